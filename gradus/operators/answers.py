"""Answers that need parsing: numbers and fractions, countdown and travel procedures, error counts."""

from __future__ import annotations

import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, DoubleType

from gradus.functions.algebra import equivalent

_FRACTION = re.compile(r"\\[dt]?frac\{([^{}]+)\}\{([^{}]+)\}")
_NOISE = re.compile(r"\\(?:left|right|,|;|!|text\{[^{}]*\}|mathrm\{[^{}]*\}|displaystyle)|[\s$]|\\%|%|°|\\circ|\^\\circ")


def plain(text: str) -> str:
    """A formula without layout: fractions as a/b, no spaces, no trailing dot."""
    t = text.strip()
    while (m := _FRACTION.search(t)) is not None:
        t = f"{t[: m.start()]}({m[1]})/({m[2]}){t[m.end():]}"
    t = _NOISE.sub("", t).replace("\\cdot", "*").replace("\\times", "*").replace("−", "-")
    return t.rstrip(".").strip("{}")


def value(text: str) -> Fraction | None:
    """The number that a plain text stands for: integers with thousands separators, decimals, one division."""
    t = re.sub(r"(?<=\d),(?=\d{3}(?:\D|$))", "", text.replace("(", "").replace(")", ""))
    m = re.fullmatch(r"([+-]?\d{1,40}(?:\.\d{1,40})?)(?:/([+-]?\d{1,40}(?:\.\d{1,40})?))?", t)
    if not m:
        return None
    bottom = Fraction(m[2]) if m[2] else Fraction(1)
    return Fraction(m[1]) / bottom if bottom else None


def same_answer(a: str | None, b: str | None) -> bool:
    """Equal as numbers, as sets of comma-separated answers, as formulas without layout, or by their values at random points."""
    if a is None or b is None:
        return False
    x, y = plain(a), plain(b)
    if x == y:
        return x != ""
    p, q = value(x), value(y)
    if p is not None and q is not None:
        return p == q
    parts = [[re.sub(r"^[a-z]=", "", s) for s in re.split(r",(?!\d{3}(?:\D|$))", t)] for t in (x, y)]
    key = lambda s: (0, value(s)) if value(s) is not None else (1, s)
    if len(parts[0]) == len(parts[1]) > 1 and sorted(map(str, map(key, parts[0]))) == sorted(map(str, map(key, parts[1]))):
        return not x.startswith(("(", "[")) or equivalent(a, b)
    return equivalent(a, b)


@pandas_udf(BooleanType())
def math_equal(pred: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([same_answer(a, b) for a, b in zip(pred, ref, strict=True)], dtype="boolean")


_STEP = re.compile(r"^\s*(-?\d{1,9})\s*([-+*/])\s*(-?\d{1,9})\s*=\s*(-?\d{1,18})\s*$")


def countdown_ok(lines: list[str], numbers: list[int], target: int) -> bool:
    """Equations that each use numbers still there, give back their result, and end at the target. Never evaluated as code."""
    left = list(numbers)
    last = None
    for line in lines:
        m = _STEP.match(line)
        if not m:
            return False
        a, b, c = int(m[1]), int(m[3]), int(m[4])
        for n in (a, b):
            if n not in left:
                return False
            left.remove(n)
        if m[2] == "/":
            ok = b != 0 and b * c == a
        else:
            ok = c == {"+": a + b, "-": a - b, "*": a * b}[m[2]]
        if not ok:
            return False
        left.append(c)
        last = c
    return last == target


@pandas_udf(BooleanType())
def countdown_solved(text: pd.Series, numbers: pd.Series, target: pd.Series) -> pd.Series:
    rows = zip(text, numbers, target, strict=True)
    return pd.Series([bool(t) and countdown_ok([x for x in t.split("\n") if x.strip()], list(map(int, n)), int(g)) for t, n, g in rows], dtype="boolean")


_STAY = re.compile(r"(?:visit|in|stay(?:ing)? in)\s+([A-Z][\w' -]*?)\s+for\s+(\d{1,9})\s+days?", re.I)


def stays(text: str) -> list[tuple[str, int]]:
    """(city, days) in the order of the text."""
    return [(m[1].strip().lower(), int(m[2])) for m in _STAY.finditer(text or "")]


@pandas_udf(DoubleType())
def travel_score(text: pd.Series, cities: pd.Series, days: pd.Series) -> pd.Series:
    """Share of the plan's leading stays that are right: 1 for the whole plan, and no more stays than it has."""

    def score(t: str, c: str, d: str) -> float:
        want = list(zip([x.strip().lower() for x in c.split("**")], map(int, d.split("**")), strict=False))
        got = stays(t)
        n = 0
        while n < min(len(got), len(want)) and got[n] == want[n]:
            n += 1
        return n / max(len(want), len(got), 1)

    return pd.Series([score(*x) for x in zip(text, cities, days, strict=True)], dtype="float64")


def passed_at_one(df: DataFrame, by: list[str], item: str, passed: str) -> DataFrame:
    """Share of items all of whose tests passed; a test without a result failed."""
    items = df.groupBy(*by, item).agg(F.min(F.coalesce(F.col(passed), F.lit(False)).cast("int")).alias("ok"))
    return items.groupBy(*by).agg(F.avg("ok").alias("pass_at_1"), F.count("*").alias("n_items"))


def error_counts(df: DataFrame, by: list[str], errors: Column) -> DataFrame:
    return df.select(*by, F.explode(errors).alias("error")).groupBy(*by, "error").agg(F.count("*").alias("n"))
