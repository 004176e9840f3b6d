"""Contests between models, win rates and ratings."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from gradus.functions.draws import below, divided, draw, permuted
from gradus.functions.text import ratio


def decoded(ix: Column, runs: int, turns: int, pairs: Column) -> dict[str, Column]:
    """run, turn, item and the two models (a > b) of a contest's index."""
    rest = divided(ix, runs)
    item_pair = divided(rest, turns)
    p = item_pair % pairs
    a = F.floor((1 + F.sqrt(1 + 8.0 * p)) / 2).cast("long")
    return {"run": ix % runs, "turn": rest % turns, "item_ix": divided(item_pair, pairs), "model_a": a, "model_b": p - divided(a * (a - 1), 2)}


def n_contests(runs: int, turns: int, items: Column, models: int) -> Column:
    """How many contests there are: each pair of models on each run, turn and item."""
    return items * (runs * turns * models * (models - 1) // 2)


def contests(groups: DataFrame, by: list[str], seed: int, runs: int, models: int) -> DataFrame:
    """(by, contest, run, item_ix, model_a, model_b): the contests of each group, drawn by hash.

    ``groups`` has one row per group with its number of items (``n``), which are
    numbered by ``item_ix``, and of contests (``n_contests``). A group that has enough
    contests is drawn from without replacement: its k-th contest is the place of k
    under a keyed permutation of all there are, so that as many rows are made as
    are drawn. Any other is drawn from with replacement.
    """
    pairs = models * (models - 1) // 2
    rows = groups.select(*by, "n_contests", n_contests(runs, 1, F.col("n"), models).alias("_total"), draw(seed, *by).alias("_key"))
    rows = rows.repartition(groups.sparkSession.sparkContext.defaultParallelism, *by)  # few rows, each of many contests
    rows = rows.withColumn("contest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_contests").cast("long") - 1)))
    once = permuted(rows.where("n_contests <= _total"), "contest", "_total", "_key", "ix").select(*by, "contest", "ix")
    again = rows.where("n_contests > _total").select(*by, "contest", below(F.col("_total"), seed, *by, "contest").alias("ix"))
    rows = once.unionByName(again)
    return rows.select(*by, "contest", *[c.alias(n) for n, c in decoded(F.col("ix"), runs, 1, F.lit(pairs)).items()])


def outcome(x: Column, y: Column, atol: float = 1e-4, rtol: float = 1e-5) -> Column:
    """1 if x wins, 0.5 if both are close, else 0; a NaN is close to nothing and wins nothing."""
    close = F.coalesce(F.abs(x - y) <= F.lit(atol) + rtol * F.abs(y), F.lit(False)) & ~F.isnan(x) & ~F.isnan(y)
    return F.when(close, 0.5).when((x > y) & ~F.isnan(x), 1.0).otherwise(0.0)


def win_rates(df: DataFrame, by: list[str], a: str = "model_a", b: str = "model_b", result: str = "outcome") -> DataFrame:
    """Wins over appearances of each model; ties count in the latter only."""
    sides = F.array(F.struct(F.col(a).alias("model"), (F.col(result) == 1).alias("won")), F.struct(F.col(b).alias("model"), (F.col(result) == 0).alias("won")))
    rows = df.select(*by, F.explode(sides).alias("s"))
    return rows.groupBy(*by, "s.model").agg(F.avg(F.col("s.won").cast("int")).alias("win_rate"), F.count("*").alias("n"))


def allocation(df: DataFrame, levels: list[str], total: int) -> DataFrame:
    """How many contests each finest group gets: the total, split evenly at every level and rounded up each time."""
    rows, n = df.select(*levels).distinct(), F.lit(total).cast("long")
    for depth, level in enumerate(levels):  # windows over one row for each finest group
        n = F.ceil(n / F.size(F.collect_set(level).over(Window.partitionBy(*levels[:depth]))))
    return rows.select(*levels, n.alias("n_contests"))


def balanced(df: DataFrame, entities: list[str], total: int) -> DataFrame:
    """(balance_by, entity, n_contests): the total split evenly over the values of each of the columns, rounded up."""
    rows = None
    for name in entities:
        part = df.select(F.lit(name).alias("balance_by"), F.col(name).cast("string").alias("entity")).distinct()
        rows = part if rows is None else rows.unionByName(part)
    count = rows.groupBy("balance_by").agg(F.count("*").alias("k"))
    return rows.join(count, "balance_by").select("balance_by", "entity", F.ceil(F.lit(total) / F.col("k")).alias("n_contests"))


def strengths(pdf: pd.DataFrame, rounds: int = 150, tolerance: float = 1e-13) -> dict:
    """Maximum-likelihood strengths, of geometric mean 1, from sums per pair of models: (model_a, model_b, w, n)."""
    wins: dict = {}
    games: dict = {}
    for a, b, w, n in zip(pdf["model_a"], pdf["model_b"], pdf["w"], pdf["n"], strict=True):
        wins[a] = wins.get(a, 0.0) + w
        wins[b] = wins.get(b, 0.0) + n - w
        key = (min(a, b), max(a, b))
        games[key] = games.get(key, 0) + n
    p = dict.fromkeys(wins, 1.0)
    for _ in range(rounds):
        load = dict.fromkeys(p, 0.0)
        for (a, b), n in games.items():
            share = n / (p[a] + p[b])
            load[a] += share
            load[b] += share
        new = {m: min(1e9, max(1e-9, wins[m] / load[m])) for m in p}
        centre = math.exp(sum(map(math.log, new.values())) / len(new))
        new = {m: v / centre for m, v in new.items()}
        moved = max(abs(new[m] - p[m]) for m in p)
        p = new
        if moved < tolerance:
            break
    return p


def bradley_terry(pairs: DataFrame, by: list[str], scale: float = 400.0, base: float = 10.0, start: float = 1000.0) -> DataFrame:
    """(by, model, rating): maximum-likelihood ratings from (model_a, model_b, outcome), centred on ``start``; a tie is half a win for each.

    Contests are summed per pair of models before anything is gathered; the
    iteration runs beside others over that table, whose size is the number of pairs
    of models. A model that wins or loses all of its contests has no finite rating:
    its strength stops at the bounds 1e-9 and 1e9.
    """
    sums = pairs.groupBy(*by, "model_a", "model_b").agg(F.sum("outcome").alias("w"), F.count("*").alias("n"))
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in sums.select(*by).schema)

    def fit(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = strengths(pdf)
        out = pd.DataFrame({"model": list(found), "rating": [start + scale * math.log(v) / math.log(base) for v in found.values()]})
        for name, value in zip(by, keys, strict=True):
            out.insert(0, name, value)
        return out[[*by, "model", "rating"]]

    return sums.groupBy(*by).applyInPandas(fit, f"{schema}model {sums.schema['model_a'].dataType.simpleString()}, rating double")


def elo(df: DataFrame, by: list[str], order: str, k: float = 4.0, start: float = 1000.0, decay: bool = True) -> DataFrame:
    """Ratings after all contests of a group, taken in order: (by, model, rating).

    The order makes a group one fold; groups (bootstraps) run side by side. ``k``
    falls in equal steps to 0 over the group if ``decay``.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*by).schema)

    def fold(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        ratings: dict = {}
        n = len(pdf)
        for i, (a, b, result) in enumerate(zip(pdf["model_a"], pdf["model_b"], pdf["outcome"], strict=True)):
            x, y = ratings.get(a, start), ratings.get(b, start)
            move = (k * (1 - i / n) if decay else k) * (result - 1 / (1 + 10 ** ((y - x) / 400)))
            ratings[a], ratings[b] = x + move, y - move
        out = pd.DataFrame({"model": list(ratings), "rating": list(ratings.values())})
        for name, value in zip(by, keys, strict=True):
            out.insert(0, name, value)
        return out[[*by, "model", "rating"]]

    kind = df.schema["model_a"].dataType.simpleString()
    return df.groupBy(*by).applyInPandas(fold, f"{schema}, model {kind}, rating double")


def rating_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean over bootstraps, std_adj (the sample deviation, corrected once more for the sample's size) and a normal 95 % interval of the mean."""
    n = F.count(value)
    std = F.stddev_samp(value) * F.sqrt(n / F.nullif(n - 1, F.lit(0)))
    out = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(std, F.lit(0.0)).alias("std_adj"), n.alias("n"))
    half = 1.959963984540054 * F.col("std_adj") / F.sqrt("n")
    return out.withColumns({"low": F.col("mean") - half, "high": F.col("mean") + half})


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny = 1e-300
    c, d = 1.0, 1 / max(tiny, 1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            c = 1 + step / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    if math.isnan(t) or df <= 0:
        return float("nan")
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


@pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(float(x), float(n)) for x, n in zip(t, df, strict=True)], dtype="float64")


def paired_t(df: DataFrame, key: str, model: str, value: str) -> DataFrame:
    """(model_a, model_b, t, n, p) of each pair of models, over the keys that both have."""
    a = df.select(key, F.col(model).alias("model_a"), F.col(value).alias("x"))
    b = df.select(key, F.col(model).alias("model_b"), F.col(value).alias("y"))
    rows = a.join(b, key).where("model_a < model_b").withColumn("d", F.col("x") - F.col("y"))
    out = rows.groupBy("model_a", "model_b").agg(ratio(F.avg("d"), F.stddev_samp("d") / F.sqrt(F.count("d"))).alias("t"), F.count("d").alias("n"))
    return out.withColumn("p", t_pvalue("t", (F.col("n") - 1).cast("double")))
