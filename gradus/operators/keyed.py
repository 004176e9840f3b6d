"""Joins, set operations and order-dependent operators on keyed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.functions.text import f_measure, let, normalize_cell, ratio


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; of the wide row only the greatest is carried, so that hot keys combine before the shuffle."""
    row = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(row).select("_row.*")


def missing(expected: DataFrame, received: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(received, keys, "left_anti")


def in_order(expected: DataFrame, received: DataFrame, keys: list[str]) -> DataFrame:
    """Every expected row with what was received for it, if anything."""
    return expected.join(received, keys, "left")


def first_per_group(df: DataFrame, group: list[str], order: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def conversation_so_far(df: DataFrame, conv: str, turn: str, text: Column) -> DataFrame:
    """At each turn the texts up to it, joined by newlines."""
    w = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select(conv, turn, F.array_join(F.collect_list(text).over(w), "\n").alias("so_far"))


def set_recall(pred: Column, ref: Column) -> Column:
    """Share of the distinct references that the prediction holds."""
    return ratio(F.size(F.array_intersect(pred, ref)), F.size(F.array_distinct(ref)))


def table_scores(pred: DataFrame, ref: DataFrame, table: str, row: list[str]) -> DataFrame:
    """Precision, recall and F1 of a table's rows, each row counting as often as it occurs; cells compare normalised."""
    clean = lambda df: df.select(table, *[normalize_cell(F.col(c).cast("string")).alias(c) for c in row])
    p, r = (clean(d).groupBy(table, *row).agg(F.count("*").alias(n)) for d, n in ((pred, "n"), (ref, "m")))
    both = p.join(r, [table, *row], "full")
    out = both.groupBy(table).agg(
        ratio(F.sum(F.when(F.col("m").isNotNull(), F.col("n"))), F.sum("n")).alias("precision"), ratio(F.sum(F.when(F.col("n").isNotNull(), F.col("m"))), F.sum("m")).alias("recall")
    )
    return out.withColumn("f1", f_measure(F.col("precision"), F.col("recall")))


def matching_prefix(pred: Column, ref: Column) -> Column:
    """Number of leading elements that agree."""
    pairs = F.arrays_zip(pred.alias("a"), ref.alias("b"))
    differ = F.array_position(F.transform(pairs, lambda x: F.coalesce(x["a"] == x["b"], F.lit(False))), False)
    return F.when(differ > 0, differ - 1).otherwise(F.least(F.size(pred), F.size(ref)).cast("long"))


def top_words(df: DataFrame, group: list[str], words: Column, k: int) -> DataFrame:
    """The k most frequent words of each group, ties in order of the word."""
    counts = df.select(*group, F.explode(words).alias("word")).groupBy(*group, "word").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*group).orderBy(F.desc("n"), "word")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


EQUATION = r"(-?\d{1,9})\s*([-+*/])\s*(-?\d{1,9})\s*=\s*(-?\d{1,18})"


def countdown_line(line: Column) -> Column:
    """Whether ``a op b = c`` holds; null if the line is no such equation. Text is never evaluated."""

    def holds(part: Column) -> Column:
        a, op, b, c = (F.get(part, F.lit(g)) for g in range(4))
        a, b, c = (x.try_cast("long") for x in (a, b, c))
        whole = F.when((b != 0) & (F.try_mod(a, b) == 0), F.try_divide(a, b).cast("long"))
        value = F.when(op == "+", a + b).when(op == "-", a - b).when(op == "*", a * b).otherwise(whole)
        return F.when(F.size(part) == 4, F.coalesce(value == c, F.lit(False)))

    parts = F.when(line.rlike(EQUATION), F.array(*[F.regexp_extract(line, EQUATION, g) for g in range(1, 5)])).otherwise(F.array().cast("array<string>"))
    return let(parts, holds)


def options(items: Column) -> Column:
    """``A. first`` and so on, one a line."""
    return F.array_join(F.transform(items, lambda o, i: F.concat(F.char(F.lit(65) + i), F.lit(". "), F.trim(o))), "\n")


def filled_template(template: str, values: dict[str, Column]) -> Column:
    """``{name}`` replaced by values, all at once: braces in a value stay."""
    parts, rest = [], template
    while "{" in rest and "}" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(before), F.coalesce(values[name].cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def with_answer_at(distractors: Column, answer: Column, place: Column) -> Column:
    """Distractors with the answer put at a place, from 0."""
    return F.array_insert(distractors, place + 1, answer)
