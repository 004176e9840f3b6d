"""Means of means, bootstraps over runs, and completeness."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions.draws import below, divided, intervals, resampled_sums, uniform
from gradus.functions.text import norm, ratio
from gradus.operators.logprob import stderr
from gradus.operators.numbering import numbered, same


def mean_of_means(df: DataFrame, levels: list[str], value: str) -> dict[str, DataFrame]:
    """The mean at each level of the mean of the level below, the finest level last in ``levels``.

    Not what a rollup gives, which is the mean of all rows.
    """
    out, rows = {}, df
    for depth in range(len(levels), 0, -1):
        rows = rows.groupBy(*levels[:depth]).agg(F.avg(value).alias(value))
        out[levels[depth - 1]] = rows
    return out


def grouped(df: DataFrame, by: list[str], group: str, task: str, value: str) -> DataFrame:
    """Members of an aggregation group are replaced by their mean; tasks without a group stand for themselves."""
    return df.groupBy(*by, F.coalesce(F.col(group), F.col(task)).alias("task")).agg(F.avg(value).alias(value))


def micro(df: DataFrame, by: list[str], value: str, n: str) -> DataFrame:
    """Mean weighted by the number of rows."""
    return df.groupBy(*by).agg(ratio(F.sum(F.col(value) * F.col(n)), F.sum(n)).alias(value))


def resampled(df: DataFrame, keys: list[str], run: str, bootstraps: int, seed: int) -> DataFrame:
    """For each bootstrap and item one of its runs, drawn by hash. ``df`` has a row per item (``keys``) and run, from 0."""
    runs = df.groupBy(*keys).agg(F.max(run).alias("_last"))
    drawn = runs.withColumn("bootstrap", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bootstraps - 1).cast("long"))))
    drawn = drawn.withColumn(run, below(F.col("_last") + 1, seed, "bootstrap", *keys)).drop("_last")
    return df.join(drawn, [*keys, run])


def with_error(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and standard error over bootstraps."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), stderr(F.col(value)).alias("stderr"), F.count("*").alias("n_bootstraps"))


def auto_scaled(value: Column, most: Column) -> Column:
    """On 0 to 100, whichever scale it came in."""
    return F.when(most <= 1, value * 100).otherwise(value)


def scaled_means(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Means on 0 to 100 of groups that may be on 0 to 1: those are, none of whose values is above 1."""
    return df.groupBy(*by).agg(auto_scaled(F.avg(value), F.max(value)).alias(value))


def pragmatics(counts: DataFrame, by: list[str], phenomenon: str, low: float = 0.5) -> DataFrame:
    """accuracy and normalized, on 0 to 100: the mean over phenomena of n_correct over n_total, summed over a phenomenon's tasks."""
    per = counts.groupBy(*by, phenomenon).agg((F.sum("n_correct") / F.sum("n_total")).alias("a"))
    out = per.groupBy(*by).agg(F.avg("a").alias("a"))
    return out.select(*by, (F.col("a") * 100).alias("accuracy"), (norm(F.col("a"), low, 1.0) * 100).alias("normalized"))


def diagnostics(components: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean of the components that are there."""
    return components.where(F.col(value).isNotNull()).groupBy(*by).agg(F.avg(value).alias(value), F.count("*").alias("n_components"))


def success(percent: Column, seed: int, *keys: str) -> Column:
    """1 with the given probability in percent, drawn by hash."""
    return (uniform(seed, *keys) < percent / 100).cast("int")


def redrawn_means(rows: DataFrame, by: list[str], key: str, value: str, bootstraps: int, seed: int, slices: int = 20, chunk: int = 1 << 14, piece: int = 256) -> DataFrame:
    """(by, bootstrap, value): the mean over as many rows as a group has, drawn from it with replacement, in each bootstrap.

    Rows are numbered in order of the numeric ``key``; the i-th draw of a bootstrap
    takes the row at draw(seed, by, bootstrap, i) % n. Draws are made where they are
    used and never move. What moves are the values, as arrays of ``chunk`` places, once
    for each of a few slices of the bootstraps. A task holds ``piece`` chunks at once:
    a group with more is taken in pieces, each of which makes the group's draws and
    sums those that fall on it. Null values count as drawn, but not in the mean.
    """
    names = [f"_of_{i}" for i in range(len(by))]
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n")).select(*[F.col(b).alias(n) for b, n in zip(by, names, strict=True)], "_n")
    at = numbered(rows.select(*by, key, F.col(value).cast("double").alias("_value")), by, key, "_at", ties=["_value"])
    chunks = at.groupBy(*by, divided(F.col("_at"), chunk).alias("_chunk")).agg(F.sort_array(F.collect_list(F.struct("_at", "_value")))["_value"].alias("_values"))
    chunks = chunks.join(sizes, same(by, names)).drop(*names)
    head = F.concat_ws("|", F.lit(str(seed)), *[F.col(b).cast("string") for b in by])
    each = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    chunks = chunks.withColumns({"_head": head, "_piece": divided(F.col("_chunk"), piece), "_slice": each})

    def sums(table: pa.Table) -> pa.Table:
        table = table.sort_by("_chunk")
        first = table.slice(0, 1).to_pylist()[0]
        flat = pa.concat_arrays([c.flatten() for c in table["_values"].chunks])
        mine = range(bootstraps * first["_slice"] // slices, bootstraps * (first["_slice"] + 1) // slices)
        there, values = (x.to_numpy(zero_copy_only=False) for x in (flat.is_valid(), flat.fill_null(0.0)))
        total, count = resampled_sums(f"{first['_head']}|".encode(), mine, first["_n"], first["_piece"] * piece * chunk, values, there)
        out = table.select(by).take([0] * len(mine))
        for name, column in (("bootstrap", np.arange(mine.start, mine.stop)), ("_total", total), ("_count", count)):
            out = out.append_column(name, pa.array(column))
        return out

    places = [*by, "_slice", "_piece"]
    tasks = 8 * rows.sparkSession.sparkContext.defaultParallelism
    kinds = ", ".join([f"`{b}` {rows.schema[b].dataType.simpleString()}" for b in by] + ["bootstrap long, _total double, _count long"])
    sums_of = chunks.repartition(tasks, *places).groupBy(*places).applyInArrow(sums, kinds)
    return sums_of.groupBy(*by, "bootstrap").agg(F.try_divide(F.sum("_total"), F.sum("_count")).alias(value))


def percentile_interval(df: DataFrame, by: list[str], key: str, value: str, bootstraps: int, seed: int) -> DataFrame:
    """(by, low, mid, high): the median and the middle 95 % of the means of resampled rows, of which each bootstrap draws as many as there are with replacement.

    The numeric ``key`` tells a group's rows apart.
    """
    return intervals(redrawn_means(df, by, key, value, bootstraps, seed), by, value)


def completeness(expected: DataFrame, actual: DataFrame, keys: list[str], model: list[str], reasoning: str | None = None) -> DataFrame:
    """Per model: how many expected results are there, which are missing or have fewer rows than expected, and a status.

    ``expected`` has the keys and ``n_expected``, ``actual`` the keys and ``n``, and with
    ``reasoning`` a column of how many of its rows have reasoning: results that lack
    some are listed too, and make a run incomplete.
    """
    both = expected.join(actual, keys, "left")
    missing, short = F.col("n").isNull(), F.col("n") < F.col("n_expected")
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in keys if k not in model])
    listed = lambda which: F.array_join(F.array_sort(F.collect_list(F.when(which, name))), ",")
    lists = {"missing": missing, "incomplete": short} | ({"missing_reasoning": F.col(reasoning) < F.col("n")} if reasoning else {})
    out = both.groupBy(*model).agg(F.count_if(~missing).alias("n_present"), F.count("*").alias("n_expected"), *[listed(w).alias(c) for c, w in lists.items()])
    whole = F.lit(True)
    for c in lists:
        whole = whole & (F.col(c) == "")
    return out.withColumn("status", F.when(F.col("n_present") == 0, "Error").when(whole, "Complete").otherwise("Incomplete"))


def report_table(report: DataFrame, rows: str, columns: str, values: list, cell: str) -> DataFrame:
    """A report with a column for each of the given values; cells without a result are null."""
    return report.groupBy(rows).pivot(columns, values).agg(F.first(cell))
