"""Summaries of log-probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stderr(x: Column) -> Column:
    """Standard error of the mean of the non-null values, 0 for fewer than two."""
    return F.coalesce(F.sqrt(F.var_samp(x) / F.count(x)), F.lit(0.0))


def _mean(x: Column) -> Column:
    return F.when(F.count(x) < 2, 0.0).otherwise(F.avg(x))


def summary(df: DataFrame, by: list[str], logprob: str = "logprob") -> DataFrame:
    """null_count, mean_logprob and its error over non-null values (0 for fewer than two), mean probability with null as 0, on 0 to 100, and its error."""
    lp = F.col(logprob)
    p = F.coalesce(F.exp(lp) * 100, F.lit(0.0))
    return df.groupBy(*by).agg(
        F.count_if(lp.isNull()).alias("null_count"),
        _mean(lp).alias("mean_logprob"),
        stderr(lp).alias("stderr_logprob"),
        F.avg(p).alias("mean_probability"),
        stderr(p).alias("stderr_probability"),
    )


def by_group(df: DataFrame, by: list[str], group: str, logprob: str = "logprob") -> DataFrame:
    """The summary of each group, and of all rows under a null group."""
    lp = F.col(logprob)
    p = F.coalesce(F.exp(lp) * 100, F.lit(0.0))
    return df.groupingSets([[*map(F.col, by), F.col(group)], [*map(F.col, by)]], *by, group).agg(
        F.count_if(lp.isNull()).alias("null_count"), F.avg(p).alias("mean_probability"), F.count("*").alias("n")
    )


def total_over_tokens(df: DataFrame, item: list[str], position: str, logprob: str = "logprob") -> DataFrame:
    """An answer's log-probability: the sum over its tokens, with the number of tokens."""
    return df.groupBy(*item).agg(F.sum(logprob).alias("logprob"), F.count(position).alias("n_tokens"))


def cumulative(df: DataFrame, item: list[str], position: str, logprob: str = "logprob") -> DataFrame:
    """``so_far``: the log-probability of an answer up to each of its tokens."""
    w = Window.partitionBy(*item).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("so_far", F.sum(logprob).over(w))


def group_mean_accuracy(df: DataFrame, by: list[str], group: str, n_choices: int, correct: str = "correct") -> DataFrame:
    """Mean of the groups' accuracies on 0 to 100, and that normalised for chance."""
    means = df.groupBy(*by, group).agg((F.avg(correct) * 100).alias("accuracy"))
    low = 100.0 / n_choices
    out = means.groupBy(*by).agg(F.avg("accuracy").alias("accuracy"))
    return out.withColumn("normalized", F.greatest((F.col("accuracy") - low) / (100 - low), F.lit(0.0)) * 100)


def correct_and_total(df: DataFrame, by: list[str], correct: str = "correct") -> DataFrame:
    return df.groupBy(*by).agg(F.sum(correct).cast("long").alias("n_correct"), F.count("*").alias("n_total"))
