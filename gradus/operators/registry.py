"""Metrics and readers by name, so that a task's configuration can choose them.

A metric has three parts: what to extract from a response, how to score one row,
and how to summarise scored rows per group. Own ones are added to ``METRICS``,
own readers to ``READERS``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.functions import text
from gradus.operators import classify, generate, items
from gradus.sources import files


@dataclass(frozen=True)
class Metric:
    extract: Callable[[Column], Column]
    score: Callable[[Column, Column], Column]  # (prediction, label)
    summarise: Callable[[DataFrame, list[str]], DataFrame]


def mean_score(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg((F.avg("score") * 100).alias("score"), F.count("*").alias("n"))


def choices(labels: dict[str, str], tag: str = "Answer:") -> Metric:
    """Multiple choice: balanced accuracy of the label named after a tag."""
    return Metric(lambda r: text.extract_choice(r, labels, tag), lambda p, label: (p == label).cast("double"), classify.balanced_accuracy)


METRICS: dict[str, Metric] = {
    "exact_match": Metric(text.extract_answer, lambda p, label: generate.exact_match(p, F.array(label)).cast("double"), mean_score),
    "contained": Metric(text.without_reasoning, lambda p, label: generate.gold_contained(p, F.array(label)).cast("double"), mean_score),
    "strict": Metric(lambda r: r, lambda p, label: (p == label).cast("double"), mean_score),
}
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "jsonl": files.read_jsonl,
    "runs": files.read_run_files,
    "parquet": lambda spark, path: spark.read.parquet(path),
}


def load(spark: SparkSession, reader: str, path: str, where: dict | None = None, limit: int | None = None, key: str = "id", by: list[str] | None = None) -> DataFrame:
    """A task's items by the named reader: those with the given values, and of each group the first ``limit`` in order of a numeric key."""
    rows = READERS[reader](spark, path)
    for name, value in (where or {}).items():
        rows = rows.where(F.col(name) == value)
    return rows if limit is None else items.limited(rows, by or [], key, limit)


def scored(df: DataFrame, metric: Metric, response: str = "response", label: str = "label") -> DataFrame:
    """Rows with ``pred`` and ``score``; null responses count as empty ones."""
    rows = df.withColumn("pred", metric.extract(F.coalesce(F.col(response), F.lit(""))))
    return rows.withColumn("score", F.coalesce(metric.score(F.col("pred"), F.col(label)), F.lit(0.0)))


def evaluate(df: DataFrame, metric: str | Metric, by: list[str], overrides: DataFrame | None = None) -> DataFrame:
    """A metric per group; ``overrides`` names rows of ``by`` (or some of its columns) to leave out."""
    rows = df.join(overrides, overrides.columns, "left_anti") if overrides is not None else df
    metric = METRICS[metric] if isinstance(metric, str) else metric
    return metric.summarise(scored(rows, metric), by)


def evaluate_tasks(df: DataFrame, metrics: dict[str, str | Metric], by: list[str], overrides: dict[str, str | Metric] | None = None, task: str = "task") -> DataFrame:
    """(task, by, measure, value): each task by its own metric, or by the one that overrides it; tasks without a metric are left out."""
    out = None
    for name, metric in {k: (overrides or {}).get(k, m) for k, m in metrics.items()}.items():
        found = evaluate(df.where(F.col(task) == name), metric, by)
        measures = [F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in found.columns if c not in by]
        part = found.select(F.lit(name).alias("task"), *by, F.explode(F.array(*measures)).alias("e")).select("task", *by, "e.*")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no task has a metric")
    return out


def joined_contents(messages: Column) -> Column:
    """The plainest chat template: contents with blank lines between."""
    return F.array_join(F.transform(messages, lambda m: m["content"]), "\n\n")
