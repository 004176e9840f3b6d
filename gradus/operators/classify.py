"""Metrics of predicted classes. ``by`` are the columns to group by; rows carry a label and a prediction.

Everything starts from one count per group, label and prediction, so that rows
are combined where they are read and only counts are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.functions.text import norm, ratio


def confusion(df: DataFrame, by: list[str], label: str = "label", pred: str = "pred") -> DataFrame:
    return df.groupBy(*by, F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, by: list[str], label: str = "label", pred: str = "pred") -> DataFrame:
    """precision, recall, f1 and support of every class that occurs as label or prediction; 0 where undefined."""
    counts = confusion(df, by, label, pred)
    sides = counts.select(*by, "n", F.explode(F.array(F.struct(F.lit(1).alias("ref"), F.col("label").alias("class")), F.struct(F.lit(0).alias("ref"), F.col("pred").alias("class")))).alias("side"), (F.col("label") == F.col("pred")).alias("hit"))
    per = sides.groupBy(*by, F.col("side.class").alias("class")).agg(
        F.sum(F.when(F.col("side.ref") == 1, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("side.ref") == 0, F.col("n")).otherwise(0)).alias("predicted"),
        F.sum(F.when((F.col("side.ref") == 1) & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
    )
    return per.select(
        *by,
        "class",
        "support",
        ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
    )


def class_averages(df: DataFrame, by: list[str], **columns) -> DataFrame:
    """Macro and support-weighted averages of the class report."""
    report = class_report(df, by, **columns)
    weighted = [ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")]
    return report.groupBy(*by).agg(*[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")], *weighted)


def balanced_accuracy(df: DataFrame, by: list[str], label: str = "label", pred: str = "pred") -> DataFrame:
    """Mean recall over the classes of the references, its chance-normalised form on 0 to 100, and their number."""
    hits = F.sum((F.col(pred) == F.col(label)).cast("int"))
    recall = df.groupBy(*by, label).agg((hits / F.count("*")).alias("recall"))
    out = recall.groupBy(*by).agg(F.avg("recall").alias("balanced_accuracy"), F.count("*").alias("n_labels"))
    return out.withColumn("normalized_accuracy", 100 * norm(F.col("balanced_accuracy"), 1 / F.col("n_labels"), 1.0))


def macro_f1(df: DataFrame, by: list[str], **columns) -> DataFrame:
    """Mean F1 over all classes of references and predictions, the null class included."""
    return class_report(df, by, **columns).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def null_weighted_f1(df: DataFrame, by: list[str], pred: str = "pred", null: str = "null", **columns) -> DataFrame:
    """Mean F1 over the classes of the references, times the share of predictions that are not null."""
    f1 = class_report(df, by, pred=pred, **columns).where("support > 0").groupBy(*by).agg(F.avg("f1").alias("label_f1"))
    share = df.groupBy(*by).agg(F.avg((F.col(pred) == null).cast("int")).alias("null_share"), F.count_if(F.col(pred) == null).alias("null_count"))
    return f1.join(share, by).withColumn("null_weighted_f1", F.col("label_f1") * (1 - F.col("null_share")))


def _facets(df: DataFrame, by: list[str], groups: list[str]) -> DataFrame:
    facets = F.array(F.struct(F.lit("all").alias("facet"), F.lit("all").alias("value")), *[F.struct(F.lit(g).alias("facet"), F.col(g).cast("string").alias("value")) for g in groups])
    return df.select(*by, "label", "pred", F.explode(facets).alias("f")).select(*by, "f.facet", "f.value", "label", "pred")


def subgroup_macro_f1(df: DataFrame, by: list[str], groups: list[str]) -> DataFrame:
    """Macro-F1 over all rows and within each value of each group column, as (facet, value)."""
    return macro_f1(_facets(df, by, groups), [*by, "facet", "value"])


def subgroup_accuracy(df: DataFrame, by: list[str], groups: list[str]) -> DataFrame:
    """Balanced accuracy over all rows and within each value of each group column, as (facet, value)."""
    rows = _facets(df, by, groups)
    return balanced_accuracy(rows, [*by, "facet", "value"]).select(*by, "facet", "value", "balanced_accuracy")
