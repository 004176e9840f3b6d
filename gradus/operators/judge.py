"""Verdicts of judges: parsing, combining and scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions.text import first_group, last_match, ratio

CLASS = r"<classification>\s*([^<]*?)\s*</classification>"


def verdict(text: Column, swapped: Column | None = None) -> Column:
    """WIN, LOSE or TIE of side A when exactly one of [[A]], [[B]] and [[C]] is named, else ERROR; A and B change places if swapped."""
    a, b, c = (F.contains(text, F.lit(f"[[{x}]]")) for x in "ABC")
    one = (a.cast("int") + b.cast("int") + c.cast("int")) == 1
    flip = F.lit(False) if swapped is None else swapped
    side = F.when(c, "TIE").when(a != flip, "WIN").otherwise("LOSE")
    return F.coalesce(F.when(one, side), F.lit("ERROR"))


def combined(first: Column, second: Column, ties: bool = True) -> Column:
    """The verdict of both orders: theirs if they agree, else TIE, or ERROR where ties are not allowed."""
    return F.when(first == second, first).otherwise("TIE" if ties else "ERROR")


def points(outcome: Column) -> Column:
    return F.when(outcome == "WIN", 1.0).when(outcome == "TIE", 0.5).otherwise(0.0)


def classification(text: Column, last: bool = False) -> Column:
    """The class in the first, or last, classification tag."""
    return last_match(text, CLASS) if last else first_group(text, CLASS)


def weight(cls: Column, weights: dict[str, float]) -> Column:
    """The class's weight, 0 for unknown classes and null."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[cls], F.lit(0.0))


def correct(text: Column) -> Column:
    """1 if the verdict says CORRECT as a word of its own, 0 if INCORRECT, both or neither."""
    return (text.rlike(r"\bCORRECT\b") & ~text.rlike(r"\bINCORRECT\b")).cast("int")


def criteria_score(df: DataFrame, by: list[str], item: list[str], category: str, value: str) -> DataFrame:
    """An item's score is the mean over its criteria; means of items on 0 to 100 per category, and of all under a null category."""
    items = df.groupBy(*by, category, *item).agg(F.avg(value).alias("score"))
    sets = [[*map(F.col, by), F.col(category)], [*map(F.col, by)]]
    return items.groupingSets(sets, *by, category).agg((F.avg("score") * 100).alias("score"), F.count("*").alias("n_items"))


def two_turn_score(df: DataFrame, by: list[str], turn: str, value: str) -> DataFrame:
    """Mean of the two turns' means; a turn without scores counts as 0."""
    mean = lambda t: F.coalesce(F.avg(F.when(F.col(turn) == t, F.col(value))), F.lit(0.0))
    return df.groupBy(*by).agg(mean(0).alias("turn_0"), mean(1).alias("turn_1")).withColumn("score", (F.col("turn_0") + F.col("turn_1")) / 2)


SEVERITY = {"high": 10.0, "medium": 5.0, "low": 1.0, "generic": 1.0}


def severity_score(df: DataFrame, by: list[str], severity: str, value: str) -> DataFrame:
    """generic and criteria: weighted means of the values of generic criteria, and of the rest; overall is their product."""
    w = F.coalesce(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[F.col(severity)], F.lit(1.0))
    part = lambda on: ratio(F.sum(F.when(on, w * F.col(value))), F.sum(F.when(on, w)))
    generic = F.coalesce(F.col(severity) == "generic", F.lit(False))
    out = df.groupBy(*by).agg(part(generic).alias("generic"), part(~generic).alias("criteria"))
    return out.withColumn("overall", F.col("generic") * F.col("criteria"))


def rubric_score(df: DataFrame, by: list[str], met: str, value: str) -> DataFrame:
    """Points met over all positive points, at least 0; criteria without a verdict are not met."""
    got = F.sum(F.when(F.coalesce(F.col(met), F.lit(False)), F.col(value)).otherwise(0))
    return df.groupBy(*by).agg(F.greatest(ratio(got, F.sum(F.greatest(F.col(value), F.lit(0)))), F.lit(0.0)).alias("score"))


def win_rates(df: DataFrame, by: list[str], category: str, outcome: str) -> DataFrame:
    """win_rate: points over all outcomes, errors included; weighted: the mean of the categories' rates on 0 to 100."""
    per = df.groupBy(*by, category).agg(F.sum(points(F.col(outcome))).alias("points"), F.count("*").alias("n"))
    return per.groupBy(*by).agg((F.sum("points") / F.sum("n")).alias("win_rate"), (F.avg(F.col("points") / F.col("n")) * 100).alias("weighted"), F.sum("n").alias("n"))


def fine_grained(df: DataFrame, by: list[str], first: str, second: str, most: float) -> DataFrame:
    """Scores of both orders averaged (null if either is): score on 0 to 100, wins, ties and nulls as shares."""
    x = (F.col(first) + F.col(second)) / 2
    return df.groupBy(*by).agg(
        (F.sum(F.coalesce(x, F.lit(0.0))) / (most * F.count("*")) * 100).alias("score"),
        F.avg(F.coalesce((x > 0.5).cast("int"), F.lit(0))).alias("win"),
        F.avg(F.coalesce((x == 0.5).cast("int"), F.lit(0))).alias("tie"),
        F.count_if(x.isNull()).alias("null_count"),
    )


def labelled_points(judgement: Column, labels: list[str], scores: list[float], reverse: bool = False) -> Column:
    """The score of the first label, in order of the list, that the judgement holds; scores the other way round if ``reverse``; null for none."""
    out = F.lit(None).cast("double")
    for label, score in reversed(list(zip(labels, reversed(scores) if reverse else scores, strict=True))):
        out = F.when(F.contains(judgement, F.lit(label)), float(score)).otherwise(out)
    return out


def harmonic(a: Column, b: Column) -> Column:
    return ratio(2 * a * b, a + b)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, in double precision; 0 if either is zero."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda acc, v: acc + v)
    return ratio(dot(x, y), F.sqrt(dot(x, x) * dot(y, y)))
