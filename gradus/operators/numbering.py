"""Row numbers within groups, of which one may hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same(keys: list[str], other: list[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(keys, other, strict=True):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def placed(df: DataFrame, by: list[str], order: list[str], part: Column, name: str = "place") -> DataFrame:
    """``df`` with the row's number from 0 within its group, in the given order.

    ``part`` cuts the order into parts, and must grow with it. Rows are numbered
    within their part, to which the sizes of the parts before are added: one row per
    group and part is all that is ever gathered, and no task holds a whole group.
    """
    rows = df.withColumn("_n_part", part)
    sizes = rows.groupBy(*by, "_n_part").agg(F.count("*").alias("_n_rows"))
    upto = Window.partitionBy(*by).orderBy("_n_part").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"_n_of_{k}" for k in range(len(by))]
    before = sizes.select(*[F.col(b).alias(n) for b, n in zip(by, names, strict=True)], F.col("_n_part").alias("_n_at"), F.coalesce(F.sum("_n_rows").over(upto), F.lit(0)).alias("_n_before"))
    ranked = rows.withColumn(name, F.row_number().over(Window.partitionBy(*by, "_n_part").orderBy(*order)))
    out = ranked.join(before, same([*by, "_n_part"], [*names, "_n_at"]))
    return out.withColumn(name, F.col(name) + F.col("_n_before") - 1).drop("_n_part", "_n_at", "_n_before", *names)


def numbered(df: DataFrame, by: list[str], key: str, name: str = "place", parts: int = 64, ties: Sequence[str] = ()) -> DataFrame:
    """Rows numbered from 0 in order of a numeric key within each group, then of the columns ``ties``, in parts of the key's range."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None:
        return df.withColumn(name, F.lit(0).cast("long"))
    return placed(df, by, [key, *ties], F.least(F.floor((F.col(key) - low) * parts / (high - low + 1)), F.lit(parts - 1)), name)
