"""Bounded, repeatable samples of labelled rows for fitting models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAIN = 1 << 20


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the fold that nothing is learned from; rows without an id belong to it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def per_label(rows: DataFrame, label: str, each: int, seed: int = 11) -> DataFrame:
    """About ``each`` rows of every label, at most twice as many in all, by a hash of doc_id.

    Labels come back in ``label`` as they are; rows without label or id are left
    out. Only one count per label reaches the driver.
    """
    rows = rows.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return rows.limit(0)
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, max(1, round(GRAIN * min(1.0, each / n))))])
    draw = F.xxhash64(F.lit(seed), F.col("doc_id"))
    some = rows.where(F.pmod(draw, F.lit(GRAIN)) < share[F.col(label)])
    return some.orderBy(draw).limit(2 * each * len(counts))
