"""Mixing sources to target weights by fitting a subset-sum budget.

Sizes are counts of words. Each source gets a target: its share by weight, but
no more than ``most`` times what it has; what is over goes to the others by
weight. A source takes every document as often as its target holds its whole
size. The rest of the budget goes to a subset of its documents:

1. Documents are counted by exact size. A table of sizes and counts stands for
   the source from here on; it has one row per distinct size.
2. Of each size a like share is taken, rounded down. What then is left of the
   budget is closed by a bounded-knapsack program over sums, with single
   documents and powers of two of them as items.
3. The chosen number of documents of each size is drawn by a seeded hash. The
   order is found in two steps, first over slices of the hash, then within the
   one slice where the number is reached, so that a size which very many
   documents share is never ordered in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.llm.tables import cut, width

WORD = r"[^\x20\x09-\x0D]+"
SLICE = 1000  # documents of one size in a slice of the hash, on average


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# ----------------------------------------------------------------- targets
def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Weights go to the sources in order of code points, null last, over and over.
    A source is full if the level, the budget per weight, passes most * size /
    weight. In order of that bound, the level follows from running sums: the
    sources before are full and the others share what is left. These windows
    see one row per source.
    """
    alone = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.array(*[F.lit(w) for w in weights])[((F.row_number().over(alone) - 1) % len(weights)).cast("int")]
    given = sizes.select("source", "source_size", weight.cast("double").alias("w"))
    by = Window.orderBy((F.col("source_size") / F.col("w")), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    total = F.sum("source_size").over(every)
    level = (total - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0))) / F.sum("w").over(after)
    found = given.select("source", "source_size", "w", level.alias("level"), (F.col("source_size") * most / F.col("w")).alias("bound"))
    # the level of the first source that is not full holds for all after it
    shared = F.min(F.when(F.col("level") <= F.col("bound"), F.struct(F.col("bound"), F.col("level")))).over(every)["level"]
    target = F.least(F.col("source_size") * F.lit(float(most)), F.coalesce(shared * F.col("w"), F.col("source_size") * F.lit(float(most))))
    return found.select("source", "source_size", target.alias("target"))


# ----------------------------------------------------------------- knapsack
def fill(sizes: list[int], counts: list[int], budget: int, seed: int = 0, reach: int = 1 << 17) -> list[int]:
    """How many items of each size to take so that the sum comes as near to the budget as can be found.

    Sizes are distinct and positive. Never more than counts. The program over the
    last ``reach`` units mostly finds the exact sum; if not, it runs again over
    twice the largest size, which no remainder exceeds that larger items could
    close. The sum is then off by no more than the smallest size that is not used
    up. Memory: five bytes for each unit of up to three times the largest size.
    """
    total = sum(s * c for s, c in zip(sizes, counts, strict=True))
    if budget <= 0 or not total:
        return [0] * len(sizes)
    if budget >= total:
        return list(counts)
    off = lambda t: abs(budget - sum(s * x for s, x in zip(sizes, t, strict=True)))
    best = _closed(sizes, counts, budget, total, seed, reach)
    if off(best) and 2 * max(sizes) > reach:
        best = min(best, _closed(sizes, counts, budget, total, seed, 2 * max(sizes)), key=off)
    return best


def _closed(sizes: list[int], counts: list[int], budget: int, total: int, seed: int, reach: int) -> list[int]:
    taken = [c * budget // total for c in counts]
    left = budget - sum(s * t for s, t in zip(sizes, taken, strict=True))
    order = np.random.default_rng(seed).permutation(len(sizes)).tolist()
    # bring what is left within the reach of the program, the largest first
    for i in sorted(order, key=lambda i: -sizes[i]):
        if left <= reach // 2:
            break
        more = min(counts[i] - taken[i], (left - reach // 4) // sizes[i])
        if more > 0:
            taken[i] += more
            left -= more * sizes[i]
    goal = int(min(left, reach))
    top = goal + min(reach, max(sizes))
    via = np.full(top + 1, -1, np.int32)  # the item that first reached a sum
    reached = np.zeros(top + 1, bool)
    reached[0] = True
    items: list[tuple[int, int]] = []
    for i in order:
        free, part = counts[i] - taken[i], 1
        while free > 0 and not reached[goal]:
            part = min(part, free)
            step = part * sizes[i]
            if step > top:
                break
            new = reached[:-step] & ~reached[step:]
            via[step:][new] = len(items)
            reached[step:] |= new
            items.append((i, part))
            free, part = free - part, part * 2
        if reached[goal]:
            break
    sums = np.flatnonzero(reached)
    at = int(sums[np.abs(sums - goal).argmin()])
    while at:
        i, part = items[via[at]]
        taken[i] += part
        at -= part * sizes[i]
    return taken


def _fill_source(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size", ignore_index=True)
    target, whole = float(pdf["target"].iloc[0]), int(pdf["source_size"].iloc[0])
    rounds = int(target // whole) if whole else 0
    rest = round(target - rounds * whole)
    some = pdf["size"] > 0
    extra = np.zeros(len(pdf), np.int64)
    extra[some.to_numpy()] = fill(pdf.loc[some, "size"].tolist(), pdf.loc[some, "n"].tolist(), rest, seed=whole % (1 << 32))
    return pdf[["source", "size", "n"]].assign(rounds=rounds, extra=extra)


def _draws(doc_id: Column, text: Column, seed: int) -> list[Column]:
    """Two hashes that order the documents of a size; rows that share an id, or have none, go by their texts."""
    return [F.xxhash64(F.lit(seed), doc_id, text).alias("draw"), F.xxhash64(F.lit(-seed), text, doc_id).alias("tie")]


def _ranked(docs: DataFrame, weights: tuple[int, ...], most: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with their rank among those of their source and size, how many are taken of each size, targets of sources)."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    thin = cut(docs.select(doc_id.alias("doc_id"), F.col("source"), words(text).alias("size"), *_draws(doc_id, text, seed)))
    known = thin.groupBy("source", "size").agg(F.count("*").alias("n"))
    goals = targets(known.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most)
    goals = cut(goals.select(F.col("source").alias("of"), "source_size", "target"))
    table = known.join(goals, F.col("source").eqNullSafe(F.col("of"))).select("source", "size", "n", "source_size", "target")
    kind = docs.schema["source"].dataType.simpleString()
    plan = table.groupBy("source").applyInPandas(_fill_source, f"source {kind}, size long, n long, rounds long, extra long")
    plan = cut(plan.select(F.col("source").alias("of"), F.col("size").alias("z"), "n", "rounds", "extra"))

    # slices of the hash, for sizes that many documents share
    unit = F.shiftrightunsigned(F.col("draw").bitwiseXOR(F.lit(-(1 << 63))), 11) / F.lit(float(1 << 53))  # in order of the signed hash
    slices = F.ceil(F.col("n") / SLICE)
    placed = thin.join(plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("z")))
    placed = placed.select(*thin.columns, "n", "rounds", "extra", F.least(F.floor(unit * slices), slices - 1).alias("slice"))
    held = placed.where("n > " + str(SLICE)).groupBy("source", "size", "slice").agg(F.count("*").alias("rows"))
    upto = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(
        F.col("source").alias("of"), F.col("size").alias("z"), F.col("slice").alias("at"), F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("before")
    )
    dealt = placed.repartition(width(docs), "source", "size", "slice")
    ranked = dealt.withColumn("place", F.row_number().over(Window.partitionBy("source", "size", "slice").orderBy("draw", "tie")))
    ranked = ranked.join(held, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("z")) & (F.col("slice") == F.col("at")), "left")
    ranked = ranked.select(*thin.columns, "rounds", "extra", (F.col("place") + F.coalesce("before", F.lit(0))).alias("rank"))
    return ranked, plan, goals


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken), one row per input row.

    ``taken`` is the size times how often the mix takes the document, 0 to
    ``most`` times. Null texts have size 0 and are never taken; a null source is a
    source. Rows are drawn by hashes of doc_id and text; repeated rows are as good
    as each other. Other columns are ignored.
    """
    ranked, _, goals = _ranked(docs, weights, most, seed)
    taken = F.col("size") * (F.col("rounds") + (F.col("rank") <= F.col("extra")).cast("long"))
    ranked = ranked.select("doc_id", "source", "size", taken.alias("taken"))
    return ranked.join(goals, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 17, broadcast_rows: int = 200_000) -> DataFrame:
    """The rows of the mix: each row of ``docs`` as often as ``mix`` takes it, all columns kept.

    Texts don't move: the last document taken of each source and size says which
    others are, by their hashes alone. That table has a row for each size that
    occurs in a source; it is broadcast up to ``broadcast_rows`` rows, and joined by a
    shuffle beyond that. Rows that share both doc_id and text count as one document,
    taken as often as the first of them.
    """
    ranked, plan, _ = _ranked(docs, weights, most, seed)
    last = ranked.where("rank = extra").select(F.col("source").alias("of_last"), F.col("size").alias("z_last"), F.col("draw").alias("last_draw"), F.col("tie").alias("last_tie"))
    shares = plan.join(last, F.col("of").eqNullSafe(F.col("of_last")) & (F.col("z") == F.col("z_last")), "left")
    shares = cut(shares.where("rounds > 0 OR last_draw IS NOT NULL").select("of", "z", "rounds", "last_draw", "last_tie"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = docs.select(row, F.col("source").alias("source"), words(text).alias("size"), *_draws(doc_id, text, seed))
    shares = F.broadcast(shares) if shares.count() <= broadcast_rows else shares
    joined = rows.join(shares, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("z")))
    more = F.coalesce(F.struct("draw", "tie") <= F.struct(F.col("last_draw").alias("draw"), F.col("last_tie").alias("tie")), F.lit(False)) & F.col("last_draw").isNotNull()
    times = (F.col("rounds") + more.cast("long")).cast("int")
    return joined.where((F.col("size") > 0) & (times > 0)).select("row", F.explode(F.sequence(F.lit(1), times)).alias("copy")).select("row.*")
