"""Collapse of cumulative conversation snapshots, and chat rendering.

Chat logs often hold a conversation once per turn, each time as far as it had
come. Such a snapshot is a prefix of a longer conversation. Every turn hashes to
128 bits together with its position; the running XOR over a conversation's turns
identifies each of its prefixes. An anti-join of whole conversations with the
distinct proper prefixes of all leaves the maximal ones. Prefixes are computed
once and written to the shared checkpoint folder.

Built from DataFrame functions only. Texts are hashed where they are read; only
thin rows move until the kept conversations are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradus.llm.tables import cut


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, n, h1, h2): the hash of each conversation's first pos turns, n of which it has."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    absent = F.struct(F.col("text").isNull(), F.col("role").isNull())
    thin = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.xxhash64(role, text, absent).alias("x"),
        F.xxhash64(F.lit("chat"), text, role, absent).alias("y"),
    )
    # all windows go by one order, so that one shuffle and one sort serve them
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "x", "y")
    every = Window.partitionBy("conv_id")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = thin.select("*", F.row_number().over(order).alias("pos"), F.count("*").over(every).alias("n"))
    return placed.select(
        "conv_id",
        "pos",
        "n",
        F.bit_xor(F.xxhash64("pos", "x")).over(run).alias("h1"),
        F.bit_xor(F.xxhash64("pos", "y")).over(run).alias("h2"),
    )


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that no other one continues.

    Turns go by turn number, repeated numbers by content, null numbers first. Of
    equal conversations the smallest conv_id stays, with their number. A null role
    or text differs from an empty one. Rows without conv_id belong to no
    conversation and are left out. Other columns are ignored.
    """
    known = cut(prefixes(turns))  # thin rows, read twice from here
    whole = (
        known.where("pos = n").groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    )
    inner = known.where("pos < n").select(F.col("pos").alias("p"), F.col("h1").alias("g1"), F.col("h2").alias("g2")).distinct()
    continued = (F.col("pos") == F.col("p")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))
    return whole.join(inner, continued, "left_anti").select("conv_id", F.col("pos").cast("long").alias("n_turns"), "n_copies")


def render(turns: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """(conv_id, n_turns, n_copies, text): each maximal conversation as one training text.

    A turn becomes ``start + role + newline + text + end + newline``; null roles
    and texts render as empty.
    """
    kept = maximal(turns)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.xxhash64(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")), F.struct(F.col("text").isNull(), F.col("role").isNull())).alias("x"),
    )
    line = F.concat(F.lit(start), F.col("role"), F.lit("\n"), F.col("text"), F.lit(f"{end}\n"))
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(1 << 63))).alias("turn"), "x", line.alias("line"))))
    texts = rows.join(kept, "conv_id").groupBy("conv_id", "n_turns", "n_copies").agg(ordered.alias("lines"))
    return texts.select(
        "conv_id", "n_turns", "n_copies", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("text")
    )


ORACLE_SQL = """
WITH c AS (
  SELECT conv_id, count(*) AS n,
         list({'r': role, 't': text} ORDER BY turn, role, text) AS turns,
         string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS text
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), u AS (
  SELECT turns, any_value(n) AS n, min(conv_id) AS conv_id, count(*) AS n_copies, min(text) AS text FROM c GROUP BY turns
), p AS (
  SELECT DISTINCT list_slice(turns, 1, k) AS turns FROM (SELECT turns, n, unnest(range(1, n)) AS k FROM u)
)
SELECT conv_id, n AS n_turns, n_copies, text FROM u WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.turns = u.turns)
"""
