"""Connected components by alternating large-star and small-star steps.

Every step is a minimum per node (combined before the shuffle) and a join of
the edges with those minima, whose keys are unique: a node with very many edges
makes one side of a join skewed, which adaptive execution splits, and never
gathers its neighbours in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.tables import cut


def _star(edges: DataFrame) -> DataFrame:
    """Larger node first, each edge once, no loops."""
    return (
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _large(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest one it knows."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    return _star(edges.join(least, F.col("b") == F.col("u")).select("a", F.col("m").alias("b")))


def _small(edges: DataFrame) -> DataFrame:
    """Each node hands itself and its smaller neighbours to the smallest one."""
    least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    moved = edges.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _star(moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a and b, long); root is the smallest node reachable.

    Rounds grow with the logarithm of the number of nodes. Loops, repeated edges
    and edges with a null end are allowed; the last kind links nothing. An empty
    input gives an empty result.
    """
    edges = cut(_star(edges.select("a", "b").dropna()))
    seen = None
    for _ in range(max_rounds):
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state[0] == 0 or state == seen:
            break
        seen = state
        edges = cut(_small(_large(edges)))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # settled: every edge leads from a node to its root
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )
