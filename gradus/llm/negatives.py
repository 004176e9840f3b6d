"""Hard negatives of anchors, mined with an STR-packed R-tree.

Rows score by the integer inner product of their scaled vectors. An anchor's
positives are its best rows of the same label; each positive opens a window of
scores, and the best rows of other labels within it are its hard negatives.

Packing. Rows of one label and length are sorted into slabs by their first
coordinate, and each slab into tiles by the second (sort-tile-recursive), by
quantiles that Spark aggregates. A tile's task goes on with the coordinates of
largest spread until leaves of ``leaf`` rows are left, and packs runs of
neighbouring nodes into the levels above. Every node has the bounding box of its
rows.

Search. Between an anchor and a box every coordinate's product has an interval; their
sums bound the scores of all rows in it. A queue gives the node of the highest bound
first. Boxes that lie outside the window of scores are pruned, and the search ends
when the best bound is strictly below the k-th score found, so that ties are seen.

Scale. The anchors are a stated query set, which goes against all rows in blocks
of ``block``: one block travels to all tiles at a time, so that what a task holds is
a tile and a block. Of rows alike in label and vector only the first k + 1 ids can
be among any anchor's best, so that copies of a very common vector are cut to those
before they move; tiles over their size, where coordinates repeat, are cut by hash.
Every tile returns its k best for each list, and the lists are merged by rank.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.llm.tables import cut

EXACT = 1 << 53
LONG = (1 << 63) - 1
GRAIN = 128  # quantiles of a coordinate


# ------------------------------------------------------------------ in a task
def str_order(vectors: np.ndarray, leaf: int, coordinates: np.ndarray) -> np.ndarray:
    """Rows in sort-tile-recursive order: slabs by the first coordinate, each packed by the others."""
    tiles = -(-len(vectors) // leaf)
    if tiles <= 1 or not len(coordinates):
        return np.arange(len(vectors))
    order = np.argsort(vectors[:, coordinates[0]], kind="stable")
    slabs = int(np.ceil(round(tiles ** (1 / len(coordinates)), 9)))
    size = leaf * -(-tiles // slabs)
    parts = [order[i : i + size] for i in range(0, len(order), size)]
    return np.concatenate([p[str_order(vectors[p], leaf, coordinates[1:])] for p in parts])


class Tree:
    """An R-tree over the rows of one tile; nodes of every level lie side by side, leaves first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = 64, fanout: int = 8, depth: int = 3):
        spread = np.argsort([-float(c.max() - c.min()) for c in vectors.T], kind="stable")[:depth] if vectors.shape[1] else np.zeros(0, int)
        order = str_order(vectors, leaf, spread)
        self.ids, self.rows, self.leaf = ids[order], vectors[order], leaf
        n = -(-len(ids) // leaf)
        low = [np.minimum.reduceat(self.rows, np.arange(n) * leaf, axis=0)]
        high = [np.maximum.reduceat(self.rows, np.arange(n) * leaf, axis=0)]
        self.children: list[range] = [range(0)] * n
        first = 0
        while n > 1:
            at = np.arange(0, n, fanout)
            low.append(np.minimum.reduceat(low[-1], at, axis=0))
            high.append(np.maximum.reduceat(high[-1], at, axis=0))
            self.children += [range(first + i, first + min(i + fanout, n)) for i in at.tolist()]
            first, n = first + n, len(at)
        self.low, self.high, self.leaves = np.concatenate(low), np.concatenate(high), len(low[0])

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) possible score of each anchor with each node's rows."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T


class Search:
    """One anchor's searches in a tree; leaves are scored once for all of them."""

    def __init__(self, tree: Tree, vector: np.ndarray, least: np.ndarray, most: np.ndarray):
        self.tree, self.vector, self.least, self.most, self.scored = tree, vector, least, most, {}

    def scores(self, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        if leaf not in self.scored:
            part = slice(leaf * self.tree.leaf, (leaf + 1) * self.tree.leaf)
            self.scored[leaf] = self.tree.rows[part] @ self.vector, self.tree.ids[part]
        return self.scored[leaf]

    def best(self, k: int, but: int, low: float | int | None = None, high: float | int | None = None) -> list[tuple[int, int]]:
        """(score, id) of the k best rows within [low, high] other than ``but``: highest first, ties by smaller id."""
        found: list[tuple] = []  # (-score, id), best first
        queue = [(-self.most[-1], len(self.tree.children) - 1)]
        while queue:
            bound, node = heappop(queue)
            if (low is not None and -bound < low) or (len(found) == k and bound > found[-1][0]):
                break
            if high is not None and self.least[node] > high:
                continue
            if node >= self.tree.leaves:
                for child in self.tree.children[node]:
                    heappush(queue, (-self.most[child], child))
                continue
            scores, ids = self.scores(node)
            take = ids != but
            if low is not None:
                take &= (scores >= low) & (scores <= high)
            if len(found) == k:
                take &= scores >= -found[-1][0]
            if take.any():
                found = sorted(found + list(zip((-scores[take]).tolist(), ids[take].tolist(), strict=True)))[:k]
        return [(max(-LONG, min(LONG, int(-s))), i) for s, i in found]


def exact(vectors: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as they are if doubles give exact sums of products, else as Python's whole numbers."""
    size = vectors.shape[1] * float(np.abs(vectors).max(initial=0)) * float(np.abs(anchors).max(initial=0))
    if size < EXACT:
        return vectors, anchors
    return tuple(np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (vectors, anchors))


def _tiles(batches):
    """Rows (tile, label, size, vec_id, vector) sorted by tile -> (label, size, ids, vectors) of each tile."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        tile = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(tile)) + 1).tolist(), len(tile)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if tile[lo] != last and held:
                yield _tile(held)
                held = []
            last = tile[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield _tile(held)


def _tile(parts: list[pa.RecordBatch]) -> tuple[int, int, np.ndarray, np.ndarray]:
    label, size = (parts[0].column(i)[0].as_py() for i in (1, 2))
    ids = np.concatenate([p.column(3).to_numpy() for p in parts])
    vectors = np.concatenate([p.column(4).flatten().to_numpy(zero_copy_only=False) for p in parts])
    return label, size, ids, vectors.reshape(len(ids), size)


def _found(rows: list[tuple]) -> pa.RecordBatch:
    names = ["anchor_id", "positive_id", "positive_score", "vec_id", "score"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names)


def _search(anchors: list[tuple], k: int, leaf: int):
    """Tiles -> each tile's best rows of the anchors' lists.

    Anchors are (vec_id, label, vector, positives): positives None asks for rows of
    the anchor's label, and (id, score) pairs for rows of others in their windows.
    """

    def run(batches):
        sizes = {}
        for a in anchors:
            sizes.setdefault(len(a[2]), []).append(a)
        for label, size, ids, vectors in _tiles(batches):
            mine = [a for a in sizes.get(size, []) if (a[1] == label) == (a[3] is None)]
            if not mine:
                continue
            matrix = np.array([a[2] for a in mine], np.float64).reshape(len(mine), size)
            vectors, matrix = exact(vectors, matrix)
            tree = Tree(ids, vectors, leaf)
            least, most = tree.bounds(matrix)
            out = []
            for n, (anchor, _, _, positives) in enumerate(mine):
                search = Search(tree, matrix[n], least[n].tolist(), most[n].tolist())
                if positives is None:
                    out += [(anchor, None, None, i, s) for s, i in search.best(k, anchor)]
                for positive, score in positives or []:
                    low = -(-80 * score // 100)
                    if low <= score:
                        out += [(anchor, positive, score, i, s) for s, i in search.best(k, anchor, low, score)]
                if len(out) >= 1 << 14:
                    yield _found(out)
                    out = []
            if out:
                yield _found(out)

    return run


# ------------------------------------------------------------------ in Spark
def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, size, vector) of the rows that take part, scaled; of rows with one vec_id the one of the least label and vector."""
    value = F.col("embedding").cast("array<double>")
    # sizes of vectors with null elements differ from those without them
    whole = F.size(F.filter(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))) == F.size(value)
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole)
    scaled = F.transform(value, lambda x: _floor(F.lit(256.0) * x))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), F.size(value).alias("size"), scaled.alias("vector"))
    if rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        return rows
    least = rows.groupBy("vec_id").agg(F.min(F.struct("label", "size", "vector")).alias("row"))
    return least.select("vec_id", "row.label", "row.size", "row.vector")


def _floor(x: Column) -> Column:
    """Of a double as a double; those beyond 2^52 are whole already, and beyond what a long holds."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x) + F.lit(0.0)


def _quantiles(rows: DataFrame, by: list[str], coordinate: str) -> DataFrame:
    grid = F.array(*[F.lit(i / GRAIN) for i in range(1, GRAIN)])
    return rows.groupBy(*by).agg(F.percentile_approx(coordinate, grid, F.lit(4 * GRAIN)).alias("cuts"), F.count("*").alias("n"))


def packed(rows: DataFrame, k: int, tile_rows: int) -> DataFrame:
    """Rows (tile, label, size, vec_id, vector) in tiles of about ``tile_rows`` at most, each tile in one partition."""
    first = Window.partitionBy("label", "size", "vector").orderBy("vec_id")
    rows = rows.withColumn("copy", F.row_number().over(first)).where(F.col("copy") <= k + 1)
    x, y = (F.coalesce(F.get("vector", F.lit(i)), F.lit(0.0)).alias(n) for i, n in ((0, "x"), (1, "y")))
    rows = cut(rows.select("label", "size", "vec_id", "vector", x, y))
    passed = lambda c: F.size(F.filter("cuts", lambda q: q < F.col(c)))

    slabs = _quantiles(rows, ["label", "size"], "x").withColumn("slabs", F.ceil(F.sqrt(F.ceil(F.col("n") / tile_rows))))
    rows = rows.join(slabs, ["label", "size"]).withColumn("slab", F.floor(passed("x") * F.col("slabs") / GRAIN)).drop("cuts", "n")
    tiles = _quantiles(rows, ["label", "size", "slab"], "y").withColumn("tiles", F.ceil(F.col("n") / tile_rows))
    rows = rows.join(tiles.drop("n"), ["label", "size", "slab"])
    rows = rows.withColumn("part", F.floor(passed("y") * F.col("tiles") / GRAIN)).select("label", "size", "slab", "part", "vec_id", "vector")
    cell = ["label", "size", "slab", "part"]
    full = rows.groupBy(*cell).agg(F.ceil(F.count("*") / (2 * tile_rows)).alias("pieces"))
    rows = rows.join(full, cell).withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.col("pieces")))
    tile = F.xxhash64(*cell, "piece").alias("tile")
    return cut(rows.select(tile, "label", "size", "vec_id", "vector").repartition("tile").sortWithinPartitions("tile"))


def _merged(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int = 100, k: int = 5, tile_rows: int = 8192, leaf: int = 64, block: int = 1 << 15) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors, ids divisible by ``every``.

    Components are scaled by 256 and floored, and vec_ids divisible by 7 move to
    the next label, modulo 10. Rows whose vec_id, label or vector is null, or with a
    component that is null or not finite, take no part. Of rows with one vec_id one
    takes part, of the least label and vector. Vectors only meet those of the same
    length. An anchor without positives, or a positive without rows in its window,
    has no rows in the result. Scores are exact; beyond 63 bits they stop at the
    largest. Other columns are ignored. Anchors and their positives pass the
    driver in blocks of ``block``.
    """
    rows = cut(prepared(vectors))
    tiles = packed(rows, k, tile_rows)
    anchors = rows.where(F.col("vec_id") % every == 0)
    rounds = max(1, -(-anchors.count() // block))
    schema = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"
    out = []
    for n in range(rounds):
        some = [(r.vec_id, r.label, r.vector, None) for r in anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == n).collect()]
        positives = {}
        for r in _merged(tiles.mapInArrow(_search(some, k, leaf), schema), ["anchor_id"], k).collect():
            positives.setdefault(r.anchor_id, []).append((r.vec_id, r.score))
        wanted = [(i, label, vector, positives[i]) for i, label, vector, _ in some if i in positives]
        found = _merged(tiles.mapInArrow(_search(wanted, k, leaf), schema), ["anchor_id", "positive_id"], k)
        out.append(found if rounds == 1 else cut(found))
    result = out[0]
    for other in out[1:]:
        result = result.unionByName(other)
    names = [F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")]
    return result.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), *names)


#: Every anchor against every row, ranked twice.
ORACLE_SQL = """
WITH taking AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM taking a JOIN taking b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), negatives AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score
  FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * score AND score <= positive_score
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id))::INTEGER AS rank,
       negative_id, positive_score, negative_score
FROM negatives
QUALIFY rank <= 5
"""
