"""SimHash near-duplicates by bit-sliced comparison.

A document's fingerprint is the bitwise majority of the XXH64 hashes (seed 42)
of its word shingles. Documents whose fingerprints differ in few bits link, and
linked documents form groups.

Search. Only distinct fingerprints are compared. The 64 bits are cut into
``radius + 2`` blocks; two fingerprints within the radius agree on at least two
blocks, so they meet in one of the tables keyed by a pair of blocks. A bucket
with more than ``bucket_rows`` fingerprints is dealt into groups, of which every two
have a part of their own, so that none compares more than about ``2 * bucket_rows``.
Where those would be more than the tables of a further cut, the bucket is cut
instead, by three of ``radius + 3`` blocks of the bits that it leaves open, and then
by four of ``radius + 4``. Nothing is dropped. Tasks derive the tables from the radius.

Comparison. Inside a task the fingerprints of a block lie as vertical bit
planes, 64 candidates to a machine word. One query's bit flips a plane, and a
carry-save counter adds the plane to the distances of all candidates at once.
Queries whose candidates have all passed the radius leave the block early. A
task emits spanning links of what it found, not all pairs.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.llm.components import connected_components
from gradus.llm.tables import cut

SEED = 42
BITS = 64


def simhash(text: bytes | None, shingle: int = 3, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of one UTF-8 text: no words give zero."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and splits at [\x20\x09-\x0D]
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    digest = xxhash.xxh64_digest
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(starts), 65536):
        part = b"".join(
            [digest(joined[a:b], seed) for a, b in zip(starts[lo : lo + 65536].tolist(), ends[lo : lo + 65536].tolist(), strict=True)]
        )
        bits = np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)  # most significant bit first
    top = (2 * ones > len(starts)).astype(np.uint8)
    return int.from_bytes(np.packbits(top).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, second: bool = False) -> DataFrame:
    """(doc_id, fp, fp2): fp holds the fingerprint's 64 bits as a long, fp2 those of another seed, or 0 unless ``second``."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.fromiter((simhash(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            other = np.fromiter((simhash(t.as_py(), shingle, SEED + 1) if second else 0 for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), pa.array(other.view(np.int64))], ["doc_id", "fp", "fp2"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long, fp2 long")


# ------------------------------------------------------------------ comparison
def planes_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bit planes of shape (64, words), the words' unused lanes set)."""
    n = len(fps)
    words = -(-n // 64)
    bits = np.zeros((words * 64, BITS), np.uint8)
    bits[:n] = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)
    unused = np.ones(words * 64, np.uint8)
    unused[:n] = 0
    return planes, np.packbits(unused, bitorder="little").view(np.uint64)


def within(queries: np.ndarray, block: np.ndarray, radius: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, candidate) of fingerprints at ``radius`` or fewer differing bits.

    Counters start so high that they overflow exactly when a distance passes the radius.
    """
    planes, unused = planes_of(block)
    digits = radius.bit_length()
    bias = (1 << digits) - 1 - radius
    full = ~np.uint64(0)
    live = np.arange(len(queries))
    mask = (np.unpackbits(queries.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.uint64)) * full
    shape = (len(queries), planes.shape[1])
    count = [np.full(shape, full if bias >> d & 1 else 0, np.uint64) for d in range(digits)]
    over = np.broadcast_to(unused, shape).copy()
    for b in range(BITS):
        carry = planes[b][None, :] ^ mask[:, b][:, None]
        for d in range(digits):
            carry, count[d] = count[d] & carry, count[d] ^ carry
        over |= carry
        if b % 8 == 7:  # abandon what is out of reach
            stay = (over != full).any(axis=1)
            if not stay.all():
                live, mask, over = live[stay], mask[stay], over[stay]
                count = [c[stay] for c in count]
                if not len(live):
                    break
    hits = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little") if len(live) else np.zeros((0, 64), np.uint8)
    q, c = np.nonzero(hits)
    return live[q], c


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; parent maps every index to its set's least index."""
    while len(a):
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent[:] = up


def spanning(fps: np.ndarray, radius: int = 3, rows: int = 1024, second: np.ndarray | None = None, confirm: int = 2 * BITS) -> np.ndarray:
    """For each fingerprint the least index that chains of close fingerprints reach within ``fps``.

    With second fingerprints a pair is close only if both distances add up to ``confirm`` at most.
    """
    parent = np.arange(len(fps))
    for j in range(0, len(fps), rows):
        block = fps[j : j + rows]
        for i in range(0, j + 1, rows):
            q, c = within(fps[i : i + rows], block, radius)
            if i == j:
                q, c = q[q < c], c[q < c]
            if second is not None:
                apart = np.bitwise_count(fps[q + i] ^ fps[c + j]) + np.bitwise_count(second[q + i] ^ second[c + j])
                q, c = q[apart <= confirm], c[apart <= confirm]
            unite(parent, q + i, c + j)
    return parent


def _compare(radius: int, confirm: int | None, rows: int = 1024):
    """Arrow batches (mask, k, part, id, fp, fp2) sorted by bucket -> spanning links of the close fingerprints in each bucket, as ids."""

    def flush(held: dict[str, np.ndarray]):
        fps = held["fp"].view(np.uint64)
        parent = spanning(fps, radius, rows, *(() if confirm is None else (held["fp2"].view(np.uint64), confirm)))
        far = parent != np.arange(len(fps))
        if far.any():
            yield pa.RecordBatch.from_arrays([pa.array(held["id"][far]), pa.array(held["id"][parent[far]])], ["a", "b"])

    def run(batches):
        names = ["id", "fp", "fp2"]
        held, new, last = {n: np.zeros(0, np.int64) for n in names}, np.zeros(0, bool), None
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            starts = np.ones(batch.num_rows, bool)
            starts[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in bucket])
            first = tuple(x[0] for x in bucket)
            starts[0] = last is None or last != first
            last = tuple(x[-1] for x in bucket)
            held = {n: np.concatenate([held[n], batch.column(3 + i).to_numpy(zero_copy_only=False)]) for i, n in enumerate(names)}
            new = np.concatenate([new, starts])
            cuts = np.flatnonzero(new)
            begin = 0
            # whole buckets go together, up to `rows`; the last bucket may go on in the next batch
            while True:
                ok = cuts[(cuts > begin) & (cuts <= begin + rows)]
                end = int(ok[-1]) if len(ok) else next((int(c) for c in cuts[cuts > begin]), None)
                if end is None:
                    break
                yield from flush({n: v[begin:end] for n, v in held.items()})
                begin = end
            held, new = {n: v[begin:] for n, v in held.items()}, new[begin:]
        if len(new):
            yield from flush(held)

    return run


def _spans(bits: list[int], n: int) -> list[int]:
    """Cut the given bit positions into n masks of nearly equal size."""
    return [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits), n)]


def tables(radius: int, bits: list[int] | None = None, keep: int = 2) -> list[int]:
    """Masks of which every pair within the radius agrees on at least one: ``keep`` of ``radius + keep`` blocks."""
    blocks = _spans(list(range(BITS)) if bits is None else bits, radius + keep)
    return [sum(c) for c in combinations(blocks, keep)]


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


LEVELS = 3


def _finer(radius: int, level: int):
    """Rows (mask, id, fp, fp2) -> each under all tables over the bits that its mask leaves open: (mask, k, id, fp, fp2)."""

    def run(batches):
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            for mask in np.unique(columns[0]).tolist():
                if mask not in known:
                    fixed = mask % (1 << BITS)
                    more = tables(radius, [b for b in range(BITS) if not fixed >> b & 1], level + 2)
                    known[mask] = np.array([_long(fixed | x) for x in more], np.int64)
                chosen = np.flatnonzero(columns[0] == mask)
                step = max(1, (1 << 18) // len(known[mask]))
                for lo in range(0, len(chosen), step):
                    at = np.repeat(chosen[lo : lo + step], len(known[mask]))
                    masks = np.tile(known[mask], len(at) // len(known[mask]))
                    parts = [masks, columns[2][at] & masks, *(c[at] for c in columns[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts], ["mask", "k", "id", "fp", "fp2"])

    return run


def buckets(fps: DataFrame, radius: int, bucket_rows: int) -> DataFrame:
    """Rows (mask, k, part, id, fp, fp2) of (id, fp, fp2) in buckets in which every pair within the radius meets.

    Of the buckets only sizes are looked at, and none of them reaches the driver.
    """
    out, rows = None, fps.select(F.lit(0).cast("long").alias("mask"), "id", "fp", "fp2")
    columns = ["mask", "k", "id", "fp", "fp2"]
    for level in range(LEVELS):
        rows = rows.mapInArrow(_finer(radius, level), "mask long, k long, id long, fp long, fp2 long")
        sizes = cut(rows.groupBy("mask", "k").agg(F.count("*").alias("n")).where("n > 1"))
        # a row of a crowded bucket is copied once for each of its groups, or under each further table, whichever are fewer
        further = comb(radius + level + 3, level + 3) if level < LEVELS - 1 else 1 << 62
        met = rows.join(sizes.withColumn("groups", F.ceil(F.col("n") / bucket_rows)), ["mask", "k"])
        dealt = _dealt(met.where(F.col("groups") <= further), columns)
        out = dealt if out is None else out.unionByName(dealt)
        if sizes.where(F.ceil(F.col("n") / bucket_rows) > further).isEmpty():
            break
        rows = cut(met.where(F.col("groups") > further).select("mask", "id", "fp", "fp2"))
    return out


def _dealt(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A bucket's rows in ``groups``, each of which meets every other in a part of its own; one group is one part."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("groups")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    part = F.least("own", "other") * F.col("groups") + F.greatest("own", "other")
    return rows.select(*columns, part.alias("part"))


def links(fps: DataFrame, radius: int = 3, bucket_rows: int = 4096, confirm: int | None = None) -> DataFrame:
    """Spanning links (a, b), as ids, among rows (id, fp, fp2) whose ``fp`` differ in ``radius`` bits or fewer.

    Rows (fp) without an id are their own ids. With ``confirm`` a link needs distances
    of ``fp`` and ``fp2`` that add up to so many bits at most.
    """
    if "id" not in fps.columns:
        fps = fps.select(F.col("fp").alias("id"), "fp", F.lit(0).cast("long").alias("fp2"))
    keys = ["mask", "k", "part"]
    pairs = buckets(fps, radius, bucket_rows).select(*keys, "id", "fp", "fp2").repartition(*keys).sortWithinPartitions(*keys)
    return pairs.mapInArrow(_compare(radius, confirm), "a long, b long")


def groups(docs: DataFrame, shingle: int = 3, radius: int = 3, bucket_rows: int = 4096, confirm: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id of the document's group.

    One row per input row. A null text is empty; texts without words have
    fingerprint zero and link like any other. Null doc_ids group by their text's
    fingerprint but never name a group, unless all of its ids are null. Rows with
    a repeated doc_id are judged each by its own text. Other columns are ignored.

    A wide radius finds more copies that were edited, but also texts that have
    nothing in common. With ``confirm`` documents have two fingerprints of
    independent seeds; they link if either is within the radius and both
    distances add up to ``confirm`` at most. Those that agree in both are one class;
    all others are confirmed, those that agree in one of them too.
    """
    prints = cut(fingerprints(docs, shingle, confirm is not None))
    classes = prints.groupBy("fp", "fp2").agg(F.min("doc_id").alias("first"))
    if confirm is None:
        classes = cut(classes.withColumn("id", F.col("fp")))
        found = links(classes.select("id", "fp", "fp2"), radius, bucket_rows)
    else:
        classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))
        found = links(classes.select("id", "fp", "fp2"), radius, bucket_rows, confirm)
        turned = classes.select("id", F.col("fp2").alias("fp"), F.col("fp").alias("fp2"))
        found = found.unionByName(links(turned, radius, bucket_rows, confirm))
    roots = connected_components(found).select(F.col("node").alias("id"), "root")
    joined = classes.join(roots, "id", "left").select("fp", "fp2", "first", F.coalesce("root", "id").alias("root"))
    least = joined.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component_id"))
    named = joined.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("p"), F.col("fp2").alias("p2"), "component_id")
    return prints.join(named, (F.col("fp") == F.col("p")) & (F.col("fp2") == F.col("p2"))).select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def first_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: one of each near-duplicate group, all columns kept.

    The row whose doc_id is the group's smallest stays. Rows that share a doc_id
    count as versions of one document, of which each distinct text stays once.
    Rows with a null doc_id stay only if their whole group has none.
    """
    kept = groups(docs, **options).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = cut(kept.groupBy(F.col("doc_id").alias("kept_id")).agg(F.count("*").alias("kept_n")))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    stay = rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")))
    once = stay.where("kept_n = 1").select("row.*")
    more = stay.where("kept_n > 1").withColumn("text", F.col("row.text")).dropDuplicates(["id", "text"]).select("row.*")
    return once.unionByName(more)
