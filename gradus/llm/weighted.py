"""Document fingerprints by consistent weighted sampling.

A text's terms are its word shingles, weighted by how often they occur. For each
of ``samples`` independent rounds every term k of weight S gets a value from two
gamma(2, 1) variables r and c and a uniform one b that depend on the term only:

    t = floor(ln S / r + b),  ln a = ln c - r * (t - b + 1)

The round's sample is the pair (k, t) of the term with the smallest a. Two texts
draw the same sample with a probability equal to their generalised Jaccard
similarity, the sum of the smaller weights over the sum of the larger ones. The
draws come from tables of 1,024 rows, one row for r and b and one for c, which a
term's hash picks, so that some terms share some of their draws; likeness stays
within the sampling error of 128 samples (tests compare 200 to 20,000 terms). A
fingerprint keeps 16 bits of each sample, as four hex digits; likeness is the
share of equal samples.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.llm.tables import width

ROWS = 1024  # rows of the tables of draws, small enough for a cache; r and b come from one row of a term, c from another
EMPTY = 0xFFFF


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHasher:
    """64-bit hashes of a text's words: polynomials over random byte values, from one running sum."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, seed: int = 7):
        self.values = np.random.default_rng(seed).integers(1, 1 << 63, 256, np.uint64)
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            steps = np.array([self.BASE, pow(self.BASE, -1, 1 << 64)], np.uint64)
            powers = np.repeat(steps[:, None], size, axis=1)
            powers[:, 0] = 1
            self.up, self.down = powers.cumprod(axis=1, dtype=np.uint64)
        return self.up, self.down

    def __call__(self, text: bytes) -> np.ndarray:
        data = np.frombuffer(text, np.uint8)
        if not len(data):
            return np.zeros(0, np.uint64)
        space = np.ones(len(data) + 2, bool)
        space[1:-1] = self.space[data]
        edges = np.flatnonzero(space[1:] != space[:-1])
        starts, ends = edges[0::2], edges[1::2]
        up, down = self.powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * up[: len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts])


class Sampler:
    """Fingerprints of texts; the same seed gives the same draws everywhere."""

    def __init__(self, samples: int = 128, shingle: int = 5, seed: int = 1):
        self.words, self.samples, self.shingle = WordHasher(), samples, shingle
        rng = np.random.default_rng(seed)
        size = (ROWS, samples)
        self.r = rng.gamma(2.0, 1.0, size).astype(np.float32)
        self.b = rng.random(size, np.float32)
        self.c = np.log(rng.gamma(2.0, 1.0, size)).astype(np.float32)
        self.once = (self.r * (1 - self.b)).astype(np.float32)  # the subtrahend for weight 1, where t = 0

    def terms(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingle hashes and how often each occurs; a text of fewer words is one shingle."""
        words = self.words(text.encode("utf-8", "surrogatepass").lower())
        if not len(words):
            return words, np.zeros(0, np.int64)
        k = min(self.shingle, len(words))
        n = len(words) - k + 1
        joined = np.full(n, k, np.uint64)
        for i in range(k):
            joined = joined * np.uint64(WordHasher.BASE) + words[i : i + n]
        return np.unique(mix(joined), return_counts=True)

    def fingerprint(self, text: str) -> np.ndarray:
        """``samples`` 16-bit values."""
        terms, counts = self.terms(text)
        if not len(terms):
            return np.full(self.samples, EMPTY, np.uint16)
        best = np.full(self.samples, np.inf, np.float32)
        term, step = np.zeros(self.samples, np.uint64), np.zeros(self.samples, np.int64)
        every = np.arange(self.samples)
        for lo in range(0, len(terms), 1024):
            some, weight = terms[lo : lo + 1024], counts[lo : lo + 1024]
            i, j = (some % ROWS).astype(np.intp), (some // ROWS % ROWS).astype(np.intp)
            value = self.c.take(j, axis=0)
            value -= self.once.take(i, axis=0)
            more = np.flatnonzero(weight > 1)
            if len(more):
                r, b = self.r.take(i[more], axis=0), self.b.take(i[more], axis=0)
                t = np.floor(np.log(weight[more]).astype(np.float32)[:, None] / r + b)
                value[more] = self.c.take(j[more], axis=0) - r * (t - b + 1)
            at = value.argmin(axis=0)
            least = value[at, every]
            won = np.flatnonzero(least < best)
            best[won], term[won] = least[won], some[at[won]]
            rows = i[at[won]]
            step[won] = np.floor(np.log(weight[at[won]]).astype(np.float32) / self.r[rows, won] + self.b[rows, won])
        return (mix(term + step.astype(np.uint64) * np.uint64(WordHasher.BASE)) >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def to_text(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, samples: int = 128, shingle: int = 5) -> DataFrame:
    """(doc_id, fingerprint) of every row; a null text is an empty one, equal texts have equal fingerprints."""

    def run(batches):
        sampler = Sampler(samples, shingle)
        for batch in batches:
            found = [to_text(sampler.fingerprint(x.as_py() or "")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


# ------------------------------------------------------- a document and the next one
LOWEST = -(1 << 63)


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the key, by a coarse and a fine search."""
    if not bounds:
        return F.lit(0)
    size = max(1, isqrt(len(bounds)))
    parts = [bounds[i : i + size] for i in range(0, len(bounds), size)]
    fine = F.array(*[F.array(*[F.lit(x) for x in part]) for part in parts])
    coarse = F.array(*[F.lit(part[0]) for part in parts])
    passed = F.size(F.filter(coarse, lambda x: x <= key))
    within = F.size(F.filter(F.element_at(fine, F.greatest(passed, F.lit(1))), lambda x: x <= key))
    return F.when(passed == 0, 0).otherwise((passed - 1) * size + within)


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, copy, key, tie, doc_id, text), each task holding whole buckets in order.

    Buckets are ranges of doc_id. Each ends with a copy (copy = 1) of the row that
    follows its last one, so that every row finds the next one in its own task;
    the first row of all follows the last. The text moves once. Null ids come
    first; equal ids go by a hash of their texts. An id that more rows have than a
    task should hold, or a null that they have for it, is cut by ranges of that hash.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("key")
    rows = docs.select(key, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n, spark = width(docs), docs.sparkSession
    cuts = docs.select(key.cast("double").alias("x")).approxQuantile("x", [i / n for i in range(1, n)], 0.25 / n)
    bounds = sorted({max(LOWEST, int(x)) for x in cuts})
    # ids of many rows are bounds; a row for each of them at most reaches the driver
    counts = docs.select(key).where(F.col("key").isin(bounds)).groupBy("key").count().collect()
    total = docs.count()
    parts = {r["key"]: min(n, -(-r["count"] * n // total)) for r in counts if r["count"] * n > 2 * total}
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("bucket", (_bucket(F.col("key"), bounds) * n).cast("long"))
    if parts:
        share = F.create_map(*[F.lit(x) for kv in sorted(parts.items()) for x in kv])[F.col("key")]
        step = F.shiftrightunsigned(F.col("tie").bitwiseXOR(F.lit(LOWEST)), 40) * share / float(1 << 24)
        rows = rows.withColumn("bucket", F.col("bucket") + F.when(share.isNotNull(), F.floor(step)).otherwise(n - 1))
    # one row per bucket: as many as there are partitions, and twice that with cut ids
    firsts = sorted(rows.groupBy("bucket").agg(F.min(F.struct("key", "tie")).alias("x")).select("bucket", "x.key", "x.tie").collect())
    plan = [(b, k, t, i, (i or len(firsts)) - 1) for i, (b, k, t) in enumerate(firsts)]
    heads = spark.createDataFrame(plan, "bucket long, first_key long, first_tie long, at int, before int")
    own = F.struct(F.col("at").alias("bucket"), F.lit(0).alias("copy"))
    ahead = F.struct(F.col("before").alias("bucket"), F.lit(1).alias("copy"))
    first = (F.col("key") == F.col("first_key")) & (F.col("tie") == F.col("first_tie"))
    dealt = rows.join(F.broadcast(heads), "bucket").select(
        F.explode(F.when(first, F.array(own, ahead)).otherwise(F.array(own))).alias("to"), "key", "tie", "doc_id", "text"
    )
    dealt = dealt.select("to.bucket", "to.copy", "key", "tie", "doc_id", "text")
    return dealt.repartitionById(max(n, len(firsts)), F.col("bucket")).sortWithinPartitions("bucket", "copy", "key", "tie")


def edit(text: str, following: str) -> str:
    """The last half of a text replaced by as much of the start of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_edited(docs: DataFrame, samples: int = 128, shingle: int = 5) -> DataFrame:
    """Each row's fingerprint, that of its edited text, and likeness to that and to the next row's.

    Columns: doc_id, n_chars (code points), edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. One row per input row. Texts
    without words have one fingerprint in common, and a likeness of 1 to each
    other. A single row is its own next. Other columns are ignored.
    """

    def run(batches):
        sampler = Sampler(samples, shingle)
        waiting = None
        for batch in batches:
            out = []
            buckets, copies, ids = (batch.column(i).to_pylist() for i in (0, 1, 4))
            for bucket, copy, doc_id, text in zip(buckets, copies, ids, batch.column(5), strict=True):
                if copy and (waiting is None or waiting[0] != bucket):
                    continue  # further copies of a first row that occurs more than once
                text = text.as_py()
                found = waiting[3] if waiting is not None and waiting[2] == text else sampler.fingerprint(text)
                if waiting is not None:
                    _, before, old, old_found = waiting
                    changed = edit(old, text)
                    new_found = sampler.fingerprint(changed)
                    out.append(
                        (
                            before,
                            len(old),
                            hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                            to_text(old_found),
                            to_text(new_found),
                            likeness(old_found, new_found),
                            likeness(old_found, found),
                        )
                    )
                waiting = None if copy else (bucket, doc_id, text, found)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names)

    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return with_next(docs).mapInArrow(run, schema)
