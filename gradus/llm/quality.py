"""Quality scores from a factorisation machine.

A text's features are its hashed words (weights of unit length), its structure
(shares of character classes, word and line repetition and the like, each binned)
and metadata columns (numbers binned by magnitude, other values hashed). The
model adds to a linear part all pairwise interactions of features through
low-rank vectors v:

    w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

so that a score takes time linear in the number of features. Training runs in
numpy on a bounded sample of labelled rows, with weights that make both labels
count alike. Margins become scores by a calibration on folds that were held out
of training, so that a threshold means the same at every number of labels.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.sampling import per_label
from gradus.llm.weighted import WordHasher

WORDS = 1 << 15
BINS = 12
STATS = 13
METADATA = 1 << 10
SIZE = WORDS + BINS * STATS + METADATA


class Features:
    """Texts and metadata -> feature indices and values."""

    def __init__(self):
        self.words = WordHasher()
        kind = np.zeros(256, np.intp)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 punctuation, 6 beyond ASCII
        for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c"), 1):
            kind[list(chars)] = k
        kind[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = 5
        kind[128:] = 6
        self.kind = kind

    def stats(self, data: bytes, words: int, distinct: int, most: int, doubled: int) -> list[float]:
        """Shares from 0 to 1."""
        raw = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        kinds = np.bincount(self.kind, raw, 7)
        n = max(1, len(data))
        lines = [x for x in data.split(b"\n") if x.strip()]
        letters = max(1.0, kinds[1] + kinds[2] + kinds[6])
        return [
            kinds[2] / letters,
            kinds[3] / n,
            kinds[4] / n,
            kinds[5] / n,
            kinds[6] / n,
            kinds[0] / n,
            float(raw[list(b".,;:?'\"-")].sum()) / max(1.0, kinds[5]),
            distinct / max(1, words),
            most / max(1, words),
            doubled / max(1, words),
            len(set(lines)) / max(1, len(lines)),
            min(1.0, (n - kinds[4]) / max(1, words) / 24),
            min(1.0, np.log2(n) / 24),
        ]

    def __call__(self, text: str, metadata: tuple) -> tuple[np.ndarray, np.ndarray]:
        data = text.encode("utf-8", "surrogatepass")
        hashes = self.words(data.lower())
        buckets, counts = np.unique(hashes % np.uint64(WORDS), return_counts=True)
        values = counts / max(1.0, float(np.sqrt((counts.astype(np.float64) ** 2).sum())))
        doubled = int((hashes[1:] == hashes[:-1]).sum())
        stats = np.array(self.stats(data, len(hashes), len(buckets), int(counts.max(initial=0)), doubled))
        # finer bins near zero, where most shares lie
        bins = np.minimum(BINS - 1, np.sqrt(np.clip(stats, 0, 1)) * BINS).astype(np.int64)
        more = [WORDS + BINS * i + b for i, b in enumerate(bins.tolist())]
        for i, value in enumerate(metadata):
            name = f"{i}:{int(np.log2(abs(value) + 1))}" if isinstance(value, (int, float)) and np.isfinite(value) else f"{i}={value}"
            more.append(WORDS + BINS * STATS + zlib.crc32(name.encode("utf-8", "surrogatepass")) % METADATA)
        index = np.concatenate([buckets.astype(np.int64), np.array(more, np.int64)])
        return index, np.concatenate([values, np.full(len(more), 0.3)]).astype(np.float32)


@dataclass
class Machine:
    """The model: bias, linear weights, and ``rank`` factors of each feature; slope and shift from margins to scores."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def new(cls, rank: int = 8, seed: int = 5) -> Machine:
        draw = np.random.default_rng(seed).normal(0, 0.02, (SIZE, rank))
        return cls(0.0, np.zeros(SIZE, np.float32), draw.astype(np.float32))

    def margin(self, index: np.ndarray, value: np.ndarray) -> float:
        own = self.factors[index] * value[:, None]
        total = own.sum(axis=0)
        return float(self.bias + self.linear[index] @ value + 0.5 * (total @ total - (own * own).sum()))

    def probability(self, index: np.ndarray, value: np.ndarray) -> float:
        """Of label 1, as calibrated."""
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(index, value) + self.shift, -30, 30))))

    def train(self, rows: list[Row], steps: int = 300, batch: int = 64, rate: float = 0.1, seed: int = 5) -> None:
        """A number of adaptive stochastic gradient steps, whatever the number of rows.

        The loss is logistic, with weights that make both labels count alike.
        Only features that occur in ``rows`` are touched, in dense arrays of their own.
        """
        rng, y = np.random.default_rng(seed), np.array([r[0] for r in rows], np.float64)
        weight = _balance(y)
        known, where = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)
        values, sizes = np.concatenate([r[2] for r in rows]).astype(np.float64), np.array([len(r[1]) for r in rows])
        begin, n = np.cumsum(sizes) - sizes, len(known)
        linear, factors = self.linear[known].astype(np.float64), self.factors[known].T.astype(np.float64)
        spent_w, spent_v, spent_b = np.full(n, 1e-2), np.full(factors.shape, 1e-2), 1e-2
        order = np.zeros(0, np.int64)
        for _ in range(steps):
            if len(order) < min(batch, len(rows)):
                order = rng.permutation(len(rows))
            pick, order = order[:batch], order[batch:]
            starts = np.cumsum(sizes[pick]) - sizes[pick]
            of = np.repeat(np.arange(len(pick)), sizes[pick])
            at = np.arange(len(of)) + (begin[pick] - starts)[of]
            index, value = where[at], values[at]
            own = factors.take(index, axis=1) * value
            total = np.add.reduceat(own, starts, axis=1)
            z = self.bias + np.add.reduceat(linear[index] * value, starts)
            z += 0.5 * ((total**2).sum(axis=0) - np.add.reduceat((own**2).sum(axis=0), starts))
            g = weight[pick] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)
            each = g[of] * value
            grad_w = np.bincount(index, each, n)
            grad_v = np.stack([np.bincount(index, d, n) for d in (total.take(of, axis=1) - own) * each])
            spent_w += grad_w**2
            spent_v += grad_v**2
            spent_b += g.sum() ** 2
            linear -= rate * grad_w / np.sqrt(spent_w)
            factors -= rate * grad_v / np.sqrt(spent_v)
            self.bias -= float(rate * g.sum() / np.sqrt(spent_b))
        self.linear[known], self.factors[known] = linear, factors.T

    def calibrate(self, margins: np.ndarray, y: np.ndarray, cut: float) -> None:
        """Slope and shift of the margins, so that ``cut`` is the score where both labels, weighted alike, are as likely.

        A logistic fit by Newton's method. Its targets stay off 0 and 1 by what so
        few rows can tell, so that labels which margins part entirely have a finite slope.
        """
        ones, weight = y.sum(), _balance(y)
        goal = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
        x, at = np.stack([margins, np.ones(len(y))]), np.array([1.0, 0.0])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(at @ x, -30, 30)))
            move = np.linalg.solve((x * (weight * p * (1 - p))) @ x.T + 1e-6 * np.eye(2), x @ (weight * (p - goal)))
            at = at - move * min(1.0, 2 / max(1e-12, np.abs(move).max()))
        self.slope, self.shift = max(1e-3, float(at[0])), float(at[1] + np.log(cut / (1 - cut)))


Row = tuple[int, np.ndarray, np.ndarray]  # label, feature indices and their values


def _balance(y: np.ndarray) -> np.ndarray:
    """Weights of rows with which either label has half of the whole."""
    ones = max(1.0, y.sum())
    return np.where(y == 1, len(y) / (2 * ones), len(y) / (2 * max(1.0, len(y) - ones)))


def learn(rows: list[Row], cut: float = 0.3, folds: int = 3, seed: int = 5) -> Machine:
    """A machine trained on all rows, calibrated by the margins that machines trained without a row's fold give it."""
    rng, y = np.random.default_rng(seed), np.array([r[0] for r in rows])
    fold, margins = np.zeros(len(rows), np.int64), np.zeros(len(rows))
    for label in (0, 1):
        own = rng.permutation(np.flatnonzero(y == label))
        fold[own] = np.arange(len(own)) % folds
    for k in range(folds):
        machine, rest = Machine.new(), np.flatnonzero(fold != k)
        if len(rest):
            machine.train([rows[i] for i in rest])
        for i in np.flatnonzero(fold == k):
            margins[i] = machine.margin(*rows[i][1:])
    machine = Machine.new()
    machine.train(rows)
    machine.calibrate(margins, y.astype(np.float64), cut)
    return machine


def _rows(docs: DataFrame, metadata: list[str], *first: str) -> DataFrame:
    return docs.select(*first, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.struct(F.lit(0).alias("_"), *[F.col(m) for m in metadata]).alias("metadata"))


def _values(metadata: pa.StructArray) -> list[tuple]:
    return [tuple(x.values())[1:] for x in metadata.to_pylist()]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", metadata: list[str] | None = None, each: int = 1500, cut: float = 0.3) -> Machine | None:
    """Learn from ``labels`` (doc_id and a label of 0 or 1) of ``docs``; None unless both labels occur.

    At most 4 * each labels are drawn, from the label table alone; only their
    rows' features reach the driver, one row for each doc_id: of repeated ones the
    row and the label that come first in order. ``cut`` is the score at which
    both labels are to be as likely. Columns of other names are ignored.
    """
    known = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
    some = per_label(known, "label", each).select(F.col("doc_id").alias("labelled_id"), "label")

    def run(batches):
        features = Features()
        for batch in batches:
            found = [features(t.as_py(), m) for t, m in zip(batch.column(2), _values(batch.column(3)), strict=True)]
            index, value = pa.array([x[0] for x in found], pa.list_(pa.int64())), pa.array([x[1] for x in found], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), index, value], ["id", "label", "index", "value"])

    texts = _rows(docs, metadata or [], "doc_id")
    joined = texts.join(F.broadcast(some), F.col("doc_id") == F.col("labelled_id")).select("doc_id", "label", "text", "metadata")
    got = joined.mapInArrow(run, f"id {texts.schema['doc_id'].dataType.simpleString()}, label int, index array<long>, value array<float>")
    got = got.groupBy("id").agg(F.min(F.struct("label", "index", "value")).alias("x")).select("x.*").collect()
    rows = [(r["label"], np.array(r["index"]), np.array(r["value"], np.float32)) for r in got]
    rows.sort(key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))  # the same order in every run
    return learn(rows, cut) if {r[0] for r in rows} == {0, 1} else None


def score(docs: DataFrame, machine: Machine | None, metadata: list[str] | None = None) -> DataFrame:
    """(doc_id, score) of every row from its whole text, a null text as an empty one.

    The score is the probability of label 1, moved so that both labels are as
    likely at the cut that the machine was learned for; 0.5 for all if nothing
    was learned. Null metadata is a value of its own. Repeated
    and null doc_ids stay as they are. Other columns are ignored.
    """

    def run(batches):
        features = Features()
        for batch in batches:
            pairs = zip(batch.column(1), _values(batch.column(2)), strict=True)
            found = [machine.probability(*features(t.as_py(), m)) if machine else 0.5 for t, m in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    return _rows(docs, metadata or [], "doc_id").select(F.col("doc_id").cast("long"), "text", "metadata").mapInArrow(run, "doc_id long, score double")
