"""Language identification with a byte convolutional network.

Texts are cut into windows of 256 bytes, each beginning three bytes before the
end of the one before, so that every byte sequence of up to four lies in a
window. Filters of widths 2, 3 and 4 run over byte embeddings; the largest
response of each filter in a window feeds a softmax over languages. A text's
prediction is the mean of its windows' log-probabilities, weighted by their
bytes.

As a filter sees a byte only through its embedding, its response is a sum of
one looked-up number per byte of its width. Both passes use that: the forward
pass adds rows of tables with 256 entries, and the backward pass gathers each
filter's gradient at the one place where its maximum was.

Training runs in numpy on a bounded sample: ``each`` documents of every
language, of which a passage of ``passage`` characters is used. Every window of
every text is then scored in batches on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.sampling import per_label

WINDOW, WIDTHS = 256, (2, 3, 4)
REACH = max(WIDTHS) - 1
UNKNOWN = "und"


def windows(text: bytes) -> np.ndarray:
    """(n, 256) byte windows that cover the text, the last one padded with zeros."""
    step = WINDOW - REACH
    n = max(1, -(-(len(text) - REACH) // step))
    padded = np.zeros((n - 1) * step + WINDOW, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::step]


@dataclass
class ByteNet:
    """Parameters, and the passes through them."""

    languages: list[str]
    filters: int = 12
    size: int = 8
    seed: int = 3
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        if self.p:
            return
        rng, units = np.random.default_rng(self.seed), self.filters * len(WIDTHS)
        self.p = {"bytes": rng.normal(0, 0.5, (256, self.size)), "bias": np.zeros(units)}
        for k in range(max(WIDTHS)):
            self.p[f"at{k}"] = rng.normal(0, 0.3, (self.size, self.units(k)))
        self.p |= {"out": rng.normal(0, 0.1, (units, len(self.languages))), "prior": np.zeros(len(self.languages))}
        self.p = {n: x.astype(np.float32) for n, x in self.p.items()}

    def units(self, k: int) -> int:
        """Filters wide enough to see the byte at offset k: they come first, widest first."""
        return self.filters * sum(w > k for w in WIDTHS)

    def tables(self) -> list[np.ndarray]:
        return [self.p["bytes"] @ self.p[f"at{k}"] for k in range(max(WIDTHS))]

    def responses(self, x: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """(n, positions, units) of windows x."""
        n, room = x.shape[0], x.shape[1] - REACH
        z = tables[0].take(x[:, :room].ravel(), axis=0)
        for k in range(1, max(WIDTHS)):
            z[:, : self.units(k)] += tables[k].take(x[:, k : k + room].ravel(), axis=0)
        return z.reshape(n, room, -1)

    def log_probabilities(self, x: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        hidden = np.maximum(self.responses(x, tables).max(axis=1) + self.p["bias"], 0)
        z = hidden @ self.p["out"] + self.p["prior"]
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def judge(self, text: bytes, tables: list[np.ndarray], at_once: int = 64) -> tuple[str, float]:
        """The likeliest language of a whole text, and its probability."""
        x, total = windows(text), np.zeros(len(self.languages))
        for lo in range(0, len(x), at_once):
            logp = self.log_probabilities(x[lo : lo + at_once], tables).astype(np.float64)
            total += np.minimum(WINDOW, len(text) - (WINDOW - REACH) * np.arange(lo, lo + len(logp))) @ logp
        total /= len(text) + REACH * (len(x) - 1)
        e = np.exp(total - total.max())
        return self.languages[int(e.argmax())], float(e.max() / e.sum())

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        z = self.responses(x, self.tables())
        where = z.argmax(axis=1)
        best = np.take_along_axis(z, where[:, None, :], 1)[:, 0] + p["bias"]
        hidden = np.maximum(best, 0)
        logits = hidden @ p["out"] + p["prior"]
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        d = e / e.sum(axis=1, keepdims=True)
        d[np.arange(n), y] -= 1
        d /= n
        g = {"out": hidden.T @ d, "prior": d.sum(axis=0)}
        dh = (d @ p["out"].T) * (best > 0)
        g |= {"bias": dh.sum(axis=0), "bytes": np.zeros_like(p["bytes"])}
        for k in range(max(WIDTHS)):
            u = self.units(k)
            seen = np.take_along_axis(x, where[:, :u] + k, 1)
            table = np.zeros((256, u), np.float32)
            np.add.at(table, (seen, np.broadcast_to(np.arange(u), seen.shape)), dh[:, :u])
            g[f"at{k}"] = p["bytes"].T @ table
            g["bytes"] += table @ p[f"at{k}"].T
        return g

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 640, batch: int = 64, rate: float = 0.01) -> None:
        """A number of steps of Adam, whatever the number of windows."""
        rng = np.random.default_rng(self.seed)
        first, second = ({n: np.zeros_like(v) for n, v in self.p.items()} for _ in range(2))
        order = np.zeros(0, np.int64)
        for step in range(1, steps + 1):
            if len(order) < min(batch, len(x)):
                order = rng.permutation(len(x))
            pick, order = order[:batch], order[batch:]
            now = rate * (1 - step / (steps + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for n, v in self.gradients(x[pick], y[pick]).items():
                first[n] = 0.9 * first[n] + 0.1 * v
                second[n] = 0.999 * second[n] + 0.001 * v * v
                self.p[n] -= (now * first[n] / (np.sqrt(second[n]) + 1e-8)).astype(np.float32)


def fit(labelled: DataFrame, each: int = 600, passage: int = 1024, steps: int = 640, seed: int = 3) -> ByteNet | None:
    """Learn from rows with doc_id, text and lang; None if no row has all three.

    At most 2 * each * languages passages reach the driver.
    """
    start = F.lit(1) + F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.greatest(F.char_length("text") - passage + 1, F.lit(1))).cast("int")
    passages = labelled.where(F.col("text").isNotNull()).select("doc_id", "lang", F.substring(F.col("text"), start, F.lit(passage)).alias("text"))
    rows = per_label(passages, "lang", each).collect()
    languages = sorted({r.lang for r in rows})
    rng = np.random.default_rng(seed)
    x, y = [], []
    for r in rows:
        for w in windows(r.text.encode("utf-8", "surrogatepass")):
            w = w.copy()
            if rng.random() < 0.35:  # short texts must be known too
                w[int(np.exp(rng.uniform(np.log(6), np.log(WINDOW)))) :] = 0
            x.append(w)
            y.append(languages.index(r.lang))
    if not languages:
        return None
    net = ByteNet(languages, seed=seed)
    net.train(np.array(x), np.array(y), steps)
    return net


LETTERS = r"\p{L}"


def predict(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from all windows of its whole text.

    ``und`` with score 0 where the text is null or has no letter, or if nothing
    was learned; else the likeliest language and its probability. Repeated and
    null doc_ids stay as they are. Other columns are ignored.
    """

    def run(batches):
        tables = net.tables() if net else []
        for batch in batches:
            texts = zip(batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True)
            found = [net.judge(t.as_py(), tables) if letters and net else (UNKNOWN, 0.0) for t, letters in texts]
            names, scores = pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), names, scores], ["doc_id", "lang_pred", "score"])

    letters = F.coalesce(F.col("text").rlike(LETTERS), F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), letters.alias("letters")).mapInArrow(
        run, "doc_id long, lang_pred string, score double"
    )


def accepted(docs: DataFrame, net: ByteNet | None, least: float = 0.4) -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of at least ``least``; all columns kept.

    Rows whose text is null or has no letter go, and all rows if nothing was
    learned. The decision is taken beside the row, without a join.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def run(batches):
        tables = net.tables() if net else []
        for batch in batches:
            texts = zip(batch.column(0).field("text").cast(pa.binary()), batch.column(1).to_pylist(), strict=True)
            stay = [bool(letters and net and net.judge(t.as_py(), tables)[1] >= least) for t, letters in texts]
            yield batch.filter(pa.array(stay, pa.bool_())).select([0])

    letters = F.coalesce(F.col("row.text").rlike(LETTERS), F.lit(False)).alias("letters")
    return rows.select("row", letters).mapInArrow(run, rows.schema).select("row.*")
