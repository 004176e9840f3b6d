"""Repeated passages, found by parsing documents relative to indexed reference blocks.

A window is ``window`` consecutive words of one document. A word goes if a window
covers it whose words also start earlier: in a smaller doc_id, or further up in
the same document. What stays is the first occurrence of everything.

Reference blocks. The anchor of a window is its ``anchor`` consecutive words of
the least hash, so that equal windows have equal anchors at equal places. An
anchor that occurs once in the corpus can't lie in a repeated window. Of every other
one the first occurrence, with the words that a window round it may reach, goes
into the reference: the block of its document, indexed by anchors.

Parsing. Each later occurrence is sent, with the words round it, to the block that
holds the first. There the passage is factored as Lempel and Ziv do, relative to
the block: from an anchor the match grows in both directions as far as the words
agree. Factors of ``window`` words or more are repeated spans.

Factor boundaries. A window that crosses the end of a factor may repeat another
place than the block's. Those windows, and the block's own ones that share their
anchor, are compared by hash across all blocks: all but the earliest are spans.
Each window's anchor is either new, or leads it to a block where a factor covers
it or its hash goes on, so that nothing is missed.

Scale. Texts move by document, once for both joins that need them; anchors are
counted before they move; a passage that very many documents share has copies of
its block (one for every ``pieces`` occurrences), each with a part of them.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.llm.tables import cut
from gradus.llm.weighted import WordHasher, mix

PLACE = 28  # bits of a word's place in its document; the document's number has those above


# ------------------------------------------------------------------ in a task
class Stretch:
    """Words of many texts in one row, with hashes of any run of words in it."""

    def __init__(self, hasher: WordHasher, texts: list[bytes], part: int = 1 << 20):
        self.counts = np.array([len(t.split()) for t in texts], np.int64)
        self.begins = np.cumsum(self.counts) - self.counts
        joined, found, at = b"\n".join(texts), [], 0
        while at < len(joined):  # in parts that end with a word
            to = at + part
            while to < len(joined) and joined[to] not in b" \t\n\v\f\r":
                to += 1
            found.append(hasher(joined[at:to]))
            at = to
        words = np.concatenate(found) if found else np.zeros(0, np.uint64)
        self.n = len(words)
        up, self.down = hasher.powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(words * up[: self.n], out=self.sums[1:])
        self.text = np.repeat(np.arange(len(texts)), self.counts)  # which text a word is of
        self.begin = self.begins[self.text]
        self.stop = self.begin + self.counts[self.text]

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the words from a up to b; comparable for runs of equal length."""
        return mix((self.sums[b] - self.sums[a]) * self.down[a])

    def anchors(self, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts of the windows that lie within one text, places of their anchors)."""
        n = self.n - window + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(self.n - anchor + 1)
        hashes = self.hash(at, at + anchor)
        least, place = hashes[:n].copy(), np.zeros(n, np.int64)
        for i in range(1, window - anchor + 1):
            other = hashes[i : i + n]
            less = other < least
            np.copyto(least, other, where=less)
            place[less] = i
        starts = np.flatnonzero(at[:n] + window <= self.stop[:n])
        return starts, starts + place[starts]


def longest(equal, limit: np.ndarray) -> np.ndarray:
    """The largest n up to the limit for which ``equal(n)`` holds, as it does for all smaller ones; a search for all at once."""
    low, high = np.zeros_like(limit), limit.copy()
    while (low < high).any():
        middle = (low + high + 1) // 2
        holds = equal(middle)
        low, high = np.where(holds, middle, low), np.where(holds, high, middle - 1)
    return low


def factors(texts: Stretch, p: np.ndarray, block: Stretch, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, stop) of the longest match round each anchor at p of the texts, which stands at q in the block."""
    ahead = longest(lambda n: texts.hash(p, p + n) == block.hash(q, q + n), np.minimum(texts.stop[p] - p, block.stop[q] - q))
    back = longest(lambda n: texts.hash(p - n, p) == block.hash(q - n, q), np.minimum(p - texts.begin[p], q - block.begin[q]))
    return p - back, p + ahead


class Parser:
    """Parses passages relative to the blocks that they are dealt to."""

    def __init__(self, window: int, anchor: int):
        self.window, self.anchor, self.hasher = window, anchor, WordHasher()

    def placed(self, rows: list[tuple]) -> tuple[Stretch, np.ndarray, np.ndarray, np.ndarray]:
        """Rows of (block, doc, start, marks, text) -> (words, places of the marks, their key within the block, each word's corpus place)."""
        words = Stretch(self.hasher, [r[4] for r in rows])
        marks = [np.frombuffer(r[3], np.int32) for r in rows]
        sizes = list(map(len, marks))
        shift = words.begins - np.array([r[2] for r in rows], np.int64)
        places = np.concatenate(marks).astype(np.int64) + np.repeat(shift, sizes)
        block = np.repeat(np.array([r[0] for r in rows], np.uint64), sizes)
        key = mix(words.hash(places, places + self.anchor) + block * np.uint64(WordHasher.BASE))
        corpus = np.array([r[1] << PLACE for r in rows], np.int64) - shift
        return words, places, key, np.arange(words.n) + corpus[words.text]

    def parse(self, refs: list[tuple], pieces: list[tuple]) -> pa.RecordBatch:
        """Factors (at, stop, source) of the pieces, and windows (hash, at) that no factor covers, those of the blocks included."""
        block, q, known, ref_at = self.placed(refs)
        texts, p, keys, at = self.placed(pieces)
        order = np.argsort(known)
        known, q = known[order], q[order]
        hit = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
        found = known[hit] == keys
        mate = np.full(texts.n + 1, -1)
        mate[p[found]] = q[hit[found]]
        start, stop = factors(texts, p[found], block, q[hit[found]])
        source = ref_at[q[hit[found]] - (p[found] - start)]
        long = stop - start >= self.window
        start, stop, source = start[long], stop[long], source[long]
        spans = np.unique(np.stack([at[start], stop - start, source]), axis=1) if len(start) else np.zeros((3, 0), np.int64)
        # windows at the boundaries
        inside = np.zeros(texts.n + 2, np.int64)
        np.add.at(inside, start, 1)
        np.add.at(inside, stop - self.window + 1, -1)
        inside = np.cumsum(inside) > 0
        marked = np.zeros(texts.n + 1, bool)
        marked[p] = True
        begins, anchors = texts.anchors(self.window, self.anchor)
        left = marked[anchors] & ~inside[begins]
        begins, anchors = begins[left], anchors[left]
        wanted = np.zeros(block.n + 1, bool)
        wanted[mate[anchors]] = True  # -1 is the spare place at the end
        wanted[-1] = False
        own, own_anchors = block.anchors(self.window, self.anchor)
        own = own[wanted[own_anchors]]
        windows = np.concatenate([texts.hash(begins, begins + self.window), block.hash(own, own + self.window)]).view(np.int64)
        places = np.concatenate([at[begins], ref_at[own]])
        n, m = spans.shape[1], len(windows)
        void = np.zeros(n + m, bool)
        void[:n] = True
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.zeros(n, np.int64), windows]), mask=void),
                pa.array(np.concatenate([spans[0], places])),
                pa.array(np.concatenate([spans[1], np.full(m, self.window)]).astype(np.int32)),
                pa.array(np.concatenate([spans[2], np.zeros(m, np.int64)]), mask=~void),
            ],
            ["window", "at", "length", "source"],
        )


def _marks(window: int, anchor: int, size: int = 1 << 21):
    """Texts -> (h, at): anchors with their places in the corpus."""

    def flush(hasher, docs, texts):
        words = Stretch(hasher, texts)
        places = np.unique(words.anchors(window, anchor)[1])
        at = (np.array(docs, np.int64)[words.text[places]] << PLACE) + places - words.begin[places]
        return pa.RecordBatch.from_arrays([pa.array(words.hash(places, places + anchor).view(np.int64)), pa.array(at)], ["h", "at"])

    def run(batches):
        hasher, docs, texts, held = WordHasher(), [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                docs.append(doc)
                texts.append(text.as_py())
                held += len(texts[-1])
                if held >= size or len(texts) >= 1 << 16:
                    yield flush(hasher, docs, texts)
                    docs, texts, held = [], [], 0
        if texts:
            yield flush(hasher, docs, texts)

    return run


def _pieces(window: int, anchor: int):
    """Texts with their repeated anchors -> words of the reference (kind 0) and passages to parse (kind 1), by block and copy."""
    before, after = window - anchor, window

    def regions(places):
        """Maximal runs of places whose windows touch."""
        cuts = np.flatnonzero(np.diff(places) > before + after) + 1
        return np.split(places, cuts)

    def run(batches):
        for batch in batches:
            out = []
            lists = [batch.column(i).to_pylist() for i in (0, 2, 3, 4)]
            for (doc, places, sources, copies), text in zip(zip(*lists, strict=True), batch.column(1).cast(pa.binary()), strict=True):
                words = text.as_py().split()
                places, sources, copies = np.array(places, np.int32), np.array(sources, np.int64), np.array(copies, np.int64)
                order = np.lexsort((places, sources, copies > 0))
                places, sources, copies = places[order], sources[order], copies[order]
                later = copies > 0  # own anchors have the negative number
                groups = np.flatnonzero((np.diff(sources) != 0) | (np.diff(later) != 0)) + 1
                for some in np.split(np.arange(len(places)), groups):
                    for part in regions(np.unique(places[some])):
                        a, b = max(0, int(part[0]) - before), min(len(words), int(part[-1]) + after)
                        row = (int(sources[some[0]]), doc, a, part.tobytes(), b" ".join(words[a:b]))
                        if later[some[0]]:
                            most = int(copies[some].max())
                            out.append((row[0], int(mix(np.array([doc], np.uint64))[0] % np.uint64(most)), 1, *row[1:]))
                        else:
                            out.extend((row[0], i, 0, *row[1:]) for i in range(int(-copies[some].min())))
                        if len(out) >= 1 << 14:
                            yield pieces_batch(out)
                            out = []
            yield pieces_batch(out)

    return run


def pieces_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    names = ["block", "copy", "kind", "doc", "start", "marks", "words"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _parse(window: int, anchor: int, size: int = 1 << 21):
    def run(batches):
        parser = Parser(window, anchor)
        last, block, refs, pieces, held = None, 0, [], [], 0
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for key, copy, kind, doc, start, marks, words in zip(*columns, batch.column(6), strict=True):
                full = held >= size
                if full and pieces:
                    yield parser.parse(refs, pieces)
                    pieces, held = [], 0
                if (key, copy) != last:
                    last, block = (key, copy), block + 1
                    if full:
                        refs = []
                elif full:
                    refs = [r for r in refs if r[0] == block]
                row = (block, doc, start, marks, words.as_py())
                (pieces if kind else refs).append(row)
                held += len(row[4])
        if pieces:
            yield parser.parse(refs, pieces)

    return run


# ------------------------------------------------------------------ in Spark
ROOM = 1 << (63 - PLACE)


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
    """((doc, text), names or None, shift): whole numbers in order of doc_id.

    Where ids are given, differ and span less than 2^35 they are numbers, less
    their minimum. Otherwise distinct (doc_id, text) are numbered, nulls last, rows
    of one id by a hash of their texts; ``names`` then has each number's doc_id.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    low, high, n, given = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*"), F.count("doc_id")).first()
    if not n:
        return rows.select(F.col("doc_id").alias("doc"), "text"), None, 0
    if given == n and high - low < ROOM and rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        # never null, so that inner and outer joins ask for the same rows and share one exchange of the texts
        return rows.select(F.coalesce(F.col("doc_id") - low, F.lit(0)).alias("doc"), "text"), None, low
    rows = rows.select("doc_id", F.xxhash64("text").alias("tie"), F.length("text").alias("chars"), "text")
    keys = cut(rows.select("doc_id", "tie", "chars").distinct().orderBy(F.col("doc_id").asc_nulls_last(), "tie", "chars"))
    keys = keys.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    offsets, total = {}, 0
    for part, count in sorted(keys.groupBy("part").count().collect()):  # one row for each partition
        offsets[part], total = total, total + count
    first = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv])[F.col("part")]
    names = cut(keys.select("doc_id", "tie", "chars", (first + F.col("row").bitwiseAND((1 << 33) - 1)).cast("long").alias("doc")))
    other = names.select(F.col("doc_id").alias("i"), F.col("tie").alias("t"), F.col("chars").alias("c"), "doc")
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("tie") == F.col("t")) & (F.col("chars") == F.col("c"))
    return rows.join(other, same).select("doc", "text"), names.select("doc", "doc_id"), 0


def splittable(rows: DataFrame, unique: DataFrame, key: str) -> DataFrame:
    """Inner join with an aggregate by its key, under a name that hides how the aggregate is dealt.

    Otherwise aggregate and join share one exchange, which adaptive execution can't
    split where a key is common. The aggregate, which moves once more, is small.
    """
    flipped = F.col(key).bitwiseXOR(F.lit(1)).alias("key")
    return rows.select("*", flipped).join(unique.select("*", flipped).drop(key), "key").drop("key")


def found(texts: DataFrame, window: int = 20, anchor: int = 6, pieces: int = 2048) -> DataFrame:
    """(window, at, length, source) of ``(doc, text)``: factors, whose window is null, and windows at their boundaries, whose source is null.

    ``at`` and ``source`` are places in the corpus: a document's number shifted by
    ``PLACE`` bits, and the word's place in it.
    """
    marks = texts.mapInArrow(_marks(window, anchor), "h long, at long")
    first = marks.groupBy("h").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = F.ceil(F.col("n") / pieces).cast("int")
    met = splittable(marks, first, "h").select(
        F.shiftright("at", PLACE).alias("of"),
        F.col("at").bitwiseAND((1 << PLACE) - 1).cast("int").alias("place"),
        F.shiftright("first", PLACE).alias("source"),
        F.when(F.col("at") == F.col("first"), -copies).otherwise(copies).alias("copies"),
    )
    lists = met.groupBy("of").agg(*[F.collect_list(c).alias(c) for c in ("place", "source", "copies")])
    joined = texts.join(lists, F.col("doc") == F.col("of")).select("doc", "text", "place", "source", "copies")
    dealt = joined.mapInArrow(_pieces(window, anchor), "block long, copy int, kind int, doc long, start int, marks binary, words binary")
    dealt = dealt.repartition("block", "copy").sortWithinPartitions("block", "copy", "kind")
    return dealt.mapInArrow(_parse(window, anchor), "window long, at long, length int, source long")


def spans(texts: DataFrame, window: int = 20, **options) -> DataFrame:
    """(at, length) of every repeated span of ``(doc, text)``."""
    parsed = found(texts, window, **options)
    factor = parsed.where("window is null").select("at", "length")
    open_windows = parsed.where("window is not null").select("window", "at", "length")
    first = open_windows.groupBy("window").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("last > first").select("window", "first")
    again = splittable(open_windows, first, "window").where("at > first").select("at", "length")
    return factor.unionByName(again)


def _rest(batches):
    """(doc, text, places, lengths) -> (doc, n_words, n_removed, text of the words that stay)."""
    for batch in batches:
        docs, places, lengths = (batch.column(i).to_pylist() for i in (0, 2, 3))
        n_words, n_removed, kept = [], [], []
        for text, at, length in zip(batch.column(1).cast(pa.binary()), places, lengths, strict=True):
            words = text.as_py().split()
            n_words.append(len(words))
            if at:
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, np.array(at), 1)
                np.add.at(edge, np.array(at) + np.array(length), -1)
                words = list(compress(words, np.cumsum(edge) == 0))
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        kept = pa.array(kept, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), kept], ["doc", "n_words", "n_removed", "text"])


def without_repeats(docs: DataFrame, window: int = 20, **options) -> DataFrame:
    """(doc_id, n_words, n_removed, text): each row's words outside repeated windows, joined by one space.

    Words are maximal runs of other characters than space and U+0009 to U+000D,
    compared as they are. One row per input row. A null text has no words. Null
    doc_ids come after all others. Rows of one doc_id go by a hash of their
    texts; rows alike in both count as one document and get the same result. Texts
    of fewer words than a window stay whole. Texts may have 2^28 words. Other
    columns are ignored.
    """
    texts, names, shift = numbered(docs)
    gone = spans(texts, window, **options)
    gone = gone.select(F.shiftright("at", PLACE).alias("of"), F.col("at").bitwiseAND((1 << PLACE) - 1).cast("int").alias("place"), "length")
    lists = gone.groupBy("of").agg(F.collect_list("place").alias("places"), F.collect_list("length").alias("lengths"))
    joined = texts.join(lists, F.col("doc") == F.col("of"), "left").select("doc", "text", "places", "lengths")
    rest = joined.mapInArrow(_rest, "doc long, n_words long, n_removed long, text string")
    if names is None:
        return rest.select((F.col("doc") + shift).alias("doc_id"), "n_words", "n_removed", "text")
    names = names.select(F.col("doc").alias("named"), "doc_id")
    return rest.join(names, F.col("doc") == F.col("named")).select("doc_id", "n_words", "n_removed", "text")


def factored(docs: DataFrame, window: int = 20, **options) -> DataFrame:
    """(doc_id, start, length, source_id, source_start) of the factors of ``window`` words or more, in words.

    Rows and ties as in :func:`without_repeats`.
    """
    texts, names, shift = numbered(docs)
    rows = found(texts, window, **options).where("window is null")
    low = F.lit((1 << PLACE) - 1)
    rows = rows.select(
        F.shiftright("at", PLACE).alias("doc"),
        F.col("at").bitwiseAND(low).alias("start"),
        F.col("length").cast("long").alias("length"),
        F.shiftright("source", PLACE).alias("source"),
        F.col("source").bitwiseAND(low).alias("source_start"),
    )
    if names is None:
        named: list[Column] = [(F.col("doc") + shift).alias("doc_id"), (F.col("source") + shift).alias("source_id")]
    else:
        one, other = (names.select(F.col("doc").alias(a), F.col("doc_id").alias(b)) for a, b in (("d", "di"), ("s", "si")))
        rows = rows.join(one, F.col("doc") == F.col("d")).join(other, F.col("source") == F.col("s"))
        named = [F.col("di").alias("doc_id"), F.col("si").alias("source_id")]
    return rows.select(named[0], "start", "length", named[1], "source_start")


#: Windows by their words, the earliest of each, and the words under all others.
ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), starts AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 19)) AS s FROM words WHERE len(w) >= 20
), windows AS (
  SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS key FROM starts JOIN words USING (doc_id)
), ranked AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY key ORDER BY doc_id, s) AS k FROM windows
), gone AS (
  SELECT DISTINCT doc_id, s + d AS place FROM ranked, (SELECT unnest(generate_series(0, 19)) AS d) WHERE k > 1
), each_word AS (
  SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS place FROM words
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text FROM each_word ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id
)
SELECT words.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""
