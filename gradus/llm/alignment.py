"""Alignment of two tokenizers over a corpus, with inverted pair bitmaps.

Both tokenizers cut the same bytes. A token of A and one of B are linked where
their byte ranges overlap; ends that both have cut a text into groups.

Index. Documents are numbered within chunks, and every pair of token ids has for
each chunk the documents that link it: as bit planes, of which plane k holds the
documents whose number of such links has bit k. A plane is a compressed bitmap, a
sorted list of 16-bit numbers where few documents are set and plain bits where
many are. The planes ORed and counted give the number of documents, and counts of
the planes, weighted by their powers of two, the number of links. Chunks are
disjoint, so that corpus-wide counts are sums of counts; the index itself isn't
gathered by pair.

Scores. A pair's corpus-wide count, and whether it is the highest of its B token,
go back along the postings: joined to the pair's bitmaps, dealt by chunk, and
added up for every document that a plane holds.

Scale. A pair that all documents have is one row to a chunk. Chunks close after a
number of links, so that tasks hold bounded arrays. Both vocabularies travel with
the job; their size is that of the files.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.tables import cut, width

CHUNK = 1 << 16  # documents of a chunk at most: their numbers have 16 bits


# ------------------------------------------------------------------ tokenizers
def byte_letters() -> dict[str, int]:
    """Which byte each letter of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = sorted(set(range(256)) - set(shown))
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """Tokenizer A: a byte-level vocabulary file of the tokenizers library; encodes a space and the text.

    Where the file says no more than merges in the order of their ids, and the usual
    pattern, tiktoken's encoder takes its place: it gives the same ids in a sixth of
    the time. Texts with very long runs of one pre-token stay with the file's own.
    """

    def __init__(self, file: bytes, pattern: str | None = None, longest: int = 2000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file.decode())
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        letters, vocabulary = byte_letters(), self.tokenizer.get_vocab()
        self.bytes = [b""] * (1 + max(vocabulary.values(), default=-1))
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(map(letters.__getitem__, token))
        self.fast, self.runs = self.ranked(json.loads(file), vocabulary, pattern), re.compile(rf"\S{{{longest}}}|\s{{{longest}}}")

    def ranked(self, file: dict, vocabulary: dict[str, int], pattern: str | None):
        """tiktoken's encoder, if the pattern is given and the file's merges rank tokens as their ids do."""
        model, split = file["model"], file.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        plain = plain and not (file.get("normalizer") or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"))
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        made = [vocabulary["".join(m)] for m in merges]
        special = {t["id"] for t in file.get("added_tokens", [])}
        single = [i for t, i in vocabulary.items() if len(t) == 1]
        if not (pattern and plain and made == sorted(set(made)) and set(made) | set(single) | special == set(vocabulary.values())):
            return None
        from tiktoken import Encoding

        return Encoding("file", pat_str=pattern, mergeable_ranks={self.bytes[i]: i for i in (*single, *made)}, special_tokens={})

    def encode(self, texts: list[str]) -> list:
        slow = [i for i, t in enumerate(texts) if self.fast is None or self.runs.search(t)]
        out = [None] * len(texts) if slow else []
        if slow:
            for i, e in zip(slow, self.tokenizer.encode_batch_fast([" " + texts[i] for i in slow], add_special_tokens=False), strict=True):
                out[i] = e.ids
        if not slow:
            return [self.fast.encode_to_numpy(" " + t, disallowed_special=()) for t in texts]
        return [self.fast.encode_to_numpy(" " + t, disallowed_special=()) if ids is None else ids for t, ids in zip(texts, out, strict=True)]


class Pieces:
    """Tokenizer B: a model of the sentencepiece library, which adds the space itself."""

    def __init__(self, file: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        byte = [re.fullmatch(r"<0x([0-9A-F]{2})>", p) for p in pieces]
        self.bytes = [bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode() for m, p in zip(byte, pieces, strict=True)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


# ------------------------------------------------------------------ one batch of texts
class Aligner:
    def __init__(self, a, b):
        self.a, self.b = a, b
        self.bytes = [pa.array(t.bytes, pa.binary()) for t in (a, b)]
        self.lengths = [np.array(list(map(len, t.bytes)), np.int64) for t in (a, b)]
        ends = [(",", "|"), (",", ";")]  # after a token within its group, and after the last of a side
        self.names = pa.array([f"{i}{e}" for t, end in zip((a, b), ends, strict=True) for i in range(len(t.bytes)) for e in end])
        self.first = [0, 2 * len(a.bytes)]

    def tokens(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, number of ids of each text) of both tokenizers; none for texts that are empty or that one of them doesn't give back."""
        read = [t.decode("utf-8", "replace") for t in texts]
        out, right = [], np.array([bool(t) for t in texts], bool)
        for tokenizer, table, length in zip((self.a, self.b), self.bytes, self.lengths, strict=True):
            found = tokenizer.encode(read)
            n = np.array(list(map(len, found)), np.int64)
            ids = np.concatenate([np.asarray(x, np.int64) for x in found]) if len(found) else np.zeros(0, np.int64)
            data = table.take(pa.array(ids)).buffers()[2]
            data = memoryview(data or b"").cast("B")
            size = np.concatenate([[0], np.cumsum(length[ids])])[np.concatenate([[0], np.cumsum(n)])].tolist()
            right &= [data[lo:hi] == b" " + t for lo, hi, t in zip(size[:-1], size[1:], texts, strict=True)]
            out.append((ids, n))
        return [(ids[np.repeat(right, n)], np.where(right, n, 0)) for ids, n in out]

    def __call__(self, texts: list[bytes]) -> tuple[list[tuple], np.ndarray, np.ndarray]:
        """((n_a, n_b, n_groups, n_links, digest of the groups) of each text, text of every link, its pair)."""
        (ids_a, n_a), (ids_b, n_b) = self.tokens(texts)
        text_a, text_b = (np.repeat(np.arange(len(texts)), n) for n in (n_a, n_b))
        ends_a, ends_b = (np.cumsum(length[ids]) for length, ids in zip(self.lengths, (ids_a, ids_b), strict=True))  # no token is empty: ends differ
        to_b, to_a = np.searchsorted(ends_b, ends_a), np.searchsorted(ends_a, ends_b)
        last_a, last_b = ends_b[to_b] == ends_a, ends_a[to_a] == ends_b  # a group ends where both end
        # every end of either side closes the stretch of bytes that one pair of tokens has in common
        alone = ~last_b
        pair = np.concatenate([ids_a * len(self.b.bytes) + ids_b[to_b], ids_a[to_a[alone]] * len(self.b.bytes) + ids_b[alone]])
        text = np.concatenate([text_a, text_b[alone]])
        n_groups, n_links = (np.bincount(x, minlength=len(texts)) for x in (text_a[last_a], text))
        # tokens in the order of their groups: those of A come after B's of earlier groups, those of B after A's of the group
        group_a, group_b = (np.cumsum(last) - last for last in (last_a, last_b))
        before_b = np.concatenate([[0], np.flatnonzero(last_b) + 1])
        upto_a = np.flatnonzero(last_a) + 1
        codes = np.zeros(len(ids_a) + len(ids_b), np.int64)
        codes[np.arange(len(ids_a)) + before_b[group_a]] = 2 * ids_a + last_a
        codes[np.arange(len(ids_b)) + upto_a[group_b]] = self.first[1] + 2 * ids_b + last_b
        named = self.names.take(pa.array(codes))
        data = memoryview(named.buffers()[2] or b"").cast("B")
        at = np.frombuffer(named.buffers()[1], np.int32)[: len(codes) + 1][np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
        digests = [hashlib.sha256(data[lo : hi - 1]).hexdigest() if hi > lo else "" for lo, hi in zip(at[:-1], at[1:], strict=True)]
        rows = list(zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_links.tolist(), digests, strict=True))
        return rows, text, pair


# ------------------------------------------------------------------ bitmaps
LIST, BITS = b"\0", b"\1"


def bitmap(numbers: np.ndarray) -> bytes:
    """A sorted set of 16-bit numbers: a list, or bits up to the largest, whichever is shorter."""
    if len(numbers) * 16 <= int(numbers[-1]) + 1:
        return LIST + numbers.astype("<u2").tobytes()
    bits = np.zeros(int(numbers[-1]) + 1, np.uint8)
    bits[numbers] = 1
    return BITS + np.packbits(bits, bitorder="little").tobytes()


def numbers(bits: bytes) -> np.ndarray:
    if bits[:1] == LIST:
        return np.frombuffer(bits, "<u2", offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8, offset=1), bitorder="little"))


def popcount(bits: bytes) -> int:
    if bits[:1] == LIST:
        return len(bits) // 2
    return int(np.bitwise_count(np.frombuffer(bits, np.uint8, offset=1)).sum())


def merged(planes: list[bytes]) -> bytes:
    """The OR of bitmaps."""
    if len(planes) == 1:
        return planes[0]
    if all(p[:1] == LIST for p in planes):
        return bitmap(np.unique(np.concatenate([numbers(p) for p in planes])))
    size = max(int(n[-1]) for n in map(numbers, planes)) // 8 + 1
    total = np.zeros(size, np.uint8)
    for p in planes:
        bits = np.frombuffer(p, np.uint8, offset=1) if p[:1] == BITS else np.packbits(np.bincount(numbers(p), minlength=8 * size).astype(np.uint8), bitorder="little")
        total[: len(bits)] |= bits
    return BITS + total.tobytes()


def planes_of(docs: np.ndarray, times: np.ndarray) -> list[bytes]:
    """Plane k: the documents whose number of links has bit k; empty planes stay as an empty list."""
    if times.max() == 1:
        return [bitmap(docs)]
    some = [docs[(times >> k & 1) == 1] for k in range(int(times.max()).bit_length())]
    return [bitmap(d) if len(d) else LIST for d in some]


def postings(pair: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int, list[bytes]]]:
    """(pair, number of documents, number of links, planes) of a chunk's links."""
    key, times = np.unique(pair * CHUNK + doc, return_counts=True)
    pair, doc = key // CHUNK, key % CHUNK
    starts = np.flatnonzero(np.diff(pair, prepend=-1))
    out = []
    for p, lo, hi in zip(pair[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(pair)], strict=False):
        planes = planes_of(doc[lo:hi], times[lo:hi])
        out.append((p, popcount(merged([x for x in planes if x != LIST])), sum(popcount(x) << k for k, x in enumerate(planes)), planes))
    return out


SCHEMA = (
    "chunk long, kind int, pair long, docs long, links long, planes array<binary>, "
    "number int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
)
DOC, PAIR = 1, 0  # a chunk's postings sort before its documents


def _batch(names: list[str], kinds: list, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _index(file_a: bytes, file_b: bytes, pattern: str | None, links: int, size: int = 1 << 19):
    """(doc_id, text) -> rows of SCHEMA: documents, and postings of the chunk whenever it is full."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    long, small = pa.int64(), pa.int32()
    kinds = [long, small, long, long, long, pa.list_(pa.binary()), small, long, long, long, long, long, pa.string()]

    def run(batches):
        aligner, task = Aligner(ByteLevel(file_a, pattern), Pieces(file_b)), TaskContext.get().partitionId()
        chunk, n, held = 0, 0, []  # of the open chunk: documents, and (pair, document) of its links

        def close():
            pair, doc = (np.concatenate([h[i] for h in held]) for i in (0, 1)) if held else (np.zeros(0, np.int64),) * 2
            rows = postings(pair, doc)
            for lo in range(0, len(rows), 1 << 14):
                yield _batch(names, kinds, [(chunk << 32 | task, PAIR, *r, None, None, None, None, None, None, None) for r in rows[lo : lo + (1 << 14)]])

        def add(ids, texts):
            nonlocal n
            rows, doc, pair = aligner(texts)
            held.append((pair, doc + n))
            out = []
            for k, (i, counts) in enumerate(zip(ids, rows, strict=True)):
                out.append((chunk << 32 | task, DOC, None, None, None, None, n + k, i, *counts))
            n += len(ids)
            return _batch(names, kinds, out)

        ids, texts, bytes_held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                ids.append(doc_id)
                texts.append(text.as_py() or b"")
                bytes_held += len(texts[-1])
                if bytes_held >= size or n + len(ids) >= CHUNK:
                    yield add(ids, texts)
                    ids, texts, bytes_held = [], [], 0
                    if n >= CHUNK or sum(len(h[0]) for h in held) >= links:
                        yield from close()
                        chunk, n, held = chunk + 1, 0, []
        if ids:
            yield add(ids, texts)
        yield from close()

    return run


def index(docs: DataFrame, file_a: str, file_b: str, pattern: str | None = None, links: int = 1 << 21) -> DataFrame:
    """Rows of ``SCHEMA``: every document (kind 1), and each chunk's postings by pair (kind 0).

    A pair is A's id times the size of B's vocabulary plus B's id. The files are
    read by the driver. ``pattern`` is that by which A's file splits texts, if its
    faster encoder may be used. A chunk closes at ``links`` links.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return cut(rows.mapInArrow(_index(Path(file_a).read_bytes(), Path(file_b).read_bytes(), pattern, links), SCHEMA))


def pair_scores(found: DataFrame, size_b: int) -> DataFrame:
    """(pair, n_docs, n_links, best): corpus-wide counts, and whether no other pair of the same B token has more links."""
    counts = found.where(F.col("kind") == PAIR).groupBy("pair").agg(F.sum("docs").alias("n_docs"), F.sum("links").alias("n_links"))
    counts = counts.withColumn("b", F.col("pair") % size_b)
    most = counts.groupBy(F.col("b").alias("of")).agg(F.max("n_links").alias("most"))
    return counts.join(most, F.col("b") == F.col("of")).select("pair", "n_docs", "n_links", (F.col("n_links") == F.col("most")).alias("best"))


def _returned(batches):
    """A chunk's postings with their scores, then its documents -> documents with the sums of their links' scores."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    last, total, best = None, np.zeros(CHUNK, np.int64), np.zeros(CHUNK, np.int64)
    for batch in batches:
        chunks, kinds = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        cuts = [0, *(np.flatnonzero((np.diff(chunks) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(chunks)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            if chunks[lo] != last:
                last = chunks[lo]
                total[:], best[:] = 0, 0
            part = batch.slice(lo, hi - lo)
            if kinds[lo] == PAIR:
                add_scores(part, total, best)
            else:
                at = part.column(5).to_numpy(zero_copy_only=False)
                sums = [pa.array(total[at]), pa.array(best[at])]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(6, 11)), sums[1], sums[0], part.column(11)], names)


def add_scores(part: pa.RecordBatch, total: np.ndarray, best: np.ndarray) -> None:
    """Add each posting's score, times its number of links, to its documents."""
    planes, count, is_best = part.column(2), part.column(3).to_numpy(), part.column(4).to_numpy(zero_copy_only=False).astype(np.int64)
    n = planes.value_lengths().to_numpy()
    row = np.repeat(np.arange(len(n)), n)
    power = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)  # a plane's place in its list
    bits = planes.flatten()
    offsets = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + len(bits) + 1].astype(np.int64)
    data = np.frombuffer(bits.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(bits) and bits.buffers()[2] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    heads, sizes = offsets[:-1], np.diff(offsets)
    plain = data[heads] == LIST[0]
    keep = np.repeat(plain, sizes)
    keep[heads] = False
    docs = [np.ascontiguousarray(data[keep]).view("<u2").astype(np.int64)]
    owner = [np.repeat(np.flatnonzero(plain), sizes[plain] // 2)]
    for i in np.flatnonzero(~plain).tolist():
        docs.append(numbers(data[offsets[i] : offsets[i + 1]].tobytes()))
        owner.append(np.full(len(docs[-1]), i))
    docs, owner = np.concatenate(docs), np.concatenate(owner)
    times = np.left_shift(1, power[owner])
    np.add.at(total, docs, times * count[row[owner]])
    np.add.at(best, docs, times * is_best[row[owner]])


def align(docs: DataFrame, file_a: str, file_b: str, pattern: str | None = None, links: int = 1 << 21) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    ``n_best`` counts the links whose pair has the most links of all pairs with its
    B token, ties included; ``count_sum`` adds the corpus-wide counts of all links.
    One row per input row, repeated rows and null ids too, each of which counts. A
    text that is null or empty, or that a tokenizer's tokens don't give back byte
    by byte, has zeros and an empty digest, and adds to no count. Other columns are
    ignored.
    """
    found = index(docs, file_a, file_b, pattern, links)
    size_b = len(Pieces(Path(file_b).read_bytes()).bytes)
    scores = pair_scores(found, size_b).select(F.col("pair").alias("scored"), F.col("n_links").alias("count"), "best")
    held = found.where(F.col("kind") == PAIR).join(scores, F.col("pair") == F.col("scored"))
    own = ["number", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kinds = dict(found.dtypes)
    held = held.select("chunk", "kind", "planes", "count", "best", *[F.lit(None).cast(kinds[c]).alias(c) for c in own])
    rows = found.where(F.col("kind") == DOC).select("chunk", "kind", "planes", F.lit(None).cast("long").alias("count"), F.lit(None).cast("boolean").alias("best"), *own)
    n = width(docs)
    dealt = held.unionByName(rows).repartitionById(n, F.pmod("chunk", F.lit(n)).cast("int")).sortWithinPartitions("chunk", "kind")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return dealt.mapInArrow(_returned, schema)


def vocabulary_links(docs: DataFrame, file_a: str, file_b: str, pattern: str | None = None, links: int = 1 << 21) -> DataFrame:
    """(a_id, b_id, n_docs, n_links, best): which tokens of either vocabulary stand for each other over the corpus, and in how many documents."""
    size_b = len(Pieces(Path(file_b).read_bytes()).bytes)
    scores = pair_scores(index(docs, file_a, file_b, pattern, links), size_b)
    return scores.select(F.floor(F.col("pair") / size_b).alias("a_id"), (F.col("pair") % size_b).alias("b_id"), "n_docs", "n_links", "best")
