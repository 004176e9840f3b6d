"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Merging always takes the pair of lowest rank, the leftmost among equals. Open
pairs wait in one bucket per merge rank, which holds their positions in a linked
list of parts. A bitmap of two levels says which buckets are filled: a bit for
each of 256 ranks in a word, and a bit for each word. Find-first-set on both
yields the next rank. A merge leaves the pairs it
destroyed where they are; they are recognised as stale when they come up. A
pre-token of n bytes takes O(n log n), whatever its length, and many short ones
share one queue: a bucket then holds places in all of them.

The vocabulary file is read once by the driver and broadcast: its size is that
of the file, whatever the corpus.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_ranks(path: str) -> dict[bytes, int]:
    """A file with one ``base64(token) rank`` a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Encoder(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers.

    Pre-tokens that are not known yet are merged together, as one linked list in
    which nothing merges across their borders. Remembers up to ``memory`` of them,
    those of up to 64 bytes, then starts anew.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: int = 400_000, chunk: int = 1 << 18):
        super().__init__()
        self.ranks, self.find, self.memory, self.chunk = ranks, regex.compile(pattern).findall, memory, chunk
        self.longest = max(map(len, ranks), default=1)
        size = max(ranks.values(), default=-1) + 1
        self.low = [0] * -(-size // 256)  # one bit per filled bucket; empty again after every run
        self.single, self.double = np.full(256, -1, np.int32), np.full(1 << 16, -1, np.int32)
        self.tokens = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
            if len(token) == 1:
                self.single[token[0]] = rank
            elif len(token) == 2:
                self.double[token[0] << 8 | token[1]] = rank

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pre-tokens that are not empty.

        ``end[i]`` is where the part that starts at i ends, ``before[i]`` where
        the part before it starts, ``id_of[i]`` its id (-1: merged away), and
        ``open_at[i]`` the rank of the pair that starts at i, -1 if it has none.
        A bucket is worked off from left to right, until a merge opens a pair of
        lower rank.
        """
        text = b"".join(pieces)
        n, get, longest, low, top = len(text), self.ranks.get, self.longest, self.low, 0
        starts = np.cumsum([0, *map(len, pieces)])
        data = np.frombuffer(text, np.uint8)
        first = np.zeros(n + 1, bool)
        first[starts] = True
        pairs = self.double[data[:-1].astype(np.int32) << 8 | data[1:]]
        pairs[first[1:-1]] = -1
        open_at, id_of = [*pairs.tolist(), -1], self.single[data].tolist()
        end, before, border = list(range(1, n + 1)), list(range(-1, n)), first.tobytes()
        places = np.flatnonzero(pairs >= 0)
        places = places[np.argsort(pairs[places], kind="stable")]
        known, cuts = np.unique(pairs[places], return_index=True)
        buckets = {r: x.tolist() for r, x in zip(known.tolist(), np.split(places, cuts[1:]), strict=True)} if len(known) else {}
        for r in buckets:
            low[r >> 8] |= 1 << (r & 255)
            top |= 1 << (r >> 8)
        while top:
            word = (top & -top).bit_length() - 1
            bits = low[word]
            rank = word << 8 | (bits & -bits).bit_length() - 1
            bucket = buckets.pop(rank)
            low[word] = bits = bits & (bits - 1)
            if not bits:
                top &= top - 1
            bucket.sort()
            for k, i in enumerate(bucket):
                if open_at[i] != rank:
                    continue  # stale
                j = end[i]
                end[i] = stop = end[j]
                id_of[i], id_of[j], open_at[i], open_at[j] = rank, -1, -1, -1
                lower = False
                if not border[stop]:
                    before[stop] = i
                    to = end[stop]
                    new = get(text[i:to]) if to - i <= longest else None
                    if new is not None:
                        open_at[i] = new
                        if new in buckets:
                            buckets[new].append(i)
                        else:
                            buckets[new] = [i]
                            low[new >> 8] |= 1 << (new & 255)
                            top |= 1 << (new >> 8)
                            lower = new < rank
                if not border[i]:
                    h = before[i]
                    new = get(text[h:stop]) if stop - h <= longest else None
                    if new is None:
                        open_at[h] = -1
                    else:
                        open_at[h] = new
                        if new in buckets:
                            buckets[new].append(h)
                        else:
                            buckets[new] = [h]
                            low[new >> 8] |= 1 << (new & 255)
                            top |= 1 << (new >> 8)
                            lower = lower or new < rank
                if lower:
                    if k + 1 < len(bucket):  # the rest waits
                        buckets[rank] = bucket[k + 1 :]
                        low[word] |= 1 << (rank & 255)
                        top |= 1 << word
                    break
        ids = np.array(id_of, np.int32)
        left = ids >= 0
        counts = np.concatenate([[0], np.cumsum(left)])[starts] * 4
        out = ids[left].astype("<u4").tobytes()
        return [out[a:b] for a, b in zip(counts.tolist(), counts[1:].tolist(), strict=False)]

    def learn(self, tokens: list[str]) -> None:
        """Put the ids of all these pre-tokens into the memory."""
        waiting, pieces, size = [], [], 0
        for k, token in enumerate(tokens, 1):
            piece = token.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(piece)
            if whole is not None:
                self[token] = whole.to_bytes(4, "little")
            else:
                waiting.append(token)
                pieces.append(piece)
                size += len(piece)
            if pieces and (size >= self.chunk or k == len(tokens)):
                self.update(zip(waiting, self.merge(pieces), strict=True))
                waiting, pieces, size = [], [], 0

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of several texts; the more at once, the less time for each."""
        found = [self.find(t) for t in texts]
        every = set().union(*found)
        new = every.difference(self)
        if len(self) + len(new) > self.memory:
            self.clear()
            new = every
        self.learn(sorted(new))
        out = [b"".join(map(self.__getitem__, f)) for f in found]
        for token in new:
            if len(token) > 64:
                del self[token]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _groups(texts: Iterable[str], size: int = 1 << 18):
    """Neighbouring texts of together about ``size`` characters, one group in memory at a time."""
    held, total = [], 0
    for text in texts:
        held.append(text)
        total += len(text)
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def _shared(df: DataFrame, ranks: dict[bytes, int]):
    return df.sparkSession.sparkContext.broadcast(ranks)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids): the whole text of each row as token ids, a null text as an empty one.

    With ``digests`` in place of the ids: ids_sha256 of their little-endian
    32-bit form, and decoded_sha256 of the bytes that they decode to. One row per
    input row; repeated and null doc_ids stay as they are. Other columns are ignored.
    """
    shared = _shared(docs, ranks)

    def run(batches):
        encoder = Encoder(shared.value, pattern)
        for batch in batches:
            found = []
            for texts in _groups(t.as_py() or "" for t in batch.column(1)):
                for ids in encoder.encode_all(texts):
                    if digests:
                        found.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(encoder.decode(ids)).hexdigest()))
                    else:
                        found.append((len(ids) // 4, np.frombuffer(ids, "<u4").astype(np.int32)))
            kinds = (pa.int64(), pa.string(), pa.string()) if digests else (pa.int64(), pa.list_(pa.int32()))
            columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)]
            names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids",))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    out = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, out)


def decode(tokens: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, bytes) of rows with doc_id and ids; null ids decode to no bytes, ids outside the vocabulary fail."""
    shared = _shared(tokens, ranks)

    def run(batches):
        encoder = Encoder(shared.value, "")
        for batch in batches:
            data = [encoder.decode(np.array(ids.as_py() or [], "<u4").tobytes()) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "bytes"])

    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, bytes binary")
