import hashlib
import random
from collections import Counter, defaultdict
from functools import cache
from pathlib import Path

import numpy as np
import pytest
from public_tokenizers import PATTERN, path
from samples import EDGES

from gradus.llm import alignment, queries

FILES = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")
ODD = ["  two  spaces", "tabs\tand\nlines\r\n", "<|endoftext|> and <s> </s> <unk> <0x41>", "é ü 😀 漢字 ไทย", "▁ lower block", "\x00 nul", "a" * 5000, " " * 300, "word", "ﬁ ligature ½"]


@cache
def tokenizers():
    return alignment.ByteLevel(Path(FILES[0]).read_bytes()), alignment.Pieces(Path(FILES[1]).read_bytes())


def spans(ids, table):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(table[i])))
        at += len(table[i])
    return out


def plain(texts):
    """Every row's columns, token by token."""
    a, b = tokenizers()
    linked, counts = [], Counter()
    for text in texts:
        x, y = ([], []) if not text else (a.tokenizer.encode(" " + text, add_special_tokens=False).ids, b.model.encode(text))
        want = b" " + (text or "").encode()
        if b"".join(a.bytes[i] for i in x) != want or b"".join(b.bytes[i] for i in y) != want:
            x, y = [], []
        sx, sy = spans(x, a.bytes), spans(y, b.bytes)
        pairs, j0 = [], 0
        for i, (lo, hi) in enumerate(sx):
            while j0 < len(sy) and sy[j0][1] <= lo:
                j0 += 1
            j = j0
            while j < len(sy) and sy[j][0] < hi:
                pairs.append((x[i], y[j]))
                j += 1
        cut = sorted({e for _, e in sx} & {e for _, e in sy})
        of = {e: k for k, e in enumerate(cut)}
        groups = [([], []) for _ in cut]
        for side, ids, span in ((0, x, sx), (1, y, sy)):
            k = 0
            for t, (_, e) in zip(ids, span, strict=True):
                groups[k][side].append(str(t))
                k = of[e] + 1 if e in of else k
        groups = ["|".join(",".join(side) for side in sides) for sides in groups]
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        linked.append((len(x), len(y), len(groups), pairs, digest))
        counts.update(pairs)
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(na, nb, g, len(p), sum(counts[q] == most[q[1]] for q in p), sum(counts[q] for q in p), d) for na, nb, g, p, d in linked], counts


def columns(rows):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows)


@pytest.mark.parametrize(("links", "pattern"), [(1 << 21, None), (50, PATTERN)])
def test_odd_texts(docs_of, links, pattern):
    texts = [*EDGES, *ODD, *ODD[:3], None]
    ids = [None if i == 4 else i // 2 for i in range(len(texts))]  # every id twice, one is null
    want, _ = plain(texts)
    got = alignment.align(docs_of([(i, t, "en", "s") for i, t in zip(ids, texts, strict=True)]), *FILES, pattern, links=links).collect()
    assert columns(got) == sorted((-1 if i is None else i, *w) for i, w in zip(ids, want, strict=True))
    assert sum(w[0] > 0 for w in want) > 10 and any(w[0] == 0 and t for w, t in zip(want, texts, strict=True) if t is not None)


def test_pair_counts(docs_of):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "beta", "über", "99%", "x-y"]) for _ in range(rng.randint(0, 40))) for _ in range(80)]
    _, counts = plain(texts)
    rows = alignment.vocabulary_links(docs_of([(i, t, "en", "s") for i, t in enumerate(texts)]), *FILES, links=200).collect()
    assert {(r.a_id, r.b_id): r.n_links for r in rows} == counts
    docs = Counter(p for t in texts for p in plain([t])[1])
    assert {(r.a_id, r.b_id): r.n_docs for r in rows} == docs
    assert {r.b_id for r in rows if r.best} == {r.b_id for r in rows}


def test_faster_encoder():
    slow, fast = (alignment.ByteLevel(Path(FILES[0]).read_bytes(), p) for p in (None, PATTERN))
    assert slow.fast is None and fast.fast is not None
    rng = random.Random(5)
    letters = "ab  \n\t'sÉß漢字😀1290.,-<|>_Ġ\x00\x85\u3000"
    texts = [t for t in [*EDGES, *ODD] if t] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 200))) for _ in range(500)]
    assert [list(x) for x in slow.encode(texts)] == [list(x) for x in fast.encode(texts)]


def test_empty(docs_of):
    assert alignment.align(docs_of([]), *FILES).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_bitmaps(seed):
    rng = np.random.default_rng(seed)
    sets = [np.unique(rng.integers(0, rng.choice([20, 3000, 65536]), rng.choice([1, 5, 900, 20000]))) for _ in range(4)]
    maps = [alignment.bitmap(s) for s in sets]
    for s, m in zip(sets, maps, strict=True):
        assert alignment.numbers(m).tolist() == s.tolist() and alignment.popcount(m) == len(s)
    union = np.unique(np.concatenate(sets))
    assert alignment.numbers(alignment.merged(maps)).tolist() == union.tolist() and alignment.popcount(alignment.merged(maps)) == len(union)
    times = rng.integers(1, 40, len(union))
    planes = alignment.planes_of(union, times)
    assert sum(alignment.popcount(p) << k for k, p in enumerate(planes)) == times.sum()


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want, _ = plain([r.text for r in docs])
    df = queries.QUERIES["op11_alignment"](spark, "/root/testdata/sf0.001")
    assert all(k == ("string" if c == "groups_sha256" else "bigint") for c, k in df.dtypes)
    assert columns(df.collect()) == sorted((r.doc_id, *w) for r, w in zip(docs, want, strict=True))
