import hashlib
import random

import duckdb
import pytest

from gradus.llm import queries, repeats


def plain(rows, window=20):
    """(doc_id, n_words, words that stay) of rows (doc_id, text), by every window's words in order."""
    tie = {t: i for i, t in enumerate(sorted({t or "" for _, t in rows}))}
    docs = sorted({(i is None, i or 0, tie[t or ""], t or "") for i, t in rows})
    seen, out = {}, {}
    for d in docs:
        words = d[3].encode().split()
        gone = set()
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone |= set(range(s, s + window))
            else:
                seen[key] = d
        out[d] = [w for i, w in enumerate(words) if i not in gone]
    return sorted((i is None, i or 0, len((t or "").encode().split()), b" ".join(out[(i is None, i or 0, tie[t or ""], t or "")]).decode()) for i, t in rows)


def found(docs, **options):
    rows = repeats.without_repeats(docs, **options).collect()
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.text) for r in rows), rows


def corpus(rng, n=60, vocabulary=12):
    """Texts with shared passages, edits, overlapping repeats within a text, and few different words."""
    words = [f"w{i}" for i in range(vocabulary)]
    passages = [[rng.choice(words) for _ in range(rng.randint(15, 60))] for _ in range(8)]
    texts = []
    for _ in range(n):
        text = []
        for _ in range(rng.randint(0, 5)):
            part = rng.choice([list(rng.choice(passages)), [rng.choice(words) for _ in range(rng.randint(1, 40))], [rng.choice(words)] * rng.randint(1, 50)])
            if rng.random() < 0.4:
                part[rng.randrange(len(part))] = "edited"
            text += part[rng.randint(0, 3) :]
        texts.append(rng.choice([" ", "\n", "\t \v"]).join(text))
    return texts


@pytest.mark.parametrize(("seed", "pieces", "window", "anchor"), [(1, 2048, 20, 6), (2, 2, 20, 6), (3, 1, 8, 3), (4, 3, 20, 20)])
def test_against_all_windows(docs_of, seed, pieces, window, anchor):
    rng = random.Random(seed)
    rows = [(i * 7 - 100, t) for i, t in enumerate(corpus(rng))]
    got, _ = found(docs_of([(*r, "en", "s") for r in rows]), window=window, anchor=anchor, pieces=pieces)
    want = plain(rows, window)
    assert got == want and any(len(t.split()) < n for _, _, n, t in want)


def test_repeated_rows_and_null_ids(docs_of):
    long = " ".join(f"a{i}" for i in range(40))
    rows = [(3, long), (3, long), (9, long + " end"), (None, long), (None, None), (4, None), (5, "short"), (6, "short"), (1 << 62, "far " + long), (-(1 << 62), "x " + long)]
    got, _ = found(docs_of([(*r, "en", "s") for r in rows]))
    assert got == plain(rows)
    # of two texts with one id the hash of the text decides which is earlier
    two = [(1, "p " + long), (1, "q " + long)]
    _, rows = found(docs_of([(*r, "en", "s") for r in two]))
    assert sorted(r.n_words - len(r.text.split()) for r in rows) == [0, 40]


def test_factors_are_copies_of_earlier_words(docs_of):
    texts = corpus(random.Random(8), 40, 500)
    words = [t.split() for t in texts]
    rows = repeats.factored(docs_of([(i, t, "en", "s") for i, t in enumerate(texts)])).collect()
    assert rows
    for r in rows:
        assert r.length >= 20 and (r.source_id, r.source_start) < (r.doc_id, r.start)
        assert words[r.doc_id][r.start : r.start + r.length] == words[r.source_id][r.source_start : r.source_start + r.length]
    # most of what goes lies in factors: boundaries add little
    gone = repeats.without_repeats(docs_of([(i, t, "en", "s") for i, t in enumerate(texts)])).collect()
    covered = {(r.doc_id, w) for r in rows for w in range(r.start, r.start + r.length)}
    assert len(covered) <= sum(r.n_removed for r in gone) <= 1.3 * len(covered)


def test_long_word_and_long_text(docs_of):
    texts = ["x" * (3 << 20) + " " + " ".join(f"b{i % 977}" for i in range(300000)), " ".join(f"b{i % 977}" for i in range(50, 400))]
    got, _ = found(docs_of([(i, t, "en", "s") for i, t in enumerate(texts)]))
    assert [(g[2], len(g[3].split())) for g in got] == [(300001, 1 + 977 + 19), (350, 0)] or got == plain(list(enumerate(texts)))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_beside_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    want = con.sql(queries.ORACLE["op13_repeats"])
    df = queries.QUERIES["op13_repeats"](spark, f"/root/testdata/{sf}")
    got = sorted(tuple(r) for r in df.select(want.columns).collect())
    assert got == sorted(want.fetchall()) and sum(r[2] for r in got)
    assert all(r[3] == hashlib.sha256(b"").hexdigest() for r in got if r[1] == r[2])
