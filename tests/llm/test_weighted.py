import hashlib
from collections import Counter

import numpy as np

from gradus.llm import weighted


def jaccard(a, b):
    a, b = (Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (a.lower().split(), b.lower().split()))
    return sum((a & b).values()) / sum((a | b).values())


def test_collision_rate_is_generalised_jaccard():
    rng, sampler = np.random.default_rng(1), weighted.Sampler(512)
    for _ in range(20):
        words = [f"w{x}" for x in rng.integers(0, 9, 80)]
        a, b = " ".join(words * 3), " ".join([*words, *words[:40], *(f"v{x}" for x in rng.integers(0, 9, 60))])
        assert abs(weighted.likeness(sampler.fingerprint(a), sampler.fingerprint(b)) - jaccard(a, b)) < 0.1
    assert weighted.likeness(sampler.fingerprint("A b C d e f"), sampler.fingerprint("a B c D E f")) == 1


def test_next_and_edit(docs_of):
    texts = {i: " ".join(f"w{i}{j}é" for j in range(i % 7 * 20)) for i in range(0, 300, 3)}
    docs = docs_of([(i, t, "en", "s") for i, t in texts.items()]).repartition(5)
    found = {r.doc_id: r for r in weighted.compare_edited(docs, 64).collect()}
    ids = sorted(texts)
    sampler = weighted.Sampler(64)
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        half = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - half] + texts[j][:half]
        r = found[i]
        prints = [sampler.fingerprint(x) for x in (texts[i], edited, texts[j])]
        assert r.n_chars == len(texts[i]) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == tuple(map(weighted.to_text, prints[:2]))
        assert (r.near_edited, r.near_next) == (weighted.likeness(*prints[:2]), weighted.likeness(prints[0], prints[2]))


def test_single_row_follows_itself(docs_of):
    (r,) = weighted.compare_edited(docs_of(["one two three four five six"]), 16).collect()
    assert r.near_next == 1.0


def test_bucket_search():
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    bounds = [-5, 0, 3, 4, 10, 11, 90]
    rows = SparkSession.getActiveSession().range(-9, 100).select("id", weighted._bucket(F.col("id"), bounds).alias("b")).collect()
    assert all(r.b == sum(x <= r.id for x in bounds) for r in rows)


def test_likeness_at_every_number_of_terms():
    """Draws that terms share don't move the mean: 200 to 20,000 terms, several thousand samples."""
    rng = np.random.default_rng(7)
    for n in (200, 2_000, 20_000):
        found, want = [], []
        for seed in range(4):
            sampler, words = weighted.Sampler(512, seed=seed), [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
            a, b = " ".join(words), " ".join([*words[: n * 3 // 4], *(f"v{x}" for x in rng.integers(0, 1 << 40, n // 4))])
            found.append(weighted.likeness(sampler.fingerprint(a), sampler.fingerprint(b)))
            want.append(jaccard(a, b))
        assert abs(np.mean(found) - np.mean(want)) < 0.04


def test_hot_and_null_ids(docs_of):
    """Ids that most rows share are cut by their texts; every row still finds the next one."""
    rows = [(None, f"null {i} a b c d e", "en", "s") for i in range(150)] + [(7, f"hot {i} a b c d e", "en", "s") for i in range(150)]
    rows += [(i, f"other {i} a b c d e", "en", "s") for i in range(8, 60)] + [(7, "same text of one id", "en", "s")] * 20
    docs = docs_of(rows).repartition(6)
    dealt = weighted.with_next(docs).select("bucket", "copy", "doc_id").where("copy = 0").groupBy("bucket").count().collect()
    assert sum(r["count"] for r in dealt) == len(rows) and max(r["count"] for r in dealt) < 150
    found = weighted.compare_edited(docs, 16).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
    # in order of id and hash of the text, the first half of the next text ends each edited one
    keyed = docs.selectExpr("doc_id", "text", "xxhash64(text) AS tie").collect()
    order = sorted(keyed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.tie))
    want = Counter((a.doc_id, hashlib.sha256(weighted.edit(a.text, b.text).encode()).hexdigest()) for a, b in zip(order, order[1:] + order[:1], strict=True))
    assert Counter((r.doc_id, r.edited_sha256) for r in found) == want
