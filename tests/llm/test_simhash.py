import random

import numpy as np
import pytest
import xxhash

from gradus.llm import simhash
from gradus.llm.components import connected_components


def plain(text, k=3, seed=42):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(items, linked):
    root = list(range(len(items)))
    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def near_group(rng, centre, n, flips=2):
    out = set()
    while len(out) < n:
        x = centre
        for b in rng.sample(range(64), rng.randint(0, flips)):
            x ^= 1 << b
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("text", ["", " ", "One", "a B", "a b c", "A b\x0bc\x1cd e é É", "x " * 70000])
def test_fingerprint(text):
    assert simhash.simhash(text.encode()) == plain(text)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5, 7])
def test_bit_sliced_comparison(radius):
    rng = random.Random(radius)
    fps = near_group(rng, rng.getrandbits(64), 90, 5) + [rng.getrandbits(64) for _ in range(60)]
    a, b = np.array(fps[:77], np.uint64), np.array(fps[40:], np.uint64)
    found = set(zip(*map(list, (x.tolist() for x in simhash.within(a, b, radius))), strict=True))
    assert found == {(i, j) for i in range(len(a)) for j in range(len(b)) if (int(a[i]) ^ int(b[j])).bit_count() <= radius}


@pytest.mark.parametrize("bucket_rows", [4096, 5, 1])
def test_links_lose_nothing(spark, bucket_rows):
    rng = random.Random(4)
    fps = sorted({f for _ in range(4) for f in near_group(rng, rng.getrandbits(64), 60, 3)} | {rng.getrandbits(64) for _ in range(60)})
    rows = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long").repartition(6)
    pairs = simhash.links(rows, 3, bucket_rows)
    found = {r.node % (1 << 64): r.root % (1 << 64) for r in connected_components(pairs).collect()}
    expected = classes(fps, lambda x, y: (x ^ y).bit_count() <= 3)
    groups = lambda of: {frozenset(k for k in range(len(fps)) if of(k) == v) for v in {of(k) for k in range(len(fps))}}
    assert groups(lambda k: found.get(fps[k], fps[k])) == groups(lambda k: expected[k])


def test_groups(docs_of):
    base = " ".join(f"word{i}" for i in range(300))
    texts = [base, base.upper(), base + " more", "", None, " \n", "quite another text", *(base + f" extra{i}" for i in range(30))]
    rows = {r.doc_id: r.component_id for r in simhash.groups(docs_of(texts)).collect()}
    fps = [plain(t) for t in texts]
    assert [rows[i] for i in range(len(texts))] == classes(fps, lambda x, y: (x ^ y).bit_count() <= 3)
    kept = simhash.first_of_each_group(docs_of(texts)).select("doc_id", "fp").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(rows.values())) and {r.fp for r in kept} == {"x"}


def close(x, y, radius, confirm):
    return (x[0] ^ y[0]).bit_count() <= radius and (x[0] ^ y[0]).bit_count() + (x[1] ^ y[1]).bit_count() <= confirm


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("bucket_rows", [4096, 30, 3])
def test_wide_radius_with_second_fingerprints(spark, bucket_rows):
    """Pairs that only the first or only the second fingerprint has close don't link; nothing else is lost, equal first ones included."""
    rng = random.Random(5)
    centre, other = rng.getrandbits(64), rng.getrandbits(64)
    firsts = near_group(rng, centre, 60, 8) + [centre] * 20 + [rng.getrandbits(64) for _ in range(30)]
    rows = [(f, near_group(rng, other, 1, 12)[0] if rng.random() < 0.7 else rng.getrandbits(64)) for f in firsts]
    table = spark.createDataFrame([(i, signed(a), signed(b)) for i, (a, b) in enumerate(rows)], "id long, fp long, fp2 long").repartition(5)
    found = {r.node: r.root for r in connected_components(simhash.links(table, 6, bucket_rows, 20)).collect()}
    want = classes(rows, lambda x, y: close(x, y, 6, 20))
    assert [found.get(i, i) for i in range(len(rows))] == want and len(set(want)) > 20


@pytest.mark.parametrize("radius", [3, 6])
def test_buckets_are_bounded(spark, radius):
    """However many fingerprints fall together, a task compares two groups at most, and every close pair meets somewhere."""
    rng = random.Random(radius)
    fps = near_group(rng, rng.getrandbits(64), 150, 2) + [0] * 40
    table = spark.createDataFrame([(i, signed(f), i) for i, f in enumerate(fps)], "id long, fp long, fp2 long").repartition(4)
    sizes, met = {}, set()
    for r in simhash.buckets(table, radius, 20).collect():
        sizes.setdefault((r.mask, r.k, r.part), []).append(r.id)
    for ids in sizes.values():
        assert len(ids) <= 2 * 2 * 20  # two groups, each of about 20 by hash
        met |= {(a, b) for a in ids for b in ids if a < b}
    near = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if (fps[a] ^ fps[b]).bit_count() <= radius}
    assert near <= met


def test_members_of_a_class_link_for_themselves(docs_of, spark, monkeypatch):
    """Texts 1 and 2 share the first fingerprint, and only 2, of the larger second one, is close to 3; 4 shares it without being confirmed."""
    prints = {"a": (5, 1), "b": (5, 0xFF), "c": (5 ^ 3, 0xFFF), "d": (5, (1 << 64) - 1)}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: spark.createDataFrame([(r.doc_id, *map(signed, prints[r.text])) for r in docs.collect()], "doc_id long, fp long, fp2 long"))
    found = {r.doc_id: r.component_id for r in simhash.groups(docs_of([(1, "a", "en", "s"), (2, "b", "en", "s"), (3, "c", "en", "s"), (4, "d", "en", "s")]), radius=3, confirm=7).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(50)] + [(100, x) for x in range(101, 300)] + [(rng.randint(400, 500), rng.randint(400, 500)) for _ in range(60)]
    edges += [(7, 7), (None, 3), (3, None)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            todo += (new := near[todo.pop()] - seen)
            seen |= new
        assert found[node] == min(seen)
    assert set(found) == set(near)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
