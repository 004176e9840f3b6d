import random
from collections import defaultdict

import pytest

from gradus.llm import mixing


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        level = left / sum(w[n] for n in open_)
        over = [n for n in open_ if level * w[n] > most * sizes[n]]
        if not over:
            return out | {n: level * w[n] for n in open_}
        for n in over:
            out[n] = float(most * sizes[n])
            left -= out[n]
            open_.remove(n)
    return out


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 5, "b": 1000, None: 3}, {"a": 0, "b": 0}, {"x": 1, "y": 1, "z": 100, "é": 7, "Z": 50}, {}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert found == pytest.approx(plain_targets(sizes))


def test_fill_hits_the_budget():
    rng = random.Random(3)
    for _ in range(200):
        sizes = rng.sample(range(1, 400), rng.randint(1, 40))
        counts = [rng.randint(1, 9) for _ in sizes]
        total = sum(s * c for s, c in zip(sizes, counts, strict=True))
        budget = rng.randint(0, total + 5)
        taken = mixing.fill(sizes, counts, budget, rng.randint(0, 9), reach=rng.choice([64, 4096, 1 << 17]))
        assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
        assert abs(sum(s * t for s, t in zip(sizes, taken, strict=True)) - budget) <= max(sizes)
    assert sum(s * t for s, t in zip([3, 5, 7], mixing.fill([3, 5, 7], [10, 10, 10], 101), strict=True)) == 101


def test_mix(spark, docs_of):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 5, 5, rng.randint(1, 60)])), "en", rng.choice(["a", "a", "a", "b", "c", None])) for i in range(4000)]
    rows += [(5000 + i, "same size here", "en", "hot") for i in range(3000)]
    docs = docs_of(rows)
    found = {r.doc_id: r for r in mixing.mix(docs).collect()}
    again = {r.doc_id: r for r in mixing.mix(docs.repartition(7)).collect()}
    assert found == again and len(found) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, text, _, source in rows:
        n = len(text.split())
        assert found[i]["size"] == n and found[i].taken in {0, n, 2 * n, 3 * n}
        sizes[source] += n
        taken[source] += found[i].taken
    targets = plain_targets(sizes)
    for i, _, _, source in rows[:50]:
        assert found[i].source_size == sizes[source] and found[i].target == pytest.approx(targets[source])
    assert all(abs(taken[s] - targets[s]) <= 3 for s in sizes)
    copies = mixing.mixed(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in copies} == {i: r.taken // r["size"] for i, r in found.items() if r.taken}
