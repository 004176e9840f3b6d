import math
import random

import duckdb
import numpy as np
import pytest

from gradus.llm import negatives, queries


def plain(rows, every=100, k=5):
    """All anchors against all rows, with Python's whole numbers."""
    by_id = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = ((label + 1) % 10 if i % 7 == 0 else label, len(v), [math.floor(256.0 * float(np.float32(x))) for x in v])
        by_id[i] = min(by_id.get(i, row), row)
    out = []
    for a in (i for i in by_id if i % every == 0):
        label, size, v = by_id[a]
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, m) for i, (m, n, w) in by_id.items() if i != a and n == size)
        for s, p, _ in [x for x in scored if x[2] == label][:k]:
            window = [x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s]
            out += [(a, p, rank, i, -s, -t) for rank, (t, i, _) in enumerate(window[:k], 1)]
    return sorted(out)


def run(spark, rows, **options):
    extra = [(*r, 1, "x", "y", "z", 2, "t", 3) for r in rows]
    kinds = "vec_id long, embedding array<float>, label int, rank int, tile string, x string, copy string, n int, cuts string, size int"
    found = negatives.mine(spark.createDataFrame(extra, kinds), **options).collect()
    return sorted(tuple(r) for r in found)


def vectors(seed, n, size, spread=1.0, labels=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 1, (4, size))
    x = centre[rng.integers(0, 4, n)] + spread * rng.normal(0, 1, (n, size))
    return [(int(i), [float(np.float32(c)) for c in v], int(rng.integers(0, labels))) for i, v in enumerate(x)]


@pytest.mark.parametrize(("size", "spread", "options"), [(16, 0.3, {}), (3, 1.0, {"tile_rows": 40, "leaf": 4}), (64, 0.05, {"tile_rows": 64, "leaf": 8, "block": 20})])
def test_against_all_rows(spark, size, spread, options):
    rows = vectors(size, 600, size, spread)
    want = plain(rows, 10, 4)
    assert want and run(spark, rows, every=10, k=4, **options) == want


def test_ties_and_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.1, 0.2]), rng.choice([0.1, 0.3])], rng.randint(0, 2)) for i in range(400)]  # few different vectors
    rows += [(1000 + i, [0.1, 0.1], 1) for i in range(300)]  # one very common vector
    rows += [(5, [9.0, 9.0], 0), (5, [9.0, 9.0], 0), (20, [0.2, 0.3], None), (None, [0.2, 0.2], 1), (30, None, 1), (31, [None, 0.1], 1), (32, [float("nan"), 0.1], 1)]
    rows += [(33, [float("inf"), 0.1], 1), (-40, [0.3, 0.3], 2), (41, [], 1), (200, [], 1), (300, [], 2), (42, [0.5], 1), (400, [0.4], 1), (401, [0.35], 0), (-14, [0.0, 0.0], 4)]
    want = plain(rows, 20, 5)
    assert run(spark, rows, every=20, tile_rows=32, leaf=8) == want and want


def test_large_components(spark):
    rows = [(i, [3.0e6 * (i % 5 + 1), -2.5e6 * (i % 3), 7.0e6], i % 2) for i in range(1, 60)]
    assert run(spark, rows, every=10) == plain(rows, 10)


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(100, [0.5], 1)]) == []


def test_boxes_bound_scores_and_queue_prunes():
    rng = np.random.default_rng(4)
    rows = np.floor(rng.normal(0, 90, (3000, 4)))
    tree = negatives.Tree(np.arange(3000), rows, leaf=16, fanout=4)
    anchors = np.floor(rng.normal(0, 90, (20, 4)))
    least, most = tree.bounds(anchors)
    scores = anchors @ tree.rows.T
    for leaf in range(tree.leaves):
        part = scores[:, leaf * 16 : leaf * 16 + 16]
        assert (part.min(axis=1) >= least[:, leaf]).all() and (part.max(axis=1) <= most[:, leaf]).all()
    for a in range(20):
        search = negatives.Search(tree, anchors[a], least[a].tolist(), most[a].tolist())
        want = sorted((-s, i) for s, i in zip(scores[a].tolist(), tree.ids.tolist(), strict=True))
        assert search.best(5, -1) == [(int(-s), i) for s, i in want[:5]]
        assert len(search.scored) < tree.leaves / 4
        high = -want[40][0]
        assert search.best(5, -1, 0.8 * high, high) == [(int(-s), i) for s, i in want if 0.8 * high <= -s <= high][:5]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_beside_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{sf}/embeddings.parquet'")
    want = con.sql(queries.ORACLE["op12_negatives"])
    df = queries.QUERIES["op12_negatives"](spark, f"/root/testdata/{sf}")
    assert {c: k for c, k in df.dtypes} == {c: "int" if c == "rank" else "bigint" for c in want.columns}
    got = sorted(tuple(r) for r in df.select(want.columns).collect())
    assert got and got == sorted(want.fetchall())
