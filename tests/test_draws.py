"""Permutations and bootstrap weights drawn by hash."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus import plans
from gradus.functions import draws
from gradus.operators import rating, rollup
from gradus.plans.tables import scored


def permuted(spark, rows):
    """Rows of (x, total, key) -> the places, in order."""
    df = spark.createDataFrame(rows, "x long, total long, key long")
    return draws.permuted(df, "x", "total", "key", "ix")


def test_every_number_once(spark):
    totals = [1, 2, 3, 5, 7, 40, 41, 99, 100, 101, 1000, 4097]
    rows = [(x, n, 123456789012345 * (n + 1)) for n in totals for x in range(n)]
    found = {}
    for r in permuted(spark, rows).collect():
        found.setdefault(r.total, []).append(r.ix)
    for n in totals:
        assert sorted(found[n]) == list(range(n))
        if n > 90:
            assert sum(a == b for a, b in enumerate(found[n])) < 12 and found[n] != sorted(found[n])


def test_large_totals_stay_whole(spark):
    total = (1 << 60) - 12345
    found = [r.ix for r in permuted(spark, [(x, total, k) for x in range(500) for k in (7, 1 << 59)]).collect()]
    assert len(set(found)) > 990 and min(found) >= 0 and max(found) < total
    high = np.array(found, float) / total
    assert 0.45 < high.mean() < 0.55 and (high > 0.9).any() and (high < 0.1).any()


def test_draws_are_even(spark):
    """Of the first tenth of many permutations every place has an equal share, and pairs of neighbours part."""
    rows = [(x, 100, k * 1152921504606846883 % (1 << 60)) for k in range(3000) for x in range(10)]
    found = permuted(spark, rows).collect()
    counts = np.array([Counter(r.ix for r in found)[i] for i in range(100)])
    assert ((counts - 300) ** 2 / 300).sum() < 150  # chi-square of 99 degrees
    gaps = Counter((b.ix - a.ix) % 100 for a, b in zip(found, found[1:], strict=False) if b.x)
    assert max(gaps.values()) < 27000 / 99 * 1.5


def test_as_sql(spark):
    rows = [(x, n, 987654321987654321 % (1 << 60) - n) for n in (1, 6, 77, 10**6, 10**13) for x in range(min(n, 300))]
    con = duckdb.connect()
    con.sql("CREATE TABLE t (x BIGINT, total BIGINT, key BIGINT)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    sql = draws.permuted_sql("p", "(SELECT x AS own, * FROM t)", "own", "x", "total", "key", "ix")
    want = con.sql(f"WITH RECURSIVE {sql} SELECT total, own, ix FROM p WHERE ix < total").fetchall()
    assert sorted(want) == sorted((r.total, r.x, r.ix) for r in permuted(spark, rows).collect())


def test_contests_without_replacement(spark):
    groups = spark.createDataFrame([("a", 30, 600), ("b", 2, 500)], "g string, n long, n_contests long")
    rows = rating.contests(groups, ["g"], 1, 4, 5).collect()
    a = [(r.run, r.item_ix, r.model_a, r.model_b) for r in rows if r.g == "a"]
    assert len(a) == len(set(a)) == 600  # of 30 * 4 * 10
    b = [(r.run, r.item_ix, r.model_a, r.model_b) for r in rows if r.g == "b"]
    assert len(b) == 500 and len(set(b)) <= 80  # with replacement: there are 2 * 4 * 10
    assert all(0 <= r.run < 4 and r.item_ix < 30 and 0 <= r.model_b < r.model_a < 5 for r in rows)


def test_poisson_weights(spark):
    rows = spark.range(400).select(draws.draw(3, "id").alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(999).cast("long"))).alias("b"))
    w = np.array([r.w for r in draws.poisson_weights(rows, "key", "b", "w").select("w").collect()]).reshape(400, 1000)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    for k, p in enumerate([0.3679, 0.3679, 0.1839, 0.0613]):
        assert abs((w == k).mean() - p) < 0.005
    # rows and bootstraps are independent of each other
    assert abs(np.corrcoef(w[:100])[np.triu_indices(100, 1)]).mean() < 0.05 and abs(np.corrcoef(w.T[:100])[np.triu_indices(100, 1)]).mean() < 0.06


@pytest.mark.parametrize("n", [300, 2000])
def test_intervals_as_by_plain_resampling(spark, n):
    rng = np.random.default_rng(n)
    values = rng.gamma(2.0, 10.0, n)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, v double")
    means = draws.resampled_means(df.withColumn("g", F.lit("x")), ["g"], ["id"], ["v"], 1000, 5)
    r = draws.intervals(means, ["g"], "v").first()
    plain = np.percentile([values[rng.integers(0, n, n)].mean() for _ in range(4000)], [2.5, 50, 97.5])
    width = plain[2] - plain[0]
    assert abs(r.low - plain[0]) < 0.1 * width and abs(r.mid - plain[1]) < 0.1 * width and abs(r.high - plain[2]) < 0.1 * width
    assert means.count() == 1000


def plain_draw(*key):
    return int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:15], 16)


@pytest.mark.parametrize("head", ["", "4156|1|2|", "x" * 50, "y" * 55, "z" * 61, "w" * 130])
@pytest.mark.parametrize("low", [0, 99_990, 10**9])
def test_draws_of_many_texts(head, low):
    numbers = np.arange(low, low + 10)
    assert draws.drawn(head.encode(), draws.digits(numbers)).tolist() == [int(hashlib.md5(f"{head}{i}".encode()).hexdigest()[:15], 16) for i in numbers]


def test_redrawn_as_one_by_one(spark):
    """As many draws as rows, from groups of several chunks and pieces, one row, null keys and null values."""
    rng = np.random.default_rng(5)
    sizes = {("a", 1): 137, ("b", 1): 1, ("b", None): 24}
    rows = [(g, r, 7 * i - 50, None if i % 9 == 4 else float(rng.gamma(2.0))) for (g, r), n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "g string, r int, id long, v double").repartition(5)
    found = {(x.g, x.r, x.bootstrap): x.v for x in rollup.redrawn_means(df, ["g", "r"], "id", "v", 110, 3, slices=7, chunk=10, piece=3).collect()}
    assert set(found) == {(*k, b) for k in sizes for b in range(110)}
    for (g, r), n in sizes.items():
        values = [x[3] for x in rows if x[:2] == (g, r)]
        for b in range(110):
            taken = [values[plain_draw(3, g, *([] if r is None else [r]), b, i) % n] for i in range(n)]
            assert found[g, r, b] == pytest.approx(np.mean([x for x in taken if x is not None]))


@pytest.mark.parametrize("n", [300, 2000])
def test_redrawn_intervals_as_by_plain_resampling(spark, n):
    values = np.random.default_rng(n).gamma(2.0, 10.0, n)
    df = spark.createDataFrame([("x", i, float(v)) for i, v in enumerate(values)], "g string, id long, v double")
    r = rollup.percentile_interval(df, ["g"], "id", "v", 1000, 5).first()
    rng = np.random.default_rng(n + 1)
    plain = np.percentile([values[rng.integers(0, n, n)].mean() for _ in range(4000)], [2.5, 50, 97.5])
    width = plain[2] - plain[0]
    assert abs(r.low - plain[0]) < 0.1 * width and abs(r.mid - plain[1]) < 0.1 * width and abs(r.high - plain[2]) < 0.1 * width


def test_interval_draws_as_many_as_there_are(spark):
    """In each of a thousand resamples every item of a model and run is replaced by one drawn from all of them."""
    sf = "/root/testdata/sf0.001"
    rows = scored(spark, sf).where("model = 1 AND run = 2").orderBy("item_id").collect()
    values, n = np.array([r.correct for r in rows]), len(rows)
    draw = lambda b, i: int(hashlib.md5(f"4156|1|2|{b}|{i}".encode()).hexdigest()[:15], 16)
    means = [values[[draw(b, i) % n for i in range(n)]].mean() for b in range(1000)]
    found = [r for r in plans.queries()["bootstrap_interval"](spark, sf).collect() if (r.model, r.run) == (1, 2)]
    assert [(r.low, r.mid, r.high) for r in found] == [tuple(np.round(np.percentile(means, [2.5, 50, 97.5]), 6))]
