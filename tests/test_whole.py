"""Queries without SQL that must cover all of their rows."""

from pyspark.sql import functions as F

from gradus import plans
from gradus.operators import rating as operators
from gradus.plans import rating

SF = "/root/testdata/sf0.001"
QUERIES = plans.queries()


def test_lsum_scores_every_reference(spark):
    pairs = lambda name: sorted(tuple(r) for r in QUERIES[name](spark, SF).select("item_id", "ref_ix").collect())
    found = pairs("rouge_lsum")
    assert {ref_ix for _, ref_ix in found} == {0, 1}
    assert found == pairs("rouge_l")


def test_contests_of_every_bootstrap(spark):
    by = ["bootstrap", *rating.LEVELS]
    rows = rating.contests(spark, SF)
    found = rows.groupBy(*by).agg(F.count("*").alias("n_contests"), F.countDistinct("place").alias("places")).collect()
    want = {tuple(r[c] for c in rating.LEVELS): r.n_contests for r in QUERIES["contest_allocation"](spark, SF).collect()}
    assert {tuple(r[c] for c in by): r.n_contests for r in found} == {(b, *k): n for b in range(30) for k, n in want.items()}
    assert sum(want.values()) >= 20_000 and all(r.places == r.n_contests for r in found)
    assert {r.bootstrap for r in QUERIES["rating_elo"](spark, SF).collect()} == set(range(30))
    assert [r.n for r in QUERIES["rating_summary"](spark, SF).collect()] == [30] * 5


def test_contests_without_replacement(spark):
    """A group with enough contests draws none twice; one without enough draws as many as asked."""
    groups = spark.createDataFrame([("a", 50, 300), ("b", 1, 100)], "g string, n long, n_contests long")
    found = operators.contests(groups, ["g"], 1, 4, 3).collect()
    of_a = {(r.run, r.item_ix, r.model_a, r.model_b) for r in found if r.g == "a"}
    assert len(of_a) == sum(r.g == "a" for r in found) == 300 and sum(r.g == "b" for r in found) == 100
    assert all(r.model_a > r.model_b and r.item_ix < 50 for r in found)


def test_elo_by_hand(spark):
    rows = spark.createDataFrame([(0, "a", 1, 0, 1.0), (0, "b", 2, 1, 0.5), (0, "c", 0, 2, 0.0)], "b int, place string, model_a int, model_b int, outcome double")
    found = {r.model: r.rating for r in operators.elo(rows.repartition(3), ["b"], "place", k=4.0).collect()}
    want = dict.fromkeys(range(3), 1000.0)
    for i, (x, y, result) in enumerate([(1, 0, 1.0), (2, 1, 0.5), (0, 2, 0.0)]):
        move = 4.0 * (1 - i / 3) * (result - 1 / (1 + 10 ** ((want[y] - want[x]) / 400)))
        want[x], want[y] = want[x] + move, want[y] - move
    assert found == want
