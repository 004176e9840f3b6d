"""Contests, win rates and ratings."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradus.functions.draws import RANGE, draw_sql, permuted_sql
from gradus.operators import rating, rollup
from gradus.operators.numbering import numbered
from gradus.plans.registry import Registry
from gradus.plans.tables import MODELS, RUNS, items, read, scored, sql

REGISTRY = Registry()
query = REGISTRY.query
SEED = 42
BOOTSTRAPS, TOTAL, LEVELS = 30, 20_000, ["lang", "competency", "task"]
PAIRS = MODELS * (MODELS - 1) // 2


def recursive(*parts):
    return sql(*parts).replace("WITH ", "WITH RECURSIVE ", 1)


KEYS = ["bootstrap", *LEVELS]

_ALLOC = f"""SELECT lang, competency, task, ceil(ceil(ceil({TOTAL} / nl::DOUBLE) / nc) / nt)::BIGINT AS n_contests FROM (SELECT DISTINCT lang, competency, task FROM items)
    JOIN (SELECT lang, count(DISTINCT competency) AS nc FROM items GROUP BY 1) USING (lang) JOIN (SELECT lang, competency, count(DISTINCT task) AS nt FROM items GROUP BY ALL) USING (lang, competency)
    CROSS JOIN (SELECT count(DISTINCT lang) AS nl FROM items)"""
_DRAW = draw_sql(str(SEED), "bootstrap", "lang", "competency", "task", "{c}")
_SCORES = "sc AS (SELECT item_id, run, model, correct FROM scored WHERE NOT (model = 2 AND run = 3 AND item_id % 5 = 0))"
_BASE = (
    "ix AS (SELECT lang, competency, task, item_id, row_number() OVER (PARTITION BY lang, competency, task ORDER BY item_id) - 1 AS item_ix FROM items)",
    f"al AS ({_ALLOC})",
    f"g AS (SELECT bootstrap, lang, competency, task, n_contests, n * {RUNS * PAIRS} AS total FROM al JOIN (SELECT lang, competency, task, count(*) AS n FROM items GROUP BY ALL) USING (lang, competency, task), (SELECT unnest(range(0, {BOOTSTRAPS})) AS bootstrap))",
    f"gk AS (SELECT *, {draw_sql(str(SEED), 'bootstrap', 'lang', 'competency', 'task')} AS key, unnest(range(0, n_contests)) AS contest FROM g)",
    permuted_sql("pm", "(SELECT * FROM gk WHERE n_contests <= total)", "bootstrap, lang, competency, task", "contest", "total", "key", "ix"),
    f"""k AS (SELECT bootstrap, lang, competency, task, contest, {_DRAW.format(c="contest")} % total AS ix FROM gk WHERE n_contests > total
    UNION ALL SELECT bootstrap, lang, competency, task, contest, ix FROM pm WHERE ix < total)""",
    f"""d AS (SELECT *, p - a * (a - 1) // 2 AS b FROM (SELECT *, floor((1 + sqrt(1 + 8.0::DOUBLE * p)) / 2)::BIGINT AS a FROM
    (SELECT bootstrap, lang, competency, task, contest, ix % {RUNS} AS run, ix // {RUNS} // {PAIRS} AS item_ix, ix // {RUNS} % {PAIRS} AS p FROM k)))""",
    _SCORES,
)
_O = (
    *_BASE,
    """o AS (SELECT d.bootstrap, d.lang, d.competency, d.task, contest, d.a AS model_a, d.b AS model_b, x.correct IS NULL OR y.correct IS NULL AS missing,
    CASE WHEN abs(coalesce(x.correct, -1) - coalesce(y.correct, -1)) <= 1e-4 + 1e-5 * abs(coalesce(y.correct, -1)) THEN 0.5::DOUBLE WHEN coalesce(x.correct, -1) > coalesce(y.correct, -1) THEN 1 ELSE 0 END AS outcome
    FROM d JOIN ix i ON i.lang = d.lang AND i.competency = d.competency AND i.task = d.task AND i.item_ix = d.item_ix
    LEFT JOIN sc x ON x.item_id = i.item_id AND x.model = d.a AND x.run = d.run LEFT JOIN sc y ON y.item_id = i.item_id AND y.model = d.b AND y.run = d.run)""",
)
_W = "w AS (SELECT bootstrap, model, avg(won::INT)::DOUBLE AS win_rate, count(*) AS n FROM (SELECT bootstrap, model_a AS model, outcome = 1 AS won FROM o UNION ALL SELECT bootstrap, model_b, outcome = 0 FROM o) GROUP BY ALL)"


def drawn(spark, sf_dir):
    """Contests of every bootstrap, split evenly over languages, competencies and tasks, with their items."""
    known = numbered(items(spark, sf_dir).select(*LEVELS, "item_id"), LEVELS, "item_id", "item_ix")
    groups = known.groupBy(*LEVELS).agg(F.count("*").alias("n")).join(rating.allocation(known, LEVELS, TOTAL), LEVELS)
    groups = groups.withColumn("bootstrap", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BOOTSTRAPS - 1).cast("long"))))
    return rating.contests(groups, KEYS, SEED, RUNS, MODELS).join(known, [*LEVELS, "item_ix"])


def with_scores(rows, scores, how="left"):
    """Both models' scores of each contest; a missing one is null."""
    a = scores.select("item_id", "run", F.col("model").alias("model_a"), F.col("score").cast("double").alias("x"))
    b = scores.select("item_id", "run", F.col("model").alias("model_b"), F.col("score").cast("double").alias("y"))
    return rows.join(a, ["item_id", "run", "model_a"], how).join(b, ["item_id", "run", "model_b"], how)


def contests(spark, sf_dir):
    """Contests with their outcome and a place that mixes the groups; a missing score is -1, and some of one model's are missing."""
    scores = scored(spark, sf_dir).where("NOT (model = 2 AND run = 3 AND item_id % 5 = 0)").withColumn("score", F.col("correct"))
    rows = with_scores(drawn(spark, sf_dir), scores)
    result = rating.outcome(F.coalesce("x", F.lit(-1.0)), F.coalesce("y", F.lit(-1.0))).alias("outcome")
    place = F.md5(F.concat_ws("|", F.lit("order"), F.lit(str(SEED)), *[F.col(c).cast("string") for c in (*KEYS, "contest")]))
    return rows.select(*KEYS, "contest", place.alias("place"), "model_a", "model_b", (F.col("x").isNull() | F.col("y").isNull()).alias("missing"), result)


@query(recursive(*_O, "SELECT bootstrap, lang, competency, task, contest, model_a, model_b, missing, outcome FROM o"), "outcome")
def contest_outcomes(spark, sf_dir):
    return contests(spark, sf_dir).drop("place")


@query(recursive(*_O, _W, "SELECT bootstrap, model, win_rate, n FROM w"), "win_rate")
def contest_win_rates(spark, sf_dir):
    return rating.win_rates(contests(spark, sf_dir), ["bootstrap"])


@query(recursive(*_O, "SELECT bootstrap, avg((outcome = 0.5)::INT)::DOUBLE AS tie_rate, avg(missing::INT)::DOUBLE AS missing_rate FROM o GROUP BY bootstrap"), "tie_rate missing_rate")
def contest_tie_rate(spark, sf_dir):
    """Ties, and contests in which either side has no score."""
    share = lambda c: F.avg(c.cast("int"))
    return contests(spark, sf_dir).groupBy("bootstrap").agg(share(F.col("outcome") == 0.5).alias("tie_rate"), share(F.col("missing")).alias("missing_rate"))


_HIT = f"({{d}} / {RANGE}.0::DOUBLE < {{p}} / 100)::INT"


@query(
    recursive(
        *_BASE,
        "pr AS (SELECT item_id, model, avg(correct) * 100 AS p FROM scored GROUP BY ALL)",
        f"""q AS (SELECT bootstrap, d.task, {_HIT.format(d=draw_sql("9", "bootstrap", "contest", "i.item_id", "d.a"), p="x.p")} AS u, {_HIT.format(d=draw_sql("9", "bootstrap", "contest", "i.item_id", "d.b"), p="y.p")} AS v
        FROM d JOIN ix i ON i.lang = d.lang AND i.competency = d.competency AND i.task = d.task AND i.item_ix = d.item_ix JOIN pr x ON x.item_id = i.item_id AND x.model = d.a JOIN pr y ON y.item_id = i.item_id AND y.model = d.b
        WHERE substr(d.task, 4)::BIGINT % 3 = 0)""",
        "SELECT bootstrap, task, avg(CASE WHEN u = v THEN 0.5 WHEN u > v THEN 1 ELSE 0 END) AS outcome, count(*) AS n FROM q GROUP BY ALL",
    ),
    "outcome",
)
def contest_bernoulli(spark, sf_dir):
    """Tasks scored by probabilities (every third here): each side succeeds with its probability, drawn by hash."""
    p = scored(spark, sf_dir).groupBy("item_id", "model").agg((F.avg("correct") * 100).alias("p"))
    rows = drawn(spark, sf_dir).where(F.substring("task", 4, 9).cast("long") % 3 == 0)
    rows = rows.join(p.select("item_id", F.col("model").alias("model_a"), F.col("p").alias("pa")), ["item_id", "model_a"]).join(p.select("item_id", F.col("model").alias("model_b"), F.col("p").alias("pb")), ["item_id", "model_b"])
    x, y = (rollup.success(F.col(c), 9, "bootstrap", "contest", "item_id", m).cast("double") for c, m in (("pa", "model_a"), ("pb", "model_b")))
    return rows.withColumn("outcome", rating.outcome(x, y)).groupBy("bootstrap", "task").agg(F.avg("outcome").alias("outcome"), F.count("*").alias("n"))


@query(sql(f"SELECT lang, competency, task, count(*) * {RUNS * 2 * PAIRS} AS n FROM items GROUP BY ALL"))
def contest_counts(spark, sf_dir):
    """All contests there are, over two turns."""
    rows = items(spark, sf_dir).groupBy(*LEVELS).agg(F.count("*").alias("k"))
    return rows.select(*LEVELS, rating.n_contests(RUNS, 2, F.col("k"), MODELS).alias("n"))


@query("SELECT p, a, p - a * (a - 1) // 2 AS b, n FROM (SELECT p, n, floor((1 + sqrt(1 + 8.0::DOUBLE * p)) / 2)::BIGINT AS a FROM (SELECT o_orderkey % 4950 AS p, count(*) AS n FROM orders GROUP BY 1))")
def pair_decode(spark, sf_dir):
    """Orders dealt to all pairs of a hundred models by index."""
    found = rating.decoded(F.col("p"), 1, 1, F.lit(4950))
    rows = read(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 4950).cast("long").alias("p")).agg(F.count("*").alias("n"))
    return rows.select("p", found["model_a"].alias("a"), found["model_b"].alias("b"), "n")


@query(sql(_ALLOC))
def contest_allocation(spark, sf_dir):
    return rating.allocation(items(spark, sf_dir), LEVELS, TOTAL)


@query(sql(" UNION ALL ".join(f"SELECT '{c}' AS balance_by, {c} AS entity, ceil({TOTAL} / (SELECT count(DISTINCT {c}) FROM items)::DOUBLE)::BIGINT AS n_contests FROM items GROUP BY {c}" for c in LEVELS)))
def contest_allocation_balanced(spark, sf_dir):
    """The total over tasks, over languages or over competencies alone."""
    return rating.balanced(items(spark, sf_dir), LEVELS, TOTAL)


_MLE = (
    *_O,
    "pw AS (SELECT bootstrap, model_a AS a, model_b AS b, sum(outcome) AS w, count(*) AS n FROM o GROUP BY ALL)",
    "ws AS (SELECT bootstrap, list(w ORDER BY model) AS w FROM (SELECT bootstrap, model, sum(w) AS w FROM (SELECT bootstrap, a AS model, w FROM pw UNION ALL SELECT bootstrap, b, n - w FROM pw) GROUP BY ALL) GROUP BY bootstrap)",
    "st AS MATERIALIZED (SELECT ws.bootstrap, ws.w, list({'a': pw.a, 'b': pw.b, 'n': pw.n}) AS g FROM pw JOIN ws ON pw.bootstrap = ws.bootstrap GROUP BY ALL)",
    f"""it AS (SELECT bootstrap, 0 AS k, list_transform(w, lambda x: 1.0::DOUBLE) AS v FROM st UNION ALL
    SELECT bootstrap, k + 1, list_transform(v, lambda x: x / exp(list_avg(list_transform(v, lambda y: ln(y))))) FROM (SELECT it.bootstrap, it.k, list_transform(range(1, {MODELS + 1}), lambda i: least(1e9, greatest(1e-9,
    st.w[i] / list_sum(list_transform(list_filter(st.g, lambda e: e.a = i - 1 OR e.b = i - 1), lambda e: e.n / (it.v[e.a + 1] + it.v[e.b + 1])))))) AS v FROM it JOIN st USING (bootstrap) WHERE it.k < 150))""",
    f"ml AS (SELECT bootstrap, i AS model, 1000 + 400 * log10(v[i + 1]) AS rating FROM it, (SELECT unnest(range(0, {MODELS})) AS i) WHERE k = 150)",
)


@query(recursive(*_MLE, "SELECT bootstrap, model, rating FROM ml"), "rating")
def rating_mle(spark, sf_dir):
    """Maximum-likelihood ratings of each bootstrap."""
    return rating.bradley_terry(contests(spark, sf_dir), ["bootstrap"])


_Z = "avg({c}) AS {n}, stddev_samp({c}) * sqrt(count({c}) / (count({c}) - 1)::DOUBLE) AS {s}"


@query(
    recursive(
        *_MLE,
        _W,
        f"z AS (SELECT model, {_Z.format(c='rating', n='mean', s='std_adj')}, count(rating) AS n, avg(win_rate) AS win_rate, stddev_samp(win_rate) AS win_rate_std FROM ml JOIN w USING (bootstrap, model) GROUP BY model)",
        "SELECT model, mean, std_adj, n, win_rate, win_rate_std, mean - 1.959963984540054::DOUBLE * std_adj / sqrt(n) AS low, mean + 1.959963984540054::DOUBLE * std_adj / sqrt(n) AS high FROM z",
    ),
    "mean std_adj low high win_rate win_rate_std",
)
def rating_summary(spark, sf_dir):
    """Ratings over bootstraps beside win rates."""
    rows = contests(spark, sf_dir)
    rates = rating.win_rates(rows, ["bootstrap"]).groupBy("model").agg(F.avg("win_rate").alias("win_rate"), F.stddev_samp("win_rate").alias("win_rate_std"))
    return rating.rating_summary(rating.bradley_terry(rows, ["bootstrap"]), ["model"], "rating").join(rates, "model")


_PLACE = f"md5(concat_ws('|', 'order', '{SEED}', {', '.join(f'{c}::VARCHAR' for c in (*KEYS, 'contest'))}))"
_MOVE = "x.k * (x.o - 1 / (1 + pow(10, (s.r[x.b + 1] - s.r[x.a + 1]) / 400)))"
_ELO = (
    *_O,
    f"""sq AS (SELECT bootstrap, list({{'r': NULL::DOUBLE[], 'a': model_a, 'b': model_b, 'o': outcome, 'k': 4.0::DOUBLE * (1 - i / n::DOUBLE)}} ORDER BY i) AS c FROM
    (SELECT *, row_number() OVER (PARTITION BY bootstrap ORDER BY {_PLACE}) - 1 AS i, count(*) OVER (PARTITION BY bootstrap) AS n FROM o) GROUP BY bootstrap)""",
    f"""el AS (SELECT bootstrap, list_reduce(c, lambda s, x: {{'r': list_transform(s.r, lambda v, j: CASE WHEN j - 1 = x.a THEN v + {_MOVE} WHEN j - 1 = x.b THEN v - {_MOVE} ELSE v END), 'a': x.a, 'b': x.b, 'o': x.o, 'k': x.k}},
    {{'r': [{", ".join(["1000"] * MODELS)}]::DOUBLE[], 'a': 0::BIGINT, 'b': 0::BIGINT, 'o': 0.0::DOUBLE, 'k': 0.0::DOUBLE}}).r AS r FROM sq)""",
)


@query(recursive(*_ELO, f"SELECT bootstrap, i AS model, r[i + 1] AS rating FROM el, (SELECT unnest(range(0, {MODELS})) AS i)"), "rating")
def rating_elo(spark, sf_dir):
    """Sequential ratings of each bootstrap."""
    return rating.elo(contests(spark, sf_dir), ["bootstrap"], "place")


_M = "m AS (SELECT item_id, model, avg(correct) AS score FROM scored GROUP BY ALL)"


@query(sql(_M, "SELECT a.model AS model_a, b.model AS model_b, coalesce(avg(a.score - b.score) / nullif(stddev_samp(a.score - b.score) / sqrt(count(*)), 0), 0) AS t, count(*) AS n FROM m a JOIN m b ON a.item_id = b.item_id AND a.model < b.model GROUP BY ALL"), "t")
def paired_t_test(spark, sf_dir):
    return paired(spark, sf_dir).drop("p")


def paired(spark, sf_dir):
    rows = scored(spark, sf_dir).groupBy("item_id", "model").agg(F.avg("correct").alias("score"))
    return rating.paired_t(rows, "item_id", "model", "score")


@query()
def paired_t_pvalues(spark, sf_dir):
    return paired(spark, sf_dir).select("model_a", "model_b", "p")


@query(
    sql(
        "s AS (SELECT model, run, lang, avg(correct) * 100 AS r FROM scored GROUP BY ALL)",
        "z AS (SELECT model, avg(r) AS mean, stddev_samp(r) * sqrt(count(r) / (count(r) - 1)::DOUBLE) AS std_adj, count(r) AS n FROM s GROUP BY model)",
        "SELECT *, mean - 1.959963984540054::DOUBLE * std_adj / sqrt(n) AS low, mean + 1.959963984540054::DOUBLE * std_adj / sqrt(n) AS high FROM z",
    ),
    "mean std_adj low high",
)
def interval_of_bootstraps(spark, sf_dir):
    """The summary over accuracies of runs and languages."""
    rows = scored(spark, sf_dir).groupBy("model", "run", "lang").agg((F.avg("correct") * 100).alias("r"))
    return rating.rating_summary(rows, ["model"], "r")


@query(sql("SELECT model, task, avg(correct) * 100 AS score FROM scored GROUP BY ALL"), "score")
def sorted_task_scores(spark, sf_dir):
    """Best models first; the order is part of the written report, not of the rows."""
    rows = scored(spark, sf_dir).groupBy("model", "task").agg((F.avg("correct") * 100).alias("score"))
    return rollup.micro(rows.withColumn("n", F.lit(1)), ["model", "task"], "score", "n").orderBy(F.desc("score"), "model", "task")
