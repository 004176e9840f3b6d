"""Roll-ups of task scores, bootstraps over runs, completeness."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradus.functions.draws import RANGE, draw_sql
from gradus.operators import rollup
from gradus.plans.registry import Registry
from gradus.plans.tables import RUNS, read, scored, sql

REGISTRY = Registry()
query = REGISTRY.query
SEED, BOOTSTRAPS = 94370244, 30

_T = "t AS (SELECT model, lang, competency, task, avg(correct) * 100 AS score, count(*) AS n FROM scored GROUP BY ALL)"
LEVELS = ["model", "lang", "competency", "task"]


def task_scores(spark, sf_dir):
    return scored(spark, sf_dir).groupBy(*LEVELS).agg((F.avg("correct") * 100).alias("score"), F.count("*").alias("n"))


_C = "c AS (SELECT model, lang, competency, avg(score) AS score FROM t GROUP BY ALL)"
_L = "l AS (SELECT model, lang, avg(score) AS score FROM c GROUP BY ALL)"


@query(sql(_T, _C, "SELECT model, lang, competency, score FROM c"), "score")
def competency_scores(spark, sf_dir):
    return rollup.mean_of_means(task_scores(spark, sf_dir), LEVELS, "score")["competency"]


@query(sql(_T, _C, _L, "SELECT model, lang, score FROM l"), "score")
def language_scores(spark, sf_dir):
    return rollup.mean_of_means(task_scores(spark, sf_dir), LEVELS, "score")["lang"]


@query(sql(_T, _C, _L, "SELECT model, avg(score) AS score FROM l GROUP BY model"), "score")
def rollup_of_means(spark, sf_dir):
    return rollup.mean_of_means(task_scores(spark, sf_dir), LEVELS, "score")["model"]


@query(sql(_T, _C, "SELECT model, avg(score) AS score FROM (SELECT model, lang, avg(score) AS score FROM c WHERE lang IN ('es', 'fr') GROUP BY ALL) GROUP BY model"), "score")
def regional_total(spark, sf_dir):
    """The total over a subset of languages."""
    return rollup.mean_of_means(task_scores(spark, sf_dir).where(F.col("lang").isin("es", "fr")), LEVELS, "score")["model"]


_G = "CASE WHEN substr(task, 4)::BIGINT < 10 THEN 'low' END"


@query(sql(_T, f"SELECT model, lang, coalesce({_G}, task) AS task, avg(score) AS score FROM t GROUP BY ALL"), "score")
def group_macro(spark, sf_dir):
    rows = task_scores(spark, sf_dir).withColumn("group", F.when(F.substring("task", 4, 9).cast("long") < 10, "low"))
    return rollup.grouped(rows, ["model", "lang"], "group", "task", "score")


@query(sql(_T, "SELECT model, lang, competency, sum(score * n) / sum(n)::DOUBLE AS score FROM t GROUP BY ALL"), "score")
def group_micro(spark, sf_dir):
    return rollup.micro(task_scores(spark, sf_dir), ["model", "lang", "competency"], "score", "n")


@query(sql("SELECT model, lang, avg(coalesce(score, 0)) AS score, count_if(score IS NULL)::BIGINT AS n_failed FROM (SELECT model, lang, task, CASE WHEN count(*) < 8 THEN NULL ELSE avg(correct) * 100 END AS score FROM scored GROUP BY ALL) GROUP BY ALL"), "score")
def failed_as_zero(spark, sf_dir):
    """Tasks that gave no result count as 0: here those with fewer than eight rows."""
    rows = scored(spark, sf_dir).groupBy("model", "lang", "task").agg(F.when(F.count("*") >= 8, F.avg("correct") * 100).alias("score"))
    return rows.groupBy("model", "lang").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("score"), F.count_if(F.col("score").isNull()).alias("n_failed"))


_B = f"""b AS (SELECT s.* EXCLUDE (run), bootstrap FROM scored s JOIN (SELECT model, item_id, bootstrap, {draw_sql(str(SEED), "bootstrap", "model", "item_id")} % {RUNS} AS run
    FROM (SELECT DISTINCT model, item_id FROM scored), (SELECT unnest(range(0, {BOOTSTRAPS})) AS bootstrap)) d USING (model, item_id, run))"""
_BT = "bt AS (SELECT bootstrap, model, lang, competency, task, avg(correct) * 100 AS score FROM b GROUP BY ALL)"


def bootstrapped(spark, sf_dir):
    rows = rollup.resampled(scored(spark, sf_dir), ["model", "item_id"], "run", BOOTSTRAPS, SEED)
    return rows.groupBy("bootstrap", *LEVELS).agg((F.avg("correct") * 100).alias("score"))


@query(sql(_B, _BT, "SELECT model, lang, task, avg(score) AS mean, coalesce(sqrt(var_samp(score) / count(score)), 0) AS stderr, count(*) AS n_bootstraps FROM bt GROUP BY ALL"), "mean stderr")
def bootstrap_task_mean(spark, sf_dir):
    return rollup.with_error(bootstrapped(spark, sf_dir), ["model", "lang", "task"], "score")


@query(
    sql(
        _B,
        _BT,
        "bc AS (SELECT bootstrap, model, lang, competency, avg(score) AS score FROM bt GROUP BY ALL)",
        "bl AS (SELECT bootstrap, model, lang, avg(score) AS score FROM bc GROUP BY ALL)",
        "bm AS (SELECT bootstrap, model, avg(score) AS score FROM bl GROUP BY ALL)",
        "SELECT model, avg(score) AS mean, coalesce(sqrt(var_samp(score) / count(score)), 0) AS stderr, count(*) AS n_bootstraps FROM bm GROUP BY model",
    ),
    "mean stderr",
)
def bootstrap_overall(spark, sf_dir):
    """Means of means within each bootstrap, then mean and error over bootstraps."""
    return rollup.with_error(rollup.mean_of_means(bootstrapped(spark, sf_dir), ["bootstrap", *LEVELS], "score")["model"], ["model"], "score")


@query(
    sql(
        _B,
        "rc AS (SELECT bootstrap, model, lang, label, avg(correct)::DOUBLE AS recall FROM b GROUP BY ALL)",
        "ba AS (SELECT bootstrap, model, lang, avg(recall) * 100 AS score FROM rc GROUP BY ALL)",
        "SELECT model, lang, avg(score) AS mean, coalesce(sqrt(var_samp(score) / count(score)), 0) AS stderr, count(*) AS n_bootstraps FROM ba GROUP BY ALL",
    ),
    "mean stderr",
)
def bootstrap_balanced_accuracy(spark, sf_dir):
    rows = rollup.resampled(scored(spark, sf_dir), ["model", "item_id"], "run", BOOTSTRAPS, SEED)
    recall = rows.groupBy("bootstrap", "model", "lang", "label").agg(F.avg("correct").alias("recall"))
    return rollup.with_error(recall.groupBy("bootstrap", "model", "lang").agg((F.avg("recall") * 100).alias("score")), ["model", "lang"], "score")


@query(
    sql(
        f"x AS (SELECT model, item_id, bootstrap, ({draw_sql('7', 'bootstrap', 'model', 'item_id')} / {RANGE}.0::DOUBLE < p / 100)::INT AS hit FROM (SELECT model, item_id, avg(correct) * 100 AS p FROM scored GROUP BY ALL), (SELECT unnest(range(0, {BOOTSTRAPS})) AS bootstrap))",
        "SELECT model, avg(m) AS mean, coalesce(sqrt(var_samp(m) / count(m)), 0) AS stderr, count(*) AS n_bootstraps FROM (SELECT model, bootstrap, avg(hit) * 100 AS m FROM x GROUP BY ALL) GROUP BY model",
    ),
    "mean stderr",
)
def bootstrap_bernoulli(spark, sf_dir):
    """A draw per item and bootstrap with the item's probability."""
    rows = scored(spark, sf_dir).groupBy("model", "item_id").agg((F.avg("correct") * 100).alias("p"))
    rows = rows.withColumn("bootstrap", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BOOTSTRAPS - 1).cast("long"))))
    means = rows.groupBy("model", "bootstrap").agg((F.avg(rollup.success(F.col("p"), 7, "bootstrap", "model", "item_id")) * 100).alias("m"))
    return rollup.with_error(means, ["model"], "m")


@query(
    sql(
        "r AS (SELECT model, run, item_id, correct, row_number() OVER (PARTITION BY model, run ORDER BY item_id) - 1 AS place, count(*) OVER (PARTITION BY model, run) AS n FROM scored)",
        f"d AS (SELECT model, run, bootstrap, {draw_sql('4156', 'model', 'run', 'bootstrap', 'place')} % n AS place FROM r, (SELECT unnest(range(0, 1000)) AS bootstrap))",
        "m AS (SELECT d.model, d.run, bootstrap, avg(correct) AS m FROM d JOIN r ON d.model = r.model AND d.run = r.run AND d.place = r.place GROUP BY ALL)",
        "SELECT model, run, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.5) AS mid, quantile_cont(m, 0.975) AS high FROM m GROUP BY model, run",
    ),
    "low mid high",
)
def bootstrap_interval(spark, sf_dir):
    """Of each model and run, from a thousand resamples of its items, as many with replacement as there are."""
    return rollup.percentile_interval(scored(spark, sf_dir), ["model", "run"], "item_id", "correct", 1000, 4156)


@query(
    sql(
        f"e AS (SELECT model, run, lang, count(*) AS n_expected FROM scored GROUP BY ALL)",
        "a AS (SELECT model, run, lang, count(*) AS n FROM scored WHERE NOT (model = 1 AND lang = 'fr') AND NOT (model = 2 AND run = 3 AND item_id % 5 = 0) AND NOT (model = 4 AND run = 1) GROUP BY ALL)",
        """r AS (SELECT model, run, count(n)::BIGINT AS n_present, count(*) AS n_expected, coalesce(string_agg(CASE WHEN n IS NULL THEN lang END, ',' ORDER BY lang), '') AS missing,
        coalesce(string_agg(CASE WHEN n < n_expected THEN lang END, ',' ORDER BY lang), '') AS incomplete FROM e LEFT JOIN a USING (model, run, lang) GROUP BY ALL)""",
        "SELECT *, CASE WHEN n_present = 0 THEN 'Error' WHEN missing = '' AND incomplete = '' THEN 'Complete' ELSE 'Incomplete' END AS status FROM r",
    )
)
def completeness_report(spark, sf_dir):
    """Some results are left out, to be reported."""
    keys = ["model", "run", "lang"]
    rows = scored(spark, sf_dir)
    expected = rows.groupBy(*keys).agg(F.count("*").alias("n_expected"))
    there = rows.where("NOT (model = 1 AND lang = 'fr') AND NOT (model = 2 AND run = 3 AND item_id % 5 = 0) AND NOT (model = 4 AND run = 1)")
    return rollup.completeness(expected, there.groupBy(*keys).agg(F.count("*").alias("n")), keys, ["model", "run"])


_H = """h AS (SELECT r.r_name AS region, n.n_name AS nation, c.c_custkey AS customer, avg(o.o_totalprice) AS score FROM orders o
    JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY ALL)"""


@query(f"WITH {_H} SELECT region, avg(score) AS score FROM (SELECT region, nation, avg(score) AS score FROM h GROUP BY ALL) GROUP BY region", "score")
def geography_means(spark, sf_dir):
    """Mean of nations' means of customers' means; the small dimensions are broadcast only as far as Spark's size check allows."""
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_totalprice").join(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.groupBy("c_custkey", "c_nationkey").agg(F.avg("o_totalprice").alias("score"))
    rows = rows.join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), "score")
    return rollup.mean_of_means(rows, ["region", "nation"], "score")["region"]


_LEFT = "NOT (model = 1 AND lang = 'fr') AND NOT (model = 2 AND run = 3 AND item_id % 5 = 0) AND NOT (model = 4 AND run = 1)"
_INT = f"""e AS (SELECT model, run, lang, count(*) AS n_expected FROM scored GROUP BY ALL),
    a AS (SELECT model, run, lang, count(*) AS n, count_if(model <> 3 OR item_id % 11 <> 0) AS n_reasoned FROM scored WHERE {_LEFT} GROUP BY ALL),
    r AS (SELECT model, run, count(n)::BIGINT AS n_present, count(*) AS n_expected, coalesce(string_agg(CASE WHEN n IS NULL THEN lang END, ',' ORDER BY lang), '') AS missing,
    coalesce(string_agg(CASE WHEN n < n_expected THEN lang END, ',' ORDER BY lang), '') AS incomplete, coalesce(string_agg(CASE WHEN n_reasoned < n THEN lang END, ',' ORDER BY lang), '') AS missing_reasoning
    FROM e LEFT JOIN a USING (model, run, lang) GROUP BY ALL),
    s AS (SELECT *, CASE WHEN n_present = 0 THEN 'Error' WHEN missing = '' AND incomplete = '' AND missing_reasoning = '' THEN 'Complete' ELSE 'Incomplete' END AS status FROM r)"""


def integrity(spark, sf_dir):
    keys = ["model", "run", "lang"]
    rows = scored(spark, sf_dir)
    expected = rows.groupBy(*keys).agg(F.count("*").alias("n_expected"))
    there = rows.where(_LEFT).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if((F.col("model") != 3) | (F.col("item_id") % 11 != 0)).alias("n_reasoned"))
    return rollup.completeness(expected, there, keys, ["model", "run"], "n_reasoned")


@query(sql(_INT, "SELECT * FROM s"))
def integrity_report(spark, sf_dir):
    """With results whose reasoning is missing."""
    return integrity(spark, sf_dir)


@query(sql(_INT, "SELECT model, max(status) FILTER (run = 0) AS \"0\", max(status) FILTER (run = 1) AS \"1\", max(status) FILTER (run = 2) AS \"2\", max(status) FILTER (run = 3) AS \"3\" FROM s GROUP BY model"))
def integrity_table(spark, sf_dir):
    return rollup.report_table(integrity(spark, sf_dir), "model", "run", list(range(RUNS)), "status")


@query(sql("SELECT model, task, avg(x) * CASE WHEN max(x) <= 1 THEN 100 ELSE 1 END AS score FROM (SELECT model, task, correct * CASE WHEN substr(task, 4)::BIGINT % 2 = 0 THEN 1 ELSE 100 END AS x FROM scored) GROUP BY ALL"), "score")
def auto_scaled_means(spark, sf_dir):
    """Tasks scored on 0 to 1 or on 0 to 100."""
    scale = F.when(F.substring("task", 4, 9).cast("long") % 2 == 0, 1).otherwise(100)
    return rollup.scaled_means(scored(spark, sf_dir).select("model", "task", (F.col("correct") * scale).alias("score")), ["model", "task"], "score")


_PRAG = "pg AS (SELECT model, lang, avg(a) AS a FROM (SELECT model, lang, competency, sum(correct) / count(*)::DOUBLE AS a FROM scored GROUP BY ALL) GROUP BY ALL)"


def pragmatics(spark, sf_dir):
    counts = scored(spark, sf_dir).groupBy("model", "lang", "task", "competency").agg(F.sum("correct").alias("n_correct"), F.count("*").alias("n_total"))
    return rollup.pragmatics(counts, ["model", "lang"], "competency")


@query(sql(_PRAG, "SELECT model, lang, a * 100 AS accuracy, greatest((a - 0.5) / 0.5, 0) * 100 AS normalized FROM pg"), "accuracy normalized")
def pragmatics_total(spark, sf_dir):
    """Phenomena over all of their tasks; their mean, normalised for two choices."""
    return pragmatics(spark, sf_dir)


@query(
    sql(
        _PRAG,
        "c AS (SELECT model, lang, greatest((a - 0.5) / 0.5, 0) * 100 AS score FROM pg WHERE lang <> 'de' UNION ALL SELECT model, lang, avg(correct) * 100 FROM scored WHERE run = 0 OR lang = 'fr' GROUP BY ALL)",
        "SELECT model, lang, avg(score) AS score, count(*) AS n_components FROM c GROUP BY ALL",
    ),
    "score",
)
def diagnostics_total(spark, sf_dir):
    """The mean of the components that a language has: one has no pragmatics."""
    first = pragmatics(spark, sf_dir).where("lang <> 'de'").select("model", "lang", F.col("normalized").alias("score"))
    other = scored(spark, sf_dir).where("run = 0 OR lang = 'fr'").groupBy("model", "lang").agg((F.avg("correct") * 100).alias("score"))
    return rollup.diagnostics(first.unionByName(other), ["model", "lang"], "score")
