"""Judges' verdicts drawn for items, turns and criteria; similarities of embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradus.functions import text
from gradus.functions.draws import divided, draw, draw_sql
from gradus.operators import judge
from gradus.plans.registry import Registry
from gradus.plans.tables import answers, read, sql

REGISTRY = Registry()
query = REGISTRY.query

WEIGHTS = {"CLASS_0": 0.0, "CLASS_1": 0.25, "CLASS_2": 0.5, "CLASS_3": 0.75, "CLASS_4": 1.0}
_V = f"""v AS (SELECT a.model, a.run, a.item_id, a.lang, a.competency, c.criterion, {draw_sql("5", "a.model", "a.run", "a.item_id", "c.criterion")} AS d
    FROM answers a, (SELECT unnest(range(0, 5)) AS criterion) c)"""
_J = """j AS (SELECT *, 'Note. <classification> CLASS_' || (d % 6) || ' </classification> then <classification>CLASS_' || (d // 8 % 6) || '</classification>' AS verdict FROM v)"""
_W = "CASE {c} WHEN 'CLASS_1' THEN 0.25::DOUBLE WHEN 'CLASS_2' THEN 0.5 WHEN 'CLASS_3' THEN 0.75 WHEN 'CLASS_4' THEN 1.0 ELSE 0 END"
_S = f"s AS (SELECT *, {_W.format(c="regexp_extract(verdict, '<classification>\\s*([^<]*?)\\s*</classification>', 1)")} AS w FROM j)"


def verdicts(spark, sf_dir):
    rows = answers(spark, sf_dir).withColumn("criterion", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    rows = rows.withColumn("d", draw(5, "model", "run", "item_id", "criterion"))
    said = F.format_string("Note. <classification> CLASS_%d </classification> then <classification>CLASS_%d</classification>", F.col("d") % 6, divided(F.col("d"), 8) % 6)
    return rows.select("model", "run", "item_id", "lang", "competency", "criterion", "d", said.alias("verdict"))


def weighted(spark, sf_dir):
    return verdicts(spark, sf_dir).withColumn("w", judge.weight(judge.classification(F.col("verdict")), WEIGHTS))


@query(
    sql(_V, _J, _S, "SELECT model, competency, avg(score) * 100 AS score, count(*) AS n_items FROM (SELECT model, competency, item_id, run, avg(w) AS score FROM s GROUP BY ALL) GROUP BY GROUPING SETS ((model, competency), (model))"),
    "score",
)
def judge_criteria(spark, sf_dir):
    return judge.criteria_score(weighted(spark, sf_dir), ["model"], ["item_id", "run"], "competency", "w")


@query(sql(_V, _J, "SELECT model, run, item_id, criterion, regexp_extract(verdict, '.*<classification>\\s*([^<]*?)\\s*</classification>', 1) AS class FROM j"))
def judge_last_classification(spark, sf_dir):
    return verdicts(spark, sf_dir).select("model", "run", "item_id", "criterion", judge.classification(F.col("verdict"), last=True).alias("class"))


@query(
    sql(_V, _J, _S, "SELECT model, lang, t0 AS turn_0, t1 AS turn_1, (t0 + t1) / 2 AS score FROM (SELECT model, lang, coalesce(avg(w) FILTER (criterion = 0), 0) AS t0, coalesce(avg(w) FILTER (criterion = 1), 0) AS t1 FROM s GROUP BY ALL)"),
    "turn_0 turn_1 score",
)
def judge_two_turn(spark, sf_dir):
    return judge.two_turn_score(weighted(spark, sf_dir), ["model", "lang"], "criterion", "w")


_SEV = "x AS (SELECT *, CASE criterion WHEN 0 THEN 'generic' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' END AS severity, CASE criterion WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 1 END::DOUBLE AS sw FROM s)"


def severities(spark, sf_dir):
    named = F.create_map(*[F.lit(x) for kv in enumerate(["generic", "high", "medium", "low"]) for x in kv])
    return weighted(spark, sf_dir).withColumn("severity", F.try_element_at(named, F.col("criterion").cast("int")))


@query(
    sql(_V, _J, _S, _SEV, "SELECT model, run, item_id, g AS generic, c AS criteria, g * c AS overall FROM (SELECT model, run, item_id, sum(sw * w) FILTER (severity = 'generic') / sum(sw) FILTER (severity = 'generic') AS g, sum(sw * w) FILTER (severity IS DISTINCT FROM 'generic') / sum(sw) FILTER (severity IS DISTINCT FROM 'generic') AS c FROM x GROUP BY ALL)"),
    "generic criteria overall",
)
def judge_severity_weighted(spark, sf_dir):
    return judge.severity_score(severities(spark, sf_dir), ["model", "run", "item_id"], "severity", "w")


@query(
    sql(_V, "SELECT model, run, item_id, greatest(sum(CASE WHEN d % 3 = 0 THEN criterion * 2 - 3 ELSE 0 END) / sum(greatest(criterion * 2 - 3, 0))::DOUBLE, 0) AS score FROM v GROUP BY ALL"),
    "score",
)
def judge_rubric_points(spark, sf_dir):
    rows = verdicts(spark, sf_dir).select("model", "run", "item_id", (F.col("d") % 3 == 0).alias("met"), (F.col("criterion") * 2 - 3).alias("points"))
    return judge.rubric_score(rows, ["model", "run", "item_id"], "met", "points")


_P = """p AS (SELECT model, run, item_id, competency, criterion, CASE d % 5 WHEN 0 THEN 'I say [[A]]' WHEN 1 THEN '[[B]] it is' WHEN 2 THEN '[[C]]' WHEN 3 THEN '[[A]] or [[B]]' ELSE '[[A]].' END AS one,
    CASE d // 8 % 4 WHEN 0 THEN '[[A]]' WHEN 1 THEN '[[B]]' WHEN 2 THEN '[[C]]' ELSE 'none' END AS two FROM v)"""
_PV = """pv AS (SELECT *, CASE WHEN contains(one, '[[A]]')::INT + contains(one, '[[B]]')::INT + contains(one, '[[C]]')::INT <> 1 THEN 'ERROR' WHEN contains(one, '[[C]]') THEN 'TIE' WHEN contains(one, '[[A]]') THEN 'WIN' ELSE 'LOSE' END AS v1,
    CASE two WHEN '[[A]]' THEN 'LOSE' WHEN '[[B]]' THEN 'WIN' WHEN '[[C]]' THEN 'TIE' ELSE 'ERROR' END AS v2 FROM p)"""


def pairwise(spark, sf_dir):
    d = F.col("d")
    one = F.when(d % 5 == 0, "I say [[A]]").when(d % 5 == 1, "[[B]] it is").when(d % 5 == 2, "[[C]]").when(d % 5 == 3, "[[A]] or [[B]]").otherwise("[[A]].")
    e = divided(d, 8) % 4
    two = F.when(e == 0, "[[A]]").when(e == 1, "[[B]]").when(e == 2, "[[C]]").otherwise("none")
    rows = verdicts(spark, sf_dir).select("model", "run", "item_id", "competency", "criterion", judge.verdict(one).alias("v1"), judge.verdict(two, F.lit(True)).alias("v2"))
    return rows.withColumn("outcome", judge.combined(F.col("v1"), F.col("v2")))


@query(sql(_V, _P, _PV, "SELECT model, run, item_id, criterion, v1, v2, CASE WHEN v1 = v2 THEN v1 ELSE 'TIE' END AS outcome, CASE WHEN v1 = v2 THEN v1 ELSE 'ERROR' END AS strict FROM pv"))
def judge_pairwise_verdicts(spark, sf_dir):
    rows = pairwise(spark, sf_dir)
    return rows.select("model", "run", "item_id", "criterion", "v1", "v2", "outcome", judge.combined(F.col("v1"), F.col("v2"), ties=False).alias("strict"))


_PTS = "CASE WHEN v1 <> v2 OR v1 = 'TIE' THEN 0.5 WHEN v1 = 'WIN' THEN 1 ELSE 0 END::DOUBLE"


@query(
    sql(_V, _P, _PV, f"SELECT model, sum(pts) / sum(n)::DOUBLE AS win_rate, avg(pts / n) * 100 AS weighted, sum(n)::BIGINT AS n FROM (SELECT model, competency, sum({_PTS}) AS pts, count(*) AS n FROM pv GROUP BY ALL) GROUP BY model"),
    "win_rate weighted",
)
def judge_pairwise_win_rate(spark, sf_dir):
    return judge.win_rates(pairwise(spark, sf_dir), ["model"], "competency", "outcome")


_LABELS, _POINTS = ["much better", "better", "same", "worse", "much worse"], [1.0, 0.75, 0.5, 0.25, 0.0]
_FINE = "CASE WHEN {d} % 7 < 5 THEN 'It is ' || ['much better', 'better', 'same', 'worse', 'much worse'][({d} % 5 + 1)::INT] ELSE 'unsure' END"
_FIRST = "CASE " + " ".join(f"WHEN contains({{t}}, '{x}') THEN {p}::DOUBLE" for x, p in zip(_LABELS, _POINTS, strict=True)) + " END"
_LAST = "CASE " + " ".join(f"WHEN contains({{t}}, '{x}') THEN {1 - p}::DOUBLE" for x, p in zip(_LABELS, _POINTS, strict=True)) + " END"


@query(
    sql(
        _V,
        f"y AS (SELECT model, {_FINE.format(d='d')} AS one, {_FINE.format(d='(d // 8)')} AS two FROM v)",
        f"x AS (SELECT model, ({_FIRST.format(t='one')} + {_LAST.format(t='two')}) / 2 AS x FROM y)",
        "SELECT model, sum(coalesce(x, 0)) / count(*) * 100 AS score, avg(coalesce((x > 0.5)::INT, 0)) AS win, avg(coalesce((x = 0.5)::INT, 0)) AS tie, count_if(x IS NULL)::BIGINT AS null_count FROM x GROUP BY model",
    ),
    "score win tie",
)
def judge_fine_grained(spark, sf_dir):
    """Labels in words, the second order read the other way round."""
    d, e = F.col("d"), divided(F.col("d"), 8)
    said = lambda x: F.when(x % 7 < 5, F.concat(F.lit("It is "), F.get(F.array(*map(F.lit, _LABELS)), (x % 5).cast("int")))).otherwise("unsure")
    rows = verdicts(spark, sf_dir).select("model", judge.labelled_points(said(d), _LABELS, _POINTS).alias("first"), judge.labelled_points(said(e), _LABELS, _POINTS, reverse=True).alias("second"))
    return judge.fine_grained(rows, ["model"], "first", "second", 1.0)


@query(sql(_V, "SELECT model, run, item_id, criterion, CASE WHEN d % 3 = 0 THEN 'so it' || chr(10) || 'is' WHEN d % 3 = 1 THEN 'short' END AS reflection, CASE WHEN d % 3 = 0 THEN 'late' WHEN d % 3 = 1 THEN 'short' END AS one_line FROM v"))
def judge_reflections(spark, sf_dir):
    """What a judge reflects, over lines and on one line only."""
    d = F.col("d")
    said = F.when(d % 3 == 0, "<reflection>so it\nis </reflection> <reflection>late</reflection>").when(d % 3 == 1, "x <reflection> short</reflection>").otherwise("none")
    rows = verdicts(spark, sf_dir)
    return rows.select("model", "run", "item_id", "criterion", text.reflection(said).alias("reflection"), text.reflection(said, dotall=False).alias("one_line"))


@query(sql(_V, "SELECT model, run, item_id, criterion, CASE WHEN d % 3 < 2 THEN d % 2 = 0 END AS met FROM v"))
def judge_rubric_verdicts(spark, sf_dir):
    """The last object of a judge's answer, plain, with escaped quotes, or broken."""
    d = F.col("d")
    met = F.when(d % 2 == 0, "true").otherwise("false")
    said = F.when(d % 3 == 0, F.concat(F.lit('{"a": 1} then {"criteria_met": '), met, F.lit("}"))).when(d % 3 == 1, F.concat(F.lit('so {\\"criteria_met\\": '), met, F.lit("}"))).otherwise('{"criteria_met": ')
    found = F.try_variant_get(text.repaired_json(said, "criteria_met"), "$.criteria_met", "boolean")
    return verdicts(spark, sf_dir).select("model", "run", "item_id", "criterion", found.alias("met"))


@query(
    sql(_V, "SELECT model, lang, avg((d % 4 = 0)::INT)::DOUBLE AS accuracy FROM v GROUP BY ALL"),
    "accuracy",
)
def judge_binary(spark, sf_dir):
    d = F.col("d")
    said = F.when(d % 4 == 0, "This is CORRECT.").when(d % 4 == 1, "INCORRECT").when(d % 4 == 2, "CORRECT, no, INCORRECT").otherwise("unclear")
    return verdicts(spark, sf_dir).groupBy("model", "lang").agg(F.avg(judge.correct(said)).alias("accuracy"))


_COS = """e AS (SELECT a.vec_id, a.label, CASE WHEN n1 * n2 = 0 THEN 0 ELSE dot / sqrt(n1 * n2) END AS cosine FROM (
    SELECT a.vec_id, a.label, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS dot,
    list_sum(list_transform(a.embedding, lambda z: z::DOUBLE * z)) AS n1, list_sum(list_transform(b.embedding, lambda z: z::DOUBLE * z)) AS n2
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) a)"""


def neighbours(spark, sf_dir):
    """Each vector beside the one with the next id."""
    v = read(spark, sf_dir, "embeddings")
    following = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(following, "vec_id").select("vec_id", "label", judge.cosine(F.col("embedding"), F.col("other")).alias("cosine"))


@query(f"WITH {_COS} SELECT label, avg(2.5 * greatest(cosine, 0)) AS similarity, max(cosine) AS best FROM e GROUP BY label", "similarity best")
def vector_similarity(spark, sf_dir):
    return neighbours(spark, sf_dir).groupBy("label").agg(F.avg(2.5 * F.greatest("cosine", F.lit(0.0))).alias("similarity"), F.max("cosine").alias("best"))


@query(
    f"WITH {_COS} SELECT avg(CASE WHEN a + b = 0 THEN 0 ELSE 2 * a * b / (a + b) END) * 100 AS score FROM (SELECT greatest(cosine, 0) AS a, abs(cosine) AS b FROM e)",
    "score",
)
def ref_similarity_harmonic(spark, sf_dir):
    rows = neighbours(spark, sf_dir).select(judge.harmonic(F.greatest("cosine", F.lit(0.0)), F.abs("cosine")).alias("h"))
    return rows.agg((F.avg("h") * 100).alias("score"))
