"""Evaluation tables made from the driver's tables by hashed draws, for Spark and for SQL.

items: labelled documents with language, task and competency. responses: what
five models answered in four runs, most often the label in one of several forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.functions.draws import draw, draw_sql
from gradus.functions.text import extract_choice
from gradus.sources.parallel import spread

MODELS, RUNS = 5, 4
LABELS = ["bad", "good", "toxic"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts, which cost most per row, are dealt out to all cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def sql(*parts: str) -> str:
    """The last part as a query that can name the tables below and the parts before it."""
    return "WITH " + ", ".join([*(f"{n} AS ({CTE[n]})" for n in CTE), *parts[:-1]]) + " " + parts[-1]


CTE = {
    "items": """SELECT d.doc_id AS item_id, d.lang, d.source AS task,
        'c' || (substr(d.source, 4)::BIGINT % 4)::VARCHAR AS competency,
        CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 1 THEN 'good' ELSE 'bad' END AS label
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "answers": f"""SELECT i.*, m.model, r.run, {draw_sql("m.model", "r.run", "i.item_id")} AS u
        FROM items i, (SELECT unnest(range(0, {MODELS})) AS model) m, (SELECT unnest(range(0, {RUNS})) AS run) r""",
    "responses": """SELECT item_id, lang, task, competency, label, model, run, CASE
        WHEN u % 16 = 3 THEN 'no idea'
        WHEN u % 4 = 1 THEN 'Some thought.' || chr(10) || 'Answer: **' || upper(named) || '**'
        WHEN u % 4 = 2 THEN 'answer:' || named || '.'
        ELSE 'Answer: ' || named END AS response
        FROM (SELECT *, CASE WHEN u % 100 < 50 + 10 * model THEN label WHEN u % 3 = 0 THEN 'bad' WHEN u % 3 = 1 THEN 'good' ELSE 'toxic' END AS named FROM answers)""",
    "scored": """SELECT *, CASE WHEN pred = label THEN 1 ELSE 0 END AS correct FROM (
        SELECT *, coalesce(nullif(lower(regexp_extract(response, '(?i)answer:[\\s\\*]*(good|bad|toxic)', 1)), ''), 'null') AS pred FROM responses)""",
}


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("bad")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source")
    return docs.join(read(spark, sf_dir, "labels"), "doc_id").select(
        F.col("doc_id").alias("item_id"),
        "lang",
        F.col("source").alias("task"),
        F.concat(F.lit("c"), (F.substring("source", 4, 9).cast("long") % 4).cast("string")).alias("competency"),
        label.alias("label"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per item, model and run, with the draw that decides the response."""
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(MODELS - 1).cast("long")))
    rows = items(spark, sf_dir).withColumn("model", each)
    rows = rows.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(RUNS - 1).cast("long"))))
    return rows.withColumn("u", draw("model", "run", "item_id"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    u: Column = F.col("u")
    other = F.when(u % 3 == 0, "bad").when(u % 3 == 1, "good").otherwise("toxic")
    named = F.when(u % 100 < 50 + 10 * F.col("model"), F.col("label")).otherwise(other)
    response = (
        F.when(u % 16 == 3, "no idea")
        .when(u % 4 == 1, F.concat(F.lit("Some thought.\nAnswer: **"), F.upper(named), F.lit("**")))
        .when(u % 4 == 2, F.concat(F.lit("answer:"), named, F.lit(".")))
        .otherwise(F.concat(F.lit("Answer: "), named))
    )
    return answers(spark, sf_dir).select("item_id", "lang", "task", "competency", "label", "model", "run", response.alias("response"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = extract_choice(F.col("response"), {x: x for x in LABELS})
    rows = responses(spark, sf_dir).withColumn("pred", pred)
    return rows.withColumn("correct", (F.col("pred") == F.col("label")).cast("int"))
