"""Readers and writers of evaluation records."""

from __future__ import annotations

import io
import json
import unicodedata
import zipfile
from collections.abc import Iterable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.functions.text import file_timestamp

ITEMS = "id string, label string, prompts array<map<string,string>>, metadata map<string,string>"
RESPONSES = "custom_id string, model string, run int, task string, lang string, responses array<string>, finish_reasons array<string>, errors array<string>, individual_scores map<string,string>"


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str = ITEMS) -> DataFrame:
    """Records of a known schema: no pass over the data to infer one. Unreadable lines give nulls."""
    return spark.read.schema(schema).json(paths)


def read_csv(spark: SparkSession, paths: str | list[str], schema: str, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).csv(paths, header=True, sep=sep)


def read_tsv_column(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One language's column of a table of translated words."""
    return spark.read.csv(path, header=True, sep="\t").select(F.col(column).alias("word"))


def read_words(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Distinct lines without spaces at the ends, no empty ones."""
    return spark.read.text(paths).select(F.trim("value").alias("word")).where("word <> ''").distinct()


def read_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, text) of whole files, spaces collapsed."""
    rows = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return rows.select("path", F.trim(F.regexp_replace("value", r"[ \t]+", " ")).alias("text"))


def read_binaries(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content, size) of images or sound, as they are."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content", F.col("length").alias("size"))


def read_run_files(spark: SparkSession, pattern: str, schema: str = RESPONSES) -> DataFrame:
    """Result files under ``org/model/run_k/...``: org, model and run come from the path."""
    rows = spark.read.schema(schema).json(pattern).withColumn("path", F.col("_metadata.file_path"))
    part = lambda g: F.regexp_extract("path", r"([^/]+)/([^/]+)/run_(\d+)/[^/]*$", g)
    return rows.withColumns({"org": part(1), "model": part(2), "run": F.nullif(part(3), F.lit("")).cast("int")})


def latest_files(files: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """Of each key the file with the latest timestamp in its name; files without one come before all others."""
    order = F.struct(F.coalesce(file_timestamp(F.col(path)), F.lit("0001-01-01").cast("timestamp")), F.col(path))
    return files.groupBy(*keys).agg(F.max_by(path, order).alias(path))


def versions(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Rows of several files with the first version that holds them: version k is the union of the first k files."""
    parts = [read_jsonl(spark, p, schema).withColumn("since", F.lit(k)) for k, p in enumerate(paths, 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _each(df: DataFrame, value: Column) -> DataFrame:
    """``ix`` and ``score``: a value's numbers one by one, be it one number, null, or a JSON list of them."""
    numbers = F.coalesce(F.when(F.ltrim(value).startswith("["), F.from_json(value, "array<double>")), F.array(value.try_cast("double")))
    return df.select("*", F.posexplode(numbers).alias("ix", "score"))


def first_scores(df: DataFrame, scores: str = "individual_scores") -> DataFrame:
    """``metric``, ``ix`` and ``score``: what a record holds under its first metric, lists one by one, null as 0. Records without scores go."""
    rows = df.withColumn("metric", F.get(F.map_keys(scores), F.lit(0))).where("metric IS NOT NULL")
    return _each(rows, F.col(scores)[F.col("metric")]).withColumn("score", F.coalesce("score", F.lit(0.0)))


def named_scores(df: DataFrame, metric: Column, scores: str = "individual_scores") -> DataFrame:
    """``ix`` and ``score`` under a metric chosen for each record; nulls go. Log-probabilities are read as the accuracy of their probabilities."""
    name = F.when(metric == "logprobs", "probabilities_accuracy").otherwise(metric)
    return _each(df, F.try_element_at(F.col(scores), name)).where("score IS NOT NULL")


def unread(rows: DataFrame, corrupt: str = "_corrupt_record") -> DataFrame:
    """Lines that a permissive reader could not read, as data to report."""
    return rows.where(F.col(corrupt).isNotNull()).select("path", F.col(corrupt).alias("line"))


def judge_keys(df: DataFrame, packed: str = "custom_id") -> DataFrame:
    """``item``, ``turn`` and ``criterion`` from ids such as ``x_1_turn0_criteria3``; an item's own name may hold the separator."""
    part = lambda g: F.regexp_extract(packed, r"^(.*?)(?:_turn(\d+))?(?:_criteria(\d+))?$", g)
    number = lambda g: F.nullif(part(g), F.lit("")).cast("int")
    return df.withColumns({"item": part(1), "turn": number(2), "criterion": number(3)})


def read_cached(spark: SparkSession, path: str, schema: str = RESPONSES) -> DataFrame | None:
    """Results of an earlier run, ``path`` with .jsonl or .csv; None if there are none."""
    for suffix, reader in ((".jsonl", read_jsonl), (".csv", read_csv)):
        if _exists(spark, path + suffix):
            return reader(spark, path + suffix, schema)
    return None


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path).schema  # noqa: B018
    except AnalysisException:
        return False
    return True


def read_zipped_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, text) of the files in zip archives; names in composed form, without folders."""

    def run(batches):
        for batch in batches:
            out = []
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for info in z.infolist():
                        if not info.is_dir():
                            name = unicodedata.normalize("NFC", info.filename).rpartition("/")[2]
                            out.append((archive, name, z.read(info).decode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(3)], ["path", "name", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, name string, text string")


def line_counts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, n, first): lines of each file, and the first of them, from one pass that keeps one row per file."""
    rows = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    rows = rows.withColumn("at", F.monotonically_increasing_id())
    return rows.groupBy("path").agg(F.count("*").alias("n"), F.min_by("value", F.struct("block", "at")).alias("first"))


def split_ids(df: DataFrame, column: str, names: Iterable[str], sep: str = "_") -> DataFrame:
    """A packed id's last parts as columns of their own; what is left over stays in the first."""
    names = list(names)
    pattern = "^(.*)" + "".join(rf"{sep}([^{sep}]*)" for _ in names[1:]) + "$"
    return df.withColumns({n: F.regexp_extract(column, pattern, k) for k, n in enumerate(names, 1)})


# --------------------------------------------------------------------- writers
def write_jsonl(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """One folder per value of ``by``, each written by few tasks."""
    rows = df.repartition(*by) if by else df
    (rows.write.partitionBy(*by) if by else rows.write).mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    rows = df.repartition(*by) if by else df
    (rows.write.partitionBy(*by) if by else rows.write).mode("overwrite").parquet(path)


def write_batches(df: DataFrame, path: str, id_column: str, prompt: str, model: str) -> None:
    """Requests for a batch service, one JSON object a line."""
    body = F.struct(F.lit(model).alias("model"), F.array(F.struct(F.lit("user").alias("role"), F.col(prompt).alias("content"))).alias("messages"))
    df.select(F.to_json(F.struct(F.col(id_column).cast("string").alias("custom_id"), body.alias("body"))).alias("value")).write.mode("overwrite").text(path)


def metrics_tree(df: DataFrame, levels: list[str], value: str) -> DataFrame:
    """One row: the metrics as nested JSON objects, the first level outermost."""
    rows = df.select(*levels, F.col(value).cast("double").cast("string").alias("_json"))
    for depth in range(len(levels) - 1, -1, -1):
        name = F.regexp_replace(F.to_json(F.array(F.col(levels[depth]).cast("string"))), r"^\[|\]$", "")
        pair = F.concat(name, F.lit(":"), F.coalesce("_json", F.lit("null")))
        rows = rows.withColumn("_pair", pair).groupBy(*levels[:depth]).agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list("_pair")), ","), F.lit("}")).alias("_json"))
    return rows.select(F.col("_json").alias("metrics"))


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One small file, such as a configuration or a report; ends with a newline."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def yaml_lines(value, depth: int = 0) -> list[str]:
    """Nested dicts and lists of plain values as YAML, each plain value written as JSON, which YAML includes."""
    pad = "  " * depth
    plain = lambda x: json.dumps(x, ensure_ascii=False)
    if isinstance(value, dict) and value:
        pairs = [(f"{pad}{plain(str(k))}:", v) for k, v in value.items()]
    elif isinstance(value, list) and value:
        pairs = [(f"{pad}-", v) for v in value]
    else:
        return [f"{pad}{plain(value)}"]
    out = []
    for head, v in pairs:
        out += [head, *yaml_lines(v, depth + 1)] if isinstance(v, (dict, list)) and v else [f"{head} {plain(v)}"]
    return out


def write_yaml(spark: SparkSession, value: dict, path: str) -> None:
    write_text(spark, "\n".join(yaml_lines(value)), path)


def write_metrics(df: DataFrame, levels: list[str], value: str, path: str) -> None:
    """The metrics tree of all tasks so far, in place of the last one: call it after each task, and a run can go on from there."""
    metrics_tree(df, levels, value).coalesce(1).write.mode("overwrite").text(path)


def write_ratings(path: str, **reports: DataFrame) -> None:
    """One CSV folder for each report of a rating: results, outcomes, bootstraps, p-values, failures."""
    for name, df in reports.items():
        write_csv(df, f"{path}/{name}")


def failures(expected: DataFrame, found: DataFrame, keys: list[str], reason: str) -> DataFrame:
    """What was to be loaded and is not there, with a reason."""
    return expected.join(found, keys, "left_anti").withColumn("reason", F.lit(reason))


def write_rouge(scores: DataFrame, path: str, measures: tuple[str, ...] = ("precision", "recall", "f1")) -> None:
    """Scores by pair, or (measure, low, mid, high), as CSV."""
    kept = ["measure", "low", "mid", "high"] if "measure" in scores.columns else ["item_id", "ref_ix", *measures]
    write_csv(scores.select(*kept), path)
