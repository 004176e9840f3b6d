"""Files there and back, and streams of them."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from gradus.operators import items
from gradus.sources import configs, files
from gradus.streaming import scores


def test_jsonl(spark, tmp_path):
    rows = [{"id": "1", "label": "a", "prompts": [{"text": "é"}], "metadata": {"language": "my"}}, {"id": "2", "label": None}]
    (tmp_path / "x.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    df = files.read_jsonl(spark, str(tmp_path / "x.jsonl"))
    assert [(r.id, r.label) for r in df.orderBy("id").collect()] == [("1", "a"), ("2", None)]
    files.write_jsonl(df, str(tmp_path / "out"), ["label"])
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    counts = files.line_counts(spark, str(tmp_path / "x.jsonl")).first()
    assert counts.n == 2 and json.loads(counts.first)["id"] == "1"


def test_run_files(spark, tmp_path):
    for run, score in ((0, "0.5"), (1, None)):
        d = tmp_path / "org" / "m" / f"run_{run}"
        d.mkdir(parents=True)
        (d / "task.jsonl").write_text(json.dumps({"custom_id": "q_1_7", "individual_scores": {"b": "9", "a": score}}))
    df = files.first_scores(files.read_run_files(spark, str(tmp_path / "*/*/*/*.jsonl")))
    assert {(r.org, r.model, r.run, r.metric, r.score) for r in df.collect()} == {("org", "m", 0, "b", 9.0), ("org", "m", 1, "b", 9.0)}
    ids = files.split_ids(df.limit(1), "custom_id", ["id", "turn", "criterion"]).first()
    assert (ids.id, ids.turn, ids.criterion) == ("q", "1", "7")


def test_latest(spark):
    rows = [("m", "c_2024-01-01T00:00:00.000001.yaml"), ("m", "c_2024-01-01T00:00:00.000002.yaml"), ("m", "c.yaml"), ("n", "d.yaml")]
    found = files.latest_files(spark.createDataFrame(rows, "model string, path string"), ["model"])
    assert {(r.model, r.path) for r in found.collect()} == {("m", rows[1][1]), ("n", "d.yaml")}


def test_texts_and_words(spark, tmp_path):
    (tmp_path / "a.txt").write_text("b  c\nb  c\n\n a \n")
    assert sorted(r.word for r in files.read_words(spark, str(tmp_path / "a.txt")).collect()) == ["a", "b  c"]
    assert files.read_texts(spark, str(tmp_path)).first().text == "b c\nb c\n\n a \n"
    (tmp_path / "v.tsv").write_text("en\tfr\ncat\tchat\n")
    assert files.read_tsv_column(spark, str(tmp_path / "v.tsv"), "fr").first().word == "chat"
    assert files.read_binaries(spark, str(tmp_path), "*.tsv").first().size == 15


def test_versions(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"{k}.jsonl").write_text(json.dumps({"id": str(k)}))
    df = files.versions(spark, [str(tmp_path / "1.jsonl"), str(tmp_path / "2.jsonl")], files.ITEMS)
    assert df.where("since <= 1").count() == 1 and df.where("since <= 2").count() == 2


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("en", "t1", 1.5), ("en", 't"2', None), ("fr", "t1", 2.0)], "lang string, task string, score double")
    tree = json.loads(files.metrics_tree(df, ["lang", "task"], "score").first().metrics)
    assert tree == {"en": {"t1": 1.5, 't"2': None}, "fr": {"t1": 2.0}}
    files.write_csv(df, str(tmp_path / "c"))
    back = files.read_csv(spark, str(tmp_path / "c"), "lang string, task string, score double")
    assert sorted(back.select("lang", "score").collect(), key=str) == sorted(df.select("lang", "score").collect(), key=str)
    files.write_batches(df, str(tmp_path / "b"), "task", "lang", "some-model")
    sent = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "b")).collect()]
    assert {x["custom_id"] for x in sent} == {"t1", 't"2'} and sent[0]["body"]["messages"][0]["role"] == "user"
    files.write_parquet(df, str(tmp_path / "p"), ["lang"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3


def test_stream(spark, tmp_path):
    schema = "model string, ts timestamp, score double"
    folder = tmp_path / "in"
    folder.mkdir()

    def add(name, rows):
        (folder / name).write_text("\n".join(json.dumps({"model": m, "ts": t, "score": s}) for m, t, s in rows))

    def drain():
        means = scores.windowed_means(scores.read_stream(spark, str(folder), schema), ["model"], "ts", "score")
        scores.write_table(means, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()

    add("1.json", [("a", "2024-01-01T00:10:00", 1.0), ("a", "2024-01-01T00:20:00", 2.0), ("b", "2024-01-01T00:30:00", 5.0)])
    add("2.json", [("a", "2024-01-01T05:00:00", 9.0)])
    drain()
    add("3.json", [("a", "2024-01-01T00:15:00", 100.0), ("a", "2024-01-01T09:00:00", 1.0)])  # the first one comes too late
    drain()
    out = spark.read.parquet(str(tmp_path / "out")).groupBy("model", "start").agg(F.first("mean").alias("mean"), F.count("*").alias("k"))
    found = {(r.model, r.start.hour): (r["mean"], r.k) for r in out.collect()}
    assert found[("a", 0)] == (1.5, 1) and found[("b", 0)] == (5.0, 1) and found[("a", 5)] == (9.0, 1)


def test_scores_of_records(spark):
    rows = [("x", {"b": "[1, null, 2.5]", "a": "7"}), ("y", {"logprobs": None}), ("z", {}), ("w", {"probabilities_accuracy": "0.5"})]
    df = spark.createDataFrame([(i, json.dumps(m)) for i, m in rows], "id string, raw string")
    df = df.select("id", F.from_json("raw", "map<string,string>").alias("individual_scores"))
    assert sorted((r.id, r.ix, r.score) for r in files.first_scores(df).collect()) == [("w", 0, 0.5), ("x", 0, 1.0), ("x", 1, 0.0), ("x", 2, 2.5), ("y", 0, 0.0)]
    assert [(r.id, r.score) for r in files.named_scores(df, F.lit("logprobs")).collect()] == [("w", 0.5)]
    ids = spark.createDataFrame([("my_item_1_turn0_criteria12",), ("a_criteria3",), ("plain",)], "custom_id string")
    assert [(r["item"], r.turn, r.criterion) for r in files.judge_keys(ids).collect()] == [("my_item_1", 0, 12), ("a", None, 3), ("plain", None, None)]


def test_cached_results_and_archives(spark, tmp_path):
    assert files.read_cached(spark, str(tmp_path / "none")) is None
    (tmp_path / "r.jsonl").write_text(json.dumps({"custom_id": "1", "model": "m"}))
    (tmp_path / "s.csv").write_text("custom_id,model\n2,n\n")
    assert files.read_cached(spark, str(tmp_path / "r")).first().model == "m"
    assert files.read_cached(spark, str(tmp_path / "s"), "custom_id string, model string").first().model == "n"
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("folder/e\u0301.txt", "text one")
        z.writestr("b.txt", "two")
    found = {r.name: r.text for r in files.read_zipped_texts(spark, str(tmp_path / "d.zip")).collect()}
    assert found == {"\u00e9.txt": "text one", "b.txt": "two"}


def test_reports(spark, tmp_path):
    tree = {"a": {"b": [1, "x: y"], "c": None}, "d": [], "e": 1.5, "f": [{"g": "h"}, [1, 2]]}
    files.write_yaml(spark, tree, str(tmp_path / "y"))
    written = spark.read.text(str(tmp_path / "y"), wholetext=True).first().value
    assert written == '"a":\n  "b":\n    - 1\n    - "x: y"\n  "c": null\n"d": []\n"e": 1.5\n"f":\n  -\n    "g": "h"\n  -\n    - 1\n    - 2\n'
    scores = spark.createDataFrame([("en", "t1", 1.0)], "lang string, task string, score double")
    for extra in ([], [("en", "t2", 2.0)]):
        files.write_metrics(scores.union(spark.createDataFrame(extra, scores.schema)), ["lang", "task"], "score", str(tmp_path / "m"))
    assert json.loads(spark.read.text(str(tmp_path / "m")).first().value) == {"en": {"t1": 1.0, "t2": 2.0}}
    gone = files.failures(scores.select("task").union(spark.createDataFrame([("t9",)], "task string")), scores, ["task"], "no file")
    files.write_ratings(str(tmp_path / "csv"), results=scores, failures=gone)
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "csv/failures"), header=True).collect()] == [("t9", "no file")]
    files.write_rouge(spark.createDataFrame([("f1", 0.1, 0.2, 0.3)], "measure string, low double, mid double, high double"), str(tmp_path / "rouge"))
    assert spark.read.csv(str(tmp_path / "rouge"), header=True).columns == ["measure", "low", "mid", "high"]


def test_configs(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.json").write_text(json.dumps({"size": 5, "tasks": {"t1": {"languages": {"en": 1}, "n": "${size}", "text": "has ${size}"}, "t2": {"languages": ["fr"], "aggregation_group": "g"}}}))
    (tmp_path / "sub" / "b.json").write_text(json.dumps({"tasks": {"t1": {"languages": {"de": 1}, "tags": ["x"]}, "t2": {"languages": ["fr", "es"]}}}))
    tree = configs.read_configs(spark, str(tmp_path))
    assert tree["tasks"]["t1"] == {"languages": {"en": 1, "de": 1}, "n": 5, "text": "has 5", "tags": ["x"]} and tree["tasks"]["t2"]["languages"] == ["fr", "es"]
    pairs = items.task_languages(configs.task_table(spark, tree).select("task", "alias", "languages")).collect()
    assert {(r.task, r.alias, r.lang) for r in pairs} == {("t1", None, "en"), ("t1", None, "de"), ("t2", "g", "fr"), ("t2", "g", "es")}
    with pytest.raises(ValueError):
        configs.resolved({"a": "${b}", "b": "${a}"})
