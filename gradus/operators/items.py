"""Preparation of items: selection, options, labels, renaming, examples and documents beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions.draws import RANGE, draw
from gradus.operators.numbering import numbered, placed


def limited(df: DataFrame, by: list[str], key: str, n: int) -> DataFrame:
    """The first n rows of each group in order of a numeric key, or all that there are."""
    return numbered(df, by, key, "_place").where(F.col("_place") < n).drop("_place")


def without_null_responses(df: DataFrame, responses: str) -> DataFrame:
    """Rows none of whose turns' responses is null; a null list counts as one."""
    return df.where(F.coalesce(~F.exists(responses, lambda r: r.isNull()), F.lit(False)))


def answered(df: DataFrame, prior: str, answer: Column) -> DataFrame:
    """``response``: the answer to each conversation, empty for those whose prior turn has none, in place."""
    return df.withColumn("response", F.when(F.col(prior).isNull(), F.lit("")).otherwise(answer))


def balanced_places(df: DataFrame, by: list[str], key: str, n: int, seed: int) -> DataFrame:
    """``answer_at``: a place from 0 to n - 1 for each row's answer, as often as each other in every group, in an order drawn by hash."""
    rows = df.withColumn("_draw", draw(seed, key))
    rows = placed(rows, by, ["_draw", key], F.floor(F.col("_draw") / (RANGE // 64)), "_place")
    return rows.withColumn("answer_at", (F.col("_place") % n).cast("int")).drop("_draw", "_place")


def shuffled(options: Column, key: str, seed: int) -> Column:
    """Options in an order drawn by hash of the row's key and their place."""
    drawn = F.transform(options, lambda o, i: F.struct(draw(seed, key, i).alias("d"), i.alias("i"), o.alias("o")))
    return F.transform(F.array_sort(drawn), lambda x: x["o"])


def repaired_labels(df: DataFrame, status: str, label: str, corrected: str, n: int, good: str = "ok", wrong: str = "wrong_groundtruth") -> DataFrame:
    """Rows with good labels, and those with a wrong one and a correction from 0 to n - 1, which replaces it; others go."""
    fixed = F.col(corrected).try_cast("int")
    new = F.when(F.col(status) == good, F.col(label)).when((F.col(status) == wrong) & fixed.between(0, n - 1), fixed)
    return df.withColumn(label, new).where(F.col(label).isNotNull())


def corrected(df: DataFrame, key: str, patches: dict, column: str) -> DataFrame:
    """Single values of a column set by the row's key."""
    out = F.col(column)
    for k, value in patches.items():
        out = F.when(F.col(key) == k, F.lit(value)).otherwise(out)
    return df.withColumn(column, out)


def cleaned(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Replacements by pattern, one after the other."""
    for pattern, new in rules:
        text = F.regexp_replace(text, pattern, new)
    return text


def mapped(df: DataFrame, columns: dict[str, str | Column], metadata: list[str] | None = None) -> DataFrame:
    """A task's own columns under the names that all tasks share, and some of them as a map of strings."""
    out = [(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()]
    if metadata:
        out.append(F.create_map(*[x for m in metadata for x in (F.lit(m), F.col(m).cast("string"))]).alias("metadata"))
    return df.select(*out)


def localised(flag: Column, yes: str, no: str) -> Column:
    return F.when(flag, yes).when(~flag, no)


def converted(text: Column, table: dict[str, str]) -> Column:
    """Character by character; others stay."""
    return F.translate(text, "".join(table), "".join(table.values()))


def with_examples(items: DataFrame, examples: DataFrame, subject: str, key: str, k: int) -> DataFrame:
    """``examples``: the first k examples of the item's subject, in order; an item of a subject without any has an empty list."""
    some = limited(examples, [subject], key, k).groupBy(F.col(subject).alias("_subject"))
    lists = some.agg(F.array_sort(F.collect_list(F.struct(key, *[c for c in examples.columns if c != key]))).alias("examples"))
    kind = lists.schema["examples"].dataType.simpleString()
    joined = items.join(lists, F.col(subject) == F.col("_subject"), "left").drop("_subject")
    return joined.withColumn("examples", F.coalesce("examples", F.array().cast(kind)))


def bundled(questions: DataFrame, key: str, names: str, documents: DataFrame, name: str, text: str, sep: str = ";") -> DataFrame:
    """``documents``: the texts of the documents that a question names, in the order named; unknown names are left out."""
    asked = questions.select(key, F.posexplode(F.split(names, sep)).alias("_at", "_name")).withColumn("_name", F.trim("_name"))
    known = documents.select(F.col(name).alias("_name"), F.col(text).alias("_text"))
    lists = asked.join(known, "_name").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", "_text"))).alias("_found"))
    joined = questions.join(lists, key, "left")
    return joined.withColumn("documents", F.coalesce(F.transform("_found", lambda x: x["_text"]), F.array().cast("array<string>"))).drop("_found")


def baseline_of(baselines: Column, model: str) -> Column:
    """The baseline model's answer; null if there is none."""
    return F.try_element_at(baselines, F.lit(model))


def stale(judgements: DataFrame, inputs: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Judgements whose inputs are gone or have been made anew since, by a hash of them."""
    return judgements.join(inputs, [*keys, version], "left_anti")


# ------------------------------------------------------------------ which tasks
def task_languages(configs: DataFrame, task: str = "task", languages: str = "languages") -> DataFrame:
    """One row per task and language from a map or an array of languages."""
    kind = configs.schema[languages].dataType.typeName()
    names = F.map_keys(languages) if kind == "map" else F.col(languages)
    return configs.select(*[c for c in configs.columns if c != languages], F.explode(names).alias("lang")).distinct()


def resolved(requests: DataFrame, tasks: DataFrame, aliases: DataFrame, every: str = "all") -> DataFrame:
    """(lang, task): what is asked for, of what there is.

    ``requests`` are (lang, name), where a name is a task, an alias of several, or
    ``every``; ``tasks`` are (lang, task), ``aliases`` (name, task). A task asked for in
    several ways counts once; unknown names and languages go.
    """
    named = requests.where(F.col("name") != every)
    direct = named.select("lang", F.col("name").alias("task"))
    by_alias = named.join(aliases, "name").select("lang", "task")
    whole = requests.where(F.col("name") == every).select("lang").join(tasks, "lang").select("lang", "task")
    return direct.unionByName(by_alias).unionByName(whole).distinct().join(tasks, ["lang", "task"], "left_semi")


def valid(tasks: DataFrame, known: DataFrame, skipped: DataFrame, keys: list[str]) -> DataFrame:
    return tasks.join(known, keys, "left_semi").join(skipped, keys, "left_anti")
