"""Preparation of items, prompts from them, and what is read from records."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradus.functions import text
from gradus.functions.draws import divided, draw, draw_sql
from gradus.operators import answers, items, prompts
from gradus.plans import tables
from gradus.plans.registry import Registry
from gradus.plans.tables import read, sql
from gradus.sources import files

REGISTRY = Registry()
query = REGISTRY.query


def documents(spark, sf_dir):
    return read(spark, sf_dir, "documents")


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5")
def limited_items(spark, sf_dir):
    return items.limited(documents(spark, sf_dir).select("source", "doc_id"), ["source"], "doc_id", 5)


@query("SELECT doc_id FROM documents WHERE doc_id % 7 <> 0 AND source IS NOT NULL")
def complete_responses(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.array("source", F.when(F.col("doc_id") % 7 != 0, "x")).alias("responses"))
    return items.without_null_responses(rows, "responses").select("doc_id")


@query("SELECT conv_id, turn, CASE WHEN turn > 0 AND (conv_id + turn) % 9 = 0 THEN '' ELSE 'r' || length(text) END AS response FROM conversations")
def answered_turns(spark, sf_dir):
    """Conversations without a prior answer are skipped and come back empty."""
    prior = F.when((F.col("turn") > 0) & ((F.col("conv_id") + F.col("turn")) % 9 == 0), F.lit(None)).otherwise("x")
    rows = read(spark, sf_dir, "conversations").withColumn("prior", prior)
    return items.answered(rows, "prior", F.concat(F.lit("r"), F.length("text").cast("string"))).select("conv_id", "turn", "response")


_SHUFFLED = "[x.o FOR x IN list_sort([{{'d': {d0}, 'i': 0, 'o': 'x'}}, {{'d': {d1}, 'i': 1, 'o': 'y'}}, {{'d': {d2}, 'i': 2, 'o': 'z'}}])]".format(**{f"d{i}": draw_sql("18", "doc_id", str(i)) for i in range(3)})


def _balanced(by: str, n: int) -> str:
    return f"""SELECT doc_id, answer_at, array_to_string(list_concat(list_concat(w[1:answer_at], [source]), w[answer_at + 1:]), ',') AS options FROM (SELECT doc_id, source, {_SHUFFLED} AS w,
    ((row_number() OVER (PARTITION BY {by} ORDER BY {draw_sql("19", "doc_id")}, doc_id) - 1) % {n})::INT AS answer_at FROM documents)"""


def balanced(spark, sf_dir, by, n):
    rows = items.balanced_places(documents(spark, sf_dir).select("doc_id", "source", "lang"), by, "doc_id", n, 19)
    options = F.array_insert(items.shuffled(F.array(*map(F.lit, "xyz")), "doc_id", 18), F.col("answer_at") + 1, F.col("source"))
    return rows.select("doc_id", "answer_at", F.array_join(options, ",").alias("options"))


@query(_balanced("source", 4))
def balanced_options(spark, sf_dir):
    """The answer at each of four places as often as at each other, within every source; the distractors shuffled by row."""
    return balanced(spark, sf_dir, ["source"], 4)


@query(_balanced("lang, source", 3))
def block_balanced_options(spark, sf_dir):
    """The same by blocks of language and source."""
    return balanced(spark, sf_dir, ["lang", "source"], 3)


@query("SELECT doc_id, CASE WHEN quality = 1 THEN toxic::INT ELSE (doc_id % 6)::INT END AS label FROM labels WHERE quality = 1 OR (doc_id % 6 < 4 AND doc_id % 5 <> 0)")
def repaired_labels(spark, sf_dir):
    """Good labels stay, wrong ones with a usable correction get it, the rest goes."""
    status = F.when(F.col("quality") == 1, "ok").when(F.col("doc_id") % 5 != 0, "wrong_groundtruth").otherwise("bad_question")
    rows = read(spark, sf_dir, "labels").select("doc_id", status.alias("status"), F.col("toxic").cast("int").alias("label"), (F.col("doc_id") % 6).cast("string").alias("fix"))
    return items.repaired_labels(rows, "status", "label", "fix", 4).select("doc_id", "label")


@query(
    r"""SELECT doc_id AS id, CASE WHEN doc_id = 7 THEN 'patched' ELSE translate(regexp_replace(regexp_replace(text, '\s*[.]$', ''), '\s+', ' ', 'g'), 'éäß', 'ea$') END AS question,
    CASE WHEN doc_id % 2 = 0 THEN 'Benar' ELSE 'Salah' END AS label, source AS task_source, n_chars::VARCHAR AS task_n_chars FROM documents"""
)
def mapped_columns(spark, sf_dir):
    """Columns renamed, cleaned and converted, labels in a language, one row corrected, some columns as metadata."""
    clean = items.converted(items.cleaned(F.col("text"), [(r"\s*[.]$", ""), (r"\s+", " ")]), {"é": "e", "ä": "a", "ß": "$"})
    rows = items.mapped(documents(spark, sf_dir), {"id": "doc_id", "question": clean, "label": items.localised(F.col("doc_id") % 2 == 0, "Benar", "Salah")}, ["source", "n_chars"])
    rows = items.corrected(rows, "id", {7: "patched"}, "question")
    return rows.select("id", "question", "label", F.col("metadata")["source"].alias("task_source"), F.col("metadata")["n_chars"].alias("task_n_chars"))


_EX = "ex AS (SELECT source, string_agg(doc_id || '=' || lang, ';' ORDER BY doc_id) AS shots FROM (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 2) GROUP BY source)"


@query(f"WITH {_EX} SELECT doc_id, coalesce(shots, '') AS shots FROM documents d LEFT JOIN ex ON d.source = ex.source")
def items_with_examples(spark, sf_dir):
    """The first two documents of an item's source, in order."""
    d = documents(spark, sf_dir).select("doc_id", "source", "lang")
    rows = items.with_examples(d.select("doc_id", "source"), d, "source", "doc_id", 2)
    shots = F.transform("examples", lambda e: F.concat(e["doc_id"].cast("string"), F.lit("="), e["lang"]))
    return rows.select("doc_id", F.array_join(shots, ";").alias("shots"))


@query(
    """SELECT q.doc_id, coalesce((SELECT string_agg(b.text, '|' ORDER BY n.at) FROM (SELECT unnest([0, 1, 2]) AS at, unnest([q.doc_id % 7, q.doc_id * 3 % 11, 1000000]) AS id) n JOIN benchmark b ON b.item_id = n.id), '') AS bundle FROM documents q"""
)
def document_bundles(spark, sf_dir):
    """Questions beside the documents that they name; the last name is unknown."""
    names = F.concat_ws("; ", *[F.concat(F.lit("b"), x.cast("string")) for x in (F.col("doc_id") % 7, F.col("doc_id") * 3 % 11, F.lit(1000000))])
    known = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("name"), "text")
    rows = items.bundled(documents(spark, sf_dir).select("doc_id", names.alias("names")), "doc_id", "names", known, "name", "text")
    return rows.select("doc_id", F.array_join("documents", "|").alias("bundle"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN source END AS baseline FROM documents")
def baseline_answers(spark, sf_dir):
    """An item's answers by model, one of which is the baseline."""
    held = F.when(F.col("doc_id") % 3 != 0, F.create_map(F.lit("base"), F.col("source"), F.lit("other"), F.col("lang"))).otherwise(F.create_map(F.lit("other"), F.col("lang")))
    return documents(spark, sf_dir).select("doc_id", items.baseline_of(held, "base").alias("baseline"))


@query("SELECT doc_id FROM documents WHERE doc_id % 10 = 0")
def stale_judgements(spark, sf_dir):
    """Judgements of texts that have changed since."""
    d = documents(spark, sf_dir)
    old = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return items.stale(d.select("doc_id", F.md5(old).alias("version")), d.select("doc_id", F.md5("text").alias("version")), ["doc_id"], "version").select("doc_id")


# ------------------------------------------------------------------ which tasks
_TASKS = "tk AS (SELECT DISTINCT lang, source AS task FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)"


def tasks(spark, sf_dir):
    found = documents(spark, sf_dir).where("lang IS NOT NULL AND source IS NOT NULL")
    return items.task_languages(found.groupBy(F.col("source").alias("task")).agg(F.collect_set("lang").alias("languages")))


@query(f"WITH {_TASKS} SELECT lang, task FROM tk")
def task_languages(spark, sf_dir):
    return tasks(spark, sf_dir).select("lang", "task")


@query(f"WITH {_TASKS} SELECT lang, task FROM tk WHERE lang = 'fr' OR (lang = 'en' AND (task = 'src3' OR substr(task, 4)::BIGINT < 5))")
def task_set_resolution(spark, sf_dir):
    """Everything of one language, a task and an alias of another, and unknown names, which go."""
    known = tasks(spark, sf_dir)
    asked = spark.createDataFrame([("fr", "all"), ("fr", "src3"), ("en", "src3"), ("en", "low"), ("en", "nothing"), ("xx", "all")], "lang string, name string")
    aliases = known.where(F.substring("task", 4, 9).cast("long") < 5).select(F.lit("low").alias("name"), "task").distinct()
    return items.resolved(asked, known, aliases)


@query(f"WITH {_TASKS} SELECT lang, task FROM tk WHERE task <> 'src2' AND lang <> 'de' AND NOT (lang = 'es' AND task = 'src1')")
def valid_tasks(spark, sf_dir):
    """Known tasks that the skip list does not name."""
    known = tasks(spark, sf_dir).select("lang", "task")
    asked = known.unionByName(spark.createDataFrame([("en", "unknown")], "lang string, task string"))
    skipped = known.where("task = 'src2' OR lang = 'de' OR (lang = 'es' AND task = 'src1')")
    return items.valid(asked, known, skipped, ["lang", "task"])


@query("SELECT DISTINCT lang, 'cfg' || (substr(source, 4)::BIGINT % 3) AS config FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def distinct_parameters(spark, sf_dir):
    """Pairs of reader and configuration that several judges share."""
    rows = documents(spark, sf_dir).where("lang IS NOT NULL AND source IS NOT NULL")
    return rows.select("lang", F.concat(F.lit("cfg"), (F.substring("source", 4, 9).cast("long") % 3).cast("string")).alias("config")).distinct()


@query("SELECT DISTINCT word FROM (SELECT unnest(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS word FROM documents WHERE text IS NOT NULL) WHERE word <> '' ORDER BY word")
def sorted_words(spark, sf_dir):
    words = F.explode(F.split(text.collapse(F.col("text")), " ")).alias("word")
    return documents(spark, sf_dir).select(words).where("word <> ''").distinct().orderBy("word")


# ------------------------------------------------------------------ prompts
@query(
    f"""WITH {_EX.replace("doc_id || '=' || lang, ';'", "'user: q' || doc_id || chr(10) || 'assistant: ' || lang, chr(10)")} SELECT doc_id, CASE WHEN shots IS NULL THEN 'user: Be brief.' || chr(10) || chr(10) || text ELSE replace(shots, shots, 'user: Be brief.' || chr(10) || chr(10) || substr(shots, 7)) || chr(10) || 'user: ' || text END AS prompt
    FROM documents d LEFT JOIN ex ON d.source = ex.source"""
)
def few_shot_prompts(spark, sf_dir):
    """Examples of the item's source as turns, a preamble before the first, then the item."""
    d = documents(spark, sf_dir)
    shots = d.select("doc_id", "source", F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("question"), F.col("lang").alias("answer"))
    rows = items.with_examples(d.select("doc_id", "source", "text"), shots, "source", "doc_id", 2)
    turns = prompts.conversation(F.col("examples"), F.col("text"), "Be brief.")
    return rows.select("doc_id", F.array_join(F.transform(turns, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("prompt"))


@query(
    """SELECT doc_id, 'Conversation:' || chr(10) || 'user: ' || lang || chr(10) || 'assistant: ' || text || chr(10) || chr(10) || 'Criterion (' || (doc_id % 5 - 2) || ' points): ' || source AS prompt FROM documents"""
)
def rubric_prompts(spark, sf_dir):
    """A judge's prompt with the conversation and one criterion of a rubric with its points."""
    turns = F.array(prompts.message("user", F.col("lang")), prompts.message("assistant", F.col("text")))
    return documents(spark, sf_dir).select("doc_id", prompts.JUDGE_PROMPTS["rubric"](turns, F.col("source"), F.col("doc_id") % 5 - 2).alias("prompt"))


@query(
    """SELECT doc_id, t AS turn, CASE t WHEN 1 THEN 'Question 1: one' || chr(10) || 'Answer 1: ' || lang ELSE 'Question 1: one' || chr(10) || 'Answer 1: ' || lang || chr(10) || 'Question 2: two' || chr(10) || 'Answer 2: ' || source END AS prompt
    FROM documents, (SELECT unnest([1, 2])::INT AS t)"""
)
def transcript_prompts(spark, sf_dir):
    """A judge's prompt for each turn, the later one with all before it."""
    rows = documents(spark, sf_dir).select("doc_id", F.array(F.lit("one"), F.lit("two")).alias("q"), F.array("lang", "source").alias("a"))
    return prompts.transcripts(rows, "q", "a").select("doc_id", "turn", "prompt")


# ------------------------------------------------------------------ records
_RECORD = "'{{\"' || CASE WHEN doc_id % 2 = 0 THEN 'b' ELSE 'a' END || '\": ' || CASE doc_id % 3 WHEN 0 THEN 'null' WHEN 1 THEN (doc_id % 10)::VARCHAR ELSE '[1, null, ' || (doc_id % 7) || ']' END || ', \"c\": 5}}'"


def records(spark, sf_dir):
    """Scores of a record as JSON: one number, null, or a list."""
    i = F.col("doc_id")
    value = F.when(i % 3 == 0, "null").when(i % 3 == 1, (i % 10).cast("string")).otherwise(F.concat(F.lit("[1, null, "), (i % 7).cast("string"), F.lit("]")))
    raw = F.concat(F.lit('{"'), F.when(i % 2 == 0, "b").otherwise("a"), F.lit('": '), value, F.lit(', "c": 5}'))
    return documents(spark, sf_dir).select("doc_id", F.from_json(raw, "map<string,string>").alias("individual_scores"))


_EACH = "CASE WHEN doc_id % 3 = 0 THEN [{zero}] WHEN doc_id % 3 = 1 THEN [(doc_id % 10)::DOUBLE] ELSE [1, {zero}, (doc_id % 7)::DOUBLE] END"


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'b' ELSE 'a' END AS metric, unnest({_EACH.format(zero='0')}) AS score, unnest(range(CASE WHEN doc_id % 3 = 2 THEN 3 ELSE 1 END))::INT AS ix FROM documents", "score")
def first_metric_scores(spark, sf_dir):
    """Scores under a record's first metric, lists one by one, null as 0."""
    return files.first_scores(records(spark, sf_dir)).select("doc_id", "metric", "ix", "score")


@query(f"SELECT * FROM (SELECT doc_id, unnest({_EACH.format(zero='NULL')}) AS score, unnest(range(CASE WHEN doc_id % 3 = 2 THEN 3 ELSE 1 END))::INT AS ix FROM documents WHERE doc_id % 2 = 1) WHERE score IS NOT NULL", "score")
def named_metric_scores(spark, sf_dir):
    """Scores under a metric chosen by name; rows without one go."""
    return files.named_scores(records(spark, sf_dir), F.lit("a")).select("doc_id", "ix", "score")


@query("SELECT doc_id, doc_id::VARCHAR AS item, (doc_id % 2)::INT AS turn, (doc_id % 12)::INT AS criterion FROM documents")
def judge_record_keys(spark, sf_dir):
    """Keys packed in a judge's record id, read from its end."""
    packed = F.concat_ws("_", F.lit("task"), F.col("doc_id").cast("string"), F.concat(F.lit("turn"), (F.col("doc_id") % 2).cast("string")), F.concat(F.lit("criteria"), (F.col("doc_id") % 12).cast("string")))
    rows = files.judge_keys(documents(spark, sf_dir).select("doc_id", packed.alias("custom_id")))
    return rows.select("doc_id", F.regexp_replace("item", "^task_", "").alias("item"), "turn", "criterion")


# ------------------------------------------------------------------ extraction
_SAID = "CASE doc_id % 4 WHEN 0 THEN 'so Answer: `' || lang || ' rest' WHEN 1 THEN 'answer: ' || lang WHEN 2 THEN '<think>no</think> Answer:' || chr(10) || lang ELSE ' ' || source || ' ' END"


def said(spark, sf_dir):
    i = F.col("doc_id") % 4
    raw = F.when(i == 0, F.concat(F.lit("so Answer: `"), "lang", F.lit(" rest"))).when(i == 1, F.concat(F.lit("answer: "), "lang")).when(i == 2, F.concat(F.lit("<think>no</think> Answer:\n"), "lang")).otherwise(F.concat(F.lit(" "), "source", F.lit(" ")))
    return documents(spark, sf_dir).where("lang IS NOT NULL AND source IS NOT NULL").select("doc_id", raw.alias("said"))


@query(
    f"""SELECT doc_id, trim(CASE WHEN regexp_matches(s, 'Answer:[\\s\\r\\n`*]*(en|fr|de|es)') THEN regexp_extract(s, 'Answer:[\\s\\r\\n`*]*(en|fr|de|es)', 1) ELSE s END) AS label,
    CASE WHEN contains(s, 'answer: ') THEN substr(s, 9) END AS found, trim(CASE WHEN contains(s, '</think>') THEN regexp_extract(s, '(?s)</think>(.*)', 1) ELSE s END, ' ' || chr(10)) AS final
    FROM (SELECT doc_id, {_SAID} AS s FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)"""
)
def extracted_answers(spark, sf_dir):
    """A label with the case as it is or the whole answer, a tagged pattern or null, and what follows the reasoning."""
    s = F.col("said")
    final = F.trim(text.without_reasoning(s), F.lit(" \n"))
    return said(spark, sf_dir).select("doc_id", text.extract_label(s, ["en", "fr", "de", "es"]).alias("label"), text.with_answer_pattern(s, "answer: ", "([a-z]+)", whole=False).alias("found"), final.alias("final"))


@query("SELECT doc_id, 'int' AS a, doc_id::VARCHAR AS a_value, 'string' AS b, 'x,' || source AS b_value, 'bool' AS c, CASE WHEN doc_id % 2 = 0 THEN 'float' ELSE 'int' END AS d FROM documents WHERE source IS NOT NULL")
def typed_arguments(spark, sf_dir):
    """Arguments with the kinds of their values; a comma in a value stays."""
    raw = F.concat(F.lit("a="), F.col("doc_id").cast("string"), F.lit(",b='x,"), "source", F.lit("',c=TRUE,d="), F.when(F.col("doc_id") % 2 == 0, "-2.5").otherwise("-3"))
    rows = documents(spark, sf_dir).where("source IS NOT NULL").select("doc_id", text.arguments(raw).alias("m"))
    of = lambda k, f: F.col("m")[k][f]
    return rows.select("doc_id", of("a", "kind").alias("a"), of("a", "value").alias("a_value"), of("b", "kind").alias("b"), of("b", "value").alias("b_value"), of("c", "kind").alias("c"), of("d", "kind").alias("d"))


@query("SELECT doc_id, 'x{' || source || '}' AS boxed, 'code ' || lang AS code, make_timestamp(2024, 1, 1 + (doc_id % 28), 3, 4, 5.000006) AS ts FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def extracted_parts(spark, sf_dir):
    """The last box, the last fenced block and the time in a file's name."""
    rows = documents(spark, sf_dir).where("source IS NOT NULL AND lang IS NOT NULL")
    box = F.concat(F.lit(r"\boxed{1} so \boxed{x{"), "source", F.lit("}} end"))
    fence = F.concat(F.lit("```py\nold```\n```\ncode "), "lang", F.lit("```"))
    name = F.concat(F.lit("run_2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit("T03:04:05.000006.yaml"))
    return rows.select("doc_id", text.boxed(box).alias("boxed"), text.fenced_code(fence).alias("code"), text.file_timestamp(name).cast("timestamp_ntz").alias("ts"))


_BARE = r"trim(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~’]', '', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT item_id, array_to_string(list_filter(string_split({_BARE}, ' '), lambda w: w NOT IN ({', '.join(repr(w) for w in text.BELIEF_STOPS)})), ' ') AS belief FROM benchmark")
def belief_forms(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", text.normalize_belief(F.col("text")).alias("belief"))


# ------------------------------------------------------------------ procedures
_NUM = f"n AS (SELECT doc_id, d % 9 + 1 AS a, d // 16 % 9 + 1 AS b, d // 256 % 9 + 1 AS c, d // 4096 % 9 + 1 AS e, d // 65536 % 4 AS kind FROM (SELECT doc_id, {draw_sql('31', 'doc_id')} AS d FROM documents))"


@query(f"WITH {_NUM} SELECT doc_id, kind = 0 AS solved FROM n")
def countdown_solutions(spark, sf_dir):
    """Three equations on four numbers: right, with a number used again, with a wrong result, or short of the target."""
    d = draw(31, "doc_id")
    a, b, c, e = (divided(d, q) % 9 + 1 for q in (1, 16, 256, 4096))
    kind = divided(d, 65536) % 4
    s = lambda x: x.cast("string")
    line = lambda x, op, y, z: F.concat(s(x), F.lit(f" {op} "), s(y), F.lit(" = "), s(z))
    first, second = line(a, "+", b, a + b), line(a + b, "*", c, (a + b) * c)
    third = F.when(kind == 1, line(F.lit(999), "-", e, 999 - e)).when(kind == 2, line((a + b) * c, "-", e, (a + b) * c - e + 1)).otherwise(line((a + b) * c, "-", e, (a + b) * c - e))
    steps = F.when(kind == 3, F.concat(first, F.lit("\n"), second)).otherwise(F.concat(first, F.lit("\n"), second, F.lit("\n"), third))
    target = (a + b) * c - e + F.when(kind == 2, 1).otherwise(0)
    return documents(spark, sf_dir).select("doc_id", answers.countdown_solved(steps, F.array(a, b, c, e), target).alias("solved"))


@query("SELECT doc_id, (doc_id % 4) / 3.0::DOUBLE AS score FROM documents", "score")
def travel_plans(spark, sf_dir):
    """Plans of three stays, of which the first none to three are right."""
    k = F.col("doc_id") % 4
    stay = lambda i, city, n: F.concat(F.lit(f"Stay in {city} for "), F.when(k > i, str(n)).otherwise("9"), F.lit(" days. "))
    plan = F.concat(stay(0, "Rome", 2), stay(1, "Paris", 3), stay(2, "New York", 4))
    return documents(spark, sf_dir).select("doc_id", answers.travel_score(plan, F.lit("Rome**Paris**New York"), F.lit("2**3**4")).alias("score"))


# ------------------------------------------------------------------ summaries
@query(sql("SELECT lang, task, count(label) > 0 AND count(DISTINCT label) <> count(*) AS multiple_choice FROM items GROUP BY ALL"))
def multiple_choice_tasks(spark, sf_dir):
    """Tasks whose labels repeat."""
    rows = tables.items(spark, sf_dir).groupBy("lang", "task")
    return rows.agg(((F.count("label") > 0) & (F.countDistinct("label") != F.count("*"))).alias("multiple_choice"))
