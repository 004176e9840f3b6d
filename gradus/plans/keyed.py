"""Joins, set operations, windows, prompts and long-context metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradus.functions import text
from gradus.functions.draws import divided, draw, draw_sql, permuted_sql
from gradus.operators import answers, keyed, prompts
from gradus.plans.generate import TOKENS
from gradus.plans.registry import Registry
from gradus.plans.tables import items, read, responses, sql

REGISTRY = Registry()
query = REGISTRY.query


def documents(spark, sf_dir):
    return read(spark, sf_dir, "documents")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def keep_last_duplicate(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return keyed.keep_last(rows, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("SELECT event_type, max(ts)::VARCHAR IS NOT NULL AS seen, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY event_type")
def latest_per_key(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    return rows.groupBy("event_type").agg(F.max("ts").isNotNull().alias("seen"), F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_ids(spark, sf_dir):
    return keyed.missing(documents(spark, sf_dir).select("doc_id"), read(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def expected_with_received(spark, sf_dir):
    return keyed.in_order(documents(spark, sf_dir).select("doc_id"), read(spark, sf_dir, "labels").select("doc_id", "quality"), ["doc_id"])


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3")
def first_k_per_subject(spark, sf_dir):
    """Few-shot examples: the first three of each source."""
    return keyed.first_per_group(documents(spark, sf_dir).select("source", "doc_id"), ["source"], ["doc_id"], 3)


@query("SELECT conv_id, turn, string_agg(role || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS so_far FROM conversations")
def turn_accumulation(spark, sf_dir):
    return keyed.conversation_so_far(read(spark, sf_dir, "conversations"), "conv_id", "turn", F.concat("role", F.lit(": "), "text"))


@query("SELECT user_id, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM events", "total")
def running_total(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return read(spark, sf_dir, "events").select("user_id", "event_id", F.sum("value").over(w).alias("total"))


_T = TOKENS
_NEXT = f"x AS (SELECT a.item_id, {_T.format(x='a.text')} AS p, {_T.format(x='b.text')} AS r FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)"


def passages(spark, sf_dir):
    """Tokens of each benchmark passage, and of the next one."""
    b = read(spark, sf_dir, "benchmark")
    following = b.select((F.col("item_id") - 1).alias("item_id"), text.tokens(F.col("text")).alias("r"))
    return b.select("item_id", text.tokens(F.col("text")).alias("p")).join(following, "item_id")


@query(f"WITH {_NEXT} SELECT item_id, len(list_intersect(p, r)) / len(list_distinct(r))::DOUBLE AS recall, len(list_intersect(p, r)) = len(list_distinct(r)) AS strict FROM x", "recall")
def set_recall_strict(spark, sf_dir):
    rows = passages(spark, sf_dir).select("item_id", keyed.set_recall(F.col("p"), F.col("r")).alias("recall"))
    return rows.withColumn("strict", F.col("recall") == 1)


@query("SELECT item_id, coalesce((SELECT min(i) - 1 FROM (SELECT unnest(range(1, greatest(len(p), len(r)) + 1)) AS i) WHERE p[i] IS DISTINCT FROM r[i]), len(p))::BIGINT AS n FROM (SELECT a.doc_id AS item_id, string_split(a.text, ' ') AS p, string_split(b.text, ' ') AS r FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)")
def prefix_match(spark, sf_dir):
    """Words that a document and the next one begin with in common."""
    d = documents(spark, sf_dir)
    following = d.select((F.col("doc_id") - 1).alias("doc_id"), F.split("text", " ").alias("r"))
    rows = d.select("doc_id", F.split("text", " ").alias("p")).join(following, "doc_id")
    return rows.select(F.col("doc_id").alias("item_id"), keyed.matching_prefix(F.col("p"), F.col("r")).alias("n"))


@query(
    """WITH p AS (SELECT o_custkey AS t, o_orderstatus AS s, o_orderpriority AS q, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY ALL),
    r AS (SELECT o_custkey AS t, o_orderstatus AS s, o_orderpriority AS q, count(*) AS m FROM orders WHERE o_orderkey % 3 <> 1 GROUP BY ALL),
    j AS (SELECT coalesce(p.t, r.t) AS t, n, m FROM p FULL JOIN r USING (t, s, q)),
    s AS (SELECT t, coalesce(sum(n) FILTER (m IS NOT NULL) / sum(n)::DOUBLE, 0) AS precision, coalesce(sum(m) FILTER (n IS NOT NULL) / sum(m)::DOUBLE, 0) AS recall FROM j GROUP BY t)
    SELECT t AS o_custkey, precision, recall, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM s""",
    "precision recall f1",
)
def table_row_f1(spark, sf_dir):
    """Orders of a customer as a table's rows: two overlapping parts of them as prediction and reference."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return keyed.table_scores(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 3 <> 1"), "o_custkey", ["o_orderstatus", "o_orderpriority"])


@query(f"WITH t AS (SELECT source, unnest({_T.format(x='text')}) AS word FROM documents), n AS (SELECT source, word, count(*) AS n FROM t GROUP BY ALL) SELECT source, word, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, word)::INT AS rank FROM n QUALIFY rank <= 5")
def top_words(spark, sf_dir):
    """The five most common words of each source: the answer of the common-words task."""
    return keyed.top_words(documents(spark, sf_dir), ["source"], text.tokens(F.col("text")), 5)


@query("SELECT DISTINCT word FROM (SELECT unnest(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS word FROM benchmark)")
def word_list(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select(F.explode(F.split(text.collapse(F.col("text")), " ")).alias("word")).distinct()


@query("SELECT lang AS task FROM documents UNION SELECT source FROM documents UNION SELECT role FROM conversations")
def task_set_union(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select(F.col("lang").alias("task")).union(d.select("source")).union(read(spark, sf_dir, "conversations").select("role")).distinct()


@query("SELECT source FROM documents WHERE lang = 'fr' INTERSECT ALL SELECT source FROM documents WHERE lang = 'de'")
def multiset_intersection(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.where("lang = 'fr'").select("source").intersectAll(d.where("lang = 'de'").select("source"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE quality = 1")
def set_difference(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id").subtract(read(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))


_EQ = f"e AS (SELECT doc_id, d % 40 AS a, d // 64 % 12 AS b, CASE d % 4 WHEN 0 THEN '+' WHEN 1 THEN '-' WHEN 2 THEN '*' ELSE '/' END AS op, d // 1024 % 3 AS off, d % 13 = 0 AS broken FROM (SELECT doc_id, {draw_sql('9', 'doc_id')} AS d FROM documents))"


@query(
    f"""WITH {_EQ} SELECT doc_id, CASE WHEN broken THEN NULL WHEN op = '+' THEN off = 0 WHEN op = '-' THEN off = 0 WHEN op = '*' THEN off = 0 ELSE b <> 0 AND a % greatest(b, 1) = 0 AND off = 0 END AS ok FROM e"""
)
def countdown_lines(spark, sf_dir):
    """Equations, some of them wrong or no equations; a quotient must be whole."""
    d = F.col("d")
    rows = documents(spark, sf_dir).select("doc_id", draw(9, "doc_id").alias("d"))
    a, b, off = d % 40, divided(d, 64) % 12, divided(d, 1024) % 3
    op = F.element_at(F.array(*map(F.lit, "+-*/")), (d % 4 + 1).cast("int"))
    value = F.when(op == "+", a + b).when(op == "-", a - b).when(op == "*", a * b).otherwise(F.floor(a / F.greatest(b, F.lit(1))))
    line = F.when(d % 13 == 0, "no equation").otherwise(F.concat(a.cast("string"), F.lit(" "), op, F.lit(" "), b.cast("string"), F.lit(" = "), (value + off).cast("string")))
    return rows.select("doc_id", keyed.countdown_line(line).alias("ok"))


@query("SELECT doc_id, 'Question: ' || text || chr(10) || 'A. ' || trim(lang) || chr(10) || 'B. ' || trim(source) || chr(10) || 'C. {x}' AS prompt FROM documents")
def prompt_options(spark, sf_dir):
    """A template filled with a question and lettered options; braces in values stay as they are."""
    values = {"question": F.col("text"), "options": keyed.options(F.array("lang", "source", F.lit("{x}")))}
    return documents(spark, sf_dir).select("doc_id", keyed.filled_template("Question: {question}\n{options}", values).alias("prompt"))


_D = f"{draw_sql('17', 'doc_id')} % 4"


@query(f"SELECT doc_id, {_D} AS answer_at, array_to_string(list_concat(list_concat(['x', 'y', 'z'][1:{_D}], [source]), ['x', 'y', 'z'][{_D} + 1:]), ',') AS options FROM documents")
def shuffled_options(spark, sf_dir):
    """The answer at a drawn place among the distractors."""
    place = draw(17, "doc_id") % 4
    put = keyed.with_answer_at(F.array(*map(F.lit, "xyz")), F.col("source"), place.cast("int"))
    return documents(spark, sf_dir).select("doc_id", place.alias("answer_at"), F.array_join(put, ",").alias("options"))


@query(sql("SELECT competency, lang, count(*) AS n FROM items WHERE label <> 'toxic' AND NOT (competency = 'c1' AND lang = 'de') GROUP BY ALL"))
def filtered_items(spark, sf_dir):
    """Overrides as anti-joins: labels, and pairs of competency and language, to leave out."""
    skip = spark.createDataFrame([("c1", "de")], "competency string, lang string")
    rows = items(spark, sf_dir).where("label <> 'toxic'").join(F.broadcast(skip), ["competency", "lang"], "left_anti")
    return rows.groupBy("competency", "lang").agg(F.count("*").alias("n"))


@query(sql("SELECT model, run, count(*) AS n FROM responses WHERE run < 2 OR model = 4 GROUP BY ALL"))
def run_cap(spark, sf_dir):
    """Runs beyond a model's cap are left out; the last model has none."""
    caps = spark.createDataFrame([(m, 2) for m in range(4)], "model long, cap int")
    rows = responses(spark, sf_dir).join(F.broadcast(caps), "model", "left").where("cap IS NULL OR run < cap")
    return rows.groupBy("model", "run").agg(F.count("*").alias("n"))


@query("SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events")
def json_field(spark, sf_dir):
    found = F.try_variant_get(F.try_parse_json(text.flat_json(F.concat(F.lit("so: "), F.col("props")))), "$.k", "bigint")
    return read(spark, sf_dir, "events").select("event_id", found.alias("k"))


@query("SELECT page_id, regexp_extract(html, '(?s)<title>(.*)</title>', 1) AS title, len(regexp_extract_all(html, '<p>')) AS n_paragraphs FROM pages")
def tagged_spans(spark, sf_dir):
    rows = read(spark, sf_dir, "pages")
    return rows.select("page_id", text.tagged(F.col("html"), "title").alias("title"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("n_paragraphs"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}_]+')) AS n_words, len(list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: trim(p) <> '')) AS n_paragraphs FROM documents")
def text_counts(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.word_count(F.col("text")).cast("long").alias("n_words"), F.size(text.paragraphs(F.col("text"))).cast("long").alias("n_paragraphs"))


_N = r"trim(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\s+', ' ', 'g'))"


_LINE = f"list_filter(string_split({_N}, ' '), lambda w: w NOT IN ('a', 'an', 'the'))"
_ENDS = r"trim(regexp_replace(regexp_replace(lower(text), '^[!-/:-@\[-`{-~ \n]+|[!-/:-@\[-`{-~ \n]+$', '', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT item_id, {_N} AS answer, array_to_string({_LINE}, '') AS cell, {_ENDS} AS ends FROM benchmark")
def normal_forms(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "benchmark").select("item_id", text.normalize_answer(t).alias("answer"), text.normalize_cell(t).alias("cell"), text.normalize_ends(t).alias("ends"))


@query("SELECT event_type, e AS error, count(*) AS n FROM (SELECT event_type, unnest(list_filter([CASE WHEN value < 1 THEN 'small' END, CASE WHEN user_id % 7 = 0 THEN 'user' END, CASE WHEN props IS NULL THEN 'props' END], lambda x: x IS NOT NULL)) AS e FROM events) GROUP BY ALL")
def error_counts(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    errors = F.array_compact(F.array(F.when(F.col("value") < 1, "small"), F.when(F.col("user_id") % 7 == 0, "user"), F.when(F.col("props").isNull(), "props")))
    return answers.error_counts(rows, ["event_type"], errors)


@query("SELECT event_type, avg(ok)::DOUBLE AS pass_at_1, count(*) AS n_items FROM (SELECT event_type, user_id, min((value > 0.5)::INT) AS ok FROM events GROUP BY ALL) GROUP BY event_type", "pass_at_1")
def pass_at_one(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("passed", F.col("value") > 0.5)
    return answers.passed_at_one(rows, ["event_type"], "user_id", "passed")


@query("SELECT d.doc_id, k AS criterion_ix, 'Criterion: ' || [d.lang, d.source][k + 1] || chr(10) || chr(10) || 'Response: ' || text AS prompt FROM documents d, (SELECT unnest([0, 1])::INT AS k)")
def judge_prompts(spark, sf_dir):
    rows = documents(spark, sf_dir).withColumn("criteria", F.array("lang", "source"))
    return prompts.per_criterion(rows, "criteria", "text").select("doc_id", "criterion_ix", "prompt")


_AB = "SELECT doc_id, ord AS \"order\", t AS turn, CASE ord WHEN 'baseline-before' THEN '[A]' || chr(10) || b || chr(10) || '[B]' || chr(10) || a ELSE '[A]' || chr(10) || a || chr(10) || '[B]' || chr(10) || b END AS prompt"


@query(
    f"""{_AB} FROM (SELECT doc_id, t, 'Q: one' || chr(10) || 'A: ' || lang || CASE WHEN t = 2 THEN chr(10) || 'Q: two' || chr(10) || 'A: ' || source ELSE '' END AS a,
    'Q: one' || chr(10) || 'A: x' || CASE WHEN t = 2 THEN chr(10) || 'Q: two' || chr(10) || 'A: y' ELSE '' END AS b FROM documents, (SELECT unnest([1, 2])::INT AS t)), (SELECT unnest(['baseline-before', 'baseline-after']) AS ord)"""
)
def pairwise_prompts(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.array(F.lit("one"), F.lit("two")).alias("q"), F.array("lang", "source").alias("a"), F.array(F.lit("x"), F.lit("y")).alias("b"))
    return prompts.both_orders(rows, "q", "a", "b").select("doc_id", "order", "turn", "prompt")


_PARTS = r"list_filter(string_split(regexp_replace(text, '([.?!]+)\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')"
_NEEDLE = f"""tk AS (SELECT i AS task_id, {_PARTS} AS parts FROM (SELECT unnest(range(100)) AS i) JOIN benchmark b ON b.item_id = i % (SELECT count(*) FROM benchmark)),
    nd AS (SELECT task_id, k, {draw_sql("42", "task_id", "k", "'at'")} % (len(parts) + 1) AS pos, 'key-' || {draw_sql("42", "task_id", "k", "'key'")} AS key, ({draw_sql("42", "task_id", "k", "'value'")} % 2147483648)::VARCHAR AS value FROM tk, (SELECT unnest([1, 2, 3]) AS k)),
    ln AS (SELECT task_id, pos, 0 AS own, k, 'The number of ' || key || ' is ' || value || '.' AS text FROM nd UNION ALL SELECT task_id, i, 1, i, parts[i + 1] FROM (SELECT task_id, parts, unnest(range(len(parts))) AS i FROM tk))"""


@query(f"WITH {_NEEDLE} SELECT task_id, prompt, label FROM (SELECT task_id, string_agg(text, ' ' ORDER BY pos, own, k) AS prompt FROM ln GROUP BY 1) JOIN (SELECT task_id, string_agg(value, ',' ORDER BY k) AS label FROM nd GROUP BY 1) USING (task_id)")
def needle_tasks(spark, sf_dir):
    bench = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("text_id"), text.sentences(F.col("text")).alias("parts"))
    n = F.broadcast(bench.agg(F.count("*").alias("n")))
    tasks = spark.range(100).join(n).select(F.col("id").alias("task_id"), (F.col("id") % F.col("n")).alias("text_id"))
    return prompts.needle_tasks(bench, tasks, 3, 42).withColumn("label", F.array_join("label", ","))


_COMMON = f"""v AS (SELECT word, row_number() OVER (ORDER BY {draw_sql("42", "word")}, word) - 1 AS number FROM (SELECT DISTINCT unnest({_T.format(x="text")}) AS word FROM benchmark)),
    tk AS (SELECT task_id, place, size, {draw_sql("42", "'task'", "task_id")} AS key FROM (SELECT unnest(range(50)) AS task_id), (SELECT unnest(range(100)) AS place), (SELECT count(*) AS size FROM v) WHERE place < size),
    {permuted_sql("pm", "tk", "task_id", "place", "size", "key", "ix")},
    p AS (SELECT task_id, word, place FROM pm JOIN v ON ix = number WHERE ix < size),
    c AS (SELECT task_id, word, place, unnest(range(CASE WHEN place < 10 THEN 30 ELSE 1 END)) AS copy FROM p)"""


@query(f"WITH RECURSIVE {_COMMON} SELECT task_id, string_agg(word, ' ' ORDER BY {draw_sql('42', 'task_id', 'word', 'copy')}, word) AS words, string_agg(word, ' ' ORDER BY place) FILTER (place < 10 AND copy = 0) AS label FROM c GROUP BY task_id")
def common_word_tasks(spark, sf_dir):
    vocabulary = read(spark, sf_dir, "benchmark").select(F.explode(text.tokens(F.col("text"))).alias("word")).distinct()
    found = prompts.common_word_tasks(vocabulary, spark.range(50).withColumnRenamed("id", "task_id"), 10, 30, 100, 42)
    return found.select("task_id", F.array_join("words", " ").alias("words"), F.array_join("label", " ").alias("label"))


@query("SELECT doc_id, d % 5 <> 0 AS equal FROM (SELECT doc_id, " + draw_sql("21", "doc_id") + " AS d FROM documents)")
def math_equivalence(spark, sf_dir):
    """A drawn fraction in different notations against its value; one in five is off."""
    rows = documents(spark, sf_dir).select("doc_id", draw(21, "doc_id").alias("d"))
    top, bottom = (F.col("d") % 900 + 1).cast("string"), F.lit("8")
    pred = F.when(F.col("d") % 2 == 0, F.concat(F.lit(r"$\frac{"), top, F.lit("}{8}$"))).otherwise(((F.col("d") % 900 + 1) / 8).cast("decimal(20,3)").cast("string"))
    ref = F.concat((F.col("d") % 900 + 1 + (F.col("d") % 5 == 0).cast("int")).cast("string"), F.lit("/"), bottom)
    return rows.select("doc_id", answers.math_equal(pred, ref).alias("equal"))


@query("SELECT doc_id, (d // 7 % 6)::INT AS kind, d % 5 <> 0 AS equal FROM (SELECT doc_id, " + draw_sql("22", "doc_id") + " AS d FROM documents)")
def math_forms(spark, sf_dir):
    """Drawn polynomials, roots, sets, intervals, rational functions and powers, each in two forms; one in five is off by one."""
    rows = documents(spark, sf_dir).select("doc_id", draw(22, "doc_id").alias("d"))
    rows = rows.withColumns({"kind": (divided(F.col("d"), 7) % 6).cast("int"), "a": divided(F.col("d"), 42) % 30 + 2, "b": divided(F.col("d"), 1260) % 30 + 40, "off": (F.col("d") % 5 == 0).cast("long")})
    forms = [  # (prediction, reference)
        ("concat('(x+', a, ')(x-', b, ')')", "concat('x^2-', b - a, 'x-', a * b + off)"),
        ("concat('\\\\sqrt{', a * a * b, '}')", "concat(a + off, '\\\\sqrt{', b, '}')"),
        ("concat('\\\\{', a, ', ', b, ', z\\\\}')", "concat('\\\\{z, ', b + off, ', ', a, '\\\\}')"),
        ("concat('\\\\left[', a, ', \\\\frac{', 3 * b, '}{3}\\\\right)')", "concat('[', a, ', ', b, if(off = 1, ']', ')'))"),
        ("concat('\\\\frac{x^2-', a * a, '}{x-', a, '}')", "concat('x+', a + off)"),
        ("concat('x^{', a, '} \\\\cdot x^{-', b, '}')", "concat('\\\\frac{1}{x^{', b - a + off, '}}')"),
    ]
    case = lambda side: F.expr("CASE kind " + " ".join(f"WHEN {k} THEN {f[side]}" for k, f in enumerate(forms)) + " END")
    return rows.select("doc_id", "kind", answers.math_equal(case(0), case(1)).alias("equal"))
