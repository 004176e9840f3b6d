"""Queries on generated text and log-probabilities: documents as predictions, benchmark passages as references."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradus.functions.draws import draw_sql, poisson_sql
from gradus.operators import generate, logprob
from gradus.plans.registry import Registry
from gradus.plans.tables import answers, read, scored, sql

REGISTRY = Registry()
query = REGISTRY.query

TOKENS = "list_filter(string_split(regexp_replace(regexp_replace(lower({x}), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}\\p{{Cf}}\\p{{Co}}\\x{{FFFD}}]', '', 'g'), '[!-/:-@\\[-`{{-~\\p{{P}}\\s\\p{{Z}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
NORMAL = "trim(regexp_replace(regexp_replace(lower({x}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+', ' ', 'g'))"
PAIRS = """refs AS (SELECT d.doc_id AS item_id, k.ref_ix, b.text AS ref FROM documents d, (SELECT unnest([0, 1])::INT AS ref_ix) k
    JOIN benchmark b ON b.item_id = (d.doc_id * (1 + 6 * k.ref_ix) + k.ref_ix) % (SELECT count(*) FROM benchmark))"""


def preds(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("pred"))


def ref_keys(spark, sf_dir):
    """(item_id, ref_ix, ref_id): two reference passages for each document."""
    n = F.broadcast(read(spark, sf_dir, "benchmark").agg(F.count("*").alias("n")))  # one row
    keys = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("ref_ix")).join(n)
    return keys.select(F.col("doc_id").alias("item_id"), "ref_ix", ((F.col("doc_id") * (1 + 6 * F.col("ref_ix")) + F.col("ref_ix")) % F.col("n")).alias("ref_id"))


def ref_texts(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ref_id"), F.col("text").alias("ref"))


def refs(spark, sf_dir):
    return ref_keys(spark, sf_dir).join(ref_texts(spark, sf_dir), "ref_id").select("item_id", "ref_ix", "ref")


def overlaps(spark, sf_dir):
    return preds(spark, sf_dir), ref_keys(spark, sf_dir), ref_texts(spark, sf_dir)


def ref_lists(spark, sf_dir):
    lists = refs(spark, sf_dir).groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ref_ix", "ref"))), lambda x: x["ref"]).alias("refs"))
    return preds(spark, sf_dir).join(lists, "item_id")


def _overlap_sql(pred: str, ref: str) -> tuple[str, ...]:
    return (
        PAIRS,
        f"pt AS (SELECT item_id, token, count(*) AS n FROM (SELECT doc_id AS item_id, unnest({pred}) AS token FROM documents) GROUP BY ALL)",
        f"rt AS (SELECT item_id, ref_ix, token, count(*) AS m FROM (SELECT item_id, ref_ix, unnest({ref}) AS token FROM refs) GROUP BY ALL)",
        "pn AS (SELECT item_id, sum(n) AS n_pred FROM pt GROUP BY 1)",
        "rn AS (SELECT item_id, ref_ix, sum(m) AS n_ref FROM rt GROUP BY ALL)",
        "com AS (SELECT item_id, ref_ix, sum(least(n, m)) AS common FROM rt JOIN pt USING (item_id, token) GROUP BY ALL)",
        """sc AS (SELECT r.item_id, r.ref_ix, coalesce(coalesce(common, 0) / nullif(n_pred, 0)::DOUBLE, 0) AS precision, coalesce(coalesce(common, 0) / nullif(n_ref, 0)::DOUBLE, 0) AS recall
        FROM refs r LEFT JOIN pn USING (item_id) LEFT JOIN rn USING (item_id, ref_ix) LEFT JOIN com USING (item_id, ref_ix))""",
        "f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM sc)",
    )


_F1 = _overlap_sql(*(f"list_filter(string_split({NORMAL.format(x=x)}, ' '), lambda w: w <> '')" for x in ("text", "ref")))


@query(sql(*_F1, "SELECT item_id, max(f1) AS f1 FROM f GROUP BY item_id"), "f1")
def qa_token_f1(spark, sf_dir):
    return generate.token_f1(*overlaps(spark, sf_dir))


@query(sql(*_F1, "SELECT avg(f1) * 100 AS f1 FROM (SELECT item_id, max(f1) AS f1 FROM f GROUP BY item_id)"), "f1")
def qa_token_f1_corpus(spark, sf_dir):
    return generate.token_f1(*overlaps(spark, sf_dir)).agg((F.avg("f1") * 100).alias("f1"))


_EM = (PAIRS, f"h AS (SELECT d.doc_id AS item_id, max(({NORMAL.format(x='d.text')} = {NORMAL.format(x='r.ref')})::INT) AS exact_match, max(CASE WHEN ref_ix = 0 THEN contains(trim(lower(d.text), '. '), trim(lower(r.ref), '. '))::INT END) AS contained FROM documents d JOIN refs r ON d.doc_id = r.item_id GROUP BY 1)")


@query(sql(*_EM, "SELECT avg(exact_match) * 100 AS exact_match, avg(contained) * 100 AS gold_contained FROM h"), "exact_match gold_contained")
def qa_exact_match(spark, sf_dir):
    rows = ref_lists(spark, sf_dir)
    scored_rows = rows.select(generate.exact_match(F.col("pred"), F.col("refs")).alias("e"), generate.gold_contained(F.col("pred"), F.col("refs")).alias("g"))
    return scored_rows.agg((F.avg("e") * 100).alias("exact_match"), (F.avg("g") * 100).alias("gold_contained"))


def _pre(n: int) -> tuple[str, ...]:
    """Tokens with their positions, then runs of n through window functions."""
    run = "token" if n == 1 else "token || ' ' || lead(token) OVER w"
    window = "" if n == 1 else " WINDOW w AS (PARTITION BY {} ORDER BY i)"
    p, r = TOKENS.format(x="text"), TOKENS.format(x="ref")
    return (
        PAIRS,
        f"ptok AS (SELECT item_id, unnest(t) AS token, unnest(range(len(t))) AS i FROM (SELECT doc_id AS item_id, {p} AS t FROM documents))",
        f"rtok AS (SELECT item_id, ref_ix, unnest(t) AS token, unnest(range(len(t))) AS i FROM (SELECT item_id, ref_ix, {r} AS t FROM refs))",
        f"pt AS (SELECT item_id, token, count(*) AS n FROM (SELECT item_id, {run} AS token FROM ptok{window.format('item_id')}) WHERE token IS NOT NULL GROUP BY ALL)",
        f"rt AS (SELECT item_id, ref_ix, token, count(*) AS m FROM (SELECT item_id, ref_ix, {run} AS token FROM rtok{window.format('item_id, ref_ix')}) WHERE token IS NOT NULL GROUP BY ALL)",
        *_overlap_sql("[]", "[]")[3:],
    )


@query(sql(*_pre(1), "SELECT item_id, ref_ix, precision, recall, f1 FROM f"), "precision recall f1")
def rouge_1(spark, sf_dir):
    return generate.rouge_n(*overlaps(spark, sf_dir), 1)


@query(sql(*_pre(2), "SELECT item_id, ref_ix, precision, recall, f1 FROM f"), "precision recall f1")
def rouge_2(spark, sf_dir):
    return generate.rouge_n(*overlaps(spark, sf_dir), 2)


def _aggregate(*parts: str) -> str:
    """Over the scores f of all pairs."""
    return sql(
        *parts,
        f"d AS (SELECT precision, recall, f1, {draw_sql('4156', 'item_id', 'ref_ix')} AS key, unnest(range(0, 1000)) AS bootstrap FROM f)",
        f"m AS (SELECT bootstrap, sum(precision * w) / sum(w) AS precision, sum(recall * w) / sum(w) AS recall, sum(f1 * w) / sum(w) AS f1 FROM ({poisson_sql('d', 'key', 'bootstrap', 'w')}) GROUP BY bootstrap)",
        "u AS (UNPIVOT m ON precision, recall, f1 INTO NAME measure VALUE x)",
        "SELECT measure, quantile_cont(x, 0.025) AS low, quantile_cont(x, 0.5) AS mid, quantile_cont(x, 0.975) AS high FROM u GROUP BY measure",
    )


def aggregate(scores):
    return generate.aggregated(scores, ["item_id", "ref_ix"], ["precision", "recall", "f1"], 1000, 4156)


@query(_aggregate(*_pre(1)), "low mid high")
def rouge_1_aggregate(spark, sf_dir):
    """Low, middle and high of a thousand resampled means of each measure over all pairs."""
    return aggregate(generate.rouge_n(*overlaps(spark, sf_dir), 1))


# the longest common subsequence by match points: places of equal tokens, in order of one side and against that of the
# other, of which the longest run that rises on the other side is found by patience piles, whose tops are the state
_LCS = (
    *_pre(1),
    "mp AS (SELECT r.item_id, r.ref_ix, list([p.i] ORDER BY r.i, p.i DESC) AS js FROM rtok r JOIN ptok p ON r.item_id = p.item_id AND r.token = p.token GROUP BY ALL)",
    "lc AS (SELECT item_id, ref_ix, len(list_reduce(js, lambda s, x: list_concat(list_filter(s, lambda t: t < x[1]), x, list_filter(s, lambda t: t >= x[1])[2:]), []::BIGINT[])) AS common FROM mp)",
    """ls AS (SELECT r.item_id, r.ref_ix, coalesce(coalesce(common, 0) / nullif(n_pred, 0)::DOUBLE, 0) AS precision, coalesce(coalesce(common, 0) / nullif(n_ref, 0)::DOUBLE, 0) AS recall
    FROM refs r LEFT JOIN pn USING (item_id) LEFT JOIN rn USING (item_id, ref_ix) LEFT JOIN lc USING (item_id, ref_ix))""",
)
_ROUGE_L = "SELECT item_id, ref_ix, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM ls"


def rouge_l_scores(spark, sf_dir):
    return generate.rouge_l_of_each(*overlaps(spark, sf_dir))


@query(_aggregate(*[p for p in _LCS if not p.startswith("f AS")], f"f AS ({_ROUGE_L})"), "low mid high")
def rouge_l_corpus(spark, sf_dir):
    """The corpus score: low, middle and high of precision, recall and F1 of the longest common subsequences."""
    return aggregate(rouge_l_scores(spark, sf_dir))


@query(sql(*_LCS, _ROUGE_L), "precision recall f1")
def rouge_l(spark, sf_dir):
    return rouge_l_scores(spark, sf_dir)


@query()
def rouge_lsum(spark, sf_dir):
    return generate.rouge_lsum(*overlaps(spark, sf_dir))


_CHR = (
    "tx AS (SELECT 'p' AS side, item_id, text AS x FROM benchmark UNION ALL SELECT 'r', (item_id + 1) % (SELECT count(*) FROM benchmark), text FROM benchmark)",
    "bare AS (SELECT side, item_id, regexp_replace(x, '\\s+', '', 'g') AS b, list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '') AS w FROM tx)",
    """grams AS (SELECT side, item_id, ord, gram, count(*) AS n FROM (
        SELECT side, item_id, 'c' || k AS ord, substr(b, i, k) AS gram FROM (SELECT side, item_id, b, k, unnest(range(1, length(b) - k + 2)) AS i FROM bare, (SELECT unnest(range(1, 7)) AS k))
        UNION ALL SELECT side, item_id, 'w' || k, array_to_string(list_slice(w, i, i + k - 1), ' ') FROM (SELECT side, item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bare, (SELECT unnest(range(1, 3)) AS k))) GROUP BY ALL)""",
    "tot AS (SELECT ord, sum(CASE WHEN side = 'p' THEN n END) AS np, sum(CASE WHEN side = 'r' THEN n END) AS nr FROM grams GROUP BY 1)",
    "com AS (SELECT a.ord, sum(least(a.n, b.n)) AS common FROM grams a JOIN grams b ON a.side = 'p' AND b.side = 'r' AND a.item_id = b.item_id AND a.ord = b.ord AND a.gram = b.gram GROUP BY 1)",
)


@query(
    sql(*_CHR, "SELECT sum(coalesce(5 * p * r / nullif(4 * p + r, 0), 0)) / 8 * 100 AS chrf FROM (SELECT coalesce(common / np::DOUBLE, 0) AS p, coalesce(common / nr::DOUBLE, 0) AS r FROM tot LEFT JOIN com USING (ord))"),
    "chrf",
)
def chrf_corpus(spark, sf_dir):
    """Each benchmark passage against the one before it."""
    bench = read(spark, sf_dir, "benchmark")
    n = F.broadcast(bench.agg(F.count("*").alias("n")))
    before = bench.join(n).select(((F.col("item_id") + 1) % F.col("n")).alias("item_id"), F.col("text").alias("ref"))
    return generate.chrf(bench.select("item_id", F.col("text").alias("pred")), before)


@query(sql("SELECT model, lang, avg(x) AS score, avg(greatest((x - 25) / -25.0::DOUBLE, 0)) * 100 AS normalized FROM (SELECT model, lang, u % 2501 / 100.0::DOUBLE AS x FROM answers) GROUP BY ALL"), "score normalized")
def learned_error_scores(spark, sf_dir):
    """A learned scorer's errors from 0 to 25, of which less is better."""
    rows = answers(spark, sf_dir).withColumn("x", F.col("u") % 2501 / F.lit(100.0))
    return generate.error_scores(rows, ["model", "lang"], "x", 25.0)


_LP = "lp AS (SELECT *, CASE WHEN u % 16 = 3 THEN NULL ELSE ln((1 + u % 1000) / 1000.0::DOUBLE) END AS logprob FROM answers)"
_ERR = "coalesce(sqrt(var_samp({x}) / count({x})), 0)"


def logprobs(spark, sf_dir):
    u = F.col("u")
    return answers(spark, sf_dir).withColumn("logprob", F.when(u % 16 != 3, F.log((1 + u % 1000) / F.lit(1000.0))))


@query(
    sql(
        _LP,
        f"""SELECT model, lang, count_if(logprob IS NULL)::BIGINT AS null_count, CASE WHEN count(logprob) < 2 THEN 0 ELSE avg(logprob) END AS mean_logprob, {_ERR.format(x="logprob")} AS stderr_logprob,
        avg(coalesce(exp(logprob) * 100, 0)) AS mean_probability, {_ERR.format(x="coalesce(exp(logprob) * 100, 0)")} AS stderr_probability FROM lp GROUP BY model, lang""",
    ),
    "mean_logprob stderr_logprob mean_probability stderr_probability",
)
def logprob_summary(spark, sf_dir):
    return logprob.summary(logprobs(spark, sf_dir), ["model", "lang"])


@query(
    sql(_LP, "SELECT model, competency, count_if(logprob IS NULL)::BIGINT AS null_count, avg(coalesce(exp(logprob) * 100, 0)) AS mean_probability, count(*) AS n FROM lp GROUP BY GROUPING SETS ((model, competency), (model))"),
    "mean_probability",
)
def logprob_by_phenomenon(spark, sf_dir):
    return logprob.by_group(logprobs(spark, sf_dir), ["model"], "competency")


@query(sql(_LP, "SELECT model, item_id, sum(logprob) AS logprob, count(run) AS n_tokens FROM lp GROUP BY model, item_id"), "logprob")
def logprob_of_answer(spark, sf_dir):
    """The runs stand for an answer's tokens."""
    return logprob.total_over_tokens(logprobs(spark, sf_dir), ["model", "item_id"], "run")


@query(sql(_LP, "SELECT model, item_id, run, sum(logprob) OVER (PARTITION BY model, item_id ORDER BY run ROWS UNBOUNDED PRECEDING) AS so_far FROM lp"), "so_far")
def logprob_so_far(spark, sf_dir):
    """The sum up to each token; nulls add nothing."""
    return logprob.cumulative(logprobs(spark, sf_dir), ["model", "item_id"], "run").select("model", "item_id", "run", "so_far")


@query(
    sql("SELECT model, accuracy, greatest((accuracy - 50) / 50, 0) * 100 AS normalized FROM (SELECT model, avg(a) AS accuracy FROM (SELECT model, competency, avg(correct) * 100 AS a FROM scored GROUP BY ALL) GROUP BY model)"),
    "accuracy normalized",
)
def phenomenon_accuracy(spark, sf_dir):
    return logprob.group_mean_accuracy(scored(spark, sf_dir), ["model"], "competency", 2)


@query(sql("SELECT model, competency, sum(correct)::BIGINT AS n_correct, count(*) AS n_total FROM scored GROUP BY ALL"))
def phenomenon_counts(spark, sf_dir):
    return logprob.correct_and_total(scored(spark, sf_dir), ["model", "competency"])
