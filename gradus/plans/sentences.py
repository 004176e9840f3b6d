"""Sentences of documents: by rules for English, and by the marks of a language."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradus.functions import text
from gradus.operators import boundaries
from gradus.plans.registry import Registry
from gradus.plans.tables import read, sql

REGISTRY = Registry()
query = REGISTRY.query

_LETTERS = "length(regexp_extract({x}, '{p}', 1)) // 2"
_BEGINS = f"regexp_matches(r, '^ {text.STARTERS}')"
_BEFORE = _LETTERS.format(x=rf"regexp_replace(l, '(?:{text.TITLES})\.', '-', 'g')", p=r"((?:[A-Za-z]\.)+)$")
_AFTER = _LETTERS.format(x="r", p=r"^((?:[A-Za-z]\.)+)")
_STOP = rf"""CASE WHEN regexp_matches(l, '(?:{text.TITLES})\.$') OR regexp_matches(r, '^(?:{text.SITES})') THEN false
    WHEN regexp_matches(l, '[0-9]\.$') AND regexp_matches(r, '^[0-9]') THEN false
    WHEN starts_with(r, '.') THEN false
    WHEN ends_with(l, '..') THEN true
    WHEN ends_with(l, 'Ph.') AND starts_with(r, 'D.') OR ends_with(l, 'Ph.D.') THEN false
    WHEN regexp_matches(l, '[A-Z]\.[A-Z]\.$') AND {_BEGINS} THEN true
    WHEN before > 0 AND after > 0 THEN false
    WHEN before > 1 AND (before + after) % 3 <> 1 THEN false
    WHEN regexp_matches(l, ' (?:{text.SUFFIXES})\.$') THEN {_BEGINS}
    ELSE NOT regexp_matches(l, '{text.BLANK}[A-Za-z]\.$') END"""


@query(
    rf"""WITH p AS (SELECT doc_id, regexp_extract_all(' ' || replace(text, chr(10), ' ') || '  ', '[^.?!]*[.?!]|[^.?!]+$') AS p FROM documents),
    c AS (SELECT doc_id, i, p[i] AS piece, array_to_string(p[greatest(1, i - {text.AROUND - 1}):i], '') AS l, coalesce(array_to_string(p[i + 1:i + {text.AROUND}], ''), '') AS r
        FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM p)),
    d AS (SELECT *, {_BEFORE} AS before, {_AFTER} AS after FROM c),
    e AS (SELECT doc_id, i, piece, r, l, ends_with(piece, '.') AS stop, CASE WHEN ends_with(piece, '.') THEN {_STOP} ELSE regexp_matches(piece, '[?!]$') END AS ends FROM d),
    m AS (SELECT *, ends AND CASE WHEN stop THEN regexp_matches(r, '^["”]') AND NOT ends_with(l, '..') ELSE starts_with(r, '"') END AS moves FROM e),
    z AS (SELECT *, max(CASE WHEN ends THEN i ELSE 0 END) OVER (PARTITION BY doc_id) AS final, lag(moves, 1, false) OVER (PARTITION BY doc_id ORDER BY i) AS moved FROM m)
    SELECT doc_id, count_if(ends) + coalesce(max((i > final AND regexp_matches(CASE WHEN moved THEN substr(piece, 2) ELSE piece END, '{text.SOLID}'))::INT), 0) AS n FROM z GROUP BY doc_id"""
)
def english_sentence_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.size(text.english_sentences(F.col("text"))).cast("long").alias("n"))


_MARKS = text.ending_marks("")


@query(
    rf"""WITH w AS (SELECT doc_id, k, unnest(x) AS word, unnest(range(len(x))) AS i FROM (SELECT doc_id, k, regexp_extract_all(line, '{text.BLANK}*{text.SOLID}+') AS x
        FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS k FROM (SELECT doc_id, regexp_split_to_array(text, '[\r\n|]') AS l FROM documents)))),
    c AS (SELECT *, regexp_replace(word, '[{text.CLOSING.replace("'", "''")}]+$', '') AS closed FROM w),
    b AS (SELECT *, regexp_replace(closed, '[{_MARKS}]$', '') AS bare FROM c),
    e AS (SELECT *, regexp_matches(closed, '[{_MARKS}]$') AND NOT (NOT regexp_matches(bare, '[{_MARKS}]$') AND (regexp_matches(bare, '\p{{Nd}}$') OR regexp_matches(bare, '{text.ABBREVIATED}'))) AS last FROM b),
    s AS (SELECT *, coalesce(sum(last::INT) OVER (PARTITION BY doc_id, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM e),
    t AS (SELECT doc_id, k, sentence FROM s GROUP BY ALL HAVING regexp_matches(string_agg(word, ''), '[^\p{{P}}\p{{S}}\x09-\x0D\x20]'))
    SELECT doc_id, count(t.k) AS n FROM documents LEFT JOIN t USING (doc_id) GROUP BY doc_id"""
)
def language_sentence_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.size(text.language_sentences(F.col("text"))).cast("long").alias("n"))


_Q = lambda p: p.replace("'", "''")
_WORD = r"CASE WHEN regexp_matches(lower(regexp_replace({t}, '\.$', '')), '^[-+]?[0-9][0-9.,]*$') THEN '#' ELSE lower(regexp_replace({t}, '\.$', '')) END"
_LL = "(CASE WHEN {k} > 0 THEN {k} * ln({p}) ELSE 0 END + CASE WHEN {n} - {k} > 0 THEN ({n} - {k}) * ln(1 - {p}) ELSE 0 END)"
_LEARNED = (
    rf"tk AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[\x09-\x0D\x20]+'), lambda t: regexp_replace(regexp_replace(t, '{_Q(boundaries.OPENING)}', ''), '{_Q(boundaries.CLOSED)}', '')), lambda t: t <> '') AS t FROM documents)",
    f"pr AS (SELECT doc_id, token, next, {_WORD.format(t='token')} AS word, {_WORD.format(t='next')} AS next_word FROM (SELECT doc_id, unnest(t) AS token, unnest(list_concat(t[2:], [NULL])) AS next FROM tk WHERE len(t) > 0))",
    "ct AS (SELECT word, count_if(ends_with(token, '.')) AS n_stop, count_if(NOT ends_with(token, '.')) AS n_bare FROM pr GROUP BY 1)",
    rf"""rt AS (SELECT word, n_stop, n_bare, -2 * ({_LL.format(k="n_stop", n="(n_stop + n_bare)", p="share")} - {_LL.format(k="n_stop", n="(n_stop + n_bare)", p=boundaries.WITH_STOP)}) AS ratio,
    len(regexp_extract_all(word, '\.')) AS inside FROM ct, (SELECT sum(n_stop) / sum(n_stop + n_bare)::DOUBLE AS share FROM ct) WHERE n_stop > 0 AND regexp_matches(word, '\p{{L}}'))""",
    "ab AS (SELECT word, n_stop, n_bare, ratio, ratio * exp(-(length(word) - inside)) * (inside + 1) * pow((length(word) - inside)::DOUBLE, -n_bare::DOUBLE) AS score FROM rt)",
    rf"en AS (SELECT pr.*, ab.word AS abbreviation FROM pr LEFT JOIN (SELECT word FROM ab WHERE score >= {boundaries.ABBREVIATION}) ab ON pr.word = ab.word WHERE regexp_matches(token, '[.?!]$'))",
    "fd AS (SELECT next_word AS word, count(*) AS n_after FROM en WHERE next IS NOT NULL AND (abbreviation IS NULL OR NOT ends_with(token, '.')) GROUP BY 1)",
    rf"""sx AS (SELECT fd.word, n_after, n_all, m, n FROM fd JOIN (SELECT word, count(*) AS n_all FROM pr GROUP BY 1) e ON fd.word = e.word, (SELECT sum(n_after)::DOUBLE AS m FROM fd), (SELECT count(*)::DOUBLE AS n FROM pr)
    WHERE regexp_matches(fd.word, '\p{{L}}') AND n > m)""",
    f"""st AS (SELECT word, n_after, n_all, -2 * ({_LL.format(k="n_after", n="m", p="(n_all / n)")} + {_LL.format(k="(n_all - n_after)", n="(n - m)", p="(n_all / n)")}
    - {_LL.format(k="n_after", n="m", p="(n_after / m)")} - {_LL.format(k="(n_all - n_after)", n="(n - m)", p="((n_all - n_after) / (n - m))")}) AS ratio, n_after / m > n_all / n AS more FROM sx)""",
)


def _pairs(spark, sf_dir):
    return boundaries.neighbours(read(spark, sf_dir, "documents"), "doc_id", "text")


@query(sql(*_LEARNED, "SELECT * FROM ab"), "ratio score")
def abbreviation_scores(spark, sf_dir):
    """Words with a full stop, and how much they look like abbreviations."""
    return boundaries.abbreviations(_pairs(spark, sf_dir))


@query(sql(*_LEARNED, "SELECT * FROM st"), "ratio")
def sentence_starters(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    return boundaries.starters(pairs, boundaries.abbreviations(pairs))


@query(
    sql(
        *_LEARNED,
        rf"""br AS (SELECT doc_id, count(*) AS n FROM en LEFT JOIN (SELECT word FROM st WHERE ratio >= {boundaries.STARTER} AND more) s ON en.next_word = s.word WHERE next IS NOT NULL
        AND NOT (ends_with(token, '.') AND abbreviation IS NOT NULL AND NOT (s.word IS NOT NULL AND regexp_matches(next, '^\p{{Lu}}'))) GROUP BY doc_id)""",
        "SELECT tk.doc_id, (len(t) > 0)::BIGINT + coalesce(n, 0) AS n FROM tk LEFT JOIN br ON tk.doc_id = br.doc_id",
    )
)
def learned_sentence_counts(spark, sf_dir):
    """Sentences by the abbreviations and starters that the documents teach."""
    return boundaries.sentence_counts(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
