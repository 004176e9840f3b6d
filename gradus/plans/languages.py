"""Languages of documents by profiles of letter groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradus.operators import languages
from gradus.plans.registry import Registry
from gradus.plans.tables import read, sql

REGISTRY = Registry()
query = REGISTRY.query
SIZE = languages.SIZE


def _grams(name: str, by: str, where: str) -> tuple[str, ...]:
    return (
        f"{name}w AS (SELECT {by}, word, count(*) AS times FROM (SELECT {by}, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}]+')) AS word FROM documents WHERE {where}) GROUP BY ALL)",
        f"{name}g AS (SELECT {by}, gram, sum(times) AS n FROM (SELECT {by}, times, substr(w, i, k) AS gram FROM (SELECT {by}, times, '_' || word || '_' AS w, k, unnest(range(1, length(word) + 4 - k)) AS i FROM {name}w, (SELECT unnest([1, 2, 3]) AS k))) WHERE gram NOT IN ('_', '__') GROUP BY ALL)",
        f"{name} AS (SELECT {by}, gram, (row_number() OVER (PARTITION BY {by} ORDER BY n DESC, gram))::INT AS rank FROM {name}g QUALIFY rank <= {SIZE})",
    )


_KNOWN = _grams("pf", "lang", "lang IS NOT NULL")
_NEAR = (
    *_KNOWN,
    *_grams("own", "doc_id", "true"),
    f"nr AS (SELECT doc_id, lang, sum(abs(o.rank - p.rank) - {SIZE}) AS gain FROM own o JOIN pf p USING (gram) GROUP BY ALL)",
    "bs AS (SELECT doc_id, lang AS language, gain FROM nr QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY gain, lang) = 1)",
    f"fn AS (SELECT d.doc_id, language, (s.most + gain)::BIGINT AS distance FROM documents d LEFT JOIN bs USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) * {SIZE} AS most FROM own GROUP BY 1) s USING (doc_id))",
)


def _found(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs, languages.nearest(docs, "doc_id", "text", languages.profiles(docs, "lang", "text"), "lang")


@query(sql(*_KNOWN, "SELECT lang, gram, rank FROM pf"))
def language_profiles(spark, sf_dir):
    return languages.profiles(read(spark, sf_dir, "documents"), "lang", "text")


@query(sql(*_NEAR, "SELECT doc_id, language, distance FROM fn"))
def response_languages(spark, sf_dir):
    """The language nearest to each document."""
    return _found(spark, sf_dir)[1]


_SAID = "CASE doc_id % 3 WHEN 0 THEN upper(text) WHEN 1 THEN lower(text) ELSE text END"


@query(
    sql(
        *_NEAR,
        f"""SELECT doc_id, coalesce(language = lang, false) AS in_language, coalesce(language = 'en', false) AND upper(r) = r AND lower(r) <> r AS english_capitals,
        coalesce(language = 'en', false) AND lower(r) = r AND upper(r) <> r AS english_lower FROM (SELECT doc_id, lang, {_SAID} AS r FROM documents) JOIN fn USING (doc_id)""",
    )
)
def language_checks(spark, sf_dir):
    """Responses in capitals, in small letters and as they are: is each in its document's language, and is it English in one case only?"""
    docs, found = _found(spark, sf_dir)
    said = F.when(F.col("doc_id") % 3 == 0, F.upper("text")).when(F.col("doc_id") % 3 == 1, F.lower("text")).otherwise(F.col("text"))
    return languages.language_checks(docs.select("doc_id", "lang", said.alias("r")), "doc_id", "r", "lang", found)
