"""Instruction checks on responses made from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradus.functions.checkers import ENGLISH, EXCLUDED, check, counted, loose
from gradus.functions.draws import draw, draw_sql
from gradus.plans.registry import Registry
from gradus.plans.tables import read

REGISTRY = Registry()
query = REGISTRY.query

_R = f"""r AS (SELECT doc_id, lang, CASE d % 12 WHEN 0 THEN '<<A title>>' || chr(10) || text WHEN 1 THEN '"' || text || '"' WHEN 2 THEN '* one' || chr(10) || '- two' || chr(10) || 'end'
    WHEN 3 THEN '```json' || chr(10) || '{{"a": [1, 2]}}' || chr(10) || '```' WHEN 4 THEN text || chr(10) || 'P.S. more' WHEN 5 THEN 'one *** two *** ' || text
    WHEN 6 THEN '[] first ****** second' WHEN 7 THEN 'Dear [name] of [place], *yes* and **no**' WHEN 8 THEN upper(text) WHEN 9 THEN 'Section 1 of it' || chr(10) || chr(10) || 'Section 2 the end'
    WHEN 10 THEN '  ' ELSE text END AS r FROM (SELECT *, {draw_sql("3", "doc_id")} AS d FROM documents))"""


def responses(spark, sf_dir):
    d, t = draw(3, "doc_id") % 12, F.col("text")
    r = (
        F.when(d == 0, F.concat(F.lit("<<A title>>\n"), t))
        .when(d == 1, F.concat(F.lit('"'), t, F.lit('"')))
        .when(d == 2, "* one\n- two\nend")
        .when(d == 3, '```json\n{"a": [1, 2]}\n```')
        .when(d == 4, F.concat(t, F.lit("\nP.S. more")))
        .when(d == 5, F.concat(F.lit("one *** two *** "), t))
        .when(d == 6, "[] first ****** second")
        .when(d == 7, "Dear [name] of [place], *yes* and **no**")
        .when(d == 8, F.upper(t))
        .when(d == 9, "Section 1 of it\n\nSection 2 the end")
        .when(d == 10, "  ")
        .otherwise(t)
    )
    return read(spark, sf_dir, "documents").select("doc_id", "lang", r.alias("r"))


#: name of the result -> (checker, arguments, the same in DuckDB's SQL)
CHECKS = {
    "words_100": ("words", {"n": 100}, r"len(regexp_extract_all(r, '[\p{L}\p{M}\p{N}_]+')) >= 100"),
    "parts_3": ("starred_parts", {"n": 3}, r"len(list_filter(string_split(r, '***'), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g')) <> '')) = 3"),
    "placeholders_2": ("placeholders", {"n": 2}, r"len(regexp_extract_all(r, '\[([^\[\]]+)\]')) >= 2"),
    "postscript": ("postscript", {}, r"regexp_matches(lower(r), 'p\.\s?s\.')"),
    "highlights_2": ("highlights", {"n": 2}, r"len(regexp_extract_all(r, '(?:^|[^*])\*([^\n*]+)\*(?:[^*]|$)')) + len(regexp_extract_all(r, '\*\*([^\n*]+)\*\*')) >= 2"),
    "bullets_2": ("bullets", {"n": 2}, r"len(regexp_extract_all(r, '(?m)^\s*[*-] ')) = 2"),
    "sections_2": ("sections", {"title": "Section", "n": 2}, r"len(regexp_extract_all(r, '(?:^|[^\p{L}\p{N}_])Section\s+[\p{L}\p{N}_]+')) = 2"),
    "json": ("json_value", {}, r"json_valid(regexp_replace(regexp_replace(regexp_replace(r, '^\s+|\s+$', '', 'g'), '^```(?:json|JSON|Json)?\s*', ''), '\s*```$', ''))"),
    "options": ("one_of", {"options": ["first", "and"]}, "contains(r, 'first') OR contains(r, 'and')"),
    "title": ("title", {}, r"regexp_matches(r, '<<[^\n]*[^\s<>][^\n]*>>')"),
    "starts": ("starts", {"word": "Dear"}, r"starts_with(lower(regexp_replace(r, '^\s+|\s+$', '', 'g')), 'dear')"),
    "ends": ("ends", {"phrase": "the end"}, r"""ends_with(lower(regexp_replace(regexp_replace(r, '^\s+|\s+$', '', 'g'), '"+$', '')), 'the end')"""),
    "quotes": ("in_quotes", {}, r"""regexp_matches(regexp_replace(r, '^\s+|\s+$', '', 'g'), '(?s)^".+"$')"""),
    "has_words": ("has_words", {"keywords": ["the", "of"]}, r"regexp_matches(r, '(?i)(^|[^\p{L}\p{N}_])the($|[^\p{L}\p{N}_])') AND regexp_matches(r, '(?i)(^|[^\p{L}\p{N}_])of($|[^\p{L}\p{N}_])')"),
    "has_words_anywhere": ("has_words", {"keywords": ["the"], "language": "th"}, "contains(r, 'the')"),
    "lacks_words": ("lacks_words", {"keywords": ["der"]}, r"NOT regexp_matches(r, '(?i)(^|[^\p{L}\p{N}_])der($|[^\p{L}\p{N}_])')"),
    "keyword_5": ("word_frequency", {"keyword": "th", "n": 5}, "len(regexp_extract_all(r, '(?i)th')) >= 5"),
    "number": ("number_frequency", {"number": "1", "n": 1}, "len(regexp_extract_all(r, '1')) >= 1"),
    "letter_9": ("letter_frequency", {"letter": "e", "n": 9, "relation": "less than"}, "length(lower(r)) - length(replace(lower(r), 'e', '')) < 9"),
    "capitals_3": ("capital_words", {"n": 3}, "len(list_filter(regexp_split_to_array(r, '[^0-9A-Za-z]+'), lambda w: regexp_matches(w, '^[A-Z0-9]*[A-Z][A-Z0-9]*$') AND length(w) > 1)) >= 3"),
    "repeats": ("repeats", {"prompt": "first"}, r"starts_with(lower(regexp_replace(r, '^\s+|\s+$', '', 'g')), 'first') AND length(regexp_replace(r, '^\s+|\s+$', '', 'g')) > 5"),
    "two": ("two_responses", {}, r"len(list_filter(string_split(regexp_replace(r, '^\s+|\s+$', '', 'g'), '******'), lambda p: regexp_replace(regexp_replace(p, '^\s+|\s+$', '', 'g'), '^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$', '', 'g') <> '')) = 2"),
    "paragraph_word": ("nth_paragraph_word", {"n": 2, "nth": 2, "word": "Section"}, r"len(list_filter(string_split(r, chr(10) || chr(10)), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g')) <> '')) = 2 AND regexp_extract(lower(string_split(r, chr(10) || chr(10))[2]), '^\s*[''\x22]*([0-9A-Za-z]+)', 1) = 'section'"),
    "capitals": ("all_capitals", {}, "upper(r) = r AND lower(r) <> r"),
    "lower": ("all_lower", {}, "lower(r) = r AND upper(r) <> r"),
    "no_comma": ("no_comma", {}, "NOT contains(r, ',')"),
}
_PARTS = r"[regexp_replace(p, '^\s+|\s+$', '', 'g') FOR p IN string_split({r}, '{by}')]"
_SIX, _THREE = _PARTS.format(r="r", by="******"), _PARTS.format(r=r"regexp_replace(r, '\s?\*\*\*\s?', '***', 'g')", by="***")
#: Checks of the English set that differ.
ENGLISH_CHECKS = {
    "placeholders_1": ("placeholders", {"n": 1}, r"len(regexp_extract_all(r, '\[.*?\]')) >= 1"),
    "bullets_2": ("bullets", {"n": 2}, r"len(regexp_extract_all(r, '(?m)^\s*\*[^*].*$')) + len(regexp_extract_all(r, '(?m)^\s*-.*$')) = 2"),
    "sections_1": ("sections", {"title": "Section", "n": 1}, r"len(regexp_extract_all(r, 'Section\s?[0-9]+')) >= 1"),
    "paragraphs_3": ("paragraphs", {"n": 3}, f"len(list_filter({_THREE}, lambda p: p <> '')) = 3 AND NOT list_contains({_THREE}[2:-2], '')"),
    "two": ("two_responses", {}, f"len(list_filter({_SIX}, lambda p: p <> '')) = 2 AND NOT list_contains({_SIX}[2:-2], '') AND list_filter({_SIX}, lambda p: p <> '')[1] <> list_filter({_SIX}, lambda p: p <> '')[2]"),
    "repeats": ("repeats", {"prompt": "first"}, r"starts_with(lower(regexp_replace(r, '^\s+|\s+$', '', 'g')), 'first')"),
}
_ALL = ", ".join(f"coalesce(trim(r) <> '' AND ({q}), false) AS {n}" for n, (_, _, q) in CHECKS.items())


def results(spark, sf_dir):
    rows = responses(spark, sf_dir)
    return rows.select("doc_id", "lang", *[check(c, F.col("r"), **args).alias(n) for n, (c, args, _) in CHECKS.items()])


@query(f"WITH {_R} SELECT doc_id, {_ALL} FROM r")
def checker_results(spark, sf_dir):
    return results(spark, sf_dir).drop("lang")


_ENG = ", ".join(f"coalesce(trim(r) <> '' AND ({q}), false) AS {n}" for n, (_, _, q) in ENGLISH_CHECKS.items())


@query(f"WITH {_R} SELECT doc_id, {_ENG} FROM r")
def english_checker_results(spark, sf_dir):
    rows = responses(spark, sf_dir)
    return rows.select("doc_id", *[check(c, F.col("r"), ENGLISH, **args).alias(n) for n, (c, args, _) in ENGLISH_CHECKS.items()])


@query(f"WITH {_R} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id % 3 < 2 ELSE contains(r, 'My answer is no.') END AS chosen FROM r")
def constrained_options(spark, sf_dir):
    """One of the answers of the response's language."""
    even, said = F.col("doc_id") % 2 == 0, F.when(F.col("doc_id") % 3 == 0, "Ya: Jawabanku ora.").when(F.col("doc_id") % 3 == 1, "Jawabanku mungkin. Ora.").otherwise("Jawabanku")
    rows = responses(spark, sf_dir)
    return rows.select("doc_id", F.when(even, check("one_of", said, language="jv")).otherwise(check("one_of", F.col("r"), language="en")).alias("chosen"))


_U = "u AS (" + " UNION ALL ".join(f"SELECT doc_id, lang, '{n}' AS name, {n} AS passed FROM c" for n in CHECKS) + ")"


@query(
    f"WITH {_R}, c AS (SELECT doc_id, lang, {_ALL} FROM r), {_U} SELECT lang, name, count_if(passed)::BIGINT AS n_passed, count_if(NOT passed)::BIGINT AS n_failed, avg(passed::INT)::DOUBLE * 100 AS accuracy FROM u WHERE NOT (name = 'words_100' AND lang = 'de') GROUP BY GROUPING SETS ((lang, name), (lang))",
    "accuracy",
)
def checker_summary(spark, sf_dir):
    """Counts and accuracy per language and check, and of all checks under a null name; one language is without word counts here."""
    rows = results(spark, sf_dir).select("lang", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("passed")) for n in CHECKS])).alias("e")).select("lang", "e.name", "e.passed")
    rows = counted(rows, {n: c for n, (c, _, _) in CHECKS.items()}, [*EXCLUDED, ("words", "de")])
    sets = [[F.col("lang"), F.col("name")], [F.col("lang")]]
    return rows.groupingSets(sets, "lang", "name").agg(
        F.count_if("passed").alias("n_passed"), F.count_if(~F.col("passed")).alias("n_failed"), (F.avg(F.col("passed").cast("int")) * 100).alias("accuracy")
    )


_LINES = "v AS (SELECT doc_id, r AS v FROM r UNION ALL SELECT doc_id, array_to_string(string_split(r, chr(10))[2:], chr(10)) FROM r UNION ALL SELECT doc_id, array_to_string(string_split(r, chr(10))[:-2], chr(10)) FROM r UNION ALL SELECT doc_id, array_to_string(string_split(r, chr(10))[2:-2], chr(10)) FROM r)"


@query(
    f"""WITH {_R}, {_LINES}, w AS (SELECT doc_id, v FROM v UNION ALL SELECT doc_id, replace(v, '*', '') FROM v)
    SELECT doc_id, bool_or(coalesce(trim(v) <> '' AND NOT contains(v, ','), false)) AS loose, any_value(strict) AS strict FROM w
    JOIN (SELECT doc_id, trim(r) <> '' AND NOT contains(r, ',') AS strict FROM r) s USING (doc_id) GROUP BY doc_id"""
)
def loose_vs_strict(spark, sf_dir):
    return responses(spark, sf_dir).select("doc_id", check("no_comma", F.col("r")).alias("strict"), loose("no_comma", F.col("r")).alias("loose"))


@query(
    f"WITH {_R}, c AS (SELECT doc_id, lang, {_ALL} FROM r) SELECT lang, avg((words_100 AND no_comma)::INT)::DOUBLE AS prompt_level, avg((words_100::INT + no_comma::INT) / 2.0::DOUBLE) AS instruction_level FROM c GROUP BY lang",
    "prompt_level instruction_level",
)
def prompt_and_instruction_level(spark, sf_dir):
    """All of a prompt's instructions, against the mean of them."""
    rows = results(spark, sf_dir)
    both = F.array("words_100", "no_comma")
    return rows.groupBy("lang").agg(
        F.avg(F.forall(both, lambda x: x).cast("int")).alias("prompt_level"), F.avg(F.size(F.filter(both, lambda x: x)) / 2).alias("instruction_level")
    )
