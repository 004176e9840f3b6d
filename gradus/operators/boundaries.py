"""Sentence boundaries learned from a corpus without marked examples.

A word that nearly always has a full stop is an abbreviation; a word that follows
full stops more often than chance has it is a starter. Both are log-likelihood ratios
over counts of words and of their neighbours, after Kiss and Strunk, "Unsupervised
multilingual sentence boundary detection" (2006).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds of the published method, and how often an abbreviation has its full stop.
ABBREVIATION, STARTER, WITH_STOP = 0.3, 30.0, 0.99
OPENING, CLOSED = r"""^["'“”‘’«»(\[{*_]+""", r"""["'“”‘’«»)\]}*_,;:]+$"""


#: A token without the quotes and brackets round it, and without what else may follow a word; one that is nothing but these is none.
TOKEN = r"""(?<![^\x09-\x0D\x20])["'“”‘’«»(\[{*_]*+([^\x09-\x0D\x20]*[^\x09-\x0D\x20"'“”‘’«»)\]}*_,;:])"""


def word(token: Column) -> Column:
    """The word that is counted: lower case, its final full stop aside, numbers all alike."""
    plain = F.lower(F.regexp_replace(token, r"\.\z", ""))
    return F.when(plain.rlike(r"^[-+]?[0-9][0-9.,]*\z"), "#").otherwise(plain)


def marked(token: Column) -> Column:
    return F.right(token, F.lit(1)).isin(".", "?", "!")


def neighbours(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, next): every token of a text, and the one that follows it, null after the last."""
    rows = docs.select(key, F.regexp_extract_all(F.col(text), F.lit(TOKEN)).alias("token"))
    pairs = F.arrays_zip("token", F.slice("token", 2, 1 << 30).alias("next"))
    # outer, as Spark else asks first whether there are any tokens, for which it cuts the text again
    return rows.select(key, F.explode_outer(pairs).alias("_p")).select(key, "_p.token", "_p.next").where(F.col("token").isNotNull())


def tallied(pairs: DataFrame) -> DataFrame:
    """(token, times): the same tokens are counted first, and only distinct ones are made words."""
    return pairs.groupBy("token").agg(F.count("*").alias("times"))


def by_word(rows: DataFrame, token: str, name: str, **sums: Column) -> DataFrame:
    """``rows`` of distinct tokens by their words, and whether a word has letters.

    The key is never null and letters are an aggregate, as Spark would move a condition on
    the key below both counts, to every token of every text.
    """
    key = F.coalesce(word(F.col(token)), F.lit(""))
    return rows.groupBy(key.alias(name)).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()], F.bool_or(key.rlike(r"\p{L}")).alias("_letters"))


def log_likelihood(k: Column, n: Column, p: Column) -> Column:
    """Of k successes in n, 0 for what can't be otherwise."""
    term = lambda times, share: F.when(times > 0, times * F.log(share)).otherwise(F.lit(0.0))
    return term(k, p) + term(n - k, 1 - p)


def abbreviations(pairs: DataFrame) -> DataFrame:
    """(word, n_stop, n_bare, ratio, score) of every word that has a full stop somewhere: from ``ABBREVIATION`` on it is taken for an abbreviation.

    The ratio compares a full stop as frequent as anywhere with one nearly always;
    short words, words with full stops inside, and words seldom without one gain.
    """
    stop = F.col("token").endswith(".")
    counts = by_word(tallied(pairs), "token", "word", n_stop=F.when(stop, F.col("times")), n_bare=F.when(~stop, F.col("times")))
    totals = counts.agg((F.sum("n_stop") / F.sum(F.col("n_stop") + F.col("n_bare"))).alias("share"))  # one row
    rows = counts.where((F.col("n_stop") > 0) & F.col("_letters")).join(F.broadcast(totals))
    k, n = F.col("n_stop"), F.col("n_stop") + F.col("n_bare")
    ratio = -2 * (log_likelihood(k, n, F.col("share")) - log_likelihood(k, n, F.lit(WITH_STOP)))
    inside = F.regexp_count("word", F.lit(r"\."))
    letters = F.length("word") - inside
    rows = rows.select("word", "n_stop", "n_bare", ratio.alias("ratio"), inside.alias("_i"), letters.alias("_l"))
    score = F.col("ratio") * F.exp(-F.col("_l")) * (F.col("_i") + 1) * F.pow(F.col("_l").cast("double"), -F.col("n_bare").cast("double"))
    return rows.select("word", "n_stop", "n_bare", "ratio", score.alias("score"))


def known(scores: DataFrame) -> DataFrame:
    return scores.where(F.col("score") >= ABBREVIATION).select(F.col("word").alias("abbreviation"))


def ends(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """The tokens that end with a mark, with the abbreviation that they are, or null. Others meet no table."""
    return pairs.where(marked(F.col("token"))).join(known(scores), word(F.col("token")) == F.col("abbreviation"), "left")


def starters(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """(word, n_after, n_all, ratio) of words after the marks that no abbreviation explains: from ``STARTER`` on, and more often there than elsewhere, a word starts sentences."""
    followed = pairs.where(marked(F.col("token")) & F.col("next").isNotNull()).groupBy("token", "next").agg(F.count("*").alias("times"))
    after = ends(followed, scores).where(F.col("abbreviation").isNull() | ~F.col("token").endswith("."))
    found = by_word(after, "next", "word", n_after=F.col("times"))
    every = by_word(tallied(pairs), "token", "_w", n_all=F.col("times")).drop("_letters")
    breaks, total = found.agg(F.sum("n_after").alias("breaks")), every.agg(F.sum("n_all").alias("total"))  # one row each
    rows = found.where("_letters").join(every, F.col("word") == F.col("_w")).join(F.broadcast(breaks)).join(F.broadcast(total))
    a, b, m, n = F.col("n_after"), F.col("n_all"), F.col("breaks"), F.col("total")
    alike = log_likelihood(a, m, b / n) + log_likelihood(b - a, n - m, b / n)
    apart = log_likelihood(a, m, a / m) + log_likelihood(b - a, n - m, (b - a) / (n - m))
    return rows.where(n > m).select("word", "n_after", "n_all", (-2 * (alike - apart)).alias("ratio"), (a / m > b / n).alias("more"))


def sentence_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n): sentences of each text, by what the texts themselves teach. Texts without words have none.

    A question or exclamation mark ends a sentence, and so does a full stop, unless its
    word is an abbreviation that no capitalised starter follows.
    """
    pairs = neighbours(docs, key, text)
    scores = abbreviations(pairs)
    begin = starters(pairs, scores).where((F.col("ratio") >= STARTER) & F.col("more")).select(F.col("word").alias("starter"))
    stops = ends(pairs, scores).withColumn("_w", word(F.col("next"))).join(begin, F.col("_w") == F.col("starter"), "left")
    short = F.col("token").endswith(".") & F.col("abbreviation").isNotNull()
    goes_on = F.col("next").isNull() | ~short | (F.col("starter").isNotNull() & F.col("next").rlike(r"^\p{Lu}"))
    counts = stops.groupBy(key).agg(F.count_if(goes_on & F.col("next").isNotNull()).alias("n"))
    # the last token closes a sentence, whatever it is
    return docs.select(key, F.when(F.col(text).rlike(r"""[^\x09-\x0D\x20"'“”‘’«»()\[\]{}*_,;:]"""), 1).otherwise(0).alias("_last")).join(counts, key, "left").select(key, (F.col("_last") + F.coalesce("n", F.lit(0))).cast("long").alias("n"))
