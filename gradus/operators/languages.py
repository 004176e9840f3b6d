"""Language of a text by its most frequent letter groups, and the checks that ask for it.

Every language has a profile, its most frequent groups of one to three letters in
order of frequency, learned from texts that name theirs. A text is in the language
from whose order its own differs least (Cavnar and Trenkle, "N-gram-based text
categorization", 1994).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.functions.checkers import all_capitals, all_lower

SIZE, LONGEST = 300, 3


def groups(word: Column) -> Column:
    """Letter groups of a word between two marks of its ends, in time that grows with its length."""
    marked = F.concat(F.lit("_"), word, F.lit("_"))
    letters = F.regexp_extract_all(word, F.lit("(?s)([^_])"))
    # every match moves on by one letter and looks ahead at the others
    longer = [F.regexp_extract_all(marked, F.lit(f"(?s)(?!__)(?=(.{{{n}}}))."), F.lit(1)) for n in range(2, LONGEST + 1)]
    return F.concat(letters, *longer)


def counted(docs: DataFrame, by: str, text: str) -> DataFrame:
    """(by, gram, n): letter groups of all words; words are counted first, and only distinct ones are cut up."""
    words = docs.select(by, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{M}]+)"))).alias("word"))
    words = words.groupBy(by, "word").agg(F.count("*").alias("times"))
    return words.select(by, "times", F.explode(groups(F.col("word"))).alias("gram")).groupBy(by, "gram").agg(F.sum("times").alias("n"))


def ranked(counts: DataFrame, by: str, size: int = SIZE) -> DataFrame:
    """(by, gram, rank): the most frequent groups, from 1; ties in the order of the alphabet."""
    order = Window.partitionBy(by).orderBy(F.col("n").desc(), "gram")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).select(by, "gram", "rank")


def profiles(docs: DataFrame, language: str, text: str, size: int = SIZE) -> DataFrame:
    """(language, gram, rank) of every language that texts name."""
    return ranked(counted(docs.where(F.col(language).isNotNull()), language, text), language, size)


def nearest(docs: DataFrame, key: str, text: str, known: DataFrame, language: str, size: int = SIZE) -> DataFrame:
    """(key, language, distance): the language nearest to each text, the first by name among equals; null for texts without letters.

    A group that the language's profile lacks counts as ``size`` ranks apart. ``known``
    has at most ``size`` rows for each language, and is broadcast. Texts are dealt out by
    key once; words, groups and ranks are counted where they are.
    """
    own = ranked(counted(docs.select(key, text).repartition(F.col(key)), key, text), key, size)
    other = F.broadcast(known.select(F.col(language).alias("_language"), F.col("gram").alias("_gram"), F.col("rank").alias("_rank")))
    near = own.join(other, F.col("gram") == F.col("_gram"), "left").groupBy(key, "_language").agg(F.sum(F.abs(F.col("rank") - F.col("_rank")) - size).alias("_gain"), F.max("rank").alias("_last"))
    # the last rank of all is the number of groups; those that no profile has are under no language
    best = near.groupBy(key).agg((F.max("_last") * size).alias("_most"), F.min(F.when(F.col("_language").isNotNull(), F.struct("_gain", "_language"))).alias("_best"))
    found = best.select(F.col(key).alias("_key"), F.col("_best._language").alias("language"), (F.col("_most") + F.col("_best._gain")).alias("distance"))
    return docs.select(key).join(found, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, "language", "distance")


def language_checks(responses: DataFrame, key: str, response: str, expected: str, found: DataFrame, english: str = "en") -> DataFrame:
    """(key, in_language, english_capitals, english_lower) of responses whose languages are ``found``: in the expected language, and English in capitals or small letters only."""
    checked = responses.select(key, expected, all_capitals(F.col(response)).alias("_capitals"), all_lower(F.col(response)).alias("_lower"))  # before the join, which moves no texts
    rows = checked.join(found.select(F.col(key).alias("_key"), "language"), F.col(key) == F.col("_key"))
    is_english = F.coalesce(F.col("language") == english, F.lit(False))
    return rows.select(
        key,
        F.coalesce(F.col("language") == F.col(expected), F.lit(False)).alias("in_language"),
        (is_english & F.col("_capitals")).alias("english_capitals"),
        (is_english & F.col("_lower")).alias("english_lower"),
    )
