"""The registered queries of this subpackage: one per operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm import alignment, bpe, chat, language, links, mixing, negatives, pii, quality, repeats, simhash, vectors, weighted
from gradus.llm.sampling import held_out
from gradus.llm.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consistent weighted samples of every text and of its edited text, and their likeness."""
    return weighted.compare_edited(read(spark, sf_dir, "documents"), samples=128, shingle=5)


@query
def op2_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    return chat.render(read(spark, sf_dir, "conversations"))


ORACLE["op2_chat_collapse"] = chat.ORACLE_SQL


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the factorisation machine, learned from the labels of four folds of five."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    machine = quality.fit(docs, labels.where(~held_out(F.col("doc_id"))), "quality", ["n_chars"], each=1500)
    found = quality.score(docs, machine, ["n_chars"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query
def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the rules, and of trust and distrust where no rule fits."""
    return links.judge(read(spark, sf_dir, "pages"), RULES).drop("trust", "distrust")


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages by the byte network, learned from four folds of five."""
    docs = read(spark, sf_dir, "documents")
    net = language.fit(docs.where(~held_out(F.col("doc_id"))), each=600)
    found = language.predict(docs, net)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of sources at 1, 2 and 3 parts takes of every document."""
    found = mixing.mix(read(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3)
    return found.select("doc_id", "size", "source_size", "target", "taken")


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts, and digests of ids and of the decoded bytes."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, digests=True)


@query
def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at a cosine of 0.93 within each label, and components."""
    return vectors.near_duplicates(read(spark, sf_dir, "embeddings"), least=0.93)


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data by patterns and by the random field."""
    docs = read(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs, sample=2000))


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles, and components at a radius of 3 bits."""
    found = simhash.groups(read(spark, sf_dir, "documents"), shingle=3, radius=3)
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of two tokenizers in every text, with corpus-wide counts of their pairs."""
    files = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align(read(spark, sf_dir, "documents"), *files, pattern=public_tokenizers.PATTERN)


@query
def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of anchors in the windows of their positives' scores."""
    return negatives.mine(read(spark, sf_dir, "embeddings"), every=100, k=5)


ORACLE["op12_negatives"] = negatives.ORACLE_SQL


@query
def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words outside windows of 20 words that start earlier too."""
    found = repeats.without_repeats(read(spark, sf_dir, "documents"), window=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE["op13_repeats"] = repeats.ORACLE_SQL
