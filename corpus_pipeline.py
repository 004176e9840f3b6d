"""From raw documents to token ids, stage by stage.

Each stage takes (spark, docs, sf_dir), where docs has the columns of
``documents``, and returns what the next one works on. Rows go only where a stage
says so: documents of no known language, all but one of a group of near
duplicates, and those that the mix leaves out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm import bpe, language, mixing, pii, simhash
from gradus.llm.tables import cut, read


SHINGLE, RADIUS, CONFIRM = 5, 7, 24  # of the near-duplicate stage; bits of either fingerprint, and of both together


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language stay, as learned from the rows that name theirs."""
    return language.accepted(docs, language.fit(docs.where(F.col("lang").isNotNull())), least=0.4)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with close fingerprints the one with the smallest doc_id stays."""
    return simhash.first_of_each_group(docs, shingle=SHINGLE, radius=RADIUS, confirm=CONFIRM)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, personal data replaced by its kind."""
    return pii.redact(docs, pii.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs, weights=(1, 2, 3), most=3)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every document of the mix."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", remove_near_duplicates),
    ("PII", mask_personal_data),
    ("mixing sources", mix_sources),
    ("BPE", encode_tokens),
]

#: Networks, random fields and merges are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared checkpoint folder before the next begins."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
