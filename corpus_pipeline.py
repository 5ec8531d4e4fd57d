"""From raw documents to token ids: filter, deduplicate, mix and encode.

Each stage takes the rows that the one before kept and returns them with the columns of ``documents``; the
last returns each document's token ids. Results between stages are tables in the shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from postlake.llm import bpe, mixing, simhash, substring, toxicity
from postlake.llm.common import cut, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the limit go. Held-out rows teach nothing here either."""
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.not_toxic(docs, lexicon)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that share 0.8 of their five-word shingles with one that stays and has a smaller id."""
    return simhash.one_of_near(docs)


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that stand earlier in the corpus are cut."""
    return substring.deduplicated(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample that meets the target weights of sources, languages and topics."""
    return mixing.sampled(docs, calibrated=True)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxic_out),
    ("simhash", near_copies_out),
    ("substring", repeats_out),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: Mixing and the learned lexicon have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
