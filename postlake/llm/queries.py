"""The operators' queries over their whole tables, and the SQL that gives the same rows where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chat, counts, knn, licenses, media, mixing, simhash, substring, toxicity, urls, whitening
from .common import cut, forget, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def licenses_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1_licenses that SQL can say."""
    return op1_licenses(spark, sf_dir).select(*licenses.BASE)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = toxicity.learn(docs, labels.where(~toxicity.held_out()))
    return toxicity.score(docs, lexicon).withColumn("held_out", toxicity.held_out())


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ids=False).drop("ids")


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.without_repeats(table(spark, sf_dir, "documents"), texts=False).drop("text")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), calibrated=True)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    columns = ["conv_id", "turn", "role", "text"]
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(*columns, F.lit(0).alias("own")).unionByName(more.withColumn("own", F.lit(1)))
    return chat.format_conversations(rows, texts=False).drop("own", "formatted")


def chat_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6_chat that SQL can say."""
    return op6_chat(spark, sf_dir).select(*chat.DIGESTS)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is sung, word by word; those whose conv_id 20 divides are looked up among all."""
    rows = table(spark, sf_dir, "conversations").where("conv_id is not null")
    turns = rows.select("conv_id", F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["text"]), "\n").alias("text"))
    prints = cut(media.fingerprints(whole, "conv_id", "text", media.sing))
    found = media.matches(prints, F.col("id") % 20 == 0).withColumnRenamed("id", "conv_id")
    forget(prints)
    return found


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, one_each=False)


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), urls.bad_label()).drop("listed")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(table(spark, sf_dir, "documents"), *paths, groups=False).drop("groups")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_licenses": op1_licenses,
    "op2_toxicity": op2_toxicity,
    "op3_bpe": op3_bpe,
    "op4_substring": op4_substring,
    "op5_mixing": op5_mixing,
    "op6_chat": op6_chat,
    "op7_media": op7_media,
    "op8_simhash": op8_simhash,
    "op9_topk": op9_topk,
    "op10_urls": op10_urls,
    "op11_token_counts": op11_token_counts,
    "op12_alignment": op12_alignment,
    "op13_whitening": op13_whitening,
    "licenses_base": licenses_base,
    "chat_digests": chat_digests,
}

ORACLE: dict[str, str] = {
    "licenses_base": licenses.SQL,
    "chat_digests": chat.SQL,
    "op4_substring": substring.SQL,
    "op9_topk": knn.SQL,
    "op10_urls": urls.SQL,
}
