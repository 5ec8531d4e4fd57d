"""Directories of providers: mail hosts by suffix, model presets by precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .digest import suffix_lookup


def find_preset(wanted: DataFrame, presets: DataFrame, first: str = "none", generic: str = "openai_compatible") -> DataFrame:
    """Each row of ``wanted(name, base_url)`` with a preset of ``presets(key, provider, preset_url)``, a small directory.

    First same provider and URL; then the key; then the provider, if only one preset has it. Several: the
    generic one. None: the first one.
    """
    by_url = presets.select(F.col("provider").alias("name"), F.col("preset_url").alias("base_url"), "key").groupBy("name", "base_url").agg(F.min("key").alias("by_url"))
    by_key = presets.select(F.col("key").alias("name"), F.col("key").alias("by_key"))
    by_provider = presets.groupBy(F.col("provider").alias("name")).agg(F.when(F.count("*") == 1, F.min("key")).otherwise(F.lit(generic)).alias("by_provider"))
    found = wanted.join(by_url, ["name", "base_url"], "left").join(by_key, "name", "left").join(by_provider, "name", "left")
    return found.select(*wanted.columns, F.coalesce("by_url", "by_key", "by_provider", F.lit(first)).alias("preset"))


def resolve_host(rows: DataFrame, entered: str, directory: DataFrame) -> DataFrame:
    """``rows`` with what ``directory(domain, provider, mail_host, supported)``, a small one, knows of the address or domain entered.

    ``mail_host`` is the provider's, if it is supported; else what was entered, unchanged.
    """
    domain = F.lower(F.trim(F.substring_index(F.col(entered), "@", -1)))
    found = suffix_lookup(rows.withColumn("domain_entered", domain), "domain_entered", directory.select("domain", "provider"))
    known = directory.select(F.col("domain").alias("matched"), "mail_host", "supported")
    out = found.join(known, "matched", "left")
    host = F.when(F.col("supported"), F.col("mail_host")).otherwise(F.col(entered))
    return out.select(*rows.columns, "provider", "supported", host.alias("mail_host"))
