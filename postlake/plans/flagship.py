"""The flagship: screen documents, claim each text once, count by source and outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import policy, state
from ..sources.tables import table
from .registry import query


def screened(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document. Labels stand in for a model's output: quality for importance, toxic for risk."""
    clean: Column = T.one_line(T.clean_controls(F.coalesce("text", F.lit(""))))
    known = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = docs.select("doc_id", "source", clean.alias("text_clean"), T.controls(F.coalesce("text", F.lit(""))).alias("removed")).join(known, "doc_id", "left")
    importance = F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").otherwise("normal")
    risk = F.when(F.col("toxic") == 1, "high").otherwise("none")
    evidence = policy.evidence(F.col("text_clean"), F.col("removed"), F.lit(0), T.has_orders(F.col("text_clean")))
    return rows.select(
        "doc_id",
        "source",
        F.sha2("text_clean", 256).alias("hash"),
        policy.route(risk, importance, F.lit(True), F.lit(False), "normal")["status"].alias("status"),
        (F.size(T.domain_tokens(F.col("text_clean"))) + F.size(T.ipv4_tokens(F.col("text_clean")))).cast("long").alias("n_defanged"),
        F.size(evidence).cast("long").alias("n_evidence"),
    )


@query(r"""
WITH k AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT d.doc_id, d.source, regexp_replace(coalesce(d.text, ''), '\r\n?', chr(10), 'g') AS t, k.quality, k.toxic
  FROM documents d LEFT JOIN k USING (doc_id)),
c AS (
  SELECT doc_id, source, quality, toxic,
         trim(regexp_replace(regexp_replace(t, '[\x00-\x08\x0B-\x1F\x7F-\x9F\x{00AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]', '', 'g'), '\s+', ' ', 'g')) AS text_clean,
         length(t) - length(regexp_replace(t, '[\x00-\x08\x0B-\x1F\x7F-\x9F\x{00AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]', '', 'g')) AS removed
  FROM d),
s AS (
  SELECT doc_id, source, sha256(text_clean) AS hash,
         CASE WHEN coalesce(toxic, 0) <> 1 AND coalesce(quality, 2) = 0 THEN 'queued_low' ELSE 'delivered' END AS status,
         len(list_filter(regexp_extract_all(text_clean, '([A-Za-z0-9][A-Za-z0-9\-]*(?:\.[A-Za-z0-9\-]+)+)'), lambda x: len(list_filter(string_split(x, '.')[2:], lambda l: regexp_matches(l, '^[A-Za-z]{2}'))) > 0))
           + len(regexp_extract_all(text_clean, '(\d{1,3}(?:\.\d{1,3}){3,})')) AS n_defanged,
         CAST(removed >= 8 AS INTEGER) + CAST(regexp_matches(text_clean, '(?i)(?:ignore|forget|disregard)\s+(?:all\s+)?(?:your|the)?\s*(?:previous|prior|above)\s+(?:instructions?|rules?|prompts?)') AS INTEGER) AS n_evidence
  FROM c),
f AS (SELECT hash, min(doc_id) AS doc_id FROM s GROUP BY hash)
SELECT s.source, s.status, count(*) AS n_docs, CAST(sum(s.n_defanged) AS BIGINT) AS n_defanged, CAST(sum(s.n_evidence) AS BIGINT) AS n_evidence, min(s.doc_id) AS first_doc_id
FROM s JOIN f ON s.hash = f.hash AND s.doc_id = f.doc_id GROUP BY s.source, s.status""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = screened(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    # the first document of each text, by a partial aggregate: a text that a third of all rows share is no hot key
    first = rows.groupBy("hash").agg(F.min_by(F.struct("doc_id", "source", "status", "n_defanged", "n_evidence"), "doc_id").alias("d")).select("d.*")
    return first.groupBy("source", "status").agg(F.count("*").alias("n_docs"), F.sum("n_defanged").alias("n_defanged"), F.sum("n_evidence").alias("n_evidence"), F.min("doc_id").alias("first_doc_id"))
