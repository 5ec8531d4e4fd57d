"""Signals, risk, routing and sender checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import policy
from ..sources.tables import table
from .registry import query


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a made-up report, a bit of the doc_id for each fact."""
    k = F.col("doc_id")
    bit = lambda i: F.shiftright(k, i).bitwiseAND(F.lit(1)) == 1
    none = F.array().cast("array<string>")
    auth = F.when(k % 5 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("spf"), F.when(k % 5 == 1, "fail").otherwise("pass"), F.lit("dkim"), F.when(k % 5 < 3, "softfail").otherwise("none")))
    report: Column = F.struct(
        bit(0).alias("reply_to_mismatch"), bit(1).alias("return_path_mismatch"), auth.alias("auth_results"),
        F.when(bit(2), F.array(F.lit("xn--a[.]example"))).otherwise(none).alias("punycode_domains"), F.when(bit(3), F.array(F.lit("pа[.]example"))).otherwise(none).alias("mixed_script_domains"),
        (k % 3).alias("blocked_attachments"), bit(4).alias("encrypted"), (k % 7).alias("links_removed"), bit(5).alias("hidden_text_removed"), bit(6).alias("html_divergent"),
        (k % 2).alias("control_chars_removed"), F.lit(False).alias("truncated"), F.lit(False).alias("id_collision"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", policy.signals(report).alias("signals"))


_BITS = """
b AS (SELECT doc_id, doc_id & 1 = 1 AS rt, (doc_id >> 1) & 1 = 1 AS rp, (doc_id >> 2) & 1 = 1 AS pu, (doc_id >> 3) & 1 = 1 AS mi, (doc_id >> 4) & 1 = 1 AS en, (doc_id >> 5) & 1 = 1 AS hi, (doc_id >> 6) & 1 = 1 AS di,
       CASE doc_id % 5 WHEN 0 THEN 'auth_missing' WHEN 1 THEN 'auth_failed' WHEN 2 THEN 'auth_failed' ELSE 'auth_ok' END AS au FROM documents),
k AS (SELECT *, list_filter([CASE WHEN rt THEN 'reply_to_mismatch' END, CASE WHEN rp THEN 'return_path_mismatch' END, au, CASE WHEN pu THEN 'punycode' END, CASE WHEN mi THEN 'mixed_script' END,
       CASE WHEN doc_id % 3 > 0 THEN 'blocked_attachments' END, CASE WHEN en THEN 'encrypted' END, 'links_removed', CASE WHEN hi THEN 'hidden_text' END, CASE WHEN di THEN 'html_divergent' END,
       CASE WHEN doc_id % 2 > 0 THEN 'control_chars' END], lambda x: x IS NOT NULL) AS keys FROM b)"""


@query(f"WITH {_BITS} SELECT doc_id, array_to_string(keys, ',') AS keys, CAST(pu AS INTEGER) + CAST(mi AS INTEGER) AS n_hard FROM k")
def signal_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).select("doc_id", F.array_join(F.transform("signals", lambda s: s["key"]), ",").alias("keys"), F.size(F.filter("signals", lambda s: s["hard"])).alias("n_hard"))


@query(f"""
WITH {_BITS}, l AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1),
s AS (SELECT k.doc_id, coalesce(toxic, 0) = 1 AS sus, pu, mi, list_filter(keys, lambda x: x IN ('auth_failed', 'reply_to_mismatch', 'return_path_mismatch', 'punycode', 'mixed_script')) AS sp FROM k LEFT JOIN l USING (doc_id)),
j AS (SELECT *, len(sp) >= 3 AND (pu OR mi) AS joint FROM s),
m AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'low' ELSE 'high' END AS model FROM j),
r AS (SELECT doc_id, greatest(doc_id % 3, CASE WHEN joint THEN 2 WHEN sus OR pu OR mi THEN 1 ELSE 0 END) AS rank,
      list_concat(list_filter([CASE WHEN joint THEN 'several independent spoofing signals: ' || array_to_string(list_transform(sp, lambda x: map {{'auth_failed': 'sender authentication failed', 'reply_to_mismatch': 'differing reply address', 'return_path_mismatch': 'differing return path', 'punycode': 'punycode domain', 'mixed_script': 'mixed writing systems'}}[x]), ', ') END,
        CASE WHEN sus THEN 'critic output contained disallowed content (removed)' END, CASE WHEN pu THEN 'punycode domain' END, CASE WHEN mi THEN 'mixed writing systems' END], lambda x: x IS NOT NULL),
        CASE WHEN doc_id % 4 = 0 THEN ['model says so'] ELSE [] END) AS reasons FROM m)
SELECT doc_id, ['none', 'low', 'high'][rank + 1] AS risk, array_to_string(CASE WHEN rank > 0 AND len(reasons) = 0 THEN ['the critic reports a risk without giving a reason'] ELSE reasons[1:5] END, '|') AS reasons FROM r""")
def risk_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = _facts(spark, sf_dir).join(labels, "doc_id", "left")
    model = policy.at_rank(F.col("doc_id") % 3, policy.RISKS)
    reasons = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("model says so"))).otherwise(F.array().cast("array<string>"))
    out = rows.select("doc_id", policy.verdict(model, reasons, F.coalesce(F.col("toxic"), F.lit(0)) == 1, F.col("signals")).alias("v"))
    return out.select("doc_id", F.col("v.risk").alias("risk"), F.array_join("v.reasons", "|").alias("reasons"))


_LABELS = "l AS (SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY 1), d AS (SELECT doc_id, CASE q WHEN 1 THEN 'high' WHEN 0 THEN 'low' ELSE 'normal' END AS importance, CASE WHEN t = 1 THEN 'high' ELSE 'none' END AS risk FROM documents LEFT JOIN l USING (doc_id))"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels stand in for a model's importance and risk."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    rows = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("q") == 1, "high").when(F.col("q") == 0, "low").otherwise("normal").alias("importance"), F.when(F.col("t") == 1, "high").otherwise("none").alias("risk"))


@query(f"WITH {_LABELS} SELECT doc_id, importance <> 'low' AS meets FROM d")
def importance_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("doc_id", policy.meets(F.col("importance"), "normal").alias("meets"))


@query(f"""
WITH {_LABELS} SELECT doc_id, CASE WHEN risk = 'high' AND importance = 'low' THEN 'normal' ELSE importance END AS importance,
CASE WHEN doc_id % 10 = 0 OR doc_id % 17 = 0 THEN 'failed' WHEN risk <> 'high' AND importance = 'low' THEN 'queued_low' ELSE 'delivered' END AS status FROM d""")
def route(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = policy.route(F.col("risk"), F.col("importance"), F.col("doc_id") % 17 != 0, F.col("doc_id") % 10 == 0, "normal")
    return _judged(spark, sf_dir).select("doc_id", r["importance"].alias("importance"), r["status"].alias("status"))


_RESULTS = "['pass', 'fail', 'softfail', 'none', 'neutral', 'policy', 'permerror']"


@query(f"""
WITH r AS (SELECT doc_id, {_RESULTS}[length(coalesce(text, '')) % 7 + 1] AS a, {_RESULTS}[length(coalesce(lang, '')) * doc_id % 7 + 1] AS b, {_RESULTS}[coalesce(n_chars, 0) % 5 + 1] AS c, length(coalesce(text, '')) % 2 = 0 AS two FROM documents)
SELECT doc_id, CASE WHEN two THEN 'dkim=' || b || ',dmarc=' || c || ',' ELSE '' END || 'spf=' || a AS results,
  list_contains(['fail', 'softfail', 'permerror'], a) OR (two AND (list_contains(['fail', 'softfail', 'permerror'], b) OR list_contains(['fail', 'softfail', 'permerror'], c))) AS failed FROM r""")
def auth_results_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers whose results come from the texts' lengths: one check or three, in odd spelling, one of them said again."""
    results = F.array(*(F.lit(x) for x in ("pass", "fail", "softfail", "none", "neutral", "policy", "permerror")))
    size = F.length(F.coalesce("text", F.lit("")))
    at = lambda n: F.element_at(results, (n + 1).cast("int"))
    a, b, c = at(size % 7), at(F.length(F.coalesce("lang", F.lit(""))) * F.col("doc_id") % 7), at(F.coalesce("n_chars", F.lit(0)) % 5)
    one = F.concat(F.lit("mx."), F.coalesce("source", F.lit("none")), F.lit(".example; spf = "), F.upper(a))
    header = F.when(size % 2 == 0, F.concat(one, F.lit(" (ok) ;dmarc="), c, F.lit("; DKIM= "), b, F.lit("; spf=pass"))).otherwise(one)
    found = policy.parse_auth(F.lower(header))
    bad = F.exists(found, lambda x: ~F.substring_index(x, "=", -1).isin(*policy.AUTH_FINE))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(found, ",").alias("results"), bad.alias("failed"))


@query("""
WITH a AS (SELECT c_custkey, s_suppkey, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'n' || c_nationkey || '@bank.example' END AS own, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'n' || s_nationkey || '@bank.example' END AS other, c_custkey % 3 = 0 AS none
  FROM customer JOIN supplier ON c_custkey % (SELECT count(*) FROM supplier) = s_suppkey)
SELECT c_custkey, s_suppkey, NOT none AND (own <> '' OR other <> '') AND (other = '' OR other <> own) AS reply_mismatch FROM a""")
def reply_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers answer to suppliers: addresses are equal where the nations are, some are unknown on either side, a third names no other."""
    suppliers = table(spark, sf_dir, "supplier")
    rows = table(spark, sf_dir, "customer").withColumn("s_suppkey", F.col("c_custkey") % suppliers.count()).join(suppliers, "s_suppkey")
    own = F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.concat(F.lit("N"), F.col("c_nationkey").cast("string"), F.lit("@Bank.example ")))
    other = F.when(F.col("s_suppkey") % 5 == 0, "").otherwise(F.concat(F.lit(" n"), F.col("s_nationkey").cast("string"), F.lit("@bank.Example")))
    given = F.when(F.col("c_custkey") % 3 == 0, F.lit(None).cast("string")).otherwise("x")
    return rows.select("c_custkey", "s_suppkey", policy.reply_mismatch(own, given, F.array(other)).alias("reply_mismatch"))


@query("SELECT c_custkey, s_suppkey, c_custkey % 3 = 1 OR (c_custkey % 3 = 2 AND c_nationkey <> s_nationkey) AS path_mismatch FROM customer JOIN supplier ON c_custkey % (SELECT count(*) FROM supplier) = s_suppkey")
def return_path_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier")
    rows = table(spark, sf_dir, "customer").withColumn("s_suppkey", F.col("c_custkey") % suppliers.count()).join(suppliers, "s_suppkey")
    k = F.col("c_custkey") % 3
    own = F.when(k == 1, "").otherwise(F.concat(F.lit("N"), F.col("c_nationkey").cast("string"), F.lit(".example")))
    back = F.when(k == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit(".example")))
    return rows.select("c_custkey", "s_suppkey", policy.return_path_mismatch(own, back).alias("path_mismatch"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'forged_marker,control_burst,instruction_phrase' WHEN doc_id % 4 = 1 THEN 'control_burst' WHEN doc_id % 4 = 2 THEN 'instruction_phrase' ELSE '' END AS evidence FROM documents")
def evidence_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(policy.evidence(F.col("text"), F.when(k < 2, 8).otherwise(7), F.when(k == 0, 1).otherwise(0), k.isin(0, 2)), ",").alias("evidence"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 4096 ELSE 2000 END AS part_limit FROM events")
def part_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..kernels.output import PART_CHARS

    name = F.when(F.col("event_type") == "view", "telegram").when(F.col("event_type") == "click", "signal").otherwise("fax")
    limits = F.create_map(*[F.lit(x) for pair in PART_CHARS.items() for x in pair])
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_element_at(limits, name), F.lit(min(PART_CHARS.values()))).alias("part_limit"))


@query("SELECT doc_id, array_to_string(list_filter([lang, source], lambda x: x IN ('en', 'src1', 'src2')), ',') AS known FROM documents")
def known_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that a model gave, less those nobody knows."""
    known = F.array(*(F.lit(x) for x in ("en", "src1", "src2")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.filter(F.array("lang", "source"), lambda x: F.array_contains(known, x)), ",").alias("known"))
