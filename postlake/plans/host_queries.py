"""Input checks, directories, templates, zone lines, states and check tables over pages, documents, events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import links as L
from ..functions import text as X
from ..operators import checks, hosting, mail, providers, state
from ..sources.tables import settled, table
from .mail_queries import messages
from .registry import query
from .url_queries import HOST_SQL

_IPV4 = "CASE page_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE '203.0.113.' || (page_id % 256) END"
_IPV6 = "CASE WHEN page_id % 2 = 1 THEN '2001:db8::' || (page_id % 10) END"


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", L.host_of(F.col("url")).alias("host"))


@query(f"""
WITH h AS (SELECT page_id, {HOST_SQL} AS host, {_IPV4} AS v4, {_IPV6} AS v6 FROM pages)
SELECT page_id, host || '.   A     ' || coalesce(nullif(v4, ''), '{hosting.NO_IPV4.replace("'", "''")}') || chr(10)
  || CASE WHEN v6 IS NULL THEN '' ELSE host || '.   AAAA  ' || v6 || chr(10) END || host || '.   MX 10 ' || host || '.' AS zone FROM h""")
def dns_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = hosting.dns_records(F.col("host"), F.expr(_IPV4), F.expr(_IPV6))
    return _hosts(spark, sf_dir).select("page_id", F.array_join(lines, "\n").alias("zone"))


@query(f"SELECT page_id, 'mirror-' || left(sha256(url), 8) || '@' || {HOST_SQL} AS address FROM pages")
def mirror_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses from a noise that SQL knows too; in use it is random."""
    return _hosts(spark, sf_dir).select("page_id", hosting.mirror_address(F.col("host"), F.col("url")).alias("address"))


@query("""
WITH d AS (SELECT doc_id, doc_id % 3 AS k, coalesce(text, '') AS t, coalesce(lang, '') AS l, coalesce(source, '') AS s FROM documents),
f AS (SELECT doc_id, CASE k WHEN 0 THEN 'From ' || s || ' (' || l || '):' || chr(10) || t || chr(10) WHEN 1 THEN l || l || ' {{source}} {{Source}} {{lang ' || t END AS text, k FROM d)
SELECT doc_id, sha256(text) AS text_sha256, length(text) AS n_chars, CASE WHEN k = 2 THEN 'no value for: missing, nope' END AS problem FROM f""")
def filled_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates with names, values that look like names, unclosed names and names without a value."""
    k = F.col("doc_id") % 3
    template = F.when(k == 0, "From {{source}} ({{lang}}):\n{{text}}\n").when(k == 1, "{{lang}}{{lang}} {{odd}} {{Source}} {{lang {{text}}").otherwise("{{nope}} {{source}} {{missing}}{{nope}}")
    values = F.create_map(F.lit("source"), "source", F.lit("lang"), "lang", F.lit("text"), "text", F.lit("odd"), F.lit("{{source}}"))
    out = hosting.fill(template, values)
    return table(spark, sf_dir, "documents").select("doc_id", out.alias("f")).select("doc_id", F.sha2("f.text", 256).alias("text_sha256"), F.length("f.text").cast("long").alias("n_chars"), "f.problem")


@query(f"""
WITH h AS (SELECT page_id, page_id % 5 AS k, {HOST_SQL} AS domain, CASE WHEN page_id % 7 = 0 THEN '/srv/../live' ELSE '/etc/live/' || page_id END AS cert_dir FROM pages),
p AS (SELECT *, 'mirror-' || left(sha256(CAST(page_id AS VARCHAR)), 8) || '@' || CASE WHEN k = 1 THEN 'mail.' ELSE '' END || domain AS address,
  len(string_split(domain, '.')) >= 2 AND NOT contains(domain, 'xn--') AND length(domain) <= 253
  AND len(list_filter(string_split(domain, '.'), lambda x: NOT regexp_matches(x, '^[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?$'))) = 0 AS fine FROM h),
r AS (SELECT *, CASE k WHEN 2 THEN 'unknown keys: size' WHEN 3 THEN 'no JSON object' WHEN 4 THEN 'another version' ELSE
  CASE WHEN NOT fine THEN 'no valid domain' WHEN k = 1 THEN 'no address of the domain' WHEN page_id % 7 = 0 THEN 'no valid folder' END END AS problem FROM p)
SELECT page_id, CASE WHEN problem IS NULL THEN domain END AS domain, CASE WHEN problem IS NULL THEN address END AS address, CASE WHEN problem IS NULL THEN cert_dir END AS cert_dir,
  CASE WHEN problem IS NULL THEN '2024-01-15T10:00:00Z' END AS generated_at, problem,
  sha256('{{' || chr(10) || '  "address": "' || address || '",' || chr(10) || '  "cert_dir": "' || cert_dir || '",' || chr(10) || '  "domain": "' || domain || '",' || chr(10)
    || '  "generated_at": "2024-01-15T10:00:00Z",' || chr(10) || '  "version": 1' || chr(10) || '}}' || chr(10)) AS json_sha256 FROM r""")
def mirror_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States written and read back; of five one each has a foreign address, a key too many, half its text or another version."""
    k = F.col("page_id") % 5
    folder = F.when(F.col("page_id") % 7 == 0, "/srv/../live").otherwise(F.concat(F.lit("/etc/live/"), F.col("page_id").cast("string")))
    domain = F.when(k == 1, F.concat(F.lit("mail."), "host")).otherwise(F.col("host"))
    address = hosting.mirror_address(domain, F.col("page_id").cast("string"))
    json = hosting.state_json(F.col("host"), address, folder, F.lit("2024-01-15 10:00:00").cast("timestamp_ntz"))
    rows = _hosts(spark, sf_dir).withColumn("json", json)
    size = F.replace(F.col("json"), F.lit('"version": 1'), F.lit('"version": 1, "size": 2'))
    kept = F.when(k == 2, size).when(k == 3, F.left(F.col("json"), F.lit(30))).when(k == 4, F.replace(F.col("json"), F.lit('"version": 1'), F.lit('"version": 2'))).otherwise(F.col("json"))
    return rows.select("page_id", hosting.read_state(kept).alias("s"), F.sha2("json", 256).alias("json_sha256")).select("page_id", "s.*", "json_sha256")


_STATUS = "CASE event_id % 5 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'skipped' ELSE 'ok' END"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", "user_id", F.col("event_type").alias("name"), F.expr(_STATUS).alias("status"), F.concat(F.lit("saw "), "props").alias("detail"), F.concat(F.lit("mend "), "event_type").alias("fix"))


@query(f"WITH r AS (SELECT *, {_STATUS} AS status FROM events) SELECT event_id, event_type AS name, status, CASE WHEN status = 'ok' THEN 'saw ' || props ELSE 'mend ' || event_type END AS shown, status = 'FAIL' AS failed FROM r")
def check_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosting.check_table(_results(spark, sf_dir)).select("event_id", "name", "status", "shown", "failed")


@query(f"""
WITH r AS (SELECT user_id, {_STATUS} AS status FROM events)
SELECT user_id, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'FAIL') AS fail, count(*) FILTER (WHERE status = 'skipped') AS skipped,
  CAST(count(*) FILTER (WHERE status = 'FAIL') > 0 AS INTEGER) AS code FROM r GROUP BY user_id""")
def check_exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosting.exit_code(_results(spark, sf_dir), "user_id")


_PATH = "CASE page_id % 4 WHEN 0 THEN '/etc/live/' || page_id WHEN 1 THEN '/srv/../' || page_id WHEN 2 THEN url ELSE '/a..b/c d' END"


@query(f"WITH p AS (SELECT page_id, {_PATH} AS path FROM pages) SELECT page_id, path, regexp_matches(path, '^/[A-Za-z0-9._/-]*$') AND NOT list_contains(string_split(path, '/'), '..') AS valid FROM p")
def valid_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.expr(_PATH).alias("path")).withColumn("valid", checks.valid_folder(F.col("path")))


_TYPED = "CASE event_id % 4 WHEN 0 THEN ' ' || event_id || ' ' WHEN 1 THEN 'x' || event_id WHEN 2 THEN '-' || event_id ELSE CAST(event_id * 7 AS STRING) END"


@query(f"WITH t AS (SELECT event_id, TRY_CAST(trim({_TYPED}) AS BIGINT) AS n FROM events) SELECT event_id, CASE WHEN n BETWEEN 1 AND 65535 THEN n END AS port, CASE WHEN n BETWEEN 10 AND 3600 THEN n END AS timeout, CASE WHEN n BETWEEN 0 AND 1000000 THEN n END AS tokens FROM t")
def typed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = F.expr(_TYPED)
    ranges = {"port": (1, 65_535), "timeout": (10, 3600), "tokens": (0, 1_000_000)}
    return table(spark, sf_dir, "events").select("event_id", *(checks.in_range(typed, low, high).alias(name) for name, (low, high) in ranges.items()))


@query("""
WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN replace(text, ' ', '  ' || chr(13) || chr(10)) WHEN 1 THEN chr(27) || text || chr(7) || chr(7) WHEN 2 THEN chr(10) || ' ' || text || chr(9) || chr(13) || chr(10) ELSE text END AS x FROM documents),
c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(x, chr(13) || chr(10) || '?', chr(10), 'g'), '[ \\t]+' || chr(10), chr(10), 'g'), '^[ \\t\\n]+|[ \\t\\n]+$', '', 'g') AS x FROM t),
b AS (SELECT *, list_sort(list_distinct(regexp_extract_all(x, '[\\x00-\\x08\\x0B-\\x1F\\x7F]'))) AS bad FROM c)
SELECT doc_id, sha256(x) AS text_sha256, CASE WHEN len(bad) > 0 THEN 'control characters: ' || array_to_string(list_transform(bad, lambda y: 'U+' || printf('%04X', ord(y))), ', ') WHEN length(x) > 2000 THEN 'too long' END AS problem FROM b""")
def instruction_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t = F.col("doc_id") % 4, F.col("text")
    typed = F.when(k == 0, F.replace(t, F.lit(" "), F.lit("  \r\n"))).when(k == 1, F.concat(F.lit("\x1b"), t, F.lit("\x07\x07"))).when(k == 2, F.concat(F.lit("\n "), t, F.lit("\t\r\n"))).otherwise(t)
    return table(spark, sf_dir, "documents").select("doc_id", checks.instructions(typed).alias("i")).select("doc_id", F.sha2("i.text", 256).alias("text_sha256"), "i.problem")


@query("""
WITH t AS (SELECT doc_id, trim(regexp_replace(replace(replace(text, chr(13), ' '), chr(10), ' '), '[^0-9A-Za-zÄÖÜäöüß _./-]', '·', 'g')) AS name,
  left(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[^\\n\\x20-\\x7EÄÖÜäöüß—–…„“”‘’§·]', '·', 'g'), 4000) AS message, to_json(text) AS toml FROM documents)
SELECT doc_id, CASE WHEN coalesce(name, '') = '' THEN '(unnamed)' ELSE left(name, 80) END AS name, sha256(message) AS message_sha256, sha256(replace(toml, chr(127), '\\u007F')) AS toml_sha256 FROM t""")
def operator_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as names that a server gave, as messages for a terminal and as TOML strings; dealt out by their ids, as files may have few row groups."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id").select("doc_id", X.safe_name(t).alias("name"), F.sha2(X.terminal_text(t), 256).alias("message_sha256"), F.sha2(X.toml_string(t), 256).alias("toml_sha256"))


MAIL_HOSTS = (("example.com", "alpha", "imap.alpha.example", True), ("org", "beta", "imap.beta.example", True), ("example.net", "gamma", "imap.gamma.example", False))
_HOST_ROWS = ", ".join(f"('{d}', '{p}', '{h}', {str(s).lower()})" for d, p, h, s in MAIL_HOSTS)
_ENTERED = "CASE page_id % 3 WHEN 0 THEN host WHEN 1 THEN 'me@' || host ELSE ' ' || upper(host) END"


@query(f"""
WITH d(domain, provider, mail_host, supported) AS (VALUES {_HOST_ROWS}), h AS (SELECT page_id, {HOST_SQL} AS host FROM pages), e AS (SELECT page_id, host, {_ENTERED} AS entered FROM h),
m AS (SELECT page_id, provider, mail_host, supported, row_number() OVER (PARTITION BY page_id ORDER BY length(domain) DESC) AS k FROM e JOIN d ON host = domain OR host LIKE '%.' || domain)
SELECT e.page_id, entered, provider, supported, CASE WHEN supported THEN mail_host ELSE entered END AS mail_host FROM e LEFT JOIN m ON e.page_id = m.page_id AND k = 1""")
def resolved_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = spark.sql(f"SELECT * FROM VALUES {_HOST_ROWS} AS d(domain, provider, mail_host, supported)")
    rows = _hosts(spark, sf_dir).select("page_id", F.expr(_ENTERED).alias("entered"))
    return providers.resolve_host(rows, "entered", directory)


PRESETS = (("small", "acme", "https://acme.example/v1"), ("large", "acme", "https://acme.example/v2"), ("local", "home", "http://localhost:8000"))
_WANTED = "CASE c_custkey % 5 WHEN 0 THEN 'acme' WHEN 1 THEN 'home' WHEN 2 THEN 'large' WHEN 3 THEN 'elsewhere' END"
_BASE = "CASE c_custkey % 3 WHEN 0 THEN 'https://acme.example/v1' WHEN 1 THEN 'https://acme.example/v2' ELSE '' END"


@query(f"""
WITH p(key, provider, url) AS (VALUES {', '.join(map(str, PRESETS))}), w AS (SELECT c_custkey, {_WANTED} AS name, {_BASE} AS base_url FROM customer)
SELECT c_custkey, name, base_url, coalesce((SELECT min(key) FROM p WHERE provider = w.name AND url = w.base_url), (SELECT min(key) FROM p WHERE key = w.name),
  (SELECT CASE count(*) WHEN 0 THEN NULL WHEN 1 THEN min(key) ELSE 'openai_compatible' END FROM p WHERE provider = w.name), 'none') AS preset FROM w""")
def model_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    presets = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, PRESETS))} AS p(key, provider, preset_url)")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_WANTED).alias("name"), F.expr(_BASE).alias("base_url"))
    return providers.find_preset(rows, presets)


def _waiting(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as mails, and an outbox with a message for each customer in debt."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", state.dedupe_hash(F.col("o_custkey").cast("string")).alias("key_hash"))
    key = state.dedupe_hash(F.col("c_custkey").cast("string")).alias("key_hash")
    box = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(key, (F.col("c_custkey") * 1000).alias("next_attempt"))
    return rows, box


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def outbox_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.still_pending(*_waiting(spark, sf_dir)).select("o_orderkey")


@query("SELECT count(*) AS delivered FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def direct_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.direct_delivered(*_waiting(spark, sf_dir))


@query("SELECT count(*) AS waiting, count(*) FILTER (WHERE c_custkey * 1000 <= 60000 OR c_custkey * 1000 > 60000 + 7200) AS due FROM customer WHERE c_acctbal < 0")
def outbox_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, box = _waiting(spark, sf_dir)
    return state.waiting(box, F.lit(60_000).cast("long"))


@query()
def stage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of one run over all messages."""
    return mail.stage_report(mail.judged_safe(mail.first_ones(settled(mail.opened(messages(spark, sf_dir))))))
