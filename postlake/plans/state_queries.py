"""Claims, status, outbox, digest and commands over documents, conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import digest, state
from ..sources.tables import table
from .registry import query

NOW = 1_705_276_800  # 2024-01-15 00:00
_E = "CAST(floor(epoch(ts)) AS BIGINT)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat_ws("-", "source", (F.col("n_chars") % 50).cast("string")).alias("key"), F.sha2("text", 256).alias("content"))


_A = "a AS (SELECT doc_id, source || '-' || (n_chars % 50) AS key, sha256(text) AS content FROM documents)"
_F = "f AS (SELECT key, min(doc_id) AS first, arg_min(content, doc_id) AS fc FROM a GROUP BY key)"


@query("WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents), f AS (SELECT h, min(doc_id) AS m FROM h GROUP BY h) SELECT doc_id, CASE WHEN doc_id = m THEN 'CLAIMED' ELSE 'DUPLICATE' END AS result FROM h JOIN f USING (h)")
def claim_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("key"), F.lit(None).cast("string").alias("content"))
    return state.claim(rows, "key", "content", "doc_id").select("doc_id", "result")


@query(f"WITH {_A}, {_F} SELECT doc_id, CASE WHEN doc_id = first THEN 'CLAIMED' WHEN content = fc THEN 'DUPLICATE' ELSE 'COLLISION' END AS result FROM a JOIN f USING (key)")
def claim_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.claim(_arrivals(spark, sf_dir), "key", "content", "doc_id").select("doc_id", "result")


@query(f"""
WITH {_A}, {_F}, r AS (SELECT doc_id, key, content, CASE WHEN doc_id = first THEN 'CLAIMED' WHEN content = fc THEN 'DUPLICATE' ELSE 'COLLISION' END AS result FROM a JOIN f USING (key)),
c AS (SELECT doc_id, 'collision:' || sha256(sha256(key) || content) AS final_key FROM r WHERE result = 'COLLISION'), m AS (SELECT final_key, min(doc_id) AS m FROM c GROUP BY 1)
SELECT doc_id, key AS final_key, result, false AS id_collision FROM r WHERE result <> 'COLLISION'
UNION ALL SELECT doc_id, final_key, CASE WHEN doc_id = m THEN 'CLAIMED' ELSE 'DUPLICATE' END, true FROM c JOIN m USING (final_key)""")
def collision_rekey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.claim_with_rekey(_arrivals(spark, sf_dir), "key", "content", "doc_id").select("doc_id", "final_key", "result", "id_collision")


_SEEN = "s AS (SELECT sha256(source || '-' || (n_chars % 50)) AS key_hash, arg_min(sha256(text), doc_id) AS content_hash FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1)"


def _seen(rows: DataFrame, sf_dir: str) -> DataFrame:
    """An earlier batch: the documents that ``labels`` knows."""
    return rows.join(table(rows.sparkSession, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").groupBy(state.dedupe_hash(F.col("key")).alias("key_hash")).agg(F.min_by("content", "doc_id").alias("content_hash"))


@query(f"WITH {_A}, {_SEEN} SELECT doc_id FROM a WHERE sha256(key) IN (SELECT key_hash FROM s)")
def seen_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _arrivals(spark, sf_dir)
    return rows.withColumn("key_hash", state.dedupe_hash(F.col("key"))).join(_seen(rows, sf_dir), "key_hash", "left_semi").select("doc_id")


@query(f"WITH {_A}, {_SEEN} SELECT doc_id FROM a WHERE sha256(key) NOT IN (SELECT key_hash FROM s)")
def seen_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _arrivals(spark, sf_dir)
    return rows.withColumn("key_hash", state.dedupe_hash(F.col("key"))).join(_seen(rows, sf_dir), "key_hash", "left_anti").select("doc_id")


@query(f"""
WITH {_A}, {_SEEN}, f AS (SELECT key, min(doc_id) AS first, arg_min(content, doc_id) AS fc FROM a GROUP BY key)
SELECT doc_id, CASE WHEN s.key_hash IS NULL AND doc_id = first THEN 'CLAIMED' WHEN content = coalesce(s.content_hash, fc) THEN 'DUPLICATE' ELSE 'COLLISION' END AS result
FROM a JOIN f USING (key) LEFT JOIN s ON s.key_hash = sha256(a.key)""")
def claim_after_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _arrivals(spark, sf_dir)
    return state.claim(rows, "key", "content", "doc_id", _seen(rows, sf_dir)).select("doc_id", "result")


_STATES = "['pending', 'sanitized', 'summarized', 'checked', 'delivered', 'skipped_low', 'failed']"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = F.array(*(F.lit(s) for s in state.STATES))
    return _events(spark, sf_dir).select("event_id", "user_id", state.epoch(F.col("ts")).alias("at"), states[(F.col("event_id") % 7).cast("int")].alias("state"))


_LOG = f"l AS (SELECT event_id, user_id, {_E} AS sec, {_STATES}[event_id % 7 + 1] AS state, event_id % 7 AS rk FROM events)"
_FOLD = "f AS (SELECT user_id, min(sec) AS first_seen, arg_max(state, {'a': sec, 'b': rk, 'c': event_id}) AS status, count(*) FILTER (WHERE state = 'failed') AS retry_count FROM l GROUP BY user_id)"


@query(f"WITH {_LOG}, {_FOLD} SELECT * FROM f")
def status_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.fold_status(_log(spark, sf_dir), "user_id", "state", "at", "event_id")


@query(f"WITH {_LOG}, {_FOLD} SELECT status, count(*) AS n FROM f GROUP BY status")
def count_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status_fold(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""
WITH {_LOG}, {_FOLD}, o AS (SELECT user_id, bool_or(value > 20) AS d FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT user_id, CASE WHEN status = 'checked' AND d IS NOT NULL THEN CASE WHEN d THEN 'delivered' ELSE 'failed' END ELSE status END AS status FROM f LEFT JOIN o USING (user_id)""")
def promote_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = _events(spark, sf_dir).where("event_type = 'purchase'").select("user_id", (F.col("value") > 20).alias("delivered"))
    return state.promote(status_fold(spark, sf_dir), outcomes, "user_id").select("user_id", "status")


@query("SELECT event_id, CAST(least(5 * pow(2, greatest(event_id % 80, 1) - 1), 600) AS DOUBLE) AS delay FROM events")
def backoff_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", state.backoff(F.col("event_id") % 80).alias("delay"))


@query("SELECT event_id, CAST([60, 300, 900, 2100][least(greatest(event_id % 7, 1), 4)] AS BIGINT) AS delay FROM events")
def delivery_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", state.delivery_delay(F.col("event_id") % 7).cast("long").alias("delay"))


@query("""
WITH t AS (SELECT event_id, event_id * 37 % 100000 AS age, 1 + event_id % 5 AS used FROM events)
SELECT event_id, age <= 86400 AND age <= [0, 60, 360, 1260, 3360][used] + 3600 AS plausible FROM t""")
def age_plausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", state.age_plausible(F.col("event_id") * 37 % 100_000, 1 + F.col("event_id") % 5).alias("plausible"))


@query(f"""
WITH o AS (SELECT event_id AS id, {_E} AS n FROM events), r AS (SELECT id, n > {NOW} + 7200 AS was_reset, CASE WHEN n > {NOW} + 7200 THEN {NOW} ELSE n END AS next_attempt FROM o)
SELECT * FROM r WHERE next_attempt <= {NOW} ORDER BY id LIMIT 50""")
def outbox_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.col("event_id").alias("id"), state.epoch(F.col("ts")).alias("next_attempt"))
    return state.outbox_due(rows, F.lit(NOW).cast("long")).select("id", "was_reset", "next_attempt")


_STEP = f"""
t AS (SELECT event_id AS id, event_id % 6 AS attempts, {NOW} - event_id * 13 % 9000 - CASE WHEN event_id % 11 = 0 THEN 100000 ELSE 0 END AS first_queued, event_id % 3 = 0 AS ok FROM events),
u AS (SELECT *, attempts + 1 AS used, {NOW} - first_queued AS age FROM t),
p AS (SELECT *, age <= 86400 AND age <= [0, 60, 360, 1260, 3360, 3360][used] + 3600 AS plausible FROM u),
s AS (SELECT id, CASE WHEN ok THEN 'delivered' WHEN used >= 5 OR (plausible AND age >= 3600) THEN 'abandoned' ELSE 'deferred' END AS outcome, attempts, used, first_queued, ok, plausible FROM p)"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    first = F.lit(NOW) - k * 13 % 9000 - F.when(k % 11 == 0, 100_000).otherwise(0)
    rows = _events(spark, sf_dir).select(k.alias("id"), (k % 6).alias("attempts"), first.alias("first_queued"), (k % 3 == 0).alias("ok"))
    return state.outbox_step(rows, F.lit(NOW).cast("long"))


@query(f"""
WITH {_STEP} SELECT id, outcome, CASE WHEN ok THEN attempts ELSE used END AS attempts, CASE WHEN outcome = 'deferred' THEN {NOW} + [60, 300, 900, 2100][least(used, 4)] END AS next_attempt,
CASE WHEN outcome = 'deferred' AND NOT plausible THEN {NOW} ELSE first_queued END AS first_queued FROM s""")
def outbox_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir)


@query(f"WITH {_STEP} SELECT count(*) FILTER (WHERE outcome = 'delivered') AS delivered, count(*) FILTER (WHERE outcome = 'deferred') AS deferred, count(*) FILTER (WHERE outcome = 'abandoned') AS abandoned FROM s")
def flush_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.flush_stats(_steps(spark, sf_dir))


@query("""
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 2 END AS n_parts, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE sha256(coalesce(text, '')) END AS first_sha256,
  CASE WHEN doc_id % 5 <> 0 AND lang IN ('en', 'de') THEN CASE lang WHEN 'en' THEN 'high' ELSE 'low' END ELSE 'normal' END AS importance, doc_id % 5 <> 0 AND n_chars % 2 = 0 AS is_warning FROM documents""")
def decode_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of whole texts: whole ones, some with a value that no one knows, and such as were cut off."""
    level = F.when(F.col("lang") == "en", "high").when(F.col("lang") == "de", "low").otherwise(F.concat(F.lit("so "), F.coalesce("lang", F.lit("so"))))
    whole = F.to_json(F.struct(F.array(F.coalesce("text", F.lit("")), "lang").alias("parts"), level.alias("importance"), (F.col("n_chars") % 2 == 0).alias("is_warning")), {"ignoreNullFields": "false"})
    d = state.decode_payload(F.when(F.col("doc_id") % 5 == 0, F.left(whole, F.length(whole) - 7)).otherwise(whole))
    rows = table(spark, sf_dir, "documents").select("doc_id", d.alias("d"))
    return rows.select("doc_id", F.size("d.parts").alias("n_parts"), F.sha2(F.try_element_at("d.parts", F.lit(1)), 256).alias("first_sha256"), "d.importance", "d.is_warning")


_LINES = """
WITH i AS (SELECT doc_id AS id, source, lang AS category, trim(regexp_replace(left(text, 60), '\\s+', ' ', 'g')) AS headline, lang || '.example' AS from_domain FROM documents),
t AS (SELECT source, count(*) AS total FROM i GROUP BY source), w AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id) AS place FROM i),
g AS (SELECT source, category, count(*) AS n, string_agg('• ' || CASE WHEN headline = '' THEN '(no subject)' ELSE headline END || ' (' || from_domain || ')', chr(10) ORDER BY id) AS lines FROM w WHERE place <= 60 GROUP BY source, category)
"""


def _digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.trim(F.regexp_replace(F.left("text", F.lit(60)), r"\s+", " "))
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.col("lang").alias("category"), line.alias("headline"), F.concat("lang", F.lit(".example")).alias("from_domain"))
    return digest.low_digest(items, "source")


@query(_LINES + "SELECT source, category, n, lines, CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, category) AS INTEGER) AS rank, total, greatest(total - 60, 0) AS rest FROM g JOIN t USING (source)")
def low_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(spark, sf_dir)


@query("SELECT CAST(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '2024-01-01 18:00:00') AS DATE) AS day, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT)) AS cents FROM events GROUP BY 1")
def daily_bucket_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(digest.daily_bucket(F.col("ts")).alias("day"), F.round(F.col("value") * 100).cast("long").alias("c"))
    return rows.groupBy("day").agg(F.count("*").alias("n"), F.sum("c").cast("decimal(38,0)").alias("cents"))


_TEXT = "CASE event_id % 4 WHEN 0 THEN ' /Digest@bot now' WHEN 1 THEN '/status' WHEN 2 THEN 'hello /digest' ELSE '/stop' END"


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    said = F.when(k == 0, " /Digest@bot now").when(k == 1, "/status").when(k == 2, "hello /digest").otherwise("/stop")
    return _events(spark, sf_dir).select(F.col("event_id").alias("update_id"), (F.col("user_id") % 5).cast("string").alias("chat_id"), said.alias("text"))


@query(f"WITH u AS (SELECT event_id AS update_id, user_id % 5 AS chat, {_TEXT} AS t FROM events), c AS (SELECT update_id, chat, regexp_replace(lower(string_split(trim(t), ' ')[1]), '@.*$', '') AS command FROM u) SELECT update_id, command FROM c WHERE chat = 3 AND command IN ('/digest', '/status')")
def command_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.commands(_updates(spark, sf_dir), "3").select("update_id", "command")


@query("SELECT max(event_id) + 1 AS next_offset, count(*) FILTER (WHERE event_id % 4 = 0 AND user_id % 5 = 3) > 0 AS wants_digest FROM events")
def command_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offset moves past every update, of whatever chat; several digests asked for are one."""
    rows = _updates(spark, sf_dir)
    asked = digest.commands(rows, "3").agg((F.count_if(F.col("command") == "/digest") > 0).alias("wants_digest"))
    return rows.agg((F.max("update_id") + 1).alias("next_offset")).join(asked)  # two single rows


@query("""
WITH t AS (SELECT conv_id, turn, text, greatest(800 - coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS room FROM conversations)
SELECT conv_id, turn, length(text) > room AS cut, CASE WHEN length(text) > room THEN rtrim(left(text, CAST(room AS BIGINT))) ELSE text END AS kept FROM t""")
def text_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return digest.running_budget(rows, "conv_id", ["turn"], "text", 800).select("conv_id", "turn", "cut", "kept")


@query("""
WITH c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type IN ('view', 'click'))
SELECT user_id AS chat_id, event_id AS first_update, event_type AS kind FROM c WHERE k = 1""")
def discover_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chat with its first update, distinct by an aggregate."""
    rows = _events(spark, sf_dir).where(F.col("event_type").isin("view", "click"))
    return rows.groupBy(F.col("user_id").alias("chat_id")).agg(F.min("event_id").alias("first_update"), F.min_by("event_type", "event_id").alias("kind"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'date unknown' ELSE strftime(CAST(o_orderdate AS TIMESTAMP) + to_minutes(CAST(o_orderkey % 1440 AS INTEGER)), '%d.%m. %H:%M') END AS shown FROM orders")
def format_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A date with the sender's own offset, as the message shows it."""
    at = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 97 == 0, "date unknown").otherwise(F.date_format(at, "dd.MM. HH:mm")).alias("shown"))
