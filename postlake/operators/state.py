"""Claims, the status log, the outbox and the low-priority queue as set operations.

Every rule that looks at the first of a group is an aggregate joined back, not a sorted window, so that one
key with a large share of the rows is summed before it is shuffled and its join can be split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..limits import LIMITS, Limits

#: Fixed value: the order of states; later ones win at equal time.
STATES = ("pending", "sanitized", "summarized", "checked", "delivered", "skipped_low", "failed")


def epoch(ts: Column) -> Column:
    """Whole seconds since 1970, whatever the session's time zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def dedupe_hash(key: Column) -> Column:
    return F.sha2(key, 256)


def collision_key(key: Column, content: Column) -> Column:
    return F.concat(F.lit("collision:"), F.sha2(F.concat(dedupe_hash(key), content), 256))


def claim(rows: DataFrame, key: str, content: str, order: str, seen: DataFrame | None = None) -> DataFrame:
    """Each row with ``result``: CLAIMED for the first of its key, DUPLICATE for others with its content (or an unknown one), COLLISION for others with different content.

    ``seen(key_hash, content_hash)`` are claims of earlier batches. ``order`` has no ties within a key. No key counts as an empty one.
    """
    hashed = rows.withColumn("key_hash", dedupe_hash(F.coalesce(F.col(key), F.lit(""))))
    first = hashed.groupBy("key_hash").agg(F.min(order).alias("first_order"), F.min_by(content, order).alias("first_content"))
    joined = hashed.join(first, "key_hash")
    if seen is not None:
        joined = joined.join(seen.select("key_hash", F.col("content_hash").alias("seen_content"), F.lit(True).alias("was_seen")), "key_hash", "left")
        known, before = F.when(F.col("was_seen"), F.col("seen_content")).otherwise(F.col("first_content")), F.coalesce("was_seen", F.lit(False))
    else:
        known, before = F.col("first_content"), F.lit(False)
    same = known.isNull() | F.col(content).isNull() | (known == F.col(content))
    result = F.when(~before & (F.col(order) == F.col("first_order")), "CLAIMED").when(same, "DUPLICATE").otherwise("COLLISION")
    return joined.withColumn("result", result).select(*rows.columns, "key_hash", "result")


def claim_with_rekey(rows: DataFrame, key: str, content: str, order: str, seen: DataFrame | None = None) -> DataFrame:
    """Collisions are claimed again under a key of their own: the first of each such key is CLAIMED with ``id_collision``, later ones are duplicates."""
    columns = [*rows.columns, "final_key", "result", "id_collision"]
    first = claim(rows, key, content, order, seen).drop("key_hash")
    kept = first.where("result <> 'COLLISION'").withColumn("final_key", F.col(key)).withColumn("id_collision", F.lit(False)).select(columns)
    again = first.where("result = 'COLLISION'").drop("result").withColumn("final_key", collision_key(F.coalesce(F.col(key), F.lit("")), F.col(content)))
    second = claim(again, "final_key", content, order, seen).withColumn("id_collision", F.lit(True))
    return kept.unionByName(second.select(columns))


def rank(state: Column) -> Column:
    return F.array_position(F.array(*(F.lit(s) for s in STATES)), state)


def fold_status(log: DataFrame, key: str, state: str, at: str, order: str) -> DataFrame:
    """The status row of each key from its log: last state by time, then rank, then ``order``; first sight and failures."""
    last = F.struct(F.col(at), rank(F.col(state)), F.col(order))
    return log.groupBy(key).agg(F.min(at).alias("first_seen"), F.max_by(state, last).alias("status"), F.count_if(F.col(state) == "failed").alias("retry_count"))


def promote(seen: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """Rows in state ``checked`` take over the delivery's outcome; no other state changes."""
    done = outcomes.groupBy(key).agg(F.bool_or("delivered").alias("was_delivered"))
    new = F.when((F.col("status") == "checked") & F.col("was_delivered").isNotNull(), F.when(F.col("was_delivered"), "delivered").otherwise("failed")).otherwise(F.col("status"))
    return seen.join(done, key, "left").withColumn("status", new).drop("was_delivered")


def backoff(attempt: Column, start: int = 5, most: int = 600) -> Column:
    """Seconds before a reconnect: doubled each time, up to the most."""
    return F.least(F.lit(float(start)) * F.pow(F.lit(2.0), F.least(F.greatest(attempt, F.lit(1)), F.lit(64)) - 1), F.lit(float(most)))


def delivery_delay(used: Column, limits: Limits = LIMITS) -> Column:
    """Seconds before the next try after ``used`` failed ones."""
    waits = F.array(*(F.lit(x) for x in limits.delivery_backoff))
    return F.element_at(waits, F.least(F.greatest(used, F.lit(1)), F.lit(len(limits.delivery_backoff))).cast("int"))


def age_plausible(age: Column, used: Column, limits: Limits = LIMITS) -> Column:
    """Whether an age can come from the retries so far and not from a clock that jumped."""
    waits = F.array(*(F.lit(x) for x in limits.delivery_backoff))
    waited = F.aggregate(F.slice(waits, F.lit(1), F.greatest(used - 1, F.lit(0)).cast("int")), F.lit(0), lambda a, x: a + x)
    return (age <= limits.plausible_age) & (age <= waited + limits.age_slack)


def outbox_due(outbox: DataFrame, now: Column, limits: Limits = LIMITS) -> DataFrame:
    """The rows whose time has come, oldest first; times too far ahead come from a wrong clock and count as now."""
    ahead = F.col("next_attempt") > now + limits.future_tolerance
    return outbox.withColumn("was_reset", ahead).withColumn("next_attempt", F.when(ahead, now).otherwise(F.col("next_attempt"))).where(F.col("next_attempt") <= now).orderBy("id").limit(limits.outbox_batch)


def still_pending(rows: DataFrame, outbox: DataFrame) -> DataFrame:
    """The rows whose ``key_hash`` has a message in the outbox."""
    return rows.join(outbox.select("key_hash"), "key_hash", "left_semi")


def direct_delivered(rows: DataFrame, outbox: DataFrame) -> DataFrame:
    """How many of ``rows(key_hash)`` went out at once: those of which nothing waits any more. What waits is the flush's to count."""
    return rows.join(outbox.select("key_hash"), "key_hash", "left_anti").agg(F.count("*").alias("delivered"))


def waiting(outbox: DataFrame, now: Column, limits: Limits = LIMITS) -> DataFrame:
    """One row: how many messages wait, and how many of them are due."""
    due = (F.col("next_attempt") <= now) | (F.col("next_attempt") > now + limits.future_tolerance)
    return outbox.agg(F.count("*").alias("waiting"), F.count_if(due).alias("due"))


def outbox_step(attempted: DataFrame, now: Column, limits: Limits = LIMITS) -> DataFrame:
    """Rows (id, attempts, first_queued, ok) after one try: outcome, attempts, next_attempt and first_queued."""
    used = F.col("attempts") + 1
    age = F.greatest(now - F.col("first_queued"), F.lit(0))
    plausible = age_plausible(age, used, limits)
    over = (used >= limits.delivery_attempts) | (plausible & (age >= limits.delivery_deadline))
    outcome = F.when(F.col("ok"), "delivered").when(over, "abandoned").otherwise("deferred")
    return attempted.select(
        "id",
        outcome.alias("outcome"),
        F.when(F.col("ok"), F.col("attempts")).otherwise(used).alias("attempts"),
        F.when(outcome == "deferred", now + delivery_delay(used, limits)).alias("next_attempt"),
        F.when((outcome == "deferred") & ~plausible, now).otherwise(F.col("first_queued")).alias("first_queued"),
    )


def flush_stats(steps: DataFrame) -> DataFrame:
    """How many rows were delivered, deferred and abandoned."""
    return steps.agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("delivered", "deferred", "abandoned")))


def decode_payload(payload: Column) -> Column:
    """(parts, importance, is_warning) of an outbox payload; broken JSON has none, normal and false."""
    p = F.from_json(payload, "parts ARRAY<STRING>, importance STRING, is_warning BOOLEAN")
    known = F.when(p["importance"].isin("low", "normal", "high"), p["importance"])
    return F.struct(F.coalesce(p["parts"], F.array().cast("array<string>")).alias("parts"), F.coalesce(known, F.lit("normal")).alias("importance"), F.coalesce(p["is_warning"], F.lit(False)).alias("is_warning"))


def error_for(exception: Column, stage: Column) -> Column:
    """The stable class of a failure."""
    #: Exceptions and their classes.
    known = {
        "InaccurateSummaryError": "summary_inaccurate", "UnreadableMailError": "ingest_error", "SanitizeError": "sanitize_error", "LLMTimeout": "llm_timeout", "LLMRateLimited": "llm_rate_limited",
        "LLMInvalidResponse": "llm_invalid_response", "LLMTransportError": "llm_transport_error", "ValidationError": "schema_invalid", "MessengerError": "delivery_error", "StateError": "state_error",
    }
    pairs = reduce(lambda a, b: a + b, [[F.lit(k), F.lit(v)] for k, v in known.items()])
    return F.coalesce(F.try_element_at(F.create_map(*pairs), exception), F.concat(stage, F.lit("_error")))
