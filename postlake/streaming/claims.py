"""Claims and the outbox on streams, by keyed state; the rules are those of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..limits import LIMITS, Limits
from ..operators import mail


def stream_claim(arrivals: DataFrame, key: str, content: str, order: str, forget_days: float | None = None) -> DataFrame:
    """(order, key_hash, result) of each arrival: CLAIMED, DUPLICATE or COLLISION against all before it.

    The arrivals of a key in one batch are ordered together; the source's rate bounds them. A claim is kept for
    ever, or for ``forget_days`` days after its key was seen last.
    """
    rows = arrivals.select(F.sha2(key, 256).alias("key_hash"), F.col(content).alias("content"), F.col(order).cast("long").alias("arrival"))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if forget_days else GroupStateTimeout.NoTimeout

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, known = (True, state.get[0]) if state.exists else (False, None)
        out = []
        for row in pd.concat(list(frames)).sort_values("arrival").itertuples():
            now = row.content if isinstance(row.content, str) else None
            if not seen:
                seen, known, result = True, now, "CLAIMED"
            else:
                result = "DUPLICATE" if known is None or now is None or known == now else "COLLISION"
            out.append((row.arrival, k[0], result))
        state.update((known,))
        if forget_days:
            state.setTimeoutDuration(int(forget_days * 86_400_000))
        yield pd.DataFrame(out, columns=["arrival", "key_hash", "result"])

    return rows.groupBy("key_hash").applyInPandasWithState(step, "arrival long, key_hash string, result string", "content string", "append", timeout)


def stream_outbox(tries: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """``tries(id, at, ok)``, in seconds, to (id, at, outcome, attempts, next_attempt); what is delivered or abandoned is forgotten.

    Tries of one batch that follow the last outcome are left out; a message that is queued again later begins anew.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempts, first = state.get if state.exists else (0, None)
        done, out = False, []
        for row in pd.concat(list(frames)).sort_values("at").itertuples():
            first = row.at if first is None else first
            if row.ok:
                done = True
                out.append((k[0], row.at, "delivered", attempts, None))
                break
            attempts += 1
            age = max(0, row.at - first)
            plausible = age <= limits.plausible_age and age <= sum(limits.delivery_backoff[: attempts - 1]) + limits.age_slack
            if attempts >= limits.delivery_attempts or (plausible and age >= limits.delivery_deadline):
                done = True
                out.append((k[0], row.at, "abandoned", attempts, None))
                break
            first = first if plausible else row.at
            wait = limits.delivery_backoff[min(attempts, len(limits.delivery_backoff)) - 1]
            out.append((k[0], row.at, "deferred", attempts, row.at + wait))
        if not done:
            state.update((attempts, first))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["id", "at", "outcome", "attempts", "next_attempt"]).astype({"next_attempt": "Int64"})

    schema = "id long, at long, outcome string, attempts int, next_attempt long"
    rows = tries.select(F.col("id").cast("long").alias("id"), F.col("at").cast("long").alias("at"), "ok")
    return rows.groupBy("id").applyInPandasWithState(step, schema, "attempts int, first long", "append", GroupStateTimeout.NoTimeout)


def run_mail_stream(files: DataFrame, out: str, checkpoint: str, sink: str = "telegram", once: bool = True):
    """Messages of new files as Parquet under ``out``, one folder a batch: a batch that is retried replaces its own."""

    def batch(rows: DataFrame, number: int) -> None:
        mail.run(rows, sink=sink).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="120 seconds")).start()


def stream_counts(arrivals: DataFrame, at: str, by: str, late: str = "10 minutes", width: str = "1 day", start: str = "18 hours") -> DataFrame:
    """Arrivals a day, from the digest's hour on, with late ones up to ``late``."""
    return arrivals.withWatermark(at, late).groupBy(F.window(at, width, width, start).alias("day"), by).agg(F.count("*").alias("n"))
