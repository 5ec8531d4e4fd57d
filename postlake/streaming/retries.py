"""The outbox as a stream that tries again by itself: a timer at each message's next attempt, the parts that are left as state.

The rules are those of ``state.outbox_step``. Each message is a key; its state is gone with its last part, when it is given up, or
after a time to live that no plausible message reaches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..limits import LIMITS, Limits
from ..sources.sinks import Ledger, Sink, send_all

OUT = "dedupe_key string, at long, outcome string, attempts int, n_left int, next_attempt long, error string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def after_failure(attempts: int, first: int, now: int, limits: Limits = LIMITS) -> tuple[str, int, int, int | None]:
    """(outcome, attempts, first, next attempt) when a try fails at ``now`` after ``attempts`` failed ones; ``first`` is when it was queued."""
    used, age = attempts + 1, max(0, now - first)
    plausible = age <= limits.plausible_age and age <= sum(limits.delivery_backoff[: used - 1]) + limits.age_slack
    if used >= limits.delivery_attempts or (plausible and age >= limits.delivery_deadline):
        return "abandoned", used, first, None
    return "deferred", used, first if plausible else now, now + limits.delivery_backoff[min(used, len(limits.delivery_backoff)) - 1]


class Retries(StatefulProcessor):
    def __init__(self, sink: Callable[[], Sink], ledger: str | None, limits: Limits) -> None:
        self.sink, self.ledger, self.limits = sink, ledger, limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        alive = 1000 * (self.limits.plausible_age + self.limits.age_slack + sum(self.limits.delivery_backoff))
        self.handle = handle
        #: Parts that are left, numbered from the message's end, and how it went so far.
        self.parts = handle.getMapState("parts", "n int", "text string", alive)
        self.tries = handle.getValueState("tries", "attempts int, first long", alive)
        self.out = self.sink()
        self.notes = Ledger(self.ledger) if self.ledger else None

    def _try(self, key: str, now: int) -> Iterator[Row]:
        attempts, first = self.tries.get()
        left = sorted(((n[0], text[0]) for n, text in self.parts.iterator()), reverse=True)
        _, sent, _, ok, error = send_all(self.out, key, [text for _, text in left], 1, self.notes)
        if ok:
            outcome, used, at = "delivered", attempts, None
        else:
            outcome, used, first, at = after_failure(attempts, first, now, self.limits)
        if at is None:
            self.parts.clear()
            self.tries.clear()
            if self.notes:
                self.notes.forget([key])
        else:
            for n, _ in left[:sent]:
                self.parts.removeKey((n,))
            self.tries.update((used, first))
            self.handle.registerTimer(1000 * at)
        yield Row(dedupe_key=key, at=now, outcome=outcome, attempts=used, n_left=len(left) - sent, next_attempt=at, error=error)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        given = [r for r in rows]  # copies of one message: they have one key, and its parts are the same
        if self.tries.exists():
            return  # it waits for its timer
        now = timerValues.getCurrentProcessingTimeInMs() // 1000
        parts = given[0].parts or []
        for i, text in enumerate(parts):
            self.parts.updateValue((len(parts) - i,), (text,))
        self.tries.update((0, now))
        yield from self._try(key[0], now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.tries.exists():
            yield from self._try(key[0], timerValues.getCurrentProcessingTimeInMs() // 1000)


def retry_queue(messages: DataFrame, sink: Callable[[], Sink], ledger: str | None = None, limits: Limits = LIMITS) -> DataFrame:
    """``messages(dedupe_key, parts)`` to a row for each try: outcome, failed tries so far, parts left and the next attempt, in seconds.

    What is queued is tried at once, and again when its timer fires, without new input. A message that is queued again while it
    waits is the same one. A query over it needs the state store that ``with_rocks`` sets.
    """
    rows = messages.select(F.coalesce("dedupe_key", F.lit("")).alias("dedupe_key"), "parts")
    return rows.groupBy("dedupe_key").transformWithState(Retries(sink, ledger, limits), OUT, "append", "processingTime")


def with_rocks(spark: SparkSession) -> SparkSession:
    """State with timers and maps needs this store; queries that run already keep theirs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return spark
