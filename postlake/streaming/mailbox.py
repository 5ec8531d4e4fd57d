"""A mailbox as a stream whose batches are cycles of the state: claimed and queued in one commit, delivered, and marked afterwards."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..limits import LIMITS, Limits
from ..operators.stages import Stages
from ..operators.store import Store, cycle
from ..sources.mailbox import Mailbox
from ..sources.sinks import Sink


def run_mailbox(
    spark: SparkSession, options: dict[str, str], folder: str, sink: Callable[[], Sink], checkpoint: str, name: str = "telegram", threshold: str = "normal",
    hour: int = 18, limits: Limits = LIMITS, every: str | None = "120 seconds", now: Callable[[], float] = time.time, done: Callable[[int, dict[str, int]], object] | None = None,
    stages: Stages | None = None,
) -> StreamingQuery:
    """Each batch of new messages is a cycle over the state in ``folder``; without ``every`` what is there now is worked off and the query ends.

    A batch that died is given again, and its claims tell what of it was done. The source marks a batch's messages when the next
    one is planned, or when a query begins anew: by then they are delivered, or wait in the outbox. ``done`` gets each batch's counts.
    """
    spark.dataSource.register(Mailbox)

    def batch(rows: DataFrame, number: int) -> None:
        counts = cycle(Store(rows.sparkSession, folder), rows, sink, int(now()), name, threshold, hour, limits, stages=stages)
        if done is not None:
            done(number, counts)

    writer = spark.readStream.format("mailbox").options(**options).load().writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
