"""Calls to a service that allows only so many a second: its rate is shared out over lanes, each with a bounded window of calls at a time.

A lane is one task. Rows are dealt evenly over ``lanes``, and each lane spaces its calls so that all together keep the rate; with fewer
free cores than lanes the rate is kept, too, but not reached. Answers come in the order of their rows. When the service
says when to ask again, all calls of the lane wait until then. A lane that is lost is asked again as a whole.
"""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .http import Retryable
from .sinks import pause

A, B = TypeVar("A"), TypeVar("B")

#: Rows that are turned into Python objects at a time.
_SMALL = 256


@dataclass(frozen=True)
class Pace:
    """Calls a second that the service allows in all, tasks that share them, and calls of a task that may be open at a time."""

    per_second: float
    lanes: int = 4
    window: int = 8

    def __post_init__(self) -> None:
        if self.per_second <= 0 or self.lanes < 1 or self.window < 1:
            raise ValueError("a pace needs a positive rate, lanes and window")


class Bucket:
    """Gives the calls of one lane their times, evenly spaced."""

    def __init__(self, per_second: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.gap, self.clock, self.sleep = 1 / per_second, clock, sleep
        self.next, self.lock = clock(), threading.Lock()

    def take(self) -> None:
        """Wait for the next time that is free."""
        with self.lock:
            now = self.clock()
            at = max(self.next, now)
            self.next = at + self.gap
        if at > now:
            self.sleep(at - now)

    def hold(self, seconds: float) -> None:
        """No call before so many seconds are over."""
        with self.lock:
            self.next = max(self.next, self.clock() + seconds)


def paced(ask: Callable[..., B], bucket: Bucket) -> Callable[..., B]:
    """The same call, at the bucket's times; what the service says about waiting holds for all who share the bucket."""

    def run(*args: object) -> B:
        bucket.take()
        try:
            return ask(*args)
        except Retryable as e:
            if e.after is not None:
                bucket.hold(pause(1, e.after))
            raise

    return run


def in_order(items: Iterable[A], work: Callable[[A], B], window: int) -> Iterator[B]:
    """``work`` of each item, so many at a time, in the order of the items; no more are taken than there is room for."""
    with ThreadPoolExecutor(window) as pool:
        open_: deque[Future[B]] = deque()
        for item in items:
            if len(open_) >= window:
                yield open_.popleft().result()
            open_.append(pool.submit(work, item))
        while open_:
            yield open_.popleft().result()


def mapped(rows: DataFrame, worker: Callable[[Bucket], Callable[[dict], dict]], ddl: str, pace: Pace) -> DataFrame:
    """A row for each row, by what ``worker`` makes of a lane's bucket."""
    schema = T.StructType.fromDDL(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, one = to_arrow_schema(schema), worker(Bucket(pace.per_second / pace.lanes))
        given = (r for b in batches for i in range(0, b.num_rows, _SMALL) for r in b.slice(i, _SMALL).to_pylist())
        held: list[dict] = []
        for r in in_order(given, one, pace.window):
            held.append(r)
            if len(held) == _SMALL:
                yield from pa.Table.from_pylist(held, arrow).to_batches()
                held = []
        if held:
            yield from pa.Table.from_pylist(held, arrow).to_batches()

    return rows.repartition(pace.lanes).mapInArrow(run, schema)
