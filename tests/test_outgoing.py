"""The message sink as a data source, and the outbox that tries again by its own timers."""

from __future__ import annotations

import os
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from postlake.limits import Limits
from postlake.operators import state
from postlake.sources import outgoing
from postlake.streaming import retries

from .test_delivery import ToFile

MESSAGES = "dedupe_key string, parts array<string>"


def make(options):
    """A sink that writes parts to a file, fails for texts "bad", and whose process dies once at "kill"."""

    class Sink(ToFile):
        def send(self, key, part_no, text):
            if text == "kill" and not os.path.exists(self.path + ".died"):
                open(self.path + ".died", "w").close()
                os._exit(1)
            super().send(key, part_no, text)

    return Sink(options["path"])


def options(tmp_path):
    return {"sink": "tests.test_outgoing:make", "path": str(tmp_path / "out"), "ledger": str(tmp_path / "ledger")}


def test_batches(spark, tmp_path):
    spark.dataSource.register(outgoing.Messages)
    rows = spark.createDataFrame([("a", ["1", "2"]), ("b", ["3", "bad", "4"]), ("c", []), ("d", None), (None, ["5"])], MESSAGES)
    assert outgoing.outcomes(spark, str(tmp_path / "ledger")).count() == 0
    rows.write.format("messages").options(**options(tmp_path)).mode("append").save()
    got = {r.dedupe_key: (r.sent, r.n_parts, r.ok, r.error) for r in outgoing.outcomes(spark, str(tmp_path / "ledger")).collect()}
    assert got == {"a": (2, 2, True, None), "b": (1, 3, False, "ValueError"), "c": (0, 0, True, None), "d": (0, 0, True, None), "": (1, 1, True, None)}
    rows.write.format("messages").options(**options(tmp_path)).mode("append").save()  # all of it again
    assert sorted((tmp_path / "out").read_text().split()) == ["1", "2", "3", "5"]


def test_a_task_killed_after_its_second_part(spark, tmp_path):
    spark.dataSource.register(outgoing.Messages)
    rows = spark.createDataFrame([("m", ["1", "2", "kill", "4"])], MESSAGES)
    with pytest.raises(Exception):  # noqa: B017  in local mode no task is tried again
        rows.write.format("messages").options(**options(tmp_path)).mode("append").save()
    assert (tmp_path / "out").read_text().split() == ["1", "2"]
    rows.write.format("messages").options(**options(tmp_path)).mode("append").save()
    assert (tmp_path / "out").read_text().split() == ["1", "2", "kill", "4"]
    assert [(r.sent, r.ok) for r in outgoing.outcomes(spark, str(tmp_path / "ledger")).collect()] == [(4, True)]


def test_streams(spark, tmp_path):
    spark.dataSource.register(outgoing.Messages)
    for i in range(2):
        spark.createDataFrame([(f"k{i}", [f"a{i}", f"b{i}"])], MESSAGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second time nothing is new
        stream = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = stream.writeStream.format("messages").options(**options(tmp_path)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
    assert Counter((tmp_path / "out").read_text().split()) == Counter(["a0", "b0", "a1", "b1"])
    assert sorted(p.name for p in (tmp_path / "ledger" / "outcomes").glob("*.json")) == ["batch-0.json", "batch-1.json"]
    assert outgoing.outcomes(spark, str(tmp_path / "ledger")).where("ok").count() == 2


def test_options_are_checked():
    for wrong in ({"sink": "console"}, {"ledger": "/x"}, {"sink": "nope", "ledger": "/x"}, {"sink": "telegram", "ledger": "/x", "token": "", "chat": "1"}):
        with pytest.raises(ValueError):
            outgoing.Messages(wrong).writer(None, False)


def test_after_failure_is_the_batch_rule(spark):
    limits = Limits(delivery_backoff=(60, 300), delivery_attempts=4, delivery_deadline=900, plausible_age=5000, age_slack=1000)
    cases = [(a, first, now) for a in range(5) for first in (0, 400, 2000) for now in (0, 400, 950, 1400, 1700, 2900, 6000, 10_000)]
    rows = spark.createDataFrame([(i, a, f, n) for i, (a, f, n) in enumerate(cases)], "id long, attempts int, first_queued long, now long")
    steps = state.outbox_step(rows.withColumn("ok", F.lit(False)), F.col("now"), limits).collect()
    want = {r.id: (r.outcome, r.attempts, r.next_attempt) for r in steps}
    firsts = {r.id: r.first_queued for r in steps}
    for i, (a, first, now) in enumerate(cases):
        outcome, used, begun, at = retries.after_failure(a, first, now, limits)
        assert (outcome, used, at) == want[i] and (outcome != "deferred" or begun == firsts[i])


class Flaky:
    """Fails each key's first so many calls, as its name says."""

    def __init__(self, folder) -> None:
        self.folder = str(folder)

    def __call__(self):
        return self

    def send(self, key, part_no, text):
        with open(f"{self.folder}/{key}.calls", "a") as f:
            f.write("x")
        if text == "last" and os.path.getsize(f"{self.folder}/{key}.calls") <= int(key.partition("-")[2]):
            raise OSError("down")
        with open(f"{self.folder}/sent", "a") as f:
            f.write(f"{key}:{text}\n")


def test_timers_try_again(spark, tmp_path):
    limits = Limits(delivery_backoff=(1, 2, 1), delivery_attempts=4)
    keys = [("a-0", ["last"]), ("b-3", ["first", "last"]), ("c-99", ["last"]), ("d-2", ["last"])]
    folder = tmp_path / "calls"
    folder.mkdir()
    spark.createDataFrame(keys, MESSAGES).coalesce(1).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        stream = retries.with_rocks(spark).readStream.schema(MESSAGES).parquet(str(tmp_path / "in"))
        out = retries.retry_queue(stream, Flaky(folder), str(tmp_path / "ledger"), limits)
        q = out.writeStream.format("memory").queryName("retried").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
        until = time.time() + 90
        while time.time() < until and spark.table("retried").where("outcome <> 'deferred'").count() < len(keys):
            time.sleep(0.5)
            assert q.exception() is None
            # queued again while it waits: nothing new
            if not (tmp_path / "again").exists() and spark.table("retried").where("dedupe_key = 'c-99'").count():
                (tmp_path / "again").touch()
                spark.createDataFrame(keys[2:3], MESSAGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    tries = defaultdict(list)
    for r in spark.table("retried").collect():
        tries[r.dedupe_key].append(r)
    ends = {}
    for key, found in tries.items():
        attempts, first = 0, min(r.at for r in found)
        for r in sorted(found, key=lambda r: (r.at, r.attempts)):  # each try is the batch rule's step over what went before
            ok = r.outcome == "delivered"
            row = spark.createDataFrame([(1, attempts, first, ok)], "id long, attempts int, first_queued long, ok boolean")
            step = state.outbox_step(row, F.lit(r.at).cast("long"), limits).first()
            assert (r.outcome, r.attempts, r.next_attempt) == (step.outcome, step.attempts, step.next_attempt)
            attempts, first = step.attempts, step.first_queued
            ends[key] = (r.outcome, r.attempts)
    assert ends == {"a-0": ("delivered", 0), "b-3": ("delivered", 2), "c-99": ("abandoned", 4), "d-2": ("delivered", 2)}
    assert Counter((folder / "sent").read_text().split()) == Counter(["a-0:last", "b-3:first", "b-3:last", "d-2:last"])
