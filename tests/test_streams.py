"""Streams give what the batch operators give."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from postlake.limits import LIMITS
from postlake.operators import digest, mail, state
from postlake.sources import eml, sinks
from postlake.streaming import claims


def drained(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)


def test_claims(spark, tmp_path):
    rows = [(i, f"k{i % 7}", None if i == 20 else f"c{i % 3}") for i in range(60)]
    df = spark.createDataFrame(rows, "n long, key string, content string")
    for i in range(3):
        df.where(F.col("n").between(20 * i, 20 * i + 19)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.arrival, r.result) for r in drained(claims.stream_claim(stream, "key", "content", "n"), "claims").collect()}
    want = {(r.n, r.result) for r in state.claim(df, "key", "content", "n").collect()}
    assert got == want


def test_outbox(spark, tmp_path):
    rows = [(1, 0, False), (1, 60, False), (1, 400, True), (2, 0, False), (2, 70, False), (2, 400, False), (2, 1400, False), (2, 3600, False), (3, 0, False), (3, 3700, False), (4, 0, True)]
    spark.createDataFrame(rows, "id long, at long, ok boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, at long, ok boolean").parquet(str(tmp_path / "in"))
    got = sorted((r.id, r.at, r.outcome, r.attempts, r.next_attempt) for r in drained(claims.stream_outbox(stream), "outbox").collect())
    assert got == [(1, 0, "deferred", 1, 60), (1, 60, "deferred", 2, 360), (1, 400, "delivered", 2, None), (2, 0, "deferred", 1, 60), (2, 70, "deferred", 2, 370), (2, 400, "deferred", 3, 1300), (2, 1400, "deferred", 4, 3500), (2, 3600, "abandoned", 5, None), (3, 0, "deferred", 1, 60), (3, 3700, "deferred", 2, 4000), (4, 0, "delivered", 0, None)]


def test_mail_stream_and_delivery(spark, tmp_path):
    folder = tmp_path / "mail"
    folder.mkdir()
    body = "Message-ID: <{0}@x>\r\nFrom: A <a@b.example>\r\nSubject: S{0}\r\nContent-Type: text/plain\r\n\r\nHello {1} http://evil.example\r\n"
    for i, (key, said) in enumerate([(1, "a"), (1, "a"), (1, "other"), (2, "b")]):
        (folder / f"{i}.eml").write_text(body.format(key, said))
    q = claims.run_mail_stream(eml.stream_eml(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    rows = out.collect()
    assert len(rows) == 3 and sum(r.dedupe_key.startswith("collision:") for r in rows) == 1 and {r.status for r in rows} == {"delivered"}
    batch = mail.run(eml.read_eml(spark, str(folder)))
    assert sorted(map(str, (r.parts for r in batch.collect()))) == sorted(map(str, (r.parts for r in rows)))

    class Flaky:
        def __init__(self):
            self.tries = 0

        def send(self, key, part_no, text):
            self.tries += 1
            if self.tries % 2:
                raise sinks.Temporary(after=0.0)

    assert {(r.sent, r.ok) for r in sinks.deliver(out, Flaky).collect()} == {(1, True)}
    assert sinks.pause(3, None) == 4.0 and sinks.pause(1, 99.0) == 30.0 and sinks.pause(2, float("nan")) == 2.0


def test_counts_by_digest_day(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    want = {(r.day, r.n) for r in events.groupBy(digest.daily_bucket(F.col("ts")).alias("day")).agg(F.count("*").alias("n")).collect()}
    got = {(r.day, r.n) for r in claims.stream_counts(events.withColumn("one", F.lit(1)), "ts", "one").select(F.col("day.start").cast("date").alias("day"), "n").collect()}
    assert got == want


@pytest.mark.parametrize("empty", [True, False])
def test_empty_and_odd_rows(spark, empty):
    rows = [] if empty else [(1, None, None), (2, "k", None), (3, "k", "c"), (4, None, "x")]
    df = spark.createDataFrame(rows, "n long, key string, content string")
    assert state.claim(df, "key", "content", "n").count() == (0 if empty else 4)  # no key counts as an empty one
    assert LIMITS.delivery_attempts == 5
