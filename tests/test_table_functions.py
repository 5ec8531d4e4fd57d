"""Table functions in SQL, and counters that a pass gives as it runs."""

from __future__ import annotations

import json
import logging
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from postlake.functions import tables
from postlake.operators import mail, metrics, state
from postlake.plans.mail_queries import messages
from postlake.sources.tables import settled

BOTH = b'From: a@b.example\r\nContent-Type: multipart/mixed; boundary=z\r\n\r\n--z\r\nContent-Type: text/plain\r\n\r\nsee http://x.example/a and www.y.example\r\n--z\r\nContent-Type: application/pdf; name="a.pdf"\r\nContent-Disposition: attachment; filename="a.pdf"\r\n\r\n%PDF\r\n--z--\r\n'


def test_parts_and_links(spark):
    tables.register(spark)
    spark.createDataFrame([(1, BOTH), (2, None), (3, b"\xff\x00")], "n int, content binary").createOrReplaceTempView("some_mails")
    got = spark.sql("SELECT n, p.* FROM some_mails, LATERAL mail_parts(content) p").collect()
    assert [(r.part_no, r.ctype, r.filename, r.role) for r in got if r.n == 1] == [(2, "text/plain", None, "plain"), (3, "application/pdf", "a.pdf", "attachment")]
    assert all(r.size == 0 for r in got if r.n == 2)
    links = spark.sql("SELECT n, l.* FROM some_mails, LATERAL mail_links(content) l ORDER BY link_no").collect()
    want = mail.links(mail.sanitized(mail.raw(spark.table("some_mails").where("n = 1")))).orderBy("link_no").collect()
    assert [(r.link_no, r.defanged) for r in links] == [(r.link_no, r.defanged) for r in want] and len(links) == 2
    for wrong in ("SELECT * FROM mail_parts('text')", "SELECT * FROM mail_parts(7)", "SELECT * FROM claim_arrivals(TABLE(some_mails))"):
        with pytest.raises(PySparkException):
            spark.sql(wrong).collect()


def test_claims(spark):
    tables.register(spark)
    rows = [("a", "x", 3), ("a", "x", 1), ("a", "y", 2), ("b", None, 1), ("b", "z", 5), (None, "n", 1), (None, "m", 2), ("", "n", 9)]
    df = spark.createDataFrame([r for r in rows if r[0] != ""], "key string, content string, arrival long")
    df.createOrReplaceTempView("some_arrivals")
    got = {(r.key_hash, r.arrival): r.result for r in spark.sql("SELECT * FROM claim_arrivals(TABLE(some_arrivals))").collect()}
    want = {(r.key_hash, r.arrival): r.result for r in state.claim(df, "key", "content", "arrival").collect()}
    assert got == want and set(got.values()) == {"CLAIMED", "DUPLICATE", "COLLISION"}
    assert spark.sql("SELECT * FROM claim_arrivals(TABLE(SELECT * FROM some_arrivals WHERE false))").count() == 0


def test_counts_without_a_second_job(spark, sf):
    rows = mail.judged_safe(mail.first_ones(settled(mail.opened(messages(spark, sf).limit(60)))))
    watched, seen = metrics.counted(rows)
    kept = settled(watched)
    assert seen.get == mail.stage_report(kept).first().asDict() and seen.get["mails"] == kept.count() > 0


def test_streams_log_their_batches(spark, tmp_path):
    log = tmp_path / "log"
    logger = logging.getLogger("postlake.test")
    logger.propagate = False
    handler, listener = metrics.log_to(str(log), logger), metrics.JsonLog(logger)
    spark.streams.addListener(listener)
    try:
        for i in range(2):
            spark.createDataFrame([(f"From: a@b.example\r\nSubject: secret{i}\r\n\r\nhi http://x.example".encode(),)], "content binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("content binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = metrics.counted_stream(mail.judged(mail.raw(stream))).select("status").writeStream.format("noop").queryName("watched").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        until = time.time() + 20
        while time.time() < until and "query_ended" not in log.read_text():
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
        logger.removeHandler(handler)
    lines = [json.loads(x) for x in log.read_text().splitlines()]
    batches = [x for x in lines if x["event"] == "query_progress" and x["rows"]]
    assert lines[0]["event"] == "query_started" and lines[-1]["event"] == "query_ended" and "secret" not in log.read_text()
    assert [(b["batch"], b["mails_mails"], b["mails_links_removed"]) for b in batches] == [(0, 1, 1), (1, 1, 1)]


def test_lines_hold_scalars_only():
    record = logging.LogRecord("x", logging.ERROR, "f", 1, "failed", (), (ValueError, ValueError("secret"), None))
    record.fields = {"n": 1, "row": {"a": "secret"}, "text": "é", "none": None}
    line = json.loads(metrics.JsonLines().format(record))
    assert (line["level"], line["event"], line["error"], line["n"], line["row"], line["text"], line["none"]) == ("error", "failed", "ValueError", 1, "dict", "é", None) and "secret" not in str(line)
