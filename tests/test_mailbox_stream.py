"""A mailbox read as a stream, against a stand-in: claimed once, delivered once, marked once, whatever dies between."""

from __future__ import annotations

from collections import Counter

import pytest

from postlake.operators import mail, store
from postlake.sources import mailbox
from postlake.streaming.mailbox import run_mailbox

from .stand_in_mailbox import uids_of
from .test_delivery import ToFile

NOW = 1_705_276_800
MAIL = "Message-ID: <{0}@x>\r\nFrom: A <a@b.example>\r\nSubject: S{0}\r\nContent-Type: text/plain\r\n\r\nHello {1}\r\n"


@pytest.fixture
def box(tmp_path):
    folder = tmp_path / "box"
    folder.mkdir()
    return folder


def options(box, **more):
    return {"host": str(box), "user": "u", "password": "p", "client": "tests.stand_in_mailbox:Client", "delay": "0.01", **more}


def put(box, uid, key, said="text"):
    (box / f"{uid}.eml").write_bytes(MAIL.format(key, said).encode())


def marks(box) -> Counter:
    log = box / "log"
    return Counter(int(x) for x in log.read_text().split()) if log.exists() else Counter()


def subjects(path) -> Counter:
    return Counter(x.partition("Subject: ")[2] for x in path.read_text().split("\n") if "Subject: " in x) if path.exists() else Counter()


def run(spark, box, tmp_path, **more):
    q = run_mailbox(spark, options(box), str(tmp_path / "state"), ToFile(str(tmp_path / "out")), str(tmp_path / "cp"), every=None, now=lambda: NOW + 60, **more)
    assert q.awaitTermination(120)
    return q


def sent(tmp_path) -> list[str]:
    path = tmp_path / "out"
    return [x for x in path.read_text().split("\n") if x.startswith(("📧", "⚠"))] if path.exists() else []


def test_each_message_once(spark, box, tmp_path):
    for uid, key in ((1, "a"), (2, "b"), (3, "a"), (4, "c")):
        put(box, uid, key)
    (box / "4.broken").touch()  # only its header can be fetched
    seen = []
    run(spark, box, tmp_path, done=lambda n, counts: seen.append(counts))
    assert sum(c["new"] for c in seen) == 3 and sum(c["delivered"] for c in seen) == 3
    s = store.Store(spark, str(tmp_path / "state"))
    rows = {r.status for r in s.read("seen").collect()}
    assert rows == {"delivered", "failed"} and s.read("seen").where("error_class = 'ingest_error'").count() == 1
    text = (tmp_path / "out").read_text()
    assert "The mail has no text" not in text and "ingest_error" in text  # a notice of the failure, not an empty mail
    put(box, 5, "d")
    run(spark, box, tmp_path)
    put(box, 6, "e")
    run(spark, box, tmp_path)
    assert all(n == 1 for n in marks(box).values()) and {1, 2, 3, 4, 5} <= set(marks(box))
    assert store.Store(spark, str(tmp_path / "state")).read("outbox").count() == 0


def test_dies_between_batch_and_mark(spark, box, tmp_path):
    put(box, 1, "a")
    put(box, 2, "b")

    def die(number, counts):
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        run(spark, box, tmp_path, done=die)
    assert marks(box) == Counter()
    before = (tmp_path / "out").read_text()
    assert before.count("📧") == 2
    again = []
    run(spark, box, tmp_path, done=lambda n, counts: again.append(counts))
    put(box, 3, "c")
    run(spark, box, tmp_path)
    assert [c["new"] for c in again] == [0]  # the batch is given again and known
    assert (tmp_path / "out").read_text().count("📧") == 3
    assert marks(box)[1] == marks(box)[2] == 1


def test_offsets(box):
    put(box, 3, "a")
    put(box, 7, "b")
    (box / "3.seen").touch()
    reader = mailbox.Mailbox(options(box)).streamReader(None)
    assert reader.initialOffset() == {"validity": 0, "uid": 0} and reader.latestOffset() == {"validity": 1, "uid": 7}
    parts = reader.partitions({"validity": 0, "uid": 0}, {"validity": 1, "uid": 7})
    assert [(p.uids, p.validity) for p in parts] == [((7,), 1)]
    assert reader.partitions({"validity": 1, "uid": 7}, {"validity": 1, "uid": 7}) == []
    assert [r[0] for r in reader.read(parts[0])] == [7]
    (box / "validity").write_text("2")  # built anew: old numbers mean nothing any more
    assert reader.partitions({"validity": 1, "uid": 7}, {"validity": 1, "uid": 7}) == []
    assert [p.uids for p in reader.partitions({"validity": 1, "uid": 7}, reader.latestOffset())] == [(7,)]
    with pytest.raises(mailbox.MailboxError, match="anew"):
        list(mailbox.Mailbox(options(box, reconnects="1")).streamReader(None).read(parts[0]))
    reader.commit({"validity": 1, "uid": 7})
    assert not marks(box)


def test_lost_connections(box):
    for uid in range(1, 6):
        put(box, uid, f"k{uid}")
    (box / "3.drop").touch()
    (box / "refuse").write_text("3")
    reader = mailbox.Mailbox(options(box)).streamReader(None)
    assert reader.latestOffset()["uid"] == 5 and (box / "refuse").read_text() == "0"
    (part,) = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert [r[0] for r in reader.read(part)] == [1, 2, 3, 4, 5]
    (box / "refuse").write_text("99")
    with pytest.raises(mailbox.MailboxError):
        mailbox.Mailbox(options(box, reconnects="2")).streamReader(None).latestOffset()
    assert (box / "refuse").read_text() == "96"
    assert [mailbox.delay(n) for n in (0, 1, 2, 3, 8, 500)] == [5, 5, 10, 20, 600, 600]


def test_marks_many_at_a_time(spark, box):
    for uid in (1, 2, 3, 5):
        put(box, uid, f"k{uid}")
    (box / "2.locked").touch()
    done = mailbox.commit(spark.createDataFrame([(u,) for u in (5, 1, 2, 2, None)], "uid long"), options(box))
    assert sorted((r.uid, r.marked, r.error) for r in done.collect()) == [(1, True, None), (2, False, "MailboxError"), (5, True, None)]
    assert marks(box) == Counter({1: 1, 5: 1})
    assert mailbox.spans([7, 1, 2, 3, 3]) == "1:3,7" and mailbox.spans([4]) == "4" and uids_of("1:3,7", 9) == {1, 2, 3, 7}


def test_too_large_messages_are_not_fetched(box):
    put(box, 1, "a")
    (box / "1.size").write_text(str(10**9))
    reader = mailbox.Mailbox(options(box)).reader(None)
    ((uid, content, whole),) = reader.read(reader.partitions()[0])
    assert uid == 1 and not whole and content.endswith(b"\r\n\r\n") and b"Hello" not in content


def test_half_fetched_mails_fail_closed(spark):
    rows = [(9, MAIL.format("k", "x").encode(), False), (10, MAIL.format("l", "x").encode(), True), (11, MAIL.format("k", "x").encode(), True), (12, None, None)]
    files = spark.createDataFrame(rows, "uid long, content binary, whole boolean")
    raw = {r.uid: r for r in mail.raw(files).collect()}
    assert raw[9].ingest_failed and raw[9].dedupe_key == "<k@x>" and raw[9].content_hash is None and not raw[10].ingest_failed
    opened = {r.uid: r for r in mail.opened(files).collect()}
    assert opened[9].safe.error == "ingest_error" and opened[10].safe.error is None and opened[10].safe.body_text.startswith("Hello")
    out = {r.dedupe_key: r for r in mail.run(files).collect()}
    assert len(out) == 3 and out["<k@x>"].status in ("failed", "delivered")


def test_no_binary_in_the_exchanges(spark, tmp_path):
    files = spark.createDataFrame([(MAIL.format("k", "x").encode(),)], "content binary")
    assert "content" not in mail.opened(files).columns and "binary" not in mail.opened(files).schema.simpleString()
    plan = mail.run(files)._jdf.queryExecution().executedPlan().toString()
    assert "mime_bytes" not in plan
