"""Nothing queued is lost or sent twice, and streams forget what is over."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from postlake.limits import LIMITS, Limits
from postlake.operators import store
from postlake.sources import sinks
from postlake.streaming import claims

NOW = 1_705_276_800


class ToFile:
    """Writes what it is given as a line of a file."""

    def __init__(self, path):
        self.path = path

    def __call__(self):
        return self

    def send(self, key, part_no, text):
        if text == "bad":
            raise ValueError("no")
        with open(self.path, "a") as f:
            f.write(text + "\n")


def outbox(spark, folder, rows):
    s = store.Store(spark, str(folder))
    s.replace("outbox", spark.createDataFrame(rows, store.TABLES["outbox"]))
    return s


def test_numbers_that_collide(spark, tmp_path):
    s = outbox(spark, tmp_path / "a", [(7, "k1", "mail", ["A"], 0, NOW, NOW), (7, "k2", "mail", ["B"], 0, NOW, NOW + 500), (7, None, "digest", ["D"], 0, NOW, NOW + 500)])
    sink = ToFile(str(tmp_path / "out"))
    assert store.flush(s, sink, NOW + 1)["delivered"] == 1 and {r.key_hash for r in s.read("outbox").collect()} == {"k2", "digest:7"}
    assert store.waiting(s, NOW + 1) == {"waiting": 2, "due": 0}
    assert store.flush(s, sink, NOW + 600)["delivered"] == 2 and s.read("outbox").count() == 0
    assert sorted((tmp_path / "out").read_text().split()) == ["A", "B", "D"]
    down = outbox(spark, tmp_path / "b", [(7, "k1", "mail", ["A", "bad"], 0, NOW, NOW), (7, "k2", "mail", ["bad"], 0, NOW, NOW)])
    assert store.flush(down, sink, NOW + 1) == {"delivered": 0, "deferred": 2, "abandoned": 0}
    assert sorted((r.key_hash, r.parts, r.attempts, r.id) for r in down.read("outbox").collect()) == [("k1", ["bad"], 1, 7), ("k2", ["bad"], 1, 7)]


def test_thousands_of_messages_go_out_once(spark, tmp_path):
    folder = tmp_path / "mail"
    folder.mkdir()
    n = 5000
    for i in range(n):
        (folder / f"{i}.eml").write_text(f"Message-ID: <{i}@x>\r\nFrom: A <a@b.example>\r\nSubject: S{i}\r\nContent-Type: text/plain\r\n\r\nHello {i}\r\n")
    from postlake.sources import eml

    s = store.Store(spark, str(tmp_path / "state"))
    limits = Limits(outbox_batch=2 * n)
    sink = ToFile(str(tmp_path / "out"))
    assert store.ingest(s, eml.read_eml(spark, str(folder)), NOW, limits=limits) == n
    assert store.flush(s, sink, NOW + 1, limits) == {"delivered": n, "deferred": 0, "abandoned": 0}
    lines = [x for x in (tmp_path / "out").read_text().split("\n") if x.startswith("📧")]
    assert len(lines) == n == len(set(lines)) and s.read("outbox").count() == 0
    assert s.read("seen").where("status = 'delivered'").count() == n


def test_deliver_sends_once_however_often_it_is_read(spark, tmp_path):
    messages = spark.createDataFrame([("a", ["1", "2"]), ("b", ["3", "bad", "4"]), ("c", [])], "dedupe_key string, parts array<string>")
    out = sinks.deliver(messages, ToFile(str(tmp_path / "out")))
    got = {r.dedupe_key: (r.sent, r.n_parts, r.ok, r.error) for r in out.collect()}
    assert out.count() == 3 and got == {"a": (2, 2, True, None), "b": (1, 3, False, "ValueError"), "c": (0, 0, True, None)}
    assert sorted((tmp_path / "out").read_text().split()) == ["1", "2", "3"]


def test_streams_forget_what_is_over(spark, tmp_path):
    for i, rows in enumerate([[(1, 0, False), (2, 0, True)], [(1, 60, True), (3, 5, False)], [(2, 90, False)]]):
        spark.createDataFrame(rows, "id long, at long, ok boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, at long, ok boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = claims.stream_outbox(stream, LIMITS).writeStream.format("memory").queryName("forgets").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    kept = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    q.stop()
    rows = spark.table("forgets").collect()
    assert kept == 2 and {r.id for r in rows if r.outcome == "delivered"} == {1, 2}


def test_claims_expire(spark, tmp_path):
    spark.createDataFrame([(1, "k", "c"), (2, "k", "d")], "n long, key string, content string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("n long, key string, content string").parquet(str(tmp_path / "in"))
    q = claims.stream_claim(stream, "key", "content", "n", 400).writeStream.format("memory").queryName("expires").outputMode("append").trigger(once=True).start()
    assert q.awaitTermination(60)
    assert {(r.arrival, r.result) for r in spark.table("expires").collect()} == {(1, "CLAIMED"), (2, "COLLISION")}
    assert spark.table("expires").select(F.max("arrival")).first()[0] == 2


@pytest.mark.parametrize("text", [":" + " " * 1_000_000, ": " * 500_000, "http" + " " * 1_000_000 + ":", "a-" * 500_000 + ".", "1.1." * 250_000 + "12345", "a" + " " * 1_000_000 + "b", ".a-" * 300_000 + "_", "<" * 500_000])
def test_the_guard_takes_time_in_proportion(text):
    import time

    from postlake.kernels import output

    began = time.process_time()
    guarded = output.final_guard(text)
    assert time.process_time() - began < 2 and output.final_guard(guarded) == guarded
    began = time.process_time()
    output.scrub_plain(text)
    assert time.process_time() - began < 4


def test_guard_cases():
    from postlake.kernels import output

    cases = {
        "go HTTP : / /x.example now": "go hxxp[:]//x[.]example now",
        "h t t p s://a": "hxxps[:]//a",
        "gopher   :// a": "gopher[:]// a",
        "javascript:x and data: y": "javascript[:]x and data: y",
        "www . x": "www[.] x",
        "a.b.cd e1.22 3.5.1 x.y_": "a[.]b[.]cd e1.22 3.5.1 x.y",
        "q.xy.zz_": "q[.]xy[.]zz", "q.xy.zz_z": "q[.]xy.zz_z",
        "1.2.3.4 1.2.3 1.1234.1.2.3.4 a1.2.3.4 1.2.3.4.5": "1[.]2[.]3[.]4 1.2.3 1.1234.1[.]2[.]3[.]4 a1.2.3.4 1[.]2[.]3[.]4[.]5",
        "[a](b) <i> @everyone __x__": "[a] (b) i (at)everyone x",
        "a。bc": "a[.]bc",
    }
    assert {t: output.final_guard(t) for t in cases} == cases


@pytest.mark.parametrize(
    ("attrs", "hidden"),
    [({"hidden": None}, True), ({"style": "Display : NONE"}, True), ({"style": "display:inline"}, False), ({"style": "visibility:collapse"}, True), ({"style": "opacity: 0.00"}, True), ({"style": "opacity:0.5"}, False),
     ({"style": "font-size:.0em"}, True), ({"style": "font-size:10px"}, False), ({"style": "color:#FFF"}, True), ({"style": "color:white;background:black"}, False), ({"style": "color:rgb(255, 255, 255);background-color:#ffffff"}, True), ({"style": None}, False), ({}, False)],
)
def test_what_hides_an_element(attrs, hidden):
    from postlake.kernels.html import Look

    assert Look(attrs).hidden == hidden


@pytest.mark.parametrize(
    ("attrs", "unseen"),
    [({"width": "1", "height": "2"}, True), ({"width": "1"}, False), ({"style": "width:1px;height:0"}, True), ({"width": "3", "height": "1"}, False), ({"width": " 2x", "style": "height:2"}, True), ({"width": "", "height": ""}, False)],
)
def test_pictures_too_small_to_be_seen(attrs, unseen):
    from postlake.kernels.html import Look

    assert Look(attrs).unseen == unseen
