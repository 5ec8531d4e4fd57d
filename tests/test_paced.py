"""Calls at a service's pace, against a stand-in that allows only so many a second."""

from __future__ import annotations

import json
import threading
import time
from collections import Counter, deque
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from postlake.operators import assess, mail
from postlake.sources import models, paced
from postlake.sources.http import Limited

from .test_boundaries import GOOD, JUDGED

RATE, MAILS = 100, 1_000


class Service(ThreadingHTTPServer):
    """Answers after a while, refuses what is over the rate, and notes what it was asked."""

    daemon_threads, request_queue_size = True, 128

    def __init__(self) -> None:
        super().__init__(("127.0.0.1", 0), Handler)
        self.room, self.at, self.lock = RATE / 5, time.monotonic(), threading.Lock()
        self.refused, self.open, self.most, self.times = 0, 0, 0, deque()
        self.asked: Counter = Counter()


class Handler(BaseHTTPRequestHandler):
    def do_POST(self) -> None:
        asked = json.loads(self.rfile.read(int(self.headers["content-length"])))
        s = self.server
        with s.lock:
            now = time.monotonic()
            s.room, s.at = min(RATE / 5, s.room + (now - s.at) * RATE), now
            fine = s.room >= 1
            s.room -= fine
            s.refused += not fine
            s.open += 1
            s.most = max(s.most, s.open)
            if fine:
                s.times.append(now)
        system, user = (m["content"] for m in asked["messages"])
        if fine:
            time.sleep(0.05)
            with s.lock:
                s.asked[user.partition("Mail number ")[2].partition(".")[0]] += 1
        body = json.dumps({"choices": [{"message": {"content": json.dumps(JUDGED if "phishing_risk" in system else GOOD)}}]}).encode() if fine else b"{}"
        self.send_response(200 if fine else 429)
        if not fine:
            self.send_header("retry-after", "0.2")
        self.send_header("content-length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)
        with s.lock:
            s.open -= 1

    def log_message(self, *_) -> None:
        pass


@pytest.fixture
def service():
    made = Service()
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield made
    made.shutdown()


def test_a_thousand_mails_at_the_allowed_rate(spark, service):
    host = f"http://127.0.0.1:{service.server_address[1]}"
    text = F.concat(F.lit("Message-ID: <"), F.col("id"), F.lit("@x>\r\nFrom: a@b.example\r\nSubject: S\r\n\r\nMail number "), F.col("id"), F.lit(".\r\n"))
    rows = mail.sanitized(mail.raw(spark.range(MAILS).select(text.cast("binary").alias("content")))).cache()
    assert rows.count() == MAILS
    out = assess.summarized(rows, lambda: models.Chat("m", host=host), pace=paced.Pace(RATE, lanes=4, window=6))
    began = time.monotonic()
    found = out.select("dedupe_key", "error", "summary.headline").collect()
    took = time.monotonic() - began
    assert len({r.dedupe_key for r in found}) == MAILS and {r.error for r in found} == {None} and {r.headline for r in found} == {GOOD["headline"]}
    assert set(service.asked) == {str(i) for i in range(MAILS)} and set(service.asked.values()) == {1}
    least = MAILS / RATE
    asked_for = service.times[-1] - service.times[0]
    assert asked_for <= 1.2 * least and took < 3 * least
    assert service.most <= 24 and service.refused <= MAILS / 20


def test_times_and_waits():
    now = [0.0]

    def sleep(seconds):
        now[0] += seconds

    bucket = paced.Bucket(10, lambda: now[0], sleep)
    at = []
    for _ in range(3):
        bucket.take()
        at.append(round(now[0], 3))
    assert at == [0.0, 0.1, 0.2]

    def limited():
        raise Limited("429", 5.0)

    with pytest.raises(Limited):
        paced.paced(limited, bucket)()
    bucket.take()
    assert round(now[0], 3) == 5.3  # asked at 0.3, told to wait for 5
    for wrong in ((0, 1, 1), (1, 0, 1), (1, 1, 0)):
        with pytest.raises(ValueError):
            paced.Pace(*wrong)


def test_in_order_and_bounded():
    taken, open_, most, lock = [], [0], [0], threading.Lock()

    def items():
        for i in range(40):
            taken.append(i)
            yield i

    def work(i):
        with lock:
            open_[0] += 1
            most[0] = max(most[0], open_[0])
        time.sleep(0.002 * (i % 5))
        with lock:
            open_[0] -= 1
        return i

    out = paced.in_order(items(), work, 4)
    assert next(out) == 0 and len(taken) <= 6
    assert list(out) == list(range(1, 40)) and most[0] <= 4
    assert list(paced.in_order([], work, 2)) == []
    with pytest.raises(ZeroDivisionError):
        list(paced.in_order([1, 0], lambda x: 1 / x, 2))


def test_the_service_says_when(monkeypatch):
    waits, fails = [], [Limited("429", 7.0), Limited("429", float("inf")), 3]

    def ask():
        e = fails.pop(0)
        if isinstance(e, Exception):
            raise e
        return e

    assert models.patiently(ask, sleep=waits.append) == 3 and waits[0] == 7.0 and waits[1] <= 30


def test_failures_stay_rows(spark, monkeypatch):
    rows = mail.sanitized(mail.raw(spark.createDataFrame([(b"From: a@b.example\r\n\r\nx",), (b"From: a@b.example\r\n\r\ny",)], "content binary")))

    def maker():
        def ask(system, user):
            raise models.InvalidReply("no")

        return ask

    out = assess.reviewed(assess.summarized(rows, maker, pace=paced.Pace(1000, 2, 2)), maker, pace=paced.Pace(1000, 2, 2)).collect()
    assert [r.error for r in out] == ["llm_invalid_response"] * 2
