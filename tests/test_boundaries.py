"""What calls out: sinks, models, the mailbox and commands, against stand-ins of the other side."""

from __future__ import annotations

import json
import socket
import threading

import pytest
from pyspark.sql import functions as F

from postlake.config import Config
from postlake.operators import assess, commands, mail, store
from postlake.sources import mailbox, messengers, models, sinks
from postlake.sources.http import Failed, Limited, Reply, Retryable, TimedOut, call

NOW = 1_705_276_800


class Other:
    """Answers in turn and keeps what it was asked."""

    def __init__(self, *replies):
        self.replies, self.asked = list(replies), []

    def __call__(self, method, url, headers, body, timeout):
        self.asked.append((method, url, dict(headers), json.loads(body) if body else None))
        reply = self.replies.pop(0)
        if isinstance(reply, Exception):
            raise reply
        status, body, *head = reply
        return Reply(status, dict(head), body if isinstance(body, bytes) else json.dumps(body).encode())


def test_bot_and_webhook():
    other = Other((200, {"ok": True}), (200, {"ok": False, "error_code": 403}), (429, b"", ("retry-after", "7")), (500, b""), (404, b"secret"), OSError("x"), TimeoutError(), (200, {"ok": True}))
    bot = messengers.Bot("123:abc", "9", transport=other)
    bot.send("k", 0, "hello")
    assert other.asked[0][1].endswith("/bot123:abc/sendMessage") and other.asked[0][3] == {"chat_id": "9", "text": "hello", "disable_web_page_preview": True}
    with pytest.raises(Failed, match="403"):
        bot.send("k", 0, "x")
    with pytest.raises(sinks.Temporary) as e:
        bot.send("k", 0, "x")
    assert e.value.after == 7 and "abc" not in str(e.value) + repr(bot)
    with pytest.raises(sinks.Temporary):
        bot.send("k", 0, "x")
    for _ in range(3):
        with pytest.raises(Failed) as e:
            bot.send("k", 0, "x")
        assert "abc" not in str(e.value) and "secret" not in str(e.value)
    bot.send("k", 0, "")
    assert bot.healthy() and not other.replies
    hook = Other((204, b""), (400, b""))
    w = messengers.Webhook("https://x.example/secret", transport=hook)
    w.send("k", 0, "@everyone")
    assert hook.asked[0][3] == {"content": "@everyone", "allowed_mentions": {"parse": []}} and not w.healthy() and "secret" not in repr(w)
    for bad in (("telegram", "", "1"), ("discord",), ("nobody",)):
        with pytest.raises(ValueError):
            messengers.maker(*bad)
    assert isinstance(messengers.maker("telegram", "t", "c")(), messengers.Bot) and isinstance(messengers.maker("signal", path="/x")(), messengers.Socket)


def test_retries_until_it_works():
    other = Other((503, b""), (429, b"", ("retry-after", "nan")), (200, {"ok": True}))
    bot, waits = messengers.Bot("t", "c", transport=other), []
    sinks.with_retry(lambda: bot.send("k", 0, "x"), 3, waits.append)
    assert waits == [1.0, 2.0]


@pytest.mark.parametrize(("reply", "fine"), [(b'{"result": {"version": "1"}}\n', True), (b'{"error": {"code": -1}}\n', False), (b"junk\n", False), (b"[]\n", False), (b"", False), (b"x" * 1_200_000, False)])
def test_socket(tmp_path, reply, fine):
    path, asked = str(tmp_path / "s"), []
    server = socket.socket(socket.AF_UNIX)
    server.bind(path)
    server.listen(1)

    def answer():
        c, _ = server.accept()
        asked.append(json.loads(c.recv(65536)))
        try:
            c.sendall(reply)
        except OSError:
            pass
        c.close()

    t = threading.Thread(target=answer)
    t.start()
    sink = messengers.Socket(path, 5)
    if fine:
        sink.send("k", 0, "hello")
    else:
        with pytest.raises(Failed):
            sink.send("k", 0, "hello")
    t.join()
    assert asked[0]["method"] == "send" and asked[0]["params"] == {"noteToSelf": True, "message": "hello"}
    assert not messengers.Socket(str(tmp_path / "none")).healthy()


GOOD = {"headline": "H", "summary_text": "see http://evil.example now", "importance": "high", "importance_reason": "r", "category": "c", "attachment_summaries": {}, "injection_suspected": False}
JUDGED = {"phishing_risk": "low", "risk_reasons": ["odd"], "summary_accurate": True, "notes": ""}


def test_repair_and_patience():
    asked = []

    def ask(system, user, replies=["no json", json.dumps({"a": 1} | JUDGED), json.dumps(JUDGED)]):  # noqa: B006
        asked.append(system)
        return replies[len(asked) - 1]

    with pytest.raises(models.InvalidReply):
        models.complete_json(ask, "s", "u", models.VERDICT)
    assert len(asked) == 2 and "no JSON object" in asked[1]
    assert models.complete_json(ask, "s", "u", models.VERDICT) == JUDGED and len(asked) == 3
    assert models.faults({"phishing_risk": "x", "risk_reasons": [1], "notes": 2, "stolen text": 1}, models.VERDICT) == ["- field `phishing_risk`: none of none, low, high", "- field `risk_reasons`: holds more than text", "- field `summary_accurate`: missing", "- field `notes`: no str", "- a field that is not asked for"]
    waits, fails = [], [TimedOut(), Limited(), None]

    def once():
        if (e := fails.pop(0)) is not None:
            raise e
        return 5

    assert models.patiently(once, sleep=waits.append) == 5 and waits == [2.0, 4.0]
    for e in (Failed(), models.InvalidReply()):
        with pytest.raises(Failed):
            models.patiently(lambda e=e: (_ for _ in ()).throw(e), sleep=waits.append)
    assert len(waits) == 2 and [models.error_class(e) for e in (TimedOut(), Limited(), Retryable(), models.InvalidReply(), KeyError())] == ["llm_timeout", "llm_rate_limited", "llm_transport_error", "llm_invalid_response", "summarize_error"]


def test_clients():
    other = Other((200, {"content": [{"type": "thinking"}, {"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}), (200, {"content": []}), (200, {"choices": [{"message": {"content": "c"}}]}), (200, {}))
    one, two = models.Messages("m", "secret", transport=other), models.Chat("m", "secret", "http://h/v1/", transport=other)
    assert one("s", "u") == "ab" and other.asked[0][2]["x-api-key"] == "secret" and other.asked[0][3]["system"] == "s"
    for c in (one, two):
        if c is two:
            assert two("s", "u") == "c" and other.asked[2][1] == "http://h/v1/chat/completions"
        with pytest.raises(models.InvalidReply):
            c("s", "u")
    assert "secret" not in repr(one) + repr(two) and models.client("none", "") is None and isinstance(models.client("openai_compatible", "m", base_url="http://h"), models.Chat)
    with pytest.raises(ValueError):
        models.client("other", "m")
    assert call("x", "GET", "http://h", transport=Other((200, b"[1]"))) == {}


def fake_model(system, user):
    if "Down" in user:
        raise Limited("429")
    return json.dumps(JUDGED if "phishing_risk" in system else GOOD)


def test_mails_by_a_model(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(models, "WAITS", (0.0,))
    (tmp_path / "m").mkdir()
    for i, said in enumerate(["Hello", "Down"]):
        (tmp_path / "m" / f"{i}.eml").write_text(f"Message-ID: <{i}@x>\r\nFrom: A <a@b.example>\r\nSubject: S{i}\r\nContent-Type: text/plain\r\n\r\n{said}\r\n")
    from postlake.sources import eml

    clean = mail.sanitized(mail.claimed(eml.read_eml(spark, str(tmp_path / "m"))))
    clean = clean.withColumn("error", F.when(F.col("body_text").contains("Down"), "sanitize_error").otherwise(F.col("error")))
    out = mail.routed(assess.reviewed(assess.summarized(clean, lambda: fake_model), lambda: fake_model))
    rows = {r.subject: r for r in out.collect()}
    assert rows["S0"].status == "delivered" and "http" not in rows["S0"].summary.summary_text and rows["S0"].summary.injection_suspected
    assert rows["S0"].verdict.phishing_risk == "low" and "odd" in rows["S0"].verdict.risk_reasons and rows["S1"].status == "failed" and rows["S1"].summary is None
    assert {len(r.parts) for r in mail.composed(out).collect()} == {1}
    with pytest.raises(Limited):
        assess.summary_of({"subject": "Down", "body_text": "", "attachment_texts": [], "attachments": [], "from_domain": "d"}, fake_model)


class Box:
    """A server with a mailbox of three."""

    capabilities = ("IMAP4REV1", "MOVE")
    calls: list = []

    def __init__(self, *_, **__):
        pass

    def login(self, user, password):
        return "OK", []

    def select(self, folder):
        return ("OK", [b"3"]) if folder == '"INBOX"' else ("NO", [])

    def list(self):
        return "OK", [b'(\\HasNoChildren) "/" "INBOX"', b'() "/" Sent', None]

    def logout(self):
        return "BYE", []

    def uid(self, command, *args):
        Box.calls.append((command, *args))
        if command == "SEARCH":
            return "OK", [b"3 1 2"]
        if command == "FETCH" and args[0] == "2":
            return "OK", [None]
        if command == "FETCH" and args[0] == "3" and "HEADER" not in args[1]:
            return "NO", []
        if command == "FETCH":
            return "OK", [(b"x", f"Subject: {args[0]}\r\n\r\n".encode()), b")"]
        return ("NO", []) if args[0] == "3" else ("OK", [])


def test_mailbox(monkeypatch):
    monkeypatch.setattr(mailbox.imaplib, "IMAP4_SSL", Box)
    options = {"host": "h", "user": "u", "password": "secret"}
    reader = mailbox.Mailbox(options).reader(None)
    parts = reader.partitions()
    assert [p.uids for p in parts] == [(1, 2, 3)]
    assert list(reader.read(parts[0])) == [(1, b"Subject: 1\r\n\r\n", True), (3, b"Subject: 3\r\n\r\n", False)]
    with mailbox._session(options) as s:
        assert s.folders() == ["INBOX", "Sent"] and "secret" not in repr(s)
        s.mark(1, "Done")
        with pytest.raises(mailbox.MailboxError):
            s.mark(3)
    assert ("STORE", "1", "+FLAGS", "(\\Seen)") in Box.calls and ("MOVE", "1", '"Done"') in Box.calls and not any("Deleted" in str(c) or c[0] == "EXPUNGE" for c in Box.calls)
    with pytest.raises(ValueError):
        mailbox.Mailbox(options | {"port": "143"}).reader(None)
    with pytest.raises(mailbox.MailboxError):
        mailbox._session(options | {"folder": "x"}).__enter__()


def test_commands(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "state"))
    updates = [{"update_id": 5, "message": {"chat": {"id": 9}, "text": " /Digest@bot now"}}, {"update_id": 6, "message": {"chat": {"id": 8}, "text": "/status"}}, {"update_id": 7, "message": {"chat": {"id": 9}, "text": "/status"}}, {"update_id": 8}, "junk", {"update_id": 9, "message": {"chat": {"id": 9}, "text": "/digest"}}]
    other = Other((200, {"ok": True, "result": updates}), (200, {"ok": True, "result": []}), (500, b""))
    bot = messengers.Bot("t", "9", transport=other)
    assert commands.serve(s, bot, "9", "In*box* http://x.example", NOW) and s.meta(commands.OFFSET) == "10"
    row = s.read("outbox").first()
    assert row.kind == "status" and "0 message(s)" in row.parts[0] and "*" not in row.parts[0] and "://" not in row.parts[0].replace("[:]//", "")
    assert not commands.serve(s, bot, "9", "x", NOW + 1) and other.asked[1][3]["offset"] == 10 and not commands.serve(s, bot, "9", "x", NOW + 2)
    config = Config()
    assert not commands.enabled(config, True, "t", "9")
