"""The costliest inputs stay within their bounds, and what saves time changes no result."""

from __future__ import annotations

import email
import email.policy
import time

import pytest

from postlake.kernels import links, mime
from postlake.limits import Limits


def took(run) -> float:
    began = time.time()
    run()
    return time.time() - began


def many(n: int, inner: bytes = b"\r\nx\r\n") -> bytes:
    return b"From: a@b.example\r\nContent-Type: multipart/mixed; boundary=z\r\n\r\n" + b"".join(b"--z\r\n%s" % inner for _ in range(n)) + b"--z--\r\n"


@pytest.mark.parametrize("text", ["x.example ", "hxxps://x(.)example/a ", "mailto:a@b.example "])
def test_many_links(text):
    assert took(lambda: links.Links().scrub(text * 32_000)) < 2


def test_many_parts_and_a_long_header():
    data = many(200_000)
    assert took(lambda: mime.sanitize(mime.raw_mail(data))) < 4
    assert took(lambda: mime.raw_mail(b"To: " + b"a@b.example, " * 1_600_000 + b"\r\n\r\nx")) < 4


def test_links_beyond_the_bound_are_told_alike():
    text = "see http://a.example/x. and www.b.example, c(.)example mailto:d@e.example backup.zip f.example! tel: +49 123 4567 "
    some, all_ = links.Links(Limits(links=3)), links.Links()
    short, whole = some.scrub(text * 2), all_.scrub(text * 2)
    assert some.removed == all_.removed and some.capped and [f["kind"] for f in some.facts] == [f["kind"] for f in all_.facts]
    assert short.count(links.CAPPED) == some.removed - 3 and "backup.zip" in short and whole.count("!") == short.count("!")
    assert [f["link_no"] for f in some.facts] == list(range(1, some.removed + 1))


RFC822 = b"Content-Type: message/rfc822\r\n\r\nContent-Type: multipart/mixed; boundary=y\r\n\r\n--y\r\n\r\na\r\n--y\r\n\r\nb\r\n--y--\r\n\r\n"


@pytest.mark.parametrize(
    "data",
    [many(1), many(30), many(100), many(12, RFC822), many(40, RFC822), many(9, b"Content-Type: text/html\r\n\r\n<p>x\r\n"), many(90, b"Content-Type: image/png\r\n\r\nx\r\n") + b"after", b"", b"\r\n", b"junk", b"\xff\xfe"],
)
def test_stopping_early_changes_nothing(data):
    limits = Limits(mime_parts=10)
    msg = email.message_from_bytes(data, policy=email.policy.compat32)
    parts, encrypted, skipped = mime.walk(msg, limits)
    found = mime.parts_of(data, limits)
    assert (found[0], found[1], bool(found[2])) == (parts, encrypted, bool(skipped))
    first = next((p for kind in ("text/plain", "text/html") for p in msg.walk() if mime.content_type(p) == kind), None)
    assert mime.body_prefix(data, limits) == (mime.decoded(first)[:512] if first is not None else "")


def test_headers_alone_give_the_raw_row():
    data = b"Message-ID: <1@x>\r\n" + many(3)
    raw = mime.raw_mail(data)
    assert (raw["message_id"], raw["dedupe_key"], raw["from_domain"], raw["size_bytes"], raw["ingest_failed"]) == ("<1@x>", "<1@x>", "b.example", len(data), False)
    deep = b"".join(b'Content-Type: multipart/mixed; boundary="b%d"\r\n\r\n--b%d\r\n' % (i, i) for i in range(3000))
    assert not mime.raw_mail(b"Message-ID: <2@x>\r\n" + deep)["ingest_failed"]
