"""A mailbox over IMAP as a Spark data source: unread messages are rows, and are marked only after delivery.

Nothing is ever deleted. Reading leaves the unread mark, so a run that dies sees its messages again, and the claims know
those that were handled. Each partition is a range of UIDs with a session of its own.

As a stream the offset is the mailbox's validity and the highest UID that was ever given out; it never goes back, whatever is marked.
A batch has the unread messages between two offsets. Spark tells when a batch is durable, also after a restart, and then its
messages are marked, many at a time. A mailbox that was built anew has another validity and begins anew.
"""

from __future__ import annotations

import contextlib
import imaplib
import importlib
import re
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import TypeVar

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..limits import LIMITS

T = TypeVar("T")

#: UIDs of a partition, and bytes of a message's header that are fetched if the whole can't be.
RANGE, HEADER = 200, 262_144
#: UIDs that one command marks, sessions that mark at a time, and how often a lost connection is made again.
MARKED, SESSIONS, RECONNECTS = 500, 4, 6


class MailboxError(Exception):
    """The mailbox can't be reached or refuses; the message names no secret."""


@dataclass
class Session:
    host: str
    user: str
    password: str = field(repr=False)
    folder: str = "INBOX"
    port: int = 993
    timeout: float = 30.0
    client: str = ""  # "module:name" of another maker of connections, for a TLS context of one's own

    def __post_init__(self) -> None:
        if int(self.port) == 143:
            raise ValueError("port 143 isn't encrypted from the start")

    def __enter__(self) -> Session:
        try:
            module, _, name = self.client.partition(":")
            make = getattr(importlib.import_module(module), name) if name else imaplib.IMAP4_SSL
            self.box = make(self.host, int(self.port), timeout=self.timeout)
            self.box.login(self.user, self.password)
            self._ok(self.box.select(f'"{self.folder}"'))
        except (OSError, imaplib.IMAP4.error) as e:
            raise MailboxError(f"no session ({type(e).__name__})") from None
        return self

    def __exit__(self, *_: object) -> None:
        with contextlib.suppress(OSError, imaplib.IMAP4.error):
            self.box.logout()

    @staticmethod
    def _ok(answer: tuple) -> list:
        status, data = answer
        if str(status).upper() != "OK":
            raise MailboxError(f"the server answered {status}")
        return data

    def _uid(self, command: str, *args: str) -> list:
        try:
            return self._ok(self.box.uid(command, *args))
        except (OSError, imaplib.IMAP4.error) as e:
            raise MailboxError(f"{command} failed ({type(e).__name__})") from None

    def unread(self, after: int = 0, upto: int | None = None) -> list[int]:
        """UIDs of unread messages. A range ``n:*`` always has the last message, so what is not after ``after`` is left out here."""
        found = self._uid("SEARCH", "UNSEEN") if not after and upto is None else self._uid("SEARCH", "UID", f"{after + 1}:{'*' if upto is None else upto}", "UNSEEN")
        return sorted(u for x in (found[0] or b"").split() if (u := int(x)) > after and (upto is None or u <= upto))

    def _said(self, what: str) -> int | None:
        """A number that the server gave when the folder was opened."""
        found = (self.box.response(what)[1] or [None])[0]
        return int(found) if found else None

    def offset(self) -> dict[str, int]:
        """The validity, and the highest UID that was ever given out."""
        after = self._said("UIDNEXT")
        last = after - 1 if after else max((int(x) for x in (self._uid("SEARCH", "ALL")[0] or b"").split()), default=0)
        return {"validity": self._said("UIDVALIDITY") or 0, "uid": last}

    def sizes(self, uids: Iterable[int]) -> dict[int, int]:
        """Bytes of each message, as far as the server says so."""
        try:
            data = self._uid("FETCH", spans(uids), "(UID RFC822.SIZE)")
        except MailboxError:
            return {}
        lines = [x if isinstance(x, bytes) else x[0] for x in data or [] if isinstance(x, bytes | tuple)]
        pairs = ((re.search(rb"\bUID (\d+)", x), re.search(rb"RFC822\.SIZE (\d+)", x)) for x in lines)
        return {int(u[1]): int(n[1]) for u, n in pairs if u and n}

    def message(self, uid: int, size: int | None = None) -> tuple[bytes, bool] | None:
        """The bytes, and whether they are all; only the header if the message is too large or the server can't give the rest; None if it is gone."""
        for part, whole in (("(BODY.PEEK[])", True), (f"(BODY.PEEK[HEADER]<0.{HEADER}>)", False)):
            if whole and size is not None and size > LIMITS.mail_bytes:
                continue
            try:
                data = self._uid("FETCH", str(uid), part)
            except MailboxError:
                if whole:
                    continue
                raise
            found = [x[1] for x in data or [] if isinstance(x, tuple) and len(x) > 1]
            return (found[0], whole) if found else None
        return None

    def folders(self) -> list[str]:
        """Names of all folders; those without one are left out."""
        try:
            rows = self._ok(self.box.list())
        except (OSError, imaplib.IMAP4.error) as e:
            raise MailboxError(f"LIST failed ({type(e).__name__})") from None
        names = (re.search(rb'"((?:[^"\\]|\\.)*)"\s*$|(\S+)\s*$', x) for x in rows if isinstance(x, bytes))
        return [n for m in names if m and (n := (m[1] or m[2] or b"").decode("utf-8", "replace"))]

    def mark(self, uids: int | Iterable[int], move_to: str = "") -> None:
        """Read, and moved by the server if it can; copying and deleting is no way."""
        which = spans([uids] if isinstance(uids, int) else uids)
        self._uid("STORE", which, "+FLAGS", r"(\Seen)")
        if move_to:
            if not any(str(c).upper() == "MOVE" for c in getattr(self.box, "capabilities", ())):
                raise MailboxError("the server can't move messages")
            self._uid("MOVE", which, f'"{move_to}"')

    def mark_each(self, uids: list[int], move_to: str = "") -> Iterator[tuple[int, str | None]]:
        """Mark many at a time, one by one where the server refuses; each with its error."""
        for i in range(0, len(uids), MARKED):
            some = uids[i : i + MARKED]
            try:
                self.mark(some, move_to)
                yield from ((u, None) for u in some)
                continue
            except MailboxError as e:
                if len(some) == 1:
                    yield some[0], type(e).__name__
                    continue
            for u in some:
                try:
                    self.mark(u, move_to)
                    yield u, None
                except MailboxError as e:
                    yield u, type(e).__name__


def spans(uids: Iterable[int]) -> str:
    """UIDs as the protocol writes a set: ``1:3,7``."""
    out: list[list[int]] = []
    for u in sorted(set(uids)):
        if out and out[-1][1] == u - 1:
            out[-1][1] = u
        else:
            out.append([u, u])
    return ",".join(f"{a}:{b}" if a != b else str(a) for a, b in out)


def _session(options: dict) -> Session:
    return Session(options["host"], options["user"], options["password"], options.get("folder", "INBOX"), int(options.get("port", 993)), client=options.get("client", ""))


def delay(attempt: int, start: float = 5.0, most: float = 600.0) -> float:
    """Seconds before a connection is made again: doubled each time, up to the most."""
    return min(start * 2.0 ** min(max(attempt, 1) - 1, 63), most)


def reconnected(options: dict, work: Callable[[Session], T], sleep: Callable[[float], None] = time.sleep) -> T:
    """What ``work`` gives in a session; a connection that is lost or can't be made is made again, later each time."""
    most, start = int(options.get("reconnects", RECONNECTS)), float(options.get("delay", 5.0))
    for attempt in range(1, most + 2):
        try:
            with _session(options) as s:
                return work(s)
        except MailboxError:
            if attempt > most:
                raise
            sleep(delay(attempt, start))
    raise AssertionError


@dataclass
class Uids(InputPartition):
    uids: tuple[int, ...]
    validity: int | None = None


def _rows(s: Session, uids: tuple[int, ...]) -> Iterator[tuple]:
    sizes = s.sizes(uids)
    for uid in uids:
        if (found := s.message(uid, sizes.get(uid))) is not None:
            yield uid, found[0], found[1]


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        _session(options)  # options are checked before anything runs

    def partitions(self) -> list[Uids]:
        with _session(self.options) as s:
            uids = s.unread()
        return [Uids(tuple(uids[i : i + RANGE])) for i in range(0, len(uids), RANGE)] or [Uids(())]

    def read(self, partition: Uids) -> Iterator[tuple]:
        if not partition.uids:
            return
        with _session(self.options) as s:
            yield from _rows(s, partition.uids)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        _session(options)

    def initialOffset(self) -> dict:
        return {"validity": 0, "uid": 0}

    def latestOffset(self) -> dict:
        return reconnected(self.options, Session.offset)

    @staticmethod
    def _between(s: Session, start: dict, end: dict) -> list[int]:
        """Unread messages after ``start`` up to ``end``; all up to there if the mailbox was built anew between them, none if it was afterwards."""
        if s.offset()["validity"] != end["validity"]:
            return []
        return s.unread(start["uid"] if start["validity"] == end["validity"] else 0, end["uid"]) if end["uid"] else []

    def partitions(self, start: dict, end: dict) -> list[Uids]:
        uids = reconnected(self.options, lambda s: self._between(s, start, end))
        return [Uids(tuple(uids[i : i + RANGE]), end["validity"]) for i in range(0, len(uids), RANGE)]

    def read(self, partition: Uids) -> Iterator[tuple]:
        def work(s: Session) -> list[tuple]:
            if s.offset()["validity"] != partition.validity:
                raise MailboxError("the mailbox was built anew while it was read")
            return list(_rows(s, left[:1]))

        left = partition.uids
        while left:  # a message a session would be slow: one session goes on until it is lost
            try:
                with _session(self.options) as s:
                    if s.offset()["validity"] != partition.validity:
                        raise MailboxError("the mailbox was built anew while it was read")
                    for row in _rows(s, left):
                        yield row
                        left = tuple(u for u in left if u > row[0])
                    return
            except MailboxError:
                yield from reconnected(self.options, work)
                left = left[1:]

    def commit(self, end: dict) -> None:
        """The batch up to ``end`` is durable: what it had is marked. A message that can't be marked is seen again and known then."""
        with contextlib.suppress(MailboxError), _session(self.options) as s:
            for _ in s.mark_each(self._between(s, {"validity": end["validity"], "uid": 0}, end), self.options.get("move_to", "")):
                pass


class Mailbox(DataSource):
    """``spark.dataSource.register(Mailbox); spark.read.format("mailbox").options(host=..., user=..., password=...).load()``, or ``readStream``.

    More options: folder, port, move_to (where the stream's marked messages go), reconnects and delay (of its connections), client.
    """

    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return "uid BIGINT, content BINARY, whole BOOLEAN"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


def commit(handled: DataFrame, options: dict, move_to: str = "") -> DataFrame:
    """Mark the messages ``handled(uid)`` after their delivery; (uid, marked, error). One that can't be marked doesn't stop the others."""
    from .tables import settled

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            with _session(options) as s:
                done = [(uid, error is None, error) for uid, error in s.mark_each([int(u) for u in frame["uid"]], move_to)]
            yield pd.DataFrame(done, columns=["uid", "marked", "error"])

    return settled(handled.select("uid").where("uid is not null").distinct().coalesce(SESSIONS).mapInPandas(run, "uid long, marked boolean, error string"))
