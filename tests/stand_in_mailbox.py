"""A mailbox in a folder that stands in for a server: ``<uid>.eml`` are messages, ``<uid>.seen`` their marks, ``log`` what was asked."""

from __future__ import annotations

import imaplib
import re
from pathlib import Path


def uids_of(spec: str, last: int) -> set[int]:
    out: set[int] = set()
    for part in spec.split(","):
        a, _, b = part.partition(":")
        lo, hi = (last if x == "*" else int(x) for x in (a, b or a))
        out |= set(range(min(lo, hi), max(lo, hi) + 1))
    return out


class Client:
    capabilities = ("IMAP4REV1", "MOVE")

    def __init__(self, host: str, port: int, timeout: float) -> None:
        self.folder = Path(host)
        if (self.folder / "refuse").exists():
            n = int((self.folder / "refuse").read_text())
            if n > 0:
                (self.folder / "refuse").write_text(str(n - 1))
                raise OSError("refused")

    def login(self, user, password):
        return "OK", []

    def select(self, folder):
        return "OK", []

    def logout(self):
        return "BYE", []

    def _all(self) -> list[int]:
        return sorted(int(p.stem) for p in self.folder.glob("*.eml"))

    def response(self, what):
        validity = self.folder / "validity"
        value = {"UIDVALIDITY": validity.read_text() if validity.exists() else "1", "UIDNEXT": str(max(self._all(), default=0) + 1)}[what]
        return what, [value.encode()]

    def uid(self, command, *args):
        last = max(self._all(), default=0)
        if command == "SEARCH":
            found = [u for u in self._all() if not (self.folder / f"{u}.seen").exists()]
            if args[0] == "UID":
                found = [u for u in found if u in uids_of(args[1], last)]
            return "OK", [" ".join(map(str, found)).encode()]
        asked = sorted(uids_of(args[0], last) & set(self._all()))
        if command == "FETCH" and "SIZE" in args[1]:
            sizes = {u: (self.folder / f"{u}.size") for u in asked}
            return "OK", [b"%d (UID %d RFC822.SIZE %d)" % (u, u, int(p.read_text()) if p.exists() else (self.folder / f"{u}.eml").stat().st_size) for u, p in sizes.items()]
        if command == "FETCH":
            drop = self.folder / f"{asked[0]}.drop" if asked else None
            if drop and drop.exists():
                drop.unlink()
                raise imaplib.IMAP4.abort("connection lost")
            if asked and "HEADER" not in args[1] and (self.folder / f"{asked[0]}.broken").exists():
                return "NO", []
            data = [(self.folder / f"{u}.eml").read_bytes() for u in asked]
            return "OK", [x for d in data for x in ((b"x", d.partition(b"\r\n\r\n")[0] + b"\r\n\r\n" if "HEADER" in args[1] else d), b")")] or [None]
        if command == "STORE":
            if any((self.folder / f"{u}.locked").exists() for u in asked):
                return "NO", []
            with (self.folder / "log").open("a") as f:
                for u in asked:
                    (self.folder / f"{u}.seen").touch()
                    f.write(f"{u}\n")
            return "OK", []
        return "NO", []
