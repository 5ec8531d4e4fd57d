"""Checks of mail servers over the network, a row for each domain and check, in tasks: name, mail exchanger, dialogue, certificate, cleartext.

``network_checks`` gives the rows that ``hosting.check_table`` and ``exit_code`` take. What it asks stands in a ``Probes``, which a deployment
or a test replaces; a probe that raises is a failed check, never a failed task. ``await_mail`` polls a mailbox until something new is there.
"""

from __future__ import annotations

import contextlib
import smtplib
import socket
import ssl
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from ..kernels.text import clamp
from ..sources.mailbox import MailboxError, Session
from .hosting import FAIL, OK, SKIPPED

#: Names of the checks, ports, seconds to wait for each, days from which a certificate is soon over, and a foreign recipient.
NAMES = ("DNS A/AAAA", "DNS MX", "SMTP banner", "SMTP relay", "SMTP recipient", "IMAPS cert", "IMAPS 143")
SMTP_PORT, IMAPS_PORT, CLEAR_PORT, WAIT, CLEAR_WAIT, SOON, OUTSIDE = 25, 993, 143, 10.0, 5.0, 14, "probe@example.net"
OUT = "domain string, name string, status string, detail string, fix string"


def addresses(domain: str) -> list[str]:
    return sorted({x[4][0] for x in socket.getaddrinfo(domain, None, type=socket.SOCK_STREAM)})


def exchangers(domain: str) -> list[tuple[int, str]] | None:
    """Preference and name of each mail exchanger; None where nothing can look them up."""
    try:
        import dns.resolver
    except ImportError:
        return None
    return sorted((r.preference, str(r.exchange).rstrip(".")) for r in dns.resolver.resolve(domain, "MX", lifetime=CLEAR_WAIT))


@dataclass(frozen=True)
class Dialogue:
    """What a server said: its banner, and the codes for a foreign recipient and for its own."""

    banner: str
    outside: int
    own: int


def dialogue(domain: str, address: str, port: int = SMTP_PORT) -> Dialogue:
    """Greet, name a sender and both recipients, take it all back. Nothing is ever sent."""
    with smtplib.SMTP(timeout=WAIT, local_hostname=domain) as s:
        _, banner = s.connect(domain, port)
        s.ehlo(domain)
        s.mail(f"probe@{domain}")
        outside, own = s.rcpt(OUTSIDE)[0], s.rcpt(address)[0]
        s.rset()
    return Dialogue(banner.decode("utf-8", "replace"), outside, own)


def days_left(domain: str, port: int = IMAPS_PORT) -> float:
    """Days until a certificate ends, whose chain and name hold; an error otherwise."""
    with socket.create_connection((domain, port), WAIT) as s, ssl.create_default_context().wrap_socket(s, server_hostname=domain) as t:
        return (ssl.cert_time_to_seconds(t.getpeercert()["notAfter"]) - time.time()) / 86_400


def cleartext(domain: str, port: int = CLEAR_PORT) -> bytes:
    """What answers without encryption; nothing if nothing does."""
    with contextlib.suppress(OSError), socket.create_connection((domain, port), CLEAR_WAIT) as s:
        s.settimeout(CLEAR_WAIT)
        return s.recv(64)
    return b""


@dataclass(frozen=True)
class Probes:
    addresses: Callable[[str], list[str]] = addresses
    exchangers: Callable[[str], list[tuple[int, str]] | None] = exchangers
    dialogue: Callable[[str, str], Dialogue] = dialogue
    days_left: Callable[[str], float] = days_left
    cleartext: Callable[[str], bytes] = cleartext


def _shown(value: str) -> str:
    """A server's words as they may be printed."""
    return clamp("".join(c if c.isprintable() else "·" for c in value), 120)


def checked(domain: str, address: str, probes: Probes) -> Iterator[tuple[str, str, str, str]]:
    """(name, status, detail, fix) of each check of one domain."""

    def asked(probe: Callable[..., object], *args: str) -> object:
        try:
            return probe(*args)
        except Exception as e:  # noqa: BLE001  what can't be asked is not fine
            return e

    def row(name: str, fine: bool, detail: str, fix: str) -> tuple[str, str, str, str]:
        return name, OK if fine else FAIL, detail if fine else "", "" if fine else fix

    found = asked(probes.addresses, domain)
    yield row(NAMES[0], isinstance(found, list) and bool(found), f"{domain} -> {', '.join(map(str, found))}" if isinstance(found, list) else "", f"{domain} does not resolve: create its A and AAAA records")
    records = asked(probes.exchangers, domain)
    if records is None:
        yield NAMES[1], SKIPPED, "", "nothing here looks up mail exchangers"
    else:
        own = [p for p, host in records if host == domain] if isinstance(records, list) else []
        yield row(NAMES[1], bool(own), f"MX {own[0]} {domain}." if own else "", f"no MX of {domain} names it: create the record")
    said = asked(probes.dialogue, domain, address)
    talked = isinstance(said, Dialogue)
    yield row(NAMES[2], talked and domain in said.banner, _shown(said.banner) if talked else "", f"no banner for {domain} on port {SMTP_PORT}: check the server's name and that it runs")
    yield row(NAMES[3], talked and 500 <= said.outside < 600, f"a foreign recipient is refused ({said.outside})" if talked else "", "the server takes mail for foreign recipients, or did not say: restrict its relaying")
    yield row(NAMES[4], talked and 200 <= said.own < 300, f"{address} is accepted" if talked else "", f"{address} is refused: check the mailbox map")
    left = asked(probes.days_left, domain)
    valid = isinstance(left, int | float) and left > 0
    yield row(NAMES[5], valid, f"chain and name valid, {int(left)} days left{': renew it soon' if left < SOON else ''}" if valid else "", f"no valid certificate for {domain} on port {IMAPS_PORT}")
    answer = asked(probes.cleartext, domain)
    yield row(NAMES[6], answer == b"", "cleartext is closed", f"{domain} answers without encryption on port {CLEAR_PORT}: close it")


def network_checks(states: DataFrame, probes: Callable[[], Probes] = Probes) -> DataFrame:
    """``states(domain, address)`` to (domain, name, status, detail, fix); each domain is asked once, in the task that holds it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = probes()
        for frame in frames:
            rows = [(d, *r) for d, a in zip(frame["domain"], frame["address"], strict=True) for r in checked(d, a or "", made)]
            yield pd.DataFrame(rows, columns=["domain", "name", "status", "detail", "fix"])

    return states.where("domain is not null").select("domain", "address").dropDuplicates(["domain"]).mapInPandas(run, OUT)


def await_mail(session: Callable[[], Session], seconds: float, every: float = 5.0, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> tuple[str, str, str, str]:
    """The check that a mail arrives within so many seconds: the mailbox's next number goes up, whatever is deleted or moved meanwhile."""
    try:
        with session() as s:
            before = s.offset()
        until = clock() + seconds
        while clock() < until:
            sleep(every)
            with session() as s:
                if s.offset() != before:
                    return "Mail", OK, "a mail has arrived", ""
    except MailboxError as e:
        return "Mail", FAIL, "", f"the mailbox can't be read ({e})"
    return "Mail", FAIL, "", f"no mail within {seconds:.0f} s"
