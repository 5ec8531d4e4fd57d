"""Network checks against stand-ins of the outside."""

from __future__ import annotations

import socket
import threading

from postlake.operators import hosting, probes
from postlake.sources.mailbox import Session

from .stand_in_mailbox import Client


def refused(*_):
    raise OSError("refused")


GOOD = probes.Probes(lambda d: ["192.0.2.1"], lambda d: [(10, d)], lambda d, a: probes.Dialogue(f"220 {d} ready\x1b", 554, 250), lambda d: 80.5, lambda d: b"")
BAD = probes.Probes(refused, lambda d: [(10, "other.example")], lambda d, a: probes.Dialogue("220 other", 250, 550), lambda d: -1.0, lambda d: b"* OK")
DOWN = probes.Probes(lambda d: [], lambda d: None, refused, refused, refused)


def statuses(made):
    return [(name, status) for name, status, _, _ in probes.checked("a.example", "m@a.example", made)]


def test_checks():
    assert statuses(GOOD) == [(n, "ok") for n in probes.NAMES]
    assert statuses(BAD) == [(n, "FAIL") for n in probes.NAMES]
    assert [s for _, s in statuses(DOWN)] == ["FAIL", "skipped", "FAIL", "FAIL", "FAIL", "FAIL", "FAIL"]
    shown = {n: (d, f) for n, _, d, f in probes.checked("a.example", "m@a.example", GOOD)}
    assert shown["SMTP banner"][0] == "220 a.example ready·" and shown["IMAPS cert"][0] == "chain and name valid, 80 days left" and not any(f for _, f in shown.values())
    soon = probes.Probes(GOOD.addresses, GOOD.exchangers, GOOD.dialogue, lambda d: 3.0, GOOD.cleartext)
    assert "renew" in dict((n, d) for n, _, d, _ in probes.checked("a.example", "x", soon))["IMAPS cert"]


def test_a_table_of_domains(spark):
    states = spark.createDataFrame([("a.example", "m@a.example"), ("a.example", "m@a.example"), ("b.example", None), (None, "x")], "domain string, address string")
    rows = probes.network_checks(states, lambda: GOOD)
    assert rows.count() == 2 * len(probes.NAMES)
    codes = {r.domain: (r.ok, r.fail, r.skipped, r.code) for r in hosting.exit_code(rows, "domain").collect()}
    assert codes == dict.fromkeys(("a.example", "b.example"), (7, 0, 0, 0))
    down = hosting.exit_code(probes.network_checks(states, lambda: DOWN), "domain").first()
    assert (down.fail, down.skipped, down.code) == (6, 1, 1)
    assert hosting.check_table(probes.network_checks(states, lambda: BAD)).where("failed and shown <> ''").count() == 14


def test_a_dialogue_sends_nothing():
    said, server = [], socket.create_server(("127.0.0.1", 0))

    def serve():
        conn, _ = server.accept()
        with conn, conn.makefile("rwb") as f:
            f.write(b"220 localhost ready\r\n")
            f.flush()
            for line in f:
                said.append(line.strip().split(b" ")[0].upper())
                f.write(b"554 no\r\n" if b"example.net" in line else b"250 fine\r\n" if not line.upper().startswith(b"QUIT") else b"221 bye\r\n")
                f.flush()

    threading.Thread(target=serve, daemon=True).start()
    got = probes.dialogue("127.0.0.1", "m@localhost", server.getsockname()[1])
    server.close()
    assert (got.outside, got.own) == (554, 250) and "ready" in got.banner
    assert b"DATA" not in said and said[:4] == [b"EHLO", b"MAIL", b"RCPT", b"RCPT"] and b"RSET" in said


def test_cleartext():
    server = socket.create_server(("127.0.0.1", 0))
    threading.Thread(target=lambda: server.accept()[0].sendall(b"* OK hello"), daemon=True).start()
    port = server.getsockname()[1]
    assert probes.cleartext("127.0.0.1", port) == b"* OK hello"
    server.close()
    assert probes.cleartext("127.0.0.1", port) == b""


def test_waiting_for_a_mail(tmp_path):
    (tmp_path / "1.eml").write_bytes(b"Subject: old\r\n\r\n")
    now = [0.0]

    def session():
        return Session(str(tmp_path), "u", "p", client="tests.stand_in_mailbox:Client")

    def sleep(seconds):
        now[0] += seconds
        if now[0] == 15:
            (tmp_path / "2.eml").write_bytes(b"Subject: new\r\n\r\n")

    assert probes.await_mail(session, 60, sleep=sleep, clock=lambda: now[0])[1] == "ok" and now[0] == 15
    now[0] = 100
    assert probes.await_mail(session, 20, sleep=sleep, clock=lambda: now[0])[1] == "FAIL" and now[0] == 120
    (tmp_path / "refuse").write_text("9")
    assert probes.await_mail(session, 20, sleep=sleep, clock=lambda: now[0])[3].startswith("the mailbox can't be read")
    assert Client.capabilities
