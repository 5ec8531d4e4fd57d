"""The state's log against a plain dictionary, and what is left when a cycle dies at any of its writes."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postlake.operators import log, store
from postlake.sources import eml, sinks

from .test_delivery import ToFile

NOW = 1_705_276_800 + 60
TABLES = {"t": ("k STRING, v INT", ("k",)), "u": ("a STRING, b STRING, n INT", ("a", "b"))}


def rows(spark, ddl, data):
    return spark.createDataFrame(data, ddl)


def test_like_a_dictionary(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log, "FAN", 3)
    made, truth, dice = log.Log(spark, str(tmp_path), TABLES), {}, random.Random(4)
    assert made.version() == 0 and made.read("t").count() == 0
    for i in range(12):
        new = {f"k{dice.randrange(9)}": dice.choice([i, None]) for _ in range(dice.randrange(3))}
        gone = [k for k in (f"k{dice.randrange(9)}",) if k not in new and dice.random() < 0.6]
        made.commit({"t": rows(spark, TABLES["t"][0], list(new.items()))}, {"t": rows(spark, "k string", [(k,) for k in gone])} if gone else None)
        truth = {k: v for k, v in (truth | new).items() if k not in gone}
        if i % 3 == 2:
            assert {r.k: r.v for r in made.read("t").collect()} == truth
            some = rows(spark, "k string", [("k1",), ("k2",), ("k2",), ("other",)])
            for n in (4, None):
                assert {r.k: r.v for r in made.read("t", some, n).collect()} == {k: v for k, v in truth.items() if k in ("k1", "k2")}
    runs = made.manifest()["t"]
    assert made.version() == 12 and len(runs) < 9 and max(r["level"] for r in runs) >= 1
    assert len(made.files.names("data", "t")) <= 12  # what no kept version names is gone
    assert len([x for x in made.files.names("manifest") if x.endswith(".json")]) == log.KEPT


def test_keys_of_two_columns_and_whole_tables(spark, tmp_path):
    made = log.Log(spark, str(tmp_path), TABLES)
    made.commit({"u": rows(spark, TABLES["u"][0], [("x", "1", 1), ("x", "2", 2)]), "t": rows(spark, TABLES["t"][0], [("a", 1)])})
    made.commit({"u": rows(spark, TABLES["u"][0], [("x", "2", 3)])}, {"u": rows(spark, "a string, b string", [("x", "1")])})
    assert [tuple(r) for r in made.read("u").collect()] == [("x", "2", 3)] and made.read("t").count() == 1
    made.commit({"u": rows(spark, TABLES["u"][0], [("y", "9", 9)])}, instead=True)
    assert [tuple(r) for r in made.read("u").collect()] == [("y", "9", 9)] and made.read("t").count() == 1


def test_two_writers(spark, tmp_path, monkeypatch):
    first, second = (log.Log(spark, str(tmp_path), TABLES) for _ in range(2))
    one = rows(spark, TABLES["t"][0], [("a", 1)])
    first.commit({"t": one})
    monkeypatch.setattr(second, "version", lambda: 0)
    with pytest.raises(log.Conflict):
        second.commit({"t": one})
    assert first.version() == 1 and first.read("t").count() == 1


def test_a_batch_costs_what_it_has(spark, tmp_path):
    """A few keys against a large store: no run is shuffled, and a commit writes only its own rows."""
    made = log.Log(spark, str(tmp_path), TABLES)
    made.commit({"t": spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").cast("int").alias("v"))})
    made.commit({"t": rows(spark, TABLES["t"][0], [("k7", 0)])})
    assert [r["rows"] for r in made.manifest()["t"]] == [20_000, 1]
    found = made.read("t", rows(spark, "k string", [("k7",), ("k9",)]), 2)
    oldest = found._jdf.queryExecution().optimizedPlan().toString()
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert {r.k: r.v for r in found.collect()} == {"k7": 0, "k9": 9} and "LeftAnti" in oldest
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and plan.count("BroadcastHashJoin") >= 3


class Died(BaseException):
    """Ends a cycle where it is; nothing may catch it."""


class Killer:
    """Counts the driver's writes, and dies at the one that it is told, before or after it is done."""

    def __init__(self, monkeypatch) -> None:
        self.n, self.at, self.after = 0, None, False
        for owner, name in ((log.Log, "_write"), (log.Files, "create"), (log.Files, "rename_new"), (log.Log, "_vacuum"), (log.Files, "delete"), (sinks.Ledger, "forget"), (store, "deliver")):
            monkeypatch.setattr(owner, name, self._counted(getattr(owner, name)))

    def _counted(self, real):
        def run(*args, **kwargs):
            self.n += 1
            mine = self.n == self.at
            if mine and not self.after:
                raise Died
            out = real(*args, **kwargs)
            if mine:
                raise Died
            return out

        return run


def test_dies_at_each_write(spark, tmp_path, monkeypatch):
    folder = tmp_path / "mail"
    folder.mkdir()
    for i in range(2):
        (folder / f"{i}.eml").write_text(f"Message-ID: <{i}@x>\r\nFrom: A <a@b.example>\r\nSubject: S{i}\r\nContent-Type: text/plain\r\n\r\nHello {i}\r\n")
    files = eml.read_eml(spark, str(folder)).cache()
    killer = Killer(monkeypatch)

    def cycle(s, out):
        return store.cycle(s, files, ToFile(str(out)), NOW, hour=24)

    s = store.Store(spark, str(tmp_path / "plain"))
    killer.n = 0
    assert cycle(s, tmp_path / "plain.out") == {"new": 2, "digest": 0, "delivered": 2, "deferred": 0, "abandoned": 0}
    writes = killer.n
    want = Counter((tmp_path / "plain.out").read_text().split("\n"))
    assert writes >= 12
    for at in range(1, writes + 1):
        state, out = str(tmp_path / f"s{at}"), tmp_path / f"{at}.out"
        killer.at, killer.n, killer.after = None, 0, at % 2 == 0
        s = store.Store(spark, state)
        killer.n, killer.at = 0, at
        with pytest.raises(Died):
            cycle(s, out)
        killer.at = None
        cycle(store.Store(spark, state), out)
        assert Counter(out.read_text().split("\n")) == want, f"write {at}"
        again = store.Store(spark, state)
        assert again.read("outbox").count() == 0 and {r.status for r in again.read("seen").collect()} == {"delivered"}


def test_digest_is_one_step(spark, tmp_path, monkeypatch):
    s = store.Store(spark, str(tmp_path / "s"))
    s.apply({"low_queue": rows(spark, store.TABLES["low_queue"], [(1, "k", NOW, "head", "other", "b.example")])})
    killer = Killer(monkeypatch)
    killer.at = 4  # the manifest's draft is there, the manifest is not
    with pytest.raises(Died):
        store.send_digest(s, NOW, hour=0)
    killer.at = None
    assert s.read("low_queue").count() == 1 and s.read("outbox").count() == 0 and s.meta("digest_day") is None
    assert store.send_digest(s, NOW, hour=0) and not store.send_digest(s, NOW, hour=0)
    assert s.read("low_queue").count() == 0 and s.read("outbox").count() == 1


def test_older_states_are_taken_over(spark, tmp_path):
    box = [(3, "k", "mail", ["x"], 1, NOW, NOW), (4, None, "digest", ["y"], 0, NOW, NOW)]
    for v, data in ((1, box[:1]), (2, box)):
        rows(spark, store.TABLES["outbox"], data).write.parquet(str(tmp_path / f"s/outbox/v={v}"))
    rows(spark, store.TABLES["meta"], [("version", "1"), ("digest_day", "9")]).write.parquet(str(tmp_path / "s/meta/v=1"))
    s = store.Store(spark, str(tmp_path / "s"))
    assert s.meta("version") == str(store.VERSION) and s.meta("digest_day") == "9"
    assert {(r.id, r.key_hash) for r in s.read("outbox").collect()} == {(3, "k"), (4, "digest:4")}
    assert store.Store(spark, str(tmp_path / "s")).read("outbox").count() == 2
    rows(spark, store.TABLES["meta"], [("version", "9")]).write.parquet(str(tmp_path / "new/meta/v=1"))
    with pytest.raises(ValueError, match="9"):
        store.Store(spark, str(tmp_path / "new"))


class DiesAt(ToFile):
    """A sink whose process is gone when it is to send a part of that text."""

    def send(self, key, part_no, text):
        import os

        if text == "third" and not os.path.exists(self.path + ".died"):
            open(self.path + ".died", "w").close()
            os._exit(1)
        super().send(key, part_no, text)


def test_a_task_that_is_lost_goes_on_where_it_was(spark, tmp_path):
    messages = rows(spark, "dedupe_key string, parts array<string>", [("m", ["first", "second", "third", "fourth"])])
    sink, ledger = DiesAt(str(tmp_path / "out")), str(tmp_path / "ledger")
    with pytest.raises(Exception):  # noqa: B017  in local mode no task is tried again
        sinks.deliver(messages, sink, ledger=ledger)
    assert (tmp_path / "out").read_text().split() == ["first", "second"]
    done = sinks.deliver(messages, sink, ledger=f"file://{ledger}").first()
    assert (done.sent, done.n_parts, done.ok) == (4, 4, True)
    assert (tmp_path / "out").read_text().split() == ["first", "second", "third", "fourth"]
    notes = sinks.Ledger(ledger)
    assert notes.noted("m") == {1, 2, 3, 4} and notes.noted("other") == set()
    rest = rows(spark, "dedupe_key string, parts array<string>", [("m", ["third", "fourth"])])  # queued again without its first parts
    assert sinks.deliver(rest, sink, ledger=ledger).first().sent == 2 and len((tmp_path / "out").read_text().split()) == 4
    notes.forget(["m", "other"])
    assert notes.noted("m") == set()
