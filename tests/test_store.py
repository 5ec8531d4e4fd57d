from __future__ import annotations

import pytest

from postlake import config
from postlake.operators import checks, providers, store
from postlake.sources import eml

DAY = 1_705_276_800
BODY = "Message-ID: <{0}@x>\r\nFrom: A <a@b.example>\r\nSubject: S{0}\r\nContent-Type: text/plain\r\n\r\nHello {1}\r\n"


class Down:
    def send(self, key, part_no, text):
        raise OSError("down")


class Up:
    def send(self, key, part_no, text):
        assert "://" not in text


def test_cycles(spark, tmp_path):
    folder = tmp_path / "mail"
    folder.mkdir()
    for i, (key, said) in enumerate([(1, "a"), (1, "a"), (2, "b")]):
        (folder / f"{i}.eml").write_text(BODY.format(key, said))
    files = eml.read_eml(spark, str(folder))
    s = store.Store(spark, str(tmp_path / "state"))
    assert store.cycle(s, files, Down, DAY + 60) == {"new": 2, "digest": 0, "delivered": 0, "deferred": 2, "abandoned": 0}
    assert store.cycle(s, files, Up, DAY + 90) == {"new": 0, "digest": 0, "delivered": 0, "deferred": 0, "abandoned": 0}  # not due yet
    (folder / "3.eml").write_text(BODY.format(1, "other"))
    files = eml.read_eml(spark, str(folder))
    assert store.cycle(s, files, Up, DAY + 200) == {"new": 1, "digest": 0, "delivered": 3, "deferred": 0, "abandoned": 0}
    assert {r.status for r in s.read("seen").collect()} == {"delivered"} and s.read("outbox").count() == 0
    (folder / "4.eml").write_text(BODY.format(5, "low"))
    files = eml.read_eml(spark, str(folder))
    assert store.ingest(s, files, DAY + 300, threshold="high") == 1 and s.read("low_queue").count() == 1
    assert not store.send_digest(s, DAY + 400) and store.send_digest(s, DAY + 19 * 3600) and not store.send_digest(s, DAY + 20 * 3600)
    assert s.read("low_queue").count() == 0 and s.read("outbox").first().parts[0].startswith("🗂 1 low-priority mails: 1 unclassified")
    assert store.flush(s, Up, DAY + 20 * 3600)["delivered"] == 1
    s.set_meta("version", "99")
    with pytest.raises(ValueError, match="99"):
        store.Store(spark, str(tmp_path / "state"))


def test_config(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text('[delivery]\nactive = "discord"\n[model]\nprovider = "x"\nmodel = "m"\n[critic]\nmodel = ""\nmax_tokens = 5\n[limits]\nlinks = 10\n')
    made = config.load(path, {"POSTLAKE_DELIVERY_DIGEST_HOUR": "7"})
    assert (made.delivery.active, made.delivery.digest_hour, made.limits.links) == ("discord", 7, 10)
    assert made.critic_model() == config.Model("x", "m", "", 5) and config.state_dir(made, path) == str(tmp_path / "state")
    with pytest.raises(config.ConfigError) as e:
        config.load_dict({"delivery": {"min_importance": "urgent", "nope": 1, "digest_hour": "x"}, "source": 3, "other": {}, "model": {"provider": "x"}}, {})
    assert set(str(e.value).split("\n")) == {"[delivery] nope: unknown", "[delivery] digest_hour: int expected", "[source] is no table", "[other] is no section", "[delivery] min_importance: one of low, normal, high expected", "[model] model: needed unless the provider is none"}


def test_presets_and_checks(spark):
    presets = spark.createDataFrame([("a1", "a", "http://1"), ("a2", "a", "http://2"), ("b1", "b", "http://3")], "key string, provider string, preset_url string")
    wanted = spark.createDataFrame([("a", "http://2"), ("b1", ""), ("b", ""), ("a", ""), ("z", "")], "name string, base_url string")
    assert {(r.name, r.base_url): r.preset for r in providers.find_preset(wanted, presets).collect()} == {("a", "http://2"): "a2", ("b1", ""): "b1", ("b", ""): "b1", ("a", ""): "openai_compatible", ("z", ""): "none"}
    rows = spark.createDataFrame([("/etc/x", "10", "a \r\nb\t"), ("/a/../b", "x", "a\x07"), ("rel", "99999", "y" * 2001)], "p string, n string, t string")
    from pyspark.sql import functions as F

    got = rows.select(checks.valid_folder(F.col("p")).alias("p"), checks.in_range(F.col("n"), 1, 65535).alias("n"), checks.instructions(F.col("t")).alias("t")).collect()
    assert [(r.p, r.n, r.t.problem) for r in got] == [(True, 10, None), (False, None, "control characters: U+0007"), (False, None, "too long")] and got[0].t.text == "a\nb"
