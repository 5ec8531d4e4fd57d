"""Stages from a configuration, a cycle that asks a model, and a probe that touches nothing."""

from __future__ import annotations

import json

import pytest

from postlake import config
from postlake.operators import stages, store
from postlake.sources import eml, models
from postlake.sources.paced import Pace

from .test_boundaries import GOOD, JUDGED

NOW = 1_705_276_800
MAIL = "Message-ID: <{0}@x>\r\nFrom: A <a@b.example>\r\nSubject: S{0}\r\nContent-Type: text/plain\r\n\r\n{1}\r\n"


def model(system, user):
    """Finds mails that say so unimportant or fraudulent, and fails for one."""
    if "cannot" in user:
        raise models.InvalidReply("no")
    if "phishing_risk" in system:
        return json.dumps(JUDGED | {"phishing_risk": "high" if "swindle" in user else "none"})
    return json.dumps(GOOD | {"importance": "low" if "boring" in user or "swindle" in user else "normal", "headline": "By a model"})


def maker():
    return model


def test_a_cycle_that_asks_a_model(spark, tmp_path):
    folder = tmp_path / "mail"
    folder.mkdir()
    for i, said in enumerate(["hello", "boring news", "swindle", "cannot be read"]):
        (folder / f"{i}.eml").write_text(MAIL.format(i, said))
    s, sink = store.Store(spark, str(tmp_path / "state")), stages.Collecting(str(tmp_path / "out"))
    made = stages.with_models(maker, maker, pace=Pace(1000, 2, 2))
    got = store.cycle(s, eml.read_eml(spark, str(folder)), sink, NOW + 60, hour=24, stages=made)
    assert (got["new"], got["delivered"]) == (4, 3) and s.read("low_queue").count() == 1
    texts = [x["text"] for x in sink.sent]
    assert sum("By a model" in t for t in texts) == 2 and sum("llm_invalid_response" in t for t in texts) == 1
    assert sorted(r.status for r in s.read("seen").collect()) == ["delivered", "delivered", "failed", "skipped_low"]
    assert {x["key"].partition(":")[0] for x in sink.sent} == {"mail"}


def test_from_config(spark, tmp_path):
    plain = stages.from_config(config.load_dict({"delivery": {"min_importance": "high", "active": "signal"}}, {}))
    found = stages.probe(spark, plain)
    assert found.status == "queued_low" and found.fine and found.parts == []
    told = config.load_dict({"model": {"provider": "openai_compatible", "model": "m", "base_url": "http://127.0.0.1:9"}, "critic": {"model": "n"}}, {})
    asked = stages.from_config(told, key="k", summarizer=maker, critic=maker, instructions="short")
    assert stages.probe(spark, asked).fine and "By a model" in stages.probe(spark, asked).parts[0]
    own = stages._maker(told.critic_model(), "k")()
    assert isinstance(own, models.Chat) and own.model == "n" and own.host == "http://127.0.0.1:9"
    with pytest.raises(ValueError):
        stages.from_config(config.load_dict({"model": {"provider": "nobody", "model": "m"}}, {}))


def test_probe(spark, tmp_path):
    found = stages.probe(spark, stages.offline())
    assert found.fine and found.status == "delivered" and "Probe" in found.parts[0] and found.error is None
    broken = stages.with_models(lambda: lambda system, user: "no json", maker)
    failed = stages.probe(spark, broken)
    assert not failed.fine and failed.status == "failed" and failed.error == "llm_invalid_response"
    leaky = stages.Stages(stages.offline().assess, lambda rows: rows.selectExpr("dedupe_key", "array('http://x') as parts"))
    assert not stages.probe(spark, leaky).fine
    assert stages.Collecting(str(tmp_path / "none")).sent == []
