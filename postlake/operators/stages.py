"""The stages behind a mail's cleaning, put together from a configuration or from parts: functions of tables that a cycle takes.

``assess`` makes sanitized rows into judged ones (summary, verdict, status), ``compose`` makes those into messages. Without a model both are
columns; with one, summaries and verdicts are asked for at the service's pace. ``probe`` sends a made-up mail through the stages
and nowhere else.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..config import Config, Model
from ..limits import LIMITS, Limits
from ..sources import models
from ..sources.paced import Pace
from ..sources.tables import settled
from . import assess, mail

Stage = Callable[[DataFrame], DataFrame]
Maker = Callable[[], models.Complete]


@dataclass(frozen=True)
class Stages:
    assess: Stage
    compose: Stage
    limits: Limits = LIMITS


def offline(threshold: str = "normal", sink: str = "telegram", limits: Limits = LIMITS, footnote: bool = False) -> Stages:
    """No model: the beginning of the text, and what the code alone knows."""
    return Stages(lambda rows: mail.judged_safe(rows, threshold, limits), lambda rows: mail.composed(rows, sink, footnote), limits)


def with_models(summarizer: Maker, critic: Maker, threshold: str = "normal", sink: str = "telegram", limits: Limits = LIMITS, footnote: bool = False, instructions: str = "", pace: Pace | None = None) -> Stages:
    """A model summarises, another (or the same) reviews. The reader's instructions go to the first only."""

    def judge(rows: DataFrame) -> DataFrame:
        return mail.routed(assess.reviewed(assess.summarized(rows, summarizer, instructions, limits, pace), critic, limits, pace), threshold)

    return Stages(judge, lambda rows: mail.composed(rows, sink, footnote), limits)


def _maker(model: Model, key: str) -> Maker | None:
    """What makes the client that a section names, checked here and now; None where it names none."""
    made = lambda: models.client(model.provider, model.model, key, model.base_url, model.max_tokens)
    return made if made() is not None else None


def from_config(config: Config, key: str = "", critic_key: str = "", instructions: str = "", pace: Pace | None = None, summarizer: Maker | None = None, critic: Maker | None = None) -> Stages:
    """The stages that a configuration names; ``summarizer`` and ``critic`` take the place of its own. The critic's empty settings are the model's."""
    summarizer = summarizer or _maker(config.model, key)
    own = (config.delivery.min_importance, config.delivery.active, config.limits, config.delivery.footnote)
    if summarizer is None:
        return offline(*own)
    return with_models(summarizer, critic or _maker(config.critic_model(), critic_key or key) or summarizer, *own, instructions, pace)


#: A mail with a link, an address in disguise, hidden text and a reply address elsewhere.
MADE_UP = (
    b"Message-ID: <probe@postlake.example>\r\nFrom: Probe <probe@postlake.example>\r\nReply-To: other@elsewhere.example\r\nSubject: Probe\r\nMIME-Version: 1.0\r\n"
    b"Content-Type: text/html; charset=utf-8\r\n\r\n<p>See <a href='http://probe.example/x'>this</a> and hxxps://probe(.)example.</p><p hidden>unseen</p>\r\n"
)


@dataclass(frozen=True)
class Probed:
    status: str
    error: str | None
    parts: list[str]

    @property
    def fine(self) -> bool:
        """Judged and composed, with nothing left to click and nothing hidden shown."""
        said = " ".join(self.parts)
        return self.status in ("delivered", "queued_low") and self.error is None and "http://" not in said and "unseen" not in said


def probe(spark: SparkSession, stages: Stages, message: bytes = MADE_UP) -> Probed:
    """What the stages make of one mail; no state, no sink and no mailbox is touched."""
    rows = mail.first_ones(settled(mail.opened(spark.createDataFrame([(bytearray(message),)], "content binary"), stages.limits)))
    judged = settled(stages.assess(rows))
    found, made = judged.select("status", "error").first(), stages.compose(judged).first()
    return Probed(found.status, found.error, list(made.parts))


class Collecting:
    """A sink that keeps what it is given, as JSON lines of a file, and sends nothing."""

    def __init__(self, path: str) -> None:
        self.path = path

    def __call__(self) -> Collecting:
        return self

    def send(self, key: str, part_no: int, text: str) -> None:
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(json.dumps({"key": key, "part_no": part_no, "text": text}, ensure_ascii=False) + "\n")

    @property
    def sent(self) -> list[dict]:
        try:
            with open(self.path, encoding="utf-8") as f:
                return [json.loads(line) for line in f]
        except FileNotFoundError:
            return []
