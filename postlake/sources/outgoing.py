"""Messages as a Spark data sink, of batches and of streams: each part is sent once, and what happened is written when all tasks are done.

A task notes each part in the ledger as soon as it is out. Whoever runs the task again, or the batch of a stream, reads the notes
first and sends the rest. Outcomes travel as commit messages, and one file of JSON lines for each write holds them;
a stream's batch that is written again replaces its own. A message that failed is an outcome and no error of the write.
"""

from __future__ import annotations

import importlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from . import messengers
from .sinks import OUTCOME, Ledger, Outcome, Sink, send_all

SCHEMA = "dedupe_key STRING, parts ARRAY<STRING>"
#: Options that ``messengers.maker`` takes.
MAKER = ("token", "chat", "url", "path", "host")


def maker(options: dict[str, str]) -> Callable[[], Sink]:
    """What makes the sink: ``module:name`` of a deployment's own (called with the options), or the name of one that calls out."""
    name = options["sink"]
    module, _, attribute = name.partition(":")
    if attribute:
        make = getattr(importlib.import_module(module), attribute)
        return lambda: make(options)
    return messengers.maker(name, **{k: options[k] for k in MAKER if k in options})


@dataclass
class Sent(WriterCommitMessage):
    outcomes: list[Outcome]


class _Writer:
    def __init__(self, options: dict[str, str]) -> None:
        for needed in ("sink", "ledger"):
            if not options.get(needed):
                raise ValueError(f"option {needed} is needed")
        self.options = options
        maker(options)  # options are checked before anything runs

    def write(self, iterator: Iterator[Row]) -> Sent:
        out, ledger, attempts = maker(self.options)(), Ledger(self.options["ledger"]), int(self.options.get("attempts", 3))
        return Sent([send_all(out, r.dedupe_key or "", r.parts or [], attempts, ledger) for r in iterator])

    def _book(self, messages: list, name: str) -> None:
        """The outcomes of a write, under a name that a repeated write has again."""
        ledger = Ledger(self.options["ledger"])
        folder = f"{ledger.folder}/outcomes"
        ledger.fs.create_dir(folder, recursive=True)
        columns = [c.split()[0] for c in OUTCOME.split(", ")]
        draft = f"{folder}/.{uuid.uuid4().hex}"
        with ledger.fs.open_output_stream(draft) as f:
            for m in messages:
                for outcome in m.outcomes if m is not None else ():
                    f.write((json.dumps(dict(zip(columns, outcome, strict=True))) + "\n").encode())
        ledger.fs.move(draft, f"{folder}/{name}.json")

    def abort(self, messages: list, *_: int) -> None:
        """What went out stays noted: the next write sends the rest."""


class _BatchWriter(_Writer, DataSourceWriter):
    def commit(self, messages: list) -> None:
        self._book(messages, f"write-{uuid.uuid4().hex}")


class _StreamWriter(_Writer, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:
        self._book(messages, f"batch-{batchId}")


class Messages(DataSource):
    """``spark.dataSource.register(Messages); df.write.format("messages").options(sink=..., ledger=...).mode("append").save()``, or ``writeStream``.

    Rows are ``dedupe_key`` and ``parts``. Options: sink (as ``maker`` says) with its own, ledger (a folder that driver and tasks
    share), attempts of each part.
    """

    @classmethod
    def name(cls) -> str:
        return "messages"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _BatchWriter(dict(self.options))

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return _StreamWriter(dict(self.options))


def outcomes(spark: SparkSession, ledger: str) -> DataFrame:
    """(dedupe_key, sent, n_parts, ok, error) of all writes with that ledger; a message that was tried again has a row for each try."""
    try:
        return spark.read.schema(OUTCOME).json(f"{ledger}/outcomes/*.json")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], OUTCOME)
