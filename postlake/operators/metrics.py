"""Counters that a pass gives as it runs, and a log of them as JSON lines.

``counted`` puts the report's aggregates into the plan itself (``observe``), so they are there when the rows have been written and cost no
second job. ``JsonLog`` writes a line for what happens to each streaming query, with what its batches observed. No line holds
anything of a mail's content.
"""

from __future__ import annotations

import json
import logging
import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql.streaming import StreamingQueryListener

from . import mail

LOGGER = logging.getLogger("postlake")


def counted(judged_rows: DataFrame, name: str = "mails") -> tuple[DataFrame, Observation]:
    """The same rows, and what holds the report of ``mail.stage_report`` once an action has run over all of them."""
    seen = Observation(name)
    return judged_rows.observe(seen, *mail.report_columns()), seen


def counted_stream(judged_rows: DataFrame, name: str = "mails") -> DataFrame:
    """The same for a stream: each batch's progress has the counts under that name."""
    return judged_rows.observe(name, *mail.report_columns())


class JsonLines(logging.Formatter):
    """Records as JSON lines: time, level, event and the scalar ``fields``; of other values only their kind."""

    converter = time.gmtime

    def format(self, record: logging.LogRecord) -> str:
        fields = {k: v if isinstance(v, str | int | float | bool | None) else type(v).__name__ for k, v in getattr(record, "fields", {}).items()}
        head = {"at": self.formatTime(record, "%Y-%m-%dT%H:%M:%SZ"), "level": record.levelname.lower(), "event": record.getMessage()}
        if record.exc_info and record.exc_info[0]:
            head["error"] = record.exc_info[0].__name__  # an error's text may hold what a mail said
        return json.dumps(head | fields, ensure_ascii=False)


def log_to(path: str, logger: logging.Logger = LOGGER) -> logging.Handler:
    """Send the logger's records to a file of JSON lines; the handler, for ``removeHandler``."""
    handler = logging.FileHandler(path, encoding="utf-8")
    handler.setFormatter(JsonLines())
    logger.addHandler(handler)
    logger.setLevel(logging.INFO)
    return handler


def event(what: str, logger: logging.Logger = LOGGER, **fields: object) -> None:
    logger.info(what, extra={"fields": fields})


class JsonLog(StreamingQueryListener):
    """``spark.streams.addListener(JsonLog())``: a line when a query starts, ends, idles and for each of its batches."""

    def __init__(self, logger: logging.Logger = LOGGER) -> None:
        self.logger = logger

    def onQueryStarted(self, e) -> None:
        event("query_started", self.logger, query=e.name, id=str(e.id))

    def onQueryProgress(self, e) -> None:
        p = e.progress
        counts = {f"{name}_{k}": v for name, row in (p.observedMetrics or {}).items() for k, v in row.asDict().items()}
        event("query_progress", self.logger, query=p.name, batch=p.batchId, rows=p.numInputRows, seconds=p.batchDuration / 1000, **counts)

    def onQueryIdle(self, e) -> None:
        event("query_idle", self.logger, id=str(e.id))

    def onQueryTerminated(self, e) -> None:
        failed = bool(e.exception)
        event("query_failed" if failed else "query_ended", self.logger, id=str(e.id), error=e.errorClassOnException if failed else None)
