"""Where messages go: a registry of sinks, and the retry rule of those that call out."""

from __future__ import annotations

import contextlib
import hashlib
import math
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Protocol

from pyspark.sql import DataFrame, Row

from .tables import settled


class Sink(Protocol):
    """Sends one part; raises ``Temporary`` for what may work later."""

    def send(self, key: str, part_no: int, text: str) -> None: ...


class Temporary(Exception):
    """A failure worth another try; ``after`` seconds if the other side said so."""

    def __init__(self, message: str = "", after: float | None = None) -> None:
        super().__init__(message)
        self.after = after


def pause(attempt: int, after: float | None, most: float = 30.0) -> float:
    """Seconds before the next try: what the other side asks for if that is sensible, else doubled each time."""
    if after is not None and math.isfinite(after) and after >= 0:
        return min(after, most)
    return min(2.0 ** (attempt - 1), most)


def with_retry(call: Callable[[], None], attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> None:
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except Temporary as e:
            if attempt == attempts:
                raise
            sleep(pause(attempt, e.after))
    return None


class ConsoleSink:
    def send(self, key: str, part_no: int, text: str) -> None:
        print(f"{key[:12]} {part_no}: {text}")


#: Makers of sinks by name; a deployment adds its own, ``messengers`` those that call out.
SINKS: dict[str, Callable[[], Sink]] = {"console": ConsoleSink}


class Ledger:
    """Which parts of which messages have gone out: an empty file for each part, in a folder that driver and tasks share.

    A part is numbered from the message's end, so a message that is queued again without its first parts keeps its numbers.
    """

    def __init__(self, folder: str) -> None:
        from pyarrow import fs

        self.fs, self.folder = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        self._selector = fs.FileSelector

    def _of(self, key: str) -> str:
        name = hashlib.sha256(key.encode()).hexdigest()
        return f"{self.folder}/{name[:2]}/{name}"

    def noted(self, key: str) -> set[int]:
        return {int(x.base_name) for x in self.fs.get_file_info(self._selector(self._of(key), allow_not_found=True)) if x.base_name.isdigit()}

    def note(self, key: str, left: int) -> None:
        self.fs.create_dir(self._of(key), recursive=True)
        self.fs.open_output_stream(f"{self._of(key)}/{left}").close()

    def forget(self, keys: Iterable[str]) -> None:
        """What was booked elsewhere needs no note any more."""
        for key in keys:
            with contextlib.suppress(FileNotFoundError):
                self.fs.delete_dir(self._of(key))


Outcome = tuple[str, int, int, bool, str | None]
OUTCOME = "dedupe_key string, sent int, n_parts int, ok boolean, error string"


def send_all(out: Sink, key: str, parts: Sequence[str], attempts: int = 3, ledger: Ledger | None = None) -> Outcome:
    """Send a message's parts in order, but for those that the ledger has; it stops at the first that fails."""
    sent, error = 0, None
    try:
        noted = ledger.noted(key) if ledger else set()
        for i, text in enumerate(parts):
            if len(parts) - i not in noted:
                with_retry(lambda i=i, text=text: out.send(key, i, text), attempts)
                if ledger:
                    ledger.note(key, len(parts) - i)
            sent += 1
    except Exception as e:  # noqa: BLE001  booked as a failed try
        error = type(e).__name__
    return key, sent, len(parts), error is None, error


def deliver(messages: DataFrame, sink: Callable[[], Sink], attempts: int = 3, ledger: str | None = None) -> DataFrame:
    """Send each message's parts in order; (dedupe_key, sent, n_parts, ok, error).

    A message stops at its first part that fails (``error`` is the failure's class), and the rest can be retried from
    ``sent``. Everything is sent here and once: the result is a table of what happened, however often it is read.
    With the folder of a ``ledger`` a task that is lost and run again goes on where the lost one was; only what died between a part
    and its note goes out twice. Without one it sends its parts again. A copy of a running task would send them too, so
    sessions that start such copies are refused.
    """
    if messages.sparkSession.sparkContext.getConf().get("spark.speculation", "false") == "true":
        raise ValueError("a message may not be sent by two copies of a task: spark.speculation is on")

    def run(rows: Iterator) -> Iterator:
        import pandas as pd

        out, notes = sink(), Ledger(ledger) if ledger else None
        for frame in rows:
            done = [send_all(out, key, parts, attempts, notes) for key, parts in zip(frame["dedupe_key"], frame["parts"], strict=True)]
            yield pd.DataFrame(done, columns=["dedupe_key", "sent", "n_parts", "ok", "error"])

    return settled(messages.select("dedupe_key", "parts").mapInPandas(run, OUTCOME))


def log_line(row: Row) -> str:
    """A row as one JSON line; values that are no scalars show only their kind."""
    import json

    return json.dumps({k: v if isinstance(v, str | int | float | bool | None) else type(v).__name__ for k, v in row.asDict().items()}, ensure_ascii=False)
