"""Commands that a chat may give: all of them are served, and what was asked is remembered across runs."""

from __future__ import annotations

from typing import Protocol

from ..config import Config
from ..kernels.output import PART_CHARS, finalize, scrub_plain
from ..sources.http import Failed
from ..sources.sinks import Temporary
from . import digest
from .store import TABLES, Store, waiting

#: Fixed value: characters of the folder's name that an answer shows.
FOLDER = 80
OFFSET = "command_offset"


class Source(Protocol):
    def updates(self, offset: int = 0) -> list[dict]: ...


def enabled(config: Config, accept: bool, token: str, chat: str) -> bool:
    """Only a bot that is the active sink, has a token and a chat, and was told to takes commands."""
    return config.delivery.active == "telegram" and accept and bool(token) and bool(chat)


def poll(store: Store, bot: Source, chat: str) -> list[str]:
    """The new commands in their order. The offset moves past junk too; a failed call costs nothing but this poll."""
    kept = store.meta(OFFSET)
    offset = int(kept) if kept and kept.isdigit() else 0
    try:
        rows = bot.updates(offset)
    except (Failed, Temporary):
        return []
    if not rows:
        return []
    df = store.spark.createDataFrame([(r["update_id"], r["chat_id"], r["text"]) for r in rows], "update_id long, chat_id string, text string")
    found = [r.command for r in digest.commands(df, chat).orderBy("update_id").collect()]  # one call's updates
    after = max(offset, *(r["update_id"] + 1 for r in rows))
    if after != offset:
        store.set_meta(OFFSET, str(after))
    return found


def answer_status(store: Store, folder: str, now: int, sink: str = "telegram") -> None:
    """Queue the answer to /status. The folder's name is the only part of it that isn't ours."""
    queued = store.read("low_queue").count()
    text = f"Running. Folder: {scrub_plain(folder, FOLDER)}. {waiting(store, now)['waiting']} message(s) waiting to be delivered, {queued} mail(s) collected for the daily digest."
    parts = finalize(text, PART_CHARS.get(sink, 2000))
    row = store.spark.createDataFrame([(now * 1_000_000, f"status:{now}", "status", parts, 0, now, now)], TABLES["outbox"])
    waits = store.read("outbox", row, 1).select("key_hash")
    store.apply({"outbox": row.join(waits, "key_hash", "left_anti").select(row.columns)})


def serve(store: Store, bot: Source, chat: str, folder: str, now: int, sink: str = "telegram") -> bool:
    """Serve all that was asked; whether a run is due at once, however often it was asked for."""
    asked = poll(store, bot, chat)
    if "/status" in asked:
        answer_status(store, folder, now, sink)
    return "/digest" in asked
