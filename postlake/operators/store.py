"""The state's tables, and the cycle that works on them.

Each step ends in one commit of all tables that it changes (``log``), so a cycle that dies leaves the state before a step or after
it. What goes out between two commits is noted in a ledger part by part; the next cycle reads it and sends the rest.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels.compose import compose_digest
from ..kernels.output import PART_CHARS
from ..limits import LIMITS, Limits
from ..sources.sinks import Ledger, Sink, deliver
from ..sources.tables import settled
from . import mail, metrics, state
from .log import Conflict, Log, StateError, told
from .stages import Stages, offline

__all__ = ["Conflict", "StateError", "Store"]

VERSION = 2
TABLES = {
    "seen": "key_hash STRING, content_hash STRING, status STRING, error_class STRING, retry_count INT, first_seen BIGINT",
    "outbox": "id BIGINT, key_hash STRING, kind STRING, parts ARRAY<STRING>, attempts INT, first_queued BIGINT, next_attempt BIGINT",
    "low_queue": "id BIGINT, key_hash STRING, received BIGINT, headline STRING, category STRING, from_domain STRING",
    "meta": "key STRING, value STRING",
}
KEYS = {"seen": ("key_hash",), "outbox": ("key_hash", "kind"), "low_queue": ("key_hash",), "meta": ("key",)}


class Store:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.log = Log(spark, self.folder, {n: (TABLES[n], KEYS[n]) for n in TABLES})
        self.ledger = f"{self.folder}/ledger"
        if not self.log.version():
            self._begin()
        found = self.meta("version")
        if found is not None and int(found) > VERSION:
            raise ValueError(f"state of version {found}; this code knows {VERSION}")

    @told
    def _begin(self) -> None:
        """The first version, with what a state of the first kind (whole tables under ``v=``) holds."""
        old: dict[str, DataFrame] = {}
        for name in TABLES:
            whole = [int(x[2:]) for x in self.log.files.names(name) if x.startswith("v=") and "_SUCCESS" in self.log.files.names(name, x)]
            if whole:
                old[name] = self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}/v={max(whole)}")
        known = {r.key: r.value for r in old["meta"].collect()} if "meta" in old else {}
        if int(known.get("version", 0)) > VERSION:
            raise ValueError(f"state of version {known['version']}; this code knows {VERSION}")
        old["meta"] = self.spark.createDataFrame(sorted((known | {"version": str(VERSION)}).items()), TABLES["meta"])
        self.apply(old)

    @told
    def read(self, name: str, keys: DataFrame | None = None, n_keys: int | None = None) -> DataFrame:
        """A table as of the last commit, or its rows of the given keys; columns that older runs lack are null."""
        return self.log.read(name, keys, n_keys)

    @told
    def apply(self, changes: Mapping[str, DataFrame], gone: Mapping[str, DataFrame] | None = None) -> None:
        """Rows that are new or take their key's place, and keys that are removed, in all tables at once."""
        self.log.commit({n: _named(r) if n == "outbox" else r for n, r in changes.items()}, gone)

    @told
    def replace(self, name: str, rows: DataFrame) -> None:
        """All that a table holds from now on."""
        self.log.commit({name: _named(rows) if name == "outbox" else rows}, instead=True)

    @told
    def meta(self, key: str) -> str | None:
        row = self.read("meta").where(F.col("key") == key).first()
        return row.value if row else None

    def meta_row(self, key: str, value: str) -> DataFrame:
        return self.spark.createDataFrame([(key, value)], TABLES["meta"])

    def set_meta(self, key: str, value: str) -> None:
        self.apply({"meta": self.meta_row(key, value)})


def _named(outbox: DataFrame) -> DataFrame:
    """What names a message: its key; one without (a digest of an older version) by its number."""
    return outbox.withColumn("key_hash", F.coalesce("key_hash", F.concat(F.lit("digest:"), F.col("id").cast("string"))))


def flush(store: Store, sink: Callable[[], Sink], now: int, limits: Limits = LIMITS) -> dict[str, int]:
    """Try what is due; book outcomes. A message whose first parts went out keeps only the rest.

    Messages are told by key and kind. Their numbers only order them, and may be shared.
    """
    rows = state.outbox_due(store.read("outbox"), F.lit(now).cast("long"), limits).collect()  # a batch of at most ``outbox_batch``
    if not rows:
        return {"delivered": 0, "deferred": 0, "abandoned": 0}
    spark, names = store.spark, [f"{r.kind}:{r.key_hash}" for r in rows]
    messages = spark.createDataFrame([(name, r.parts) for name, r in zip(names, rows, strict=True)], "dedupe_key string, parts array<string>")
    sent = {r.dedupe_key: r for r in deliver(messages, sink, ledger=store.ledger).collect()}
    done = spark.createDataFrame(
        [(i, r.id, r.key_hash, r.kind, r.parts[sent[name].sent :], r.attempts, r.first_queued, sent[name].ok) for i, (name, r) in enumerate(zip(names, rows, strict=True))],
        "id long, number long, key_hash string, kind string, parts array<string>, attempts int, first_queued long, ok boolean",
    )
    steps = state.outbox_step(done, F.lit(now).cast("long"), limits)
    after = settled(done.select("id", "number", "key_hash", "kind", "parts").join(steps, "id").drop("id").withColumnRenamed("number", "id"))
    outcomes = after.where("kind = 'mail' and outcome <> 'deferred'").select("key_hash", (F.col("outcome") == "delivered").alias("delivered"))
    booked = state.promote(store.read("seen", outcomes, len(rows)), outcomes, "key_hash")
    kept = after.where("outcome = 'deferred'").withColumn("attempts", F.col("attempts").cast("int"))
    store.apply({"seen": booked, "outbox": kept}, {"outbox": after.where("outcome <> 'deferred'").select("key_hash", "kind")})
    Ledger(store.ledger).forget(names)  # booked, so the notes have done their work
    counted = {r.outcome: r["count"] for r in after.groupBy("outcome").count().collect()}
    found = {o: counted.get(o, 0) for o in ("delivered", "deferred", "abandoned")}
    metrics.event("flushed", **found)
    return found


def waiting(store: Store, now: int, limits: Limits = LIMITS) -> dict[str, int]:
    """How many messages wait, and how many of them are due."""
    row = state.waiting(store.read("outbox"), F.lit(now).cast("long"), limits).first()
    return {"waiting": row.waiting, "due": row.due}


def pending(store: Store, keys: DataFrame) -> DataFrame:
    """The rows of ``keys(key_hash)`` of which a message still waits."""
    return state.still_pending(keys, store.read("outbox"))


def lookup(store: Store, key_hash: str) -> dict | None:
    """What is known of one mail; None if it was never seen."""
    row = store.read("seen", store.spark.createDataFrame([(key_hash,)], "key_hash string"), 1).first()
    return row.asDict() if row else None


def ingest(store: Store, files: DataFrame, now: int, sink: str = "telegram", threshold: str = "normal", limits: Limits = LIMITS, mark: Callable[[DataFrame], object] | None = None, stages: Stages | None = None) -> int:
    """Claim, judge and queue the new messages of ``files``; how many there were.

    ``files`` is read once. Where it has a ``uid``, ``mark`` gets those of all its messages (duplicates too) once their claims are durable.
    ``stages`` judge and compose; without any, no model is asked, and ``threshold`` and ``sink`` say how.
    The report of the batch is logged, as the pass that wrote its rows counted it.
    """
    stages = stages or offline(threshold, sink, limits)
    arrived = settled(mail.opened(files, limits))
    key, content = F.coalesce("dedupe_key", F.lit("")), F.coalesce("content_hash", F.lit(""))
    asked = arrived.select(F.explode(F.array(state.dedupe_hash(key), state.dedupe_hash(state.collision_key(key, content)))).alias("key_hash"))
    seen = store.read("seen", asked, 2 * arrived.count())  # of all that were ever seen, those that may be meant
    rows = stages.assess(mail.first_ones(arrived, seen.select("key_hash", "content_hash")))
    work = f"work/{uuid.uuid4().hex}"
    keep = ["dedupe_key", "content_hash", "from_domain", "status", "error", F.col("summary.headline").alias("headline"), F.col("summary.category").alias("category")]
    watched, seen_now = metrics.counted(rows)
    rows = settled(watched)
    rows.select(*keep).join(stages.compose(rows).select("dedupe_key", "parts"), "dedupe_key").withColumn("key_hash", state.dedupe_hash(F.col("dedupe_key"))).write.parquet(f"{store.folder}/{work}")
    book = store.spark.read.parquet(f"{store.folder}/{work}")
    number = F.abs(F.xxhash64("key_hash", F.lit(now)))  # numbers grow with time; keys, not numbers, tell messages apart
    at = F.lit(now).cast("long")
    low, status = F.col("status") == "queued_low", F.when(F.col("status") == "queued_low", "skipped_low").when(F.col("status") == "failed", "failed").otherwise("checked")
    store.apply(
        {
            "seen": book.select("key_hash", "content_hash", status.alias("status"), F.col("error").alias("error_class"), F.lit(0).alias("retry_count"), at.alias("first_seen")),
            "outbox": book.where(~low).select((at * 1_000_000 + number % 1_000_000).alias("id"), "key_hash", F.lit("mail").alias("kind"), "parts", F.lit(0).alias("attempts"), at.alias("first_queued"), at.alias("next_attempt")),
            "low_queue": book.where(low).select((at * 1_000_000 + number % 1_000_000).alias("id"), "key_hash", at.alias("received"), "headline", "category", "from_domain"),
        }
    )
    report = seen_now.get
    n = report["mails"]
    metrics.event("ingested", **report)
    store.log.files.delete(work)
    if mark is not None and "uid" in arrived.columns:
        mark(arrived.select("uid"))
    return n


def send_digest(store: Store, now: int, hour: int = 18, sink: str = "telegram", limits: Limits = LIMITS) -> bool:
    """Once a day, from ``hour`` on: the low-priority queue becomes one message; an empty day is done, too."""
    day = str(now // 86_400)
    if store.meta("digest_day") == day or now % 86_400 < hour * 3600:
        return False
    queue = settled(store.read("low_queue"))
    total, changes = queue.count(), {"meta": store.meta_row("digest_day", day)}
    if total:
        shown = [r.asDict() for r in queue.orderBy("id").limit(limits.digest_items).collect()]
        parts = compose_digest(shown, PART_CHARS.get(sink, 2000), limits, total)
        changes["outbox"] = store.spark.createDataFrame([(now * 1_000_000, f"digest:{day}", "digest", parts, 0, now, now)], TABLES["outbox"])
    store.apply(changes, {"low_queue": queue.select("key_hash")} if total else {})
    return total > 0


def cycle(store: Store, files: DataFrame, sink: Callable[[], Sink], now: int, name: str = "telegram", threshold: str = "normal", hour: int = 18, limits: Limits = LIMITS, mark: Callable[[DataFrame], object] | None = None, stages: Stages | None = None) -> dict[str, int]:
    """What is due, what is new, what that queued, and the digest; counts of all. ``mark`` and ``stages`` as in ``ingest``."""
    first = flush(store, sink, now, limits)
    new = ingest(store, files, now, name, threshold, limits, mark, stages)
    digest = send_digest(store, now, hour, name, limits)
    second = flush(store, sink, now, limits)
    return {"new": new, "digest": int(digest)} | {k: first[k] + second[k] for k in first}


def run_forever(step: Callable[[], object], stop: threading.Event, every: float, failed: Callable[[Exception], float | None] = lambda e: None) -> int:
    """Cycle after cycle until ``stop`` is set, which lets a running cycle end; how many there were.

    ``failed`` gives the seconds to wait after a cycle that raised, or None if that ends the run. Waits end at once when stopped.
    """
    done = 0
    while not stop.is_set():
        wait: float | None = every
        try:
            step()
        except Exception as e:
            wait = failed(e)
            if wait is None:
                raise
        done += 1
        stop.wait(wait)
    return done
