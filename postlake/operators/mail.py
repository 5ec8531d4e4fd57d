"""From raw messages to delivered ones, table by table.

``raw`` and ``sanitized`` run kernels in Arrow batches, one call a mail with all of its fields, as links are
numbered through them. All decisions between are columns. Failures stay rows: each table has them with
the stage and class, so nothing is lost and nothing of a mail's content leaks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schemas
from ..functions import text as X
from ..kernels import compose as C
from ..kernels import mime
from ..kernels.output import PART_CHARS
from ..limits import LIMITS, Limits
from ..sources.tables import settled
from . import policy
from .state import claim_with_rekey

_SMALL = 256
NOTE = "Excerpt, not a summary — no language model configured."


def _mapped(rows: DataFrame, one: Callable[[dict], dict], ddl: str) -> DataFrame:
    """A row for each row, in batches small enough for large binaries."""
    schema = T.StructType.fromDDL(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for b in batches:
            for i in range(0, b.num_rows, _SMALL):
                out = [one(r) for r in b.slice(i, _SMALL).to_pylist()]
                yield from pa.Table.from_pylist(out, arrow).to_batches()

    return rows.mapInArrow(run, schema)


def _read(r: dict, limits: Limits) -> dict:
    """The raw row of a message. One of which only the header could be fetched is told by it, and fails."""
    row = mime.raw_mail(r["content"] or b"", limits)
    if r.get("whole") is False:
        row |= {"ingest_failed": True, "content_hash": None, "mime_bytes": b""}
    return row


#: What a source may say of a message beside its content: its number in a mailbox.
SOURCE = {"uid": "BIGINT"}


def _given(files: DataFrame) -> tuple[DataFrame, list[str]]:
    carried = [c for c in SOURCE if c in files.columns]
    return files.select("content", *(c for c in ("whole",) if c in files.columns), *(F.col(c).cast("long").alias(c) for c in carried)), carried


def raw(files: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """``files(content)`` to raw rows; one that can't be read is a row with ``ingest_failed``, and so is one that is not ``whole``.

    The column ``uid`` of a mailbox stays.
    """
    given, carried = _given(files)
    return _mapped(given, lambda r: _read(r, limits) | {c: r[c] for c in carried}, ", ".join([schemas.RAW_MAIL, *(f"{c} {SOURCE[c]}" for c in carried)]))


#: Raw columns that go on beside the sanitized ones, and what tells rows of one pass apart.
_HEAD = ("dedupe_key", "content_hash", "subject_raw")


def opened(files: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """``files(content)`` read and sanitized in one pass, without any binary: sanitized columns and ``error`` in ``safe``, what claims need beside it.

    ``rid`` numbers the rows; it is fixed once the result is written.
    """
    given, carried = _given(files)
    kinds = T.StructType.fromDDL(schemas.SANITIZED_MAIL + ", error STRING").simpleString()

    def one(r: dict) -> dict:
        row = _read(r, limits)
        return {c: row[c] for c in _HEAD} | {"arrived": row["date"], "safe": _sanitized(row, limits)} | {c: r[c] for c in carried}

    columns = ["dedupe_key STRING", "content_hash STRING", "subject_raw STRING", "arrived TIMESTAMP", f"safe {kinds}", *(f"{c} {SOURCE[c]}" for c in carried)]
    return _mapped(given, one, ", ".join(columns)).withColumn("rid", F.monotonically_increasing_id())


def parts(files: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """The MIME parts of each message, without their content: (path, part_no, depth, ctype, disposition, filename, role, size)."""
    ddl = "path STRING, parts ARRAY<STRUCT<part_no: INT, depth: INT, ctype: STRING, disposition: STRING, filename: STRING, role: STRING, size: BIGINT>>"

    def one(r: dict) -> dict:
        found, _, _ = mime.parts_of(r["content"] or b"", limits)
        return {"path": r["path"], "parts": [{"part_no": p.part_no, "depth": p.depth, "ctype": p.ctype, "disposition": p.disposition, "filename": p.filename, "role": p.role, "size": len(p.data)} for p in found]}

    return _mapped(files.select("path", "content"), one, ddl).select("path", F.explode("parts").alias("p")).select("path", "p.*")


def _sanitized(r: dict, limits: Limits) -> dict:
    """The sanitized row of a raw one; where an error is set the content columns are empty."""
    blank = {"from_display": "", "subject": "", "body_text": "", "attachment_texts": [], "attachments": [], "links_found": [], "report": None}
    base = {"dedupe_key": r["dedupe_key"], "from_domain": r["from_domain"], "date": r["date"], "date_offset_min": r["date_offset_min"]}
    if r["ingest_failed"]:
        return {**base, **blank, "error": "ingest_error"}
    try:
        out = mime.sanitize(r, limits)
    except Exception:  # noqa: BLE001  fail closed, one mail at a time
        return {**base, **blank, "error": "sanitize_error"}
    out["report"] = {**out["report"], "auth_results": list(out["report"]["auth_results"].items())}
    return {**out, "error": None}


def sanitized(raw_rows: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Raw rows to sanitized ones with (stage, error); where an error is set the content columns are empty."""
    return _mapped(raw_rows, lambda r: _sanitized(r, limits), schemas.SANITIZED_MAIL + ", error STRING")


def links(sanitized_rows: DataFrame) -> DataFrame:
    """The fact table of listed links: (dedupe_key, link_no, defanged)."""
    entry = F.explode("links_found").alias("entry")
    return sanitized_rows.select("dedupe_key", entry).select("dedupe_key", F.regexp_extract("entry", r"^#(\d+): ", 1).cast("int").alias("link_no"), F.regexp_replace("entry", r"^#\d+: ", "").alias("defanged"))


def without_body(attachments: Column) -> Column:
    """What is said of a mail that has no text."""
    blocked = F.filter(attachments, lambda a: ~a["processed"])
    names = F.array_join(F.transform(F.slice(blocked, 1, 5), lambda a: a["filename_sanitized"]), ", ")
    return F.when(F.size(blocked) > 0, F.concat(F.lit("The mail has no text. Unprocessed attachments: "), names)).otherwise("The mail has no text.")


def offline_summary(sanitized_rows: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """A summary without any model: the beginning of the text, always of normal importance."""
    # a column of its own, or each of its uses would go through the whole text again
    sanitized_rows = sanitized_rows.withColumn("line", X.one_line(F.col("body_text")))
    body = F.col("line")
    excerpt = F.when(body == "", without_body(F.col("attachments"))).otherwise(X.clamp(body, limits.excerpt_chars))
    files = F.filter(F.col("attachment_texts"), lambda a: F.trim(a["text"]) != "")
    summaries = F.transform(files, lambda a: F.struct(a["name"].alias("name"), F.concat(F.lit("Excerpt: "), X.clamp(X.one_line(a["text"]), limits.excerpt_chars - 9)).alias("text")))
    evidence = policy.evidence(body, F.col("report.control_chars_removed"), F.col("report.forged_markers"), X.has_orders(F.concat_ws(" ", "subject", "from_display", "body_text")), limits)
    return sanitized_rows.withColumn(
        "summary",
        F.struct(
            X.clamp(F.when(F.col("subject") == "", "Mail without subject").otherwise(F.col("subject")), limits.headline_chars).alias("headline"),
            F.concat(F.lit(NOTE + " "), excerpt).alias("summary_text"),
            F.lit("normal").alias("importance"),
            F.lit("no language model configured — not assessed").alias("importance_reason"),
            F.lit("unclassified").alias("category"),
            summaries.alias("attachment_summaries"),
            (F.size(evidence) > 0).alias("injection_suspected"),
        ),
    ).drop("line")


def offline_verdict(rows: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """What the code alone knows about the risk."""
    kinds = F.array_sort(F.array_distinct(F.transform(F.filter("attachments", lambda a: ~a["processed"]), lambda a: a["declared_mime"])))
    facts = rows.withColumn("signals", policy.signals(F.col("report"), kinds))
    none = F.array().cast("array<string>")
    v = policy.verdict(F.lit("none"), none, F.lit(False), F.col("signals"), limits)
    return facts.withColumn("v", v).withColumn("verdict", F.struct(F.col("v.risk").alias("phishing_risk"), F.col("v.reasons").alias("risk_reasons"), F.lit(True).alias("summary_accurate"), F.lit("").alias("notes"))).drop("v")


def routed(rows: DataFrame, threshold: str = "normal") -> DataFrame:
    r = policy.route(F.col("verdict.phishing_risk"), F.col("summary.importance"), F.col("verdict.summary_accurate"), F.col("error").isNotNull(), threshold)
    return rows.withColumn("r", r).withColumn("status", F.coalesce(F.col("r.status"), F.lit("failed"))).drop("r")


def composed(rows: DataFrame, sink: str = "telegram", with_footnote: bool = False) -> DataFrame:
    """(dedupe_key, status, importance, is_warning, parts): messages of what is delivered, notices of what failed."""
    limit = PART_CHARS.get(sink, min(PART_CHARS.values()))

    def one(r: dict) -> dict:
        if r["status"] == "failed":
            parts_ = C.compose_failure(r["from_domain"] or "", r["subject"] or "", "sanitize", r["error"] or "unknown", limit)
            return {"dedupe_key": r["dedupe_key"], "status": "failed", "importance": "normal", "is_warning": False, "parts": parts_}
        if r["status"] == "queued_low":
            return {"dedupe_key": r["dedupe_key"], "status": "queued_low", "importance": "low", "is_warning": False, "parts": []}
        return {"dedupe_key": r["dedupe_key"], "status": "delivered", "importance": r["summary"]["importance"], "is_warning": r["verdict"]["phishing_risk"] == "high", "parts": C.compose(r, r["summary"], r["verdict"], limit, with_footnote)}

    return _mapped(rows.drop("signals", "body_text", "attachment_texts"), one, "dedupe_key STRING, status STRING, importance STRING, is_warning BOOLEAN, parts ARRAY<STRING>")


#: Numbers of claimed rows that are broadcast at most: 8 bytes and a key each.
FEW = 1_000_000


def _first(arrived: DataFrame, at: str, seen: DataFrame | None) -> DataFrame:
    """(rid, final_key, collides) of the messages that are new, once each. Only their keys travel."""
    narrow = arrived.select("rid", "dedupe_key", "content_hash", F.struct(at, "content_hash", "subject_raw", "rid").alias("arrival"))
    new = settled(claim_with_rekey(narrow, "dedupe_key", "content_hash", "arrival", seen).where("result = 'CLAIMED'").select("rid", "final_key", F.col("id_collision").alias("collides")))
    return F.broadcast(new) if new.count() <= FEW else new


def claimed(files: DataFrame, seen: DataFrame | None = None, limits: Limits = LIMITS) -> DataFrame:
    """Raw rows of the messages that are new, once each; ``seen(key_hash, content_hash)`` are those of earlier runs."""
    read = raw(files, limits)
    rows = settled(read.withColumn("rid", F.monotonically_increasing_id()))  # a message is parsed once, however often the claims look at it
    columns = [F.col("final_key").alias(c) if c == "dedupe_key" else F.col("collides").alias(c) if c == "id_collision" else F.col(c) for c in read.columns]
    return rows.join(_first(rows, "date", seen), "rid").select(columns)


def first_ones(arrived: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Sanitized rows, with content_hash, of those messages of ``opened`` (settled before) that are new, once each."""
    new = arrived.join(_first(arrived, "arrived", seen), "rid")
    columns = [c for c in arrived.schema["safe"].dataType.names if c not in ("dedupe_key", "report")]
    report = F.col("safe.report").withField("id_collision", F.col("collides"))
    return new.select(F.col("final_key").alias("dedupe_key"), *(F.col(f"safe.{c}").alias(c) for c in columns), report.alias("report"), "content_hash")


def judged_safe(rows: DataFrame, threshold: str = "normal", limits: Limits = LIMITS) -> DataFrame:
    """Sanitized rows with summary, verdict and status."""
    return routed(offline_verdict(offline_summary(rows, limits), limits), threshold)


def judged(raw_rows: DataFrame, threshold: str = "normal", limits: Limits = LIMITS) -> DataFrame:
    """Raw rows to sanitized ones with summary, verdict and status."""
    return judged_safe(sanitized(raw_rows, limits), threshold, limits)


def run(files: DataFrame, threshold: str = "normal", sink: str = "telegram", limits: Limits = LIMITS) -> DataFrame:
    """All stages over ``files(content)``: read and sanitize, claim each message once, summarise, judge, route, compose."""
    return composed(judged_safe(first_ones(settled(opened(files, limits))), threshold, limits), sink)


def report_columns() -> list[Column]:
    """The aggregates of a run's report, without any content: what each stage took out, and how the mails were judged."""
    fine = F.col("error").isNull()
    total = lambda c: F.coalesce(F.sum(F.when(fine, c)), F.lit(0)).cast("long")
    is_ = lambda c, v: F.count_if(fine & (F.col(c) == v))
    return [
        F.count("*").alias("mails"),
        F.count_if(~fine).alias("failed"),
        total(F.length("body_text")).alias("characters"),
        total(F.size("attachments")).alias("attachments"),
        total(F.size(F.filter("attachments", lambda a: a["processed"]))).alias("processed"),
        total(F.col("report.links_removed")).alias("links_removed"),
        total(F.col("report.control_chars_removed")).alias("controls_removed"),
        F.count_if(fine & F.col("summary.injection_suspected")).alias("injection_suspected"),
        *(is_("summary.importance", v).alias(f"importance_{v}") for v in policy.IMPORTANCE),
        *(is_("verdict.phishing_risk", v).alias(f"risk_{v}") for v in policy.RISKS),
        F.count_if(fine & ~F.col("verdict.summary_accurate")).alias("inaccurate"),
    ]


def stage_report(judged_rows: DataFrame) -> DataFrame:
    """One row of counts for a run; ``metrics.counted`` gives the same without a job of its own."""
    return judged_rows.agg(*report_columns())
