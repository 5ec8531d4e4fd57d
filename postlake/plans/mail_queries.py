"""Operators whose rules are kernels. Where SQL can say what they give for these tables it stands beside them; the rest is checked by tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables, udfs
from ..kernels.attachments import CONTROL, NAME_CHARS, SIGNATURES, SUFFIX_CHARS, WINDOW
from ..operators import mail
from ..sources.tables import table
from .registry import query
from .url_queries import _FANG, HOST_SQL


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw message for each document, with a page's HTML beside the text of some.

    Documents are dealt out by their ids: what is done to a message costs far more than to move it, and files may have few row groups.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").repartition("doc_id")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html", "url")
    rows = docs.join(pages, "doc_id", "left")
    k = F.col("doc_id")
    head = F.concat(
        F.lit("Message-ID: <"), F.when(k % 10 == 9, (k - 1).cast("string")).otherwise(k.cast("string")), F.lit("@mail.example>\r\nFrom: Sender "), k.cast("string"), F.lit(" <a@"), F.col("source"), F.lit(".example>\r\n"),
        F.when(k % 7 == 0, F.lit("Reply-To: b@other.example\r\n")).otherwise(""), F.when(k % 5 == 0, F.lit("Return-Path: <c@xn--pypal-4ve.com>\r\nAuthentication-Results: mx; spf=fail dkim=pass\r\n")).otherwise(""),
        F.lit("To: me@home.example\r\nSubject: Report "), k.cast("string"), F.lit(" http://promo.example/x\r\nDate: Mon, 15 Jan 2024 10:00:00 +0100\r\nMIME-Version: 1.0\r\n"),
    )
    plain = F.concat(F.lit("Content-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\n"), F.col("text"), F.lit(" see hxxps://login(.)example/a\r\n"))
    html = F.concat(F.lit("Content-Type: text/html; charset=utf-8\r\n\r\n"), F.col("html"), F.lit("\r\n"))
    mixed = F.concat(F.lit("Content-Type: multipart/alternative; boundary=\"zz\"\r\n\r\n--zz\r\n"), plain, F.lit("--zz\r\n"), html, F.lit("--zz--\r\n"))
    body = F.when(F.col("html").isNull(), plain).when(k % 2 == 0, html).otherwise(mixed)
    return rows.select(F.concat(F.lit("/mail/"), k.cast("string"), F.lit(".eml")).alias("path"), F.concat(head, body).cast("binary").alias("content"))


def _rewritten(pattern: str, new: str, text: str = "text") -> str:
    """SQL of a text in which each match ``x`` of ``pattern`` becomes ``new``."""
    found, rest = f"regexp_extract_all({text}, '{pattern}')", f"regexp_split_to_array({text}, '{pattern}')"
    return f"array_to_string(list_transform(range(1, len({rest}) + 1), lambda i: {rest}[i] || coalesce(list_transform({found}, lambda x: {new})[i], '')), '')"


#: Names and rows of numbers: dots go where a label but the first begins with two letters, or where four short numbers stand in a row.
_DOTTED = "[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+"
_BROKEN = "CASE WHEN regexp_matches(x, '[.][A-Za-z][A-Za-z]') OR regexp_matches(x, '^[0-9]{1,3}([.][0-9]{1,3}){3,}$') THEN replace(x, '.', '[.]') ELSE x END"
_GUARDED = f"g AS (SELECT doc_id, {_rewritten(_DOTTED, _BROKEN, "coalesce(text, '')")} AS t FROM documents)"
#: Words that hold a link in any of these forms go whole.
_LINKISH = r"(?i)(?:[a-z][a-z0-9+.-]{0,15}://|h[^\w]{0,2}x[^\w]{0,2}x[^\w]{0,2}p|\bwww\s*[.]|\bmailto\s*:|\btel\s*:|[(]\s*[.]\s*[)]|\[\s*[.]\s*\]|[(]\s*dot\s*[)]|[A-Za-z0-9-]{1,63}\s*[.]\s*[A-Za-z]{2,24}\s*/)"


def _redacted(text: str) -> str:
    for pattern in (r"!?\[[^\]\n]{0,200}\][(][^)\n]{0,500}[)]", r"</?[A-Za-z][^>\n]{0,200}>", r"&#x?[0-9A-Fa-f]{1,8};?", rf"\S*?{_LINKISH}\S*"):
        text = f"regexp_replace({text}, '{pattern}', '[entfernt]', 'g')"
    return text


@query()
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", udfs.html_to_text("html").alias("h"))
    return rows.select("page_id", F.length("h.text").alias("n_chars"), F.sha2("h.text", 256).alias("text_sha256"), "h.hidden", "h.rejected")


#: A path ends where a bracket begins, so a disguised one ends at its first dot.
_PLAIN_AGAIN = r"CASE link_no WHEN 1 THEN url ELSE regexp_replace(lower(url), '^([a-z]+://[^/?#]*[^.]*).*$', '\1') END"


@query(f"""
WITH l AS (SELECT page_id, unnest([1, 2]) AS link_no, url FROM pages)
SELECT page_id, CAST(link_no AS INTEGER) AS link_no, 'Link' AS kind, {HOST_SQL} AS host, {_FANG.format(_PLAIN_AGAIN)} AS defanged,
  false AS is_punycode, CAST(NULL AS VARCHAR) AS unicode_host, false AS is_mixed_script, false AS capped FROM l""")
def links_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", udfs.scrub_links(F.concat(F.lit("see "), "url", F.lit(". Or "), F.replace("url", F.lit("."), F.lit("(dot)")))).alias("s"))
    return rows.select("page_id", F.explode("s.links").alias("l")).select("page_id", "l.*")


@query("SELECT doc_id, sha256('fi' || nfc_normalize(text)) AS text_sha256, CAST(1 AS BIGINT) AS removed FROM documents")
def clean_text_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", udfs.clean_text(F.concat(F.lit("ﬁ​"), "text")).alias("c"))
    return rows.select("doc_id", F.sha2("c.text", 256).alias("text_sha256"), "c.removed")


@query(f"WITH {_GUARDED} SELECT doc_id, sha256(t) AS guarded_sha256 FROM g")
def final_guard_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(udfs.final_guard("text"), 256).alias("guarded_sha256"))


@query(f"""
WITH RECURSIVE {_GUARDED},
lines AS (SELECT doc_id, unnest(range(1, len(string_split(trim(t), chr(10))) + 1)) AS line, unnest(string_split(trim(t), chr(10))) AS said FROM g),
cuts AS (
  SELECT doc_id, line, 0 AS k, CAST(NULL AS VARCHAR) AS piece, said AS rest, '' AS lead FROM lines
  UNION ALL
  SELECT doc_id, line, k + 1, lead || CASE WHEN whole THEN rest ELSE rtrim(left(rest, stop)) END, CASE WHEN whole OR ltrim(substr(rest, stop + 1)) = '' THEN NULL ELSE ltrim(substr(rest, stop + 1)) END, '… '
  FROM (SELECT *, length(rest) <= room AS whole, CASE WHEN strpos(reverse(left(rest, room)), ' ') > 0 AND room - strpos(reverse(left(rest, room)), ' ') >= room // 2 THEN room - strpos(reverse(left(rest, room)), ' ') ELSE room END AS stop
        FROM (SELECT *, 2000 - length(lead) AS room FROM cuts WHERE rest IS NOT NULL) AS r) AS s),
pieces AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line, k) AS n, piece FROM cuts WHERE k > 0),
packed AS (
  SELECT doc_id, n, piece, 0 AS part_no, length(piece) AS used FROM pieces WHERE n = 1
  UNION ALL
  SELECT p.doc_id, p.n, p.piece, CASE WHEN used + 1 + length(p.piece) <= 2000 THEN part_no ELSE part_no + 1 END, CASE WHEN used + 1 + length(p.piece) <= 2000 THEN used + 1 + length(p.piece) ELSE length(p.piece) END
  FROM packed AS b JOIN pieces AS p ON p.doc_id = b.doc_id AND p.n = b.n + 1),
parts AS (SELECT doc_id, part_no, string_agg(piece, chr(10) ORDER BY n) AS part FROM packed GROUP BY doc_id, part_no)
SELECT doc_id, part_no, CAST(length(part) AS INTEGER) AS n_chars, sha256(part) AS part_sha256 FROM parts""")
def split_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(udfs.split_parts("text", F.lit(2000))).alias("part_no", "part"))
    return rows.select("doc_id", "part_no", F.length("part").alias("n_chars"), F.sha2("part", 256).alias("part_sha256"))


@query(f"WITH s AS (SELECT doc_id, coalesce(text, '') AS before, {_redacted("coalesce(text, '')")} AS t FROM documents) SELECT doc_id, sha256(trim(t)) AS text_sha256, t <> before AS suspicious FROM s")
def scrub_model_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", udfs.scrub_model_text("text").alias("s"))
    return rows.select("doc_id", F.sha2("s.text", 256).alias("text_sha256"), "s.suspicious")


_REPLY = """concat(text, CASE doc_id % 6 WHEN 0 THEN ' at [home](http://a.example/b c) now' WHEN 1 THEN ' go to hxxps://x.example/y now' WHEN 2 THEN ' or (evil (.) example) too'
  WHEN 3 THEN ' <b class=x>bold</b> &#x41; end' WHEN 4 THEN ' call tel:112, www.x and evil.com/x!' ELSE ' plain 1.2 end' END)"""


@query(f"WITH r AS (SELECT doc_id, coalesce({_REPLY}, '') AS before FROM documents), s AS (SELECT *, {_redacted('before')} AS t FROM r) SELECT doc_id, sha256(trim(t)) AS text_sha256, t <> before AS suspicious FROM s")
def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as replies that end in links, marks and entities of several forms."""
    rows = table(spark, sf_dir, "documents").select("doc_id", udfs.scrub_model_text(F.expr(_REPLY)).alias("s"))
    return rows.select("doc_id", F.sha2("s.text", 256).alias("text_sha256"), "s.suspicious")


@query(r'''SELECT doc_id, '{"headline":' || to_json(text) || ',"importance":"high"}' AS json FROM documents''')
def extract_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("text").isNotNull(), F.to_json(F.struct(F.col("text").alias("headline"), F.lit("high").alias("importance"))))
    reply = F.concat(F.lit("Sure:\n```json\n"), said, F.lit("\n```"))
    return table(spark, sf_dir, "documents").select("doc_id", udfs.extract_json(reply).alias("json"))


@query()
def raw_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail.raw(messages(spark, sf_dir)).drop("mime_bytes", "reply_to_addresses", "to_addrs", "date")


#: The leaves that ``messages`` gives each mail, with their bytes.
_PARTS = """
m AS (SELECT '/mail/' || d.doc_id || '.eml' AS path, d.doc_id AS k, octet_length(encode(d.text)) AS plain, octet_length(encode(p.html)) AS html FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id),
parts AS (
  SELECT path, 1 AS part_no, 0 AS depth, 'text/plain' AS ctype, 'plain' AS role, plain + 32 AS size FROM m WHERE html IS NULL
  UNION ALL SELECT path, 1, 0, 'text/html', 'html', html + 2 FROM m WHERE html IS NOT NULL AND k % 2 = 0
  UNION ALL SELECT path, 2, 1, 'text/plain', 'plain', plain + 30 FROM m WHERE html IS NOT NULL AND k % 2 <> 0
  UNION ALL SELECT path, 3, 1, 'text/html', 'html', html FROM m WHERE html IS NOT NULL AND k % 2 <> 0)"""
_ALL_PARTS = f"""WITH {_PARTS}
SELECT path, CAST(part_no AS INTEGER) AS part_no, CAST(depth AS INTEGER) AS depth, ctype, CAST(NULL AS VARCHAR) AS disposition, CAST(NULL AS VARCHAR) AS filename, role, CAST(size AS BIGINT) AS size FROM parts"""


@query(_ALL_PARTS)
def mail_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail.parts(messages(spark, sf_dir))


@query(_ALL_PARTS)
def mail_parts_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a table function in SQL, beside each message's row."""
    tables.register(spark)
    messages(spark, sf_dir).createOrReplaceTempView("mail_messages")
    return spark.sql("SELECT m.path, p.* FROM mail_messages m, LATERAL mail_parts(m.content) p")


@query("""
WITH a AS (SELECT source || '/' || (doc_id % 50) AS key, lang AS content, doc_id AS arrival FROM documents),
f AS (SELECT key, arg_min(content, arrival) AS first, min(arrival) AS at FROM a GROUP BY key)
SELECT sha256(a.key) AS key_hash, a.arrival, CASE WHEN a.arrival = f.at THEN 'CLAIMED' WHEN a.content = f.first THEN 'DUPLICATE' ELSE 'COLLISION' END AS result
FROM a JOIN f USING (key)""")
def claims_by_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents claim a key of fifty for each source; the function asks for its rows by key and in order."""
    tables.register(spark)
    rows = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id") % 50).alias("key"), F.col("lang").alias("content"), F.col("doc_id").alias("arrival"))
    rows.createOrReplaceTempView("mail_arrivals")
    return spark.sql("SELECT * FROM claim_arrivals(TABLE(mail_arrivals))")


@query()
def sanitized_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mail.sanitized(mail.raw(messages(spark, sf_dir)))
    report = ("links_removed", "control_chars_removed", "truncated", "html_divergent", "reply_to_mismatch", "return_path_mismatch")
    return rows.select("dedupe_key", "from_display", "subject", F.sha2("body_text", 256).alias("body_sha256"), *(F.col(f"report.{c}").alias(c) for c in report), "error")


@query("""
WITH m AS (SELECT doc_id AS k, CAST(doc_id AS VARCHAR) AS n, CAST(doc_id - CASE WHEN doc_id % 10 = 9 THEN 1 ELSE 0 END AS VARCHAR) AS id, source FROM documents)
SELECT '<' || id || '@mail.example>' AS dedupe_key, 'Sender ' || n AS from_display, source || '.example' AS from_domain, 'Report ' || n || ' [Link #: promo.example]' AS subject,
  k % 7 = 0 AS reply_to_mismatch, k % 5 = 0 AS return_path_mismatch, CASE WHEN k % 5 = 0 THEN 'dkim=pass,spf=fail' ELSE '' END AS checked, CAST(NULL AS VARCHAR) AS error FROM m""")
def sanitized_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the headers say once they are safe; the number of the subject's link, which counts those of the text, is left out."""
    rows = mail.sanitized(mail.raw(messages(spark, sf_dir)))
    checked = F.array_join(F.transform(F.array_sort(F.map_entries("report.auth_results")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    report = ("reply_to_mismatch", "return_path_mismatch")
    return rows.select("dedupe_key", "from_display", "from_domain", F.regexp_replace("subject", r"#\d+", "#").alias("subject"), *(F.col(f"report.{c}").alias(c) for c in report), checked.alias("checked"), "error")


@query()
def mail_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mail.run(messages(spark, sf_dir))
    return rows.select("dedupe_key", "status", "importance", "is_warning", F.size("parts").alias("n_parts"), F.sha2(F.array_join("parts", "\n"), 256).alias("parts_sha256"))


#: How the attachments of ``attachment_kinds`` begin, and the types they are declared as, by doc_id in turn.
OPENINGS = ("", "%PDF-1.7 ", "MZ", "GIF89a", "{\\rtf1 ", "#!/bin/sh ", "\x07\x08", "SQLite")
DECLARED = ("text/plain", " Text/HTML ; charset=utf-8", "application/pdf", "application/zip", "")


def _turns(values: tuple[str, ...], key: str) -> str:
    """SQL, for both engines, of the value whose turn it is."""
    chosen = " ".join(f"WHEN {i} THEN {_literal(v)}" for i, v in enumerate(values))
    return f"CASE abs({key}) % {len(values)} {chosen} END"


def _literal(value: str) -> str:
    return "concat(''" + "".join(f", chr({ord(c)})" for c in value) + ")"


_CONTROLS = ", ".join(f"'{b:02X}'" for b in CONTROL)
_STARTS = " OR ".join(f"starts_with(data, '{start.hex().upper()}')" for start, _ in SIGNATURES)


@query(f"""
WITH a AS (
  SELECT doc_id, {_turns(DECLARED, "doc_id // 8")} AS declared, hex(encode({_turns(OPENINGS, "doc_id")} || coalesce(text, ''))) AS data FROM documents),
b AS (
  SELECT doc_id, lower(trim(split_part(declared, ';', 1))) AS declared, data, regexp_extract_all(left(data, {2 * WINDOW}), '..') AS head FROM a),
c AS (
  SELECT *, len(list_filter(head, lambda x: x IN ({_CONTROLS}))) AS odd, len(list_filter(head, lambda x: x = '00')) AS nul FROM b)
SELECT doc_id, CASE
  WHEN declared NOT IN ('application/pdf', 'text/plain', 'text/html') THEN 'unknown'
  WHEN declared = 'application/pdf' THEN CASE WHEN starts_with(data, '255044462D') THEN 'pdf' ELSE 'mismatch' END
  WHEN ({_STARTS}) OR nul > 0 OR 20 * odd >= greatest(len(head), 1) THEN 'mismatch'
  WHEN declared = 'text/plain' THEN 'text' ELSE 'html' END AS kind
FROM c""")
def attachment_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as attachments of several declared types and true beginnings."""
    data = F.encode(F.concat(F.expr(_turns(OPENINGS, "doc_id")), F.coalesce("text", F.lit(""))), "utf-8")
    return table(spark, sf_dir, "documents").select("doc_id", udfs.detect_kind(F.expr(_turns(DECLARED, "(doc_id div 8)")), data).alias("kind"))


@query(f"""
WITH n AS (
  SELECT page_id, unnest([url, replace(repeat(url, 4), '/', ' - ') || '.tar.gz', '..' || chr(92) || url || chr(92) || '._ ']) AS name, unnest([1, 2, 3]) AS form FROM pages),
k AS (
  SELECT page_id, form, trim(regexp_replace(regexp_replace(regexp_extract(replace(name, chr(92), '/'), '[^/]*$'), '[^A-Za-z0-9._ -]', '_', 'g'), ' +', ' ', 'g'), '._ ') AS kept FROM n),
s AS (
  SELECT *, CASE WHEN regexp_matches(kept, '.[.][^.]{{1,{SUFFIX_CHARS}}}$') THEN regexp_extract(kept, '[.][^.]{{1,{SUFFIX_CHARS}}}$') ELSE '' END AS suffix FROM k),
r AS (SELECT *, {NAME_CHARS} - 3 - length(suffix) AS room FROM s)
SELECT page_id, form, CASE WHEN kept = '' OR kept IS NULL THEN 'unbenannt' WHEN length(kept) <= {NAME_CHARS} THEN kept
  ELSE left(kept, room - room // 2) || '…' || right(left(kept, length(kept) - length(suffix)), room // 2) || suffix END AS name
FROM r""")
def attachment_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names that addresses make: as they are, long ones with a suffix, and such as end in a folder."""
    long = F.concat(F.replace(F.repeat("url", 4), F.lit("/"), F.lit(" - ")), F.lit(".tar.gz"))
    folder = F.concat(F.lit("..\\"), "url", F.lit("\\._ "))
    names = F.posexplode(F.array("url", long, folder)).alias("at", "name")
    return table(spark, sf_dir, "pages").select("page_id", names).select("page_id", (F.col("at") + 1).alias("form"), udfs.sanitize_filename("name").alias("name"))


@query("""
WITH m AS (
  SELECT d.doc_id AS k, coalesce(d.source, '') AS source,
    'Message-ID: <' || CAST(CASE WHEN d.doc_id % 10 = 9 THEN d.doc_id - 1 ELSE d.doc_id END AS VARCHAR) || '@mail.example>' || chr(13) || chr(10)
    || 'From: Sender ' || CAST(d.doc_id AS VARCHAR) || ' <a@' || d.source || '.example>' || chr(13) || chr(10)
    || CASE WHEN d.doc_id % 7 = 0 THEN 'Reply-To: b@other.example' || chr(13) || chr(10) ELSE '' END
    || CASE WHEN d.doc_id % 5 = 0 THEN 'Return-Path: <c@xn--pypal-4ve.com>' || chr(13) || chr(10) || 'Authentication-Results: mx; spf=fail dkim=pass' || chr(13) || chr(10) ELSE '' END
    || 'To: me@home.example' || chr(13) || chr(10) || 'Subject: Report ' || CAST(d.doc_id AS VARCHAR) || ' http://promo.example/x' || chr(13) || chr(10)
    || 'Date: Mon, 15 Jan 2024 10:00:00 +0100' || chr(13) || chr(10) || 'MIME-Version: 1.0' || chr(13) || chr(10) AS head,
    'Content-Type: text/plain; charset=utf-8' || chr(13) || chr(10) || 'Content-Transfer-Encoding: 8bit' || chr(13) || chr(10) || chr(13) || chr(10)
    || d.text || ' see hxxps://login(.)example/a' || chr(13) || chr(10) AS plain,
    'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || chr(13) || chr(10) || p.html || chr(13) || chr(10) AS html
  FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id),
w AS (
  SELECT k, source, head || CASE WHEN html IS NULL THEN plain WHEN k % 2 = 0 THEN html
    ELSE 'Content-Type: multipart/alternative; boundary="zz"' || chr(13) || chr(10) || chr(13) || chr(10) || '--zz' || chr(13) || chr(10) || plain || '--zz' || chr(13) || chr(10) || html || '--zz--' || chr(13) || chr(10) END AS content
  FROM m)
SELECT '<' || CAST(CASE WHEN k % 10 = 9 THEN k - 1 ELSE k END AS VARCHAR) || '@mail.example>' AS message_id, 'Sender ' || CAST(k AS VARCHAR) || ' <a@' || source || '.example>' AS from_addr,
  source || '.example' AS from_domain, 'a@' || source || '.example' AS from_address, CASE WHEN k % 7 = 0 THEN 'b@other.example' END AS reply_to_address,
  CASE WHEN k % 5 = 0 THEN 'xn--pypal-4ve.com' END AS return_path_domain, CASE WHEN k % 5 = 0 THEN 'mx; spf=fail dkim=pass' END AS auth_results_header,
  'Report ' || CAST(k AS VARCHAR) || ' http://promo.example/x' AS subject_raw, 60 AS date_offset_min, 'me@home.example' AS sent_to,
  CAST(octet_length(encode(content)) AS BIGINT) AS size_bytes, sha256(content) AS content_hash
FROM w""")
def raw_mail_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the headers of the raw rows say, with size and hash of the whole message."""
    columns = ("message_id", "from_addr", "from_domain", "from_address", "reply_to_address", "return_path_domain", "auth_results_header", "subject_raw", "date_offset_min")
    return mail.raw(messages(spark, sf_dir)).select(*columns, F.array_join("to_addrs", ",").alias("sent_to"), F.col("size_bytes").cast("long").alias("size_bytes"), "content_hash")
