"""Raw messages: headers to a row, the MIME tree to parts, and the whole mail to safe text."""

from __future__ import annotations

import email
import email.parser
import email.policy
import hashlib
import re
import time
from dataclasses import dataclass, field
from email.header import decode_header
from email.headerregistry import HeaderRegistry
from email.message import Message
from email.utils import getaddresses, parsedate_to_datetime

from ..limits import LIMITS, Limits
from . import pdf
from .attachments import detect_kind, sanitize_filename
from .html import TooComplex, html_to_text
from .links import Links
from .text import clean_text, header_text, neutralize_markers, one_line, strip_tag_like, unescape

UNREADABLE, UNKNOWN_SENDER, TRUNCATED = "(unreadable)", "(unknown sender)", "[truncated]"
#: Names of entries that stand for what was not looked at, and types that mean encryption.
TOO_MANY, TOO_DEEP = "(mime-teile ueberschritten)", "(mime-tiefe ueberschritten)"
ENCRYPTED = frozenset({"multipart/encrypted", "application/pgp-encrypted", "application/pkcs7-mime", "application/x-pkcs7-mime"})
_HOST = re.compile(r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)*")
_AUTH = re.compile(r"\b(spf|dkim|dmarc)\s*=\s*([A-Za-z0-9._-]{1,32})")
_NOISE = re.compile(r"\[(?:Link|Mail|Tel|Bild)\b[^\]]*\]")
_WORDS = re.compile(r"[0-9a-zà-öø-ÿ]{3,}")
_registry = HeaderRegistry()


def header_values(msg: Message, name: str, limits: Limits = LIMITS) -> list[str]:
    """All values of a header, each on one line; bytes beyond ASCII read as UTF-8 or Latin-1."""
    out = []
    for value in (msg.get_all(name) or [])[: limits.header_values]:
        raw = str(value)[: limits.header_chars]
        data = raw.encode("utf-8", "surrogateescape")
        try:
            out.append(one_line(data.decode("utf-8")))
        except UnicodeDecodeError:
            out.append(one_line(data.decode("latin-1")))
    return out


def decode_words(value: str) -> str:
    """RFC 2047 words decoded; a value that can't be stays as it is."""
    try:
        return "".join(p.decode(c or "latin-1", "replace") if isinstance(p, bytes) else p for p, c in decode_header(value))
    except (LookupError, ValueError):
        return value


def domain_of(address: str) -> str:
    """The host of the first address that has one, else empty."""
    try:
        found = getaddresses([one_line(address)])
    except (RecursionError, ValueError):
        return ""
    for _, spec in found:
        local, at, host = spec.rpartition("@")
        host = host.strip().strip("<>[]").rstrip(".").lower()
        if local and at and _HOST.fullmatch(host):
            return host
    return ""


def parse_addresses(raw: str, limits: Limits = LIMITS) -> tuple[str, str, str, list[str]]:
    """Display form, address and host of the first entry, and the addresses of all; an unusable one is empty."""
    if not raw:
        return "", "", "", []
    if len(raw) >= limits.header_chars:
        return UNREADABLE, "", "", []
    try:
        entries = _registry("To", raw).addresses
    except (ValueError, IndexError, AttributeError, TypeError, RecursionError):
        return UNREADABLE, "", "", []
    usable = [e for e in entries if e.domain][: limits.recipients]
    specs = [e.addr_spec if _HOST.fullmatch(e.domain.lower()) else "" for e in usable]
    if not usable:
        return one_line(raw), "", "", []
    first = usable[0]
    name = one_line(decode_words(first.display_name))
    shown = f"{name} <{specs[0]}>" if name and specs[0] else name or specs[0] or one_line(raw)
    return shown, specs[0], first.domain.lower() if specs[0] else "", specs


def parse_auth(header: str | None) -> dict[str, str]:
    """The first result of each check."""
    out: dict[str, str] = {}
    for check, result in _AUTH.findall(header or ""):
        out.setdefault(check.lower(), result.lower())
    return out


def fallback_key(sender: str, date: str, subject: str, body: str) -> str:
    """The key of a mail without Message-ID: a hash of what it says."""
    return "sha256:" + hashlib.sha256("".join(f"{x}\0" for x in (sender, date, subject, body[:512])).encode("utf-8", "replace")).hexdigest()


def content_type(part: Message) -> str:
    try:
        return part.get_content_type()
    except Exception:  # noqa: BLE001  a broken header must not cost the mail
        return "application/octet-stream"


def payload(part: Message) -> bytes:
    try:
        data = part.get_payload(decode=True)
    except Exception:  # noqa: BLE001
        data = None
    return data if isinstance(data, bytes) else b""


def decoded(part: Message) -> str:
    """A text part in its charset, else UTF-8, else Latin-1."""
    data = payload(part)
    for charset in (part.get_content_charset(failobj=None), "utf-8"):
        try:
            if charset:
                return data.decode(charset)
        except (LookupError, UnicodeDecodeError, ValueError):
            continue
    return data.decode("latin-1")


class _Enough(Exception):
    """The parser made more parts than are looked at."""


def begun(data: bytes, limits: Limits = LIMITS) -> tuple[Message, bool]:
    """A message with its first parts, four times as many as are looked at, and whether these are all."""
    made: list[Message] = []

    def message(policy: email.policy.Policy = email.policy.compat32) -> Message:
        if len(made) > 4 * limits.mime_parts:
            raise _Enough
        made.append(Message(policy=policy))
        return made[-1]

    parser = email.parser.BytesFeedParser(message, policy=email.policy.compat32)
    made.clear()  # the parser tries its factory once
    try:
        parser.feed(data)
        return parser.close(), True
    except _Enough:
        return made[0], False


def body_prefix(data: bytes, limits: Limits = LIMITS) -> str:
    """The start of the first plain part, else of the first HTML part."""
    msg, whole = begun(data, limits)
    first = {content_type(part): part for part in reversed(list(msg.walk()))}
    if not whole and "text/plain" not in first:
        first = {content_type(part): part for part in reversed(list(email.message_from_bytes(data, policy=email.policy.compat32).walk()))}
    part = first.get("text/plain", first.get("text/html"))
    return decoded(part)[:512] if part is not None else ""


def without_head(msg: Message) -> bytes:
    """A message of which only the headers were parsed, less those that say nothing of its body."""
    raw = lambda x: str(x).encode("ascii", "surrogateescape") if not isinstance(x, bytes) else x
    kept = b"".join(raw(k) + b": " + raw(v) + b"\r\n" for k, v in msg.raw_items() if k.lower().startswith(("content-", "mime-")))
    return kept + b"\r\n" + raw(msg._payload)  # the bytes as they came; the public way decodes them


def prefix_of(msg: Message, limits: Limits = LIMITS) -> str:
    """``body_prefix`` of a message of which only the headers were parsed; one without parts is not parsed again."""
    try:
        simple = msg.get_content_maintype() not in ("multipart", "message")
    except Exception:  # noqa: BLE001  a broken header must not cost the mail
        simple = False
    if simple:
        return decoded(msg)[:512] if content_type(msg) in ("text/plain", "text/html") else ""
    return body_prefix(without_head(msg), limits)


def raw_mail(data: bytes, limits: Limits = LIMITS) -> dict:
    """The raw row of a message; one that can't be read gives a row that says so."""
    empty = dict.fromkeys(("message_id", "reply_to", "reply_to_address", "return_path_domain", "date", "date_offset_min", "auth_results_header"))
    failed = {**empty, "dedupe_key": "sha256:" + hashlib.sha256(data).hexdigest(), "from_addr": UNREADABLE, "from_domain": "", "from_address": "", "reply_to_addresses": [], "to_addrs": [], "subject_raw": "", "mime_bytes": b"", "size_bytes": len(data), "content_hash": "", "id_collision": False, "ingest_failed": True}
    try:
        msg = email.parser.BytesHeaderParser(policy=email.policy.compat32).parsebytes(data)
        one = lambda name: next(iter(header_values(msg, name, limits)), None)
        shown, address, host, _ = parse_addresses(one("From") or "", limits)
        reply = one("Reply-To")
        _, reply_address, _, replies = parse_addresses(reply or "", limits)
        date_raw, subject = one("Date"), decode_words(one("Subject") or "")
        try:
            date = parsedate_to_datetime(date_raw) if date_raw else None
        except (TypeError, ValueError, OverflowError):
            date = None
        offset = date.utcoffset() if date is not None else None
        back = one("Return-Path")
        # only a mail without Message-ID is parsed as a whole here
        key = one("Message-ID") or fallback_key(shown, date_raw or "", subject, prefix_of(msg, limits))
        return {
            "message_id": one("Message-ID"), "dedupe_key": key, "from_addr": shown, "from_domain": host, "reply_to": reply, "from_address": address,
            "reply_to_address": reply_address if reply else None, "reply_to_addresses": replies, "return_path_domain": (domain_of(back) or None) if back else None,
            "to_addrs": [s for v in header_values(msg, "To", limits) for s in parse_addresses(v, limits)[3] if s][: limits.recipients],
            "subject_raw": subject, "date": date, "date_offset_min": int(offset.total_seconds() // 60) if offset is not None else (0 if date else None),
            "auth_results_header": " ".join(header_values(msg, "Authentication-Results", limits)) or None,
            "mime_bytes": data, "size_bytes": len(data), "content_hash": hashlib.sha256(data).hexdigest(), "id_collision": False, "ingest_failed": False,
        }
    except Exception:  # noqa: BLE001  the scan goes on
        return failed


@dataclass
class Part:
    """A leaf of the MIME tree, or what stands for one."""

    part_no: int
    depth: int
    ctype: str
    disposition: str | None
    filename: str | None
    data: bytes
    role: str  # plain, html, attachment or metadata
    charset_text: str | None = None


def walk(msg: Message, limits: Limits = LIMITS) -> tuple[list[Part], bool, int]:
    """The parts in order, whether something is encrypted, and how many parts were beyond the bound."""
    out: list[Part] = []
    encrypted, seen, skipped = False, 0, 0
    stack: list[tuple[Message, int]] = [(msg, 0)]
    while stack:
        part, depth = stack.pop()
        seen += 1
        if seen > limits.mime_parts:
            skipped += 1
            continue
        ctype = content_type(part)
        if depth > limits.mime_depth:
            out.append(Part(seen, depth, ctype, None, TOO_DEEP, b"", "metadata"))
            continue
        encrypted |= ctype in ENCRYPTED
        inner = part.get_payload()
        if part.is_multipart() and not ctype.startswith("message/") and isinstance(inner, list):
            stack.extend((p, depth + 1) for p in reversed(inner) if isinstance(p, Message))
            continue
        try:
            disposition, filename = part.get_content_disposition(), part.get_filename()
        except Exception:  # noqa: BLE001
            disposition, filename = None, None
        body = disposition != "attachment" and filename is None and ctype in ("text/plain", "text/html")
        role = "metadata" if ctype.startswith("message/") else ctype[5:] if body else "attachment"
        out.append(Part(seen, depth, ctype, disposition, filename, b"" if role == "metadata" else payload(part), role, decoded(part) if ctype.startswith("text/") else None))
    return out, encrypted, skipped


def parts_of(data: bytes, limits: Limits = LIMITS) -> tuple[list[Part], bool, int]:
    """``walk`` over a message's bytes, whose parser stops soon after the last part that is looked at."""
    msg, whole = begun(data, limits)
    out = walk(msg, limits)
    # parts inside of others that are never opened count for the parser only
    return out if whole or out[2] else walk(email.message_from_bytes(data, policy=email.policy.compat32), limits)


def content_words(text: str) -> set[str]:
    return set(_WORDS.findall(_NOISE.sub(" ", text).casefold()))


def diverges(plain: str, html_text: str, limits: Limits = LIMITS) -> bool:
    """Whether the HTML side says much that the plain one doesn't."""
    other = content_words(html_text)
    new = other - content_words(plain)
    return len(new) >= limits.divergence_words and len(new) > limits.divergence_share * len(other)


def reply_mismatch(sender: str | None, reply_to: str | None, replies: list[str] | None) -> bool:
    """Whether an answer would go elsewhere; an address that can't be read counts as elsewhere, two of them don't."""
    if not reply_to:
        return False
    sender = (sender or "").strip().lower()
    replies = [r.strip().lower() for r in replies or [""]]
    return (bool(sender) or any(replies)) and any(r != sender or not r for r in replies)


def return_path_mismatch(sender_domain: str | None, path_domain: str | None) -> bool:
    return bool(path_domain) and (path_domain or "").lower() != (sender_domain or "").lower()


@dataclass
class _Budget:
    left: int
    cut: bool = False

    def take(self, text: str, mark: str = "") -> str:
        if len(text) <= self.left:
            self.left -= len(text)
            return text
        out = text[: self.left].rstrip() + mark
        self.left, self.cut = 0, True
        return out


@dataclass
class _Mail:
    limits: Limits
    links: Links = field(default_factory=Links)
    removed: int = 0
    forged: int = 0
    hidden: int = 0
    rejected: bool = False

    def safe(self, raw: str, budget: _Budget) -> str:
        """Cleaned, without forged markers, live links and tags, within the budget. The order matters: tags would take markers along."""
        text, removed = clean_text(raw)
        text, forged = neutralize_markers(text)
        self.removed, self.forged = self.removed + removed, self.forged + forged
        return budget.take(strip_tag_like(self.links.scrub(text)), f"\n{TRUNCATED}")

    def header(self, raw: str, limit: int) -> str:
        text, removed, forged = header_text(raw, limit, self.links.scrub)
        self.removed, self.forged = self.removed + removed, self.forged + forged
        return text

    def html(self, parts: list[str]) -> list[str]:
        out, elements, room = [], self.limits.html_elements, self.limits.html_bytes
        for i, raw in enumerate(parts):
            size = len(raw.encode("utf-8", "surrogatepass"))
            if i >= self.limits.html_parts or size > room:
                self.rejected = True
                continue
            room -= size
            text, removed = clean_text(raw)
            try:
                text, hidden = html_to_text(text, elements, self.limits)
            except TooComplex:
                self.rejected = True
                continue
            self.removed, self.hidden = self.removed + removed, self.hidden + hidden
            out.append(text)
        return out


def sanitize(raw: dict, limits: Limits = LIMITS) -> dict:
    """The sanitized row of a raw one. Raises ValueError for a mail beyond the size bound."""
    data = raw["mime_bytes"] or b""
    if max(raw["size_bytes"] or 0, len(data)) > limits.mail_bytes:
        raise ValueError("mail_too_large")
    parts, encrypted, skipped = parts_of(data, limits)
    mail = _Mail(limits, Links(limits))
    raw_room, room = _Budget(limits.text_chars * limits.raw_factor), _Budget(limits.text_chars)
    plain = [p.charset_text or "" for p in parts if p.role == "plain"]
    html = [p.charset_text or "" for p in parts if p.role == "html"]
    divergent = False
    if plain:
        body = raw_room.take("\n\n".join(plain))
        if html:
            probe = _Mail(limits)
            divergent = diverges(body, "\n".join(probe.html(html)), limits)
            mail.rejected, mail.hidden = probe.rejected, probe.hidden
    else:
        body = raw_room.take("\n\n".join(mail.html(html)))
    body = mail.safe(body, room)
    attachments, texts, names, processed, blocked = [], [], set(), 0, 0
    pdf_seconds = limits.pdf_seconds
    for p in [p for p in parts if p.role in ("attachment", "metadata")] + [Part(0, 0, "multipart/mixed", None, TOO_MANY, b"", "metadata")] * bool(skipped):
        base = name = p.filename if p.filename in (TOO_MANY, TOO_DEEP) else sanitize_filename(p.filename)
        n = 1
        while name in names:
            n += 1
            name = f"{base} ({n})"
        names.add(name)
        kind = "unknown" if p.role == "metadata" else detect_kind(p.ctype, p.data)
        text = None
        if kind in ("text", "pdf") and processed < limits.attachments_processed:
            if kind == "text":
                text = p.charset_text
            else:
                began = time.monotonic()
                text = pdf.text_of(p.data, min(pdf.SECONDS, pdf_seconds))
                pdf_seconds -= time.monotonic() - began
        if text:
            short = raw_room.take(text)
            text = mail.safe(short, room) if short else None
        processed += text is not None
        blocked += text is None
        if text is not None:
            texts.append({"name": name, "text": text})
        if text is not None or len(attachments) < limits.attachments_listed:
            attachments.append({"filename_sanitized": name, "declared_mime": p.ctype, "detected_kind": kind, "size_bytes": len(p.data), "processed": text is not None, "extracted_chars": len(text or "")})
    subject = mail.header(raw["subject_raw"] or "", limits.subject_chars)
    display = raw["from_addr"] or ""
    name = display.partition("<")[0].strip() or display
    shown = mail.header(unescape(name), limits.display_chars).lstrip("/:. ") or UNKNOWN_SENDER
    host = raw["from_domain"] or ""
    links = mail.links
    if "xn--" in host:
        links.punycode += [x for x in [host.replace(".", "[.]")] if not any(e.startswith(x) for e in links.punycode)]
    report = {
        "links_removed": links.removed, "hidden_text_removed": mail.hidden > 0, "control_chars_removed": mail.removed, "punycode_domains": links.punycode,
        "mixed_script_domains": links.mixed, "truncated": room.cut or raw_room.cut, "html_divergent": divergent, "html_rejected": mail.rejected, "links_capped": links.capped,
        "blocked_attachments": blocked, "reply_to_mismatch": reply_mismatch(raw["from_address"], raw["reply_to"], raw["reply_to_addresses"]),
        "return_path_mismatch": return_path_mismatch(host, raw["return_path_domain"]), "id_collision": bool(raw["id_collision"]), "forged_markers": mail.forged, "encrypted": encrypted,
        "auth_results": parse_auth(raw["auth_results_header"]),
    }
    return {"dedupe_key": raw["dedupe_key"], "from_display": shown, "from_domain": host, "subject": subject, "date": raw["date"], "date_offset_min": raw["date_offset_min"], "body_text": body, "attachment_texts": texts, "attachments": attachments, "links_found": links.found, "report": report}
