"""What an attachment is, by its content, and how it may be named."""

from __future__ import annotations

import re
import unicodedata
import zlib

#: Signatures at the start of a file, in the order they are tried.
SIGNATURES = (
    (b"%PDF-", "pdf"),
    (b"MZ", "exe"),
    (b"\x7fELF", "elf"),
    (b"PK\x03\x04", "zip"),
    (b"PK\x05\x06", "zip"),
    (b"PK\x07\x08", "zip"),
    (b"Rar!\x1a\x07", "rar"),
    (b"7z\xbc\xaf\x27\x1c", "7z"),
    (b"\x1f\x8b", "gzip"),
    (b"BZh", "bzip2"),
    (b"\xfd7zXZ\x00", "xz"),
    (b"MSCF", "cab"),
    (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "ole2"),
    (b"\x89PNG\r\n\x1a\n", "png"),
    (b"\xff\xd8\xff", "jpeg"),
    (b"GIF87a", "gif"),
    (b"GIF89a", "gif"),
    (b"BM", "bmp"),
    (b"II*\x00", "tiff"),
    (b"MM\x00*", "tiff"),
    (b"\xca\xfe\xba\xbe", "macho-fat/javaclass"),
    (b"\xfe\xed\xfa\xce", "macho"),
    (b"\xfe\xed\xfa\xcf", "macho"),
    (b"\xcf\xfa\xed\xfe", "macho"),
    (b"\xce\xfa\xed\xfe", "macho"),
    (b"{\\rtf", "rtf"),
    (b"#!", "script"),
    (b"SQLite format 3\x00", "sqlite"),
    (b"\x00asm", "wasm"),
)
#: Declared types that are read at all, and bytes that no text has.
READABLE = {"application/pdf": "pdf", "text/plain": "text", "text/html": "html"}
CONTROL = bytes(b for b in range(32) if b not in (9, 10, 12, 13, 27))
WINDOW, NAME_CHARS, SUFFIX_CHARS = 8192, 80, 10


def sniff(data: bytes) -> str | None:
    return next((kind for start, kind in SIGNATURES if data.startswith(start)), None)


def looks_like_text(data: bytes) -> bool:
    """No NUL and under a twentieth of control bytes in the first window; nothing is text, too."""
    head = data[:WINDOW]
    return b"\0" not in head and 20 * (len(head) - len(head.translate(None, CONTROL))) < max(len(head), 1)


def detect_kind(declared: str, data: bytes) -> str:
    """pdf, text or html if declaration and content agree; mismatch if not; unknown for all other types."""
    kind = READABLE.get(declared.partition(";")[0].strip().lower())
    if kind is None:
        return "unknown"
    found = sniff(data)
    fits = found == "pdf" if kind == "pdf" else found is None and looks_like_text(data)
    return kind if fits else "mismatch"


def shorten(name: str, limit: int = NAME_CHARS) -> str:
    """Cut in the middle so that a short suffix stays; the ellipsis counts as three characters."""
    if len(name) <= limit:
        return name
    m = re.search(rf"(?<=.)\.[^.]{{1,{SUFFIX_CHARS}}}$", name, re.S)
    suffix = m[0] if m and limit - 3 - len(m[0]) >= 2 else ""
    room = limit - 3 - len(suffix)
    if room < 2:
        return name[:limit]
    stem, tail = name[: len(name) - len(suffix)], room // 2
    return f"{stem[: room - tail]}…{stem[len(stem) - tail :] if tail else ''}{suffix}"


def sanitize_filename(name: str | None, fallback: str = "unbenannt") -> str:
    """A harmless ASCII name without folders."""
    if not name:
        return fallback
    base = unicodedata.normalize("NFKC", name).replace("\\", "/").rpartition("/")[2]
    kept = " ".join(re.sub(r"[^A-Za-z0-9._ -]", "_", base).split()).strip("._ ")
    return shorten(kept) if kept else fallback


_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOWN = re.compile(rb"\(((?:[^()\\]|\\.)*)\)\s*(?:Tj|'|\")|\[((?:[^\]\\]|\\.)*)\]\s*TJ", re.S)
_STRING = re.compile(rb"\(((?:[^()\\]|\\.)*)\)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def extract_pdf_text(data: bytes, most_in: int = 10 << 20, most_out: int = 50_000) -> str | None:
    """The strings that a PDF's plain or deflated page streams show; None if there are none to be had.

    Fonts with encodings of their own are beyond this reader: their files count as unreadable.
    """
    if not data.startswith(b"%PDF-") or len(data) > most_in:
        return None
    out: list[str] = []
    room = most_out
    for m in _STREAM.finditer(data):
        body = m[1]
        try:
            body = zlib.decompressobj().decompress(body, 4 * most_out)
        except zlib.error:
            if b"Tj" not in body and b"TJ" not in body:
                continue
        for shown in _SHOWN.finditer(body):
            parts = [shown[1]] if shown[1] is not None else [x[1] for x in _STRING.finditer(shown[2])]
            raw = b"".join(re.sub(rb"\\([0-7]{1,3}|.)", lambda x: bytes([int(x[1], 8) & 255]) if x[1][:1].isdigit() else _ESCAPES.get(x[1], x[1]), p) for p in parts)
            text = raw.decode("latin-1")
            if sum(not (c.isprintable() or c.isspace()) for c in text) * 4 > len(text):
                continue
            out.append(text[:room])
            room -= len(out[-1])
            if room <= 0:
                return "\n".join(out)
    return "\n".join(out) if out else None
