"""Unicode, entities, tags and markers: pure functions on strings."""

from __future__ import annotations

import html
import re
import unicodedata

#: The scripts that count when a host mixes writing systems.
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "HEBREW", "ARABIC", "DEVANAGARI", "THAI", "HANGUL", "HIRAGANA", "KATAKANA", "GEORGIAN", "CHEROKEE", "COPTIC", "ETHIOPIC", "BENGALI", "TAMIL")
MARKER_TOKEN = "[forged data-block marker removed]"
#: Words that together mark a data block; a deployment names its own.
MARKER_WORDS = ("POSTLAKE", "UNTRUSTED")

_TAG_LIKE = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_CHUNK = re.compile(r"<+[^<>\n]{0,300}>+")


def strip_control(text: str) -> tuple[str, int]:
    """Without characters of the categories C*, but for tab and line feed; and how many went. A character is looked up once, however often it stands in the text."""
    if text.isascii() and text.isprintable():
        return text, 0
    bad = {c for c in set(text) if c not in "\t\n" and unicodedata.category(c)[0] == "C"}
    kept = text
    if len(bad) > 4:
        kept = "".join([c for c in text if c not in bad])
    else:
        for c in bad:
            kept = kept.replace(c, "")
    return kept, len(text) - len(kept)


def clean_text(text: str) -> tuple[str, int]:
    """Line ends as LF, NFKC, no control characters; and how many went."""
    return strip_control(unicodedata.normalize("NFKC", text.replace("\r\n", "\n").replace("\r", "\n")))


def script_of(char: str) -> str | None:
    name = unicodedata.name(char, "")
    if name.startswith("CJK"):
        return "CJK"
    first = name.partition(" ")[0]
    return first if first in SCRIPTS else None


def is_mixed_script(domain: str) -> bool:
    """Whether one label has letters of several scripts."""
    return any(len({s for c in label if c.isalpha() and (s := script_of(c))}) > 1 for label in domain.split("."))


def unescape(text: str, rounds: int = 8) -> str:
    """Entities resolved until nothing changes."""
    for _ in range(rounds):
        after = html.unescape(text)
        if after == text:
            break
        text = after
    return text


def strip_tag_like(text: str) -> str:
    return _TAG_LIKE.sub(" ", text)


def neutralize_markers(text: str, words: tuple[str, ...] = MARKER_WORDS) -> tuple[str, int]:
    """Angle-bracketed chunks that hold all marker words become a token; and how many did."""
    found = 0

    def one(m: re.Match[str]) -> str:
        nonlocal found
        if all(w in m[0].upper() for w in words):
            found += 1
            return MARKER_TOKEN
        return m[0]

    return _CHUNK.sub(one, text), found


def one_line(text: str) -> str:
    return " ".join(text.split())


def clamp(text: str, limit: int) -> str:
    return text if len(text) <= limit else text[: limit - 1].rstrip() + "…"


def header_text(text: str, limit: int, scrub) -> tuple[str, int, int]:
    """A header value for display: cleaned, without markers, links and tags, on one line, capped; with removed characters and markers."""
    text, removed = clean_text(text)
    text, forged = neutralize_markers(text)
    return clamp(one_line(strip_tag_like(scrub(text))), limit), removed, forged
