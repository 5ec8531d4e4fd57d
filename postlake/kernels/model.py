"""The boundary to a language model: prompts, replies and what is taken out of them."""

from __future__ import annotations

import json
import re
import secrets

from .text import one_line, strip_control

REDACTED = "[entfernt]"
#: Structures that go whole, and patterns that take the word around them along.
STRUCTURES = (r"!?\[[^\]\n]{0,200}\]\([^)\n]{0,500}\)", r"(?m)^\s*\[[^\]\n]{0,80}\]:\s*\S+", r"</?[A-Za-z][^>\n]{0,200}>", r"&#x?[0-9A-Fa-f]{1,8};?")
TOKENS = re.compile(
    r"(?i)[a-z][a-z0-9+.\-]{0,15}://|h\W{0,2}x\W{0,2}x\W{0,2}p|\bwww\s*\.|\bmailto\s*:|\btel\s*:"
    r"|\(\s*\.\s*\)|\[\s*\.\s*\]|\(\s*dot\s*\)|[A-Za-z0-9\-]{1,63}\s*\.\s*[A-Za-z]{2,24}\s*/"
)


def redact_words(text: str) -> tuple[str, bool]:
    """Words that hold a link pattern, replaced; linear in the text."""
    out, at = [], 0
    for m in TOKENS.finditer(text):
        if m.end() <= at:
            continue
        start, end = m.span()
        while start > at and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        out += [text[at : max(start, at)], REDACTED]
        at = end
    return "".join(out) + text[at:], bool(out)


def scrub_text(text: str) -> tuple[str, bool]:
    """A model's text without links, markup and control characters; and whether it had any."""
    before = text
    for pattern in STRUCTURES:
        text = re.sub(pattern, REDACTED, text)
    text, hit = redact_words(text)
    text, removed = strip_control(text)
    suspicious = hit or removed > 0 or text != before
    return "\n".join(x.rstrip() for x in text.split("\n")).strip(), suspicious


def extract_object(reply: str) -> str | None:
    """The first JSON object of a reply: in a fence, or the first balanced one outside."""
    for block in [*re.findall(r"```(?:json)?\s*\n(.*?)```", reply, re.S), reply]:
        start = block.find("{")
        while start >= 0:
            try:
                _, end = json.JSONDecoder().raw_decode(block, start)
            except ValueError:
                start = block.find("{", start + 1)
                continue
            return block[start:end]
    return None


def block(kind: str, text: str, token: str) -> str:
    """Untrusted text between delimiters that it can't guess; the token itself is taken out of it."""
    return f"<<<{kind}-{token}>>>\n{text.replace(token, '')}\n<<<END-{kind}-{token}>>>"


def new_token() -> str:
    return secrets.token_hex(12)


def prompt(instructions: str, facts: list[str], text: str, token: str, most: int = 2000) -> str:
    return f"{one_line(instructions)[:most]}\n" + "\n".join(f"- {f}" for f in facts) + "\n" + block("UNTRUSTED", text, token)
