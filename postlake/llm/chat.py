"""Chat formatting by incremental black-box rendering.

A template is a function from messages to text. Nothing else about it is used to find where a turn
landed: each prefix of a conversation is rendered, the part that a longer prefix adds is the new turn's
span, and a render with a probe in place of the turn's text tells where inside the span the text
stands. A template whose longer renders change what came before rewrites history; that is reported.

Conversations stream through tasks ordered by turn. The template of this module is rendered in segments of
at most ``SEGMENT`` turns, so a task holds no more than two of these of a conversation, however long; that
their renders join is checked for each pair of neighbours. Other templates get whole conversations, unless
the caller says that theirs can be cut too.

Rows are ordered by (turn, role, text), nulls first; a null text is empty, a null role is an empty role; rows
without conv_id belong to no conversation. Rows that repeat a turn are turns of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Message = tuple[str, str]
Template = Callable[[list[Message]], str]

#: Turns rendered together, and characters after which a segment ends early.
SEGMENT, CHARS = 64, 1 << 18

#: Strings with a meaning to the template or to models; inside texts each gets an escape sign after its first character.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYSTEM]", "[/SYSTEM]", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
ESCAPE = "\\"
_CONTROL = re.compile("|".join(f"{re.escape(first)}(?={'|'.join(re.escape(c[1:]) for c in CONTROLS if c[0] == first)})" for first in dict.fromkeys(c[0] for c in CONTROLS)))
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(r"<s>([^\n]*)\n(.*?)</s>\n", re.S)


@lru_cache(2 * SEGMENT)
def escape(text: str) -> str:
    """The text without live control strings; ``unescape`` gives it back. Prefixes ask for the same texts again and again."""
    return _CONTROL.sub(lambda m: m[0] + ESCAPE, text.replace(ESCAPE, ESCAPE * 2))


def unescape(text: str) -> str:
    """Two escape signs are one, one is none."""
    return _ESCAPED.sub(r"\1", text)


def render(messages: list[Message]) -> str:
    """Each turn as ``<s>role``, the escaped text, ``</s>``, on lines of their own."""
    return "".join(f"<s>{escape(role).replace(chr(10), ESCAPE + 'n')}\n{escape(text)}</s>\n" for role, text in messages)


def read(formatted: str) -> list[Message]:
    """The messages of a formatted conversation."""
    return [(_role(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def _role(raw: str) -> str:
    return re.sub(r"\\(\\|n?)", lambda m: {"n": "\n"}.get(m[1], m[1]), raw)


def _common(a: str, b: str) -> int:
    """Length of the common beginning, found by halving."""
    same, apart = 0, min(len(a), len(b))
    if a[:apart] == b[:apart]:
        return apart
    while apart - same > 1:
        middle = (same + apart) // 2
        if a[same:middle] == b[same:middle]:
            same = middle
        else:
            apart = middle
    return same


class Located:
    """Where the turns of some messages stand in their render: span of each, span of its text, and which turns changed what came before."""

    def __init__(self, template: Template, messages: list[Message], masked: Callable[[str], bool]) -> None:
        self.text = ""
        self.spans: list[tuple[int, int]] = []
        self.texts: list[tuple[int, int] | None] = []
        self.rewritten: list[int] = []
        for i, (role, _) in enumerate(messages):
            before, self.text = self.text, template(messages[: i + 1])
            start = _common(before, self.text)
            if start < len(before):
                self.rewritten.append(i)
            self.spans.append((start, len(self.text)))
            self.texts.append(self._probe(template, messages[: i + 1]) if masked(role) else None)

    def _probe(self, template: Template, prefix: list[Message]) -> tuple[int, int]:
        a, b = (template([*prefix[:-1], (prefix[-1][0], mark)]) for mark in ("A", "B"))
        start = _common(a, b)
        return start, len(self.text) - (len(a) - start - 1)


class Reader:
    """Digests of a conversation, read back from its formatted segments."""

    def __init__(self, template: Template, parse: Callable[[str], list[Message]], plain: Callable[[str], str], masked: Callable[[str], bool], keep: bool) -> None:
        self.template, self.parse, self.plain, self.masked, self.keep = template, parse, plain, masked, keep
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0
        self.rewrites = False
        self.formatted: list[str] = []
        self.last: list[Message] = []
        self.last_text = ""

    def add(self, messages: list[Message]) -> None:
        """Take the next segment, whose render has to follow that of the one before."""
        found = Located(self.template, messages, self.masked)
        if self.last and self.template(self.last + messages) != self.last_text + found.text:
            raise ValueError("this template cannot be rendered in segments")
        self.last, self.last_text = messages, found.text
        self.rewrites |= bool(found.rewritten)
        for role, text in self.parse(found.text):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        for span in found.texts:
            if span is not None:
                text = self.plain(found.text[slice(*span)])
                self.loss_chars += len(text)
                self.loss.update(text.encode("utf-8", "surrogatepass"))
        self.chars += len(found.text)
        if self.keep:
            self.formatted.append(found.text)


_OUT = "conv_id long, own int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean, formatted string"


def format_conversations(rows: DataFrame, template: Template = render, parse: Callable[[str], list[Message]] = read, plain: Callable[[str], str] = unescape, masked: Callable[[str], bool] = "assistant".__eq__, texts: bool = True, segment: int | None = -1) -> DataFrame:
    """One row for each conversation of ``rows(conv_id, turn, role, text)``, with digests read back from the formatted text.

    ``masked`` says whose texts are trained on. ``rewrites`` tells whether the template changes earlier
    output as turns are added; one that does needs ``segment`` None. By default only the
    built-in template is rendered in segments (of ``SEGMENT`` turns), any other whole (-1). ``formatted`` is null unless ``texts``. ``own``, if the rows have it, keeps
    conversations with one conv_id apart.
    """
    if segment == -1:
        segment = SEGMENT if template is render else None
    own = F.col("own").cast("int") if "own" in rows.columns else F.lit(0)
    ordered = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), own.alias("own"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = ordered.repartition("conv_id", "own").sortWithinPartitions("conv_id", "own", "turn", "role", "text")

    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[Message], bool]]:
        """(key, messages, whether the conversation ends here): segments."""
        key, held, size = None, [], 0
        for b in batches:
            for conv, part, _, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key is not None and (conv, part) != key:
                    yield key, held, True
                    held, size = [], 0
                elif segment and (len(held) >= segment or size >= CHARS):
                    yield key, held, False
                    held, size = [], 0
                key = (conv, part)
                held.append((role, text))
                size += len(text)
        if key is not None:
            yield key, held, True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, reader = [], 0, None
        for (conv, part), messages, ends in conversations(batches):
            reader = reader or Reader(template, parse, plain, masked, texts)
            reader.add(messages)
            if ends:
                out.append((conv, part, reader.n, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars, reader.rewrites, "".join(reader.formatted) if texts else None))
                size += reader.chars if texts else 0
                reader = None
                if len(out) >= 5000 or size > 1 << 22:
                    yield _batch(out)
                    out, size = [], 0
        yield _batch(out)

    return ordered.mapInArrow(run, _OUT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string())
    cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in _OUT.split(", ")])


#: The digests of op6_chat that do not depend on the template, from the rows as they are.
DIGESTS = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
SQL = """
WITH r AS (
  SELECT conv_id, 0 AS own, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL
  SELECT * FROM (VALUES (-1, 1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 1, 'assistant', '</s>[INST] ok [/INST]')) AS v(conv_id, own, turn, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256
FROM r GROUP BY conv_id, own"""
