"""Text of a PDF's pages: objects, object streams, the page tree, filters with predictors, and fonts with maps of their own.

Objects are found by looking for them, so a file with a broken cross-reference table reads like a whole one, and the last
definition of an object counts. What is encrypted is not read. ``text_of`` reads in a process of its own that has a
bound on its memory and is killed when its time is over; the file came from a stranger.
"""

from __future__ import annotations

import os
import re
import subprocess
import sys
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import Any

from .attachments import extract_pdf_text

#: Bytes of a file and of one decoded stream, characters of text, operators of all pages, depth of nested things, and what a process may use.
MOST_IN, MOST_STREAM, MOST_OUT, MOST_STEPS, DEPTH = 10 << 20, 32 << 20, 50_000, 2_000_000, 16
SECONDS, MEMORY = 10.0, 512 << 20

_OBJ = re.compile(rb"(\d{1,10})\s+(\d{1,5})\s+obj\b")
_TOKEN = re.compile(rb"\s*(?:%[^\r\n]*[\r\n]?\s*)*(<<|>>|[\[\]{}]|/[^\s()<>\[\]{}/%]*|[+-]?(?:\d+\.?\d*|\.\d+)(?![^\s()<>\[\]{}/%])|<[0-9A-Fa-f\s]*>|\(|[^\s()<>\[\]{}/%]+)")
_REST_OF_REF = re.compile(rb"\s+(\d{1,5})\s+R(?![^\s()<>\[\]{}/%])")
_STRING_PART = re.compile(rb"[^()\\]+|\\(?:[0-7]{1,3}|\r\n|[\s\S])|[()]")
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}
_HEX_NAME = re.compile(rb"#([0-9A-Fa-f]{2})")

#: Names of glyphs that are not single letters, as fonts' encodings write them.
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")",
    "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
    "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@",
    "bracketleft": "[", "backslash": "\\", "bracketright": "]", "underscore": "_", "braceleft": "{", "bar": "|", "braceright": "}", "endash": "–", "emdash": "—",
    "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "bullet": "•", "ellipsis": "…", "Euro": "€", "germandbls": "ß",
    "adieresis": "ä", "odieresis": "ö", "udieresis": "ü", "Adieresis": "Ä", "Odieresis": "Ö", "Udieresis": "Ü", "eacute": "é", "egrave": "è", "agrave": "à", "fi": "fi", "fl": "fl",
}


class Unreadable(ValueError):
    """Nothing that can be read as pages."""


class Name(str):
    pass


class Ref(int):
    pass


class Word(bytes):
    """An operator or a keyword."""


class Stream(dict):
    """A stream's dictionary, with its bytes as they are in the file."""

    raw: bytes = b""


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    out, depth = [], 1
    while depth:
        m = _STRING_PART.match(data, at)
        if m is None:
            raise Unreadable("a string without end")
        at, part = m.end(), m[0]
        depth += (part == b"(") - (part == b")")
        if part[:1] == b"\\":
            rest = part[1:]
            part = bytes([int(rest, 8) & 255]) if rest[:1].isdigit() and rest[:1] < b"8" else _ESCAPED.get(rest, rest)
        if depth:
            out.append(part)
    return b"".join(out), at


def value(data: bytes, at: int, depth: int = 0) -> tuple[Any, int]:
    """The value that begins at a place, and where it ends; a Word for what is none."""
    m = _TOKEN.match(data, at)
    if m is None or depth > DEPTH:
        raise Unreadable("no value")
    t, at = m[1], m.end()
    if t == b"(":
        return _string(data, at)
    if t[:1] == b"/":
        return Name(_HEX_NAME.sub(lambda x: bytes([int(x[1], 16)]), t[1:]).decode("latin-1")), at
    if t == b"<<" or t == b"[":
        items, end = [], b">>" if t == b"<<" else b"]"
        while True:
            item, at = value(data, at, depth + 1)
            if isinstance(item, Word) and item in (b">>", b"]", b"endobj"):
                break
            items.append(item)
        if end == b"]":
            return items, at
        return {k: v for k, v in zip(items[::2], items[1::2], strict=False) if isinstance(k, Name)}, at
    if t[:1] == b"<" and t[-1:] == b">" and len(t) > 1:
        digits = re.sub(rb"\s", b"", t[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), at
    if t[:1] in b"+-.0123456789" and re.fullmatch(rb"[+-]?(\d+\.?\d*|\.\d+)", t):
        if t.isdigit() and (r := _REST_OF_REF.match(data, at)):
            return Ref(int(t)), r.end()
        return (float(t) if b"." in t else int(t)), at
    return Word(t), at


def _flate(data: bytes) -> bytes:
    d = zlib.decompressobj()
    try:
        return d.decompress(data, MOST_STREAM)
    except zlib.error:  # a damaged end is no reason to lose the beginning
        d, out = zlib.decompressobj(), []
        try:
            for i in range(0, len(data), 256):
                out.append(d.decompress(data[i : i + 256], MOST_STREAM))
        except zlib.error:
            pass
        return b"".join(out)


def _ascii85(data: bytes) -> bytes:
    out, group = bytearray(), []
    for c in data.partition(b"~")[0]:
        if c == 0x7A and not group:
            out += bytes(4)
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += (sum(x * 85**i for x, i in zip(group, range(4, -1, -1), strict=True)) & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
    if len(group) > 1:
        n = sum(x * 85**i for x, i in zip(group + [84] * (5 - len(group)), range(4, -1, -1), strict=True)) & 0xFFFFFFFF
        out += n.to_bytes(4, "big")[: len(group) - 1]
    return bytes(out)


def _runs(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and data[at] != 128 and len(out) < MOST_STREAM:
        n = data[at]
        out += data[at + 1 : at + 2 + n] if n < 128 else data[at + 1 : at + 2] * (257 - n)
        at += n + 2 if n < 128 else 2
    return bytes(out)


def _lzw(data: bytes, early: int) -> bytes:
    out, table, width, have, bits, last = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""], 9, 0, 0, b""
    for byte in data:
        bits, have = bits << 8 | byte, have + 8
        if have < width:
            continue
        code = bits >> (have - width)
        have -= width
        bits &= (1 << have) - 1
        if code == 257 or len(out) > MOST_STREAM:
            break
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        if code > len(table) or (code == len(table) and not last):
            break
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last and len(table) < 4096:
            table.append(last + entry[:1])
        last = entry
        width = min(12, max(9, (len(table) + early).bit_length()))
    return bytes(out)


def _predicted(data: bytes, parms: dict) -> bytes:
    """Undo what was done to rows before they were packed."""
    kind, colors, bits, columns = (parms.get(k, d) for k, d in (("Predictor", 1), ("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1)))
    if not all(isinstance(x, int) and 0 < x < 1 << 16 for x in (kind, colors, bits, columns)) or kind == 1:
        return data
    step, width = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    if kind == 2:
        rows = [bytearray(data[i : i + width]) for i in range(0, len(data), width)]
        for row in rows if bits == 8 else ():
            for i in range(step, len(row)):
                row[i] = row[i] + row[i - step] & 255
        return b"".join(rows)
    out, above = bytearray(), bytearray(width)
    for i in range(0, len(data), width + 1):
        how, row = data[i], bytearray(data[i + 1 : i + 1 + width])
        row += bytes(width - len(row))
        for j in range(width if how else 0):
            a, b, c = row[j - step] if j >= step else 0, above[j], above[j - step] if j >= step else 0
            if how == 1:
                guess = a
            elif how == 2:
                guess = b
            elif how == 3:
                guess = (a + b) // 2
            else:
                p = a + b - c
                guess = min((a, b, c), key=lambda x, p=p: abs(p - x)) if how == 4 else 0
            row[j] = row[j] + guess & 255
        out += row
        above = row
    return bytes(out)


class File:
    def __init__(self, data: bytes) -> None:
        self.data = data
        self.places = {int(m[1]): m.end() for m in _OBJ.finditer(data)}
        self.packed: dict[int, tuple[bytes, int]] = {}
        self.known: dict[int, Any] = {}
        self.trailers: list[dict] = []
        for m in re.finditer(rb"\btrailer\b", data):
            try:
                found, _ = value(data, m.end())
                self.trailers.append(found if isinstance(found, dict) else {})
            except (Unreadable, ValueError):
                continue
        for number in list(self.places):
            o = self.get(Ref(number))
            if isinstance(o, Stream) and o.get("Type") == "ObjStm":
                self._unpack(o)
            elif isinstance(o, Stream) and o.get("Type") == "XRef":
                self.trailers.append(o)
        if any("Encrypt" in t for t in self.trailers):
            raise Unreadable("encrypted")

    def get(self, x: Any, depth: int = 0) -> Any:
        """A value, or what a reference stands for; None if that is nowhere."""
        while isinstance(x, Ref) and depth < DEPTH:
            if int(x) not in self.known:
                self.known[int(x)] = None  # what refers to itself is nothing
                self.known[int(x)] = self._object(int(x))
            x, depth = self.known[int(x)], depth + 1
        return None if isinstance(x, Ref) else x

    def _object(self, number: int) -> Any:
        data, at = self.packed[number] if number in self.packed and number not in self.places else (self.data, self.places.get(number, -1))
        if at < 0:
            return None
        try:
            found, at = value(data, at)
        except (Unreadable, ValueError):
            return None
        if isinstance(found, dict) and (m := re.compile(rb"\s*stream(\r\n|\n|\r)").match(data, at)):
            length = self.get(found.get("Length"), 1)
            start = m.end()
            stop = start + length if isinstance(length, int) and re.compile(rb"\s*endstream").match(data, start + length) else data.find(b"endstream", start)
            out = Stream(found)
            out.raw = data[start : stop if stop >= 0 else len(data)]
            return out
        return found

    def _unpack(self, o: Stream) -> None:
        data, first, n = self.bytes_of(o), self.get(o.get("First")), self.get(o.get("N"))
        if not isinstance(first, int) or not isinstance(n, int):
            return
        heads = data[:first].split()[: 2 * n]
        for number, at in zip(heads[::2], heads[1::2], strict=False):
            if number.isdigit() and at.isdigit():
                self.packed[int(number)] = data, first + int(at)
                self.known.pop(int(number), None)

    def bytes_of(self, o: Stream) -> bytes:
        """A stream's bytes without their filters; none behind a filter that isn't known."""
        filters, parms = self.get(o.get("Filter", o.get("F"))), self.get(o.get("DecodeParms", o.get("DP")))
        filters = filters if isinstance(filters, list) else [filters] if filters else []
        parms = parms if isinstance(parms, list) else [parms]
        data = o.raw
        for i, f in enumerate(map(self.get, filters[:8])):
            p = self.get(parms[i]) if i < len(parms) else None
            p = {k: self.get(v) for k, v in p.items()} if isinstance(p, dict) else {}
            if f in ("FlateDecode", "Fl"):
                data = _predicted(_flate(data), p)
            elif f in ("LZWDecode", "LZW"):
                data = _predicted(_lzw(data, 1 if p.get("EarlyChange", 1) else 0), p)
            elif f in ("ASCIIHexDecode", "AHx"):
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.partition(b">")[0])
                data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            elif f in ("ASCII85Decode", "A85"):
                data = _ascii85(data)
            elif f in ("RunLengthDecode", "RL"):
                data = _runs(data)
            else:
                return b""
        return data[:MOST_STREAM]

    def pages(self) -> Iterator[tuple[dict, dict]]:
        """Pages in their order, each with its resources; all that look like pages if there is no tree."""
        roots = [self.get(t.get("Root")) for t in reversed(self.trailers)]
        tree = next((self.get(r.get("Pages")) for r in roots if isinstance(r, dict) and isinstance(self.get(r.get("Pages")), dict)), None)
        if tree is not None:
            yield from self._below(tree, {}, 0, set())
            return
        for number in sorted({*self.places, *self.packed}):
            o = self.get(Ref(number))
            if isinstance(o, dict) and o.get("Type") == "Page":
                yield o, self.get(o.get("Resources")) or {}

    def _below(self, node: dict, resources: dict, depth: int, seen: set[int]) -> Iterator[tuple[dict, dict]]:
        if depth > DEPTH or id(node) in seen:
            return
        seen.add(id(node))
        resources = self.get(node.get("Resources")) or resources
        kids = self.get(node.get("Kids"))
        if not isinstance(kids, list):
            yield node, resources if isinstance(resources, dict) else {}
            return
        for kid in map(self.get, kids):
            if isinstance(kid, dict):
                yield from self._below(kid, resources, depth + 1, seen)


class Font:
    """How a font's codes read: by its own map, by its differences, else as the usual Western encoding."""

    def __init__(self, file: File, font: dict) -> None:
        self.map: dict[bytes, str] = {}
        self.widths: list[int] = []
        self.wide = font.get("Subtype") == "Type0"
        told = file.get(font.get("ToUnicode"))
        if isinstance(told, Stream):
            self._read(file.bytes_of(told))
        encoding = file.get(font.get("Encoding"))
        differences = file.get(encoding.get("Differences")) if isinstance(encoding, dict) else None
        base = encoding.get("BaseEncoding") if isinstance(encoding, dict) else encoding
        self.codec = "mac_roman" if base == "MacRomanEncoding" else "cp1252"
        code = 0
        for x in differences if isinstance(differences, list) else ():
            x = file.get(x)
            if isinstance(x, Name):
                if (text := glyph(x)) is not None and 0 <= code < 256:
                    self.map.setdefault(bytes([code]), text)
                code += 1
            elif isinstance(x, int):
                code = x

    def _read(self, cmap: bytes) -> None:
        def text(raw: bytes) -> str:
            return raw.decode("utf-16-be", "replace")

        for m in re.finditer(rb"begin(codespacerange|bfchar|bfrange)(.*?)end\1", cmap, re.S):
            try:
                items, _ = value(b"[" + m[2] + b"]", 0)
            except (Unreadable, ValueError):
                continue
            if m[1] == b"codespacerange":
                self.widths += [len(x) for x in items if isinstance(x, bytes)]
            elif m[1] == b"bfchar":
                self.map |= {k: text(v) for k, v in zip(items[::2], items[1::2], strict=False) if isinstance(k, bytes) and isinstance(v, bytes)}
            else:
                for low, high, to in zip(items[::3], items[1::3], items[2::3], strict=False):
                    if not isinstance(low, bytes) or not isinstance(high, bytes):
                        continue
                    first, n = int.from_bytes(low, "big"), min(int.from_bytes(high, "big") - int.from_bytes(low, "big") + 1, 1 << 16)
                    for i in range(n):
                        if isinstance(to, list) and i < len(to) and isinstance(to[i], bytes):
                            self.map[(first + i).to_bytes(len(low), "big")] = text(to[i])
                        elif isinstance(to, bytes) and len(to) >= 2:
                            last = int.from_bytes(to[-2:], "big") + i
                            self.map[(first + i).to_bytes(len(low), "big")] = text(to[:-2] + (last & 0xFFFF).to_bytes(2, "big"))

    def text(self, raw: bytes) -> str:
        widths = sorted(set(self.widths) or ({2} if self.wide else {1}))
        out, at = [], 0
        while at < len(raw):
            for w in widths:
                if raw[at : at + w] in self.map:
                    out.append(self.map[raw[at : at + w]])
                    break
            else:
                w = widths[0]
                if not self.wide:
                    out.append(raw[at : at + 1].decode(self.codec, "replace"))
            at += w
        return "".join(out)


def glyph(name: str) -> str | None:
    if len(name) == 1:
        return name
    if name in GLYPHS:
        return GLYPHS[name]
    if m := re.fullmatch(r"uni([0-9A-Fa-f]{4})|u([0-9A-Fa-f]{4,6})", name):
        code = int(m[1] or m[2], 16)
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None
    return None


class Reader:
    """Walks contents and collects what they show, line by line."""

    def __init__(self, file: File) -> None:
        self.file, self.out, self.steps, self.room = file, [], MOST_STEPS, MOST_OUT
        self.fonts: dict[int, Font] = {}

    def say(self, text: str) -> None:
        text = text[: self.room]
        self.room -= len(text)
        self.out.append(text)

    def line(self) -> None:
        if self.out and not self.out[-1].endswith("\n"):
            self.say("\n")

    def _font(self, resources: dict, name: Any) -> Font | None:
        fonts = self.file.get(resources.get("Font"))
        found = self.file.get(fonts.get(name)) if isinstance(fonts, dict) else None
        if not isinstance(found, dict):
            return None
        if id(found) not in self.fonts:
            self.fonts[id(found)] = Font(self.file, found)
        return self.fonts[id(found)]

    def contents(self, data: bytes, resources: dict, depth: int = 0) -> None:
        held: list[Any] = []
        font, at, height = None, 0, None
        while self.room > 0 and self.steps > 0:
            self.steps -= 1
            try:
                x, at = value(data, at)
            except (Unreadable, ValueError):
                break
            if not isinstance(x, Word):
                held = [*held[-31:], x]
                continue
            if x == b"BI":  # a picture within the contents
                end = re.compile(rb"\sEI(?=\s|$)").search(data, at)
                at = end.end() if end else len(data)
            elif x == b"Tf" and len(held) > 1:
                font = self._font(resources, held[-2])
            elif x in (b"Td", b"TD") and len(held) > 1 and held[-1]:
                self.line()
            elif x in (b"T*", b"ET"):
                self.line()
            elif x == b"Tm" and len(held) > 5:
                if height is not None and held[-1] != height:
                    self.line()
                height = held[-1]
            elif x in (b"Tj", b"'", b'"') and held and isinstance(held[-1], bytes):
                if x != b"Tj":
                    self.line()
                self.say(font.text(held[-1]) if font else held[-1].decode("cp1252", "replace"))
            elif x == b"TJ" and held and isinstance(held[-1], list):
                for y in held[-1]:
                    if isinstance(y, bytes):
                        self.say(font.text(y) if font else y.decode("cp1252", "replace"))
                    elif isinstance(y, int | float) and y < -200:  # wide enough for a blank
                        self.say(" ")
            elif x == b"Do" and held and depth < DEPTH:
                objects = self.file.get(resources.get("XObject"))
                form = self.file.get(objects.get(held[-1])) if isinstance(objects, dict) else None
                if isinstance(form, Stream) and form.get("Subtype") == "Form":
                    self.contents(self.file.bytes_of(form), self.file.get(form.get("Resources")) or resources, depth + 1)
            held = []


def read(data: bytes, most_out: int = MOST_OUT) -> str | None:
    """The text of all pages, or of all plain streams where there are no pages; None if there is none to be had.

    Unbounded but for its own counters: see ``text_of``.
    """
    if b"%PDF-" not in data[:1024] or len(data) > MOST_IN:
        return None
    try:
        reader = Reader(file := File(data))
        reader.room = most_out
        pages = file.pages()
        first = next(pages, None)
        if first is None:  # what shows strings at all, then
            return extract_pdf_text(data, MOST_IN, most_out)
        for page, resources in chain([first], pages):
            contents = file.get(page.get("Contents"))
            streams = [file.get(x) for x in contents] if isinstance(contents, list) else [contents]
            reader.contents(b"\n".join(file.bytes_of(s) for s in streams if isinstance(s, Stream)), resources)
            reader.line()
            if reader.room <= 0 or reader.steps <= 0:
                break
    except (Unreadable, RecursionError):
        return None
    text = "".join(reader.out).rstrip("\n")
    return text if text.strip() and sum(not (c.isprintable() or c.isspace()) for c in text) * 4 <= len(text) else None


def text_of(data: bytes, seconds: float = SECONDS, memory: int = MEMORY, most_out: int = MOST_OUT) -> str | None:
    """``read`` in a process that is killed when its time is over and can't take more than its memory; None for whatever goes wrong there."""
    if b"%PDF-" not in data[:1024] or len(data) > MOST_IN or seconds <= 0:
        return None
    env = {**os.environ, "PYTHONPATH": os.pathsep.join(p for p in sys.path if p)}
    try:
        done = subprocess.run([sys.executable, "-m", "postlake.kernels.pdf", str(memory), str(most_out)], input=data, capture_output=True, timeout=seconds, env=env, check=False)
    except (subprocess.SubprocessError, OSError):
        return None
    return done.stdout.decode("utf-8", "replace")[:most_out] or None if done.returncode == 0 else None


def main() -> int:
    import resource

    memory = int(sys.argv[1])
    resource.setrlimit(resource.RLIMIT_AS, (memory, memory))
    try:
        text = read(sys.stdin.buffer.read(), int(sys.argv[2]))
    except Exception:  # noqa: BLE001  nothing of the file may show in a message
        return 1
    sys.stdout.buffer.write((text or "").encode("utf-8", "replace"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
