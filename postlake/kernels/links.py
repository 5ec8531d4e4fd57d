"""Links: finding them however they are written, numbering and defanging them.

A text is a list of segments, plain ones and finished markers. Each pass splits the plain segments at
what it finds, so no later pass can reach into a marker.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import unquote

from ..limits import LIMITS, Limits
from .text import clean_text, is_mixed_script

CAPPED = "[Link removed]"
FOOTNOTE = "Link footnote (defanged):"
SUPPRESSED = "[further links suppressed]"

#: Endings that make a bare name a file, not a host.
FILE_ENDINGS = frozenset(
    "exe dll msi bat cmd ps1 sh js mjs py jar apk zip rar 7z tar gz tgz bz2 xz iso img bin dat "
    "pdf doc docx xls xlsx ppt pptx odt ods odp rtf txt csv md html htm eml ics vcf log ini cfg "
    "toml json xml yml yaml png jpg jpeg gif svg webp bmp tif tiff mp3 mp4 mov avi db sqlite bak tmp".split()
)

#: The patterns of what counts as a link.
DOT = r"(?:\(\s*(?:\.|dot)\s*\)|\[\s*(?:\.|dot)\s*\]|\{\s*(?:\.|dot)\s*\})"
HTTP = r"(?:%68|h)\s{0,3}(?:%74|t|x)\s{0,3}(?:%74|t|x)\s{0,3}(?:%70|p)\s{0,3}(?:%73|s)?"
FTP = r"f\s{0,3}t\s{0,3}p\s{0,3}s?"
LABEL = r"[\w%-]+"
BETWEEN = rf"(?:{DOT}|\.|(?:\s{{1,3}}(?:{DOT}|\.)\s{{0,3}}|(?:{DOT}|\.)\s{{1,3}})(?=[a-z0-9]))"
HOST = rf"{LABEL}(?:{BETWEEN}{LABEL})*"
PATH = r"(?:[/?#][^\s<>\"'()\x00]*)?"
URL = rf"(?:{HTTP}|{FTP})\s{{0,3}}:\s{{0,3}}/\s{{0,3}}/\s{{0,3}}(?:[^\s<>\"'@/\x00]{{1,64}}@)?{HOST}(?::\d{{1,5}})?{PATH}"
MAILTO = r"mailto\s{0,3}:\s{0,3}[^\s<>\"'`,;:\x00]{1,128}"
TEL = r"tel\s{0,3}:\s{0,3}\+?[0-9][0-9 ()./-]{2,24}[0-9]"
WWW = rf"\bwww\s{{0,3}}(?:{DOT}|\.)\s{{0,3}}{HOST}{PATH}"
DOTTED = rf"\b{LABEL}(?:\s{{0,3}}{DOT}\s{{0,3}}{LABEL})+{PATH}"
BARE = rf"(?<![\w@.-]){LABEL}+(?:\.{LABEL}+){{1,10}}(?:/[^\s<>\"'()\x00]*)?"

_DOT = re.compile(DOT, re.I)
_SCHEME = re.compile(r"(?:%68|h)(?:%74|t|x)(?:%74|t|x)(?:%70|p)(%73|s)?", re.I)
_MARKUP = str.maketrans("", "", "`*|~\\")
#: A host that needs no decoding or cleaning.
_SIMPLE = re.compile(r"[a-z0-9._-]*")
_PORT, _TAIL, _SPACE = re.compile(r":\d+$"), re.compile(r"[/?#]"), re.compile(r"\s+")


def trailing(raw: str) -> tuple[str, str]:
    """The link and the punctuation that ends the sentence."""
    core = raw.rstrip(".,;:!?")
    return core, raw[len(core) :]


def condense(raw: str) -> str:
    return _DOT.sub(".", _SPACE.sub("", raw))


def canonical(raw: str) -> str:
    """Plain scheme, lower case, no disguise."""
    flat = condense(raw)
    if m := _SCHEME.match(flat):
        return ("https" if m[1] else "http") + flat[m.end() :].lower()
    return flat.lower()


def host_of(url: str) -> str:
    rest = url.partition("://")[2] if "://" in url else url
    name = _TAIL.split(rest, maxsplit=1)[0].rpartition("@")[2]
    name = _PORT.sub("", name)
    name = name.strip(".") if _SIMPLE.fullmatch(name) else clean_text(unquote(name).strip(".").lower())[0]
    return (name[4:] if name.startswith("www.") and name.count(".") > 1 else name) or "unknown"


def defang(url: str, limit: int = LIMITS.defanged_chars) -> str:
    """A form that no client makes clickable."""
    out = url.translate(_MARKUP)
    for pattern, new in ((r"^https", "hxxps"), (r"^http\b", "hxxp"), (r"^ftp", "fxp"), (r"^mailto:", "mailto[:]")):
        out = re.sub(pattern, new, out)
    out = out.replace("://", "[:]//").replace(".", "[.]")
    return out if len(out) <= limit else out[:limit] + "…"


def punycode_unicode(host: str) -> str | None:
    """The Unicode form of an ``xn--`` host, if there is one."""
    if "xn--" not in host:
        return None
    try:
        return clean_text(host.encode("ascii").decode("idna"))[0]
    except UnicodeError:
        return None


@dataclass
class Links:
    """The links of one mail, numbered through all of its fields."""

    limits: Limits = LIMITS
    removed: int = 0
    capped: bool = False
    found: list[str] = field(default_factory=list)
    punycode: list[str] = field(default_factory=list)
    mixed: list[str] = field(default_factory=list)
    facts: list[dict] = field(default_factory=list)

    @property
    def full(self) -> bool:
        """Whether all further links are beyond the bound, so that nothing about them needs to be known."""
        return self.removed >= self.limits.links

    def _over(self, kind: str) -> str:
        self.removed += 1
        self.capped = True
        self.facts.append({"link_no": self.removed, "kind": kind, "host": None, "defanged": None, "is_punycode": False, "unicode_host": None, "is_mixed_script": False, "capped": True})
        return CAPPED

    def _note(self, kind: str, host: str, shown: str) -> int | None:
        if self.full:
            self._over(kind)
            return None
        self.removed += 1
        if len(self.found) < self.limits.links_listed:
            self.found.append(f"#{self.removed}: {shown}")
        return self.removed

    def mark(self, kind: str, host: str, shown: str) -> str:
        """Number a link; its marker."""
        n = self._note(kind, host, shown)
        if n is None:
            return CAPPED
        plain, notes = punycode_unicode(host), ""
        if "xn--" in host:
            entry = host.replace(".", "[.]") + (f" (Unicode: {plain.replace('.', '[.]')})" if plain else "")
            self.punycode += [entry] * (entry not in self.punycode)
            notes += " (caution: punycode)"
        mixed = is_mixed_script(plain or host)
        if mixed:
            entry = (plain or host).replace(".", "[.]")
            self.mixed += [entry] * (entry not in self.mixed)
            notes += " (caution: mixed writing systems)"
        self.facts.append({"link_no": n, "kind": kind, "host": host, "defanged": shown, "is_punycode": "xn--" in host, "unicode_host": plain, "is_mixed_script": mixed, "capped": False})
        return f"[{kind} #{n}: {host}{notes}]"

    # one handler for each pass: the marker and what stays behind it, or None to leave the text alone
    def _url(self, raw: str) -> tuple[str, str] | None:
        core, rest = trailing(raw)
        if self.full:
            return self._over("Link"), rest
        url = canonical(core)
        return self.mark("Link", host_of(url), defang(url, self.limits.defanged_chars)), rest

    def _mail(self, raw: str) -> tuple[str, str] | None:
        core, rest = trailing(raw)
        if self.full:
            return self._over("Mail"), rest
        address = condense(core).rpartition(":")[2].lower() if core.count(":") == 1 else condense(core).split(":", 1)[-1].lower()
        host = clean_text(address.rpartition("@")[2] if "@" in address else "unknown")[0] or "unknown"
        return self.mark("Mail", host, defang(f"mailto:{address}", self.limits.defanged_chars)), rest

    def _tel(self, raw: str) -> tuple[str, str] | None:
        number = condense(raw).split(":", 1)[-1]
        n = self._note("Tel", "", f"tel[:]{number}")
        if n is None:
            return CAPPED, ""
        self.facts.append({"link_no": n, "kind": "Tel", "host": None, "defanged": f"tel[:]{number}", "is_punycode": False, "unicode_host": None, "is_mixed_script": False, "capped": False})
        return f"[Tel #{n}]", ""

    def _name(self, raw: str) -> tuple[str, str] | None:
        core, rest = trailing(raw)
        if self.full:
            return self._over("Link"), rest
        flat = condense(core).lower()
        return self.mark("Link", host_of(flat), defang(flat, self.limits.defanged_chars)), rest

    def _bare(self, raw: str) -> tuple[str, str] | None:
        flat = condense(trailing(raw)[0]).lower()
        ending = host_of(flat).rpartition(".")[2]
        is_file = ending in FILE_ENDINGS and not any(c in flat for c in "/?#")
        return None if len(ending) < 2 or not ending.isalpha() or is_file else self._name(raw)

    def scrub(self, text: str) -> str:
        """The text with a marker for each link."""
        segments: list[tuple[bool, str]] = [(False, text)]
        for pattern, handler, signs in _PASSES:
            segments = [x for done, part in segments for x in ([(done, part)] if done or not any(s in part for s in signs) else self._split(pattern, getattr(self, handler), part))]
        return "".join(part for _, part in segments).replace("\x00", "")

    @staticmethod
    def _split(pattern: re.Pattern[str], handler: Callable[[str], tuple[str, str] | None], text: str) -> list[tuple[bool, str]]:
        out, at = [], 0
        for m in pattern.finditer(text):
            if (made := handler(m[0])) is None:
                continue
            marker, rest = made
            out += [(False, text[at : m.start()]), (True, marker)]
            at = m.end() - len(rest)
        out.append((False, text[at:]))
        return [x for x in out if x[1]]


#: The passes in order; a text without any of the signs can be spared the pattern.
_PASSES = [(re.compile(p, re.I), h, s) for p, h, s in ((URL, "_url", ":"), (MAILTO, "_mail", ":"), (TEL, "_tel", ":"), (WWW, "_name", "wW"), (DOTTED, "_name", "([{"), (BARE, "_bare", "."))]


def footnote(found: list[str], limit: int = LIMITS.footnote_chars) -> str:
    """The list of links, as far as it fits."""
    if not found:
        return ""
    lines, used = [FOOTNOTE], 0
    for entry in found:
        used += len(entry) + 1
        if used > limit:
            lines.append(SUPPRESSED)
            break
        lines.append(entry)
    return "\n".join(lines)
