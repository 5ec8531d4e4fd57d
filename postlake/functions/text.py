"""Text rules as columns; all of them run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Control and invisible characters that ``clean_controls`` takes out; the exact rule, with NFKC, is ``udfs.clean_text``.
CONTROLS = "[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x9F\\u00AD\\u200B-\\u200F\\u202A-\\u202E\\u2060-\\u2064\\uFEFF]"
TAG_LIKE = r"</?[a-zA-Z][^<>]{0,200}>"
#: Fixed value: characters that foreign text may not have. Plain ones are told first, as most are.
FOREIGN = "[[^\\n\\x20-\\x7E]&&[^ÄÖÜäöüß—–…„“”‘’§·]]"
#: Fixed value: characters that are taken out of names that a server gave.
NAME = "[^0-9A-Za-zÄÖÜäöüß _./-]"
#: Fixed value: phrases that only make sense as orders to a language model.
ORDERS = (
    r"(?:ignore|forget|disregard)\s+(?:all\s+(?:of\s+)?|any\s+|every\s+)?(?:your|the|these|those|my)?\s*(?:previous|prior|above|preceding|earlier)\s+(?:instructions?|rules?|prompts?)"
    r"|(?:ignoriere|ignorieren\s+sie|vergiss|vergessen\s+sie|missachte|missachten\s+sie)\s+(?:alle\s+|sämtliche\s+|saemtliche\s+)?(?:deine\s+|deinen\s+|deiner\s+|ihre\s+|die\s+|den\s+|der\s+)?(?:vorherigen|vorhergehenden|bisherigen|obigen|früheren|frueheren|oberen)\s+(?:anweisungen?|regeln?|vorgaben?|instruktionen?)"
    r"|(?:you\s+are\s+now|du\s+bist\s+(?:ab\s+)?jetzt)\s+(?:ein[e]?\s+|an?\s+|the\s+)?(?:ki|ai|assistent|assistant|sprachmodell|language\s+model|chatbot|bot)"
)


def unix_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def clean_controls(c: Column) -> Column:
    return F.regexp_replace(unix_lines(c), CONTROLS, "")


def controls(c: Column) -> Column:
    """How many characters ``clean_controls`` takes out."""
    return F.regexp_count(unix_lines(c), F.lit(CONTROLS)).cast("long")


def strip_tag_like(c: Column) -> Column:
    return F.regexp_replace(c, TAG_LIKE, " ")


def forged_markers(c: Column, words: tuple[str, str], token: str = "[forged data-block marker removed]") -> tuple[Column, Column]:
    """The text without angle-bracketed chunks that hold both words, and how many there were."""
    a, b = words
    p = rf"(?i)<+(?:[^<>\n]{{0,300}}{a}[^<>\n]{{0,300}}{b}|[^<>\n]{{0,300}}{b}[^<>\n]{{0,300}}{a})[^<>\n]{{0,300}}>+"
    return F.regexp_replace(c, p, F.lit(token)), F.regexp_count(c, F.lit(p)).cast("long")


def one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clamp(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.rtrim(F.left(c, F.lit(limit - 1))), F.lit("…"))).otherwise(c)


def foreign_text(c: Column, limit: int = 400) -> Column:
    return F.left(F.regexp_replace(F.translate(c, "\r\n", "  "), FOREIGN, "·"), F.lit(limit))


def terminal_text(c: Column, limit: int = 4000) -> Column:
    """A finished message for a terminal: foreign characters go, its own line ends stay. A line end is two characters at most, so no more than these are looked at."""
    return F.left(F.regexp_replace(unix_lines(F.left(c, F.lit(2 * limit))), FOREIGN, "·"), F.lit(limit))


def safe_name(c: Column, limit: int = 80) -> Column:
    """A name that a server gave, of plain characters on one line. Each character stands for one, so no more are looked at than the name has."""
    kept = F.left(F.trim(c, F.lit(" \r\n")), F.lit(limit))
    flat = F.regexp_replace(F.translate(kept, "\r\n", "  "), NAME, "·")
    return F.when(F.coalesce(flat, F.lit("")) == "", F.lit("(unnamed)")).otherwise(flat)


def toml_string(c: Column) -> Column:
    """A text as a TOML basic string; such strings are escaped as in JSON, and a delete character too."""
    return F.replace(F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", ""), F.lit("\x7f"), F.lit("\\u007F"))


def notice_subject(c: Column) -> Column:
    flat = one_line(F.regexp_replace(c, r"[^\x20-\x7E]", " "))
    short = F.when(F.length(flat) > 120, F.concat(F.left(flat, F.lit(119)), F.lit("…"))).otherwise(flat)
    return F.when(F.coalesce(short, F.lit("")) == "", F.lit("(no subject)")).otherwise(short)


def label(c: Column) -> Column:
    flat = one_line(F.regexp_replace(F.left(c, F.lit(64)), r"[^\p{L}\p{N}_-]", " "))
    return F.when(flat == "", F.lit("unknown")).otherwise(flat)


def error_class(c: Column) -> Column:
    """Lower case, runs of anything else as one underscore, none at the ends; null if nothing is left."""
    return F.nullif(F.left(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9_]+", "_"), "^_+|_+$", ""), F.lit(64)), F.lit(""))


def size_format(c: Column) -> Column:
    mb = F.regexp_replace(F.format_string("%.1f", F.bround(c / (1024 * 1024), 1)), r"\.", ",")
    return F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B"))).when(c < 1024 * 1024, F.concat(F.bround(c / 1024, 0).cast("long").cast("string"), F.lit(" KB"))).otherwise(F.concat(mb, F.lit(" MB")))


def mask_secrets(c: Column, secrets: list[str], least: int = 8) -> Column:
    """Each secret, and each beginning of it of ``least`` characters or more, longest first, as asterisks."""
    cuts = [s.strip()[:n] for s in secrets if len(s.strip()) >= least for n in range(len(s.strip()), least - 1, -1)]
    return reduce(lambda x, s: F.replace(x, F.lit(s), F.lit("***")), cuts, c)


def has_orders(c: Column) -> Column:
    first = r"(?=[ifdvmyIFDVMY\x{130}\x{131}])"  # all that an order can begin with, told before any word is tried
    return c.rlike(first + "(?iu)(?:" + ORDERS + r")(?![\p{L}\p{N}_])")


def content_words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.lower(c), "ß", "ss"), F.lit("([0-9a-zà-öø-ÿ]{3,})"), F.lit(1)))


def diverges(plain: Column, other: Column, least: int = 5, share: float = 0.5) -> Column:
    words = content_words(other)
    new = F.size(F.array_except(words, content_words(plain)))
    return (new >= least) & (new > share * F.size(words))


def domain_tokens(c: Column) -> Column:
    """Tokens that a client could take for a host and the guard defangs."""
    found = F.regexp_extract_all(c, F.lit(r"([A-Za-z0-9][A-Za-z0-9\-]*(?:\.[A-Za-z0-9\-]+)+)"), F.lit(1))
    return F.filter(found, lambda t: F.exists(F.slice(F.split(t, r"\."), 2, 100), lambda x: x.rlike("^[A-Za-z]{2}")))


def ipv4_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(\d{1,3}(?:\.\d{1,3}){3,})"), F.lit(1))


def defang_dots(c: Column) -> Column:
    return F.replace(c, F.lit("."), F.lit("[.]"))


def mixed_script(host: Column) -> Column:
    """Whether a label has letters of several of the common scripts."""
    scripts = ("Latin", "Cyrillic", "Greek", "Armenian", "Hebrew", "Arabic", "Hangul", "Hiragana", "Katakana", "Han", "Georgian", "Thai")
    several = lambda x: reduce(lambda a, b: a + b, [x.rlike(rf"\p{{Is{s}}}").cast("int") for s in scripts]) > 1
    return F.exists(F.split(host, r"\."), several)
