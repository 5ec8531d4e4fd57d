"""URL rules as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trailing(c: Column) -> tuple[Column, Column]:
    """The link and the punctuation after it."""
    core = F.regexp_replace(c, r"[.,;:!?]+$", "")
    return core, F.substring(c, F.length(core) + 1, F.length(c))


def canonical(c: Column) -> Column:
    flat = F.regexp_replace(F.regexp_replace(c, r"\s+", ""), r"(?i)\((?:\.|dot)\)|\[(?:\.|dot)\]|\{(?:\.|dot)\}", ".")
    return F.lower(F.regexp_replace(F.regexp_replace(flat, r"(?i)^(?:%68|h)(?:%74|t|x)(?:%74|t|x)(?:%70|p)(?:%73|s)", "https"), r"(?i)^(?:%68|h)(?:%74|t|x)(?:%74|t|x)(?:%70|p)(?![s])", "http"))


def host_of(url: Column) -> Column:
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"^.*?://", "")).otherwise(url)
    name = F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^.*@", "")
    name = F.lower(F.regexp_replace(F.regexp_replace(name, r":\d+$", ""), r"^\.+|\.+$", ""))
    short = F.when(name.startswith("www.") & (F.regexp_count(name, F.lit(r"\.")) >= 2), F.substring(name, F.lit(5), F.length(name))).otherwise(name)
    return F.when(short == "", F.lit("unknown")).otherwise(short)


def defang(url: Column, limit: int = 300) -> Column:
    out = F.translate(url, "`*|~\\", "")
    for pattern, new in ((r"^https", "hxxps"), (r"^http\b", "hxxp"), (r"^ftp", "fxp"), (r"^mailto:", "mailto[:]")):
        out = F.regexp_replace(out, pattern, new)
    out = F.replace(F.replace(out, F.lit("://"), F.lit("[:]//")), F.lit("."), F.lit("[.]"))
    return F.when(F.length(out) > limit, F.concat(F.left(out, F.lit(limit)), F.lit("…"))).otherwise(out)


def suffixes(host: Column) -> Column:
    """The host and all its parent domains, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def is_global_ipv4(c: Column) -> Column:
    """Not loopback, link-local, unspecified or private; null if it is no address."""
    p = F.transform(F.split(c, r"\."), lambda x: x.try_cast("int"))
    a, b = p[0], p[1]
    valid = (F.size(p) == 4) & F.forall(p, lambda x: F.coalesce(x.between(0, 255), F.lit(False)))
    inside = (a == 10) | (a == 127) | (a == 0) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127))
    return F.when(valid, ~inside)


def valid_domain(c: Column, labels: int = 3) -> Column:
    """Whether a name can be a mail host: ASCII, no punycode, enough labels of the right form."""
    name = F.lower(F.regexp_replace(F.trim(c), r"\.$", ""))
    parts = F.split(name, r"\.")
    return (F.length(name) <= 253) & ~F.contains(name, F.lit("xn--")) & (F.size(parts) >= labels) & F.forall(parts, lambda x: x.rlike(r"^[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?$"))
