"""Checks of what an operator types in, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_folder(c: Column) -> Column:
    """An absolute path of plain characters without steps up."""
    return c.rlike(r"^/[A-Za-z0-9._/-]*$") & ~F.array_contains(F.split(c, "/"), "..")


def in_range(c: Column, low: int, high: int) -> Column:
    """The number if it is one within the range, else null."""
    n = F.trim(c).try_cast("long")
    return F.when(n.between(low, high), n)


def instructions(c: Column, most: int = 2000) -> Column:
    """(text, problem): line ends as LF, no space at their ends; control characters are named, too long texts refused."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"[ \t]++(?=\n)", ""), r"^[ \t\n]+|[ \t\n]++$", "")
    bad = F.sort_array(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([\x00-\x08\x0B-\x1F\x7F])"), F.lit(1))))
    named = F.array_join(F.transform(bad, lambda x: F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(x)), 4, "0"))), ", ")
    problem = F.when(F.size(bad) > 0, F.concat(F.lit("control characters: "), named)).when(F.length(text) > most, "too long")
    return F.struct(text.alias("text"), problem.alias("problem"))
