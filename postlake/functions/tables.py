"""Table functions for SQL: a mail's parts and links beside its row, and claims over a partitioned table; ``register`` names them.

``SELECT m.path, p.* FROM messages m, LATERAL mail_parts(m.content) p``; what a function needs of its argument is checked when the
query is analysed. ``claim_arrivals(TABLE(arrivals))`` says itself that it wants the rows of a key together and in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BinaryType, DataType, IntegerType, LongType, NullType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..kernels import mime
from ..limits import LIMITS


def _fields(**kinds: DataType) -> StructType:
    out = StructType()
    for name, kind in kinds.items():
        out = out.add(name, kind)
    return out


_TEXT, _INT, _LONG = StringType(), IntegerType(), LongType()


def _checked(content: AnalyzeArgument, fields: StructType) -> AnalyzeResult:
    if content.isTable or not isinstance(content.dataType, BinaryType | NullType):
        raise ValueError(f"the content of a message is binary, not {content.dataType.simpleString()}")
    return AnalyzeResult(fields)


class MailParts:
    """The MIME parts of a message, without their content."""

    @staticmethod
    def analyze(content: AnalyzeArgument) -> AnalyzeResult:
        return _checked(content, _fields(part_no=_INT, depth=_INT, ctype=_TEXT, disposition=_TEXT, filename=_TEXT, role=_TEXT, size=_LONG))

    def eval(self, content: bytes | None) -> Iterator[tuple]:
        for p in mime.parts_of(bytes(content or b""), LIMITS)[0]:
            yield p.part_no, p.depth, p.ctype, p.disposition, p.filename, p.role, len(p.data)


class MailLinks:
    """The links that a message lists once it is safe; none of one that can't be read."""

    @staticmethod
    def analyze(content: AnalyzeArgument) -> AnalyzeResult:
        return _checked(content, _fields(link_no=_INT, defanged=_TEXT))

    def eval(self, content: bytes | None) -> Iterator[tuple]:
        raw = mime.raw_mail(bytes(content or b""), LIMITS)
        try:
            found = [] if raw["ingest_failed"] else mime.sanitize(raw, LIMITS)["links_found"]
        except Exception:  # noqa: BLE001  fail closed, one mail at a time
            found = []
        for entry in found:
            number, _, link = entry.partition(": ")
            yield int(number[1:]), link


class ClaimArrivals:
    """Rows (key, content, arrival) to (key_hash, arrival, result), as ``state.claim`` says, in memory that does not grow with a key.

    A key is one task's; where one may hold a large share of the rows, ``state.claim`` splits it.
    """

    def __init__(self) -> None:
        self.first = True
        self.known: str | None = None

    @staticmethod
    def analyze(arrivals: AnalyzeArgument) -> AnalyzeResult:
        names = arrivals.dataType.names if arrivals.isTable and arrivals.dataType is not None else []
        if not {"key", "content", "arrival"} <= set(names):
            raise ValueError("a table with key, content and arrival is needed")
        fields = _fields(key_hash=_TEXT, arrival=_LONG, result=_TEXT)
        return AnalyzeResult(fields, partitionBy=[PartitioningColumn("key")], orderBy=[OrderingColumn("arrival")])

    def eval(self, row: Row) -> Iterator[tuple]:
        if self.first:
            result, self.first, self.known = "CLAIMED", False, row["content"]
        else:
            same = self.known is None or row["content"] is None or self.known == row["content"]
            result = "DUPLICATE" if same else "COLLISION"
        yield hashlib.sha256((row["key"] or "").encode()).hexdigest(), row["arrival"], result


FUNCTIONS = {"mail_parts": MailParts, "mail_links": MailLinks, "claim_arrivals": ClaimArrivals}


def register(spark: SparkSession) -> None:
    """All table functions under their names in SQL."""
    for name, made in FUNCTIONS.items():
        spark.udtf.register(name, udtf(made))
