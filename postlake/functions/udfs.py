"""Arrow UDFs for what SQL can't say, each a thin cover of a kernel; ``register`` names them in SQL.

A batch is walked a few rows at a time: besides Arrow's own bytes no more than these rows are held as Python objects.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, LongType, StringType, StructType

from ..kernels import attachments, html, links, model, output, text

#: Rows of a batch that are Python objects at a time.
STEP = 64


def _struct(**fields: DataType) -> StructType:
    """Types by name; DDL strings would need a session when this module is imported."""
    out = StructType()
    for name, kind in fields.items():
        out = out.add(name, kind)
    return out


_TEXT, _LONG, _INT, _FLAG = StringType(), LongType(), IntegerType(), BooleanType()
_LINK = _struct(link_no=_INT, kind=_TEXT, host=_TEXT, defanged=_TEXT, is_punycode=_FLAG, unicode_host=_TEXT, is_mixed_script=_FLAG, capped=_FLAG)


def _stepped(one: Callable, kind: DataType, *columns: pa.Array) -> pa.Array:
    """What ``one`` gives for each row; a tuple for a struct."""
    arrow, names = to_arrow_type(kind), kind.names if isinstance(kind, StructType) else None
    made = []
    for i in range(0, len(columns[0]), STEP):
        rows = (one(*x) for x in zip(*(c.slice(i, STEP).to_pylist() for c in columns), strict=True))
        made.append(pa.array([dict(zip(names, r, strict=True)) for r in rows] if names else list(rows), arrow))
    return pa.concat_arrays(made) if made else pa.array([], arrow)


def _udf(kind: DataType):
    """A kernel of one value as a function of columns."""

    def add(one: Callable):
        def run(s: pa.Array) -> pa.Array:
            return _stepped(one, kind, s)

        return arrow_udf(run, kind)

    return add


def _strings(f: Callable[[str], str | None]):
    return _udf(_TEXT)(lambda x: None if x is None else f(x))


@_udf(_struct(text=_TEXT, removed=_LONG))
def clean_text(x: str | None) -> tuple:
    return text.clean_text(x or "")


@_udf(_struct(text=_TEXT, hidden=_LONG, rejected=_TEXT))
def html_to_text(x: str | None) -> tuple:
    try:
        return (*html.html_to_text(text.clean_text(x or "")[0]), None)
    except html.TooComplex as e:
        return None, 0, str(e)


@_udf(_struct(text=_TEXT, removed=_LONG, links=ArrayType(_LINK)))
def scrub_links(x: str | None) -> tuple:
    found = links.Links()
    out = found.scrub(x or "")
    return out, found.removed, found.facts


def _detect_kind(declared: pa.Array, data: pa.Array) -> pa.Array:
    return _stepped(lambda a, b: attachments.detect_kind(a or "", b or b""), _TEXT, declared, data)


def _split_parts(s: pa.Array, limit: pa.Array) -> pa.Array:
    return _stepped(lambda x, n: output.finalize(x or "", n), ArrayType(_TEXT), s, limit)


detect_kind = arrow_udf(_detect_kind, _TEXT)
split_parts = arrow_udf(_split_parts, ArrayType(_TEXT))


@_udf(_struct(text=_TEXT, suspicious=_FLAG))
def scrub_model_text(x: str | None) -> tuple:
    return model.scrub_text(x or "")


@_udf(_FLAG)
def is_mixed_script(x: str | None) -> bool:
    return text.is_mixed_script(x or "")


final_guard = _strings(output.final_guard)
scrub_field = _strings(output.scrub_field)
scrub_plain = _strings(output.scrub_plain)
neutralize_markup = _strings(output.neutralize_markup)
unescape_entities = _strings(text.unescape)
host_of = _strings(links.host_of)
canonical_url = _strings(links.canonical)
defang = _strings(links.defang)
punycode_unicode = _strings(links.punycode_unicode)
sanitize_filename = _strings(attachments.sanitize_filename)
extract_json = _strings(model.extract_object)

NAMES = (
    "clean_text", "html_to_text", "scrub_links", "detect_kind", "split_parts", "scrub_model_text", "is_mixed_script", "final_guard", "scrub_field", "scrub_plain",
    "neutralize_markup", "unescape_entities", "host_of", "canonical_url", "defang", "punycode_unicode", "sanitize_filename", "extract_json",
)


def register(spark: SparkSession) -> None:
    """All functions under their names in SQL."""
    for name in NAMES:
        spark.udf.register(name, globals()[name])
