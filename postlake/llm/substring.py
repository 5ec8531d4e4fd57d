"""Substring deduplication by compacting the de Bruijn graph of the corpus.

Edges of the graph are token k-mers, the windows of ``window`` consecutive words; nodes are the runs of one
word less at their ends. The graph of what repeats is built and compacted in steps:

* Consecutive windows that share their minimizer (the least hash among the ``sub``-word runs inside them) travel as
  one edge: a row with the hashes of its two end nodes and its source coordinates (doc_id, first word). Equal windows
  have equal minimizers, so all that can repeat meets by minimizer. Edges that differ under one minimizer are
  broken up into single windows, which meet by their own ends.
* Edges that occur again are the repeated ones. An aggregate counts how many of them enter and leave each node; a
  node with one of each whose edges follow each other in the source too is a joint. A join with the joints says which
  edges open a path, so each nonbranching path becomes one stretch of its source.
* The other places of repeated edges are joined to the paths and put together along them: long spans, each with
  the coordinates of its source.
* The words at a span and at its source must agree (by SHA-256 of the words themselves) before anything is cut.

The texts are dealt out by doc_id once, as a bucketed table; what is asked of them then comes to the texts.

Hot keys: each task first settles what repeats inside its own block of documents, so words that stand in a third of
all documents reach the shuffle once a block. A minimizer that many different edges of a block share is broken up
without further ado, and its edges are dealt out one by one. Words are hashed by XXH3 and runs of words by halves.

Rows with one doc_id are read as parts of one document (coordinates decide, equal ones are not repeats; the digest
tells whose words are meant). Rows without a doc_id neither lose words nor cause a loss. Null texts have no words. A
text of any length is one row and has to fit in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucketed, cut, flat, joined, slices, windows, word_bounds, word_hashes

WINDOW, SUB = 20, 6
#: Bytes of text hashed at once, rows of a block that are compared before the shuffle, and edges of one minimizer in a block from which it counts as hot.
CHUNK, BLOCK, HOT = 1 << 20, 400_000, 256

_SPACE = np.ones(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = False

#: Kinds of rows: an edge seen once in its block, one seen again there, a place that repeats an earlier one, an edge to be broken up
#: (which is seen once, or again), and the word that a minimizer's edges are.
ONCE, AGAIN, REPEAT, BREAK, BREAK_AGAIN, MARK = range(6)
_ROW = "a long, b long, c long, doc long, start int, n int, kind int"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]
_FLAG = "doc long, start int, n int, kind int, a long, b long"
_FLAGS = [x.split()[0] for x in _FLAG.split(", ")]


class Words:
    """The words of some rows, with hashes of their runs."""

    def __init__(self, texts: pa.Array, window: int) -> None:
        self.data, at = flat(texts)
        self.starts, self.ends, self.first = word_bounds(self.data, at, _SPACE)
        self.hashes = word_hashes(self.data, self.starts, self.ends)
        self.nodes = windows(self.hashes, window - 1)


def edges_of(w: Words, window: int, sub: int) -> tuple[np.ndarray, ...]:
    """Row, first word, windows and minimizer of each edge."""
    n, width = len(w.hashes), window - sub + 1
    if n < window:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    order = windows(w.hashes, sub)
    least = np.lib.stride_tricks.sliding_window_view(order, width).argmin(axis=1)
    where = np.arange(len(least)) + least
    stop = np.repeat(w.first[1:], np.diff(w.first))
    i = np.flatnonzero(np.arange(len(least)) + window <= stop[: len(least)])
    if not len(i):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    new = np.flatnonzero(np.concatenate(([True], where[i][1:] != where[i][:-1])))
    first = i[new]
    count = np.diff(np.concatenate((new, [len(i)])))
    return np.searchsorted(w.first, first, "right") - 1, first, count, order[where[first]]


def _changes(columns: Sequence[np.ndarray]) -> np.ndarray:
    """Which rows differ from the one before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _emit(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A block of edges (minimizer, two end nodes, doc, start, windows, seen again): repeats inside it are settled here."""
    minimizer, left, right, doc, start, n, again = rows
    order = np.lexsort((start, doc, n, right, left, minimizer))
    minimizer, left, right, doc, start, n, again = (x[order] for x in rows)
    new = _changes((minimizer, left, right, n))
    first = np.flatnonzero(new)
    if not len(first):
        return
    head = first[np.cumsum(new) - 1]
    later = (doc != doc[head]) | (start != start[head])
    twice = np.logical_or.reduceat(later | again, first)
    # different edges of one minimizer
    _, inverse, many = np.unique(minimizer[first], return_inverse=True, return_counts=True)
    hot = many[inverse] >= HOT
    kind = np.where(hot, BREAK, ONCE) + twice
    out = [x[first] for x in (minimizer, left, right, doc, start, n)] + [kind]
    marks = np.unique(minimizer[first][hot])
    zero = np.zeros(len(marks), np.int64)
    # places that repeat an earlier one: what goes on in the document and in the source is one span
    at = np.flatnonzero(later)
    at = at[np.lexsort((start[at], doc[at]))]
    h = head[at]
    d, s, k, sd, ss = doc[at], start[at].astype(np.int64), n[at].astype(np.int64), doc[h], start[h].astype(np.int64)
    goes_on = np.zeros(len(at), bool)
    goes_on[1:] = (d[1:] == d[:-1]) & (sd[1:] == sd[:-1]) & (s[1:] == s[:-1] + k[:-1]) & (ss[1:] == ss[:-1] + k[:-1])
    opens = np.flatnonzero(~goes_on)
    total = np.add.reduceat(k, opens) if len(opens) else k
    spans = [sd[opens], ss[opens], np.zeros(len(opens), np.int64), d[opens], s[opens], total, np.full(len(opens), REPEAT)]
    columns = [np.concatenate((x.view(np.int64) if x.dtype == np.uint64 else x, m.view(np.int64), r)) for x, m, r in zip(out, (marks, zero, zero, zero, zero, zero, zero + MARK), spans, strict=True)]
    kinds = (np.int64,) * 4 + (np.int32,) * 3
    for i in range(0, len(columns[0]), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 50_000].astype(t)) for x, t in zip(columns, kinds, strict=True)], _NAMES)


def _blocks(parts: Iterator[list[np.ndarray]], block: int) -> Iterator[list[np.ndarray]]:
    held, size = [], 0
    for p in parts:
        held.append(p)
        size += len(p[0])
        if size >= block:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, size = [], 0
    if size:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def all_edges(docs: DataFrame, window: int = WINDOW, sub: int = SUB, block: int = BLOCK) -> DataFrame:
    """The edges of all documents, one row each, less what a block settles alone."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for b in batches:
            for piece in slices(b, 1, CHUNK):
                w = Words(piece.column(1), window)
                row, first, count, minimizer = edges_of(w, window, sub)
                ids = piece.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                yield [minimizer.astype(np.uint64), w.nodes[first], w.nodes[first + count], ids[row], (first - w.first[row]).astype(np.int32), count.astype(np.int32), np.zeros(len(row), bool)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(parts(batches), block):
            yield from _emit(rows)

    return docs.mapInArrow(run, _ROW)


def _flag(*columns: np.ndarray) -> pa.RecordBatch:
    kinds = (np.int64, np.int32, np.int32, np.int32, np.int64, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).astype(t)) for c, t in zip(columns, kinds, strict=True)], _FLAGS)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted edges to flags.

    REPEAT: a place, with its source (a, b). AGAIN: the first place of a repeated edge, with its end nodes. BREAK and
    BREAK_AGAIN: the first place of an edge whose minimizer has others. Only the edge that a batch ends with is held.
    """
    held: list[np.ndarray] | None = None  # that edge as a row
    others = False  # and whether its minimizer is known to have other edges

    def ended(rows: list[np.ndarray], twice: np.ndarray, several: np.ndarray) -> pa.RecordBatch:
        kind = np.where(several, BREAK + twice, np.where(twice, AGAIN, ONCE))
        some = np.flatnonzero((kind != ONCE) & (rows[5] > 0))  # marks have no windows
        return _flag(*(rows[i][some] for i in (3, 4, 5)), kind[some], rows[1][some], rows[2][some])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [c.to_numpy() for c in batch.columns]
        ready = np.flatnonzero((rows[6] == REPEAT) | (rows[6] == BREAK) | (rows[6] == BREAK_AGAIN))
        if len(ready):
            a, b, c, doc, start, n, kind = (x[ready] for x in rows)
            yield _flag(doc, start, n, kind, np.where(kind == REPEAT, a, b), np.where(kind == REPEAT, b, c))
            rest = np.ones(batch.num_rows, bool)
            rest[ready] = False
            rows = [x[rest] for x in rows]
        if not len(rows[0]):
            continue
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        a, b, c, doc, start, n, kind = rows
        new = _changes((a, b, c, n))
        first = np.flatnonzero(new)
        head = first[np.cumsum(new) - 1]
        later = ((doc != doc[head]) | (start != start[head])) & (n > 0)
        twice = np.logical_or.reduceat(later | (kind == AGAIN), first)
        at = np.flatnonzero(later)
        if len(at):
            yield _flag(doc[at], start[at], n[at], np.full(len(at), REPEAT), doc[head[at]], start[head[at]])
        same = a[first][1:] == a[first][:-1]
        before = np.concatenate(([others], same))
        several = before | np.concatenate((same, [False]))
        heads = [x[first] for x in rows]
        yield ended([x[:-1] for x in heads], twice[:-1], several[:-1])
        held = [x[-1:] for x in heads]
        held[6] = np.where(twice[-1:], AGAIN, ONCE) if held[5][0] else held[6]
        others = bool(before[-1])
    if held is not None:
        yield ended(held, held[6] == AGAIN, np.array([others]))


def _dealt(rows: DataFrame) -> DataFrame:
    """By minimizer to partitions, rows that are settled already anywhere; there equal edges together, by coordinates."""
    settled = F.col("kind").isin(REPEAT, BREAK, BREAK_AGAIN)
    return rows.repartition(F.when(settled, F.xxhash64("doc", "start")).otherwise(F.col("a"))).sortWithinPartitions("a", "b", "c", "n", "doc", "start")


def _asked(docs: DataFrame, rows: DataFrame, doc: str, *columns: str, how: str = "inner") -> DataFrame:
    """The documents with what is asked of them, a list in the column ``asked``."""
    own = rows.groupBy(F.col(doc).alias("doc_id")).agg(F.collect_list(F.struct(*columns)).alias("asked"))
    return docs.join(own.hint("shuffle_hash"), "doc_id", how)


def _lists(column: pa.ListArray) -> tuple[np.ndarray, ...]:
    """Row and fields of all entries."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    inner = column.flatten()
    return (np.repeat(np.arange(len(column)), sizes), *(inner.field(i).to_numpy(zero_copy_only=False) for i in range(inner.type.num_fields)))


def single_edges(docs: DataFrame, broken: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Flags of the single windows of edges that are to be broken up."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for b in batches:
            for piece in slices(b, 1, CHUNK):
                w = Words(piece.column(1), window)
                row, start, n, kind, left = _lists(piece.column(2))
                s = w.first[row] + start
                fit = s + n + window - 1 <= w.first[row + 1]
                row, start, n, kind, left, s = (x[fit] for x in (row, start, n, kind, left, s))
                own = w.nodes[s] == left.view(np.uint64)  # rows that share a doc_id may have other words here
                row, start, n, kind, s = (x[own] for x in (row, start, n, kind, s))
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                s, ids = np.repeat(s, n) + step, piece.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                left, right = w.nodes[s], w.nodes[s + 1]
                yield [joined(left, right), left, right, np.repeat(ids[row], n), (np.repeat(start, n) + step).astype(np.int32), np.ones(len(s), np.int32), np.repeat(kind == BREAK_AGAIN, n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(parts(batches), block):
            yield from _emit(rows)

    asked = _asked(docs.select("doc_id", "text"), broken, "doc", "start", "n", "kind", "a")
    return _dealt(asked.mapInArrow(run, _ROW)).mapInArrow(_settle, _FLAG)


def compacted(edges: DataFrame) -> DataFrame:
    """(doc, start, path) of each repeated edge ``edges(doc, start, n, a, b)``: the first word of its nonbranching path in the source.

    ``a`` and ``b`` are the nodes it leaves and enters. A path goes on where a node has one repeated edge in and one
    out, if the second stands right behind the first in the source; where it doesn't, another source begins.
    """
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("leaves"), F.struct("doc", "start").alias("at")).union(edges.select("b", F.lit(0), F.struct("doc", (F.col("start") + F.col("n")).alias("start"))))
    nodes = ends.groupBy("node").agg(F.sum("leaves").alias("out"), F.count("*").alias("degree"), F.min("at").alias("low"), F.max("at").alias("high"))
    joints = nodes.where("degree = 2 and out = 1 and low = high").groupBy(F.col("low.doc").alias("doc"), F.col("low.start").alias("start")).agg(F.lit(True).alias("joint"))
    opened = edges.select("doc", "start").join(joints, ["doc", "start"], "left")
    along = Window.partitionBy("doc").orderBy("start")
    return opened.select("doc", "start", F.last(F.when(F.col("joint").isNull(), F.col("start")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("path"))


def spans(places: DataFrame, paths: DataFrame) -> DataFrame:
    """Long spans (doc, start, n, a, b) from single repeated places: those that follow each other along one path of the source (a, b)."""
    own = places.join(paths.select(F.col("doc").alias("a"), F.col("start").alias("b"), "path").dropDuplicates(["a", "b"]), ["a", "b"], "left").withColumn("path", F.coalesce("path", "b"))
    along = Window.partitionBy("doc").orderBy("start", "a", "b")

    def before(c: Column) -> Column:
        return F.lag(c).over(along)

    follows = (before(F.col("start") + F.col("n")) == F.col("start")) & (before(F.col("a")) == F.col("a")) & (before(F.col("b") + F.col("n")) == F.col("b")) & (before(F.col("path")) == F.col("path"))
    marked = own.withColumn("opens", F.when(follows, 0).otherwise(1)).withColumn("span", F.sum("opens").over(along))
    return marked.groupBy("doc", "span").agg(F.min("start").alias("start"), F.sum("n").cast("int").alias("n"), F.min("a").alias("a"), F.min("b").alias("b")).drop("span")


def digests(docs: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """(a, b, n, digest): SHA-256 of the words at the sources of spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1, CHUNK):
                row, start, n = _lists(piece.column(2))
                ids = piece.column(0).to_numpy(zero_copy_only=False)[row]
                out: list[bytes | None] = []
                last, words = -1, []
                for r, s, k in zip(row.tolist(), start.tolist(), n.tolist(), strict=True):
                    if r != last:
                        last, words = r, piece.column(1)[r].as_py().encode("utf-8").split()
                    out.append(_digest(words, s, k + window - 1))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(out, pa.binary())], ["a", "b", "n", "digest"])

    asked = _asked(docs.select("doc_id", "text"), found.select("a", F.col("b").cast("int").alias("b"), "n").distinct(), "a", "b", "n")
    return asked.mapInArrow(run, "a long, b int, n int, digest binary").where("digest is not null")


def _digest(words: list[bytes], start: int, n: int) -> bytes | None:
    return hashlib.sha256(b" ".join(words[start : start + n])).digest() if start + n <= len(words) else None


def repeats(docs: DataFrame, window: int = WINDOW, sub: int = SUB, block: int = BLOCK) -> DataFrame:
    """(doc, start, n, digest): spans of ``n`` windows that stand earlier too, with the digest of the words there.

    ``docs(doc_id, text)`` is dealt by doc_id and has no nulls.
    """
    flags = cut(_dealt(all_edges(docs.select("doc_id", "text"), window, sub, block)).mapInArrow(_settle, _FLAG))
    single = cut(single_edges(docs, flags.where(F.col("kind").isin(BREAK, BREAK_AGAIN)), window, block))
    both = flags.union(single)
    places = both.where(F.col("kind") == REPEAT).drop("kind")
    found = cut(spans(places, compacted(both.where(F.col("kind") == AGAIN).drop("kind"))))
    source = digests(docs, found, window)
    return found.join(source, ["a", "b", "n"]).select("doc", "start", "n", "digest").distinct()


_CUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, text string"


def _kept_text(raw: bytes, gone: np.ndarray) -> str:
    """The text without the words that are gone; white space before a kept word stays."""
    starts, ends, _ = word_bounds(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), _SPACE)
    stay = ~gone
    opens = np.flatnonzero(stay & ~np.concatenate(([False], stay[:-1])))
    shuts = np.flatnonzero(stay & ~np.concatenate((stay[1:], [False])))
    body = b"".join([raw[(ends[a - 1] if a else 0) : ends[z]] for a, z in zip(opens.tolist(), shuts.tolist(), strict=True)]).decode("utf-8")
    return body.lstrip(" \t\n\r\x0b\x0c") if gone[0] else body


def without_repeats(docs: DataFrame, window: int = WINDOW, sub: int = SUB, block: int = BLOCK, texts: bool = True, carried: Sequence[str] = ()) -> DataFrame:
    """Each row's (doc_id, n_words, n_removed, kept_sha256, text): the text without the words that repeated windows cover.

    The hash is of the kept words with one space between. ``text`` keeps the original white space before
    kept words, is as before where nothing is removed, and is null unless ``texts``. ``carried`` columns
    follow unchanged.
    """
    extra = [f"carried_{i}" for i in range(len(carried))]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *(F.col(c).alias(x) for c, x in zip(carried, extra, strict=True)))
    known = bucketed(own.where("doc_id is not null"), "doc_id")
    found = repeats(known, window, sub, block)
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "text", *extra]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in slices(b, 1, CHUNK):
                out: list[list] = [[], [], [], []]
                row, start, n, digest = _lists(piece.column(2))
                at = np.searchsorted(row, np.arange(piece.num_rows + 1))
                for i, t in enumerate(piece.column(1)):
                    text = t.as_py()
                    raw = text.encode("utf-8")
                    kept = words = raw.split()
                    depth = np.zeros(len(words) + 1, np.int64)
                    mine = slice(at[i], at[i + 1])
                    for s, k, d in zip(start[mine].tolist(), n[mine].tolist(), digest[mine], strict=True):
                        if _digest(words, s, k + window - 1) == d:
                            depth[s] += 1
                            depth[s + k + window - 1] -= 1
                    gone = np.cumsum(depth[:-1]) > 0
                    lost = int(gone.sum())
                    if lost:
                        kept = list(compress(words, (~gone).tolist()))
                        text = _kept_text(raw, gone) if texts else None
                    for c, x in zip(out, (len(words), lost, hashlib.sha256(b" ".join(kept)).hexdigest(), text if texts else None), strict=True):
                        c.append(x)
                yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True)), *piece.columns[3:]], names)

    schema = T.StructType([*T.StructType.fromDDL(_CUT).fields, *(own.schema[c] for c in extra)])
    asked = _asked(known, found, "doc", "start", "n", "digest", how="left").select("doc_id", "text", "asked", *extra)
    nobody = own.where("doc_id is null").select("doc_id", "text", F.lit(None).cast(asked.schema["asked"].dataType).alias("asked"), *extra)
    made = asked.mapInArrow(run, schema).union(nobody.mapInArrow(run, schema))
    return made.select(*names[:5], *(F.col(x).alias(c) for x, c in zip(extra, carried, strict=True)))


def deduplicated(docs: DataFrame, window: int = WINDOW, sub: int = SUB, block: int = BLOCK) -> DataFrame:
    """The rows with their own columns; ``text`` has lost what repeats, ``n_chars`` (if there) follows it. Rows without a doc_id stay as they are."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    plain = docs.select("doc_id", "text", *(F.col(c).alias(f"own_{i}") for i, c in enumerate(others)))  # their names may clash with the operator's
    made = without_repeats(plain, window, sub, block, carried=plain.columns[2:]).drop("n_words", "n_removed", "kept_sha256")
    made = made.select("doc_id", "text", *(F.col(f"own_{i}").alias(c) for i, c in enumerate(others)))
    columns = [F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c).cast(docs.schema[c].dataType).alias(c) for c in docs.columns]
    return made.select(*columns)


#: Word lists themselves, not hashes of them, tell which windows repeat.
SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
w AS (
  SELECT doc_id, i AS start, list_slice(words, i, i + 19) AS run
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM d WHERE len(words) >= 20)),
later AS (
  SELECT doc_id, start, row_number() OVER (PARTITION BY run ORDER BY doc_id, start) AS place FROM w),
gone AS (
  SELECT DISTINCT doc_id, start + k AS at FROM later, (SELECT unnest(range(0, 20)) AS k) WHERE place > 1),
every AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS at FROM d),
cut AS (
  SELECT e.doc_id, count(g.at) AS n_removed, coalesce(string_agg(CASE WHEN g.at IS NULL THEN e.word END, ' ' ORDER BY e.at), '') AS kept
  FROM every e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.at = e.at GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id"""
