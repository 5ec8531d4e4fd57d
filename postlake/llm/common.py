"""Helpers that the training-data operators share.

Conventions of all operators here: a null text counts as empty; a null ``doc_id`` names no
document, so such a row gets its own result but is never anyone's copy; columns that an
operator does not know are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Bytes A-Z to a-z, all others as they are.
ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Without one in the session, a temporary one serves in local mode only."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="postlake-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._cut = path
    return made


def forget(df: DataFrame) -> None:
    """Delete the table that ``cut`` wrote for ``df``, which nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """``df`` written once into the shared folder, dealt by ``key``: joins by that key then move the other side only."""
    spark = df.sparkSession
    name, n = f"bucketed_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.bucketBy(n, key).option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    return spark.read.table(name)


def offsets(column: pa.Array) -> np.ndarray:
    """The n + 1 offsets of a string or binary array, whichever width they have."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    return np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose strings in ``column`` hold about ``most`` bytes at most; a longer one stands alone."""
    n = batch.num_rows
    if not n:
        return
    sizes = offsets(batch.column(column))
    first = 0
    while first < n:
        last = int(np.searchsorted(sizes, sizes[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield batch.slice(first, last - first)
        first = last


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the n + 1 offsets of its rows; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = offsets(column)
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def word_bounds(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes with ``inside[byte]``, which never cross a row, and the first word of each row (n + 1)."""
    held = inside[data]
    first = held.copy()
    first[1:] &= ~held[:-1]
    edge = at[:-1][at[:-1] < len(data)]
    first[edge] = held[edge]
    last = held.copy()
    last[:-1] &= ~held[1:]
    edge = at[1:] - 1
    edge = edge[edge >= 0]
    last[edge] = held[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


_K = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
SEED = 7


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of SplitMix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each pair (a, b) in this order."""
    return mix((a * _K[0]) ^ ((b + _K[1]) * _K[2]))


def windows(values: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each ``k`` consecutive values, by first place.

    Halves are hashed first and then joined, which is no sum: unlike a polynomial's, its terms can't cancel out.
    """
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, size, level = None, 0, 1, values
    while size <= k:
        if k & size:
            part = level[done : done + n]
            out = part if out is None else joined(out, part)
            done += size
        if 2 * size <= k:
            level = joined(level[:-size], level[size:])
        size *= 2
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH3 (64 bits) of the bytes of each word; a word that repeats is hashed once."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    inside = data[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
    at = np.concatenate(([0], np.cumsum(ends - starts)))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(inside)]).dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w, SEED) for w in words.dictionary.to_pylist()], np.uint64)[words.indices.to_numpy()]


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first ``keys`` (integer) columns, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if s == e:
                continue
            now = tuple(c[s] for c in cols)
            if held and now != key:
                yield pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)
