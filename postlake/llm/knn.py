"""Exact top-k by inner product as a Voronoi join.

Data and queries are grouped by their nearest pivot. Each cell is summarised: its size, its radius and the distances of
its members nearest to the pivot, and the same radius for the queries in it. For a query q = c + s of the cell of pivot
c and a member x = p + t of the cell of pivot p, q.x lies within |c||t| + |s||p| + |s||t| of c.p. So the summaries give
for each cell of queries a score that at least k candidates reach, and the cells of data that can't reach it are left out
for all its queries. Cells that lie side by side are packed into query groups and data blocks (a large cell is split by a
hash of the id), a block travels only to the groups that need it and a query only to the blocks that its cell needs; they
are solved locally, and the blocks' best are merged. Pivots are a bounded sample, more of them the more
rows there are: they decide what is skipped, never the result. Where distances are all alike, as among random vectors of many
dimensions, no bound of this kind can leave anything out, and each block meets each group.

Components are integers (floor of 1024 x). A vector that is null or has null or non-finite components
takes no part, nor one without id. A shorter vector counts as if zeros followed. Rows that repeat a vec_id are
candidates each, for all queries but those of that id, or (``one_each``) the smallest vector counts alone. Scores beyond 64
bits become the nearest long, and tie there. Ties go to the smaller vec_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

K, SCALE = 10, 1024
#: Pivots at least and at most; between them there are as many as the root of the number of rows.
FEWEST, MOST = 64, 1024
#: Data rows and queries that one local problem has, about, and scores that it computes at a time.
BLOCK, QUERIES, SCORES = 16_384, 65_536, 1 << 22
#: Beyond this a sum of products may not be exact in double precision.
EXACT = 2.0**53


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of integers, zeros after the shorter ones."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dims).all():
        return values.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows, exact; those beyond 64 bits become the nearest long."""
    most = [float(np.abs(x.astype(float)).max(initial=0)) for x in (a, b)]
    if most[0] * most[1] * a.shape[1] < EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, 1 - 2**63, 2**63 - 1).astype(np.int64)


def vectors(rows: DataFrame, scale: int = SCALE, one_each: bool = True) -> DataFrame:
    """(vec_id, v): the rows that take part, with integer components."""
    v = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    sound = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    own = rows.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return cut(own.groupBy("vec_id").agg(F.min("v").alias("v")) if one_each else own)


@dataclass
class Summary:
    """Of each cell: its pivot, size, radius, queries and their radius; and the members nearest to their pivots, as (cell, distance, id)."""

    centre: np.ndarray
    size: np.ndarray
    radius: np.ndarray
    asked: np.ndarray
    asked_radius: np.ndarray
    near_cell: np.ndarray
    near: np.ndarray
    near_id: np.ndarray


def needed(s: Summary, k: int) -> np.ndarray:
    """Which cells of data (columns) can hold one of the ``k`` best of a query of each cell (rows)."""
    dots = s.centre @ s.centre.T
    norm = np.sqrt(np.diag(dots))
    bar = np.full(len(dots), -np.inf)
    for g in np.flatnonzero(s.asked):
        sure = dots[g, s.near_cell] - (norm[g] + s.asked_radius[g]) * s.near - s.asked_radius[g] * norm[s.near_cell]
        order = np.argsort(-sure, kind="stable")
        _, first = np.unique(s.near_id[order], return_index=True)  # one of them may be the query itself
        if len(first) > k:
            bar[g] = sure[order][np.sort(first)[k]]
    bar = np.where(bar < -(2.0**63), -np.inf, np.minimum(bar, 2.0**63))  # scores end there and tie
    most = dots + norm[:, None] * s.radius + s.asked_radius[:, None] * (norm + s.radius)
    slack = 1e-9 * (np.abs(dots).max() + np.abs(most).max()) + 1
    return (most >= (bar - slack)[:, None]) & (s.asked > 0)[:, None] & (s.size > 0)


def packed(sizes: np.ndarray, order: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """First pack and number of packs of each cell, and all packs: neighbours in ``order`` share one of about ``most`` rows, a large cell has several."""
    first, pieces = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    now, held = 0, 0
    for c in order.tolist():
        if held and held + sizes[c] > most:
            now, held = now + 1, 0
        first[c] = now
        held += int(sizes[c])
        if sizes[c] > most:
            pieces[c] = -(-int(sizes[c]) // most)
            now, held = now + int(pieces[c]), 0
    return first, pieces, now + 1


def _along(centre: np.ndarray) -> np.ndarray:
    """Cells in the order of their pivots along the direction in which these differ most."""
    apart = centre - centre.mean(axis=0)
    return np.argsort(apart @ np.linalg.svd(apart, full_matrices=False)[2][0], kind="stable")


def top_k(rows: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, pivots: int | None = None, block: int = BLOCK, most_queries: int = QUERIES, one_each: bool = True) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best other vectors for each one with ``is_query`` (of vec_id)."""
    spark = rows.sparkSession
    data = vectors(rows, scale, one_each)
    schema = "query_id long, rank int, vec_id long, score long"
    n, dims, asked = data.agg(F.count("*"), F.max(F.size("v")), F.count_if(is_query)).first()
    if not n or not asked:
        return spark.createDataFrame([], schema)
    dims = max(dims, 1)
    chosen = data.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(pivots or min(MOST, max(FEWEST, math.isqrt(n)))).collect()
    centre = np.zeros((len(chosen), dims))
    for i, r in enumerate(chosen):
        centre[i, : len(r.v)] = r.v
    squares = (centre**2).sum(axis=1)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), dims).astype(float)
            cell = (squares[None, :] - 2 * x @ centre.T).argmin(axis=1) if len(x) else np.zeros(0, np.int64)
            away = np.sqrt(((x - centre[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(away)], ["vec_id", "v", "asks", "cell", "away"])

    grouped = cut(data.withColumn("asks", is_query).mapInArrow(group, "vec_id long, v array<long>, asks boolean, cell int, away double"))
    sizes = grouped.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"), F.count_if("asks").alias("asked"), F.coalesce(F.max(F.when(F.col("asks"), F.col("away"))), F.lit(0.0)).alias("asked_radius")).collect()
    each = grouped.select("cell", "vec_id", "away") if one_each else grouped.groupBy("cell", "vec_id").agg(F.min("away").alias("away"))
    nearest = each.select("cell", "vec_id", "away", F.row_number().over(Window.partitionBy("cell").orderBy("away", "vec_id")).alias("i")).where(F.col("i") <= k + 1).collect()  # k + 1 for each pivot
    columns = [np.zeros(len(centre), t) for t in (np.int64, float, np.int64, float)]
    for r in sizes:
        for c, x in zip(columns, r[1:], strict=True):
            c[r.cell] = x
    summary = Summary(centre, *columns, *(np.array([r[c] for r in nearest]) for c in ("cell", "away", "vec_id")))
    need = needed(summary, k)
    order = _along(centre)
    block_of, block_pieces, n_blocks = packed(summary.size, order, block)
    group_of, group_pieces, n_groups = packed(summary.asked, order, most_queries)

    def meeting(mine: np.ndarray, other_of: np.ndarray, other_pieces: np.ndarray) -> list[np.ndarray]:
        """The packs of the other side that each cell's rows go to."""
        return [np.unique(np.concatenate([[0][:0], *(np.arange(other_of[c], other_of[c] + other_pieces[c]) for c in np.flatnonzero(row))])).astype(np.int32) for row in mine]

    to_blocks = meeting(need, block_of, block_pieces)  # of each cell of queries
    to_groups = meeting(need.T, group_of, group_pieces)  # of each cell of data

    def dealt(own_of: np.ndarray, own_pieces: np.ndarray, goes: list[np.ndarray], queries: bool):
        counts = np.array([len(x) for x in goes])
        every, at = np.concatenate([[0][:0], *goes]).astype(np.int32), np.cumsum(counts) - counts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, cell = b.column(0).to_numpy(), b.column(2).to_numpy()
                own = (own_of[cell] + (ids * 0x9E3779B1 & 0x7FFFFFFF) % own_pieces[cell]).astype(np.int32)
                times = counts[cell]
                i = np.repeat(np.arange(len(ids)), times)
                other = every[np.repeat(at[cell] - np.cumsum(times) + times, times) + np.arange(len(i))]
                for s in range(0, len(i), 2000):
                    c = slice(s, s + 2000)
                    mine, met = pa.array(own[i[c]]), pa.array(other[c])
                    take = pa.array(i[c])
                    yield pa.RecordBatch.from_arrays([mine, met, *(b.column(j).take(take) for j in range(3))] if queries else [met, mine, *(b.column(j).take(take) for j in range(3))], ["pack", "block", "vec_id", "v", "cell"])

        return run

    kind = "pack int, block int, vec_id long, v array<long>, cell int"
    asking = grouped.where("asks").select("vec_id", "v", "cell").mapInArrow(dealt(group_of, group_pieces, to_blocks, True), kind)
    held = grouped.select("vec_id", "v", "cell").mapInArrow(dealt(block_of, block_pieces, to_groups, False), kind)

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[np.ndarray] = [np.zeros((0, 3), np.int64)]
        if left.num_rows and right.num_rows:
            left, right = left.combine_chunks(), right.combine_chunks().sort_by("vec_id")
            ids, cells, x = right["vec_id"].to_numpy(), right["cell"].to_numpy(), matrix(right["v"].chunk(0), dims)
            q_ids, q_cells, q = left["vec_id"].to_numpy(), left["cell"].to_numpy(), matrix(left["v"].chunk(0), dims)
            for g in np.unique(q_cells).tolist():
                there = np.flatnonzero(need[g][cells])  # a cell of queries meets the cells that it needs
                mine = np.flatnonzero(q_cells == g)
                if not len(there):
                    continue
                step = max(1, SCORES // len(there))
                for s in range(0, len(mine), step):
                    some = mine[s : s + step]
                    score = products(q[some], x[there])
                    for i, query in enumerate(q_ids[some].tolist()):
                        at = np.flatnonzero(ids[there] != query)
                        row = score[i]
                        if len(at) > k:
                            best = np.partition(row[at], -k)[-k]
                            at = at[row[at] >= best]
                        at = at[np.lexsort((ids[there][at], -row[at]))][:k] if len(at) else at
                        out.append(np.stack((np.full(len(at), query), ids[there][at], row[at]), axis=1))
        made = np.concatenate(out)
        return pa.table([pa.array(made[:, i]) for i in range(3)], ["query_id", "vec_id", "score"])

    keys = ["pack", "block"]
    local = asking.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(solve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id
  WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
