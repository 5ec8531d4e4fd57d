from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from postlake.llm import knn


def brute(vectors: dict[int, list[int]], queries, k=10):
    out = set()
    for q in queries:
        score = sorted((-max(1 - 2**63, min(2**63 - 1, sum(a * b for a, b in zip(vectors[q], v, strict=False)))), i) for i, v in vectors.items() if i != q)[:k]
        out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(score, 1)}
    return out


def test_embeddings(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    vectors = {r.vec_id: [math.floor(1024 * x) for x in r.embedding] for r in rows.collect()}
    for options in ({}, {"pivots": 16, "block": 50, "most_queries": 2}):
        got = knn.top_k(rows, F.col("vec_id") % 100 == 0, **options).collect()
        assert {tuple(r) for r in got} == brute(vectors, [i for i in vectors if i % 100 == 0]) and len(got) == 50


def test_ties_and_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int, cell int, v string"
    same = [(i, [0.5, 0.25], 1, 1, "x") for i in range(1, 40)]
    odd = [(100, [0.5, 0.25], 0, 0, "y"), (200, None, 0, 0, "y"), (300, [], 0, 0, "y"), (400, [1.0], 0, 0, "y"), (None, [9.0, 9.0], 0, 0, "y"), (50, [float("nan"), 1.0], 0, 0, "y"), (51, [None, 1.0], 0, 0, "y"), (52, [float("inf")], 0, 0, "y"), (60, [-1.0, 0.0], 0, 0, "y"), (60, [2.0, 0.0], 0, 0, "y"), (500, [3e38, -3e38], 0, 0, "y")]
    df = spark.createDataFrame(same + odd, schema).repartition(4)
    vectors = {i: [512, 256] for i in range(1, 40)} | {100: [512, 256], 300: [], 400: [1024], 60: [-1024, 0]}
    big = [max(-(2**63), min(2**63 - 1, math.floor(1024 * float(np.float32(x))))) for x in (3e38, -3e38)]
    got = {tuple(r) for r in knn.top_k(df, F.col("vec_id") % 100 == 0, pivots=3, block=7).collect()}
    assert got == brute(vectors | {500: big}, [100, 300, 400, 500])
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in knn.top_k(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2 * 1024**2)]
    assert knn.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_repeated_ids_are_candidates_each(spark):
    """As the SQL has it: all rows but those of the query's own id."""
    import duckdb

    rows = [(100, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [5.0, 0.0]), (8, [0.5, 0.5]), (100, [0.25, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2)
    got = [tuple(r) for r in knn.top_k(df, F.col("vec_id") % 100 == 0, one_each=False).collect()]
    con = duckdb.connect()
    con.sql("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    assert sorted(got) == sorted(con.sql(knn.SQL).fetchall()) and (100, 1, 7, 5 * 1024**2) in got and len(got) == 6


def test_cells_are_left_out_where_vectors_form_clusters(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(0, 1, (20, 8))
    x = np.concatenate([m + rng.normal(0, 0.01, (100, 8)) for m in middle])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    seen = []
    plain = knn.needed
    knn.needed = lambda s, k: seen.append((s, plain(s, k))) or seen[-1][1]
    try:
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = {tuple(r) for r in knn.top_k(df, F.col("vec_id") % 10 == 0, block=200, most_queries=20).collect()}
    finally:
        knn.needed = plain
    assert got == brute({i: [math.floor(1024 * c) for c in v] for i, v in rows}, range(0, 2000, 10))
    s, need = seen[0]
    pairs = (need * s.asked[:, None] * s.size).sum() / s.asked.sum() / s.size.sum()
    assert pairs < 0.3


def test_one_vector_that_many_rows_hold(spark):
    rows = [(i, [0.5, 0.25, -1.0]) for i in range(3000)] + [(i, [i / 5000, 1.0, 0.0]) for i in range(3000, 3300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = {tuple(r) for r in knn.top_k(df, F.col("vec_id") % 1000 == 0, block=100, most_queries=2).collect()}
    assert got == brute({i: [math.floor(1024 * c) for c in v] for i, v in rows}, range(0, 3300, 1000))
