from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlake.llm import mixing


def test_marginals_and_sample(docs):
    rows = mixing.mix(docs).toPandas()
    assert len(rows) == docs.count()
    mass = rows.weight * rows.n_tokens
    for name, shares in mixing.TARGETS.items():
        got = (mass.groupby(rows[name]).sum() / mass.sum()).to_dict()
        want = shares.of(rows.n_tokens.groupby(rows[name]).sum().to_dict())
        assert got == pytest.approx(want, abs=1e-6)
    assert (rows.probability * rows.n_tokens).sum() == pytest.approx(mixing.KEEP * rows.n_tokens.sum(), rel=1e-6)
    assert mixing.sampled(docs).count() == rows.sampled.sum() and mixing.sampled(docs).columns == docs.columns


def test_rake_against_plain_fitting():
    rng = np.random.default_rng(1)
    table = rng.integers(1, 100, (3, 4)).astype(float)
    codes = [np.repeat(np.arange(3), 4), np.tile(np.arange(4), 3)]
    targets = [np.array([0.5, 0.3, 0.2]), np.array([0.1, 0.2, 0.3, 0.4])]
    x = table / table.sum()
    for _ in range(500):
        x = x * (targets[0] / x.sum(axis=1))[:, None]
        x = x * (targets[1] / x.sum(axis=0))[None, :]
    assert mixing.rake(table.ravel(), codes, targets) == pytest.approx(x.ravel(), abs=1e-8)
    w, n = np.array([3.0, 1.0, 0.1]), np.array([10.0, 50.0, 40.0])
    c = mixing.scale(w, n, 0.5)
    assert (np.minimum(1, c * w) * n).sum() == pytest.approx(50)


def test_spark_rakes_the_same(docs):
    rows = mixing._prepared(docs.select("doc_id", "text", "source", "lang")).drop("text")
    own = {tuple(r[:3]): r[3:] for r in mixing.cell_weights(rows).collect()}
    other = {tuple(r[:3]): r[3:] for r in mixing.cell_weights(rows, most=1).collect()}
    assert own.keys() == other.keys() and all(other[k] == pytest.approx(v, rel=1e-3) for k, v in own.items())


def test_odd_rows(odd, empty):
    assert mixing.mix(odd).count() == 10 and mixing.mix(empty).count() == 0
    kept = mixing.sampled(odd)
    assert kept.columns == odd.columns and kept.count() <= 10 and mixing.sampled(empty).count() == 0
    assert mixing.mix(odd).where(F.col("n_tokens") == 0).count() == 3


def test_null_and_unlisted_languages_stay(spark):
    langs = ["en", "fr", "de", "es", None, "it"]
    df = spark.createDataFrame([(i, "some words in a row " * 5, langs[i % 6], "a") for i in range(600)], "doc_id long, text string, lang string, source string")
    rows = mixing.mix(df).toPandas()
    mass = rows.weight * rows.n_tokens
    for odd in (rows.lang.isna(), rows.lang == "it"):
        assert mass[odd].sum() / mass.sum() == pytest.approx(1 / 6, abs=1e-6) and rows.sampled[odd].any()
    assert mass[rows.lang == "en"].sum() / mass.sum() == pytest.approx(0.55 * 4 / 6, abs=1e-6)
    ready = mixing._prepared(df).drop("text")
    own, other = ({tuple(r[:3]): r.weight for r in mixing.cell_weights(ready, most=n).collect()} for n in (10, 1))
    assert own.keys() == other.keys() and all(other[k] == pytest.approx(v, rel=1e-3) for k, v in own.items())


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_calibrated_sample_meets_the_targets(spark, sf_dir):
    """What is kept by expectation has the targets' shares exactly, what was drawn has them within the draw's own error."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mix(docs, calibrated=True).toPandas()
    assert rows.probability.between(0, 1).all() and rows.probability.max() > 0.99
    kept, n = rows.probability * rows.n_tokens, rows.n_tokens
    assert 0.3 * n.sum() < kept.sum() <= mixing.KEEP * n.sum() * (1 + 1e-6)
    drawn = n * rows.sampled
    for name, shares in mixing.TARGETS.items():
        want = shares.of(n.groupby(rows[name]).sum().to_dict())
        assert (kept.groupby(rows[name]).sum() / kept.sum()).to_dict() == pytest.approx(want, abs=1e-5)
        error = np.sqrt((n**2 * rows.probability * (1 - rows.probability)).sum()) / kept.sum()
        got = (drawn.groupby(rows[name]).sum() / drawn.sum()).to_dict()
        assert all(abs(got.get(v, 0) - s) < 5 * error + 1e-9 for v, s in want.items())
    assert ((rows.weight * n).sum()) == pytest.approx(n.sum(), rel=1e-5)


def test_spark_calibrates_the_same(spark):
    rows = [(i, "a b c d " * (1 + i % 7), ["en", "fr", "de", None][(i * i) % 4], f"s{i % 3}") for i in range(300)]
    ready = mixing._prepared(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).drop("text")
    targets = {"source": mixing.Shares(temper=0.5), "lang": mixing.Shares((("en", 0.4), ("fr", 0.35)))}
    own, other = ({tuple(r[:3]): (r.weight, r.probability) for r in mixing.cell_weights(ready, targets, 0.6, most=n, calibrated=True).collect()} for n in (100, 1))
    assert own.keys() == other.keys() and all(other[k] == pytest.approx(v, rel=1e-4) for k, v in own.items())


def test_calibrated_odd_rows(odd, empty):
    assert mixing.mix(odd, calibrated=True).count() == 10 and mixing.mix(empty, calibrated=True).count() == 0
    assert mixing.sampled(odd, calibrated=True).columns == odd.columns and mixing.sampled(empty, calibrated=True).count() == 0
