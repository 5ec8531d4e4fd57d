from __future__ import annotations

import pytest

ODD = "doc_id long, text string, lang string, source string, n_chars long, fp long, `row` string, flags string, topic string, n_words int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows, and columns with operators' own names."""
    line = "Shared words that stand in many documents of this table and are more than twenty words long so that each window of them repeats here."
    rows = [
        (1, line, "en", "a", 1, 7, "x", "f", "t", 1),
        (2, f"Before. {line} After.", "en", "a", 1, None, None, None, None, None),
        (3, None, None, None, None, 1, "y", "g", "u", 2),
        (4, "", "de", "b", 0, 1, "y", "g", "u", 2),
        (5, line, "en", "a", 1, 7, "x", "f", "t", 1),
        (5, line, "en", "a", 1, 7, "x", "f", "t", 1),
        (None, line, "fr", "b", 1, 7, "x", "f", "t", 1),
        (6, "word " * 30_000 + "MIT License", "fr", "b", 1, 7, "x", "f", "t", 1),
        (7, "x" * 50_000, "fr", "b", 1, 7, "x", "f", "t", 1),
        (8, " \t\n ", "fr", "b", 1, 7, "x", "f", "t", 1),
    ]
    return spark.createDataFrame(rows, ODD).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], ODD)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
