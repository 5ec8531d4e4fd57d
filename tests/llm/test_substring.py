from __future__ import annotations

import hashlib
import random

import pytest

from postlake.llm import substring


def brute(rows, window=20):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out[doc] = (len(words), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize(("block", "hot"), [(50, 4), (100_000, 4), (400, 256)])
def test_against_brute_force(spark, monkeypatch, block, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    random.seed(block)
    base = [" ".join(random.choice("abcdef") for _ in range(random.randrange(5, 60))) for _ in range(12)]
    rows = [(i, "\n ".join(random.choice(base) for _ in range(random.randrange(0, 4)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = substring.without_repeats(df, block=block).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == brute(rows) and len(found) == len(rows)
    assert all(len(r.text.encode().split()) == r.n_words - r.n_removed for r in found)


def test_documents(docs):
    found = substring.without_repeats(docs, texts=False).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(odd, empty):
    out = substring.deduplicated(odd)
    assert out.columns == odd.columns
    rows = sorted(out.collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    texts = [r.text for r in rows]
    assert len(rows) == 10 and texts[0].startswith("Shared words") and texts[1] == "Before. After." and texts[4] == texts[5] == "" and texts[-1].startswith("Shared")
    assert rows[1].n_chars == len("Before. After.") and rows[1].flags is None and rows[0].flags == "f"
    long = next(r for r in rows if r.doc_id == 6)
    assert long.text.split() == ["word", "MIT", "License"]
    assert substring.deduplicated(empty).count() == 0


def thue_morse(n: int, a: str, b: str) -> list[str]:
    return [b if i.bit_count() % 2 else a for i in range(n)]


def test_words_and_runs_that_sums_take_for_equal(spark):
    """Thue-Morse words, and documents whose words follow that pattern, are unlike their opposites."""
    x, y = "".join(thue_morse(1024, "a", "b")), "".join(thue_morse(1024, "b", "a"))
    rest = [f"w{i}" for i in range(19)]
    rows = [(1, " ".join([*rest[:9], x, *rest[9:]])), (2, " ".join([*rest[:9], y, *rest[9:]])), (3, " ".join([*rest[:9], x, *rest[9:]]))]
    rows += [(10, " ".join(thue_morse(4096, "p", "q"))), (11, " ".join(thue_morse(4096, "q", "p")))]
    found = substring.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == brute(rows)
    assert [next(r.n_removed for r in found if r.doc_id == i) for i in (1, 2, 3)] == [0, 0, 20]


def test_long_words(spark):
    random.seed(3)
    long = ["".join(random.choices("ab", k=k)) for k in (1_000, 5_000, 50_000)]
    base = [random.choice([*long, "c", "d"]) for _ in range(60)]
    rows = [(i, " ".join(base[i : i + 40])) for i in range(6)] + [(9, " ".join(w[:-1] + "c" if len(w) == 50_000 else w for w in base))]
    found = substring.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == brute(rows)


def test_paths_are_compacted(spark):
    """Two documents share a passage, which is one path and one span; a third that leaves it halfway makes a node branch."""
    words = [f"w{i}" for i in range(200)]
    docs = [(1, " ".join(words)), (2, " ".join(["x", *words[50:150], "y"]))]
    flags = lambda rows: substring._dealt(substring.all_edges(spark.createDataFrame(rows, "doc_id long, text string").repartition(len(rows)))).mapInArrow(substring._settle, substring._FLAG).cache()
    two = flags(docs)
    paths = substring.compacted(two.where(f"kind = {substring.AGAIN}"))
    assert {r.path for r in paths.collect()} and paths.select("path").distinct().count() == 1
    span = substring.spans(two.where(f"kind = {substring.REPEAT}").drop("kind"), paths).collect()
    assert len(span) == 1 and span[0].doc == 2 and span[0].a == 1 and span[0].b == span[0].start + 49 and 60 < span[0].n <= 81
    rows = [*docs, (3, " ".join([*words[50:100], *(f"z{i}" for i in range(40))])), (4, " ".join([*words[60:100], *(f"z{i}" for i in range(40))]))]
    found = substring.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == brute(rows)


def test_like_sql(docs, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = substring.without_repeats(docs, texts=False).drop("text")
    assert sorted(map(tuple, df.collect())) == sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({substring.SQL})").fetchall())


def test_wide_offsets(spark, docs):
    spark.conf.set("spark.sql.execution.arrow.useLargeVarTypes", "true")
    try:
        found = substring.without_repeats(docs, texts=False).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.useLargeVarTypes")
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == brute([(r.doc_id, r.text) for r in docs.collect()])
