"""Each stage against brute force on its own input, and the whole run."""

from __future__ import annotations

import corpus_pipeline
from postlake.llm import mixing, simhash, toxicity
from postlake.llm.common import cut

from .test_near import jaccard
from .test_substring import brute as repeated


def test_stages(spark, sf, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash", "substring", "mixing", "bpe"] and corpus_pipeline.ORACLE_SQL is None
    columns, steps = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut(stage(spark, docs, sf))
        steps[name] = before.collect(), docs.collect()
        assert name == "bpe" or docs.columns == columns

    before, after = steps["toxicity"]
    lexicon = toxicity.learn(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").where(~toxicity.held_out()))
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if lexicon.score(r.text) < toxicity.TOXIC)

    before, after = steps["simhash"]
    texts, kept = {r.doc_id: r.text for r in before}, {r.doc_id for r in after}
    near = {(a, b) for a in texts for b in texts if a < b and jaccard(texts[a], texts[b]) >= simhash.SIMILARITY}
    assert kept <= set(texts) and all(any((a, b) in near for a in kept) for b in set(texts) - kept)  # what goes is a near copy of what stays
    assert len(set(texts) - kept) >= 0.9 * len({b for _, b in near} - {b for b in kept if not any((a, b) in near for a in kept)}) > 0

    before, after = steps["substring"]
    want = repeated([(r.doc_id, r.text) for r in before])
    assert len(after) == len(before) and all(len(r.text.encode().split()) == want[r.doc_id][0] - want[r.doc_id][1] and r.n_chars == len(r.text) for r in after)

    before, after = steps["mixing"]
    kept = {r.doc_id: r.text for r in after}
    assert kept.items() <= {r.doc_id: r.text for r in before}.items() and 0.4 < sum(map(len, kept.values())) / sum(len(r.text) for r in before) < 0.95
    assert mixing.KEEP == 0.7

    before, after = steps["bpe"]
    assert sorted(r.doc_id for r in before) == sorted(r.doc_id for r in after) and all(r.n_tokens * 4 == len(r.ids) for r in after)
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf).collect()} == {r.doc_id: r.ids_sha256 for r in after}


def test_empty_documents(spark, sf, docs):
    docs = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_odd_rows_through_all_stages(spark, sf, odd):
    """Nulls, repeated ids with unlike texts, a long text and clashing columns: no stage fails, and all but the last keep the columns."""
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, sf))
        assert name == "bpe" or docs.columns == odd.columns
    assert docs.count() <= 10
