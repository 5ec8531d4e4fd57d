from __future__ import annotations

import json

from postlake.plans.mail_queries import extract_json


def test_whole_texts(spark, tmp_path):
    texts = {1: "A whole text, longer than twenty characters: \u00e9 \"quoted\"\nand a second line.", 2: "short", 3: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.json for r in extract_json(spark, str(tmp_path)).collect()}
    assert {k: v and json.loads(v)["headline"] for k, v in found.items()} == texts
