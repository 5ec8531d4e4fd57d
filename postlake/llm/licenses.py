"""Licence scan by diagonal voting.

Every rolling k-gram of words of every text is hashed and joined (in Spark) to the positions of the
k-grams of licence phrases and notices. A hit votes for its diagonal: place in the text less place in the
template. Votes are summed by diagonal; neighbouring diagonals, as words that were put in or left out
leave them, are merged if they lie no further apart than half a notice, so that a notice said again is not taken for more of the first;
and a span counts once the words themselves, compared k-gram by k-gram, agree
with the template. Phrases are short and must stand whole on one diagonal. Notices are longer: they
count when at least ``SHARE`` of their k-grams are found in one merged span that is no longer than the notice over ``SHARE``, or
on one diagonal, whatever lies beside it.

The template table is fixed and small, so the join broadcasts it; the k-grams of a text are hit where they
are made, and only hits reach the shuffle, summed before it. Words are runs of ASCII letters (lower-cased)
and digits and of all characters beyond ASCII. Null texts have no words. Each row is scanned by itself,
also rows that share a doc_id or have none. A long text is scanned whole; its hits of one template are merged in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, flat, slices, windows, word_bounds, word_hashes

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notices that name no phrase or say more than one; labels of their own.
NOTICES = {
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-work": "this work is licensed under the gnu general public license version 3",
    "apache-notice": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-2.0": "licensed under the apache license version 2 0",
    "mit-release": "released under the mit license",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "all-rights-reserved": "copyright all rights reserved no part of this publication may be reproduced",
}

#: Words of the k-grams of phrases and of notices, the share of a notice's k-grams that counts, and how far diagonals of one span are apart.
SHORT, LONG, SHARE, NEAR = 2, 4, 0.6, 8
CHUNK = 1 << 20

_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[97:123] = _INSIDE[128:] = True
_LOWER = np.frombuffer(ASCII_LOWER, np.uint8)


def grams(texts: pa.Array, k: int) -> tuple:
    """Hashes of all k-grams of each text's words by first word (0 where there is none), with the words' bounds."""
    data, at = flat(texts)
    data = _LOWER[data]
    starts, ends, first = word_bounds(data, at, _INSIDE)
    words = word_hashes(data, starts, ends)
    return data, starts, ends, first, words


def _rolling(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that have k words before their text ends, and the hashes there."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    stop = np.repeat(first[1:], np.diff(first))
    i = np.flatnonzero(np.arange(n - k + 1) + k <= stop[: n - k + 1])
    return i, windows(words, k)[i]


def template_rows(phrases: dict[str, str], notices: dict[str, str]) -> list[tuple]:
    """(template, label, is phrase, k-grams in all, place, hash, words) of each template's k-grams."""
    out = []
    for number, (text, label, k) in enumerate([*((p, x, SHORT) for p, x in phrases.items()), *((t, x, LONG) for x, t in notices.items())]):
        data, starts, ends, first, words = grams(pa.array([text]), k)
        if len(words) < k:
            raise ValueError(f"a template has fewer than {k} words: {text}")
        at, hashes = _rolling(words, first, k)
        for i, h in zip(at.tolist(), hashes.view(np.int64).tolist(), strict=True):
            out.append((number, label, k == SHORT, len(at), i, h, " ".join(data[s:e].tobytes().decode() for s, e in zip(starts[i : i + k], ends[i : i + k], strict=True))))
    return out


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, share: float = SHARE) -> DataFrame:
    """The licences of each row.

    doc_id, n_words, n_base (places of phrases), first_word and last_word (their smallest and largest first
    word), base_labels, labels (with those of notices), score (1 with a phrase, else the best notice's
    share) and spans (label, first word, last word, share) of all notices that count.
    """
    spark = docs.sparkSession
    rows = template_rows(phrases, notices)
    table = spark.createDataFrame(rows, "template int, label string, phrase boolean, size int, place int, hash long, words string")
    marks = np.zeros(1 << 16, bool)  # which low bits the templates' hashes have: only there k-grams carry their words for the comparison
    marks[np.array([r[5] for r in rows], np.int64).view(np.uint64) & np.uint64(0xFFFF)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in slices(b, 2, CHUNK):
                data, starts, ends, first, words = grams(piece.column(2), SHORT)
                ids = piece.column(0).to_numpy()
                count = np.diff(first)
                zero = np.zeros(len(ids), np.int64)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(count), pa.array(zero), pa.nulls(len(ids), pa.string())], _NAMES)
                if not len(words):
                    continue
                at = np.searchsorted(first, np.arange(len(words)), "right") - 1
                flatw = None
                for k in (SHORT, LONG):
                    i, h = _rolling(words, first, k)
                    text = [None] * len(i)
                    for x in np.flatnonzero(marks[h & np.uint64(0xFFFF)]).tolist():
                        flatw = data.tobytes() if flatw is None else flatw
                        text[x] = " ".join([flatw[s:e].decode() for s, e in zip(starts[i[x] : i[x] + k].tolist(), ends[i[x] : i[x] + k].tolist(), strict=True)])
                    row = at[i]
                    for z in range(0, len(i), 100_000):
                        c = slice(z, z + 100_000)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[row[c]]), pa.nulls(len(row[c]), pa.int64()), pa.array(i[c] - first[row[c]]), pa.array(h[c].view(np.int64)), pa.array(text[c], pa.string())], _NAMES)

    # a row for each text (words null, place its number of words) and one for each of its k-grams
    all_grams = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, "row long, doc_id long, at long, hash long, gram string")
    joined = all_grams.join(F.broadcast(table), "hash", "left").where("template is not null or (hash = 0 and gram is null)")  # the fixed templates
    votes = joined.groupBy("row", "template", "label", "phrase", "size", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.max("doc_id").alias("doc_id"), F.max("at").alias("at"), F.count("*").alias("votes"), F.count_if(F.col("gram") == F.col("words")).alias("same"),
        F.collect_set(F.when(F.col("gram") == F.col("words"), F.col("place"))).alias("places"),
    )
    # neighbouring diagonals of a notice are one span
    own = Window.partitionBy("row", "template").orderBy("diagonal")
    near = F.least(F.lit(NEAR), F.floor((F.col("size") + LONG - 1) / 2))
    step = F.when(F.col("diagonal") - F.lag("diagonal").over(own) <= near, 0).otherwise(1)
    alone = F.size("places") / F.col("size")
    one = F.struct((F.col("diagonal") + F.array_min("places")).alias("first_word"), (F.col("diagonal") + F.array_max("places") + LONG - 1).alias("last_word"), alone.alias("part"))
    spans = votes.where("same > 0 or template is null").withColumn("step", step).withColumn("span", F.sum("step").over(own))
    merged = spans.groupBy("row", "template", "label", "phrase", "size", "span").agg(
        F.max("doc_id").alias("doc_id"), F.max("at").alias("n"),
        F.count_if((F.col("phrase")) & (F.col("same") == F.col("size"))).alias("found"),
        F.min(F.when(F.col("phrase") & (F.col("same") == F.col("size")), F.col("diagonal"))).alias("low"),
        F.max(F.when(F.col("phrase") & (F.col("same") == F.col("size")), F.col("diagonal"))).alias("high"),
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
        F.min(F.col("diagonal") + F.array_min("places")).alias("from_word"), F.max(F.col("diagonal") + F.array_max("places") + LONG - 1).alias("to_word"),
        F.max(alone).alias("alone"), F.collect_list(F.when(alone >= share, one)).alias("whole"),
    )
    part = F.size("places") / F.col("size")
    # pieces that lie too far apart for the words of one notice are no notice, however many diagonals led from one to the next
    dense = (F.col("to_word") - F.col("from_word") + 1) * share <= F.col("size") + LONG - 1
    counted = merged.withColumn("part", F.when(~F.col("phrase"), F.greatest(F.when(dense, part), F.col("alone")))).withColumn("good", F.when(F.col("phrase"), F.col("found") > 0).otherwise(F.coalesce(F.col("part") >= share, F.lit(False))))
    merged_one = F.array(F.struct(F.col("from_word").alias("first_word"), F.col("to_word").alias("last_word"), part.alias("part")))
    spots = F.transform(F.when(dense & (part >= share), merged_one).otherwise(F.col("whole")), lambda w: F.struct("label", w["first_word"].alias("first_word"), w["last_word"].alias("last_word"), w["part"].alias("part")))
    base = F.coalesce(F.col("phrase"), F.lit(False)) & F.coalesce(F.col("good"), F.lit(False))
    return counted.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max(F.when(F.col("template").isNull(), F.col("n"))).alias("n_words"),
        F.coalesce(F.sum(F.when(base, F.col("found"))), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.when(base, F.col("low"))).alias("first_word"),
        F.max(F.when(base, F.col("high"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("good"), F.col("label")))), ",").alias("labels"),
        F.greatest(F.max(F.when(base, F.lit(1.0))), F.max(F.when(~F.col("phrase"), F.least(F.col("part"), F.lit(1.0)))), F.lit(0.0)).alias("score"),
        F.array_sort(F.flatten(F.collect_list(F.when(~F.col("phrase") & F.col("good"), spots)))).alias("spans"),
    ).drop("row")


_NAMES = ["row", "doc_id", "at", "hash", "gram"]


#: The base columns, by lists of words. A companion of the query, as the method's own labels and score have no SQL.
BASE = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
p AS (
  SELECT string_split(phrase, ' ') AS phrase, label
  FROM (VALUES ('gnu general public license', 'gpl'), ('apache license', 'apache'), ('cc by', 'cc-by'), ('mit license', 'mit')) AS v(phrase, label)),
w AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM d),
h AS (
  SELECT w.doc_id, p.label, w.i - 1 AS spot FROM w JOIN p ON w.words[w.i] = p.phrase[1]
  WHERE list_slice(w.words, w.i, w.i + len(p.phrase) - 1) = p.phrase),
s AS (
  SELECT doc_id, count(*) AS n, min(spot) AS low, max(spot) AS high, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(low AS BIGINT) AS first_word,
       CAST(high AS BIGINT) AS last_word, coalesce(labels, '') AS base_labels
FROM d LEFT JOIN s ON s.doc_id = d.doc_id"""
