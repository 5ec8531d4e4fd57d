from __future__ import annotations

import re

from postlake.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += found
        labels |= {label} if found else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def seen(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels


def test_documents(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = licenses.scan(docs).collect()
    assert len(rows) == len(texts) and all(seen(r) == brute(texts[r.doc_id]) for r in rows)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in rows)


def test_spans_with_edits(spark):
    notice = licenses.NOTICES["bsd-text"]
    broken = notice.replace("source and", "source code and").replace("provided that", "provided")
    rows = [(1, "GNU General Public License; GNU General GNU General\nPublic-License MIT license cc by CC-BY"), (2, f"Head words here. {broken.title()} tail"), (3, " ".join(notice.split()[:6])), (4, " ".join(reversed(notice.split())))]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(seen(found[i]) == brute(t) for i, t in rows)
    assert found[2].labels == "bsd-text" and found[2].spans[0].first_word == 3 and 0.6 <= found[2].score < 1
    assert found[3].labels == "" and 0 < found[3].score < 0.6 and found[4].score == 0.0


def test_odd_rows(odd, empty):
    rows = licenses.scan(odd).collect()
    want = sorted(str((r.doc_id, brute(r.text))) for r in odd.collect())
    assert sorted(str((r.doc_id, seen(r))) for r in rows) == want and licenses.scan(empty).count() == 0


def test_spans_start_and_end_where_their_words_do(spark):
    """Words put in near both ends move the ends' diagonals apart."""
    notice = licenses.NOTICES["isc-text"].split()
    words = ["head", *notice[:6], "one", "two", *notice[6:-6], "three", *notice[-6:], "tail"]
    scattered = " ".join(" ".join(notice[i : i + 5]) + " x" * 40 for i in range(0, len(notice), 5))
    rows = [(1, " ".join(words)), (2, scattered), (3, " ".join(notice[2:] + notice))]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    span = found[1].spans[0]
    assert (span.label, span.first_word, span.last_word) == ("isc-text", 1, len(words) - 2) and found[2].labels == ""


def test_labels_against_word_lists(spark, docs):
    """Notices by plain comparison of words: those that stand whole have their label, and no label comes without most of their 4-grams."""
    rows = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for r in docs.collect():
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        line, labels = f" {' '.join(words)} ", set(filter(None, rows[r.doc_id].labels.split(",")))
        grams = {tuple(words[i : i + 4]) for i in range(len(words) - 3)}
        for label, notice in licenses.NOTICES.items():
            own = notice.split()
            share = sum(tuple(own[i : i + 4]) in grams for i in range(len(own) - 3)) / (len(own) - 3)
            assert label in labels or f" {notice} " not in line, (r.doc_id, label)
            assert label not in labels or share >= licenses.SHARE, (r.doc_id, label)
            assert share == 0 or label in labels or share <= 1
        assert rows[r.doc_id].score == 1 or not rows[r.doc_id].base_labels


def test_notices_said_again(spark):
    """Each notice two and three times in a row, side by side and apart, with a word changed, put in or left out in one of them."""
    rows, want = [], {}

    def put(text, labels):
        want[len(rows)] = set(labels)
        rows.append((len(rows), text))

    for label, notice in licenses.NOTICES.items():
        words = notice.split()
        for times in (1, 2, 3):
            for between in ("", " x", " some words that lie between them"):
                put((notice + between + " ") * times, [label])
        if len(words) >= 16:
            mid = len(words) // 2
            for edited in (words[:mid] + ["new"] + words[mid:], words[:mid] + words[mid + 1 :], words[:mid] + ["other"] + words[mid + 1 :]):
                put(f"{notice} {' '.join(edited)}", [label])
                put(f"{' '.join(edited)} {' '.join(edited)}", [label])
                put(f"{' '.join(edited)} {notice} {' '.join(edited)}", [label])
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        assert want[i] <= set(found[i].labels.split(",")), text
        assert seen(found[i]) == brute(text)
        line = f" {text} ".replace("  ", " ")
        for label, notice in licenses.NOTICES.items():  # a label stands where its words do
            if label in found[i].labels.split(",") and label not in want[i]:
                assert f" {notice} " in line
        spans = [s for s in found[i].spans if s.label in want[i]]
        words = WORD.findall(text)
        assert spans and all(0 <= s.first_word <= s.last_word < len(words) and s.part >= licenses.SHARE for s in spans)
        whole = [j for label in want[i] for j in range(len(words)) if words[j : j + len(licenses.NOTICES[label].split())] == licenses.NOTICES[label].split()]
        assert {s.first_word for s in spans} >= set(whole)


def test_like_sql(spark, sf):
    import duckdb

    from postlake.llm.queries import licenses_base

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = licenses_base(spark, sf)
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, con.sql(f"SELECT {', '.join(df.columns)} FROM ({licenses.SQL})").fetchall()))
    assert df.where("n_base > 0").count() > 0
