from __future__ import annotations

import numpy as np

from postlake.llm import media


def noisy(text: str, seed: int = 0) -> bytes:
    samples, rate = media.decode_wav(media.sing(text))
    return media.encode_wav(samples + np.random.default_rng(seed).normal(0, 0.01, len(samples)), rate)


def words(n: int, seed: int) -> str:
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 500, n))


def test_integral_image_filters():
    frames = media.chroma(*media.decode_wav(media.sing(words(30, 1))))
    assert frames.shape == (30, 12) and np.allclose(np.linalg.norm(frames, axis=1), 1)
    n = len(media.integers(frames))
    assert n == 30 - media.SPAN + 1 and len(media.filters()) == 16
    kind, c, size, t, length = media.filters()[4]
    wide = np.concatenate((frames, frames), axis=1)
    value = np.log((wide[0 : length // 2, c : c + size].sum() + 0.1) / (wide[length // 2 : length, c : c + size].sum() + 0.1))
    level = int(value > -0.35) + int(value > 0) + int(value > 0.35)
    assert kind == 0 and media.integers(frames)[0] >> 22 & 3 == level ^ level >> 1


def test_noise_keeps_most_bits_and_offset():
    a, b = media.fingerprint(media.sing(words(80, 2))), media.fingerprint(noisy(words(80, 2)))
    n, wrong = media.align(a, b, 0)
    assert n == len(a) and wrong < 0.1 * 32 * n
    other = media.fingerprint(media.sing(words(80, 3)))
    assert media.align(a, other, 0)[1] > 0.25 * 32 * n


def test_matches(spark):
    texts = {20: words(60, 1), 21: words(60, 1), 40: words(90, 2), 3: "lead in words " + words(90, 2) + " tail", 60: words(50, 4), 5: None, 80: "", 7: words(60, 1), 100: words(70, 9)}
    rows = [(k, media.sing(t) if t is not None else None) for k, t in texts.items()] + [(120, b"no wav"), (None, media.sing("x")), (21, media.sing(words(60, 1))), (9, noisy(words(70, 9)))]
    df = spark.createDataFrame(rows, "id long, media binary, run int, class int".replace(", run int, class int", ""))
    from pyspark.sql import functions as F

    found = {r.id: r for r in media.matches(media.fingerprints(df, "id"), F.col("id") % 20 == 0).collect()}
    assert sorted(found) == [20, 40, 60, 80, 100, 120]
    assert found[20].class_id == 7 and found[20].copies == 3 and found[20].match_id is None
    assert found[40].match_id == 3 and found[40].offset == -3 and found[40].matched and found[40].bit_errors == 0
    assert found[60].match_id is None and not found[60].matched and found[80].n_prints == 0 and found[120].n_prints == 0
    assert media.matches(media.fingerprints(df.limit(0), "id"), F.col("id") % 20 == 0).count() == 0


def test_recall_against_brute_force(spark):
    """Each query that a noisy, shifted copy stands for among others is found by it."""
    from pyspark.sql import functions as F

    rows = [(i, media.sing(words(60, i))) for i in range(0, 200, 20)] + [(i + 1, noisy("before it " * (i % 3) + words(60, i), i)) for i in range(0, 200, 20)] + [(1000 + i, media.sing(words(60, 1000 + i))) for i in range(50)]
    prints = media.fingerprints(spark.createDataFrame(rows, "id long, media binary"), "id").cache()
    every = {r.id: np.frombuffer(r.prints, "<u4") for r in prints.collect()}

    def best(q):
        def score(k, o):
            n, wrong = media.align(every[q], every[k], o)
            return 32 * n - 2 * wrong

        return max((score(k, o), -k) for k in every if k != q for o in range(-8, 9))[1] * -1

    got = {r.id: r.match_id for r in media.matches(prints, (F.col("id") % 20 == 0) & (F.col("id") < 1000)).collect()}
    assert sum(got[q] == best(q) for q in got) >= 0.9 * len(got)


def test_passages_that_many_recordings_hold(spark):
    """All that a query shares with its near copy stands in two smaller recordings as well."""
    from pyspark.sql import functions as F

    whole = words(90, 900).split()
    first, last = " ".join(whole[:60]), " ".join(whole[30:])
    texts = {i: f"{first} {words(40, i)}" for i in (1, 2)} | {i: f"{words(40, i)} {last}" for i in (3, 4)} | {20: " ".join(whole), 500: f"well then {' '.join(whole)} and more"}
    prints = media.fingerprints(spark.createDataFrame([(k, media.sing(t)) for k, t in texts.items()], "id long, media binary"), "id")
    found = media.matches(prints, F.col("id") == 20).first()
    assert (found.match_id, found.offset, found.overlap, found.bit_errors, found.matched) == (500, -2, 83, 0, True)


def whole_search(every: dict, q: int) -> tuple:
    """The best alignment (other, offset) over all recordings and offsets."""

    def score(k, o):
        n, wrong = media.align(every[q], every[k], o)
        return 32 * n - 2 * wrong, -k, -o

    best = max(score(k, o) for k in every if k != q for o in range(-len(every[k]) + 1, len(every[q])))
    return -best[1], -best[2]


def test_copies_near_the_limit(spark):
    """Copies with a word changed every 7 or 8 frames, and with noise, up to the share of wrong bits that is a match."""
    from pyspark.sql import functions as F

    rows = []
    for i in range(0, 80, 20):
        own = words(200, i).split()
        rows.append((i, media.sing(" ".join(own))))
        if i < 40:
            rows.append((i + 1, media.sing(" ".join(f"x{j}" if j % (8 - i // 20) == 0 else w for j, w in enumerate(own)))))
        else:
            samples, rate = media.decode_wav(rows[-1][1])
            rows.append((i + 1, media.encode_wav(samples + np.random.default_rng(i).normal(0, 0.2 + 0.1 * (i == 60), len(samples)), rate)))
    prints = media.fingerprints(spark.createDataFrame(rows, "id long, media binary"), "id").cache()
    every = {r.id: np.frombuffer(r.prints, "<u4") for r in prints.collect()}
    got = {r.id: r for r in media.matches(prints, F.col("id") % 20 == 0).collect()}
    assert {q: (r.match_id, r.offset) for q, r in got.items()} == {q: whole_search(every, q) for q in got} == {q: (q + 1, 0) for q in got}
    assert all(r.matched for r in got.values()) and max(r.bit_errors / r.overlap / 32 for r in got.values()) > 0.12


def test_repeated_passages(spark):
    """Of a passage that stands twice in a recording the later place counts too."""
    from pyspark.sql import functions as F

    refrain, end = words(60, 700), words(30, 701)
    rows = [(20, media.sing(f"{refrain} {end}")), (500, media.sing(f"{refrain} {refrain} {end}"))]
    found = media.matches(media.fingerprints(spark.createDataFrame(rows, "id long, media binary"), "id"), F.col("id") == 20).first()
    assert (found.match_id, found.offset, found.overlap, found.bit_errors, found.matched) == (500, -60, 83, 0, True)


def test_broken_recordings_are_no_failure(spark):
    """Rates and channels of zero, cut off files, and columns named like the operator's own."""
    from pyspark.sql import functions as F

    good = media.sing(words(60, 5))
    zero_rate = good[:24] + bytes(4) + good[28:]
    no_channels = good[:22] + bytes(2) + good[24:]
    rows = [(20, good, 1, 2, "x"), (1, good, 1, 2, "x"), (40, zero_rate, 1, 2, "x"), (60, no_channels, None, None, None), (80, good[:50], 1, 2, "x"), (100, good[:10], 1, 2, "x")]
    df = spark.createDataFrame(rows, "id long, media binary, `class` int, copies int, prints string")
    found = {r.id: r for r in media.matches(media.fingerprints(df, "id"), F.col("id") % 20 == 0).collect()}
    assert sorted(found) == [20, 40, 60, 80, 100] and found[20].class_id == 1 and found[20].copies == 2
    assert all(found[i].n_prints == 0 and found[i].match_id is None for i in (40, 60, 80, 100))


def test_recall_of_the_query(spark, sf):
    """op7_media itself against a search of all offsets of all recordings."""
    from postlake.llm.queries import op7_media

    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    talks: dict = {}
    for r in sorted((r for r in rows if r.conv_id is not None), key=lambda r: (r.turn, r.role, r.text or "")):
        talks.setdefault(r.conv_id, []).append(r.text or "")
    every = {k: media.fingerprint(media.sing("\n".join(v))) for k, v in talks.items()}
    got = op7_media(spark, sf).collect()
    assert sorted(r.conv_id for r in got) == sorted(k for k in every if k % 20 == 0)
    right = asked = 0
    for r in got:
        own = {k: p for k, p in every.items() if len(p) and (k == r.conv_id or p.tobytes() != every[r.conv_id].tobytes())}
        if not len(every[r.conv_id]) or len(own) < 2:
            continue
        other, offset = whole_search(own, r.conv_id)
        n, wrong = media.align(own[r.conv_id], own[other], offset)
        if n and wrong <= 32 * n * media.ERRORS:
            asked += 1
            right += r.match_id is not None and (r.overlap, r.bit_errors) == (n, wrong)
    assert right >= 0.9 * asked


def talks_of(spark, sf) -> dict:
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    talks: dict = {}
    for r in sorted((r for r in rows if r.conv_id is not None), key=lambda r: (r.turn, r.role, r.text or "")):
        talks.setdefault(r.conv_id, []).append(r.text or "")
    return {k: " ".join(v) for k, v in talks.items()}


def test_recall_of_planted_copies(spark, sf):
    """Among the sung conversations: copies with noise, with words changed, shifted, and of a part only."""
    from pyspark.sql import functions as F

    talks = {k: t for k, t in sorted(talks_of(spark, sf).items()) if len(t.split()) >= 60}
    assert len(talks) >= 12
    rows, dice = [(k, media.sing(t)) for k, t in talks.items()], np.random.default_rng(11)
    for n, (k, t) in enumerate(list(talks.items())[:40]):
        w = t.split()
        if n % 4 == 1:
            w = ["well", "then"] * (n % 9) + w
        if n % 4 == 2:
            w = [f"other{i}" if i % 9 == 4 else x for i, x in enumerate(w)]
        if n % 4 == 3:
            w = w[len(w) // 5 :]
        samples, rate = media.decode_wav(media.sing(" ".join(w)))
        rows.append((1_000_000 + 20 * k, media.encode_wav(samples + dice.normal(0, 0.1 * (n % 3), len(samples)), rate)))
    prints = media.fingerprints(spark.createDataFrame(rows, "id long, media binary"), "id").cache()
    every = {r.id: np.frombuffer(r.prints, "<u4") for r in prints.collect()}
    got = {r.id: r for r in media.matches(prints, F.col("id") >= 1_000_000).collect()}
    right = asked = 0
    for q, r in got.items():
        own = {k: p for k, p in every.items() if k == q or p.tobytes() != every[q].tobytes()}
        other, offset = whole_search(own, q)
        n, wrong = media.align(own[q], own[other], offset)
        if wrong <= 32 * n * media.ERRORS and other == (q - 1_000_000) // 20:
            asked += 1
            right += r.match_id is not None and (r.overlap, r.bit_errors) == (n, wrong)
    assert asked >= 12 and right >= 0.9 * asked


def test_silence_costs_nothing(spark):
    """Recordings that all begin with the same long silence vote as often as those without."""
    from pyspark.sql import functions as F

    def votes(silent):
        lead = np.zeros(silent * media.FRAME)
        rows = []
        for i in range(60):
            samples, rate = media.decode_wav(media.sing(words(60, i // 2 * 2)))
            tail = np.random.default_rng(i).normal(0, 0.05, len(samples)) * (i % 2)
            rows.append((i, media.encode_wav(np.concatenate((lead, samples + tail)), rate)))
        prints = media.fingerprints(spark.createDataFrame(rows, "id long, media binary"), "id").cache()
        classes = prints.select(F.col("id").alias("class"), (F.col("id") % 20 == 0).alias("asked"), "prints")
        found = {r.id: r for r in media.matches(prints, F.col("id") % 20 == 0).collect()}
        assert {q: (r.match_id, r.offset) for q, r in found.items()} == {q: (q + 1, 0) for q in found} and len(found) == 3
        return media.histogram(classes).count()

    assert votes(400) <= votes(0) + 4 * 3 * 60  # a few where the silence ends, and not one for each two of its frames


def test_hot_integers(spark):
    """A group of near copies in which every integer is hot: its queries still find their nearest."""
    from pyspark.sql import functions as F

    samples, rate = media.decode_wav(media.sing(words(120, 77)))
    rows = [(i, media.encode_wav(samples + np.random.default_rng(i).normal(0, 0.02 + 0.001 * i, len(samples)), rate)) for i in range(60)]
    rows += [(1000 + i, media.sing(words(80, 500 + i))) for i in range(20)]
    prints = media.fingerprints(spark.createDataFrame(rows, "id long, media binary"), "id").cache()
    every = {r.id: np.frombuffer(r.prints, "<u4") for r in prints.collect()}
    got = {r.id: r for r in media.matches(prints, F.col("id").isin(0, 20, 40), rare=5).collect()}
    for q, r in got.items():
        other, offset = whole_search({k: p for k, p in every.items() if k < 60 and (k == q or p.tobytes() != every[q].tobytes())}, q)
        n, wrong = media.align(every[q], every[other], offset)
        assert (r.overlap, r.bit_errors) == (n, wrong) and r.matched
    # and a passage that many hold doesn't vote where rarer integers do
    shared = words(40, 900)
    more = [(i, media.sing(f"{words(60, 2000 + i)} {shared}")) for i in range(30)] + [(30, media.sing(f"lead {words(60, 2000)} {shared}"))]
    prints = media.fingerprints(spark.createDataFrame(more, "id long, media binary"), "id")
    found = media.matches(prints, F.col("id") == 0, rare=5).first()
    assert (found.match_id, found.offset, found.bit_errors) == (30, -1, 0)


def test_still_integers_never_vote():
    import pyarrow as pa

    x = np.array([7] * 20 + [1, 2, 3], np.int32)
    batch = pa.RecordBatch.from_arrays([pa.array([5]), pa.array([True]), pa.array([x.tobytes()])], ["class", "asked", "prints"])
    (out,) = media._places(iter([batch]))
    assert out.column(2).to_pylist() == [0, 19, 20, 21, 22] and out.column(3).to_pylist() == [7, 7, 1, 2, 3]
    assert out.column(4).to_pylist()[:2] == [None, 7] and out.column(5).to_pylist() == [7, None, None, None, None]


def test_frequent_integers_vote_for_every_query(spark):
    """A passage that all hold and that is a small part of each is all that they share; its offsets are found for all pairs."""
    from pyspark.sql import functions as F

    shared = words(20, 900)
    rows = [(i, media.sing(f"{words(40 + i, 3000 + i)} {shared} {words(40, 4000 + i)}")) for i in range(12)]
    prints = media.fingerprints(spark.createDataFrame(rows, "id long, media binary"), "id")
    classes = prints.select(F.col("id").alias("class"), (F.col("id") == 0).alias("asked"), "prints").cache()
    few, many = ({(r["class"], r.other, r.offset): round(r.weight, 6) for r in media.histogram(classes, rare=n).collect()} for n in (2, 1000))
    assert few == many and {(0, i, -i) for i in range(1, 12)} <= set(few)


def test_only_places_that_queries_ask_for_travel(spark):
    """Integers of which no query has an equal one reach no exchange; all places of the others do, and their votes are those of all pairs."""
    from collections import Counter

    from pyspark.sql import functions as F

    rows = [(i, media.sing(f"{words(30 + i, 5000 + i)} {words(20, 5100 + i % 2)}")) for i in range(10)]
    prints = media.fingerprints(spark.createDataFrame(rows, "id long, media binary"), "id")
    classes = prints.select(F.col("id").alias("class"), (F.col("id") == 0).alias("asked"), "prints").cache()
    every = {r["class"]: np.frombuffer(r.prints, "<i4") for r in classes.collect()}
    own = Counter(every[0].tolist())
    got = media.asked_places(classes).collect()
    assert sorted((r["class"], r.at, r.value) for r in got) == sorted((c, i, v) for c, x in every.items() for i, v in enumerate(x.tolist()) if v in own)
    assert 0 < len(got) < 0.5 * sum(map(len, every.values()))
    votes = {(r.other, r.offset) for r in media.histogram(classes).collect()}
    assert {(i, -i) for i in range(2, 10, 2)} <= votes <= {(c, i - j) for c, x in every.items() if c for i, v in enumerate(every[0].tolist()) for j, w in enumerate(x.tolist()) if v == w}


def test_mark_of_the_integers_that_queries_hold(spark):
    """Integers of which no query has an equal one are nearly all left out before any exchange, and no other one is."""
    import pyarrow as pa

    rng = np.random.default_rng(21)
    asked, others = rng.integers(-(1 << 31), 1 << 31, 5000).astype(np.int32), rng.integers(-(1 << 31), 1 << 31, 50_000).astype(np.int32)
    mark = media._mark(spark.createDataFrame([(int(v),) for v in [*asked, 0, -1, -(1 << 31), (1 << 31) - 1]], "value int").repartition(3))
    x = np.concatenate((others, asked, np.array([0, -1, -(1 << 31), (1 << 31) - 1], np.int32)))
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([False]), pa.array([x.astype("<i4").tobytes()], pa.binary())], ["class", "asked", "prints"])
    every, left = (pa.Table.from_batches(list(media._places([batch], m))).to_pylist() for m in (None, mark))
    wanted = {int(v) for v in x[50_000:]}
    assert [r for r in every if r["value"] in wanted] == [r for r in left if r["value"] in wanted]
    assert len(every) == len(x) and len(left) < len(wanted) + 100 and all(r in every[: len(x)] for r in left[:5])
