"""Chroma audio fingerprints and their alignment.

A recording (WAV, mono 16 bit) becomes pitch-class frames: the spectrum of each frame is folded onto twelve
classes and normalised. Filters over the integral image of time and class compare areas of neighbouring
frames; each of sixteen filters gives two bits, so every frame yields a packed 32-bit integer.

Recordings are aligned by a histogram of offsets, a Spark aggregate: each integer of a query votes with each equal one of another
recording for their offset, unless what lies a filter's span before and behind differs too much. A vote weighs more
the fewer places its integer has. The offsets with at least ``KEEP`` of a query's highest weight are judged, all of them, by the bit errors of
the whole overlap. Still integers, which are equal to both neighbours (silence, held notes), never vote: an offset that only
they agree on is no alignment. All others vote for every query, however many places they have; a vote of a frequent one weighs least.

Recordings with equal fingerprints are one class, told by its smallest id. Recordings that are null, broken or shorter than a
filter have no integers and match nothing; rows without id take no part; of rows that repeat an id the one with the smallest
fingerprint counts. A long recording is fingerprinted in one task, and its votes are spread. Of alignments that
fit alike the class with the smallest id counts, then the smallest offset.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, forget

RATE, FRAME = 4000, 128
#: Frames that a filter spans, and the largest share of wrong bits that is a match.
SPAN, ERRORS = 8, 0.2
CLASSES = 12
#: Places from which an integer's votes are dealt out over tasks, wrong bits of the surroundings (of 32 on each side) up to which two places
#: vote, and the share of the highest weight from which an offset is judged.
RARE, AROUND, KEEP = 256, 10, 0.25
#: Bits of the mark by which most integers that no query holds are left where they are; a full mark costs exchanges, never places.
MARK = 26


def filters() -> list[tuple[int, int, int, int, int]]:
    """(kind, first class, classes, first frame, frames) of the sixteen filters, by rule: kinds and sizes in turn over the octave."""
    return [(i % 4, 3 * i % CLASSES, 3 + i % 4, 0, (2, 4, 6, SPAN)[i // 4]) for i in range(16)]


def chroma(samples: np.ndarray, rate: int = RATE, frame: int = FRAME) -> np.ndarray:
    """Pitch-class energies of each whole frame, of length 1 (all zero for silence)."""
    n = len(samples) // frame
    if not n:
        return np.zeros((0, CLASSES))
    blocks = samples[: n * frame].reshape(n, frame) * np.hanning(frame)
    energy = np.abs(np.fft.rfft(blocks, axis=1)) ** 2
    freq = np.fft.rfftfreq(frame, 1 / rate)
    heard = freq >= 200
    pitch = 12 * np.log2(freq[heard] / 440)
    low = np.floor(pitch).astype(int)
    part = pitch - low
    fold = np.zeros((heard.sum(), CLASSES))
    fold[np.arange(len(low)), low % CLASSES] += 1 - part
    fold[np.arange(len(low)), (low + 1) % CLASSES] += part
    out = energy[:, heard] @ fold
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-9)


def integers(frames: np.ndarray) -> np.ndarray:
    """A packed 32-bit integer for each place where all filters fit."""
    n = len(frames) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    wide = np.concatenate((frames, frames), axis=1)  # classes wrap around
    image = np.zeros((len(frames) + 1, 2 * CLASSES + 1))
    image[1:, 1:] = wide.cumsum(axis=0).cumsum(axis=1)

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        a, b = image[t0 : t0 + n], image[t1 : t1 + n]
        return b[:, c1] - b[:, c0] - a[:, c1] + a[:, c0]

    out = np.zeros(n, np.uint32)
    for kind, c, size, t, length in filters():
        half, mid = length // 2, c + size // 2
        if kind == 0:  # earlier against later
            x, y = area(t, t + half, c, c + size), area(t + half, t + length, c, c + size)
        elif kind == 1:  # lower against higher classes
            x, y = area(t, t + length, c, mid), area(t, t + length, mid, c + size)
        elif kind == 2:  # crosswise
            x = area(t, t + half, c, mid) + area(t + half, t + length, mid, c + size)
            y = area(t, t + half, mid, c + size) + area(t + half, t + length, c, mid)
        else:  # inside against around
            x, y = area(t, t + length, c, c + size), area(t, t + length, c + size, c + CLASSES) * size / (CLASSES - size)
        value = np.log((x + 0.1) / (y + 0.1))
        # two bits in Gray code, so that neighbouring levels differ in one
        level = (value > -0.35).astype(np.uint32) + (value > 0) + (value > 0.35)
        out = out << np.uint32(2) | (level ^ level >> np.uint32(1)).astype(np.uint32)
    return out


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Samples between -1 and 1, and their rate."""
    with wave.open(io.BytesIO(data)) as w:
        if w.getsampwidth() != 2:
            raise wave.Error("16-bit samples are needed")
        if w.getframerate() < 1:
            raise wave.Error("a rate is needed")
        raw = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels())
        return raw.mean(axis=1) / 32768, w.getframerate()


def encode_wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


_TONES = np.sin(2 * np.pi * 440 * 2 ** (np.arange(CLASSES)[:, None] / 12) * np.arange(FRAME)[None, :] / RATE)


def sing(text: str | None) -> bytes:
    """A recording of a text: each word sounds for a frame as three tones that depend on the word."""
    words = (text or "").split()
    h = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)
    chords = [(h >> np.uint64(8 * i)).astype(np.int64) % CLASSES for i in range(3)]
    sound = (_TONES[chords[0]] * 0.5 + _TONES[chords[1]] * 0.3 + _TONES[chords[2]] * 0.15).ravel() if words else np.zeros(0)
    return encode_wav(sound)


def fingerprint(data: bytes | None) -> np.ndarray:
    """The integers of a recording; none if it is null or no WAV."""
    if not data:
        return np.zeros(0, np.uint32)
    try:
        samples, rate = decode_wav(data)
    except (wave.Error, EOFError, ValueError, ArithmeticError):  # ArithmeticError: no channels
        return np.zeros(0, np.uint32)
    return integers(chroma(samples, rate, max(2, FRAME * rate // RATE)))


def fingerprints(rows: DataFrame, key: str, column: str = "media", record: Callable[[object], bytes | None] | None = None) -> DataFrame:
    """(id, prints): little-endian 32-bit integers of each recording. ``record`` makes the recording from the column, if it isn't one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 256):
                piece = b.slice(s, 256)
                data = (x.as_py() for x in piece.column(1))
                made = [fingerprint(record(x) if record else x).astype("<u4").tobytes() for x in data]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(made, pa.binary())], ["id", "prints"])

    own = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), column)
    return own.mapInArrow(run, "id long, prints binary")


def align(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int]:
    """Integers that overlap if b's place i lies at a's place i + offset, and the bits in which they differ."""
    start, stop = max(0, offset), min(len(a), len(b) + offset)
    if stop <= start:
        return 0, 0
    return stop - start, int(np.bitwise_count(a[start:stop] ^ b[start - offset : stop - offset]).sum())


def _bits(x: np.ndarray) -> np.ndarray:
    """The bit of the mark that an integer falls on."""
    return (x.view(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(32 - MARK)


def _places(batches: Iterator[pa.RecordBatch], mark: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """(class, asked, at, value, before, behind) of each integer that is not still and, if a mark is given, falls on a bit of it that is set."""
    for b in batches:
        for c, asked, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            x = np.frombuffer(data.as_py(), "<i4")
            still = np.zeros(len(x), bool)
            still[1:-1] = (x[1:-1] == x[:-2]) & (x[1:-1] == x[2:])
            if mark is not None:
                bit = _bits(x)
                still |= (mark[bit >> np.uint32(3)] >> (bit & np.uint32(7)).astype(np.uint8) & 1) == 0
            for at in np.array_split(np.flatnonzero(~still), len(x) // (1 << 18) + 1):
                if not len(at):
                    continue
                before = pa.array(x[np.maximum(at - SPAN, 0)], mask=at < SPAN)
                behind = pa.array(x[np.minimum(at + SPAN, len(x) - 1)], mask=at + SPAN >= len(x))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c)), pa.array(np.full(len(at), asked)), pa.array(at.astype(np.int32)), pa.array(x[at]), before, behind], ["class", "asked", "at", "value", "before", "behind"])


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, other, offset, votes, overlap, bit_errors) of the best of each pair's offsets, the smallest of equals."""
    for b in batches:
        out = []
        for c, other, offsets, x, y in zip(*(col.to_pylist() for col in b.columns), strict=True):
            x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
            tried = [(*align(x, y, o), o) for o in offsets]
            n, wrong, o = max(tried, key=lambda t: (32 * t[0] - 2 * t[1], -t[2]))
            start = max(0, o)
            out.append((c, other, o, int((x[start : start + n] == y[start - o : start - o + n]).sum()), n, wrong))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True) if out else [()] * 6, kinds, strict=True)], ["class", "other", "offset", "votes", "overlap", "bit_errors"])


def asked_places(classes: DataFrame) -> DataFrame:
    """(class, asked, at, value, before, behind) of each integer of ``classes(class, asked, prints)`` that a query has too: no other one meets any."""
    kind = "class long, asked boolean, at int, value int, before int, behind int"
    rows = classes.select("class", "asked", "prints")
    wanted = cut(rows.where("asked").mapInArrow(_places, kind).select("value").distinct())
    spread = classes.sparkSession.sparkContext.broadcast(_mark(wanted))
    marked = rows.mapInArrow(lambda batches: _places(batches, spread.value), kind)
    made = cut(marked.join(wanted, "value", "left_semi").select("class", "asked", "at", "value", "before", "behind"))
    forget(wanted)
    return made


def _mark(wanted: DataFrame) -> np.ndarray:
    """The bits on which the integers of ``wanted(value)`` fall, eight to a byte; 2 to the power of MARK in all, however many integers there are."""

    def fall(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_bits(b.column(0).to_numpy()).astype(np.int64) + 1)], ["place"])

    bits = wanted.select("value").mapInArrow(fall, "place long")  # Spark counts places from 1
    made = np.zeros(1 << MARK - 3, np.uint8)
    for r in bits.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).toLocalIterator():
        made[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bits, np.uint8)
    return made


def histogram(classes: DataFrame, rare: int = RARE, around: int = AROUND) -> DataFrame:
    """(class, other, offset, weight): the votes of ``classes(class, asked, prints)`` for the offsets of those that are asked for.

    Of an integer with more than ``rare`` places those of queries lie in groups of about ``rare``, each of which meets all its places.
    """
    places = asked_places(classes)
    total = max(1, classes.agg(F.sum(F.length("prints"))).first()[0] or 0) / 4
    counts = places.groupBy("value").agg(F.count("*").alias("n"), F.count_if("asked").alias("q"))
    counts = cut(counts.where("n > 1").select("value", "n", F.when(F.col("n") > rare, F.ceil(F.col("q") / rare)).otherwise(1).alias("parts")))
    asking = places.where("asked").drop("asked").join(counts, "value").withColumn("part", F.pmod(F.xxhash64("class", "at"), F.col("parts")))
    other = places.select(F.col("class").alias("other"), F.col("at").alias("there"), "value", F.col("before").alias("before_there"), F.col("behind").alias("behind_there"))
    # only places of an integer that lies in several groups are repeated
    several = counts.where("parts > 1").select("value", F.sequence(F.lit(0).cast("long"), F.col("parts") - 1).alias("every"))
    other = other.join(several, "value", "left").withColumn("part", F.explode(F.coalesce("every", F.array(F.lit(0).cast("long"))))).drop("every")
    wrong, room = F.lit(0), F.lit(0)
    for side in ("before", "behind"):
        bits = F.bit_count(F.col(side).bitwiseXOR(F.col(f"{side}_there")).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
        wrong, room = wrong + F.coalesce(bits, F.lit(0)), room + F.when(bits.isNotNull(), around).otherwise(0)
    votes = asking.join(other, ["value", "part"]).where((F.col("class") != F.col("other")) & (wrong <= room))
    return votes.groupBy("class", "other", (F.col("at") - F.col("there")).alias("offset")).agg(F.sum(1 + F.log2(F.lit(total) / F.col("n"))).alias("weight"))


def matches(prints: DataFrame, is_query: Column, errors: float = ERRORS, keep: float = KEEP, rare: int = RARE) -> DataFrame:
    """For each recording with ``is_query`` (of id): (id, class_id, n_prints, copies, match_id, offset, votes, overlap, bit_errors, matched).

    ``copies`` counts the recordings of its class, itself included. ``match_id`` is the class whose aligned overlap has the
    most bits right less the wrong ones, among the offsets that lead the histogram; null if nothing votes. ``votes`` counts the
    equal integers of the overlap. ``matched`` says that at most the share ``errors`` of the overlap's bits differ.
    """
    one = prints if prints.groupBy("id").count().where("count > 1").isEmpty() else prints.groupBy("id").agg(F.min("prints").alias("prints"))
    known = cut(one.withColumn("digest", F.sha2("prints", 256)))
    named = cut(known.groupBy("digest").agg(F.min("id").alias("class"), F.count("*").alias("copies")))
    member = cut(known.select("id", "digest", F.length("prints").alias("size")).join(named, "digest").select("id", "class", "copies", "size"))
    wanted = member.where(is_query).select("class").distinct().withColumn("asked", F.lit(True))
    classes = known.join(named.select(F.col("class").alias("id")), "id").where(F.length("prints") > 0).select(F.col("id").alias("class"), "prints")
    classes = cut(classes.join(wanted, "class", "left").select("class", F.coalesce("asked", F.lit(False)).alias("asked"), "prints"))
    forget(known)
    forget(named)

    votes = cut(histogram(classes, rare))
    leads = votes.join(votes.groupBy("class").agg(F.max("weight").alias("most")), "class").where(F.col("weight") >= keep * F.col("most"))
    pairs = leads.groupBy("class", "other").agg(F.collect_list("offset").alias("offsets"))
    own = pairs.join(classes.select("class", F.col("prints").alias("x")), "class")
    both = own.join(classes.select(F.col("class").alias("other"), F.col("prints").alias("y")), "other")
    judged = both.select("class", "other", "offsets", "x", "y").mapInArrow(_judged, "class long, other long, offset int, votes long, overlap long, bit_errors long")
    order = F.struct(32 * F.col("overlap") - 2 * F.col("bit_errors"), -F.col("other"), -F.col("offset"))
    top = judged.groupBy("class").agg(F.max_by(F.struct("other", "offset", "votes", "overlap", "bit_errors"), order).alias("m")).select("class", "m.*")
    out = member.where(is_query).join(top, "class", "left")
    return out.select("id", F.col("class").alias("class_id"), F.expr("size div 4").alias("n_prints"), "copies", F.col("other").alias("match_id"), "offset", "votes", "overlap", "bit_errors", F.coalesce(F.col("bit_errors") <= 32 * F.col("overlap") * errors, F.lit(False)).alias("matched"))
