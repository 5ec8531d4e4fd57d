"""Toxicity by a weighted lexicon.

Texts are folded first: lower case, compatibility forms, letters of other scripts that look Latin, and
digits or signs that stand for letters (l and i become one letter, as 1 may mean either). An Aho-Corasick
automaton finds the lexicon's word beginnings in the folded text; at each word the longest entry counts,
and an exception phrase of whole words that begins there takes the hit away. The weights of the hits, normalised by the
length of the text, give the score.

Weights are learned: a word beginning of 3 to 12 letters gets the smoothed log-odds of toxic against
clean labelled texts, if these differ by more than chance among so many candidates can explain. At most
``SAMPLE`` labelled rows (those of least hash, a fixed bound) take part; without any, a small built-in
lexicon serves. The lexicon has at most ``ENTRIES`` entries, the strongest ones, so that it stays a fixed size; a word is told by its
first ``LONGEST`` letters. An empty or null text scores 0; a text of any length is scored whole, and rows that repeat a
doc_id are scored each for itself. Labels that are null are left out; a document with
several is toxic if one says so.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Labelled rows to learn from, entries of the lexicon, toxic texts that an entry needs, and the score from which a text is toxic.
SAMPLE, ENTRIES, LEAST, TOXIC = 16_384, 2_000, 3, 0.7
SHORTEST, LONGEST = 3, 12
#: Length, in words, that a text counts as having at least.
FLOOR = 50
#: How often one word of a text counts at most, in learning and in scoring, and the powers of the length that are tried.
REPEATS, POWERS = 2, (0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0)

_LOOKS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ӏ": "i",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ո": "n", "օ": "o", "ս": "u", "ց": "g",
}
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "l": "i"}
_FOLD = str.maketrans(_LOOKS | _DIGITS)
_FOLD_ASCII = str.maketrans(_DIGITS)
_HIDDEN = re.compile("[­​-‏⁠-⁤﻿]")
_INNER = re.compile(r"(?<=[^\W\d_])[$](?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")

#: What counts where nothing is labelled, and phrases in which an entry means no harm.
BUILT_IN = {w: 4.0 for w in ("idiot", "moron", "stupid", "scum", "trash", "loser", "worthless", "pathetic", "disgusting", "clown")}
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "clownfish", "pathetic fallacy", "pond scum", "scumble")


def fold(text: str) -> list[str]:
    """The folded words of a text."""
    text = text.lower()
    if text.isascii():
        text = text.translate(_FOLD_ASCII)
    else:
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text)).lower().translate(_FOLD)
    if "$" in text:
        text = _INNER.sub("s", text)
    return _WORD.findall(text)


class Lexicon:
    """Weighted word beginnings, exception phrases and the evidence at which the score is ``TOXIC``."""

    def __init__(self, weights: dict[str, float], exceptions: Iterable[str] = EXCEPTIONS, cut: float = 0.2, power: float = 0.5) -> None:
        self.weights, self.exceptions, self.cut, self.power = dict(weights), tuple(exceptions), cut, power
        self._automaton: ahocorasick.Automaton | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_automaton": None}

    @property
    def automaton(self) -> ahocorasick.Automaton:
        if self._automaton is None:
            made = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                made.add_word(" " + entry, (len(entry) + 1, weight))
            for phrase in self.exceptions:
                made.add_word(f" {'  '.join(fold(phrase))} ", (0, 0.0))  # whole words
            made.make_automaton()
            self._automaton = made
        return self._automaton

    def hits(self, text: str) -> tuple[Counter, dict[str, float], int]:
        """How often each folded word is hit, its weight, and the number of all words."""
        words = fold(text)
        found: Counter[str] = Counter()
        weights: dict[str, float] = {}
        if words and len(self.automaton):
            line = f" {'  '.join(words)} "  # a blank on each side of every word
            for end, (size, weight) in self.automaton.iter_long(line):
                if weight:
                    word = line[end - size + 2 : line.index(" ", end + 1)]
                    found[word] += 1
                    weights[word] = weight
        return found, weights, len(words)

    def evidence(self, text: str) -> tuple[float, int]:
        """The weights of all hits, a word's repeats up to ``REPEATS``, and the number of words."""
        found, weights, n = self.hits(text)
        return sum(weights[w] * min(k, REPEATS) for w, k in found.items()), max(n, FLOOR)

    def score(self, text: str) -> float:
        """0 without evidence, ``TOXIC`` where evidence by length reaches the cut, towards 1 beyond."""
        found, n = self.evidence(text)
        return 1 - (1 - TOXIC) ** (max(0.0, found) / n**self.power / self.cut)

    def to_json(self) -> str:
        return json.dumps({"weights": self.weights, "exceptions": self.exceptions, "cut": self.cut, "power": self.power})


def _beginnings(words: list[str]) -> Counter:
    """How often each word beginning occurs, repeats of a word up to ``REPEATS``."""
    out: Counter[str] = Counter()
    for w, k in Counter(words).items():
        for n in range(SHORTEST, min(len(w), LONGEST) + 1):
            out[w[:n]] += min(k, REPEATS)
    return out


def _counts(rows: DataFrame) -> DataFrame:
    """Occurrences of each beginning in toxic and clean texts (a, b) and the toxic texts (n) that have it; the empty one counts all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, ...] = (Counter(), Counter(), Counter())

        def out() -> Iterator[pa.RecordBatch]:
            names = list(counts[0].keys() | counts[1].keys())
            for i in range(0, len(names), 50_000):
                some = names[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *(pa.array([c[f] for f in some], pa.int64()) for c in counts)], ["entry", "a", "b", "n"])

        for batch in batches:
            for text, toxic in zip(*batch.columns, strict=True):
                words = fold(text.as_py())
                found = _beginnings(words)
                found[""] = len(words)
                counts[0 if toxic.as_py() else 1].update(found)
                if toxic.as_py():
                    counts[2].update(found.keys())
                if sum(map(len, counts)) > 400_000:
                    yield from out()
                    for c in counts:
                        c.clear()
        yield from out()

    counted = rows.select("text", "toxic").mapInArrow(run, "entry string, a long, b long, n long")
    return counted.groupBy("entry").agg(*(F.sum(c).alias(c) for c in "abn"))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled documents, the same ones each time."""
    one = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return cut(own.join(F.broadcast(chosen), "doc_id").select("text", "toxic"))  # a bounded number of ids; the table is read once


def choose(counted: list[tuple[str, int, int]], toxic: int, clean: int, entries: int = ENTRIES) -> dict[str, float]:
    """Weights of the entries that say most, none of which begins another; the longer of two that say the same."""
    out: dict[str, float] = {}
    begun: set[str] = set()
    for entry, a, b in sorted(counted, key=lambda x: (-_surprise(x[1], x[2], toxic, clean), -len(x[0]), x[0])):
        if entry in begun or any(entry[:n] in out for n in range(SHORTEST, len(entry) + 1)):
            continue
        out[entry] = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
        begun |= {entry[:n] for n in range(SHORTEST, len(entry))}
        if len(out) >= entries:
            break
    return out


def _surprise(a: int, b: int, toxic: int, clean: int) -> float:
    """How unlikely it is, as a negative logarithm, that an entry prefers toxic texts as much by chance."""
    n, p = a + b, toxic / (toxic + clean)
    return sum(k * math.log(k / n / q) for k, q in ((a, p), (b, 1 - p)) if k)


def best_cut(found: list[tuple[float, int, int]]) -> tuple[float, float]:
    """The power of the length and the cut that part toxic from clean (evidence, words, label) with fewest errors, then with the widest gap."""
    best = (math.inf, 0.0, 0.2, 0.5)
    e, n, toxic = (np.array(x, float) for x in zip(*found, strict=True)) if found else (np.zeros(0),) * 3
    for power in POWERS:
        x = e / n**power
        hits, misses = np.sort(x[(toxic == 1) & (x > 0)]), np.sort(x[(toxic == 0) & (x > 0)])
        if not len(hits):
            continue
        seen = np.unique(np.concatenate((hits, misses)))
        below = np.concatenate(([seen[0] / 4], seen[:-1]))
        # a cut just above each value of ``below``: clean texts from it on are wrong, and toxic ones under it
        wrong = np.searchsorted(hits, seen) + len(misses) - np.searchsorted(misses, seen)
        for i in np.flatnonzero(wrong == wrong.min()).tolist():
            best = min(best, (int(wrong[i]), -float(np.log(seen[i] / below[i])), float(np.sqrt(seen[i] * below[i])), power))
    return best[2], best[3]


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, exceptions: Iterable[str] = EXCEPTIONS) -> Lexicon:
    """A lexicon learned from the labelled documents."""
    known = sample(docs, labels, rows)
    counted = _counts(known).where((F.col("n") >= LEAST) | (F.col("entry") == ""))
    total = counted.where("entry = ''").first()
    if total is None or not total.a or not total.b:
        return Lexicon({fold(w)[0]: x for w, x in BUILT_IN.items()}, exceptions)
    toxic, clean = total.a, total.b
    # what no chance explains among the candidates of a length
    p, n = F.lit(toxic / (toxic + clean)), F.col("a") + F.col("b")
    gain = F.col("a") * F.log(F.col("a") / n / p) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / n / (1 - p))).otherwise(0.0)
    likely = counted.where("entry <> ''").where(F.col("a") / n > p).withColumn("gain", gain / REPEATS).withColumn("size", F.length("entry"))
    sizes = likely.groupBy("size").agg((F.log(F.count("*")) + 2).alias("bar"))  # a row for each length
    chosen = likely.join(F.broadcast(sizes), "size").where("gain > bar").orderBy(F.desc("gain"), F.desc("size"), "entry").limit(20 * ENTRIES).select("entry", "a", "b").collect()
    weights = choose([tuple(r) for r in chosen], toxic, clean)
    trial = Lexicon(weights, exceptions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [trial.evidence(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.float64()), pa.array([x for _, x in found], pa.int64()), b.column(1), b.column(2)], ["e", "n", "toxic", "draw"])

    measured = known.withColumn("draw", F.xxhash64("text", "toxic")).mapInArrow(run, "e double, n long, toxic int, draw long")
    found = [tuple(r)[:3] for r in measured.orderBy("draw", "e", "n").limit(rows).collect()]  # ``rows`` at most, also where documents repeat an id
    level, power = best_cut(found)
    return Lexicon(weights, exceptions, level, power)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score, predicted) of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [lexicon.score(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array([int(x >= TOXIC) for x in scores], pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def held_out(doc_id: str = "doc_id"):
    """Rows that labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def not_toxic(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows, all columns as they are, whose text does not reach the toxic score."""
    columns = docs.columns
    text = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array([lexicon.score(str(t.as_py() or "")) < TOXIC for t in b.column(text)], pa.bool_())
            yield b.filter(keep)

    return docs.mapInArrow(run, docs.schema)
