"""Byte-level BPE through a minimal acyclic transducer.

The frequent pieces of the corpus (counted over all documents by Spark) are encoded once and compiled
into a minimal acyclic automaton whose equal suffixes are shared. Its paths number the words in byte
order, and the number leads to the word's ids. Each Python worker maps the compiled file into memory and
looks up all new pieces of a batch at once; pieces that the lexicon lacks are merged exactly, so the
lexicon decides how fast a text is encoded and never how.

A null text is an empty one: no ids. Added tokens of the vocabulary are found in texts first, as the
vocabulary's own library does.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import struct
import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

#: Words of the lexicon and the longest of them in bytes; pieces that a worker remembers; bytes of text at once.
LEXICON, LONGEST, REMEMBERED, CHUNK = 50_000, 48, 500_000, 1 << 20
#: Bits of an id within a pair of two, and what no merge has.
BITS, NONE = 24, 1 << 62
#: The splitting rule of byte-level BPE vocabularies (a fixed value); letters come first, as most pieces are words and no other rule can match where they do.
PATTERN = r" ?\p{L}+| ?\p{N}+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _slot(pairs: np.ndarray, size: int) -> np.ndarray:
    return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())).astype(np.int64)


class Bpe:
    """A vocabulary read from a tokenizer file's JSON."""

    def __init__(self, source: bytes) -> None:
        spec = json.loads(source)
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a byte-level BPE vocabulary without normalizer and prefix space is needed")
        chars, vocab = byte_characters(), spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens that take in their surroundings are not supported")
        size = max([*vocab.values(), *added.values()]) + 1
        self.pieces: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.pieces[i] = bytes(chars[c] for c in token)
        for token, i in added.items():
            self.pieces[i] = token.encode()
        self.of_byte = [vocab[c] for c, _ in sorted(chars.items(), key=lambda x: x[1])]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merges = {vocab[a] << BITS | vocab[b]: rank << BITS | vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        self.added = added
        self.split_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.split = regex.compile(PATTERN)
        self._slots: tuple[np.ndarray, np.ndarray] | None = None

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece: again and again the adjacent pair of least rank becomes one, the leftmost first."""
        return self._long([self.of_byte[b] for b in piece])

    def _table(self) -> tuple[np.ndarray, np.ndarray]:
        """The merges as a hash table in arrays, filled at most to a quarter."""
        if self._slots is None:
            size = 1 << max(4, (4 * len(self.merges)).bit_length())
            keys, values = np.full(size, -1, np.int64), np.full(size, NONE, np.int64)
            pairs = np.fromiter(self.merges, np.int64, len(self.merges))
            for key, at in zip(pairs.tolist(), _slot(pairs, size).tolist(), strict=True):
                while keys[at] >= 0:
                    at = (at + 1) % size
                keys[at], values[at] = key, self.merges[key]
            self._slots = keys, values
        return self._slots

    def _found(self, pairs: np.ndarray) -> np.ndarray:
        """Rank and result of each pair's merge, NONE without one."""
        keys, values = self._table()
        out, at, open_ = np.full(len(pairs), NONE), _slot(pairs, len(keys)), np.arange(len(pairs))
        while len(open_):
            here = keys[at[open_]]
            hit = here == pairs[open_]
            out[open_[hit]] = values[at[open_[hit]]]
            open_ = open_[~hit & (here >= 0)]
            at[open_] = (at[open_] + 1) % len(keys)
        return out

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of many pieces, as bytes: all take their next merge at the same time."""
        out = [b""] * len(pieces)
        for i, p in enumerate(pieces):
            if len(p) > LONGEST:
                out[i] = np.array(self.merge(p), "<u4").tobytes()
        words = np.array([i for i, p in enumerate(pieces) if 0 < len(p) <= LONGEST], np.int64)
        if not len(words):
            return out
        some = [pieces[i] for i in words.tolist()]
        counts = np.fromiter(map(len, some), np.int64, len(some))
        ids = np.array(self.of_byte, np.int64)[np.frombuffer(b"".join(some), np.uint8)]
        starts = np.cumsum(counts) - counts
        pairs = np.full(len(ids), NONE)
        inner = np.ones(len(ids), bool)
        inner[starts + counts - 1] = False
        at = np.flatnonzero(inner)
        pairs[at] = self._found(ids[at] << BITS | ids[at + 1])
        while len(words):
            best = np.minimum.reduceat(pairs, starts)
            going = best < NONE
            if not going.all():
                done = np.flatnonzero(~going)
                stay = np.repeat(going, counts)
                raw, ends = ids[~stay].astype("<u4").tobytes(), np.cumsum(counts[done]).tolist()
                for w, s, e in zip(words[done].tolist(), [0, *ends], ends, strict=False):
                    out[w] = raw[4 * s : 4 * e]
                ids, pairs = ids[stay], pairs[stay]
                words, counts, best = words[going], counts[going], best[going]
                starts = np.cumsum(counts) - counts
                if not len(words):
                    break
            same = np.flatnonzero(pairs == np.repeat(best, counts))
            owner = np.searchsorted(starts, same, "right") - 1
            at = same[np.concatenate(([True], owner[1:] != owner[:-1]))]
            ids[at] = best & (1 << BITS) - 1
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids, pairs = ids[stay], pairs[stay]
            at -= np.arange(len(at))
            counts = counts - 1
            starts = np.cumsum(counts) - counts
            pairs[at] = NONE
            right, left = at[at < starts + counts - 1], at[at > starts] - 1
            for x in (right, left):
                pairs[x] = self._found(ids[x] << BITS | ids[x + 1])
        return out

    def _long(self, ids: list[int]) -> list[int]:
        merges, n = self.merges, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get(ids[i] << BITS | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            best, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = best & (1 << BITS) - 1, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (m := merges.get(ids[x] << BITS | ids[y])) is not None:
                    heapq.heappush(heap, (m, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def parts(self, text: str) -> Iterable[tuple[str, bool]]:
        """The text between added tokens, and these."""
        if self.split_added is None or not any(t in text for t in self.added):
            return ((text, False),)
        return ((x, i % 2 == 1) for i, x in enumerate(self.split_added.split(text)))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of little-endian 32-bit ids."""
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def compile_lexicon(words: Iterable[bytes], outputs: dict[bytes, list[int]]) -> bytes:
    """The minimal acyclic automaton of the words, with their ids, as one block of bytes.

    Words are added in byte order; as soon as a branch can get no more words, its states are replaced by
    equal ones that are registered already. A transition stores how many words stand before its own.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []
    sizes: list[int] = []

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if (i := register.get(key)) is None:
            i = register[key] = len(states)
            states.append(key)
            sizes.append(int(node[0]) + sum(sizes[t] for _, t in node[1]))
        return i

    ordered = sorted(set(words))
    path: list[list] = [[False, []]]  # open states of the last word; each has the finished transitions and that which leads on
    last = b""

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(node)))

    for word in ordered:
        common = len(os.path.commonprefix([word, last]))
        close(common)
        path.extend([False, []] for _ in range(len(word) - common))
        path[-1][0] = True
        last = word
    close(0)
    root = settle(path[0])
    keys, targets, skips = [], [], []
    for i, (final, moves) in enumerate(states):
        seen = int(final)
        for byte, target in moves:
            keys.append(i * 256 + byte)
            targets.append(target)
            skips.append(seen)
            seen += sizes[target]
    ids = [outputs[w] for w in ordered]
    arrays = [np.array(keys, np.int64), np.array(targets, np.int64), np.array(skips, np.int64), np.array([f for f, _ in states], np.int64), np.cumsum([0, *map(len, ids)]).astype(np.int64), np.array([x for i in ids for x in i], "<i8")]
    return struct.pack("<7q", root, *map(len, arrays)) + b"".join(x.tobytes() for x in arrays)


class Lexicon:
    """A compiled lexicon, mapped from a file that no one else needs."""

    def __init__(self, block: bytes) -> None:
        with tempfile.TemporaryFile() as f:  # gone as soon as the mapping is
            f.write(block)
            f.flush()
            self.map = mmap.mmap(f.fileno(), len(block), access=mmap.ACCESS_READ)
        head = struct.unpack_from("<7q", self.map)
        self.root, at, views = head[0], 56, []
        for n in head[1:]:
            views.append(np.frombuffer(self.map, np.int64, n, at))
            at += 8 * n
        self.keys, self.targets, self.skips, self.final, self.offsets, self.ids = views

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for those that are not in the lexicon."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        number, state = np.zeros(len(words), np.int64), np.full(len(words), self.root)
        if not len(self.keys):
            return np.full(len(words), -1)
        data = np.frombuffer(b"".join(words), np.uint8)
        at = np.cumsum(sizes) - sizes
        alive = np.flatnonzero((sizes > 0) & (sizes <= LONGEST))
        out = np.full(len(words), -1)
        for j in range(LONGEST + 1):
            done = sizes[alive] == j
            ends = alive[done]
            good = ends[self.final[state[ends]] == 1]
            out[good] = number[good]
            alive = alive[~done]
            if not len(alive):
                break
            key = state[alive] * 256 + data[at[alive] + j]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[k] == key
            alive, k = alive[hit], k[hit]
            number[alive] += self.skips[k]
            state[alive] = self.targets[k]
        return out

    def output(self, number: int) -> bytes:
        return self.ids[self.offsets[number] : self.offsets[number + 1]].astype("<u4").tobytes()


class Encoder:
    """Encodes texts, with a bounded memory of pieces seen before."""

    def __init__(self, bpe: Bpe, lexicon: Lexicon | None) -> None:
        self.bpe, self.lexicon = bpe, lexicon
        self.known: dict[str, bytes] = {}

    def learn(self, pieces: Iterable[str]) -> None:
        new = [p for p in pieces if p not in self.known]
        raw = [p.encode() for p in new]
        numbers = self.lexicon.find(raw).tolist() if self.lexicon is not None and new else [-1] * len(new)
        fresh = iter(self.bpe.merge_all([b for b, n in zip(raw, numbers, strict=True) if n < 0]))
        for p, n in zip(new, numbers, strict=True):
            self.known[p] = self.lexicon.output(n) if n >= 0 else next(fresh)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian 32-bit integers."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        split = self.bpe.split.findall
        cuts = [[(p, True) if added else (split(p), False) for p, added in self.bpe.parts(t)] for t in texts]
        self.learn({w for c in cuts for p, added in c if not added for w in p})
        get = self.known.__getitem__
        return [b"".join([struct.pack("<I", self.bpe.added[p]) if added else b"".join(map(get, p)) for p, added in c]) for c in cuts]


_built: dict[tuple, Encoder] = {}


def _encoder(vocabulary: bytes, lexicon: bytes) -> Encoder:
    """One for each worker and lexicon."""
    key = (hashlib.sha256(vocabulary).digest(), hashlib.sha256(lexicon).digest())
    if key not in _built:
        _built.clear()
        _built[key] = Encoder(Bpe(vocabulary), Lexicon(lexicon))
    return _built[key]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def frequent_pieces(docs: DataFrame, bpe: Bpe, size: int = LEXICON) -> list[bytes]:
    """The most frequent pieces of all texts, at most ``size`` and all with counts of like size or none; tasks count before the shuffle."""
    source = docs.sparkSession.sparkContext.broadcast(bpe.split.pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(source.value).findall
        counts: Counter[str] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words = [w for w in counts if len(w.encode()) <= LONGEST]
            for i in range(0, len(words), 50_000):
                some = words[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([counts[w] for w in some], pa.int64())], ["piece", "n"])

        for b in batches:
            for t in b.column(0):
                counts.update(split(t.as_py()))
                if len(counts) > REMEMBERED:
                    yield from out()
                    counts.clear()
        yield from out()

    counted = cut(_texts(docs).select("text").mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).where("n > 1"))
    # how many pieces have counts of each size (some thousand sizes), and the sizes of which all fit
    levels = counted.groupBy(F.floor(F.log2("n") * 64).alias("level")).agg(F.count("*").alias("pieces")).orderBy(F.desc("level")).collect()
    least, taken = None, 0
    for r in levels:
        taken += r.pieces
        if taken > size:
            break
        least = r.level
    if least is None:
        return []
    return [r.piece.encode() for r in counted.where(F.floor(F.log2("n") * 64) >= least).select("piece").collect()]  # ``size`` at most


_OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"


def encode(docs: DataFrame, vocabulary: str, size: int = LEXICON, ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of each row's whole text.

    ``vocabulary`` is the path of a tokenizer file, read on the driver. ``ids`` are little-endian unsigned
    32-bit integers, null unless asked for. The decoded text comes from the ids alone.
    """
    sc = docs.sparkSession.sparkContext
    with open(vocabulary, "rb") as f:
        source = f.read()
    bpe = Bpe(source)
    words = frequent_pieces(docs, bpe, size)
    block = sc.broadcast((source, compile_lexicon(words, {w: bpe.merge(w) for w in words})))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(*block.value)
        for b in batches:
            for piece in slices(b, 1, CHUNK):
                packed = encoder.encode(piece.column(1).to_pylist())
                n = [len(x) // 4 for x in packed]
                hashes = [hashlib.sha256(x).hexdigest() for x in packed]
                decoded = [hashlib.sha256(encoder.bpe.decode(x).decode("utf-8", "replace").encode()).hexdigest() for x in packed]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string()), pa.array(packed if ids else [None] * len(packed), pa.binary())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    return _texts(docs).mapInArrow(run, _OUT)
