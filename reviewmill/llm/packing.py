"""Packing of token sequences by patterns: repeat counts of few-document patterns are fitted to the histogram of lengths.

Documents are encoded and cut where they are read; what travels to the driver is the histogram, one number a length.
It fits how often each pattern of two or three lengths that fill a sequence is used (non-negative least squares),
rounds that, and packs the lengths that are left by best fit, all on counts. The plan says where the i-th piece of a length goes,
so each task finds the places of its pieces on its own: no document is sorted or meets another before sequences are written.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, ship
from .tokens import byte_alphabet

#: Words and pieces that a worker remembers: so many of each, and as many that it is about to forget.
MEMORY = 500_000
#: Rounds of the fit.
ROUNDS = 200
#: Parts of the fit that are tried.
SHARES = (1.0, 0.9, 0.75, 0.5, 0.25, 0.1)
#: Bytes of ids in a batch that a task hands over, about.
BATCH_BYTES = 4 << 20

# The one way of cutting for which there is a short cut, as a tokenizer file states it.
CUTTER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}

_LETTERS = "A-Za-z" + "".join(c for c in map(chr, range(0xC0, 0x250)) if unicodedata.category(c)[0] == "L")
#: Texts of these characters only, in which a letter is a letter for every Unicode version.
_PLAIN = re.compile(rf"[\t-\r -~{_LETTERS}]*")
#: CUTTER's way of cutting such texts; its first alternatives begin with different characters, so letters may come first.
_CUTS = re.compile(rf" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\t-\r {_LETTERS}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: A word that is letters, and marks after them in which no contraction begins: two pieces.
_SIMPLE = re.compile(rf"([{_LETTERS}]+)([!-&(-/:;=>?@\[-`{{-~]*)")
#: Before a single space between two other characters a text can be cut: no piece goes across.
_WORDS = re.compile(r"(?<=\S)(?= \S)")


class _Met(Exception):
    """White space meets a space, so there is more to see than words."""


_ALPHABET = byte_alphabet()
#: How byte-level models write ASCII characters.
_SEEN = dict(enumerate(_ALPHABET[:128]))


class Encoder:
    """Encodes texts to the bytes of their ids (little-endian unsigned 32-bit).

    With CUTTER and no normaliser, a text is cut before single spaces, and each word is encoded once and remembered: plain
    ones piece by piece by the tokenizer's model, those with any other character or a special token by all of the
    tokenizer. So are whole texts for any other tokenizer.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.model = self.tokenizer.model
        told = json.loads(self.tokenizer.to_str())
        special = [t["content"] for t in told["added_tokens"]]
        self.cuts = told["normalizer"] is None and told["pre_tokenizer"] == CUTTER and all(t.startswith("<|") and not re.search(r"\s", t) for t in special)
        self.pieces, self.words = _Memory(self.piece), _Memory(self.word)

    def bytes(self, ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def whole(self, text: str) -> bytes:
        return self.bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def piece(self, piece: str) -> bytes:
        seen = piece.translate(_SEEN) if piece.isascii() else "".join(map(_ALPHABET.__getitem__, piece.encode()))
        return self.bytes([t.id for t in self.model.tokenize(seen)])

    def word(self, word: str) -> bytes:
        """A word after a space. One with white space at an end is none, and never remembered."""
        if simple := _SIMPLE.fullmatch(word):
            letters, marks = simple.groups()
            return self.pieces[f" {letters}"] + self.pieces[marks] if marks else self.pieces[f" {letters}"]
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Met
        return self.unit(f" {word}")

    def unit(self, text: str) -> bytes:
        """A text, or a part of one that no piece crosses the ends of."""
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.pieces.__getitem__, _CUTS.findall(text)))
        return self.whole(text)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.cuts:
            return self.whole(text)
        first, *others = text.split(" ")
        try:
            if not first[-1:].isspace():
                return self.unit(first) + b"".join(map(self.words.__getitem__, others))
        except _Met:
            pass
        return b"".join(map(self.unit, _WORDS.split(text)))


class _Memory(dict):
    """Values of short texts, each made once. When it is full, what was used since it last was is kept."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.before = make, {}

    def __missing__(self, text: str) -> bytes:
        value = self.before.get(text)
        if value is None:
            value = self.make(text)
        if len(text) < 64:
            if len(self) >= MEMORY:
                self.before = dict(self)
                self.clear()
            self[text] = value
        return value


_encoders: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    """One a worker, kept from task to task."""
    if file not in _encoders:
        _encoders[file] = Encoder(file)
    return _encoders[file]


def cut_points(n: int, size: int) -> list[int]:
    """Where the pieces of n ids begin, and n: all are of `size` but the first, which may be shorter."""
    return [0, *range(n % size or size, n, size), n]


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """Pieces of docs (doc_id, text): doc_id, piece, start, length, ids, and part and place, which number those of a length.

    ids: little-endian unsigned 32-bit. A null text is empty and has the end id only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), [0] * (size + 1)
        end, held, waiting = code.bytes([end_id]), 0, []
        names = ["doc_id", "piece", "start", "length", "ids", "place", "part"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32()]

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*waiting), kinds)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = code.encode(text.as_py()) + end
                cuts = cut_points(len(ids) // 4, size)
                for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                    waiting.append((doc_id, i, lo, hi - lo, ids[4 * lo : 4 * hi], seen[hi - lo], part))
                    seen[hi - lo] += 1
                held += len(ids)
                if held > BATCH_BYTES:
                    yield done()
                    held, waiting = 0, []
        if waiting:
            yield done()

    schema = "doc_id long, piece int, start long, length long, ids binary, place long, part int"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """Every pattern of two or three of the lengths that fills a sequence, the longest first, 0 for none."""
    there = np.zeros(size + 1, bool)
    there[lengths] = True
    out = []
    half = np.arange(1, size // 2 + 1)
    half = half[there[half] & there[size - half]]
    out.append(np.stack([size - half, half, np.zeros_like(half)], axis=1))
    for least in range(1, size // 3 + 1):
        if there[least]:
            middle = np.arange(least, (size - least) // 2 + 1)
            middle = middle[there[middle] & there[size - least - middle]]
            out.append(np.stack([size - least - middle, middle, np.full_like(middle, least)], axis=1))
    return np.concatenate(out)


def fit_counts(found: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """How often to use each pattern: non-negative least squares of the histogram, by accelerated projected gradients.

    counts: by length, 0 for none. A length's miss weighs its tokens.
    """
    weight = np.arange(len(counts), dtype=float) / (len(counts) - 1)
    flat, n = found.ravel(), len(counts)
    columns = np.repeat(np.arange(len(found)), found.shape[1])
    uses = lambda x: np.bincount(flat, weights=x[columns], minlength=n)
    back = lambda r: (r * weight**2)[found].sum(axis=1)
    probe = np.ones(len(found))
    for _ in range(20):
        step = back(uses(probe))
        probe = step / (bound := np.linalg.norm(step))
    x = ahead = np.zeros(len(found))
    speed = 1.0
    for _ in range(rounds):
        new = np.maximum(0, ahead - back(uses(ahead) - counts) / bound)
        faster = (1 + (1 + 4 * speed**2) ** 0.5) / 2
        x, ahead, speed = new, new + (speed - 1) / faster * (new - x), faster
    return x


def rounded(x: np.ndarray) -> np.ndarray:
    """Whole numbers whose running sums are those of x, rounded: many small counts don't vanish."""
    return np.diff(np.floor(np.cumsum(x) + 0.5), prepend=0).astype(np.int64)


@dataclass
class Plan:
    """Where pieces go. By length: numbers of the pieces from which a range begins, its first sequence, its offset."""

    n_sequences: int
    ranges: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    def find(self, length: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the index-th pieces of their lengths."""
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for n in np.unique(length):
            here = length == n
            begins, first, place = self.ranges[int(n)]
            at = np.searchsorted(begins, index[here], side="right") - 1
            sequence[here], offset[here] = first[at] + index[here] - begins[at], place[at]
        return sequence, offset


def best_fit(left: dict[int, int], size: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit of the longest lengths first, on counts: contents (length, copies) of a sequence, and how many are alike."""
    open_: dict[int, list[tuple[list[tuple[int, int]], int]]] = defaultdict(list)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            room = min((r for r, groups in open_.items() if groups and r >= length), default=0)
            if room:
                inside, alike = open_[room].pop()
            else:
                room, inside, alike = size, [], n
            each = room // length
            full = min(alike, n // each)
            if full:
                open_[room - each * length].append(([*inside, (length, each)], full))
            n -= full * each
            if full < alike and n:  # one more, which the rest doesn't fill
                open_[room - n * length].append(([*inside, (length, n)], 1))
                full, n = full + 1, 0
            if full < alike and inside:
                open_[room].append((inside, alike - full))
    return [group for groups in open_.values() for group in groups]


def _used(found: np.ndarray, times: np.ndarray, counts: np.ndarray) -> tuple[list[tuple[list[tuple[int, int]], int]], np.ndarray]:
    """The patterns used so often, as far as there are pieces of their lengths; and the counts that are left."""
    groups, counts = [], counts.copy()
    for p in np.flatnonzero(times).tolist():
        inside: dict[int, int] = defaultdict(int)
        for length in found[p].tolist():
            inside[length] += 1
        inside.pop(0, None)
        n = min(int(times[p]), *(int(counts[length]) // k for length, k in inside.items()))
        if n:
            groups.append((list(inside.items()), n))
            for length, k in inside.items():
                counts[length] -= n * k
    return groups, counts


def make_plan(histogram: dict[int, int], size: int) -> Plan:
    """The plan for so many pieces of each length, 1 to size.

    Where the fit has used up the short lengths, what is left packs badly. So some SHARES of the fit are rounded, and the
    one counts that needs the fewest sequences.
    """
    counts = np.zeros(size + 1, np.int64)
    counts[list(histogram)] = list(histogram.values())
    groups: list[tuple[list[tuple[int, int]], int]] = [([(size, 1)], int(counts[size]))] if counts[size] else []
    counts[size] = 0
    found = patterns(np.flatnonzero(counts), size)
    found = found[np.lexsort((-found[:, 1], -found[:, 0]))]
    fitted = fit_counts(found, counts) if len(found) else np.zeros(0)
    tried = []
    for share in SHARES:
        some, left = _used(found, rounded(share * fitted), counts)
        tried.append(some + best_fit({int(x): int(left[x]) for x in np.flatnonzero(left)}, size))
    groups += min(tried, key=lambda t: sum(n for _, n in t))
    used: dict[int, int] = defaultdict(int)
    ranges: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    sequence = 0
    for inside, alike in groups:
        offset = 0
        for length, copies in inside:
            for _ in range(copies):
                ranges[length].append((used[length], sequence, offset))
                used[length] += alike
                offset += length
        sequence += alike
    return Plan(sequence, {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in ranges.items()})


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 2048) -> DataFrame:
    """Every piece of docs (doc_id, text) and its place: doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset.

    Who asks for no ids gets places without moving any. A document's ids end with end_id, so a null or empty text has this one. Only longer documents than `size` are cut,
    into pieces of it, of which the first may be shorter. Rows that repeat a doc_id, or have none, are packed each on
    its own. An empty table gives an empty one; other columns are not read.

    A piece is numbered among those of its length by the task that made it, and tasks by their counts: one small
    row a task and length. No length is one task's, however many pieces it has.
    """
    spark = docs.sparkSession
    ship(spark)
    pieces = materialise(cut_documents(docs, tokenizer, end_id, size), "pieces")
    counts = materialise(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    plan = make_plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size)
    known = spark.sparkContext.broadcast(plan)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, index: pd.Series) -> pd.DataFrame:
        sequence, offset = known.value.find(length.to_numpy(), index.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # as many rows as tasks times lengths: no bound for a broadcast
    placed = pieces.withColumn("ids_crc32", F.crc32("ids")).join(bases.hint("merge"), ["part", "length"]).withColumn("at", place("length", F.col("base") + F.col("place")))
    return placed.select("doc_id", "piece", "start", "length", "ids", "ids_crc32", "at.sequence_id", "at.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """One row a sequence of pack(): sequence_id, ids (binary, in order), pieces (array of offset, doc_id, piece, length).

    A sequence has `size` ids at most, so its group is small.
    """
    own = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    rows = packed.groupBy("sequence_id").agg(own.alias("own"))
    ids = F.aggregate("own", F.lit(b""), lambda all_, x: F.concat(all_, x["ids"]))
    return rows.select("sequence_id", ids.alias("ids"), F.transform("own", lambda x: x.dropFields("ids")).alias("pieces"))
