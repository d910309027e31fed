"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Compiled from a model file: the normaliser (a space is written as SPACE, one is put before the text) is composed with
the pieces, so the machine's arcs read raw characters and write ids; a character that no piece covers goes over an arc
that writes its bytes. Composed with a text, it is a lattice whose places are those in the text, and the encoding is
the path of least weight: the tropical semiring's shortest path.

A Unigram model's arcs weigh their pieces' negative log probabilities. A BPE model's scores are ranks of merges, no
weights of a path. Its machine remembers the piece that it has written last, and going on from piece a to piece b
weighs 0 if the model leaves the text a + b as these two pieces, and infinity if it would merge across them. Every two
neighbours of a sequence are left alone just if the sequence is the model's own encoding of its text, so the shortest
path weighs 0 and is the only one that does. The pairs' weights are expanded when a text first asks for them.

A Unigram model's path is found place by place. A BPE model's is found depth first: no arc weighs less than 0, so a way
through the lattice that has weighed 0 so far is the best there is, and only where it ends is another one looked for.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: What a model writes for a space.
SPACE = "▁"
#: Entries of a worker's memory of encoded words. When it is full it becomes the old one, from which words in use come back.
MEMORY = 100_000
#: Characters of a word up to which it is remembered whole. What no piece spans parts longer ones, and they are remembered so.
WHOLE = 24


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbered fields of a protocol buffer message: integers, and the bytes of all others."""
    at = 0

    def varint() -> int:
        nonlocal at
        x = shift = 0
        while True:
            b = data[at]
            at += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if tag & 7 == 2 else 8 if tag & 7 == 1 else 4
            yield tag >> 3, data[at : at + n]
            at += n


#: Fixed values of the file format: kinds of models and of pieces.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: What a character without a piece weighs beyond the least likely piece of a Unigram model.
UNKNOWN_WEIGHT = 10.0
#: No piece: the state at the start and after bytes, where nothing written before matters.
FREE = -1
_INFINITE = float("inf")


@dataclass
class Model:
    """What a model file holds: its kind, its pieces (text, score, kind), and whether a space is put before a text."""

    kind: int
    pieces: list[tuple[str, float, int]]
    prefix: bool

    @classmethod
    def read(cls, file: str) -> Model:
        pieces, trainer, normaliser = [], {}, {}
        with open(file, "rb") as f:
            for k, v in _fields(f.read()):
                if k == 1:
                    own = dict(_fields(v))
                    pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, bytes(4)))[0], own.get(3, NORMAL)))
                elif k == 2:
                    trainer |= dict(_fields(v))
                elif k == 3:
                    normaliser |= dict(_fields(v))
        kind = trainer.get(3, UNIGRAM)
        if kind not in (UNIGRAM, BPE):
            raise ValueError("neither a Unigram nor a BPE model")
        if {k for _, _, k in pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("the model has pieces of the user's or unused ones")
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(5, 1) or trainer.get(24, 0):
            raise ValueError("the model's normaliser maps characters or drops spaces, or spaces end its words")
        return cls(kind, pieces, bool(normaliser.get(3, 1)))


class Transducer:
    """A model, compiled for composition with texts."""

    def __init__(self, file: str):
        model = Model.read(file)
        self.bpe, self.prefix = model.kind == BPE, model.prefix
        self.names = [p for p, _, _ in model.pieces]
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(model.pieces) if kind == BYTE}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte fallback")
        self.scores = {p: score for p, score, kind in model.pieces if kind == NORMAL}
        ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind == NORMAL}
        # a piece that a BPE model never makes of its own text is on no path
        used = {p: i for p, i in ids.items() if not self.bpe or len(p) == 1 or self.merge(p) == [p]}
        # in single precision, as the models' own library adds them up: near ties fall alike
        self.weights = {i: np.float32(0 if self.bpe else -self.scores[p]) for p, i in used.items()}
        self.unknown = 0.0 if self.bpe else np.float32(UNKNOWN_WEIGHT) - np.float32(min(self.scores.values(), default=0.0))
        #: weights of pairs (a, b) at a * len(names) + b, and how the pieces in them are made
        self.left_alone: dict[int, float] = {}
        self.made: dict[int, tuple[list[float], list[str], list[str]]] = {}
        #: most characters of a piece; and whether each character of a piece is a piece, so that bytes are written only for characters that no piece holds
        self.most = max(map(len, used), default=0)
        self.closed = self.bpe and all(c in used for p in used for c in p)
        #: the compiled machine: arcs of each state by raw character, and the piece that ends there (FREE: none)
        self.arcs: list[dict[str, int]] = [{}]
        self.ends = [FREE]
        #: the longest piece on the way to each state, and the longest that each piece begins with (FREE: none)
        self.longest: list[int] = []
        self.shorter = [FREE] * len(self.names)
        for p, i in used.items():
            at = 0
            for c in p:
                if c not in self.arcs[at]:
                    self.arcs.append({})
                    self.ends.append(FREE)
                    self.arcs[at][c] = len(self.arcs) - 1
                    if c == SPACE:  # the normaliser's arc
                        self.arcs[at][" "] = len(self.arcs) - 1
                at = self.arcs[at][c]
            self.ends[at] = i
        self.longest = [FREE] * len(self.ends)
        for number, arcs in enumerate(self.arcs):  # states come after those that lead to them
            for to in arcs.values():
                self.longest[to] = self.longest[number] if self.ends[to] == FREE else self.ends[to]
                if self.ends[to] != FREE:
                    self.shorter[self.ends[to]] = self.longest[number]
        self.inner = {p[i : i + 2] for p in used for i in range(len(p) - 1)}
        if any(x[1] == SPACE != x[0] for x in self.inner):
            raise ValueError("a piece holds a space after another character")
        self.inner |= {x.replace(SPACE, " ") for x in self.inner} | {x.replace(SPACE, " ", 1) for x in self.inner} | {x[0] + x[1].replace(SPACE, " ") for x in self.inner}
        # letters and digits part from all else where no piece joins them; characters of pieces that do are no letters here
        crossing = {c for x in self.inner for c, d in (x, x[::-1]) if c.isalnum() and not d.isalnum() and d not in (SPACE, " ")}
        joined = any((x[0] in crossing) != (x[1] in crossing) and x[0].isalnum() and x[1].isalnum() for x in self.inner)
        letter = f"[^\\W_{re.escape(''.join(sorted(crossing)))}]"
        space, other = f"[ {SPACE}]", f"(?:(?!{letter})[^ {SPACE}])"
        self.words = re.compile(f"{space}*[^ {SPACE}]+|{space}+" if joined else f"{space}*{letter}+|{space}*{other}+|{space}+")
        self.known = _Known(self)
        self.shown = [p.replace(SPACE, " ") for p in self.names]

    def merges(self, text: str) -> Iterator[tuple[float, list[str]]]:
        """A BPE model's merges, on a text of two pieces or one: the best pair first, the leftmost of equals.

        Each gives its score and the parts that the text then has.
        """
        parts = list(text)
        while len(parts) > 1:
            best = None
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best[0]):
                    best = (score, i)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            yield best[0], parts

    def merge(self, text: str) -> list[str]:
        parts = list(text)
        for _, parts in self.merges(text):  # noqa: B007
            pass
        return parts

    def making(self, piece: int) -> tuple[list[float], list[str], list[str]]:
        """How merges make a piece: their scores, and its first and its last part before each and at the end."""
        if (found := self.made.get(piece)) is None:
            name = self.names[piece]
            scores, firsts, lasts = [], [name[0]], [name[-1]]
            for score, parts in self.merges(name):
                scores.append(score)
                firsts.append(parts[0])
                lasts.append(parts[-1])
            found = self.made[piece] = ([*scores, -_INFINITE], firsts, lasts)
        return found

    def between(self, a: int, b: int) -> float:
        """Weight of going on from piece a to piece b, in a BPE model.

        On the text a + b the model makes both by their own merges, the best first, unless one across is better at some time.
        """
        if len(self.left_alone) > MEMORY:
            self.left_alone.clear()
        (left, _, lasts), (right, firsts, _), score = self.making(a), self.making(b), self.scores.get
        i, j, weight = 0, 0, 0.0
        while True:
            x, y, across = left[i], right[j], score(lasts[i] + firsts[j])
            if across is not None and across > x and across >= y:
                weight = _INFINITE
                break
            if x >= y:
                if x == -_INFINITE:
                    break
                i += 1
            else:
                j += 1
        self.left_alone[a * len(self.names) + b] = weight
        return weight

    def weightless(self, text: str) -> list[int]:
        """Ids on the path of weight 0 in a BPE model whose characters are pieces: depth first, longer pieces first.

        A place is reached by one path of weight 0 at most (the encoding of what is before it). So where no way leads on
        from a place, none ever will, and it isn't tried again: time is linear in the text.
        """
        n, size, arcs, names, longest, shorter, known = len(text), len(self.names), self.arcs, self.names, self.longest, self.shorter, self.left_alone.get
        dead: set[int] = set()
        out: list[int] = []  # pieces on the way; less than FREE: -2 - place of a character that is written in bytes
        at, before, piece = 0, FREE, None
        while at < n:
            if piece is None:
                state = 0
                for c in text[at : at + self.most]:
                    if (to := arcs[state].get(c)) is None:
                        break
                    state = to
                if not state:
                    out.append(-2 - at)
                    at, before = at + 1, FREE
                    continue
                piece = longest[state]
            while piece != FREE:
                if before == FREE or not (self.between(before, piece) if (pair := known(before * size + piece)) is None else pair):
                    end = at + len(names[piece])
                    if not dead or end not in dead:
                        break
                piece = shorter[piece]
            if piece != FREE:
                out.append(piece)
                at, before, piece = end, piece, None
                continue
            dead.add(at)
            while out and out[-1] < FREE:
                at -= 1
                out.pop()
            if not out:
                raise ValueError(f"no path of finite weight through {text[:60]!r}")
            last = out.pop()
            at -= len(names[last])
            before, piece = out[-1] if out and out[-1] > FREE else FREE, shorter[last]
        if min(out) > FREE:
            return out
        byte = self.byte_ids
        return [i for x in out for i in ((x,) if x > FREE else [byte[b] for b in text[-2 - x].encode("utf-8", "replace")])]

    def shortest(self, text: str) -> list[int]:
        """Ids on the shortest path through the composition with a text.

        Places are taken in order, so all paths to one are known when it is reached, and it keeps the lightest: of
        equals, the one whose last piece is the longest. A Unigram model's machine has one state at every place. A
        BPE model's has one that any finite path leads to (the encoding of what is before it, of weight 0), and a
        place that has been reached with 0 needs no other path.
        """
        n, size, arcs, ends, bpe, known = len(text), len(self.names), self.arcs, self.ends, self.bpe, self.left_alone.get
        least, start, last = [_INFINITE] * (n + 1), [0] * (n + 1), [FREE] * (n + 1)
        least[0] = 0.0 if bpe else np.float32(0)
        for at in range(n):
            if (so_far := least[at]) == _INFINITE:
                continue
            state, end, before, single = arcs[0], at, last[at], False
            while end < n and (number := state.get(text[end])):
                state, piece = arcs[number], ends[number]
                end += 1
                if piece == FREE:
                    continue
                single |= end == at + 1
                if not bpe:
                    weight = so_far + self.weights[piece]
                elif least[end] == 0.0:
                    continue
                elif before == FREE:
                    weight = so_far
                else:
                    weight = so_far + (self.between(before, piece) if (pair := known(before * size + piece)) is None else pair)
                if weight < least[end]:
                    least[end], start[end], last[end] = weight, at, piece
            if not single and so_far + self.unknown < least[at + 1]:
                least[at + 1], start[at + 1], last[at + 1] = so_far + self.unknown, at, FREE
        if least[n] == _INFINITE:
            raise ValueError(f"no path of finite weight through {text[:60]!r}")
        out, at = [], n
        while at:
            out.append([last[at]] if last[at] != FREE else [self.byte_ids[b] for b in text[start[at] : at].encode("utf-8", "replace")])
            at = start[at]
        return [i for own in reversed(out) for i in own]

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        text = " " + text if self.prefix else text
        if not self.bpe:
            return np.array(self.shortest(text), np.uint32)
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.words.findall(text))), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        out: list[str] = []
        run = bytearray()
        low, high = min(self.bytes_of), max(self.bytes_of)
        if not ((ids >= low) & (ids <= high)).any():
            text = "".join(map(self.shown.__getitem__, ids.tolist()))
        else:
            for i in ids.tolist():
                if i in self.bytes_of:
                    run.append(self.bytes_of[i])
                    continue
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run.clear()
                out.append(self.shown[i])
            text = "".join(out) + run.decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


class _Known(dict):
    """Bytes of the ids of words, with the spaces before them, and of their parts."""

    def __init__(self, owner: Transducer):
        super().__init__()
        self.owner, self.old = owner, {}

    def __missing__(self, text: str) -> bytes:
        if (ids := self.old.get(text)) is None:
            ids = self.parts(text)
        if len(text) < 64:
            if len(self) > MEMORY:
                self.old = dict(self)
                self.clear()
            self[text] = ids
        return ids

    def parts(self, text: str) -> bytes:
        t = self.owner
        inner = t.inner
        # no piece spans a pair of characters that none holds
        cuts = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in inner] if len(text) > WHOLE or not t.closed else ()
        if cuts:
            return b"".join([self[text[a:b]] for a, b in zip([0, *cuts], [*cuts, len(text)])])
        return array("I", t.weightless(text) if t.closed else t.shortest(text)).tobytes()


_compiled: dict[str, Transducer] = {}


def transducer(file: str) -> Transducer:
    """Compiled once a worker, kept from task to task."""
    if file not in _compiled:
        _compiled[file] = Transducer(file)
    return _compiled[file]


def encode_batches(batches: Iterator[pa.RecordBatch], file: str) -> Iterator[tuple[pa.Array, list[str | None], list[np.ndarray]]]:
    """doc_ids, texts and ids of a few documents at a time."""
    t = transducer(file)
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            texts = part.column(1).to_pylist()
            yield part.column(0), texts, [t.encode(x) for x in texts]


def encode(docs: DataFrame, file: str) -> DataFrame:
    """Ids of every row of docs (doc_id, text): doc_id, n_tokens, ids (array<int>).

    Null and empty texts have no ids. Each row is encoded on its own. An empty table gives an empty one; other columns
    are not read.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, _, ids in encode_batches(batches, file):
            n = np.array([len(x) for x in ids], np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            flat = pa.array(np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(n), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, file: str) -> DataFrame:
    """Texts of encoded rows (doc_id, ids): doc_id, text. Null ids give a null text."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(file)
        for batch in batches:
            texts = [None if x is None else t.decode(np.array(x, np.uint32)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, file: str) -> DataFrame:
    """Digest of the ids of every row of docs, decoded again: doc_id, n_tokens, n_byte_tokens, ids_crc32, same_text.

    ids_crc32 is that of the ids as little-endian unsigned 32-bit integers. A null text counts as empty.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        t = transducer(file)
        low, high = min(t.bytes_of), max(t.bytes_of)
        for doc_ids, texts, ids in encode_batches(batches, file):
            columns = [
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([int(((x >= low) & (x <= high)).sum()) for x in ids], pa.int64()),
                pa.array([zlib.crc32(x.data) for x in ids], pa.int64()),
                pa.array([t.decode(x) == (text or "") for x, text in zip(ids, texts)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([doc_ids, *columns], ["doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", "same_text"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, n_byte_tokens long, ids_crc32 long, same_text boolean")
