"""Token ids in Arrow files of equal-length sequences."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import files
from .common import fresh_path, materialise, ship

#: Ids of a sequence, and sequences of a record batch: sequence k of a file is row k % BATCH of batch k // BATCH.
SEQUENCE, BATCH = 2048, 64
#: Rows of the sample from which bounds between files are taken, for each file.
SAMPLED = 100
#: Entries of a worker's memory of pieces; beyond that it starts anew.
MEMORY = 300_000

# The one way of normalising and cutting for which there is a short cut, as a tokenizer file states it.
NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
CUTTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

_LETTERS = r"a-z\u00df-\u00f6\u00f8-\u024f"
#: Precomposed Latin letters that lower-casing leaves in _LETTERS: not, for one, U+018F, whose small letter is U+0259.
_LATIN = "".join(c for c in map(chr, range(0xC0, 0x250)) if re.fullmatch(f"[{_LETTERS}]", c.lower()))
#: Texts of these characters only, precomposed Latin letters among them, need no normalising but lower-casing.
_PLAIN = re.compile(rf"[\t-\r -~{_LATIN}]*")
#: CUTTER's way of cutting such texts, after lower-casing.
_CUTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9\t-\r ]+")


def byte_alphabet() -> list[str]:
    """The character by which byte-level models write each byte: itself if it can be seen, else one from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(other)) for b in range(256)]


class Encoder:
    """Encodes texts to the bytes of their ids.

    A tokenizer with NORMALISER and CUTTER drops white space and never looks past it, nor past the pieces that it
    cuts. So plain texts are cut into those pieces, and each piece is encoded by the tokenizer's model once and
    remembered. Words with any other character, or with a special token, go through all of it. Texts for any other
    tokenizer go through it whole.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 2**16 else "<u4")
        told = json.loads(self.tokenizer.to_str())
        special = [t["content"] for t in told["added_tokens"]]
        self.cuts = told["normalizer"] == NORMALISER and told["pre_tokenizer"] == CUTTER and all(t.startswith("<|") and not re.search(r"\s", t) for t in special)
        self.pieces = _Pieces(self)

    def bytes(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.dtype.char}", *ids)

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, _CUTS.findall(text.lower())))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.cuts:
            return self.bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return self.plain(text)
        words = re.findall(r"[^\t-\r ]+", text)
        return b"".join(
            self.plain(w) if _PLAIN.fullmatch(w) and "<|" not in w else self.bytes(self.tokenizer.encode(w, add_special_tokens=False).ids) for w in words
        )


class _Pieces(dict):
    """The bytes of each piece's ids."""

    def __init__(self, owner: Encoder):
        super().__init__()
        self.owner, self.model, self.alphabet = owner, owner.tokenizer.model, byte_alphabet()

    def __missing__(self, piece: str) -> bytes:
        if len(self) > MEMORY:
            self.clear()
        seen = piece if piece.isascii() else "".join(map(self.alphabet.__getitem__, piece.encode()))
        ids = self.owner.bytes([t.id for t in self.model.tokenize(seen)])
        if len(piece) < 64:
            self[piece] = ids
        return ids


_encoders: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    """One a worker, kept from task to task."""
    if file not in _encoders:
        _encoders[file] = Encoder(file)
    return _encoders[file]


class SequenceWriter:
    """Writes documents' ids one after another into an Arrow file of fixed-size lists.

    Columns: ids and mask, lists of SEQUENCE (the mask is 1, and 0 where the last sequence is padded), and ends: the
    documents that end in the sequence, with the place after their last id.
    """

    def __init__(self, uri: str, dtype: np.dtype):
        ids = pa.list_(pa.from_numpy_dtype(dtype), SEQUENCE)
        ends = pa.list_(pa.struct([("doc_id", pa.int64()), ("end", pa.int32())]))
        self.schema = pa.schema([("ids", ids), ("mask", pa.list_(pa.uint8(), SEQUENCE)), ("ends", ends)])
        self.sink, self.dtype = files.create(uri), dtype
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.waiting: list[bytes] = []
        self.n = self.flushed = self.docs = 0
        self.ends: list[tuple[int | None, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.waiting.append(ids)
        self.n += len(ids) // self.dtype.itemsize
        self.docs += 1
        self.ends.append((doc_id, self.n))
        if self.n - self.flushed >= 8 * SEQUENCE * BATCH:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), self.dtype)
        step = SEQUENCE * BATCH
        whole = len(ids) if last else len(ids) // step * step
        self.waiting = [ids[whole:].tobytes()]
        at = 0
        for lo in range(0, whole, step):
            part = ids[lo : min(lo + step, whole)]
            rows = -(-len(part) // SEQUENCE)
            mask = (np.arange(rows * SEQUENCE) < len(part)).astype(np.uint8)
            part = np.pad(part, (0, rows * SEQUENCE - len(part)))
            start, own = self.flushed + lo, [[] for _ in range(rows)]
            while at < len(self.ends) and self.ends[at][1] <= start + len(part) and self.ends[at][1] > start:
                place = self.ends[at][1] - start
                own[(place - 1) // SEQUENCE].append({"doc_id": self.ends[at][0], "end": (place - 1) % SEQUENCE + 1})
                at += 1
            columns = [
                pa.FixedSizeListArray.from_arrays(pa.array(part), SEQUENCE),
                pa.FixedSizeListArray.from_arrays(pa.array(mask), SEQUENCE),
                pa.array(own, self.schema.field("ends").type),
            ]
            self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.ends = self.ends[at:]
        self.flushed += whole

    def close(self) -> None:
        self.flush(True)
        self.writer.close()
        self.sink.close()


def read_sequence(uri: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of the k-th sequence of a file. One batch is looked up; of a local file, which is mapped, nothing is copied."""
    row = pa.ipc.open_file(files.open_mapped(uri)).get_batch(k // BATCH).slice(k % BATCH, 1)
    return row.column(0).flatten().to_numpy(), row.column(1).flatten().to_numpy()


def read_documents(uri: str) -> Iterator[tuple[int | None, int, int, int]]:
    """doc_id, start in the file, number of ids and crc32 of the ids as little-endian uint32, for each document."""
    with files.open_random(uri) as source:
        reader = pa.ipc.open_file(source)
        start = n = crc = 0
        for b in range(reader.num_record_batches):
            batch = reader.get_batch(b)
            ids = batch.column(0).flatten().to_numpy().astype("<u4")
            used = int(np.count_nonzero(batch.column(1).flatten().to_numpy()))
            at = 0
            for row, ends in enumerate(batch.column(2).to_pylist()):
                for e in ends:
                    place = row * SEQUENCE + e["end"]
                    n, crc = n + place - at, zlib.crc32(ids[at:place].data, crc)
                    yield e["doc_id"], start, n, crc
                    start, n, crc, at = start + n, 0, 0, place
            n, crc = n + used - at, zlib.crc32(ids[at:used].data, crc)


def range_bounds(docs: DataFrame, parts: int) -> np.ndarray:
    """Ids between parts of about equally many rows, of a sample of SAMPLED rows a part, a million at most; a hot id is there several times."""
    total = docs.count()
    share = min(1.0, min(SAMPLED * parts, 1_000_000) / max(1, total))
    ids = np.sort(np.array([r[0] for r in docs.select(_id()).sample(share, 7).collect()], np.int64))
    return ids[(np.arange(1, parts) * len(ids)) // parts] if len(ids) else ids


def _id():
    """doc_id, nulls before all."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))


def part_of(bounds: np.ndarray, ids: np.ndarray, told: np.ndarray) -> np.ndarray:
    """Part of each row in order of id and of told, a hash (int64): an id that is a bound is dealt by it to the parts about that."""
    first, last = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
    place = (told.astype(np.float64) + 2.0**63) / 2.0**64
    return np.minimum(last, first + np.floor(place * (last - first + 1)).astype(np.int64)).astype(np.int32)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int) -> DataFrame:
    """Encodes docs (doc_id, text) and writes one file a task, in ascending order of doc_id from file to file.

    Texts are encoded where they are read: only ids move to the files' tasks. Rows that share a doc_id lie in order of a
    hash of their texts, in several files if they are many.

    Returns the manifest: part (the files' order), path, n_docs, n_ids. Only files that it names count: a repeated
    task writes another file. Null texts are empty and have the end id only; null doc_ids come first; rows that
    repeat a doc_id keep their own ids. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = range_bounds(docs, parts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        end = code.bytes([end_id])
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                doc_id, key, told, text = (c.slice(lo, 1000) for c in batch.columns)
                ids = pa.array([code.encode(x.as_py()) + end for x in text], pa.binary())
                part = part_of(bounds, key.to_numpy(), told.to_numpy())
                yield pa.RecordBatch.from_arrays([doc_id, told, pa.array(part), ids], ["doc_id", "told", "part", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            for doc_id, part, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if writer is None:
                    first, path = part, files.new_file(folder, f"part-{part:06d}", ".arrow")
                    writer = SequenceWriter(path, encoder(tokenizer).dtype)
                if part != first:
                    raise ValueError("a task has rows of one part")
                writer.add(doc_id, ids.as_py())
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"part": first, "path": path, "n_docs": writer.docs, "n_ids": writer.n}])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _id().alias("key"), F.xxhash64("text").alias("told"), "text")
    rows = rows.mapInArrow(encode, "doc_id long, told long, part int, ids binary")
    dealt = rows.repartitionById(parts, "part").sortWithinPartitions("doc_id", "told").select("doc_id", "part", "ids")
    return materialise(dealt.mapInArrow(write, "part long, path string, n_docs long, n_ids long"), "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Reads the files of a manifest back, one task a file: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, path in zip(batch.column("base").to_pylist(), batch.column("path").to_pylist()):
                rows = [(d, base + s, n, c) for d, s, n, c in read_documents(path)]
                for lo in range(0, len(rows), 10_000):
                    columns = [pa.array(c, pa.int64()) for c in zip(*rows[lo : lo + 10_000])]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    # one row a file: their running sum is a small job
    before = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.select("part", "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    return parts.repartitionByRange(max(1, manifest.count()), "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_index(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes docs' ids to a new folder in the shared one and reads them back."""
    return read_tokens(write_tokens(docs, tokenizer, fresh_path(docs.sparkSession, "tokens"), end_id))
