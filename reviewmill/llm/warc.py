"""WARC archives by way of a table of chunks: record id, chunk number, bytes and the digest so far."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .common import attach_by_key, fresh_path, materialise, ship

#: Bytes of a chunk, bytes of an archive after which the next record opens another, least payload that is worth a revisit.
CHUNK, ARCHIVE, LEAST_REVISIT = 65536, 256 << 20, 100
_DATE = "2024-01-01T00:00:00Z"

_HEAD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
CHUNKS = f"{_HEAD}, chunk_no int, last boolean, data binary, digest_so_far string"
_COLUMNS = [x.split()[0] for x in CHUNKS.split(", ")]
_TYPES = [{"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}[x.split()[1]] for x in CHUNKS.split(", ")]


def _batches(rows: Iterator[tuple], most: int = 32) -> Iterator[pa.RecordBatch]:
    """Record batches of few rows, so that one never holds more than `most` chunks."""
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _TYPES)], _COLUMNS)

    for row in rows:
        held.append(row)
        if len(held) == most:
            yield batch()
            held = []
    if held:
        yield batch()


def _sized(pages: DataFrame) -> DataFrame:
    """Pages with their payload, its size and digest, and `told`, a hash that tells records apart and finds them again."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    sized = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("payload"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html, 256).alias("payload_digest"))
    return sized.withColumn("told", F.xxhash64("page_id", "url", "payload_digest"))


def decide_records(pages: DataFrame) -> DataFrame:
    """The records of pages (page_id, url, html) that revisit another: told, page_id, payload_digest, refers_to.

    Of equal payloads of LEAST_REVISIT bytes or more, the smallest page_id is the response and the others revisit
    it. Null html is empty. Rows with a null page_id are responses; so are all that share the smallest id.
    """
    rows = _sized(pages).filter(F.col("payload_bytes") >= LEAST_REVISIT).select("told", "page_id", "payload_digest")
    rows = materialise(rows, "payloads")
    groups = rows.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    groups = materialise(groups.filter("n > 1"), "payload-groups")
    again = attach_by_key(rows, groups, "payload_digest", "n", rows.count()).filter("page_id > refers_to")
    return materialise(again.select("told", "page_id", "payload_digest", "refers_to").distinct(), "revisits")


def chunk_records(pages: DataFrame, revisits: DataFrame) -> DataFrame:
    """The table of chunks: a row for each CHUNK bytes of a payload, with the SHA-256 of all bytes so far.

    Payloads are cut where they are read, so only chunks meet the revisits, which may be a shuffle, and only chunks
    are sorted and go to Python: a record of any length streams through. An empty payload, and a revisit, has one
    empty chunk. A record's chunks stay together and in order.
    """
    ship(pages.sparkSession)
    n = F.greatest(F.ceil(F.col("payload_bytes") / CHUNK), F.lit(1)).cast("int")
    cut = _sized(pages).withColumn("row", F.monotonically_increasing_id()).select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    cut = cut.select(
        "told", "row", "page_id", "url", "payload_bytes", "payload_digest", "chunk_no",
        (F.col("chunk_no") == n - 1).alias("last"), F.substring("payload", F.col("chunk_no") * CHUNK + 1, F.lit(CHUNK)).alias("data"),
    )
    again = revisits.select("told", F.col("page_id").alias("__page"), F.col("payload_digest").alias("__digest"), "refers_to")
    same = [cut["told"] == again["told"], cut["page_id"] == again["__page"], cut["payload_digest"] == again["__digest"]]
    other = F.col("refers_to").isNotNull()
    met = cut.join(again, same, "left").filter(~other | (F.col("chunk_no") == 0)).sortWithinPartitions(cut["told"], "row", "chunk_no")
    met = met.select(
        "page_id", "url", F.when(other, "revisit").otherwise("response").alias("record_type"), "refers_to", "payload_bytes", "payload_digest", "chunk_no",
        (F.col("last") | other).alias("last"), F.when(other, F.lit(b"")).otherwise(F.col("data")).alias("data"),
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        digest = hashlib.sha256()
        for batch in batches:
            for *head, no, last, data in zip(*[c.to_pylist() for c in batch.columns]):
                if no == 0:
                    digest = hashlib.sha256()
                digest.update(data)
                yield *head, no, last, data, digest.copy().hexdigest()

    return met.mapInArrow(lambda x: _batches(rows(x)), CHUNKS)


def _head(page_id, url, record_type, refers_to, payload_bytes, payload_digest) -> bytes:
    fields = [("WARC-Type", record_type), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", _DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    if record_type == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("WARC-Payload-Digest", f"sha256:{payload_digest}"), ("X-Payload-Length", payload_bytes)]
    fields += [("Content-Type", "text/html"), ("Content-Length", payload_bytes if record_type == "response" else 0)]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Streams a table of chunks, each record's in order and together, into gzip archives, one member a record.

    Returns the manifest: path, n_records. Only archives that it names count, so that a repeated task does no harm.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sink, path, n, size = TaskContext.get().partitionId(), None, None, 0, 0
        for batch in batches:
            for *head, no, last, data, _ in zip(*[c.to_pylist() for c in batch.columns]):
                if no == 0:
                    if sink is not None and size >= ARCHIVE:
                        sink.close()
                        yield pa.RecordBatch.from_pylist([{"path": path, "n_records": n}])
                        sink = None
                    if sink is None:
                        path = files.new_file(folder, f"part-{part:06d}", ".warc.gz")
                        sink, n, size = files.create(path), 0, 0
                    member = zlib.compressobj(1, zlib.DEFLATED, 31)
                    sink.write(member.compress(_head(*head)))
                    n += 1
                size += len(data)
                sink.write(member.compress(data))
                if last:
                    sink.write(member.compress(b"\r\n\r\n") + member.flush())
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "n_records": n}])

    return materialise(chunks.mapInArrow(write, "path string, n_records long"), "warc-manifest")


class _Inflated:
    """The bytes of a file of gzip members, read a little at a time."""

    def __init__(self, source):
        self.source, self.member, self.held = source, zlib.decompressobj(31), b""

    def more(self) -> bool:
        if self.member.eof:
            rest, self.member = self.member.unused_data, zlib.decompressobj(31)
        else:
            rest = self.member.unconsumed_tail
        rest = rest or self.source.read(CHUNK)
        out = self.member.decompress(rest, CHUNK) if rest else self.member.flush()
        self.held += out
        return bool(rest or out)

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.held.find(mark)) < 0:
            if not self.more():
                if self.held.strip():
                    raise ValueError("the archive ends in a record's header")
                return None
        out, self.held = self.held[:at], self.held[at + len(mark) :]
        return out

    def upto(self, n: int) -> bytes:
        while not self.held:
            if not self.more():
                raise ValueError("the archive ends in a record")
        out, self.held = self.held[:n], self.held[n:]
        return out


def read_archive(source) -> Iterator[tuple]:
    """Rows of the table of chunks, without the bytes; a payload that doesn't have its header's digest is an error."""
    data = _Inflated(source)
    while (head := data.until(b"\r\n\r\n")) is not None:
        lines = head.decode().lstrip("\r\n").split("\r\n")
        field = dict(x.split(": ", 1) for x in lines[1:])
        number = lambda k: None if field.get(k, "<urn:page:None>") == "<urn:page:None>" else int(field[k][10:-1])
        wanted, left, digest, no = field["WARC-Payload-Digest"][7:], int(field["Content-Length"]), hashlib.sha256(), 0
        row = (number("WARC-Record-ID"), field.get("WARC-Target-URI"), field["WARC-Type"], number("WARC-Refers-To"))
        room = CHUNK
        while left:
            piece = data.upto(min(left, room))
            digest.update(piece)
            left, room = left - len(piece), room - len(piece)
            if left and not room:
                yield *row, int(field["X-Payload-Length"]), wanted, no, False, None, digest.copy().hexdigest()
                no, room = no + 1, CHUNK
        got = digest.hexdigest()
        if row[2] == "response" and got != wanted:
            raise ValueError(f"record {row[0]} has another digest than its header says")
        yield *row, int(field["X-Payload-Length"]), wanted, no, True, None, got
        if data.until(b"\r\n\r\n") != b"":
            raise ValueError(f"record {row[0]} is longer than its header says")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Reads the archives of a manifest back into a table of chunks without bytes, one task an archive."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with files.open_stream(path) as source:
                    yield from read_archive(source)

    return manifest.repartitionByRange(max(1, manifest.count()), "path").mapInArrow(lambda x: _batches(rows(x), 1000), CHUNKS)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html), reads the archives back and returns what they hold.

    page_id, payload_bytes, payload_digest, record_type, refers_to. Empty tables give no archive and no row; other
    columns are not read.
    """
    ship(pages.sparkSession)
    manifest = write_archives(chunk_records(pages, decide_records(pages)), fresh_path(pages.sparkSession, "warc"))
    return read_archives(manifest).filter("last").select(
        "page_id", "payload_bytes", F.when(F.col("record_type") == "response", F.col("digest_so_far")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to"
    )
