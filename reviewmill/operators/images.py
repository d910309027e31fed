"""Image candidates of product pages, and checks of image files."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.schemas import schema
from ..functions.text import let
from ..sources.session import ship

#: Extensions of image files, and the least width and height of a valid image.
EXTENSIONS, LEAST_SIDE = ["jpg", "jpeg", "png", "webp"], 100
#: Bytes that are read at both ends of an image file; segments of a JPEG file that are looked at before its size is known.
HEAD, TAIL, SEGMENTS = 4096, 4096, 256
#: Parts of a product's urls that are ranked apart before they are ranked together.
URL_PARTS = 64


def candidate_urls(hires: Column, detail: Column, page: Column, strict: bool = True) -> Column:
    """The three lists of urls in one, each url once where it comes first. strict leaves out those of the whole page."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(x, none) for x in ((hires, detail) if strict else (hires, detail, page))]))


def chosen_urls(found: Column, most: int) -> Column:
    """The first `most` candidates, raised to the large size; of those with one key, the first.

    The list is cut before copies are dropped, so fewer may be left.
    """
    large = F.transform(F.slice(found, 1, most), urls.upgrade)
    keyed = F.transform(large, lambda u: F.struct(urls.url_key(u).alias("key"), u.alias("url")))
    # the fields of an array of structs are arrays: x["key"] holds all keys
    first = let(keyed, lambda x: F.filter(x, lambda u, i: F.array_position(x["key"], u["key"]) == i + 1))
    return F.transform(first, lambda x: x["url"])


def first_urls(downloads: DataFrame, most: int) -> DataFrame:
    """The first `most` different urls of each product in order: asin, found. No list is longer, whatever a product's rows."""
    rows = downloads.filter("image_url is not null").select("asin", "image_url").distinct().withColumn("part", F.pmod(F.hash("image_url"), F.lit(URL_PARTS)))
    for keys in (["asin", "part"], ["asin"]):
        rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("image_url"))).filter(F.col("nth") <= most)
    return rows.groupBy("asin").agg(F.array_sort(F.collect_list("image_url")).alias("found"))


def image_rows(products: DataFrame, found: str, most: int) -> DataFrame:
    """A row for each chosen image: asin, image_url, idx (from 1), file_name. The list stays in its row until here."""
    rows = products.select("asin", F.posexplode(chosen_urls(F.col(found), most)).alias("at", "image_url"))
    rows = rows.select("asin", "image_url", (F.col("at") + 1).alias("idx"))
    return rows.withColumn("file_name", urls.file_name(F.col("asin"), F.col("idx"), F.col("image_url")))


class Ranged:
    """A file of which only ranges are read: its head once, and what else is asked for."""

    def __init__(self, size: int, read: Callable[[int, int], bytes]):
        self.size, self.read, self.n_read = size, read, 0
        self.head = self.more(0, HEAD)

    def more(self, start: int, n: int) -> bytes:
        data = self.read(start, max(0, min(n, self.size - start)))
        self.n_read += len(data)
        return data

    def at(self, start: int, n: int) -> bytes:
        return self.head[start : start + n] if start + n <= len(self.head) else self.more(start, n)

    def end(self, n: int) -> bytes:
        """The last n bytes before padding of zeros, which is shorter than TAIL in a whole file."""
        return self.at(max(0, self.size - TAIL), TAIL).rstrip(b"\0")[-n:]


def probe(file: Ranged) -> tuple[int, int] | None:
    """Width and height from the header of a whole PNG, JPEG or WebP file; None if it is none of these.

    Reads HEAD and TAIL, and of a JPEG file 9 bytes at each of SEGMENTS segments at most.
    """
    head = file.head
    if head[:8] == b"\x89PNG\r\n\x1a\n" and head[12:16] == b"IHDR" and len(head) >= 24 and file.end(8)[:4] == b"IEND":
        return struct.unpack(">II", head[16:24])
    if head[:2] == b"\xff\xd8" and file.end(2) == b"\xff\xd9":
        at = 2
        for _ in range(SEGMENTS):
            mark = file.at(at, 9)
            if len(mark) < 9 or mark[0] != 0xFF:
                return None
            if 0xC0 <= mark[1] <= 0xCF and mark[1] not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", mark[5:9])
                return width, height
            at += 2 + int.from_bytes(mark[2:4], "big")
        return None
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP" and len(head) >= 30 and file.size >= int.from_bytes(head[4:8], "little") + 8:
        kind, body = head[12:16], head[20:]
        if kind == b"VP8X":
            return int.from_bytes(body[4:7], "little") + 1, int.from_bytes(body[7:10], "little") + 1
        if kind == b"VP8L":
            bits = int.from_bytes(body[1:5], "little")
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        if kind == b"VP8 ":
            return int.from_bytes(body[6:8], "little") & 0x3FFF, int.from_bytes(body[8:10], "little") & 0x3FFF
    return None


def probe_file(uri: str, size: int) -> tuple[tuple[int, int] | None, int]:
    """probe() of a file in any store that pyarrow reaches, and how many bytes that took. A file that is gone has no size."""
    store, path = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", uri))
    try:
        with store.open_input_file(path) as source:
            file = Ranged(size, lambda start, n: source.read_at(n, start))
            return probe(file), file.n_read
    except FileNotFoundError:
        return None, 0


def _found(rows: list[tuple[tuple[int, int] | None, int]]) -> pd.DataFrame:
    return pd.DataFrame([(*(p or (None, None)), n) for p, n in rows], columns=["width", "height", "n_read"]).astype({"width": "Int32", "height": "Int32", "n_read": "int64"})


@F.pandas_udf(schema("width int, height int, n_read long"))
def _probe(paths: pd.Series, lengths: pd.Series) -> pd.DataFrame:
    return _found([probe_file(p, n) for p, n in zip(paths, lengths)])


@F.pandas_udf(schema("width int, height int, n_read long"))
def _probe_content(content: pd.Series) -> pd.DataFrame:
    return _found([(probe(Ranged(len(x), lambda start, n, x=x: x[start : start + n])), len(x)) if x else (None, 0) for x in content])


def check_images(files: DataFrame) -> DataFrame:
    """Verdict on each file (path, length): path, width, height, n_read, status valid, small or corrupt.

    Files are opened where the task is and read at head and tail, whatever their length. Where only Spark reaches the
    store, files have a column content, and that is looked at instead.
    """
    ship(files.sparkSession)
    found = _probe_content("content") if "content" in files.columns else _probe("path", "length")
    sized = files.select("path", found.alias("p")).select("path", "p.width", "p.height", "p.n_read")
    small = (F.col("width") < LEAST_SIDE) | (F.col("height") < LEAST_SIDE)
    return sized.withColumn("status", F.when(F.col("width").isNull(), "corrupt").when(small, "small").otherwise("valid"))


def image_report(checked: DataFrame) -> DataFrame:
    """One row: total, valid, corrupt (small ones among them), small, and percentages."""
    row = checked.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "valid").alias("valid"), F.count_if(F.col("status") != "valid").alias("corrupt"), F.count_if(F.col("status") == "small").alias("small"))
    part = lambda c: F.when(F.col("total") > 0, F.round(F.col(c) * 100 / F.col("total"), 1)).otherwise(0.0)
    return row.withColumn("valid_percent", part("valid")).withColumn("corrupt_percent", part("corrupt"))
