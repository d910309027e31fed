"""Readers and writers of the tables that the jobs work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.images import EXTENSIONS
from ..operators.ledger import product_counts, status_stats
from .xlsx import read_xlsx

#: The columns of an exported product table, in order; bullets follow as bullet_1 to bullet_5.
PRODUCT_COLUMNS = [
    "asin", "link", "main_image", "brand", "title", "price", "promo_price", "rating", "review_count", "bsr_rank", "main_category", "main_category_rank",
    "sub_category", "sub_category_rank", "launch_date", "variant_count", "best_selling_color", "status", "error",
]
BULLETS = 5


def normal_name(name: str) -> str:
    """A column name as it is compared: full-width signs made ASCII, no spaces, lower case."""
    for a, b in (("／", "/"), ("（", "("), ("）", ")"), ("．", "."), ("。1", ".1"), (" ", ""), ("　", "")):
        name = name.replace(a, b)
    return name.strip().lower()


def resolve_column(df: DataFrame, wanted: str, aliases: list[str] = ()) -> str | None:
    """The column of df that a configured name, or one of its aliases, means. Looks at names only: no job."""
    by_name: dict[str, str] = {}
    for c in df.columns:
        by_name.setdefault(normal_name(c), c)
    return next((by_name[n] for n in map(normal_name, [wanted, *aliases]) if n in by_name), None)


def require_columns(df: DataFrame, wanted: list[str], aliases: dict[str, list[str]] | None = None) -> dict[str, str]:
    """The columns of df for all wanted names; an error names every one that is missing."""
    found = {w: resolve_column(df, w, (aliases or {}).get(w, [])) for w in wanted}
    if missing := [w for w, c in found.items() if c is None]:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are: {', '.join(df.columns)}")
    return found


def read_reviews(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """A review table: a workbook's first sheet, parquet, csv with a header or json lines; all columns are kept."""
    kind = kind or path.rstrip("/").rpartition(".")[2].lower()
    if kind in ("xlsx", "xlsm"):
        return read_xlsx(spark, path)
    reader = spark.read.option("header", True).option("multiLine", True) if kind == "csv" else spark.read
    return reader.format(kind).load(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids, one a line: stripped, blank lines dropped, repeats kept."""
    return spark.read.text(path).select(strip(F.col("value")).alias("asin")).filter("asin <> ''")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages, one file each: path and html."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def read_images(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """Image files of a folder and all below it: path, length and, if asked for, content. Without it no file is opened.

    A file of no bytes has no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    some = files.filter(F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)).isin(EXTENSIONS))
    return some.select("path", "length", *["content"] * content)


def keep_columns(df: DataFrame, groups: list[list[str]]) -> DataFrame:
    """The columns of some groups that df has, in the groups' order."""
    return df.select([F.col(f"`{c}`") for g in groups for c in g if c in df.columns])


def export_products(products: DataFrame) -> DataFrame:
    """Products as a flat table of texts: set columns in order, null as empty, the first bullets in columns of their own."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    flat: list[Column] = [text(F.col(c) if c in products.columns else F.lit(None)).alias(c) for c in PRODUCT_COLUMNS]
    top = F.slice("bullet_points", 1, BULLETS)
    return products.select(*flat, *[text(F.get(top, F.lit(i))).alias(f"bullet_{i + 1}") for i in range(BULLETS)])


def report(downloads: DataFrame, products: DataFrame, generated_at: str) -> DataFrame:
    """The report, one row: generated_at, by_status (count, mean time and total size of each), totals of products, and of downloads."""
    entry = F.struct("status", F.struct("n", "avg_time", "total_size").alias("of"))
    stats = status_stats(downloads).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("by_status"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.round(F.coalesce(F.sum("total_size"), F.lit(0)) / (1024 * 1024), 4).alias("mb"))
    # both sides are one row
    return stats.join(product_counts(products, downloads)).select(F.lit(generated_at).alias("generated_at"), "by_status", "total_products", "products_with_images", "total", "mb")


def write_report(row: DataFrame, path: str) -> None:
    """A report() as JSON."""
    row.coalesce(1).write.mode("errorifexists").json(path)
