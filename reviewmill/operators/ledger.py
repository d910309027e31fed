"""The ledger of downloads and the table of products: upserts, joins and reports.

downloads: asin, image_url, local_path, status, file_size, error_message, download_time, created_at and, to order rows
of one moment, seq. products: asin, title, url, created_at, updated_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import shorten

KEY = ["asin", "image_url"]
#: Classes of errors, by what the message holds, in this order; and the class of all others.
ERRORS = [("timeout", "Timeout"), ("403", "403 Forbidden"), ("404", "404 Not Found"), ("429", "429 Rate Limited")]
OTHER = "Other"


def latest_downloads(downloads: DataFrame) -> DataFrame:
    """The last row of each image of each product.

    Tasks keep the last row of each key that they have read, so an image that was tried again and again is a row a task.
    """
    rest = [c for c in downloads.columns if c not in KEY]
    last = F.max_by(F.struct(*rest), F.struct("created_at", "seq")).alias("last")
    return downloads.groupBy(*KEY).agg(last).select(*[f"last.{c}" if c in rest else c for c in downloads.columns])


def upsert_downloads(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """The ledger after new results: a later row of the same key replaces the earlier. Replays change nothing."""
    return latest_downloads(ledger.unionByName(new, allowMissingColumns=True))


def upsert_products(products: DataFrame, new: DataFrame) -> DataFrame:
    """Products after new rows: the newest title and url that aren't null, the first created_at, the last updated_at."""
    every = products.unionByName(new)
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("updated_at", c)))
    return every.groupBy("asin").agg(newest("title").alias("title"), newest("url").alias("url"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))


def pending(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """Candidates (asin, image_url, ...) that the ledger has no success for: only keys of successes are compared."""
    return candidates.join(ledger.filter("status = 'success'").select(*KEY).distinct(), KEY, "left_anti")


def with_success(products: DataFrame, ledger: DataFrame) -> DataFrame:
    return products.join(ledger.filter("status = 'success'").select("asin").distinct(), "asin", "left_semi")


def with_titles(facts: DataFrame, products: DataFrame) -> DataFrame:
    return facts.join(products.select("asin", "title"), "asin", "left")


def status_stats(downloads: DataFrame, by: list[str] = ()) -> DataFrame:
    """Count, mean time and total size by status, of all downloads or by further columns."""
    return downloads.groupBy(*by, "status").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("download_time"), 6).alias("avg_time"), F.sum("file_size").alias("total_size")
    )


def overall_stats(downloads: DataFrame) -> DataFrame:
    """status_stats() with each status's part of all downloads in percent and its size in MB."""
    stats = status_stats(downloads)
    whole = F.sum("n").over(Window.partitionBy())
    return stats.select("status", "n", F.round(F.col("n") * 100 / whole, 2).alias("percent"), F.round(F.coalesce("total_size", F.lit(0)) / (1024 * 1024), 4).alias("mb"))


def product_counts(products: DataFrame, downloads: DataFrame) -> DataFrame:
    """One row: products in all, and products with an image."""
    none = F.lit(0).cast("long")
    total = products.agg(F.count(F.lit(1)).alias("total_products")).withColumn("products_with_images", none)
    some = downloads.filter("status = 'success'").agg(F.count_distinct("asin").alias("products_with_images")).withColumn("total_products", none)
    return total.unionByName(some).agg(F.sum("total_products").alias("total_products"), F.sum("products_with_images").alias("products_with_images"))


def images_per_product(downloads: DataFrame) -> DataFrame:
    return downloads.filter("status = 'success'").groupBy("asin").agg(F.count(F.lit(1)).alias("images"))


def average_images(downloads: DataFrame) -> DataFrame:
    return images_per_product(downloads).agg(F.round(F.avg("images"), 6).alias("avg_images"))


def image_histogram(downloads: DataFrame) -> DataFrame:
    return images_per_product(downloads).groupBy("images").agg(F.count(F.lit(1)).alias("products"))


def error_class(message: Column) -> Column:
    out = F.when(F.lit(False), OTHER)
    for part, name in ERRORS:
        out = out.when(F.ilike(message, F.lit(f"%{part}%")), name)
    return out.otherwise(OTHER)


def error_classes(downloads: DataFrame) -> DataFrame:
    return downloads.filter("status = 'failed'").groupBy(error_class(F.col("error_message")).alias("error_type")).agg(F.count(F.lit(1)).alias("n"))


def top_products(downloads: DataFrame, products: DataFrame, n: int = 10) -> DataFrame:
    """The n products with most images: counts first, then the top n, and titles for these alone."""
    best = downloads.filter("status = 'success'").groupBy("asin").agg(F.count(F.lit(1)).alias("images"), F.sum("file_size").alias("total_size"))
    best = best.orderBy(F.desc("images"), "asin").limit(n)
    return with_titles(best, products).select("asin", shorten(F.col("title")).alias("title"), "images", "total_size")


def latest_failures(downloads: DataFrame, n: int = 20) -> DataFrame:
    failed = downloads.filter("status = 'failed'").select("asin", "image_url", "error_message", "created_at", "seq")
    return failed.orderBy(F.desc("created_at"), F.desc("seq"), "asin", "image_url").limit(n)


def download_results(downloads: DataFrame) -> DataFrame:
    """One row a product: total, success, failed, skipped."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return downloads.groupBy("asin").agg(F.count(F.lit(1)).alias("total"), *[of(s) for s in ("success", "failed", "skipped")])


def download_errors(downloads: DataFrame) -> DataFrame:
    """The error texts of each product, a row each: asin, message, copies. No product's texts are gathered in a list."""
    message = F.coalesce("error_message", F.lit("Unknown error")).alias("message")
    return downloads.filter("status = 'failed'").groupBy("asin", message).agg(F.count(F.lit(1)).alias("copies"))


def results_with_errors(downloads: DataFrame) -> DataFrame:
    """download_results() with all error texts of a product, sorted, each as often as it occurs, in one text.

    Texts are counted by product and message first, so a product that failed a million times with one text is a row a
    task until its text is written out. That text is one cell, which a task must hold; download_errors() has no such bound.
    """
    counts = ("total", "success", "failed", "skipped")
    message = F.when(F.col("status") == "failed", F.coalesce("error_message", F.lit("Unknown error"))).alias("message")
    each = downloads.groupBy("asin", message).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in counts[1:]])
    error = F.when(F.col("message").isNotNull(), F.struct("message", F.col("failed").alias("copies")))
    found = each.groupBy("asin").agg(*[F.sum(c).alias(c) for c in counts], F.array_sort(F.collect_list(error)).alias("errors"))
    copies = lambda e: F.concat(F.repeat(F.concat(e["message"], F.lit("; ")), (e["copies"] - 1).cast("int")), e["message"])
    return found.withColumn("errors", F.array_join(F.transform("errors", copies), "; "))


def batch_summary(results: DataFrame) -> DataFrame:
    counts = ("total", "success", "failed", "skipped")
    return results.agg(F.count(F.lit(1)).alias("products"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts])


def problem_products(results: DataFrame) -> DataFrame:
    return results.filter("failed > 0 or total = 0")


def success_counts(products: DataFrame) -> DataFrame:
    """Products by outcome (status): one row."""
    return products.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") != "success").alias("failed"))


def failed_products(products: DataFrame) -> DataFrame:
    return products.filter("status = 'failed'").select("asin", F.coalesce("error", F.lit("Unknown error")).alias("error"))


def completeness(products: DataFrame, fields: list[str]) -> DataFrame:
    """Filled cells of each field and their percentage: null, empty text, zero and empty list count as empty. One pass."""
    kinds = dict(products.dtypes)

    def filled(c: str) -> Column:
        some = F.col(c).isNotNull()
        if kinds[c] == "string":
            return some & (F.col(c) != "")
        return some & (F.size(c) > 0) if kinds[c].startswith("array") else some & (F.col(c) != 0)

    row = products.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(filled(c)).alias(f"f_{c}") for c in fields])
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"f_{c}").alias("filled")) for c in fields])
    percent = F.when(F.col("total") > 0, F.round(F.col("x.filled") * 100 / F.col("total"), 1)).otherwise(0.0)
    return row.select("total", F.explode(each).alias("x")).select("x.field", "x.filled", percent.alias("percent"))
