"""How the benchmark tables stand for reviews, products, downloads and requests. The expressions are good SQL in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.rules import Rule
from ..sources.session import spread

AS_OF = "2024-01-20 00:00:00"

DOWNLOADS = """cast(l_partkey as string) as asin, concat('https://img.example/', l_orderkey, '/', l_linenumber, '._AC_SX679_.jpg') as image_url,
case l_returnflag when 'N' then 'success' when 'A' then 'failed' else 'skipped' end as status, cast(l_quantity * 1000 as bigint) as file_size,
case when l_returnflag = 'A' then case l_linenumber when 1 then 'Read TIMEOUT after 403' when 2 then 'HTTP 403' when 3 then 'HTTP 404 page' when 4 then '429 slow down' when 5 then null else 'connection reset' end end as error_message,
l_discount as download_time, l_shipdate as created_at, l_extendedprice as seq"""
REQUESTS = """concat('https://shop.example/', user_id) as url, user_id, case event_type when 'view' then 200 when 'click' then 304 when 'error' then 503 else 429 end as status_code,
value as response_time, ts as created_at, event_id"""
PRODUCTS = "cast(p_partkey as string) as asin, p_name as title, concat('https://shop.example/', p_partkey) as url"
#: Cells with several tags.
TAGGED = "p_partkey, concat(p_type, '/', p_brand, case when p_size % 3 = 0 then '| large ' when p_size % 3 = 1 then '/nan' else '//' end) as kind, case when p_size > 25 then p_brand else ' ' end as brand"
STARS = "doc_id, case quality * 2 + toxic when 0 then '2.5 stars' when 1 then '**' when 2 then '5' else 'n/a' end as star"

TABLES = {"downloads": ("lineitem", DOWNLOADS), "requests": ("events", REQUESTS), "products": ("part", PRODUCTS), "tagged": ("part", TAGGED), "stars": ("labels", STARS)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are much work each."""
    return spread(table(spark, sf_dir, name))


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = TABLES[name]
    return table(spark, sf_dir, source).selectExpr(*_columns(columns))


def _columns(text: str) -> list[str]:
    """Cuts a select list at its outer commas."""
    out, depth, last, quote = [], 0, 0, False
    for i, c in enumerate(text):
        quote ^= c == "'"
        depth += 0 if quote else (c == "(") - (c == ")")
        if c == "," and not depth and not quote:
            out.append(text[last:i].strip())
            last = i + 1
    return [*out, text[last:].strip()]


def ctes(*names: str) -> str:
    """The same tables as common table expressions."""
    return ", ".join(f"{n} as (select {TABLES[n][1]} from {TABLES[n][0]})" for n in names)


#: Rules for the benchmark's texts, whose words are invented: (header, keyword, label).
RULES = [
    Rule("mood", "exact", i, k, v) for i, (k, v) in enumerate([
        ("disgusting", "bad"), ("trash", "bad"), ("loser", "bad"), ("worthless", "bad"), ("table", "furniture"), ("able", "capable"), ("with", "company"), ("for this", "purpose"),
    ])
] + [
    Rule("place", "exact", i, k, v) for i, (k, v) in enumerate([("the", "article"), ("there", "spot"), ("here", "spot"), ("von", "german"), ("quelle", "french"), ("que", "romance"), ("under the", "licence")])
]
PATTERNS = [Rule("form", "fuzzy", i, k, v) for i, (k, v) in enumerate([("[0-9]{4,}", "number"), ("licen[sc]e", "licence"), ("[|] [a-z]", "cells")])]
HEADERS = ["mood", "place", "form"]


def rule_values(rules: list[Rule]) -> str:
    return ", ".join(f"('{r.header}', {r.ord}, '{r.pattern}', '{r.label}')" for r in rules)
