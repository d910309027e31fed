"""Phrase maps and pattern tables of realistic size over documents, with SQL of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text, phrase_steps
from ..operators import matching
from ..operators.rewriting import with_clean_text
from ..operators.rules import Rule
from .bindings import spread_table

_FIRST = ("con", "pro", "re", "en", "la", "de", "ver", "ge", "an", "tion")
_SECOND = ("ta", "que", "der", "ment", "le", "ung", "ier", "la", "ra", "ne")
_SMALL = ("the", "of", "and", "in", "en", "de", "la", "que", "der", "die", "und", "les")

#: Steps that feed each other: the native map writes what the map's CJK keys take, and those what its words take.
NATIVE = {"of the": "的", "in der": "里面", "  ": " "}
PHRASES = (
    {"的": "of", "里面 ": "in ", "里面": "in"}
    | {a + b: f"{b} {a}x" for a in _FIRST for b in _SECOND}
    | {f"{a} {b}": f"{a}{b}" for a in _SMALL for b in _SMALL if a != b}
    | {"the": "der artikel", "und": "and", "and": "plus", "ofthe": "article of", "ción": "tion", "ñ": "n", "tions": "s", "plus": "und", "in": "inside", "it's": "it is"}
)
PREFIX = "^(?:der|la|que|inside) "


def rewriting_sql(text: str, steps: list[tuple[str, str, bool]]) -> str:
    """The steps as nested calls. A whole word is replaced twice: the first time misses every other of words in a row."""
    for source, target, whole in steps:
        source, target = source.replace("'", "''"), target.replace("'", "''")
        if whole:
            for _ in range(2):
                text = rf"regexp_replace({text}, '(^|[^\p{{L}}\p{{N}}\p{{M}}_]){source}([^\p{{L}}\p{{N}}\p{{M}}_]|$)', '\1{target}\2', 'g')"
        else:
            text = f"replace({text}, '{source}', '{target}')"
    return text


_STEPS = phrase_steps(PHRASES, NATIVE)

H3_SQL = f"""with read as materialized (select doc_id, lower(coalesce(text, '')) as t0 from documents),
told as (select doc_id, {rewriting_sql('t0', _STEPS)} as t from read)
select doc_id, md5(t) as text_md5, length(t)::int as n_chars from (select doc_id, trim(regexp_replace(regexp_replace(t, '{PREFIX}', '', 'g'), '\\s+', ' ', 'g')) as t from told)"""


def sc1_h3_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cleaned by a map of some 250 phrases, most of them whole words, and a prefix."""
    docs = with_clean_text(spread_table(spark, sf_dir, "documents"), F.col("text"), "t", _STEPS, PREFIX)
    return docs.select("doc_id", F.md5(F.col("t").cast("binary")).alias("text_md5"), F.char_length("t").alias("n_chars"))


#: Patterns of two syllables with something between, and some without a literal.
PATTERN_RULES = [
    Rule("form", "fuzzy", i, p, f"p{i}")
    for i, p in enumerate(
        [f"{a}[a-z]?{b}" for a in _FIRST for b in _SECOND]
        + [f"(?:{a}|{b}) [a-z]+{b[0]}" for a in _SMALL[:8] for b in _SMALL[4:] if a != b]
        + [f"{a}{b}{{1,2}}[.,]" for a in _FIRST for b in "nst"]
        + ["[0-9]{4,}", "licen[sc]e", "[|] [a-z]", "[a-z]{9,}", "LICEN[SC]E|Copyright", "que [a-z]{3}[.,]"]
    )
]

H2_SQL = f"""with rules(ord, pattern) as (values {', '.join(f"({r.ord}, '{r.pattern}')" for r in PATTERN_RULES)}),
clean as (select doc_id, trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) as t from documents),
hits as (select doc_id, ord, regexp_extract(t, '(?i)' || pattern) as word, length(regexp_extract(t, '(?i)^(.*?)(?:' || pattern || ')', 1))::int as start
  from clean join rules on regexp_matches(t, '(?i)' || pattern))
select doc_id, ord, word, start from hits"""


def h2_pattern_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First place of each of some 200 patterns in each document, taken as one segment."""
    clean = spread_table(spark, sf_dir, "documents").select("doc_id", clean_text(F.col("text")).alias("t"))
    one = F.array(F.struct(F.col("t").alias("seg"), F.lit(1).alias("weight")))
    found = matching.with_rule_hits(clean, F.col("t"), one, PATTERN_RULES, [], "groups")
    hits = found.select("doc_id", F.explode(F.flatten(F.transform("groups", lambda g: g["hits"]))).alias("h"))
    return hits.select("doc_id", "h.ord", F.col("h.keyword").alias("word"), "h.start")
