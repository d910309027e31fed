"""Keyword and pattern hits in texts, as array columns. Everything here is local to a row: no shuffle."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions import lexicon
from ..functions.text import let, quoted, strip
from ..sources.session import ship
from .literals import PatternIndex
from .rules import Rule, bounded

HIT = StructType([
    StructField("start", IntegerType()), StructField("minus_size", IntegerType()), StructField("ord", IntegerType()),
    StructField("keyword", StringType()), StructField("label", StringType()),
])
#: Hits of any rules, with their rules' header and stage, by segment; those in the whole text, for headers with several
#: labels (ALL_EXACT, ALL_FUZZY) and for the fallback, have no segment.
RULE_HIT = StructType([*HIT.fields, StructField("header", StringType()), StructField("stage", StringType())])
GROUP = StructType([StructField("seg", StringType()), StructField("weight", IntegerType()), StructField("offset", IntegerType()), StructField("hits", ArrayType(RULE_HIT))])
ALL_EXACT, ALL_FUZZY = "all_exact", "all_fuzzy"
_TURN = "\u0001"


def segment_parts(text: Column) -> Column:
    """Sentences, cut at turn words: array of (seg, weight). What follows a turn word weighs 2, to the sentence's end."""
    sentences = F.filter(F.transform(F.split(text, lexicon.SENTENCE_ENDS), strip), lambda x: x != "")

    def cut(sentence: Column) -> Column:
        parts = F.split(F.regexp_replace(sentence, lexicon.TURN_WORDS, _TURN), _TURN)
        parts = F.transform(parts, lambda x, i: F.struct(strip(x).alias("seg"), F.when(i == 0, 1).otherwise(2).alias("weight")))
        return F.filter(parts, lambda x: x["seg"] != "")

    whole = F.array(F.struct(text.alias("seg"), F.lit(1).alias("weight")))
    found = let(sentences, lambda x: F.flatten(F.transform(F.when(F.size(x) == 0, F.array(text)).otherwise(x), cut)))
    return let(found, lambda x: F.when(F.size(x) == 0, whole).otherwise(x))


def segments(text: Column) -> Column:
    """segment_parts() with their offsets: characters of the earlier segments, with one between two."""
    none = F.expr("struct(cast(array() as array<struct<seg: string, weight: int, offset: int>>) as made, 0 as at)")

    def add(state: Column, x: Column) -> Column:
        placed = F.struct(x["seg"].alias("seg"), x["weight"].alias("weight"), state["at"].alias("offset"))
        return F.struct(F.concat(state["made"], F.array(placed)).alias("made"), (state["at"] + F.char_length(x["seg"]) + 1).alias("at"))

    return F.aggregate(segment_parts(text), none, add, lambda s: s["made"])


def occurrences(text: Column, keyword: str) -> Column:
    """Starts (from 0) of all places of a keyword, overlapping ones too."""
    k = len(keyword)
    if any(keyword[i:] == keyword[: k - i] for i in range(1, k)):
        found = F.filter(F.sequence(F.lit(0), F.greatest(F.char_length(text) - k, F.lit(0))), lambda p: F.substring(text, p + 1, F.lit(k)) == keyword)
    else:
        none = F.expr("struct(cast(array() as array<int>) as made, 0 as at)")
        sizes = F.transform(F.split(text, quoted(keyword), -1), lambda x: F.char_length(x))
        add = lambda s, n: F.struct(F.concat(s["made"], F.array(s["at"] + n)).alias("made"), (s["at"] + n + k).alias("at"))
        # after the last part there is no place
        found = F.aggregate(sizes, none, add, lambda s: F.slice(s["made"], 1, F.greatest(F.size(s["made"]) - 1, F.lit(0))))
    return F.when(F.contains(text, F.lit(keyword)), found).otherwise(F.array().cast("array<int>"))


def keyword_hits(text: Column, rules: list[Rule]) -> Column:
    """Every place of every rule's keyword: array of HIT, in order of place, long ones first. For some dozens of rules."""

    def hits(r: Rule) -> Column:
        values = [F.lit(-len(r.pattern)).alias("minus_size"), F.lit(r.ord).alias("ord"), F.lit(r.pattern).alias("keyword"), F.lit(r.label).alias("label")]
        return F.transform(occurrences(text, r.pattern.lower()), lambda p: F.struct(p.alias("start"), *values))

    each = [hits(r) for r in rules if r.pattern]
    return F.array_sort(F.flatten(F.array(*each))) if each else F.array().cast(ArrayType(HIT))


def drop_contained(hits: Column) -> Column:
    """Without the hits that lie inside a longer one: one pass over hits in order of place, long ones first.

    A hit is inside one before it if that ends as late and isn't at the same place; `before` is how far those reach.
    """
    none = F.expr(f"struct(cast(array() as array<{HIT.simpleString()}>) as kept, -1 as start, -1 as end, -1 as before, -1 as reach)")

    def step(s: Column, h: Column) -> Column:
        end = h["start"] - h["minus_size"]
        before = F.when((h["start"] == s["start"]) & (end == s["end"]), s["before"]).otherwise(s["reach"])
        return F.struct(
            F.when(end > before, F.concat(s["kept"], F.array(h))).otherwise(s["kept"]).alias("kept"),
            h["start"].alias("start"), end.alias("end"), before.alias("before"), F.greatest(s["reach"], end).alias("reach"),
        )

    return F.aggregate(hits, none, step, lambda s: s["kept"])


def outermost(hits: list[tuple]) -> list[tuple]:
    """drop_contained() on sorted tuples (start, minus_size, ...)."""
    kept, place, before, reach = [], None, -1, -1
    for h in hits:
        end = h[0] - h[1]
        if (h[0], end) != place:
            place, before = (h[0], end), reach
        reach = max(reach, end)
        if end > before:
            kept.append(h)
    return kept


class KeywordIndex:
    """All keywords in one automaton, or one alternation where the automaton's module is missing."""

    def __init__(self, rules: list[Rule], exact: bool = False):
        """exact: keywords as they are written; else in lower case, for lower-cased texts."""
        self.rules: dict[str, list[Rule]] = {}
        for r in rules:
            if r.pattern:
                self.rules.setdefault(r.pattern if exact else r.pattern.lower(), []).append(r)
        try:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for k in self.rules:
                self.automaton.add_word(k, k)
            if self.rules:
                self.automaton.make_automaton()
        except ImportError:
            self.automaton = None

    def places(self, text: str) -> Iterator[tuple[int, str]]:
        if not self.rules:
            return
        if self.automaton is not None:
            for end, k in self.automaton.iter(text):
                yield end + 1 - len(k), k
        else:
            for k in self.rules:
                yield from ((m.start(), k) for m in re.finditer(f"(?={re.escape(k)})", text))

    def hits(self, text: str | None, contained: bool) -> list[tuple]:
        found = sorted((p, -len(k), r.ord, r.pattern, r.label) for p, k in self.places(text or "") for r in self.rules[k])
        return found if contained else outermost(found)

    def by_header(self, text: str) -> dict[str, list[tuple]]:
        """Hits of each header, with their rules, in order of place."""
        out: dict[str, list[tuple]] = {}
        for p, k in self.places(text):
            for r in self.rules[k]:
                out.setdefault(r.header, []).append((p, -len(k), r.ord, r))
        return {h: sorted(hits, key=lambda x: x[:3]) for h, hits in out.items()}


def _pattern_hits(found: list[tuple[int, re.Match]], rules: list[Rule], stage: str) -> list[tuple]:
    return [(m.start(), m.start() - m.end(), rules[i].ord, m.group(), rules[i].label, rules[i].header, stage) for i, m in found]


class RuleIndex:
    """All rules, ready for one pass over a text and its segments. `several`: headers that take every label."""

    def __init__(self, rules: list[Rule], several: list[str]):
        rules = [r for r in rules if r.pattern and r.label]
        of = lambda stage, whole: [r for r in rules if r.stage == stage and (r.header in several) == whole]
        self.keywords, self.fuzzy = KeywordIndex(of("exact", False)), of("fuzzy", False)
        self.whole_keywords, self.whole_fuzzy = KeywordIndex(of("exact", True)), of("fuzzy", True)
        self.patterns, self.whole_patterns = (PatternIndex([r.pattern for r in found]) for found in (self.fuzzy, self.whole_fuzzy))
        self.fallback = KeywordIndex(of("en_fallback", False))

    def groups(self, text: str, segs: list[tuple[str, int]]) -> Iterator[tuple[tuple, list[tuple]]]:
        """((seg, weight, offset), hits) of the segments with hits and of the whole text."""
        at = 0
        for seg, weight in segs:
            hits = [(*h[:3], h[3].pattern, h[3].label, header, "exact") for header, found in self.keywords.by_header(seg).items() for h in outermost(found)]
            hits += _pattern_hits(self.patterns.search(seg), self.fuzzy, "fuzzy")
            if hits:
                yield (seg, weight, at), hits
            at += len(seg) + 1
        hits = []
        for header, found in self.whole_keywords.by_header(text).items():
            hits += [(*h[:3], h[3].pattern, h[3].label, header, ALL_EXACT) for h in sorted(outermost(found), key=lambda x: (x[0], -x[1], x[2]))]
        hits += _pattern_hits(self.whole_patterns.search(text), self.whole_fuzzy, ALL_FUZZY)
        for header, found in self.fallback.by_header(text).items():
            h = min(found, key=lambda x: (x[1], x[0], x[2]))
            hits.append((*h[:3], h[3].pattern, h[3].label, header, "en_fallback"))
        if hits:
            yield (None, None, None), hits


def _struct(rows: list[tuple], kind: StructType, types: list[pa.DataType]) -> pa.StructArray:
    columns = zip(*rows) if rows else [()] * len(types)
    return pa.StructArray.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], kind.names)


def rule_hits(text: Column, parts: Column, rules: list[Rule], several: list[str]) -> Column:
    """Hits of all rules, array of GROUP: one pass in Arrow batches, linear in the text, for thousands of rules.

    A pattern is run only on segments that hold one of the literals which it can't do without (one automaton finds
    those of all patterns); a pattern without such a literal is run on all. parts: the text's segment_parts(). Keywords lose those inside longer ones of their header. A pattern gives its
    first place in each segment; for `several` headers, in the text. The fallback gives each header's longest keyword,
    the earliest of equals. Patterns are Python's. A null text has no hits. The index is built once a task.
    """
    i, s = pa.int32(), pa.string()

    @F.arrow_udf(ArrayType(GROUP))
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        index = RuleIndex(rules, several)
        for texts, segs in batches:
            hits, hit_ends, groups, ends = [], [0], [], [0]
            for text, own in zip(texts.to_pylist(), segs.to_pylist()):
                for group, found in index.groups(text, [(x["seg"], x["weight"]) for x in own or []]) if text is not None else ():
                    groups.append(group)
                    hits += found
                    hit_ends.append(len(hits))
                ends.append(len(groups))
            lists = pa.ListArray.from_arrays(pa.array(hit_ends, i), _struct(hits, RULE_HIT, [i, i, i, s, s, s, s]))
            heads = [pa.array(list(c), t) for c, t in zip(zip(*groups) if groups else ((), (), ()), (s, i, i))]
            yield pa.ListArray.from_arrays(pa.array(ends, i), pa.StructArray.from_arrays([*heads, lists], GROUP.names))

    return of(text, parts)


def with_rule_hits(df: DataFrame, text: Column, parts: Column, rules: list[Rule], several: list[str], out: str) -> DataFrame:
    """Adds rule_hits()."""
    ship(df.sparkSession)
    return df.withColumn(out, rule_hits(text, parts, rules, several))


def with_indexed_hits(df: DataFrame, text: str, rules: list[Rule], out: str = "hits", contained: bool = True) -> DataFrame:
    """Adds keyword_hits() for thousands of rules: one pass of an automaton over the text, in Arrow batches.

    contained: keep hits inside longer ones. The automaton is built once a task.
    """
    ship(df.sparkSession)

    @F.pandas_udf(ArrayType(HIT))
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = KeywordIndex(rules)
        for texts in batches:
            yield pd.Series([[dict(zip(HIT.names, h)) for h in index.hits(x, contained)] for x in texts], dtype=object)

    return df.withColumn(out, of(text))


def keyword_join(docs: DataFrame, key: str, text: str, rules: DataFrame) -> DataFrame:
    """docs x rules (header, pattern, label): a row for each rule whose keyword is in the text, as it is written.

    One pass of an automaton over each text finds its rules' numbers; no text meets rules that it doesn't hold. The
    rule table is checked to be small.
    """
    rows = bounded(rules.select("header", "pattern", "label")).collect()
    ship(docs.sparkSession)
    numbered = [Rule(r.header, "exact", i, r.pattern, r.label) for i, r in enumerate(rows)]

    @F.arrow_udf("array<int>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = KeywordIndex(numbered, exact=True)
        for texts in batches:
            yield pa.array([sorted({r.ord for _, k in index.places(x or "") for r in index.rules[k]}) for x in texts.to_pylist()], pa.list_(pa.int32()))

    told = docs.sparkSession.createDataFrame([(r.ord, r.header, r.pattern, r.label) for r in numbered], "__rule int, header string, pattern string, label string")
    return docs.select(key, F.explode(of(text)).alias("__rule")).join(F.broadcast(told), "__rule").drop("__rule")


def pattern_hits(segs: Column, rules: list[Rule]) -> Column:
    """First place of each rule's pattern in each segment: array of (start, minus_size, ord, keyword, label, seg, weight, offset)."""

    def hits(r: Rule) -> Column:
        pattern = f"(?iu){r.pattern}"

        def hit(s: Column) -> Column:
            found = F.regexp_extract(s["seg"], f"(?s)^(.*?)({pattern})", 2)
            return F.struct(
                F.char_length(F.regexp_extract(s["seg"], f"(?s)^(.*?)(?:{pattern})", 1)).alias("start"), (-F.char_length(found)).alias("minus_size"),
                F.lit(r.ord).alias("ord"), found.alias("keyword"), F.lit(r.label).alias("label"), s["seg"].alias("seg"), s["weight"].alias("weight"), s["offset"].alias("offset"),
            )

        return F.transform(F.filter(segs, lambda s: s["seg"].rlike(pattern)), hit)

    return F.flatten(F.array(*[hits(r) for r in rules]))


def segment_hits(segs: Column, rules: list[Rule]) -> Column:
    """Keyword hits of every segment, contained ones dropped, in the shape of pattern_hits()."""

    def of(s: Column) -> Column:
        hits = drop_contained(keyword_hits(s["seg"], rules))
        return F.transform(hits, lambda h: F.struct(*[h[c].alias(c) for c in ("start", "minus_size", "ord", "keyword", "label")], *[s[c].alias(c) for c in ("seg", "weight", "offset")]))

    return F.flatten(F.transform(segs, of))
