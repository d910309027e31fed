"""From hits to labels: negation, polarity, scores, and the best candidate for each header. No shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions.text import NO, YES, bad_by_star, height_label, is_blank, let
from ..sources.session import ship
from .matching import ALL_EXACT, ALL_FUZZY, drop_contained, keyword_hits, pattern_hits, rule_hits, segment_hits, segment_parts, segments
from .rewriting import with_clean_text
from .rules import Rule

STAGES = ["exact", "fuzzy", "en_fallback"]
NO_RANK = 10**6
# Points of a hit by stage, those of a negated one, of each weight of its segment and of its length.
EXACT, EXACT_NEGATED, FUZZY, FUZZY_NEGATED = 20, 30, 10, 15
WEIGHT, MOST_LENGTH = 10, 8


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def translate(value: Column, opposites: dict[str, str]) -> Column:
    """The opposite label, or the label itself."""
    return F.coalesce(F.try_element_at(_map(opposites), value), value) if opposites else value


def is_negated(seg: Column, start: Column, end: Column, keyword: Column) -> Column:
    """Negation words close before a hit that doesn't open the segment, or after any hit."""
    left = lambda n: F.substring(seg, F.greatest(start - n, F.lit(0)) + 1, F.least(start, F.lit(n)))
    prefix = left(4).rlike(f"({'|'.join(lexicon.NEGATION_PREFIXES)})$")
    exempt = keyword.rlike(f"^({'|'.join(lexicon.NEGATION_EXEMPT)})") | (keyword == "")
    token = left(4).rlike(f"({'|'.join(lexicon.NEGATION_TOKENS)})$") & ~exempt
    before = (start > 0) & (prefix | token | left(14).rlike(lexicon.ENGLISH_NEGATION))
    return before | F.substring(seg, end + 1, F.lit(10)).rlike(lexicon.NEGATION_SUFFIX)


def allowed(seg: Column, start: Column, end: Column, keyword: Column) -> Column:
    """A keyword of one character counts only in a telling context, or if it is clear by itself."""
    near = F.substring(seg, F.greatest(start - 3, F.lit(0)) + 1, end + 3 - F.greatest(start - 3, F.lit(0)))
    return (F.char_length(keyword) != 1) | near.rlike(lexicon.SHORT_CONTEXT) | keyword.isin(lexicon.SHORT_ALLOWED)


def polarity_of(label: Column) -> Column:
    return F.when(label.rlike(lexicon.NEGATIVE_LABEL), -1).when(label.rlike(lexicon.POSITIVE_LABEL), 1).otherwise(0)


def segment_facts(seg: Column, neutral: str | None) -> Column:
    """What a segment says besides its hits, which they all share: a struct, computed once a segment."""
    says = {
        "better": seg.rlike(lexicon.BETTER_THAN), "worse": seg.rlike(lexicon.WORSE_THAN), "alike": seg.rlike(lexicon.ANALOGY), "conceded": seg.rlike(lexicon.PRICE_CONCESSION),
        "expected": seg.rlike(lexicon.EXPECTATION), "mismatch": seg.rlike(lexicon.CLAIM_MISMATCH), "neutral": seg.rlike(f"(?iu){neutral}") if neutral else F.lit(False),
        "other": seg.rlike(lexicon.OTHER_PRODUCT) | seg.rlike(lexicon.EARLIER_PRODUCT),
    }
    return F.struct(*[c.alias(k) for k, c in says.items()])


def bonus(seg: Column, start: Column, polarity: Column, says: Column) -> Column:
    """What a hit's segment adds to its score. says: segment_facts()."""
    left = F.substring(seg, F.greatest(start - 6, F.lit(0)) + 1, F.least(start, F.lit(6)))
    degree = F.lit(0)
    for words, points in reversed(lexicon.DEGREES):
        degree = F.when(left.rlike(words), points).otherwise(degree)
    good, bad = polarity > 0, polarity < 0
    one = lambda which, points: F.when(which, points).otherwise(0)
    # The points of each.
    total = degree + one((good & says["better"]) | (bad & says["worse"]), 3) + one(says["alike"], F.when(bad, 2).otherwise(1))
    return total + one(good & says["conceded"], 4) + one(good & says["expected"], 4) + one(bad & says["mismatch"], 5) + one((polarity == 0) & says["neutral"], 2)


def by_hit(hits: Column) -> Column:
    """Hits that carry their segment, as groups of one."""
    return F.transform(hits, lambda h: F.struct(h["seg"].alias("seg"), h["weight"].alias("weight"), h["offset"].alias("offset"), F.array(h).alias("hits")))


def candidates(groups: Column, exact: bool | None, neutral: str | None = None, opposites: dict[str, str] = lexicon.OPPOSITES) -> Column:
    """Scored candidates of hits by segment: array of (minus_score, pos, ord, polarity, label), best first.

    groups: (seg, weight, offset, hits). exact: whether they are hits of keywords; None: by each hit's stage, which
    candidates then carry, with the header. A negated hit takes the opposite label and, without one, is negative under
    its own. A positive one in a segment that says "worse than" is turned as well. Negative hits that speak of other
    products are dropped.
    """
    end = lambda h: h["start"] - h["minus_size"]

    def told(seg: Column, h: Column) -> Column:
        negated = is_negated(seg, h["start"], end(h), h["keyword"])
        label = lambda no: F.struct(h.alias("h"), no.alias("negated"), F.when(no, translate(h["label"], opposites)).otherwise(h["label"]).alias("label"))
        polarity = lambda x: F.when(x["negated"] & (x["label"] == h["label"]), -1).otherwise(polarity_of(x["label"]))
        return let(let(negated, label), lambda x: F.struct(x["h"].alias("h"), x["negated"].alias("negated"), x["label"].alias("label"), polarity(x).alias("polarity")))

    def turned(says: Column, x: Column) -> Column:
        worse = says["worse"] & (x["polarity"] > 0)
        label = F.when(worse, translate(x["label"], opposites)).otherwise(x["label"])
        return F.struct(x["h"].alias("h"), x["negated"].alias("negated"), label.alias("label"), F.when(worse, -1).otherwise(x["polarity"]).alias("polarity"))

    def scored(g: Column, says: Column, x: Column) -> Column:
        h = x["h"]
        keyword = F.when(x["negated"], EXACT_NEGATED).otherwise(EXACT) + F.least(-h["minus_size"], F.lit(MOST_LENGTH))
        pattern = F.when(x["negated"], FUZZY_NEGATED).otherwise(FUZZY)
        base = F.when(h["stage"] == "exact", keyword).otherwise(pattern) if exact is None else keyword if exact else pattern
        score = base + g["weight"] * WEIGHT + bonus(g["seg"], h["start"], x["polarity"], says)
        more = [h[c].alias(c) for c in ("header", "stage")] if exact is None else []
        return F.struct((-score).alias("minus_score"), (g["offset"] + h["start"]).alias("pos"), h["ord"].alias("ord"), x["polarity"].alias("polarity"), x["label"].alias("label"), *more)

    def of(g: Column) -> Column:
        hits = F.filter(g["hits"], lambda h: (h["keyword"] == "") | allowed(g["seg"], h["start"], end(h), h["keyword"]))
        signed = F.transform(hits, lambda h: told(g["seg"], h))
        last = lambda says: F.filter(F.transform(signed, lambda x: turned(says, x)), lambda x: ~((x["polarity"] < 0) & says["other"]))
        return let(segment_facts(g["seg"], neutral), lambda says: F.transform(last(says), lambda x: scored(g, says, x)))

    return F.array_sort(F.flatten(F.transform(groups, of)))


def ends_well(text: Column) -> Column:
    """Whether the text says that all was put right, or praises this item."""
    return (text.rlike(lexicon.RESOLVED) & text.rlike(lexicon.SATISFIED_NOW)) | text.rlike(lexicon.THIS_ITEM_GOOD)


def best_label(text: Column, header: str, found: Column, ranks: dict[str, int], good_end: Column | None = None) -> Column:
    """The label of the best candidate: by rank where the header has ranks, else by polarity, score and place.

    Negative candidates come first, unless the text ends well: then positive ones do. good_end: ends_well(text), if
    it has been computed.
    """

    def pick(found: Column) -> Column:
        if ranks:
            rank = lambda c: F.coalesce(F.try_element_at(_map(ranks), c["label"]), F.lit(NO_RANK))
            ranked = F.array_min(F.transform(found, lambda c: F.struct(rank(c).alias("rank"), c["minus_score"], c["pos"], c["ord"], c["label"].alias("label"))))
            out = ranked["label"]
        else:
            wanted = F.when(ends_well(text) if good_end is None else good_end, 1).otherwise(-1)
            pool = let(wanted, lambda w: F.filter(found, lambda c: c["polarity"] == w))
            out = let(pool, lambda p: F.get(F.when(F.size(p) > 0, p).otherwise(found), F.lit(0))["label"])
        if header == lexicon.EASY_CARE_HEADER:
            easy = text.rlike(lexicon.EASY_CARE) & F.exists(found, lambda c: c["label"] == lexicon.EASY_CARE_LABEL)
            out = F.when(easy, lexicon.EASY_CARE_LABEL).otherwise(out)
        return out

    return let(found, pick)


def longest_match(text: Column, rules: list[Rule]) -> Column:
    """The label of the longest keyword in the text, the earliest of equals."""

    def first(r: Rule) -> Column:
        at = F.instr(text, F.lit(r.pattern.lower()))
        return F.when(at > 0, F.struct(F.lit(-len(r.pattern)).alias("minus_size"), at.alias("start"), F.lit(r.ord).alias("ord"), F.lit(r.label).alias("label")))

    return F.array_min(F.array(*[first(r) for r in rules if r.pattern]))["label"]


def exclusive(labels: Column, header: str) -> Column:
    """Without labels that exclude each other: the first size label stays, else the one that its group puts first."""
    if header == lexicon.MULTI_HEADERS[0]:
        size = lambda x: x.isin(lexicon.SIZE_GROUP)
        first = lambda all_: F.get(F.filter(all_, size), F.lit(0))
        labels = let(labels, lambda all_: F.filter(all_, lambda x: ~size(x) | (x == first(all_))))

    def one_of(given: Column, group: list[str]) -> Column:
        keep = lambda all_: F.coalesce(*[F.when(F.array_contains(all_, g), g) for g in group])
        return let(given, lambda all_: F.filter(all_, lambda x: ~x.isin(group) | (x == keep(all_))))

    for group in lexicon.EXCLUSIVE.get(header, []):
        labels = one_of(labels, group)
    return labels


def all_labels(text: Column, header: str, exact: list[Rule], fuzzy: list[Rule]) -> Column:
    """Every label of a header with several: keywords in order of place, then patterns in order of rules, each once."""
    hits = F.transform(drop_contained(keyword_hits(text, exact)), lambda h: F.struct(h["start"], -h["minus_size"], h["ord"], h["label"].alias("label")))
    parts = [F.transform(F.array_sort(hits), lambda h: h["label"])]
    parts += [F.when(text.rlike(f"(?iu){r.pattern}"), F.array(F.lit(r.label))).otherwise(F.array().cast("array<string>")) for r in fuzzy]
    return exclusive(F.array_distinct(F.concat(*parts)), header)


def label_columns(text: Column, segs: Column, rules: list[Rule], order: list[str] = STAGES, neutral: str | None = None) -> dict[str, Column]:
    """A label column for each header of the rules; empty where there is none. `segs` are the text's segments.

    Expressions only, for some dozens of rules: indexed_columns() gives the same.
    """
    out = {}
    for header, by_stage, ranks in _headers(rules):
        if header in lexicon.MULTI_HEADERS:
            out[header] = F.when(is_blank(text), "").otherwise(F.array_join(all_labels(text, header, by_stage["exact"], by_stage["fuzzy"]), "/"))
            continue
        found = []
        for stage in order:
            if not by_stage[stage]:
                continue
            if stage == "exact":
                found.append(best_label(text, header, candidates(by_hit(segment_hits(segs, by_stage[stage])), True, neutral), ranks))
            elif stage == "fuzzy":
                found.append(best_label(text, header, candidates(by_hit(pattern_hits(segs, by_stage[stage])), False, neutral), ranks))
            else:
                found.append(longest_match(text, by_stage[stage]))
        out[header] = F.when(is_blank(text), "").otherwise(F.coalesce(*[F.when(c != "", c) for c in found], F.lit("")))
    return out


def _headers(rules: list[Rule]):
    """(header, its rules by stage, its labels' ranks)"""
    own: dict[str, list[Rule]] = {}
    for r in rules:
        own.setdefault(r.header, []).append(r)
    for header, some in own.items():
        yield header, {s: [r for r in some if r.stage == s] for s in STAGES}, {r.label: r.pri for r in some if r.pri is not None}


def indexed_columns(text: Column, whole: Column, found: Column, good_end: Column, rules: list[Rule], order: list[str] = STAGES) -> tuple[dict[str, Column], dict[str, Column]]:
    """Label columns as label_columns() gives them, and the hits that count for each stage.

    whole: the rule_hits() of the whole text. found: the candidates of those in segments. Hits of a stage count where
    no earlier stage has given its header a label; for a header with several labels, its different labels do.
    """
    labels, counts = {}, {"exact": [], "fuzzy": []}
    none = F.array().cast("array<string>")
    for header, by_stage, ranks in _headers(rules):
        own = lambda stage: F.transform(F.filter(whole, lambda h: (h["header"] == header) & (h["stage"] == stage)), lambda h: h["label"])  # noqa: B023, E731
        if header in lexicon.MULTI_HEADERS:
            exact = own(ALL_EXACT) if by_stage["exact"] else none
            every = F.array_distinct(F.concat(exact, own(ALL_FUZZY) if by_stage["fuzzy"] else none))
            labels[header] = F.array_join(exclusive(every, header), "/")
            counts["exact"].append(F.size(F.array_distinct(exact)))
            counts["fuzzy"].append(F.size(every) - F.size(F.array_distinct(exact)))
            continue
        stages, before = [], F.lit(0)
        for stage in (s for s in order if by_stage[s]):
            if stage == "en_fallback":
                some = own(stage)
                stages.append(F.get(some, F.lit(0)))
            else:
                some = F.filter(found, lambda c: (c["header"] == header) & (c["stage"] == stage))  # noqa: B023
                stages.append(best_label(text, header, some, ranks, good_end))
                counts[stage].append(F.when(before == 0, F.size(some)).otherwise(0))
            before = before + F.size(some)
        labels[header] = F.coalesce(*stages, F.lit(""))
    return labels, {s: sum(c, F.lit(0)) for s, c in counts.items()}


def label_reviews(
    reviews: DataFrame, text: str, rules: list[Rule], *, steps=(), prefix: str | None = None, order: list[str] = STAGES, neutral: str | None = None,
    negative: str | None = None, star: str | None = None, most_star: float = 3, bad: str = "bad_review", height: dict | None = None,
    indexed: bool = True, statistics: bool = False,
) -> DataFrame:
    """Labels of every review: all columns, cleaned_text, one column a header, and the bad-review flag.

    The flag follows the star column where one is named; else any label, or the negative pattern, makes a review bad.
    Streams and tables are labelled alike: every row on its own. height: keyword arguments of height_label() and
    `header`, which is filled where it is still empty. indexed: hits come from one pass in Arrow batches, and only the
    few of a row are scored in expressions; else all is expressions. statistics: adds exact_hits and fuzzy_hits.
    """
    ship(reviews.sparkSession)
    clean = F.col("cleaned_text")
    base = with_clean_text(reviews, F.col(text), "cleaned_text", list(steps), prefix)
    if indexed or statistics:
        some = F.when(~is_blank(clean), clean)
        base = base.withColumn("__hits", rule_hits(some, segment_parts(clean), rules, lexicon.MULTI_HEADERS))
        of = lambda whole: F.filter("__hits", lambda g: g["seg"].isNull() if whole else g["seg"].isNotNull())
        base = base.withColumns({"__found": candidates(of(False), None, neutral), "__whole": F.flatten(F.transform(of(True), lambda g: g["hits"])), "__good": ends_well(clean)})
        labels, counts = indexed_columns(clean, F.col("__whole"), F.col("__found"), F.col("__good"), rules, order)
        more = {f"{s}_hits": c.cast("long") for s, c in counts.items()} if statistics else {}
        out = base.withColumns(labels | more).drop("__hits", "__found", "__whole", "__good")
    else:
        base = base.withColumn("__segments", segments(clean))
        labels = label_columns(clean, F.col("__segments"), rules, order, neutral)
        out = base.withColumns(labels).drop("__segments")
    if height and height["header"] in labels:
        told = height_label(F.col("cleaned_text"), **{k: v for k, v in height.items() if k != "header"})
        out = out.withColumn(height["header"], F.when(F.col(height["header"]) != "", F.col(height["header"])).otherwise(F.coalesce(told, F.lit(""))))
    if star is not None:
        return out.withColumn(bad, bad_by_star(F.col(star), most_star))
    some = F.exists(F.array(*[F.col(f"`{h}`") for h in labels]), lambda x: x != "")
    if negative:
        some = some | F.col("cleaned_text").rlike(f"(?iu){negative}")
    return out.withColumn(bad, F.when(some & ~is_blank(F.col("cleaned_text")), YES).otherwise(NO))


def match_statistics(labelled: DataFrame, headers: list[str]) -> DataFrame:
    """One row of label_reviews(statistics=True): exact hits, fuzzy hits, and reviews without any label."""
    none = ~F.exists(F.array(*[F.col(f"`{h}`") for h in headers]), lambda x: x != "")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return labelled.agg(total("exact_hits"), total("fuzzy_hits"), F.count_if(none).alias("unlabelled"))
