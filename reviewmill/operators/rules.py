"""Label rules as tables: read, merged, retired and compiled. Rule tables are small; reviews are never joined here."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

#: Most rules that a job carries to its executors.
MOST_RULES = 50_000
SCHEMA = "header string, stage string, ord int, pattern string, label string, pri int"


@dataclass(frozen=True)
class Rule:
    header: str
    stage: str
    ord: int
    pattern: str
    label: str
    pri: int | None = None


def bounded(table: DataFrame, most: int = MOST_RULES) -> DataFrame:
    """A table that may be broadcast: one with more rows than `most` is an error."""
    if table.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows can't be broadcast")
    return table


#: Characters of a gram in the index of headers.
GRAM = 3


def _grams(text: Column, sizes: Column) -> Column:
    """The text's different runs of characters, of each of the sizes."""
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.char_length(text) - n + 1), lambda i: F.substring(text, i, n))
    return F.array_distinct(F.flatten(F.transform(F.filter(sizes, lambda n: n <= F.char_length(text)), runs)))


def first_holder(stems: DataFrame, headers: DataFrame) -> DataFrame:
    """stem, header: the first header (header, ord) that holds each of the stems, by an index of their grams.

    A stem of up to GRAM characters is a gram itself, and the index knows each gram's first header. A longer one is held by
    headers that have its rarest gram, and those are looked at. All joins are by gram.
    """
    first = F.min_by("header", F.struct("ord", "header")).alias("header")
    index = headers.select("header", "ord", F.explode(_grams(F.col("header"), F.sequence(F.lit(1), F.lit(GRAM)))).alias("gram"))
    short = stems.filter(F.char_length("stem") <= GRAM).join(index.groupBy("gram").agg(first), F.col("stem") == F.col("gram")).select("stem", "header")
    own = stems.filter(F.char_length("stem") > GRAM).select("stem", F.explode(_grams(F.col("stem"), F.array(F.lit(GRAM)))).alias("gram"))
    sizes = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = own.join(sizes, "gram", "left").groupBy("stem").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    held = rarest.join(index, "gram").filter(F.contains("header", F.col("stem"))).groupBy("stem").agg(first)
    return short.unionByName(held)


def resolve_header(names: DataFrame, headers: DataFrame, aliases: DataFrame) -> DataFrame:
    """names(name) with the header that each means, see header_of_name(). headers: header, ord. aliases: alias, header.

    Any number of names, headers and aliases: all of it is equality joins. A null name means no header.
    """
    asked = names.select("name").filter("name is not null").distinct()
    real = headers.select("header").distinct()
    same = asked.join(real, F.col("name") == F.col("header")).select("name", "header", F.lit(0).alias("rank"))
    told = aliases.dropDuplicates(["alias"]).join(real, "header")
    by_alias = asked.join(told, F.col("name") == F.col("alias")).select("name", "header", F.lit(1).alias("rank"))
    stems = asked.withColumn("stem", F.regexp_replace("name", "标签$", "")).filter("stem <> ''")
    held = stems.join(first_holder(stems.select("stem").distinct(), headers), "stem").select("name", "header", F.lit(2).alias("rank"))
    best = same.unionByName(by_alias).unionByName(held).groupBy("name").agg(F.min_by("header", "rank").alias("header"))
    return names.select("name").join(best, "name", "left")


def header_of_name(name: Column, headers: Column, aliases: Column) -> Column:
    """The header that a name means: the same name, an alias, or the first header that holds the name's stem; else null.

    headers: an array in order. aliases: a map to headers. A name's stem is what stands before the word for label.
    """
    alias, stem = F.try_element_at(aliases, name), F.regexp_replace(name, "标签$", "")
    held = F.get(F.filter(headers, lambda h: F.contains(h, stem)), F.lit(0))
    return F.when(F.array_contains(headers, name), name).when(F.array_contains(headers, alias), alias).when(stem != "", held)


def merge_rule_sources(sources: list[DataFrame]) -> DataFrame:
    """Rules (header, keyword, label) of several sources: of one header and keyword, the later source's stays.

    Sources may have `ord`: then the last of a source's own stays, and ord is kept.
    """
    ordered = all("ord" in source.columns for source in sources)
    every = None
    for rank, source in enumerate(sources):
        ranked = source.select("header", F.lower(strip(F.col("keyword"))).alias("keyword"), "label", *["ord"] * ordered, F.lit(rank).alias("source_rank"))
        every = ranked if every is None else every.unionByName(ranked)
    every = every.filter("keyword <> '' and label is not null")
    best = Window.partitionBy("header", "keyword").orderBy(F.desc("source_rank"), *[F.desc("ord")] * ordered, "label")
    return every.withColumn("at", F.row_number().over(best)).filter("at = 1").drop("at")


def retire_covered(rules: DataFrame, clusters: DataFrame) -> DataFrame:
    """Drops exact rules whose label a cluster covers, unless the keyword is one of the cluster's."""
    covered = rules.join(clusters.select("header", "label").distinct(), ["header", "label"], "left_semi")
    own = clusters.select("header", "label", F.lower("keyword").alias("keyword")).distinct()
    gone = covered.withColumn("keyword", F.lower("keyword")).join(own, ["header", "label", "keyword"], "left_anti").select("header", "label", "keyword").distinct()
    return rules.join(gone, [rules["header"] == gone["header"], rules["label"] == gone["label"], F.lower(rules["keyword"]) == gone["keyword"]], "left_anti")


def retire_patterns(fuzzy: DataFrame, groups: DataFrame) -> DataFrame:
    """Drops patterns whose label a semantic group covers, unless they are an alternation themselves; each once."""
    covered = groups.select("header", "label").distinct().withColumn("covered", F.lit(True))
    kept = fuzzy.join(covered, ["header", "label"], "left").filter(F.col("covered").isNull() | F.col("pattern").rlike(r"^\(.*\|.*\)$")).drop("covered")
    first = Window.partitionBy("header", "pattern", "label").orderBy("ord")
    return kept.withColumn("at", F.row_number().over(first)).filter("at = 1").drop("at")


def group_patterns(groups: DataFrame, by: list[str] = ("header", "label")) -> DataFrame:
    """One alternation for each header and label of groups (header, label, ord, phrase), or for each of other columns.

    groups are rules, so a bounded table.
    """
    words = F.transform(F.array_sort(F.collect_list(F.struct("ord", "phrase"))), lambda x: x["phrase"])
    return groups.groupBy(*by).agg(F.concat(F.lit("("), F.array_join(words, "|"), F.lit(")")).alias("pattern"))


def header_of_label(rules: DataFrame, by: list[str] = ()) -> DataFrame:
    """The header that a label belongs to: that of its first rule, exact rules before patterns. `by`: columns within which that holds."""
    rank = F.when(F.col("stage") == "exact", 0).when(F.col("stage") == "fuzzy", 1).otherwise(2)
    return rules.groupBy(*by, "label").agg(F.min_by("header", F.struct(rank, F.col("ord"), F.col("header"))).alias("header"))


#: Sections of a configuration. The map of foreign keywords holds labels, or maps of keywords by header, as JSON.
CONFIG = (
    "struct<output_columns: array<string>, header_alias_map: map<string, string>, label_priority_order: array<string>, exact_semantic_clusters: map<string, map<string, array<string>>>, "
    "exact_rules: map<string, map<string, string>>, fuzzy_rules: map<string, array<array<string>>>, semantic_groups: map<string, map<string, struct<label: string, patterns: array<string>>>>, "
    "en_map_mode: string, en_keyword_to_label_map: map<string, string>>"
)
#: Levels of clusters, first ranks first, and the mode in which foreign keywords are used.
LEVELS, FALLBACK_ONLY = ["HIGH", "MID", "LOW"], "fallback_only"
_BETWEEN = "\u0001"


def compile_rules(configs: DataFrame, sheet: DataFrame | None = None) -> DataFrame:
    """All rules of configurations (config_id, config as JSON) and of a sheet (config_id, header, keyword, value, match_type).

    Returns config_id, header, stage, ord, pattern, label, pri. Headers are resolved by name, alias and stem; a header
    that means none of the output columns is one of its own. Keywords of clusters stand for the first of their level,
    whose rank is its label's priority. Exact rules win over clusters and the sheet over both; exact rules that say
    less than a cluster are retired, as are patterns whose label a semantic group covers. Foreign keywords are the
    fallback of their header, or of the header that has their label.
    """
    # configurations are parsed once and kept, as few as they are: each section is asked for several times
    c = configs.select("config_id", F.from_json("config", CONFIG).alias("c")).select("config_id", "c.*")
    none = F.array().cast("array<string>")
    full = lambda name: F.concat_ws(_BETWEEN, "config_id", F.coalesce(header_of_name(name, F.coalesce("output_columns", none), F.col("header_alias_map")), name)).alias("header")
    section = lambda column: c.select("*", F.explode(column).alias("name", "own")).withColumn("header", full(F.col("name")))
    levels = F.coalesce("label_priority_order", F.array(*map(F.lit, LEVELS)))
    clusters = section("exact_semantic_clusters").select("header", "own", F.posexplode(levels).alias("pri", "level"))
    clusters = clusters.select("header", "pri", F.try_element_at("own", F.col("level")).alias("words")).withColumn("label", strip(F.get("words", F.lit(0)))).filter("label <> ''")
    clusters = clusters.select("header", "pri", "label", F.posexplode("words").alias("at", "keyword")).withColumn("ord", F.col("pri") * 10_000 + F.col("at")).drop("at")
    exact = section("exact_rules").select("header", F.posexplode("own").alias("ord", "keyword", "label"))
    fuzzy = section("fuzzy_rules").select("header", F.posexplode("own").alias("ord", "rule"))
    fuzzy = fuzzy.select("header", "ord", F.get("rule", F.lit(0)).alias("pattern"), F.get("rule", F.lit(1)).alias("label"))
    groups = section("semantic_groups").select("header", F.posexplode("own").alias("nth", "group", "g"))
    groups = groups.select("header", "nth", strip(F.col("g.label")).alias("label"), F.posexplode_outer("g.patterns").alias("ord", "phrase")).filter("label <> ''").withColumn("phrase", strip(F.col("phrase")))
    used = c.filter(F.lower(F.trim(F.coalesce("en_map_mode", F.lit(FALLBACK_ONLY)))) == FALLBACK_ONLY)
    entries = used.select("*", F.exists(F.map_values("en_keyword_to_label_map"), lambda v: v.startswith("{")).alias("nested"), F.posexplode("en_keyword_to_label_map").alias("ord", "k", "v"))
    by_header = entries.filter(F.col("nested") & F.col("v").startswith("{")).select(full(F.col("k")), F.posexplode(F.from_json("v", "map<string,string>")).alias("ord", "keyword", "label"))
    by_label = entries.filter(~F.col("nested")).select("config_id", "ord", F.col("k").alias("keyword"), F.col("v").alias("label"))
    told = None
    if sheet is not None:
        told = read_rule_sheet(sheet, ["config_id"]).withColumnRenamed("header", "name").join(c.select("config_id", "output_columns", "header_alias_map"), "config_id", "left")
        told = told.select(full(F.col("name")), "keyword", "label", "stage", F.lit(0).alias("ord"))

    base = retire_covered(merge_rule_sources([clusters, exact]), clusters)
    some = group_patterns(groups.filter("phrase <> ''"), ["header", "label", "nth"]).select("header", (F.col("nth") + MOST_RULES).alias("ord"), "pattern", "label")
    patterns = retire_patterns(fuzzy.select("header", "ord", strip(F.col("pattern")).alias("pattern"), strip(F.col("label")).alias("label")).unionByName(some), groups)
    if told is not None:
        base = merge_rule_sources([base.select("header", "keyword", "label", (F.col("source_rank") * MOST_RULES + F.col("ord")).alias("ord")), told.filter("stage = 'exact'")])
        patterns = patterns.unionByName(told.filter("stage = 'fuzzy'").select("header", (F.col("ord") + 2 * MOST_RULES).alias("ord"), F.col("keyword").alias("pattern"), "label"))
    base = base.select("header", F.lit("exact").alias("stage"), (F.col("source_rank") * 10 * MOST_RULES + F.col("ord")).alias("ord"), F.col("keyword").alias("pattern"), "label")
    known = base.unionByName(patterns.select("header", F.lit("fuzzy").alias("stage"), "ord", "pattern", "label"))
    own = F.substring_index("header", _BETWEEN, 1)
    owners = header_of_label(known.withColumn("config_id", own), ["config_id"])
    fallback = by_header.unionByName(by_label.withColumn("config_id", F.col("config_id").cast("string")).join(owners, ["config_id", "label"]).select(*by_header.columns))
    every = known.unionByName(fallback.select("header", F.lit("en_fallback").alias("stage"), "ord", F.col("keyword").alias("pattern"), "label"))
    ranks = clusters.groupBy("header", "label").agg(F.min("pri").alias("pri"))
    at = F.row_number().over(Window.partitionBy("header", "stage").orderBy("ord", "pattern")) - 1
    out = every.join(ranks, ["header", "label"], "left").withColumn("ord", at)
    return out.select(own.alias("config_id"), F.substring_index("header", _BETWEEN, -1).alias("header"), "stage", "ord", "pattern", "label", "pri")


def read_rule_sheet(sheet: DataFrame, by: list[str] = ()) -> DataFrame:
    """Rules of a sheet (header, keyword, value, match_type): blank cells, also those read as nan, are no rules.

    A keyword without a value is its own label. `by`: further columns that are kept.
    """

    def cell(name: str) -> Column:
        text = strip(F.col(name).cast("string"))
        return F.when((text != "") & (F.lower(text) != "nan"), text)

    rows = sheet.select(*by, cell("header").alias("header"), cell("keyword").alias("keyword"), F.coalesce(cell("value"), cell("keyword")).alias("label"), F.lower(cell("match_type")).alias("kind"))
    return rows.filter("header is not null and keyword is not null").select(
        *by, "header", "keyword", "label", F.when(F.col("kind").isin("fuzzy", "regex", "模糊"), "fuzzy").otherwise("exact").alias("stage")
    )


def collect_rules(rules: DataFrame) -> list[Rule]:
    """Compiles a rule table for the executors. The number of rules is checked: they are shipped with the plan."""
    rows = rules.select("header", "stage", "ord", "pattern", "label", F.col("pri").cast("int")).limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return sorted((Rule(*r) for r in rows), key=lambda r: (r.header, r.stage, r.ord))
