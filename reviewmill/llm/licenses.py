"""License scans by diagonal voting, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower

#: Phrases of the base and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: Notices that the method knows, as words.
NOTICES = [
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("this work has been released into the public domain", "public-domain"),
]
#: Words of a k-gram. Diagonals this far apart are one span, as a word may be missing or added. Least part of a
#: notice's k-grams that makes its label. Most k-grams of all templates, as they are broadcast.
K, GAP, LEAST, MOST_GRAMS = 2, 2, 0.7, 200_000

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_grams(phrases=PHRASES, notices=NOTICES) -> list[tuple]:
    """(template, position, word, next word, k-grams of the template, label, in the base?) for all k-grams."""
    rows = []
    for t, (text, label, base) in enumerate([(*x, True) for x in phrases] + [(*x, False) for x in notices]):
        words = text.split()
        rows += [(t, i, a, b, len(words) - K + 1, label, base) for i, (a, b) in enumerate(zip(words, words[1:]))]
    if len(rows) > MOST_GRAMS:
        raise ValueError(f"{len(rows)} k-grams of templates are too many to broadcast")
    return rows


def verified_votes(places: Column, n_grams: Column) -> Column:
    """Votes and start of a span's best reading: each template position votes once, in the order of the text.

    places: the span's (pos, tpos), sorted. A reading goes on from a vote to a later one, also later in the template,
    on a diagonal no more than GAP away, so words are missing or added between votes only. Hits farther back than the
    template and GAP can't be continued and are forgotten: the work for a hit is bounded, however long the span.
    """

    def step(state: Column, hit: Column) -> Column:
        pos, tpos = hit["pos"], hit["tpos"]
        recent = F.filter(state["recent"], lambda h: h["pos"] >= pos - n_grams - GAP)
        fits = F.filter(recent, lambda h: (h["pos"] < pos) & (h["tpos"] < tpos) & (F.abs((pos - tpos) - (h["pos"] - h["tpos"])) <= GAP))
        longest = F.array_max(F.transform(fits, lambda h: F.struct(h["votes"].alias("votes"), h["minus"].alias("minus"))))
        # of equal readings, the earliest
        votes, minus = F.coalesce(longest["votes"], F.lit(0)) + 1, F.coalesce(longest["minus"], -pos)
        here = F.array(F.struct(pos.alias("pos"), tpos.alias("tpos"), votes.alias("votes"), minus.alias("minus")))
        # `here` is bound before it is used twice
        return F.transform(here, lambda h: F.struct(
            F.concat(recent, F.array(h)).alias("recent"), F.greatest(state["best"], F.struct(h["votes"].alias("votes"), h["minus"].alias("minus"))).alias("best")
        ))[0]

    none = F.expr(
        "struct(cast(array() as array<struct<pos: int, tpos: int, votes: int, minus: int>>) as recent, named_struct('votes', 0, 'minus', 0) as best)"
    )
    return F.aggregate(places, none, step, lambda s: F.struct(s["best"]["votes"].alias("votes"), (-s["best"]["minus"]).alias("start")))


def scan_licenses(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """Licenses in every row of docs (doc_id, text).

    All rolling k-grams of a text are joined by hash, and by their words, to the positions of the templates. A hit
    votes for the diagonal on which its template would start. A phrase of the base stands where its diagonal has
    all votes. Votes on neighbouring diagonals are one span; a notice's span counts with the part of its k-grams that
    stand there, each once and in order (`verified_votes`): a k-gram that repeats in the text is one vote.
    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best part of any
    template), n_spans (accepted spans of notices), first_span. Null texts are empty and have no words, zero counts
    and empty labels. Each row is scanned on its own, also those that repeat a doc_id; other columns are not read.
    """
    spark = docs.sparkSession
    grams = spark.createDataFrame(template_grams(phrases, notices), "tpl int, tpos int, ta string, tb string, n_grams int, label string, base boolean")
    grams = grams.withColumn("gram", F.xxhash64("ta", "tb"))
    words = F.array_remove(F.split(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), SEPARATORS), "")
    texts = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words.alias("w"))
    n = F.size("w").cast("long")
    # a text of fewer words than K has one row of nulls
    pairs = F.arrays_zip(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))).alias("a"), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("b"))
    rolled = texts.select("row", "doc_id", n.alias("n_words"), F.posexplode_outer(pairs).alias("pos", "pair")).select(
        "row", "doc_id", "n_words", "pos", F.col("pair.a").alias("a"), F.col("pair.b").alias("b"), F.xxhash64("pair.a", "pair.b").alias("gram")
    )
    same = (rolled["gram"] == grams["gram"]) & (rolled["a"] == grams["ta"]) & (rolled["b"] == grams["tb"])
    hits = rolled.join(F.broadcast(grams), same, "left").filter(F.col("tpl").isNotNull() | (F.coalesce("pos", F.lit(0)) == 0))
    hits = hits.select("row", "doc_id", "n_words", "pos", "tpl", "tpos", "n_grams", "label", "base")
    # from here on a text's hits are together: one shuffle of the hits and a row for each text
    hits = hits.repartition("row")
    hits = hits.withColumn("diagonal", F.col("pos") - F.col("tpos"))
    along = Window.partitionBy("row", "tpl").orderBy("diagonal", "pos")
    opens = F.when(F.col("diagonal") - F.lag("diagonal").over(along) <= F.when(F.col("base"), 0).otherwise(GAP), 0).otherwise(1)
    spans = hits.withColumn("opens", opens).withColumn("span", F.sum("opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    # a phrase of the base has one diagonal, where no position has two votes
    spans = spans.groupBy("row", "doc_id", "n_words", "tpl", "n_grams", "label", "base", "span").agg(
        F.count("tpos").alias("hits"), F.min("pos").alias("first"), F.collect_list(F.when(~F.col("base"), F.struct("pos", "tpos"))).alias("places")
    )
    verified = F.when(F.col("base") | (F.col("hits") < 2), F.struct(F.col("hits").cast("int").alias("votes"), F.col("first").alias("start"))).otherwise(
        verified_votes(F.array_sort("places"), F.col("n_grams"))
    )
    spans = spans.withColumn("best", verified).select("*", "best.votes", "best.start")
    part = F.when(F.col("tpl").isNotNull(), F.col("votes") / F.col("n_grams"))
    place = F.col("base") & (F.col("votes") == F.col("n_grams"))
    notice = ~F.col("base") & (part >= LEAST)
    joined = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    return spans.groupBy("row", "doc_id", "n_words").agg(
        F.count_if(place).alias("n_base"),
        F.min(F.when(place, F.col("start").cast("long"))).alias("first_word"),
        F.max(F.when(place, F.col("start").cast("long"))).alias("last_word"),
        joined(place).alias("base_labels"),
        joined(place | notice).alias("labels"),
        F.round(F.coalesce(F.max(part), F.lit(0.0)), 6).alias("score"),
        F.count_if(notice).alias("n_spans"),
        F.min(F.when(notice, F.col("start").cast("long"))).alias("first_span"),
    ).drop("row")


def oracle() -> str:
    """The same in DuckDB's SQL, for documents."""
    values = ", ".join(f"({t}, {i}, '{a}', '{b}', {n}, '{label}', {str(base).lower()})" for t, i, a, b, n, label, base in template_grams())
    return rf"""
with recursive grams(tpl, tpos, a, b, n_grams, label, base) as (values {values}),
texts as (
  select row_number() over () as row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
rolled as (select row, pos::bigint as pos, w[pos + 1] as a, w[pos + 2] as b from texts, unnest(range(greatest(len(w) - 1, 0))) as r(pos)),
hits as (select row, tpl, n_grams, label, base, pos, tpos, pos - tpos as diagonal from rolled join grams using (a, b)),
opened as (
  select *, case when diagonal - lag(diagonal) over (partition by row, tpl order by diagonal, pos) <= case when base then 0 else {GAP} end then 0 else 1 end as opens
  from hits),
numbered as (select *, sum(opens) over (partition by row, tpl order by diagonal, pos rows between unbounded preceding and current row) as span from opened),
-- readings of a notice: each position votes once, in the order of the text, on diagonals close to each other
readings as (
  select row, tpl, span, pos, tpos, 1 as votes, pos as start from numbered where not base
  union
  select h.row, h.tpl, h.span, h.pos, h.tpos, r.votes + 1, r.start from readings r join numbered h using (row, tpl, span)
  where h.pos > r.pos and h.tpos > r.tpos and h.pos - r.pos <= h.n_grams + {GAP} and abs((h.pos - h.tpos) - (r.pos - r.tpos)) <= {GAP}),
best as (select row, tpl, span, max(votes) as votes, arg_min(start, (-votes, start)) as start from readings group by 1, 2, 3),
spans as (
  select row, tpl, label, base, coalesce(b.votes, n) as votes, coalesce(b.start, first) as start, coalesce(b.votes, n) / n_grams as part,
    base and n = n_grams as place, not base and coalesce(b.votes, n) / n_grams >= {LEAST} as notice
  from (select row, tpl, n_grams, label, base, span, count(*) as n, min(pos) as first from numbered group by all) left join best b using (row, tpl, span)),
found as (
  select row, count(*) filter (place) as n_base, min(start) filter (place) as first_word, max(start) filter (place) as last_word,
    string_agg(distinct label, ',' order by label) filter (place) as base_labels,
    string_agg(distinct label, ',' order by label) filter (place or notice) as labels,
    max(part) as score, count(*) filter (notice) as n_spans, min(start) filter (notice) as first_span
  from spans group by row)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels,
  coalesce(labels, '') as labels, round(coalesce(score, 0.0), 6)::double as score, coalesce(n_spans, 0) as n_spans, first_span
from texts left join found using (row)
"""
