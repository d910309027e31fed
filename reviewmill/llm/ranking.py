"""Ranked lexical search by three phases with a uniform threshold (TPUT; Cao and Wang, 2004) over term-partitioned postings.

A term's list lies in segments, one for each block of BLOCK_DOCS documents, sorted by term and block in one table: a
list is read on its own, and a long one lies in many partitions. The phases for an item of m terms:

1. The k best entries of each list give partial sums; the k-th best sum, `tau`, is a lower bound.
2. Each list gives its entries of tau / m or more. Their sums by block bound each document's score from below, and
   with what the lists hold back, from above. The k-th best lower bound is the new tau, and what can't reach it goes.
3. What is left, and isn't known exactly yet, is looked up in all of the item's lists.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_groups, materialise, ship

#: Documents of a block: a segment names them in 16 bits.
BLOCK_DOCS = 1024
#: Terms of the items that are ranked together, about: what each task knows of them is so large.
CHUNK_TERMS = 200_000

#: Letters, digits and all bytes of other characters stay, A-Z lower-cased; the rest parts terms.
_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))

_SEGMENTS = "block long, term int, size long, words long, docs binary, counts binary, lengths binary"
#: Term of the row that names a block's documents, and of a candidate's row.
_NAMES = -1


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TERMS).split() if text else []


def _asked_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = [sorted({t.decode() for t in terms_of(x.as_py())}) for x in batch.column(2).cast(pa.binary())]
        columns = [*batch.columns[:2], pa.array(terms, pa.list_(pa.string())), pa.array(map(len, terms), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["item", "item_id", "terms", "n"])


def _segment_rows(numbers):
    """Segments of the terms in numbers, and a row that names the documents, for each block of a task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = numbers.value.get, TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        lengths: list[int] = []
        found: list[tuple[list[int], list[int]]] = []

        def done() -> pa.RecordBatch:
            each = [len(t) for t, _ in found]
            term = np.fromiter((x for t, _ in found for x in t), np.int32, sum(each))
            count = np.fromiter((x for _, c in found for x in c), np.uint32, sum(each))
            doc = np.repeat(np.arange(len(ids), dtype=np.uint16), each)
            length = np.repeat(np.array(lengths, np.uint32), each)
            order = np.argsort(term, kind="stable")
            term, count, doc, length = term[order], count[order], doc[order], length[order]
            cuts = np.concatenate([[0], np.flatnonzero(term[1:] != term[:-1]) + 1, [len(term)]]) if len(term) else np.zeros(1, np.int64)
            cut = lambda x: [x[lo:hi].tobytes() for lo, hi in zip(cuts, cuts[1:])]
            named = np.array([i or 0 for i in ids], np.int64).tobytes(), np.array([i is None for i in ids], np.uint8).tobytes()
            columns = [
                pa.array([block] * len(cuts), pa.int64()),
                pa.array([_NAMES, *term[cuts[:-1]].tolist()], pa.int32()),
                pa.array([sum(n > 0 for n in lengths), *np.diff(cuts).tolist()], pa.int64()),
                pa.array([sum(lengths)] + [None] * (len(cuts) - 1), pa.int64()),
                pa.array([named[0], *cut(doc)], pa.binary()),
                pa.array([named[1], *cut(count)], pa.binary()),
                pa.array([None, *cut(length)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["block", "term", "size", "words", "docs", "counts", "lengths"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                words = terms_of(text.as_py())
                counts = Counter(map(number, words))
                counts.pop(None, None)
                ids.append(doc_id)
                lengths.append(len(words))
                found.append((list(counts), list(counts.values())))
                if len(ids) == BLOCK_DOCS:
                    yield done()
                    block += 1
                    ids, lengths, found = [], [], []
        if ids:
            yield done()

    return run


class Ranking:
    """What tasks know of the items that are ranked together: terms of each item, weights of terms, thresholds, bounds."""

    def __init__(self, items: dict[int, list[int]], df: dict[int, int], n_docs: int, n_words: int):
        self.n_docs, self.n_words = n_docs, n_words
        self.weight = np.zeros(1 + max((t for ts in items.values() for t in ts), default=0), np.int64)
        for term, n in df.items():
            self.weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))
        self.items = {i: [t for t in terms if self.weight[t]] for i, terms in items.items()}
        #: least impact that any item asks of a list; by item: its threshold, and the most that each list can hold back
        self.least = np.zeros(len(self.weight), np.int64)
        self.threshold: dict[int, int] = {}
        self.held: dict[int, list[int]] = {}

    def impacts(self, term: np.ndarray, count: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whole part of each entry's impact, before its term's weight."""
        count = count.astype(np.int64)
        if len(length) and int(length.max()) * 50 * self.n_docs >= 2**63:
            mean = np.array([50 * int(n) * self.n_docs // self.n_words for n in length], np.int64)
        else:
            mean = 50 * length.astype(np.int64) * self.n_docs // self.n_words
        return 1_000_000_000 * count // (1000 * count + 20 * (50 + mean))

    def threshold_by(self, tau: dict[int, int], best: dict[int, tuple[int, int]]) -> None:
        """tau: the k-th best partial sum of each item that has one. best: the largest and the least impact of each list."""
        self.least[:] = np.iinfo(np.int64).max
        for item, terms in self.items.items():
            if terms:
                t = self.threshold[item] = -(-tau.get(item, 0) // len(terms))
                # a list that gives all its entries holds nothing back
                self.held[item] = [0 if best.get(x, (0, 0))[1] >= t else min(t - 1, best[x][0]) for x in terms]
                self.least[terms] = np.minimum(self.least[terms], t)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of rows of segments: sizes, and for all their entries term, document, count and length."""
    size, term = batch.column("size").to_numpy(), batch.column("term").to_numpy()
    joined = [np.frombuffer(b"".join(batch.column(c).to_pylist()), d) for c, d in (("docs", np.uint16), ("counts", np.uint32), ("lengths", np.uint32))]
    return size, np.repeat(term, size), *joined


def _head_rows(known, k: int):
    """The k best entries of each list, with its least impact, as far as it lies in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r: Ranking = known.value
        held: tuple | None = None

        def row(term: int, block: np.ndarray, doc: np.ndarray, impact: np.ndarray, least: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(doc), term, np.int32)), pa.array(block), pa.array(doc.astype(np.int32)), pa.array(impact), pa.array(np.full(len(doc), least, np.int64))],
                ["term", "block", "doc", "impact", "least"],
            )

        for batch in batches:
            size, term, doc, count, length = _flat(batch)
            impact, ends = r.impacts(term, count, length) * r.weight[term], np.cumsum(size)
            for t, b, lo, hi in zip(batch.column("term").to_pylist(), batch.column("block").to_pylist(), ends - size, ends):
                top = np.argsort(-impact[lo:hi], kind="stable")[:k] + lo
                new = (np.full(len(top), b, np.int64), doc[top], impact[top], int(impact[lo:hi].min()))
                if held and held[0] != t:
                    yield row(*held)
                    held = None
                if held:
                    both = [np.concatenate([x, y]) for x, y in zip(held[1:4], new)]
                    top = np.argsort(-both[2], kind="stable")[:k]
                    new = (*(x[top] for x in both), min(held[4], new[3]))
                held = (t, *new)
        if held:
            yield row(*held)

    return run


def _fetch_rows(known, all_entries: bool):
    """The entries that some item asks of a list: block, term, documents, and impacts before the weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r: Ranking = known.value
        for batch in batches:
            size, term, doc, count, length = _flat(batch)
            impact = r.impacts(term, count, length)
            take = (impact * r.weight[term] >= r.least[term]) | all_entries
            row = np.repeat(np.arange(len(size)), size)[take]
            left = np.bincount(row, minlength=len(size))
            ends = np.cumsum(left)
            doc, impact = doc[take], impact[take].astype(np.uint32)
            some = pa.array(np.flatnonzero(left))
            cut = lambda x: pa.array([x[lo:hi].tobytes() for lo, hi in zip(ends - left, ends) if hi > lo], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("block").take(some), batch.column("term").take(some), cut(doc), cut(impact)], ["block", "term", "docs", "counts"])

    return run


def _lists(group: pa.Table, r: Ranking) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Documents and impacts of each term's segment in a block."""
    out = {}
    for term, docs, impacts in zip(*(group.column(c).to_pylist() for c in ("term", "docs", "counts"))):
        if term != _NAMES:
            out[term] = np.frombuffer(docs, np.uint16), np.frombuffer(impacts, np.uint32).astype(np.int64) * r.weight[term]
    return out


def _sums(n: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out = np.zeros(n, np.int64)
    if parts:
        np.add.at(out, np.concatenate([d for d, _ in parts]), np.concatenate([v for _, v in parts]))
    return out


def _bound_rows(known, k: int):
    """Bounds of the documents of a block that can be among an item's k best: item, block, doc, doc_id, low, high.

    A document goes if k others of the block are certainly better; of equal scores the smaller doc_id is better.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r: Ranking = known.value
        for (block,), group in arrow_groups(batches, ["block"]):
            names = group.column("term").to_pylist().index(_NAMES)
            ids, unnamed = np.frombuffer(group.column("docs")[names].as_py(), np.int64), np.frombuffer(group.column("counts")[names].as_py(), np.uint8)
            place = np.empty(len(ids), np.int64)
            place[np.lexsort((ids, unnamed))] = np.arange(len(ids))  # nulls last
            lists = _lists(group, r)
            out: list[tuple[np.ndarray, ...]] = []
            for item, terms in r.items.items():
                own, held = [], []
                for term, most in zip(terms, r.held.get(item, ())):
                    if term in lists:
                        doc, impact = lists[term]
                        enough = impact >= r.threshold[item]
                        own.append((doc[enough], impact[enough]))
                        held.append((doc[enough], np.full(int(enough.sum()), most, np.int64))) if most else None
                if not own:
                    continue
                low = _sums(len(ids), own)
                high = np.where(low > 0, low + sum(r.held[item]) - _sums(len(ids), held), 0)
                seen = np.flatnonzero(low > 0)
                if len(seen) > k:
                    last = seen[np.lexsort((place[seen], -low[seen]))[k - 1]]
                    seen = seen[(high[seen] > low[last]) | (high[seen] == low[last]) & (place[seen] <= place[last])]
                out.append((np.full(len(seen), item, np.int64), seen, low[seen], high[seen]))
            if out:
                item, doc, low, high = (np.concatenate(x) for x in zip(*out))
                columns = [pa.array(item), pa.array(np.full(len(item), block, np.int64)), pa.array(doc.astype(np.int32)), pa.array(ids[doc], mask=unnamed[doc].astype(bool)), pa.array(low), pa.array(high)]
                yield pa.RecordBatch.from_arrays(columns, ["item", "block", "doc", "doc_id", "low", "high"])

    return run


def _exact_rows(known):
    """Full scores of a block's candidates: rows of the term _NAMES, with item, doc and doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r: Ranking = known.value
        for _, group in arrow_groups(batches, ["block"]):
            asked = group.filter(pc.equal(group.column("term"), _NAMES))
            lists = _lists(group, r) if asked.num_rows else {}
            item, doc = asked.column("item").to_numpy(), asked.column("doc").to_numpy()
            score = np.zeros(len(item), np.int64)
            for i in np.unique(item):
                here = item == i
                score[here] = _sums(BLOCK_DOCS, [lists[t] for t in r.items[int(i)] if t in lists])[doc[here]]
            if len(item):
                yield pa.RecordBatch.from_arrays([asked.column("item").combine_chunks(), asked.column("doc_id").combine_chunks(), pa.array(score)], ["item", "doc_id", "score"])

    return run


def _best(rows: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows of each item."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)


def _kth(rows: DataFrame, k: int, value: str) -> DataFrame:
    """item, tau: the k-th best value of each item that has k."""
    return _best(rows, k, F.col(value).desc()).groupBy("item").agg(F.min(value).alias("tau"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).drop("n")


def _ranked(docs: DataFrame, asked: list, k: int) -> DataFrame | None:
    """item, rank, doc_id, score for the items of asked (item, terms), whose terms are some CHUNK_TERMS."""
    spark = docs.sparkSession
    numbers = {t: i for i, t in enumerate(sorted({t for r in asked for t in r.terms}))}
    items = {r.item: [numbers[t] for t in r.terms] for r in asked}
    segment = _segment_rows(spark.sparkContext.broadcast({t.encode(): i for t, i in numbers.items()}))
    posted = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(segment, _SEGMENTS), "posted")
    n_docs, n_words = posted.filter(F.col("term") == _NAMES).agg(F.sum("size"), F.sum("words")).first()
    if not n_docs:
        return None
    df = {r.term: r.df for r in posted.filter(F.col("term") != _NAMES).groupBy("term").agg(F.sum("size").alias("df")).collect()}
    r = Ranking(items, df, n_docs, n_words)
    known = spark.sparkContext.broadcast(r)
    weighty = posted.filter(F.col("term") != _NAMES)
    lists = materialise(weighty.drop("words").repartitionByRange("term", "block").sortWithinPartitions("term", "block"), "postings")

    heads = lists.mapInArrow(_head_rows(known, k), "term int, block long, doc int, impact long, least long")
    lead = Window.partitionBy("term").orderBy(F.col("impact").desc(), "block", "doc")
    heads = materialise(heads.withColumn("place", F.row_number().over(lead)), "heads")
    best = {r.term: (r.most, r.least) for r in heads.groupBy("term").agg(F.max("impact").alias("most"), F.min("least").alias("least")).collect()}
    wanted = spark.createDataFrame([(i, t) for i, terms in r.items.items() for t in terms] or [(-1, -1)], "item long, term int")
    sums = heads.filter(F.col("place") <= k).join(wanted, "term").groupBy("item", "block", "doc").agg(F.sum("impact").alias("low"))
    r.threshold_by({x.item: x.tau for x in _kth(sums, k, "low").collect()}, best)

    known = spark.sparkContext.broadcast(r)
    fetched = lists.mapInArrow(_fetch_rows(known, False), "block long, term int, docs binary, counts binary")
    names = posted.filter(F.col("term") == _NAMES).select("block", "term", "docs", "counts")
    blocks = fetched.unionByName(names).repartition("block").sortWithinPartitions("block", "term")
    bounds = materialise(blocks.mapInArrow(_bound_rows(known, k), "item long, block long, doc int, doc_id long, low long, high long"), "bounds")
    left = bounds.join(_kth(bounds, k, "low"), "item", "left").filter("high >= coalesce(tau, 0)")
    left = materialise(left.drop("tau"), "candidates")

    sure, open_ = left.filter("low = high").select("item", "doc_id", F.col("low").alias("score")), left.filter("low < high")
    looked = lists.join(open_.select("block").distinct(), "block", "left_semi").mapInArrow(_fetch_rows(known, True), "block long, term int, docs binary, counts binary")
    met = looked.unionByName(open_.select("block", F.lit(_NAMES).alias("term"), "item", "doc", "doc_id"), allowMissingColumns=True)
    exact = met.repartition("block").sortWithinPartitions("block", "term").mapInArrow(_exact_rows(known), "item long, doc_id long, score long")
    return _best(sure.unionByName(exact).filter("score > 0"), k, F.col("score").desc(), F.col("doc_id").asc_nulls_last())


def rank(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """The k best of docs (doc_id, text) for each row of items (item_id, text): item_id, rank (from 1), doc_id, score.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z lower-cased; null has none. A score sums the
    weight of each of the item's terms times its saturated share of the document, in whole numbers. Equal scores rank
    by ascending doc_id, nulls last. Items and documents that repeat an id count each on their own, so an item that
    is there twice has two rows of each rank. An item without a scoring document has no row; empty tables give none;
    other columns are not read.

    Postings are made of the items' terms only; the weights count all documents. More than CHUNK_TERMS terms are ranked chunk
    by chunk, each in a pass over the documents.
    """
    ship(spark := docs.sparkSession)
    asked = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text")
    asked = materialise(asked.mapInArrow(_asked_rows, "item long, item_id long, terms array<string>, n long"), "asked")
    n_chunks = max(1, -(-(asked.agg(F.sum("n")).first()[0] or 0) // CHUNK_TERMS))
    chunk = F.pmod(F.xxhash64("item"), F.lit(n_chunks))
    out = spark.createDataFrame([], "item long, doc_id long, score long, rank int")
    for c in range(n_chunks):
        rows = asked.filter((chunk == c) & (F.col("n") > 0)).select("item", "terms").collect()
        found = _ranked(docs, rows, k) if rows else None
        out = out if found is None else out.unionByName(found)
    return out.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def oracle(k: int = 50) -> str:
    """DuckDB SQL that scores every document that shares a term with an item."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
with asked as (select item_id, unnest(list_distinct({words})) as term from benchmark),
words as (select doc_id, {words} as w from documents),
lengths as (select doc_id, len(w)::bigint as n from words),
whole as (select count(*) filter (n > 0) as docs, sum(n)::bigint as total from lengths),
posts as (select doc_id, term, count(*) as tf from (select doc_id, unnest(w) as term from words) where term in (select term from asked) group by 1, 2),
weights as (select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from posts, whole group by 1),
scores as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::bigint as score
  from posts join asked using (term) join weights using (term) join lengths using (doc_id), whole group by 1, 2),
ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from scores where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= {k}
"""
