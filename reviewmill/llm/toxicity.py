"""Toxicity by multiple-instance learning: sentences are scored, noisy-or makes the document's score."""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship

#: The model is fitted on so many labelled documents of each label at most, the first in order of a hash of the id,
#: and on so many characters at most: a text that would go beyond is passed over. Everything else covers all documents.
FIT_DOCS, FIT_CHARS = 2000, 16_000_000
#: Features are words and their beginnings of these lengths. One is taken if so much speaks against its being spread
#: over toxic and other sentences by chance (Chernoff bound, in nats); so many are taken at most.
STARTS, LEAST_NATS, MOST_FEATURES = (4, 5, 6, 7), 12.0, 4096

#: Least part of the sentences with a feature that are of toxic documents.
LEAST_PURITY = 0.8
#: A sentence without features is never likelier toxic than this log-odds says: labels without a cause don't raise it.
MOST_BIAS = -12.0

_SENTENCE = re.compile(r"[.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """The word, marked as whole, and its beginnings."""
    return [word + "$", *[word[:n] for n in STARTS if len(word) >= n]]


@dataclass
class Model:
    """Weight of each feature in a sentence's log-odds, and the bias that a sentence has without any."""

    weights: dict[str, float]
    bias: float

    def __post_init__(self) -> None:
        self.known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        """Sum of the weights of the word's features."""
        if (x := self.known.get(word)) is None:
            if len(self.known) > 200_000:
                self.known.clear()
            x = self.known[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return x

    def sentences(self, text: str) -> list[tuple[str, float]]:
        """The text's sentences with their probabilities: where the offence is."""
        found = []
        for s in _SENTENCE.split(text):
            if words := set(_WORD.findall(s.lower())):
                found.append((s.strip(), _logistic(self.bias + sum(map(self.weight, words)))))
        return found

    def offending(self, text: str | None) -> list[str]:
        """Every sentence that is more likely toxic than not, in the order of the text."""
        return [s for s, p in self.sentences(text or "") if p >= 0.5]

    def score(self, text: str | None) -> tuple[float, str | None]:
        """Noisy-or over the sentences with a feature, and the worst of them if it's more likely toxic than not.

        Others add nothing: the bias of many clean sentences is no evidence, however long the text.
        """
        if not text or not any(map(self.weight, set(_WORD.findall(text.lower())))):
            return 0.0, None
        each = []
        for s in _SENTENCE.split(text):
            own = list(map(self.weight, set(_WORD.findall(s.lower()))))
            if any(own):
                each.append((s.strip(), _logistic(self.bias + sum(own))))
        if not each:
            return 0.0, None
        worst = max(each, key=lambda x: x[1])
        return float(-np.expm1(sum(np.log1p(-min(p, 1 - 1e-12)) for _, p in each))), worst[0] if worst[1] >= 0.5 else None


def _logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-x)))


def _nats(k: float, n: float, p: float) -> float:
    """How unlikely at least k of n are, each with probability p."""
    x = min(k / n, 1 - 1e-12)
    return n * (x * np.log(x / p) + (1 - x) * np.log((1 - x) / (1 - p))) if x > p else 0.0


def choose(bags: list[tuple[list[tuple[str, ...]], int]]) -> list[str]:
    """Features that mark toxic sentences. Different sentences are counted, so that copies of a document weigh once."""
    kinds: tuple[set[tuple[str, ...]], set[tuple[str, ...]]] = (set(), set())
    for bag, label in bags:
        kinds[label].update(bag)
    toxic = Counter(f for s in kinds[1] for f in {f for w in s for f in features(w)})
    some = {f for f, k in toxic.items() if k >= 3}
    counts = (Counter(f for s in kinds[0] for f in {f for w in s for f in features(w)} if f in some), toxic)
    share = len(kinds[1]) / max(1, len(kinds[0]) + len(kinds[1]))
    nats = {f: _nats(k, k + counts[0][f], share) for f, k in ((f, toxic[f]) for f in some)} if 0 < share < 1 else {}
    purity = {f: counts[1][f] / (counts[1][f] + counts[0][f] + 0.5) for f in nats}
    chosen: list[str] = []
    taken: set[str] = set()
    for f in sorted((f for f, x in nats.items() if x >= LEAST_NATS and purity[f] >= LEAST_PURITY), key=lambda f: (len(f), f)):
        word = f.rstrip("$")
        if not any(word[:n] in taken and purity[word[:n]] >= 0.95 * purity[f] for n in STARTS if f != word[:n]):
            taken.add(f)
            chosen.append(f)
    return sorted(chosen, key=lambda f: (-nats[f], f))[:MOST_FEATURES]


def fit(rows: list[tuple[str, int]], steps: int = 500, rate: float = 0.2, shrink: float = 1e-4) -> Model:
    """Fits sentence weights to document labels: gradient descent (Adam) on the noisy-or's log loss.

    Copies among the rows count once. A sentence without features is toxic with the bias's probability only, so a
    document is kept as the number of those and the features of its other sentences.
    """
    bags = []
    for text, label in dict(rows).items():
        bag = [tuple(sorted(set(map(sys.intern, _WORD.findall(s))))) for s in _SENTENCE.split((text or "").lower())]
        bags.append(([s for s in bag if s], label))
    words = choose(bags)
    at = {w: i for i, w in enumerate(words)}
    doc, item, feature, plain = [], [], [], np.zeros(len(bags))
    k = 0
    for d, (bag, _) in enumerate(bags):
        for s in bag:
            if own := [at[f] for f in {f for w in s for f in features(w)} if f in at]:
                feature += own
                item += [k] * len(own)
                doc.append(d)
                k += 1
            else:
                plain[d] += 1
    y = np.array([label for _, label in bags], float)
    doc, item, feature = np.array(doc, int), np.array(item, int), np.array(feature, int)
    w, m, v = np.zeros(len(words) + 1), 0.0, 0.0
    w[-1] = MOST_BIAS
    for step in range(1, steps + 1):
        z = w[-1] + np.bincount(item, w[feature], k) if k else np.zeros(0)
        soft, base = np.logaddexp(0, z), np.logaddexp(0, w[-1])  # -log(1 - p)
        hazard = np.maximum(np.bincount(doc, soft, len(bags)) + plain * base, 1e-12) if len(bags) else np.zeros(0)
        pull = 1 - y - y * np.exp(-hazard) / -np.expm1(-hazard)  # d loss / d hazard
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-w[-1]))
        each = pull[doc] * p
        g = np.append(np.bincount(feature, each[item], len(words)), each.sum() + (pull * plain).sum() * p0) / max(1, len(bags)) + shrink * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w[-1] = min(w[-1], MOST_BIAS)
    return Model(dict(zip(words, w[:-1].tolist())), float(w[-1]))


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from labelled rows that aren't held out; null labels and ids are no labels. None at all: nothing is toxic."""
    usable = labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = None
    for label in (0, 1):
        some = usable.filter(F.col("toxic") == label).dropDuplicates(["doc_id"]).orderBy(*order).limit(FIT_DOCS)
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").filter("text is not null")
    texts = texts.select("doc_id", "text", "toxic", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"), F.length("text").alias("n"))
    texts = materialise(texts, "fit-texts")
    keys, size = ["toxic", "h", "doc_id", "t"], 0
    # rows that repeat a doc_id leave a label no more than FIT_DOCS texts; their lengths come to the driver before them
    lengths = [r for label in (0, 1) for r in texts.filter(F.col("toxic") == label).select(*keys, "n").distinct().orderBy(*keys).limit(FIT_DOCS).collect()]
    taken = []
    for r in sorted(lengths, key=lambda r: (r.h, r.doc_id, r.t, r.toxic)):
        if size + r.n <= FIT_CHARS:
            size += r.n
            taken.append(tuple(r)[:4])
    if not taken:
        return fit([])
    accepted = docs.sparkSession.createDataFrame(taken, texts.select(*keys).schema)
    rows = texts.join(F.broadcast(accepted), keys, "left_semi").dropDuplicates(keys).collect()
    return fit([(r.text, r.toxic) for r in sorted(rows, key=lambda r: (r.h, r.doc_id, r.t, r.toxic))])


def score_docs(docs: DataFrame, model: Model) -> DataFrame:
    """Scores every row of docs (doc_id, text): doc_id, score, predicted, worst_sentence, offending (sentences, where predicted).

    Null and empty texts have no sentence and score 0. Each row is scored on its own, from its text alone. An empty
    table gives an empty one; other columns are not read.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [model.score(x) for x in texts]
            offending = [model.offending(x) if s >= 0.5 else [] for x, (s, _) in zip(texts, found)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([int(s >= 0.5) for s, _ in found], pa.int32()), pa.array([w for _, w in found], pa.string()), pa.array(offending, pa.list_(pa.string()))],
                ["doc_id", "score", "predicted", "worst_sentence", "offending"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int, worst_sentence string, offending array<string>")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model doesn't call toxic, all their columns: one pass, no join."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(x)[0] < 0.5 for x in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
