"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship

_SYMBOLS, _END = b"#*$%&|<>", b".!?\"')"
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_distinct", "n_letters", "n_upper"]
_BLANK = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]

#: (rule, measure, bad from, good up to): votes bad at or above the first, good at or below the second, else abstains.
#: Measures that are better when high are given as their complement. The first ANCHORS rules name plain junk; how far
#: the others can be trusted is learned from how they agree with these and with each other.
RULES = [
    ("symbols", "n_symbols / n_words", 0.15, 0.02),
    ("repeats", "n_repeat_words / n_words", 0.3, 0.1),
    ("capitals", "n_upper / greatest(n_letters, 1)", 0.4, 0.12),
    ("duplicate lines", "n_dup_lines / greatest(n_lines, 1)", 0.2, 0.1),
    ("unended lines", "1 - n_ended_lines / greatest(n_lines, 1)", 0.5, 0.15),
    ("few different words", "1 - n_distinct / n_words", 0.6, 0.5),
    ("word length", "abs(word_chars / n_words - 6.5)", 3.5, 2.5),
    ("length", "100 / n_words", 1.5, 1.0),
]
ANCHORS = 3


def count_text(text: bytes | None) -> tuple[int, ...]:
    """The counts of one text, in the order of _COUNTS."""
    if not text:
        return (0,) * len(_COUNTS)
    words = text.split()
    n = len(words)
    plain = text.decode("utf-8", "replace")
    letters, upper = len(text.translate(None, _NOT_LETTERS)), len(text.translate(None, _NOT_UPPER))  # A-Z and a-z only
    windows = list(zip(words, words[1:], words[2:]))
    repeat = 0
    if len(set(windows)) < len(windows):
        seen, last = Counter(windows), -1
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeat += i + 2 - max(last, i - 1)
                last = i + 2
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    ended = sum(x.rstrip()[-1:] in _ENDS for x in lines)
    chars = len(plain) - sum(map(plain.count, _BLANK))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    return n, chars, symbols, len(lines) - len(set(lines)), repeat, len(lines), ended, len(set(words)), letters, upper


_ENDS = {bytes([c]) for c in _END}
_NOT_LETTERS = bytes(c for c in range(256) if not bytes([c]).isalpha())
_NOT_UPPER = bytes(c for c in range(256) if not bytes([c]).isupper())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [count_text(x) for x in batch.column(1).cast(pa.binary()).to_pylist()]
        columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * len(_COUNTS)
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *_COUNTS])


def text_counts(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_count, "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS))


#: What is believed of a rule before it is seen, P(bad, abstain, good), of bad and good documents and, for good ones, of
#: the anchors and the others; and the weight of that against the documents.
PRIOR_BAD, PRIOR_ANCHOR, PRIOR_OTHER, PRIOR_WEIGHT = (0.3, 0.2, 0.5), (0.0005, 0.0995, 0.9), (0.03, 0.07, 0.9), 0.2


def estimate(votes: np.ndarray, n: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """EM for two classes. votes: patterns x rules of 0 bad, 1 abstain, 2 good; n: documents of each pattern.

    Returns each pattern's posterior of good, and P(vote | class) as (class, rule, vote). It starts from the
    anchors, whose rate of false alarms is held; one bad vote of another rule decides nothing, and a rule that calls
    good documents bad loses its say.
    """
    bad = votes == 0
    good = np.where(bad[:, :ANCHORS].any(axis=1), 0.001, np.where(bad.sum(axis=1) >= 2, 0.3, 0.98))
    one_hot, total = np.eye(3)[votes], n.sum()
    fine = [PRIOR_ANCHOR] * ANCHORS + [PRIOR_OTHER] * (votes.shape[1] - ANCHORS)
    belief = np.array([[PRIOR_BAD] * votes.shape[1], fine]) * PRIOR_WEIGHT * total
    for _ in range(rounds):
        share = np.stack([1 - good, good]) * n
        given = np.einsum("cp,prv->crv", share, one_hot) + belief
        given /= given.sum(axis=2, keepdims=True)
        given[1, :ANCHORS] = PRIOR_ANCHOR  # else a common kind of junk passes as a habit of good documents
        prior = (share.sum(axis=1) + 0.05 * total) / (1.1 * total)
        log = np.log(prior)[:, None] + np.einsum("crv,prv->cp", np.log(given), one_hot)
        now = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
        moved, good = np.abs(now - good).max(initial=0), now
        if moved < 1e-9:
            break
    return good, given


def score_quality(docs: DataFrame) -> DataFrame:
    """Verdict on every row of docs (doc_id, text): doc_id, the counts, base_failed, quality (0 to 1) and kept.

    Votes are made for every document; EM sees how many documents have each pattern of votes, at most 3 to the
    number of RULES patterns whatever the table, so that all documents count and none goes to the driver. A null or
    empty text has no words, abstains and fails the base. Rows are judged each on its own; rows with one text get
    the same verdict. An empty table gives an empty one; other columns are not read.
    """
    spark = docs.sparkSession
    pattern = F.lit(0)
    for i, (_, measure, bad, fine) in enumerate(RULES):
        value = F.expr(measure)
        vote = F.when(F.col("n_words") == 0, 1).when(value >= bad, 0).when(value <= fine, 2).otherwise(1)
        pattern = pattern + vote * 3**i
    rows = materialise(text_counts(docs).withColumn("pattern", pattern.cast("int")), "counts")
    seen = rows.groupBy("pattern").count().collect()
    patterns = np.array([r[0] for r in seen], np.int64)
    votes = patterns[:, None] // 3 ** np.arange(len(RULES))[None, :] % 3
    good, _ = estimate(votes, np.array([r[1] for r in seen], np.float64)) if seen else (np.array([]), None)
    table = spark.createDataFrame(list(zip(patterns.tolist(), good.tolist())), "pattern int, quality double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.join(F.broadcast(table), "pattern").withColumn("base_failed", failed).select(
        "doc_id", *_COUNTS, "base_failed", F.round("quality", 6).alias("quality"), (~failed & (F.col("quality") >= 0.5)).alias("kept")
    )
