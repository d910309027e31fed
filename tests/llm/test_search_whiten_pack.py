"""Ranked search, whitening and packing against brute force: nulls, empty and long texts, ties, repeats, no rows, clashing columns."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewmill.llm import packing, queries, ranking, whitening

public_tokenizers = pytest.importorskip("public_tokenizers")

CLASHING = "doc_id long, text string, rank string, score double, item long, block string, length string, part long, place string, offset boolean"


def brute_rank(docs, items, k):
    find = lambda s: re.findall(rb"[0-9A-Za-z\x80-\xff]+", (s or "").encode().lower())
    bags = [(d, Counter(find(t))) for d, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n_docs, n_words = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for (d, bag), n in zip(bags, sizes):
            s = 0
            for t in set(find(text)) & set(bag):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                s += w * (1_000_000_000 * bag[t] // (1000 * bag[t] + 20 * (50 + 50 * n * n_docs // n_words)))
            if s > 0:
                scores.append((-s, d is None, d))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(scores[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(4000)]
    draw = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = [(i, draw(rng.choice([1, 5, 20, 80, 300]))) for i in range(400)]
    out += [(500 + i, out[3][1].upper()) for i in range(150)]  # ties, more than k of them
    out += [(900, None), (901, ""), (902, " \n\t-!"), (903, draw(30_000)), (None, out[5][1]), (None, None), (7, out[5][1]), (7, out[6][1])]
    out += [(904, "É漢字 naïve\x7fﬁ, É ñandú_x"), (905, "w1-w2.w3")]
    return out


@pytest.fixture(scope="module")
def asked(texts):
    return [(0, texts[3][1]), (1, texts[5][1] + "\n" + texts[9][1]), (2, "É ÑANDÚ naïve w7"), (3, None), (4, "nothing_here zzz"), (5, ""), (1, "w1 w2"), (None, "w3"), (6, texts[403 + 148][1] or "")]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(d, t, "x", 1.5, 3, "y", "z", 4, "u", False) for d, t in texts], CLASHING).repartition(5)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_rank(spark, docs, texts, asked, k):
    items = spark.createDataFrame([(i, t, 9) for i, t in asked], "item_id long, text string, doc_id int").repartition(2)
    got = ranking.rank(docs, items, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_rank(texts, asked, k)


def test_rank_by_chunks(spark, docs, texts, asked, monkeypatch):
    monkeypatch.setattr(ranking, "CHUNK_TERMS", 40)
    items = spark.createDataFrame(asked, "item_id long, text string")
    assert sorted(map(tuple, ranking.rank(docs, items, 3).collect()), key=str) == brute_rank(texts, asked, 3)


def test_rank_nothing(spark, docs, asked):
    items = spark.createDataFrame(asked, "item_id long, text string")
    assert ranking.rank(docs.limit(0), items).count() == 0
    assert ranking.rank(docs, items.limit(0)).count() == 0
    assert ranking.rank(docs.filter("doc_id in (900, 901)"), items).count() == 0


def test_lists_hold_back_less_than_the_threshold():
    r = ranking.Ranking({1: [0, 1, 2], 2: [2]}, {0: 1, 1: 5, 2: 2}, 10, 100)
    r.threshold_by({1: 100}, {0: (90, 40), 1: (20, 3), 2: (50, 34)})
    assert (r.threshold, r.held) == ({1: 34, 2: 0}, {1: [0, 20, 0], 2: [0]}) and r.least.tolist() == [34, 34, 0]
    big = ranking.Ranking({1: [0]}, {0: 1}, 10**12, 10**14)
    n = 4_000_000_000
    assert big.impacts(np.zeros(1, int), np.array([3], np.uint32), np.array([n], np.uint32)).tolist() == [3 * 10**9 // (3000 + 20 * (50 + 50 * n * 10**12 // 10**14))]


def vectors(rng, n, d):
    return (rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * 0.2).astype(np.float32)


def test_whiten(spark):
    rng = np.random.default_rng(5)
    c = vectors(rng, 300, 12)
    c[200:260] = c[3]  # one vector many times
    rows = [(i, [float(v) for v in x], "x", 3) for i, x in enumerate(c)]
    odd = [(1000, None), (1001, [1.0] * 11 + [None]), (1002, [1.0] * 11 + [float("nan")]), (1003, [float("-inf")] * 12), (1004, []), (1005, [1.0] * 5), (1006, [1e30] * 12)]
    named = [(None, rows[0][1], "x", 3), (7, rows[1][1], "x", 3)]
    df = spark.createDataFrame(rows + named + [(*o, "x", 3) for o in odd], "vec_id long, embedding array<float>, n string, component long").repartition(4)
    got = whitening.whiten(df)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.collect()
    x = np.floor(1024 * np.concatenate([c, c[:2]]).astype(float)).astype(int) + 100_000
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1], axes[:, ::-1]
    deviation = ((n * x - s) ** 2).sum(axis=1)
    assert len(got) == 8 * n and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    assert got[0].identity_error < 1e-9
    for r in got:
        own = int(deviation[r.vec_id or 0])
        assert r.vec_id == 7 or r.deviation == own
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
    by = {(r.vec_id, r.component): r.whitened for r in got if r.vec_id not in (None, 7)}
    for j in range(8):
        want = y[:300] @ axes[:, j] / np.sqrt(values[j])
        have = np.array([by[i, j + 1] for i in range(300) if i != 7])
        want = np.delete(want, 7)
        assert np.allclose(have, want, atol=1e-8) or np.allclose(have, -want, atol=1e-8)


def test_whiten_without_variance(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25])], schema)).collect()
    assert [(r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, 0.0, 0.0), (2, 1, 0, None, 0.0, 0.0)]
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0, -1.0]) for i in range(4)], schema), components=2).orderBy("component", "vec_id").collect()
    assert [r.whitened for r in line[:4]] == pytest.approx([-1.3416407865, -0.4472135955, 0.4472135955, 1.3416407865]) and {r.whitened for r in line[4:]} == {None}
    assert line[0].identity_error < 1e-12 and line[0].explained == 1


def test_whole_numbers_stay_exact():
    x = np.array([[2**52, 5], [-(2**52), 7]])
    n = 10**6
    y = whitening.centred(x, n, [3, 9])
    assert y.tolist() == [[2**52 * n - 3, 5 * n - 9], [-(2**52) * n - 3, 7 * n - 9]]
    assert whitening.squares(y) == [sum(v * v for v in r) for r in y.tolist()]
    assert whitening.squares(np.array([[3, -4], [0, 0]])) == [25, 0]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(queries.BYTE_BPE))


def check_packing(rows, texts, tokenizer, size):
    """Every row is of a document's pieces, and each sequence is gapless; number of sequences."""
    want = Counter()
    for d, t in texts:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        first = len(ids) % size or size
        cuts = [0, *range(first, len(ids), size), len(ids)]
        for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            want[d, i, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in rows) == want
    inside = defaultdict(list)
    for r in rows:
        inside[r.sequence_id].append((r.offset, r.length))
    for own in inside.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(inside)


def test_pack(spark, docs, texts, tokenizer):
    packed = packing.pack(docs, public_tokenizers.path(queries.BYTE_BPE), 0)
    rows = packed.collect()
    n = check_packing(rows, texts, tokenizer, 2048)
    whole = sum(r.length for r in rows)
    assert -(-whole // 2048) <= n <= -(-whole // 2048) + 1
    own = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    assert len(own) == n and sum(len(r.ids) for r in own.values()) == 4 * whole
    for r in rows:
        s = own[r.sequence_id]
        assert s.ids[4 * r.offset : 4 * (r.offset + r.length)] == r.ids and (r.offset, r.doc_id, r.piece, r.length) in [tuple(p) for p in s.pieces]
    assert packing.pack(docs.limit(0), public_tokenizers.path(queries.BYTE_BPE), 0).count() == 0


def test_pack_small_sequences(spark, docs, texts, tokenizer):
    rows = packing.pack(docs, public_tokenizers.path(queries.BYTE_BPE), 0, size=64).collect()
    assert check_packing(rows, texts, tokenizer, 64) <= sum(n for _, n in packing.best_fit(dict(Counter(r.length for r in rows)), 64)) + 1


def test_cut_points():
    assert packing.cut_points(5, 8) == [0, 5] and packing.cut_points(8, 8) == [0, 8] and packing.cut_points(17, 8) == [0, 1, 9, 17] and packing.cut_points(16, 8) == [0, 8, 16]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 50), max_size=25))
def test_plan(histogram):
    size = 40
    plan = packing.make_plan(histogram, size)
    inside = defaultdict(list)
    for length, n in histogram.items():
        for s, o in zip(*plan.find(np.full(n, length), np.arange(n))):
            inside[int(s)].append((int(o), length))
    assert sorted(inside) == list(range(plan.n_sequences))
    for own in inside.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    # patterns don't cost sequences
    assert plan.n_sequences <= sum(n for _, n in packing.best_fit(dict(histogram), size)) + 1


def test_fit_finds_an_exact_mix():
    # 30 times 10 + 6, 20 times 8 + 8, 12 times 7 + 5 + 4: all fill a sequence of 16
    counts = np.zeros(17)
    counts[[10, 6, 8, 7, 5, 4]] = [30, 30, 40, 12, 12, 12]
    found = packing.patterns(np.flatnonzero(counts), 16)
    x = packing.fit_counts(found, counts, 2000)
    assert np.allclose(np.bincount(found.ravel(), weights=np.repeat(x, 3), minlength=17)[1:], counts[1:], atol=0.05)
    assert packing.make_plan({10: 30, 6: 30, 8: 40, 7: 12, 5: 12, 4: 12}, 16).n_sequences == 62
    assert packing.make_plan({}, 16).n_sequences == 0 and packing.rounded(np.full(10, 0.25)).sum() == 3


TEXT = st.lists(st.sampled_from(["a", "Zebra", "ñandú", "it's", "'ve", "'", "'S", "12", "3.5", " ", "  ", "\n", "\t", "\r\n", " \n ", "<|endoftext|>", "<|", "É", "漢字", " ", " ", "́", "😀", "_", "-", "...", "ı", "ǅ", "\x1c", "\x85", "½", "٣"]), max_size=14).map("".join)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_encoder(tokenizer, text):
    code = packing.encoder(public_tokenizers.path(queries.BYTE_BPE))
    assert code.cuts and code.encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_encoder_forgets(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "MEMORY", 3)
    code = packing.Encoder(public_tokenizers.path(queries.BYTE_BPE))
    text = " ".join(f"word{i % 5} it's x{i}, Überañ" for i in range(40))
    assert code.encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_encoder_of_another_tokenizer():
    file = public_tokenizers.path(queries.WORD_BPE)
    code = packing.Encoder(file)
    assert not code.cuts and code.encode("Some Words") == np.array(code.tokenizer.encode("Some Words", add_special_tokens=False).ids, "<u4").tobytes()


def test_queries(spark):
    folder = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{folder}/documents.parquet").count()
    packed = queries.op13_pattern_packing(spark, folder)
    assert packed.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and packed.filter(F.col("piece") == 0).count() == n
    assert dict(queries.op12_whitening(spark, folder).dtypes)["deviation"] == "bigint"
