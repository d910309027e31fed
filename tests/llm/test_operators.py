"""Small tables with nulls, empty and long texts, ties, repeats, no rows and clashing columns, against brute force."""

import hashlib
import json
import random
import re
import struct
import threading
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewmill.llm import common, exact_dedup, licenses, mixing, near_dups, pieces, quality, sharding, tokens, toxicity, warc
from reviewmill.llm.common import attach_by_key, fresh_path, prefix_sums

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = "the of and lorem ipsum dolor sit amet tempor incididunt ut labore et dolore magna aliqua".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ",", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = [(i, text(rng, rng.randint(1, 120)), "en", rng.choice(["a", "b", "ä", None]), 3) for i in range(150)]
    out += [(200 + i, out[i % 7][1].upper() if i % 2 else out[i % 7][1], "de", "hot", 0) for i in range(60)]
    out += [(300, None, None, None, None), (301, "", "en", "a", 0), (302, "  \n\t", "en", "a", 3), (303, "word", "en", "z", 4), (304, text(rng, 20_000), "en", "a", 9)]
    out += [(305, "Released under the MIT License. All rights reserved. CC BY", "en", "a", 5), (306, "É漢😀 \x1c ﬁ <|endoftext|> <s> naïve's 3.14", "en", "b", 4)]
    base = out[3][1].split()
    out += [(400 + i, " ".join([*base[:i], f"w{i}", *base[i + 1 :]]), "en", "a", 1) for i in range(0, min(40, len(base)))]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    # further columns with the names of results
    return spark.createDataFrame([(*r, "x", 1.5, False) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, keep_id string, score double, kept boolean").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def lower(s):
    return (s or "").encode().lower()


def test_exact(docs, none, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r[0])
    got = {r.doc_id: r for r in exact_dedup.exact_groups(docs).collect()}
    assert len(got) == len(rows)
    for r in rows:
        g, own = got[r[0]], groups[lower(r[1])]
        assert (g.keep_id, g.group_size, g.kept) == (max(own), len(own), r[0] == max(own))
        assert g.text_sha256 == hashlib.sha256(lower(r[1])).hexdigest()
    assert {g.in_history for g in got.values()} == {True, False}
    assert sorted(r.doc_id for r in exact_dedup.drop_repeats(docs).collect()) == sorted(max(v) for v in groups.values())
    assert exact_dedup.exact_groups(none).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 2**63, 5000).astype(np.uint64) for _ in range(2))
    levels = exact_dedup.build_levels(a, b)
    assert sorted(exact_dedup.find_slots(levels, a, b).tolist()) == list(range(5000))
    with pytest.raises(ValueError):
        exact_dedup.build_levels(a[[0, 0]], b[[0, 0]])


def test_licenses(docs, none, rows):
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    for r in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r[1]).decode())
        places = [(i, label) for p, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        g = got[r[0]]
        assert (g.n_words, g.n_base) == (len(words), len(places))
        assert g.base_labels == ",".join(sorted({x for _, x in places})) and set(filter(None, g.base_labels.split(","))) <= set(g.labels.split(","))
        assert (g.first_word, g.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert 0 <= g.score <= 1
    assert "mit" in got[305].labels.split(",") and got[300].n_words == 0 and licenses.scan_licenses(none).count() == 0


def test_license_with_a_word_more(spark):
    df = spark.createDataFrame([(1, "licensed under the well known apache license version 2 0"), (2, "under the table of the license")], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(df).collect()}
    assert got == {1: "apache-2.0", 2: ""}


def test_license_repeats_on_one_diagonal(spark):
    texts = ["of the " * 8, "public license, " * 8, "the terms of the license " * 4, "under the terms of the GNU Lesser General Public License"]
    got = [r.labels for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["", "", "", "gpl,lgpl"]


def test_license_votes_are_different_positions(spark):
    texts = ["rated 4.0, 4.0, 4.0, 4.0, 4.0", "2.0 " * 7, "4.0 " * 500, "4.0 4.0 4.0 licensed under CC BY-NC 4.0", "by nc 4 0 licensed under cc"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score, r.n_spans, r.first_span) for r in licenses.scan_licenses(df).collect()}
    assert [got[i][0] for i in range(3)] == [""] * 3 and got[0][1] == round(1 / 6, 6)
    assert "cc-by-nc-4.0" in got[3][0].split(",") and got[3][1:] == (1, 1, 6) and got[4][2] == 0


def test_mix(docs, none, rows):
    got = mixing.mix_plan(docs).collect()
    size = {r[0]: len((r[1] or "").encode().split()) for r in rows}
    assert {g.doc_id: g["size"] for g in got} == size
    sources = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    own, weight = defaultdict(int), {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    for r in rows:
        own[r[3]] += size[r[0]]
    target, left, total = {}, set(sources), 1.5 * sum(own.values())
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * level > 2 * own[s]}
        if not over:
            break
        target |= {s: 2.0 * own[s] for s in over}
        left -= over
    target |= {s: weight[s] * level for s in left}
    taken = defaultdict(int)
    for g in got:
        assert g.target == pytest.approx(target[g.source]) and g.source_size == own[g.source] and g.taken <= 2 * g["size"] and g.taken == g.copies * g["size"]
        taken[g.source] += g.taken
    for s in sources:
        assert abs(taken[s] - target[s]) <= max(size[r[0]] for r in rows if r[3] == s)
    assert sorted(mixing.mix_plan(docs.repartition(5)).collect(), key=str) == sorted(got, key=str)
    assert mixing.mixed(docs).count() == sum(g.copies for g in got) and mixing.mix_plan(none).count() == 0


def test_quality(docs, none, rows):
    got = {r.doc_id: r for r in quality.score_quality(docs).collect()}
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        windows = Counter(zip(words, words[1:], words[2:]))
        repeat = {i + j for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in range(3)}
        lines = [x for x in (r[1] or "").split("\n") if x.split()]
        g = got[r[0]]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", r[1] or "")), len(lines) - len(set(lines)), len(repeat))
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (g.base_failed and g.kept)
    assert quality.score_quality(none).count() == 0


def test_estimate_distrusts_a_rule():
    rng = np.random.default_rng(5)
    good = rng.random(4000) < 0.8
    votes = np.where(rng.random((4000, 8)) < 0.95, np.where(good, 2, 0)[:, None], np.where(good, 0, 2)[:, None])
    votes[:, : quality.ANCHORS] = np.where(good[:, None], 2, 0)
    votes[:, 7] = rng.integers(0, 3, 4000)  # says nothing
    patterns, inverse, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    found, given = quality.estimate(patterns, n.astype(float))
    assert ((found[inverse.ravel()] > 0.5) == good).mean() > 0.99
    assert abs(given[0, 7, 0] - given[1, 7, 0]) < 0.2 < given[0, 5, 0] - given[1, 5, 0]


def test_toxicity(spark, docs, none):
    rng = random.Random(7)
    data = [(i, ". ".join(text(rng, 12).replace(".", "") for _ in range(6)), int(i % 4 == 0)) for i in range(600)]
    data = [(i, t.replace("amet", "vileword", 1) + ". vilewords" if y else t.replace("vile", "x"), y) for i, t, y in data]
    df = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    model = toxicity.train(df.drop("toxic"), df.select("doc_id", "toxic").unionByName(spark.sql("select cast(null as bigint) doc_id, cast(null as int) toxic")))
    got = toxicity.score_docs(df, model).withColumn("held_out", toxicity.held_out(F.col("doc_id"))).collect()
    held = [g for g in got if g.held_out]
    assert [zlib.crc32(str(g.doc_id).encode()) % 5 == 0 for g in got] == [g.held_out for g in got]
    assert sum(g.predicted == (g.doc_id % 4 == 0) for g in held) / len(held) > 0.95
    assert all("vile" in g.worst_sentence for g in got if g.worst_sentence)
    assert all("vile" in x for g in got for x in g.offending) and any(len(g.offending) == 2 for g in got) and all(g.predicted or not g.offending for g in got)
    other = {g.doc_id: g for g in toxicity.score_docs(docs, model).collect()}
    assert (other[300].score, other[301].score, other[302].score) == (0, 0, 0) and len(other) == docs.count()
    assert toxicity.drop_toxic(docs, model).columns == docs.columns and toxicity.score_docs(none, model).count() == 0
    empty = toxicity.train(none, df.select("doc_id", "toxic").limit(0))
    assert toxicity.score_docs(docs, empty).filter("predicted = 1").count() == 0


def test_scores_by_brute_force(spark, docs, rows):
    """Every document's score from the model's weights alone, sentence by sentence."""
    rng = random.Random(17)
    model = toxicity.Model({w[:n] + end: rng.uniform(-3, 9) for w in WORDS for n, end in ((4, ""), (6, ""), (len(w), "$")) if len(w) >= n and rng.random() < 0.4}, -9.0)
    got = {r.doc_id: r for r in toxicity.score_docs(docs, model).collect()}
    for r in rows:
        left, offending = 1.0, []
        for s in re.split(r"[.!?\n]+", r[1] or ""):
            own = [sum(model.weights.get(f, 0) for f in [w + "$", *[w[:n] for n in (4, 5, 6, 7) if len(w) >= n]]) for w in set(re.findall(r"[^\W\d_]+", s.lower()))]
            if any(own):
                p = 1 / (1 + np.exp(-(model.bias + sum(own))))
                left *= 1 - p
                offending += [s.strip()] if p >= 0.5 else []
        assert got[r[0]].score == pytest.approx(1 - left, abs=1e-9) and got[r[0]].predicted == int(1 - left >= 0.5)
        assert got[r[0]].offending == (offending if 1 - left >= 0.5 else [])
    assert 0 < sum(g.predicted for g in got.values()) < len(rows)


def test_fit_passes_over_a_text_too_long(spark, monkeypatch):
    data = [(i, f"{'vileword' if i % 2 else 'lorem'} number{i}. ipsum", i % 2) for i in range(60)]
    df = spark.createDataFrame([(-1, "x" * 5000, 1), *data], "doc_id long, text string, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda rows: seen.append(rows))
    monkeypatch.setattr(toxicity, "FIT_CHARS", sum(len(t) for _, t, _ in data) // 2)
    monkeypatch.setattr(toxicity, "held_out", lambda doc_id: F.lit(False))
    toxicity.train(df.drop("toxic"), df.select("doc_id", "toxic"))
    size, want = 0, []
    for r in df.orderBy(F.xxhash64("doc_id")).collect():
        if size + len(r.text) <= toxicity.FIT_CHARS:
            size += len(r.text)
            want.append((r.text, r.toxic))
    assert seen == [want] and len(want) > 25


def test_noisy_or():
    model = toxicity.Model({"bad$": 9.0}, -8.0)
    p = 1 / (1 + np.exp(-1.0))
    assert model.score("so bad. bad!")[0] == pytest.approx(1 - (1 - p) ** 2) and model.score("so bad. fine")[1] == "so bad"


def test_length_alone_is_not_toxic():
    model = toxicity.Model({"bad$": 13.0}, toxicity.MOST_BIAS)
    assert model.score("fine\n" * 130_000) == (0.0, None)
    assert model.score("fine\n" * 130_000 + "so bad") == model.score("so bad")


def test_warc(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("ab漢\r\n") for _ in range(200_000))
    data = [(1, "http://a/é\r\nX: y", long), (2, None, None), (3, "u", ""), (4, "u", "x" * 99), (5, "u", "x" * 99), (9, "u", "y" * 100), (7, "u", "y" * 100), (8, "u", "WARC/1.1\r\n\r\n" * 20), (6, "u", long), (None, "u", "z" * 200)]
    pages = spark.createDataFrame([(*r, "k") for r in data], "page_id long, url string, html string, record_type string").repartition(2)
    got = {r.page_id: r for r in warc.archive_pages(pages).collect()}
    assert len(got) == len(data)
    for i, _, html in data:
        body = (html or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {9: 7, 6: 1}
    chunks = warc.chunk_records(pages, warc.decide_records(pages)).filter("page_id = 1").orderBy("chunk_no").collect()
    assert b"".join(c.data for c in chunks) == long.encode() and max(len(c.data) for c in chunks) == warc.CHUNK
    assert [c.digest_so_far for c in chunks] == [hashlib.sha256(long.encode()[: (i + 1) * warc.CHUNK]).hexdigest() for i in range(len(chunks))]
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_warc_null_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 100_000)  # records that are longer than an archive
    long = "ab漢" * 50_000
    data = [(None, "u", "z" * 200), (None, "u", "z" * 200), (None, "v", "z" * 200), (4, "u", "z" * 200), (4, "u", "z" * 200), (5, "u", "z" * 200), (5, "u", "z" * 200), (6, "u", long), (7, None, long), (7, None, "y" * 150)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_pages(pages).collect())
    refers = lambda i, html: {(5, "z" * 200): 4, (7, long): 6}.get((i, html))
    assert got == Counter((i, len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "revisit" if refers(i, h) else "response", refers(i, h)) for i, _, h in data)
    chunks = warc.chunk_records(pages, warc.decide_records(pages)).collect()
    assert sum(c.chunk_no == 0 for c in chunks) == len(data) == sum(c.last for c in chunks)


def test_pieces(docs, none, rows):
    sentencepiece = pytest.importorskip("sentencepiece")
    file = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=file)
    encoded = pieces.encode(docs, file)
    got = {r.doc_id: list(r.ids) for r in encoded.collect()}
    assert got == {r[0]: library.encode(r[1] or "") for r in rows}
    back = {r.doc_id: r.text for r in pieces.decode(encoded, file).collect()}
    assert back == {r[0]: r[1] or "" for r in rows} and all(r.same_text for r in pieces.round_trip(docs, file).collect())
    assert pieces.encode(none, file).count() == 0
    t, rng = pieces.transducer(file), random.Random(11)
    for _ in range(1500):
        s = "".join(rng.choice("ab ▁.eto\n1-=éß漢😀") for _ in range(rng.randint(0, 30)))
        assert t.encode(s).tolist() == library.encode(s)


def model_file(path, pieces, kind):
    """A model file: <unk>, the bytes, then pieces (text, score); no normalising but a space before the text."""
    varint = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)
    part = lambda field, data: varint(field << 3 | 2) + varint(len(data)) + data
    number = lambda field, n: varint(field << 3) + varint(n)
    piece = lambda text, score, k: part(1, part(1, text.encode()) + varint(2 << 3 | 5) + struct.pack("<f", score) + number(3, k))
    data = piece("<unk>", 0, 2) + b"".join(piece(f"<0x{b:02X}>", 0, 6) for b in range(256)) + b"".join(piece(t, x, 1) for t, x in pieces)
    data += part(2, number(3, kind) + number(35, 1)) + part(3, part(1, b"identity") + number(3, 1) + number(4, 0) + number(5, 1))
    path.write_bytes(data)
    return str(path)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_unigram(tmp_path, seed):
    sentencepiece = pytest.importorskip("sentencepiece")
    rng = random.Random(seed)
    letters = "abcdeé漢.1"
    found = {"".join(rng.choice(letters) for _ in range(rng.randint(2, 5))) for _ in range(300)}
    found |= {"▁" + x for x in list(found)[:80]} | {"▁", "▁▁", *"abcde.é1"}
    file = model_file(tmp_path / "u.model", [(x, -rng.random() * 9 - len(x) / 2) for x in sorted(found)], 1)
    library, t = sentencepiece.SentencePieceProcessor(model_file=file), pieces.Transducer(file)
    for _ in range(1500):
        s = "".join(rng.choice(letters + "  ▁z😀\n") for _ in range(rng.randint(0, 40)))
        ids = t.encode(s)
        assert ids.tolist() == library.encode(s) and t.decode(ids) == library.decode(library.encode(s))


def test_bpe_of_any_order(tmp_path):
    """Merges of random order, also such that a piece is never made of its own text."""
    sentencepiece = pytest.importorskip("sentencepiece")
    for seed in range(4):
        rng = random.Random(seed)
        found = list({"".join(rng.choice("ab▁"[: 2 + (i == 0)]) for i in range(n)) for n in range(2, 6) for _ in range(12)})
        rng.shuffle(found)
        file = model_file(tmp_path / f"b{seed}.model", [(x, -float(i)) for i, x in enumerate(found)] + [(x, -1000.0 - i) for i, x in enumerate("ab▁")], 2)
        library, t = sentencepiece.SentencePieceProcessor(model_file=file), pieces.Transducer(file)
        for _ in range(500):
            s = "".join(rng.choice("ababab z") for _ in range(rng.randint(0, 30)))
            assert t.encode(s).tolist() == library.encode(s), (seed, s)


def test_a_way_without_weight_goes_straight_on(tmp_path):
    """Few pairs are looked at, and they weigh what merging their text says; dead ends are left as place by place."""
    file, rng = public_tokenizers.path("piece_bpe_32k.model"), random.Random(5)
    t, parts = pieces.Transducer(file), "the er in ost ung ción ß ent re sh on le Ab 漢".split()
    words = [" " + "".join(rng.choice(parts) for _ in range(rng.randint(2, 6))) for _ in range(3000)]

    class Asked(dict):
        n = 0

        def get(self, *key):
            self.n += 1
            return super().get(*key)

    t.left_alone = Asked()
    ids = t.encode("".join(words))
    assert t.left_alone.n < len(ids)  # place by place: 1.4 times that
    assert all(t.weightless(w) == t.shortest(w) for w in words)
    for seed in range(4):
        rng = random.Random(seed)
        found = list({"".join(rng.choice("ab▁"[: 2 + (i == 0)]) for i in range(n)) for n in range(2, 6) for _ in range(12)})
        rng.shuffle(found)
        t = pieces.Transducer(model_file(tmp_path / f"p{seed}.model", [(x, -float(i // (1 + seed))) for i, x in enumerate(found)] + [(x, -1000.0) for x in "ab▁"], 2))
        assert t.closed
        for a in t.weights:
            for b in t.weights:
                x, y = t.names[a], t.names[b]
                assert (t.between(a, b) == 0) == (t.merge(x + y) == [x, y])
        for _ in range(300):
            s = "".join(rng.choice("ababab z😀") for _ in range(rng.randint(1, 30)))
            assert t.weightless(s) == t.shortest(s), (seed, s)


def test_other_models_are_refused(tmp_path):
    with pytest.raises(ValueError):
        pieces.Transducer(model_file(tmp_path / "w.model", [("a", -1.0)], 3))


def test_shards(docs, none, rows):
    def jump(key, n):
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
        return b

    def mix(x):
        x = (x + 0x9E3779B97F4A7C15) % 2**64
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return x ^ x >> 31

    got = {r.doc_id: r for r in sharding.assign_shards(docs, 5).collect()}
    slots = defaultdict(list)
    for r in rows:
        g, body = got[r[0]], (r[1] or "").encode()
        assert (g["size"], g.text_crc32) == (len(body) + 8, zlib.crc32(body))
        assert (g.shard, g.grown_shard) == (jump(mix(r[0]), 5), jump(mix(r[0]), 6)) and g.grown_shard in (g.shard, 5)
        slots[g.shard].append(g.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sharding.assign_shards(none, 5).count() == 0


def test_write_shards(spark, docs, rows, tmp_path):
    sharding.write_shards(docs, 5, str(tmp_path / "out"))
    got = {(r.doc_id, r.shard) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.doc_id, r.shard) for r in sharding.assign_shards(docs, 5).collect()} and len(got) == len(rows)


@pytest.mark.parametrize("scheme", ["file://", ""])
def test_settled_leaves_its_result_only(spark, monkeypatch, tmp_path, scheme):
    monkeypatch.setattr(common, "scratch_dir", lambda spark: f"{scheme}{tmp_path}")
    other = common.materialise(spark.range(4), "other")
    build = lambda: common.materialise(common.materialise(spark.range(9), "a").filter("id > 2"), "b")
    first = common.settled(spark, build, "one")
    assert sorted(x.name[:3] for x in tmp_path.iterdir()) == ["one", "oth"] and first.rows.count() == 6
    second = common.settled(spark, lambda: first.rows.filter("id > 5"), "two")
    first.drop()
    assert sorted(x.name[:3] for x in tmp_path.iterdir()) == ["oth", "two"] and second.rows.count() == 3 and other.count() == 4
    with pytest.raises(ZeroDivisionError):
        common.settled(spark, lambda: common.materialise(spark.range(2), "c") and 1 / 0, "bad")
    assert sorted(x.name[:3] for x in tmp_path.iterdir()) == ["oth", "two"]


def test_settled_beside_another_query(spark, monkeypatch, tmp_path):
    """A table that another thread makes meanwhile stays."""
    monkeypatch.setattr(common, "scratch_dir", lambda spark: f"file://{tmp_path}")
    made = []

    def build():
        out = common.materialise(spark.range(5), "own")
        other = threading.Thread(target=lambda: made.append(common.materialise(spark.range(7), "other")))
        other.start()
        other.join()
        return out

    assert common.settled(spark, build, "one").rows.count() == 5 and made[0].count() == 7


def test_columns_of_any_name_come_back(spark, rows, tmp_path):
    names = ["doc_id", "text", "lang", "source", "n_chars", "__row", "__ROW_", "__name", "__part", "__times", "__copy", "shard", "Key", "Size", "block", "node", "digest"]
    some = [r for r in rows if r[0] % 3 == 0]
    df = spark.createDataFrame([(*r, *(f"{c}{r[0]}" for c in names[5:])) for r in some], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names[5:])).repartition(3)
    labels = spark.createDataFrame([(r[0], 0) for r in some], "doc_id long, toxic int")
    for out in (exact_dedup.drop_repeats(df), near_dups.drop_near_repeats(df), mixing.mixed(df), toxicity.drop_toxic(df, toxicity.train(df, labels))):
        got = out.collect()
        assert out.columns == names and got
        assert all(r[c] == f"{c}{r.doc_id}" for r in got for c in names[5:])
    with pytest.raises(ValueError):
        sharding.write_shards(df, 3, str(tmp_path / "a"))
    sharding.write_shards(df, 3, str(tmp_path / "b"), "dealt_to")
    assert {r.shard for r in spark.read.parquet(str(tmp_path / "b")).collect()} == {f"shard{r[0]}" for r in some}


def test_a_third_of_ids_null(spark):
    """Null ids are spread over the files of tokens, over blocks of slots and over blocks of the mix."""
    docs = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"), F.lit("a").alias("source")).repartition(7)
    manifest = tokens.write_tokens(docs.repartition(7), public_tokenizers.path("word_bpe_49k.json"), fresh_path(spark, "t"), 2).collect()
    assert sum(m.n_docs for m in manifest) == 30_000 and (len(manifest) == 1 or max(m.n_docs for m in manifest) < 1.5 * 30_000 / len(manifest))
    same = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
    for df in (docs, same):
        slots = sharding.assign_shards(df, 2)
        assert sorted(r.slot for r in slots.filter("shard = 0").collect()) == list(range(slots.filter("shard = 0").count()))
    seen = []

    def spy(rows, group, block, *rest):
        seen.append(max(r["count"] for r in rows.groupBy(*group, block).count().collect()))
        return prefix_sums(rows, group, block, *rest)

    for module, run in ((sharding, lambda: sharding.assign_shards(docs, 2)), (mixing, lambda: mixing.mix_plan(docs))):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(module, "prefix_sums", spy)
            run()
    assert len(seen) == 2 and max(seen) < 30_000 / 9  # 10,000 if a key were one block


def test_tokens(spark, docs, none, rows):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    file, start = public_tokenizers.path("word_bpe_49k.json"), 0
    manifest = tokens.write_tokens(docs, file, fresh_path(spark, "t"), 2)
    got = {r.doc_id: r for r in tokens.read_tokens(manifest).collect()}
    stream = []
    for r in sorted(rows, key=lambda r: r[0]):
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [2]
        assert (got[r[0]].start, got[r[0]].n_tokens, got[r[0]].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        stream += ids
    first = min(manifest.collect(), key=lambda m: m.part)
    ids, mask = tokens.read_sequence(first.path, 0)
    n = min(first.n_ids, tokens.SEQUENCE)
    assert len(ids) == tokens.SEQUENCE and mask.sum() == n and ids[mask > 0].tolist() == stream[:n] and not ids.flags.owndata and not mask.flags.owndata
    assert tokens.token_index(none, file, 2).count() == 0


def test_parts_are_in_order():
    rng = np.random.default_rng(8)
    ids = np.sort(np.where(rng.random(9000) < 0.4, 7, rng.integers(0, 1000, 9000)))
    bounds = np.sort(rng.choice(ids, 15))
    told = rng.integers(-(2**63), 2**63, len(ids))
    order = np.lexsort((told, ids))
    part = tokens.part_of(bounds, ids[order], told[order])
    assert (np.diff(part) >= 0).all() and part.min() == 0 and part.max() == 15 and np.bincount(part).max() < 3 * 9000 / 16
    assert tokens.part_of(np.zeros(0, np.int64), ids[:3], told[:3]).tolist() == [0, 0, 0]


def test_plain_letters():
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(file := public_tokenizers.path("word_bpe_49k.json"))
    code = tokens.Encoder(file)
    for c in map(chr, range(0xC0, 0x250)):
        for word in (f"{c}lifba", f"ab{c}cd", f"a{c}{c.lower()}'s 3{c}{c}!", f"{c}'S-{c}"):
            assert np.frombuffer(code.encode(word), code.dtype).tolist() == library.encode(word, add_special_tokens=False).ids, word


def reachable(rows, k, percent=80):
    sets = {}
    for r in rows:
        w = lower(r[1]).split()
        sets[r[0]] = frozenset(zip(*[w[j:] for j in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near(docs, none, rows, k):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.link(docs, k).collect()}
    want = reachable(rows, k)
    assert got == want
    if k == 5:
        assert sorted(r.doc_id for r in near_dups.drop_near_repeats(docs).collect()) == sorted(i for i, (_, c) in want.items() if c == i)
        assert near_dups.link(none, k).count() == 0


@pytest.mark.parametrize("percent", [50, 60, 70, 90])
def test_near_at_any_percent(spark, percent):
    rng = random.Random(percent)
    rows = []
    for i in range(150):  # pairs about the limit
        a = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([50, 120]))]
        shared = round(len(a) * 2 * percent / (100 + percent)) + rng.choice([-1, 0, 1, 3])
        b = a[:shared] + [f"x{rng.randrange(10**6)}" for _ in range(max(0, len(a) - shared))]
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.link(spark.createDataFrame(rows, "doc_id long, text string"), 1, percent).collect()}
    want = reachable(rows, 1, percent)
    assert got == want and sum(c != i for i, (_, c) in want.items()) > 50


def test_bands_by_percent():
    assert [near_dups.band_width(p) for p in (50, 80, 90)] == [2, 4, 5] and [near_dups.least_agreeing(p) for p in (50, 80, 100)] == [31, 76, 128]
    for percent in (0, 5, 101):
        with pytest.raises(ValueError):
            near_dups.band_width(percent)


def middle_leader_rows():
    """1 and 2 are similar and meet in buckets of two only; 2 leads 1 there, but 3 is a more and 4 a less famous leader of 1."""

    def words(seed, n):
        r = random.Random(seed)
        return [f"w{r.randrange(10**6)}" for _ in range(n)]

    x = words(0, 100)
    y = x[:-9] + words(1, 9)
    z1, z2 = x[30:] + words(100, 40), x[30:] + words(241, 40)
    out = [x, y, z1, z2, z1[:-1] + words(30000, 1), z1[:-1] + words(30001, 1), z2[:-5] + words(20015, 5)]
    out += [y[30:] + words(s, 40) for s in (10010, 10011, 10013, 10800)]
    return [(i, " ".join(w)) for i, w in enumerate(out, 1)]


def test_near_buckets_of_two(spark):
    rows = middle_leader_rows()
    keys = {i: set(near_dups.band_keys(near_dups.sketch(near_dups.shingle_set(t.encode(), 5))).tolist()) for i, t in rows}
    buckets = [b for k in set().union(*keys.values()) if len(b := {i for i in keys if k in keys[i]}) > 1]
    fame = {i: sum(len(b) for b in buckets if i in b) for i in keys}
    order = lambda i: (fame[i], -i)
    assert {1, 2} in buckets and all(b == {1, 2} for b in buckets if {1, 2} <= b)
    assert order(1) < order(4) < order(2) < order(3) and {1, 4} in buckets and any({1, 3} <= b for b in buckets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.link(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()}
    assert got == reachable(rows, 5) and got[2][1] == 1


def test_every_character():
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(file := public_tokenizers.path("word_bpe_49k.json"))
    code = tokens.Encoder(file)
    assert code.cuts
    for lo in range(0, 0x10000, 64):
        text = " ".join(f"the{c}s {c}of 3{c}" for c in map(chr, range(lo, lo + 64)) if not 0xD800 <= ord(c) < 0xE000)
        assert np.frombuffer(code.encode(text), code.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, hex(lo)


def test_other_tokenizer(rows):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(file := public_tokenizers.path("byte_bpe_50k.json"))
    code = tokens.Encoder(file)
    assert not code.cuts
    for r in rows:
        assert np.frombuffer(code.encode(r[1]), code.dtype).tolist() == library.encode(r[1] or "", add_special_tokens=False).ids


def test_sequences_end_with_documents(tmp_path, monkeypatch):
    """Documents that end at the end of a sequence, of a batch, in the middle, and empty ones."""
    monkeypatch.setattr(tokens, "SEQUENCE", 8)
    monkeypatch.setattr(tokens, "BATCH", 2)
    uri = f"file://{tmp_path}/t.arrow"
    writer, lengths = tokens.SequenceWriter(uri, np.dtype("<u2")), [8, 8, 16, 3, 5, 1, 40, 7, 24, 2]
    docs = [np.arange(n, dtype="<u2") + 100 * i for i, n in enumerate(lengths)]
    for i, ids in enumerate(docs):
        writer.add(i, ids.tobytes())
    writer.close()
    got = list(tokens.read_documents(uri))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).tolist()
    assert got == [(i, s, n, zlib.crc32(ids.astype("<u4").tobytes())) for i, (s, n, ids) in enumerate(zip(starts, lengths, docs))]
    stream = np.concatenate(docs)
    for k in range(-(-len(stream) // 8)):
        ids, mask = tokens.read_sequence(uri, k)
        assert ids[mask > 0].tolist() == stream[8 * k : 8 * k + 8].tolist()


def copies_rows():
    """A group of near copies around the limit of similarity, and documents that only share a passage."""
    rng = random.Random(21)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base, passage, out = words(60), words(40), []
    for i in range(650):
        t = list(base)
        for at in rng.sample(range(60), rng.choice([1, 2, 2, 3, 4, 9])):
            t[at] = f"x{rng.randrange(10**6)}"
        out.append(t)
    out += [passage + words(15) for _ in range(150)] + [words(30) for _ in range(50)]
    rng.shuffle(out)
    return [(i, " ".join(t)) for i, t in enumerate(out)]


@pytest.mark.parametrize("block, shingles, leader_rows, copies", [(256, 1 << 21, 2000, 3), (40, 1 << 21, 50, 3), (256, 56 * 20, 2000, 10**6)])
def test_near_large_groups(spark, monkeypatch, block, shingles, leader_rows, copies):
    for name, value in (("BLOCK", block), ("BLOCK_SHINGLES", shingles), ("LEADER_ROWS", leader_rows), ("COPIES", copies)):
        monkeypatch.setattr(near_dups, name, value)
    rows = copies_rows()
    made, blocks = [], near_dups._in_blocks
    monkeypatch.setattr(near_dups, "_in_blocks", lambda dealt, *a: made.append((dealt.count(), (e := blocks(dealt, *a)).count())) or e)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.link(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()}
    assert got == reachable(rows, 5)
    assert made and all(found <= dealt for dealt, found in made)


def test_block_edges():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**62, 100).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(100) < rng.choice([0.05, 0.1, 0.2]), rng.integers(0, 2**62, 100), base).astype(np.uint64)) for _ in range(60)]
    marks = np.zeros((60, near_dups.COORDINATES), np.uint8)  # all are plausible
    similar = {(i, j) for i in range(60) for j in range(i) if 100 * len(x := np.intersect1d(sets[i], sets[j])) >= 80 * (len(sets[i]) + len(sets[j]) - len(x))}
    comp = np.arange(60)
    for side in (np.zeros(60, int), np.where(comp < 10, 1, 2)):
        links = {(i, j) for i, j in similar if not side.any() or side[i] != side[j]}
        edges = near_dups.block_edges(comp, side, marks, sets, 80)
        whole = near_dups.spanning(*zip(*sorted(links)))
        assert set(edges) <= links and len(edges) == len(whole) and 0 < len(edges) < 60 and near_dups.spanning(*zip(*edges, *links)) == edges
    assert near_dups.block_edges(np.zeros(60, int), np.zeros(60, int), marks, sets, 80) == []


def test_sketch_estimates():
    rng = np.random.default_rng(3)
    for n in (1, 5, 300):
        a = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        x, y = near_dups.sketch(a[:n], 512), near_dups.sketch(a[: 2 * n], 512)
        assert (x != np.iinfo(np.uint64).max).all() and abs((x == y).mean() - 0.5) < 0.1


def test_common_matrix():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 20_000, n).astype(np.uint64)) for n in (1, 40, 9000, 9000, 500)]
    want = [[len(np.intersect1d(x, y)) for y in sets] for x in sets]
    got = near_dups.common_matrix(sets)
    assert [[got[i, j] for j in range(5)] == [near_dups.common_elements(x, y) for y in sets] for i, x in enumerate(sets) if i] and all(got[i, j] == want[i][j] for i in range(5) for j in range(5) if i != j)


def test_null_and_repeated_ids(spark):
    rng = random.Random(13)
    t = [text(rng, 60) for _ in range(6)]
    near = t[5] + " more"
    rows = [(None, t[0], "a"), (None, t[1], "a"), (7, t[1], "a"), (9, t[2], "b"), (9, t[3], "b"), (9, t[3], "b"), (None, t[4], "b"), (None, t[4], "b"), (2**62 + 1, t[5], "a"), (None, near, "a"), (None, None, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    groups = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(df).collect())
    assert groups == Counter([(None, None, 1, None)] * 3 + [(None, 7, 2, None), (7, 7, 2, True), (9, 9, 1, True)] + [(9, 9, 2, True)] * 2 + [(None, None, 2, None)] * 2 + [(2**62 + 1, 2**62 + 1, 1, True)])
    once = exact_dedup.drop_repeats(df)
    want = [(None, t[0]), (7, t[1]), (9, t[2]), (9, t[3]), (None, t[4]), (2**62 + 1, t[5]), (None, near), (None, None)]
    assert Counter((r.doc_id, r.text) for r in once.collect()) == Counter(want) and once.columns == df.columns
    want.remove((None, near))
    assert Counter((r.doc_id, r.text) for r in near_dups.drop_near_repeats(once).collect()) == Counter(want)
    plan = Counter()
    for r in mixing.mix_plan(df).collect():
        plan[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixing.mixed(df).collect()) == +plan and plan[None] > 0 and plan[9] > 0


def test_hot_keys_and_prefix_sums(spark):
    facts = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    dims = facts.groupBy("k").agg(F.count("*").alias("n"))
    assert attach_by_key(facts, dims, "k", "n", 5000).agg(F.count("*"), F.max("n")).first() == (5000, 1667)
    sums = prefix_sums(facts.withColumn("g", F.lit("x")).withColumn("b", F.col("id") % 7), ["g"], "b", [F.col("id")], F.lit(2).cast("long"), "before")
    assert sorted(r.before for r in sums.collect()) == list(range(0, 10000, 2))


def test_pipeline(spark, tmp_path, docs):
    corpus = pytest.importorskip("corpus_pipeline")
    wide = docs.select("doc_id", "text", "lang", "source", "n_chars")
    wide.write.parquet(str(tmp_path / "documents.parquet"))
    spark.sql("select id doc_id, 1 quality, 0 toxic from range(50)").write.parquet(str(tmp_path / "labels.parquet"))
    stages, now = dict(corpus.STAGES), wide
    kept = exact_dedup.drop_repeats(wide)
    assert stages["toxicity"](spark, wide, str(tmp_path)).count() == wide.count()
    for name in list(stages)[:-1]:
        now = stages[name](spark, now, str(tmp_path))
        assert now.columns == wide.columns, name
        now.write.parquet(path := str(tmp_path / name))
        now = spark.read.parquet(path)
        if name == "near dedup":
            want = reachable([tuple(r) for r in kept.collect()], 5)
            assert sorted(r.doc_id for r in now.collect()) == sorted(i for i, (_, c) in want.items() if c == i)
    out = corpus.run(spark, str(tmp_path))
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in now.collect()) and json.dumps(out.columns)
