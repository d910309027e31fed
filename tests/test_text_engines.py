"""Phrase maps and pattern tables of any size against the plain ways."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewmill.functions.text import clean_text, phrase_steps
from reviewmill.operators import rules
from reviewmill.operators.literals import PatternIndex, fold, required
from reviewmill.operators.rewriting import Rewriter, with_clean_text


def plainly(text, steps):
    for source, target, whole in steps:
        if whole:
            text = re.sub(rf"(?<!\w){re.escape(source)}(?!\w)", lambda _: target, text)
        else:
            text = text.replace(source, target)
    return text


PHRASE = st.text("ab c-'很", min_size=1, max_size=4)


@settings(max_examples=400, deadline=None)
@given(st.dictionaries(PHRASE, st.text("abx 很", max_size=5), max_size=12), st.dictionaries(PHRASE, PHRASE, max_size=3), st.text("ab c-'很_x", max_size=40))
def test_rewriter_is_step_after_step(phrases, native, text):
    steps = phrase_steps(phrases, native)
    assert Rewriter(steps).rewrite(text) == plainly(text, steps)


def test_rewriter_chains():
    steps = phrase_steps({"a": "b c", "b": "d", "c d": "e", "aa": "a", "很": "a", "pet": "x"}, {"zz": "很"})
    for text in ("zz", "aa a", "competition pet petition", "zz b", "", "bb", "a\n很"):
        assert Rewriter(steps).rewrite(text) == plainly(text, steps)
    assert Rewriter([]).rewrite("a") == "a"


def test_many_phrases_equal_expressions(spark):
    """Maps of a few phrases go by expressions: the automaton gives the same on random maps."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abç很 -") for _ in range(rng.randint(1, 4)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(80)] + [None, "", "TITLE: Ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, c string")
    for _ in range(3):
        steps = phrase_steps({word(): word() for _ in range(12)}, {word(): word()})
        many = [*steps, *[(f"zz{i}", "y", True) for i in range(40)]]  # never there, but too many for expressions
        got = with_clean_text(df, F.col("c"), "t", many, "^title:").orderBy("i").collect()
        want = df.withColumn("t", clean_text(F.col("c"), steps, "^title:")).orderBy("i").collect()
        assert [r.t for r in got] == [r.t for r in want]


def test_two_thousand_phrases(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    phrases = {word(): word() for _ in range(1200)} | {f"{word()} {word()}": word() for _ in range(800)}
    steps = phrase_steps(phrases)
    texts = [" ".join(rng.choice(list(phrases)) if rng.random() < 0.3 else word() for _ in range(200)) for _ in range(30)]
    got = with_clean_text(spark.createDataFrame(list(enumerate(texts)), "i int, c string"), F.col("c"), "t", steps).orderBy("i").collect()
    assert [r.t for r in got] == [" ".join(plainly(t, steps).split()) for t in texts]


LEAF = st.sampled_from(["a", "b", "K", "ſ", "ß", "é", "很", ".", "[ab]", "[^a]", "[0-9]", "\\d", "ab", "bka", "^", "$", "\\b", "(?=a)", "(?!b)", "(?<=a)"])
PATTERN = st.recursive(
    LEAF,
    lambda inner: st.one_of(
        st.lists(inner, min_size=1, max_size=4).map("".join), st.lists(inner, min_size=2, max_size=3).map(lambda x: f"(?:{'|'.join(x)})"),
        st.tuples(inner, st.sampled_from(["*", "+", "?", "{2}", "{1,3}", "+?", "{0,2}"])).map(lambda x: f"(?:{x[0]}){x[1]}"), inner.map(lambda x: f"({x})"),
    ),
    max_leaves=6,
)


@settings(max_examples=500, deadline=None)
@given(st.lists(PATTERN, min_size=1, max_size=4), st.text("abAkKſßẞsé很 1İıi", max_size=30))
def test_index_finds_what_every_pattern_finds(patterns, text):
    want = [(i, m.span()) for i, p in enumerate(patterns) if (m := re.search(p, text, re.IGNORECASE))]
    for padded in (text, text + "z" * 300):
        found = PatternIndex(patterns).search(padded)
        again = [(i, m.span()) for i, p in enumerate(patterns) if (m := re.search(p, padded, re.IGNORECASE))]
        assert [(i, m.span()) for i, m in found] == again
    assert [(i, m.span()) for i, m in PatternIndex(patterns).search(text)] == want


@pytest.mark.parametrize("pattern, literals", [
    ("licen[sc]e", {"licen": 0}), ("foo|BAR", {"foo": 0, "bar": 0}), ("[0-9]{4,}", None), ("x*", None), ("(?:很|非常)清晰", {"清晰": 2}), ("ab+c", {"ab": 0}),
    ("a{2,3}b", {"ab": 2}), (".*tail", {"tail": None}), ("(abc)\\1", {"abc": 0}), ("straße", {"stra": 0}), ("(?=abc)d", {"d": 0}), ("(?:foo|[0-9])x", {"x": 3}),
])
def test_literals(pattern, literals):
    assert required(pattern) == literals


def test_case_pairs_fold_alike():
    """Every character that a character matches case aside has its folded form, or the pattern has no literal."""
    chars = "".join(chr(c) for c in range(0x20, 0x2C00)) + "".join(chr(c) for c in range(0xA640, 0xABC0))
    cased = [c for c in chars if c.lower() != c or c.upper() != c]
    assert len(cased) > 2000
    for c in cased[::3] + list("ſKıİµiIßẞ"):
        if found := required(re.escape(c)):
            assert all(any(x in fold(m.group()) for x in found) for m in re.finditer(re.escape(c), chars, re.IGNORECASE)), c


def test_two_thousand_patterns_cost_little_more_than_twenty():
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    text = " ".join(word(rng.randint(2, 9)) for _ in range(5500))

    def took(n):
        index = PatternIndex([f"{word(5)}[0-9x]?{word(3)}" for _ in range(n)])
        best = []
        for _ in range(7):
            began = time.process_time()
            index.search(text)
            best.append(time.process_time() - began)
        return min(best)

    assert took(2000) < 4 * took(20) + 0.005


def test_headers_of_names(spark):
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abc很") for _ in range(n))
    headers = list(dict.fromkeys(word(rng.randint(1, 8)) + rng.choice(["", "标签"]) for _ in range(120)))
    aliases = {word(4): rng.choice([*headers, "gone"]) for _ in range(30)}
    names = [word(rng.randint(0, 6)) + rng.choice(["", "标签"]) for _ in range(200)] + headers[:10] + list(aliases)[:10] + [None, "", "标签", headers[0]]

    def means(name):
        if name is None or name in headers:
            return name
        if aliases.get(name) in headers:
            return aliases[name]
        stem = name.removesuffix("标签")
        return next((h for h in headers if stem and stem in h), None)

    order = list(enumerate(headers))
    rng.shuffle(order)
    got = rules.resolve_header(
        spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(h, i) for i, h in order], "header string, ord int"), spark.createDataFrame(list(aliases.items()), "alias string, header string")
    )
    assert sorted(((r.name, r.header) for r in got.collect()), key=str) == sorted(((n, means(n)) for n in names), key=str)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "__one" not in plan and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
