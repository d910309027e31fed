import random
import time

import pytest
from pyspark.sql import functions as F

from reviewmill.functions.text import bad_by_star, clean_text, cut_tags, date_of, height_label, length_cm, merge_columns, phrase_steps, star_of
from reviewmill.operators import labelling, matching
from reviewmill.operators.rules import Rule


def exact(header, pairs):
    return [Rule(header, "exact", i, k, v) for i, (k, v) in enumerate(pairs)]


RULES = exact("画质", [("清晰", "清晰"), ("模糊", "模糊"), ("噪音大", "噪音大"), ("亮", "亮度不错")])


def one(spark, text, rules, **more):
    df = spark.createDataFrame([(1, text)], "review_id int, content string")
    return labelling.label_reviews(df, "content", rules, **more).first()


@pytest.mark.parametrize(
    "text, label",
    [
        ("画面很清晰", "清晰"),
        ("画面不清晰", "模糊"),  # negated before
        ("清晰度不好", "模糊"),  # negated after
        ("开始清晰，但是后来模糊", "模糊"),
        ("噪音大，但是画面清晰", "噪音大"),  # negative candidates first
        ("不如上一台清晰", "模糊"),  # worse than
        ("以前模糊，换货解决了，现在很满意，清晰", "清晰"),  # ends well
        ("", ""),
        ("。，, ", ""),
        (None, ""),
        ("价格便宜", ""),
        ("灯亮", ""),  # one character needs a context
        ("画面亮", "亮度不错"),
        ("not 清晰", "模糊"),
    ],
)
def test_labels(spark, text, label):
    assert one(spark, text, RULES)["画质"] == label


def test_contained_keyword(spark):
    rules = exact("人群", [("懂参数", "发烧友"), ("不懂参数", "小白")])
    assert one(spark, "完全不懂参数看着晕", rules)["人群"] == "小白"
    assert one(spark, "我懂参数也看色域", rules)["人群"] == "发烧友"


def test_other_product(spark):
    rules = exact("h", [("cheap", "质量差")])
    assert one(spark, "after returning many others that were cheap", rules)["h"] == ""
    assert one(spark, "it feels cheap", rules)["h"] == "质量差"


def test_stages_and_ranks(spark):
    rules = [Rule("h", "exact", 0, "aaa", "A", 2), Rule("h", "exact", 1, "bbb", "B", 1), Rule("h", "fuzzy", 0, "c+d", "C"), Rule("h", "en_fallback", 0, "eee", "E")]
    assert one(spark, "aaa bbb", rules)["h"] == "B"
    assert one(spark, "xccd", rules)["h"] == "C"
    assert one(spark, "eee", rules)["h"] == "E"
    assert one(spark, "eee xcd", rules, order=["en_fallback", "fuzzy"])["h"] == "E"


def test_many_labels(spark):
    rules = exact("外观标签", [("太小", "尺寸小"), ("太大", "尺寸大"), ("漂亮", "颜色好看"), ("难看", "颜色不好看")])
    assert one(spark, "太大了，也太小，漂亮又难看", rules)["外观标签"] == "尺寸大/颜色不好看"


def test_flag_and_height(spark):
    got = one(spark, "只有100cm", exact("高度", [("zzz", "z")]), height={"header": "高度", "expected": 180, "tolerance": 5, "small": "偏矮", "large": "偏高", "fine": "合适", "hint": "太矮"})
    assert got["高度"] == "偏矮" and got["bad_review"] == "是"
    assert one(spark, "so bad", RULES, negative="bad")["bad_review"] == "是"
    assert one(spark, "fine", RULES, negative="bad")["bad_review"] == "否"


def values(spark, expr, cells):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("c"))).collect()]


def test_stars(spark):
    cells = ["4", "4.0", "4星", "4 stars", "⭐⭐", "***", "三星", "差评", "中评", "好评", "", None, "abc"]
    assert values(spark, star_of, cells) == [4, 4, 4, 4, 2, 3, 3, 1, 3, 5, None, None, None]
    assert values(spark, lambda c: bad_by_star(c, 3), ["3", "3.5", "x"]) == ["是", "否", "无"]


def test_dates(spark):
    cells = ["2025年4月18日", "2025年04月18", "45765", "20250418", "2025-04-18", "2025/4/18", "April 18, 2025", "", "x", None, "99999999999", "20251399"]
    assert values(spark, date_of, cells) == ["2025-04-18"] * 7 + [""] * 5


def test_cells(spark):
    assert values(spark, cut_tags, ["a/b", "a｜b", "a|b", " a / ", "nan", "", None]) == [["a", "b"]] * 3 + [["a"], [], [], []]
    df = spark.createDataFrame([(None, " x "), (" a", "b"), (" ", None)], "a string, b string")
    assert [r[0] for r in df.select(merge_columns([F.col("a"), F.col("b")])).collect()] == ["x", "a b", ""]


def test_clean(spark):
    steps = phrase_steps({"pet": "宠物", "uncomfortable": "不舒服", "comfortable": "舒服", "easy to use": "好用"}, {"不 错": "好"})
    cells = ["My PET in a competition", "uncomfortable", "Easy  to use", "a　 b\n c", None, "petに", "title: x"]
    got = values(spark, lambda c: clean_text(c, steps, "^title:"), cells)
    assert got == ["my 宠物 in a competition", "不舒服", "easy to use", "a b c", "", "petに", "x"]


def test_heights(spark):
    label = lambda c: height_label(c, 170, 5, "S", "L", "OK", "太矮")
    assert values(spark, label, ["5英尺7", "高180cm", "150 厘米", "太矮", "none"]) == ["OK", "L", "S", "S", None]


def test_index_equals_expressions(spark):
    rng = random.Random(3)
    rules = exact("h", [(k, k) for k in ("a", "ab", "aba", "ba", "bb", "abba", "aa")])
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["", None, "aaaa"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    key = ["start", "minus_size", "ord"]
    for contained in (True, False):
        built = matching.keyword_hits(F.coalesce("t", F.lit("")), rules)
        built = built if contained else matching.drop_contained(built)
        want = {r.i: [tuple(h[k] for k in key) for h in r.hits] for r in df.select("i", built.alias("hits")).collect()}
        got = {r.i: [tuple(h[k] for k in key) for h in r.hits] for r in matching.with_indexed_hits(df, "t", rules, contained=contained).collect()}
        assert got == want


def test_lengths(spark):
    assert values(spark, length_cm, ["180cm", "1.8 m", "6 ft", "6英尺", "75", "x", None]) == [180.0, 180.0, 182.88, 182.88, 75.0, None, None]


LEXICON_RULES = [
    *RULES, Rule("画质", "fuzzy", 0, "卡.{0,2}顿", "系统卡顿"), Rule("画质", "en_fallback", 0, "noisy", "噪音大"), Rule("画质", "en_fallback", 1, "so noisy", "吵"),
    Rule("h", "exact", 0, "aaa", "A", 2), Rule("h", "exact", 1, "bbb", "B", 1), Rule("h", "fuzzy", 0, "c+d", "C"),
    *exact("外观标签", [("太小", "尺寸小"), ("太大", "尺寸大"), ("漂亮", "颜色好看"), ("难看", "颜色不好看")]), Rule("外观标签", "fuzzy", 0, "丑", "外观不好看"),
    *exact("核心痛点", [("低维护", "不想维护"), ("假", "假得明显")]),
]


def test_both_paths_label_alike(spark):
    """One pass in Arrow batches gives what expressions give, over mixtures of every case."""
    rng = random.Random(8)
    cases = ["画面很清晰", "不清晰", "清晰度不好", "但是后来模糊", "噪音大", "不如上一台清晰", "比它更清晰", "换货解决了", "现在很满意", "亮", "画面亮", "系统卡了顿", "noisy", "so noisy", "aaa", "bbb", "xccd", "太大", "太小", "漂亮", "难看", "丑",
             "低维护 low maintenance alternative", "假", "宣传清晰 实际模糊", "这个价位来说", "没想到", "像", "非常", "。", "！", "，", "不过", "returned others bad quality", " "]
    texts = ["".join(rng.choice(cases) for _ in range(rng.randint(0, 8))) for _ in range(150)] + [None, "", "。，,"]
    df = spark.createDataFrame(list(enumerate(texts)), "review_id int, content string").repartition(4)
    label = lambda indexed: sorted(labelling.label_reviews(df, "content", LEXICON_RULES, neutral="一般", indexed=indexed).collect())
    assert label(True) == label(False)


def test_many_rules_and_a_long_text(spark):
    rules = exact("h", [(f"kw{i:04d}", f"label {i}") for i in range(5000)])
    words = [f"kw{i * 7 % 6000:04d}" for i in range(20_000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, ". ".join(words[:50]))], "review_id int, content string")
    began = time.time()
    got = {r.review_id: r for r in labelling.label_reviews(df, "content", rules, statistics=True).collect()}
    assert got[1].h == "label 0" and got[1].exact_hits == sum(int(w[2:]) < 5000 for w in words) and got[2].exact_hits == 50 and time.time() - began < 60
    stats = labelling.match_statistics(labelling.label_reviews(df, "content", rules, statistics=True), ["h"]).first()
    assert tuple(stats) == (got[1].exact_hits + 50, 0, 0)


def test_keyword_join(spark):
    docs = spark.createDataFrame([(1, "ab abc"), (2, "Ab"), (3, None)], "i int, t string")
    rules = spark.createDataFrame([("h", "ab", "x"), ("h", "abc", "y"), ("g", "ab", "z"), ("g", "Ab", "w")], "header string, pattern string, label string")
    got = sorted(tuple(r) for r in matching.keyword_join(docs, "i", "t", rules).collect())
    assert got == [(1, "g", "ab", "z"), (1, "h", "ab", "x"), (1, "h", "abc", "y"), (2, "g", "Ab", "w")]


def test_segments(spark):
    df = spark.createDataFrame([("好。但是坏！不过行",), ("",)], "t string")
    got = [[tuple(s) for s in r[0]] for r in df.select(matching.segments(F.col("t"))).collect()]
    assert got == [[("好", 1, 0), ("坏", 2, 2), ("行", 2, 4)], [("", 1, 0)]]


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["画面很清晰", "画面不清晰", None, "噪音大，但是画面清晰"])], "review_id int, content string")
    df.write.parquet(str(tmp_path / "in"))
    label = lambda x: labelling.label_reviews(x, "content", RULES)
    q = label(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("labels").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(spark.table("labels").collect(), key=str) == sorted(label(df).collect(), key=str)


def test_rule_tables(spark):
    from reviewmill.operators import rules

    config = '{"output_columns":["h"],"exact_rules":{"h":{"k":"l"}},"fuzzy_rules":{"h":[["a.b","x"],["c","y"]]},"en_keyword_to_label_map":{"h":{"e":"z"}}}'
    flat = rules.compile_rules(spark.createDataFrame([(1, config), (2, "{}"), (3, None)], "config_id int, config string"))
    assert sorted(tuple(r)[:6] for r in flat.collect()) == [("1", "h", "en_fallback", 0, "e", "z"), ("1", "h", "exact", 0, "k", "l"), ("1", "h", "fuzzy", 0, "a.b", "x"), ("1", "h", "fuzzy", 1, "c", "y")]
    compiled = rules.collect_rules(flat)
    assert [r.pattern for r in compiled] == ["e", "k", "a.b", "c"]
    sheet = spark.createDataFrame([("h", " k ", "v", "fuzzy"), ("h", "nan", "v", None), (None, "k", "v", ""), ("h", "q", "v", None), ("h", "r", " ", None)], "header string, keyword string, value string, match_type string")
    assert sorted(tuple(r) for r in rules.read_rule_sheet(sheet).collect()) == [("h", "k", "v", "fuzzy"), ("h", "q", "v", "exact"), ("h", "r", "r", "exact")]
    with pytest.raises(ValueError):
        rules.bounded(spark.range(5), 4)
