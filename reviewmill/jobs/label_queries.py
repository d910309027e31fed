"""The whole label decision, with SQL of its own: made-up sentences for each case stand in the benchmark's turns."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon
from ..operators import labelling
from ..operators.rules import Rule
from .bindings import PATTERNS, RULES, spread_table

#: One for each case: plain, negated before and after, turn words, two sentences, degree, likeness, better and worse
#: than, claim and fact, price, put right, others' faults, nested keywords, ranks, several labels, easy care, fallback.
SENTENCES = [
    "画面很清晰", "画面不清晰", "清晰度不好", "开始清晰，但是后来模糊", "噪音大，不过画面清晰。流畅", "不如上一台清晰", "比上一台更清晰，也流畅", "以前模糊，换货解决了，现在很满意，清晰",
    "灯亮", "画面亮", "not sharp at all", "after returning many others that were cheap", "it feels cheap", "完全不懂参数看着晕", "我懂参数也看色域，送父母", "宣传清晰，实际模糊",
    "噪音大但这个价位来说流畅", "本来以为模糊 没想到清晰", "像电影一样清晰！非常流畅", "太大了，也太小，漂亮又难看，好丑", "low maintenance alternative 低维护 假", "系统卡了顿，一般般亮", "it is noisy",
    "this one is great, 模糊 and sharp", "never quiet? 有点模糊", "画面比 以前清晰 很多 inferior to others",
]
BLANK = "。，,"
NEUTRAL, NEGATIVE = "一般般|so so", "stupid|idiot"


def _rules(header: str, stage: str, pairs: list[tuple], ranked: bool = False) -> list[Rule]:
    return [Rule(header, stage, i, k, v, i if ranked else None) for i, (k, v) in enumerate(pairs)]


def _topics() -> list[Rule]:
    """100 keywords of two syllables, as there are in the benchmark's words."""
    first, second = ("con", "pro", "re", "en", "la", "de", "ver", "ge", "an", "tion"), ("ta", "que", "der", "ment", "le", "ung", "ier", "la", "ra", "ne")
    return _rules("topic", "exact", [(a + b, f"{a} {i % 4}") for i, a in enumerate(first) for b in second])


LABEL_RULES = [
    *_rules("画质", "exact", [("清晰", "清晰"), ("模糊", "模糊"), ("噪音大", "噪音大"), ("流畅", "流畅"), ("亮", "亮度不错"), ("cheap", "质量差"), ("sharp", "清晰"), ("quiet", "静音")]),
    *_rules("画质", "fuzzy", [("卡.{0,2}顿", "系统卡顿"), ("gr[ae]+t", "稳定")]),
    *_rules("画质", "en_fallback", [("noisy", "噪音大"), ("is noisy", "有点吵")]),
    *_rules("人群", "exact", [("不懂参数", "小白"), ("懂参数", "发烧友"), ("父母", "长辈")], ranked=True),
    *_rules("核心痛点", "exact", [("低维护", "不想维护"), ("假", "假得明显")]),
    *_rules("外观标签", "exact", [("太小", "尺寸小"), ("太大", "尺寸大"), ("漂亮", "颜色好看"), ("难看", "颜色不好看"), ("好", "外观好看")]),
    *_rules("外观标签", "fuzzy", [("太?丑", "外观不好看"), ("又.看", "颜色不好看")]),
    *RULES, *PATTERNS, *_topics(),
]
HEADERS = list(dict.fromkeys(r.header for r in LABEL_RULES))
RANKED = sorted({r.header for r in LABEL_RULES if r.pri is not None})
_CASE = " ".join(f"when {i} then '{s}'" for i, s in enumerate(SENTENCES))
#: The text of a turn with its sentence: the same in Spark and DuckDB.
TEXT = f"case when (conv_id * 7 + turn) % {len(SENTENCES) + 1} = {len(SENTENCES)} then '{BLANK}' else concat(coalesce(text, ''), ' ', case (conv_id * 7 + turn) % {len(SENTENCES) + 1} {_CASE} end) end"


def _re2(pattern: str) -> str:
    """A pattern of the lexicon as a literal for DuckDB, whose (?U) would mean something else."""
    flags = re.match(r"\(\?([iuU]+)\)", pattern)
    body = pattern[flags.end() :] if flags else pattern
    return "'" + ("(?i)" if flags and "i" in flags[1] else "") + f"({body})".replace("'", "''") + "'"


def _has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {_re2(pattern)})"


def _values(rules: list[Rule]) -> str:
    return ", ".join(f"('{r.header}', '{r.stage}', {r.ord}, '{r.pattern}', '{r.label}', {'null' if r.pri is None else r.pri})" for r in rules)


def label_sql() -> str:
    """Common table expressions up to labels (conv_id, turn, header, label) and counts of hits, for LABEL_RULES."""
    one = f"header not in ({', '.join(repr(h) for h in lexicon.MULTI_HEADERS)})"
    opposite = lambda c: "coalesce(case " + c + " " + " ".join(f"when '{a}' then '{b}'" for a, b in lexicon.OPPOSITES.items()) + f" end, {c})"
    polarity = lambda c: f"case when {_has(c, lexicon.NEGATIVE_LABEL)} then -1 when {_has(c, lexicon.POSITIVE_LABEL)} then 1 else 0 end"
    left = lambda n: f"substr(seg, greatest(start - {n}, 0) + 1, least(start, {n}))"
    degree = "case " + " ".join(f"when {_has(left(6), words)} then {points}" for words, points in lexicon.DEGREES) + " else 0 end"
    near = "substr(seg, greatest(start - 3, 0) + 1, start + size + 3 - greatest(start - 3, 0))"
    short = ", ".join(f"'{x}'" for x in lexicon.SHORT_ALLOWED)
    sizes = ", ".join(f"'{x}'" for x in lexicon.SIZE_GROUP)
    groups = ", ".join(f"('{h}', {g}, '{label}', {i})" for h, every in lexicon.EXCLUSIVE.items() for g, own in enumerate(every) for i, label in enumerate(own))
    places = lambda text: f"unnest(list_filter(range(0, length({text})), lambda i: substr({text}, i::bigint + 1, length(pattern)) = pattern)) as start"
    outer = lambda rows, seg: f"""(select * from {rows} p where not exists (select 1 from {rows} q where q.conv_id = p.conv_id and q.turn = p.turn and q.header = p.header {seg}
      and q.start <= p.start and q.start + q.size >= p.start + p.size and q.size > p.size))"""  # noqa: E731
    return f"""rules(header, stage, ord, pattern, label, pri) as (values {_values(LABEL_RULES)}),
groups(header, grp, label, nth) as (values {groups}),
texts as (select conv_id, turn, trim(regexp_replace(lower({TEXT}), '\\s+', ' ', 'g')) as t from conversations),
filled as (select *, {_has('t', lexicon.RESOLVED)} and {_has('t', lexicon.SATISFIED_NOW)} or {_has('t', lexicon.THIS_ITEM_GOOD)} as good_end from texts where not regexp_matches(t, '^[。，,\\s]*$')),
sentences as (select conv_id, turn, i, list_filter(list_transform(regexp_split_to_array(t, '{lexicon.SENTENCE_ENDS}'), lambda x: trim(x)), lambda x: x <> '')[i] as s
  from filled, unnest(range(1, 1 + len(list_filter(list_transform(regexp_split_to_array(t, '{lexicon.SENTENCE_ENDS}'), lambda x: trim(x)), lambda x: x <> '')))) as r(i)),
cut as (select conv_id, turn, i, j, trim(regexp_split_to_array(s, '{lexicon.TURN_WORDS}')[j]) as seg, case when j = 1 then 1 else 2 end as weight
  from sentences, unnest(range(1, 1 + len(regexp_split_to_array(s, '{lexicon.TURN_WORDS}')))) as r(j)),
segs as (select *, coalesce(sum(length(seg) + 1) over (partition by conv_id, turn order by i, j rows between unbounded preceding and 1 preceding), 0) as pos0 from cut where seg <> ''),
keywords as (select s.*, r.header, r.stage, r.ord, r.pattern as keyword, r.label, length(pattern) as size, {places('seg')} from segs s join rules r on contains(seg, pattern) where stage = 'exact' and {one}),
hits as (
  select * from {outer('keywords', 'and q.i = p.i and q.j = p.j')}
  union all select s.*, header, stage, ord, regexp_extract(seg, '(?i)' || pattern), label, length(regexp_extract(seg, '(?i)' || pattern)), length(regexp_extract(seg, '(?i)^(.*?)' || pattern, 1))
  from segs s join rules r on regexp_matches(seg, '(?i)' || pattern) where stage = 'fuzzy' and {one}),
told as (
  select *, start > 0 and ({_has(left(4), f"({'|'.join(lexicon.NEGATION_PREFIXES)})$")} or {_has(left(4), f"({'|'.join(lexicon.NEGATION_TOKENS)})$")} and not {_has('keyword', f"^({'|'.join(lexicon.NEGATION_EXEMPT)})")}
    or {_has(left(14), lexicon.ENGLISH_NEGATION)}) or {_has('substr(seg, start + size + 1, 10)', lexicon.NEGATION_SUFFIX)} as negated
  from hits where length(keyword) <> 1 or {_has(near, lexicon.SHORT_CONTEXT)} or keyword in ({short})),
turned as (select *, case when negated then {opposite('label')} else label end as label2 from told),
signed as (select *, case when negated and label2 = label then -1 else {polarity('label2')} end as polarity2 from turned),
final as (
  select *, case when worse then {opposite('label2')} else label2 end as label3, case when worse then -1 else polarity2 end as polarity
  from (select *, polarity2 > 0 and {_has('seg', lexicon.WORSE_THAN)} as worse from signed)),
found as (
  select conv_id, turn, header, stage, ord, label3 as label, polarity, pos0 + start as pos,
    case when stage = 'exact' then case when negated then 30 else 20 end + least(size, 8) else case when negated then 15 else 10 end end + weight * 10 + {degree}
    + case when polarity > 0 and {_has('seg', lexicon.BETTER_THAN)} or polarity < 0 and {_has('seg', lexicon.WORSE_THAN)} then 3 else 0 end
    + case when {_has('seg', lexicon.ANALOGY)} then case when polarity < 0 then 2 else 1 end else 0 end
    + case when polarity > 0 and {_has('seg', lexicon.PRICE_CONCESSION)} then 4 else 0 end + case when polarity > 0 and {_has('seg', lexicon.EXPECTATION)} then 4 else 0 end
    + case when polarity < 0 and {_has('seg', lexicon.CLAIM_MISMATCH)} then 5 else 0 end + case when polarity = 0 and {_has('seg', '(?i)' + NEUTRAL)} then 2 else 0 end as score
  from final where not (polarity < 0 and ({_has('seg', lexicon.OTHER_PRODUCT)} or {_has('seg', lexicon.EARLIER_PRODUCT)}))),
ranks as (select header, label, min(pri) as pri from rules where pri is not null group by 1, 2),
chosen as (
  select conv_id, turn, header, stage, label, count(*) over (partition by conv_id, turn, header, stage) as n, row_number() over (partition by conv_id, turn, header, stage order by
    case when header = '{lexicon.EASY_CARE_HEADER}' and {_has('t', lexicon.EASY_CARE)} and label = '{lexicon.EASY_CARE_LABEL}' then 0 else 1 end,
    case when header in (select header from ranks) then coalesce(pri, 1000000) when polarity = case when good_end then 1 else -1 end then 0 else 1 end, score desc, pos, ord, polarity, label) as nth
  from found join filled using (conv_id, turn) left join ranks using (header, label)),
fallback as (
  select conv_id, turn, header, label, row_number() over (partition by conv_id, turn, header order by length(pattern) desc, strpos(t, pattern), ord) as nth
  from filled join rules on contains(t, pattern) where stage = 'en_fallback'),
whole as (select f.*, r.header, r.ord, r.label, length(pattern) as size, {places('t')} from filled f join rules r on contains(t, pattern) where stage = 'exact' and not {one}),
several as (
  select conv_id, turn, header, label, 0 as part, start, size, ord from {outer('whole', '')}
  union all select conv_id, turn, header, label, 1, 0, 0, ord from filled join rules r on regexp_matches(t, '(?i)' || pattern) where stage = 'fuzzy' and not {one}),
first_of as (select conv_id, turn, header, label, min(part) as part, min((part, start, size, ord)) as place from several group by 1, 2, 3, 4),
sized as (select *, label in ({sizes}) and header = '{lexicon.MULTI_HEADERS[0]}' and place > min(place) filter (label in ({sizes})) over (partition by conv_id, turn, header) as late from first_of),
kept as (
  select * from sized s where not coalesce(late, false) and not exists (
    select 1 from groups g join groups h on g.header = h.header and g.grp = h.grp and h.nth < g.nth join first_of f on f.label = h.label and f.header = h.header
    where g.header = s.header and g.label = s.label and f.conv_id = s.conv_id and f.turn = s.turn)),
labels as (
  select conv_id, turn, header, first(label order by rank) as label from (
    select conv_id, turn, header, label, case stage when 'exact' then 0 else 1 end as rank from chosen where nth = 1
    union all select conv_id, turn, header, label, 2 from fallback where nth = 1) group by 1, 2, 3
  union all select conv_id, turn, header, string_agg(label, '/' order by place) from kept group by 1, 2, 3),
counted as (
  select conv_id, turn, sum(exact)::bigint as exact_hits, sum(fuzzy)::bigint as fuzzy_hits from (
    select conv_id, turn, header, coalesce(max(n) filter (stage = 'exact'), 0) as exact, case when count(*) filter (stage = 'exact') > 0 then 0 else coalesce(max(n) filter (stage = 'fuzzy'), 0) end as fuzzy
    from chosen group by 1, 2, 3
    union all select conv_id, turn, header, count(*) filter (part = 0), count(*) filter (part = 1) from first_of group by 1, 2, 3) group by 1, 2)"""


_SHOWN = ", ".join(f"""coalesce(max(label) filter (header = '{h}'), '') as "{h}\"""" for h in HEADERS)

LABELS_SQL = f"""with {label_sql()},
wide as (select conv_id, turn, role, t, {_SHOWN} from texts join conversations using (conv_id, turn) left join labels using (conv_id, turn) group by all)
select w.* exclude (t), coalesce(exact_hits, 0) as exact_hits, coalesce(fuzzy_hits, 0) as fuzzy_hits,
  case when not regexp_matches(t, '^[。，,\\s]*$') and ({' or '.join(f'"{h}" <> {chr(39) * 2}' for h in HEADERS)} or {_has('t', '(?i)' + NEGATIVE)}) then '是' else '否' end as bad_review
from wide w left join counted using (conv_id, turn)"""

STATISTICS_SQL = f"""with {label_sql()}
select (select coalesce(sum(exact_hits), 0)::bigint from counted) as exact_hits, (select coalesce(sum(fuzzy_hits), 0)::bigint from counted) as fuzzy_hits,
  (select count(*) from texts) - (select count(*) from (select distinct conv_id, turn from labels)) as unlabelled"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spread_table(spark, sf_dir, "conversations").withColumn("text", F.expr(TEXT))
    return labelling.label_reviews(turns, "text", LABEL_RULES, neutral=NEUTRAL, negative=NEGATIVE, statistics=True)


def w1_label_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain: clean, segments, hits, negation, polarity, scores, pools, ranks, stages, several labels, flag."""
    return _labelled(spark, sf_dir).drop("text", "cleaned_text")


def a5_label_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact hits, fuzzy hits and reviews without a label, of the same chain."""
    return labelling.match_statistics(_labelled(spark, sf_dir), HEADERS)
