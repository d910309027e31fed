"""Configurations of twenty parts each, with every section, compiled to rule tables and on to labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules
from .bindings import table

#: k0 to k19 are the keywords of a configuration's parts, g its number.
_K = ", ".join(f"max(case when (p_partkey - 1) % 20 = {i} then concat(p_name, ' ', p_partkey) end) as k{i}" for i in range(20))
CONFIG = """to_json(named_struct(
  'output_columns', array('尺寸/高度', '功能标签', 'look'), 'header_alias_map', map('appearance', 'look', 'ghost', 'nowhere'),
  'exact_semantic_clusters', map('尺寸标签', map('HIGH', array(k0, k1), 'MID', cast(array() as array<string>), 'LOW', array(k2))),
  'exact_rules', map('尺寸/高度', map(k3, k0, k4, 'fine', k1, 'moved'), 'appearance', map(k5, 'pretty', k6, 'plain')),
  'fuzzy_rules', map('look', array(array('p5', 'pretty'), array('(a|b)', 'pretty'), array('p6', 'plain')), '功能标签', array(array('f1', 'useful'))),
  'semantic_groups', map('appearance', map('g1', named_struct('label', 'pretty', 'patterns', array(k7, k8)))),
  'en_map_mode', case when g % 5 = 4 then 'off' end))"""
EN_FLAT, EN_NESTED = "to_json(map(k9, 'fine', k10, 'useful', k11, 'unknown'))", "to_json(map('look', map(k9, 'pretty'), 'ghost', map(k10, 'x')))"
SHEET = "stack(3, 'appearance', k12, 'nice', 'exact', 'new header', k13, ' ', 'fuzzy', 'look', k6, 'of the sheet', cast(null as string)) as (header, keyword, value, match_type)"

RULES_SQL = f"""with n as (select (p_partkey - 1) // 20 as g, {_K} from part group by 1),
r as (
  select g, '尺寸/高度' as header, 'exact' as stage, 0 as ord, lower(k0) as pattern, k0 as label, 0 as pri from n union all select g, '尺寸/高度', 'exact', 1, lower(k2), k2, 2 from n
  union all select g, '尺寸/高度', 'exact', 2, lower(k4), 'fine', null from n union all select g, '尺寸/高度', 'exact', 3, lower(k1), 'moved', null from n
  union all select g, 'look', 'exact', 0, lower(k5), 'pretty', null from n
  union all select g, 'look', 'exact', case when lower(k12) < lower(k6) then 1 else 2 end, lower(k12), 'nice', null from n union all select g, 'look', 'exact', case when lower(k12) < lower(k6) then 2 else 1 end, lower(k6), 'of the sheet', null from n
  union all select g, 'look', 'fuzzy', 0, '(a|b)', 'pretty', null from n union all select g, 'look', 'fuzzy', 1, 'p6', 'plain', null from n union all select g, 'look', 'fuzzy', 2, concat('(', k7, '|', k8, ')'), 'pretty', null from n
  union all select g, '功能标签', 'fuzzy', 0, 'f1', 'useful', null from n union all select g, 'new header', 'fuzzy', 0, k13, k13, null from n
  union all select g, '尺寸/高度', 'en_fallback', 0, k9, 'fine', null from n where g % 5 <> 4 and g % 2 = 0 union all select g, '功能标签', 'en_fallback', 0, k10, 'useful', null from n where g % 5 <> 4 and g % 2 = 0
  union all select g, 'look', 'en_fallback', 0, k9, 'pretty', null from n where g % 5 <> 4 and g % 2 = 1 union all select g, 'ghost', 'en_fallback', 0, k10, 'x', null from n where g % 5 <> 4 and g % 2 = 1)
select g::varchar as config_id, header, stage, ord::int as ord, pattern, label, pri::int as pri from r where pattern is not null"""


def io3_compile_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested configurations, and a rule sheet, to one rule table: IO2, IO3, J6, J7 and U2 to U5 together."""
    n = table(spark, sf_dir, "part").groupBy(F.expr("(p_partkey - 1) div 20").alias("g")).agg(*[F.expr(x) for x in _K.replace(", max(", "|max(").split("|")])
    en = F.expr(f"case when g % 2 = 0 then {EN_FLAT} else {EN_NESTED} end")
    config = F.concat(F.expr(f"substring({CONFIG}, 1, length({CONFIG}) - 1)"), F.lit(', "en_keyword_to_label_map": '), en, F.lit("}"))
    return rules.compile_rules(n.select(F.col("g").alias("config_id"), config.alias("config")), n.select(F.col("g").alias("config_id"), F.expr(SHEET)))
