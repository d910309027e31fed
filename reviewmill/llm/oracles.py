"""DuckDB SQL that gives the same rows as the queries, where SQL can.

Not for op4 and op5 (fitted models), op7, op9 and op13 (tokenizers) and op12 (eigenvectors): these are tested against
brute force and the libraries.
"""

from __future__ import annotations

from . import licenses, mixing, ranking
from .common import BLOCK_ROWS

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"

EXACT = f"""
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size, doc_id = max(doc_id) over same as kept, sha256(t) as text_sha256
from (select doc_id, {_LOWER} as t from documents) window same as (partition by t)
"""

WARC = """
with p as (select page_id, coalesce(html, '') as html from pages),
q as (select page_id, html, min(page_id) over (partition by html) as first_id, octet_length(encode(html)) as payload_bytes from p)
select page_id, payload_bytes, sha256(html) as payload_digest,
  case when payload_bytes >= 100 and page_id > first_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id > first_id then first_id end as refers_to
from q
"""


def _mix(seed: int = 7) -> str:
    bits = lambda text: f"('0x' || substr(md5({text}), 1, 8))::bigint"
    offset = f"""({bits(f"'{seed}:' || key")} % {mixing.UNIT})"""
    copies = f"(({offset} + before + expected) // {mixing.UNIT} - ({offset} + before) // {mixing.UNIT})"
    a, b, c = mixing.WEIGHTS
    return f"""
with sizes as (select doc_id, source, coalesce('s' || source, 'n') as key, coalesce(len(regexp_extract_all(text, {_WORDS})), 0)::bigint as size,
  {bits("coalesce(text, '')")} as mark from documents),
own as (select source, key, sum(size)::bigint as source_size from sizes group by 1, 2),
weighed as (
  select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then {a} when 1 then {b} else {c} end as weight,
    source_size * {mixing.MOST_COPIES} as cap, sum(source_size) over () as whole from own),
ranked as (
  select *, {mixing.SHARE_NUM} * whole - {mixing.SHARE_DEN} * coalesce(sum(cap) over (rise rows between unbounded preceding and 1 preceding), 0) as num,
    {mixing.SHARE_DEN} * sum(weight) over (rise rows between current row and unbounded following) as den
  from weighed window rise as (order by cap / weight, source nulls last)),
level as (select num, den from ranked where cap * den >= num * weight order by cap / weight, source nulls last limit 1),
targets as (select key, source_size, least(cap::double, weight * level.num::bigint / level.den::bigint) as target from ranked, level),
dealt as (
  select s.*, t.source_size, t.target, case when source_size = 0 then 0 else floor(target * {mixing.UNIT} / source_size + 0.5)::bigint end as expected,
    {bits(f"concat_ws(':', '{seed}', doc_id, mark)")} % greatest(1, (select count(*) from sizes) // {BLOCK_ROWS}) as block
  from sizes s join targets t using (key)),
summed as (
  select *, coalesce(sum(expected) over (partition by key order by block, case when block % 2 = 0 then size else -size end, doc_id, mark rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from dealt)
select doc_id, source, size, source_size, target, {copies} as copies, size * {copies} as taken from summed
"""


NEAR = f"""
with recursive words as (select doc_id, regexp_extract_all({_LOWER}, {_WORDS}) as w from documents),
shingles as (
  select distinct doc_id, w[i] || ' ' || w[i + 1] as s from words, unnest(range(1, len(w))) as r(i)
  union all select doc_id, w[1] from words where len(w) = 1),
sizes as (select doc_id, count(*) as n from shingles group by 1),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from shared join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c >= 80 * (p.n + q.n - c)),
sides as (select x, y from links union all select y, x from links),
reach as (select x as doc_id, y as other from sides union select r.doc_id, b.y from reach r join sides b on b.x = r.other)
select doc_id, coalesce(n, 0) as n_shingles, least(doc_id, coalesce(low, doc_id)) as component_id, least(doc_id, coalesce(low, doc_id)) = doc_id as kept
from words left join sizes using (doc_id) left join (select doc_id, min(other) as low from reach group by 1) using (doc_id)
"""


def _jump(shards: int) -> str:
    """op8 in whole numbers: crc32 by a table of 256 values, the hash's loop by recursion.

    Slots are counted by block; a shard of fewer than two blocks' rows is one, and so its slots follow the ids. This
    SQL is right for such tables: below some 100,000 rows.
    """
    wrap = lambda x: f"(({x}) % 18446744073709551616::uhugeint)"
    step = lambda x, shift, factor: wrap(f"xor({x}, {x} >> {shift})::uhugeint * {factor}::uhugeint") + "::ubigint"
    jump = "floor((b + 1) * (2147483648.0::double / ((x >> 33)::double + 1.0::double)))::bigint"
    return f"""
with recursive bits as (select list(list_reduce([n::ubigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end) order by n) as t from range(256) r(n)),
rows as (select doc_id, encode(coalesce(text, '')) as text from documents),
told as (
  select doc_id, octet_length(text)::bigint + 8 as size,
    xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(regexp_extract_all(hex(text), '..'), lambda h: ('0x' || h)::ubigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::bigint + 1])), 4294967295::ubigint)::bigint as text_crc32
  from rows, bits),
seeds as (select distinct doc_id, {wrap("coalesce(doc_id, -1)::uhugeint + 11400714819323198485::uhugeint")}::ubigint as x from told),
one as (select doc_id, {step('x', 30, 13787848793156543929)} as x from seeds),
two as (select doc_id, {step('x', 27, 10723151780598845931)} as x from one),
keys as (select doc_id, xor(x, x >> 31) as x from two),
jumps as (
  select n, doc_id, x, 0::bigint as b, 0::bigint as j from keys, (values ({shards}), ({shards + 1})) v(n)
  union all
  select n, doc_id, x, j, {jump.replace('(b + 1)', '(j + 1)')} from (select n, doc_id, {wrap("x::uhugeint * 2862933555777941757::uhugeint + 1")}::ubigint as x, j from jumps where j < n)),
landed as (select n, doc_id, max(b) as shard from jumps group by 1, 2),
dealt as (
  select t.*, s.shard::int as shard, g.shard::int as grown_shard from told t
  join landed s on s.doc_id is not distinct from t.doc_id and s.n = {shards} join landed g on g.doc_id is not distinct from t.doc_id and g.n = {shards + 1})
select doc_id, size, text_crc32, 'key' as law, shard, (row_number() over (partition by shard order by doc_id, text_crc32, size) - 1)::bigint as slot, grown_shard from dealt
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_diagonals": licenses.oracle(), "op2_exact_dedup": EXACT, "op3_mix_sources": _mix(), "op6_warc_chunks": WARC, "op8_jump_shards": _jump(24), "op10_near_dups": NEAR, "op11_tput_search": ranking.oracle()}
