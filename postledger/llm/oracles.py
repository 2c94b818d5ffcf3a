"""SQL that must give the same rows as the queries, where SQL can say it."""

from __future__ import annotations

from postledger.llm import chat
from postledger.llm.queries import CONTROL_TEXT

OP7 = """
with n as (
  select doc_id, length(coalesce(text, '')) as n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) as text_sha256
  from documents),
k as (
  select *, first_value(doc_id) over (partition by text_sha256 order by n_chars desc, doc_id) as keep_id,
         count(*) over (partition by text_sha256) as group_size
  from n)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from k
"""

OP8 = """
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents),
s as (
  select source, sum(size)::bigint as source_size,
         [1, 2, 3][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int] as w
  from d group by source),
r as (
  select *, row_number() over (order by 3.0 * source_size / w, source is null, source) as k from s),
p as (
  select *, (select sum(source_size) from s)::bigint - coalesce(sum(3 * source_size) over (order by k rows between unbounded preceding and 1 preceding), 0)::bigint as rest,
         sum(w) over (order by k rows between current row and unbounded following)::bigint as weight
  from r),
level as (
  select rest, weight from p where rest * w <= 3 * source_size * weight order by k limit 1),
t as (
  select source, source_size, least((3 * source_size)::double, (w * rest)::double / weight::double) as target
  from s, (select rest, weight from level)),
x as (
  select d.doc_id, d.size, t.source_size, t.target,
         case when t.source_size > 0 then t.target / t.source_size else 0.0 end as rate,
         row_number() over (partition by d.source order by d.size, md5('17-' || coalesce(d.doc_id::varchar, '')), d.doc_id) - 1 as pos
  from d join t on d.source is not distinct from t.source),
c as (
  select *, (floor(rate) + floor((pos + 1) * (rate - floor(rate)) + 0.5) - floor(pos * (rate - floor(rate)) + 0.5))::bigint as copies from x)
select doc_id, size, source_size, target, copies, copies * size as taken from c
"""

_ESCAPED = "{}"
for _plain, _coded in chat.ESCAPES:
    _ESCAPED = f"replace({_ESCAPED}, '{_plain}', '{_coded}')"

OP10 = f"""
with r as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{CONTROL_TEXT}'
  union all select -1, 1, 'assistant', '{CONTROL_TEXT}'),
p as (
  select *, lag(role) over (partition by conv_id order by turn, role, text) as before from r),
f as (
  select *, case when before = role then {len(chat.NEXT)}
                 else {len(chat.OPEN) + len(chat.BODY) + len(chat.CLOSE)} + length({_ESCAPED.format("role")}) end
            + length({_ESCAPED.format("text")}) as chars
  from p)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(chars)::bigint as formatted_chars
from f group by conv_id
"""

# CRC-32 of the digits of an id, bit by bit.
_CRC = """list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
    lambda h, b: list_reduce(list_concat([xor(h, b)], range(8)), lambda x, i: xor(x >> 1, case when x & 1 = 1 then 3988292384::bigint else 0::bigint end)))"""

_FRAMED = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')"
_REST = " || ".join(_FRAMED.format(c) for c in ("doc_id", "source", "lang", "n_chars"))

OP11 = f"""
with recursive d as (
  select doc_id, lang, sha256({_REST} || {_FRAMED.format("text")}) as leaf,
         case when xor({_CRC}, 4294967295::bigint) % 3 = 0
              then sha256({_REST} || {_FRAMED.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) end as changed
  from documents),
l as (
  select *, row_number() over (partition by lang order by doc_id, leaf) - 1 as pos, count(*) over (partition by lang) as n from d),
nodes as (
  select lang, 0 as level, pos, leaf as node, n from l
  union all
  select lang, level + 1, pos // 8, sha256(string_agg(node, '' order by pos)), (any_value(n) + 7) // 8
  from nodes where n > 1 group by lang, level, pos // 8),
subroots as (
  select lang, node as subroot, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n from nodes where n = 1),
tops as (
  select 0 as level, pos, subroot as node, n from subroots
  union all
  select level + 1, pos // 8, sha256(string_agg(node, '' order by pos)), (any_value(n) + 7) // 8
  from tops where n > 1 group by level, pos // 8),
steps as (
  select l.lang, l.pos, x.level, x.pos as place, x.node
  from l join nodes x on x.lang is not distinct from l.lang and x.pos // 8 = l.pos // power(8, x.level + 1)::bigint and x.n > 1
  union all
  select l.lang, l.pos, 1000 + x.level, x.pos, x.node
  from l join subroots s on s.lang is not distinct from l.lang join tops x on x.pos // 8 = s.pos // power(8, x.level + 1)::bigint and x.n > 1),
sided as (
  select steps.*, case when level < 1000 then steps.pos // power(8, level)::bigint else s.pos // power(8, level - 1000)::bigint end as own
  from steps join subroots s on s.lang is not distinct from steps.lang),
sides as (
  select lang, pos, level, coalesce(string_agg(node, '' order by place) filter (where place < own), '') as left_side,
         coalesce(string_agg(node, '' order by place) filter (where place > own), '') as right_side
  from sided group by lang, pos, level),
path as (
  select *, row_number() over (partition by lang, pos order by level) as step from sides),
proofs as (
  select lang, pos, sha256(string_agg(left_side || right_side, '' order by level)) as proof_sha256, count(*) as height from path group by lang, pos),
folded as (
  select lang, pos, 0::bigint as step, coalesce(changed, leaf) as node from l
  union all
  select f.lang, f.pos, p.step, sha256(p.left_side || f.node || p.right_side)
  from folded f join path p on p.lang is not distinct from f.lang and p.pos = f.pos and p.step = f.step + 1)
select l.doc_id, l.leaf, s.subroot, t.node as root, coalesce(p.proof_sha256, sha256('')) as proof_sha256,
       f.node as folded_root, f.node = t.node as verified
from l join subroots s on s.lang is not distinct from l.lang
cross join (select node from tops where n = 1) t
left join proofs p on p.lang is not distinct from l.lang and p.pos = l.pos
join folded f on f.lang is not distinct from l.lang and f.pos = l.pos and f.step = coalesce(p.height, 0)
"""

ORACLES = {"op7_exact_dedup": OP7, "op8_mix_sources": OP8, "op10_chat_format": OP10, "op11_merkle_manifest": OP11}
