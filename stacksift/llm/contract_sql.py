"""SQL with the rows of the queries that SQL can express."""

OP11_SQL = r"""
with docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
lines as (
  select rid, doc_id, pos, parts[pos] as line,
    translate(trim(parts[pos], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as line_key
  from (select *, unnest(range(1, len(parts) + 1)) as pos from (select *, string_split(text, chr(10)) as parts from docs))),
shared as (
  select line_key, max(doc_id) as holder from (select distinct line_key, doc_id from lines where length(line_key) >= 20) group by line_key having count(*) >= 3),
marked as (
  select lines.*, shared.line_key is not null and lines.doc_id is distinct from shared.holder as goes from lines left join shared on lines.line_key = shared.line_key)
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (where goes) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not goes), '')) as kept_sha256
from marked group by rid
"""

OP12_SQL = r"""
with recursive drawn as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce(
      list_concat([4294967295::bigint], list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda ch: ascii(ch)::bigint)),
      lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end)),
    4294967295::bigint) % 20 as d
  from conversations),
damaged as (
  select conv_id, turn, case when d = 4 then 'user' else role end as role,
    case when d = 1 then '' when d = 2 then translate(text, '.!?', '') else text end as text
  from (select *, unnest(range(case when d = 3 then 2 else 1 end)) as copy from drawn where d <> 0)),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as r from damaged),
marked as (
  select *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare,
    row_number() over (partition by conv_id, role, text order by r) as nth,
    coalesce(left(lag(role) over (partition by conv_id order by r), 1) || left(role, 1) not in ('su', 'ua', 'au'), false) as illegal
  from placed),
turns as (
  select *, case when bare = '' then 'blank' when nth > 1 then 'duplicate' when right(bare, 1) not in ('.', '!', '?') then 'truncated' else 'fine' end as fault from marked),
closed(f, t, c, a, b) as (values
  (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
  (0, 2, 3, 'I', 'user:' || chr(10)), (1, 2, 3, 'I', 'user:' || chr(10)), (3, 2, 3, 'I', 'user:' || chr(10)), (2, 3, 3, 'I', 'assistant:' || chr(10)),
  (0, 3, 6, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 3, 6, 'II', 'user:' || chr(10) || 'assistant:' || chr(10))),
edits(f, t, op, c, initial, role) as (values
  (0, 0, 'D', 4, '', ''), (1, 1, 'D', 4, '', ''), (2, 2, 'D', 4, '', ''), (3, 3, 'D', 4, '', ''),
  (0, 1, 'K', 0, 's', ''), (0, 2, 'K', 0, 'u', ''), (1, 2, 'K', 0, 'u', ''), (3, 2, 'K', 0, 'u', ''), (2, 3, 'K', 0, 'a', ''),
  (0, 2, 'R', 3, '', 'user'), (1, 2, 'R', 3, '', 'user'), (3, 2, 'R', 3, '', 'user'), (2, 3, 'R', 3, '', 'assistant')),
walk as (
  select distinct conv_id, 0::bigint as r, 0 as state, {'cost': 0, 'audit': '', 'body': ''} as best from turns
  union all
  select w.conv_id, x.r, e.t as state, min({
    'cost': w.best.cost + c.c + e.c + case when x.fault = 'truncated' and e.op <> 'D' then 3 else 0 end,
    'audit': w.best.audit || c.a || e.op,
    'body': w.best.body || c.b || case e.op when 'D' then '' when 'K' then x.role || ':' || x.text || chr(10) else e.role || ':' || x.text || chr(10) end}) as best
  from walk w
    join turns x on x.conv_id is not distinct from w.conv_id and x.r = w.r + 1
    join closed c on c.f = w.state
    join edits e on e.f = c.t and (e.op = 'D' or (x.fault in ('fine', 'truncated') and (e.op = 'R' or e.initial = left(x.role, 1))))
  group by w.conv_id, x.r, e.t),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank,
    count(*) filter (where fault = 'duplicate') as duplicate, count(*) filter (where fault = 'truncated') as truncated, count(*) filter (where illegal) as illegal, max(r) as rows
  from turns group by conv_id),
ends as (
  select w.conv_id, min({'cost': w.best.cost + c.c, 'audit': w.best.audit || c.a, 'body': w.best.body || c.b}) as best
  from walk w join counts n on n.conv_id is not distinct from w.conv_id and n.rows = w.r join closed c on c.f = w.state and c.t in (0, 3)
  group by w.conv_id)
select k.conv_id, coalesce(n.gaps, 0) as gaps, coalesce(n.blank, 0) as blank, coalesce(n.duplicate, 0) as duplicate, coalesce(n.truncated, 0) as truncated,
  coalesce(n.illegal, 0) as illegal, coalesce(e.best.cost, 0) as cost, coalesce(e.best.audit, '') as audit,
  sha256(coalesce(left(e.best.body, greatest(length(e.best.body) - 1, 0)), '')) as repaired_sha256
from (select distinct conv_id from conversations) k
  left join counts n on n.conv_id is not distinct from k.conv_id left join ends e on e.conv_id is not distinct from k.conv_id
"""

OP13_SQL = r"""
with v as (
  select row_number() over () as rid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select a.rid, a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.q, b.q)::bigint as score
  from v a join v b on a.rid <> b.rid where a.vec_id % 100 = 0),
positives as (
  select *, row_number() over (partition by rid order by score desc, vec_id nulls last) as k from pairs where same qualify k <= 5),
ranked as (
  select p.anchor_id, p.vec_id as positive_id, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score,
    row_number() over (partition by p.rid, p.k order by n.score desc, n.vec_id nulls last) as rank
  from positives p join pairs n on n.rid = p.rid and not n.same
  where 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score)
select anchor_id, positive_id, rank::integer as rank, negative_id, positive_score, negative_score from ranked where rank <= 10
"""
