"""SQL for the queries on conversations."""

from __future__ import annotations


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    bits = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: [ascii(substr({text}, i, 1))::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {bits}), lambda a, b: case when b >= 0 then xor(a, b) else xor(a >> 1, 3988292384 * (a & 1)) end), 4294967295::bigint)"


TRIE = f"""
with turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) as rank, {{'role': role, 'text': text}} as said
  from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null) c),
heads as (select conv_id, conv_id - conv_id % 20 as base, {crc32_sql("cast(conv_id as varchar)")} % 4 as h from (select distinct conv_id from turns) d),
placed as (
  select h.conv_id, 0 as part, t.rank, t.said from heads h join turns t on t.conv_id = h.base and t.rank <= h.h
  union all select h.conv_id, 1, t.rank, t.said from heads h join turns t on t.conv_id = h.conv_id and t.rank > h.h),
rebuilt as (select h.conv_id, coalesce(p.said, []) as said from heads h left join (select conv_id, list(said order by part, rank) as said from placed group by conv_id) p on p.conv_id = h.conv_id),
prefixes as (select conv_id, d as depth, said[1:d] as prefix, len(said) = d as ends from (select conv_id, said, unnest(range(0, len(said) + 1)) as d from rebuilt) r),
nodes as (
  select prefix, depth, min(conv_id) as conv_id, count(*) as n_convs, coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where ends), '') as ended,
    case when depth = 0 then 0 else (count(*) - 1) * len(regexp_extract_all(prefix[depth].text, '[^\\x20\\x09-\\x0D]+')) end as saved from prefixes group by prefix, depth),
children as (select prefix[1:depth - 1] as prefix, count(*) as n from nodes where depth > 0 group by 1),
known as (select n.*, coalesce(c.n, 0) as n_children from nodes n left join children c on c.prefix = n.prefix),
below as (select prefix[1:a] as prefix, sum(saved) as saved_tokens, count(*) filter (where n_children = 0) as n_leaves from (select *, unnest(range(0, depth + 1)) as a from known) k group by 1)
select k.conv_id, k.depth, p.conv_id as parent_conv_id, k.n_convs, k.n_children, b.n_leaves, cast(b.saved_tokens as bigint) as saved_tokens, sha256(k.ended) as ends_sha256
from known k join below b on b.prefix = k.prefix left join nodes p on k.depth > 0 and p.prefix = k.prefix[1:k.depth - 1]
"""


# States of the repair: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. Costs and texts are those of what follows.
_NEXT = {0: {"s": 1, "u": 2, "": 0}, 1: {"u": 2, "": 1}, 2: {"a": 3, "": 2}, 3: {"u": 2, "": 3}}
_FILL = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}


def _edit(after: str, cost: str, letter: str, line: str | None = None) -> str:
    lines = f"{after}.lines" if line is None else f"list_prepend({line}, {after}.lines)"
    return f"{{'cost': {after}.cost + {cost}, 'audit': concat('{letter}', {after}.audit), 'lines': {lines}}}"


def _taken(state: int) -> str:
    """The cheapest way on from a state that begins with an edit of this turn."""
    name, filled = _FILL[state]
    stays = "case when o.fault = 'truncated' then 3 else 0 end"
    deleted = _edit(f"w.s{state}", "4", "D")
    changed = f"case when o.fault not in ('blank', 'duplicate') then {_edit(f'w.s{filled}', f'3 + {stays}', 'R', f"concat('{name}:', o.text)")} end"
    kept = " ".join(f"when '{initial}' then {_edit(f'w.s{after}', stays, 'K', "concat(o.role, ':', o.text)")}" for initial, after in _NEXT[state].items())
    return f"list_min([{deleted}, {changed}, case when o.fault not in ('blank', 'duplicate') then case substr(o.role, 1, 1) {kept} end end])"


def _filled(state: int) -> str:
    name, after = _FILL[state]
    other, last = _FILL[after]
    twice = f"{{'cost': b{last}.cost + 6, 'audit': concat('II', b{last}.audit), 'lines': list_prepend('{name}:', list_prepend('{other}:', b{last}.lines))}}"
    return f"list_min([b{state}, {_edit(f'b{after}', '3', 'I', f"'{name}:'")}, {twice}])"


REPAIR = f"""
with recursive marked as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, concat(coalesce(cast(conv_id as varchar), ' '), ':', coalesce(cast(turn as varchar), ' ')) as mark from conversations),
numbered as (select *, {crc32_sql("mark")} % 20 as damage from marked),
damaged as (
  select conv_id, turn, case when damage = 4 then 'user' else role end as role, case damage when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case when damage = 3 then 2 else 1 end)) as copy from numbered where damage <> 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), copy) as i from damaged),
ordered as (
  select *, substr(lag(role) over (partition by conv_id order by i), 1, 1) as initial_before,
    case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
      when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') then 'truncated' else '' end as fault from placed),
facts as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
    count(*) filter (where fault = 'truncated') as truncated, count(*) filter (where i > 1 and concat(initial_before, substr(role, 1, 1)) not in ('su', 'ua', 'au')) as illegal from ordered group by conv_id),
walk as (
  select conv_id, n + 1 as i, {{'cost': 0::bigint, 'audit': '', 'lines': []::varchar[]}} as s0, {{'cost': 6::bigint, 'audit': 'II', 'lines': ['user:', 'assistant:']}} as s1,
    {{'cost': 3::bigint, 'audit': 'I', 'lines': ['assistant:']}} as s2, {{'cost': 0::bigint, 'audit': '', 'lines': []::varchar[]}} as s3 from facts
  union all
  select conv_id, i, {", ".join(f"{_filled(s)} as s{s}" for s in range(4))} from (
    select o.conv_id, o.i, {", ".join(f"{_taken(s)} as b{s}" for s in range(4))} from walk w join ordered o on o.conv_id is not distinct from w.conv_id and o.i = w.i - 1) b)
select c.conv_id, coalesce(f.gaps, 0) as gaps, coalesce(f.blank, 0) as blank, coalesce(f.duplicate, 0) as duplicate, coalesce(f.truncated, 0) as truncated, coalesce(f.illegal, 0) as illegal,
  coalesce(w.s0.cost, 0) as cost, coalesce(w.s0.audit, '') as audit, sha256(coalesce(array_to_string(w.s0.lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join facts f on f.conv_id is not distinct from c.conv_id left join walk w on w.conv_id is not distinct from c.conv_id and w.i = 1
"""
