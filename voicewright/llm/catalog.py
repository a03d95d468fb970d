"""Registered queries of the text operators, and the SQL of the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontaminate, jaccard_join, licenses, lz, pii, quality, repair, suffix_dedup, token_counts, toxicity, trie


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe_round_trip": bpe.op1_bpe_round_trip,
        "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
        "op11_conversation_repair": repair.op11_conversation_repair,
        "op12_prefix_trie": trie.op12_prefix_trie,
        "op13_quality_rules": quality.op13_quality_rules,
        "op2_token_counts": token_counts.op2_token_counts,
        "op3_jaccard_join": jaccard_join.op3_jaccard_join,
        "op4_pii": pii.op4_pii,
        "op5_lz_fingerprint": lz.op5_lz_fingerprint,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_license_scan": licenses.op8_license_scan,
        "op9_chat_format": chat.op9_chat_format,
    }


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: All pairs that share a shingle, and components by recursion: for small tables.
_JACCARD = rf"""with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from w),
d as (select distinct doc_id, g from s),
n as (select doc_id, count(*) as n from d group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from d a join d b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 75 * (nx.n + ny.n - c)),
both_ways as (select x, y from e union all select y, x from e),
r(a, b) as (select doc_id, doc_id from documents union select r.a, t.y from r join both_ways t on r.b = t.x)
select documents.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(r.b) as component_id
from documents join r on r.a = documents.doc_id left join n on n.doc_id = documents.doc_id group by 1"""

_CHAT = r"""with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, length(regexp_replace(role, '(</?|\[/?)(\\*)(s>|INST\])', '\1\\\2\3', 'g')) + length(regexp_replace(text, '(</?|\[/?)(\\*)(s>|INST\])', '\1\\\2\3', 'g')) + 17 as chars from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role) filter (role = 'assistant'), '')) as loss_sha256, sum(chars)::bigint as formatted_chars
from e group by conv_id"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string that isn't empty, bit by bit."""
    steps = "list_reduce(range(8), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)), xor(a, b))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda c: ascii(c)::bigint), lambda a, b: {steps}, 4294967295::bigint), 4294967295)"


def _repair_sql() -> str:
    """Least cost and audit by a fold over each conversation's rows: one string of both for each of four states (nothing, s, open turn, whole turns)."""
    more = lambda x, cost, letter: f"lpad((({x})[1:8]::bigint + {cost})::varchar, 8, '0') || ({x})[9:] || '{letter}'"
    least = lambda xs: "least(" + ", ".join(xs) + ")"
    row = "'i': a.i, 'd': a.d, 't': a.t"
    opened = least(["a.u", *(more(f"a.{k}", 2, "I") for k in "nsb")])
    whole = f"list_transform([{{'n': a.n, 's': a.s, 'u': {opened}, 'b': a.b, {row}}}], lambda a: {{'n': a.n, 's': a.s, 'u': a.u, 'b': {least(['a.b', more('a.u', 2, 'I')])}, {row}}})[1]"
    keep = lambda k, i: f"case when not y.d and y.i = '{i}' then {more(f'a.{k}', 'y.t', 'K')} end"
    name = lambda k: f"case when not y.d then {more(f'a.{k}', '2 + y.t', 'R')} end"
    gone = lambda k: more(f"a.{k}", 3, "D")
    step = (
        f"{{'n': {gone('n')}, 's': {least([gone('s'), keep('n', 's')])}, 'u': {least([gone('u'), *(keep(k, 'u') for k in 'nsb'), *(name(k) for k in 'nsb')])}, "
        f"'b': {least([gone('b'), keep('u', 'a'), name('u')])}, 'i': y.i, 'd': y.d, 't': y.t}}"
    )
    fold = f"list_transform([list_reduce(list_prepend({{'n': '00000000', 's': null::varchar, 'u': null::varchar, 'b': null::varchar, 'i': '', 'd': false, 't': 0}}, rs), lambda a, y: list_transform([{whole}], lambda a: {step})[1])], lambda a: {whole})[1]"
    return rf"""with t as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_crc32("(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))")} % 20 as k from conversations),
dm as (select conv_id, turn, case when k = 4 then 'user' else role end as role, case when k = 1 then '' when k = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when k = 3 then 2 else 1 end)) as copy from t where k <> 0),
o as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn nulls first, role, md5(text)) as rn from dm),
s as (select *, row_number() over (partition by conv_id, role, text order by rn) > 1 as seen, regexp_replace(text, '[\x20\x09-\x0D]+$', '') as trimmed, left(role, 1) as i, lag(left(role, 1)) over (partition by conv_id order by rn) as before from o),
f as (select *, case when trimmed = '' then 'b' when seen then 'd' when right(trimmed, 1) not in ('.', '!', '?') then 't' else '' end as fault from s),
g as (select conv_id, (coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0))::bigint as gaps, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
  count(*) filter (before is not null and before || i not in ('su', 'ua', 'au')) as illegal,
  list({{'n': null::varchar, 's': null::varchar, 'u': null::varchar, 'b': null::varchar, 'i': i, 'd': fault in ('b', 'd'), 't': (fault = 't')::int}} order by rn) as rs from f group by conv_id),
e as (select conv_id, {fold} as z from g),
w as (select conv_id, least(z.n, z.b) as w from e),
l as (select conv_id, unnest(string_split(w[9:], '')) as letter, generate_subscripts(string_split(w[9:], ''), 1) as p from w where length(w) > 8),
c as (select *, count(*) filter (letter <> 'I') over x as rn, count(*) filter (letter <> 'D') over x as q, count(*) filter (letter <> 'D') over (partition by conv_id) as n from l window x as (partition by conv_id order by p)),
r as (select c.conv_id, p, case when letter = 'K' then o.role when (q - n % 2) % 2 = 1 then 'user' else 'assistant' end || ':' || case when letter = 'I' then '' else o.text end as line
  from c left join o on o.conv_id is not distinct from c.conv_id and o.rn = c.rn where letter <> 'D'),
h as (select conv_id, sha256(string_agg(line, chr(10) order by p)) as repaired_sha256 from r group by conv_id)
select b.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(w[1:8]::bigint, 0) as cost, coalesce(w[9:], '') as audit, coalesce(repaired_sha256, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) b left join g on g.conv_id is not distinct from b.conv_id left join w on w.conv_id is not distinct from b.conv_id left join h on h.conv_id is not distinct from b.conv_id"""


#: All prefixes of all conversations, and each node's subtree by comparing keys: for small tables.
_TRIE = f"""with o as (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text, turn from conversations where conv_id is not null),
u as (select c, list({{'k': md5(strlen(role) || ':' || role || text), 'n': strlen(text)}} order by turn nulls first, role, text) as p, {_crc32("any_value(c::varchar)")} % 9 as h from o group by c),
j as (select a.c, list_concat(coalesce(b.p, [])[1:a.h], a.p[a.h + 1:]) as p from u a left join u b on b.c = a.c - a.c % 5),
d as (select c, p, unnest(range(len(p) + 1)) as d from j),
k as (select c, d, len(p) as n, list_reduce(list_prepend('', list_transform(p[1:d], lambda x: x.k)), lambda x, y: x || y) as key, list_reduce(list_prepend('', list_transform(p[1:d - 1], lambda x: x.k)), lambda x, y: x || y) as up, case when d > 0 then p[d].n else 0 end as bytes from d),
t as (select key, any_value(up) as up, any_value(d)::bigint as depth, min(c) as conv_id, count(*) as n_convs, any_value(bytes) as bytes, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (n = d), '')) as ends_sha256 from k group by key),
s as (select a.key, sum((b.n_convs - 1) * b.bytes)::bigint as saved_tokens, count(*) filter (b.key not in (select up from t where depth > 0)) as n_leaves from t a join t b on starts_with(b.key, a.key) group by a.key)
select t.conv_id, t.depth, case when t.depth > 0 then q.conv_id end as parent_conv_id, t.n_convs, (select count(*) from t x where x.up = t.key and x.depth > 0) as n_children, n_leaves, saved_tokens, t.ends_sha256
from t join s on s.key = t.key left join t q on q.key = t.up"""


def oracle_sql() -> dict[str, str]:
    return {"op3_jaccard_join": _JACCARD, "op9_chat_format": _CHAT, "op11_conversation_repair": _repair_sql(), "op12_prefix_trie": _TRIE}
