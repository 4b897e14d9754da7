"""The SQL counterparts.  They share no code with the operators but the numbers that define a result."""

WS = r"[\x20\x09-\x0D]"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

EXACT_DEDUP = f"""
with d as (select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '{WS}', '', 'g')) as text_sha256 from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size,
       row_number() over w = 1 as kept, text_sha256
from d window w as (partition by text_sha256 order by n desc, doc_id)
"""

# CRC-32 of the UTF-8 bytes, bit-reflected polynomial 0xEDB88320
_BYTES = """flatten(list_transform(string_split(coalesce(text, ''), ''), lambda c: case when unicode(c) < 128 then [unicode(c)]
  when unicode(c) < 2048 then [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)]
  when unicode(c) < 65536 then [224 + (unicode(c) >> 12), 128 + ((unicode(c) >> 6) & 63), 128 + (unicode(c) & 63)]
  else [240 + (unicode(c) >> 18), 128 + ((unicode(c) >> 12) & 63), 128 + ((unicode(c) >> 6) & 63), 128 + (unicode(c) & 63)] end))"""
_STEP = "list_reduce([xor(c, b)] || range(8), lambda v, i: xor(v >> 1, 3988292384::bigint * (v & 1)))"


def _half_rounds(keys, prime, a, b):
    """Nested selects, one per half round, from ``l, r, ra, rb``."""
    source = "{source}"
    for i, key in enumerate(keys):
        value = "r" if i % 2 == 0 else "l"
        mix = f"((({value} * {a} + {key}) % {prime}) * (({value} * {a} + {key}) % {prime}) % {prime} * {b} + {key}) % {prime}"
        source = (f"select row, (l + {mix}) % ra as l, r, ra, rb, n from ({source})" if i % 2 == 0
                  else f"select row, l, (r + {mix}) % rb as r, ra, rb, n from ({source})")
    return source


def sharding_sql(keys, prime, a, b, shards):
    rounds = _half_rounds(keys, prime, a, b)
    first = rounds.format(source="select row, row // rb as l, row % rb as r, ra, rb, n from domain")
    again = rounds.format(source="select row, y // rb as l, y % rb as r, ra, rb, n from walk where y >= n")
    return f"""
with recursive raw as (select doc_id, strlen(coalesce(text, '')) + 8 as size,
  case when coalesce(text, '') = '' then 0 else
  xor(list_reduce([4294967295::bigint] || {_BYTES}, lambda c, b: {_STEP}), 4294967295::bigint) end as text_crc32 from documents),
numbered as (select *, row_number() over (order by doc_id nulls first, text_crc32, size) - 1 as row from raw),
total as (select count(*)::bigint as n, greatest(1, ceil(sqrt(count(*)))::bigint) as ra from numbered),
domain as (select row, ra, (n + ra - 1) // ra as rb, n from numbered, total),
walk(row, y, ra, rb, n) as (
  select row, l * rb + r, ra, rb, n from ({first})
  union all select row, l * rb + r, ra, rb, n from ({again}))
select doc_id, size, text_crc32, 'rows' as law, (y % {shards})::integer as shard, y // {shards} as slot, null::integer as grown_shard, row
from numbered join walk using (row) where y < n
"""


_KEY = r"translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000')"
QUALITY = rf"""
with d as (select row_number() over () as k, doc_id, coalesce(text, '') as text, coalesce(source, '') as host from documents),
w as (select *, {_WORDS} as ws from d),
grams as (select k, i, list_slice(ws, i, i + 4) as g from w, unnest(range(1, greatest(len(ws) - 3, 1))) as u(i)),
again as (select k, i from (select k, i, count(*) over (partition by k, g) as c from grams) where c > 1),
covered as (select k, count(distinct i + j) as n from again, range(5) as r(j) group by k),
lines as (select k, host, text, line, regexp_replace({_KEY}, '{WS}', '', 'g') as key, length(regexp_replace(line, '{WS}', '', 'g')) as chars,
  len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as words from d, unnest(string_split(text, chr(10))) as u(line)),
full_lines as (select * from lines where chars > 0),
dup as (select k, count(*) - count(distinct line) as n from full_lines group by k),
often as (select host, key from full_lines join (select host, count(distinct text) as total from d group by host) using (host)
  group by host, key, total having count(distinct text) > 20 and count(distinct text) * 100 > total * 5),
gone as (select k, sum(words) as words, sum(chars) as chars from full_lines join often using (host, key) group by k),
c as (select w.k, doc_id, len(ws) as n_words, length(regexp_replace(text, '{WS}', '', 'g')) as word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(dup.n, 0) as n_dup_lines, coalesce(covered.n, 0) as n_repeat_words,
  coalesce(gone.words, 0)::bigint as n_removed_words, coalesce(gone.chars, 0) as gone_chars
  from w left join dup on dup.k = w.k left join covered on covered.k = w.k left join gone on gone.k = w.k)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed, n_removed_words,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words)
  and not (n_removed_words > 0 and (n_words - n_removed_words < 10 or (word_chars - gone_chars) * 100 < word_chars * 30)) as kept
from c
"""

_TURN = "'<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)"
CHAT = f"""
with t as (select conv_id, replace(coalesce(role, ''), '<|', '< |') as role, replace(coalesce(text, ''), '<|', '< |') as text,
  row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as rn from conversations where conv_id is not null),
e as (select conv_id, max(rn) filter (role = 'assistant') as last, max(rn) as n from t group by conv_id),
p as (select conv_id, coalesce(arg_max(text, rn), '') as stale from t join e using (conv_id) where role = 'assistant' and rn < last group by conv_id),
c as (select e.conv_id, last, n, coalesce(stale, '') as stale, a.text as answer,
  case when last is null then n when a.text = coalesce(stale, '') then last else last - 1 end as n_common
  from e left join p on p.conv_id = e.conv_id left join t a on a.conv_id = e.conv_id and a.rn = e.last),
q as (select conv_id, string_agg({_TURN}, '' order by rn) filter (rn <= n_common) as prompt from t join c using (conv_id) group by conv_id)
select conv_id as pair_id, n_common::integer as n_common,
  coalesce(prompt, '') || case when n_common < last then '<|im_start|>assistant' || chr(10) else '' end as prompt,
  case when n_common < last then answer || '<|im_end|>' || chr(10) else '' end as chosen,
  case when n_common < last then stale || '<|im_end|>' || chr(10) else '' end as rejected,
  case when n_common < last then '0-' || (length(answer) + 10) else '' end as chosen_spans,
  case when n_common < last then '0-' || (length(stale) + 10) else '' end as rejected_spans
from c join q using (conv_id)
"""

NEAR_COPIES = r"""
with recursive d as (select row_number() over () as k, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
g as (select distinct k, doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') as gram from d, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as u(i) where len(ws) > 0),
n as (select k, doc_id, count(*) as n from g group by k, doc_id),
both_ as (select a.k as a, b.k as b, count(*) as c from g a join g b on a.gram = b.gram and a.k <> b.k group by a.k, b.k),
link as (select a, b from both_ join n x on x.k = a join n y on y.k = b where 100 * c >= 80 * (x.n + y.n - c)),
reach(k, r) as (select k, k from n union select reach.k, link.b from reach join link on link.a = reach.r),
low as (select reach.k, min(n.doc_id) as component_id from reach join n on n.k = reach.r group by reach.k)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(low.component_id, d.doc_id) as component_id from d left join n on n.k = d.k left join low on low.k = d.k
"""


def prefix_trie_sql(group, heads):
    crc = f"xor(list_reduce([4294967295::bigint] || list_transform(string_split(conv_id::varchar, ''), lambda c: unicode(c)::bigint), lambda c, b: {_STEP}), 4294967295::bigint)"
    return f"""
with turns as (select conv_id, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) as t, turn from conversations where conv_id is not null),
own as (select conv_id, list(t order by turn nulls first, t) as s, {crc} % {heads} as h from turns group by conv_id),
rebuilt as (select o.conv_id, list_slice(coalesce(b.s, []), 1, o.h) || list_slice(o.s, o.h + 1, len(o.s)) as s
  from own o left join own b on b.conv_id = o.conv_id - o.conv_id % {group}),
prefixes as (select conv_id, d, list_slice(s, 1, d) as p, d = len(s) as last from rebuilt, unnest(range(len(s) + 1)) as u(d)),
nodes as (select p, any_value(d) as depth, min(conv_id) as conv_id, count(*) as n_convs,
  sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (last), '')) as ends_sha256 from prefixes group by p),
kids as (select list_slice(p, 1, depth - 1) as p, count(*) as n_children from nodes where depth > 0 group by 1),
counted as (select nodes.*, coalesce(n_children, 0) as n_children,
  case when depth = 0 then 0 else (n_convs - 1) * length(list_extract(p, depth).text) end as saved from nodes left join kids using (p)),
below as (select list_slice(p, 1, k) as p, sum((n_children = 0)::int)::bigint as n_leaves, sum(saved)::bigint as saved_tokens
  from counted, unnest(range(depth + 1)) as u(k) group by 1)
select c.conv_id, c.depth, up.conv_id as parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, c.ends_sha256
from counted c join below using (p) left join nodes up on c.depth > 0 and up.p = list_slice(c.p, 1, c.depth - 1)
"""
