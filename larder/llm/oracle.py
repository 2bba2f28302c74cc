"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

_OP10 = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
win as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') as k
        from (select doc_id, ws, unnest(generate_series(1, len(ws) - 12)) as i from w)),
m as (select k, min(doc_id) as first from win group by k),
gone as (select distinct win.doc_id, i + d as i from win join m using (k), range(13) as r(d) where m.first < win.doc_id),
word as (select doc_id, unnest(ws) as word, unnest(generate_series(1, len(ws))) as i from w),
kept as (select doc_id, string_agg(word, ' ' order by i) as t, count(*) as n
         from word anti join gone using (doc_id, i) group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed,
  sha256(coalesce(t, '')) as kept_sha256
from w left join kept using (doc_id)
"""

_OP8 = r"""
with a as (select page_id, coalesce(url, '') as u from pages),
s as (select page_id, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path from a),
rules(verdict, h, p) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
        ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fit as (select page_id, host, path, h || p as rule, verdict from s join rules
        on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)),
best as (select page_id, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict from fit group by page_id)
select s.page_id, s.host, s.path, rule, coalesce(verdict, 'allow') as verdict from s left join best using (page_id)
"""

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
_OP2 = f"""
with d as (select doc_id, {_WORDS} as ws from documents),
b as (select item_id, ws, least(10, len(ws)) as n from (select item_id, {_WORDS} as ws from benchmark) where len(ws) > 0),
win as (select distinct item_id, n, array_to_string(ws[i:i + n - 1], ' ') as k
        from (select item_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) as i from b)),
dw as (select doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') as k
       from (select doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) as i from d, (select distinct n from win))),
hit as (select doc_id, dw.n, i, item_id from dw join win using (n, k)),
cov as (select doc_id, count(distinct i + o) as n_hit from hit, range(10) as r(o) where o < n group by doc_id),
its as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids
        from hit group by doc_id)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
from d left join cov using (doc_id) left join its using (doc_id)
"""

_OP4 = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
win as (select doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) as k
        from (select doc_id, ws, unnest(generate_series(1, len(ws) - 49)) as i from w)),
m as (select k, min(doc_id) as first from win group by k),
rep as (select doc_id, i, first from win join m using (k) where first < doc_id),
edge as (select *, case when i - lag(i) over (partition by doc_id order by i) <= 50 then 0 else 1 end as e from rep),
run as (select *, sum(e) over (partition by doc_id order by i) as r from edge)
select doc_id, (min(i) - 1)::bigint as start_word, (max(i) + 50 - min(i))::bigint as n_words, min(first) as first_doc_id
from run group by doc_id, r
"""

_OP9 = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
code as (select h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          (((('0x' || substr(h, 5 * g + 1, 5))::int) >> (15 - 5 * k)) & 31) + 1, 1), '' order by g, k) as payload_digest
         from (select distinct h from p), range(8) as t(g), range(4) as u(k) group by h),
last as (select h, max(page_id) as last from p group by h)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
  case when page_id < last then 'revisit' else 'response' end as record_type, case when page_id < last then last end as refers_to
from p join code using (h) join last using (h)
"""




def _crc32(number: str) -> str:
    """CRC-32 of a number as decimal text."""
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    letters = f"list_transform(string_split(({number})::varchar, ''), lambda x: ascii(x)::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {letters}), lambda c, b: {bits}), 4294967295)"


def _leaf(text: str) -> str:
    fields = [f"coalesce(octet_length(encode({v}::varchar))::varchar || ':' || {v}::varchar, '-')" for v in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(fields)})"


def _climb(name: str, tree: str, levels: int) -> str:
    """Tables {name}0.. of nodes (tree, p, d, c) and {name}k0.. of their children; from a level of one node on, that node."""
    out = []
    for k in range(levels):
        out.append(
            f"{name}k{k} as (select {tree}, p // 16 as p, c, list(d order by p) as kids from {name}{k} group by {tree}, p // 16, c)"
        )
        digest = "case when c = 1 then kids[1] else sha256(array_to_string(kids, '')) end"
        out.append(f"{name}{k + 1} as (select {tree}, p, {digest} as d, (c + 15) // 16 as c from {name}k{k})")
    return ",\n".join(out)


def _fold(name: str, begin: str, tree: str, levels: int) -> str:
    """Tables {name}f0.. of rows on their way up: place p, value v and siblings s."""
    out = [f"{name}f0 as ({begin})"]
    for k in range(levels):
        around = "kids[:(f.p % 16)] || kids[(f.p % 16) + 2:]"
        new = "sha256(array_to_string(kids[:(f.p % 16)] || [v] || kids[(f.p % 16) + 2:], ''))"
        out.append(
            f"{name}f{k + 1} as (select f.* replace (f.p // 16 as p, case when n.c = 1 then v else {new} end as v, "
            f"s || array_to_string({around}, '') as s) from {name}f{k} f join {name}k{k} n on f.{tree} is not distinct from n.{tree} and f.p // 16 = n.p)"
        )
    return ",\n".join(out)


#: Levels of sixteen children: 4e9 documents in a source, a million sources.
_SOURCE_LEVELS, _TOP_LEVELS = 8, 5
_OP11 = f"""
with l as (select doc_id, source, {_leaf("text")} as leaf,
    {_leaf(f"case when {_crc32('doc_id')} % 5 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end")} as found
  from documents),
x as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as p, count(*) over (partition by source) as c from l),
a0 as (select source, p, leaf as d, c from x),
{_climb("a", "source", _SOURCE_LEVELS)},
sub as (select source, d, row_number() over (order by source nulls first) - 1 as p, count(*) over () as c from a{_SOURCE_LEVELS}),
b0 as (select 0 as one, p, d, c from sub),
{_climb("b", "one", _TOP_LEVELS)},
{_fold("a", "select doc_id, source, leaf, p, found as v, '' as s from x", "source", _SOURCE_LEVELS)},
{_fold("b", f"select f.* replace (sub.p as p), sub.d as subroot, 0 as one from af{_SOURCE_LEVELS} f join sub on f.source is not distinct from sub.source",
       "one", _TOP_LEVELS)}
select doc_id, leaf, subroot, d as root, sha256(s) as proof_sha256, v as folded_root, v = d as verified
from bf{_TOP_LEVELS}, b{_TOP_LEVELS}
"""

_OP12 = f"""
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first) as n from conversations where conv_id is not null),
c as (select conv_id, conv_id - conv_id % 5 as base, {_crc32('conv_id')} % 9 as h from (select distinct conv_id from t)),
r as (select c.conv_id, n, role, text from c join t on t.conv_id = c.base and n <= h
      union all select c.conv_id, n, role, text from c join t using (conv_id) where n > h),
w as (select c.conv_id, coalesce(list(md5(length(role) || ':' || role || text) order by n) filter (n is not null), []) as ks,
        coalesce(list(octet_length(encode(text))::bigint order by n) filter (n is not null), []) as bs from c left join r using (conv_id) group by 1),
p as (select conv_id, d, ks[:d] as k, bs[d] as b, len(ks) = d as ends from (select *, unnest(generate_series(0, len(ks))) as d from w)),
node as (select k, d, min(conv_id) as conv_id, count(*) as n_convs, any_value(b) as b,
           coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '') as ids from p group by k, d),
kids as (select k[:d - 1] as k, count(*) as n_children from node where d > 0 group by 1),
full_node as (select node.*, coalesce(n_children, 0) as n_children from node left join kids using (k)),
above as (select k[:a] as k, n_children, (n_convs - 1) * coalesce(b, 0) as saved from (select *, unnest(generate_series(0, d)) as a from full_node)),
sums as (select k, count(*) filter (n_children = 0) as n_leaves, sum(saved) as saved_tokens from above group by k)
select f.conv_id, f.d as depth, up.conv_id as parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens::bigint as saved_tokens, sha256(f.ids) as ends_sha256
from full_node f join sums using (k) left join node up on f.d > 0 and up.k = f.k[:f.d - 1] and up.d = f.d - 1
"""


def statements() -> dict[str, str]:
    return {
        "op2_benchmark_decontamination": _OP2,
        "op4_suffix_array_dedup": _OP4,
        "op8_url_filters": _OP8,
        "op9_warc": _OP9,
        "op10_substring_dedup": _OP10,
        "op11_merkle_manifest": _OP11,
        "op12_conversation_trie": _OP12,
    }
