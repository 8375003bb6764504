"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

# Fixed values, written out here so that the SQL does not take them from the code that it checks.
SPAN = 13
PRIME, MULTIPLIER, BUCKETS = 2147483647, 48271, 4096
ROUND_KEYS = ((16807, 11), (69621, 23), (39373, 37), (40692, 53), (40014, 71), (45991, 97))

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _network(source: str, x: str, to: str) -> str:
    """CTEs that take column x of `source` (with a, b) through the rounds into column `to`."""
    p = PRIME
    steps = [f"{to}_0 as (select *, {x} // b as {to}_u, {x} % b as {to}_v, a as {to}_ru, b as {to}_rv from {source})"]
    names = [f"{to}_{c}" for c in ("u", "v", "ru", "rv")]
    u, v, ru, rv = names
    for i, (m, c) in enumerate(ROUND_KEYS):
        t = f"(({v} % {p} * {m} + {c}) % {p})"
        steps.append(
            f"{to}_{i + 1} as (select * exclude ({', '.join(names)}), {v} as {u}, ({u} + ({t} * {t} + {c}) % {p}) % {ru} as {v}, "
            f"{rv} as {ru}, {ru} as {rv} from {to}_{i})"
        )
    last = len(ROUND_KEYS)
    steps.append(f"{to}_done as (select * exclude ({', '.join(names)}), {u} * {rv} + {v} as {to} from {to}_{last})")
    return ",\n".join(steps)


def sharding_sql(walks: int = 4) -> str:
    """Walks of a few steps are written out; at the sizes of the SQL check a longer one would show as a difference."""
    chain, source = [], "numbered"
    for i in range(walks):
        x = "row_number" if i == 0 else f"at{i - 1}"
        name = f"raw{i}"
        chain.append(_network(source, x, name))
        keep = name if i == 0 else f"case when at{i - 1} < total then at{i - 1} else {name} end"
        chain.append(f"walk{i} as (select *, {keep} as at{i} from {name}_done)")
        source = f"walk{i}"
    at = f"at{walks - 1}"
    crc = "list_transform(range(256), lambda x: list_reduce(list_concat([x], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end))"
    return f"""
with crc_table as (select {crc} as t),
bytes as (select rowid_, doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: cast(concat('0x', p) as bigint)) as bs
          from (select *, row_number() over () as rowid_ from documents)),
sums as (select rowid_, doc_id, len(bs) + 1 as size,
         xor(list_reduce(list_concat([4294967295::bigint], bs), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) as text_crc32 from bytes, crc_table),
n as (select count(*) as total from documents),
sides as (select total, cast(ceil(sqrt(total)) as bigint) as b, (total + cast(ceil(sqrt(total)) as bigint) - 1) // cast(ceil(sqrt(total)) as bigint) as a from n),
numbered as (select doc_id, size, text_crc32, total, a, b, row_number() over (order by
    (((coalesce(doc_id, 0) % {PRIME} + {PRIME}) % {PRIME} * {MULTIPLIER}) % {PRIME} + text_crc32) % {BUCKETS},
    doc_id nulls first, text_crc32, size) - 1 as row_number from sums, sides),
{(',' + chr(10)).join(chain)}
select doc_id, cast(size as bigint) as size, cast(text_crc32 as bigint) as text_crc32, 'rows' as law, cast({at} % 16 as integer) as shard,
       cast({at} // 16 as bigint) as slot, cast(null as integer) as grown_shard from {source}
"""


_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
with d as (select doc_id, row_number() over () as rid, {_WORDS.format(LOWER.format("coalesce(text, '')"))} as w from documents),
i as (select cast(item_id as varchar) as item, {_WORDS.format(LOWER.format("coalesce(text, '')"))} as w from benchmark),
lens as (select distinct least({SPAN}, len(w)) as m from i where len(w) > 0),
iw as (select distinct item, least({SPAN}, len(w)) as m, array_to_string(w[k + 1:k + least({SPAN}, len(w))], ' ') as g
       from (select item, w, unnest(range(0, len(w) - least({SPAN}, len(w)) + 1)) as k from i where len(w) > 0)),
dw as (select rid, m, k, array_to_string(w[k + 1:k + m], ' ') as g from (select rid, w, m, unnest(range(0, greatest(len(w) - m + 1, 0))) as k from d, lens)),
hits as (select rid, dw.m, k, item from dw join iw on dw.m = iw.m and dw.g = iw.g),
covered as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(k, k + m)) as p from hits) group by rid),
found as (select rid, list_sort(list(distinct item)) as items from hits group by rid),
r as (select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(items, []) as items from d left join covered using (rid) left join found using (rid))
select doc_id, n_words, n_hit, len(items) as n_items, sha256(coalesce(array_to_string(items, ','), '')) as items_sha256,
       n_hit > 0 and 20 * n_hit >= n_words as contaminated from r
"""


def _kind(n: int, pattern: str, group: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"select rid, {n} as kind, regexp_extract_all(text, '{quoted}') as found, regexp_extract_all(text, '{quoted}', {group}) as val, string_split_regex(text, '{quoted}') as gaps from d"


# Kind, pattern, group that holds the value, its least length.
_PATTERNS = [
    ("assign", r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("blob", r"[A-Za-z0-9+/_-]{24,}", 0, 24),
]
_LEAST = "[" + ", ".join(str(n) for *_, n in _PATTERNS) + "]"
_NAMES = "[" + ", ".join(f"'{k}'" for k, *_ in _PATTERNS) + "]"

SECRETS = f"""
with d as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as text from documents),
k as ({' union all '.join(_kind(n, p, g) for n, (_, p, g, _) in enumerate(_PATTERNS))}),
e as (select rid, kind, unnest(range(0, len(found))) as i, found, val, gaps from k),
m as (select rid, kind, val[i + 1] as value, list_sum(list_transform(gaps[1:i + 1], lambda s: length(s))) + coalesce(list_sum(list_transform(found[1:i], lambda s: length(s))), 0) as start_,
      length(found[i + 1]) as n from e),
f as (select * from m where length(value) >= {_LEAST}[kind + 1]
      and (kind <> 3 or (regexp_matches(value, '[0-9]') and regexp_matches(value, '[a-z]') and regexp_matches(value, '[A-Z]')))),
o as (select value, count(distinct source) as owners from f join d using (rid) group by value),
c as (select f.rid, f.kind, cast(start_ as bigint) as s, cast(start_ + n as bigint) as t, case when owners >= 3 then 'example' when regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Za-z]')
      and len(list_distinct(regexp_extract_all(value, '.'))) >= 6 and len(list_distinct(regexp_extract_all(value, '.'))) * 4 >= length(value) then 'live' else 'weak' end as cls
      from f join o using (value)),
s as (select *, concat({_NAMES}[kind + 1], ':', s, ':', t) as span from c where kind <> 3 or cls = 'live'),
r as (select rid, count_if(kind = 0) as n_assign, count_if(kind = 1) as n_access, count_if(kind = 2) as n_hex,
      coalesce(string_agg(case when kind <> 3 then span end, ',' order by s, kind), '') as base, string_agg(span, ',' order by s, kind) as spans,
      count_if(cls = 'live') as n_live, count_if(cls = 'example') as n_example from s group by rid)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256,
       coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_example, 0) as n_example from d left join r using (rid)
"""

EMBEDDINGS = """
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.93),
reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
low as (select a as vec_id, min(b) as b from reach group by a),
n as (select a as vec_id, count(*) as n from links group by a)
select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(b, vec_id)) as component_id, vec_id = least(vec_id, coalesce(b, vec_id)) as kept
from embeddings left join low using (vec_id) left join n using (vec_id)
"""

#: crc32 of the decimal ids by a table of 256 values; ties of turns by the key that the operator states.
CONVERSATIONS = """
with crc_table as (select list_transform(range(256), lambda x: list_reduce(list_concat([x], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
t as (select conv_id as c, turn, coalesce(role, '') as role, coalesce(text, '') as text, left(base64(unhex(left(sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))), 32))), 22) as k
      from conversations where conv_id is not null),
o as (select *, row_number() over (partition by c order by turn nulls first, k) - 1 as pos from t),
n as (select c, count(*) as n, c - c % 5 as base from o group by c),
hs as (select c, n, base, xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(cast(c as varchar), ''), lambda x: ascii(x)::bigint)),
       lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 9 as h from n, crc_table),
front as (select hs.c, o.pos as nth, role, text, k from hs join o on o.c = hs.base and o.pos < hs.h),
rest as (select o.c, o.pos as nth, role, text, k from hs join o on o.c = hs.c and o.pos >= hs.h),
b as (select *, row_number() over (partition by c order by nth) as depth from (select * from front union all select * from rest)),
p as (select c, depth, strlen(text) as bytes, string_agg(k, ',') over (partition by c order by depth) as path from b
      union all select c, 0, 0, '' from hs),
x as (select c, depth, bytes, path, coalesce(lag(path) over (partition by c order by depth), '') as up, depth = max(depth) over (partition by c) as ends from p),
nodes as (select path, any_value(up) as up, depth, min(c) as conv_id, count(*) as n_convs, (count(*) - 1) * max(bytes) as own,
          sha256(coalesce(string_agg(case when ends then c end, ',' order by c), '')) as ends_sha256 from x group by path, depth),
kids as (select up, count(*) as n_children from nodes where depth > 0 group by up),
full_ as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join kids on kids.up = nodes.path),
sums as (select x.path, sum(own) as saved, count_if(n_children = 0) as n_leaves from full_ f join x on x.c = f.conv_id and x.depth <= f.depth group by x.path)
select f.conv_id, f.depth, case when f.depth > 0 then g.conv_id end as parent_conv_id, f.n_convs, f.n_children, cast(n_leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, f.ends_sha256
from full_ f join sums using (path) left join nodes g on g.path = f.up and f.depth > 0
"""

URLS = """
with rules as (select * from (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) as r(h, p, v)),
a as (select row_number() over () as rid, page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
b as (select *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from a),
f as (select rid, h || p as rule, v, row_number() over (partition by rid order by length(h || p) desc, length(h) desc) as place from b join rules
      on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from b left join (select * from f where place = 1) using (rid)
"""

ORACLES: dict[str, str] = {
    "op1_sharding": sharding_sql(),
    "op2_embedding_dedup": EMBEDDINGS,
    "op3_decontamination": DECONTAMINATION,
    "op10_secret_scan": SECRETS,
    "op11_conversation_trie": CONVERSATIONS,
    "op13_url_filter": URLS,
}
