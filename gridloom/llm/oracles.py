"""DuckDB SQL that gives the rows of the queries."""

EXACT = r"""
with n as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents
), g as (
  select norm, min(doc_id) as keep_id, count(*) as group_size from n group by norm
)
select n.doc_id, g.keep_id, g.group_size, n.doc_id is not distinct from g.keep_id as kept, sha256(n.norm) as text_sha256
from n join g on n.norm = g.norm
"""


def _matches(place: int, kind: str, pattern: str, group: str, least: int) -> str:
    """Spans of one rule: the text splits into the parts between its matches, whose lengths give the places."""
    return f"""
  select doc_id, r, {place} as place, '{kind}' as kind, list_sum(list_transform(parts[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(whole[1:i-1], lambda p: length(p))), 0) as s, length(whole[i]) as len
  from (select doc_id, r, unnest(generate_series(1, length(whole))) as i, parts, whole, body from (
    select doc_id, r, regexp_split_to_array(t, '{pattern}') as parts, regexp_extract_all(t, '{pattern}') as whole, regexp_extract_all(t, '{pattern}', {group}) as body
    from docs where regexp_matches(t, '{pattern}')))
  where length(body[i]) >= {least}"""


def _folded(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" for c in word)


_NAMES = "|".join([*map(_folded, ("password", "passwd", "secret", "token")), f"{_folded('api')}_?{_folded('key')}"])
_KINDS = [
    ("assign", rf"(?:{_NAMES})[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 1, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
    ("github", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 25),
    ("jwt", "eyJ[A-Za-z0-9_.-]+", 0, 43),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----+", 0, 1),
]

SECRETS = f"""
with docs as (select doc_id, row_number() over () as r, coalesce(text, '') as t from documents),
found as ({" union all ".join(_matches(i, *k) for i, k in enumerate(_KINDS))}),
spans as (select *, kind || ':' || s || ':' || (s + len) as span from found),
told as (
  select r, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    string_agg(span, ',' order by s, place) filter (place < 3) as base, string_agg(span, ',' order by s, place) as spans
  from spans group by r)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join told using (r)
"""

WARC = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), d as (
  select payload_digest, min(page_id) as first_id from p where payload_bytes >= 100 group by payload_digest
)
select page_id, payload_bytes, payload_digest, case when page_id > first_id then 'revisit' else 'response' end as record_type, case when page_id > first_id then first_id end as refers_to
from p left join d using (payload_digest)
"""

NEAR = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents
), shingles as (
  select distinct doc_id, case when length(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i+4], ' ') end as s
  from (select doc_id, w, unnest(generate_series(1, greatest(1, length(w) - 4))) as i from words where length(w) > 0)
), sizes as (select doc_id, count(*) as n from shingles group by doc_id
), links as (
  select x.doc_id as a, y.doc_id as b from shingles x join shingles y on x.s = y.s and x.doc_id <> y.doc_id join sizes m on m.doc_id = x.doc_id join sizes n on n.doc_id = y.doc_id
  group by x.doc_id, y.doc_id having 100 * count(*) >= 85 * (any_value(m.n) + any_value(n.n) - count(*))
), reach as (
  select a as node, b as other from links union select r.node, l.b from reach r join links l on l.a = r.other
), least as (select node, min(other) as least from reach group by node)
select d.doc_id, coalesce(n, 0) as n_shingles, least(d.doc_id, coalesce(least, d.doc_id)) as component_id, d.doc_id <= coalesce(least, d.doc_id) as kept
from documents d left join sizes using (doc_id) left join least on node = d.doc_id
"""

_CRC = """
crc_table as (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as entries)"""


def _crc(value: str) -> str:
    """crc32 of a number's decimal digits, as crc_table gives it."""
    return f"xor(list_reduce(list_concat([4294967295], list_transform(string_split(cast({value} as varchar), ''), lambda d: ascii(d))), lambda c, b: xor(c // 256, entries[(xor(c, b) % 256) + 1])), 4294967295)"


def _fields(*names: str) -> str:
    return " || ".join(f"coalesce(octet_length(encode(cast({c} as varchar))) || ':' || cast({c} as varchar), '-')" for c in names)


EMBEDDINGS = """
with recursive rows as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
good as (select * from rows where len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and list_sum(list_transform(v, lambda x: abs(x))) > 0),
links as (select x.r as a, y.r as b from good x join good y on x.r <> y.r and len(x.v) = len(y.v) and list_cosine_similarity(x.v, y.v) >= 0.95),
reach as (select a as node, b as other from links union select r.node, l.b from reach r join links l on l.a = r.other),
least as (select node, min(vec_id) as least from reach join rows on r = other group by node),
degrees as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0) as n_links, least(vec_id, least) as component_id, coalesce(vec_id = least(vec_id, least), false) as kept
from rows left join degrees on a = r left join least on node = r
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MERKLE = f"""
with recursive {_CRC.strip()},
hashed as (select row_number() over () as r, doc_id, lang, {_crc("doc_id")} % 3 = 0 as hit, sha256({_fields("doc_id", "source", "lang", "n_chars", "text")}) as leaf,
  sha256({_fields("doc_id", "source", "lang", "n_chars", f"translate(text, '{_UPPER}', '{_LOWER}')")}) as tampered from documents, crc_table),
leaves as (select *, case when lang is null then '' else '=' || lang end as tree, row_number() over (partition by lang order by doc_id nulls first, leaf, r) - 1 as pos, count(*) over (partition by lang) as n from hashed),
nodes as (select tree, 0 as level, n, pos, leaf as digest from leaves
  union all select tree, level + 1, (n + 7) // 8, pos // 8, sha256(string_agg(digest, '' order by pos)) from nodes where n > 1 group by tree, level, n, pos // 8),
subroots as (select tree, digest, row_number() over (order by encode(tree)) - 1 as pos, count(*) over () as n from nodes where n = 1),
tops as (select 0 as level, n, pos, digest from subroots union all select level + 1, (n + 7) // 8, pos // 8, sha256(string_agg(digest, '' order by pos)) from tops where n > 1 group by level, n, pos // 8),
low as (select r, tree, 0 as level, n, pos, case when hit then tampered else leaf end as now, '' as proof from leaves
  union all select r, low.tree, low.level + 1, (low.n + 7) // 8, low.pos // 8, sha256(string_agg(case when x.pos = low.pos then now else digest end, '' order by x.pos)), proof || coalesce(string_agg(digest, '' order by x.pos) filter (x.pos <> low.pos), '')
  from low join nodes x on x.tree = low.tree and x.level = low.level and x.pos // 8 = low.pos // 8 where low.n > 1 group by r, low.tree, low.level, low.n, low.pos, now, proof),
high as (select r, 0 as level, s.n, s.pos, now, proof from low join subroots s using (tree) where low.n = 1
  union all select r, high.level + 1, (high.n + 7) // 8, high.pos // 8, sha256(string_agg(case when x.pos = high.pos then now else digest end, '' order by x.pos)), proof || coalesce(string_agg(digest, '' order by x.pos) filter (x.pos <> high.pos), '')
  from high join tops x on x.level = high.level and x.pos // 8 = high.pos // 8 where high.n > 1 group by r, high.level, high.n, high.pos, now, proof)
select l.doc_id, l.leaf, s.digest as subroot, t.digest as root, sha256(h.proof) as proof_sha256, h.now as folded_root, h.now = t.digest as verified
from leaves l join subroots s using (tree) join high h on h.r = l.r and h.n = 1 join tops t on t.n = 1
"""

TRIE = f"""
with {_CRC.strip()},
said as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
own as (select conv_id, list(struct_pack(role := role, text := text) order by turn nulls first, sha256(octet_length(encode(role)) || ':' || role || text)[:32]) as said from said group by conv_id),
ruled as (select conv_id, said, {_crc("conv_id")} % 9 as h from own, crc_table),
built as (select c.conv_id, list_concat(coalesce(b.said[1:c.h], []), c.said[c.h + 1:]) as path from ruled c left join own b on b.conv_id = c.conv_id - c.conv_id % 5),
passed as (select conv_id, path, unnest(range(len(path) + 1)) as depth from built),
nodes as (select path[1:depth] as node, any_value(depth) as depth, min(conv_id) as conv_id, count(*) as n_convs, coalesce(string_agg(conv_id, ',' order by conv_id) filter (depth = len(path)), '') as ends from passed group by path[1:depth]),
children as (select node[1:depth - 1] as node, count(*) as n_children from nodes where depth > 0 group by node[1:depth - 1]),
told as (select n.*, coalesce(n_children, 0) as n_children, case when depth = 0 then 0 else (n_convs - 1) * octet_length(encode(n.node[depth].text)) end as saved from nodes n left join children c on c.node = n.node),
under as (select node[1:d] as node, sum(case when n_children = 0 then 1 else 0 end) as n_leaves, sum(saved) as saved_tokens from (select *, unnest(range(depth + 1)) as d from told) group by node[1:d])
select t.conv_id, t.depth, p.conv_id as parent_conv_id, t.n_convs, t.n_children, cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens, sha256(t.ends) as ends_sha256
from told t join under u on u.node = t.node left join nodes p on t.depth > 0 and p.node = t.node[1:t.depth - 1]
"""
