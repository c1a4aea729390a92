"""DuckDB SQL for the corpus queries that SQL can express, written apart from them."""

from __future__ import annotations

from fleetlens.llm.license_rules import RULES, SENTENCES

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def license_sql() -> str:
    key = f"trim(regexp_replace(translate(s, {_AZ}), '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g'))"
    known = ", ".join(
        f"(trim(regexp_replace(lower({_text(text)}), '[^a-z0-9]+', ' ', 'g')), {_text(name)})" for name, text in SENTENCES.items()
    )
    state = "select *, ',' || sentences || ',' as r0 from (select doc_id, n_known, replace(sentences, ',', ',,') as sentences, sentences as plain from found)"
    marks = []
    for at, (name, wanted) in enumerate(RULES):
        pattern = _text("," + ",,".join(wanted) + ",")
        state = f"select *, case when contains(r{at}, {pattern}) then {_text(name)} end as m{at}, replace(r{at}, {pattern}, ',') as r{at + 1} from ({state})"
        marks.append(f"m{at}")
    first = " || ".join(
        f"case when m{at} is not null" + "".join(f" and coalesce(m{k}, '') <> m{at}" for k in range(at)) + f" then ',' || m{at} else '' end"
        for at in range(len(RULES))
    )
    return f"""
    with known(k, name) as (values {known}),
    parts as (
      select doc_id, row_number() over () as row_key,
        regexp_split_to_array(regexp_replace(coalesce(text, ''), '\\n[ \\t]*([a-z])', ' \\1', 'g'), '\\n+|[.!?:]+(?:[ \\t]+|$)') as a
      from documents),
    each as (select row_key, generate_subscripts(a, 1) as i, unnest(a) as s from parts),
    hits as (select row_key, i, name from (select row_key, i, {key} as k from each) x join known using (k)),
    seq as (select row_key, count(*) as n_known, string_agg(name, ',' order by i) as sentences from hits group by row_key),
    found as (
      select doc_id, coalesce(n_known, 0) as n_known, coalesce(sentences, '') as sentences from parts left join seq using (row_key))
    select doc_id, n_known, plain as sentences, substr({first}, 2) as licenses from ({state})
    """


URL_SQL = f"""
with rules(rule, host, path, verdict) as (values
  ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
  ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
rest as (
  select page_id, row_number() over () as row_key,
    case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as r from pages),
parts as (
  select page_id, row_key, translate(regexp_extract(r, '^[^/?#]*'), {_AZ}) as host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from rest)
select page_id, p.host, p.path, max_by(rule, length(rule)) as rule,
  coalesce(max_by(verdict, length(rule)), 'allow') as verdict
from parts p left join rules u
  on (p.host = u.host or ends_with(p.host, '.' || u.host)) and starts_with(p.path, u.path)
group by row_key, page_id, p.host, p.path
"""

DECONTAMINATE_SQL = f"""
with cut as (
  select 'd' as side, doc_id as id, row_number() over () as row_key, text from documents
  union all select 'b', item_id, row_number() over (), text from benchmark),
words as (
  select side, id, row_key,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_AZ}), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w
  from cut),
item as (
  select id, n, array_to_string(w[i:i + n - 1], ' ') as gram
  from (select id, w, least(len(w), 13) as n, unnest(range(1, len(w) - least(len(w), 13) + 2)) as i
        from words where side = 'b' and len(w) > 0)),
lengths as (select distinct n from item),
grams as (
  select row_key, i, n, array_to_string(w[i:i + n - 1], ' ') as gram
  from (select row_key, w, n, unnest(range(1, len(w) - n + 2)) as i from words, lengths where side = 'd' and len(w) >= n)),
hit as (select row_key, i, n, item.id from grams join item using (n, gram)),
covered as (
  select row_key, count(distinct pos) as n_hit from (select row_key, unnest(range(i, i + n)) as pos from hit) group by row_key),
items as (
  select row_key, count(*) as n_items, string_agg(id, ',' order by id) as ids
  from (select distinct row_key, cast(id as varchar) as id from hit) group by row_key)
select words.id as doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from words left join covered using (row_key) left join items using (row_key) where side = 'd'
"""

#: CRC-32 of the digits of ``conv_id``, bit by bit (0xEDB88320, all ones before and after).
_CRC = """xor(list_reduce(
    list_prepend(4294967295, flatten(list_transform(string_split(cast(conv_id as varchar), ''), lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295)"""

TRIE_SQL = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as x from conversations where conv_id is not null),
own as (
  select conv_id, list({{'r': r, 'x': x}} order by turn nulls first, md5(strlen(r) || ':' || r || x)) as own, {_CRC} % 9 as h
  from turns group by conv_id),
rebuilt as (
  select a.conv_id, list_concat(list_slice(coalesce(b.own, []), 1, a.h), list_slice(a.own, a.h + 1, len(a.own))) as seq
  from own a left join own b on b.conv_id = a.conv_id - a.conv_id % 5),
paths as (
  select conv_id, d, list_slice(seq, 1, d) as p, d = len(seq) as ends
  from (select *, unnest(range(0, len(seq) + 1)) as d from rebuilt)),
nodes as (
  select row_number() over () as node, * from (
    select d, p, min(conv_id) as conv_id, count(*) as n_convs, case when d > 0 then strlen(p[d].x) else 0 end as last,
      coalesce(string_agg(conv_id, ',' order by conv_id) filter (ends), '') as ids
    from paths group by d, p)),
members as (select paths.conv_id, node, nodes.d, n_convs, last from paths join nodes using (d, p)),
below as (
  select distinct v.node, u.node as lower, u.n_convs, u.last from members v join members u on u.conv_id = v.conv_id and u.d >= v.d),
edges as (
  select distinct v.node as parent, u.node as child from members v join members u on u.conv_id = v.conv_id and u.d = v.d + 1),
children as (select parent, count(*) as n_children from edges group by parent),
sums as (
  select node, cast(sum((n_convs - 1) * last) as bigint) as saved_tokens,
    count(*) filter (lower not in (select parent from edges)) as n_leaves
  from below group by node)
select n.conv_id, n.d as depth, top.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children, n_leaves,
  saved_tokens, sha256(n.ids) as ends_sha256
from nodes n join sums using (node) left join children on children.parent = n.node
  left join edges on edges.child = n.node left join nodes top on top.node = edges.parent
"""


def llm_oracles() -> dict[str, str]:
    return {"op2_license_rules": license_sql(), "op4_url_rules": URL_SQL, "op7_decontaminate": DECONTAMINATE_SQL, "op12_prefix_trie": TRIE_SQL}
