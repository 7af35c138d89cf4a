"""DuckDB SQL for the queries of the catalogue, over the same tables."""

from __future__ import annotations

from quarry.plans import code_oracle

SQL: dict[str, str] = {}

TOKENS = r"list_filter(string_split_regex(lower(regexp_replace(coalesce({t}, ''), '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
WORD_TOKENS = TOKENS.format(t="text")

#: The trade graph between nations.
G3 = """
flow as (select s_nationkey as src, c_nationkey as dst, sum(l_extendedprice * (1 - l_discount)) as revenue
  from lineitem join supplier on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey group by all),
g3 as (select src, dst, (12000 - 3000 * r)::bigint as confidence from
  (select src, dst, row_number() over (partition by src order by revenue desc, dst) as r from flow) where r <= 3)"""
G2 = "g2 as (select l_suppkey as src, l_partkey as dst, least(10000, 1000 * count(*))::bigint as confidence from lineitem group by all)"
NODES = "nodes as (select n_nationkey as node from nation)"

SQL["doc_tokenize_counts"] = f"select doc_id, len(t)::bigint as n_tokens, len(list_distinct(t))::bigint as n_distinct from (select doc_id, {WORD_TOKENS} as t from documents)"
SQL["token_estimates"] = """select doc_id, greatest(1, ceil(strlen(coalesce(text, '')) / 4))::bigint as tokens, ceil(strlen(coalesce(text, '')) / 4)::bigint as tokens_or_none from documents"""
SQL["snippets"] = r"""
select doc_id, md5(left(list_aggregate(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), 'string_agg', chr(10)), 600)) as snippet,
  md5(left(list_aggregate(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')[1:48], 'string_agg', ' '), 240)) as preview,
  md5(coalesce(list_aggregate(string_split(text, chr(10))[2:4], 'string_agg', chr(10)), '')) as lines from documents
"""
_NAMES = "password|passwd|pwd|secret|token|api_key|apikey|private_key|access_key|client_secret|connection_string|conn_string|connectionstring|credential|auth|bearer|jwt|certificate|cert|signing_key|encryption_key|api-key"
SQL["secret_redaction"] = r"""
with m as (select doc_id, text, '(?i)\b([A-Za-z0-9_]*(?:NAMES)[A-Za-z0-9_]*)(\s*[=:]\s*)("[^"\n]*"|''[^''\n]*''|[^\s"'']+)' as p from documents)
select doc_id, len(regexp_extract_all(text, p))::bigint as n_secrets, md5(regexp_replace(text, p, '\1\2[REDACTED]', 'g')) as redacted from m where len(regexp_extract_all(text, p)) > 0
""".replace("NAMES", _NAMES)
SQL["intent_classify"] = r"""
select conv_id, turn, case when q like '%caller%' or q like '%who calls%' then 'callers' when q like '%callee%' or q like '%calls from%' then 'callees'
  when q like '%dependency%' or q like '%path%' or q like '%trace%' then 'trace' when q like '%impact%' or q like '%affected%' then 'impact'
  when q like '%context%' or q like '%pack%' then 'pack' when q like '%test%' then 'test' when q like '%explain%' or q like '%what is%' then 'explanation'
  when regexp_full_match(q, '[\p{L}\p{N}_:]*') then 'symbol_lookup' else 'code_search' end as intent
from (select conv_id, turn, lower(coalesce(text, '')) as q from conversations)
"""
_BM25 = f"""
d as (select doc_id, {WORD_TOKENS} as t from documents), st as (select count(*) as n, avg(len(t)) as mean from d),
h as (select doc_id, len(t) as len, w as term, len(list_filter(t, lambda x: x = w)) as tf from d, (select unnest(['the', 'and', 'report']) as w)),
hit as (select * from h where tf > 0), df as (select term, count(*) as df from hit group by term),
bm as (select doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))), 6) as score, count(*) as n_terms
  from hit join df using (term), st group by doc_id)"""
SQL["doc_bm25_topk"] = f"with {_BM25} select doc_id, score, n_terms from bm order by score desc, doc_id limit 20"
SQL["doc_search_filtered"] = f"with {_BM25} select doc_id, score, source from bm join documents using (doc_id) where lang = 'en' and source in ('src1', 'src2') order by score desc, doc_id limit 10"
SQL["rank_profile_score"] = """
with prof(intent, e, b, dm, k, p) as (values ('symbol_lookup', 12, 3, 1, 80, 20), ('code_search', 4, 10, 1, 20, 20), ('test', 4, 7, 1, 140, 20), ('callers', 3, 2, 4, 30, 80), ('callees', 3, 2, 4, 30, 80),
  ('trace', 3, 2, 4, 30, 80), ('impact', 3, 2, 3, 60, 80), ('pack', 6, 6, 2, 50, 40), ('explanation', 6, 6, 2, 50, 40)),
r as (select p_partkey, p_brand, ['Function', 'Method', 'Struct', 'Test', 'Module'][p_size % 5 + 1] as kind, p_size % 4 as dist, -p_retailprice / 1000 as bm from part)
select p_partkey, intent, (case when lower(p_brand) = 'brand#1' then e * 100 when lower(p_brand) like '%brand#1%' then e * 100 // 2 else 0 end + b * 80 + trunc(abs(bm * 100))
  + case when dist > 0 then dm * 60 // dist else 0 end
  + case when (intent = 'test' and kind = 'Test') or (intent = 'symbol_lookup' and kind in ('Function', 'Method', 'Struct')) or (intent in ('callers', 'callees') and kind in ('Function', 'Method')) then k
         when kind in ('Function', 'Method') then k // 2 else 0 end + p)::bigint as score from r, prof
"""
_COS = "list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings order by vec_id limit 1))"
SQL["vec_topk_cosine"] = f"select vec_id, label, round({_COS}, 6) as score from embeddings order by {_COS} desc, vec_id limit 25"
SQL["vec_topk_filtered"] = f"select vec_id, label, round({_COS}, 6) as score from embeddings where label < 5 and {_COS} >= 0 order by {_COS} desc, vec_id limit 10"
SQL["vec_stats"] = """select label, count(*) as n, min(len(embedding))::bigint as least_dim, max(len(embedding))::bigint as most_dim,
  round(avg(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x)))), 6) as mean_norm, sum((len(list_filter(embedding, lambda x: not isfinite(x))) = 0)::bigint)::bigint as n_finite from embeddings group by label"""
_LEX = f"""lx as (select doc_id, lang, least(1.0, len(list_filter(['the', 'and', 'of', 'thing'], lambda w: list_contains(t, w))) / 4
  + case when lower(text) like '%of the%' then 0.15 else 0.0 end + case when lower(source) like '%of the%' then 0.10 else 0.0 end) as score from (select *, {WORD_TOKENS} as t from documents))"""
SQL["lexical_overlap"] = f"with {_LEX} select doc_id, round(score, 6) as score from lx"
SQL["hybrid_rank"] = f"""
with {_LEX}, a as (select doc_id as id, score as lex, 0.0 as vec, case when lang = 'en' then 0.2 else 0.0 end as meta from lx order by score desc, doc_id limit 40),
b as (select vec_id as id, 0.0 as lex, {_COS} as vec, 0.0 as meta from embeddings order by vec desc, vec_id limit 40),
m as (select id, max(lex)::double as lexical, max(vec)::double as vector, max(meta)::double as meta from (select * from a union all select * from b) group by id)
select id, round(lexical, 6) as lexical, round(vector, 6) as vector, round(greatest(0, least(1, 0.4 * lexical + 0.5 * vector + 0.1 * meta)), 6) as final
from m order by 0.4 * lexical + 0.5 * vector + 0.1 * meta desc, vector desc, lexical desc, id limit 10
"""
SQL["graph_neighbors_both"] = f"""with {G2} select src as seed, dst as neighbor, 'out' as direction, confidence from g2 where confidence >= 2000 and src <= 10 and src in (select s_suppkey from supplier)
  union all select dst, src, 'in', confidence from g2 where confidence >= 2000 and dst <= 10 and dst in (select s_suppkey from supplier)"""
_DEG = f"""{G3}, {NODES}, deg as (select node, coalesce(o, 0)::bigint as out_degree, coalesce(i, 0)::bigint as in_degree, (coalesce(o, 0) + coalesce(i, 0)) / (select count(*) - 1 from nation)::double as degree
  from nodes left join (select src, count(*) as o from g3 group by src) on src = node left join (select dst, count(distinct src) as i from g3 group by dst) on dst = node)"""
SQL["graph_degrees"] = f"with {_DEG} select node, out_degree, in_degree, round(degree, 6) as degree from deg"
SQL["graph_summary"] = f"with {G3} select case when src = dst then 'self' else 'trade' end as edge_type, confidence, count(*) as n from g3 group by all"
SQL["graph_bfs"] = f"""with recursive {G3}, walk as (select 0 as node, 0 as distance union select dst, distance + 1 from walk join g3 on src = node where distance < 3)
  select node, min(distance)::bigint as distance from walk group by node"""
SQL["graph_shortest_path"] = f"""with recursive {G3}, walk as (select 0 as node, 0 as distance union select dst, distance + 1 from walk join g3 on src = node where distance < 4),
 far as (select node from (select node, min(distance) as d from walk group by node) order by d desc, node limit 1),
 p as (select 0 as node, [0] as path, 0 as depth, 10000::bigint as confidence union all select dst, list_append(path, dst), depth + 1, least(p.confidence, g3.confidence) from p join g3 on src = node where depth < 4 and not list_contains(path, dst))
 select list_aggregate(path, 'string_agg', '>') as path, depth::bigint as depth, confidence from p where node = (select node from far) and depth > 0 order by depth, p.path limit 1"""
SQL["graph_components"] = f"""with recursive {G2}, e as (select src as a, dst + 10000000 as b from g2 where confidence >= 3000), u as (select a, b from e union select b, a from e),
 r as (select a as node, a as root from u union select r.node, u.b from r join u on u.a = r.root), c as (select node, min(root) as component from r group by node)
 select component, count(*) as size from c group by component"""
_REACH = "reach as (select src, dst from {e} union select reach.src, {e}.dst from reach join {e} on {e}.src = reach.dst)"
SQL["graph_scc_cycles"] = f"""with recursive {G3}, {NODES}, {_REACH.format(e='g3')},
 m as (select node, node as other from nodes union select a.src, a.dst from reach a join reach b on a.src = b.dst and a.dst = b.src),
 c as (select node, min(other) as component from m group by node), s as (select *, count(*) over (partition by component) as size from c)
 select component, string_agg(node, ',' order by node) as members, count(*) as size from s where size > 1 or node in (select src from g3 where src = dst) group by component"""
_EV = "ev as (select src, dst from (select lag(event_type) over (partition by user_id order by ts, event_id) as src, event_type as dst from events) where src is not null group by all)"
SQL["graph_event_cycles"] = f"""with recursive {_EV}, nodes as (select src as node from ev union select dst from ev), {_REACH.format(e='ev')},
 m as (select node, node as other from nodes union select a.src, a.dst from reach a join reach b on a.src = b.dst and a.dst = b.src),
 c as (select node, min(other) as component from m group by node), s as (select *, count(*) over (partition by component) as size from c)
 select component, string_agg(node, ',' order by node) as members, count(*) as size from s where size > 1 group by component"""
SQL["graph_self_loops"] = f"with {G3} select src as node, confidence from g3 where src = dst"


def _pagerank(rounds: int) -> str:
    out = [f"{G3}, {NODES}, o as (select src, count(*) as o from g3 group by src), r0 as materialized (select node, 1.0::double / (select count(*) from nodes) as rank from nodes)"]
    for k in range(rounds):
        out.append(
            f"r{k + 1} as materialized (select n.node, 0.15 / (select count(*) from nodes) + 0.85 * (coalesce((select sum(r.rank / o.o) from g3 join r{k} r on r.node = g3.src join o on o.src = g3.src where g3.dst = n.node), 0)"
            f" + coalesce((select sum(rank) from r{k} where node not in (select src from o)), 0) / (select count(*) from nodes)) as rank from nodes n)"
        )
    # The first round after which the ranks moved by less than the tolerance in all, else the last.
    out += [f"m{k} as materialized (select sum(abs(a.rank - b.rank)) as m from r{k} a join r{k - 1} b using (node))" for k in range(1, rounds + 1)]
    still = lambda k: "".join(f" and (select m from m{i}) >= 0.0001" for i in range(1, k))
    ends = [f"select node, round(rank, 6) as rank from r{k} where " + (f"(select m from m{k}) < 0.0001" if k < rounds else "true") + still(k) for k in range(1, rounds + 1)]
    return "with " + ", ".join(out) + " " + " union all ".join(ends)


SQL["graph_pagerank"] = _pagerank(20)
SQL["centrality_rank"] = f"""with {_DEG} select node, least(80, trunc(500 * (in_degree / 100)) + trunc(40 * degree) + least(in_degree, 10))::bigint as boost,
 least(18, trunc(120 * (in_degree / 100)) + trunc(20 * degree) + least(in_degree, 10))::bigint as risk, (trunc(1e6 * (in_degree / 100)) + trunc(1e4 * degree) + in_degree)::bigint as sort_score from deg"""
SQL["impact_set"] = f"""with recursive {G3}, walk as (select 0 as node, 0 as distance union select src, distance + 1 from walk join g3 on dst = node where distance < 2),
 a as (select node, distance from walk union all select src, 1 from g3 where dst = 0 union all select dst, 1 from g3 where src = 0)
 select node, min(distance)::bigint as distance from a where node <> 0 group by node order by distance, node limit 64"""
SQL["impact_risk"] = f"""with {G3}, e as (select * from g3 where src <> dst),
near as (select node, other, max(confidence) as c, 1 as d from (select dst as node, src as other, confidence from e union all select src, dst, confidence from e) group by 1, 2),
two as (select a.dst as node, b.src as other, max(b.confidence) as c, 2 as d from e a join e b on b.dst = a.src where a.dst <> b.src group by 1, 2),
hit as (select node, max(d) as most, min(c) as least_c from (select * from near union all select * from two where (node, other) not in (select (node, other) from near)) group by node),
r as (select n_nationkey as node, n_regionkey, (select count(distinct src) from g3 where dst = n_nationkey) as fan_in, (select count(*) from g3 where src = n_nationkey) as fan_out, exists (select 1 from g3 where src = n_nationkey and dst = n_nationkey) as lp from nation),
s as (select r.*, least(18, trunc(120 * (fan_in / 100))::bigint + trunc(20 * ((fan_in + fan_out) / (select count(*) - 1 from nation)))::bigint + least(fan_in, 10))::bigint as cent, most, least_c from r left join hit on hit.node = r.node),
t as (select node, fan_in, fan_out, greatest(0, least(100, least(10 * fan_in, 35) + least(5 * fan_out, 20) + case when most is null then 0 when most <= 1 then 12 else 6 end + case when most is null then 0 when least_c >= 8000 then 10 else 4 end
  + case when n_regionkey = 1 then 25 else 0 end + case when n_regionkey = 2 then 18 else -10 end + case when most is null then 0 else least(6 * most, 18) end + case when lp then 20 else 0 end + cent))::bigint as score from s)
select *, case when score < 25 then 'low' when score < 50 then 'medium' when score < 75 then 'high' else 'critical' end as level from t"""
SQL["context_pack_greedy"] = """
with recursive d as (select source as pack, doc_id as id, greatest(1, ceil(strlen(coalesce(text, '')) / 4))::bigint as tokens, (n_chars % 97)::bigint as score from documents),
o as (select *, row_number() over (partition by pack order by round(greatest(score, 1) / tokens, 9) desc, score desc, id) as r from d where tokens <= 2000),
f as (select pack, 0::bigint as r, 0::bigint as used, []::bigint[] as ids from (select distinct pack from o) union all
  select o.pack, o.r, case when used + tokens <= 2000 then used + tokens else used end, case when used + tokens <= 2000 then list_append(ids, id) else ids end from f join o on o.pack = f.pack and o.r = f.r + 1)
select pack, len(ids)::bigint as n_items, used as tokens, coalesce(list_aggregate(list_sort(ids), 'string_agg', ','), '') as ids from f qualify row_number() over (partition by pack order by r desc) = 1
"""
SQL["savings_summary"] = "select event_type, count(*) as entries, sum(user_id % 7)::bigint as files_avoided, count(*) as searches, (800 * sum(user_id % 7))::bigint as tokens_saved from events group by event_type"
SQL["metadata_view_limit_then_filter"] = "select p_partkey, p_name, p_type as type, p_brand as brand, 'ANY' as method from (select * from part order by p_partkey limit 500) where p_brand = 'Brand#13'"
SQL["html_title"] = r"""select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, regexp_extract(html, '<html lang="([a-z]*)"', 1) as lang, len(regexp_extract_all(html, '<a href='))::bigint as n_links,
 len(regexp_extract_all(html, '<form\b'))::bigint as n_forms, len(regexp_extract_all(html, '<script\b'))::bigint as n_scripts from pages"""
SQL["html_links"] = """select page_id, count(*) as n, count(distinct href) as n_distinct, min(href) as first_href from (select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as href from pages) group by page_id"""
_PATH = r"""'/' || regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', '')), ':[a-z0-9_]+|\[[a-z0-9_]+\]|<[a-z0-9_:]+>|\{[a-z0-9_:]+\}', '{id}', 'g'), '^/+|/+$', '', 'g')"""
SQL["url_normalize"] = f"select page_id, {_PATH} as path, 'GET ' || ({_PATH}) as route_key from pages"
SQL["env_refs"] = r"select doc_id, len(regexp_extract_all(text, '\b(?:version|License|token)\b'))::bigint as n_refs from documents where len(regexp_extract_all(text, '\b(?:version|License|token)\b')) > 0"
SQL["route_match"] = rf"""
with p as (select page_id as id, {_PATH} as path from pages),
c as (select id, id % 5 as project, case id % 3 when 0 then null when 1 then 'GET' else 'POST' end as method, path, list_filter(string_split(path, '/'), lambda x: x <> '') as seg from p),
s as (select id, id % 7 as project, 'GET' as method, path, list_filter(string_split(path, '/'), lambda x: x <> '') as seg from (select id, regexp_replace(path, '/[0-9]+[^/]*$', '/{{id}}') as path from p)),
m as (select c.id as client_id, s.id as server_id, case when c.path = s.path then case when c.method = s.method then 'exact' when c.method is null then 'unknown_method' else 'other_method' end
  when c.method = s.method and len(c.seg) = len(s.seg) and s.path like '%{{id}}%' and s.seg[1] <> '{{id}}' and len(list_filter(list_zip(c.seg, s.seg), lambda z: z[1] <> z[2] and z[2] <> '{{id}}')) = 0 then 'pattern' end as rule
  from c join s on c.project <> s.project)
select client_id, server_id, rule, (case rule when 'exact' then 9000 when 'unknown_method' then 6000 when 'pattern' then 8000 else 3000 end)::bigint as confidence from m where rule is not null
"""
SQL["message_match"] = """
with e as (select distinct user_id, event_type as name, user_id % 4 as project, case user_id % 5 when 0 then 'kafka' when 3 then 'unknown' when 4 then 'pubsub' else 'rabbitmq' end as broker, ['topic', 'pattern', 'queue'][user_id % 3 + 1] as kind from events),
x as (select p.name, p.broker as pb, c.broker as cb, p.kind as pk, c.kind as ck, (p.kind in ('topic', 'queue') and c.kind = 'pattern') or (c.kind in ('topic', 'queue') and p.kind = 'pattern') as fits
  from e p join e c on p.name = c.name and p.project <> c.project where p.user_id % 2 = 0 and c.user_id % 2 = 1),
r as (select name, case when pb = cb and pk = ck then 'exact' when pb = cb and fits then 'compatible_kind' when (pb = 'unknown' or cb = 'unknown') and (pk = ck or fits) then 'unknown_broker' when pk = ck or fits then 'conflicting_broker' end as rule from x)
select name, rule, count(*) as n, (case rule when 'unknown_broker' then 6000 when 'conflicting_broker' then 3000 else 9000 end)::bigint as confidence from r where rule is not null group by all
"""
SQL["package_match"] = """
with p as (select p_partkey, p_partkey % 5 as project, ['npm', 'rust', 'go'][p_partkey % 3 + 1] as ecosystem, p_brand || '_' || p_size as name from part),
k as (select project, ecosystem, name, case when ecosystem = 'rust' then replace(lower(name), '_', '-') when ecosystem = 'go' then regexp_replace(lower(name), '/+$', '') else lower(name) end as key, p_partkey % 2 as side, min(p_partkey) as id from p group by all),
h as (select c.id as consumer_id, s.id as provider_id, case when c.name = s.name then 'exact' else 'normalized' end as rule from k c join k s on c.ecosystem = s.ecosystem and c.key = s.key and c.project <> s.project and c.side = 1 and s.side = 0)
select consumer_id, provider_id, rule, (case rule when 'exact' then 9000 else 8000 end)::bigint as confidence from h
union all select id, null, 'external', 6000 from k where side = 1 and id not in (select consumer_id from h)
"""
SQL["contract_pairs"] = """
with p as (select p_brand as project, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g'), '(dto|model|schema|entity|contract|props)$', '') as name, min(p_partkey) as id, min(p_size) % 2 as kind from part group by p_brand, p_type)
select a.id as left_id, b.id as right_id, (case when a.name in ('user','item','data','request','response','config','result','error') then 3000 when a.kind = b.kind then 9000 else 6000 end)::bigint as confidence
from p a join p b on a.name = b.name and a.id < b.id and a.project <> b.project
"""
SQL["infra_selector_subset"] = """
with l as (select conv_id, list(distinct role || '=' || (turn % 3)) as labels from conversations group by conv_id), s as (select conv_id as selector_id, list_distinct([role || '=0', 'assistant=1']) as sel from conversations where turn = 0)
select selector_id, count(*) as n, min(conv_id) as first_conv from s join l on list_has_all(labels, sel) group by selector_id
"""
SQL["federated_counts_rollup"] = "select c_mktsegment, o_orderstatus, count(*) as n, count(distinct o_custkey) as n_customers from orders join customer on o_custkey = c_custkey group by rollup (c_mktsegment, o_orderstatus)"
SQL["federated_collect"] = "select source as project, doc_id, n_chars from (select *, row_number() over (partition by source order by n_chars desc, doc_id) as r from documents) where r <= 5 order by n_chars desc, doc_id limit 40"
_SV = f"{G3}, e as (select g3.*, a.n_regionkey as p, b.n_regionkey as q from g3 join nation a on a.n_nationkey = src join nation b on b.n_nationkey = dst)"
SQL["service_edges"] = f"with {_SV} select p as from_project, q as to_project, count(*) as n, min(confidence) as confidence, list_aggregate(list_sort(list(distinct src))[1:8], 'string_agg', ',') as evidence from e where p <> q group by p, q"
SQL["service_summary"] = f"""with {_SV} select n_regionkey as project, count(*) as nodes, coalesce((select count(*) from e where p = n_regionkey and p = q), 0)::bigint as within,
 coalesce((select count(*) from e where p = n_regionkey and p <> q), 0)::bigint as outbound, coalesce((select count(*) from e where q = n_regionkey and p <> q), 0)::bigint as inbound from nation group by n_regionkey"""
SQL["graph_isolated"] = f"with {G3} select n_nationkey as node from nation where n_nationkey not in (select dst from g3)"
_GI = "{g3}, p as (select 0 as node, [0] as path, 0 as depth, 10000::bigint as score union all select dst, list_append(path, dst), depth + 1, greatest(0, least(p.score, g3.confidence) - 250 * depth)::bigint from p join g3 on src = node where depth < {d} and not list_contains(path, dst))"
SQL["group_impact_paths"] = f"with recursive {_GI.format(g3=G3, d=3)} select list_aggregate(path, 'string_agg', '>') as path, depth::bigint as depth, score from p where depth > 0"
SQL["project_impact_rollup"] = f"with recursive {_GI.format(g3=G3, d=2)} select n_regionkey as project, count(score) as n_paths, coalesce(max(score), 0)::bigint as best, count(distinct node) as n_nodes from nation left join (select * from p where depth > 0) h on h.node = n_nationkey group by n_regionkey"
SQL["diff_status_rollup"] = """
with r as (select case l_returnflag when 'A' then 'A' when 'N' then 'M' else 'R' end as x, case when l_linestatus = 'O' then ' ' else 'M' end as y, l_quantity::bigint as a, case when l_linenumber > 1 then l_linenumber end as d from lineitem)
select count(*) as files, count(*) as staged, count_if(y <> ' ')::bigint as unstaged, 0::bigint as conflicted, count_if(x = 'M')::bigint as modified, 0::bigint as deleted, count_if(x = 'R')::bigint as renamed, 0::bigint as copied, 0::bigint as untracked,
 count_if(x = 'A')::bigint as added, coalesce(sum(a), 0)::bigint as lines_added, coalesce(sum(d), 0)::bigint as lines_deleted from r
"""
SQL["diff_impact_join"] = "select l_orderkey as path, count(*) as n, count(distinct l_partkey) as n_parts from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'P') group by l_orderkey"
SQL["freshness_status"] = """
with r as (select o_custkey % 11 <> 0 as a, o_orderpriority <> '1-URGENT' as b, o_orderkey % 3 <> 0 as c, o_orderstatus = 'O' as d from orders)
select case when not a and b then 'unsafe' when a or c then 'stale' when d then 'dirty' else 'fresh' end as status, count(*) as n, sum(a::int + (not a and b)::int + (not a and c)::int + d::int)::bigint as n_reasons from r group by 1
"""
SQL["numstat_merge"] = "select l_orderkey::varchar as path, sum(case when l_linenumber > 1 then l_linenumber end)::bigint as added, sum(case when l_linenumber > 1 then 2 end)::bigint as deleted from lineitem group by l_orderkey"
SQL["compact_log_summary"] = r"""
with d as (select doc_id, coalesce(text, '') as t, string_split(coalesce(text, ''), chr(10)) as ls from documents),
h as (select *, list_filter(ls, lambda x: regexp_matches(x, '(?i)\b(error|failed|failure|panic|warning|exception)\b'))[1:40] as hit from d),
s as (select *, list_aggregate(case when len(hit) = 0 then ls[1:40] else hit end, 'string_agg', chr(10)) as short from h)
select doc_id, len(ls)::bigint as n_lines, len(list_filter(ls, lambda x: trim(x, ' ') = ''))::bigint as n_blank, md5(short) as summary, floor((strlen(t) - strlen(short)) / 4)::bigint as saved_tokens from s
"""
SQL["budget_prefix"] = """
with l as (select doc_id, i, string_split(coalesce(text, ''), chr(10))[i] as s from (select doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as i from documents)),
c as (select *, sum(strlen(s) + 1) over (partition by doc_id order by i) as used from l),
k as (select doc_id, i, s, used, used <= 920 as ok, min(case when used > 920 then i end) over (partition by doc_id) as stop from c)
select doc_id, count_if(ok)::bigint as n_kept, max(stop) is not null as truncated, coalesce(max(case when ok then used end), 0)::bigint as used, md5(coalesce(string_agg(case when ok then s end, chr(10) order by i), '')) as kept from k group by doc_id
"""
SQL["command_families"] = "select conv_id, turn, ['git', 'cargo', 'yarn', 'rg', 'unknown', 'docker'][turn % 6 + 1] as family from conversations"
SQL["rename_occurrences"] = r"with r as (select doc_id, len(list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: x = 'the'))::bigint as n from documents) select * from r where n > 0"
SQL["quality_hit_mrr"] = """
with q as (select vec_id as q, label as ql, embedding::double[] as qe from embeddings where vec_id % 100 = 0),
s as (select q, ql, label, row_number() over (partition by q order by round(list_cosine_similarity(embedding::double[], qe), 6) desc, vec_id) as rank from embeddings, q where vec_id <> q),
b as (select q, min(case when label = ql then rank end) as hit from s where rank <= 10 group by q)
select round(avg(case when hit <= 1 then 1.0 else 0.0 end), 6) as hit1, round(avg(case when hit <= 3 then 1.0 else 0.0 end), 6) as hit3, round(avg(coalesce(1 / hit, 0.0)), 6) as mrr from b
"""
SQL["percentile_rank"] = """
with e as (select event_type, value, row_number() over (partition by event_type order by value, event_id) - 1 as i, count(*) over (partition by event_type) as n from events)
select event_type, max(case when i = floor((n - 1) * 50 / 100 + 0.5) then value end) as p50, max(case when i = floor((n - 1) * 95 / 100 + 0.5) then value end) as p95 from e group by event_type
"""
SQL["scan_paths"] = """
select page_id, case when page_id % 4 in (1, 2) then 'ignored_directory' when page_id % 5 = 1 then 'ignored_extension' end as skip_reason,
 ['rust', 'png', 'javascript', 'python', 'zzz'][page_id % 5 + 1] as language from pages
"""
SQL["changed_files"] = "select case when doc_id % 3 = 0 then 'add' when doc_id % 5 = 0 and text <> 'old' then 'update' else 'keep' end as action, count(*) as n from documents group by 1"
SQL["file_ids"] = "select doc_id, 'file-' || sha256(doc_id::varchar) as file_id, sha256(text) as content_hash from documents"
SQL["keyed_merge"] = "select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1"
SQL["dup_exact"] = "select md5(text) as digest, count(*) as n, min(doc_id) as first_id from documents group by 1 having count(*) > 1"
SQL["stream_debounce_last_event"] = """
with g as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over w < 600000000 then 0 else 1 end as opens from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(opens) over (partition by user_id order by ts, event_id) as burst from g)
select user_id, min(epoch_us(ts))::bigint as started, max(epoch_us(ts))::bigint as ended, max_by(event_id, (ts, event_id)) as last_id, count(*) as n from s group by user_id, burst
"""
SQL["chunk_lines"] = r"""
with recursive l as (select doc_id, i, string_split(coalesce(text, ''), chr(10))[i] as line from (select doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as i from documents)),
p as (select doc_id, i, substr(line, k * 2000 + 1, 2000) as s, row_number() over (partition by doc_id order by i, k) as r from (select doc_id, i, line, unnest(range(0, (greatest(length(line), 1) - 1) // 2000 + 1)) as k from l)),
f as (select doc_id, 0::bigint as r, 0::bigint as first, 0::bigint as last, '' as buf, []::struct(a bigint, b bigint, c varchar)[] as out from (select distinct doc_id from p) union all
 select p.doc_id, p.r, case when go then f.first else p.i end, p.i, case when go then buf || chr(10) || f.s else f.s end, case when go or not regexp_matches(buf, '[^\x20\x09-\x0D]') then out else list_append(out, {'a': f.first, 'b': f.last, 'c': regexp_replace(buf, '[\x20\x09-\x0D]+$', '')}) end
 from (select f.*, p.i, p.s, p.r as pr, regexp_matches(buf, '[^\x20\x09-\x0D]') and strlen(buf) + strlen(p.s) + 1 <= 2000 as go from f join p on p.doc_id = f.doc_id and p.r = f.r + 1) f join p on p.doc_id = f.doc_id and p.r = f.pr),
e as (select doc_id, case when not regexp_matches(buf, '[^\x20\x09-\x0D]') then out else list_append(out, {'a': first, 'b': last, 'c': regexp_replace(buf, '[\x20\x09-\x0D]+$', '')}) end as out from f qualify row_number() over (partition by doc_id order by r desc) = 1)
select doc_id, i - 1 as chunk_index, out[i].a as start_line, out[i].b as end_line, md5(out[i].c) as chunk from (select doc_id, out, unnest(range(1, len(out) + 1)) as i from e)
"""
SQL["rename_positions"] = r"""
with l as (select doc_id, i, string_split(text, chr(10))[i] as s from (select doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents)),
c as (select doc_id, i, s, unnest(range(1, length(s) - 2)) as k from l where s like '%heed%')
select doc_id, i::bigint as line, k::bigint as column, (case when regexp_matches(s, '^\s*(//|#|\*|--)') or regexp_matches(s, '["'']') then 3000 else 6000 end)::bigint as confidence
from c where substr(s, k, 4) = 'heed' and not regexp_matches(substr(s, k + 4, 1), '[A-Za-z0-9_]') and (k = 1 or not regexp_matches(substr(s, k - 1, 1), '[A-Za-z0-9_]'))
"""
SQL["extract_symbols"] = "select 'Function' as kind, name, count(*) as n, min(l)::bigint as first_line from (select 'size_' || p_size as name, 2 as l from part union all select 'other_' || p_size, 4 from part) group by name"
_EXT = "['rs', 'py', 'ts'][p_partkey % 3 + 1]"
SQL["extract_calls"] = f"select 'src/f' || p_partkey || '.' || {_EXT} as path, 'size_' || p_size as caller, 'other_' || p_size as callee, 8500::bigint as confidence from part"
SQL["extract_routes"] = "select 'src/f' || p_partkey || '.ts' as path, 5::bigint as line, 'express' as framework, 'GET' as method, '/parts/' || p_partkey as route from part where p_partkey % 3 = 2"
SQL["extract_clients"] = "select '/sizes/' || p_size as url, count(*) as n from part group by p_size"
SQL["extract_data_access"] = "select 'sql' as technology, 'read' as operation, 'brand_' || p_size as name, count(*) as n from part group by p_size"
SQL["scope_glob"] = "select 'src/f' || p_partkey || '.rs' as path from part where p_partkey % 3 = 0 and p_partkey::varchar like '1%'"
_AG = f"{G3}, m as (select src, a.n_regionkey as p, case when dst <> 3 then dst end as dst, b.n_regionkey as q, confidence from g3 join nation a on a.n_nationkey = src join nation b on b.n_nationkey = dst), an as (select node, min(project) as project from (select src as node, p as project from m union all select dst, q from m where dst is not null) group by node)"
SQL["arch_nodes_edges"] = f"with {_AG} select case when dst is null then 'unresolved' else 'trade' end as kind, count(*) as n, count(distinct src) as n_src from m group by 1 union all select 'project_' || project, count(*), min(node)::bigint from an group by project"
SQL["arch_bounded"] = f"with {_AG}, k as (select node from an order by project, node limit 15) select dst, src, 'trade' as kind, confidence from m where src in (select node from k) and dst in (select node from k) order by confidence desc, src, dst limit 12"
SQL["arch_neighborhood"] = f"with recursive {G3}, u as (select src, dst from g3 union select dst, src from g3), walk as (select 1 as node, 0 as distance union select dst, distance + 1 from walk join u on src = node where distance < 2) select node, min(distance)::bigint as distance from walk group by node"
SQL["arch_most_connected"] = f"with {G3} select node, count(*) as degree from (select src as node from g3 union all select dst from g3) group by node order by degree desc, node limit 10"
SQL["arch_confidence"] = f"with {G2} select case when confidence >= 8000 then 'high' when confidence >= 5000 then 'medium' when confidence >= 1 then 'low' else 'unknown' end as level, count(*) as n from g2 group by 1"
SQL["arch_isolated"] = f"with {G3}, x as (select a.n_regionkey as p, b.n_regionkey as q from g3 join nation a on a.n_nationkey = src join nation b on b.n_nationkey = dst where confidence = 9000 and a.n_regionkey <> b.n_regionkey) select distinct n_regionkey as project from nation where n_regionkey not in (select p from x) and n_regionkey not in (select q from x)"
SQL["path_confidence"] = f"with {G2} select src as path, min(confidence) as least, floor(avg(confidence))::bigint as mean from g2 group by src"
SQL["cross_pack"] = """
with recursive d as (select lang as pack, source as file, doc_id as id, n_chars % 97 as score, n_chars as chars, row_number() over (partition by lang, source order by n_chars % 97 desc, doc_id) as n from documents),
t as (select *, row_number() over (partition by pack order by score desc, id) as r0 from d where n = 1),
o as (select *, row_number() over (partition by pack order by round(greatest(score, 1) / chars, 9) desc, score desc, id) as r from t where r0 <= 12 and chars <= 10000),
f as (select pack, 0::bigint as r, 0::bigint as used, []::bigint[] as ids from (select distinct pack from o) union all
  select o.pack, o.r, case when used + chars <= 10000 then used + chars else used end, case when used + chars <= 10000 then list_append(ids, id) else ids end from f join o on o.pack = f.pack and o.r = f.r + 1)
select pack, len(ids)::bigint as n_items, used as tokens, coalesce(list_aggregate(list_sort(ids), 'string_agg', ','), '') as ids from f qualify row_number() over (partition by pack order by r desc) = 1
"""
SQL["counts_cube"] = "select source, lang, count(*) as n from documents group by cube (source, lang)"
SQL |= code_oracle.SQL
SQL["dependency_report"] = code_oracle.dependency_report(SQL["package_match"], SQL["contract_pairs"])
