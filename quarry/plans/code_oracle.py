"""DuckDB SQL for the queries over the code index, the version-control log and the service landscape."""

from __future__ import annotations

SQL: dict[str, str] = {}

SYM = """sym as (select p_partkey as id, 'p' || (p_partkey % 5) as project, 'src/' || lower(p_type) || case when p_partkey % 4 = 0 then '/tests/f' else '/f' end || p_size || '.rs' as path, p_partkey % 100 as start_line,
 replace(p_name, ' ', '_') as name, ['Function', 'Method', 'Struct', 'Test', 'Route', 'Interface'][p_partkey % 6 + 1] as kind, case p_size % 3 when 0 then 'pub' when 1 then 'private' end as visibility,
 case when p_partkey % 5 = 0 then 'pub fn' else 'fn' end || chr(10) || p_brand || chr(10) || p_type as snippet, (10 * p_size)::bigint as score, p_partkey % 7 as v, p_size, lower(p_brand) as b, lower(p_type) as t from part)"""
PE = """pe as (select src, dst, least(10000, 8000 + 500 * count(*))::bigint as confidence from
 (select l_partkey as src, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as dst from lineitem) where dst is not null group by 1, 2)"""

SQL["symbol_find"] = f"with {SYM} select id, path, start_line, kind from sym where name = 'cold_widget'"
SQL["symbol_list"] = f"with {SYM} select id, name from sym order by name, id limit 50"
SQL["symbol_by_ids"] = f"with {SYM} select id, name, path from sym where id in (select l_partkey from lineitem where l_quantity >= 49)"
SQL["symbol_ranked_find"] = f"with {SYM} select id, name, (1220 + case when kind in ('Function', 'Method', 'Struct') then 80 else 0 end)::bigint as score from sym where name = 'cold_widget'"
SQL["symbol_search_hits"] = f"""with {SYM}, h as (select l_partkey as id, max(l_quantity) as q from lineitem group by 1)
select id, name, (case when name like '%widget%' then 200 else 0 end + 800 + trunc(q * 100) + case when kind in ('Function', 'Method') then 10 else 0 end + 20)::bigint as score from sym join h using (id) order by score desc, name, id limit 30"""
SQL["symbol_exposure"] = f"with {SYM} select id, coalesce(visibility = 'pub', false) or kind in ('Route', 'Interface') or (kind = 'Method' and snippet like 'pub %') as exposed, regexp_replace(path, '/[^/]*$', '') as module from sym"
SQL["rank_dedupe"] = "select l_partkey as id, l_quantity::bigint as score, l_linenumber::bigint as distance, l_returnflag as name from lineitem qualify row_number() over (partition by l_partkey order by l_quantity::bigint desc, l_linenumber, l_returnflag) = 1"
SQL["contains_edges"] = f"""with {SYM}, s as (select id, path, start_line as a, start_line + id % 40 as z from sym)
select o.id as src, i.id as dst, 10000::bigint as confidence from s i join s o on o.path = i.path and o.id <> i.id and o.a <= i.a and o.z >= i.z and (o.a <> i.a or o.z <> i.z or o.id < i.id) qualify row_number() over (partition by i.id order by o.z - o.a, o.id desc) = 1"""
SQL["traversal_scores"] = f"with {PE} select src, dst, (confidence + [100, 90, 80, 40, 0, 0][(src + dst) % 6 + 1] - dst % 3)::bigint as score from pe"
_ALIKE = "(contains(lower({a}), lower({b})) or len(list_filter(string_split(lower({b}), '_'), lambda p: strlen(p) > 2 and contains(lower({a}), p))) > 0)"
SQL["related_candidates"] = f"""with {SYM}, {PE}, s as (select * from sym where id = 1), imp as (select * from sym where id in (select src from pe where dst = 1) order by id limit 64),
c as (select sym.*, regexp_matches(lower(path), '/(tests?|specs?)/|_(test|spec)\\.rs$') as tp from sym where id <> 1),
r as (select c.id, c.name, greatest(case when c.kind = 'Test' then 6000 else 0 end, case when tp then 5000 else 0 end, case when {_ALIKE.format(a="c.name", b="s.name")} then 8000 else 0 end,
  case when regexp_replace(c.path, '/[^/]*$', '') = regexp_replace(s.path, '/[^/]*$', '') then 6500 else 0 end, case when c.id in (select src from pe where dst = 1) then 9000 else 0 end,
  case when c.path in (select path from imp) then 5500 else 0 end)::bigint as confidence from c, s where tp or c.kind = 'Test'),
n as (select distinct r.id from r join imp on {_ALIKE.format(a="r.name", b="imp.name")}),
z as (select id, name, greatest(confidence, case when id in (select id from n) then 5500 else 0 end)::bigint as confidence from r)
select id, confidence, confidence >= 8000 as direct from z order by confidence desc, name, id limit 16"""
SQL["impacted_files"] = f"with {SYM}, {PE} select distinct path from sym where id in (select src from pe where dst in (select id from sym where name = 'cold_widget'))"
SQL["context_pack_symbols"] = f"""with recursive {SYM},
u as (select *, regexp_replace(path, '/[^/]*$', '') as module, (greatest(1, ceil(strlen(snippet) / 4)) + greatest(1, ceil(strlen(name) / 4)))::bigint as tokens from sym qualify row_number() over (partition by project, snippet order by score desc, id) = 1),
w as (select *, (case when count(*) over (partition by project, path) > 1 then 0.85::double else 1::double end) * (case when count(*) over (partition by project, module) > 2 then 0.90::double else 1::double end) as penalty from u),
o as (select project as pack, id, tokens, row_number() over (partition by project order by round(greatest(score, 1) * penalty / tokens, 9) desc, score desc, id) as r from w where tokens <= 150),
f as (select pack, 0::bigint as r, 0::bigint as used, []::bigint[] as ids from (select distinct pack from o) union all
  select o.pack, o.r, case when used + tokens <= 150 then used + tokens else used end, case when used + tokens <= 150 then list_append(ids, id) else ids end from f join o on o.pack = f.pack and o.r = f.r + 1)
select pack, len(ids)::bigint as n_items, used as tokens, coalesce(list_aggregate(list_sort(ids), 'string_agg', ','), '') as ids from f qualify row_number() over (partition by pack order by r desc) = 1"""
_TOKENS = r"list_filter(string_split_regex(lower(regexp_replace(coalesce({t}, ''), '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
SQL["hybrid_metadata"] = f"""with d as (select doc_id, lang, source, coalesce(text, '') as text, doc_id % 3 as k, {_TOKENS.format(t="text")} as a, {_TOKENS.format(t="source")} as p from documents),
m as (select *, list_filter(['the', 'and', 'src1'], lambda t: list_contains(a, t) or list_contains(p, t)) as hit from d),
b as (select *, coalesce(lang = 'en', false) as b1, k = 0 as b2, k = 1 and len(hit) > 0 as b3, strlen(text) <= 2000 as b4, list_has_any(['the', 'and', 'src1'], p) as b5 from m)
select doc_id, round(case when b1 then 0.2 else 0 end + case when b2 then 0.3 else 0 end + case when b3 then 0.1 else 0 end + case when b4 then 0.05 else 0 end + case when b5 then 0.1 else 0 end, 6)::double as meta,
 concat_ws(',', case when b1 then 'language_match' end, case when b2 then 'source_kind_match,symbol_chunk' end, case when b3 then 'source_specific_terms' end, case when b4 then 'compact_chunk' end, case when b5 then 'path_term_match' end) as boosts,
 coalesce(list_aggregate(hit, 'string_agg', ','), '') as matched from b"""
SQL["hybrid_filters"] = "select doc_id, source as path from documents where lang = 'en' and doc_id % 3 = 1 and source like 'src1%'"

#: Views: number, what stands for a missing kind, source.
_VIEWS = {"component": (1, "unknown", "unknown"), "data_access": (2, "Unknown", "unknown"), "realtime": (3, "Unknown", "unknown"), "messaging": (4, "Unknown", "unknown"), "infrastructure": (5, "Unknown", "unknown"), "wpf": (6, "Unknown", "WpfMetadata")}
_ORDER = "path, start_line, name, id"
_FED = "k as (select * from (select *, row_number() over (partition by project order by {o}) as n from sym where {w}) where n <= 5 order by project, {o} limit 30)"
for _v, (_i, _kind, _source) in _VIEWS.items():
    _row = f"case when p_size % 2 = 0 then t else '{_kind}' end as kind"
    SQL[f"view_{_v}"] = f"with {SYM}, k as (select * from sym where v = {_i} order by {_ORDER} limit 1000) select id, name as symbol, path as file_path, {_row}, '-' as method, b as origin, '{_source}' as source, id as confidence from k"
    SQL[f"federated_{_v}"] = f"with {SYM}, {_FED.format(o=_ORDER, w=f'v = {_i}')} select id, project, name as symbol, {_row} from k"
_row = "case when v = 0 and p_size % 2 = 0 then t else 'api' end as kind"
SQL["view_route"] = f"""with {SYM}, k as (select * from sym where kind = 'Route' order by {_ORDER} limit 1000)
select id, name as symbol, path as file_path, {_row}, case when v = 0 and p_size % 3 = 0 then 'Get' else 'UNKNOWN' end as method, case when v = 0 then b else 'unknown' end as origin, 'unknown' as source, case when v = 0 then id else 0 end as confidence from k"""
SQL["federated_route"] = f"with {SYM}, {_FED.format(o=_ORDER, w="kind = 'Route'")} select id, project, name as symbol, {_row} from k"
SQL["view_wanted"] = f"with {SYM}, k as (select * from sym where v = 1 order by {_ORDER} limit 200) select id, 'h,' || p_size as hooks, t as kind from k where p_size % 2 = 0 and t = 'economy'"


def _output(lines: list[str]) -> str:
    return "l as (select l_orderkey as id, l_linenumber as i, l_partkey as j, [" + ", ".join(f"'{x}'" for x in lines) + f"][l_partkey % {len(lines)} + 1] as s from lineitem)"


_LINES = ["On branch main", "Changes to be committed:", "  modified: a", "Changes not staged for commit:", "  src/b.rs", "Untracked files:", "Unmerged paths:", "plain words"]
SQL["compact_status"] = f"""with {_output(_LINES)}, m as (select *, last_value(case when s like 'Changes to%' then 'a' when s like 'Changes not%' then 'b' when s like 'Untracked%' then 'c' when s like 'Unmerged%' then 'd' end ignore nulls)
  over (partition by id order by i, j rows unbounded preceding) as sec, s like '  %' as f from l)
select id, case when bool_or(s like 'On %') then 'On branch main' else 'branch: unknown' end as branch, count(*) filter (f and sec = 'a') as staged, count(*) filter (f and sec = 'b') as unstaged, count(*) filter (f and sec = 'c') as untracked, count(*) filter (f and sec = 'd') as conflicts from m group by id"""
_LINES = ["diff --git a/x b/x", "+++ b/x", "@@ -1 +1 @@", "+one", "-two", "Binary files differ", "--- a/y"]
SQL["compact_diff"] = f"""with {_output(_LINES)} select id, count(distinct s) filter (s like 'diff%' or s like '+++%' or s like '---%') as files, count(*) filter (s like '@@%') as hunks, count(*) filter (s = '+one') as added, count(*) filter (s = '-two') as deleted,
 count(*) filter (s like 'Binary%') as binary, coalesce(string_agg(s, chr(10) order by i, j) filter (s in ('+one', '-two')), '') as snippets from l group by id"""
_LINES = ["error: no such name", "warning: unused", "test a ... FAILED", "test result: ok", "Found 3 warnings", "compiling", "container web Exited (1)", "0.0.0.0:80->80", "src/a.rs:12: hit", "src/b.rs:1: hit", "merge conflict", "dir/"]
SQL["compact_tools"] = f"""with {_output(_LINES)}, n as (select *, l_ as k from (select *, list_position([{", ".join(f"'{x}'" for x in _LINES)}], s) - 1 as l_ from l))
select id, count(*) filter (k in (0, 2)) as errors, count(*) filter (k in (1, 4)) as warnings, count(*) filter (k = 2) as failures, count(*) filter (k in (3, 4)) as summaries, count(*) filter (k in (6, 7)) as services, count(*) filter (k in (0, 2, 6)) as issues,
 count(*) as matches, count(distinct split_part(s, ':', 1)) filter (s like '%:%') as files, count(*) as lines, count(*) filter (k = 11) as folders,
 concat_ws(chr(10), case when id % 2 = 1 then 'non-zero exit code: 1' end, string_agg(s, chr(10) order by i, j) filter (k in (0, 1, 2, 4, 10))) as findings from n group by id"""

SQL["auto_index_policy"] = """with o as (select o_orderkey as k, o_custkey as c, o_orderstatus <> 'O' as b from orders),
r as (select k, concat_ws(',', case when k % 11 = 0 then 'auto_index_disabled' end, case when c % 13 = 0 then 'no_git_repo' end, case when b then 'branch_changed' end, case when k % 17 = 0 then 'detached_head' end, case when k % 19 = 0 then 'conflict_detected' end,
  case when c % 60 > 50 then 'excessive_changed_files' end, case when k % 23 = 0 then 'git_status_warning' end, case when k % 5 = 0 and k % 2 = 0 then 'changed_files_not_listed' end, case when k % 29 = 0 then 'truncated_changed_files' end,
  case when c % 3 = 2 then 'unsafe_change_status:deleted' end) as blocked, c % 13 = 0 or b or k % 17 = 0 or k % 19 = 0 or c % 60 > 50 or k % 29 = 0 or c % 3 = 2 as manual from o)
select k as id, blocked, manual, blocked = '' and k % 2 = 0 as permitted from r"""
SQL["branch_compare"] = "select o_orderkey as path, case o_orderstatus when 'O' then 'added' when 'F' then 'deleted' else 'modified' end as status from orders where o_orderstatus in ('O', 'F') or o_orderpriority = '1-URGENT'"
SQL["branch_list"] = "select n_name as name, 'refs/heads/' || n_name as full_ref, n_nationkey % 5 = 0 as current, false as detached from nation"
SQL["index_snapshot_latest"] = "select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1"
_NAMED = ["route"] + list(_VIEWS)
SQL["diff_evidence"] = f"with {SYM}, c as (select * from sym where path in (select path from sym where name = 'cold_widget')) " + " union all ".join(
    f"(select '{v}' as source, id, name, path, start_line as line from c where {'kind = ' + chr(39) + 'Route' + chr(39) if v == 'route' else f'v = {i}'} order by path, start_line, name, id limit 20)" for i, v in enumerate(_NAMED)
)

#: The trade graph between nations, and the kinds of its edges.
_G3 = """flow as (select s_nationkey as src, c_nationkey as dst, sum(l_extendedprice * (1 - l_discount)) as revenue
  from lineitem join supplier on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey group by all),
g3 as (select src, dst, (12000 - 3000 * r)::bigint as confidence, ['calls_http_route', 'exposes_http_route', 'publishes_message', 'consumes_message', 'imports_package', 'provides_package', 'depends_on_package', 'shares_contract', 'uses_contract',
  'implements_contract', 'uses_infrastructure', 'defines_infrastructure_resource', 'depends_on_infrastructure', 'deploys_service', 'selects_service', 'deploys_as', 'selects_workload', 'routes_to_service', 'links'][(src + dst) % 19 + 1] as kind
  from (select src, dst, row_number() over (partition by src order by revenue desc, dst) as r from flow) where r <= 3)"""
SQL["edge_categories"] = f"with {PE}, k as (select confidence, (src + dst) % 19 as i from pe) select case when i < 2 then 'route' when i < 4 then 'messaging' when i < 10 then 'dependency' when i < 18 then 'infrastructure' else 'other' end as category, count(*) as n, min(confidence) as confidence from k group by 1"
_DOWN = "select dst as a, src as z, src || '>' || dst as e from g3 union select src, dst, src || '>' || dst from g3 where kind in ('publishes_message', 'shares_contract', 'uses_contract', 'depends_on_infrastructure', 'deploys_service', 'selects_service')"
_UP = "select src as a, dst as z, src || '>' || dst as e from g3"
SQL["arch_directed"] = f"with {_G3} " + " union all ".join(f"select a as src, count(*) as n, min(z) as first, '{name}' as direction from ({q}) group by a" for name, q in {"upstream": _UP, "downstream": _DOWN, "both": f"{_UP} union {_DOWN}"}.items())
SQL["service_map"] = f"""with {_G3}, e as (select a.n_regionkey as p, b.n_regionkey as q, g3.* from g3 join nation a on a.n_nationkey = src join nation b on b.n_nationkey = dst)
select p as from_project, q as to_project, kind, count(*) as n, min(confidence) as confidence, list_aggregate(list_sort(list(distinct src))[1:8], 'string_agg', ',') as evidence from e where p <> q group by p, q, kind"""
SQL["route_roles"] = "select page_id, case when page_id % 4 = 0 or page_id % 5 in (0, 2) then 'server' when page_id % 4 in (1, 2) or page_id % 5 = 1 then 'page' else 'unknown' end as role from pages"
SQL["message_keys"] = """with e as (select user_id as u, event_type, case when user_id % 3 = 0 or user_id % 4 = 2 then 'producer' when user_id % 3 = 1 or user_id % 4 = 1 then 'consumer' else 'none' end as role, ['rabbitmq', 'kafka', 'unknown'][user_id % 3 + 1] as broker from events),
k as (select role, broker, 'topic' as key_kind, event_type as key_name from e where u % 2 = 0 union all select role, broker, 'queue', 'q' from e where u % 3 = 0 union all select role, broker, 'routing_key', 'r' from e where u % 5 = 0
 union all select role, broker, 'exchange_routing_key', 'ex:r' from e where u % 2 = 1 and u % 5 = 0) select *, count(*) as n from k group by all"""
SQL["infra_kinds"] = """with k as (select p_partkey, p_partkey % 6 as t, p_partkey % 7 as k, p_partkey % 3 as r from part)
select p_partkey, case when t = 0 and k = 0 then 'compose_service' when t = 1 and k = 1 then 'docker_image' when t = 2 and r = 0 then 'k8s_service' when t = 2 and r = 1 then 'k8s_secret' when t = 3 and k = 2 then 'terraform_module' when t in (3, 4) then 'terraform_resource'
 when k = 3 then 'database' when k = 4 then 'cache' when k = 5 then 'queue' else 'unknown' end as kind from k"""
SQL["manifest_entries"] = """with p as (select p_partkey as project, ['npm', 'dotnet', 'go', 'rust'][p_partkey % 4 + 1] as ecosystem, case when p_partkey % 4 = 2 then 'org/' else '' end as o, lower(replace(p_brand, '#', '-')) as b, lower(p_type) as t from part)
select project, ecosystem, 'provider' as role, o || b as name from p union all select project, ecosystem, 'consumer', o || t from p union all select project, ecosystem, 'consumer', o || 'lint' from p"""
SQL["graph_first_edges"] = f"""with recursive {PE}, fe as (select * from pe order by src, dst limit 2000), s as (select min(src) as node from fe),
walk as (select node, 0 as d from s union select dst, d + 1 from walk join fe on src = node where d < 3), far as (select min(node) as node from (select node, min(d) as d from walk group by node) where d = 3)
select s.node || '>' || a.dst || '>' || b.dst || '>' || c.dst as path, 3::bigint as depth from s, far, fe a, fe b, fe c where a.src = s.node and b.src = a.dst and c.src = b.dst and c.dst = far.node order by a.dst, b.dst limit 1"""
SQL["graph_edge_types"] = f"with {PE} select case when (src + dst) % 4 = 0 then 'Calls' else 'CONTAINS' end as edge_type, count(*) as n from pe where (src + dst) % 4 in (0, 2) group by 1"
SQL["graph_nodes_by_ids"] = f"with {SYM}, {PE} select id as node, case when kind <> 'Route' then upper(path) end as path from sym where id in (select dst from pe where confidence > 8500)"
SQL["answer_quality"] = "with o as (select o_orderkey as k, o_custkey as c from orders), " + """r as (select k as id, case when c % 4 = 0 then 0 else (k % 4) / (c % 4) end as f, case when c % 3 = 0 then 1 else (k % 3) / (c % 3) end as s, case when c % 5 = 0 then 1 else (k % 5) / (c % 5) end as n,
 case when c % 2 = 0 then 1 else (k % 2) / (c % 2) end as a, case when c % 6 = 0 then 1 else (k % 6) / (c % 6) end as t, (c % 10) / 10 as top from o)
select id, round(least(1, greatest(0, 0.3 * f + 0.2 * s + 0.2 * n + 0.15 * a + 0.1 * t + 0.05 * top)), 6)::double as score from r"""


def dependency_report(packages: str, contracts: str) -> str:
    """From the SQL of the two match queries."""
    return f"""with a as (select 'package' as kind, consumer_id as candidate, provider_id as other, rule, confidence from ({packages}) union all select 'contract', left_id, right_id, 'contract', confidence from ({contracts}))
select kind, candidate, other, rule, confidence from (select * from a qualify row_number() over (partition by candidate, kind, rule order by confidence desc, other nulls first) = 1) order by confidence desc, kind, candidate, rule limit 50"""
