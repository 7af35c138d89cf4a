"""Queries over the tables as a code index, a version-control log and a service landscape."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import keys as K
from quarry.functions import text as X
from quarry.operators import archgraph, compaction, domain, git, impact, matching, search
from quarry.operators import graph as G
from quarry.operators import symbols as S
from quarry.plans import adapters as A
from quarry.plans.adapters import pick, table

#: Kinds of edges and views as the queries deal them out.
EDGE_KINDS = [k for kinds in archgraph.CATEGORIES.values() for k in kinds] + ["links"]


# symbols


def symbol_find(spark: SparkSession, d: str) -> DataFrame:
    return S.find(A.code_symbols(spark, d), "cold_widget").select("id", "path", "start_line", "kind")


def symbol_list(spark: SparkSession, d: str) -> DataFrame:
    return S.listed(A.code_symbols(spark, d), 50).select("id", "name")


def symbol_by_ids(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("id"))
    return S.by_ids(A.code_symbols(spark, d), wanted).select("id", "name", "path")


def symbol_ranked_find(spark: SparkSession, d: str) -> DataFrame:
    return S.ranked(S.find(A.code_symbols(spark, d), "cold_widget"), "cold_widget", "symbol_lookup").select("id", "name", "score")


def symbol_search_hits(spark: SparkSession, d: str) -> DataFrame:
    """Line items as text hits of their part: the lowest is the best."""
    hits = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), (-F.col("l_quantity")).cast("double").alias("bm25"), F.col("l_orderkey").alias("at"))
    return S.search_hits(hits, A.code_symbols(spark, d), "widget", "code_search", 30).select("id", "name", "score")


def symbol_exposure(spark: SparkSession, d: str) -> DataFrame:
    return A.code_symbols(spark, d).select("id", S.exposed(F.col("visibility"), F.col("kind"), F.col("snippet")).alias("exposed"), S.module(F.col("path")).alias("module"))


def rank_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Every part once, out of its line items as ranked results."""
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_quantity").cast("bigint").alias("score"), F.col("l_linenumber").cast("bigint").alias("distance"), F.col("l_returnflag").alias("name"))
    return S.dedupe_ranked(rows)


def contains_edges(spark: SparkSession, d: str) -> DataFrame:
    rows = A.code_symbols(spark, d).select("id", "path", F.col("start_line").alias("start"), (F.col("start_line") + F.col("id") % 40).alias("end"))
    return S.contains_edges(rows)


def traversal_scores(spark: SparkSession, d: str) -> DataFrame:
    e = A.part_edges(spark, d)
    return e.select("src", "dst", S.traversal_score(F.col("confidence"), pick(["ast", "user", "import", "heuristic", "semantic", "other"], F.col("src") + F.col("dst")), F.col("dst") % 3).alias("score"))


# impact


def related_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Tests for the first symbol, with its direct neighbours as impacted ones."""
    symbols, edges = A.code_symbols(spark, d), A.part_edges(spark, d)
    seed = symbols.filter("id = 1")
    near = G.neighbors(edges, seed.select(F.col("id").alias("node")), "in").select(F.col("neighbor").alias("id")).distinct()
    impacted = symbols.join(near, "id", "left_semi").orderBy("id").limit(64)
    return impact.related_tests(seed, symbols, edges, impacted).select("id", "confidence", "direct")


def impacted_files(spark: SparkSession, d: str) -> DataFrame:
    near = G.neighbors(A.part_edges(spark, d), A.code_symbols(spark, d).filter("name = 'cold_widget'").select(F.col("id").alias("node")), "in")
    return impact.impacted_files(near.select(F.col("neighbor").alias("id")), A.code_symbols(spark, d))


def context_pack_symbols(spark: SparkSession, d: str) -> DataFrame:
    return impact.pack_symbols(A.code_symbols(spark, d).withColumnRenamed("project", "pack"), 150)


# hybrid search


def hybrid_metadata(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", F.col("lang").alias("language"), F.col("source").alias("path"), pick(["symbol_chunk", "route_chunk", "file_chunk"], F.col("doc_id")).alias("source_kind"))
    rows = search.with_metadata(docs, ["the", "and", "src1"], {"language": "en", "source_kind": "symbol_chunk"})
    return rows.select("doc_id", F.round("meta", 6).alias("meta"), F.array_join("boosts", ",").alias("boosts"), F.array_join("matched", ",").alias("matched"))


def hybrid_filters(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("language"), F.col("source").alias("path"), pick(["symbol_chunk", "route_chunk", "file_chunk"], F.col("doc_id")).alias("source_kind"))
    return search.wanted_only(docs, {"language": "en", "source_kind": "route_chunk"}, "src1").select("doc_id", "path")


# domain views


def _view(view: str, spark: SparkSession, d: str) -> DataFrame:
    rows = domain.domain_view(A.code_symbols(spark, d), view, 1000)
    return rows.select("id", "symbol", "file_path", "kind", F.coalesce("method" if "method" in rows.columns else F.lit(None).cast("string"), F.lit("-")).alias("method"), rows[next(iter(domain.VIEWS[view]))].alias("origin"), "source", "confidence")


def _federated(view: str, spark: SparkSession, d: str) -> DataFrame:
    return domain.federated_view(A.code_symbols(spark, d), view, 5, 30).select("id", "project", "symbol", "kind")


def view_wanted(spark: SparkSession, d: str) -> DataFrame:
    """Limit first, then the filters: a list's member and a kind in another case."""
    return domain.domain_view(A.code_symbols(spark, d), "component", 200, {"hooks": "h", "kind": "economy"}).select("id", "hooks", "kind")


# compaction


def tool_output(spark: SparkSession, d: str, lines: list[str]) -> DataFrame:
    """Orders as outputs of a tool: id and the lines that the order's items stand for, at most a handful of items each."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey", pick(lines, F.col("l_partkey")).alias("s"))
    order = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "s")))
    text = li.groupBy("id").agg(F.array_join(F.transform(order, lambda x: x["s"]), "\n").alias("text"))
    return text.select("id", compaction.output_lines(F.lit(None).cast("string"), F.col("text")).alias("lines"))


STATUS = ["On branch main", "Changes to be committed:", "  modified: a", "Changes not staged for commit:", "  src/b.rs", "Untracked files:", "Unmerged paths:", "plain words"]
DIFF = ["diff --git a/x b/x", "+++ b/x", "@@ -1 +1 @@", "+one", "-two", "Binary files differ", "--- a/y"]
BUILD = ["error: no such name", "warning: unused", "test a ... FAILED", "test result: ok", "Found 3 warnings", "compiling", "container web Exited (1)", "0.0.0.0:80->80", "src/a.rs:12: hit", "src/b.rs:1: hit", "merge conflict", "dir/"]


def compact_status(spark: SparkSession, d: str) -> DataFrame:
    return tool_output(spark, d, STATUS).select("id", compaction.status_sections(F.col("lines")).alias("r")).select("id", "r.branch", "r.counts.staged", "r.counts.unstaged", "r.counts.untracked", "r.counts.conflicts")


def compact_diff(spark: SparkSession, d: str) -> DataFrame:
    return tool_output(spark, d, DIFF).select("id", compaction.diff_counts(F.col("lines")).alias("r")).select("id", "r.*")


def compact_tools(spark: SparkSession, d: str) -> DataFrame:
    """The same output as that of a build, a container tool, a search and a listing."""
    lines = F.col("lines")
    parts = [compaction.build_counts(lines), compaction.docker_counts(lines), compaction.search_counts(lines), compaction.preview_counts(lines)]
    out = tool_output(spark, d, BUILD).select("id", *(p.alias(f"r{i}") for i, p in enumerate(parts)), compaction.key_findings(lines, (F.col("id") % 2).cast("int")).alias("f"))
    return out.select("id", "r0.*", "r1.*", "r2.*", "r3.*", F.array_join("f", "\n").alias("findings"))


# version control


def auto_index_policy(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    status = F.array(pick(["modified", "added", "deleted"], c), F.lit("modified"))
    rows = o.select(
        k.alias("id"), (k % 11 > 0).alias("enabled"), (c % 13 > 0).alias("is_repo"), F.lit(True).alias("indexed_repo"), F.col("o_orderstatus").alias("branch_now"), F.lit("O").alias("branch_indexed"), F.when(k % 3 > 0, k).alias("commit_now"),
        F.when(k % 3 > 0, k).alias("commit_indexed"), (k % 17 == 0).alias("detached"), F.when(k % 19 == 0, 1).otherwise(0).alias("conflicts"), (c % 60).alias("n_changed"), (k % 23 == 0).alias("warned"), (k % 5 > 0).alias("listed"),
        (k % 29 == 0).alias("truncated"), status.alias("statuses"), (k % 2 == 0).alias("dirty"),
    )
    return git.auto_index(rows).select("id", F.array_join("blocked", ",").alias("blocked"), "manual", "permitted")


def branch_compare(spark: SparkSession, d: str) -> DataFrame:
    """Two snapshots of the orders: the older ones without the open, the newer without the finished, urgent ones changed."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), "o_orderstatus", F.col("o_custkey").alias("a"), F.when(F.col("o_orderpriority") == "1-URGENT", -1).otherwise(F.col("o_custkey")).alias("b"))
    base, head = o.filter("o_orderstatus <> 'O'").select("path", F.col("a").alias("hash")), o.filter("o_orderstatus <> 'F'").select("path", F.col("b").alias("hash"))
    return git.compare(base, head)


def branch_list(spark: SparkSession, d: str) -> DataFrame:
    """Each region's nations as a listing of branches."""
    n = table(spark, d, "nation").select("n_regionkey", F.concat(F.when(F.col("n_nationkey") % 5 == 0, "* ").otherwise("  "), "n_name").alias("s"))
    return git.branches(n.groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("s")), "\n").alias("listing")), "listing")


def index_snapshot_latest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return git.latest_snapshot(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


def diff_evidence(spark: SparkSession, d: str) -> DataFrame:
    """What the views hold of the files with a cold widget."""
    symbols = A.code_symbols(spark, d)
    changed = S.find(symbols, "cold_widget").select("path", F.lit(None).cast("string").alias("old_path")).distinct()
    views = {v: domain.domain_view_rows(symbols, v).select("id", "name", "path", F.col("start_line").alias("line")) for v in domain.VIEWS}
    return git.diff_evidence(changed, views, 20)


# architecture


def kinded_edges(spark: SparkSession, d: str) -> DataFrame:
    """The trade graph with kinds of edges dealt out."""
    return A.trade_edges(spark, d).withColumns({"kind": pick(EDGE_KINDS, F.col("src") + F.col("dst")), "edge": F.concat_ws(">", "src", "dst")})


def edge_categories(spark: SparkSession, d: str) -> DataFrame:
    e = A.part_edges(spark, d).select(archgraph.category(pick(EDGE_KINDS, F.col("src") + F.col("dst"))).alias("category"), "confidence")
    return e.groupBy("category").agg(F.count("*").alias("n"), F.min("confidence").alias("confidence"))


def arch_directed(spark: SparkSession, d: str) -> DataFrame:
    e = kinded_edges(spark, d)
    one = lambda direction: archgraph.directed(e, direction).groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("first")).withColumn("direction", F.lit(direction))
    return one("upstream").unionByName(one("downstream")).unionByName(one("both"))


def service_map(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("project"))
    return archgraph.service_map(kinded_edges(spark, d), n)


def dependency_report(spark: SparkSession, d: str) -> DataFrame:
    from quarry.plans import queries as Q

    package = Q.package_match(spark, d).select(F.col("consumer_id").alias("candidate"), F.col("provider_id").alias("other"), "rule", "confidence")
    contract = Q.contract_pairs(spark, d).select(F.col("left_id").alias("candidate"), F.col("right_id").alias("other"), F.lit("contract").alias("rule"), "confidence")
    return archgraph.dependency_report({"package": package, "contract": contract}, None, 50)


def route_roles(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    role = matching.route_role(pick(["API", "page", "route", "other"], k), pick(["express", "Angular", "go_chi", "rails", "spring"], k))
    return table(spark, d, "pages").select("page_id", role.alias("role"))


def message_keys(spark: SparkSession, d: str) -> DataFrame:
    """Events as messages: their broker, role and keys, counted."""
    u = F.col("user_id")
    rows = table(spark, d, "events").select(
        matching.message_role(pick(["Publish", "consume", "none"], u), pick(["x", "EventPattern", "emit", "y"], u)).alias("role"), F.when(u % 2 == 0, F.col("event_type")).alias("topic"), F.when(u % 3 == 0, "q").alias("queue"),
        F.lit(None).cast("string").alias("pattern"), F.when(u % 5 == 0, "r").alias("routing_key"), F.when(u % 2 == 1, "ex").alias("exchange"), pick(["amqp", "Kafka", ""], u).alias("b"),
    )
    return matching.message_keys(rows, K.broker(F.col("b"))).groupBy(F.coalesce("role", F.lit("none")).alias("role"), "broker", "key_kind", "key_name").agg(F.count("*").alias("n"))


def infra_kinds(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    kind = matching.infra_kind(pick(["docker_compose", "docker", "Kubernetes", "terraform", "gcp", "aws"], k), pick(["service", "image", "module", "db", "redis_cache", "job_queue", "thing"], k), pick(["service", "secret", "pod"], k))
    return table(spark, d, "part").select("p_partkey", kind.alias("kind"))


def manifest_entries(spark: SparkSession, d: str) -> DataFrame:
    """Parts as manifests of four ecosystems that provide their brand and need their type."""
    p = table(spark, d, "part").withColumns({"k": F.col("p_partkey"), "b": F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), "t": F.lower("p_type")})
    text = (
        F.when(F.col("k") % 4 == 0, F.format_string('{"name": "%s", "dependencies": {"%s": "1"}, "devDependencies": {"lint": "2"}}', "b", "t"))
        .when(F.col("k") % 4 == 1, F.format_string('<Project><PackageId>%s</PackageId><PackageReference Include="%s" Version="1"/><ProjectReference Include="..\\lib\\lint.csproj"/></Project>', "b", "t"))
        .when(F.col("k") % 4 == 2, F.format_string("module org/%s\n\nrequire org/%s v1\nrequire (\n\torg/lint v2\n)\n", "b", "t")).otherwise(F.format_string('[package]\nname = "%s"\n\n[dependencies]\n%s = "1"\n\n[dev-dependencies]\nlint = "2"\n', "b", "t"))
    )
    name = F.concat(F.lit("p"), "k", F.lit("/"), pick(["package.json", "app.csproj", "go.mod", "Cargo.toml"], F.col("k")))
    return matching.manifest_entries(p.select(F.col("k").alias("project"), name.alias("path"), text.alias("content"))).drop("path")


# graph


def graph_first_edges(spark: SparkSession, d: str) -> DataFrame:
    """A path from the first part within the first 2,000 edges."""
    edges = G.settled(G.first_edges(A.part_edges(spark, d), 2000, "src", "dst"))
    far = G.bfs(edges, edges.select(F.min("src").alias("node")), 3).filter("distance = 3").agg(F.min("node")).first()[0]
    first = edges.agg(F.min("src")).first()[0]
    return G.shortest_path(edges, first, -1 if far is None else far, 3).select(F.array_join("path", ">").alias("path"), F.col("depth").cast("bigint").alias("depth"))


def graph_edge_types(spark: SparkSession, d: str) -> DataFrame:
    e = A.part_edges(spark, d).withColumn("edge_type", pick(["Calls", "imports", "CONTAINS", "Tests"], F.col("src") + F.col("dst")))
    return G.of_types(e, ["calls", "Contains"]).groupBy("edge_type").agg(F.count("*").alias("n"))


def graph_nodes_by_ids(spark: SparkSession, d: str) -> DataFrame:
    symbols = A.code_symbols(spark, d)
    nodes = symbols.select(F.col("id").alias("node"), F.when(F.col("kind") != "Route", F.col("path")).alias("file_id"))
    files = symbols.select(F.col("path").alias("file_id"), F.upper("path").alias("path")).distinct()
    wanted = A.part_edges(spark, d).filter("confidence > 8500").select(F.col("dst").alias("node"))
    return G.nodes_by_ids(nodes, wanted, files).select("node", "path")


def answer_quality(spark: SparkSession, d: str) -> DataFrame:
    """Orders as answers: hits out of expected files, symbols, kinds, facts and tags."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    parts = {"files": (k % 4, c % 4), "symbols": (k % 3, c % 3), "kinds": (k % 5, c % 5), "facts": (k % 2, c % 2), "tags": (k % 6, c % 6)}
    return table(spark, d, "orders").select(k.alias("id"), F.round(search.answer_quality(parts, (c % 10) / 10), 6).alias("score"))


def queries() -> dict:
    import types

    hidden = ("queries", "tool_output", "kinded_edges", "_view", "_federated", "table", "pick", "partial")
    plain = {k: v for k, v in globals().items() if isinstance(v, types.FunctionType) and v.__module__ == __name__ and k not in hidden}
    return plain | {f"view_{v}": partial(_view, v) for v in domain.VIEWS} | {f"federated_{v}": partial(_federated, v) for v in domain.VIEWS}
