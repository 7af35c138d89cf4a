"""The graph of matches between projects: nodes, edges, filters, neighbourhoods and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import graph as G

#: Confidences of the levels, and the least confidence that a level filter lets through.
LEVELS = {"high": 9000, "medium": 6000, "low": 3000, "unknown": 0}
LEAST = {"high": 8000, "medium": 5000, "low": 1, "unknown": 0}


def build(matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of matches (left_id, left_project, right_id or null, right_project, kind, confidence).

    The left node always stands; a match without a right node gives an edge to ``unresolved``.
    """
    left = matches.select(F.col("left_id").alias("node"), F.col("left_project").alias("project"))
    right = matches.filter("right_id is not null").select(F.col("right_id").alias("node"), F.col("right_project").alias("project"))
    nodes = left.unionByName(right).groupBy("node").agg(F.min("project").alias("project"))
    edges = matches.select(F.col("left_id").alias("src"), F.col("right_id").alias("dst"), F.when(F.col("right_id").isNull(), "unresolved").otherwise(F.col("kind")).alias("kind"), "confidence")
    return nodes, edges


def level(confidence):
    return F.when(confidence >= LEAST["high"], "high").when(confidence >= LEAST["medium"], "medium").when(confidence >= LEAST["low"], "low").otherwise("unknown")


def bounded(nodes: DataFrame, edges: DataFrame, most_nodes: int, most_edges: int) -> tuple[DataFrame, DataFrame]:
    """The first nodes in order of (project, node); of the edges between them the first by (confidence descending, src, dst)."""
    kept = nodes.orderBy("project", "node").limit(most_nodes)
    ids = kept.select("node")
    inner = edges.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return kept, inner.orderBy(F.desc("confidence"), "src", "dst").limit(most_edges)


def around(edges: DataFrame, seed: DataFrame, depth: int) -> DataFrame:
    """node, distance of what lies within depth steps of the seeds, whatever the direction."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return G.bfs(both, seed, depth)


def most_connected(edges: DataFrame, most: int = 10) -> DataFrame:
    """node, degree: the nodes with the most edge ends."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(most)


def histogram(edges: DataFrame) -> DataFrame:
    """level, n: edges by level of confidence."""
    return edges.groupBy(level(F.col("confidence")).alias("level")).agg(F.count("*").alias("n"))


def confidence_summary(paths: DataFrame) -> DataFrame:
    """path, least and mean (rounded down) confidence of its edges: rows (path, confidence)."""
    return paths.groupBy("path").agg(F.min("confidence").alias("least"), F.floor(F.avg("confidence")).alias("mean"))


def isolated(projects: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Projects without an edge to or from another project."""
    p = nodes.select(F.col("node").alias("src"), F.col("project").alias("a"))
    q = nodes.select(F.col("node").alias("dst"), F.col("project").alias("b"))
    across = edges.join(p, "src").join(q, "dst").filter("a <> b")
    busy = across.select(F.explode(F.array("a", "b")).alias("project")).distinct()
    return projects.join(busy, "project", "left_anti")


def cross_pack(items: DataFrame, budget: int, most_files: int) -> DataFrame:
    """The first occurrence of each file, then the files in order of score as long as they fit the characters; the oversized are skipped."""
    from quarry.operators.impact import greedy_pack

    first = items.withColumn("_n", F.row_number().over(Window.partitionBy("pack", "file").orderBy(F.desc("score"), "id"))).filter("_n = 1")
    top = first.withColumn("_r", F.row_number().over(Window.partitionBy("pack").orderBy(F.desc("score"), "id"))).filter(F.col("_r") <= most_files)
    return greedy_pack(top.select("pack", "id", "score", F.col("chars").alias("tokens")), budget)


#: Kinds of edges by category, and those that a change also follows forward when it goes downstream.
CATEGORIES = {
    "route": ("calls_http_route", "exposes_http_route"),
    "messaging": ("publishes_message", "consumes_message"),
    "dependency": ("imports_package", "provides_package", "depends_on_package", "shares_contract", "uses_contract", "implements_contract"),
    "infrastructure": ("uses_infrastructure", "defines_infrastructure_resource", "depends_on_infrastructure", "deploys_service", "selects_service", "deploys_as", "selects_workload", "routes_to_service"),
}
ALSO_DOWN = ("publishes_message", "shares_contract", "uses_contract", "depends_on_infrastructure", "deploys_service", "selects_service")


def category(kind):
    """The category of an edge's kind; other for what is in none."""
    out = F.when(kind.isin(*CATEGORIES["route"]), "route")
    for name in ("messaging", "dependency", "infrastructure"):
        out = out.when(kind.isin(*CATEGORIES[name]), name)
    return out.otherwise("other")


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """src, dst, edge: what a change of src reaches next: upstream along edges, downstream against them (and along some kinds), or both; each once."""
    ahead, back = edges.select("src", "dst", "edge"), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge")
    down = back.unionByName(edges.filter(F.col("kind").isin(*ALSO_DOWN)).select("src", "dst", "edge"))
    return {"upstream": ahead, "downstream": down, "both": ahead.unionByName(down)}[direction].distinct()


def service_map(edges: DataFrame, projects: DataFrame, evidence: bool = True, most: int = 1000) -> DataFrame:
    """Edges between projects by kind: count, least confidence and, unless stripped, the first eight sources; the surest first, at most ``most``.

    Sources are counted once before the grouping, and only the eight least are kept on the way.
    """
    a, b = projects.select(F.col("node").alias("src"), F.col("project").alias("from_project")), projects.select(F.col("node").alias("dst"), F.col("project").alias("to_project"))
    rows = edges.join(a, "src").join(b, "dst").filter("from_project <> to_project")
    keys = ["from_project", "to_project", "kind"]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("confidence").alias("confidence"))
    if evidence:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("src"))
        some = rows.select(*keys, "src").distinct().withColumn("_r", rank).filter("_r <= 8").groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list("src")), ",").alias("evidence"))
        counts = counts.join(some, keys)
    else:
        counts = counts.withColumn("evidence", F.lit(""))
    return counts.orderBy(F.desc("confidence"), *keys).limit(most)


def dependency_report(parts: dict[str, DataFrame], kinds: list[str] | None, most: int) -> DataFrame:
    """kind, candidate, other, rule, confidence of match tables (candidate, other, rule, confidence): one row per (candidate, kind, rule), then the surest."""
    out = None
    for kind, rows in parts.items():
        if kinds is None or kind in kinds:
            one = rows.select(F.lit(kind).alias("kind"), "candidate", "other", "rule", "confidence")
            out = one if out is None else out.unionByName(one)
    best = out.groupBy("candidate", "kind", "rule").agg(F.min_by(F.struct("other", "confidence"), F.struct(-F.col("confidence"), F.col("other"))).alias("b"))
    return best.select("kind", "candidate", "b.other", "rule", "b.confidence").orderBy(F.desc("confidence"), "kind", "candidate", "rule").limit(most)
