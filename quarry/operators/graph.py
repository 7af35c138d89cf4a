"""Graph operators over edges (src, dst, ...). Loops cut their lineage in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: list[str] = []


def settled(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the folder of spark.checkpoint.dir; one of our own only where none is set."""
    spark: SparkSession = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="quarry-checkpoint-"))
            atexit.register(shutil.rmtree, _OWN[0], True)
        spark.sparkContext.setCheckpointDir(named or f"file://{_OWN[0]}")
    return df.checkpoint()


def neighbors(edges: DataFrame, seeds: DataFrame, direction: str = "both", least: int = 0) -> DataFrame:
    """seed, neighbor, direction, confidence of the edges at each seed (node)."""
    kept = edges.filter(F.col("confidence") >= least)
    out = kept.join(seeds, kept.src == seeds.node, "left_semi").select(F.col("src").alias("seed"), F.col("dst").alias("neighbor"), F.lit("out").alias("direction"), "confidence")
    into = kept.join(seeds, kept.dst == seeds.node, "left_semi").select(F.col("dst").alias("seed"), F.col("src").alias("neighbor"), F.lit("in").alias("direction"), "confidence")
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction]


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, out_degree (with parallel edges), in_degree (distinct sources), degree ((in + out) / (n - 1))."""
    n = nodes.count()
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("in_degree"))
    both = nodes.select("node").join(out, "node", "left").join(into, "node", "left").fillna(0, ["out_degree", "in_degree"])
    return both.withColumn("degree", (F.col("in_degree") + F.col("out_degree")) / F.lit(max(n - 1, 1)))


def bfs(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """node and least distance of what can be reached from start (node) in at most depth steps along edges."""
    seen = settled(start.select("node").distinct().withColumn("distance", F.lit(0)))
    front = seen
    for d in range(1, depth + 1):
        step = front.join(edges, front.node == edges.src).select(F.col("dst").alias("node")).distinct()
        front = settled(step.join(seen, "node", "left_anti").withColumn("distance", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def simple_paths(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """path (array of nodes), depth, confidence (least on the path) of all simple paths from start of 1 to depth edges."""
    front = start.select(F.col("node").alias("at"), F.array("node").alias("path"), F.lit(10_000).cast("bigint").alias("confidence"))
    found = None
    for d in range(1, depth + 1):
        step = front.join(edges, (front["at"] == edges.src) & ~F.array_contains(front.path, edges.dst))
        front = settled(step.select(F.col("dst").alias("at"), F.array_append("path", F.col("dst")).alias("path"), F.least(front.confidence, edges.confidence.cast("bigint")).alias("confidence")))
        level = front.select("path", F.lit(d).alias("depth"), "confidence")
        found = level if found is None else found.unionByName(level)
    return found


def shortest_path(edges: DataFrame, source, target, depth: int) -> DataFrame:
    """The first shortest path, by its nodes; path, depth, confidence (least on the path; of parallel edges the surest).

    Each node is reached once, by the first of its shortest paths, so a level holds
    at most one row per node.
    """
    start = edges.sparkSession.createDataFrame([(source,)], f"node {edges.schema['src'].dataType.simpleString()}")
    front = start.select("node", F.array("node").alias("path"), F.lit(10_000).cast("bigint").alias("confidence"))
    seen, found = settled(start), None
    for d in range(1, depth + 1):
        step = front.join(edges, front.node == edges.src).select(F.col("dst").alias("at"), "path", F.least(front.confidence, edges.confidence.cast("bigint")).alias("confidence"))
        fresh = step.join(seen.withColumnRenamed("node", "at"), "at", "left_anti")
        first = fresh.groupBy("at").agg(F.min(F.struct("path", (-F.col("confidence")).alias("c"))).alias("b"))
        front = settled(first.select(F.col("at").alias("node"), F.array_append("b.path", F.col("at")).alias("path"), (-F.col("b.c")).alias("confidence")))
        hit = front.filter(F.col("node") == F.lit(target)).select("path", F.lit(d).alias("depth"), "confidence")
        if not hit.isEmpty():
            return hit
        if front.isEmpty():
            break
        seen = seen.unionByName(front.select("node"))
        found = hit
    return found if found is not None else hit


def of_types(edges: DataFrame, types: list[str] | None) -> DataFrame:
    """Edges of the given types, whatever their case; all where none are given."""
    return edges if not types else edges.filter(F.lower("edge_type").isin(*(t.lower() for t in types)))


def first_edges(edges: DataFrame, most: int, *order) -> DataFrame:
    """The first edges in order: what a bounded search over edges sees."""
    return edges.orderBy(*order).limit(most)


def nodes_by_ids(nodes: DataFrame, ids: DataFrame, files: DataFrame) -> DataFrame:
    """The nodes of a table of ids (node), with the path of their file (file_id) where there is one."""
    return nodes.join(ids.select("node"), "node", "left_semi").join(files.select("file_id", "path"), "file_id", "left")


def seed_node(nodes: DataFrame, value: str) -> DataFrame:
    """The node of this id, else those of the symbol of this id."""
    both = nodes.filter((F.col("node") == value) | (F.col("symbol_id") == value))
    exact = F.coalesce(F.col("node") == value, F.lit(False))
    return both.withColumn("_x", F.max(exact).over(Window.partitionBy(F.lit(value)))).filter(~F.col("_x") | exact).drop("_x")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and component (least node connected with it, whatever the direction): large-star and small-star steps."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = (both.filter("v > u") if large else both).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out if large else out.unionByName(least.select("u", F.col("m").alias("v")))
        return out.filter("u > v").distinct()

    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    at = settled(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u > v").distinct())
    before = mark(at)
    while True:
        at = settled(star(star(at, True), False))
        after = mark(at)
        if after == before:
            break
        before = after
    roots = at.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.select("node").join(roots, "node", "left").withColumn("component", F.coalesce("component", "node"))


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 20, damping: float = 0.85, tolerance: float = 1e-4, every: int = 5) -> DataFrame:
    """node and rank. Parallel edges count; the mass of nodes without edges out is spread evenly; stops when the ranks move by less than tolerance in all."""
    n = nodes.count()
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    links = settled(edges.join(out, "src").select("src", "dst", "out"))
    ranks = settled(nodes.select("node", F.lit(1.0 / max(n, 1)).alias("rank")).join(out.withColumnRenamed("src", "node"), "node", "left"))
    for k in range(iterations):
        gained = links.join(ranks, links.src == ranks.node).groupBy("dst").agg(F.sum(F.col("rank") / links["out"]).alias("gain")).withColumnRenamed("dst", "node")
        lost = ranks.filter("out is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        fresh = (1 - damping) / n + damping * (F.coalesce("gain", F.lit(0.0)) + F.col("lost") / n)
        moved = ranks.join(gained, "node", "left").join(F.broadcast(lost), F.lit(True)).select("node", fresh.alias("rank"), "out", F.abs(fresh - F.col("rank")).alias("moved"))
        ranks = settled(moved)
        if tolerance and ranks.agg(F.sum("moved")).first()[0] < tolerance:
            break
    return ranks.select("node", "rank")


def reachable(edges: DataFrame, most: int = 64) -> DataFrame:
    """All pairs (src, dst) with a path of at least one edge, by doubling; for the bounded graphs of cycle detection."""
    pairs = settled(edges.select("src", "dst").distinct())
    size = pairs.count()
    for _ in range(most):
        a, b = pairs.alias("a"), pairs.alias("b")
        longer = a.join(b, F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
        pairs = settled(pairs.union(longer).distinct())
        now = pairs.count()
        if now == size:
            break
        size = now
    return pairs


def strong_components(nodes: DataFrame, edges: DataFrame, bound: int = 512) -> DataFrame:
    """node, component (least node of its strongly connected component), size. Meant for at most ``bound`` nodes, as cycle queries are."""
    if nodes.count() > bound:
        raise ValueError(f"cycle detection takes at most {bound} nodes; filter the graph first")
    pairs = reachable(edges)
    back = pairs.select(F.col("src").alias("b"), F.col("dst").alias("a"))
    mutual = pairs.join(back, (pairs.src == back.a) & (pairs.dst == back.b)).select(F.col("src").alias("node"), F.col("dst").alias("other"))
    least = nodes.select("node", F.col("node").alias("other")).union(mutual).groupBy("node").agg(F.min("other").alias("component"))
    return least.withColumn("size", F.count("*").over(Window.partitionBy("component")))


def cycles(nodes: DataFrame, edges: DataFrame, self_loops: bool) -> DataFrame:
    """component and members of each cycle group: components of several nodes and, if asked, nodes with an edge to themselves."""
    found = strong_components(nodes, edges)
    loops = edges.filter("src = dst").select(F.col("src").alias("node")).distinct().withColumn("loop", F.lit(True))
    kept = found.join(loops, "node", "left").filter((F.col("size") > 1) | (F.lit(self_loops) & F.coalesce("loop", F.lit(False))))
    return kept.groupBy("component").agg(F.sort_array(F.collect_list("node")).alias("members"), F.count("*").alias("size"))


def centrality_boost(rank, degree, in_degree):
    return F.least(F.lit(80), (500 * rank).cast("bigint") + (40 * degree).cast("bigint") + F.least(in_degree, F.lit(10))).cast("bigint")


def centrality_risk(rank, degree, fan_in):
    return F.least(F.lit(18), (120 * rank).cast("bigint") + (20 * degree).cast("bigint") + F.least(fan_in, F.lit(10))).cast("bigint")


def centrality_sort(rank, degree, in_degree):
    return ((1e6 * rank).cast("bigint") + (1e4 * degree).cast("bigint") + in_degree).cast("bigint")


def group_impact(edges: DataFrame, start: DataFrame, depth: int = 2, decay: int = 250) -> DataFrame:
    """path, depth and score of all simple paths: the score is cut to each edge's confidence and loses decay * (depth before the step)."""
    front = start.select(F.col("node").alias("at"), F.array("node").alias("path"), F.lit(10_000).cast("bigint").alias("score"))
    found = None
    for d in range(depth):
        step = front.join(edges, (front["at"] == edges.src) & ~F.array_contains(front.path, edges.dst))
        score = F.greatest(F.lit(0), F.least(front.score, edges.confidence.cast("bigint")) - decay * d).cast("bigint")
        front = settled(step.select(F.col("dst").alias("at"), F.array_append("path", F.col("dst")).alias("path"), score.alias("score")))
        level = front.select("path", F.lit(d + 1).alias("depth"), "score")
        found = level if found is None else found.unionByName(level)
    return found
