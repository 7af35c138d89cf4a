"""Impact sets, risk, related tests, packing under a budget, savings and service rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import estimate_tokens
from quarry.operators import graph as G
from quarry.operators.symbols import module


def impact_set(edges: DataFrame, seed, depth: int, most: int) -> DataFrame:
    """node, distance of what leads to the seed within depth steps, and of its direct neighbours either way; the nearest first."""
    spark = edges.sparkSession
    start = spark.createDataFrame([(seed,)], f"node {edges.schema['src'].dataType.simpleString()}")
    callers = G.bfs(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start, depth)
    related = G.neighbors(edges, start).select(F.col("neighbor").alias("node"), F.lit(1).alias("distance"))
    best = callers.unionByName(related).filter(F.col("node") != F.lit(seed)).groupBy("node").agg(F.min("distance").cast("bigint").alias("distance"))
    return best.orderBy("distance", "node").limit(most)


def risk_level(score: Column) -> Column:
    return F.when(score < 25, "low").when(score < 50, "medium").when(score < 75, "high").otherwise("critical")


def assess(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Risk of each node by nine signals, clamped to 0..100; nodes has node, exposed, n_tests, in_cycle and centrality (its capped share).

    Impacted are callers up to two steps away and direct neighbours either way. An
    impacted node counts at its least distance, with the surest edge that reaches it
    there. Nodes without edges get no points for distance, confidence and depth.
    """
    calls = edges.filter("src <> dst").select(F.col("dst").alias("node"), F.col("src").alias("other"), "confidence")
    both = calls.unionByName(calls.select(F.col("other").alias("node"), F.col("node").alias("other"), "confidence"))
    near = both.groupBy("node", "other").agg(F.max("confidence").alias("confidence")).withColumn("distance", F.lit(1))
    first, then = calls.select("node", F.col("other").alias("via")).distinct(), calls.select(F.col("node").alias("via"), "other", "confidence")
    two = first.join(then, "via").filter("node <> other").groupBy("node", "other").agg(F.max("confidence").alias("confidence"))
    far = two.join(near, ["node", "other"], "left_anti").withColumn("distance", F.lit(2))
    hit = near.unionByName(far).groupBy("node").agg(F.max("distance").alias("most"), F.min("confidence").alias("least"))
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("fan_out"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("fan_in"))
    rows = nodes.join(out, "node", "left").join(into, "node", "left").join(hit, "node", "left").fillna(0, ["fan_in", "fan_out"])
    most, none = F.col("most"), F.col("most").isNull()
    signals = (
        F.least(10 * F.col("fan_in"), F.lit(35)) + F.least(5 * F.col("fan_out"), F.lit(20)) + F.when(none, 0).when(most <= 1, 12).otherwise(6) + F.when(none, 0).when(F.col("least") >= 8000, 10).otherwise(4)
        + F.when(F.col("exposed"), 25).otherwise(0) + F.when(F.col("n_tests") > 0, -10).otherwise(18) + F.when(none, 0).otherwise(F.least(6 * most, F.lit(18))) + F.when(F.col("in_cycle"), 20).otherwise(0) + F.col("centrality")
    )
    score = F.greatest(F.lit(0), F.least(F.lit(100), signals)).cast("bigint")
    return rows.select("node", "fan_in", "fan_out", score.alias("score"), risk_level(score).alias("level"))


def is_test_path(path: Column) -> Column:
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return F.coalesce(low.rlike(r"/(tests?|specs?)/|_(test|spec)\.rs$"), F.lit(False))


def name_similarity(name: Column, target: Column) -> Column:
    """Whether name holds the target, or one of the target's parts (between underscores) of over two bytes; never for an empty target."""
    low, t = F.lower(name), F.lower(target)
    parts = F.filter(F.split(t, "_"), lambda p: F.octet_length(p) > 2)
    return F.coalesce((F.length(t) > 0) & (low.contains(t) | F.exists(parts, lambda p: low.contains(p))), F.lit(False))


def related_tests(seed: DataFrame, candidates: DataFrame, edges: DataFrame | None = None, impacted: DataFrame | None = None, most: int = 16) -> DataFrame:
    """The tests among candidates (id, name, path, kind) by the greatest confidence of the rules that hold: graph edge 9000, name 8000, module 6500, kind 6000, impacted neighbour 5500, path 5000.

    seed is one row (id, name, path), a stated query, and is broadcast with the at
    most 64 impacted neighbours (name, path). edges (src, dst) lead from tests.
    """
    s = seed.select(F.col("id").alias("sid"), F.col("name").alias("sname"), F.col("path").alias("spath"))
    if impacted is not None:
        near = impacted.limit(64).agg(F.collect_list(F.struct("name", "path")).alias("near"))
        s = s.join(near)
    rows = candidates.filter((F.col("kind") == "Test") | is_test_path(F.col("path"))).join(F.broadcast(s), F.col("id") != F.col("sid"))
    if edges is not None:
        linked = edges.join(F.broadcast(seed.select(F.col("id").alias("dst"))), "dst", "left_semi").select(F.col("src").alias("id")).distinct().withColumn("linked", F.lit(True))
        rows = rows.join(linked, "id", "left")
    neighbour = F.exists("near", lambda x: name_similarity(F.col("name"), x["name"]) | F.coalesce(x["path"] == F.col("path"), F.lit(False))) if impacted is not None else F.lit(False)
    rules = [
        (F.col("kind") == "Test", 6000), (is_test_path(F.col("path")), 5000), (name_similarity(F.col("name"), F.col("sname")), 8000), (module(F.col("path")) == module(F.col("spath")), 6500),
        (F.col("linked") if edges is not None else F.lit(False), 9000), (neighbour, 5500),
    ]
    confidence = F.greatest(*(F.when(test, worth).otherwise(0) for test, worth in rules)).cast("bigint")
    out = rows.select("id", "name", confidence.alias("confidence")).withColumn("direct", F.col("confidence") >= 8000)
    return out.orderBy(F.desc("confidence"), "name", "id").limit(most)


def pack_symbols(rows: DataFrame, budget: int) -> DataFrame:
    """Packs of symbols (pack, id, name, path, snippet, score): of equal snippets the best, worth less in files (0.85) and modules (0.90) that hold several, then as greedy_pack."""
    best = Window.partitionBy("pack", "snippet").orderBy(F.desc("score"), "id")
    once = rows.withColumn("_n", F.row_number().over(best)).filter("_n = 1").withColumn("module", module(F.col("path")))
    in_file, in_module = (F.count("*").over(Window.partitionBy("pack", c)) for c in ("path", "module"))
    penalty = F.when(in_file > 1, 0.85).otherwise(1.0) * F.when(in_module > 2, 0.90).otherwise(1.0)
    tokens = (estimate_tokens(F.col("snippet")) + estimate_tokens(F.col("name"))).cast("bigint")
    priced = once.withColumn("penalty", penalty).withColumn("tokens", tokens)
    value = F.greatest(F.col("score"), F.lit(1)) * F.col("penalty") / F.col("tokens")
    return greedy_pack(priced.select("pack", "id", "score", "tokens", value.alias("value")), budget)


def impacted_files(impacted: DataFrame, symbols: DataFrame) -> DataFrame:
    """The files of impacted symbols (id), each once, by path."""
    return symbols.join(impacted.select("id"), "id", "left_semi").select("path").distinct().orderBy("path")


def greedy_pack(items: DataFrame, budget: int) -> DataFrame:
    """pack, n_items, tokens, ids: items (pack, id, score, tokens, optionally value) taken by value per token as long as they fit.

    An item that does not fit is skipped and the next ones are tried. A pack's
    items are folded in order, so a pack is one row of the result; per pack only
    those items take part that fit the budget alone.
    """
    value = F.col("value") if "value" in items.columns else F.greatest(F.col("score"), F.lit(1)) / F.col("tokens")
    fit = items.filter(F.col("tokens") <= budget).withColumn("v", F.round(value, 9))
    row = F.struct((-F.col("v")).alias("v"), (-F.col("score")).alias("s"), F.col("id"), F.col("tokens"))
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<bigint>").alias("ids"))
    add = lambda a, x: F.when(
        a["used"] + x["tokens"] <= budget, F.struct((a["used"] + x["tokens"]).alias("used"), F.array_append(a["ids"], x["id"]).alias("ids"))
    ).otherwise(a)
    packed = fit.groupBy("pack").agg(F.sort_array(F.collect_list(row)).alias("rows")).select("pack", F.aggregate("rows", zero, add).alias("r"))
    return packed.select("pack", F.size("r.ids").cast("bigint").alias("n_items"), F.col("r.used").alias("tokens"), F.array_join(F.sort_array("r.ids"), ",").alias("ids"))


def savings_summary(ledger: DataFrame, key: str) -> DataFrame:
    """Per key: entries, files and searches avoided, and tokens saved (800 for each file)."""
    files = F.coalesce(F.sum("files_avoided"), F.lit(0))
    return ledger.groupBy(key).agg(F.count("*").alias("entries"), files.alias("files_avoided"), F.coalesce(F.sum("searches"), F.lit(0)).alias("searches"), (800 * files).alias("tokens_saved"))


def service_edges(edges: DataFrame, projects: DataFrame) -> DataFrame:
    """Edges between projects: count, least confidence and the first eight sources as evidence."""
    a, b = projects.select(F.col("node").alias("src"), F.col("project").alias("from_project")), projects.select(F.col("node").alias("dst"), F.col("project").alias("to_project"))
    rows = edges.join(a, "src").join(b, "dst").filter("from_project <> to_project")
    return rows.groupBy("from_project", "to_project").agg(
        F.count("*").alias("n"), F.min("confidence").alias("confidence"), F.array_join(F.slice(F.sort_array(F.collect_set("src")), 1, 8), ",").alias("evidence")
    )


def service_summary(edges: DataFrame, projects: DataFrame) -> DataFrame:
    """Per project: nodes, edges within, outbound and inbound edges."""
    a, b = projects.select(F.col("node").alias("src"), F.col("project").alias("p")), projects.select(F.col("node").alias("dst"), F.col("project").alias("q"))
    rows = edges.join(a, "src").join(b, "dst")
    one = lambda c: c.cast("bigint")
    out = rows.select(F.col("p").alias("project"), one(F.col("p") == F.col("q")).alias("within"), one(F.col("p") != F.col("q")).alias("outbound"), F.lit(0).cast("bigint").alias("inbound"))
    into = rows.filter("p <> q").select(F.col("q").alias("project"), F.lit(0).cast("bigint").alias("within"), F.lit(0).cast("bigint").alias("outbound"), F.lit(1).cast("bigint").alias("inbound"))
    counts = out.unionByName(into).groupBy("project").agg(*(F.sum(c).alias(c) for c in ("within", "outbound", "inbound")))
    nodes = projects.groupBy("project").agg(F.count("*").alias("nodes"))
    return nodes.join(counts, "project", "left").fillna(0)
