"""Graph, corpus and log views of the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators import git
from quarry.operators.domain import VIEWS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to part: src, dst, confidence (1,000 for each line, at most 10,000)."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.count("*").alias("n"))
    return lines.select("src", "dst", F.least(F.lit(10_000), 1000 * F.col("n")).cast("bigint").alias("confidence"))


def trade_edges(spark: SparkSession, sf_dir: str, most: int = 3) -> DataFrame:
    """Supplier's nation to customer's nation: the targets of most revenue for each source; src, dst, confidence (9000 - 3000 * rank)."""
    t = lambda n: table(spark, sf_dir, n)
    supplier = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src"))
    customer = t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("dst"))
    orders = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(customer, "o_custkey")
    lines = t("lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    flows = lines.join(supplier, "l_suppkey").join(orders, "l_orderkey").groupBy("src", "dst").agg(F.sum("revenue").alias("revenue"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("revenue"), "dst"))
    return flows.withColumn("r", rank).filter(F.col("r") <= most).select("src", "dst", (12_000 - 3000 * F.col("r")).cast("bigint").alias("confidence"))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions between a user's event types in order of time: src, dst, n."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, sf_dir, "events").select(F.lag("event_type").over(w).alias("src"), F.col("event_type").alias("dst"))
    return steps.filter("src is not null").groupBy("src", "dst").agg(F.count("*").alias("n"))


def pick(values: list[str], by):
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols of five projects: id, project, path, start_line, name, kind, visibility, snippet, score, metadata of one of seven views."""
    k, size = F.col("p_partkey"), F.col("p_size")
    view = pick(list(VIEWS), k)
    first = F.when(F.col("v").isin("route", "component"), "framework").otherwise("technology")
    fields = [(first, F.lower("p_brand")), (F.lit("kind"), F.when(size % 2 == 0, F.lower("p_type"))), (F.lit("method"), F.when(size % 3 == 0, F.lit("Get"))), (F.lit("hooks"), F.concat_ws(",", F.lit("h"), size)), (F.lit("confidence"), k)]
    packed = F.concat_ws(";", *(F.concat(F.col("v"), F.lit("."), f, F.lit("="), value.cast("string")) for f, value in fields))
    folder = F.when(k % 4 == 0, "/tests/f").otherwise("/f")
    return table(spark, sf_dir, "part").withColumn("v", view).select(
        k.alias("id"), F.concat(F.lit("p"), k % 5).alias("project"), F.concat(F.lit("src/"), F.lower("p_type"), folder, size, F.lit(".rs")).alias("path"), (k % 100).alias("start_line"),
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), pick(["Function", "Method", "Struct", "Test", "Route", "Interface"], k).alias("kind"),
        F.when(size % 3 == 0, "pub").when(size % 3 == 1, "private").alias("visibility"), F.concat_ws("\n", F.when(k % 5 == 0, "pub fn").otherwise("fn"), "p_brand", "p_type").alias("snippet"), (10 * size).cast("bigint").alias("score"), packed.alias("metadata"),
    )


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each line's part to that of the order's next line: src, dst, confidence."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return steps.filter("dst is not null").groupBy("src", "dst").agg(F.least(F.lit(10_000), 8000 + 500 * F.count("*")).cast("bigint").alias("confidence"))


def numstat_counts(li: DataFrame) -> DataFrame:
    """Lines changed by order, of line items as numstat lines."""
    text = F.concat_ws("\t", F.when(F.col("l_linenumber") == 1, "-").otherwise(F.col("l_linenumber").cast("string")), F.when(F.col("l_linenumber") == 1, "-").otherwise(F.lit("2")), F.col("l_orderkey").cast("string"))
    return git.merge_counts(git.parse_numstat(li.select(text.alias("line")), "line"))
