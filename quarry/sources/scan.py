"""File scans, content hashes, change plans and keyed merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.keys import language_of, skip_reason

LARGEST = 2_097_152


def discover(spark: SparkSession, root: str) -> DataFrame:
    """path, language, size_bytes, content_hash, content of the text files under root, less what is ignored, too large or not UTF-8."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).filter(F.col("length") <= LARGEST)
    kept = files.filter(skip_reason(F.col("path")).isNull() & F.is_valid_utf8(F.col("content").cast("string")))
    return kept.select("path", language_of(F.col("path")).alias("language"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("content_hash"), F.col("content").cast("string").alias("content"))


def stable_id(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), F.sha2(value, 256))


def change_plan(now: DataFrame, before: DataFrame) -> DataFrame:
    """path and action (add, update, keep, delete) from two file tables (path, content), by content hash; one full outer join."""
    a = now.select("path", F.sha2("content", 256).alias("new_hash"))
    b = before.select("path", F.sha2("content", 256).alias("old_hash"))
    action = F.when(F.col("old_hash").isNull(), "add").when(F.col("new_hash").isNull(), "delete").when(F.col("old_hash") == F.col("new_hash"), "keep").otherwise("update")
    return a.join(b, "path", "full").select("path", action.alias("action"))


def latest_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The newest row of each key: what a keyed merge leaves."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def merge(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """stored with the rows of fresh put in place of those with their keys."""
    return stored.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def exact_duplicates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The digest, size and first key of each group of equal texts."""
    return docs.groupBy(F.md5(text).alias("digest")).agg(F.count("*").alias("n"), F.min(key).alias("first_id")).filter("n > 1")


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """group_id, group_name, project_id of a JSON registry of projects and groups; projects that are not registered are marked missing."""
    raw = spark.read.option("multiLine", "true").json(path)
    groups = raw.select(F.explode("groups").alias("g")).select(F.col("g.id").alias("group_id"), F.col("g.name").alias("group_name"), F.explode("g.project_ids").alias("project_id"))
    projects = raw.select(F.explode("projects").alias("p")).select(F.col("p.id").alias("project_id"), F.col("p.path").alias("path"))
    return groups.join(projects, "project_id", "left").withColumn("status", F.when(F.col("path").isNull(), "missing").otherwise("ok"))
