"""Whole-identifier occurrences for renames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pattern(name: str) -> str:
    return rf"(?<![A-Za-z0-9_]){re.escape(name)}(?![A-Za-z0-9_])"


def occurrence_counts(rows: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """key, n: whole-identifier occurrences of name (letters, digits and underscores make identifiers)."""
    return rows.select(key, F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(_pattern(name)), F.lit(0))).cast("bigint").alias("n"))


def positions(rows: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """key, line, column (from 1), confidence of each occurrence; in comments or strings 3000, elsewhere 6000."""
    lines = rows.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("i", "s")).filter(F.col("s").rlike(_pattern(name)))
    gaps = F.split("s", _pattern(name), -1)
    size = len(name)
    at = F.transform(F.sequence(F.lit(1), F.size(gaps) - 1), lambda k: F.aggregate(F.slice(gaps, F.lit(1), k), F.lit(0), lambda a, g: a + F.length(g)) + (k - 1) * size + 1)
    low = F.col("s").rlike(r"^\s*(//|#|\*|--)") | (F.col("s").rlike("[\"']"))
    return lines.select(key, (F.col("i") + 1).cast("bigint").alias("line"), F.explode(at).alias("c"), F.when(low, 3000).otherwise(6000).cast("bigint").alias("confidence")).select(key, "line", F.col("c").cast("bigint").alias("column"), "confidence")


def overlaps(edits: DataFrame, key: str) -> DataFrame:
    """Places that more than one edit touches."""
    return edits.groupBy(key, "line", "column").agg(F.count("*").alias("n")).filter("n > 1")
