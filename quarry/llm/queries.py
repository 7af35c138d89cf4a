"""Thin queries over the operators: (spark, sf_dir) to a DataFrame, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import oracle
from quarry.llm.common import table


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.url_reputation import judge_urls

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, table(spark, sf_dir, "labels")).select("page_id", "host", "path", "rule", "verdict")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.quality_rules import clean_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return clean_documents(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.simhash import near_duplicates

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.decontaminate import contaminated, find_contamination

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), items.alias("items_sha256"), contaminated().alias("contaminated")
    )


def op5_rank_array_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"))


def op9_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.token_orc import store_and_read

    return store_and_read(table(spark, sf_dir, "documents"))


def op3_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.warc_zstd import archive_and_read

    return archive_and_read(table(spark, sf_dir, "pages"))


def op2_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.pii_bootstrap import KINDS, count_of, extract, joined

    spans = extract(table(spark, sf_dir, "documents"))
    counts = [count_of(F.col("spans"), k).alias(f"n_{k}") for k in KINDS]
    return spans.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op8_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.context_tree import score_documents

    return score_documents(table(spark, sf_dir, "documents")).drop("n_bytes")


def op4_induced_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
