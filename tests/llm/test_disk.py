"""What the operators leave on disk while they run."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from quarry.llm import common, near_copies, substring_dedup
from quarry.llm.simhash import dedup_stage
from quarry.llm.substring_dedup import remove_repeats


def shuffle_blocks(spark) -> set[tuple[str, int]]:
    """Names and sizes of the shuffle files."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    every = (files.apply(k) for k in range(files.size()))
    return {(x.getName(), x.length()) for x in every if x.getName().startswith("shuffle_") and x.getName().endswith(".data")}


def left_after(spark, action) -> set[tuple[str, int]]:
    """Shuffle files that an action adds and leaves; they go in the background, within seconds."""
    before = shuffle_blocks(spark)
    action()
    for _ in range(50):
        if not (left := shuffle_blocks(spark) - before):
            break
        time.sleep(0.1)
    return left


def test_a_written_table_leaves_no_shuffle_files(spark):
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert not left_after(spark, lambda: common.written(df, "test"))
    assert spark.conf.get(common.DROP_SHUFFLES) == "false"


def test_repeats_are_found_without_shuffle_files_of_the_first_step(spark):
    # The segments are shuffled, some twice the input, before the texts are.
    docs = spark.createDataFrame([(k, f"{k} " + "the same passage " * 20) for k in range(20)], "doc_id long, text string")
    made = []
    assert not left_after(spark, lambda: made.append(remove_repeats(docs)))
    assert made[0].filter("n_removed > 0").count() == 20  # the first repeats itself


def near_texts(spark):
    words = [f"w{k}" for k in range(60)]
    rows = []
    for group in range(12):
        for copy in range(5):
            text = [f"g{group}", *words[group : group + 40]]
            text[3 + 5 * copy] = f"x{copy}"
            rows.append((len(rows), " ".join(text)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_the_pipeline_stage_discards_its_tables_and_shuffle_files(spark):
    docs = near_texts(spark)
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{common.shared_dir(spark)}/quarry")
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    large = lambda: {x.getPath().getName() for x in fs.listStatus(root) if x.getPath().getName().split("-")[0] in {"sets", "met", "members"}} if fs.exists(root) else set()
    before = large()
    left = left_after(spark, lambda: dedup_stage(docs))  # counts that the driver reads may stay
    assert sum(n for _, n in left) < docs.agg(F.sum(F.length("text"))).first()[0]
    assert large() == before


def test_only_written_tables_are_discarded(spark, data):
    with pytest.raises(ValueError):
        common.discard(spark, spark.read.parquet(f"{data}/documents.parquet"))


def test_blocks_of_pairs_give_the_same_result(spark, monkeypatch):
    docs = near_texts(spark)
    kept = lambda: sorted(r.doc_id for r in dedup_stage(docs).select("doc_id").collect())
    whole, parts = kept(), []
    monkeypatch.setattr(near_copies, "BLOCK", 1)
    monkeypatch.setattr(near_copies, "MEMBER_SHARE", 2)
    held = near_copies.in_blocks
    monkeypatch.setattr(near_copies, "in_blocks", lambda pairs, count, body: parts.append(count) or held(pairs, count, body))
    assert kept() == whole
    assert max(parts) > 1


def test_what_op4_deals_out_and_leaves_has_no_needless_columns(spark):
    docs = spark.createDataFrame([(k, k, f"{k} " + "the same passage " * 20) for k in range(20)], "doc_id long, th long, t string")
    found = substring_dedup.find_segments(docs, 100)
    assert found.columns == ["anchor", "seg", "doc", "th", "start", "n"] and found.filter("n < 0").count() > 0
    left = substring_dedup.compare_segments(found, 4, substring_dedup.HOT)
    assert "seg" not in left.columns
    repeats = left.filter(F.col("kind") == substring_dedup.REPEAT)
    assert repeats.count() > 0 and repeats.filter("anchor is not null or n <= 0").count() == 0
