"""Queries over all rows of their tables."""

import numpy as np

from quarry.functions import vector as V
from quarry.plans.queries import queries

ALL = queries()


def test_embedding_takes_every_chunk_of_documents(spark, tmp_path):
    texts = [(1, "alpha beta\n" + "gamma delta\n" * 400), (2, "short text"), (3, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.chunk_index): r for r in ALL["hash_embedding"](spark, str(tmp_path)).collect()}
    assert {k for k in got if k[0] == 2} == {(2, 0)} and len([k for k in got if k[0] == 1]) > 1
    assert np.allclose(got[2, 0].embedding, V.embed_tokens(["short", "text"]), atol=1e-6) and got[2, 0].dimension == V.DIMENSION


def test_numstat_takes_every_order(spark, data):
    orders = spark.read.parquet(f"{data}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert ALL["numstat_merge"](spark, data).count() == orders
