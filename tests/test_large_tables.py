"""Queries that failed on larger tables or odd rows, against their SQL on small ones."""

import random

import duckdb
import numpy as np
from helpers import same

from quarry.functions import vector as V
from quarry.operators import matching, nearest
from quarry.operators import symbols as S
from quarry.plans import oracle
from quarry.plans.queries import queries

ALL = queries()


def check(spark, folder, name, **tables):
    """The query equals its SQL on tables of (rows, schema)."""
    db = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        db.sql(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    same(ALL[name](spark, str(folder)), db.sql(oracle.SQL[name]))


def test_snippets_of_texts_without_words(spark, tmp_path):
    texts = [None, "", " ", "\n \n", "\t\n\r\n", "one", "a\nb", "a\n\n \nb\nc\nd", "\x1f\n\x85x\n　 y", "a\x00b\r\nc" + "\U0001f1e9\U0001f1eaé" * 300]
    check(spark, tmp_path, "snippets", documents=(list(enumerate(texts)), "doc_id long, text string"))


def test_messages_are_counted_without_their_pairs(spark, tmp_path):
    # 60,000 users of one event type are 900,000,000 pairs; what a user id stands for repeats every 60 ids.
    spark.range(60_000).selectExpr("id as user_id", "'view' as event_type").write.parquet(f"{tmp_path}/events.parquet")
    broker, kind = ["kafka", "rabbitmq", "rabbitmq", "unknown", "pubsub"], ["topic", "pattern", "queue"]
    want = {}
    for p in range(0, 60, 2):
        for c in range(1, 60, 2):
            (pb, pk), (cb, ck) = ((broker[u % 5], kind[u % 3]) for u in (p, c))
            fits = "pattern" in (pk, ck) and pk != ck
            if p % 4 != c % 4 and (pk == ck or fits):
                rule = ("exact" if pk == ck else "compatible_kind") if pb == cb else "unknown_broker" if "unknown" in (pb, cb) else "conflicting_broker"
                want[rule] = want.get(rule, 0) + 1000 * 1000
    pairs = ALL["message_match"](spark, str(tmp_path))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join") :]
    assert join.count("Aggregate") == 4  # each side: distinct users, then counts
    assert {r.rule: r.n for r in pairs.collect()} == want


def test_routes_of_one_hot_path_are_dealt_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK", 3)
    urls = [None, "https://a.example/en", *(f"https://a.example/{'en' if k % 3 else 'de'}/{k % 9}" for k in range(60))]
    check(spark, tmp_path, "route_match", pages=([(k, u) for k, u in enumerate(urls)], "page_id long, url string"))


def test_enclosing_ranges_equal_brute_force_and_are_not_paired(spark):
    deal = random.Random(5)
    rows = [(k, f"f{deal.randrange(3)}", a := deal.randrange(12), a + deal.randrange(-1, 9)) for k in range(300)]
    want = {}
    for k, path, a, z in rows:
        outer = [(e - s, -i) for i, p, s, e in rows if p == path and i != k and s <= a and e >= z and ((s, e) != (a, z) or i < k)]
        if outer:
            want[k] = -min(outer)[1]
    deal.shuffle(rows)
    got = S.contains_edges(spark.createDataFrame([*rows, (1000, None, 1, 2)], "id long, path string, start long, end long"))
    assert {r.dst: r.src for r in got.collect()} == want
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_quality_in_blocks_equals_sql_with_ties(spark, tmp_path, monkeypatch):
    for name, value in (("QUERIES", 2), ("ASKED", 1), ("ROWS", 16)):
        monkeypatch.setattr(nearest, name, value)
    deal = random.Random(7)
    rows = [(25 * k, deal.randrange(6), [float(deal.choice([-1, 1, 2])), float(deal.choice([1, 2])), float(deal.choice([0, 1]))]) for k in range(300)]
    check(spark, tmp_path, "quality_hit_mrr", embeddings=(rows, "vec_id long, label int, embedding array<float>"))


def test_quality_scores_odd_vectors_too(spark, tmp_path):
    rows = [(0, 1, [1.0, 0.0]), (1, 2, None), (2, 1, [1.0, 0.5, 3.0]), (3, 3, [0.0, 1.0]), (100, 2, None)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    # 0 finds 3 (score 0), then those without a score by id: 1, 2 (of its label), 100; 100 finds 0, 1 (of its label).
    assert tuple(ALL["quality_hit_mrr"](spark, str(tmp_path)).first()) == (0.0, 1.0, round((1 / 3 + 1 / 2) / 2, 6))


def test_rounding_is_that_of_spark(spark):
    deal = random.Random(1)
    xs = [*(deal.uniform(-1, 1) for _ in range(3000)), *(deal.randrange(-9999, 9999) / 1e6 + 5e-7 for _ in range(3000)), 0.0, -0.0, -1e-9, 1.0]
    want = [r.y for r in spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1).selectExpr("round(x, 6) y").collect()]
    assert list(map(repr, nearest.round6(np.array(xs)).tolist())) == list(map(repr, want))


def test_embeddings_together_are_those_one_by_one():
    deal = random.Random(2)
    texts = ["".join(deal.choice("abABz09_ -é߀İiΣσΑ𝐀ǅ²Ⅷ٣\n") for _ in range(deal.choice([0, 3, 30]))) for _ in range(300)]
    texts += ["one", "parseHTTPRequest snake_case Élan", "a" * 1999]
    tokens = [V.identifier_tokens(x) for x in texts]
    assert [[w for run in V.RUN.findall(x) for w in V.run_tokens(run)] for x in texts] == tokens
    assert np.array_equal(V.embed_many(tokens), np.array([V.embed_tokens(x) for x in tokens]))
