import numpy as np
from pyspark.sql import functions as F

from quarry.functions import keys as K
from quarry.functions import text as X
from quarry.functions import vector as V
from quarry.operators import git, matching, rename
from quarry.operators import graph as G
from quarry.sources import scan
from quarry.streaming import debounce


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


def test_tokens(spark):
    assert one(spark, X.tokenize(F.col("t")), t="parseHTTPRequest snake_case Élan été") == ["parse", "httprequest", "snake", "case", "élan", "été"]
    assert one(spark, X.tokenize(F.col("t")), t=None) == []


def test_chunks_drop_blank_lines_and_cut_long_ones(spark):
    got = one(spark, X.chunk_lines(F.col("t"), 10), t="\n\nab\ncd\n" + "x" * 25 + "\n")
    assert [(c.start_line, c.end_line, c.chunk) for c in got] == [(3, 4, "ab\ncd"), (5, 5, "x" * 10), (5, 5, "x" * 10), (5, 6, "x" * 5)]


def test_fnv_known_values():
    assert V.fnv64([]) == 0xCBF29CE484222325
    h = ((0xCBF29CE484222325 ^ 0x61) * 0x100000001B3) % 2**64
    assert V.fnv64([b"a"]) == ((h ^ 0xFF) * 0x100000001B3) % 2**64


def test_embedding(spark):
    v = V.embed_tokens(["a", "b"])
    assert abs(np.sqrt((v * v).sum()) - 1) < 1e-12 and (v != 0).sum() == 3
    assert not V.embed_tokens([]).any()
    assert V.identifier_tokens("parseHTTPRequest snake_case Élan") == ["parse", "httprequest", "snake", "case", "élan"]
    assert V.cut_input("é" * 1001) == "é" * 1000 and V.cut_input("x" * 1999 + "é") == "x" * 1999 and V.cut_input("x" * 2000) == "x" * 2000
    h = V.fnv64([b"token", b"a"])
    assert np.sign(V.embed_tokens(["a"])[h % 384]) == (1 if h % 2 == 0 else -1)
    df = spark.createDataFrame([("a b",)], "t string").select(V.hash_embedding()("t").alias("v"))
    assert np.allclose(df.first().v, v)


def test_cosine_of_zero_is_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert df.select(V.cosine(F.col("a"), F.col("b")).alias("x"), V.cosine(F.col("b"), F.col("b")).alias("y")).first() == (0.0, 1.0)


def test_route_paths(spark):
    for raw in ("/users/:id", "/users/[id]", "/users/<id>", "/users/{id}/", "https://h.example/Users/:ID?x=1"):
        assert one(spark, K.http_path(F.col("u")), u=raw) == "/users/{id}"
    assert one(spark, K.pattern_fits(F.col("p"), F.col("q")), p="/users/{id}", q="/users/7")
    assert not one(spark, K.pattern_fits(F.col("p"), F.col("q")), p="/users/{id}", q="/users/7/x")


def test_keys(spark):
    assert one(spark, K.broker(F.col("b")), b="AMQP") == "rabbitmq"
    assert one(spark, K.broker(F.col("b")), b=None) == "unknown"
    assert one(spark, K.contract_name(F.col("b")), b="User_DTO") == "user"
    assert one(spark, K.language_of(F.col("b")), b="a/b.c/Dockerfile") == "dockerfile"
    assert one(spark, K.skip_reason(F.col("b")), b="x/node_modules/y.js") == "ignored_directory"
    assert one(spark, K.intent(F.col("b")), b="Who calls parse?") == "callers"


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, 9000) for a, b in pairs], "src string, dst string, confidence int")


def nodes(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_graph_fixtures(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("x", "x"), ("y", "z")])
    n = nodes(spark, "abcdxyz")
    assert {(r.node, r.distance) for r in G.bfs(e, nodes(spark, "a"), 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {tuple(r.members) for r in G.cycles(n, e, True).collect()} == {("b", "c", "d"), ("x",)}
    assert {tuple(r.members) for r in G.cycles(n, e, False).collect()} == {("b", "c", "d")}
    assert {(r.node, r.component) for r in G.components(n, e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "y"), ("z", "y")}
    assert G.shortest_path(e, "a", "d", 4).first().path == ["a", "b", "c", "d"]
    assert abs(G.pagerank(n, e, 8).agg(F.sum("rank")).first()[0] - 1) < 1e-9
    got = {tuple(r.path): r.score for r in G.group_impact(e, nodes(spark, "a"), 3).collect()}
    assert got == {("a", "b"): 9000, ("a", "b", "c"): 8750, ("a", "b", "c", "d"): 8250}


def test_degrees_count_parallel_edges_out_only(spark):
    d = {r.node: (r.out_degree, r.in_degree) for r in G.degrees(nodes(spark, "ab"), edges(spark, [("a", "b"), ("a", "b")])).collect()}
    assert d == {"a": (2, 0), "b": (0, 1)}


def test_porcelain(spark):
    text = "R  new.rs\0old.rs\0?? n.txt\0UU both.rs\0 M m.rs\0"
    got = {(r.path, r.status, r.staged, r.unstaged) for r in git.parse_porcelain(spark.createDataFrame([(text,)], "t string"), "t").collect()}
    assert got == {("new.rs", "renamed", True, False), ("n.txt", "untracked", False, False), ("both.rs", "conflicted", False, False), ("m.rs", "modified", False, True)}
    # An old path that begins with R is no entry, the file after it is; each row is a listing of its own.
    two = spark.createDataFrame([("R  x.md\0README.md\0 M b.rs\0",), ("A  a.rs\0",), (None,)], "t string")
    got = {(r.path, r.old_path, r.status) for r in git.parse_porcelain(two, "t").collect()}
    assert got == {("x.md", "README.md", "renamed"), ("b.rs", None, "modified"), ("a.rs", None, "added")}


def test_numstat_null_only_if_all_null(spark):
    lines = spark.createDataFrame([("-\t-\ta",), ("1\t2\tb",), ("-\t-\tb",)], "l string")
    assert {tuple(r) for r in git.merge_counts(git.parse_numstat(lines, "l")).collect()} == {("a", None, None), ("b", 1, 2)}


def test_rename_overlap(spark):
    df = spark.createDataFrame([(1, "foo foo_bar\n// foo")], "id int, t string")
    got = rename.positions(df, "id", "t", "foo")
    assert {(r.line, r.column, r.confidence) for r in got.collect()} == {(1, 1, 6000), (2, 4, 3000)}
    assert rename.overlaps(got.union(got), "id").count() == 2


def test_unmatched_clients(spark):
    c = spark.createDataFrame([(1, 1, "GET", "/a"), (2, 1, "GET", "/zz")], "client_id int, project int, method string, path string")
    s = spark.createDataFrame([(9, 2, "GET", "/a"), (8, 1, "GET", "/a")], "server_id int, project int, method string, path string")
    m = matching.match_routes(c, s)
    assert [tuple(r) for r in m.collect()] == [(1, 9, "exact", 9000)]
    assert [r.client_id for r in matching.unmatched(c, m).collect()] == [2]
    c = spark.createDataFrame([(1, 1, "GET", "/acme/users"), (2, 1, "GET", "/a/b")], "client_id int, project int, method string, path string")
    s = spark.createDataFrame([(9, 2, "GET", "/{id}/users"), (8, 2, "GET", "/{id}/{id}"), (7, 2, "GET", "/acme/{id}")], "server_id int, project int, method string, path string")
    assert {(r.client_id, r.server_id, r.rule) for r in matching.match_routes(c, s).collect()} == {(1, 9, "pattern"), (1, 8, "pattern"), (1, 7, "pattern"), (2, 8, "pattern")}


def test_packages_of_one_project_do_not_match(spark):
    kind = "id bigint, project int, ecosystem string, name string"
    c = spark.createDataFrame([(1, 1, "npm", "x"), (2, 1, "npm", "y")], kind)
    p = spark.createDataFrame([(8, 1, "npm", "x"), (9, 2, "npm", "Y")], kind)
    assert {tuple(r) for r in matching.match_packages(c, p).collect()} == {(1, None, "external", 6000), (2, 9, "normalized", 8000)}


def test_families_and_languages(spark):
    family = {"docker compose up": "docker_compose", "docker ps": "docker", '"git.exe" status': "git", "npx x": "npm", "make": "unknown", "": "unknown", "rg foo": "rg"}
    language = {"a/x.h": "c_header", "x.tsx": "tsx", "q.ksql.sql": "ksql", ".env.local": "env", "go.mod": "gomod", "Makefile": "makefile", "noext": None, "a.zzz": "zzz"}
    reason = {"a/bin/x.rs": "ignored_directory", "x.deps.json": "ignored_name", "A/COVERAGE.XML": "ignored_name", "x.min.js": None, "vendor/a.go": None, "a.mdf": "ignored_extension"}
    for function, want in ((K.command_family, family), (K.language_of, language), (K.skip_reason, reason)):
        assert {k: one(spark, function(F.col("b")), b=k) for k in want} == want


def test_discover(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.rs").write_text("fn main() {}")
    (tmp_path / "src" / "bad.py").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "node_modules" / "b.js").write_text("x")
    got = scan.discover(spark, str(tmp_path)).collect()
    assert [(r.language, r.content) for r in got] == [("rust", "fn main() {}")]


def test_merge_replaces_by_key(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z")], "k int, v string")
    assert {tuple(r) for r in scan.merge(a, b, ["k"]).collect()} == {(1, "x"), (2, "z")}


def test_registry(spark, tmp_path):
    p = tmp_path / "r.json"
    p.write_text('{"projects": [{"id": "p1", "path": "/x"}], "groups": [{"id": "g", "name": "G", "project_ids": ["p1", "p2"]}]}')
    assert {(r.project_id, r.status) for r in scan.load_registry(spark, str(p)).collect()} == {("p1", "ok"), ("p2", "missing")}


def test_stream_equals_batch(spark, data, tmp_path):
    src = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = debounce.stream_last_events(stream, ["user_id"], "ts", "event_id", 500, "60 days")
    q = out.writeStream.outputMode("complete").format("memory").queryName("debounced").start()
    q.processAllAvailable()
    q.stop()
    batch = debounce.last_events(src, ["user_id"], "ts", "event_id", 500)
    assert {tuple(r) for r in spark.table("debounced").collect()} == {tuple(r) for r in batch.collect()}


def test_apply_changes_takes_the_latest(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "x")], "path string, seq int, v string")
    rows.write.parquet(str(tmp_path / "in"))
    seen = []
    q = debounce.apply_changes(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), lambda df, _: seen.extend(tuple(r) for r in df.collect()), str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == [("a", 2, "new"), ("b", 1, "x")]
