import pytest
from pyspark.sql import functions as F

from quarry.operators import compaction, domain, git, impact, matching, search
from quarry.operators import graph as G
from quarry.operators import symbols as S


def test_requests_are_checked():
    search.validate_request("a", 100, (0.4, 0.5, 0.1), 0.0)
    for bad in [(" ", 1, (1, 0, 0), None), ("a", 101, (1, 0, 0), None), ("a", 1, (0, 0, 0), None), ("a", 1, (float("nan"), 1, 0), None), ("a", 1, (2, 0, 0), None), ("a", 1, (1, 0, 0), 1.5)]:
        with pytest.raises(ValueError):
            search.validate_request(*bad)
    assert search.warnings_of(0, False) == ["no_vectors"] and search.warnings_of(3, False) == []


def test_names_and_paths_of_tests(spark):
    rows = spark.createDataFrame([("check_parse_line", "parse_it", "src/tests/a.rs"), ("other", "ab_cd", "src/a_test.rs"), ("x", "", "contest/a.rs"), (None, "a", None)], "n string, t string, p string")
    out = rows.select(impact.name_similarity(F.col("n"), F.col("t")), impact.is_test_path(F.col("p"))).collect()
    assert [tuple(r) for r in out] == [(True, True), (False, True), (False, False), (False, False)]


def test_related_tests_take_the_best_rule(spark):
    seed = spark.createDataFrame([(1, "load", "src/a/f.rs")], "id int, name string, path string")
    rows = spark.createDataFrame(
        [(1, "load", "src/a/f.rs", "Function"), (2, "t", "lib/tests/x.rs", "Function"), (3, "t", "src/a/g.rs", "Test"), (4, "test_load", "z/q.rs", "Test"), (5, "t", "z/q.rs", "Test"), (6, "load_it", "src/a/h.rs", "Function")],
        "id int, name string, path string, kind string",
    )
    edges = spark.createDataFrame([(5, 1)], "src int, dst int")
    out = impact.related_tests(seed, rows, edges).collect()
    assert [(r.id, r.confidence, r.direct) for r in out] == [(5, 9000, True), (4, 8000, True), (3, 6500, False), (2, 5000, False)]
    assert impact.related_tests(seed, rows.limit(0)).collect() == []


def test_shortest_path_in_a_ladder_holds_a_row_per_node(spark):
    pairs = [(f"{i}{x}", f"{i + 1}{y}") for i in range(6) for x in "ab" for y in "ab"]
    edges = spark.createDataFrame([(s, t, 9000 - i) for i, (s, t) in enumerate(pairs)], "src string, dst string, confidence long")
    row = G.shortest_path(edges, "0a", "6b", 8).first()
    assert row.path == ["0a", "1a", "2a", "3a", "4a", "5a", "6b"] and row.depth == 6
    assert G.shortest_path(edges, "6a", "0a", 8).collect() == []


def test_views_limit_before_they_filter(spark):
    rows = spark.createDataFrame(
        [(1, "p", "b.rs", 1, "GET /x", "Route", None), (2, "p", "a.rs", 1, "home", "Route", "route.method=post;route.path=/y;route.framework=axum"), (3, "p", "c.rs", 1, "w", "Class", "wpf.technology=wpf;wpf.binding_paths=A,B")],
        "id int, project string, path string, start_line int, name string, kind string, metadata string",
    )
    out = domain.domain_view(rows, "route", 10).orderBy("id").collect()
    assert [(r.method, r.path, r.framework, r.kind) for r in out] == [("GET", "/x", "unknown", "api"), ("post", "/y", "axum", "api")]
    assert domain.domain_view(rows, "route", 1, {"method": "get"}).collect() == []
    assert [r.id for r in domain.domain_view(rows, "route", 1, {"method": "POST"}).collect()] == [2]
    assert [r.id for r in domain.domain_view(rows, "wpf", 5, {"binding_paths": "B"}).collect()] == [3]
    assert domain.federated_view(rows.limit(0), "route", 5, 5).collect() == []


def test_smallest_enclosing_range(spark):
    rows = spark.createDataFrame([(1, "f", 0, 100), (2, "f", 10, 50), (3, "f", 20, 30), (4, "f", 20, 30), (5, "g", 20, 30)], "id int, path string, start int, end int")
    assert sorted((r.src, r.dst) for r in S.contains_edges(rows).collect()) == [(1, 2), (2, 3), (3, 4)]


def test_nothing_in_nothing_out(spark):
    lines = spark.createDataFrame([(None, None), ("", "\n \n")], "e string, o string").select(compaction.output_lines(F.col("e"), F.col("o")).alias("l"))
    out = lines.select(compaction.diff_counts(F.col("l")).alias("d"), compaction.status_sections(F.col("l")).alias("s"), compaction.key_findings(F.col("l"), F.lit(2)).alias("f")).collect()
    assert {(r.d.files, r.s.branch, r.s.counts.staged, r.f[0]) for r in out} == {(0, "branch: unknown", 0, "non-zero exit code: 2")}


def test_branches_and_base(spark):
    b = git.branches(spark.createDataFrame([("* main\n  x\n\n* (HEAD detached at 1)",), (None,)], "t string"), "t")
    assert sorted((r.name, r.current, r.detached) for r in b.collect()) == [("(HEAD detached at 1)", True, True), ("main", True, False), ("x", False, False)]
    assert git.base_ref(None, b) == "main" and git.base_ref("y", b) == "y" and git.base_ref(None, b.limit(0)) is None


def test_broken_manifests(spark):
    files = spark.createDataFrame([(1, "a/package.json", "{"), (1, "b/package.json", None), (1, "App.csproj", "<Project/>"), (1, "x/Cargo.toml", '[dependencies]\nserde = { version = "1" }\nmy-x.workspace = true\n')], "project int, path string, content string")
    assert sorted((r.ecosystem, r.role, r.name) for r in matching.manifest_entries(files).collect()) == [("dotnet", "provider", "App"), ("rust", "consumer", "my-x"), ("rust", "consumer", "serde")]
