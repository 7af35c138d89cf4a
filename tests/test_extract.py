import pytest
from pyspark.sql import functions as F

from quarry.operators import archgraph, extract

FILES = {
    "a/main.rs": "pub mod x;\nuse std::io;\npub struct Point;\nenum Kind { A }\nfn load() {}\npub async fn run() {\n    load()\n}\n",
    "b/app.ts": "import x from 'lib';\nexport class Shop {}\n@Get('items/:id')\napp.post('/orders', f)\nfetch('/api/users')\nsocket.on('joined', f)\n",
    "c/api.py": "from a.b import c\nclass Item:\n    async def get(self):\n        pass\n@router.get('/items/{id}')\n",
    "d/q.sql": "CREATE TABLE IF NOT EXISTS shop.items (id int);\ninsert into shop.items select * from other\n",
    "e/conf.yaml": "host: example\napi_key: abc123\n",
    "Dockerfile": "FROM python:3\nEXPOSE 80\n",
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(list(FILES.items()), "path string, content string")


def test_symbols(files):
    got = {(r.path, r.kind, r.name) for r in extract.symbols(files).collect()}
    assert {("a/main.rs", "Module", "x"), ("a/main.rs", "Struct", "Point"), ("a/main.rs", "Enum", "Kind"), ("a/main.rs", "Function", "run"), ("a/main.rs", "Import", "std::io")} <= got
    assert {("b/app.ts", "Class", "Shop"), ("b/app.ts", "Import", "lib"), ("c/api.py", "Class", "Item"), ("c/api.py", "Function", "get"), ("d/q.sql", "Table", "shop.items")} <= got
    assert {("Dockerfile", "Image", "python:3"), ("Dockerfile", "Port", "80")} <= got


def test_calls_stay_in_the_file_and_leave_out_self_calls(files):
    assert [tuple(r) for r in extract.call_edges(files, extract.symbols(files)).collect()] == [("a/main.rs", "run", "load", 8500)]


def test_routes_messages_and_data(files):
    assert {(r.framework, r.method, r.route) for r in extract.routes(files).collect()} == {("nest", "GET", "items/:id"), ("express", "POST", "/orders"), ("fastapi", "GET", "/items/{id}")}
    assert {(r.technology, r.role, r.name) for r in extract.messages(files).collect()} == {("socketio", "consumer", "joined")}
    assert {(r.operation, r.name) for r in extract.data_access(files).collect() if r.path == "d/q.sql"} == {("write", "shop.items"), ("read", "other")}
    assert [(r.path, r.url) for r in extract.http_clients(files).collect()] == [("b/app.ts", "/api/users")]


def test_settings_are_redacted(files):
    assert {(r.key, r.value) for r in extract.settings(files).collect()} == {("host", "example"), ("api_key", "[REDACTED]")}


def test_scopes(files):
    hit = lambda scope: {r.path for r in files.filter(extract.scope_predicate(scope)).collect()}
    assert hit("glob:**/*.rs") == {"a/main.rs"} and hit("glob:*") == {"Dockerfile"} and hit("path:a") == {"a/main.rs"} and hit("language:python") == {"c/api.py"}
    assert hit("project") == set(FILES)
    for bad in ("path:../x", "nothing", "color:red"):
        with pytest.raises(ValueError):
            extract.scope_predicate(bad)


def test_unresolved_matches_keep_their_left_node(spark):
    m = spark.createDataFrame([(1, "p", 2, "q", "http", 9000), (3, "p", None, None, "http", 3000)], "left_id int, left_project string, right_id int, right_project string, kind string, confidence int")
    nodes, edges = archgraph.build(m)
    assert {r.node for r in nodes.collect()} == {1, 2, 3}
    assert {(r.src, r.kind) for r in edges.collect()} == {(1, "http"), (3, "unresolved")}
    assert {r.level: r.n for r in archgraph.histogram(edges).collect()} == {"high": 1, "low": 1}
    assert archgraph.isolated(nodes.select("project").distinct(), nodes, edges.filter(F.col("kind") == "none")).count() == 2
