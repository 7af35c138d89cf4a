"""Joins across projects: routes, messages, packages, contracts and infrastructure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.keys import package_name, pattern_fits, segments


#: Rows of one key that an expansion to pairs holds together.
BLOCK = 1024


def expanded(left: DataFrame, right: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The join of left and right by keys, where few keys may have nearly all rows of both.

    The right rows of a key are dealt by a hash of ``by`` into blocks of about BLOCK rows, and the left ones are sent to each block:
    a task holds a block at most, and the pairs of one key are made by many tasks.
    """
    blocks = right.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).alias("_blocks")).filter("_blocks > 1")
    told = lambda df: df.join(blocks, keys, "left")
    some = F.coalesce("_blocks", F.lit(1))
    a = told(left).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), some - 1)))
    b = told(right).withColumn("_block", F.pmod(F.xxhash64(by), some))
    return a.drop("_blocks").join(b.drop("_blocks"), [*keys, "_block"]).drop("_block")


def match_routes(clients: DataFrame, servers: DataFrame) -> DataFrame:
    """client_id, server_id, rule, confidence for clients and servers (id, project, method, path) of different projects.

    Equal paths join by path. Distinct paths meet distinct patterns by number of segments and the
    first literal segment, with the comparison of segments left over; what fits is then expanded to the
    clients and servers of one method. The first rule that
    holds counts: exact 9000, unknown method 6000, pattern 8000, other method 3000.
    """
    c = clients.select("client_id", F.col("project").alias("cp"), F.col("method").alias("cm"), F.col("path").alias("cpath"))
    s = servers.select("server_id", F.col("project").alias("sp"), F.col("method").alias("sm"), F.col("path").alias("spath"))
    same = expanded(c.withColumn("spath", F.col("cpath")), s, ["spath"], "server_id").filter("cp <> sp")
    exact, unknown = F.col("cm") == F.col("sm"), F.col("cm").isNull() | F.col("sm").isNull()
    rule = F.when(exact, "exact").when(unknown, "unknown_method").otherwise("other_method")
    equal = same.select("client_id", "server_id", rule.alias("rule"), F.when(exact, 9000).when(unknown, 6000).otherwise(3000).alias("confidence"))
    # A pattern meets a path by number of segments and its first literal segment with the place; so each pair meets once.
    placed = lambda path: F.transform(segments(F.col(path)), lambda x, i: F.struct(i.alias("at"), x.alias("s")))
    nowhere = F.struct(F.lit(-1).alias("at"), F.lit("").alias("s"))
    params = s.filter(F.col("spath").contains("{id}")).select("spath", "sm").distinct().withColumn("p", F.coalesce(F.get(F.filter(placed("spath"), lambda x: x["s"] != "{id}"), F.lit(0)), nowhere))
    params = params.select("sm", "spath", F.size(segments(F.col("spath"))).alias("sn"), "p.at", "p.s")
    paths = c.select("cpath", "cm").distinct().withColumn("p", F.explode(F.concat(placed("cpath"), F.array(nowhere)))).select("cm", "cpath", F.size(segments(F.col("cpath"))).alias("cn"), "p.at", "p.s")
    near = (F.col("cn") == F.col("sn")) & (F.col("cm") == F.col("sm")) & (paths["at"] == params["at"]) & (paths["s"] == params["s"]) & (F.col("cpath") != F.col("spath"))
    fit = paths.join(params, near).filter(pattern_fits(F.col("spath"), F.col("cpath"))).select("cpath", "cm", "spath", "sm")
    asked = c.join(fit, ["cpath", "cm"]).select("client_id", "cp", "spath", "sm")
    patterns = expanded(asked, s, ["spath", "sm"], "server_id").filter("cp <> sp").select("client_id", "server_id", F.lit("pattern").alias("rule"), F.lit(8000).alias("confidence"))
    return equal.unionByName(patterns)


def unmatched(clients: DataFrame, matches: DataFrame) -> DataFrame:
    return clients.join(matches, "client_id", "left_anti")


#: Confidence of the rules for messages.
MESSAGE_WORTH = {"exact": 9000, "compatible_kind": 9000, "unknown_broker": 6000, "conflicting_broker": 3000}


def _judged(rows: DataFrame) -> DataFrame:
    """rows (pb, pk, cb, ck) to which a rule applies, with the first that holds and its confidence."""
    fits = F.col("pk").isin("topic", "queue", "routing_key") & (F.col("ck") == "pattern") | F.col("ck").isin("topic", "queue", "routing_key") & (F.col("pk") == "pattern")
    unknown = (F.col("pb") == "unknown") | (F.col("cb") == "unknown")
    alike = (F.col("pk") == F.col("ck")) | fits
    rule = (
        F.when((F.col("pb") == F.col("cb")) & (F.col("pk") == F.col("ck")), "exact").when((F.col("pb") == F.col("cb")) & fits, "compatible_kind")
        .when(unknown & alike, "unknown_broker").when(alike, "conflicting_broker")
    )
    worth = F.create_map(*(F.lit(x) for kv in MESSAGE_WORTH.items() for x in kv))
    return rows.withColumn("rule", rule).filter("rule is not null").withColumn("confidence", F.element_at(worth, F.col("rule")))


def _side(rows: DataFrame, p: str, *more) -> DataFrame:
    return rows.select(F.col("project").alias(f"{p}p"), F.col("broker").alias(f"{p}b"), F.col("kind").alias(f"{p}k"), "name", *more)


def match_messages(producers: DataFrame, consumers: DataFrame, key: str) -> DataFrame:
    """Pairs of producers and consumers (key, project, broker, kind, name) of one name in different projects, with the first rule that holds."""
    p, c = _side(producers, "p", F.col(key).alias("producer")), _side(consumers, "c", F.col(key).alias("consumer"))
    return _judged(p.join(c, "name").filter("pp <> cp"))


def count_messages(producers: DataFrame, consumers: DataFrame) -> DataFrame:
    """name, rule, n, confidence: how many pairs of match_messages each rule has for each name.

    Rows of equal project, broker, kind and name are one row with a count each before they are joined, so no pair is formed.
    """
    p = _side(producers, "p").groupBy("pp", "pb", "pk", "name").agg(F.count("*").alias("pn"))
    c = _side(consumers, "c").groupBy("cp", "cb", "ck", "name").agg(F.count("*").alias("cn"))
    return _judged(p.join(c, "name").filter("pp <> cp")).groupBy("name", "rule").agg(F.sum(F.col("pn") * F.col("cn")).alias("n"), F.min("confidence").alias("confidence"))


def match_packages(consumers: DataFrame, providers: DataFrame) -> DataFrame:
    """consumer_id, provider_id (null: external), rule, confidence for entries (id, project, ecosystem, name); providers of other projects only."""
    norm = lambda df, p: df.select(F.col("id").alias(f"{p}_id"), F.col("project").alias(f"{p}_project"), "ecosystem", package_name(F.col("ecosystem"), F.col("name")).alias("key"), F.col("name").alias(f"{p}_name"))
    c, s = norm(consumers, "consumer"), norm(providers, "provider")
    hits = c.join(s.withColumn("pp", F.col("provider_project")), ["ecosystem", "key"]).filter("consumer_project <> pp").select("consumer_id", "provider_id", F.when(F.col("consumer_name") == F.col("provider_name"), "exact").otherwise("normalized").alias("rule"))
    external = c.join(hits, "consumer_id", "left_anti").select("consumer_id", F.lit(None).cast("bigint").alias("provider_id"), F.lit("external").alias("rule"))
    worth = F.create_map(*map(F.lit, ["exact", 9000, "normalized", 8000, "external", 6000]))
    return hits.unionByName(external).withColumn("confidence", F.element_at(worth, F.col("rule")))


GENERIC = ["user", "item", "data", "request", "response", "config", "result", "error"]


def match_contracts(entries: DataFrame) -> DataFrame:
    """Unordered pairs of entries (id, project, name, kind) with one name in different projects: generic name 3000, same kind 9000, else 6000."""
    a, b = entries.alias("a"), entries.alias("b")
    rows = a.join(b, (F.col("a.name") == F.col("b.name")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.project") != F.col("b.project")))
    worth = F.when(F.col("a.name").isin(GENERIC), 3000).when(F.col("a.kind") == F.col("b.kind"), 9000).otherwise(6000)
    return rows.select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"), F.col("a.name").alias("name"), worth.alias("confidence"))


def selector_matches(selectors: DataFrame, labelled: DataFrame) -> DataFrame:
    """selector_id, conv_id where all parts of a selector are among the labels.

    Joined by part and counted, so no pair without a common part is formed.
    """
    parts = selectors.select("selector_id", F.explode(F.array_distinct("selector")).alias("label"), F.size(F.array_distinct("selector")).alias("need"))
    have = labelled.select("conv_id", F.explode("labels").alias("label"))
    return parts.join(have, "label").groupBy("selector_id", "conv_id").agg(F.count("*").alias("n"), F.first("need").alias("need")).filter("n = need").select("selector_id", "conv_id")


def selector_counts(selectors: DataFrame, labelled: DataFrame) -> DataFrame:
    """selector_id, n, first_conv: how many rows of labelled (conv_id, labels) have all parts of each selector, and the first of them.

    Equal selectors and equal label sets are one row each before they are joined,
    so labels that nearly all rows carry cost no more than their distinct sets.
    """
    parts, have = selectors.select("selector_id", F.sort_array(F.array_distinct("selector")).alias("selector")), labelled.select("conv_id", F.sort_array("labels").alias("labels"))
    kinds = have.groupBy("labels").agg(F.count("*").alias("n"), F.min("conv_id").alias("first_conv"))
    asked = parts.select("selector").distinct()
    found = selector_matches(asked.select(F.col("selector").alias("selector_id"), "selector"), kinds.select(F.col("labels").alias("conv_id"), "labels"))
    told = found.join(kinds, F.col("conv_id") == F.col("labels")).groupBy(F.col("selector_id").alias("selector")).agg(F.sum("n").alias("n"), F.min("first_conv").alias("first_conv"))
    return parts.join(told, "selector").select("selector_id", "n", "first_conv")


def federated_collect(rows: DataFrame, project: str, order: list, each: int, most: int) -> DataFrame:
    """The first rows of each project, then the first of all."""
    w = Window.partitionBy(project).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= each).drop("_n").orderBy(*order).limit(most)


#: What tells servers, producers and consumers.
SERVERS = ("express", "nestjs", "fastify", "aspnetcore")
PRODUCING = (("outbound", "publish", "producer", "send"), ("producer", "publisher", "client", "emit", "send"))
CONSUMING = (("inbound", "consume", "consumer", "subscribe", "handler"), ("consumer", "subscriber", "handler", "eventpattern", "messagepattern"))


def _low(c):
    return F.lower(F.coalesce(c, F.lit("")))


def route_role(kind, framework):
    """server, page or unknown."""
    k, f = _low(kind), _low(framework)
    server = (k == "api") | f.isin(*SERVERS) | f.startswith("go_")
    return F.when(server, "server").when(k.isin("page", "route") | (f == "angular"), "page").otherwise("unknown")


def message_role(direction, kind):
    """producer, consumer or null; producing comes first."""
    d, k = _low(direction), _low(kind)
    fits = lambda sets: d.isin(*sets[0]) | k.isin(*sets[1])
    return F.when(fits(PRODUCING), "producer").when(fits(CONSUMING), "consumer")


def message_keys(rows: DataFrame, broker) -> DataFrame:
    """rows with broker, key_kind and key_name for each of topic, queue, pattern, routing_key, and exchange with routing_key; each once."""
    one = lambda kind, name: F.when(name.isNotNull(), F.struct(F.lit(kind).alias("key_kind"), name.alias("key_name")))
    pair = F.when(F.col("exchange").isNotNull() & F.col("routing_key").isNotNull(), F.concat_ws(":", "exchange", "routing_key"))
    every = [one(k, F.col(k)) for k in ("topic", "queue", "pattern", "routing_key")] + [one("exchange_routing_key", pair)]
    keys = F.array_distinct(F.array_compact(F.array(*every)))
    return rows.withColumn("broker", broker).withColumn("_k", F.explode(keys)).select("*", "_k.key_kind", "_k.key_name").drop("_k", "topic", "queue", "pattern", "routing_key", "exchange")


def infra_kind(technology, kind, resource):
    """What an infrastructure row stands for, by technology, kind and type of resource."""
    t, k, r = _low(technology), _low(kind), _low(resource)
    return (
        F.when((t == "docker_compose") & (k == "service"), "compose_service").when((t == "docker") & (k == "image"), "docker_image")
        .when((t == "kubernetes") & r.isin("service", "deployment", "configmap", "secret"), F.concat(F.lit("k8s_"), r)).when((t == "terraform") & (k == "module"), "terraform_module")
        .when(t.isin("terraform", "gcp", "gke"), "terraform_resource").when(k.contains("database") | (k == "db"), "database").when(k.contains("cache") | k.contains("redis"), "cache")
        .when(k.contains("queue"), "queue").otherwise("unknown")
    )


#: Sections of a package.json that name what a package needs.
NPM_SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")


def manifest_entries(files: DataFrame) -> DataFrame:
    """project, path, ecosystem, role, name of files (project, path, content): what manifests provide and what they need; each once.

    package.json, project files (.csproj), go.mod and Cargo.toml. Broken JSON has no entries.
    """
    low, text = F.lower("path"), F.coalesce("content", F.lit(""))
    found = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(1))
    entry = lambda role: (lambda n: F.struct(F.lit(role).alias("role"), n.alias("name")))
    both = lambda give, need: F.concat(F.transform(give, entry("provider")), F.transform(need, entry("consumer")))
    keys = lambda s: F.coalesce(F.map_keys(F.from_json(F.get_json_object(text, f"$.{s}"), "map<string,string>")), F.array().cast("array<string>"))
    npm = both(F.array_compact(F.array(F.get_json_object(text, "$.name"))), F.concat(*map(keys, NPM_SECTIONS)))
    own = F.coalesce(*(F.get(found(rf"<{t}>\s*([^<]*?)\s*</{t}>"), F.lit(0)) for t in ("PackageId", "AssemblyName", "RootNamespace")), F.regexp_extract("path", r"([^/\\\\]*?)(?:\.csproj)?$", 1))
    refs = F.transform(found(r'<ProjectReference[^>]*Include="([^"]*)"'), lambda x: F.regexp_extract(x, r"([^/\\\\]*?)(?:\.csproj)?$", 1))
    net = both(F.array(own), F.concat(found(r'<PackageReference[^>]*Include="([^"]*)"'), refs))
    block = F.when(text.contains("require ("), found(r"(?m)^[ \t]*([A-Za-z0-9][^\s/]*/\S*)")).otherwise(F.array().cast("array<string>"))
    go = both(found(r"(?m)^[ \t]*module[ \t]+(\S+)"), F.concat(found(r"(?m)^[ \t]*require[ \t]+([^\s(]\S*)"), block))
    section = lambda s: F.regexp_extract_all(text, F.lit(rf"(?s)(?:^|\n)\[{s}\][^\n]*\n(.*?)(?=\n\[|$)"), F.lit(1))
    names = lambda s, p: F.flatten(F.transform(section(s), lambda b: F.regexp_extract_all(b, F.lit(p), F.lit(1))))
    crate = both(names("package", r'(?m)^name\s*=\s*"([^"]*)"'), names(r"(?:dev-|build-)?dependencies", r"(?m)^([A-Za-z0-9_-]+)(?:\.workspace)?\s*="))
    kinds = {"npm": ("package.json", npm), "dotnet": (".csproj", net), "go": ("go.mod", go), "rust": ("cargo.toml", crate)}
    out = None
    for ecosystem, (end, entries) in kinds.items():
        rows = files.filter(low.endswith(end)).select("project", "path", F.lit(ecosystem).alias("ecosystem"), F.explode(F.array_distinct(entries)).alias("e")).select("project", "path", "ecosystem", "e.role", "e.name")
        out = rows if out is None else out.unionByName(rows)
    return out
