"""Personal data by bootstrapped contextual extraction, with built-in column functions only.

Four kinds of identifiers (email, ip, card, phone) are found by pattern and
check; they are the seeds. Every seed, every other token with a digit or an "@"
in it and every run of digit groups joined by the kinds' own separators is a
candidate: an instance (its text) under a lexical pattern (the two words before
it, however far, lower-cased, digits as 0). Candidates shorter than the shortest
identifier of any kind, ``min_token`` characters, are none. Patterns and
instances make a bipartite graph that is scored in turns, per kind:

* a pattern's confidence is the mean score of its distinct instances, with one
  instance of score 0 added, so that a pattern seen once is never trusted;
* an instance's score is 1 for a seed of the kind, 0 for a seed of another
  kind, and else the mean confidence of its patterns.

An instance that reaches ``min_confidence`` counts as a seed in the next turn, so
patterns may come to be trusted by what others found. After ``rounds`` turns,
patterns of at least ``min_support`` such instances and ``min_confidence`` reveal
the candidates under them that no seed covers: new spans of that kind. Seeds
always stay.

Patterns are written with possessive runs and look-behinds, so no text, however
long or odd, makes them back-track or recurse.

Scale: texts are scanned once, row by row; only candidates are shuffled.
Scores are sums over distinct (pattern, instance) edges, combined map-side, and
joined back to the edges; a pattern or instance of very many edges is on the
splittable side of its join.

Edge cases: null and empty texts have no spans. Rows with one doc_id but other
texts are kept apart by the text; repeated rows get equal results. A null doc_id
is a value like any other. Other columns are not carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import let, written

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)"
IP_PARTS = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"
GROUPS = r"(?<![A-Za-z0-9@._%+/-])\+?+\(?+[0-9]++\)?+(?:[\x20.-]?+\(?+[0-9]++\)?+)++(?![A-Za-z@])"
TOKEN = r"(?<![A-Za-z0-9@._%+/-])(?=[A-Za-z._%+/-]*+[0-9@])[A-Za-z0-9@._%+/-]++"
#: Characters before a candidate in which its two context words are sought first; more are taken where they are not there.
NEAR, FAR = 64, 4096


def luhn(digits: Column) -> Column:
    """True where the string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(a, k):
        d = F.substring(digits, n - k, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return a + F.when(k % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def passes(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(IP_PARTS)
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.length(digits).between(13, 19) & let(digits, luhn)


def found(text: Column, pattern: str, keep, tag: Column) -> Column:
    """Array of (kind, start, end, s) for the matches of pattern that keep accepts, by start.

    The text between matches gives their places: a match starts where the pieces
    and matches before it end. Places are code points, ends exclusive.
    """

    def placed(m: Column, gaps: Column) -> Column:
        none = F.array().cast("array<struct<kind:string,start:int,end:int,s:string>>")
        zero = F.struct(F.lit(0).alias("at"), none.alias("out"))

        def step(a, k):
            start = a["at"] + F.length(gaps[k])
            end = start + F.length(m[k])
            one = F.struct(tag.alias("kind"), start.alias("start"), end.alias("end"), m[k].alias("s"))
            return F.struct(end.alias("at"), F.when(keep(m[k]), F.array_append(a["out"], one)).otherwise(a["out"]).alias("out"))

        places = F.aggregate(F.sequence(F.lit(0), F.size(m) - 1), zero, step, lambda a: a["out"])
        return F.when(F.size(m) == 0, none).otherwise(places)

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(matches, lambda m: let(F.split(text, pattern, -1), lambda gaps: placed(m, gaps)))


def base_spans(text: Column) -> Column:
    """All seeds, by kind and then start."""
    none = F.array().cast("array<struct<kind:string,start:int,end:int,s:string>>")
    may = {"email": text.contains("@"), "ip": text.contains("."), "card": F.lit(True), "phone": text.contains("+")}
    return F.concat(*(F.when(may[k], found(text, PATTERNS[k], lambda m, k=k: passes(k, m), F.lit(k))).otherwise(none) for k in KINDS))


def context_of(text: Column, start: Column) -> Column:
    """The last two words before start, lower-cased, digits as 0."""
    last_two = lambda w: F.regexp_replace(F.array_join(F.slice(w, F.greatest(F.size(w) - 1, F.lit(1)), F.lit(2)), " "), "[0-9]", "0")

    def within(most: int | None, beyond):
        first = F.greatest(start - most, F.lit(0)) if most else F.lit(0)
        words = F.filter(F.split(F.lower(F.substring(text, first + 1, start - first)), r"[\x20\x09-\x0D]+"), lambda w: w != "")
        # The first word may be cut, so two whole ones need a third before them.
        return let(words, lambda w: F.when((first == 0) | (F.size(w) > 2), last_two(w)).otherwise(beyond()) if most else last_two(w))

    return within(NEAR, lambda: within(FAR, lambda: within(None, None)))


def scan(docs: DataFrame, min_token: int) -> DataFrame:
    """doc_id, key (a hash of the text), base spans and other candidates with their contexts."""
    t = F.col("t")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    rows = rows.select("doc_id", F.xxhash64("t").alias("key"), "t", base_spans(t).alias("base"))
    other = found(t, f"{GROUPS}|{TOKEN}", lambda m: F.length(m) >= min_token, F.lit(None).cast("string"))
    apart = lambda x, y: (x["end"] <= y["start"]) | (x["start"] >= y["end"])
    rows = rows.withColumn("other", F.filter(other, lambda x: F.forall("base", lambda y: apart(x, y))))
    seen = F.transform(
        F.concat("base", "other"),
        lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("instance"), context_of(t, x["start"]).alias("pattern")),
    )
    place = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    return rows.select("doc_id", "key", F.transform("base", place).alias("base"), seen.alias("seen"))


def score(edges: DataFrame, rounds: int, min_support: int, min_confidence: float) -> DataFrame:
    """pattern and kind for the patterns to be trusted. edges: distinct pattern, instance, kind (null if no seed)."""
    mine = [F.when(F.col("kind") == k, 1.0).when(F.col("kind").isNotNull(), 0.0) for k in KINDS]
    known = edges.select("pattern", "instance", "kind", *(m.alias(f"s_{k}") for m, k in zip(mine, KINDS, strict=True)))
    mean = [(F.sum(F.coalesce(f"s_{k}", F.lit(0.0))) / (F.count("*") + 1)).alias(f"c_{k}") for k in KINDS]
    support = [F.sum(F.when(F.coalesce(f"s_{k}", F.lit(0.0)) >= min_confidence, 1).otherwise(0)).alias(f"n_{k}") for k in KINDS]
    patterns = known.groupBy("pattern").agg(*mean, *support)
    for _ in range(rounds - 1):
        links = known.join(patterns.select("pattern", *(f"c_{k}" for k in KINDS)), "pattern")
        told = links.filter("kind is null").groupBy("instance").agg(*(F.avg(f"c_{k}").alias(f"t_{k}") for k in KINDS))
        scored = known.join(told, "instance", "left")
        sure = lambda k: F.when(F.col(f"t_{k}") >= min_confidence, 1.0).otherwise(F.col(f"t_{k}"))
        scored = scored.select("pattern", *(F.coalesce(f"s_{k}", sure(k), F.lit(0.0)).alias(f"s_{k}") for k in KINDS))
        patterns = written(scored.groupBy("pattern").agg(*mean, *support), "patterns")
    best = F.greatest(*(F.struct(F.col(f"c_{k}").alias("c"), F.lit(-i).alias("i"), F.col(f"n_{k}").alias("n"), F.lit(k).alias("kind")) for i, k in enumerate(KINDS)))
    trusted = patterns.select("pattern", best.alias("b")).filter((F.col("b.c") >= min_confidence) & (F.col("b.n") >= min_support))
    return trusted.select("pattern", F.col("b.kind").alias("kind"), F.col("b.c").alias("confidence"))


def extract(docs: DataFrame, rounds: int = 3, min_support: int = 3, min_confidence: float = 0.6, min_token: int = 5) -> DataFrame:
    """doc_id, key, base and spans (arrays of kind, start, end) of every row of docs (doc_id, text)."""
    rows = written(scan(docs, min_token), "candidates")
    seen = rows.select("doc_id", "key", F.explode("seen").alias("x")).select("doc_id", "key", "x.*").filter("pattern <> ''")
    edges = written(seen.select("pattern", "instance", "kind").distinct(), "edges")
    trusted = score(edges, rounds, min_support, min_confidence)
    fresh = seen.filter("kind is null").drop("kind").join(trusted, "pattern")
    added = fresh.groupBy("doc_id", "key").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))
    near = rows.select("doc_id", "key", "base").alias("r").join(added.alias("a"), F.expr("r.doc_id <=> a.doc_id and r.key = a.key"), "left")
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    both = near.select("r.doc_id", "r.key", "r.base", F.coalesce("a.added", none).alias("added"))
    order = lambda kind: F.sort_array(F.filter(F.concat("base", "added"), lambda x: x["kind"] == kind))
    return both.select("doc_id", "key", "base", F.concat(*(order(k) for k in KINDS)).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def masked(text: Column, spans: Column) -> Column:
    """text with each span (overlapping ones merged) replaced by its kind in square brackets."""
    places = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a, x):
        before = F.substring(text, a["at"] + 1, x["start"] - a["at"])
        put = F.array_append(a["out"], F.concat(before, F.lit("["), F.upper(x["kind"]), F.lit("]")))
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.when(x["start"] >= a["at"], put).otherwise(a["out"]).alias("out"))

    tail = lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(places, zero, step, tail))


def pii_stage(docs: DataFrame) -> DataFrame:
    """docs with every span masked; the input's columns, whatever their names, n_chars brought up to date."""
    spans = extract(docs).groupBy("doc_id", "key").agg(F.first("spans").alias("spans"))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    near = keyed.alias("d").join(spans.alias("s"), F.expr("d.doc_id <=> s.doc_id and d.key = s.key"))
    text = F.when(F.col("row.text").isNotNull(), masked(F.col("row.text"), F.col("spans")))
    out = near.select("row", text.alias("new_text"))
    row = F.col("row").withField("text", F.col("new_text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("new_text").cast(docs.schema["n_chars"].dataType))
    return out.select(row.alias("row")).select("row.*")
