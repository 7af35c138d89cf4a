"""Full-text, vector and hybrid search as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import tokenize
from quarry.functions.vector import cosine

K1, B = 1.2, 0.75


def inverted_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf, len: map-side counts of each term in each document."""
    tokens = docs.select(key, tokenize(F.col(text)).alias("t")).select(key, F.size("t").alias("len"), F.explode("t").alias("term"))
    return tokens.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def bm25(docs: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """key, score (BM25, higher is better) and n_terms for documents with any term.

    The terms are filtered before anything is shuffled; corpus size and mean length
    come from one aggregate, document frequencies from the filtered rows.
    """
    terms = sorted({t.lower() for t in terms})
    tokens = docs.select(key, tokenize(F.col(text)).alias("t"))
    sizes = tokens.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("mean")).first()
    tf = lambda w: F.size(F.filter("t", lambda x: x == w))
    # A token stands in the lower-cased text as it is, so a plain search spares most texts the cutting.
    low, may = F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(False)
    for w in terms:
        may = may | low.contains(w)
    hits = docs.filter(may).select(key, tokenize(F.col(text)).alias("t")).select(
        key, F.size("t").alias("len"), F.explode(F.array(*(F.struct(F.lit(w).alias("term"), tf(w).alias("tf")) for w in terms))).alias("x")
    ).select(key, "len", "x.*").filter("tf > 0")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.lit(sizes.n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(sizes.mean)))
    return hits.join(F.broadcast(df), "term").groupBy(key).agg(F.sum(part).alias("score"), F.count("*").alias("n_terms"))


def top(df: DataFrame, n: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(n)


def vector_search(vectors: DataFrame, query: list[float], key: str, vector: str, n: int, least: float | None = None) -> DataFrame:
    """key and score of the n nearest rows by cosine; a total order by key breaks ties."""
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors.withColumn("score", cosine(F.col(vector), q))
    if least is not None:
        scored = scored.filter(F.col("score") >= least)
    return scored.orderBy(F.desc("score"), key).limit(n)


def lexical_overlap(terms: Column, tokens: Column, text: Column, path: Column, phrase: Column) -> Column:
    """Share of the query's terms among the tokens, plus 0.15 for the phrase in the text and 0.10 in the path, at most 1."""
    hit = F.size(F.filter(terms, lambda t: F.array_contains(tokens, t)))
    base = F.when(F.size(terms) == 0, 0.0).otherwise(hit / F.size(terms))
    return F.least(F.lit(1.0), base + F.when(F.lower(text).contains(phrase), 0.15).otherwise(0.0) + F.when(F.lower(path).contains(phrase), 0.10).otherwise(0.0))


def hybrid(lexical: DataFrame, vector: DataFrame, key: str, n: int, weights=(0.4, 0.5, 0.1)) -> DataFrame:
    """Merge two candidate lists (key, score, meta) into one ranking by the weighted, clamped score."""
    total = sum(weights)
    wl, wv, wm = (w / total for w in weights)
    both = lexical.select(key, F.col("score").alias("lex"), F.lit(0.0).alias("vec"), "meta").unionByName(vector.select(key, F.lit(0.0).alias("lex"), F.col("score").alias("vec"), "meta"))
    merged = both.groupBy(key).agg(F.max("lex").alias("lexical"), F.max("vec").alias("vector"), F.max("meta").alias("meta"))
    final = F.greatest(F.lit(0.0), F.least(F.lit(1.0), wl * F.col("lexical") + wv * F.col("vector") + wm * F.col("meta")))
    return merged.withColumn("final", final).orderBy(F.desc("final"), F.desc("vector"), F.desc("lexical"), key).limit(n)


#: Per intent, multipliers of the exact, BM25 and distance weights, and the kind and provenance weights.
PROFILES = {
    "symbol_lookup": (12, 3, 1, 80, 20), "code_search": (4, 10, 1, 20, 20), "test": (4, 7, 1, 140, 20), "callers": (3, 2, 4, 30, 80), "callees": (3, 2, 4, 30, 80),
    "trace": (3, 2, 4, 30, 80), "impact": (3, 2, 3, 60, 80), "pack": (6, 6, 2, 50, 40), "explanation": (6, 6, 2, 50, 40),
}
EXACT, BM25_WEIGHT, PROXIMITY = 100, 80, 60


def profile_weight(intent: Column, k: int) -> Column:
    return F.element_at(F.create_map(*(x for name, row in PROFILES.items() for x in (F.lit(name), F.lit(row[k])))), intent)


def symbol_score(intent: Column, name: Column, query: Column, score: Column, distance: Column, kind: Column) -> Column:
    """Exact, BM25, distance, kind and provenance parts of a symbol's rank."""
    exact = profile_weight(intent, 0) * EXACT
    part = F.when(F.lower(name) == F.lower(query), exact).when(F.lower(name).contains(F.lower(query)), F.floor(exact / 2)).otherwise(0)
    text = F.when(score.isNull(), 0).otherwise(profile_weight(intent, 1) * BM25_WEIGHT + F.abs(score * 100).cast("bigint"))
    near = F.when(distance > 0, F.floor(profile_weight(intent, 2) * PROXIMITY / distance)).otherwise(0)
    w = profile_weight(intent, 3)
    full = ((intent == "test") & (kind == "Test")) | ((intent == "symbol_lookup") & kind.isin("Function", "Method", "Struct")) | (intent.isin("callers", "callees") & kind.isin("Function", "Method"))
    kinds = F.when(full, w).when(kind.isin("Function", "Method"), F.floor(w / 2)).otherwise(0)
    return (part + text + near + kinds + profile_weight(intent, 4)).cast("bigint")


def first_per_key(df: DataFrame, key: str, *order) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


#: Kinds of chunks that stand for a fact of a domain, and the boosts of a candidate's attributes.
DOMAIN_CHUNKS = ("route_chunk", "component_chunk", "data_access_chunk", "realtime_chunk", "messaging_chunk", "infrastructure_chunk")
BOOSTS = {"language_match": 0.20, "framework_match": 0.20, "source_kind_match": 0.20, "symbol_chunk": 0.10, "source_specific_terms": 0.10, "compact_chunk": 0.05, "path_term_match": 0.10}
MOST_RESULTS, COMPACT_BYTES = 100, 2000


def validate_request(query: str, limit: int, weights: tuple, least: float | None = None) -> None:
    """Raise for an empty query, a limit above 100, weights outside 0..1 or all zero, and a least score outside 0..1."""
    inside = lambda x: isinstance(x, (int, float)) and 0 <= x <= 1  # noqa: E731  (NaN and infinity are not)
    if not query.strip():
        raise ValueError("the query is empty")
    if limit > MOST_RESULTS:
        raise ValueError(f"at most {MOST_RESULTS} results")
    if not all(map(inside, weights)) or sum(weights) <= 0:
        raise ValueError("weights lie between 0 and 1 and are not all 0")
    if least is not None and not inside(least):
        raise ValueError("the least score lies between 0 and 1")


def warnings_of(n_vectors: int, failed: bool) -> list[str]:
    """Why a hybrid ranking rests on text alone."""
    return ["vector_search_failed"] if failed else ["no_vectors"] if n_vectors == 0 else []


def with_metadata(rows: DataFrame, terms: list[str], wanted: dict[str, str]) -> DataFrame:
    """rows (text, path, source_kind and what is wanted) with matched (terms in text or path), boosts (their names) and meta (their sum, at most 1).

    An attribute that nobody asked for gives no boost; a null one matches nothing.
    """
    asked = F.array(*map(F.lit, terms)).cast("array<string>")
    path = tokenize(F.coalesce("path", F.lit("")))
    out = rows.withColumn("_p", path).withColumn("matched", F.filter(asked, lambda t: F.array_contains(tokenize(F.coalesce("text", F.lit(""))), t) | F.array_contains("_p", t)))
    same = {f"{k}_match": F.coalesce(F.col(k) == v, F.lit(False)) for k, v in wanted.items()}
    tests = same | {
        "symbol_chunk": F.col("source_kind") == "symbol_chunk", "source_specific_terms": F.col("source_kind").isin(*DOMAIN_CHUNKS) & (F.size("matched") > 0),
        "compact_chunk": F.octet_length(F.coalesce("text", F.lit(""))) <= COMPACT_BYTES, "path_term_match": F.arrays_overlap(asked, F.col("_p")),
    }
    named = {k: F.coalesce(tests[k], F.lit(False)) for k in BOOSTS if k in tests}
    total = sum((F.when(t, BOOSTS[k]).otherwise(0.0) for k, t in named.items()), F.lit(0.0))
    return out.withColumns({"boosts": F.array_compact(F.array(*(F.when(t, k) for k, t in named.items()))), "meta": F.least(F.lit(1.0), total)}).drop("_p")


def wanted_only(rows: DataFrame, wanted: dict[str, str], prefix: str | None = None) -> DataFrame:
    """rows with the wanted attributes and paths that start with prefix; nulls fail."""
    for k, v in wanted.items():
        rows = rows.filter(F.col(k) == v)
    return rows if prefix is None else rows.filter(F.col("path").startswith(prefix))


#: Shares of an answer's quality.
SHARES = {"files": 0.30, "symbols": 0.20, "kinds": 0.20, "facts": 0.15, "tags": 0.10}


def answer_quality(parts: dict[str, tuple[Column, Column]], relevance: Column) -> Column:
    """Weighted shares of (hits, expected) and 0.05 of the top results' relevance, in 0..1. Nothing expected counts as all found, but for files."""
    share = lambda name: F.when(parts[name][1] == 0, 0.0 if name == "files" else 1.0).otherwise(F.try_divide(*parts[name]))
    total = sum((share(name) * worth for name, worth in SHARES.items()), 0.05 * relevance)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))
