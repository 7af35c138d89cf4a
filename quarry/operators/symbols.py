"""Symbol tables (id, project, path, start_line, name, kind, visibility, snippet): lookup, ranked search, exposure, nesting.

Null names never match; empty tables give no rows; ties are broken by name and id.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.search import first_per_key, symbol_score

#: Kinds that other programs can address, and marks of public symbols.
ADDRESSABLE = ("Route", "Endpoint", "Interface")
PUBLIC = ("pub", "public")

#: What an edge's origin adds to the score of a step along it.
PROVENANCE = {"ast": 100, "user": 90, "import": 80, "heuristic": 40, "semantic": 0}


def find(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.filter(F.col("name") == name)


def listed(symbols: DataFrame, most: int) -> DataFrame:
    """The first symbols by name, then id."""
    return symbols.orderBy("name", "id").limit(most)


def by_ids(symbols: DataFrame, ids: DataFrame) -> DataFrame:
    """The symbols of a table of ids (id), each once however often it is asked for; one join instead of lookups."""
    return symbols.join(ids.select("id"), "id", "left_semi")


def ranked(rows: DataFrame, query: str, intent: str, bm25: Column | None = None, distance: Column | None = None) -> DataFrame:
    """rows with their score, best first, then by name and id."""
    none = F.lit(None).cast("double")
    score = symbol_score(F.lit(intent), F.col("name"), F.lit(query), none if bm25 is None else bm25, F.lit(0) if distance is None else distance, F.col("kind"))
    return rows.withColumn("score", score).orderBy(F.desc("score"), "name", "id")


def search_hits(hits: DataFrame, symbols: DataFrame, query: str, intent: str, most: int) -> DataFrame:
    """The best ``most`` symbols of text hits (id, bm25, at: lower is better); of a symbol's hits the first counts."""
    first = first_per_key(hits.select("id", "bm25", "at"), "id", "bm25", "at")
    return ranked(first.join(symbols, "id"), query, intent, F.col("bm25")).limit(most)


def dedupe_ranked(rows: DataFrame) -> DataFrame:
    """One row per id: the one of greatest score, then of least distance, then by name."""
    return first_per_key(rows, "id", F.desc("score"), "distance", "name")


def module(path: Column) -> Column:
    """The folder of a path; empty without one."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def exposed(visibility: Column, kind: Column, snippet: Column) -> Column:
    """Whether a symbol can be used from outside: public, addressable, or a method whose first line says so."""
    first = F.coalesce(F.element_at(F.split(F.coalesce(snippet, F.lit("")), "\n"), 1), F.lit(""))
    return F.coalesce(visibility.isin(*PUBLIC), F.lit(False)) | F.coalesce(kind.isin(*ADDRESSABLE), F.lit(False)) | (F.coalesce(kind == "Method", F.lit(False)) & first.contains("pub "))


def traversal_score(confidence: Column, provenance: Column, distance: Column) -> Column:
    """Confidence plus what the origin adds (0 if unknown) less the distance."""
    table = F.create_map(*(F.lit(x) for kv in PROVENANCE.items() for x in kv))
    return (confidence + F.coalesce(F.element_at(table, provenance), F.lit(0)) - distance).cast("bigint")


def _enclosing(batches):
    """id, src, width of symbols (path, start, end, id) that come by path and start, then falling end and rising id.

    ``ends`` and ``best`` hold, by rising end, the ranges so far of which no other reaches as far and is better:
    (width, -id) rises with the end, so the first that reaches far enough is the best.
    """
    path, now, last, ends, best = None, None, None, [], []
    for b in batches:
        out: list[list] = [[], [], []]
        for p, start, end, k in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
            if p != path:
                path, now, last, ends, best = p, None, None, [], []
            if (start, end) != now:
                now, last, held = (start, end), None, None  # last: the greatest lesser id of this range; held: its other encloser
                at = bisect_left(ends, end)
                if at < len(ends):
                    held = best[at]
            elif before != k:
                last = before
            before = k
            found = (end - start, -last) if last is not None else held
            if found is not None:
                for c, v in zip(out, (k, -found[1], found[0]), strict=True):
                    c.append(v)
            mine, to = (end - start, -k), bisect_left(ends, end)
            if to < len(ends) and best[to] <= mine:
                continue
            at = to + (to < len(ends) and ends[to] == end)
            while to and best[to - 1] >= mine:
                to -= 1
            ends[to:at], best[to:at] = [end], [mine]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["id", "src", "width"])


def contains_edges(symbols: DataFrame) -> DataFrame:
    """src, dst, confidence: each symbol (id, path, start, end; whole numbers but the path) and the smallest other range of its file that encloses it.

    Ranges are compared within a file only. Of equal ranges the one of smaller id encloses the other.
    One sorted pass over each file; no pairs are formed.
    """
    whole = (F.col(c).cast("bigint").alias(c) for c in ("start", "end", "id"))
    rows = symbols.select("path", *whole).dropna()
    dealt = rows.repartition("path").sortWithinPartitions("path", "start", F.desc("end"), "id")
    best = dealt.mapInArrow(_enclosing, "id long, src long, width long").groupBy("id").agg(F.min_by("src", F.struct(F.col("width"), -F.col("src"))).alias("src"))
    return best.select("src", F.col("id").alias("dst"), F.lit(10_000).cast("bigint").alias("confidence"))
