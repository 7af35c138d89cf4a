"""Near copies by exact Jaccard similarity of word-shingle sets, none of them missed.

A text's set holds the hashes of its distinct shingles. Three steps link sets
whose similarity is ``percent`` or more; every link is checked on the two sets.

1. SimHash: the fingerprints of the sets' texts are linked by the
   segment-popcount grid of ``simhash`` and each set is compared with the least
   set of its fingerprint. At a similarity of 0.8 fingerprints may differ in ten
   bits and more, which no grid of useful size covers, so this finds the closest
   copies and leaves the rest to
2. hubs: if two sets have the similarity s, they share at least s of the larger
   one, so that the first n - ceil(s * n) + 1 members of each, in one order of
   all shingles, have a member in common. In a group with such a member in
   common each set is compared with a few, its hubs: those whose members the
   most other sets have. This joins large groups of copies in a linear number of
   pairs.
3. Only sets that are still apart are then compared with one another, of each two
   components the closest pair first.

A pair is made only if the sizes and the place of the shared member allow s, and
in step 3 a sketch too. The sketch has a bit for each of 256 classes of hashes: whether the set
has an odd number of them. Two sketches never differ in more bits than the sets
in members, so no pair at s or more is left out.

Frequent shingles come last in the order, which keeps common lines out of the
prefixes; they are told from a sample of the texts, and which ones are told
changes the work and not the result. Of a pair the prefixes tell how much the
sets can share at most, which leaves few pairs whose whole sets are needed.

Scale: equal sets collapse first (map-side minima), so copies cost nothing
beyond their own row. What is shuffled is the prefixes, a fifth of the sets.
Pairs, which may grow faster than the texts, take prefixes and sets along in
blocks of a bounded size, so that the disk they need does not grow with them.

Edge cases: null and empty texts have the same, empty set. A text shorter than
a shingle has one shingle of all its words.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import discard, steps, written
from quarry.llm.components import components
from quarry.llm.simhash import fingerprint_links, majority, shingle_hashes

#: One text in so many tells the frequent shingles: at most MOST of them, in at least one of 2,000 sampled texts and 8 texts.
SAMPLE, MOST, LEAST = 16, 65_536, 8
SKETCH = [f"b{k}" for k in range(4)]
#: Hubs of a group; the exact step follows whatever they link.
HUBS = 3
#: Rows, of a few numbers each, up to which a side of a join is broadcast once they are counted.
FEW = 2_000_000
#: Pairs are verified in blocks whose first sets have that share of all sets' members: all of them by prefixes, which are a fifth, an eighth by whole sets.
PREFIX_SHARE, MEMBER_SHARE = 1, 8
#: Members, of 8 bytes each, for which no block is made smaller.
BLOCK = 4_000_000


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """The sorted distinct hashes, of 63 bits."""
    return np.unique(hashes >> np.uint64(1))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """For each of 256 classes of hashes, whether their number is odd: 64 bits in each of 4 integers."""
    odd = np.bincount((hashes >> np.uint64(40)).astype(np.int64) & 255, minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def set_key(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets' Jaccard similarity is percent / 100 or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * (100 + percent) >= percent * (len(a) + len(b))


def may_be_similar(a: np.ndarray, b: np.ndarray, na: int, nb: int, percent: int) -> bool:
    """Whether sets of na and nb members that begin with the prefixes a and b can be similar."""
    if not len(a) or not len(b):
        return na == nb
    last = min(a[-1], b[-1])  # up to here both sets are known
    i, j = np.searchsorted(a, last, "right"), np.searchsorted(b, last, "right")
    both = len(np.intersect1d(a[:i], b[:j], assume_unique=True)) + min(na - i, nb - j)
    return both * (100 + percent) >= percent * (na + nb)


def frequent_shingles(docs: DataFrame, shingle: int) -> np.ndarray:
    sample = docs.select("text").filter(F.xxhash64("text") % SAMPLE == 0)

    def run(batches):
        for b in steps(batches, 0):
            keys = [shingle_set(shingle_hashes(x.as_py(), shingle)) for x in b.column(0).cast(pa.binary())]
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64))], ["key"])

    counts = sample.mapInArrow(run, "key long").groupBy("key").count()
    least = max(LEAST, sample.count() // 2000)
    often = written(counts.filter(F.col("count") >= least), "frequent")
    rows = often.orderBy(F.desc("count"), "key").limit(MOST).collect()
    return np.sort(np.array([r.key for r in rows], np.int64).view(np.uint64))


def text_sets(docs: DataFrame, shingle: int, percent: int, frequent) -> DataFrame:
    """doc_id, k1, k2, set (its key), fp, n and prefix of every row of docs (doc_id, k1, k2, text).

    A prefix holds hashes in order, with the top bit set in those of frequent shingles.
    """

    def run(batches):
        last = frequent.value
        for b in steps(batches, 3):
            keys, fps, sizes, prefixes, sketches = [], [], [], [], []
            for x in b.column(3).cast(pa.binary()):
                hashes = shingle_hashes(x.as_py(), shingle)
                s = shingle_set(hashes)
                n = len(s)
                often = np.isin(s, last, assume_unique=True) if len(last) else np.zeros(n, bool)
                keys.append(set_key(s))
                fps.append(majority(hashes))
                sizes.append(n)
                ordered = np.sort(s | (often.astype(np.uint64) << np.uint64(63)))
                prefixes.append(ordered[: n + (-percent * n) // 100 + 1].view(np.int64))
                sketches.append(sketch(s))
            ends = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            values = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            told = np.array(sketches, np.int64).reshape(-1, len(SKETCH))
            cols = [*b.columns[:3], pa.array(keys, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(ends), pa.array(values)), *(pa.array(x) for x in told.T.copy())], ["doc_id", "k1", "k2", "set", "fp", "n", "prefix", *SKETCH])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "k1", "k2", "text").mapInArrow(run, f"doc_id {kind}, k1 long, k2 long, set binary, fp long, n int, prefix array<long>" + "".join(f", {c} long" for c in SKETCH))


def counted(df: DataFrame) -> DataFrame:
    """df, which is written, marked for broadcast if it has at most FEW rows."""
    return F.broadcast(df) if df.count() <= FEW else df


def members(docs: DataFrame, sets: DataFrame, shingle: int) -> DataFrame:
    """set and hashes (its members) for each of sets (set, k1, k2), whose keys name a row of docs that has it."""

    def run(batches):
        for b in steps(batches, 1):
            found = [shingle_set(shingle_hashes(x.as_py(), shingle)).tobytes() for x in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["set", "hashes"])

    return docs.join(sets.select("set", "k1", "k2"), ["k1", "k2"]).select("set", "text").mapInArrow(run, "set long, hashes binary").dropDuplicates(["set"])


def with_both(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """pairs (u, v) with columns of both sets."""
    side = lambda x: sets.select(F.col("set").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns))
    return pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", *(f"{c}_{x}" for c in columns for x in "uv"))


def kept_pairs(rows: DataFrame, fits) -> DataFrame:
    """u, v of the rows whose further values fit."""

    def run(batches):
        for b in batches:
            ok = [fits(*(x.as_py() if x.type == pa.binary() else x for x in row)) for row in zip(*b.columns[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return rows.mapInArrow(run, "u long, v long")


def blocks(pairs: DataFrame, sets: DataFrame, share: int) -> int:
    """So many parts that the first sets of a part's pairs have at most about 1 / share of the members of all sets, or BLOCK."""
    all_n = sets.agg(F.sum("n").alias("n")).first().n or 0
    their_n = pairs.join(sets.select(F.col("set").alias("u"), "n"), "u").agg(F.sum("n").alias("n")).first().n or 0
    return max(1, -(-their_n // max(BLOCK, all_n // share)))


def in_blocks(pairs: DataFrame, count: int, body) -> DataFrame:
    """The union of body(part), which is written, over count parts of pairs: what one part shuffles goes before the next."""
    if count == 1:
        return body(pairs)
    return reduce(DataFrame.unionByName, [body(pairs.filter(F.pmod(F.xxhash64("u"), F.lit(count)) == k)) for k in range(count)])


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (u, v), which are written, whose sets are similar."""
    spark = docs.sparkSession
    array = lambda x: x.values.to_numpy().view(np.uint64)
    may = lambda a, b, m, n: may_be_similar(array(a), array(b), m.as_py(), n.as_py(), percent)
    are = lambda a, b: similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent)
    named = lambda part: counted(written(part.select(F.explode(F.array("u", "v")).alias("set")).distinct(), "named"))

    def by_prefix(part: DataFrame) -> DataFrame:
        names = named(part)
        out = written(kept_pairs(with_both(part, sets.join(names, "set", "left_semi"), "prefix", "n"), may), "pairs")
        discard(spark, names)
        return out

    def by_members(part: DataFrame) -> DataFrame:
        names = named(part)
        rows = counted(written(sets.select("set", "k1", "k2").join(names, "set", "left_semi"), "rows"))
        held = written(members(docs, rows, shingle), "members")
        out = written(kept_pairs(with_both(part, held, "hashes"), are), "links")
        discard(spark, names, rows, held)
        return out

    near = in_blocks(pairs, blocks(pairs, sets, PREFIX_SHARE), by_prefix)
    links = in_blocks(near, blocks(near, sets, MEMBER_SHARE), by_members)
    discard(spark, near)
    return links


def near_copies(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """set, root (the least set of its component) and least of each distinct set of docs (doc_id, k1, k2, text).

    k1 and k2 together name a row; least is the first of the set's rows: null (whether it has no id), doc_id, k1, k2.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, shingle))
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "k1", "k2")).alias("least")
    by_set = text_sets(docs, shingle, percent, frequent).groupBy("set").agg(first_row, *(F.first(c).alias(c) for c in ("fp", "n", "prefix", *SKETCH)))
    # From here on a set has a number, which is written with it once.
    sets = written(by_set.select(F.monotonically_increasing_id().alias("set"), "least", "least.k1", "least.k2", "fp", "n", "prefix", *SKETCH), "sets")

    # 1: sets whose fingerprints are equal or linked.
    heads = written(sets.groupBy("fp").agg(F.min("set").alias("v")), "heads")
    same = sets.join(heads, "fp").select(F.col("set").alias("u"), "v")
    linked = fingerprint_links(heads.select("fp")).select(F.col("u").alias("fp"), F.col("v").alias("fp2"))
    across = linked.join(heads.withColumnRenamed("v", "u"), "fp").join(heads.withColumnRenamed("fp", "fp2"), "fp2").select("u", "v")
    by_print = same.unionByName(across).filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))

    # 2: sets with a prefix shingle in common, each with the hub of that shingle; again with other hubs while too many are apart.
    cells = sets.select("set", "n", F.posexplode("prefix").alias("pos", "key"))
    shared = written(cells.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1"), "shared")
    met = written(cells.join(shared, "key"), "met")
    col = F.col
    most = F.least("a.pos", "b.pos") + F.least(col("a.n") - col("a.pos"), col("b.n") - col("b.pos"))
    sizes = F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * percent
    apart_at_least = sum((F.bit_count(col(f"a.{c}").bitwiseXOR(col(f"b.{c}"))) for c in SKETCH), F.lit(0))
    alike = apart_at_least * (100 + percent) <= (col("a.n") + col("b.n")) * (100 - percent)
    may = (col("a.set") != col("b.set")) & (col("a.root") != col("b.root")) & sizes & (most * (100 + percent) >= (col("a.n") + col("b.n")) * percent)
    pair = (F.greatest("a.set", "b.set").alias("u"), F.least("a.set", "b.set").alias("v"))
    start = met.withColumn("root", col("set"))
    first = F.row_number().over(Window.partitionBy("key").orderBy("order", "set"))
    hubs = start.join(met.groupBy("set").agg((-F.avg("k")).alias("order")), "set").withColumn("first", first).filter(F.col("first") <= HUBS)
    tried = written(start.alias("a").join(hubs.alias("b"), (col("a.key") == col("b.key")) & may).select(*pair).unionByName(by_print).distinct(), "pairs")
    links = verified(tried, docs, sets, shingle, percent)

    # 3: sets that have a shingle in common and are not connected yet.
    apart = met.join(components(links).withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    open_keys = apart.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b").select("key")
    apart_rows = written(apart.join(open_keys, "key", "left_semi"), "apart")
    apart = apart_rows.join(sets.select("set", *SKETCH), "set")
    both = apart.alias("a").join(apart.alias("b"), (col("a.key") == col("b.key")) & (col("a.set") > col("b.set")) & may & alike)
    rest = both.select(*pair, col("a.root").alias("ru"), col("b.root").alias("rv"), apart_at_least.alias("far")).distinct()
    rest = written(rest.join(tried, ["u", "v"], "left_anti"), "pairs")
    # Of each two components the closest pair first: what that connects needs no other pair.
    by_root = [F.greatest("ru", "rv").alias("x"), F.least("ru", "rv").alias("y")]
    best = written(rest.groupBy(*by_root).agg(F.min(F.struct("far", "u", "v")).alias("p")).select("x", "y", "p.u", "p.v"), "best")
    discard(sets.sparkSession, met, shared, apart_rows)
    closest = verified(best.select("u", "v"), docs, sets, shingle, percent)
    merged = components(best.join(closest, ["u", "v"]).select(F.col("x").alias("u"), F.col("y").alias("v")))
    now = lambda c: merged.select(F.col("node").alias(c), F.col("root").alias(f"{c}_now"))
    rest = rest.join(now("ru"), "ru", "left").join(now("rv"), "rv", "left").filter(F.coalesce("ru_now", "ru") != F.coalesce("rv_now", "rv")).select("u", "v")
    rest = written(rest.join(best, ["u", "v"], "left_anti"), "pairs")
    roots = components(links.unionByName(closest).unionByName(verified(rest, docs, sets, shingle, percent)))
    return sets.join(roots.withColumnRenamed("node", "set"), "set", "left").select("set", F.coalesce("root", "set").alias("root"), "least")
