"""SimHash near-duplicates by segment-popcount embedding and a grid range-join.

A 64-bit fingerprint is cut into 16 segments of four bits; the vector of the
segments' bit counts embeds it in a grid. Flipping one bit moves one count by
one, so the Manhattan distance of two embeddings never exceeds the Hamming
distance of their fingerprints, and fingerprints that differ in at most two
bits meet in some grid cell at Manhattan distance one or less from both. The
range join therefore puts every distinct fingerprint into its own cell and the
cells one step away (at most 33 rows), and keeps the cells where two meet.

Within a surviving cell all pairs are never formed. A pair at two bits or less
has a common 64-bit value at most one bit from both; that value's embedding is
a cell where both meet. So members are dealt out by these exact values and
each is linked to the least fingerprint at the same value, which keeps all
connections with a linear number of links. The links are then checked exactly
by the bit count of the exclusive or.

Scale: equal fingerprints collapse before any candidate is made (map-side
minima), rows per distinct fingerprint are bounded by 33, and after the grid by
65. Components come from large-star/small-star rounds. The fingerprints are
joined back to the documents by fingerprint, where the other side has one row
each, so that a fingerprint of a third of all rows is split by the adaptive
skew join.

Edge cases: null and empty texts have no words and the fingerprint zero, linked
like any other. Texts of one or two words have one shingle. Rows with a null
doc_id keep their fingerprint and take part in links; component_id is the least
non-null doc_id of the component, or null if it has none. Repeated rows yield
repeated rows. Other columns, with whatever names, are not carried along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import LOWER, UPPER, discard, steps, written
from quarry.llm.components import components

SEGMENTS, BITS = 16, 4
_LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Shingles whose bits are counted at once; bounds the memory that a long text takes.
_BLOCK = 1 << 16


def shingle_hashes(text: bytes | None, shingle: int, seed: int = 42) -> np.ndarray:
    """The 64-bit hash of every shingle of a UTF-8 text, repeats included; of all words where they are fewer."""
    words = (text or b"").translate(_LOWERED).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(g, seed) for g in grams), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as an unsigned integer; 0 of none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        bits = np.unpackbits(hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a UTF-8 text, as an unsigned integer."""
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row."""

    def run(batches):
        for b in steps(batches, 1):
            texts = b.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(x.as_py(), shingle) for x in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _count_in(j: int) -> Column:
    return F.bit_count(F.shiftrightunsigned("fp", BITS * j).bitwiseAND(F.lit(15)))


def _packed(counts: list[Column]) -> Column:
    """The embedding as one long, four bits for each segment's count."""
    out = F.lit(0).cast("long")
    for j, c in enumerate(counts):
        out = out.bitwiseOR(F.shiftleft(c.cast("long"), BITS * j))
    return out


def grid_cells(fps: DataFrame) -> DataFrame:
    """fp, cell, seg, step: the own cell (step 0) and those one step away."""
    counts = [F.col(f"_c{j}") for j in range(SEGMENTS)]
    base = fps.select("fp", *(_count_in(j).alias(f"_c{j}") for j in range(SEGMENTS)))
    base = base.withColumn("_own", _packed(counts))
    none = F.lit(None).cast("struct<cell:bigint,seg:int,step:int>")
    cell = lambda c, j, step: F.struct(c.alias("cell"), F.lit(j).alias("seg"), F.lit(step).alias("step"))
    cells = [cell(F.col("_own"), 0, 0)]
    for j, c in enumerate(counts):
        one = F.lit(1 << (BITS * j)).cast("long")
        cells.append(F.when(c < BITS, cell(F.col("_own") + one, j, 1)).otherwise(none))
        cells.append(F.when(c > 0, cell(F.col("_own") - one, j, -1)).otherwise(none))
    out = base.select("fp", F.explode(F.array(*cells)).alias("x")).filter("x is not null")
    return out.select("fp", "x.cell", "x.seg", "x.step")


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """u, v: links that connect exactly the distinct fingerprints at two bits or less."""
    cells = grid_cells(fps)
    shared = cells.groupBy("cell").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a < b").select("cell")
    met = cells.join(shared, "cell", "left_semi")
    # Values one bit from fp whose embedding is the cell: flip a bit of seg that is unset (step 1) or set (step -1).
    at = [F.lit(b) + F.col("seg") * BITS for b in range(BITS)]
    bit = [F.call_function("shiftleft", F.lit(1).cast("long"), x) for x in at]
    fits = [((F.col("fp").bitwiseAND(b) == 0) & (F.col("step") == 1)) | ((F.col("fp").bitwiseAND(b) != 0) & (F.col("step") == -1)) for b in bit]
    values = F.array(F.when(F.col("step") == 0, F.col("fp")), *(F.when(f, F.col("fp").bitwiseXOR(b)) for f, b in zip(fits, bit, strict=True)))
    dealt = written(met.select("fp", F.explode(values).alias("value")).filter("value is not null"), "values")
    hubs = dealt.groupBy("value").agg(F.min("fp").alias("hub"), F.max("fp").alias("_b")).filter("hub < _b").select("value", "hub")
    pairs = dealt.join(hubs, "value").filter(F.col("fp") != F.col("hub"))
    return pairs.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= 2).select(F.col("fp").alias("u"), F.col("hub").alias("v")).distinct()


def with_classes(by_doc: DataFrame, classes: DataFrame) -> DataFrame:
    """by_doc with the component_id of classes (fp, n rows of it, component_id), by fp.

    The fingerprints that more rows have than a partition's even share are fewer
    than the partitions; their classes are broadcast. So no task gets more of
    one fingerprint than that share.
    """
    spark = by_doc.sparkSession
    share = classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n / int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = classes.filter(F.col("n") > share).select("fp", F.struct("component_id").alias("_class"))
    marked = by_doc.join(F.broadcast(hot), "fp", "left")
    rest = marked.filter("_class is null").drop("_class").join(classes.filter(F.col("n") <= share).select("fp", "component_id"), "fp")
    return marked.filter("_class is not null").select("doc_id", "fp", "_class.component_id").unionByName(rest.select("doc_id", "fp", "component_id"))


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp, fingerprint (hexadecimal) and component_id of every row of docs (doc_id, text)."""
    by_doc = written(fingerprints(docs, shingle), "fingerprints")
    fps = written(by_doc.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")), "distinct")
    roots = components(fingerprint_links(fps.select("fp")))
    in_component = fps.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = in_component.groupBy("root").agg(F.min("least_id").alias("_id"))
    linked = in_component.join(least, "root").select("fp", "_id")
    classes = written(fps.join(linked, "fp", "left").select("fp", "n", F.coalesce("_id", "least_id").alias("component_id")), "classes")
    return with_classes(by_doc, classes).select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def dedup_stage(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of texts linked by a five-word Jaccard similarity of 0.8 or more; all columns of docs, whatever their names.

    The row of the least doc_id stays (rows without an id come last); of rows
    that share that id and text, the least. Rows with one id and other texts are
    different documents.
    """
    from quarry.llm.near_copies import near_copies

    names = [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit("k2"), "doc_id").alias("k2")]
    groups = near_copies(docs.select("doc_id", "text", *names), shingle, percent)
    keep = groups.groupBy("root").agg(F.min("least").alias("least")).select("least.k1", "least.k2")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *names)
    kept = written(keep, "kept")
    discard(docs.sparkSession, groups)  # it reads written tables only
    return rows.join(kept, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.min("row").alias("row")).select("row.*")
