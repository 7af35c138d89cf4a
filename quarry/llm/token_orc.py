"""Token ids in ORC: integer run-length encoding, row indexes, Bloom filters on document ids.

Documents are dealt out by ranges of doc_id, encoded, ended by an end id and
written as ORC files in ascending order of doc_id, a folder for each range.
Spark's ORC writer keeps the ids in stripes with run-length encoded integers, a
row index for each ``row_stride`` rows and a Bloom filter on doc_id, so a reader
skips files, stripes and row groups by id, and splits files at stripes.

Reading back, each document's size and checksum come from the decoded column
where it lies. Offsets take two levels: sums per range (one row a file, so the
driver sees as many rows as there are ranges), then a running sum within each
range, whose rows are bounded by the range's share of the documents.

Scale: one shuffle, of the texts by range. Range borders come from a quantile
sketch of the ids, so repeated ids in the hot spots of a skewed id space only
widen a single range. Ids of one document stand in one row.

Edge cases: null and empty texts have the end id only. Repeated ids stay
separate rows, in the order of their texts; null ids come first. An empty table
makes an empty file set and an empty result. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.bpe import WIDE_STEP, RankArrayBPE, byte_symbols, coder, read_spec
from quarry.llm.common import fresh_path, steps, written

END_ID = 2
ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(8 << 20),
    "orc.compress": "ZSTD",
}


class LibraryCoder(RankArrayBPE):
    """Codes each distinct word by the library's own model; words are cut as in the parent."""

    #: Some 200 bytes each. A step of a worker has about 150,000 distinct words, half of which come again.
    most_known = 500_000

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        super().__init__(spec)
        self.model = Tokenizer.from_str(spec).model
        self.symbols = byte_symbols()

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        symbols, tokens = self.symbols.__getitem__, self.model.tokenize
        return [array("I", [t.id for t in tokens("".join(map(symbols, w)))]).tobytes() for w in words]


def with_range(docs: DataFrame, ranges: int) -> DataFrame:
    """docs with part, the number of the doc_id range of each row; no shuffle."""
    cuts = docs.select(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)] or [0.5], 10_000).alias("q")).first().q or []
    cuts = sorted(set(cuts)) if ranges > 1 else []
    part = F.lit(0)
    # A balanced tree of comparisons: logarithmic in the number of cuts.
    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") <= F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    if cuts:
        part = F.when(F.col("doc_id").isNull(), 0).otherwise(tree(0, len(cuts)))
    return docs.withColumn("part", part)


def encode_ids(docs: DataFrame, path: str | None, end_id: int) -> DataFrame:
    spec = read_spec(docs.sparkSession, path)
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], np.uint32).tobytes()

    def run(batches):
        code = coder(spec, LibraryCoder)
        for b in steps(batches, 2, WIDE_STEP):
            ids, sizes, _ = code.encode(b.column(2), False)
            ends = np.cumsum(sizes + 1)  # an end id after each document
            flat = np.full(len(ids) + len(sizes), end_id, np.int32)
            inner = np.ones(len(flat), bool)
            inner[ends - 1] = False
            flat[inner] = ids.view(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["part", "doc_id", "ids"])

    return docs.select("part", "doc_id", "text").mapInArrow(run, f"part int, doc_id {kind}, ids array<int>")


def write_ids(docs: DataFrame, out: str, path: str | None = None, end_id: int = END_ID, ranges: int | None = None) -> None:
    """Write docs (doc_id, text) as ORC files under out, in ascending order of doc_id, a folder part=k for each range."""
    ranges = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = with_range(docs.select("doc_id", "text"), ranges)
    dealt = parted.repartitionById(ranges, "part").sortWithinPartitions("part", "doc_id", "text")
    encode_ids(dealt, path, end_id).write.partitionBy("part").options(**ORC_OPTIONS).orc(out)


def read_ids(spark: SparkSession, out: str, kind: str = "bigint") -> DataFrame:
    return spark.read.schema(f"doc_id {kind}, ids array<int>, part int").orc(out)


def summarize_ids(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in files of write_ids."""
    kind = files.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            ids = b.column(2)
            flat, offsets = ids.flatten(), np.asarray(pc.cumulative_sum(pc.list_value_length(ids)))
            data = memoryview(np.ascontiguousarray(flat.to_numpy(zero_copy_only=False)).view("<u4")).cast("B") if len(flat) else b""
            ends = [0, *offsets.tolist()]
            sums = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pc.cast(pc.list_value_length(ids), pa.int64()), pa.array(sums, pa.int64())], ["part", "doc_id", "n_tokens", "ids_crc32"])

    sizes = written(files.select("part", "doc_id", "ids").mapInArrow(run, f"part int, doc_id {kind}, n_tokens long, ids_crc32 long"), "id-sizes")
    totals = sorted(sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before, at = {}, 0
    for part, n in totals:
        before[part] = at
        at += n
    base = F.element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), F.col("part")) if before else F.lit(0)
    order = Window.partitionBy("part").orderBy("doc_id", "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    start = base.cast("long") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0))
    return sizes.select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")


def find_document(files: DataFrame, doc_id: int) -> DataFrame:
    """The rows of one document; the comparison reaches the files' statistics and Bloom filters."""
    return files.filter(F.col("doc_id") == F.lit(doc_id)).select("doc_id", "ids")


def store_and_read(docs: DataFrame, path: str | None = None) -> DataFrame:
    out = fresh_path(docs.sparkSession, "token-ids")
    write_ids(docs, out, path)
    return summarize_ids(read_ids(docs.sparkSession, out, docs.schema["doc_id"].dataType.simpleString()))
