"""Benchmark decontamination by Wu-Manber search over words.

Texts become words: A-Z lower-cased, cut at every ASCII character that is no
letter or digit. The test strings are all windows of 13 words of the benchmark
items (an item of fewer words is one string). Per length of string, a shift
table over blocks of two words tells how far the search may jump, the bucket of
the block that ends a string selects the strings to try, and direct comparison
confirms each occurrence.

Scale: documents are read once and never shuffled; each is searched as a whole
where it lies. The test strings are the stated query set. They are read to the
driver in blocks of at most ``block_words`` item words and broadcast block by
block, so what one broadcast holds is bounded however large the benchmark is
(one item is never cut; its words are its own bound). With several blocks, a
task searches ``WIDE_STEP`` bytes of texts with one block before it loads the next.

Edge cases: a null or empty text has no words: no hit, no items, not
contaminated. A null benchmark text gives no string; equal items are all
reported; rows with equal item ids count as one item; null item ids match
words but are not reported. With an empty benchmark nothing is hit. Repeated
documents are searched alike. Extra columns of documents are not carried by
``find_contamination``; clashing names do no harm, as columns go by position.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import STEP, steps

_WORDS = bytes(
    ord(chr(c).lower()) if chr(c).isascii() and chr(c).isalpha() else c if c >= 0x80 or chr(c).isdigit() else 0x20
    for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words of a UTF-8 text. Multi-byte characters are word characters, byte for byte."""
    return (text or b"").translate(_WORDS).split()


class WuManber:
    """Search for many word strings of one length m."""

    def __init__(self, m: int, strings: dict[tuple, object]):
        self.m, self.block = m, min(2, m)
        self.jump = m - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[bytes, list]] = {}
        for words, value in strings.items():
            for end in range(self.block, m + 1):
                key = words[end - self.block : end]
                if m - end < self.shift.get(key, self.jump):
                    self.shift[key] = m - end
            # Within a bucket, the first word selects; the rest is compared directly.
            self.buckets.setdefault(words[m - self.block :], {}).setdefault(words[0], []).append((list(words), value))

    def search(self, text: list[bytes]):
        """(start, value) of every occurrence."""
        m, shift, jump, n = self.m, self.shift.get, self.jump, len(text)
        end = m
        if self.block == 1:
            for at, w in enumerate(text):
                for _, value in self.buckets.get((w,), {}).get(w, ()):
                    yield at, value
            return
        while end <= n:
            key = (text[end - 2], text[end - 1])
            s = shift(key, jump)
            if s:
                end += s
                continue
            start = end - m
            for words, value in self.buckets[key].get(text[start], ()):
                if text[start:end] == words:
                    yield start, value
            end += 1


class Searcher:
    """All windows of a block of benchmark items."""

    def __init__(self, items: list[tuple], window: int):
        by_length: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            words = words_of(text)
            m = min(window, len(words))
            for at in range(len(words) - m + 1 if m else 0):
                by_length[m][tuple(words[at : at + m])].add(item)
        self.engines = [WuManber(m, strings) for m, strings in sorted(by_length.items())]

    def search(self, text: list[bytes]):
        for engine in self.engines:
            for at, items in engine.search(text):
                yield at, at + engine.m, items


def item_blocks(benchmark: DataFrame, block_words: int):
    """Lists of (item_id, text) of bounded size, fetched partition by partition."""
    block, size = [], 0
    for row in benchmark.filter("text is not null").select("item_id", F.encode("text", "utf-8").alias("text")).distinct().toLocalIterator():
        text = bytes(row.text)
        n = len(words_of(text))
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((row.item_id, text))
        size += n
    if block:
        yield block


_SEARCHERS: dict = {}


def _searcher(handle, window: int) -> Searcher:
    """The search tables of a block; a worker keeps those of the last block only."""
    if handle.id not in _SEARCHERS:
        _SEARCHERS.clear()
        _SEARCHERS[handle.id] = Searcher(handle.value, window)
    return _SEARCHERS[handle.id]


class _Handle:
    def __init__(self, broadcast, key):
        self.broadcast, self.id = broadcast, key

    @property
    def value(self):
        return self.broadcast.value


SCHEMA = "doc_id {kind}, n_words long, n_hit long, n_windows long, item_ids array<string>, hit_spans array<struct<start:int,end:int>>"
#: Bytes of texts searched with one block before the next one is loaded, where there are several.
WIDE_STEP = 64 << 20


class Search:
    """The benchmark's search tables, ready to be sent to the tasks."""

    def __init__(self, benchmark: DataFrame, window: int, block_words: int):
        sc, run_id = benchmark.sparkSession.sparkContext, uuid.uuid4().hex
        self.window = window
        self.handles = [_Handle(sc.broadcast(block), (run_id, k)) for k, block in enumerate(item_blocks(benchmark, block_words))]
        self.step = STEP if len(self.handles) <= 1 else WIDE_STEP

    def find(self, texts: pa.Array):
        """For each text: number of words, merged hit ranges of words, number of hit windows of full size, item ids."""
        words = [words_of(x.as_py()) for x in texts.cast(pa.binary())]
        found: list[tuple[list, set]] = [([], set()) for _ in words]
        for handle in self.handles:
            search = _searcher(handle, self.window).search
            for w, (spans, items) in zip(words, found, strict=True):
                for start, end, ids in search(w):
                    spans.append((start, end))
                    items |= ids
        for w, (spans, items) in zip(words, found, strict=True):
            runs: list[list[int]] = []
            for start, end in sorted(spans):
                if runs and start <= runs[-1][1]:
                    runs[-1][1] = max(end, runs[-1][1])
                else:
                    runs.append([start, end])
            yield len(w), runs, sum(y - x >= self.window for x, y in spans), sorted(str(x) for x in items if x is not None)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_words: int = 250_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_windows (hits of the full window), item_ids (sorted as strings) and hit_spans (word ranges) of every row of docs (doc_id, text)."""
    search = Search(benchmark, window, block_words)
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches):
        longs = lambda x: pa.array(x, pa.int64())
        for b in steps(batches, 1, search.step):
            n_words, runs, full, ids = zip(*search.find(b.column(1)), strict=True) if b.num_rows else ((), (), (), ())
            hit = [sum(y - x for x, y in r) for r in runs]
            merged = [[{"start": x, "end": y} for x, y in r] for r in runs]
            cols = [b.column(0), longs(n_words), longs(hit), longs(full), pa.array(ids, pa.list_(pa.string())), pa.array(merged, pa.list_(span))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_hit", "n_windows", "item_ids", "hit_spans"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA.format(kind=kind))


def contaminated(min_percent: int = 5):
    return (F.col("n_hit") > 0) & (F.lit(100) * F.col("n_hit") >= F.lit(min_percent) * F.col("n_words"))


def decontaminate_stage(docs: DataFrame, benchmark: DataFrame, window: int = 13, min_percent: int = 5, block_words: int = 250_000) -> DataFrame:
    """The documents without benchmark passages; all columns of docs, whatever their names.

    A document goes if a full window of an item occurs in it, however long it
    is, or if what it holds of items shorter than a window makes up
    ``min_percent`` of its words (a few common words may be an item too).
    Judged row by row, so repeated ids do no harm.
    """
    search, at = Search(benchmark, window, block_words), docs.columns.index("text")

    def run(batches):
        for b in steps(batches, at, search.step):
            keep = [not full and (not runs or 100 * sum(y - x for x, y in runs) < min_percent * n) for n, runs, full, _ in search.find(b.column(at))]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
