"""Language-model scoring by context-tree weighting over bytes.

Each byte is eight binary decisions. A decision's node is the path of the bits
before it, in the context of the last d bytes, for every d from 0 to ``depth``.
Every node keeps a Krichevsky-Trofimov estimate of its zeros and ones; a node's
weighted probability is half its own estimate's and half the product of those
of its children (the contexts one byte longer), which mixes all context trees
up to that depth. After training, the chance of a bit is the mixture, by the
posterior weights along the path, of the estimates at all depths; an empty node
(a context that training never saw) gives either bit the chance 1/2, as its
estimate does. The sum over bits is the text's log10 probability; code length
per byte follows from it.

Beside it stands a plain unigram score of tokens with add-one smoothing.

Scale: a byte with its context is a string of depth + 1 bytes. One pass counts
the distinct strings and tokens of the training texts per task and sums them in
a shuffle, so a very frequent one is a row a task; strings of other texts come
along with count 0. The strings are dealt out by the last two bytes of context,
so each task has whole subtrees of levels 2 and deeper. Pairs with more strings
than a task's even share are fewer than the tasks; theirs are dealt out by the
last three bytes. Only the nodes of levels 0 and 1 (at most 65,536) and those of
level 2 of such pairs (255 each) go to the driver and to all tasks. There each
distinct string is scored once. Strings and tokens that make up at least
1/``FREQUENT_GRAMS`` and 1/``FREQUENT`` of all are looked up where the texts lie:
there are at most so many of them whatever the input, so their broadcast is
bounded. The others of each text are joined by string and by token, where no
key can have more than that share of all rows. No row is dropped.

Edge cases: null and empty texts score 0 and have one token, the end. A null
doc_id is never held out. Repeated rows are scored alike, as each row has a
number of its own while it is scored. With no training text every bit has
chance 1/2. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import steps, written

DEPTH = 5
#: At most: a string with its context is a number of 64 bits.
DEEPEST = 7
FREQUENT = 65_536
FREQUENT_GRAMS = 1 << 23
#: Bytes of text whose strings are held as numbers at once.
PIECE = 1 << 20
#: Strings whose subtrees are built at once; a pair of context bytes stands together.
SUBTREE = 400_000
END = b"\n"  # as a token it cannot clash: words hold no white space


def held_out(doc_id: Column) -> Column:
    """Documents that are only scored: crc32 of the id as text leaves 2 when divided by 7."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 7 == 2, F.lit(False))


def grams(texts, depth: int):
    """Yields (codes, rows, sizes): the depth+1 byte strings that end at each byte, for pieces of rows.

    A text starts in a context of zero bytes. Long texts come in pieces, whose
    context runs on from the piece before.
    """
    pad = b"\0" * depth
    held, rows, sizes, total = [], [], [], 0

    def codes():
        buf = np.frombuffer(b"".join(held), np.uint8)
        n = len(buf) - depth
        code = np.zeros(n, np.uint64)
        for k in range(depth + 1):
            code <<= np.uint64(8)
            code |= buf[k : n + k]
        ends = np.cumsum(np.array(sizes) + depth)
        keep = np.ones(n, bool)
        for k in range(depth):
            keep[ends[:-1] - 1 - k] = False
        return code[keep], np.array(rows), np.array(sizes)

    for row, text in enumerate(texts):
        for at in range(0, len(text), PIECE):
            part = text[at : at + PIECE]
            held += [pad if at == 0 else text[at - depth : at], part]
            rows.append(row)
            sizes.append(len(part))
            total += len(part)
            if total >= PIECE:
                yield codes()
                held, rows, sizes, total = [], [], [], 0
    if held:
        yield codes()


def tokens_of(text: bytes) -> list[bytes]:
    return [*text.split(), END]


def count_strings(docs: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(token, n) of the training rows of docs (held, text), and (gram, n, m): times in training rows, and in all rows."""

    def run(batches):
        tokens: Counter = Counter()
        held: list[tuple] = []

        def rows(token, gram, n, m):
            longs = lambda x: pa.array(x, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(token, pa.binary()), longs(gram), longs(n), longs(m)], ["token", "gram", "n", "m"])

        def out_tokens():
            items = iter(tokens.items())
            while part := list(islice(items, 20_000)):
                yield rows([t for t, _ in part], [None] * len(part), [n for _, n in part], [0] * len(part))
            tokens.clear()

        def merge_held():
            codes, n, m = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(codes, kind="stable")
            first = starts_of(codes[order])
            held[:] = [(codes[order][first], np.add.reduceat(n[order], first), np.add.reduceat(m[order], first))]

        def out_grams():
            if held:
                merge_held()
                codes, n, m = held.pop()
                for at in range(0, len(codes), 50_000):
                    cut = slice(at, at + 50_000)
                    yield rows([None] * len(codes[cut]), codes[cut].view(np.int64), n[cut], m[cut])

        for b in steps(batches, 1):
            out = np.array(b.column(0).to_pylist(), bool)
            texts = [(x.as_py() or b"").lower() for x in b.column(1).cast(pa.binary())]
            for t, h in zip(texts, out.tolist(), strict=True):
                if not h:
                    tokens.update(tokens_of(t))
            if len(tokens) > 300_000:
                yield from out_tokens()
            for scored in (False, True):
                for codes, _, _ in grams([t for t, h in zip(texts, out.tolist(), strict=True) if h == scored], depth):
                    codes, m = np.unique(codes, return_counts=True)
                    held.append((codes, m * (not scored), m))
            if sum(len(x[0]) for x in held) > 1_500_000:
                merge_held()
                if len(held[0][0]) > 1_000_000:
                    yield from out_grams()
        yield from out_tokens()
        yield from out_grams()

    counted = docs.select("held", "text").mapInArrow(run, "token binary, gram long, n long, m long")
    summed = written(counted.groupBy("token", "gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "training-counts")
    return summed.filter("token is not null").select("token", "n"), summed.filter("gram is not null").select("gram", "n", "m")


def starts_of(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x >= 0.5, by Stirling's series at x + 8."""
    low = np.ones_like(x)
    for k in range(8):
        low = low * (x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(low)


def kt_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of any sequence with these counts."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - math.log(math.pi) - log_gamma(n0 + n1 + 1.0)


def bit_counts(codes: np.ndarray, counts: np.ndarray, d: int) -> tuple:
    """(keys, n0, n1) of the nodes at depth d, by key: the context's d bytes, then the path of bits as a heap index."""
    short = codes & np.uint64((1 << 8 * (d + 1)) - 1)
    order = np.argsort(short, kind="stable")
    short, counts = short[order], counts[order]
    first = starts_of(short)
    short, n = short[first], np.add.reduceat(counts, first) if len(first) else counts
    context, byte = short & ~np.uint64(255), short & np.uint64(255)
    parts = []
    for k in range(8):  # of one length of path, keys come sorted
        keys = context | np.uint64(1 << k) | (byte >> np.uint64(8 - k))
        first = starts_of(keys)
        ones = n * ((byte >> np.uint64(7 - k)) & np.uint64(1)).astype(np.int64)
        parts.append((keys[first], np.add.reduceat(n, first), np.add.reduceat(ones, first)) if len(first) else (keys, n, n))
    keys, n, ones = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys)
    return keys[order], (n - ones)[order].astype(float), ones[order].astype(float)


def level(keys, n0, n1, below) -> tuple:
    """(keys, log odds of a one, log odds of the own weight, ln weighted probability); below: sums over children, None at the leaves.

    Log odds keep chances and weights near 0 and 1 apart from them.
    """
    own = kt_log(n0, n1)
    weighted = own if below is None else np.logaddexp(own, below) - math.log(2)
    weight = np.full(len(keys), np.inf) if below is None else own - below
    return keys, np.log(n1 + 0.5) - np.log(n0 + 0.5), weight, weighted


def chance_of(odds: np.ndarray) -> np.ndarray:
    """The chance that has these log odds; that of the opposite is chance_of(-odds)."""
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-odds))


def child_sums(parent: np.ndarray, child: np.ndarray, value: np.ndarray, d: int) -> np.ndarray:
    """Sum of value over the children at depth d + 1 of each parent key at depth d."""
    context = (child >> np.uint64(8)) & np.uint64((1 << 8 * d) - 1)
    up = (context << np.uint64(8)) | (child & np.uint64(255))
    return np.bincount(np.searchsorted(parent, up), value, len(parent)).astype(float)


def pair_in(keys: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Whether the last two context bytes of each string or node of level 2 or deeper are one of pairs."""
    return np.isin((keys >> np.uint64(8)) & np.uint64(0xFFFF), pairs)


def subtree(codes: np.ndarray, counts: np.ndarray, depth: int, split: np.ndarray = np.zeros(0, np.uint64)) -> tuple[list[tuple], list[tuple]]:
    """The levels from 2 to depth over strings of whole pairs of context bytes; and what others need of them: (d, keys, n0, n1, sums over children).

    Of the split pairs there may be a part of the strings, with all that share
    three bytes. Their nodes of level 2 are given away in parts; the other pairs'
    give theirs to level 1.
    """
    levels, below, gives = [], None, []
    for d in range(depth, 1, -1):
        keys, n0, n1 = bit_counts(codes, counts, d)
        sums = None if below is None else child_sums(keys, *below, d)
        if d == 2 and len(split):
            part = pair_in(keys, split)
            gives.append((2, keys[part], n0[part], n1[part], sums[part]))
            keys, n0, n1, sums = keys[~part], n0[~part], n1[~part], sums[~part]
            whole = ~pair_in(codes, split)
            codes, counts = codes[whole], counts[whole]
        made = level(keys, n0, n1, sums)
        levels.insert(0, made[:3])
        below = made[0], made[3]
    keys, n0, n1 = bit_counts(codes, counts, 1)
    return levels, [*gives, (1, keys, n0, n1, child_sums(keys, *below, 1))]


def summed(keys, n0, n1, below) -> tuple:
    """Rows with distinct keys, in order, and the sums of the others."""
    unique, at = np.unique(keys, return_inverse=True)
    return unique, *(np.bincount(at, x, len(unique)).astype(float) for x in (n0, n1, below))


def top_levels(one: tuple, two: tuple) -> list[tuple]:
    """Levels 0, 1 and, of split pairs, 2 of what all subtrees give to levels 1 and 2: (keys, n0, n1, sums over children)."""
    keys, n0, n1, below = summed(*two)
    split = level(keys, n0, n1, below)
    up = ((keys >> np.uint64(8) & np.uint64(0xFF)) << np.uint64(8)) | (keys & np.uint64(255))
    keys, n0, n1, below = summed(*(np.concatenate(x) for x in zip(one, (up, n0, n1, split[3]), strict=True)))
    first = level(keys, n0, n1, below)
    keys, n0, n1, below = summed(keys & np.uint64(255), n0, n1, first[3])
    return [x[:3] for x in (level(keys, n0, n1, below), first, split)]


def log10_chance(levels: list[tuple], codes: np.ndarray) -> np.ndarray:
    """log10 chance of the last byte of each string after the others."""
    byte, total = codes & np.uint64(255), np.zeros(len(codes))
    for k in range(8):
        node = np.uint64(1 << k) | (byte >> np.uint64(8 - k))
        sign = np.where((byte >> np.uint64(7 - k)) & np.uint64(1) == 1, 1.0, -1.0)
        chance, rest = np.zeros(len(codes)), np.ones(len(codes))  # of the bit that is there; what deeper nodes weigh
        alive = np.arange(len(codes))
        for d, (keys, one, own) in enumerate(levels):
            if not len(keys) or not len(alive):
                break
            context = (codes[alive] >> np.uint64(8)) & np.uint64((1 << 8 * d) - 1)
            want = (context << np.uint64(8)) | node[alive]
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            there = keys[at] == want
            alive, at = alive[there], at[there]
            chance[alive] += rest[alive] * chance_of(own[at]) * chance_of(sign[alive] * one[at])
            rest[alive] *= chance_of(-own[at])
        total += np.log10(chance + 0.5 * rest)  # an empty node gives each bit 1/2; at the leaves nothing rests
    return total


def pair_of(gram: Column) -> Column:
    """The last two context bytes."""
    return F.shiftright(gram, 8).bitwiseAND(F.lit(0xFFFF))


def whole_pairs(batches):
    """(codes, n, m) of rows that come in the order of their pairs: about SUBTREE strings, and never a part of a pair."""
    held: list[list[np.ndarray]] = [[], [], []]
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        codes = b.column(0).to_numpy().view(np.uint64)
        pair = codes >> np.uint64(8) & np.uint64(0xFFFF)
        cuts = starts_of(pair).tolist()
        if held[0] and held[0][-1][-1] >> np.uint64(8) & np.uint64(0xFFFF) == pair[0]:
            cuts = cuts[1:]
        columns, at = (codes, b.column(1).to_numpy(), b.column(2).to_numpy()), 0
        for cut in [*cuts, len(codes)]:
            if size + cut - at >= SUBTREE or cut == len(codes):
                for k, x in enumerate(columns):
                    held[k].append(x[at:cut])
                size, at = size + cut - at, cut
                if size >= SUBTREE and cut < len(codes):
                    yield tuple(map(np.concatenate, held))
                    held, size = [[], [], []], 0
    if size:
        yield tuple(map(np.concatenate, held))


def score_strings(counts: DataFrame, depth: int, parts: int | None = None) -> DataFrame:
    """gram, m and v: the log10 chance of each distinct string of counts (gram, n, m)."""
    spark = counts.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    pair = pair_of(F.col("gram"))
    by_pair = counts.groupBy(pair.alias("pair")).count()
    share = counts.count() / parts
    large = [r.pair for r in by_pair.filter(F.col("count") > share).collect()] if depth > 2 else []  # fewer than parts
    split = np.array(sorted(large), np.uint64)
    place = F.when(pair.isin(large), F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFFFF))).otherwise(pair) if large else pair
    dealt = counts.withColumns({"pair": pair, "place": place}).repartition(parts, "place").sortWithinPartitions("pair").select("gram", "n", "m")

    def trained(codes, n):
        return codes[n > 0], n[n > 0]

    def give(batches):
        for codes, n, _ in whole_pairs(batches):
            for d, keys, *values in subtree(*trained(codes, n), depth, split)[1]:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), d, np.int32)), pa.array(keys.view(np.int64)), *map(pa.array, values)], ["d", "key", "n0", "n1", "below"])

    sums = dealt.mapInArrow(give, "d int, key long, n0 double, n1 double, below double").groupBy("d", "key").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "below")))
    rows = sums.toArrow()  # at most 65,536 and 255 for each split pair
    level_of = rows.column(0).to_numpy()
    given = [(rows.column(1).to_numpy().view(np.uint64)[level_of == d], *(rows.column(k).to_numpy()[level_of == d] for k in (2, 3, 4))) for d in (1, 2)]
    top = spark.sparkContext.broadcast(top_levels(*given))

    def score(batches):
        root, first, second = top.value
        for codes, n, m in whole_pairs(batches):
            levels = subtree(*trained(codes, n), depth, split)[0]
            keys = np.concatenate([levels[0][0], second[0]])
            order = np.argsort(keys)
            levels = [root, first, tuple(np.concatenate([a, b])[order] for a, b in zip(levels[0], second, strict=True)), *levels[1:]]
            for at in range(0, len(codes), 50_000):
                cut = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(codes[cut].view(np.int64)), pa.array(m[cut]), pa.array(log10_chance(levels, codes[cut]))], ["gram", "m", "v"])

    return written(dealt.mapInArrow(score, "gram long, m long, v double"), "strings")


class Lookup:
    """Values of known codes, in a table with linear probing."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(codes)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.at = np.zeros(1 << bits, np.int32)  # the place among codes, from 1
        self.codes, self.values = np.append(np.uint64(0), codes), np.append(0.0, values)
        todo, slot = np.arange(1, len(codes) + 1, dtype=np.int32), self._slot(codes)
        while len(todo):
            free = self.at[slot] == 0
            self.at[slot[free]] = todo[free]  # of several for one slot the last stays
            left = self.at[slot] != todo
            todo, slot = todo[left], (slot[left] + 1) & self.last

    def _slot(self, codes):
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each code, 0 for those that are not known, and which those are."""
        slot = self._slot(codes)
        at = self.at[slot]
        wrong = np.flatnonzero((self.codes[at] != codes) & (at != 0))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & self.last
            at[wrong] = self.at[slot[wrong]]
            wrong = wrong[(self.codes[at[wrong]] != codes[wrong]) & (at[wrong] != 0)]
        return self.values[at], at == 0


_LOOKUPS: dict = {}


def lookup(broadcast) -> Lookup:
    """The table of a broadcast; a worker keeps the last one."""
    key, codes, values = broadcast.value
    if key not in _LOOKUPS:
        _LOOKUPS.clear()
        _LOOKUPS[key] = Lookup(codes, values)
    return _LOOKUPS[key]


def score_documents(docs: DataFrame, depth: int = DEPTH, frequent_grams: int = FREQUENT_GRAMS, frequent: int = FREQUENT, parts: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte of every row of docs (doc_id, text)."""
    if not 2 <= depth <= DEEPEST:
        raise ValueError(f"depth has to be from 2 to {DEEPEST}")
    sc = docs.sparkSession.sparkContext
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held"), "text")
    token_counts, gram_counts = count_strings(rows, depth)
    size = token_counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_train, smooth = size.n, size.n + size.v + 1
    often = sc.broadcast({bytes(r.token): r.n for r in token_counts.filter(F.col("n") * frequent >= n_train).toLocalIterator()})
    strings = score_strings(gram_counts, depth, parts)
    all_grams = strings.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("m")).first().m
    top = strings.filter(F.col("m").cast("decimal(38,0)") * frequent_grams >= all_grams).select("gram", "v").toArrow()
    table = sc.broadcast((uuid.uuid4().hex, top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()))
    kind = docs.schema["doc_id"].dataType.simpleString()
    pairs = pa.struct([("token", pa.binary()), ("n", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        known, model, number = often.value, lookup(table), TaskContext.get().partitionId() << 40
        log = math.log10
        for b in steps(batches, 2):
            texts = [(x.as_py() or b"").lower() for x in b.column(2).cast(pa.binary())]
            score, rare_grams, rare_rows = np.zeros(len(texts)), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for codes, which, sizes in grams(texts, depth):
                values, missing = model.find(codes)
                first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                np.add.at(score, which, np.add.reduceat(values, first))
                missing = np.flatnonzero(missing)
                rare_grams.append(codes[missing])
                rare_rows.append(which[np.searchsorted(first, missing, "right") - 1])
            gram_ends = np.searchsorted(np.concatenate(rare_rows), np.arange(len(texts) + 1))
            n_tokens, n_known, base = [], [], []
            rare, rare_n, ends = [], [], [0]
            for t in texts:
                counts = Counter(tokens_of(t))
                have = counts.keys() & known.keys()
                n_tokens.append(sum(counts.values()))
                n_known.append(sum(counts[x] for x in have))
                base.append(math.fsum(counts[x] * log((known[x] + 1) / smooth) for x in have))
                new = counts.keys() - have
                rare += new
                rare_n += map(counts.__getitem__, new)
                ends.append(len(rare))
            ids = np.arange(number, number + len(texts), dtype=np.int64)
            number += len(texts)
            longs = lambda x: pa.array(x, pa.int64())
            rows_of = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), longs(rare_n)], fields=list(pairs))
            rare_of = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows_of)
            grams_of = pa.ListArray.from_arrays(pa.array(gram_ends, pa.int32()), pa.array(np.concatenate(rare_grams).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [longs(ids), b.column(0), b.column(1), longs(n_tokens), longs(n_known), pa.array(base, pa.float64()), pa.array(score), longs([len(t) for t in texts]), rare_of, grams_of],
                ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "n_bytes", "rare", "grams"],
            )

    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, n_bytes long, rare array<struct<token:binary,n:long>>, grams array<long>"
    scored = written(rows.mapInArrow(run, schema), "scored")
    tokens = scored.select("row", F.explode("rare").alias("x")).select("row", "x.token", F.col("x.n").alias("k")).join(token_counts, "token", "left")
    by_token = tokens.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("more_known"),
        F.sum(F.col("k") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(smooth)))).alias("more_base"),
    )
    by_gram = scored.select("row", F.explode("grams").alias("gram")).join(strings.select("gram", "v"), "gram").groupBy("row").agg(F.sum("v").alias("more_score"))
    out = scored.drop("rare", "grams").join(by_token, "row", "left").join(by_gram, "row", "left")
    total = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        total.alias("score"),
        "n_bytes",
        F.when(F.col("n_bytes") > 0, -total / F.lit(math.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
