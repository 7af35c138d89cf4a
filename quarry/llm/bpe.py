"""BPE encoding and decoding with a contiguous rank array per word.

A word's symbols lie side by side: an array of part boundaries and, beside it,
the rank of each adjacent pair. The array is scanned for the least rank (the
first of equal ones), the boundary between the two parts is deleted and the
ranks of the two neighbouring pairs are looked up anew, until no pair has a
rank. The words of a batch that are as long as one another are one matrix, a
row each, so that every step is taken for all of them at once. Words over
``LONG_WORD`` symbols, where repeated scans would be quadratic, take the same
merges in the same order from a heap.

The vocabulary file's own rules are followed: special strings are cut out of
the raw text, the rest is brought to NFC and lower-cased, cut by the file's
word pattern, and each word's bytes get an end-of-word mark. Tokens are joined
by spaces when decoded, as the file names no decoder.

Scale: documents are encoded row by row where they lie, with nothing shuffled.
Texts are handled in steps of about ``WIDE_STEP`` bytes (a longer text stands
alone): cut at white space, each distinct piece cut into words once, each
distinct word merged once, and the codes spread to their places by index.
A worker remembers ``KNOWN`` words at most (operator 9 its own number). The vocabulary file is read on the driver
and sent as it is (its size is fixed).

Edge cases: null and empty texts have no tokens and decode to the empty string;
very long texts are encoded whole, a piece without white space too. Repeated
rows are encoded alike. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import steps

LONG_WORD = 64
ID_BITS = 24
ID_MASK = (1 << ID_BITS) - 1
NO_RANK = 1 << 60
WIDE_STEP = 8 << 20
#: Words that a worker remembers at most.
KNOWN = 150_000
#: White space beyond ASCII.
_SPACES = str.maketrans(dict.fromkeys("\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000", " "))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte: itself if printable Latin-1, else the next from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(own))}
    return [rest.get(b, chr(b)) for b in range(256)]


def _pattern(spec: dict):
    from tokenizers import Regex

    return Regex(next(s["pattern"]["Regex"] for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split"))


def spread(codes: list[bytes], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids (32 bits each) of codes[k] for each k of which, one after another, and how many each has."""
    sizes = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
    known, starts, length = np.frombuffer(b"".join(codes), "<u4"), np.cumsum(sizes) - sizes, sizes[which]
    ends = np.cumsum(length)
    return known[np.repeat(starts[which] - (ends - length), length) + np.arange(length.sum())], length


class RankArrayBPE:
    most_known = KNOWN

    def __init__(self, spec: str):
        """spec: the JSON of a tokenizer file with BPE over words with an end-of-word mark."""
        spec = json.loads(spec)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"]
        symbols = byte_symbols()
        self.first = np.array([self.vocab.get(s, -1) for s in symbols], np.int64)
        self.last = np.array([self.vocab.get(s + suffix, -1) for s in symbols], np.int64)
        self.size = max(self.vocab.values()) + 1
        # The rank of each pair, counted from 1, above the id that it merges to; in the order of the pairs.
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        left, right, whole = (np.array([self.vocab[x] for x in xs], np.int64) for xs in zip(*((a, b, a + b) for a, b in pairs), strict=True))
        keys, worth = left * self.size + right, np.arange(1, len(pairs) + 1, dtype=np.int64) << ID_BITS | whole
        order = np.argsort(keys, kind="stable")
        self.keys, self.worth = keys[order], worth[order]
        self.settled: set[str] = set()
        self.odd: set[str] = set()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.word = "(" + next(s["pattern"]["Regex"] for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split") + ")"
        self.names = {i: s for s, i in {**self.vocab, **self.special}.items()}
        self.spaced = {i: f"{s} " for i, s in self.names.items()}
        self.known = {"": b""}
        self.spec, self.library = json.dumps(spec), None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank and merged id of each pair; NO_RANK for none."""
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.worth[at], NO_RANK)

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word (not empty), as little-endian unsigned 32-bit integers."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes)
        ids = self.first[data]
        ids[ends - 1] = self.last[data[ends - 1]]
        if (known := ids >= 0).all():
            starts = ends - sizes
        else:
            before = np.concatenate([[0], np.cumsum(known)])
            starts, sizes = before[ends - sizes], before[ends] - before[ends - sizes]
            ids = ids[known]
        out = [b""] * len(words)
        for n in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == n)
            if n > LONG_WORD:
                for r in rows.tolist():
                    out[r] = array("I", self._heap(ids[starts[r] : starts[r] + n].tolist())).tobytes()
            elif n:
                self._scan(ids[starts[rows][:, None] + np.arange(n)], rows, out)
        return out

    def _scan(self, parts: np.ndarray, rows: np.ndarray, out: list) -> None:
        """Merge words of one length, a row of parts each; row k goes to out[rows[k]]."""

        def put(done, at):
            raw, width = done.astype("<u4").tobytes(), 4 * done.shape[1]
            for k, r in enumerate(at.tolist()):
                out[r] = raw[k * width : (k + 1) * width]

        ranks = self.ranks(parts[:, :-1], parts[:, 1:])
        while ranks.shape[1]:
            at = ranks.argmin(1)
            best = ranks[np.arange(len(at)), at]
            more = best != NO_RANK
            if not more.all():
                put(parts[~more], rows[~more])
                parts, ranks, rows, at, best = parts[more], ranks[more], rows[more], at[more], best[more]
            if not len(rows):
                return
            n, width = parts.shape
            every = np.arange(n)
            parts[every, at] = best & ID_MASK
            stay = np.ones((n, width), bool)
            stay[every, at + 1] = False
            parts = parts[stay].reshape(n, width - 1)
            stay = np.ones((n, width - 1), bool)
            stay[every, at] = False
            ranks = ranks[stay].reshape(n, width - 2)
            for side in (at - 1, at):
                k = np.flatnonzero((side >= 0) & (side < width - 2))
                x = side[k]
                ranks[k, x] = self.ranks(parts[k, x], parts[k, x + 1])
        put(parts, rows)

    def _heap(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.ranks(np.array(parts[:-1]), np.array(parts[1:])).tolist()
        heap = [(m, i, parts[i], parts[i + 1]) for i, m in enumerate(ranks) if m != NO_RANK]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = m & ID_MASK, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            near = [(x, y) for x, y in ((before[i], i), (i, after[i])) if x >= 0 and y < n]
            for (x, y), m in zip(near, self.ranks(np.array([parts[x] for x, _ in near]), np.array([parts[y] for _, y in near])).tolist() if near else (), strict=True):
                if m != NO_RANK:
                    heapq.heappush(heap, (m, x, parts[x], parts[y]))
        return [p for p, ok in zip(parts, alive, strict=True) if ok]

    def _settle(self, text: str) -> None:
        """Tell characters whose meaning is certain from odd ones: newer than Python's tables, or of another class in the pattern engine's."""
        new = [c for c in set(text) - self.settled - self.odd if not c.isascii()]
        classes = [unicodedata.category(c) for c in new]
        is_letter, is_number = (pc.match_substring_regex(pa.array(new, pa.string()), rf"^\p{{{x}}}$").to_pylist() for x in "LN")
        sure = {c for c, k, a, b in zip(new, classes, is_letter, is_number, strict=True) if k != "Cn" and a == (k[0] == "L") and b == (k[0] == "N")}
        self.settled |= sure
        self.odd |= set(new) - sure

    def _odd_words(self, piece: str) -> list[str]:
        """Where character tables may disagree, the library cuts the words; the merges stay ours."""
        from tokenizers import Tokenizer, pre_tokenizers

        if self.library is None:
            whole = Tokenizer.from_str(self.spec)
            self.library = whole.normalizer, pre_tokenizers.Split(_pattern(json.loads(self.spec)), "removed", invert=True)
        normalizer, split = self.library
        return [w for w, _ in split.pre_tokenize_str(normalizer.normalize_str(piece))]

    def words_of(self, pieces: list[str]) -> pa.ListArray:
        """The words of texts without special strings, as the vocabulary has them, and empty ones."""
        far = [k for k, p in enumerate(pieces) if not p.isascii()]
        texts = [p.lower() for p in pieces]
        self._settle("".join(map(pieces.__getitem__, far)))
        for k in far:
            texts[k] = unicodedata.normalize("NFC", pieces[k]).replace("Σ", "σ").lower().translate(_SPACES)
        whole = pa.array(texts, pa.string())
        mixed = pa.array([not t.isalpha() for t in texts], pa.bool_())
        words = pc.ascii_split_whitespace(pc.replace_with_mask(whole, mixed, pc.replace_substring_regex(whole.filter(mixed), self.word, r"\1 ")))
        if self.odd and (odd := [k for k in far if not self.odd.isdisjoint(pieces[k])]):
            lists = words.to_pylist()
            for k in odd:
                lists[k] = self._odd_words(pieces[k])
            words = pa.array(lists, pa.list_(pa.string()))
        return words

    def code_pieces(self, pieces: list[str], decoded: bool):
        """The ids of all pieces, the number of each piece's, and each piece's names with spaces after them."""
        lists = self.words_of(pieces)
        told = lists.flatten().dictionary_encode()
        words = told.dictionary.to_pylist()
        codes = list(map(self.known.get, words))
        new = [w for w, c in zip(words, codes, strict=True) if c is None]
        if new:
            merged = dict(zip(new, self.merge_words([w.encode("utf-8") for w in new]), strict=True))
            codes = [merged[w] if c is None else c for w, c in zip(words, codes, strict=True)]
            if len(self.known) + len(new) > self.most_known:  # those of this step stay, if that leaves room
                self.known = {"": b""} | (dict(zip(words, codes, strict=True)) if 2 * len(words) <= self.most_known else {})
            self.known |= merged if len(new) < self.most_known else {}
        ids, sizes = spread(codes, told.indices.to_numpy())
        sizes = np.diff(np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])])
        if not decoded:
            return ids, sizes, None
        spaced = self.spaced.__getitem__
        of_word = pa.array(["".join(map(spaced, array("I", c))) for c in codes], pa.string())
        return ids, sizes, pc.binary_join(pa.ListArray.from_arrays(lists.offsets, of_word.take(told.indices)), "")

    def _plain(self, texts: pa.Array, decoded: bool):
        """Of texts without special strings: the ids of all, the number of each text's, and the decoded texts."""
        lists = pc.ascii_split_whitespace(texts)
        told = lists.flatten().dictionary_encode()
        known, sizes, names = self.code_pieces(told.dictionary.to_pylist(), decoded)
        which = told.indices.to_numpy()
        starts, length = np.cumsum(sizes) - sizes, sizes[which]
        ends = np.cumsum(length)
        ids = known[np.repeat(starts[which] - (ends - length), length) + np.arange(length.sum())]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])]
        if decoded:
            names = pc.utf8_rtrim(pc.binary_join(pa.ListArray.from_arrays(lists.offsets, names.take(told.indices)), ""), " ")
        return ids, np.diff(bounds), names

    def _special(self, text: str) -> bytes:
        """The ids of a text with special strings."""
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._plain(pa.array([text[at : m.start()]]), False)[0].tobytes(), array("I", [self.special[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(pa.array([text[at:]]), False)[0].tobytes()])

    def encode(self, texts: pa.Array, decoded: bool = True):
        """The ids of all texts (null: empty), the number of each text's, and the decoded texts (None if not wanted)."""
        texts = texts.cast(pa.string()).fill_null("")
        marks = [k for k in np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)).tolist() if self.cut.search(texts[k].as_py())]
        parts, at = [], 0
        for k in [*marks, len(texts)]:
            if k > at:
                parts.append(self._plain(texts.slice(at, k - at), decoded))
            if k < len(texts):
                ids = np.frombuffer(self._special(texts[k].as_py()), "<u4")
                parts.append((ids, np.array([len(ids)]), pa.array([self.decode(ids.tolist())], pa.string()) if decoded else None))
            at = k + 1
        if not parts:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64), pa.array([], pa.string()) if decoded else None
        ids, sizes, names = zip(*parts, strict=True)
        return np.concatenate(ids), np.concatenate(sizes), pa.concat_arrays(names) if decoded else None

    def decode(self, ids) -> str:
        return " ".join(self.names[i] for i in ids if i in self.names)


_CODERS: dict = {}


def coder(broadcast, kind=RankArrayBPE):
    """The worker's coder for a broadcast vocabulary; it outlives a task, with the pieces it knows."""
    key = (kind, hashlib.md5(broadcast.value.encode()).hexdigest())
    if key not in _CODERS:
        _CODERS[key] = kind(broadcast.value)
    return _CODERS[key]


def read_spec(spark: SparkSession, path: str | None):
    with open(path or tokenizer_path(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, path: str | None = None, with_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs (doc_id, text); with_text: also ids and decoded."""
    spec = read_spec(docs.sparkSession, path)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_text

    def run(batches):
        code = coder(spec)
        digest = lambda x: hashlib.sha256(x).hexdigest()
        for b in steps(batches, 1, WIDE_STEP):
            ids, sizes, decoded = code.encode(b.column(1))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B") if len(ids) else b""
            ids_of = pa.array([digest(raw[4 * x : 4 * y]) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string())
            text_of = pa.array([digest(x.as_buffer() or b"") for x in decoded.cast(pa.binary())], pa.string())
            cols = [b.column(0), pa.array(sizes, pa.int64()), ids_of, text_of]
            if with_text:
                cols += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view(np.int32))), decoded]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(cols)])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def bpe_stage(docs: DataFrame) -> DataFrame:
    """Each document with its token ids and the text that they decode to."""
    return encode_documents(docs, with_text=True).withColumnRenamed("decoded", "text").select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256", "text")
