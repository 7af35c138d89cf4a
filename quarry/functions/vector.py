"""Vector expressions over arrays of doubles, and the hash embedding."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSION = 384
#: FNV-1a, 64 bits: fixed values.
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def normalize(a: Column) -> Column:
    return F.transform(a, lambda x: F.when(norm(a) == 0, F.lit(0.0)).otherwise(x.cast("double") / norm(a)))


def is_finite(a: Column) -> Column:
    return F.forall(a, lambda x: ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))


def fnv64(parts: list[bytes]) -> int:
    """FNV-1a over the parts, each followed by a byte 0xff."""
    h = FNV_START
    for p in parts:
        for c in (*p, 0xFF):
            h = ((h ^ c) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def stable_hash(parts: list[str]) -> str:
    return f"{fnv64([p.encode() for p in parts]):016x}"


INPUT_BYTES = 2000


def cut_input(text: str, most: int = INPUT_BYTES) -> str:
    """text, or where it is longer, what stands before the last character that starts within ``most`` bytes."""
    data = text.encode("utf-8")
    if len(data) <= most:
        return text
    while data[most] & 0xC0 == 0x80:
        most -= 1
    return data[:most].decode("utf-8")


def identifier_tokens(text: str) -> list[str]:
    """Letter and digit runs, cut before a capital after a small letter, lower-cased."""
    words, before = [""], ""
    for c in text:
        if not c.isalnum() or (before.islower() and c.isupper()):
            words.append("")
        if c.isalnum():
            words[-1] += c.lower()
        before = c
    return [w for w in words if w]


def embed_tokens(tokens: list[str], dimension: int = DIMENSION) -> np.ndarray:
    """Signed hash counts of tokens (1) and neighbouring pairs (0.5), scaled to length 1.

    The lowest bit of a hash is its sign and, with the rest, its place.
    """
    out = np.zeros(dimension)
    pairs = [f"{a}::{b}" for a, b in zip(tokens, tokens[1:], strict=False)]
    for seed, words, weight in ((b"token", tokens, 1.0), (b"bigram", pairs, 0.5)):
        for w in words:
            h = fnv64([seed, w.encode("utf-8")])
            out[h % dimension] += weight if h & 1 == 0 else -weight
    size = np.sqrt((out * out).sum())
    return out / size if size else out


RUN, CUT = re.compile(r"[^\W_]+"), re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Runs whose tokens a worker remembers.
KNOWN = 200_000


def run_tokens(run: str) -> tuple[str, ...]:
    """identifier_tokens of letters and digits only."""
    return tuple(CUT.sub(" ", run).lower().split(" ")) if run.isascii() else tuple(identifier_tokens(run))


def _fnv_more(state: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """FNV-1a states carried on by size bytes of data from begin on, each."""
    order = np.argsort(-size, kind="stable")
    h, begin, size = state[order], begin[order], size[order]
    left = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")  # how many have a k-th byte
    with np.errstate(over="ignore"):
        for k, n in enumerate(left.tolist()):
            h[:n] = (h[:n] ^ data[begin[:n] + k]) * np.uint64(FNV_PRIME)
    out = np.empty_like(h)
    out[order] = h
    return out


def embed_many(texts: list[list[str]], dimension: int = DIMENSION) -> np.ndarray:
    """embed_tokens of each list of tokens, a row each."""
    code: dict[str, int] = {}
    ids = np.array([code.setdefault(w, len(code)) for tokens in texts for w in tokens], np.int64)
    row = np.repeat(np.arange(len(texts)), [len(tokens) for tokens in texts])
    out = np.zeros(len(texts) * dimension)
    if not len(ids):
        return out.reshape(-1, dimension)
    raw = [w.encode("utf-8") for w in code]
    size = np.array([len(w) + 1 for w in raw])  # with the byte 0xff at the end
    begin = np.cumsum(size) - size
    data = np.frombuffer(b"\xff".join(raw) + b"\xff", np.uint8).astype(np.uint64)
    token = _fnv_more(np.full(len(raw), fnv64([b"token"]), np.uint64), data, begin, size)
    first = _fnv_more(np.full(len(raw), fnv64([b"bigram"]), np.uint64), data, begin, size - 1)
    with np.errstate(over="ignore"):
        for _ in range(2):
            first = (first ^ np.uint64(ord(":"))) * np.uint64(FNV_PRIME)
    near = np.flatnonzero(row[1:] == row[:-1])
    pair = _fnv_more(first[ids[near]], data, begin[ids[near + 1]], size[ids[near + 1]])
    for h, at, weight in ((token[ids], row, 1.0), (pair, row[near], 0.5)):
        place = at * dimension + (h % np.uint64(dimension)).astype(np.int64)
        out += np.bincount(place, np.where(h & np.uint64(1), -weight, weight), len(out))
    out = out.reshape(-1, dimension)
    length = np.sqrt((out * out).sum(axis=1))
    return out / np.where(length == 0, 1.0, length)[:, None]


def hash_embedding(dimension: int = DIMENSION):
    """A vectorised function from a text to its embedding; a null text is an empty one."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, tuple[str, ...]] = {}

        def tokens(text: str | None) -> list[str]:
            out: list[str] = []
            for run in RUN.findall(cut_input(text or "")):
                if (got := known.get(run)) is None:
                    if len(known) >= KNOWN:
                        known.clear()
                    got = known[run] = run_tokens(run)
                out += got
            return out

        for texts in batches:
            parts = [embed_many([tokens(x) for x in texts.iloc[at : at + 1024]], dimension) for at in range(0, len(texts), 1024)]
            yield pd.Series([v for part in parts for v in part], index=texts.index, dtype=object)

    return embed
