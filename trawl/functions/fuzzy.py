"""Context-triggered piecewise hashes and their comparison, after the published algorithm (Kornblum, 2006)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the published format.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
WINDOW, SMALLEST, LENGTH = 7, 3, 64
PRIME, START = 0x01000193, 0x28021967


#: The piece hash keeps six bits, on which only six bits of the state and of the byte bear: next state by state and byte.
_NEXT = [bytes(((state * PRIME) ^ c) & 63 for c in range(256)) for state in range(64)]


def triggers(data: bytes) -> np.ndarray:
    """The rolling hash after each byte: sums over the last seven bytes, plain and weighted, and their shifted parity."""
    c = np.frombuffer(bytes(WINDOW - 1) + data, np.uint8).astype(np.uint32)
    n, out, mixed = len(data), np.zeros(len(data), np.uint32), np.zeros(len(data), np.uint32)
    for k in range(WINDOW):
        back = c[WINDOW - 1 - k : WINDOW - 1 - k + n]
        out += back * np.uint32(1 + WINDOW - k)
        mixed ^= back << np.uint32(5 * k)
    return out + mixed


def signature(data: bytes, rolled: np.ndarray, block: int, limit: int) -> str:
    """A character a piece; pieces end where the rolling hash is block - 1 modulo block, limit - 1 times at most."""
    ends = (np.flatnonzero(rolled % np.uint32(block) == block - 1)[: limit - 1] + 1).tolist()
    out, at = [], 0
    last = [len(data)] if len(rolled) and rolled[-1] else []
    for end in ends + last:
        piece = START & 63
        for c in data[at:end]:
            piece = _NEXT[piece][c]
        out.append(ALPHABET[piece])
        at = end
    return "".join(out)


def fuzzy_hash(text: str | bytes) -> str:
    """block size, signature and signature of twice the block size; text is hashed in UTF-8."""
    data = text.encode("utf-8") if isinstance(text, str) else text
    rolled, block = triggers(data), SMALLEST
    while block * LENGTH < len(data):
        block *= 2
    # the signature of a block size has as many characters as pieces, which are counted before it is made
    while block > SMALLEST:
        pieces = min(LENGTH - 1, int((rolled % np.uint32(block) == block - 1).sum())) + bool(len(rolled) and rolled[-1])
        if pieces >= LENGTH // 2:
            break
        block //= 2
    return f"{block}:{signature(data, rolled, block, LENGTH)}:{signature(data, rolled, 2 * block, LENGTH // 2)}"


def _shorten(s: str) -> str:
    """Runs of a character cut to three."""
    out = []
    for c in s:
        if out[-3:] != [c] * 3:
            out.append(c)
    return "".join(out)


def edit_distance(a: str, b: str) -> int:
    """Insertions and deletions cost 1, replacements 2, so it is the lengths less twice the longest common subsequence, whose
    rows are the bits of one number (after Hyyrö, 2004)."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for y in b:
        hit = row & where.get(y, 0)
        row = (row + hit | row - hit) & every
    return len(a) + len(b) - 2 * (len(a) - row.bit_count())


def _score(a: str, b: str, block: int) -> int:
    a, b = _shorten(a), _shorten(b)
    grams = {a[i : i + WINDOW] for i in range(len(a) - WINDOW + 1)}
    if not any(b[i : i + WINDOW] in grams for i in range(len(b) - WINDOW + 1)):
        return 0
    score = 100 - 100 * (edit_distance(a, b) * LENGTH // (len(a) + len(b))) // LENGTH
    return max(0, min(score, block // SMALLEST * min(len(a), len(b))))


_CODES = np.zeros(128, np.uint8)
_CODES[[ord(c) for c in ALPHABET]] = np.arange(1, len(ALPHABET) + 1)
#: Pairs whose common subsequences are worked out at once.
PAIRS = 1 << 15


def encoded(signatures: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, lengths) of signatures of LENGTH characters of the alphabet at most: a row each, zeros behind its end."""
    lengths = np.array([len(s) for s in signatures], np.int64)
    codes = np.zeros((len(signatures), LENGTH), np.uint8)
    codes[np.arange(LENGTH) < lengths[:, None]] = _CODES[np.frombuffer("".join(signatures).encode("ascii"), np.uint8)]
    return codes, lengths


def scores(codes: np.ndarray, lengths: np.ndarray, p: np.ndarray, q: np.ndarray, block: int) -> np.ndarray:
    """What `_score` says of the pairs (p, q) of encoded signatures, which are shortened and have a gram in common. LENGTH is the
    number of bits of a word, so that the rows of `edit_distance` are worked out for many pairs at once."""
    masks = np.zeros((len(codes), len(ALPHABET) + 1), np.uint64)
    for k in range(LENGTH):
        masks[np.arange(len(codes)), codes[:, k]] |= np.uint64(1) << np.uint64(k)
    masks[:, 0] = 0
    flat, turned, out = masks.ravel(), np.ascontiguousarray(codes.T), np.zeros(len(p), np.int64)
    for at in range(0, len(p), PAIRS):
        x, y = p[at : at + PAIRS], q[at : at + PAIRS]
        row, first = np.full(len(x), ~np.uint64(0)), x * masks.shape[1]
        for column in turned[: lengths[y].max()]:
            hit = row & flat[first + column[y]]
            row = row + hit | row - hit
        total = lengths[x] + lengths[y]
        edits = total - 2 * (LENGTH - np.bitwise_count(row).astype(np.int64))
        score = 100 - 100 * (edits * LENGTH // total) // LENGTH
        out[at : at + PAIRS] = np.clip(np.minimum(score, block // SMALLEST * np.minimum(lengths[x], lengths[y])), 0, None)
    return out


def hash_compare(x: str | None, y: str | None) -> int | None:
    """Likeness of two hashes, 0 to 100; small block sizes bound it. Null with null, -1 for what is no hash."""
    if x is None or y is None:
        return None
    try:
        (b1, s1, d1), (b2, s2, d2) = x.split(":", 2), y.split(":", 2)
        n, m = int(b1), int(b2)
    except ValueError:
        return -1
    if n == m:
        return max(_score(s1, s2, n), _score(d1, d2, 2 * n))
    if n == 2 * m:
        return _score(s1, d2, n)
    if m == 2 * n:
        return _score(d1, s2, m)
    return 0


def compare(a: str, b: str) -> int | None:
    return hash_compare(fuzzy_hash(a), fuzzy_hash(b))


def fuzzy_hash_column(text: Column) -> Column:
    @F.pandas_udf("string")
    def work(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else fuzzy_hash(t))

    return work(text)


def hash_compare_column(a: Column, b: Column) -> Column:
    @F.pandas_udf("int")
    def work(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([hash_compare(p, q) for p, q in zip(x, y, strict=True)], dtype="Int32")

    return work(a, b)


def register(spark: SparkSession) -> None:
    """fuzzy_hash, fuzzy_compare and fuzzy_hash_compare as SQL functions."""

    @F.pandas_udf("string")
    def hashed(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else fuzzy_hash(t))

    @F.pandas_udf("int")
    def compared(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else compare(p, q) for p, q in zip(x, y, strict=True)], dtype="Int32")

    @F.pandas_udf("int")
    def hash_compared(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([hash_compare(p, q) for p, q in zip(x, y, strict=True)], dtype="Int32")

    spark.udf.register("fuzzy_hash", hashed)
    spark.udf.register("fuzzy_compare", compared)
    spark.udf.register("fuzzy_hash_compare", hash_compared)
