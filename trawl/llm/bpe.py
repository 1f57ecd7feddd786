"""Operator 5, byte-level BPE encoding and decoding.

A pretoken's bytes are mapped to Latin-1 so that an Aho-Corasick automaton over the vocabulary finds the longest token at
a position. Encoding is by backtracking: take the longest match, check that it may follow the token before it, else try
the next shorter one, else step back; positions from which no valid rest exists are marked and never tried again, so the
work is linear in the pretoken. "May follow" is exact: two adjacent tokens are compatible if applying the merges to their
joined bytes gives these two tokens again; the answer is memoised by pair. A sequence of pairwise compatible tokens is
the one that the ranked merges give. (Published: van Antwerpen and Neubeck, "So many tokens, so little time", 2024.)

Words repeat, so each Python worker keeps a bounded memo from chunk to ids; a chunk is a piece between single spaces, at
which a pretoken always begins. Texts with other space runs next to a space are cut by the pattern itself.

Defined cases: a null text is the empty text (no tokens; digests of nothing); surrogates cannot occur in Spark strings;
any bytes round-trip; rows repeat as they are; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.shared import bounded_batches, documents, trimmed

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Entries of a worker's memo, which is emptied when full.
MEMO = 250_000
LONGEST_MEMO = 64
_CODECS: dict[tuple[str, str], "Codec"] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def rust_pattern(pattern: str) -> str:
    """The pattern with white space as Unicode's property, which is what the tiktoken library's engine takes \\s for."""
    return pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


class _OddSpace(Exception):
    """White space next to a single space: a pretoken need not begin there."""


class _Chunks(dict):
    """chunk -> ids as little-endian uint32; encodes what is missing."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _OddSpace
        ids = self.encode(chunk)
        if len(chunk) <= LONGEST_MEMO:
            if len(self) >= MEMO:
                self.clear()
            self[chunk] = ids
        return ids


class Codec:
    """Encoder and decoder over one vocabulary of byte strings with ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import ahocorasick
        import regex

        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.machine = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.machine.add_word(token.decode("latin-1"), (rank, len(token) - 1))
        self.machine.make_automaton()
        self.sizes = [len(token) for token in self.tokens]
        self.prefixes = self._shorter()
        self.compatible: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.split = regex.compile(rust_pattern(pattern)).findall
        self.plain = pattern == GPT2_PATTERN
        self.first = _Chunks(lambda chunk: self._pretokens(chunk))
        self.later = _Chunks(lambda chunk: self._pretokens(" " + chunk))

    def _shorter(self) -> list[int]:
        """For each token the longest other token that is its prefix, or -1."""
        out = [-1] * len(self.tokens)
        for rank, token in enumerate(self.tokens):
            for n in range(len(token) - 1, 0, -1):
                if (found := self.ranks.get(token[:n])) is not None:
                    out[rank] = found
                    break
        return out

    def merge(self, piece: bytes) -> list[int]:
        """The ranked merges themselves, for short pieces: the reference that compatibility is defined by."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def follows(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) >= MEMO:
                self.compatible.clear()
            known = self.compatible[key] = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def longest(self, piece: str) -> list[int]:
        """The longest token that starts at each position of a Latin-1 string; of one start's matches it ends last."""
        found = [-1] * len(piece)
        for end, (rank, back) in self.machine.iter(piece):
            found[end - back] = rank
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        best, n = self.longest(piece.decode("latin-1")), len(piece)
        sizes, shorter, follows = self.sizes, self.prefixes, self.follows
        dead = bytearray(n + 1)
        out: list[int] = []
        at, rank = 0, best[0]
        while at < n:
            while rank >= 0:
                end = at + sizes[rank]
                if not dead[end] and (not out or follows(out[-1], rank)):
                    break
                rank = shorter[rank]
            if rank >= 0:
                out.append(rank)
                at = end
                rank = best[at] if at < n else -1
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a single byte")
                dead[at] = 1
                last = out.pop()
                at -= sizes[last]
                rank = shorter[last]
        return out

    def _fresh(self, word: str) -> bytes:
        ids = array("I", self.encode_piece(word.encode("utf-8")))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _word(self, word: str) -> bytes:
        known = self.words.get(word)
        if known is None:
            known = self._fresh(word)
            if len(word) <= LONGEST_MEMO:
                if len(self.words) >= MEMO:
                    self.words.clear()
                self.words[word] = known
        return known

    def _pretokens(self, chunk: str) -> bytes:
        words = self.split(chunk)
        # a chunk of one pretoken is remembered as the chunk
        return self._fresh(words[0]) if len(words) == 1 else b"".join(map(self._word, words))

    def forget(self) -> None:
        """Empty the memos."""
        for memo in (self.words, self.first, self.later, self.compatible):
            memo.clear()

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.plain:
            first, *rest = text.split(" ")
            try:
                return self.first[first] + b"".join(map(self.later.__getitem__, rest))
            except _OddSpace:
                pass
        return self._pretokens(text)

    def decode(self, ids: bytes) -> bytes:
        numbers = array("I", ids)
        if sys.byteorder == "big":
            numbers.byteswap()
        return b"".join(map(self.tokens.__getitem__, numbers))


#: Fixed value: the published pattern at whose single spaces a match always begins.
GPT2_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def codec(file: str, pattern: str) -> Codec:
    """This process's codec for a vocabulary that was sent with addFile."""
    if (file, pattern) not in _CODECS:
        _CODECS[file, pattern] = Codec(read_ranks(SparkFiles.get(file)), pattern)
    return _CODECS[file, pattern]


def encode_batches(batches: Iterator[pa.RecordBatch], file: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, ids binary, decoded binary)."""
    own = codec(file, pattern)
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            ids = [own.encode(text) for text in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(map(own.decode, ids), pa.binary())], ["doc_id", "ids", "decoded"])


def digest_batches(batches: Iterator[pa.RecordBatch], file: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """As encode_batches, with digests in place of the ids and the bytes."""
    own, sha = codec(file, pattern), hashlib.sha256
    for batch in batches:
        counts, ids_sha, bytes_sha = [], [], []
        for text in batch.column(1):
            ids = own.encode(text.as_py())
            counts.append(len(ids) // 4)
            ids_sha.append(sha(ids).hexdigest())
            bytes_sha.append(sha(own.decode(ids)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(bytes_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _stage_batches(batches: Iterator[pa.RecordBatch], file: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """(doc_id, lang, source, text) -> (doc_id, lang, source, n_tokens, ids) after decoding the ids has given the text again."""
    own = codec(file, pattern)
    # other stages share the workers, so the memos go at the end of a partition
    with trimmed(own.forget):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                ids = []
                for text in part.column(3).to_pylist():
                    ids.append(own.encode(text))
                    if own.decode(ids[-1]) != text.encode("utf-8"):
                        raise ValueError("token ids do not decode to their text")
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int64)
                flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                lists = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(flat)).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(np.diff(ends)), lists], ["doc_id", "lang", "source", "n_tokens", "ids"])


def _ship(spark: SparkSession, path: str) -> str:
    """Send the vocabulary to all executors; the name by which they find it."""
    import os

    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def _mapped(rows: DataFrame, work, schema: str, path: str | None, pattern: str | None) -> DataFrame:
    import public_tokenizers

    bounded_batches(rows.sparkSession)
    file = _ship(rows.sparkSession, path or public_tokenizers.path(VOCABULARY))
    pattern = pattern or public_tokenizers.PATTERN
    return rows.mapInArrow(lambda batches: work(batches, file, pattern), schema)


def _apply(docs: DataFrame, work, schema: str, path: str | None, pattern: str | None, id_column: str, text_column: str) -> DataFrame:
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return _mapped(rows, work, schema, path, pattern)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): token ids as little-endian uint32 and the bytes that they decode to."""
    return _apply(docs, encode_batches, "doc_id long, ids binary, decoded binary", path, pattern, id_column, text_column)


def token_digests(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) without moving ids between processes."""
    return _apply(docs, digest_batches, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", path, pattern, id_column, text_column)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all documents."""
    return token_digests(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: (doc_id, lang, source, n_tokens, ids) of each document that is left, ids as an array of token ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    return _mapped(rows, _stage_batches, "doc_id long, lang string, source string, n_tokens long, ids array<int>", None, None)
