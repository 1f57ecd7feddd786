from __future__ import annotations

import pytest

#: Names that the operators use inside; documents carry a column of each.
CLASHES = ("row", "score", "digest", "document", "id", "size", "crc32", "key", "piece", "shard", "slot", "shard_key", "shard_no", "_piece", "_key", "tokens", "topic", "probability", "kept", "_probability", "_topic", "_source", "_tokens", "node", "class_id", "_gone", "kept_id", "kept_digest", "copies", "keep_id", "bucket", "core", "spans", "n", "two words")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


@pytest.fixture(scope="session")
def make(spark):
    """A documents table with extra columns that clash with inner names; rows are (doc_id, text)."""

    def build(rows):
        return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), *CLASHES) for i, t in rows], SCHEMA)

    return build


@pytest.fixture(scope="session")
def clashes():
    """The extra columns of `make`; each holds its own name in every row."""
    return CLASHES


@pytest.fixture(scope="session")
def edges():
    """Null, empty, repeated, very long and ordinary texts; a null id, ties and a repeated row."""
    long = " ".join(f"word{i % 977}x{i % 31}" for i in range(20_000))
    prose = "the quick brown fox jumps over the lazy dog and then it runs away from here to there again " * 4
    return [(0, None), (1, ""), (2, prose), (3, prose), (4, long), (5, "short"), (6, "  spaced   out\n\n text\t"), (None, prose), (7, long + " end"), (5, "short"), (8, "Ünïcode ☃ text 😀 mit ß")]
