"""Operators on bytes and tokens: suffix-array dedup, BPE, WARC, exact dedup, shards."""

from __future__ import annotations

import bisect
import hashlib
import os
import random
import uuid
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import compare, connect
from trawl.llm import bpe, columns, exact_dedup, queries, sharding, suffix_dedup, warc, windows


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, sf, name):
    compare(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLES[name])


# suffix-array dedup


def removed_by_force(texts: list[bytes], length: int) -> list[tuple[int, int, bytes]]:
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((sum(gone), runs, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


def check_repeats(got, rows):
    want = removed_by_force([(t or "").encode() for _, t in rows], windows.LENGTH)
    expected = Counter((i, len((t or "").encode()), n, s, hashlib.sha256(left).hexdigest(), left) for (i, t), (n, s, left) in zip(rows, want, strict=True))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in got.collect()) == expected


def test_repeats_edges(make, edges):
    check_repeats(suffix_dedup.remove_repeats(make(edges)), edges)
    assert suffix_dedup.remove_repeats(make([])).count() == 0


def test_repeats_periodic_and_overlapping(make):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    base = " ".join(word() for _ in range(200))
    rows = [(0, base), (1, base[150:600]), (2, "x" * 900), (3, "y" * 199), (4, "ab" * 300 + base[:210]), (5, base[:199]), (6, base[40:239]), (7, "stutter " * 120), (8, "é" * 300)]
    for i in range(9, 25):
        at = rng.randrange(len(base) - 260)
        rows.append((i, word() + " " + base[at : at + rng.choice([150, 199, 200, 201, 230, 260])] + " " + word()))
    check_repeats(suffix_dedup.remove_repeats(make(rows)), rows)


def test_repeats_of_test_data(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    check_repeats(suffix_dedup.remove_repeats(docs), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_split_collections_find_the_same(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    check_repeats(suffix_dedup.remove_repeats(docs, collection_limit=0), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_one_repeated_byte(make, monkeypatch):
    """20 MB of one byte, and texts that are taken in parts, are a few runs and not a piece a byte."""
    data = np.frombuffer(b"z" * 50_000 + b"ab" * 5_000 + b"stutter " * 3_000, np.uint8)
    found = windows.pieces(data, np.array([0, 50_000, 60_000, len(data)]))
    assert len(found["text"]) < 30 and found["times"].sum() > 50_000
    long = "z" * 20_000_000
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.remove_repeats(make([(0, long), (1, "only once " * 3)])).select("doc_id", "n_bytes", "n_removed", "n_spans").collect()}
    assert got == {0: (20_000_000, 20_000_000, 1), 1: (30, 0, 0)}


def test_texts_taken_in_parts():
    """The windows of the pieces of a text are the same ones whether it is cut whole or in parts."""
    import pyarrow as pa

    rng = random.Random(6)
    text = "".join(rng.choice("abcd ") for _ in range(9000)) + "q" * 700 + "ab" * 300
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text])], ["id", "mark", "text"])

    def starts(size):
        old, suffix_dedup.CHUNK = suffix_dedup.CHUNK, size
        try:
            out = set()
            for b in suffix_dedup._find_pieces(iter([batch])):
                for r in b.to_pylist():
                    step = r["reach"] // (r["times"] - 1) if r["times"] > 1 else 1
                    for k in range(r["times"]):
                        core = r["core_at"] + k * step
                        out |= {(s, core) for s in range(core - r["left"], core + r["right"] - windows.SPREAD + 2)}
            return out
        finally:
            suffix_dedup.CHUNK = old

    assert starts(1000) == starts(1 << 20)
    assert {s for s, _ in starts(1000)} == set(range(len(text) - windows.LENGTH + 1))


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_construction_order_and_prefixes(tmp_path, monkeypatch, block):
    """Every column's order and prefixes against sorted suffixes, read in blocks; the files go again."""
    monkeypatch.setattr(columns, "BLOCK", block)
    rng = random.Random(5)
    spread = 9
    left = ["".join(rng.choice("ab") for _ in range(rng.randint(0, spread - 1))).encode() for _ in range(60)]
    right = ["".join(rng.choice("ab") for _ in range(rng.randint(0, spread - 1))).encode() for _ in range(60)]
    core = np.array([rng.randrange(3) for _ in range(60)])
    made = columns.Collection(core, left, right, spread, f"file://{tmp_path}")
    for distance, blocks in made.columns():
        parts = list(blocks)
        order, prefix = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else ([], [])
        key = lambda i, d=distance: (list(left[i][len(left[i]) - d :]), int(core[i]), list(right[i]))
        keys = [key(i) for i in order]
        assert keys == sorted(keys)
        assert sorted(order) == [i for i in range(60) if len(left[i]) >= distance]
        for n in range(1, len(order)):
            a, b = ([*k[0], 1000 + k[1], *k[2]] for k in (keys[n - 1], keys[n]))
            common = next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert prefix[n] == common
    made.close()
    assert not list(tmp_path.iterdir())
    weight = np.array([rng.choice([1, 1, 1, 2]) for _ in range(60)])
    again = columns.Collection(core, left, right, spread, f"file://{tmp_path}")
    got = {(int(s), d) for s, near, far in zip(*again.repeated(weight), strict=True) for d in range(near, far + 1)}
    seen = Counter()
    window = lambda i, d: (left[i][len(left[i]) - d :], int(core[i]), right[i][: spread - 1 - d])
    exists = [(i, d) for i in range(60) for d in range(spread) if d <= len(left[i]) and spread - 1 - d <= len(right[i])]
    for i, d in exists:
        seen[d, window(i, d)] += int(weight[i])
    assert got == {(i, d) for i, d in exists if seen[d, window(i, d)] > 1} != set()


# byte-level BPE


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))
    return bpe.Codec(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(tokenizers):
    ours, theirs = tokenizers
    rng = random.Random(1)
    pieces = [" ", "  ", "\n", "\t", "\x1c", "\x1f", "\x85", " ", " ", "​", "　", "'s", "'ll", "a", "B", "é", "ß", "1", "٣", "½", "!!", "😀", "字", "́", "\x00", "\r\n", "the", "ing", "﻿"]
    for _ in range(4000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        ids = ours.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(t), repr(t)
        assert ours.decode(ids) == t.encode()


def test_bpe_long_pretoken(tokenizers):
    ours, theirs = tokenizers
    for t in ("a" * 20_000, "ab" * 5_000, "".join(random.Random(2).choice("abcdefgh") for _ in range(20_000))):
        assert np.frombuffer(ours.encode(t), "<u4").tolist() == theirs.encode_ordinary(t)


def test_bpe_frames(make, edges, tokenizers):
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.token_digests(make(edges)).collect())
    want = Counter()
    for i, t in edges:
        ids = np.array(tokenizers[1].encode_ordinary(t or ""), "<u4")
        want[i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    assert bpe.encode(make([])).count() == 0
    assert all(bytes(r["decoded"]) == (t or "").encode() for r, (_, t) in zip(bpe.encode(make(edges)).orderBy(F.col("doc_id").isNull(), "doc_id").collect(), sorted(edges, key=lambda e: (e[0] is None, e[0] or 0)), strict=True))


# WARC


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "x" * 2000
    rows = [(1, "https://e.com/1", big), (2, None, big), (9, "https://e.com/9", big), (3, "u\r\nX: y", "tiny"), (4, "v", "tiny"), (5, "w", None), (6, "z", ""), (None, "n", big), (7, "é", "é" * 600)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    warc.write(pages, str(tmp_path / "a"))
    back = {r["page_id"]: r for r in warc.read(spark, str(tmp_path / "a")).collect()}
    assert len(back) == len(rows)
    for i, _, h in rows:
        raw = (h or "").encode()
        assert back[i]["payload_bytes"] == len(raw)
        assert back[i]["payload_digest"] == hashlib.sha1(raw).hexdigest()
        assert back[i]["payload"] is None if i in (1, 2) else bytes(back[i]["payload"]) == raw
    assert [(back[i]["record_type"], back[i]["refers_to"]) for i in (1, 2, 9, 3, None)] == [("revisit", 9), ("revisit", 9), ("response", None), ("response", None), ("response", None)]
    assert back[3]["target_uri"] == "u%0D%0AX: y"


def test_warc_pushdown_skips_payloads(spark, tmp_path):
    pages = spark.range(50).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.col("id").cast("string"), 5000).alias("html"))
    warc.write(pages, str(tmp_path / "a"))
    one = warc.read(spark, str(tmp_path / "a")).filter("page_id = 7 AND record_type = 'response'")
    assert [r["payload_bytes"] for r in one.collect()] == [5000]
    heads = warc.read(spark, str(tmp_path / "a"), payload=False)
    assert heads.filter("payload IS NOT NULL").count() == 0 and heads.count() == 50
    rejected = warc.WarcReader({"path": "x"})
    assert list(rejected.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload",), b"")])) == [warc.EqualTo(("payload",), b"")]


def test_warc_reads_foreign_archives(spark, tmp_path):
    import gzip

    record = warc.record_bytes(5, "response", "u", "d" * 40, 3, None, b"abc")
    (tmp_path / "a.warc").write_bytes(record + record)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record))
    back = warc.read(spark, str(tmp_path))
    assert [bytes(r["payload"]) for r in back.collect()] == [b"abc"] * 4
    assert gzip.decompress(warc.gzip_member(b"data")) == b"data"


def test_warc_empty(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "a"))
    assert warc.read(spark, str(tmp_path / "a")).count() == 0


# exact dedup


def test_exact_dedup_edges(spark, make, edges, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", 4)
    got = exact_dedup.dedup(make(edges), index).collect()
    assert len(got) == len(edges)
    keep = {}
    import re

    for i, t in edges:
        n = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        keep.setdefault(n, []).append(i)
    want = Counter((i, min((x for x in ids if x is not None), default=None), len(ids)) for ids in keep.values() for i in ids)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == want
    assert index.rows().count() == len(keep)
    index.drop()


def test_exact_dedup_persists(spark, make, tmp_path):
    path = f"file://{tmp_path}/index"
    index = exact_dedup.DigestIndex(spark, path, 4)
    exact_dedup.dedup(make([(5, "a b"), (6, "c")]), index)
    again = exact_dedup.dedup(make([(1, "a  b"), (2, "d"), (3, "d")]), exact_dedup.DigestIndex(spark, path, 4))
    assert {r["doc_id"]: (r["keep_id"], r["kept"]) for r in again.collect()} == {1: (5, False), 2: (2, True), 3: (2, False)}
    exact_dedup.dedup(make([(1, "a  b"), (2, "d")]), index)
    assert index.rows().count() == 3
    assert exact_dedup.dedup(make([]), index).count() == 0
    index.drop()
    assert not (tmp_path / "index").exists()


IN_A_NEW_PROCESS = """
import sys
from trawl.llm import exact_dedup
from trawl.session import build_session
spark = build_session("again", cores=2, shuffle_partitions=2, memory="1g")
docs = spark.createDataFrame([(1, "a  b"), (9, "new")], "doc_id long, text string")
index = exact_dedup.DigestIndex(spark, sys.argv[1], 7)
found = exact_dedup.dedup(docs, index).collect()
print("FOUND", index.buckets, *sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in found))
"""


def test_exact_dedup_index_opens_in_a_new_process(spark, make, tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    path = f"file://{tmp_path}/index"
    index = exact_dedup.DigestIndex(spark, path, 4)
    exact_dedup.dedup(make([(5, "a b"), (6, "c")]), index)
    said = subprocess.run([sys.executable, "-c", IN_A_NEW_PROCESS, path], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parents[2])}, capture_output=True, text=True, timeout=300, check=False)
    assert "FOUND 4 (1, 5, False) (9, 9, True)" in said.stdout, said.stderr[-2000:]
    spark.catalog.refreshTable(index._table(index.generation, 4))
    assert {r["keep_id"] for r in index.rows().collect()} == {5, 6, 9}
    index.drop()


def test_exact_dedup_index_is_compacted(spark, make, monkeypatch, tmp_path):
    monkeypatch.setattr(exact_dedup, "COMPACT_AFTER", 3)
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", 2)
    first = index.generation
    for k in range(7):
        exact_dedup.dedup(make([(10 * k, f"text {k}"), (10 * k + 1, "common"), (10 * k + 2, f"text {k - 1}")]), index)
    assert {r["keep_id"] for r in index.rows().collect()} == {0, 1, 2, 10, 20, 30, 40, 50, 60}
    assert index.generation != first and not (tmp_path / "index" / first).exists()
    assert len(index.known().inputFiles()) <= 2 * 2
    plan = index.rows()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    index.drop()


@pytest.mark.parametrize("step", ["_write", "_point", "_make", "remove"])
def test_exact_dedup_index_survives_a_crash(spark, make, monkeypatch, tmp_path, step):
    """A compaction that dies at any step leaves all digests, to this session and the next."""
    path = f"file://{tmp_path}/index"
    index = exact_dedup.DigestIndex(spark, path, 2)
    exact_dedup.dedup(make([(1, "a"), (2, "b")]), index)

    def die(*_):
        raise RuntimeError("lost")

    def half(self, name, content):
        self._files.create(self._paths(f"{self.path}/{name}"), False).close()
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        if step == "remove":
            m.setattr(exact_dedup, "remove", die)
        else:
            m.setattr(exact_dedup.DigestIndex, step, half if step == "_make" else die)
        with pytest.raises(RuntimeError):
            index.compact()
    for opened in (index, exact_dedup.DigestIndex(spark, path)):
        assert {r["keep_id"] for r in opened.rows().collect()} == {1, 2}
    again = exact_dedup.DigestIndex(spark, path)
    got = exact_dedup.dedup(make([(7, "a"), (8, "c")]), again).collect()
    assert {r["doc_id"]: r["keep_id"] for r in got} == {7: 1, 8: 8}
    again.compact()
    assert {r["keep_id"] for r in again.rows().collect()} == {1, 2, 8}
    assert [x.name for x in (tmp_path / "index").glob("generation-*")] == [again.generation]
    again.drop()


# shards


@pytest.mark.parametrize("hot", [False, True])
def test_shards_are_even(make, hot):
    rng = random.Random(7)
    rows = [(i, "same text " * 20 if hot and i % 3 == 0 else "".join(rng.choice("abc ") for _ in range(rng.randint(0, 300)))) for i in range(3000)]
    got = sharding.shard(make(rows), shards=10).select("document.*", *[F.col(c).alias(f"own_{c}") for c in ("size", "shard", "slot", "crc32")]).collect()
    assert len(got) == len(rows)
    sizes, slots = Counter(), {}
    for r in got:
        assert r["own_size"] == len((r["text"] or "").encode()) + 16
        assert r["own_crc32"] == zlib.crc32((r["text"] or "").encode())
        sizes[r["own_shard"]] += r["own_size"]
        slots.setdefault(r["own_shard"], []).append(r["own_slot"])
    assert set(sizes) == set(range(10))
    assert max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 10 + 700
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def sharded_by_force(rows, shards, cuts, tolerance):
    """Sort all keys, and take for each splitter the boundary that the rounds of probing must end with."""
    import struct

    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keyed = []
    for i, t in rows:
        high = (xxhash.xxh64_intdigest((t or "").encode(), 42) >> 25) << 24
        low = (42 if i is None else xxhash.xxh64_intdigest(struct.pack("<q", i), 42)) & ((1 << 24) - 1)
        keyed.append((high | low, -(1 << 63) if i is None else i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())))
    assert all(signed(k[0]) >= 0 for k in keyed)
    total, edges = sum(k[2] for k in keyed), []
    allowed = tolerance * total / sharding.SHARDS
    for n in range(1, shards * cuts):
        target, prefix, shift = total * n // (shards * cuts), 0, 63
        below, inside = 0, total
        while shift and inside > allowed:
            step = min(shift, 13 if shift == 63 else 5)
            children = Counter()
            for k in keyed:
                if k[0] >> shift == prefix:
                    children[k[0] >> (shift - step)] += k[2]
            shift -= step
            for child in sorted(children):
                prefix, inside = child, children[child]
                if below + inside >= target:
                    break
                below += inside
        edges.append((prefix + (2 * (target - below) > inside)) << shift)
    edges.sort()
    out = Counter()
    place: dict[int, int] = {}
    for key, i, size, crc in sorted(keyed):
        no = bisect.bisect_right(edges, key) // cuts
        out[None if i == -(1 << 63) else i, size, crc, no, place.get(no, 0)] += 1
        place[no] = place.get(no, 0) + 1
    return out


def test_shards_equal_brute_force(make, edges):
    rng = random.Random(17)
    rows = edges + [(20 + i, "".join(rng.choice("abc ") for _ in range(rng.randint(0, 90)))) for i in range(400)]
    got = Counter((r["i"], r["size"], r["crc32"], r["shard"], r["slot"]) for r in sharding.shard(make(rows), shards=7, cuts=3).select(F.col("document.doc_id").alias("i"), "size", "crc32", "shard", "slot").collect())
    assert got == sharded_by_force(rows, 7, 3, sharding.TOLERANCE)


def test_shards_edges(make, edges, clashes):
    got = sharding.shard(make(edges), shards=4)
    assert got.count() == len(edges)
    assert all(r[c] == c for r in got.select("document.*").collect() for c in clashes)
    assert sharding.shard(make([])).count() == 0
