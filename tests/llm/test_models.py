"""Near duplicates, neighbours, personal data, classifier, mixing and the pipeline."""

from __future__ import annotations

import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trawl.llm import ann, components, mixing, near_dedup, pii, quality, queries

# near duplicates


def classes_by_force(rows, threshold=0.8):
    sets = {}
    for i, t in rows:
        w = [x.lower() for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        sets[i] = (Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both, any_ = sum((sets[a] & sets[b]).values()), sum((sets[a] | sets[b]).values())
            if both >= threshold * any_ and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: find(i) for i in ids}


def edited(words, rng, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_near_classes_of_test_data(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs).collect()}
    assert got == classes_by_force([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_near_classes_of_a_group(make):
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(140)]
    rows = [(i, edited(base, rng, rng.randint(1, 4))) for i in range(120)] + [(200 + i, " ".join(f"z{rng.randrange(10**6)}" for _ in range(30))) for i in range(20)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(make(rows)).collect()}
    assert got == classes_by_force(rows)


def test_near_classes_edges(make, edges):
    got = [(r["doc_id"], r["class_id"]) for r in near_dedup.near_classes(make(edges)).collect()]
    assert Counter(i for i, _ in got) == Counter(i for i, _ in edges)
    by_id = dict(got)
    assert by_id[3] == 2 and by_id[None] == 2 and by_id[1] == 0 and by_id[7] == 4 and by_id[5] == 5
    assert near_dedup.near_classes(make([])).count() == 0


def test_signatures_estimate_similarity():
    import pyarrow as pa

    from trawl.llm.shared import byte_column

    rng = random.Random(2)
    base = [f"w{k}" for k in range(400)]
    texts = [" ".join(base)] + [edited(base, rng, n) for n in (2, 5, 12, 25)]
    keys, bounds, _ = near_dedup.cells(*byte_column(pa.array(texts)))
    found = near_dedup.signatures(keys, bounds)
    for i in range(1, 5):
        exact = near_dedup.similarity(keys[bounds[0] : bounds[1]], keys[bounds[i] : bounds[i + 1]])
        assert abs((found[0] == found[i]).mean() - exact) < 0.15


def test_signatures_of_real_weights():
    """Elements 0 to 299 in two texts with weights of their own, as unit cells of which the last may be a part."""
    rng = np.random.default_rng(8)
    first = rng.uniform(0.2, 3, 300)
    second = np.where(rng.random(300) < 0.3, rng.uniform(0.2, 3, 300), first)
    keys, parts, bounds = [], [], [0]
    for weights in (first, second):
        for element, w in enumerate(weights):
            whole = int(np.ceil(w))
            keys += [element * 1000 + c for c in range(whole)]
            parts += [1.0] * (whole - 1) + [w - (whole - 1)]
        bounds.append(len(keys))
    keys = near_dedup.mix64(np.array(keys, np.uint64))
    found = near_dedup.signatures(keys, np.array(bounds), 2048, 2048 * np.log(2048) + 4096, np.array(parts))
    exact = np.minimum(first, second).sum() / np.maximum(first, second).sum()
    assert abs((found[0] == found[1]).mean() - exact) < 0.04
    assert (near_dedup.signatures(keys, np.array(bounds)) == near_dedup.signatures(keys, np.array(bounds), parts=np.ones(len(keys)))).all()


def test_no_possible_pair_is_left_out():
    """All pairs of random multisets with similarities around the threshold, sizes from one cell to thousands."""
    rng = np.random.default_rng(3)
    cells = []
    for size in (1, 2, 5, 9, 40, 300, 3000):
        base = rng.integers(0, 2**63, size).astype(np.uint64)
        for _ in range(12):
            own = base.copy()
            changed = rng.random(size) < rng.uniform(0, 0.25)
            own[changed] = rng.integers(0, 2**63, int(changed.sum())).astype(np.uint64)
            cells.append(own[: max(1, int(size * rng.uniform(0.85, 1)))])
    n = len(cells)
    want = {(p, q) for p in range(n) for q in range(n) if near_dedup.similarity(cells[p], cells[q]) >= 0.8}
    got = {(int(p), int(q)) for ps, qs in near_dedup.possible_pairs(cells, np.arange(n), np.arange(n), 0.8) for p, q in zip(ps, qs, strict=True)}
    assert want <= got and len(want) > 2 * n and len(got) < 1.6 * len(want)


def test_links_between_components_of_a_bucket(spark):
    """Members of one bucket, in blocks of 8, against brute force over all pairs, with sketches as far apart as they may be."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 100).astype(np.uint64)
    rows, cells = [], {}
    for node in range(70):
        own = base.copy()
        change = rng.choice(100, rng.integers(4, 14), replace=False)
        own[change] = rng.integers(0, 2**63, len(change)).astype(np.uint64)
        cells[node] = own
        rows.append((node, [77, 88] + [1000 * node + b for b in range(near_dedup.BANDS - 2)], bytearray(own.tobytes())))
    part = {k: 0 if k % 3 == 0 else k for k in cells}
    known = spark.createDataFrame(rows, "node long, bands array<long>, cells binary")
    labelled = spark.createDataFrame([(b, k, part[k]) for b in (77, 88) for k in cells], "bucket long, node long, part long")
    old, near_dedup.BLOCK = near_dedup.BLOCK, 8
    try:
        got = {(r["u"], r["v"]) for r in near_dedup.links_left(labelled, labelled.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), known, 0.8).collect()}
    finally:
        near_dedup.BLOCK = old
    want = {tuple(sorted((part[a], part[b]))) for a in cells for b in range(a) if part[a] != part[b] and near_dedup.similarity(cells[a], cells[b]) >= 0.8}
    assert got == want and 20 < len(want)
    assert near_dedup._links_between(pa.table({"bucket": pa.array([], pa.int64())}), 0.8).num_rows == 0


def test_near_classes_with_salted_joins(make, monkeypatch):
    """Groups of exact and of near copies, with every key of more than a few rows dealt over salts."""
    from trawl.llm import shared

    monkeypatch.setattr(shared, "LEAST_HOT", 3)
    rng = random.Random(13)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    rows = [(i, " ".join(base) if i % 3 else edited(base, rng, 1)) for i in range(60)] + [(100 + i, " ".join(f"z{rng.randrange(10**6)}" for _ in range(20))) for i in range(9)]
    got = near_dedup.near_classes(make(rows))
    assert {r["doc_id"]: r["class_id"] for r in got.collect()} == classes_by_force(rows)
    assert sum(r["first"] for r in got.collect()) == len(set(classes_by_force(rows).values()))
    assert near_dedup.stage(None, make(rows), "").count() == len(set(classes_by_force(rows).values()))


def test_near_classes_of_repeated_ids(make):
    """Rows that repeat an id are classed by their own texts, and the stage keeps one row of each class."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (3, b + " more"), (None, a + " end"), (None, c), (None, c), (8, c + " end"), (9, "x"), (9, "x")]
    got = Counter((r["doc_id"], r["class_id"], r["first"]) for r in near_dedup.near_classes(make(rows)).collect())
    assert got == Counter([(5, 5, True), (5, 3, False), (3, 3, True), (None, 5, False), (None, 8, False), (None, 8, False), (8, 8, True), (9, 9, True), (9, 9, True)])
    kept = Counter((r["doc_id"], r["text"]) for r in near_dedup.stage(None, make(rows), "").collect())
    assert kept == Counter([(5, a), (3, b + " more"), (8, c + " end"), (9, "x")])


def test_salted_join(spark):
    from trawl.llm import shared

    many = spark.range(5000).select(F.when(F.col("id") % 3 > 0, F.lit(1)).otherwise(F.col("id")).alias("k"), "id")
    one = spark.range(0, 5000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w")).unionByName(spark.createDataFrame([(1, 7)], "k long, w long"))
    old, shared.LEAST_HOT = shared.LEAST_HOT, 100
    try:
        for how in ("inner", "left"):
            want = Counter(map(tuple, many.join(one, "k", how).collect()))
            assert Counter(map(tuple, shared.salted_join(many, one, "k", how).collect())) == want
    finally:
        shared.LEAST_HOT = old


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}


# neighbours


def vectors_frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, shard string")


def test_recall(spark, sf):
    rows = ann.usable(spark.read.parquet(f"{sf}/embeddings.parquet")).persist()
    got = defaultdict(list)
    for r in ann.search(ann.build(rows, shard_size=200), rows.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    data = {r["vec_id"]: np.array(r["vector"], float) for r in rows.collect()}
    hits = total = 0
    for q, found in got.items():
        want = sorted(((-float(data[q] @ v), i) for i, v in data.items() if i != q))[:20]
        assert len(found) == 20 and q not in dict(found)
        assert all(abs(s - data[q] @ data[i]) < 1e-9 for i, s in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        hits += len({i for _, i in want} & set(dict(found)))
        total += 20
    assert len(got) == 25 and hits / total >= 0.9


def test_recall_of_full_shards(spark):
    """20,000 clustered vectors, in three shards of up to 8,192 that are searched with the production beam."""
    rng = np.random.default_rng(31)
    centres = rng.normal(size=(250, 48))
    data = (centres[rng.integers(0, 250, 20_000)] + 0.7 * rng.normal(size=(20_000, 48))).astype(np.float32)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(data.tolist())], "vec_id long, embedding array<float>")
    usable = ann.usable(rows)
    index = ann.build(usable)
    assert index.count() >= 2
    queries = usable.filter("vec_id % 20 = 0")
    got = defaultdict(set)
    for r in ann.search(index, queries).collect():
        got[r["query_id"]].add(r["vec_id"])
    asked = np.arange(0, 20_000, 20)
    score = data[asked].astype(float) @ data.astype(float).T
    score[np.arange(len(asked)), asked] = -np.inf
    want = np.argsort(-score, axis=1, kind="stable")[:, :20]
    recall = sum(len(got[int(q)] & set(w.tolist())) for q, w in zip(asked, want, strict=True)) / want.size
    print(f"recall {recall:.4f}")
    assert set(got) == set(asked.tolist()) and recall >= 0.95
    # a group for each shard gives the same neighbours
    apart = {(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(index, queries.filter("vec_id < 2000"), group_bytes=1).collect()}
    assert {(q, v) for q, _, v in apart} == {(q, v) for q in got if q < 2000 for v in got[q]}


def test_neighbours_edges(spark):
    same = [1.0, 0.0]
    rows = [(i, same) for i in range(0, 60)] + [(100, None), (101, [0.0, 0.0]), (102, [float("nan"), 1.0]), (103, [1.0, None]), (104, [1.0]), (None, same), (105, [0.5, 0.5]), (5, same)]
    usable = ann.usable(vectors_frame(spark, rows))
    assert sorted(r["vec_id"] for r in usable.collect()) == [*range(60), 105]
    found = ann.search(ann.build(usable), usable.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in found if r["query_id"] == 40] == list(range(20))
    assert [r["vec_id"] for r in found if r["query_id"] == 0] == list(range(1, 21))
    few = ann.usable(vectors_frame(spark, [(0, [1.0, 2.0]), (1, [2.0, 1.0])]))
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in ann.search(ann.build(few), few.filter("vec_id % 20 = 0")).collect()] == [(0, 1, 4.0)]
    none = ann.usable(vectors_frame(spark, []))
    assert ann.search(ann.build(none), none).count() == 0


# personal data


def base_by_force(x):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 16 <= len(pii.digits_of(m.group())) <= 19 and pii.luhn(pii.digits_of(m.group()))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 8 <= len(pii.digits_of(m.group())) <= 15]


def test_base_spans():
    rng = random.Random(2)
    parts = ["a", "@", ".", "1", "-", "+", "_", "23", "255", "4111111111111111", " ", "(", ")", "b.c", "@", "é", "٣", "007"]
    for _ in range(20_000):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(0, 16)))
        assert pii.base_spans(x) == base_by_force(x), x
    assert pii.base_spans("1" * 200_000) == [] and pii.base_spans("a@" * 50_000) == []


@pytest.mark.parametrize("text", ["a" * 1_000_000 + "@ ", "a." * 500_000 + "@b", "x@" + "a" * 1_000_000, "1.2." * 250_000, "+1" + "(" * 1_000_000, "4 " * 500_000, "token=" * 150_000, "Mr " * 300_000])
def test_scans_are_linear(text):
    began = time.process_time()
    pii.candidates(text)
    assert time.process_time() - began < 2


def planted(rng, n):
    """(texts, spans that are personal by kind, spans that only look so) in prose of made-up words."""
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvz") for _ in range(rng.randint(2, 9)))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    prose = lambda: " ".join(word() for _ in range(rng.randint(15, 40)))

    def wrong_card():
        while pii.luhn(number := digits(16)):
            pass
        return number

    personal = {
        "secret": lambda: (f'{rng.choice(["token", "password", "api_key"])} = "', "".join(rng.choice("0123456789abcdef") for _ in range(32)), '"'),
        "national_id": lambda: (rng.choice(["my ssn is ", "social security ", ""]), f"{rng.randint(100, 599)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", ""),
        "near_phone": lambda: (rng.choice(["call ", "phone ", "tel ", ""]), f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{digits(4)}", ""),
        "name": lambda: ("Dr. ", f"{rng.choice(sorted(pii.GIVEN_NAMES)).title()} {word().title()}", ""),
    }
    alike = {
        "secret": lambda: ("secret: ", word()[:5] + "word", ""),
        "national_id": lambda: ("order number ", f"{rng.choice(['000', '666', '900'])}-00-{digits(4)}", " | 12345678"),
        "near_phone": lambda: ("item | ", f"111-111 {digits(0)}1111"[:11].replace("111-111 ", "111 111 "), " | 99887766 |"),
        "near_card": lambda: rng.choice([("| 445566 | ", wrong_card(), " | 778899 |"), ("", wrong_card(), "")]),
    }
    texts, yes, no = [], set(), set()
    for i in range(n):
        parts = [prose()]
        for k, (table, out) in enumerate(((personal, yes), (alike, no))):
            if rng.random() < 0.5:
                kind = rng.choice(sorted(table))
                head, span, tail = table[kind]()
                start = len(" ".join(parts)) + 1 + len(head)
                parts.append(head + span + tail)
                out.add((i, kind, start, start + len(span)))
            parts.append(prose())
        texts.append((i, " ".join(parts)))
    return texts, yes, no


def test_added_spans_of_planted_texts(spark, make):
    texts, yes, no = planted(random.Random(23), 1500)
    found = {(r["doc_id"], s["kind"], s["start"], s["end"]) for r in pii.find(make(texts)).collect() for s in r["spans"] if not s["base"]}
    recall, precision = len(found & yes) / len(yes), len(found & yes) / len(found)
    print(f"recall {recall:.3f} precision {precision:.3f} of {len(yes)} planted and {len(no)} look-alikes")
    assert recall >= 0.95 and precision >= 0.9


def test_pii_of_test_data_and_edges(spark, make, edges):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    secrets, kinds = set(), Counter()
    for r in pii.find(docs).collect():
        base = [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]]
        assert base == base_by_force(texts[r["doc_id"]])
        kinds.update(s["kind"] for s in r["spans"] if not s["base"])
        secrets |= {(r["doc_id"], s["start"], s["end"]) for s in r["spans"] if s["kind"] == "secret"}
    # of the numbers that only look like cards none is added, and the tokens that are planted are all found
    assert secrets >= {(i, *m.span(1)) for i, t in texts.items() for m in re.finditer(r'token = "([0-9a-f]+)"', t)} != set()
    assert not kinds["near_card"]
    assert all(r["spans"] == [] for r in pii.find(make(edges)).collect())
    assert pii.find(make([])).count() == 0


def test_em_learns_who_is_right():
    """Labelers whose reliability differs by kind, and one that never votes on one of them."""
    rng = random.Random(4)
    counts, truths = Counter(), defaultdict(Counter)
    for kind, rights in (("secret", (0.95, 0.9, 0.6)), ("name", (0.6, 0.9, 0.95))):
        for _ in range(4000):
            truth = rng.random() < 0.5
            said = tuple(int(truth) if rng.random() < right else int(not truth) for right in rights) + (-1,)
            counts[kind, said] += 1
            truths[kind, said][truth] += 1
    patterns = [(k, v, n) for (k, v), n in counts.items()]
    posterior, trust, rate = pii.expectation_maximisation(patterns)
    for kind, rights in (("secret", (0.95, 0.9, 0.6)), ("name", (0.6, 0.9, 0.95))):
        assert np.abs(trust[kind][:3].mean(axis=1) - rights).max() < 0.05
        assert abs(rate[kind] - 0.5) < 0.1
    wrong = sum(truths[k, v][x < 0.5] for (k, v, _), x in zip(patterns, posterior, strict=True))
    assert wrong / 8000 < 0.08


# classifier


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op7_quality_ftrl"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = [(r["held_out"], r["predicted"] == r["quality"]) for r in got.collect()]
    held = [ok for out, ok in rows if out]
    assert sum(held) / len(held) >= 0.95


MASK = (1 << 64) - 1


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def naive_features(text, bits):
    """Runs of letters, digits and non-ASCII bytes, or of other non-space bytes; their hashes and those of neighbours."""
    kind = lambda b: 0 if b == 32 or 9 <= b <= 13 else 1 if b >= 128 or chr(b).isalnum() else 2
    runs, raw = [], text.encode()
    for k, b in enumerate(raw):
        if k and kind(raw[k - 1]) == kind(b):
            runs[-1].append(b)
        else:
            runs.append([b])
    hashes = [mixed(sum((b + 33 if 65 <= b <= 90 else b + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, b in enumerate(r)) & MASK) for r in runs if kind(r[0])]
    out = Counter()
    for k, h in enumerate(hashes):
        same = 0x5EED if k and hashes[k - 1] == h else h
        out[mixed(same) & ((1 << bits) - 1)] += 1
        if k:
            out[mixed((hashes[k - 1] * 3 + same) & MASK) & ((1 << bits) - 1)] += 1
    return out, len(hashes)


def scalar_ftrl(rows, bits, epochs):
    """One coordinate at a time; rows are (text, label)."""
    import math

    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(epochs):
        for text, label in rows:
            found, runs = naive_features(text, bits)
            x = {i: quality.SCALE * c / max(1, runs) for i, c in found.items()} | {-1: 1.0}
            p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - label) * v
                w = weight(i)
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w
                n[i] += g * g
    return {i: weight(i) for i in z}


def test_ftrl_equals_a_scalar_loop(spark, make):
    import math

    rng = random.Random(12)
    words = ["The", "cat", "cat", "ÉTÉ", "x1", "!!", "a-b", "<p>", "\n", "  "]
    rows = [(" ".join(rng.choice(words[: 6 + 4 * label]) for _ in range(rng.randint(0, 25))), label) for label in (0, 1) * 40]
    rng.shuffle(rows)
    import pyarrow as pa

    model = quality.fit(pa.array([t for t, _ in rows]), np.array([y for _, y in rows]), bits=10, epochs=3)
    want = scalar_ftrl(rows, 10, 3)
    assert model.bias == pytest.approx(want.pop(-1))
    assert {i: w for i, w in enumerate(model.weights) if w} == {i: pytest.approx(w) for i, w in want.items() if w}
    scores = model.scores(pa.array([t for t, _ in rows]))
    for (text, _), score in zip(rows, scores, strict=True):
        found, runs = naive_features(text, 10)
        assert score == pytest.approx(1 / (1 + math.exp(-(model.bias + sum(quality.SCALE * c / max(1, runs) * model.weights[i] for i, c in found.items())))))
    # the distributed fit learns from the same vectors in the order of the ids' hashes
    labels = spark.createDataFrame([(i, y, 0) for i, (_, y) in enumerate(rows)], "doc_id long, quality int, toxic int")
    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    order = sorted(range(len(rows)), key=lambda i: signed(xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 42)))
    import zlib

    used = [rows[i] for i in order if zlib.crc32(str(i).encode()) % 3 != 1]
    got = quality.train(make([(i, t) for i, (t, _) in enumerate(rows)]), labels)
    same = quality.fit(pa.array([t for t, _ in used]), np.array([y for _, y in used]))
    assert got.bias == pytest.approx(same.bias) and np.allclose(got.weights, same.weights)


def test_classifier_edges(spark, make, edges):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(make(edges), none)
    assert [r["score"] for r in quality.score(make(edges), model).collect()] == [0.5] * len(edges)
    assert quality.score(make([]), model).count() == 0
    odd = spark.createDataFrame([(2, 1, 0), (2, 0, 0), (3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.score(make(edges), quality.train(make(edges), odd)).count() == len(edges)


def test_held_out_rule(spark):
    import zlib

    got = spark.range(100).select("id", quality.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in got)


# mixing


def test_raking_meets_targets():
    rng = random.Random(9)
    cells = [(s, l, t, float(rng.randint(500, 5000))) for s in "abcd" for l in ("x", "y", "z") for t in "pq"]
    p = mixing.rake(cells, {"source": dict.fromkeys("abcd", 1.0), "lang": {"x": 2.0, "y": 1.0, "z": 1.0}, "topic": {"p": 1.0, "q": 1.0}}, keep=0.2, rounds=200)
    kept = p * np.array([c[3] for c in cells])
    assert kept.sum() == pytest.approx(0.2 * sum(c[3] for c in cells))
    for k, share in ((0, {"a": 0.25, "d": 0.25}), (1, {"x": 0.5, "y": 0.25}), (2, {"p": 0.5})):
        for name, want in share.items():
            assert kept[[c[k] == name for c in cells]].sum() / kept.sum() == pytest.approx(want, rel=1e-6)
    assert (p <= 1).all() and (p > 0).all()


def test_table_and_driver_fits_agree(spark, sf):
    rows = mixing.described(spark.read.parquet(f"{sf}/documents.parquet")).select(*mixing.MARGINS, "tokens")
    cells = rows.groupBy(*mixing.MARGINS).agg(F.sum("tokens").cast("double").alias("have"))
    local = sorted((*[r[m] for m in mixing.MARGINS], r["have"]) for r in cells.collect())
    want = dict(zip([c[:3] for c in local], mixing.rake(local, rounds=3), strict=True))
    got = {tuple(r[m] for m in mixing.MARGINS): r["probability"] for r in mixing.rake_table(cells, rounds=3).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_mixing_equals_brute_force(spark):
    """Words, topics, a scalar fit and the draw of each document, all anew."""
    import struct

    import xxhash

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()

    def topic(t):
        if "icense" in t or "rights reserved" in t:
            return "legal"
        if " | " in t:
            return "tabular"
        if "@" in t or "+1 (" in t:
            return "contact"
        return "long" if len(t) >= 2000 else "short"

    words = {r["doc_id"]: len([w for w in re.split(r"[\x20\x09-\x0D]+", r["text"] or "") if w]) for r in docs}
    cell = {r["doc_id"]: (r["source"], r["lang"], topic(r["text"] or "")) for r in docs}
    have = Counter()
    for i, c in cell.items():
        have[c] += words[i]
    total = sum(have.values())
    want = []
    for k in range(3):
        margin = Counter()
        for c, n in have.items():
            margin[c[k]] += n
        power = {name: n**mixing.TEMPERATURE for name, n in margin.items()}
        want.append({name: v / sum(power.values()) * mixing.KEEP * total for name, v in power.items()})
    x = {c: mixing.KEEP * n for c, n in have.items()}
    for _ in range(mixing.ROUNDS):
        for k in range(3):
            now = Counter()
            for c, v in x.items():
                now[c[k]] += v
            x = {c: min(have[c], v * want[k][c[k]] / now[c[k]]) for c, v in x.items()}
    p = {c: x[c] / n if n else 1.0 for c, n in have.items()}

    def drawn(i):
        h = xxhash.xxh64_intdigest(struct.pack("<i", mixing.SEED), xxhash.xxh64_intdigest(struct.pack("<q", i), 42))
        return (h >> 11) * 2.0**-53

    got = {r["doc_id"]: r for r in queries.QUERIES["op10_raking"](spark, sf).collect()}
    assert set(got) == set(cell)
    for i, r in got.items():
        assert (r["source"], r["lang"], r["topic"], r["n_tokens"]) == (*cell[i], words[i])
        assert r["probability"] == pytest.approx(p[cell[i]])
        assert r["kept"] == (drawn(i) < r["probability"])
    assert 0 < sum(r["kept"] for r in got.values()) < len(got)


def test_mixing_edges(spark, make, edges, clashes):
    docs = make(edges).withColumn("lang", F.when(F.col("doc_id") > 4, F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    for most in (mixing.MAX_CELLS, 0):
        got = mixing.mix(docs, max_cells=most).collect()
        assert len(got) == len(edges)
        assert all(0 <= r["probability"] <= 1 for r in got)
        assert all(r["document"][c] == c for r in got for c in clashes)
        assert mixing.mix(make([]), max_cells=most).count() == 0
    assert [r["tokens"] for r in mixing.mix(make([(6, "  spaced   out\n\n text\t")])).collect()] == [3]
    assert {r["topic"] for r in mixing.mix(docs, topic=F.lower).collect()} == {(t or "").lower() for _, t in edges}


# pipeline


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], sf).persist()
        assert out.columns == docs.columns, name
        assert out.join(kept[-1], docs.columns, "left_anti").count() == 0, name
        kept.append(out)
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in kept]
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    squeezed = defaultdict(list)
    for i in ids[1]:
        squeezed[re.sub(r"[\x20\x09-\x0D]+", " ", texts[i])].append(i)
    assert ids[2] == {min(v) for v in squeezed.values()}
    classes = classes_by_force([(i, texts[i]) for i in ids[2]])
    assert ids[3] == {i for i, c in classes.items() if i == c}
    import public_tokenizers
    import tiktoken

    from trawl.llm import bpe

    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY)), special_tokens={})
    about = {r["doc_id"]: (r["lang"], r["source"]) for r in docs.collect()}
    final = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in final} == ids[4]
    for r in final:
        assert (r["lang"], r["source"]) == about[r["doc_id"]]
        assert r["ids"] == theirs.encode_ordinary(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_edges(spark, sf, make, edges, clashes, stage):
    work = dict(corpus_pipeline.STAGES)[stage]
    docs = make(edges)
    blank = docs.select("doc_id", "text", *[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields[2:]])
    for frame in (docs, blank):
        out = work(spark, frame, sf)
        assert out.count() <= len(edges)
        if stage != "byte_bpe":
            assert out.columns == docs.columns
            assert frame is blank or all(r[c] == c for r in out.collect() for c in clashes)
            assert out.count() == 0 or {r["doc_id"] for r in out.collect()} <= {i for i, _ in edges}
    assert work(spark, make([]), sf).count() == 0
