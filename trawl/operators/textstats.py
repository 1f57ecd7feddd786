"""Corpus statistics: TF-IDF, BM25, cluster documents and keywords. Terms are exploded and summed, never gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.functions import text as X
from trawl.scratch import materialise

K1, B = 1.5, 0.75


def term_counts(docs: DataFrame, key: str, text: str, stop: tuple[str, ...] = ()) -> DataFrame:
    """(key, term, tf), pre-aggregated per partition."""
    words = X.tokens(F.col(text))
    if stop:
        words = F.filter(words, lambda w: ~w.isin(*stop))
    return docs.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def tfidf(counts: DataFrame, key: str, n_docs: int, max_features: int) -> DataFrame:
    """(key, term, weight): smoothed idf, unit rows, vocabulary of the max_features most frequent terms (ties by name)."""
    terms = counts.groupBy("term").agg(F.sum("tf").alias("_cf"), F.count("*").alias("_df"))
    vocabulary = terms.orderBy(F.desc("_cf"), "term").limit(max_features)
    idf = F.log((1.0 + n_docs) / (1.0 + F.col("_df"))) + 1.0
    raw = counts.join(vocabulary.select("term", idf.alias("_idf")), "term").withColumn("_w", F.col("tf") * F.col("_idf"))
    norms = raw.groupBy(F.col(key).alias("_k")).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    return raw.join(norms, F.col(key) == F.col("_k")).select(key, "term", (F.col("_w") / F.col("_norm")).alias("weight"))


#: (query, term) rows up to which bm25 hands the queries to every task.
MOST_ASKED = 2_000_000
#: Contributions of a term of a document to a query that are summed at once.
PIECE = 1 << 21


def bm25(docs: DataFrame, queries: DataFrame, key: str, text: str, query_key: str, best: int | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(query_key, key, score) where a query's term occurs in a document; queries is (query_key, term), distinct.

    With `best` at least the best of each query are among the rows. Up to MOST_ASKED rows of queries, counted first, go to the
    tasks; more are joined.
    """
    if queries.limit(MOST_ASKED + 1).count() <= MOST_ASKED:
        return bm25_for_all(docs, queries, key, text, query_key, best, k1, b)
    return bm25_by_join(docs, queries, key, text, query_key, k1, b)


def bm25_by_join(docs: DataFrame, queries: DataFrame, key: str, text: str, query_key: str, k1: float = K1, b: float = B) -> DataFrame:
    """As bm25, for any number of queries. A document's length is the size of its list of tokens, and tokens that no query asks
    for are dropped before anything is counted, so only hits are summed by document and term."""
    words = docs.select(F.col(key).cast("long").alias(key), X.tokens(F.col(text)).alias("_w")).filter(F.size("_w") > 0).withColumn("_len", F.size("_w"))
    size = words.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"))
    asked = queries.select("term").distinct()
    hits = words.select(key, "_len", F.explode("_w").alias("term")).join(asked, "term", "left_semi").groupBy(key, "_len", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("_df"))
    # one row of two numbers
    rows = hits.join(df, "term").join(queries, "term").join(F.broadcast(size), F.lit(True))
    idf = F.log(1.0 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    tf = F.col("tf") / (F.col("tf") + k1 * (1.0 - b + b * F.col("_len") / F.col("_avg")))
    return rows.groupBy(query_key, key).agg(F.sum(idf * tf).alias("score"))


def bm25_for_all(docs: DataFrame, queries: DataFrame, key: str, text: str, query_key: str, best: int | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """As bm25: all documents with a term of the query, or of each batch the `best` highest by rounded score with all ties, which
    hold the best of the whole.

    Documents are reduced to the queries' terms once, as a written table; then each batch of them is scored by sparse sums
    over the lists of queries that ask for a term, PIECE entries at a time. Keys are long, and unique in docs; only the queries
    are held by the tasks.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    asked = queries.select(query_key, "term").collect()
    vocabulary = pa.array(sorted({r["term"] for r in asked}), pa.string())
    where = {t: i for i, t in enumerate(vocabulary.to_pylist())}
    names = sorted({r[query_key] for r in asked})
    row = {q: i for i, q in enumerate(names)}
    at = np.array([(where[r["term"]], row[r[query_key]]) for r in asked], np.int64).reshape(-1, 2)

    def reduced(batches):
        for batch in batches:
            words = batch.column(1)
            flat, parent = words.flatten(), pc.list_parent_indices(words).to_numpy()
            found = pc.index_in(flat.cast(pa.string()), value_set=vocabulary).fill_null(-1).to_numpy()
            lengths = np.bincount(parent, minlength=batch.num_rows).astype(np.int64)
            pairs, tf = np.unique(parent[found >= 0].astype(np.int64) * max(len(vocabulary), 1) + found[found >= 0], return_counts=True)
            ends = np.searchsorted(pairs, np.arange(batch.num_rows + 1, dtype=np.int64) * max(len(vocabulary), 1)).astype(np.int32)
            terms, counts = pa.array((pairs % max(len(vocabulary), 1)).astype(np.int32)), pa.array(tf.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths), pa.ListArray.from_arrays(pa.array(ends), terms), pa.ListArray.from_arrays(pa.array(ends), counts)], ["doc", "len", "terms", "tf"])

    words = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(X.tokens(F.col(text)), F.array().cast("array<string>")).alias("w"))
    small = materialise(words.mapInArrow(reduced, "doc long, len long, terms array<int>, tf array<int>").filter("len > 0"), "bm25")
    size = small.agg(F.count("*").alias("n"), F.avg("len").alias("a")).first()
    idf = np.zeros(len(vocabulary))
    for r in small.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        idf[r["t"]] = np.log(1.0 + (size["n"] - r["count"] + 0.5) / (r["count"] + 0.5))
    average = float(size["a"] or 1.0)
    order = np.argsort(at[:, 0], kind="stable")
    # the queries of each term, one list after the other
    lists = docs.sparkSession.sparkContext.broadcast((np.searchsorted(at[order, 0], np.arange(len(vocabulary) + 1)), at[order, 1], np.array(names, np.int64), idf))

    def scored(batches):
        starts, asking, queries, idf = lists.value
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                terms, tf = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy().astype(float)
                parent = pc.list_parent_indices(batch.column(2)).to_numpy()
                if not len(terms):
                    continue
                doc, length = batch.column(0).to_numpy(), batch.column(1).to_numpy()[parent]
                weight = idf[terms] * tf / (tf + k1 * (1.0 - b + b * length / average))
                many = starts[terms + 1] - starts[terms]
                ends, low, keys, sums = np.cumsum(many), 0, [], []
                while low < len(terms):
                    high = max(low + 1, int(np.searchsorted(ends, ends[low] - many[low] + PIECE, "right")))
                    own = np.repeat(np.arange(low, high), many[low:high])
                    nth = np.arange(len(own)) - np.repeat(np.cumsum(many[low:high]) - many[low:high], many[low:high])
                    part, inverse = np.unique(parent[own] * len(queries) + asking[starts[terms[own]] + nth], return_inverse=True)
                    keys.append(part)
                    sums.append(np.bincount(inverse, weights=weight[own], minlength=len(part)))
                    low = high
                pair, inverse = np.unique(np.concatenate(keys), return_inverse=True)
                score = np.bincount(inverse, weights=np.concatenate(sums), minlength=len(pair))
                row, query = pair // len(queries), pair % len(queries)
                kept = score > 0
                if best is not None:
                    place = np.lexsort((-score, query))
                    firsts = np.searchsorted(query[place], query)
                    last = np.minimum(firsts + best, np.searchsorted(query[place], query, "right")) - 1
                    kept &= score >= score[place][last] - 2e-9
                yield pa.RecordBatch.from_arrays([pa.array(queries[query[kept]]), pa.array(doc[row[kept]]), pa.array(score[kept])], [query_key, key, "score"])

    return small.mapInArrow(scored, f"{query_key} long, {key} long, score double")


def cluster_docs(docs: DataFrame, label: str, key: str, text: str) -> DataFrame:
    """One text a cluster, its documents' texts in order of the key; noise (-1) is left out.

    This gathers a cluster by definition; keyword counts don't need it, see cluster_term_counts.
    """
    rows = docs.filter(F.col(label).cast("string") != "-1")
    return rows.groupBy(label).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, text))), lambda s: s[text]), " ").alias("cluster_text"))


def cluster_term_counts(docs: DataFrame, label: str, text: str, longest: int = 3) -> DataFrame:
    """(label, term, tf) over n-grams of 1..longest tokens, counted per document and summed by cluster."""
    words = X.tokens(F.col(text))

    def grams_of(n: int):
        every = F.transform(F.col("_w"), lambda w, i: F.slice(F.col("_w"), i + 1, n))
        return F.transform(F.filter(every, lambda g: F.size(g) == n), lambda g: F.array_join(g, " "))

    grams = F.concat(*[grams_of(n) for n in range(1, longest + 1)])
    exploded = docs.filter(F.col(label) != -1).select(label, words.alias("_w")).select(label, F.explode(grams).alias("term"))
    return exploded.groupBy(label, "term").agg(F.count("*").alias("tf"))


#: Places in the table that says which terms are frequent; it has a byte for each, whatever the terms, and errs to yes only.
PLACES = 1 << 21


def _chained(hashes, word):
    """The hash of a gram from that of its words but the last, and the last one's."""
    import numpy as np

    x = (hashes * np.uint64(0x9E3779B97F4A7C15)) ^ word
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _frequent_places(terms: DataFrame, n: int):
    """The table of PLACES for terms, n-grams of n words each."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            words = np.array([t.split(" ") for t in batch.column(0).to_pylist()], object).reshape(-1, n)
            hashes = pd.util.hash_array(words[:, 0])
            for k in range(1, n):
                hashes = _chained(hashes, pd.util.hash_array(words[:, k]))
            yield pa.RecordBatch.from_arrays([pa.array((hashes % np.uint64(PLACES)).astype(np.int32))], ["place"])

    out = np.zeros(PLACES, bool)
    out[terms.select("term").mapInArrow(work, "place int").distinct().toArrow()["place"].to_numpy()] = True
    return out


def _spots(lists, n: int, table):
    """(known, at, owner, starts, hashes) of lists of words: the different words, each word's place in them and list, and where
    the n-grams start both of whose n-1-grams are in table, if it is given, with their hashes (for n > 1)."""
    import numpy as np
    import pandas as pd
    import pyarrow.compute as pc

    flat, owner = lists.flatten().dictionary_encode(), pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    known, at = flat.dictionary, flat.indices.to_numpy().astype(np.int64)
    starts = np.flatnonzero(owner[: max(len(owner) - n + 1, 0)] == owner[n - 1 :])
    if table is None or n == 1:
        return known, at, owner, starts, None
    word = pd.util.hash_array(np.array(known.to_pylist(), object))[at]
    hashes, m = word, len(word)
    for k in range(1, n - 1):
        hashes = _chained(hashes[: m - k], word[k:])
    fine = table[hashes % np.uint64(PLACES)]
    starts = starts[fine[starts] & fine[starts + 1]]
    return known, at, owner, starts, _chained(hashes[starts], word[starts + n - 1])


#: Places of a table that leave a task in a row.
CHUNK = 1 << 12


def _possible_places(words: DataFrame, n: int, frequent, least: int):
    """The table of PLACES that n-grams with frequent parts fall on `least` times or more: an n-gram that occurs as often is in it."""
    import numpy as np
    import pyarrow as pa

    given = words.sparkSession.sparkContext.broadcast(frequent)

    def counted(batches):
        hits = np.zeros(PLACES, np.int64)
        for batch in batches:
            hits += np.bincount((_spots(batch.column(1), n, given.value)[4] % np.uint64(PLACES)).astype(np.int64), minlength=PLACES)
        rows = hits.reshape(-1, CHUNK)
        some = np.flatnonzero(rows.any(axis=1))
        for at in range(0, len(some), 64):
            yield pa.RecordBatch.from_arrays([pa.array(some[at : at + 64].astype(np.int32)), pa.array([rows[k].tobytes() for k in some[at : at + 64]], pa.binary())], ["chunk", "hits"])

    def added(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, hits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[chunk] = held.get(chunk, 0) + np.frombuffer(hits, np.int64)
        for chunk, hits in held.items():
            yield pa.RecordBatch.from_arrays([pa.array((np.flatnonzero(hits >= least) + chunk * CHUNK).astype(np.int32))], ["place"])

    out = np.zeros(PLACES, bool)
    found = words.select(F.lit(0).alias("_"), "_w").mapInArrow(counted, "chunk int, hits binary").repartition("chunk").mapInArrow(added, "place int")
    out[found.toArrow()["place"].to_numpy()] = True
    return out


def _gram_counts(words: DataFrame, label: str, n: int, frequent, possible=None) -> DataFrame:
    """(label, term, tf) of the n-grams of words (label, _w) both of whose n-1-grams are frequent, and which are possible, if
    these tables are given."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    given = words.sparkSession.sparkContext.broadcast((frequent, possible))

    def work(batches):
        table, own = given.value
        for batch in batches:
            kinds = batch.column(0).dictionary_encode()
            known, at, owner, starts, hashes = _spots(batch.column(1), n, table)
            if own is not None and hashes is not None:
                starts = starts[own[hashes % np.uint64(PLACES)]]
            if not len(starts):
                continue
            # a column of numbers for each word of the gram; equal rows are counted once
            kind = kinds.indices.to_numpy()[owner[starts]].astype(np.int64)
            inverse = np.unique(kind * len(known) + at[starts], return_inverse=True)[1]
            for k in range(1, n):
                inverse = np.unique(inverse * len(known) + at[starts + k], return_inverse=True)[1]
            where = starts[np.unique(inverse, return_index=True)[1]]
            tf = np.bincount(inverse, minlength=len(where))
            texts = [known.take(pa.array(at[where + k])) for k in range(n)]
            term = texts[0] if n == 1 else pc.binary_join_element_wise(*texts, " ")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[where])), term, pa.array(tf.astype(np.int64))], [label, "term", "tf"])

    kind = words.schema[label].dataType.simpleString()
    return words.mapInArrow(work, f"`{label}` {kind}, term string, tf long").groupBy(label, "term").agg(F.sum("tf").alias("tf"))


def _eligible(counts: DataFrame, clusters: int, min_df: int, max_df: float) -> DataFrame:
    terms = counts.groupBy("term").agg(F.count("*").alias("_df"), F.sum("tf").alias("_cf"))
    return terms.filter((F.col("_df") >= min_df) & (F.col("_df") <= max_df * clusters))


def keyword_term_counts(docs: DataFrame, label: str, text: str, clusters: int, longest: int = 3, min_df: int = 2, max_df: float = 0.85, max_features: int = 15_000) -> DataFrame:
    """As cluster_term_counts, but without n-grams that cannot be in the vocabulary of cluster_keywords (of the same arguments).

    An n-gram occurs at most as often as each of the shorter ones in it. Once there are max_features terms that may be in the
    vocabulary, one with a part that is rarer than all of these has no place there, and is not made. Counts of the others are
    exact, and as long as there are fewer terms everything is counted.
    """
    words = docs.filter(F.col(label) != -1).select(label, F.coalesce(X.tokens(F.col(text)), F.array().cast("array<string>")).alias("_w"))
    words = materialise(words, "words")  # read in each pass
    found, frequent, least = None, None, 0
    for n in range(1, longest + 1):
        # a table of counters first, so that of grams with frequent parts only those that may be frequent too are counted by name
        possible = None if frequent is None else _possible_places(words, n, frequent, least)
        own = materialise(_gram_counts(words, label, n, frequent, possible), "grams")
        found = own if found is None else found.unionByName(own)
        if n < longest:
            top = _eligible(found, clusters, min_df, max_df).orderBy(F.desc("_cf")).limit(max_features).agg(F.count("*").alias("n"), F.min("_cf").alias("least")).first()
            frequent = None
            if top["n"] >= max_features:
                least = top["least"]
                frequent = _frequent_places(own.groupBy("term").agg(F.sum("tf").alias("_cf")).filter(F.col("_cf") >= least), n)
    return found


def cluster_keywords(counts: DataFrame, label: str, clusters: int, top: int = 6, min_df: int = 2, max_df: float = 0.85, max_features: int = 15_000) -> DataFrame:
    """(label, keyword_rank, term): best TF-IDF terms, dropping those that hold or are held by an accepted one.

    A label's terms are gone through in order until `top` are accepted; there are max_features of them at most.
    """
    vocabulary = _eligible(counts, clusters, min_df, max_df).orderBy(F.desc("_cf"), "term").limit(max_features)
    scored = counts.join(vocabulary, "term").withColumn("_s", F.col("tf") * (F.log((1.0 + clusters) / (1.0 + F.col("_df"))) + 1.0))
    ordered = scored.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_s")).alias("s"), "term"))), lambda s: s["term"]).alias("_terms"))
    none = F.array().cast("array<string>")
    accepted = F.aggregate("_terms", none, lambda acc, t: F.when((F.size(acc) >= top) | F.exists(acc, lambda a: F.contains(a, t) | F.contains(t, a)), acc).otherwise(F.concat(acc, F.array(t))))
    return ordered.select(label, F.posexplode(accepted).alias("keyword_rank", "term"))
