"""Worked cases and invariants of the functions, apart from the test tables."""

from __future__ import annotations

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trawl.functions import fuzzy, html, suffixes, text, urls, vectors
from trawl.operators import clustering, crawl, focus, ranking, segment_index, site_files, store, wrapper
from trawl.plans import url_queries
from trawl.sources import files
from trawl.streaming import frontier


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("url", "want"), [
    ("https://example.com/novice/svet/X.html?q=a%2C+b&sort=score&t=article", "https://example.com/novice/svet/X.html"),
    ("https://example.com/spored/kanal?e=12817738", "https://example.com/spored/kanal?e=12817738"),
    ("https://example.com/kljucna-beseda/RUSIJA", "https://example.com/kljucna-beseda/RUSIJA"),
    ("http://www.a.co.uk/x//y/../z/?b=2&e=1#f", "https://a.co.uk/x/z?e=1"),
    ("https://t.example.net/r?x=1&amp;redir=https%3A%2F%2Fwww.example.com%2Fa%2Fb.html%3Futm%3D1", "https://example.com/a/b.html"),
    ("https://www.example.com:8080", "https://example.com/"),
    ("https://localhost/a", "https://localhost./a"),
])
def test_canonical(spark, url, want):
    got = value(spark, urls.canonical(F.lit(url), trackers=("t.example.net",)))
    assert got == want
    assert value(spark, urls.canonical(F.lit(got))) == got or "localhost" in url


def test_canonical_agrees_between_column_and_python(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("url", urls.canonical(F.col("url")).alias("c")).collect()
    assert all(html.canonical_url(r["url"]) == r["c"] for r in rows)


def test_link_metadata(spark):
    link = F.lit("https://example.com/novice/svet/c-d.html")
    assert value(spark, urls.section(link)) == "novice"
    assert value(spark, urls.topic(link)) == "svet"
    assert value(spark, urls.link_title(link)) == "c d"


def test_metadata_sentence(spark):
    got = value(spark, text.metadata_sentence(F.array(F.lit("c d")), F.array().cast("array<string>"), F.array(F.lit("svet"), F.lit("novice"), F.lit("svet"))))
    assert got == "Naslovi: c d. Ključne besede: novice, svet."
    none = F.array().cast("array<string>")
    assert value(spark, text.metadata_sentence(none, none, none)) == ""


def test_bow_cosine(spark):
    a, b = "This is one example sentence.", "An example sentence is a sentence that serves as an example"
    assert value(spark, text.bow_cosine(text.tokens(F.lit(a)), text.tokens(F.lit(b)))) == pytest.approx(5 / (4 * math.sqrt(5)))


@pytest.mark.parametrize(("lengths", "compat", "want"), [((3, 3, 7, 1), False, 4), ((7, 1), True, 3), ((7, 1), False, 2), ((2, 2, 1), False, 1)])
def test_sentence_chunks(spark, lengths, compat, want):
    t = " ".join(" ".join(["w"] * n) + "." for n in lengths)
    got = value(spark, text.sentence_chunks(F.lit(t), 5, compat))
    assert len(got) == want
    assert " ".join(c for c in got if c) == t
    if compat:
        assert got[0] == ""


def test_fixed_chunks(spark):
    assert [len(c) for c in value(spark, text.fixed_chunks(F.lit("x" * 120), 50))] == [50, 50, 20]
    assert value(spark, text.fixed_chunks(F.lit(""), 50)) == []


def test_onclick(spark):
    assert value(spark, urls.onclick_candidates(F.lit("location.href='/a.html'"))) == ["/a.html", "/a.html"]
    assert value(spark, urls.onclick_candidates(F.lit(None).cast("string"))) == []


def test_ndcg(spark):
    rows = spark.createDataFrame([(1, 4.0, 7.0), (1, 3.0, 0.0), (1, 2.0, 15.0), (1, 1.0, 1.0)], "q int, s double, g double")
    at = lambda k, full=False: ranking.ndcg(rows, "q", "s", "g", k, full).first()["ndcg"]
    assert at(4) == pytest.approx(0.749663, abs=1e-6)
    assert at(2) == pytest.approx(1.0)
    assert at(2, True) == pytest.approx(0.360518, abs=1e-6)


def test_ndcg_ties_and_zeros(spark):
    tied = spark.createDataFrame([(1, 1.0, 3.0), (1, 1.0, 0.0), (2, 1.0, 0.0)], "q int, s double, g double")
    got = {r["q"]: r["ndcg"] for r in ranking.ndcg(tied, "q", "s", "g", 1, True).collect()}
    assert got == {1: pytest.approx(0.5), 2: 0.0}


def test_minmax_keeps_order_and_bears_equal_scores(spark):
    rows = spark.createDataFrame([(1, 0, 2.0), (1, 1, 4.0), (1, 2, 3.0), (2, 0, 5.0)], "q int, p int, s double")
    got = rows.select("q", "p", ranking.minmax("s", "q").alias("v")).orderBy("q", "p").collect()
    assert [r["v"] for r in got] == [0.0, 1.0, 0.5, None]


def test_resize(spark):
    assert value(spark, vectors.resize(vectors.literal([1, 2, 3]), 5)) == [1, 2, 3, 0, 0]
    assert value(spark, vectors.resize(vectors.literal([1, 2, 3, 4, 5]), 3)) == [1, 2, 3]


def test_vector_checks():
    with pytest.raises(ValueError):
        vectors.check_size([0.0] * 3)
    with pytest.raises(ValueError):
        vectors.distance("cos_similarity", F.col("a"), F.col("b"))


def test_fuzzy_goldens():
    assert fuzzy.compare("lorem ipsum dolor sit amet", "lorem ipsum dolor sit amet") == 9
    assert fuzzy.hash_compare("3:JBo8MRwRn:J3PR", "3:JBo8MRwx:J3Px") == 8
    assert fuzzy.fuzzy_hash("lorem ipsum dolor sit amet") == "3:JBo8MRwRn:J3PR"
    assert fuzzy.fuzzy_hash("Lorem ipsum dolor sit amet") == "3:f4oo8MRwRn:f4kPR"


def test_fuzzy_sql_functions(spark):
    fuzzy.register(spark)
    assert spark.sql("SELECT fuzzy_compare('lorem ipsum dolor sit amet', 'lorem ipsum dolor sit amet') AS v").first()["v"] == 9


#: Three pages of one made-up template: a recipe with an optional note and a list of steps.
RECIPES = (
    "<html><body><section><h2>Soup</h2><em>for two</em><ol><li>peel</li><li>boil</li></ol></section></body></html>",
    "<html><body><section><h2>Bread</h2><ol><li>mix</li><li>knead</li><li>bake</li></ol></section></body></html>",
    "<html><body><section><h2>Tea</h2><ol><li>steep</li></ol></section></body></html>",
)


def test_wrapper(spark):
    soup, bread, tea = map(wrapper.tree_of, RECIPES)
    learnt = wrapper.align(soup, bread)
    assert wrapper.spelled(learnt) == "body/[section/[h2/[#PCDATA], (em/[for two])?, ol/[(li/[#PCDATA])+]]]"
    assert wrapper.extract(tea, learnt) == ["Tea", "steep"]
    assert wrapper.align_simple(tea, bread)[1][0][1][-1][1][-1] == "?"
    frame = spark.createDataFrame([("s", i, p) for i, p in enumerate(RECIPES)], "site string, n int, html string")
    got = frame.join(wrapper.learn(frame, "site", "html", "n"), "site").select("n", wrapper.extract_column(F.col("html"), F.col("wrapper")).alias("t")).orderBy("n").collect()
    assert got[2]["t"] == ["Tea", "steep"]


def test_article():
    page = """<html><head><meta property="og:title" content="X | site.com"><title>no</title></head><body>
    <div><div><div><picture tabindex="0" class="media-object"></picture></div></div><p>Lead.</p></div>
    <div id="article-body">One <script>a()</script> tail <b>two</b></div></body></html>"""
    got = html.article(page, "site.com")
    assert got["title"] == "X"
    assert got["article_content"] == "Lead. One two"
    assert html.article("") == {"title": "", "article_content": ""}
    assert html.article(None)["article_content"] == ""


def test_cleaned():
    long = "A paragraph that is long enough to be kept by the filter."
    page = f"<title>T</title><nav>n</nav><div>uporabljamo piškotke</div><article><p>{long}<p>short<p>{long}</article>"
    got = html.cleaned(page)
    assert got == {"title": "T", "summary": long, "body": f"{long}\n{long}"}


def test_page_object():
    page = '<a href="/a/?x=1">1</a><a href="/a">2</a><a href="mailto:x">3</a><a href="/d.PDF">4</a><img src="/i.png?w=1"><img src="/i.png"><img src="/n.txt"><img src="/b.BMP">'
    got = html.page_object(page, "https://www.example.com/p")
    assert got["links"] == ["https://example.com/a"]
    assert got["page_data"] == [{"url": "https://example.com/d.PDF", "data_type_code": "PDF"}]
    assert got["images"] == [{"url": "https://example.com/i.png", "filename": "i.png", "content_type": "png"}, {"url": "https://example.com/b.BMP", "filename": "b.BMP", "content_type": "bmp"}]
    assert html.page_object("", "https://example.com/x.docx")["page_type_code"] == "BINARY"


def test_signature():
    assert html.signature_text("<article>A <i>b</i><div id=comments_placeholder>no</div><script>x</script></article>") == "A b"
    assert html.signature_text('<div id="pageContent"><p id="z9"></p><p id="clip1"></p><h1>Head</h1></div>') == "head z"
    assert html.signature_text("<p>nothing</p>") == ""


def test_length_is_computed_once_a_vector(spark):
    frame = spark.createDataFrame([([3.0, -4.0],), ([0.0, 0.0],), (None,)], "v array<double>").select(vectors.normalised(F.col("v")).alias("u"))
    assert [r["u"] for r in frame.collect()] == [[0.6, -0.8], [0.0, 0.0], None]
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1


def test_references_end_with_a_semicolon():
    cut = "<title>A&amp;&amp</title><body><div id='article-body'>x &lt y &#233; &lt;</div><!-- <script> --><article>b &nbsp;c&amp</article>"
    assert html.article(cut) == {"title": "A&&amp", "article_content": "x &lt y é <"}
    assert html.signature_text(cut) == "b c&amp"
    assert html.element_text("<div class='k'><script>a &amp b && c</script></div>", "div", "k") == ["a &amp b && c"]
    assert html.anchors('<a href="/a?e=1&copy=2&amp;e=3">t</a>', "https://e.com/")[0]["url"] == "https://e.com/a?e=1&e=3"


def test_first_best():
    assert clustering.first_best([(35, 0.1), (36, 0.4), (37, 0.2), (38, 0.4)]) == 36


def test_mmr_prefers_variety():
    assert clustering.mmr([1.0, 0.99, 0.5], [[1, 0], [1, 0.01], [0, 1]], 2, 0.5) == [0, 2]


def test_partial_update_tells_null_from_absent(spark):
    rows = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "id int, x string, y string")
    change = spark.createDataFrame([(1, {"x": None})], "id int, set map<string, string>")
    got = {tuple(r) for r in store.partial_update(rows, change, "id").collect()}
    assert got == {(1, None, "b"), (2, "c", "d")}


def test_frontier_discards_stale(spark):
    rows = spark.createDataFrame([(0.1, "a", 0, 1, 1), (0.5, "a", 1, 1, 1), (0.3, "b", 0, 1, 2)], "priority double, url string, version int, from_page int, frontier_page int")
    assert [r["url"] for r in crawl.frontier_next(rows, 5).collect()] == ["b", "a"]


def test_crawl_rounds(spark):
    pages = spark.createDataFrame([("a",), ("b",), ("k",), ("c",)], "url string")
    links = spark.createDataFrame([("a", "b"), ("a", "k"), ("b", "c"), ("c", "a"), ("b", "elsewhere")], "source string, target string")
    got = [(r["round"], r["url"]) for r in crawl.crawl_rounds(pages, links, "a", 10, 1, keyword="k").orderBy("round").collect()]
    assert got == [(0, "a"), (1, "k"), (2, "b"), (3, "c")]
    assert {r["round"] for r in crawl.crawl_rounds(pages, links, "a", 2, 1).collect()} == {0, 1}
    assert crawl.crawl_rounds(pages, links, "nowhere", 3, 1).count() == 0


def test_page_source(spark):
    rows = spark.createDataFrame([("https://www.e.com/a/", '<a href="/b">x</a><a href="/b/">x</a>'), ("http://e.com/a", '<a href="//e.com/c">x</a>')], "url string, html string")
    pages, found = crawl.page_source(rows)
    assert [r["url"] for r in pages.collect()] == ["https://e.com/a"]
    assert sorted((r["source"], r["target"]) for r in found.collect()) == [("https://e.com/a", "https://e.com/b"), ("https://e.com/a", "https://e.com/c")]


def test_delay_schedule_in_buckets(spark):
    rows = spark.range(500).select("id", F.concat(F.lit("d"), (F.col("id") % 3).cast("string")).alias("domain"), (F.col("id") % 7).cast("double").alias("delay"))
    whole = {r["id"]: r["start"] for r in crawl.delay_schedule(rows, "domain", "id", "delay").collect()}
    parts = {r["id"]: r["start"] for r in crawl.delay_schedule(rows, "domain", "id", "delay", F.floor(F.col("id") / 40)).collect()}
    assert whole == parts and whole[6] == 3.0


class LetterCounts:
    """An embedder whose vectors can be worked out by hand."""

    name, size = "letters", 3

    def embed(self, texts):
        import numpy as np

        return np.array([[t.count(c) for c in "xyz"] for t in texts], float).reshape(len(texts), 3)


def test_rescoring_adds_metadata_up(spark):
    schema = "page_id int, url string, section string, topic string, link_title string, summary string, label string, keywords array<string>"
    first = spark.createDataFrame([(1, "u", "x-x", None, "", None, None, []), (1, "v", "y", None, "", None, None, None), (1, "u", "x-x", None, "", None, None, [])], schema)
    later = spark.createDataFrame([(2, "u", "x-x", "y", "a_y.", "z...", "l-z", ["q-q", ""]), (3, "u", "x-x", "y", "a_y.", "z...", "l-z", ["q-q", ""])], schema)
    known = crawl.prioritised(crawl.gathered(first), "xx", LetterCounts())
    assert {r["url"]: (r["seen"], r["priority"]) for r in known.collect()} == {"u": (1, -1.0), "v": (1, 0.0)}
    after = {r["url"]: r for r in crawl.rescored(known, crawl.gathered(later), "xx", LetterCounts()).collect()}
    # Naslovi: a y.. Povzetki: z. Ključne besede: l-z, q q, x x, y.  (x, y, z: 2, 2, 3)
    assert after["u"]["seen"] == 3 and after["u"]["priority"] == pytest.approx(-2 / (4 + 4 + 9) ** 0.5)
    assert (after["v"]["seen"], after["v"]["priority"]) == (1, 0.0)


def test_merged_links_of_a_page(spark):
    page = """<div id="article-keywords"><a href="/k">one </a></div>
    <ul class="menu__items"><li><div><a href="/a/b.html"><p class="summary">First</p></a></div></li></ul>
    <div id="footer-bottom"><p><a href="/a/b.html"><span class="label">L</span></a></p></div><a href="/spored/x">s</a>"""
    rows = spark.createDataFrame([(1, page)], "page_id int, html string")
    found = rows.select("page_id", F.posexplode(html.anchors_column(F.col("html"), F.lit("https://e.com/p"))).alias("at", "a"))
    got = {r["url"]: r for r in url_queries.merge_anchors(found).collect()}
    both = got["https://e.com/a/b.html"]
    assert (both["seen"], both["summary"], both["label"], both["containers"]) == (2, "First", None, ["menu", "footer"])
    assert got["https://e.com/spored/x"]["containers"] == ["spored"] and got["https://e.com/k"]["keywords"] == ["one"]


def test_boxes_replace_containers():
    """Each rule of the boxes, on a page whose addresses are canonical and on one whose are not."""
    page = """<a onclick="location.href='/a/x.html'"><p class="summary">late</p></a><ul class="menu__items"><li><b><a href="/a/x.html"><p class="summary">early</p></a></b></li></ul>
    <div id="related-articles"><a href="/a/x.html">1</a><a href="/a/y.html">2</a><a href="/a/z.html?utm=1">3</a></div><a class="read-more" href="/a/y.html">more</a><a class="read-more">none</a>
    <div id="proad"><a href="/vsebine/oglasevanje">ads</a><a href="https://e.com/spored/q">q</a></div>"""

    def merged(base):
        out = {}
        for a in html.anchors(page, base):
            own = out.setdefault(a["url"], (a["summary"], []))
            own[1].extend(a["containers"])
        return out

    assert merged("https://e.com/p") == {
        "https://e.com/a/x.html": ("early", ["related-articles"]), "https://e.com/a/y.html": (None, ["read-more"]), "https://e.com/a/z.html": (None, []),
        "https://e.com/vsebine/oglasevanje": (None, []), "https://e.com/spored/q": (None, ["proad"]),
    }
    # joined addresses of this page are not canonical, so only the absolute one is found
    assert {k: v[1] for k, v in merged("https://www.e.com/p").items()} == {
        "https://e.com/a/x.html": ["menu"], "https://e.com/a/y.html": [], "https://e.com/a/z.html": [], "https://e.com/vsebine/oglasevanje": [], "https://e.com/spored/q": ["proad"],
    }


def test_upserts_over_several_batches(spark, tmp_path):
    """A source of five files, one a micro-batch, folded every second batch; counts of changed windows likewise."""
    for k in range(5):
        spark.createDataFrame([("a", 0.5 - k / 10, f"2024-01-01 0{k % 2}:10:00"), (f"u{k}", 0.3, "2024-01-01 05:00:00")], "url string, priority double, at string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("url string, priority double, at string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table = f"file://{tmp_path}/table"
    frontier.run_upserts(source.select("url", "priority"), str(tmp_path / "c1"), table, compact_after=2)
    got = {r["url"]: (r["priority"], r["seen"]) for r in frontier.state(spark, table).collect()}
    assert got == {"a": (pytest.approx(0.1), 5)} | {f"u{k}": (0.3, 1) for k in range(5)}
    assert sorted(p.name for p in (tmp_path / "table-folds").iterdir()) == ["upto=1", "upto=3"]
    timed = source.select(F.to_timestamp("at").alias("ts"), F.lit("t").alias("event_type"))
    frontier.run_counts(frontier.event_counts(timed, late=None), str(tmp_path / "c2"), f"file://{tmp_path}/counts")
    counts = {str(r["start"]): r["events"] for r in frontier.latest_counts(spark, f"file://{tmp_path}/counts").collect()}
    assert counts == {"2024-01-01 00:00:00": 3, "2024-01-01 01:00:00": 2, "2024-01-01 05:00:00": 5}


HOSTS = {
    "www.example.com": "example.com", "a.b.co.kr": "b.co.kr", "x.com.tr": "x.com.tr", "co.uk": ".co.uk", "localhost": "localhost.", "a.unknowntld": "unknowntld.",
    "a.www.ck": "www.ck", "b.c.ck": "b.c.ck", "x.city.kobe.jp": "city.kobe.jp", "a.b.c.kobe.jp": "b.c.kobe.jp", "example.org": "example.org", "a.b.sch.uk": "a.b.sch.uk",
}


def test_registered_domains(spark):
    rows = spark.createDataFrame([(f"https://u@{h}:8080/p",) for h in HOSTS], "u string")
    assert [r[0] for r in rows.select(urls.registered_domain(F.col("u"))).collect()] == list(HOSTS.values())
    assert {h: suffixes.load().registered(h) for h in HOSTS} == HOSTS


def test_suffixes_of_a_file(tmp_path):
    (tmp_path / "list").write_text("// comment\nzz\n*.yy\n!k.yy\n===END ICANN DOMAINS===\nqq\n")
    rules = suffixes.load(str(tmp_path / "list"))
    assert [rules.registered(h) for h in ("a.b.zz", "a.b.yy", "a.k.yy", "a.qq")] == ["b.zz", "a.b.yy", "k.yy", "qq."]


def test_fuzzy_hash_of_many_sizes():
    """Against the definition, byte by byte."""
    rng = random.Random(8)

    def by_byte(data):
        ring, h1, h2, h3, rolled = [0] * 7, 0, 0, 0, []
        for n, c in enumerate(data):
            h2 = (h2 - h1 + 7 * c) % 2**32
            h1 = (h1 + c - ring[n % 7]) % 2**32
            ring[n % 7] = c
            h3 = (h3 << 5) % 2**32 ^ c
            rolled.append((h1 + h2 + h3) % 2**32)

        def signed(block, limit):
            piece, out = 0x28021967, ""
            for c, r in zip(data, rolled, strict=True):
                piece = piece * 0x01000193 % 2**32 ^ c
                if r % block == block - 1 and len(out) < limit - 1:
                    out, piece = out + fuzzy.ALPHABET[piece % 64], 0x28021967
            return out + (fuzzy.ALPHABET[piece % 64] if rolled and rolled[-1] else "")

        block = 3
        while block * 64 < len(data):
            block *= 2
        while block > 3 and len(signed(block, 64)) < 32:
            block //= 2
        return f"{block}:{signed(block, 64)}:{signed(2 * block, 32)}"

    for size in (0, 1, 6, 7, 50, 191, 192, 193, 1000, 5000):
        for alphabet in (b"ab", bytes(range(256))):
            data = bytes(rng.choice(alphabet) for _ in range(size))
            assert fuzzy.fuzzy_hash(data) == by_byte(data)
    assert fuzzy.fuzzy_hash(b"z" * 900) == by_byte(b"z" * 900) and fuzzy.fuzzy_hash(bytes(300)) == by_byte(bytes(300))


def test_edit_distance():
    """Against the table of all prefixes."""
    rng = random.Random(9)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next_row(row, i, x, b)
        assert fuzzy.edit_distance(a, b) == row[-1]


def _next_row(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (0 if x == y else 2)))
    return out


def test_explained_variance(spark):
    import numpy as np

    x = np.random.default_rng(3).normal(size=(60, 7)) + 1
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    want = (u[:, :3] * s[:3]).var(axis=0, ddof=1).sum() / x.var(axis=0, ddof=1).sum()
    frame = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>")
    assert clustering.explained_variance(frame, "v", 3) == pytest.approx(want)


def test_robots(spark):
    text_ = "User-agent: *\nDisallow: /x\nCrawl-delay: 3"
    rows = spark.createDataFrame([("https://e.com/x/1", text_), ("https://e.com/y", text_), ("https://e.com/y", None), ("https://e.com/x", "")], "u string, r string")
    got = [(r["allowed"], r["crawl_delay"]) for r in crawl.robots_allowed(rows, "u", "r", "bot").collect()]
    assert got == [(False, 3.0), (True, 3.0), (False, 1.0), (True, 1.0)]


def test_settings_and_results(spark, tmp_path):
    s = files.Settings.of({"CHUNK_WORDS": "64", "RERANK": "True"})
    assert (s.chunk_words, s.rerank, s.metric) == (64, True, "cosine")
    (tmp_path / "cosine.json").write_text('{"embedding_model": "m", "reranking_enabled": false, "average_results": {"ndcg@2": 0.5, "ndcg@10": null, "ndcg@3": 0.7}}')
    (tmp_path / "skip.txt").write_text("no")
    rows = files.read_results(spark, str(tmp_path))
    assert sorted((r["k"], r["ndcg"]) for r in rows.collect()) == [(2, 0.5), (3, 0.7)]
    assert files.curve_means(rows).first()["mean_ndcg"] == pytest.approx(0.6)


def test_migrate(spark):
    assert files.migrate(spark, "CREATE OR REPLACE TEMP VIEW one AS SELECT 1 AS x; CREATE OR REPLACE TEMP VIEW two AS SELECT x + 1 AS x FROM one;") == 2
    assert spark.table("two").first()["x"] == 2


@given(st.text(alphabet="ab./:?#&=e%2F", max_size=30))
@settings(max_examples=200, deadline=None)
def test_canonical_python_is_idempotent(tail):
    try:
        once = html.canonical_url("https://www.example.com/" + tail)
    except ValueError:
        return
    if "?" not in once and "%" not in once:
        assert html.canonical_url(once) == once


def test_models(spark, tmp_path):
    from trawl.operators import models
    from trawl.sources.cache import cached

    e = models.HashedEmbedder(16).embed(["one two", "", "two one"])
    assert (e[0] == e[2]).all() and not e[1].any()
    assert models.OverlapReranker().score("one two", ["two x", ""]) == [0.5, 0.0]
    assert models.model_folder("a/b") == "a_b"
    assert models.TemplateGenerator().answer(value(spark, text.rag_prompt(F.lit("ctx"), F.lit("q")))) == "ctx"
    rows = spark.createDataFrame([("aa bb", "aa"), ("aa bb", "zz"), (None, None)], "q string, t string")
    assert [r[0] for r in rows.select(models.rerank_column(F.col("q"), F.col("t"), models.OverlapReranker())).collect()] == [0.5, 0.0, 0.0]
    made = []
    for k in (1, 1, 2):
        got = cached(spark, str(tmp_path), "x", {"k": k}, lambda k=k: made.append(k) or spark.range(k))
        assert got.count() == k
    assert made == [1, 2]


def test_append_segments_prunes_by_model(spark, tmp_path):
    files.append_segments(spark.createDataFrame([(1, 10, "a"), (2, 20, "b")], "id int, model_id int, page_segment string"), str(tmp_path / "s"))
    files.append_segments(spark.createDataFrame([(3, 10, "c")], "id int, model_id int, page_segment string"), str(tmp_path / "s"))
    one = spark.read.parquet(str(tmp_path / "s")).filter("model_id = 10")
    assert one.count() == 2 and "PartitionFilters: [isnotnull(model_id" in one._jdf.queryExecution().toString()


def test_numbering_in_buckets(spark):
    rows = spark.range(300).select("id", F.when(F.col("id") % 4 > 0, F.lit("hot")).otherwise(F.when(F.col("id") % 8 > 0, F.lit("x"))).alias("g"))
    got = {r["id"]: (r["n"], r["group_size"]) for r in ranking.numbered(rows, "g", "id", F.floor(F.col("id") / 16), "n").collect()}
    groups = {}
    for i in range(300):
        groups.setdefault("hot" if i % 4 else "x" if i % 8 else None, []).append(i)
    assert got == {i: (n, len(v)) for v in groups.values() for n, i in enumerate(v)}


def test_segment_index(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 24))
    data = centres[rng.integers(0, 40, 6000)] + 0.6 * rng.normal(size=(6000, 24))
    data[:50] = data[0]
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(9001, None), (9002, [0.0] * 24)]
    frame = spark.createDataFrame(rows, "id long, embedding array<double>")
    table, index = f"file://{tmp_path}/t", f"file://{tmp_path}/i"
    segment_index.load(frame.filter("id < 3000"), table, index)
    segment_index.load(frame.filter("id >= 3000"), table, index)
    found = {}
    for r in segment_index.search(spark, index, frame.filter("id % 20 = 0 AND id < 9000"), 10, size=256).collect():
        found.setdefault(r["query_id"], set()).add(r["id"])
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    hits = sum(len(found[q] & set(np.lexsort((np.arange(6000), np.round(1 - unit @ unit[q], 12)))[:10].tolist())) for q in range(0, 6000, 20))
    assert set(found) == set(range(0, 6000, 20)) and hits / 3000 >= 0.9
    assert spark.read.parquet(f"{index}/cells").count() == 6000
    segment_index.drop(spark, index)
    segment_index.drop(spark, index)
    assert not (tmp_path / "i").exists()


def test_site_files(spark):
    fetched = [
        ("a/robots.txt", "User-agent: *\nCrawl-delay: 4\n\nUser-agent: me\nCrawl-delay: 9\nSITEMAP: a/s.xml\nSitemap: a/t.xml"), ("a/s.xml", "<urlset><url><loc> a/1 </loc></url><url><loc>a/2</loc></url></urlset>"),
        ("b/robots.txt", "User-agent: *\nDisallow: /x"), ("c/robots.txt", "Sitemap: c/gone.xml\nUser-agent: *\nCrawl-delay: 5"), ("c/gone.xml", None), ("e/robots.txt", "User-agent: *\nCrawl-delay: 3"),
    ]
    domains = spark.createDataFrame([(d,) for d in "abcde"], "domain string")
    table = spark.createDataFrame(fetched, "url string, content string")
    got = {r["domain"]: (r["robots_content"], r["sitemap_content"], r["delay"]) for r in site_files.site_rows(domains, table, "me").collect()}
    assert got == {"a": (fetched[0][1], fetched[1][1], 9.0), "b": (fetched[2][1], None, 1.0), "c": ("", "", 1.0), "d": ("", "", 1.0), "e": (fetched[5][1], None, 3.0)}
    assert value(spark, site_files.sitemap_urls(F.lit(fetched[1][1]))) == ["a/1", "a/2"]

    def get(url):
        if url == "bad":
            raise OSError
        return url.upper()

    urls_ = spark.createDataFrame([("x",), ("bad",), ("x",)], "url string")
    assert {tuple(r) for r in site_files.fetched_by(urls_, get).collect()} == {("x", "X"), ("bad", None)}


def test_focus(spark):
    docs = spark.createDataFrame([("s", "ball goal goal"), ("s", "goal team"), ("p", "vote party"), (None, "vote")], "c string, t string")
    model = focus.train(docs, "c", "t")
    pages = spark.createDataFrame([(1, "goal goal"), (2, "vote vote"), (3, "other"), (4, None)], "k int, t string")
    got = {r["k"]: (r["relevance"], r["in_focus"]) for r in focus.relevance(pages, "k", "t", model, ("s",)).collect()}
    # five terms: 5 words of s and 2 of p; goal has 3 and 0 of them
    s, p = 2 / 3 * (4 / 10) ** 2, 1 / 3 * (1 / 7) ** 2
    assert got[1] == (pytest.approx(s / (s + p)), True)
    s, p = 2 / 3 * (1 / 10) ** 2, 1 / 3 * (2 / 7) ** 2
    assert got[2] == (pytest.approx(s / (s + p)), False)
    assert got[3] == got[4] == (pytest.approx(2 / 3), True)


def test_lemmas(spark):
    from trawl.operators import models

    class Table:
        def analyse(self, text):
            return [{"ran": ("run", "VERB"), "the": ("the", "DET"), "dogs": ("dog", "NOUN"), "in": ("in", "NOUN")}[w] for w in text.split()]

    rows = spark.createDataFrame([("the dogs ran in",), (None,)], "t string")
    assert [r[0] for r in rows.select(models.lemma_column(F.col("t"), Table(), text.STOP_WORDS)).collect()] == ["dog run", ""]
    assert models.SurfaceAnalyser().analyse("Ana je 12 velika, ž") == [("ana", "PROPN"), ("je", "NOUN"), ("12", "NUM"), ("velika", "NOUN"), (",", "PUNCT"), ("ž", "PART")]


def test_only_local_sessions_go_without_a_shared_folder():
    from types import SimpleNamespace

    from trawl import scratch

    lonely = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        scratch.shared_dir(lonely)
    shared = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: "hdfs://host/shared/"), sparkContext=lonely.sparkContext)
    assert scratch.shared_dir(shared) == "hdfs://host/shared"


def test_scratch_tables_go(spark):
    from pathlib import Path

    from trawl import scratch

    with scratch.Scratch(spark) as own:
        first = own.write(spark.range(5), "first")
        second = own.replace(first, first.filter("id > 2"), "second")
        at = [Path(p.removeprefix("file://")) for p in own.paths]
        assert second.count() == 2 and len(at) == 1 and at[0].exists()
    assert not at[0].exists()
    kept = scratch.materialise(spark.range(3), "kept")
    assert kept.count() == 3
    place = Path(scratch._HANDED_OUT[-1][1].removeprefix("file://"))
    scratch.release()
    assert not place.exists() and not scratch._HANDED_OUT
