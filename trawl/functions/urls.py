"""URL functions as Column expressions; nothing leaves the JVM."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn

from trawl.functions.suffixes import Suffixes, load

ALLOWED_PARAMETERS = ("e",)


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)), r":[0-9]*$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def among(value: Column, names: list[str]) -> Column:
    """value is one of names; thousands of them cross to the JVM as one string and become a hash set in the plan."""
    if not names:
        return F.lit(False)
    if not hasattr(value, "_jc"):
        return value.isin(*names)
    jvm = SparkContext._active_spark_context._jvm
    listed = jvm.java.util.regex.Pattern.compile(",").splitAsStream(",".join(names)).toList()
    return ClassicColumn(value._jc.isInCollection(listed))


def registered_domain(url: Column, rules: Suffixes | None = None) -> Column:
    """Last label before the public suffix, a dot and the suffix; a host without suffix keeps its last label and the dot.

    The longest rule holds; an exception is one label longer than the suffix that it leaves.
    """
    rules = rules or load()
    h = host(url)
    tail = lambda n: F.substring_index(h, ".", -n)
    of = lambda names, labels: sorted(x for x in names if x.count(".") == labels - 1)
    many = F.size(F.split(h, "[.]"))
    out = F.concat(tail(1), F.lit("."))
    for n in range(1, max(s.count(".") for s in rules.plain) + 2):
        suffix = among(tail(n), of(rules.plain, n))
        if parents := of(rules.wild, n - 1):
            suffix |= among(tail(n - 1), parents) & (many >= n)
        out = F.when(suffix & (many >= n), F.when(many > n, tail(n + 1)).otherwise(F.concat(F.lit("."), tail(n)))).otherwise(out)
    for n in sorted({e.count(".") + 1 for e in rules.exceptions}):
        out = F.when(among(tail(n), of(rules.exceptions, n)), tail(n)).otherwise(out)
    return out


def site_domain(url: Column) -> Column:
    return F.concat(F.lit("https://"), registered_domain(url))


def normal_path(p: Column) -> Column:
    """Empty, `.` and `..` parts resolved, no slash at the end; an empty path is `/`."""
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    start = F.array().cast("array<string>")
    folded = F.aggregate(parts, start, lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    lead = F.when(p.startswith("//") & ~p.startswith("///"), "//").otherwise("/")
    return F.concat(lead, F.array_join(folded, "/"))


def parameter(q: Column, name: str) -> Column:
    """The last value of a query parameter, decoded; null without one or with an empty one."""
    found = F.filter(F.split(q, "&"), lambda x: x.startswith(F.lit(f"{name}=")))
    raw = F.try_element_at(found, F.lit(-1))
    value = F.substring(raw, len(name) + 2, 100_000)
    return F.when(value != "", F.try_url_decode(value))


def follow_redirect(url: Column, trackers: tuple[str, ...]) -> Column:
    """The target of a tracker's link where the host is a known tracker and names one."""
    if not trackers:
        return url
    target = F.coalesce(parameter(query(url), "redir"), parameter(query(url), "amp;redir"))
    return F.when(F.regexp_extract(url, r"://([^/?#]*)", 1).isin(*trackers), F.coalesce(target, url)).otherwise(url)


def canonical(url: Column, trackers: tuple[str, ...] = (), allowed: tuple[str, ...] = ALLOWED_PARAMETERS) -> Column:
    """https, registered domain, normal path, and of the query only the allowed parameters, sorted."""
    target = follow_redirect(url, trackers)
    key = lambda x: F.try_url_decode(F.element_at(F.split(x, "="), 1))
    pairs = F.filter(F.split(query(target), "&"), lambda x: (x != "") & key(x).isin(*allowed))
    spelled = F.array_sort(F.transform(pairs, lambda x: F.concat(F.url_encode(key(x)), F.lit("="), F.url_encode(F.coalesce(F.try_url_decode(F.regexp_extract(x, r"=(.*)$", 1)), F.lit(""))))))
    kept = F.array_join(spelled, "&")
    return F.concat(F.lit("https://"), registered_domain(target), normal_path(path(target)), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def without_query(url: Column) -> Column:
    """Scheme, host and path only."""
    return F.regexp_extract(url, r"^([^?#;]*)", 1)


def simple_link(href: Column, base: Column) -> Column:
    """http kept, // and / completed, everything else dropped (null)."""
    return F.when(href.startswith("http"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(base, href))


def resolve_rooted(href: Column, base: Column) -> Column:
    """RFC 3986 resolution of absolute, scheme-relative and root-relative references; others go through `resolve`."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    return F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(origin, href))


def resolve(href: Column, base: Column) -> Column:
    """RFC 3986 resolution of any reference, vectorised over Arrow batches."""
    @F.pandas_udf("string")
    def join(h: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else urljoin(y, x) for x, y in zip(h, b, strict=True)])

    return F.coalesce(resolve_rooted(href, base), join(href, base))


def parts(url: Column) -> Column:
    return F.split(path(url), "/")


def section(url: Column) -> Column:
    return F.try_element_at(parts(url), F.lit(2))


def topic(url: Column) -> Column:
    return F.try_element_at(parts(url), F.lit(3))


def link_title(url: Column) -> Column:
    """Last path part without its last five characters, dashes as spaces, for `.html` links; else empty."""
    last = F.replace(F.element_at(parts(url), -1), F.lit("-"), F.lit(" "))
    return F.when(F.contains(url, F.lit(".html")), F.substring(last, F.lit(1), F.greatest(F.length(last) - 5, F.lit(0)))).otherwise(F.lit(""))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'<a [^>]*href="([^"]*)"'), F.lit(1))


def wanted_href(href: Column) -> Column:
    return ~F.trim(href).rlike(r"^(javascript:|mailto:|tel:|#)")


#: Where the code of an onclick names a url, in the order in which matches are listed.
ONCLICK_PATTERNS = (
    r"""(?:location\.href|document\.location|window\.location)\s*=\s*['"]([^'"]+)['"]""",
    r"""(?:location\.assign|window\.open)\(\s*['"]([^'"]+)['"]""",
    r"""Url\s*:\s*["']([^"']+)["']""",
    r"""PlaybackUrl\s*:\s*["']([^"']+)["']""",
    r"""["']([^"']+\.html)["']""",
)


def onclick_candidates(code: Column) -> Column:
    """All matches of ONCLICK_PATTERNS in turn, repeats kept; null or empty code has none."""
    found = F.concat(*[F.regexp_extract_all(code, F.lit(p), F.lit(1)) for p in ONCLICK_PATTERNS])
    return F.coalesce(found, F.array().cast("array<string>"))
