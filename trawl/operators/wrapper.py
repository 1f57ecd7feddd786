"""Wrapper induction over pages of one template, and extraction by the learnt wrapper.

A tree is a tuple (tag, children) or a text; a template node is (tag, children, mark) with mark "" for one, "+" for
repeated and "?" for optional, and the texts #PCDATA for varying text and ? for unmatched rest.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions.dom import Element, parse

VARIES, REST = "#PCDATA", "?"


def tree_of(html: str | None):
    root = parse(html, close_paragraphs=False)
    body = root.find("body")

    def build(e: Element):
        parts = (build(c) if isinstance(c, Element) else c.strip() for c in e.children)
        return e.tag or "[document]", [p for p in parts if p != ""], ""

    return build(body if body is not None else root)


def _is_node(x) -> bool:
    return not isinstance(x, str)


def same_shape(a, b) -> bool:
    if not _is_node(a) or not _is_node(b):
        return _is_node(a) == _is_node(b)
    return a[0] == b[0] and all(same_shape(x, y) for x, y in zip(a[1], b[1], strict=False))


def alike(a, b) -> bool:
    return a[0] == b[0] if _is_node(a) and _is_node(b) else _is_node(a) == _is_node(b)


def fold_repeats(children: list) -> list:
    """Runs of children of one shape become one repeated child; texts are folded without a mark."""
    out: list = []
    for c in children:
        if out and same_shape(out[-1], c):
            if _is_node(out[-1]):
                out[-1] = (out[-1][0], out[-1][1], "+")
        else:
            out.append(c)
    return out


def align_simple(a, b):
    """Position by position; whatever one side has more of is ?."""
    if not _is_node(a) or not _is_node(b) or a[0] != b[0]:
        return VARIES
    shared = [align_simple(x, y) for x, y in zip(a[1], b[1], strict=False)]
    return a[0], shared + [REST] * abs(len(a[1]) - len(b[1])), ""


def align(a, b):
    """With repeats folded and, where a child's neighbour fits better, optional children; equal text stays."""
    if not _is_node(a) or not _is_node(b):
        return a if a == b else VARIES
    if a[0] != b[0]:
        return VARIES
    left, right = fold_repeats(a[1]), fold_repeats(b[1])
    out: list = []
    optional = lambda n: (n[0], n[1], "?") if _is_node(n) else n
    while left and right:
        x, y = left[0], right[0]
        if not alike(x, y) and len(left) > 1 and alike(left[1], y):
            out.append(optional(x))
            left = left[1:]
        elif not alike(x, y) and len(right) > 1 and alike(x, right[1]):
            out.append(optional(y))
            right = right[1:]
        else:
            out.append(align(x, y))
            left, right = left[1:], right[1:]
    return a[0], out + [REST] * (len(left) + len(right)), "+" if "+" in (a[2], b[2]) else ""


def extract(node, template) -> list[str]:
    """The varying texts of a page; a child that the template has no node for is no match."""
    if template == VARIES:
        return [node] if not _is_node(node) else []
    if not _is_node(node) or not _is_node(template) or node[0] != template[0]:
        return []
    out: list[str] = []
    parts, rules = list(node[1]), list(template[1])
    while parts and rules:
        n, t = parts[0], rules[0]
        fits = _is_node(n) and _is_node(t) and n[0] == t[0]
        if _is_node(t) and t[2] == "+" and fits:
            out += extract(n, t)
            parts = parts[1:]
        elif _is_node(t) and t[2] in ("?", "+") and not fits:
            rules = rules[1:]
        else:
            out += extract(n, t)
            parts, rules = parts[1:], rules[1:]
    return out


def spelled(template) -> str:
    """A short form: tag/[children], repeats as (x)+, options as (x)?."""
    if not _is_node(template):
        return template
    inner = ", ".join(spelled(c) for c in template[1])
    own = template[0] + (f"/[{inner}]" if inner else "")
    return f"({own}){template[2]}" if template[2] else own


def as_json(template) -> str:
    return json.dumps(template, ensure_ascii=False)


def from_json(s: str):
    turn = lambda x: (x[0], [turn(c) for c in x[1]], x[2]) if isinstance(x, list) else x
    return turn(json.loads(s))


def learn(pages: DataFrame, group: str, html: str, order: str, sample: int = 2) -> DataFrame:
    """(group, wrapper): the wrapper of the first `sample` pages of each group; the sample bounds what meets in a task."""
    from pyspark.sql import Window as W

    first = pages.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy(order))).filter(F.col("_n") <= sample)
    lists = first.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", html))), lambda s: s[html]).alias("_pages"))

    @F.pandas_udf("string")
    def induce(s: pd.Series) -> pd.Series:
        def one(texts) -> str:
            trees = [tree_of(t) for t in texts]
            out = trees[0]
            for t in trees[1:]:
                out = align(out, t)
            return as_json(out)

        return s.map(one)

    return lists.select(group, induce("_pages").alias("wrapper"))


def extract_column(html: Column, wrapper: Column) -> Column:
    @F.pandas_udf("array<string>")
    def apply(h: pd.Series, w: pd.Series) -> pd.Series:
        known: dict[str, object] = {}
        out = []
        for x, s in zip(h, w, strict=True):
            if s not in known:
                known[s] = from_json(s)
            out.append(extract(tree_of(x), known[s]))
        return pd.Series(out)

    return apply(html, wrapper)
