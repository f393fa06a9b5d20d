"""Trees in pre-order arrays, in one pass each: digests of subtrees, paths from above, markup, the nearest marked node around."""

from __future__ import annotations

import hashlib
import re
from html import escape
from urllib.parse import urljoin
from xml.sax.saxutils import quoteattr

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.html import VOID


def _digests(parents: list[int], labels: list[str | None]) -> list[str | None]:
    """Bottom up: of each node with a label a digest of the label over its labelled children's digests. A parent is a place, -1 for none."""
    under: dict[int, list[str]] = {}
    out: list[str | None] = [None] * len(labels)
    for i in range(len(labels) - 1, -1, -1):
        if labels[i] is not None:
            material = "\x1f".join([labels[i], *reversed(under.pop(i, []))])
            out[i] = hashlib.sha256(material.encode("utf-8", "surrogatepass")).hexdigest()[:16]
            under.setdefault(parents[i], []).append(out[i])
    return out


@F.arrow_udf(T.ArrayType(T.StringType()))
def subtree_digests(parents: pa.Array, labels: pa.Array) -> pa.Array:
    """Digests of one tree a row, from its nodes' parents (places in the array, -1 for none) and labels (null: left out, with
    its children)."""
    return pa.array([None if p is None or x is None else _digests(p, x) for p, x in zip(parents.to_pylist(), labels.to_pylist())], pa.list_(pa.string()))


def _descents(parents: list[int], steps: list[str | None], stops: list[bool]) -> list[str | None]:
    out: list[str | None] = []
    for parent, step, stop in zip(parents, steps, stops):
        out.append("" if stop else f"{out[parent] if parent >= 0 else ''}/{step}")
    return out


@F.arrow_udf(T.ArrayType(T.StringType()))
def descents(parents: pa.Array, steps: pa.Array, stops: pa.Array) -> pa.Array:
    """Top down: the steps that lead to each node from the nearest node at or above it that stops, or from the top."""
    rows = zip(parents.to_pylist(), steps.to_pylist(), stops.to_pylist())
    return pa.array([None if p is None else _descents(p, s, x) for p, s, x in rows], pa.list_(pa.string()))


def _markup(nodes: list[dict]) -> str:
    out, open_ = [], []
    for n in nodes:
        while open_ and open_[-1][1] < n["pre"]:
            out.append(f"</{open_.pop()[0]}>")
        if n["tag"] == "#text":
            raw = bool(open_) and open_[-1][0] in ("script", "style")
            out.append(n["text"] if raw else escape(n["text"], quote=False))
            continue
        out.append(f"<{n['tag']}{''.join(f' {k}={quoteattr(v)}' for k, v in n['attrs'])}>")
        if n["tag"] not in VOID:
            open_.append((n["tag"], n["last"]))
    return "".join(out) + "".join(f"</{tag}>" for tag, _ in reversed(open_))


def markup(nodes: Column, most_bytes: int) -> Column:
    """struct<content, bytes, cut> of a subtree's nodes in order: its HTML, up to so many bytes of UTF-8 and no broken character."""

    @F.arrow_udf("struct<content: string, bytes: int, cut: boolean>")
    def write(column: pa.Array) -> pa.Array:
        made = [None if n is None else _markup(n).encode("utf-8", "surrogatepass") for n in column.to_pylist()]
        kept = [None if m is None else m[:most_bytes].decode("utf-8", "ignore") for m in made]
        names = ["content", "bytes", "cut"]
        return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array([None if k is None else len(k.encode()) for k in kept], pa.int32()), pa.array([None if m is None else len(m) > most_bytes for m in made], pa.bool_())], names=names)

    return write(F.transform(nodes, lambda n: F.struct(n["pre"].alias("pre"), n["last"].alias("last"), n["tag"].alias("tag"), n["attrs"].alias("attrs"), n["text"].alias("text"))))


def _tidy(parts: list[str]) -> str:
    """Collapsed, without blanks before punctuation."""
    return re.sub(r"\s+([,.;:!?])", r"\1", re.sub(r"\s+", " ", "".join(parts)).strip())


def _inline(nodes: list[dict], base: str) -> list[tuple[str | None, str | None]]:
    """Bottom up: each element's text with the links in it as Markdown, and without."""
    linked: dict[int, list[str]] = {}
    plain: dict[int, list[str]] = {}
    out: list[tuple[str | None, str | None]] = [(None, None)] * len(nodes)
    for n in reversed(nodes):
        own = [n["text"]], [n["text"]]
        if n["tag"] != "#text":
            raw = list(reversed(plain.pop(n["pre"], [])))
            text = _tidy(list(reversed(linked.pop(n["pre"], []))))
            out[n["pre"]] = (text, _tidy(raw))
            own = [f"[{text}]({urljoin(base, n['href'])})" if n["tag"] == "a" and n["href"] and text else text], list(reversed(raw))
        linked.setdefault(n["parent"], []).extend(own[0])
        plain.setdefault(n["parent"], []).extend(own[1])
    return out


def inline_texts(nodes: Column, url: Column) -> Column:
    """array<struct<linked, plain>>: of each element of a page its text with links as Markdown, and its text; null for texts."""

    @F.arrow_udf("array<struct<linked: string, plain: string>>")
    def write(column: pa.Array, urls: pa.Array) -> pa.Array:
        made = [None if n is None else [{"linked": a, "plain": b} for a, b in _inline(n, u or "")] for n, u in zip(column.to_pylist(), urls.to_pylist())]
        return pa.array(made, pa.list_(pa.struct([("linked", pa.string()), ("plain", pa.string())])))

    return write(F.transform(nodes, lambda n: F.struct(n["pre"].alias("pre"), n["parent"].alias("parent"), n["tag"].alias("tag"), n["attrs"]["href"].alias("href"), n["text"].alias("text"))), url)


def _enclosing(pre: np.ndarray, last: np.ndarray, marked: np.ndarray, itself: bool) -> list[int | None]:
    out: list[int | None] = []
    open_: list[tuple[int, int]] = []
    for p, end, mark in zip(pre.tolist(), last.tolist(), marked.tolist()):
        while open_ and open_[-1][1] < p:
            open_.pop()
        if mark and itself:
            open_.append((p, end))
        out.append(open_[-1][0] if open_ else None)
        if mark and not itself:
            open_.append((p, end))
    return out


def enclosing(nodes: Column, marked, itself: bool = False) -> Column:
    """array<int>: of each node in an array sorted by ``pre`` the ``pre`` of the nearest marked node around it; with ``itself`` a
    marked node is its own. A node is open from its ``pre`` to its ``last``."""

    @F.arrow_udf("array<int>")
    def walk(column: pa.Array) -> pa.Array:
        out = []
        for row in column:
            if not row.is_valid:
                out.append(None)
                continue
            n = row.values
            pre, last, mark = (n.field(k).to_numpy(zero_copy_only=False) for k in ("pre", "last", "mark"))
            out.append(_enclosing(pre, last, mark, itself))
        return pa.array(out, pa.list_(pa.int32()))

    return walk(F.transform(nodes, lambda n: F.struct(n["pre"].alias("pre"), n["last"].alias("last"), F.coalesce(marked(n), F.lit(False)).alias("mark"))))


def places_of(nodes: Column) -> Column:
    """map<int,int> from ``pre`` to the place in the array, from 0."""
    return F.map_from_arrays(F.transform(nodes, lambda n: n["pre"]), F.transform(nodes, lambda n, i: i))
