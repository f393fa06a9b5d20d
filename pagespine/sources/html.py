"""Pages as node arrays: one parse per page, everything after it in column expressions.

A node is struct<pre, parent, last, depth, tag, attrs, text, shape, nth, same, after>: ``pre`` numbers nodes in document order
from 0, ``last`` is the number of its last descendant, so a subtree is a range; text nodes have the tag ``#text``. ``nth`` is an
element's place among its element siblings, ``same`` among those of its tag, both from 1; ``after`` is the number of siblings after it. Script and style are
raw text; void elements have no content; a ``p`` ends at a block element; what remains open ends with its parent.
"""

from __future__ import annotations

import hashlib
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, readable

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: An element that ends an open element of the same kind, unless one of the others is open above it.
SELF_ENDING = {"li": ("ul", "ol"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "dt": ("dl",), "dd": ("dl",)}

NODE = "struct<pre: int, parent: int, last: int, depth: int, tag: string, attrs: map<string, string>, text: string, shape: string, nth: int, same: int, after: int>"
#: Tags without content of their own.
NON_CONTENT = ("script", "style", "link", "meta", "template", "noscript")


class _Nodes(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []

    def _add(self, tag, attrs, text):
        self.rows.append([len(self.rows), self.open[-1] if self.open else -1, len(self.rows), len(self.open), tag, attrs, text])

    def _close_to(self, depth):
        last = len(self.rows) - 1
        while len(self.open) > depth:
            self.rows[self.open.pop()][2] = last

    def _close(self, tag, stops=()):
        for i in range(len(self.open) - 1, -1, -1):
            name = self.rows[self.open[i]][4]
            if name == tag:
                self._close_to(i)
                return
            if name in stops:
                return

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._close("p", ("table", "td"))
        if tag in SELF_ENDING:
            self._close(tag, SELF_ENDING[tag])
        own: dict[str, str] = {}
        for k, v in attrs:  # the first of a name counts
            own.setdefault(k, v or "")
        self._add(tag, list(own.items()), None)
        if tag not in VOID:
            self.open.append(len(self.rows) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(tag)

    def handle_endtag(self, tag):
        if tag not in VOID:
            self._close(tag)

    def handle_data(self, data):
        self._add("#text", [], data)


def parse(html: str | None) -> list[tuple]:
    reader = _Nodes()
    reader.feed(html or "")
    reader.close()
    reader._close_to(0)
    return [(*r, shape, *place) for r, shape, place in zip(reader.rows, _shapes(reader.rows), _places(reader.rows))]


def _places(rows: list[list]) -> list[tuple[int, int, int]]:
    """Of each element its place among its siblings, among those of its tag, and how many siblings follow; 0 for texts."""
    children: dict[int, int] = {}
    of_tag: dict[tuple[int, str], int] = {}
    out = []
    for _, parent, _, _, tag, *_ in rows:
        if tag == "#text":
            out.append((0, 0, parent))
            continue
        children[parent] = children.get(parent, 0) + 1
        of_tag[parent, tag] = of_tag.get((parent, tag), 0) + 1
        out.append((children[parent], of_tag[parent, tag], parent))
    return [(nth, same, children[parent] - nth if nth else 0) for nth, same, parent in out]


def _shapes(rows: list[list]) -> list[str | None]:
    """Of each content element a digest of its tag over its content children's shapes, whatever the texts; bottom up."""
    out: list[str | None] = [None] * len(rows)
    under: dict[int, list[str]] = {}
    for pre, parent, _, _, tag, *_ in reversed(rows):
        if tag != "#text" and tag not in NON_CONTENT:
            out[pre] = hashlib.sha256("|".join([tag, *reversed(under.pop(pre, []))]).encode("utf-8", "surrogatepass")).hexdigest()[:16]
            under.setdefault(parent, []).append(out[pre])
    return out


def with_nodes(pages: DataFrame, html: str = "html", out: str = "nodes") -> DataFrame:
    """Adds the page's nodes; a null or empty page has none."""
    types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
    names = ("pre", "parent", "last", "depth", "tag", "attrs", "text", "shape", "nth", "same", "after")

    @F.arrow_udf(f"array<{NODE}>")
    def nodes(column: pa.Array) -> pa.Array:
        rows, ends = [], [0]
        for html in column.to_pylist():
            rows += parse(html)
            ends.append(len(rows))
        columns = list(zip(*rows)) or [()] * len(types)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=list(names)))

    return pages.withColumn(out, nodes(F.col(html)))


def below(n: Column, a: Column) -> Column:
    """Whether node n lies within node a."""
    return (n["pre"] > a["pre"]) & (n["pre"] <= a["last"])


def subtree(nodes: Column, of: Column) -> Column:
    """A node and all within it, of a whole page's nodes."""
    return F.slice(nodes, of["pre"] + 1, of["last"] - of["pre"] + 1)


def texts(nodes: Column) -> Column:
    """The texts among the nodes, in document order."""
    return F.transform(F.filter(nodes, lambda n: n["tag"] == "#text"), lambda n: n["text"])


def node_text(nodes: Column, of: Column) -> Column:
    """The node's texts with a blank between, stripped; blanks within stay."""
    return F.regexp_replace(F.array_join(texts(subtree(nodes, of)), " "), r"(?U)^\s+|\s+$", "")


def visible_text(nodes: Column) -> Column:
    """All texts of the page, collapsed, without blanks before punctuation."""
    parts = F.filter(F.transform(texts(nodes), lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")), lambda t: t != "")
    return readable(F.array_join(parts, " "))


def without(nodes: Column, drop) -> Column:
    """The nodes that are not, and are not within, one for which ``drop`` holds."""
    return let(F.filter(nodes, drop), lambda roots: F.filter(nodes, lambda n: ~F.exists(roots, lambda a: (n["pre"] >= a["pre"]) & (n["pre"] <= a["last"]))))


def has_class(n: Column, name: str) -> Column:
    return F.array_contains(F.split(F.coalesce(n["attrs"]["class"], F.lit("")), r"\s+"), name)


# What cleaning drops, in this order.
NOISE_TAGS = ("script", "style", "noscript", "iframe")
FRAME_TAGS = ("header", "nav", "footer")
SIDE_CLASSES, SIDE_IDS = ("sidebar", "widget", "advertisement", "ad"), ("sidebar",)
KEPT_LIST_ITEMS, KEPT_TABLE_ROWS = 3, 5


def cleaned(nodes: Column) -> Column:
    """The nodes that matter: without scripts, frames and side matter, within main or else body; first list items and
    table rows only."""

    def side(n):
        out = n["attrs"]["id"].isin(*SIDE_IDS)
        for c in SIDE_CLASSES:
            out = F.coalesce(out, F.lit(False)) | has_class(n, c)
        return out

    def scoped(kept):
        first = lambda tag: F.try_element_at(F.filter(kept, lambda n: n["tag"] == tag), F.lit(1))
        return let(F.coalesce(first("main"), first("body")), lambda root: F.when(root.isNull(), kept).otherwise(F.filter(kept, lambda n: (n["pre"] >= root["pre"]) & (n["pre"] <= root["last"]))))

    def shortened(own):
        return without(own, lambda n: ((n["tag"] == "li") & (n["same"] > KEPT_LIST_ITEMS)) | ((n["tag"] == "tr") & (n["same"] > KEPT_TABLE_ROWS)))

    return let(without(nodes, lambda n: n["tag"].isin(*NOISE_TAGS, *FRAME_TAGS) | side(n)), lambda kept: let(scoped(kept), shortened))


# What pruning drops; how deep an anonymous empty box may lie; how much text keeps what is hidden.
NON_SEMANTIC = ("svg", "canvas")
DEEPEST_EMPTY, HIDDEN_TEXT = 8, 80
DATA_URI = "[data-uri-removed]"


def hidden(n: Column) -> Column:
    """Whether an element says that it isn't shown."""
    return (n["tag"] != "#text") & (n["attrs"]["hidden"].isNotNull() | F.coalesce(n["attrs"]["aria-hidden"] == "true", F.lit(False)))


def pruned(nodes: Column) -> Column:
    """The nodes without drawings, hidden parts that hold little, and deep empty boxes without a name; inline image data
    is replaced by a mark."""

    def payload(own):
        records = F.exists(own, lambda n: n["tag"].isin("article", "tr", "li") | n["attrs"]["data-sku"].isNotNull() | n["attrs"]["data-component"].isNotNull())
        return records | (F.length(F.trim(F.array_join(F.filter(texts(own), lambda t: F.trim(t) != ""), " "))) >= HIDDEN_TEXT)

    def empty_box(n):
        named = n["attrs"]["class"].isNotNull() | n["attrs"]["id"].isNotNull() | F.exists(F.map_keys(n["attrs"]), lambda k: k.startswith("data-"))
        return n["tag"].isin("div", "span") & ~named & (n["depth"] > DEEPEST_EMPTY) & (F.trim(F.array_join(texts(subtree(nodes, n)), "")) == "")

    inside = lambda n: F.slice(nodes, n["pre"] + 2, n["last"] - n["pre"])
    kept = without(nodes, lambda n: n["tag"].isin(*NON_SEMANTIC) | (hidden(n) & ~payload(inside(n))) | empty_box(n))
    marked = lambda n: F.transform_values(n["attrs"], lambda k, v: F.when((k == "src") & v.startswith("data:"), DATA_URI).otherwise(v))
    return F.transform(kept, lambda n: n.withField("attrs", marked(n)))


def node_table(pages: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """One row per node: the id and the node's fields."""
    # outer: else the planner tests the array's size first, by a parse of its own
    return with_nodes(pages.select(id, html), html).select(id, F.explode_outer("nodes").alias("n")).filter("n IS NOT NULL").select(id, "n.*")
