"""Extraction plans: what to take from a row, as an expression that is built step by step.

    take("a.title").attribute("href").map(urls.clean).compact()

A plan is called with a page's nodes and the row's node (None: the page) and gives a column: one value, or with ``all()``
an array. ``computed`` makes many fields from one evaluation of a user's function. Evidence of what a plan looked at is a
digest of it, not the text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.html import let, node_text, subtree, with_nodes
from .selectors import Selector, css, xpath


@dataclass(frozen=True)
class Plan:
    selector: Selector
    of: str | None = None
    many: bool = False
    maps: tuple[Callable[[Column], Column], ...] = ()
    dense: bool = False

    def text(self) -> Plan:
        return replace(self, of=None)

    def attribute(self, name: str) -> Plan:
        return replace(self, of=name)

    def all(self) -> Plan:
        return replace(self, many=True)

    def map(self, f: Callable[[Column], Column]) -> Plan:
        """Applies ``f`` to each value, after what was given before."""
        return replace(self, maps=(*self.maps, f))

    def compact(self) -> Plan:
        """Without nulls, which maps may leave."""
        return replace(self, dense=True)

    def __call__(self, nodes: Column, within: Column | None = None) -> Column:
        made = (xpath if self.selector.kind == "xpath" else css)(self.selector.value)
        found = F.transform(made.nodes(nodes, within), lambda n: n["attrs"][self.of] if self.of else node_text(nodes, n))
        if self.of:
            found = F.filter(found, lambda v: v.isNotNull())
        if self.many:
            for f in self.maps:
                found = F.transform(found, f)
            return F.filter(found, lambda v: v.isNotNull()) if self.dense else found
        value = F.try_element_at(found, F.lit(1))
        value = F.when(value != "", value)
        for f in self.maps:
            value = f(value)
        return value


def take(value: str, kind: str = "css") -> Plan:
    return Plan(Selector(value, kind))


def rows(pages: DataFrame, container: str | None, plans: dict[str, Callable], id: str = "page_id", html: str = "html") -> DataFrame:
    """id, ord and a column for each plan, of each container, or of the page; a plan may also be any function of nodes and
    the row's node that gives a column."""
    parsed, nodes = with_nodes(pages.select(id, html), html), F.col("nodes")
    made = lambda within: F.struct(*[f(nodes, within).alias(name) for name, f in plans.items()])
    if container is None:
        return parsed.select(id, F.lit(0).alias("ord"), made(None).alias("r")).select(id, "ord", "r.*")
    return parsed.select(id, F.posexplode(F.transform(css(container).nodes(nodes), made)).alias("ord", "r")).select(id, "ord", "r.*")


def computed(extracted: DataFrame, f: Callable[[DataFrame], Column], names: list[str]) -> DataFrame:
    """Adds the fields ``names`` of the struct that ``f`` gives for a row; it is evaluated once, whatever the number of fields."""
    return extracted.withColumn("__made", let(f(extracted), lambda s: s)).select(*extracted.columns, *[F.col("__made")[n].alias(n) for n in names])


def evidence(nodes: Column, of: Column) -> Column:
    """Digest of a node's texts: tells whether it has changed without keeping it."""
    inside = F.filter(subtree(nodes, of), lambda t: t["tag"] == "#text")
    return F.substring(F.sha2(F.array_join(F.transform(inside, lambda t: t["text"]), "\x1f"), 256), 1, 16)
