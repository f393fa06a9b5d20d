"""Record contracts: fields with selectors, modes and types; extraction of one record or many per page."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce, urls
from ..functions.text import collapse
from ..sources.html import node_text, with_nodes
from .selectors import Selector, css, values, xpath

COERCERS = {
    "text": coerce.stripped,
    "title": coerce.stripped,
    "author": coerce.stripped,
    "price": coerce.price,
    "rating": coerce.rating,
    "number": coerce.number,
    "integer": lambda c: coerce.number(c, integer=True),
    "url": urls.clean,
    "datetime": coerce.iso_date,
    "list": coerce.items,
}
CHECKS = {"price": "numeric", "rating": "numeric", "number": "numeric", "integer": "numeric", "url": "url", "title": "text", "author": "text", "datetime": "text"}


def register(name: str, coercer, check: str | None = None) -> None:
    """Adds a type: a function of a string column, and the kind of its shape check."""
    COERCERS[name] = coercer
    if check:
        CHECKS[name] = check


@dataclass(frozen=True)
class Field:
    name: str
    cascade: tuple[Selector, ...]
    kind: str = "text"
    mode: str = "first"  # first, list, body, related
    root: Selector | None = None
    required: bool = False
    default: object = None
    compute: object = None  # a function of the page's nodes and the row's node that gives a column, in place of the cascade


@dataclass(frozen=True)
class Contract:
    name: str
    fields: tuple[Field, ...]
    container: Selector | None = None
    identity: tuple[tuple[str, ...], tuple[str, ...]] = field(default=(("name", "title", "headline", "service_name"), ("price", "url", "service_url", "date", "published_at", "score")))


def _compiled(s: Selector):
    return xpath(s.value) if s.kind == "xpath" or s.value.startswith("/") else css(s.value)


def raw_value(f: Field, nodes: Column, within: Column | None = None, max_level: int = 8) -> Column:
    """The first selector of the cascade that yields something, as text; the field's own root, if it has one, must match."""
    if f.compute is not None:
        return f.compute(nodes, within)
    if f.root is not None and f.root.kind in ("css", "xpath"):
        within = F.try_element_at(_compiled(f.root).nodes(nodes, within), F.lit(1))
    tries = []
    for s in f.cascade:
        if f.mode == "related":
            found = F.filter(_compiled(s).nodes(nodes, within), lambda n: F.lit(True))
            one = coerce.related(F.transform(found, lambda n: F.struct(node_text(nodes, n).alias("text"), n["attrs"]["href"].alias("href"))))
        else:
            found = F.filter(values(s, nodes, within, max_level), lambda v: F.trim(v) != "") if f.mode != "first" else values(s, nodes, within, max_level)
            joined = {"first": F.try_element_at(found, F.lit(1)), "list": F.array_join(found, ", "), "body": F.array_join(found, "\n\n")}
            one = joined[f.mode]
        tries.append(F.when(one != "", one))
    got = F.coalesce(*tries)
    return F.when(within.isNotNull(), got) if f.root is not None and f.root.kind in ("css", "xpath") else got


def extract(pages: DataFrame, contract: Contract, id: str = "page_id", html: str = "html", max_level: int = 8) -> DataFrame:
    """id, ord and the raw fields: a row for each container, or for the page if there is no container selector.

    Rows without any value are left out, and so are those equal to an earlier row of their page.
    """
    parsed = with_nodes(pages.select(id, html), html)
    nodes = F.col("nodes")
    if contract.container is None:
        raw = parsed.select(id, F.lit(0).alias("ord"), *[raw_value(f, nodes, None, max_level).alias(f.name) for f in contract.fields])
    else:
        found = _compiled(contract.container).nodes(nodes)
        each = F.transform(found, lambda c: F.struct(*[raw_value(f, nodes, c, max_level).alias(f.name) for f in contract.fields]))
        raw = parsed.select(id, F.posexplode(each).alias("ord", "r")).select(id, "ord", "r.*")
    names = [f.name for f in contract.fields]
    some = raw.filter(F.coalesce(*[F.col(n) for n in names]).isNotNull())
    return keep_first(some, [id, *names], ["ord"])


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by an aggregate, so that a key of very many rows is one row from each task."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("__row")).select("__row.*")


def typed(raw: DataFrame, contract: Contract) -> DataFrame:
    """The fields coerced; what can't be becomes the default, and is named in ``defaulted``; required fields that are then
    null are named in ``missing``."""
    out, failed, missing = {}, [], []
    for f in contract.fields:
        value = COERCERS[f.kind](F.col(f.name))
        failed.append(F.when(F.col(f.name).isNotNull() & value.isNull(), F.lit(f.name)))
        has_default = f.default is not None
        if f.required:
            missing.append(F.when(value.isNull() & F.lit(not has_default), F.lit(f.name)))
        out[f.name] = F.coalesce(value, F.lit(f.default).cast(raw.select(value.alias("v")).schema["v"].dataType)) if f.default is not None else value
    rest = [c for c in raw.columns if c not in out]
    return raw.select(*rest, *[v.alias(k) for k, v in out.items()], F.array_compact(F.array(*failed)).alias("defaulted"), F.array_compact(F.array(*missing)).cast("array<string>").alias("missing"))


def complete(rows: DataFrame) -> DataFrame:
    """The typed rows that lack no required field."""
    return rows.filter(F.size("missing") == 0)


def nested(pages: DataFrame, parent: Contract, children: dict[str, Contract], id: str = "page_id", html: str = "html", max_level: int = 8) -> DataFrame:
    """id, ord, the parent's raw fields, and for each child contract an array of structs of its fields, from its containers
    within the parent's; a child without a container gives one struct."""
    parsed, nodes = with_nodes(pages.select(id, html), html), F.col("nodes")

    def fields(c: Contract, within):
        return [raw_value(f, nodes, within, max_level).alias(f.name) for f in c.fields]

    def record(within):
        inner = []
        for name, c in children.items():
            if c.container is None:
                inner.append(F.array(F.struct(*fields(c, within))).alias(name))
            else:
                inner.append(each(c, within).alias(name))
        return F.struct(*fields(parent, within), *inner)

    def each(c: Contract, within):
        return F.transform(_compiled(c.container).nodes(nodes, within), lambda w: F.struct(*fields(c, w)))

    if parent.container is None:
        return parsed.select(id, F.lit(0).alias("ord"), record(None).alias("r")).select(id, "ord", "r.*")
    return parsed.select(id, F.posexplode(F.transform(_compiled(parent.container).nodes(nodes), record)).alias("ord", "r")).select(id, "ord", "r.*")


def issues(raw: DataFrame, contract: Contract) -> DataFrame:
    """Adds ``issues``: array<struct<field, issue>> of raw values of the wrong shape."""
    found = []
    for f in contract.fields:
        if f.kind in CHECKS:
            found.append(F.struct(F.lit(f.name).alias("field"), coerce.issue(CHECKS[f.kind], F.col(f.name), coerce.MAX_CHARS.get(f.kind, 50)).alias("issue")))
    return raw.withColumn("issues", F.filter(F.array(*found), lambda i: i["issue"].isNotNull()))


def dedupe_by_identity(rows: DataFrame, contract: Contract, scope: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal name and partner values (case and blanks aside) the first; rows without both all stay."""

    def pick(names):
        own = [n for n in names if n in rows.columns]
        text = lambda n: F.col(n).cast("string")
        return F.coalesce(*[F.when(text(n) != "", F.concat(F.lit(f"{n}="), F.lower(collapse(text(n))))) for n in own], F.lit(None).cast("string"))

    keyed = rows.withColumn("__a", pick(contract.identity[0])).withColumn("__b", pick(contract.identity[1]))
    whole = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    first = keep_first(keyed.filter(whole), [*scope, "__a", "__b"], order)
    return first.unionByName(keyed.filter(~whole)).drop("__a", "__b")
