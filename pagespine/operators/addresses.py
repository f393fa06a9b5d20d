"""Addresses of elements, regions and members: made, parsed, resolved in any version of a page, and looked into.

An address is ``//*[@id="x"]#anchor=id%3Dx`` for an element that has a key of its own, that with ``|./div/p[@class="lead"]`` for
one below it, and ``/html/body/div[2]`` where nothing durable is above. A step names the tag if that stands once among
its siblings, else an attribute that makes it so, else its place. A region adds ``#shape=`` to its container's address, a
member ``&key=`` or, without a key of its own, ``&ordinal=`` (from 0). An address that starts at an anchor and has no place and no
ordinal has a reference: a digest that is the same in every version of the page.

Keys and steps are counted by joins; parents' steps are strung together in one pass a page. Resolving goes step by step
for all addresses at once: joins on (page, parent), as many as the longest address has steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.trees import descents, markup
from ..scratch import large, written
from ..sources.html import let, node_table, node_text, subtree, with_nodes
from ._registry import read, registry
from .compiled import bounded_prefix
from .observe import SAFE_NAME, anchor_keys, anchors, nearest_anchors, region_runs

QUERIES, SQL, query = registry()

#: What the value of a step's attribute may not hold, as steps are told apart by it.
STEP_RESERVED = r'["#|/\[\]]'
# Budgets of an inspection and an expansion.
INSPECT_BYTES, EXPAND_ITEMS, SUMMARY_CHARS = 32_000, 500, 400


def anchor_path(key: Column) -> Column:
    """The path that finds what has the key."""
    pair = lambda x: F.concat(F.lit("@"), F.substring_index(x, "=", 1), F.lit('="'), F.regexp_replace(x, "^[^=]*=", ""), F.lit('"'))
    both = F.array_join(F.transform(F.split(F.regexp_extract(key, r"^both\((.*)\)$", 1), ";"), pair), " and ")
    return F.when(key.startswith("tag:"), F.concat(F.lit("//"), F.regexp_replace(key, "^tag:", ""))).when(key.startswith("both("), F.concat(F.lit("//*["), both, F.lit("]"))).otherwise(F.concat(F.lit("//*["), pair(key), F.lit("]")))


def anchored(key: Column) -> Column:
    return F.concat(anchor_path(key), F.lit("#anchor="), F.url_encode(key))


def steps(elements: DataFrame, id: str = "page_id") -> DataFrame:
    """id, pre, step: how each element is told from its siblings."""
    tags = elements.groupBy(id, "parent", "tag").agg(F.count(F.lit(1)).alias("same_tag"))
    told = elements.select(id, "parent", "tag", "pre", F.posexplode("attrs").alias("at", "name", "value"))
    told = told.filter(F.col("name").rlike(SAFE_NAME) & ~F.col("value").rlike(STEP_RESERVED))
    alone = told.groupBy(id, "parent", "tag", "name", "value").agg(F.count(F.lit(1)).alias("n"), F.min("pre").alias("pre"), F.min("at").alias("at")).filter("n = 1")
    best = alone.groupBy(id, "pre").agg(F.min_by(F.struct("name", "value"), "at").alias("best"))
    joined = elements.join(large(tags), [id, "parent", "tag"]).join(large(best), [id, "pre"], "left")
    by_attribute = F.concat("tag", F.lit("[@"), F.col("best.name"), F.lit('="'), F.col("best.value"), F.lit('"]'))
    return joined.select(id, "pre", F.when(F.col("same_tag") == 1, F.col("tag")).when(F.col("best").isNotNull(), by_attribute).otherwise(F.concat("tag", F.lit("["), F.col("same").cast("string"), F.lit("]"))).alias("step"))


def addresses(elements: DataFrame, id: str = "page_id") -> DataFrame:
    """id, pre, address of all elements (id, pre, parent, last, tag, attrs, same)."""
    found = anchors(elements, id)
    each = elements.join(large(steps(elements, id)), [id, "pre"]).join(large(found), [id, "pre"], "left")
    rows = each.groupBy(id).agg(F.array_sort(F.collect_list(F.struct("pre", "parent", "step", "key"))).alias("own"))
    rows = rows.withColumn("place", F.map_from_arrays("own.pre", F.transform("own", lambda n, i: i)))
    rows = rows.withColumn("parents", F.transform("own", lambda n: F.coalesce(F.try_element_at(F.col("place"), n["parent"]), F.lit(-1))))
    rows = rows.withColumn("paths", descents(F.col("parents"), F.col("own.step"), F.transform("own", lambda n: n["key"].isNotNull())))
    long = rows.select(id, F.explode(F.arrays_zip(F.col("own.pre").alias("pre"), F.col("paths").alias("path"))).alias("x")).select(id, "x.*")
    near = long.join(large(nearest_anchors(elements, found, id)), [id, "pre"], "left")
    below = F.when(F.col("path") == "", F.lit("")).otherwise(F.concat(F.lit("|."), "path"))
    return near.select(id, "pre", F.when(F.col("key").isNull(), F.col("path")).otherwise(F.concat(anchored(F.col("key")), below)).alias("address"))


def parsed(address: Column) -> Column:
    """struct<anchor, steps, shape, key, ordinal> of an address; null if it isn't one."""
    segments = F.split(address, r"\|")
    part = lambda x, name: F.when(x.rlike(f"[#&]{name}="), F.regexp_extract(x, f"[#&]{name}=([^&]*)", 1))
    first, rest = F.get(segments, F.lit(0)), F.slice(segments, 2, 99)
    path = lambda x: F.substring_index(x, "#", 1)
    whole = F.concat(F.when(first.rlike("#anchor="), F.lit("")).otherwise(F.regexp_replace(path(first), "^/", "")), F.coalesce(F.array_join(F.transform(rest, lambda x: F.regexp_replace(path(x), r"^\./?", "")), "/"), F.lit("")))
    names = F.transform(F.array_remove(F.split(whole, "/"), ""), lambda s: F.struct(F.regexp_extract(s, r"^([^\[]+)", 1).alias("tag"), F.when(s.rlike(r"\[@"), F.regexp_extract(s, r'\[@([^=]+)="', 1)).alias("name"), F.when(s.rlike(r"\[@"), F.regexp_extract(s, r'="([^"]*)"\]$', 1)).alias("value"), F.regexp_extract(s, r"\[([0-9]+)\]$", 1).try_cast("int").alias("place")))
    last = F.element_at(segments, -1)
    good = first.rlike("^/[^|]") & F.forall(rest, lambda x: x.startswith(".")) & ~(last.rlike("[#&](key|ordinal)=") & ~last.rlike("[#&]shape="))
    return F.when(good, F.struct(F.url_decode(part(first, "anchor")).alias("anchor"), names.alias("steps"), part(last, "shape").alias("shape"), F.url_decode(part(last, "key")).alias("key"), part(last, "ordinal").try_cast("int").alias("ordinal")))


def reference(address: Column, modality: str = "html") -> Column:
    """16 hex digits that name the same thing in every version of a page; null for an address that can't promise that."""
    durable = address.rlike("#anchor=") & ~address.rlike(r"\[[0-9]+\]") & ~address.rlike("[#&]ordinal=")
    return F.when(durable, F.substring(F.sha2(F.concat(F.lit(f"{modality}|"), address), 256), 1, 16))


def rebound(address: Column, key: Column) -> Column:
    """A member's address with another member's key."""
    return F.regexp_replace(F.regexp_replace(address, "[#&]ordinal=[0-9]+", "&key="), "&key=[^&|]*", F.concat(F.lit("&key="), F.url_encode(key)))


def member_keys(members: DataFrame, id: str = "page_id") -> DataFrame:
    """``members`` (id, region, pre, attrs, text) with ``key``: of id, data attributes and a digest of the text the first that
    no other member of the region has."""
    a = F.col("attrs")
    data = F.transform(F.array_sort(F.filter(F.map_keys(a), lambda k: k.startswith("data-") & (a[k] != ""))), lambda k: F.concat(k, F.lit("="), a[k]))
    digest = F.when(F.col("text") != "", F.concat(F.lit("text:"), F.substring(F.sha2("text", 256), 1, 16)))
    keys = F.filter(F.concat(F.array(F.when(F.coalesce(a["id"], F.lit("")) != "", F.concat(F.lit("id="), a["id"]))), data, F.array(digest)), lambda k: k.isNotNull())
    long = members.select(id, "region", "pre", F.posexplode(keys).alias("tier", "key"))
    alone = long.groupBy(id, "region", "key").agg(F.count(F.lit(1)).alias("n"), F.min("pre").alias("pre"), F.min("tier").alias("tier")).filter("n = 1")
    best = alone.groupBy(id, "region", "pre").agg(F.min_by("key", "tier").alias("key"))
    return members.join(large(best), [id, "region", "pre"], "left")


def region_members(pages: DataFrame, elements: DataFrame, id: str = "page_id") -> DataFrame:
    """id, region (address), container, shape, ordinal, pre, last, attrs, text, key: the members of each region, addressed by ``address``."""
    runs = region_runs(elements.filter(F.col("shape").isNotNull()), id)
    holders = addresses(elements, id).withColumnRenamed("pre", "parent")
    region = F.concat("address", F.when(F.element_at(F.split("address", r"\|"), -1).contains("#"), "&shape=").otherwise("#shape="), "shape")
    inside = written(elements.join(large(runs.select(id, "parent", "shape")), [id, "parent", "shape"]).join(large(holders), [id, "parent"]), "region-insides")
    # only members are read, as a page's outer elements repeat all of its text
    wanted = inside.groupBy(id).agg(F.collect_set("pre").alias("wanted"))
    text = lambda p: let(F.element_at("nodes", p + 1), lambda n: F.struct(p.alias("pre"), F.trim(F.regexp_replace(node_text(F.col("nodes"), n), r"(?U)\s+", " ")).alias("text")))
    texts = with_nodes(pages.select(id, "html").join(large(wanted), id)).select(id, F.explode_outer(F.transform("wanted", text)).alias("t")).select(id, "t.*")
    members = inside.withColumn("region", region).join(large(texts), [id, "pre"])
    place = F.row_number().over(Window.partitionBy(id, "region").orderBy("pre")) - 1
    keyed = member_keys(members.select(id, "region", F.col("parent").alias("container"), "shape", "pre", "last", "attrs", "text"), id).withColumn("ordinal", place)
    own = F.when(F.col("key").isNotNull(), F.concat(F.lit("&key="), F.url_encode("key"))).otherwise(F.concat(F.lit("&ordinal="), F.col("ordinal").cast("string")))
    return keyed.withColumn("address", F.concat("region", own))


def expanded(members: DataFrame, most_items: int = EXPAND_ITEMS, most_bytes: int = INSPECT_BYTES, id: str = "page_id") -> DataFrame:
    """What an expansion of each region shows of its members, in order, within a number of items and of bytes of summaries."""
    told = members.withColumn("summary", F.substring("text", 1, SUMMARY_CHARS)).withColumn("__size", F.octet_length("summary") + F.octet_length("address"))
    scope = told.withColumn("__scope", F.concat_ws("\x1f", id, "region"))
    return bounded_prefix(scope, "__scope", "ordinal", "__size", most_bytes, most_items).select(id, "region", "address", "ordinal", "summary", F.col("key").isNotNull().alias("stable"))


def resolved(asked: DataFrame, elements: DataFrame, members: DataFrame | None = None, id: str = "page_id") -> DataFrame:
    """``asked`` (id, address) with ``pre``: the one element that each address leads to; null where none or several are found.

    ``members`` (as ``region_members``) are needed for addresses of members.
    """
    want = written(asked.select(id, "address").distinct().withColumn("p", parsed(F.col("address"))), "asked-addresses")
    keys = elements.select(id, "pre", F.explode(anchor_keys(F.col("tag"), F.col("attrs"))).alias("anchor")).groupBy(id, "anchor").agg(F.count(F.lit(1)).alias("n"), F.min("pre").alias("at")).filter("n = 1").drop("n")
    start = want.filter("p IS NOT NULL").withColumn("anchor", F.col("p.anchor")).join(large(keys), [id, "anchor"], "left")
    now = start.filter("anchor IS NULL OR at IS NOT NULL").select(id, "address", "p", F.coalesce("at", F.lit(-1)).alias("at"))
    longest = want.agg(F.coalesce(F.max(F.size("p.steps")), F.lit(0))).first()[0]
    children = elements.select(id, F.col("parent").alias("at"), F.col("tag"), F.col("pre").alias("next"), "attrs", "same")
    done = now.filter("size(p.steps) = 0")
    now = now.filter("size(p.steps) > 0")
    for k in range(longest):
        step = now.withColumn("s", F.get("p.steps", F.lit(k))).withColumn("tag", F.col("s.tag"))
        met = step.join(large(children), [id, "at", "tag"]).filter(F.col("s.name").isNull() | (F.col("attrs")[F.col("s.name")] == F.col("s.value"))).filter(F.col("s.place").isNull() | (F.col("s.place") == F.col("same")))
        met = met.groupBy(id, "address").agg(F.count(F.lit(1)).alias("n"), F.min("next").alias("at"), F.first("p").alias("p")).filter("n = 1")
        now = written(met.select(id, "address", "p", "at"), "address-steps")
        done = done.unionByName(now.filter(f"size(p.steps) = {k + 1}"))
        now = now.filter(f"size(p.steps) > {k + 1}")
    done = done.filter("at >= 0")
    plain = done.filter("p.key IS NULL AND p.ordinal IS NULL").select(id, "address", F.col("at").alias("pre"))
    if members is not None:
        picks = done.filter("p.key IS NOT NULL OR p.ordinal IS NOT NULL").select(id, "address", F.col("at").alias("container"), F.col("p.shape").alias("shape"), F.col("p.key").alias("want_key"), F.col("p.ordinal").alias("want_ordinal"))
        inside = members.select(id, "container", "shape", "key", "ordinal", "pre")
        hits = picks.join(large(inside), [id, "container", "shape"]).filter(F.coalesce(F.col("want_key") == F.col("key"), F.col("want_ordinal") == F.col("ordinal")))
        plain = plain.unionByName(hits.groupBy(id, "address").agg(F.count(F.lit(1)).alias("n"), F.min("pre").alias("pre")).filter("n = 1").drop("n"))
    return asked.join(large(plain), [id, "address"], "left")


def inspected(pages: DataFrame, found: DataFrame, most_bytes: int = INSPECT_BYTES, id: str = "page_id") -> DataFrame:
    """``found`` (id, address, pre) with the element's HTML, its bytes, and whether it was cut at the budget."""
    asked = found.filter("pre IS NOT NULL").groupBy(id).agg(F.collect_list(F.struct("address", "pre")).alias("asked"))
    part = lambda a: F.struct(a["address"].alias("address"), a["pre"].alias("pre"), let(F.element_at("nodes", a["pre"] + 1), lambda n: subtree(F.col("nodes"), n)).alias("own"))
    own = with_nodes(pages.select(id, "html").join(large(asked), id)).select(id, F.explode_outer(F.transform("asked", part)).alias("a")).select(id, "a.*")
    return own.select(id, "address", "pre", markup(F.col("own"), most_bytes).alias("m")).select(id, "address", "pre", "m.*")


def element_table(pages: DataFrame, id: str = "page_id") -> DataFrame:
    """The elements of each page, written once."""
    return written(node_table(pages.select(id, "html"), id).filter(~F.col("tag").isin("#text")).select(id, "pre", "parent", "last", "tag", "attrs", "shape", "same"), "elements")


@query("page_addresses")
def page_addresses(spark, sf):
    """Every element's address, the reference it earns, and the element that the address leads to: itself."""
    elements = element_table(read(spark, sf, "pages"))
    made = written(addresses(elements), "addresses")
    return resolved(made.select("page_id", "address", F.col("pre").alias("of")), elements).withColumn("reference", reference(F.col("address")))


@query("region_expansions")
def region_expansions(spark, sf):
    """The members of each page's regions as an expansion shows them."""
    pages = read(spark, sf, "pages")
    return expanded(region_members(pages, element_table(pages)))


@query("member_inspections")
def member_inspections(spark, sf):
    """The last member of each region, by the address of the first with the last one's key, and its HTML."""
    pages = read(spark, sf, "pages")
    elements = element_table(pages)
    members = written(region_members(pages, elements), "members")
    ends = members.groupBy("page_id", "region").agg(F.min_by("address", "ordinal").alias("first"), F.max_by("key", "ordinal").alias("key")).filter("key IS NOT NULL")
    asked = ends.select("page_id", rebound(F.col("first"), F.col("key")).alias("address"))
    return inspected(pages, resolved(asked, elements, members), 200)
