"""Reducers: what an index says of a page's rendered tree and of its accessibility tree.

Both collapse adjacent siblings of one shape into a region, of which only the first member is gone into, and count how many members
were seen and how many the page declares. The DOM reducer folds chains of elements that only wrap another one;
the accessibility reducer first hoists what lies in elements without a role to the nearest element with one.

Shapes are digests bottom up and nearest ancestors a stack walk (``functions.trees``), one pass a page each. Chains are
followed by pointer jumping: each round doubles how far a pointer leads, so rounds grow with the logarithm of the longest chain.
Depths and what lies in skipped members are running sums over places where elements begin and end, not tests of nodes against nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.trees import enclosing, places_of, subtree_digests
from ..plans.selectors import ROLE_SELECTORS, css
from ..scratch import large, written
from ..sources.html import NON_CONTENT, hidden, node_text, with_nodes
from ._registry import read, registry
from .observe import region_runs

QUERIES, SQL, query = registry()

# What declares something and is no part of the structure; how deep entries go; the fewest members of a region.
METADATA_TAGS = (*NON_CONTENT, "title", "base")
MAX_DEPTH, MIN_RUN = 24, 2
# Where a container says how many members it has in all.
DECLARED = ("aria-rowcount", "aria-setsize", "aria-colcount")
#: Chains longer than two to this power don't occur in pages that the parse lets through.
MAX_ROUNDS = 40


def declared_count(attrs: Column) -> Column:
    """The number of members that a container declares; null where it says none, or -1 for unknown."""
    n = F.coalesce(*[attrs[k].try_cast("int") for k in DECLARED])
    return F.when(n >= 0, n)


def label(n: Column) -> Column:
    """tag, ``#id`` and the first two classes of an element."""
    classes = F.slice(F.array_remove(F.split(F.coalesce(n["attrs"]["class"], F.lit("")), r"\s+"), ""), 1, 2)
    return F.concat(n["tag"], F.when(F.coalesce(n["attrs"]["id"], F.lit("")) != "", F.concat(F.lit("#"), n["attrs"]["id"])).otherwise(""), F.array_join(F.transform(classes, lambda c: F.concat(F.lit("."), c)), ""))


def structure(pages: DataFrame, id: str = "page_id") -> DataFrame:
    """One row for each structural element: id, pre, parent, last, tag, label, own_text, named, unseen, declared, shape.

    ``shape`` is a digest of tags with their attributes' names, but for id and data attributes, over the children's shapes.
    """
    nodes = F.col("nodes")
    kept = with_nodes(pages.select(id, "html")).withColumn("own", F.filter(nodes, lambda n: (n["tag"] != "#text") & ~n["tag"].isin(*METADATA_TAGS)))
    kept = kept.withColumn("place", places_of(F.col("own")))
    # metadata has no structural content, so every structural element's parent is one
    parents = F.transform("own", lambda n: F.coalesce(F.try_element_at(F.col("place"), n["parent"]), F.lit(-1)))
    names = lambda n: F.array_join(F.array_sort(F.filter(F.map_keys(n["attrs"]), lambda k: (k != "id") & ~k.startswith("data-"))), ",")
    kept = kept.withColumn("shapes", subtree_digests(parents, F.transform("own", lambda n: F.concat_ws(":", n["tag"], names(n)))))
    spoken = F.transform(F.filter(nodes, lambda t: (t["tag"] == "#text") & (F.trim(F.regexp_replace(t["text"], r"(?U)\s+", " ")) != "")), lambda t: t["parent"])
    kept = kept.withColumn("spoken", F.array_distinct(spoken))
    named = lambda n: n["attrs"]["id"].isNotNull() | F.exists(F.map_keys(n["attrs"]), lambda k: k.startswith("data-"))
    row = F.transform("own", lambda n, i: F.struct(n["pre"].alias("pre"), n["parent"].alias("parent"), n["last"].alias("last"), n["tag"].alias("tag"), label(n).alias("label"), F.array_contains("spoken", n["pre"]).alias("own_text"), named(n).alias("named"), hidden(n).alias("unseen"), declared_count(n["attrs"]).alias("declared"), F.get("shapes", i).alias("shape")))
    # outer: else the planner tests the array's size first, by a parse of its own
    return kept.select(id, F.explode_outer(row).alias("n")).filter("n IS NOT NULL").select(id, "n.*")


def chains(elements: DataFrame, kids: DataFrame, id: str = "page_id") -> DataFrame:
    """id, pre, target, length, path: where the chain of wrappers that begins at each element ends, by pointer jumping; ``path``
    has the labels before the target's.

    A wrapper has one child (``kids``: id, pre, kids, child) and says nothing itself: no text, id or data attribute, count,
    and isn't hidden.
    """
    wraps = (F.coalesce("kids", F.lit(0)) == 1) & ~F.col("own_text") & ~F.col("named") & ~F.col("unseen") & F.col("declared").isNull()
    step = elements.join(large(kids), [id, "pre"], "left")
    step = step.select(id, "pre", F.when(wraps, F.col("child")).otherwise(F.col("pre")).alias("target"), F.when(wraps, 1).otherwise(0).alias("length"), F.when(wraps, F.array("label")).otherwise(F.array().cast("array<string>")).alias("path"))
    step = written(step, "chains")
    for _ in range(MAX_ROUNDS):
        ahead = step.select(id, F.col("pre").alias("target"), F.col("target").alias("further"), F.col("length").alias("more"), F.col("path").alias("rest"))
        moved = step.join(large(ahead), [id, "target"])
        after = written(moved.select(id, "pre", F.col("further").alias("target"), (F.col("length") + F.col("more")).alias("length"), F.concat("path", "rest").alias("path"), (F.col("more") > 0).alias("moved")), "chains")
        step = after.drop("moved")
        if not after.filter("moved").take(1):
            return step
    raise RuntimeError("a chain of wrappers did not end")


def outside(elements: DataFrame, skipped: DataFrame, id: str = "page_id") -> DataFrame:
    """The elements that are no (id, pre) of ``skipped`` and in none, by a running maximum of where skipped elements end."""
    marked = elements.join(large(skipped.select(id, "pre", F.lit(True).alias("__skip"))), [id, "pre"], "left")
    w = Window.partitionBy(id).orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("__skip"), F.col("last"))).over(w)
    return marked.withColumn("__reach", reach).filter(F.coalesce("__reach", F.lit(-1)) < F.col("pre")).drop("__skip", "__reach")


def depths(entries: DataFrame, id: str = "page_id") -> DataFrame:
    """Adds ``depth``: how many entries (id, pre, last) lie around each, by a running sum of beginnings and ends."""
    begins = entries.select(id, F.col("pre").alias("at"), F.lit(0).alias("order"), F.lit(1).alias("change"))
    ends = entries.select(id, F.col("last").alias("at"), F.lit(1).alias("order"), F.lit(-1).alias("change"))
    w = Window.partitionBy(id).orderBy("at", "order").rowsBetween(Window.unboundedPreceding, 0)
    level = begins.unionByName(ends).withColumn("depth", F.sum("change").over(w) - 1).filter("change = 1").select(id, F.col("at").alias("pre"), F.col("depth").cast("int"))
    return entries.join(large(level), [id, "pre"])


def member_runs(elements: DataFrame, id: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """Regions (id, parent, shape, first, n, whole), and their members but for the first, which are not gone into."""
    runs = written(region_runs(elements.select(id, "parent", "pre", "shape"), id, MIN_RUN), "member-runs")
    sizes = elements.groupBy(id, "parent").agg(F.count(F.lit(1)).alias("all"))
    regions = runs.join(large(sizes), [id, "parent"]).withColumn("whole", F.col("n") == F.col("all")).drop("all")
    skipped = elements.join(large(runs.select(id, "parent", "shape", "first")), [id, "parent", "shape"]).filter("pre <> first").select(id, "pre")
    return regions, skipped


def dom_entries(pages: DataFrame, id: str = "page_id") -> DataFrame:
    """id, pre, start, label, depth, kind, observed, declared, complete: what a DOM index lists, in order of ``start``.

    An entry of kind ``element`` is where a chain of wrappers ends that begins at ``start``; its label names the chain. One of kind
    ``region`` is the first of its members; ``declared`` is told if the members are all that the container holds.
    """
    elements = written(structure(pages, id), "structure")
    regions, skipped = member_runs(elements, id)
    seen = written(outside(elements, skipped, id), "seen")
    firsts = regions.select(id, F.col("first").alias("pre"), "parent", F.col("n").alias("observed"), "whole")
    holders = elements.select(id, F.col("pre").alias("parent"), F.col("declared").alias("said"))
    firsts = firsts.join(large(holders), [id, "parent"], "left").select(id, "pre", "observed", F.when(F.col("whole"), F.col("said")).alias("declared"))
    # a region's first member is an entry of its own: no chain runs through it
    marked = seen.join(large(firsts.select(id, "pre", F.lit(True).alias("region"))), [id, "pre"], "left")
    kids = elements.groupBy(id, F.col("parent").alias("pre")).agg(F.count(F.lit(1)).alias("kids"), F.min("pre").alias("child"))
    folds = chains(marked.withColumn("named", F.col("named") | F.coalesce("region", F.lit(False))), kids, id)
    # what a wrapper holds is within its chain; all else begins one
    within = folds.filter("length > 0").select(id, F.col("pre").alias("parent")).join(large(seen.select(id, "pre", "parent")), [id, "parent"])
    starts = folds.join(large(within.select(id, "pre")), [id, "pre"], "left_anti")
    entries = starts.select(id, F.col("pre").alias("start"), F.col("target").alias("pre"), "path").join(large(seen.select(id, "pre", "last", "label")), [id, "pre"]).withColumn("label", F.array_join(F.concat("path", F.array("label")), " > "))
    entries = written(entries.join(large(firsts.withColumnRenamed("pre", "start")), [id, "start"], "left"), "entries")
    levels = depths(entries.select(id, "pre", "last"), id).select(id, "pre", "depth")
    told = entries.join(large(levels), [id, "pre"]).filter(F.col("depth") <= MAX_DEPTH)
    return told.select(id, "pre", "start", "label", "depth", F.when(F.col("observed").isNull(), "element").otherwise("region").alias("kind"), "observed", "declared", F.when(F.col("observed").isNotNull(), F.coalesce(F.col("declared") == F.col("observed"), F.lit(False))).alias("complete"))


@query("dom_entries")
def dom_index(spark, sf):
    return dom_entries(read(spark, sf, "pages"))


# The accessibility tree.

# States that a node's shape has by name; roles that take their name from what they hold.
STATES = ("checked", "disabled", "expanded", "pressed", "selected", "required", "readonly", "invalid", "current")
NAMED_BY_CONTENT = ("button", "link", "heading", "listitem", "cell", "row", "option", "tab", "menuitem", "checkbox", "radio", "switch", "treeitem")


def role_of(n: Column) -> Column:
    """The role that an element says, or that its tag has; null without one."""
    said = F.lower(F.trim(F.substring_index(F.coalesce(n["attrs"]["role"], F.lit("")), " ", 1)))
    implied = None
    for role, selectors in ROLE_SELECTORS.items():
        for s in selectors:
            (_, holds), = css(s).alternatives[0]
            implied = F.when(holds(n), role) if implied is None else implied.when(holds(n), role)
    return F.when(said.isin("none", "presentation"), F.lit(None)).when(said != "", said).otherwise(implied)


def collapsed(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))


def ax_nodes(pages: DataFrame, id: str = "page_id") -> DataFrame:
    """id, pre, last, parent, role, name, level, states, ignored, shape: one row for each element with a role.

    ``parent`` is the nearest element with a role around it, -1 for none. The name is the label, alternative text or title
    that the element states, else, for roles named by content, its text. What is hidden, or lies in something hidden, is ignored.
    """
    nodes = F.col("nodes")
    parsed = with_nodes(pages.select(id, "html"))
    parsed = parsed.withColumn("roles", F.transform(nodes, lambda n: F.when(n["tag"] != "#text", role_of(n))))
    parsed = parsed.withColumn("above", enclosing(nodes, lambda n: F.get(F.col("roles"), n["pre"]).isNotNull()))
    parsed = parsed.withColumn("veil", enclosing(nodes, hidden, itself=True))
    name = lambda n, role: F.coalesce(*[F.when(collapsed(n["attrs"][a]) != "", collapsed(n["attrs"][a])) for a in ("aria-label", "alt", "title")], F.when(role.isin(*NAMED_BY_CONTENT), collapsed(node_text(nodes, n))), F.lit(""))
    level = lambda n: F.coalesce(n["attrs"]["aria-level"].try_cast("int"), F.when(n["tag"].rlike("^h[1-6]$"), F.substring(n["tag"], 2, 1).cast("int")))
    states = lambda n: F.filter(F.array(*map(F.lit, STATES)), lambda s: F.array_contains(F.map_keys(n["attrs"]), F.concat(F.lit("aria-"), s)) | F.array_contains(F.map_keys(n["attrs"]), s))

    def node(n):
        role = F.get(F.col("roles"), n["pre"])
        return F.struct(n["pre"].alias("pre"), n["last"].alias("last"), F.coalesce(F.get(F.col("above"), n["pre"]), F.lit(-1)).alias("parent"), role.alias("role"), name(n, role).alias("name"), level(n).alias("level"), states(n).alias("states"), F.get(F.col("veil"), n["pre"]).isNotNull().alias("ignored"))

    own = F.transform(F.filter(nodes, lambda n: F.get(F.col("roles"), n["pre"]).isNotNull()), node)
    # written, as the digests need what the walks gave, page by page
    parsed = written(parsed.select(id, own.alias("own")), "ax-own").withColumn("place", places_of(F.col("own")))
    parents = F.transform("own", lambda n: F.coalesce(F.try_element_at(F.col("place"), n["parent"]), F.lit(-1)))
    material = F.transform("own", lambda n: F.concat_ws("|", n["role"], F.array_join(n["states"], ","), F.coalesce(n["level"].cast("string"), F.lit("")), n["ignored"].cast("string")))
    parsed = parsed.withColumn("shapes", subtree_digests(parents, material))
    return parsed.select(id, F.posexplode("own").alias("i", "n"), "shapes").select(id, "n.*", F.get("shapes", F.col("i")).alias("shape"))


def ax_entries(nodes: DataFrame, id: str = "page_id") -> DataFrame:
    """id, pre, depth, label, role, name, ignored, kind, observed: what an accessibility index lists.

    A label is ``role "name"``, with the place among those of that role and name on the page, from 1, where there are several: enough to
    aim at the node. Runs of siblings of one shape are a region, of which only the first member is gone into.
    """
    nodes = written(nodes, "ax-nodes")
    regions, skipped = member_runs(nodes, id)
    same = nodes.groupBy(id, "role", "name").agg(F.count(F.lit(1)).alias("times"))
    nth = F.row_number().over(Window.partitionBy(id, "role", "name").orderBy("pre"))
    aimed = nodes.withColumn("nth", nth).join(large(same), [id, "role", "name"])
    text = F.concat("role", F.when(F.col("name") != "", F.concat(F.lit(' "'), "name", F.lit('"'))).otherwise(""), F.when(F.col("times") > 1, F.concat(F.lit(" #"), F.col("nth").cast("string"))).otherwise(""))
    seen = outside(aimed.withColumn("label", text), skipped, id)
    found = depths(written(seen, "ax-seen"), id).filter(F.col("depth") <= MAX_DEPTH)
    firsts = regions.select(id, F.col("first").alias("pre"), F.col("n").alias("observed"))
    return found.join(large(firsts), [id, "pre"], "left").select(id, "pre", "depth", "label", "role", "name", "ignored", F.when(F.col("observed").isNull(), "node").otherwise("region").alias("kind"), "observed")


@query("ax_entries")
def ax_index(spark, sf):
    return ax_entries(ax_nodes(read(spark, sf, "pages")))


@query("ax_links", r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS name FROM pages)
SELECT page_id, name, count(*) AS n FROM (SELECT page_id, trim(regexp_replace(name, '\s+', ' ', 'g')) AS name FROM a) GROUP BY 1, 2""")
def ax_links(spark, sf):
    """How often each link name stands on a page: links that stand once can be aimed at by name alone."""
    nodes = ax_nodes(read(spark, sf, "pages")).filter("role = 'link'")
    return nodes.groupBy("page_id", "name").agg(F.count(F.lit(1)).alias("n"))


@query("ax_items", "WITH i AS (SELECT page_id, len(regexp_extract_all(html, '<li>')) AS items FROM pages) SELECT page_id, items FROM i WHERE items > 0")
def ax_items(spark, sf):
    """Of each page how many list items its lists hold, by hoisted parents."""
    nodes = written(ax_nodes(read(spark, sf, "pages")).select("page_id", "pre", "parent", "role"), "ax-nodes")
    lists = nodes.filter("role = 'list'").select("page_id", F.col("pre").alias("parent"))
    return nodes.filter("role = 'listitem'").join(large(lists), ["page_id", "parent"]).groupBy("page_id").agg(F.count(F.lit(1)).alias("items"))
