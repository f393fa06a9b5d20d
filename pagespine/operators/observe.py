"""Observation indexes of pages: features and matches, repeated regions, anchors, diffs, windows and cuts.

Of a page's nodes, repeated sibling shapes are one region. Shapes come with the parse, runs from windows within a
parent; nothing but the parse is Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.structured import ld_types
from ..functions.text import class_tokens
from ..functions.trees import enclosing
from ..scratch import large, written
from ..sources.html import node_table, with_nodes
from ._registry import read, registry
from .pages import _TAGS, shapes

QUERIES, SQL, query = registry()

# Landmarks; thresholds of a match by layer; the fewest features that count; attributes that give identity.
LANDMARKS = ("header", "nav", "main", "aside", "footer", "section", "article", "form")
THRESHOLDS = {"skeleton": 0.40, "semantic": 0.50, "identity": 0.40, "ax": 0.50, "network": 0.50, "endpoint": 0.50}
MIN_SKELETON, MIN_OPTIONAL = 8, 3
IDENTITY_ATTRIBUTES = ("id", "data-testid", "name", "role", "aria-label")
# Tags that every page has.
FRAME_TAGS = ("html", "head", "body")
# How much a feature counts, by layer: (pattern of the whole feature in lower case, weight), the first that fits; else the last.
WEIGHTS = {
    "semantic": (("schema:.*", 3.0), ("role:.*", 2.0), ("h[^:]*:.*", 1.25), ("lm:(nav|footer|header)", 0.35), ("lm:(main|article|form)", 1.5), (".*", 1.0)),
    "identity": ((".*(testid|test-id|qa|cy|component).*", 2.0), ("data:(data-mw|data-reactroot)", 0.5), (".*", 1.0)),
    "ax": (("ax:(link|text|generic)", 0.5), ("ax:(main|article|form|search|button|table)", 1.5), (".*", 1.0)),
    "network": (("cookie:.*", 1.5), ("hdr:(date|content-length|cache-control|etag|last-modified)", 0.25), ("hdr:(server|x-powered-by|cf-.*)", 1.0), (".*", 0.75)),
    "endpoint": (("ep:(.*[^/])?", 3.0), (".*", 1.0)),
}
# Of a skeleton's paths, tags that say little with their weight, what names and blocks add, the blocks, the most.
PLAIN_TAGS, PLAIN_WEIGHT, CLASS_ADDS, NAME_ADDS, BLOCK_ADDS, MOST = ("html", "body", "div", "span", "ul", "li", "a"), 0.35, 0.75, 1.0, 0.5, 3.0
BLOCK_TAGS = ("main", "article", "section", "form", "table")


def jaccard(a: Column, b: Column) -> Column:
    """1 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    """How much of the smaller set is in the other: 1 if both are empty, 0 if one is."""
    least = F.least(F.size(a), F.size(b))
    return F.when(F.size(F.array_union(a, b)) == 0, 1.0).when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def weight(layer: str, x: Column) -> Column:
    """How much one feature counts: common frames little, what tells pages apart more."""
    if layer != "skeleton":
        out = None
        for pattern, w in WEIGHTS[layer]:
            hit = F.lower(x).rlike(f"(?s)^({pattern})$")
            out = F.when(hit, w) if out is None else out.when(hit, w)
        return out
    parts = F.array_remove(F.split(x, r"[/#.]+"), "")
    plain = F.array(*map(F.lit, PLAIN_TAGS))
    base = F.when((F.size(parts) > 0) & (F.size(F.array_except(parts, plain)) == 0), PLAIN_WEIGHT).otherwise(1.0)
    more = F.when(x.contains("."), CLASS_ADDS).otherwise(0.0) + F.when(x.contains("#"), NAME_ADDS).otherwise(0.0)
    block = F.when(F.arrays_overlap(parts, F.array(*map(F.lit, BLOCK_TAGS))), BLOCK_ADDS).otherwise(0.0)
    return F.least(F.lit(MOST), base + more + block)


def weighted_jaccard(layer: str, a: Column, b: Column) -> Column:
    total = lambda s: F.round(F.aggregate(s, F.lit(0.0), lambda n, x: n + weight(layer, x)), 9)
    union = total(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(total(F.array_intersect(a, b)) / union)


def with_weights(sets: DataFrame) -> DataFrame:
    """Adds ``weights``: of each layer in the struct ``own`` the weights of its features, in their order."""
    weights = lambda layer: F.transform(F.col("own")[layer], lambda x: weight(layer, x)).alias(layer)
    return sets.withColumn("weights", F.struct(*map(weights, sets.schema["own"].dataType.names)))


def weighted_overlap(a: Column, in_a: Column, b: Column, in_b: Column) -> Column:
    """``weighted_jaccard`` of sets a and b whose features' weights are known."""
    total = lambda w: F.aggregate(w, F.lit(0.0), lambda n, x: n + x)
    shared = F.round(total(F.zip_with(a, in_a, lambda x, w: F.when(F.array_contains(b, x), w).otherwise(0.0))), 9)
    union = F.round(total(in_a) + total(in_b) - shared, 9)
    return F.when(union == 0, 1.0).otherwise(shared / union)


def features(pages: DataFrame) -> DataFrame:
    """page_id, skeleton, semantic, identity: sorted feature arrays of each page, from one parse."""
    nodes = F.col("nodes")
    elements = F.filter(nodes, lambda n: n["tag"] != "#text")

    def symbol(n):
        known = None
        for a in IDENTITY_ATTRIBUTES:
            hit = F.coalesce(n["attrs"][a], F.lit("")) != ""
            known = hit if known is None else known | hit
        classes = F.slice(class_tokens(F.coalesce(n["attrs"]["class"], F.lit(""))), 1, 2)
        return F.concat(n["tag"], F.when(known, "#").otherwise(""), F.array_join(F.transform(classes, lambda c: F.concat(F.lit("."), c)), ""))

    marked = with_nodes(pages.select("page_id", "html")).withColumn("marks", F.transform(nodes, lambda n: F.when(n["tag"] != "#text", symbol(n))))
    marks = F.col("marks")
    paths = F.transform(elements, lambda n: F.when(n["parent"] < 0, marks[n["pre"]]).otherwise(F.concat_ws("/", F.get(marks, n["parent"]), F.get(marks, n["pre"]))))
    tags = F.transform(elements, lambda n: n["tag"])
    semantic = [F.transform(F.array_intersect(F.array(*map(F.lit, LANDMARKS)), tags), lambda t: F.concat(F.lit("lm:"), t))]
    roles = F.filter(F.transform(elements, lambda n: F.lower(F.trim(n["attrs"]["role"]))), lambda r: F.coalesce(r, F.lit("")) != "")
    semantic.append(F.transform(roles, lambda r: F.concat(F.lit("role:"), r)))
    for level in range(1, 7):
        n = F.size(F.filter(tags, lambda t: t == f"h{level}"))  # noqa: B023
        semantic.append(F.when(n > 0, F.array(F.concat(F.lit(f"h{level}:"), F.when(n <= 2, "lo").when(n <= 6, "mid").otherwise("hi")))).otherwise(F.array().cast("array<string>")))
    kinds = F.filter(F.transform(elements, lambda n: F.regexp_extract(n["attrs"]["itemtype"], "([^/]+)/*$", 1)), lambda t: F.coalesce(t, F.lit("")) != "")
    semantic.append(F.transform(kinds, lambda t: F.concat(F.lit("schema:"), F.trim(t))))
    semantic.append(F.transform(ld_types(nodes), lambda t: F.concat(F.lit("schema:"), t)))
    identity = F.transform(F.filter(F.flatten(F.transform(elements, lambda n: F.map_keys(n["attrs"]))), lambda k: k.startswith("data-")), lambda k: F.concat(F.lit("data:"), k))
    tidy = lambda a: F.array_sort(F.array_distinct(a))
    return marked.select("page_id", tidy(paths).alias("skeleton"), tidy(F.concat(*semantic)).alias("semantic"), tidy(identity).alias("identity"))


@query("semantic_features", f"""WITH {_TAGS}, f AS (SELECT page_id, CASE WHEN tag IN {LANDMARKS} THEN 'lm:' || tag ELSE tag || ':' || CASE WHEN n <= 2 THEN 'lo' WHEN n <= 6 THEN 'mid' ELSE 'hi' END END AS feature FROM hist WHERE tag IN {LANDMARKS} OR regexp_matches(tag, '^h[1-6]$'))
SELECT page_id, feature FROM f""")
def semantic_features(spark, sf):
    return features(read(spark, sf, "pages")).select("page_id", F.explode("semantic").alias("feature"))


def match(joined: DataFrame) -> DataFrame:
    """Adds score, containment_score and same_shape for rows with a struct of features on either side (own, their).

    Layers that the structs lack don't take part. All that both sides carry (skeleton and semantic always, the others with
    ``MIN_OPTIONAL`` features or more) have to reach their thresholds; thin pages match nothing. Weights that stand beside
    the features (own_weights, their_weights) are used, else they are found for each row.
    """
    own, their = F.col("own"), F.col("their")
    layers, found, known = {}, {}, joined.schema["own"].dataType.names
    for layer in (x for x in THRESHOLDS if x in known):
        a, b = own[layer], their[layer]
        carried = F.lit(True) if layer in ("skeleton", "semantic") else (F.size(a) >= MIN_OPTIONAL) & (F.size(b) >= MIN_OPTIONAL)
        near = weighted_overlap(a, F.col("own_weights")[layer], b, F.col("their_weights")[layer]) if "own_weights" in joined.columns else weighted_jaccard(layer, a, b)
        # columns of their own, as the scores and the verdict all read them
        found |= {f"__near_{layer}": F.when(carried, near), f"__held_{layer}": F.when(carried, containment(a, b))}
        layers[layer] = (F.col(f"__near_{layer}"), F.col(f"__held_{layer}"))
    thick = (F.size(own["skeleton"]) >= MIN_SKELETON) & (F.size(their["skeleton"]) >= MIN_SKELETON)
    same = thick
    for layer, (w, _) in layers.items():
        same = same & F.coalesce(w >= THRESHOLDS[layer], F.lit(True))
    mean = lambda i: F.when(thick, F.round(sum((F.coalesce(v[i], F.lit(0.0)) for v in layers.values()), F.lit(0.0)) / sum((F.when(v[i].isNotNull(), 1).otherwise(0) for v in layers.values()), F.lit(0)), 9)).otherwise(0.0)
    return joined.withColumns(found).select(*joined.columns, mean(0).alias("score"), mean(1).alias("containment_score"), same.alias("same_shape"))


@query("page_matches")
def page_matches(spark, sf):
    """Each page against the first page of its shape bucket: links grow with the pages, not with their pairs."""
    pages = read(spark, sf, "pages")
    # both parse; their results are written once, and exemplars are taken from them
    own = written(shapes(pages).select("page_id", "shape").join(features(pages), "page_id").select("page_id", "shape", F.struct("skeleton", "semantic", "identity").alias("own")), "page-features")
    first = own.groupBy("shape").agg(F.min_by(F.struct(F.col("page_id").alias("exemplar"), F.col("own").alias("their")), "page_id").alias("e")).select("shape", "e.*")
    return match(own.join(first, "shape")).select("page_id", "exemplar", "score", "containment_score", "same_shape")


# Repeated regions.


def with_shapes(nodes: DataFrame) -> DataFrame:
    """The content elements, which have a shape: the tag over their content children's shapes."""
    return nodes.filter(F.col("shape").isNotNull())


def region_runs(shaped: DataFrame, id: str = "page_id", least: int = 2) -> DataFrame:
    """id, parent, shape, first, n: adjacent siblings of one shape, if the shape has a single run under its parent."""
    w = Window.partitionBy(id, "parent").orderBy("pre")
    starts = shaped.withColumn("new", F.coalesce((F.col("shape") != F.lag("shape").over(w)).cast("int"), F.lit(1)))
    runs = starts.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(id, "parent", "shape", "run").agg(F.min("pre").alias("first"), F.count(F.lit(1)).alias("n"))
    single = runs.groupBy(id, "parent", "shape").agg(F.count(F.lit(1)).alias("runs"), F.min("first").alias("first"), F.max("n").alias("n"))
    return single.filter((F.col("runs") == 1) & (F.col("n") >= least)).drop("runs")


@query("region_index")
def region_index(spark, sf):
    """Regions of each page with the label of an exemplar and the number of members."""
    nodes = written(node_table(read(spark, sf, "pages").select("page_id", "html")).select("page_id", "pre", "parent", "tag", "attrs", "shape"), "nodes")
    body = with_shapes(nodes)
    label = F.concat(F.col("tag"), F.when(F.coalesce(F.col("attrs")["id"], F.lit("")) != "", F.concat(F.lit("#"), F.col("attrs")["id"])).otherwise(""), F.when(F.coalesce(F.col("attrs")["class"], F.lit("")) != "", F.concat(F.lit("."), F.substring_index(F.trim(F.col("attrs")["class"]), " ", 1))).otherwise(""))
    exemplars = nodes.select("page_id", F.col("pre").alias("first"), label.alias("exemplar"))
    return region_runs(body).join(large(exemplars), ["page_id", "first"]).select("page_id", "parent", "first", "shape", "exemplar", F.col("n").alias("members"))


@query("adjacent_runs", """WITH i AS (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pre FROM lineitem),
e AS (SELECT *, CASE WHEN lag(l_returnflag) OVER w = l_returnflag THEN 0 ELSE 1 END AS new FROM i WINDOW w AS (PARTITION BY l_orderkey ORDER BY pre)),
r AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY pre) AS run FROM e), g AS (SELECT l_orderkey, l_returnflag, run, min(pre) AS first, count(*) AS n FROM r GROUP BY 1, 2, 3)
SELECT l_orderkey, l_returnflag, min(first)::INTEGER AS first, max(n) AS n FROM g GROUP BY 1, 2 HAVING count(*) = 1 AND max(n) >= 2""")
def adjacent_runs(spark, sf):
    """The run rule on a table: an order's lines as siblings, their return flags as shapes."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    e = read(spark, sf, "lineitem").select("l_orderkey", F.lit(0).alias("parent"), F.col("l_returnflag").alias("shape"), place.alias("pre"))
    return region_runs(e, "l_orderkey").select("l_orderkey", F.col("shape").alias("l_returnflag"), "first", "n")


# What a tag's or attribute's name is like that a key may have; what no key may hold.
SAFE_NAME, RESERVED = r"^[A-Za-z][A-Za-z0-9_-]*$", '["#|]'


def anchor_keys(tag: Column, attrs: Column) -> Column:
    """array<string>: what may tell an element from all others, the most durable first: id, data attributes by name, class,
    the attribute written first, the first two together, and the tag."""
    pair = lambda name, value: F.concat(name, F.lit("="), value)
    names = F.map_keys(attrs)
    data = F.transform(F.array_sort(F.filter(names, lambda k: k.startswith("data-") & k.rlike(SAFE_NAME))), lambda k: pair(k, attrs[k]))
    classes = F.array_join(F.array_remove(F.split(F.coalesce(attrs["class"], F.lit("")), r"\s+"), ""), " ")
    first = F.get(names, F.lit(0))
    told = F.slice(F.filter(names, lambda k: attrs[k] != ""), 1, 2)
    both = F.when((F.size(told) == 2) & F.forall(told, lambda k: k.rlike(SAFE_NAME) & ~attrs[k].contains(";")), F.concat(F.lit("both("), F.array_join(F.transform(told, lambda k: pair(k, attrs[k])), ";"), F.lit(")")))
    one = lambda hit, key: F.array(F.when(hit, key))
    keys = F.concat(one(F.coalesce(attrs["id"], F.lit("")) != "", pair(F.lit("id"), attrs["id"])), data, one(classes != "", pair(F.lit("class"), classes)), one(first.rlike(SAFE_NAME), pair(first, attrs[first])), F.array(both), one(~tag.isin(*FRAME_TAGS) & tag.rlike(SAFE_NAME), F.concat(F.lit("tag:"), tag)))
    return F.array_distinct(F.filter(keys, lambda k: k.isNotNull()))


def anchors(nodes: DataFrame, id: str = "page_id") -> DataFrame:
    """id, pre, key: the most durable key that no other element of the page has."""
    own = nodes.filter(F.col("tag") != "#text")
    long = own.select(id, "pre", F.posexplode(anchor_keys(F.col("tag"), F.col("attrs"))).alias("tier", "key"))
    census = long.groupBy(id, "key").agg(F.count(F.lit(1)).alias("times"), F.min("pre").alias("pre"), F.min("tier").alias("tier")).filter("times = 1")
    return census.filter(~F.col("key").rlike(RESERVED)).groupBy(id, "pre").agg(F.min_by("key", "tier").alias("key"))


@query("page_anchors")
def page_anchors(spark, sf):
    return anchors(node_table(read(spark, sf, "pages").select("page_id", "html")))


def nearest_anchors(nodes: DataFrame, found: DataFrame, id: str = "page_id") -> DataFrame:
    """id, pre, anchor, key: of each element the nearest element at or above it that has a key (``found``), by one walk over a page's
    elements in order."""
    own = nodes.filter(F.col("tag") != "#text").select(id, "pre", "last").join(large(found.select(id, "pre", "key")), [id, "pre"], "left")
    page = own.groupBy(id).agg(F.array_sort(F.collect_list(F.struct("pre", "last", "key"))).alias("own"))
    page = page.withColumn("near", enclosing(F.col("own"), lambda n: n["key"].isNotNull(), itself=True))
    page = page.withColumn("keys", F.map_from_entries(F.transform(F.filter("own", lambda n: n["key"].isNotNull()), lambda n: F.struct(n["pre"], n["key"]))))
    each = page.select(id, "keys", F.explode(F.arrays_zip(F.col("own.pre").alias("pre"), F.col("near").alias("anchor"))).alias("x"))
    return each.filter("x.anchor IS NOT NULL").select(id, "x.pre", "x.anchor", F.try_element_at("keys", F.col("x.anchor")).alias("key"))


@query("anchor_counts")
def anchor_counts(spark, sf):
    """How many elements of each page have something durable above them."""
    nodes = written(node_table(read(spark, sf, "pages").select("page_id", "html")).select("page_id", "pre", "last", "depth", "tag", "attrs"), "nodes")
    return nearest_anchors(nodes, anchors(nodes)).groupBy("page_id").agg(F.count(F.lit(1)).alias("anchored"), F.countDistinct("anchor").alias("anchors"))


# Indexes: diff, windows, cuts.


def diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, kind: added, removed, changed or unchanged; entries without a key don't take part."""
    a = before.filter(F.col(key).isNotNull()).select(key, F.struct(*fields).alias("__a"))
    b = after.filter(F.col(key).isNotNull()).select(key, F.struct(*fields).alias("__b"))
    kind = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, kind.alias("kind"))


@query("index_diff", """WITH e AS (SELECT event_id, 'r' || user_id AS ref, event_type AS label FROM events), a AS (SELECT ref, arg_min(label, event_id) AS label FROM e WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT ref, arg_min(label, event_id) AS label FROM e WHERE event_id % 2 = 1 GROUP BY 1)
SELECT ref, CASE WHEN a.label IS NULL THEN 'added' WHEN b.label IS NULL THEN 'removed' WHEN a.label <> b.label THEN 'changed' ELSE 'unchanged' END AS kind FROM a FULL JOIN b USING (ref)""")
def index_diff(spark, sf):
    e = read(spark, sf, "events").select("event_id", F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("ref"), F.col("event_type").alias("label"))
    side = lambda r: e.filter(F.col("event_id") % 2 == r).groupBy("ref").agg(F.min_by("label", "event_id").alias("label"))
    return diff(side(0), side(1), "ref", ["label"])


def depth_cut(candidates: DataFrame, scope: list[str], depth: str, budget: int) -> DataFrame:
    """scope, depth, deepest, retained, proposed: the deepest level whose candidates, with all above, fit the budget."""
    n = candidates.groupBy(*scope, depth).agg(F.count(F.lit(1)).alias("__n"))
    # one row a level: few, whatever the number of candidates
    total = F.sum("__n").over(Window.partitionBy(*scope).orderBy(depth).rowsBetween(Window.unboundedPreceding, 0))
    level = n.withColumn("__total", total)
    fits = F.col("__total") <= budget
    out = level.groupBy(*scope).agg(F.coalesce(F.max(F.when(fits, F.col(depth))), F.lit(0)).alias("cut"), F.max(depth).alias("deepest"), F.coalesce(F.max(F.when(fits, F.col("__total"))), F.min("__total")).alias("retained"), F.max("__total").alias("proposed"))
    return out


@query("depth_cuts", """WITH n AS (SELECT source, length(text) % 9 AS depth, count(*) AS n FROM documents GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY depth) AS total FROM n)
SELECT source, coalesce(max(CASE WHEN total <= 40 THEN depth END), 0)::BIGINT AS cut, max(depth)::BIGINT AS deepest, coalesce(max(CASE WHEN total <= 40 THEN total END), min(total))::BIGINT AS retained, max(total)::BIGINT AS proposed FROM c GROUP BY 1""")
def depth_cuts(spark, sf):
    d = read(spark, sf, "documents").select("source", (F.length("text") % 9).cast("long").alias("depth"))
    return depth_cut(d.filter("depth IS NOT NULL"), ["source"], "depth", 40)


@query("page_windows", "SELECT conv_id, turn, ord // 3 + 1 AS page FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord FROM conversations)")
def page_windows(spark, sf, size: int = 3):
    """Entries of an index in windows of ``size``."""
    ord_ = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    c = read(spark, sf, "conversations").select("conv_id", "turn", ord_.alias("ord"))
    return c.select("conv_id", "turn", (F.floor(F.col("ord") / size) + 1).cast("long").alias("page"))


def overview(entries: DataFrame, scope: str, budget: int, footer: int = 48) -> DataFrame:
    """The entries that fit a budget of tokens, taken greedily in order of tier; what is too big is passed over.

    Greedy packing depends on all earlier choices, so an index, which is bounded by its page, is packed by one fold.
    """
    items = F.array_sort(F.collect_list(F.struct("tier", "ord", "tokens")))
    start = F.struct(F.lit(budget - footer).cast("long").alias("left"), F.array().cast("array<long>").alias("taken"))
    fold = F.aggregate(items, start, lambda s, e: F.when(e["tokens"] <= s["left"], F.struct((s["left"] - e["tokens"]).alias("left"), F.concat(s["taken"], F.array(e["ord"])).alias("taken"))).otherwise(s), lambda s: s["taken"])
    return entries.groupBy(scope).agg(fold.alias("taken"))


@query("overviews")
def overviews(spark, sf):
    """Of each page's elements what fits 200 tokens: headings, then regions, then the rest."""
    nodes = node_table(read(spark, sf, "pages").select("page_id", "html")).filter("tag <> '#text'")
    tier = F.when(F.col("depth") == 0, 0).when(F.col("tag").rlike("^h[1-6]$"), 1).when(F.col("tag").isin("ul", "ol", "table", "nav", "article"), 2).when(F.col("attrs")["id"].isNotNull(), 3).otherwise(4)
    entries = nodes.select("page_id", tier.alias("tier"), F.col("pre").cast("long").alias("ord"), F.ceil((F.length("tag") + F.lit(12)) / 4).cast("long").alias("tokens"))
    return overview(entries, "page_id", 200)
