"""Stored references of page shapes, pages classified against them, and elements found again in another version of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import class_tokens
from ..functions.trees import descents, places_of
from ..scratch import large, written
from ..sources.html import node_text, with_nodes
from ._registry import read, registry
from .observe import IDENTITY_ATTRIBUTES, THRESHOLDS, features
from .similar import candidates, compared, feature_sets, ordered, postings, ranked, sectioned, weighed

QUERIES, SQL, query = registry()

#: Two references whose scores lie closer than this are not told apart.
MARGIN = 1e-9


def references(pages: DataFrame) -> DataFrame:
    """id, own: a reference for each distinct set of features that the pages have; the page with the least id stands for it."""
    return feature_sets(features(pages)).select("id", "own")


def classified(pages: DataFrame, stored: DataFrame) -> DataFrame:
    """page_id, reference, score, status: the best stored reference (id, own) of the page's shape, by the index of similar sets.

    ``match``: one scores best, and is told; ``ambiguous``: several do, the least is told; ``none``: no reference has the page's shape.
    Only distinct features are compared, and only with references that share a feature of a prefix.
    """
    found = written(features(pages), "page-features")
    sets = written(feature_sets(found), "asked-features")
    # stored and asked sets are numbered apart, as their ids may be equal
    both = stored.select((F.col("id") * 2).alias("id"), "own").unionByName(sets.select((F.col("id") * 2 + 1).alias("id"), "own"))
    items = written(weighed(both), "weighed")
    posts = postings(ordered(items, ranked(items), THRESHOLDS["skeleton"])).withColumn("side", (F.col("id") % 2).cast("int"))
    met = candidates(posts, THRESHOLDS["skeleton"]).select(*[F.when(F.col("a") % 2 == side, F.col("a")).otherwise(F.col("b")).alias(name) for side, name in ((0, "stored"), (1, "asked"))])
    met = met.select(F.floor(F.col("stored") / 2).alias("reference"), F.floor(F.col("asked") / 2).alias("asked"))
    good = written(compared(met, "asked", sets, "reference", stored).filter("same_shape").select("asked", "reference", "score"), "matches")
    best = good.groupBy("asked").agg(F.max("score").alias("best"))
    near = good.join(large(best), "asked").filter(F.col("score") >= F.col("best") - MARGIN).groupBy("asked").agg(F.min("reference").alias("reference"), F.max("score").alias("score"), F.count(F.lit(1)).alias("n"))
    keys = [c for c in found.columns if c != "page_id"]
    told = found.join(large(sets.select(F.col("id").alias("asked"), "own.*")), keys).select("page_id", "asked").join(large(near), "asked", "left")
    return told.select("page_id", "reference", "score", F.when(F.col("n").isNull(), "none").when(F.col("n") == 1, "match").otherwise("ambiguous").alias("status"))


@query("page_classes")
def page_classes(spark, sf):
    """Every page against references made from the pages of even id."""
    pages = sectioned(read(spark, sf, "pages"))
    stored = written(references(pages.filter("page_id % 2 = 0")), "references")
    return classified(pages, stored)


# Elements, seen and found again.

# Fixed value: how many siblings either side are kept.
SIBLINGS = 3
#: What an element found again is scored by; a candidate below the least score is not it.
SCORES = {"identity": 4.0, "text": 2.0, "classes": 1.5, "ancestry": 1.5, "siblings": 1.0}
LEAST_SCORE = 0.5


def observations(pages: DataFrame, id: str = "page_id") -> DataFrame:
    """id, pre, tag, identity, classes, text, ancestry, siblings, parent_tag of every element.

    ``identity`` holds the attributes that name it; ``ancestry`` the tags from the top, ``siblings`` those of up to three before and three after.
    """
    nodes = F.col("nodes")
    own = with_nodes(pages.select(id, "html")).withColumn("own", F.filter(nodes, lambda n: n["tag"] != "#text"))
    own = own.withColumn("place", places_of(F.col("own")))
    parents = F.transform("own", lambda n: F.coalesce(F.try_element_at(F.col("place"), n["parent"]), F.lit(-1)))
    own = own.withColumn("paths", descents(parents, F.transform("own", lambda n: n["tag"]), F.transform("own", lambda n: F.lit(False))))
    identity = lambda n: F.map_filter(n["attrs"], lambda k, v: k.isin(*IDENTITY_ATTRIBUTES) & (F.trim(v) != ""))
    text = lambda n: F.trim(F.regexp_replace(node_text(nodes, n), r"(?U)\s+", " "))
    each = F.transform("own", lambda n, i: F.struct(n["pre"].alias("pre"), n["parent"].alias("parent"), n["tag"].alias("tag"), F.transform_values(identity(n), lambda k, v: F.trim(v)).alias("identity"), class_tokens(F.coalesce(n["attrs"]["class"], F.lit(""))).alias("classes"), F.nullif(text(n), F.lit("")).alias("text"), F.get("paths", i).alias("path")))
    rows = own.select(id, F.explode(each).alias("n")).select(id, "n.*")
    w = Window.partitionBy(id, "parent").orderBy("pre")
    around = F.array(*[F.lag("tag", k).over(w) for k in range(SIBLINGS, 0, -1)], *[F.lead("tag", k).over(w) for k in range(1, SIBLINGS + 1)])
    ancestry = F.slice(F.split(F.col("path"), "/"), 2, F.greatest(F.size(F.split(F.col("path"), "/")) - 2, F.lit(0)))
    return rows.withColumn("siblings", F.filter(around, lambda x: x.isNotNull())).withColumn("ancestry", ancestry).select(id, "pre", "tag", "identity", "classes", "text", "ancestry", "siblings", F.try_element_at("ancestry", F.lit(-1)).alias("parent_tag"))


def blocks(seen: DataFrame) -> Column:
    """What an element and its counterpart have in common at least: a naming attribute, the text, or tag, classes and ancestry."""
    named = F.transform(F.map_entries("identity"), lambda e: F.concat(F.lit("i:"), e["key"], F.lit("="), e["value"]))
    told = F.when(F.col("text").isNotNull(), F.concat(F.lit("t:"), "tag", F.lit(":"), F.sha2("text", 256)))
    kind = F.concat(F.lit("k:"), "tag", F.lit("."), F.array_join("classes", "."), F.lit(":"), F.array_join("ancestry", "/"))
    return F.filter(F.concat(named, F.array(told, kind)), lambda x: x.isNotNull())


def _overlap(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(None)).otherwise(F.size(F.array_intersect(a, b)) / union)


def found_again(before: DataFrame, after: DataFrame, id: str = "page_id", most: int = 64) -> DataFrame:
    """id, pre, found, score: for each element of ``before`` (rows of ``observations``) the one of ``after`` that is most like it.

    Candidates share a block; blocks of more than ``most`` elements of a page on either side tell nothing by themselves and are left to the others
    that the element is in. Parts that neither side has don't count. A tie, or less than ``LEAST_SCORE``, finds nothing.
    """
    def keyed(df):
        each = df.select(id, "pre", F.explode(blocks(df)).alias("block"))
        sizes = each.groupBy(id, "block").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most)
        return each.join(sizes.drop("n"), [id, "block"])

    met = keyed(before).join(keyed(after).withColumnRenamed("pre", "found"), [id, "block"]).select(id, "pre", "found").distinct()
    columns = ("tag", "identity", "classes", "text", "ancestry", "siblings")
    joined = met.join(before.select(id, "pre", F.struct(*columns).alias("x")), [id, "pre"]).join(after.select(id, F.col("pre").alias("found"), F.struct(*columns).alias("y")), [id, "found"]).filter("x.tag = y.tag")
    x, y = F.col("x"), F.col("y")
    entries = lambda s: F.transform(F.map_entries(s["identity"]), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    parts = {"identity": _overlap(entries(x), entries(y)), "text": F.when(x["text"].isNotNull() | y["text"].isNotNull(), F.coalesce((x["text"] == y["text"]).cast("double"), F.lit(0.0))), "classes": _overlap(x["classes"], y["classes"]), "ancestry": F.when(x["ancestry"] == y["ancestry"], 1.0).otherwise(_overlap(x["ancestry"], y["ancestry"])), "siblings": F.when(x["siblings"] == y["siblings"], 1.0).otherwise(_overlap(x["siblings"], y["siblings"]))}
    weight = sum((F.when(p.isNotNull(), SCORES[k]).otherwise(0.0) for k, p in parts.items()), F.lit(0.0))
    score = F.round(sum((F.coalesce(p, F.lit(0.0)) * SCORES[k] for k, p in parts.items()), F.lit(0.0)) / F.greatest(weight, F.lit(1.0)), 9)
    scored = written(joined.select(id, "pre", "found", score.alias("score")).filter(F.col("score") >= LEAST_SCORE), "found-scores")
    best = scored.groupBy(id, "pre").agg(F.max("score").alias("score"))
    alone = scored.join(best, [id, "pre", "score"]).groupBy(id, "pre", "score").agg(F.count(F.lit(1)).alias("n"), F.min("found").alias("found")).filter("n = 1")
    return before.select(id, "pre").join(alone.select(id, "pre", "found", "score"), [id, "pre"], "left")


@query("element_observations", r"""SELECT page_id, unnest(l) AS text, 'html/body/nav/ul/li' AS ancestry, least(3, generate_subscripts(l, 1) - 1)::INTEGER AS before FROM (SELECT page_id, [trim(regexp_replace(x, '\s+', ' ', 'g')) FOR x IN regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<li><a href="[^"]*">([^<]*)</a></li>', 1)] AS l FROM pages)""")
def element_observations(spark, sf):
    """The links of each page's navigation as they are seen, with how many siblings before their list item are kept."""
    seen = written(observations(read(spark, sf, "pages")), "observations")
    items = seen.filter("tag = 'a' AND array_join(ancestry, '/') = 'html/body/nav/ul/li'")
    lists = seen.filter("tag = 'li' AND array_join(ancestry, '/') = 'html/body/nav/ul'")
    before = lists.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("pre"))).select("page_id", (F.col("pre") + 1).alias("pre"), F.least(F.lit(SIBLINGS), F.col("place") - 1).cast("int").alias("before"))
    return items.join(before, ["page_id", "pre"]).select("page_id", F.coalesce("text", F.lit("")).alias("text"), F.array_join("ancestry", "/").alias("ancestry"), "before")
