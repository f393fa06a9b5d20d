"""Pages of one shape, whatever their shape buckets: a weighted set-similarity join by prefix filtering.

Features are ordered from the rarest on. Two sets whose weighted Jaccard similarity reaches a bound have a feature in
common among those with which the rest of the set still weighs the bound's share, the prefix; so only prefixes are
indexed. A pair is taken from the list of its first common feature only, and is passed over there if sizes, or what is left behind
that feature, can't reach the bound. Every pair over the bound is a candidate; none is lost. Long lists are cut into blocks that
are paired with each other, so that a feature of very many sets is many tasks. Equal sets are one, with their pages beside.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import large, numbered, written
from ._registry import read, registry
from .observe import MIN_SKELETON, THRESHOLDS, features, match, weight, with_weights

QUERIES, SQL, query = registry()

#: Members of a list that are paired off in one task; rows and bytes of a table of features that is broadcast.
BLOCK, SMALL_ROWS, SMALL_BYTES = 512, 200_000, 32 << 20
#: Sums of weights are rounded to so many places before they are compared.
PLACES = 9


def small(df: DataFrame, column: str) -> bool:
    """Whether a table of (a string column and a few numbers) may be broadcast."""
    n = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("bytes")).first()
    return n["rows"] <= SMALL_ROWS and n["bytes"] <= SMALL_BYTES


def ordered(sets: DataFrame, ranks: DataFrame, bound: float) -> DataFrame:
    """id, total, list: a set's features by rank as (rank, weight, rest), and ``prefix``, how many of them are indexed."""
    each = sets.select("id", F.inline("items"))
    each = each.join(F.broadcast(ranks) if small(ranks, "item") else ranks, "item")
    lists = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "weight"))).alias("list"), F.round(F.sum("weight"), PLACES).alias("total"))
    rest = F.expr("transform(list, (x, i) -> named_struct('rank', x.rank, 'rest', aggregate(slice(list, i + 1, size(list)), 0D, (n, y) -> n + y.weight)))")
    return lists.withColumn("list", rest).withColumn("prefix", F.expr(f"size(filter(list, x -> x.rest >= {bound}D * total - 1e-9D))"))


def ranked(sets: DataFrame) -> DataFrame:
    """(item, rank): the sets' features, the rarest first."""
    counts = sets.select(F.explode("items.item").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    return written(numbered(written(counts, "feature-counts"), [F.col("n"), F.col("item")], "rank").select("item", "rank"), "feature-ranks")


def postings(lists: DataFrame) -> DataFrame:
    """rank, id, total, rest, before: one row for each feature of a prefix, with the features before it."""
    at = F.expr("transform(slice(list, 1, prefix), (x, i) -> named_struct('rank', x.rank, 'rest', x.rest, 'before', transform(slice(list, 1, i), y -> y.rank)))")
    return lists.select("id", "total", F.inline(at))


def _met(bound: float):
    """Pairs of a block pair's members that meet first in its list and may reach the bound."""

    def run(batches):
        for batch in batches:
            a, b = [], []
            for low, high, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                members = listed.as_py()
                one, two = [m for m in members if m["block"] == low], [m for m in members if m["block"] == high]
                totals, rests = (np.array([m[k] for m in two]) for k in ("total", "rest"))
                seen = [frozenset(m["before"]) for m in two]
                for m in one:
                    able = (np.minimum(totals, m["total"]) >= bound * np.maximum(totals, m["total"]) - 1e-9) & (np.minimum(rests, m["rest"]) * (1 + bound) >= bound * (totals + m["total"]) - 1e-9)
                    own = m["before"]
                    for k in np.flatnonzero(able).tolist():
                        apart = m["side"] is None or m["side"] != two[k]["side"]
                        if apart and (low < high or m["id"] < two[k]["id"]) and seen[k].isdisjoint(own):
                            a.append(min(m["id"], two[k]["id"]))
                            b.append(max(m["id"], two[k]["id"]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def candidates(posts: DataFrame, bound: float) -> DataFrame:
    """(a, b) with a < b, each pair once, of the ids in ``posts``; if these have a ``side``, only pairs of different sides."""
    posts = posts if "side" in posts.columns else posts.withColumn("side", F.lit(None).cast("int"))
    sizes = posts.groupBy("rank").agg((F.count(F.lit(1)) / BLOCK).cast("int").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    spread = posts.join(sizes, "rank").withColumn("block", F.pmod(F.xxhash64("id"), F.col("last") + 1).cast("int"))
    spread = spread.select("*", F.explode(F.sequence(F.lit(0), "last")).alias("other")).select("rank", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), F.struct("block", "id", "total", "rest", "before", "side").alias("m"))
    # by a number of its own, as Spark gathers parts by their bytes, and work grows with pairs
    spread = spread.repartition(parts(posts), "rank", "low", "high")
    lists = spread.groupBy("rank", "low", "high").agg(F.collect_list("m").alias("members")).filter("size(members) > 1")
    return lists.select("low", "high", "members").mapInArrow(_met(bound), "a long, b long")


def similar_pairs(sets: DataFrame, bound: float) -> DataFrame:
    """(a, b), a < b: candidates of all pairs of ``sets`` (id, items of (item, weight)) with a weighted Jaccard of ``bound`` or more."""
    return candidates(postings(ordered(sets, ranked(sets), bound)), bound)


def feature_sets(found: DataFrame) -> DataFrame:
    """Distinct features of pages: id (the least page_id that has them), pages, and a struct ``own`` of them."""
    layers = [c for c in found.columns if c != "page_id"]
    return found.groupBy(*layers).agg(F.min("page_id").alias("id"), F.count(F.lit(1)).alias("pages")).select("id", "pages", F.struct(*layers).alias("own"))


def weighed(sets: DataFrame) -> DataFrame:
    """id and the skeleton's features with their weights, of sets that are thick enough to match any."""
    return sets.filter(F.size("own.skeleton") >= MIN_SKELETON).select("id", F.transform("own.skeleton", lambda x: F.struct(x.alias("item"), weight("skeleton", x).alias("weight"))).alias("items"))


def compared(met: DataFrame, a: str, own: DataFrame, b: str, their: DataFrame) -> DataFrame:
    """``match`` of pairs of ids in the columns a and b, of sets (id, own) on either side. Features are weighed once a set, not once a pair,
    and pairs are dealt to all tasks, as those of one list come from one task."""
    met = met.repartition(parts(met), a, b)
    for key, sets, name in ((a, own, "own"), (b, their, "their")):
        sets = with_weights(sets.select("id", "own")).select(F.col("id").alias(key), F.col("own").alias(name), F.col("weights").alias(f"{name}_weights"))
        sets = written(sets.withColumn("__told", F.concat_ws("", *[F.col(name)[k] for k in sets.schema[name].dataType.names])), "weighed-sets")
        met = met.join((F.broadcast if small(sets, "__told") else large)(sets.drop("__told")), key)
    return match(met)


def matching_pairs(sets: DataFrame) -> DataFrame:
    """a, b, score, containment_score of all pairs of distinct feature sets that have one shape."""
    met = similar_pairs(weighed(sets), THRESHOLDS["skeleton"])
    return compared(met, "a", sets, "b", sets).filter("same_shape").select("a", "b", "score", "containment_score")


def sectioned(pages: DataFrame) -> DataFrame:
    """``pages`` whose body ends with a section for each word of the address, so that their features differ as their addresses do."""
    words = F.array_distinct(F.filter(F.split(F.regexp_replace("url", "^[a-z]+://|[.]example[.][a-z]+|[0-9]+", "/"), "[^a-z]+"), lambda w: w != ""))
    section = lambda w: F.concat(F.lit('<section class="'), w, F.lit('"><div class="'), w, F.lit('-in"><em>'), w, F.lit("</em></div></section>"))
    return pages.select("page_id", F.concat("html", F.array_join(F.transform(words, section), "")).alias("html"))


@query("page_feature_sets")
def page_feature_sets(spark, sf):
    """Each page with the page that stands for its features, and how many pages have them."""
    found = written(features(sectioned(read(spark, sf, "pages"))), "page-features")
    sets = feature_sets(found)
    keys = [c for c in found.columns if c != "page_id"]
    return found.join(sets.select("id", "pages", "own.*"), keys).select("page_id", F.col("id").alias("feature_set"), "pages")


@query("page_pairs")
def page_pairs(spark, sf):
    """All pairs of distinct feature sets of pages that have one shape; with ``page_feature_sets`` they tell all pairs of pages."""
    return matching_pairs(written(feature_sets(features(sectioned(read(spark, sf, "pages")))), "page-feature-sets"))
