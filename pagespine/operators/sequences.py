"""Sequences too long for one window: windows of an index that never split what belongs together, runs of equal digests, integrity.

Places and running sums come from ranges that are sorted apart (``scratch.numbered``, ``scratch.running``). Pages of an index are a walk
from one page's end to the next one's; where each page that began anywhere would end is a join, and the walk from the start is found by
doubling: each round knows twice as many pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import large, numbered, running, written
from ..sources.html import node_table
from ._registry import read, registry

QUERIES, SQL, query = registry()

# Entries of a page, and how many more it may have to keep a unit whole.
PAGE_LIMIT, PAGE_SLACK = 1000, 8
#: Pages of an index are at most two to this power.
MAX_ROUNDS = 60


def placed(entries: DataFrame, scope: str, order: list[str]) -> DataFrame:
    """``entries`` with ``pos``, the place in their scope, from 0."""
    all_ = numbered(entries, [F.col(scope), *map(F.col, order)], "__n")
    starts = all_.groupBy(scope).agg(F.min("__n").alias("__least"))
    return all_.join(starts, scope).withColumn("pos", F.col("__n") - F.col("__least")).drop("__n", "__least")


def units(entries: DataFrame, scope: str) -> DataFrame:
    """(scope, pos, unit_start, unit_end): an entry with ``bound`` belongs to the one before it, so they are one unit."""
    heads = entries.select(scope, "pos", F.when(F.coalesce("bound", F.lit(False)) & (F.col("pos") > 0), 0).otherwise(1).alias("head"))
    each = written(running(heads, [F.col(scope), F.col("pos")], "head", "unit"), "units")
    ends = each.groupBy("unit").agg(F.min("pos").alias("unit_start"), (F.max("pos") + 1).alias("unit_end"))
    return each.select(scope, "pos", "unit").join(ends, "unit").drop("unit")


def bound_pages(entries: DataFrame, scope: str, limit: int = PAGE_LIMIT, slack: int = PAGE_SLACK) -> DataFrame:
    """scope, page, offset, returned, total of entries (scope, pos, bound): windows that never split a unit.

    A page of ``limit`` entries grows by up to ``slack`` to end with a unit, else ends before the unit; a unit that is longer than a page is
    one by itself.
    """
    each = written(units(entries, scope), "page-units")
    total = each.groupBy(scope).agg(F.count(F.lit(1)).alias("total"))
    starts = each.filter("pos = unit_start").join(total, scope).select(scope, F.col("pos").alias("offset"), "total")
    # the unit that holds the entry where a page of the limit would end
    cut = each.select(scope, F.col("pos").alias("at"), F.col("unit_start").alias("u_start"), F.col("unit_end").alias("u_end"))
    ends = starts.withColumn("at", F.col("offset") + limit).join(cut, [scope, "at"], "left")
    whole = F.when(F.col("u_end") <= F.col("at") + slack, F.col("u_end")).when(F.col("u_start") > F.col("offset"), F.col("u_start")).otherwise(F.col("u_end"))
    next_ = F.when(F.col("u_start").isNull(), F.col("total")).when(F.col("u_start") == F.col("at"), F.col("at")).otherwise(whole)
    steps = written(ends.select(scope, "offset", "total", next_.alias("next")), "page-steps")
    jumps, known = steps.select(scope, "offset", F.col("next").alias("to"), F.lit(1).cast("long").alias("pages")), steps.filter("offset = 0").select(scope, "offset", F.lit(1).cast("long").alias("page"))
    for _ in range(MAX_ROUNDS):
        more = known.join(jumps, [scope, "offset"]).select(scope, F.col("to").alias("offset"), (F.col("page") + F.col("pages")).alias("page")).join(steps.select(scope, "offset"), [scope, "offset"], "left_semi")
        more = written(more.join(known, [scope, "offset"], "left_anti"), "page-walk")
        if not more.take(1):
            break
        known = written(known.unionByName(more), "page-walk")
        ahead = jumps.select(scope, F.col("offset").alias("to"), F.col("to").alias("further"), F.col("pages").alias("more"))
        jumps = written(jumps.join(ahead, [scope, "to"]).select(scope, "offset", F.col("further").alias("to"), (F.col("pages") + F.col("more")).alias("pages")), "page-jumps")
    return known.join(steps, [scope, "offset"]).select(scope, "page", "offset", (F.col("next") - F.col("offset")).alias("returned"), "total")


@query("bound_pages", """WITH RECURSIVE e AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role = 'assistant' AS b, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations),
h AS (SELECT *, sum(CASE WHEN b AND pos > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY pos) AS unit FROM e),
u AS (SELECT *, min(pos) OVER (PARTITION BY conv_id, unit) AS us, max(pos) OVER (PARTITION BY conv_id, unit) + 1 AS ue FROM h),
s AS (SELECT a.conv_id, a.pos AS "offset", a.total, CASE WHEN c.pos IS NULL THEN a.total WHEN c.us = c.pos THEN c.pos WHEN c.ue <= a.pos + 3 + 1 THEN c.ue WHEN c.us > a.pos THEN c.us ELSE c.ue END AS next
  FROM u a LEFT JOIN u c ON c.conv_id = a.conv_id AND c.pos = a.pos + 3 WHERE a.pos = a.us),
w AS (SELECT conv_id, 1::BIGINT AS page, "offset", next, total FROM s WHERE "offset" = 0 UNION ALL SELECT s.conv_id, w.page + 1, s."offset", s.next, s.total FROM w JOIN s ON s.conv_id = w.conv_id AND s."offset" = w.next)
SELECT conv_id, page, "offset", next - "offset" AS returned, total FROM w""")
def conversation_pages(spark, sf):
    """Turns of each conversation in windows of 3, or 4 where that keeps an answer with its question."""
    c = read(spark, sf, "conversations").select("conv_id", "turn", (F.col("role") == "assistant").alias("bound"))
    return bound_pages(placed(c, "conv_id", ["turn"]), "conv_id", 3, 1)


def digest_runs(rows: DataFrame, keys: list[str], order: str, digest: str) -> DataFrame:
    """keys, run, digest, first, last, n: the history of what each key held, one row for each run of equal digests; runs count
    from 1. A run knows no more than its row's place and digest of the one before, whatever a key's share of all rows."""
    at = written(numbered(rows.select(*keys, order, digest), [*map(F.col, keys), F.col(order), F.col(digest)], "__place"), "digests")
    before = at.select((F.col("__place") + 1).alias("__place"), F.struct(*keys).alias("__keys"), F.col(digest).alias("__digest"))
    same_key = F.coalesce(F.col("__keys").eqNullSafe(F.struct(*keys)), F.lit(False))
    changed = at.join(before, "__place", "left").withColumn("__new", F.when(same_key & F.col("__digest").eqNullSafe(F.col(digest)), 0).otherwise(1))
    runs = running(changed.select(*keys, order, digest, "__place", "__new"), [F.col("__place")], "__new", "__run")
    each = written(runs.groupBy(*keys, "__run").agg(F.first(digest).alias(digest), F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")), "digest-runs")
    starts = each.groupBy(*keys).agg(F.min("__run").alias("__least"))
    return each.join(starts, keys).select(*keys, (F.col("__run") - F.col("__least") + 1).alias("run"), digest, "first", "last", "n")


@query("digest_runs", """WITH d AS (SELECT o_orderpriority AS domain, o_custkey % 20 AS field, o_orderkey AS seq, sha256(o_orderstatus) AS digest FROM orders),
c AS (SELECT *, CASE WHEN lag(digest) OVER w = digest THEN 0 ELSE 1 END AS new FROM d WINDOW w AS (PARTITION BY domain, field ORDER BY seq)), r AS (SELECT *, sum(new) OVER (PARTITION BY domain, field ORDER BY seq) AS run FROM c)
SELECT domain, field, run, digest, min(seq) AS first, max(seq) AS last, count(*) AS n FROM r GROUP BY 1, 2, 3, 4""")
def order_status_runs(spark, sf):
    """What each (domain, field) held, in runs."""
    o = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("domain"), (F.col("o_custkey") % 20).alias("field"), F.col("o_orderkey").alias("seq"), F.sha2("o_orderstatus", 256).alias("digest"))
    return digest_runs(o, ["domain", "field"], "seq", "digest")


@query("blob_sources", "SELECT sha256(html) AS digest, url, count(*) AS seen, min(page_id) AS first FROM pages GROUP BY 1, 2")
def blob_sources(spark, sf):
    """Which URLs gave each blob, and how often."""
    p = read(spark, sf, "pages").select(F.sha2("html", 256).alias("digest"), "url", "page_id")
    return p.groupBy("digest", "url").agg(F.count(F.lit(1)).alias("seen"), F.min("page_id").alias("first"))


# Integrity.

TREE_FAULTS = ("repeated", "orphan", "backward", "outside", "crossing", "depth", "gap")


def tree_faults(nodes: DataFrame, id: str = "page_id") -> DataFrame:
    """id, pre, fault: nodes (id, pre, parent, last, depth) that are no tree in document order.

    ``repeated``: a number twice; ``orphan``: a parent that isn't there; ``backward``: a parent that isn't before it, or an end before its
    beginning; ``outside``: not within its parent; ``crossing``: begins before an earlier sibling ends; ``depth``: not one below its parent;
    ``gap``: a number is missing before it. Siblings are swept in order; parents are met by a join.
    """
    up = nodes.groupBy(id, F.col("pre").alias("parent")).agg(F.max("last").alias("p_last"), F.max("depth").alias("p_depth"))
    siblings = Window.partitionBy(id, "parent").orderBy("pre", "last")
    order = Window.partitionBy(id).orderBy("pre")
    # a page's nodes are bounded by the page
    swept = nodes.withColumns({"reach": F.max("last").over(siblings.rowsBetween(Window.unboundedPreceding, -1)), "prior": F.lag("pre").over(order)})
    met = swept.join(large(up), [id, "parent"], "left")
    tests = {
        "repeated": F.col("prior") == F.col("pre"),
        "orphan": (F.col("parent") >= 0) & F.col("p_last").isNull(),
        "backward": (F.col("parent") >= F.col("pre")) | (F.col("last") < F.col("pre")),
        "outside": (F.col("last") > F.col("p_last")) | ((F.col("parent") >= 0) & (F.col("pre") > F.col("p_last"))),
        "crossing": F.col("reach") >= F.col("pre"),
        "depth": F.coalesce(F.col("p_depth") + 1, F.when(F.col("parent") < 0, 0)) != F.col("depth"),
        "gap": F.col("pre") > F.coalesce(F.col("prior") + 1, F.lit(0)),
    }
    found = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), name) for name, test in tests.items()]), lambda x: x.isNotNull())
    return met.select(id, "pre", F.explode(found).alias("fault"))


@query("tree_integrity", "SELECT fault, 0::BIGINT AS n FROM (SELECT unnest(['repeated', 'orphan', 'backward', 'outside', 'crossing', 'depth', 'gap']) AS fault)")
def tree_integrity(spark, sf):
    """How many nodes of the parsed pages have each fault: none."""
    nodes = written(node_table(read(spark, sf, "pages").select("page_id", "html")).select("page_id", "pre", "parent", "last", "depth"), "tree-nodes")
    every = spark.createDataFrame([(f,) for f in TREE_FAULTS], "fault string")
    return every.join(tree_faults(nodes).groupBy("fault").agg(F.count(F.lit(1)).alias("n")), "fault", "left").na.fill(0, ["n"])


def trace_faults(requests: DataFrame, scope: str, id: str, at: str, status: str) -> DataFrame:
    """scope, id, fault: requests of a trace whose id is repeated, that begin before the one before them in order of id, or whose
    status isn't one."""
    w = Window.partitionBy(scope).orderBy(id)
    swept = requests.withColumns({"__prior": F.lag(id).over(w), "__before": F.max(at).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    tests = {"repeated": F.col("__prior").eqNullSafe(F.col(id)), "order": F.col(at) < F.col("__before"), "status": ~F.col(status).between(100, 599)}
    found = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), name) for name, test in tests.items()]), lambda x: x.isNotNull())
    return swept.select(scope, id, F.explode(found).alias("fault"))


@query("trace_integrity", """WITH r AS (SELECT user_id AS trace, event_id // 3 AS request, ts, CAST(value * 20 AS INTEGER) AS status, event_id FROM events),
s AS (SELECT *, lag(request) OVER w AS prior, max(status) OVER (PARTITION BY trace ORDER BY request, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r WINDOW w AS (PARTITION BY trace ORDER BY request, event_id))
SELECT fault, sum(CASE fault WHEN 'repeated' THEN (prior = request)::INT WHEN 'status' THEN (status NOT BETWEEN 100 AND 599)::INT END)::BIGINT AS n FROM s, (SELECT unnest(['repeated', 'status']) AS fault) GROUP BY 1""")
def trace_integrity(spark, sf):
    """Events as requests of their user's trace, whose numbers repeat and whose status is made from the value."""
    r = read(spark, sf, "events").select(F.col("user_id").alias("trace"), F.floor(F.col("event_id") / 3).alias("request"), "ts", F.round(F.col("value") * 20).cast("int").alias("status"))
    return trace_faults(r, "trace", "request", "ts", "status").filter("fault <> 'order'").groupBy("fault").agg(F.count(F.lit(1)).alias("n"))
