"""Verification of selectors on pages, verdicts on cached ones, and what tells contracts and strategies apart.

The queries verify a small contract on ``pages``, and take ``events``, ``lineitem``, ``part`` and ``orders`` as logs of
verdicts, of strategies compared, of selectors found and of crawls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.contract import Contract, Field
from ..plans.selectors import Unsupported, LEVELS, Selector, css, values, xpath
from ..sources.html import with_nodes
from ._registry import read, registry

QUERIES, SQL, query = registry()

# The names of a cascade's levels, kinds that can't be tested on a page, and reasons of failure.
CASCADE = ("primary", "fallback", "tertiary")
UNTESTABLE = ("regex", "jsonld", "global_id", "visual")
REASONS = {"unsupported": "unsupported_strategy", "na": "na_selector", "none": "no_elements_found", "syntax": "invalid_syntax", "root": "root matched no element"}


def _elements(s: Selector, nodes: Column, within: Column | None) -> Column:
    """How much a selector finds, elements or values."""
    if s.kind in ("css", "xpath"):
        made = (css if s.kind == "css" else xpath)(s.value)
        return F.size(made.values(nodes, within) if made.take != "text" else made.nodes(nodes, within))
    return F.size(values(s, nodes, within))


def tested(s: Selector, nodes: Column, within: Column | None = None) -> tuple[Column, Column]:
    """(whether it finds something, why not)."""
    if s.kind in UNTESTABLE:
        return F.lit(False), F.lit(REASONS["unsupported"])
    if not s.value or s.value == "NA":
        return F.lit(False), F.lit(REASONS["na"])
    try:
        return _elements(s, nodes, within) > 0, F.lit(REASONS["none"])
    except Unsupported:
        return F.lit(False), F.lit(REASONS["unsupported"])
    except ValueError:
        return F.lit(False), F.lit(REASONS["syntax"])


def field_verdict(f: Field, nodes: Column, max_level: int = 8) -> Column:
    """struct<field, status, working_level, selector, selector_level, failures>: the first selector of the cascade that
    finds something, within the field's root if it has one; failures are of what was tried before it."""
    within, rooted = None, F.lit(True)
    if f.root is not None:
        within = F.try_element_at((xpath if f.root.kind == "xpath" else css)(f.root.value).nodes(nodes), F.lit(1))
        rooted = within.isNotNull()
    tries = [(level, s, *tested(s, nodes, within)) for level, s in zip(CASCADE, f.cascade) if LEVELS[s.kind] <= max_level]
    first = F.coalesce(*[F.when(ok, F.lit(i)) for i, (_, _, ok, _) in enumerate(tries)], F.lit(len(tries)))
    kind = "array<struct<level: string, selector: string, reason: string>>"
    failed = F.array(*[F.struct(F.lit(level).alias("level"), F.lit(s.value).alias("selector"), reason.alias("reason")) for level, s, _, reason in tries]).cast(kind)
    lost = F.array(F.struct(F.lit("root").alias("level"), F.lit(f.root.value if f.root else "").alias("selector"), F.lit(REASONS["root"]).alias("reason"))).cast(kind)
    good = rooted & (first < len(tries))
    pick = lambda what: F.when(good, F.coalesce(*[F.when(first == i, F.lit(what(t))) for i, t in enumerate(tries)], F.lit(None).cast("string")))
    return F.struct(
        F.lit(f.name).alias("field"), F.when(good, "verified").otherwise("failed").alias("status"), pick(lambda t: t[0]).alias("working_level"),
        pick(lambda t: t[1].value).alias("selector"), pick(lambda t: t[1].kind).alias("selector_level"), F.when(rooted, F.slice(failed, F.lit(1), first)).otherwise(lost).alias("failures"),
    )


def verdicts(pages: DataFrame, contract: Contract, id: str = "page_id", html: str = "html", max_level: int = 8) -> DataFrame:
    """id and a row for each field of the contract, from one parse of a page."""
    made = F.array(*[field_verdict(f, F.col("nodes"), max_level) for f in contract.fields])
    return with_nodes(pages.select(id, html), html).select(id, F.explode(made).alias("v")).select(id, "v.*")


PAGE = Contract("Page", (
    Field("headline", (Selector("h2.title"), Selector("article > h1"), Selector("title"))),
    Field("aside_note", (Selector("p"),), root=Selector("aside")),
    Field("links", (Selector("NA"), Selector("href=(.*)", "regex"), Selector("//nav//a/@href", "xpath"))),
    Field("english", (Selector('html[lang="en"]'), Selector("html", "attr", name="data-lang"), Selector("p!", "css"))),
))
_VERDICTS = r"""v AS (SELECT page_id, 'headline' AS field, 'verified' AS status, 'fallback' AS working_level, 'css' AS selector_level, 'primary:no_elements_found' AS failures FROM pages
UNION ALL SELECT page_id, 'aside_note', 'failed', NULL, NULL, 'root:root matched no element' FROM pages
UNION ALL SELECT page_id, 'links', CASE WHEN l THEN 'verified' ELSE 'failed' END, CASE WHEN l THEN 'tertiary' END, CASE WHEN l THEN 'xpath' END, 'primary:na_selector,fallback:unsupported_strategy' || CASE WHEN l THEN '' ELSE ',tertiary:no_elements_found' END FROM (SELECT page_id, regexp_matches(regexp_extract(html, '<nav>(.*)</nav>', 1), '<a href=') AS l FROM pages)
UNION ALL SELECT page_id, 'english', CASE WHEN e THEN 'verified' ELSE 'failed' END, CASE WHEN e THEN 'primary' END, CASE WHEN e THEN 'css' END, CASE WHEN e THEN '' ELSE 'primary:no_elements_found,fallback:no_elements_found,tertiary:invalid_syntax' END FROM (SELECT page_id, contains(html, '<html lang="en"') AS e FROM pages))"""


@query("field_verdicts", f"WITH {_VERDICTS} SELECT * FROM v")
def field_verdicts(spark, sf):
    made = verdicts(read(spark, sf, "pages"), PAGE)
    told = F.array_join(F.transform("failures", lambda f: F.concat(f["level"], F.lit(":"), f["reason"])), ",")
    return made.select("page_id", "field", "status", "working_level", "selector_level", told.alias("failures"))


@query("level_distribution", f"WITH {_VERDICTS} SELECT field, selector_level, working_level, count(*) AS n FROM v WHERE status = 'verified' GROUP BY ALL")
def level_distribution(spark, sf):
    """Verified fields by the kind and the level of the selector that worked."""
    return verdicts(read(spark, sf, "pages"), PAGE).filter("status = 'verified'").groupBy("field", "selector_level", "working_level").agg(F.count(F.lit(1)).alias("n"))


def root_holds(nodes: Column, container: str, primaries: list[Selector]) -> Column:
    """Whether some field's first selector finds something in the first container."""
    first = F.try_element_at(css(container).nodes(nodes), F.lit(1))
    hits = F.lit(False)
    for s in primaries:
        if s.kind in ("css", "xpath"):
            hits = hits | (_elements(s, nodes, first) > 0)
    return first.isNotNull() & F.coalesce(hits, F.lit(False))


@query("root_checks", """WITH r AS (SELECT page_id, regexp_extract(html, '<nav>(.*)</nav>', 1) AS nav, html FROM pages)
SELECT page_id, contains(html, '<article><h1>') AS article, contains(nav, '<h1') OR contains(nav, '<p>') AS nav, false AS aside FROM r""")
def root_checks(spark, sf):
    nodes, fields = F.col("nodes"), [Selector("h1"), Selector("p")]
    parsed = with_nodes(read(spark, sf, "pages").select("page_id", "html"))
    return parsed.select("page_id", *[root_holds(nodes, c, fields).alias(c) for c in ("article", "nav", "aside")])


def cache_verdicts(snapshots: DataFrame, wanted: DataFrame, scope: str) -> DataFrame:
    """scope, field, verdict: fresh or stale. Snapshots are (scope, field, active, verified, frozen), wanted (scope, field).

    Inactive ones are fresh; a stale root makes all others stale, frozen ones are then replayed as fresh, and wanted
    fields without a snapshot are stale.
    """
    own = snapshots.withColumn("fresh", ~F.col("active") | F.col("verified"))
    roots = own.filter("field = 'root'").select(scope, F.col("fresh").alias("root_fresh"))
    judged = own.join(roots, scope, "left").withColumn("fresh", F.col("frozen") | (F.col("fresh") & (F.coalesce("root_fresh", F.lit(True)) | (F.col("field") == "root"))))
    missing = wanted.join(snapshots.select(scope, "field"), [scope, "field"], "left_anti").select(scope, "field", F.lit("stale").alias("verdict"))
    return judged.select(scope, "field", F.when(F.col("fresh"), "fresh").otherwise("stale").alias("verdict")).unionByName(missing)


@query("cache_verdicts", """WITH e AS (SELECT user_id AS site, event_type, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), s AS (SELECT site, CASE WHEN event_type = 'error' THEN 'root' ELSE event_type END AS field, arg_min(k, event_id) AS k FROM e WHERE event_type <> 'signup' OR k < 50 GROUP BY 1, 2),
f AS (SELECT site, field, k % 4 = 0 OR k % 3 <> 0 AS fresh, k % 7 = 0 AS frozen FROM s), r AS (SELECT site, fresh AS root_fresh FROM f WHERE field = 'root'), w AS (SELECT DISTINCT site, field FROM (SELECT DISTINCT site FROM e), (SELECT unnest(['root', 'click', 'signup']) AS field))
SELECT site, field, CASE WHEN frozen OR (fresh AND (coalesce(root_fresh, true) OR field = 'root')) THEN 'fresh' ELSE 'stale' END AS verdict FROM f LEFT JOIN r USING (site)
UNION ALL SELECT site, field, 'stale' FROM w WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.site = w.site AND f.field = w.field)""")
def cached_verdicts(spark, sf):
    """Of each site's fields, whether the selector kept for them still holds."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = read(spark, sf, "events").select(F.col("user_id").alias("site"), "event_type", "event_id", k.alias("k"))
    field = F.when(F.col("event_type") == "error", "root").otherwise(F.col("event_type"))
    s = e.filter("event_type <> 'signup' OR k < 50").groupBy("site", field.alias("field")).agg(F.min_by("k", "event_id").alias("k"))
    snapshots = s.select("site", "field", (F.col("k") % 4 != 0).alias("active"), (F.col("k") % 3 != 0).alias("verified"), (F.col("k") % 7 == 0).alias("frozen"))
    wanted = e.select("site").distinct().select("site", F.explode(F.array(*map(F.lit, ("root", "click", "signup")))).alias("field"))
    return cache_verdicts(snapshots, wanted, "site")


# Contracts that claim the same parts of a page.


def overlaps(footprints: DataFrame, scope: str, contract: str, element: str) -> DataFrame:
    """scope, a, b, shared: contracts of one scope that claim common elements; footprints are (scope, contract, element).

    A page has few contracts, so a pair is found through the elements both claim, which grow with the footprints.
    """
    own = footprints.select(scope, contract, element).distinct()
    a, b = own.withColumnRenamed(contract, "a"), own.withColumnRenamed(contract, "b")
    return a.join(b, [scope, element]).filter("a < b").groupBy(scope, "a", "b").agg(F.count(F.lit(1)).alias("shared"))


def discriminated(footprints: DataFrame, contracts: DataFrame, scope: str, contract: str, element: str) -> DataFrame:
    """scope, contracts, empty, overlapping, accepted: whether all contracts of a scope claim something, and nothing twice."""
    sizes = footprints.groupBy(scope, contract).agg(F.countDistinct(element).alias("__n"))
    own = contracts.select(scope, contract).distinct().join(sizes, [scope, contract], "left")
    counted = own.groupBy(scope).agg(F.count(F.lit(1)).alias("contracts"), F.count_if(F.col("__n").isNull()).alias("empty"))
    pairs = overlaps(footprints, scope, contract, element).groupBy(scope).agg(F.count(F.lit(1)).alias("overlapping"))
    joined = counted.join(pairs, scope, "left").withColumn("overlapping", F.coalesce("overlapping", F.lit(0).cast("long")))
    return joined.withColumn("accepted", (F.col("contracts") >= 2) & (F.col("empty") == 0) & (F.col("overlapping") == 0))


@query("contract_overlaps", """WITH f AS (SELECT DISTINCT l_orderkey AS page, l_returnflag AS contract, l_partkey % 10 AS element FROM lineitem) SELECT x.page, x.contract AS a, y.contract AS b, count(*) AS shared FROM f x JOIN f y ON x.page = y.page AND x.element = y.element AND x.contract < y.contract GROUP BY 1, 2, 3""")
def contract_overlaps(spark, sf):
    return overlaps(_footprints(spark, sf), "page", "contract", "element")


def _footprints(spark, sf):
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_returnflag").alias("contract"), (F.col("l_partkey") % 10).alias("element"))


@query("contract_gate", """WITH f AS (SELECT DISTINCT l_orderkey AS page, l_returnflag AS contract, l_partkey % 10 AS element FROM lineitem), c AS (SELECT DISTINCT l_orderkey AS page, l_linestatus AS contract FROM lineitem UNION SELECT DISTINCT page, contract FROM f),
n AS (SELECT c.page, count(*) AS contracts, count(*) FILTER (s.page IS NULL) AS empty FROM c LEFT JOIN (SELECT DISTINCT page, contract FROM f) s ON c.page = s.page AND c.contract = s.contract GROUP BY 1),
o AS (SELECT page, count(*) AS overlapping FROM (SELECT x.page, x.contract, y.contract AS b FROM f x JOIN f y ON x.page = y.page AND x.element = y.element AND x.contract < y.contract GROUP BY ALL) GROUP BY 1)
SELECT page, contracts, empty, coalesce(overlapping, 0) AS overlapping, contracts >= 2 AND empty = 0 AND coalesce(overlapping, 0) = 0 AS accepted FROM n LEFT JOIN o USING (page)""")
def contract_gate(spark, sf):
    footprints = _footprints(spark, sf)
    contracts = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linestatus").alias("contract")).union(footprints.select("page", "contract"))
    return discriminated(footprints, contracts, "page", "contract", "element")


def duplicate_selectors(selectors: DataFrame, contract: str = "contract") -> DataFrame:
    """contract, selector, fields: selectors that stand for more than one field under the same root; frame fields don't count."""
    own = selectors.filter(~F.col("field").isin("root", "related_content") & F.col("selector").isNotNull())
    return own.groupBy(contract, "root", "kind", "selector").agg(F.array_sort(F.collect_set("field")).alias("fields")).filter("size(fields) > 1").select(contract, "selector", "fields")


def colliding_contracts(selectors: DataFrame, contract: str = "contract") -> DataFrame:
    """contracts: those with the same set of selectors, which so aren't told apart; by the set, not by pairs."""
    own = selectors.filter(~F.col("field").isin("root", "related_content") & F.col("selector").isNotNull())
    sets = own.groupBy(contract).agg(F.array_sort(F.collect_set(F.struct(F.coalesce("root", F.lit("")).alias("root"), "kind", "selector"))).alias("__set"))
    return sets.groupBy("__set").agg(F.array_sort(F.collect_list(contract)).alias("contracts")).filter("size(contracts) > 1").select("contracts")


def _selectors(spark, sf):
    p = F.col
    return read(spark, sf, "part").select(p("p_name").alias("contract"), p("p_brand").alias("field"), F.when(p("p_size") % 5 > 0, p("p_type")).alias("root"), F.lit("css").alias("kind"), F.concat(F.lit(".s"), (p("p_size") % 7).cast("string")).alias("selector"))


_SELECTORS = "s AS (SELECT p_name AS contract, p_brand AS field, CASE WHEN p_size % 5 > 0 THEN p_type END AS root, '.s' || (p_size % 7) AS selector FROM part)"


@query("duplicate_selectors", f"WITH {_SELECTORS} SELECT contract, selector, array_to_string(list_sort(list(DISTINCT field)), ',') AS fields FROM s GROUP BY contract, root, selector HAVING count(DISTINCT field) > 1")
def repeated_selectors(spark, sf):
    return duplicate_selectors(_selectors(spark, sf)).withColumn("fields", F.array_join("fields", ","))


@query("colliding_contracts", "WITH s AS (SELECT DISTINCT c_custkey AS contract, unnest(['.n' || (c_nationkey % 3), '.s' || c_mktsegment]) AS selector FROM customer), t AS (SELECT contract, array_to_string(list_sort(list(DISTINCT selector)), ',') AS k FROM s GROUP BY 1) SELECT min(contract) AS first, count(*) AS n FROM t GROUP BY k HAVING count(*) > 1")
def same_selector_sets(spark, sf):
    c = read(spark, sf, "customer")
    both = F.array(F.struct(F.lit("name").alias("field"), F.concat(F.lit(".n"), (F.col("c_nationkey") % 3).cast("string")).alias("selector")), F.struct(F.lit("segment").alias("field"), F.concat(F.lit(".s"), "c_mktsegment").alias("selector")))
    rows = c.select(F.col("c_custkey").alias("contract"), F.explode(both).alias("x")).select("contract", "x.*", F.lit(None).cast("string").alias("root"), F.lit("css").alias("kind"))
    return colliding_contracts(rows).select(F.col("contracts")[0].alias("first"), F.size("contracts").cast("long").alias("n"))


# References of earlier pages.


def field_score(page: Column, same_shape: Column, route: Column, field_type: Column, root: Column, name: Column, contract: Column) -> Column:
    """struct<score, same_field_scope> of a candidate field and a stored one; page and contract are scores, the others booleans."""
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    score = (page * 2.0 + one(route) + one(field_type) + one(root) + one(name) + contract) / 7.0
    return F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"), (same_shape & route & field_type & root).alias("same_field_scope"))


_PAIRS = """pairs AS (SELECT l_orderkey AS candidate, l_partkey AS reference, l_linenumber AS ord, l_discount * 5 AS page, l_discount * 5 >= 0.2 AS same_shape, l_orderkey % 3 = l_partkey % 3 AS route, l_returnflag = 'A' AS field_type, l_linestatus = 'O' AS root, l_quantity > 25 AS name, l_tax * 10 AS contract, l_suppkey % 2 AS strategy FROM lineitem)"""


def _pairs(spark, sf) -> DataFrame:
    c = F.col
    return read(spark, sf, "lineitem").select(
        c("l_orderkey").alias("candidate"), c("l_partkey").alias("reference"), c("l_linenumber").alias("ord"), (c("l_discount") * 5).alias("page"), (c("l_discount") * 5 >= 0.2).alias("same_shape"), (c("l_orderkey") % 3 == c("l_partkey") % 3).alias("route"),
        (c("l_returnflag") == "A").alias("field_type"), (c("l_linestatus") == "O").alias("root"), (c("l_quantity") > 25).alias("name"), (c("l_tax") * 10).alias("contract"), (c("l_suppkey") % 2).alias("strategy"),
    )


@query("field_scores", f"WITH {_PAIRS} SELECT candidate, reference, ord, round(greatest(0.0, least(1.0, (page * 2 + route::INT + field_type::INT + root::INT + name::INT + contract) / 7)), 9) AS score, same_shape AND route AND field_type AND root AS same_field_scope FROM pairs")
def field_scores(spark, sf):
    """How near stored fields are to candidates, over pairs as blocking gives them: here, lines of orders."""
    c = F.col
    s = field_score(c("page"), c("same_shape"), c("route"), c("field_type"), c("root"), c("name"), c("contract"))
    return _pairs(spark, sf).select("candidate", "reference", "ord", s.alias("s")).select("candidate", "reference", "ord", F.round("s.score", 9).alias("score"), "s.same_field_scope")


def strategy_match(pairs: DataFrame, candidate: str, order: str, strategy: str, conditions: list[str]) -> DataFrame:
    """candidate, chosen, strategies: the first compatible reference, if all compatible ones have one strategy; else null."""
    able = pairs.filter(F.expr(" AND ".join(conditions)))
    found = able.groupBy(candidate).agg(F.countDistinct(strategy).alias("strategies"), F.min(order).alias("__first"))
    return pairs.select(candidate).distinct().join(found, candidate, "left").select(candidate, F.when(F.col("strategies") == 1, F.col("__first")).alias("chosen"), F.coalesce("strategies", F.lit(0).cast("long")).alias("strategies"))


@query("strategy_matches", f"WITH {_PAIRS} SELECT candidate, CASE WHEN count(DISTINCT strategy) FILTER (same_shape AND route) = 1 THEN min(ord) FILTER (same_shape AND route) END AS chosen, count(DISTINCT strategy) FILTER (same_shape AND route) AS strategies FROM pairs GROUP BY 1")
def strategy_matches(spark, sf):
    return strategy_match(_pairs(spark, sf), "candidate", "ord", "strategy", ["same_shape", "route"])


def with_fallback(asked: DataFrame, known: DataFrame, domain: str = "domain") -> DataFrame:
    """``asked`` with ``found``: the domain that has selectors, its own or else that without its first label."""
    have = known.select(F.col(domain).alias("__have")).distinct()
    parent = F.when(F.col(domain).contains("."), F.regexp_replace(domain, r"^[^.]*\.", ""))
    own = asked.withColumn("__parent", parent).join(have.withColumnRenamed("__have", "__own"), F.col(domain) == F.col("__own"), "left")
    return own.join(have.withColumnRenamed("__have", "__other"), F.col("__parent") == F.col("__other"), "left").select(*asked.columns, F.coalesce("__own", "__other").alias("found"))


@query("subdomain_lookup", """WITH a AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'www.n' || c_nationkey || '.test' WHEN 1 THEN 'n' || c_nationkey || '.test' ELSE 'a.www.n' || c_nationkey || '.test' END AS domain FROM customer), k AS (SELECT DISTINCT 'n' || s_nationkey || '.test' AS d FROM supplier)
SELECT c_custkey, domain, CASE WHEN domain IN (SELECT d FROM k) THEN domain WHEN regexp_replace(domain, '^[^.]*\\.', '') IN (SELECT d FROM k) THEN regexp_replace(domain, '^[^.]*\\.', '') END AS found FROM a""".replace("\\\\", "\\"))
def subdomain_lookup(spark, sf):
    k, site = F.col("c_custkey"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit(".test"))
    asked = read(spark, sf, "customer").select(k, F.when(k % 3 == 0, F.concat(F.lit("www."), site)).when(k % 3 == 1, site).otherwise(F.concat(F.lit("a.www."), site)).alias("domain"))
    known = read(spark, sf, "supplier").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit(".test")).alias("domain"))
    return with_fallback(asked, known)


# Stores.


def selector_summary(snapshots: DataFrame) -> DataFrame:
    """domain, discovered_at, fields, and how many snapshots have each status; of (domain, field, discovered_at, status)."""
    status = lambda s: F.count_if(F.col("status") == s).alias(s)
    return snapshots.groupBy("domain").agg(F.min("discovered_at").alias("discovered_at"), F.array_sort(F.collect_set("field")).alias("fields"), *map(status, ("active", "failing", "retired")))


@query("selector_summary", """WITH e AS (SELECT 'site' || (user_id % 40) AS domain, event_type AS field, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS s FROM events)
SELECT domain, min(ts) AS discovered_at, array_to_string(list_sort(list(DISTINCT field)), ',') AS fields, count(*) FILTER (s = 0) AS active, count(*) FILTER (s = 1) AS failing, count(*) FILTER (s = 2) AS retired FROM e GROUP BY 1""")
def stored_selectors(spark, sf):
    s = F.get_json_object("props", "$.k").cast("long") % 3
    rows = read(spark, sf, "events").select(F.concat(F.lit("site"), (F.col("user_id") % 40).cast("string")).alias("domain"), F.col("event_type").alias("field"), F.col("ts").alias("discovered_at"), F.when(s == 0, "active").when(s == 1, "failing").when(s == 2, "retired").alias("status"))
    return selector_summary(rows).withColumn("fields", F.array_join("fields", ","))


def contract_summary(metrics: DataFrame, events: DataFrame, contract: str = "contract") -> DataFrame:
    """contract, domains, tlds, routes, fields (sorted), url_count, run_count: of what fields were found and what ran.

    Metrics are (contract, domain, tld, route, field, url), events (contract, type, url, route).
    """
    names = lambda c: F.array_sort(F.collect_set(c))
    m = metrics.groupBy(contract).agg(names("domain").alias("domains"), names("tld").alias("tlds"), names("field").alias("fields"))
    e = events.groupBy(contract).agg(F.count_if(F.col("type") == "run").alias("run_count"))
    both = metrics.select(contract, "url", "route").union(events.select(contract, "url", "route")).groupBy(contract).agg(F.countDistinct("url").alias("url_count"), names("route").alias("routes"))
    return both.join(m, contract, "left").join(e, contract, "left").select(contract, "domains", "tlds", "routes", "fields", "url_count", F.coalesce("run_count", F.lit(0).cast("long")).alias("run_count"))


@query("contract_summary", """WITH e AS (SELECT 'c' || (user_id % 12) AS contract, 'site' || (user_id % 40) || CASE WHEN user_id % 2 = 0 THEN '.test' ELSE '.example' END AS domain, event_type, 'u' || (event_id % 97) AS url, '/' || event_type AS route FROM events),
m AS (SELECT *, split_part(domain, '.', 2) AS tld FROM e WHERE event_type <> 'error'), j AS (SELECT contract, count(DISTINCT url) AS url_count, array_to_string(list_sort(list(DISTINCT route)), ',') AS routes, count(*) FILTER (event_type = 'error') AS run_count FROM e GROUP BY 1)
SELECT contract, array_to_string(list_sort(list(DISTINCT domain)), ',') AS domains, array_to_string(list_sort(list(DISTINCT tld)), ',') AS tlds, any_value(routes) AS routes, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS fields, any_value(url_count) AS url_count, any_value(run_count) AS run_count FROM m JOIN j USING (contract) GROUP BY 1""")
def summarised_contracts(spark, sf):
    u = F.col("user_id")
    e = read(spark, sf, "events").select(F.concat(F.lit("c"), (u % 12).cast("string")).alias("contract"), F.concat(F.lit("site"), (u % 40).cast("string"), F.when(u % 2 == 0, ".test").otherwise(".example")).alias("domain"), "event_type", F.concat(F.lit("u"), (F.col("event_id") % 97).cast("string")).alias("url"), F.concat(F.lit("/"), "event_type").alias("route"))
    metrics = e.filter("event_type <> 'error'").select("contract", "domain", F.element_at(F.split("domain", r"\."), 2).alias("tld"), "route", F.col("event_type").alias("field"), "url")
    events = e.filter("event_type = 'error'").select("contract", F.lit("run").alias("type"), "url", "route")
    done = contract_summary(metrics, events)
    return done.select("contract", *[F.array_join(c, ",").alias(c) for c in ("domains", "tlds", "routes", "fields")], "url_count", "run_count")


def resume(stack: DataFrame, terminal: DataFrame, url: str = "url") -> DataFrame:
    """What a crawl goes on with: its stack without what has ended, in whatever way."""
    return stack.join(terminal.select(url).distinct(), url, "left_anti")


@query("crawl_resume", "SELECT 'o' || o_orderkey AS url, o_orderpriority AS priority FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def crawl_resume(spark, sf):
    url = lambda c: F.concat(F.lit("o"), F.col(c).cast("string")).alias("url")
    stack = read(spark, sf, "orders").select(url("o_orderkey"), F.col("o_orderpriority").alias("priority"))
    return resume(stack, read(spark, sf, "lineitem").filter("l_linestatus = 'F'").select(url("l_orderkey")))


def signature(*parts: Column, names: tuple[str, ...]) -> Column:
    """16 hex digits of the canonical JSON of texts by name: names in order, blanks collapsed, lower case."""
    tidy = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    pairs = [F.concat(F.lit(f'"{n}": '), F.to_json(F.array(tidy(c))).substr(F.lit(2), F.length(F.to_json(F.array(tidy(c)))) - 2)) for n, c in sorted(zip(names, parts), key=lambda x: x[0])]
    return F.substring(F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}")), 256), 1, 16)


@query("field_signatures", """SELECT p_partkey AS id, substr(sha256('{"desc": "' || lower(p_type) || '", "name": "' || lower(p_name) || '", "type": "' || lower(p_brand) || '"}'), 1, 16) AS signature FROM part""")
def field_signatures(spark, sf):
    """Names, descriptions and types that differ only in case and blanks have one signature."""
    p = read(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), signature(F.concat(F.lit("  "), F.upper("p_name")), F.col("p_type"), F.col("p_brand"), names=("name", "desc", "type")).alias("signature"))


# How well pages fit contracts.


def probes(pages: DataFrame, contracts: list[Contract], id: str = "page_id") -> DataFrame:
    """id, contract, required, verified, fit_score, fit of each page for each contract: which of its fields' selectors find something, and the
    share of the required fields that are so or are computed by row.

    ``candidate``: all that is required is computed; ``uncached``: no field has selectors; else ``strong``, ``partial`` or ``stale`` by the share.
    Contracts are what users wrote, so each adds a branch to the plan.
    """
    out = None
    for c in contracts:
        told = {f.name: f for f in c.fields}
        required = sorted(n for n, f in told.items() if f.required)
        computed = sorted(n for n in required if told[n].compute is not None)
        cached = [f for f in c.fields if f.compute is None and f.cascade]
        names = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
        if cached:
            found = verdicts(pages, Contract(c.name, tuple(cached), c.container), id)
            each = found.groupBy(id).agg(F.array_sort(F.collect_set(F.when(F.col("status") == "verified", F.col("field")))).alias("verified"))
        else:
            each = pages.select(id, names([]).alias("verified"))
        resolved = F.size(F.array_intersect(names(required), F.array_union("verified", names(computed))))
        score = F.round(resolved / len(required), 6) if required else F.lit(0.0)
        fit = F.when(F.lit(bool(required) and required == computed), "candidate").when(F.lit(not cached), "uncached").when(F.col("fit_score") >= 1, "strong").when(F.col("fit_score") > 0, "partial").otherwise("stale")
        own = each.withColumn("fit_score", score).select(id, F.lit(c.name).alias("contract"), names(required).alias("required"), "verified", "fit_score", fit.alias("fit"))
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no contracts")
    return out


_PROBED = [
    Contract("Page", (Field("headline", (Selector("article > h1"),), required=True), Field("english", (Selector('html[lang="en"]'),), required=True), Field("links", (Selector("//nav//a/@href", "xpath"),)))),
    Contract("Gone", (Field("aside_note", (Selector("aside p"),), required=True),)), Contract("Empty", (Field("x", (), required=True),)), Contract("Made", (Field("n", (), required=True, compute=lambda nodes, within: F.size(nodes)),)),
]


@query("contract_probes", r"""WITH p AS (SELECT page_id, contains(html, '<html lang="en"') AS e, contains(html, '<article><h1>') AS h, regexp_matches(regexp_extract(html, '<nav>(.*)</nav>', 1), '<a href=') AS l FROM pages)
SELECT page_id, 'Page' AS contract, array_to_string(list_filter([CASE WHEN e THEN 'english' END, CASE WHEN h THEN 'headline' END, CASE WHEN l THEN 'links' END], lambda x: x IS NOT NULL), ',') AS verified, (e::INT + h::INT) / 2.0 AS fit_score, CASE WHEN e AND h THEN 'strong' WHEN e OR h THEN 'partial' ELSE 'stale' END AS fit FROM p
UNION ALL SELECT page_id, 'Gone', '', 0, 'stale' FROM p UNION ALL SELECT page_id, 'Empty', '', 0, 'uncached' FROM p UNION ALL SELECT page_id, 'Made', '', 1, 'candidate' FROM p""")
def contract_probes(spark, sf):
    return probes(read(spark, sf, "pages"), _PROBED).select("page_id", "contract", F.array_join("verified", ",").alias("verified"), "fit_score", "fit")
