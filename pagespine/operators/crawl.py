"""Link graphs and crawls over known pages: admission, frontier order, representatives, reachability, sitemaps, robots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..plans.contract import keep_first
from ..scratch import numbered, written
from ._registry import read, registry
from .pages import _PARTS

QUERIES, SQL, query = registry()


def admitted(found: DataFrame, denied: tuple[str, ...], blocked_prefixes: tuple[str, ...], per_host: int) -> DataFrame:
    """URLs whose host isn't denied and whose path isn't blocked, the first ``per_host`` of each host (the crawl's own cap)."""
    host, path = U.domain(F.col("url")), U.part(F.col("url"), "path")
    able = found.withColumn("host", host).filter(~F.col("host").isin(*denied))
    for prefix in blocked_prefixes:
        able = able.filter(~path.startswith(prefix))
    rank = F.row_number().over(Window.partitionBy("host").orderBy("page_id"))
    return able.withColumn("__n", rank).filter(F.col("__n") <= per_host).drop("__n")


_SHAPE = "'/' || array_to_string(list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN ':id' ELSE x END), '/')"


@query("crawl_admission", f"""WITH {_PARTS}, d AS (SELECT page_id, CASE WHEN host LIKE 'www.%' THEN substr(host, 5) ELSE host END AS host, path FROM parts)
SELECT host, page_id FROM d WHERE host <> 'example.org' AND NOT starts_with(path, '/tag') QUALIFY row_number() OVER (PARTITION BY host ORDER BY page_id) <= 3""")
def crawl_admission(spark, sf):
    return admitted(read(spark, sf, "pages").select("page_id", "url"), ("example.org",), ("/tag",), 3).select("host", "page_id")


def frontier(candidates: DataFrame, seen: DataFrame, max_depth: int) -> DataFrame:
    """New URLs in the order they are to be popped: the last batch first, in it the best score first; each URL once."""
    fresh = candidates.filter(F.col("depth") <= max_depth).join(seen.select("url"), "url", "left_anti")
    return keep_first(fresh, ["url"], ["batch", "ord"])


def pop_order() -> Column:
    return F.struct((-F.col("batch")).alias("b"), (-F.col("score")).alias("s"), F.col("ord").alias("o"))


@query("frontier_order", """WITH c AS (SELECT 'u' || user_id || '/' || CAST(json_extract_string(props, '$.k') AS BIGINT) AS url, user_id % 10 AS batch, event_id AS ord, value AS score, CAST(json_extract_string(props, '$.k') AS BIGINT) % 6 AS depth FROM events),
f AS (SELECT * FROM c WHERE depth <= 3 AND url NOT IN (SELECT 'u' || o_custkey || '/' || (o_orderkey % 100) FROM orders) QUALIFY row_number() OVER (PARTITION BY url ORDER BY batch, ord) = 1)
SELECT url, batch, score, row_number() OVER (PARTITION BY batch ORDER BY score DESC, ord) AS place FROM f""")
def frontier_order(spark, sf):
    """Places within each batch; batches themselves follow each other from last to first."""
    c = read(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), F.get_json_object("props", "$.k")).alias("url"), (F.col("user_id") % 10).alias("batch"), F.col("event_id").alias("ord"), F.col("value").alias("score"), (F.get_json_object("props", "$.k").cast("long") % 6).alias("depth"))
    seen = read(spark, sf, "orders").select(F.concat(F.lit("u"), F.col("o_custkey").cast("string"), F.lit("/"), (F.col("o_orderkey") % 100).cast("string")).alias("url"))
    w = Window.partitionBy("batch").orderBy(F.desc("score"), "ord")
    return frontier(c, seen, 3).select("url", "batch", "score", F.row_number().over(w).cast("long").alias("place"))


def representatives(results: DataFrame, cluster: Column, order: str, limit: int | None = None) -> DataFrame:
    """The first URL of each cluster in order; up to ``limit``, others fill what is left."""
    ranked = results.withColumn("__c", cluster)
    first = ranked.groupBy("__c").agg(F.min(order).alias("__first"))
    marked = ranked.join(first, "__c").withColumn("again", F.col(order) != F.col("__first")).drop("__c", "__first")
    return marked.filter(~F.col("again")) if limit is None else marked.orderBy("again", order).limit(limit)


@query("representative_urls", f"WITH {_PARTS}, s AS (SELECT page_id, url, {_SHAPE} AS shape FROM parts) SELECT page_id, url FROM s ORDER BY row_number() OVER (PARTITION BY shape ORDER BY page_id) > 1, page_id LIMIT 40")
def representative_urls(spark, sf):
    """A page of each path shape, filled up to 40 (the feature's own limit)."""
    return representatives(read(spark, sf, "pages").select("page_id", "url"), U.path_shape(F.col("url")), "page_id", 40).select("page_id", "url")


# Segments of pages that only list or serve the site.
ARTIFACT_SEGMENTS = ("tag", "tags", "category", "categories", "author", "login", "search", "feed", "page")


def evidence(text_chars: Column, links: Column) -> Column:
    """How much text a page has for its links, 0 to 1."""
    return F.when(text_chars == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), text_chars / 1500) - F.least(F.lit(0.8), links / 50)))


@query("scrape_targets", f"""WITH {_PARTS}, e AS (SELECT page_id, length(trim(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>[^<]*</(script|style)>', '', 'g'), '<[^>]*>', '', 'g'))) AS chars, len(regexp_extract_all(html, '<a[ >]')) AS links, len(list_intersect(list_transform(string_split(path, '/'), lambda x: lower(x)), {list(ARTIFACT_SEGMENTS)})) > 0 AS artifact FROM parts)
SELECT page_id, artifact, round(CASE WHEN chars = 0 THEN 0 ELSE greatest(0, least(1, chars / 1500) - least(0.8, links / 50)) END, 9) AS evidence, links, row_number() OVER (ORDER BY artifact, evidence DESC, links, page_id) AS place FROM e""")
def scrape_targets(spark, sf):
    """Targets in order: list pages last, then more evidence, then fewer links; with what they are ordered by."""
    text = F.trim(F.regexp_replace(F.regexp_replace("html", "<(script|style)[^>]*>[^<]*</(script|style)>", ""), "<[^>]*>", ""))
    links = F.regexp_count("html", F.lit("<a[ >]"))
    parts = F.transform(F.split(U.part(F.col("url"), "path"), "/"), lambda x: F.lower(x))
    found = read(spark, sf, "pages").select("page_id", F.arrays_overlap(parts, F.array(*map(F.lit, ARTIFACT_SEGMENTS))).alias("artifact"), F.round(evidence(F.length(text), links), 9).alias("evidence"), links.cast("long").alias("links"))
    return numbered(found, [F.col("artifact"), F.desc("evidence"), F.col("links"), F.col("page_id")], "place")


@query("crawl_gate", f"""WITH {_PARTS}, h AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="(/[^"?#]*)', 1)) AS path FROM pages), s AS (SELECT page_id, {_SHAPE} AS shape FROM h)
SELECT page_id, count(*) AS links, count(DISTINCT shape) AS shapes, count(*) >= 3 AND count(DISTINCT shape) >= 2 AS passes FROM s GROUP BY 1""")
def crawl_gate(spark, sf, least_links: int = 3, least_shapes: int = 2):
    """Whether a page has enough local links, of enough shapes, to crawl on."""
    h = read(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="(/[^"?#]*)'), 1)).alias("path"))
    s = h.withColumn("shape", U.path_shape(F.concat(F.lit("http://x"), "path")))
    return s.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("shape").alias("shapes")).withColumn("passes", (F.col("links") >= least_links) & (F.col("shapes") >= least_shapes))


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """node, depth: the fewest steps from a seed, breadth first; each round joins the last round's nodes only, and is written."""
    found = frontier_ = written(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "reached")
    for depth in range(1, max_depth + 1):
        following = frontier_.join(edges, F.col("node") == F.col("source")).select(F.col("target").alias("node")).distinct()
        frontier_ = written(following.join(found.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "reached")
        if not frontier_.take(1):
            break
        found = found.unionByName(frontier_)
    return found


@query("reachability", """WITH RECURSIVE e AS (SELECT n_nationkey AS source, (n_nationkey * 2 + 1) % 25 AS target FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 7) % 25 FROM nation), r AS (SELECT 0 AS node, 0 AS depth UNION SELECT target, depth + 1 FROM r JOIN e ON node = source WHERE depth < 4)
SELECT node::BIGINT AS node, min(depth)::INTEGER AS depth FROM r GROUP BY 1""")
def reachability(spark, sf):
    n = read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("source"))
    edges = n.withColumn("target", (F.col("source") * 2 + 1) % 25).unionByName(n.withColumn("target", (F.col("source") + 7) % 25))
    return reachable(edges, n.filter("source = 0").select(F.col("source").alias("node")), 4)


def sitemap_entries(xml: Column) -> Column:
    """struct<is_index, urls>: the locations of a sitemap, or the sitemaps of an index."""
    return F.struct(xml.rlike("<sitemapindex[ >]").alias("is_index"), F.transform(F.regexp_extract_all(xml, F.lit(r"<(?:loc|link)>\s*([^<]*?)\s*</(?:loc|link)>"), 1), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&"))).alias("urls"))


@query("sitemap_urls", "SELECT page_id, replace(url, '#top', '') AS loc, page_id % 5 = 0 AS is_index FROM pages")
def sitemap_urls(spark, sf):
    """Locations in a sitemap made of each page's URL."""
    body = F.concat(F.lit("\n  <loc> "), F.replace(F.replace("url", F.lit("#top"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("</loc>"))
    xml = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("<sitemapindex><sitemap>"), body, F.lit("</sitemap></sitemapindex>"))).otherwise(F.concat(F.lit("<urlset><url>"), body, F.lit("</url></urlset>")))
    s = read(spark, sf, "pages").select("page_id", sitemap_entries(xml).alias("s"))
    return s.select("page_id", F.explode("s.urls").alias("loc"), F.col("s.is_index").alias("is_index"))


def expanded_sitemaps(roots: DataFrame, nested: DataFrame, max_depth: int = 10) -> DataFrame:
    """sitemap, path: every sitemap that the roots (sitemap, ord) lead to, each once, where it first stands; nested ones
    (sitemap, child, ord) follow their parent at once, in their own order. ``path`` sorts them so."""
    level = written(roots.groupBy("sitemap").agg(F.min(F.array("ord")).alias("path")), "sitemaps")
    found = level
    for _ in range(max_depth):
        below = level.join(nested, "sitemap").select(F.col("child").alias("sitemap"), F.concat("path", F.array("ord")).alias("path"))
        level = written(below.groupBy("sitemap").agg(F.min("path").alias("path")).join(found.select("sitemap"), "sitemap", "left_anti"), "sitemaps")
        if not level.take(1):
            break
        found = found.unionByName(level)
    return found


def sitemap_locations(sitemaps: DataFrame, locations: DataFrame, max_sitemaps: int, max_urls: int) -> DataFrame:
    """url, sitemap, place: locations (sitemap, url, ord) of the first ``max_sitemaps`` in order, each where it first
    stands, up to ``max_urls`` (the feature's own limits)."""
    first = numbered(sitemaps, [F.col("path"), F.col("sitemap")], "nth").filter(F.col("nth") <= max_sitemaps)
    once = locations.join(first, "sitemap").groupBy("url").agg(F.min(F.struct("nth", "ord", "sitemap")).alias("x"))
    placed = numbered(once.select("url", "x.*"), [F.col("nth"), F.col("ord"), F.col("url")], "place")
    return placed.filter(F.col("place") <= max_urls).select("url", "sitemap", "place")


@query("sitemap_queue", """WITH maps AS (SELECT 'r' || r_regionkey AS sitemap, [r_regionkey] AS path FROM region UNION ALL SELECT 'n' || n_nationkey, [n_regionkey, n_nationkey] FROM nation), f AS (SELECT *, row_number() OVER (ORDER BY path, sitemap) AS nth FROM maps),
l AS (SELECT 'n' || s_nationkey AS sitemap, 'u' || (s_suppkey % 60) AS url, s_suppkey AS ord FROM supplier UNION ALL SELECT 'r' || (s_suppkey % 5), 'u' || (s_suppkey % 70), s_suppkey FROM supplier),
o AS (SELECT url, sitemap, nth, ord FROM l JOIN f USING (sitemap) WHERE nth <= 20 QUALIFY row_number() OVER (PARTITION BY url ORDER BY nth, ord) = 1)
SELECT url, sitemap, place FROM (SELECT url, sitemap, row_number() OVER (ORDER BY nth, ord, url) AS place FROM o) WHERE place <= 50""")
def sitemap_queue(spark, sf):
    name = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    long = lambda c: F.col(c).cast("long")
    roots = read(spark, sf, "region").select(name("r", "r_regionkey").alias("sitemap"), long("r_regionkey").alias("ord"))
    nested = read(spark, sf, "nation").select(name("r", "n_regionkey").alias("sitemap"), name("n", "n_nationkey").alias("child"), long("n_nationkey").alias("ord"))
    s = read(spark, sf, "supplier")
    of = lambda sitemap, n: s.select(sitemap.alias("sitemap"), F.concat(F.lit("u"), (F.col("s_suppkey") % n).cast("string")).alias("url"), long("s_suppkey").alias("ord"))
    locations = of(name("n", "s_nationkey"), 60).unionByName(of(F.concat(F.lit("r"), (F.col("s_suppkey") % 5).cast("string")), 70))
    return sitemap_locations(expanded_sitemaps(roots, nested), locations, 20, 50)


# Functions that navigate, and calls of them.
NAVIGATION = r"function\s+(\w+)\s*\(([^)]*)\)\s*\{[^}]*?location(?:\.href)?\s*=\s*['\"]([^'\"]*[/=])['\"]\s*\+\s*(\w+)"
CALL = r"(\w+)\(\s*['\"]([^'\"]+)['\"]"


def onclick_links(pages: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """id, link: addresses that scripts of the page build from the first argument of an ``onclick`` call."""
    groups = lambda i: F.regexp_extract_all(html, F.lit(NAVIGATION), i)
    plain = F.filter(F.arrays_zip(groups(1).alias("name"), groups(2).alias("params"), groups(3).alias("prefix"), groups(4).alias("added")), lambda f: F.trim(F.substring_index(f["params"], ",", 1)) == f["added"])
    templates = F.map_from_entries(F.transform(plain, lambda f: F.struct(f["name"], f["prefix"])))
    calls = F.regexp_extract_all(html, F.lit(r"(?i)onclick=\"([^\"]*)\""), 1)
    made = F.transform(calls, lambda c: F.concat(F.try_element_at(F.col("__t"), F.regexp_extract(c, CALL, 1)), F.regexp_extract(c, CALL, 2)))
    return pages.withColumn("__t", templates).select(id, F.explode(F.array_compact(made)).alias("link"))


@query("onclick_links", "SELECT page_id, '/item/' || page_id AS link FROM pages WHERE page_id % 2 = 0")
def script_links(spark, sf):
    k = F.col("page_id")
    script = "<script>function go(id, x) { track(x); window.location.href = '/item/' + id; } function no(a) { alert(a); }</script>"
    call = F.when(k % 2 == 0, F.concat(F.lit("<a onclick=\"go('"), k.cast("string"), F.lit("', 1)\">x</a>"))).otherwise("<a onclick=\"no('y')\">x</a>")
    return onclick_links(read(spark, sf, "pages").select(k, F.concat("html", F.lit(script), call).alias("html")))


def robots_sitemaps(text: Column) -> Column:
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x))
    return F.transform(F.filter(lines, lambda x: x.rlike(r"(?i)^sitemap:\s*\S")), lambda x: F.trim(F.regexp_replace(x, r"(?i)^sitemap:", "")))


@query("robots_sitemaps", "SELECT n_nationkey AS site, 'https://' || lower(n_name) || '/sitemap.xml' AS sitemap FROM nation")
def robots_lines(spark, sf):
    text = F.concat(F.lit("User-agent: *\r\nDisallow: /x\nSITEMAP: https://"), F.lower("n_name"), F.lit("/sitemap.xml \nSitemap:\n"))
    return read(spark, sf, "nation").select(F.col("n_nationkey").alias("site"), F.explode(robots_sitemaps(text)).alias("sitemap"))


# Rules of robots files.


def robots_rules(text: Column) -> Column:
    """array<struct<agents, rules: array<struct<allow, path>>>>: the groups of a robots file in order, by one fold over its lines.

    Agents that follow each other share the rules after them; a blank line ends a group.
    """
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n")
    bare = lambda x: F.regexp_replace(x, "#.*$", "")
    part = lambda x: F.struct(F.lower(F.trim(F.substring_index(bare(x), ":", 1))).alias("name"), F.trim(F.regexp_replace(bare(x), "^[^:]*:", "")).alias("value"), (x == "").alias("blank"), bare(x).contains(":").alias("told"))
    rule = "struct<allow:boolean,path:string>"
    empty = F.struct(F.array().cast("array<string>").alias("agents"), F.array().cast(f"array<{rule}>").alias("rules"))
    start = F.struct(F.lit(0).alias("state"), empty.alias("now"), F.array().cast(f"array<struct<agents:array<string>,rules:array<{rule}>>>").alias("done"))
    state = lambda n, now, done: F.struct(F.lit(n).alias("state"), now.alias("now"), done.alias("done"))
    ended = lambda s: F.when(s["state"] == 2, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"])

    def step(s, x):
        agent = F.struct(F.concat(F.when(s["state"] == 2, F.array().cast("array<string>")).otherwise(s["now"]["agents"]), F.array(F.lower(x["value"]))).alias("agents"), F.when(s["state"] == 2, F.array().cast(f"array<{rule}>")).otherwise(s["now"]["rules"]).alias("rules"))
        # an empty path to disallow allows all
        own = F.struct(((x["name"] == "allow") | (x["value"] == "")).alias("allow"), F.coalesce(F.try_url_decode(F.replace(x["value"], F.lit("+"), F.lit("%2B"))), x["value"]).alias("path"))
        more = F.struct(s["now"]["agents"].alias("agents"), F.concat(s["now"]["rules"], F.array(own)).alias("rules"))
        out = F.when(x["blank"], state(0, empty, ended(s)))
        out = out.when(x["told"] & (x["name"] == "user-agent"), state(1, agent, ended(s)))
        out = out.when(x["told"] & x["name"].isin("allow", "disallow") & (s["state"] != 0), state(2, more, s["done"]))
        return out.when(x["told"] & x["name"].isin("crawl-delay", "request-rate") & (s["state"] != 0), state(2, s["now"], s["done"])).otherwise(s)

    return F.aggregate(F.transform(lines, part), start, step, ended)


def robots_allowed(asked: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """``asked`` (url, host) with ``allowed`` by the robots files (host, text) of their hosts; a host without one allows all.

    The first group that names the agent counts, or else the first for all; in it the first rule whose path the URL's begins with.
    """
    name = agent.split("/")[0].lower()
    groups = robots_rules(F.col("text"))
    named = F.filter(groups, lambda g: F.exists(g["agents"], lambda a: (a != "*") & (a != "") & F.lit(name).contains(a))) if name != "*" else F.filter(groups, lambda g: F.lit(False))
    for_all = F.filter(groups, lambda g: F.array_contains(g["agents"], "*"))
    own = robots.select("host", F.coalesce(F.try_element_at(named, F.lit(1)), F.try_element_at(for_all, F.lit(1)))["rules"].alias("__rules"))
    path, query = U.part(F.col("url"), "path"), U.part(F.col("url"), "query")
    whole = F.concat(F.when(path == "", F.lit("/")).otherwise(F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)), F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    hit = F.try_element_at(F.filter(F.col("__rules"), lambda r: F.startswith(F.col("__path"), r["path"])), F.lit(1))
    return asked.withColumn("__path", whole).join(own, "host", "left").withColumn("allowed", F.coalesce(hit["allow"], F.lit(True))).drop("__path", "__rules")


@query("robots_verdicts", r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages), f AS (SELECT host, min(regexp_extract(path, '^(/[^/]*)', 1)) AS first FROM p GROUP BY 1)
SELECT page_id, path = '' OR starts_with(path, first || '/1') OR NOT starts_with(path, first) AS allowed FROM p JOIN f USING (host)""")
def robots_verdicts(spark, sf):
    """Pages under a robots file of each host that closes its first folder but for what begins with 1."""
    pages = read(spark, sf, "pages").select("page_id", "url", U.part(F.col("url"), "host").alias("host"))
    folders = pages.groupBy("host").agg(F.min(F.regexp_extract(U.part(F.col("url"), "path"), "^(/[^/]*)", 1)).alias("first"))
    robots = folders.select("host", F.concat(F.lit("User-agent: other\nDisallow: /\n\nUser-agent: a\nUser-agent: *\n# note\nAllow: "), "first", F.lit("/1\nDisallow: "), "first", F.lit("\n")).alias("text"))
    return robots_allowed(pages, robots).select("page_id", "allowed")


def contract_targets(results: DataFrame, contracts: DataFrame, limit: int) -> DataFrame:
    """contract, url, place: what of a crawl to scrape for each contract (name, limit): pages that came through, in order of ``place_key`` (see
    ``scrape_targets``), one of each cluster first, up to the contract's limit, or ``limit``.

    ``results``: url, ord, status, content_type, artifact, evidence, links, depth, cluster.
    """
    kind = F.lower(F.trim(F.substring_index(F.coalesce("content_type", F.lit("")), ";", 1)))
    able = results.filter((F.col("status") == "succeeded") & kind.isin("", "text/html", "application/xhtml+xml"))
    placed = numbered(able, [F.col("artifact"), F.desc("evidence"), F.col("links"), F.desc("depth"), F.col("ord")], "__nth")
    first = placed.groupBy("cluster").agg(F.min("__nth").alias("__first"))
    spread = placed.join(first, "cluster").withColumn("again", F.col("__nth") != F.col("__first"))
    order = numbered(spread.select("url", "again", "__nth"), [F.col("again"), F.col("__nth")], "place")
    # contracts are what users wrote: few
    return order.crossJoin(F.broadcast(contracts.select(F.col("name").alias("contract"), F.coalesce("limit", F.lit(limit)).alias("__limit")))).filter(F.col("place") <= F.col("__limit")).select("contract", "url", "place")


@query("contract_targets", f"""WITH {_PARTS}, e AS (SELECT page_id, url, {_SHAPE} AS shape, length(html) % 7 AS links, page_id % 3 AS depth FROM parts WHERE page_id % 4 <> 3), o AS (SELECT *, row_number() OVER (ORDER BY links, depth DESC, page_id) AS nth FROM e),
f AS (SELECT *, row_number() OVER (PARTITION BY shape ORDER BY nth) > 1 AS again FROM o), p AS (SELECT url, row_number() OVER (ORDER BY again, nth) AS place FROM f)
SELECT contract, url, place FROM p, (SELECT 'News' AS contract, 10 AS most UNION ALL SELECT 'Product', 25) WHERE place <= most""")
def page_targets(spark, sf):
    p = read(spark, sf, "pages")
    results = p.select("url", F.col("page_id").alias("ord"), F.when(F.col("page_id") % 4 == 3, "failed").otherwise("succeeded").alias("status"), F.lit("Text/HTML; charset=utf-8").alias("content_type"), F.lit(0).alias("artifact"), F.lit(0.5).alias("evidence"), (F.length("html") % 7).alias("links"), (F.col("page_id") % 3).alias("depth"), U.path_shape(F.col("url")).alias("cluster"))
    return contract_targets(results, spark.createDataFrame([("News", 10), ("Product", None)], "name string, limit int"), 25)
