"""Observation indexes put together: order, budgets, accounts, declarations, signatures, censuses, variants, triggers.

The queries read ``pages``, and take ``events``, ``conversations`` and ``documents`` as candidates of indexes.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.structured import shape_signature
from ..scratch import numbered
from ..sources.html import let, subtree, with_nodes
from ._registry import read, registry
from .network import _RARE, _REQ, endpoint_groups, rank_key, rarity, requests, templated
from .observe import MIN_SKELETON, features

QUERIES, SQL, query = registry()

# The order of modalities in an index; tags that declare something about the page.
MODALITIES = ("html", "dom", "ax", "network")
DECLARATIONS = ("title", "meta", "link", "base", "html")


def compiled(entries: DataFrame) -> DataFrame:
    """``entries`` (modality, pruner, digest, ord) with ``ordinal``, from 1: by modality, pruner, digest, then their order."""
    rank = F.array_position(F.array(*map(F.lit, MODALITIES)), F.col("modality"))
    ranked = entries.withColumn("__rank", F.when(rank == 0, len(MODALITIES) + 1).otherwise(rank))
    return numbered(ranked, [F.col(c) for c in ("__rank", "modality", "pruner", "digest", "ord")], "ordinal").drop("__rank")


@query("index_ordinals", """WITH e AS (SELECT event_id AS ord, CASE user_id % 5 WHEN 0 THEN 'network' WHEN 1 THEN 'html' WHEN 2 THEN 'ax' WHEN 3 THEN 'dom' ELSE 'video' END AS modality, event_type AS pruner, 'd' || (user_id % 7) AS digest FROM events)
SELECT ord, modality, row_number() OVER (ORDER BY CASE modality WHEN 'html' THEN 1 WHEN 'dom' THEN 2 WHEN 'ax' THEN 3 WHEN 'network' THEN 4 ELSE 5 END, modality, pruner, digest, ord) AS ordinal FROM e""")
def index_ordinals(spark, sf):
    u = F.col("user_id") % 5
    kind = F.when(u == 0, "network").when(u == 1, "html").when(u == 2, "ax").when(u == 3, "dom").otherwise("video")
    e = read(spark, sf, "events").select(kind.alias("modality"), F.col("event_type").alias("pruner"), F.concat(F.lit("d"), (F.col("user_id") % 7).cast("string")).alias("digest"), F.col("event_id").alias("ord"))
    return compiled(e).select("ord", "modality", "ordinal")


def bounded_prefix(members: DataFrame, scope: str, order: str, size: str, max_bytes: int, max_items: int) -> DataFrame:
    """``members`` that an expansion shows: in order, up to the first that would overflow either budget.

    Sums run within a scope, whose members are bounded by its region.
    """
    w = Window.partitionBy(scope).orderBy(order)
    placed = members.withColumns({"__n": F.row_number().over(w), "__sum": F.sum(size).over(w)})
    return placed.filter((F.col("__n") <= max_items) & (F.col("__sum") <= max_bytes)).drop("__n", "__sum")


@query("expanded_members", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER w AS n, sum(length(text)) OVER w AS total FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE n <= 4 AND total <= 900")
def expanded_members(spark, sf):
    c = read(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    return bounded_prefix(c, "conv_id", "turn", "size", 900, 4).select("conv_id", "turn")


def account(entries: DataFrame, scope: str) -> DataFrame:
    """scope, proposed, retained, omitted, bytes, retained_bytes of entries (scope, kept, size)."""
    kept = F.coalesce("kept", F.lit(False))
    return entries.groupBy(scope).agg(F.count(F.lit(1)).alias("proposed"), F.count_if(kept).alias("retained"), F.count_if(~kept).alias("omitted"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.when(kept, F.col("size"))), F.lit(0)).alias("retained_bytes"))


@query("view_accounts", "SELECT source, count(*) AS proposed, count(*) FILTER (lang IS NOT NULL) AS retained, count(*) FILTER (lang IS NULL) AS omitted, coalesce(sum(length(text)), 0)::BIGINT AS bytes, coalesce(sum(length(text)) FILTER (lang IS NOT NULL), 0)::BIGINT AS retained_bytes FROM documents GROUP BY 1")
def view_accounts(spark, sf):
    d = read(spark, sf, "documents").select("source", F.col("lang").isNotNull().alias("kept"), F.length("text").cast("long").alias("size"))
    return account(d, "source")


def declarations(nodes: Column) -> Column:
    """array<struct<pre, kind, name, value>>: what a page says of itself: language, title, metadata, links, structured data."""
    a = lambda n, k: n["attrs"][k]
    inner = lambda n: F.trim(F.array_join(F.transform(F.filter(subtree(nodes, n), lambda t: t["tag"] == "#text"), lambda t: t["text"]), ""))
    data = lambda n: (n["tag"] == "script") & F.coalesce(F.lower(a(n, "type")) == "application/ld+json", F.lit(False))
    found = F.filter(nodes, lambda n: n["tag"].isin(*DECLARATIONS) | data(n))
    name = lambda n: F.when(n["tag"] == "meta", F.coalesce(a(n, "name"), a(n, "property"), a(n, "http-equiv"), F.when(a(n, "charset").isNotNull(), "charset"))).when(n["tag"] == "link", a(n, "rel")).when(n["tag"] == "html", "lang")
    value = lambda n: F.when(n["tag"] == "meta", F.coalesce(a(n, "content"), a(n, "charset"))).when(n["tag"].isin("link", "base"), a(n, "href")).when(n["tag"] == "html", a(n, "lang")).otherwise(inner(n))
    return F.transform(found, lambda n: F.struct(n["pre"].alias("pre"), n["tag"].alias("kind"), name(n).alias("name"), value(n).alias("value")))


@query("page_declarations", """SELECT page_id, 'html' AS kind, 'lang' AS name, regexp_extract(html, '<html lang="([^"]*)"', 1) AS value FROM pages UNION ALL SELECT page_id, 'meta', 'charset', regexp_extract(html, '<meta charset="([^"]*)"', 1) FROM pages""")
def page_declarations(spark, sf):
    made = with_nodes(read(spark, sf, "pages").select("page_id", "html")).select("page_id", F.explode(declarations(F.col("nodes"))).alias("d")).select("page_id", "d.kind", "d.name", "d.value")
    return made.filter("kind IN ('html', 'meta')")


@query("payload_shapes", """SELECT CASE event_id % 3 WHEN 0 THEN substr(sha256('k'), 1, 16) WHEN 1 THEN substr(sha256(concat_ws(chr(10), '[]', '[].a', '[].a.b', '[].c')), 1, 16) END AS digest, count(*) AS n FROM events GROUP BY 1""")
def payload_shapes(spark, sf):
    """Payloads by the shape of their JSON, whatever the number of list members and the values."""
    k = F.col("event_id")
    body = F.when(k % 3 == 0, F.col("props")).when(k % 3 == 1, F.concat(F.lit('[{"a": {"b": 1}}, {"c": '), k.cast("string"), F.lit("}]"))).otherwise("{broken")
    return read(spark, sf, "events").select(shape_signature(body).alias("s")).groupBy(F.col("s.digest").alias("digest")).agg(F.count(F.lit(1)).alias("n"))


def endpoint_features(endpoint: Column) -> Column:
    """``ep:`` with the host and the path whose ids are templates; null without a host."""
    rest = F.regexp_replace(F.trim(endpoint), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.element_at(F.split(F.substring_index(rest, "/", 1), "@"), -1))
    from ..functions import values as V

    path = F.when(rest.contains("/"), F.regexp_replace(rest, r"^[^/]*", "")).otherwise(F.lit(""))
    tidy = F.array_join(F.filter(F.split(V.path_template(path), "/"), lambda s: s != ""), "/")
    return F.when(host != "", F.concat(F.lit("ep:"), host, F.lit("/"), tidy))


@query("endpoint_skeletons", f"WITH {_REQ} SELECT DISTINCT origin, 'ep:' || split_part(origin, '//', 2) || template AS feature FROM req")
def endpoint_skeletons(spark, sf):
    """The set of endpoints that each site calls."""
    return requests(spark, sf).select("origin", endpoint_features(F.concat("origin", "path")).alias("feature")).distinct()


def header_features(headers: Column) -> Column:
    """``hdr:`` names and ``cookie:`` names of a map of headers; never values."""
    names = F.filter(F.transform(F.map_keys(headers), lambda k: F.lower(F.trim(k))), lambda k: k != "")
    cookies = F.transform(F.filter(F.map_entries(headers), lambda e: (F.lower(F.trim(e["key"])) == "set-cookie") & (e["value"] != "")), lambda e: F.lower(F.trim(F.substring_index(e["value"], "=", 1))))
    marked = lambda mark, a: F.transform(a, lambda x: F.concat(F.lit(mark), x))
    return F.array_sort(F.array_distinct(F.concat(marked("hdr:", names), marked("cookie:", F.filter(cookies, lambda c: c != "")))))


@query("header_signatures", "SELECT event_id AS id, 'cookie:sid' || (user_id % 3) || ',hdr:server,hdr:set-cookie' || CASE WHEN event_type = 'view' THEN ',hdr:x-cache' ELSE '' END AS signature FROM events")
def header_signatures(spark, sf):
    some = F.create_map(F.lit("Server"), F.lit("x"), F.lit(" Set-Cookie"), F.concat(F.lit("SID"), (F.col("user_id") % 3).cast("string"), F.lit("=abc; Path=/")))
    more = F.when(F.col("event_type") == "view", F.create_map(F.lit("X-Cache"), F.lit("hit"))).otherwise(F.create_map().cast("map<string,string>"))
    return read(spark, sf, "events").select(F.col("event_id").alias("id"), F.array_join(header_features(F.map_concat(some, more)), ",").alias("signature"))


def skeleton_hash(skeleton: Column) -> Column:
    """``t1:`` and a digest of a page's sorted set of skeleton features; ``t1:degenerate`` for a page with too few."""
    body = F.to_json(F.array_sort(F.array_distinct(skeleton)))
    return F.when(F.size(skeleton) < MIN_SKELETON, "t1:degenerate").otherwise(F.concat(F.lit("t1:"), F.substring(F.sha2(body, 256), 1, 16)))


@query("skeleton_hashes")
def skeleton_hashes(spark, sf):
    return features(read(spark, sf, "pages")).select("page_id", skeleton_hash(F.col("skeleton")).alias("skeleton_hash"))


def row_structure(nodes: Column, of: Column) -> Column:
    """24 hex digits of a row's structure: of each element its depth in the row, tag, attribute names and band of children."""
    own = F.filter(subtree(nodes, of), lambda n: n["tag"] != "#text")
    kids = lambda n: F.size(F.filter(own, lambda c: c["parent"] == n["pre"]))
    band = lambda k: F.when(k == 0, "0").when(k == 1, "1").when(k <= 4, "2-4").otherwise("5+")
    lines = F.transform(own, lambda n: F.concat_ws(":", (n["depth"] - of["depth"]).cast("string"), n["tag"], F.array_join(F.array_sort(F.transform(F.map_keys(n["attrs"]), lambda k: F.lower(k))), ","), let(kids(n), band)))
    return F.substring(F.sha2(F.array_join(lines, "\n"), 256), 1, 24)


@query("list_item_structures", r"""WITH i AS (SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '<nav>(.*)</nav>', 1), '<li><a href="[^"]*">[^<]*</a></li>')) AS li FROM pages)
SELECT page_id, substr(sha256('0:li::1' || chr(10) || '1:a:href:0'), 1, 24) AS structure, count(*) AS n FROM i GROUP BY 1""")
def list_item_structures(spark, sf):
    """Rows of each page's navigation by structure: texts and addresses don't matter."""
    nodes = F.col("nodes")
    parsed = with_nodes(read(spark, sf, "pages").select("page_id", "html"))
    made = parsed.select("page_id", F.explode(F.transform(F.filter(nodes, lambda n: n["tag"] == "li"), lambda n: row_structure(nodes, n))).alias("structure"))
    return made.groupBy("page_id", "structure").agg(F.count(F.lit(1)).alias("n"))


def template_ratio(a: Column, b: Column) -> Column:
    """How much of two path templates matches in order: 1 for equal ones, 0 if one is empty."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([0.0 if not p or not q else 1.0 if p == q else SequenceMatcher(a=p, b=q, autojunk=False).ratio() for p, q in zip(x, y)], dtype="float64")

    return ratio(a, b)


def path_similarity(a: Column, b: Column) -> Column:
    """1 for URLs of one path template, else how much of the joined templates matches in order; 0 for a URL without a path."""
    return template_ratio(path_signature(a), path_signature(b))


@query("path_similarities")
def path_similarities(spark, sf):
    """Each page's URL against the first of its host."""
    p = read(spark, sf, "pages").select("page_id", "url", U.part(F.col("url"), "host").alias("host"))
    first = p.groupBy("host").agg(F.min_by("url", "page_id").alias("first"))
    return p.join(first, "host").select("page_id", F.round(path_similarity(F.col("url"), F.col("first")), 9).alias("similarity"))


def path_signature(url: Column) -> Column:
    return F.coalesce(F.array_join(F.filter(F.split(U.link_signature(url), "/"), lambda s: s != ""), "/"), F.lit(""))


def best_similarities(found: DataFrame, references: DataFrame, scope: str, url: str = "url") -> DataFrame:
    """``found`` with ``similarity``: how like a URL's path is to that of the reference of its scope that is most like it; null without one.

    Paths are compared by template, so each two distinct templates of a scope are compared once, however many URLs have them; equal
    ones aren't compared at all.
    """
    told = found.withColumn("__own", path_signature(F.col(url)))
    known = references.select(F.col(scope).alias("__scope"), path_signature(F.col(url)).alias("__their")).distinct()
    asked = told.select(F.col(scope).alias("__scope"), "__own").distinct()
    pairs = asked.join(known, "__scope")
    equal = pairs.filter("__own = __their AND __own <> ''").select("__scope", "__own", F.lit(1.0).alias("similarity"))
    rest = pairs.join(equal.select("__scope", "__own"), ["__scope", "__own"], "left_anti").select("__scope", "__own", template_ratio(F.col("__own"), F.col("__their")).alias("similarity"))
    best = equal.unionByName(rest).groupBy("__scope", "__own").agg(F.max("similarity").alias("similarity"))
    return told.join(best, (F.col(scope) == F.col("__scope")) & (told["__own"] == best["__own"]), "left").select(*found.columns, "similarity")


@query("best_path_similarities")
def best_path_similarities(spark, sf):
    """Each page's URL against those of every tenth page of its host."""
    p = read(spark, sf, "pages").select("page_id", "url", U.part(F.col("url"), "host").alias("host"))
    refs = p.filter("page_id % 10 = 0")
    return best_similarities(p, refs, "host").select("page_id", F.round("similarity", 9).alias("similarity"))


# Censuses of roles, and how members of a region differ.


def naming_census(nodes: DataFrame, scope: str) -> DataFrame:
    """scope, role, name, n: how often a role has a name, blanks aside; what stands once can be aimed at."""
    name = F.trim(F.regexp_replace(F.coalesce("name", F.lit("")), r"\s+", " "))
    return nodes.groupBy(scope, "role", name.alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("naming_census", "SELECT user_id AS page, event_type AS role, 'n ' || (event_id % 3) AS name, count(*) AS n FROM events GROUP BY 1, 2, 3")
def named_roles(spark, sf):
    e = read(spark, sf, "events").select(F.col("user_id").alias("page"), F.col("event_type").alias("role"), F.concat(F.lit("  n \t"), (F.col("event_id") % 3).cast("string"), F.lit(" ")).alias("name"))
    return naming_census(e, "page")


def sibling_census(children: DataFrame, parent: str) -> DataFrame:
    """parent, role, key, value, n: among a node's children how many have a role (key null), and a role and an attribute."""
    roles = children.groupBy(parent, "role").agg(F.count(F.lit(1)).alias("n")).select(parent, "role", F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"), "n")
    keyed = children.select(parent, "role", F.explode("attrs").alias("key", "value")).groupBy(parent, "role", "key", "value").agg(F.count(F.lit(1)).alias("n"))
    return roles.unionByName(keyed)


@query("sibling_census", "SELECT user_id AS parent, event_type AS role, NULL AS key, NULL AS value, count(*) AS n FROM events GROUP BY 1, 2 UNION ALL SELECT user_id, event_type, 'level', CAST(event_id % 2 AS VARCHAR), count(*) FROM events GROUP BY 1, 2, 4")
def roles_of_siblings(spark, sf):
    e = read(spark, sf, "events").select(F.col("user_id").alias("parent"), F.col("event_type").alias("role"), F.create_map(F.lit("level"), (F.col("event_id") % 2).cast("string")).alias("attrs"))
    return sibling_census(e, "parent")


def variants(members: DataFrame, region: str, member: str, tokens: str) -> DataFrame:
    """region, token, n: tokens that some of a region's members have and others don't."""
    sizes = members.groupBy(region).agg(F.countDistinct(member).alias("__size"))
    found = members.select(region, member, F.explode(F.array_distinct(tokens)).alias("token")).groupBy(region, "token").agg(F.countDistinct(member).alias("n"))
    return found.join(sizes, region).filter(F.col("n") < F.col("__size")).drop("__size")


@query("member_variants", "WITH t AS (SELECT user_id AS region, event_id AS member, unnest(['all', event_type, 'k' || (event_id % 4)]) AS token FROM events), s AS (SELECT region, count(DISTINCT member) AS size FROM t GROUP BY 1), n AS (SELECT region, token, count(DISTINCT member) AS n FROM t GROUP BY 1, 2) SELECT region, token, n FROM n JOIN s USING (region) WHERE n < size")
def member_variants(spark, sf):
    e = read(spark, sf, "events").select(F.col("user_id").alias("region"), F.col("event_id").alias("member"), F.array(F.lit("all"), F.col("event_type"), F.concat(F.lit("k"), (F.col("event_id") % 4).cast("string"))).alias("tokens"))
    return variants(e, "region", "member", "tokens")


def state_tallies(members: DataFrame, region: str, member: str, states: str) -> DataFrame:
    """region, state, value, n, members: in how many of a region's members a state (a map of names to values) has each value."""
    sizes = members.groupBy(region).agg(F.countDistinct(member).alias("members"))
    found = members.select(region, member, F.explode(states).alias("state", "value")).groupBy(region, "state", "value").agg(F.countDistinct(member).alias("n"))
    return found.join(sizes, region)


@query("state_tallies", "WITH t AS (SELECT user_id AS region, event_id AS member, unnest(['checked', 'kind']) AS state, unnest([CAST(event_id % 2 = 0 AS VARCHAR), event_type]) AS value FROM events), s AS (SELECT region, count(DISTINCT member) AS members FROM t GROUP BY 1) SELECT region, state, value, count(DISTINCT member) AS n, members FROM t JOIN s USING (region) GROUP BY region, state, value, members")
def tallied_states(spark, sf):
    states = F.create_map(F.lit("checked"), (F.col("event_id") % 2 == 0).cast("string"), F.lit("kind"), F.col("event_type"))
    return state_tallies(read(spark, sf, "events").select(F.col("user_id").alias("region"), F.col("event_id").alias("member"), states.alias("states")), "region", "member", "states")


def endpoint_lines(found: DataFrame, deviants: int = 3) -> DataFrame:
    """origin, method, template, line, deviants: one line for each endpoint, with how many distinct parameter signatures and shapes its calls
    have and how many deviate, and the first so many of those that do, the rarest first.

    ``found``: requests with template, signature and the reasons of ``network.rarity``.
    """
    group = ["origin", "method", "template"]
    ranked = found.withColumn("__rank", rank_key()).withColumn("__odd", (F.col("group_size") > 1) & F.col("__rank").contains("0"))
    facts = ranked.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("status")).alias("statuses"), F.countDistinct("signature").alias("signatures"), F.countDistinct("shape").alias("shapes"), F.count_if("__odd").alias("odd"))
    first = F.row_number().over(Window.partitionBy(*group).orderBy("__rank", "request_id"))
    odd = ranked.filter("__odd").withColumn("__nth", first).filter(F.col("__nth") <= deviants).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("__nth", "request_id"))).alias("odd_ones"))
    many = lambda n, word: F.concat(F.col(n).cast("string"), F.lit(f" {word}"), F.when(F.col(n) == 1, "").otherwise("s"))
    line = F.concat("method", F.lit(" "), "template", F.lit(" x"), F.col("n").cast("string"), F.lit(" "), F.array_join("statuses", "/"), F.lit(", "), many("signatures", "signature"), F.lit(", "), many("shapes", "shape"), F.when(F.col("odd") > 0, F.concat(F.lit(", "), many("odd", "deviant"))).otherwise(""))
    return facts.join(odd, group, "left").select(*group, line.alias("line"), F.coalesce(F.array_join(F.transform("odd_ones", lambda x: x["request_id"].cast("string")), ","), F.lit("")).alias("deviants"))


@query("endpoint_deviants", f"""WITH {_RARE}, g AS (SELECT *, request_id % 2 AS signature, group_size > 1 AND contains(rank, '0') AS odd FROM rare), d AS (SELECT *, row_number() OVER (PARTITION BY origin, method, template ORDER BY rank, request_id) AS nth FROM g WHERE odd),
o AS (SELECT origin, method, template, string_agg(CAST(request_id AS VARCHAR), ',' ORDER BY nth) AS deviants FROM d WHERE nth <= 3 GROUP BY 1, 2, 3),
f AS (SELECT origin, method, template, count(*) AS n, array_to_string(list_sort(list(DISTINCT status)), '/') AS st, count(DISTINCT signature) AS sg, count(DISTINCT shape) AS sh, count(*) FILTER (odd) AS od FROM g GROUP BY 1, 2, 3)
SELECT origin, method, template, method || ' ' || template || ' x' || n || ' ' || st || ', ' || sg || ' signature' || CASE WHEN sg = 1 THEN '' ELSE 's' END || ', ' || sh || ' shape' || CASE WHEN sh = 1 THEN '' ELSE 's' END || CASE WHEN od > 0 THEN ', ' || od || ' deviant' || CASE WHEN od = 1 THEN '' ELSE 's' END ELSE '' END AS line, coalesce(deviants, '') AS deviants FROM f LEFT JOIN o USING (origin, method, template)""")
def endpoint_deviants(spark, sf):
    """Endpoints of the trace with their rarest calls; a call's signature is made from its number."""
    found = rarity(templated(requests(spark, sf)).withColumn("signature", F.col("request_id") % 2))
    return endpoint_lines(found)


@query("group_coverage", f"WITH {_REQ} SELECT origin, method, template, count(*) AS observed, CASE WHEN origin IN ('https://api0.test', 'https://api3.test') THEN count(*) END AS declared FROM req GROUP BY 1, 2, 3")
def group_coverage(spark, sf):
    """How many calls of an endpoint a trace holds; that these are all is said only of a trace known to be complete."""
    complete = F.col("origin").isin("https://api0.test", "https://api3.test")
    g = endpoint_groups(templated(requests(spark, sf)))
    return g.select("origin", "method", "template", F.col("n").alias("observed"), F.when(complete, F.col("n")).alias("declared"))


@query("endpoint_texts", f"WITH {_REQ} SELECT origin, method, template, method || ' ' || template || ' x' || count(*) || ' ' || array_to_string(list_sort(list(DISTINCT status)), '/') || ', ' || count(DISTINCT shape) || CASE WHEN count(DISTINCT shape) = 1 THEN ' shape' ELSE ' shapes' END AS line FROM req GROUP BY 1, 2, 3")
def endpoint_texts(spark, sf):
    """One line for each endpoint: calls, statuses, how many shapes."""
    g = endpoint_groups(templated(requests(spark, sf)))
    line = F.concat("method", F.lit(" "), "template", F.lit(" x"), F.col("n").cast("string"), F.lit(" "), F.array_join("statuses", "/"), F.lit(", "), F.col("shapes").cast("string"), F.when(F.col("shapes") == 1, " shape").otherwise(" shapes"))
    return g.select("origin", "method", "template", line.alias("line"))


# What a page might ask of a visitor, told by its markup; and conditions that a replay waits for.

# Markup and words of each kind.
TRIGGERS = {
    "cookie": r"(?i)cookie[-_ ]?(?:consent|banner|notice)|accept (?:all )?cookies",
    "popup": r"(?i)class=\"[^\"]*(?:modal|popup|overlay)[^\"]*\"|role=\"dialog\"",
    "load_more": r"(?i)>\s*(?:load|show|see) more\s*<",
    "pagination": r"(?i)rel=\"next\"|class=\"[^\"]*paginat[^\"]*\"|[?&]page=\d+",
    "search": r"(?i)type=\"search\"|role=\"search\"",
}


def triggers(html: Column) -> Column:
    return F.array_compact(F.array(*[F.when(html.rlike(pattern), F.lit(kind)) for kind, pattern in TRIGGERS.items()]))


@query("page_triggers", """SELECT page_id, 'cookie' AS kind FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 'load_more' FROM pages WHERE page_id % 3 = 0
UNION ALL SELECT page_id, 'pagination' FROM pages WHERE page_id % 5 = 0 OR regexp_matches(html, '(?i)rel="next"|class="[^"]*paginat[^"]*"|[?&]page=[0-9]+')""")
def page_triggers(spark, sf):
    k = F.col("page_id")
    more = F.concat(F.col("html"), F.when(k % 2 == 0, '<div id="cookie-banner">Accept</div>').otherwise(""), F.when(k % 3 == 0, "<button> Load more </button>").otherwise(""), F.when(k % 5 == 0, '<a rel="next" href="/2">2</a>').otherwise(""))
    return read(spark, sf, "pages").select(k, F.explode(triggers(more)).alias("kind"))


def condition(kind: str, value: str, nodes: Column, url: Column, least: int = 1) -> Column:
    """Whether a page meets a condition: url (contains), selector, text, count (at least), absent."""
    from ..plans.selectors import css

    if kind == "url":
        return url.contains(value)
    if kind == "text":
        shown = F.filter(nodes, lambda n: (n["tag"] == "#text"))
        return F.exists(shown, lambda n: n["text"].contains(value))
    found = F.size(css(value).nodes(nodes))
    return {"selector": found > 0, "absent": found == 0, "count": found >= least}[kind]


@query("replay_conditions", "SELECT page_id, contains(url, 'page=2') AS at_page_2, true AS has_article, len(regexp_extract_all(html, '<p>')) >= 9 AS nine_paragraphs, true AS no_form FROM pages")
def replay_conditions(spark, sf):
    nodes, url = F.col("nodes"), F.col("url")
    parsed = with_nodes(read(spark, sf, "pages").select("page_id", "url", "html"))
    return parsed.select("page_id", condition("url", "page=2", nodes, url).alias("at_page_2"), condition("selector", "article > h1", nodes, url).alias("has_article"), condition("count", "p", nodes, url, 9).alias("nine_paragraphs"), condition("absent", "form", nodes, url).alias("no_form"))


# Stored bytes, told by their digest.


def put_artifacts(rows: DataFrame, content: str, path: str) -> DataFrame:
    """Writes each distinct content once, partitioned by the digest's first digits; returns digest and size of every row."""
    keyed = rows.withColumn("digest", F.sha2(F.col(content).cast("binary"), 256))
    stored = keyed.groupBy("digest").agg(F.first(F.col(content).cast("binary")).alias("content")).withColumn("shelf", F.substring("digest", 1, 2))
    try:
        stored = stored.join(rows.sparkSession.read.parquet(path).select("digest"), "digest", "left_anti")
    except AnalysisException as e:  # nothing is stored yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    stored.write.mode("append").partitionBy("shelf").parquet(path)
    return keyed.select(*[c for c in rows.columns if c != content], "digest", F.octet_length(F.col(content).cast("binary")).alias("size"))


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """digest, content, intact: whether the content still has its digest."""
    return spark.read.parquet(path).select("digest", "content", (F.sha2("content", 256) == F.col("digest")).alias("intact"))
