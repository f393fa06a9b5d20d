"""Summaries of operational tables: events, runs, verdicts, coverage, research notes, field atoms.

The queries take ``events`` as an event log of sites, ``conversations`` as research notes and ``pages`` as where atoms
of selectors were seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._registry import read, registry

QUERIES, SQL, query = registry()

# How far each source of a selector is trusted; the statuses of a contract in rising order.
SOURCE_TRUST = {"verified": 3, "manual": 2, "llm": 2, "fingerprint": 1}
CONTRACT_STATUS = {"rejected": 0, "candidate": 1, "provisional": 2, "validated": 3, "production": 4}


def cache_events(events: DataFrame) -> DataFrame:
    """id, domain, url, route, event_type, occurred_at, value, k of the events table."""
    site = F.concat(F.lit("site"), (F.col("user_id") % 40).cast("string"))
    url = F.concat(F.lit("https://"), site, F.lit(".test/"), "event_type", F.lit("/"), (F.col("event_id") % 97).cast("string"))
    return events.select(F.col("event_id").alias("id"), site.alias("domain"), url.alias("url"), F.concat(F.lit("/"), "event_type", F.lit("/{id}")).alias("route"), "event_type", F.col("ts").alias("occurred_at"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


EV = """ev AS (SELECT event_id AS id, 'site' || (user_id % 40) AS domain, 'https://site' || (user_id % 40) || '.test/' || event_type || '/' || (event_id % 97) AS url, '/' || event_type || '/{id}' AS route,
  event_type, ts AS occurred_at, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


def scale_to(value: Column) -> Column:
    """Exact sums of money and times, whatever the order of adding."""
    return F.sum(value.cast("decimal(18,4)")).cast("double")


@query("event_summary", f"WITH {EV} SELECT domain, event_type, count(*) AS n, count(DISTINCT url) AS urls FROM ev GROUP BY 1, 2")
def event_summary(spark, sf):
    return cache_events(read(spark, sf, "events")).groupBy("domain", "event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("url").alias("urls"))


@query("domain_summary", f"WITH {EV} SELECT domain, count(DISTINCT url) AS urls, array_to_string(list_sort(list(DISTINCT route)), ',') AS routes, count(*) AS runs FROM ev GROUP BY 1")
def domain_summary(spark, sf):
    """Of each domain its URLs, routes (few by nature) and runs."""
    return cache_events(read(spark, sf, "events")).groupBy("domain").agg(F.countDistinct("url").alias("urls"), F.array_join(F.array_sort(F.collect_set("route")), ",").alias("routes"), F.count(F.lit(1)).alias("runs"))


def latest(rows: DataFrame, scope: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The last row of each scope by aggregation, so that one scope with most rows needs no sort."""
    picked = rows.groupBy(*scope).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("__last"))
    return picked.select(*scope, "__last.*")


@query("latest_run", f"WITH {EV} SELECT domain, id, event_type, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status FROM ev QUALIFY row_number() OVER (PARTITION BY domain ORDER BY occurred_at DESC, id DESC) = 1")
def latest_run(spark, sf):
    runs = cache_events(read(spark, sf, "events")).withColumn("status", F.when(F.col("event_type") == "error", "failed").otherwise("ok"))
    return latest(runs, ["domain"], ["occurred_at", "id"], ["id", "event_type", "status"])


def failure_streaks(verdicts: DataFrame, scope: list[str], order: list[str], failed: Column) -> DataFrame:
    """Of each scope how many verdicts failed since the last that didn't."""
    good = verdicts.filter(~failed).groupBy(*scope).agg(F.max(F.struct(*order)).alias("__good"))
    after = failed & (F.col("__good").isNull() | (F.struct(*order) > F.col("__good")))
    return verdicts.join(good, scope, "left").groupBy(*scope).agg(F.count_if(after).alias("failures"), F.count(F.lit(1)).alias("verdicts"))


_STREAKS = f"""{EV}, v AS (SELECT domain, 'f' || (k % 5) AS field, occurred_at, id, event_type = 'error' AS bad FROM ev), good AS (SELECT domain, field, max(occurred_at) AS at FROM v WHERE NOT bad GROUP BY 1, 2),
lastgood AS (SELECT v.domain, v.field, max((v.occurred_at, v.id)) AS g FROM v WHERE NOT bad GROUP BY 1, 2),
streaks AS (SELECT v.domain, v.field, count(*) FILTER (bad AND (g IS NULL OR (v.occurred_at, v.id) > g)) AS failures, count(*) AS verdicts FROM v LEFT JOIN lastgood l ON l.domain = v.domain AND l.field = v.field GROUP BY 1, 2)"""


def streaks(spark, sf):
    v = cache_events(read(spark, sf, "events")).withColumn("field", F.concat(F.lit("f"), (F.col("k") % 5).cast("string")))
    return failure_streaks(v, ["domain", "field"], ["occurred_at", "id"], F.col("event_type") == "error")


@query("verdict_streaks", f"WITH {_STREAKS} SELECT * FROM streaks")
def verdict_streaks(spark, sf):
    return streaks(spark, sf)


def health(latest_status: Column, fields: Column, failing: Column) -> Column:
    """unhealthy if the latest run failed, else degraded if a field fails, else healthy; unknown without either."""
    none = latest_status.isNull() & (F.coalesce(fields, F.lit(0)) == 0)
    return F.when(none, "unknown").when(latest_status != "ok", "unhealthy").when(F.coalesce(failing, F.lit(0)) > 0, "degraded").otherwise("healthy")


@query("run_health", f"""WITH {_STREAKS}, l AS (SELECT domain, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status FROM ev QUALIFY row_number() OVER (PARTITION BY domain ORDER BY occurred_at DESC, id DESC) = 1),
f AS (SELECT domain, count(*) AS fields, count(*) FILTER (failures > 0) AS failing FROM streaks GROUP BY 1)
SELECT domain, fields, failing, CASE WHEN status IS NULL AND fields = 0 THEN 'unknown' WHEN status <> 'ok' THEN 'unhealthy' WHEN failing > 0 THEN 'degraded' ELSE 'healthy' END AS health FROM l JOIN f USING (domain)""")
def run_health(spark, sf):
    f = streaks(spark, sf).groupBy("domain").agg(F.count(F.lit(1)).alias("fields"), F.count_if(F.col("failures") > 0).alias("failing"))
    return latest_run(spark, sf).join(f, "domain").select("domain", "fields", "failing", health(F.col("status"), F.col("fields"), F.col("failing")).alias("health"))


@query("tracking_stats", f"""WITH {EV} SELECT domain, count(*) AS url_count, count(*) FILTER (event_type = 'signup') AS llm_calls, sum(CAST(value AS DECIMAL(18,4)))::DOUBLE AS total_elapsed, count(*) FILTER (event_type = 'error') AS partial,
  CASE WHEN count(*) FILTER (event_type = 'signup') > 0 THEN count(*) / count(*) FILTER (event_type = 'signup') END AS efficiency FROM ev GROUP BY 1""")
def tracking_stats(spark, sf):
    """Counters by domain; efficiency is URLs for each call of a model."""
    calls = F.count_if(F.col("event_type") == "signup")
    return cache_events(read(spark, sf, "events")).groupBy("domain").agg(F.count(F.lit(1)).alias("url_count"), calls.alias("llm_calls"), scale_to(F.col("value")).alias("total_elapsed"), F.count_if(F.col("event_type") == "error").alias("partial"), F.try_divide(F.count(F.lit(1)), calls).alias("efficiency"))


@query("level_map", f"WITH {EV}, n AS (SELECT domain, k % 8 + 1 AS level, count(*) AS n FROM ev GROUP BY 1, 2) SELECT domain, string_agg(level || ':' || n, ',' ORDER BY level) AS levels FROM n GROUP BY 1")
def level_map(spark, sf):
    """Counts by selector level of each domain, summed in two steps."""
    n = cache_events(read(spark, sf, "events")).groupBy("domain", (F.col("k") % 8 + 1).alias("level")).count()
    entries = F.array_sort(F.collect_list(F.struct("level", "count")))
    return n.groupBy("domain").agg(F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["level"].cast("string"), e["count"].cast("string"))), ",").alias("levels"))


# Crawl outcomes: a run is a domain, an event a URL that was tried.

_RESULTS = f"""{EV}, res AS (SELECT *, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'policy_blocked' ELSE 'succeeded' END AS status,
  CASE k % 4 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'Application/JSON' WHEN 2 THEN '' END AS content_type FROM ev)"""


def crawl_results(spark, sf) -> DataFrame:
    kinds = F.when(F.col("k") % 4 == 0, "text/html; charset=utf-8").when(F.col("k") % 4 == 1, "Application/JSON").when(F.col("k") % 4 == 2, "")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "policy_blocked").otherwise("succeeded")
    return cache_events(read(spark, sf, "events")).withColumns({"status": status, "content_type": kinds})


def content_family(content_type: Column) -> Column:
    bare = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    return F.when(bare == "", "unknown").otherwise(bare)


def path_prefix(url: Column, depth: int = 1) -> Column:
    parts = F.filter(F.split(F.regexp_extract(url, "^[a-z]+://[^/?#]*([^?#]*)", 1), "/"), lambda p: p != "")
    return F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, depth), "/"))


@query("crawl_path_prefixes", f"WITH {_RESULTS} SELECT domain, '/' || split_part(url, '/', 4) AS prefix, count(*) AS n FROM res WHERE status = 'succeeded' GROUP BY 1, 2")
def crawl_path_prefixes(spark, sf):
    return crawl_results(spark, sf).filter("status = 'succeeded'").groupBy("domain", path_prefix(F.col("url")).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


@query("crawl_content_types", f"WITH {_RESULTS} SELECT CASE WHEN coalesce(content_type, '') = '' THEN 'unknown' ELSE lower(trim(split_part(content_type, ';', 1))) END AS content_type, count(*) AS n FROM res WHERE status = 'succeeded' GROUP BY 1")
def crawl_content_types(spark, sf):
    return crawl_results(spark, sf).filter("status = 'succeeded'").groupBy(content_family(F.col("content_type")).alias("content_type")).agg(F.count(F.lit(1)).alias("n"))


@query("outcome_lanes", f"WITH {_RESULTS} SELECT domain, status, count(*) AS n, arg_min(url, id) AS first_url, arg_max(url, id) AS last_url FROM res GROUP BY 1, 2")
def outcome_lanes(spark, sf):
    """Each lane's size, first and last URL; the lane's URLs themselves are the rows."""
    return crawl_results(spark, sf).groupBy("domain", "status").agg(F.count(F.lit(1)).alias("n"), F.min_by("url", "id").alias("first_url"), F.max_by("url", "id").alias("last_url"))


def run_status(attempted: Column, failures: Column, threshold: int = 0) -> Column:
    return F.when(attempted <= 0, "error").when(failures > threshold, "partial").otherwise("ok")


@query("crawl_run_status", f"""WITH {_RESULTS}, s AS (SELECT domain, count(*) FILTER (status <> 'policy_blocked') AS attempted, count(*) FILTER (status = 'failed') AS failures, count(DISTINCT k) AS batches, count(*) FILTER (k % 6 = 0) AS idle FROM res GROUP BY 1)
SELECT domain, attempted, failures, CASE WHEN attempted <= 0 THEN 'error' WHEN failures > 3 THEN 'partial' ELSE 'ok' END AS status, CASE WHEN batches > 0 THEN idle / (batches * 4) ELSE 0 END AS idle_ratio, CASE WHEN batches > 0 THEN greatest(0, batches * 4 - idle) / batches ELSE 0 END AS batch_fill FROM s""")
def crawl_run_status(spark, sf, workers: int = 4):
    """Status of each run, and how well its worker slots were used."""
    r = crawl_results(spark, sf)
    s = r.groupBy("domain").agg(F.count_if(F.col("status") != "policy_blocked").alias("attempted"), F.count_if(F.col("status") == "failed").alias("failures"), F.countDistinct("k").alias("batches"), F.count_if(F.col("k") % 6 == 0).alias("idle"))
    slots, zero = F.col("batches") * workers, F.lit(0.0)
    used = F.greatest(F.lit(0), slots - F.col("idle"))
    return s.select("domain", "attempted", "failures", run_status(F.col("attempted"), F.col("failures"), 3).alias("status"), F.coalesce(F.try_divide("idle", slots), zero).alias("idle_ratio"), F.coalesce(F.try_divide(used, F.col("batches")), zero).alias("batch_fill"))


@query("envelope_status", f"WITH {_RESULTS}, s AS (SELECT domain, count(*) AS units, count(*) FILTER (status = 'succeeded') AS good FROM res GROUP BY 1) SELECT domain, units, good, CASE WHEN good = units THEN 'ok' WHEN good = 0 THEN 'error' ELSE 'partial' END AS status FROM s")
def envelope_status(spark, sf):
    s = crawl_results(spark, sf).groupBy("domain").agg(F.count(F.lit(1)).alias("units"), F.count_if(F.col("status") == "succeeded").alias("good"))
    return s.withColumn("status", F.when(F.col("good") == F.col("units"), "ok").when(F.col("good") == 0, "error").otherwise("partial"))


@query("field_coverage", """WITH c AS (SELECT source, count(*) AS records, count(lang) AS with_lang, count(*) FILTER (trim(text) <> '') AS with_text FROM documents GROUP BY 1), b AS (SELECT count(lang) / count(*) AS base FROM documents)
SELECT source, records, with_lang, with_text, round(with_lang / records, 6) AS lang_coverage, CASE WHEN with_text = 0 THEN 'failed' WHEN with_lang / records < base * 0.9 THEN 'degraded' ELSE 'ok' END AS quality FROM c, b""")
def field_coverage(spark, sf):
    """How many records of each source have a field, against the coverage of all."""
    docs = read(spark, sf, "documents").select("source", "lang", "text")
    c = docs.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.count("lang").alias("with_lang"), F.count_if(F.trim("text") != "").alias("with_text"))
    base = docs.agg((F.count("lang") / F.count(F.lit(1))).alias("base"))
    share = F.col("with_lang") / F.col("records")
    quality = F.when(F.col("with_text") == 0, "failed").when(share < F.col("base") * 0.9, "degraded").otherwise("ok")
    return c.join(F.broadcast(base)).select("source", "records", "with_lang", "with_text", F.round(share, 6).alias("lang_coverage"), quality.alias("quality"))  # base is one row


def merge_status(statuses: Column) -> Column:
    """The highest status; what starts as a candidate never falls to rejected."""
    rank = F.create_map(*[F.lit(x) for pair in CONTRACT_STATUS.items() for x in pair])
    top = F.max(F.struct(F.coalesce(F.try_element_at(rank, statuses), F.lit(1)).alias("r"), statuses.alias("s")))
    return F.when(top["r"] <= 1, "candidate").otherwise(top["s"])


@query("research_summary", """WITH o AS (SELECT 'c' || (conv_id % 20) AS contract, conv_id, turn, CASE WHEN turn % 7 = 6 THEN 'production' WHEN turn % 5 = 4 THEN 'rejected' WHEN role = 'assistant' THEN 'provisional' ELSE 'candidate' END AS status,
  CASE WHEN turn % 3 = 0 THEN 'a' || turn END AS artifact, CASE WHEN turn % 2 = 1 THEN length(text) END AS records FROM conversations),
m AS (SELECT contract, max(CASE status WHEN 'production' THEN 4 WHEN 'validated' THEN 3 WHEN 'provisional' THEN 2 ELSE 1 END) AS r, count(*) AS observations, arg_max(artifact, (conv_id, turn)) FILTER (artifact IS NOT NULL) AS latest_artifact, arg_max(records, (conv_id, turn)) FILTER (records IS NOT NULL) AS latest_records FROM o GROUP BY 1)
SELECT contract, CASE r WHEN 4 THEN 'production' WHEN 3 THEN 'validated' WHEN 2 THEN 'provisional' ELSE 'candidate' END AS status, observations, latest_artifact, latest_records FROM m""")
def research_summary(spark, sf):
    """Contracts of a log of observations: merged status and the last of each value that isn't null."""
    turn = F.col("turn")
    status = F.when(turn % 7 == 6, "production").when(turn % 5 == 4, "rejected").when(F.col("role") == "assistant", "provisional").otherwise("candidate")
    o = read(spark, sf, "conversations").select(F.concat(F.lit("c"), (F.col("conv_id") % 20).cast("string")).alias("contract"), F.struct("conv_id", "turn").alias("ord"), status.alias("status"), F.when(turn % 3 == 0, F.concat(F.lit("a"), turn.cast("string"))).alias("artifact"), F.when(turn % 2 == 1, F.length("text").cast("long")).alias("records"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord")))
    return o.groupBy("contract").agg(merge_status(F.col("status")).alias("status"), F.count(F.lit(1)).alias("observations"), last("artifact").alias("latest_artifact"), last("records").alias("latest_records"))


def merge_atoms(atoms: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row of each key: the sites seen, the most trusted source (of equals the first), the first selector, and how many disagree."""
    trust = F.create_map(*[F.lit(x) for pair in SOURCE_TRUST.items() for x in pair])
    rank = F.struct(F.coalesce(F.try_element_at(trust, "source"), F.lit(0)).alias("r"), (-F.col(order)).alias("o"))
    merged = atoms.groupBy(*key).agg(F.array_sort(F.collect_set("domain")).alias("domains"), F.max_by("source", rank).alias("source"), F.min_by("selector", order).alias("selector"), F.countDistinct("selector").alias("selectors"))
    return merged.withColumn("conflict", F.col("selectors") > 1)


_ATOMS = """atoms AS (SELECT page_id, 's1:' || (page_id % 7) AS page_shape, 'r' || (page_id % 3) AS region, 'f' || (page_id % 5) AS field, 's' || (page_id % 2) AS selector, ['verified', 'manual', 'llm', 'fingerprint'][page_id % 4 + 1] AS source, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS domain FROM pages)"""


def atoms(spark, sf) -> DataFrame:
    p, text = F.col("page_id"), lambda a, n: F.concat(F.lit(a), (F.col("page_id") % n).cast("string"))
    sources = F.array(*[F.lit(s) for s in SOURCE_TRUST])
    return read(spark, sf, "pages").select("page_id", text("s1:", 7).alias("page_shape"), text("r", 3).alias("region"), text("f", 5).alias("field"), text("s", 2).alias("selector"), F.element_at(sources, (p % 4 + 1).cast("int")).alias("source"), F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("domain"))


@query("atoms_merge", f"""WITH {_ATOMS}, k AS (SELECT *, CASE source WHEN 'verified' THEN 3 WHEN 'fingerprint' THEN 1 ELSE 2 END AS r FROM atoms)
SELECT page_shape, region, field, array_to_string(list_sort(list(DISTINCT domain)), ',') AS domains, arg_max(source, (r, -page_id)) AS source, arg_min(selector, page_id) AS selector, count(DISTINCT selector) > 1 AS conflict FROM k GROUP BY 1, 2, 3""")
def atoms_merge(spark, sf):
    return merge_atoms(atoms(spark, sf), ["page_shape", "region", "field"], "page_id").select("page_shape", "region", "field", F.array_join("domains", ",").alias("domains"), "source", "selector", "conflict")


def resolve_atoms(requested: DataFrame, found: DataFrame, allowed: tuple[str, ...] | None = None) -> DataFrame:
    """page_shape, field, n, verdict: a hit if exactly one region of the shape has the field; thin shapes always miss."""
    able = found.filter(F.col("source").isin(*allowed)) if allowed else found
    n = able.filter(~F.col("page_shape").endswith(":degenerate")).groupBy("page_shape", "field").agg(F.countDistinct("region").alias("n"))
    joined = requested.join(n, ["page_shape", "field"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return joined.withColumn("verdict", F.when(F.col("n") == 1, "hit").when(F.col("n") == 0, "miss").otherwise("ambiguous"))


@query("atom_resolve", f"""WITH {_ATOMS}, req AS (SELECT DISTINCT page_shape, 'f' || (page_id % 6) AS field FROM atoms), n AS (SELECT page_shape, field, count(DISTINCT region) AS n FROM atoms WHERE source <> 'fingerprint' GROUP BY 1, 2)
SELECT page_shape, field, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN 'hit' WHEN n IS NULL THEN 'miss' ELSE 'ambiguous' END AS verdict FROM req LEFT JOIN n USING (page_shape, field)""")
def atom_resolve(spark, sf):
    a = atoms(spark, sf)
    asked = a.select("page_shape", F.concat(F.lit("f"), (F.col("page_id") % 6).cast("string")).alias("field")).distinct()
    return resolve_atoms(asked, a, ("verified", "manual", "llm"))


@query("cached_fields", """WITH f AS (SELECT DISTINCT c_nationkey AS field FROM customer), s AS (SELECT DISTINCT s_nationkey AS field FROM supplier) SELECT n_name AS name, CASE WHEN n_nationkey IN (SELECT field FROM s) THEN 'fresh' ELSE 'missing' END AS state FROM nation WHERE n_nationkey IN (SELECT field FROM f)""")
def cached_fields(spark, sf):
    """Wanted fields with a snapshot, by a semi join, and those without, by an anti join."""
    wanted = read(spark, sf, "nation").join(read(spark, sf, "customer"), F.col("n_nationkey") == F.col("c_nationkey"), "left_semi")
    have = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("have"))
    parts = [wanted.join(have, F.col("n_nationkey") == F.col("have"), how).select(F.col("n_name").alias("name"), F.lit(state).alias("state")) for how, state in (("left_semi", "fresh"), ("left_anti", "missing"))]
    return parts[0].unionByName(parts[1])


@query("snapshot_fields", "SELECT c_custkey AS snapshot, n_name AS field_name, c_mktsegment AS status FROM customer LEFT JOIN nation ON c_nationkey * 2 = n_nationkey")
def snapshot_fields(spark, sf):
    """Snapshots with the field they belong to, if it is known."""
    fields = read(spark, sf, "nation")
    return read(spark, sf, "customer").join(fields, F.col("c_nationkey") * 2 == F.col("n_nationkey"), "left").select(F.col("c_custkey").alias("snapshot"), F.col("n_name").alias("field_name"), F.col("c_mktsegment").alias("status"))
