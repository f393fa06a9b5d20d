"""Request traces: templates and classes, endpoint groups, modes, rarity. The queries read ``events`` as requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..scratch import written
from ._registry import read, registry

QUERIES, SQL, query = registry()

# What makes a request rare, in order of precedence.
RARITY = ("status_not_success", "response_shape_deviates", "problem_mime", "mime_deviates", "item_count_deviates", "singleton_template")


def requests(spark, sf) -> DataFrame:
    """request_id, method, origin, path, query, status, mime, items, shape, ms of the events table."""
    k, kind = F.get_json_object("props", "$.k").cast("long"), F.col("event_type")
    text = lambda c: c.cast("string")
    return read(spark, sf, "events").select(
        F.col("event_id").alias("request_id"),
        F.when(kind.isin("purchase", "signup"), "POST").otherwise("GET").alias("method"),
        F.concat(F.lit("https://api"), text(F.col("user_id") % 5), F.lit(".test")).alias("origin"),
        F.concat(F.lit("/v1/"), kind, F.lit("/"), text(F.col("user_id"))).alias("path"),
        F.concat(F.lit("k="), text(k), F.lit("&tag="), kind, F.lit("&empty=")).alias("query"),
        F.when(kind == "error", F.when(k % 2 == 0, 500).otherwise(404)).otherwise(200).alias("status"),
        F.when((kind == "error") & (k % 3 == 0), "application/problem+json").when(k % 11 == 0, "text/html").otherwise("application/json").alias("mime"),
        (k % 4).alias("items"),
        F.concat(F.lit("sh"), text(k % 3)).alias("shape"),
        (F.col("value") * 10).alias("ms"),
    )


_REQ = """req AS (SELECT event_id AS request_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method, 'https://api' || (user_id % 5) || '.test' AS origin, '/v1/' || event_type || '/{id}' AS template,
  CASE WHEN event_type = 'error' THEN CASE WHEN k % 2 = 0 THEN 500 ELSE 404 END ELSE 200 END AS status, CASE WHEN event_type = 'error' AND k % 3 = 0 THEN 'application/problem+json' WHEN k % 11 = 0 THEN 'text/html' ELSE 'application/json' END AS mime,
  k % 4 AS items, 'sh' || (k % 3) AS shape, value * 10 AS ms FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def templated(found: DataFrame) -> DataFrame:
    return found.withColumn("template", V.path_template(F.col("path")))


@query("request_templates", f"""WITH {_REQ} SELECT request_id, template, 'empty:empty,k:id,tag:enum' AS params, CASE WHEN ms < 0 OR ms IS NULL THEN 'unknown' WHEN ms < 50 THEN 'instant' WHEN ms < 200 THEN 'fast' WHEN ms < 1000 THEN 'moderate' WHEN ms < 3000 THEN 'slow' ELSE 'very_slow' END AS timing FROM req""")
def request_templates(spark, sf):
    """Paths and parameters by the classes of their values."""
    params = F.array_join(F.transform(V.classed_params(F.col("query")), lambda p: F.concat_ws(":", p["name"], p["value_class"])), ",")
    return templated(requests(spark, sf)).select("request_id", "template", params.alias("params"), V.timing_bucket(F.col("ms")).alias("timing"))


@query("value_classes", """WITH v AS (SELECT user_id, event_type, unnest([event_type, CAST(user_id AS VARCHAR), '', strftime(ts, '%Y-%m-%d'), event_type || ' !']) AS value FROM events)
SELECT event_type, CASE WHEN value = '' THEN 'empty' WHEN regexp_matches(value, '^[0-9]{4}-') THEN 'timestamp' WHEN regexp_matches(value, '^[0-9]+$') THEN 'id' WHEN value LIKE '% !' THEN 'opaque' ELSE 'enum' END AS value_class, count(*) AS n FROM v GROUP BY 1, 2""")
def value_classes(spark, sf):
    e = read(spark, sf, "events").select("event_type", F.explode(F.array("event_type", F.col("user_id").cast("string"), F.lit(""), F.date_format("ts", "yyyy-MM-dd"), F.concat("event_type", F.lit(" !")))).alias("value"))
    return e.groupBy("event_type", V.value_class(F.col("value")).alias("value_class")).agg(F.count(F.lit(1)).alias("n"))


def endpoint_groups(found: DataFrame) -> DataFrame:
    """Requests by origin, method and template, in the order in which each first appears."""
    return found.groupBy("origin", "method", "template").agg(F.min("request_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("status")).alias("statuses"), F.countDistinct("shape").alias("shapes"))


@query("request_groups", f"WITH {_REQ} SELECT origin, method, template, min(request_id) AS first_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT status)), ',') AS statuses, count(DISTINCT shape) AS shapes FROM req GROUP BY 1, 2, 3")
def request_groups(spark, sf):
    return endpoint_groups(templated(requests(spark, sf))).withColumn("statuses", F.array_join("statuses", ","))


def modes(rows: DataFrame, names: list[str], scope: tuple[str, ...] = ()) -> DataFrame:
    """(scope, name, value): the most frequent value of each column, ties by the text; counted in one pass over all columns."""
    long = rows.select(*scope, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in names])).alias("x")).select(*scope, "x.*")
    counted = long.filter("value IS NOT NULL").groupBy(*scope, "name", "value").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*scope, "name").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("m")).select(*scope, "name", F.col("m.value").alias("value"))


@query("modal_defaults", f"""WITH {_REQ}, l AS (SELECT unnest(['method', 'status', 'mime', 'shape', 'template']) AS name, unnest([method, CAST(status AS VARCHAR), mime, shape, template]) AS value FROM req), c AS (SELECT name, value, count(*) AS n FROM l GROUP BY 1, 2)
SELECT name, value FROM c QUALIFY row_number() OVER (PARTITION BY name ORDER BY n DESC, value) = 1""")
def modal_defaults(spark, sf):
    return modes(templated(requests(spark, sf)), ["method", "status", "mime", "shape", "template"])


def rarity(found: DataFrame, group: tuple[str, ...] = ("origin", "method", "template")) -> DataFrame:
    """Adds a boolean for each reason of RARITY; deviations are from the mode of the request's own group.

    Requests are counted once by group and the values that can deviate; modes and sizes come from those few rows.
    """
    names = ("shape", "mime", "items")
    counted = written(found.groupBy(*group, *names).agg(F.count(F.lit(1)).alias("n")), "request-counts")
    votes = counted.select(*group, "n", F.explode(F.array(*[F.struct(F.lit(x).alias("name"), F.col(x).cast("string").alias("value")) for x in names])).alias("x"))
    votes = votes.filter("x.value IS NOT NULL").groupBy(*group, "x.name", "x.value").agg(F.sum("n").alias("n"))
    best = lambda x: F.min(F.when(F.col("name") == x, F.struct((-F.col("n")).alias("n"), "value")))["value"].alias(f"usual_{x}")
    usual = votes.groupBy(*group).agg(*map(best, names))
    sizes = counted.groupBy(*group).agg(F.sum("n").alias("group_size"))
    once = counted.groupBy("template").agg(F.sum("n").alias("template_size"))
    facts = sizes.join(usual, list(group), "left").join(once, "template")
    joined = found.join(facts, list(group))
    differs = lambda n: F.coalesce((F.col("group_size") > 1) & (F.col(n).cast("string") != F.col(f"usual_{n}")), F.lit(False))
    reasons = [F.coalesce(~(F.col("status").between(200, 399)), F.lit(True)), differs("shape"), F.coalesce(F.col("mime") == "application/problem+json", F.lit(False)), differs("mime"), differs("items"), F.col("template_size") == 1]
    return joined.withColumns(dict(zip(RARITY, reasons)))


def rank_key() -> Column:
    """Sorts lexicographically: an earlier reason outranks all later ones."""
    return F.concat(*[F.when(F.col(r), "0").otherwise("1") for r in RARITY])


_RARE = f"""{_REQ}, sz AS (SELECT origin, method, template, count(*) AS group_size FROM req GROUP BY 1, 2, 3), ts AS (SELECT template, count(*) AS template_size FROM req GROUP BY 1),
ms AS (SELECT origin, method, template, shape AS usual_shape FROM (SELECT origin, method, template, shape, count(*) AS n FROM req GROUP BY 1, 2, 3, 4) QUALIFY row_number() OVER (PARTITION BY origin, method, template ORDER BY n DESC, shape) = 1),
mm AS (SELECT origin, method, template, mime AS usual_mime FROM (SELECT origin, method, template, mime, count(*) AS n FROM req GROUP BY 1, 2, 3, 4) QUALIFY row_number() OVER (PARTITION BY origin, method, template ORDER BY n DESC, mime) = 1),
mi AS (SELECT origin, method, template, items AS usual_items FROM (SELECT origin, method, template, items, count(*) AS n FROM req GROUP BY 1, 2, 3, 4) QUALIFY row_number() OVER (PARTITION BY origin, method, template ORDER BY n DESC, CAST(items AS VARCHAR)) = 1),
rare AS (SELECT req.*, CASE WHEN status NOT BETWEEN 200 AND 399 THEN '0' ELSE '1' END || CASE WHEN group_size > 1 AND shape <> usual_shape THEN '0' ELSE '1' END || CASE WHEN mime = 'application/problem+json' THEN '0' ELSE '1' END ||
  CASE WHEN group_size > 1 AND mime <> usual_mime THEN '0' ELSE '1' END || CASE WHEN group_size > 1 AND items <> usual_items THEN '0' ELSE '1' END || CASE WHEN template_size = 1 THEN '0' ELSE '1' END AS rank, group_size
  FROM req JOIN sz USING (origin, method, template) JOIN ts USING (template) JOIN ms USING (origin, method, template) JOIN mm USING (origin, method, template) JOIN mi USING (origin, method, template))"""


@query("rarity_rank", f"WITH {_RARE} SELECT request_id, rank FROM rare")
def rarity_rank(spark, sf):
    return rarity(templated(requests(spark, sf))).select("request_id", rank_key().alias("rank"))


@query("rare_groups", f"WITH {_RARE} SELECT origin, method, template, min(rank) AS rank, count(*) FILTER (group_size > 1 AND contains(rank, '0')) AS deviants FROM rare GROUP BY 1, 2, 3")
def rare_groups(spark, sf):
    """Groups by their rarest member; a group of one has no deviants."""
    r = rarity(templated(requests(spark, sf))).withColumn("rank", rank_key())
    return r.groupBy("origin", "method", "template").agg(F.min("rank").alias("rank"), F.count_if((F.col("group_size") > 1) & F.col("rank").contains("0")).alias("deviants"))


def duplicate_key(*parts: Column) -> Column:
    """Equal for requests that ask for the same; only equality matters."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


@query("duplicate_key_groups", f"WITH {_REQ}, d AS (SELECT substr(sha256(method || '|' || origin || '|' || template), 1, 16) AS key, request_id FROM req) SELECT key, count(*) AS n, min(request_id) AS first_id FROM d GROUP BY 1 HAVING count(*) > 1")
def duplicate_key_groups(spark, sf):
    found = templated(requests(spark, sf)).withColumn("key", duplicate_key(F.col("method"), F.col("origin"), F.col("template")))
    return found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("request_id").alias("first_id")).filter("n > 1")
