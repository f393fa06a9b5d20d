"""Sources and sinks as queries: URL lists, downloads, stringified tables, envelopes, digests, policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import formats, readers
from ._registry import read, registry

QUERIES, SQL, query = registry()


@query("urls_from_text", """WITH u AS (SELECT page_id, 'see ' || url || ', or (' || replace(url, 'http:', 'https:') || ').' AS t FROM pages), x AS (SELECT page_id, unnest(regexp_extract_all(t, 'https?://[^\\s<>"]+')) AS raw FROM u)
SELECT page_id, rtrim(raw, '.,;:!?)]}''"') AS url FROM x""")
def urls_from_text(spark, sf):
    text = F.concat(F.lit("see "), "url", F.lit(", or ("), F.replace("url", F.lit("http:"), F.lit("https:")), F.lit(")."))
    return read(spark, sf, "pages").select("page_id", F.explode(readers.urls_in_text(text)).alias("url"))


@query("urls_from_markdown", "SELECT page_id, unnest([url, 'https://other.test/a']) AS url, unnest([1, 2])::BIGINT AS place FROM pages")
def urls_from_markdown(spark, sf):
    """Targets of links first, then other URLs, each once."""
    text = F.concat(F.lit("bare https://other.test/a and [this]("), "url", F.lit(") again "), "url", F.lit(" end"))
    return read(spark, sf, "pages").select("page_id", F.posexplode(readers.urls_in_markdown(text)).alias("place", "url")).withColumn("place", F.col("place").cast("long") + 1)


@query("event_props", "SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY 1")
def event_props(spark, sf):
    """Downloads with JSON content, parsed by schema."""
    e = read(spark, sf, "events").withColumn("p", F.from_json("props", "k long"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("total"))


@query("output_stringified", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, coalesce(o_orderstatus, '') AS o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS o_custkey FROM orders")
def output_stringified(spark, sf):
    """What the text sinks write: every value a string, null an empty one."""
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("o_custkey"))
    return formats.stringified(o, null="")


@query("output_envelopes", """SELECT r_regionkey AS id, '{"url":"https://x.test/' || r_regionkey || '","items":[' || string_agg('{"name":"' || n_name || '","key":' || n_nationkey || '}', ',' ORDER BY n_nationkey) || '],"item_count":' || count(*) || '}' AS envelope FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1""")
def output_envelopes(spark, sf):
    """JSON envelopes of several records by page."""
    rows = read(spark, sf, "region").join(read(spark, sf, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_regionkey").alias("id"), F.concat(F.lit("https://x.test/"), F.col("r_regionkey").cast("string")).alias("url"), F.col("n_nationkey").alias("ord"), F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key")).alias("content"))
    return formats.envelopes(rows, ["id", "url"], "ord", "content").select("id", "envelope")


@query("output_markdown", "SELECT r_regionkey AS id, '# ' || r_name || chr(10) || chr(10) || '## key' || chr(10) || chr(10) || r_regionkey AS markdown FROM region")
def output_markdown(spark, sf):
    r = read(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("title"), F.col("r_regionkey").alias("key"), F.lit(None).cast("string").alias("note"))
    return r.select("id", formats.markdown("title", ["key", "note"]).alias("markdown"))


@query("file_gate", """SELECT n_nationkey AS id, ['pdf', 'png', 'gzip', 'json', NULL][n_nationkey % 5 + 1] AS kind, n_nationkey % 5 IN (0, 3) AS allowed FROM nation""")
def file_gate(spark, sf):
    """Kinds of downloads by their first bytes, else by their text; only listed kinds pass."""
    k = F.col("n_nationkey") % 5
    data = F.when(k == 0, F.to_binary(F.lit("255044462d312e37"), F.lit("hex"))).when(k == 1, F.to_binary(F.lit("89504e470d0a1a0a00"), F.lit("hex"))).when(k == 2, F.to_binary(F.lit("1f8b0800"), F.lit("hex"))).when(k == 3, F.encode(F.lit(' {"a": 1}'), "utf-8")).otherwise(F.encode(F.lit("plain words"), "utf-8"))
    kind = formats.file_kind(data)
    return read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), kind.alias("kind"), formats.is_allowed(kind, ("pdf", "json")).alias("allowed"))


@query("policy_cascade", "SELECT n_nationkey AS id, coalesce(CASE WHEN n_nationkey % 7 = 0 THEN 1 END, CASE WHEN n_nationkey % 3 = 0 THEN 2 END, CASE WHEN n_nationkey % 2 = 0 THEN 3 END, 9) AS pages FROM nation")
def policy_cascade(spark, sf):
    """The call's setting, else the contract's, else the session's, else the default."""
    k = F.col("n_nationkey")
    return read(spark, sf, "nation").select(k.alias("id"), F.coalesce(F.when(k % 7 == 0, 1), F.when(k % 3 == 0, 2), F.when(k % 2 == 0, 3), F.lit(9)).alias("pages"))


@query("search_results", "SELECT n_regionkey AS query, n_name AS title, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rank FROM nation WHERE n_nationkey % 6 <> 5")
def search_results(spark, sf):
    """Results of a search provider, ranked; rows without a URL are errors and go elsewhere."""
    from pyspark.sql import Window

    n = read(spark, sf, "nation").withColumn("url", F.when(F.col("n_nationkey") % 6 != 5, F.concat(F.lit("https://x.test/"), "n_name")))
    good = n.filter("url IS NOT NULL")
    return good.select(F.col("n_regionkey").alias("query"), F.col("n_name").alias("title"), F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")).cast("long").alias("rank"))


@query("scrape_units", "SELECT page_id, contract FROM pages, (VALUES ('NewsArticle'), ('Product')) AS c(contract)")
def scrape_units(spark, sf):
    """Every page with every contract; contracts are a fixed list, exploded beside each page."""
    return read(spark, sf, "pages").select("page_id", F.explode(F.array(F.lit("NewsArticle"), F.lit("Product"))).alias("contract"))
