"""Structured data of pages and payloads: values at paths through JSON-LD, types, and where objects stand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import structured as S
from ..sources.html import with_nodes
from ._registry import read, registry

QUERIES, SQL, query = registry()


def json_ld(parsed_pages: DataFrame, path: str, id: str = "page_id") -> DataFrame:
    """id, place, value: what a path leads to in the JSON-LD scripts of pages with ``nodes``, in order, from 1."""
    found = S.path_values(S.parsed(S.ld_texts(F.col("nodes"))), path)
    return parsed_pages.select(id, F.posexplode(found).alias("place", "v")).select(id, (F.col("place") + 1).alias("place"), S.as_text(F.col("v")).alias("value"))


_NAV = r"""regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<li><a href="([^"]*)">[^<]*</a></li>', 1)"""


def described(pages: DataFrame) -> DataFrame:
    """``pages`` with three scripts that say in JSON-LD what their navigation lists: as a list in an object, as a bare list, and damaged."""
    links = F.regexp_extract_all(F.regexp_extract("html", "<nav>(.*?)</nav>", 1), F.lit('<li><a href="([^"]*)">[^<]*</a></li>'), F.lit(1))
    item = lambda x, i: F.struct(F.lit("ListItem").alias("@type"), (i + 1).alias("position"), F.struct(x.alias("url"), F.array(F.lit("WebPage"), F.lit("Thing")).alias("@type")).alias("item"))
    whole = F.to_json(F.struct(F.lit("ItemList").alias("@type"), F.transform(links, item).alias("itemListElement")))
    bare = F.to_json(F.transform(links, lambda x: F.struct(x.alias("url"))))
    script = lambda kind, body: F.concat(F.lit(f'<script type="{kind}">'), body, F.lit("</script>"))
    return pages.withColumn("html", F.concat("html", script("application/LD+JSON", whole), script("application/ld+json", F.concat(whole, F.lit("}"))), script("application/ld+json", bare), script("application/json", whole)))


@query("page_json_ld", f"SELECT page_id, unnest(u) AS value, generate_subscripts(u, 1)::INTEGER AS place FROM (SELECT page_id, {_NAV} AS u FROM pages)")
def page_json_ld(spark, sf):
    """The addresses in each page's structured data, script by script: those at ``itemListElement.*.item.url``."""
    return json_ld(with_nodes(described(read(spark, sf, "pages")).select("page_id", "html")), "itemListElement.*.item.url")


@query("page_schema_types", f"SELECT page_id, unnest(CASE WHEN len({_NAV}) > 0 THEN ['ItemList', 'ListItem', 'Thing', 'WebPage'] ELSE ['ItemList'] END) AS type FROM pages")
def page_schema_types(spark, sf):
    return with_nodes(described(read(spark, sf, "pages")).select("page_id", "html")).select("page_id", F.explode(S.ld_types(F.col("nodes"))).alias("type"))


@query("payload_paths", "SELECT conv_id, role AS value, count(*) AS n FROM conversations WHERE role IS NOT NULL GROUP BY 1, 2")
def payload_paths(spark, sf):
    """Roles in conversations told as one JSON text each: ``turns.*.role``."""
    turn = F.struct("turn", "role", "text")
    told = read(spark, sf, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(turn)).alias("turns"))).alias("body"))
    values = S.path_values(S.parsed(F.array("body")), "turns.*.role")
    return told.select("conv_id", F.explode(F.transform(values, S.as_text)).alias("value")).groupBy("conv_id", "value").agg(F.count(F.lit(1)).alias("n"))
