"""Views of a page: Markdown, what kind of content it is, all that it links to, and the view that is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..functions.trees import inline_texts
from ..plans.contract import keep_first
from ..scratch import written
from ..sources.html import cleaned, let, texts, visible_text, with_nodes
from ._registry import read, registry
from .crawl import onclick_links, robots_sitemaps
from .pages import links, with_title

QUERIES, SQL, query = registry()

# What a block of each tag begins with; tags within a line, and those that make a line of their own; the longest
# line of its own; how many blocks back an equal one is dropped; the least share of the text, and of its words, that blocks hold.
HEADINGS = {"h1": "## ", "h2": "## ", "h3": "### ", "h4": "#### ", "h5": "##### ", "h6": "###### "}
INLINE_TAGS = ("a", "b", "button", "em", "span", "strong")
BLOCK_TAGS = ("blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "li", "p", "pre", "td", "th", "tr")
LONGEST_LEAF, LOOK_BACK, LEAST_SHARE, LEAST_WORDS = 120, 3, 0.6, 0.8
CURRENCIES = "[$€£]"


def _tables(rows: DataFrame, id: str) -> DataFrame:
    """id, pre, table: each table that has cells as Markdown; rows of tables within it are its rows, too."""
    cells = rows.filter(F.col("tag").isin("td", "th") & (F.col("plain") != "")).select(id, F.col("parent").alias("tr"), F.struct("pre", "plain").alias("cell"))
    lines = rows.filter("tag = 'tr'").select(id, F.col("pre").alias("tr")).join(cells, [id, "tr"]).groupBy(id, "tr").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    tables = rows.filter("tag = 'table'").select(F.col(id).alias("__id"), F.col("pre").alias("table"), F.col("last").alias("end"))
    met = lines.join(tables, (F.col(id) == F.col("__id")) & (F.col("tr") > F.col("table")) & (F.col("tr") <= F.col("end")))
    each = met.groupBy(id, "table").agg(F.array_sort(F.collect_list(F.struct("tr", F.col("cells.plain").alias("cells")))).alias("rows")).withColumn("width", F.array_max(F.transform("rows", lambda r: F.size(r["cells"]))))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    padded = lambda r: F.concat(r["cells"], F.array_repeat(F.lit(""), F.col("width") - F.size(r["cells"])))
    made = F.transform("rows", lambda r: line(padded(r)))
    return each.select(id, F.col("table").alias("pre"), F.array_join(F.concat(F.slice(made, 1, 1), F.array(line(F.array_repeat(F.lit("---"), F.col("width")))), F.slice(made, 2, F.greatest(F.size("rows") - 1, F.lit(0)))), "\n").alias("table"))


def blocks(parsed: DataFrame, id: str = "page_id") -> DataFrame:
    """id, pre, block of pages with ``nodes`` and ``url``: headings, items, quotes, code, tables, paragraphs, and inline elements that stand
    alone, in document order. Elements within a table give none but tables; nested blocks give one each."""
    each = parsed.select(id, F.col("nodes"), inline_texts(F.col("nodes"), F.col("url")).alias("inline")).select(id, F.explode(F.arrays_zip("nodes", "inline")).alias("x"))
    rows = written(each.select(id, "x.nodes.pre", "x.nodes.parent", "x.nodes.last", "x.nodes.tag", "x.inline.linked", "x.inline.plain").filter("tag <> '#text'"), "inline-texts")
    # a tag is open around an element if the furthest end of those before it is not before the element
    w = Window.partitionBy(id).orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    within = lambda tags: F.coalesce(F.max(F.when(F.col("tag").isin(*tags), F.col("last"))).over(w) >= F.col("pre"), F.lit(False))
    placed = rows.withColumns({"in_table": within(("table",)), "in_inline": within(INLINE_TAGS), "in_block": within(BLOCK_TAGS)})
    mixed = rows.filter(~F.col("tag").isin(*INLINE_TAGS)).select(id, F.col("parent").alias("pre")).distinct().withColumn("mixed", F.lit(True))
    placed = placed.join(mixed, [id, "pre"], "left").join(_tables(rows, id), [id, "pre"], "left")
    leaf = F.col("tag").isin(*INLINE_TAGS) & ~F.col("in_inline") & ~F.col("in_block") & F.col("mixed").isNull() & (F.length("plain") <= LONGEST_LEAF)
    text = F.col("linked")
    out = F.when((text == "") | (F.col("in_table") & (F.col("tag") != "table")), F.lit(None))
    for tag, mark in HEADINGS.items():
        out = out.when(F.col("tag") == tag, F.concat(F.lit(mark), text))
    out = out.when(F.col("tag") == "li", F.concat(F.lit("- "), text)).when(F.col("tag") == "blockquote", F.concat(F.lit("> "), text)).when(F.col("tag") == "pre", F.concat(F.lit("```\n"), text, F.lit("\n```")))
    out = out.when(F.col("tag") == "table", F.col("table")).when(F.col("tag") == "p", text).when(leaf, F.concat(F.lit("- "), text))
    return placed.select(id, "pre", out.alias("block")).filter("block IS NOT NULL")


def body_or_text(found: Column, text: Column) -> Column:
    """The blocks, without those that equal one of the last three kept; the text where they hold too little of it; both where they
    lack many of its words, or a price."""
    start = F.array().cast("array<string>")
    kept = F.aggregate(found, start, lambda s, b: F.when(F.array_contains(F.slice(F.reverse(s), 1, LOOK_BACK), b), s).otherwise(F.concat(s, F.array(b))))
    words = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"(?U)[$\w][\w$+.-]*"), F.lit(0)))

    def judged(body, said):
        own, all_ = words(said), words(text)
        share = F.when(F.size(all_) == 0, 1.0).otherwise(F.size(F.array_intersect(all_, own)) / F.size(all_))
        prices = F.size(F.array_except(F.filter(all_, lambda x: x.rlike(CURRENCIES)), own)) == 0
        little = (body == "") | (F.length(said) < F.length(text) * LEAST_SHARE)
        return F.when(little, text).when((share < LEAST_WORDS) | ~prices, F.concat(body, F.lit("\n\n## Extracted Text\n\n"), text)).otherwise(body)

    return let(F.array_join(kept, "\n\n"), lambda body: let(F.trim(F.regexp_replace(body, r"(?U)[#>`|*\-\s]+", " ")), lambda said: judged(body, said)))


def with_markdown(pages: DataFrame, id: str = "page_id") -> DataFrame:
    """``pages`` with ``title``, ``text`` and ``markdown``: a document with the title, or else the address, and the blocks."""
    parsed = with_nodes(pages)
    views = written(with_title(parsed).withColumn("text", visible_text(F.col("nodes"))).select(*pages.columns, "title", "text"), "page-texts")
    found = blocks(parsed.select(id, "url", "nodes"), id).groupBy(id).agg(F.transform(F.array_sort(F.collect_list(F.struct("pre", "block"))), lambda b: b["block"]).alias("found"))
    joined = views.join(found, id, "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    body = F.when(F.col("text") == "", F.lit("")).otherwise(body_or_text(F.col("found"), F.col("text")))
    document = F.concat(F.lit("# "), F.coalesce("title", "url", F.lit("")), F.lit("\n\nSource: "), F.coalesce("url", F.lit("")), F.lit("\n\n"), body)
    return joined.withColumn("markdown", F.concat(F.regexp_replace(document, r"(?U)\s+$", ""), F.lit("\n"))).drop("found")


@query("page_markdown")
def page_markdown(spark, sf):
    return with_markdown(read(spark, sf, "pages")).select("page_id", "markdown")


# Marks of feeds near the top; marks of what builds pages in the browser, in this order; marks of gates near the top; words of
# pages that are still loading; how much of a page is looked at for gates and for shells; how little text a shell shows.
FEED_MARKS = ("<?xml", "<rss", "<feed", "<channel>", 'xmlns="http://www.w3.org/2005/atom"', 'xmlns="http://purl.org/rss/1.0/"')
FRAMEWORKS = {
    "react": ('id="root"', 'id="app"', "data-reactroot", "react-root", "__react"), "vue": ('id="app"', "v-if=", "v-for=", "vue.js", "__vue"), "angular": ("ng-app", "ng-controller", "angular.js", "ng-version"),
    "next": ("__next", "_next/static", "next.js"), "svelte": ("svelte", "__svelte"), "astro": ("<astro-island", "data-fw="),
}
GATE_MARKS = (
    "ak_bmsc", "bm_sz", "_abck", "akam-sw", "behavioral-content", "akamai-protected", "akamai_edge", "just a moment", "checking your browser", "cf-browser-verification", "challenge-platform",
    "please enable javascript", "javascript is required", "javascript is disabled", "enable javascript to continue", "requires javascript to function", "px-captcha", "_pxparam", "incap_ses", "visid_incap", "_utmz",
    "datadome.js", "captcha-delivery.com", "ddcid", "dd_cookie", "ddjskey", "ddoptions",
)
LOADING_MARKS = ("loading...", "loading article", "loading content", "please wait")
FEED_CHARS, GATE_CHARS, SHELL_CHARS, SHELL_LEAST, SHELL_TEXT, SHELL_SHARE, MINIMAL = 500, 3_000, 50_000, 5_000, 500, 0.02, 100


def any_of(text: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | text.contains(m)
    return out


def with_content_kind(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with content_length, content_type, requires_js and js_framework: whether a page is a feed, or needs a browser and why: a
    framework with little content, a notice, a loading mark, islands that wait; a gate; or a shell that shows hardly any text."""
    page = F.coalesce(F.col(html), F.lit(""))
    low = F.lower(page)
    body = F.regexp_extract(low, r"(?s)<body[^>]*>(.*?)</body>", 1)
    has_body = low.rlike(r"(?s)<body[^>]*>(.*?)</body>")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"(?s)<script[^>]*>.*?</script>", ""), r"(?s)<style[^>]*>.*?</style>", ""), r"(?U)^\s+|\s+$", "")
    islands = low.contains("<astro-island") & low.contains("data-fw=")
    framework = F.when(islands, "astro")
    for name, marks in FRAMEWORKS.items():
        framework = framework.when(any_of(low, marks), name)
    shown = F.trim(F.regexp_replace(F.regexp_replace(body, "<[^>]+>", " "), r"(?U)\s+", " "))
    notice = low.contains("<noscript>") & (low.contains("enable javascript") | low.contains("requires javascript"))
    heavy = (framework.isNotNull() & has_body & (F.length(bare) < MINIMAL)) | notice | (framework.isNotNull() & any_of(shown, LOADING_MARKS)) | islands
    gate = any_of(F.substring(low, 1, GATE_CHARS), GATE_MARKS)
    head = with_nodes(pages.withColumn("__head", F.substring(page, 1, SHELL_CHARS)), "__head", "__nodes")
    silent = F.col("__silent")
    head = head.withColumn("__silent", F.transform(F.filter("__nodes", lambda n: n["tag"].isin("script", "style", "noscript")), lambda n: F.struct(n["pre"].alias("pre"), n["last"].alias("last"))))
    said = F.array_join(F.transform(F.filter("__nodes", lambda n: (n["tag"] == "#text") & ~F.exists(silent, lambda s: (n["pre"] > s["pre"]) & (n["pre"] <= s["last"]))), lambda n: n["text"]), " ")
    head = head.withColumn("__said", F.length(F.regexp_replace(said, r"(?U)^\s+|\s+$", "")))
    shell = (F.length(page) > SHELL_LEAST) & ((F.col("__said") < SHELL_TEXT) | (F.col("__said") < F.length(page) * SHELL_SHARE))
    feed = any_of(F.substring(low, 1, FEED_CHARS), FEED_MARKS)
    reasons = F.when(feed, F.lit(None)).when(heavy, F.coalesce(framework, F.lit(""))).when(gate, "bot-gate").when(framework.isNull() & shell, "js-shell")
    out = head.withColumns({"content_length": F.length(page), "content_type": F.when(feed, "rss").otherwise("html"), "requires_js": ~feed & (heavy | gate | (framework.isNull() & shell)), "js_framework": F.when(feed, F.lit(None)).otherwise(F.coalesce(F.nullif(reasons, F.lit("")), framework))})
    return out.drop("__head", "__nodes", "__silent", "__said")


@query("content_kinds", """SELECT page_id, length(html)::INTEGER AS content_length, CASE WHEN contains(lower(substr(html, 1, 500)), '<?xml') OR contains(lower(substr(html, 1, 500)), '<rss') THEN 'rss' ELSE 'html' END AS content_type,
  contains(lower(html), 'id="root"') AND contains(lower(html), 'loading...') OR contains(lower(substr(html, 1, 3000)), 'just a moment') AS requires_js,
  CASE WHEN contains(lower(html), 'id="root"') THEN 'react' WHEN contains(lower(html), 'ng-app') THEN 'angular' WHEN contains(lower(substr(html, 1, 3000)), 'just a moment') THEN 'bot-gate' END AS js_framework FROM pages""")
def content_kinds(spark, sf):
    return with_content_kind(read(spark, sf, "pages")).select("page_id", "content_length", "content_type", "requires_js", "js_framework")


def absolute(href: Column, page: Column) -> Column:
    """``href`` as seen from a page's address."""
    base = F.concat(U.part(page, "scheme"), F.lit("://"), U.part(page, "host"))
    folder = F.regexp_replace(U.part(page, "path"), "[^/]*$", "")
    return F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(U.part(page, "scheme"), F.lit(":"), href)).when(href.startswith("/"), F.concat(base, href)).otherwise(F.concat(base, F.when(folder == "", F.lit("/")).otherwise(folder), href))


def looks_like_feed(html: Column) -> Column:
    head = F.lower(F.substring(F.ltrim(F.regexp_replace(html, r"^\s+", "")), 1, 500))
    return head.startswith("<?xml") | any_of(head, ("<urlset", "<sitemapindex", "<rss", "<feed"))


def feed_links(html: Column) -> Column:
    """array<struct<href, text>>: locations and links of a feed or sitemap with the title of what they belong to."""
    unescaped = lambda x: F.replace(F.replace(F.replace(x, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    pieces = F.split(html, r"(?i)(?=<(?:[\w-]+:)?(?:item|entry|url|sitemap|channel)[\s>])")
    title = lambda p: T.collapse(unescaped(F.regexp_replace(F.regexp_extract(p, r"(?is)<(?:[\w-]+:)?title[^>]*>(?:\s*<!\[CDATA\[)?(.*?)(?:\]\]>\s*)?</(?:[\w-]+:)?title>", 1), "<[^>]+>", "")))
    found = lambda p: F.arrays_zip(F.regexp_extract_all(p, F.lit(r"(?is)<(?:[\w-]+:)?(?:loc|link)\b([^>]*?)(?:/>|>(.*?)</(?:[\w-]+:)?(?:loc|link)>)"), 1).alias("attrs"), F.regexp_extract_all(p, F.lit(r"(?is)<(?:[\w-]+:)?(?:loc|link)\b([^>]*?)(?:/>|>(.*?)</(?:[\w-]+:)?(?:loc|link)>)"), 2).alias("text"))
    href = lambda f: F.coalesce(F.nullif(F.regexp_extract(f["attrs"], r"(?i)\bhref\s*=\s*[\"']([^\"']*)", 1), F.lit("")), F.regexp_replace(F.regexp_replace(f["text"], r"<!\[CDATA\[|\]\]>", ""), r"(?U)^\s+|\s+$", ""))
    return F.flatten(F.transform(pieces, lambda p: F.transform(found(p), lambda f: F.struct(unescaped(href(f)).alias("href"), title(p).alias("text")))))


def all_links(pages: DataFrame, allowed_hosts: tuple[str, ...] | None = None, id: str = "page_id") -> DataFrame:
    """id, ord, link, text, score, source: what a page links to, each canonical address once, in order: the entries of a feed; else the sitemaps of
    a robots file; else the anchors, then what scripts open on a click. Without ``allowed_hosts`` every host counts."""
    pages = pages.select(id, "url", "html").filter("html IS NOT NULL")
    feeds, others = pages.filter(looks_like_feed(F.col("html"))), pages.filter(~looks_like_feed(F.col("html")))
    told = feeds.select(id, "url", F.posexplode(feed_links(F.col("html"))).alias("ord", "f")).select(id, F.col("ord").cast("long").alias("ord"), absolute(F.col("f.href"), F.col("url")).alias("raw"), "f.text", F.lit("feed").alias("source")).filter("raw <> ''")
    lines = others.withColumn("maps", robots_sitemaps(F.col("html")))
    robots = lines.filter("size(maps) > 0").select(id, "url", F.posexplode("maps").alias("ord", "m")).select(id, F.col("ord").cast("long").alias("ord"), absolute(F.col("m"), F.col("url")).alias("raw"), F.lit("sitemap").alias("text"), F.lit("robots").alias("source"))
    plain = lines.filter("size(maps) = 0").select(id, "url", "html")
    anchors = links(plain.withColumnRenamed(id, "page_id")).select(F.col("page_id").alias(id), "ord", F.col("link").alias("raw"), "text", F.lit("anchor").alias("source"), F.col("score").alias("known"))
    opened = onclick_links(plain, id).withColumn("n", F.monotonically_increasing_id())
    places = F.row_number().over(Window.partitionBy(id).orderBy("n")).cast("long") + (1 << 40)
    clicks = opened.withColumn("ord", places).join(plain.select(id, "url"), id).select(id, "ord", absolute(F.col("link"), F.col("url")).alias("raw"), F.lit("").alias("text"), F.lit("script").alias("source"))
    rows = anchors
    for more in (told, robots, clicks):
        rows = rows.unionByName(more.withColumn("known", F.lit(None).cast("double")))
    whole = rows.withColumn("link", U.canonical(F.col("raw"))).filter("link IS NOT NULL")
    if allowed_hosts is not None:
        whole = whole.filter(U.part(F.col("link"), "host").isin(*allowed_hosts))
    first = keep_first(whole, [id, "link"], ["ord"])
    score = F.when(F.col("source") == "robots", 0.95).otherwise(F.coalesce("known", U.link_score(F.col("link"), F.col("text"))))
    return first.select(id, "ord", "link", "text", score.alias("score"), "source")


@query("page_all_links", r"""WITH u AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS base, regexp_extract_all(html, '<a href="([^"#]*)"', 1) AS h FROM pages), l AS (SELECT page_id, base || unnest(h) AS link FROM u)
SELECT page_id, 'anchor' AS source, count(DISTINCT link) AS n FROM l GROUP BY 1""")
def page_all_links(spark, sf):
    return all_links(read(spark, sf, "pages")).groupBy("page_id", "source").agg(F.count(F.lit(1)).alias("n"))


VIEWS = ("text", "markdown", "html", "clean_html", "raw_html", "links", "metadata")


def view(pages: DataFrame, kind: str) -> DataFrame:
    """page_id, content: one view of each page (page_id, url, html); links and metadata are JSON."""
    if kind not in VIEWS:
        raise ValueError(f"no such view: {kind!r}; there are {', '.join(VIEWS)}")
    if kind == "raw_html":
        return pages.select("page_id", F.col("html").alias("content"))
    if kind == "text":
        return with_nodes(pages.select("page_id", "html")).select("page_id", visible_text(F.col("nodes")).alias("content"))
    if kind == "markdown":
        return with_markdown(pages).select("page_id", F.col("markdown").alias("content"))
    if kind in ("html", "clean_html"):
        return with_nodes(pages.select("page_id", "html")).select("page_id", T.readable(F.array_join(texts(cleaned(F.col("nodes"))), " ")).alias("content"))
    if kind == "links":
        found = links(pages).groupBy("page_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("ord", F.col("link").alias("url"), "text")))).alias("content"))
        return pages.select("page_id").join(found, "page_id", "left").na.fill("[]", ["content"])
    told = with_title(with_nodes(with_content_kind(pages)))
    return told.select("page_id", F.to_json(F.struct("url", "title", "content_length", "content_type", "requires_js", "js_framework")).alias("content"))
