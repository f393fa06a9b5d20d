"""Markdown against a plain recursion over the page's tree, kinds of content, links of all sources, views."""

import json
import re
from urllib.parse import urljoin

import pytest

from pagespine.operators import compiled, views
from pagespine.sources import html

URL = "https://a.test/dir/page?x=1"
RICH = """<html><head><title> The  title </title></head><body><h1>Head <b>ing</b></h1><h2>Sub</h2><p>See <a href="/x">this <i>one</i></a> , now. <a>bare</a></p>
<ul><li><p>in an item</p></li><li>two <a href="b.html">B</a></li></ul><blockquote>quoted words</blockquote><pre>code  here</pre><span>alone</span><div><a href="#f">jump</a></div>
<table><tr><th>A</th><th>B</th></tr><tr><td>1</td></tr><tr><td>x <a href="/t">y</a></td><td></td><td>z</td></tr><tr><td><p>para in cell</p></td></tr></table>
<p>same</p><p>same</p><p>other</p><p>same</p><p>A longer paragraph, so that the blocks hold most of what the page says: that, those, them, here, there, when, where, who.</p><button>Buy for $12.50</button><em>long %s</em><strong>a <div>b</div></strong></body></html>""" % ("word " * 26)
THIN = "<html><body><div>all of the text is in boxes without blocks, so that it stays as it is</div><p>p</p></body></html>"
PRICES = "<html><body>" + "".join(f"<p>words of paragraph number {i} that are many</p>" for i in range(9)) + "<div>costs $9.99</div></body></html>"


def tidy(text):
    return re.sub(r"\s+([,.;:!?])", r"\1", re.sub(r"\s+", " ", text).strip())


def plain_markdown(text, url):
    nodes = [{"pre": r[0], "parent": r[1], "last": r[2], "tag": r[4], "attrs": dict(r[5]), "text": r[6]} for r in html.parse(text)]
    kids = {n["pre"]: [m for m in nodes if m["parent"] == n["pre"]] for n in nodes}
    above = lambda n: [a for a in nodes if a["pre"] < n["pre"] <= a["last"] and a["tag"] != "#text"]

    def content(n):
        return "".join(m["text"] for m in nodes[n["pre"] : n["last"] + 1] if m["tag"] == "#text")

    def inline(n):
        out = []
        for k in kids[n["pre"]]:
            inner = k["text"] if k["tag"] == "#text" else inline(k)
            out.append(f"[{inner}]({urljoin(url, k['attrs']['href'])})" if k["tag"] == "a" and k["attrs"].get("href") and inner else inner)
        return tidy("".join(out))

    def table(n):
        rows = []
        for tr in nodes[n["pre"] + 1 : n["last"] + 1]:
            cells = [tidy(content(c)) for c in kids[tr["pre"]] if c["tag"] in ("td", "th") and tidy(content(c))] if tr["tag"] == "tr" else []
            rows += [cells] if cells else []
        if not rows:
            return None
        width = max(map(len, rows))
        lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
        return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])

    def block(n):
        tag, up = n["tag"], [a["tag"] for a in above(n)]
        value = inline(n)
        if (tag != "table" and "table" in up) or not value:
            return None
        if tag in views.HEADINGS:
            return views.HEADINGS[tag] + value
        if tag == "table":
            return table(n)
        simple = {"li": f"- {value}", "blockquote": f"> {value}", "pre": f"```\n{value}\n```", "p": value}
        if tag in simple:
            return simple[tag]
        lone = tag in views.INLINE_TAGS and not set(up) & {*views.INLINE_TAGS, *views.BLOCK_TAGS}
        if lone and all(k["tag"] in ("#text", *views.INLINE_TAGS) for k in kids[n["pre"]]) and len(tidy(content(n))) <= 120:
            return f"- {value}"

    kept = []
    for b in filter(None, (block(n) for n in nodes if n["tag"] != "#text")):
        if b not in kept[-3:]:
            kept.append(b)
    said = tidy(" ".join(n["text"].strip() for n in nodes if n["tag"] == "#text" and n["text"].strip()))
    body = "\n\n".join(kept)
    bare = re.sub(r"[#>`|*\-\s]+", " ", body).strip()
    words = lambda x: set(re.findall(r"[$\w][\w$+.-]*", x.lower()))
    if not body or len(bare) < 0.6 * len(said):
        out = said
    elif len(words(said) & words(bare)) < 0.8 * len(words(said)) or any("$" in w for w in words(said) - words(bare)):
        out = f"{body}\n\n## Extracted Text\n\n{said}"
    else:
        out = body
    titles = [t for n in nodes if n["tag"] == "title" and (t := tidy(content(n)))] or [t for n in nodes if n["tag"] == "h1" and (t := " ".join("".join(k["text"] for k in kids[n["pre"]] if k["tag"] == "#text").split()))]
    heading = re.sub(r"\s+", " ", titles[0]) if titles else url
    return f"# {heading}\n\nSource: {url}\n\n{out if said else ''}".rstrip() + "\n"


def frame(spark, *texts, url=URL):
    return spark.createDataFrame([(i, url, t) for i, t in enumerate(texts)], "page_id long, url string, html string")


def test_markdown(spark, tiny):
    pages = spark.read.parquet(f"{tiny}/pages.parquet").limit(60).select("page_id", "url", "html").unionByName(frame(spark, RICH, THIN, PRICES, "", None).selectExpr("-1 - page_id AS page_id", "url", "html"))
    got = {r["page_id"]: r["markdown"] for r in views.with_markdown(pages).collect()}
    for r in pages.collect():
        assert got[r["page_id"]] == plain_markdown(r["html"] or "", r["url"]), r["page_id"]
    rich = got[-1]
    for part in ("# The title\n\nSource: https://a.test/dir/page?x=1\n\n", "## Head ing", "See [this one](https://a.test/x), now. bare", "- in an item", "\n\nin an item\n\n", "- two [B](https://a.test/dir/b.html)", "> quoted words", "```\ncode here\n```", "- alone", "| A | B |", "- Buy for $12.50"):
        assert part in rich, part
    assert rich.count("\n\nsame\n\n") == 1 and "- long" not in rich and "## Extracted Text" in got[-3] and "$9.99" in got[-3] and got[-2].count("\n\n") == 2


BIG = "<p>" + "text of the page, long enough to be read. " * 40 + "</p>"
KINDS = [
    ("<?xml version='1.0'?><rss><channel></channel></rss>", "rss", False, None), (f"<html><body>{BIG}</body></html>", "html", False, None), ('<html><body><div id="root"></div><script>x</script></body></html>', "html", True, "react"),
    (f'<html><body><div id="root">{BIG}</div></body></html>', "html", False, "react"), (f'<html ng-app><body>Please wait {BIG}</body></html>', "html", True, "angular"), (f"<html><head><title>Just a moment...</title></head><body>{BIG}</body></html>", "html", True, "bot-gate"),
    (f"<html><body>{BIG}<noscript>Please Enable JavaScript</noscript></body></html>", "html", True, None), (f'<html><body><astro-island data-fw="x"></astro-island>{BIG}</body></html>', "html", True, "astro"),
    ("<html><head><script>" + "var a = 1;" * 700 + "</script></head><body><p>hi</p>" + "<div></div>" * 30 + "</body></html>", "html", True, "js-shell"), ("", "html", False, None), (None, "html", False, None), (f"<html><body>{BIG}</body>{' ' * 4000}just a moment</html>", "html", False, None),
]


def test_content_kinds(spark):
    got = views.with_content_kind(frame(spark, *[k[0] for k in KINDS])).orderBy("page_id").collect()
    assert [(r["content_type"], r["requires_js"], r["js_framework"]) for r in got] == [k[1:] for k in KINDS]
    assert got[0]["content_length"] == len(KINDS[0][0]) and set(got[0].asDict()) == {"page_id", "url", "html", "content_length", "content_type", "requires_js", "js_framework"}


def test_all_links(spark):
    feed = '<?xml version="1.0"?><rss><channel><title>Chan</title><link>https://a.test/</link><item><title>One &amp; only</title><link>/1?b=2&amp;a=1</link></item><item><link href="https://b.test/2"/></item><item><link>/1?a=1&amp;b=2</link></item></channel></rss>'
    robots = "User-agent: *\nSitemap: /map.xml\nsitemap: https://c.test/s.xml\n"
    page = """<html><script>function go(id) { location.href = '/item/' + id; }</script><a href="/x">X</a><a href="#no">n</a><a href="y/../x">again</a><a href="javascript:1">j</a><a href="?page=2">Next</a><b onclick="go('7')">b</b></html>"""
    got = {}
    for r in views.all_links(frame(spark, feed, robots, page, None)).orderBy("page_id", "ord").collect():
        got.setdefault(r["page_id"], []).append((r["link"], r["text"], r["source"]))
    assert got[0] == [("https://a.test/", "Chan", "feed"), ("https://a.test/1?a=1&b=2", "One & only", "feed"), ("https://b.test/2", "", "feed")]
    assert got[1] == [("https://a.test/map.xml", "sitemap", "robots"), ("https://c.test/s.xml", "sitemap", "robots")]
    assert [(u, s) for u, _, s in got[2]][0] == ("https://a.test/x", "anchor") and ("https://a.test/item/7", "", "script") == got[2][-1] and 3 not in got
    only = views.all_links(frame(spark, feed), ("b.test",)).collect()
    assert [r["link"] for r in only] == ["https://b.test/2"]


@pytest.mark.parametrize("kind", views.VIEWS)
def test_views(spark, kind):
    got = {r["page_id"]: r["content"] for r in views.view(frame(spark, RICH, THIN), kind).collect()}
    assert len(got) == 2
    if kind == "links":
        assert [x["url"] for x in json.loads(got[0])][:2] == ["https://a.test/x", "https://a.test/dir/b.html"] and json.loads(got[1]) == []
    if kind == "metadata":
        assert json.loads(got[0])["title"] == "The title" and json.loads(got[1])["content_type"] == "html"
    if kind == "raw_html":
        assert got[1] == THIN


def test_no_such_view(spark):
    with pytest.raises(ValueError):
        views.view(frame(spark, RICH), "smoke")


def test_artifacts_are_stored_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, body string")
    for _ in range(2):
        made = compiled.put_artifacts(rows, "body", str(tmp_path / "store"))
        assert made.count() == 3
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2
