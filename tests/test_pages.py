"""Parsing, selectors, extraction, features, sources, sinks and streams on small literal pages."""

import json

import pytest
from pyspark.sql import functions as F

from pagespine import streaming
from pagespine.functions import coerce, urls
from pagespine.operators import collect, observe
from pagespine.operators.records import NEWS_ARTICLE, PRODUCT
from pagespine.plans.contract import Contract, Field, extract, typed
from pagespine.plans.selectors import Selector, css, values, xpath
from pagespine.sources import formats, html, readers

QUERIES, SQL = collect()
PAGE = """<html><head><title> A &amp; B </title><script>var x = "</p>";</script></head><body><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
<main id="m"><article><h1>Head</h1><p>One <b>two<p>Three<br>four</article><table><tr><td>1</td></tr><tr><td>2</td></tr><tr><td>3</td></tr><tr><td>4</td></tr><tr><td>5</td></tr><tr><td>6</td></tr></table>
<ul class="list big"><li>x</li><li>y</li><li>z</li><li>w</li></ul><div class="ad">Buy</div></main></body></html>"""


@pytest.fixture(scope="module")
def page(spark):
    return html.with_nodes(spark.createDataFrame([(1, PAGE)], "page_id long, html string"))


def one(df, *columns):
    row = df.select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


def test_tree():
    nodes = html.parse(PAGE)
    assert [n[0] for n in nodes] == list(range(len(nodes)))
    tags = [n[4] for n in nodes]
    assert tags.count("p") == 2 and tags.count("br") == 1 and tags.count("script") == 1
    p, q = (n for n in nodes if n[4] == "p")
    assert q[1] == p[1], "a paragraph ends the one before"
    assert all(n[0] <= n[2] < len(nodes) for n in nodes)
    assert html.parse(None) == html.parse("") == []


def test_selectors(page):
    nodes = F.col("nodes")
    assert one(page, css("main li").values(nodes)) == ["x", "y", "z", "w"]
    assert one(page, css("ul.big > li").values(nodes)) == ["x", "y", "z", "w"]
    assert one(page, css("nav a::attr(href)").values(nodes)) == ["/a", "/b"]
    assert one(page, xpath("//main[@id='m']//h1/text()").values(nodes)) == ["Head"]
    assert one(page, values(Selector("link", "role", "b"), nodes)) == ["B"]
    assert one(page, values(Selector("anything", "visual"), nodes)) == []
    assert one(page, values(Selector("NA"), nodes)) == []
    with pytest.raises(ValueError):
        css("a:hover")


def test_cleaning(page):
    kept = one(page, html.texts(html.cleaned(F.col("nodes"))))
    words = " ".join(kept).split()
    assert "Buy" not in words and "w" not in words and "6" not in words and "5" in words and "A" not in words


def test_extraction(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<div class=card><b class=name>N</b><i class=price>$3.50</i></div><div class=card><b class=name>N</b><i class=price>$3.50</i></div><div class=card></div>")], "page_id long, html string")
    article = typed(extract(pages, NEWS_ARTICLE), NEWS_ARTICLE).collect()
    assert [(r["page_id"], r["headline"]) for r in article] == [(1, "Head")]
    cards = Contract("Card", PRODUCT.fields, Selector(".card"))
    found = typed(extract(pages, cards), cards).collect()
    assert [(r["page_id"], r["name"], r["price"]) for r in found] == [(3, "N", 3.5)]


def test_field_root_must_match(spark):
    pages = spark.createDataFrame([(1, PAGE)], "page_id long, html string")
    inside = Contract("C", (Field("a", (Selector("li"),), root=Selector("nav")), Field("b", (Selector("h1"),), root=Selector("aside"))))
    assert extract(pages, inside).select("a", "b").first() == ("A", None)


@pytest.mark.parametrize("raw,price", [("$1,299", 1.299), ("1.234,50 €", 1234.5), ("1,234,567", None), ("free", 0.0), ("freedom", None), (None, None), ("2 for 10", 10.0)])
def test_price(spark, raw, price):
    assert one(spark.createDataFrame([(raw,)], "x string"), coerce.price(F.col("x"))) == price


@pytest.mark.parametrize("raw,canonical", [("HTTP://u:p@Ex.com:80/a/../b//c?z=1&a=2#f", "http://ex.com/b/c?a=2&z=1"), ("https://x.test", "https://x.test/"), ("ftp://x/y", None), (None, None)])
def test_canonical(spark, raw, canonical):
    assert one(spark.createDataFrame([(raw,)], "x string"), urls.canonical(F.col("x"))) == canonical


@pytest.mark.parametrize("data,header,text,encoding", [
    ("é".encode("utf-8-sig"), None, "é", "utf-8"), ("é".encode("utf-16"), None, "é", "utf-16-le"), ("한".encode("euc-kr"), "euc-kr", "한", "euc_kr"),
    (b'<meta charset="koi8-r">' + "ж".encode("koi8-r"), None, '<meta charset="koi8-r">ж', "koi8-r"), (b"\xe9", None, "é", "fallback"), (None, None, None, None), (b"ok", "no-such", "ok", "utf-8"),
])
def test_decode(data, header, text, encoding):
    assert readers.decode(data, header) == (text, encoding)


def test_url_lists(spark, tmp_path):
    (tmp_path / "a.json").write_text('["https://x.test/1", {"url": "https://x.test/2"}]')
    (tmp_path / "b.csv").write_text("name,URL\nq,https://x.test/3\n")
    (tmp_path / "c.txt").write_text("go to https://x.test/4.")
    got = [[r["url"] for r in readers.url_list(spark, str(tmp_path / f)).orderBy("ord").collect()] for f in ("a.json", "b.csv", "c.txt")]
    assert got == [["https://x.test/1", "https://x.test/2"], ["https://x.test/3"], ["https://x.test/4"]]


def test_bad_lines_are_told(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"a": 1}\n\n{"a": \n{"a": 2}\n')
    good, bad = readers.json_lines(spark, str(tmp_path / "s.jsonl"), "a int")
    assert sorted(r["a"] for r in good.collect()) == [1, 2] and bad.count() == 1


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2.5, ["a"], None)], "a int, b double, c array<string>, d string")
    assert tuple(formats.stringified(rows).first()) == ("1", "2.5", '["a"]', None)
    both = formats.append(rows.select("a"), rows.select("b"))
    assert both.columns == ["a", "b"] and both.count() == 2
    for kind in ("csv", "parquet", "jsonl"):
        formats.write(rows, f"{tmp_path}/{kind}", kind)
        assert len(list((tmp_path / kind).glob("part-*"))) >= 1
    content = spark.createDataFrame([("https://x.test", ("evil", "t"))], "url string, content struct<url: string, title: string>")
    assert formats.json_rows(content).first().asDict() == {"url": "https://x.test", "title": "t"}
    single = spark.createDataFrame([("https://x.test", 1, "t")], "url string, o int, content string")
    assert json.loads(formats.envelopes(single, ["url"], "o", "content").first()["envelope"]) == {"url": "https://x.test", "content": "t"}


def test_features_and_matches(spark):
    other = PAGE.replace("Head", "Tail").replace("<li>w</li>", "<li>w</li><li>v</li>")
    thin = "<p>x</p>"
    f = observe.features(spark.createDataFrame([(1, PAGE), (2, other), (3, thin), (4, None)], "page_id long, html string")).collect()
    by = {r["page_id"]: r for r in f}
    assert by[1]["skeleton"] == by[2]["skeleton"] and by[4]["skeleton"] == []
    assert set(by[1]["semantic"]) == {"lm:nav", "lm:main", "lm:article", "h1:lo"}
    pairs = spark.createDataFrame([(a, b, by[a][1:], by[b][1:]) for a, b in ((1, 2), (1, 3), (3, 3))], "a int, b int, own struct<skeleton: array<string>, semantic: array<string>, identity: array<string>>, their struct<skeleton: array<string>, semantic: array<string>, identity: array<string>>")
    assert {(r["a"], r["b"]): (r["same_shape"], r["score"]) for r in observe.match(pairs).collect()} == {(1, 2): (True, 1.0), (1, 3): (False, 0.0), (3, 3): (False, 0.0)}


def test_regions_and_anchors(spark):
    nodes = html.node_table(spark.createDataFrame([(1, PAGE)], "page_id long, html string"))
    found = observe.region_runs(observe.with_shapes(nodes)).collect()
    assert sorted(r["n"] for r in found) == [2, 4, 6], "nav items, list items, rows; the paragraphs differ in shape"
    keys = {r["key"] for r in observe.anchors(nodes).collect()}
    assert {"id=m", "class=list big", "class=ad", "tag:table"} <= keys and "tag:li" not in keys
    near = observe.nearest_anchors(nodes, observe.anchors(nodes)).filter("key = 'tag:table'")
    assert near.count() == 13


def test_overview_passes_over_what_is_too_big(spark):
    e = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 1, 50), (1, 2, 2, 30)], "page_id long, tier int, ord long, tokens long")
    assert observe.overview(e, "page_id", 100, 50).first()["taken"] == [0, 2]


def test_streams(spark, tmp_path):
    source, schema = tmp_path / "in", "page_id long, url string, html string"
    for i in (1, 2):
        spark.createDataFrame([(1, f"https://x.test/{i}", PAGE.replace("Head", f"Head {i}")), (10 + i, "https://x.test/n", PAGE)], schema).coalesce(1).write.mode("append").parquet(str(source))
    streaming.write_records(streaming.pages(spark, str(source), 1), NEWS_ARTICLE, f"{tmp_path}/out", f"{tmp_path}/c1").awaitTermination()
    assert sorted(r["page_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 1, 11, 12]
    streaming.keep_newest(streaming.pages(spark, str(source), 1), f"{tmp_path}/table", f"{tmp_path}/c2", ["page_id"], ["url"]).awaitTermination()
    newest = streaming.read_newest(spark, f"{tmp_path}/table")
    assert {r["page_id"]: r["url"] for r in newest.collect()} == {1: "https://x.test/2", 11: "https://x.test/n", 12: "https://x.test/n"}


def test_unseen(spark, tmp_path):
    spark.createDataFrame([("http://x.test/a?b=1&a=2", 1), ("http://X.test/a?a=2&b=1#f", 2), ("http://x.test/c", 3)], "url string, n int").withColumn("at", F.timestamp_seconds("n")).write.parquet(f"{tmp_path}/u")
    stream = streaming.unseen(spark.readStream.schema("url string, n int, at timestamp").parquet(f"{tmp_path}/u"), "at", "1 hour")
    q = stream.writeStream.format("memory").queryName("unseen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("unseen").count() == 2


@pytest.mark.parametrize("module, name", [("pages", "page_titles"), ("records", "headings")])
def test_entities_as_in_sql(spark, by_sql, same, tmp_path, module, name):
    """Titles cut within an entity, quoted words, numbers and names that the SQL leaves alone."""
    odd = ["a &amp;&amp b", "cut&amp", "token = &quot;x&quot; y", "&#39;n&#x41; &eacute;t&eacute;", "&copy; 1 &lt;b&gt; &amp;quot; &amp;amp;", "R&D & co", "plain"]
    rows = [(i, f"<html><head><title>{t}</title></head><body><h1>{t}</h1><p>&quot;p&quot;</body></html>") for i, t in enumerate(odd)]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "made"))
    (part,) = (tmp_path / "made").glob("*.parquet")
    part.rename(tmp_path / "pages.parquet")
    same(QUERIES[name](spark, str(tmp_path)), *by_sql(SQL[name], tmp_path))
