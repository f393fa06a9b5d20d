"""Addresses: each leads to its element, also in an edited version; regions, members and inspections."""

import re

import pytest
from pyspark.sql import functions as F

from pagespine.operators import addresses as A
from pagespine.operators.observe import anchor_keys
from pagespine.sources import html

PAGE = """<html><body><div id="top"><p class="lead">a</p><p>b</p><p>c</p></div><section data-k="s1"><h2>H</h2><div><span title="x">one</span><span title="y">two</span></div></section>
<ul class="cards"><li id="c1"><a href="/1">One</a></li><li id="c2"><a href="/2">Two</a></li><li><a href="/3">Three</a></li><li><a href="/3">Three</a></li></ul>
<form name="f" method="post"><input name="q"><input name="r"></form><form name="f" method="get"><input></form><div><div><b>deep</b></div></div></body></html>"""
EDITED = PAGE.replace('<div id="top">', '<header><nav><a href="/new">n</a></nav></header><div class="banner"></div><div id="top"><p class="intro">new</p>').replace('<li id="c1">', '<li id="c0"><a href="/0">Zero</a></li><li id="c1">').replace("<h2>H</h2>", "<h2>Changed</h2>")


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "page_id long, html string")


def shown(spark, text):
    """{pre: (tag, attributes, text)} of a page's elements."""
    nodes = html.parse(text)
    return {n[0]: (n[4], tuple(n[5]), " ".join(t[6] for t in nodes[n[0] : n[2] + 1] if t[4] == "#text")) for n in nodes if n[4] != "#text"}


def test_every_address_leads_to_its_element(spark, small):
    elements = A.element_table(spark.read.parquet(f"{small}/pages.parquet").limit(60).unionByName(frame(spark, PAGE).select(F.lit(-1).cast("long").alias("page_id"), F.lit("u").alias("url"), "html")))
    made = A.addresses(elements)
    got = A.resolved(made.select("page_id", "address", F.col("pre").alias("of")), elements).collect()
    assert got and all(r["of"] == r["pre"] for r in got)
    assert len({(r["page_id"], r["address"]) for r in got}) == len(got) == elements.count()


def test_forms(spark):
    elements = A.element_table(frame(spark, PAGE))
    by_pre = {r["pre"]: (r["address"], r["ref"]) for r in A.addresses(elements).withColumn("ref", A.reference(F.col("address"))).collect()}
    place = {v: k for k, v in shown(spark, PAGE).items()}
    of = lambda tag, attrs, text: by_pre[place[tag, attrs, text]]
    assert of("div", (("id", "top"),), "a b c")[0] == '//*[@id="top"]#anchor=id%3Dtop'
    assert of("p", (), "b")[0] == '//*[@id="top"]#anchor=id%3Dtop|./p[2]' and of("p", (), "b")[1] is None
    assert of("p", (("class", "lead"),), "a")[0].startswith('//*[@class="lead"]#anchor=')
    assert of("input", (("name", "q"),), "")[0] == '//*[@name="q"]#anchor=name%3Dq'
    assert of("b", (), "deep")[0] == "//b#anchor=tag%3Ab" and len(of("b", (), "deep")[1]) == 16
    assert of("form", (("name", "f"), ("method", "post")), "")[0] == '//*[@name="f" and @method="post"]#anchor=both%28name%3Df%3Bmethod%3Dpost%29'
    assert [a for a, _ in by_pre.values() if a == "/html/body"]


def test_addresses_survive_an_edit(spark):
    """What has a durable address in one version is found by it in the other, where things were put in before and within."""
    old, new = (A.element_table(frame(spark, t)) for t in (PAGE, EDITED))
    made = A.addresses(old).withColumn("ref", A.reference(F.col("address"))).filter("ref IS NOT NULL")
    got = A.resolved(made.select("page_id", "address", "ref", F.col("pre").alias("old")), new).collect()
    before, after = shown(spark, PAGE), shown(spark, EDITED)
    assert len(got) > 12
    for r in got:
        tag, attrs, text = before[r["old"]]
        assert r["pre"] is not None and after[r["pre"]][:2] == (tag, attrs), r["address"]
        assert text in after[r["pre"]][2] or tag in ("h2", "section", "ul", "body", "html", "div")
    # references of the same things are equal in both versions
    again = {r["ref"] for r in A.addresses(new).withColumn("ref", A.reference(F.col("address"))).collect()}
    assert {r["ref"] for r in got} <= again


def test_what_leads_nowhere(spark):
    elements = A.element_table(frame(spark, PAGE))
    asked = spark.createDataFrame([(0, x) for x in ("//*[@id=\"gone\"]#anchor=id%3Dgone", "/html/body/nav", "./relative", "/html/body/p[9]", "/html/body/div#key=x", "", "/html/body/div")], "page_id long, address string")
    assert all(r["pre"] is None for r in A.resolved(asked, elements).collect())


def test_members(spark):
    pages = frame(spark, PAGE)
    elements = A.element_table(pages)
    members = A.region_members(pages, elements).cache()
    cards = {r["text"]: r for r in members.collect() if "cards" in r["region"] and r["attrs"].get("id") != "x"}
    assert cards["One"]["key"] == "id=c1" and cards["Two"]["address"].endswith("&key=id%3Dc2") and cards["Three"]["key"] is None
    assert re.search(r"&ordinal=[23]$", cards["Three"]["address"])
    all_ = members.select("page_id", "address", F.col("pre").alias("of"))
    assert all(r["of"] == r["pre"] for r in A.resolved(all_, elements, members).collect())
    moved = members.filter("key = 'id=c1'").select("page_id", A.rebound(F.col("address"), F.lit("id=c2")).alias("address"))
    assert A.resolved(moved, elements, members).first()["pre"] == cards["Two"]["pre"]
    shown_ = A.expanded(members, most_items=2).filter("region LIKE '%cards%'").orderBy("ordinal").collect()
    assert [(r["summary"], r["stable"]) for r in shown_] == [("One", True), ("Two", True)]
    found = A.inspected(pages, A.resolved(moved, elements, members)).first()
    assert found["content"] == '<li id="c2"><a href="/2">Two</a></li>' and not found["cut"]
    short = A.inspected(pages, A.resolved(moved, elements, members), most_bytes=9).first()
    assert (short["content"], short["bytes"], short["cut"]) == ('<li id="c', 9, True)
    members.unpersist()


def test_budgets_keep_characters_whole(spark):
    pages = frame(spark, '<p id="a">éé</p>')
    asked = spark.createDataFrame([(0, "x", 0)], "page_id long, address string, pre int")
    r = A.inspected(pages, asked, most_bytes=11).first()
    assert (r["content"], r["bytes"], r["cut"]) == ('<p id="a">', 10, True)


@pytest.mark.parametrize("attrs, keys", [({"name": "n", "id": "i", "class": " a  b "}, ["id=i", "class=a b", "name=n", "both(name=n;id=i)", "tag:p"]), ({"data-z": "1", "data-a": "2"}, ["data-a=2", "data-z=1", "both(data-z=1;data-a=2)", "tag:p"]), ({}, ["tag:p"]), ({"x": "a;b", "y": "c"}, ["x=a;b", "tag:p"])])
def test_keys(spark, attrs, keys):
    df = spark.createDataFrame([("p", attrs)], "tag string, attrs map<string, string>")
    assert df.select(anchor_keys(F.col("tag"), F.col("attrs"))).first()[0] == keys
