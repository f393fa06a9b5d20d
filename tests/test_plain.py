"""Queries without SQL against plain Python over the same pages, and functions on small literal cases."""

import difflib
import hashlib
import json
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pagespine.functions import coerce, urls
from pagespine.operators import collect, compiled, crawl, observe, verify
from pagespine.plans.contract import Contract, Field, keep_first
from pagespine.plans.selectors import Selector, Unsupported, css, values, xpath
from pagespine.sources import html, readers

QUERIES, SQL = collect()
KEYS = ("pre", "parent", "last", "depth", "tag", "attrs", "text", "shape", "nth", "same", "after")


@pytest.fixture(scope="module")
def parsed(spark, tiny):
    """page_id, url and nodes of the small table, as dicts."""
    rows = spark.read.parquet(f"{tiny}/pages.parquet").select("page_id", "url", "html").collect()
    return {r["page_id"]: (r["url"], [dict(zip(KEYS, n)) | {"attrs": dict(n[5])} for n in html.parse(r["html"])]) for r in rows}


def elements(nodes):
    return [n for n in nodes if n["tag"] != "#text"]


def texts(nodes, of=None):
    return [n["text"] for n in nodes if n["tag"] == "#text" and (of is None or of["pre"] <= n["pre"] <= of["last"])]


def test_region_index(spark, tiny, parsed):
    want = set()
    for page, (_, nodes) in parsed.items():
        under = defaultdict(list)
        for n in nodes:
            if n["shape"] is not None:
                under[n["parent"]].append(n)
        for parent, children in under.items():
            runs = []
            for c in children:
                if runs and runs[-1][0]["shape"] == c["shape"]:
                    runs[-1].append(c)
                else:
                    runs.append([c])
            times = Counter(r[0]["shape"] for r in runs)
            for r in runs:
                if times[r[0]["shape"]] == 1 and len(r) > 1:
                    a = r[0]["attrs"]
                    label = r[0]["tag"] + (f"#{a['id']}" if a.get("id") else "") + (f".{a['class'].strip().split(' ')[0]}" if a.get("class") else "")
                    want.add((page, parent, r[0]["pre"], r[0]["shape"], label, len(r)))
    got = {tuple(r) for r in QUERIES["region_index"](spark, tiny).select("page_id", "parent", "first", "shape", "exemplar", "members").collect()}
    assert got == want and want


def plain_anchors(nodes):
    keys, where = defaultdict(list), {}
    for n in elements(nodes):
        a = n["attrs"]
        tiers = [f"id={a['id']}" if a.get("id") else None, *[f"{k}={a[k]}" for k in sorted(a) if k.startswith("data-")]]
        classes = " ".join(a.get("class", "").split())
        told = [(k, v) for k, v in a.items() if v][:2]
        safe = lambda k: re.fullmatch(observe.SAFE_NAME, k)
        tiers += [f"class={classes}" if classes else None, f"{list(a)[0]}={list(a.values())[0]}" if a and safe(list(a)[0]) else None]
        tiers += [f"both({told[0][0]}={told[0][1]};{told[1][0]}={told[1][1]})" if len(told) == 2 and all(safe(k) and ";" not in v for k, v in told) else None]
        tiers += [f"tag:{n['tag']}" if n["tag"] not in observe.FRAME_TAGS and safe(n["tag"]) else None]
        for k in dict.fromkeys(t for t in tiers if t):
            keys[k].append(n["pre"])
            where.setdefault(n["pre"], []).append(k)
    good = lambda k: len(keys[k]) == 1 and not re.search(observe.RESERVED, k)
    return {pre: next(k for k in own if good(k)) for pre, own in where.items() if any(map(good, own))}


def test_page_anchors(spark, tiny, parsed):
    got = {(r["page_id"], r["pre"]): r["key"] for r in QUERIES["page_anchors"](spark, tiny).collect()}
    assert got == {(page, pre): k for page, (_, nodes) in parsed.items() for pre, k in plain_anchors(nodes).items()}


def test_anchor_counts(spark, tiny, parsed):
    want = {}
    for page, (_, nodes) in parsed.items():
        own, found = plain_anchors(nodes), []
        for n in elements(nodes):
            at = n["pre"]
            while at >= 0 and at not in own:
                at = nodes[at]["parent"]
            if at >= 0:
                found.append(at)
        if found:
            want[page] = (len(found), len(set(found)))
    assert {r["page_id"]: (r["anchored"], r["anchors"]) for r in QUERIES["anchor_counts"](spark, tiny).collect()} == want


def test_overviews(spark, tiny, parsed):
    want = {}
    for page, (_, nodes) in parsed.items():
        entries = []
        for n in elements(nodes):
            tier = 0 if n["depth"] == 0 else 1 if re.fullmatch("h[1-6]", n["tag"]) else 2 if n["tag"] in ("ul", "ol", "table", "nav", "article") else 3 if "id" in n["attrs"] else 4
            entries.append((tier, n["pre"], -(-(len(n["tag"]) + 12) // 4)))
        left, taken = 200 - 48, []
        for _, at, size in sorted(entries):
            if size <= left:
                left, taken = left - size, [*taken, at]
        want[page] = taken
    assert {r["page_id"]: r["taken"] for r in QUERIES["overviews"](spark, tiny).collect()} == want


def test_skeleton_hashes(spark, tiny, parsed):
    own = {r["page_id"]: r["skeleton"] for r in observe.features(spark.read.parquet(f"{tiny}/pages.parquet")).collect()}
    want = {i: "t1:degenerate" if len(s) < 8 else "t1:" + hashlib.sha256(json.dumps(sorted(s), separators=(",", ":")).encode()).hexdigest()[:16] for i, s in own.items()}
    assert {r["page_id"]: r["skeleton_hash"] for r in QUERIES["skeleton_hashes"](spark, tiny).collect()} == want


def test_path_similarities(spark, tiny, parsed):
    p = spark.read.parquet(f"{tiny}/pages.parquet")
    rows = {r["page_id"]: (r["host"], r["path"]) for r in p.select("page_id", urls.part(F.col("url"), "host").alias("host"), F.array_join(F.filter(F.split(urls.link_signature(F.col("url")), "/"), lambda s: s != ""), "/").alias("path")).collect()}
    first = {}
    for i in sorted(rows):
        first.setdefault(rows[i][0], rows[i][1])
    ratio = lambda a, b: 0.0 if not a or not b else 1.0 if a == b else difflib.SequenceMatcher(a=a, b=b, autojunk=False).ratio()
    got = {r["page_id"]: r["similarity"] for r in QUERIES["path_similarities"](spark, tiny).collect()}
    assert got == {i: pytest.approx(ratio(path, first[host]), abs=1e-9) for i, (host, path) in rows.items()}


def test_best_path_similarities(spark, tiny):
    p = spark.read.parquet(f"{tiny}/pages.parquet").select("page_id", urls.part(F.col("url"), "host").alias("h"), compiled.path_signature(F.col("url")).alias("s")).collect()
    refs = defaultdict(set)
    for r in p:
        if r["page_id"] % 10 == 0:
            refs[r["h"]].add(r["s"])
    ratio = lambda a, b: 0.0 if not a or not b else difflib.SequenceMatcher(a=a, b=b, autojunk=False).ratio()
    got = {r["page_id"]: r["similarity"] for r in QUERIES["best_path_similarities"](spark, tiny).collect()}
    assert got == {r["page_id"]: pytest.approx(max(ratio(r["s"], x) for x in refs[r["h"]]), abs=1e-9) if refs[r["h"]] else None for r in p}


def test_page_matches(spark, tiny, parsed):
    """Each page against the first of its bucket: the scores of the weighted sets, by a plain loop."""
    own = {r["page_id"]: r for r in observe.features(spark.read.parquet(f"{tiny}/pages.parquet")).collect()}
    got = QUERIES["page_matches"](spark, tiny).collect()
    assert {r["page_id"] for r in got} == set(own)
    for r in got:
        a, b = own[r["page_id"]], own[r["exemplar"]]
        carried = [k for k in ("skeleton", "semantic", "identity") if k != "identity" or min(len(a[k]), len(b[k])) >= observe.MIN_OPTIONAL]
        cover = lambda x, y: 1.0 if not x and not y else len(set(x) & set(y)) / min(len(x), len(y)) if x and y else 0.0
        thick = min(len(a["skeleton"]), len(b["skeleton"])) >= observe.MIN_SKELETON
        mean = sum(cover(a[k], b[k]) for k in carried) / len(carried) if thick else 0.0
        assert r["containment_score"] == pytest.approx(mean, abs=1e-6)
        if r["page_id"] == r["exemplar"]:
            assert r["same_shape"] == thick


HTML = """<html><body><ul id="u"><li class="a x">1</li><li data-k="foo-bar">2</li><li>3<b>in</b></li></ul><p>one <a href="/q">l</a></p><p class="z">two</p>
<div><p>three</p></div><input type="submit" value="Go"><input><button>B</button><a>no link</a></body></html>"""


def test_selectors(spark):
    tests = {
        ("css", "li:nth-child(2)"): ["2"], ("css", "li:first-child, p.z"): ["1", "two"], ("css", "ul + p"): ["one  l"], ("css", "ul ~ p"): ["one  l", "two"], ("css", "li:not(.a)"): ["2", "3 in"],
        ("css", "li[data-k^=foo]"): ["2"], ("css", 'li[data-k$="bar"]'): ["2"], ("css", "li[data-k*=o-b]"): ["2"], ("css", "li[class~=x]"): ["1"], ("css", "li[data-k^='']"): [], ("css", "li:last-child"): ["3 in"],
        ("css", "li:nth-child(odd)"): ["1", "3 in"], ("css", "div > p, ul > li:nth-child(n+2)"): ["2", "3 in", "three"], ("css", "a[href]::attr(href)"): ["/q"],
        ("css", "li:nth-of-type(3)"): ["3 in"], ("css", "p:first-of-type"): ["one  l", "three"], ("css", "ul:only-child"): [], ("css", "div p:only-child"): ["three"], ("css", "li:is(.a, [data-k])"): ["1", "2"], ("css", "li:not(.a, [data-k])"): ["3 in"],
        ("css", "li:nth-last-child(1)"): ["3 in"], ("css", "input:empty"): ["", ""], ("css", "a:link"): ["l"], ("css", "button:enabled"): ["B"], ("css", "html:root > body > ul > li.x"): ["1"],
        ("xpath", "//li[2]"): ["2"], ("xpath", "//p[contains(text(), 'thr')]"): ["three"], ("xpath", "//li[contains(., 'in')]"): ["3 in"], ("xpath", '//a[contains(@href,"q")]/@href'): ["/q"],
        ("role", "button"): ["B", ""], ("role", "link"): ["l"], ("role", "textbox"): [""],
    }
    df = html.with_nodes(spark.createDataFrame([(1, HTML)], "id int, html string"))
    row = df.select(*[values(Selector(v, k), F.col("nodes")).alias(str(i)) for i, (k, v) in enumerate(tests)]).first()
    assert dict(zip(tests, row)) == tests
    for valid in ("li:hover", "p:has(a)", "li:last-of-type"):
        with pytest.raises(Unsupported):
            css(valid)
    for bad in ("li:hoover", "a >", "li[", "p!x", "li:nth-child(x)"):
        with pytest.raises(ValueError):
            css(bad)
    with pytest.raises(ValueError):
        xpath("//li[position() < 3]")


def test_verdicts(spark):
    c = Contract("C", (
        Field("a", (Selector("h9"), Selector("li:bad"), Selector("NA"))), Field("b", (Selector("p"),), root=Selector("div")), Field("c", (Selector("p.z"),), root=Selector("div")),
        Field("d", (Selector("x", "jsonld"), Selector("ul", "attr", name="id"))), Field("e", (Selector("button", "role"),)), Field("f", (Selector("p"),), root=Selector("aside")),
    ))
    pages = spark.createDataFrame([(1, HTML), (2, None)], "page_id int, html string")
    got = {(r["page_id"], r["field"]): (r["status"], r["working_level"], [f["reason"] for f in r["failures"]]) for r in verify.verdicts(pages, c).collect()}
    none, root = "no_elements_found", "root matched no element"
    assert {f: got[1, f] for f in "abcdef"} == {"a": ("failed", None, [none, "invalid_syntax", "na_selector"]), "b": ("verified", "primary", []), "c": ("failed", None, [none]), "d": ("verified", "fallback", ["unsupported_strategy"]), "e": ("verified", "primary", []), "f": ("failed", None, [root])}
    assert all(got[2, f][0] == "failed" for f in "abcdef")
    low = {r["field"]: r["status"] for r in verify.verdicts(pages.filter("page_id = 1"), c, max_level=1).collect()}
    assert low["d"] == "failed" and low["e"] == "failed" and low["b"] == "verified"


def test_dates_in_another_zone(spark):
    texts_ = {"2024-01-01T00:00:00+02:00": "2023-12-31T22:00:00+00:00", "2024-01-01": "2024-01-01T00:00:00+00:00", "Posted: 3 May 2024": "2024-05-03T00:00:00+00:00", "March: 2020-01-05": None}
    df = spark.createDataFrame([(t,) for t in texts_], "t string")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert {r["t"]: r["d"] for r in df.select("t", coerce.iso_date(F.col("t")).alias("d")).collect()} == texts_
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_urls_of_json():
    assert readers.urls_in_json('{"title": "https://no.test/x", "url": "https://a.test/1"}') == ["https://a.test/1"]
    assert readers.urls_in_json('["https://a.test/1", {"url": "https://b.test"}, "https://a.test/1", "plain", 3]') == ["https://a.test/1", "https://b.test"]
    assert readers.urls_in_json('{"items": [{"url": "https://a.test", "ref": "https://c.test"}]}') == ["https://a.test"]


def test_address_joined_to_its_page(spark):
    df = spark.createDataFrame([("/a?utm_source=x&b=1", "http://s.test/p/q"), ("//c.test/d", "http://s.test"), ("javascript:x()", "http://s.test")], "u string, p string")
    assert [r[0] for r in df.select(urls.clean(F.col("u"), page=F.col("p"))).collect()] == ["https://s.test/a?b=1", "https://c.test/d", None]


def test_numbered_over_parts(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.lit("y").alias("y"))
    got = crawl.numbered(df, [F.desc("x")], "place").collect()
    assert all(r["place"] == 1000 - r["x"] for r in got) and len(got) == 1000


def test_first_rows_of_a_hot_key(spark):
    df = spark.range(2000).select(F.lit(1).alias("k"), (2000 - F.col("id")).alias("o"), F.col("id").alias("v"))
    assert [tuple(r) for r in keep_first(df, ["k"], ["o"]).collect()] == [(1, 1, 1999)]


def test_artifacts(spark, tmp_path):
    rows = spark.createDataFrame([(1, b"abc"), (2, b"abc"), (3, b""), (4, None)], "id int, body binary")
    put = {r["id"]: (r["digest"], r["size"]) for r in compiled.put_artifacts(rows, "body", f"{tmp_path}/store").collect()}
    assert put[1] == put[2] == (hashlib.sha256(b"abc").hexdigest(), 3) and put[4] == (None, None)
    kept = compiled.read_artifacts(spark, f"{tmp_path}/store").filter("digest IS NOT NULL").collect()
    assert len(kept) == 2 and all(r["intact"] for r in kept)


def test_gate_of_contracts(spark):
    f = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1), (2, "b", 1), (3, "a", 1)], "page int, contract string, element int")
    c = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (3, "b"), (4, "a")], "page int, contract string")
    got = {r["page"]: (r["contracts"], r["empty"], r["overlapping"], r["accepted"]) for r in verify.discriminated(f, c, "page", "contract", "element").collect()}
    assert got == {1: (2, 0, 0, True), 2: (2, 0, 1, False), 3: (2, 1, 0, False), 4: (1, 1, 0, False)}


def test_plans(spark):
    from pagespine.plans.extraction import computed, evidence, rows, take

    pages = spark.createDataFrame([(1, HTML)], "page_id int, html string")
    made = rows(pages, "li", {"text": take("b"), "key": take("li").attribute("data-k"), "whole": lambda nodes, within: html.node_text(nodes, within), "mark": evidence})
    got = made.orderBy("ord").collect()
    assert [(r["text"], r["key"], r["whole"]) for r in got] == [(None, None, "1"), (None, None, "2"), ("in", None, "3 in")] and len({r["mark"] for r in got}) == 3
    page = rows(pages, None, {"hrefs": take("a").attribute("href").all(), "sizes": take("li").all().map(F.length).map(lambda n: F.when(n > 1, n)).compact(), "first": take("//p", "xpath").map(F.upper)})
    assert tuple(page.select("hrefs", "sizes", "first").first()) == (["/q"], [4], "ONE  L")
    more = computed(page, lambda df: F.struct(F.size("hrefs").alias("n"), F.col("first").alias("again")), ["n", "again"])
    assert tuple(more.select("n", "again").first()) == (1, "ONE  L")


def test_required_and_nested_fields(spark):
    from pagespine.plans.contract import complete, extract, nested, typed

    body = '<div class="shop"><h2>S1</h2><p class="i"><b>x</b><i>3</i></p><p class="i"><b>y</b></p></div><div class="shop"><h2>S2</h2></div>'
    pages = spark.createDataFrame([(1, body)], "page_id int, html string")
    item = Contract("Item", (Field("name", (Selector("b"),)), Field("price", (Selector("i"),), "number", required=True)), container=Selector("p.i"))
    shop = Contract("Shop", (Field("title", (Selector("h2"),)), Field("loud", (), compute=lambda nodes, within: F.upper(F.try_element_at(css("h2").values(nodes, within), F.lit(1))))), container=Selector("div.shop"))
    got = nested(pages, shop, {"items": item}).orderBy("ord").collect()
    assert [(r["title"], r["loud"], [(i["name"], i["price"]) for i in r["items"]]) for r in got] == [("S1", "S1", [("x", "3"), ("y", None)]), ("S2", "S2", [])]
    rows = typed(extract(pages, item), item)
    assert sorted((r["name"], r["missing"]) for r in rows.collect()) == [("x", []), ("y", ["price"])] and complete(rows).count() == 1


def test_pruned(spark):
    deep = "<div>" * 10 + "<div><div></div></div><div class='k'></div><div>text</div>" + "</div>" * 10
    page = f"<body><svg><path></path></svg><img src='data:image/png;base64,xx'><img src='/a.png'><div hidden>little</div><div hidden><ul><li>kept</li></ul></div><div aria-hidden='true'>{'long ' * 20}</div>{deep}</body>"
    nodes = html.with_nodes(spark.createDataFrame([(1, page)], "id int, html string")).select(html.pruned(F.col("nodes")).alias("n")).first()["n"]
    tags = Counter(n["tag"] for n in nodes)
    assert tags["svg"] == tags["path"] == tags["canvas"] == 0 and tags["li"] == 1
    assert [n["attrs"]["src"] for n in nodes if n["tag"] == "img"] == [html.DATA_URI, "/a.png"]
    shown = [n["text"].strip() for n in nodes if n["tag"] == "#text"]
    assert "little" not in shown and "kept" in shown and "text" in shown and any(t.startswith("long") for t in shown)
    assert sum(n["tag"] == "div" and n["depth"] > 8 for n in nodes) == 4
