"""Reducers against plain recursion over the parsed page."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from pagespine.functions import trees
from pagespine.operators import reducers
from pagespine.sources import html

NAMES = ("pre", "parent", "last", "depth", "tag", "attrs", "text", "shape", "nth", "same", "after")
EXTRA = """<html lang="en"><head><title>T</title><script>x()</script></head><body><div class="a b c"><div class="w"><section class="s x"><p>one</p></section></div></div>
<div><div id="named"><span><b>in</b></span></div></div><ul aria-setsize="9"><li><div><a href="/1" title="First">1</a></div></li><li><div><a href="/2" title="Second">2</a></div></li><li><div><a href="/3" title="Third">2</a></div></li></ul>
<table aria-rowcount="2"><tr><td>x</td></tr><tr><td>y</td></tr></table><div aria-hidden="true"><button aria-pressed="true">B</button></div><div role="presentation"><h2>Head <i>ing</i></h2><img alt="pic"><input></div>
<main><div><button disabled>Go</button><button>Go</button></div><p>tail</p><h3 aria-level="5">deep</h3></main></body></html>"""


def tree(text):
    return [dict(zip(NAMES, row)) | {"attrs": dict(row[5])} for row in html.parse(text)]


def squash(text):
    return re.sub(r"\s+", " ", text or "").strip()


def digest(*parts):
    return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()[:16]


def runs(children, shape):
    """[(first, members)] of adjacent children of one shape; whether each is a region."""
    out = []
    for c in children:
        if out and shape[out[-1][0]] == shape[c]:
            out[-1].append(c)
        else:
            out.append([c])
    single = lambda s: sum(shape[r[0]] == s for r in out) == 1
    return [(r, len(r) >= 2 and single(shape[r[0]])) for r in out]


def plain_dom(text):
    nodes = tree(text)
    own = {n["pre"]: n for n in nodes if n["tag"] != "#text" and n["tag"] not in reducers.METADATA_TAGS}
    kids = {p: [] for p in (-1, *own)}
    for p, n in own.items():
        kids[n["parent"]].append(p)
    spoken = {n["parent"] for n in nodes if n["tag"] == "#text" and squash(n["text"])}
    shape = {}

    def sign(p):
        names = ",".join(sorted(k for k in own[p]["attrs"] if k != "id" and not k.startswith("data-")))
        shape[p] = digest(f"{own[p]['tag']}:{names}", *[sign(c) for c in kids[p]])
        return shape[p]

    def count(p):
        for k in reducers.DECLARED:
            if re.fullmatch(r"-?\d+", own[p]["attrs"].get(k, "")):
                return int(own[p]["attrs"][k]) if int(own[p]["attrs"][k]) >= 0 else None

    def label(p):
        a = own[p]["attrs"]
        return own[p]["tag"] + (f"#{a['id']}" if a.get("id") else "") + "".join(f".{c}" for c in a.get("class", "").split()[:2])

    def wraps(p):
        a = own[p]["attrs"]
        named = any(k == "id" or k.startswith("data-") for k in a)
        return len(kids[p]) == 1 and p not in spoken and not named and count(p) is None and "hidden" not in a and a.get("aria-hidden") != "true"

    out = []

    def walk(parent, depth):
        for members, region in runs(kids[parent], shape):
            for p in members[:1] if region else members:
                if region:
                    declared = count(parent) if parent >= 0 and len(members) == len(kids[parent]) else None
                    out.append((p, p, label(p), depth, "region", len(members), declared, declared == len(members)))
                    walk(p, depth + 1)
                    continue
                path = [p]
                while wraps(path[-1]):
                    path.append(kids[path[-1]][0])
                out.append((path[-1], p, " > ".join(map(label, path)), depth, "element", None, None, None))
                walk(path[-1], depth + 1)

    for p in kids[-1]:
        sign(p)
    walk(-1, 0)
    return [e for e in out if e[3] <= reducers.MAX_DEPTH]


def plain_ax(text):
    nodes = tree(text)
    tags = {"button": "button", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "article": "article", "main": "main", "nav": "navigation", "ul": "list", "ol": "list", "li": "listitem", "table": "table", "tr": "row", "td": "cell", "th": "cell", "img": "img", "textarea": "textbox"}

    def role(n):
        said = n["attrs"].get("role", "").split(" ")[0].strip().lower()
        if said in ("none", "presentation") or n["tag"] == "#text":
            return None
        if said:
            return said
        if n["tag"] == "input":
            return {"text": "textbox", "search": "searchbox", "button": "button", "submit": "button"}.get(n["attrs"].get("type", "text"))
        return ("link" if "href" in n["attrs"] else None) if n["tag"] == "a" else tags.get(n["tag"])

    found, out, kids, shape = {}, [], {-1: []}, {}
    for n in nodes:
        r = role(n)
        if r:
            up = [a for a in nodes[: n["pre"]] if a["pre"] in found and a["last"] >= n["pre"]]
            a = n["attrs"]
            texts = " ".join(t["text"] for t in nodes[n["pre"] : n["last"] + 1] if t["tag"] == "#text")
            name = next((squash(a[k]) for k in ("aria-label", "alt", "title") if squash(a.get(k))), squash(texts) if r in reducers.NAMED_BY_CONTENT else "")
            level = int(a["aria-level"]) if a.get("aria-level") else int(n["tag"][1]) if re.fullmatch("h[1-6]", n["tag"]) else None
            states = [s for s in reducers.STATES if s in a or f"aria-{s}" in a]
            veil = any(m["last"] >= n["pre"] and ("hidden" in m["attrs"] or m["attrs"].get("aria-hidden") == "true") for m in nodes[: n["pre"] + 1] if m["tag"] != "#text")
            found[n["pre"]] = (r, name, level, states, veil)
            kids[n["pre"]] = []
            kids[up[-1]["pre"] if up else -1].append(n["pre"])

    def sign(p):
        r, _, level, states, veil = found[p]
        shape[p] = digest("|".join([r, ",".join(states), "" if level is None else str(level), str(veil).lower()]), *[sign(c) for c in kids[p]])
        return shape[p]

    same = [(found[p][0], found[p][1]) for p in sorted(found)]

    def walk(parent, depth):
        for members, region in runs(kids[parent], shape):
            for p in members[:1] if region else members:
                r, name, *_, veil = found[p]
                at = sum(same[k] == (r, name) for k, q in enumerate(sorted(found)) if q <= p)
                label = r + (f' "{name}"' if name else "") + (f" #{at}" if same.count((r, name)) > 1 else "")
                out.append((p, depth, label, r, name, veil, "region" if region else "node", len(members) if region else None))
                walk(p, depth + 1)

    for p in kids[-1]:
        sign(p)
    walk(-1, 0)
    return [e for e in out if e[1] <= reducers.MAX_DEPTH]


@pytest.fixture(scope="module")
def pages(spark, tiny):
    """The small pages and one that has what they lack, and an empty one."""
    more = spark.createDataFrame([(-1, EXTRA), (-2, "<p>x"), (-3, None)], "page_id long, html string")
    return spark.read.parquet(f"{tiny}/pages.parquet").select("page_id", "html").unionByName(more)


def test_dom_entries(spark, pages):
    columns = ("pre", "start", "label", "depth", "kind", "observed", "declared", "complete")
    got = {}
    for r in reducers.dom_entries(pages).collect():
        got.setdefault(r["page_id"], []).append(tuple(r[c] for c in columns))
    for r in pages.collect():
        want = plain_dom(r["html"]) if r["html"] else []
        assert sorted(got.get(r["page_id"], []), key=lambda e: e[1]) == sorted(want, key=lambda e: e[1]), r["page_id"]
    labels = {e[2] for e in got[-1]}
    assert "div.a.b > div.w > section.s.x > p" in labels
    assert {(e[2], e[5], e[6], e[7]) for e in got[-1] if e[4] == "region"} >= {("li", 3, 9, False), ("tr", 2, 2, True)}


def test_ax_entries(spark, pages):
    columns = ("pre", "depth", "label", "role", "name", "ignored", "kind", "observed")
    got = {}
    for r in reducers.ax_entries(reducers.ax_nodes(pages)).collect():
        got.setdefault(r["page_id"], []).append(tuple(r[c] for c in columns))
    for r in pages.collect():
        want = plain_ax(r["html"]) if r["html"] else []
        assert sorted(got.get(r["page_id"], [])) == sorted(want), r["page_id"]
    assert {'button "Go" #1', 'button "Go" #2', 'link "First"', 'heading "Head ing"', 'img "pic"'} <= {e[2] for e in got[-1]} and any(e[5] for e in got[-1])


def test_enclosing(spark):
    """The nearest marked node around each, also where the array has gaps."""
    rows = [[(0, 9, True), (2, 4, False), (3, 3, True), (5, 9, True), (6, 7, False), (7, 7, True), (9, 9, False)], [], None]
    df = spark.createDataFrame([(r,) for r in rows], "n array<struct<pre: int, last: int, m: boolean>>")
    got = df.select(trees.enclosing(F.col("n"), lambda n: n["m"]).alias("a"), trees.enclosing(F.col("n"), lambda n: n["m"], itself=True).alias("b")).collect()
    assert [tuple(r) for r in got] == [([None, 0, 0, 0, 5, 5, 5], [0, 0, 3, 5, 5, 7, 5]), ([], []), (None, None)]
