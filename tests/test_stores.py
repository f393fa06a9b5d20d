"""Streams that keep state: frontiers that resume, counters that add once, logs of classes; elements found again."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from pagespine.operators import observe, references, similar
from pagespine.streaming import frontier, stores

from .test_similar import weights_of, wj

FOUND = "url string, score double, depth int, ord long, ts timestamp"


def batches(spark, folder, parts, first=0):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, FOUND).coalesce(1).write.parquet(f"{folder}/part{first + k:03d}")


def crawl_rows(seed):
    rng, start = random.Random(seed), datetime.datetime(2024, 1, 1)
    parts = []
    for b in range(6):
        rows = [(f"http://h{rng.randrange(3)}.test/p{rng.randrange(12)}", rng.randrange(10) / 10, 1, 100 * b + i, start + datetime.timedelta(seconds=10 * b)) for i in range(8)]
        parts.append(rows + [("not a url", 1.0, 1, 0, start)])
    # later times let the timers of what is still pending expire
    return parts + [[(f"http://h{h}.test/last", 0.0, 1, 900 + h, start + datetime.timedelta(seconds=t)) for h in range(3)] for t in (500, 1000)]


@pytest.fixture
def rocks(spark):
    was = {k: spark.conf.get(k, None) for k in frontier.PROVIDER}
    for k, v in frontier.PROVIDER.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run(spark, folder, out, checkpoint):
    stream = spark.readStream.schema(FOUND).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    q = frontier.frontier(stream, delay_seconds=5).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert not q.isActive and q.exception() is None


def test_frontier_resumes(spark, rocks, tmp_path):
    """A stream that was stopped twice pops what one uninterrupted run does, in that order, each URL once."""
    parts = crawl_rows(6)
    batches(spark, tmp_path / "whole", parts)
    run(spark, tmp_path / "whole", str(tmp_path / "a"), str(tmp_path / "ca"))
    for at, until in ((0, 3), (3, 5), (5, len(parts))):
        batches(spark, tmp_path / "cut", parts[at:until], at)
        run(spark, tmp_path / "cut", str(tmp_path / "b"), str(tmp_path / "cb"))
    one, two = (sorted(map(tuple, spark.read.parquet(str(tmp_path / x)).collect())) for x in "ab")
    assert one and one == two
    assert len({r[1] for r in one}) == len(one)
    for host in {r[0] for r in one}:
        places = sorted(r[4] for r in one if r[0] == host)
        assert places == list(range(1, len(places) + 1))
        times = [r[5] for r in sorted((r for r in one if r[0] == host), key=lambda r: r[4])]
        assert all((b - a).total_seconds() >= 5 for a, b in zip(times, times[1:]))


def plain_counts(rows):
    out = {}
    for key, order, ok in sorted(rows, key=lambda r: r[1]):
        n, failed, good, tail, _ = out.get(key, (0, 0, 0, 0, None))
        out[key] = (n + 1, failed + (not ok), good + ok, 0 if ok else tail + 1, order)
    return out


def test_counters_add_once(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.choice("abc") if rng.random() < 0.5 else "hot", i, rng.random() < 0.4) for i in range(200)]
    schema, path = "k string, i int, ok boolean", str(tmp_path / "store")
    for b in range(5):
        spark.createDataFrame(rows[40 * b : 40 * b + 40], schema).coalesce(1).write.parquet(str(tmp_path / f"in/p{b}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    stores.count_replays(stream, path, str(tmp_path / "c"), ["k"], "i", "ok").awaitTermination(120)
    told = lambda: {r["k"]: tuple(r)[1:] for r in stores.read_counters(spark, path, ["k"]).select("k", "replays", "failures", "verified", "tail", "last").collect()}
    want = plain_counts(rows)
    assert told() == want
    # a batch that runs again writes the same delta again
    stores.deltas(spark.createDataFrame(rows[160:], schema), ["k"], "i", "ok").write.mode("overwrite").parquet(f"{path}/delta=4")
    assert told() == want
    stores.compact(spark, path, ["k"])
    assert told() == want and len(list((tmp_path / "store").iterdir())) == 1
    stores.deltas(spark.createDataFrame([("hot", 999, False)], schema), ["k"], "i", "ok").write.parquet(f"{path}/delta=5")
    assert told() == plain_counts([*rows, ("hot", 999, False)])


def test_scope_keys(spark):
    rows = [("http://a.test/x?b=1&a=2", "a.test"), ("http://a.test/x?a=9&b=3", "a.test"), ("http://a.test/x?a=9", "a.test"), ("http://a.test", "a.test"), ("http://a.test/", "a.test")]
    a, b, c, d, e = (r["k"] for r in spark.createDataFrame(rows, "u string, d string").select(stores.scope_key(F.col("u"), F.col("d")).alias("k")).collect())
    assert a == b != c and d == e and a.startswith("scope:v1:") and len(a) == 41


def test_classes(spark, tiny, tmp_path):
    """Against brute force over all references; a stream of pages classifies as the batch query does."""
    pages = similar.sectioned(spark.read.parquet(f"{tiny}/pages.parquet"))
    stored = references.references(pages.filter("page_id % 2 = 0")).cache()
    got = {r["page_id"]: (r["reference"], r["status"]) for r in references.classified(pages, stored).collect()}
    own = {r["page_id"]: r.asDict() for r in observe.features(pages).collect()}
    refs = {r["id"]: r["own"].asDict() for r in stored.collect()}
    weights = {k: weights_of(spark, [*own.values(), *refs.values()], k) for k in ("skeleton", "semantic", "identity")}
    for page, f in own.items():
        best = []
        for ref, g in refs.items():
            scores = {k: wj(weights[k], f[k], g[k]) for k in weights if k != "identity" or min(len(f[k]), len(g[k])) >= observe.MIN_OPTIONAL}
            if min(len(f["skeleton"]), len(g["skeleton"])) >= observe.MIN_SKELETON and all(v >= observe.THRESHOLDS[k] for k, v in scores.items()):
                best.append((round(sum(scores.values()) / len(scores), 9), ref))
        top = [r for s, r in best if s >= max(best)[0] - 1e-8]
        assert got[page] == ((None, "none") if not top else (min(top), "match" if len(top) == 1 else "ambiguous")), page
    for part in range(2):
        pages.filter(f"page_id % 2 = {part}").coalesce(1).write.parquet(str(tmp_path / f"in/p{part}"))
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    stores.log_classes(stream, stored, str(tmp_path / "log"), str(tmp_path / "c")).awaitTermination(240)
    assert {r["page_id"]: (r["reference"], r["status"]) for r in spark.read.parquet(str(tmp_path / "log")).collect()} == got
    stored.unpersist()


def test_found_again(spark):
    """Elements of a page in an edited version: precision and recall over those that can be told apart."""
    page = '<html><body><nav><a href="/a" id="home">Home</a><a href="/b">Shop</a></nav><main><h1>Title</h1><div class="card big"><h2>One</h2><p>first text</p></div><div class="card"><h2>Two</h2><p>second text</p></div><form><input name="q"><button data-testid="go">Go</button></form></main></body></html>'
    edited = page.replace("<nav>", '<div class="promo"><p>New here</p></div><nav>').replace("<h1>Title</h1>", "<h1>Other title</h1>").replace('<div class="card big">', '<div class="wrap"><div class="card big">').replace("first text</p></div>", "first text</p></div></div>").replace(">Go<", ">Search<")
    seen = [references.observations(spark.createDataFrame([(1, t)], "page_id long, html string")).cache() for t in (page, edited)]
    got = {r["pre"]: r["found"] for r in references.found_again(*seen).collect()}
    sign = lambda df: {r["pre"]: (r["tag"], tuple(sorted(r["identity"].items())), tuple(r["classes"]), r["text"]) for r in df.collect()}
    a, b = map(sign, seen)
    truth = {("a", "Home"): None, ("a", "Shop"): None, ("h2", "One"): None, ("h2", "Two"): None, ("p", "first text"): None, ("p", "second text"): None, ("input", None): None}
    for pre, (tag, identity, classes, text) in a.items():
        if (tag, text) in truth:
            assert got[pre] is not None and (b[got[pre]][0], b[got[pre]][3]) == (tag, text)
        if ("data-testid", "go") in identity or tag == "h1":
            assert b[got[pre]][0] == tag and b[got[pre]][1] == identity
    found = [(p, f) for p, f in got.items() if f is not None]
    assert sum(a[p][0] == b[f][0] for p, f in found) == len(found) and len(found) >= 0.8 * len(a)
    first = seen[0].filter("tag = 'h2' AND text = 'Two'").first()
    assert (first["parent_tag"], first["ancestry"], first["siblings"]) == ("div", ["html", "body", "main", "div"], ["p"])
