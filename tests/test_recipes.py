"""Recipes and the contract store; robots rules against the standard library's parser; targets of contracts."""

import json
import random
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from pagespine.operators import crawl
from pagespine.plans import recipes
from pagespine.plans.contract import extract, typed

RECIPE = {
    "contract": {"name": "Offer", "schema_version": 1, "fields": [{"name": "name", "type": "title", "required": True}, {"name": "price", "type": "price", "default": 0.0}, {"name": "link", "type": "url"}]},
    "selectors": {"shop.test": {"root": ".card", "fields": {"name": {"primary": {"type": "css", "value": ".none"}, "fallback": {"type": "css", "value": "h2"}, "discovered_at": "2024"}, "price": {"primary": {"type": "css", "value": ".p"}}, "link": {"primary": {"type": "attr", "value": "a", "name": "href"}}}}},
    "metadata": {"created_at": "2024-01-01", "source_urls": ["https://shop.test/"]},
}
HTML = '<div class="card"><h2>One</h2><b class="p">$1.50</b><a href="https://shop.test/1">x</a></div><div class="card"><h2>Two</h2><b class="p">free</b></div>'


def test_a_recipe_is_its_content():
    own = recipes.recipe_id(RECIPE)
    moved = json.loads(json.dumps(RECIPE, sort_keys=True))
    moved["metadata"]["created_at"] = "2030"
    moved["selectors"]["shop.test"]["fields"]["name"]["discovered_at"] = "2031"
    moved["instructions"] = ["read me"]
    assert recipes.recipe_id(moved) == own and own.startswith("sha256:") and len(own) == 71
    moved["selectors"]["shop.test"]["fields"]["price"]["primary"]["value"] = ".q"
    assert recipes.recipe_id(moved) != own
    assert recipes.loaded(json.dumps(RECIPE | {"recipe_id": own}))["recipe_id"] == own
    with pytest.raises(ValueError):
        recipes.loaded(json.dumps(RECIPE | {"recipe_id": "sha256:0"}))


def test_a_recipe_extracts(spark):
    c = recipes.to_contract(RECIPE, "www.shop.test")
    pages = spark.createDataFrame([(1, "https://shop.test/x", HTML)], "page_id long, url string, html string")
    got = [(r["name"], r["price"]) for r in typed(extract(pages, c), c).collect()]
    assert sorted(got) == [("One", 1.5), ("Two", 0.0)]
    assert recipes.selectors_for(RECIPE, "other.test") is None and recipes.to_contract(RECIPE, "other.test").container is None
    over = recipes.to_contract(RECIPE, "shop.test", {"name": "//h2"}).fields[0].cascade
    assert [(s.kind, s.value) for s in over] == [("xpath", "//h2"), ("css", ".none"), ("css", "h2")]
    assert recipes.root_fingerprint(".card") == recipes.root_fingerprint({"type": "css", "value": ".card"}) != recipes.root_fingerprint("//div")


def test_contract_store(spark, tmp_path):
    store = recipes.ContractStore(spark, str(tmp_path))
    own = store.add(RECIPE["contract"])
    assert store.add(RECIPE["contract"]) == own == store.add(RECIPE["contract"], "other name")
    assert store.get("Offer") == store.get(own) == store.get("other name") == RECIPE["contract"]
    assert store.specs().count() == 1 and store.aliases().count() == 2
    with pytest.raises(recipes.Collision):
        store.add(RECIPE["contract"] | {"fields": [{"name": "x"}]}, "Offer")
    with pytest.raises(KeyError):
        store.get("nothing")
    for bad in ({"name": "a", "fields": []}, {"name": "a", "schema_version": 9, "fields": [{"name": "x"}]}, {"name": "a", "fields": [{"name": "x"}, {"name": "x"}]}):
        with pytest.raises(ValueError):
            store.add(bad)


def test_robots(spark):
    """Random files, against the standard library."""
    rng = random.Random(4)
    lines = ["User-agent: *", "user-agent: bot", "User-Agent: botany", "Disallow: /a", "Disallow: /a%20b", "Allow: /a/b", "Disallow:", "Disallow: *", "", "# note", "Allow: / # all", "Crawl-delay: 5", "junk", "Disallow: /c?x=1", "Sitemap: https://x/s"]
    files = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(9))) for _ in range(60)]
    urls = ["/", "/a", "/a/b/c", "/a b", "/a%20b/x", "/c?x=1&y", "/c", "/zzz", ""]
    robots = spark.createDataFrame([(f"h{i}.test", t) for i, t in enumerate(files)], "host string, text string")
    asked = spark.createDataFrame([(f"https://h{i}.test{u}", f"h{i}.test") for i in range(len(files) + 1) for u in urls if " " not in u], "url string, host string")
    for agent in ("*", "bot", "Bot/1.0"):
        for r in crawl.robots_allowed(asked, robots, agent).collect():
            i = int(r["host"][1:-5])
            if i == len(files):
                assert r["allowed"]
                continue
            plain = RobotFileParser()
            plain.parse(files[i].splitlines())
            assert r["allowed"] == plain.can_fetch(agent, r["url"]), (agent, files[i], r["url"])


def test_targets(spark):
    rows = [("u1", 1, "succeeded", "text/html", 1, 0.9, 1, 0, "a"), ("u2", 2, "succeeded", None, 0, 0.5, 3, 1, "a"), ("u3", 3, "failed", "text/html", 0, 0.9, 1, 0, "b"), ("u4", 4, "succeeded", "image/png", 0, 0.9, 1, 0, "c"), ("u5", 5, "succeeded", "text/html; x", 0, 0.5, 3, 2, "a"), ("u6", 6, "succeeded", "text/html", 0, 0.1, 3, 2, "d")]
    results = spark.createDataFrame(rows, "url string, ord int, status string, content_type string, artifact int, evidence double, links int, depth int, cluster string")
    contracts = spark.createDataFrame([("A", None), ("B", 2)], "name string, limit int")
    got = {(r["contract"], r["place"]): r["url"] for r in crawl.contract_targets(results, contracts, 10).collect()}
    assert got == {("A", 1): "u5", ("A", 2): "u6", ("A", 3): "u2", ("A", 4): "u1", ("B", 1): "u5", ("B", 2): "u6"}
