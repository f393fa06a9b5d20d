"""The similarity join of feature sets against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from pagespine.operators import observe, similar


def weights_of(spark, sets, layer):
    names = sorted({x for s in sets for x in s[layer]})
    df = spark.createDataFrame([(x,) for x in names], "x string")
    return {r["x"]: r["w"] for r in df.select("x", observe.weight(layer, F.col("x")).alias("w")).collect()}


def wj(weights, a, b):
    union = sum(weights[x] for x in set(a) | set(b))
    return sum(weights[x] for x in set(a) & set(b)) / union if union else 1.0


@pytest.mark.parametrize("block", [512, 3])
def test_join_of_random_sets(spark, monkeypatch, block):
    """Every pair at or over the bound is a candidate, once; also when lists are cut into many blocks."""
    monkeypatch.setattr(similar, "BLOCK", block)
    rng = random.Random(11)
    vocabulary, w = [f"x{i}" for i in range(40)], {}
    for x in vocabulary:
        w[x] = rng.choice([0.35, 1.0, 1.75, 3.0])
    sets = [{x for x in rng.sample(vocabulary, rng.randrange(1, 12))} for _ in range(120)]
    sets = [s if rng.random() < 0.5 else (sets[rng.randrange(len(sets))] | {rng.choice(vocabulary)}) for s in sets]
    df = spark.createDataFrame([(i, [(x, w[x]) for x in sorted(s)]) for i, s in enumerate(sets)], "id long, items array<struct<item: string, weight: double>>")
    for bound in (0.4, 0.75):
        got = [tuple(r) for r in similar.similar_pairs(df, bound).collect()]
        assert len(got) == len(set(got)) and all(a < b for a, b in got)
        want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if wj(w, sets[i], sets[j]) >= bound}
        assert want and want <= set(got) and len(got) < len(sets) * (len(sets) - 1) / 2


def test_page_pairs(spark, small):
    """All pairs of feature sets of sf0.01 that have one shape, by brute force, with their scores: recall 1."""
    pages = similar.sectioned(spark.read.parquet(f"{small}/pages.parquet"))
    sets = {r["id"]: r["own"].asDict() for r in similar.feature_sets(observe.features(pages)).collect()}
    weights = {layer: weights_of(spark, sets.values(), layer) for layer in ("skeleton", "semantic", "identity")}
    want = {}
    for a in sets:
        for b in sets:
            x, y = sets[a], sets[b]
            if a < b and min(len(x["skeleton"]), len(y["skeleton"])) >= observe.MIN_SKELETON:
                scores = {k: wj(weights[k], x[k], y[k]) for k in weights if k != "identity" or min(len(x[k]), len(y[k])) >= observe.MIN_OPTIONAL}
                if all(v >= observe.THRESHOLDS[k] for k, v in scores.items()):
                    want[a, b] = sum(scores.values()) / len(scores)
    got = {(r["a"], r["b"]): r["score"] for r in similar.QUERIES["page_pairs"](spark, small).collect()}
    assert want and got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}
    member = similar.QUERIES["page_feature_sets"](spark, small).collect()
    assert len(member) == pages.count() and {r["feature_set"] for r in member} == set(sets)


def test_six_layers(spark):
    """Layers that structs carry take part, each with its own weights; one of the optional ones vetoes."""
    skeleton, semantic = [f"div/p.c{i}" for i in range(9)], ["lm:main", "h1:lo"]
    ax, network = ["ax:link", "ax:main", "ax:button"], ["hdr:server", "hdr:date", "cookie:sid"]
    full = lambda endpoint, net=network: (skeleton, semantic, [], ax, net, endpoint)
    schema = "own struct<skeleton: array<string>, semantic: array<string>, identity: array<string>, ax: array<string>, network: array<string>, endpoint: array<string>>"
    ends = ["ep:a/x", "ep:a/y", "ep:a/z"]
    rows = [(full(ends), full(ends)), (full(ends), full(["ep:b/x", "ep:b/y", "ep:b/z"])), (full(ends), full(["ep:b/x"])), (full(ends), full(ends, ["hdr:server", "hdr:date", "hdr:etag", "cookie:other"]))]
    got = observe.match(spark.createDataFrame(rows, f"{schema}, {schema.replace('own', 'their', 1)}")).collect()
    assert [r["same_shape"] for r in got] == [True, False, True, False]
    assert got[0]["score"] == 1.0 and got[2]["score"] == 1.0
    assert got[3]["score"] == pytest.approx((4 + (1.0 + 0.25) / (1.0 + 0.25 + 0.25 + 1.5 + 1.5)) / 5, abs=1e-6)


def test_features_are_weighed_once_a_set(spark, small):
    """Pairs are compared by weights that stand beside the sets, and dealt anew before: a pair costs no pattern."""
    pages = similar.sectioned(spark.read.parquet(f"{small}/pages.parquet").limit(40))
    sets = similar.written(similar.feature_sets(observe.features(pages)), "sets")
    both = observe.with_weights(sets)
    a = both.select(F.col("id").alias("a"), "own", F.col("weights").alias("own_weights"))
    b = both.select(F.col("id").alias("b"), F.col("own").alias("their"), F.col("weights").alias("their_weights"))
    pairs = a.join(b, F.col("a") < F.col("b"))
    shown = lambda df: sorted(tuple(r) for r in df.select("a", "b", "score", "containment_score", "same_shape").collect())
    assert shown(observe.match(pairs)) == shown(observe.match(pairs.drop("own_weights", "their_weights")))
    compared = similar.compared(pairs.select("a", "b"), "a", sets, "b", sets)
    assert shown(compared) == shown(observe.match(pairs))
    plan = compared._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "RepartitionByExpression" in plan
