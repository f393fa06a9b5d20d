"""Windows, runs and integrity against plain loops."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from pagespine import scratch
from pagespine.operators import sequences as S


def plain_pages(bound, limit, slack):
    """[(offset, returned)]: a walk from page to page."""
    total, start, out = len(bound), 0, []
    while start < total:
        end = min(start + limit, total)
        if end < total and bound[end]:
            first = end
            while first > start and bound[first]:
                first -= 1
            last = first + 1
            while last < total and bound[last]:
                last += 1
            end = last if last <= start + limit + slack or first == start else first
        out.append((start, end - start))
        start = end
    return out


@pytest.mark.parametrize("limit, slack", [(3, 1), (5, 0), (4, 8), (1, 0)])
def test_bound_pages(spark, limit, slack):
    rng = random.Random(limit)
    scopes = {s: [rng.random() < p for _ in range(n)] for s, (n, p) in enumerate([(1, 0.5), (7, 0.0), (40, 0.5), (60, 0.9), (33, 1.0), (90, 0.3)])}
    for bound in scopes.values():
        bound[0] = False
    df = spark.createDataFrame([(s, i, b) for s, bs in scopes.items() for i, b in enumerate(bs)], "scope int, pos long, bound boolean")
    got = {}
    for r in S.bound_pages(df, "scope", limit, slack).collect():
        got.setdefault(r["scope"], []).append((r["page"], r["offset"], r["returned"], r["total"]))
    assert {s: sorted(v) for s, v in got.items()} == {s: [(k + 1, *p, len(b)) for k, p in enumerate(plain_pages(b, limit, slack))] for s, b in scopes.items()}


def test_running_sum(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(50), i, rng.randrange(-3, 9)) for i in range(500)]
    got = {r["i"]: r["s"] for r in scratch.running(spark.createDataFrame(rows, "k int, i int, v int"), [F.col("k"), F.col("i")], "v", "s").collect()}
    order = sorted(rows)
    assert got == dict(zip([r[1] for r in order], itertools.accumulate(r[2] for r in order)))


def test_digest_runs(spark):
    """Also where nulls stand, a key has one row, and one key holds most of the rows."""
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.8 else f"k{rng.randrange(30)}", rng.choice([None, "f"]), i, rng.choice(["a", "a", "a", "b", None])) for i in range(800)]
    want = []
    for key, group in itertools.groupby(sorted(rows, key=lambda r: (r[0], r[1] or "", r[2])), key=lambda r: r[:2]):
        for n, (digest, run) in enumerate(itertools.groupby(group, key=lambda r: r[3])):
            run = list(run)
            want.append((*key, n + 1, digest, run[0][2], run[-1][2], len(run)))
    df = spark.createDataFrame(rows, "domain string, field string, seq int, digest string")
    got = [tuple(r) for r in S.digest_runs(df.withColumn("field", F.coalesce("field", F.lit(""))), ["domain", "field"], "seq", "digest").collect()]
    assert sorted(got, key=repr) == sorted([(a, b or "", *rest) for a, b, *rest in want], key=repr)


def test_planted_faults(spark, tiny):
    good = [(0, -1, 5, 0), (1, 0, 2, 1), (2, 1, 2, 2), (3, 0, 5, 1), (4, 3, 4, 2), (5, 3, 5, 2)]
    plant = {
        "repeated": good + [(2, 1, 2, 2)], "orphan": [*good[:4], (4, 9, 4, 2), good[5]], "backward": [*good[:5], (5, 5, 5, 2)], "outside": [good[0], (1, 0, 2, 1), (2, 1, 3, 2), *good[3:]],
        "crossing": [good[0], (1, 0, 3, 1), *good[2:]], "depth": [*good[:4], (4, 3, 4, 1), good[5]], "gap": [g for g in good if g[0] != 4],
    }
    rows = [(name, *n) for name, nodes in plant.items() for n in nodes] + [("good", *n) for n in good]
    got = {}
    for r in S.tree_faults(spark.createDataFrame(rows, "page_id string, pre int, parent int, last int, depth int")).collect():
        got.setdefault(r["page_id"], set()).add((r["pre"], r["fault"]))
    assert "good" not in got
    at = {"repeated": 2, "orphan": 4, "backward": 5, "outside": 2, "crossing": 3, "depth": 4, "gap": 5}
    assert all((at[name], name) in got[name] for name in plant), got


def test_trace_faults(spark):
    rows = [(1, 1, 10, 200), (1, 2, 20, 99), (1, 3, 15, 404), (1, 3, 30, 500), (2, 1, 5, 200)]
    got = {tuple(r) for r in S.trace_faults(spark.createDataFrame(rows, "t int, id int, at int, status int"), "t", "id", "at", "status").collect()}
    assert {f for *_, f in got} == {"status", "order", "repeated"} and all(t == 1 for t, *_ in got) and (1, 2, "status") in got
