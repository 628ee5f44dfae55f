"""Range joins by cells, hull corners, places over a table, and folds by islands, against plain loops."""

import random
from math import hypot

import pytest
from pyspark.sql import functions as F

from plumbline.operators import clustering, joins, passes, pieces, ranking


@pytest.mark.parametrize("seed", range(2))
def test_values_within_a_growing_tolerance(spark, seed):
    rng = random.Random(seed)
    a = [(rng.choice([1, 2]), rng.choice([rng.uniform(-50, 50), rng.uniform(0, 9000), None])) for _ in range(60)]
    b = [(rng.choice([1, 2]), rng.choice([rng.uniform(-50, 50), rng.uniform(0, 9000), None])) for _ in range(90)]
    got = {tuple(r) for r in joins.near_values(spark.createDataFrame(a, "k int, x double"), spark.createDataFrame(b, "k int, y double"), ["k"], "x", "y", 30.0, 0.08).collect()}
    assert got == {(k, x, y) for k, x in a for m, y in b if k == m and x is not None and y is not None and abs(y - x) <= max(30.0, 0.08 * x)}


@pytest.mark.parametrize("seed", range(3))
def test_farthest_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [(1, i, rng.gauss(0, 9), rng.gauss(0, 4)) for i in range(200)] + [(2, i, float(rng.randint(0, 3)), float(rng.randint(0, 2))) for i in range(40)]
    rows += [(3, i, 5.0, 5.0) for i in range(7)] + [(4, 1, 1.0, 1.0), (5, 1, 0.0, 0.0), (5, 2, 3.0, 3.0), (5, 3, 1.0, 1.0), (6, 1, None, 1.0), (6, 2, 1.0, 1.0)] + [(7, i, float(i), 2.0 * i) for i in range(50)]
    rng.shuffle(rows)
    got = {r.k: (r.id_a, r.id_b, r.d) for r in pieces.farthest_pair(spark.createDataFrame(rows, "k int, id int, x double, y double").repartition(5), ["k"]).collect()}
    want = {}
    for k in range(1, 8):
        mine = sorted((i, x, y) for m, i, x, y in rows if m == k and x is not None)
        pairs = [(-hypot(x - u, y - v), i, j) for i, x, y in mine for j, u, v in mine if i < j]
        if pairs:
            d, i, j = min((round(p[0], 9), *p[1:]) for p in pairs)
            want[k] = (i, j, pytest.approx(-d, abs=1e-8))
    assert got == want


def test_places_over_a_whole_table(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, rng.randint(0, 9)])) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, v int").repartition(6)
    got = {r.i: r.place for r in ranking.global_rank(df, [F.desc("v"), F.col("i")], "place").collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {i: n for n, (i, _) in enumerate(order, 1)}
    assert ranking.global_rank(df.limit(0), [F.col("i")], "place").count() == 0


@pytest.mark.parametrize("tol, rel", [(5.0, 0.0), (1.0, 0.1)])
def test_folds_by_islands(spark, tol, rel):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, None]), rng.choice([round(rng.uniform(-40, 400), 1), None])) for _ in range(300)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = {(r.k, r.group_no): (r.anchor, r.n) for r in clustering.anchor_groups(df, ["k"], "v", tol, rel).collect()}
    emitted = {}
    for r in clustering.debounced(df, ["k"], "v", tol).collect():
        emitted.setdefault(r.k, []).append(r.v)
    want, out = {}, {}
    for k in (1, 2, None):
        anchor, last, number = None, None, -1
        for v in sorted(x for m, x in rows if m == k and x is not None):
            if anchor is None or v - anchor > max(tol, rel * anchor):
                anchor, number = v, number + 1
                want[k, number] = (v, 0)
            want[k, number] = (anchor, want[k, number][1] + 1)
            if last is None or v - last > tol:
                last = v
                out.setdefault(k, []).append(v)
    assert got == want and {k: sorted(v) for k, v in emitted.items()} == out


@pytest.mark.parametrize("seed", range(2))
def test_spans_on_cuts_and_mirrors(spark, seed):
    rng = random.Random(seed)
    spans = [(rng.choice([1, 2, 3]), float(a), float(a + rng.randint(0, 9))) for a in (rng.randint(0, 60) for _ in range(30))]
    cuts = [(rng.choice([1, 2, 3]), float(rng.randint(-5, 75))) for _ in range(3)] + [(1, None)]
    got = {r.k: (r.lo, r.hi, r.on_cut) for r in passes.cut_extent(spark.createDataFrame(spans, "k int, lo double, hi double"), spark.createDataFrame(cuts, "k int, at double"), "k").collect()}
    want = {}
    for k in {s[0] for s in spans}:
        merged = []
        for lo, hi in sorted(s[1:] for s in spans if s[0] == k):
            if merged and lo <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], hi)
            else:
                merged.append([lo, hi])
        on = [(any(m == k and c is not None and lo <= c <= hi for m, c in cuts), hi - lo, -lo) for lo, hi in merged]
        flag, width, lo = max(on)
        want[k] = (-lo, -lo + width, flag)
    assert got == want
    bars = [(rng.choice([1, 2]), i, float(rng.randint(0, 100))) for i in range(25)]
    df = spark.createDataFrame(bars, "k int, i int, x double").withColumn("w", F.lit(100.0))
    added = {(r.k, r.i) for r in passes.mirror_fill(df, "k", "x", "w", 3.0).filter("mirrored").collect()}
    assert added == {(k, i) for k, i, x in bars if not any(m == k and abs(y - (100 - x)) <= 3 for m, _, y in bars)}
