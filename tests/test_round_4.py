"""Findings of round 4: pairs are neither sorted nor stored, whatever lies within reach of what."""

import math

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators import clustering, evidence, leaders, passes, pieces, references


def test_nearest_of_meets_brute_force():
    rng = np.random.default_rng(4)
    for n, m, cap, wide in ((200, 900, 30.0, 400.0), (300, 5, 500.0, 400.0), (50, 4000, 480.0, 300.0), (40, 300, 5.0, 60.0)):
        px, py, qx, qy = (np.round(rng.uniform(-wide, wide, k)) for k in (n, n, m, m))
        qy = np.zeros(m) if m == 300 else np.abs(qy)
        best, dist = evidence.nearest_of(px, py, qx, qy, cap)
        apart = np.sqrt((px[:, None] - qx) ** 2 + (py[:, None] - qy) ** 2)
        near = apart.min(axis=1) <= cap
        assert (best == np.where(near, apart.argmin(axis=1), -1)).all()
        assert (dist == np.where(near, apart.min(axis=1), math.inf)).all()


def test_nearest_in_a_crowd_makes_no_pairs_outside_a_worker(spark):
    rng = np.random.default_rng(5)
    p = [(i % 2, i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(-90, 90, (300, 2)))] + [(0, 900, math.nan, 1.0), (None, 901, 0.0, 0.0)]
    q = [(i % 2, i // 3, float(x), float(y), float(x) + i % 40, float(y) + i % 7) for i, (x, y) in enumerate(rng.integers(-90, 90, (2000, 2)))] + [(0, 9000, None, 1.0, 2.0, 3.0)]
    points = spark.createDataFrame(p, "k int, pid int, px double, py double")
    lines = spark.createDataFrame(q, "k int, sid int, x0 double, y0 double, x1 double, y1 double")
    near = evidence.nearest_point(points, lines, ["k"], "pid", ("px", "py"), ("x0", "y0"), ["sid"], 25.0)
    touch = evidence.nearest_segment(points, lines, ["k"], 25.0)
    for df in (near, touch):
        assert "MapInArrow" in df._jdf.queryExecution().executedPlan().toString()
    at = {k: [r for r in q if r[0] == k and r[2] is not None] for k in (0, 1)}
    want = {i: min((math.sqrt((x - r[2]) ** 2 + (y - r[3]) ** 2), r[1]) for r in at[k]) for k, i, x, y in p if k is not None and not math.isnan(x)}
    assert {r.pid: (r.d, r.sid) for r in near.collect()} == {i: w for i, w in want.items() if w[0] < 25}

    def gap(x, y, r):
        dx, dy = r[4] - r[2], r[5] - r[3]
        t = max(0.0, min(1.0, ((x - r[2]) * dx + (y - r[3]) * dy) / (dx * dx + dy * dy))) if dx * dx + dy * dy >= 1e-9 else 0.0
        ex, ey = x - r[2] - t * dx, y - r[3] - t * dy
        return math.sqrt(ex * ex + ey * ey)

    want = {i: min((gap(x, y, r), r[1]) for r in at[k]) for k, i, x, y in p if k is not None and not math.isnan(x)}
    assert {r.pid: (r.distance, r.sid) for r in touch.collect()} == {i: w for i, w in want.items() if w[0] < 25}


def test_blocks_are_summed_before_references_open_them(spark):
    refs = [("s", None, 1, 10, 1.0), ("s", None, 2, 10, 2.0), ("s", None, 2, 11, 3.0), ("s", None, 3, None, 1.0), ("s", 10, 4, 11, 5.0), ("s", 11, 5, 10, 7.0)]
    refs = spark.createDataFrame([(*r[:4], 0.0, -1.0, 1.0, 0.0, r[4], 1.0) for r in refs], "sheet string, block long, ref long, child long, a double, b double, c double, d double, tx double, ty double")
    ents = spark.createDataFrame([("s", b, e, t, p) for b, e, t, p in ((10, 1, "LINE", [(1.0, 2.0)]), (10, 2, "LINE", [(3.0, None)]), (11, 3, "LINE", [(5.0, 8.0), (0.0, 0.0)]), (11, 4, "HATCH", None), (11, 5, "TEXT", []))], "sheet string, block long, ent long, type string, points array<struct<x:double,y:double>>")
    tops, inside, _ = references.expand_blocks(refs, "sheet")
    at = F.get("points", F.lit(0))
    want = references.placed_by_blocks(ents, tops, inside, "sheet").groupBy("sheet", "outer", "type", "depth").agg(F.count(F.lit(1)).alias("n"), F.sum(at["x"]).alias("x"), F.sum(at["y"]).alias("y"))
    got = references.summed_by_blocks(ents, tops, inside, "sheet")
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))
    assert got.count() == 10


def _links(monkeypatch, module, n):
    """Counts of links that the module's components are given, to be no more than a few a thing."""
    met, plain = [], module.components
    monkeypatch.setattr(module, "components", lambda nodes, edges: met.append(edges.count()) or plain(nodes, edges))
    return met


def test_crowded_boxes_make_few_links(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(1, i, x, y, x + w, y + 9) for i, (x, y, w) in enumerate(zip(rng.uniform(0, 40, 400).tolist(), rng.uniform(0, 30, 400).tolist(), rng.uniform(1, 40, 400).tolist()))] + [(1, 900 + i, 500.0 + 3 * i, 0.0, 500.0 + 3 * i, 0.0) for i in range(4)] + [(1, 950, 800.0, 0.0, 801.0, 1.0)]
    met = _links(monkeypatch, clustering, len(rows))
    got = clustering.outline_components(spark.createDataFrame(rows, "k int, id int, x0 double, y0 double, x1 double, y1 double"), ["k"])
    assert {(r.component, r.n) for r in got.collect()} == {(0, 400), (900, 4)}
    assert met[0] < 20 * len(rows)


def test_crowded_circles_make_few_links(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(1, i, "abc"[i % 3], 8, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 9, (400, 2)))] + [(1, 900, "a", 8, 100.0, 0.0), (1, 901, "a", 8, 101.0, 0.0), (1, 902, "b", 8, 106.0, 6.0), (1, 903, "b", 8, 107.5, 6.0), (1, 904, "c", 9, 106.0, 6.0)]
    met = _links(monkeypatch, passes, len(rows))
    got = passes.cross_view_clusters(spark.createDataFrame(rows, "p int, id int, view string, dia int, x double, y double"), "p", 6.0)
    want = {(i, 0, 3) for i in range(400)} | {(900, 900, 2), (901, 900, 2), (902, 900, 2)}
    assert {(r.id, r.component, r.views) for r in got.collect()} == want
    assert met[0] < 20 * len(rows)


def test_titles_in_a_crowd_make_no_pairs_outside_a_worker(spark):
    rng = np.random.default_rng(8)
    v = [(1, i, float(x), float(y), 40.0, 20.0 * (i % 3), 1.0, 1.0, 10.0) for i, (x, y) in enumerate(rng.integers(0, 60, (60, 2)))] + [(1, 900, None, 0.0, 40.0, 20.0, 1.0, 1.0, 1.0)]
    t = [(1, float(x), float(y), f"t{i % 90}") for i, (x, y) in enumerate(rng.integers(0, 50, (500, 2)))] + [(1, None, 1.0, "none")]
    out = pieces.viewport_titles(spark.createDataFrame(v, "k int, view int, cx double, cy double, w double, h double, vx double, vy double, vh double"), spark.createDataFrame(t, "k int, tx double, ty double, s string"), ["k"])
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    want = {900: ""}
    for _, i, cx, cy, w, h, *_ in v[:-1]:
        near = [(math.sqrt((x - cx) ** 2 + (y - cy + h / 2) ** 2), x, y, s) for _, x, y, s in t[:-1] if abs(x - cx) <= w * 1.3 / 2 and cy - h * 1.3 / 2 - h * 0.25 <= y <= cy + h * 1.3 / 2]
        want[i] = min(near)[3] if near else ""
    assert {r.view: r.title for r in out.collect()} == want


def test_tips_are_searched_once(spark, monkeypatch):
    held, plain = [], leaders.stored
    monkeypatch.setattr(leaders, "stored", lambda df, name: held.append(name) or plain(df, name))
    tips = spark.createDataFrame([("s", 1, 5.0, 5.0)], "sheet string, inst int, tip_x double, tip_y double")
    views = spark.createDataFrame([("s", "v", 1, 0.0, 0.0, 10.0, 10.0)], "sheet string, view string, rank int, x0 double, y0 double, x1 double, y1 double")
    bars = spark.createDataFrame([("s", "v", 7, 8, 0.0, 9.0, 10.0, 9.0)], "sheet string, view string, bar int, dia int, x1 double, y1 double, x2 double, y2 double")
    out = leaders.bind_tips(tips, views, bars, spark.createDataFrame([("s", 1, 8)], "sheet string, inst int, dia int"), "sheet")
    assert [(r.bar, r.dist, r.status) for r in out.collect()] == [(7, 4.0, "ok")] and held == ["tips", "asked"]
