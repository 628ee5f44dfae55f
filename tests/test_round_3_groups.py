"""Findings of round 3 on groups, pairs and searches, each by a small input on which the code before it failed."""

import math
import random
import time
from contextlib import redirect_stdout
from io import StringIO

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators import attendance, binding, chaining, clashes, dealing, filling, passes, pieces, summaries


def plan(df) -> str:
    out = StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_groups_are_passed_through_in_order(spark):
    """Groups across Arrow batches, null and repeated keys, more rows out than a batch holds."""
    rng = random.Random(0)
    rows = [(rng.choice([None, 1, 2, 3]), i, rng.randint(0, 9)) for i in range(30000)]
    df = spark.createDataFrame(rows, "k int, i int, v int")
    got = dealing.in_groups(df, ["k"], ["v", "i"], lambda g: [(g[0][0], len(g), j, r[1]) for j, r in enumerate(g)], "k int, n int, j int, i int").collect()
    want = []
    for k in (None, 1, 2, 3):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1]))
        want += [(k, len(own), j, r[1]) for j, r in enumerate(own)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert dealing.in_groups(df.filter("false"), ["k"], [], lambda g: [(1,)], "n int").count() == 0


def test_chains_of_many_small_groups_make_no_frame_each(spark):
    """a table of fragments that touch nothing falls into as many groups as rows."""
    df = spark.range(200).select(F.lit(1).alias("k"), F.col("id").alias("frag"), F.array(*[F.struct((F.col("id") * 100.0 + d).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")) for d in (0, 7)]).alias("points"))
    out = chaining.chain_fragments(df, ["k"])
    assert "FlatMapGroupsInPandas" not in plan(out)
    assert sorted((r.chain, r.members, r.n, r.length) for r in out.collect()) == [(i, [i], 1, 7.0) for i in range(200)]
    marks = spark.createDataFrame([(1, 5, 7.0, 2), (1, 6, 7.0, 1)], "k int, mark int, length double, need long")
    chains = spark.createDataFrame([(1, c, 2, 7.0) for c in (3, 1, 2, 9)], "k int, chain int, n int, length double")
    taken = chaining.accept_chains(chains, marks, ["k"])
    assert "FlatMapGroupsInPandas" not in plan(taken)
    assert sorted((r.mark, r.chain) for r in taken.collect()) == [(5, 1), (5, 2), (6, 3)]


def loops(fixed, shapes, low, high, steps=8):
    """The rule of declash_shapes, thing by thing."""
    held, out = list(fixed), []
    for x0, y0, x1, y1, z, r in shapes:
        near = [o for o in held if not (x1 < o[0] or x0 > o[2] or y1 < o[1] or y0 > o[3])]
        for _ in range(steps):
            met = next((o for o in near if abs(z - o[4]) < r + o[5]), None)
            if met is None:
                break
            z = met[4] + r + met[5]
            if z > high:
                z = met[4] - r - met[5]
            z = max(low, min(high, z))
        held.append((x0, y0, x1, y1, z, r))
        out.append(z)
    return out


def test_shapes_settle_as_by_loops():
    for seed in range(20):
        rng = random.Random(seed)
        box = lambda: (x := rng.randint(0, 60), y := rng.randint(0, 60), x + rng.randint(0, 30), y + rng.randint(0, 30), float(rng.randint(20, 90)), float(rng.randint(4, 8)))  # noqa: B023, E731
        fixed, shapes = [box() for _ in range(40)], [box() for _ in range(30)] * 4
        rng.shuffle(shapes)
        assert clashes.settle(fixed, shapes, 30.0, 120.0) == loops(fixed, shapes, 30.0, 120.0)


def test_copies_of_shapes_are_looked_up_once():
    """copies of a panel's shapes, 20,000 in all; each met all those before it."""
    rng = random.Random(3)
    shapes = [(float(x), 0.0, x + 50.0, 50.0, 75.0, 5.0) for x in (rng.randint(0, 400) for _ in range(100))] * 200
    start = time.monotonic()
    assert len(clashes.settle([], shapes, 30.0, 120.0)) == 20000
    assert time.monotonic() - start < 10


def test_shapes_store_no_pairs(spark):
    """shapes in two islands, one without a whole box, an upright bar beside one of them."""
    at = lambda *ps: [{"x": x, "y": y, "z": z} for x, y, z in ps]
    rows = [(1, 1, "shape", 10.0, "default", at((0.0, 0.0, 75.0), (10.0, 10.0, 75.0))), (1, 2, "shape", 10.0, "default", at((5.0, 5.0, 75.0), (20.0, 20.0, 75.0))), (1, 3, "shape", 10.0, None, at((500.0, 500.0, 75.0), (510.0, 510.0, 75.0))), (1, 4, "v-mesh", 10.0, "default", at((505.0, 400.0, 75.0), (505.0, 600.0, 75.0))), (1, 5, "shape", 10.0, "default", at((None, 0.0, 75.0), (None, 1.0, 75.0)))]
    bars = spark.createDataFrame(rows, "k int, id int, kind string, dia double, z_source string, points array<struct<x:double,y:double,z:double>>")
    out = clashes.declash_shapes(bars, spark.createDataFrame([(1, 200.0)], "k int, thickness double"), ["k"])
    assert "ExistingRDD" not in plan(out).replace("Scan ExistingRDD[k", "")
    assert {r.id: (r.z, r.moved) for r in out.collect()} == {1: (75.0, False), 2: (85.0, True), 3: (85.0, True), 5: (75.0, False)}


def test_candidates_are_bound_without_a_frame_each(spark):
    """candidates are stored in columns, and components pass through a worker as rows."""
    marks = spark.createDataFrame([(1, m, 10, m, "M_00") for m in (1, 2, 3)], "k int, mark long, dia int, qty long, shape string").withColumn("targets", F.array(F.struct((F.col("mark") * 1000.0).alias("target"), F.lit(0.0).alias("penalty"))))
    arrays = spark.createDataFrame([(1, 10 + m, 10, 1000.0 * m, 4, 100.0, "h") for m in (1, 2, 3)], "k int, array long, dia int, len double, n long, pitch double, axis string")
    notes = spark.createDataFrame([], "k int, array long, kind string, mark long, dia int, qty long, spacing double, quals array<struct<name:string,axis:string>>")
    leaders = spark.createDataFrame([(1, 2, 12, 5.0)], "k int, mark long, array long, distance double")
    out = binding.bind_evidence(marks, arrays, notes, leaders, ["k"])
    assert "FlatMapGroupsInPandas" not in plan(out) and "parquet" in plan(out)
    assert sorted((r.mark, r.array, r.offset, r.taken, r.kind) for r in out.collect()) == [(1, 11, 0, 1, "array_signature"), (2, 12, 0, 1, "leader"), (2, 12, 1, 1, "array_signature"), (3, 13, 0, 3, "array_signature")]


def test_nearest_vectors_as_by_loops(spark, monkeypatch):
    """blocks are multiplied; equal distances, copies, NaN and infinity as by sums of squares in order."""
    monkeypatch.setattr(attendance, "FACES", 16)
    monkeypatch.setattr(attendance, "KNOWN", 8)
    rng = random.Random(2)
    vec = lambda: [rng.choice([0.0, 0.1, 0.25, 1.0, -0.3]) for _ in range(6)]
    known = [(i, vec()) for i in range(30)] + [(30, [math.nan] * 6), (31, [math.inf] + [0.0] * 5)]
    faces = [(i, vec()) for i in range(100)] + [(100, known[3][1]), (101, [math.nan] + [0.0] * 5), (102, [1e200] * 6), (103, [0.0] * 5), (104, None), (105, [None] * 6)]
    out = attendance.identify(spark.createDataFrame(faces, "face long, v array<float>"), spark.createDataFrame(known, "employee_id long, e array<float>"), 0.4)
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    single = lambda v: [float(np.float32(x)) for x in v]
    want = {}
    with np.errstate(all="ignore"):
        for f, v in faces:
            if v is None or None in v or len(v) != 6:
                want[f] = (None, None)
                continue
            dist = []
            for i, e in known:
                s = 0.0
                for x, y in zip(single(v), single(e)):
                    s += (x - y) * (x - y)
                dist.append((math.isnan(s), math.sqrt(s), i))
            worst, d, i = min(dist)
            want[f] = (i if d < 0.4 else None, repr(d))
    assert {r.face: (r.employee_id, None if r.distance is None else repr(r.distance)) for r in out.collect()} == want


def test_unlocated_reasons_without_pairs(spark):
    """lengths at the very ends of the tolerance, nulls and NaN, counted as one by one."""
    rng = random.Random(5)
    cuts = [round(rng.uniform(0, 300), 2) for _ in range(40)] + [0.0, 0.5, -7.0]
    marks = [(i, rng.randint(1, 3), c, c / 3, rng.randint(1, 60), rng.randint(0, 1)) for i, c in enumerate(cuts)] + [(90, 1, None, None, 1, 0), (91, 1, None, 100.0, 1, 0), (92, 9, 100.0, 30.0, 1, 0), (93, None, 1.0, 1.0, 1, 0), (94, 1, math.nan, 1.0, 1, 0), (95, 4, 5.0, 5.0, 1, 0), (96, 5, 5.0, 5.0, 1, 0)]
    edge = [x for c in cuts for v in (c, c / 3) for s in (-1, 1) for x in (v + s * 0.1 * max(v, 1.0), float(np.nextafter(v + s * 0.1 * max(v, 1.0), 1e9)))]
    runs = [(rng.randint(1, 3), x, rng.randint(0, 5)) for x in edge + [rng.uniform(0, 300) for _ in range(60)]] + [(1, None, 3), (2, math.nan, 4), (4, None, 1), (None, 5.0, 1), (5, math.nan, 1), (1, 100.0, None)]
    out = summaries.unlocated_reasons(spark.createDataFrame(marks, "mark int, dia int, cut double, leg double, qty int, located int"), spark.createDataFrame(runs, "dia long, len double, n long"))
    want = {}
    for mark, dia, cut, leg, qty, located in marks:
        own = [(x, n or 0) for d, x, n in runs if d == dia and dia is not None and x is not None]
        near = lambda v: [n for x, n in own if v is not None and abs(x - v) / (v if v > 1.0 or math.isnan(v) else 1.0) <= 0.1]  # noqa: B023, E731
        a, b = near(cut), near(leg)
        reason = "NO_BAR_OF_DIAMETER" if not own else "NO_RUN_OF_LENGTH" if not a + b and (cut, leg) != (None, None) else "PARTLY_DRAWN" if located else "LEG_MATCH_ONLY" if not sum(a) else "TOO_FEW_DRAWN" if sum(a) < qty else "CLAIMED_BY_OTHERS"
        want[mark] = (sum(a), sum(b), reason)
    assert {r.mark: (r.pool, r.legs, r.reason) for r in out.collect()} == want
    assert "Window" in plan(out)  # running sums along the lengths, no pairs


def test_boxes_over_places_of_copies(spark):
    """copies of places and of boxes meet once; nulls, edges and ties as by loops."""
    rng = random.Random(4)
    views = [(rng.randint(1, 2), r, f"v{r}", x := rng.randint(0, 40) * 10.0, y := rng.randint(0, 40) * 10.0, x + rng.choice([0, 30, 400]), y + rng.choice([0, 50, 300])) for r in range(40)] + [(1, None, "none", 0.0, 0.0, 500.0, 500.0), (1, 3, "a", None, 0.0, 1.0, 1.0)]
    texts = [(i, rng.randint(1, 3), rng.randint(0, 50) * 10.0, rng.randint(0, 50) * 10.0) for i in range(200)] + [(900, 1, None, 1.0)]
    df = spark.createDataFrame(texts, "id int, k int, x double, y double")
    out = passes.first_containing_view(df, spark.createDataFrame(views, "k int, rank int, view string, x0 double, y0 double, x1 double, y1 double"), "k", 20.0)
    want = {i: min(((r, v) for q, r, v, x0, y0, x1, y1 in views if q == k and r is not None and x0 is not None and x is not None and x0 - 20 <= x <= x1 + 20 and y0 - 20 <= y <= y1 + 20), default=(None, None))[1] for i, k, x, y in texts}
    assert {r.id: r.view for r in out.collect()} == want
    assert "__cx" in plan(out)
    frames = [(1, i, float(rng.randint(0, 20) * 10), float(rng.randint(0, 20) * 10), 100.0, rng.choice([0.0, 80.0]), 1.0, 2.0, 50.0) for i in range(40)]
    words = [(1, rng.randint(0, 20) * 10.0, rng.randint(0, 20) * 10.0, f"t{i}") for i in range(60)] * 2
    made = pieces.viewport_titles(spark.createDataFrame(frames, "k int, view int, cx double, cy double, w double, h double, vx double, vy double, vh double"), spark.createDataFrame(words, "k int, tx double, ty double, s string"), ["k"])
    title = {}
    for _, i, cx, cy, w, h, *_ in frames:
        near = [(math.sqrt((tx - cx) ** 2 + (ty - cy + h / 2) ** 2), tx, ty, s) for _, tx, ty, s in words if abs(tx - cx) <= w * 1.3 / 2 and cy - h * 1.3 / 2 - h * 0.25 <= ty <= cy + h * 1.3 / 2]
        title[i] = min(near)[3] if near else ""
    assert {r.view: r.title for r in made.collect()} == title
    assert "__cx" in plan(made)


def test_claims_of_many_small_parts_make_no_frame_each(spark):
    """each mark's reach is a part of its own."""
    rows = spark.createDataFrame([(1, m, 2, 1000.0 * m) for m in range(1, 30)], "k int, mark int, qty int, target double")
    bars = spark.createDataFrame([(1, m, 1000.0 * m + 5) for m in range(1, 30, 2)], "k int, item int, length double")
    out = filling.claim_bars(rows, bars, ["k"], 50.0, 0.0)
    assert "FlatMapCoGroups" not in plan(out)
    assert sorted((r.mark, r.unit, r.item) for r in out.collect()) == [(m, u, m if m % 2 and not u else None) for m in range(1, 30) for u in (0, 1)]
