"""Rules whose figures must grow no faster than their tables: no frame for each group, no pairs where copies crowd together."""

import random
from math import dist

from pyspark.sql import functions as F

from plumbline.functions import shapes
from plumbline.operators import binding, clustering, filling, joins, matching, passes, pieces, registration


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _bars(spark, rows):
    return spark.createDataFrame(rows, "k int, id int, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double, length double")


def _pieces(spark, rows):
    return spark.createDataFrame(rows, "k int, id int, x0 double, y0 double, x1 double, y1 double, dia double")


def test_twins_and_seeds_make_no_frame_for_each_key(spark):
    """F23"""
    assert "InPandas" not in _plan(pieces.near_twins(_bars(spark, [(1, 1, *[0.0] * 7)]), ["k"]))
    assert "InPandas" not in _plan(pieces.seed_clusters(spark.createDataFrame([(1, 1, 0.0, 0.0)], "k int, id int, x double, y double"), ["k"]))


def test_twins_as_by_loops(spark):
    """bars crowd around the edges of cells, some the other way round."""
    rng = random.Random(3)
    rows = []
    for i in range(300):
        a, b = [(float(rng.choice([-7, -6, 0, 6, 7, 8])), float(rng.choice([0, 5, 6, 12, 13])), float(rng.choice([-3, 0, 3]))) for _ in range(2)]
        rows.append((i % 2, i, *a, *b, rng.choice([0.0, 10.0, 10.4, 20.0])))
    want, kept = {}, {0: [], 1: []}
    for k, i, *p, n in rows:
        a, b = p[:3], p[3:]
        twin = any((dist(a, c) < 6 and dist(b, d) < 6 or dist(a, d) < 6 and dist(b, c) < 6) and m and abs(n - m) / m < 0.05 for c, d, m in kept[k])
        want[i] = not twin
        if not twin:
            kept[k].append((a, b, n))
    assert {r.id: r.kept for r in pieces.near_twins(_bars(spark, rows), ["k"]).collect()} == want and not all(want.values())


def test_chains_make_no_frame_for_each_key(spark):
    """F30"""
    assert "InPandas" not in _plan(pieces.chain_pieces(_pieces(spark, [(1, 1, *[0.0] * 5)]), ["k"]))


def test_chains_as_by_loops(spark):
    """every piece is looked at in each round."""
    rng = random.Random(4)
    rows = [(1, i, *[float(rng.randrange(0, 60, 3)) for _ in range(4)], rng.choice([8.0, 9.5, 12.0])) for i in range(150)]
    free, want = [r[1:] for r in rows], []
    while free:
        seed = free.pop(0)
        head, tail, chain, at = seed[1:3], seed[3:5], [seed[0]], -1
        while True:
            fits = [r for r in free if abs(r[5] - seed[5]) <= 1.9 and min(dist(e, p) for e in (head, tail) for p in (r[1:3], r[3:5])) <= 4]
            if not fits:
                break
            one = next((r for r in fits if r[0] > at), fits[0])
            at, a, b = one[0], one[1:3], one[3:5]
            if dist(tail, a) <= 4:
                tail = b
            elif dist(tail, b) <= 4:
                tail = a
            elif dist(head, b) <= 4:
                head = a
            else:
                head = b
            free.remove(one)
            chain.append(at)
        want.append((seed[0], chain))
    got = pieces.chain_pieces(_pieces(spark, rows), ["k"]).collect()
    assert sorted((r.seed, r.ids) for r in got) == want and max(len(c) for _, c in want) > 3


def test_runs_make_no_frame_for_each_key(spark):
    """F32"""
    runs = spark.createDataFrame([(1, 1, 0.0, 1.0, 5.0, float("nan"), [0.0, 1.0]), (1, 2, 300.0, 300.0, 5.0, None, [300.0])], "k int, id int, lo double, hi double, length double, pitch double, places array<double>")
    out = pieces.bridge_runs(runs, ["k"])
    assert "InPandas" not in _plan(out) and [(r.seed, r.n, r.pitch) for r in out.collect()] == [(1, 2, 300.0)]


def test_filled_rows_make_no_frame_for_each_key(spark):
    """F33"""
    rows = spark.createDataFrame([(1, 1, 15, None, 2, 4.0)], "k int, sno int, dia int, descr string, nos int, length double")
    bars = spark.createDataFrame([(1, 1, 16, 4.1, "Other"), (2, 1, 16, 4.1, "Other")], "k int, bar int, dia int, length double, orient string")
    out = filling.fill_rows(rows, bars, ["k"])
    assert "InPandas" not in _plan(out) and [(r.k, r.sno, r.dia, r.nos, r.units, r.found) for r in out.collect()] == [(1, 1, 15, 2, 1, 4.1)]


def test_matching_makes_no_frame_for_each_part(spark):
    """F36"""
    d = spark.createDataFrame([(1, "a", 2, 100.0), (1, "b", 1, 90.0), (1, "c", None, 100.0), (1, "d", 1, None)], "k int, mark string, qty long, target double")
    p = spark.createDataFrame([(1, 95.0), (1, 101.0), (1, None), (2, 1.0)], "k int, length double")
    nearest = matching.greedy_nearest(d, p, ["k"])
    for out in (nearest, matching.first_fit(d, p, ["k"]), matching.best_fit_bars(d, p, ["k"]), matching.tiered(d, [p, p], ["k"]), matching.evidence_sweep(d, [p, p], ["k"])):
        assert "InPandas" not in _plan(out)
    assert {r.mark: (r.found, r.status) for r in nearest.collect()} == {"a": (1, "SHORT"), "b": (1, "OK"), "c": (0, "DEAD_END"), "d": (0, "DEAD_END")}


def test_bent_bars_of_a_batch_are_drawn_together(spark):
    """F25"""
    rows = [("M_T1", {c: 300.0 for c in "BCDE"} | {"A": 0.0, "G": 70.0}, 10.0, 900.0), ("M_00", {"B": 500.0}, 8.0, 0.0), ("M_00", {"B": 500.0}, None, 1.0), ("M_17A", {"C": None, "B": None}, 8.0, 1.0)]
    df = spark.createDataFrame(rows, "s string, d map<string,double>, dia double, cut double").select(shapes.bent_bar(F.col("s"), F.col("d"), F.col("dia"), F.col("cut")).alias("b"))
    assert "aggregate(" not in _plan(df)
    got = [r.b for r in df.collect()]
    assert [b.error for b in got] == [None, None, "missing diameter", "missing dimension C"]
    assert len(got[0].pts) == len(got[0].pts_exact) and abs(sum(dist(p, q) for p, q in zip(got[0].pts_exact, got[0].pts_exact[1:])) - 900) < 1e-6
    assert [tuple(p) for p in got[1].pts] == [(0.0, 0.0), (500.0, 0.0)] and (got[1].scale_applied, got[1].residual_mm, got[1].geometric_mm) == (1.0, 500.0, 500.0)
    assert got[2].pts is None and got[3].geometric_mm is None


def test_cuts_look_from_their_station_outwards(spark):
    """numbers crowd on few heights, on both sides of bands; ties go to the smaller number."""
    rng = random.Random(5)
    stubs = [(s, rng.choice("ZX"), float(rng.choice([0, 30, 60, 90, -45])), float(rng.randrange(0, 400, 20))) for s in (1, 2) for _ in range(40)] + [(None, "Z", 1.0, 1.0)] * 2
    numbers = [(s, i, float(rng.randrange(-80, 160, 8)), float(rng.randrange(-80, 160, 16))) for s in (1, 2) for i in range(60)] + [(1, None, 0.0, 0.0), (1, 99, None, 0.0)]
    out = registration.cut_stations(spark.createDataFrame(stubs, "sheet int, axis string, station double, other double"), spark.createDataFrame(numbers, "sheet int, number int, x double, y double"), "sheet", 25.0)
    assert "Join" not in _plan(out)
    ends, want = {}, {}
    for s, axis, station, other in stubs[:-2]:
        ends.setdefault((s, axis, station), []).append(other)
    for (s, axis, station), others in sorted(ends.items()):
        near = [(abs((y if axis == "Z" else x) - station) + 0.15 * min(abs((x if axis == "Z" else y) - o) for o in others), i) for k, i, x, y in numbers[:-2] if k == s]
        if len(others) > 1 and min(near)[0] <= 25:
            d, number = min(near)
            want.setdefault((s, number), (axis, station, d))
    assert {(r.sheet, r.number): (r.axis, r.station, r.distance) for r in out.collect()} == want and len(want) > 5


def test_edge_pairs_are_not_shuffled(spark, monkeypatch):
    """in blocks of any size the same pairs as by loops; a null side ends where the other does."""
    rng = random.Random(6)
    rows = [(g, e, float(rng.randrange(0, 60, 3)), None if e == 7 else float(rng.randrange(0, 9)), rng.uniform(9, 14)) for g in (1, 2) for e in range(40)] + [(None, 1, 0.0, 0.0, 9.0), (1, 99, None, 0.0, 9.0)]
    pairs = []
    for g, e, o, a, b in rows[:-2]:
        for h, f, p, c, d in rows[:-2]:
            if g == h and 5 <= p - o <= 34:
                over = min(b, d) - max(x for x in (a, c) if x is not None) if (a, c) != (None, None) else 0
                if over > 0.2:
                    pairs.append((g, e, f, int(p - o + 0.5), over))
    votes = {}
    for g, e, f, dia, over in pairs:
        for x in (e, f):
            votes.setdefault((g, x), {}).setdefault(dia, []).append(over)
    won = {k: min(v, key=lambda d: (-round(sum(v[d]), 6), d)) for k, v in votes.items()}
    want = sorted((g, e, f, dia, round(o, 9)) for g, e, f, dia, o in pairs if won[g, e] == won[g, f] == dia)
    monkeypatch.setattr(joins, "PAIRS", 50)
    out = joins.edge_votes(spark.createDataFrame(rows, "grp int, edge int, off double, lo double, hi double"))
    assert "Join" not in _plan(out) and want
    assert sorted((r.grp, r.e1, r.e2, r.dia, round(r.ov, 9)) for r in out.collect()) == want


def test_scores_group_no_pairs(spark):
    """two targets that are equal, several notes of one array; pairs are not shuffled after they met."""
    marks = spark.createDataFrame([(1, "a", 8, 4, "M_T1", [(None, 0.0), (100.0, 20.0), (100.0, 5.0), (104.0, 0.0)])], "e int, mark string, dia int, qty int, shape string, targets array<struct<target:double,penalty:double>>")
    arrays = spark.createDataFrame([(1, 1, 8, 100.0, 4, 150.0, "h"), (1, 2, 8, 104.0, 2, None, "v"), (1, 3, 8, None, 2, None, "v")], "e int, array int, dia int, len double, n int, pitch double, axis string")
    notes = spark.createDataFrame([(1, 1, "note", None, 8, 4, 150, [("ties", "v")]), (1, 1, "mark", "a", None, None, None, None), (1, 1, "note", "a", 10, 4, 150, None)], "e int, array int, kind string, mark string, dia int, qty int, spacing int, quals array<struct<name:string,axis:string>>")
    out = binding.binding_scores(marks, arrays, notes, ["e"])
    assert _plan(out).split("Join")[0].count("Exchange") == 0 and _plan(out).split("Join")[0].count("Aggregate") == 0
    assert {r.array: (r.score, r.evidence) for r in out.collect()} == {1: (20.0 - 45 - 20 + 25 - 12 - 70, ["leader_mark", "note_qty", "pitch", "qualifier_shape"]), 2: (7.5, [])}


def test_equal_outlines_meet_once(spark, monkeypatch):
    """copies of a box are one, but for one whose sides are the wrong way round."""
    met = []
    plain = clustering.touching_boxes
    monkeypatch.setattr(clustering, "touching_boxes", lambda boxes, *rest: met.append(boxes.count()) or plain(boxes, *rest))
    rows = [(1, i, 0.0, 0.0, 5.0, 5.0) for i in range(300)] + [(1, 300, 7.0, 0.0, 9.0, 5.0)] + [(1, 400 + i, 100.0, 0.0, 90.0, 5.0) for i in range(3)] + [(2, 500 + i, 0.0, 0.0, 5.0, 5.0) for i in range(2)]
    out = clustering.outline_components(spark.createDataFrame(rows, "k int, id int, x0 double, y0 double, x1 double, y1 double"), ["k"])
    assert [tuple(r) for r in out.collect()] == [(1, 0, 301, 0.0, 0.0, 9.0, 5.0)] and met == [6]


def test_circles_of_one_place_and_view_meet_once(spark, monkeypatch):
    """F31"""
    links = []
    plain = passes.components
    monkeypatch.setattr(passes, "components", lambda nodes, edges: links.append(edges.count()) or plain(nodes, edges))
    rows = [(1, 2 * i + j, "ab"[j], 8, 6.0 * j, 0.0) for i in range(200) for j in (0, 1)] + [(1, 900 + i, "a", 8, 50.0, 0.0) for i in range(3)] + [(2, 950, "b", 8, 0.0, 0.0), (1, 960, None, 8, 0.0, 0.0)]
    out = passes.cross_view_clusters(spark.createDataFrame(rows, "p int, id int, view string, dia int, x double, y double"), "p", 6.0)
    assert {(r.id, r.component, r.views) for r in out.collect()} == {(i, 0, 2) for i in range(400)} and links == [1]
