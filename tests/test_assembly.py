"""Binding, chaining, de-clashing, registration and leaders against plain re-computations on random small inputs."""

import math
import random
from collections import Counter
from math import dist

import pytest
from pyspark.sql import functions as F

from plumbline.functions import shapes
from plumbline.operators import binding, chaining, clashes, evidence, joins, leaders, references, registration, sections, synthesis, tables

POINTS = "array<struct<x:double,y:double,z:double>>"


def plain_binding(marks, arrays, leads, scores):
    """The rule over one whole element, without components: marks {id: qty}, arrays {id: n}, scores [(score, mark, array)]."""
    left, got, out = dict(arrays), Counter(), Counter()

    def take(m, a, k):
        k = min(k, left[a])
        left[a] -= k
        got[m] += k
        out[m, a] += k
        return k

    for _, m, a in sorted(leads):
        take(m, a, 1)
    best = {a: min(s for s, _, b in scores if b == a) for a in {a for _, _, a in scores}}
    for a in sorted(best, key=lambda a: (best[a], a)):
        while left[a]:
            open_ = sorted((s, m) for s, m, b in scores if b == a and got[m] < marks[m])
            near = [m for s, m in open_ if s <= open_[0][0] + 20]
            if not near:
                break
            if len(near) == 1:
                take(near[0], a, marks[near[0]] - got[near[0]])
                break
            free, need = left[a], {m: marks[m] - got[m] for m in near}
            total, rest, some = sum(need.values()), free, 0
            for m in near[:-1]:
                k = take(m, a, min(need[m], max(1, round(free * need[m] / total))))
                rest, some = rest - k, some + k
            some += take(near[-1], a, min(need[near[-1]], rest))
            if not some:
                break
    return {k: v for k, v in out.items() if v}


@pytest.mark.parametrize("seed", range(3))
def test_binding_against_the_rule_over_whole_elements(spark, seed):
    rng = random.Random(seed)
    marks = [(e, f"m{i}", rng.choice([8, 10]), rng.randint(1, 9), "M_00", [{"target": float(rng.choice([500, 520, 800, 1500])), "penalty": 0.0}]) for e in (1, 2, None) for i in range(7)]
    arrays = [(e, f"a{i}", rng.choice([8, 10]), float(rng.choice([500, 510, 530, 810, 1450])), rng.randint(1, 9), 150.0, "h") for e in (1, 2, None) for i in range(8)]
    notes = [(1, "a1", "note", "m2", 0, 3, 150.0, [{"name": "u_bar", "axis": "v"}]), (1, "a1", "mark", "m3", None, None, None, None), (2, "a0", "note", None, 8, 2, 20.0, None)]
    leads = [(1, "m1", "a0", 3.0), (1, "m1", "a0", 1.0), (2, "m2", "a2", 2.0), (2, "m9", "a2", 2.0)]
    m = spark.createDataFrame(marks, "element int, mark string, dia int, qty int, shape string, targets array<struct<target:double,penalty:double>>")
    a = spark.createDataFrame(arrays, "element int, array string, dia int, len double, n int, pitch double, axis string")
    n = spark.createDataFrame(notes, "element int, array string, kind string, mark string, dia int, qty int, spacing double, quals array<struct<name:string,axis:string>>")
    lead = spark.createDataFrame(leads, "element int, mark string, array string, distance double")
    scores = binding.binding_scores(m, a, n, ["element"]).collect()
    rows = binding.bind_evidence(m, a, n, lead, ["element"]).collect()
    for e in (1, 2):
        dia = {x[1]: x[2] for x in marks if x[0] == e} | {x[1]: x[2] for x in arrays if x[0] == e}
        leads_here = {(mk, ar): d for x, mk, ar, d in sorted(leads, key=lambda x: -x[3]) if x == e and mk in dia and dia[mk] == dia[ar]}
        want = plain_binding({x[1]: x[3] for x in marks if x[0] == e}, {x[1]: x[4] for x in arrays if x[0] == e}, [(d, *k) for k, d in leads_here.items()], [(s.score, s.mark, s.array) for s in scores if s.element == e])
        got = Counter()
        for r in rows:
            if r.element == e:
                got[r.mark, r.array] += r.taken
        assert dict(got) == want
        for ar in {r.array for r in rows if r.element == e}:
            spans = sorted((r.offset, r.taken) for r in rows if r.element == e and r.array == ar)
            assert [o for o, _ in spans] == [sum(t for _, t in spans[:i]) for i in range(len(spans))]  # gapless
            assert sum(t for _, t in spans) <= next(x[4] for x in arrays if x[:2] == (e, ar))
    assert all(r.taken == 1 and r.offset == 0 for r in rows if r.kind == "leader" and r.array == "a0" and r.score < -1e5)


def test_binding_of_empty_tables(spark):
    none = [spark.createDataFrame([], s) for s in ("element int, mark string, dia int, qty int, shape string, targets array<struct<target:double,penalty:double>>", "element int, array string, dia int, len double, n int, pitch double, axis string", "element int, array string, kind string, mark string, dia int, qty int, spacing double, quals array<struct<name:string,axis:string>>", "element int, mark string, array string, distance double")]
    assert binding.bind_evidence(*none, ["element"]).count() == 0


def test_targets(spark):
    r = spark.createDataFrame([(900.0, [50.0, 210.0, 160.0, 30.0, None])], "l double, d array<double>")
    got = r.select(binding.mark_targets(F.col("l"), F.col("d"), F.array(F.lit(200.0), F.lit(None).cast("double"))).alias("t")).first().t
    assert [(t.target, t.penalty) for t in got] == [(900.0, 0.0), (50.0, 55.0), (210.0, 15.0), (160.0, 20.0)]


def test_references_nest_turn_and_stop(spark):
    one = (1.0, 0.0, 0.0, 1.0)
    rows = [(None, 1, "a", *one, 10.0, 0.0), ("a", 2, "b", 0.0, -1.0, 1.0, 0.0, 0.0, 5.0), ("b", 3, "a", *one, 0.0, 0.0), ("b", 4, None, *one, 0.0, 0.0), (None, 5, "b", 2.0, 0.0, 0.0, 2.0, 0.0, 0.0)]
    refs = spark.createDataFrame([("s", *r) for r in rows], "sheet string, block string, ref int, child string, a double, b double, c double, d double, tx double, ty double")
    ents = spark.createDataFrame([("s", "b", 1, "LINE", [(1.0, 2.0)]), ("s", "b", 2, "HATCH", None), ("s", None, 3, "TEXT", [(7.0, 7.0)]), ("s", "unused", 4, "LINE", [(0.0, 0.0)])], "sheet string, block string, ent int, type string, points array<struct<x:double,y:double>>")
    instances, met = references.expand_references(refs, "sheet")
    placed = references.placed_entities(ents, instances, "sheet")
    at = {(r.outer, r.ent, r.depth): r.points and tuple(r.points[0]) for r in placed.collect()}
    # (1, 2) turned a quarter and moved by (0, 5), then by (10, 0); doubled under the second reference, whose own nesting goes on into a
    assert at == {(1, 1, 2): (8.0, 6.0), (1, 2, 2): None, (5, 1, 1): (2.0, 4.0), (5, 2, 1): None, (None, 3, 0): (7.0, 7.0)}
    assert Counter((r.ref, r.outcome) for r in met.collect()) == Counter({(1, "opened"): 1, (2, "opened"): 1, (3, "cycle"): 1, (4, "no_block"): 2, (5, "opened"): 1, (3, "opened"): 1, (2, "cycle"): 1})
    account = {r.type: (r.read, r.written, r.skipped, r.balanced) for r in references.read_account(ents, instances, met, placed, "sheet", ["LINE", "TEXT"]).collect()}
    assert account == {"LINE": (2, 2, 0, True), "HATCH": (2, 0, 2, True), "TEXT": (1, 1, 0, True), "INSERT": (8, 4, 4, True)}
    lost = placed.filter("ent <> 1 or depth <> 1")
    assert not {r.type: r.balanced for r in references.read_account(ents, instances, met, lost, "sheet", ["LINE", "TEXT"]).collect()}["LINE"]
    assert {r.outcome for r in references.expand_references(refs, "sheet", 1)[1].collect()} == {"opened", "max_depth", "no_block"} - {"no_block"}


def plain_chains(fragments, gap=20.0, depth=2.0):
    """Passes over all fragments in order, as the rule says it."""
    used, out = set(), []
    for i, (name, pts) in enumerate(fragments):
        if i in used:
            continue
        used.add(i)
        members, line, grew = [name], list(pts), True
        while grew:
            grew = False
            for j, (other, p) in enumerate(fragments):
                if j in used or abs(p[0][2] - pts[0][2]) > depth:
                    continue
                if dist(line[-1], p[0]) <= gap:
                    line = line + p[1:]
                elif dist(line[-1], p[-1]) <= gap:
                    line = line + p[-2::-1]
                elif dist(line[0], p[-1]) <= gap:
                    line = p[:-1] + line
                elif dist(line[0], p[0]) <= gap:
                    line = p[::-1][:-1] + line
                else:
                    continue
                used.add(j)
                members.append(other)
                grew = True
        out.append((members, line))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_chains_and_accepted_bars(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in (1, 2):
        for i in range(40):
            p = (rng.randrange(0, 300, 30) + rng.random() * 12, rng.randrange(0, 180, 30) + rng.random() * 12, rng.choice([0.0, 1.5, 1.5, 50.0]))
            q = (p[0] + rng.choice([60, 90, 0]), p[1] + rng.choice([0, 60]), p[2])
            rows.append((k, k * 100 + i, [p, q]))
    df = spark.createDataFrame([(k, f, [dict(zip("xyz", p)) for p in pts]) for k, f, pts in rows] + [(1, 999, []), (1, 998, [{"x": None, "y": 1.0, "z": 0.0}])], f"k int, frag long, points {POINTS}")
    chains = chaining.chain_fragments(df, ["k"])
    got = {(r.k, tuple(r.members)): [tuple(p) for p in r.points] for r in chains.collect()}
    want = {(k, tuple(m)): line for k in (1, 2) for m, line in plain_chains([(f, pts) for x, f, pts in rows if x == k])}
    assert got == want and any(len(m) > 2 for _, m in got)
    lengths = {(k, m[0]): (len(m), sum(dist(a, b) for a, b in zip(line, line[1:]))) for (k, m), line in want.items()}
    marks = [(k, f"b{i}", float(rng.choice([150, 200, 300])), rng.randint(0, 3)) for k in (1, 2) for i in range(4)]
    accepted = chaining.accept_chains(chains, spark.createDataFrame(marks, "k int, mark string, length double, need int"), ["k"]).collect()
    for k in (1, 2):
        used, expected = set(), set()
        for length, mark, need in sorted((-x[2], x[1], x[3]) for x in marks if x[0] == k):
            for (kk, c), (n, path) in sorted(lengths.items()):
                if kk == k and need > 0 and n > 1 and c not in used and abs(path + length) <= 0.15 * -length:
                    used.add(c)
                    expected.add((mark, c))
                    need -= 1
        assert {(r.mark, r.chain) for r in accepted if r.k == k} == expected


def test_ceilings_and_needs(spark):
    marks = spark.createDataFrame([(1, "a", 1000.0, 3, " m_00 ", [1000.0]), (1, "b", 600.0, 2, "M_T1", [300.0, None, 200.0]), (2, "c", 800.0, 1, "M_00", None), (2, "d", 500.0, 0, "M_T1", [900.0])], "k int, mark string, length double, qty int, shape string, segments array<double>")
    assert {r.k: round(r.ceiling, 6) for r in chaining.fragment_ceilings(marks, ["k"]).collect()} == {1: 345.0, 2: 400.0}
    assert {r.k: r.ceiling for r in chaining.fragment_ceilings(marks, ["k"], strict=True).collect()} == {1: 300.0, 2: 400.0}
    bars = spark.createDataFrame([(1, 1000.0), (1, 1080.0), (1, 1081.0), (1, None), (2, 770.0)], "k int, length double")
    assert {r.mark: r.need for r in chaining.wanted(marks, bars, ["k"]).collect()} == {"a": 1, "b": 2, "c": 0, "d": 0}


def box(pts):
    return min(p[0] for p in pts), min(p[1] for p in pts), max(p[0] for p in pts), max(p[1] for p in pts)


@pytest.mark.parametrize("seed", range(2))
def test_shapes_leave_what_they_stand_in(spark, seed):
    rng = random.Random(seed)
    bars = []
    for i in range(60):
        x, y = rng.uniform(0, 300), rng.uniform(0, 300)
        bars.append((rng.choice([1, 2]), i, rng.choice(["shape", "shape", "v-mesh", "link"]), rng.choice([8, 12]), rng.choice(["default", "section"]), [(x, y, 75.0), (x + rng.uniform(0, 80), y + rng.uniform(0, 80), 75.0)]))
    df = spark.createDataFrame([(k, i, kind, d, z, [dict(zip("xyz", p)) for p in pts]) for k, i, kind, d, z, pts in bars], f"k int, id int, kind string, dia int, z_source string, points {POINTS}")
    panels = spark.createDataFrame([(1, 150.0), (2, 120.0)], "k int, thickness double")
    got = {r.id: (r.z, r.moved) for r in clashes.declash_shapes(df, panels, ["k"]).collect()}
    want = {}
    for k, thick in ((1, 150.0), (2, 120.0)):
        held = [(*box(p), p[0][2], d / 2) for x, _, kind, d, z, p in bars if x == k and (kind == "v-mesh" or z == "section")]
        for x, i, kind, d, z, p in bars:
            if x != k or kind != "shape" or z == "section":
                continue
            b, at = box(p), p[0][2]
            for _ in range(8):
                hit = next((o for o in held if not (b[2] < o[0] or b[0] > o[2] or b[3] < o[1] or b[1] > o[3]) and abs(at - o[4]) < d / 2 + o[5]), None)
                if hit is None:
                    break
                at = hit[4] + d / 2 + hit[5]
                if at > max(30, thick - 30):
                    at = hit[4] - d / 2 - hit[5]
                at = max(30.0, min(max(30.0, thick - 30), at))
            held.append((*b, at, d / 2))
            want[i] = (at if abs(at - 75) > 0.5 else 75.0, abs(at - 75) > 0.5)
    assert got == want and any(m for _, m in got.values())


def test_outline_of_steps_has_their_area(spark):
    rng = random.Random(5)
    segs, want = [], 0.0
    tops = [rng.randrange(300, 600, 50) for _ in range(6)]
    for i, top in enumerate(tops):  # columns 60 wide: 120 bins of 3 over 360
        segs += [(1, i * 60.0, float(top), i * 60.0 + 60, float(top)), (1, i * 60.0, 0.0, i * 60.0 + 60, 1.0), (1, i * 60.0, 0.0, i * 60.0, float(top))]
        want += 60 * (top - 0.5)
    segs += [(2, 0.0, 0.0, 0.0, 50.0), (3, 0.0, 0.0, 100.0, 0.0), (3, None, 0.0, 100.0, 0.0)]
    df = spark.createDataFrame(segs, "view int, x1 double, y1 double, x2 double, y2 double")
    rows = registration.view_outlines(df, ["view"]).collect()
    assert [r.view for r in rows] == [1] and rows[0].area == pytest.approx(want, abs=0.1)
    ring = [tuple(p) for p in rows[0].points]
    assert all(a[0] == b[0] or a[1] == b[1] for a, b in zip(ring, ring[1:] + ring[:1]))


def test_known_offsets_and_mirrors_are_found(spark):
    rng = random.Random(3)
    runs = [(1, "c", float(x)) for x in rng.sample(range(0, 4000, 7), 40)]
    points = [(1, 1, "c", x - 335.0) for _, _, x in runs[:25]] + [(1, 2, "c", 2500.0 - x) for _, _, x in runs[10:35]] + [(1, 3, "d", 5.0), (1, 2, "c", None)]
    got = {r.view: (r.sense, r.offset) for r in registration.offset_votes(spark.createDataFrame(points, "sheet int, view int, class string, u double"), spark.createDataFrame(runs, "sheet int, class string, at double"), "sheet", 5.0).collect()}
    assert set(got) == {1, 2} and got[1][0] == 1 and abs(got[1][1] - 335) <= 5 and got[2][0] == -1 and abs(got[2][1] - 2500) <= 5


def test_leaders_by_hand(spark):
    comps = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 0.0), (1, 2, 0.0, 300.0, 30.0, 300.0), (1, 3, 5.0, 5.0, 400.0, 0.0), (1, 4, 900.0, 0.0, 900.0, 100.0), (1, 5, 5000.0, 0.0, 5100.0, 0.0)], "sheet int, component int, ax double, ay double, bx double, by double")
    bubbles = spark.createDataFrame([(1, 7, -10.0, 0.0, 8), (1, 8, 900.0, 130.0, 12), (1, 9, None, 0.0, 8)], "sheet int, inst int, x double, y double, dia int")
    steel = spark.createDataFrame([(1, 1, 0, 10, 100.0, 20.0, 300.0, 20.0), (1, 2, 0, 8, 100.0, 60.0, 300.0, 60.0), (1, 3, 0, 10, 900.0, -5.0, 900.0, -5.0)], "sheet int, segment int, view int, dia int, x1 double, y1 double, x2 double, y2 double")
    tips = leaders.leader_tips(comps, bubbles, steel, "sheet")
    assert {(r.inst, r.component) for r in tips.collect()} == {(7, 1), (8, 4)}  # 2 is short, 3 is farther from steel, 5 has no bubble
    views = spark.createDataFrame([(1, 0, 0, -100.0, -100.0, 600.0, 400.0)], "sheet int, view int, rank int, x0 double, y0 double, x1 double, y1 double")
    bars = steel.withColumnRenamed("segment", "bar")
    got = {r.inst: (r.view, r.bar, r.found_dia, r.status) for r in leaders.bind_tips(tips, views, bars, bubbles, "sheet").collect()}
    assert got == {7: (0, 2, 8, "ok"), 8: (None, None, None, "no_view")}
    wide = spark.createDataFrame([(1, 0, 0, -100.0, -100.0, 1600.0, 400.0)], "sheet int, view int, rank int, x0 double, y0 double, x1 double, y1 double")
    got = {r.inst: (r.bar, r.status) for r in leaders.bind_tips(tips, wide, bars, bubbles, "sheet").collect()}
    assert got == {7: (2, "ok"), 8: (3, "dia_mismatch")}


def test_pairs_at_no_distance(spark):
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 1.0), (1, 2, 1.0, 1.0, 900.0, 2.0), (1, 3, 900.0, 2.1, 901.0, 3.0), (1, 4, 5.0, 1.5, 5.0, 1.5)], "k int, id int, x0 double, y0 double, x1 double, y1 double")
    assert {(r.a, r.b) for r in joins.touching_boxes(boxes, ["k"], 0.0).collect()} == {(1, 2), (2, 4)}
    p = spark.createDataFrame([(1, 1, 2.0, 3.0), (1, 2, 2.0, 3.0), (1, 3, 2.0, 3.5)], "k int, i int, x double, y double")
    q = p.select("k", p.i.alias("j"), p.x.alias("u"), p.y.alias("v"))
    assert {(r.i, r.j) for r in joins.radius_join(p, q, ["k"], ("x", "y"), ("u", "v"), 0.0).collect()} == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)}
    seg = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 0.0)], "k int, sid int, x0 double, y0 double, x1 double, y1 double")
    assert evidence.nearest_segment(spark.createDataFrame([(1, 1, 5.0, 1.0)], "k int, pid int, px double, py double"), seg, ["k"], 0.0).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_overlaps_of_very_long_and_short_spans(spark, seed):
    rng = random.Random(seed)
    spans = lambda n: [(rng.choice([1, 2]), i, float(rng.randrange(-500, 500)), float(rng.choice([0, 1, 7, 90, 10**9]))) for i in range(n)]
    a, b = spans(40), spans(40)
    left = spark.createDataFrame([(k, i, x, x + w) for k, i, x, w in a], "k int, i int, lo double, hi double")
    right = spark.createDataFrame([(k, i, x, x + w) for k, i, x, w in b], "k int, j int, lo2 double, hi2 double")
    got = Counter((r.i, r.j, r.overlap) for r in joins.overlap_join(left, right, ["k"], "lo", "hi", "lo2", "hi2", 5.0).collect())
    want = Counter((i, j, min(x + w, y + v) - max(x, y)) for k, i, x, w in a for m, j, y, v in b if k == m and min(x + w, y + v) > max(x, y))
    assert got == want


def plain_shape(shape, dims, dia, cut):
    """One bar, step by step."""
    legs, turns, mode, close, hooks = shapes.SHAPES[shape]
    tight = 2 * dia if shape.startswith("M_T") or dia <= 16 else 3.5 * dia
    wide = 2 * dia if dia <= 16 else 3.5 * dia
    take = lambda t: tight * math.radians(abs(t)) / 2 if mode == "path" else (tight + dia / 2) * math.tan(math.radians(abs(t)) / 2)
    x = y = h = 0.0
    pts = [(x, y)]
    for i, name in enumerate(legs):
        run = max(1.0, dims[name] - (take(turns[i - 1]) if i else 0) - (take(turns[i]) if i < len(turns) else 0))
        x, y = x + run * math.cos(h), y + run * math.sin(h)
        pts.append((x, y))
        if i < len(turns):
            t = math.radians(turns[i])
            s = math.copysign(1, t)
            c = (x - s * wide * math.sin(h), y + s * wide * math.cos(h))
            steps = max(3, int(abs(turns[i]) / 15) + 2)
            for k in range(1, steps + 1):
                a = h - s * math.pi / 2 + t * k / steps
                pts.append((c[0] + wide * math.cos(a), c[1] + wide * math.sin(a)))
            (x, y), h = pts[-1], h + t
    if close:
        pts.append(pts[0])
    for k, v in enumerate([dims[c] for c in hooks if dims.get(c)]):
        a = math.atan2(pts[1][1] - pts[0][1], pts[1][0] - pts[0][0]) + (1 if k == 0 else -1) * math.radians(135)
        pts.append((pts[0][0] + v * math.cos(a), pts[0][1] + v * math.sin(a)))
    return pts, sum(dist(a, b) for a, b in zip(pts, pts[1:]))


def test_shapes_have_their_cut_length(spark):
    rng = random.Random(1)
    rows = [(s, {c: float(rng.randint(80, 900)) for c in "ABCDEG"}, d, float(rng.randint(300, 4000))) for s in shapes.SHAPES for d in (8.0, 20.0)]
    rows += [("M_T1", {**{c: 300.0 for c in "BCDE"}, "A": None, "G": 70.0}, 10.0, None), ("M_17", {"B": 1.0, "C": 0.0, "D": 5.0}, 8.0, 10.0), ("M_17", {"B": 1.0}, 8.0, 10.0), ("none", {}, 8.0, 1.0), (None, None, 8.0, 1.0)]
    df = spark.createDataFrame(rows, "s string, d map<string,double>, dia double, cut double")
    got = df.select("s", shapes.bent_bar(F.col("s"), F.col("d"), F.col("dia"), F.col("cut")).alias("b")).collect()
    for (s, d, dia, cut), r in zip(rows[:-4], got):
        pts, geo = plain_shape(s, d, dia, cut)
        assert [tuple(p) for p in r.b.pts] == [pytest.approx(p, abs=1e-6) for p in pts] and r.b.geometric_mm == round(geo, 1)
        exact = [tuple(p) for p in r.b.pts_exact]
        assert abs(sum(dist(a, b) for a, b in zip(exact, exact[1:])) - (cut or geo)) < 0.1
        assert r.b.scale_applied == (pytest.approx(cut / geo, abs=1e-6) if cut else 1.0)
    assert [r.b.error for r in got[-4:]] == ["missing dimension C", "missing dimension C", "unknown shape code none", "unknown shape code null"]


@pytest.mark.parametrize("seed", range(2))
def test_stretches_covered_by_several_spans(spark, seed):
    rng = random.Random(seed)
    rows = [(k, a, a + rng.randrange(0, 20)) for k in (1, 2) for a in [rng.randrange(0, 100) for _ in range(25)]]
    got = {}
    for r in synthesis.covered(spark.createDataFrame(rows, "k int, lo int, hi int"), ["k"], 3).collect():
        assert not got.get(r.k, set()) & set(range(r.lo, r.hi))
        got.setdefault(r.k, set()).update(range(r.lo, r.hi))
    assert got == {k: {c for c in range(130) if sum(x == k and a <= c < b for x, a, b in rows) >= 3} for k in (1, 2)}


def test_stacks_take_the_longest_pairs_once(spark):
    bars = [(1, 16, x, 30.0, hi) for x, hi in ((0.2, 900.0), (100.0, 1000.0), (200.0, 1200.0), (300.0, 1200.0), (900.0, 2000.0))] + [(1, 16, 100.0, 1000.5, 1100.0), (1, 10, 50.0, 0.0, 2000.0), (2, 16, 0.0, 0.0, 500.0), (1, 16, None, 0.0, 1.0)]
    b = spark.createDataFrame(bars, "panel int, dia int, x double, lo double, hi double")
    calls = spark.createDataFrame([(1, 8, 100.0), (1, 8, 100.0), (1, 10, 150.0), (2, 8, None)], "panel int, dia int, pitch double")
    stacks = synthesis.tie_stacks(b, calls, "panel")
    # 200-300 share 1170, 100-200 share 1070 but 200 is taken, 0-100 share 870
    assert [(r.a, r.b, r.covered) for r in stacks.orderBy("a").collect()] == [(0.0, 100.0, 870.0), (200.0, 300.0, 1170.0)]
    one = synthesis.tie_stacks(b, calls.limit(1), "panel").collect()
    assert [(r.a, r.b) for r in one] == [(200.0, 300.0)]
    panels = spark.createDataFrame([(1, 1000.0, 1000.0, 160.0)], "panel int, width double, height double, thickness double")
    ties = synthesis.place_ties(stacks, panels, "panel").collect()
    assert sorted(r.y for r in ties if r.x_lo == 170.0) == [30.0 + 100 * i for i in range(10)] and {r.loop_mm for r in ties} == {2 * 160 + 100 + 160.0}


def test_column_ties_merge_near_levels(spark):
    rows = [(1, i, 10, "default", 50.0, 350.0, y, 300.0) for i, y in enumerate((10.0, 25.0, 31.0, 49.0, 52.0))] + [(1, 9, 10, "section", 50.0, 350.0, 500.0, 300.0), (1, 10, 10, "default", 50.0, 100.0, 600.0, 50.0), (1, 11, 10, "plane-snap", 50.0, 350.0, 700.0, 420.0), (2, 12, 10, "default", 50.0, 350.0, 10.0, 300.0)]
    bars = spark.createDataFrame(rows, "panel int, id int, dia int, z_source string, x0 double, x1 double, y double, length double")
    panels = spark.createDataFrame([(1, 400.0, 2000.0, 300.0), (2, 800.0, 2000.0, 300.0)], "panel int, width double, height double, thickness double")
    straight = spark.createDataFrame([(1, 10, 450.0), (1, 12, 300.0), (1, 10, None)], "panel int, dia int, length double")
    got = synthesis.column_ties(bars, straight, panels, "panel").orderBy("y").collect()
    assert [(r.y, r.n) for r in got] == [(10.0, 2), (31.0, 2), (52.0, 1)] and {(r.x_lo, r.x_hi, r.z_lo, r.z_hi) for r in got} == {(40.0, 360.0, 40.0, 260.0)}


def test_marks_take_units_in_order_of_trust(spark):
    units = spark.createDataFrame([(1, "end_cut", "cluster", 5, 9, 1), (1, "plan_cut", "single", 1, 1, 1), (1, "plan_cut", "pitch", 2, 3, 3), (1, "plan_cut", "cluster", 3, 2, 1), (1, "plan_cut", "cluster", 4, 4, 1), (1, "other", "single", 6, 1, 1)], "k int, kind string, tier string, unit int, strength int, n int")
    marks = spark.createDataFrame([(1, "a", 3), (1, "b", 0), (1, "c", None), (1, "d", 3), (1, "e", 9), (1, "f", 1), (2, "g", 1)], "k int, mark string, qty int")
    got = {}
    for r in sections.triangulate(units, marks, ["k"], ["mark"]).collect():
        got.setdefault(r.mark, set()).add((r.unit, r.seq))
    assert got == {"a": {(4, 0), (3, 0), (2, 0)}, "d": {(2, 1), (2, 2), (1, 0)}, "e": {(5, 0)}}


def test_bent_marks_with_fragments_by_their_labels(spark):
    marks = spark.createDataFrame([(1, "a", 1000.0, 4, "M_T1"), (1, "b", 1000.0, 2, "M_00"), (1, "c", 2000.0, 2, "M_17"), (1, "d", 3000.0, 1, "M_17")], "k int, mark string, length double, qty int, shape string")
    frags = spark.createDataFrame([(1, i, [{"x": 100.0 * i, "y": 0.0, "z": 0.0}, {"x": 9000.0, "y": 9000.0, "z": 0.0}]) for i in range(3)] + [(1, 9, [{"x": 9000.0, "y": 0.0, "z": 0.0}])], f"k int, frag int, points {POINTS}")
    labels = spark.createDataFrame([(1, "a", 0.0, 2000.0), (1, "a", 1.0, 2000.0), (1, "c", 0.0, -2200.0), (1, "b", 0.0, 0.0), (1, "d", None, 0.0)], "k int, mark string, x double, y double")
    bars = spark.createDataFrame([(1, 1010.0)], "k int, length double")
    got = chaining.shapes_by_evidence(marks, frags, labels, bars, ["k"]).collect()
    assert sorted((r.mark, r.bar) for r in got) == [("a", 0), ("a", 1), ("a", 2)]  # c has one fragment in reach only


def test_tables_of_inserts_by_hand(spark):
    rows = [(0, 100, "Insert Schedule"), (10, 92, "Ref No."), (60, 92, "Type"), (110, 91, "Count"), (9, 80, "N1"), (61, 79, "RR-SA-3.0"), (112, 78, "2 nos"), (200, 80, "- M40"), (125, 80, "7"), (145, 70, "M40"), (10, 70, "N2"), (60, 69, "x"), (10, 60, "N3"), (60, 60, "y"), (110, 60, "none"), (11, 50, "N4"), (60, 50, " z \n q"), (110, 50, "12"), (0, 40, "Dowel Schedule"), (10, 30, "N5"), (60, 30, "w"), (110, 30, "1"), (None, 30, "1")]
    cells = spark.createDataFrame([(1, x if x is None else float(x), float(y), t) for x, y, t in rows] + [(2, 0.0, 100.0, "Insert Schedule"), (2, 10.0, 92.0, "Type"), (2, 10.0, 80.0, "N1")], "s int, x double, y double, text string")
    got = tables.insert_schedule(cells, "s").orderBy("line_no").collect()
    assert [(r.s, r.ref, r.type, r["count"]) for r in got] == [(1, "N1", "RR-SA-3.0", 2), (1, "N4", "z q", 12)]
