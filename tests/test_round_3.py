"""Findings of round 3, each by a small input on which the code before it failed."""

import random
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import clashes, evidence, extension, joins, references, registration
from plumbline.plans import catalog


def rounded(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.fixture
def held(spark, tmp_path):
    """held(query, table=DataFrame, ...): rows of the query over these tables, after those of its SQL are found equal."""

    def run(name, **tables):
        con = duckdb.connect()
        for t, df in tables.items():
            df.write.parquet(str(tmp_path / f"{t}.parquet"))
            con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
        df = catalog.QUERIES[name](spark, str(tmp_path))
        rel = con.execute(catalog.ORACLE_SQL[name])
        names = [d[0] for d in rel.description]
        got = rounded(tuple(r) for r in df.select(*names).collect())
        assert got == rounded(rel.fetchall())
        return got

    return run


def test_modal_spacing_counts_fractions_of_seconds(spark, held):
    base = datetime(2024, 1, 1)
    rows = [(i, base + timedelta(seconds=s), 1) for i, s in enumerate((0.9, 450.5, 900.1))]
    assert held("modal_spacing", events=spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long")) == [(1, 300, 2)]


def test_tol_match_flags_at_the_very_edge(spark, held):
    """Prices a whole tolerance off, where the order of three factors decides."""
    rng, parts, lines = random.Random(0), [], []
    while len(parts) < 60:
        p, q, r = rng.randint(90000, 200000) / 100, float(rng.randint(1, 50)), rng.choice([0.08, 0.15, 0.20, 0.01, 0.005])
        if r * p * q != r * (p * q) and r * p * q > 120:
            e = p * q + rng.choice([r * p * q, r * (p * q)])
            if (abs(e - p * q) <= r * p * q) != (abs(e - p * q) <= r * (p * q)):
                parts.append((len(parts), p))
                lines.append((len(lines), q, e, "N"))
    held("tol_match_flags", part=spark.createDataFrame(parts, "p_partkey long, p_retailprice double"), lineitem=spark.createDataFrame(lines, "l_partkey long, l_quantity double, l_extendedprice double, l_returnflag string"))


def test_depth_pairs_mean_does_not_depend_on_the_order(spark):
    rng = random.Random(1)
    marks = [(p, 1, float(rng.randint(1, 499)), 300.0, 8) for p in range(150) for _ in range(11)]
    sides = spark.createDataFrame([(p, 1, "vertical", 0.0, 0.0, 1000.0, 3000.0) for p in range(150)], "panel int, view int, way string, x0 double, y0 double, x1 double, y1 double")
    elevations = spark.createDataFrame([(p, 0.0, 0.0, 3000.0, 3000.0) for p in range(150)], "panel int, x0 double, y0 double, x1 double, y1 double")
    circles = spark.createDataFrame(marks, "panel int, view int, x double, y double, dia int").repartition(7, F.rand(3))
    got = {r.panel: r.front for r in registration.depth_pairs(circles, sides, elevations, "panel").collect()}
    assert got == {p: sum(int(x) for q, _, x, *_ in marks if q == p) / 1000 / 11 for p in range(150)}


def test_steps_without_a_fitting_pitch_keep_the_least(spark):
    steps = spark.createDataFrame([([15.0, 37.0],), ([40.0, 80.0],)], "s array<double>")
    assert [r[0] for r in steps.select(extension.true_pitch(F.col("s"))).collect()] == [15.0, 20.0]


def test_longest_row_of_blocks_as_bin_by_bin():
    rng = random.Random(2)
    for _ in range(200):
        spans = [(a, min(a + rng.randint(0, 40), 79), rng.uniform(0, 3)) for a in (rng.randint(0, 79) for _ in range(rng.randint(1, 30)))]
        blocks = [(n, at, y, y) for a, b, y in spans for n in [(b - a + 1).bit_length() - 1] for at in {a, b - (1 << n) + 1}]
        cells = {i: [y for a, b, y in spans if a <= i <= b] for i in range(80)}
        rows, last = [[]], None
        for i in sorted(i for i, y in cells.items() if y and max(y) - min(y) >= 1):
            rows += [[]] if i - 1 != last else []
            rows[-1].append((i, max(cells[i]), min(cells[i])))
            last = i
        assert registration.longest_row(*map(np.array, zip(*blocks))) == max(rows, key=len)


def parts(spark, n, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([i, i, 3, None]), f"Brand#{rng.randint(1, 2)}", rng.choice([1, 2, 9, None]), rng.choice([900.0, 903.5, 905.0, 905.1, 911.0, None])) for i in range(n)]
    return spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int, p_retailprice double")


@pytest.mark.parametrize("seed", range(2))
def test_joins_of_counted_values_with_repeated_ids(spark, held, seed):
    held("range_join_tol", part=parts(spark, 60, seed))


def test_radius_counts_with_repeated_ids(spark, held):
    held("radius_count", part=parts(spark, 60, 5))


def test_nearest_capped_takes_ties_on_both_sides(spark, held):
    rng = random.Random(3)
    money = lambda: rng.choice([0.0, 100.0, 200.0, 1100.0, 5000.0, None])
    customers = spark.createDataFrame([(i, rng.randint(0, 2), money()) for i in range(60)], "c_custkey long, c_nationkey int, c_acctbal double")
    suppliers = spark.createDataFrame([(i, rng.randint(0, 1), money()) for i in range(9)], "s_suppkey long, s_nationkey int, s_acctbal double")
    held("nearest_capped", customer=customers, supplier=suppliers)


def test_copies_of_values_make_no_pairs(spark):
    """300,000 copies: 45 billion pairs, which no join of rows gets through."""
    df = spark.range(300000).select(F.lit(1).alias("k"), "id", F.lit(5.0).alias("v"), F.lit(2.0).alias("w"))
    assert [tuple(r) for r in joins.near_pair_sums(df, ["k"], "id", "v", 5.0).collect()] == [(1, 300000 * 299999 // 2, 0.0)]
    assert [tuple(r) for r in joins.radius_counts(df, ["k"], "id", ("v", "w"), 10.0).groupBy("near").count().collect()] == [(299999, 300000)]
    right = df.select("k", F.col("id").alias("r"), F.col("v").alias("u"))
    near = joins.nearest_capped(df, right, ["k"], "id", "v", "u", "r", 900.0)
    assert [tuple(r) for r in near.groupBy("r", "distance").count().collect()] == [(0, 0.0, 300000)]


def test_clashes_of_many_copies(spark):
    """20,000 copies of a cross and of a link in it: 400 million pairs of each kind, which are not made."""
    at = lambda x, y, z: F.struct(x.alias("x"), y.alias("y"), z.alias("z"))
    n = lambda v: F.lit(float(v))
    kinds = {"h-mesh": (at(n(0), n(50), n(75)), at(n(100), n(50), n(75))), "v-mesh": (at(n(80), n(0), n(75)), at(n(80), n(90), n(75))), "link": (at(n(40), n(52), n(40)), at(n(40), n(52), n(110)))}
    bars = None
    for i, (k, ends) in enumerate(kinds.items()):
        one = spark.range(i * 20000, i * 20000 + 20000).select(F.lit(1).alias("panel"), "id", F.lit(k).alias("kind"), n(10).alias("dia"), F.lit("default").alias("z_source"), F.array(*ends).alias("points"))
        bars = bars.unionByName(one) if bars else one
    panels = spark.createDataFrame([(1, 200.0, 80.0, 150.0)], "panel int, width double, height double, thickness double")
    moved = clashes.declash_links(bars, panels, ["panel"]).groupBy("kind", "shift_x", "shift_y").count().collect()
    assert sorted(map(tuple, moved)) == [("h-mesh", 0.0, 0.0, 20000), ("link", 0.0, 10.0, 20000), ("v-mesh", 0.0, 0.0, 20000)]
    laid = clashes.declash_planes(bars, panels, ["panel"]).groupBy("kind", "z").count().collect()
    assert sorted(map(tuple, laid), key=repr) == [("h-mesh", 80.0, 20000), ("link", None, 20000), ("v-mesh", 70.0, 20000)]


def test_blocks_are_walked_once_however_often_they_are_opened(spark):
    one = (1.0, 0.0, 0.0, 1.0)
    nested = spark.createDataFrame([(1, 7, 1, 8, *one, 5.0, 0.0), (1, 8, 2, 7, *one, 0.0, 0.0)], "sheet int, block int, ref int, child int, a double, b double, c double, d double, tx double, ty double")
    top = spark.range(1000).select(F.lit(1).alias("sheet"), F.lit(None).cast("int").alias("block"), (F.col("id") + 10).cast("int").alias("ref"), F.lit(7).alias("child"), *[F.lit(v).alias(c) for c, v in zip("abcd", (0.0, -1.0, 1.0, 0.0))], F.col("id").cast("double").alias("tx"), F.lit(0.0).alias("ty"))
    refs = top.unionByName(nested)
    tops, inside, met = references.expand_blocks(refs, "sheet")
    assert (tops.count(), inside.count(), met.count()) == (1000, 2, 2)
    ents = spark.createDataFrame([(1, 8, 1, "LINE", [(1.0, 2.0)])], "sheet int, block int, ent int, type string, points array<struct<x:double,y:double>>")
    got = sorted((r.outer, r.depth, *r.points[0]) for r in references.placed_by_blocks(ents, tops, inside, "sheet").collect())
    assert got == [(i + 10, 2, i - 2.0, 6.0) for i in range(1000)]
    instances, seen = references.expand_references(refs, "sheet")
    assert sorted((r.outer, r.depth, *r.points[0]) for r in references.placed_entities(ents, instances, "sheet").collect()) == got
    assert sorted(map(tuple, seen.groupBy("depth", "outcome").count().collect())) == [(0, "opened", 1000), (1, "opened", 1000), (2, "cycle", 1000)]


def test_nearest_of_many_copies(spark):
    """100,000 copies on either side: ten billion pairs, which are not made."""
    n = 100000
    points = spark.range(n).select(F.lit("A").alias("dia"), F.col("id").alias("pid"), F.lit(3.0).alias("px"), F.lit(4.0).alias("py"))
    lines = spark.range(n).select(F.lit("A").alias("dia"), (F.col("id") + 5).alias("sid"), *[F.lit(v).alias(c) for c, v in zip(("x0", "y0", "x1", "y1"), (0.0, 0.0, 9.0, 0.0))])
    assert [tuple(r) for r in evidence.nearest_segment(points, lines, ["dia"], 60.0).groupBy("sid", "distance").count().collect()] == [(5, 4.0, n)]
    got = evidence.nearest_point(points, lines, ["dia"], "pid", ("px", "py"), ("x0", "y0"), ["sid"], 60.0)
    assert [tuple(r) for r in got.groupBy("sid", "d").count().collect()] == [(5, 5.0, n)]
