"""Views registered, leaders bound, fragments chained and clashes solved, over rows that stand for drawn things."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chaining, clashes, leaders, registration, tables
from .tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: All lines with a number of their own, and numbers made of their columns; doubles in both engines.
_L = """l as (select l_orderkey o, l_orderkey * 1000 + row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) id, l_suppkey s, l_partkey p, l_linenumber k,
 cast(l_quantity as double) q, cast(l_extendedprice as double) e, l_returnflag f, l_linestatus st from lineitem)"""


def _own(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE_SQL[name] = oracle
        return fn

    return add


def _sql(spark, sf_dir, text):
    """Spark's rows of SQL over numbered lines."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql(f"with {_L} {text}")


_POINTS = "select s sheet, k as view, id, p % 7 dia, q * 10 + 0.5 u from l where f = 'R'"
_RUNS = "select s sheet, p % 7 dia, q * 9 as at from l where f = 'A'"
_SPANS = "select s sheet, k as view, max(q * 10) span from l group by 1, 2"


@_own("view_senses", f"""with {_L}, p as ({_POINTS}), r as ({_RUNS}), v as ({_SPANS}),
c as (select p.sheet, p.view, exists (select 1 from r where r.sheet = p.sheet and r.dia = p.dia and abs(r.at - p.u) <= 3) a, exists (select 1 from r where r.sheet = p.sheet and r.dia = p.dia and abs(r.at - (v.span - p.u)) <= 3) b from p join v on v.sheet = p.sheet and v.view = p.view),
n as (select v.sheet, v.view, count(*) filter (a) ahead, count(*) filter (b) back from v left join c on c.sheet = v.sheet and c.view = v.view group by 1, 2)
select sheet, "view", ahead, back, case when ahead >= back then 1 else -1 end sense, case when ahead + back = 0 then 0 else round(abs(ahead - back) / (ahead + back)::double, 2) end confidence from n""")
def view_senses(spark, sf_dir):
    """Sense of each section view against the elevation's runs, scored both ways."""
    return registration.view_senses(*[_sql(spark, sf_dir, t) for t in (_POINTS, _RUNS, _SPANS)], "sheet")


@_own("offset_votes", f"""with {_L}, p as ({_POINTS}), r as ({_RUNS}), a as (select sheet, "view", dia, floor(u / 5) i, count(*) n from p group by all), b as (select sheet, dia, floor(r.at / 5) j, count(*) m from r group by all),
w as (select a.sheet, a.view, way, case when way = 1 then j - i else j + i + 1 end o, sum(least(n, m)) votes from a join b on a.sheet = b.sheet and a.dia = b.dia, (values (1), (-1)) t(way) group by all),
x as (select *, row_number() over (partition by sheet, "view" order by votes desc, way desc, abs(o), o) r from w) select sheet, "view", way sense, o * 5.0 as "offset", cast(votes as bigint) votes from x where r = 1""")
def offset_votes(spark, sf_dir):
    """Offset and sense of each view by votes of cells."""
    p, r = _sql(spark, sf_dir, _POINTS).withColumnRenamed("dia", "class"), _sql(spark, sf_dir, _RUNS).withColumnRenamed("dia", "class")
    return registration.offset_votes(p, r, "sheet")


_STUBS = "select s sheet, case when k % 2 = 0 then 'Z' else 'X' end axis, floor(e / 700) * 10.0e0 station, q * 40 other from l where f = 'A'"
_NUMBERS = "select s sheet, p number, floor(e / 70) + 0.25 x, q * 45 y from l where f = 'R'"


@_own("cut_stations", f"""with {_L}, s as ({_STUBS}), n as ({_NUMBERS}), c as (select sheet, axis, round(station, 1) station, count(*) n from s group by 1, 2, 3 having count(*) >= 2),
d as (select c.sheet, c.axis, c.station, number, abs(case when c.axis = 'Z' then y else x end - c.station) + 0.15 * min(abs(case when c.axis = 'Z' then x else y end - other)) dist from c join n on n.sheet = c.sheet join s on s.sheet = c.sheet and s.axis = c.axis and round(s.station, 1) = c.station group by c.sheet, c.axis, c.station, number, x, y),
b as (select sheet, axis, station, number, dist, row_number() over (partition by sheet, axis, station order by dist, number) r from d where dist <= 1500), u as (select *, row_number() over (partition by sheet, number order by axis, station) k from b where r = 1)
select sheet, number, axis, station, round(dist, 6) distance from u where k = 1""")
def cut_stations(spark, sf_dir):
    """Numbered cut lines from pairs of stubs."""
    return registration.cut_stations(_sql(spark, sf_dir, _STUBS), _sql(spark, sf_dir, _NUMBERS), "sheet").withColumn("distance", F.round("distance", 6))


_CUTS = "select o sheet, case when k % 2 = 0 then 'plan_cut' else 'end_cut' end kind, q * 5 y, 200.0e0 + 10 * (o % 5) thickness from l"


@_own("thickness_flips", f"""with {_L}, p as ({_CUTS}), m as (select sheet, avg(case when kind = 'plan_cut' and y between 0 and thickness then y - thickness / 2 end) a, avg(case when kind = 'end_cut' and y between 0 and thickness then y - thickness / 2 end) b from p group by 1)
select sheet, coalesce(abs(a) > 2 and abs(b) > 2 and a * b < 0, false) flip from m""")
def thickness_flips(spark, sf_dir):
    """Sheets whose end cuts measure the thickness the other way."""
    return registration.thickness_flips(_sql(spark, sf_dir, _CUTS), "sheet")


@_own("view_outlines")
def view_outlines(spark, sf_dir):
    """Rectilinear outlines of views with steps and notches."""
    segments = _sql(spark, sf_dir, "select s element, k as view, e / 50 x1, q * 8 y1, e / 50 + 20 + p % 400 x2, q * 8 + k % 3 y2 from l")
    out = registration.view_outlines(segments, ["element", "view"])
    return out.select("element", "view", F.size("points").alias("n"), F.round("area", 3).alias("area"), F.to_json("points").alias("points"))


_LEADERS = "select s sheet, id component, e / 20 xa, q * 60 ya, e / 20 + p % 180 xb, q * 60 + k * 20 yb from l where f = 'N' and st = 'O'"
_BUBBLES = "select s sheet, id inst, e / 20 x, q * 60 + 15 y, p % 3 dia from l where f = 'A'"
_STEEL = "select s sheet, id segment, k % 3 as view, p % 3 dia, e / 20 x1, q * 60 + 5 y1, e / 20 + 100 x2, q * 60 + 5 y2 from l where f = 'R'"
_BOXES = "select s sheet, k % 3 as view, k % 3 as rank, min(e / 20) x0, min(q * 60) y0, 0.6e0 * max(e / 20) x1, max(q * 60) y1 from l group by 1, 2, 3"
#: Distance of a point from a segment, as SQL.
_SEG = "sqrt(({px} - x1 - t * (x2 - x1)) ^ 2 + ({py} - y1 - t * (y2 - y1)) ^ 2)"


@_own("leader_binding", f"""with {_L}, c as ({_LEADERS}), b as ({_BUBBLES}), m as ({_STEEL}), v as ({_BOXES}),
e as (select sheet, component, sqrt((xa - xb) ^ 2 + (ya - yb) ^ 2) reach, 0 as "end", xa ex, ya ey, xb tx, yb ty from c union all select sheet, component, sqrt((xa - xb) ^ 2 + (ya - yb) ^ 2), 1, xb, yb, xa, ya from c),
n as (select e.*, b.inst, sqrt((ex - x) ^ 2 + (ey - y) ^ 2) d from e join b on b.sheet = e.sheet where reach >= 40 and abs(ex - x) <= 200 and abs(ey - y) <= 200),
g as (select * from (select *, row_number() over (partition by sheet, component order by d, "end", inst) r from n where d <= 200) z where r = 1),
h as (select sheet, component, inst, d, reach, tx, ty, min({_SEG.format(px='tx', py='ty')}) md from (select g.*, x1, y1, x2, y2, greatest(0, least(1, ((tx - x1) * (x2 - x1) + (ty - y1) * (y2 - y1)) / ((x2 - x1) ^ 2 + (y2 - y1) ^ 2))) t from g join m on m.sheet = g.sheet) z group by all),
i as (select * from (select *, row_number() over (partition by sheet, inst order by md, component) r from h where md <= 150) z where r = 1),
w as (select i.*, (select arg_min("view", rank) from v where v.sheet = i.sheet and tx between x0 - 50 and x1 + 50 and ty between y0 - 50 and y1 + 50) as "view", b.dia expected_dia from i join b on b.sheet = i.sheet and b.inst = i.inst),
s as (select sheet, inst, expected_dia, segment bar, dia, {_SEG.format(px='tx', py='ty')} dist from (select w.*, m.segment, m.dia, x1, y1, x2, y2, greatest(0, least(1, ((tx - x1) * (x2 - x1) + (ty - y1) * (y2 - y1)) / ((x2 - x1) ^ 2 + (y2 - y1) ^ 2))) t from w join m on m.sheet = w.sheet and m.view = w.view) z),
k as (select * from (select *, row_number() over (partition by sheet, inst order by dia = expected_dia desc, dist, bar) r from s where dist <= 90) z where r = 1)
select w.sheet, w.inst, w.component, round(w.d, 6) label_dist, round(w.reach, 6) reach, round(w.md, 6) material_dist, w.view, k.bar, round(k.dist, 6) dist, w.expected_dia, k.dia found_dia,
 case when w.view is null then 'no_view' when k.bar is null then 'no_bar_in_range' when k.dia <> w.expected_dia then 'dia_mismatch' else 'ok' end status from w left join k on k.sheet = w.sheet and k.inst = w.inst""")
def leader_binding(spark, sf_dir):
    """Leaders from bubbles to the bars that they point at, with reasons."""
    bubbles, steel = _sql(spark, sf_dir, _BUBBLES), _sql(spark, sf_dir, _STEEL)
    tips = leaders.leader_tips(_sql(spark, sf_dir, _LEADERS).toDF("sheet", "component", "ax", "ay", "bx", "by"), bubbles, steel, "sheet")
    out = leaders.bind_tips(tips, _sql(spark, sf_dir, _BOXES), steel.withColumnRenamed("segment", "bar"), bubbles, "sheet")
    return out.drop("tip_x", "tip_y").withColumns({c: F.round(c, 6) for c in ("label_dist", "reach", "material_dist", "dist")})


_FRAGMENTS = "select s panel, 8 + 2 * (p % 3) dia, id frag, floor(e / 90) * 15 x, q * 30 y, k % 2 * 40.0e0 z, 40.0e0 + 15 * (p % 9) w, 30.0e0 * (p % 4) h from l where f = 'R'"


def _fragments(spark, sf_dir):
    """Lines as fragments on a grid of 15, so that many ends meet, some within the gap only."""
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"), F.col("z").alias("z"))
    f = _sql(spark, sf_dir, _FRAGMENTS)
    return f.select("panel", "dia", "frag", F.array(at(F.col("x"), F.col("y")), at(F.col("x") + F.col("w"), F.col("y") + F.col("h"))).alias("points"))


@_own("fragment_chains")
def fragment_chains(spark, sf_dir):
    """Fragments joined end to end (H6)."""
    out = chaining.chain_fragments(_fragments(spark, sf_dir), ["panel", "dia"])
    return out.select("panel", "dia", "chain", "n", F.round("length", 6).alias("length"), F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


@_own("stitched_bars")
def stitched_bars(spark, sf_dir):
    """Chains that become bars of bent marks whose length they have."""
    marks = _sql(spark, sf_dir, "select s panel, 8 + 2 * (p % 3) dia, id mark, q qty, e / 150 length, case when k = 1 then 'M_00' else 'M_T1' end shape, e / 400 leg from l where f = 'A'")
    bars = _sql(spark, sf_dir, "select s panel, 8 + 2 * (p % 3) dia, e / 100 length from l where f = 'N'")
    keys = ["panel", "dia"]
    ceilings = chaining.fragment_ceilings(marks.withColumn("segments", F.array("leg")), keys)
    chord = F.sqrt(sum(((F.element_at("points", 1)[c] - F.element_at("points", -1)[c]) ** 2 for c in "xyz"), F.lit(0.0)))
    fragments = _fragments(spark, sf_dir).join(ceilings, keys).filter(chord < F.col("ceiling"))
    bent = chaining.wanted(marks.filter("shape <> 'M_00' and qty > 0"), bars, keys)
    return chaining.accept_chains(chaining.chain_fragments(fragments, keys), bent, keys).withColumn("length", F.round("length", 6))


_BARS = "select o % 500 panel, id, case k % 4 when 0 then 'link' when 1 then 'h-mesh' when 2 then 'v-mesh' else 'shape' end kind, 8.0e0 + 2 * (p % 5) dia, case when p % 3 = 0 then 'section' else 'default' end z_source, floor(e / 40) x, q * 50 y, 10.0e0 * (p % 30) len from l"
_PANELS = "select distinct o % 500 panel, 2600.0e0 width, 2500.0e0 height, 150.0e0 + 10 * (o % 500 % 5) thickness from l"


def _model(spark, sf_dir):
    """Lines as bars of 500 panels: links through the thickness, level and upright meshes, slanting shapes."""
    b = _sql(spark, sf_dir, _BARS)
    z = F.when(F.col("kind") == "link", 40.0).otherwise(75.0)
    at = lambda dx, dy, dz: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), (z + dz).alias("z"))
    none = F.lit(0.0)
    flat = F.when(F.col("kind").isin("h-mesh", "shape"), F.col("len")).otherwise(none)
    tall = F.when(F.col("kind").isin("v-mesh", "shape"), F.col("len")).otherwise(none)
    deep = F.when(F.col("kind") == "link", 70.0).otherwise(none)
    return b.select("panel", "id", "kind", "dia", "z_source", F.array(at(none, none, none), at(flat, tall, deep)).alias("points")), _sql(spark, sf_dir, _PANELS)


@_own("declash_links", f"""with {_L}, b as ({_BARS}), p as ({_PANELS}), k as (select panel, id, x, y, dia / 2 r from b where kind = 'link'),
m as (select panel, kind, dia / 2 r, x x0, case when kind = 'h-mesh' then x + len else x end x1, y y0, case when kind = 'v-mesh' then y + len else y end y1 from b where kind in ('h-mesh', 'v-mesh')),
a as (select k.panel, k.id, m.kind, case when m.kind = 'h-mesh' then case when k.y >= height / 2 then 1 else -1 end else case when k.x >= width / 2 then 1 else -1 end end * (k.r + m.r) s from k join m on m.panel = k.panel join p on p.panel = k.panel
 where (m.kind = 'h-mesh' and k.x between x0 - k.r - m.r and x1 + k.r + m.r and abs(k.y - y0) <= k.r + m.r) or (m.kind = 'v-mesh' and k.y between y0 - k.r - m.r and y1 + k.r + m.r and abs(k.x - x0) <= k.r + m.r)),
g as (select panel, id, count(distinct kind) kinds, min(kind) kind, count(distinct sign(s)) ways, arg_max(s, abs(s)) s from a group by 1, 2)
select b.panel, b.id, case when kinds = 1 and ways = 1 and g.kind = 'v-mesh' then s else 0 end shift_x, case when kinds = 1 and ways = 1 and g.kind = 'h-mesh' then s else 0 end shift_y from b left join g on g.panel = b.panel and g.id = b.id""")
def declash_links(spark, sf_dir):
    """Links moved off the mesh bars that they stand in."""
    bars, panels = _model(spark, sf_dir)
    return clashes.declash_links(bars, panels, ["panel"]).select("panel", "id", "shift_x", "shift_y")


@_own("declash_planes", f"""with {_L}, b as ({_BARS}), p as ({_PANELS}), v as (select * from b where kind = 'v-mesh' and z_source = 'default'), h as (select * from b where kind = 'h-mesh' and z_source = 'default'),
g as (select v.panel, max(v.dia / 2 + h.dia / 2) / 2 half from v join h on h.panel = v.panel and v.x between h.x - 1 and h.x + h.len + 1 and h.y between v.y - 1 and v.y + v.len + 1 group by 1)
select b.panel, b.id, case when half is null then null when z_source = 'default' and kind = 'v-mesh' then greatest(0, thickness / 2 - half) when z_source = 'default' and kind = 'h-mesh' then least(thickness, thickness / 2 + half) end z from b join p on p.panel = b.panel left join g on g.panel = b.panel""")
def declash_planes(spark, sf_dir):
    """Crossing meshes without depth evidence on two planes."""
    bars, panels = _model(spark, sf_dir)
    return clashes.declash_planes(bars, panels, ["panel"]).select("panel", "id", "z")


@_own("declash_shapes")
def declash_shapes(spark, sf_dir):
    """Shapes moved in depth until they stand in nothing."""
    bars, panels = _model(spark, sf_dir)
    return clashes.declash_shapes(bars, panels, ["panel"])


_ELEVATIONS = "select s panel, 0.0e0 x0, 0.0e0 y0, 3000.0e0 x1, 2800.0e0 y1 from l group by 1"
_SIDES = "select s panel, id as view, 4000.0e0 + p % 9 * 300 x0, case k % 3 when 0 then 5.0e0 * (p % 6) else -900.0e0 end y0, 4000.0e0 + p % 9 * 300 + case k % 3 when 0 then q * 30 else 2900 + p % 200 end x1, case k % 3 when 0 then 2780.0e0 + p % 50 else -900 + q * 20 end y1 from l where f = 'A'"
_CIRCLES = "select l.s panel, l.id as view, 4000.0e0 + l.p % 9 * 300 + m * 7 % (l.q * 30) x, case l.k % 3 when 0 then m * 97 % 2800 else -900 + m * 5 % (l.q * 20) end y, 8 + 4 * (m % 2) dia from l, (select 1 m union all select 2 union all select 3 union all select 5 union all select 11) c where l.f = 'A'"


@_own("depth_pairs", f"""with {_L}, e as ({_ELEVATIONS}), v as ({_SIDES}), c as ({_CIRCLES}),
s as (select * from (select v.*, e.x0 ex0, e.x1 - e.x0 ew, case when abs(v.y0 - e.y0) < 20 and abs(v.y1 - e.y1) < 20 and v.x1 - v.x0 < 0.3e0 * (e.y1 - e.y0) then 'vertical' when abs(v.x1 - v.x0 - (e.x1 - e.x0)) < 60 and v.y1 - v.y0 < 0.3e0 * (e.x1 - e.x0) then 'horizontal' end way
 from v join e on e.panel = v.panel where not (v.x0 >= e.x0 - 1 and v.x1 <= e.x1 + 1 and v.y0 >= e.y0 - 1 and v.y1 <= e.y1 + 1)) z where way is not null),
f as (select s.panel, case way when 'vertical' then 'h' else 'v' end family, cast(round_even(case way when 'vertical' then c.y else ex0 + (round_even(c.x / 30, 0) * 30 - x0) / (x1 - x0) * ew end / 30, 0) as bigint) bucket, dia, case way when 'vertical' then (c.x - x0) / (x1 - x0) else (c.y - y0) / (y1 - y0) end f
 from s join c on c.panel = s.panel and c.view = s.view where c.x between x0 and x1 and c.y between y0 and y1 and x1 > x0 and y1 > y0)
select panel, family, bucket, dia, round(coalesce(avg(f) filter (f < 0.5), avg(f) filter (f >= 0.5)), 6) front, round(case when avg(f) filter (f < 0.5) is not null then avg(f) filter (f >= 0.5) end, 6) back, count(*) n from f group by 1, 2, 3, 4""")
def depth_pairs(spark, sf_dir):
    """Depths of bars from their circles in section views."""
    elevations = _sql(spark, sf_dir, _ELEVATIONS)
    sections = registration.section_views(_sql(spark, sf_dir, _SIDES), elevations, "panel")
    out = registration.depth_pairs(_sql(spark, sf_dir, _CIRCLES), sections, elevations, "panel")
    return out.withColumns({c: F.round(c, 6) for c in ("front", "back")})


@_own("evidence_shapes")
def evidence_shapes(spark, sf_dir):
    """Bars of bent marks whose fragments lie by their labels."""
    keys = ["panel", "dia"]
    marks = _sql(spark, sf_dir, "select s panel, 8 + 2 * (p % 3) dia, id mark, cast(q as bigint) % 9 qty, e / 60 length, case when k = 1 then 'M_00' else 'M_T1' end shape from l where f = 'A'")
    labels = _sql(spark, sf_dir, "select s panel, 8 + 2 * (p % 3) dia, id mark, e x, q * 500 y from l where f = 'A' and k <= 4")
    bars = _sql(spark, sf_dir, "select s panel, 8 + 2 * (p % 3) dia, e / 100 length from l where f = 'N'")
    at = lambda dx: F.struct((F.col("e") + dx).alias("x"), (F.col("q") * 500).alias("y"), F.lit(0.0).alias("z"))
    fragments = _sql(spark, sf_dir, "select s panel, 8 + 2 * (p % 3) dia, id frag, e, q from l where f = 'R'").select(*keys, "frag", F.array(at(0), at(60)).alias("points"))
    return chaining.shapes_by_evidence(marks, fragments, labels, bars, keys)


#: Sheets with a table of inserts: title, headers, three cells a row a little askew, a legend beside it, another table below.
_INSERTS = """select o sheet, 0.0e0 x, 1000.0e0 y, 'Insert  Schedule' text from l group by 1 union all select o, 10, 992, 'Ref No.' from l group by 1 union all select o, 60, 992, 'Type' from l group by 1 union all select o, 110, 991, 'Count' from l where o % 5 > 0 group by 1
union all select o, 8.0e0 + p % 6, 980 - k * 10 - p % 3, 'N' || k from l union all select o, 62, 980 - k * 10, 'RR-SA-' || p % 9 from l union all select o, 108.0e0 + q % 40, 980 - k * 10, case when p % 7 = 0 then '- M' else p % 50 || ' nos' end from l union all select o, 15, 945, 'Dowel Schedule' from l where f = 'R' group by 1"""


@_own("insert_schedule")
def insert_schedule(spark, sf_dir):
    """Tables of inserts read from the cells of sheets."""
    return tables.insert_schedule(_sql(spark, sf_dir, _INSERTS), "sheet")
