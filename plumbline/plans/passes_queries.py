"""Model-building rules over rows that stand for bars, marks, views and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import passes
from .tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Inputs by name, as columns of a table that both engines read alike.
INPUTS = {
    # distinct rows of an order's lines as bars: panel, bar, coordinate, radius, kind, diameter, length, position
    "bars": ("select o panel, n bar, sup * 7.0e0 c, (qty % 5) * 0.5e0 r, case when sup % 3 = 0 then 'hook' when sup % 3 = 1 then 'face-dowel' else 'mesh' end kind, 8 + 2 * (part % 3) dia, round(price / 10, 1) len, qty * 20.0e0 x, flag from lines"),
    "marks": ("select panel, 8 + 2 * (p % 3) dia, 'k' || p mark, 1 + p % 2 qty, round(1000.0e0 + 37 * (p % 40), 1) len, case when p % 4 = 0 then 'M_00' when p % 4 = 1 then '17A' else 'M_11' end shape, 1 + p % 3 legs from (select o panel, part % 7 p from lines group by 1, 2) z"),
}
_LINES = "lines as (select l_orderkey o, l_orderkey * 1000 + row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) n, l_suppkey sup, l_partkey part, cast(l_quantity as bigint) qty, l_extendedprice price, l_returnflag flag from lineitem)"
_WITH = f"with {_LINES}, bars as ({INPUTS['bars']}), marks as ({INPUTS['marks']})"


def _input(spark, sf_dir, name):
    """One of INPUTS. Lines have no key: a rank within their order gives them a number."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql(f"with {_LINES} {INPUTS[name]}")


def _own(name: str, oracle: str):
    def add(fn):
        QUERIES[name], ORACLE_SQL[name] = fn, oracle
        return fn

    return add


@_own("depth_lookup", f"""{_WITH},
near as (select b.panel, b.bar, a.kind section, a.len z from bars b join bars a on a.panel = b.panel and a.c between b.c - 40 and b.c + 40 and abs(a.r - b.r) <= 0.5 where b.flag = 'A' and a.flag <> 'A'),
g as (select *, case when z - lag(z) over (partition by bar order by z, section) > 8 then 1 else 0 end f from near), h as (select *, sum(f) over (partition by bar order by z, section) cl from g),
p as (select panel, bar, cl, avg(z) depth, count(*) n, count(distinct section) s from h group by 1, 2, 3),
q as (select *, row_number() over (partition by bar order by n desc, cl) i from p), w as (select bar, max(z) - min(z) sp from near group by 1)
select panel, q.bar, round(depth, 4) depth, n, s sections, s >= 2 or sp <= 15 corroborated from q join w on q.bar = w.bar where i = 1""")
def depth_lookup(spark, sf_dir):
    """Depth of bars from readings of like radius nearby (H2)."""
    b = _input(spark, sf_dir, "bars")
    bars = b.filter("flag = 'A'").select("panel", "bar", F.col("c").alias("coord"), "r")
    readings = b.filter("flag <> 'A'").select("panel", F.col("kind").alias("section"), "c", F.col("r").alias("rr"), F.col("len").alias("z"))
    return passes.depth_lookup(bars, readings, "panel").withColumn("depth", F.round("depth", 4))


_VIEWS = "select l_orderkey sheet, l_linenumber v, l_quantity * 30.0 w, l_tax * 10000.0 h, cast(l_discount * 100 as int) bars, l_returnflag <> 'N' outline from lineitem"


@_own("elevation_candidates", f"with v as ({_VIEWS}), m as (select sheet, max(bars) mx from v group by 1) select sheet, v.v, w, h, bars from v join m using (sheet) where bars >= 0.3 * mx and outline and least(w, h) >= 300")
def elevation_candidates(spark, sf_dir):
    """Views that can be an elevation."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return passes.elevation_candidates(spark.sql(_VIEWS), "sheet").select("sheet", "v", "w", "h", "bars")


@_own("outline_openings", """with l as (select l_suppkey panel, case l_returnflag when 'A' then 'WALL' when 'R' then 'OUTLINE' else 'MISC' end layer, l_extendedprice area, l_linestatus = 'F' closed from lineitem),
r as (select *, case layer when 'WALL' then 1 when 'OUTLINE' then 2 end rk from l), f as (select panel, min(rk) fr from r where rk is not null group by 1), o as (select r.panel, max(area) outline from r join f on r.panel = f.panel and rk = fr group by 1)
select o.panel, outline, count(*) filter (where closed and area < 0.95 * outline) openings from o left join l using (panel) group by 1, 2""")
def outline_openings(spark, sf_dir):
    """Wall outline by layer priority and its openings."""
    l = table(spark, sf_dir, "lineitem")
    layer = F.when(F.col("l_returnflag") == "A", "WALL").when(F.col("l_returnflag") == "R", "OUTLINE").otherwise("MISC")
    return passes.outline_and_openings(l.select(F.col("l_suppkey").alias("panel"), layer.alias("layer"), F.col("l_extendedprice").alias("area"), (F.col("l_linestatus") == "F").alias("closed")), "panel", ["WALL", "OUTLINE"])


_SECTIONS = "select l_orderkey panel, l_quantity * 10.0 w, l_extendedprice / 50 h, 400.0 + l_orderkey % 7 * 100 panel_w, 900.0 panel_h from lineitem"


@_own("section_thickness", f"""with v as (select *, least(w, h) t from ({_SECTIONS}) z), r as (select panel, median(t) raw, count(*) n from v group by 1)
select v.panel, round(coalesce(median(t) filter (where t <= 0.5 * least(panel_w, panel_h)), case when max(n) >= 2 and count(*) filter (where abs(t - raw) <= 0.2 * raw) >= 2 then median(t) filter (where abs(t - raw) <= 0.2 * raw) end), 6) thickness from v join r on v.panel = r.panel group by 1""")
def section_thickness(spark, sf_dir):
    """Consensus thickness of the sections (H24, H1 in part)."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return passes.section_thickness(spark.sql(_SECTIONS), "panel").withColumn("thickness", F.round("thickness", 6))


@_own("calibrate_on_count", f"""{_WITH}, n as (select panel, dia, count(*) qty from bars where kind = 'hook' group by 1, 2), h as (select n.panel, n.dia, min(m.len) ln from n join marks m on m.panel = n.panel and m.dia = n.dia and m.qty = n.qty group by 1, 2)
select b.panel, bar, kind, b.dia, b.len length, case when kind = 'hook' then coalesce(ln, b.len) else b.len end scaled from bars b left join h on h.panel = b.panel and h.dia = b.dia""")
def calibrate_on_count(spark, sf_dir):
    """Hooks take a mark's length where they are as many as it asks for."""
    b = _input(spark, sf_dir, "bars").select("panel", "bar", "kind", "dia", F.col("len").alias("length"))
    return passes.calibrate_on_count(b, _input(spark, sf_dir, "marks"), "panel", "hook").select("panel", "bar", "kind", "dia", "length", "scaled")


@_own("calibrate_uniform", f"""{_WITH}, p as (select panel, kind, dia, count(*) qty, max(len) - min(len) sp, avg(len) mean from bars group by 1, 2, 3)
select p.panel, kind, p.dia, m.mark, m.len from p join marks m on m.panel = p.panel and m.dia = p.dia and m.qty = p.qty where sp <= 0.05 * mean and shape <> 'M_00' and abs(mean - m.len) > 0.05 * m.len
 and not exists (select 1 from marks o where o.panel = p.panel and o.dia = p.dia and o.mark <> m.mark and abs(mean - o.len) <= 0.1 * o.len)""")
def calibrate_uniform(spark, sf_dir):
    """Kinds of uniform length that a bent mark's count calibrates."""
    b = _input(spark, sf_dir, "bars").select("panel", "kind", "dia", F.col("len").alias("length"))
    return passes.calibrate_uniform(b, _input(spark, sf_dir, "marks"), "panel")


@_own("drop_dowels", f"{_WITH} select panel, bar from bars b where not (kind = 'face-dowel' and exists (select 1 from marks m where m.panel = b.panel and m.dia = b.dia) and not exists (select 1 from marks m where m.panel = b.panel and m.dia = b.dia and contains(shape, '17A')))")
def drop_dowels(spark, sf_dir):
    """Face dowels go whose diameter is scheduled in no dowel shape."""
    return passes.drop_unscheduled_dowels(_input(spark, sf_dir, "bars"), _input(spark, sf_dir, "marks"), "panel").select("panel", "bar")


@_own("dowel_only_dias", f"{_WITH} select panel, dia from marks group by 1, 2 having count(*) filter (where shape = 'M_00' or legs <> 2) = 0")
def dowel_only_dias(spark, sf_dir):
    """Diameters of two-leg bent marks alone."""
    return passes.dowel_only(_input(spark, sf_dir, "marks"), "panel")


_PANELS = "select o_orderkey panel, 300.0 + o_orderkey % 5 * 100 w, 200.0 t, 2400.0 h from orders"


@_own("drop_ties", f"""{_WITH}, panels as ({_PANELS}), d as (select panel, dia from marks group by 1, 2 having count(*) filter (where shape = 'M_00' or legs <> 2) = 0)
select b.panel, bar from bars b where not exists (select 1 from panels p join d on d.panel = p.panel where p.panel = b.panel and d.dia = b.dia and p.h >= 4 * p.w and p.h >= 4 * p.t and b.len >= 0.7 * p.w
 and not exists (select 1 from marks m where m.panel = b.panel and m.dia = b.dia and abs(b.len - m.len) <= greatest(30, 0.08 * m.len)))""")
def drop_ties(spark, sf_dir):
    """Unclaimed tie candidates of columns go."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    bars = _input(spark, sf_dir, "bars").select("panel", "bar", "dia", F.col("len").alias("length"))
    return passes.drop_unclaimed_ties(bars, _input(spark, sf_dir, "marks"), spark.sql(_PANELS), "panel").select("panel", "bar")


_TEXTS = "select p_brand panel, case p_size % 5 when 0 then 'T8 Ties @' || (100 + p_size) || ' mm' when 1 then '2 -T12 Crack Bar' when 2 then p_size || ' - T' || (8 + p_size % 9) when 3 then ' T10 TIE @ 150' else p_name end text, 2400.0 height from part"


@_own("predicted_rows", f"""with n as (select panel, trim(text) t, height, count(*) inst from ({_TEXTS}) z where trim(text) <> '' group by 1, 2, 3)
select panel, kind, dia, cast(sum(n) as bigint) n from (
 select panel, 'ties' kind, regexp_extract(t, '^T([0-9]+)', 1)::int dia, inst * (cast(floor((height / 1000 - 0.06) / (regexp_extract(t, '@ ?([0-9]+)', 1)::int / 1000.0) + 1e-9) as bigint) + 1) n from n where regexp_matches(lower(t), 'ties? ?@ ?[0-9]')
 union all select panel, case when contains(lower(t), 'crack') then 'crack' else 'detail' end, regexp_extract(t, '- ?T([0-9]+)', 1)::int, inst * regexp_extract(t, '^[0-9]+')::int from n where regexp_matches(t, '^[0-9]+ *- *T[0-9]')) z group by 1, 2, 3""")
def predicted_rows(spark, sf_dir):
    """Rows of a schedule foretold from labels."""
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return passes.predicted_rows(spark.sql(_TEXTS), "panel")


@_own("grid_places", "select p_partkey, i, round(case when n > 1 then 50 + i * (950.0 - 50) / (n - 1) else 500 end, 6) place from (select p_partkey, p_size % 9 n, unnest(range(0, p_size % 9)) i from part) z")
def grid_places(spark, sf_dir):
    """Bars spread evenly over a span."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 9).alias("n"), F.lit(50.0).alias("lo"), F.lit(950.0).alias("hi"))
    return passes.grid_places(p, "lo", "hi", "n").select("p_partkey", F.col("i").cast("long").alias("i"), F.round("place", 6).alias("place"))


@_own("mirror_fill", f"{_WITH} select panel, bar, x, false mirrored from bars union all select panel, bar, 1020 - x, true from bars b where not exists (select 1 from bars a where a.panel = b.panel and abs(1020 - b.x - a.x) <= 15)")
def mirror_fill(spark, sf_dir):
    """Mirror images that no bar stands for."""
    b = _input(spark, sf_dir, "bars").select("panel", "bar", "x", F.lit(1020.0).alias("width"))
    return passes.mirror_fill(b, "panel", "x", "width").select("panel", "bar", "x", "mirrored")


@_own("dimension_evidence", f"{_WITH} select panel, mark, len from marks m where exists (select 1 from bars b where b.panel = m.panel and b.len > 20 and b.len < 15000 and abs(b.len - m.len) <= greatest(30, 0.08 * m.len))")
def dimension_evidence(spark, sf_dir):
    """Absent marks whose length a dimension shows."""
    signals = _input(spark, sf_dir, "bars").select("panel", F.col("len").alias("extent"))
    return passes.dimension_evidence(_input(spark, sf_dir, "marks").select("panel", "mark", "len"), signals, "panel")


_CIRCLES = "select event_id id, user_id % 40 panel, event_type view, 8 dia, value * 3 x, (event_id % 100) * 7.0 y from events"


@_own("cross_view_clusters", f"""with recursive c as ({_CIRCLES}), e as (select a.id a, b.id b from c a join c b on a.panel = b.panel and a.dia = b.dia and a.view <> b.view and a.id <> b.id and abs(a.x - b.x) <= 6 and abs(a.y - b.y) <= 6),
r(id, root) as (select id, id from c union select e.b, r.root from r join e on e.a = r.id), m as (select id, min(root) component from r group by 1), n as (select component, count(distinct view) views from m join c using (id) group by 1)
select id, component, views from m join n using (component) where views >= 2""")
def cross_view_clusters(spark, sf_dir):
    """Circles that agree across views (C11)."""
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return passes.cross_view_clusters(spark.sql(_CIRCLES), "panel", 6.0)


_BOXES = "select s_nationkey panel, s_suppkey rank, s_name view, s_suppkey % 10 * 100.0 x0, s_suppkey % 7 * 100.0 y0, s_suppkey % 10 * 100.0 + 250 x1, s_suppkey % 7 * 100.0 + 250 y1 from supplier"
_SPOTS = "select c_custkey id, c_nationkey panel, c_custkey % 131 * 10.0 x, c_custkey % 97 * 10.0 y from customer"


@_own("first_view", f"with v as ({_BOXES}), t as ({_SPOTS}) select id, t.panel, x, y, arg_min(view, rank) view from t left join v on v.panel = t.panel and x between x0 - 20 and x1 + 20 and y between y0 - 20 and y1 + 20 group by 1, 2, 3, 4")
def first_view(spark, sf_dir):
    """Texts in the first view that holds them."""
    for t in ("supplier", "customer"):
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return passes.first_containing_view(spark.sql(_SPOTS), spark.sql(_BOXES), "panel", 20.0).select("id", "panel", "x", "y", "view")


@_own("fused_extent", f"""{_WITH}, c as (select panel, bar id, dia, x from bars where flag = 'A'), u as (select panel, dia, x rx, len lo, len + 500 hi from bars where flag = 'R'), o as (select panel, min(len) lo, max(len) hi from bars group by 1),
h as (select c.id, u.lo, u.hi, row_number() over (partition by c.id order by abs(c.x - rx), rx, u.lo) i from c join u on u.panel = c.panel and u.dia = c.dia and abs(c.x - rx) <= 100)
select c.panel, c.id, coalesce(h.lo, o.lo) lo, coalesce(h.hi, o.hi) hi, case when h.id is null then 'outline' else 'run' end source from c join o on o.panel = c.panel left join h on h.id = c.id and i = 1""")
def fused_extent(spark, sf_dir):
    """Section clusters with the extent of an elevation run, else of the outline."""
    b = _input(spark, sf_dir, "bars")
    runs = b.filter("flag = 'R'").select("panel", "dia", F.col("x").alias("rx"), F.col("len").alias("lo"), (F.col("len") + 500).alias("hi"))
    outlines = b.groupBy("panel").agg(F.min("len").alias("lo"), F.max("len").alias("hi"))
    return passes.fused_extent(b.filter("flag = 'A'").select("panel", F.col("bar").alias("id"), "dia", "x"), runs, outlines, "panel", 100.0)


@_own("cut_extent", f"""{_WITH}, s as (select panel, x lo, x + r * 60 hi from bars), a as (select *, case when lo > max(hi) over (partition by panel order by lo, hi rows between unbounded preceding and 1 preceding) then 1 else 0 end f from s),
b as (select *, sum(f) over (partition by panel order by lo, hi) g from a), m as (select panel, min(lo) lo, max(hi) hi from b group by panel, g),
h as (select *, exists (select 1 from bars c where c.panel = m.panel and c.flag = 'A' and c.c between m.lo and m.hi) on_cut from m), q as (select *, row_number() over (partition by panel order by on_cut desc, hi - lo desc, lo) i from h) select panel, lo, hi, on_cut from q where i = 1""")
def cut_extent(spark, sf_dir):
    """The merged span on a cut, else the longest."""
    b = _input(spark, sf_dir, "bars")
    return passes.cut_extent(b.select("panel", F.col("x").alias("lo"), (F.col("x") + F.col("r") * 60).alias("hi")), b.filter("flag = 'A'").select("panel", F.col("c").alias("at")), "panel")


@_own("exact_hit", "with g as (select vec_id, unnest(range(1, 65)) i, embedding from embeddings), h as (select vec_id, i, 20 * abs(embedding[i]::double) gap from g), s as (select vec_id, i, gap, (select min(d) from (values (8.0), (10.0), (12.0), (16.0), (20.0), (25.0), (32.0)) t(d) where abs(gap - d) < 0.35) size from h) select vec_id, round(arg_min(gap, i), 6) gap, arg_min(size, i)::double size from s where size is not null group by 1")
def exact_hit(spark, sf_dir):
    """The first gap that is a standard diameter."""
    gaps = F.transform("embedding", lambda v: 20 * F.abs(v.cast("double")))
    e = table(spark, sf_dir, "embeddings").select("vec_id", passes.exact_hit(gaps, [8, 10, 12, 16, 20, 25, 32]).alias("h")).filter("h is not null")
    return e.select("vec_id", F.round("h.gap", 6).alias("gap"), "h.size")


@_own("fragment_floor", """
with f as (select l_suppkey, l_linenumber, min(greatest(l_quantity * 20, l_extendedprice / 20)) f from lineitem where l_returnflag = 'A' group by 1, 2)
select l.l_suppkey, l.l_linenumber, count(*) n, round(sum(l.l_extendedprice / 10), 4) total from lineitem l left join f on l.l_suppkey = f.l_suppkey and l.l_linenumber = f.l_linenumber where l.l_returnflag = 'R' and (f.f is null or l.l_extendedprice / 10 >= 0.5 * f.f) group by 1, 2""")
def fragment_floor(spark, sf_dir):
    """Drawn pieces shorter than half the least of their marks' longest segments go."""
    l = table(spark, sf_dir, "lineitem")
    marks = l.filter("l_returnflag = 'A'").select("l_suppkey", "l_linenumber", F.array(F.col("l_quantity") * 20, F.col("l_extendedprice") / 20).alias("segments"))
    bars = l.filter("l_returnflag = 'R'").select("l_suppkey", "l_linenumber", (F.col("l_extendedprice") / 10).alias("length"))
    return passes.drop_fragments(bars, marks, ["l_suppkey", "l_linenumber"]).groupBy("l_suppkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("length"), 4).alias("total"))
