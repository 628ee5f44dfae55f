"""Bars implied by drawings, section evidence and bent shapes, over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import shapes
from ..operators import sections, synthesis
from .assembly_queries import _L, _sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _own(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE_SQL[name] = oracle
        return fn

    return add


#: Panels of 40 orders; upright meshes on a grid of 80, on three depths.
_UPRIGHT = "select o // 160 panel, 8 + 4 * (p % 3) dia, floor(e / 3000) * 80.0e0 x, k % 3 * 60.0e0 z, q * 10 lo, q * 10 + 100 + p % 900 hi from l where f <> 'N'"
_CALLOUTS = "select o // 160 panel, 8 + 4 * (p % 2) dia, 50.0e0 + 25 * (p % 3) pitch from l where f = 'N' and k = 1"
_SIZES = "select distinct o // 160 panel, 600.0e0 + o // 160 % 7 * 400 width, 2400.0e0 height, 160.0e0 thickness from l"


def _own_sql(spark, sf_dir, text):
    return _sql(spark, sf_dir, text.replace("//", "div"))


@_own("tie_stacks")
def tie_stacks(spark, sf_dir):
    """Ties over the stretches that pairs of main bars share."""
    bars, callouts, panels = (_own_sql(spark, sf_dir, t) for t in (_UPRIGHT, _CALLOUTS, _SIZES))
    stacks = synthesis.tie_stacks(bars, callouts, "panel")
    return synthesis.place_ties(stacks, panels, "panel").groupBy("panel", "dia", "x_lo", "x_hi").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("first"), F.max("y").alias("last"), F.max("loop_mm").alias("loop_mm"))


_HAIRPINS = f"""with {_L}, u as ({_UPRIGHT}), c as ({_CALLOUTS}), s as ({_SIZES}), t as (select panel, dia, row_number() over (partition by panel order by count(*) desc, dia, pitch) r from c group by panel, dia, pitch),
m as (select u.panel, u.dia, x, z, lo, hi from u join t on t.panel = u.panel and t.dia = u.dia and r = 1),
a as (select *, case when lo > max(hi) over (partition by panel, dia, x, z order by lo, hi rows between unbounded preceding and 1 preceding) + 5 then 1 else 0 end n from m),
b as (select *, sum(n) over (partition by panel, dia, x, z order by lo, hi) g from a), i as (select panel, dia, x, z, min(lo) lo, max(hi) hi from b group by panel, dia, x, z, g),
f as (select panel, dia, x, count(distinct z) faces from i group by 1, 2, 3 having count(distinct z) >= 2),
e as (select panel, dia, x, y, sum(d) d from (select panel, dia, x, lo y, 1 d from i union all select panel, dia, x, hi, -1 from i) z group by 1, 2, 3, 4),
w as (select *, sum(d) over (partition by panel, dia, x order by y) depth, lead(y) over (partition by panel, dia, x order by y) nxt from e),
h as (select w.panel, w.dia, w.x, y lo, nxt hi from w join f on f.panel = w.panel and f.dia = w.dia and f.x = w.x where depth >= faces),
j as (select *, case when lo > lag(hi) over (partition by panel, dia, x order by lo) then 1 else 0 end n from h), k2 as (select *, sum(n) over (partition by panel, dia, x order by lo) g from j), common as (select panel, dia, x, min(lo) lo, max(hi) hi from k2 group by panel, dia, x, g),
ends as (select panel, dia, x, lo y, 1 way from common union all select panel, dia, x, hi, -1 from common), ub as (select o // 160 panel, floor(e / 3000) * 80.0e0 + 30 ux, q * 40 uy from l where f = 'N' and k = 2)
select ends.panel, x, least(greatest(y, 30), height - 30) y, way, dia from ends join s on s.panel = ends.panel where y between 0 and height and least(greatest(y, 30), height - 30) + 400 * way between 0 and height
 and not exists (select 1 from ub where ub.panel = ends.panel and abs(ux - x) < 120 and abs(uy - y) < 200)"""


@_own("hairpin_ends", _HAIRPINS)
def hairpin_ends(spark, sf_dir):
    """Hairpins at the free ends of bars on several faces."""
    bars, callouts, panels = (_own_sql(spark, sf_dir, t) for t in (_UPRIGHT, _CALLOUTS, _SIZES))
    ubars = _own_sql(spark, sf_dir, "select o // 160 panel, floor(e / 3000) * 80.0e0 + 30 x, q * 40 y from l where f = 'N' and k = 2")
    return synthesis.hairpins(bars, ubars, callouts, panels, "panel")


@_own("column_ties")
def column_ties(spark, sf_dir):
    """Ties around slim columns, from lines across without depth evidence."""
    bars = _own_sql(spark, sf_dir, "select o // 160 panel, id, 8 + 2 * (p % 3) dia, case when k % 3 = 0 then 'section' when k % 3 = 1 then 'plane-snap' else 'default' end z_source, 10.0e0 x0, 10 + p * 7 % 600 x1, q * 48 y, 1.0e0 * (p * 7 % 600) length from l where f <> 'N'")
    straight = _own_sql(spark, sf_dir, "select o // 160 panel, 8 + 2 * (p % 3) dia, 1.0e0 * (p * 5 % 900) length from l where f = 'N' and k = 3")
    return synthesis.column_ties(bars, straight, _own_sql(spark, sf_dir, _SIZES), "panel")


_UNITS = "select s element, case when k % 2 = 0 then 'plan_cut' else 'end_cut' end kind, case p % 3 when 0 then 'cluster' when 1 then 'pitch' else 'single' end tier, 8 + 2 * (p % 4) dia, id unit, case p % 3 when 2 then 1 else 2 + cast(q as bigint) % 5 end strength, case p % 3 when 1 then 2 + cast(q as bigint) % 5 else 1 end n from l where f = 'R'"
_MARKS = "select s element, 8 + 2 * (p % 4) dia, id mark, cast(q as bigint) % 7 qty from l where f = 'A'"


@_own("section_bars", f"""with {_L}, u as ({_UNITS}), m as ({_MARKS}), n as (select *, sum(n) over (partition by element, dia order by kind desc, case tier when 'cluster' then 1 when 'pitch' then 2 else 3 end, strength desc, unit rows unbounded preceding) til from u),
w as (select *, sum(qty) over (partition by element, dia order by mark rows unbounded preceding) til from m where qty > 0), e as (select *, til - n + seq + 1 pos from n, range(6) r(seq) where seq < n)
select w.element, w.dia, mark, kind, tier, unit, seq, case tier when 'cluster' then 'section_multi_cut' when 'pitch' then 'section_pitch' else 'section_single_cut' end evidence from w join e on e.element = w.element and e.dia = w.dia and pos between w.til - qty + 1 and w.til""")
def section_bars(spark, sf_dir):
    """Marks placed by clusters, pitch groups and single circles of sections, in order of trust."""
    return sections.triangulate(_sql(spark, sf_dir, _UNITS), _sql(spark, sf_dir, _MARKS), ["element", "dia"], ["mark"])


@_own("bent_shapes")
def bent_shapes(spark, sf_dir):
    """Filleted shapes from leg dimensions, scaled to the cut length, with residual and factor."""
    names = F.array(*[F.lit(n) for n in [*shapes.SHAPES, "unlisted"]])
    l = _sql(spark, sf_dir, "select * from l").withColumn("shape", F.get(names, (F.col("p") % 11).cast("int"))).withColumn("dia", 8 + 4 * (F.col("k") % 5))
    dims = F.create_map(*[x for i, c in enumerate("ABCDEG") for x in (F.lit(c), F.when((F.col("id") + i) % 37 != 0, 60 + (F.col("q") * (i + 3) * 7) % 900))])
    made = l.select("id", "shape", "dia", shapes.bent_bar(F.col("shape"), dims, F.col("dia").cast("double"), F.round(F.col("e") / 20)).alias("b"))
    return made.select("id", "shape", "dia", "b.error", "b.geometric_mm", "b.residual_mm", "b.scale_applied", F.size("b.pts").alias("points"), F.round(shapes._length(F.col("b.pts_exact")), 3).alias("exact_mm"))
