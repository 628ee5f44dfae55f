"""Placement: lines, boxes, bends, claims, probes, tags, candidates and reasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import placement as pl
from ..functions import text as grammar
from ..operators import evidence, summaries
from .tables import sql_query, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _own(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE_SQL[name] = oracle
        return fn

    return add


def _same(name: str, text: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = sql_query(text), text


#: A segment for each distinct line item: from (price, quantity) over a run set by discount and tax.
_SEG_SQL = "select distinct l_orderkey k, l_linenumber n, l_extendedprice / 20 x0, l_quantity * 50 y0, l_extendedprice / 20 + (l_discount - 0.05) * 4000 x1, l_quantity * 50 + (l_tax - 0.04) * 4000 y1, l_returnflag dia from lineitem"


def _segments(spark, sf_dir):
    x, y = F.col("l_extendedprice") / 20, F.col("l_quantity") * 50
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), x.alias("x0"), y.alias("y0"), (x + (F.col("l_discount") - 0.05) * 4000).alias("x1"), (y + (F.col("l_tax") - 0.04) * 4000).alias("y1"), F.col("l_returnflag").alias("dia")).distinct()


@_own("line_form", f"""
with s as ({_SEG_SQL}), a as (select *, atan2(y1 - y0, x1 - x0) t from s), b as (select *, case when t < 0 then t + pi() when t >= pi() - 1e-9 then 0 else t end th from a)
select k, n, x0, y0, dia, round(y0 * cos(th) - x0 * sin(th), 6) as off_, round(least(x0 * cos(th) + y0 * sin(th), x1 * cos(th) + y1 * sin(th)), 6) s0, round(greatest(x0 * cos(th) + y0 * sin(th), x1 * cos(th) + y1 * sin(th)), 6) s1 from b""")
def line_form(spark, sf_dir):
    """Canonical form of a segment: offset and extent along its own direction."""
    s = _segments(spark, sf_dir)
    f = pl.line_form(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    return s.select("k", "n", "x0", "y0", "dia", F.round(f["off"], 6).alias("off_"), F.round(f["s0"], 6).alias("s0"), F.round(f["s1"], 6).alias("s1"))


@_own("run_families", f"""
with s as ({_SEG_SQL}), a as (select dia, x1 - x0 dx, y1 - y0 dy, degrees(atan2(y1 - y0, x1 - x0)) d from s), b as (select *, case when d < 0 then d + 180 when d >= 180 then d - 180 else d end g from a)
select dia, case when g < 8 or g > 172 then 'h' when abs(g - 90) < 8 then 'v' else 'other' end family,
 case when abs(dx) > 2 * abs(dy) then 'Horizontal' when abs(dy) > 2 * abs(dx) then 'Vertical' else 'Mixed' end extent, count(*) n from b group by 1, 2, 3""")
def run_families(spark, sf_dir):
    """Runs by angle within 8 degrees, and by the ratio of their extents."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    extent = F.when(F.abs(dx) > 2 * F.abs(dy), "Horizontal").when(F.abs(dy) > 2 * F.abs(dx), "Vertical").otherwise("Mixed")
    return _segments(spark, sf_dir).groupBy("dia", pl.run_family(dx, dy).alias("family"), extent.alias("extent")).agg(F.count(F.lit(1)).alias("n"))


@_own("box_filter", f"select dia, count(*) n, sum(case when x0 between 975 and 3025 and y0 between 475 and 2025 then 1 else 0 end) padded, sum(case when x0 between 1000 and 3000 and y0 between 500 and 2000 and x1 between 1000 and 3000 and y1 between 500 and 2000 then 1 else 0 end) whole from ({_SEG_SQL}) s group by dia")
def box_filter(spark, sf_dir):
    """Starts within a padded box, and segments wholly within the bare one."""
    box = tuple(F.lit(v) for v in (1000.0, 500.0, 3000.0, 2000.0))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    return _segments(spark, sf_dir).groupBy("dia").agg(F.count(F.lit(1)).alias("n"), F.count_if(pl.in_box(x0, y0, box, 25.0)).alias("padded"), F.count_if(pl.in_box(x0, y0, box) & pl.in_box(x1, y1, box)).alias("whole"))


@_own("tip_to_bar", f"""
with s as ({_SEG_SQL}), p as (select c_custkey pid, c_acctbal / 2 px, (c_custkey % 50) * 50 py, ['A', 'N', 'R'][1 + c_custkey % 3] dia from customer),
j as (select p.dia, pid, s.k * 10 + s.n sid, case when (x1 - x0) ^ 2 + (y1 - y0) ^ 2 < 1e-9 then 0 else greatest(0, least(1, ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / ((x1 - x0) ^ 2 + (y1 - y0) ^ 2))) end t, px, py, x0, y0, x1, y1 from p join s on p.dia = s.dia),
d as (select dia, pid, sid, sqrt((px - x0 - t * (x1 - x0)) ^ 2 + (py - y0 - t * (y1 - y0)) ^ 2) distance from j)
select dia, pid, sid, round(distance, 4) distance from (select *, row_number() over (partition by dia, pid order by distance, sid) r from d where distance < 60) w where r = 1""")
def tip_to_bar(spark, sf_dir):
    """Each leader tip to the nearest bar of its diameter within 60, by distance from the segment."""
    s = _segments(spark, sf_dir).withColumn("sid", F.col("k") * 10 + F.col("n"))
    kind = F.element_at(F.array(*[F.lit(x) for x in "ANR"]), (F.col("c_custkey") % 3 + 1).cast("int"))
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pid"), (F.col("c_acctbal") / 2).alias("px"), (F.col("c_custkey") % 50 * 50).cast("double").alias("py"), kind.alias("dia"))
    return evidence.nearest_segment(p, s, ["dia"], 60.0).select("dia", "pid", "sid", F.round("distance", 4).alias("distance"))


@_own("leader_walk", f"""
with s as (select k, x0, y0, x1, y1, dia from ({_SEG_SQL}) z where (x1 - x0) ^ 2 + (y1 - y0) ^ 2 >= 110 ^ 2),
e as (select dia, k, x0 x, y0 y, x1 fx, y1 fy from s union all select dia, k, x1, y1, x0, y0 from s),
t as (select c_custkey tag, c_acctbal / 2 tx, (c_custkey % 50) * 50 ty, ['A', 'N', 'R'][1 + c_custkey % 3] dia from customer),
a as (select dia, tag, k, fx, fy from (select t.dia, tag, k, fx, fy, row_number() over (partition by tag order by sqrt((tx - x) ^ 2 + (ty - y) ^ 2), k, fx, fy) r from t join e on t.dia = e.dia and sqrt((tx - x) ^ 2 + (ty - y) ^ 2) < 480) w where r = 1),
h as (select p_partkey head, p_retailprice * 2.5 hx, p_size * 40 hy from part)
select tag, k, head, round(d, 4) d from (select tag, k, head, sqrt((fx - hx) ^ 2 + (fy - hy) ^ 2) d, row_number() over (partition by tag order by sqrt((fx - hx) ^ 2 + (fy - hy) ^ 2), head) r from a join h on sqrt((fx - hx) ^ 2 + (fy - hy) ^ 2) < 160) w where r = 1""")
def leader_walk(spark, sf_dir):
    """A tag takes the long segment whose end is nearest, and its far end snaps to an arrow head."""
    s = _segments(spark, sf_dir).filter("pow(x1 - x0, 2) + pow(y1 - y0, 2) >= 12100")
    kind = F.element_at(F.array(*[F.lit(x) for x in "ANR"]), (F.col("c_custkey") % 3 + 1).cast("int"))
    tags = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tag"), (F.col("c_acctbal") / 2).alias("tx"), (F.col("c_custkey") % 50 * 50).cast("double").alias("ty"), kind.alias("dia"))
    heads = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("head"), (F.col("p_retailprice") * 2.5).alias("hx"), (F.col("p_size") * 40.0).alias("hy"))
    return evidence.leader_walk(tags, s, heads, ["dia"], 480.0, 160.0).select("tag", "k", "head", F.round("d", 4).alias("d"))


@_own("bent_lengths", """
select p_partkey, len(s) n_segments, round(list_sum(s) - (case when p_size % 5 = 0 then 8 else greatest(len(s) - 1, 0) end) * 2 * (p_size / 1000.0), 6) bent, cast(floor(p_retailprice / (100 + p_size)) as bigint) + 1 bars,
 round(case len(s) when 1 then s[1] when 2 then s[1] else s[1] - s[3] end, 6) end_x, round(case len(s) when 1 then 0 else s[2] end, 6) end_y
from (select *, list_filter([p_size / 10.0, case when p_partkey % 3 = 0 then 0 else p_retailprice / 1000 end, case when p_partkey % 4 = 0 then null else 0.25 end], lambda v: coalesce(v, 0) > 1e-6) s from part) x""")
def bent_lengths(spark, sf_dir):
    """Segments in order, bend deductions, run counts and the end of the schematic line."""
    p = table(spark, sf_dir, "part")
    a, b, c = F.col("p_size") / 10.0, F.when(F.col("p_partkey") % 3 == 0, 0.0).otherwise(F.col("p_retailprice") / 1000), F.when(F.col("p_partkey") % 4 != 0, 0.25)
    p = p.withColumn("s", pl.nonzero_segments({"A": a, "B": b, "G": c}))
    end = F.element_at(pl.zigzag(F.col("s")), -1)
    return p.select("p_partkey", F.size("s").alias("n_segments"), F.round(pl.bent_length(F.col("s"), F.col("p_size"), F.col("p_size") % 5 == 0), 6).alias("bent"), pl.run_count(F.col("p_retailprice"), F.col("p_size") + 100).alias("bars"), F.round(end.x, 6).alias("end_x"), F.round(end.y, 6).alias("end_y"))


@_own("panel_axes", """
with p as (select p_partkey k, p_retailprice len, 8 + p_size % 5 * 2 dia, case when p_partkey % 11 = 0 then null else 200.0 end t, p_size * 60.0 w, 400 + p_retailprice h, p_size * 40.0 a, case when p_partkey % 6 = 0 then 128.0 + p_size end b,
  case when p_partkey % 9 = 0 then 'T8 U Bar' end note, case when p_partkey % 13 = 0 then 'M_T1' else 'M_17' end shape from part),
q as (select *, coalesce(t, 200) - 60 - dia clear, greatest(a, coalesce(b, 0)) m from p),
r as (select *, coalesce(abs(a - clear) <= 18, false) or coalesce(abs(b - clear) <= 18, false) or note is not null or shape = 'M_T1' through,
  case when (w - m < -20) <> (h - m < -20) then case when w - m < -20 then 'Z' else 'X' end when abs(h - m) < abs(w - m) then 'Z' else 'X' end run from q),
s as (select *, case when through then 'Y' when run = 'X' then 'Z' else 'X' end fold from r)
select k, run, fold, through, case when run = 'X' then 100.0 when fold = 'X' then 25.0 else 0.0 end x, case when fold = 'Y' then 25.0 else 0.0 end y, case when run = 'Z' then 100.0 when fold = 'Z' then 25.0 else 0.0 end z from s""")
def panel_axes(spark, sf_dir):
    """The axes that a bar follows in its panel, and a point of its plane on them."""
    k, size = F.col("p_partkey"), F.col("p_size")
    legs = F.array(size * 40.0, F.when(k % 6 == 0, size + 128.0))
    a = pl.bar_axes(legs, F.col("p_retailprice"), size % 5 * 2 + 8, F.when(k % 13 == 0, "M_T1").otherwise("M_17"), F.when(k % 9 == 0, "T8 U Bar"), F.when(k % 11 != 0, 200.0), size * 60.0, F.col("p_retailprice") + 400)
    q = table(spark, sf_dir, "part").select(k.alias("k"), *[c.alias(n) for n, c in a.items()])
    return q.select("*", pl.in_panel(F.lit(100.0), F.lit(25.0), F.col("run"), F.col("fold"), (F.lit(0.0), F.lit(0.0), F.lit(0.0))).alias("p")).select("k", "run", "fold", "through", "p.*")


@_own("shape_families", """
select case when shape is null or shape = '' then '?' when shape = 'M_00' then 'straight' when shape in ('M_17', 'M_17A') then 'u_bar' when shape in ('M_T1', 'M_T10') then 'link_tie' else 'bent_other' end family, count(*) n
from (select ['M_00', 'M_17', 'M_17A', 'M_T1', 'M_T10', 'X', '', null][1 + p_partkey % 8] shape from part) x group by 1""")
def shape_families(spark, sf_dir):
    """Families of shape codes (P25)."""
    codes = F.array(*[F.lit(x) for x in ("M_00", "M_17", "M_17A", "M_T1", "M_T10", "X", "", None)])
    shape = F.element_at(codes, (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").groupBy(pl.shape_family(shape).alias("family")).agg(F.count(F.lit(1)).alias("n"))


# demand of projection and fill for each schedule and element that share a mark, and the best element


@_own("element_fit", """
with m as (select distinct o_custkey schedule, o_orderkey, l_partkey mark, l_extendedprice / 10 len, l_quantity qty from lineitem join orders on l_orderkey = o_orderkey),
e as (select p_partkey mark, p_size element, 4000 + 20 * p_size span from part),
w as (select schedule, count(distinct mark) want from m group by schedule),
hit as (select distinct m.schedule, e.element, e.span from m join e on m.mark = e.mark),
overlap as (select schedule, element, count(distinct m.mark) both_n from m join e on m.mark = e.mark group by schedule, element),
fit as (select hit.schedule, hit.element, -cast(sum(cast(greatest(len - span - 25, 0) * qty as decimal(18,3))) as double) / 1000 + least(max(len) / max(span), 1) * 50 fit from hit join m on hit.schedule = m.schedule group by hit.schedule, hit.element),
s as (select f.schedule, f.element, round(cast(both_n as double) / want * 200 + cast(fit as double), 6) score, round(cast(both_n as double) / want, 2) tag_overlap from fit f join overlap o on f.schedule = o.schedule and f.element = o.element join w on w.schedule = f.schedule)
select schedule, element, score, tag_overlap from (select *, row_number() over (partition by schedule order by score desc, element desc) r from s) x where r = 1""")
def element_fit(spark, sf_dir):
    """The element that a schedule belongs to."""
    l, o, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    rows = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("schedule"), "o_orderkey", F.col("l_partkey").alias("mark"), (F.col("l_extendedprice") / 10).alias("len"), F.col("l_quantity").alias("qty")).distinct()
    return summaries.schedule_fit(rows, p.select(F.col("p_partkey").alias("mark"), F.col("p_size").alias("element"), (4000 + 20 * F.col("p_size")).alias("span")), "schedule")


@_own("fused_confidence", "select user_id, views, inside, case when inside then c else round(c * 0.6, 2) end confidence from (select user_id, views, inside, cast(least(0.98, cast(0.9 as double) + cast(0.04 as double) * (views - 1)) as double) c from (select user_id, count(distinct event_type) views, min(value) > 1 inside from events group by user_id) a) b")
def fused_confidence(spark, sf_dir):
    """Confidence from agreeing views, less outside the concrete."""
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("views"), (F.min("value") > 1).alias("inside"))
    return g.select("user_id", "views", "inside", pl.fused_confidence(F.col("views"), F.col("inside")).alias("confidence"))


@_own("bucket_probe", """
with a as (select c_custkey, c_nationkey k, cast(floor(c_acctbal / 100) as bigint) b from customer), h as (select s_nationkey k, cast(floor(s_acctbal / 100) as bigint) b, min(s_suppkey) s_suppkey from supplier group by 1, 2),
p as (select c_custkey, k, b + o b, pr, o from a cross join (values (0, 0), (1, -1), (2, 1), (3, -2), (4, 2)) t(pr, o))
select k, c_custkey, o probe, s_suppkey from (select p.k, c_custkey, o, s_suppkey, row_number() over (partition by p.k, c_custkey order by pr) r from p join h on p.k = h.k and p.b = h.b) x where r = 1""")
def bucket_probe(spark, sf_dir):
    """First of the neighbouring buckets 0, -1, 1, -2, 2 that holds a value."""
    left = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), F.floor(F.col("c_acctbal") / 100).alias("b"))
    right = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), F.floor(F.col("s_acctbal") / 100).alias("b"))
    return evidence.bucket_probe(left, right, ["k"], "c_custkey", "b", "s_suppkey")


# section frame to elevation frame, both boxes known for each view


@_own("frame_remap", """
with b as (select l_suppkey view_id, min(l_extendedprice) c0, max(l_extendedprice) c1, min(l_quantity) * 100 e0, max(l_quantity) * 100 e1 from lineitem group by l_suppkey)
select view_id, l_orderkey, l_linenumber, l_extendedprice, round(e0 + (l_extendedprice - c0) / (c1 - c0) * (e1 - e0), 4) x from lineitem join b on l_suppkey = view_id where c1 > c0""")
def frame_remap(spark, sf_dir):
    """Coordinates of a view's crop in its extent."""
    l = table(spark, sf_dir, "lineitem").withColumn("view_id", F.col("l_suppkey"))
    frames = l.groupBy("view_id").agg(F.min("l_extendedprice").alias("c0"), F.max("l_extendedprice").alias("c1"), (F.min("l_quantity") * 100).alias("e0"), (F.max("l_quantity") * 100).alias("e1"))
    return summaries.remapped(l.select("view_id", "l_orderkey", "l_linenumber", "l_extendedprice"), frames, "view_id", "l_extendedprice").withColumnRenamed("x_there", "x")


# every source of a mark against its first: which fields differ


@_own("first_source_diffs", """
with r as (select l_partkey mark, l_suppkey src, max(l_quantity) qty, max(l_extendedprice) len, max(l_returnflag) shape from lineitem group by l_partkey, l_suppkey),
b as (select *, first_value(qty) over w qty0, first_value(len) over w len0, first_value(shape) over w shape0, first_value(src) over w src0 from r window w as (partition by mark order by src))
select mark, src0 base_src, src, case when qty <> qty0 then 1 else 0 end qty_diff, case when abs(len - len0) > 1.0 then 1 else 0 end len_diff, case when shape <> shape0 then 1 else 0 end shape_diff from b where src <> src0 and (qty <> qty0 or abs(len - len0) > 1.0 or shape <> shape0)""")
def first_source_diffs(spark, sf_dir):
    """Sources of a mark that differ from its first."""
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("mark"), F.col("l_suppkey").alias("src")).agg(F.max("l_quantity").alias("qty"), F.max("l_extendedprice").alias("len"), F.max("l_returnflag").alias("shape"))
    return summaries.against_first(r, "mark", "src", {"qty": None, "len": 1.0, "shape": None})


@_own("claim_leftovers", """
with base as (select c_nationkey k, c_custkey id, c_acctbal lo, c_acctbal + 400 hi from customer), claims as (select s_nationkey k, s_acctbal lo, s_acctbal + 150 hi from supplier),
a as (select *, max(hi) over (partition by k order by lo, hi rows between unbounded preceding and 1 preceding) reach from claims), b as (select *, sum(case when reach is null or lo > reach then 1 else 0 end) over (partition by k order by lo, hi) i from a),
m as (select k, min(lo) lo, max(hi) hi from b group by k, i),
t as (select base.k, id, greatest(base.lo, m.lo) lo, least(base.hi, m.hi) hi from base join m on base.k = m.k and base.lo < m.hi and m.lo < base.hi union all select k, id, lo, lo from base union all select k, id, hi, hi from base),
w as (select k, id, hi piece_lo, lead(lo) over (partition by k, id order by lo, hi) piece_hi from t)
select k, id, piece_lo, piece_hi from w where piece_lo < piece_hi""")
def claim_leftovers(spark, sf_dir):
    """What claims leave of intervals."""
    base = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("lo"), (F.col("c_acctbal") + 400).alias("hi"))
    claims = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("c_lo"), (F.col("s_acctbal") + 150).alias("c_hi"))
    return evidence.subtract_claims(base, claims, ["k"], 400.0)


# arcs of one centre and radius cover 100 degrees or more together: a sleeve (C14)


@_own("arc_sleeves", """
with a as (select cast(floor(l_extendedprice / 500) as bigint) cx, l_suppkey cy, cast(l_quantity as bigint) r, cast(l_orderkey * 37 % 360 as bigint) a0, cast(l_partkey * 53 % 360 as bigint) a1 from lineitem)
select cx, cy, r, sum((a1 - a0 + 360) % 360) coverage, count(*) arcs from a group by cx, cy, r having sum((a1 - a0 + 360) % 360) >= 100""")
def arc_sleeves(spark, sf_dir):
    """Circles that arcs mostly cover (C14)."""
    whole = lambda c: F.expr(f"cast({c} as bigint)")
    a = table(spark, sf_dir, "lineitem").select(whole("floor(l_extendedprice / 500)").alias("cx"), F.col("l_suppkey").alias("cy"), whole("l_quantity").alias("r"), whole("l_orderkey * 37 % 360").alias("a0"), whole("l_partkey * 53 % 360").alias("a1"))
    return summaries.sleeves(a, ["cx", "cy", "r"], "a0", "a1")


_PROFILE_SQL = """
with e as (select distinct l_suppkey view_id, l_orderkey, l_linenumber, l_extendedprice / 20 x0, l_extendedprice / 20 + l_quantity * 10 x1, l_partkey * 2 y0, l_partkey * 2 + l_discount * 40 y1 from lineitem),
u as (select *, greatest(0, least(199, cast(trunc(x0 / 27.5) as int))) i0, greatest(0, least(199, cast(trunc(x1 / 27.5) as int))) i1 from e where abs(y1 - y0) <= 3 and abs(x1 - x0) >= 40)
select view_id, bin, round(min((y0 + y1) / 2), 1) lo, round(max((y0 + y1) / 2), 1) hi from (select view_id, y0, y1, cast(unnest(generate_series(i0, i1)) as int) bin from u) s group by view_id, bin"""


@_own("depth_profile", _PROFILE_SQL)
def depth_profile(spark, sf_dir):
    """Lowest and highest edge over 200 stations (C20, first part)."""
    x = F.col("l_extendedprice") / 20
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("view_id"), "l_orderkey", "l_linenumber", x.alias("x0"), (x + F.col("l_quantity") * 10).alias("x1"), (F.col("l_partkey") * 2).cast("double").alias("y0"), (F.col("l_partkey") * 2 + F.col("l_discount") * 40).alias("y1"), F.lit(5500.0).alias("width")).distinct()
    return evidence.depth_profile(e, ["view_id"], "width")


@_own("depth_zones")
def depth_zones(spark, sf_dir):
    """Runs of constant depth (C20, second part); held by a hand fixture."""
    return evidence.depth_zones(depth_profile(spark, sf_dir), "view_id", 27.5)


# why a mark is not fully located: the first reason that holds


@_own("unlocated_reasons", """
with m as (select p_partkey mark, p_size dia, p_retailprice cut, p_size % 7 + 1 qty, p_partkey % 4 located from part),
a as (select c_custkey % 60 dia, c_acctbal / 5 len, c_custkey % 5 + 1 n from customer),
g as (select mark, min(abs(len - cut) / greatest(cut, 1)) err_cut, min(abs(len - cut / 3) / greatest(cut / 3, 1)) err_leg, count(len) runs,
 coalesce(sum(case when abs(len - cut) / greatest(cut, 1) <= 0.1 then n end), 0) pool, coalesce(sum(case when abs(len - cut / 3) / greatest(cut / 3, 1) <= 0.1 then n end), 0) legs, max(qty) qty, max(located) located from m left join a on m.dia = a.dia group by mark)
select mark, cast(pool as bigint) pool, cast(legs as bigint) legs, case when runs = 0 then 'NO_BAR_OF_DIAMETER' when least(err_cut, err_leg) > 0.1 then 'NO_RUN_OF_LENGTH' when located > 0 then 'PARTLY_DRAWN' when pool = 0 then 'LEG_MATCH_ONLY' when pool < qty then 'TOO_FEW_DRAWN' else 'CLAIMED_BY_OTHERS' end reason from g""")
def unlocated_reasons(spark, sf_dir):
    """Why bars of a mark were not found."""
    p, c = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    marks = p.select(F.col("p_partkey").alias("mark"), F.col("p_size").alias("dia"), F.col("p_retailprice").alias("cut"), (F.col("p_retailprice") / 3).alias("leg"), (F.col("p_size") % 7 + 1).alias("qty"), (F.col("p_partkey") % 4).alias("located"))
    return summaries.unlocated_reasons(marks, c.select((F.col("c_custkey") % 60).alias("dia"), (F.col("c_acctbal") / 5).alias("len"), (F.col("c_custkey") % 5 + 1).alias("n")))


_TAG_SQL = r"case when regexp_matches(t, '^-\(([0-9]+)\)\s*-?\(?\s*T([0-9]+)(.*?)\)?$') then 'note' when regexp_full_match(t, '[A-Z][0-9]?') then 'mark' when regexp_matches(t, '^T[0-9]+') then 'spacing' else 'none' end"


@_own("tag_kinds", rf"""
with t as (select o_orderkey, ['-(' || o_orderkey || ') -(T12 EF)', 'B' || o_orderkey % 10, 'T8 @150', 'see plan', '-(3)T10', 'AB'][1 + o_orderkey % 6] t from orders)
select o_orderkey, {_TAG_SQL} kind, case when t like '-(%' then cast(regexp_extract(t, '^-\(([0-9]+)\)', 1) as bigint) end qty from t""")
def tag_kinds(spark, sf_dir):
    """Tag grammar of the older sheets: notes, mark letters, spacings."""
    k = F.col("o_orderkey")
    choices = F.array(F.concat(F.lit("-("), k, F.lit(") -(T12 EF)")), F.concat(F.lit("B"), k % 10), F.lit("T8 @150"), F.lit("see plan"), F.lit("-(3)T10"), F.lit("AB"))
    t = F.element_at(choices, (k % 6 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", grammar.tag_kind(t).alias("kind"), grammar.tag_quantity(t).alias("qty"))


@_own("all_diameters", r"""
with t as (select p_partkey, 'x ' || (p_size % 9 + 1) || ' -T' || p_size || ' and T8 @' || p_size || ', T' || p_size || ' again' t from part)
select p_partkey, cast(regexp_extract(t, '\(?([0-9]+)\)?\s*-\s*\(?T([0-9]+)\)?\b', 1) as int) n, cast(regexp_extract(t, '\(?([0-9]+)\)?\s*-\s*\(?T([0-9]+)\)?\b', 2) as int) dia, list_sort(list_distinct(list_transform(regexp_extract_all(t, '\bT([0-9]+)\b', 1), lambda x: cast(x as int)))) dias from t""")
def all_diameters(spark, sf_dir):
    """Count callouts anywhere in a text, and every diameter that it names."""
    p = table(spark, sf_dir, "part")
    t = F.concat(F.lit("x "), F.col("p_size") % 9 + 1, F.lit(" -T"), F.col("p_size"), F.lit(" and T8 @"), F.col("p_size"), F.lit(", T"), F.col("p_size"), F.lit(" again"))
    found = grammar.count_callout(t)
    return p.select("p_partkey", found["n"].alias("n"), found["dia"].alias("dia"), grammar.diameters(t).alias("dias"))


_HEADS = ["Mark", "schedule  mark", "Bar Diameter", "Shape", "Total Bar Length", "length", "Bar Length", "Quantity", "No.", "Weight kg", "b", "Remarks"]


@_own("column_heads", f"""
with h as (select {_HEADS}[1 + p_partkey % 12] raw from part), t as (select raw, trim(regexp_replace(lower(raw), '\\s+', ' ', 'g')) t from h)
select raw, case when t in ('schedule mark', 'mark') then 'Schedule Mark' when contains(t, 'diameter') then 'Bar Diameter' when t = 'shape' then 'Shape' when contains(t, 'total') or t = 'length' then 'Total Bar Length' when contains(t, 'bar length') then 'Bar Length' when contains(t, 'quantity') or t = 'no.' then 'Quantity' when contains(t, 'weight') then 'Weight' when regexp_full_match(t, '[a-h]') then upper(t) else t end head, count(*) n from t group by 1, 2""")
def column_heads(spark, sf_dir):
    """Canonical names of column headers."""
    raw = F.element_at(F.array(*[F.lit(x) for x in _HEADS]), (F.col("p_partkey") % 12 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(raw.alias("raw")).groupBy("raw", grammar.column_head(F.col("raw")).alias("head")).agg(F.count(F.lit(1)).alias("n"))


_LINE_SQL = r"^T([0-9]+)\s+([0-9.]+)k\s+([0-9.]+)k\s+([+\-][0-9.]+)k\s+([0-9]+%|extra|-)\s*$"


@_own("report_lines", rf"""
with t as (select p_partkey, case when p_partkey % 5 = 0 then 'TOTAL 1k' else 'T' || p_size || '   ' || p_size || '.25k  ' || p_partkey || '.5k  -1.00k  ' || case when p_partkey % 2 = 0 then 'extra' else '86%' end end line from part)
select p_partkey, cast(regexp_extract(line, '{_LINE_SQL}', 1) as int) dia, cast(regexp_extract(line, '{_LINE_SQL}', 2) as double) recon, cast(regexp_extract(line, '{_LINE_SQL}', 3) as double) official, regexp_extract(line, '{_LINE_SQL}', 5) pct from t where regexp_matches(line, '{_LINE_SQL}')""")
def report_lines(spark, sf_dir):
    """Rows read back from a printed tally."""
    k = F.col("p_partkey")
    line = F.when(k % 5 == 0, "TOTAL 1k").otherwise(F.concat(F.lit("T"), F.col("p_size"), F.lit("   "), F.col("p_size"), F.lit(".25k  "), k, F.lit(".5k  -1.00k  "), F.when(k % 2 == 0, "extra").otherwise("86%")))
    row = grammar.tally_line(F.col("line"))
    return table(spark, sf_dir, "part").select("p_partkey", line.alias("line")).select("p_partkey", *[row[c].alias(c) for c in ("dia", "recon", "official", "pct")]).filter("dia is not null")


# candidate documents: exact stem first, then longest core, nearest in time, schedule sheets


@_own("candidate_ranking", """
with c as (select o_custkey, o_orderkey, o_orderpriority name, split_part(o_orderpriority, '-', 1) core, o_orderdate from orders), d as (select c_custkey, c_custkey % 5 + 1 want from customer)
select o_custkey, o_orderkey, rank_no from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by case when core = cast(want as string) then 0 else 1 end, length(name) desc, abs(year(o_orderdate) * 12 + month(o_orderdate) - 1996 * 12), case when name like '%SPEC%' then 0 else 1 end, o_orderkey) rank_no from c join d on o_custkey = c_custkey) x where rank_no <= 3""")
def candidate_ranking(spark, sf_dir):
    """The first three candidates of each key."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 5 + 1).alias("want"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    core = F.split_part("o_orderpriority", F.lit("-"), F.lit(1)) == F.col("want").cast("string")
    months = F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1996 * 12
    order = [F.when(core, 0).otherwise(1), F.length("o_orderpriority").desc(), F.abs(months), F.when(F.col("o_orderpriority").contains("SPEC"), 0).otherwise(1)]
    return summaries.ranked_candidates(j, "o_custkey", "o_orderkey", order, 3)
