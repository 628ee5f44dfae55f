"""Clusters, intervals, joins by distance, polylines and distributions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import clustering, joins, summaries
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


@_own("single_link_1d", "select c_nationkey, cluster, count(*) n, min(c_acctbal) lo, max(c_acctbal) hi from (select *, sum(nw) over (partition by c_nationkey order by c_acctbal, c_custkey rows between unbounded preceding and current row) cluster from (select c_nationkey, c_custkey, c_acctbal, case when c_acctbal - lag(c_acctbal) over (partition by c_nationkey order by c_acctbal, c_custkey) > 25 then 1 else 0 end nw from customer) a) b group by c_nationkey, cluster")
def single_link_1d(spark, sf_dir):
    """Single-link clusters of one coordinate."""
    c = clustering.single_link(table(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal"), ["c_nationkey"], "c_acctbal", 25.0)
    return c.groupBy("c_nationkey", "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))


@_own("anchor_1d", """
with recursive v as (select c_nationkey k, c_acctbal x, count(*) n, row_number() over (partition by c_nationkey order by c_acctbal) i from customer group by 1, 2),
f as (select k, i, x, n, x anchor, 0 g from v where i = 1 union all select v.k, v.i, v.x, v.n, case when v.x - f.anchor <= 60 then f.anchor else v.x end, case when v.x - f.anchor <= 60 then f.g else f.g + 1 end from v join f on v.k = f.k and v.i = f.i + 1)
select k c_nationkey, g group_no, min(anchor) anchor, cast(sum(n) as bigint) n from f group by k, g""")
def anchor_1d(spark, sf_dir):
    """Anchor clusters: compared with the group's first."""
    return clustering.anchor_groups(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_acctbal", 60.0).select("c_nationkey", "group_no", "anchor", "n")


def _intervals(spark, sf_dir):
    start = F.unix_seconds(F.col("ts").cast("timestamp")).cast("double")
    return table(spark, sf_dir, "events").select("user_id", "event_type", start.alias("lo"), (start + F.col("value")).alias("hi"))


def _union_sql(keys: str, gap: str) -> str:
    return f"""
with e as (select user_id, event_type, floor(epoch(ts)) lo, floor(epoch(ts)) + value hi from events),
a as (select *, max(hi) over (partition by {keys} order by lo, hi rows between unbounded preceding and 1 preceding) reach from e),
b as (select *, sum(case when reach is null or lo > reach + {gap} then 1 else 0 end) over (partition by {keys} order by lo, hi) island from a)
select {keys}, min(lo) lo, round(max(hi), 3) hi, count(*) n from b group by {keys}, island"""


@_own("interval_union", _union_sql("user_id", "3600"))
def interval_union(spark, sf_dir):
    """Islands of intervals at most an hour apart."""
    return clustering.interval_union(_intervals(spark, sf_dir), ["user_id"], "lo", "hi", 3600).withColumn("hi", F.round("hi", 3))


@_own("interval_gap_by_class", _union_sql("user_id, event_type", "(case when event_type = 'view' then 7200 else 600 end)"))
def interval_gap_by_class(spark, sf_dir):
    """Islands whose gap depends on the class."""
    gap = F.when(F.col("event_type") == "view", 7200).otherwise(600)
    return clustering.interval_union(_intervals(spark, sf_dir), ["user_id", "event_type"], "lo", "hi", gap).withColumn("hi", F.round("hi", 3))


_same("dedupe_geometry", "select l_orderkey, l_partkey, cast(floor(l_extendedprice * 10 + 0.5) as bigint) key10, count(*) n, min(l_linenumber) first_line from lineitem group by l_orderkey, l_partkey, cast(floor(l_extendedprice * 10 + 0.5) as bigint)")


@_own("conn_components", """
with recursive e as (select distinct a.vec_id a, b.vec_id b from (select vec_id, label, row_number() over (partition by label order by vec_id) r from embeddings) a join (select vec_id, label, row_number() over (partition by label order by vec_id) r from embeddings) b on a.label = b.label and b.r = a.r + 1 where a.r % 7 <> 0),
u as (select a, b from e union all select b, a from e),
w as (select vec_id node, vec_id c from embeddings union select u.b, w.c from w join u on u.a = w.node)
select node, min(c) component from w group by node""")
def conn_components(spark, sf_dir):
    """Least node reachable by links."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label").withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")))
    b = e.select("label", F.col("vec_id").alias("b"), (F.col("r") - 1).alias("r"))
    edges = e.join(b, ["label", "r"]).filter("r % 7 <> 0").select(F.col("vec_id").alias("a"), "b")
    return clustering.components(e.select(F.col("vec_id").alias("node")), edges)


@_own("outline_components", """
with recursive o as (select c_nationkey k, c_custkey id, c_acctbal % 400 x0, c_custkey * 37 % 300 * 1.0 y0, c_acctbal % 400 + (20 + c_custkey % 30) x1, c_custkey * 37 % 300 * 1.0 + (case when c_custkey % 50 = 0 then 250 else 10 end) y1 from customer),
e as (select a.id a, b.id b from o a join o b on a.k = b.k and a.id <> b.id and a.x0 - 3 <= b.x1 and b.x0 - 3 <= a.x1 and a.y0 - 3 <= b.y1 and b.y0 - 3 <= a.y1),
w as (select id node, id c from o union select e.b, w.c from w join e on e.a = w.node),
m as (select node, min(c) component from w group by node)
select k c_nationkey, component, count(*) n, min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1 from o join m on node = id group by 1, 2 having count(*) >= 3""")
def outline_components(spark, sf_dir):
    """Outlines whose boxes lie near each other, three at least."""
    x, y, i = F.col("c_acctbal") % 400, F.col("c_custkey") * 37 % 300 * 1.0, F.col("c_custkey")
    boxes = table(spark, sf_dir, "customer").select("c_nationkey", i.alias("id"), x.alias("x0"), y.alias("y0"), (x + (i % 30 + 20)).alias("x1"), (y + F.when(i % 50 == 0, 250).otherwise(10)).alias("y1"))
    return clustering.outline_components(boxes, ["c_nationkey"])


@_own("modal_spacing", """
select user_id, bin, n from (select user_id, bin, count(*) n, row_number() over (partition by user_id order by count(*) desc, bin) r from (select user_id, cast(floor(d / 300 + 0.5) as bigint) * 300 bin from (select user_id, epoch(ts) - lag(epoch(ts)) over (partition by user_id order by ts, event_id) d from events) a where d > 20 and d < 600000) b group by user_id, bin) c where r = 1""")
def modal_spacing(spark, sf_dir):
    """Most frequent binned difference."""
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6  # seconds with their fraction, which decides between bins
    d = table(spark, sf_dir, "events").withColumn("s", s).withColumn("d", F.col("s") - F.lag("s").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    b = d.filter("d > 20 and d < 600000").select("user_id", (F.floor(F.col("d") / 300 + 0.5) * 300).alias("bin")).groupBy("user_id", "bin").agg(F.count(F.lit(1)).alias("n"))
    return b.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "bin"))).filter("r = 1").drop("r")


@_own("pitch_runs", """
with recursive v as (select o_custkey k, cast(date_diff('day', date '1992-01-01', o_orderdate) as double) x, row_number() over (partition by o_custkey order by o_orderdate) i from orders where o_orderdate is not null),
f as (select k, i, x, 0 r, cast(null as double) p from v where i = 1 union all select k, i, x, case when fits then r else r + 1 end, case when not fits then null when p is null and d <> 0 then d else p end
 from (select v.k, v.i, v.x, f.r, f.p, v.x - f.x d, v.x = f.x or f.p is null or abs(v.x - f.x - f.p) <= greatest(8.0, 0.18 * f.p) fits from v join f on v.k = f.k and v.i = f.i + 1) s)
select k o_custkey, cast(r as bigint) run_no, count(*) n, max(p) pitch, min(x) lo, max(x) hi from f group by k, r""")
def pitch_runs(spark, sf_dir):
    """Runs of constant pitch of order dates by customer."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).alias("x"))
    return clustering.pitch_runs(o, ["o_custkey"], "x")


@_own("base_pitch", "select g, min(d) base, list_max(list_filter([1,2,3,4,5,6], lambda k: list_bool_and(list_transform(list(d), lambda x: abs(x / k - round(x / k)) <= 0.12)))) divisor from (select p_size % 10 g, p_size d from part where p_size > 0) x group by g")
def base_pitch(spark, sf_dir):
    """Largest divisor of which all steps are whole multiples."""
    p = table(spark, sf_dir, "part").filter("p_size > 0").groupBy((F.col("p_size") % 10).alias("g")).agg(F.min("p_size").alias("base"), F.collect_set("p_size").alias("d"))
    ok = F.filter(F.array(*[F.lit(k) for k in range(1, 7)]), lambda k: F.forall("d", lambda x: F.abs(x / k - F.round(x / k)) <= 0.12))
    return p.select("g", "base", F.array_max(ok).alias("divisor"))


@_own("range_join_tol", "select a.p_brand, count(*) pairs, round(sum(abs(a.p_retailprice - b.p_retailprice)), 2) gap from part a join part b on a.p_brand = b.p_brand and a.p_partkey < b.p_partkey and b.p_retailprice - a.p_retailprice between -5 and 5 group by a.p_brand")
def range_join_tol(spark, sf_dir):
    """Tolerance join within equal keys, bucketed."""
    return joins.near_pair_sums(table(spark, sf_dir, "part"), ["p_brand"], "p_partkey", "p_retailprice", 5.0).withColumn("gap", F.round("gap", 2))


@_own("band_self_join", "select a.c_nationkey, count(*) pairs from customer a join customer b on a.c_nationkey = b.c_nationkey and b.c_acctbal - a.c_acctbal between 5 and 34 group by 1")
def band_self_join(spark, sf_dir):
    """Pairs of one key whose gap lies in a band."""
    c = table(spark, sf_dir, "customer")
    j = joins.band_join(c.select("c_nationkey", F.col("c_acctbal").alias("x")), c.select("c_nationkey", F.col("c_acctbal").alias("y")), ["c_nationkey"], "x", "y", 5, 34)
    return j.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("pairs"))


@_own("radius_count", "select a.p_partkey, count(distinct b.p_partkey) near from part a join part b on a.p_brand = b.p_brand and a.p_partkey <> b.p_partkey and (a.p_size - b.p_size) * (a.p_size - b.p_size) + (a.p_retailprice - b.p_retailprice) * (a.p_retailprice - b.p_retailprice) <= 100 group by 1")
def radius_count(spark, sf_dir):
    """Distinct neighbours within a radius, by grid cells."""
    p = table(spark, sf_dir, "part").withColumn("s", F.col("p_size").cast("double"))
    return joins.radius_counts(p, ["p_brand"], "p_partkey", ("s", "p_retailprice"), 10.0)


@_own("nearest_capped", "select c_nationkey, c_custkey, s_suppkey, distance from (select c.c_nationkey, c_custkey, s_suppkey, abs(s_acctbal - c_acctbal) distance, row_number() over (partition by c_custkey order by abs(s_acctbal - c_acctbal), s_suppkey) r from customer c left join supplier s on c.c_nationkey = s.s_nationkey and abs(s_acctbal - c_acctbal) <= 900) x where r = 1")
def nearest_capped(spark, sf_dir):
    """Nearest within a cap, non-consuming."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), "s_suppkey", "s_acctbal")
    return joins.nearest_capped(c, s, ["c_nationkey"], "c_custkey", "c_acctbal", "s_acctbal", "s_suppkey", 900.0)


@_own("overlap_pairs", """
with e as (select event_id, user_id, event_type, floor(epoch(ts)) lo, floor(epoch(ts)) + value * 60 hi from events)
select a.user_id, count(*) pairs, round(sum(least(a.hi, b.hi) - greatest(a.lo, b.lo)), 2) overlap from e a join e b on a.user_id = b.user_id and a.event_type = 'view' and b.event_type = 'click' and least(a.hi, b.hi) > greatest(a.lo, b.lo) group by 1""")
def overlap_pairs(spark, sf_dir):
    """Overlapping intervals of two classes."""
    s = F.unix_seconds(F.col("ts").cast("timestamp")).cast("double")
    e = table(spark, sf_dir, "events").select("user_id", "event_type", s.alias("lo"), (s + F.col("value") * 60).alias("hi"))
    b = e.filter("event_type = 'click'").select("user_id", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    j = joins.overlap_join(e.filter("event_type = 'view'"), b, ["user_id"], "lo", "hi", "lo2", "hi2", 3600.0)
    return j.groupBy("user_id").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sum("overlap"), 2).alias("overlap"))


@_own("edge_vote_pairing", """
with e as (select l_suppkey grp, row_number() over (partition by l_suppkey order by l_partkey, l_orderkey, l_linenumber, l_extendedprice) edge, l_quantity * 3.0 "off", l_partkey % 50 * 1.0 lo, l_partkey % 50 + l_tax * 100 hi from lineitem),
p as (select a.grp, a.edge e1, b.edge e2, cast(floor(b."off" - a."off" + 0.5) as bigint) dia, least(a.hi, b.hi) - greatest(a.lo, b.lo) ov from e a join e b on a.grp = b.grp and b."off" - a."off" between 5 and 34 where least(a.hi, b.hi) - greatest(a.lo, b.lo) > 0.2),
v as (select grp, edge, dia, sum(ov) w from (select grp, e1 edge, dia, ov from p union all select grp, e2, dia, ov from p) x group by 1, 2, 3),
b as (select grp, edge, dia from (select *, row_number() over (partition by grp, edge order by round(w, 6) desc, dia) r from v) y where r = 1)
select p.grp, dia_, count(*) pairs from (select p.grp, p.dia dia_ from p join b b1 on p.grp = b1.grp and p.e1 = b1.edge and p.dia = b1.dia join b b2 on p.grp = b2.grp and p.e2 = b2.edge and p.dia = b2.dia) p group by 1, 2""")
def edge_vote_pairing(spark, sf_dir):
    """Parallel edges of every supplier paired by a vote for the gap."""
    l = table(spark, sf_dir, "lineitem")
    n = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice"))
    e = l.select(F.col("l_suppkey").alias("grp"), n.alias("edge"), (F.col("l_quantity") * 3.0).alias("off"), (F.col("l_partkey") % 50).cast("double").alias("lo"), (F.col("l_partkey") % 50 + F.col("l_tax") * 100).alias("hi"))
    return joins.edge_votes(e).groupBy("grp", F.col("dia").alias("dia_")).agg(F.count(F.lit(1)).alias("pairs"))


def _points(spark, sf_dir):
    pts = F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.struct(F.element_at("embedding", (2 * i - 1).cast("int")).cast("double").alias("x"), F.element_at("embedding", (2 * i).cast("int")).cast("double").alias("y")))
    return table(spark, sf_dir, "embeddings").select("vec_id", pts.alias("p"))


@_own("polyline_len", "select vec_id, round(list_sum(list_transform(range(1, 32), lambda i: sqrt(pow(embedding[2*i-1]::double - embedding[2*i+1]::double, 2) + pow(embedding[2*i]::double - embedding[2*i+2]::double, 2)))), 6) len, round(abs(list_sum(list_transform(range(1, 33), lambda i: embedding[2*i-1]::double * embedding[case when i = 32 then 2 else 2*i+2 end]::double - embedding[case when i = 32 then 1 else 2*i+1 end]::double * embedding[2*i]::double))) / 2, 6) area from embeddings")
def polyline_len(spark, sf_dir):
    """Length and shoelace area of a polyline."""
    return _points(spark, sf_dir).select("vec_id", F.round(geo.length(F.col("p")), 6).alias("len"), F.round(geo.area(F.col("p")), 6).alias("area"))


@_own("polyline_shape")
def polyline_shape(spark, sf_dir):
    """Straight vertices dropped, points sampled, arcs drawn."""
    q = _points(spark, sf_dir)
    ring = geo.arc(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(30.0), (F.col("vec_id") % 300 + 40).cast("double"), 16)
    return q.select("vec_id", F.size(geo.simplify(F.col("p"))).alias("kept"), F.size(geo.sample(F.col("p"), 0.05)).alias("samples"), F.round(geo.length(ring), 6).alias("arc_len"))


@_own("distance_pctl", "select user_id % 10 g, round(percentile_cont(0.5) within group (order by value), 4) med, round(percentile_cont(0.9) within group (order by value), 4) p90, round(avg(case when value <= 50 then 1.0 else 0.0 end), 4) within_50 from events group by user_id % 10".replace("avg(case when value <= 50 then 1.0 else 0.0 end)", "cast(sum(case when value <= 50 then 1 else 0 end) as double) / count(*)"))
def distance_pctl(spark, sf_dir):
    """Median, ninth decile and share within a distance."""
    e = table(spark, sf_dir, "events").withColumn("g", F.col("user_id") % 10)
    return summaries.distance_stats(e, "g", "value", 50).withColumnRenamed("within", "within_50")


_same("histogram_tv", """
with h as (select event_type t, least(cast(floor(value / 25) as bigint), 19) b, count(*) n from events group by 1, 2), s as (select t, b, cast(n as double) / sum(n) over (partition by t) f from h)
select coalesce(x.t, y.t) t, round(sum(abs(coalesce(x.f, 0) - coalesce(y.f, 0))) * 50, 4) mismatch from (select s.t, s.b, s.f from s where s.t <> 'view') x full outer join (select k.t, s.b, s.f from s cross join (select distinct event_type t from events where event_type <> 'view') k where s.t = 'view') y on x.t = y.t and x.b = y.b group by 1""")


@_own("sum_by_projection", "select cast(floor(p_retailprice / 5) as bigint) * 5 key5, p_size, count(*) n from part group by cast(floor(p_retailprice / 5) as bigint) * 5, p_size")
def sum_by_projection(spark, sf_dir):
    """Counts by a coordinate cut to steps."""
    return summaries.projected_counts(table(spark, sf_dir, "part"), "p_retailprice", 5, "p_size").withColumnRenamed("key", "key5")
