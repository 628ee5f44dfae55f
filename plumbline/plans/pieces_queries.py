"""Drawn pieces over the tables: segments, points and arcs are made from prices, quantities and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import clustering, pieces, rails
from .placement_queries import _segments
from .tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _own(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE_SQL[name] = oracle
        return fn

    return add


def _numbered(rows: DataFrame, order: str, line: str, by: list[str]) -> DataFrame:
    """An id for each row: order and line numbers repeat, so rows that share them are told apart by their place among them."""
    place = F.row_number().over(Window.partitionBy(order, line).orderBy(*by))
    return rows.withColumn("id", (F.col(order) * 10 + F.col(line)) * 100000 + place)


def _points(spark, sf_dir):
    """A point for each order, by customer."""
    return table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), (F.col("o_totalprice") % 500).alias("x"), (F.col("o_totalprice") / 500 % 300).alias("y"))


@_own("seed_clusters")
def seed_clusters(spark, sf_dir):
    """Greedy clusters of points by a box around the first (C4)."""
    return pieces.seed_clusters(_points(spark, sf_dir), ["o_custkey"])


@_own("farthest_pair", """
with p as (select o_custkey, o_orderkey id, o_totalprice % 500 x, o_totalprice / 500 % 300 y from orders)
select o_custkey, id_a, id_b, d from (select a.o_custkey, a.id id_a, b.id id_b, sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2) d, row_number() over (partition by a.o_custkey order by sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2) desc, a.id, b.id) r from p a join p b on a.o_custkey = b.o_custkey and a.id < b.id) x where r = 1""")
def farthest_pair(spark, sf_dir):
    """The two points of a component farthest apart."""
    return pieces.farthest_pair(_points(spark, sf_dir), ["o_custkey"])


@_own("concentric_arcs")
def concentric_arcs(spark, sf_dir):
    """Concentric arcs a diameter apart are a bend."""
    l = _numbered(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", ["l_suppkey", "l_quantity", "l_discount", "l_extendedprice", "l_tax"])
    arcs = l.select("l_suppkey", "id", (F.col("l_quantity") / 2).alias("cx"), (F.col("l_discount") * 10).alias("cy"), (F.col("l_extendedprice") % 90).alias("r"), (F.col("l_tax") * 1000).alias("a0"))
    return pieces.concentric_pairs(arcs, ["l_suppkey"])


def _pieces(spark, sf_dir):
    """All segments on a coarse grid; a view holds the segments of 512 order numbers, so views grow in number and not in size."""
    own = _numbered(_segments(spark, sf_dir), "k", "n", ["x0", "y0", "x1", "y1", "dia"])
    return own.select("dia", "id", F.floor(F.col("k") / 512).alias("view"), *[F.round(F.col(c) / 20).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])


@_own("chain_pieces")
def chain_pieces(spark, sf_dir):
    """Pieces whose ends meet become one bar."""
    bars = _pieces(spark, sf_dir).select("view", "id", "x0", "y0", "x1", "y1", F.when(F.col("dia") == "A", 8.0).when(F.col("dia") == "N", 9.5).otherwise(12.0).alias("dia"))
    return pieces.chain_pieces(bars, ["view"])


@_own("near_twins")
def near_twins(spark, sf_dir):
    """Bars drawn twice are booked once."""
    bars = _pieces(spark, sf_dir).select("dia", "view", "id", "x0", "y0", F.lit(0.0).alias("z0"), "x1", "y1", F.lit(0.0).alias("z1"))
    return pieces.near_twins(bars.withColumn("length", F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2)), ["view", "dia"])


@_own("rail_bars")
def rail_bars(spark, sf_dir):
    """Outlines joined to rails over gaps of up to 60, and rails a diameter apart paired to bars."""
    l = table(spark, sf_dir, "lineitem")
    outlines = l.select("l_suppkey", (F.col("l_quantity") * 4).alias("off"), (F.col("l_extendedprice") / 20).alias("lo"), (F.col("l_extendedprice") / 20 + 50 + F.col("l_discount") * 4000).alias("hi"))
    merged = clustering.interval_union(outlines, ["l_suppkey", "off"], "lo", "hi", 60.0)
    number = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("off", "lo"))
    return rails.rail_bars(merged.withColumn("rail", number), ["l_suppkey"])


@_own("bridge_runs")
def bridge_runs(spark, sf_dir):
    """Runs split by crossing bars join over gaps of whole pitches."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag", "l_orderkey").agg(F.array_sort(F.collect_list((F.col("l_quantity") * 40).cast("double"))).alias("places"))
    runs = l.select("l_suppkey", "l_returnflag", F.col("l_orderkey").alias("id"), F.array_min("places").alias("lo"), F.array_max("places").alias("hi"), ((F.col("l_orderkey") % 5) * 300.0 + 600).cast("double").alias("length"), F.when(F.size("places") > 1, F.element_at("places", 2) - F.element_at("places", 1)).alias("pitch"), "places")
    return pieces.bridge_runs(runs, ["l_suppkey", "l_returnflag"])


@_own("elevation_match")
def elevation_match(spark, sf_dir):
    """Marks take drawn runs by their length or a leg's."""
    l = table(spark, sf_dir, "lineitem")
    marks = l.filter("l_returnflag = 'A'").groupBy("l_suppkey", F.col("l_partkey").alias("mark")).agg(F.count(F.lit(1)).alias("qty"), (F.min("l_extendedprice") / 10).alias("length"), F.array(F.min("l_quantity") * 50).alias("legs"))
    own = _numbered(l.filter("l_returnflag = 'R'"), "l_orderkey", "l_linenumber", ["l_suppkey", "l_extendedprice", "l_quantity", "l_tax", "l_linestatus"])
    runs = own.select("l_suppkey", "id", (F.col("l_extendedprice") / 10).alias("length"), F.col("l_quantity").alias("z"), F.col("l_tax").alias("x"), F.when(F.col("l_linestatus") == "F", "h").otherwise("v").alias("family"))
    return pieces.elevation_match(marks, runs, ["l_suppkey"])


@_own("word_cells", """
with w as (select o_custkey, o_orderkey id, floor(o_totalprice % 200) x0, floor(o_totalprice % 200) + 8 x1, floor(o_totalprice / 200 % 40) y, o_orderpriority t from orders),
a as (select *, case when y - lag(y) over (partition by o_custkey order by y) > 3 then 1 else 0 end nw from w), b as (select *, sum(nw) over (partition by o_custkey order by y) g from a),
m as (select o_custkey, g, avg(y) mean from b group by 1, 2), n as (select b.o_custkey, b.id, min_by(m.g, (abs(b.y - m.mean), m.g)) line_no from b join m on b.o_custkey = m.o_custkey group by 1, 2),
p as (select w.*, line_no from w join n using (o_custkey, id)), q as (select *, case when x0 - max(x1) over (partition by o_custkey, line_no order by x0, id rows between unbounded preceding and 1 preceding) > 6 then 1 else 0 end nc from p),
r as (select *, sum(nc) over (partition by o_custkey, line_no order by x0, id rows unbounded preceding) cell_no from q)
select o_custkey, line_no, cell_no, list_reduce(list((x0 + x1) / 2 order by x0, id), lambda acc, v: (acc + v) / 2) x, max(x1) as "end", string_agg(t, ' ' order by x0, id) t from r group by 1, 2, 3""")
def word_cells(spark, sf_dir):
    """Words to lines and cells."""
    o = table(spark, sf_dir, "orders")
    x0 = F.floor(F.col("o_totalprice") % 200).cast("double")
    words = o.select("o_custkey", F.col("o_orderkey").alias("id"), x0.alias("x0"), (x0 + 8).alias("x1"), F.floor(F.col("o_totalprice") / 200 % 40).cast("double").alias("y"), F.col("o_orderpriority").alias("t"))
    return pieces.word_cells(words, ["o_custkey"])


@_own("viewport_titles", """
with v as (select s_nationkey, s_suppkey as view, s_acctbal / 10 cx, s_acctbal / 20 cy, 200.0::double w, (s_suppkey % 3) * 100.0::double h, s_acctbal vx, s_acctbal / 2 vy, 1000.0::double vh from supplier),
t as (select c_nationkey s_nationkey, c_acctbal / 10 tx, c_acctbal / 20 ty, c_name s from customer),
j as (select v.s_nationkey, view, s, row_number() over (partition by v.s_nationkey, view order by sqrt((tx - cx) ^ 2 + (ty - cy + h / 2) ^ 2), tx, ty, s) r from v join t on v.s_nationkey = t.s_nationkey where abs(tx - cx) <= w * 1.3 / 2 and ty between cy - h * 1.3 / 2 - h * 0.25 and cy + h * 1.3 / 2)
select v.s_nationkey, v.view, case when h <> 0 then vh / h else 0 end scale, case when h <> 0 then vx - vh * w / h / 2 end wx0, case when h <> 0 then vy - vh / 2 end wy0, case when h <> 0 then vx + vh * w / h / 2 end wx1, case when h <> 0 then vy + vh / 2 end wy1, coalesce(s, '') title from v left join j on v.view = j.view and v.s_nationkey = j.s_nationkey and r = 1""")
def viewport_titles(spark, sf_dir):
    """Model windows and nearest titles of viewports."""
    b = F.col("s_acctbal")
    views = table(spark, sf_dir, "supplier").select("s_nationkey", F.col("s_suppkey").alias("view"), (b / 10).alias("cx"), (b / 20).alias("cy"), F.lit(200.0).alias("w"), (F.col("s_suppkey") % 3 * 100.0).alias("h"), b.alias("vx"), (b / 2).alias("vy"), F.lit(1000.0).alias("vh"))
    texts = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("s_nationkey"), (F.col("c_acctbal") / 10).alias("tx"), (F.col("c_acctbal") / 20).alias("ty"), F.col("c_name").alias("s"))
    return pieces.viewport_titles(views, texts, ["s_nationkey"])


@_own("cached_vectors", """
select cast(e.vec_id as varchar) path, cast(e.label as varchar) employee_id, coalesce(n_name, cast(e.label as varchar)) as name, cast(e.vec_id % 7 as bigint) mtime, e.embedding as vector, not (e.vec_id % 2 = 0 and e.vec_id % 7 < 4) fresh
from embeddings e left join nation on n_nationkey = e.label and n_nationkey < 3 where e.vec_id % 2 = 0 and e.vec_id % 7 < 4 or e.vec_id % 5 <> 0""")
def cached_vectors(spark, sf_dir):
    """Vectors from the cache while the file is the same, else from the image."""
    e = table(spark, sf_dir, "embeddings")
    path, mtime = F.col("vec_id").cast("string").alias("path"), (F.col("vec_id") % 7).alias("mtime")
    images = e.select(path, F.col("label").cast("string").alias("employee_id"), mtime, F.when(F.col("vec_id") % 5 != 0, F.col("embedding")).alias("found"))
    cache = e.filter("vec_id % 2 = 0").select(path, F.when(F.col("vec_id") % 7 < 4, F.col("vec_id") % 7).otherwise(-1).alias("mtime"), F.col("embedding").alias("vector"))
    people = table(spark, sf_dir, "nation").filter("n_nationkey < 3").select(F.col("n_nationkey").cast("string").alias("employee_id"), F.col("n_name").alias("name"))
    return pieces.cached_vectors(images, cache, people)
