"""Reports and their sinks, days and people, siblings and sheets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import tolerance as tol
from ..operators import reports
from ..runtime import shared_folder
from .tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _own(name: str, oracle: str):
    def add(fn):
        QUERIES[name], ORACLE_SQL[name] = fn, oracle
        return fn

    return add


_MARKS = "select l_suppkey panel, l_partkey mark, count(*) qty, min(l_extendedprice) len, 8 + 2 * (l_partkey % 5) dia from lineitem where l_returnflag = 'A' group by 1, 2, 5"
_SEEN = "select l_suppkey panel, l_partkey mark, case when l_returnflag = 'R' then 'tagged' when l_linestatus = 'O' then 'located' else 'note' end source, 1 n from lineitem where l_returnflag <> 'A'"


def _sql(spark, sf_dir, text, *names):
    for n in names or ("lineitem",):
        table(spark, sf_dir, n).createOrReplaceTempView(n)
    return spark.sql(text)


@_own("audit_marks", f"""with m as ({_MARKS}), e as ({_SEEN}), s as (select panel, mark, source, sum(n) n from e group by 1, 2, 3),
b as (select panel, mark, max(n) b, coalesce(max(n) filter (where source = 'tagged'), 0) t, coalesce(max(n) filter (where source = 'located'), 0) l from s group by 1, 2)
select m.panel, m.mark, qty, coalesce(t, 0) tagged, coalesce(l, 0) located, least(coalesce(b, 0), qty) covered, round(least(coalesce(b, 0), qty) * len, 4) covered_len,
 round(least(coalesce(b, 0), qty) * len / 1000 * case dia when 6 then 0.222 when 8 then 0.395 when 10 then 0.617 when 12 then 0.888 when 16 then 1.578 end, 6) covered_kg from m left join b on b.panel = m.panel and b.mark = m.mark""")
def audit_marks(spark, sf_dir):
    """Tagged, located and covered bars of every mark."""
    a = reports.audit_marks(_sql(spark, sf_dir, _MARKS), _sql(spark, sf_dir, _SEEN), ["panel", "mark"])
    return a.withColumn("covered_len", F.round("covered_len", 4)).withColumn("covered_kg", F.round("covered_kg", 6))


@_own("model_against_schedule", """with p as (select l_suppkey panel, l_partkey mark, count(*) n, avg(l_quantity * 100) ml, sum(l_tax) kg from lineitem where l_returnflag = 'R' group by 1, 2),
s as (select l_suppkey panel, l_partkey mark, count(*) qty, round(avg(l_quantity * 100)) cut, sum(l_tax) kg from lineitem where l_returnflag = 'A' group by 1, 2)
select coalesce(s.panel, p.panel) panel, coalesce(s.mark, p.mark) mark, coalesce(qty, 0) qty, coalesce(n, 0) placed, coalesce(qty = n, false) count_ok, coalesce(abs(ml - cut) <= 2, false) len_ok, coalesce(abs(p.kg - s.kg) <= 0.1, false) kg_ok from s full outer join p on s.panel = p.panel and s.mark = p.mark""")
def model_against_schedule(spark, sf_dir):
    """Placed bars against the schedule."""
    l = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "panel").withColumnRenamed("l_partkey", "mark")
    placed = l.filter("l_returnflag = 'R'").select("panel", "mark", (F.col("l_quantity") * 100).alias("len"), F.col("l_tax").alias("kg"))
    marks = l.filter("l_returnflag = 'A'").groupBy("panel", "mark").agg(F.count(F.lit(1)).alias("qty"), F.round(F.avg(F.col("l_quantity") * 100)).alias("cut"), F.sum("l_tax").alias("kg"))
    return reports.model_against_schedule(placed, marks, ["panel", "mark"])


@_own("element_summary", """with e as (select l_suppkey element, l_returnflag k, sum(cast(l_quantity as bigint)) v from lineitem group by 1, 2), m as (select element, string_agg(k || ':' || v, ',' order by k) evidence from e group by 1)
select l_suppkey element, cast(sum(cast(l_quantity as bigint)) as bigint) qty, round(sum(cast(l_quantity as bigint) * l_linenumber * 100.0), 4) length, round(sum(least(20, cast(l_quantity as bigint)) * l_linenumber * 100.0) / sum(cast(l_quantity as bigint) * l_linenumber * 100.0), 6) located_share, any_value(evidence) evidence from lineitem join m on element = l_suppkey group by 1""")
def element_summary(spark, sf_dir):
    """Quantities, located share and merged evidence of elements."""
    q = F.col("l_quantity").cast("long")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("element"), q.alias("qty"), (F.col("l_linenumber") * 100.0).alias("cut"), F.lit(20).cast("long").alias("located"), F.create_map(F.col("l_returnflag"), q).alias("evidence"))
    out = reports.element_summary(rows, "element")
    text = F.array_join(F.transform(F.map_entries("evidence"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return out.select("element", "qty", F.round("length", 4).alias("length"), F.round("located_share", 6).alias("located_share"), text.alias("evidence"))


_TAGS = "select l_orderkey panel, l_linenumber view, 'k' || l_suppkey % 2 mark, l_quantity / 50 x, l_discount y, l_orderkey * 1000 + row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) seq, 1 + l_partkey % 4 qty, case when l_partkey % 3 > 0 then 100 + l_partkey % 3 * 25 end spacing from lineitem"


@_own("annotation_index", f"""with t as ({_TAGS}), v as (select panel, view, count(*) * 10.0 + view area from t group by 1, 2), m as (select panel, arg_max(view, area) view from v group by 1),
u as (select t.*, row_number() over (partition by t.panel, mark, round(x, 1), round(y, 1) order by seq) i from t join m on m.panel = t.panel and m.view = t.view)
select panel, mark, cast(sum(qty) as bigint) qty, string_agg(qty::varchar, '+' order by seq) "groups", arg_max(spacing, seq) filter (where spacing is not null) spacing from u where i = 1 group by 1, 2""")
def annotation_index(spark, sf_dir):
    """Tags of the largest view of each panel."""
    t = _sql(spark, sf_dir, _TAGS)
    views = t.groupBy("panel", "view").agg((F.count(F.lit(1)) * 10.0 + F.col("view")).alias("area"))
    out = reports.annotation_index(t, views, "panel")
    return out.withColumn("groups", F.array_join(F.transform("groups", lambda q: q.cast("string")), "+"))


@_own("candidate_census", "select 8 + 2 * (l_partkey % 5) dia, count(*) filter (where l_returnflag = 'A') clustered, count(*) filter (where l_returnflag <> 'A') unclustered from lineitem group by 1")
def candidate_census(spark, sf_dir):
    """Candidates by diameter and pass."""
    l = table(spark, sf_dir, "lineitem").select((8 + 2 * (F.col("l_partkey") % 5)).alias("dia"), F.when(F.col("l_returnflag") == "A", "clustered").otherwise("unclustered").alias("pass"))
    return l.groupBy("dia").pivot("pass", ["clustered", "unclustered"]).agg(F.count(F.lit(1))).fillna(0)


_CLUSTERS = "select s_nationkey panel, s_suppkey cluster, s_suppkey % 10 * 100.0 x0, s_suppkey % 7 * 100.0 y0, s_suppkey % 10 * 100.0 + 100 * (1 + s_suppkey % 3) x1, s_suppkey % 7 * 100.0 + 300 y1 from supplier"
_HOLES = "select c_nationkey panel, c_custkey % 131 * 10.0 x, c_custkey % 97 * 10.0 y, c_custkey % 41 * 1.0 d from customer"


@_own("largest_cluster", f"""with c as ({_CLUSTERS}), h as ({_HOLES}), m as (select *, row_number() over (partition by panel order by (x1 - x0) * (y1 - y0) desc, cluster) i from c),
s as (select *, case when d < 6 then null when d <= 9 then 8 when d <= 11 then 10 when d <= 14 then 12 when d <= 18 then 16 when d <= 22 then 20 when d between 23 and 27 then 25 when d between 30 and 34 then 32 end dia from h)
select m.panel, cluster, count(dia) circles, coalesce(string_agg(distinct dia::varchar, ',' order by dia::varchar), '') dias from m left join s on s.panel = m.panel and x between x0 and x1 and y between y0 and y1 and dia is not null where i = 1 group by 1, 2""")
def largest_cluster(spark, sf_dir):
    """The largest cluster of a panel and the section circles in it."""
    out = reports.largest_cluster(_sql(spark, sf_dir, _CLUSTERS, "supplier"), _sql(spark, sf_dir, _HOLES, "customer"), "panel", tol.snap(F.col("d")))
    return out.withColumn("dias", F.array_join(F.array_sort(F.transform("dias", lambda d: d.cast("string"))), ","))


_DAYS = "select user_id, 'u' || user_id name, cast(ts as date) as day, case when event_type = 'view' then null else cast(sum(cast(floor(value) as bigint)) as bigint) end as seconds from events group by user_id, cast(ts as date), event_type"


@_own("days_by_duration", f"with d as (select name, day, max(seconds) as seconds from ({_DAYS}) z group by 1, 2) select name, day, seconds, row_number() over (partition by day order by coalesce(seconds, -1) desc, name) place from d")
def days_by_duration(spark, sf_dir):
    """People of a day, longest first, unknown last (O3)."""
    days = _sql(spark, sf_dir, _DAYS, "events").groupBy("name", "day").agg(F.max("seconds").alias("seconds"))
    return reports.ranked_days(days, "duration")


@_own("days_by_name", f"with d as (select name, day, max(seconds) as seconds from ({_DAYS}) z group by 1, 2) select name, day, seconds, row_number() over (partition by day order by name) place from d")
def days_by_name(spark, sf_dir):
    """People of a day by name."""
    days = _sql(spark, sf_dir, _DAYS, "events").groupBy("name", "day").agg(F.max("seconds").alias("seconds"))
    return reports.ranked_days(days, "name")


@_own("personal_report", f"with d as (select name, day, max(seconds) as seconds from ({_DAYS}) z group by 1, 2) select name, cast(sum(coalesce(seconds, 0)) as bigint) total, count(*) as days, max(day) last_day from d group by 1")
def personal_report(spark, sf_dir):
    """Totals and days of a person."""
    days = _sql(spark, sf_dir, _DAYS, "events").groupBy("name", "day").agg(F.max("seconds").alias("seconds"))
    return reports.personal_report(days, "name")


@_own("business_days", "select cast(ts + interval 330 minutes as date) as day, count(*) n from events group by 1")
def business_days(spark, sf_dir):
    """Events by the calendar day at +05:30."""
    return table(spark, sf_dir, "events").select(reports.business_day(F.col("ts").cast("timestamp")).alias("day")).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@_own("enrolled_people", "select user_id, count(*) photos, count(*) >= 3 and bool_and(coalesce(cast(floor(value) as bigint) % 9 <> 0, false)) ok from events group by 1")
def enrolled_people(spark, sf_dir):
    """People whose photos may be enrolled."""
    e = table(spark, sf_dir, "events").select("user_id", F.when(F.floor("value").cast("long") % 9 != 0, 1).otherwise(2).alias("faces"))
    return reports.enrolled(e, "user_id")


@_own("siblings_in_time", "with w as (select o_custkey, o_orderkey, epoch(o_orderdate) t, max(epoch(o_orderdate)) over (partition by o_custkey) hi, min(epoch(o_orderdate)) over (partition by o_custkey) lo from orders) select o_custkey, o_orderkey, greatest(hi - t, t - lo) < 7 * 86400 trusted from w")
def siblings_in_time(spark, sf_dir):
    """Siblings trusted within seven days."""
    o = table(spark, sf_dir, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp"))
    return reports.siblings_in_time(o, "o_custkey", "o_orderkey", "at").select("o_custkey", "o_orderkey", "trusted")


@_own("sheet_round_trip", "select c_custkey::varchar id, c_name name, nullif(case when c_custkey % 5 = 0 then '' else c_mktsegment end, '') segment from customer where c_custkey % 7 <> 0")
def sheet_round_trip(spark, sf_dir):
    """Customers written as a sheet and read again: rows without a first cell go, empty cells are null (S13). The sheet holds every customer."""
    path = f"{shared_folder(spark)}/sheet-{uuid.uuid4().hex}"
    c = table(spark, sf_dir, "customer")
    c.select(F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey").cast("string")).otherwise("").alias("id"), F.concat(F.lit(" "), "c_name", F.lit("  ")).alias("name"), F.when(F.col("c_custkey") % 5 == 0, " ").otherwise(F.col("c_mktsegment")).alias("segment")).write.option("header", True).csv(path)
    return reports.read_sheet(spark, path, ["id", "name", "segment"])


@_own("report_round_trip", "select l_suppkey::int panel, 'mark ' || lpad(l_partkey::varchar, 8, ' ') || ' x' || count(*) \"value\" from lineitem group by l_suppkey, l_partkey")
def report_round_trip(spark, sf_dir):
    """Text reports by panel, written and read again (K1)."""
    path = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("panel"), "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    lines = reports.report_lines(rows, "panel", F.concat(F.lit("mark "), F.lpad(F.col("l_partkey").cast("string"), 8, " "), F.lit(" x"), F.col("n").cast("string")))
    reports.write_reports(lines.repartition("panel"), "panel", path)
    return spark.read.text(path).select("panel", "value")


@_own("json_round_trip", "select l_suppkey::int panel, count(*) \"rows\" from (select l_suppkey, l_partkey from lineitem group by 1, 2) z group by 1")
def json_round_trip(spark, sf_dir):
    """JSON by panel with an index; the index is read again and held against the files (K2)."""
    path = f"{shared_folder(spark)}/json-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("panel"), "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    reports.write_json(rows.repartition("panel"), "panel", path)
    files = spark.read.schema("panel int, l_partkey long, n long").json(f"{path}/panels").groupBy("panel").agg(F.count(F.lit(1)).alias("rows"))
    index = spark.read.schema("panel int, rows long").json(f"{path}/index")
    return index.join(files, ["panel", "rows"])
