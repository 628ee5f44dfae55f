"""Schedules: verification, rollups, census, ranking, sums along an order (aggregations, windows, sets)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tolerance as tol
from ..operators import matching, summaries
from .tables import sql_query, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _same(name: str, text: str) -> None:
    """SQL that Spark and DuckDB read alike."""
    QUERIES[name], ORACLE_SQL[name] = sql_query(text), text


def _own(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE_SQL[name] = oracle
        return fn

    return add


@_own("tally_reconcile", """
with rows_ as (select l_orderkey k, count(*) n_rows, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) row_total from lineitem group by 1)
select coalesce(k, o_orderkey) order_key, coalesce(n_rows, 0) n_rows, row_total, o_totalprice printed,
 round(row_total - o_totalprice, 2) delta,
 case when k is null then 'MISSING_ROWS' when o_orderkey is null then 'MISSING_SUMMARY'
  when abs(row_total - o_totalprice) <= greatest(0.09, 0.01 * greatest(abs(row_total), abs(o_totalprice))) then 'OK' else 'MISMATCH' end status
from rows_ full outer join orders on k = o_orderkey""")
def tally_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows summed by key against printed totals, either side may miss."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("row_total"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("printed"))
    j = rows.join(o, F.col("k") == F.col("o_orderkey"), "full_outer")
    status = F.when(F.col("k").isNull(), "MISSING_ROWS").when(F.col("o_orderkey").isNull(), "MISSING_SUMMARY").when(tol.close(F.col("row_total"), F.col("printed"), 0.09, 0.01), "OK").otherwise("MISMATCH")
    return j.select(F.coalesce("k", "o_orderkey").alias("order_key"), F.coalesce("n", F.lit(0)).alias("n_rows"), "row_total", "printed", F.round(F.col("row_total") - F.col("printed"), 2).alias("delta"), status.alias("status"))


_SNAP = "case when p_size < 6 then null when p_size <= 9 then 8 when p_size <= 11 then 10 when p_size <= 14 then 12 when p_size <= 18 and p_size >= 14 then 16 when p_size between 18 and 22 then 20 when p_size between 23 and 27 then 25 when p_size between 30 and 34 then 32 end"


@_own("snap_std", f"select p_partkey, p_size, {_SNAP} dia, round(p_size * p_size / 162.0, 6) kg_per_m, round(pi() / 4 * p_size * p_size * 7850e-9, 9) kg_per_mm from part")
def snap_std(spark, sf_dir):
    """Nearest standard size within 2, and both unit weights."""
    p = table(spark, sf_dir, "part")
    x = F.col("p_size").cast("double")
    return p.select("p_partkey", "p_size", tol.snap(x).alias("dia"), F.round(tol.unit_weight(x), 6).alias("kg_per_m"), F.round(tol.mass_per_mm(x), 9).alias("kg_per_mm"))


_FLAGS = ", ".join(f"abs(l_extendedprice - p_retailprice * l_quantity) <= greatest({a}, {r} * p_retailprice * l_quantity) {k}_ok" for k, (a, r) in tol.FAMILIES.items())


@_own("tol_match_flags", f"select {', '.join(f'count(*) filter (where {k}_ok) {k}_n' for k in tol.FAMILIES)}, count(*) n, l_returnflag from (select l_returnflag, {_FLAGS} from lineitem join part on l_partkey = p_partkey) group by l_returnflag")
def tol_match_flags(spark, sf_dir):
    """Each tolerance family on printed against computed amounts."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    want = F.col("p_retailprice") * F.col("l_quantity")
    # the share of the price comes first, as in the SQL: another order of the factors decides otherwise at the very edge
    near = lambda a, r: F.abs(F.col("l_extendedprice") - want) <= F.greatest(F.lit(a), F.lit(r) * F.col("p_retailprice") * F.col("l_quantity"))
    return j.groupBy("l_returnflag").agg(*[F.count_if(near(*v)).alias(f"{k}_n") for k, v in tol.FAMILIES.items()], F.count(F.lit(1)).alias("n"))


_same("verify_row_arith", """
select l_linestatus, count(*) n, sum(case when abs(round(l_extendedprice / l_quantity, 2) * l_quantity - l_extendedprice) <= 2 then 1 else 0 end) len_ok,
 sum(case when abs(l_extendedprice * (1 - l_discount) - l_extendedprice) <= greatest(0.03, 0.01 * l_extendedprice) then 1 else 0 end) weight_ok,
 sum(case when l_quantity is null or l_extendedprice is null then 1 else 0 end) unreadable
from lineitem where l_quantity > 0 group by l_linestatus""")

_same("verify_group", """
with r as (select l_suppkey k, count(*) n, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) t from lineitem group by l_suppkey),
s as (select s_suppkey k, s_acctbal * 1000 printed from supplier)
select coalesce(r.k, s.k) k, n, t, printed, case when r.k is null or s.k is null then 'ONE_SIDED' when abs(t - printed) <= greatest(0.09, 0.01 * greatest(abs(t), abs(printed))) then 'OK' else 'MISMATCH' end status
from r full outer join s on r.k = s.k""")

_same("verify_grand", """
select cast(sum(d) as double) rows_total, cast(max(g) as double) grand, case when abs(cast(sum(d) as double) - cast(max(g) as double)) <= greatest(0.15, 0.01 * abs(cast(max(g) as double))) then 'OK' else 'MISMATCH' end status
from (select cast(l_extendedprice as decimal(18,2)) d, null g from lineitem union all select null d, cast(o_totalprice as decimal(18,2)) g from orders) u""".replace("cast(max(g) as double)", "cast(sum(g) as double)"))


@_own("master_rollup", f"""
with b as (select l_suppkey panel, {_SNAP} dia, l_quantity q, cast(l_extendedprice as decimal(18,2)) len from lineitem join part on l_partkey = p_partkey)
select panel, dia, count(*) n_rows, sum(q) qty, cast(sum(len) as double) length, grouping(panel) g_panel, grouping(dia) g_dia from b group by rollup (panel, dia)""")
def master_rollup(spark, sf_dir):
    """Rows, quantity and length by panel and diameter, with sums (A4, A10)."""
    p = table(spark, sf_dir, "part").select("p_partkey", tol.snap(F.col("p_size").cast("double")).alias("dia"))
    rows = table(spark, sf_dir, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    return summaries.diameter_rollup(rows, "l_suppkey", "dia", "l_quantity", "l_extendedprice")


@_own("census_by_kind", """
select event_type, user_id % 10 layer, count(*) n, count(distinct user_id) instances, round(sum(cast(value as decimal(18,4))), 2) drawn from events group by event_type, user_id % 10""".replace("round(sum(cast(value as decimal(18,4))), 2)", "cast(sum(cast(value as decimal(18,4))) as double)"))
def census_by_kind(spark, sf_dir):
    """Entities, instances and drawn length by kind and layer."""
    e = table(spark, sf_dir, "events").withColumn("layer", F.col("user_id") % 10)
    return summaries.kind_census(e, ["event_type", "layer"], "user_id", "value")


_same("conf_split_flag", """
with c as (select l_suppkey panel, l_shipmode_ dia, cast(sum(case when l_discount >= 0.05 then cast(l_extendedprice as decimal(18,2)) end) as double) high, cast(sum(case when l_discount < 0.05 then cast(l_extendedprice as decimal(18,2)) end) as double) low from (select *, l_returnflag l_shipmode_ from lineitem) x group by l_suppkey, l_shipmode_)
select panel, dia, coalesce(high, 0) high, coalesce(low, 0) low, coalesce(low, 0) >= 0.5 * (coalesce(high, 0) + coalesce(low, 0)) flagged from c""")

_same("pivot_located", """
select l_suppkey panel, sum(case when l_returnflag = 'A' then 1 else 0 end) a_n, sum(case when l_returnflag = 'N' then 1 else 0 end) n_n, sum(case when l_returnflag = 'R' then 1 else 0 end) r_n,
 sum(case when l_linestatus = 'F' then 1 else 0 end) located, count(*) qty, round(100.0 * sum(case when l_linestatus = 'F' then 1 else 0 end) / count(*), 2) pct from lineitem group by l_suppkey""".replace("100.0 * sum(case when l_linestatus = 'F' then 1 else 0 end) / count(*)", "cast(100 * sum(case when l_linestatus = 'F' then 1 else 0 end) as double) / count(*)"))


@_own("source_ranked_takeoff", """
with m as (select o_custkey k, 1 src, cast(sum(cast(o_totalprice as decimal(18,2))) as double) kg from orders where o_orderstatus = 'F' group by 1),
s as (select o_custkey k, 2 src, cast(max(cast(o_totalprice as decimal(18,2))) as double) kg from orders where o_orderstatus <> 'F' group by 1),
r as (select c.c_custkey k, 3 src, c.c_acctbal kg from customer c where c.c_custkey % 3 = 0),
a as (select *, row_number() over (partition by k order by src) rn from (select * from m union all select * from s union all select * from r) u)
select c_custkey element, case src when 1 then 'marks' when 2 then 'summary' when 3 then 'reference' else 'NONE' end source, coalesce(kg, 0) weight from customer left join a on c_custkey = k and rn = 1""")
def source_ranked_takeoff(spark, sf_dir):
    """Best source for each element: marks, then summary, then reference."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    kg = F.col("o_totalprice").cast("decimal(18,2)")
    m = o.filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.sum(kg).cast("double").alias("marks"))
    s = o.filter("o_orderstatus <> 'F'").groupBy(F.col("o_custkey").alias("k2")).agg(F.max(kg).cast("double").alias("summary"))
    j = c.join(m, F.col("c_custkey") == F.col("k"), "left").join(s, F.col("c_custkey") == F.col("k2"), "left").withColumn("ref", F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")))
    source = F.when(F.col("marks").isNotNull(), "marks").when(F.col("summary").isNotNull(), "summary").when(F.col("ref").isNotNull(), "reference").otherwise("NONE")
    return j.select(F.col("c_custkey").alias("element"), source.alias("source"), F.coalesce("marks", "summary", "ref", F.lit(0.0)).alias("weight"))


@_own("seq_slice", "select l_orderkey, l_linenumber, l_partkey, l_quantity qty, sum(l_quantity) over w last_place, sum(l_quantity) over w - l_quantity + 1 first_place from (select distinct l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem) d window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity rows between unbounded preceding and current row)")
def seq_slice(spark, sf_dir):
    """Marks in order take consecutive places of a pool."""
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("qty")).distinct()
    out = matching.sequential_slices(d, ["l_orderkey"], ["l_linenumber", "l_partkey", "qty"], "qty")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "qty", F.col("last").alias("last_place"), F.col("first").alias("first_place"))


@_own("budget_trim", """
with d as (select distinct o_custkey, o_orderkey, cast(o_totalprice as decimal(18,2)) kg from orders), b as (select c_custkey, cast(c_acctbal * 20 as decimal(18,2)) budget from customer)
select o_custkey, o_orderkey, cast(kg as double) kg from (select *, sum(kg) over (partition by o_custkey) - coalesce(sum(kg) over (partition by o_custkey order by kg desc, o_orderkey rows between unbounded preceding and 1 preceding), 0) remaining from d join b on o_custkey = c_custkey) x where remaining <= budget""")
def budget_trim(spark, sf_dir):
    """Drop the heaviest until the total is within the budget."""
    d = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("kg")).distinct()
    j = d.join(table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") * 20).cast("decimal(18,2)").alias("budget")), F.col("o_custkey") == F.col("c_custkey"))
    return matching.budget_trim(j, ["o_custkey"], [F.desc("kg"), "o_orderkey"], "kg", "budget").select("o_custkey", "o_orderkey", F.col("kg").cast("double").alias("kg"))


_same("remainder_split", "select l_orderkey, l_linenumber, l_partkey, l_quantity, k, floor(l_quantity / 4) + case when k < l_quantity % 4 then 1 else 0 end share from (select distinct l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem) d cross join (select 0 k union all select 1 union all select 2 union all select 3) g".replace("floor(l_quantity / 4) + case when k < l_quantity % 4 then 1 else 0 end", "cast(floor(l_quantity / 4) as bigint) + case when k < l_quantity % 4 then 1 else 0 end"))

_same("mode_callout", """
select o_orderstatus, o_orderpriority callout, n from (select o_orderstatus, o_orderpriority, count(*) n, row_number() over (partition by o_orderstatus order by count(*) desc, o_orderpriority) r from orders group by o_orderstatus, o_orderpriority) x where r = 1""")

_same("count_gated_update", """
with g as (select l_orderkey k, count(*) n, max(l_quantity) q from lineitem group by l_orderkey)
select l_orderkey, l_linenumber, l_partkey, count(*) n_rows, max(case when n = floor(q / 10) then o_totalprice else l_extendedprice end) len from lineitem join g on l_orderkey = k join orders on o_orderkey = l_orderkey group by l_orderkey, l_linenumber, l_partkey""")


@_own("sanity_findings", """
select 'z_bounds' check_name, l_orderkey id, l_extendedprice val from lineitem where l_extendedprice < 1000 or l_extendedprice > 100000
union all select 'density', o_orderkey, o_totalprice from orders where o_totalprice < 2000 or o_totalprice > 400000
union all select 'degenerate', l_orderkey, l_quantity from lineitem where l_quantity <= 0""")
def sanity_findings(spark, sf_dir):
    """Rows out of bounds, by check."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    out = lambda c, low, high: (F.col(c) < low) | (F.col(c) > high)
    return summaries.findings(("z_bounds", l, "l_orderkey", "l_extendedprice", out("l_extendedprice", 1000, 100000)), ("density", o, "o_orderkey", "o_totalprice", out("o_totalprice", 2000, 400000)), ("degenerate", l, "l_orderkey", "l_quantity", F.col("l_quantity") <= 0))


@_own("source_agreement", """
with f as (select l_partkey mark, l_suppkey src, max(l_quantity) v from lineitem group by l_partkey, l_suppkey), b as (select mark, src, v, first_value(v) over (partition by mark order by src) v0 from f)
select mark, count(*) sources, case when count(*) = 1 then 'SINGLE_SOURCE' when sum(case when abs(v - v0) > 1 then 1 else 0 end) = 0 then 'AGREE' else 'DISAGREE' end status from b group by mark""")
def source_agreement(spark, sf_dir):
    """Do the sources of a mark agree (A26)?"""
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("mark"), F.col("l_suppkey").alias("src")).agg(F.max("l_quantity").alias("v"))
    return summaries.source_agreement(f, "mark", "src", "v")


_same("balance_check", """
select l_shipdate_ y, count(*) read_n, sum(case when l_returnflag <> 'N' then 1 else 0 end) written_n, sum(case when l_returnflag = 'N' then 1 else 0 end) skipped_n,
 count(*) = sum(case when l_returnflag <> 'N' then 1 else 0 end) + sum(case when l_returnflag = 'N' then 1 else 0 end) balanced from (select year(l_shipdate) l_shipdate_, l_returnflag from lineitem) x group by l_shipdate_""")


@_own("combined_sheets", """
select base, cast(sum(t) as double) total, count(*) sheets, case when cast(sum(t) as double) >= 0.95 * 1000000 then 'OK' else 'SHORTFALL' end verdict from (select o_custkey % 100 base, cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(18,2)) t from orders group by o_custkey) x group by base""")
def combined_sheets(spark, sf_dir):
    """Sheets of one base against its demand."""
    s = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(summaries.money(F.col("o_totalprice"))).alias("t")).withColumn("base", F.col("o_custkey") % 100)
    return summaries.combined_sheets(s, "base", "t", F.lit(1000000))


_same("distinct_view_max", """
select label, max(per_view) most from (select l_partkey label, l_suppkey view_id, sum(q) per_view from (select distinct l_partkey, l_suppkey, l_linenumber, l_quantity q from lineitem) d group by l_partkey, l_suppkey) v group by label""")


@_own("element_candidates", """
select grp, best, n_views, extras from (select p_brand grp, p_partkey best, p_size n_views, row_number() over (partition by p_brand order by case when p_type like '%STEEL%' then 0 else 1 end, p_size desc, p_partkey) r, count(*) over (partition by p_brand) - 1 extras from part) x where r = 1""")
def element_candidates(spark, sf_dir):
    """The best candidate of each group."""
    return summaries.best_candidate(table(spark, sf_dir, "part"), "p_brand", "p_partkey", F.col("p_type").like("%STEEL%"), "p_size")


@_own("known_only", "select distinct l_partkey from lineitem where exists (select 1 from part where p_partkey = l_partkey and p_size in (8, 10, 12, 16, 20, 25, 32))")
def known_only(spark, sf_dir):
    """Keys of standard sizes."""
    return summaries.known_sizes(table(spark, sf_dir, "lineitem"), "l_partkey", table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", [8, 10, 12, 16, 20, 25, 32])


@_own("phantom_drop", "select o_orderkey, o_custkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def phantom_drop(spark, sf_dir):
    """Orders that no line names."""
    return summaries.without_evidence(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", table(spark, sf_dir, "lineitem"), "l_orderkey")


@_own("set_ops", "select l_suppkey k, 'both' side from lineitem where l_returnflag = 'A' intersect select l_suppkey, 'both' from lineitem where l_returnflag = 'R' union all (select c_nationkey, 'only_customer' from customer except select s_nationkey, 'only_customer' from supplier)")
def set_ops(spark, sf_dir):
    """Keys on both sides, and keys on one side only."""
    l = table(spark, sf_dir, "lineitem")
    flag = lambda f: l.filter(F.col("l_returnflag") == f).select("l_suppkey")
    nations = (table(spark, sf_dir, t).select(F.col(f"{t[0]}_nationkey").cast("bigint")) for t in ("customer", "supplier"))
    return summaries.set_report(flag("A"), flag("R"), *nations, "both", "only_customer")


_same("fragment_drop", """
with f as (select l_suppkey k, max(l_quantity) floor_q from lineitem group by l_suppkey)
select l_suppkey, count(*) kept from lineitem join f on l_suppkey = k where l_quantity >= 0.5 * floor_q group by l_suppkey""")

_same("nearest_dates_ranking", """
select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by length(o_orderpriority) desc, abs(datediff(o_orderdate, date '1996-01-01')), o_orderkey) r from orders) x where r = 1""")
ORACLE_SQL["nearest_dates_ranking"] = ORACLE_SQL["nearest_dates_ranking"].replace("datediff(o_orderdate, date '1996-01-01')", "datediff('day', date '1996-01-01', cast(o_orderdate as date))")
