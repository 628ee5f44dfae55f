"""Attendance from gate events: IN is a view, OUT is a purchase; the clock stands at 2024-01-30 18:00."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attendance as att
from ..operators import clustering, ranking
from .tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
NOW = "2024-01-30 18:00:00"

_DAILY = """with g as (select user_id, cast(ts as date) d, event_type, ts, event_id from events where event_type in ('view', 'purchase')),
a as (select user_id, d, arg_min(ts, event_id) filter (where event_type = 'view') in_ts, arg_max(ts, event_id) filter (where event_type = 'purchase') out_ts from g group by 1, 2),
b as (select *, case when in_ts is not null and out_ts is not null then 'present' when in_ts is not null then case when d = date '2024-01-30' then 'currently-in' else 'missing-checkout' end else 'missing-checkin' end status from a),
s as (select *, case status when 'present' then cast(epoch(date_trunc('second', out_ts)) as bigint) - cast(epoch(date_trunc('second', in_ts)) as bigint) when 'currently-in' then cast(epoch(timestamp '2024-01-30 18:00:00') as bigint) - cast(epoch(date_trunc('second', in_ts)) as bigint) end secs from b) """


def _own(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE_SQL[name] = oracle
        return fn

    return add


def _gate(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type in ('view', 'purchase')")
    return e.select("user_id", "ts", F.when(F.col("event_type") == "view", "in").otherwise("out").alias("mode"), "event_id")


def _rows(spark, sf_dir):
    d = att.daily(_gate(spark, sf_dir), "user_id", "ts", "mode", "event_id")
    today = F.lit(NOW).cast("timestamp_ntz").cast("date")
    d = d.withColumn("status", att.status(F.col("day"), F.col("in_ts"), F.col("out_ts"), today))
    return d.withColumn("secs", att.seconds(F.col("in_ts"), F.col("out_ts"), F.col("status"), F.lit(NOW).cast("timestamp_ntz")))


@_own("attendance_daily", _DAILY + "select user_id, d \"day\", in_ts, out_ts from s")
def attendance_daily(spark, sf_dir):
    """First IN and last OUT by arrival."""
    return _rows(spark, sf_dir).select("user_id", "day", "in_ts", "out_ts")


@_own("attendance_status", _DAILY + "select user_id, d \"day\", status, secs, case when secs is null then '-' when greatest(secs, 0) >= 3600 then (greatest(secs, 0) // 3600) || 'h ' || (greatest(secs, 0) % 3600 // 60) || 'm' else (greatest(secs, 0) // 60) || 'm' end shown, coalesce(strftime(in_ts, '%I:%M %p'), '-') in_shown from s")
def attendance_status(spark, sf_dir):
    """Status, duration and their texts."""
    r = _rows(spark, sf_dir)
    return r.select("user_id", "day", "status", "secs", F.when(F.col("secs").isNull(), "-").otherwise(att.format_duration(F.col("secs"))).alias("shown"), F.coalesce(F.date_format("in_ts", "hh:mm a"), F.lit("-")).alias("in_shown"))


@_own("attendance_totals", _DAILY + "select user_id, cast(coalesce(sum(secs), 0) as bigint) total, count(*) filter (where status in ('present', 'currently-in')) as \"days\", count(*) filter (where status = 'missing-checkin') no_in, count(*) filter (where status = 'missing-checkout') no_out from s group by 1")
def attendance_totals(spark, sf_dir):
    """Totals by person."""
    s = F.col("status")
    return _rows(spark, sf_dir).groupBy("user_id").agg(F.coalesce(F.sum("secs"), F.lit(0)).alias("total"), F.count_if(s.isin("present", "currently-in")).alias("days"), F.count_if(s == "missing-checkin").alias("no_in"), F.count_if(s == "missing-checkout").alias("no_out"))


@_own("currently_in", _DAILY + "select user_id, secs, row_number() over (order by secs desc, user_id) place from s where status = 'currently-in'")
def currently_in(spark, sf_dir):
    """Who is in, longest first (O2)."""
    return ranking.global_rank(_rows(spark, sf_dir).filter("status = 'currently-in'").select("user_id", "secs"), [F.desc("secs"), F.col("user_id")], "place")


@_own("preset_ranges", _DAILY + """, p as (select 'this-week' preset, date '2024-01-29' a, date '2024-01-30' b union all select 'last-week', date '2024-01-22', date '2024-01-28' union all select 'this-month', date '2024-01-01', date '2024-01-30' union all select 'last-30', date '2024-01-01', date '2024-01-30')
select preset, a first_day, b last_day, count(*) n, cast(coalesce(sum(secs), 0) as bigint) total from p join s on d between a and b group by 1, 2, 3""")
def preset_ranges(spark, sf_dir):
    """Calendar presets and the inclusive range filter."""
    today = F.lit(NOW).cast("timestamp_ntz").cast("date")
    names = ["this-week", "last-week", "this-month", "last-30"]
    p = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(n).alias("preset"), att.preset(n, today)[0].alias("first_day"), att.preset(n, today)[1].alias("last_day")) for n in names])).alias("x")).select("x.*")
    r = _rows(spark, sf_dir)
    return r.join(F.broadcast(p), F.col("day").between(F.col("first_day"), F.col("last_day"))).groupBy("preset", "first_day", "last_day").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("secs"), F.lit(0)).alias("total"))


@_own("distinct_people", "select c_nationkey, arg_min(c_name, c_custkey) first_name, count(*) n from customer group by 1")
def distinct_people(spark, sf_dir):
    """First name seen of each."""
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.min_by("c_name", "c_custkey").alias("first_name"), F.count(F.lit(1)).alias("n"))


@_own("stat_cards", _DAILY + "select count(*) filter (where status = 'currently-in') inside, count(distinct user_id) people, cast(coalesce(sum(secs) filter (where d between date '2024-01-29' and date '2024-01-30'), 0) as bigint) week_secs from s")
def stat_cards(spark, sf_dir):
    """Cards of the dashboard."""
    week = F.col("day").between(F.lit("2024-01-29").cast("date"), F.lit("2024-01-30").cast("date"))
    return _rows(spark, sf_dir).agg(F.count_if(F.col("status") == "currently-in").alias("inside"), F.countDistinct("user_id").alias("people"), F.coalesce(F.sum(F.when(week, F.col("secs"))), F.lit(0)).alias("week_secs"))


@_own("debounce_events", """
with recursive e as (select user_id, cast(epoch(date_trunc('second', ts)) as double) t, row_number() over (partition by user_id order by date_trunc('second', ts)) i from events),
f as (select user_id, i, t, t last_t, true emitted from e where i = 1 union all select e.user_id, e.i, e.t, case when e.t - f.last_t > 7200 then e.t else f.last_t end, e.t - f.last_t > 7200 from e join f on e.user_id = f.user_id and e.i = f.i + 1)
select user_id, t from f where emitted""")
def debounce_events(spark, sf_dir):
    """Events more than two hours after the last emitted one."""
    e = table(spark, sf_dir, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("t"))
    return clustering.debounced(e, ["user_id"], "t", 7200.0)


@_own("gate_debounce", """
with recursive e as (select event_type, user_id, cast(floor(epoch(ts)) as double) t, row_number() over (partition by event_type, user_id order by floor(epoch(ts))) i from events),
f as (select event_type, user_id, i, t, t last_t, true emitted from e where i = 1 union all select e.event_type, e.user_id, e.i, e.t, case when e.t - f.last_t > 7200 then e.t else f.last_t end, e.t - f.last_t > 7200 from e join f on e.event_type = f.event_type and e.user_id = f.user_id and e.i = f.i + 1)
select event_type, user_id, t from f where emitted""")
def gate_debounce(spark, sf_dir):
    """Events more than two hours after the last one emitted for the same gate (the event type) and person."""
    e = table(spark, sf_dir, "events").select("event_type", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("t"))
    return clustering.debounced(e, ["event_type", "user_id"], "t", 7200.0)


@_own("nearest_vector", "select face, case when d < 0.9 then employee_id end employee_id, round(d, 6) distance from (select a.vec_id face, b.vec_id employee_id, sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(a.embedding[i]::double - b.embedding[i]::double, 2)))) d, row_number() over (partition by a.vec_id order by sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(a.embedding[i]::double - b.embedding[i]::double, 2)))), b.vec_id) r from embeddings a join embeddings b on b.vec_id % 25 = 0 and a.vec_id % 25 <> 0) x where r = 1")
def nearest_vector(spark, sf_dir):
    """Nearest known encoding below a limit (J18); every 25th row plays a registered person."""
    e = table(spark, sf_dir, "embeddings")
    known = e.filter("vec_id % 25 = 0").select(F.col("vec_id").alias("employee_id"), F.col("embedding").alias("e"))
    faces = e.filter("vec_id % 25 <> 0").select(F.col("vec_id").alias("face"), F.col("embedding").alias("v"))
    return att.identify(faces, known, 0.9).withColumn("distance", F.round("distance", 6))


@_own("mock_attendance")
def mock_attendance(spark, sf_dir):
    """Fourteen days without weekends, some absent, today some still in; the same on each run."""
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("employee_id"), F.col("c_name").alias("name"))
    today = F.lit("2024-01-30").cast("date")
    days = people.withColumn("day", F.explode(F.sequence(F.date_sub(today, 13), today))).filter(F.dayofweek("day").between(2, 6))

    def chance(salt):
        return F.pmod(F.xxhash64("employee_id", "day", F.lit(salt)), F.lit(1000)) / 1000

    kept = days.filter(chance(1) >= 0.12)
    start = (F.lit(8 * 3600) + F.floor(chance(2) * 7200)).cast("int")
    done = ~((F.col("day") == today) & (chance(3) < 0.4))
    return kept.select("employee_id", "name", "day", start.alias("in_s"), F.when(done, start + 8 * 3600 + F.floor(chance(4) * 7200)).cast("int").alias("out_s"))
