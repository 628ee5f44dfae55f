"""Reports over marks, evidence, views and days; text and JSON sinks; sheets and siblings as sources."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import ship

#: Kg per metre of the audited diameters.
UNIT_KG = {6: 0.222, 8: 0.395, 10: 0.617, 12: 0.888, 16: 1.578, 20: 2.466, 25: 3.854, 32: 6.313}


def unit_kg(dia: Column) -> Column:
    """kg per metre of a diameter by the table; null for others."""
    return F.create_map(*[F.lit(v) for k, x in UNIT_KG.items() for v in (k, x)])[dia.cast("int")]


def audit_marks(marks: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """marks (keys, qty, len, dia) with tagged, located, covered, covered_len, covered_kg: the best source of each mark, at most its quantity.

    ``evidence``: keys, source, n; sources are tagged, located or others. Marks without evidence have zeros.
    """
    per = evidence.groupBy(*keys, "source").agg(F.sum("n").alias("n"))
    best = per.groupBy(*keys).agg(F.max("n").alias("best"), *[F.coalesce(F.max(F.when(F.col("source") == s, F.col("n"))), F.lit(0)).alias(s) for s in ("tagged", "located")])
    j = marks.join(best, keys, "left").fillna(0, ["best", "tagged", "located"])
    covered = F.least("best", "qty")
    return j.select(*keys, "qty", "tagged", "located", covered.alias("covered"), (covered * F.col("len")).alias("covered_len"), (covered * F.col("len") / 1000 * unit_kg(F.col("dia"))).alias("covered_kg"))


def model_against_schedule(placed: DataFrame, marks: DataFrame, keys: list[str], len_tol: float = 2.0, kg_tol: float = 0.1) -> DataFrame:
    """Full outer of placed bars (keys, len, kg) and marks (keys, qty, cut, kg): counts, and whether count, mean length and weight agree."""
    p = placed.groupBy(*[F.col(k).alias(f"p_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("placed"), F.avg("len").alias("mean_len"), F.sum("kg").alias("placed_kg"))
    on = [F.col(k) == F.col(f"p_{k}") for k in keys]
    j = marks.join(p, on, "full_outer")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return j.select(*[F.coalesce(k, f"p_{k}").alias(k) for k in keys], F.coalesce("qty", F.lit(0)).alias("qty"), F.coalesce("placed", F.lit(0)).alias("placed"), yes(F.col("qty") == F.col("placed")).alias("count_ok"), yes(F.abs(F.col("mean_len") - F.col("cut")) <= len_tol).alias("len_ok"), yes(F.abs(F.col("placed_kg") - F.col("kg")) <= kg_tol).alias("kg_ok"))


def element_summary(rows: DataFrame, key: str) -> DataFrame:
    """key, qty, length, located_share (by length), evidence: rows (key, qty, cut, located, evidence map) summed, their maps merged by sum."""
    base = rows.groupBy(key).agg(F.sum("qty").alias("qty"), F.sum(F.col("qty") * F.col("cut")).alias("length"), (F.sum(F.least("located", "qty") * F.col("cut")) / F.nullif(F.sum(F.col("qty") * F.col("cut")), F.lit(0))).alias("located_share"))
    merged = rows.select(key, F.explode("evidence").alias("k", "v")).groupBy(key, "k").agg(F.sum("v").alias("v"))
    maps = merged.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("evidence"))
    return base.join(maps, key, "left")


def annotation_index(tags: DataFrame, views: DataFrame, panel: str) -> DataFrame:
    """panel, mark, qty, groups, spacing: tags of each panel's largest view, once for each mark and place to 0.1, the last spacing by ``seq``.

    ``tags``: panel, view, mark, x, y, qty, spacing, seq; ``views``: panel, view, area. Of equal tags the first by seq counts.
    """
    main = views.groupBy(panel).agg(F.max_by("view", F.struct("area", "view")).alias("view"))
    at = tags.join(main, [panel, "view"], "left_semi").withColumn("__x", F.round("x", 1)).withColumn("__y", F.round("y", 1))
    once = at.groupBy(panel, "mark", "__x", "__y").agg(F.min_by(F.struct("seq", "qty", "spacing"), "seq").alias("t")).select(panel, "mark", "t.*")
    groups = F.transform(F.sort_array(F.collect_list(F.struct("seq", "qty"))), lambda g: g["qty"])
    return once.groupBy(panel, "mark").agg(F.sum("qty").alias("qty"), groups.alias("groups"), F.max_by("spacing", F.when(F.col("spacing").isNotNull(), F.col("seq"))).alias("spacing"))


def largest_cluster(clusters: DataFrame, circles: DataFrame, key: str, snap: Column) -> DataFrame:
    """key, cluster, circles, dias: each key's cluster of largest area (the lowest of equals) with the circles in its box and their snapped diameters.

    ``clusters``: key, cluster, x0, y0, x1, y1; ``circles``: key, x, y and what ``snap`` reads.
    """
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    main = clusters.groupBy(F.col(key).alias("__k")).agg(F.max_by(F.struct("cluster", "x0", "y0", "x1", "y1"), F.struct(area, -F.col("cluster"))).alias("m"))
    inside = circles.withColumn("__dia", snap).join(main, (F.col(key) == F.col("__k")) & F.col("x").between(F.col("m.x0"), F.col("m.x1")) & F.col("y").between(F.col("m.y0"), F.col("m.y1")) & F.col("__dia").isNotNull(), "right")
    return inside.groupBy(F.col("__k").alias(key), F.col("m.cluster").alias("cluster")).agg(F.count("__dia").alias("circles"), F.sort_array(F.collect_set("__dia")).alias("dias"))


def siblings_in_time(files: DataFrame, group: str, name: str, at: str, days: int = 7) -> DataFrame:
    """Files with ``trusted``: the group's other files lie less than ``days`` from it (true without any)."""
    w = Window.partitionBy(group)
    far = F.greatest(F.max(F.unix_seconds(at)).over(w) - F.unix_seconds(at), F.unix_seconds(at) - F.min(F.unix_seconds(at)).over(w))
    return files.select(group, name, at, (far < days * 86400).alias("trusted"))


def ranked_days(days: DataFrame, by: str) -> DataFrame:
    """Rows (name, day, seconds) with ``place`` in each day by name (Unicode order) or by duration, longest first, unknown last."""
    order = {"name": [F.collate("name", "UNICODE"), F.col("name")], "duration": [F.desc(F.coalesce("seconds", F.lit(-1))), F.col("name")]}[by]
    return days.withColumn("place", F.row_number().over(Window.partitionBy("day").orderBy(*order)))


def personal_report(days: DataFrame, who: str) -> DataFrame:
    """who, total seconds, and the days, latest first."""
    listed = F.sort_array(F.collect_list(F.struct("day", "seconds")), asc=False)
    return days.groupBy(who).agg(F.sum(F.coalesce("seconds", F.lit(0))).alias("total"), F.count(F.lit(1)).alias("days"), listed[0]["day"].alias("last_day"))


def business_day(ts: Column, offset: str = "+05:30") -> Column:
    """The calendar day of an instant at a fixed offset."""
    return F.to_date(F.from_utc_timestamp(ts, offset))


def enrolled(photos: DataFrame, who: str, least: int = 3) -> DataFrame:
    """who, photos, ok: people with at least ``least`` photos, each with exactly one face. ``photos``: who, faces (null: none found)."""
    return photos.groupBy(who).agg(F.count(F.lit(1)).alias("photos"), ((F.count(F.lit(1)) >= least) & F.bool_and(F.coalesce(F.col("faces") == 1, F.lit(False)))).alias("ok"))


def read_sheet(spark: SparkSession, path: str, columns: list[str], first: int = 2) -> DataFrame:
    """Rows of a CSV sheet from line ``first`` on; cells are trimmed, empty ones null, rows with an empty first cell go."""
    raw = spark.read.csv(path, header=first > 1, schema=", ".join(f"`{c}` string" for c in columns), mode="PERMISSIVE")
    cells = raw.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in columns])
    return cells.filter(F.col(f"`{columns[0]}`").isNotNull())


def sheet_names(rows: DataFrame, name: str, order: list[str], out: str = "sheet") -> DataFrame:
    """Add ``out``: names less the signs []:*?/\\, cut to 27, and unique: in order, a name that is taken gets _2, _3 and so on until it is free.

    Only names that are equal but for such endings can clash, so these are told apart together, group by group. Null
    names count as empty; rows equal in ``order`` are interchangeable.
    """
    base = F.substring(F.regexp_replace(F.coalesce(name, F.lit("")), r"[\[\]:*?/\\]", ""), 1, 27)
    marked = rows.withColumn("__base", base).withColumn("__root", F.regexp_replace("__base", r"(_\d+)+$", ""))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        taken, following, names = set(), {}, []
        for own in pdf["__base"]:
            free, n = own, following.get(own, 2)
            while free in taken:
                free, n = f"{own}_{n}", n + 1
            following[own] = n
            taken.add(free)
            names.append(free)
        return pdf.drop(columns=["__base", "__root"]).assign(**{out: names})

    ship(rows.sparkSession)
    schema = ", ".join([*[f"`{c}` {kind}" for c, kind in rows.dtypes], f"`{out}` string"])
    return marked.groupBy("__root").applyInPandas(run, schema)


def report_lines(rows: DataFrame, panel: str, line: Column) -> DataFrame:
    """(panel, value): one text line a row, as a text sink partitioned by panel takes it."""
    return rows.select(panel, line.alias("value"))


def write_reports(lines: DataFrame, panel: str, path: str) -> None:
    """One folder of text for each panel."""
    lines.write.partitionBy(panel).text(path)


def write_json(rows: DataFrame, panel: str, path: str) -> None:
    """JSON for each panel, and an index of panels with their numbers of rows beside it."""
    rows.write.partitionBy(panel).json(f"{path}/panels")
    rows.groupBy(panel).agg(F.count(F.lit(1)).alias("rows")).write.json(f"{path}/index")
