"""Schedule tables as positioned text: segments, rows, headers, columns; and summaries and flowed text."""

from __future__ import annotations

from collections.abc import Callable
from math import nextafter

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import text as tx
from .clustering import anchor_groups, single_link

#: Titles that begin a segment, labels of the revision block, cells that only data rows hold.
TABLE_TITLE = r"Rebar schedule for ([\w\-]+)\(([A-Za-z]+)"
SUMMARY_TITLE = "Summary Schedule"
REVISION_TITLE = "REVISION SCHEDULE"
REVISION_LABELS = ["Rev", "Date", "Description", "Chkd", "Appd."]
DATA_CELL = r"^\d+(\.\d+)?\s*(mm|kg)$"


def _reading(sheet: str) -> WindowSpec:
    """The cells of a sheet from the top, then from the left; steps that read in this order share one sort."""
    return Window.partitionBy(sheet).orderBy(F.desc("y"), "x", "txt")


def without_revisions(cells: DataFrame, sheet: str, pad: float = 5.0) -> DataFrame:
    """Cells (sheet, y, x, txt) less those in the x range of a sheet's revision labels, whatever their height; cells of no sheet (null) stay."""
    whole = _reading(sheet).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    label = F.when(F.col(sheet).isNotNull() & F.trim("txt").isin(REVISION_LABELS), F.col("x"))
    span = cells.withColumns({"__lo": F.min(label).over(whole), "__hi": F.max(label).over(whole)})
    within = F.col("x").between(F.col("__lo") - pad, F.col("__hi") + pad)
    return span.filter(~F.coalesce(within, F.lit(False))).drop("__lo", "__hi")


def segments(cells: DataFrame, sheet: str) -> DataFrame:
    """Cells under a title, from the top: adds block (from 1), kind (table or summary), panel and sub.

    A summary keeps the panel of the table before it; what stands before any title or under a revision title goes.
    """
    kind = F.when(F.col("txt").rlike(TABLE_TITLE), "table").when(F.col("txt").contains(SUMMARY_TITLE), "summary").when(F.col("txt").contains(REVISION_TITLE), "revision")
    upto = _reading(sheet).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    titled = cells.withColumn("__t", kind)
    table = F.when(F.col("__t") == "table", F.struct(*[F.regexp_extract("txt", TABLE_TITLE, i).alias(c) for i, c in ((1, "panel"), (2, "sub"))]))
    running = {"block": F.count("__t").over(upto), "kind": F.last("__t", True).over(upto), "__of": F.last("__table", True).over(upto)}
    named = titled.withColumn("__table", table).withColumns(running).filter("__t is null and kind in ('table', 'summary')")
    return named.withColumns({"panel": F.col("__of.panel"), "sub": F.when(F.col("kind") == "table", F.col("__of.sub"))}).drop("__t", "__table", "__of")


def _lines(cells: DataFrame, sheet: str, kind: str, row_tol: float) -> DataFrame:
    """sheet, block, panel, sub, row, x, txt (trimmed) of the cells in segments of a kind; rows are single links of y."""
    body = segments(without_revisions(cells, sheet), sheet).filter(F.col("kind") == kind)
    body = body.select(sheet, "block", "panel", "sub", "x", F.trim("txt").alias("txt"), (-F.col("y")).alias("__up"))
    return single_link(body, [sheet, "block"], "__up", row_tol, "row").drop("__up")


def parse_tables(cells: DataFrame, sheet: str, row_tol: float = 2.0, column_tol: float = 12.0) -> DataFrame:
    """sheet, panel, sub, row, cells (map of canonical column to text) of every table row that has a mark.

    Rows are single links of y; the rows above the first data row are the header, one or more lines, whose lowest line gives
    the columns; a cell belongs to the nearest column within ``column_tol``, the left one of two. Of two texts in one place the
    left one counts. Sheets without a title, or tables without a data row, give nothing.

    Cells are dealt once, by sheet; from a row's cells on, as many as a table is wide, a row is an array. Column names are found once a table.
    """
    keys = [sheet, "block"]
    block = Window.partitionBy(*keys)
    cell = F.struct("x", "txt").alias("c")
    rows = _lines(cells, sheet, "table", row_tol).groupBy(*keys, "row").agg(F.first("panel").alias("panel"), F.first("sub").alias("sub"), F.max(F.col("txt").rlike(DATA_CELL)).alias("__data"), F.collect_list(cell).alias("c"))
    rows = rows.withColumn("__first", F.min(F.when(F.col("__data"), F.col("row"))).over(block))
    # rows are numbered without gaps, so the header's lowest line is the one before the first data row
    part = F.transform("c", lambda a: F.struct("row", a["x"].alias("x"), a["txt"].alias("label"), (F.col("row") == F.col("__first") - 1).alias("base")))
    rows = rows.withColumn("h", F.collect_list(F.when(F.col("row") < F.col("__first"), part)).over(block)).filter((F.col("row") >= F.col("__first")) & (F.size("h") > 0))
    label = lambda h, b: F.array_join(F.transform(F.filter(h, lambda a: F.abs(a["x"] - b["x"]) <= column_tol), lambda a: a["label"]), " ")
    labelled = lambda h: F.transform(F.filter(h, lambda c: c["base"]), lambda b: F.struct(b["x"].alias("cx"), label(h, b).alias("label")))
    named = F.transform(_with(F.sort_array(F.flatten("h")), labelled), lambda b: F.struct(b["cx"].alias("cx"), tx.column_head(b["label"]).alias("column")))
    data = rows.withColumn("__named", F.when(F.col("row") == F.col("__first"), named)).drop("h").withColumn("cols", F.first("__named", True).over(block))
    near = lambda x: F.array_min(F.transform(F.filter("cols", lambda c: F.abs(x - c["cx"]) <= column_tol), lambda c: F.struct(F.abs(x - c["cx"]).alias("d"), c["cx"].alias("cx"), c["column"].alias("column"))))
    own = F.filter(F.transform(F.sort_array("c"), lambda a: F.struct(near(a["x"])["column"].alias("column"), a["txt"].alias("txt"))), lambda a: a["column"].isNotNull())
    # of a column's texts the first from the left; exploded, so that the condition on marks does not find the map a second time
    first = lambda o: _with(F.transform(o, lambda a: a["column"]), lambda names: F.filter(o, lambda a, i: F.array_position(names, a["column"]) == i + 1))
    out = data.select(sheet, "panel", "sub", "row", F.explode(F.array(F.map_from_entries(_with(own, first)))).alias("cells"))
    return out.filter(F.col("cells")["Schedule Mark"].isNotNull())


def _with(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is found once, however often fn names it."""
    return F.transform(F.array(value), fn)[0]


def parse_summaries(cells: DataFrame, sheet: str, row_tol: float = 2.0, largest: int = 50) -> DataFrame:
    """sheet, panel, dia, length, kg of the summary rows: three numbers, the first a diameter of at most ``largest``; totals rows go."""
    number = F.regexp_extract(F.regexp_replace("txt", ",", ""), r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    numbers = _lines(cells, sheet, "summary", row_tol).withColumn("v", number).filter("v is not null")
    three = numbers.groupBy(sheet, "block", "row").agg(F.first("panel").alias("panel"), F.transform(F.sort_array(F.collect_list(F.struct("x", "v"))), lambda s: s["v"]).alias("v")).filter(F.size("v") == 3)
    return three.select(sheet, "panel", F.col("v")[0].alias("dia"), F.col("v")[1].alias("length"), F.col("v")[2].alias("kg")).filter(F.col("dia") <= largest)


#: A row of flowed text: mark, shape, diameter, quantity, length, weight; a length that varies counts 0.
FLOWED = r"\b([A-Z][A-Z0-9]*)\s+(M_\d+[A-Z]?)\s+T(\d+)\s+(\d+)\s+(<varies>|[\d.]+)\s*mm\s+([\d.]+)\s*kg"


def flowed_rows(text: Column) -> Column:
    """array of struct mark, shape, dia, qty, len, kg: all rows of a flowed text in order; a number that is none drops its row. Null text has none."""
    def row(line: Column) -> Column:
        get = lambda i: F.regexp_extract(line, FLOWED, i)
        length = F.when(get(5) == "<varies>", F.lit(0.0)).otherwise(get(5).try_cast("double"))
        return F.struct(get(1).alias("mark"), get(2).alias("shape"), get(3).try_cast("int").alias("dia"), get(4).try_cast("int").alias("qty"), length.alias("len"), get(6).try_cast("double").alias("kg"))

    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(FLOWED), F.lit(0)), row)
    return F.filter(found, lambda r: r["dia"].isNotNull() & r["qty"].isNotNull() & r["len"].isNotNull() & r["kg"].isNotNull())


def element_code(stem: Column) -> Column:
    """The element of a file stem: less its sheet suffix (S, R or M with a number) and its size in brackets."""
    return F.regexp_replace(F.regexp_replace(stem, r"\s*\[.*\]$", ""), r"_(S|R\d*|M\d*)$", "")


def panel_code(stem: Column) -> Column:
    return F.split_part(stem, F.lit("("), F.lit(1))


def visual_lines(texts: DataFrame, keys: list[str], tol: float = 3.0) -> DataFrame:
    """keys, line_no, y, line, cells: texts in visual rows from top to bottom, joined by ' | ' from left to right.

    texts: keys, x, y, text. A text joins the first row that exists less than ``tol`` from it, else begins one. Texts
    come by falling y, so that is the last row: rows are told by their first text, by a fold over distinct y; texts are then dealt to them by
    a running look-up. Texts of one place go by text; null texts and places are left out.
    """
    known = texts.dropna(subset=["x", "y", "text"]).select(*keys, "x", F.col("y").cast("double").alias("y"), "text")
    firsts = anchor_groups(known.select(*keys, (-F.col("y")).alias("__d")).distinct(), keys, "__d", nextafter(tol, 0.0))
    marks = firsts.select(*keys, F.col("anchor").alias("__d"), "group_no", "anchor", F.lit(None).cast("struct<x:double,text:string>").alias("cell"))
    cells = known.select(*keys, (-F.col("y")).alias("__d"), F.lit(None).cast("long").alias("group_no"), F.lit(None).cast("double").alias("anchor"), F.struct(F.col("x").cast("double").alias("x"), "text").alias("cell"))
    upto = Window.partitionBy(*keys).orderBy("__d", F.col("group_no").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = marks.unionByName(cells).withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in ("group_no", "anchor")}).filter("cell is not null")
    rows = placed.groupBy(*keys, F.col("group_no").alias("line_no"), (-F.col("anchor")).alias("y")).agg(F.array_sort(F.collect_list("cell")).alias("c"))
    return rows.select(*keys, "line_no", "y", F.array_join(F.transform("c", lambda c: c["text"]), " | ").alias("line"), F.size("c").alias("cells"))


def sheet_texts(cells: DataFrame, sheet: str, order: list[str], text: str) -> DataFrame:
    """sheet, text: the texts of a sheet in order, by one space; null texts are left out, a sheet without any is empty."""
    held = cells.groupBy(sheet).agg(F.array_sort(F.collect_list(F.struct(*order, text))).alias("c"))
    return held.select(sheet, F.array_join(F.transform("c", lambda c: c[text]), " ").alias("text"))


#: The title of the table of inserts and its columns, in the order in which an equally near cell takes them.
INSERT_TITLE = "Insert Schedule"
INSERT_COLUMNS = {"ref": "Ref No.", "type": "Type", "count": "Count"}


def insert_schedule(cells: DataFrame, sheet: str, near: float = 20.0, row: float = 3.0) -> DataFrame:
    """sheet, line_no, ref, type, count: the table of inserts of each sheet that has one.

    cells: sheet, x, y, text (white space squeezed before). The header cells stand less than 12 below the title; a sheet
    without all three has no table. Cells more than 4 below the title, up to 15 right of the last column, come from top
    to bottom (then by x) until one that names another schedule; a cell more than ``near`` from all columns is not of the
    table, others take the nearest. A row begins with a cell more than ``row`` below the first one of the row before.
    Of several cells of one place the last counts; a row needs all three, and a digit in its count. If a title or header
    stands twice, the upper, then left one counts. Nulls are left out.
    """
    t = cells.dropna(subset=["x", "y", "text"]).select(sheet, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text")).filter("text <> ''")
    title = t.filter(F.col("text") == INSERT_TITLE).groupBy(sheet).agg(F.max("y").alias("hy"))
    heads = t.join(title, sheet).filter((F.col("y") < F.col("hy")) & (F.col("hy") - F.col("y") < 12) & F.col("text").isin(*INSERT_COLUMNS.values()))
    place = [F.min_by("x", F.when(F.col("text") == name, F.struct(-F.col("y"), F.col("x")))).alias(c) for c, name in INSERT_COLUMNS.items()]
    frame = heads.groupBy(sheet).agg(*place).dropna().join(title, sheet)
    band = t.join(frame, sheet).filter((F.col("y") < F.col("hy") - 4) & (F.col("x") <= F.greatest(*INSERT_COLUMNS) + 15) & ~F.col("text").isin(*INSERT_COLUMNS.values()))
    stop = band.filter(F.col("text").contains("Schedule") | F.startswith(F.col("text"), F.lit("\\L"))).groupBy(sheet).agg(F.min(F.struct((-F.col("y")).alias("d"), "x")).alias("stop"))
    column = F.array_min(F.array(*[F.struct(F.abs(F.col("x") - F.col(c)).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(INSERT_COLUMNS)]))
    kept = band.join(stop, sheet, "left").filter(F.col("stop").isNull() | (F.struct((-F.col("y")).alias("d"), "x") < F.col("stop"))).withColumn("c", column).filter(F.col("c.d") <= near)
    rows = anchor_groups(kept.select(sheet, (-F.col("y")).alias("__d")).distinct(), [sheet], "__d", row)
    marks = rows.select(sheet, F.col("anchor").alias("__d"), "group_no", F.lit(None).cast("int").alias("i"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("string").alias("text"))
    held = kept.select(sheet, (-F.col("y")).alias("__d"), F.lit(None).cast("long").alias("group_no"), F.col("c.i").alias("i"), "x", "text")
    upto = Window.partitionBy(sheet).orderBy("__d", F.col("group_no").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = marks.unionByName(held).withColumn("line_no", F.last("group_no", ignorenulls=True).over(upto)).filter("i is not null")
    last = [F.max(F.when(F.col("i") == i, F.struct("__d", "x", "text"))).alias(c) for i, c in enumerate(INSERT_COLUMNS)]
    whole = placed.groupBy(sheet, "line_no").agg(*last).dropna()
    return whole.select(sheet, "line_no", F.col("ref.text").alias("ref"), F.col("type.text").alias("type"), F.regexp_replace("count.text", r"\D", "").try_cast("long").alias("count")).filter("count is not null")
