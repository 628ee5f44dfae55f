"""Schedule tables drawn as positioned text, parsed back into rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tables as parsers
from .tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_ROWS = "rows_ as (select l_orderkey o, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) r, l_partkey % 90 m, cast(l_quantity as bigint) q, 8 + 2 * (l_suppkey % 3) d, l_returnflag f from lineitem)"
#: A sheet for each order, as both engines read it: titles, two header lines, rows that are not quite straight, a summary, a revision block.
CELLS = f"""with {_ROWS}, s as (select distinct o from rows_)
select o sheet, 1000.0 y, 10.0 x, 'Rebar schedule for PW-' || o || '(R)' txt from s
union all select o, 990.0, 10.0, 'Schedule' from s union all select o, 985.0, 11.0, 'Mark' from s union all select o, 990.0, 60.0, 'Bar' from s union all select o, 985.0, 58.0, 'Diameter' from s
union all select o, 985.0, 100.0, 'Quantity' from s union all select o, 985.5, 150.0, 'Bar Length' from s union all select o, 985.0, 200.0, 'Weight' from s
union all select o, 980.0 - 6 * r, 12.0, 'K' || m from rows_ where f <> 'N' or m % 2 = 0 union all select o, 980.4 - 6 * r, 57.0, d || ' mm' from rows_ union all select o, 980.0 - 6 * r, 104.0, '' || q from rows_
union all select o, 981.0 - 6 * r, 148.0, (q * 100) || ' mm' from rows_ union all select o, 980.0 - 6 * r, 201.0, q || '.5 kg' from rows_
union all select o, 500.0, 10.0, 'Summary Schedule' from s union all select o, 490.0, 10.0, 'Dia' from s
union all select o, 480.0 - 6 * d, 10.0, 'T' || d from rows_ group by 1, 2, 4 union all select o, 480.0 - 6 * d, 60.0, sum(q * 100) || ' mm' from rows_ group by o, d union all select o, 480.5 - 6 * d, 100.0, sum(q) || '.25 kg' from rows_ group by o, d
union all select o, 300.0, 10.0, 'Total' from s union all select o, 300.0, 60.0, '99' from s
union all select o, 975.0, 900.0, 'Rev' from s union all select o, 975.0, 930.0, 'Date' from s union all select o, 970.0 - o % 50, 915.0, '12 mm' from s"""


def _drawn(*cells: tuple[str, float, str]) -> str:
    return "array(" + ", ".join(f"named_struct('y', cast({y} as double), 'x', {x}d, 'txt', {txt})" for y, x, txt in cells) + ")"


_ROW = _drawn(("980.4 - 6 * r", 57.0, "d || ' mm'"), ("980.0 - 6 * r", 104.0, "'' || q"), ("981.0 - 6 * r", 148.0, "(q * 100) || ' mm'"), ("980.0 - 6 * r", 201.0, "q || '.5 kg'"))
_MARK = _drawn(("980.0 - 6 * r", 12.0, "'K' || m"))
_SHEET = _drawn(
    ("1000.0", 10.0, "'Rebar schedule for PW-' || o || '(R)'"), ("990.0", 10.0, "'Schedule'"), ("985.0", 11.0, "'Mark'"), ("990.0", 60.0, "'Bar'"), ("985.0", 58.0, "'Diameter'"),
    ("985.0", 100.0, "'Quantity'"), ("985.5", 150.0, "'Bar Length'"), ("985.0", 200.0, "'Weight'"), ("500.0", 10.0, "'Summary Schedule'"), ("490.0", 10.0, "'Dia'"),
    ("300.0", 10.0, "'Total'"), ("300.0", 60.0, "'99'"), ("975.0", 900.0, "'Rev'"), ("975.0", 930.0, "'Date'"), ("970.0 - o % 50", 915.0, "'12 mm'"),
)
_SUMS = _drawn(("480.0 - 6 * d", 10.0, "'T' || d"), ("480.0 - 6 * d", 60.0, "mm || ' mm'"), ("480.5 - 6 * d", 100.0, "kg || '.25 kg'"))
#: The cells of CELLS, places as doubles, drawn in one pass over an order's rows: a row's own, the sheet's with its first row, a summary's with a
#: diameter's first row. Orders are dealt once, by the name that sheets are parsed by.
DRAWN = f"""with l as (select l_orderkey o, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_partkey % 90 m, cast(l_quantity as bigint) q, 8 + 2 * (l_suppkey % 3) d, l_returnflag f from lineitem),
rows_ as (select o, m, q, d, f, row_number() over (partition by o order by l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) r from l),
w as (select *, sum(q * 100) over e mm, sum(q) over e kg, row_number() over (partition by o, d order by r) n from rows_ window e as (partition by o, d order by r rows between unbounded preceding and unbounded following))
select o sheet, inline(concat({_ROW}, case when f <> 'N' or m % 2 = 0 then {_MARK} else array() end, case when r = 1 then {_SHEET} else array() end, case when n = 1 then {_SUMS} else array() end)) from w"""


def _cells(spark, sf_dir):
    """CELLS, dealt by sheet once: their steps go on where the rows lie."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql(DRAWN)


def schedule_rows(spark, sf_dir):
    """Every sheet's table parsed back from its cells."""
    t = parsers.parse_tables(_cells(spark, sf_dir), "sheet")
    cell = lambda k: F.col("cells")[k]
    return t.select("sheet", "panel", "sub", cell("Schedule Mark").alias("mark"), cell("Bar Diameter").alias("dia"), cell("Quantity").alias("qty"), cell("Bar Length").alias("length"), cell("Weight").alias("kg"))


def schedule_summaries(spark, sf_dir):
    """Every sheet's summary parsed back from its cells."""
    return parsers.parse_summaries(_cells(spark, sf_dir), "sheet")


_FLOW = "select o, string_agg('K' || m || ' M_' || (m % 20) || ' T' || d || ' ' || q || ' ' || case when m % 5 = 0 then '<varies>' else '' || (q * 100) end || ' mm ' || q || '.5 kg', ' ; ') t from rows_ group by 1"


def flowed_schedule(spark, sf_dir):
    """Rows found in flowed text, lengths that vary as 0."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    t = spark.sql(f"with {_ROWS} {_FLOW}".replace("string_agg", "listagg"))
    return t.select("o", F.explode(parsers.flowed_rows(F.col("t"))).alias("r")).select("o", "r.*")


def sheet_codes(spark, sf_dir):
    """Elements, panels and sheets of file stems."""
    stem = F.expr("'PW-' || p_brand || case p_partkey % 4 when 0 then '_S' when 1 then '_R2' when 2 then '_M1 [3000x2400x200]' else '' end || case when p_partkey % 3 = 0 then '(R' || p_partkey % 5 || ')' else '' end")
    p = table(spark, sf_dir, "part").select("p_partkey", stem.alias("stem"))
    return p.select("p_partkey", parsers.element_code(F.col("stem")).alias("element"), parsers.panel_code(F.col("stem")).alias("panel"), F.nullif(F.regexp_extract("stem", r"\((R\d*)\)", 1), F.lit("")).alias("sheet"))


QUERIES = {f.__name__: f for f in (schedule_rows, schedule_summaries, flowed_schedule, sheet_codes)}
#: The rows as they were before they were drawn: a parse gives them back.
ORACLE_SQL = {
    "schedule_rows": f"with {_ROWS} select o sheet, 'PW-' || o panel, 'R' sub, 'K' || m mark, d || ' mm' dia, '' || q qty, (q * 100) || ' mm' length, q || '.5 kg' kg from rows_ where f <> 'N' or m % 2 = 0",
    "schedule_summaries": f"with {_ROWS} select o sheet, 'PW-' || o panel, d::double dia, sum(q * 100)::double length, sum(q) + 0.25::double kg from rows_ group by o, d",
    "flowed_schedule": f"with {_ROWS} select o, 'K' || m mark, 'M_' || (m % 20) shape, d dia, q qty, case when m % 5 = 0 then 0 else q * 100.0 end len, q + 0.5 kg from rows_",
    "sheet_codes": "with s as (select *, 'PW-' || p_brand b, case when p_partkey % 3 = 0 then 'R' || p_partkey % 5 end sh from part) select p_partkey, b || case when sh is not null then case p_partkey % 4 when 0 then '_S' when 1 then '_R2' when 2 then '_M1 [3000x2400x200]' else '' end || '(' || sh || ')' else '' end element, b || case p_partkey % 4 when 0 then '_S' when 1 then '_R2' when 2 then '_M1 [3000x2400x200]' else '' end panel, sh sheet from s",
}
