"""Schedules filled from drawn bars, and texts of drawings, over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import filling, matching, tables
from .assembly_queries import _L, _sql
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


_KEYS = ["panel", "dia"]
_ROWS = "select s panel, 8 + 2 * (p % 3) dia, id mark, cast(q as bigint) % 6 qty, e / 15 target from l where f = 'A'"
_BARS = "select s panel, 8 + 2 * (p % 3) dia, id item, e / 16 length, q * 50 x0, 1.0e0 * (p % 900) y0, q * 50 + case when k % 2 = 0 then e / 16 else 0 end x1, 1.0e0 * (p % 900) + case when k % 2 = 0 then 0 else e / 16 end y1 from l where f = 'R'"


@_own("straight_claims")
def straight_claims(spark, sf_dir):
    """Bars claimed by straight rows, and what is left to be made (M2)."""
    return filling.claim_bars(_sql(spark, sf_dir, _ROWS), _sql(spark, sf_dir, _BARS), _KEYS)


@_own("made_bars")
def made_bars(spark, sf_dir):
    """Where the shortfall of straight rows is drawn (M2)."""
    rows, bars = _sql(spark, sf_dir, _ROWS), _sql(spark, sf_dir, _BARS)
    panels = _sql(spark, sf_dir, "select distinct s panel, 100.0e0 x0, 50.0e0 y0, 3100.0e0 + s % 5 * 100 x1, 2850.0e0 y1 from l")
    out = filling.made_bars(filling.claim_bars(rows, bars, _KEYS), rows, bars, panels, _KEYS, "panel")
    return out.select("panel", "dia", "mark", "unit", *[F.round(c, 3).alias(c) for c in ("x0", "y0", "x1", "y1")])


@_own("bent_claims")
def bent_claims(spark, sf_dir):
    """Chained bars claimed by bent rows, as counts and length for each mark (M3)."""
    claims = filling.claim_bars(_sql(spark, sf_dir, _ROWS), _sql(spark, sf_dir, _BARS), _KEYS, 120.0, 0.20)
    return claims.groupBy(*_KEYS, "mark").agg(F.count("item").alias("claimed"), F.count(F.lit(1)).alias("qty"), F.round(F.sum("length"), 4).alias("length"))


@_own("filled_rows")
def filled_rows(spark, sf_dir):
    """Bars given to the rows that they fit best, by direction (M5)."""
    rows = _sql(spark, sf_dir, "select s panel, id sno, case when p % 9 = 0 then 15 else 8 + 4 * (p % 3) end dia, case p % 4 when 0 then 'Horizontal mesh' when 1 then 'VERTICAL bars' else 'ties' end descr, cast(q as bigint) % 6 nos, e / 9000 length from l where f = 'A'")
    bars = _sql(spark, sf_dir, "select s panel, id bar, 8 + 4 * (p % 3) dia, e / 8000 length, case when k = 1 then 'tie' else 'mesh' end kind, q * 10 w, 250 - q * 3 h from l where f = 'R'")
    bars = bars.withColumn("orient", filling.orientation(F.col("kind"), F.col("w"), F.col("h")))
    return filling.fill_rows(rows, bars, ["panel"]).withColumn("found", F.round("found", 4))


@_own("missing_steel")
def missing_steel(spark, sf_dir):
    """Verdicts of three pools with what is missing, in units and kg (M6)."""
    rows, bars = _sql(spark, sf_dir, _ROWS), _sql(spark, sf_dir, _BARS)
    pools = [bars.filter(F.col("item") % 3 == i).select(*_KEYS, "length") for i in range(3)]
    return filling.with_missing(matching.tiered(rows.filter("qty > 0"), pools, _KEYS), "dia")


#: Names of blocks, made of parts: both forms of anchors, other cast-in blocks, and names of no kind.
_BLOCKS = """case p_partkey % 6 when 0 then 'RR spread anchor face based - RR-SA-' || p_size || '_' || p_partkey % 10 || '-' || (100 + p_size) || '-' || p_partkey || '-Front - 1'
 when 1 then p_size || '_5Ø_ Lifting Insert_COLUMN - ' || p_size || 'Ø Lifting insert-' || p_partkey || '-Plan' when 2 then 'CORBEL ' || p_name when 3 then 'Steel Channel with Stiffener ' || p_size when 4 then 'Wire Loop / LoopBox ' || p_size else p_name end"""
_KIND = {name: "case " + " ".join(f"when contains(lower(n), '{w}') then '{k}'" for w, k in kinds) for name, kinds in (("model", tx.BLOCK_KINDS), ("drawing", tx.CASTIN_KINDS))}


@_own("anchor_blocks", rf"""with b as (select p_partkey, {_BLOCKS} n from part), a as (select *, regexp_extract(n, '(?i)^RR spread anchor face based - RR-SA-([\d_]+)-(\d+)-([^-]+)-(.+)$', ['cap', 'embed', 'id', 'suffix']) r,
 regexp_extract(n, '(?i)^([\d_]+)Ø_?\s*Lifting Insert_COLUMN - ([\d_]+)Ø\s*Lifting insert-([^-]+)-(.+)$', ['d1', 'd2', 'id', 'suffix']) f from b)
select p_partkey, case when r.id <> '' then 'RR-SA' when f.id <> '' then 'lifting_insert' else 'unknown' end family, try_cast(replace(r.cap, '_', '.') as double) capacity_t, try_cast(r.embed as integer) embed_length_mm,
 case when r.id <> '' then 'RR-SA-' || r.cap || '-' || r.embed when f.id <> '' then 'LIFT-' || f.d2 else 'UNKNOWN:' || n[:40] end type_key, nullif(r.id || f.id, '') ref_id, nullif(r.suffix || f.suffix, '') view_suffix,
 {_KIND['model']} end model_kind, {_KIND['drawing']} else 'other' end drawing_kind from a""")
def anchor_blocks(spark, sf_dir):
    """Names of anchor blocks parsed, and kinds of cast-in blocks by keyword."""
    b = table(spark, sf_dir, "part").select("p_partkey", F.expr(_BLOCKS).alias("n"))
    return b.select("p_partkey", tx.anchor_block(F.col("n")).alias("a"), tx.block_kind(F.col("n")).alias("model_kind"), tx.block_kind(F.col("n"), tx.CASTIN_KINDS, "other").alias("drawing_kind")).select("p_partkey", "a.*", "model_kind", "drawing_kind")


#: Cells of an order's sheet: pieces of the note that names another element, in an order of their own.
_CELLS = "select o sheet, q * 40 + k y, e % 300 x, case k % 5 when 0 then 'REINFORCEMENT' when 1 then 'Details  refer' when 2 then ': PW-' || p || '-GF see also' when 3 then 'PC-' || id else chr(10) || 'NOTE ' || s end text from l"


@_own("element_references", rf"""with {_L}, c as ({_CELLS}), t as (select sheet, regexp_replace(string_agg(text, ' ' order by -y, x, text), '\s+', ' ', 'g') t from c group by 1)
select sheet, nullif(regexp_extract(t, '(?i)REINFORCEMENT\s+DETAILS?\s*(?:REFER|SEE)?\s*[:\-]?\s*([A-Z]{{2}}-[A-Z0-9\-]+)', 1), '') as element from t""")
def element_references(spark, sf_dir):
    """The element that a note, spread over the cells of a sheet, refers to."""
    cells = _sql(spark, sf_dir, _CELLS).withColumn("down", -F.col("y"))
    return tables.sheet_texts(cells, "sheet", ["down", "x"], "text").select("sheet", tx.reinforced_as(F.col("text")).alias("element"))


_WORDS = "select s sheet, e / 40 y, q * 3 x, 'c' || p % 100 text from l"


@_own("visual_lines", f"""with recursive {_L}, t as ({_WORDS}), a as (select sheet, max(y) y, 0 line_no from t group by 1 union all select sheet, y, line_no from (select a.sheet, (select max(t.y) from t where t.sheet = a.sheet and t.y <= a.y - 3) y, line_no + 1 line_no from a) z where y is not null),
m as (select t.sheet, x, text, t.y, a.y top, line_no from t asof join a on t.sheet = a.sheet and t.y <= a.y)
select sheet, cast(line_no as bigint) line_no, top y, string_agg(text, ' | ' order by x, text) line, count(*) cells from m group by 1, 2, 3""")
def visual_lines(spark, sf_dir):
    """Texts in visual rows, each in the first row within 3 of it."""
    return tables.visual_lines(_sql(spark, sf_dir, _WORDS), ["sheet"])
