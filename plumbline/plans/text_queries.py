"""Texts: note grammars, references, segments, ragged tables, names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import reports
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


#: Labels in every dialect of the notes, made from the numbers of a part; both engines read this text alike.
LABELS = """case p_partkey % 18 when 0 then '-(' || p_size || ') -(T12)' when 1 then '-(' || p_size || ') -(T8 U Bar)' when 2 then '-(' || p_size || ')-T16 Perimeter Bar'
 when 3 then '-(' || p_size || ')-T8@200 mm' when 4 then p_size || ' -T20' when 5 then p_size || ' -T16 CRACK BAR' when 6 then p_size || ' -T12 -Crack Bar' when 7 then 'T8 @' || (p_size * 5) || ' mm'
 when 8 then 'T8 Horizontal Bar @' || (p_size * 5) || ' mm' when 9 then 'T8 UBAR @' || (p_size * 5) || ' mm' when 10 then 'T10 TIES @ ' || (p_size * 5) || ' mm c/c' when 11 then 'T' || p_size
 when 12 then 'B' || (p_size % 10) when 13 then 'T12 vert starter dowel' when 14 then '1-URGENT' when 15 then 'tie at N' || p_size when 16 then p_size || '.5' else p_name end"""


@_own("callout_grammar", rf"""
with t as (select p_partkey, trim({LABELS}) s from part), u as (select *, trim(regexp_replace(regexp_replace(s, '[()]', '', 'g'), '\s+', ' ', 'g')) b from t),
k as (select *, case when regexp_matches(b, '(?i)^-?\s*[0-9]+\s*-\s*T[0-9]+') then 'count' when regexp_matches(s, '(?i)^T[0-9]+\s*(UBAR|U\s*BAR|TIES?|HOOK)?\s*@\s*[0-9]+\s*mm') then 'pitch'
 when regexp_matches(s, '(?i)^T[0-9]+$') then 'bare' when regexp_matches(s, '^[A-Z][A-Z]?[0-9]?[0-9]?$') then 'mark' else 'UNPARSED' end kind from u)
select p_partkey, s, kind,
 case kind when 'count' then regexp_extract(b, '(?i)-\s*T([0-9]+)', 1)::double when 'pitch' then regexp_extract(s, '(?i)^T([0-9]+)', 1)::double when 'bare' then substr(s, 2)::double end dia,
 case kind when 'count' then regexp_extract(b, '[0-9]+')::int when 'bare' then 1 end n,
 case kind when 'pitch' then regexp_extract(s, '@\s*([0-9]+)', 1)::double end pitch,
 case kind when 'count' then trim(regexp_replace(b, '(?i)^-?\s*[0-9]+\s*-\s*T[0-9]+', '')) when 'pitch' then trim(regexp_extract(s, '(?i)^T[0-9]+\s*([A-Z ]*?)\s*@', 1) || ' ' || regexp_extract(s, '(?i)mm\s*(.*)$', 1)) when 'bare' then '' when 'mark' then 'MARK_REF' else 'UNPARSED' end note
from k""")
def callout_grammar(spark, sf_dir):
    """Ordered alternatives of the callout grammar with their numbers and notes."""
    t = table(spark, sf_dir, "part").select("p_partkey", F.trim(F.expr(LABELS)).alias("s"))
    return t.select("p_partkey", "s", tx.callout(F.col("s")).alias("c")).select("p_partkey", "s", "c.*")


_WORDS = " || ".join(f"case when regexp_matches(lower(r), '{p}') then ',{q}' else '' end" for q, p in [
    ("crack", r"\bcrack\b"), ("dowel", r"\bdowel\b"), ("hook", r"\bhooks?\b"), ("horizontal", r"\bhoriz(ontal)?\b"), ("perimeter", r"\bperimeter\b"),
    ("starter", r"\bstarter\b"), ("ties", r"\b(ties?|links?)\b"), ("u_bar", r"\b(u\s*-?\s*bars?|ubars?)\b"), ("vertical", r"\bvert(ical)?\b")])


@_own("note_qualifiers", rf"""
with t as (select p_partkey, trim(regexp_replace({LABELS}, '\s+', ' ', 'g')) s from part),
k as (select *, case when regexp_matches(s, '^-?\(?\s*[0-9]+\s*\)?\s*-\s*\(?\s*T\s*[0-9]+\s*[^)]*\)?\s*$') then 'qty' when regexp_matches(s, '(?i)^T\s*[0-9]+[^@]*@\s*[0-9]+') then 'space' when regexp_matches(s, '^[A-Z][0-9]?$') then 'mark' when regexp_matches(s, '(?i)^T\s*[0-9]+\s*[a-z ]*$') then 'dia' end kind from t),
r as (select *, case kind when 'qty' then regexp_replace(s, '^-?\(?\s*[0-9]+\s*\)?\s*-\s*\(?\s*T\s*[0-9]+', '') when 'space' then regexp_extract(s, '^[^@]*') when 'dia' then s else '' end r from k where kind is not null)
select p_partkey, kind, case kind when 'qty' then regexp_extract(s, '[0-9]+')::int end qty, case when kind <> 'mark' then regexp_extract(s, '(?i)T\s*([0-9]+)', 1)::int end dia,
 case when kind in ('qty', 'space') then nullif(regexp_extract(s, '@\s*([0-9]+)', 1), '')::int end spacing, case when kind <> 'mark' then substr({_WORDS}, 2) end qual from r""")
def note_qualifiers(spark, sf_dir):
    """Notes by quantity, spacing, mark or diameter, with their sorted qualifiers (T4, T5)."""
    t = table(spark, sf_dir, "part").select("p_partkey", tx.note(F.expr(LABELS)).alias("c")).filter("c is not null")
    return t.select("p_partkey", "c.kind", "c.qty", "c.dia", "c.spacing", F.when(F.col("c.kind") != "mark", F.array_join("c.qual", ",")).alias("qual"))


@_own("text_category", rf"""
with t as (select {LABELS} s from part)
select category, count(*) n from (select case when regexp_matches(s, '[0-9]\s*-\s*T[0-9]') then 'count' when regexp_matches(s, '(?i)T[0-9]+[a-z ]*@\s*[0-9]') or contains(s, '@') and regexp_matches(upper(s), 'T[0-9]') then 'pitch'
 when upper(s) like '%UBAR%' or upper(s) like '%U-BAR%' or upper(s) like '%U BAR%' then 'u-bar' when upper(s) like '%TIE%' then 'tie' when regexp_full_match(s, '[0-9.]+') then 'dimension' when regexp_matches(upper(s), '\bN[0-9]+\b') then 'insert' else 'other' end category from t) x group by 1""")
def text_category(spark, sf_dir):
    """First of seven classes of a drawing text."""
    return table(spark, sf_dir, "part").select(tx.text_class(F.expr(LABELS)).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@_own("cross_ref_extract", r"select page_id, regexp_extract(url, '^https?://([^/]+)', 1) host, len(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) n_refs, regexp_extract(html, 'href=\"([^\"]+)\"', 1) first_ref from pages")
def cross_ref_extract(spark, sf_dir):
    """References found in the concatenated text of a sheet."""
    ref = 'href="([^"]+)"'
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), F.size(F.regexp_extract_all("html", F.lit(ref), 1)).cast("long").alias("n_refs"), F.regexp_extract("html", ref, 1).alias("first_ref"))


@_own("title_segments", "select conv_id, turn, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn rows between unbounded preceding and current row) segment from (select distinct conv_id, turn, min(role) over (partition by conv_id, turn) role from conversations) d")
def title_segments(spark, sf_dir):
    """Ordered segmentation: a title cell begins a new block."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return c.select("conv_id", "turn", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w).alias("segment"))


@_own("visual_rows", "select conv_id, string_agg(role || ':' || turn, ' | ' order by turn, role) line, count(*) cells from conversations group by conv_id")
def visual_rows(spark, sf_dir):
    """Cells of a visual row joined in order."""
    cells = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("c"))
    return cells.select("conv_id", F.concat_ws(" | ", F.transform("c", lambda x: F.concat(x.role, F.lit(":"), x.turn.cast("string")))).alias("line"), F.size("c").cast("long").alias("cells"))


@_own("ragged_pad", "select doc_id, list_resize(str_split(text, chr(10)), 6, '')[1:6] lines from documents")
def ragged_pad(spark, sf_dir):
    """Ragged rows cut or filled to a width."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.pad_row(F.split("text", "\n"), 6).alias("lines"))


@_own("sheet_name_dedupe", r"""
select doc_id, case when r = 1 then base else base || '_' || r end sheet from (select doc_id, base, row_number() over (partition by base order by doc_id) r from (select doc_id, left(regexp_replace(source || ':' || lang, '[\[\]:*?/\\]', '', 'g'), 27) base from documents) a) b""")
def sheet_name_dedupe(spark, sf_dir):
    """Names stripped of forbidden signs, cut, and made unique."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("source"), F.lit(":"), F.col("lang")).alias("name"))
    return reports.sheet_names(d, "name", ["doc_id"]).select("doc_id", "sheet")


@_own("unparsed_top", "select o_orderstatus, count(*) instances, list_slice(list_sort(list(distinct o_orderpriority)), 1, 20) texts from orders where not regexp_matches(o_orderpriority, '^[12]') group by o_orderstatus")
def unparsed_top(spark, sf_dir):
    """Instances and the first twenty distinct texts."""
    o = table(spark, sf_dir, "orders").filter(~F.col("o_orderpriority").rlike("^[12]"))
    return o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("instances"), F.slice(F.array_sort(F.collect_set("o_orderpriority")), 1, 20).alias("texts"))


@_own("block_classes", "select p_partkey, case when contains(upper(p_name), 'SLEEVE') then 'sleeve' when contains(upper(p_type), 'STEEL') then 'steel' when contains(upper(p_type), 'BRASS') then 'brass' else 'other' end kind, regexp_extract(p_brand, '([0-9]+)', 1) capacity from part")
def block_classes(spark, sf_dir):
    """Class of a block by keyword priority, and a field of its name."""
    def has(c, w):
        return F.upper(c).contains(w)

    kind = F.when(has("p_name", "SLEEVE"), "sleeve").when(has("p_type", "STEEL"), "steel").when(has("p_type", "BRASS"), "brass").otherwise("other")
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("capacity"))


_ENVELOPE = "select event_id, try_cast(nullif(regexp_extract(props, '\"k\": ?(-?[0-9]+)', 1), '') as bigint) k from events"


@_own("json_envelope", _ENVELOPE)
def json_envelope(spark, sf_dir):
    """JSON parsed by schema, faulty rows null."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))
