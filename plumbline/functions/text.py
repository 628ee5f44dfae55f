"""Grammars of notes and text tables, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(text: Column) -> Column:
    """First number in a text, thousands commas removed; null without one."""
    return F.nullif(F.regexp_extract(F.regexp_replace(text, ",", ""), r"-?[0-9]+(?:\.[0-9]+)?", 0), F.lit("")).try_cast("double")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


#: Alternatives of the callout grammar, in the order in which they are tried. The first one looks at the
#: text without parentheses, the others at the text as it stands.
COUNT_DIA = r"(?i)^-?\s*(\d+)\s*-\s*T(\d+)\s*(.*)$"
DIA_PITCH = r"(?i)^T(\d+)\s*(UBAR|U\s*BAR|TIE[S]?|HOOK)?\s*@\s*(\d+)\s*mm\s*(.*)$"
BARE_DIA = r"(?i)^T(\d+)$"
MARK = r"^[A-Z]{1,2}\d{0,2}$"


def callout(text: Column) -> Column:
    """struct kind (count, pitch, bare, mark or UNPARSED), dia, n, pitch, note: the first alternative that holds.

    A bare diameter counts once; marks and unparsed texts have no numbers. Null text is null.
    """
    plain = F.trim(F.regexp_replace(text, "\n", " "))
    bared = squeeze(F.regexp_replace(plain, "[()]", ""))
    part = lambda t, pattern, i: F.regexp_extract(t, pattern, i)
    kinds = [(bared.rlike(COUNT_DIA), "count"), (plain.rlike(DIA_PITCH), "pitch"), (plain.rlike(BARE_DIA), "bare"), (plain.rlike(MARK), "mark")]
    kind = F.lit("UNPARSED")
    for holds, name in reversed(kinds):
        kind = F.when(holds, name).otherwise(kind)
    by = lambda **c: F.coalesce(*[F.when(kind == k, v) for k, v in c.items()])
    return F.when(text.isNotNull(), F.struct(
        kind.alias("kind"),
        by(count=part(bared, COUNT_DIA, 2), pitch=part(plain, DIA_PITCH, 1), bare=part(plain, BARE_DIA, 1)).cast("double").alias("dia"),
        by(count=part(bared, COUNT_DIA, 1), bare=F.lit("1")).cast("int").alias("n"),
        by(pitch=part(plain, DIA_PITCH, 3)).cast("double").alias("pitch"),
        F.trim(by(count=part(bared, COUNT_DIA, 3), pitch=F.concat_ws(" ", part(plain, DIA_PITCH, 2), part(plain, DIA_PITCH, 4)), bare=F.lit(""), mark=F.lit("MARK_REF"), UNPARSED=F.lit("UNPARSED"))).alias("note"),
    ))


def callout_kind(text: Column) -> Column:
    return callout(text)["kind"]


#: Qualifiers of notes, each with the words that show it.
QUALIFIERS = {
    "u_bar": r"(?i)\bu\s*-?\s*bars?\b|\bubars?\b",
    "ties": r"(?i)\btie(s)?\b|\blink(s)?\b",
    "hook": r"(?i)\bhook(s)?\b",
    "horizontal": r"(?i)\bhoriz(ontal)?\b",
    "vertical": r"(?i)\bvert(ical)?\b",
    "crack": r"(?i)\bcrack\b",
    "perimeter": r"(?i)\bperimeter\b",
    "dowel": r"(?i)\bdowel\b",
    "starter": r"(?i)\bstarter\b",
}


def qualifiers(text: Column) -> Column:
    """Sorted names of the qualifiers that a note shows; none in a null text."""
    return F.filter(F.array(*[F.when(F.coalesce(text, F.lit("")).rlike(QUALIFIERS[q]), F.lit(q)) for q in sorted(QUALIFIERS)]), lambda x: x.isNotNull())


#: Notes by quantity, by spacing, mark bubbles, bare diameters, in the order in which they are tried.
NOTE_QTY = r"^-?\(?\s*(\d+)\s*\)?\s*-\s*\(?\s*T\s*(\d+)\s*([^)]*?)\)?\s*$"
NOTE_SPACE = r"(?i)^T\s*(\d+)\s*([^@]*?)@\s*(\d+)"
NOTE_MARK = r"^[A-Z][0-9]?$"
NOTE_DIA = r"(?i)^T\s*(\d+)\s*([A-Za-z ]*)$"
NOTE_AT = r"@\s*(\d+)"


def note(text: Column) -> Column:
    """struct kind (qty, space, mark, dia), qty, dia, spacing, qual of a label; null where it is no note, empty or null."""
    t = squeeze(F.regexp_replace(text, r"\\P", " "))
    number = lambda pattern, i, of=t: F.nullif(F.regexp_extract(of, pattern, i), F.lit("")).cast("int")
    rest = F.regexp_extract(t, NOTE_QTY, 3)
    kind = F.when(t.rlike(NOTE_QTY), "qty").when(t.rlike(NOTE_SPACE), "space").when(t.rlike(NOTE_MARK), "mark").when(t.rlike(NOTE_DIA), "dia")
    pick = lambda **c: F.coalesce(*[F.when(kind == k, v) for k, v in c.items()])
    return F.when(kind.isNotNull(), F.struct(
        kind.alias("kind"),
        pick(qty=number(NOTE_QTY, 1)).alias("qty"),
        pick(qty=number(NOTE_QTY, 2), space=number(NOTE_SPACE, 1), dia=number(NOTE_DIA, 1)).alias("dia"),
        pick(qty=number(NOTE_AT, 1, rest), space=number(NOTE_SPACE, 3)).alias("spacing"),
        pick(qty=qualifiers(rest), space=qualifiers(F.regexp_extract(t, NOTE_SPACE, 2)), dia=qualifiers(F.regexp_extract(t, NOTE_DIA, 2))).alias("qual"),
    ))


#: Classes of drawing texts, the first that holds; "@" counts only beside a diameter.
COUNT_TEXT = r"(\d+)\s*-\s*T(\d+)"
PITCH_TEXT = r"(?i)T(\d+)\s*(?:[A-Z ]*)?@\s*(\d+)"


def text_class(text: Column) -> Column:
    """One of seven classes of a drawing text; null text is null."""
    up = F.upper(text)
    return (
        F.when(text.rlike(COUNT_TEXT), "count").when(text.rlike(PITCH_TEXT) | (text.contains("@") & up.rlike(r"T\d+")), "pitch")
        .when(up.contains("UBAR") | up.contains("U-BAR") | up.contains("U BAR"), "u-bar").when(up.contains("TIE"), "tie")
        .when(text.rlike(r"^[\d.]+$"), "dimension").when(up.rlike(r"\bN\d+\b"), "insert").when(text.isNotNull(), "other")
    )


def pad_row(row: Column, width: int) -> Column:
    """A ragged row cut or filled with empty strings to ``width`` cells."""
    return F.slice(F.concat(row, F.array_repeat(F.lit(""), width)), 1, width)


#: Tags of older sheets, count callouts, diameters, rows of a printed tally.
TAG_NOTE = r"^-\((\d+)\)\s*-?\(?\s*T(\d+)(.*?)\)?$"
COUNT_ANYWHERE = r"\(?(\d+)\)?\s*-\s*\(?T(\d+)\)?\b"
ANY_DIA = r"\bT(\d+)\b"
TALLY_LINE = r"^T(\d+)\s+([\d.]+)k\s+([\d.]+)k\s+([+\-][\d.]+)k\s+(\d+%|extra|-)\s*$"


def tag_kind(text: Column) -> Column:
    """note, mark, spacing or none."""
    t = squeeze(text)
    return F.when(t.rlike(TAG_NOTE), "note").when(t.rlike("^[A-Z][0-9]?$"), "mark").when(t.rlike(r"^T\d+"), "spacing").otherwise("none")


def tag_quantity(text: Column) -> Column:
    """The quantity of a note; null for other tags."""
    return F.regexp_extract(squeeze(text), TAG_NOTE, 1).try_cast("long")


def count_callout(text: Column) -> Column:
    """n and dia of the first count callout anywhere in a text; nulls without one."""
    return F.struct(*[F.regexp_extract(text, COUNT_ANYWHERE, i).try_cast("int").alias(k) for i, k in ((1, "n"), (2, "dia"))])


def diameters(text: Column) -> Column:
    """Sorted distinct diameters named in a text."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(ANY_DIA), F.lit(1)), lambda x: x.try_cast("int"))))


def tally_line(line: Column) -> Column:
    """dia, recon, official, pct of a tally's row; null dia for other lines."""
    kinds = {1: ("dia", "int"), 2: ("recon", "double"), 3: ("official", "double"), 5: ("pct", "string")}
    return F.struct(*[F.regexp_extract(line, TALLY_LINE, i).try_cast(kind).alias(k) for i, (k, kind) in kinds.items()])


#: Headers of schedule tables (pattern on the squeezed lower-case text, name), the first that holds.
HEADERS = [
    ("^(schedule )?mark$", "Schedule Mark"),
    ("diameter", "Bar Diameter"),
    ("^shape$", "Shape"),
    ("total|^length$", "Total Bar Length"),
    ("bar length", "Bar Length"),
    (r"quantity|^no\.$", "Quantity"),
    ("weight", "Weight"),
]


def column_head(text: Column) -> Column:
    """The canonical name of a table's column header: letters a to h are segments; an unknown one stays in lower case."""
    named = lambda t: F.coalesce(*[F.when(t.rlike(pattern), F.lit(name)) for pattern, name in HEADERS], F.when(t.rlike("^[a-h]$"), F.upper(t)), t)
    return F.transform(F.array(F.lower(squeeze(text))), named)[0]  # squeezed once


#: Names of anchor blocks. Capacity (with _ for the point), embedded length, id and view of a spread
#: anchor; two diameters, id and view of a lifting insert.
SPREAD_ANCHOR = r"(?i)^RR spread anchor face based - RR-SA-([\d_]+)-(\d+)-([^-]+)-(.+)$"
LIFTING_INSERT = r"(?i)^([\d_]+)Ø_?\s*Lifting Insert_COLUMN - ([\d_]+)Ø\s*Lifting insert-([^-]+)-(.+)$"
#: Kinds of cast-in blocks by words of their name, the first that holds; for models, and for drawings.
BLOCK_KINDS = [("corbel", "corbel"), ("wire loop", "loop"), ("loopbox", "loop"), ("spread anchor", "anchor"), ("rr-sa", "anchor"), ("stiffener", "embed"), ("channel", "embed")]
CASTIN_KINDS = [("corbel", "corbel"), ("anchor", "anchor"), ("loopbox", "anchor"), ("stiffener", "channel"), ("channel", "channel")]


def anchor_block(name: Column) -> Column:
    """struct<family, capacity_t, embed_length_mm, type_key, ref_id, view_suffix> of an anchor block's name.

    A name of neither form is of the family ``unknown``, keyed by its first 40 signs; a null one too, with a null key.
    """
    part = lambda pattern, i: F.regexp_extract(name, pattern, i)
    none = lambda kind: F.lit(None).cast(kind)
    fields = ("family", "capacity_t", "embed_length_mm", "type_key", "ref_id", "view_suffix")

    def told(*values: Column) -> Column:
        return F.struct(*[v.alias(n) for v, n in zip(values, fields)])

    spread = told(F.lit("RR-SA"), F.regexp_replace(part(SPREAD_ANCHOR, 1), "_", ".").try_cast("double"), part(SPREAD_ANCHOR, 2).try_cast("int"), F.concat_ws("-", F.lit("RR-SA"), part(SPREAD_ANCHOR, 1), part(SPREAD_ANCHOR, 2)), part(SPREAD_ANCHOR, 3), part(SPREAD_ANCHOR, 4))
    lift = told(F.lit("lifting_insert"), none("double"), none("int"), F.concat(F.lit("LIFT-"), part(LIFTING_INSERT, 2)), part(LIFTING_INSERT, 3), part(LIFTING_INSERT, 4))
    other = told(F.lit("unknown"), none("double"), none("int"), F.concat(F.lit("UNKNOWN:"), F.substring(name, 1, 40)), none("string"), none("string"))
    return F.when(name.rlike(SPREAD_ANCHOR), spread).when(name.rlike(LIFTING_INSERT), lift).otherwise(other)


def block_kind(name: Column, kinds: list[tuple[str, str]] = BLOCK_KINDS, other: str | None = None) -> Column:
    """The kind of the first word that a block's name holds, in any case; ``other`` without one."""
    low = F.lower(name)
    return F.coalesce(*[F.when(low.contains(word), kind) for word, kind in kinds], F.lit(other).cast("string"))


#: Fixed value: a note that names the element whose reinforcement holds here.
REINFORCED_AS = r"(?i)REINFORCEMENT\s+DETAILS?\s*(?:REFER|SEE)?\s*[:\-]?\s*([A-Z]{2}-[A-Z0-9\-]+)"


def reinforced_as(text: Column) -> Column:
    """The element that the first such note of a text, white space squeezed, names; null without one."""
    return F.nullif(F.regexp_extract(F.regexp_replace(text, r"\s+", " "), REINFORCED_AS, 1), F.lit(""))
