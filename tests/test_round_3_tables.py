"""Schedule tables parsed back from cells that are dealt once."""

import random
import re

from plumbline.functions import text
from plumbline.operators import tables as parsers
from plumbline.plans import parsing_queries

SF = "/root/testdata/sf0.001"
COLUMNS = "sheet string, y double, x double, txt string"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_sheet_is_dealt_once(spark):
    cells = spark.createDataFrame([("s", 1.0, 1.0, "Rebar schedule for P(R)")] * 2, COLUMNS)
    for out in (parsers.parse_tables(cells, "sheet"), parsers.parse_summaries(cells, "sheet")):
        assert _plan(out).count("Exchange") == 1 and "Join" not in _plan(out)
    assert all(_plan(parsing_queries.QUERIES[q](spark, SF)).count("Exchange") == 1 for q in ("schedule_rows", "schedule_summaries"))


def test_cells_are_drawn_as_their_sql_says(spark):
    drawn = parsing_queries._cells(spark, SF)
    told = spark.sql(parsing_queries.CELLS).selectExpr("sheet", "cast(y as double) y", "cast(x as double) x", "txt")
    assert drawn.count() == told.count() > 50_000
    assert drawn.exceptAll(told).count() == told.exceptAll(drawn).count() == 0


def _low(v):
    return (v is not None, v if v is not None else 0)


def _by_loops(cells, revised=True):
    """Tables of one sheet, cell by cell."""
    marks = revised and [x for _, x, t in cells if t is not None and t.strip(" ") in parsers.REVISION_LABELS and x is not None]
    if marks:
        cells = [c for c in cells if c[1] is None or not min(marks) - 5 <= c[1] <= max(marks) + 5]
    blocks, out = [], []
    for y, x, t in sorted(cells, key=lambda c: (c[0] is None, -(c[0] or 0), _low(c[1]), _low(c[2]))):
        title = re.search(parsers.TABLE_TITLE, t or "")
        if title or any(s in (t or "") for s in (parsers.SUMMARY_TITLE, parsers.REVISION_TITLE)):
            blocks.append((title, []))
        elif blocks:
            blocks[-1][1].append((y, x, t if t is None else t.strip(" ")))
    for title, body in blocks:
        rows, last = [], None
        for y, x, t in sorted(body, key=lambda c: (c[0] is not None, -(c[0] or 0))) if title else ():
            if not rows or (y is not None and last is not None and last - y > 2):
                rows.append([])
            last = y
            rows[-1].append((x, t))
        first = next((i for i, r in enumerate(rows) if any(re.search(parsers.DATA_CELL, t or "") for _, t in r)), 0)
        head = [(x, t) for r in rows[:first] for x, t in sorted(r, key=lambda c: (_low(c[0]), _low(c[1]))) if x is not None and t is not None]
        base = sorted({x for x, _ in rows[first - 1] if x is not None}) if first else []
        name = lambda t: next((n for p, n in text.HEADERS if re.search(p, t)), t.upper() if t in set("abcdefgh") else t)
        cols = [(b, name(" ".join(" ".join(t for x, t in head if abs(x - b) <= 12).split()).lower())) for b in base]
        for i, r in enumerate(rows[first:], first):
            got = {}
            for x, t in sorted(r, key=lambda c: (_low(c[0]), _low(c[1]))):
                near = min(((abs(x - b), b, c) for b, c in cols if abs(x - b) <= 12), default=None) if x is not None else None
                if near:
                    got.setdefault(near[2], t)
            if got.get("Schedule Mark") is not None:
                out.append((title[1], title[2], i, got))
    return out


def test_tables_as_by_loops(spark):
    """Sheets with headers of two lines, several tables, places that repeat or are equally near two columns, nulls."""
    rng = random.Random(7)
    rows = []
    for s in [*map(str, range(60)), None]:
        y = 1000.0
        for _ in range(rng.randrange(1, 4)):
            rows.append((s, y, 5.0, rng.choice(["Rebar schedule for PW-%d(R)" % rng.randrange(9), "Rebar schedule for Q(Sub)", "Summary Schedule", "REVISION SCHEDULE", "no title"])))
            head = [(10.0, "Mark"), (60.0, "Diameter"), (84.0, "Quantity"), (110.0, "a"), (rng.choice([10.0, 140.0, 150.0]), rng.choice(["Mark", "Other"]))]
            rows += [(s, y - 10, 61.0, "Bar")] * rng.randrange(2) + [(s, y - 15 + rng.choice([0, 1]), x, t) for x, t in head if rng.random() < 0.9]
            for i in range(rng.randrange(5)):
                at = y - 22 - rng.choice([6, 2.5, 2]) * i
                rows += [(s, at + rng.choice([0, 0.5]), x + rng.choice([0, 3, 12, -12, 13]), t) for x, t in [(10.0, f"K{i}"), (10.0, "K"), (60.0, f"{i} mm"), (72.0, "7"), (84.0, "12 kg")] if rng.random() < 0.8]
            y -= 100
        rows += [(s, rng.choice([None, 950.0]), rng.choice([None, 10.0, 60.0]), rng.choice([None, " K9 ", "5 mm"])) for _ in range(rng.randrange(4))]
        if rng.random() < 0.4:
            rows += [(s, 990.0, 300.0, "Rev"), (s, 990.0, rng.choice([85.0, 330.0]), " Date "), (s, 970.0, 310.0, "9 mm")]
    want = {s: _by_loops([r[1:] for r in rows if r[0] == s], s is not None) for s in {r[0] for r in rows}}  # labels of no sheet hide nothing
    got = {}
    for r in parsers.parse_tables(spark.createDataFrame(rows, COLUMNS), "sheet").collect():
        got.setdefault(r.sheet, []).append((r.panel, r.sub, r.row, r.cells))
    order = lambda t: (t[2], repr(sorted(t[3].items(), key=str)), t[0])
    assert {s: sorted(t, key=order) for s, t in got.items()} == {s: sorted(t, key=order) for s, t in want.items() if t}
    assert sum(map(len, want.values())) > 40
