"""Check-in and check-out analytics: daily upserts, statuses, durations, presets, totals, identities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dealing import in_groups


def daily(events: DataFrame, who: str = "employee_id", ts: str = "event_ts", mode: str = "mode", seq: str = "seq") -> DataFrame:
    """(who, day, in_ts, out_ts): the first IN and the last OUT by arrival, not by time."""
    day = F.to_date(ts).alias("day")
    return events.groupBy(who, day).agg(F.min_by(F.when(F.col(mode) == "in", F.col(ts)), F.when(F.col(mode) == "in", F.col(seq))).alias("in_ts"), F.max_by(F.when(F.col(mode) == "out", F.col(ts)), F.when(F.col(mode) == "out", F.col(seq))).alias("out_ts"))


def status(day: Column, in_ts: Column, out_ts: Column, today: Column) -> Column:
    return F.when(in_ts.isNotNull() & out_ts.isNotNull(), "present").when(in_ts.isNotNull(), F.when(day == today, "currently-in").otherwise("missing-checkout")).otherwise("missing-checkin")


def seconds(in_ts: Column, out_ts: Column, state: Column, now: Column) -> Column:
    """Duration by status; null for missing ones, negative where the check-out is earlier."""
    def epoch(c: Column) -> Column:
        return F.unix_seconds(c.cast("timestamp"))

    return F.when(state == "present", epoch(out_ts) - epoch(in_ts)).when(state == "currently-in", epoch(now) - epoch(in_ts))


def format_duration(s: Column) -> Column:
    """Whole minutes, never below 0; hours are left out when 0."""
    m = F.floor(F.greatest(s, F.lit(0)) / 60)
    return F.when(m >= 60, F.format_string("%dh %dm", F.floor(m / 60), m % 60)).otherwise(F.format_string("%dm", m))


def preset(name: str, today: Column) -> tuple[Column, Column]:
    """First and last day of this-week, last-week, this-month or last-30."""
    week = F.date_trunc("week", today).cast("date")
    return {"this-week": (week, today), "last-week": (F.date_sub(week, 7), F.date_sub(week, 1)), "this-month": (F.trunc(today, "month"), today), "last-30": (F.date_sub(today, 29), today)}[name]


#: Rows of a block of faces and of known people, and faces that are multiplied with a block at once.
FACES, KNOWN, AT_ONCE = 8192, 4096, 512


def nearest(faces: list[tuple], known: list[tuple]) -> list[tuple]:
    """(face, distance, id): of each face (face, v) the nearest of the known (id, e), ties to the smaller id.

    Products single out who can be nearest, with a margin above their rounding; these are measured by the sum of squares,
    taken in order. A null vector or component, or another length, leaves a face's distance null; what is not finite is always measured, NaN
    being the farthest.
    """
    if not known:
        return []
    size = len(known[0][1]) if known[0][1] is not None else -1
    whole = lambda v: v is not None and len(v) == size and None not in v
    if not all(whole(e) for _, e in known):
        return [(f, None, None) for f, _ in faces]
    out = [(f, None, None) for f, v in faces if not whole(v)]
    asked = [(f, v) for f, v in faces if whole(v)]
    ids = [i for i, _ in known]
    b = np.array([e for _, e in known], float).reshape(len(known), size)
    odd = ~np.isfinite(b).all(axis=1)
    safe = np.where(odd[:, None], 0.0, b)
    square = (safe * safe).sum(axis=1)
    for start in range(0, len(asked), AT_ONCE):
        part = asked[start : start + AT_ONCE]
        a = np.array([v for _, v in part], float).reshape(len(part), size)
        with np.errstate(all="ignore"):
            own = (a * a).sum(axis=1)
            near = own[:, None] + square - 2.0 * (a @ safe.T)
            near[:, odd] = np.inf
            reach = near.min(axis=1) + 1e-9 * (own + square.max())
            fits = (near <= reach[:, None]) | odd | ~np.isfinite(reach)[:, None]
            for (f, _), v, fit in zip(part, a, fits):
                at = np.flatnonzero(fit)
                d = np.sqrt(np.cumsum((v - b[at]) ** 2, axis=1)[:, -1]) if size else np.zeros(len(at))
                best = min((bool(np.isnan(x)), float(x), ids[j]) for x, j in zip(d, at))
                out.append((f, *best[1:]))
    return out


def identify(faces: DataFrame, known: DataFrame, limit: float = 0.5) -> DataFrame:
    """(face, employee_id, distance): nearest known encoding, taken only below ``limit``.

    faces: face, v; known: employee_id, e. Every face meets every known row, so the work grows with both: each side is dealt
    out as blocks, and a task takes one block of faces and one of known rows (see ``nearest``).
    """
    n_f, n_k = (max(1, -(-df.count() // rows)) for df, rows in ((faces, FACES), (known, KNOWN)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    vector = lambda c: F.col(c).cast("array<double>").alias("vector")
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    one = faces.select(block("face", n_f).alias("f"), each(n_k).alias("k"), F.lit(1).alias("side"), "face", none(known, "employee_id"), vector("v"))
    two = known.select(each(n_f).alias("f"), block("employee_id", n_k).alias("k"), F.lit(0).alias("side"), none(faces, "face"), "employee_id", vector("e"))

    def run(rows: list[tuple]) -> list[tuple]:
        return nearest([(face, v) for _, _, side, face, _, v in rows if side], [(who, v) for _, _, side, _, who, v in rows if not side])

    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((faces, "face"), (known, "employee_id"))}
    met = in_groups(one.unionByName(two), ["f", "k"], ["side"], run, f"face {kinds['face']}, __d double, employee_id {kinds['employee_id']}")
    best = met.groupBy("face").agg(F.min(F.struct("__d", "employee_id")).alias("m"))
    return best.select("face", F.when(F.col("m.__d") < limit, F.col("m.employee_id")).alias("employee_id"), F.col("m.__d").alias("distance"))
