"""Bent bars as filleted polylines, from leg dimensions and turns, scaled to their cut length."""

from __future__ import annotations

from math import cos, pi, sin

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship

#: Slope of a crank, which the schedules do not state.
CRANK = 17.5
#: For each shape the dimension of each leg, the turn after it (left: +), how dimensions measure, whether
#: the outline closes, and the dimensions of its hook tails.
SHAPES = {
    "M_00": (["B"], [], "path", False, []),
    "M_17": (["B", "C", "D"], [90, 90], "outside", False, []),
    "M_17A": (["C", "B"], [-90], "outside", False, []),
    "26": (["A", "B", "C"], [-CRANK, CRANK], "path", False, []),
    "M_T1": (["B", "C", "D", "E"], [-90, -90, -90], "outside", True, ["A", "G"]),
    "M_T10": (["A", "B", "G"], [-135, -135], "path", False, []),
    "Rebar Shape 8": (["A", "B", "C"], [-90, 90], "outside", False, []),
    "Rebar Shape 9": (["C", "D", "E", "B", "A"], [-90, -90, -90, -90], "outside", False, []),
    "Rebar Shape 30": (["A", "B", "C", "D", "E"], [-CRANK, CRANK, CRANK, -CRANK], "path", False, []),
    "Rebar Shape 31": (["A", "B", "C", "D", "E"], [CRANK, -CRANK, -CRANK, CRANK], "path", False, []),
}
_POINT = "struct<x:double,y:double>"


#: Dimensions that shapes have.
LETTERS = sorted({c for legs, _, _, _, hooks in SHAPES.values() for c in legs + hooks})


def _radius(dia: np.ndarray, link: bool) -> np.ndarray:
    return np.where(link | (dia <= 16), 2.0 * dia, 3.5 * dia)


def _outline(spec: tuple, link: bool, dims: dict[str, np.ndarray], dia: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, y and whether a point exists, as rows of points by bars of one shape whose dimensions are all there."""
    legs, turns, mode, close, hooks = spec
    tight, r = _radius(dia, link), _radius(dia, False)
    turns = [*turns, *[0.0] * (len(legs) - len(turns))]

    def taken(turn: float) -> np.ndarray:
        a = abs(turn) * (pi / 180)
        return tight * a / 2 if mode == "path" else (tight + dia / 2) * np.tan(a / 2)

    heading, xs, ys = 0.0, [np.zeros(len(dia))], [np.zeros(len(dia))]
    for i, (leg, turn) in enumerate(zip(legs, turns)):
        run = np.maximum(dims[leg] - taken(turns[i - 1] if i else 0.0) - taken(turn), 1.0)
        x, y, bend = xs[-1] + run * cos(heading), ys[-1] + run * sin(heading), turn * (pi / 180)
        xs.append(x)
        ys.append(y)
        if turn:
            swing = heading + (pi / 2 if turn > 0 else -pi / 2)
            cx, cy, n = x + r * cos(swing), y + r * sin(swing), max(3, int(abs(turn) / 15) + 2)
            start = np.arctan2(y - cy, x - cx)
            for k in range(1, n + 1):
                xs.append(cx + r * np.cos(start + bend * k / n))
                ys.append(cy + r * np.sin(start + bend * k / n))
        heading += bend
    there = [np.ones(len(dia), bool)] * len(xs)
    if close:
        there.append(np.hypot(xs[0] - xs[-1], ys[0] - ys[-1]) > 1e-6)
        xs.append(xs[0])
        ys.append(ys[0])
    lead, before = np.arctan2(ys[1] - ys[0], xs[1] - xs[0]), np.zeros(len(dia), bool)
    for hook in hooks:
        v = dims[hook]
        a = lead + np.where(before, -1.0, 1.0) * (pi * 0.75)
        there.append(v != 0)
        before = before | (v != 0)
        xs.append(xs[0] + v * np.cos(a))
        ys.append(ys[0] + v * np.sin(a))
    return np.array(xs), np.array(ys), np.array(there)


def _measured(x: np.ndarray, y: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length along the points that exist, and their mean; added up in their order."""
    length, sx, sy, px, py = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1]), x[0], y[0]
    for u, v, t in zip(x, y, there):
        length = np.where(t, length + np.hypot(px - u, py - v), length)
        sx, sy, px, py = np.where(t, sx + u, sx), np.where(t, sy + v, sy), np.where(t, u, px), np.where(t, v, py)
    n = there.sum(axis=0)
    return length, sx / n, sy / n


def _points(parts: list[tuple], size: int) -> pa.Array:
    """One list of points a row, null where no part (rows, x, y, there) has it."""
    count = np.zeros(size, np.int64)
    for rows, _, _, there in parts:
        count[rows] = there.sum(axis=0)
    ends = np.concatenate([[0], np.cumsum(count)])
    x, y = np.empty(ends[-1]), np.empty(ends[-1])
    for rows, u, v, there in parts:
        at = ends[rows] + np.cumsum(there, axis=0) - 1
        x[at[there]], y[at[there]] = u[there], v[there]
    points = pa.StructArray.from_arrays([pa.array(x), pa.array(y)], ["x", "y"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), points, mask=pa.array(count == 0))


def _made(shape: pa.Array, dia: pa.Array, cut: pa.Array, *values: pa.Array) -> pa.Array:
    """error, pts, geo, scale and pts_exact of a batch of bars, shape by shape."""
    size = len(shape)
    names = np.array(shape.to_pylist(), object)
    number = lambda c, none: c.fill_null(none).to_numpy(zero_copy_only=False)
    dims, d, want = {c: number(v, 0.0) for c, v in zip(LETTERS, values)}, number(dia, 0.0), number(cut, 0.0)
    bare = dia.is_null().to_numpy(zero_copy_only=False)
    error = np.array([None if n in SHAPES else f"unknown shape code {'null' if n is None else n}" for n in names], object)
    geo, scale = np.full(size, np.nan), np.full(size, np.nan)
    drawn, exact = [], []
    for name, spec in SHAPES.items():
        own = names == name
        error[own & bare] = "missing diameter"
        for leg in reversed(spec[0]):
            error[own & (dims[leg] == 0)] = f"missing dimension {leg}"
        rows = np.flatnonzero(own & np.equal(error, None))
        if not len(rows):
            continue
        x, y, there = _outline(spec, name.startswith("M_T"), {c: v[rows] for c, v in dims.items()}, d[rows])
        length, mx, my = _measured(x, y, there)
        known = (want[rows] != 0) & (length > 1)
        k = np.where(known, want[rows] / np.where(known, length, 1.0), 1.0)
        geo[rows], scale[rows] = length, k
        drawn.append((rows, x, y, there))
        exact.append((rows, (x - mx) * k + mx, (y - my) * k + my, there))
    gone = ~np.equal(error, None)
    columns = {"error": pa.array(error, pa.string()), "pts": _points(drawn, size), "geo": pa.array(geo, mask=gone), "scale": pa.array(scale, mask=gone), "pts_exact": _points(exact, size)}
    return pa.StructArray.from_arrays(list(columns.values()), list(columns))


def _length(pts: Column) -> Column:
    n = F.size(pts) - 1
    return F.aggregate(F.zip_with(F.slice(pts, 1, n), F.slice(pts, 2, n), lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"])), F.lit(0.0), lambda s, d: s + d)


def bent_bar(shape: Column, dims: Column, dia: Column, cut_length: Column) -> Column:
    """struct<error, pts, geometric_mm, residual_mm, scale_applied, pts_exact> of one bar.

    dims: map<string, double> of leg dimensions. A dimension is shortened by what its bends take: half the arc on
    each side (mode path), or the set-back from the outer face (outside); a run is 1 at least. The form comes from the
    dimensions, the length from the schedule: ``pts_exact`` is scaled about the mean of its points so that its length
    is the cut length; what that absorbs is told by residual (1 place) and scale (6 places). An unknown shape, a
    dimension that is missing, null or 0, or a null diameter gives only an error; without a cut length the scale is 1.

    Bars of a batch are drawn together, shape by shape: nested expressions would be interpreted point by point.
    """
    ship(SparkSession.active())
    made = F.arrow_udf(_made, f"error string, pts array<{_POINT}>, geo double, scale double, pts_exact array<{_POINT}>")
    cut = cut_length.cast("double")
    b = made(shape, dia.cast("double"), cut, *[F.try_element_at(dims, F.lit(c)).cast("double") for c in LETTERS])
    rounded = [F.round(b["geo"], 1).alias("geometric_mm"), F.round(b["geo"] - cut, 1).alias("residual_mm"), F.round(b["scale"], 6).alias("scale_applied")]
    return F.struct(b["error"].alias("error"), b["pts"].alias("pts"), *rounded, b["pts_exact"].alias("pts_exact"))
