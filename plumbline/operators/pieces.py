"""Drawn pieces: point clusters, leader ends, bends from arcs, chains, twin bars, runs across gaps, words to cells.

The greedy rules depend on the order of rows inside a key (a view or an element), so a worker passes through rows
sorted by ``id``, key by key; a grid keeps each look-up to the cells that the tolerance reaches.
"""

from __future__ import annotations

from collections import defaultdict
from heapq import nsmallest
from itertools import product
from math import dist, floor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship
from .dealing import in_groups, in_tables
from .joins import PAIRS, boxes_and_points


class _Grid:
    """Rows by the cell of a point; ``near`` gives those of the cells that ``tol`` around a point reaches, two an axis."""

    def __init__(self, tol: float):
        self.reach = tol * (1 + 1e-6)  # what rounding adds to a distance
        self.size, self.held = 2.5 * self.reach, {}

    def _cell(self, p) -> tuple:
        return tuple([floor(c / self.size + 0.5) for c in p])

    def put(self, p, row: int) -> None:
        self.held.setdefault(self._cell(p), set()).add(row)

    def take(self, p, row: int) -> None:
        self.held.get(self._cell(p), set()).discard(row)

    def near(self, *points) -> set[int]:
        found: set[int] = set()
        for p in points:
            spans = []
            for c in p:
                low, high = floor((c - self.reach) / self.size + 0.5), floor((c + self.reach) / self.size + 0.5)
                spans.append((low,) if low == high else (low, high))
            for cell in product(*spans):
                rows = self.held.get(cell)
                if rows:
                    found |= rows
        return found


def _by_key(df: DataFrame, keys: list[str], columns: list[str], ddl: str, fn, order: list[str] | None = None) -> DataFrame:
    """Rows that ``fn`` gives for the tuples of ``columns`` of each key, by id or ``order``."""
    kinds, n = dict(df.dtypes), len(keys)

    def run(rows: list[tuple]) -> list[tuple]:
        head = rows[0][:n]
        return [(*head, *r) for r in fn([r[n:] for r in rows])]

    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], ddl.format(**kinds)])
    return in_groups(df.select(*keys, *columns), keys, order or ["id"], run, schema)


def seed_clusters(points: DataFrame, keys: list[str], tol: float = 60.0) -> DataFrame:
    """(keys, id, seed): a free point takes all later free points within ``tol`` of it in x and in y."""

    def run(rows: list[tuple]) -> list[tuple]:
        grid, seed = _Grid(tol), {}
        for i, (_, x, y) in enumerate(rows):
            grid.put((x, y), i)
        for i, (own, x, y) in enumerate(rows):
            if i in seed:
                continue
            for j in grid.near((x, y)):
                if abs(rows[j][1] - x) <= tol and abs(rows[j][2] - y) <= tol:
                    seed[j] = own
                    grid.take(rows[j][1:], j)
        return [(r[0], seed[i]) for i, r in enumerate(rows)]

    return _by_key(points, keys, ["id", "x", "y"], "id {id}, seed {id}", run)


def hull(points: list[tuple]) -> list[tuple]:
    """Corners of the convex hull of (x, y, id) points, and points that rounding cannot tell from its edges; of points at one
    place the two of least id."""
    kept: list[tuple] = []
    for p in sorted(points):
        if len(kept) < 2 or p[:2] != kept[-1][:2] or p[:2] != kept[-2][:2]:
            kept.append(p)
    if len(kept) < 4:
        return kept
    size = max(abs(c) for p in kept for c in p[:2]) or 1.0

    def half(rows: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) < -1e-9 * size * size:
                out.pop()
            out.append(p)
        return out

    return sorted(set(half(kept)) | set(half(kept[::-1])))


def farthest_pair(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id_a, id_b, d): the two points of a component farthest apart, ties to the smaller ids; a single point has none.

    Only corners of a component's hull can be ends of its longest distance: each task keeps its rows' corners before
    the exchange, a component keeps those of all, and only they meet in pairs. Null coordinates take no part.
    """
    kinds = dict(points.dtypes)
    ddl = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], f"id {kinds['id']}, x double, y double"])
    columns = [*keys, "id", "x", "y"]
    known = points.dropna(subset=["id", "x", "y"]).select(*keys, "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))

    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for key, part in pdf.groupby(keys, dropna=False, sort=False) if keys else [((), pdf)]:
            found = hull(list(zip(part["x"].tolist(), part["y"].tolist(), part["id"].tolist())))
            rows += [(*(key if isinstance(key, tuple) else (key,)), i, x, y) for x, y, i in found]
        return pd.DataFrame(rows, columns=columns)

    ship(points.sparkSession)
    few = known.mapInPandas(lambda parts: (corners(p) for p in parts), ddl)
    few = few.groupBy(*keys).applyInPandas(lambda pdf: corners(pdf), ddl)
    a = few.select(*keys, F.col("id").alias("id_a"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    b = few.select(*keys, F.col("id").alias("id_b"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    d = F.sqrt((F.col("xa") - F.col("xb")) ** 2 + (F.col("ya") - F.col("yb")) ** 2)
    best = a.join(b, keys).filter("id_a < id_b").groupBy(*keys).agg(F.min(F.struct((-d).alias("m"), "id_a", "id_b")).alias("p"))
    return best.select(*keys, "p.id_a", "p.id_b", (-F.col("p.m")).alias("d"))


def concentric_pairs(arcs: DataFrame, keys: list[str], centre: float = 2.0, low: float = 5.0, high: float = 34.0, turn: float = 15.0) -> DataFrame:
    """(keys, id_a, id_b, dia, radius): an arc takes the first later free arc about the same centre whose radius differs by a
    diameter and whose start angle agrees. Arcs (id, cx, cy, r, a0); radii of at most 1 take no part."""

    def run(rows: list[tuple]) -> list[tuple]:
        grid, used, out = _Grid(centre), set(), []
        for i, r in enumerate(rows):
            grid.put(r[1:3], i)
        for i, (own, x, y, r, a0) in enumerate(rows):
            for j in sorted(grid.near((x, y))) if i not in used else []:
                other = rows[j]
                off = (a0 - other[4]) % 360
                if j > i and j not in used and dist((x, y), other[1:3]) <= centre and low <= abs(r - other[3]) <= high and not turn < off < 360 - turn:
                    used |= {i, j}
                    out.append((own, other[0], abs(r - other[3]), (r + other[3]) / 2))
                    break
        return out

    return _by_key(arcs.filter("r > 1"), keys, ["id", "cx", "cy", "r", "a0"], "id_a {id}, id_b {id}, dia double, radius double", run)


def chain_pieces(pieces: DataFrame, keys: list[str], tol: float = 4.0, dia_tol: float = 1.9) -> DataFrame:
    """(keys, seed, ids, length, dia): pieces whose ends meet join the seed's chain at its tail or head while their diameter is
    near the seed's; dia is the mean by length. Pieces (id, x0, y0, x1, y1, dia) are looked at in rounds, by id."""

    def run(pieces_: list[tuple]) -> list[tuple]:
        rows = {r[0]: r[1:] for r in pieces_}
        order, dias = list(rows), [r[4] for r in rows.values()]
        ends = [p for r in rows.values() for p in (r[:2], r[2:4])]  # those of piece j are 2 j and 2 j + 1
        grid, free, out = _Grid(tol), set(range(len(order))), []
        for e, p in enumerate(ends):
            grid.put(p, e)

        def use(i: int) -> None:
            free.discard(i)
            grid.take(ends[2 * i], 2 * i)
            grid.take(ends[2 * i + 1], 2 * i + 1)

        def meeting(p: tuple, dia: float) -> set[int]:
            return {e >> 1 for e in grid.near(p) if abs(dias[e >> 1] - dia) <= dia_tol and dist(p, ends[e]) <= tol}

        for i, k in enumerate(order):
            if i not in free:
                continue
            use(i)
            head, tail, dia, chain, at = ends[2 * i], ends[2 * i + 1], dias[i], [i], -1
            before, behind = meeting(head, dia), meeting(tail, dia)
            while before or behind:
                # on through the ids, then from the first again
                at = min((j for fits in (before, behind) for j in fits if j > at), default=None)
                if at is None:
                    at = min(j for fits in (before, behind) for j in fits)
                a, b = ends[2 * at], ends[2 * at + 1]
                use(at)
                if dist(tail, a) <= tol:
                    tail, moved = b, True
                elif dist(tail, b) <= tol:
                    tail, moved = a, True
                elif dist(head, b) <= tol:
                    head, moved = a, False
                else:
                    head, moved = b, False
                before, behind = (before - {at}, meeting(tail, dia)) if moved else (meeting(head, dia), behind - {at})
                chain.append(at)
            size = [dist(ends[2 * j], ends[2 * j + 1]) for j in chain]
            total = sum(size)
            out.append((k, [order[j] for j in chain], total, sum(dias[j] * n for j, n in zip(chain, size)) / total if total else dia))
        return out

    return _by_key(pieces, keys, ["id", "x0", "y0", "x1", "y1", "dia"], "seed {id}, ids array<{id}>, length double, dia double", run)


def near_twins(bars: DataFrame, keys: list[str], tol: float = 6.0, rel: float = 0.05) -> DataFrame:
    """(keys, id, kept): a bar goes if both its ends lie within ``tol`` of an earlier kept bar's, either way round, and the
    lengths differ by less than ``rel``. Keys hold kind and diameter; bars (id, x0, y0, z0, x1, y1, z1, length)."""

    def run(rows: list[tuple]) -> list[tuple]:
        grid, kept, out = _Grid(tol), {}, []
        for i, (own, *ends, n) in enumerate(rows):
            a, b = tuple(ends[:3]), tuple(ends[3:])
            # ends within tol, either way round, leave the middles within tol
            middle = tuple([(u + v) / 2 for u, v in zip(a, b)])
            twin = any(
                m and abs(n - m) / m < rel and (dist(a, p) < tol and dist(b, q) < tol or dist(a, q) < tol and dist(b, p) < tol)
                for p, q, m in map(kept.__getitem__, grid.near(middle))
            )
            if not twin:
                kept[i] = (a, b, n)
                grid.put(middle, i)
            out.append((own, not twin))
        return out

    return _by_key(bars, keys, ["id", "x0", "y0", "z0", "x1", "y1", "z1", "length"], "id {id}, kept boolean", run)


#: How far lengths, pitches and gaps may differ, absolutely and relatively; twins; gaps without a pitch; leg tolerances.
LIKE_LENGTH, LIKE_PITCH, LIKE_GAP, TWIN, OPEN_GAP = (25.0, 0.06), (10.0, 0.2), (12.0, 0.25), 3.0, 400.0
LEG = (30.0, 0.06)


class _Chain:
    """Runs that one chain has taken so far."""

    __slots__ = ("seed", "length", "reach", "pitch", "low", "hi", "places")

    def __init__(self, seed, length: float, low: float):
        self.seed, self.length, self.pitch, self.low, self.hi, self.places = seed, length, None, low, float("-inf"), []
        self.reach = max(LIKE_LENGTH[0], LIKE_LENGTH[1] * length)

    def accepts(self, lo: float, length: float, pitch: float | None) -> bool:
        if abs(length - self.length) > self.reach:
            return False
        known = self.pitch
        if known is None:
            known = pitch
        elif pitch is not None and abs(pitch - known) > max(LIKE_PITCH[0], LIKE_PITCH[1] * known):
            return False
        gap = abs(lo - self.hi)
        if not known:
            return gap <= OPEN_GAP
        return abs(gap - max(round(gap / known), 1) * known) <= max(LIKE_GAP[0], LIKE_GAP[1] * known)

    def take(self, hi: float, pitch: float | None, places) -> None:
        self.places.extend(places)
        self.hi = max(self.hi, hi)
        if self.pitch is None:
            self.pitch = pitch
        if self.pitch is None:
            bars = self.bars()
            if len(bars) > 1:
                self.pitch = min(b - a for a, b in zip(bars, bars[1:]))

    def bars(self) -> list[float]:
        """Places without those at most TWIN beyond the last kept one."""
        kept: list[float] = []
        for at in sorted(self.places):
            if not kept or at > kept[-1] + TWIN:
                kept.append(at)
        return kept


def bridge_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seed, n, lo, hi, pitch): chains of runs across whole multiples of their pitch, found in one sweep from low to high.

    A run joins the oldest chain whose length and pitch are like its own and whose end lies a whole number of pitches away (or
    near, where no pitch is known); else it begins one. Chains are looked up by cells of length. Keys hold diameter and
    axis; runs (id, lo, hi, length, pitch or null, places array). A chain without a pitch takes the smallest step of its bars.
    """
    cell = 100.0

    def run(rows: list[tuple]) -> list[tuple]:
        chains: list[_Chain] = []
        by_length: dict[int, list[_Chain]] = defaultdict(list)
        for own, lo, hi, length, pitch, places in rows:
            chain = next((c for c in by_length[floor(length / cell)] if c.accepts(lo, length, pitch)), None)
            if chain is None:
                chain = _Chain(own, length, lo)
                for i in range(floor((length - chain.reach) / cell), floor((length + chain.reach) / cell) + 1):
                    by_length[i].append(chain)
                chains.append(chain)
            chain.take(hi, pitch, places)
        return [(c.seed, len(c.bars()), round(c.low, 1), round(c.hi, 1), c.pitch) for c in chains]

    known = runs.select(*keys, "id", *[F.col(c).cast("double").alias(c) for c in ("lo", "hi", "length")], F.nanvl(F.col("pitch").cast("double"), F.lit(None)).alias("pitch"), F.col("places").cast("array<double>").alias("places"))
    return _by_key(known, keys, ["id", "lo", "hi", "length", "pitch", "places"], "seed {id}, n long, lo double, hi double, pitch double", run, ["lo", "id"])


def elevation_match(marks: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mark, family, taken): marks by length falling take up to qty runs of a family whose length is like theirs or like a leg's.

    Horizontal runs are dealt out first; vertical ones go to marks that got none. A family's lengths are sorted once, a mark's
    tolerances are bands in them, and of the free runs in its bands the lowest by (z, x, id) are taken. Keys hold the diameter; marks
    (mark, qty, length, legs array or null), runs (id, family h or v, length, z, x). Marks without a run are absent.
    """
    kinds = dict(marks.dtypes) | {"id": dict(runs.dtypes)["id"]}

    def deal(wanted: list, pool: pd.DataFrame) -> dict:
        """Which runs each mark takes from one family."""
        place = {i: n for n, i in enumerate(pool.sort_values(["z", "x", "id"])["id"])}
        lengths = pool.sort_values(["length", "id"])
        ids, values, gone, out = lengths["id"].tolist(), lengths["length"].to_numpy(float), set(), {}
        for row in wanted:
            legs = row.legs if row.legs is not None else []
            bands = [(t - max(LEG[0], LEG[1] * t), t + max(LEG[0], LEG[1] * t)) for t in {float(row.length), *(float(x) for x in legs if x)}]
            spans = [range(*np.searchsorted(values, (lo, hi), side="left").tolist()) for lo, hi in ((a, np.nextafter(b, np.inf)) for a, b in bands)]
            free = {ids[j] for span in spans for j in span} - gone
            chosen = nsmallest(int(row.qty), free, key=place.__getitem__)
            if chosen:
                out[row.mark] = chosen
                gone.update(chosen)
        return out

    def run(m: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(m) or not len(r):
            return pd.DataFrame([], columns=[*keys, "mark", "family", "taken"])
        wanted = list(m.sort_values(["length", "mark"], ascending=[False, True]).itertuples(index=False))
        flat = deal(wanted, r[r["family"] == "h"])
        upright = deal([x for x in wanted if x.mark not in flat], r[r["family"] == "v"])
        own = [getattr(wanted[0], k) for k in keys]
        rows = [(*own, mark, family, taken) for family, got in (("h", flat), ("v", upright)) for mark, taken in got.items()]
        return pd.DataFrame(rows, columns=[*keys, "mark", "family", "taken"])

    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], f"mark {kinds['mark']}", "family string", f"taken array<{kinds['id']}>"])
    ship(marks.sparkSession)
    return marks.groupBy(*keys).cogroup(runs.groupBy(*keys)).applyInPandas(run, schema)


def word_cells(words: DataFrame, keys: list[str], line: float = 3.0, gap: float = 6.0) -> DataFrame:
    """(keys, line_no, cell_no, x, end, t): words (id, x0, x1, y, t) on one line at most ``gap`` apart are a cell.

    Lines are single-link groups of y; a word belongs to the line of nearest mean. x is folded word by word, half and half.
    """
    up = Window.partitionBy(*keys).orderBy("y")
    ys = words.select(*keys, "y").withColumn("new", F.when(F.col("y") - F.lag("y").over(up) > line, 1).otherwise(0)).withColumn("line_no", F.sum("new").over(up))
    means = ys.groupBy(*keys, "line_no").agg(F.avg("y").alias("mean"))
    beside = Window.partitionBy(*keys).orderBy("line_no")
    means = means.withColumn("below", F.lag("mean").over(beside)).withColumn("above", F.lead("mean").over(beside))
    own = ys.select(*keys, "y", "line_no").distinct().join(means, [*keys, "line_no"])
    off = [F.struct(F.abs(F.col("y") - F.col(c)).alias("d"), (F.col("line_no") + i).alias("n")) for c, i in (("below", -1), ("mean", 0), ("above", 1))]
    best = F.array_min(F.filter(F.array(*off), lambda s: s.d.isNotNull()))
    placed = words.join(own.select(*keys, "y", best["n"].alias("line_no")), [*keys, "y"])
    along = Window.partitionBy(*keys, "line_no").orderBy("x0", "id")
    reach = F.max("x1").over(along.rowsBetween(Window.unboundedPreceding, -1))
    cut = placed.withColumn("new", F.when(F.col("x0") - reach > gap, 1).otherwise(0)).withColumn("cell_no", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    packed = cut.groupBy(*keys, "line_no", "cell_no").agg(F.sort_array(F.collect_list(F.struct("x0", "id", ((F.col("x0") + F.col("x1")) / 2).alias("x"), "t"))).alias("w"), F.max("x1").alias("end"))
    x = F.aggregate(F.slice("w", 2, F.size("w")), F.element_at("w", 1)["x"], lambda acc, s: (acc + s.x) / 2)
    return packed.select(*keys, "line_no", "cell_no", x.alias("x"), "end", F.array_join(F.transform("w", lambda s: s.t), " ").alias("t"))


def viewport_titles(views: DataFrame, texts: DataFrame, keys: list[str], pad: float = 1.30) -> DataFrame:
    """(keys, view, scale, wx0, wy0, wx1, wy1, title): a viewport's model window, and the text nearest to the middle of its lower
    edge within the padded frame (a quarter of its height further down; none: empty).

    Views (view, cx, cy, w, h, vx, vy, vh); texts (tx, ty, s). Views with the same frame ask once, texts of one place answer once (the
    least), and both meet by cells of the frame's level, which go through a worker: no pairs are sorted or stored.
    """
    w = F.when(F.col("h") != 0, F.col("vh") * F.col("w") / F.col("h")).otherwise(0.0)
    window = views.select(*keys, "view", "cx", "cy", "w", "h", F.when(F.col("h") != 0, F.col("vh") / F.col("h")).otherwise(0.0).alias("scale"), *[F.when(F.col("h") != 0, e).alias(n) for e, n in ((F.col("vx") - w / 2, "wx0"), (F.col("vy") - F.col("vh") / 2, "wy0"), (F.col("vx") + w / 2, "wx1"), (F.col("vy") + F.col("vh") / 2, "wy1"))])
    frame, half = ["cx", "cy", "w", "h"], F.col("w") * pad / 2
    frames = window.select(*keys, *frame).distinct().withColumns({"__x0": F.col("cx") - half, "__x1": F.col("cx") + half, "__y0": F.col("cy") - F.col("h") * (pad / 2 + 0.25), "__y1": F.col("cy") + F.col("h") * pad / 2})
    places = texts.groupBy(*keys, "tx", "ty").agg(F.min("s").alias("s"))
    sides, cell = ("__x0", "__y0", "__x1", "__y1"), [*keys, "__l", "__cx", "__cy"]
    dealt, asked = boxes_and_points(frames, places, keys, sides, ("tx", "ty"))
    numbers = lambda df, names: [F.col(c).cast("double").alias(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in names]
    names = [*frame, "tx", "ty"]
    both = dealt.select(*cell, F.lit(0).alias("__s"), *numbers(dealt, names), F.lit(None).cast(dict(places.dtypes)["s"]).alias("s")).unionByName(asked.select(*cell, F.lit(1).alias("__s"), *numbers(asked, names), "s"))

    def run(rows: pa.Table) -> pa.Table | None:
        n = rows.num_rows - int(rows.column("__s").to_numpy().sum())
        if not n or n == rows.num_rows:
            return None
        cx, cy, w, h = (rows.column(c).to_numpy()[:n, None] for c in frame)
        tx, ty = (rows.column(c).to_numpy()[n:] for c in ("tx", "ty"))
        best, least = np.full(n, 0), np.full(n, np.inf)
        step = max(1, PAIRS // 4 // len(tx))
        for i in range(0, n, step):
            x, y, wide, high = (c[i : i + step] for c in (cx, cy, w, h))
            within = (np.abs(tx - x) <= wide * pad / 2) & (ty >= y - high * pad / 2 - high * 0.25) & (ty <= y + high * pad / 2)
            dx, dy = tx - x, ty - y + high / 2
            apart = np.where(within, np.sqrt(dx * dx + dy * dy), np.inf)
            best[i : i + step], least[i : i + step] = apart.argmin(axis=1), apart.min(axis=1)  # the first, so the least place
        near = np.flatnonzero(least < np.inf)
        own, other = rows.take(pa.array(near)), rows.take(pa.array(best[near] + n))
        return pa.table([*[own.column(c) for c in (*keys, *frame)], pa.array(least[near]), *[other.column(c) for c in ("tx", "ty", "s")]], [*keys, *frame, "d", "tx", "ty", "s"])

    kinds = dict(both.dtypes)
    met = in_tables(both, cell, ["__s", "tx", "ty"], run, ", ".join([f"`{c}` {kinds[c]}" for c in (*keys, *frame)] + [f"d double, tx double, ty double, s {kinds['s']}"]))
    near = met.groupBy(*keys, *frame).agg(F.min(F.struct("d", "tx", "ty", "s")).alias("m"))
    out = window.join(near, [*keys, *frame], "left")
    return out.select(*keys, "view", "scale", "wx0", "wy0", "wx1", "wy1", F.coalesce("m.s", F.lit("")).alias("title"))


def cached_vectors(images: DataFrame, cache: DataFrame, people: DataFrame) -> DataFrame:
    """(path, employee_id, name, mtime, vector, fresh): vectors of the cache hold while the file's mtime is the same; others come
    from the image's own ``found`` column, and images without one are left out. An unlisted employee is named by the id."""
    held = cache.select("path", "mtime", F.col("vector").alias("held"))
    joined = images.join(held, ["path", "mtime"], "left").join(people, "employee_id", "left")
    vector = F.coalesce("held", "found")
    return joined.filter(vector.isNotNull()).select("path", "employee_id", F.coalesce("name", "employee_id").alias("name"), "mtime", vector.alias("vector"), F.col("held").isNull().alias("fresh"))
