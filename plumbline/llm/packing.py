"""Operator 7: best-fit packing by a linear grouping scheme.

Lengths are bounded by the capacity, so their histogram is a bounded table: the plan is made on the driver
from it alone, and the rows are placed by their rank among equal lengths, in parallel.

1. Large lengths (over capacity * SMALL) are sorted and cut into GROUPS groups of equal cardinality; each
   is rounded up to its group's largest.
2. A configuration program over these few sizes is solved by column generation; its solution is rounded
   down and the rest goes first-fit decreasing into further configurations.
3. Actual documents take the places of their group, largest first, which leaves gaps of known sizes.
4. Small lengths go, largest first, into the smallest gap that takes them; a new sequence opens if none does.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import each_text, extended, map_arrow, prepare, ranked, stored, without
from .tokens import default_path, encoder

CAPACITY = 4096
GROUPS = 48
SMALL = 1 / 8


@dataclass
class Plan:
    """For length l, ranks first[i] <= r < first[i+1] of row i go to sequence seq[i] + (r - first[i] + skip[i]) // per[i]."""

    length: np.ndarray
    first: np.ndarray
    seq: np.ndarray
    per: np.ndarray
    skip: np.ndarray
    sequences: int


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Configurations (items of each size) with multiplicities that cover ``counts`` exactly."""
    k = len(sizes)
    patterns = np.diag(capacity // sizes).astype(float)
    base = patterns.copy()
    x = counts / np.diag(base)
    for _ in range(rounds):
        try:
            duals = np.linalg.solve(base.T, np.ones(k))
        except np.linalg.LinAlgError:
            break
        pattern = _knapsack(sizes, duals, capacity)
        if pattern @ duals <= 1 + 1e-7:
            break
        move = np.linalg.solve(base, pattern)
        ratio = np.full(k, np.inf)
        np.divide(x, move, out=ratio, where=move > 1e-9)
        leave = int(np.argmin(ratio))
        if not np.isfinite(ratio[leave]):
            break
        step = ratio[leave]
        x = np.maximum(x - step * move, 0)
        x[leave] = step
        base[:, leave] = pattern
    left, out = counts.astype(np.int64).copy(), []
    for j in np.argsort(-x):
        p = np.rint(base[:, j]).astype(np.int64)
        used = p > 0
        times = min(int(x[j] + 1e-6), int((left[used] // p[used]).min()) if used.any() else 0)
        if times > 0:
            out.append((p, times))
            left -= p * times
    while left.any():  # what rounding left over, first-fit decreasing
        p, room = np.zeros(k, np.int64), capacity
        for i in range(k):
            p[i] = min(left[i], room // sizes[i])
            room -= p[i] * sizes[i]
        used = p > 0
        times = int((left[used] // p[used]).min())
        out.append((p, times))
        left -= p * times
    return out


def _knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """The most valuable configuration; few items fit, so the table grows item by item."""
    best = np.zeros(capacity + 1)
    choice = []
    for _ in range(capacity // int(sizes.min())):
        new, pick = best.copy(), np.full(capacity + 1, -1)
        for i, (s, v) in enumerate(zip(sizes, values)):
            if v > 0:
                with_it = best[: capacity + 1 - s] + v
                better = with_it > new[s:] + 1e-12
                new[s:][better] = with_it[better]
                pick[s:][better] = i
        if (pick < 0).all():
            break
        choice.append(pick)
        best = new
    pattern, room = np.zeros(len(sizes)), capacity
    for pick in reversed(choice):
        if pick[room] >= 0:
            pattern[pick[room]] += 1
            room -= int(sizes[pick[room]])
    return pattern


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL) -> Plan:
    """Places for every rank of every length. ``histogram``: length to count, lengths 1 to capacity."""
    rows: list[tuple[int, int, int, int, int]] = []  # length, first rank, sequence, per, skip
    bound = int(capacity * small)
    large = sorted((n for n in histogram if n > bound and histogram[n] > 0), reverse=True)
    gaps: dict[int, list[tuple[int, int]]] = {}
    opened = 0
    if large:
        counts = np.array([histogram[n] for n in large])
        total = int(counts.sum())
        edge = np.unique(np.linspace(0, total, min(groups, total) + 1).astype(np.int64))
        ends = np.cumsum(counts)
        begins = ends - counts
        tops = np.array([large[int(np.searchsorted(ends, e, side="right"))] for e in edge[:-1]])
        sizes, which = np.unique(-tops, return_inverse=True)  # groups with the same largest length are one
        sizes = -sizes
        n_of = np.bincount(which, weights=np.diff(edge)).astype(np.int64)
        start = np.concatenate([[0], np.cumsum(n_of)[:-1]])
        used = np.zeros(len(sizes), np.int64)
        for p, times in configurations(sizes, n_of, capacity):
            cuts, spans = {0, times}, []
            for g in np.flatnonzero(p):
                a, lo = int(p[g]), int(start[g] + used[g])
                hi = lo + a * times
                used[g] += a * times
                i = int(np.searchsorted(ends, lo, side="right"))
                while i < len(large) and begins[i] < hi:
                    r0, r1 = max(lo, int(begins[i])), min(hi, int(ends[i]))
                    rows.append((large[i], r0 - int(begins[i]), opened + (r0 - lo) // a, a, (r0 - lo) % a))
                    spans.append((r0 - lo, r1 - lo, a, large[i]))
                    for at in (r0 - lo, r1 - lo):
                        cuts |= {at // a, -(-at // a)}
                    i += 1
            marks = np.array(sorted(c for c in cuts if 0 <= c <= times))
            fill = np.zeros(len(marks) - 1, np.int64)
            for q0, q1, a, length in spans:  # between two marks every sequence holds the same
                fill += length * np.clip(np.minimum(q1, (marks[:-1] + 1) * a) - np.maximum(q0, marks[:-1] * a), 0, None)
            for s, e, f in zip(marks[:-1].tolist(), marks[1:].tolist(), fill.tolist()):
                if f < capacity:
                    gaps.setdefault(capacity - f, []).append((opened + s, e - s))
            opened += times
    open_gaps = sorted(gaps)
    for n in sorted((n for n in histogram if n <= bound and histogram[n] > 0), reverse=True):
        rank, left = 0, histogram[n]
        while left:
            i = bisect_left(open_gaps, n)
            if i == len(open_gaps):
                fit = capacity // n
                full, part = divmod(left, fit)
                if full:
                    rows.append((n, rank, opened, fit, 0))
                    _add(gaps, open_gaps, capacity - fit * n, opened, full)
                    opened, rank = opened + full, rank + full * fit
                if part:
                    rows.append((n, rank, opened, part, 0))
                    _add(gaps, open_gaps, capacity - part * n, opened, 1)
                    opened += 1
                break
            gap = open_gaps[i]
            at, bins = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                open_gaps.pop(i)
            fit = gap // n if gap // n == 1 or left >= gap // n * bins else 1
            take = min(bins, left // fit)
            rows.append((n, rank, at, fit, 0))
            _add(gaps, open_gaps, gap - fit * n, at, take)
            if take < bins:
                _add(gaps, open_gaps, gap, at + take, bins - take)
            rank, left = rank + take * fit, left - take * fit
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return Plan(cols[0], cols[1], cols[2], cols[3], cols[4], opened)


def _add(gaps: dict, open_gaps: list[int], gap: int, at: int, bins: int) -> None:
    if gap > 0 and bins > 0:
        if gap not in gaps:
            gaps[gap] = []
            insort(open_gaps, gap)
        gaps[gap].append((at, bins))


def place(p: Plan, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Sequence of each (length, rank)."""
    key = p.length * (1 << 44) + p.first
    i = np.searchsorted(key, length * (1 << 44) + rank, side="right") - 1
    return p.seq[i] + (rank - p.first[i] + p.skip[i]) // p.per[i]


def pack(items: DataFrame, ids: list[str], capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL) -> DataFrame:
    """Add sequence_id and offset to rows with a ``length`` of 1 to capacity. ``ids`` name the rows' order.

    An empty table gives an empty one. Equal lengths are interchangeable, repeated rows are packed each. Columns
    named sequence_id or offset are replaced. A length that is null or outside 1 to capacity raises. Collected to
    the driver: one count for each length, so at most ``capacity`` rows at any input size.
    """
    items = without(items, "sequence_id", "offset")
    hist = {int(r["length"] or 0): int(r["n"]) for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).orderBy("length").limit(capacity + 2).collect()}
    if any(not 1 <= n <= capacity for n in hist):
        raise ValueError("a length is outside 1 to capacity")
    made = items.sparkSession.sparkContext.broadcast(plan(hist, capacity, groups, small))
    with_rank = ranked(items, ["length"], [F.col(c) for c in ids], "__rank")
    at = with_rank.columns.index("length"), with_rank.columns.index("__rank")
    schema = extended(with_rank, "sequence_id long")

    def assign(batches):
        for b in batches:
            seq = place(made.value, b.column(at[0]).to_numpy().astype(np.int64), b.column(at[1]).to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seq, pa.int64())], names=[*b.schema.names, "sequence_id"])

    placed = map_arrow(with_rank, assign, schema)
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "__rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop("__rank")


def pieces(docs: DataFrame, vocabulary: str | None = None, kind: str = "word", end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every whole text (null: empty); longer ones are cut at capacity."""
    vocabulary = vocabulary or default_path("word_bpe_49k.json")
    end = np.array([end_id], "<u4").tobytes()
    fields = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches):
        enc = encoder(vocabulary, kind)
        for b in batches:
            rows = []
            for doc, raw in zip(b.column(0).to_pylist(), enc.stream(each_text(b.column(1)))):
                raw += end
                for k, at in enumerate(range(0, len(raw), capacity * 4)):
                    part = raw[at : at + capacity * 4]
                    rows.append((doc, k, at // 4, len(part) // 4, crc32(part)))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, fields)], schema=fields)

    return map_arrow(docs.select("doc_id", "text"), cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents, tokenized and packed into sequences of at most 4096 tokens.

    Null and empty texts are the end id alone; only longer documents are cut; repeated rows are packed each; an empty
    table gives no row.
    """
    prepare(spark)
    cut = stored(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")), "pieces")
    return pack(cut, ["doc_id", "piece", "ids_crc32"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
