"""Operator 12: cheapest repair of conversations, by Dijkstra's search on a lattice that is never built.

A node is (turn index, grammar state), an edge one edit: Keep, Rerole, Delete, Insert. The queue is ordered by (cost,
audit), the audit being the edits' initials, so ties fall to the ASCII-least audit, and the search stops at the first
accepting end node that it pops. Edits determine the states, so two audits of equal cost that reach one node are never
prefixes of each other: the order of two audits stays as edits are appended.

Rows are dealt out by ranges of (conversation, turn), so a conversation of any length is spread over tasks. One that
lies within a task and has at most BLOCK rows is repaired there. Others become pieces of at most BLOCK rows: each is
searched from every state it may be entered in, a second pass joins the pieces' results along the conversation, a
third applies the chosen edits and hashes the text row by row. The hash of a conversation is one task's work, as its
definition asks, with one row in memory at a time.
"""

from __future__ import annotations

import hashlib
import heapq
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, prepare, stored

#: Rows of a conversation that one search takes, and the bytes of their texts beyond which a piece ends.
BLOCK, BLOCK_BYTES = 256, 8 << 20
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 2, 3, 2, 1

#: States of the grammar (s?(ua)+)?: at the start, after s, after u, after a.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
_NEXT = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_A, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A}
_ENDS = {START, AFTER_A}
_LEGAL = {"su", "ua", "au"}
_SPACE = b" \t\n\v\f\r"


def _turn_to(state: int) -> tuple[str, int]:
    """The one role that may follow as a user's or assistant's turn, and the state behind it."""
    return ("assistant", AFTER_A) if state == AFTER_U else ("user", AFTER_U)


def _edits(lattice: list[tuple[str, bool, bool]], i: int, state: int):
    """Edges of a node: (initial, cost, next index, next state). ``lattice``: (role initial, must go, truncated)."""
    follows = _turn_to(state)[1]
    yield "I", INSERT_COST, i, follows
    if i < len(lattice):
        initial, must_go, truncated = lattice[i]
        yield "D", DELETE_COST, i + 1, state
        if not must_go:
            extra = TRUNCATED_COST if truncated else 0
            yield "R", REROLE_COST + extra, i + 1, follows
            if (state, initial) in _NEXT:
                yield "K", KEEP_COST + extra, i + 1, _NEXT[state, initial]


def search(lattice: list[tuple[str, bool, bool]], start: int = START, stop: set[int] | None = None) -> dict[int, tuple[int, str]]:
    """Cheapest (cost, audit) to end nodes, by their state, of rows entered in ``start``.

    With ``stop`` the search ends at the first popped end node in one of these states, else when all that can be
    reached are popped.
    """
    done, found, queue = set(), {}, [(0, "", 0, start)]
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(lattice):
            found[state] = (cost, audit)
            if stop is not None and state in stop:
                return {state: (cost, audit)}
        for initial, price, j, then in _edits(lattice, i, state):
            if (j, then) not in done:
                heapq.heappush(queue, (cost + price, audit + initial, j, then))
    return found


def apply_edits(audit: str, rows, state: int = START):
    """Yield (line, state behind it) for each row that an audit keeps or inserts. ``rows``: iterator of (role, text)."""
    rows = iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = _NEXT[state, role[:1]]
        else:
            role, state = _turn_to(state)
        yield f"{role}:{text}", state


def _relation(e: str, f: str):
    """How e stands to f: -1 or 1 where they differ, else what the longer one has more, as (e's rest, f's rest)."""
    if e.startswith(f) or f.startswith(e):
        return e[len(f) :], f[len(e) :]
    return -1 if e < f else 1


class Stitcher:
    """Joins the pieces of one conversation in order; audits so far are held as choices of pieces, not as strings.

    For each pair of live states the order of their audits is kept: as -1 or 1 once they differ, else as the rest by
    which one goes on where the other ends. So a piece costs the same however long the conversation is.
    """

    def __init__(self):
        self.cost = {START: 0}
        self.order = {(START, START): ("", "")}
        self.back: list[dict[int, int]] = []

    def _compare(self, x: int, e: str, y: int, f: str):
        before = self.order[x, y]
        return before if isinstance(before, int) else _relation(before[0] + e, before[1] + f)

    def add(self, table: dict[tuple[int, int], tuple[int, str]]) -> None:
        best: dict[int, tuple[int, int, str]] = {}  # exit -> cost, entry, audit of the piece
        for (entry, leave), (cost, audit) in sorted(table.items()):
            if entry not in self.cost:
                continue
            total, held = self.cost[entry] + cost, best.get(leave)
            if held is None or total < held[0]:
                best[leave] = (total, entry, audit)
            elif total == held[0]:
                way = self._compare(entry, audit, held[1], held[2])
                if way == -1 or (not isinstance(way, int) and way[1]):  # less, or a prefix of the other
                    best[leave] = (total, entry, audit)
        order = {(a, b): self._compare(best[a][1], best[a][2], best[b][1], best[b][2]) for a in best for b in best}
        self.cost, self.order = {s: v[0] for s, v in best.items()}, order
        self.back.append({s: v[1] for s, v in best.items()})

    def end(self) -> tuple[int, list[tuple[int, int]]]:
        """Cost, and (entry, exit) of each piece, for the best accepting state."""
        ends = [s for s in self.cost if s in _ENDS]
        last = ends[0]
        for s in ends[1:]:
            way = self.order[s, last]
            if self.cost[s] < self.cost[last] or (self.cost[s] == self.cost[last] and (way == -1 or (not isinstance(way, int) and bool(way[1])))):
                last = s
        cost, states = self.cost[last], []
        for back in reversed(self.back):
            states.append((back[last], last))
            last = back[last]
        return cost, states[::-1]


def _facts(rows: list[tuple]) -> tuple[list[tuple[str, bool, bool]], dict]:
    """What a search and a report need of (turn, role, text, first): the lattice, and counts of faults and turns."""
    lattice, n = [], {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0}
    before = turn_before = None
    for turn, role, text, first in rows:
        shown = text.encode("utf-8", "surrogatepass").rstrip(_SPACE)
        blank, duplicate = not shown, bool(shown) and not first
        truncated = not blank and not duplicate and shown[-1:] not in (b".", b"!", b"?")
        for name, has in (("blank", blank), ("duplicate", duplicate), ("truncated", truncated)):
            n[name] += has
        initial = role[:1]
        n["illegal"] += before is not None and before + initial not in _LEGAL
        n["turns"] += turn is not None and turn != turn_before
        before, turn_before = initial, turn if turn is not None else turn_before
        lattice.append((initial, blank or duplicate, truncated))
    turns = [t for t, *_ in rows if t is not None]
    n |= {"first_role": rows[0][1][:1] if rows else None, "last_role": before, "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "n": len(rows)}
    return lattice, n


_SUMMARY = [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "n")] + [("first_role", pa.string()), ("last_role", pa.string())]
_PIECES = pa.schema([("conv_id", pa.int64()), ("piece", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.string()), ("skip", pa.int64()), *_SUMMARY, ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("table", pa.list_(pa.struct([("entry", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))), ("rows", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])
_DDL = "conv_id long, piece string, turn long, role string, digest string, skip long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, n long, first_role string, last_role string, cost long, audit string, repaired_sha256 string, table array<struct<entry:int,leave:int,cost:long,audit:string>>, rows array<struct<role:string,text:string>>"
_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _solved(conv, rows: list[tuple]) -> dict:
    lattice, facts = _facts(rows)
    [(cost, audit)] = search(lattice, START, _ENDS).values()
    lines = "\n".join(line for line, _ in apply_edits(audit, ((r[1], r[2]) for r in rows)))
    return {"conv_id": conv, **facts, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(lines.encode("utf-8", "surrogatepass")).hexdigest()}


def _piece(conv, name: str, key: tuple, rows: list[tuple]) -> dict:
    lattice, facts = _facts(rows)
    table = [{"entry": e, "leave": x, "cost": c, "audit": a} for e in range(4) for x, (c, a) in search(lattice, e).items()]
    return {"conv_id": conv, "piece": name, "turn": key[0], "role": key[1], "digest": key[2], "skip": key[3], **facts, "table": table, "rows": [{"role": r[1], "text": r[2]} for r in rows]}


def _in_order(batches):
    """Rows of sorted batches as (conv_id, turn, role, text, digest, copies, first), a few at a time."""
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            yield from zip(*(part.column(i).to_pylist() for i in range(part.num_columns)))


def _cut(batches):
    """Repair whole short conversations, cut what may go on in another task, or is long, into pieces."""
    from pyspark import TaskContext

    context = TaskContext.get()
    task, out, made = f"{context.partitionId()}-{context.taskAttemptId()}", [], 0
    convs = groupby(_in_order(batches), key=lambda r: r[0])
    first_of_task, pending = True, None

    def full(rows, size):
        return len(rows) >= BLOCK or size >= BLOCK_BYTES

    def emit(record):
        out.append(record)
        return len(out) >= 256

    def flush():
        done = pa.RecordBatch.from_pylist(out, schema=_PIECES)
        out.clear()
        return done

    for conv, rows in convs:
        if pending:  # the last conversation ended in this task, so it was no longer than this
            if emit(_solved(*pending)):
                yield flush()
            pending = None
        held, size, key, whole = [], 0, None, not first_of_task
        first_of_task = False
        for _, turn, role, text, digest, copies, first in rows:
            for skip in range(copies):
                if full(held, size):
                    made, whole = made + 1, False
                    if emit(_piece(conv, f"{task}-{made}", key, held)):
                        yield flush()
                    held, size, key = [], 0, None
                key = key or (turn, role, digest, skip)
                held.append((turn, role, text, first and skip == 0))
                size += len(text)
        if whole:
            pending = (conv, held)
        else:
            made += 1
            if emit(_piece(conv, f"{task}-{made}", key or (None, "", "", 0), held)):
                yield flush()
    if pending:
        made += 1
        conv, held = pending
        turn, role = (held[0][0], held[0][1]) if held else (None, "")
        emit(_piece(conv, f"{task}-{made}", (turn, role, hashlib.sha256(held[0][2].encode("utf-8", "surrogatepass")).hexdigest() if held else "", 0), held))
    if out:
        yield flush()


_CHOICE = pa.schema([("piece", pa.string()), ("entry", pa.int32()), ("leave", pa.int32()), ("total", pa.int64())])


def _stitch(batches):
    """Choose each piece's entry and exit; batches: conv_id, piece, table, sorted."""
    for _, rows in groupby(_in_order(batches), key=lambda r: r[0]):
        joined, names = Stitcher(), []
        for _, name, table in rows:
            joined.add({(t["entry"], t["leave"]): (t["cost"], t["audit"]) for t in table})
            names.append(name)
        cost, states = joined.end()
        for at in range(0, len(names), 4096):
            part = range(at, min(at + 4096, len(names)))
            yield pa.RecordBatch.from_pylist([{"piece": names[i], "entry": states[i][0], "leave": states[i][1], "total": cost} for i in part], schema=_CHOICE)


def _finish(batches):
    """Apply the chosen audits piece by piece; a conversation's text passes as a stream."""
    report = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def wide():
        for b in batches:
            for at in range(b.num_rows):
                yield {k: v[0] for k, v in b.slice(at, 1).to_pydict().items()}

    for conv, pieces in groupby(wide(), key=lambda r: r["conv_id"]):
        sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        audits, digest, some = [], hashlib.sha256(), False
        low = high = before = None
        for p in pieces:
            for c in sums:
                sums[c] += p[c]
            if p["n"]:
                sums["illegal"] += before is not None and before + p["first_role"] not in _LEGAL
                before = p["last_role"]
            if p["low"] is not None:
                sums["turns"] -= p["low"] == high
                low, high = p["low"] if low is None else low, p["high"]
            audit = next(t["audit"] for t in p["table"] if (t["entry"], t["leave"]) == (p["entry"], p["leave"]))
            audits.append(audit)
            for line, _ in apply_edits(audit, ((r["role"], r["text"]) for r in p["rows"]), p["entry"]):
                digest.update((b"\n" if some else b"") + line.encode("utf-8", "surrogatepass"))
                some = True
            total = p["total"]
        gaps = 0 if low is None else high - low + 1 - sums["turns"]
        yield pa.RecordBatch.from_pylist([{"conv_id": conv, "gaps": gaps, **{c: sums[c] for c in ("blank", "duplicate", "truncated", "illegal")}, "cost": total, "audit": "".join(audits), "repaired_sha256": digest.hexdigest()}], schema=report)


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows after damage, equal ones as one row with their number.

    Nulls in role and text become one space, and so do nulls in the hashed ``conv_id:turn``. A row that is dropped
    stays as an empty one with no copies, so that its conversation is not lost.
    """
    blank = F.lit(" ")
    ids = [F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")]
    kind = F.pmod(F.crc32(F.concat_ws(":", *ids).cast("binary")), F.lit(20))
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    dropped = kind == 0
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.when(~dropped, F.col("turn").cast("long")).alias("turn"),
        F.when(dropped, "").when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(dropped | (kind == 1), "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(dropped, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").cast("long").alias("copies"))


def repair(rows: DataFrame) -> DataFrame:
    """Faults and the cheapest repair of each conversation of (conv_id, turn, role, text, copies), no nulls in role and text.

    Turns come in order, nulls first; rows of one turn by role, then by the sha256 of their text, copies side by side.
    Conversations without rows (no copies) have zeros, an empty audit and the hash of the empty string. An empty table
    gives no row. Null conv_ids are one conversation. Other columns are not read.
    """
    spark = prepare(rows.sparkSession)
    rows = rows.select("conv_id", "turn", "role", "text", "copies").withColumn("digest", F.sha2("text", 256))
    # the first of equal rows is found by aggregation and looked up by its place: no group of equals meets in a task
    first = rows.filter("copies > 0").groupBy(F.col("conv_id").alias("fc"), F.col("role").alias("fr"), F.col("digest").alias("fd")).agg(F.min(F.struct("turn")).alias("ft"))
    first = first.select("fc", "fr", "fd", F.col("ft.turn").alias("ft"), F.lit(True).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("fc")) & (F.col("role") == F.col("fr")) & (F.col("digest") == F.col("fd")) & F.col("turn").eqNullSafe(F.col("ft"))
    known = rows.join(first, same, "left").select("conv_id", "turn", "role", "text", "digest", "copies", F.coalesce("first", F.lit(False)).alias("first"))
    place = ["conv_id", "turn", "role", "digest"]
    dealt = known.repartitionByRange(*place).sortWithinPartitions(*place)
    cut = stored(map_arrow(dealt, _cut, _DDL), "conversations")
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns"))
    whole = cut.filter("piece is null").select("conv_id", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    pieces = cut.filter("piece is not null")
    order = ["conv_id", "turn", "role", "digest", "skip"]
    tables = pieces.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "piece", "table")
    choice = map_arrow(tables, _stitch, "piece string, entry int, leave int, total long").withColumnRenamed("piece", "chosen")
    joined = pieces.join(choice, F.col("piece") == F.col("chosen")).repartition("conv_id").sortWithinPartitions(*order)
    return whole.unionByName(map_arrow(joined.drop("chosen"), _finish, _REPORT))


ORACLE_SQL = r"""
with recursive
crc_table as (select list_transform(range(256), lambda i: list_reduce(list_prepend(cast(i as ubigint), [0::ubigint, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end)) tab),
hashed as (select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') t, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') id from conversations),
damaged as (select h.*, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(id, ''), lambda x: cast(ascii(x) as ubigint))),
  lambda c, x: xor(c >> 8, tab[cast(xor(c, x) & 255 as integer) + 1])), 4294967295::ubigint) % 20 k from hashed h, crc_table),
after as (select conv_id, turn, case when k = 4 then 'user' else role end role, case when k = 1 then '' when k = 2 then regexp_replace(t, '[.!?]', '', 'g') else t end t
  from damaged, range(2) copies(copy) where k <> 0 and (copy = 0 or k = 3)),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(t)) i from after),
seen as (select *, row_number() over (partition by conv_id, role, t order by i) nth, lag(role) over (partition by conv_id order by i) pre from placed),
faults as (select conv_id, turn, i, role, t, role[1] c, not regexp_matches(t, '[^\x20\x09-\x0D]') blank, regexp_matches(t, '[^\x20\x09-\x0D]') and nth > 1 dup,
  regexp_matches(t, '[^\x20\x09-\x0D]') and nth = 1 and not regexp_matches(t, '[.!?][\x20\x09-\x0D]*\z') cut, pre is not null and pre[1] || role[1] not in ('su', 'ua', 'au') bad from seen),
counts as (select conv_id, count(*) n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (blank) blank, count(*) filter (dup) duplicate, count(*) filter (cut) truncated, count(*) filter (bad) illegal from faults group by conv_id),
-- best (cost, audit, text) of each grammar state before row i, inserts included
walk as (select conv_id, n, cast(0 as bigint) i, {'c': 0, 'a': '', 't': ''} v0, cast(null as struct(c integer, a varchar, t varchar)) v1, {'c': 2, 'a': 'I', 't': chr(10) || 'user:'} v2, {'c': 4, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'} v3 from counts
 union all
 select conv_id, n, i, n0, n1, m2, list_min([n3, {'c': m2.c + 2, 'a': m2.a || 'I', 't': m2.t || chr(10) || 'assistant:'}]) from (
  select *, list_min(list_filter([n2, case when n0 is null then null else {'c': n0.c + 2, 'a': n0.a || 'I', 't': n0.t || chr(10) || 'user:'} end, case when n1 is null then null else {'c': n1.c + 2, 'a': n1.a || 'I', 't': n1.t || chr(10) || 'user:'} end,
    case when n3 is null then null else {'c': n3.c + 2, 'a': n3.a || 'I', 't': n3.t || chr(10) || 'user:'} end], lambda x: x is not null)) m2 from (
   select w.conv_id, w.n, w.i + 1 i, case when v0 is null then null else {'c': v0.c + 3, 'a': v0.a || 'D', 't': v0.t} end n0,
    list_min(list_filter([case when v1 is null then null else {'c': v1.c + 3, 'a': v1.a || 'D', 't': v1.t} end, case when v0 is not null and keep and f.c = 's' then {'c': v0.c + x, 'a': v0.a || 'K', 't': v0.t || kept} end], lambda y: y is not null)) n1,
    list_min(list_filter(list_concat([case when v2 is null then null else {'c': v2.c + 3, 'a': v2.a || 'D', 't': v2.t} end],
      list_transform([v0, v1, v3], lambda v: case when v is not null and keep then {'c': v.c + 2 + x, 'a': v.a || 'R', 't': v.t || chr(10) || 'user:' || f.t} end),
      list_transform([v0, v1, v3], lambda v: case when v is not null and keep and f.c = 'u' then {'c': v.c + x, 'a': v.a || 'K', 't': v.t || kept} end)), lambda y: y is not null)) n2,
    list_min(list_filter([case when v3 is null then null else {'c': v3.c + 3, 'a': v3.a || 'D', 't': v3.t} end, case when v2 is not null and keep then {'c': v2.c + 2 + x, 'a': v2.a || 'R', 't': v2.t || chr(10) || 'assistant:' || f.t} end,
      case when v2 is not null and keep and f.c = 'a' then {'c': v2.c + x, 'a': v2.a || 'K', 't': v2.t || kept} end], lambda y: y is not null)) n3
   from walk w join (select *, not blank and not dup keep, case when cut then 1 else 0 end x, chr(10) || role || ':' || t kept from faults) f on w.conv_id is not distinct from f.conv_id and f.i = w.i + 1))),
best as (select conv_id, list_min([v0, v3]) v from walk where i = n)
select c.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal,
 cast(coalesce(v.c, 0) as bigint) cost, coalesce(v.a, '') audit, sha256(coalesce(v.t[2:], '')) repaired_sha256
from (select distinct conv_id from conversations) c left join counts on counts.conv_id is not distinct from c.conv_id left join best on best.conv_id is not distinct from c.conv_id
"""


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of all damaged conversations.

    Nulls in role and text are one space; null turns come first; null conv_ids are one conversation; rows of one turn
    come by role and the sha256 of their text; repeated rows are duplicates; very long texts are hashed as a stream;
    very long conversations are cut into pieces; further columns are not read; an empty table gives no row.
    """
    prepare(spark)
    return repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
