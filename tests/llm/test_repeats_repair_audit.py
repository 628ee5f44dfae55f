"""Repeated spans, conversation repair and filter interactions against brute force, with nulls, ties, repeats and long rows."""

import random
import re
from hashlib import sha256
from itertools import permutations
from zlib import crc32

import pytest

from plumbline.llm import common, conversations, filter_audit, repeats

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_repeats(rows):
    """(doc_id, n_words, n_removed, sha) of each (doc_id, text), by looking at every window."""
    least = {}
    split = [WORD.findall((t or "").encode()) for _, t in rows]
    for (d, _), w in zip(rows, split):
        for i in range(len(w) - 12):
            if d is not None:
                k = tuple(w[i : i + 13])
                least[k] = min(least.get(k, d), d)
    out = []
    for (d, _), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - 12):
            if d is not None and least[tuple(w[i : i + 13])] < d:
                gone |= set(range(i, i + 13))
        out.append((d, len(w), len(gone), sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


def texts(rng):
    """Documents that share passages, of few words each, with repeats within themselves and runs of one word."""
    words = [f"w{i}" for i in range(40)] + ["Ä", "\x1c", "a b"]
    passages = [[rng.choice(words) for _ in range(rng.randint(10, 90))] for _ in range(8)] + [["la"] * 70]
    out = []
    for _ in range(60):
        body = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            at = rng.randrange(len(p))
            body += p[at : at + rng.randint(5, 90)] + [rng.choice(words) for _ in range(rng.choice([0, 1, 30]))]
        out.append(rng.choice([" ", "\n", "\t "]).join(body))
    return out


@pytest.mark.parametrize("seed, rows_a_batch", [(0, 10000), (1, 5), (2, 64)])
def test_repeats_by_every_window(spark, seed, rows_a_batch):
    rng = random.Random(seed)
    common.prepare(spark)
    body = texts(rng)
    rows = [(rng.choice([i, i, -i, i // 3]), t) for i, t in enumerate(body)]
    rows += [(7, None), (None, body[5]), (None, None), (8, ""), (3, body[9]), (3, body[9]), (90, body[9] + " " + body[10])] + [(100 + i, body[1]) for i in range(20)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_a_batch))
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
        got = [tuple(r) for r in repeats.remove_repeats(df).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(str, got)) == sorted(map(str, plain_repeats(rows))) and any(r[2] for r in got)


def test_repeats_of_long_texts_empty_tables_and_clashing_columns(spark):
    common.prepare(spark)
    rng = random.Random(4)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(200_000))
    rows = [(2, long, 1, 2), (1, "x " + long[:70_000], 3, 4), (5, "la " * 100_000, 5, 6), (6, "la " * 20, 7, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, place int, tag int")
    assert sorted(tuple(r) for r in repeats.remove_repeats(df).collect()) == sorted(plain_repeats([r[:2] for r in rows]))
    assert repeats.remove_repeats(df.limit(0)).count() == 0


def test_paths_compact_where_stretches_touch_or_overlap(spark):
    common.prepare(spark)
    rng = random.Random(9)
    stretches, want = set(), {}
    for doc in range(6):
        for _ in range(12):
            place, n, apart = rng.randrange(0, 300), rng.randrange(1, 90), rng.choice([5, 70])
            stretches.add((doc, place, n, 99, place - apart))
            want.setdefault((doc, apart), set()).update(range(place, place + n))
    got = repeats.compact(spark.createDataFrame(sorted(stretches), "doc_id long, place long, n long, source long, source_place long")).collect()
    seen = {}
    for r in got:
        cells = set(range(r.place, r.place + r.n))
        key = (r.doc_id, r.place - r.source_place)
        assert not cells & seen.get(key, set()) and not {r.place - 1, r.place + r.n} & want[key]
        seen[key] = seen.get(key, set()) | cells
    assert seen == want


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        c, t = (" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        kind = crc32(f"{c}:{t}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], sha256(r[3].encode()).hexdigest()))


def plain_repair(rows):
    """Best (cost, audit) of each grammar state after each row, all edits tried; rows of one conversation."""
    seen, facts = set(), []
    n = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    for _, _, role, text in rows:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            n[fault] += 1
        facts.append((role, text, fault))
    n["illegal"] = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    moves = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    def better(table, state, value):
        if state not in table or value < table[state]:
            table[state] = value

    def inserts(table):
        for _ in range(4):
            for s, (cost, audit, lines) in list(table.items()):
                for name in ("user", "assistant"):
                    if (s, name[0]) in moves:
                        better(table, moves[s, name[0]], (cost + 2, audit + "I", lines + (f"{name}:",)))

    table = {"": (0, "", ())}
    inserts(table)
    for role, text, fault in facts:
        after, more = {}, fault == "truncated"
        for s, (cost, audit, lines) in table.items():
            better(after, s, (cost + 3, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                for edit, name, price in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    if (s, name[:1]) in moves:
                        better(after, moves[s, name[:1]], (cost + price + more, audit + edit, lines + (f"{name}:{text}",)))
        inserts(after)
        table = after
    cost, audit, lines = min(table[s] for s in ("", "a") if s in table)
    turns = {r[1] for r in rows if r[1] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, n["blank"], n["duplicate"], n["truncated"], n["illegal"], cost, audit, sha256("\n".join(lines).encode()).hexdigest())


def conversations_of(rng):
    rows = []
    roles = ["user", "assistant", "system", "user", "assistant", "uncle", "", "USER", None]
    said = ["Yes.", "no", "Why?\n ", "", " \t", None, "ok!\x1c", "Yes.", "é"]
    for conv in [*range(40), None]:
        for i in range(rng.randint(1, 12)):
            turn = rng.choice([i, i, i, None, i // 2])
            rows.append((conv, turn, rng.choice(roles[: rng.choice([2, 3, 9])]), rng.choice(said) if rng.random() < 0.5 else f"text {rng.random()}."))
        if rng.random() < 0.3:
            rows.append(rows[-1])
    return rows


@pytest.mark.parametrize("seed, parts", [(0, 4), (1, 40)])
def test_repairs_by_trying_every_edit(spark, tmp_path, seed, parts):
    rng = random.Random(seed)
    rows = conversations_of(rng)
    # conversations longer than a block: without any role, so that no two paths ever meet, and a plain one
    rows += [(900, i, None, f"{i}") for i in range(700)] + [(901, i, ("user", "assistant", "x")[i % 3], f"{i % 300}.") for i in range(600)] + [(902, None, "user", "same.")] * 600
    # a conversation of which nothing is left
    gone = next(i for i in range(1000, 2000) if crc32(f"{i}:5".encode()) % 20 == 0)
    rows.append((gone, 5, "user", "hello."))
    rng.shuffle(rows)
    path = str(tmp_path)
    spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, copies int").write.parquet(f"{path}/conversations.parquet")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r.conv_id: tuple(r)[1:] for r in conversations.op12_conversation_repair(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {c: plain_repair(plain_damage([r for r in rows if r[0] == c])) for c in {r[0] for r in rows}}
    assert got == want
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())


def test_pieces_join_as_one_search():
    """Blocks of any size, stitched, find what one search over all rows finds."""
    rng = random.Random(11)
    for _ in range(300):
        lattice = [(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 14))]
        want = conversations.search(lattice, conversations.START, {conversations.START, conversations.AFTER_A})
        joined, at, tables = conversations.Stitcher(), 0, []
        while at < len(lattice) or not tables:
            part = lattice[at : at + rng.randint(1, 4)]
            at += len(part)
            tables.append({(e, x): v for e in range(4) for x, v in conversations.search(part, e).items()})
            joined.add(tables[-1])
        cost, states = joined.end()
        assert [(cost, "".join(t[s][1] for t, s in zip(tables, states)))] == list(want.values())


def plain_audit(docs, labels):
    rows = []
    for d, text, source in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = d is not None and any(x is not None and x < d and (y or "") == t for x, y, _ in docs)
        fails = {f for f, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t), smaller)) if bad}
        rows.append((source or "", fails, d in {x for x, q, _ in labels if q == 1 and x is not None}, d in {x for x, _, z in labels if z == 1 and x is not None}))
    out = []
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        removed, found = {}, []
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                here, before = [r for r in left if f in r[1]], len(mine) - len(left)
                early = sum(f in r[1] for r in mine) - len(here)
                assert early <= before
                left = [r for r in left if f not in r[1]]
                removed[f] = removed.get(f, 0) + len(here)
                found.append((part, "".join(order), step, len(left), len(here), early, sum(r[1] == {f} for r in mine), sum(r[2] for r in here), sum(r[3] for r in here), f))
        out += [(*r[:-1], removed[r[-1]]) for r in found]
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_audit_by_running_every_order(spark, seed):
    common.prepare(spark)
    rng = random.Random(seed)
    docs = []
    for i in range(60):
        w = [rng.choice(["a", "b", "Word", "X#", " ", "\x1f"]) + str(rng.randrange(rng.choice([3, 400]))) for _ in range(rng.choice([0, 5, 199, 200, 320]))]
        docs.append((i, " ".join(w), rng.choice(["s", "t", None, ""])))
    docs += [(70, docs[3][1], "s"), (71, docs[3][1], "t"), (None, docs[3][1], "t"), (72, None, "s"), (73, None, None), (70, docs[3][1], "s"), (70, "other text", "s"), (74, "Ab " * 200_000, "s")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 75, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    rng.shuffle(docs)
    df = spark.createDataFrame([(*r, 5, "x") for r in docs], "doc_id long, text string, source string, n int, mask string").repartition(3)
    got = filter_audit.interaction_report(filter_audit.failures(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(docs, labels)
    assert filter_audit.interaction_report(filter_audit.failures(df.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0
