"""Operator 6: language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed greedily into the longest
phrases that occur in that language's training text; the language that needs the fewest phrases, normalised
by the bits a phrase costs (log2 of its training length) and the text's length, wins.

Texts are lower-cased, letters kept, runs of anything else become one space. Many texts are parsed side by side,
BLOCK characters at a time; states and counts pass from block to block, so a text of any length is one parse.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import extended, learn_rows, map_arrow, prepare, stored, texts_of, without, worker_model

BLOCK = 1024
#: Training bounds: all labelled texts are cut into segments of so many characters; of each language's segments
#: those of smallest hash are taken, so many at most and so many characters in all.
SEGMENT_CHARS, SEGMENTS, LANG_CHARS = 800, 120, 32_000
#: Characters of the languages whose tables a worker holds at once, and entries of these tables; further languages
#: are parsed in turn. One language beyond that has a sparse table.
GROUP_CHARS, GROUP_CELLS = 400_000, 24_000_000
#: Picked segments up to which they are sent to every task.
BROADCAST_ROWS = 500_000
#: Texts parsed side by side.
LANES = 8192
UNKNOWN = "und"


@dataclass
class Model:
    """Training text by language; the automata follow from it in each worker."""

    texts: dict[str, str]
    digest: str = field(default="")

    def __post_init__(self):
        self.digest = blake2b(repr(sorted(self.texts.items())).encode(), digest_size=16).hexdigest()


class Parser:
    """Transition tables of all languages' automata over a shared alphabet: dense, or sorted keys where that is too large.

    An entry is twice the next state, plus 1 where the phrase ends and the character begins the next one.
    """

    def __init__(self, model: Model, cells: int | None = None):
        self.langs = sorted(model.texts)
        letters = sorted({c for t in model.texts.values() for c in t.lower() if c.isalpha()})
        self.width = len(letters) + 2  # 0: anything but a letter; last: a letter that no training text has
        self.classes = np.zeros(0x110000, np.int16 if self.width < 1 << 15 else np.int32)
        self.classes[[i for i in range(0x110000) if chr(i).isalpha()]] = self.width - 1
        self.classes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.roots, self.bits, self.again, keys, values, base = [], [], [], [], [], 0
        for lang in self.langs:
            seq = self.normal(model.texts[lang])
            moves = automaton(seq.tolist())
            keys.append(np.array([(base + s) * self.width + c for s, m in enumerate(moves) for c in m], np.int64))
            values.append(np.array([base + t for m in moves for t in m.values()], np.int64))
            again = np.full(self.width, base, np.int64)
            again[list(moves[0])] = base + np.array(list(moves[0].values()), np.int64)
            self.again.append(again * 2 + 1)
            self.roots.append(base)
            self.bits.append(np.log2(max(len(seq), 2)))
            base += len(moves)
        self.roots, self.bits, self.again = np.array(self.roots, np.int64), np.array(self.bits), np.stack(self.again)
        keys, values = np.concatenate(keys), np.concatenate(values) * 2
        self.table = None
        if base * self.width <= (GROUP_CELLS if cells is None else cells):
            sizes = np.diff(np.append(self.roots, base))
            self.table = np.repeat(self.again, sizes, axis=0).astype(np.int32).ravel()
            self.table[keys] = values
        else:
            order = np.argsort(keys)
            self.keys, self.values = keys[order], values[order]

    def normal(self, text: str) -> np.ndarray:
        c = self.classes[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
        if len(c) < 2:
            return c
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
        return c[keep]

    def phrases(self, texts: list[str], block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases by text and language, normalised lengths, and whether a text has a letter."""
        seqs = [self.normal(t) for t in texts]
        length = np.array([len(s) for s in seqs], np.int64)
        total = np.zeros((len(texts), len(self.langs)))
        order = np.argsort(-length, kind="stable")[: int((length > 0).sum())]
        for at in range(0, len(order), LANES):
            part = order[at : at + LANES]
            sizes = length[part]
            state = np.repeat(self.roots[:, None], len(part), axis=1)
            count = np.ones(state.shape, np.int64)
            for first in range(0, int(sizes[0]), block):
                own = np.minimum(sizes[sizes > first] - first, block)  # longest first: a run of lanes from the left
                grid = np.zeros((int(own[0]), len(own)), np.int32)
                for j, size in enumerate(own.tolist()):
                    grid[:size, j] = seqs[part[j]][first : first + size]
                self._parse(grid, own, state, count)
            total[part] = count.T
        return total, length, np.array([bool((s != 0).any()) for s in seqs], bool)

    def _parse(self, grid: np.ndarray, sizes: np.ndarray, state: np.ndarray, count: np.ndarray) -> None:
        """Take states and counts of the lanes over the next characters."""
        active = np.searchsorted(-sizes, -np.arange(len(grid)), side="left")
        for t in range(len(grid)):
            n = active[t]
            got = self._next(state[:, :n], grid[t, :n])
            count[:, :n] += got & 1
            state[:, :n] = got >> 1

    def _next(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        key = state * self.width + c
        if self.table is not None:
            return self.table[key]
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.values[at], self.again[:, c])


def automaton(seq: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of seq; state 0 is the root."""
    moves, link, length, last = [{}], [-1], [0], 0
    for c in seq:
        cur = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return moves


def train(docs: DataFrame, segments: int = SEGMENTS, segment_chars: int = SEGMENT_CHARS, lang_chars: int = LANG_CHARS) -> Model:
    """Learn from doc_id, text, lang rows; rows with a null lang or text, or without a letter, teach nothing.

    A bounded sample, drawn from all of every text: see SEGMENT_CHARS. Every language is learned; equal rows
    teach once. No labelled row gives a model that answers ``und``. Driver and workers hold ``lang_chars`` characters
    of each language.
    """
    prepare(docs.sparkSession)
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.xxhash64("doc_id", "text").alias("k"), "text")
    sized = known.filter(F.col("text").rlike(r"\p{L}")).select("lang", "k", F.length("text").alias("size")).distinct()
    cut = sized.select("lang", "k", "size", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / segment_chars).cast("int"))).alias("i"))
    cut = cut.select("lang", "k", "i", F.xxhash64("k", "i").alias("h"), F.least(F.lit(segment_chars), F.col("size") - F.col("i") * segment_chars).alias("n"))
    order = Window.partitionBy("lang").orderBy("h", "k", "i")
    before = F.coalesce(F.sum(F.col("n") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    few = cut.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= segments)
    pick = stored(few.withColumn("before", before).filter(F.col("before") < lang_chars).select("lang", "k", "i", "h"), "language-sample")
    small = F.broadcast(pick) if pick.count() <= BROADCAST_ROWS else pick
    rows = known.join(small, ["lang", "k"]).select("lang", "h", F.expr(f"substring(text, i * {segment_chars} + 1, {segment_chars})").alias("t")).distinct().collect()
    texts: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["h"], r["t"])):
        if len(texts.get(r["lang"], "")) < lang_chars:
            texts[r["lang"]] = (texts.get(r["lang"], "") + " " + r["t"])[:lang_chars]
    return Model({k: t for k, t in texts.items() if any(c.isalpha() for c in t)})


def parser(model: Model) -> Parser:
    return worker_model(model.digest, lambda: Parser(model))


def grouped(model: Model, chars: int | None = None) -> list[Model]:
    """The model dealt into ones of at most ``chars`` characters and GROUP_CELLS entries (one language at least), in the order of tags."""
    groups, size, letters = [], 0, set()
    for lang in sorted(model.texts):
        text = model.texts[lang]
        own = set(text.lower())
        if not groups or size + len(text) > (chars or GROUP_CHARS) or 2 * (size + len(text)) * (len(letters | own) + 2) > GROUP_CELLS:
            groups.append({})
            size, letters = 0, set()
        groups[-1][lang] = text
        size, letters = size + len(text), letters | own
    return [Model(g) for g in groups]


def predict(model: Model, texts: list[str], groups: list[Model] | None = None) -> tuple[list[str], np.ndarray]:
    """Language and score of each text. Score: how far the winner's cost is below the second's, 0 to 1; ties go to the smaller tag."""
    if not model.texts or not texts:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    # least and second least cost so far: a group's tables at a time
    low, other = np.full(len(texts), np.inf), np.full(len(texts), np.inf)
    tags = np.full(len(texts), UNKNOWN, object)
    for group in groups or grouped(model):
        p = parser(group)
        total, length, letters = p.phrases(texts)
        cost = total * p.bits[None] / np.maximum(length, 1)[:, None]
        best = cost.argmin(axis=1)
        least = cost[np.arange(len(cost)), best]
        second = np.partition(cost, 1, axis=1)[:, 1] if len(p.langs) > 1 else np.full(len(cost), np.inf)
        other = np.minimum(np.maximum(low, least), np.minimum(other, second))
        tags = np.where(least < low, np.array(p.langs, object)[best], tags)
        low = np.minimum(low, least)
    score = np.where(letters, np.clip(1 - low / np.where(letters, other, 1), 0, 1), 0.0)
    return [t if ok else UNKNOWN for t, ok in zip(tags, letters)], score


def identify(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """Add the predicted language and its score. Null or letterless text: ``und`` and 0.

    Other columns stay; ones of the two added names are replaced. Repeated rows are predicted alike; an empty table
    stays empty.
    """
    docs = without(docs, lang, score)
    at, n = docs.columns.index("text"), len(docs.columns)
    schema = extended(docs, f"{lang} string, {score} double")

    def run(batches):
        groups = grouped(model)
        for b in batches:
            tags, scores = predict(model, texts_of(b.column(at)), groups)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(tags, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, lang, score])

    return map_arrow(docs, run, schema)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """Predict the language of every document; learn from documents outside the held-out quarter.

    Null, empty and letterless texts are ``und``; a null doc_id hashes as the empty text; ties of languages go to the
    smaller tag; repeated rows stay; an empty table gives no row.
    """
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = learn_rows(F.col("doc_id"), 4) == 2
    model = train(docs.filter(~held))
    out = identify(docs.select("doc_id", held.alias("held_out"), "text"), model, "lang_pred", "score")
    return out.select("doc_id", "held_out", "lang_pred", "score")
