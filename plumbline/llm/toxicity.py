"""Operator 5: toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Each word enters as a word vector (known words only; its first component starts as the word's class
log-odds) joined with the mean vector of its hashed character trigrams. Overlapping windows of WINDOW words,
STRIDE words apart, cover the whole text; a document's score is its largest window's. Training labels whole
documents, so each round takes every document's highest-scoring window and learns on that. The fit runs in one
task on the bounded sample, so that its memory and time are no driver's.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import extended, learn_rows, map_arrow, prepare, stored, texts_of, without

WINDOW, STRIDE, HIDDEN, WORD_DIM, CHAR_DIM, BUCKETS = 32, 16, 8, 4, 4, 2048
#: Training bounds: labelled documents of each class (whole texts), known words.
TOXIC_DOCS, CLEAN_DOCS, VOCABULARY = 1_500, 4_000, 12_000
#: Rounds, and the least number of passes and of steps (of BATCH windows) in a round; chosen on learning rows alone.
ROUNDS, PASSES, STEPS, BATCH = 8, 2, 20, 100
THRESHOLD = 0.7
#: Words held by a worker with their input projections, and windows that run side by side.
CACHE_WORDS, LANES = 150_000, 4096

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class Weights:
    vocabulary: dict[str, int]  # 0 stands for unknown words
    word: np.ndarray
    char: np.ndarray
    w: np.ndarray  # 2 directions, inputs, 3 gates
    u: np.ndarray
    b: np.ndarray
    att: np.ndarray
    out: np.ndarray
    bias: float
    prior: bool = False  # one class only was seen: every score is 0

    def arrays(self) -> list[np.ndarray]:
        return [self.word, self.char, self.w, self.u, self.b, self.att, self.out]


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of ^^word$ for all words, and where each word's begin (each has one at least)."""
    text = "".join(f"^^{w}$" for w in words)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    h = c[:-2] * np.uint64(0x9E3779B1) ^ c[1:-1] * np.uint64(0x85EBCA77) ^ c[2:] * np.uint64(0xC2B2AE3D)
    h = ((h >> np.uint64(7)) ^ h) % np.uint64(BUCKETS)
    ends = np.cumsum([len(w) + 3 for w in words])
    inside = np.ones(len(c), bool)
    inside[ends - 1] = inside[ends - 2] = False
    starts = np.concatenate([[0], ends[:-1]]) - 2 * np.arange(len(words))
    return h[inside[: len(h)]].astype(np.int64), starts


def inputs(m: Weights, words: list[str]) -> np.ndarray:
    ids = np.array([m.vocabulary.get(w, 0) for w in words])
    grams, starts = trigrams(words)
    sums = np.add.reduceat(m.char[grams], starts, axis=0)
    n = np.diff(np.append(starts, len(grams)))[:, None]
    return np.concatenate([m.word[ids], sums / n], axis=1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def forward(m: Weights, proj: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows. proj: rows of both directions' input projections; ids, mask: windows by WINDOW."""
    n, steps, hd = len(ids), ids.shape[1], HIDDEN
    hs = np.zeros((2, steps, n, hd), np.float32)
    tape = []
    for d in (0, 1):
        h = np.zeros((n, hd), np.float32)
        own = np.ascontiguousarray(proj[:, d])
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            x, g = own[ids[:, t]], h @ m.u[d]
            zr = _sigmoid(x[:, : 2 * hd] + g[:, : 2 * hd])
            z, r = zr[:, :hd] * mask[:, t, None], zr[:, hd:]
            c = np.tanh(x[:, 2 * hd :] + r * g[:, 2 * hd :])
            if keep:
                tape.append((d, t, h, zr[:, :hd], z, r, c, g[:, 2 * hd :]))
            h = h + z * (c - h)
            hs[d, t] = h
    both = np.concatenate([hs[0], hs[1]], axis=2)  # steps, windows, 2 hidden
    e = np.where(mask.T, both @ m.att, np.float32(-1e9))
    a = np.exp(e - e.max(axis=0))
    a /= a.sum(axis=0)
    ctx = (a[:, :, None] * both).sum(axis=0)
    logit = ctx @ m.out + m.bias
    return (logit, (both, a, ctx, tape)) if keep else logit


def projections(m: Weights, x: np.ndarray) -> np.ndarray:
    return np.stack([x @ m.w[d] + m.b[d] for d in (0, 1)], axis=1).astype(np.float32)


def windows(n: int) -> list[int]:
    """Starts of overlapping windows that together cover n words; one window even for none."""
    return list(range(0, max(1, n - WINDOW + STRIDE), STRIDE))


def lay_out(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all documents: word rows, mask, owner. A document without words is one blank window."""
    ids, owner, length = [], [], []
    for i, d in enumerate(docs):
        starts = np.arange(0, max(1, len(d) - WINDOW + STRIDE), STRIDE)
        padded = np.zeros(starts[-1] + WINDOW, np.int32)
        padded[: len(d)] = d
        ids.append(padded[starts[:, None] + np.arange(WINDOW)])
        length.append(np.minimum(len(d) - starts, WINDOW))
        owner.append(np.full(len(starts), i))
    length = np.maximum(np.concatenate(length), 1)
    return np.concatenate(ids), np.arange(WINDOW)[None] < length[:, None], np.concatenate(owner)


def window_logits(m: Weights, proj: np.ndarray, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return np.concatenate([forward(m, proj, ids[i : i + LANES], mask[i : i + LANES]) for i in range(0, len(ids), LANES)])


def fit(texts: Iterable[str], labels: Iterable[int], rounds: int = ROUNDS, seed: int = 7) -> Weights:
    """Train on labelled texts, taken one by one. With one class only, the model scores 0."""
    rng = np.random.default_rng(seed)
    # words as row numbers from the start: the sample's words as strings would take ten times its bytes
    first_seen: dict[str, int] = {"": 0}
    docs, given = [], []
    for text, label in zip(texts, labels):
        docs.append(np.array([first_seen.setdefault(w, len(first_seen)) for w in words_of(text)], np.int32))
        del text
        given.append(label)
    labels, y = given, np.array(given, np.float32)
    distinct = sorted(first_seen)
    rank = np.zeros(len(distinct), np.int32)
    rank[[first_seen[w] for w in distinct]] = np.arange(len(distinct))
    docs = [rank[d] for d in docs]
    del first_seen, rank
    counts = np.zeros((2, len(distinct)), np.int64)
    for d, label in zip(docs, labels):
        counts[int(label == 1), np.unique(d)] += 1
    toxic, seen = counts[1], counts.sum(axis=0)
    common = np.argsort(-seen, kind="stable")[:VOCABULARY]  # ties by code point
    common = common[seen[common] >= 3]
    vocabulary = {distinct[w]: i for i, w in enumerate(common.tolist(), 1)}
    nt, nc = float(y.sum()), float(len(y) - y.sum())
    word = rng.normal(0, 0.1, (len(vocabulary) + 1, WORD_DIM)).astype(np.float32)
    word[0] = 0
    odds = np.log((toxic[common] + 0.5) / (nt + 1)) - np.log((seen[common] - toxic[common] + 0.5) / (nc + 1))
    word[1:, 0] = odds * seen[common] / (seen[common] + 5)
    dim, hd = WORD_DIM + CHAR_DIM, HIDDEN
    m = Weights(vocabulary, word, rng.normal(0, 0.1, (BUCKETS, CHAR_DIM)).astype(np.float32), rng.normal(0, 0.4, (2, dim, 3 * hd)).astype(np.float32), rng.normal(0, 0.3, (2, hd, 3 * hd)).astype(np.float32), np.zeros((2, 3 * hd), np.float32), np.zeros(2 * hd, np.float32), rng.normal(0, 0.3, 2 * hd).astype(np.float32), 0.0)
    if not nt or not nc:
        m.prior = True
        return m
    ids, mask, owner = lay_out(docs)
    grams, starts = trigrams(distinct)
    gram_n = np.diff(np.append(starts, len(grams)))
    moments = [[np.zeros_like(a), np.zeros_like(a)] for a in m.arrays()] + [[0.0, 0.0]]
    step = 0
    for round_ in range(rounds):
        if round_ == 0:  # no network yet: the window with the largest log-odds
            first = word[[vocabulary.get(w, 0) for w in distinct], 0]
            value = np.where(mask, first[ids], -9).max(axis=1)
        else:
            value = window_logits(m, projections(m, inputs(m, distinct)), ids, mask)
        order = np.lexsort((-value, owner))
        best = order[np.unique(owner[order], return_index=True)[1]]
        for _ in range(max(PASSES, -(-STEPS // -(-len(best) // BATCH)))):
            deal = rng.permutation(len(best))
            for at in range(0, len(deal), BATCH):
                pick = deal[at : at + BATCH]
                step += 1
                _learn(m, moments, step, distinct, ids[best[pick]], mask[best[pick]], y[pick], (grams, starts, gram_n))
    return m


def _learn(m: Weights, moments: list, step: int, distinct: list[str], ids: np.ndarray, mask: np.ndarray, y: np.ndarray, gram: tuple) -> None:
    """One Adam step on windows by back-propagation through both directions."""
    used, local = np.unique(ids, return_inverse=True)
    local = local.reshape(ids.shape)
    names = [distinct[i] for i in used]
    x = inputs(m, names)
    logit, (both, a, ctx, tape) = forward(m, projections(m, x), local, mask, keep=True)
    hd, n = HIDDEN, len(ids)
    d_logit = (_sigmoid(logit) - y) / n
    g_out, g_bias = ctx.T @ d_logit, float(d_logit.sum())
    d_ctx = d_logit[:, None] * m.out[None]
    d_a = (both * d_ctx[None]).sum(axis=2)
    d_e = a * (d_a - (a * d_a).sum(axis=0))
    g_att = np.einsum("tn,tnh->h", d_e, both)
    d_both = a[:, :, None] * d_ctx[None] + d_e[:, :, None] * m.att
    g_w, g_u, g_b, d_x = np.zeros_like(m.w), np.zeros_like(m.u), np.zeros_like(m.b), np.zeros_like(x)
    carry = {0: np.zeros((n, hd), np.float32), 1: np.zeros((n, hd), np.float32)}
    d_rows = np.zeros((2, len(used), 3 * hd), np.float32)
    for d, t, h, z_raw, z, r, c, gc in reversed(tape):
        d_h = carry[d] + d_both[t, :, d * hd : (d + 1) * hd]
        d_c = d_h * z * (1 - c * c)
        d_z = d_h * (c - h) * mask[:, t, None] * z_raw * (1 - z_raw)
        d_r = d_c * gc * r * (1 - r)
        pre = np.concatenate([d_z, d_r, d_c], axis=1)
        rec = np.concatenate([d_z, d_r, d_c * r], axis=1)
        g_u[d] += h.T @ rec
        carry[d] = d_h * (1 - z) + rec @ m.u[d].T
        np.add.at(d_rows[d], local[:, t], pre)
    for d in (0, 1):
        g_w[d], g_b[d] = x.T @ d_rows[d], d_rows[d].sum(axis=0)
        d_x += d_rows[d] @ m.w[d].T
    g_word, g_char = np.zeros_like(m.word), np.zeros_like(m.char)
    np.add.at(g_word, [m.vocabulary.get(w, 0) for w in names], d_x[:, :WORD_DIM])
    g_word[0] = 0
    grams, starts, size = gram
    where = np.concatenate([np.arange(starts[i], starts[i] + size[i]) for i in used])
    np.add.at(g_char, grams[where], np.repeat(d_x[:, WORD_DIM:] / size[used][:, None], size[used], axis=0))
    rate, b1, b2 = 0.01, 0.9, 0.999
    scale = rate * np.sqrt(1 - b2**step) / (1 - b1**step)
    for p, g, (m1, m2) in zip(m.arrays(), [g_word, g_char, g_w, g_u, g_b, g_att, g_out], moments):
        m1 += (1 - b1) * (g - m1)
        m2 += (1 - b2) * (g * g - m2)
        p -= (scale * m1 / (np.sqrt(m2) + 1e-8)).astype(np.float32)
    last = moments[-1]
    last[0] += (1 - b1) * (g_bias - last[0])
    last[1] += (1 - b2) * (g_bias**2 - last[1])
    m.bias -= scale * last[0] / (last[1] ** 0.5 + 1e-8)


class Scorer:
    """Scores texts, keeping the input projections of words it has met."""

    def __init__(self, m: Weights):
        self.m = m
        self._reset()

    def _reset(self) -> None:
        self.row = {"": 0}
        self.proj = projections(self.m, inputs(self.m, [""]))

    def score(self, texts: list[str]) -> np.ndarray:
        if self.m.prior or not texts:
            return np.zeros(len(texts))
        out, held, size, first = np.zeros(len(texts)), [], 0, 0
        for i, text in enumerate(texts):  # in lots of bounded size
            held.append(words_of(text))
            size += len(held[-1])
            if size > 200_000 or i + 1 == len(texts):
                out[first : i + 1] = self._lot(held)
                held, size, first = [], 0, i + 1
        return out

    def _lot(self, docs: list[list[str]]) -> np.ndarray:
        if len(self.row) > CACHE_WORDS:
            self._reset()
        row = self.row
        new = list(dict.fromkeys(w for ws in docs for w in ws if w not in row))
        if new:
            for i, w in enumerate(new, len(row)):
                row[w] = i
            self.proj = np.concatenate([self.proj, projections(self.m, inputs(self.m, new))])
        ids, mask, owner = lay_out([np.array([row[w] for w in ws], np.int32) for ws in docs])
        best = np.full(len(docs), -np.inf)
        np.maximum.at(best, owner, window_logits(self.m, self.proj, ids, mask))
        return _sigmoid(best)


def train(docs: DataFrame, labels: DataFrame, toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS) -> Weights:
    """Fit on a bounded sample: of each class the labelled doc_ids of smallest hash, whole texts, in one task.

    ``docs``: doc_id, text (null: empty); ``labels``: doc_id, toxic (null: no label; repeated ids: toxic if any row
    is). Null doc_ids teach nothing; equal rows teach once, and of an id's differing texts no more than the class's
    bound are taken. Without labels, or with one class only, every score is 0.
    """
    spark = prepare(docs.sparkSession)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    sizes = known.agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("all")).first()
    toxic = sizes["toxic"] or 0
    # the smallest hashes lie below a bound that twice as many rows as wanted stay under: only these are ranked
    share = F.when(F.col("toxic") == 1, 2 * toxic_docs / max(toxic, 1)).otherwise(2 * clean_docs / max(sizes["all"] - toxic, 1))
    low = known.withColumn("h", F.xxhash64("doc_id")).filter(F.col("h") / float(1 << 64) + 0.5 <= share)
    order = Window.partitionBy("toxic").orderBy("h", "doc_id")
    pick = low.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= F.when(F.col("toxic") == 1, toxic_docs).otherwise(clean_docs)).select(F.col("doc_id").alias("k"), "toxic")
    # at most toxic_docs + clean_docs ids: small enough to be sent to every task
    met = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).join(F.broadcast(pick), F.col("doc_id") == F.col("k")).select("doc_id", "t", "toxic").distinct()
    rows = [met.filter(F.col("toxic") == c).withColumn("h", F.xxhash64("doc_id", "t")).orderBy("h", "doc_id").limit(n) for c, n in ((1, toxic_docs), (0, clean_docs))]
    sample = stored(rows[0].unionByName(rows[1]), "toxicity-sample").repartition(1).sortWithinPartitions("doc_id", "h").select("t", "toxic")

    def learn(batches):
        given = ((t, y) for b in batches for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        texts, classes = _unzipped(given)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, classes))], pa.binary())], names=["weights"])

    made = map_arrow(sample, learn, "weights binary").collect()
    return pickle.loads(made[0]["weights"]) if made else fit([], [])


def _unzipped(pairs):
    """Two iterators over pairs that are read in step, so that a text is let go before the next comes."""
    last = []

    def first():
        for a, b in pairs:
            last.append(b)
            yield a

    def second():
        while True:
            yield last.pop()

    return first(), second()


def score_documents(docs: DataFrame, m: Weights, score: str = "score") -> DataFrame:
    """Add the score, 0 to 1, of every whole text (null: empty). Other columns stay; one named as the score is replaced.

    Empty texts have the score of a blank window; repeated rows are scored alike; an empty table stays empty.
    """
    docs = without(docs, score)
    at = docs.columns.index("text")

    def run(batches):
        scorer = Scorer(m)
        for b in batches:
            text = b.column(at)  # a few rows' texts at a time
            scores = [scorer.score(texts_of(text.slice(i, 500))) for i in range(0, len(text), 500)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())], names=[*b.schema.names, score])

    return map_arrow(docs, run, extended(docs, f"{score} double"))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score all documents; learn from labels outside the held-out third.

    Null and empty texts are scored as blank; a null doc_id hashes as the empty text; repeated rows stay; an empty
    table gives no row.
    """
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(learn_rows(F.col("doc_id"), 3) != 1)
    model = train(docs, labels)
    out = score_documents(docs.withColumn("held_out", learn_rows(F.col("doc_id"), 3) == 1), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
