"""Operator 8: approximate nearest neighbours over learned partitions.

On a bounded sample the neighbour graph is built and cut into balanced parts by recursive spectral bisection;
a small network learns which part a vector belongs to. Every row is indexed in its most probable part; a
query visits its most probable parts and all their rows are scored exactly. The number of parts visited is
the least that finds RECALL of the true neighbours of sample rows that were held out of the fit; a query whose
parts hold too few candidates visits further ones.

Visits are made in steps, the most probable part first and FACTOR times as many in each step: the worst of the
k nearest found so far bars all rows below it, so a step adds about FACTOR times k rows a query at most on average,
however many parts it visits. A part is searched in blocks of bounded size against blocks of queries.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import extended, map_arrow, prepare, stored

#: Fitting bounds: rows of the sample (more, if parts need them: so many for each), neighbours in its graph.
SAMPLE, SAMPLE_PER_PART, NEAR = 4_000, 40, 10
#: Rows that a part should hold, and the fewest and most parts; beyond PARTS * PART_ROWS rows parts grow.
PART_ROWS, FEWEST, PARTS = 1_500, 4, 256
#: One sample row in so many is held out of the fit and asks for the number of visits.
HELD = 10
RECALL = 0.93
#: Parts visited by the steps together: 1, FACTOR, FACTOR ** 2 and so on.
FACTOR = 4
BLOCK, QUERY_BLOCK = 4_000, 1_000
#: Queries scored at a time against a block; tasks at most among which the blocks of one part are dealt.
LOT, SALTS = 64, 16
HIDDEN = 64


@dataclass
class Router:
    """Weights of the classifier and the number of parts a query visits."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    visits: int

    @property
    def parts(self) -> int:
        return len(self.b2)

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts of each vector, most probable first; the direction of a vector decides."""
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.argsort(-(np.tanh(unit @ self.w1 + self.b1) @ self.w2 + self.b2), axis=1, kind="stable")


def bisect(near: np.ndarray, parts: int, seed: int = 3) -> np.ndarray:
    """Balanced parts (a power of two) of a neighbour graph: split at the median of its second eigenvector, again and again."""
    n = len(near)
    label = np.zeros(n, np.int64)
    rng = np.random.default_rng(seed)
    src, dst = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    a, b = np.concatenate([src, dst]), np.concatenate([dst, src])
    for _ in range(int(np.log2(parts))):
        inner = label[a] == label[b]
        ia, ib = a[inner], b[inner]
        degree = np.bincount(ia, minlength=n) + 1.0
        size = np.bincount(label, weights=degree)
        v = rng.normal(size=n)
        for _ in range(60):  # lazy random walk within each part, the constant taken out
            v -= (np.bincount(label, weights=v * degree) / size)[label]
            v = 0.5 * v + 0.5 * (np.bincount(ia, weights=v[ib], minlength=n) + v) / degree
            v /= np.sqrt(np.bincount(label, weights=v * v * degree) / size)[label] + 1e-12
        order = np.lexsort((np.arange(n), v, label))
        rank = np.empty(n, np.int64)
        counts = np.bincount(label)
        rank[order] = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
        label = 2 * label + (rank >= (counts[label] + 1) // 2)
    return label


def fit(x: np.ndarray, parts: int, near: int = NEAR, recall: float = RECALL, epochs: int = 40, seed: int = 5) -> Router:
    """Learn parts and router from the sample's vectors but every HELD-th, on which the visits are chosen."""
    rng = np.random.default_rng(seed)
    whole, ask = x, np.arange(HELD - 1, len(x), HELD)
    x = np.delete(whole, ask, axis=0)
    n, d = x.shape
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    while n < 4 * parts and parts > 1:
        parts //= 2
    if parts < 2:
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    k = min(near, n - 1)
    graph = np.concatenate([np.argpartition(-_others(unit[i : i + 512] @ unit.T, i), k - 1, axis=1)[:, :k] for i in range(0, n, 512)])
    label = bisect(graph, parts)
    r = Router(rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)) * 2, np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, parts)), np.zeros(parts), parts)
    # a vector's target: the parts of its neighbours and its own
    goal = np.zeros((n, parts))
    np.add.at(goal, (np.repeat(np.arange(n), k), label[graph].ravel()), 0.5 / k)
    goal[np.arange(n), label] += 0.5
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (r.w1, r.b1, r.w2, r.b2)]
    step = 0
    for _ in range(epochs):
        deal = rng.permutation(n)
        for at in range(0, n, 256):
            i = deal[at : at + 256]
            h = np.tanh(unit[i] @ r.w1 + r.b1)
            z = h @ r.w2 + r.b2
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            dz = (p - goal[i]) / len(i)
            dh = dz @ r.w2.T * (1 - h * h)
            step += 1
            for w, g, m in zip((r.w1, r.b1, r.w2, r.b2), (unit[i].T @ dh, dh.sum(0), h.T @ dz, dz.sum(0)), moments):
                m[0] += 0.1 * (g - m[0])
                m[1] += 0.001 * (g * g - m[1])
                w -= 0.01 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step) * m[0] / (np.sqrt(m[1]) + 1e-8)
    if not len(ask):
        return r
    # visits: true neighbours of the held-out rows, by inner product among the whole sample
    score = whole[ask] @ whole.T
    score[np.arange(len(ask)), ask] = -np.inf
    true = np.argpartition(-score, min(20, len(whole) - 1) - 1, axis=1)[:, : min(20, len(whole) - 1)]
    home, order = r.order(whole)[:, 0], r.order(whole[ask])
    place = np.argsort(order, axis=1)
    at = np.take_along_axis(place, home[true], axis=1)
    found = np.array([(at < v).mean() for v in range(1, parts + 1)])
    met = found >= recall
    r.visits = int(np.argmax(met)) + 1 if met.any() else parts
    return r


def _others(s: np.ndarray, first: int) -> np.ndarray:
    s[np.arange(len(s)), first + np.arange(len(s))] = -np.inf
    return s


def valid_vectors(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Rows whose vector is not null, has only finite components, is not zero, and has the most frequent dimension."""
    ok = df.filter(F.col(vec).isNotNull()).filter(F.forall(vec, lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)))).filter(F.exists(vec, lambda v: v != 0))
    dims = ok.groupBy(F.size(vec).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return ok.filter(F.size(vec) == (dims[0]["d"] if dims else 0))


def matrix(column) -> np.ndarray:
    """Vectors of an Arrow list column as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def search(rows: DataFrame, query: Column, k: int = 20, sample: int = SAMPLE, part_rows: int = PART_ROWS, parts: int = PARTS, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by inner product of each row of (vec_id, embedding) where ``query`` holds.

    All rows but the query's own are candidates, ties go to the smaller vec_id, other columns are ignored. Fully
    equal rows count once; rows with a null vec_id, and vectors that valid_vectors leaves out, take no part. Fewer
    candidates give fewer rows; an empty table gives none. The router is fitted on rows of smallest hash (SAMPLE).
    """
    spark = prepare(rows.sparkSession)
    base = stored(valid_vectors(rows.select("vec_id", "embedding")).filter("vec_id is not null").distinct(), "vectors")
    n = base.count()
    wanted = 1 << max(0, int(np.log2(min(parts, max(n / part_rows, FEWEST)))))
    pick = base.withColumn("h", F.xxhash64("vec_id", "embedding")).orderBy("h").limit(max(sample, SAMPLE_PER_PART * wanted)).select("embedding").toArrow()
    x = matrix(pick.column(0).combine_chunks()) if len(pick) else np.zeros((0, 0))
    router = spark.sparkContext.broadcast(fit(x, wanted, recall=recall) if len(x) else None)

    def index(batches):
        for b in batches:
            part = router.value.order(matrix(b.column(1)))[:, 0] if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part.astype(np.int32), pa.int32())], names=[*b.schema.names, "part"])

    indexed = stored(map_arrow(base, index, extended(base, "part int")), "vector-index")
    counts = {r["part"]: r["n"] for r in indexed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    # so many rows hold k candidates, whatever rows are the query's own
    enough = k + (base.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 0)

    def route(batches):
        size = np.array([counts.get(p, 0) for p in range(router.value.parts)]) if counts else None
        for b in batches:
            if b.num_rows:
                to = router.value.order(matrix(b.column(1))).astype(np.int32)
                visits = np.maximum(router.value.visits, (np.cumsum(size[to], axis=1) < enough).sum(axis=1) + 1)
                visited = np.arange(to.shape[1])[None] < visits[:, None]
                ends = np.concatenate([[0], visited.sum(axis=1).cumsum()])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(to[visited], pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "parts"])

    routed = stored(map_arrow(base.filter(query), route, extended(base, "parts array<int>")), "vector-queries")
    most = routed.agg(F.max(F.size("parts"))).first()[0] or 0
    wide = base.schema["embedding"].dataType.elementType.simpleString() == "double"
    cut = {p: max(1, -(-c // BLOCK)) for p, c in counts.items()}
    blocks = _of_part(cut)
    salts = _of_part({p: min(c, SALTS) for p, c in cut.items()})
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    held = indexed.withColumn("block", (spread % blocks).cast("int")).withColumn("bound", F.lit(0.0))
    left = stored(_blocks(held, "c", wide).withColumn("salt", F.col("block") % salts).drop("c_bounds", "block"), "vector-blocks")
    q_blocks = max(1, -(-n // (20 * QUERY_BLOCK)))
    best = None
    low, high = 0, 1
    while low < most:
        step = routed.select("vec_id", "embedding", F.explode(F.slice("parts", low + 1, high - low)).alias("part"))
        if best is None:
            step = step.withColumn("bound", F.lit(float("-inf")))
        else:
            bar = best.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bar"))
            step = step.join(bar, "vec_id", "left").withColumn("bound", F.coalesce("bar", F.lit(float("-inf")))).drop("bar")
        right = _blocks(step.withColumn("block", (spread % q_blocks).cast("int")), "q", wide).drop("block").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        hits = _score(left.join(right, ["part", "salt"]), k, wide)
        if best is not None:
            hits = hits.unionByName(best.drop("rank"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = stored(hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "vector-best")
        low, high = high, high * FACTOR
    if best is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return best.select("query_id", "rank", "vec_id", "score")


def _of_part(numbers: dict[int, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for p, c in numbers.items() for v in (p, c)]), F.col("part")) if numbers else F.lit(1)


def _blocks(df: DataFrame, name: str, wide: bool) -> DataFrame:
    """Rows of a (part, block) packed into one row of binary ids, vectors and bounds; blocks are of bounded size."""
    kind = "<f8" if wide else "<f4"

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        return pd.DataFrame({"part": [key[0]], "block": [key[1]], "ids": [pdf["vec_id"].to_numpy().astype("<i8").tobytes()], "vecs": [np.stack(pdf["embedding"].to_numpy()).astype(kind).tobytes()], "bounds": [pdf["bound"].to_numpy().astype("<f8").tobytes()]})

    packed = df.groupBy("part", "block").applyInPandas(pack, "part int, block int, ids binary, vecs binary, bounds binary")
    return packed.select("part", "block", *[F.col(c).alias(f"{name}_{c}") for c in ("ids", "vecs", "bounds")])


def _score(pairs: DataFrame, k: int, wide: bool) -> DataFrame:
    """query_id, vec_id, score: of each block the k nearest of each query that its bound doesn't bar."""
    kind, fields = "<f8" if wide else "<f4", pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                ci, qi = np.frombuffer(row["c_ids"], "<i8"), np.frombuffer(row["q_ids"], "<i8")
                cv = np.frombuffer(row["c_vecs"], kind).reshape(len(ci), -1).astype(np.float64)
                qv = np.frombuffer(row["q_vecs"], kind).reshape(len(qi), -1).astype(np.float64)
                bound = np.frombuffer(row["q_bounds"], "<f8")
                top = min(k, len(ci))
                for at in range(0, len(qi), LOT):
                    ids, bar = qi[at : at + LOT], bound[at : at + LOT]
                    s = qv[at : at + LOT] @ cv.T
                    s[ids[:, None] == ci[None]] = -np.inf
                    edge = np.maximum(-np.partition(-s, top - 1, axis=1)[:, top - 1], bar)
                    r, c = np.nonzero((s >= (edge - 1e-9 * (1 + np.abs(edge)))[:, None]) & (s > -np.inf))
                    exact = (qv[at + r] * cv[c]).sum(axis=1)
                    order = np.lexsort((ci[c], -exact, r))  # ties to smaller ids
                    r, c, exact = r[order], c[order], exact[order]
                    keep = (np.arange(len(r)) - np.searchsorted(r, r) < k) & (exact >= bar[r])
                    if keep.any():
                        yield pa.RecordBatch.from_arrays([pa.array(ids[r[keep]]), pa.array(ci[c[keep]]), pa.array(exact[keep])], schema=fields)

    return map_arrow(pairs.select("c_ids", "c_vecs", "q_ids", "q_vecs", "q_bounds"), run, "query_id long, vec_id long, score double")


def op8_learned_partitions(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every row whose vec_id is divisible by 20.

    Null vec_ids and vectors that are null, zero, hold null or non-finite components, or differ from the most
    frequent dimension take no part; ties go to the smaller vec_id; an empty table gives no row.
    """
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
