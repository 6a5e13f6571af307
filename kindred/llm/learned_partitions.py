"""Approximate nearest neighbours by learned partitions.

Fit, on a documented sample of at most ``SAMPLE`` vectors: their neighbour graph, its balanced
partition by recursive spectral bisection at the median, and a small classifier (one hidden layer)
that tells a vector's part.  Parts grow with the table, as far as the sample can fit them.  The number of parts that a query
visits is the least that finds ``target`` of the true neighbours of the sample's last fifth, which the fit does not see; it
visits more where those hold fewer than k vectors.  Every vector is indexed in its most probable part and
every query goes to its most probable parts, where all vectors are compared exactly.

Parts are dealt out in blocks of ``BLOCK`` rows and ``BLOCK`` queries, so neither a large part nor a
vector that a third of the rows hold makes a large task.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows
without an id.  Vectors are compared with those of their length; lengths other than the most common one are compared whole.
Rows with the same id and vector count as one; rows with the same id and different vectors are different rows, each a query
and a candidate of the other.  Ties go to the smaller id.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

SAMPLE = 8192
BLOCK = 4096
RESULT = "query_id long, key long, vec_id long, score double"
DEALT = "n int, part int, vec_id long, key long, v array<double>"


def usable(vectors: DataFrame, zero: bool = False) -> DataFrame:
    """(vec_id, key, n, v): the vectors that take part, in double precision, their hash and length."""
    v = F.col("embedding").cast("array<double>")
    ok = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if not zero:
        ok &= F.exists(v, lambda x: x != 0)
    rows = vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).withColumn("key", F.xxhash64("v"))
    return rows.groupBy("vec_id", "key").agg(F.min("v").alias("v")).select("vec_id", "key", F.size("v").alias("n"), "v")


def parts_for(n: int) -> int:
    """A power of two: about 2,048 rows a part, at least 32 and at most what gives a part 64 vectors of the sample."""
    return min(SAMPLE // 64, max(32, 1 << max(0, (n // 2048).bit_length() - 1)))


def drawn(rows: DataFrame, size: int) -> DataFrame:
    """The ``size`` rows whose ids hash lowest, all rows if fewer.

    The hashes are cut off above a share of rows that is expected to hold a quarter more, so that the
    partitions together, not each of them, send about that many to the driver.
    """
    n, h = rows.count(), F.xxhash64("vec_id", "key")
    if n > 4 * size:
        rows = rows.where(h < F.lit(int(1.25 * size / n * 2**64) - 2**63))
    return rows.orderBy(h, "vec_id", "key").limit(size)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), 1024):
        s = x[i : i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """Halves the graph again and again, by its second eigenvector, at the median."""
    rng, label = np.random.default_rng(seed), np.zeros(len(graph), np.int64)
    src, dst = np.repeat(np.arange(len(graph)), graph.shape[1]), graph.ravel()
    src, dst = np.concatenate([src, dst]), np.concatenate([dst, src])
    for _ in range(int(np.log2(parts))):
        inside = label[src] == label[dst]
        s, d = src[inside], dst[inside]
        degree = np.maximum(np.bincount(s, minlength=len(graph)), 1).astype(float)
        mass = np.bincount(label, degree)
        x = rng.standard_normal(len(graph))
        for _ in range(60):  # a lazy walk, with each part's constant taken out
            x -= (np.bincount(label, x * degree) / mass)[label]
            x = 0.5 * x + 0.5 * np.bincount(s, x[d], minlength=len(graph)) / degree
            x /= np.sqrt(np.bincount(label, x * x))[label] + 1e-12
        order = np.lexsort((np.arange(len(graph)), x, label))
        sizes = np.bincount(label)
        rank = np.empty(len(graph), np.int64)
        rank[order] = np.arange(len(graph)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        label = 2 * label + (rank >= sizes[label] // 2)
    return label


class Router:
    """A classifier with one hidden layer; trained by Adam."""

    def __init__(self, x: np.ndarray, y: np.ndarray, parts: int, hidden: int = 128, epochs: int = 40, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.scale = 1 / (x.std() + 1e-12)
        w = [rng.standard_normal((x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden), rng.standard_normal((hidden, parts)) / np.sqrt(hidden), np.zeros(parts)]
        m, s, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        x = x * self.scale
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
                step += 1
                h = np.tanh(x[at] @ w[0] + w[1])
                z = h @ w[2] + w[3]
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(at)), y[at]] -= 1
                p /= len(at)
                back = (p @ w[2].T) * (1 - h * h)
                for i, g in enumerate((x[at].T @ back, back.sum(0), h.T @ p, p.sum(0))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    s[i] = 0.999 * s[i] + 0.001 * g * g
                    w[i] = w[i] - 3e-3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)
        self.w = w

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Parts, most probable first."""
        z = np.tanh(x * self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]
        return np.argsort(-z, axis=1, kind="stable")


def fit(x: np.ndarray, parts: int, k: int, target: float):
    """A router and the number of parts to visit.  The last fifth of the sample stays out of the training and sets that number."""
    cut = max(1, len(x) * 4 // 5)
    label = balanced_parts(neighbour_graph(x[:cut], min(10, cut - 1)), parts) if cut > 1 else np.zeros(cut, np.int64)
    router = Router(x[:cut], label, parts)
    ranks, home = router.ranked(x), None
    home = ranks[:, 0]
    ask = x[cut:][:1024]
    if not len(ask):
        return router, parts
    s = ask @ x.T
    s[np.arange(len(ask)), np.arange(cut, cut + len(ask))] = -np.inf
    true = np.argsort(-s, axis=1)[:, : min(k, len(x) - 1)]
    place = np.argsort(ranks[cut:][:1024], axis=1)  # of each part, in each query's order
    at = np.take_along_axis(place, home[true], axis=1)
    found = np.array([(at < m).mean() for m in range(1, parts + 1)])
    return router, int(np.searchsorted(found, target) + 1) if found[-1] >= target else parts


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, added in the order of the components, whatever the block."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += q[:, j] * x[:, j]
    return out


def best_of(q_ids, q_keys, q, ids, keys, x, k: int):
    """(query, its key, row, score) of each query's k best rows but itself, ties to the smaller id."""
    out = []
    for i in range(0, len(q), 256):
        s = q[i : i + 256] @ x.T
        s[(q_ids[i : i + 256, None] == ids[None, :]) & (q_keys[i : i + 256, None] == keys[None, :])] = -np.inf
        kth = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
        slack = 1e-9 * np.maximum(1.0, np.abs(kth))
        a, b = np.nonzero((s >= np.where(np.isfinite(kth), kth - slack, -1e308)[:, None]) & np.isfinite(s))
        exact = exact_scores(q[i + a], x[b])
        order = np.lexsort((ids[b], -exact, a))
        a, b, exact = a[order], b[order], exact[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        keep = rank < k
        out.append((q_ids[i + a[keep]], q_keys[i + a[keep]], ids[b[keep]], exact[keep]))
    return [np.concatenate(z) for z in zip(*out, strict=True)]


def matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def search(vectors: DataFrame, every: int, k: int = 20, parts: int | None = None, target: float = 0.93) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each vector whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = scratch.put(usable(vectors))
    lengths = {r.n: r["count"] for r in rows.groupBy("n").count().collect()}  # one row a length
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    main = min(lengths, key=lambda n: (-lengths[n], n))
    x = np.array(drawn(rows.where(F.col("n") == main), SAMPLE).toPandas()["v"].tolist(), dtype=np.float64)
    parts = parts or parts_for(lengths[main])
    while parts > 1 and len(x) < 8 * parts:
        parts //= 2
    router, visits = fit(x, parts, k, target)

    def index(batches):
        for b in batches:
            part, hit = np.zeros(b.num_rows, np.int32), np.asarray(b.column("n")) == main
            if hit.any():
                part[hit] = router.ranked(matrix(b.column("v").filter(pa.array(hit))))[:, 0]
            yield pa.RecordBatch.from_arrays([b.column("n"), pa.array(part), *[b.column(c) for c in ("vec_id", "key", "v")]], names=["n", "part", "vec_id", "key", "v"])

    indexed = scratch.put(rows.mapInArrow(index, DEALT))
    sizes = {(r.n, r.part): r["count"] for r in indexed.groupBy("n", "part").count().collect()}  # a row a part, and one a length
    held = np.array([sizes.get((main, p), 0) for p in range(parts)])

    def ask(batches):
        for b in batches:
            hit = np.asarray(b.column("n")) == main
            at, part = [np.flatnonzero(~hit)], [np.zeros((~hit).sum(), np.int32)]
            if hit.any():
                ranks = router.ranked(matrix(b.column("v").filter(pa.array(hit))))
                enough = (np.cumsum(held[ranks], axis=1) > k).argmax(1) + 1  # the query itself is in a part, too
                need = np.where(held.sum() > k, np.maximum(visits, enough), parts)
                at.append(np.repeat(np.flatnonzero(hit), need))
                part.append(np.concatenate([r[:m] for r, m in zip(ranks, need, strict=True)]).astype(np.int32))
            take = pa.array(np.concatenate(at))
            yield pa.RecordBatch.from_arrays([b.column("n").take(take), pa.array(np.concatenate(part)), *[b.column(c).take(take) for c in ("vec_id", "key", "v")]], names=["n", "part", "vec_id", "key", "v"])

    asking = scratch.put(rows.where(F.col("vec_id") % every == 0).mapInArrow(ask, DEALT))
    asked = {(r.n, r.part): r["count"] for r in asking.groupBy("n", "part").count().collect()}
    shape = [(*at, -(-sizes[at] // BLOCK), -(-m // BLOCK)) for at, m in asked.items() if at in sizes]
    if not shape:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shape = F.broadcast(spark.createDataFrame(shape, "n int, part int, nb int, nq int"))  # a row a part, and one a length
    salt = F.xxhash64("vec_id", "key")
    spread = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    data = indexed.join(shape, ["n", "part"]).select("vec_id", "key", "v", "n", "part", F.pmod(salt, "nb").cast("int").alias("b"), spread("nq").alias("q"))
    asks = asking.join(shape, ["n", "part"]).select("vec_id", "key", "v", "n", "part", F.pmod(salt, "nq").cast("int").alias("q"), spread("nb").alias("b"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.array([], pa.int64())
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": none, "key": none, "vec_id": none, "score": pa.array([], pa.float64())})
        side = lambda t: (np.asarray(t.column("vec_id")), np.asarray(t.column("key")), matrix(t.column("v")))
        return pa.table(dict(zip(("query_id", "key", "vec_id", "score"), best_of(*side(left), *side(right), k), strict=True)))

    unit = ["n", "part", "b", "q"]
    found = asks.groupBy(*unit).cogroup(data.groupBy(*unit)).applyInArrow(compare, RESULT)
    best = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
