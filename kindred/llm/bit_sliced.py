"""Exact top-k inner products over a bit-sliced index.

Components become integers floor(1024 x).  The index holds blocks of ``BLOCK`` rows as bit slices, and nothing else:
for each component and bit, a bitmap over the rows.  A query's scores are the sum of its weights
times the slices: bitmaps of equal weight are added by carry-save adders, which gives the slices of
all rows' sums at once.  The sum leaves out the ``coarse`` lowest slices of each component, so it bounds a row's score
from both sides.  The k-th largest sum is found from the most significant slice downward; the rows whose upper bound
reaches it are put together again from all slices and resolved exactly.

Blocks meet queries in groups of about ``GROUP``: a block is sent once for each group, a query once for each block, so
memory is bounded by a block and a group.  Vectors that are null or empty, or hold null or non-finite components, take no
part, nor do rows without an id; zero vectors do.  Vectors are compared with those of their length.  Rows with the same id
and vector count as one; rows with the same id and different vectors are different rows.  Ties go to the smaller id.  An empty
table gives an empty result.  Blocks and queries with components of 2**``WIDE`` or more are not sliced but resolved whole, in
integers of any size; scores beyond 64 bits become the nearest that 64 bits hold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch
from .learned_partitions import usable

BLOCK = 16_384
GROUP = 2048
WIDE = 24  # with fewer bits, products of any usual number of components fit


def pack(bits: np.ndarray) -> np.ndarray:
    """Booleans over rows -> words of 64 rows (the last axis)."""
    pad = -bits.shape[-1] % 64
    packed = np.packbits(np.pad(bits, [(0, 0)] * (bits.ndim - 1) + [(0, pad)]), axis=-1, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64)


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), bitorder="little")[:n].astype(bool)


def slices_of(x: np.ndarray):
    """Integers (rows, components) -> least of each component, number of bits, and the bitmaps (component, bit, words)."""
    low = x.min(0)
    y = x - low
    bits = max(1, int(y.max()).bit_length())
    return low, bits, np.stack([pack(((y.T >> b) & 1).astype(bool)) for b in range(bits)], axis=1)


def rows_of(at: np.ndarray, low: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """The integers of some rows, from all slices."""
    bits = (planes[:, :, at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
    return (bits.astype(np.int64) << np.arange(planes.shape[1])[None, :, None]).sum(1).T + low


def add_up(by_weight: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """Bitmaps by weight -> slices of their sum; three bitmaps of a weight become one and a carry until one is left."""
    out, w = [], 0
    while by_weight and w <= max(by_weight):
        stack = np.concatenate(by_weight.pop(w)) if w in by_weight else None
        while stack is not None and len(stack) > 1:
            if len(stack) == 2:
                a, b = stack[:1], stack[1:]
                rest, carry = a ^ b, a & b
            else:
                m = len(stack) // 3
                a, b, c = stack[:m], stack[m : 2 * m], stack[2 * m : 3 * m]
                t = a ^ b
                rest, carry = np.concatenate([t ^ c, stack[3 * m :]]), (a & b) | (t & c)
            by_weight.setdefault(w + 1, []).append(carry)
            stack = rest
        out.append(stack[0] if stack is not None else None)
        w += 1
    return out


def at_least(sums: list, bound: int, like: np.ndarray) -> np.ndarray:
    """Bitmap of the rows whose sum is ``bound`` or more."""
    full = np.full_like(like, 0xFFFFFFFFFFFFFFFF)
    if bound <= 0:
        return full
    if bound >> len(sums):
        return np.zeros_like(like)
    more, same = np.zeros_like(like), full
    for i in range(len(sums) - 1, -1, -1):
        s = sums[i] if sums[i] is not None else np.zeros_like(like)
        if bound >> i & 1:
            same = same & s
        else:
            more, same = more | (same & s), same & ~s
    return more | same


def top_rows(q: np.ndarray, planes: np.ndarray, coarse: int, k: int, allowed: np.ndarray) -> np.ndarray:
    """Indexes of a block's rows that can be among its k best."""
    words, coarse = planes.shape[-1], min(coarse, planes.shape[1] - 1)
    by_weight: dict[int, list] = {}
    for d, weight in enumerate(q.tolist()):
        if weight:
            s = planes[d, coarse:] if weight > 0 else ~planes[d, coarse:]
            for j in range(abs(weight).bit_length()):
                if abs(weight) >> j & 1:
                    for b in range(len(s)):
                        by_weight.setdefault(j + b, []).append(s[b : b + 1])
    sums = add_up(by_weight)
    mask = pack(allowed)
    count = lambda m: int(np.bitwise_count(m).sum())
    if count(mask) <= k or not sums:
        return np.flatnonzero(allowed)
    sure, same, bound = np.zeros(words, np.uint64), mask, 0
    for i in range(len(sums) - 1, -1, -1):
        s = sums[i] if sums[i] is not None else np.zeros(words, np.uint64)
        if count(sure | (same & s)) >= k:
            same, bound = same & s, bound | 1 << i
        else:
            sure, same = sure | (same & s), same & ~s
    spread = -(-int(((1 << coarse) - 1) * np.abs(q).sum()) // (1 << coarse))
    return np.flatnonzero(unpack(at_least(sums, bound - spread, mask) & mask, len(allowed)))


INDEX = "n int, ids binary, keys binary, x binary, low binary, planes binary"
FOUND = "query_id long, key long, vec_id long, score long"


def _index(t: pa.Table) -> pa.Table:
    """The rows of a block -> its slices, or the integers themselves if they are wide."""
    x = np.asarray(t.column("x").combine_chunks().flatten()).reshape(t.num_rows, -1)
    out = {"ids": np.asarray(t.column("vec_id")), "keys": np.asarray(t.column("key")), "x": x[:0], "low": x[:0], "planes": x[:0]}
    if x.min() <= -(1 << WIDE) or x.max() >= 1 << WIDE:
        out["x"] = x
    else:
        out["low"], _, out["planes"] = slices_of(x)
    return pa.table({"n": pa.array([x.shape[1]], pa.int32())} | {c: [a.tobytes()] for c, a in out.items()})


def _answer(batches, coarse: int, k: int):
    """(n, ids, keys, x, low, planes, q_ids, q_keys, q): a block and a group of queries -> the k best of each query."""
    for batch in batches:
        for i in range(batch.num_rows):
            of = lambda c, kind: np.frombuffer(batch.column(c)[i].as_py(), kind)  # noqa: B023, E731
            n, ids, keys = batch.column("n")[i].as_py(), of("ids", np.int64), of("keys", np.int64)
            whole, low, planes = of("x", np.int64).reshape(-1, n), of("low", np.int64), of("planes", np.uint64)
            planes = planes.reshape(n, -1, -(-len(ids) // 64)) if len(planes) else None
            groups = [batch.column(c)[i].values for c in ("q_ids", "q_keys", "q")]
            out = []
            for q_id, q_key, q in zip(np.asarray(groups[0]).tolist(), np.asarray(groups[1]).tolist(), np.asarray(groups[2].flatten()).reshape(-1, n), strict=True):
                allowed = (ids != q_id) | (keys != q_key)
                if planes is None or np.abs(q).max() >= 1 << WIDE:
                    at = np.flatnonzero(allowed)
                    x = whole[at] if planes is None else rows_of(at, low, planes)
                    s = np.clip(x.astype(object) @ q.astype(object), -(2**63), 2**63 - 1).astype(np.int64) if len(at) else np.zeros(0, np.int64)
                else:
                    at = top_rows(q, planes, coarse, k, allowed)
                    s = rows_of(at, low, planes) @ q
                best = _first(s, ids[at], k)
                out += [(q_id, q_key, v, z) for v, z in zip(ids[at][best].tolist(), s[best].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], pa.int64()) for j in range(4)], names=["query_id", "key", "vec_id", "score"])


def _first(s: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k highest scores, ties to the smaller id; ~s orders as -s does, without overflow."""
    return np.lexsort((ids, ~s))[:k]


def search(vectors: DataFrame, every: int = 100, k: int = 10, coarse: int = 3, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each vector whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = scratch.put(usable(vectors, zero=True).select("vec_id", "key", "n", F.transform("v", lambda x: F.floor(F.lit(1024.0) * x)).alias("x")))
    asks = rows.where(F.col("vec_id") % every == 0)
    blocks, groups = max(1, -(-rows.count() // block)), max(1, -(-asks.count() // group))
    salt = F.xxhash64("vec_id", "key")
    built = rows.groupBy("n", F.pmod(salt, F.lit(blocks)).alias("b")).applyInArrow(_index, INDEX)
    grouped = asks.groupBy("n", F.pmod(salt, F.lit(groups)).cast("int").alias("g")).agg(F.collect_list(F.struct("vec_id", "key", "x")).alias("s"))
    grouped = grouped.select("n", "g", F.col("s.vec_id").alias("q_ids"), F.col("s.key").alias("q_keys"), F.col("s.x").alias("q"))
    units = scratch.put(built).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).join(grouped, ["n", "g"]).drop("g")
    found = units.repartition(max(1, min(blocks * groups, 4096)), F.xxhash64("ids", "q_ids")).mapInArrow(lambda it: _answer(it, coarse, k), FOUND)
    best = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
