"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: 64 bits by majority over the XXH64 (seed 42) of a text's 3-word shingles, repeats
included.  Two fingerprints link at ``radius`` 3 differing bits or fewer, and linked documents form
components.

Plan.  Equal fingerprints collapse first, so copies cost one row.  Of six blocks of the 64 bits, a
link leaves three untouched, so each fingerprint goes to 20 buckets of about 32 bits; together they
miss no link.  A bucket stores its fingerprints as vertical bit planes and compares them with bit-wise carry-save
counters, many at once, until every row exceeds the radius.  It returns a spanning set of its links,
never all pairs.  A bucket of over ``hot`` rows is dealt again by the same argument over its other 32
bits, and what is still larger is compared in pairs of pieces of ``hot`` / 2 rows.

Null texts count as empty; a text without words has fingerprint zero, which links like any other.
Repeated rows are returned each.  Rows without an id get a fingerprint and their component's id (null if
it holds no id).  An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, gathered, words_of

CUTS = (0, 11, 22, 33, 44, 54, 64)
TABLES = tuple(combinations(range(6), 3))


def _majority(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Fingerprints of runs of hashes, ``n`` to a run."""
    out = np.zeros(len(n), np.uint64)
    counts = np.zeros((len(n), 64), np.int64)
    run = np.repeat(np.arange(len(n)), n)
    for i in range(0, len(h), 200_000):
        r = run[i : i + 200_000]
        starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        bits = np.unpackbits(h[i : i + 200_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts[r[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    bits = (2 * counts > n[:, None]).astype(np.uint8)
    out[:] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(batches):
    """(doc_id, key, text) -> (doc_id, key, fp)."""
    import pyarrow.compute as pc
    import xxhash

    digest = xxhash.xxh64_intdigest
    for batch in batches:
        for i in range(0, batch.num_rows, 250):
            b = batch.slice(i, 250)
            flat, n = words_of(b.column("text"))
            data = memoryview(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat.cast(pa.string())), " ")[0].as_buffer()) if len(flat) else b""
            lengths = np.asarray(pc.binary_length(flat)).astype(np.int64)
            start = np.cumsum(lengths + 1) - lengths - 1
            end = start + lengths
            first = np.cumsum(n) - n
            shingles = np.where(n >= 3, n - 2, np.minimum(n, 1))
            at = np.arange(shingles.sum()) - np.repeat(np.cumsum(shingles) - shingles, shingles) + np.repeat(first, shingles)
            last = at + np.repeat(np.minimum(n, 3), shingles) - 1
            h = np.fromiter((digest(data[x:y], 42) for x, y in zip(start[at].tolist(), end[last].tolist(), strict=True)), np.uint64, len(at))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(_majority(h, shingles).view(np.int64))], names=["doc_id", "key", "fp"])


def planes(fp: np.ndarray) -> np.ndarray:
    """Fingerprints -> 64 bitmaps over the rows."""
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    packed = np.packbits(np.pad(bits, ((0, 0), (0, -len(fp) % 64))), axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64)


def near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """(i, j) of a x b at ``radius`` (3 or less) bits or fewer: counters of many rows at once, dropped when all exceed it."""
    p = planes(b)
    out = []
    valid = np.zeros(p.shape[1] * 64, np.uint8)
    valid[: len(b)] = 1
    start_over = ~np.packbits(valid, bitorder="little").view(np.uint64)
    step = max(1, 65_536 // p.shape[1])
    for i in range(0, len(a), step):
        q = a[i : i + step]
        live = np.arange(len(q))
        ones = np.zeros((len(q), p.shape[1]), np.uint64)
        twos, over = ones.copy(), np.broadcast_to(start_over, ones.shape).copy()
        for bit in range(64):
            flip = np.zeros(len(live), np.uint64) - ((q[live] >> np.uint64(bit)) & np.uint64(1))
            d = p[bit][None, :] ^ flip[:, None]
            carry = ones & d
            ones ^= d
            over |= twos & carry
            twos ^= carry
            if bit % 8 == 7:
                open_ = (over != np.uint64(0xFFFFFFFFFFFFFFFF)).any(1)
                if not open_.all():
                    live, ones, twos, over = live[open_], ones[open_], twos[open_], over[open_]
                    if not len(live):
                        break
        if not len(live):
            continue
        beyond = over | {3: np.uint64(0), 2: ones & twos, 1: twos, 0: ones | twos}[radius]
        hit = np.unpackbits(~beyond.view(np.uint8).reshape(len(live), -1), axis=1, bitorder="little")[:, : len(b)]
        x, y = np.nonzero(hit)
        out.append(np.stack([i + live[x], y]))
    return np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)


def near_few(fp: list, radius: int) -> list:
    """near() within a few rows, with bitmaps that are integers."""
    m = len(fp)
    full = (1 << m) - 1
    cols = [0] * 64
    for i, v in enumerate(fp):
        for bit in range(64):
            if v >> bit & 1:
                cols[bit] |= 1 << i
    out = []
    for i in range(m - 1):
        v, ones, twos, over = fp[i], 0, 0, (2 << i) - 1
        for bit in range(64):
            d = cols[bit] ^ full if v >> bit & 1 else cols[bit]
            carry = ones & d
            ones ^= d
            over |= twos & carry
            twos ^= carry
            if over == full:
                break
        beyond = over | (0, ones & twos, twos, ones | twos)[3 - radius]
        out += [(i, j) for j in range(i + 1, m) if not beyond >> j & 1]
    return out


def spanning(n: int, pairs) -> list:
    """Links (i, root) with the same components as the pairs."""
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in pairs:
        x, y = find(x), find(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return [(i, find(i)) for i in range(n) if find(i) != i]


def _links(batches, radius: int, hot: int):
    """Rows (t, key, fp, node, side), sorted by (t, key): links (a, b).  side: 0, or which piece of two a row is in."""
    rest = None

    def out(fp, node, side):
        if (side != 0).any():
            a, b = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
            x, y = near(fp[a], fp[b], radius) if len(a) and len(b) else (np.zeros(0, np.int64),) * 2
            pairs = zip(a[x].tolist(), b[y].tolist(), strict=True)
        elif len(fp) <= 64:
            pairs = near_few(fp.tolist(), radius)
        else:
            pairs = zip(*near(fp, fp, radius).tolist(), strict=True)
        return [(node[i], node[j]) for i, j in spanning(len(fp), pairs)]

    def runs(cols, last: bool):
        t, key, fp, node, side = cols
        edge = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (key[1:] != key[:-1]), [True]])) if len(t) else np.zeros(1, np.int64)
        stop = len(edge) - 1 if last else max(0, len(edge) - 2)
        found = []
        for i in np.flatnonzero(np.diff(edge[: stop + 1]) > 1):
            x, y = edge[i], edge[i + 1]
            found += out(fp[x:y], node[x:y], side[x:y])
        return found, [c[edge[stop] :] for c in cols]

    kinds = (np.int32, np.int64, np.int64, np.int64, np.int8)
    for b in batches:
        cols = [np.asarray(b.column(i)).astype(k) for i, k in enumerate(kinds)]
        cols[2] = cols[2].view(np.uint64)
        cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)] if rest else cols
        found, rest = runs(cols, False)
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(2)], names=["a", "b"])
    if rest:
        found, _ = runs(rest, True)
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(2)], names=["a", "b"])


def _bits(fp, lo: int, hi: int):
    return F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))


def _key(fp, blocks):
    key = F.lit(0).cast("long")
    for b in blocks:
        key = F.shiftleft(key, CUTS[b + 1] - CUTS[b]).bitwiseOR(_bits(fp, CUTS[b], CUTS[b + 1]))
    return key


def linked(scratch: Scratch, prints: DataFrame, radius: int = 3, hot: int = 8192) -> DataFrame:
    """(a, b): links between the nodes of (fp, node), whose fingerprints are distinct; all that the components need."""
    fp = F.col("fp")
    dealt = prints.select("fp", "node", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), _key(fp, t).alias("key")) for i, t in enumerate(TABLES)])).alias("k"))
    dealt = dealt.select(F.col("k.t").alias("t"), F.col("k.key").alias("key"), "fp", "node")
    sizes = dealt.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"))
    large = scratch.put(sizes.where(F.col("n") > hot))
    run = lambda rows: gathered(rows, "t", "key").sortWithinPartitions("t", "key", "fp", "side").mapInArrow(lambda it: _links(it, radius, hot), "a long, b long")
    plain = dealt.withColumn("side", F.lit(0).cast("byte"))
    if large.isEmpty():
        return run(plain)
    few = large.select("t", "key")
    out = run(plain.join(few, ["t", "key"], "left_anti"))
    # of the other bits, four parts: one at least is equal in a link
    again = dealt.join(few, ["t", "key"]).select("t", "key", "fp", "node")
    subs = []
    for i, t in enumerate(TABLES):
        a, b, c = [x for x in range(6) if x not in t]
        own = F.shiftleft(F.shiftleft(_bits(fp, CUTS[a], CUTS[a + 1]), CUTS[b + 1] - CUTS[b]).bitwiseOR(_bits(fp, CUTS[b], CUTS[b + 1])), CUTS[c + 1] - CUTS[c]).bitwiseOR(_bits(fp, CUTS[c], CUTS[c + 1]))
        subs.append(F.when(F.col("t") == i, own))
    own = F.coalesce(*subs)
    again = again.select("t", "key", "fp", "node", F.explode(F.array(*[F.struct(F.lit(j).alias("s"), _bits(own, 9 * j, 9 * j + 9).alias("sub")) for j in range(4)])).alias("k"))
    again = again.select((F.col("t") + 20 * (1 + F.col("k.s"))).alias("t"), F.xxhash64("key", "k.sub").alias("key"), "fp", "node")
    sizes = scratch.put(again.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")))
    again = again.join(sizes, ["t", "key"])
    out = out.union(run(again.where(F.col("n") <= hot).select("t", "key", "fp", "node", F.lit(0).cast("byte").alias("side"))))
    pieces = F.ceil(F.col("n") / (hot // 2)).cast("long")
    mine = F.pmod(F.xxhash64("fp"), pieces)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), pieces - 1), lambda o: F.struct(F.least(o, mine).alias("x"), F.greatest(o, mine).alias("y"), F.when(o == mine, 0).when(mine < o, 1).otherwise(2).cast("byte").alias("side")))
    still = again.where(F.col("n") > hot).select("t", "key", "fp", "node", F.explode(pairs).alias("p"))
    return out.union(run(still.select("t", F.xxhash64("key", "p.x", "p.y").alias("key"), "fp", "node", F.col("p.side").alias("side"))))


def text_key():
    """The hash that tells texts of one id apart."""
    return F.xxhash64(F.col("text").cast("string"))


def grouped(docs: DataFrame, radius: int = 3, hot: int = 8192) -> DataFrame:
    """(doc_id, key, fp, root, component_id) of each row of (doc_id, text); root tells components apart, with or without an id."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), F.col("text").cast("string").alias("text"))
    rows = scratch.put(texts.mapInArrow(fingerprints, "doc_id long, key long, fp long"))
    prints = scratch.put(rows.groupBy("fp").agg(F.min("doc_id").alias("first")).withColumn("node", F.xxhash64("fp")))
    root = components(scratch, linked(scratch, prints.select("fp", "node"), radius, hot))
    at = prints.join(root, "node", "left").select("fp", "first", F.coalesce("root", "node").alias("root"))
    least = at.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = scratch.put(at.join(least, "root").select("fp", "root", "component_id"))
    return rows.join(by_fp, "fp").select("doc_id", "key", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = 3, hot: int = 8192) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of (doc_id, text)."""
    return grouped(docs, radius, hot).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
