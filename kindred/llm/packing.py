"""Best-fit packing into bins of several permitted lengths.

A document is its words ([^\\x20\\x09-\\x0D]+) and one end token.  Documents of over the largest
capacity are cut into pieces of that length and a remainder.  Pieces are dealt at random into shards
of about ``SHARD``, and each shard is packed by best fit, longest first: a piece goes to the open bin
that it leaves least room in; else a bin opens.  Which size opens is optimised over all permitted
ones jointly: the shard is packed once for each limit on the size of a new bin, within it the size
of least cost per token it can still be filled with opens, and the packing of least total cost is
kept.  At last each bin shrinks to the least permitted length that holds its contents.  The cost of a
bin is its length plus ``open_cost``.

Null texts count as empty (one token).  Repeated rows and rows without an id are packed like others.
An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

CAPACITIES = (512, 1024, 2048, 4096)
SHARD = 65_536
RESULT = "bin_id long, capacity int, used int, doc_ids array<long>, starts array<long>, lengths array<int>"


def best_fit(sizes: list[int], capacities: tuple[int, ...], limit: int, open_cost: float) -> tuple[list[list[int]], float]:
    """Bins (lists of indexes) of sizes that descend, and their cost after downsizing."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacities[-1] + 1)]  # open bins by what is left
    mask, left, used = 0, sum(sizes), []
    for i, size in enumerate(sizes):
        fits = mask >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
        else:
            able = [c for c in capacities if c >= size and c <= limit] or [next(c for c in capacities if c >= size)]
            r = min(able, key=lambda c: ((c + open_cost) / min(c, left), c))
            b = len(bins)
            bins.append([])
            used.append(0)
        bins[b].append(i)
        used[b] += size
        left -= size
        r -= size
        if r:
            if not room[r]:
                mask |= 1 << r
            room[r].append(b)
    fit = np.array(capacities)[np.searchsorted(capacities, used)] if used else np.zeros(0)
    return bins, float(fit.sum() + open_cost * len(bins))


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, open_cost: float = 16.0, shard: int = SHARD) -> DataFrame:
    """One row per bin: its length, the tokens used, and its pieces' documents, first tokens and lengths."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    top = capacities[-1]
    n = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1
    rows = scratch.put(docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.cast("long").alias("n")))
    pieces = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(top).cast("long"))))
    pieces = pieces.select("doc_id", "start", F.least(F.col("n") - F.col("start"), F.lit(top)).cast("int").alias("length"), "row")
    total = rows.agg(F.sum(F.ceil(F.col("n") / top))).first()[0]
    if not total:
        return spark.createDataFrame([], RESULT)
    shards = -(-int(total) // shard)

    def fill(t: pa.Table) -> pa.Table:
        s, ids, start, length = (t.column(c).to_numpy() if c != "doc_id" else t.column(c) for c in ("shard", "doc_id", "start", "length"))
        order = np.lexsort((start, t.column("row").to_numpy(), -length))
        sizes = length[order].tolist()
        bins, _ = min((best_fit(sizes, capacities, c, open_cost) for c in capacities), key=lambda x: x[1])
        flat = order[np.concatenate([np.array(b) for b in bins])]
        cut = np.concatenate([[0], np.cumsum([len(b) for b in bins])]).astype(np.int32)
        used = np.add.reduceat(length[flat], cut[:-1])
        lists = lambda x: pa.ListArray.from_arrays(pa.array(cut), x)
        return pa.table({
            "bin_id": (int(s[0]) << 32) + np.arange(len(bins)), "capacity": np.array(capacities, np.int32)[np.searchsorted(capacities, used)], "used": used.astype(np.int32),
            "doc_ids": lists(ids.take(pa.array(flat)).combine_chunks()), "starts": lists(pa.array(start[flat])), "lengths": lists(pa.array(length[flat])),
        })

    return pieces.withColumn("shard", F.pmod(F.xxhash64("row", "start"), F.lit(shards))).groupBy("shard").applyInArrow(fill, RESULT)
