"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import CLEANUP, Scratch  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c):
    """Lower-cases A-Z and leaves every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def gathered(df: DataFrame, *keys: str) -> DataFrame:
    """All rows of a key in one partition, for functions over whole partitions.

    Dealt by an expression of its own: after a join on the same keys Spark leaves a repartition by them out, and may then
    split the partitions of the join.
    """
    return df.repartition(F.xxhash64(F.lit("gathered"), *keys))


FEW = 1 << 18  # links


def _joined(batches):
    """Links (a, b), at most ``FEW`` -> (x, root): every end of one, and the smallest that it reaches."""
    import pyarrow as pa

    up: dict[int, int] = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["x", "root"])


def components(scratch: Scratch, links: DataFrame, few: int = FEW) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b); root is the smallest node that it reaches.

    Rounds of contraction: each node moves to the neighbour, or itself, that comes first in an order
    drawn anew each round, so the number of rounds is logarithmic whatever the shape.  Each round is
    two joins and two aggregations with map-side combine; hubs cause no large groups.  Once ``few`` links are left, one
    task joins them, which saves the last rounds; the roots are the same.
    """
    links = scratch.put(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct())
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    label = scratch.put(nodes.select("node", F.col("node").alias("at")))
    edges, step = links, 0
    while (left := edges.count()) > few:
        step += 1
        both = edges.select("a", "b").union(edges.select("b", "a"))
        first = F.struct(F.xxhash64(F.lit(step), F.col("b")).alias("h"), F.col("b").alias("to"))
        own = F.struct(F.xxhash64(F.lit(step), F.col("a")).alias("h"), F.col("a").alias("to"))
        move = scratch.put(both.groupBy("a").agg(F.min(first).alias("m")).select("a", F.least(own, "m")["to"].alias("to")))
        moved = (
            edges.join(move, "a").select(F.col("to").alias("x"), "b")
            .join(move.withColumnRenamed("a", "b"), "b").select(F.col("x").alias("a"), F.col("to").alias("b"))
        )
        moved = moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        next_edges = scratch.put(moved)
        next_label = scratch.put(
            label.join(move.withColumnRenamed("a", "at"), "at", "left").select("node", F.coalesce("to", "at").alias("at"))
        )
        scratch.drop(label, edges, move)
        label, edges = next_label, next_edges
    if left:
        last = scratch.put(edges.coalesce(1).mapInArrow(_joined, "x long, root long"))
        label = scratch.put(label.join(last, label["at"] == last["x"], "left").select("node", F.coalesce("root", "at").alias("at")))
    root = label.groupBy("at").agg(F.min("node").alias("root"))
    return label.join(root, "at").select("node", "root")


M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of ordered pairs of 64-bit hashes."""
    with np.errstate(over="ignore"):
        x = a * M1 + (b ^ (b >> np.uint64(29))) * M2
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def words_of(texts):
    """A pyarrow string array's words ([^\\x20\\x09-\\x0D]+, A-Z lower-cased): flat words, and the number in each text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    low = pc.ascii_lower(pc.fill_null(texts, ""))
    lists = pc.ascii_split_whitespace(low.cast(pa.large_string()))
    flat, off = lists.flatten(), np.asarray(lists.offsets)
    off = off - off[0]
    keep = np.asarray(pc.binary_length(flat)) > 0
    ends = np.concatenate([[0], np.cumsum(keep)])[off]
    return flat.filter(pa.array(keep)), np.diff(ends)
