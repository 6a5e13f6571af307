"""Chat formatting after cumulative snapshots collapse.

A conversation that is logged again and again as it grows leaves snapshots that are prefixes of the
last one.  Each turn gets the rolling hash of its conversation up to it: the running sums of two
64-bit hashes of (position, role, text).  A conversation whose whole hash is another's proper prefix
hash is anti-joined away, equal conversations leave the one with the smallest id, and the maximal
ones are rendered.

Turns are in order of turn; equal ones by role, then by hashes of their texts.  Repeated turn rows count once.
Null roles and texts count as empty, a null turn comes first, and rows without a conversation id take no part.
An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) of the conversations that are no proper prefix of another."""
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = rows.withColumn("h1", F.xxhash64(F.lit(1), "role", "text")).withColumn("h2", F.xxhash64(F.lit("b"), "text", "role"))
    one = rows.select("conv_id", "turn", "role", "h1", "h2").distinct()
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "h1", "h2")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    ranked = one.withColumn("k", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("conv_id")))
    rolling = lambda c: F.sum(F.xxhash64("k", c).cast("decimal(20,0)")).over(so_far)
    hashed = ranked.withColumn("p1", rolling("h1")).withColumn("p2", rolling("h2")).select("conv_id", "k", "n", "p1", "p2")
    whole = hashed.where("k = n").groupBy("n", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    prefixes = hashed.where("k < n").select(F.col("k").alias("n"), "p1", "p2").distinct()
    kept = whole.join(prefixes, ["n", "p1", "p2"], "left_anti")
    turn = F.struct("turn", "role", "h1", "h2", "text")
    chats = rows.join(kept.select("conv_id", "n_copies"), "conv_id").groupBy("conv_id", "n_copies").agg(F.sort_array(F.collect_set(turn)).alias("turns"))
    said = F.transform("turns", lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n")))
    return chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "n_copies", F.concat_ws("", said).alias("rendered"))
