"""An extension: each micro-batch of arriving candidates is blocked against the static S1 records, with posting caps of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocking


def stream_candidates(arriving: DataFrame, s1: DataFrame, sink) -> object:
    """Starts a query that passes each micro-batch's (s1_id, cand_id, block_score, rank) to ``sink(frame, batch)``."""
    def step(batch: DataFrame, n: int) -> None:
        sink(blocking.candidates(s1.unionByName(batch.select(*s1.columns))), n)

    return arriving.writeStream.foreachBatch(step).start()

