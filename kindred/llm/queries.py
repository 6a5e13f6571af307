"""The driver's queries for the operators of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bit_sliced, chat, learned_partitions, licenses, packing, paragraphs, simhash, suffix_tree, toxicity, transducer_bpe
from .common import table


def _remainder(n: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op1_lm_scoring(spark, sf_dir):
    return suffix_tree.score(table(spark, sf_dir, "documents").withColumn("held", _remainder(10) == 0))


def op2_ann(spark, sf_dir):
    return learned_partitions.search(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scorer = toxicity.fit(docs.where(_remainder(4) != 2), table(spark, sf_dir, "labels").where(_remainder(4) != 2))
    scored = toxicity.score(docs, scorer)
    return scored.select("doc_id", (_remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_votes")


def op4_topk(spark, sf_dir):
    return bit_sliced.search(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op5_chat(spark, sf_dir):
    return chat.maximal_conversations(table(spark, sf_dir, "conversations"))


def op6_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark, sf_dir):
    """One row per document that loses words: its id, the spans of words cut, how many words they hold, and their clusters."""
    c = paragraphs.cuts(paragraphs.repeats(table(spark, sf_dir, "documents")))
    n_words = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    spans = F.transform("spans", lambda x: F.concat_ws("-", x["start"].cast("string"), x["stop"].cast("string")))
    return c.select("doc_id", F.size("spans").cast("long").alias("n_cut"), n_words.alias("n_words"), F.array_join(spans, ",").alias("cut_words"), F.array_join(F.transform("components", lambda x: x.cast("string")), ",").alias("components"))


def op8_bpe(spark, sf_dir, path: str | None = None):
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return transducer_bpe.digests(table(spark, sf_dir, "documents"), path)


def op9_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_packing(spark, sf_dir):
    """One row per bin; lists as text."""
    bins = packing.pack(table(spark, sf_dir, "documents"))
    return bins.select("bin_id", "capacity", "used", F.size("doc_ids").cast("long").alias("n_pieces"), "doc_ids", "starts", "lengths")


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_ann, op3_toxicity, op4_topk, op5_chat, op6_licenses, op7_substring_dedup, op8_bpe, op9_simhash, op10_packing)}

OP4 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(generate_series(1, len(q.x)), lambda i: q.x[i] * v.x[i])) AS BIGINT) AS score
      FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP5 = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
             string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '') OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS rendered
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
g AS (SELECT n, rendered, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE k = n GROUP BY n, rendered)
SELECT conv_id, n AS n_turns, n_copies, rendered FROM g
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k < p.n AND p.k = g.n AND p.rendered = g.rendered)
"""

ORACLE = {"op4_topk": OP4, "op5_chat": OP5}
