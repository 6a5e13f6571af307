"""Decision rules over scored pairs (s1_id, cand_id, rank, p)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import kernels as K
from ..functions.numbers import rounded


def best(tie: str = "cand_id"):
    return Window.partitionBy("s1_id").orderBy(F.desc("p"), "rank", tie)


def threshold(scored: DataFrame, tau: float) -> DataFrame:
    return scored.where(F.col("p") >= tau)


def margin(scored: DataFrame, tau: float, m: float) -> DataFrame:
    """At least tau, and within m of the best."""
    return scored.withColumn("top", F.max("p").over(Window.partitionBy("s1_id"))).where((F.col("p") >= tau) & (rounded(F.col("top") - F.col("p"), 6) <= m)).drop("top")


def strict_top1(scored: DataFrame, tau: float = 0.70, second: float = 0.88, m: float = 0.04) -> DataFrame:
    ranked = scored.withColumn("place", F.row_number().over(best())).withColumn("top", F.max("p").over(Window.partitionBy("s1_id")))
    return ranked.where(((F.col("place") == 1) & (F.col("p") >= tau)) | ((F.col("place") > 1) & (F.col("top") >= tau) & (F.col("p") >= second) & (rounded(F.col("top") - F.col("p"), 6) <= m))).drop("place", "top")


def attenuated(scored: DataFrame) -> DataFrame:
    """Pairs whose plot codes are both there and unequal lose most of their score.  Reads a and b of features.paired()."""
    x, y = F.array_sort(F.col("a.plots")), F.array_sort(F.col("b.plots"))
    return scored.withColumn("p", F.when((F.size(x) > 0) & (F.size(y) > 0) & (x != y), F.least(0.15 * F.col("p"), F.lit(0.25))).otherwise(F.col("p")))


def band(p="p", high: float = 0.88, low: float = 0.35):
    return F.when(F.col(p) >= high, "clear_match").when(F.col(p) < low, "reject").otherwise("borderline")


def vetoes() -> dict:
    """Post-model vetoes on number features."""
    conflict, overlap, same = F.col("number_conflict_flag") == 1, F.col("number_overlap_ratio"), F.col("exact_number_match") == 1
    return {"conflict": ~conflict, "conflict_unless_sure": ~(conflict & (F.col("p") < 0.97)), "overlap": ~(conflict & (overlap == 0)), "inexact": ~(~same & conflict)}


def lists(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """(s1_id, seq, ids): every S1 record in input order, its ids sorted and distinct, blank lists kept."""
    got = pairs.groupBy("s1_id").agg(F.array_sort(F.collect_set("cand_id")).alias("ids"))
    all_ = records.where("source = 'S1'").select(F.col("entity_id").alias("s1_id"), "seq")
    return all_.join(got, "s1_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))


def trimmed_candidates(scored: DataFrame, accepted: DataFrame, by: str = "p") -> DataFrame:
    """Candidate lists for output: three best and the accepted where a record matched, else two."""
    order = Window.partitionBy("s1_id").orderBy(*([F.desc("p")] if by == "p" else []), "rank", "cand_id")
    hits = accepted.select("s1_id", "cand_id", F.lit(True).alias("hit"))
    ranked = scored.join(hits, ["s1_id", "cand_id"], "left").withColumn("place", F.row_number().over(order)).withColumn("any", F.max(F.coalesce("hit", F.lit(False))).over(Window.partitionBy("s1_id")))
    kept = ranked.where(F.col("hit") | (F.col("place") <= F.when(F.col("any"), 3).otherwise(2)))
    return kept.groupBy("s1_id").agg(F.array_sort(F.collect_list(F.struct("place", "cand_id"))).alias("c")).select("s1_id", F.col("c.cand_id").alias("ids"))


def borderline(candidates: DataFrame, accepted: DataFrame) -> DataFrame:
    """(s1_id, cand_id, case_type): the first candidate of a record without match, else its first that did not match."""
    rest = candidates.join(accepted.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_anti")
    matched = accepted.select("s1_id", F.lit("secondary_candidate").alias("case_type")).distinct()
    first = rest.groupBy("s1_id").agg(F.min_by("cand_id", F.struct("rank", "cand_id")).alias("cand_id"))
    return first.join(matched, "s1_id", "left").select("s1_id", "cand_id", F.coalesce("case_type", F.lit("rejected_top1")).alias("case_type"))


def patched(predictions: DataFrame, verdicts: DataFrame, sure: float = 0.70) -> DataFrame:
    """Applies the last verdict (s1_id, line, cand_id, is_match, confidence) of each record to its list of ids."""
    last = verdicts.groupBy("s1_id").agg(F.max_by(F.struct("cand_id", "is_match", "confidence"), "line").alias("v"))
    v = F.col("v")
    ids = F.when(v["is_match"] & (v["confidence"] >= sure), F.array(v["cand_id"])).when(~v["is_match"], F.array().cast("array<string>")).otherwise(F.col("ids"))
    return predictions.join(last, "s1_id", "left").withColumn("ids", ids).drop("v")


def merged(s1: DataFrame, matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """(s1_id, seq, ids, cand_ids): matches missing from the candidates are appended to them."""
    none = F.array().cast("array<string>")
    out = s1.join(matches.select("s1_id", "ids"), "s1_id", "left").join(candidates.select("s1_id", F.col("ids").alias("c")), "s1_id", "left")
    return out.select("s1_id", "seq", F.coalesce("ids", none).alias("ids"), F.array_union(F.coalesce("c", none), F.coalesce("ids", none)).alias("cand_ids"))


RULES = ("v1_missing_or_repeated", "v2_unknown_s1", "v3_unknown_id", "v4_repeats", "v5_self", "v6_not_candidate")


def violations(s1: DataFrame, others: DataFrame, lists_: DataFrame) -> DataFrame:
    """(rule, n): breaches of the submission rules by (s1_id, ids, cand_ids).

    Three passes, none of them over what made the lists twice if those are stored: lists against records, ids against the
    pool, and the rules that a list can break on its own.
    """
    seen = lists_.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"))
    both = s1.select("s1_id", F.lit(True).alias("known")).join(seen, "s1_id", "full")
    one = both.agg(F.count_if(F.col("known") & (F.coalesce("n", F.lit(0)) != 1)).alias(RULES[0]), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias(RULES[1]))
    ids = lists_.select(F.explode("ids").alias("entity_id")).join(others.select("entity_id"), "entity_id", "left_anti").agg(F.count(F.lit(1)).alias(RULES[2]))
    own = lists_.agg(
        F.count_if(F.size("ids") != F.size(F.array_distinct("ids"))).alias(RULES[3]),
        F.coalesce(F.sum(F.size(F.filter("ids", lambda x: x == F.col("s1_id")))), F.lit(0)).cast("long").alias(RULES[4]),
        F.count_if(F.size(F.array_except("ids", "cand_ids")) > 0).alias(RULES[5]),
    )
    row = one.join(ids).join(own)  # one row each
    return row.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).cast("long").alias("n")) for r in RULES])).alias("x")).select("x.*")


def binary(p="p", tau: float = 0.5):
    return F.when(F.col(p) >= tau, "match").otherwise("reject")


def ranked_borderline(cases: DataFrame, records: DataFrame, most: int = 15_000) -> DataFrame:
    """The ``most`` borderline cases whose raw names are most alike, cases without any match ahead by 0.15; ties by ids."""
    side = lambda key, x: records.select(F.col("entity_id").alias(key), F.coalesce("business_name", F.lit("")).alias(x))
    both = cases.join(side("s1_id", "x"), "s1_id").join(side("cand_id", "y"), "cand_id")
    alike = 0.5 * K.jaro_winkler_udf("x", "y") + 0.5 * K.token_sort_udf("x", "y") + F.when(F.col("case_type") == "rejected_top1", 0.15).otherwise(0.0)
    return both.select("s1_id", "cand_id", "case_type", rounded(alike, 6).alias("similarity")).orderBy(F.desc("similarity"), "s1_id", "cand_id").limit(most)
