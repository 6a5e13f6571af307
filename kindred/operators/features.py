"""Pair features: built-in expressions on arrays computed once per record; kernels only after top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import text as T
from ..functions.numbers import rounded


def described(records: DataFrame, *more: str) -> DataFrame:
    """Per-record columns that the features read, and ``more``."""
    name, addr = T.business_name(F.col("business_name")), T.address(F.col("business_address"))
    base = records.withColumn("name", name).withColumn("addr", addr)
    return base.select(
        "entity_id", "business_name", "business_address", "country", "name", "addr", T.domain_stem(F.col("business_name")).alias("stem"),
        F.array_distinct(T.numbers(F.col("business_address"))).alias("nums"), F.array_distinct(T.words(F.col("addr"))).alias("aw"), F.array_distinct(T.words(F.col("name"))).alias("nw"),
        F.size(T.words(F.col("name"))).alias("nt"), T.plot_codes(F.col("business_address")).alias("plots"), F.get(T.words(F.col("name")), F.lit(0)).alias("first"), T.has_non_latin(F.concat("business_name", F.lit(" "), "business_address")).alias("foreign"), *more,
    )


def paired(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """(s1_id, cand_id, ...) with both records' columns as structs a and b."""
    return sides(pairs, described(records))


def sides(pairs: DataFrame, d: DataFrame) -> DataFrame:
    """``paired`` of records that are described."""
    side = lambda name, key: d.select(F.col("entity_id").alias(key), F.struct(*[c for c in d.columns if c != "entity_id"]).alias(name))
    return pairs.join(side("a", "s1_id"), "s1_id").join(side("b", "cand_id"), "cand_id")


def _jaccard(x, y, both_empty: float):
    u = F.size(F.array_union(x, y))
    return F.when(u == 0, both_empty).otherwise(F.size(F.array_intersect(x, y)) / u)


def _flag(c):
    return c.cast("double")


def set_features() -> list:
    """The features of the 14 that need no string kernel."""
    a, b = F.col("a"), F.col("b")
    na, nb, la, lb = a["nums"], b["nums"], F.length(a["name"]), F.length(b["name"])
    some = (F.size(na) > 0) & (F.size(nb) > 0)
    most, least = F.greatest(a["nt"], b["nt"]), F.least(a["nt"], b["nt"])
    return [
        _flag((la > 0) & (a["name"] == b["name"])).alias("exact_name_match"),
        _flag((a["stem"] != "") & (a["stem"] == b["stem"])).alias("domain_match_flag"),
        _jaccard(na, nb, 1.0).alias("number_overlap_ratio"),
        _flag(some & (F.array_sort(na) == F.array_sort(nb))).alias("exact_number_match"),
        _flag(some & ~F.arrays_overlap(na, nb)).alias("number_conflict_flag"),
        _jaccard(a["aw"], b["aw"], 1.0).alias("address_token_jaccard"),
        _flag((a["addr"] == "") | (b["addr"] == "")).alias("missing_address_flag"),
        (F.abs(la - lb) / F.greatest(la, lb, F.lit(1))).alias("name_length_diff"),
        F.when(most == 0, 1.0).otherwise(least / F.greatest(most, F.lit(1))).alias("token_count_ratio"),
        _jaccard(a["nw"], b["nw"], 0.0).alias("name_jaccard"),
    ]


def kernel_features() -> list:
    a, b = F.col("a"), F.col("b")
    longest = F.greatest(F.length(a["name"]), F.length(b["name"]))
    both = (a["addr"] != "") & (b["addr"] != "")
    return [
        F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a["name"], b["name"]) / longest).alias("levenshtein_ratio"),
        K.jaro_winkler_udf(a["name"], b["name"]).alias("jaro_winkler"), K.token_sort_udf(a["name"], b["name"]).alias("token_sort_ratio"), K.token_set_udf(a["name"], b["name"]).alias("token_set_ratio"),
        F.when(both, K.token_sort_udf(a["addr"], b["addr"])).otherwise(0.0).alias("address_token_sort_ratio"), K.ratio_udf(a["name"], b["name"]).alias("name_ratio"), K.token_set_udf(a["addr"], b["addr"]).alias("addr_token_set"),
    ]


def first_generation() -> list:
    """Set-based features of the 21-column vector that the 14 lack."""
    a, b = F.col("a"), F.col("b")
    tri = lambda x, y: F.when((F.size(x) == 0) | (F.size(y) == 0), 0.5).when(F.arrays_overlap(x, y), 1.0).otherwise(0.0)
    some = (F.size(a["plots"]) > 0) & (F.size(b["plots"]) > 0)
    least = F.least(F.size(a["nw"]), F.size(b["nw"]))
    first = F.coalesce((a["first"] == b["first"]) & (F.length(a["first"]) > 0), F.lit(False))
    street = F.filter(F.array_intersect(a["aw"], b["aw"]), lambda w: (F.length(w) > 3) & ~w.isin(*T.GENERIC))
    return [
        _flag(first).alias("name_first_word_match"), F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a["nw"], b["nw"])) / F.greatest(least, F.lit(1))).alias("name_containment_ratio"), tri(a["nums"], b["nums"]).alias("number_match"),
        tri(a["plots"], b["plots"]).alias("plot_code_match"), _flag(some & ~F.arrays_overlap(a["plots"], b["plots"])).alias("plot_code_conflict"), _flag(first & F.arrays_overlap(a["nums"], b["nums"])).alias("exact_first_word_and_number"),
        _flag(F.upper(a["country"]) == F.upper(b["country"])).alias("country_match"), _flag(a["foreign"] | b["foreign"]).alias("non_latin_flag"), (F.lit(1.0) / F.col("rank")).alias("reciprocal_rank"), _flag(F.size(street) > 0).alias("has_matching_street_token"),
    ]


def domain_link():
    """1 if one name is a domain and its stem is in the other, or like it; or if either holds a web ending and the names are alike."""
    a, b = F.col("a"), F.col("b")
    like = lambda x, y, least: K.token_sort_udf(x, y) >= least
    one = lambda x, y: y["name"].contains(F.replace(x["stem"], F.lit("-"), F.lit(" "))) | like(F.replace(x["stem"], F.lit("-"), F.lit(" ")), y["name"], 0.75)
    web = F.lower(F.concat_ws(" ", a["business_name"], b["business_name"])).rlike(r"\.(?:com|in|org|net)")
    here, there = a["stem"] != "", b["stem"] != ""
    return _flag(F.when(here & ~there, one(a, b)).when(there & ~here, one(b, a)).otherwise(web & like(a["name"], b["name"], 0.7))).alias("domain_match")


def scorecard():
    """A transparent logistic score of set features."""
    z = -4.0 + 3.0 * F.col("exact_name_match") + 3.0 * F.col("name_jaccard") + 4.0 * F.col("address_token_jaccard") - 1.0 * F.col("number_conflict_flag")
    return rounded(1 / (1 + F.exp(-z)), 6).alias("p")
