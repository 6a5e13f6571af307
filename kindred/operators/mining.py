"""Training-set mining: pairs, hard negatives, quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import kernels as K
from ..functions import text as T
from ..scratch import Scratch
from . import blocking, features


def training_pairs(candidates: DataFrame, truth: DataFrame, negatives: int = 5, within: int = 20) -> DataFrame:
    """All true pairs, and of each record's best ``within`` candidates the first ``negatives`` that are not true."""
    pos = truth.select("s1_id", "cand_id").distinct().withColumn("label", F.lit(1))
    order = Window.partitionBy("s1_id").orderBy("rank")
    neg = candidates.where(F.col("rank") <= within).join(pos, ["s1_id", "cand_id"], "left_anti").withColumn("n", F.row_number().over(order)).where(F.col("n") <= negatives)
    return pos.union(neg.select("s1_id", "cand_id", F.lit(0).alias("label")))


def score_columns(text: DataFrame) -> DataFrame:
    """(entity_id, source, s): what ``blocking_score`` reads of a record with name and addr."""
    tokens = F.array_distinct(F.filter(T.words(F.col("name")), lambda t: (F.length(t) >= 3) & ~t.isin(*T.STOP)))
    keys = F.array_distinct(blocking.address_keys(F.col("addr"), F.col("business_address")))
    return text.select("entity_id", "source", F.struct("name", tokens.alias("tokens"), keys.alias("keys"), F.array_distinct(T.numbers(F.col("addr"))).alias("nums")).alias("s"))


def blocking_score(a, b):
    """50 for equal names, 8 a shared name token (32 at most), 10 a shared address key (40), 20 for numbers in common or 5 for others."""
    some = (F.size(a["nums"]) > 0) & (F.size(b["nums"]) > 0)
    return (
        F.when((a["name"] != "") & (a["name"] == b["name"]), 50).otherwise(0) + F.least(8 * F.size(F.array_intersect(a["tokens"], b["tokens"])), F.lit(32)) + F.least(10 * F.size(F.array_intersect(a["keys"], b["keys"])), F.lit(40))
        + F.when(some & F.arrays_overlap(a["nums"], b["nums"]), 20).when(some, 5).otherwise(0)
    ).alias("score")


def reverse_mined(records: DataFrame, truth: DataFrame, first: int = 2000, held: int = 80, keep: int = 25) -> DataFrame:
    """(s1_id, cand_id, score, n): of the first ``first`` S1 records, the other records that share a key and are not true.

    The best ``held`` of each source, then the best ``keep`` of all, by (score, cand_id) descending; a bounded set of S1 records
    meets the whole pool, and the pool's records meet those S1 records alone that share a key.
    """
    text = blocking.with_text(records)
    s1 = records.where("source = 'S1'").orderBy("seq", "entity_id").limit(first).select("entity_id")
    ask = blocking.reverse_keys(text.join(s1, "entity_id", "left_semi")).select("country", "kind", "key", F.col("entity_id").alias("s1_id"))
    pool = blocking.reverse_keys(text.where("source <> 'S1'")).select("country", "kind", "key", F.col("entity_id").alias("cand_id"))
    pairs = pool.join(ask, ["country", "kind", "key"]).select("s1_id", "cand_id").distinct().join(truth.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_anti")
    d = score_columns(text)
    both = pairs.join(d.select(F.col("entity_id").alias("s1_id"), F.col("s").alias("a")), "s1_id").join(d.select(F.col("entity_id").alias("cand_id"), "source", F.col("s").alias("b")), "cand_id")
    scored = both.select("s1_id", "cand_id", "source", blocking_score(F.col("a"), F.col("b")))
    best = [F.desc("score"), F.desc("cand_id")]
    heap = scored.withColumn("h", F.row_number().over(Window.partitionBy("source", "s1_id").orderBy(*best))).where(F.col("h") <= held)
    return heap.withColumn("n", F.row_number().over(Window.partitionBy("s1_id").orderBy(*best))).where(F.col("n") <= keep).select("s1_id", "cand_id", "score", "n")


#: Kinds of hard negatives, on the similarity of names (Jaro-Winkler) and of addresses (words in common, sorted words) and on numbers.
HARD = ("number_address_trap", "name_address", "name_conflict")


def retrieved(scratch: Scratch, records: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Described records and the best ``k`` candidates of every S1 record, stored."""
    d = scratch.put(features.described(records, "source", "seq", *(["cross"] if "cross" in records.columns else [])))
    return d, scratch.put(blocking.probed(d.where("source = 'S1'"), blocking.posted(scratch, d), k))


def in_slices(scratch: Scratch, found: DataFrame, d: DataFrame, of, least: int = 2000, most: int = 16) -> DataFrame:
    """``of(candidates, described records)``, stored slice by slice of the S1 records.

    What a slice shuffles goes before the next one comes, so that pairs of one slice are on disk at a time.  A slice has
    ``least`` records or a ``most``-th of them, whichever is more.
    """
    n = min(most, 1 + d.where("source = 'S1'").count() // least)
    parts = [scratch.put(of(found.where(F.pmod(F.xxhash64("s1_id"), F.lit(n)) == i), d)) for i in range(n)]
    return d.sparkSession.read.schema(parts[0].schema).parquet(*[x._kindred_path for x in parts])


def sliced(scratch: Scratch, records: DataFrame, k: int, of=lambda found, d: found, least: int = 2000, most: int = 16) -> DataFrame:
    """``of(candidates, described records)`` of every S1 record, stored slice by slice of the S1 records."""
    d, found = retrieved(scratch, records, k)
    out = in_slices(scratch, found, d, of, least, most)
    scratch.drop(d, found)
    return out


def hard_among(true: DataFrame):
    """What picks hard negatives from candidates and described records."""
    def picked(found, d):
        pairs = found.select("s1_id", "cand_id").join(true.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_anti")
        wide = features.sides(pairs, d.select("entity_id", "name", "addr", "nums", "aw", "stem", "nw", "nt")).select("*", *features.set_features())
        number, conflict = (F.col("exact_number_match") == 1) | (F.col("number_overlap_ratio") >= 0.5), F.col("number_conflict_flag") == 1
        kinds = K.hard_kinds_udf(F.col("a")["name"], F.col("b")["name"], F.col("a")["addr"], F.col("b")["addr"], number, conflict, F.col("address_token_jaccard"))
        flagged = wide.select("s1_id", "cand_id", kinds.alias("kinds")).where("kinds > 0")
        return flagged.select("s1_id", "cand_id", *[(F.col("kinds").bitwiseAND(1 << i) > 0).alias(name) for i, name in enumerate(HARD)])

    return picked


def hard_negatives(records: DataFrame, truth: DataFrame, k: int = 100) -> DataFrame:
    """(s1_id, cand_id, a flag for each kind): candidates among a record's best ``k`` that are not true and that are hard."""
    scratch = Scratch(records.sparkSession)
    true = scratch.put(truth.select("s1_id", "cand_id"))
    out = sliced(scratch, records, k, hard_among(true))
    scratch.drop(true)
    return out


def rule_counts(negatives: DataFrame) -> DataFrame:
    """(n, and how many are of each kind)."""
    return negatives.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(n)).alias(n) for n in HARD])


def first_generation_pairs(records: DataFrame, truth: DataFrame, cap: int, k: int = 20) -> DataFrame:
    """(s1_id, cand_id, rank, label) over a pool of the first ``cap`` records and every true one.

    True pairs that blocking misses come after a record's candidates, by id.
    """
    pool = records.where("source <> 'S1'")
    needed = truth.select(F.col("cand_id").alias("entity_id")).distinct()
    ahead = pool.orderBy("source", "seq", "entity_id").limit(cap)
    held = ahead.unionByName(pool.join(needed, "entity_id", "left_semi").join(ahead.select("entity_id"), "entity_id", "left_anti"))
    found = blocking.candidates(records.where("source = 'S1'").unionByName(held), k).select("s1_id", "cand_id", "rank")
    true = truth.select("s1_id", "cand_id").distinct()
    missed = true.join(found, ["s1_id", "cand_id"], "left_anti").withColumn("m", F.row_number().over(Window.partitionBy("s1_id").orderBy("cand_id")))
    late = missed.join(found.groupBy("s1_id").agg(F.max("rank").alias("last")), "s1_id", "left").select("s1_id", "cand_id", (F.coalesce("last", F.lit(0)) + F.col("m")).alias("rank"))
    return found.union(late).join(true.withColumn("label", F.lit(1)), ["s1_id", "cand_id"], "left").na.fill(0, ["label"])


def waterfall(rows: DataFrame, tests: list, order: list) -> DataFrame:
    """(rows, category): rows in order go to the first category whose test they pass and whose quota is not full.

    ``tests``: (category, condition, quota) each.  A full category lets its rows fall through to the next, which is the same as
    a pass for each category over what the ones before did not take; a pass keeps a quota's rows, never all.
    """
    out, rest = None, rows
    for name, cond, quota_ in tests:
        taken = rest.where(cond).orderBy(*order).limit(quota_).withColumn("category", F.lit(name))
        rest = rest.join(taken.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_anti")
        out = taken if out is None else out.unionByName(taken)
    return out


def mined_positives(records: DataFrame, truth: DataFrame, across: int = 2500, web: int = 5000, shift: int = 15_000) -> DataFrame:
    """(s1_id, cand_id, category) of true pairs: across scripts or by plot code, by website, else a shifted name or address."""
    seq = records.select(F.col("entity_id").alias("s1_id"), "seq")
    pairs = features.paired(truth.select("s1_id", "cand_id").distinct(), records).join(seq, "s1_id")
    a, b = F.col("a"), F.col("b")
    marked = pairs.select("s1_id", "cand_id", "seq", F.coalesce(T.is_cross_script(a, b), F.lit(False)).alias("x"), T.is_website(a["business_name"], b["business_name"]).alias("w"))
    return waterfall(marked, [("cross_script", F.col("x"), across), ("website", F.col("w"), web), ("shift", F.lit(True), shift)], ["seq", "s1_id", "cand_id"]).select("s1_id", "cand_id", "category")


def mined_negatives(records: DataFrame, truth: DataFrame, k: int = 35, foreign: int = 2500, place: int = 15_000, street: int = 10_000) -> DataFrame:
    """(s1_id, cand_id, category) of candidates that are not true: another script, one name in two places, one street with two names."""
    seq = records.select(F.col("entity_id").alias("s1_id"), "seq")
    pairs = blocking.candidates(records, k).join(truth.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_anti")
    wide = features.paired(pairs, records).join(seq, "s1_id")
    a, b = F.col("a"), F.col("b")
    marked = wide.select("s1_id", "cand_id", "seq", "rank", b["foreign"].alias("x"), K.token_sort_udf(a["name"], b["name"]).alias("name"), K.token_set_udf(a["addr"], b["addr"]).alias("addr"))
    tests = [("foreign", F.col("x"), foreign), ("place", (F.col("name") >= 0.8) & (F.col("addr") < 0.45), place), ("street", (F.col("addr") >= 0.65) & (F.col("name") < 0.5), street)]
    return waterfall(marked, tests, ["seq", "s1_id", "rank"]).select("s1_id", "cand_id", "category")


def quota(rows: DataFrame, category: str, quotas: dict[str, int], order: list) -> DataFrame:
    """The first rows of each category, up to its quota."""
    limit = F.create_map(*[x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))])
    w = Window.partitionBy(category).orderBy(*order)
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= F.coalesce(F.element_at(limit, F.col(category)), F.lit(0)))


def shuffled(rows: DataFrame, key: list[str], seed: int = 42) -> DataFrame:
    return rows.orderBy(F.xxhash64(F.lit(seed), *key), *key)


def split(column: str = "s1_id", train: int = 80):
    """True for the records of the training side."""
    return F.conv(F.substring(F.md5(F.col(column).cast("binary")), 1, 4), 16, 10).cast("int") % 100 < train


def positives_of(records: DataFrame, truth: DataFrame, first: int) -> DataFrame:
    """The first ``first`` S1 records in input order and every record that is true for one of them."""
    s1 = records.where("source = 'S1'").orderBy("seq", "entity_id").limit(first).select("entity_id")
    theirs = truth.join(s1.withColumnRenamed("entity_id", "s1_id"), "s1_id", "left_semi").select(F.col("cand_id").alias("entity_id"))
    return records.join(s1.union(theirs).distinct(), "entity_id", "left_semi")
