"""Evaluation: entity F-beta, sweeps, recall, confusion, distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import rounded

B2 = 0.25  # beta squared


def f_half(truth, pred):
    """F0.5 of two id lists; empty against empty is 1."""
    tp = F.size(F.array_intersect(truth, pred))
    p, r = tp / F.size(pred), tp / F.size(truth)
    return F.when(F.size(truth) == 0, (F.size(pred) == 0).cast("double")).when((F.size(pred) == 0) | (tp == 0), 0.0).otherwise((1 + B2) * p * r / (B2 * p + r))


def f_counts(n_true, n_pred, tp):
    p, r = tp / n_pred, tp / n_true
    return F.when(n_true == 0, (n_pred == 0).cast("double")).when(tp == 0, 0.0).otherwise((1 + B2) * p * r / (B2 * p + r))


def by_entity(s1: DataFrame, truth: DataFrame, pred: DataFrame) -> DataFrame:
    """(s1_id, n_true, n_pred, tp, f05) of every S1 record, from pairs."""
    t = truth.groupBy("s1_id").agg(F.collect_set("cand_id").alias("t"))
    q = pred.groupBy("s1_id").agg(F.collect_set("cand_id").alias("q"))
    none = F.array().cast("array<string>")
    both = s1.join(t, "s1_id", "left").join(q, "s1_id", "left").withColumn("t", F.coalesce("t", none)).withColumn("q", F.coalesce("q", none))
    return both.select("s1_id", F.size("t").alias("n_true"), F.size("q").alias("n_pred"), F.size(F.array_intersect("t", "q")).alias("tp"), rounded(f_half(F.col("t"), F.col("q")), 6).alias("f05"))


def macro(entities: DataFrame) -> DataFrame:
    single = F.col("n_true") == 0
    return entities.agg(F.count(F.lit(1)).alias("n_entities"), rounded(F.avg("f05"), 6).alias("macro_f05"), rounded(F.avg(F.when(single, F.col("f05"))), 6).alias("singleton_f05"), rounded(F.avg(F.when(~single, F.col("f05"))), 6).alias("matched_f05"))


def sweep(s1: DataFrame, truth: DataFrame, scored: DataFrame, grid: DataFrame) -> DataFrame:
    """macro-F0.5 at every (tau, m) of a small grid, in one pass: a record's pairs are counted for all points at once."""
    points = [(r.tau, r.m) for r in grid.collect()]  # the grid is the caller's, a few dozen points
    hits = truth.select("s1_id", "cand_id").distinct().withColumn("hit", F.lit(True))
    marked = scored.select("s1_id", "cand_id", "p").join(hits, ["s1_id", "cand_id"], "left").withColumn("gap", rounded(F.max("p").over(Window.partitionBy("s1_id")) - F.col("p"), 6))
    at = [(F.col("p") >= tau) & (F.col("gap") <= m) for tau, m in points]
    counts = marked.groupBy("s1_id").agg(*[F.count_if(c).alias(f"n{i}") for i, c in enumerate(at)], *[F.count_if(c & F.coalesce("hit", F.lit(False))).alias(f"t{i}") for i, c in enumerate(at)])
    records = s1.join(truth.groupBy("s1_id").agg(F.countDistinct("cand_id").alias("n_true")), "s1_id", "left").join(counts, "s1_id", "left").na.fill(0)
    cells = F.array(*[F.struct(F.lit(float(tau)).alias("tau"), F.lit(float(m)).alias("m"), F.col(f"n{i}").alias("n"), F.col(f"t{i}").alias("tp")) for i, (tau, m) in enumerate(points)])
    each = records.select("n_true", F.explode(cells).alias("x")).select("n_true", "x.*")
    return each.groupBy("tau", "m").agg(
        rounded(F.avg(f_counts(F.col("n_true"), F.col("n"), F.col("tp"))), 6).alias("macro_f05"), F.sum("n").cast("long").alias("predicted_links"), F.count_if(F.col("n") > 0).alias("s1_with_predictions"),
    )


def best_of_sweep(swept: DataFrame) -> DataFrame:
    """The row of the highest macro-F0.5; of equals the first of the grid."""
    return swept.orderBy(F.desc("macro_f05"), "tau", "m").limit(1)


def recall(s1: DataFrame, truth: DataFrame, pairs: DataFrame) -> DataFrame:
    hit = truth.join(pairs.select("s1_id", "cand_id").distinct().withColumn("hit", F.lit(1)), ["s1_id", "cand_id"], "left")
    per = hit.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("hit", F.lit(0))).alias("h"))
    t = per.agg(F.count(F.lit(1)).alias("entities_with_truth"), F.sum("n").alias("true_links"), F.sum("h").alias("captured_links"), rounded(F.sum("h") / F.sum("n"), 6).alias("link_recall"), rounded(F.avg((F.col("h") == F.col("n")).cast("double")), 6).alias("entity_recall"))
    c = pairs.agg(F.count(F.lit(1)).alias("candidate_pairs"))
    n = s1.agg(F.count(F.lit(1)).alias("n_s1"))
    return t.join(c).join(n).withColumn("avg_candidates", rounded(F.col("candidate_pairs") / F.col("n_s1"), 6))


def outcome(scored: DataFrame, truth: DataFrame, tau: float) -> DataFrame:
    """Scored pairs with their outcome; FN are retrieved pairs only."""
    marked = scored.join(truth.select("s1_id", "cand_id").distinct().withColumn("hit", F.lit(True)), ["s1_id", "cand_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    yes = F.col("p") >= tau
    return marked.withColumn("outcome", F.when(yes & F.col("hit"), "TP").when(yes, "FP").when(F.col("hit"), "FN").otherwise("TN"))


def distribution(marked: DataFrame) -> DataFrame:
    return marked.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("p"), 6).alias("mean"), rounded(F.median("p"), 6).alias("median"), F.min("p").alias("least"), F.max("p").alias("most"))


def histogram(scored: DataFrame, edges: list[float]) -> DataFrame:
    """Right-closed bins; the first holds its left edge too."""
    bin_ = F.when(F.col("p") < edges[0], None)
    for i in range(1, len(edges)):
        bin_ = bin_.when(F.col("p") <= edges[i], i - 1)
    return scored.withColumn("bin", bin_).where("bin IS NOT NULL").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def auc(marked: DataFrame) -> DataFrame:
    """Exact ROC AUC by rank sums, ties averaged; ranks come from counts by score, not from a global sort of rows."""
    by = marked.groupBy("p").agg(F.sum(F.col("hit").cast("long")).alias("pos"), F.sum((~F.col("hit")).cast("long")).alias("neg"))
    below = by.withColumn("under", F.sum("neg").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)))
    return below.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), rounded(F.sum(F.col("pos") * (F.coalesce("under", F.lit(0)) + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg")), 6).alias("auc"))


def conflicts(featured: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    flags = {"number_conflict": F.col("number_conflict_flag") == 1, "no_overlap": F.col("number_overlap_ratio") == 0, "exact_number": F.col("exact_number_match") == 1, "missing_address": F.col("missing_address_flag") == 1, "exact_name": F.col("exact_name_match") == 1, "low_address": F.col("address_token_jaccard") < 0.3}
    return featured.agg(n.alias("n"), *[x for k, c in flags.items() for x in (F.count_if(c).alias(k), rounded(100 * F.count_if(c) / n, 6).alias(f"{k}_pct"))])


def threshold_counts(scored: DataFrame, taus) -> DataFrame:
    """(tau, n): pairs of at least tau, all from one pass."""
    row = scored.agg(*[F.count_if(F.col("p") >= t).alias(f"n{i}") for i, t in enumerate(taus)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(float(t)).alias("tau"), F.col(f"n{i}").alias("n")) for i, t in enumerate(taus)])).alias("x")).select("x.*")


def _share(part, whole):
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def average_precision(marked: DataFrame) -> DataFrame:
    """Area under the steps of precision over recall; pairs of one score enter together, and only counts by score are ordered."""
    by = marked.groupBy("p").agg(F.sum(F.col("hit").cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    down = Window.orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    step = by.withColumn("precision", F.sum("pos").over(down) / F.sum("n").over(down))
    return step.agg(rounded(_share(F.sum(F.col("pos") * F.col("precision")), F.sum("pos")), 6).alias("average_precision"))


def class_report(marked: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of either class, from the outcomes."""
    n = {k: F.col(k) for k in ("TP", "FP", "FN", "TN")}
    counts = marked.agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in n])
    sides = [(1, n["TP"], n["FP"], n["FN"]), (0, n["TN"], n["FN"], n["FP"])]
    rows = [F.struct(F.lit(label).alias("label"), _share(hit, hit + wrong).alias("p"), _share(hit, hit + lost).alias("r"), (hit + lost).alias("support")) for label, hit, wrong, lost in sides]
    x = counts.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    f1 = _share(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))
    return x.select("label", rounded("p", 6).alias("precision"), rounded("r", 6).alias("recall"), rounded(f1, 6).alias("f1"), "support")


def false_positive_details(marked: DataFrame, records: DataFrame) -> DataFrame:
    """False positives with the raw fields of both records; a record that is missing leaves nulls."""
    side = lambda key, x: records.select(F.col("entity_id").alias(key), F.col("business_name").alias(f"{x}_name"), F.col("business_address").alias(f"{x}_address"))
    return marked.where("outcome = 'FP'").select("s1_id", "cand_id", "p").join(side("s1_id", "s1"), "s1_id", "left").join(side("cand_id", "cand"), "cand_id", "left")


def negative_profile(featured: DataFrame, truth: DataFrame) -> DataFrame:
    """How many pairs that are not true look alike in name and address though their numbers conflict."""
    rest = featured.join(truth.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_anti")
    conflict, address, name = F.col("number_conflict_flag") == 1, F.col("address_token_jaccard") >= 0.5, F.col("jaro_winkler") >= 0.9
    flags = {"number_conflict": conflict, "conflict_high_jaccard": conflict & address, "conflict_high_name": conflict & name, "extreme": conflict & address & name}
    return rest.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in flags.items()])


def targeted_pool(records: DataFrame, truth: DataFrame, distractors: int) -> DataFrame:
    """The S1 records, every true target, and the first ``distractors`` other records by source and input order."""
    needed = truth.select(F.col("cand_id").alias("entity_id")).distinct()
    pool = records.where("source <> 'S1'")
    rest = pool.join(needed, "entity_id", "left_anti").orderBy("source", "seq", "entity_id").limit(distractors)
    return records.where("source = 'S1'").unionByName(pool.join(needed, "entity_id", "left_semi")).unionByName(rest)
