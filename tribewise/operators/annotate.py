"""Human-annotation tasks and their evaluation.

* Random choices are hashes: ``md5(seed|cluster|key)`` orders the candidates
  and the shuffled task items, so a task is reproducible and independent of
  partitioning.
* Intruder eligibility is a band join (count within mean +- stddev of the
  cluster's top members, other cluster).  All bands have the same width, so
  counts are bucketized by that width and each band touches at most two
  buckets: an equi-join on the bucket plus a filter, never a cross join.
* Agreement (Fleiss' kappa, Gwet's AC1) is computed from the (item, category)
  count table after ``unpivot``; only closed forms, no driver loop.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = "key"
CLUSTER = "cluster"
COUNT = "count"


def assignments_with_counts(assignments: DataFrame, counts: DataFrame, key_col: str = KEY) -> DataFrame:
    """Cluster assignments joined to popularity counts (inner, on the key)."""
    return assignments.join(counts, key_col)


def label_task(assignments: DataFrame, model_name: str, key_col: str = KEY, cluster_col: str = CLUSTER,
               count_col: str | None = COUNT) -> DataFrame:
    """A10: per cluster, blank-joined members (by count desc, key asc when a
    count column is given, else by key) plus empty annotator columns."""
    order = ([F.col(count_col).desc()] if count_col else [])
    key_str = F.col(key_col).cast("string")
    if count_col:
        members = F.transform(F.sort_array(F.collect_list(F.struct((-F.col(count_col)).alias("o"), key_str.alias("k")))),
                              lambda s: s["k"])
    else:
        members = F.sort_array(F.collect_list(key_str))
    del order
    g = assignments.groupBy(cluster_col).agg(F.array_join(members, " ").alias("members"))
    return g.select(F.lit(model_name).alias("model_id"), F.col(cluster_col).alias("cluster_id"), "members",
                    F.lit("").alias("coherent"), F.lit("").alias("cluster_label"))


def top_members(assignments: DataFrame, n: int, key_col: str = KEY, cluster_col: str = CLUSTER,
                count_col: str = COUNT) -> DataFrame:
    """The n most popular members per cluster (count desc, key asc) with their rank."""
    w = Window.partitionBy(cluster_col).orderBy(F.col(count_col).desc(), F.col(key_col).asc())
    return assignments.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def eligible_intruders(assignments: DataFrame, n: int = 5, key_col: str = KEY, cluster_col: str = CLUSTER,
                       count_col: str = COUNT) -> DataFrame:
    """(cluster, candidate key, candidate count) for keys of other clusters
    whose count lies within mean(top-n counts of the cluster) +- stddev(all counts)."""
    sd = assignments.select(F.stddev_samp(count_col)).scalar()
    top = top_members(assignments, n, key_col, cluster_col, count_col)
    bands = (top.groupBy(cluster_col).agg(F.avg(count_col).alias("_mean"), F.count(F.lit(1)).alias("_members"))
             .withColumn("_sd", sd)
             .withColumn("_lo", F.col("_mean") - F.col("_sd")).withColumn("_hi", F.col("_mean") + F.col("_sd")))
    width = F.when(F.col("_w") > 0, F.col("_w")).otherwise(F.lit(1.0))
    cand = assignments.select(F.col(key_col).alias("candidate"), F.col(cluster_col).alias("_cc"),
                              F.col(count_col).alias("candidate_count")).withColumn("_w", 2 * sd)
    cand = cand.withColumn("_bucket", F.floor(F.col("candidate_count") / width))
    bands = bands.withColumn("_w", 2 * F.col("_sd")).withColumn(
        "_bucket", F.explode(F.array(F.floor(F.col("_lo") / width), F.floor(F.col("_lo") / width) + 1,
                                     F.floor(F.col("_hi") / width))))
    bands = bands.dropDuplicates([cluster_col, "_bucket"])
    j = bands.join(cand.drop("_w"), "_bucket")
    return (j.where((F.col("candidate_count") >= F.col("_lo")) & (F.col("candidate_count") <= F.col("_hi"))
                    & (F.col("_cc") != F.col(cluster_col)))
            .select(cluster_col, "candidate", "candidate_count", "_members"))


def _md5_order(seed, *cols):
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def intruder_task(assignments: DataFrame, model_name: str, n: int = 5, seed: int = 0, key_col: str = KEY,
                  cluster_col: str = CLUSTER, count_col: str = COUNT) -> tuple[DataFrame, DataFrame]:
    """(task, answers).

    Clusters with fewer than n members or without an eligible intruder are
    skipped.  The intruder is the eligible key with the smallest
    md5(seed|cluster|key); the n + 1 items are shown in md5(seed|cluster|key)
    order and the answer is the intruder's 1-based position.
    """
    top = top_members(assignments, n, key_col, cluster_col, count_col)
    full = top.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") >= n).drop("_m")
    elig = eligible_intruders(assignments, n, key_col, cluster_col, count_col).join(full, cluster_col)
    pick = (elig.withColumn("_h", _md5_order(seed, cluster_col, "candidate"))
            .groupBy(cluster_col).agg(F.min_by("candidate", "_h").alias("intruder")))
    items = (top.join(pick, cluster_col).select(cluster_col, F.col(key_col).cast("string").alias("item"),
                                                F.lit(False).alias("is_intruder"))
             .unionByName(pick.select(cluster_col, F.col("intruder").cast("string").alias("item"),
                                      F.lit(True).alias("is_intruder"))))
    items = items.withColumn("_h", _md5_order(seed, cluster_col, "item"))
    grouped = items.groupBy(cluster_col).agg(F.sort_array(F.collect_list(F.struct("_h", "item", "is_intruder"))).alias("_s"))
    cols = [F.col("_s")[i]["item"].alias(f"item_{i + 1}") for i in range(n + 1)]
    pos = F.array_position(F.transform("_s", lambda s: s["is_intruder"]), F.lit(True)).cast("bigint")
    base = grouped.select(F.lit(model_name).alias("model_id"), F.col(cluster_col).alias("cluster_id"), *cols,
                          pos.alias("intruder_position"))
    task = base.drop("intruder_position").withColumn("intruder_annotated", F.lit(""))
    return task, base


def coherence_scores(ratings: DataFrame, rater_cols: list[str]) -> DataFrame:
    """Coherence score (sum of the raters' 0/1 votes) and model precision (score / #raters)."""
    total = sum((F.col(c) for c in rater_cols[1:]), F.col(rater_cols[0]))
    return ratings.withColumn("coherence_score", total).withColumn(
        "model_precision", F.col("coherence_score") / F.lit(float(len(rater_cols))))


def agreement(ratings: DataFrame, item_col: str, rater_cols: list[str]) -> DataFrame:
    """One row (raters, items, observed_agreement, fleiss_kappa, gwet_ac1).

    Closed forms with missing ratings: r_ik of the r_i raters of item i chose
    category k.  p_a is the mean of sum_k r_ik (r_ik - 1) / (r_i (r_i - 1)) over
    items with two ratings or more, pi_k the mean of r_ik / r_i over items with
    any; Fleiss p_e = sum_k pi_k^2, Gwet p_e = sum_k pi_k (1 - pi_k) / (q - 1)
    with q the number of categories seen.  ``items`` counts items with any rating.
    """
    long = ratings.unpivot([item_col], rater_cols, "rater", "category").where(F.col("category").isNotNull())
    cells = long.groupBy(item_col, "category").agg(F.count(F.lit(1)).alias("r_ik"))
    per_item = cells.groupBy(item_col).agg(F.sum("r_ik").alias("r_i"), F.sum(F.col("r_ik") * (F.col("r_ik") - 1)).alias("_agree"))
    pa = per_item.agg(F.count(F.lit(1)).alias("items"), F.avg(F.when(
        F.col("r_i") > 1, F.col("_agree") / (F.col("r_i") * (F.col("r_i") - 1)))).alias("p_a"))
    n_items = per_item.select(F.count(F.lit(1))).scalar()
    pik = (cells.join(per_item, item_col).groupBy("category")
           .agg((F.sum(F.col("r_ik") / F.col("r_i")) / n_items).alias("pi")))
    pe = pik.agg(F.sum(F.col("pi") * F.col("pi")).alias("pe_f"),
                 F.sum(F.col("pi") * (1 - F.col("pi"))).alias("_g"), F.count(F.lit(1)).alias("q"))
    j = pa.withColumn("_k", F.lit(1)).join(pe.withColumn("_k", F.lit(1)), "_k")
    pe_g = F.when(F.col("q") > 1, F.col("_g") / (F.col("q") - 1)).otherwise(F.lit(0.0))
    return j.select(F.lit(",".join(rater_cols)).alias("raters"), "items",
                    F.col("p_a").alias("observed_agreement"),
                    F.try_divide(F.col("p_a") - F.col("pe_f"), 1 - F.col("pe_f")).alias("fleiss_kappa"),
                    F.try_divide(F.col("p_a") - pe_g, 1 - pe_g).alias("gwet_ac1"))


def pairwise_agreement(ratings: DataFrame, item_col: str, rater_cols: list[str]) -> DataFrame:
    """M19 for every pair of raters, one row each."""
    return reduce(DataFrame.unionByName, [agreement(ratings, item_col, list(pair)) for pair in combinations(rater_cols, 2)])


def landis_koch(coef) -> F.Column:
    """Landis-Koch band of a coefficient (fixed values: the published scale)."""
    c = F.col(coef) if isinstance(coef, str) else coef
    return (F.when(c < 0, "Poor").when(c <= 0.2, "Slight").when(c <= 0.4, "Fair").when(c <= 0.6, "Moderate")
            .when(c <= 0.8, "Substantial").otherwise("Almost Perfect"))


def intruder_precision(answers: DataFrame, key: DataFrame, id_cols: list[str], annotator_cols: list[str],
                       answer_col: str = "intruder_position") -> DataFrame:
    """Per task row, matches of each annotator with the key (a cell that
    is not a number counts as no match), precision = matches / #annotators."""
    j = answers.join(key.select(*id_cols, answer_col), id_cols)
    hits = [F.coalesce((F.col(c).try_cast("bigint") == F.col(answer_col)).cast("int"), F.lit(0)) for c in annotator_cols]
    total = sum(hits[1:], hits[0])
    return j.withColumn("matches", total).withColumn("model_precision", F.col("matches") / float(len(annotator_cols)))


def precision_summary(scored: DataFrame, col: str = "model_precision") -> DataFrame:
    """M23 over all task rows: (rows, mean, stddev) with the sample standard deviation."""
    return scored.agg(F.count(col).alias("rows"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("stddev"))


def selection_union(df: DataFrame, key_col: str, cluster_col: str, keys: DataFrame, clusters: DataFrame) -> DataFrame:
    """Rows of the selected keys plus rows of the selected clusters, without duplicates."""
    a = df.join(keys.select(key_col).distinct(), key_col, "leftsemi")
    b = df.join(clusters.select(cluster_col).distinct(), cluster_col, "leftsemi")
    return a.unionByName(b).distinct()
