"""Comparing clusterings.

Clusterings are long tables ``(key, cluster)``; counts are ``(key, n)``.
Everything reduces to the contingency table, whose size is bounded by
(#clusters_1 x #clusters_2), never by the number of keys; the key-level work
is one equi-join (intersection) or full outer join (union) on the key.

Metric definitions follow the reference:
* contingency cell += n1 + n2 for keys whose two counts are both > 0;
* cluster probabilities from each clustering's own counts;
* mutual information in bits summing only the positive cell terms
  (``mode="positive"``, the reference's behaviour) or all terms (``"full"``);
* VI = H1 + H2 - 2 MI (bits);
* adjusted Rand, Rand, NMI (arithmetic mean), homogeneity, completeness and
  V-measure with the same closed forms and edge cases as scikit-learn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tribewise import schemas as S
from tribewise.session import cut_lineage, drop_state

UNION_UNIFORM = "union_uniform_probability"
INTERSECT_UNIFORM = "intersection_uniform_probability"
INTERSECT_COMMENT_PROB = "intersection_comment_probability"
METRIC_NAMES = ("adjusted_rand_index", "rand_index", "normalized_mutual_info", "homogeneity",
                "completeness", "v_measure", "variation_of_information")


def remap_clusters(m1: DataFrame, m2: DataFrame, key_col: str = "key", cluster_col: str = "cluster",
                   use_union: bool = False, missing: int = S.MISSING_CLUSTER) -> DataFrame:
    """(key, c1, c2) over the intersection (inner join) or the union
    (full outer join, ``missing`` for a key absent from one side)."""
    a = m1.select(F.col(key_col).alias("key"), F.col(cluster_col).alias("c1"))
    b = m2.select(F.col(key_col).alias("key"), F.col(cluster_col).alias("c2"))
    if not use_union:
        return a.join(b, "key", "inner")
    t1, t2 = a.schema["c1"].dataType, b.schema["c2"].dataType
    return a.join(b, "key", "full").select(
        "key", F.coalesce("c1", F.lit(missing).cast(t1)).alias("c1"),
        F.coalesce("c2", F.lit(missing).cast(t2)).alias("c2"))


def attach_counts(remapped: DataFrame, counts1: DataFrame, counts2: DataFrame, key_col: str = "key",
                  count_col: str = "n") -> DataFrame:
    """Adds n1, n2 per key (0 for a key without a count)."""
    c1 = counts1.select(F.col(key_col).alias("key"), F.col(count_col).alias("n1"))
    c2 = counts2.select(F.col(key_col).alias("key"), F.col(count_col).alias("n2"))
    return (remapped.join(c1, "key", "left").join(c2, "key", "left")
            .withColumn("n1", F.coalesce("n1", F.lit(0)).cast("bigint"))
            .withColumn("n2", F.coalesce("n2", F.lit(0)).cast("bigint")))


def _weights(df: DataFrame):
    if "n1" in df.columns:
        return F.col("n1"), F.col("n2")
    return F.lit(1).cast("bigint"), F.lit(1).cast("bigint")


def contingency_table(remapped: DataFrame) -> DataFrame:
    """(c1, c2, n) with n = sum(n1 + n2) over keys where both counts > 0
    (unit counts when the frame has no n1/n2)."""
    w1, w2 = _weights(remapped)
    return (remapped.where((w1 > 0) & (w2 > 0)).groupBy("c1", "c2")
            .agg(F.sum(w1 + w2).cast("bigint").alias("n")))


def cluster_probabilities(remapped: DataFrame, side: str = "c1") -> DataFrame:
    """(cluster, p) share of the side's weight per cluster."""
    w1, w2 = _weights(remapped)
    w = w1 if side == "c1" else w2
    sums = remapped.groupBy(side).agg(F.sum(w).alias("_w"))
    total = remapped.select(F.sum(w)).scalar()
    return sums.select(F.col(side).alias("cluster"), F.try_divide(F.col("_w"), total.cast("double")).alias("p"))


def key_probabilities(keys: DataFrame, counts: DataFrame, key_col: str = "key", count_col: str = "n",
                      default: int = 0) -> DataFrame:
    """Normalized counts over a key list, ``default`` for missing keys;
    a zero total gives null (no division error under ANSI)."""
    j = keys.select(key_col).join(counts.select(key_col, count_col), key_col, "left").select(
        key_col, F.coalesce(F.col(count_col), F.lit(default)).alias("_c"))
    total = j.select(F.sum("_c")).scalar()
    return j.select(key_col, F.try_divide(F.col("_c").cast("double"), total).alias("p"))


def mutual_information(ct: DataFrame, p1: DataFrame, p2: DataFrame, mode: str = "positive") -> DataFrame:
    """M7: one row ``mi`` (bits) from the cell table and both marginals."""
    total = ct.select(F.sum("n")).scalar()
    j = (ct.join(p1.select(F.col("cluster").alias("c1"), F.col("p").alias("p1")), "c1")
         .join(p2.select(F.col("cluster").alias("c2"), F.col("p").alias("p2")), "c2"))
    pij = F.col("n") / total.cast("double")
    comp = pij * F.log2(pij / (F.col("p1") * F.col("p2")))
    term = F.when(comp > 0, comp) if mode == "positive" else comp
    return j.agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("mi"))


def _pair_sums(remapped: DataFrame, pair_cols=()) -> DataFrame:
    """Every sum that the comparison metrics need, one row per pair of clusterings, from one cell table.

    The cells (at most clusters x clusters per pair) carry their marginals by
    windows; sums over clusters, such as entropies, are sums over cells because
    a marginal is the sum of its cells.
    """
    w1, w2 = _weights(remapped)
    pair = list(pair_cols)
    cells = remapped.groupBy(*pair, "c1", "c2").agg(
        F.sum(w1).cast("double").alias("s1"), F.sum(w2).cast("double").alias("s2"),
        F.coalesce(F.sum(F.when((w1 > 0) & (w2 > 0), w1 + w2)), F.lit(0)).cast("double").alias("n"),
        F.count(F.lit(1)).cast("double").alias("u"))
    cells = cells.withColumn("_one", F.lit(1))
    whole, row, col = (Window.partitionBy("_one", *pair, *c) for c in ((), ("c1",), ("c2",)))
    total = {c: F.sum(c).over(whole).alias(f"t_{c}") for c in ("s1", "s2", "n", "u")}
    m = cells.select("*", *total.values(), F.sum("s1").over(row).alias("m1"), F.sum("s2").over(col).alias("m2"),
                     F.sum("u").over(row).alias("a"), F.sum("u").over(col).alias("b"))
    p1, p2 = F.try_divide("m1", "t_s1"), F.try_divide("m2", "t_s2")
    pij = F.try_divide("n", "t_n")
    part = F.when((pij > 0) & (p1 > 0) & (p2 > 0), pij * F.log2(pij / (p1 * p2)))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return m.groupBy(*pair).agg(
        zero(F.when(p1 > 0, -F.try_divide("s1", "t_s1") * F.log2(p1))).alias("h1"),
        zero(F.when(p2 > 0, -F.try_divide("s2", "t_s2") * F.log2(p2))).alias("h2"),
        zero(F.when(part > 0, part)).alias("mi_positive"), zero(part).alias("mi_all"),
        F.sum(F.col("u") * F.col("u")).alias("sq"), F.sum(F.col("u") * F.col("a")).alias("a2"),
        F.sum(F.col("u") * F.col("b")).alias("b2"), F.sum("u").alias("total"),
        zero(F.col("u") / F.col("t_u") * F.log(F.col("t_u") * F.col("u") / (F.col("a") * F.col("b")))).alias("mi_nat"),
        (-F.sum(F.col("u") / F.col("t_u") * F.log(F.col("a") / F.col("t_u")))).alias("h1_nat"),
        (-F.sum(F.col("u") / F.col("t_u") * F.log(F.col("b") / F.col("t_u")))).alias("h2_nat"),
        F.size(F.collect_set("c1")).alias("k1"), F.size(F.collect_set("c2")).alias("k2"))


def _vi_columns(mode: str) -> list:
    mi = F.col("mi_positive" if mode == "positive" else "mi_all")
    return [F.col("h1"), F.col("h2"), mi.alias("mi"), (F.col("h1") + F.col("h2") - 2 * mi).alias("vi")]


def variation_of_information(remapped: DataFrame, mode: str = "positive", pair_cols=()) -> DataFrame:
    """M8: one row per pair (h1, h2, mi, vi) in bits; weighted when n1/n2 are present."""
    return _pair_sums(remapped, pair_cols).select(*pair_cols, *_vi_columns(mode))


def pairwise_variation(labelings: DataFrame, model_col: str = "model", key_col: str = "key",
                       cluster_col: str = "cluster") -> DataFrame:
    """(model_a, model_b, vi) of every ordered pair of distinct models in a long (model, key, cluster) table.

    VI is symmetric, so each pair is computed once, over the keys that both have.
    """
    x = labelings.select(F.col(key_col).alias("_k"), F.col(model_col).alias("model_a"), F.col(cluster_col).alias("c1"))
    y = labelings.select(F.col(key_col).alias("_k"), F.col(model_col).alias("model_b"), F.col(cluster_col).alias("c2"))
    both = x.join(y, "_k").where("model_a < model_b")
    vi = variation_of_information(both, pair_cols=("model_a", "model_b")).select("model_a", "model_b", "vi")
    turned = F.explode(F.array(F.struct("model_a", "model_b"), F.struct(F.col("model_b").alias("model_a"), F.col("model_a").alias("model_b"))))
    return vi.select(turned.alias("_p"), "vi").select("_p.model_a", "_p.model_b", "vi")


def _pair_counting_columns() -> list:
    sq, a2, b2, n = (F.col(c) for c in ("sq", "a2", "b2", "total"))
    tp, fp, fn = sq - n, b2 - sq, a2 - sq
    tn = n * n - fp - fn - sq
    mi = F.greatest(F.col("mi_nat"), F.lit(0.0))
    ari = F.when((fn == 0) & (fp == 0), F.lit(1.0)).otherwise(
        2.0 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)))
    pairs = n * n - n
    rand = F.when((pairs == 0) | (tn + tp == pairs), F.lit(1.0)).otherwise((tn + tp) / pairs)
    h1, h2 = F.col("h1_nat"), F.col("h2_nat")
    nmi = (F.when((F.col("k1") == 1) & (F.col("k2") == 1), F.lit(1.0)).when(mi == 0, F.lit(0.0)).otherwise(mi / ((h1 + h2) / 2.0)))
    hom = F.when(h1 == 0, F.lit(1.0)).otherwise(mi / h1)
    com = F.when(h2 == 0, F.lit(1.0)).otherwise(mi / h2)
    v = F.when(hom + com == 0, F.lit(0.0)).otherwise(2.0 * hom * com / (hom + com))
    return [ari.alias("adjusted_rand_index"), rand.alias("rand_index"), nmi.alias("normalized_mutual_info"),
            hom.alias("homogeneity"), com.alias("completeness"), v.alias("v_measure")]


def pair_counting_metrics(remapped: DataFrame, pair_cols=()) -> DataFrame:
    """Per pair adjusted Rand, Rand, NMI (arithmetic), homogeneity, completeness
    and V-measure over unit weights (labels c1 = true, c2 = predicted)."""
    return _pair_sums(remapped, pair_cols).select(*pair_cols, *_pair_counting_columns())


def compare_clusterings(m1: DataFrame, m2: DataFrame, use_union: bool = False,
                        counts1: DataFrame | None = None, counts2: DataFrame | None = None,
                        key_col: str = "key", cluster_col: str = "cluster",
                        missing: int = S.MISSING_CLUSTER) -> DataFrame:
    """Long (comparison, metric, value).

    With counts (intersection only) only VI is returned, as in the reference;
    passing just one of the two count tables is an error.
    """
    if (counts1 is None) != (counts2 is None):
        raise ValueError("pass both count tables or neither")
    remapped = remap_clusters(m1, m2, key_col, cluster_col, use_union, missing)
    if counts1 is not None and not use_union:
        weighted = attach_counts(remapped, counts1, counts2, key_col)
        vi = variation_of_information(weighted)
        return vi.select(F.lit(INTERSECT_COMMENT_PROB).alias("comparison"),
                         F.lit("variation_of_information").alias("metric"), F.col("vi").alias("value"))
    style = UNION_UNIFORM if use_union else INTERSECT_UNIFORM
    wide = _pair_sums(remapped).select(*_pair_counting_columns(), _vi_columns("positive")[-1].alias("variation_of_information"))
    return wide.unpivot([], list(METRIC_NAMES), "metric", "value").select(
        F.lit(style).alias("comparison"), "metric", "value")


def cluster_size_stats(assignments: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """Number of clusters, mean and population stddev of cluster sizes."""
    sizes = assignments.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("size"))
    return sizes.agg(F.count(F.lit(1)).alias("num_clusters"), F.avg("size").alias("mean_size"),
                     F.stddev_pop("size").alias("stddev_size"), F.min("size").alias("min_size"),
                     F.max("size").alias("max_size"))


def cluster_members_string(assignments: DataFrame, key_col: str = "key", cluster_col: str = "cluster",
                           out_col: str = "members") -> DataFrame:
    """Cluster -> sorted distinct members, blank-joined."""
    return assignments.groupBy(cluster_col).agg(
        F.array_join(F.sort_array(F.collect_set(F.col(key_col).cast("string"))), " ").alias(out_col))


def maximum_matching(ct: DataFrame, rows: DataFrame | None = None, cols: DataFrame | None = None,
                     missing: int = S.MISSING_CLUSTER) -> DataFrame:
    """Greedy maximum-match pairing of clusters, computed in parallel rounds.

    Greedy repeatedly takes the largest positive cell (ties: smallest row,
    then smallest column) and deletes its row and column.  A round here takes
    every cell that is first in both its row and its column under the total
    order (n desc, c1 asc, c2 asc); those are exactly the cells greedy would
    take next, in some order, so the matching is the same.  Each round's
    remaining table is checkpointed to the shared checkpoint folder.

    ``rows``/``cols`` list every cluster label (a ``cluster`` column) so that
    clusters without a positive cell come out unmatched.  Returns
    (c1, c2, round); unmatched rows get c2 = ``missing``, unmatched columns c1 = ``missing``.
    """
    cells = ct.where(F.col("n") > 0).select("c1", "c2", "n")
    matched = None
    rnd = 0
    while not cells.isEmpty():
        rnd += 1
        wr = Window.partitionBy("c1").orderBy(F.col("n").desc(), F.col("c2").asc())
        wc = Window.partitionBy("c2").orderBy(F.col("n").desc(), F.col("c1").asc())
        ranked = cells.select("*", F.row_number().over(wr).alias("_rr"), F.row_number().over(wc).alias("_rc"))
        pick = ranked.where((F.col("_rr") == 1) & (F.col("_rc") == 1)).select("c1", "c2", F.lit(rnd).alias("round"))
        pick = cut_lineage(pick)
        matched = pick if matched is None else matched.unionByName(pick)
        left = cut_lineage(cells.join(pick.select("c1"), "c1", "left_anti")
                           .join(pick.select("c2"), "c2", "left_anti"))
        drop_state(cells)
        cells = left
    if matched is None:
        matched = ct.sparkSession.createDataFrame([], "c1 bigint, c2 bigint, round int")
    row_labels = (rows if rows is not None else ct.select(F.col("c1").alias("cluster"))).select(
        F.col("cluster").alias("c1")).distinct()
    col_labels = (cols if cols is not None else ct.select(F.col("c2").alias("cluster"))).select(
        F.col("cluster").alias("c2")).distinct()
    lone_rows = row_labels.join(matched.select("c1"), "c1", "left_anti").select(
        "c1", F.lit(missing).cast(matched.schema["c2"].dataType).alias("c2"), F.lit(None).cast("int").alias("round"))
    lone_cols = col_labels.join(matched.select("c2"), "c2", "left_anti").select(
        F.lit(missing).cast(matched.schema["c1"].dataType).alias("c1"), "c2", F.lit(None).cast("int").alias("round"))
    return matched.unionByName(lone_rows).unionByName(lone_cols)


def pair_clusters_across(m1: DataFrame, m2: DataFrame, key_col: str = "key", cluster_col: str = "cluster",
                         missing: int = S.MISSING_CLUSTER) -> DataFrame:
    """Union remap, shared-key contingency without the missing row/column,
    then the maximum matching; ordered by c1 desc."""
    remapped = remap_clusters(m1, m2, key_col, cluster_col, True, missing)
    ct = (remapped.where((F.col("c1") != missing) & (F.col("c2") != missing))
          .groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n")))
    rows = m1.select(F.col(cluster_col).alias("cluster"))
    cols = m2.select(F.col(cluster_col).alias("cluster"))
    return maximum_matching(ct, rows, cols, missing).orderBy(F.col("c1").desc(), F.col("c2").asc())


def alignment_chains(clusterings: list[DataFrame], key_col: str = "key", cluster_col: str = "cluster",
                     missing: int = S.MISSING_CLUSTER) -> DataFrame:
    """Chains of matched cluster ids across consecutive clusterings.

    Columns ``step_0..step_{T-1}`` hold the cluster id in each clustering
    (``missing`` where the chain has none) and ``chain_length`` counts the
    present ids.  Consecutive matchings are chained by full outer joins on
    the shared cluster id, so a mismatched id can never be silently dropped.
    """
    chains = None
    for t in range(len(clusterings) - 1):
        pairs = pair_clusters_across(clusterings[t], clusterings[t + 1], key_col, cluster_col, missing)
        pairs = pairs.select(F.col("c1").alias(f"step_{t}"), F.col("c2").alias(f"step_{t + 1}"))
        if chains is None:
            chains = pairs
            continue
        left = chains.where(F.col(f"step_{t}") != missing)
        left_missing = chains.where(F.col(f"step_{t}") == missing)
        right = pairs.where(F.col(f"step_{t}") != missing)
        right_new = pairs.where(F.col(f"step_{t}") == missing)
        joined = left.join(right, f"step_{t}", "full")
        prev_cols = [f"step_{i}" for i in range(t + 1)]
        filled = joined.select(*[F.coalesce(F.col(c), F.lit(missing)).alias(c) for c in prev_cols],
                               F.coalesce(F.col(f"step_{t + 1}"), F.lit(missing)).alias(f"step_{t + 1}"))
        left_missing = left_missing.withColumn(f"step_{t + 1}", F.lit(missing).cast(filled.schema[f"step_{t + 1}"].dataType))
        right_new = right_new.select(*[F.lit(missing).cast(filled.schema[c].dataType).alias(c) for c in prev_cols[:-1]],
                                     f"step_{t}", f"step_{t + 1}")
        chains = cut_lineage(filled.unionByName(left_missing).unionByName(right_new))
    steps = [c for c in chains.columns if c.startswith("step_")]
    present = F.size(F.filter(F.array(*[F.col(c) for c in steps]), lambda x: x != missing))
    chains = chains.where(present > 0)
    return chains.withColumn("chain_length", present)


def pivot_mean(df: DataFrame, row_col: str, col_col: str, value_col: str, values=None) -> DataFrame:
    """Pivot table of means (``values`` fixes the pivot columns, avoiding a pass)."""
    g = df.groupBy(row_col)
    return (g.pivot(col_col, values) if values is not None else g.pivot(col_col)).agg(F.avg(value_col))
