"""Intrinsic cluster quality (M1-M5), scikit-learn definitions.

* Cosine silhouette (M1) needs no pairs: for unit vectors the summed cosine
  distance from x to cluster C is |C| - x.S_C, where S_C is the cluster's
  vector sum.  Clusters are dealt into blocks of ``CLUSTER_BLOCK`` sums; a point
  meets each block by an equi-join and the partial results are combined.
* Euclidean silhouette (M5) has no such identity: blocked distance sums per
  (point, cluster) are computed in cogroup tasks and summed by Spark.
* Davies-Bouldin (M3, M4) and Calinski-Harabasz (M2) need centroids and
  point-to-own-centroid distances (an equi-join on the cluster id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tribewise.functions import vectors as V
from tribewise.operators import blocked as B

CLUSTER_BLOCK = 512  # vector sums that one row carries


def _prep(df: DataFrame, key_col: str, vec_col: str, cluster_col: str, normalize: bool) -> DataFrame:
    v = V.as_doubles(vec_col)
    return df.select(F.col(key_col).alias("key"), F.col(cluster_col).alias("cluster"),
                     (V.normalize(v) if normalize else v).alias("v"))


def _silhouette_from_sums(points: DataFrame, sums: DataFrame) -> DataFrame:
    """points (key, cluster, v); sums: (cluster, size, vsum) -> (key, cluster, a, b, own_n)."""
    number = sums.select(F.ceil(F.count(F.lit(1)) / F.lit(CLUSTER_BLOCK)).cast("int")).scalar()
    blocks = (sums.withColumn("_nb", number).groupBy(F.pmod(F.xxhash64("cluster"), F.col("_nb")).cast("int").alias("_block"))
              .agg(F.collect_list(F.struct(F.col("cluster").alias("c"), F.col("size").alias("n"), F.col("vsum").alias("s"))).alias("_arr")))
    met = (points.withColumn("_nb", number).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
           .join(blocks, "_block"))
    per = met.withColumn("_d", F.transform("_arr", lambda s: F.struct(
        s["c"].alias("c"), s["n"].alias("n"), V.dot(F.col("v"), s["s"]).alias("xs"))))
    own = F.filter("_d", lambda d: d["c"] == F.col("cluster"))[0]
    others = F.transform(F.filter("_d", lambda d: d["c"] != F.col("cluster")), lambda d: (d["n"] - d["xs"]) / d["n"])
    a = F.when(own["n"] > 1, ((own["n"] - 1) - (own["xs"] - V.dot("v", "v"))) / (own["n"] - 1))
    part = per.select("key", "cluster", a.alias("a"), F.array_min(others).alias("b"), own["n"].alias("own_n"))
    return part.groupBy("key", "cluster").agg(F.max("a").alias("a"), F.min("b").alias("b"), F.max("own_n").alias("own_n"))


def _silhouette_value(a, b, own_n):
    s = (b - a) / F.greatest(a, b)
    return F.when(own_n <= 1, F.lit(0.0)).when(F.greatest(a, b) == 0, F.lit(0.0)).otherwise(s)


def silhouette_points_cosine(df: DataFrame, key_col: str = "key", vec_col: str = "vector",
                             cluster_col: str = "cluster") -> DataFrame:
    """Per-point cosine silhouette (key, cluster, silhouette)."""
    pts = _prep(df, key_col, vec_col, cluster_col, normalize=True)
    sums = V.group_vector_sums(pts, "cluster", "v", "vsum")
    ab = _silhouette_from_sums(pts, sums)
    out = ab.select("key", "cluster", _silhouette_value(F.col("a"), F.col("b"), F.col("own_n")).alias("silhouette"))
    return out.withColumnRenamed("key", key_col).withColumnRenamed("cluster", cluster_col)


def _silhouette_blocked(pts: DataFrame, metric: str) -> DataFrame:
    sums = B.distance_sums_by_cluster(pts, "key", "v", "cluster", metric=metric)
    j = sums.join(pts.select("key", "cluster"), "key")
    own = F.max(F.when(F.col("other_cluster") == F.col("cluster"), F.col("dist_sum") / F.col("n")))
    own_n = F.max(F.when(F.col("other_cluster") == F.col("cluster"), F.col("n")))
    b = F.min(F.when(F.col("other_cluster") != F.col("cluster"), F.col("dist_sum") / F.col("n")))
    agg = j.groupBy("key", "cluster").agg(own.alias("a"), b.alias("b"), own_n.alias("own_n"))
    # a point alone in its cluster has no own-cluster partner (own_n is null)
    agg = agg.withColumn("own_n", F.coalesce(F.col("own_n") + 1, F.lit(1)))
    return agg.select("key", "cluster", _silhouette_value(F.col("a"), F.col("b"), F.col("own_n")).alias("silhouette"))


def silhouette_points(df: DataFrame, key_col: str = "key", vec_col: str = "vector",
                      cluster_col: str = "cluster") -> DataFrame:
    """M5: per-point euclidean silhouette (key, cluster, silhouette)."""
    pts = _prep(df, key_col, vec_col, cluster_col, normalize=False)
    return (_silhouette_blocked(pts, "euclidean").withColumnRenamed("key", key_col)
            .withColumnRenamed("cluster", cluster_col))


def silhouette_score(df: DataFrame, key_col: str = "key", vec_col: str = "vector",
                     cluster_col: str = "cluster", metric: str = "cosine") -> DataFrame:
    """M1: one row, mean silhouette; null when there is a single cluster."""
    per = (silhouette_points_cosine if metric == "cosine" else silhouette_points)(df, key_col, vec_col, cluster_col)
    return per.agg(F.when(F.count_distinct(cluster_col) > 1, F.avg("silhouette")).alias("silhouette"))


def centroids(df: DataFrame, vec_col: str = "vector", cluster_col: str = "cluster") -> DataFrame:
    """(cluster, centroid, size) with the component-wise mean."""
    pts = df.select(F.col(cluster_col).alias("cluster"), V.as_doubles(vec_col).alias("v"))
    return V.group_vector_sums(pts, "cluster", "v", "centroid", mean=True)


def davies_bouldin_per_cluster(df: DataFrame, vec_col: str = "vector", cluster_col: str = "cluster") -> DataFrame:
    """M4: (cluster, score) = max over other clusters of (s_i + s_j) / d(c_i, c_j);
    coincident centroids give ratio 0."""
    pts = df.select(F.col(cluster_col).alias("cluster"), V.as_doubles(vec_col).alias("v"))
    cen = centroids(df, vec_col, cluster_col)
    spread = (pts.join(cen.select("cluster", "centroid"), "cluster")
              .groupBy("cluster").agg(F.avg(F.sqrt(V.sq_distance("v", "centroid"))).alias("s")))
    table = cen.join(spread, "cluster")
    arr = table.select(F.collect_list(F.struct(F.col("cluster").alias("c"), F.col("centroid").alias("m"),
                                               F.col("s").alias("s")))).scalar()
    table = table.withColumn("_arr", arr)
    ratios = F.transform(F.filter("_arr", lambda o: o["c"] != F.col("cluster")), lambda o: F.when(
        F.sqrt(V.sq_distance(F.col("centroid"), o["m"])) == 0, F.lit(0.0)).otherwise(
        (F.col("s") + o["s"]) / F.sqrt(V.sq_distance(F.col("centroid"), o["m"]))))
    return table.select(F.col("cluster").alias(cluster_col), F.coalesce(F.array_max(ratios), F.lit(0.0)).alias("score"),
                        F.col("s").alias("spread"))


def davies_bouldin_score(df: DataFrame, vec_col: str = "vector", cluster_col: str = "cluster") -> DataFrame:
    """M3: mean of the per-cluster scores (0 when all spreads are 0)."""
    per = davies_bouldin_per_cluster(df, vec_col, cluster_col)
    return per.agg(F.when(F.max(F.abs("spread")) == 0, F.lit(0.0)).otherwise(F.avg("score")).alias("davies_bouldin"))


def calinski_harabasz_score(df: DataFrame, vec_col: str = "vector", cluster_col: str = "cluster") -> DataFrame:
    """M2: (B / (k - 1)) / (W / (n - k)); 1.0 when W is 0."""
    pts = df.select(F.col(cluster_col).alias("cluster"), V.as_doubles(vec_col).alias("v"))
    cen = centroids(df, vec_col, cluster_col)
    overall = V.group_vector_sums(pts.withColumn("_all", F.lit(0)), "_all", "v", "mu", mean=True)
    mu = overall.select("mu").scalar()
    within = pts.join(cen.select("cluster", "centroid"), "cluster").agg(
        F.sum(V.sq_distance("v", "centroid")).alias("w"), F.count(F.lit(1)).alias("n"))
    between = cen.withColumn("_mu", mu).agg(F.sum(F.col("size") * V.sq_distance(F.col("centroid"), F.col("_mu"))).alias("b"),
                      F.count(F.lit(1)).alias("k"))
    j = within.withColumn("_k", F.lit(1)).join(between.withColumn("_k", F.lit(1)), "_k")
    return j.select(F.when(F.col("w") == 0, F.lit(1.0)).otherwise(
        F.col("b") * (F.col("n") - F.col("k")) / (F.col("w") * (F.col("k") - 1))).alias("calinski_harabasz"))
