"""Driver-table queries for clustering comparison.

Labelings: parts by brand and by type (keys = parts, weights = lineitem rows
before / from 1995); embeddings by ``label``, by the index of their largest
component (``argmax``) and by the sign pattern of their first three
components (``signs``) -- three data-derived partitions of the same keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tribewise.operators import compare as C
from tribewise.plans.registry import query, r6, table

SPLIT_DATE = "1998-06-01"


def part_labelings(spark, d):
    p = table(spark, d, "part")
    return (p.select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("cluster")),
            p.select(F.col("p_partkey").alias("key"), F.col("p_type").alias("cluster")))


def document_labelings(spark, d):
    """All documents by source, and those that have labels by their labels: key sets that differ by themselves."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return (docs.select(F.col("doc_id").alias("key"), F.col("source").alias("cluster")),
            labels.select(F.col("doc_id").alias("key"), F.concat_ws("/", F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("cluster")))


def part_counts(spark, d):
    li = table(spark, d, "lineitem")
    early = li.where(F.col("l_shipdate") < F.lit(SPLIT_DATE).cast("timestamp_ntz"))
    late = li.where(F.col("l_shipdate") >= F.lit(SPLIT_DATE).cast("timestamp_ntz"))
    cnt = lambda x: x.groupBy(F.col("l_partkey").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return cnt(early), cnt(late)


def weighted_remap(spark, d):
    m1, m2 = part_labelings(spark, d)
    c1, c2 = part_counts(spark, d)
    return C.attach_counts(C.remap_clusters(m1, m2), c1, c2)


def embedding_labelings(spark, d):
    e = table(spark, d, "embeddings")
    lab = e.select(F.col("vec_id").alias("key"), F.col("label").cast("bigint").alias("cluster"))
    arg = e.select(F.col("vec_id").alias("key"),
                   (F.array_position("embedding", F.array_max("embedding")) - 1).cast("bigint").alias("cluster"))
    sig = e.select(F.col("vec_id").alias("key"), (
        F.when(F.col("embedding")[0] > 0, 4).otherwise(0) + F.when(F.col("embedding")[1] > 0, 2).otherwise(0)
        + F.when(F.col("embedding")[2] > 0, 1).otherwise(0)).cast("bigint").alias("cluster"))
    return {"label": lab, "argmax": arg, "signs": sig}


_W_SQL = f"""
WITH m1 AS (SELECT p_partkey AS key, p_brand AS c1 FROM part),
m2 AS (SELECT p_partkey AS key, p_type AS c2 FROM part),
e AS (SELECT l_partkey AS key, count(*) AS n FROM lineitem WHERE l_shipdate < TIMESTAMP '{SPLIT_DATE}' GROUP BY 1),
l AS (SELECT l_partkey AS key, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '{SPLIT_DATE}' GROUP BY 1),
r AS (SELECT m1.key, c1, c2, coalesce(e.n, 0) AS n1, coalesce(l.n, 0) AS n2
      FROM m1 JOIN m2 ON m1.key = m2.key LEFT JOIN e ON e.key = m1.key LEFT JOIN l ON l.key = m1.key),
p1 AS (SELECT c1, sum(n1) / (SELECT CAST(sum(n1) AS DOUBLE) FROM r) AS p FROM r GROUP BY c1),
p2 AS (SELECT c2, sum(n2) / (SELECT CAST(sum(n2) AS DOUBLE) FROM r) AS p FROM r GROUP BY c2),
ct AS (SELECT c1, c2, CAST(sum(n1 + n2) AS BIGINT) AS n FROM r WHERE n1 > 0 AND n2 > 0 GROUP BY c1, c2),
ctt AS (SELECT CAST(sum(n) AS DOUBLE) AS t FROM ct),
mi AS (SELECT coalesce(sum(CASE WHEN comp > 0 THEN comp END), 0.0) AS mi FROM (
        SELECT (n / t) * log2((n / t) / (p1.p * p2.p)) AS comp FROM ct JOIN p1 USING (c1) JOIN p2 USING (c2), ctt)),
h AS (SELECT (SELECT coalesce(sum(CASE WHEN p > 0 THEN -p * log2(p) END), 0.0) FROM p1) AS h1,
             (SELECT coalesce(sum(CASE WHEN p > 0 THEN -p * log2(p) END), 0.0) FROM p2) AS h2)"""


@query("contingency", _W_SQL + "\nSELECT c1, c2, n FROM ct")
def contingency(spark, d):
    return C.contingency_table(weighted_remap(spark, d))


@query("cluster_probabilities", _W_SQL + """
SELECT 'c1' AS side, c1 AS cluster, round(p, 6) + 0.0 AS p FROM p1
UNION ALL SELECT 'c2' AS side, c2 AS cluster, round(p, 6) + 0.0 AS p FROM p2""")
def cluster_probabilities(spark, d):
    r = weighted_remap(spark, d)
    a = C.cluster_probabilities(r, "c1").select(F.lit("c1").alias("side"), "cluster", r6("p").alias("p"))
    b = C.cluster_probabilities(r, "c2").select(F.lit("c2").alias("side"), "cluster", r6("p").alias("p"))
    return a.unionByName(b)


@query("mutual_information", _W_SQL + "\nSELECT round(mi, 6) + 0.0 AS mi FROM mi")
def mutual_information(spark, d):
    r = weighted_remap(spark, d)
    mi = C.mutual_information(C.contingency_table(r), C.cluster_probabilities(r, "c1"),
                              C.cluster_probabilities(r, "c2"))
    return mi.select(r6("mi").alias("mi"))


@query("variation_of_information", _W_SQL + """
SELECT round(h1, 6) + 0.0 AS h1, round(h2, 6) + 0.0 AS h2, round(mi, 6) + 0.0 AS mi,
       round(h1 + h2 - 2 * mi, 6) + 0.0 AS vi FROM h, mi""")
def variation_of_information(spark, d):
    v = C.variation_of_information(weighted_remap(spark, d))
    return v.select(*[r6(c).alias(c) for c in ("h1", "h2", "mi", "vi")])


def _pair_metrics_sql(remap_cte: str, style: str) -> str:
    return f"""
WITH r AS ({remap_cte}),
cells AS (SELECT c1, c2, CAST(count(*) AS DOUBLE) AS nij FROM r GROUP BY c1, c2),
rw AS (SELECT c1, sum(nij) AS a FROM cells GROUP BY c1),
cl AS (SELECT c2, sum(nij) AS b FROM cells GROUP BY c2),
tot AS (SELECT sum(nij) AS n FROM cells),
cs AS (SELECT sum(nij * nij) AS sq, coalesce(sum(nij / n * ln(n * nij / (a * b))), 0.0) AS mi_raw
       FROM cells JOIN rw USING (c1) JOIN cl USING (c2), tot),
rs AS (SELECT sum(a * a) AS a2, -sum(a / n * ln(a / n)) AS h1, count(*) AS k1 FROM rw, tot),
css AS (SELECT sum(b * b) AS b2, -sum(b / n * ln(b / n)) AS h2, count(*) AS k2 FROM cl, tot),
s AS (SELECT *, sq - n AS tp, b2 - sq AS fp, a2 - sq AS fn, greatest(mi_raw, 0.0) AS mi FROM cs, rs, css, tot),
s2 AS (SELECT *, n * n - fp - fn - sq AS tn FROM s),
pm AS (SELECT
  CASE WHEN fn = 0 AND fp = 0 THEN 1.0 ELSE 2.0 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)) END AS ari,
  CASE WHEN n * n - n = 0 OR tn + tp = n * n - n THEN 1.0 ELSE (tn + tp) / (n * n - n) END AS rand,
  CASE WHEN k1 = 1 AND k2 = 1 THEN 1.0 WHEN mi = 0 THEN 0.0 ELSE mi / ((h1 + h2) / 2.0) END AS nmi,
  CASE WHEN h1 = 0 THEN 1.0 ELSE mi / h1 END AS hom,
  CASE WHEN h2 = 0 THEN 1.0 ELSE mi / h2 END AS com FROM s2),
nk AS (SELECT CAST(count(*) AS DOUBLE) AS nk FROM r),
p1 AS (SELECT c1, count(*) / nk AS p FROM r, nk GROUP BY c1, nk),
p2 AS (SELECT c2, count(*) / nk AS p FROM r, nk GROUP BY c2, nk),
vmi AS (SELECT coalesce(sum(CASE WHEN comp > 0 THEN comp END), 0.0) AS mi FROM (
        SELECT (nij / n) * log2((nij / n) / (p1.p * p2.p)) AS comp FROM cells JOIN p1 USING (c1) JOIN p2 USING (c2), tot)),
vi AS (SELECT (SELECT -sum(p * log2(p)) FROM p1) + (SELECT -sum(p * log2(p)) FROM p2) - 2 * mi AS vi FROM vmi),
allm AS (
  SELECT 'adjusted_rand_index' AS metric, ari AS value FROM pm
  UNION ALL SELECT 'rand_index', rand FROM pm
  UNION ALL SELECT 'normalized_mutual_info', nmi FROM pm
  UNION ALL SELECT 'homogeneity', hom FROM pm
  UNION ALL SELECT 'completeness', com FROM pm
  UNION ALL SELECT 'v_measure', CASE WHEN hom + com = 0 THEN 0.0 ELSE 2.0 * hom * com / (hom + com) END FROM pm
  UNION ALL SELECT 'variation_of_information', vi FROM vi)
SELECT '{style}' AS comparison, metric, round(value, 6) + 0.0 AS value FROM allm"""


_M1 = "SELECT doc_id AS key, source AS cluster FROM documents"
_M2 = "SELECT doc_id AS key, quality || '/' || toxic AS cluster FROM labels"


@query("compare_union", _pair_metrics_sql(
    f"SELECT coalesce(a.cluster, '-1') AS c1, coalesce(b.cluster, '-1') AS c2 FROM ({_M1}) a FULL JOIN ({_M2}) b ON a.key = b.key",
    C.UNION_UNIFORM))
def compare_union(spark, d):
    m1, m2 = document_labelings(spark, d)
    return C.compare_clusterings(m1, m2, use_union=True).withColumn("value", r6("value"))


@query("compare_intersection", _pair_metrics_sql(
    f"SELECT a.cluster AS c1, b.cluster AS c2 FROM ({_M1}) a JOIN ({_M2}) b ON a.key = b.key",
    C.INTERSECT_UNIFORM))
def compare_intersection(spark, d):
    m1, m2 = document_labelings(spark, d)
    return C.compare_clusterings(m1, m2, use_union=False).withColumn("value", r6("value"))


@query("compare_weighted", _W_SQL + f"""
SELECT '{C.INTERSECT_COMMENT_PROB}' AS comparison, 'variation_of_information' AS metric,
       round(h1 + h2 - 2 * mi, 6) + 0.0 AS value FROM h, mi""")
def compare_weighted(spark, d):
    m1, m2 = part_labelings(spark, d)
    c1, c2 = part_counts(spark, d)
    return C.compare_clusterings(m1, m2, counts1=c1, counts2=c2).withColumn("value", r6("value"))


_EMB_LABELS_SQL = """
WITH lab AS (SELECT vec_id AS key, CAST(label AS BIGINT) AS cluster FROM embeddings),
arg AS (SELECT vec_id AS key, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS cluster FROM embeddings),
sig AS (SELECT vec_id AS key, CAST((CASE WHEN embedding[1] > 0 THEN 4 ELSE 0 END) + (CASE WHEN embedding[2] > 0 THEN 2 ELSE 0 END)
                                 + (CASE WHEN embedding[3] > 0 THEN 1 ELSE 0 END) AS BIGINT) AS cluster FROM embeddings)"""


@query("cluster_size_stats", _EMB_LABELS_SQL + """
SELECT count(*) AS num_clusters, round(avg(size), 6) + 0.0 AS mean_size, round(stddev_pop(size), 6) + 0.0 AS stddev_size,
       min(size) AS min_size, max(size) AS max_size
FROM (SELECT cluster, count(*) AS size FROM lab GROUP BY cluster)""")
def cluster_size_stats(spark, d):
    s = C.cluster_size_stats(embedding_labelings(spark, d)["label"])
    return s.withColumn("mean_size", r6("mean_size")).withColumn("stddev_size", r6("stddev_size"))


def _vi_uniform_sql(a: str, b: str) -> str:
    return f"""(SELECT '{a}' AS model_a, '{b}' AS model_b, h1 + h2 - 2 * mi AS vi FROM (
  WITH r AS (SELECT x.cluster AS c1, y.cluster AS c2 FROM {a} x JOIN {b} y ON x.key = y.key),
  nk AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM r),
  cells AS (SELECT c1, c2, count(*) / n AS pij FROM r, nk GROUP BY c1, c2, n),
  p1 AS (SELECT c1, count(*) / n AS p FROM r, nk GROUP BY c1, n),
  p2 AS (SELECT c2, count(*) / n AS p FROM r, nk GROUP BY c2, n)
  SELECT (SELECT -sum(p * log2(p)) FROM p1) AS h1, (SELECT -sum(p * log2(p)) FROM p2) AS h2,
         (SELECT coalesce(sum(CASE WHEN comp > 0 THEN comp END), 0.0) FROM (
            SELECT pij * log2(pij / (p1.p * p2.p)) AS comp FROM cells JOIN p1 USING (c1) JOIN p2 USING (c2))) AS mi))"""


_NAMES = ("lab", "arg", "sig")
_PUBLIC = {"lab": "label", "arg": "argmax", "sig": "signs"}


def _vi_pairs_sql():
    parts = []
    for i, a in enumerate(_NAMES):
        for b in _NAMES[i + 1:]:
            parts.append(_vi_uniform_sql(a, b))
            parts.append(_vi_uniform_sql(b, a))
    return " UNION ALL ".join(parts)


def _vi_long(spark, d):
    labs = embedding_labelings(spark, d)
    long = [df.select(F.lit(name).alias("model"), "key", F.col("cluster").cast("bigint").alias("cluster")) for name, df in labs.items()]
    return C.pairwise_variation(reduce(lambda x, y: x.unionByName(y), long))


@query("vi_pairs", _EMB_LABELS_SQL + ",\nv AS (" + _vi_pairs_sql() + """)
SELECT CASE model_a WHEN 'lab' THEN 'label' WHEN 'arg' THEN 'argmax' ELSE 'signs' END AS model_a,
       CASE model_b WHEN 'lab' THEN 'label' WHEN 'arg' THEN 'argmax' ELSE 'signs' END AS model_b,
       round(vi, 6) + 0.0 AS vi FROM v""")
def vi_pairs(spark, d):
    """VI of every ordered pair of distinct labelings (both orders kept)."""
    return _vi_long(spark, d).withColumn("vi", r6("vi"))


@query("vi_pivot", _EMB_LABELS_SQL + ",\nv AS (" + _vi_pairs_sql() + """)
SELECT CASE model_a WHEN 'lab' THEN 'label' WHEN 'arg' THEN 'argmax' ELSE 'signs' END AS model_a,
       round(avg(CASE WHEN model_b = 'arg' THEN vi END), 6) + 0.0 AS argmax,
       round(avg(CASE WHEN model_b = 'lab' THEN vi END), 6) + 0.0 AS label,
       round(avg(CASE WHEN model_b = 'sig' THEN vi END), 6) + 0.0 AS signs
FROM v GROUP BY model_a""")
def vi_pivot(spark, d):
    """Mean VI pivoted by the second labeling."""
    p = C.pivot_mean(_vi_long(spark, d), "model_a", "model_b", "vi", ["argmax", "label", "signs"])
    return p.select("model_a", *[r6(c).alias(c) for c in ("argmax", "label", "signs")])


def _match_sql(a: str, b: str, name: str) -> str:
    """Greedy matching of two labelings, one cell after the other: CTE ``name`` (c1, c2), -1 for no partner."""
    return f""",
{name}_cells AS (SELECT *, row_number() OVER (ORDER BY n DESC, c1, c2) AS pos FROM (
  SELECT x.cluster AS c1, y.cluster AS c2, count(*) AS n FROM {a} x JOIN {b} y ON x.key = y.key GROUP BY ALL)),
{name}_walk AS (
  SELECT CAST(0 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS us, CAST([] AS BIGINT[]) AS vs
  UNION ALL
  SELECT c.pos, CASE WHEN free THEN list_append(us, c1) ELSE us END, CASE WHEN free THEN list_append(vs, c2) ELSE vs END
  FROM (SELECT w.us, w.vs, c.*, NOT list_contains(w.us, c.c1) AND NOT list_contains(w.vs, c.c2) AS free
        FROM {name}_walk w JOIN {name}_cells c ON c.pos = w.pos + 1) c),
{name}_pairs AS (SELECT unnest(us) AS c1, unnest(vs) AS c2 FROM {name}_walk WHERE pos = (SELECT max(pos) FROM {name}_walk)),
{name} AS (
  SELECT c1, c2 FROM {name}_pairs
  UNION ALL SELECT DISTINCT cluster, CAST(-1 AS BIGINT) FROM {a} WHERE cluster NOT IN (SELECT c1 FROM {name}_pairs)
  UNION ALL SELECT DISTINCT CAST(-1 AS BIGINT), cluster FROM {b} WHERE cluster NOT IN (SELECT c2 FROM {name}_pairs))"""


_RECURSIVE_LABELS_SQL = _EMB_LABELS_SQL.replace("WITH lab", "WITH RECURSIVE lab", 1)


@query("max_matching", _RECURSIVE_LABELS_SQL + _match_sql("lab", "arg", "m") + "\nSELECT c1, c2 FROM m")
def max_matching(spark, d):
    """Greedy maximum-match pairing of the label and argmax partitions."""
    labs = embedding_labelings(spark, d)
    return C.pair_clusters_across(labs["label"], labs["argmax"]).select("c1", "c2")


@query("alignment_chains", _RECURSIVE_LABELS_SQL + _match_sql("lab", "arg", "p") + _match_sql("arg", "sig", "q") + """,
chains AS (
  SELECT coalesce(x.c1, -1) AS step_0, coalesce(x.c2, y.c1) AS step_1, coalesce(y.c2, -1) AS step_2
  FROM (SELECT * FROM p WHERE c2 <> -1) x FULL JOIN (SELECT * FROM q WHERE c1 <> -1) y ON x.c2 = y.c1
  UNION ALL SELECT c1, -1, -1 FROM p WHERE c2 = -1
  UNION ALL SELECT -1, -1, c2 FROM q WHERE c1 = -1),
names AS (SELECT cluster, string_agg(CAST(key AS VARCHAR), ' ' ORDER BY CAST(key AS VARCHAR)) AS members FROM lab GROUP BY cluster)
SELECT step_0, step_1, step_2, CAST((step_0 <> -1) AS INTEGER) + CAST((step_1 <> -1) AS INTEGER) + CAST((step_2 <> -1) AS INTEGER) AS chain_length,
       members
FROM chains LEFT JOIN names ON step_0 = cluster""")
def alignment_chains(spark, d):
    """Chains label -> argmax -> signs with member strings of the first step."""
    labs = embedding_labelings(spark, d)
    chains = C.alignment_chains([labs["label"], labs["argmax"], labs["signs"]])
    members = C.cluster_members_string(labs["label"]).withColumnRenamed("cluster", "step_0")
    return chains.join(members, "step_0", "left")


@query("experiment_pick", """
WITH v AS (SELECT model_a || '/' || model_b AS pair, vi FROM (""" + _EMB_LABELS_SQL.replace("WITH ", "WITH ", 1)
       + ",\nvv AS (" + _vi_pairs_sql() + """)
SELECT CASE model_a WHEN 'lab' THEN 'label' WHEN 'arg' THEN 'argmax' ELSE 'signs' END AS model_a,
       CASE model_b WHEN 'lab' THEN 'label' WHEN 'arg' THEN 'argmax' ELSE 'signs' END AS model_b, vi FROM vv))
SELECT arg_min(pair, struct_pack(v := round(vi, 6), p := pair)) AS min_id, round(min(vi), 6) + 0.0 AS min_value,
       arg_min(pair, struct_pack(v := -round(vi, 6), p := pair)) AS max_id, round(max(vi), 6) + 0.0 AS max_value FROM v""")
def experiment_pick(spark, d):
    """The labeling pairs with the smallest and largest VI, to 6 digits; ties go to the smaller id."""
    from tribewise.operators.tables import min_max_pick
    v = _vi_long(spark, d).select(F.concat_ws("/", "model_a", "model_b").alias("pair"), r6("vi").alias("vi"))
    return min_max_pick(v, "pair", "vi")
