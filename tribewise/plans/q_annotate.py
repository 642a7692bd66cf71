"""Driver-table queries for annotation tasks and agreement.

Assignments: parts clustered by brand (model ``brand``), popularity = the
part's lineitem rows.  Raters: the two 0/1 columns of ``labels``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tribewise.operators import annotate as AN
from tribewise.operators import filters as FL
from tribewise.plans.q_compare import embedding_labelings
from tribewise.plans.registry import query, r6, table

TOP = 5
SEED = 0
MODEL = "brand"


def brand_assignments(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("cluster"))
    cnt = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.count(F.lit(1)).alias("n_rows"))
    return AN.assignments_with_counts(p, cnt)


_A_SQL = f"""
WITH cnt AS (SELECT l_partkey AS key, count(*) AS n_rows FROM lineitem GROUP BY l_partkey),
a AS (SELECT p_partkey AS key, p_brand AS cluster, n_rows FROM part JOIN cnt ON p_partkey = cnt.key),
sd AS (SELECT stddev_samp(n_rows) AS sd FROM a),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n_rows DESC, key ASC) AS rk FROM a) WHERE rk <= {TOP}),
b AS (SELECT cluster, avg(n_rows) AS m, count(*) AS top_members FROM top GROUP BY cluster),
el AS (SELECT b.cluster, x.key AS candidate, x.n_rows AS candidate_count, b.top_members
       FROM b, sd, a x WHERE x.n_rows >= m - sd AND x.n_rows <= m + sd AND x.cluster <> b.cluster)"""


@query("label_task", _A_SQL + f"""
SELECT '{MODEL}' AS model_id, cluster AS cluster_id,
       string_agg(CAST(key AS VARCHAR), ' ' ORDER BY n_rows DESC, CAST(key AS VARCHAR)) AS members,
       '' AS coherent, '' AS cluster_label
FROM a GROUP BY cluster""")
def label_task(spark, d):
    return AN.label_task(brand_assignments(spark, d), MODEL, count_col="n_rows")


@query("intruder_candidates", _A_SQL + "\nSELECT cluster, candidate, candidate_count, top_members FROM el")
def intruder_candidates(spark, d):
    el = AN.eligible_intruders(brand_assignments(spark, d), TOP, count_col="n_rows")
    return el.withColumnRenamed("_members", "top_members")


def _h(c):
    return f"md5('{SEED}|' || cluster || '|' || {c})"


@query("intruder_task", _A_SQL + f""",
fullc AS (SELECT cluster FROM top GROUP BY cluster HAVING count(*) >= {TOP}),
pick AS (SELECT cluster, arg_min(candidate, {_h('CAST(candidate AS VARCHAR)')}) AS intruder
         FROM el WHERE cluster IN (SELECT cluster FROM fullc) GROUP BY cluster),
items AS (SELECT t.cluster, CAST(t.key AS VARCHAR) AS item, false AS is_intruder FROM top t JOIN pick USING (cluster)
          UNION ALL SELECT cluster, CAST(intruder AS VARCHAR) AS item, true AS is_intruder FROM pick),
o AS (SELECT cluster, list(item ORDER BY {_h('item')}) AS its, list(is_intruder ORDER BY {_h('item')}) AS flags
      FROM items GROUP BY cluster)
SELECT '{MODEL}' AS model_id, cluster AS cluster_id, {", ".join(f"its[{i + 1}] AS item_{i + 1}" for i in range(TOP + 1))},
       CAST(list_position(flags, true) AS BIGINT) AS intruder_position FROM o""")
def intruder_task(spark, d):
    _, answers = AN.intruder_task(brand_assignments(spark, d), MODEL, TOP, SEED, count_col="n_rows")
    return answers


@query("rater_agreement", """
WITH r AS (SELECT doc_id, quality, toxic FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
l AS (SELECT doc_id, quality AS category FROM r UNION ALL SELECT doc_id, toxic AS category FROM r),
c AS (SELECT doc_id, category, count(*) AS rik FROM l GROUP BY doc_id, category),
n AS (SELECT count(*) AS n FROM r),
pa AS (SELECT sum(rik * (rik - 1)) / (n * 2.0) AS pa FROM c, n GROUP BY n),
pk AS (SELECT category, sum(rik) / (n * 2.0) AS pi FROM c, n GROUP BY category, n),
pe AS (SELECT sum(pi * pi) AS pef, sum(pi * (1 - pi)) / (count(*) - 1) AS peg FROM pk),
mp AS (SELECT avg((quality + toxic) / 2.0) AS mean_precision FROM r)
SELECT 'quality,toxic' AS raters, n AS items, round(pa, 6) + 0.0 AS observed_agreement,
       round((pa - pef) / (1 - pef), 6) + 0.0 AS fleiss_kappa, round((pa - peg) / (1 - peg), 6) + 0.0 AS gwet_ac1,
       round(mean_precision, 6) + 0.0 AS mean_precision,
       CASE WHEN (pa - pef) / (1 - pef) < 0 THEN 'Poor' WHEN (pa - pef) / (1 - pef) <= 0.2 THEN 'Slight'
            WHEN (pa - pef) / (1 - pef) <= 0.4 THEN 'Fair' WHEN (pa - pef) / (1 - pef) <= 0.6 THEN 'Moderate'
            WHEN (pa - pef) / (1 - pef) <= 0.8 THEN 'Substantial' ELSE 'Almost Perfect' END AS kappa_band
FROM pa, pe, n, mp""")
def rater_agreement(spark, d):
    lab = table(spark, d, "labels")
    ag = AN.agreement(lab, "doc_id", ["quality", "toxic"])
    mp = AN.coherence_scores(lab.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull()),
                             ["quality", "toxic"]).agg(F.avg("model_precision").alias("mean_precision"))
    j = ag.withColumn("_k", F.lit(1)).join(mp.withColumn("_k", F.lit(1)), "_k")
    return j.select("raters", "items", r6("observed_agreement").alias("observed_agreement"),
                    r6("fleiss_kappa").alias("fleiss_kappa"), r6("gwet_ac1").alias("gwet_ac1"),
                    r6("mean_precision").alias("mean_precision"), AN.landis_koch("fleiss_kappa").alias("kappa_band"))


@query("other_bucket", """
SELECT vec_id, CASE WHEN label IN (0, 1, 2) THEN CAST(label AS VARCHAR) ELSE 'other' END AS bucket FROM embeddings""")
def other_bucket(spark, d):
    e = table(spark, d, "embeddings")
    return FL.assign_other_category(e, "label", "bucket", [0, 1, 2]).select("vec_id", "bucket")


@query("selection_union", """
WITH e AS (SELECT vec_id, label, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS top_dim FROM embeddings)
SELECT DISTINCT vec_id, label FROM e WHERE top_dim = 0 OR label IN (3, 7)""")
def selection_union(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    keys = embedding_labelings(spark, d)["argmax"].where(F.col("cluster") == 0).select(F.col("key").alias("vec_id"))
    clusters = e.select("label").where(F.col("label").isin(3, 7))
    return AN.selection_union(e, "vec_id", "label", keys, clusters)
