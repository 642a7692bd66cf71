"""Driver-table queries for embeddings, analogies and cluster quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tribewise.operators import activity as A
from tribewise.operators import embeddings as E
from tribewise.operators import quality as Q
from tribewise.plans.registry import query, r6, table

USER_EXCLUDE = 0.05
NEGATIVE = 1
NN_K = 5


def brand_comments(spark, d):
    """(author, community) with community = the part's brand."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    od = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    pt = table(spark, d, "part").select("p_partkey", "p_brand")
    return (li.join(od, li.l_orderkey == od.o_orderkey).join(pt, li.l_partkey == pt.p_partkey)
            .select(F.col("o_custkey").cast("string").alias("author"), F.col("p_brand").alias("community")))


def cooc_df(spark, d):
    kept = A.filter_out_top_users(brand_comments(spark, d), "author", USER_EXCLUDE)
    return E.cooccurrence(kept, "author", "community")


_COOC_SQL = f"""
WITH c AS (SELECT CAST(o_custkey AS VARCHAR) AS author, p_brand AS community
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
u AS (SELECT author, percent_rank() OVER (ORDER BY count(*)) AS pr FROM c GROUP BY author),
f AS (SELECT * FROM c WHERE author IN (SELECT author FROM u WHERE pr <= {1.0 - USER_EXCLUDE})),
uc AS (SELECT author, community, count(*) AS n FROM f GROUP BY author, community),
co0 AS (SELECT x.community AS a, y.community AS b,
               CAST(sum(CASE WHEN x.community = y.community THEN x.n * (x.n - 1) ELSE x.n * y.n END) AS BIGINT) AS w
        FROM uc x JOIN uc y ON x.author = y.author GROUP BY x.community, y.community),
co AS (SELECT * FROM co0 WHERE w <> 0)"""


@query("cooccurrence", _COOC_SQL + "\nSELECT a, b, w FROM co")
def cooccurrence(spark, d):
    return cooc_df(spark, d)


@query("ppmi", _COOC_SQL + f""",
ra AS (SELECT a, sum(w) AS ra FROM co GROUP BY a),
cb AS (SELECT b, sum(w) AS cb FROM co GROUP BY b),
t AS (SELECT sum(w) AS total FROM co),
st AS (SELECT sum(pow(cb, 0.75)) AS st FROM cb),
p AS (SELECT a, b, ln((w / total) / ((ra / total) * (pow(cb, 0.75) / st))) - ln({NEGATIVE}) AS ppmi
      FROM co JOIN ra USING (a) JOIN cb USING (b), t, st)
SELECT a, b, round(ppmi, 6) + 0.0 AS ppmi FROM p WHERE ppmi > 0""")
def ppmi(spark, d):
    return E.shifted_ppmi(cooc_df(spark, d), NEGATIVE).withColumn("ppmi", r6("ppmi"))


def emb(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"),
                                                F.col("label"))


_NORM_SQL = """
WITH pts AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM pts)"""


@query("nearest_neighbors", _NORM_SQL + f""",
p AS (SELECT a.vec_id AS key, b.vec_id AS neighbor, list_dot_product(a.v, b.v) AS score FROM n a JOIN n b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, neighbor ASC) AS rank FROM p)
SELECT key, neighbor, round(score, 6) + 0.0 AS score, rank FROM r WHERE rank <= {NN_K}""")
def nearest_neighbors(spark, d):
    nn = E.nearest_neighbors(emb(spark, d), NN_K)
    return nn.select("key", "neighbor", r6("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("pairwise_cosine", _NORM_SQL + """
SELECT a.vec_id AS a, b.vec_id AS b, round(1.0 - list_dot_product(a.v, b.v), 6) + 0.0 AS distance
FROM n a JOIN n b ON a.vec_id < b.vec_id""")
def pairwise_cosine(spark, d):
    return E.pairwise_cosine_distances(emb(spark, d)).select("a", "b", r6("distance").alias("distance"))


@query("analogy_pairs", """
WITH p AS (SELECT r_name AS section, n_nationkey AS pos, n_name AS a, r_name AS b
           FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT x.section, x.a, x.b, y.a AS c, y.b AS d, x.pos AS pos_ab, y.pos AS pos_cd
FROM p x JOIN p y ON x.section = y.section AND x.pos < y.pos""")
def analogy_pairs(spark, d):
    n = table(spark, d, "nation")
    r = table(spark, d, "region")
    pairs = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("r_name").alias("section"), F.col("n_nationkey").alias("pos"),
        F.col("n_name").alias("a"), F.col("r_name").alias("b"))
    return E.generate_analogies(pairs)


def embedding_analogies(spark, d):
    """Pairs (x, x + 1) of consecutive vector ids, sectioned by the first one's label."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    nxt = e.select(F.col("vec_id").alias("b"), (F.col("vec_id") - 1).alias("a_id"))
    pairs = e.join(nxt, e.vec_id == nxt.a_id).select(
        F.col("label").alias("section"), F.col("vec_id").alias("pos"), F.col("vec_id").alias("a"), "b")
    return E.generate_analogies(pairs)


_ANALOGY_SQL = _NORM_SQL + """,
pr AS (SELECT x.label AS section, x.vec_id AS a, y.vec_id AS b FROM n x JOIN n y ON y.vec_id = x.vec_id + 1),
an AS (SELECT p.section, p.a, p.b, q.a AS c, q.b AS d FROM pr p JOIN pr q ON p.section = q.section AND p.a < q.a),
tg AS (SELECT an.*, list_transform(range(1, len(na.v) + 1), lambda i: nb.v[i] - na.v[i] + nc.v[i]) AS t
       FROM an JOIN n na ON na.vec_id = an.a JOIN n nb ON nb.vec_id = an.b JOIN n nc ON nc.vec_id = an.c),
sc AS (SELECT tg.section, tg.a, tg.b, tg.c, tg.d, k.vec_id AS cand, list_dot_product(k.v, tg.t) AS s
       FROM tg JOIN n k ON k.vec_id NOT IN (tg.a, tg.b, tg.c)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY section, a, b, c, d ORDER BY s DESC, cand ASC) AS rk FROM sc) WHERE rk = 1),
per AS (SELECT CAST(section AS VARCHAR) AS section, CAST(sum(CASE WHEN cand = d THEN 1 ELSE 0 END) AS BIGINT) AS correct,
               count(*) AS total FROM best GROUP BY section)"""


def analogy_per_section(spark, d):
    scored = E.score_analogies(embedding_analogies(spark, d), emb(spark, d))
    return E.analogy_accuracy(scored.withColumn("section", F.col("section").cast("string")))


@query("analogy_accuracy", _ANALOGY_SQL + """
SELECT section, correct, total, round(correct / CAST(total AS DOUBLE), 6) + 0.0 AS accuracy FROM per""")
def analogy_accuracy(spark, d):
    return analogy_per_section(spark, d).withColumn("accuracy", r6("accuracy"))


@query("analogy_report", _ANALOGY_SQL + """
SELECT round(sum(correct) / CAST(sum(total) AS DOUBLE), 6) + 0.0 AS accuracy,
       string_agg(section || ':' || correct || '/' || total, ',' ORDER BY section) AS detailed_accuracy FROM per""")
def analogy_report(spark, d):
    rep = E.detailed_accuracy_string(analogy_per_section(spark, d))
    return rep.withColumn("accuracy", r6("accuracy"))


_QUALITY_SQL = _NORM_SQL + """,
comp AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM pts) GROUP BY label, i),
cen AS (SELECT label, list(m ORDER BY i) AS c, FROM comp GROUP BY label),
sz AS (SELECT label, count(*) AS size FROM pts GROUP BY label),
sp AS (SELECT p.label, avg(list_distance(p.v, c.c)) AS s FROM pts p JOIN cen c USING (label) GROUP BY p.label),
tb AS (SELECT label, c, s FROM cen JOIN sp USING (label)),
db AS (SELECT x.label, max(CASE WHEN list_distance(x.c, y.c) = 0 THEN 0.0 ELSE (x.s + y.s) / list_distance(x.c, y.c) END) AS score
       FROM tb x JOIN tb y ON x.label <> y.label GROUP BY x.label)"""


@query("silhouette_cosine", _NORM_SQL + """,
dd AS (SELECT a.vec_id, a.label, b.label AS ol, 1.0 - list_dot_product(a.v, b.v) AS dist FROM n a JOIN n b ON a.vec_id <> b.vec_id),
g AS (SELECT vec_id, label, ol, avg(dist) AS md FROM dd GROUP BY vec_id, label, ol),
s AS (SELECT vec_id, label, max(CASE WHEN ol = label THEN md END) AS a, min(CASE WHEN ol <> label THEN md END) AS b
      FROM g GROUP BY vec_id, label)
SELECT round(avg(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) + 0.0 AS silhouette FROM s""")
def silhouette_cosine(spark, d):
    return Q.silhouette_score(emb(spark, d), "key", "vector", "label").select(r6("silhouette").alias("silhouette"))


@query("silhouette_points", """
WITH pts AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
dd AS (SELECT a.vec_id, a.label, b.label AS ol, list_distance(a.v, b.v) AS dist FROM pts a JOIN pts b ON a.vec_id <> b.vec_id),
g AS (SELECT vec_id, label, ol, avg(dist) AS md FROM dd GROUP BY vec_id, label, ol),
s AS (SELECT vec_id, label, max(CASE WHEN ol = label THEN md END) AS a, min(CASE WHEN ol <> label THEN md END) AS b
      FROM g GROUP BY vec_id, label)
SELECT vec_id, label, round(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END, 6) + 0.0 AS silhouette FROM s""")
def silhouette_points(spark, d):
    sp = Q.silhouette_points(emb(spark, d), "key", "vector", "label")
    return sp.select(F.col("key").alias("vec_id"), "label", r6("silhouette").alias("silhouette"))


@query("silhouette_by_cluster", """
WITH pts AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
dd AS (SELECT a.vec_id, a.label, b.label AS ol, list_distance(a.v, b.v) AS dist FROM pts a JOIN pts b ON a.vec_id <> b.vec_id),
g AS (SELECT vec_id, label, ol, avg(dist) AS md FROM dd GROUP BY vec_id, label, ol),
s AS (SELECT vec_id, label, max(CASE WHEN ol = label THEN md END) AS a, min(CASE WHEN ol <> label THEN md END) AS b
      FROM g GROUP BY vec_id, label)
SELECT label, round(avg(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) + 0.0 AS mean_silhouette
FROM s GROUP BY label""")
def silhouette_by_cluster(spark, d):
    sp = Q.silhouette_points(emb(spark, d), "key", "vector", "label")
    return sp.groupBy("label").agg(r6(F.avg("silhouette")).alias("mean_silhouette"))


@query("davies_bouldin", _QUALITY_SQL + """
SELECT round(avg(score), 6) + 0.0 AS davies_bouldin FROM db""")
def davies_bouldin(spark, d):
    return Q.davies_bouldin_score(emb(spark, d), "vector", "label").select(r6("davies_bouldin").alias("davies_bouldin"))


@query("davies_bouldin_clusters", _QUALITY_SQL + """
SELECT label, round(score, 6) + 0.0 AS score FROM db""")
def davies_bouldin_clusters(spark, d):
    per = Q.davies_bouldin_per_cluster(emb(spark, d), "vector", "label")
    return per.select("label", r6("score").alias("score"))


@query("calinski_harabasz", _QUALITY_SQL + """,
mu AS (SELECT list(m ORDER BY i) AS mu FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM pts) GROUP BY i)),
w AS (SELECT sum(pow(list_distance(p.v, c.c), 2)) AS w, count(*) AS n FROM pts p JOIN cen c USING (label)),
b AS (SELECT sum(size * pow(list_distance(c.c, mu), 2)) AS b, count(*) AS k FROM cen c JOIN sz USING (label), mu)
SELECT round(CASE WHEN w = 0 THEN 1.0 ELSE b * (n - k) / (w * (k - 1)) END, 6) + 0.0 AS calinski_harabasz FROM w, b""")
def calinski_harabasz(spark, d):
    return Q.calinski_harabasz_score(emb(spark, d), "vector", "label").select(
        r6("calinski_harabasz").alias("calinski_harabasz"))
