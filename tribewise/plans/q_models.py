"""Model-fitting queries on the driver tables (rows-only checks): C2-C5, C8-C14, M6, E2, E10, E12.

Label numbers and learned vectors are not comparable across engines, so
these queries have no oracle SQL; tests compare partitions and invariants.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tribewise.operators import activity as A
from tribewise.operators import clusters as CL
from tribewise.operators import embeddings as E
from tribewise.operators import sgns as SG
from tribewise.operators import text as T
from tribewise.operators import topics as TP
from tribewise.plans import roles
from tribewise.plans.q_activity import TOP_N, USER_EXCLUDE
from tribewise.plans.q_embed import cooc_df, emb
from tribewise.plans.q_text import _CLASS_SQL, MAX_DF, MIN_DF, VOCAB_SIZE, docs_filtered
from tribewise.plans.registry import query, r6, table
from tribewise.session import cut_lineage

N_CLUSTERS = 10
N_TOPICS = 10
SEED = 100


def _vectors(spark, d):
    return emb(spark, d).select("key", "vector")


@query("kmeans_assignments")
def kmeans_assignments(spark, d):
    out, _ = CL.fit_clusters(_vectors(spark, d), "kmeans", n_clusters=N_CLUSTERS, random_state=SEED)
    return out


@query("agglomerative_assignments")
def agglomerative_assignments(spark, d):
    out, _ = CL.fit_clusters(_vectors(spark, d), "agglomerative", n_clusters=N_CLUSTERS)
    return out


@query("dbscan_assignments", """
WITH RECURSIVE pts AS (SELECT vec_id AS key, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
unit AS (SELECT key, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM pts),
near AS (SELECT a.key AS a, b.key AS b, 1.0 - list_dot_product(a.v, b.v) AS d FROM unit a JOIN unit b ON a.key <> b.key
         WHERE 1.0 - list_dot_product(a.v, b.v) <= 0.5),
core AS (SELECT a AS key FROM near GROUP BY a HAVING count(*) + 1 >= 5),
links AS (SELECT a, b FROM near WHERE a IN (SELECT key FROM core) AND b IN (SELECT key FROM core)),
reach AS (SELECT key AS a, key AS b FROM core UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
comp AS (SELECT a AS key, min(b) AS comp FROM reach GROUP BY a),
border AS (SELECT a AS key, arg_min(comp, struct_pack(d := d, c := comp)) AS comp FROM near JOIN comp ON comp.key = b
           WHERE a NOT IN (SELECT key FROM core) GROUP BY a),
labelled AS (SELECT key, dense_rank() OVER (ORDER BY comp) - 1 AS cluster FROM (SELECT * FROM comp UNION ALL SELECT * FROM border))
SELECT pts.key, coalesce(cluster, -1) AS cluster FROM pts LEFT JOIN labelled ON labelled.key = pts.key""")
def dbscan_assignments(spark, d):
    """Clusters numbered by their smallest core key."""
    out, _ = CL.fit_clusters(_vectors(spark, d), "dbscan")
    return out


@query("affinity_sparse")
def affinity_sparse(spark, d):
    """C4 over the graph of the 32 nearest vectors."""
    out, _ = CL.fit_clusters(_vectors(spark, d), "affinity", neighbors=32, damping=0.8, convergence_iter=15)
    return out


@query("cluster_sweep")
def cluster_sweep(spark, d):
    """One hierarchy per linkage, cut at several numbers of clusters, with M1-M3 and A17."""
    from tribewise.plans.jobs import cluster_count_sweep
    out = cluster_count_sweep(_vectors(spark, d), (5, 10, 25), ("kmeans", "agglomerative:single"), month="all")
    return out.select("month", "kind", "k", *[r6(c).alias(c) for c in ("silhouette", "calinski_harabasz", "davies_bouldin")],
                      "num_clusters", "min_size", "max_size")


@query("affinity_assignments")
def affinity_assignments(spark, d):
    """C4 with the reference's input: cosine distances used as affinities
    (``as_given``).  With negative distances the messages oscillate on these
    vectors and, like sklearn, no exemplar set converges within 1000 iterations."""
    out, _ = CL.fit_clusters(_vectors(spark, d), "affinity", affinity="as_given")
    return out


def _lda(spark, d):
    # the iterations of LDA read stored vectors, not texts
    docs = cut_lineage(docs_filtered(spark, d).select("doc_id", "tokens"))
    vocab = cut_lineage(T.vocabulary_of_tokens(docs, "tokens", min_df=MIN_DF, max_df=MAX_DF, vocab_size=VOCAB_SIZE))
    vec, _ = T.to_count_vectors(docs, "tokens", vocab)
    vec = cut_lineage(vec.select("doc_id", "vectorized"))
    model = TP.fit_lda(vec, "vectorized", num_topics=N_TOPICS, seed=SEED)
    return model, vec, vocab, docs


@query("lda_topics")
def lda_topics(spark, d):
    model, vec, _, _ = _lda(spark, d)
    return TP.topic_assignments(model, vec, "doc_id").select("doc_id", "topic", r6("probability").alias("probability"))


@query("lda_top_terms")
def lda_top_terms(spark, d):
    model, _, vocab, _ = _lda(spark, d)
    return TP.top_terms(model, vocab, 20).select("topic", "rank", "term_id", "term", r6("weight").alias("weight"))


@query("u_mass")
def u_mass(spark, d):
    model, _, vocab, docs = _lda(spark, d)
    terms = cut_lineage(TP.top_terms(model, vocab, 20))
    presence = docs.select("doc_id", F.explode("tokens").alias("term"))
    return TP.u_mass(terms, presence).select("topic", r6("coherence").alias("coherence"),
                                             r6("model_coherence").alias("model_coherence"))


@query("u_mass_classes", _CLASS_SQL + """,
ranked AS (SELECT source AS topic, term, row_number() OVER (PARTITION BY source ORDER BY ct.tf DESC, term) AS rank FROM ct QUALIFY rank <= 20),
held AS (SELECT DISTINCT doc_id, term FROM tf WHERE term IN (SELECT term FROM ranked)),
n AS (SELECT count(DISTINCT doc_id) AS n FROM tf),
df AS (SELECT term, count(*) AS d FROM held GROUP BY term),
prs AS (SELECT a.topic, a.term AS x, b.term AS y FROM ranked a JOIN ranked b ON a.topic = b.topic AND b.rank < a.rank),
co AS (SELECT p.x, p.y, count(*) AS c FROM (SELECT DISTINCT x, y FROM prs) p JOIN held h ON h.term = p.x JOIN held g ON g.term = p.y AND g.doc_id = h.doc_id GROUP BY ALL),
per AS (SELECT topic, avg(ln((coalesce(c, 0) / n + 1e-12) / (d / n))) AS coherence
        FROM prs LEFT JOIN co ON co.x = prs.x AND co.y = prs.y JOIN df ON df.term = prs.y, n GROUP BY topic)
SELECT topic, round(coherence, 6) + 0.0 AS coherence, round(avg(coherence) OVER (), 6) + 0.0 AS model_coherence FROM per""")
def u_mass_classes(spark, d):
    """M6 on fixed topics: the 20 commonest terms of each source, from bitmaps of their documents."""
    docs = docs_filtered(spark, d)
    order = Window.partitionBy("source").orderBy(F.desc("tf"), F.asc("term"))
    terms = (T.class_term_counts(docs, "source", "tokens").withColumn("rank", F.row_number().over(order)).where("rank <= 20")
             .select(F.col("source").alias("topic"), "rank", "term"))
    return TP.u_mass_of_documents(terms, docs, "tokens").select("topic", r6("coherence").alias("coherence"),
                                                               r6("model_coherence").alias("model_coherence"))


def _contexts(spark, d):
    kept = A.filter_top_n(roles.comments(spark, d),
                          A.get_top_n_counts(roles.comments(spark, d), "subreddit", TOP_N), "subreddit")
    return A.aggregate_for_vectorization(kept, "author", "subreddit", exclude_top_perc=USER_EXCLUDE, as_array=True)


@query("embedding_vectors")
def embedding_vectors(spark, d):
    """E2(b): Word2Vec over the user contexts, window = the longest context (A5)."""
    ctx = _contexts(spark, d).cache()
    window = int(A.collect_max_context_length(ctx).first()[0] or 5)
    vecs, _ = E.word2vec_embeddings(ctx, "subreddit_concat", vector_size=16, window=window, seed=SEED)
    return vecs.select("key", F.posexplode("vector").alias("dim", "value")).withColumn("value", r6("value"))


@query("sgns_vectors")
def sgns_vectors(spark, d):
    """Skip-gram with negative sampling and down-sampling, in many tasks, over the co-occurrence of the user runs."""
    c = roles.comments(spark, d)
    kept = A.filter_top_n(c, A.get_top_n_counts(c, "subreddit", TOP_N), "subreddit")
    runs = A.explode_runs(A.context_runs(kept, exclude_top_perc=USER_EXCLUDE))
    counts = runs.groupBy(F.col("subreddit").alias("item")).agg(F.sum("n").alias("n"))
    pairs = E.cooccurrence(runs, "author", "subreddit", n_col="n")
    vecs = SG.train(pairs, vector_size=16, negative=5, sample=1e-3, alpha=0.2, epochs=4, seed=SEED, counts=counts, block_items=256)
    return vecs.select("key", F.posexplode("vector").alias("dim", "value")).withColumn("value", r6("value"))


@query("ppmi_svd_vectors")
def ppmi_svd_vectors(spark, d):
    """E2(a): truncated SVD of the shifted PPMI of brand co-occurrence."""
    ppmi = E.shifted_ppmi(cooc_df(spark, d), 1)
    vecs = E.svd_embeddings(ppmi, 8)
    return vecs.select("key", F.posexplode("vector").alias("dim", "value")).withColumn("value", r6("value"))


@query("pca_projection")
def pca_projection(spark, d):
    return E.pca_projection(_vectors(spark, d), 2).select("key", r6("dim_1").alias("dim_1"), r6("dim_2").alias("dim_2"))


def part_analogies(spark, d):
    """Pairs (part, part + 1) of the same brand, sectioned by brand."""
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_partkey").alias("b"), F.col("p_brand"))
    pairs = p.join(nxt, ["p_partkey", "p_brand"]).select(
        F.col("p_brand").alias("section"), F.col("p_partkey").alias("pos"),
        F.col("p_partkey").cast("string").alias("a"), F.col("b").cast("string"))
    return E.generate_analogies(pairs)


@query("grid_results")
def grid_results(spark, d):
    """A grid of negative-sampling models scored by analogy accuracy (later model wins ties), 17 columns."""
    res, _, _ = E.grid_search(_contexts(spark, d), "subreddit_concat", part_analogies(spark, d),
                              {"vector_size": [8, 16], "alpha": [0.2]}, fixed={"epochs": 2, "negative": 5, "seed": SEED},
                              trainer="sgns", contexts_path="lineitem")
    return res.withColumn("accuracy", r6("accuracy"))
