"""Driver-table queries for the sources and sinks (S1-S19): each writes a whole table in a format and reads it back.

Files go to the shared folder of the session.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tribewise import schemas as S
from tribewise.functions import vectors as V
from tribewise.operators import text as T
from tribewise.operators.embeddings import read_analogy_pairs
from tribewise.plans import q_text, roles
from tribewise.plans.q_activity import _CONTEXTS_SQL, user_contexts_df
from tribewise.plans.registry import query, r6, table
from tribewise.session import checkpoint_dir, cut_lineage
from tribewise.sources import readers as R
from tribewise.sources import sinks as K


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/tw-{name}-{uuid.uuid4().hex}"


def _dumped(spark: SparkSession, rows: DataFrame, name: str) -> str:
    path = _folder(spark, name)
    K.write_dump(rows.withColumn("undeclared", F.lit(1)), path)
    return path


@query("dump_comments", "SELECT id, CAST(NULL AS VARCHAR) AS parent_id, score, link_id, author, subreddit, body, created_utc "
       f"FROM ({roles.COMMENTS_SQL})")
def dump_comments(spark, d):
    return R.read_dump(spark, _dumped(spark, roles.comments(spark, d), "comments"))


@query("dump_submissions_failfast", "SELECT author, created_utc, id, score, selftext, title, CAST(NULL AS VARCHAR) AS url, "
       f"CAST(NULL AS VARCHAR) AS subreddit FROM ({roles.SUBMISSIONS_SQL})")
def dump_submissions_failfast(spark, d):
    return R.read_dump(spark, [_dumped(spark, roles.submissions(spark, d), "submissions")], S.SUBMISSIONS, mode="FAILFAST")


@query("contexts_round_trip", _CONTEXTS_SQL + "\nSELECT subreddit_concat, context_length FROM ctx")
def contexts_round_trip(spark, d):
    path = _folder(spark, "contexts")
    K.write_contexts(user_contexts_df(spark, d), path)
    back = R.read_contexts(spark, path)
    return back.select(F.array_join(S.CONTEXT_OUT, " ").alias(S.CONTEXT_OUT), F.size(S.CONTEXT_OUT).cast("bigint").alias(S.CONTEXT_LENGTH))


@query("vocabulary_csv", "SELECT CAST(l_partkey AS VARCHAR) AS subreddit, count(*) AS count FROM lineitem GROUP BY 1")
def vocabulary_csv(spark, d):
    path = _folder(spark, "vocabulary")
    K.write_counts(table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part")).count(), path)
    return R.read_vocabulary(spark, path)


@query("corpus_load", "SELECT doc_id, source, n_chars, md5(text) AS text_md5, lang FROM documents")
def corpus_load(spark, d):
    path = _folder(spark, "corpus")
    K.write_parquet(table(spark, d, "documents"), path, partition_by=["lang"])
    return R.read_corpus(spark, path).select("doc_id", "source", "n_chars", F.md5(F.encode("text", "utf-8")).alias("text_md5"), "lang")


@query("header_csv", "SELECT doc_id, quality, toxic FROM labels")
def header_csv(spark, d):
    path = _folder(spark, "labels")
    K.write_csv(table(spark, d, "labels"), path)
    return R.read_header_csv(spark, path, "doc_id bigint, quality int, toxic int")


@query("analogy_csv", """
SELECT row_number() OVER (ORDER BY s_suppkey) AS pos, s_name AS a, n_name || ', ' || r_name AS b
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def analogy_csv(spark, d):
    su, na, re = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    rows = (su.join(na, su.s_nationkey == na.n_nationkey).join(re, na.n_regionkey == re.r_regionkey)
            .select("s_suppkey", "s_name", F.concat_ws(", ", "n_name", "r_name").alias("b")))
    path = _folder(spark, "analogies")
    rows.coalesce(1).sortWithinPartitions("s_suppkey").select("s_name", "b").write.csv(path)  # one file: its line order is the data
    return read_analogy_pairs(spark, [path]).select("pos", "a", "b")


@query("collection_members", "SELECT 'customers' AS collection, c_name AS member FROM customer")
def collection_members(spark, d):
    path = _folder(spark, "collection")
    cu = table(spark, d, "customer")
    lines = cu.select(F.explode(F.array(F.concat(F.lit("  "), "c_name", F.lit(" ")), F.lit("   "))).alias("value"))
    lines.write.text(path)
    return R.read_collection(spark, path, "customers")


@query("metrics_by_month", """
SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, max(o_orderkey) AS last_key FROM orders GROUP BY 1""")
def metrics_by_month(spark, d):
    path = _folder(spark, "metrics")
    per = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("m")).agg(
        F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last_key"))
    per.write.partitionBy("m").json(path)
    return R.read_metrics(spark, path).select("month", "n", "last_key")


@query("vectors_round_trip", """
SELECT vec_id, round(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) FOR x IN embedding]), 6) + 0.0 AS norm2, len(embedding) AS dims
FROM embeddings""")
def vectors_round_trip(spark, d):
    path = _folder(spark, "vectors")
    K.save_vectors(table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector")), path)
    v = V.as_doubles("vector")
    return K.load_vectors(spark, path).select(F.col("key").alias("vec_id"), r6(V.dot(v, v)).alias("norm2"),
                                              F.size("vector").cast("bigint").alias("dims"))


@query("kmeans_reload", "SELECT count(*) AS n, count(*) AS n_equal FROM embeddings")
def kmeans_reload(spark, d):
    """Labels of a stored model equal those of the fitted one."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    rows = table(spark, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    fitted = KMeans(k=10, seed=100, maxIter=5, predictionCol="a").fit(rows)
    path = _folder(spark, "kmeans")
    K.save_pipeline(fitted, path)
    both = K.load_kmeans(path).setPredictionCol("b").transform(fitted.transform(rows))
    return both.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("a") == F.col("b")).cast("bigint")).alias("n_equal"))


@query("text_model_reload", q_text._VOCAB_SQL + """
SELECT tf.doc_id, count(*) AS n_terms, CAST(sum(tf.tf) AS BIGINT) AS n_tokens FROM tf JOIN v ON tf.term = v.term GROUP BY tf.doc_id""")
def text_model_reload(spark, d):
    """A stored bag-of-words model gives each document its terms and counts."""
    from pyspark.ml.feature import CountVectorizerModel
    docs = cut_lineage(q_text.docs_filtered(spark, d).select("doc_id", "tokens"))
    vocab = T.vocabulary_of_tokens(docs, "tokens", min_df=q_text.MIN_DF, max_df=q_text.MAX_DF, vocab_size=q_text.VOCAB_SIZE)
    _, model = T.to_count_vectors(docs, "tokens", vocab)
    path = _folder(spark, "bag-of-words")
    K.save_pipeline(model, path)
    out = CountVectorizerModel.load(path).transform(docs)
    nz = out.select("doc_id", F.col("vectorized").alias("v"))
    return nz.select("doc_id", F.from_json(F.to_json(F.struct("v")), "v struct<indices:array<int>,values:array<double>>").alias("j")).select(
        "doc_id", F.size("j.v.indices").cast("bigint").alias("n_terms"),
        F.aggregate("j.v.values", F.lit(0.0), lambda a, x: a + x).cast("bigint").alias("n_tokens")).filter("n_terms > 0")


@query("text_pipeline_reload", q_text._VOCAB_SQL + """
SELECT tf.doc_id, v.term_id, v.term, round(tf.tf * ln((n + 1.0) / (v.doc_freq + 1.0)), 6) + 0.0 AS weight
FROM tf JOIN v ON tf.term = v.term, nd""")
def text_pipeline_reload(spark, d):
    """A fitted text pipeline (pattern, stop words, vocabulary, IDF) is stored, loaded and applied."""
    from tribewise.operators import text_pipeline as P
    docs = table(spark, d, "documents").select("doc_id", "text")
    fitted = P.TextPipeline(inputCol="text", minDF=q_text.MIN_DF, maxDF=q_text.MAX_DF, vocabSize=q_text.VOCAB_SIZE, useIDF=True).fit(docs)
    path = _folder(spark, "text-pipeline")
    K.save_pipeline(fitted, path)
    model = P.TextPipelineModel.load(path)
    return P.terms_of_vectors(model.transform(docs), "doc_id", model.vocabulary).withColumn("weight", r6("weight"))


@query("results_round_trip", """
SELECT 'by_norm' AS model, vec_id AS key, label AS cluster, len(embedding) AS dims FROM embeddings""")
def results_round_trip(spark, d):
    """A results table joined with a table by key, through its CSV."""
    from tribewise.operators import clusters as CL
    e = table(spark, d, "embeddings")
    out = CL.results_table(e.select(F.col("vec_id").alias("key"), F.col("label").alias("cluster")), "by_norm",
                           e.select(F.col("vec_id").alias("key"), F.size("embedding").cast("bigint").alias("dims")))
    path = _folder(spark, "results")
    K.write_csv(out, path)
    return R.read_header_csv(spark, path, out.schema)
