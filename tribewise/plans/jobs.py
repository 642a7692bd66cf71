"""End-to-end jobs (P1-P9) composed from the operators.

Jobs return DataFrames (and fitted models where one is trained); sinks are
separate calls so a caller decides where and how results are written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tribewise import schemas as S
from tribewise.operators import activity as A
from tribewise.operators import filters as FL
from tribewise.sources import readers as R
from tribewise.sources import sinks as K


def community2vec_prep(comments: DataFrame, top_n: int = S.DEFAULT_TOP_N,
                       exclude_top_perc: float = S.DEFAULT_USER_EXCLUDE,
                       min_sentence_length: int = 2, community_col: str = S.COMMUNITY,
                       author_col: str = S.AUTHOR, user_profile_pattern: str | None = S.USER_PROFILE_PATTERN,
                       keep_context_col: bool = False) -> tuple[DataFrame, DataFrame]:
    """Comments -> (community counts, user contexts).

    The top-n is taken before deleted authors are removed (as in the
    reference); the user-profile regex only shapes the top-n input, the semi
    join removes the rest.
    """
    top_input = comments
    if user_profile_pattern:
        top_input = FL.filter_by_regex(comments, community_col, user_profile_pattern)
    counts = A.get_top_n_counts(top_input, community_col, top_n)
    kept = A.filter_top_n(comments, counts, community_col)
    kept = FL.remove_deleted_authors(kept, author_col)
    contexts = A.aggregate_for_vectorization(kept, author_col, community_col,
                                             min_sentence_length=min_sentence_length,
                                             exclude_top_perc=exclude_top_perc,
                                             keep_context_col=keep_context_col)
    return counts, contexts


def bag_of_words_prep(comments: DataFrame, submissions: DataFrame, top_n: int = S.DEFAULT_TOP_N,
                      top_n_from: str = "comments", exclude_top_perc: float = S.DEFAULT_USER_EXCLUDE,
                      max_time_delta: int | None = None, min_time_delta: int | None = None) -> DataFrame:
    """Comments and submissions -> joined thread pairs.

    F1 on both, top-n communities from either side, semi join both (J1),
    deleted text and authors removed (F3, F2), top users of the comments
    removed (J2), fullname prefix (F5), pair join (J3) and time window (F4,
    both bounds tested with ``is not None``).
    """
    from tribewise.operators.threads import join_submissions_and_comments
    c = FL.filter_by_regex(comments)
    s = FL.filter_by_regex(submissions)
    counts = A.get_top_n_counts(c if top_n_from == "comments" else s, S.COMMUNITY, top_n)
    c = FL.remove_deleted_authors(FL.remove_deleted_text(A.filter_top_n(c, counts), S.COMMENTS))
    s = FL.remove_deleted_authors(FL.remove_deleted_text(A.filter_top_n(s, counts), S.SUBMISSIONS))
    c = A.filter_out_top_users(c, S.AUTHOR, exclude_top_perc)
    s = FL.prefix_id_column(s, S.SUBMISSIONS)
    pairs = join_submissions_and_comments(s, c)
    return FL.filter_by_time_delta(pairs, max_time_delta, min_time_delta)


def drop_percentage_sweep(comments: DataFrame, submissions: DataFrame, percentages=(0.0, 0.02, 0.05, 0.1),
                          **kw) -> dict[float, DataFrame]:
    """P2 once per user-drop setting (lazy plans; the caller writes each)."""
    return {p: bag_of_words_prep(comments, submissions, exclude_top_perc=p, **kw) for p in percentages}


def text_job(pairs: DataFrame, min_df: float = 0.05, max_df: float = 0.95, vocab_size: int = 1 << 18,
             stop_language: str | None = "english", use_idf: bool = False, max_time_delta=None, min_time_delta=None,
             min_tf: float = 0.0, binary: bool = False, pattern: str | None = None, to_lowercase: bool = True,
             out_dir: str | None = None):
    """P4 (X6 + A8): pairs -> documents -> text pipeline (X5) -> vectors, length statistics.

    Returns (documents with tokens/vectors, fitted ``TextPipelineModel``, length statistics).  With ``out_dir``
    the vectors (``corpus``), the model (``text_model``) and the statistics (``lengths``) are stored there and read back.
    """
    from tribewise.operators.text_pipeline import TextPipeline, TextPipelineModel
    from tribewise.operators.threads import documents_from_pairs
    docs = documents_from_pairs(pairs, max_time_delta=max_time_delta, min_time_delta=min_time_delta)
    model = TextPipeline(minDF=min_df, maxDF=max_df, minTF=min_tf, vocabSize=vocab_size, binary=binary, useIDF=use_idf, pattern=pattern,
                         toLowercase=to_lowercase, stopLanguage=stop_language or "").fit(docs)
    if out_dir:
        base = out_dir.rstrip("/")
        model.write().overwrite().save(f"{base}/text_model")
        model = TextPipelineModel.load(f"{base}/text_model")
        K.write_parquet(model.transform(docs), f"{base}/corpus", "overwrite")
        vec = docs.sparkSession.read.parquet(f"{base}/corpus")
    else:
        vec = model.transform(docs)
    _, stats = A.document_length_statistics(vec, S.TOKENS)
    if out_dir:
        K.write_json(stats, f"{base}/lengths")
    return vec, model, stats


def embedding_job(contexts: DataFrame, analogies: DataFrame, grid: dict, tokens_col: str = S.CONTEXT_OUT,
                  trainer: str = "word2vec", contexts_path: str = "", **fixed):
    """P5 (A6 -> E10): window = longest context, then the grid."""
    from tribewise.operators.embeddings import grid_search
    if dict(contexts.dtypes)[tokens_col] == "string":
        contexts = contexts.withColumn(tokens_col, F.split(tokens_col, " "))
    window = contexts.agg(F.max(F.size(tokens_col))).first()[0] or 5
    fixed.setdefault("window", int(window))
    return grid_search(contexts, tokens_col, analogies, grid, fixed=fixed, trainer=trainer, contexts_path=contexts_path)


def cluster_metrics(vectors: DataFrame, assignments: DataFrame, key_col: str = "key", vec_col: str = "vector") -> DataFrame:
    """M1-M3 and A17 of one labeling as one row."""
    from tribewise.operators import quality as Q
    from tribewise.operators.compare import cluster_size_stats
    data = vectors.join(assignments, key_col)
    parts = [Q.silhouette_score(data, key_col, vec_col, "cluster"), Q.calinski_harabasz_score(data, vec_col, "cluster"),
             Q.davies_bouldin_score(data, vec_col, "cluster"), cluster_size_stats(assignments)]
    row = parts[0].withColumn("_k", F.lit(1))
    for part in parts[1:]:
        row = row.join(part.withColumn("_k", F.lit(1)), "_k")
    return row.drop("_k")


def cluster_job(vectors: DataFrame, kind: str, model_name: str, key_col: str = "key", vec_col: str = "vector",
                counts: DataFrame | None = None, out_dir: str | None = None, month: str | None = None, **params):
    """Fit, metrics (M1-M3 as one row), clusters table, keyword table.

    Returns (clusters (model, key, cluster), metrics row, members-per-cluster table).  With ``out_dir`` everything is stored
    there and read back: ``model`` (the k-means model; for the other kinds the labels, which ``predict_by_key``
    reads), ``parameters`` and ``metrics`` (JSON), ``clusters`` and ``keywords`` (CSV with a header).
    """
    from tribewise.operators import clusters as CL
    from tribewise.operators.compare import cluster_members_string
    from tribewise.session import cut_lineage
    assign, model = CL.fit_clusters(vectors, kind, key_col, vec_col, **params)
    assign = cut_lineage(assign)
    metrics = cluster_metrics(vectors, assign, key_col, vec_col).withColumn("model", F.lit(model_name)).withColumn("month", F.lit(month))
    table = CL.results_table(assign, model_name, counts, key_col)
    keywords = cluster_members_string(assign, key_col)
    if not out_dir:
        return table, metrics, keywords
    spark, base = vectors.sparkSession, out_dir.rstrip("/")
    if model is not None:
        K.save_pipeline(model, f"{base}/model")
    else:
        K.write_parquet(assign, f"{base}/model", "overwrite")
    K.write_json(K.params_frame(spark, {**CL.DEFAULTS[kind], **params, "kind": kind, "model": model_name}), f"{base}/parameters")
    K.write_json(metrics, f"{base}/metrics")
    K.write_csv(table, f"{base}/clusters")
    K.write_csv(keywords, f"{base}/keywords")
    return (R.read_header_csv(spark, f"{base}/clusters", table.schema), spark.read.schema(metrics.schema).json(f"{base}/metrics"),
            R.read_header_csv(spark, f"{base}/keywords", keywords.schema))


def topic_job(corpus: DataFrame, vocab: DataFrame, id_col: str, out_dir: str, num_topics: int = 250, features_col: str = S.VECTORIZED,
              num_terms: int = 20, extra: DataFrame | None = None, **lda):
    """C16 for topics: LDA stored as ``model``, (document, topic, probability) as ``clusters`` and the top terms as
    ``keywords`` CSV; ``extra`` (by ``id_col``) is joined to the topics table (C12).  Returns (model, topics, terms), read back."""
    from tribewise.operators import topics as TP
    spark, base = corpus.sparkSession, out_dir.rstrip("/")
    fitted = TP.fit_lda(corpus, features_col, num_topics=num_topics, **lda)
    K.save_pipeline(fitted, f"{base}/model")
    model = K.load_lda(f"{base}/model", lda.get("optimizer", "online"))
    topics = TP.topic_assignments(model, corpus, id_col)
    if extra is not None:
        topics = topics.join(extra, id_col)
    terms = TP.top_terms_table(TP.top_terms(model, vocab, num_terms))
    K.write_csv(topics, f"{base}/clusters")
    K.write_csv(terms, f"{base}/keywords")
    return model, R.read_header_csv(spark, f"{base}/clusters", topics.schema), R.read_header_csv(spark, f"{base}/keywords", terms.schema)


def cluster_count_sweep(vectors: DataFrame, ks, kinds=("kmeans",), key_col: str = "key", vec_col: str = "vector",
                        month: str | None = None, **params) -> DataFrame:
    """(month, kind, k, M1-M3, A17) for each kind and k, one long table.

    A kind is ``kmeans`` or ``agglomerative`` with an optional linkage (``agglomerative:single``).  Hierarchies are
    fitted once and cut at every k (``cut_many``).
    """
    from tribewise.operators import clusters as CL
    from tribewise.session import cut_lineage
    out = None
    for kind in kinds:
        name, _, linkage = kind.partition(":")
        cuts = None
        if name == "agglomerative":
            metric = "euclidean" if linkage == "ward" else params.get("metric", "cosine")
            tree = CL.dendrogram(vectors, linkage or "average", metric, key_col, vec_col)
            cuts = cut_lineage(CL.cut_many(vectors.select(key_col), tree, ks, key_col))
        for k in ks:
            assign = (cuts.where(F.col("k") == k).drop("k") if cuts is not None
                      else cut_lineage(CL.fit_clusters(vectors, name, key_col, vec_col, n_clusters=k)[0]))
            row = cluster_metrics(vectors, assign, key_col, vec_col).select(
                F.lit(month).cast("string").alias("month"), F.lit(kind).alias("kind"), F.lit(k).alias("k"), "*")
            out = row if out is None else out.unionByName(row)
    return out


class RunManifest:
    """A table of finished (month, step) pairs with the folder of each result; a rerun goes on where the last one ended.

    A step writes to a folder of its own and is entered only afterwards: a folder without an entry is never read.
    """

    SCHEMA = "month string, step string, path string, version long"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = f"{self.folder}/manifest"

    def entries(self) -> DataFrame:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def step(self, month: str, step: str, build) -> DataFrame:
        """The result of ``build()`` (a DataFrame), from its table if the step is finished."""
        done = self.entries()
        found = done.where((F.col("month") == month) & (F.col("step") == step)).orderBy(F.desc("version")).first()
        if found is not None:
            return self.spark.read.parquet(found["path"])
        version = (done.agg(F.max("version")).first()[0] or 0) + 1
        path = f"{self.folder}/{month}/{step}-{version}-{uuid.uuid4().hex[:8]}"
        build().write.parquet(path)
        self.spark.createDataFrame([(month, step, path, version)], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        return self.spark.read.parquet(path)


def monthly_pipeline(months: dict, run_dir: str, top_n: int, analogies: DataFrame, grid: dict, kinds=("kmeans", "agglomerative"),
                     n_clusters: int = 100, trainer: str = "sgns", exclude_top_perc: float = S.DEFAULT_USER_EXCLUDE,
                     intruder_members: int = 5, **fixed) -> dict:
    """Per month P1 -> P5 -> E12 and P6 + M22 for each kind, every result a table under ``run_dir``.

    ``months`` maps a month to its comments or to a function that gives them.  Steps that ``RunManifest`` lists are read, not run again
    (scheduling is the caller's).
    """
    from tribewise.operators import annotate as AN
    from tribewise.operators import clusters as CL
    from tribewise.operators.embeddings import grid_search, pca_projection
    results = {}
    for month, comments in months.items():
        spark = analogies.sparkSession
        run = RunManifest(spark, run_dir)

        def rows(comments=comments):
            return comments() if callable(comments) else comments
        counts = run.step(month, "counts", lambda: community2vec_prep(rows(), top_n=top_n)[0])
        contexts = run.step(month, "contexts", lambda: community2vec_prep(rows(), top_n=top_n, exclude_top_perc=exclude_top_perc)[1])
        tokens = contexts.withColumn(S.CONTEXT_OUT, F.split(S.CONTEXT_OUT, " "))
        trained = {}

        def train():
            if not trained:
                trained["fit"] = grid_search(tokens, S.CONTEXT_OUT, analogies, grid, fixed=fixed, trainer=trainer, contexts_path=run_dir)
            return trained["fit"]
        vectors = run.step(month, "vectors", lambda: train()[1].withColumn("model_id", F.lit(train()[2])))
        out = {"counts": counts, "contexts": contexts, "vectors": vectors, "grid": run.step(month, "grid", lambda: train()[0]),
               "projection": run.step(month, "projection", lambda: pca_projection(vectors, 2)), "clusters": {}}
        by_key = counts.withColumnRenamed(S.COMMUNITY, "key")
        for kind in kinds:
            name = f"{month}_{kind}"
            assign = run.step(month, f"{kind}-clusters", lambda: CL.fit_clusters(vectors, kind, n_clusters=n_clusters)[0])
            metrics = run.step(month, f"{kind}-metrics", lambda: cluster_metrics(vectors, assign).withColumns(
                {"model": F.lit(name), "month": F.lit(month)}))
            joined = AN.assignments_with_counts(assign, by_key, "key")
            label = run.step(month, f"{kind}-label-task", lambda: AN.label_task(joined, name))
            answers = run.step(month, f"{kind}-intruder-answers", lambda: AN.intruder_task(joined, name, intruder_members)[1])
            out["clusters"][kind] = {"clusters": assign, "metrics": metrics, "label_task": label, "intruder_answers": answers}
        results[month] = out
    return results


def lda_pipeline(comments: DataFrame, submissions: DataFrame, num_topics: int = 250, max_time_delta: int | None = None,
                 min_time_delta: int | None = None, lda: dict | None = None, prep: dict | None = None, **text_kw):
    """P2 (with its time window) -> P4 (IDF weights if asked for) -> C8 with assignments and top terms."""
    from tribewise.operators import topics as TP
    pairs = bag_of_words_prep(comments, submissions, max_time_delta=max_time_delta, min_time_delta=min_time_delta, **(prep or {}))
    vec, text_model, _ = text_job(pairs, **text_kw)
    model = TP.fit_lda(vec, S.VECTORIZED, num_topics=num_topics, **(lda or {}))
    return model, TP.topic_assignments(model, vec.withColumnRenamed("id", "doc_id"), "doc_id"), TP.top_terms(model, text_model.vocabulary)


def explorer_tables(vectors: DataFrame, n_clusters: int, selected_keys: DataFrame, selected_clusters: DataFrame,
                    keep_clusters=(), key_col: str = "key", vec_col: str = "vector"):
    """K-means + projection joined, an 'other' bucket, the selection union, and the metrics row (M1-M3)."""
    from tribewise.operators import annotate as AN
    from tribewise.operators import clusters as CL
    from tribewise.operators.embeddings import pca_projection
    from tribewise.session import cut_lineage
    assign = cut_lineage(CL.kmeans(vectors, n_clusters, key_col=key_col, vec_col=vec_col)[0])
    table = assign.join(pca_projection(vectors, 2, key_col, vec_col), key_col)
    table = FL.assign_other_category(table, "cluster", "cluster_bucket", keep_clusters)
    selection = AN.selection_union(table, key_col, "cluster", selected_keys, selected_clusters)
    return table, selection, cluster_metrics(vectors, assign, key_col, vec_col)


def annotation_job(assignments: DataFrame, counts: DataFrame, model_name: str, out_dir: str | None = None,
                   top_n: int = 5, seed: int = 0, key_col: str = "key", cluster_col: str = "cluster",
                   count_col: str = "count"):
    """Join counts (J5), label task (A10), intruder task and answer key.

    Writes ``<out_dir>/<model>_label_task``, ``..._intruder_task`` and
    ``..._intruder_task_answers`` as header CSVs when ``out_dir`` is given.
    """
    from tribewise.operators import annotate as AN
    from tribewise.sources.sinks import write_csv
    joined = AN.assignments_with_counts(assignments, counts, key_col)
    label = AN.label_task(joined, model_name, key_col, cluster_col, count_col)
    task, answers = AN.intruder_task(joined, model_name, top_n, seed, key_col, cluster_col, count_col)
    if out_dir:
        base = out_dir.rstrip("/")
        write_csv(label, f"{base}/{model_name}_label_task")
        write_csv(task, f"{base}/{model_name}_intruder_task")
        write_csv(answers, f"{base}/{model_name}_intruder_task_answers")
    return label, task, answers
