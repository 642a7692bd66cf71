"""Iterative models against small NumPy references (partitions, not label values)."""

import numpy as np

from tribewise.operators import clusters as CL


def _partition(labels):
    groups = {}
    for k, c in labels:
        groups.setdefault(c, set()).add(k)
    return sorted(sorted(g) for g in groups.values())


def _naive_average_cosine(X, k):
    Xn = X / np.linalg.norm(X, axis=1, keepdims=True)
    D = 1 - Xn @ Xn.T
    clusters = [[i] for i in range(len(X))]
    while len(clusters) > k:
        best = None
        for a in range(len(clusters)):
            for b in range(a + 1, len(clusters)):
                d = D[np.ix_(clusters[a], clusters[b])].mean()
                if best is None or d < best[0]:
                    best = (d, a, b)
        _, a, b = best
        clusters[a] = clusters[a] + clusters[b]
        del clusters[b]
    return sorted(sorted(c) for c in clusters)


def test_agglomerative_matches_naive(spark):
    rng = np.random.default_rng(7)
    X = rng.standard_normal((24, 5))
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(len(X))], "key long, vector array<double>")
    got = CL.agglomerative(df, n_clusters=4).collect()
    assert _partition([(r["key"], r["cluster"]) for r in got]) == _naive_average_cosine(X, 4)


def _sklearn_like_ap(S, damping=0.5, max_iter=1000, conv=50):
    n = len(S)
    S = S.copy()
    S.flat[::n + 1] = np.median(S)
    A = np.zeros((n, n)); R = np.zeros((n, n)); e = np.zeros((n, conv)); ind = np.arange(n)
    for it in range(max_iter):
        AS = A + S; I = np.argmax(AS, axis=1); Y = AS[ind, I]; AS[ind, I] = -np.inf; Y2 = AS.max(axis=1)
        tmp = S - Y[:, None]; tmp[ind, I] = S[ind, I] - Y2
        R = damping * R + (1 - damping) * tmp
        tmp = np.maximum(R, 0); tmp.flat[::n + 1] = R.flat[::n + 1]
        tmp -= tmp.sum(axis=0); dA = np.diag(tmp).copy(); tmp.clip(0, np.inf, tmp); tmp.flat[::n + 1] = dA
        A = damping * A - (1 - damping) * tmp
        E = (np.diag(A) + np.diag(R)) > 0; e[:, it % conv] = E
        if it >= conv:
            se = e.sum(axis=1)
            if np.sum((se == conv) + (se == 0)) == n and E.sum() > 0:
                break
    I = np.flatnonzero(E)
    c = np.argmax(S[:, I], axis=1); c[I] = np.arange(len(I))
    for k in range(len(I)):
        ii = np.where(c == k)[0]
        I[k] = ii[np.argmax(np.sum(S[ii[:, None], ii], axis=0))]
    c = np.argmax(S[:, I], axis=1); c[I] = np.arange(len(I))
    return I[c]


def test_affinity_matches_numpy(spark):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((3, 4)) * 4
    X = np.vstack([centers[i % 3] + rng.standard_normal(4) * 0.3 for i in range(30)])
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(len(X))], "key long, vector array<double>")
    got = CL.affinity_propagation(df, block_rows=8, check_every=1).collect()
    Xn = X / np.linalg.norm(X, axis=1, keepdims=True)
    ref = _sklearn_like_ap(-(1 - Xn @ Xn.T))
    assert _partition([(r["key"], r["cluster"]) for r in got]) == _partition(list(enumerate(ref)))


def test_dbscan_matches_numpy(spark):
    rng = np.random.default_rng(11)
    centers = rng.standard_normal((3, 6)) * 3
    X = np.vstack([centers[i % 3] + rng.standard_normal(6) * 0.4 for i in range(45)] + [rng.standard_normal(6) * 5])
    eps, ms = 0.05, 4
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(len(X))], "key long, vector array<double>")
    got = CL.dbscan(df, eps=eps, min_samples=ms).collect()
    Xn = X / np.linalg.norm(X, axis=1, keepdims=True)
    D = 1 - Xn @ Xn.T
    n = len(X)
    nb = [(D[i] <= eps) & (np.arange(n) != i) for i in range(n)]
    core = np.array([nb[i].sum() + 1 >= ms for i in range(n)])
    comp = -np.ones(n, dtype=int)
    for s in np.flatnonzero(core):
        if comp[s] >= 0:
            continue
        stack, comp[s] = [s], s
        while stack:
            i = stack.pop()
            for j in np.flatnonzero(nb[i] & core):
                if comp[j] < 0:
                    comp[j] = s
                    stack.append(j)
    for i in np.flatnonzero(~core):
        cand = np.flatnonzero(nb[i] & core)
        if len(cand):
            comp[i] = comp[cand[np.lexsort((comp[cand], D[i, cand]))[0]]]
    ref = [(i, int(c)) for i, c in enumerate(comp)]
    noise_ref = sorted(i for i, c in ref if c < 0)
    noise_got = sorted(r["key"] for r in got if r["cluster"] == -1)
    assert noise_got == noise_ref
    assert _partition([(r["key"], r["cluster"]) for r in got if r["cluster"] != -1]) == \
        _partition([(i, c) for i, c in ref if c >= 0])


def test_table_helpers(spark):
    from tribewise.operators import tables as TB
    df = spark.createDataFrame([("m1", 3.0), ("m2", 1.0), ("m3", 3.0)], "id string, vi double")
    pick = TB.min_max_pick(df, "id", "vi").collect()[0]
    assert (pick["min_id"], pick["max_id"]) == ("m2", "m1")
    a = spark.createDataFrame([("x", 1, 0.5)], "model string, cluster long, p double")
    b = spark.createDataFrame([("x", 1, 9)], "Model string, Cluster long, score long")
    j = TB.left_join_on(a, b, ["model", "cluster"], ["Model", "Cluster"]).collect()[0]
    assert j["score"] == 9
    assert TB.stack([a, a.withColumn("extra", a.p)]).count() == 2


def test_annotation_job_writes(spark, tmp_path):
    from tribewise.plans.jobs import annotation_job
    rows_ = [(f"k{i}", i % 2, 10 + (i * 7) % 5) for i in range(14)]
    assign = spark.createDataFrame([(k, c) for k, c, _ in rows_], "key string, cluster long")
    counts = spark.createDataFrame([(k, n) for k, _, n in rows_], "key string, count long")
    label, task, answers = annotation_job(assign, counts, "m", str(tmp_path), top_n=3)
    assert label.count() == 2
    a = answers.collect()
    assert all(1 <= r["intruder_position"] <= 4 for r in a)
    assert spark.read.option("header", True).csv(str(tmp_path / "m_label_task")).count() == 2


def test_word2vec_queries_run_on_the_driver_tables(spark):
    import __spark_entry__ as entry
    queries = entry.queries()
    vectors = queries["embedding_vectors"](spark, entry.SMOKE_DIR).collect()
    top = queries["top_n_communities"](spark, entry.SMOKE_DIR).collect()
    keys = {r["key"] for r in vectors}
    assert keys and len(vectors) == 16 * len(keys) and keys <= {str(r["community"]) for r in top}
    grid = queries["grid_results"](spark, entry.SMOKE_DIR).collect()
    assert sorted(r["vector_size"] for r in grid) == [8, 16]


def test_word2vec_of_contexts_without_words(spark):
    """No context is left where nearly all users have one comment: no vectors, and no error."""
    from tribewise.operators import activity as A
    from tribewise.operators import embeddings as E
    rows = [(f"u{i}", f"c{i % 3}") for i in range(50)] + [("v", "c0"), ("v", "c1")]
    contexts = A.aggregate_for_vectorization(spark.createDataFrame(rows, "author string, subreddit string"), "author", "subreddit", as_array=True)
    assert contexts.count() == 0
    vectors, model = E.word2vec_embeddings(contexts, "subreddit_concat", vector_size=4)
    assert vectors.columns == ["key", "vector"] and vectors.count() == 0 and model is None
    rare = spark.createDataFrame([(["a", "b"],), (["c"],)], "words array<string>")
    assert E.word2vec_embeddings(rare, "words", vector_size=4, min_count=2)[0].count() == 0
    assert E.word2vec_embeddings(rare, "words", vector_size=4, min_count=1)[0].count() == 3


def test_affinity_tiles_and_stop_rule(spark):
    """The answer at 3 x 3 tiles is NumPy's, also when the iterations end right where sklearn's rule first holds."""
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((3, 4)) * 4
    X = np.vstack([centers[i % 3] + rng.standard_normal(4) * 0.3 for i in range(20)])
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(len(X))], "key long, vector array<double>")
    Xn = X / np.linalg.norm(X, axis=1, keepdims=True)
    D = -(1 - Xn @ Xn.T)
    want = _sklearn_like_ap(D, conv=7)
    got = CL.affinity_propagation(df, block_rows=8, convergence_iter=7).collect()
    assert len(set(want)) > 1
    assert _partition([(r["key"], r["cluster"]) for r in got]) == _partition(list(enumerate(want)))
    assert {r["cluster"] for r in CL.affinity_propagation(df, convergence_iter=7, max_iter=7).collect()} == {-1}
