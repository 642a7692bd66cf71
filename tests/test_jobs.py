"""Jobs that store and read back, the text pipeline object, the run manifest, coherence from bitmaps."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tribewise.operators import clusters as CL
from tribewise.operators import text_pipeline as P
from tribewise.operators import topics as TP
from tribewise.plans import jobs as J
from tribewise.sources import sinks as K

DOCS = [(1, "the cat sat on the mat"), (2, "Cat and dog, dog"), (3, None), (4, "dog dog cat bird"), (5, "")]


def _docs(spark):
    return spark.createDataFrame(DOCS, "id long, document_text string")


def _terms(model, docs):
    return {(r.id, r.term): round(r.weight, 9) for r in P.terms_of_vectors(model.transform(docs), "id", model.vocabulary).collect()}


@pytest.mark.parametrize("options,want", [
    ({"minDF": 1.0, "maxDF": 1.0 * 2 ** 40}, {(1, "cat"): 1, (1, "sat"): 1, (1, "mat"): 1, (2, "cat"): 1, (2, "dog"): 2, (4, "dog"): 2, (4, "cat"): 1, (4, "bird"): 1}),
    ({"minDF": 2.0, "binary": True}, {(1, "cat"): 1, (2, "cat"): 1, (2, "dog"): 1, (4, "dog"): 1, (4, "cat"): 1}),
    ({"minDF": 2.0, "minTF": 2.0}, {(2, "dog"): 2, (4, "dog"): 2}),
    ({"minDF": 0.4, "useIDF": True}, {(1, "cat"): math.log(6 / 4), (2, "cat"): math.log(6 / 4), (2, "dog"): 2 * math.log(6 / 3),
                                      (4, "dog"): 2 * math.log(6 / 3), (4, "cat"): math.log(6 / 4)}),
    ({"minDF": 1.0, "stopLanguage": "", "toLowercase": False, "pattern": "[a-z]+", "vocabSize": 1}, {(2, "dog"): 2, (4, "dog"): 2}),
])
def test_text_pipeline_survives_storage(spark, tmp_path, options, want):
    fitted = P.TextPipeline(**options).fit(_docs(spark))
    fitted.write().save(str(tmp_path / "m"))
    with pytest.raises(Exception):
        fitted.write().save(str(tmp_path / "m"))
    fitted.write().overwrite().save(str(tmp_path / "m"))
    loaded = P.TextPipelineModel.load(str(tmp_path / "m"))
    want = {k: round(float(v), 9) for k, v in want.items()}
    assert _terms(fitted, _docs(spark)) == _terms(loaded, _docs(spark)) == want
    for name, value in options.items():
        assert loaded.getOrDefault(name) == value
    assert loaded.word_ids().count() == fitted.vocabulary.count()
    estimator = P.TextPipeline(**options)
    estimator.write().overwrite().save(str(tmp_path / "e"))
    assert _terms(P.TextPipeline.load(str(tmp_path / "e")).fit(_docs(spark)), _docs(spark)) == want


def test_text_pipeline_without_terms(spark):
    with pytest.raises(ValueError):
        P.TextPipeline(minDF=9.0).fit(_docs(spark))


def test_coherence_from_bitmaps(spark):
    rng = np.random.default_rng(2)
    words = [f"t{i}" for i in range(12)]
    rows = [(i, [words[j] for j in rng.integers(0, 12, rng.integers(0, 9))]) for i in range(300)] + [(300, None)]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(4)
    terms = spark.createDataFrame([(t, r + 1, w) for t in range(3) for r, w in enumerate(rng.permutation(words)[:6].tolist() + ["never"])],
                                  "topic int, rank int, term string")
    presence = docs.select("doc_id", F.explode("tokens").alias("term"))
    want = {r.topic: (r.coherence, r.model_coherence) for r in TP.u_mass(terms, presence).collect()}
    for step in (2048, 7):
        got = {r.topic: (r.coherence, r.model_coherence) for r in TP.u_mass_of_documents(terms, docs, "tokens", step=step).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[t], want[t]) for t in want)
    assert TP.u_mass_of_documents(terms.limit(0), docs, "tokens").collect() == []


def _vectors(spark, n=40):
    rng = np.random.default_rng(4)
    C = rng.standard_normal((4, 5)) * 4
    return spark.createDataFrame([(i, (C[i % 4] + rng.standard_normal(5) * .2).tolist()) for i in range(n)], "key long, vector array<double>")


@pytest.mark.parametrize("kind", ["kmeans", "agglomerative"])
def test_cluster_job_stores_everything(spark, tmp_path, kind):
    vectors = _vectors(spark)
    params = {"random_state": 1} if kind == "kmeans" else {"linkage": "single"}
    table, metrics, keywords = J.cluster_job(vectors, kind, "m1", out_dir=str(tmp_path), month="2021-04", n_clusters=4, **params)
    groups = {}
    for r in table.collect():
        groups.setdefault(r.cluster, set()).add(r.key % 4)
    assert len(groups) == 4 and all(len(g) == 1 for g in groups.values())
    row = metrics.first()
    assert row.month == "2021-04" and row.model == "m1" and row.num_clusters == 4 and row.silhouette > 0.5 and row.davies_bouldin < 0.5
    assert sorted(len(r.members.split()) for r in keywords.collect()) == [10] * 4
    said = spark.read.json(str(tmp_path / "parameters")).first()
    assert said["kind"] == f'"{kind}"' and said["n_clusters"] == "4"
    if kind == "kmeans":
        again = K.load_kmeans(str(tmp_path / "model"))
        assert len(again.clusterCenters()) == 4
    else:
        found = CL.predict_by_key(spark.read.parquet(str(tmp_path / "model")), spark.createDataFrame([(3,), (99,)], "key long")).collect()
        assert {r.key: r.cluster >= 0 for r in found} == {3: True, 99: False}


def test_sweep_fits_a_hierarchy_once(spark, monkeypatch):
    calls = []
    fit = CL.agglomerative_merges
    monkeypatch.setattr(CL, "agglomerative_merges", lambda *a, **k: calls.append(a[1:3]) or fit(*a, **k))
    out = J.cluster_count_sweep(_vectors(spark, 24), (2, 4, 6), ("kmeans", "agglomerative:single"), month="2021-05").collect()
    assert calls == [("single", "cosine")]
    assert {(r.month, r.kind, r.k) for r in out} == {("2021-05", kind, k) for kind in ("kmeans", "agglomerative:single") for k in (2, 4, 6)}
    best = {r.kind: r.k for r in sorted(out, key=lambda r: r.silhouette)}
    assert best == {"kmeans": 4, "agglomerative:single": 4} and all(r.num_clusters == r.k for r in out)


def _comments(spark, seed):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(f"u{rng.integers(60)}", f"c{rng.integers(4) + 4 * (i % 3)}") for i in range(900)], "author string, subreddit string")


def test_monthly_pipeline_goes_on_after_a_failure(spark, tmp_path):
    analogies = spark.createDataFrame([("s", "c0", "c1", "c4", "c5")], "section string, a string, b string, c string, d string")
    grid = {"vector_size": [4], "alpha": [0.2]}
    args = dict(top_n=20, analogies=analogies, grid=grid, kinds=("kmeans",), n_clusters=3, exclude_top_perc=0.0, intruder_members=2,
                epochs=1, negative=5)

    class Lost(Exception):
        pass

    def lost():
        raise Lost

    with pytest.raises(Lost):
        J.monthly_pipeline({"2021-04": _comments(spark, 1), "2021-05": lost}, str(tmp_path), **args)
    first = J.RunManifest(spark, str(tmp_path)).entries().collect()
    assert {r.month for r in first} == {"2021-04"} and len(first) == 9
    assert sorted(r.version for r in first) == list(range(1, 10))
    # month 1 is not built again: its comments are gone now
    out = J.monthly_pipeline({"2021-04": lost, "2021-05": _comments(spark, 2)}, str(tmp_path), **args)
    entries = J.RunManifest(spark, str(tmp_path)).entries().collect()
    assert len(entries) == 18 and {r.path for r in first} <= {r.path for r in entries}
    for month in ("2021-04", "2021-05"):
        got = out[month]
        assert got["vectors"].count() == got["counts"].count() == got["projection"].count() == 12
        assert got["clusters"]["kmeans"]["clusters"].count() == 12 and got["clusters"]["kmeans"]["label_task"].count() == 3
        assert got["clusters"]["kmeans"]["metrics"].first().month == month and len(got["grid"].columns) == 17


def test_topic_job_and_text_job(spark, tmp_path):
    pairs = spark.createDataFrame([(f"p{i}", "title", f"cat dog {w} {w}", "body bird " + w, 5 + i, "c", f"k{i}")
                                   for i, w in enumerate(["sun", "moon", "star", "sun"] * 3)],
                                  "id string, title string, selftext string, body string, time_to_comment_in_seconds long, subreddit string, comments_id string")
    vec, model, stats = J.text_job(pairs, min_df=1.0, use_idf=True, out_dir=str(tmp_path / "text"))
    assert vec.count() == 12 and spark.read.json(str(tmp_path / "text" / "lengths")).first().num_documents == 12
    loaded = P.TextPipelineModel.load(str(tmp_path / "text" / "text_model"))
    assert loaded.getOrDefault("useIDF") and loaded.vocabulary.count() == model.vocabulary.count()
    counts = J.text_job(pairs, min_df=1.0)[0]
    extra = pairs.select("id", F.col("subreddit").alias("class")).distinct()
    _, topics, terms = J.topic_job(counts, model.vocabulary, "id", str(tmp_path / "lda"), num_topics=3, extra=extra, max_iter=3, seed=1,
                                   subsampling_rate=1.0)
    assert terms.count() == 3 and topics.select("id").distinct().count() == 12 and set(topics.columns) == {"id", "topic", "probability", "class"}
