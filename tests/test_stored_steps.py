"""Text queries read the documents once: later steps start from stored tokens, vectors or counts."""

import math

import pytest

from tribewise.operators import text as T
from tribewise.operators import topics as TP
from tribewise.plans import q_models, q_sources, q_tables, q_text


def _stored(df) -> bool:
    files = df.inputFiles()
    return bool(files) and all("/tw-state-" in f for f in files)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    words = "apple pear plum fig grape melon kiwi lemon".split()
    rows = [(i, " ".join(words[(i * k) % 8] for k in range(1, 9)), "en", "ab"[i % 2], 40) for i in range(12)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("query", [q_text.tfidf_vectors, q_text.pmi_labels, q_text.popescul_ungar_labels, q_tables.top_terms_table,
                                   q_sources.text_model_reload], ids=lambda q: q.__name__)
def test_documents_are_read_once(spark, folder, query):
    out = query(spark, folder)
    assert _stored(out) and out.count() > 0


def test_lda_iterates_over_stored_vectors(spark, folder, monkeypatch):
    seen = []

    def fit(corpus, *args, **kw):
        seen.append(_stored(corpus))
        raise StopIteration
    monkeypatch.setattr(TP, "fit_lda", fit)
    for query in (q_models.lda_topics, q_models.lda_top_terms, q_models.u_mass):
        with pytest.raises(StopIteration):
            query(spark, folder)
    assert seen == [True] * 3


def test_text_pipeline_fits_on_stored_tokens(spark, folder, monkeypatch):
    from tribewise.operators import text_pipeline as P
    stats, weights, seen, fit = T.vocabulary_of_tokens, P.IDF.fit, [], []
    monkeypatch.setattr(T, "vocabulary_of_tokens", lambda docs, *a, **kw: seen.append(_stored(docs)) or stats(docs, *a, **kw))
    monkeypatch.setattr(P.IDF, "fit", lambda self, docs: fit.append(_stored(docs)) or weights(self, docs))
    assert q_sources.text_pipeline_reload(spark, folder).count() > 0
    assert seen == [True] and fit == [True]


def test_terms_of_vectors_keeps_entries_without_json(spark):
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql.types import LongType, StructField, StructType
    from tribewise.operators import text_pipeline as P
    rows = [(1, Vectors.sparse(4, [0, 3], [0.1, 2.0])), (None, Vectors.sparse(4, [1], [1e-300])), (2, None), (3, Vectors.sparse(4, [], [])),
            (1, Vectors.sparse(4, [2], [7.0])), (4, Vectors.dense([1.0, 0.0, 0.0, 2.0]))]
    docs = spark.createDataFrame(rows, StructType([StructField("id", LongType()), StructField("vectorized", VectorUDT())])).coalesce(1)
    vocab = spark.createDataFrame([(i, t) for i, t in enumerate("abcd")], "term_id int, term string")
    out = P.terms_of_vectors(docs, "id", vocab)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [(1, 0, "a", 0.1), (1, 3, "d", 2.0), (None, 1, "b", 1e-300), (1, 2, "c", 7.0)], key=str)
    assert "to_json" not in out._jdf.queryExecution().toString()


def test_labels_of_counted_classes(spark):
    counts = spark.createDataFrame([("a", "x", 3), ("a", "y", 1), ("b", "y", 4)], "source string, term string, tf bigint")
    got = {(r.source, r.term): round(r.score, 6) for r in T.pmi_labels(counts, "source", 5, bottom=False).collect()}
    assert got == {("a", "x"): 1.0, ("a", "y"): round(math.log2(1 / 4 / (5 / 8)), 6), ("b", "y"): round(math.log2(1 / (5 / 8)), 6)}
