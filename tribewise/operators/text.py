"""Bag of words, vocabulary, idf and class labels.

The long table (doc, term, tf) is the working form: it partitions by
(doc, term), aggregates map-side and never needs the vocabulary on the
driver.  The vector form (``VectorUDT``) is produced only at the ML boundary
(``to_count_vectors``) from a vocabulary whose size is capped by
``vocab_size``, which is the only thing collected.

Term ids are ranks under the total order (corpus count desc, term asc); the
top-k cut of the vocabulary is a distributed top-k, and the id numbering
runs over the cut table only (bounded by ``vocab_size``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tribewise import schemas as S
from tribewise.session import cut_lineage


def term_frequencies(docs: DataFrame, id_col: str, tokens_col: str,
                     term_col: str = "term", tf_col: str = "tf") -> DataFrame:
    """(doc, term, tf) for every observed term (tf > 0 by construction)."""
    return (docs.select(id_col, F.explode(tokens_col).alias(term_col))
            .groupBy(id_col, term_col).agg(F.count(F.lit(1)).alias(tf_col)))


def term_stats(docs: DataFrame, tokens_col: str, term_col: str = "term") -> DataFrame:
    """(term, doc_freq, total_count) of documents with one row each, in one map-side combined aggregate.

    Each row emits its tokens and its distinct tokens, so no (document, term) pair is shuffled.
    """
    both = F.array(F.struct(F.col(tokens_col).alias("t"), F.lit(0).alias("d")),
                   F.struct(F.array_distinct(tokens_col).alias("t"), F.lit(1).alias("d")))
    return (docs.select(F.explode(both).alias("_x")).select(F.explode("_x.t").alias(term_col), F.col("_x.d").alias("_d")).groupBy(term_col)
            .agg(F.sum(F.col("_d").cast("bigint")).alias("doc_freq"),
                 F.sum((1 - F.col("_d")).cast("bigint")).alias("total_count")))


def vocabulary_of_tokens(docs: DataFrame, tokens_col: str, term_col: str = "term", min_df: float = 1.0,
                         max_df: float = 2 ** 63 - 1, vocab_size: int = 1 << 18) -> DataFrame:
    """X3/X7 from token rows: as ``fit_vocabulary``, without the (document, term) table."""
    return _numbered(term_stats(docs, tokens_col, term_col), docs, term_col, min_df, max_df, vocab_size)


def class_term_counts(docs: DataFrame, class_col: str, tokens_col: str, term_col: str = "term",
                      tf_col: str = "tf") -> DataFrame:
    """A12 from token rows: (class, term, tf) in one map-side combined aggregate."""
    return (docs.select(class_col, F.explode(tokens_col).alias(term_col))
            .groupBy(class_col, term_col).agg(F.count(F.lit(1)).alias(tf_col)))


def _df_bound(value: float, n_docs):
    """Spark CountVectorizer rule: >= 1 is a document count, < 1 a fraction."""
    return F.lit(float(value)) if value >= 1.0 else F.lit(float(value)) * n_docs


def fit_vocabulary(tf: DataFrame, docs: DataFrame, id_col: str = "doc_id", term_col: str = "term",
                   tf_col: str = "tf", min_df: float = 1.0, max_df: float = 2 ** 63 - 1,
                   vocab_size: int = 1 << 18) -> DataFrame:
    """(term_id, term, doc_freq, total_count).

    Terms with ``min_df <= df <= max_df`` (CountVectorizer semantics), then the
    ``vocab_size`` most frequent by (total desc, term asc), numbered from 0.
    """
    stats = tf.groupBy(term_col).agg(F.count(F.lit(1)).alias("doc_freq"),
                                     F.sum(tf_col).alias("total_count"))
    return _numbered(stats, docs, term_col, min_df, max_df, vocab_size)


def _numbered(stats: DataFrame, docs: DataFrame, term_col: str, min_df: float, max_df: float, vocab_size: int) -> DataFrame:
    n_docs = docs.select(F.count(F.lit(1))).scalar()
    stats = stats.where((F.col("doc_freq") >= _df_bound(min_df, n_docs))
                        & (F.col("doc_freq") <= _df_bound(max_df, n_docs)))
    top = stats.orderBy(F.col("total_count").desc(), F.col(term_col).asc()).limit(vocab_size)
    # bounded by vocab_size: numbering over the cut table only
    w = Window.orderBy(F.col("total_count").desc(), F.col(term_col).asc())
    return top.select((F.row_number().over(w) - 1).alias("term_id"), term_col, "doc_freq", "total_count")


def idf_weights(vocab: DataFrame, docs: DataFrame, term_col: str = "term") -> DataFrame:
    """``ln((N + 1) / (df + 1))`` per vocabulary term (Spark ML IDF)."""
    n_docs = docs.select(F.count(F.lit(1))).scalar()
    return vocab.select("term_id", term_col,
                        F.log((n_docs + F.lit(1.0)) / (F.col("doc_freq") + F.lit(1.0))).alias("idf"))


def vectorize_long(tf: DataFrame, vocab: DataFrame, term_col: str = "term", tf_col: str = "tf",
                   min_tf: float = 0.0, binary: bool = False, idf: DataFrame | None = None,
                   id_col: str = "doc_id") -> DataFrame:
    """Long form of the CountVectorizer(+IDF) output: (doc, term_id, weight).

    ``min_tf`` >= 1 is a count, < 1 a fraction of the document's tokens.
    The vocabulary side is bounded by ``vocab_size``; Spark chooses the join.
    """
    out = tf.join(vocab.select("term_id", term_col), term_col)
    if min_tf > 0:
        if min_tf >= 1.0:
            out = out.where(F.col(tf_col) >= min_tf)
        else:
            doc_len = tf.groupBy(id_col).agg(F.sum(tf_col).alias("_len"))
            out = out.join(doc_len, id_col).where(F.col(tf_col) >= F.col("_len") * min_tf).drop("_len")
    weight = F.lit(1.0) if binary else F.col(tf_col).cast("double")
    out = out.select(id_col, "term_id", term_col, weight.alias("weight"))
    if idf is not None:
        out = (out.join(idf.select("term_id", "idf"), "term_id")
               .withColumn("weight", F.col("weight") * F.col("idf")).drop("idf"))
    return out


def to_count_vectors(docs: DataFrame, tokens_col: str, vocab: DataFrame, output_col: str = S.VECTORIZED,
                     term_col: str = "term", min_tf: float = 0.0, binary: bool = False):
    """X5 boundary: a ``CountVectorizerModel`` built from our ordered
    vocabulary (collected, bounded by ``vocab_size``) and applied to ``docs``."""
    from pyspark.ml.feature import CountVectorizerModel
    terms = [r[0] for r in vocab.orderBy("term_id").select(term_col).collect()]
    model = CountVectorizerModel.from_vocabulary(terms, inputCol=tokens_col, outputCol=output_col,
                                                 minTF=min_tf, binary=binary)
    return model.transform(docs), model


def id_to_word(vocab: DataFrame, term_col: str = "term") -> DataFrame:
    """The (term_id, term) map as a table (join it, never ship a dict)."""
    return vocab.select("term_id", term_col)


def class_term_totals(tf: DataFrame, docs: DataFrame, id_col: str, class_col: str,
                      term_col: str = "term", tf_col: str = "tf") -> DataFrame:
    """(class, term, tf) summed over the documents of each class."""
    return (tf.join(docs.select(id_col, class_col), id_col)
            .groupBy(class_col, term_col).agg(F.sum(tf_col).alias(tf_col)))


def term_probabilities(class_tf: DataFrame, class_col: str, term_col: str = "term",
                       tf_col: str = "tf") -> DataFrame:
    """P(t | class) and P(t) next to the raw counts.

    Adds ``class_tokens`` (N_c), ``term_total`` (n_t), ``corpus_tokens`` (N).
    """
    class_tf = cut_lineage(class_tf)  # counted once for totals and both ranks
    class_tot = class_tf.groupBy(class_col).agg(F.sum(tf_col).alias("class_tokens"))
    corpus = class_tot.select(F.sum("class_tokens")).scalar()
    # a term has at most one row per class, so its window is small
    term_tot = F.sum(tf_col).over(Window.partitionBy(term_col))
    return (class_tf.withColumn("term_total", term_tot).join(class_tot, class_col)
            .withColumn("corpus_tokens", corpus)
            .withColumn("p_term_given_class", F.col(tf_col) / F.col("class_tokens"))
            .withColumn("p_term", F.col("term_total") / F.col("corpus_tokens")))


def _ranked(probs: DataFrame, class_col: str, term_col: str, score, order_key, k: int,
            bottom: bool) -> DataFrame:
    """Top (and bottom) k per class; one rank per branch, so each task keeps k rows per class before the shuffle."""
    keyed = probs.select(class_col, term_col, score.alias("score"), order_key.alias("_key"))

    def branch(name: str, order) -> DataFrame:
        w = Window.partitionBy(class_col).orderBy(order, F.col(term_col).asc())
        return (keyed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                .select(class_col, term_col, "score", "rank", F.lit(name).alias("direction")))

    top = branch("top", F.col("_key").desc())
    return top.unionByName(branch("bottom", F.col("_key").asc())) if bottom else top


def pmi_labels(class_tf: DataFrame, class_col: str, k: int = 10, term_col: str = "term",
               tf_col: str = "tf", bottom: bool = True) -> DataFrame:
    """M16 + W5: ``log2(P(t|c) / P(t))`` per observed term; top and bottom k per class.

    Ranking uses tf_ct / n_t, which orders terms exactly as the PMI does within
    a class and is an exactly rounded quotient, so ties are real ties, broken by term.
    The per-class window holds one class's observed terms (bounded by the vocabulary).
    """
    p = term_probabilities(class_tf, class_col, term_col, tf_col)
    score = F.log2(F.col("p_term_given_class") / F.col("p_term"))
    key = F.col(tf_col) / F.col("term_total")
    return _ranked(p, class_col, term_col, score, key, k, bottom)


def popescul_ungar_labels(class_tf: DataFrame, class_col: str, k: int = 10, term_col: str = "term",
                          tf_col: str = "tf", bottom: bool = False) -> DataFrame:
    """``P(t|c)^2 / P(t)``, top k per class (ordered by tf_ct^2 / n_t)."""
    p = term_probabilities(class_tf, class_col, term_col, tf_col)
    score = F.col("p_term_given_class") * F.col("p_term_given_class") / F.col("p_term")
    key = (F.col(tf_col) * F.col(tf_col)) / F.col("term_total")
    return _ranked(p, class_col, term_col, score, key, k, bottom)


def term_ids_to_words(df: DataFrame, ids_col: str, vocab: DataFrame, out_col: str, term_col: str = "term") -> DataFrame:
    """Term-id array -> blank-joined words, by a join with the (term_id, term) table; rows keep their order of ids."""
    keyed = df.withColumn("_row", F.monotonically_increasing_id())
    words = (keyed.select("_row", F.posexplode(ids_col).alias("_pos", "term_id")).join(vocab.select("term_id", term_col), "term_id")
             .groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_pos", term_col))).alias("_w"))
             .select("_row", F.array_join(F.transform("_w", lambda w: w[term_col]), " ").alias(out_col)))
    return keyed.join(words, "_row", "left").withColumn(out_col, F.coalesce(out_col, F.lit(""))).drop("_row")
