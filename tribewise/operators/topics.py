"""Topic models on the bag-of-words corpus.

LDA is ``pyspark.ml.clustering.LDA``; its inputs are the count vectors built
from our ordered vocabulary.  Topic terms are joined back to words through
the vocabulary table (no UDF).  u_mass coherence counts documents from the
distinct (doc, term) presence table restricted to the topics' top terms, and
only the term pairs a topic actually needs are joined.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tribewise.session import cut_lineage

EPSILON = 1e-12
# --- fixed values: LDA defaults of the reference ---------------------------
LDA_DEFAULTS = {"num_topics": 250, "max_iter": 50, "optimizer": "online", "subsampling_rate": 0.05}


def asymmetric_alpha(num_topics: int) -> list[float]:
    """Document concentration 1 / (i + sqrt(K)), i = 0..K-1."""
    off = math.sqrt(num_topics)
    return [1.0 / (i + off) for i in range(num_topics)]


def document_concentration(num_topics: int, alpha: float | None, asymmetric: bool, optimizer: str) -> list[float] | None:
    """Prior per topic: 1 / (i + sqrt(K)) or a constant, one common value, or None for Spark's own default."""
    if not asymmetric:
        return None if alpha is None else [alpha]
    if optimizer == "em":
        raise ValueError("an asymmetric prior needs the online optimizer")
    return asymmetric_alpha(num_topics) if alpha is None else [alpha] * num_topics


def fit_lda(corpus: DataFrame, features_col: str, num_topics: int = 250, max_iter: int = 50,
            optimizer: str = "online", subsampling_rate: float = 0.05, use_asymmetric_alpha: bool = True,
            alpha: float | None = None, seed: int | None = None):
    """Fitted ``LDAModel``."""
    from pyspark.ml.clustering import LDA
    kw = {"k": num_topics, "maxIter": max_iter, "optimizer": optimizer, "featuresCol": features_col}
    if optimizer == "online":
        kw["subsamplingRate"] = subsampling_rate
    if seed is not None:
        kw["seed"] = seed
    prior = document_concentration(num_topics, alpha, use_asymmetric_alpha, optimizer)
    if prior is not None:
        kw["docConcentration"] = prior
    return LDA(**kw).fit(corpus)


def topic_assignments(model, corpus: DataFrame, id_col: str) -> DataFrame:
    """Long (doc, topic, probability) with probability > 0."""
    from pyspark.ml.functions import vector_to_array
    dist = model.transform(corpus).select(id_col, vector_to_array(model.getTopicDistributionCol()).alias("_p"))
    return (dist.select(id_col, F.posexplode("_p").alias("topic", "probability"))
            .where(F.col("probability") > 0))


def top_terms(model, vocab: DataFrame, num_terms: int = 20, term_col: str = "term") -> DataFrame:
    """(topic, rank, term_id, term, weight) from ``describeTopics``."""
    topics = model.describeTopics(maxTermsPerTopic=num_terms)
    long = topics.select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("pos", "tw"))
    long = long.select("topic", (F.col("pos") + 1).alias("rank"), F.col("tw.termIndices").alias("term_id"),
                       F.col("tw.termWeights").alias("weight"))
    return long.join(vocab.select("term_id", term_col), "term_id")


def top_terms_table(terms: DataFrame, output_col: str = "top_terms", term_col: str = "term") -> DataFrame:
    """C13 table form: (topic, blank-joined top terms in rank order)."""
    return terms.groupBy("topic").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", term_col))), lambda s: s[term_col]), " ").alias(output_col))


def term_topics(model, vocab: DataFrame, word: str, term_col: str = "term") -> DataFrame:
    """C14: topics of a word by decreasing probability (empty for an unknown word)."""
    terms = top_terms(model, vocab, vocab.count(), term_col)
    return terms.where(F.col(term_col) == word).select("topic", "weight").orderBy(F.col("weight").desc(), "topic")


def u_mass(terms: DataFrame, presence: DataFrame, id_col: str = "doc_id", term_col: str = "term") -> DataFrame:
    """M6: u_mass coherence per topic and the model mean.

    ``terms`` is (topic, rank, term); ``presence`` is (doc, term) for every
    term occurring in a document.  For each topic and each ordered pair
    (w', w*) with rank(w*) < rank(w'): ln((D(w', w*) / N + eps) / (D(w*) / N));
    a topic's coherence is the mean over its pairs.  Returns
    (topic, coherence) rows plus the mean in column ``model_coherence``.
    """
    n_docs = presence.select(F.count_distinct(id_col)).scalar()
    needed = terms.select(term_col).distinct()
    # only the needed terms' rows are shuffled
    pres = cut_lineage(presence.select(id_col, term_col).join(F.broadcast(needed), term_col, "leftsemi").distinct())
    df = pres.groupBy(term_col).agg(F.count(F.lit(1)).alias("d"))
    t1 = terms.select("topic", F.col("rank").alias("r1"), F.col(term_col).alias("w_prime"))
    t2 = terms.select("topic", F.col("rank").alias("r2"), F.col(term_col).alias("w_star"))
    pairs = t1.join(t2, "topic").where(F.col("r2") < F.col("r1")).select("topic", "w_prime", "w_star")
    needed_pairs = pairs.select("w_prime", "w_star").distinct()
    # documents containing w*, then those also containing w'
    a = pres.select(id_col, F.col(term_col).alias("w_star")).join(needed_pairs, "w_star")
    b = pres.select(id_col, F.col(term_col).alias("w_prime"))
    co = a.join(b, [id_col, "w_prime"]).groupBy("w_prime", "w_star").agg(F.count(F.lit(1)).alias("co"))
    scored = (pairs.join(co, ["w_prime", "w_star"], "left")
              .join(df.select(F.col(term_col).alias("w_star"), "d"), "w_star", "left")
              .select("topic", F.when(F.col("d") > 0, F.log(
                  (F.coalesce("co", F.lit(0)) / n_docs + EPSILON) / (F.col("d") / n_docs))).otherwise(F.lit(0.0)).alias("m")))
    per_topic = scored.groupBy("topic").agg(F.avg("m").alias("coherence"))
    mean = per_topic.select(F.avg("coherence")).scalar()
    return per_topic.withColumn("model_coherence", mean)


def u_mass_of_documents(terms: DataFrame, docs: DataFrame, tokens_col: str, term_col: str = "term", step: int = 2048) -> DataFrame:
    """M6 straight from token rows: (topic, coherence, model_coherence), equal to ``u_mass`` on their presence table.

    The tasks hold the top terms (topics x terms rows, a bound of the model) and read ``step`` documents at a time: each term gets a
    bitmap of the documents that hold it, and a pair's documents are the bits of the AND.  A task returns one row per pair; no
    (document, term) row is shuffled.  N counts documents with a token.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    listed = terms.select("topic", "rank", term_col).orderBy("topic", "rank").collect()
    names = sorted({r[term_col] for r in listed})
    at = {t: i for i, t in enumerate(names)}
    by_topic: dict = {}
    for r in listed:
        by_topic.setdefault(r["topic"], []).append(at[r[term_col]])
    pairs = sorted({(a, b) for ids in by_topic.values() for i, a in enumerate(ids) for b in ids[:i]})
    left, right = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))

    def count(batches):
        single, both, n = np.zeros(len(names), np.int64), np.zeros(len(pairs), np.int64), 0
        known = pa.array(names, pa.string())
        for batch in batches:
            for s in range(0, batch.num_rows, step):
                lists = batch.column("tokens").slice(s, step)
                found = pc.index_in(pc.list_flatten(lists), value_set=known)
                row = pc.list_parent_indices(lists)
                held = np.zeros((len(names), -(-len(lists) // 64) * 64), bool)
                mask = found.is_valid()
                held[found.filter(mask).to_numpy(zero_copy_only=False), row.filter(mask).to_numpy(zero_copy_only=False)] = True
                bits = np.packbits(held, axis=1).view(np.uint64)
                single += np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
                for a in range(0, len(pairs), 4096):
                    both[a:a + 4096] += np.bitwise_count(bits[left[a:a + 4096]] & bits[right[a:a + 4096]]).sum(axis=1, dtype=np.int64)
                n += int(pc.sum(pc.greater(pc.fill_null(pc.list_value_length(lists), 0), 0).cast(pa.int64())).as_py() or 0)
        ids = np.concatenate((np.arange(len(pairs)), [-1], -2 - np.arange(len(names))))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate((both, [n], single)))], ["id", "n"])

    found = {r["id"]: r["n"] for r in docs.select(F.col(tokens_col).alias("tokens")).mapInArrow(count, "id long, n long")
             .groupBy("id").agg(F.sum("n").alias("n")).collect()}  # one row per term and pair
    n_docs, number = found.get(-1, 0), {p: i for i, p in enumerate(pairs)}
    rows = []
    for topic, ids in by_topic.items():
        values = []
        for i, a in enumerate(ids):
            for b in ids[:i]:
                d = found.get(-2 - b, 0)
                values.append(math.log((found[number[a, b]] / n_docs + EPSILON) / (d / n_docs)) if d else 0.0)
        if values:
            rows.append((topic, sum(values) / len(values)))
    mean = sum(v for _, v in rows) / len(rows) if rows else None
    kind = terms.schema["topic"].dataType.simpleString()
    return terms.sparkSession.createDataFrame([(t, v, mean) for t, v in rows], f"topic {kind}, coherence double, model_coherence double")
