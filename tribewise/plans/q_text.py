"""Driver-table queries for threads, documents and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tribewise.functions.text import TOKEN_PATTERN, default_stop_words, remove_stop_words_df, sql_string_list, tokenize
from tribewise.operators import activity as A
from tribewise.operators import filters as FL
from tribewise.operators import text as T
from tribewise.operators import threads as TH
from tribewise.plans import roles
from tribewise.plans.registry import query, r6, table
from tribewise.session import cut_lineage

MAX_DELTA = 180 * 86400
MIN_DELTA = 86400
MIN_DF = 2.0
MAX_DF = 0.95
VOCAB_SIZE = 1 << 18
LABEL_K = 10

_PAIRS_SQL = f"""
WITH s AS (SELECT 't3_' || id AS fullname_id, * FROM ({roles.SUBMISSIONS_SQL})),
c AS ({roles.COMMENTS_SQL}),
p AS (SELECT s.id, s.author, s.created_utc, c.id AS comments_id, c.author AS comments_author,
             c.created_utc AS comments_created_utc, c.created_utc - s.created_utc AS time_to_comment_in_seconds
      FROM s JOIN c ON s.fullname_id = c.link_id)"""


def pairs_df(spark, d):
    subs = FL.prefix_id_column(roles.submissions(spark, d), "submissions")
    return TH.join_submissions_and_comments(subs, roles.comments(spark, d))


_PAIR_COLS = ["id", "author", "created_utc", "comments_id", "comments_author", "comments_created_utc",
              "time_to_comment_in_seconds"]


@query("thread_pairs", _PAIRS_SQL + "\nSELECT * FROM p")
def thread_pairs(spark, d):
    return pairs_df(spark, d).select(*_PAIR_COLS)


@query("thread_pairs_in_window", _PAIRS_SQL + f"""
SELECT * FROM p WHERE time_to_comment_in_seconds < {MAX_DELTA} AND time_to_comment_in_seconds > {MIN_DELTA}""")
def thread_pairs_in_window(spark, d):
    return FL.filter_by_time_delta(pairs_df(spark, d), MAX_DELTA, MIN_DELTA).select(*_PAIR_COLS)


def conversation_pairs(spark, d):
    """Thread pairs from ``conversations``: turn 0 opens the thread, later turns reply."""
    conv = table(spark, d, "conversations")
    head = conv.where(F.col("turn") == 0).select(
        F.col("conv_id").alias("id"), F.col("role").alias("title"), F.col("text").alias("selftext"),
        F.col("role").alias("subreddit"))
    replies = conv.where(F.col("turn") > 0).select(
        F.col("conv_id").alias("link"), F.col("turn").alias("comments_id"), F.col("text").alias("body"),
        F.col("turn").alias("time_to_comment_in_seconds"))
    return head.join(replies, head.id == replies.link).drop("link")


_CONV_PAIRS_SQL = """
WITH s AS (SELECT conv_id AS id, role AS title, text AS selftext, role AS subreddit FROM conversations WHERE turn = 0),
r AS (SELECT conv_id AS link, turn AS comments_id, text AS body, turn AS delta FROM conversations WHERE turn > 0),
p AS (SELECT * FROM s JOIN r ON s.id = r.link)"""


@query("thread_documents", _CONV_PAIRS_SQL + """
SELECT id, subreddit, concat_ws(' ', title, selftext, string_agg(body, ' ' ORDER BY delta, comments_id)) AS document_text
FROM p GROUP BY id, subreddit, title, selftext""")
def thread_documents(spark, d):
    return TH.documents_from_pairs(conversation_pairs(spark, d))


@query("thread_documents_in_window", _CONV_PAIRS_SQL + """
SELECT id, subreddit, concat_ws(' ', title, selftext, string_agg(body, ' ' ORDER BY delta, comments_id)) AS document_text
FROM p WHERE delta > 1 AND delta < 6 GROUP BY id, subreddit, title, selftext""")
def thread_documents_in_window(spark, d):
    return TH.documents_from_pairs(conversation_pairs(spark, d), max_time_delta=6, min_time_delta=1)


@query("thread_term_counts", _CONV_PAIRS_SQL + f""",
docs AS (SELECT id, concat_ws(' ', title, selftext, string_agg(body, ' ' ORDER BY delta, comments_id)) AS t
         FROM p GROUP BY id, title, selftext),
tok AS (SELECT id, unnest(regexp_extract_all(lower(t), '{TOKEN_PATTERN}', 0)) AS term FROM docs)
SELECT id, term, count(*) AS tf FROM tok GROUP BY id, term""")
def thread_term_counts(spark, d):
    return TH.thread_term_counts(conversation_pairs(spark, d), tokenize)


_TOK_SQL = f"""
WITH t AS (SELECT doc_id, source, regexp_extract_all(lower(text), '{TOKEN_PATTERN}', 0) AS tokens FROM documents)"""
_STOP = sql_string_list(default_stop_words("english"))
_FILT_SQL = _TOK_SQL + f""",
ft AS (SELECT doc_id, source, list_filter(tokens, lambda x: NOT list_contains({_STOP}, x)) AS tokens FROM t),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM ft) GROUP BY doc_id, term)"""
_VOCAB_SQL = _FILT_SQL + f""",
st AS (SELECT term, count(*) AS doc_freq, CAST(sum(tf) AS BIGINT) AS total_count FROM tf GROUP BY term),
nd AS (SELECT count(*) AS n FROM documents),
v AS (SELECT CAST(row_number() OVER (ORDER BY total_count DESC, term ASC) - 1 AS INTEGER) AS term_id,
             term, doc_freq, total_count
      FROM st, nd WHERE doc_freq >= {MIN_DF} AND doc_freq <= {MAX_DF} * n
      ORDER BY total_count DESC, term ASC LIMIT {VOCAB_SIZE})"""


def docs_tokens(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "source", "lang", tokenize("text").alias("tokens"))


def docs_filtered(spark, d):
    return remove_stop_words_df(docs_tokens(spark, d), "tokens")


def docs_tf(spark, d):
    return T.term_frequencies(docs_filtered(spark, d), "doc_id", "tokens")


def vocab_df(spark, d):
    return T.vocabulary_of_tokens(docs_filtered(spark, d), "tokens", min_df=MIN_DF, max_df=MAX_DF, vocab_size=VOCAB_SIZE)


@query("tokens", _TOK_SQL + """
SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens, array_to_string(tokens, ' ') AS tokens_text FROM t""")
def tokens(spark, d):
    t = docs_tokens(spark, d)
    return t.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"),
                    F.array_join("tokens", " ").alias("tokens_text"))


@query("doc_length_stats", _TOK_SQL + """
SELECT count(*) AS num_documents, round(avg(n), 6) + 0.0 AS mean_length, round(stddev_samp(n), 6) + 0.0 AS stddev_length,
       min(n) AS min_length, max(n) AS max_length, count(*) FILTER (WHERE n = 0) AS empty_documents
FROM (SELECT CAST(len(tokens) AS BIGINT) AS n FROM t)""")
def doc_length_stats(spark, d):
    _, stats = A.document_length_statistics(docs_tokens(spark, d), "tokens")
    return stats.withColumn("mean_length", r6("mean_length")).withColumn("stddev_length", r6("stddev_length"))


@query("stopword_filter", _FILT_SQL + """
SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens, array_to_string(tokens, ' ') AS tokens_text FROM ft""")
def stopword_filter(spark, d):
    t = docs_filtered(spark, d)
    return t.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"),
                    F.array_join("tokens", " ").alias("tokens_text"))


@query("term_frequency", _FILT_SQL + "\nSELECT doc_id, term, tf FROM tf")
def term_frequency(spark, d):
    return docs_tf(spark, d)


@query("vocabulary", _VOCAB_SQL + "\nSELECT term_id, term, doc_freq, total_count FROM v")
def vocabulary(spark, d):
    return vocab_df(spark, d)


@query("idf_weights", _VOCAB_SQL + """
SELECT term_id, term, round(ln((n + 1.0) / (doc_freq + 1.0)), 6) + 0.0 AS idf FROM v, nd""")
def idf_weights(spark, d):
    docs = table(spark, d, "documents")
    return T.idf_weights(vocab_df(spark, d), docs).withColumn("idf", r6("idf"))


@query("tfidf_vectors", _VOCAB_SQL + """
SELECT tf.doc_id, v.term_id, round(tf.tf * ln((n + 1.0) / (v.doc_freq + 1.0)), 6) + 0.0 AS weight
FROM tf JOIN v ON tf.term = v.term, nd""")
def tfidf_vectors(spark, d):
    docs = table(spark, d, "documents")
    tokens = cut_lineage(docs_filtered(spark, d).select("doc_id", "tokens"))
    vocab = cut_lineage(T.vocabulary_of_tokens(tokens, "tokens", min_df=MIN_DF, max_df=MAX_DF, vocab_size=VOCAB_SIZE))
    out = T.vectorize_long(T.term_frequencies(tokens, "doc_id", "tokens"), vocab, idf=T.idf_weights(vocab, docs))
    return out.select("doc_id", "term_id", r6("weight").alias("weight"))


def class_tf_df(spark, d):
    return T.class_term_counts(docs_filtered(spark, d), "source", "tokens")


_CLASS_SQL = _FILT_SQL + """,
ct AS (SELECT d.source, tf.term, CAST(sum(tf.tf) AS BIGINT) AS tf FROM tf JOIN documents d USING (doc_id) GROUP BY d.source, tf.term),
tt AS (SELECT term, sum(tf) AS term_total FROM ct GROUP BY term),
cl AS (SELECT source, sum(tf) AS class_tokens FROM ct GROUP BY source),
tot AS (SELECT sum(tf) AS corpus_tokens FROM ct),
pr AS (SELECT ct.source, ct.term, ct.tf, term_total, class_tokens, corpus_tokens,
              ct.tf / CAST(class_tokens AS DOUBLE) AS pc, term_total / CAST(corpus_tokens AS DOUBLE) AS pt
       FROM ct JOIN tt USING (term) JOIN cl USING (source), tot)"""


@query("class_term_totals", _CLASS_SQL + "\nSELECT source, term, tf FROM ct")
def class_term_totals(spark, d):
    return class_tf_df(spark, d)


@query("pmi_labels", _CLASS_SQL + f""",
sc AS (SELECT source, term, log2(pc / pt) AS score, tf / CAST(term_total AS DOUBLE) AS k FROM pr)
SELECT source, term, round(score, 6) + 0.0 AS score, rank, direction FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY k DESC, term ASC) AS rank, 'top' AS direction FROM sc
  UNION ALL
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY k ASC, term ASC) AS rank, 'bottom' AS direction FROM sc)
WHERE rank <= {LABEL_K}""")
def pmi_labels(spark, d):
    out = T.pmi_labels(class_tf_df(spark, d), "source", LABEL_K)
    return out.withColumn("score", r6("score")).withColumn("rank", F.col("rank").cast("bigint"))


@query("popescul_ungar_labels", _CLASS_SQL + f""",
sc AS (SELECT source, term, pc * pc / pt AS score, (tf * tf) / CAST(term_total AS DOUBLE) AS k FROM pr)
SELECT source, term, round(score, 6) + 0.0 AS score, rank, 'top' AS direction FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY k DESC, term ASC) AS rank FROM sc)
WHERE rank <= {LABEL_K}""")
def popescul_ungar_labels(spark, d):
    out = T.popescul_ungar_labels(class_tf_df(spark, d), "source", LABEL_K)
    return out.withColumn("score", r6("score")).withColumn("rank", F.col("rank").cast("bigint"))
