"""Submission/comment pairs and thread documents.

Scale notes
-----------
* The pair join is an equi-join on the submission fullname.  Submissions are
  unique per id, so a hot thread (one id holding a third of all comments) is
  a skewed partition on the comment side only; AQE's skew-join split handles
  it (``spark.sql.adaptive.skewJoin.enabled``) by splitting that partition
  and replicating the single submission row.
* Documents put a whole thread into one string, which is what the document
  table is.  Downstream term counting does not need that string:
  ``thread_term_counts`` tokenizes each comment where it lies and sums
  (thread, term) counts, which gives the same counts because tokens never
  span the blank that joins the parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tribewise import schemas as S
from tribewise.operators.filters import filter_by_time_delta, rename_columns


def join_submissions_and_comments(submissions: DataFrame, comments: DataFrame,
                                  submission_id_col: str = S.FULLNAME_ID, comments_link_col: str = "link_id",
                                  comments_prefix: str = S.COMMENTS, timestamp_col: str = "created_utc",
                                  time_delta_col: str = S.TIME_DELTA) -> DataFrame:
    """Inner join of comments to their submission plus the time delta.

    Overlapping comment columns get ``<prefix>_``; the delta is computed when
    both timestamps exist (``comments_ts - submission_ts``, bigint seconds).
    """
    renamed = rename_columns(comments, prefix=comments_prefix)
    out = submissions.join(renamed, submissions[submission_id_col] == renamed[comments_link_col])
    comments_ts = f"{comments_prefix}_{timestamp_col}"
    if timestamp_col in out.columns and comments_ts in out.columns:
        out = out.withColumn(time_delta_col, F.col(comments_ts) - F.col(timestamp_col))
    return out


def documents_from_pairs(pairs: DataFrame, submission_id_col: str = "id", submission_text_col: str = "selftext",
                         submission_title_col: str = "title", comments_text_col: str = "body",
                         comments_id_col: str = "comments_id", category_col: str = S.COMMUNITY,
                         time_delta_col: str = S.TIME_DELTA, max_time_delta: int | None = None,
                         min_time_delta: int | None = None, doc_col: str = S.DOC_TEXT) -> DataFrame:
    """One document per thread: ``title selftext comment1 comment2 ...``.

    Comments are concatenated in (delta, comment id) order inside the
    aggregate, so the order survives the shuffle.  Null parts are skipped and
    empty strings kept (``concat_ws`` semantics).
    """
    f = filter_by_time_delta(pairs, max_time_delta, min_time_delta, time_delta_col)
    order_key = F.struct(F.col(time_delta_col), F.col(comments_id_col))
    grouped = f.groupBy(submission_id_col).agg(
        F.min_by(category_col, order_key).alias(category_col),
        F.min_by(submission_text_col, order_key).alias(submission_text_col),
        F.min_by(submission_title_col, order_key).alias(submission_title_col),
        F.sort_array(F.collect_list(F.struct(F.col(time_delta_col).alias("d"),
                                             F.col(comments_id_col).alias("i"),
                                             F.col(comments_text_col).alias("t")))).alias("_c"))
    comments_text = F.array_join(F.transform("_c", lambda x: x["t"]), " ")
    return grouped.select(submission_id_col, category_col,
                          F.concat_ws(" ", F.col(submission_title_col), F.col(submission_text_col),
                                      comments_text).alias(doc_col))


def thread_term_counts(pairs: DataFrame, tokenize, submission_id_col: str = "id",
                       submission_text_col: str = "selftext", submission_title_col: str = "title",
                       comments_text_col: str = "body", time_delta_col: str = S.TIME_DELTA,
                       max_time_delta: int | None = None, min_time_delta: int | None = None) -> DataFrame:
    """(thread, term, tf) without building the thread string.

    ``tokenize`` maps a string column to an array-of-tokens column.  The
    submission text is counted once per thread (from its own row set), each
    comment where it lies; the sums are map-side combined.
    """
    f = filter_by_time_delta(pairs, max_time_delta, min_time_delta, time_delta_col)
    heads = (f.select(submission_id_col, submission_title_col, submission_text_col)
             .dropDuplicates([submission_id_col]))
    head_tokens = heads.select(submission_id_col, F.concat(
        F.coalesce(tokenize(F.col(submission_title_col)), F.array().cast("array<string>")),
        F.coalesce(tokenize(F.col(submission_text_col)), F.array().cast("array<string>"))).alias("_t"))
    body_tokens = f.select(submission_id_col, tokenize(F.col(comments_text_col)).alias("_t"))
    return (head_tokens.unionByName(body_tokens)
            .select(submission_id_col, F.explode("_t").alias("term"))
            .groupBy(submission_id_col, "term").agg(F.count(F.lit(1)).alias("tf")))
