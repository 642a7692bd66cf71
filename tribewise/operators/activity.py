"""Community counts, coverage, user exclusion and user contexts.

Scale notes
-----------
* Counting is a partial/final hash aggregate: a community or user that holds
  a third of all rows is combined map-side before the shuffle.
* The top-n table is small; Spark broadcasts it if its measured size allows.
* ``percent_rank`` over the whole table would move every user to one task.
  ``exclude_top_percentage`` computes the same filter from the histogram of
  counts (one row per distinct count value, at most ~sqrt(2 * rows) rows) and
  turns it into a scalar threshold, evaluated as a lazy scalar subquery.
* User contexts pre-aggregate (user, community) pairs first, so a hot user
  is split over many tasks and the per-user collect holds at most one entry
  per distinct community (bounded by the top-n vocabulary), never one entry
  per comment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tribewise import schemas as S


def get_top_n_counts(df: DataFrame, col: str = S.COMMUNITY, n: int = S.DEFAULT_TOP_N,
                     count_col: str = S.COUNT) -> DataFrame:
    """A1: count per value, ordered by count desc then value asc, first ``n``.

    Sort + limit is planned as a distributed top-k (TakeOrderedAndProject).
    """
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias(count_col))
            .orderBy(F.col(count_col).desc(), F.col(col).asc())
            .limit(n))


def filter_top_n(df: DataFrame, top_n: DataFrame, col: str = S.COMMUNITY) -> DataFrame:
    """Left semi join to the top-n table; Spark broadcasts it if its measured size allows."""
    return df.join(top_n.select(col), col, "leftsemi")


def coverage_stats(original: DataFrame, filtered: DataFrame, community_col: str = S.COMMUNITY,
                   author_col: str = S.AUTHOR, approximate: bool = False) -> DataFrame:
    """A2: one row with distinct communities, rows and distinct users before and
    after filtering, plus the two coverage ratios.

    One aggregate per input (the reference runs six separate jobs).
    """
    distinct = (lambda c: F.approx_count_distinct(c)) if approximate else (lambda c: F.count_distinct(c))

    def stats(df: DataFrame, tag: str) -> DataFrame:
        return df.agg(distinct(community_col).alias(f"communities_{tag}"),
                      F.count(F.lit(1)).alias(f"rows_{tag}"),
                      distinct(author_col).alias(f"users_{tag}")).withColumn("_one", F.lit(1))

    both = stats(original, "before").join(stats(filtered, "after"), "_one").drop("_one")
    return both.select(
        "communities_before", "communities_after", "rows_before", "rows_after",
        F.try_divide(F.col("rows_after"), F.col("rows_before").cast("double")).alias("row_coverage"),
        "users_before", "users_after",
        F.try_divide(F.col("users_after"), F.col("users_before").cast("double")).alias("user_coverage"))


def percent_rank_threshold(df: DataFrame, count_col: str, exclude_top_perc: float):
    """Largest value of ``count_col`` whose percent rank is <= 1 - perc, as a
    lazy scalar subquery column.

    percent_rank(v) = (#rows with a smaller value) / (rows - 1), 0 for one row.
    It is monotone in v, so the kept rows are exactly ``count_col <= threshold``.
    """
    limit = 1.0 - exclude_top_perc
    hist = df.groupBy(count_col).agg(F.count(F.lit(1)).alias("_n"))
    # the histogram has one row per distinct count value: a small, bounded window
    w_before = Window.orderBy(count_col).rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.select(count_col,
                       F.coalesce(F.sum("_n").over(w_before), F.lit(0)).alias("_below"),
                       F.sum("_n").over(Window.partitionBy()).alias("_total"))
    rank = F.when(F.col("_total") <= 1, F.lit(0.0)).otherwise(
        F.col("_below") / (F.col("_total") - 1).cast("double"))
    return hist.where(rank <= F.lit(limit)).select(F.max(count_col)).scalar()


def exclude_top_percentage(df: DataFrame, count_col: str = S.CONTEXT_LENGTH,
                           exclude_top_perc: float = S.DEFAULT_USER_EXCLUDE) -> DataFrame:
    """Rows with ``percent_rank() over (order by count_col) <= 1 - perc``.

    0 is a no-op.  Ties share a rank, so tied rows are kept or dropped together.
    No ``percentile`` column is left behind.
    """
    if exclude_top_perc == 0.0:
        return df
    return df.where(F.col(count_col) <= percent_rank_threshold(df, count_col, exclude_top_perc))


def user_activity_counts(df: DataFrame, author_col: str = S.AUTHOR, count_col: str = S.COUNT) -> DataFrame:
    return df.groupBy(author_col).agg(F.count(F.lit(1)).alias(count_col))


def filter_out_top_users(df: DataFrame, author_col: str = S.AUTHOR,
                         exclude_top_perc: float = S.DEFAULT_USER_EXCLUDE) -> DataFrame:
    """Drop every row of the top ``perc`` most active users.

    Counts per user (map-side combined), histogram threshold, then a semi join
    back by name; AQE splits a skewed user partition of the semi join.
    """
    if exclude_top_perc == 0.0:
        return df
    counts = user_activity_counts(df, author_col, "_user_rows")
    keep = exclude_top_percentage(counts, "_user_rows", exclude_top_perc).select(author_col)
    return df.join(keep, author_col, "leftsemi")


def context_runs(df: DataFrame, context_col: str = S.AUTHOR, word_col: str = S.COMMUNITY,
                 runs_col: str = "runs", context_len_col: str = S.CONTEXT_LENGTH, min_sentence_length: int = 2,
                 exclude_top_perc: float = S.DEFAULT_USER_EXCLUDE) -> DataFrame:
    """A3 as counted runs: (user, runs array<struct<w, k>>, length), minus the top users and short contexts.

    A run is a community and the user's rows there, in community order: a user with a
    million comments in three communities has three runs.  E1 takes the runs as they are (``explode_runs``);
    ``context_words`` spells them out where a file wants text.
    """
    pairs = (df.where(F.col(context_col).isNotNull())
             .groupBy(context_col, word_col).agg(F.count(F.lit(1)).alias("_k")))
    per_user = pairs.groupBy(context_col).agg(
        F.sort_array(F.collect_list(F.when(F.col(word_col).isNotNull(), F.struct(
            F.col(word_col).cast("string").alias("w"), F.col("_k").alias("k"))))).alias(runs_col),
        F.sum("_k").alias(context_len_col))
    per_user = exclude_top_percentage(per_user, context_len_col, exclude_top_perc)
    return per_user.where(F.col(context_len_col) >= min_sentence_length)


def explode_runs(runs: DataFrame, context_col: str = S.AUTHOR, runs_col: str = "runs", word_col: str = S.COMMUNITY,
                 n_col: str = "n") -> DataFrame:
    """(user, community, n): one row per run."""
    return runs.select(context_col, F.explode(runs_col).alias("_r")).select(
        context_col, F.col("_r.w").alias(word_col), F.col("_r.k").alias(n_col))


def context_words(runs_col: str = "runs"):
    """The words of counted runs, each as often as its count."""
    return F.flatten(F.transform(runs_col, lambda x: F.array_repeat(x["w"], x["k"].cast("int"))))


def aggregate_for_vectorization(df: DataFrame, context_col: str = S.AUTHOR, word_col: str = S.COMMUNITY,
                                word_out_col: str = S.CONTEXT_OUT, context_len_col: str = S.CONTEXT_LENGTH,
                                min_sentence_length: int = 2,
                                exclude_top_perc: float = S.DEFAULT_USER_EXCLUDE,
                                keep_context_col: bool = False, as_array: bool = False) -> DataFrame:
    """A3: one context per user: the user's communities (one entry per row,
    sorted, blank-joined), its length, minus the top users and short contexts.

    The user id is dropped unless ``keep_context_col``.  Words are sorted so
    the result does not depend on shuffle order; null words are skipped like ``concat_ws``
    skips nulls.  The words are spelled out in the last projection, from ``context_runs``.
    """
    runs = context_runs(df, context_col, word_col, "_runs", context_len_col, min_sentence_length, exclude_top_perc)
    words = context_words("_runs")
    out = runs.withColumn(word_out_col, words if as_array else F.array_join(words, " "))
    cols = ([context_col] if keep_context_col else []) + [word_out_col, context_len_col]
    return out.select(*cols)


def collect_max_context_length(df: DataFrame, length_col: str = S.CONTEXT_LENGTH) -> DataFrame:
    """A5: one-row DataFrame with the longest context."""
    return df.agg(F.max(length_col).alias("max_context_length"))


def context_size_stats(contexts: DataFrame, text_col: str = S.CONTEXT_OUT) -> DataFrame:
    """Number of contexts and max tokens per context in one pass."""
    return contexts.agg(F.count(F.lit(1)).alias("num_contexts"),
                        F.max(F.size(F.split(F.col(text_col), " "))).alias("max_context_tokens"))


def get_start_end_timeframes(df: DataFrame, col: str = "created_utc") -> DataFrame:
    """min/max epoch seconds and their readable UTC forms (X11)."""
    return df.agg(F.min(col).alias("start_epoch"), F.max(col).alias("end_epoch")).select(
        "start_epoch", "end_epoch",
        F.from_unixtime("start_epoch").alias("start_time"),
        F.from_unixtime("end_epoch").alias("end_time"))


def document_length_statistics(df: DataFrame, tokens_col: str = S.TOKENS,
                               length_col: str = "document_length") -> tuple[DataFrame, DataFrame]:
    """Adds the token count and returns (df_with_length, one-row describe).

    The describe row holds count, mean, stddev (sample), min, max and the number
    of documents without tokens; a sample of those is ``where(len == 0).limit(5)``.
    """
    with_len = df.withColumn(length_col, F.size(F.col(tokens_col)).cast("bigint"))
    stats = with_len.agg(
        F.count(F.lit(1)).alias("num_documents"),
        F.avg(length_col).alias("mean_length"),
        F.stddev_samp(length_col).alias("stddev_length"),
        F.min(length_col).alias("min_length"),
        F.max(length_col).alias("max_length"),
        F.count(F.when(F.col(length_col) == 0, 1)).alias("empty_documents"))
    return with_len, stats
