"""Row filters and column helpers.

All predicates are plain Catalyst expressions so they are pushed into the
Parquet scan where the column allows it and stay inside whole-stage codegen.
Comparisons are three-valued: rows whose tested column is null are dropped,
exactly like ``col != lit`` / ``~isin`` / ``~rlike`` do in Spark SQL.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tribewise import schemas as S


def filter_by_regex(df: DataFrame, col: str = S.COMMUNITY, pattern: str = S.USER_PROFILE_PATTERN,
                    match_complement: bool = True) -> DataFrame:
    """keep rows that do not match (default) or match a Java regex."""
    cond = F.col(col).rlike(pattern)
    return df.where(~cond if match_complement else cond)


def remove_deleted_authors(df: DataFrame, author_col: str = S.AUTHOR) -> DataFrame:
    """``author != '[deleted]'`` (null authors are dropped too)."""
    return df.where(F.col(author_col) != F.lit(S.DELETED))


def remove_deleted_text(df: DataFrame, record_type: str = S.COMMENTS,
                        text_col: str | None = None) -> DataFrame:
    """text not in ('[removed]', '[deleted]'); the column follows the record type."""
    col = text_col or S.TEXT_COLUMN[record_type]
    return df.where(~F.col(col).isin(*S.DELETED_TEXT_SENTINELS))


def filter_by_time_delta(df: DataFrame, max_delta: int | None = None, min_delta: int | None = None,
                         delta_col: str = S.TIME_DELTA) -> DataFrame:
    """strict ``min < delta < max``; each bound is applied when it is not None.

    A bound of 0 is a real bound here (``is not None``), unlike a truthiness test.
    """
    out = df
    if max_delta is not None:
        out = out.where(F.col(delta_col) < F.lit(max_delta))
    if min_delta is not None:
        out = out.where(F.col(delta_col) > F.lit(min_delta))
    return out


def prefix_id_column(df: DataFrame, record_type: str = S.SUBMISSIONS, id_col: str = "id",
                     output_col: str = S.FULLNAME_ID) -> DataFrame:
    """``t3_``/``t1_`` + id (``concat_ws`` so a null id gives the bare prefix)."""
    return df.withColumn(output_col, F.concat_ws("", F.lit(S.FULLNAME_PREFIX[record_type]),
                                                 F.col(id_col).cast("string")))


OVERLAPPING_COLS = ("id", "author", "subreddit", "created_utc", "score")


def rename_columns(df: DataFrame, columns: Iterable[str] | None = None,
                   prefix: str = S.COMMENTS) -> DataFrame:
    """prefix the given (overlapping) columns that exist in ``df``."""
    cols = OVERLAPPING_COLS if columns is None else tuple(columns)
    mapping = {c: f"{prefix}_{c}" for c in cols if c in df.columns}
    return df.withColumnsRenamed(mapping) if mapping else df


def assign_other_category(df: DataFrame, in_col: str, out_col: str, keep: Iterable,
                          other_value: str = "other") -> DataFrame:
    """values outside ``keep`` become ``other_value``; an empty ``keep`` copies."""
    keep = list(keep)
    if not keep:
        return df.withColumn(out_col, F.col(in_col).cast("string"))
    return df.withColumn(out_col, F.when(F.col(in_col).isin(keep), F.col(in_col).cast("string"))
                         .otherwise(F.lit(other_value)))


def filter_by_selection(df: DataFrame, col: str, selection: DataFrame | Iterable,
                        selection_col: str | None = None) -> DataFrame:
    """F8: keep rows whose ``col`` is in a selection (a short list or a key DataFrame)."""
    if isinstance(selection, DataFrame):
        sel = selection.select(F.col(selection_col or col).alias(col)).distinct()
        return df.join(sel, col, "leftsemi")
    return df.where(F.col(col).isin(list(selection)))


def drop_columns_like(df: DataFrame, prefix: str) -> DataFrame:
    """drop every column whose name starts with ``prefix``."""
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def assignments_for_keys(keys: DataFrame, assignments: DataFrame, key_col: str = "key",
                         cluster_col: str = "cluster", missing: int = S.MISSING_CLUSTER) -> DataFrame:
    """label for each requested key, ``missing`` when the key is not assigned."""
    return (keys.select(key_col).join(assignments.select(key_col, cluster_col), key_col, "left")
            .select(key_col, F.coalesce(F.col(cluster_col), F.lit(missing)).alias(cluster_col)))


def sample_documents(df: DataFrame, n: int) -> DataFrame:
    """first ``n`` rows (a sampling operator: the limit is the feature)."""
    return df.limit(n)


def not_null(*cols: str) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return cond
