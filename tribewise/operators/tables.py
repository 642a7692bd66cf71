"""Small result-table operators.

These are the joins, unions, sorts and summaries the reference's notebooks
run on per-model result tables; all are plain DataFrame operations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join_on(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str]) -> DataFrame:
    """Left join on keys that have different names on each side (right keys dropped)."""
    cond = reduce(lambda a, b: a & b, [left[lk] == right[rk] for lk, rk in zip(left_keys, right_keys)])
    out = left.join(right, cond, "left")
    return out.drop(*[right[rk] for rk in right_keys])


def join_on(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of two cluster-level tables on (model, cluster)."""
    return a.join(b, keys)


def stack(frames: list[DataFrame]) -> DataFrame:
    """Row-wise concatenation by column name (missing columns become null)."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)


def sort_desc(df: DataFrame, cols: list[str], tie_cols: list[str] = ()) -> DataFrame:
    """Sort by the given columns descending, then tie columns ascending."""
    return df.orderBy(*[F.col(c).desc() for c in cols], *[F.col(c).asc() for c in tie_cols])


def group_means(df: DataFrame, group_cols: list[str], value_cols: list[str]) -> DataFrame:
    """Mean of each value column per group."""
    return df.groupBy(*group_cols).agg(*[F.avg(c).alias(f"mean_{c}") for c in value_cols])


def count_summary(df: DataFrame, count_col: str) -> DataFrame:
    """Total, sample stddev (ddof 1) and population stddev of a count column."""
    return df.agg(F.sum(count_col).alias("total"), F.stddev_samp(count_col).alias("stddev_samp"),
                  F.stddev_pop(count_col).alias("stddev_pop"))


def min_max_pick(df: DataFrame, id_col: str, metric_col: str) -> DataFrame:
    """The row ids with the smallest and the largest metric (ties: smallest id)."""
    return df.agg(F.min_by(id_col, F.struct(F.col(metric_col), F.col(id_col))).alias("min_id"),
                  F.min(metric_col).alias("min_value"),
                  F.min_by(id_col, F.struct((-F.col(metric_col)).alias("m"), F.col(id_col))).alias("max_id"),
                  F.max(metric_col).alias("max_value"))


def log_counts(df: DataFrame, count_col: str, out_col: str = "log_count") -> DataFrame:
    """Natural log of a count; null for counts <= 0 instead of an ANSI error."""
    return df.withColumn(out_col, F.when(F.col(count_col) > 0, F.ln(F.col(count_col))))
