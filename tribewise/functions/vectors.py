"""Dense-vector column functions on ``array<double>`` (E3 and helpers).

All are Catalyst higher-order functions (``aggregate``, ``zip_with``,
``transform``), so vector math stays in the JVM and inside codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_doubles(v) -> Column:
    return _c(v).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x * x))


def normalize(v) -> Column:
    """L2-normalized copy; a zero vector stays zero."""
    # a struct in an array of one: the norm is taken once per vector, not once per component
    held = F.array(F.struct(_c(v).alias("v"), norm(v).alias("n")))
    return F.transform(held, lambda t: F.transform(t["v"], lambda x: F.when(t["n"] > 0, x / t["n"]).otherwise(F.lit(0.0))))[0]


def sq_distance(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                       lambda acc, x: acc + x)


def add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def sub(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def group_vector_sums(df: DataFrame, group_col: str, vec_col: str, out_col: str = "vsum",
                      mean: bool = False) -> DataFrame:
    """Component-wise sum (or mean) of the vectors of each group, plus its size.

    ``posexplode`` + partial aggregation: a group holding a third of all rows
    is still combined map-side, one partial per (group, component).
    """
    sizes = df.groupBy(group_col).agg(F.count(F.lit(1)).alias("size"))
    comps = (df.select(group_col, F.posexplode(vec_col).alias("_i", "_x"))
             .groupBy(group_col, "_i").agg((F.avg("_x") if mean else F.sum("_x")).alias("_s")))
    vec = comps.groupBy(group_col).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_i", "_s"))), lambda s: s["_s"]).alias(out_col))
    return vec.join(sizes, group_col)
