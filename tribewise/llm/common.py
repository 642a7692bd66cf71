"""Shared pieces of the training-data operators.

Tables, sessions and files only; no operator logic.  Everything written goes
to the folder that the cluster shares (``spark.checkpoint.dir``).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tribewise.session import checkpoint_dir, open_shared  # noqa: F401 (open_shared is used by the operators)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    spark.sparkContext._jvm.System.gc()  # lets Spark's cleaner drop the shuffle files of finished steps
    return spark.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a folder made by ``shared_path`` (no-op if it is gone)."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


def free(df: DataFrame) -> None:
    """Delete the files under a ``written`` table that no later step reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/llm-" in path:
            drop_table(df.sparkSession, path)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def text_key(col: str = "text") -> list:
    """128 bits of a text's content as two longs, ``h1`` and ``h2``; null counts as empty."""
    text = text_or_empty(col)
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(71), text).alias("h2")]


def text_runs(batch, text_col: str, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Cut an Arrow batch into runs of rows [a, b) of about ``max_bytes`` of text; a longer text is alone."""
    import numpy as np
    import pyarrow.compute as pc
    sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    a, n = 0, len(sizes)
    while a < n:
        base = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
        yield a, b
        a = b
