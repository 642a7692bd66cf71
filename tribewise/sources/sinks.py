"""Sinks (S10-S17).

Writers are distributed (``df.write``); nothing is converted to pandas on
the driver.  Single-file outputs use ``coalesce(1)`` only for tables whose
size is bounded (counts of the top-n vocabulary, metrics rows).
"""

from __future__ import annotations

import bz2
import json
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tribewise import schemas as S
from tribewise.session import open_shared


def write_counts(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Top-n counts as one CSV with header (bounded by n)."""
    df.coalesce(1).write.mode(mode).option("header", True).csv(path)


def write_contexts(df: DataFrame, path: str, col: str = S.CONTEXT_OUT, mode: str = "overwrite") -> None:
    """bzip2 CSV directory, one user context per line (arrays are blank-joined)."""
    c = F.col(col)
    out = df.select(F.array_join(c, " ").alias(col) if dict(df.dtypes)[col].startswith("array") else c)
    out.write.mode(mode).option("compression", "bzip2").csv(path)


#: Blocks of 100 kB: files are larger than with bzip2's usual 900 kB, and several times faster to read.
DUMP_LEVEL = 1


def write_dump(df: DataFrame, path: str, level: int = DUMP_LEVEL) -> None:
    """S1's files: JSON lines in a folder of bzip2 files, the form of ``df.write.option("compression", "bzip2").json``.

    Spark makes the lines; the tasks compress them with libbz2, as Java's codec takes several times as long on lines
    that repeat their field names. A task writes one file in ``_temporary``; those of the attempts that count are then moved to ``path``.
    """
    spark, base = df.sparkSession, path.rstrip("/")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(base)
    files = folder.getFileSystem(conf)
    if files.exists(folder):
        raise FileExistsError(path)
    temporary = jvm.org.apache.hadoop.fs.Path(f"{base}/_temporary")
    files.mkdirs(temporary)

    def compress(batches):
        from pyspark import TaskContext
        name, first = None, next((b for b in batches if b.num_rows), None)
        if first is not None:
            name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.json.bz2"
            with open_shared(f"{base}/_temporary/{name}", "w") as out:
                packer, batch = bz2.BZ2Compressor(level), first
                while batch is not None:
                    out.write(packer.compress("".join(batch.column(0).to_pylist()).encode()))
                    batch = next(batches, None)
                out.write(packer.flush())
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    lines = df.select(F.concat(F.to_json(F.struct("*")), F.lit("\n")).alias("line"))
    try:
        for row in lines.mapInArrow(compress, "name string").collect():  # a name per task
            if not files.rename(jvm.org.apache.hadoop.fs.Path(temporary, row["name"]), jvm.org.apache.hadoop.fs.Path(folder, row["name"])):
                raise OSError(f"{row['name']} was not moved to {path}")
        files.create(jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")).close()
    finally:
        files.delete(temporary, True)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by=None) -> None:
    """Joined threads / vectorized corpus."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Clusters / keywords tables with a header."""
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Metrics and parameters rows as JSON lines."""
    df.coalesce(1).write.mode(mode).json(path)


def params_frame(spark: SparkSession, params: dict) -> DataFrame:
    """A one-row DataFrame of parameters (values as JSON text) for S14."""
    return spark.createDataFrame([{k: json.dumps(v) for k, v in params.items()}])


def save_pipeline(model, path: str) -> None:
    """Spark ML pipeline / model persistence (``MLWritable``)."""
    model.write().overwrite().save(path)


def load_lda(path: str, optimizer: str = "online"):
    """``LocalLDAModel`` for online, ``DistributedLDAModel`` for em."""
    from pyspark.ml.clustering import DistributedLDAModel, LocalLDAModel
    return (LocalLDAModel if optimizer == "online" else DistributedLDAModel).load(path)


def save_vectors(vectors: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Embeddings as a Parquet table (key, vector)."""
    vectors.write.mode(mode).parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_kmeans(path: str):
    """Fitted k-means model for label reuse without refitting."""
    from pyspark.ml.clustering import KMeansModel
    return KMeansModel.load(path)
