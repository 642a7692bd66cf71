"""Sources (S1-S9, S19).

Dumps are JSON lines (bz2 handled by the codec) read with the fixed DDL
schemas, so undeclared fields are pruned at the scan and malformed fields
become null (PERMISSIVE) or abort the job (FAILFAST).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tribewise import schemas as S


def read_dump(spark: SparkSession, paths, record_type: str = S.COMMENTS, mode: str = "PERMISSIVE") -> DataFrame:
    """JSON-lines scan of one or many paths/globs with the fixed schema."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return (spark.read.schema(S.SCHEMAS[record_type]).option("mode", mode).option("encoding", "UTF-8")
            .json(paths))


def read_contexts(spark: SparkSession, path: str, col: str = S.CONTEXT_OUT, as_array: bool = True) -> DataFrame:
    """S3: user contexts, one blank-delimited line per user."""
    df = spark.read.text(path).withColumnRenamed("value", col)
    return df.withColumn(col, F.split(F.col(col), " ")) if as_array else df


def read_vocabulary(spark: SparkSession, path: str, has_header: bool = True, token_index: int = 0,
                    count_index: int = 1, key_col: str = S.COMMUNITY, count_col: str = S.COUNT) -> DataFrame:
    """Key,count CSV -> (key, count) DataFrame, columns chosen by position."""
    df = spark.read.option("header", has_header).csv(path)
    return df.select(F.col(df.columns[token_index]).alias(key_col),
                     F.col(df.columns[count_index]).cast("bigint").alias(count_col))


def read_corpus(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Any Spark-readable corpus (Parquet of joined threads by default)."""
    return spark.read.load(path, format=fmt, **options)


def read_header_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Cluster / counts / ratings CSVs with a header; the model name is ``df.columns[1]``."""
    r = spark.read.option("header", True)
    return r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)


def read_collection(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One member per line, stripped -> (collection, member)."""
    return (spark.read.text(path).select(F.lit(name).alias("collection"), F.trim("value").alias("member"))
            .where(F.col("member") != ""))


def read_metrics(spark: SparkSession, paths, month_pattern: str = r"(\d{4}-\d{2})") -> DataFrame:
    """Metric JSON files of many months, the month taken from the path."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return (spark.read.json(paths).withColumn("month", F.regexp_extract(F.input_file_name(), month_pattern, 1)))
