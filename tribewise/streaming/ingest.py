"""Incremental import of new dump files with Structured Streaming.

The reference has no streaming operator; this module only runs the S1 scan
and the community counting of P1 (F1, F2, A1 input) over files that arrive
in a folder, so monthly dumps can be added without rescanning old ones.
The running counts are a stateful aggregate kept by Spark's state store; a
checkpoint location in the shared folder makes the query restartable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tribewise import schemas as S
from tribewise.operators import filters as FL


def stream_dump(spark: SparkSession, folder: str, record_type: str = S.COMMENTS,
                max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(S.SCHEMAS[record_type]).option("mode", "PERMISSIVE")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(folder)


def running_community_counts(stream: DataFrame, community_col: str = S.COMMUNITY,
                             pattern: str = S.USER_PROFILE_PATTERN) -> DataFrame:
    """Streaming (community, count) of rows that pass F1 and F2."""
    kept = FL.remove_deleted_authors(FL.filter_by_regex(stream, community_col, pattern))
    return kept.groupBy(community_col).agg(F.count(F.lit(1)).alias(S.COUNT))


def start_counts(spark: SparkSession, folder: str, checkpoint: str, query_name: str = "community_counts",
                 sink: str = "memory"):
    """Start the counting query (complete output mode)."""
    counts = running_community_counts(stream_dump(spark, folder))
    return (counts.writeStream.outputMode("complete").format(sink).queryName(query_name)
            .option("checkpointLocation", checkpoint).start())
