"""The corpus pipeline: stages over ``documents``, each applying one operator of ``tribewise.llm``.

Every stage takes (spark, docs, sf_dir), works on all that the stage before it
kept, and (but for the last) returns the columns of ``documents``.

1. quality: documents that the classifier scores below 0.5 go.
2. line_dedup: repeated runs of lines go; so does a document of which nothing is left.
3. near_duplicates: of each group (five-word shingles, similarity 0.8 or more) the smallest doc_id stays.
4. decontaminate: documents that hold a benchmark passage go.
5. sentencepiece: documents become ids; the digests of ids and of the decoded text come with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tribewise.llm import op1_lines, op7_sentencepiece, op8_quality, op9_minhash, op10_decontaminate
from tribewise.llm.common import shared_path, table
from tribewise.llm.queries import PIECE_MODEL, learning_labels

#: A trained classifier and components are no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = op8_quality.train(docs, learning_labels(table(spark, sf_dir, "labels")))
    return op8_quality.score(docs, model).filter("quality_score >= 0.5").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = op1_lines.deduplicated(docs)
    left = found.filter((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("deduped", "\n", "")) != ""))
    changed = F.col("n_removed") > 0
    new = {"text": F.col("deduped"), "n_chars": F.when(changed, F.length("deduped").cast("long")).otherwise(F.col("n_chars"))}
    return left.select(*[(new[c].alias(c) if c in new else F.col(c)) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op9_minhash.one_of_each(docs, words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op10_decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_sentencepiece.digests(docs, PIECE_MODEL, ids_out=True)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
          ("decontaminate", decontaminate), ("sentencepiece", sentencepiece)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
