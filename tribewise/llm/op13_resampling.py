"""Target-distribution importance resampling over hashed n-grams.

Texts are lower-cased, split and encoded by Arrow kernels; n-grams are runs of shifted dictionary
indices, and only distinct ones of a batch are spelled out and hashed (crc32) into a bucket.
Bucket counts of the corpus and of the target texts are summed in the tasks first, one row per
bucket and task.  The log ratio of each bucket (its gain, a whole number) is an array of
``buckets`` longs that the tasks take by index; a segment sum per document gives its weight.

A document's score is its weight plus Gumbel noise from a hash of its key: taking the highest scores
draws without replacement in proportion to exp(weight / 1000).  The rank comes from a histogram of the scores
(whole numbers of a bounded range) for the threshold, then a range-partitioned sort of
the rows at or above it, numbered within partitions and shifted by the partitions before.

Cases: a null or empty text has no features and weight 0, and is never drawn with ``min_words`` > 0; a null key hashes as an
empty one and comes last among equal scores; repeated rows are each scored, and drawn one after the other; with an empty target
or corpus all gains follow from the smoothing alone; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, text_runs, written

BUCKETS, WORDS, MIN_WORDS, PERCENT, SEED = 10000, 1, 20, 10, 2024
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(texts) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Index of each word into the distinct words, those, and the number of words of each text."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=_SPLIT)
    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    values = pc.list_flatten(lists)
    full = pc.not_equal(pc.binary_length(values), 0)
    encoded = values.filter(full).dictionary_encode()
    counts = np.bincount(rows[full.to_numpy(zero_copy_only=False)], minlength=len(texts))
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary, counts


def _bucket(names, buckets: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(name.encode()) for name in names.to_pylist()), np.int64, len(names)) % buckets


def features(texts, words: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every feature, the number of features of each text, and of its words.

    Features lie text after text; all runs of 1 word, then all of 2, and so on are merged by text.
    """
    codes, names, counts = _words(texts)
    found, texts_of = [_bucket(names, buckets)[codes]], [np.repeat(np.arange(len(counts)), counts)]
    row, code, grams = texts_of[0], codes, names
    for size in range(2, words + 1):
        n = len(codes) - size + 1
        if n <= 0:
            break
        at = np.flatnonzero(row[:n] == row[size - 1:])
        pair, inverse = np.unique(code[at] * len(names) + codes[at + size - 1], return_inverse=True)
        if not len(pair):
            break
        grams = pc.binary_join_element_wise(grams.take(pa.array(pair // len(names))), names.take(pa.array(pair % len(names))), " ")
        code = np.zeros(len(codes), np.int64)
        code[at] = inverse
        found.append(_bucket(grams, buckets)[inverse])
        texts_of.append(row[at])
    if len(found) == 1:
        return found[0], counts, counts
    text = np.concatenate(texts_of)
    return np.concatenate(found)[np.argsort(text, kind="stable")], np.bincount(text, minlength=len(counts)), counts


def bucket_counts(texts: DataFrame, words: int = WORDS, buckets: int = BUCKETS, text_col: str = "text") -> DataFrame:
    """Features of all texts by bucket: bucket, n."""
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for a, b in text_runs(batch, "text", 4 << 20):
                total += np.bincount(features(batch.column("text").slice(a, b - a), words, buckets)[0], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    return (texts.select(text_or_empty(text_col).alias("text")).mapInArrow(count, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio target : corpus) of each bucket, from two results of ``bucket_counts``."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for out, counts in ((s, corpus), (t, target)):
        for row in counts.collect():  # at most ``buckets`` rows
            out[row["bucket"]] = row["n"]
    in_corpus, in_target = int(s.sum()) + buckets, int(t.sum()) + buckets
    return np.array([math.floor(1000 * math.log((b + 1) * in_corpus / ((a + 1) * in_target))) for a, b in zip(s.tolist(), t.tolist())], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, words: int = WORDS, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, n_features, n_words and weight (the floored mean gain of a document's features)."""
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def weigh(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_runs(batch, "text", 4 << 20):
                run = batch.slice(a, b - a)
                bucket, n, n_words = features(run.column("text"), words, len(gain))
                total = np.concatenate(([0], np.cumsum(gain.take(bucket))))
                ends = np.cumsum(n)
                weight = (total[ends] - total[ends - n]) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays(
                    [run.column("key"), pa.array(n.astype(np.int64)), pa.array(n_words.astype(np.int64)), pa.array(weight)],
                    ["key", "n_features", "n_words", "weight"])

    return rows.mapInArrow(weigh, f"key {kind}, n_features long, n_words long, weight long")


def noise(key: str, seed: int = SEED):
    """floor(1000 Gumbel) of a key, from the first 32 bits of sha256('seed:key')."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(F.encode(text, "utf-8"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def _number(batches) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        at = np.arange(n, n + batch.num_rows)
        n += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part)), pa.array(at)],
                                         [*batch.schema.names, "part", "at"])


def drawn(scored: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """``scored`` (key, n_features, n_words, weight, score, serial) with the rank of the drawn rows.

    Of N rows with at least ``min_words`` words the floor(percent N / 100) highest scores are drawn,
    ties to the smaller key (null last).
    """
    levels = scored.filter(F.col("n_words") >= min_words).groupBy("score").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("score")).collect()
    wanted = percent * sum(row["n"] for row in levels) // 100
    limit, above = None, 0
    for row in levels:  # one row per whole-number score, a bounded range
        if above >= wanted:
            break
        limit, above = row["score"], above + row["n"]
    candidate = (F.col("n_words") >= min_words) & (F.col("score") >= limit) if limit is not None else F.lit(False)
    kind = scored.schema["key"].dataType.simpleString()
    order = [F.desc("score"), F.asc_nulls_last("key"), F.asc("serial")]
    high = scored.filter(candidate).select("key", "n_features", "weight", "score", "serial")
    numbered = written(
        high.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
            _number, f"key {kind}, n_features long, weight long, score long, serial long, part long, at long"), "numbered")
    before = (numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row per partition
              .withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))))
    rank = F.coalesce("before", F.lit(0)) + F.col("at") + 1
    ranked = numbered.join(before.select("part", "before"), "part").select(
        "key", "n_features", "weight", "score", F.when(rank <= wanted, rank).alias("rank"))
    rest = scored.filter(~candidate).select("key", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(rest)


def resampled(docs: DataFrame, target: DataFrame, words: int = WORDS, buckets: int = BUCKETS, min_words: int = MIN_WORDS,
              percent: int = PERCENT, seed: int = SEED, key: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Every row of ``docs``: key, n_features, weight, score, rank (null where not drawn)."""
    gain = gains(bucket_counts(docs, words, buckets, text_col), bucket_counts(target, words, buckets, target_col), buckets)
    scored = weights(docs, gain, words, key, text_col).withColumn("score", F.col("weight") + noise("key", seed))
    scored = written(scored.withColumn("serial", F.monotonically_increasing_id()), "scored")
    return drawn(scored, min_words, percent).withColumnRenamed("key", key)
