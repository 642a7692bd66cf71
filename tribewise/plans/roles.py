"""Mapping of the driver tables onto the forum data model.

* submission = ``orders`` (id = o_orderkey, author = o_custkey)
* comment    = ``lineitem`` joined to its order for the author
               (community = l_partkey, link = t3_ + l_orderkey)
* thread text = ``conversations`` (turn 0 opens the thread, later turns reply)
* document class = ``documents.source``

Times become epoch seconds (``bigint``) like the dumps' ``created_utc``.
The SQL snippets below are the DuckDB twins used by the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tribewise.plans.registry import table


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return li.join(od, li.l_orderkey == od.o_orderkey).select(
        F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
        F.concat(F.lit("t3_"), F.col("l_orderkey").cast("string")).alias("link_id"),
        F.col("o_custkey").cast("string").alias("author"),
        F.col("l_partkey").cast("string").alias("subreddit"),
        F.col("l_returnflag").alias("body"),
        F.unix_timestamp("l_shipdate").alias("created_utc"),
        F.floor("l_quantity").alias("score"))


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    od = table(spark, sf_dir, "orders")
    return od.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_custkey").cast("string").alias("author"),
        F.unix_timestamp("o_orderdate").alias("created_utc"),
        F.col("o_orderstatus").alias("selftext"),
        F.col("o_orderpriority").alias("title"),
        F.floor("o_totalprice").alias("score"))


COMMENTS_SQL = """
SELECT CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) AS id,
       't3_' || CAST(l_orderkey AS VARCHAR) AS link_id,
       CAST(o_custkey AS VARCHAR) AS author,
       CAST(l_partkey AS VARCHAR) AS subreddit,
       l_returnflag AS body,
       CAST(epoch_us(l_shipdate) // 1000000 AS BIGINT) AS created_utc,
       CAST(floor(l_quantity) AS BIGINT) AS score
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

SUBMISSIONS_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS author,
       CAST(epoch_us(o_orderdate) // 1000000 AS BIGINT) AS created_utc, o_orderstatus AS selftext,
       o_orderpriority AS title, CAST(floor(o_totalprice) AS BIGINT) AS score
FROM orders
"""
