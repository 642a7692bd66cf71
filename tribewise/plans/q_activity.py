"""Driver-table queries for imports, filters and user activity (P1 slice)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tribewise.operators import activity as A
from tribewise.operators import filters as FL
from tribewise.plans import roles
from tribewise.plans.registry import query, r6, table

TOP_N = 1000
USER_EXCLUDE = 0.05

_C = f"c AS ({roles.COMMENTS_SQL})"
_TOP = (f"top AS (SELECT subreddit FROM (SELECT subreddit, count(*) AS n FROM c GROUP BY subreddit "
        f"ORDER BY n DESC, subreddit ASC LIMIT {TOP_N}))")


def _top_filtered(spark, d):
    c = roles.comments(spark, d)
    top = A.get_top_n_counts(c, "subreddit", TOP_N)
    return c, A.filter_top_n(c, top, "subreddit")


@query("top_n_communities", f"""
SELECT l_partkey AS community, count(*) AS n_rows FROM lineitem
GROUP BY l_partkey ORDER BY n_rows DESC, community ASC LIMIT {TOP_N}""")
def top_n_communities(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("community"))
    return A.get_top_n_counts(li, "community", TOP_N, count_col="n_rows")


@query("filter_top_n_semi", f"""
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY l_partkey
                    ORDER BY count(*) DESC, l_partkey ASC LIMIT {TOP_N})""")
def filter_top_n_semi(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    top = A.get_top_n_counts(li, "l_partkey", TOP_N)
    return A.filter_top_n(li, top, "l_partkey")


@query("regex_filter_keep", """
SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(red|blue) .*')""")
def regex_filter_keep(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    return FL.filter_by_regex(p, "p_name", "^(red|blue) .*", match_complement=False)


@query("regex_filter_drop", """
SELECT doc_id, source, lang FROM documents WHERE NOT regexp_matches(source, '^src1.*')""")
def regex_filter_drop(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    return FL.filter_by_regex(docs, "source", "^src1.*", match_complement=True)


_SENTINELS_SQL = f"""
WITH {_C},
m AS (SELECT id, CASE WHEN score >= 49 THEN '[deleted]' WHEN score = 1 THEN NULL ELSE author END AS author,
             CASE WHEN body = 'R' THEN '[removed]' WHEN body = 'A' AND score = 2 THEN '[deleted]' WHEN score = 3 THEN NULL ELSE body END AS body
      FROM c)"""


def _with_sentinels(spark, d):
    """All comments; returned ones count as removed text, the largest and smallest orders as deleted authors and nulls."""
    return roles.comments(spark, d).select(
        "id", F.when(F.col("score") >= 49, "[deleted]").when(F.col("score") == 1, None).otherwise(F.col("author")).alias("author"),
        F.when(F.col("body") == "R", "[removed]").when((F.col("body") == "A") & (F.col("score") == 2), "[deleted]")
        .when(F.col("score") == 3, None).otherwise(F.col("body")).alias("body"))


@query("sentinel_filters", _SENTINELS_SQL + """
SELECT id, author, body FROM m WHERE author <> '[deleted]' AND body NOT IN ('[removed]', '[deleted]')""")
def sentinel_filters(spark, d):
    """F2 + F3 on rows that hold every sentinel and nulls; the two operators alone drop them."""
    return FL.remove_deleted_text(FL.remove_deleted_authors(_with_sentinels(spark, d))).select("id", "author", "body")


@query("coverage_stats", f"""
WITH {_C}, {_TOP},
f AS (SELECT * FROM c WHERE subreddit IN (SELECT subreddit FROM top)),
b AS (SELECT count(DISTINCT subreddit) AS cb, count(*) AS rb, count(DISTINCT author) AS ub FROM c),
a AS (SELECT count(DISTINCT subreddit) AS ca, count(*) AS ra, count(DISTINCT author) AS ua FROM f)
SELECT cb AS communities_before, ca AS communities_after, rb AS rows_before, ra AS rows_after,
       round(ra / CAST(rb AS DOUBLE), 6) + 0.0 AS row_coverage,
       ub AS users_before, ua AS users_after,
       round(ua / CAST(ub AS DOUBLE), 6) + 0.0 AS user_coverage
FROM b, a""")
def coverage_stats(spark, d):
    c, f = _top_filtered(spark, d)
    s = A.coverage_stats(c, f)
    return s.withColumn("row_coverage", r6("row_coverage")).withColumn("user_coverage", r6("user_coverage"))


@query("top_user_exclusion", f"""
SELECT o_custkey, n_orders FROM (
  SELECT o_custkey, count(*) AS n_orders, percent_rank() OVER (ORDER BY count(*)) AS pr
  FROM orders GROUP BY o_custkey) WHERE pr <= {1.0 - USER_EXCLUDE}""")
def top_user_exclusion(spark, d):
    o = table(spark, d, "orders")
    counts = A.user_activity_counts(o, "o_custkey", "n_orders")
    return A.exclude_top_percentage(counts, "n_orders", USER_EXCLUDE)


@query("rows_without_top_users", f"""
WITH {_C},
u AS (SELECT author, percent_rank() OVER (ORDER BY count(*)) AS pr FROM c GROUP BY author)
SELECT id, author, subreddit FROM c WHERE author IN (SELECT author FROM u WHERE pr <= {1.0 - USER_EXCLUDE})""")
def rows_without_top_users(spark, d):
    c = roles.comments(spark, d)
    return A.filter_out_top_users(c, "author", USER_EXCLUDE).select("id", "author", "subreddit")


_CONTEXTS_SQL = f"""
WITH {_C}, {_TOP},
f AS (SELECT * FROM c WHERE subreddit IN (SELECT subreddit FROM top) AND author <> '[deleted]'),
u AS (SELECT author, string_agg(subreddit, ' ' ORDER BY subreddit) AS subreddit_concat,
             count(*) AS context_length FROM f GROUP BY author),
r AS (SELECT *, percent_rank() OVER (ORDER BY context_length) AS pr FROM u),
ctx AS (SELECT subreddit_concat, context_length FROM r WHERE pr <= {1.0 - USER_EXCLUDE} AND context_length >= 2)"""


def user_contexts_df(spark, d):
    """P1 on the driver tables: top-n -> semi join -> deleted authors -> contexts."""
    from tribewise.plans.jobs import community2vec_prep
    counts, contexts = community2vec_prep(roles.comments(spark, d), top_n=TOP_N,
                                          exclude_top_perc=USER_EXCLUDE)
    return contexts


@query("user_contexts", _CONTEXTS_SQL + "\nSELECT subreddit_concat, context_length FROM ctx")
def user_contexts(spark, d):
    return user_contexts_df(spark, d)


@query("context_runs", _CONTEXTS_SQL + """,
runs AS (SELECT author, subreddit, count(*) AS n FROM f GROUP BY author, subreddit)
SELECT runs.author, subreddit, n, context_length FROM runs JOIN r ON r.author = runs.author
WHERE pr <= """ + str(1.0 - USER_EXCLUDE) + """ AND context_length >= 2""")
def context_runs(spark, d):
    """A3 as counted runs, one row per (user, community)."""
    c = roles.comments(spark, d)
    kept = FL.remove_deleted_authors(A.filter_top_n(c, A.get_top_n_counts(c, "subreddit", TOP_N), "subreddit"))
    runs = A.context_runs(kept, exclude_top_perc=USER_EXCLUDE)
    return runs.select("author", "context_length", F.explode("runs").alias("r")).select(
        "author", F.col("r.w").alias("subreddit"), F.col("r.k").alias("n"), "context_length")


@query("context_stats", _CONTEXTS_SQL + """
SELECT count(*) AS num_contexts, max(context_length) AS max_context_length,
       max(len(string_split(subreddit_concat, ' '))) AS max_context_tokens FROM ctx""")
def context_stats(spark, d):
    ctx = user_contexts_df(spark, d)
    return ctx.agg(F.count(F.lit(1)).alias("num_contexts"),
                   F.max("context_length").alias("max_context_length"),
                   F.max(F.size(F.split("subreddit_concat", " "))).cast("bigint").alias("max_context_tokens"))


@query("timeframe", """
SELECT start_epoch, end_epoch,
       strftime(make_timestamp(start_epoch * 1000000), '%Y-%m-%d %H:%M:%S') AS start_time,
       strftime(make_timestamp(end_epoch * 1000000), '%Y-%m-%d %H:%M:%S') AS end_time
FROM (SELECT CAST(min(epoch_us(ts)) // 1000000 AS BIGINT) AS start_epoch, CAST(max(epoch_us(ts)) // 1000000 AS BIGINT) AS end_epoch FROM events)""")
def timeframe(spark, d):
    ev = table(spark, d, "events").select(F.unix_timestamp("ts").alias("created_utc"))
    return A.get_start_end_timeframes(ev, "created_utc")
