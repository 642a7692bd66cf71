"""Registered queries vs their DuckDB oracle SQL at sf0.001 (the driver's gate, small)."""

import os

import duckdb
import pytest

import __spark_entry__ as ENTRY
from tools.oracle_check import digest
from tribewise.plans.registry import TABLES

SF = "/root/testdata/sf0.001"
FAST = ["top_n_communities", "filter_top_n_semi", "coverage_stats", "top_user_exclusion", "user_contexts",
        "thread_pairs_in_window", "thread_documents", "thread_term_counts", "stopword_filter", "vocabulary",
        "pmi_labels", "compare_union", "variation_of_information", "nearest_neighbors", "silhouette_cosine",
        "davies_bouldin", "intruder_task", "rater_agreement", "cooccurrence"]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("driver tables not present")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    sdf = ENTRY.queries()[name](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    rel = con.execute(ENTRY.oracle_sql()[name])
    drows = rel.fetchall()
    dcols = [d[0] for d in rel.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert digest(sdf.columns, srows)[0] == digest(dcols, drows)[0]


def test_entry_smoke(spark):
    df = ENTRY.entry(spark)
    assert df.columns == ["subreddit_concat", "context_length"]
    assert df.count() >= 0
