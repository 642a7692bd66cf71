"""Operator tests on small rows of our own."""

import math

import pytest
from pyspark.sql import functions as F

from tribewise.operators import activity as A
from tribewise.operators import annotate as AN
from tribewise.operators import compare as C
from tribewise.operators import embeddings as E
from tribewise.operators import filters as FL
from tribewise.operators import text as T
from tribewise.operators import threads as TH
from tribewise.operators import topics as TP
from tribewise.functions.text import tokenize


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_regex_filter(spark):
    names = ["u_kettle", "gardening", "u_9lives", "TeaGarden", "blu_ray", "u_"]
    df = spark.createDataFrame([(c,) for c in names], "subreddit string")
    assert rows(FL.filter_by_regex(df), "subreddit") == [("TeaGarden",), ("blu_ray",), ("gardening",)]
    assert FL.filter_by_regex(df, pattern="(?i).*garden.*", match_complement=False).count() == 2


def test_sentinels_drop_nulls(spark):
    df = spark.createDataFrame([("a", "x"), ("[deleted]", "y"), (None, "z"), ("b", "[removed]"), ("c", None)],
                               "author string, body string")
    assert rows(FL.remove_deleted_text(FL.remove_deleted_authors(df), "comments"), "author") == [("a",)]


def test_percent_filter_keeps_ties_and_no_percentile_column(spark):
    df = spark.createDataFrame([(str(i), i) for i in range(1, 6)], "subreddit_concat string, context_length long")
    out = A.exclude_top_percentage(df, "context_length", 0.2)
    assert rows(out, "context_length") == [(1,), (2,), (3,), (4,)]
    assert out.columns == ["subreddit_concat", "context_length"]
    single = spark.createDataFrame([("x", 7)], "subreddit_concat string, context_length long")
    assert A.exclude_top_percentage(single, "context_length", 0.5).count() == 1


def test_filter_out_top_users(spark):
    posts = {"ann": 1, "bob": 7, "cy": 2, "dee": 4, "eve": 3}
    df = spark.createDataFrame([(name,) for name, n in posts.items() for _ in range(n)], "author string")
    out = A.filter_out_top_users(df, "author", 0.2)
    assert out.columns == ["author"]
    assert out.count() == sum(posts.values()) - posts["bob"] and "bob" not in {r[0] for r in out.collect()}


def test_contexts_and_top_n(spark):
    data = [("ann", c) for c in ("tea", "bikes", "tea", "tea")] + [("bob", c) for c in ("maps", "bikes")] + [("cy", "maps")]
    df = spark.createDataFrame(data, "author string, subreddit string")
    ctx = A.aggregate_for_vectorization(df, exclude_top_perc=0.0)
    assert ("bikes tea tea tea", 4) in rows(ctx, "subreddit_concat", "context_length")
    assert ("bikes maps", 2) in rows(ctx, "subreddit_concat", "context_length")
    top = A.get_top_n_counts(df, "subreddit", 2)
    assert [tuple(r) for r in top.collect()] == [("tea", 3), ("bikes", 2)]
    assert A.filter_top_n(df, top, "subreddit").count() == 5


def test_thread_join_and_window(spark):
    subs = spark.createDataFrame([(f"s{i}", f"t3_s{i}", 1000 * i) for i in range(3)],
                                 "id string, fullname_id string, created_utc long")
    com = spark.createDataFrame([("late", "t3_s1", 1900), ("early", "t3_s1", 1020), ("before", "t3_s2", 1990), ("lost", "t3_s7", 5)],
                                "id string, link_id string, created_utc long")
    pairs = TH.join_submissions_and_comments(subs, com)
    assert rows(pairs, "id", "comments_id") == [("s1", "early"), ("s1", "late"), ("s2", "before")]
    win = FL.filter_by_time_delta(pairs, 500, 0)
    assert rows(win, "comments_id", "time_to_comment_in_seconds") == [("early", 20)]


def test_documents_keep_order_and_blanks(spark):
    pairs = spark.createDataFrame(
        [("s1", "", "Title", "c2", "second", 20, "r"), ("s1", "", "Title", "c1", "first", 10, "r")],
        "id string, selftext string, title string, comments_id string, body string, "
        "time_to_comment_in_seconds long, subreddit string")
    doc = TH.documents_from_pairs(pairs).collect()[0]
    assert doc["document_text"] == "Title  first second"


def test_tokens_and_bag_of_words(spark):
    df = spark.createDataFrame([("1", "Hey #tag @user yo-yo www.reddit.com ain't !!"), ("2", "...")],
                               "id string, t string")
    toks = {r["id"]: r["k"] for r in df.select("id", tokenize("t").alias("k")).collect()}
    assert toks["1"] == ["hey", "#tag", "@user", "yo-yo", "www.reddit.com", "ain't"]
    assert toks["2"] == []
    docs = spark.createDataFrame([(1, ["a"] * 3), (2, ["b"] * 3), (3, ["a", "a", "b"])], "doc_id long, tokens array<string>")
    tf = T.term_frequencies(docs, "doc_id", "tokens")
    assert rows(tf, "doc_id", "term", "tf") == [(1, "a", 3), (2, "b", 3), (3, "a", 2), (3, "b", 1)]
    vocab = T.fit_vocabulary(tf, docs, "doc_id")
    assert rows(vocab, "term_id", "term") == [(0, "a"), (1, "b")]


def test_probabilities(spark):
    weights = {"tea": 6, "maps": 2, "bikes": 8}
    keys = spark.createDataFrame([(k,) for k in (*weights, "chess")], "key string")
    counts = spark.createDataFrame(list(weights.items()), "key string, n long")
    p = dict(rows(C.key_probabilities(keys, counts), "key", "p"))
    assert p == {"tea": 0.375, "maps": 0.125, "bikes": 0.5, "chess": 0.0}
    r = spark.createDataFrame([(k, 5 if k == "maps" else 9, 0, n, n) for k, n in weights.items()],
                              "key string, c1 long, c2 long, n1 long, n2 long")
    cp = dict(rows(C.cluster_probabilities(r, "c1"), "cluster", "p"))
    assert cp == {5: 0.125, 9: 0.875}


def test_contingency_mi_vi(spark):
    m1 = spark.createDataFrame([(f"k{i}", i) for i in range(4)], "key string, cluster long")
    m2 = spark.createDataFrame([(f"k{i}", 30 - i) for i in range(4)], "key string, cluster long")
    r = C.remap_clusters(m1, m2)
    per_cell = {(i, 30 - i) for i in range(4)}
    assert {(a, b) for a, b, _ in rows(C.contingency_table(r), "c1", "c2", "n")} == per_cell
    v = C.variation_of_information(r).collect()[0]
    assert math.isclose(v["mi"], 2.0) and abs(v["vi"]) < 1e-12
    same = C.variation_of_information(C.remap_clusters(m1, m1)).collect()[0]
    assert abs(same["vi"]) < 1e-12


def test_union_remap(spark):
    m1 = spark.createDataFrame([("tea", 4), ("maps", 6), ("bikes", 4)], "key string, cluster long")
    m2 = spark.createDataFrame([("chess", 8), ("tea", 9), ("maps", 8)], "key string, cluster long")
    r = dict((k, (a, b)) for k, a, b in rows(C.remap_clusters(m1, m2, use_union=True), "key", "c1", "c2"))
    assert r == {"tea": (4, 9), "maps": (6, 8), "bikes": (4, -1), "chess": (-1, 8)}


def test_pair_metrics_relabel_invariant(spark):
    a = spark.createDataFrame([(i, i % 3) for i in range(30)], "key long, cluster long")
    b = spark.createDataFrame([(i, 10 + (i % 3)) for i in range(30)], "key long, cluster long")
    m = dict(rows(C.compare_clusterings(a, b), "metric", "value"))
    for k in ("adjusted_rand_index", "rand_index", "normalized_mutual_info", "homogeneity", "completeness", "v_measure"):
        assert math.isclose(m[k], 1.0)
    assert abs(m["variation_of_information"]) < 1e-12


def test_greedy_matching(spark):
    table = [[5, 6, 0, 0], [0, 9, 3, 0], [0, 8, 4, 0]]
    ct = spark.createDataFrame([(i, j, v) for i, r in enumerate(table) for j, v in enumerate(r)], "c1 long, c2 long, n long")
    labels = spark.createDataFrame([(i,) for i in range(4)], "cluster long")
    got = rows(C.maximum_matching(ct, labels.where("cluster < 3"), labels), "c1", "c2")
    assert got == [(-1, 3), (0, 0), (1, 1), (2, 2)]


def test_band_join_intruders(spark):
    data = [("a", 1, 100), ("b", 1, 90), ("conservatives", 2, 95), ("d", 2, 10), ("e", 3, 200)]
    df = spark.createDataFrame(data, "key string, cluster long, count long")
    el = AN.eligible_intruders(df, n=2)
    got = rows(el.where("cluster = 1"), "candidate")
    assert got == [("conservatives",)]


def test_label_task_columns(spark):
    df = spark.createDataFrame([("a", 1, 5), ("b", 1, 9), ("c", 2, 1), ("d", 3, 2)], "key string, cluster long, count long")
    t = AN.label_task(df, "m1")
    assert t.columns == ["model_id", "cluster_id", "members", "coherent", "cluster_label"]
    assert dict(rows(t, "cluster_id", "members"))[1] == "b a"


def test_agreement_perfect(spark):
    df = spark.createDataFrame([(i, i % 2, i % 2) for i in range(10)], "item long, r1 int, r2 int")
    ag = AN.agreement(df, "item", ["r1", "r2"]).collect()[0]
    assert math.isclose(ag["observed_agreement"], 1.0) and math.isclose(ag["fleiss_kappa"], 1.0)


def test_asymmetric_alpha_and_grid_ids():
    assert TP.asymmetric_alpha(4) == [1 / 2, 1 / 3, 1 / 4, 1 / 5]
    assert E.model_id({"alpha": 0.02, "vector_size": 25, "sample": 0.002}) == "alpha0.02_sample0.002_vectorSize25"
    assert len(E.expand_grid({"a": [1, 2], "b": [1, 2], "c": [1, 2], "d": [1]})) == 8
    with pytest.raises(ValueError):
        TP.document_concentration(4, None, True, "em")
    assert TP.document_concentration(3, 0.5, True, "online") == [0.5] * 3 and TP.document_concentration(3, None, False, "em") is None


def test_detailed_accuracy_roundtrip(spark):
    per = spark.createDataFrame([("b", 1, 4), ("a", 3, 5)], "section string, correct long, total long")
    rep = E.detailed_accuracy_string(per)
    s = rep.collect()[0]["detailed_accuracy"]
    assert s == "a:3/5,b:1/4"
    assert rows(E.parse_detailed_accuracy(rep), "section", "correct", "total") == [("a", 3, 5), ("b", 1, 4)]


def test_analogy_generation(spark):
    pairs = spark.createDataFrame([("s", 0, "a", "b"), ("s", 1, "c", "d"), ("s", 2, "e", "f")],
                                  "section string, pos long, a string, b string")
    assert E.generate_analogies(pairs).count() == 3


def test_cooccurrence_closed_form(spark):
    df = spark.createDataFrame([("u", "a"), ("u", "a"), ("u", "b"), ("v", "b")], "user string, item string")
    got = dict(((a, b), w) for a, b, w in rows(E.cooccurrence(df, "user", "item"), "a", "b", "w"))
    assert got == {("a", "a"): 2, ("a", "b"): 2, ("b", "a"): 2}


def test_dump_scan_and_stream(spark, tmp_path):
    import json
    from tribewise.sources import readers, sinks
    from tribewise.streaming import ingest
    folder = tmp_path / "dumps"
    folder.mkdir()
    recs = [{"id": "1", "author": "a", "subreddit": "nba", "body": "x", "created_utc": 1506816000, "extra": 1},
            {"id": "2", "author": "[deleted]", "subreddit": "nba", "body": "y", "created_utc": 1506816000},
            {"id": "3", "author": "b", "subreddit": "u_b", "body": "z", "created_utc": 1506816000}]
    (folder / "c1.json").write_text("\n".join(json.dumps(r) for r in recs) + "\n{bad json\n")
    df = readers.read_dump(spark, str(folder))
    assert "extra" not in df.columns and df.count() == 4
    q = ingest.start_counts(spark, str(folder), str(tmp_path / "ckpt"), "tw_counts_test")
    q.processAllAvailable()
    got = {r["subreddit"]: r["count"] for r in spark.sql("select * from tw_counts_test").collect()}
    q.stop()
    assert got == {"nba": 1}
    sinks.write_counts(spark.createDataFrame([("nba", 1)], "subreddit string, count long"), str(tmp_path / "counts"))
    assert readers.read_vocabulary(spark, str(tmp_path / "counts")).collect()[0]["count"] == 1


def test_bag_of_words_job(spark):
    from tribewise.plans.jobs import bag_of_words_prep
    subs = spark.createDataFrame(
        [("s1", "x", 100, "a", "t1", "nba"), ("s2", "y", 100, "[removed]", "t2", "nba"), ("s3", "[deleted]", 100, "c", "t3", "nba")],
        "id string, author string, created_utc long, selftext string, title string, subreddit string")
    com = spark.createDataFrame(
        [("c1", "t3_s1", "p", 150, "hi", "nba"), ("c2", "t3_s1", "q", 90, "yo", "nba"), ("c3", "t3_s2", "p", 120, "ok", "nba"),
         ("c4", "t3_s1", "[deleted]", 130, "no", "nba")],
        "id string, link_id string, author string, created_utc long, body string, subreddit string")
    pairs = bag_of_words_prep(com, subs, top_n=10, exclude_top_perc=0.0, min_time_delta=0)
    assert rows(pairs, "id", "comments_id", "time_to_comment_in_seconds") == [("s1", "c1", 50)]


def test_agreement_with_missing_ratings(spark):
    table = [(1, 1, 1, 0), (2, 0, 0, 0), (3, 1, None, 1), (4, None, 0, None), (5, 1, 0, 1), (6, None, None, None)]
    df = spark.createDataFrame(table, "item int, a int, b int, c int")
    votes = [[v for v in r[1:] if v is not None] for r in table]
    votes = [v for v in votes if v]
    many = [v for v in votes if len(v) > 1]
    pa = sum(sum(v.count(k) * (v.count(k) - 1) for k in (0, 1)) / (len(v) * (len(v) - 1)) for v in many) / len(many)
    pi = [sum(v.count(k) / len(v) for v in votes) / len(votes) for k in (0, 1)]
    fleiss, gwet = sum(x * x for x in pi), sum(x * (1 - x) for x in pi)
    got = AN.agreement(df, "item", ["a", "b", "c"]).first()
    assert got["items"] == 5 and math.isclose(got["observed_agreement"], pa)
    assert math.isclose(got["fleiss_kappa"], (pa - fleiss) / (1 - fleiss)) and math.isclose(got["gwet_ac1"], (pa - gwet) / (1 - gwet))
    assert rows(AN.pairwise_agreement(df, "item", ["a", "b", "c"]), "raters") == [("a,b",), ("a,c",), ("b,c",)]
    scored = spark.createDataFrame([(0.5,), (1.0,), (0.0,)], "model_precision double")
    assert rows(AN.precision_summary(scored), "rows", "mean", "stddev") == [(3, 0.5, 0.5)]


def test_components_of_a_long_path(spark):
    from tribewise.operators.graph import connected_components
    edges = spark.createDataFrame([(i, i + 1) for i in range(63)], "src long, dst long")
    got = connected_components(spark.range(65), edges).collect()
    assert {r["component"] for r in got if r["id"] < 64} == {0} and {r["id"]: r["component"] for r in got}[64] == 64


def test_matching_runs_to_the_end(spark):
    cells = spark.createDataFrame([(i, j, 100 - 10 * max(i, j) - (i != j)) for i in range(4) for j in range(4)], "c1 long, c2 long, n long")
    assert rows(C.maximum_matching(cells), "c1", "c2") == [(i, i) for i in range(4)]


def test_folded_analogy_keys_do_not_multiply(spark):
    vectors = spark.createDataFrame([("man", [1.0, 0.0]), ("MAN", [1.0, 0.0]), ("king", [1.0, 1.0]), ("woman", [0.0, 1.0]),
                                     ("queen", [0.0, 2.0])], "key string, vector array<double>")
    one = spark.createDataFrame([("s", "man", "king", "woman", "queen")], "section string, a string, b string, c string, d string")
    assert E.score_analogies(one, vectors, case_insensitive=True).count() == 1
