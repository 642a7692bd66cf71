"""Co-occurrence tiles, counted runs, negative sampling in blocks and the grid, against small references."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tribewise.operators import activity as A
from tribewise.operators import embeddings as E
from tribewise.operators import sgns


def _brute_pairs(rows):
    by_user, out = {}, Counter()
    for u, i in rows:
        by_user.setdefault(u, []).append(i)
    for items in by_user.values():
        for x, a in enumerate(items):
            for y, b in enumerate(items):
                if x != y:
                    out[a, b] += 1
    return dict(out)


@pytest.mark.parametrize("tile,budget", [(1024, 4_000_000), (3, 20), (1, 1)])
def test_cooccurrence_tiles(spark, tile, budget):
    rng = np.random.default_rng(5)
    rows = [(f"u{rng.integers(9)}", f"c{rng.integers(11)}") for _ in range(160)] + [("bot", "c1")] * 50
    df = spark.createDataFrame(rows, "user string, item string")
    got = {(r.a, r.b): r.w for r in E.cooccurrence(df, "user", "item", budget=budget, tile=tile).collect()}
    assert got == _brute_pairs(rows)
    runs = df.groupBy("user", "item").agg(F.count(F.lit(1)).alias("k"))
    again = {(r.a, r.b): r.w for r in E.cooccurrence(runs, "user", "item", budget=budget, tile=tile, n_col="k").collect()}
    assert again == got


def test_cooccurrence_of_nothing(spark):
    assert E.cooccurrence(spark.createDataFrame([], "user string, item string"), "user", "item").collect() == []


def test_runs_hold_a_community_once(spark):
    rows = [("bot", "a")] * 1000 + [("bot", "b"), ("u", "b"), ("u", None), ("v", "a"), (None, "a")]
    df = spark.createDataFrame(rows, "author string, subreddit string")
    runs = {r.author: ([(x.w, x.k) for x in r.runs], r.context_length) for r in A.context_runs(df, exclude_top_perc=0.0).collect()}
    assert runs == {"bot": ([("a", 1000), ("b", 1)], 1001), "u": ([("b", 1)], 2)}
    text = {r.author: r.subreddit_concat for r in A.aggregate_for_vectorization(df, exclude_top_perc=0.0, keep_context_col=True).collect()}
    assert text == {"bot": " ".join(["a"] * 1000 + ["b"]), "u": "b"}


def _planted(seed=0, groups=10, roles=6, users=2500):
    """Contexts over items (group, role): users like one group and one role, so b - a + c finds the fourth."""
    rng, rows = np.random.default_rng(seed), []
    for u in range(users):
        g, r = rng.integers(groups), rng.integers(roles)
        words = []
        for z in rng.random(rng.integers(4, 12)):
            words.append(f"g{g if z < .45 or z >= .9 and rng.random() < .5 else rng.integers(groups)}"
                         f"r{r if .45 <= z < .9 else rng.integers(roles)}")
        rows.append((words,))
    pairs = [(f"r{r}r{s}", g, f"g{g}r{r}", f"g{g}r{s}") for r, s in ((0, 1), (2, 3)) for g in range(groups)]
    return rows, pairs


def _accuracy(analogies, vectors):
    return E.detailed_accuracy_string(E.analogy_accuracy(E.score_analogies(analogies, vectors))).first()["accuracy"]


def test_sgns_in_blocks_is_as_good_as_one_task(spark):
    rows, pairs = _planted()
    contexts = spark.createDataFrame(rows, "words array<string>").cache()
    analogies = E.generate_analogies(spark.createDataFrame(pairs, "section string, pos long, a string, b string"))
    cooc = E.context_pairs(contexts, "words")
    vectors = sgns.train(cooc, vector_size=24, negative=5, alpha=0.2, block_items=20).cache()  # 3 blocks: 9 cells
    again = sgns.train(cooc.repartition(3), vector_size=24, negative=5, alpha=0.2, block_items=20)
    one = {r.key: r.vector for r in vectors.collect()}
    assert all(np.allclose(one[r.key], r.vector, atol=1e-9) for r in again.collect()) and len(one) == 60
    word2vec, _ = E.word2vec_embeddings(contexts, "words", vector_size=24, window=20, epochs=20)
    assert _accuracy(analogies, vectors) >= _accuracy(analogies, word2vec) - 0.02
    # planted communities: the nearest neighbours share the group or the role
    near = E.nearest_neighbors(vectors, 3).collect()
    alike = [r for r in near if r.key[:r.key.index("r")] == r.neighbor[:r.neighbor.index("r")] or r.key[r.key.index("r"):] == r.neighbor[r.neighbor.index("r"):]]
    assert len(alike) >= 0.9 * len(near)


def test_sgns_gradient(spark):
    """A cell's first step moves along the gradient of the loss, taken by differences."""
    rng = np.random.default_rng(1)
    dim, n, m = 3, 4, 5
    U, V = rng.standard_normal((n, dim)), rng.standard_normal((m, dim))
    w, mass, noise = rng.integers(0, 4, (n, m)).astype(float), rng.random(n) * 9, rng.random(m)
    ia, ib = np.nonzero(w)

    def loss(U, V):
        x = U @ V.T
        return (w * -np.log1p(np.exp(-x))).sum() - 2.0 * (mass[:, None] * noise * np.log1p(np.exp(x))).sum()
    import pyarrow as pa
    row = {"p": 0, "q": 0, "u": U.tobytes(), "v": V.tobytes(), "gu": np.zeros((n, dim)).tobytes(), "gv": np.zeros((m, dim)).tobytes(),
           "mass": mass.tolist(), "noise": noise.tolist(), "ia": ia.astype("<i4").tobytes(), "ib": ib.astype("<i4").tobytes(), "w": w[ia, ib].tobytes()}
    (_, _, _, gu), (_, _, _, gv) = sgns._train(pa.RecordBatch.from_pylist([row]), dim, 2.0, 1.0, 0.1, 1, 128)
    for grad, M in ((gu, U), (gv, V)):
        for at in np.ndindex(M.shape):
            M[at] += 1e-6
            up = loss(U, V)
            M[at] -= 2e-6
            down = loss(U, V)
            M[at] += 1e-6
            assert abs(((up - down) / 2e-6) ** 2 - np.frombuffer(grad).reshape(M.shape)[at]) < 1e-3


def test_sgns_down_sampling_and_empty(spark):
    counts = spark.createDataFrame([("a", 90), ("b", 10)], "item string, n long")
    rate = {r.item: r.keep for r in sgns.keep_rates(counts, 0.1).collect()}
    assert np.isclose(rate["a"], (0.1 / 0.9) ** 0.5 + 0.1 / 0.9) and rate["b"] == 1.0
    assert {r.keep for r in sgns.keep_rates(counts, 0.0).collect()} == {1.0}
    assert sgns.train(spark.createDataFrame([], "a long, b long, w long"), vector_size=4).collect() == []


def test_grid_rows_have_all_columns(spark):
    rows, pairs = _planted(users=300)
    contexts = spark.createDataFrame(rows, "words array<string>")
    analogies = E.generate_analogies(spark.createDataFrame(pairs, "section string, pos long, a string, b string"))
    res, best, name, kept = E.grid_search(contexts, "words", analogies, {"vector_size": [4, 6], "sample": [0.0]}, keep_all=True,
                                          fixed={"epochs": 1, "negative": 5, "alpha": 0.2}, trainer="sgns", contexts_path="here")
    got = res.collect()
    assert len(res.columns) == 17 and [r.model_id for r in got] == ["sample0.0_vectorSize4", "sample0.0_vectorSize6"]
    assert {(r.contexts_path, r.num_users, r.hierarchical_softmax, r.negative) for r in got} == {("here", 300, 0, 5)}
    assert name in kept and best.count() == 60 and set(kept) == {r.model_id for r in got}
    top = max(r.accuracy for r in got)
    assert name == [r.model_id for r in got if r.accuracy == top][-1]
