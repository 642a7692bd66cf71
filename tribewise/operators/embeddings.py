"""Community embeddings as distributed jobs.

* Co-occurrence (E1) is a tiled Gram product: (user, community) counts are
  pre-aggregated, users are hashed into blocks and communities into tiles, and X^T Y of
  two tiles of a block is one NumPy product inside a task.  Pairs are summed over all
  users of the block before they leave the task, so no per-user pair list is ever
  materialized and a hot user costs one matrix row per tile.
* Training: skip-gram with negative sampling over co-occurrence cells (``operators.sgns``),
  ``pyspark.ml.feature.Word2Vec`` over the contexts (one task), or shifted
  PPMI factorized by the distributed SVD of ``IndexedRowMatrix``.
* Neighbours, all-pairs distances and analogy scoring use the blocked
  cogroup products of ``tribewise.operators.blocked``.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tribewise.functions import vectors as V
from tribewise.operators import blocked as B
from tribewise.session import cut_lineage, drop_state


# --- E1: co-occurrence -------------------------------------------------------
ROWS = 200_000  # (user, item) rows of a tile that a task holds


def cooccurrence(df: DataFrame, user_col: str, item_col: str, budget: int = 4_000_000,
                 tile: int = 1024, n_col: str | None = None) -> DataFrame:
    """(a, b, w) with w = sum over users of n_a * n_b (a != b) and
    n_a * (n_a - 1) (a == b): every pair of a user's rows co-occurs.

    With ``n_col`` the rows are already counted runs (user, item, n), as
    ``activity.context_runs`` gives them.  Items are hashed into tiles of about ``tile``, users into blocks
    so that a block's users x tile matrix has about ``budget`` doubles and a tile of a block about ``ROWS`` rows.  A task of the
    product holds the two matrices of one (block, tile, tile) and returns one bounded tile of the sum.
    """
    uc = df.groupBy(user_col, item_col).agg((F.sum(n_col) if n_col else F.count(F.lit(1))).alias("_n"))
    stats = uc.agg(F.approx_count_distinct(user_col).alias("u"), F.approx_count_distinct(item_col).alias("m"), F.count(F.lit(1)).alias("n")).first()
    tiles = max(1, math.ceil((stats["m"] or 0) / tile))
    nb = max(1, math.ceil((stats["u"] or 0) * min(tile, stats["m"] or 1) / budget), math.ceil(stats["n"] / tiles / ROWS))
    it = uc.schema[item_col].dataType.simpleString()
    # a row of tile t takes part in the products (t, t..) and (..t, t)
    own = F.pmod(F.xxhash64(F.col(item_col)), F.lit(tiles)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)).cast("array<int>"))
    placed = (uc.select(F.col(user_col).alias("u"), F.col(item_col).alias("i"), F.col("_n").cast("double").alias("n"), own.alias("own"),
                        F.pmod(F.xxhash64(F.col(user_col)), F.lit(nb)).alias("block")).withColumn("other", other)
              .select("block", F.least("own", "other").alias("ta"), F.greatest("own", "other").alias("tb"), "own", "u", "i", "n"))

    def gram(pdf: pd.DataFrame) -> pd.DataFrame:
        ta, tb = pdf["ta"].iloc[0], pdf["tb"].iloc[0]
        user, users = pd.factorize(pdf["u"])
        n = pdf["n"].to_numpy()

        def side(t):
            rows = (pdf["own"] == t).to_numpy()
            code, items = pd.factorize(pdf["i"][rows])
            X = np.zeros((len(users), len(items)))
            X[user[rows], code] = n[rows]
            return X, np.asarray(items)
        X, left = side(ta)
        Y, right = (X, left) if ta == tb else side(tb)
        G = X.T @ Y
        if ta == tb:
            G[np.diag_indices(len(left))] -= X.sum(axis=0)
        i, j = np.nonzero(G)
        w = np.rint(G[i, j]).astype(np.int64)
        out = pd.DataFrame({"a": left[i], "b": right[j], "w": w})
        return out if ta == tb else pd.concat([out, out.rename(columns={"a": "b", "b": "a"})])[["a", "b", "w"]]

    parts = placed.groupBy("block", "ta", "tb").applyInPandas(gram, schema=f"a {it}, b {it}, w bigint")
    return parts.groupBy("a", "b").agg(F.sum("w").alias("w")).where(F.col("w") != 0)


def shifted_ppmi(cooc: DataFrame, negative: int = 5, ns_exponent: float = 0.75) -> DataFrame:
    """(a, b, ppmi) = max(ln(P(a,b) / (P(a) P_alpha(b))) - ln(negative), 0), kept when > 0.

    P_alpha smooths the context distribution with ``ns_exponent`` (Levy et al. 2015).
    """
    row = cooc.groupBy("a").agg(F.sum("w").alias("ra"))
    col = cooc.groupBy("b").agg(F.sum("w").alias("cb"))
    total = cooc.select(F.sum("w")).scalar()
    smooth_total = col.select(F.sum(F.pow(F.col("cb"), ns_exponent))).scalar()
    j = cooc.join(row, "a").join(col, "b")
    pmi = F.log((F.col("w") / total) / ((F.col("ra") / total) * (F.pow(F.col("cb"), ns_exponent) / smooth_total)))
    val = pmi - F.lit(math.log(negative))
    return j.select("a", "b", val.alias("ppmi")).where(F.col("ppmi") > 0)


def svd_embeddings(ppmi: DataFrame, rank: int, key_col: str = "key") -> DataFrame:
    """E2(a): rows of U * sqrt(S) from the distributed truncated SVD of the PPMI matrix.

    Item ids are ranks of the item names (bounded by the vocabulary); the SVD
    is ``IndexedRowMatrix.computeSVD`` (the only RDD use in the library).
    """
    from pyspark.mllib.linalg import Vectors as MV
    from pyspark.mllib.linalg.distributed import IndexedRow, IndexedRowMatrix
    spark = ppmi.sparkSession
    items = (ppmi.select(F.col("a").alias("item")).union(ppmi.select(F.col("b").alias("item"))).distinct())
    # numbering over the distinct items only (bounded by the vocabulary)
    idx = items.select("item", (F.dense_rank().over(Window.orderBy("item")) - 1).alias("i"))
    m = idx.count()
    rows = (ppmi.join(idx.withColumnRenamed("item", "a").withColumnRenamed("i", "ia"), "a")
            .join(idx.withColumnRenamed("item", "b").withColumnRenamed("i", "ib"), "b")
            .groupBy("ia").agg(F.sort_array(F.collect_list(F.struct("ib", "ppmi"))).alias("e")))
    rdd = rows.rdd.map(lambda r: IndexedRow(r["ia"], MV.sparse(m, [x["ib"] for x in r["e"]],
                                                                [x["ppmi"] for x in r["e"]])))
    svd = IndexedRowMatrix(rdd, m, m).computeSVD(min(rank, max(1, m - 1)), computeU=True)
    scale = np.sqrt(np.asarray(svd.s.toArray()))
    u = svd.U.rows.map(lambda r: (int(r.index), [float(x) for x in (r.vector.toArray() * scale)]))
    vec = spark.createDataFrame(u, "i bigint, vector array<double>")
    return vec.join(idx, "i").select(F.col("item").alias(key_col), "vector")


def word2vec_embeddings(contexts: DataFrame, tokens_col: str, vector_size: int = 100,
                        window: int = 5, epochs: int = 5, alpha: float = 0.025, seed: int = 42,
                        min_count: int = 0, key_col: str = "key"):
    """E2(b): Spark ML Word2Vec (skip-gram, hierarchical softmax) over the contexts.

    ``window`` is the reference's longest-context window.  Returns
    (vectors DataFrame (key, vector array<double>), fitted model); contexts without a word that
    occurs ``min_count`` times give no vectors and no model.
    """
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array
    words = contexts.select(F.explode(tokens_col).alias("word"))
    if min_count > 1:
        words = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    if words.isEmpty():
        return contexts.sparkSession.createDataFrame([], f"{key_col} string, vector array<double>"), None
    w2v = Word2Vec(vectorSize=vector_size, windowSize=window, maxIter=epochs, stepSize=alpha,
                   seed=seed, minCount=min_count, inputCol=tokens_col, outputCol="_w2v",
                   numPartitions=1, maxSentenceLength=max(1000, window))
    model = w2v.fit(contexts)
    vecs = model.getVectors().select(F.col("word").alias(key_col),
                                     vector_to_array("vector").alias("vector"))
    return vecs, model


# --- E3, E5, E6 ----------------------------------------------------------------
def normalized(vectors: DataFrame, vec_col: str = "vector") -> DataFrame:
    """L2-normalized vectors (double precision)."""
    return vectors.withColumn(vec_col, V.normalize(V.as_doubles(vec_col)))


def nearest_neighbors(vectors: DataFrame, k: int = 10, key_col: str = "key", vec_col: str = "vector",
                      queries: DataFrame | None = None, block_rows: int = B.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """E5: cosine top-k per key (self excluded), ties by neighbour key.

    ``queries`` (a subset of keys) restricts the left side; an unknown key
    simply has no rows.  Output (key, neighbor, score, rank).
    """
    nv = normalized(vectors.select(key_col, vec_col), vec_col)
    left = nv if queries is None else nv.join(queries.select(key_col), key_col, "leftsemi")
    return B.topk(left, nv, k, key_col, key_col, vec_col, vec_col, exclude_self=True,
                  block_rows=block_rows)


def pairwise_cosine_distances(vectors: DataFrame, key_col: str = "key", vec_col: str = "vector",
                              block_rows: int = B.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """(a, b, distance = 1 - cos) for a < b."""
    nv = normalized(vectors.select(key_col, vec_col), vec_col)
    return B.pairwise(nv, key_col, vec_col, "cosine", block_rows).withColumnRenamed("value", "distance")


# --- J9, E7, E8, X13, X14: analogies ------------------------------------------------
def generate_analogies(pairs: DataFrame, section_col: str = "section", pos_col: str = "pos",
                       a_col: str = "a", b_col: str = "b") -> DataFrame:
    """Every (pair_i, pair_j), i < j, inside one section -> (section, a, b, c, d).

    The output is quadratic in the pairs of a section by definition; AQE
    splits a skewed section of the equi-join on ``section``.
    """
    p = pairs.select(section_col, pos_col, a_col, b_col)
    q = p.select(F.col(section_col), F.col(pos_col).alias("_qpos"), F.col(a_col).alias("c"),
                 F.col(b_col).alias("d"))
    return (p.join(q, section_col).where(F.col(pos_col) < F.col("_qpos"))
            .select(section_col, F.col(a_col).alias("a"), F.col(b_col).alias("b"), "c", "d",
                    F.col(pos_col).alias("pos_ab"), F.col("_qpos").alias("pos_cd")))


def read_analogy_pairs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Headerless two-column CSV files; the file is the section, the
    line number the position (kept explicitly, never by row order)."""
    raw = spark.read.schema("a string, b string").csv(paths, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    raw = raw.select("a", "b", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s"),
                     F.monotonically_increasing_id().alias("_id"))
    # the rows of a block are numbered in order; blocks of a file are ordered by their start
    order = Window.partitionBy("_f").orderBy("_s", "_id")
    return raw.select(F.regexp_extract("_f", r"([^/]+?)(\.[^./]*)?$", 1).alias("section"),
                      F.row_number().over(order).cast("bigint").alias("pos"), "a", "b")


def score_analogies(analogies: DataFrame, vectors: DataFrame, key_col: str = "key", vec_col: str = "vector",
                    case_insensitive: bool = False, block_rows: int = 8 * B.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Per analogy, the nearest key to b - a + c (unit vectors, cosine),
    excluding a, b and c; analogies with an unknown key are skipped.

    Returns (section, a, b, c, d, predicted, correct).
    """
    nv = normalized(vectors.select(F.col(key_col).alias("k"), F.col(vec_col).alias("v")), "v")
    an = analogies
    if case_insensitive:
        # one key per folded form: the smallest spelling
        nv = (nv.groupBy(F.upper("k").alias("_u")).agg(F.min_by("v", "k").alias("v")).select(F.col("_u").alias("k"), "v"))
        an = an.select("section", *[F.upper(c).alias(c) for c in ("a", "b", "c", "d")])
    # rows of one key are told apart by a number
    nv = cut_lineage(nv.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("v"))))
    ids = nv.select("k", "n")
    for c in ("a", "b", "c"):
        an = an.join(ids.withColumnsRenamed({"k": c, "n": f"n_{c}"}), c)
    an = an.join(ids.select(F.col("k").alias("d")), "d").select("section", "a", "b", "c", "d", "n_a", "n_b", "n_c")
    return _predicted(an, nv, block_rows)


CELL_ROWS = 1 << 17  # analogies of a task


def _predicted(an: DataFrame, nv: DataFrame, block_rows: int) -> DataFrame:
    """(section, a, b, c, d, predicted, correct) for analogies whose vectors are named by (key, n).

    Analogies are dealt into cells by (a, b) and by c, and a cell meets one block of candidates in a task: it is sent the
    keys of the analogies and each vector once, and forms b - a + c itself.
    """
    head = nv.agg(F.count(F.lit(1)).alias("n"), F.max("n").alias("most")).first()
    side = max(1, math.ceil(math.sqrt(an.count() / CELL_ROWS)))
    blocks = max(1, math.ceil(head["n"] / block_rows))
    kinds = {f.name: f.dataType.simpleString() for f in an.schema}
    cell = (F.pmod(F.xxhash64("a", "b"), F.lit(side)) * side + F.pmod(F.xxhash64("c"), F.lit(side))).cast("int")
    every = [F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<int>")) for m in (side * side, blocks)]
    dealt = an.withColumn("cell", cell)
    left = dealt.withColumn("block", every[1])
    right = nv.select(F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int").alias("block"), F.lit(True).alias("found"), "k", "n", "v").withColumn("cell", every[0])
    if blocks > 1:  # the analogies' own vectors, where they are no candidates
        own = None
        for c in ("a", "b", "c"):
            part = dealt.select("cell", F.col(c).alias("k"), F.col(f"n_{c}").alias("n"))
            own = part if own is None else own.unionByName(part)
        own = own.distinct().join(nv, ["k", "n"]).withColumn("found", F.lit(False)).withColumn("block", every[1])
        right = right.unionByName(own.where(F.col("block") != F.pmod(F.xxhash64("k"), F.lit(blocks))))
    right = right.select(F.col("cell").alias("rcell"), F.col("block").alias("rblock"), "found", "k", F.col("n"), "v")
    names = ["section", "a", "b", "c", "d"]

    def best(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        rp = rp.sort_values("k", kind="stable").reset_index(drop=True)
        out = lp[names].reset_index(drop=True)
        if not len(lp) or not len(rp):
            return out.assign(predicted=None, score=None).head(0)
        V = np.stack([np.asarray(v, np.float64) for v in rp["v"].to_numpy()])
        place = pd.MultiIndex.from_arrays([rp["k"], rp["n"]])
        ia, ib, ic = (place.get_indexer(pd.MultiIndex.from_arrays([lp[c], lp[f"n_{c}"]])) for c in ("a", "b", "c"))
        found = rp["found"].to_numpy()
        keys, K = rp["k"].to_numpy()[found], V[found]
        at, score = np.full(len(lp), -1), np.full(len(lp), -np.inf)
        step = max(1, B.STRIP // max(1, len(K)))
        for s in range(0, len(lp) if len(K) else 0, step):
            e = min(len(lp), s + step)
            S = (V[ib[s:e]] - V[ia[s:e]] + V[ic[s:e]]) @ K.T
            for c in ("a", "b", "c"):
                own = lp[c].to_numpy()[s:e]
                first, last = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
                for more in range(int((last - first).max())):
                    row = np.flatnonzero(first + more < last)
                    S[row, first[row] + more] = -np.inf
            at[s:e] = S.argmax(axis=1)  # the first of equal ones has the smallest key
            score[s:e] = S[np.arange(e - s), at[s:e]]
        some = np.isfinite(score)
        got = keys[np.where(some, at, 0)] if len(keys) else np.full(len(lp), None)
        out["predicted"] = pd.arrays.IntegerArray(got.astype(np.int64), ~some) if got.dtype.kind == "i" else np.where(some, got, None)
        out["score"] = np.where(some, score, -np.inf)
        return out

    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + f", predicted {kinds['a']}, score double"
    found = left.groupBy("cell", "block").cogroup(right.groupBy("rcell", "rblock")).applyInPandas(best, schema)
    if blocks > 1 or (head["most"] or 1) > 1:
        order = F.when(F.col("predicted").isNotNull(), F.struct((-F.col("score")).alias("s"), F.col("predicted").alias("p")))
        found = (found.groupBy(*names).agg(F.min_by("predicted", order).alias("predicted"), (F.count(F.lit(1)) / blocks).cast("int").alias("times"))
                 .withColumn("_", F.explode(F.sequence(F.lit(1), F.col("times")))))
    return found.select(*names, "predicted", F.coalesce(F.col("predicted") == F.col("d"), F.lit(False)).alias("correct"))


def analogy_accuracy(scored: DataFrame) -> DataFrame:
    """Accuracy per section (section, correct, total, accuracy)."""
    return scored.groupBy("section").agg(F.sum(F.col("correct").cast("bigint")).alias("correct"),
                                         F.count(F.lit(1)).alias("total")).withColumn(
        "accuracy", F.col("correct") / F.col("total"))


def detailed_accuracy_string(per_section: DataFrame) -> DataFrame:
    """One row: overall accuracy and ``section:correct/total,...`` in section order."""
    item = F.format_string("%s:%d/%d", F.col("section").cast("string"), F.col("correct"), F.col("total"))
    return per_section.agg(
        (F.sum("correct") / F.sum("total")).alias("accuracy"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("section").cast("string").alias("s"),
                                                                        item.alias("x")))),
                                 lambda z: z["x"]), ",").alias("detailed_accuracy"))


def parse_detailed_accuracy(df: DataFrame, col: str = "detailed_accuracy") -> DataFrame:
    """``section:correct/total,...`` -> (section, correct, total) rows."""
    item = F.explode(F.split(F.col(col), ",")).alias("_it")
    pat = r"^(.*):(\d+)/(\d+)$"
    return df.select(item).select(
        F.regexp_extract("_it", pat, 1).alias("section"),
        F.regexp_extract("_it", pat, 2).cast("bigint").alias("correct"),
        F.regexp_extract("_it", pat, 3).cast("bigint").alias("total"))


# --- E12: projection -----------------------------------------------------------------
def pca_projection(vectors: DataFrame, k: int = 2, key_col: str = "key", vec_col: str = "vector",
                   prefix: str = "dim") -> DataFrame:
    """E12 (re-aimed t-SNE table): PCA of the normalized vectors -> (key, dim_1..dim_k)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    nv = normalized(vectors.select(key_col, vec_col), vec_col).withColumn("_v", array_to_vector(vec_col))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(nv)
    out = model.transform(nv).withColumn("_p", vector_to_array("_p"))
    return out.select(key_col, *[F.col("_p")[i].alias(f"{prefix}_{i + 1}") for i in range(k)])


# --- E10: grid search ---------------------------------------------------------------------


def model_id(params: dict) -> str:
    """Sorted camel-case keys followed by values, e.g. ``alpha0.02_sample0.002_vectorSize25``."""
    named = {re.sub("_+([a-z0-9])", lambda m: m[1].upper(), k): v for k, v in params.items()}
    return "_".join(f"{k}{named[k]}" for k in sorted(named))


def expand_grid(grid: dict) -> list[dict]:
    keys = list(grid)
    return [dict(zip(keys, vals)) for vals in itertools.product(*[grid[k] for k in keys])]


def context_pairs(contexts: DataFrame, tokens_col: str, **kw) -> DataFrame:
    """E1 over contexts given as token arrays: every context is a user."""
    rows = cut_lineage(contexts.select(F.monotonically_increasing_id().alias("u"), F.col(tokens_col).alias("t")))
    return cooccurrence(rows.select("u", F.explode("t").alias("i")), "u", "i", **kw)


#: What a result row says about a model besides the grid's own parameters (fixed values: the trainer's defaults).
TRAINER_DEFAULTS = {"epochs": 5, "vector_size": 150, "negative": 20, "ns_exponent": 0.75, "alpha": 0.025, "min_alpha": 0.0001,
                    "seed": 1, "batch_words": 10000, "sample": 0.0}
RESULT_COLUMNS = ("model_id string, contexts_path string, accuracy double, detailed_accuracy string, num_users bigint, "
                  "max_comments bigint, epochs int, vector_size int, skip_gram int, hierarchical_softmax int, negative int, "
                  "ns_exponent double, alpha double, min_alpha double, seed bigint, batch_words int, sample double")


def grid_search(contexts: DataFrame, tokens_col: str, analogies: DataFrame, grid: dict,
                fixed: dict | None = None, keep_all: bool = False, case_insensitive: bool = False,
                trainer: str = "word2vec", contexts_path: str = ""):
    """Train one model per grid point, score analogies, keep the best
    (ties go to the later model).

    ``trainer`` is ``"sgns"`` (negative sampling in many tasks, over one co-occurrence table for the
    whole grid) or ``"word2vec"`` (Spark ML, hierarchical softmax, one task per fit).  Returns (results, best vectors,
    best model id); a result row holds the 17 ``RESULT_COLUMNS``.  With ``keep_all`` the vectors of every model come
    as a fourth value, by model id.
    """
    from tribewise.operators import sgns
    if trainer not in ("sgns", "word2vec"):
        raise ValueError(f"unknown trainer {trainer!r}")
    spark = contexts.sparkSession
    contexts = cut_lineage(contexts.select(tokens_col))
    head = contexts.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(tokens_col)).alias("m")).first()
    pairs = cut_lineage(context_pairs(contexts, tokens_col)) if trainer == "sgns" else None
    counts = contexts.select(F.explode(tokens_col).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    rows, best, best_vecs, kept = [], None, None, {}
    for params in expand_grid(grid):
        kw = {**(fixed or {}), **params}
        if trainer == "sgns":
            names = ("vector_size", "negative", "sample", "alpha", "min_alpha", "epochs", "seed", "ns_exponent", "passes", "batch", "block_items")
            vecs = sgns.train(pairs, counts=counts, **{k: v for k, v in kw.items() if k in names})
        else:
            names = ("vector_size", "window", "epochs", "alpha", "seed", "min_count")
            vecs, _ = word2vec_embeddings(contexts, tokens_col, **{k: v for k, v in kw.items() if k in names})
        vecs = cut_lineage(vecs)
        rep = detailed_accuracy_string(analogy_accuracy(score_analogies(analogies, vecs, case_insensitive=case_insensitive))).first()
        acc = float(rep["accuracy"]) if rep["accuracy"] is not None else 0.0
        mid = model_id(params)
        said = {**TRAINER_DEFAULTS, **kw}
        own = trainer == "sgns"
        rows.append((mid, contexts_path, acc, rep["detailed_accuracy"] or "", head["n"], head["m"] or 0, said["epochs"], said["vector_size"], 1,
                     int(not own), int(said["negative"]) if own else 0, float(said["ns_exponent"]), float(said["alpha"]),
                     float(said["min_alpha"]), said["seed"], said["batch_words"], float(said["sample"]) if own else 0.0))
        if best is None or acc >= best[1]:
            if not keep_all:
                drop_state(best_vecs)
            best, best_vecs = (mid, acc), vecs
        elif not keep_all:
            drop_state(vecs)
        if keep_all:
            kept[mid] = vecs
    out = spark.createDataFrame(rows, RESULT_COLUMNS), best_vecs, best[0] if best else None
    return (*out, kept) if keep_all else out


_SECTION_RE = re.compile(r"^(.*):(\d+)/(\d+)$")


def parse_detailed_accuracy_local(text: str) -> list[tuple[str, int, int]]:
    """X14 for a single string (driver-side helper for reports)."""
    out = []
    for part in text.split(","):
        m = _SECTION_RE.match(part)
        if m:
            out.append((m.group(1), int(m.group(2)), int(m.group(3))))
    return out
