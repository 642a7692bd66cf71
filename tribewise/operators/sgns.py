"""Skip-gram with negative sampling, trained in many tasks.

The window of a community context is the whole context, so the training pairs are the
co-occurrence counts (E1) and the loss can be written on them: a pair (a, b) seen w times adds
w ln s(u_a . v_b), and each centre a with W_a pairs adds ``negative`` W_a times the mean of
ln s(-u_a . v_b) over the noise distribution (counts to the power ``ns_exponent``).  ``sample`` thins frequent
items by the usual rate; its expected effect is a factor per item on the counts.

Items are hashed into blocks of about ``block_items``.  Each block has one row with its
centre vectors and one with its context vectors; the pairs lie in cells (centre block, context
block).  A mini-epoch joins the cells of one diagonal (every centre block and every context block
appears once) to both tables and trains each cell in a task of its own: no two tasks touch
the same vectors, so nothing has to be merged and the result does not depend on timing.  Once every diagonal
has had its turn, an epoch is done.  A cell is at most ``block_items`` squared numbers.
Steps are AdaGrad steps over ``batch`` centres at a time, ``passes`` times per visit; ``alpha`` falls to
``min_alpha`` in a straight line.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tribewise.session import cut_lineage, drop_state

_STATE = "block int, centre boolean, vectors binary, squares binary"


def keep_rates(counts: DataFrame, sample: float, item_col: str = "item", n_col: str = "n") -> DataFrame:
    """(item, keep): the share of an item's occurrences that down-sampling keeps, 1 for ``sample`` = 0."""
    if not sample:
        return counts.select(F.col(item_col).alias("item"), F.lit(1.0).alias("keep"))
    ratio = F.lit(float(sample)) / (F.col(n_col) / counts.select(F.sum(n_col)).scalar())
    return counts.select(F.col(item_col).alias("item"), F.least(F.sqrt(ratio) + ratio, F.lit(1.0)).alias("keep"))


def _cells(pairs: DataFrame, items: DataFrame, blocks: int) -> DataFrame:
    """(p, q, ia, ib, w): the pairs of each cell as packed arrays; every cell has a row."""
    a = items.select(F.col("item").alias("a"), F.col("block").alias("p"), F.col("place").alias("ia"))
    b = items.select(F.col("item").alias("b"), F.col("block").alias("q"), F.col("place").alias("ib"))
    placed = pairs.join(a, "a").join(b, "b").select("p", "q", "ia", "ib", "w")

    def pack(table: pa.Table) -> pa.Table:
        column = {n: [table.column(n).to_numpy().astype(t).tobytes()] for n, t in (("ia", "<i4"), ("ib", "<i4"), ("w", "<f8"))}
        return pa.table({"p": table.column("p").slice(0, 1), "q": table.column("q").slice(0, 1), **column})

    schema = "p int, q int, ia binary, ib binary, w binary"
    packed = placed.groupBy("p", "q").applyInArrow(pack, schema)
    spark = pairs.sparkSession
    every = spark.range(blocks * blocks).select((F.col("id") / blocks).cast("int").alias("p"), (F.col("id") % blocks).cast("int").alias("q"))
    return every.join(packed, ["p", "q"], "left")


def _train(rows: pa.RecordBatch, dim: int, negative: float, scale: float, alpha: float, passes: int, batch: int):
    """One visit of each cell in ``rows``: updated centre and context rows."""
    out = []
    for row in rows.to_pylist():
        def matrix(name):
            return np.frombuffer(row[name], np.float64).reshape(-1, dim).copy()
        U, V, gu, gv = matrix("u"), matrix("v"), matrix("gu"), matrix("gv")
        mass, noise = np.array(row["mass"], np.float64), np.array(row["noise"], np.float64)
        seen = np.zeros((len(U), len(V)))
        if row["w"] is not None:
            np.add.at(seen, (np.frombuffer(row["ia"], "<i4"), np.frombuffer(row["ib"], "<i4")), np.frombuffer(row["w"], "<f8"))
        seen *= scale
        missed = negative * scale * mass[:, None] * noise[None, :]
        for _ in range(passes):
            for s in range(0, len(U), batch):
                near = 1.0 / (1.0 + np.exp(-np.clip(U[s:s + batch] @ V.T, -30, 30)))
                g = seen[s:s + batch] * (1.0 - near) - missed[s:s + batch] * near
                du, dv = g @ V, g.T @ U[s:s + batch]
                gu[s:s + batch] += du * du
                gv += dv * dv
                U[s:s + batch] += alpha * du / np.sqrt(gu[s:s + batch] + 1e-12)
                V += alpha * dv / np.sqrt(gv + 1e-12)
        out.append((row["p"], True, U.tobytes(), gu.tobytes()))
        out.append((row["q"], False, V.tobytes(), gv.tobytes()))
    return out


def train(cooc: DataFrame, vector_size: int = 150, negative: float = 20, sample: float = 0.0, alpha: float = 0.4,
          min_alpha: float = 0.0001, epochs: int = 10, seed: int = 1, ns_exponent: float = 0.75, counts: DataFrame | None = None,
          block_items: int = 1024, passes: int = 16, batch: int = 128, key_col: str = "key") -> DataFrame:
    """(key, vector array<double>) from co-occurrence counts (a, b, w).

    ``counts`` (item, n) is needed only for ``sample`` > 0.  An empty table gives no vectors.
    The number of blocks, and so of tasks, follows from the number of items alone.
    """
    spark = cooc.sparkSession
    kind = cooc.schema["a"].dataType.simpleString()
    pairs = cooc.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.col("w").cast("double").alias("w"))
    if sample:
        if counts is None:
            raise ValueError("down-sampling needs the items' counts")
        rate = keep_rates(counts.select(F.col("item").cast("string").alias("item"), "n"), sample)
        pairs = (pairs.join(rate.withColumnsRenamed({"item": "a", "keep": "ka"}), "a").join(rate.withColumnsRenamed({"item": "b", "keep": "kb"}), "b")
                 .select("a", "b", (F.col("w") * F.col("ka") * F.col("kb")).alias("w")))
    pairs = cut_lineage(pairs)
    mass = pairs.groupBy(F.col("a").alias("item")).agg(F.sum("w").alias("mass")).unionByName(
        pairs.select(F.col("b").alias("item")).distinct().withColumn("mass", F.lit(0.0))).groupBy("item").agg(F.sum("mass").alias("mass"))
    noise = pairs.groupBy(F.col("b").alias("item")).agg(F.pow(F.sum("w"), F.lit(ns_exponent)).alias("noise"))
    items = cut_lineage(mass.join(noise, "item", "left").na.fill(0.0, ["noise"]))
    head = items.agg(F.count(F.lit(1)).alias("n"), F.sum("mass").alias("w"), F.sum("noise").alias("z")).first()
    if not head["n"]:
        return spark.createDataFrame([], f"{key_col} {kind}, vector array<double>")
    blocks = math.ceil(head["n"] / block_items)
    packed = (items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")).groupBy("block")
              .agg(F.sort_array(F.collect_list(F.struct("item", "mass", "noise"))).alias("rows")))  # about block_items rows each
    packed = cut_lineage(packed)
    placed = packed.select("block", F.posexplode("rows").alias("place", "row")).select(F.col("row.item").alias("item"), "block", "place")
    cells = cut_lineage(_cells(pairs, placed, blocks))
    drop_state(pairs)
    scale, total = head["n"] / head["w"], head["z"]

    sides = pa.schema([("block", pa.int32()), ("centre", pa.bool_()), ("vectors", pa.binary()), ("squares", pa.binary())])

    def begin(batches):
        for table in batches:
            for row in table.to_pylist():
                shape = len(row["rows"]), vector_size
                start = np.random.default_rng([seed, row["block"]]).uniform(-0.5, 0.5, shape) / vector_size
                zero = np.zeros(shape).tobytes()
                yield pa.RecordBatch.from_pylist([{"block": row["block"], "centre": True, "vectors": start.tobytes(), "squares": zero},
                                                  {"block": row["block"], "centre": False, "vectors": zero, "squares": zero}], sides)

    state = cut_lineage(packed.mapInArrow(begin, _STATE))
    weights = packed.select("block", F.col("rows.mass").alias("mass"), F.transform("rows.noise", lambda x: x / total).alias("noise"))
    steps = epochs * blocks
    for step in range(steps):
        rate = alpha + (min_alpha - alpha) * step / max(1, steps - 1)
        diagonal = cells.where(F.col("q") == (F.col("p") + step) % blocks)
        u = state.where("centre").select(F.col("block").alias("p"), F.col("vectors").alias("u"), F.col("squares").alias("gu"))
        v = state.where("not centre").select(F.col("block").alias("q"), F.col("vectors").alias("v"), F.col("squares").alias("gv"))
        turn = (diagonal.join(u, "p").join(v, "q").join(weights.select(F.col("block").alias("p"), "mass"), "p")
                .join(weights.select(F.col("block").alias("q"), "noise"), "q"))

        def visit(batches, rate=rate):
            for table in batches:
                done = _train(table, vector_size, negative, scale, rate, passes, batch)
                if done:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), sides)], schema=sides)

        # one cell per task: the adaptive plan does not merge the partitions of an explicit number
        nxt = cut_lineage(turn.repartitionByRange(blocks, "p").mapInArrow(visit, _STATE))
        drop_state(state)
        state = nxt
    out = state.where("centre").join(packed.select("block", F.col("rows.item").alias("keys")), "block").select("keys", "vectors")

    def rows(batches):
        for table in batches:
            for row in table.to_pylist():
                vectors = np.frombuffer(row["vectors"], np.float64)
                lists = pa.ListArray.from_arrays(np.arange(0, len(vectors) + 1, vector_size, dtype=np.int32), pa.array(vectors))
                yield pa.RecordBatch.from_arrays([pa.array(row["keys"], pa.string()), lists], ["key", "vector"])

    found = out.mapInArrow(rows, "key string, vector array<double>")
    return found.select(F.col("key").cast(kind).alias(key_col), "vector")
