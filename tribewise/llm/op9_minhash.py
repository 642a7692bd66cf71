"""MinHash near-dedup: banded signatures, verified links, star-contracted components.

A document is the set of its distinct word shingles (64-bit hashes).  Documents
with equal sets form a class and are handled once.  ``rows`` x ``bands`` minima
of universal hash functions give the bands; classes that share a band are in
one bucket.

Within a bucket nothing is paired with everything.  The smallest class is
compared with the others first, then, where members are still in several components, the one
that shares most of its shingles.  What is still torn is settled all at once by an exact
prefix filter over the full sets (``_across``): only pairs of different components that can
still reach the limit are formed.  A comparison first asks the signatures, then confirms on the full
sets.

Components come from alternating large-star and small-star steps over the
links.  Steps write small tables; only counts reach the driver.

Cases: A-Z are lower-cased; a document with fewer words than a shingle is one
shingle, one without words (or null) has none and links with nothing; repeated
rows share a class and a component; rows with a null key take part, but never
name a component that has another key; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free, text_key, text_or_empty, text_runs, written
from .words import U, mix, run_sums, runs, words_of

SHINGLE, ROWS, BANDS, PERCENT = 2, 4, 32, 80
_BASE = 0xD1342543DE82EF95  # a fixed odd number
#: A pair is confirmed on full sets unless its signatures agree this much less than the limit (six deviations).
SLACK = 0.22
#: How often shingles that only hopeless sets share are taken out before pairs are formed.
ROUNDS = 2


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of n hash functions x -> (a x + b) >> 32, universal for 32-bit x."""
    rng = np.random.Generator(np.random.PCG64(5))
    return tuple(rng.integers(0, 1 << 63, n, dtype=np.int64).astype(U) * U(2) + U(1) for _ in range(2))


def shingle_sets(texts, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text of an Arrow array."""
    hashes, _, _, first, _, _ = words_of(texts, fold=True)
    sums, out = run_sums(hashes, _BASE), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            at = np.arange(a, b - words + 1)
            out.append(np.unique(runs(sums, at, at + words)))
        else:
            out.append(runs(sums, np.array([a]), np.array([b])) if b > a else np.empty(0, U))
    return out


def _signatures(sets: list[np.ndarray], n_functions: int) -> np.ndarray:
    """One row of minima per set (zeros for an empty one)."""
    size = np.array([len(s) for s in sets])
    some = np.flatnonzero(size)
    out = np.zeros((len(sets), n_functions), np.uint32)
    if len(some):
        x, at = np.concatenate(sets) >> U(32), (np.cumsum(size) - size)[some]
        for k, (a, b) in enumerate(zip(*_functions(n_functions))):
            value = x * a
            value += b
            value >>= U(32)
            out[some, k] = np.minimum.reduceat(value, at)
    return out


def _set_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name a set."""
    pairs = [(mix(s).sum(dtype=U), mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U)) for s in sets]
    return tuple(np.array([p[k] for p in pairs], U).view(np.int64) for k in (0, 1))


def sketches(docs: DataFrame, key: str, text_col: str, words: int, rows: int, bands: int) -> DataFrame:
    """Per row of ``docs``: key, text key, set size, set key and band hashes."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for a, b in text_runs(batch, "text", 1 << 18):
                part = batch.slice(a, b - a)
                sets = shingle_sets(part.column("text"), words)
                minima = _signatures(sets, rows * bands).astype(U).reshape(len(sets), bands, rows)
                band = np.broadcast_to(np.arange(bands, dtype=U), (len(sets), bands)).copy()
                for k in range(rows):
                    band = mix(band * U(31) + minima[:, :, k] + U(1))
                s1, s2 = _set_keys(sets)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), part.column("h1"), part.column("h2"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(s1), pa.array(s2), pa.array(list(band.view(np.int64)), pa.list_(pa.int64()))],
                    names=["doc", "h1", "h2", "n", "s1", "s2", "bands"])

    source = docs.select(F.col(key).cast("long").alias("doc"), *text_key(text_col), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, "doc long, h1 long, h2 long, n long, s1 long, s2 long, bands array<long>")


def _full_sets(docs: DataFrame, wanted: DataFrame, text_col: str, words: int, n_functions: int) -> DataFrame:
    """node, its full set and signature; ``wanted`` has node and the key of one of its texts."""
    texts = docs.select(*text_key(text_col), text_or_empty(text_col).alias("text")).groupBy("h1", "h2").agg(
        F.min("text").alias("text"))

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for a, b in text_runs(batch, "text", 1 << 18):
                part = batch.slice(a, b - a)
                sets = shingle_sets(part.column("text"), words)
                signs = _signatures(sets, n_functions)
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), pa.array([s.tobytes() for s in sets], pa.binary()),
                     pa.array([s.tobytes() for s in signs], pa.binary())], names=["node", "full", "sign"])

    return texts.join(wanted, ["h1", "h2"]).select("node", "text").mapInArrow(run, "node long, full binary, sign binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the limit."""
    one = pairs.join(sets.select(F.col("node").alias("b"), F.col("full").alias("fb"), F.col("sign").alias("sb")), "b")
    both = one.join(sets.select(F.col("node").alias("a"), F.col("full").alias("fa"), F.col("sign").alias("sa")), "a")
    least = percent / 100 - SLACK

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            good = []
            for fa, fb, sa, sb in zip(*(batch.column(c) for c in ("fa", "fb", "sa", "sb"))):
                same = np.frombuffer(sa.as_buffer(), np.uint32) == np.frombuffer(sb.as_buffer(), np.uint32)
                if same.mean() < least:
                    good.append(False)
                    continue
                x, y = np.frombuffer(fa.as_buffer(), U), np.frombuffer(fb.as_buffer(), U)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _shingles_of(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(s, node, n, comp): the full sets of ``nodes``, a row per shingle."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for i in range(batch.num_rows):
                s = np.frombuffer(batch.column("full")[i].as_buffer(), np.int64)
                same = [pa.array(np.full(len(s), batch.column(c)[i].as_py(), np.int64)) for c in ("node", "n", "comp")]
                yield pa.RecordBatch.from_arrays([pa.array(s), *same], ["s", "node", "n", "comp"])

    return (nodes.join(sets.select("node", "full"), "node").select("node", "n", "comp", "full")
            .mapInArrow(run, "s long, node long, n long, comp long"))


def _able(nodes: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Which of ``nodes`` (node, n, comp) can reach the limit with a node of another component: (node, k), and their
    shared shingles (s, node, n, comp, f, k).

    A shingle that only one component holds is no help for a link to another.  A node needs ``percent`` % of its shingles
    (``k`` of them) among the others, or it is out, and its shingles with it, round by round.  ``f`` nodes hold a shingle.
    """
    held = written(_shingles_of(nodes, sets), "shingles")
    for _ in range(ROUNDS):
        about = written(held.groupBy("s").agg(F.count(F.lit(1)).alias("f"), F.min("comp").alias("x"), F.max("comp").alias("y"))
                        .filter("x != y").select("s", "f"), "frequencies")
        common = held.join(about, "s")
        able = written(common.groupBy("node").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n"))
                       .filter(F.col("k") * 100 >= F.col("n") * percent).select("node", "k"), "able")
        kept = written(common.join(able, "node").select("s", "node", "n", "comp", "f", "k"), "shingles")
        free(held)
        held = kept.select("s", "node", "n", "comp")
    return able, kept


def _central(members: DataFrame, nodes: DataFrame, able: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b): each bucket's node with the largest share of shingles among the others, with the members of other components."""
    rows = written(members.select("bucket", "node").join(nodes, "node").join(able, "node"), "central")
    best = rows.groupBy("bucket").agg(F.max_by(F.struct("node", "n", "k", "comp"), F.struct(F.col("k") / F.col("n"), -F.col("node"))).alias("x"))
    both = rows.join(best, "bucket").filter(
        (F.col("comp") != F.col("x.comp")) & (F.least("k", "x.k") * (100 + percent) >= (F.col("n") + F.col("x.n")) * percent))
    return both.select(F.least("node", "x.node").alias("a"), F.greatest("node", "x.node").alias("b")).distinct()


def _across(kept: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may reach the limit; no other can.  ``kept`` comes from ``_able``.

    Two sets that reach the limit share so many shingles that, with each set's own shingles first and the shared
    ones from rare to frequent, the first common one lies within the first n - percent n / 100 + 1
    of each, and what follows it can still make up the overlap.
    """
    order = F.sort_array(F.collect_list(F.struct("f", "s")))
    first = F.col("k") - F.ceil(F.col("n") * percent / 100) + 1  # of the shared shingles
    lists = (kept.groupBy("node").agg(F.min("n").alias("n"), F.min("comp").alias("comp"), F.min("k").alias("k"), order.alias("o"))
             .withColumn("o", F.slice("o", F.lit(1), F.greatest(first, F.lit(0)).cast("int"))))
    prefix = written(lists.select("node", "n", "comp", "k", F.posexplode("o").alias("i", "e"))
                     .select(F.col("e.s").alias("s"), "node", "n", "comp", (F.col("k") - F.col("i")).alias("left")), "prefixes")
    other = prefix.select("s", F.col("node").alias("o"), F.col("n").alias("m"), F.col("comp").alias("oc"), F.col("left").alias("oleft"))
    enough = F.least("left", "oleft") * (100 + percent) >= (F.col("n") + F.col("m")) * percent
    return (prefix.join(other, "s").filter((F.col("node") < F.col("o")) & (F.col("comp") != F.col("oc")) & enough)
            .select(F.col("node").alias("a"), F.col("o").alias("b")).distinct())


# ------------------------------------------------------------------ components

def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung on the smallest of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is hung on the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node it reaches) for every node of the links (a, b)."""
    def name(e: DataFrame):  # tells two sets of links apart
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = written(_small_star(edges.filter("a != b")), "star")
    before, last = name(now), None
    while before != last and before[0]:
        after = written(_small_star(_large_star(now)), "star")
        free(now)
        now, last, before = after, before, name(after)
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("comp"))).distinct()


# ------------------------------------------------------------------- the whole

def near_duplicates(docs: DataFrame, key: str = "doc_id", text_col: str = "text", words: int = SHINGLE, rows: int = ROWS,
                    bands: int = BANDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id, kept, and what names its set, component and text."""
    sketch = written(sketches(docs, key, text_col, words, rows, bands), "sketches")
    classes = written(
        sketch.filter("n > 0").groupBy("s1", "s2").agg(
            F.min("doc").alias("doc"), F.max("n").alias("n"), F.min(F.struct("h1", "h2")).alias("text"), F.min("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()), "classes")
    every = classes.select("node", "n", F.explode("bands").alias("bucket"))
    # leaders are written before they are joined, so that hot buckets can be split
    shared = written(every.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("leader"))
                     .filter("c > 1").select("bucket", "leader"), "shared")
    members = written(every.join(shared, "bucket"), "buckets")
    wanted = members.select("node").distinct().join(classes.select("node", "text.h1", "text.h2"), "node")
    sets = written(_full_sets(docs, wanted, text_col, words, rows * bands), "sets")

    def close(x: str, y: str):  # sizes that can reach the limit at all
        return F.least(x, y) * 100 >= F.greatest(x, y) * percent

    sizes = classes.select(F.col("node").alias("leader"), F.col("n").alias("m"))
    first = (members.filter("node != leader").select("leader", "node", "n").distinct().join(sizes, "leader")
             .filter(close("n", "m")).select(F.col("leader").alias("a"), F.col("node").alias("b")))
    tried = written(first, "pairs")
    links = written(_confirmed(tried, sets, percent), "links")
    for last in (False, True):
        comp = written(components(links), "components")
        live = members.select("bucket", "node", "n").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        torn = live.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x != y").select("bucket")
        live = written(live.join(torn, "bucket"), "torn")
        nodes = live.select("node", "n", "comp").distinct()
        able, kept = _able(nodes, sets, percent)
        fresh = _across(kept, percent) if last else _central(live, nodes, able, percent)
        fresh = written(fresh.join(tried, ["a", "b"], "left_anti"), "pairs")
        links = links.unionByName(written(_confirmed(fresh, sets, percent), "links"))
        tried = tried.unionByName(fresh)
        members = live.select("bucket", "node", "n").join(able, "node", "leftsemi")
    comp = components(links)
    named = classes.select("s1", "s2", "node", "doc").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    names = named.groupBy("comp").agg(F.min("doc").alias("component_id"))
    of_class = named.join(names, "comp").select("s1", "s2", F.col("node").alias("class"), "comp", "component_id")
    out = sketch.select("doc", "h1", "h2", "n", "s1", "s2").join(of_class, ["s1", "s2"], "left")
    component = F.when(F.col("n") == 0, F.col("doc")).otherwise(F.col("component_id"))
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("doc") == component, F.lit(False)).alias("kept"), "class", "comp", "h1", "h2")


def one_of_each(docs: DataFrame, key: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest key; rows without words all stay."""
    found = near_duplicates(docs.select(F.col(key).alias("doc"), F.col(text_col).alias("text")), "doc", "text", **options)
    names = [F.col("doc").alias("_nd_k"), F.col("h1").alias("_nd_h1"), F.col("h2").alias("_nd_h2")]
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "h1", "h2"))
    chosen = (found.filter("n_shingles > 0").groupBy("comp").agg(first.alias("x")).select("x.doc", "x.h1", "x.h2")
              .select(*names, F.lit(False).alias("_nd_empty")))
    empty = found.filter("n_shingles = 0").select(*names, F.lit(True).alias("_nd_empty")).distinct()
    h1, h2 = text_key(text_col)
    both = docs.withColumns({"_nd_a": h1, "_nd_b": h2}).join(
        chosen.unionByName(empty), F.col(key).eqNullSafe(F.col("_nd_k")) & (F.col("_nd_a") == F.col("_nd_h1"))
        & (F.col("_nd_b") == F.col("_nd_h2")))
    turn = F.row_number().over(Window.partitionBy("_nd_a", "_nd_b", key).orderBy(F.lit(1)))
    return both.withColumn("_nd_turn", turn).filter("_nd_empty or _nd_turn = 1").select(*docs.columns)
