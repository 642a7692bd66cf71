"""Substring dedup by seed and extend, over words of whole texts.

Seeds.  Of the hashes of ``seed`` consecutive words inside each window of
``window`` words, the smallest is the window's anchor.  A window's anchor
depends on its words alone, so equal windows have equal anchors at equal
places, and each run of consecutive windows with one anchor (its occurrence)
is one row: some 7 rows per 100 words.

Extend.  Occurrences are joined on their anchors.  An occurrence's context is
all words of its run of windows, so occurrences with equal contexts match over
their full extent both ways and form a class, settled by its size alone.  Only
where an anchor has several classes is the maximal match between them sought
window by window, once per class and not per copy.  No pair of occurrences is
ever built.

A window is a repeat if its words start at another place too, in the same
document or any other; words under a repeat are removed.  Equal texts are
handled once and share their result.

Cases: null text has no words; texts shorter than a window lose nothing;
repeated rows are copies of each other, so their windows repeat; a word of any
length is one word; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, text_key, text_or_empty, text_runs, written
from .words import run_sums, runs, window_argmin, words_of

WINDOW, SEED = 35, 8
_BASE, _WIDE = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5  # fixed odd numbers
OCCURRENCE = "h1 long, h2 long, lo int, n int, anchor long, ctx long"


def _occurrences(texts, window: int, seed: int):
    """(row, first window, windows, anchor, context) of each run of windows with one anchor."""
    hashes, _, _, first, _, _ = words_of(texts)
    if len(hashes) < window:
        return None
    sums, wide = run_sums(hashes, _BASE), run_sums(hashes, _WIDE)
    at = np.arange(len(hashes) - seed + 1)
    seeds = runs(sums, at, at + seed)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start = np.arange(len(hashes) - window + 1)
    inside = first[row[:len(start)] + 1] >= start + window
    anchor = window_argmin(seeds, window - seed + 1)[inside]
    start = start[inside]
    if not len(start):
        return None
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    b = np.flatnonzero(new)
    lo, count = start[b], np.diff(np.append(b, len(start)))
    return row[lo], lo - first[row[lo]], count, seeds[anchor[b]].view(np.int64), runs(wide, lo, lo + count - 1 + window).view(np.int64)


def occurrences(docs: DataFrame, text_col: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Anchors of all texts with the key of the text, the first window, their number and the context's hash."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for a, b in text_runs(batch, "text"):
                part = batch.slice(a, b - a)
                got = _occurrences(part.column("text"), window, seed)
                if got is None:
                    continue
                row, lo, n, anchor, ctx = got
                yield pa.RecordBatch.from_arrays(
                    [part.column("h1").take(pa.array(row)), part.column("h2").take(pa.array(row)),
                     pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(anchor), pa.array(ctx)],
                    names=["h1", "h2", "lo", "n", "anchor", "ctx"])

    return docs.select(*text_key(text_col), text_or_empty(text_col).alias("text")).mapInArrow(run, OCCURRENCE)


def _settled(docs: DataFrame, text_col: str, window: int, seed: int) -> DataFrame:
    """Per text: ``full`` (packed runs of windows that repeat) and ``open`` (runs still to be compared)."""
    every = occurrences(docs, text_col, window, seed)
    # counts are written first: a join of two plain exchanges can be split where an anchor is hot
    shared = written(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.min("ctx").alias("a"), F.max("ctx").alias("b"))
                     .filter("c > 1").select("anchor", (F.col("a") != F.col("b")).alias("several")), "shared")
    found = written(every.join(shared, "anchor"), "anchors")
    mixed = found.filter("several")
    classes = written(mixed.groupBy("anchor", "ctx").agg(F.count(F.lit(1)).alias("size"), F.min("h1").alias("leader")), "classes")
    sorted_out = (mixed.join(classes, ["anchor", "ctx"])
                  .unionByName(found.filter("not several").withColumns({"size": F.lit(2).cast("long"), "leader": F.lit(None).cast("long")})))
    whole = F.col("size") > 1
    spoken_for = F.coalesce(F.col("several") & (~whole | (F.col("h1") == F.col("leader"))), F.lit(False))
    per_text = sorted_out.groupBy("h1", "h2").agg(
        F.collect_set(F.when(whole, F.col("lo").cast("long") * 64 + F.col("n"))).alias("full"),
        F.collect_set(F.when(spoken_for, F.struct("lo", "n", "anchor", (~whole).alias("single")))).alias("open"))
    out = written(per_text, "settled")
    free(found)
    return out


def _windows(texts: DataFrame, settled: DataFrame, window: int) -> DataFrame:
    """Every window of the open runs: anchor and window hash, and whose it is where that is not known to repeat."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for a, b in text_runs(batch, "text"):
                part = batch.slice(a, b - a)
                hashes, _, _, first, _, _ = words_of(part.column("text"))
                sums = run_sums(hashes, _BASE)
                runs_of = part.column("open")
                flat = runs_of.flatten()
                row = np.repeat(np.arange(part.num_rows), runs_of.value_lengths().to_numpy(zero_copy_only=False))
                lo, n, anchor, single = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row, anchor, single, start = np.repeat(row, n), np.repeat(anchor, n), np.repeat(single, n), np.repeat(lo, n) + inner
                at = first[row] + start
                win = runs(sums, at, at + window).view(np.int64)
                mine = pa.array(single.astype(bool))
                at_row = pa.array(row)
                none = pa.scalar(None, pa.int64())
                import pyarrow.compute as pc
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(win), mine, pc.if_else(mine, part.column("h1").take(at_row), none),
                     pc.if_else(mine, part.column("h2").take(at_row), none), pa.array(start.astype(np.int32))],
                    names=["anchor", "win", "single", "h1", "h2", "start"])

    rows = texts.join(settled.filter("size(open) > 0"), ["h1", "h2"]).select("h1", "h2", "text", "open")
    return rows.mapInArrow(run, "anchor long, win long, single boolean, h1 long, h2 long, start int")


def cleaned(docs: DataFrame, text_col: str = "text", window: int = WINDOW, seed: int = SEED,
            texts_out: bool = True) -> DataFrame:
    """Per distinct text (h1, h2): n_words, n_removed, kept_sha256, and the kept words as ``kept`` with ``texts_out``."""
    if not seed <= window < 64:
        raise ValueError("a window has at least a seed's words and fewer than 64")
    settled = _settled(docs, text_col, window, seed)
    texts = docs.select(*text_key(text_col), text_or_empty(text_col).alias("text")).groupBy("h1", "h2").agg(
        F.min("text").alias("text"))
    windows = written(_windows(texts, settled, window), "windows")
    repeated = written(windows.groupBy("anchor", "win").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("anchor", "win"),
                       "repeated")
    matched = (windows.filter("single").join(repeated, ["anchor", "win"])
               .groupBy("h1", "h2").agg(F.collect_list(F.col("start").cast("long") * 64 + 1).alias("more")))
    schema = "h1 long, h2 long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if texts_out else "")

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            out = []
            for text, full, more in zip(*(batch.column(c) for c in ("text", "full", "more"))):
                words = text.as_buffer().to_pybytes().split()
                spans = [np.asarray(c.values) for c in (full, more) if c.is_valid and len(c.values)]
                removed, kept = 0, words
                if spans:
                    packed = np.concatenate(spans)
                    lo, n = packed // 64, packed % 64
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, lo, 1)
                    np.add.at(edge, lo + n - 1 + window, -1)
                    keep = np.cumsum(edge)[:-1] == 0
                    removed = int(len(words) - keep.sum())
                    kept = list(compress(words, keep.tolist()))
                data = b" ".join(kept)
                out.append((len(words), removed, hashlib.sha256(data).hexdigest()) + ((data.decode(),) if texts_out else ()))
            names = ["h1", "h2", *[c.split()[0] for c in schema.split(", ")[2:]]]
            yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), *map(pa.array, zip(*out))], names=names)

    rows = texts.join(settled.select("h1", "h2", "full"), ["h1", "h2"], "left").join(matched, ["h1", "h2"], "left")
    return rows.select("h1", "h2", "text", "full", "more").mapInArrow(run, schema)


def deduplicated(docs: DataFrame, key: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED,
                 texts_out: bool = True) -> DataFrame:
    """One row per row of ``docs``: its key and the columns of ``cleaned``."""
    found = cleaned(docs, text_col, window, seed, texts_out)
    return docs.select(F.col(key), *text_key(text_col)).join(found, ["h1", "h2"]).drop("h1", "h2")
