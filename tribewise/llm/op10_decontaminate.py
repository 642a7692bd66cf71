"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over consecutive words: hashed positions and ignored
ones.  Each mask is laid over every position of every benchmark item and of
every document; equal hashes are hits.  Around a hit, document and item are
compared word by word on the same diagonal: an overlap counts if some window
of ``window`` aligned words (the whole item, if it is shorter) has at least
``similarity`` of them equal.  The masks hit every such window of 8 words or more, whichever
words are substituted (tested by enumeration).

Words are runs of letters, digits and underscores in lower case, so case,
punctuation and line breaks do not matter.

Items of fewer than ``min_words`` words count only word for word: a mask of all
their words is laid over the documents, and every word must be equal.

The benchmark is a query set: it goes to the tasks in blocks of at most
``block_words`` words and ``WORD_BYTES`` bytes for each, each block in one pass
over all documents, so the broadcast has a bound whatever the benchmark's size.  Hits are found and
verified where the document lies; nothing of the documents is shuffled.

A document has one row per item, on the diagonal with the most equal words.

Cases: null and empty texts have no overlap; items without a word take no part; equal items are each reported; long texts of
one or a few words are compared on all diagonals of an item of the same words, in time of their lengths' product at most; repeated documents give
repeated rows; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
#: 1 is a hashed position, 0 an ignored one.
MASKS = ("11011", "10111", "1101001", "1001011")
WINDOW, SIMILARITY, MIN_WORDS, BLOCK_WORDS, WORD_BYTES = 20, 0.8, 8, 1_000_000, 16
#: Hits of an item, as a multiple of its diagonals, beyond which all are tried; hits listed at a time.
CROWDED, STEP = 4, 1 << 20
_SPAN = 1 << 33  # diagonals of one item in a number
SCHEMA = "doc_id long, item_id long, doc_word long, item_word long, n_overlap long, n_equal long"


def offsets(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


class Index:
    """Seeds of one block of benchmark items, and the verification of hits."""

    def __init__(self, items: list[tuple[int, str]], masks, window: int, similarity: float, min_words: int):
        import numpy as np
        self.np, self.window, self.similarity, self.min_words = np, window, similarity, min_words
        self.vocabulary, self.items = {}, []
        for item_id, text in items:
            words = WORD.findall((text or "").lower())
            if words:
                ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64)
                self.items.append((item_id, ids))
        rng = np.random.Generator(np.random.PCG64(7))
        short = sorted({len(ids) for _, ids in self.items if len(ids) < min_words})
        whole = {n: len(masks) + j for j, n in enumerate(short)}
        self.masks = [(offsets(m), rng.integers(1, 1 << 62, m.count("1"), dtype=np.int64) * 2 + 1)
                      for m in [*masks, *("1" * n for n in short)]]
        self.lengths = np.array([len(ids) for _, ids in self.items], np.int64)
        keys, where = [], []
        for k, (_, ids) in enumerate(self.items):
            for m in [whole[len(ids)]] if len(ids) in whole else range(len(masks)):
                at, hashes = self.seeds(ids, m)
                keys.append(hashes)
                where.append(np.column_stack((np.full(len(at), k), at)))
        self.keys = np.concatenate(keys) if keys else np.empty(0, np.int64)
        self.where = np.concatenate(where) if where else np.empty((0, 2), np.int64)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.where = self.keys[order], self.where[order]

    def seeds(self, ids, m: int):
        """Positions whose hashed words are all known to the benchmark, and their hashes."""
        np = self.np
        places, factors = self.masks[m]
        n = len(ids) - places[-1]
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        known = ids[:n] > 0
        for o in places[1:]:
            known &= ids[o:o + n] > 0
        at = np.flatnonzero(known)
        hashes = np.full(len(at), m, np.int64)
        for o, f in zip(places, factors):
            hashes = (hashes ^ (ids[at + o] * f)) * np.int64(0x2545F4914F6CDD1D)
        return at, hashes

    def diagonals(self, ids):
        """(item, place in the text minus place in the item) of every diagonal with a seed, each once.

        Seeds are counted per item first, by their distinct hashes.  An item with more hits than ``CROWDED`` times the diagonals that
        there are (texts of few words that recur) has all its diagonals tried instead; the hits of the others are
        listed in steps of ``STEP``.
        """
        np, n = self.np, len(ids)
        keys, where, seeds, load = self.keys, self.where, [], np.zeros(len(self.items), np.int64)
        for m in range(len(self.masks)):
            at, hashes = self.seeds(ids, m)
            if len(at):
                distinct, inverse, times = np.unique(hashes, return_inverse=True, return_counts=True)
                low, high = np.searchsorted(keys, distinct, "left"), np.searchsorted(keys, distinct, "right")
                rows = np.repeat(low - np.cumsum(high - low) + (high - low), high - low) + np.arange((high - low).sum())
                np.add.at(load, where[rows, 0], np.repeat(times, high - low))
                seeds.append((at, distinct, inverse))
        crowded = load > CROWDED * (n + self.lengths)
        found = [k * _SPAN + np.arange(-int(self.lengths[k]) + 1, n) for k in np.flatnonzero(crowded)]
        if crowded.any():
            cold = ~crowded[where[:, 0]]
            keys, where = keys[cold], where[cold]
        for at, distinct, inverse in seeds:
            low, high = np.searchsorted(keys, distinct, "left")[inverse], np.searchsorted(keys, distinct, "right")[inverse]
            some = np.flatnonzero(high > low)
            at, low, count = at[some], low[some], (high - low)[some]
            ends, a = np.cumsum(count), 0
            while a < len(at):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + STEP, "right")))
                c = count[a:b]
                hit = where[np.repeat(low[a:b] - np.cumsum(c) + c, c) + np.arange(c.sum())]
                found.append(np.unique(hit[:, 0] * _SPAN + np.repeat(at[a:b], c) - hit[:, 1]))
                a = b
        every = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        item = (every + _SPAN // 2) // _SPAN
        return np.column_stack((item, every - item * _SPAN))

    def overlaps(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item, first word in the text, first word in the item, aligned words, equal words) of verified items, each on its best diagonal."""
        np = self.np
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in WORD.findall(text.lower())], np.int64)
        best = {}
        for k, d in self.diagonals(ids).tolist():
            item_id, item = self.items[k]
            a, b = max(0, -d), min(len(item), len(ids) - d)
            w = min(self.window, len(item))
            if b - a < w:
                continue
            equal = np.concatenate(([0], np.cumsum(ids[a + d:b + d] == item[a:b])))
            if (equal[w:] - equal[:-w]).max() >= (w if len(item) < self.min_words else math.ceil(self.similarity * w)):
                row = (int(equal[-1]), item_id, a + d, a, b - a)
                if k not in best or row > best[k]:
                    best[k] = row
        return [(i, p, q, n, e) for e, i, p, q, n in best.values()]


def _blocks(benchmark: DataFrame, item_key: str, item_text: str, block_words: int):
    """Broadcasts of the items, at most ``block_words`` words or so (and their bytes) in each."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_key).cast("long").alias("i"), F.col(item_text).alias("t")).filter("t is not null")
    words = F.regexp_extract_all("t", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))  # WORD for Java
    total = items.agg(F.sum(F.size(words)).alias("n"), F.sum(F.octet_length("t")).alias("size")).first()
    n_blocks = max(1, math.ceil(1.25 * max(total["n"] or 0, (total["size"] or 0) / WORD_BYTES) / block_words))
    for block in range(n_blocks):
        part = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == block).orderBy("i", "t")
        yield spark.sparkContext.broadcast([tuple(r) for r in part.toLocalIterator()])


_INDEX: dict = {}


def _index(token: str, shared, options: tuple) -> Index:
    if token not in _INDEX:  # a reused worker builds the index of a block once
        _INDEX.clear()
        _INDEX[token] = Index(shared.value, *options)
    return _INDEX[token]


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text_col: str = "text",
             item_key: str = "item_id", item_text: str = "text", masks=MASKS, window: int = WINDOW,
             similarity: float = SIMILARITY, min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Pairs (document, item) with a verified overlap."""
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")
    options, out = (masks, window, similarity, min_words), None
    for shared in _blocks(benchmark, item_key, item_text, block_words):
        def run(batches, shared=shared, token=uuid.uuid4().hex):
            import pyarrow as pa
            index = _index(token, shared, options)
            for batch in batches:
                rows = []
                for doc, text in zip(batch.column("doc_id"), batch.column("text")):
                    rows += [(doc.as_py(), *hit) for hit in index.overlaps(text.as_py())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                                     names=[c.split()[0] for c in SCHEMA.split(", ")])

        found = source.mapInArrow(run, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_key: str = "item_id",
                         item_text: str = "text", masks=MASKS, window: int = WINDOW, similarity: float = SIMILARITY,
                         min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the rows that overlap a benchmark item; rows are dropped where they lie."""
    options, out = (masks, window, similarity, min_words), docs
    for shared in _blocks(benchmark, item_key, item_text, block_words):
        def run(batches, shared=shared, token=uuid.uuid4().hex):
            import pyarrow as pa
            index = _index(token, shared, options)
            for batch in batches:
                yield batch.filter(pa.array([not t.is_valid or not index.overlaps(t.as_py()) for t in batch.column(text_col)], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
