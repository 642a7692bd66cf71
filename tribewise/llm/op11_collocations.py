"""Phrase collocations by prefix-free parsing.

Every text becomes a stream of words and break marks.  Positions at which
the hash of ``overlap`` consecutive tokens is 0 modulo ``PERIOD`` cut the
stream into chunks; a chunk runs on to the end of the next cut's tokens, so
neighbours overlap by ``max_words - 1`` tokens and every phrase of up to
``max_words`` words lies whole in at least one chunk.  Equal chunks are one row
of the dictionary with the number of times that the parse uses them: copies of
texts and shared passages are counted once, weighted.  A phrase belongs to the chunk
in which it starts before the overlap (the last chunk of a text owns the
phrases of its tail too), so none is counted twice.

Counts come level by level.  A phrase of n words is counted only if the words
(then the phrases of n - 1 words) in it may reach ``min_count``: their counts are a table,
and a bitmap of fixed size (``SIEVE_BITS``, made by ``bitmap_construct_agg``) tells the
tasks which hashes are in it.  The bitmap errs only towards counting more;
counts are exact sums keyed by the phrase itself, and the limit is applied to them.

Cases: A-Z are lower-cased; a null text is empty, a null lang is ``und``; empty texts and
texts of separators have no words; repeated rows count again; a stream without cuts is cut
every ``LONGEST`` tokens, so no chunk grows with its text; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free, text_or_empty, text_runs, written
from .words import joined

#: Mean number of tokens between two cuts, and the most tokens from one cut to the next.
PERIOD, LONGEST = 24, 1024
#: Size of the bitmap that thins out candidates: 8 MB, whatever the input.
SIEVE_BITS = 1 << 26
_SLICE = 1 << 15  # bits of one result of bitmap_construct_agg
_BREAK = "\n"
_BLANK, _WORD, _MARK = 0, 1, 2
_KIND = np.full(256, _WORD, np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _MARK
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[_KIND == _MARK] = ord(_BREAK)
#: Tokens that a task counts at a time.
RUN = 1 << 20
#: Salts of the first of two ranking steps; a lang's last step sees at most so many times ``top`` rows.
SALTS = 64


def _list_bounds(lists) -> tuple[pa.Array, np.ndarray]:
    """Values and offsets (from 0) of a list array."""
    offsets = lists.offsets.to_numpy()
    return lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])), offsets - offsets[0]


def _tokens(texts) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words and break marks of texts, and where each text starts; a text ends with a mark."""
    data, offsets = joined(texts)
    kind = _KIND[data]
    at = np.flatnonzero(kind)
    kind = kind[at]
    before = np.concatenate(([_MARK], kind[:-1]))
    marks = (kind == _MARK) & (before != _MARK)
    starts = marks | ((kind == _WORD) & ((before == _MARK) | (np.diff(at, prepend=-1) > 1)))
    kept = marks | (kind == _WORD)
    at, first = at[kept], np.flatnonzero(starts[kept])
    bounds = np.concatenate((first, [len(at)])).astype(np.int32)
    tokens = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(_FOLD[data[at]])])
    return tokens, np.searchsorted(at[first], offsets)


def _codes(tokens) -> tuple[np.ndarray, pa.Array]:
    encoded = tokens.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary


def _ramp(lengths: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each length, in a row."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def parse(tokens, starts: np.ndarray, overlap: int, period: int = PERIOD, longest: int = LONGEST):
    """Chunks of texts laid end to end: (first token, end token, is last of its text) as arrays.

    ``starts`` holds each text's first token and, at the end, the number of tokens.
    """
    codes, words = _codes(tokens)
    n = len(codes)
    hashes = np.fromiter((zlib.crc32(w.as_py().encode()) for w in words), np.uint64, len(words))[codes] if n else np.empty(0, np.uint64)
    window = np.zeros(n, np.uint64)
    for k in range(overlap):
        window[:n - k] = window[:n - k] * np.uint64(0x9E3779B97F4A7C15) + hashes[k:]
    window ^= window >> np.uint64(32)
    cut = (window * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)) % np.uint64(period) == 0
    full = starts[:-1][np.diff(starts) > 0]
    ends = starts[1:][np.diff(starts) > 0]
    for k in range(overlap):  # a cut's tokens lie in its text
        tail = ends - 1 - k
        cut[tail[tail >= 0]] = False
    cut[full] = True
    at = np.flatnonzero(cut)
    gaps = np.diff(np.concatenate((at, [n])))
    pieces = -(-gaps // longest)
    at = np.repeat(at, pieces) + _ramp(pieces) * longest
    stop = np.concatenate((at[1:], [n])) if len(at) else at
    end_of = ends[np.searchsorted(ends, at, "right")] if len(at) else at
    last = (stop + overlap >= end_of) | (stop == end_of)
    # the chunk that reaches its text's end owns the rest; chunks that start beyond it add nothing
    first_last = np.concatenate(([True], (end_of[1:] != end_of[:-1]) | ~last[:-1])) if len(at) else last
    keep = ~last | first_last
    at, stop, end_of, last = at[keep], stop[keep], end_of[keep], last[keep]
    return at, np.where(last, end_of, np.minimum(stop + overlap, end_of)), last


def _chunk_batches(batches, overlap: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in text_runs(batch, "text", 4 << 20):
            run = batch.slice(a, b - a)
            tokens, starts = _tokens(run.column("text"))
            if not len(tokens):
                continue
            first, end, last = parse(tokens, starts, overlap)
            size = end - first
            index = np.repeat(first, size) + _ramp(size)
            lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(size))).astype(np.int32), tokens.take(pa.array(index)))
            row = np.searchsorted(starts, first, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [run.column("lang").take(pa.array(row)), pc.binary_join(lists, " "), pa.array(last)], ["lang", "chunk", "last"])


def dictionary(docs: DataFrame, max_words: int = 3, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Distinct chunks of the parse: lang, chunk (tokens joined by blanks), last, uses."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text_col).alias("text"))
    overlap = max(1, max_words - 1)

    def chunks(batches):
        return _chunk_batches(batches, overlap)

    return (rows.mapInArrow(chunks, "lang string, chunk string, last boolean")
            .groupBy("lang", "chunk", "last").agg(F.count(F.lit(1)).alias("uses")))


def _key(lang, phrase):
    """lang and phrase as one string; a phrase holds no tab, so the last tab divides them."""
    return F.concat(lang, F.lit("\t"), phrase)


def _passes(sieve: np.ndarray, lang: str, phrases: pa.Array) -> np.ndarray:
    seed = zlib.crc32(lang.encode() + b"\t")
    bit = np.fromiter((zlib.crc32(p.encode(), seed) for p in phrases.to_pylist()), np.int64, len(phrases)) % (len(sieve) * 8)
    return (sieve[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def _phrases(codes: np.ndarray, words: pa.Array, chunk: np.ndarray, owned: np.ndarray, uses: np.ndarray,
             lang: str, size: int, sieves: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """Distinct phrases of ``size`` words in chunks laid end to end, and their weighted counts.

    A position takes part at level n if its phrase of n - 1 words and the one after it pass the sieve of that level.
    """
    mark = words.index(_BREAK).as_py()
    code, names = codes, words  # phrase (of the level so far) at each position
    alive = codes != mark
    for level in range(2, size + 1):
        passed = alive
        if level - 2 < len(sieves):
            passed = alive & _passes(sieves[level - 2], lang, names)[code]
        n = len(codes) - level + 1
        if n <= 0:
            return pa.array([], pa.string()), np.empty(0, np.int64)
        both = passed[:n] & passed[1:n + 1] & (chunk[:n] == chunk[level - 1:])
        at = np.flatnonzero(both)
        keys, inverse = np.unique(code[at] * len(words) + codes[at + level - 1], return_inverse=True)
        names = pc.binary_join_element_wise(names.take(pa.array(keys // len(words))), words.take(pa.array(keys % len(words))), " ")
        code, alive = np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
        code[at], alive[at] = inverse, True
        if not len(names):
            return pa.array([], pa.string()), np.empty(0, np.int64)
    at = np.flatnonzero(alive & owned)
    counts = np.zeros(len(names), np.int64)
    np.add.at(counts, code[at], uses[chunk[at]])
    seen = np.flatnonzero(counts)
    return names.take(pa.array(seen)), counts[seen]


def _runs(batches, max_bytes: int) -> Iterator[pa.Table]:
    """Arrow batches put together to about so many bytes of chunks."""
    kept, size = [], 0
    for batch in batches:
        kept.append(batch)
        size += batch.nbytes
        if size >= max_bytes:
            yield pa.Table.from_batches(kept).combine_chunks()
            kept, size = [], 0
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def _count_batches(batches, size: int, overlap: int, sieves: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for run in _runs(batches, 6 * RUN):
        for lang in pc.unique(run.column("lang")).to_pylist():
            for mine in run.filter(pc.equal(run.column("lang"), lang)).combine_chunks().to_batches():
                tokens, offsets = _list_bounds(pc.split_pattern(mine.column("chunk"), " "))
                codes, words = _codes(tokens)
                lengths = np.diff(offsets)
                chunk = np.repeat(np.arange(len(lengths)), lengths)
                last = mine.column("last").to_numpy(zero_copy_only=False)
                owned = last[chunk] | (np.arange(len(codes)) < (offsets[1:] - overlap)[chunk])
                names, found = _phrases(codes, words, chunk, owned, mine.column("uses").to_numpy(), lang, size, sieves)
                keys = pc.binary_join_element_wise(pa.scalar(lang, pa.string()), names, "\t")
                yield pa.RecordBatch.from_arrays([keys, pa.array(found)], ["key", "n"])


def counts(chunks: DataFrame, size: int, max_words: int, sieves: list[np.ndarray] = (), min_count: int = 1) -> DataFrame:
    """Exact counts, from ``min_count`` on, of the phrases of ``size`` words that the sieves let through: lang, phrase, f."""
    overlap, sieves = max(1, max_words - 1), list(sieves)

    def grams(batches):
        return _count_batches(batches, size, overlap, sieves)

    phrase = F.substring_index("key", "\t", -1)
    return (chunks.mapInArrow(grams, "key string, n long").groupBy("key").agg(F.sum("n").alias("f")).filter(F.col("f") >= min_count)
            .select(F.col("key").substr(F.lit(1), F.length("key") - F.length(phrase) - 1).alias("lang"), phrase.alias("phrase"), "f"))


def sieve(frequent: DataFrame, bits: int = SIEVE_BITS) -> np.ndarray:
    """Bitmap (``bits`` / 8 bytes) of the hashes of ``frequent``'s phrases, put together by Spark in slices of 4 KB."""
    bit = F.crc32(F.encode(_key(F.col("lang"), F.col("phrase")), "utf-8")) % bits
    slices = (frequent.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / _SLICE).alias("at"))
              .agg(F.bitmap_construct_agg(F.col("bit") % _SLICE).alias("bitmap")))
    out = np.zeros(bits // 8, np.uint8)
    for row in slices.collect():  # at most bits / 2**15 rows of 4 KB
        out[row["at"] * _SLICE // 8:][:_SLICE // 8] = np.frombuffer(row["bitmap"], np.uint8)
    return out


def collocations(docs: DataFrame, min_words: int = 2, max_words: int = 3, min_count: int = 10, percent: int = 50, top: int = 2000,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``top`` best phrases of each lang: lang, rank, phrase, a, l, r, n, score.

    Candidates have ``min_words`` to ``max_words`` words and ``a`` >= ``min_count`` occurrences.  The cut with the
    lowest floor(1000000 a a / (l r)) gives l, r and score.  A candidate goes if a longer one that
    holds its words in a row has at least ``percent`` % of its occurrences.  Order: score and a
    descending, phrase ascending (bytes).
    """
    chunks = written(dictionary(docs, max_words, text_col, lang_col), "chunks")
    words = written(counts(chunks, 1, max_words), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    levels, sieves = [words.filter(F.col("f") >= min_count)], []
    for size in range(2, max_words + 1):
        sieves.append(sieve(levels[-1]))
        levels.append(written(counts(chunks, size, max_words, sieves, min_count), f"phrases{size}"))
    free(chunks)
    frequent = [level.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f")) for level in levels]

    scored = []
    for size in range(min_words, max_words + 1):
        rows = levels[size - 1].select("lang", "phrase", F.col("f").alias("a"))
        cuts = []
        for k in range(1, size):
            first = F.substring_index("phrase", " ", k)
            rest = F.substring_index("phrase", " ", k - size)
            left = frequent[k - 1].withColumnsRenamed({"part": "first", "part_f": "l"})
            right = frequent[size - k - 1].withColumnsRenamed({"part": "rest", "part_f": "r"})
            rows = rows.withColumns({"first": first, "rest": rest}).join(left, ["lang", "first"]).join(right, ["lang", "rest"])
            value = F.expr("(1000000 * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
            cuts.append(f"cut{k}")
            rows = rows.select("lang", "phrase", "a", *cuts[:-1], F.struct(value.alias("score"), F.lit(k).alias("k"), "l", "r").alias(f"cut{k}"))
        best = F.least(*cuts) if len(cuts) > 1 else F.col(cuts[0])
        scored.append(rows.select("lang", "phrase", "a", best.alias("cut"), F.lit(size).alias("size")))
    every = scored[0]
    for more in scored[1:]:
        every = every.unionByName(more)

    covers = None
    for size in range(min_words + 1, max_words + 1):
        spans = [F.array_join(F.slice(F.split("phrase", " "), i + 1, m), " ") for m in range(min_words, size) for i in range(size - m + 1)]
        found = levels[size - 1].select("lang", F.explode(F.array_distinct(F.array(*spans))).alias("phrase"), F.col("f").alias("cover"))
        covers = found if covers is None else covers.unionByName(found)
    if covers is not None:
        covers = covers.groupBy("lang", "phrase").agg(F.max("cover").alias("cover"))
        every = every.join(covers, ["lang", "phrase"], "left").filter(
            F.col("cover").isNull() | (F.lit(100) * F.col("cover") < F.lit(percent) * F.col("a")))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    flat = every.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"),
                        F.pmod(F.hash("phrase"), F.lit(SALTS)).alias("salt"))
    near = flat.withColumn("at", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("at") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
