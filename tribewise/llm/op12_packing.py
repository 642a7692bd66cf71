"""Best-fit packing: bounded-space online best-fit over pieces of documents.

Documents become token ids (an end id after each) and are cut only where they are longer
than a sequence.  Pieces are dealt by a hash of their place in the written table into groups of
some ``GROUP`` pieces; each group is packed by its own online best-fit with at
most ``OPEN`` open bins.  Open bins hang in lists by their free space, and a bitset has a
bit for each free space in use: the lowest bit at or above a length is the best fit, the lowest
bit of all the fullest bin, which closes first when there are too many.  A group's pieces arrive
in blocks of ``OPEN``, long ones first within a block: long pieces leave gaps that the
short ones of the same block fill, and bins stay open across blocks.

Tokens of a text are those of its words, cut at ASCII white space (which the vocabulary's
pre-tokenizer drops) and between an ASCII letter or digit and a stop (where it always cuts), so each
distinct word is encoded once per worker by the library and looked up afterwards; texts of over
``STEP`` bytes go through in steps.

Cases: a null or empty text is its end id alone; repeated rows are packed once each; rows with
a null key are packed too; a text of one word is encoded whole; an empty table has no pieces; extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, text_runs, written
from .words import joined

#: Tokens of a sequence, open bins of a packer, pieces of a group (in the mean).
CAPACITY, OPEN, GROUP = 2048, 4096, 16384
STEP = 4 << 20
#: Bytes of words and ids that a worker keeps before it starts anew.
KEPT = 128 << 20
_WHITE = b" \t\n\x0b\x0c\r"
_IS_WHITE, _IS_STOP, _IS_PLAIN = (np.isin(np.arange(256), [*some]) for some in (
    _WHITE, b".,;:!?", b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_ENCODERS: dict = {}


def encoder_of(model: str) -> WordEncoder:
    """The worker's encoder; it outlives a task."""
    if model not in _ENCODERS:
        _ENCODERS[model] = WordEncoder(model)
    return _ENCODERS[model]


class WordEncoder:
    """Ids of texts by way of their distinct words."""

    def __init__(self, model: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(model)
        normalizer = self.library.normalizer
        #: The vocabulary is of lower case: words are kept lower-cased (but for those that may hold a special token).
        self.fold = normalizer is not None and normalizer.normalize_str("AZ") == "az"
        self.clear()

    def clear(self):
        self.at, self.size = {}, 0
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.starts, self.lengths = np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, words: list[str]):
        for a in range(0, len(words), 1 << 16):
            some = words[a:a + (1 << 16)]
            found = self.library.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(found.ids, np.uint32)
            lengths = np.bincount(np.array(found.word_ids, np.int64), minlength=len(some))
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
            self.ids[self.used:self.used + len(ids)] = ids
            first = len(self.starts)
            self.at.update(zip(some, range(first, first + len(some))))
            self.starts = np.concatenate((self.starts, self.used + np.cumsum(lengths) - lengths))
            self.lengths = np.concatenate((self.lengths, lengths))
            self.used += len(ids)
            self.size += 200 * len(some) + sum(map(len, some)) + 4 * len(ids)

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of an Arrow string array's texts in a row, and the number of each text's ids."""
        if self.size > KEPT:
            self.clear()
        data, offsets = joined(texts)
        full = ~_IS_WHITE[data]
        before = np.concatenate((data[:1] * 0 + 32, data[:-1]))
        starts = full & (_IS_WHITE[before] | (_IS_STOP[data] & _IS_PLAIN[before]))
        at, first = np.flatnonzero(starts), np.flatnonzero(starts[full])
        letters = data[full]
        bounds = np.concatenate((first, [len(letters)])).astype(np.int32)
        if self.fold:
            plain, letters = letters, _FOLD[letters]
            bars = np.flatnonzero(plain == ord("|"))
            for i in np.unique(np.searchsorted(first, bars, "right") - 1):
                letters[bounds[i]:bounds[i + 1]] = plain[bounds[i]:bounds[i + 1]]
        encoded = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(letters)]).dictionary_encode()
        words = encoded.dictionary.to_pylist()
        self._learn([w for w in words if w not in self.at])
        known = np.fromiter((self.at[w] for w in words), np.int64, len(words))
        word = known[encoded.indices.to_numpy(zero_copy_only=False)]
        lengths = self.lengths[word]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        source = np.repeat(self.starts[word] - ends[:-1], lengths) + np.arange(ends[-1])
        return self.ids[source], np.diff(ends[np.searchsorted(at, offsets)])


def _steps(text: str, step: int) -> Iterator[str]:
    """``text`` in parts of about ``step`` bytes that end at white space (a longer word is not cut)."""
    raw, a = text.encode(), 0
    while a < len(raw):
        b = a + step
        if b < len(raw):
            while b < len(raw) and raw[b] not in _WHITE:
                b += 1
        yield raw[a:b].decode()
        a = b


def _piece_rows(ids: np.ndarray, counts: np.ndarray, capacity: int):
    """Row, piece, start and length of the pieces of documents with so many ids each."""
    n = -(-counts // capacity)
    row = np.repeat(np.arange(len(counts)), n)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = piece * capacity
    return row, piece, start, np.minimum(capacity, counts[row] - start)


def _pieces(batches, model: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    serial = TaskContext.get().partitionId() << 40
    encoder = encoder_of(model)

    def rows(keys, row, piece, start, length, ids):
        nonlocal serial
        offsets = np.concatenate(([0], np.cumsum(length) * 4)).astype(np.int32)
        raw = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4").tobytes())])
        number = np.arange(serial, serial + len(row))
        serial += len(row)
        return pa.RecordBatch.from_arrays(
            [keys.take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), raw, pa.array(number)],
            ["key", "piece", "start", "length", "ids", "serial"])

    for batch in batches:
        for a, b in text_runs(batch, "text", STEP):
            run = batch.slice(a, b - a)
            texts, keys = run.column("text"), run.column("key")
            if b - a == 1 and pc.binary_length(texts)[0].as_py() > STEP:
                rest, done = np.empty(0, np.uint32), 0
                parts = (encoder.encode(pa.array([part]))[0] for part in _steps(texts[0].as_py(), STEP))
                for more in (*parts, np.array([end_id], np.uint32)):
                    rest = np.concatenate((rest, more))
                    full = len(rest) // capacity
                    if full:
                        piece = np.arange(full) + done // capacity
                        yield rows(keys, np.zeros(full, np.int64), piece, piece * capacity, np.full(full, capacity), rest[:full * capacity])
                        rest, done = rest[full * capacity:], done + full * capacity
                if len(rest):
                    yield rows(keys, np.zeros(1, np.int64), np.array([done // capacity]), np.array([done]), np.array([len(rest)]), rest)
                continue
            found, counts = encoder.encode(texts)
            ids = np.full(len(found) + len(counts), end_id, np.uint32)
            ids[np.arange(len(found)) + np.repeat(np.arange(len(counts)), counts)] = found
            row, piece, start, length = _piece_rows(ids, counts + 1, capacity)
            yield rows(keys, row, piece, start, length, ids)


def pieces(docs: DataFrame, model: str, capacity: int = CAPACITY, end_id: int = 0, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids: key, piece, start, length, ids (little-endian 32-bit), serial."""
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def cut(batches):
        return _pieces(batches, model, capacity, end_id)

    return rows.mapInArrow(cut, f"key {kind}, piece int, start long, length long, ids binary, serial long")


class BestFit:
    """Online best-fit with at most ``open_bins`` bins open; lengths of 1 to ``capacity``."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN):
        self.capacity, self.limit = capacity, open_bins
        self.bins = [[] for _ in range(capacity + 1)]  # open bins by free space
        self.used = 0  # bit f: some open bin has f free
        self.open = self.made = 0

    def _take(self, free: int) -> int:
        at = self.bins[free].pop()
        if not self.bins[free]:
            self.used &= ~(1 << free)
        self.open -= 1
        return at

    def place(self, length: int) -> tuple[int, int]:
        """Bin of a piece and its offset there."""
        fits = self.used >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            at = self._take(free)
        else:
            free, at = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            self.bins[left].append(at)
            self.used |= 1 << left
            self.open += 1
            if self.open > self.limit:
                self._take((self.used & -self.used).bit_length() - 1)
        return at, self.capacity - free


def _spread(serial: np.ndarray) -> np.ndarray:
    x = serial.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


def _pack_group(rows: pa.Table, capacity: int, open_bins: int) -> pa.Table:
    length = rows.column("length").to_numpy()
    serial = rows.column("serial").to_numpy()
    arrival = np.lexsort((serial, _spread(serial)))
    block = np.empty(len(length), np.int64)
    block[arrival] = np.arange(len(length)) // open_bins
    order = np.lexsort((serial, -length, block))
    packer = BestFit(capacity, open_bins)
    bins, offsets = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
    for i, size in zip(order.tolist(), length[order].tolist()):
        bins[i], offsets[i] = packer.place(size)
    group = rows.column("bin_group")[0].as_py()
    return (rows.drop_columns(["serial", "bin_group"])
            .append_column("sequence_id", pa.array(bins + (group << 32))).append_column("offset", pa.array(offsets)))


def packed(cut: DataFrame, columns: list[str], capacity: int = CAPACITY, open_bins: int = OPEN, group: int = GROUP) -> DataFrame:
    """A table of pieces (``length``, a number ``serial`` of its own for each, ``columns``), with ``sequence_id`` and ``offset``."""
    groups = max(1, -(-cut.count() // group))
    rows = cut.select(*columns, "length", "serial", F.pmod(F.xxhash64("serial"), F.lit(groups)).alias("bin_group"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("serial", "bin_group").schema)

    def pack(table):
        return _pack_group(table, capacity, open_bins)

    return rows.groupBy("bin_group").applyInArrow(pack, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, model: str, ids_out: bool = True, capacity: int = CAPACITY, end_id: int = 0, open_bins: int = OPEN,
         group: int = GROUP, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of each document: key, piece, start, length, ids (or their ``ids_crc32``), sequence_id, offset."""
    cut = written(pieces(docs, model, capacity, end_id, key, text_col), "pieces")
    if not ids_out:
        cut = cut.withColumn("ids_crc32", F.crc32("ids"))
    content = "ids" if ids_out else "ids_crc32"
    rows = packed(cut, ["key", "piece", "start", content], capacity, open_bins, group)
    return rows.select(F.col("key").alias(key), "piece", "start", "length", content, "sequence_id", "offset")


def _join_ids(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("offset")
    return pa.table({"sequence_id": rows.column("sequence_id").slice(0, 1),
                     "ids": pa.array([b"".join(rows.column("ids").to_pylist())], pa.binary())})


def sequences(rows: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids.  ``rows`` come from ``pack`` with its ids."""
    return rows.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(_join_ids, "sequence_id long, ids binary")
