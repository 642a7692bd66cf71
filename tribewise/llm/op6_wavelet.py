"""Token files as wavelet matrices, one file per shard.

Texts are dealt to shards by ranges of their id, encoded there, and the shard's
ids are stored as bit planes: plane 0 holds the highest bit of every id in text
order, and before each next plane the ids are stably parted into those with a 0
and those with a 1.  With the number of ones up to every 4,096th bit, one file
answers without unpacking its tokens: the id at a position, how often an id
occurs in a range, and where its k-th occurrence is.

File: magic, length of the header, header (JSON), then sections compressed one
by one: document ids, document ends, and per plane its bits and its counts.

Encoding.  The vocabulary's pre-tokenizer always cuts before a blank that a
visible character follows, and between a letter or digit and a stop.  Texts are
cut there, the library encodes every piece that the worker has not seen, and
the ids of a run of texts are put together with array operations.

Cases: null text counts as empty; an empty text has the end id only; null ids
come first; rows of one id are ordered by text; an empty table gives no files
and no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import open_shared, shared_path, text_or_empty, text_runs, written
from .words import joined, span_hashes

MAGIC = b"WVMX0001"
BLOCK = 4096
SHARD_BYTES, SHARD_TOKENS, CACHE = 16 << 20, 32 << 20, 3_000_000
MANIFEST_SCHEMA = "shard int, part int, path string, n_docs long, n_tokens long"


# -------------------------------------------------------------------- encoding

#: Bytes after which a blank is no cut (white space, and first bytes of other blanks), marks that end a word.
_NO_CUT, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_NO_CUT[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = True
_STOP[list(b".,;:!?")] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True


class PieceCache:
    """Token ids of many texts at once, as the tokenizers library gives them.

    Pieces are known by a 64-bit hash of their bytes; hashes, lengths and ids
    of the pieces seen are arrays, so a million of them take some 40 MB.
    """

    def __init__(self, path: str, limit: int = CACHE):
        from tokenizers import Tokenizer
        self.library, self.limit = Tokenizer.from_file(path), limit
        self._clear()

    def _clear(self) -> None:
        self.keys, self.codes = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.flat, self.ends = [np.empty(0, np.uint32)], [np.zeros(1, np.int64)]

    @staticmethod
    def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces of texts that lie in ``data`` with a line end after each."""
        cut = np.zeros(len(data) + 1, bool)
        after = data[1:]
        cut[:-2] = (data[:-1] == 0x20) & ~_NO_CUT[after]
        word = _ALNUM[data[:-1]]
        word[1:] |= (data[:-2] == 0xC3) & (data[1:-1] >= 0x80) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)
        cut[1:-1] |= _STOP[after] & word
        cut[offsets[:-1]] = True
        starts = np.flatnonzero(cut[:-1])
        ends = np.append(starts[1:], len(data))
        last = np.searchsorted(starts, offsets[1:]) - 1
        ends[last] -= 1  # the line end between texts
        return starts, ends

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        got = [e.ids for e in self.library.encode_batch(pieces, add_special_tokens=False)]
        sizes = np.array([len(g) for g in got], np.int64)
        known = len(self.codes)
        base = self.ends[-1][-1]
        self.flat.append(np.fromiter((i for g in got for i in g), np.uint32, int(sizes.sum())))
        self.ends.append(base + np.cumsum(sizes))
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.codes = np.insert(self.codes, at, known + np.arange(len(keys)))

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each) for an Arrow string array."""
        if len(self.keys) > self.limit:
            self._clear()
        data, offsets = joined(texts)
        starts, ends = self.cuts(data, offsets)
        unique, first, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, unique)
        missing = np.ones(len(unique), bool)
        inside = at < len(self.keys)
        missing[inside] = self.keys[at[inside]] != unique[inside]
        if missing.any():
            raw = data.tobytes()
            spans = zip(starts[first[missing]].tolist(), ends[first[missing]].tolist())
            self._learn(unique[missing], [raw[a:b].decode() for a, b in spans])
            at = np.searchsorted(self.keys, unique)
        if len(self.flat) > 1:
            self.flat, self.ends = [np.concatenate(self.flat)], [np.concatenate(self.ends)]
        code = self.codes[at][back]
        begin = self.ends[0][code]
        length = self.ends[0][code + 1] - begin
        done = np.concatenate(([0], np.cumsum(length)))
        ids = self.flat[0][np.repeat(begin - done[:-1], length) + np.arange(done[-1])]
        return ids, np.diff(done[np.searchsorted(starts, offsets)])


_CACHES: dict[str, PieceCache] = {}


def piece_cache(path: str) -> PieceCache:
    if path not in _CACHES:
        _CACHES[path] = PieceCache(path)
    return _CACHES[path]


# ------------------------------------------------------------------------ file

def dump(ids: np.ndarray, doc_ids: list, doc_ends: np.ndarray, bits: int) -> bytes:
    """The file of one shard."""
    import zstandard
    pack = zstandard.ZstdCompressor(level=1).compress
    nulls = sum(d is None for d in doc_ids)
    sections = [pack(np.array([d or 0 for d in doc_ids], "<i8").tobytes()), pack(np.asarray(doc_ends, "<i8").tobytes())]
    now, zeros = ids.astype(np.uint16 if bits <= 16 else np.uint32), []
    for level in range(bits):
        bit = (now >> (bits - 1 - level) & 1).astype(bool)
        plane = np.packbits(bit, bitorder="little")
        padded = np.zeros(-(-max(1, len(ids)) // BLOCK) * BLOCK // 8, np.uint8)
        padded[:len(plane)] = plane
        ones = np.bitwise_count(padded.view("<u8")).reshape(-1, BLOCK // 64).sum(1, dtype=np.int64)
        sections += [pack(plane.tobytes()), pack(np.concatenate(([0], np.cumsum(ones))).astype("<u4").tobytes())]
        low = now[~bit]
        zeros.append(len(low))
        now = np.concatenate((low, now[bit]))
    head = json.dumps({"bits": bits, "n": len(ids), "docs": len(doc_ids), "null_ids": nulls, "zeros": zeros,
                       "sections": [len(s) for s in sections]}).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *sections])


class WaveletFile:
    """A shard's file in memory; planes are unpacked when first used."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet file")
        size = int.from_bytes(data[8:12], "little")
        self.head = json.loads(data[12:12 + size])
        self.data, self.at = data, np.concatenate(([0], np.cumsum(self.head["sections"]))) + 12 + size
        self.n, self.bits, self.zeros = self.head["n"], self.head["bits"], self.head["zeros"]
        self._planes: dict = {}

    def _section(self, k: int, kind: str) -> np.ndarray:
        import zstandard
        raw = zstandard.ZstdDecompressor().decompress(self.data[self.at[k]:self.at[k + 1]])
        return np.frombuffer(raw, kind)

    def plane(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        if level not in self._planes:
            raw = self._section(2 + 2 * level, np.uint8)
            padded = np.zeros(-(-max(1, self.n) // BLOCK) * BLOCK // 8, np.uint8)
            padded[:len(raw)] = raw
            self._planes[level] = padded.view("<u8"), self._section(3 + 2 * level, "<u4")
        return self._planes[level]

    def documents(self) -> tuple[list, np.ndarray]:
        ids = self._section(0, "<i8").tolist()
        return [None] * self.head["null_ids"] + ids[self.head["null_ids"]:], self._section(1, "<i8")

    def _ones(self, level: int, i: int) -> int:
        """Ones before position i of a plane."""
        words, counts = self.plane(level)
        block, word = i // BLOCK, i // 64
        total = int(counts[min(block, len(counts) - 1)]) + int(np.bitwise_count(words[block * (BLOCK // 64):word]).sum())
        return total + (int(words[word]) & ((1 << i % 64) - 1)).bit_count() if i % 64 else total

    def _bit(self, level: int, i: int) -> int:
        return int(self.plane(level)[0][i // 64]) >> i % 64 & 1

    def access(self, i: int) -> int:
        """The id at position i."""
        value = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, i), self._ones(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, symbol: int, a: int, b: int) -> tuple[int, int]:
        for level in range(self.bits):
            x, y = self._ones(level, a), self._ones(level, b)
            a, b = ((self.zeros[level] + x, self.zeros[level] + y) if symbol >> (self.bits - 1 - level) & 1
                    else (a - x, b - y))
        return a, b

    def count(self, symbol: int, a: int = 0, b: int | None = None) -> int:
        """Occurrences of an id in positions a..b-1."""
        b = self.n if b is None else min(b, self.n)
        low, high = self._range(symbol, min(a, b), b)
        return high - low

    def _select(self, level: int, k: int, bit: int) -> int:
        """Position of the k-th (from 0) such bit of a plane, by bisection over the counts and then the block."""
        low, high = 0, self.n
        before = (lambda i: self._ones(level, i)) if bit else (lambda i: i - self._ones(level, i))
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if before(middle + 1) <= k else (low, middle)
        return low

    def locate(self, symbol: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of an id."""
        if not 0 <= k < self.count(symbol):
            raise IndexError(k)
        at = self._range(symbol, 0, self.n)[0] + k
        for level in reversed(range(self.bits)):
            bit = symbol >> (self.bits - 1 - level) & 1
            at = self._select(level, at - self.zeros[level] if bit else at, bit)
        return at

    def tokens(self) -> np.ndarray:
        """All ids in text order: the partings undone from the last plane up."""
        now = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in reversed(range(self.bits)):
            bit = np.unpackbits(self._section(2 + 2 * level, np.uint8), count=self.n, bitorder="little").view(bool)
            up, zeros = np.empty_like(now), self.zeros[level]
            up[~bit] = now[:zeros]
            up[bit] = now[zeros:] | (1 << (self.bits - 1 - level))
            now = up
        return now.astype(np.uint32)


# ------------------------------------------------------------------- operators

def write_shards(docs: DataFrame, tokenizer: str, folder: str, key: str = "doc_id", text_col: str = "text",
                 end_id: int = 0, shard_bytes: int = SHARD_BYTES, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode and write files in ascending key order; returns the manifest."""
    source = docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    total = source.agg(F.sum(F.octet_length("text").cast("long") + 16)).first()[0] or 0
    n_shards = max(1, -(-total // shard_bytes))
    rows = (source.repartitionByRange(n_shards, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
            .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text"))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        ctx, cache = TaskContext.get(), piece_cache(tokenizer)
        bits = max(1, (cache.library.get_vocab_size() - 1).bit_length())
        stem = f"{ctx.partitionId():06d}-{ctx.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        done, ids, doc_ids, sizes, held = [], [], [], [], 0

        def close():
            nonlocal ids, doc_ids, sizes, held
            ends = np.cumsum(np.concatenate(sizes))
            path = f"{folder.rstrip('/')}/{stem}-{len(done):04d}.wvmx"
            with open_shared(path, "w") as f:
                f.write(dump(np.concatenate(ids), doc_ids, ends, bits))
            done.append((ctx.partitionId(), len(done), path, len(doc_ids), held))
            ids, doc_ids, sizes, held = [], [], [], 0

        for batch in batches:
            for a, b in text_runs(batch, "text"):
                got, size = cache.encode(batch.column("text").slice(a, b - a))
                ids.append(np.insert(got, np.cumsum(size), end_id).astype(np.uint32))
                sizes.append(size + 1)
                doc_ids += batch.column("doc_id").slice(a, b - a).to_pylist()
                held += len(ids[-1])
                if held >= shard_tokens:
                    close()
        if held:
            close()
        if done:
            types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)],
                                             names=[c.split()[0] for c in MANIFEST_SCHEMA.split(", ")])

    return rows.mapInArrow(run, MANIFEST_SCHEMA)


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files of a manifest (a row per file)."""
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                with open_shared(path, "r") as f:
                    shard = WaveletFile(f.read())
                ids, (docs, ends) = shard.tokens().astype("<u4"), shard.documents()
                starts = np.concatenate(([0], ends[:-1]))
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(starts + base), pa.array(ends - starts),
                     pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = max(1, manifest.count())  # files, not the manifest's size, decide the tasks
    return (files.select("path", "base").repartition(tasks, "path")
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the files of ``docs``, then read them back."""
    spark = docs.sparkSession
    manifest = written(write_shards(docs, tokenizer, shared_path(spark, "tokens"), **options), "token-manifest")
    return read_shards(manifest)
