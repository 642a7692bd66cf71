"""SentencePiece encoding with offsets, and decoding.

The normaliser walks the model's compiled character map (a double-array trie
and a table of replacements) by longest prefix, and notes for every byte of
the normalised text which source byte it came from.  Pieces are laid over the
normalised bytes one after the other, so the alignment projects each piece to
a span of original UTF-8 bytes.  The library encodes every text once; the bytes of its
pieces, joined, must be the normalised text, and their lengths are taken from a table by id.
A model without a character map and without squeezing (the dealt one) changes blanks only, which is done
for a whole text at once; the longest-prefix walk is for models that have a map.

Cases: null text counts as empty; an empty text has the end id only; equal
rows give equal rows; extra columns pass through ``encode`` untouched.
"""

from __future__ import annotations

import hashlib
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

MARK = "▁"


# ---------------------------------------------------------------- model file

def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        c = b[i]
        i += 1
        value |= (c & 127) << shift
        shift += 7
        if c < 128:
            return value, i


def _fields(b: bytes):
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        if key & 7 == 0:
            value, i = _varint(b, i)
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            if size is None:
                size, i = _varint(b, i)
            value, i = b[i:i + size], i + size
        yield key >> 3, value


def normaliser_spec(model_path: str) -> dict:
    """Field 3 of the model file: the compiled map and the white-space switches."""
    spec = {"charsmap": b"", "add_dummy_prefix": True, "remove_extra_whitespaces": True, "escape_whitespaces": True}
    names = {2: "charsmap", 3: "add_dummy_prefix", 4: "remove_extra_whitespaces", 5: "escape_whitespaces"}
    with open(model_path, "rb") as f:
        raw = f.read()
    for field, value in _fields(raw):
        if field == 3:
            for sub, v in _fields(value):
                if sub in names:
                    spec[names[sub]] = v if sub == 2 else bool(v)
    return spec


# ---------------------------------------------------------------- normaliser

class Normaliser:
    """Longest-prefix rewriting with a source offset for each byte it writes."""

    def __init__(self, charsmap: bytes = b"", add_dummy_prefix: bool = True,
                 remove_extra_whitespaces: bool = True, escape_whitespaces: bool = True):
        self.units, self.replacements = (), b""
        if charsmap:
            size = struct.unpack_from("<I", charsmap)[0]
            self.units = struct.unpack_from(f"<{size // 4}I", charsmap, 4)
            self.replacements = charsmap[4 + size:]
        self.dummy, self.squeeze = add_dummy_prefix, remove_extra_whitespaces
        self.blank = MARK.encode() if escape_whitespaces else b" "

    def longest(self, data: bytes, at: int) -> tuple[int, int] | None:
        """(length, value) of the longest key of the trie that ``data`` has at ``at``."""
        units, found = self.units, None
        if not units:
            return None
        node = self._child(0)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or (units[node] & 0x800000FF) != data[i]:
                break
            leaf = units[node] >> 8 & 1
            node ^= self._child(node)
            if leaf:
                found = (i - at + 1, units[node] & 0x7FFFFFFF)
        return found

    def _child(self, node: int) -> int:
        unit = self.units[node]
        return (unit >> 10) << ((unit & 512) >> 6)

    def step(self, data: bytes, at: int) -> tuple[bytes, int]:
        """What replaces the prefix at ``at``, and how many source bytes that prefix has."""
        hit = self.longest(data, at)
        if hit:
            end = self.replacements.index(b"\0", hit[1])
            return self.replacements[hit[1]:end], hit[0]
        lead = data[at]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return data[at:at + n], n

    def __call__(self, text: str) -> tuple[bytes, list[int]]:
        """Normalised bytes, and for each byte (and the end) the offset of its source byte."""
        data = text.encode()
        out, source, at = bytearray(), [], 0

        def put(piece: bytes, origin: int) -> None:
            out.extend(piece)
            source.extend([origin] * len(piece))

        steps = []
        while at < len(data):
            piece, n = self.step(data, at)
            steps.append((piece, at, n))
            at += n
        if self.squeeze:
            while steps and steps[0][0] in (b" ", b""):
                steps.pop(0)
            while steps and steps[-1][0] in (b" ", b""):
                steps.pop()
        if self.dummy and steps:
            put(self.blank, steps[0][1])
        before_blank = self.squeeze
        for piece, origin, n in steps:
            identical = piece == data[origin:origin + n]
            if self.squeeze and before_blank:
                piece = piece.lstrip(b" ")
            for k in range(len(piece)):
                byte = piece[k:k + 1]
                put(self.blank if byte == b" " else byte, origin + k if identical else origin)
            before_blank = piece.endswith(b" ") if piece else before_blank
        source.append(steps[-1][1] + steps[-1][2] if steps else 0)
        return bytes(out), source

    def aligned(self, text: str):
        """The same with the offsets in an array; without a map and squeezing only blanks change, all at once."""
        import numpy as np
        if self.units or self.squeeze or not text:
            out, source = self(text)
            return out, np.asarray(source, dtype=np.int64)
        data = text.encode()
        blanks = np.frombuffer(data, dtype=np.uint8) == 32
        lead = self.blank if self.dummy else b""
        source = np.repeat(np.arange(len(data), dtype=np.int64), np.where(blanks, len(self.blank), 1))
        return lead + data.replace(b" ", self.blank), np.concatenate([np.zeros(len(lead), np.int64), source, [len(data)]])


# ------------------------------------------------------------------- encoder

class Encoder:
    """The aligned normaliser beside the library's processor, and what each piece covers of a normalised text."""

    def __init__(self, model_path: str):
        import numpy as np
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.normaliser = Normaliser(**normaliser_spec(model_path))
        size = self.sp.get_piece_size()
        self.decimal = [str(i) for i in range(size)]
        #: Bytes of each piece; a byte piece stands for its byte, unknown characters have no length of their own.
        self.covers = [bytes([int(self.sp.id_to_piece(i)[3:5], 16)]) if self.sp.is_byte(i) else
                       b"" if self.sp.is_unknown(i) or self.sp.is_control(i) else self.sp.id_to_piece(i).encode() for i in range(size)]
        self.lengths = np.array([len(p) for p in self.covers], np.int64)

    def ids(self, text: str) -> list[int]:
        return self.sp.encode(text, num_threads=1)

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)

    def _lengths(self, ids: list[int], norm: bytes):
        """Bytes of ``norm`` that each piece covers, one after the other."""
        import numpy as np
        if b"".join(map(self.covers.__getitem__, ids)) == norm:
            return self.lengths[ids] if ids else np.zeros(0, np.int64)
        sizes, at = [], 0
        for i in ids:  # unknown characters among them: each is one character long
            sizes.append(len(self.covers[i]) or len(norm[at:at + 4].decode("utf-8", "ignore")[:1].encode()))
            at += sizes[-1]
        return np.array(sizes, np.int64)

    def aligned(self, text: str):
        """Ids, and (begin, end) of each piece in bytes of the original text as an array of two columns.

        Should the pieces not cover the normalised bytes, the spans are those of the library's surfaces.
        """
        import numpy as np
        norm, source = self.normaliser.aligned(text)
        ids = self.ids(text)
        if not ids:
            return ids, np.zeros((0, 2), np.int64)
        sizes = self._lengths(ids, norm)
        ends = np.cumsum(sizes)
        if ends[-1] != len(norm):
            sizes = np.array([len(p.surface.encode()) for p in self.sp.encode(text, return_type="proto").pieces], np.int64)
            ends = np.cumsum(sizes)
            return ids, np.stack([ends - sizes, ends], axis=1)
        return ids, np.stack([source[ends - sizes], source[ends]], axis=1)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(id, begin, end) of each piece, begin and end in bytes of the original text."""
        ids, spans = self.aligned(text)
        return [(i, b, z) for i, (b, z) in zip(ids, spans.tolist())]


_ENCODERS: dict[str, Encoder] = {}


def encoder(model_path: str) -> Encoder:
    """The worker's encoder of a model; Python workers are reused, so it loads once per worker."""
    if model_path not in _ENCODERS:
        _ENCODERS[model_path] = Encoder(model_path)
    return _ENCODERS[model_path]


# ----------------------------------------------------------------- operators

def _mapped(docs: DataFrame, text_col: str, rows, out_schema: str, keep: list[str]) -> DataFrame:
    """Stream Arrow batches through ``rows(text) -> tuple``, keeping the columns ``keep``."""
    from pyspark.sql.types import _parse_datatype_string
    added = _parse_datatype_string(out_schema)
    schema = docs.select(*[F.col(f"`{k}`") for k in keep]).schema
    names = [f.name for f in added.fields]
    for f in added.fields:
        schema = schema.add(f)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        target = to_arrow_schema(added)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                values = [rows(t) for t in part.column(len(keep)).to_pylist()]
                cols = [pa.array([v[k] for v in values], target.field(n).type) for k, n in enumerate(names)]
                yield pa.RecordBatch.from_arrays(part.columns[:len(keep)] + cols, names=[*keep, *names])

    text = "__text"
    while text in keep:
        text += "_"
    source = docs.select(*[F.col(f"`{k}`") for k in keep], text_or_empty(text_col).alias(text))
    return source.mapInArrow(run, schema)


def encode(docs: DataFrame, model_path: str, text_col: str = "text", spans: bool = False) -> DataFrame:
    """Add ``sp_ids`` (end id last) to ``docs``; with ``spans`` also ``sp_spans`` of (id, begin, end).

    Columns of the same names are replaced; all others pass through.
    """
    out = "sp_ids array<int>" + (", sp_spans array<struct<id:int,begin:int,end:int>>" if spans else "")

    def rows(text):
        e = encoder(model_path)
        found = e.spans(text)
        ids = [i for i, _, _ in found] + [e.sp.eos_id()]
        if not spans:
            return (ids,)
        return ids, [{"id": i, "begin": b, "end": z} for i, b, z in found]

    keep = [c for c in docs.columns if c not in ("sp_ids", "sp_spans")]
    return _mapped(docs, text_col, rows, out, keep)


def decode(encoded: DataFrame, model_path: str, ids_col: str = "sp_ids") -> DataFrame:
    """Add ``sp_text``, the library's decoding of ``ids_col`` (null ids: null)."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            e = encoder(model_path)
            texts = [None if ids is None else e.decode(ids) for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             names=[*batch.schema.names, "sp_text"])

    base = encoded.drop("sp_text")
    schema = encoded.drop("sp_text").schema.add("sp_text", "string")  # of a frame of its own: add() changes it in place
    return base.mapInArrow(run, schema)


def digests(docs: DataFrame, model_path: str, key: str = "doc_id", text_col: str = "text",
            ids_out: bool = False) -> DataFrame:
    """Per row: n_tokens, ids_sha256 and decoded_sha256 of a full encode-decode round trip, spans_sha256, and sp_ids with ``ids_out``.

    spans_sha256 is of begin and end (little-endian 64-bit) of each piece in turn, the end id left out.
    """
    def rows(text):
        e = encoder(model_path)
        ids, spans = e.aligned(text)
        ids = ids + [e.sp.eos_id()]
        named = " ".join(map(e.decimal.__getitem__, ids))
        found = (len(ids), hashlib.sha256(named.encode()).hexdigest(), hashlib.sha256(e.decode(ids).encode()).hexdigest(),
                 hashlib.sha256(spans.astype("<i8").tobytes()).hexdigest())
        return found + (ids,) if ids_out else found

    schema = ("n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"
              + (", sp_ids array<int>" if ids_out else ""))
    return _mapped(docs, text_col, rows, schema, [key])
