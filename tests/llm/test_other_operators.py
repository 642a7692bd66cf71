"""Sharding, search, archives, token files, SentencePiece, quality and the pipeline against plain versions."""

import base64
import gzip
import hashlib
import io
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import documents, no_documents
from pyspark.sql import functions as F

from tribewise.llm import (op2_sharding, op3_nndescent, op4_warc, op6_wavelet, op7_sentencepiece, op8_quality, words)

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a", "a  b\n c", "x\n\n y", "a \n b  ", "<|endoftext|> a <|endoftext|>b", "it's  'S  x \xa0 y", "\x1c a \x1f b",
       "é " * 5, "\t\t a\t b", "\x85 a", "a.b, c!?. x.", "é, ñ. ÷, ×. “q” , ‘s", "日本. 語,a", "1,000.5 x:y", "\n", ".", "ÿ.À!Ã?",
       "😀, y😀.z", "don't, can't.'s", "▁", "a▁ b", "\x00 a", "<s> </s> <0x41>", " " * 40 + "x"]


def test_quality_columns_named_like_ours(spark):
    docs = spark.createDataFrame([(i, f"good words {i}" if i % 2 else "junk !!", i % 2, "x") for i in range(40)], "doc_id long, text string, quality int, __text string")
    model = op8_quality.train(docs.select("doc_id", "text"), docs.select("doc_id", "quality"))
    assert {r["__text"] for r in op8_quality.score(docs, model).collect()} == {"x"}


# ---------------------------------------------------------------------- archives of large records

@pytest.mark.parametrize("sizes", [(200_000,), (300_000,), (600_000, 5), (5, 300_000, 7), (5_000_000, 1, 300_000, 262_144, 262_143)])
def test_members_of_any_size_end(sizes):
    rng = random.Random(1)
    parts = [bytes(rng.randrange(256) for _ in range(min(n, 1000))) * (n // min(n, 1000)) for n in sizes]
    raw = b"".join(gzip.compress(p, mtime=0) for p in parts)
    assert b"".join(op4_warc._blocks(io.BytesIO(raw))) == b"".join(parts)
    for cut in (1, len(raw) // 2):
        with pytest.raises(ValueError):
            b"".join(op4_warc._blocks(io.BytesIO(raw[:-cut])))


def test_round_trip_of_large_pages(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(10 ** 6)}" for _ in range(5000)]
    sizes = [300_000, 5_000_000, 20, 262_144, 300_000, 900_000] * 3 + [20_000_000]
    rows = [(i, f"http://x/{i}", (" ".join(words[i:]) + " " + str(i % 5)) * (n // 30_000) if n > 100 else f"small {i}") for i, n in enumerate(sizes)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in op4_warc.round_trip(pages).collect()}
    assert got == {i: (len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()) for i, _, h in rows}


# ------------------------------------------------------------------------- words

def test_word_hashes_follow_words():
    rng = random.Random(3)
    text = "".join(rng.choice("abAB \t\n\x0b\x0cé0") for _ in range(5000)) + "y" * 3000
    data = np.frombuffer(text.encode(), np.uint8)
    split = text.encode().split()
    for step in (64, 1 << 16):
        hashes, starts, ends = words.word_hashes(data, step=step)
        assert [bytes(data[a:b]) for a, b in zip(starts, ends)] == split
        names = {}
        assert all(names.setdefault(w, h) == h for w, h in zip(split, hashes.tolist()))
        assert len(set(names.values())) == len(names)
    folded, _, _ = words.word_hashes(data, fold=True)
    assert len(set(folded.tolist())) == len({w.translate(bytes.maketrans(b"AB", b"ab")) for w in split})
    sums = words.run_sums(hashes, 0xD1342543DE82EF95)
    at = np.arange(len(split) - 2)
    runs = words.runs(sums, at, at + 3)
    assert len(set(runs.tolist())) == len({tuple(split[i:i + 3]) for i in at})
    values = np.array([5, 3, 3, 9, 1, 1, 7], np.uint64)
    assert [words.window_argmin(values, w).tolist() for w in (1, 3)] == [list(range(7)), [1, 1, 4, 4, 4]]


# ---------------------------------------------------------------------- sharding

def test_sharding(spark):
    docs = documents(spark)
    rows = op2_sharding.sharded(docs, n_shards=4, n_slots=64).collect()
    source = docs.collect()
    size = lambda t: len((t or "").encode())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (r.doc_id, size(r.text) + 1, zlib.crc32((r.text or "").encode())) for r in source)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert op2_sharding.sharded(no_documents(spark)).count() == 0


def test_slot_map_versions(spark, tmp_path):
    loads = [(s, (s * 37) % 101 + 1, 3) for s in range(256)]
    one = op2_sharding.first_map(loads, 8)
    per = lambda m, n: [sum(b for s, b, _ in loads if m[s] == k) for k in range(n)]
    assert max(per(one, 8)) - min(per(one, 8)) <= 2
    two = op2_sharding.rebalanced(one, loads, 9)
    moved = [s for s in one if one[s] != two[s]]
    assert moved and all(two[s] == 8 for s in moved) and max(per(two, 9)) <= 1.1 * sum(per(two, 9)) / 9 + 101
    back = op2_sharding.rebalanced(two, loads, 8)
    assert set(back.values()) == set(range(8)) and all(back[s] == two[s] for s in two if two[s] < 8 and back[s] == two[s])
    path = str(tmp_path / "map")
    op2_sharding.store_map(spark, path, 1, one, loads)
    op2_sharding.store_map(spark, path, 2, two, loads)
    newest = {r.virtual_slot: r.shard for r in op2_sharding.read_map(spark, path).collect()}
    assert newest == two and {r.shard for r in op2_sharding.read_map(spark, path, 1).collect()} == set(range(8))


# ------------------------------------------------------------------------ search

def test_neighbours(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((6, 16))
    x = np.concatenate([centres[i % 6] + 0.3 * rng.standard_normal(16) for i in range(420)]).reshape(420, 16)
    x[100:160] = x[100]  # a group of equal vectors
    rows = [(i, [float(v) for v in x[i]], "a") for i in range(420)]
    rows += [(2000, None, "a"), (2020, [0.0] * 16, "a"), (2040, [float("nan")] * 16, "b"), (2060, [1.0, None] * 8, "b"), (2080, [], "c"),
             (2100, [1.0], "c"), (None, rows[0][1], "c")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string")
    got = op3_nndescent.neighbours(table, lambda i: i % 20 == 0, build={"block": 96, "degree": 24}).collect()
    found, hits = {}, 0
    for r in got:
        found.setdefault(r.query_id, []).append(r)
    assert sorted(found) == list(range(0, 420, 20))
    for q, mine in found.items():
        mine.sort(key=lambda r: r.rank)
        assert [r["rank"] for r in mine] == list(range(1, 21))
        scores = x @ x[q]
        assert all(abs(r.score - scores[r.vec_id]) < 1e-9 for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        order = sorted((i for i in range(420) if i != q), key=lambda i: (-scores[i], i))[:20]
        hits += len(set(order) & {r.vec_id for r in mine})
    assert hits >= 0.9 * 20 * len(found)


def test_rounds_run_at_every_size(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 12))
    turns, meet = [], op3_nndescent._met
    monkeypatch.setattr(op3_nndescent, "_met", lambda *a: (turns.append(a[-1]), meet(*a))[1])
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = op3_nndescent.neighbours(table, lambda i: i % 20 == 0).collect()
    assert turns and turns == list(range(len(turns)))
    truth = {q: set(sorted((i for i in range(300) if i != q), key=lambda i: (-(x @ x[q])[i], i))[:20]) for q in range(0, 300, 20)}
    assert sum(r.vec_id in truth[r.query_id] for r in got) >= 0.9 * 20 * len(truth)


def test_neighbours_of_few(spark):
    schema = "vec_id long, embedding array<float>"
    assert op3_nndescent.neighbours(spark.createDataFrame([], schema), lambda i: i >= 0).count() == 0
    few = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(4)], schema)
    got = op3_nndescent.neighbours(few, lambda i: i == 0).collect()
    assert sorted((r["rank"], r.vec_id) for r in got) == [(1, 3), (2, 2), (3, 1)]
    alone = spark.createDataFrame([(0, [1.0])], schema)
    assert op3_nndescent.neighbours(alone, lambda i: i == 0).count() == 0


# ---------------------------------------------------------------------- archives

def test_archives(spark):
    big = "<p>" + "abc é" * 20000
    rows = [(1, "http://a/é b", "<p>x"), (2, None, "<p>x"), (3, "http://c", None), (4, "u", ""), (5, "u\r\nX: y", big), (6, "v", big),
            (7, "w", "tail\r\n\r\nWARC/1.1\r\n\r\n"), (None, "n", "<p>x"), (6, "v", big), (8, "z", "only")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, record int")
    got = op4_warc.round_trip(pages, chunk_bytes=1000).collect()
    data = [(h or "").encode() for _, _, h in rows]
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == Counter(
        (k, len(b), digest(b)) for (k, _, _), b in zip(rows, data))
    largest = {b: max(k for (k, _, _), c in zip(rows, data) if c == b and k is not None) for b in data}
    names = {digest(b): k for b, k in largest.items()}
    for d, top in names.items():
        same = [r for r in got if r.payload_digest == d]
        response = [r for r in same if r.record_type == "response"]
        assert [r.page_id for r in response] == [top] and response[0].refers_to is None
        assert all(r.refers_to == top for r in same if r.record_type == "revisit")
    large = op4_warc.round_trip(pages, min_bytes=5).filter("record_type = 'revisit'").collect()
    assert {r.payload_digest for r in large} == {digest(big.encode())}
    assert op4_warc.round_trip(pages.limit(0)).count() == 0


def test_archive_with_damage_raises(tmp_path):
    archive = op4_warc._Archive(f"file:{tmp_path}", "a")
    archive.begin({"n_bytes": 5, "url": None, "record": 1, "page_id": 1, "revisit": False, "refers_to": None, "running_digest": "X"})
    archive.chunk(b"hello")
    archive.end()
    path, n, size = archive.close()
    raw = (tmp_path / "a.warc.gz").read_bytes()
    assert n == 1 and size == len(raw)
    head, digest, length = next(op4_warc.records(io.BytesIO(raw)))
    assert digest == base64.b32encode(hashlib.sha1(b"hello").digest()).decode() and length == 5
    with pytest.raises((ValueError, StopIteration, RuntimeError)):
        list(op4_warc.records(io.BytesIO(raw[: len(raw) // 2])))


# ------------------------------------------------------------------- token files

def test_piece_cache_equals_the_library(spark):
    from tokenizers import Tokenizer
    library, cache = Tokenizer.from_file(BYTES), op6_wavelet.PieceCache(BYTES, limit=50)
    texts = ODD + [r.text or "" for r in documents(spark, n=20).collect()]
    for _ in range(2):
        for a in range(0, len(texts), 7):
            part = texts[a:a + 7]
            ids, sizes = cache.encode(pa.array(part))
            assert ids.tolist() == [i for e in library.encode_batch(part, add_special_tokens=False) for i in e.ids]
            assert len(sizes) == len(part)


def test_wavelet_file():
    rng = np.random.default_rng(2)
    ids = np.concatenate((rng.integers(0, 50257, 9000), np.full(700, 13), [0, 50256])).astype(np.uint32)
    for part in (ids, ids[:1], ids[:0]):
        shard = op6_wavelet.WaveletFile(op6_wavelet.dump(part, [None, 5], np.array([0, len(part)]), 16))
        assert (shard.tokens() == part).all() and shard.documents()[0] == [None, 5]
        for i in range(0, len(part), 401):
            symbol = int(part[i])
            where = np.flatnonzero(part == symbol)
            assert shard.access(i) == symbol and shard.count(symbol) == len(where)
            assert shard.count(symbol, 100, 9300) == (part[100:9300] == symbol).sum()
            assert [shard.locate(symbol, k) for k in (0, len(where) - 1)] == [where[0], where[-1]]
        with pytest.raises(IndexError):
            shard.locate(60000 % 65536, 0)


def test_token_files(spark):
    from tokenizers import Tokenizer
    docs = documents(spark, n=25)
    got = sorted(op6_wavelet.round_trip(docs, BYTES, shard_bytes=20_000, shard_tokens=3000).collect(), key=lambda r: r.start)
    library = Tokenizer.from_file(BYTES)
    want = Counter()
    for r in docs.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        want[r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4"))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.concatenate(([0], np.cumsum([r.n_tokens for r in got])[:-1])).tolist()
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert keys == sorted(keys)
    assert op6_wavelet.round_trip(no_documents(spark), BYTES).count() == 0


# ----------------------------------------------------------------- SentencePiece

def test_sentencepiece_spans():
    e = op7_sentencepiece.Encoder(PIECES)
    for text in [*ODD, "The thtion of. " * 30]:
        spans, proto = e.spans(text), e.sp.encode(text, return_type="proto")
        data = text.encode()
        assert [s[0] for s in spans] == [p.id for p in proto.pieces] == e.ids(text)
        assert all(a <= b for _, a, b in spans) and all(x[2] == y[1] for x, y in zip(spans, spans[1:]))
        if spans:
            assert spans[0][1] == 0 and spans[-1][2] == len(data)


def test_sentencepiece_columns_named_like_ours(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, "y")], "doc_id long, text string, __text string")
    got = op7_sentencepiece.encode(docs, PIECES).collect()
    assert {(r.doc_id, r["__text"], len(r.sp_ids) > 0) for r in got} == {(1, "x", True), (2, "y", True)}


def trie(keys):
    """A compiled character map of a few one- and two-byte keys, laid out by hand."""
    blob, at = b"", {}
    for k, v in keys.items():
        at[k] = len(blob)
        blob += v.encode() + b"\0"
    units = [0] * 2048
    used, free_block = set(), [256]

    def place(node, prefix):
        children = sorted({k[len(prefix)] for k in keys if k.startswith(prefix) and len(k) > len(prefix)})
        base = free_block[0]
        free_block[0] += 256
        units[node] = (units[node] & 0x1FF) | ((node ^ base) << 10)
        for c in children:
            units[base ^ c] = c
        if prefix in keys:
            units[node] |= 1 << 8
            units[base] = 0x80000000 | at[prefix]
        used.update(base ^ c for c in children)
        for c in children:
            place(base ^ c, prefix + bytes([c]))

    place(0, b"")
    return struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + blob


def test_normaliser_takes_the_longest_prefix_and_keeps_offsets():
    charsmap = trie({b"a": "x", b"ab": "yy", "é".encode(): "e", b"\t": " "})
    norm = op7_sentencepiece.Normaliser(charsmap, add_dummy_prefix=False, remove_extra_whitespaces=False, escape_whitespaces=False)
    assert norm("abaécb\t") == (b"yyxecb ", [0, 0, 2, 3, 5, 6, 7, 8])
    squeezed = op7_sentencepiece.Normaliser(charsmap, add_dummy_prefix=True, remove_extra_whitespaces=True)
    text, source = squeezed("  ab \t c ")
    assert text.decode() == "▁yy▁c" and len(source) == len(text) + 1
    assert source[3:5] == [2, 2] and source[-2] == 7


def test_sentencepiece_columns(spark):
    docs = documents(spark, n=15)
    e = op7_sentencepiece.Encoder(PIECES)
    got = op7_sentencepiece.digests(docs, PIECES, ids_out=True).collect()
    want = Counter()
    for r in docs.collect():
        ids = e.sp.encode(r.text or "") + [2]
        want[r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
             hashlib.sha256(e.sp.decode(ids).encode()).hexdigest(), tuple(ids)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.sp_ids)) for r in got) == want
    both = op7_sentencepiece.decode(op7_sentencepiece.encode(docs.filter("length(text) < 900"), PIECES, spans=True), PIECES)
    for r in both.collect():
        assert r.sp_text == e.sp.decode(r.sp_ids) and [s.id for s in r.sp_spans] == r.sp_ids[:-1]
    assert op7_sentencepiece.digests(no_documents(spark), PIECES).count() == 0


def test_sentencepiece_query_and_stage_carry_spans(spark):
    """The digests are of the spans that the library's own pieces give over the plain normaliser."""
    import corpus_pipeline
    docs = documents(spark, n=15)
    e = op7_sentencepiece.Encoder(PIECES)
    want = Counter()
    for r in docs.collect():
        text = r.text or ""
        norm, source = e.normaliser(text)
        fast, offsets = e.normaliser.aligned(text)
        assert (fast, offsets.tolist()) == (norm, source)
        at, flat = 0, b""
        for p in e.sp.encode(text, return_type="proto").pieces:
            n = 1 if e.sp.is_byte(p.id) else len(p.piece.encode())
            assert e.sp.is_byte(p.id) or norm[at:at + n] == p.piece.encode()
            flat += struct.pack("<qq", source[at], source[at + n])
            at += n
        want[r.doc_id, hashlib.sha256(flat).hexdigest()] += 1
    got = op7_sentencepiece.digests(docs, PIECES)
    assert Counter((r.doc_id, r.spans_sha256) for r in got.collect()) == want
    assert "spans_sha256" in corpus_pipeline.sentencepiece(spark, docs, "").columns


# ----------------------------------------------------------------------- quality

def test_gradients_of_the_attention_model():
    rng = np.random.default_rng(4)
    x, owner, y = rng.standard_normal((9, 5)), np.array([0, 0, 0, 1, 1, 2, 2, 2, 2]), np.array([1.0, 0.0, 1.0])
    model, weight = op8_quality.Model.start(x), np.array([1.0, 2.0, 0.5])

    def loss():
        p = model.scores(x, owner, 3)
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean()

    got = model.gradients(model.forward(x, owner, 3), owner, y, weight)
    for name, g in got.items():
        part = model.parts[name].reshape(-1)
        for k in range(0, part.size, 7):
            keep = part[k]
            part[k] = keep + 1e-6
            up = loss()
            part[k] = keep - 1e-6
            assert math.isclose((up - loss()) / 2e-6, g.reshape(-1)[k], rel_tol=1e-4, abs_tol=1e-7), name
            part[k] = keep


def test_quality_by_held_out_accuracy(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        w = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(70, 300))]
        if i % 4 == 0:  # one junk passage among clean ones
            at = rng.randrange(len(w) - 60)
            w[at:at + 60] = [f"{x.upper()}!!" for x in w[at:at + 60]]
        rows.append((i, " ".join(w), "x"))
        labels.append((i, int(i % 4 != 0), 5))
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, "w " * 30000, "x")]
    labels += [(7777, 1, 1), (3, None, 1), (None, 1, 1), (4, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality_score string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, text int")
    model = op8_quality.train(docs, table.filter("doc_id % 3 != 1"), sample=200)
    got = {r.doc_id: r.quality_score for r in op8_quality.score(docs, model).collect()}
    held = [i for i in range(400) if i % 3 == 1]
    assert sum((got[i] >= 0.5) == (i % 4 != 0) for i in held) >= 0.95 * len(held)
    assert len(got) == 403 and all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001]
    none = op8_quality.train(docs, table.limit(0))
    assert {r.quality_score for r in op8_quality.score(docs, none).collect()} == {0.5}
    assert op8_quality.score(no_documents(spark), model).count() == 0


# ---------------------------------------------------------------------- pipeline

def test_pipeline_stages(spark):
    import sys
    from pathlib import Path
    sys.path.insert(0, str(Path(__file__).parents[2]))
    import corpus_pipeline
    sf = "/root/testdata/sf0.001"
    if not Path(sf).exists():
        pytest.skip("driver tables not present")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = op2_sharding.written(stage(spark, docs, sf), "test")
        assert docs.columns == columns, name
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= {r.doc_id for r in before.select("doc_id").collect()}
        kept[name] = set(ids)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in last} == kept["decontaminate"]
    assert docs.filter(F.col("n_chars") != F.length("text")).count() == 0
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept["quality"] for d in clean) >= 0.95 * len(clean)
