"""Phrases, packing and resampling against plain Python on awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tribewise.llm import op11_collocations as op11, op12_packing as op12, op13_resampling as op13
from tribewise.llm.queries import WORD_MODEL

from helpers import documents, no_documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- op11

def brute_phrases(rows, max_words=3, min_count=10, percent=50, top=2000):
    count, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = tuple(re.findall(r"[^\x20\x09]+", piece))
            total[lang] += len(ws)
            for k in range(1, max_words + 1):
                for i in range(len(ws) - k + 1):
                    count[lang, ws[i:i + k]] += 1
    found = {g: a for g, a in count.items() if a >= min_count and len(g[1]) >= 2}
    out = {}
    for (lang, g), a in found.items():
        if any(l2 == lang and len(h) > len(g) and 100 * b >= percent * a and any(h[i:i + len(g)] == g for i in range(len(h) - len(g) + 1))
               for (l2, h), b in found.items()):
            continue
        score, k = min((1000000 * a * a // (count[lang, g[:k]] * count[lang, g[k:]]), k) for k in range(1, len(g)))
        out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), count[lang, g[:k]], count[lang, g[k:]]))
    return {(lang, i + 1, p.decode(), -a, l, r, total[lang], -s)
            for lang, rs in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rs)[:top])}


def phrase_rows(rng_seed=3):
    import random
    rng = random.Random(rng_seed)
    vocab = ["New", "york", "the", "of", "a", "é", "日本", "x-y", "'s", "CITY"]
    rows = []
    for i in range(500):
        ws = [rng.choice(vocab) for _ in range(rng.randrange(0, 30))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", " !? ", "\r\n"]) for w in ws)
        rows.append((text, rng.choice(["en", "en", "de", None])))
    rows += [("same " * 3000, "en"), (rows[0][0], "en"), (rows[0][0], "en"), (None, "en"), ("", None), (" .,\n", "en"), ("one", "fr")]
    return rows + rows[:20]


@pytest.mark.parametrize("max_words", [2, 3, 4])
def test_phrases_equal_brute_force(spark, max_words):
    rows = phrase_rows()
    docs = spark.createDataFrame([(t, g, 1, "x") for t, g in rows], "text string, lang string, n int, phrase string").repartition(3)
    got = {tuple(r) for r in op11.collocations(docs, max_words=max_words).collect()}
    assert got == brute_phrases(rows, max_words)
    assert len(got) > 10


def test_phrases_of_no_texts(spark):
    assert op11.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []


def test_scores_beyond_64_bits(spark):
    row = spark.sql("select (1000000 * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0))) s"
                    " from values (900000000001L, 900000000007L, 900000000009L) t(a, l, r)").head()
    assert row.s == 1000000 * 900000000001**2 // (900000000007 * 900000000009)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc\n"), max_size=40), min_size=1, max_size=6), st.integers(1, 3), st.integers(1, 4), st.integers(1, 9))
def test_parse_owns_every_position_once(texts, overlap, period, longest):
    tokens = pa.array([w for t in texts for w in t], pa.string())
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    first, end, last = op11.parse(tokens, starts, overlap, period, max(longest, overlap))
    owned = [p for a, b, z in zip(first, end, last) for p in range(a, b if z else b - overlap)]
    assert owned == list(range(len(tokens)))
    text_end = {p: e for s, e in zip(starts, starts[1:]) for p in range(s, e)}
    for a, b, z in zip(first, end, last):
        assert b <= text_end[a]
        for p in range(a, b if z else b - overlap):  # phrases of overlap + 1 words lie whole in their chunk
            assert min(p + overlap + 1, text_end[p]) <= b


# --- op12

def odd_texts():
    return ["", " ", "Hello <|ENDOFTEXT|> <|endoftext|> World<|endoftext|>x it's O'Neil'LL", "ÀÉ é é ́x", "İstanbul ΣΑΣ ΣΑΣ.", "a b c　d", "x\x1cy\x85z\x0b\x0cw",
            "日本語 テスト 한국어 ﬁ ①", "😀👍🏽 a‍b", "1234 5.6,7", "<|startoftext|> <|endof text|>", "tab\tnew\r\nline", "\x00 \x01a"]


def test_word_ids_equal_the_library():
    library, encoder = Tokenizer.from_file(WORD_MODEL), op12.WordEncoder(WORD_MODEL)
    texts = odd_texts()
    ids, counts = encoder.encode(pa.array(texts))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aB' \t\n.́  Σσé<|>endoftext1½ﬁ日😀‍\x1c\x85"), max_size=30), max_size=5))
def test_word_ids_equal_the_library_on_any_text(texts):
    library, encoder = _library(), op12.WordEncoder(WORD_MODEL)
    ids, counts = encoder.encode(pa.array(texts, pa.string()))
    assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids]
    assert "".join(s for t in texts for s in op12._steps(t, 3)) == "".join(texts)


def _library(kept=[]):
    if not kept:
        kept.append(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    return kept[0]


@pytest.mark.parametrize("step", [op12.STEP, 2000])
def test_packing(spark, monkeypatch, step):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    if step != op12.STEP:  # long texts in steps: the tasks' own code, run here
        class Task:
            @staticmethod
            def partitionId():
                return 0
        import pyspark
        monkeypatch.setattr(op12, "STEP", step)
        monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda: Task))
        batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([t or "" for _, t in rows])], ["key", "text"])
        cut = [r for b in op12._pieces([batch], WORD_MODEL, 64, 0) for r in b.to_pylist()]
        got = [(r["key"], r["piece"], r["start"], r["length"], r["ids"]) for r in cut]
        assert len({r["serial"] for r in cut}) == len(cut)
    else:
        packed = op12.pack(docs, WORD_MODEL, capacity=64, open_bins=16, group=40)
        cut = packed.collect()
        got = [(r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in cut]
        assert packed.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
        bins = {}
        for r in cut:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length, bytes(r.ids)))
        for parts in bins.values():
            parts.sort()
            assert [o for o, _, _ in parts] == [0, *np.cumsum([n for _, n, _ in parts])[:-1]]
            assert sum(n for _, n, _ in parts) <= 64
        total = sum(r.length for r in cut)
        assert len(bins) <= 1.1 * total / 64 + 5
        whole = {r.sequence_id: bytes(r.ids) for r in op12.sequences(packed).collect()}
        assert sorted(whole.values()) == sorted(b"".join(x for _, _, x in p) for p in bins.values())
        sums = op12.pack(docs, WORD_MODEL, ids_out=False, capacity=64)
        assert sorted(r.ids_crc32 for r in sums.collect()) == sorted(zlib.crc32(x) for *_, x in got)
    want = []
    for key, text in rows:
        ids = [*_library().encode(text or "", add_special_tokens=False).ids, 0]
        for i in range(0, len(ids), 64):
            want.append((key, i // 64, i, len(ids[i:i + 64]), np.array(ids[i:i + 64], "<u4").tobytes()))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_packing_nothing(spark):
    assert op12.pack(no_documents(spark), WORD_MODEL).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80), st.integers(1, 6))
def test_best_fit_takes_the_fullest_open_bin(lengths, limit):
    packer, free, opened = op12.BestFit(20, limit), {}, set()
    for length in lengths:
        at, offset = packer.place(length)
        fits = [free[b] for b in opened if free[b] >= length]
        if fits:
            assert at in opened and free[at] == min(fits)
        else:
            assert at not in free
            free[at] = 20
        assert offset == 20 - free[at]
        free[at] -= length
        opened = {b for found in packer.bins for b in found}
        assert len(opened) <= limit and all(b in packer.bins[free[b]] for b in opened)
        if free[at] and at not in opened:
            assert all(free[b] >= free[at] for b in opened)


# --- op13

def brute_resampled(docs, target, words, buckets, min_words, percent, seed=2024):
    def grams(text):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return ws, [zlib.crc32(" ".join(ws[i:i + k]).encode()) % buckets for k in range(1, words + 1) for i in range(len(ws) - k + 1)]

    s, t = (Counter(b for text in texts for b in grams(text)[1]) for texts in ([d[1] for d in docs], target))
    n_s, n_t = sum(s.values()), sum(t.values())
    out = []
    for key, text in docs:
        ws, fs = grams(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in fs]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append((key, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(ws)))
    pool = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = pool[:percent * len(pool) // 100]
    ranked = Counter()
    for i, r in enumerate(drawn):
        ranked[(r[0], r[3], i + 1)] += 1
    return out, ranked


@pytest.mark.parametrize("words,percent", [(1, 10), (2, 30), (3, 100)])
def test_resampling_equals_brute_force(spark, words, percent):
    docs = documents(spark, n=120).repartition(4)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    target = [rows[0][1], "w1 w2 w3 É日本", None, ""]
    got = op13.resampled(docs, spark.createDataFrame([(x,) for x in target], "text string"), words=words, buckets=500, percent=percent).collect()
    out, ranked = brute_resampled(rows, target, words, 500, 20, percent)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter(r[:4] for r in out)
    assert Counter((r.doc_id, r.score, r["rank"]) for r in got if r["rank"] is not None) == ranked


def test_resampling_empty_tables(spark):
    empty = no_documents(spark)
    assert op13.resampled(empty, empty).collect() == []
    rows = op13.resampled(documents(spark, n=8), empty).collect()
    assert len(rows) == 23 and all(r["rank"] is None or r.n_features >= 20 for r in rows)
