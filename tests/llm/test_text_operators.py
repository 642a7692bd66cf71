"""Line, substring and near-duplicate operators and decontamination against brute force."""

import hashlib
import itertools
import random
import math
from collections import Counter

import pytest
from helpers import documents, no_documents, split_words

from tribewise.llm import op1_lines, op5_substring, op9_minhash, op10_decontaminate

FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def brute_lines(rows, window=3, least=50, longest=6):
    """Deduped text per row: lines of a stretch that is heavy enough and also stands earlier go."""
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = set(), {}
    for key in order:
        if key[1] is None:
            out[key] = (0, 0, None)
            continue
        lines = key[1].split("\n")
        real = [i for i, x in enumerate(lines) if x.strip(" ")]
        weight = {i: max(-(-least // window), lines[i].strip(" ").count(" ") + 1, len(lines[i].strip(" ")) // 10) for i in real}
        gone = set()
        for s in range(len(real)):
            for e in range(s + 1, min(len(real), s + longest) + 1):
                part = real[s:e]
                if sum(weight[i] for i in part) < least:
                    continue
                content = tuple(lines[i] for i in part)
                if content in seen:
                    gone.update(part)
                seen.add(content)
        out[key] = (len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_lines(spark):
    rng = random.Random(4)
    sentence = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    a, b = "head\nalpha beta\n\ngamma\ndelta", "head\nother\nalpha beta\ngamma\ndelta\nfoot"
    long, thirty, twenty, heap = sentence(60), sentence(30), sentence(20), "日本語" * 200
    rows = [(1, a), (2, b), (3, "solo"), (4, "solo"), (5, None), (6, ""), (7, "x\nx\nx\nx\nx"), (8, "q\nalpha beta\nr"),
            (9, "\n".join(str(i % 50) for i in range(3000))), (None, "head\nzzz"), (2, b),
            (10, f"one\n{long}\ntwo"), (11, f"three\n  {long}  \nfour\n{long}\n{long}\nfive"), (12, f"{long}\nfoot"),
            (13, f"u\n{thirty}\n{twenty}\nv"), (14, f"y\n{thirty}\n \n{twenty}\nz"), (15, f"{thirty}\nother\n{twenty}"),
            (16, f"{heap}\nm"), (17, f"n\n{heap}"), (18, f"{thirty}\n{twenty}\np\nq"), (19, f"{thirty}\n{twenty}\np\nq")]
    pool = [sentence(rng.choice([1, 3, 17, 25, 33, 49, 50, 51])) for _ in range(12)]
    rows += [(20 + i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n_lines int, removed string")
    got = op1_lines.deduplicated(docs)
    assert got.columns == ["doc_id", "text", "removed", "n_lines", "n_removed", "deduped"]
    want = brute_lines(rows)
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_lines, r.n_removed, r.deduped) == want[(r.doc_id, r.text)], r.doc_id
    by_id = {r.doc_id: r for r in found}
    assert by_id[12].deduped == "foot" and by_id[14].deduped == "y\n \nz" and by_id[17].deduped == "n"
    assert [by_id[i].n_removed for i in (4, 8, 15, 19)] == [0, 0, 0, 4]  # short edge lines stay
    assert op1_lines.deduplicated(no_documents(spark)).count() == 0


def brute_substrings(texts, window):
    seen = Counter()
    split = [split_words(t) for t in texts]
    for w in split:
        seen.update(tuple(w[i:i + window]) for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


@pytest.mark.parametrize("window,seed", [(35, 8), (9, 4)])
def test_substrings(spark, window, seed):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = Counter((k, *x) for (k, _), x in zip(rows, brute_substrings([t for _, t in rows], window)))
    got = op5_substring.deduplicated(docs, window=window, seed=seed)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in got.collect()) == want
    assert sum(x[2] > 0 for x in want) > 5


def test_substrings_of_nothing(spark):
    assert op5_substring.deduplicated(no_documents(spark)).count() == 0


def brute_components(rows, k, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(FOLD).split()
        sets.append(frozenset(zip(*(w[i:] for i in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    groups = {}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(key)
    return [(key, len(s), key if not s else min((x for x in groups[find(i)] if x is not None), default=None))
            for i, ((key, _), s) in enumerate(zip(rows, sets))], len(groups)


def test_near_duplicates(spark):
    base = documents(spark, n=20)
    chain = [" ".join(f"c{j}" for j in range(i, i + 30)) for i in range(12)]  # neighbours link, ends do not
    docs = base.unionByName(spark.createDataFrame(
        [(500 - i, t, "y", 1, 0.0) for i, t in enumerate(chain)], base.schema))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, groups = brute_components(rows, 2, 80)
    got = op9_minhash.near_duplicates(docs)
    found = got.collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == Counter(want)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in found)
    left = op9_minhash.one_of_each(docs, words=2).collect()
    empty = sum(1 for _, n, _ in want if n == 0)
    assert len(left) == groups  # an empty document is a group of its own
    assert sum(not split_words(r.text) for r in left) == empty
    assert left[0].__fields__ == docs.columns


def test_near_duplicates_of_nothing(spark):
    assert op9_minhash.near_duplicates(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).count() == 2
    assert op9_minhash.one_of_each(no_documents(spark)).count() == 0


def test_components_of_long_paths(spark):
    path = [(i, i + 1) for i in range(40)] + [(100 + i * 2, 100) for i in range(1, 20)]
    got = {r.node: r.comp for r in op9_minhash.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, **{100 + 2 * i: 100 for i in range(1, 20)}}


def test_masks_hit_every_tolerated_overlap():
    masks = [op10_decontaminate.offsets(m) for m in op10_decontaminate.MASKS]
    for n in range(op10_decontaminate.MIN_WORDS, op10_decontaminate.WINDOW + 1):
        for wrong in itertools.combinations(range(n), n - math.ceil(op10_decontaminate.SIMILARITY * n)):
            bad = set(wrong)
            assert any(all(p + o not in bad for o in m) for m in masks for p in range(n - m[-1])), (n, wrong)


def brute_overlaps(docs, items, window=20, similarity=0.8, least=8):
    out = set()
    for d, text in docs:
        w = [x.lower() for x in op10_decontaminate.WORD.findall(text or "")]
        for k, item in items:
            v = [x.lower() for x in op10_decontaminate.WORD.findall(item or "")]
            size = min(window, len(v))
            if len(v) >= least and any(
                    sum(w[p + i] == v[q + i] for i in range(size)) >= math.ceil(similarity * size)
                    for q in range(len(v) - size + 1) for p in range(len(w) - size + 1)):
                out.add((d, k))
    return out


def test_overlaps(spark):
    docs = documents(spark, n=14)
    base = {r.doc_id: r.text for r in docs.collect()}
    source = base[7].split()
    other = ["z"] * 5
    items = [(1, " ".join(source[:24]).upper()), (2, " ".join(source[3:9] + other + source[14:40])), (3, "too short"), (4, None),
             (5, ", ".join(source[10:18])), (6, "nothing of this stands in any of the documents here"), (1, base[9][:200]), (7, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    small = docs.filter("length(text) < 2000 or text is null")
    want = brute_overlaps([(r.doc_id, r.text) for r in small.collect()], items)
    for block in (1_000_000, 30):
        got = op10_decontaminate.overlaps(small, bench, block_words=block)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    kept = op10_decontaminate.without_contaminated(small, bench)
    bad = {t for d, t in [(r.doc_id, r.text) for r in small.collect()] if brute_overlaps([(0, t)], items)}
    assert Counter(r.text for r in kept.collect()) == Counter(r.text for r in small.collect() if r.text not in bad)
    assert kept.columns == small.columns and want
    nothing = spark.createDataFrame([], bench.schema)
    assert op10_decontaminate.overlaps(small, nothing).count() == 0
    assert op10_decontaminate.overlaps(no_documents(spark), bench).count() == 0


def test_short_items_count_word_for_word_and_blocks_count_the_same_words(spark):
    docs = spark.createDataFrame([(1, "He asked: who wrote Faust? Nobody knew."), (2, "who, wrote it: Faust"), (3, "the word alone"), (4, None)],
                                 "doc_id long, text string")
    bench = spark.createDataFrame([(1, "Who wrote Faust?"), (2, "alone"), (3, "who wrote faust nobody knew it"), (4, " ?! ")],
                                  "item_id long, text string")
    got = op10_decontaminate.overlaps(docs, bench)
    assert {tuple(r) for r in got.collect()} == {(1, 1, 2, 0, 3, 3), (3, 2, 2, 0, 1, 1)}
    assert [r.doc_id for r in op10_decontaminate.without_contaminated(docs, bench).orderBy("doc_id").collect()] == [2, 4]
    signs = spark.createDataFrame([(i, "a+b-c*d=e/" * 20) for i in range(20)], "item_id long, text string")
    assert len(list(op10_decontaminate._blocks(signs, "item_id", "text", 400))) >= 5


def test_decontaminate_texts_of_few_words(spark):
    """Periodic texts have all diagonals as hits; the result is brute force's, and long ones end."""
    import time
    rng = random.Random(4)
    items = [(1, "same " * 25), (2, "one two " * 15), (3, " ".join(rng.choice("ab") for _ in range(30))), (4, "same same same"), (5, "x y z " * 9)]
    docs = [(1, "same " * 60), (2, "two one " * 30), (3, " ".join(rng.choice("ab") for _ in range(90))), (4, "u " * 9 + "same same same"),
            (5, "one two three " * 20), (6, "same " * 30 + "one two " * 30 + "x y z " * 20)]
    want = brute_overlaps(docs, items)
    for crowded in (0, 4, 10 ** 9):
        index = op10_decontaminate.Index(items, op10_decontaminate.MASKS, 20, 0.8, 8)
        was, op10_decontaminate.CROWDED = op10_decontaminate.CROWDED, crowded
        try:
            got = {(d, hit[0]) for d, text in docs for hit in index.overlaps(text)}
        finally:
            op10_decontaminate.CROWDED = was
        assert {x for x in got if x[1] != 4} == want and {d for d, k in got if k == 4} >= {1, 4, 6}
    index = op10_decontaminate.Index([(1, "same " * 2000)], op10_decontaminate.MASKS, 20, 0.8, 8)
    start = time.time()
    assert index.overlaps("same " * 20000) == [(1, 0, 0, 2000, 2000)] or index.overlaps("same " * 20000)[0][3:] == (2000, 2000)
    assert time.time() - start < 30
