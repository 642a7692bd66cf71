"""Small tables that hold the awkward cases."""

import random


def words(rng, n, size=4000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def documents(spark, n=60, seed=1, extra=True):
    """doc_id, text with nulls, empties, copies, near copies, repeated rows, shared passages and a long text."""
    rng = random.Random(seed)
    passage = words(rng, 60)
    rows = []
    for i in range(n):
        w = words(rng, rng.randrange(1, 160))
        if i % 7 == 0:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[: rng.randrange(36, 60)]
        text = " ".join(w)
        if i % 3 == 0:
            text = text.replace(" ", "\n", 5)
        rows.append((i, text))
    rows += [(n, rows[3][1]), (n + 1, rows[3][1]), (n + 2, rows[7][1] + " tail"), (n + 3, None), (n + 4, ""), (n + 5, "one"),
             (n + 6, "ONE"), (n + 7, " \t\n "), (n + 8, " ".join(words(rng, 20000))), (n + 9, "é ñ 日本 😀  x"),
             (n + 10, "same same same " * 40), (None, "no id here"), (None, rows[5][1])]
    rows += [rows[4], rows[4]]
    if extra:
        rows = [(*r, "x", 7, 1.5) for r in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, h1 string, n long, size double")
    return spark.createDataFrame(rows, "doc_id long, text string")


def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def split_words(text):
    return (text or "").encode().split()
