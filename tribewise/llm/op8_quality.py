"""Quality classifier: gated attention over the passages of a document.

A document is a bag of passages (``PASSAGE`` words each).  A passage becomes a
row of shape features (what its bytes and words look like, never which
document, source or language it is from), an encoder turns the row into a
vector, gated attention weighs the passages of the bag, and the weighted sum is
scored.  Encoder, attention and score are learned together from document
labels alone; no passage is labelled.

Fitting uses a bounded sample (``SAMPLE`` labelled documents, the first by a
hash of their id; whole texts) in one task.  Scoring runs over every whole text
where it lies, with the model (a few thousand numbers) in the closure.

Cases: null text counts as empty, which is a bag of one empty passage and has a
score; labels without a document, and null labels, are not used; of several
labels of an id the smallest counts, of several texts of an id the smallest is
learned from; without labelled rows every score is 0.5; repeated rows have equal
scores; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .words import words_of

PASSAGE, SAMPLE, HIDDEN, GATES, SHAPES = 64, 4000, 24, 12, 64
EPOCHS, BATCH, RATE, DECAY = 30, 64, 0.01, 1e-4

#: Class of a byte: 0 other, 1 a-z, 2 A-Z, 3 digit, 4 .,;:?' , 5 blank, 6 line end, 7 UTF-8 beyond ASCII,
#: 8 ! 9 brackets and quotes 10 | 11 the other signs
_CLASS = np.zeros(256, np.int64)
_CLASS[33:127] = 11
for _chars, _k in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3),
                   (b".,;:?'", 4), (b" ", 5), (b"\n\r", 6), (b"!", 8), (b"()[]{}<>\"", 9), (b"|", 10)):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 7
N_CLASS = 12
N_FEATURES = N_CLASS + SHAPES + 5


def features(texts) -> tuple[np.ndarray, np.ndarray]:
    """(passage features, passage -> row) for an Arrow string array; every text has a passage."""
    hashes, starts, ends, first, data, offsets = words_of(texts)
    n_words = np.diff(first)
    per_text = np.maximum(1, -(-n_words // PASSAGE))
    owner = np.repeat(np.arange(len(n_words)), per_text)
    n = len(owner)
    base = np.concatenate(([0], np.cumsum(per_text)[:-1]))
    of_text = np.repeat(np.arange(len(n_words)), n_words)
    passage = base[of_text] + (np.arange(len(hashes)) - first[of_text]) // PASSAGE
    words = np.bincount(passage, minlength=n).astype(float)
    # a passage's bytes go from the start of its first word (of the text, for its first passage) to the next passage
    begin = offsets[owner].copy()
    inner = np.flatnonzero(np.arange(n) != base[owner])
    begin[inner] = starts[first[owner[inner]] + (inner - base[owner[inner]]) * PASSAGE]
    size = np.diff(np.concatenate((begin, offsets[-1:])))
    kinds = _CLASS[data]
    counts = np.bincount(np.repeat(np.arange(n) * N_CLASS, size) + kinds, minlength=n * N_CLASS).reshape(n, N_CLASS)
    out = np.zeros((n, N_FEATURES))
    out[:, :N_CLASS] = counts / np.maximum(1, size)[:, None]
    if len(hashes):
        length = np.minimum(ends - starts, 15)
        shape = ((kinds[starts] * N_CLASS + kinds[ends - 1]) * 16 + length) * 40503 >> 4 & (SHAPES - 1)
        bag = np.bincount(passage * SHAPES + shape, minlength=n * SHAPES).reshape(n, SHAPES)
        out[:, N_CLASS:N_CLASS + SHAPES] = bag / np.maximum(1, words)[:, None]
        again = np.zeros(len(hashes), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
        order = np.lexsort((hashes, passage))
        h, p = hashes[order], passage[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (p[1:] != p[:-1])
        out[:, -5] = np.bincount(passage, again, n) / np.maximum(1, words)
        out[:, -4] = np.bincount(p, new, n) / np.maximum(1, words)
        out[:, -3] = np.bincount(passage, ends - starts, n) / np.maximum(1, words) / 10
    out[:, -2] = words / PASSAGE
    out[:, -1] = words == 0
    return out, owner


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Encoder, gated attention and score; ``parts`` are plain arrays."""

    def __init__(self, parts: dict[str, np.ndarray] | None = None):
        self.parts = parts

    @classmethod
    def start(cls, x: np.ndarray, seed: int = 1):
        rng = np.random.Generator(np.random.PCG64(seed))
        draw = lambda *s: rng.standard_normal(s) / np.sqrt(s[0])
        return cls({"mean": x.mean(0), "scale": 1 / (x.std(0) + 1e-3), "W": draw(x.shape[1], HIDDEN), "b": np.zeros(HIDDEN),
                    "V": draw(HIDDEN, GATES), "U": draw(HIDDEN, GATES), "w": draw(GATES), "c": draw(HIDDEN), "d": np.zeros(1)})

    def forward(self, x: np.ndarray, owner: np.ndarray, n: int) -> dict:
        """Scores of n bags; owner says which bag a passage is in (ascending, every bag has a passage)."""
        p = self.parts
        s = {"x": np.clip((x - p["mean"]) * p["scale"], -8, 8)}
        s["h"] = np.tanh(s["x"] @ p["W"] + p["b"])
        s["v"], s["u"] = np.tanh(s["h"] @ p["V"]), _sigmoid(s["h"] @ p["U"])
        raw = (s["v"] * s["u"]) @ p["w"]
        starts = np.searchsorted(owner, np.arange(n))
        weight = np.exp(raw - np.maximum.reduceat(raw, starts)[owner])
        s["a"] = weight / np.add.reduceat(weight, starts)[owner]
        s["z"] = np.add.reduceat(s["a"][:, None] * s["h"], starts)
        s["score"] = _sigmoid(s["z"] @ p["c"] + p["d"][0])
        s["starts"] = starts
        return s

    def gradients(self, s: dict, owner: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        p = self.parts
        e = (s["score"] - y) * weight / len(y)
        dz = e[:, None] * p["c"]
        to_a = (s["h"] * dz[owner]).sum(1)
        mean = np.add.reduceat(s["a"] * to_a, s["starts"])
        ds = s["a"] * (to_a - mean[owner])
        dg = ds[:, None] * p["w"]
        dv, du = dg * s["u"] * (1 - s["v"] ** 2), dg * s["v"] * s["u"] * (1 - s["u"])
        dh = s["a"][:, None] * dz[owner] + dv @ p["V"].T + du @ p["U"].T
        dt = dh * (1 - s["h"] ** 2)
        return {"W": s["x"].T @ dt, "b": dt.sum(0), "V": s["h"].T @ dv, "U": s["h"].T @ du,
                "w": (s["v"] * s["u"]).T @ ds, "c": s["z"].T @ e, "d": np.array([e.sum()])}

    def scores(self, x, owner, n) -> np.ndarray:
        if self.parts is None:
            return np.full(n, 0.5)
        return self.forward(x, owner, n)["score"]


def fit(x: np.ndarray, owner: np.ndarray, y: np.ndarray, seed: int = 1) -> Model:
    """Adam over batches of bags; the two labels weigh the same in total."""
    if len(y) == 0:
        return Model()
    model, rng = Model.start(x, seed), np.random.Generator(np.random.PCG64(seed))
    share = np.clip(y.mean(), 0.02, 0.98)
    weight = np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share))
    at = np.searchsorted(owner, np.arange(len(y) + 1))
    m = {k: 0 * v for k, v in model.parts.items()}
    q, step = {k: 0 * v for k, v in model.parts.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for k in range(0, len(order), BATCH):
            bags = order[k:k + BATCH]
            rows = np.concatenate([np.arange(at[b], at[b + 1]) for b in bags])
            own = np.repeat(np.arange(len(bags)), at[bags + 1] - at[bags])
            s = model.forward(x[rows], own, len(bags))
            step += 1
            rate = RATE * (1 - epoch / EPOCHS) + 1e-4
            for name, g in model.gradients(s, own, y[bags], weight[bags]).items():
                g = g + DECAY * model.parts[name]
                m[name] = 0.9 * m[name] + 0.1 * g
                q[name] = 0.999 * q[name] + 0.001 * g * g
                model.parts[name] = model.parts[name] - rate * (m[name] / (1 - 0.9 ** step)) / (
                    np.sqrt(q[name] / (1 - 0.999 ** step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          sample: int = SAMPLE) -> Model:
    """Fit on the first ``sample`` labelled ids by hash; the sample is featurised where it lies and fitted in one task."""
    chosen = (labels.filter(F.col(key).isNotNull() & F.col(label_col).isNotNull())
              .groupBy(F.col(key).alias("_id")).agg(F.min(label_col).cast("double").alias("_y"))
              .orderBy(F.xxhash64("_id"), "_id").limit(sample))
    texts = (docs.join(F.broadcast(chosen), F.col(key) == F.col("_id"))  # ``sample`` rows
             .groupBy("_id", "_y").agg(F.min(text_or_empty(text_col)).alias("text")))

    def run(batches):
        import pickle

        import pyarrow as pa
        xs, owners, ys, ids, n = [], [], [], [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                x, owner = features(part.column("text"))
                xs.append(x)
                owners.append(owner + n)
                n += part.num_rows
                ys += part.column("_y").to_pylist()
                ids += part.column("_id").to_pylist()
        if not n:
            return
        x, owner, y = np.concatenate(xs), np.concatenate(owners), np.array(ys)
        rank = np.argsort(np.array(ids), kind="stable")  # the order of arrival must not matter
        place = np.empty(n, np.int64)
        place[rank] = np.arange(n)
        rows = np.argsort(place[owner], kind="stable")
        model = fit(x[rows], place[owner][rows], y[rank])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model.parts)], pa.binary())], names=["model"])

    import pickle
    found = texts.coalesce(1).mapInArrow(run, "model binary").collect()  # one row of a few KB
    return Model(pickle.loads(bytes(found[0]["model"]))) if found else Model()


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``quality_score`` added (a column of that name is replaced)."""
    text = "__text"
    while text in docs.columns:
        text += "_"
    base = docs.drop("quality_score").withColumn(text, text_or_empty(text_col))

    def run(batches):
        import pyarrow as pa

        from .common import text_runs
        for batch in batches:
            for a, b in text_runs(batch, text):
                part = batch.slice(a, b - a)
                x, owner = features(part.column(text))
                got = pa.array(model.scores(x, owner, b - a), pa.float64())
                rest = part.drop_columns([text])
                yield pa.RecordBatch.from_arrays([*rest.columns, got], names=[*rest.schema.names, "quality_score"])

    return base.mapInArrow(run, docs.drop("quality_score").schema.add("quality_score", "double"))
