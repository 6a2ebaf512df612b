"""Quality of texts by attention-based multiple-instance learning.

A text is a bag of passages.  Each passage is encoded from its own measures; gated attention gives it a
weight, and the weighted sum of the encodings is scored.  Only whole texts have labels, from which the
encoder, the attention and the score are learned together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftgraph.llm import _text as T
from weftgraph.llm._labels import fitted, scored, training_rows

#: Words of a passage; sizes of its encoding and of the attention's inner layer.
PASSAGE, HIDDEN, INNER = 64, 16, 8
_SYMBOL, _MARK = T.table(b"#*$%&|<>"), T.table(b".,;:?'\"()-")
_CLASSES = np.zeros((256, 6), np.float32)
_CLASSES[65:91, 0] = _CLASSES[48:58, 1] = 1
_CLASSES[_SYMBOL, 2] = _CLASSES[_MARK, 3] = 1
_CLASSES[33, 4] = 1
_CLASSES[128:, 5] = 1
MEASURES = 6 + 8


def passages(column):
    """(row range, measures of each passage, offsets of the rows in them); a text without words has one."""
    for lo, hi, data, off in T.texts(column):
        s, e, w = T.words(data, off, T.WHITE)
        n = np.diff(w)
        many = np.maximum(1, -(-n // PASSAGE))
        cut = np.r_[0, np.cumsum(many)]
        x = np.zeros((cut[-1], MEASURES))
        if len(s):
            row = np.repeat(np.arange(hi - lo), n)
            at = cut[row] + (np.arange(len(s)) - w[row]) // PASSAGE
            size = np.bincount(at, minlength=cut[-1])
            safe = np.maximum(1, size)
            length = e - s
            chars = np.maximum(1, np.bincount(at, length, cut[-1]))
            for c in range(6):
                total = np.r_[0, np.cumsum(_CLASSES[data, c], dtype=np.float64)]
                x[:, c] = np.bincount(at, total[e] - total[s], cut[-1]) / chars
            h = T.word_hashes(data, s, e)
            same = np.r_[False, (h[1:] == h[:-1]) & (row[1:] == row[:-1])]
            order = np.lexsort((h, at))
            new = np.r_[True, (h[order][1:] != h[order][:-1]) | (at[order][1:] != at[order][:-1])]
            # up to the next word of the row, or to its end
            last = np.r_[row[1:] != row[:-1], True]
            white = np.where(last, off[row + 1], np.r_[s[1:], len(data)]) - e
            x[:, 6] = np.where(size > 0, chars / safe / 10, 0)
            x[:, 7] = np.bincount(at, same, cut[-1]) / safe
            x[:, 8] = np.bincount(at[order], new, cut[-1]) / safe
            x[:, 9] = np.bincount(at, length == 1, cut[-1]) / safe
            x[:, 10] = np.bincount(at, length > 20, cut[-1]) / safe
            x[:, 11] = np.log1p(size) / 4
            x[:, 12] = np.log1p(n)[np.repeat(np.arange(hi - lo), many)] / 8
            x[:, 13] = np.minimum(np.bincount(at, white, cut[-1]) / safe, 4)
        yield lo, hi, x, cut


def _features(batches):
    for b in batches:
        out = [p.astype("<f4").tobytes() for _, _, x, cut in passages(b.column("text")) for p in np.split(x, cut[1:-1])]
        yield pa.RecordBatch.from_arrays([b.column("dkey"), b.column("y"), pa.array(out, pa.binary())], names=["dkey", "y", "x"])


class Attention:
    """h = tanh(E x); weight ~ exp(a . (tanh(V h) * sigmoid(U h))); score = sigmoid(s . sum of weight h)."""

    def __init__(self):
        r = np.random.default_rng(3)
        self.mean, self.scale = np.zeros(MEASURES), np.ones(MEASURES)
        shapes = {"E": (MEASURES + 1, HIDDEN), "V": (HIDDEN, INNER), "U": (HIDDEN, INNER), "a": (INNER,), "s": (HIDDEN,), "b": (1,)}
        self.p = {k: r.normal(0, 0.3, v) if k != "b" else np.zeros(1) for k, v in shapes.items()}
        self.known = False

    def forward(self, x: np.ndarray, cut: np.ndarray):
        p, start = self.p, cut[:-1]
        row = np.repeat(np.arange(len(start)), np.diff(cut))
        x = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        h = np.tanh(x @ p["E"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (v * u) @ p["a"]
        w = np.exp(e - np.maximum.reduceat(e, start)[row])
        w /= np.add.reduceat(w, start)[row]
        z = np.add.reduceat(w[:, None] * h, start)
        return x, h, v, u, w, z, row, 1 / (1 + np.exp(-np.clip(z @ p["s"] + p["b"][0], -30, 30)))

    def gradient(self, x: np.ndarray, cut: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x, h, v, u, w, z, row, score = self.forward(x, cut)
        g = (score - y) / len(y)
        dz = g[:, None] * p["s"]
        dw = (h * dz[row]).sum(1)
        de = w * (dw - np.add.reduceat(w * dw, cut[:-1])[row])
        dv, du = de[:, None] * p["a"] * u * (1 - v**2), de[:, None] * p["a"] * v * u * (1 - u)
        dh = w[:, None] * dz[row] + dv @ p["V"].T + du @ p["U"].T
        return {"s": z.T @ g, "b": np.array([g.sum()]), "a": (v * u).T @ de, "V": h.T @ dv, "U": h.T @ du, "E": x.T @ (dh * (1 - h**2))}

    def score(self, column) -> np.ndarray:
        out = [np.empty(0)]
        for lo, hi, x, cut in passages(column):
            out.append(self.forward(x, cut)[-1] if self.known else np.full(hi - lo, 0.5))
        return np.concatenate(out)


def fit(table: pa.Table | None, epochs: int = 30) -> Attention:
    m = Attention()
    if table is None or not len(table):
        return m
    y = table.column("y").to_numpy().astype(float)
    bags = [np.frombuffer(x, "<f4").reshape(-1, MEASURES).astype(float) for x in table.column("x").to_pylist()]
    every = np.concatenate(bags)
    m.mean, m.scale, m.known = every.mean(0), every.std(0) + 1e-3, True
    r, t = np.random.default_rng(4), 0
    one, two = ({k: np.zeros_like(v) for k, v in m.p.items()} for _ in range(2))
    for epoch in range(epochs):
        for rows in np.array_split(r.permutation(len(y)), max(1, len(y) // 64)):
            t += 1
            g = m.gradient(np.concatenate([bags[i] for i in rows]), np.r_[0, np.cumsum([len(bags[i]) for i in rows])], y[rows])
            rate = 0.01 if epoch < epochs * 2 // 3 else 0.002
            for k, d in g.items():
                d = d + 1e-5 * m.p[k]
                one[k] = 0.9 * one[k] + 0.1 * d
                two[k] = 0.99 * two[k] + 0.01 * d**2
                m.p[k] -= rate * (one[k] / (1 - 0.9**t)) / (np.sqrt(two[k] / (1 - 0.99**t)) + 1e-8)
    return m


def quality_model(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, modulus: int = 4, held_out: int = 2, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= ``threshold``) of each row of ``docs``
    (doc_id, text); ``labels`` (doc_id, quality) teach, and nothing but the text is scored.

    The model is fitted on at most ``max_rows`` labelled rows, never on those with crc32(doc_id) mod
    ``modulus`` equal to ``held_out``.  A null or empty text is one passage without words.  A row with a
    null id is not held out.  Without labels every score is 0.5.  Rows that repeat get the same score.
    """
    rows = training_rows(docs, labels, "quality", modulus, held_out, max_rows)
    model = docs.sparkSession.sparkContext.broadcast(fitted(rows, _features, "dkey long, y int, x binary", fit))
    return scored(docs, lambda column: model.value.score(column), modulus, held_out, threshold)
