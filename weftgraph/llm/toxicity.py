"""Toxicity of texts by a factorization machine over hashed terms.

Terms are a text's distinct words and the beginnings of its words, hashed into buckets.  Besides a weight
each bucket has a vector; the product of two vectors is the weight of the pair, so a pair of terms can
mean what neither means alone, at a cost linear in the number of terms.  Every bucket that the training
rows have gets a weight and a vector: nothing is chosen by what a term says alone.  Buckets without
training rows count for nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftgraph.llm import _text as T
from weftgraph.llm._labels import fitted, scored, training_rows

#: Buckets, and factors of each: the table that the model learns whole, and that scoring tasks get.
BUCKETS, FACTORS = 1 << 17, 8
#: Bytes of the beginnings of words that are terms; 0 is the whole word.
BEGINNINGS = (0, 4, 6)
#: Rows of a step; rates of weights and vectors; how many times the spread of its gradients a weight has to
#: be pulled from 0 by; pull of vectors to 0.
BATCH, RATE_W, RATE_V, THRESHOLD, DECAY_V = 64, 3.0, 0.05, 1.0, 0.05


def terms(column):
    """(row range, distinct buckets row by row, offsets) of runs of rows."""
    for lo, hi, data, off in T.texts(column):
        data = T.LOWER[data]
        s, e, w = T.words(data, off, T.NON_WORD)
        row = np.repeat(np.arange(hi - lo), np.diff(w))
        found = []
        for k, n in enumerate(BEGINNINGS):
            at = np.arange(len(s)) if not n else np.flatnonzero(e - s > n)
            h = T.word_hashes(data, s[at], e[at] if not n else s[at] + n)
            found.append(row[at] * BUCKETS + (T.mix(h + T.U(k)) % T.U(BUCKETS)).astype(np.int64))
        cells = np.unique(np.concatenate(found))
        yield lo, hi, cells % BUCKETS, np.searchsorted(cells, np.arange(hi - lo + 1) * BUCKETS)


def _features(batches):
    for b in batches:
        out = [x.astype("<i4").tobytes() for _, _, cells, off in terms(b.column("text")) for x in np.split(cells, off[1:-1])]
        yield pa.RecordBatch.from_arrays([b.column("dkey"), b.column("y"), pa.array(out, pa.binary())], names=["dkey", "y", "terms"])


class Machine:
    """Scores; ``known`` are the buckets that training rows have."""

    def __init__(self, known: np.ndarray):
        self.bias, self.weight = 0.0, np.zeros(BUCKETS, np.float32)
        self.vector = np.zeros((BUCKETS, FACTORS), np.float32)
        self.vector[known] = np.random.default_rng(1).normal(0, 0.05, (len(known), FACTORS))

    def margin(self, at: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(off) - 1), np.diff(off))
        n = len(off) - 1
        linear = np.bincount(row, self.weight[at], n)
        total, square = np.zeros((n, FACTORS)), np.zeros((n, FACTORS))
        v = self.vector[at]
        for f in range(FACTORS):
            total[:, f], square[:, f] = np.bincount(row, v[:, f], n), np.bincount(row, v[:, f] ** 2, n)
        # pairs weigh less in texts of many terms, whose pairs are many
        scale = 1 / np.sqrt(np.maximum(1, np.diff(off)))
        return self.bias + linear + scale * (total**2 - square).sum(1) / 2, total, scale

    def fit(self, at: np.ndarray, off: np.ndarray, y: np.ndarray, epochs: int) -> None:
        """``epochs`` for the weights alone, and as many for both, so that vectors learn what weights cannot say.

        Weights follow the regularised leader, whose threshold leaves those at 0 that few rows or no clear
        difference speak for; vectors take plain gradient steps, which are small for rare buckets.
        """
        r = np.random.default_rng(2)
        sum_w, square_w, square_b = np.zeros(BUCKETS), np.zeros(BUCKETS), 1.0
        for epoch in range(2 * epochs):
            for rows in np.array_split(r.permutation(len(y)), max(1, len(y) // BATCH)):
                size = np.diff(off)[rows]
                cut = np.r_[0, np.cumsum(size)]
                a = at[np.repeat(off[rows] - cut[:-1], size) + np.arange(cut[-1])]
                z, total, scale = self.margin(a, cut)
                g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]
                row = np.repeat(np.arange(len(rows)), size)
                u, where = np.unique(a, return_inverse=True)
                gw = np.bincount(where, g[row], len(u))
                before = np.sqrt(square_w[u])
                square_w[u] += gw**2
                step = (np.sqrt(square_w[u]) - before) / RATE_W
                sum_w[u] += gw - step * self.weight[u]
                over = np.maximum(np.abs(sum_w[u]) - THRESHOLD * (1 + np.sqrt(square_w[u])), 0)
                self.weight[u] = -np.sign(sum_w[u]) * over / ((1 + np.sqrt(square_w[u])) / RATE_W + 0.1)
                square_b += g.sum() ** 2
                self.bias -= RATE_W * g.sum() / np.sqrt(square_b)
                if epoch < epochs:
                    continue
                pull = (g * scale)[row, None] * (total[row] - self.vector[a])
                gv = np.stack([np.bincount(where, pull[:, f], len(u)) for f in range(FACTORS)], 1)
                self.vector[u] -= np.clip(RATE_V * (gv + DECAY_V * self.vector[u]), -0.5, 0.5)

    def score(self, column) -> np.ndarray:
        out = [np.empty(0)]
        for _, _, cells, off in terms(column):
            z, _, _ = self.margin(cells, off)
            out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return np.concatenate(out)


def fit(table: pa.Table | None, epochs: int = 6, steps: int = 300) -> Machine:
    """Of the rows' terms, in ``epochs``, or more where those have fewer than ``steps`` steps; without rows, a
    machine that scores 0.5."""
    if table is None or not len(table):
        return Machine(np.empty(0, np.int64))
    y = table.column("y").to_numpy().astype(float)
    cells = [np.frombuffer(x, "<i4") for x in table.column("terms").to_pylist()]
    flat = np.concatenate(cells).astype(np.int64)
    m = Machine(np.unique(flat))
    m.fit(flat, np.r_[0, np.cumsum([len(x) for x in cells])], y, max(epochs, -(-steps * BATCH // len(y))))
    return m


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, modulus: int = 3, held_out: int = 1, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= ``threshold``) of each row of ``docs``
    (doc_id, text); ``labels`` (doc_id, toxic) teach, and nothing but the text is scored.

    The model is fitted on at most ``max_rows`` labelled rows, never on those with crc32(doc_id) mod
    ``modulus`` equal to ``held_out``.  A null text is empty and has the score of no terms.  A row with a
    null id is not held out.  Without labels every score is 0.5.  Rows that repeat get the same score.
    """
    rows = training_rows(docs, labels, "toxic", modulus, held_out, max_rows)
    model = docs.sparkSession.sparkContext.broadcast(fitted(rows, _features, "dkey long, y int, terms binary", fit))
    return scored(docs, lambda column: model.value.score(column), modulus, held_out, threshold)
