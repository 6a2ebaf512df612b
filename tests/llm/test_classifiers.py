import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from weftgraph.llm import quality_model as quality_module
from weftgraph.llm import toxicity as toxicity_module
from weftgraph.llm.quality_model import Attention, quality_model
from weftgraph.llm.toxicity import toxicity

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus(spark):
    """Toxic: an insult together with a group word, neither alone; bad: repeated or full of symbols."""
    r = random.Random(1)
    word = lambda: "".join(r.choice("aeioubcdfglmnrst") for _ in range(r.randint(2, 8)))
    common = [word() for _ in range(150)]
    rows, labels = [], []
    for i in range(900):
        w = [r.choice(common) for _ in range(r.randint(20, 160))]
        insult, group = r.random() < 0.5, r.random() < 0.5
        w[3:3] = ["blorgish"] * insult + ["zanti"] * group
        bad = r.random() < 0.3
        if bad:
            w = w[:10] * 8 if r.random() < 0.5 else [x + "###" for x in w]
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, int(not bad), int(insult and group)))
    rows += [(9001, None, None, None, None), (9002, "", "en", "s", 0), (None, "x", "en", "s", 0), (9003, "word " * 20000, "en", "s", 0)]
    labels += [(5, None, None), (None, 1, 1), (123456, 1, 1), (7, labels[7][1], labels[7][2])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3), spark.createDataFrame(labels, LABELS), labels[:900]


@pytest.mark.parametrize("make,column,modulus,held", [(toxicity, 2, 3, 1), (quality_model, 1, 4, 2)])
def test_held_out_accuracy(corpus, make, column, modulus, held):
    docs, labels, truth = corpus
    found = make(docs.selectExpr("*", "1 AS score", "2 AS y", "3 AS dkey"), labels).collect()
    assert len(found) == 904
    for r in found:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % modulus == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    by = {r.doc_id: r for r in found}
    test = [(by[t[0]].predicted, t[column]) for t in truth if by[t[0]].held_out]
    assert len(test) > 150
    assert np.mean([p == y for p, y in test]) > 0.93


@pytest.mark.parametrize("make", [toxicity, quality_model])
def test_no_labels_and_no_rows(corpus, spark, make):
    docs, labels, _ = corpus
    none = spark.createDataFrame([], LABELS)
    assert {round(r.score, 6) for r in make(docs.limit(5), none).collect()} == {0.5}
    assert make(docs.limit(0), labels).count() == 0


def learned(texts, labels):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(labels, pa.int32()), pa.array(texts)], names=["dkey", "y", "text"])
    return toxicity_module.fit(pa.Table.from_batches(list(toxicity_module._features([batch]))))


def test_pairs_are_learned_end_to_end():
    """Both words or neither: 1; one of them: 0 - neither word says anything alone."""
    r = np.random.default_rng(0)
    texts, labels = [], []
    for _ in range(2000):
        a, b = r.random(2) < 0.5
        w = [f"filler{k}" for k in r.integers(0, 300, 20)]
        w[3:3] = ["zorp"] * bool(a) + ["quix"] * bool(b)
        texts.append(" ".join(w))
        labels.append(int(a == b))
    m = learned(texts[:1500], labels[:1500])
    assert ((m.score(pa.array(texts[1500:])) >= 0.5) == np.array(labels[1500:])).mean() > 0.95


def test_machine_scores_like_a_sum_over_pairs():
    r = random.Random(4)
    words = ["alpha", "beta", "gamma", "insulting", "groups", "delta", "x", "naïve"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 12))) for _ in range(60)]
    m = learned(texts, [int("insulting" in t and "groups" in t) for t in texts])
    expected = []
    for t in [*texts, "unseen words only", ""]:
        (_, _, cells, _), = toxicity_module.terms(pa.array([t]))
        z = m.bias + sum(float(m.weight[i]) for i in cells)
        z += sum(float(m.vector[i] @ m.vector[j]) for k, i in enumerate(cells) for j in cells[:k]) / max(1, len(cells)) ** 0.5
        expected.append(1 / (1 + np.exp(-z)))
    assert np.allclose(m.score(pa.array([*texts, "unseen words only", ""])), expected, atol=1e-4)


def test_attention_scores_like_a_loop_over_documents():
    r = random.Random(6)
    texts = [" ".join(r.choice(["word", "other", "###", "UPPER", "42"]) for _ in range(r.choice([0, 1, 5, 64, 65, 300]))) for _ in range(80)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(80)), pa.array([int("###" not in t) for t in texts], pa.int32()), pa.array(texts)], names=["dkey", "y", "text"])
    m = quality_module.fit(pa.Table.from_batches(list(quality_module._features([batch]))), epochs=3)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    expected = []
    for t in texts:
        bags = []
        for _, _, x, _ in quality_module.passages(pa.array([t])):
            for row in x:
                h = np.tanh(np.append((row - m.mean) / m.scale, 1) @ m.p["E"])
                bags.append((np.exp((np.tanh(h @ m.p["V"]) * sigmoid(h @ m.p["U"])) @ m.p["a"]), h))
        pooled = sum(w * h for w, h in bags) / sum(w for w, _ in bags)
        expected.append(sigmoid(pooled @ m.p["s"] + m.p["b"][0]))
    assert np.allclose(m.score(pa.array(texts)), expected, atol=1e-9)


def test_repeated_rows_and_ids(corpus):
    docs, labels, _ = corpus
    few = docs.filter("doc_id < 300")
    other = few.selectExpr("doc_id", "concat(text, ' blorgish zanti') AS text", "lang", "source", "n_chars")
    for make in (toxicity, quality_model):
        once = {(r.doc_id, r.score) for r in make(few, labels).collect()}
        twice = make(few.union(few), labels).collect()
        assert len(twice) == 600 and {(r.doc_id, r.score) for r in twice} == once
        # an id with two texts: the same one teaches, however the rows are dealt
        a, b = (sorted((r.doc_id, r.score) for r in make(x, labels).collect()) for x in (few.union(other).repartition(2), other.union(few).repartition(5)))
        assert a == b


def test_gradient_of_attention():
    r = np.random.default_rng(5)
    m = Attention()
    x, cut, y = r.normal(size=(12, 14)), np.array([0, 3, 4, 12]), np.array([1.0, 0.0, 1.0])
    loss = lambda: float(-(y * np.log(s := m.forward(x, cut)[-1]) + (1 - y) * np.log(1 - s)).mean())
    g = m.gradient(x, cut, y)
    for k, p in m.p.items():
        i = tuple(r.integers(0, n) for n in p.shape)
        old, eps = p[i], 1e-6
        p[i] = old + eps
        up = loss()
        p[i] = old - eps
        down = loss()
        p[i] = old
        assert abs((up - down) / (2 * eps) - g[k][i]) < 1e-6
