import math
import re
from collections import Counter

from weftgraph.llm import quality_rules as Q
from weftgraph.llm.quality_rules import quality_rules

BASE = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            hit |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), n < 10 or 100 * len(hit) > 20 * n)


def key(r):
    return str(tuple(r))


def test_base_like_brute_force(docs, rows, clashing, empty):
    extra = [(9001, "a|b # x\n" * 30 + "&&<>", "en", "s", 0), (9002, "A a b c d e f g h i j k\nA\nA\n\n\n", None, None, None), (9003, " ".join(str(i) for i in range(50)) + " 1 2 3 4 5", "xx", "s", 0)]
    df = docs.sparkSession.createDataFrame(rows + extra, docs.schema)
    expected = sorted(((d, *brute(t)) for d, t, *_ in rows + extra), key=str)
    assert sorted((tuple(r) for r in quality_rules(df).select(*BASE).collect()), key=str) == expected
    assert sorted((tuple(r) for r in quality_rules(clashing).select(*BASE).collect()), key=str) == sorted(((d, *brute(t)) for d, t, *_ in rows), key=str)
    assert quality_rules(empty).count() == 0


def test_verdict_and_columns(spark, docs):
    import random

    r = random.Random(3)
    clean = lambda: " ".join(r.choice("the of and to in is was for stone river hill walk".split()) + str(r.randint(0, 9)) * (r.random() < 0.01) for _ in range(120))
    odd = " ".join(r.choice("§§ ### @@ ||| ÄÖÜÄÖÜ ØØØ".split()) + str(r.randint(10**6, 10**9)) for _ in range(120))
    rows = [(i, clean(), "en", "s", 0) for i in range(80)] + [(100, odd, "en", "s", 0), (101, odd, None, "s", 0), (102, " ".join(odd.split()[:40]), "en", "s", 0), (103, "", "en", "s", 0)]
    df = spark.createDataFrame(rows, docs.schema)
    kept = {x.doc_id: x.kept for x in quality_rules(df).collect()}
    assert all(kept[i] for i in range(80))
    assert not kept[100] and not kept[101] and not kept[103]
    assert kept[102]  # too short for the distances
    stage = quality_rules(df, keep_columns=True)
    assert stage.columns == df.columns
    assert {x.doc_id for x in stage.collect()} == {i for i, k in kept.items() if k}
    twice = quality_rules(df.union(df)).collect()
    assert len(twice) == 2 * len(rows)


def test_common_words_alone_reject(spark, docs):
    """The texts have the characters of their language, but not its common words."""
    import random

    r = random.Random(4)
    nouns = "stone river hill walk tree cloud road field bread horse".split()
    text = lambda common, share: " ".join(r.choice(common if r.random() < share else nouns) for _ in range(120))
    english, german = "the of and to in is was for".split(), "der die und das den von ist mit".split()
    rows = [(i, text(english, 0.4), "en", "s", 0) for i in range(80)] + [(i, text([x + "q" for x in english], 0.4), "xx", "s", 0) for i in range(80, 140)]
    rows += [(200, text(nouns, 0.0), "en", "s", 0), (201, text(german, 0.4), "en", "s", 0), (202, text(nouns, 0.0) + " the of and to in", "en", "s", 0), (203, text(english, 0.4), "xx", "s", 0)]
    found = {x.doc_id: x for x in quality_rules(spark.createDataFrame(rows, docs.schema)).collect()}
    assert all(found[i].kept for i in range(140))  # "xx" has none of the common words, which says nothing
    for i in range(200, 204):
        assert not found[i].base_failed and found[i].class_distance <= 0.25 and not found[i].kept
        assert i > 201 or found[i].word_distance > 0.7


def test_chance_among_few_common_words_rejects_nothing(spark, docs):
    rows = [(i, " ".join(["the of and to"] * 10 + [f"noun{i}x{k}" for k in range(200)]), "en", "s", 0) for i in range(60)]
    rows += [(100, " ".join(["to"] * 12 + [f"n{k}" for k in range(60)]), "en", "s", 0), (101, " ".join(["to"] * 24 + [f"n{k}" for k in range(120)]), "en", "s", 0)]
    found = {x.doc_id: x for x in quality_rules(spark.createDataFrame(rows, docs.schema), max_repeat=100, max_class_distance=1.0).collect()}
    assert found[100].word_distance > 0.5 and quality_rules(spark.createDataFrame(rows, docs.schema), max_repeat=100, max_class_distance=1.0, max_word_distance=0.5).filter("kept AND doc_id >= 100").collect()[0].doc_id == 100


def test_few_rows_of_a_language_have_their_own_reference(spark, docs):
    import random

    r = random.Random(6)
    nouns = "stone river hill walk tree cloud road field bread horse".split()
    text = lambda common: " ".join(r.choice(common if r.random() < 0.3 else nouns) for _ in range(120))
    english, german = "the of and to in is was for".split(), "der die und das den von ist mit".split()
    rows = [(i, text(english), "en", "s", 0) for i in range(100)] + [(i, text(german), "de", "s", 0) for i in range(100, 120)]
    found = {x.doc_id: x for x in quality_rules(spark.createDataFrame(rows, docs.schema)).collect()}
    assert len(found) == 120 and all(x.kept for x in found.values())
    assert all(found[i].word_distance < 0.4 for i in range(100, 120))


def histograms(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = lambda chars: sum(c in chars for c in text)
    upper, digits, marks, symbols = n("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), n("0123456789"), n(".,;:!?'\"()-"), n("#*$%&|<>")
    white = len(text) - sum(map(len, words))
    common = [sum(w == c for w in words) for c in Q.COMMON]
    return [len(text) - upper - digits - marks - symbols - white, upper, digits, marks, symbols, white, len(text.encode()) - len(text)], common + [len(words) - sum(common)]


def distance(a, b):
    if not sum(a) or not sum(b):
        return 1.0
    p, q = [x / sum(a) for x in a], [x / sum(b) for x in b]
    part = lambda x, m: x * math.log2(x / m) if x > 0 else 0.0
    return math.sqrt(min(1, max(0, sum(part(x, (x + y) / 2) + part(y, (x + y) / 2) for x, y in zip(p, q, strict=True)) / 2)))


def judged(rows):
    """doc_id -> class distance, word distance, kept: by the definitions, one row after another."""
    cells = {i: histograms(t or "") for i, (_, t, *_) in enumerate(rows)}
    sums = {}
    for i, (_, t, lang, *_) in enumerate(rows):
        if brute(t)[0] >= 50:
            for of in (lang, ...):
                have = sums.setdefault(of, [[0] * 7, [0] * (len(Q.COMMON) + 1)])
                sums[of] = [[a + b for a, b in zip(x, y, strict=True)] for x, y in zip(have, cells[i], strict=True)]
    every = sums.get(..., [[0] * 7, [0] * (len(Q.COMMON) + 1)])
    share = Q.PRIOR_WORDS / max(1, sum(every[1]))
    out = {}
    for i, (d, t, lang, *_) in enumerate(rows):
        n, *_, failed = brute(t)
        own = sums.get(lang, [[0] * 7, [0] * (len(Q.COMMON) + 1)])
        ref = every if lang is None else [[a + share * b for a, b in zip(x, y, strict=True)] for x, y in zip(own, every, strict=True)]
        by_class, by_word = distance(cells[i][0], ref[0]), distance(cells[i][1][:-1], ref[1][:-1])
        hits, expected = n - cells[i][1][-1], n * sum(ref[1][:-1]) / max(1, sum(ref[1]))
        usual = max(hits, expected) < Q.LEAST_COMMON or ((hits < Q.LEAST_COMMON or by_word <= 0.7) and 0.2 * expected <= hits <= expected / 0.2)
        out[d] = (by_class, by_word, not failed and (n < 50 or (by_class <= 0.25 and usual)))
    return out


def test_distances_and_verdict_by_brute_force(spark, docs):
    import random

    r = random.Random(8)
    english, german = "the of and to in is was for".split(), "der die und das den von ist mit".split()
    nouns = "stone river hill Straße été 42 A-B (x) café".split()
    rows = []
    for i in range(120):
        common = (english, german, nouns)[i % 3]
        n = r.choice([0, 8, 30, 49, 50, 51, 120, 300])
        text = " ".join(r.choice(common if r.random() < 0.4 else nouns) + "#" * (i % 7 == 0) for _ in range(n))
        rows.append((i, text if i % 40 else None, ("en", "de", None, "xx")[i % 4], "s", 0))
    expected = judged(rows)
    assert 5 < sum(k for *_, k in expected.values()) < 110
    for x in quality_rules(spark.createDataFrame(rows, docs.schema).repartition(3)).collect():
        by_class, by_word, kept = expected[x.doc_id]
        assert abs(x.class_distance - by_class) < 1e-8 and abs(x.word_distance - by_word) < 1e-8 and x.kept == kept, x
