import hashlib
import re

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import decontaminate as D

COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near", "near_sha256")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute(rows, items, size=10, span=15):
    windows = []
    for i, t in items:
        w = words(t)
        if i is not None and w:
            windows += [(str(i), tuple(w[k : k + size])) for k in range(max(1, len(w) - size + 1))]
    out = []
    for d, t, *_ in rows:
        w, hit, who, near = words(t), set(), set(), set()
        for i, x in set(windows):
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    who.add(i)
            near |= {i for k in range(max(1, len(w) - span + 1)) if set(x) <= set(w[k : k + span])}
        digest = lambda x: hashlib.sha256(",".join(sorted(x)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(who), digest(who), bool(hit), len(near), digest(near)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


@pytest.fixture(scope="module")
def items(rows):
    long = [t for _, t, *_ in rows if t and len(t.split()) > 80]
    cut = lambda t, a, b: " ".join(t.split()[a:b])
    return [(1, cut(long[0], 3, 20).upper()), (2, cut(long[1], 0, 10)), (30, cut(long[2], 10, 14)), (4, "not in there at all, not in any of these texts"), (5, None), (6, ""), (None, cut(long[0], 3, 20)), (7, cut(long[0], 3, 20) + " or not"), (8, "again again again"), (9, "straße été"), (10, " ".join(long[3].split()[40:52][::-1]))]


def test_like_brute_force(docs, rows, items, clashing):
    bench = docs.sparkSession.createDataFrame(items, "item_id long, text string")
    expected = brute(rows, items)
    assert sum(x[5] for x in expected) >= 4
    assert got(D.decontaminate(docs, bench)) == expected
    assert got(D.decontaminate(clashing, bench.withColumn("doc_id", F.lit(1)))) == expected
    assert sum(x[6] > x[3] for x in expected) >= 1
    assert got(D.decontaminate(docs, bench, block=60)) == expected  # in several searches
    assert got(D.decontaminate(docs, bench, most_terms=20)) == expected  # of several indexes
    assert got(D.decontaminate(docs.union(docs), bench)) == brute(rows + rows, items)


def test_empty_tables(docs, rows, empty):
    bench = docs.sparkSession.createDataFrame([], "item_id long, text string")
    assert got(D.decontaminate(docs, bench)) == brute(rows, [])
    assert got(D.decontaminate(empty, bench)) == []


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "c x a b q"), (2, "c x x x x a b"), (3, "a b c"), (4, None), (5, "a b c x")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "a b c x"), (8, "b q"), (9, "x b")], "item_id long, text string")
    found = D.decontaminate(docs, bench, size=4, span=4).collect()
    assert {r.doc_id: r.near_items for r in found} == {1: ["7", "8", "9"], 2: ["9"], 3: [], 4: [], 5: ["7", "9"]}
    assert {r.doc_id: r.items for r in found} == {1: ["8"], 2: [], 3: [], 4: [], 5: ["7"]}
