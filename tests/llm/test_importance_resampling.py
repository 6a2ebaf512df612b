import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa

from weftgraph.llm.importance_resampling import features, importance_resampling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, order):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, [" ".join(words[i : i + k]) for k in range(1, order + 1) for i in range(len(words) - k + 1)]


def brute(rows, target, order, buckets, seed, least, percent):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    count = lambda texts: Counter(bucket(f) for t in texts for f in grams(t, order)[1])
    s, t = count(x[1] for x in rows), count(target)
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log(((t[b] + 1.0) * (s_all + buckets)) / ((s[b] + 1.0) * (t_all + buckets)))) for b in range(buckets)}
    out = []
    for d, text, *_ in rows:
        words, fs = grams(text, order)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        out.append([d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    some = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(some[: len(some) * percent // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def target(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


TARGET = ["the spark of été, the DATA", None, "", "w1 w2 w3 Straße 日本 x", "the spark of été"]


def test_like_brute_force(spark, docs, clashing, rows):
    items = target(spark, TARGET)
    for order, buckets, percent in ((1, 10_000, 10), (3, 97, 35)):
        expected = brute(rows, TARGET, order, buckets, 2024, 20, percent)
        assert sum(x[4] is not None for x in expected) > 3
        assert got(importance_resampling(docs, items, order, buckets, percent=percent)) == expected
    assert got(importance_resampling(clashing, items)) == brute(rows, TARGET, 1, 10_000, 2024, 20, 10)


def test_empty_tables_and_repeats(spark, docs, rows, empty):
    items = target(spark, TARGET)
    assert got(importance_resampling(empty, items)) == []
    assert got(importance_resampling(docs, items.limit(0))) == brute(rows, [], 1, 10_000, 2024, 20, 10)
    assert got(importance_resampling(docs.union(docs), items)) == brute(rows + rows, TARGET, 1, 10_000, 2024, 20, 10)


def test_a_hot_group_of_ties_is_ranked_without_gaps(spark):
    rows = [(i % 7 if i % 3 else None, "one two three " * 8) for i in range(300)]
    df = importance_resampling(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), target(spark, TARGET), percent=50, keep=True)
    found = df.filter("rank IS NOT NULL").orderBy("rank").collect()
    assert [r.rank for r in found] == list(range(1, 151)) and all(r.text == rows[0][1] for r in found)
    assert [r.score for r in found] == sorted((r.score for r in found), reverse=True)


def test_features_of_runs():
    bucket, row, words = features(pa.array(["A b  a", "", "--", "b-a é"]), 2, 1 << 31)
    found = Counter(zip(row.tolist(), bucket.tolist(), strict=True))
    crc = lambda s: zlib.crc32(s.encode()) % (1 << 31)
    assert words.tolist() == [3, 0, 0, 3]
    assert found == Counter([(0, crc("a")), (0, crc("b")), (0, crc("a")), (0, crc("a b")), (0, crc("b a")), (3, crc("b")), (3, crc("a")), (3, crc("é")), (3, crc("b a")), (3, crc("a é"))])


def test_draws_what_is_like_the_target(spark):
    rows = [(i, " ".join(["alpha beta gamma" if i % 4 == 0 else "delta epsilon zeta"] * 10)) for i in range(200)]
    df = importance_resampling(spark.createDataFrame(rows, "doc_id long, text string"), target(spark, ["alpha beta gamma"] * 3), percent=20)
    assert all(r.doc_id % 4 == 0 for r in df.filter("rank IS NOT NULL").collect())
