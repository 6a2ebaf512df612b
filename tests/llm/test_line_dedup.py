import hashlib
from collections import defaultdict

from weftgraph.llm.line_dedup import line_dedup

COLUMNS = ("doc_id", "n_lines", "n_dropped", "kept_sha256")
WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, chars=1):
    lines = [(t or "").split("\n") for _, t, *_ in rows]
    found = defaultdict(set)
    for (d, t, *_), ls in zip(rows, lines, strict=True):
        for x in ls:
            found[x.strip(WHITE).translate(LOWER)].add(t if d is None else d)
    gone = {k for k, v in found.items() if len(v) >= least and len(k) >= chars}
    out = []
    for (d, *_), ls in zip(rows, lines, strict=True):
        kept = [x for x in ls if x.strip(WHITE).translate(LOWER) not in gone]
        out.append((d, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_like_brute_force(docs, rows):
    expected = brute(rows)
    assert sum(x[2] for x in expected) > 10
    assert got(line_dedup(docs)) == expected
    assert got(line_dedup(docs, min_docs=2, min_chars=4)) == brute(rows, 2, 4)


def test_extra_columns_empty_and_repeats(clashing, docs, rows, empty):
    assert got(line_dedup(clashing)) == brute(rows)
    assert got(line_dedup(empty)) == []
    assert got(line_dedup(docs.union(docs), 12)) == brute(rows + rows, 12)


def test_rows_of_one_id_are_one_document(spark):
    rows = [(1, "a\nb\nc"), (1, "a\nb"), (1, "a"), (2, "a\nb"), (3, "b"), (None, "c\nc"), (None, "c\nd")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(line_dedup(df, 3)) == brute(rows, 3)
    assert {x[2] for x in brute(rows, 3)} == {0, 1, 2}


def test_hot_lines_are_dealt_out(spark, monkeypatch):
    from weftgraph.llm import _work, line_dedup as module

    joined = _work.joined
    monkeypatch.setattr(module, "joined", lambda *a: joined(*a, few=7))
    rows = [(i, "hot\n" + ("warm\n" if i % 3 else "") + f"own {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(line_dedup(df)) == brute(rows)


def test_keeps_the_columns(clashing, rows):
    df = line_dedup(clashing, keep_columns=True)
    assert df.columns == clashing.columns
    texts = [hashlib.sha256(r.text.encode()).hexdigest() for r in df.collect() if r.text is not None]
    assert len(texts) == sum(t is not None for _, t, *_ in rows)
    assert set(texts) <= {x[3] for x in brute(rows)}
