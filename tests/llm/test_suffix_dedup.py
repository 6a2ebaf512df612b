import hashlib
from collections import Counter

import pytest

from weftgraph.llm.suffix_dedup import suffix_dedup

COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def brute(rows, k=400):
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(b[i : i + k] for b in texts for i in range(len(b) - k + 1))
    out = []
    for (d, *_), b in zip(rows, texts, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - k + 1):
            if seen[b[i : i + k]] > 1:
                gone[i : i + k] = b"\1" * k
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("k", [400, 150, 64])
def test_like_brute_force(docs, rows, k):
    expected = brute(rows, k)
    assert sum(x[2] for x in expected) > 5000
    assert got(suffix_dedup(docs, k)) == expected


def test_extra_columns_and_empty(clashing, rows, empty):
    assert got(suffix_dedup(clashing)) == brute(rows)
    assert got(suffix_dedup(empty)) == []


def test_repeated_rows_are_copies(docs, rows):
    assert got(suffix_dedup(docs.union(docs))) == brute(rows + rows)
