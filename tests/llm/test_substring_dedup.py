import hashlib
import re
from collections import Counter

import pytest

from weftgraph.llm.substring_dedup import COVER, PERIOD, substring_dedup

COLUMNS = ("doc_id", "n_words", "n_removed", "kept_sha256")


def brute(rows, k=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    seen = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for (d, *_), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone |= set(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_cover_has_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_like_brute_force(docs, rows):
    expected = brute(rows)
    assert sum(x[2] for x in expected) > 1000
    assert got(substring_dedup(docs)) == expected


@pytest.mark.parametrize("k", [25, 50])
def test_other_windows(docs, rows, k):
    assert got(substring_dedup(docs, k)) == brute(rows, k)


def test_extra_columns_and_empty(clashing, rows, empty):
    assert got(substring_dedup(clashing)) == brute(rows)
    assert got(substring_dedup(empty)) == []


def test_repeated_rows_are_copies(docs, rows):
    assert got(substring_dedup(docs.union(docs))) == brute(rows + rows)
