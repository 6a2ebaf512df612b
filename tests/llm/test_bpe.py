import hashlib
import random
import sys

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from weftgraph.llm.bpe import _patterns, bpe, vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def digest(t, text):
    ids = t.encode(text or "", add_special_tokens=False).ids
    back = t.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=str)


def fuzz():
    r = random.Random(11)
    chars = "aaab the   \n\t\r\x0b\x1c\x85\xa0 　'sd'll're \"#$%0123٣½ÀßéñĀжЖ中文字日本語한국어😀👍🏽́​‍﻿՘࢏\U000323b0\U00010940<|endoftext|>"
    parts = [*chars, "<|endoftext|>", "hello", " world", "    ", "aaaaaaaa", "\n\n\n", "'s", "'LL", "it's", "don't"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 80))) for _ in range(400)]


def test_like_the_library(docs, rows, clashing, library, empty):
    expected = sorted(((d, *digest(library, t)) for d, t, *_ in rows), key=str)
    assert got(bpe(docs, PATH)) == expected
    assert got(bpe(clashing, PATH, keep=False)) == expected
    assert got(bpe(empty, PATH)) == []
    assert len(got(bpe(docs.union(docs), PATH, keep=False))) == 2 * len(rows)


def test_odd_characters(spark, library):
    texts = fuzz()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    assert got(bpe(df, PATH)) == sorted(((i, *digest(library, t)) for i, t in enumerate(texts)), key=str)


def test_every_character_is_split_alike(library):
    _, exact, _ = _patterns()
    step = {range(0x3500, 0x9F00): 97, range(0xAD00, 0xD700): 97, range(0x20100, 0xE0000): 301, range(0xE0200, 0x110000): 997}
    for c in range(sys.maxunicode + 1):
        if 0xD800 <= c < 0xE000 or any(c in k and c % n for k, n in step.items()):
            continue
        s = f"a1 {chr(c)}b2{chr(c)}!{chr(c)}  x"
        assert [m.span() for m in exact.finditer(s)] == [x[1] for x in library.pre_tokenizer.pre_tokenize_str(s)], hex(c)


def test_round_trip(docs, rows):
    kept = {(r.doc_id, r.decoded) for r in bpe(docs, PATH).collect()}
    assert kept == {(d, t or "") for d, t, *_ in rows}


def test_runs_of_one_pair(library):
    v = vocabulary(PATH)
    for n in range(1, 40):
        ids, off = v.encode([b"a" * n, b" " * n, b"ab" * n])
        for k, t in enumerate(("a" * n, " " * n, "ab" * n)):
            assert [x.id for x in library.model.tokenize(t.replace(" ", "Ġ"))] == ids[off[k] : off[k + 1]].tolist()
