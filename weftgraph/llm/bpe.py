"""Byte-level BPE by a pair occurrence index.

A task splits its texts into pretokens and keeps each different one once.  Over all of these, laid end to
end, an index maps each adjacent pair that has a rank to all its positions.  Ranks are applied in
ascending order, each at all its positions at once; a merge adds the two pairs that it makes to the index,
while entries that it spoils are recognised and skipped when their turn comes.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import pre_tokenizers

from weftgraph.llm import _text as T
from weftgraph.llm._work import keyed, real_id

#: White space as the file's library has it, and the split pattern of byte-level vocabularies.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _pattern(letter: str, number: str, other: str) -> regex.Pattern:
    return regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+", regex.V1)


@lru_cache(1)
def _patterns() -> tuple[regex.Pattern, regex.Pattern, int]:
    """The pattern, one for texts with characters that ``regex`` knows and the file's library does not,
    and the least first UTF-8 byte of those."""
    split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    new = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn"]
    new = [c for c in new if regex.match(r"[\p{L}\p{N}]", chr(c)) and len(split("a" + chr(c))) == len(split("1" + chr(c))) == 2]
    runs: list[list[int]] = []
    for c in new:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    late = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)
    fast = _pattern(r"\p{L}", r"\p{N}", rf"[^{WHITE}\p{{L}}\p{{N}}]")
    if not new:
        return fast, fast, 256
    exact = _pattern(rf"[\p{{L}}--[{late}]]", rf"[\p{{N}}--[{late}]]", rf"(?:[^{WHITE}\p{{L}}\p{{N}}]|[{late}])")
    return fast, exact, chr(new[0]).encode()[0]


class Vocabulary:
    """A tokenizer file of byte-level kind: byte -> id, ranked pairs, the bytes of each id, special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        kind, model = file["pre_tokenizer"], file["model"]
        if kind["type"] != "ByteLevel" or kind["add_prefix_space"] or not kind.get("use_regex", True) or file["normalizer"] or model["type"] != "BPE":
            raise ValueError("only byte-level BPE files without a normalizer are read")
        # printable characters stand for themselves, the other bytes for characters from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ids: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        if len({a + b for a, b in pairs}) != len(pairs):
            raise ValueError("two merges make the same token")
        self.first = np.zeros(256, np.int64)
        for c, b in byte.items():
            self.first[b] = ids.get(c, -1)
        if (self.first < 0).any():
            raise ValueError("a byte has no token")
        code = np.array([(ids[a] << 32) | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(code)
        self.codes, self.ranks = code[order], order
        self.left, self.right = code >> 32, code & 0xFFFFFFFF
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in file["added_tokens"]):
            raise ValueError("added tokens may not strip, stand for words or be normalized")
        strings = {i: bytes(byte[c] for c in t) for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        every = [strings.get(i, b"") for i in range(max(strings) + 1)]
        self.pool = np.frombuffer(b"".join(every), np.uint8)
        self.size = np.array([len(x) for x in every], np.int64)
        self.at = np.cumsum(self.size) - self.size

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = (left << 32) | right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.ranks[at], -1)

    def encode(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pretokens, end to end, and the offset of each."""
        data = np.frombuffer(b"".join(tokens), np.uint8)
        off = np.r_[0, np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))]
        n = len(data)
        ids = np.r_[self.first[data], -1]
        # the position after and before each symbol; n is none
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[off[1:] - 1] = n
        before[off[:-1]] = n
        after[n] = before[n] = n
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            at = at[after[at] < n]
            r = self.rank(ids[at], ids[after[at]])
            at, r = at[r >= 0], r[r >= 0]
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cut = np.flatnonzero(np.r_[True, r[1:] != r[:-1], True]) if len(r) else np.zeros(1, np.int64)
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                k = int(r[a])
                if k not in index:
                    index[k] = []
                    heapq.heappush(active, k)
                index[k].append(at[a:b])

        add(np.arange(n))
        while active:
            r = heapq.heappop(active)
            at = index.pop(r)
            at = np.unique(np.concatenate(at)) if len(at) > 1 else at[0]
            x, y = self.left[r], self.right[r]
            at = at[(ids[at] == x) & (ids[after[at]] == y)]
            if x == y and len(at) > 1:  # of a run of equal symbols every second pair, from the left
                new = np.r_[True, after[at[:-1]] != at[1:]]
                run = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
                at = at[run % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            behind = after[gone]
            ids[at], ids[gone] = self.made[r], -1
            after[at] = behind
            before[behind] = at
            before[n] = n
            left = before[at]
            left = left[left < n]
            add(np.union1d(at, left) if len(left) else at)
        live = ids[:n] >= 0
        return ids[:n][live], np.r_[0, np.cumsum(live)][off]

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        start = np.repeat(self.at[ids] - (np.cumsum(size) - size), size)
        return self.pool[start + np.arange(len(start))].tobytes()


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Index(dict):
    """Numbers strings as they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


#: Different pretokens that a task keeps the ids of; beyond that it starts anew.
KEPT = 1_000_000


def bpe(docs: DataFrame, path: str, keep: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of ``docs`` (doc_id, text); with ``keep``
    the ids and the decoded text, too.

    ``path`` is a tokenizer file that all executors can open; special strings in a text become their
    ids, none are added.  Hashes are of the ids as little-endian unsigned 32-bit integers and of the
    decoded text in UTF-8.  A null text is empty: no ids, and the hashes of nothing.  Rows are encoded one
    by one; rows that repeat get the same result.
    """

    def run(batches):
        v = vocabulary(path)
        fast, exact, late = _patterns()
        special = sorted(v.special, key=len, reverse=True)
        cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        index, ids, off = _Index(), np.empty(0, np.int64), np.zeros(1, np.int64)
        marks = np.array([v.special[s] for s in special], np.int64)
        for batch in batches:
            names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if keep else [])]
            out: dict[str, list] = {x: [] for x in names}
            for lo, hi, data, offsets in T.texts(batch.column("text"), 4 << 20):
                if len(index) > KEPT:
                    index, ids, off = _Index(), np.empty(0, np.int64), np.zeros(1, np.int64)
                known, rows = len(index), []
                raw = data.tobytes()
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    text = raw[a:b].decode()
                    find = fast.findall if text.isascii() or data[a:b].max() < late else exact.findall
                    if cut is None or not any(s in text for s in special):
                        rows.append(np.array([index[t] for t in find(text)], np.int64))
                        continue
                    parts = cut.split(text)
                    rows.append(np.concatenate([[-1 - special.index(p)] if i % 2 else np.array([index[t] for t in find(p)], np.int64) for i, p in enumerate(parts)]).astype(np.int64))
                if len(index) > known:
                    new = [t.encode() for t in list(index)[known:]]
                    more, where = v.encode(new)
                    ids, off = np.concatenate([ids, more]), np.concatenate([off, where[1:] + off[-1]])
                for row in rows:
                    word = row >= 0
                    size = np.ones(len(row), np.int64)
                    size[word] = off[row[word] + 1] - off[row[word]]
                    start = np.zeros(len(row), np.int64)
                    start[word] = off[row[word]]
                    end = np.cumsum(size)
                    at = np.repeat(start - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)
                    got = ids[at] if word.all() else np.where(np.repeat(word, size), ids[at] if len(ids) else 0, np.repeat(marks[np.where(word, 0, -1 - row)], size))
                    back = v.decode(got)
                    back = back.decode("utf-8", "replace")
                    out["n_tokens"].append(len(got))
                    out["ids_sha256"].append(hashlib.sha256(got.astype("<u4").tobytes()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
                    if keep:
                        out["ids"].append(got.astype(np.int32))
                        out["decoded"].append(back)
            kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([batch.column("dkey"), *(pa.array(x, kinds.get(k, pa.string())) for k, x in out.items())], names=["dkey", *out])

    more = ", ids array<int>, decoded string" if keep else ""
    df = keyed(docs).select("dkey", "text").mapInArrow(run, f"dkey long, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
    return df.select(real_id(), *df.columns[1:])
