"""Postings (hash, document, position), shuffled as byte blocks by range of the hash.

A map task turns its postings into one block a range, a few bytes a posting where a row would take
thirty; a group of ``applyInArrow`` is one range, whose size the number of ranges bounds, however
often a single hash occurs: a map task that holds a hash at several places marks all of them itself
and sends two, so a range gets at most two postings of a hash from each map task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._text import M1, U, mix, row_of
from weftgraph.llm._work import joined

#: Postings that a map task gathers before it sends blocks.
GATHER = 1_500_000
SCHEMA = "part int, keys binary, dkeys binary, tkeys binary, counts binary, pos binary, checks binary"
_ARROW = pa.schema([("part", pa.int32()), *((x, pa.binary()) for x in ("keys", "dkeys", "tkeys", "counts", "pos", "checks"))])


def planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of integers, byte by byte: planes of zeros compress to nothing."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(b: bytes, width: int) -> np.ndarray:
    n = len(b) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def range_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> U(32)) * U(n)) >> U(32)


def blocks(keys: np.ndarray, dkeys: np.ndarray, tkeys: np.ndarray, pos: np.ndarray, n: int, width: int, above: int = 0, part: np.uint64 | None = None, checks: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Postings sorted by document and position, as one row a range of the keys, or as range ``part``;
    ranges count from ``above``.  ``checks`` are 32 more bits of the keys."""
    if not len(keys):
        return
    part = range_of(keys, n) if part is None else np.full(len(keys), part)
    order = np.argsort(part, kind="stable")
    part = part[order]
    bound = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
    rows: dict[str, list] = {x: [] for x in _ARROW.names}
    for a, b in zip(bound[:-1], bound[1:], strict=True):
        o = order[a:b]
        d, t, p = dkeys[o], tkeys[o], pos[o]
        new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1])])
        step = np.diff(p, prepend=0)
        step[new] = p[new]
        rows["part"].append(int(part[a]) + above)
        rows["keys"].append(planes(keys[o], width))
        rows["dkeys"].append(d[new].astype("<i8").tobytes())
        rows["tkeys"].append(t[new].astype("<i8").tobytes())
        rows["counts"].append(planes(np.diff(np.r_[new, b - a]), 4))
        rows["pos"].append(planes(step.astype(np.int64), 5))
        rows["checks"].append(b"" if checks is None else planes(checks[o], 4))
    yield pa.RecordBatch.from_pydict(rows, schema=_ARROW)


def unpack(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """keys, dkeys, tkeys, positions of the postings of one range."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    for k, d, t, c, p in zip(*(table.column(x).to_pylist() for x in _ARROW.names[1:6]), strict=True):
        count = unplanes(c, 4).astype(np.int64)
        step = unplanes(p, 5).astype(np.int64)
        first = np.cumsum(count) - count
        total = np.cumsum(step)
        out[0].append(unplanes(k, width))
        out[1].append(np.repeat(np.frombuffer(d, "<i8"), count))
        out[2].append(np.repeat(np.frombuffer(t, "<i8"), count))
        # a step back wraps around
        out[3].append((total - np.repeat(total[first] - step[first], count)) & ((1 << 40) - 1))
    return tuple(np.concatenate(x) for x in out)


def told_apart(keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Values that are equal where both the keys and the checks are."""
    order = np.argsort(keys, kind="stable")
    k, c = keys[order], checks[order]
    if not ((k[1:] == k[:-1]) & (c[1:] != c[:-1])).any():
        return keys
    order = np.lexsort((checks, keys))
    k, c = keys[order], checks[order]
    out = np.empty(len(keys), U)
    out[order] = np.cumsum(np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])]).astype(U)
    return out


def occurrence(tkeys: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The same value for the same place in the same text."""
    return mix(tkeys.view(U) * M1 + pos.astype(U))


def repeated(keys: np.ndarray, occ: np.ndarray) -> np.ndarray:
    """Which postings have a key that is found at two occurrences or more."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    k, o = keys[order], occ[order]
    new = np.r_[True, k[1:] != k[:-1]]
    start = np.flatnonzero(new)
    many = np.minimum.reduceat(o, start) != np.maximum.reduceat(o, start)
    out = np.empty(len(keys), bool)
    out[order] = many[np.cumsum(new) - 1]
    return out


def sent(docs: DataFrame, of_batch: Callable, n: int, width: int) -> DataFrame:
    """Blocks of what ``of_batch(batch)`` yields: (keys, dkeys, tkeys, positions[, checks]) of some rows.

    Copies of a text within a task count once.  Postings that the task itself finds repeated go to
    ranges from n on, which hold results.
    """

    def run(batches):
        have, size = [], 0

        def flush():
            nonlocal have, size
            if have:
                k, d, t, p, *c = (np.concatenate(x) for x in zip(*have, strict=True))
                have, size = [], 0
                order = np.lexsort((p, d, t))
                k, d, t, p, *c = (x[order] for x in (k, d, t, p, *c))
                same = mix(k ^ occurrence(t, p))
                keep = np.sort(np.unique(same, return_index=True)[1])
                k, d, t, p, *c = (x[keep] for x in (k, d, t, p, *c))
                name = told_apart(k, c[0]) if c else k
                known = repeated(name, occurrence(t, p))
                yield from blocks(mix(t[known].view(U)), d[known], t[known], p[known], n, 1, n)
                order = np.flatnonzero(known)[np.argsort(name[known], kind="stable")]
                nth = np.arange(len(order)) - np.maximum.accumulate(np.where(np.r_[True, name[order][1:] != name[order][:-1]][: len(order)], np.arange(len(order)), 0))
                known[order[nth < 2]] = False
                yield from blocks(k[~known], d[~known], t[~known], p[~known], n, width, checks=c[0][~known] if c else None)

        for batch in batches:
            for found in of_batch(batch):
                if len(found[0]):
                    have.append(found)
                    size += len(found[0])
                if size >= GATHER:
                    yield from flush()
        yield from flush()

    return docs.mapInArrow(run, SCHEMA)


def by_document(found: DataFrame, n: int) -> DataFrame:
    """Blocks whose keys are ``mix(tkey)``, as one row a text: dkey, tkey, positions (sorted, int64)."""

    def run(table: pa.Table) -> pa.Table:
        _, d, t, p = unpack(table, 1)
        order = np.lexsort((p, d, t))
        d, t, p = d[order], t[order], p[order]
        once = np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (p[1:] != p[:-1])]
        d, t, p = d[once], t[once], p[once]
        new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1])])
        return pa.table({"dkey": d[new], "tkey": t[new], "positions": pa.array([x.astype("<i8").tobytes() for x in np.split(p, new[1:])], pa.binary())})

    return found.groupBy("part").applyInArrow(lambda t: run(t), "dkey long, tkey long, positions binary")


def found_twice(postings: DataFrame, n: int, width: int) -> DataFrame:
    """Postings whose key is found at two occurrences or more, as rows a document (``by_document``).

    Of the copies of one text only that with the least id gets them.
    """

    def run(table: pa.Table) -> pa.Table:
        if (part := table.column("part")[0].as_py()) >= n:
            return table.set_column(0, "part", pa.array([part - n] * len(table), pa.int32()))
        k, d, t, p = unpack(table, width)
        occ = occurrence(t, p)
        checks = np.concatenate([unplanes(x, 4) for x in table.column("checks").to_pylist()])
        if len(checks):
            k = told_apart(k, checks)
        hit = repeated(k, occ)
        k, d, t, p, occ = (x[hit] for x in (k, d, t, p, occ))
        order = np.lexsort((d, occ, k))
        first = np.ones(len(order), bool)
        ko, oo = k[order], occ[order]
        first[1:] = (ko[1:] != ko[:-1]) | (oo[1:] != oo[:-1])
        keep = order[first]
        keep = keep[np.lexsort((p[keep], d[keep], t[keep]))]
        out = list(blocks(mix(t[keep].view(U)), d[keep], t[keep], p[keep], n, 1))
        return pa.Table.from_batches(out, schema=_ARROW)

    return by_document(postings.groupBy("part").applyInArrow(lambda t: run(t), SCHEMA), n)


def postings(batch: pa.RecordBatch, lo: int, hi: int, off: np.ndarray, keys: np.ndarray, at: np.ndarray):
    """Of units ``at`` of rows lo..hi: keys, dkeys, tkeys, positions in the row."""
    row = row_of(off, at)
    d = batch.column("dkey").slice(lo, hi - lo).to_numpy(zero_copy_only=False)
    t = batch.column("tkey").slice(lo, hi - lo).to_numpy(zero_copy_only=False)
    return keys, d[row], t[row], at - off[row]


def copies(keys: DataFrame) -> DataFrame:
    """dkey, tkey of rows whose text some other row has, too; is_rep marks that with the least id.

    Counts meet by text before they are spread to rows; rows of a large group stay apart in the join.
    """
    groups = keys.groupBy("tkey", "n_bytes").agg(F.count("*").alias("n"), F.min("dkey").alias("least")).filter("n > 1")
    return joined(keys, groups, ["tkey", "n_bytes"], "n", "dkey").select("dkey", "tkey", (F.col("dkey") == F.col("least")).alias("is_rep")).distinct()


def with_found(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (dkey, tkey, text) with positions from ``found``; copied: some other row has the text;
    open: it has positions, and speaks for its copies if there are any."""
    known = found.join(copies(rows.select("dkey", "tkey", F.octet_length("text").alias("n_bytes"))), ["dkey", "tkey"], "full_outer")
    return rows.join(known.hint("shuffle_hash"), ["dkey", "tkey"], "left").select("dkey", "tkey", "text", "positions", F.col("is_rep").isNotNull().alias("copied"), (F.coalesce("is_rep", F.lit(True)) & F.col("positions").isNotNull()).alias("open"))
