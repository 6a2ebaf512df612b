"""Hard negatives of anchors: other-label rows whose score lies in windows below the anchor's positives.

Vectors are sorted along a Hilbert curve through all their dimensions and written as Parquet rows of packed
blocks, each with the least and greatest value of every dimension.  Interval arithmetic gives bounds of the
inner products of an anchor with all rows of a block, so that an anchor's windows read the blocks that can
have such a row, and no others.  Anchors go in chunks of neighbours on the curve; a task gets a chunk and a
slice of the blocks that it needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm._work import NULL_ID, ranges, removed, written

#: Rows of a block, anchors of a chunk, blocks that one task takes at most, zone maps of a page, first reads.
BLOCK, CHUNK, SLICE, ZONES, SEEDS = 1024, 4096, 256, 2048, 2
#: Bits a dimension has along the curve.
BITS = 4
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of ``x`` (unsigned, ``bits`` bits a column) on the Hilbert curve, as bytes in order:
    Skilling's transform, over all rows at once."""
    x = x.astype(np.uint32).T.copy()
    dims = len(x)
    for bit in range(bits - 1, 0, -1):
        q, p = np.uint32(1 << bit), np.uint32((1 << bit) - 1)
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p).astype(np.uint32)
            x[0] ^= np.where(on, p, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & np.uint32(1 << bit), np.uint32((1 << bit) - 1), 0).astype(np.uint32)
    x ^= turn
    planes = np.stack([(x >> np.uint32(b)) & 1 for b in range(bits - 1, -1, -1)]).astype(np.uint8)  # bits x dims x rows
    return np.packbits(planes.reshape(bits * dims, -1).T, axis=1)


def bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row of ``a`` with any point of each box."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T


class Numbers:
    """How vectors are packed and multiplied: ``dims`` values of the least width that holds them all, products in
    the fastest type that is exact."""

    def __init__(self, dims: int, most: int, length2: float):
        self.dims = max(1, dims)
        self.packed = next((t for t in (np.int16, np.int32) if most <= np.iinfo(t).max), np.int64)
        self.exact = length2 < 2**52
        self.product = np.float32 if length2 < 2**23 else np.float64 if self.exact else np.int64

    def vectors(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, self.packed).reshape(-1, self.dims)


def longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and whole-number components of the rows that take part."""
    fine = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col("label").cast("long")
    return embeddings.filter(fine).select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(NULL_ID)).alias("vec_id"),
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 256.0).cast("long")).alias("x"),
    )


LAYOUT = "anchors boolean, at long, n int, ids binary, labels binary, x binary, lo binary, hi binary, label_lo long, label_hi long"


def layout(rows: DataFrame, n: int, number: Numbers, least: int, most: int, every: int) -> DataFrame:
    """Blocks of rows along the curve, and chunks of the anchors among them; ``at`` is the place of the first,
    and the ids of a chunk have each anchor's place too."""
    top = (1 << BITS) - 1

    def place(batches):
        for b in batches:
            x = _padded(b.column("x"), number.dims)
            # the span may be wider than a long holds
            cell = np.clip(((x.astype(np.float64) - least) / max(1.0, float(most) - least) * top).round(), 0, top)
            key = hilbert(cell, BITS)
            width = key.shape[1]
            keys = pa.Array.from_buffers(pa.binary(width), len(x), [None, pa.py_buffer(key.tobytes())]).cast(pa.binary())
            packed = x.astype(number.packed)
            size = packed.itemsize * number.dims
            vectors = pa.Array.from_buffers(pa.binary(size), len(x), [None, pa.py_buffer(packed.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([keys, b.column("vec_id"), b.column("label"), vectors], names=["key", "vec_id", "label", "x"])

    def pack(batches) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        block, chunk = [], []

        def emit(parts, anchors, start):
            ids, labels, x, places = (np.concatenate(p) for p in zip(*parts, strict=True))
            row = [anchors, start, len(ids), (np.concatenate([ids, places]) if anchors else ids).tobytes(), labels.tobytes(), x.tobytes(), x.min(0).tobytes(), x.max(0).tobytes(), int(labels.min()), int(labels.max())]
            kinds = [pa.bool_(), pa.int64(), pa.int32(), *[pa.binary()] * 5, pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=[c.split()[0] for c in LAYOUT.split(", ")])

        def full(parts, size, anchors, start, last):
            """Whole groups of ``size`` rows out of ``parts``, and the rest at the end."""
            while parts and (last or sum(len(p[0]) for p in parts) >= size):
                joined = [np.concatenate(p) for p in zip(*parts, strict=True)]
                yield emit([tuple(p[:size] for p in joined)], anchors, int(joined[3][0]) if anchors else start())
                parts[:] = [tuple(p[size:] for p in joined)] if len(joined[0]) > size else []

        done = [at]

        def start():
            out = done[0]
            done[0] += BLOCK
            return out

        for b in batches:
            ids, labels = (b.column(c).to_numpy() for c in ("vec_id", "label"))
            x = np.frombuffer(b"".join(b.column("x").to_pylist()), number.packed).reshape(-1, number.dims)
            places = at + np.arange(len(ids))
            at += len(ids)
            block.append((ids, labels, x, places))
            some = (ids % every == 0) & (ids != NULL_ID)
            if some.any():
                chunk.append((ids[some], labels[some], x[some], places[some]))
            yield from full(block, BLOCK, False, start, False)
            yield from full(chunk, CHUNK, True, start, False)
        yield from full(block, BLOCK, False, start, True)
        yield from full(chunk, CHUNK, True, start, True)

    placed = rows.mapInArrow(place, "key binary, vec_id long, label long, x binary")
    order = ["key", "vec_id", "label", "x"]
    return written(placed.repartitionByRange(ranges(n, 100_000, 8), *order).sortWithinPartitions(*order).mapInArrow(pack, LAYOUT))


def _padded(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column, with zeros where they are shorter than ``dims``."""
    n = column.value_lengths().to_numpy()
    out = np.zeros((len(n), dims), np.int64)
    out[np.arange(dims) < n[:, None]] = column.flatten().to_numpy()
    return out


def _who(flags: np.ndarray) -> bytes:
    return np.flatnonzero(flags).astype(np.uint16).tobytes()


def needed(chunks: DataFrame, blocks: DataFrame, n_blocks: int, number: Numbers, same: bool, seeds: int = 0) -> DataFrame:
    """chunk, block, who: the blocks that can have rows in the windows of a chunk's anchors, and which of these;
    with ``seeds`` so many blocks of the greatest bounds for each anchor."""
    pages = -(-max(1, n_blocks) // ZONES)
    zone = F.struct("at", "lo", "hi", "label_lo", "label_hi")
    zones = blocks.groupBy(F.pmod(F.xxhash64("at"), F.lit(pages)).cast("int").alias("page")).agg(F.collect_list(zone).alias("zones"))

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                z = r["zones"]
                at = np.array([k["at"] for k in z])
                lo, hi = (np.concatenate([number.vectors(k[c]) for k in z]).astype(np.float64) for c in ("lo", "hi"))
                label_lo, label_hi = (np.array([k[c] for k in z]) for c in ("label_lo", "label_hi"))
                a, labels = number.vectors(r["x"]).astype(np.float64), longs(r["labels"])[:, None]
                fits = (label_lo <= labels) & (labels <= label_hi) if same else ~((label_lo == labels) & (labels == label_hi))
                if number.exact:
                    under, over = bounds(a, lo, hi)
                    if seeds:
                        kth = np.partition(np.where(fits, over, -np.inf), -min(seeds, len(z)), axis=1)[:, -min(seeds, len(z))]
                        fits &= over >= kth[:, None]
                    else:
                        first, last = (longs(r[c]).reshape(len(a), -1) for c in ("first", "last"))
                        some = np.zeros(fits.shape, bool)
                        for w in range(first.shape[1]):
                            some |= (over >= first[:, w, None]) & (under <= last[:, w, None]) & (first[:, w, None] <= last[:, w, None])
                        fits &= some
                found = np.flatnonzero(fits.any(0))
                yield pa.RecordBatch.from_arrays([pa.array([r["at"]] * len(found), pa.int64()), pa.array(at[found], pa.int64()), pa.array([_who(fits[:, k]) for k in found], pa.binary())], names=["chunk", "block", "who"])

    each = chunks.select("at", "labels", "x", "first", "last", F.explode(F.sequence(F.lit(0), F.lit(pages - 1))).alias("page"))
    return each.join(zones, "page").mapInArrow(run, "chunk long, block long, who binary")


def best(scores: np.ndarray, ids: np.ndarray, places: np.ndarray, first: np.ndarray, last: np.ndarray, top: int):
    """For each row of ``scores`` and each of its windows the ``top`` greatest scores from ``first`` to ``last``,
    with ids and places; columns are in order of id and place.  Missing ones have an id of MOST and LEAST as score."""
    order = np.argsort(~scores if scores.dtype == np.int64 else -scores, axis=1, kind="stable")
    ranked = np.take_along_axis(scores, order, 1)
    shape = (len(scores), first.shape[1], top)
    out_s, out_i, out_p = np.full(shape, LEAST), np.full(shape, MOST), np.full(shape, MOST)
    for w in range(first.shape[1]):
        at = (ranked > last[:, w, None]).sum(1)[:, None] + np.arange(top)
        inside = at < scores.shape[1]
        at = np.minimum(at, scores.shape[1] - 1)
        s = np.take_along_axis(ranked, at, 1)
        inside &= (s >= first[:, w, None]) & (s > (LEAST if s.dtype == np.int64 else -np.inf))
        column = np.take_along_axis(order, at, 1)
        out_s[:, w], out_i[:, w], out_p[:, w] = np.where(inside, np.where(inside, s, 0).astype(np.int64), LEAST), np.where(inside, ids[column], MOST), np.where(inside, places[column], MOST)
    return out_s, out_i, out_p


def merged(a, b, top: int):
    """The ``top`` first of two results of ``best``."""
    s, i, p = (np.concatenate(x, axis=2) for x in zip(a, b, strict=True))
    order = np.lexsort((p, i, ~s), axis=2)[:, :, :top]
    return tuple(np.take_along_axis(x, order, 2) for x in (s, i, p))


FOUND = "chunk long, anchor int, anchor_id long, win int, score long, id long, place long"


def visited(pairs: DataFrame, chunks: DataFrame, blocks: DataFrame, n_blocks: int, n_chunks: int, number: Numbers, same: bool, top: int) -> DataFrame:
    """The first ``top`` rows in each window of each anchor, ordered by score, id and place."""
    # slices are smaller where there would be few tasks
    slices = max(1, -(-n_blocks // max(4, min(SLICE, n_blocks * max(1, n_chunks) // 64))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c.split()[0]: pa.array([], pa.int32() if c.endswith("int") else pa.int64()) for c in FOUND.split(", ")})
        c = left.to_pylist()[0]
        a, labels, ids = number.vectors(c["x"]).astype(number.product), longs(c["labels"]), longs(c["ids"])
        ids, own = ids[: len(labels)], ids[len(labels) :]
        first, last = (longs(c[k]).reshape(len(a), -1) for k in ("first", "last"))
        shape = (len(a), first.shape[1], top)
        found = [np.full(shape, LEAST), np.full(shape, MOST), np.full(shape, MOST)]
        none = LEAST if number.product is np.int64 else -np.inf
        for k in range(right.num_rows):
            r = {x: right.column(x)[k].as_py() for x in ("at", "ids", "labels", "x", "who")}
            who, block_ids = np.frombuffer(r["who"], np.uint16).astype(np.int64), longs(r["ids"])
            places = r["at"] + np.arange(len(block_ids))
            order = np.lexsort((places, _last(block_ids)))
            block_ids, places, block_labels = _last(block_ids[order]), places[order], longs(r["labels"])[order]
            v = number.vectors(r["x"])[order].astype(number.product)
            for lo in range(0, len(who), 512):
                w = who[lo : lo + 512]
                scores = a[w] @ v.T
                alike = labels[w, None] == block_labels
                scores[(~alike | (own[w, None] == places)) if same else alike] = none
                new = best(scores, block_ids, places, first[w], last[w], top)
                for x, y in zip(found, merged([x[w] for x in found], new, top), strict=True):
                    x[w] = y
        i, w, t = np.nonzero(found[2] != MOST)
        got = [np.full(len(i), c["at"]), i, ids[i], w, *(x[i, w, t] for x in found)]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 3]
        return pa.table({name.split()[0]: pa.array(x, kind) for name, x, kind in zip(FOUND.split(", "), got, kinds, strict=True)})

    # an int on both sides: keys of other types would hash apart
    slice_of = F.pmod(F.xxhash64("at"), F.lit(slices)).cast("int").alias("slice")
    right = pairs.join(blocks.select("at", "ids", "labels", "x", slice_of), F.col("block") == F.col("at")).select("chunk", "slice", "at", "ids", "labels", "x", "who")
    left = chunks.select(F.col("at").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "at", "ids", "labels", "x", "first", "last")
    rows = left.groupBy("chunk", "slice").cogroup(right.groupBy("chunk", "slice")).applyInArrow(run, FOUND)
    by = Window.partitionBy("chunk", "anchor", "win").orderBy(F.desc("score"), "id", "place")
    return rows.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)


def _last(ids: np.ndarray) -> np.ndarray:
    """A null id comes last among ties."""
    return np.where(ids == NULL_ID, MOST, ids)


def windows(chunks: DataFrame, found: DataFrame, make, width: int) -> DataFrame:
    """``chunks`` with the windows that ``make(scores, whether found)`` gives for what each anchor found."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left.select(names)
        n = left.column("n")[0].as_py()
        scores, have = np.zeros((n, width), np.int64), np.zeros((n, width), bool)
        i, k = right.column("anchor").to_numpy(), right.column("rank").to_numpy() - 1
        scores[i, k], have[i, k] = right.column("score").to_numpy(), True
        first, last = make(scores, have)
        left = left.drop_columns(["first", "last"])
        return left.append_column("first", pa.array([first.astype(np.int64).tobytes()], pa.binary())).append_column("last", pa.array([last.astype(np.int64).tobytes()], pa.binary())).select(names)

    names = ["at", "n", "ids", "labels", "x", "first", "last"]
    chunks = chunks.select(*names)
    schema = "at long, n int, ids binary, labels binary, x binary, first binary, last binary"
    return written(chunks.groupBy("at").cogroup(found.select(F.col("chunk").alias("at"), "anchor", "rank", "score").groupBy("at")).applyInArrow(run, schema))


def hard_negatives(embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``embeddings`` (vec_id,
    embedding, label).

    Components are floor(256 * x), scores integer inner products, greater first, ties by the smaller id.
    Anchors are the rows whose id ``every`` divides; their positives are the first ``positives`` other rows of
    their label.  For each the first ``negatives`` rows of other labels come whose score is from ``least`` to
    ``most`` hundredths of the positive's.  Labels of ids that 7 divides are moved on by one, modulo 10.

    Rows with a null label or vector, or a null, NaN or infinite component, take no part; a null id is no
    anchor and comes last among ties.  Rows that repeat are rows of their own, as anchors too; ties between
    rows of one id go by the order of the layout.  Shorter vectors count as filled up with zeros.  Scores
    beyond a long wrap around.  An anchor without positives or without rows in a window gives no rows.
    """
    spark, rows = embeddings.sparkSession, usable(embeddings)
    square = F.aggregate("x", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    s = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dims"), F.min(F.array_min("x")).alias("lo"), F.max(F.array_max("x")).alias("hi"), F.max(square).alias("length2")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not s.n:
        return spark.createDataFrame([], schema)
    lo, hi = s.lo or 0, s.hi or 0
    number = Numbers(s.dims, max(abs(lo), abs(hi)), s.length2)
    table = layout(rows, s.n, number, lo, hi, every)
    blocks, chunks = table.filter("NOT anchors"), table.filter("anchors")
    n = {r.anchors: r.n for r in table.groupBy("anchors").agg(F.count("*").alias("n")).collect()}
    n_blocks, n_chunks = n.get(False, 0), n.get(True, 0)
    open_ = lambda x: F.expr(f"unhex(repeat('{np.array([x], np.int64).tobytes().hex()}', n))")
    chunks = chunks.withColumn("first", open_(LEAST)).withColumn("last", open_(MOST))

    def step(chunks, same, top, seeds=0):
        return written(visited(needed(chunks, blocks, n_blocks, number, same, seeds), chunks, blocks, n_blocks, n_chunks, number, same, top))

    def at_least(scores, have):
        """From the last of the first ``positives`` found on, or any score where fewer are found."""
        return np.where(have.all(1), scores[:, -1], LEAST)[:, None], np.full((len(scores), 1), MOST)

    def between(scores, have):
        # least * p <= 100 * n <= most * p
        return np.where(have, -(-least * scores // 100), MOST), np.where(have, most * scores // 100, LEAST)

    seeds = step(chunks, True, positives, SEEDS)
    bounded = windows(chunks, seeds, at_least, positives)
    found = step(bounded, True, positives)
    narrow = windows(bounded, found, between, positives)
    below = step(narrow, False, negatives)
    real = lambda c: F.when(F.col(c) != int(MOST), F.col(c))
    up = found.select("chunk", "anchor", (F.col("rank") - 1).alias("win"), real("id").alias("positive_id"), F.col("score").alias("positive_score"))
    down = below.select("chunk", "anchor", "anchor_id", "win", "rank", real("id").alias("negative_id"), F.col("score").alias("negative_score"))
    for x in (seeds, bounded):
        removed(x)
    return down.join(up, ["chunk", "anchor", "win"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
