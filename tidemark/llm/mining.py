"""Hard negatives from candidate blocks in Hilbert order with zone maps.

Vectors are sorted along a Hilbert curve within their label and written to Parquet as blocks that know the least and
greatest value of every dimension. Interval arithmetic over those gives the range that the inner product of an anchor
with any row of a block lies in, and only blocks whose range reaches a window of the anchor are read for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import runs
from tidemark.session import cut_lineage

POSITIVES, NEGATIVES = 5, 3
BLOCK_ROWS = 256
#: Bits of each dimension in a row's place on the curve.
CURVE_BITS = 2
#: Every so many blocks are searched first, for scores that the other blocks must beat.
SEED_BLOCKS = 16
#: Components of anchors that are broadcast at once; further anchors take another turn over the blocks.
SLICE_VALUES = 1 << 21
#: Candidates that a task holds before it keeps the best of them.
HELD = 1 << 20

_BLOCKS = "block long, label long, ids binary, vectors binary, low binary, high binary"


class _Form(NamedTuple):
    """How vectors are stored and multiplied so that every score is exact."""

    dims: int
    stored: str
    work: str


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, vector (whole numbers) of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    vector = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    rows = embeddings.select("vec_id", "label", "embedding").where("vec_id is not null and label is not null and embedding is not null")
    return rows.where(finite).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), vector.alias("vector"))


def _form(rows: DataFrame) -> _Form:
    largest = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    seen = rows.agg(F.max(F.size("vector")).alias("dims"), F.max(largest).alias("largest")).first()
    dims, most = seen.dims or 0, seen.largest or 0
    stored = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    product = dims * most * most
    return _Form(dims, stored, "f4" if product < 1 << 24 else "f8" if product < 1 << 53 else "i8")


def _matrix(vectors: pa.ListArray, form: _Form) -> np.ndarray:
    """One row for each vector; a shorter vector is filled up with zeros."""
    ends = vectors.offsets.to_numpy()
    sizes, flat = np.diff(ends), vectors.flatten().to_numpy()
    out = np.zeros((len(vectors), form.dims), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


def curve_place(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve through a grid with 2**bits cells in each dimension, as byte strings of one length.

    Gray-code form: from the highest bit down the axes are exchanged or reflected as the curve turns, then bits of all
    dimensions are interleaved.
    """
    x = cells.astype(np.uint32).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        bit, below = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for d in range(n):
            turned = (x[d] & bit) != 0
            swap = np.where(turned, 0, (x[0] ^ x[d]) & below).astype(np.uint32)
            x[0] ^= np.where(turned, below, swap).astype(np.uint32)
            x[d] ^= swap
    for d in range(1, n):
        x[d] ^= x[d - 1]
    flip = np.zeros(x.shape[1], np.uint32)
    for level in range(bits - 1, 0, -1):
        if n:
            flip ^= np.where(x[-1] & np.uint32(1 << level), np.uint32((1 << level) - 1), np.uint32(0)).astype(np.uint32)
    x ^= flip
    planes = [(x >> np.uint32(level)) & np.uint32(1) for level in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


def _grid(rows: DataFrame, form: _Form) -> np.ndarray:
    """Borders between the cells of each dimension: mean, and one standard deviation to either side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(form.dims), np.zeros(form.dims)
        for batch in batches:
            v = _matrix(batch.column(0), form).astype(np.float64)
            n, total, square = n + len(v), total + v.sum(axis=0), square + (v * v).sum(axis=0)
        if n:
            columns = [np.arange(form.dims), np.full(form.dims, n), total, square]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["d", "n", "s", "q"])

    per_task = rows.select("vector").mapInArrow(run, "d long, n long, s double, q double")
    told = per_task.groupBy("d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect()  # one row a dimension
    borders = np.zeros((form.dims, 3))
    for r in told:
        mean = r.s / r.n
        borders[r.d] = mean + np.array([-1, 0, 1]) * max(0.0, r.q / r.n - mean * mean) ** 0.5
    return borders


def blocks_of(rows: DataFrame, form: _Form) -> DataFrame:
    """The candidate blocks, written: rows of one label, neighbours on the curve, with their zone maps."""
    borders = _grid(rows, form)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(2), form)
            cells = (v[:, :, None] >= borders[None]).sum(axis=2) if form.dims else v
            keys = [k.tobytes() for k in curve_place(cells, CURVE_BITS)] if form.dims else [b""] * len(v)
            packed = [x.tobytes() for x in v.astype(form.stored)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(packed, pa.binary())],
                names=["vec_id", "label", "place", "vector"],
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, ids, raw = None, [], []

        def block() -> pa.RecordBatch:
            v = np.frombuffer(b"".join(raw), form.stored).reshape(len(raw), form.dims)
            name = ids[0] * 31 + len(ids) if len(ids) else 0  # any number that spreads
            cells = [[name & 0x7FFFFFFFFFFFFFFF], [label], [np.array(ids, np.int64).tobytes()], [v.tobytes()],
                     [v.min(axis=0).tobytes()], [v.max(axis=0).tobytes()]]
            types = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types, strict=True)], names=["block", "label", "ids", "vectors", "low", "high"])

        for batch in batches:
            for i, of, vector in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (of != label or len(ids) == BLOCK_ROWS):
                    yield block()
                    ids, raw = [], []
                label = of
                ids.append(i)
                raw.append(vector)
        if ids:
            yield block()

    placed = rows.select("vec_id", "label", "vector").mapInArrow(place, "vec_id long, label long, place binary, vector binary")
    # The id is part of the range, so that any number of equal vectors spreads over partitions.
    ordered = placed.repartitionByRange("label", "place", "vec_id").sortWithinPartitions("label", "place", "vec_id")
    return cut_lineage(ordered.select("vec_id", "label", "vector").mapInArrow(cut, _BLOCKS))


class _Asks(NamedTuple):
    """Windows of anchors: which rows count, and between which scores (both included)."""

    vectors: np.ndarray  # of the anchors
    ids: np.ndarray
    labels: np.ndarray
    anchor: np.ndarray  # of each window, sorted
    least: np.ndarray
    most: np.ndarray
    same_label: bool
    keep: int


def _best(window: np.ndarray, score: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Places of the first `keep` of each window: highest score first, then smallest id."""
    order = np.lexsort((ids, -score, window))
    sorted_ = window[order]
    starts = np.flatnonzero(runs(sorted_))
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order)))
    return order[rank < keep]


def _scan(blocks: DataFrame, form: _Form, asks: _Asks) -> DataFrame:
    """window, score, vec_id: the best of each task for each window; blocks that can't hold any are not multiplied."""
    sent = blocks.sparkSession.sparkContext.broadcast(asks)
    work = np.dtype(form.work)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        vectors = q.vectors.astype(work)
        up, down = np.maximum(vectors, 0).T, np.minimum(vectors, 0).T
        least, most = q.least.copy(), q.most
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0

        def settle() -> None:
            """Keep the best of what is held; a window that is full asks for more from then on."""
            nonlocal held, count
            if not held:
                return
            window, score, ids = (np.concatenate(c) for c in zip(*held, strict=True))
            first = _best(window, score, ids, q.keep)
            window, score, ids = window[first], score[first], ids[first]
            ends = np.flatnonzero(runs(window[::-1])[::-1])
            full = ends[np.diff(ends, prepend=-1) == q.keep]
            least[window[full]] = np.maximum(least[window[full]], score[full])
            held, count = [(window, score, ids)], len(window)

        for batch in batches:
            for label, ids, raw, low, high in zip(*(batch.column(c).to_pylist() for c in ("label", "ids", "vectors", "low", "high")), strict=True):
                low, high = (np.frombuffer(x, form.stored).astype(work) for x in (low, high))
                top, bottom = high @ up + low @ down, low @ up + high @ down
                wanted = (q.labels == label) == q.same_label
                of = q.anchor
                reach = np.flatnonzero(wanted[of] & (top[of] >= least) & (bottom[of] <= most) & (least <= most))
                if not len(reach):
                    continue
                ids = np.frombuffer(ids, np.int64)
                rows = np.frombuffer(raw, form.stored).reshape(len(ids), form.dims).astype(work)
                anchors, column = np.unique(of[reach], return_inverse=True)
                scores = (vectors[anchors] @ rows.T)[column]
                hit = (scores >= least[reach, None]) & (scores <= most[reach, None]) & (ids[None] != q.ids[of[reach], None])
                if len(ids) > q.keep and hit.sum() > 2 * q.keep * len(reach):
                    lowest = np.where(hit, scores, -np.inf if work.kind == "f" else np.iinfo(work).min)
                    hit &= scores >= np.partition(lowest, len(ids) - q.keep, axis=1)[:, [len(ids) - q.keep]]
                w, r = np.nonzero(hit)
                if len(w):
                    held.append((reach[w], scores[w, r].astype(np.int64), ids[r]))
                    count += len(w)
                if count > HELD:
                    settle()
        settle()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], names=["window", "score", "vec_id"])

    return blocks.mapInArrow(run, "window long, score long, vec_id long")


def _first(found: DataFrame, keep: int) -> DataFrame:
    order = W.partitionBy("window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def _bound(blocks: DataFrame, form: _Form, asks: _Asks) -> _Asks:
    """The same windows, with the last place that a part of the blocks already fills as the least score."""
    seeds = blocks.where(F.pmod(F.xxhash64("block"), F.lit(SEED_BLOCKS)) == 0)
    told = _first(_scan(seeds, form, asks), asks.keep).where(F.col("rank") == asks.keep).select("window", "score").toPandas()
    least = asks.least.copy()
    least[told["window"].to_numpy()] = told["score"].to_numpy()  # one number a window
    return asks._replace(least=least)


def _mine(blocks: DataFrame, form: _Form, anchors: DataFrame) -> DataFrame:
    """The negatives of one slice of anchors."""
    spark = blocks.sparkSession
    held = anchors.toArrow().combine_chunks()  # one slice
    vectors = held.column("vector")
    vectors = _matrix(vectors.chunk(0), form) if vectors.num_chunks else np.zeros((0, form.dims), np.int64)
    ids, labels = held.column("vec_id").to_numpy(), held.column("label").to_numpy()
    limit = np.iinfo(np.int64)
    each = np.arange(len(ids))
    asks = _Asks(vectors, ids, labels, each, np.full(len(ids), limit.min // 4), np.full(len(ids), limit.max // 4), True, POSITIVES)
    found = _first(_scan(blocks, form, _bound(blocks, form, asks)), POSITIVES).toPandas().sort_values(["window", "rank"])  # five an anchor
    anchor, score = found["window"].to_numpy(np.int64), found["score"].to_numpy(np.int64)
    asks = _Asks(vectors, ids, labels, anchor, -((-50 * score) // 100), (95 * score) // 100, False, NEGATIVES)
    # An anchor's windows go by their place among all windows, which the names of the pairs follow.
    pairs = found[["vec_id", "score"]].rename(columns={"vec_id": "positive_id", "score": "positive_score"})
    pairs.insert(0, "window", np.arange(len(pairs)))
    pairs.insert(1, "anchor_id", ids[anchor])
    names = spark.createDataFrame(pairs, "window long, anchor_id long, positive_id long, positive_score long")
    negatives = _first(_scan(blocks, form, _bound(blocks, form, asks)), NEGATIVES)
    return negatives.join(names, "window").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )


def is_anchor(vec_id: Column) -> Column:
    return vec_id % 50 == 0


def hard_negatives(embeddings: DataFrame, anchors: Callable[[Column], Column] = is_anchor) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null vec_id, label or vector, or a null or non-finite component take no part; a shorter vector counts as
    filled up with zeros. Anchors equal in every column are one; "another row" is one with another vec_id, and rows
    that repeat a vec_id are rows of their own. Equal scores go by the smaller vec_id. Anchors without positives, and
    positives without negatives in their window, give no rows, as does an empty table. Scores must fit in 64 bits.
    Columns other than vec_id, label and embedding are ignored.

    Every anchor meets every block's zone map, but is multiplied only with blocks that its windows reach. A first
    search of a sixteenth of the blocks gives scores that the rest must beat; it decides no row. Anchors are taken in
    slices of bounded size, each against all blocks.
    """
    rows = cut_lineage(usable(embeddings))
    form = _form(rows)
    blocks = blocks_of(rows, form)
    asked = rows.where(anchors(F.col("vec_id"))).distinct()
    most = max(1, SLICE_VALUES // max(1, form.dims))
    slices = -(-rows.where(anchors(F.col("vec_id"))).count() // most)
    slice_ = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, slices)))
    results = [cut_lineage(_mine(blocks, form, asked.where(slice_ == s))) for s in range(max(1, slices))]
    return reduce(DataFrame.unionByName, results)
