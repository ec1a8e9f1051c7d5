"""MinHash near-duplicates by an LSH forest.

Every distinct set of word shingles stands in TREES sorted orders, each by its own sequence of DEPTH minimum hashes.
Sets with a common prefix of at least LEAST_DEPTH values form a region of that order; a region that holds too many sets
is cut deeper, value by value, where it is dense and only there. Sets that share the longest common prefix that a region
allows are candidates of each other: first the most alike by a sketch of all minimum hashes, then whatever is left in a
region between different components. The full sets decide.

Two sets of similarity s lie in a common region of depth k of one order with probability s^k, so sets at the threshold
of 0.8 miss each other in all 20 orders with probability (1 - 0.8^3)^20 < 10^-6 at the least depth.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import ASCII_LOWER, likely, own_columns, rebatch, runs, utf8, without
from tidemark.llm.components import components
from tidemark.session import cut_lineage

SHINGLE = 4
#: Linked are sets with 100 * intersection >= PERCENT * union.
PERCENT = 80
TREES, DEPTH, LEAST_DEPTH = 20, 12, 3
#: A region with more sets is cut deeper, as long as there are values.
REGION = 1024
#: The most alike partners that a set is compared with in a round.
CLOSEST = 4
#: Sets whose sketches agree less can't be linked: 0.8 less about 4.4 standard deviations.
LEAST_AGREEMENT = 0.68
#: Bytes of one batch that is handed to Python.
BATCH_BYTES = 32 << 20
SEED = 12

_FUNCTIONS = TREES * DEPTH
#: Bits of each minimum that a sketch is compared by; two different minima agree in them once in 16.
_PLANES = 4
_ENOUGH = int(_FUNCTIONS * (LEAST_AGREEMENT + (1 - LEAST_AGREEMENT) / 2**_PLANES))
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 31, _FUNCTIONS, np.uint32) * np.uint32(2) + np.uint32(1)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_LAST = np.iinfo(np.int64).max


def shingle_hashes(text: bytes) -> np.ndarray:
    """The set of a text: sorted hashes of its word shingles; of all its words, if there are fewer; empty without words."""
    found = text.translate(ASCII_LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    n = max(1, len(found) - SHINGLE + 1)
    first, last = [0, *ends[: n - 1].tolist()], (ends[len(found) - n :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e], SEED) for s, e in zip(first, last, strict=True)], np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set that isn't empty."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(_FUNCTIONS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        np.minimum(out, (low[at : at + 512, None] * _FACTORS).min(axis=0), out=out)
    return out


def _keys(least: np.ndarray) -> np.ndarray:
    """One number for the first LEAST_DEPTH values of each order."""
    first = least.reshape(TREES, DEPTH)[:, :LEAST_DEPTH].astype(np.uint64)
    key = np.arange(1, TREES + 1, dtype=np.uint64)
    for k in range(LEAST_DEPTH):
        key = (key ^ first[:, k]) * _MIX[k % 3]
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """For every row: doc_id, row (its own number), _key of its text, n, the digest of its set, forest keys and sketch."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "row", "_key", "n", "digest", "keys", "sketch"]
        for batch in rebatch(rows, 500):
            data, at = utf8(batch.column(3))
            raw = data.tobytes()
            n, digests, keys, sketch = [], [], [], []
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                hashes = shingle_hashes(raw[s:e])
                least = minima(hashes) if len(hashes) else np.zeros(_FUNCTIONS, np.uint32)
                n.append(len(hashes)), digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                keys.append(_keys(least) if len(hashes) else []), sketch.append(least.astype(np.uint8).tobytes())
            made = [pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *made], names=names)

    read = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), _text_key().alias("_key"), "text")
    return read.mapInArrow(run, "doc_id long, row long, _key long, n long, digest binary, keys array<long>, sketch binary")


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def regions(printed: DataFrame, chosen: DataFrame) -> DataFrame:
    """region, row, n, sketch of every chosen set in every region of two sets or more.

    Regions start at the least depth. Where one has more than REGION sets, the prefixes of all greater depths are counted
    at once, and a set takes the least depth whose prefix is shared by no more than REGION sets, or else the greatest.
    Sets with a common prefix see the same counts, so they choose alike. Counts are combined aggregates that are joined
    back: no region is held as a whole. Most sets are alone in all their regions, and a bitmap keeps them from the joins.
    """
    narrow = cut_lineage(printed.select("row", "keys").join(chosen.select("row"), "row", "left_semi"))
    entries = narrow.select("row", F.posexplode("keys").alias("tree", "region"))
    sizes = cut_lineage(entries.groupBy("region").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    counted = cut_lineage(likely(entries, "region", sizes.select("region")).join(sizes, "region"))
    sketch = likely(printed.select("row", "n", "sketch"), "row", counted.select("row").distinct())
    small = counted.where(F.col("size") <= REGION).select("region", "row")
    large = cut_lineage(counted.where(F.col("size") > REGION))  # with its own size, often none
    large = large.join(sketch.select("row", "sketch"), "row")
    prefix = lambda k: F.xxhash64("region", F.substring("sketch", F.col("tree") * DEPTH + LEAST_DEPTH + 1, k))
    depths = F.transform(F.sequence(F.lit(1), F.lit(DEPTH - LEAST_DEPTH)), lambda k: F.struct(k.alias("k"), prefix(k).alias("deeper")))
    deep = cut_lineage(large.select("row", "tree", F.explode(depths).alias("d")).select("row", "tree", "d.*"))
    deep = deep.join(deep.groupBy("deeper").agg(F.count(F.lit(1)).alias("size")), "deeper")
    turn = F.when(F.col("size") <= REGION, F.col("k")).otherwise(2 * DEPTH - F.col("k"))
    cut = deep.groupBy("row", "tree").agg(F.min(F.struct(turn.alias("turn"), "deeper", "size")).alias("c")).where("c.size > 1")
    every = small.unionByName(cut.select(F.col("c.deeper").alias("region"), "row"))
    return cut_lineage(every.join(sketch, "row").select("region", "row", "n", "sketch"))


class _Sets(NamedTuple):
    """Sets of one region, their sketches as four bit planes."""

    row: np.ndarray
    label: np.ndarray
    n: np.ndarray
    planes: np.ndarray  # plane, set, word
    brief: list[np.ndarray]  # the full sets by the first 24 bits of each hash, in the last round

    def part(self, start: int, end: int) -> _Sets:
        cut = (x[start:end] for x in self[:3])
        return _Sets(*cut, self.planes[:, start:end], self.brief[start:end])

    def agreement(self, at: int, other: _Sets) -> np.ndarray:
        """In how many places a sketch agrees with others; less than any bound for sets that can't be linked or are already."""
        differ = self.planes[0, at] ^ other.planes[0]
        for plane in range(1, _PLANES):
            differ |= self.planes[plane, at] ^ other.planes[plane]
        same = _FUNCTIONS - np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
        n = self.n[at]
        fits = (100 * np.minimum(n, other.n) >= PERCENT * np.maximum(n, other.n)) & (other.label != self.label[at])
        return np.where(fits, same, -1)


def _sets(batch: pa.RecordBatch) -> _Sets:
    numbers = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "label", "n")]
    sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, _FUNCTIONS)
    padded = np.zeros((_PLANES, len(sketch), -(-_FUNCTIONS // 64) * 64), np.uint8)
    for plane in range(_PLANES):
        padded[plane, :, :_FUNCTIONS] = sketch >> plane & 1
    brief = [_opened(x) for x in batch.column("brief").to_pylist()] if "brief" in batch.schema.names else []
    return _Sets(*numbers, np.packbits(padded, axis=2).view(np.uint64), brief)


def _brief(hashes: np.ndarray) -> bytes:
    """The first 24 bits of each hash, in order."""
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :3].tobytes()


def _opened(brief: bytes) -> np.ndarray:
    out = np.zeros((len(brief) // 3, 4), np.uint8)
    out[:, 1:] = np.frombuffer(brief, np.uint8).reshape(-1, 3)
    return out.view(">u4")[:, 0].astype(np.uint32)


def _parts_of_regions(rows: Iterator[pa.RecordBatch]) -> Iterator[list[_Sets]]:
    """The sets of each region, in parts of one batch; rows come sorted by region."""
    now, parts = None, []
    for batch in rebatch(rows, 1000):
        region = batch.column("region").to_numpy()
        every = _sets(batch)
        starts = np.flatnonzero(runs(region))
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(region)], strict=True):
            if parts and region[s] != now:
                yield parts
                parts = []
            now = region[s]
            parts.append(every.part(s, e))
    if parts:
        yield parts


def _closest(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, agreement): for each set the most alike few of each part of its region."""
    for parts in _parts_of_regions(rows):
        for part in parts:
            found = []
            for at in range(len(part.row)):
                for other in parts:
                    same = part.agreement(at, other)
                    hit = np.flatnonzero(same >= _ENOUGH)
                    if len(hit) > CLOSEST:
                        hit = hit[np.argpartition(same[hit], -CLOSEST)[-CLOSEST:]]
                    if len(hit):
                        found.append((np.full(len(hit), part.row[at]), other.row[hit], same[hit]))
            if found:
                columns = [pa.array(np.concatenate(x)) for x in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "agreement"])


def _is_linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets that aren't empty are similar enough; never less so if their hashes are cut short."""
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    common = int((a[at] == b).sum())
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def _rest(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): pairs of one region and different components whose whole sets agree enough, by their cut hashes."""
    for parts in _parts_of_regions(rows):
        a, b = [], []
        for part in parts:
            for at, (row, brief) in enumerate(zip(part.row.tolist(), part.brief, strict=True)):
                for other in parts:
                    hit = np.flatnonzero((part.agreement(at, other) >= _ENOUGH) & (other.row < row))
                    linked = [k for k in hit.tolist() if _is_linked(brief, other.brief[k])]
                    a.extend(other.row[linked].tolist()), b.extend([row] * len(linked))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b)], names=["a", "b"])


def _candidates(places: DataFrame) -> DataFrame:
    """Pairs (a, b) to compare first, a < b: for each set the most alike few of all its regions."""
    cells = places.withColumn("label", F.col("row")).repartition("region").sortWithinPartitions("region")
    found = cells.mapInArrow(_closest, "a long, b long, agreement long").distinct()
    turn = F.row_number().over(W.partitionBy("a").orderBy(F.desc("agreement"), "b"))
    found = found.withColumn("turn", turn).where(F.col("turn") <= CLOSEST)
    return cut_lineage(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _candidates_left(places: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components and one region that are as good as linked.

    The sets go along, cut to three bytes a shingle, where two components meet; what can't be linked leaves no task.
    """
    named = cut_lineage(sets.select("row").join(labels, "row", "left").withColumn("label", F.coalesce("label", "row")))
    told = cut_lineage(places.join(named, "row"))
    mixed = told.groupBy("region").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("region")
    told = told.join(cut_lineage(mixed), "region", "left_semi").join(sets.select("row", "brief"), "row")
    cells = told.select("region", "row", "label", "n", "sketch", "brief")
    return cut_lineage(cells.repartition("region").sortWithinPartitions("region").mapInArrow(_rest, "a long, b long").distinct())


def _confirm(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets are similar enough."""
    for batch in rebatch(rows, 1000):
        sides = zip(batch.column("left"), batch.column("right"), strict=True)
        kept = [k for k, pair in enumerate(sides) if _is_linked(*(np.frombuffer(x.as_buffer(), np.uint64) for x in pair))]
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(kept, pa.int64())) for c in ("a", "b")], names=["a", "b"])


def _full_sets(docs: DataFrame, printed: DataFrame, pairs: DataFrame) -> DataFrame:
    """row, hashes and cut hashes of the sets of `pairs`, made again from their texts; other texts don't move."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatch(rows, 500):
            data, at = utf8(batch.column(1))
            raw = data.tobytes()
            sets = [shingle_hashes(raw[s:e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            cells = [pa.array([form(x) for x in sets], pa.binary()) for form in (np.ndarray.tobytes, _brief)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cells], names=["row", "hashes", "brief"])

    ends = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct()
    named = cut_lineage(printed.select("row", F.col("doc_id").alias("_id"), F.col("_key").alias("_k")).join(ends, "row", "left_semi"))
    texts = likely(docs.select("doc_id", "text", _text_key().alias("_key")), "_key", named.select("_k"))
    texts = texts.join(named, texts["doc_id"].eqNullSafe(named["_id"]) & (texts["_key"] == named["_k"]))
    return cut_lineage(texts.select("row", "text").dropDuplicates(["row"]).mapInArrow(run, "row long, hashes binary, brief binary"))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that are linked, confirmed on the full sets."""
    left, right = (sets.select(F.col("row").alias(k), F.col("hashes").alias(side)) for k, side in (("a", "left"), ("b", "right")))
    return cut_lineage(pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(_confirm, "a long, b long"))


def _connected(docs: DataFrame, printed: DataFrame, places: DataFrame) -> DataFrame | None:
    """row and label of every set that is linked with another; None if no two are.

    First every set is compared with the most alike few, which connects most of a group by a few comparisons for each
    member. Then all pairs that are left between components are compared within their regions; what is linked there is
    confirmed like the first pairs.
    """
    pairs = _candidates(places)
    if pairs.isEmpty():
        return None
    sets = _full_sets(docs, printed, pairs)  # of every set that has any possible partner
    labels = _labels(_linked(pairs, sets))
    edges = labels.select(F.col("row").alias("a"), F.col("label").alias("b"))
    left = _candidates_left(places, labels, sets)
    return labels if left.isEmpty() else _labels(edges.unionByName(_linked(left, sets)))


def _labels(links: DataFrame) -> DataFrame:
    return cut_lineage(components(links).select(F.col("node").alias("row"), F.col("root").alias("label")))


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, _key, n, component_id of every document."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    printed = cut_lineage(sketches(docs))
    order = F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("id"), "row")
    classes = printed.where("n > 0").groupBy("digest").agg(F.min(order).alias("m"))
    classes = cut_lineage(classes.select("digest", F.col("m.row").alias("row"), F.col("m.id").alias("least")))
    labels = _connected(docs, printed, regions(printed, classes))
    if labels is None:
        of = classes.withColumn("component_id", F.col("least"))
    else:
        joined = classes.join(labels, "row", "left").withColumn("label", F.coalesce("label", "row"))
        smallest = joined.groupBy("label").agg(F.min("least").alias("component_id"))
        of = joined.join(smallest, "label")
    narrow = printed.select("doc_id", "_key", "n", "digest")
    alone = narrow.where("n = 0").withColumn("component_id", F.col("doc_id")).drop("digest")
    component = F.when(F.col("component_id") < _LAST, F.col("component_id")).alias("component_id")
    member = narrow.where("n > 0").join(of.select("digest", component), "digest").drop("digest")
    return alone.unionByName(member)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """For every row of `docs` the size of its shingle set, its component, and whether it stays.

    Texts link at a similarity of 0.8 of their sets of four-word shingles; a text of fewer words is one shingle. The
    component is the smallest doc_id reachable over links. Texts without words (null, empty, blank) are linked with
    nothing, not even each other. Rows equal in their set are one node, whatever their number; repeated rows are
    reported each and stay together. A null doc_id is never the smallest unless its component has no other. An empty
    table gives no rows. Columns other than doc_id and text are not returned.

    Links of pairs at the threshold are found with a probability beyond 0.999999 where regions keep the least depth;
    in regions cut to depth k, with 1 - (1 - 0.8^k)^20. A found link is always confirmed on the full sets.
    """
    found = _grouped(docs)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept)


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each component, the one that names it; all columns stay, and so do its repeated rows."""
    gone = _grouped(docs).where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    return without(own_columns(docs, "_key", "_key_of_row", "_id"), gone, F.xxhash64(F.coalesce("text", F.lit(""))))
