"""Exact deduplication: a two-pass Bloom filter lets single documents pass, and only possible repeats shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import own_columns, pack, unpack

SEGMENT_BITS = 20
#: The filter that every executor holds has 2**20 to 2**28 slots, 128 KB to 32 MB. Past some 30 million rows it
#: fills up: more rows are then possible repeats and shuffle, and the result stays the same.
LEAST_BITS, MOST_BITS = 20, 28
SLOTS_PER_ROW = 8


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two slots for each hash, from separate bits of it."""
    h = hashes.astype(np.int64).view(np.uint64)
    mask = np.uint64((1 << bits) - 1)
    return np.concatenate([h & mask, (h >> np.uint64(32)) & mask]).astype(np.uint32)


def _digest() -> Column:
    return F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)


def _hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """First pass: the slots that two or more rows hit, one bit each."""
    per_segment = pa.schema([("segment", pa.int32()), ("hits", pa.binary())])

    def hit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            slots, times = np.unique(_slots(batch.column(0).to_numpy(zero_copy_only=False), bits), return_counts=True)
            segments = slots >> SEGMENT_BITS
            for s in np.unique(segments):
                own = segments == s
                low = slots[own] & np.uint32((1 << SEGMENT_BITS) - 1)
                gaps = np.diff(low, prepend=np.uint32(0))
                blob = pack(gaps, np.minimum(times[own], 2).astype(np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([blob], pa.binary())], schema=per_segment)

    def merge(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in rows:
            for segment, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = held.setdefault(segment, np.zeros(1 << SEGMENT_BITS, np.uint8))
                gaps, times = unpack(blob.as_py(), "u4", "u1")
                at = np.cumsum(gaps)
                counts[at] = np.minimum(counts[at] + times, 2)
        for segment, counts in held.items():
            bitmap = np.packbits(counts >= 2).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([bitmap], pa.binary())], schema=per_segment)

    segments = 1 << (bits - SEGMENT_BITS)
    merged = hashes.mapInArrow(hit, "segment int, hits binary").repartition(segments, "segment").mapInArrow(merge, "segment int, hits binary")
    whole = np.zeros((segments, (1 << SEGMENT_BITS) // 8), np.uint8)
    for row in merged.collect():  # the filter itself, of bounded size
        whole[row.segment] = np.frombuffer(row.hits, np.uint8)
    return whole.reshape(-1)


def _marked(docs: DataFrame) -> DataFrame:
    """`docs` with its digest and whether another row may have the same text."""
    docs = own_columns(docs, "text_sha256", "keep_id", "group_size", "kept", "_possible", "_hash")
    spark = docs.sparkSession
    hashes = docs.select(_hash().alias("h"))
    bits = min(MOST_BITS, max(LEAST_BITS, (SLOTS_PER_ROW * max(1, hashes.count()) - 1).bit_length()))
    sent = spark.sparkContext.broadcast(_filter(hashes, bits))

    @F.pandas_udf("boolean")
    def possible(h: pd.Series) -> pd.Series:
        filled = sent.value
        slots = _slots(h.to_numpy(), bits)
        set_ = (filled[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1
        return pd.Series(set_.reshape(2, -1).all(axis=0))

    return docs.withColumn("text_sha256", _digest()).withColumn("_hash", _hash()).withColumn("_possible", possible("_hash")).drop("_hash")


def _groups(possible: DataFrame) -> DataFrame:
    """One row per text of the possible repeats; both steps combine before they shuffle."""
    rows = possible.groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))


def repeats(docs: DataFrame) -> DataFrame:
    """Which document stays of each group of equal texts, the one with the largest doc_id.

    A null text counts as empty, and empty texts are equal. Rows that repeat a doc_id with its text are one document,
    reported once and counted each time in `group_size`. A null doc_id stays only in a group that has no other.
    An empty table gives no rows. Columns of the input other than doc_id and text are not returned.
    Only digests and ids of possible repeats shuffle; a large group is combined first, and its join has a key that
    adaptive execution splits.
    """
    marked = _marked(docs.select("doc_id", "text")).select("doc_id", "text_sha256", "_possible")
    columns = [F.col("doc_id"), F.col("keep_id"), F.col("group_size"), F.col("kept"), F.col("text_sha256")]
    single = (
        marked.where("not _possible")
        .withColumn("keep_id", F.col("doc_id"))
        .withColumn("group_size", F.lit(1).cast("long"))
        .withColumn("kept", F.lit(True))
    )
    possible = marked.where("_possible")
    joined = possible.select("text_sha256", "doc_id").distinct().join(_groups(possible), "text_sha256")
    joined = joined.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return single.select(*columns).unionByName(joined.select(*columns))


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each group of equal texts, chosen as in `repeats`.

    Single documents are not shuffled. A possible repeat travels under (digest, doc_id), which spreads a large group;
    rows that repeat a doc_id with its text leave one of them. Columns named like those of `repeats` are dropped.
    """
    marked = _marked(docs)
    kept_columns = [F.col(f"`{c}`") for c in marked.columns if c not in ("text_sha256", "_possible")]
    possible = marked.where("_possible")
    keepers = _groups(possible.select("text_sha256", "doc_id")).select(F.col("text_sha256").alias("_sha"), "keep_id")
    candidates = possible.dropDuplicates(["text_sha256", "doc_id"])
    stays = (candidates["text_sha256"] == keepers["_sha"]) & candidates["doc_id"].eqNullSafe(keepers["keep_id"])
    return marked.where("not _possible").select(*kept_columns).unionByName(candidates.join(keepers, stays, "left_semi").select(*kept_columns))
