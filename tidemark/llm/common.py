"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: Column, folds: int) -> Column:
    """The held-out fold is 1."""
    return F.crc32(doc_id.cast("string")) % folds


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - offsets[:1]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as one compressed value, byte planes apart, so that equal high bytes cost nothing."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(blob: bytes, *types: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    widths = [np.dtype(t).itemsize for t in types]
    n, at, out = len(raw) // sum(widths), 0, []
    for kind, width in zip(types, widths, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind).reshape(n))
        at += n * width
    return out


def doc_ids(column: pa.Array) -> np.ndarray:
    """Ids as numbers; a missing id counts as the largest."""
    return pc.fill_null(column.cast(pa.int64()), np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


def batches(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """`df` without columns whose names the operator's results need; Spark compares names without case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def without(docs: DataFrame, rejected: DataFrame, key: Column) -> DataFrame:
    """`docs` without the rows whose (doc_id, key) is in `rejected` (doc_id, _key).

    The rejected keys are written first, so the planner sees their true size when it chooses the join.
    """
    rejected = cut_lineage(rejected.select(F.col("doc_id").alias("_id"), "_key").distinct())
    joined = docs.withColumn("_key_of_row", key)
    gone = joined["doc_id"].eqNullSafe(rejected["_id"]) & (joined["_key_of_row"] == rejected["_key"])
    return joined.join(rejected, gone, "left_anti").drop("_key_of_row")


#: Bits of one row of the bitmap of `likely`, and the fewest and most of them all: 128 KB to 32 MB, 16 for each key.
_SEGMENT = 1 << 15
_LEAST_BITS, _MOST_BITS, _BITS_PER_KEY = 20, 28, 16


def likely(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """All `rows` whose `key`, a long, is in `keys` (one column, longs), and few others, without moving a row.

    Every executor holds a bitmap of bounded size, one bit for each slot of hashes. With far more than 16 million keys
    it fills up, so that more of the others stay; those are for a join to remove.
    """
    (name,) = keys.columns
    bits = min(_MOST_BITS, max(_LEAST_BITS, (_BITS_PER_KEY * keys.count()).bit_length()))
    slot = lambda column: F.xxhash64(column).bitwiseAND((1 << bits) - 1)
    segment, place = (slot(name) / _SEGMENT).cast("int").alias("_segment"), slot(name) % _SEGMENT
    bitmap = keys.groupBy(segment).agg(F.bitmap_construct_agg(place).alias("_bits"))
    mark = rows.withColumn("_slot", slot(key)).withColumn("_at", (F.col("_slot") / _SEGMENT).cast("int"))
    found = mark.join(F.broadcast(bitmap), F.col("_at") == F.col("_segment"))
    place = (F.col("_slot") % _SEGMENT).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.where(F.getbit(byte, place % 8) == 1).select(*[F.col(f"`{c}`") for c in rows.columns])


def runs(keys: np.ndarray) -> np.ndarray:
    """True where a run of equal neighbours begins."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return new


def rebatch(tables: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most `size` rows."""
    for batch in tables:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)
