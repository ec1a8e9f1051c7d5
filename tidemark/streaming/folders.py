"""A history that streams append to: rows by month, and few folders in each however many batches there were.

A batch writes `month=<m>/part=0-<id>-<id>`, over what it wrote before if it is repeated. When a month has `MERGE_AT` parts of
one tier, they are written once more as one part of the next tier, named by the batches it covers. A part counts unless a
complete part of a higher tier covers it; covered ones are deleted when the month is next written to, so a reader that has
just listed them still finds them. A history belongs to the checkpoint of one stream, whose batch ids it counts by. A row is rewritten once per tier, and a month lists at most MERGE_AT parts per tier.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.instants import millis
from tidemark.sources.sweeps import _files

MERGE_AT = 8
UNDATED = "none"

Part = tuple[int, int, int]


def _month(ms: int) -> str:
    return dt.datetime.fromtimestamp(ms / 1000, dt.timezone.utc).strftime("%Y-%m")


def _listed(spark: SparkSession, path: str) -> list[str]:
    fs, folder = _files(spark, path)
    return [status.getPath().getName() for status in fs.listStatus(folder)] if fs.exists(folder) else []


def _parts(spark: SparkSession, folder: str) -> list[Part]:
    """The complete parts of a month. A batch's part is complete by Spark's commit, a merged one by its marker."""
    found = [re.fullmatch(r"part=(\d+)-(\d+)-(\d+)", name) for name in _listed(spark, folder)]
    parts = [tuple(map(int, match.groups())) for match in found if match]
    return [p for p in parts if p[0] == 0 or "_SUCCESS" in _listed(spark, f"{folder}/{_name(p)}")]


def _name(part: Part) -> str:
    return "part={}-{:012d}-{:012d}".format(*part)


def _covered(parts: list[Part]) -> set[Part]:
    return {p for p in parts for q in parts if q[0] > p[0] and q[1] <= p[1] and p[2] <= q[2]}


def _months(spark: SparkSession, path: str) -> list[str]:
    return sorted(name[6:] for name in _listed(spark, path) if name.startswith("month="))


def append(batch: DataFrame, path: str, batch_id: int) -> None:
    """Write a batch, idempotently, and merge what earlier batches left in its months."""
    spark = batch.sparkSession
    at = F.timestamp_millis(millis(F.col("observed_at")))
    dated = batch.withColumns({
        "month": F.coalesce(F.date_format(at, "yyyy-MM"), F.lit(UNDATED)), "part": F.lit(_name((0, batch_id, batch_id))[5:]),
    })
    # A part of its own rows, whatever the session says about overwriting.
    dated.hint("rebalance", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "part").parquet(path)
    for month in _months(spark, path):
        _tidy(spark, f"{path}/month={month}", batch.schema, batch_id)


def _tidy(spark: SparkSession, folder: str, schema: StructType, batch_id: int) -> None:
    """Delete covered parts of a month, and merge the tiers that are full of parts no batch can write again."""
    parts = _parts(spark, folder)
    if all(p[1] != batch_id for p in parts):
        return
    gone = _covered(parts)
    fs, _ = _files(spark, folder)
    for part in gone:
        fs.delete(_files(spark, f"{folder}/{_name(part)}")[1], True)
    live = sorted(set(parts) - gone)
    for tier in sorted({p[0] for p in live}):
        full = [p for p in live if p[0] == tier and p[2] < batch_id]
        if len(full) >= MERGE_AT:
            merged = (tier + 1, min(p[1] for p in full), max(p[2] for p in full))
            rows = spark.read.schema(schema).parquet(*[f"{folder}/{_name(p)}" for p in full])
            rows.write.mode("overwrite").parquet(f"{folder}/{_name(merged)}")


def folders(
    spark: SparkSession, path: str, after_ms: int | None = None, until_ms: int | None = None, but: int | None = None
) -> list[str]:
    """The folders that hold `after <= observed_at <= until`, or everything: what a reader has to list.

    `but` leaves out what the batch of that id wrote, as long as no later batch has been.
    """
    first, last = (None if ms is None else _month(ms) for ms in (after_ms, until_ms))
    asked: Iterable[str] = _months(spark, path)
    if first is not None and last is not None:
        asked = [month for month in asked if month != UNDATED and first <= month <= last]
    out = []
    for month in asked:
        parts = _parts(spark, f"{path}/month={month}")
        out += [f"{path}/month={month}/{_name(p)}" for p in sorted(set(parts) - _covered(parts)) if p != (0, but, but)]
    return out


def arrived(spark: SparkSession, path: str, schema: StructType, batch_id: int) -> DataFrame:
    """The rows of one batch as they were written; only as long as no later batch has been."""
    name = _name((0, batch_id, batch_id))
    asked = [f"{path}/month={month}" for month in _months(spark, path)]
    found = [f"{folder}/{name}" for folder in asked if name in _listed(spark, folder)]
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def read(
    spark: SparkSession, path: str, schema: StructType | str, after_ms: int | None = None, until_ms: int | None = None, but: int | None = None
) -> DataFrame:
    """The rows of a stretch of the history (whole months of it), or all of them; each once, merged or not."""
    asked = folders(spark, path, after_ms, until_ms, but)
    return spark.read.schema(schema).parquet(*asked) if asked else spark.createDataFrame([], schema)
