"""Readers and writers: history, pages, responses, outbox, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators.history import history_diff, retention_expired, sweep_retention
from tidemark.operators.rules import between
from tidemark.sources import sweeps

HISTORY_PARTITIONS = ("source_id", "observed_date")


def read_observations(spark: SparkSession, path: str, after_ms: int | None = None, until_ms: int | None = None) -> DataFrame:
    """The history, or the half-open stretch `after < observed_at <= until` of it.

    Given both ends, date partitions outside them are not listed and the instants
    are pushed to the scan.
    """
    rows = sweeps.current(spark, path, schemas.OBSERVATIONS)
    if after_ms is None or until_ms is None:
        return rows
    return between(rows, after_ms, until_ms)


def append_observations(accepted: DataFrame, path: str) -> None:
    """Append guarded rows, partitioned by source and day.

    The rebalance hint lets a hot source-day become several files while small
    ones share a task.
    """
    # The UTC day whatever the session's zone is, as `between` prunes by it.
    dated = accepted.withColumn("observed_date", F.date_from_unix_date(F.floor(F.unix_millis("observed_at") / 86_400_000).cast("int")))
    dated.hint("rebalance", *HISTORY_PARTITIONS).write.mode("append").partitionBy(*HISTORY_PARTITIONS).parquet(path)


def append_refused(refused: DataFrame, path: str) -> None:
    """Set refused rows aside by their reason."""
    refused.write.mode("append").partitionBy("refusal").parquet(path)


def sweep_history(spark: SparkSession, path: str, as_of_ms: int) -> int:
    """Null expired raw content; returns how many rows were cleared.

    Only files that hold expired rows are replaced, by a commit that later readers go by; rows that are appended
    meanwhile, to the same day or another, stay. A sweep that meets another one's commit starts again.
    """
    while True:
        sweep = sweeps.begin(spark, path, schemas.OBSERVATIONS, retention_expired(as_of_ms), lambda rows: sweep_retention(rows, as_of_ms))
        if sweep is None:
            return 0
        if sweep.publish():
            return sweep.rows


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Saved pages as a table of markup."""
    return spark.read.schema(schemas.PAGES).parquet(path)


def read_page_files(spark: SparkSession, path: str) -> DataFrame:
    """Saved pages, one file each; the whole file is the markup."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("url"), F.col("value").alias("html")
    )


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Saved vendor responses, one JSON record per line, the body kept as text."""
    return spark.read.schema(schemas.RESPONSES).json(path)


def write_outbox(composed: DataFrame, path: str) -> None:
    """Append composed alerts for a deliverer to pick up."""
    composed.write.mode("append").parquet(path)


def write_version(df: DataFrame, root: str, version: int) -> str:
    """Write a table as a new version next to the one it was computed from."""
    path = f"{root}/version={version:08d}"
    df.write.mode("errorifexists").parquet(path)
    return path


def write_snapshot(observations: DataFrame, path: str) -> None:
    """A copy of the history to compare a restored one with."""
    observations.write.mode("errorifexists").parquet(path)


def compare_with_snapshot(observations: DataFrame, path: str) -> DataFrame:
    """Rows in which a history and a snapshot of it differ; columns that only one of them has count as null."""
    return history_diff(observations, observations.sparkSession.read.parquet(path))
