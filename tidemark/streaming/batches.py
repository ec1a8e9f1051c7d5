"""Streams whose state is a table: each micro-batch is one idempotent write.

A batch writes its own `batch=<id>` directories, or its own part of each month of
a history, and overwrites them when it is repeated, so a restart from the
checkpoint changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.config import Registry, Rule
from tidemark.functions.instants import millis
from tidemark.operators.history import accepted, ingest, refused
from tidemark.operators.requestlog import period_counts
from tidemark.operators.rules import between, window_low
from tidemark.session import scratch_path
from tidemark.sources.sweeps import _files
from tidemark.streaming import folders


def _replace(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def stream_ingest(outcomes: DataFrame, registry: Registry, history: str, quarantine: str) -> DataStreamWriter:
    """Outcomes to the history (read it with `folders.read`) and the quarantine; nothing is dropped."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # Judged once, in files, which later tasks read in bounded pieces: a cached split is many times its file's size.
        path, told = scratch_path(spark, "judged"), ingest(batch, registry)
        try:
            told.write.parquet(path)
            judged = spark.read.schema(told.schema).parquet(path)
            folders.append(accepted(judged), history, batch_id)
            _replace(refused(judged), quarantine, batch_id)
        finally:
            fs, folder = _files(spark, path)
            fs.delete(folder, True)

    return outcomes.writeStream.foreachBatch(write)


def stream_window_low(
    observations: DataFrame, rules: Sequence[Rule], history: str, verdicts: str, history_keys: Sequence[str] = ("listing_id",)
) -> DataStreamWriter:
    """A verdict for every arriving observation over the history that has arrived by then.

    The batch joins the history first and is then judged against it, by the batch
    operator: a late row sees what lies before its own instant and re-opens no
    verdict. The history is a table, so a hot listing is no larger a state than
    any other stretch of it.
    """
    widest = max(rule.window_ms for rule in rules)

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        folders.append(batch, history, batch_id)
        arrived = folders.arrived(spark, history, batch.schema, batch_id)
        span = arrived.agg(F.min(millis(F.col("observed_at"))), F.max(millis(F.col("observed_at")))).first()
        if span[0] is None:
            _replace(window_low(arrived, rules, history_keys), verdicts, batch_id)
            return
        # Only the months that a window of this batch reaches are listed, and few folders in each. Its own rows are read
        # once, as those that ask and count.
        stored = folders.read(spark, history, batch.schema, span[0] - widest, span[1], but=batch_id)
        earlier = between(stored, span[0] - widest, span[1])
        _replace(window_low(earlier, rules, history_keys, only=arrived, joining=True), verdicts, batch_id)

    return observations.writeStream.foreachBatch(write)


def stream_period_counts(requests: DataFrame, period_ms: int, counts: str) -> DataStreamWriter:
    """Requests per source and epoch-aligned period, kept as what each batch adds.

    No request is too late: a batch writes its own sums, and `latest_counts` adds them up. Nothing is held between
    batches, so there is no state to bound and no watermark to drop rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        _replace(period_counts(batch, period_ms), counts, batch_id)

    return requests.writeStream.foreachBatch(write)


def latest_counts(added: DataFrame) -> DataFrame:
    """The count of every source and period over all batches."""
    return added.groupBy("source_id", "period_start_ms").agg(F.sum("requests").alias("requests"))
