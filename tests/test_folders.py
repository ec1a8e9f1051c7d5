"""The history of streams: merged months against plain rows."""

from pyspark.sql import functions as F

from tidemark.config import DAY_MS, Rule
from tidemark.operators.rules import window_low
from tidemark.streaming import batches, folders

SCHEMA = "source_id string, listing_id string, obs_id string, ms long, amount_minor_units long, currency string"
START = 1_700_000_000_000


def _batch(spark, batch_id, days=(0,)):
    rows = [("s", "a", f"{batch_id}-{d}", None if d is None else START + d * DAY_MS + batch_id, 5, "USD") for d in days]
    return spark.createDataFrame(rows, SCHEMA).withColumn("observed_at", F.timestamp_millis("ms")).coalesce(1)


def _ids(df):
    return sorted(r.obs_id for r in df.collect())


def test_parts_stay_few_and_rows_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(folders, "MERGE_AT", 3)
    path, want = str(tmp_path / "history"), []
    for batch_id in range(40):
        days = (0, 40) if batch_id % 10 == 0 else (0,)
        batch = _batch(spark, batch_id, days)
        folders.append(batch, path, batch_id)
        if batch_id % 7 == 0:
            folders.append(batch, path, batch_id)
        want += [f"{batch_id}-{d}" for d in days]
        assert _ids(folders.arrived(spark, path, batch.schema, batch_id)) == sorted(f"{batch_id}-{d}" for d in days)
    assert _ids(folders.read(spark, path, batch.schema)) == sorted(want)
    # Forty batches: at most three parts a tier, four tiers, and the newest.
    assert len(folders.folders(spark, path, START, START)) <= 13
    listed = folders._listed(spark, f"{path}/month=2023-11")
    assert len([name for name in listed if name.startswith("part=")]) <= 20
    assert _ids(folders.read(spark, path, batch.schema, START + 40 * DAY_MS, START + 40 * DAY_MS)) == sorted(f"{i}-40" for i in range(0, 40, 10))
    assert folders.read(spark, path, batch.schema, START + 400 * DAY_MS, START + 500 * DAY_MS).count() == 0


def test_an_unfinished_merge_does_not_count(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(folders, "MERGE_AT", 2)
    path = str(tmp_path / "history")
    for batch_id in range(3):
        folders.append(_batch(spark, batch_id), path, batch_id)
    merged = [p for p in (tmp_path / "history" / "month=2023-11").iterdir() if p.name.startswith("part=1-")]
    assert len(merged) == 1
    (merged[0] / "_SUCCESS").unlink()
    schema = _batch(spark, 0).schema
    assert _ids(folders.read(spark, path, schema)) == ["0-0", "1-0", "2-0"]
    # The next batch merges again, over what was left.
    folders.append(_batch(spark, 3), path, 3)
    folders.append(_batch(spark, 4), path, 4)
    assert _ids(folders.read(spark, path, schema)) == [f"{i}-0" for i in range(5)]


def test_undated_rows_and_nothing(spark, tmp_path):
    path = str(tmp_path / "history")
    batch = _batch(spark, 0, (0, None))
    assert folders.read(spark, path, batch.schema).count() == 0
    folders.append(batch, path, 0)
    assert _ids(folders.read(spark, path, batch.schema)) == ["0-0", "0-None"]
    assert _ids(folders.read(spark, path, batch.schema, START, START)) == ["0-0"]


def test_window_low_over_many_small_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(folders, "MERGE_AT", 2)
    rows = spark.range(60).selectExpr(
        "'s' AS source_id", "'a' AS listing_id", "lpad(cast(id AS string), 3, '0') AS obs_id", f"timestamp_millis({START}L + id * {DAY_MS}L) AS observed_at",
        "1000 + (id * 7919) % 613 AS amount_minor_units", "'USD' AS currency",
    )
    source, history, verdicts = (str(tmp_path / n) for n in ("in", "history", "verdicts"))
    for part in range(6):
        rows.where(f"cast(obs_id AS int) div 10 = {part}").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    rule = Rule("low", 30 * DAY_MS, 3, 10, DAY_MS)
    query = batches.stream_window_low(stream, [rule], history, verdicts).option("checkpointLocation", str(tmp_path / "cp"))
    query = query.trigger(availableNow=True).start()
    assert query.awaitTermination(240) and query.exception() is None
    told = lambda df: sorted((r.obs_id, r.status, r.window_count) for r in df.collect())
    assert told(spark.read.parquet(verdicts)) == told(window_low(rows, [rule]))
