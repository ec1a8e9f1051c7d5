"""Sweeps next to appends and other sweeps, and comparisons of histories whose schemas differ."""

import hashlib

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.config import DAY_MS, HOUR_MS
from tidemark.operators import history
from tidemark.operators.history import history_diff, retention_expired, schema_diff, sweep_retention
from tidemark.sources import sweeps
from tidemark.sources.tables import append_observations, read_observations, sweep_history

NOW = 1_700_000_000_000


def _rows(spark, first, count, hours=24):
    day = "timestamp_millis(1700000000000L - (id % 9) * 86400000L)"
    return spark.range(first, first + count).selectExpr(
        "cast(id AS string) AS obs_id", "concat('s', id % 2) AS source_id", "concat('l', id % 5) AS listing_id", "cast(null AS string) AS store_id",
        "id AS amount_minor_units", "'USD' AS currency", f"{day} AS observed_at", "'UTC' AS source_time_zone",
        "cast(null AS timestamp) AS vendor_price_updated_at", f"{hours} AS raw_context_retention_hours", "concat('raw', id) AS raw_context",
        "cast(null AS string) AS availability",
    )


def _held(spark, path):
    return {r.obs_id: r.raw_context for r in read_observations(spark, path).collect()}


def _begin(spark, path):
    return sweeps.begin(spark, path, schemas.OBSERVATIONS, retention_expired(NOW), lambda rows: sweep_retention(rows, NOW))


def test_rows_appended_during_a_sweep_survive(spark, tmp_path):
    path = str(tmp_path / "history")
    append_observations(_rows(spark, 0, 90), path)
    sweep = _begin(spark, path)
    before = _held(spark, path)
    append_observations(_rows(spark, 100, 45), path)  # to the same days
    assert all(v is not None for v in before.values())  # nothing counts before it is committed
    assert sweep.publish()
    held = _held(spark, path)
    assert set(held) == {str(i) for i in [*range(90), *range(100, 145)]}
    due = {str(i) for i in range(90) if (i % 9) * DAY_MS > 24 * HOUR_MS}
    assert {i for i, v in held.items() if v is None} == due and sweep.rows == len(due)
    # The next sweep finds what came in between, and the one after it nothing.
    assert sweep_history(spark, path, NOW) == sum((i % 9) * DAY_MS > 24 * HOUR_MS for i in range(100, 145))
    assert sweep_history(spark, path, NOW) == 0
    assert len(_held(spark, path)) == 135


def test_of_two_sweeps_at_once_one_starts_again(spark, tmp_path):
    path = str(tmp_path / "history")
    append_observations(_rows(spark, 0, 30), path)
    one, two = _begin(spark, path), _begin(spark, path)
    assert one.publish() and not two.publish()
    assert len(_held(spark, path)) == 30 and sweep_history(spark, path, NOW) == 0


def test_pruned_reads_see_swept_rows_once(spark, tmp_path):
    path = str(tmp_path / "history")
    append_observations(_rows(spark, 0, 90), path)
    sweep_history(spark, path, NOW)
    some = read_observations(spark, path, NOW - 3 * DAY_MS, NOW - DAY_MS)
    assert sorted(r.obs_id for r in some.collect()) == sorted(str(i) for i in range(90) if i % 9 in (1, 2))


def test_columns_of_one_side_only_are_reported(spark):
    left = _rows(spark, 0, 20)
    right = left.withColumn("extra", F.lit("x"))
    assert [tuple(r) for r in schema_diff(left, right).collect()] == [("extra", None, "string")]
    assert history_diff(left, right).count() == 40 and history_diff(right, left).count() == 40
    assert history_diff(left, left.drop("availability")).count() == 0  # an absent column counts as null
    assert [r.column for r in schema_diff(left, left.drop("availability")).collect()] == ["availability"]


def test_days_that_agree_are_left_out(spark):
    left = _rows(spark, 0, 60)
    right = left.withColumn("raw_context", F.when(F.col("obs_id") != "4", F.col("raw_context"))).unionByName(left.where("obs_id = '7'"))
    got = sorted((r.obs_id, r.side) for r in history_diff(left, right).collect())
    assert got == [("4", "left"), ("4", "right"), ("7", "right")]
    bare = left.select("listing_id", "amount_minor_units")
    assert history_diff(bare, bare.where("amount_minor_units <> 3")).count() == 1
    assert history_diff(left, left).isEmpty()


def test_compared_rows_travel_once_as_values(spark, monkeypatch):
    monkeypatch.setattr(history, "ROWS_PER_TASK", 10)
    left = _rows(spark, 0, 40)
    right = left.withColumn("raw_context", F.lit(None).cast("string"))
    found = history_diff(left, right)
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(dealt) == 1 and ", 8), REPARTITION_BY_NUM" in dealt[0] and "amount_minor_units" in dealt[0]
    # Nothing is combined between the reading and the exchange.
    assert "HashAggregate" not in plan[plan.index(dealt[0]) :]
    got = {(r.obs_id, r.side): r for r in found.collect()}
    assert len(got) == 80 and got["7", "right"].raw_context is None
    for r in history.snapshot(left).collect():
        assert got[r.obs_id, "left"][: len(left.columns)] == r


def test_compared_texts_of_all_lengths(spark):
    texts = [None, "", "a", "x" * 15, "x" * 16, "x" * 17, "\u00e9" * 8, "y" * 9000]
    left = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "obs_id int, raw_context string")
    for i in range(len(texts)):
        right = spark.createDataFrame([(k, texts[i] if k == 0 else t) for k, t in enumerate(texts)], "obs_id long, raw_context string")
        got = sorted((r.side, r.obs_id, r.raw_context) for r in history_diff(left, right).collect())
        md5 = None if texts[i] is None else hashlib.md5(texts[i].encode()).hexdigest()
        assert got == ([] if i == 0 else [("left", "0", None), ("right", "0", md5)])
    bare = left.select("raw_context")
    assert history_diff(bare, bare).isEmpty()
    swapped = spark.createDataFrame([(1, None), (None, 2)], "a int, b int")
    assert history_diff(swapped.where("a = 1"), swapped.selectExpr("b as a", "a as b").where("b = 1")).count() == 2


def test_the_name_of_a_file_takes_time_by_the_length_of_its_path():
    import re
    import time

    from tidemark.sources import sweeps

    found = re.compile(getattr(sweeps, "FILE", r"([^/]+=[^/]*/)*[^/]+$"))
    cases = [
        ("file:/a/t/source_id=s/part.parquet", "source_id=s/part.parquet"), ("file:///a/t/x=1/y=a=b/p", "x=1/y=a=b/p"),
        ("/a=1/t/x=/p", "x=/p"), ("/a/t/p=1.parquet", "p=1.parquet"), ("p", "p"),
    ]
    assert [found.search(path).group() for path, _ in cases] == [want for _, want in cases]
    began = time.monotonic()
    assert found.search("/" + "a" * 20_000 + "/x=1/p").group() == "x=1/p"
    assert time.monotonic() - began < 0.5
