"""Streams against the batch operators on the same rows, split over files and restarts."""

import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidemark.config import DAY_MS, BreakerSettings, Registry, Rule, Source
from tidemark.operators.requestlog import breaker_replay, period_counts
from tidemark.operators.rules import fired, replay_alerts, window_low
from tidemark.streaming import batches, stateful
from tidemark.streaming.batches import latest_counts, stream_ingest, stream_period_counts, stream_window_low
from tidemark.streaming.stateful import stream_breaker, stream_cooldowns

RULE = Rule("low", 30 * DAY_MS, 3, 10, 20 * DAY_MS)


def _observations(spark):
    # Prices that wander, one listing far busier than the others.
    return spark.range(600).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('l', id % 7) END AS listing_id", "'s' AS source_id",
        "lpad(cast(id AS string), 5, '0') AS obs_id", "timestamp_millis(id * 43200000L) AS observed_at",
        "cast(1000 + (id * 7919) % 613 AS long) AS amount_minor_units", "'USD' AS currency",
    )


def _files(df, path, by, parts):
    """One file per slice of time, in the order a stream reads them."""
    span = df.agg(F.max(by)).first()[0] + 1
    for part in range(parts):
        low, high = span * part // parts, span * (part + 1) // parts
        df.where((F.col(by) >= low) & (F.col(by) < high)).coalesce(1).write.mode("append").parquet(path)


def _rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def _drain(writer, checkpoint, batches=None):
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    assert query.exception() is None


def _stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_window_low_stream_matches_batch(spark, tmp_path):
    rows = _observations(spark)
    source, history, verdicts, checkpoint = (str(tmp_path / n) for n in ("in", "history", "verdicts", "cp"))
    _files(rows.withColumn("k", F.col("obs_id").cast("long")), source, "k", 3)
    stream = _stream(spark, source, rows.schema)
    _drain(stream_window_low(stream, [RULE], history, verdicts), checkpoint)
    # A second start finds nothing new and changes nothing.
    _drain(stream_window_low(stream, [RULE], history, verdicts), checkpoint)
    columns = ("listing_id", "obs_id", "status", "window_count", "reference_amount", "reference_at_ms")
    got = spark.read.parquet(verdicts)
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    want = window_low(rows, [RULE])
    assert sorted(map(key, got.select(*columns).collect())) == sorted(map(key, want.select(*columns).collect()))
    assert got.select("batch").distinct().count() == 3


def test_a_batch_reads_its_own_rows_once(spark, tmp_path, monkeypatch):
    rows = _observations(spark)
    source, history, verdicts, checkpoint = (str(tmp_path / n) for n in ("in", "history", "verdicts", "cp"))
    _files(rows.withColumn("k", F.col("obs_id").cast("long")), source, "k", 3)
    asked = []

    def spied(earlier, *given, only, **options):
        asked.append((earlier.count(), only.count(), earlier.join(only, "obs_id", "left_semi").count()))
        return window_low(earlier, *given, only=only, **options)

    monkeypatch.setattr(batches, "window_low", spied)
    _drain(stream_window_low(_stream(spark, source, rows.schema), [RULE], history, verdicts), checkpoint)
    assert asked[0][0] == 0 and asked[1][0] and [n for _, n, _ in asked] == [200] * 3 and not any(both for *_, both in asked)


def test_joining_rows_count_like_the_others(spark):
    rows = _observations(spark).unionByName(_observations(spark).where("obs_id = '00599'").withColumns({"listing_id": F.lit(None), "obs_id": F.lit("x")}))
    earlier, late = rows.where("try_cast(obs_id AS int) % 5 <> 0"), rows.where("try_cast(obs_id AS int) % 5 = 0 OR obs_id = 'x'")
    columns = ("obs_id", "status", "window_count", "reference_amount", "reference_at_ms", "mismatch_currency")
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    for hot_rows in (2_000, 50):
        want = window_low(earlier.unionByName(late), [RULE], hot_rows=hot_rows).join(late.select("obs_id"), "obs_id", "left_semi")
        got = window_low(earlier, [RULE], only=late, hot_rows=hot_rows, joining=True)
        assert sorted(map(key, got.select(*columns).collect())) == sorted(map(key, want.select(*columns).collect()))


def test_cooldown_state_survives_a_restart(spark, tmp_path):
    firings = fired(window_low(_observations(spark), [RULE])).select(
        "source_id", "listing_id", "rule_id", "at_ms", "obs_id", "amount_minor_units"
    )
    early, late = firings.where("at_ms < 130 * 86400000L"), firings.where("at_ms >= 130 * 86400000L")
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def run():
        kept = stream_cooldowns(_stream(spark, source, firings.schema), [RULE])
        _drain(kept.writeStream.format("parquet").option("path", out), checkpoint)

    early.coalesce(1).write.parquet(source)
    run()
    late.coalesce(1).write.mode("append").parquet(source)
    run()
    got = _rows(spark.read.parquet(out), "listing_id", "at_ms", "obs_id")
    assert got == _rows(replay_alerts(firings, [RULE]), "listing_id", "at_ms", "obs_id")
    assert len(got) < firings.count()


def test_breaker_state_matches_batch(spark, tmp_path):
    settings = BreakerSettings(3_600_000, 4, 0.5, 7_200_000)
    log = spark.range(800).selectExpr(
        "concat('s', id % 2) AS source_id", "id AS request_id", "timestamp_millis(id * 411000L) AS at",
        "CASE WHEN (id * 7919) % 11 < 4 THEN 500 ELSE 200 END AS status",
    )
    ready = log.selectExpr("source_id", "request_id", "unix_millis(at) AS at_ms", "int(status >= 400) AS failed")
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    _files(ready, source, "request_id", 2)
    pauses = stream_breaker(_stream(spark, source, ready.schema), settings)
    _drain(pauses.writeStream.format("parquet").option("path", out), checkpoint)
    columns = ("source_id", "tripped_ms", "paused_until_ms", "failures", "outcomes")
    assert _rows(spark.read.parquet(out), *columns) == _rows(breaker_replay(log, settings, slice_ms=30_000_000), *columns)


def test_period_counts_stream_matches_batch(spark, tmp_path):
    # The oldest requests arrive last, a week and more behind the newest.
    log = spark.range(500).selectExpr(
        "concat('s', id % 3) AS source_id", "id AS request_id", "timestamp_millis((499 - id) * 3600000L) AS at"
    )
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    _files(log, source, "request_id", 3)
    _drain(stream_period_counts(_stream(spark, source, log.schema), DAY_MS, out), checkpoint)
    columns = ("source_id", "period_start_ms", "requests")
    assert _rows(latest_counts(spark.read.parquet(out)), *columns) == _rows(period_counts(log, DAY_MS), *columns)


def test_ingest_stream_splits_without_loss(spark, tmp_path):
    registry = Registry((Source("s", "USD", "UTC", 24),))
    rows = spark.createDataFrame(
        [("s", str(i), "observed" if i % 3 else "extraction-failed", None if i % 3 else "no-price", 100 - 40 * (i % 4)) for i in range(40)]
        + [("other", "x", "observed", None, 5)],
        "source_id string, listing_id string, kind string, reason string, amount_minor_units long",
    ).selectExpr(
        "*", "'USD' AS currency", "'' AS availability", "cast(null AS long) AS vendor_updated_ms", "'raw' AS raw_context",
        "timestamp_millis(1000L) AS received_at",
    )
    source, history, quarantine, checkpoint = (str(tmp_path / n) for n in ("in", "h", "q", "cp"))
    rows.repartition(3).write.parquet(source)
    stream = _stream(spark, source, rows.schema)
    _drain(stream_ingest(stream, registry, history, quarantine), checkpoint)
    kept, set_aside = spark.read.parquet(history), spark.read.parquet(quarantine)
    assert kept.count() + set_aside.count() == rows.count()
    assert {r.refusal for r in set_aside.select("refusal").distinct().collect()} == {"no-price", "negative-amount", "unknown-source"}
    assert kept.where("raw_context_retention_hours = 24 and source_time_zone = 'UTC' and availability is null").count() == kept.count()


def test_an_ingest_stream_caches_nothing_and_leaves_nothing_behind(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame

    from tidemark.session import shared_folder

    def refuse(self, *_):
        raise AssertionError("a cached split is read whole by one task")

    monkeypatch.setattr(DataFrame, "persist", refuse)
    rows = spark.range(30).selectExpr(
        "'s' AS source_id", "string(id) AS listing_id", "'observed' AS kind", "string(null) AS reason", "id - 3 AS amount_minor_units",
        "'USD' AS currency", "'' AS availability", "cast(null AS long) AS vendor_updated_ms", "'raw' AS raw_context",
        "timestamp_millis(1000L) AS received_at",
    )
    source, history, quarantine, checkpoint = (str(tmp_path / n) for n in ("in", "h", "q", "cp"))
    rows.write.parquet(source)
    _drain(stream_ingest(_stream(spark, source, rows.schema), Registry((Source("s", "USD", "UTC", 24),)), history, quarantine), checkpoint)
    assert (spark.read.parquet(history).count(), spark.read.parquet(quarantine).count()) == (27, 3)
    assert not [name for name in os.listdir(shared_folder(spark)) if name.startswith("judged-")]


def test_a_request_without_a_status_is_a_failure_of_the_breaker_query(spark, monkeypatch):
    from tidemark.plans import queries, views

    requests_of = views.requests_of
    answered = _rows(queries.QUERIES["stream_breaker"](spark, "/root/testdata/sf0.01"), "source_id", "tripped_ms", "failures", "outcomes")
    monkeypatch.setattr(views, "requests_of", lambda events: requests_of(events).withColumn("status", F.expr("CASE WHEN status < 400 THEN status END")))
    unanswered = _rows(queries.QUERIES["stream_breaker"](spark, "/root/testdata/sf0.01"), "source_id", "tripped_ms", "failures", "outcomes")
    assert answered and unanswered == answered


def test_breaker_batches_out_of_order(spark, tmp_path):
    settings = BreakerSettings(600_000, 4, 0.5, 1_200_000)
    # The second batch brings outcomes from before the first one's newest: some within its window, some not.
    first = [("s", 10 + i, 3_000_000 + i * 100_000, i % 2) for i in range(3)]
    second = [("s", 1, 1_000_000, 1), ("s", 2, 2_900_000, 1), ("s", 3, 2_950_000, 0), ("t", 4, 5, 0)]
    third = [("s", 30, 3_300_000, 1), ("s", 31, 6_000_000, 1), *[("s", 32 + i, 9_000_000 + i, 1) for i in range(4)]]
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "source_id string, request_id long, at_ms long, failed int"
    for part in (first, second, third):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        pauses = stream_breaker(_stream(spark, source, spark.createDataFrame([], schema).schema), settings)
        _drain(pauses.writeStream.format("parquet").option("path", out), checkpoint)
    # 1,000,000 is out of the window; 2,900,000 makes four of which two failed, judged at the newest instant. What falls
    # into the pause is dropped, and the window starts empty behind it.
    got = _rows(spark.read.parquet(out), "source_id", "tripped_ms", "paused_until_ms", "failures", "outcomes")
    assert got == [("s", 3_200_000, 4_400_000, 2, 4), ("s", 9_000_003, 10_200_003, 4, 4)]


def test_cooldown_state_comes_with_the_rows(spark, tmp_path):
    import pandas as pd

    from tidemark.streaming import stateful

    class State:
        exists, get, told = True, (1_000,), None

        def update(self, value):
            self.told = value

    names, state = stateful.KEPT.names, State()
    parts = [
        pd.DataFrame([("s", "1", "r", at, obs, amount)], columns=names)
        for at, obs, amount in ((4_500, "d", 1), (2_500, "b", 2), (2_500, "a", 2), (1_500, "z", 1), (2_500, "c", 1))
    ]
    kept = pd.concat(stateful._cooldown({"r": 1_500})(("s", "1", "r"), iter(parts), state))
    assert (kept["obs_id"].tolist(), state.told) == (["c", "d"], (4_500,))
    firings = spark.readStream.schema(stateful.KEPT).parquet(str(tmp_path))
    plan = stream_cooldowns(firings, [RULE])._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInPandasWithState" in plan  # no server that is asked for each key


def test_cooldowns_of_many_listings_share_groups(spark, tmp_path):
    rows = spark.range(15_000).selectExpr(
        "'s' AS source_id", "concat('l', id % 5000) AS listing_id", "'low' AS rule_id", "(id div 5000) * 12 * 86400000L + id AS at_ms",
        "string(id) AS obs_id", "id AS amount_minor_units",
    )
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    rows.coalesce(2).write.parquet(source)
    kept = stream_cooldowns(spark.readStream.schema(rows.schema).parquet(source), [RULE])
    _drain(kept.writeStream.format("parquet").option("path", out), checkpoint)
    columns = ("listing_id", "at_ms", "obs_id")
    assert _rows(spark.read.parquet(out), *columns) == _rows(rows.where("at_ms div 1036800000 <> 1"), *columns)
    # A group costs milliseconds each time it is called for, so 5,000 listings are fewer groups.
    assert 2_000 < spark.read.format("statestore").load(checkpoint).count() <= stateful.BUCKETS < 5_000


def test_listings_of_a_bucket_do_not_touch_each_other(spark, tmp_path):
    big, day = (1 << 53) + 1, DAY_MS
    # Two batches; missing numbers and names, and an amount that no float holds, in whatever bucket.
    first = [("s", "a", "low", 0, "1", big), ("s", "a", "low", 0, "0", None), ("s", None, "low", 5, "2", None), (None, "s", "low", 7, "9", 3)]
    first += [("s", f"l{i}", "low", i * day, f"x{i}", big + i if i % 2 else None) for i in range(20)] + [("s", "a", "low", None, "7", 1)]
    second = [("s", "a", "low", 19 * day, "3", 1), ("s", "a", "low", 20 * day, "5", 2), ("s", "a", "low", 20 * day, "4", 1)]
    second += [("s", None, "low", 5 + 20 * day, "6", big), (None, "s", "low", 6 + 20 * day, "8", 1), ("s", "a", "other", 1, "1", 1)]
    rules = [RULE, Rule("other", 30 * DAY_MS, 3, 10, DAY_MS)]
    want = sorted([r for r in first if r[4] not in ("0", "7")] + [second[2], second[3], second[5]], key=str)
    for buckets in (1, 3, 4096):
        source, out, checkpoint = (str(tmp_path / f"{n}{buckets}") for n in ("in", "out", "cp"))
        for part in (first, second):
            spark.createDataFrame(part, stateful.KEPT).coalesce(1).write.mode("append").parquet(source)
            kept = stream_cooldowns(_stream(spark, source, stateful.KEPT), rules, buckets=buckets)
            _drain(kept.writeStream.format("parquet").option("path", out), checkpoint)
        got = spark.read.parquet(out)
        assert got.schema == stateful.KEPT
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_a_checkpoint_belongs_to_one_number_of_buckets(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for at, buckets in ((0, 1), (1, 2)):
        rows = spark.range(8).selectExpr(
            "'s' AS source_id", "string(id) AS listing_id", "'low' AS rule_id", f"{at}L AS at_ms", "'o' AS obs_id", "id AS amount_minor_units"
        )
        rows.coalesce(1).write.mode("append").parquet(source)
        kept = stream_cooldowns(_stream(spark, source, rows.schema), [RULE], buckets=buckets)
        if buckets == 1:
            _drain(kept.writeStream.format("parquet").option("path", out), checkpoint)
        else:
            with pytest.raises(StreamingQueryException, match="the checkpoint has 1 buckets, not 2"):
                _drain(kept.writeStream.format("parquet").option("path", out), checkpoint)


def test_cooldowns_go_on_from_a_state_per_listing(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for day in (0, 12, 24):
        rows = spark.range(3).selectExpr(
            "'s' AS source_id", "string(id) AS listing_id", "'low' AS rule_id", f"{day * DAY_MS}L AS at_ms", "'o' AS obs_id", "id AS amount_minor_units"
        )
        rows.coalesce(1).write.mode("append").parquet(source)
        kept = stream_cooldowns(_stream(spark, source, rows.schema), [RULE], buckets=None)
        _drain(kept.writeStream.format("parquet").option("path", out), checkpoint)
    assert _rows(spark.read.parquet(out), "at_ms", "listing_id") == [(day * DAY_MS, str(i)) for day in (0, 24) for i in range(3)]
    assert spark.read.format("statestore").load(checkpoint).count() == 3
