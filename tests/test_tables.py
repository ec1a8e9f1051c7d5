"""The history, the watchlist, exports and their files."""

import pytest
from pyspark.sql import functions as F

from tidemark.config import HOUR_MS, Registry, Source
from tidemark.operators import export, history, watchlist
from tidemark.operators.robots import robots_decide, robots_other_records, selected_rules
from tidemark.operators.rules import between
from tidemark.plans import views
from tidemark.sources import tables

NOW = 1_700_000_000_000
REGISTRY = Registry((
    Source("a", "USD", "America/New_York", 24, 72, True, "Acme", "Prices by Acme"), Source("b", "JPY", "UTC"),
))


def observations(spark, n=40):
    return spark.range(n).selectExpr(
        "cast(id AS string) AS obs_id", "CASE WHEN id % 4 = 0 THEN 'b' ELSE 'a' END AS source_id", "concat('l', id % 5) AS listing_id",
        "cast(null AS string) AS store_id", "id * 100 + 99 AS amount_minor_units", "'USD' AS currency",
        f"timestamp_millis({NOW}L - id * 7 * {HOUR_MS}L) AS observed_at", "'UTC' AS source_time_zone",
        "cast(null AS timestamp) AS vendor_price_updated_at", "cast(CASE id % 3 WHEN 0 THEN 24 WHEN 1 THEN 72 END AS int) AS raw_context_retention_hours",
        "concat('raw', id) AS raw_context", "cast(null AS string) AS availability",
    )


def test_history_round_trip_and_pruning(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = observations(spark)
    tables.append_observations(rows, path)
    stored = tables.read_observations(spark, path)
    assert history.history_diff(rows, stored.drop("observed_date")).isEmpty()
    window = tables.read_observations(spark, path, NOW - 48 * HOUR_MS, NOW)
    assert window.count() == between(rows, NOW - 48 * HOUR_MS, NOW).count() == 7
    plan = window._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "observed_date" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "GreaterThanOrEqual(observed_at" in scan


def test_sweep_touches_only_expired_content_and_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = observations(spark)
    tables.append_observations(rows, path)
    want = history.sweep_retention(rows, NOW)
    cleared = tables.sweep_history(spark, path, NOW)
    assert cleared == history.swept(rows, NOW).agg(F.sum("deleted")).first()[0] > 0
    after = tables.read_observations(spark, path).drop("observed_date")
    assert history.history_diff(want, after).isEmpty()
    assert after.where("raw_context_retention_hours is null and raw_context is null").isEmpty()
    assert tables.sweep_history(spark, path, NOW) == 0
    assert history.swept(after, NOW).isEmpty()


def test_retention_ends_strictly_after_its_hours(spark):
    at = lambda ms: observations(spark, 1).withColumn("observed_at", F.timestamp_millis(F.lit(ms)))
    assert history.swept(at(NOW - 24 * HOUR_MS), NOW).isEmpty()
    assert not history.swept(at(NOW - 24 * HOUR_MS - 1), NOW).isEmpty()


def test_snapshots_show_any_difference(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    rows = observations(spark)
    tables.write_snapshot(rows, path)
    assert tables.compare_with_snapshot(rows, path).isEmpty()
    changed = rows.withColumn("raw_context", F.when(F.col("obs_id") == "3", F.lit("x")).otherwise(F.col("raw_context"))).where("obs_id <> '4'")
    diff = tables.compare_with_snapshot(changed.unionByName(rows.where("obs_id = '5'")), path)
    assert sorted((r.side, r.obs_id) for r in diff.collect()) == [("left", "3"), ("left", "5"), ("right", "3"), ("right", "4")]


def test_retention_audit(spark):
    rows = spark.createDataFrame([("a", None), ("a", 0), ("a", 1), ("a", 72), ("a", 73), ("b", None)], "source_id string, raw_context_retention_hours int")
    assert sorted(str(r.raw_context_retention_hours) for r in history.retention_audit(rows, REGISTRY).collect()) == ["0", "73", "None"]


def test_upsert(spark):
    schema = "source_id string, listing_id string, listing_url string, enabled boolean, added_at long, note string"
    current = spark.createDataFrame([("a", "1", "u1", True, 1, "n"), ("a", "2", "u2", False, 2, None)], schema)
    changes = spark.createDataFrame(
        [("a", "1", "u9", False, 8, "m", 1), ("a", "1", None, None, 9, None, 2), ("b", "1", "u", False, 7, None, 3)], schema + ", seq int"
    )
    after = watchlist.upsert_watchlist(current, changes)
    got = {(r.source_id, r.listing_id): tuple(r)[2:] for r in after.collect()}
    assert got == {("a", "1"): (None, True, 1, None), ("a", "2"): ("u2", False, 2, None), ("b", "1"): ("u", False, 7, None)}
    again = watchlist.upsert_watchlist(after, changes)
    assert history.history_diff(after.withColumn("raw_context", F.lit(None).cast("string")), again.withColumn("raw_context", F.lit(None).cast("string"))).isEmpty()
    switches = spark.createDataFrame([("a", "2", True, 1), ("x", "9", True, 1)], "source_id string, listing_id string, enabled boolean, seq int")
    updated, existed = watchlist.switch_entries(current, switches)
    assert {r.listing_id: r.enabled for r in updated.collect()} == {"1": True, "2": True}
    assert {r.listing_id: r.existed for r in existed.collect()} == {"2": True, "9": False}


def test_stopped_sources_are_left_out(spark):
    rows = spark.createDataFrame([("a", "1", True), ("b", "2", True), ("b", "3", False)], "source_id string, listing_id string, enabled boolean")
    stops = spark.createDataFrame([("a", 100), ("b", 0)], "source_id string, period_start_ms long")
    entries = watchlist.enabled_entries(rows)
    assert [r.listing_id for r in watchlist.without_stopped(entries, stops, F.lit(100).cast("long")).collect()] == ["2"]
    assert [r.listing_id for r in watchlist.skipped_because_stopped(entries, stops, F.lit(100).cast("long")).collect()] == ["1"]
    assert watchlist.attempted_outside_watchlist(rows.where("listing_id <> '3'"), rows).isEmpty()


def test_export_is_ordered_and_attributed(spark, tmp_path):
    items = export.attributed(observations(spark, 9), REGISTRY)
    path = str(tmp_path / "export")
    export.write_export(items, path)
    lines = "\n".join(r.value for r in spark.read.text(path, wholetext=True).orderBy("_metadata.file_name").collect()).split("\n")
    lines = [line for line in lines if line]
    assert lines[0] == "# observations" and lines[1:3] == ["## a", "Prices by Acme"]
    block = lines.index("## b")
    assert lines[3:block] == sorted(lines[3:block]) and len(lines) == 4 + 9
    assert "  l1  USD 1.99  (vendor price-update instant not published)" in "\n".join(lines)


def test_one_unattributed_item_refuses_the_whole_export(spark, tmp_path):
    items = export.attributed(observations(spark, 9), REGISTRY)
    for notice in (None, " ", "by somebody else"):
        bad = items.withColumn("attribution", F.when(F.col("obs_id") == "3", F.lit(notice)).otherwise(F.col("attribution")))
        path = tmp_path / f"refused-{notice}"
        with pytest.raises(export.UnattributedExport):
            export.write_export(bad, str(path))
        assert not path.exists()
    with pytest.raises(export.UnattributedExport):
        export.write_export(export.attributed(observations(spark, 2).withColumn("source_id", F.lit("nobody")), REGISTRY), str(tmp_path / "x"))


#: By the rules of RFC 9309: groups of one agent add up, the longest fitting path decides, an allow wins a tie.
ROBOTS = """\
Allow: /before-any-group
# tidal pools
User-agent: gullbot
User-agent: tide-bot
Disallow: /pools
Allow: /pools/rock?tide=low   # only then
Disallow: /*/draft$
Sitemap: https://h/pools.xml

User-agent: *
Disallow: /

User-agent: TIDE-BOT
Allow: /kelp
Disallow: /kelp
Disallow: /Buoy/*/log
Disallow:
"""


def test_robots_decisions(spark):
    robots = spark.createDataFrame(
        [("https://h", 200, ROBOTS, False), ("https://star", 200, "User-agent: Baz\nDisallow: /baz\r\nUser-agent: *\rDisallow: /foo", False),
         ("https://gone", 404, "User-agent: *\nDisallow: /", False), ("https://down", 503, "", False), ("https://moved", 301, "", False),
         ("https://cut", 200, "User-agent: *\nDisallow: /a\nDisallow: /b", True), ("https://none", 200, "User-agent: Baz\nDisallow: /", False)],
        "origin string, status int, body string, truncated boolean",
    )
    cases = {
        "https://h/before-any-group": "allowed", "https://h/pools": "disallowed", "https://h/poolside": "disallowed", "https://h/pools/rock": "disallowed",
        "https://h/pools/rock?tide=low": "allowed", "https://h/pools/rock?tide=high": "disallowed", "https://h/a/draft": "disallowed",
        "https://h/a/draft/2": "allowed", "https://h/draft": "allowed", "https://h/kelp": "allowed", "https://h/kelp/forest": "allowed",
        "https://h/Buoy/7/log": "disallowed", "https://h/Buoy/7/8/log.txt": "disallowed", "https://h/buoy/7/log": "allowed", "https://h/Buoy/log": "allowed",
        "https://h": "allowed", "HTTPS://H/pools#top": "disallowed", "https://h:443/pools": "disallowed", "https://h/%70ools": "disallowed",
        "https://star/foo": "disallowed", "https://star/baz": "allowed", "https://star/robots.txt": "allowed", "https://gone/x": "allowed",
        "https://down/x": "unreachable", "https://moved/x": "unreachable", "https://cut/a": "disallowed", "https://cut/b": "allowed",
        "https://none/x": "allowed", "https://elsewhere/x": "unfetched",
    }
    urls = spark.createDataFrame([(u,) for u in cases], "url string")
    for hot_rows in (10**6, 1):
        got = {r.url: r.decision for r in robots_decide(urls, robots, "tide-bot", hot_rows).collect()}
        assert got == cases
    assert [r.value for r in robots_other_records(robots).collect()] == ["https://h/pools.xml"]
    assert selected_rules(robots, "nobody").where("origin = 'https://h'").count() == 1


def test_a_history_written_in_another_zone_is_read_whole(spark, tmp_path):
    rows, path = observations(spark, 40).drop("observed_date"), str(tmp_path / "history")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        tables.append_observations(rows, path)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert tables.read_observations(spark, path, -1, 1 << 45).count() == 40


def test_a_table_may_be_a_folder_of_files(spark, tmp_path):
    for name, parts in (("one", 1), ("many", 3)):
        path = f"{tmp_path}/{name}.parquet"
        spark.range(30).repartition(parts).write.parquet(path)
        out = str(tmp_path / f"out-{name}")
        query = views.stream(spark, str(tmp_path), name).writeStream.format("parquet").option("path", out)
        query.option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
        assert spark.read.parquet(out).count() == 30


def test_ids_come_through_ingest(spark):
    one = ("cast(null AS string) AS reason", "'observed' AS kind", "'a' AS source_id", "'l' AS listing_id", "'USD' AS currency")
    rows = spark.range(20).selectExpr(
        *one, "id AS amount_minor_units", "'' AS availability", "cast(null AS long) AS vendor_updated_ms", "'raw' AS raw_context", "timestamp_millis(1000) AS received_at",
        "CASE WHEN id < 5 THEN concat('o', id) END AS obs_id",
    )
    given, derived = (history.ingest(r, REGISTRY).select("obs_id", "amount_minor_units").collect() for r in (rows, rows.drop("obs_id")))
    assert {r.obs_id for r in given if r.amount_minor_units < 5} == {f"o{i}" for i in range(5)}
    assert len({r.obs_id for r in derived}) == 20 and None not in {r.obs_id for r in given}


def test_a_registry_beyond_broadcasting_size(spark):
    few, many = (Registry(tuple(Source(f"s{i}", attribution_required=True, notice=f"by {i}") for i in range(n))) for n in (10, 10_001))
    rows = observations(spark, 20).withColumn("source_id", F.concat(F.lit("s"), F.col("amount_minor_units") % 12))
    told = lambda registry: sorted((r.source_id, r.attribution) for r in export.attributed(rows, registry).collect())
    assert [t for t in told(many) if int(t[0][1:]) < 10] == [t for t in told(few) if t[1] is not None]
    plan = export.attributed(rows, many)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan and "broadcast" in export.attributed(rows, few)._jdf.queryExecution().optimizedPlan().toString()
