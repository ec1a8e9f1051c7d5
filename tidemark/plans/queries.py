"""The registered queries: every operator over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark import schemas
from tidemark.config import DAY_MS, HOUR_MS, by_source, stop_period_ms
from tidemark.functions import instants, money, text
from tidemark.operators import (
    delivery, export, extraction, history, requestlog, robots, rules, signals, vendor, watchlist,
)
from tidemark.plans import views
from tidemark.session import cut_lineage, scratch_path
from tidemark.sources import sweeps
from tidemark.streaming import batches, folders, stateful

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register a query under the name of its function."""
    QUERIES[function.__name__] = function
    return function


def _at_ms(name: str) -> DataFrame:
    return instants.millis(F.col(name))


# -- rules ------------------------------------------------------------------


@query
def window_low_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = rules.window_low(views.observations(spark, sf_dir), views.RULES)
    return verdicts.select(
        "listing_id", "obs_id", "at_ms", "rule_id", "status", "window_count", "reference_amount", "reference_at_ms",
        "mismatch_currency",
    )


def _firings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.fired(rules.window_low(views.observations(spark, sf_dir), views.REPLAY_RULES))


@query
def window_low_fired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _firings(spark, sf_dir).select(
        "source_id", "listing_id", "obs_id", "at_ms", "amount_minor_units", "reference_amount", "window_count"
    )


@query
def window_low_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = rules.window_low(
        views.observations(spark, sf_dir), views.REPLAY_RULES, history_keys=("source_id", "listing_id")
    )
    return verdicts.select("source_id", "listing_id", "obs_id", "at_ms", "status", "window_count")


# -- signals ------------------------------------------------------------------


def _signals(spark: SparkSession, sf_dir: str, prefix: str) -> DataFrame:
    asked = [signal for signal in views.SIGNALS if signal.signal_id.startswith(prefix)]
    return signals.judge(views.observations(spark, sf_dir), asked).select(
        "listing_id", "obs_id", "at_ms", "signal_id", "status", "window_count", "reference_amount"
    )


@query
def historical_lows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir, "low-")


@query
def average_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir, "drop-")


@query
def price_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir, "outlier-").drop("reference_amount")


@query
def back_in_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.judge(views.stocked(spark, sf_dir), [signals.back_in_stock()]).select(
        "listing_id", "obs_id", "at_ms", "status", "reference_amount"
    )


@query
def target_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.target_prices(views.observations(spark, sf_dir), views.targets(spark, sf_dir)).select(
        "listing_id", "obs_id", "amount_minor_units", "target_minor_units", "status"
    )


@query
def seasonal_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.seasonal_drops(
        views.observations(spark, sf_dir), views.calendar(spark, sf_dir), 365 * DAY_MS, 3, 2_000
    ).select("source_id", "listing_id", "obs_id", "at_ms", "seasons", "extra", "status", "window_count", "reference_amount")


@query
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.between(views.observations(spark, sf_dir), views.AS_OF_MS - 90 * DAY_MS, views.AS_OF_MS)
    return rows.select("listing_id", _at_ms("observed_at").alias("at_ms"), "amount_minor_units", "currency")


@query
def latest_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.latest(views.observations(spark, sf_dir), views.AS_OF_MS, 365 * DAY_MS).select(
        "listing_id", "obs_id", "at_ms", "amount_minor_units", "currency"
    )


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    listings = views.watchlist(spark, sf_dir)
    return rules.evaluate_alerts(
        views.observations(spark, sf_dir), listings, views.RULES, views.cooldowns(spark, sf_dir), views.AS_OF_MS,
        rules.endings_frame(listings, views.ENDINGS),
    )


@query
def alert_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statuses(spark, sf_dir)


@query
def alert_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.alert_report(_statuses(spark, sf_dir))


@query
def alert_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.compose_alerts(_statuses(spark, sf_dir)).drop("at_ms")


@query
def alert_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.replay_alerts(_firings(spark, sf_dir), views.REPLAY_RULES).select(
        "listing_id", "at_ms", "obs_id", "rule_id", "amount_minor_units", "reference_amount"
    )


@query
def clearance_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.observations(spark, sf_dir)
    return rules.clearance_tag(rows, rules.endings_frame(rows, views.ENDINGS)).select(
        "source_id", "obs_id", "amount_minor_units", "clearance_ending"
    )


def _reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    outbox = _firings(spark, sf_dir).selectExpr(
        "concat(source_id, ':', at_ms - at_ms % 2592000000) AS run_id", "source_id", "listing_id", "obs_id", "rule_id",
        "timestamp_millis(at_ms) AS fired_at", "amount_minor_units", "currency",
        "CASE WHEN amount_minor_units % 41 = 0 THEN 401 WHEN amount_minor_units % 7 = 0 THEN 500 ELSE 200 END AS status",
    )
    # An outbox is a stored table by the time its answers are in.
    return delivery.reconcile_deliveries(cut_lineage(outbox), order=("fired_at", "listing_id", "obs_id"))


@query
def delivery_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reconciled(spark, sf_dir).select("run_id", "listing_id", "obs_id", "status", "outcome")


@query
def cooldowns_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = delivery.update_cooldowns(views.cooldowns(spark, sf_dir), _reconciled(spark, sf_dir))
    return after.select(
        "source_id", "listing_id", "rule_id", _at_ms("fired_at").alias("fired_ms"), "amount_minor_units", "currency"
    )


@query
def alert_run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    statuses = cut_lineage(_statuses(spark, sf_dir))
    outbox = rules.compose_alerts(statuses).withColumns(
        {
            "run_id": F.lit("run"),
            "status": F.expr(
                "CASE WHEN observed_amount % 29 = 0 THEN 403 WHEN observed_amount % 5 = 0 THEN 500 ELSE 204 END"
            ),
        }
    )
    return delivery.run_report(
        statuses, delivery.reconcile_deliveries(outbox, order=("source_id", "listing_id", "rule_id"))
    )


# -- extraction ---------------------------------------------------------------


@query
def extract_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_offers(views.offer_pages(spark, sf_dir))


@query
def extract_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = extraction.extract_offers(views.offer_pages(spark, sf_dir))
    return verdicts.groupBy(F.coalesce("reason", F.lit("ok")).alias("verdict")).agg(F.count("*").alias("n"))


@query
def offer_candidate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.offer_candidates(views.offer_pages(spark, sf_dir))
    return found.select("page_id", "reader", F.size("candidates").cast("long").alias("candidates"))


@query
def extract_real_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_offers(views.table(spark, sf_dir, "pages")).select("page_id", "url", "ok", "reason")


@query
def vendor_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = views.REGISTRY.frame(spark).select("source_id", "currency", "time_zone")
    rows = views.payloads(spark, sf_dir).join(known, "source_id", "left")
    return vendor.map_payloads(rows).drop("status", "received_at")


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vendor.response_outcomes(views.payloads(spark, sf_dir), views.REGISTRY)


@query
def response_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).select(
        "source_id", "listing_id", "kind", "reason", "status", "detail", "amount_minor_units", "currency", "raw_context"
    )


def _map_quotes(rows: DataFrame) -> DataFrame:
    """Another vendor's documents: `{"ref": listing, "quote": {"units": whole minor units, "was": the same, "code": currency}}`."""
    read = rows.withColumn("_quote", F.from_json("body", "ref string, quote struct<units: long, was: long, code: string>"))
    named = money.normalise_currency(F.col("_quote.quote.code"))
    reason = (
        F.when(F.col("_quote.quote").isNull() | ~F.col("_quote.ref").eqNullSafe(F.col("listing_id")), F.lit("no-offer"))
        .when(F.col("_quote.quote.units").isNull(), F.lit("unparseable-price"))
    )
    ok = reason.isNull()
    cells = {"amount_minor_units": F.col("_quote.quote.units"), "regular_minor_units": F.col("_quote.quote.was"), "currency": named}
    cells |= {"on_sale": F.col("_quote.quote.units") < F.col("_quote.quote.was"), "vendor_on_sale": F.lit(None).cast("boolean")}
    cells |= {"vendor_updated_ms": F.lit(None).cast("long")}
    return read.select(
        *[c for c in rows.columns if c not in ("currency", "time_zone", "body")], ok.alias("ok"), reason.alias("reason"),
        *[F.when(ok, value).alias(name) for name, value in cells.items()],
    )


@query
def other_vendor_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = views.quotes(spark, sf_dir)
    return vendor.response_outcomes(responses, views.REGISTRY, _map_quotes).select(
        "source_id", "listing_id", "kind", "reason", "status", "amount_minor_units", "currency"
    )


@query
def minor_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey",
        "element_at(array('USD', 'JPY', 'KWD', 'ZZZ', 'eur ', 'CLF', 'UYW'), cast(l_orderkey % 7 AS int) + 1) AS currency",
        "cast(cast(l_extendedprice AS decimal(18,2)) AS string) AS plain",
    )
    shown = (
        F.when(F.col("l_linenumber") % 5 == 0, F.concat(F.lit("$ "), "plain"))
        .when(F.col("l_linenumber") % 5 == 1, F.col("plain"))
        .when(F.col("l_linenumber") % 5 == 2, F.concat("currency", "plain"))
        .when(F.col("l_linenumber") % 5 == 3, F.concat(F.lit("1,234,"), F.substring(F.concat(F.lit("00"), "plain"), -6, 6)))
        .otherwise(F.concat(F.lit("-"), "plain"))
    )
    priced = money.with_code(rows.withColumn("price", shown), F.col("currency"))
    return priced.select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "price",
        F.when(F.col("_places").isNotNull(), F.col("_code")).alias("currency"),
        money.exact("price").alias("amount_minor_units"),
    )


@query
def format_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.observations(spark, sf_dir).selectExpr(
        "listing_id", "obs_id", "amount_minor_units",
        "element_at(array('USD', 'JPY', 'KWD', 'ZZZ', 'UYW'), cast(amount_minor_units % 5 AS int) + 1) AS currency",
    )
    coded = money.with_code(rows, F.col("currency"))
    return coded.select("*", money.shown("amount_minor_units").alias("shown")).drop("_code", "_places")


# -- history ------------------------------------------------------------------


def _faulty_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _faulty(views.observations(spark, sf_dir))


def _faulty(observations: DataFrame) -> DataFrame:
    """Outcomes from observations, some of them broken in every way the guard knows."""
    return observations.selectExpr(
        "CASE WHEN amount_minor_units % 23 = 0 THEN ' ' ELSE source_id END AS source_id",
        "CASE WHEN amount_minor_units % 29 = 1 THEN '' ELSE listing_id END AS listing_id",
        "CASE WHEN amount_minor_units % 31 = 2 THEN 'store-1' END AS store_id",
        "obs_id",
        "CASE WHEN amount_minor_units % 37 = 3 THEN -amount_minor_units WHEN amount_minor_units % 37 <> 4 THEN amount_minor_units END AS amount_minor_units",
        "CASE amount_minor_units % 41 WHEN 5 THEN 'usd' WHEN 6 THEN 'USD\\n' ELSE currency END AS currency",
        "CASE WHEN amount_minor_units % 43 <> 7 THEN observed_at END AS received_at",
        "CASE amount_minor_units % 11 WHEN 0 THEN 'extraction-failed' WHEN 1 THEN 'source-error' ELSE 'observed' END AS kind",
        "CASE WHEN amount_minor_units % 11 = 0 THEN 'no-price' END AS reason",
        "unix_millis(vendor_price_updated_at) AS vendor_updated_ms",
        "repeat(coalesce(raw_context, '-'), CASE WHEN amount_minor_units % 50 = 0 THEN 1300 ELSE cast(amount_minor_units % 9 AS int) END) AS raw_context",
        "coalesce(availability, '') AS availability",
    )


@query
def ingest_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.ingest(_faulty_outcomes(spark, sf_dir), views.REGISTRY)
    return rows.select(
        "source_id", "listing_id", _at_ms("observed_at").alias("at_ms"), "amount_minor_units", "currency", "kind",
        "refusal", "source_time_zone", "raw_context_retention_hours", "availability", F.md5("raw_context").alias("raw_md5"),
    )


@query
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.ingest_report(history.ingest(_faulty_outcomes(spark, sf_dir), views.REGISTRY))


@query
def collection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.ingest_report(history.ingest(_outcomes(spark, sf_dir), views.REGISTRY))


@query
def retention_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.sweep_retention(views.observations(spark, sf_dir), views.AS_OF_MS).select(
        "listing_id", "obs_id", _at_ms("observed_at").alias("at_ms"), "raw_context"
    )


@query
def retention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.swept(views.observations(spark, sf_dir), views.AS_OF_MS)


@query
def retention_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.retention_audit(views.observations(spark, sf_dir), views.REGISTRY).select(
        "source_id", "listing_id", "obs_id", "raw_context_retention_hours", "ceiling_hours"
    )


@query
def history_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.observations(spark, sf_dir)
    # A copy that lost the rows without raw content, changed some, and holds one currency twice.
    other = rows.where("raw_context is not null").withColumn(
        "raw_context",
        F.when(F.col("raw_context_retention_hours") == 72, F.lit("changed")).otherwise(F.col("raw_context")),
    )
    other = other.unionByName(rows.where("currency = 'CAD'"))
    return history.history_diff(rows, other).select(
        "side", "listing_id", "obs_id", "amount_minor_units", "raw_context", "raw_context_retention_hours"
    )


@query
def history_diff_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two histories of which one has a column more, which some rows fill."""
    rows = views.observations(spark, sf_dir)
    graded = rows.withColumn("grade", F.when(F.col("amount_minor_units") % 13 == 0, F.col("currency")))
    return history.history_diff(rows, graded).select("obs_id", "listing_id", "grade", "side")


@query
def sweep_with_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history that is swept while a part of it still arrives."""
    rows = views.observations(spark, sf_dir)
    path, late = scratch_path(spark, "history"), F.col("amount_minor_units") % 4 == 0
    rows.where(~late).write.partitionBy("source_id").parquet(path)
    due = history.retention_expired(views.AS_OF_MS)
    sweep = sweeps.begin(spark, path, rows.schema, due, lambda held: history.sweep_retention(held, views.AS_OF_MS))
    rows.where(late).write.mode("append").partitionBy("source_id").parquet(path)
    sweep.publish()
    return sweeps.current(spark, path, rows.schema).select("listing_id", "obs_id", "raw_context")


# -- watchlist ----------------------------------------------------------------


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watchlist changes from the line items: many per listing, some for listings nobody watches yet."""
    return views.table(spark, sf_dir, "lineitem").selectExpr(
        "concat('src-', (l_partkey + l_suppkey % 2) % 5) AS source_id", "cast(l_partkey AS string) AS listing_id",
        "CASE WHEN l_linenumber % 3 > 0 THEN concat('https://shop.example/', l_orderkey) END AS listing_url",
        "CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS note",
        "CASE l_linenumber % 4 WHEN 0 THEN false WHEN 1 THEN true END AS enabled",
        "cast(l_shipdate AS timestamp) AS added_at",
        "struct(l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_returnflag) AS seq",
    )


@query
def watchlist_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = watchlist.upsert_watchlist(views.watchlist(spark, sf_dir), _changes(spark, sf_dir))
    return after.select("source_id", "listing_id", "listing_url", "enabled", "note", _at_ms("added_at").alias("added_ms"))


@query
def watchlist_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    switches = _changes(spark, sf_dir).where("enabled is not null")
    updated, existed = watchlist.switch_entries(views.watchlist(spark, sf_dir), switches)
    return updated.select("source_id", "listing_id", "enabled").join(existed, ["source_id", "listing_id"], "full_outer")


@query
def watchlist_enabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watchlist.enabled_entries(views.watchlist(spark, sf_dir), with_link=True).drop("enabled")


@query
def attempted_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempted = views.observations(spark, sf_dir).select("source_id", "listing_id").distinct()
    return watchlist.attempted_outside_watchlist(attempted, views.watchlist(spark, sf_dir))


@query
def usable_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("listing_url")
    return views.watchlist(spark, sf_dir).select(
        "listing_id", text.usable_link(url).alias("link"), text.redact_credentials(url).alias("redacted"),
        text.url_origin(text.trim_all(url)).alias("origin"), text.host_key(text.trim_all(url)).alias("host"),
        text.carries_userinfo(url).alias("userinfo"),
    )


@query
def redacted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(text.redact_credentials(F.col("text"))).alias("redacted_md5"),
        text.summarise(F.col("text")).alias("summary"),
        F.md5(text.bound_text(F.col("text"), text.RAW_CONTEXT_STORED)).alias("bounded_md5"),
    )


@query
def scrubbed_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = views.table(spark, sf_dir, "part").selectExpr(
        "p_partkey",
        """concat('posting ', p_name, ' to https://hook.example/topic/', p_partkey, '?auth=', p_size, ', then HTTPS://me:', p_size,
           '@hook.example:8443/other. Key ', p_brand, ' at http://api.example/x?a=1&Token=', p_partkey, '#f') AS report""",
        "concat('postgres://me:pw', p_size, '@db:5432/', p_partkey) AS connection",
    )
    return reports.select(
        "p_partkey", text.scrub(F.col("report"), "Brand#1", "https://hook.example/topic/7").alias("report"),
        text.hide_password(F.col("connection")).alias("connection"),
    )


# -- export -------------------------------------------------------------------


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.attributed(views.observations(spark, sf_dir), views.REGISTRY)


@query
def export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.export_lines(_items(spark, sf_dir))


@query
def export_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    worn = F.when(F.col("amount_minor_units") % 3 == 0, F.lit(" ")).when(
        F.col("amount_minor_units") % 3 == 1, F.lit("from somebody")
    ).otherwise(F.col("attribution"))
    return export.violations(items.withColumn("attribution", worn)).select("source_id", "obs_id", "violation")


@query
def listing_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("obs_id", export.listing_summary().alias("summary"))


# -- request log --------------------------------------------------------------


@query
def period_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requestlog.period_counts(views.requests(spark, sf_dir), DAY_MS)


@query
def allowance_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requestlog.allowance_usage(views.requests(spark, sf_dir), views.ALLOWANCES)


@query
def failure_rate_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requestlog.failure_rate(views.requests(spark, sf_dir), views.BREAKER)


@query
def breaker_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requestlog.breaker_replay(views.requests(spark, sf_dir), views.BREAKER)


@query
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requestlog.source_health(views.requests(spark, sf_dir), DAY_MS)


@query
def ceiling_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requestlog.ceiling_audit(views.requests(spark, sf_dir), views.CEILING, views.HOST_CEILINGS)


@query
def documented_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = [s for s in views.REGISTRY.sources if s.documented_per_second]
    return requestlog.documented_limit_audit(views.requests(spark, sf_dir), sources)


@query
def stop_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    periods = {f"src-{n}": stop_period_ms(views.ALLOWANCES.get(f"src-{n}"), views.BREAKER if n == 5 else None, views.BACKOFF_MS) for n in range(7)}
    period, at = by_source(periods, F.col("source_id")), _at_ms("at")
    refused = views.requests(spark, sf_dir).where("status IN (403, 429)")
    return refused.select("request_id", "source_id", (instants.period_start(at, period) + period).alias("ends_ms"))


@query
def hold_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requestlog.hold_audit(views.requests(spark, sf_dir), views.BACKOFF_MS)


def _stop_period() -> DataFrame:
    return by_source({"src-0": DAY_MS, "src-1": 6 * HOUR_MS}, F.col("source_id"), HOUR_MS)


def _existing_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops already held: the hours in which a source answered 503."""
    log = views.requests(spark, sf_dir).where("status = 503")
    return log.select(
        "source_id", instants.period_start(_at_ms("at"), _stop_period()).alias("period_start_ms")
    ).distinct()


@query
def period_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = F.when(F.col("source_id") == "src-3", F.array(F.lit(403), F.lit(429))).otherwise(F.array(F.lit(403)))
    return requestlog.period_stops(
        views.requests(spark, sf_dir), _existing_stops(spark, sf_dir), _stop_period(), limits
    )


@query
def stopped_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = watchlist.enabled_entries(views.watchlist(spark, sf_dir))
    period = F.lit(views.LOG_END_MS - 20 * HOUR_MS).cast("long")
    stops, start = _existing_stops(spark, sf_dir), instants.period_start(period, _stop_period())
    going = watchlist.without_stopped(entries, stops, start).withColumn("state", F.lit("attempted"))
    held = watchlist.skipped_because_stopped(entries, stops, start).withColumn("state", F.lit("skipped"))
    return going.unionByName(held).groupBy("source_id", "period_start_ms", "state").agg(F.count("*").alias("n"))


@query
def refusal_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requestlog.refusal_report(views.requests(spark, sf_dir))


@query
def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots.selected_rules(views.robots(spark, sf_dir), "TideBot").drop("line_no")


@query
def robots_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = views.table(spark, sf_dir, "pages").select("page_id", "url")
    return robots.robots_decide(urls, views.robots(spark, sf_dir), "TideBot").select("page_id", "path", "decision", "pattern")


@query
def robots_other_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots.robots_other_records(views.robots(spark, sf_dir)).drop("line_no")


# -- instants -----------------------------------------------------------------


@query
def vendor_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "element_at(array('America/New_York', 'Europe/Berlin', 'Asia/Tokyo', 'Nowhere/Land'), cast(event_id % 4 AS int) + 1) AS zone",
        """CASE event_id % 6 WHEN 0 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
           WHEN 1 THEN date_format(ts, 'yyyy-MM-dd HH:mm') WHEN 2 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
           WHEN 3 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+05:30'") WHEN 4 THEN date_format(ts, "yyyy-MM-'3'd'T'HH:mm:ss'Z'")
           ELSE date_format(ts, 'dd.MM.yyyy') END AS stamp""",
    )
    return rows.select("event_id", "zone", "stamp", instants.vendor_timestamp_ms(F.col("stamp"), F.col("zone")).alias("at_ms"))


# -- streams: the given tables read as files, run until they are used up --------


def _run(writer: DataStreamWriter, checkpoint: str) -> None:
    running = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()


@query
def stream_period_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.requests_of(views.stream(spark, sf_dir, "events"))
    counts = scratch_path(spark, "counts")
    _run(batches.stream_period_counts(log, DAY_MS, counts), scratch_path(spark, "checkpoint"))
    return batches.latest_counts(spark.read.parquet(counts))


@query
def stream_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts after the whole stream has run twice over the same output, as after a lost checkpoint."""
    log, counts = views.requests_of(views.stream(spark, sf_dir, "events")), scratch_path(spark, "counts")
    for _ in range(2):
        _run(batches.stream_period_counts(log, DAY_MS, counts), scratch_path(spark, "checkpoint"))
    return batches.latest_counts(spark.read.parquet(counts))


@query
def stream_window_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    arriving = views.observations_of(views.stream(spark, sf_dir, "lineitem"))
    history_path, verdicts = scratch_path(spark, "history"), scratch_path(spark, "verdicts")
    _run(batches.stream_window_low(arriving, views.REPLAY_RULES, history_path, verdicts), scratch_path(spark, "checkpoint"))
    return spark.read.parquet(verdicts).select(
        "listing_id", "obs_id", "at_ms", "status", "window_count", "reference_amount"
    )


@query
def stream_cooldowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    arriving, kept = scratch_path(spark, "firings"), scratch_path(spark, "kept")
    firings = _firings(spark, sf_dir).select("source_id", "listing_id", "rule_id", "at_ms", "obs_id", "amount_minor_units")
    # A cooldown is kept per listing here, as the batch replay keeps it.
    firings.withColumn("source_id", F.lit("any")).write.parquet(arriving)
    rows = spark.readStream.schema(firings.schema).parquet(arriving)
    stream = stateful.stream_cooldowns(rows, views.REPLAY_RULES)
    _run(stream.writeStream.format("parquet").option("path", kept), scratch_path(spark, "checkpoint"))
    return spark.read.parquet(kept).select("listing_id", "at_ms", "obs_id", "rule_id", "amount_minor_units")


@query
def stream_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.requests_of(views.stream(spark, sf_dir, "events"))
    failed = instants.is_failure(F.col("status")).cast("int").alias("failed")
    outcomes = log.select("source_id", "request_id", F.expr("unix_millis(at) AS at_ms"), failed)
    pauses = scratch_path(spark, "pauses")
    stream = stateful.stream_breaker(outcomes, views.BREAKER)
    _run(stream.writeStream.format("parquet").option("path", pauses), scratch_path(spark, "checkpoint"))
    return spark.read.schema(stateful.PAUSES).parquet(pauses)


@query
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    arriving = _faulty(views.observations_of(views.stream(spark, sf_dir, "lineitem")))
    kept, aside = scratch_path(spark, "history"), scratch_path(spark, "quarantine")
    _run(batches.stream_ingest(arriving, views.REGISTRY, kept, aside), scratch_path(spark, "checkpoint"))
    columns = ["source_id", "listing_id", "amount_minor_units", "currency"]
    written = folders.read(spark, kept, schemas.OBSERVATIONS).select(*columns, F.lit("history").alias("state"))
    return written.unionByName(spark.read.parquet(aside).select(*columns, F.col("refusal").alias("state")))
