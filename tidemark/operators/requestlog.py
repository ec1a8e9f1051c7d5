"""Politeness arithmetic over request logs: allowances, failure rates, ceilings, holds, stops.

A log is a table with `source_id, host, request_id, at` and, where an operator
needs it, `status` and `retry_after`. Instants are compared in milliseconds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import Allowance, BreakerSettings, Ceiling, Registry, Source, small
from tidemark.functions.instants import hold_ms, is_failure, millis, period_start
from tidemark.operators.breaker import breaker_replay  # noqa: F401
from tidemark.operators.skew import attach
from tidemark.operators.trailing import RUN_CHUNK_MS, running, trailing

# Why a request may be refused before it is sent.
REFUSAL_REASONS = (
    "unconfigured-host", "unknown-source", "source-paused", "allowance-exhausted", "robots-unreachable",
    "robots-disallowed", "robots-stale", "host-held", "transport-error",
)


def _one() -> tuple[str, Column]:
    return ("sum", F.lit(1).cast("long"))


def _chunk(period_ms: int, most: int = 1024) -> int:
    """A chunk width that splits a period into at most `most` parts."""
    return max(1, -(-period_ms // most))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def period_counts(requests: DataFrame, period_ms: int) -> DataFrame:
    """Requests per source and epoch-aligned period. Every request that left counts, whatever its status."""
    at = millis(F.col("at"))
    return requests.groupBy("source_id", period_start(at, period_ms).alias("period_start_ms")).agg(
        F.count("*").alias("requests")
    )


def allowance_usage(requests: DataFrame, allowances: Mapping[str, Allowance]) -> DataFrame:
    """Per metered source and period: consumed, refused, and when the warn and stop levels were first reached.

    Requests beyond the limit are refused and consume nothing. Sources without
    an allowance are not counted.
    """
    spark = requests.sparkSession
    schema = "source_id string, period_ms long, most long, warn long"
    rows = [(source, a.period_ms, a.limit, a.warn_count) for source, a in allowances.items()]
    limits = small(spark.createDataFrame(rows, schema), len(rows))
    log = requests.select("source_id", millis(F.col("at")).alias("at_ms")).join(limits, "source_id")
    log = log.withColumn("period_start_ms", period_start(F.col("at_ms"), F.col("period_ms")))
    chunk_ms = _chunk(min(a.period_ms for a in allowances.values()))
    keys = ["source_id", "period_start_ms"]
    counted = running(log, keys, "at_ms", {"n": _one()}, chunk_ms).join(limits, "source_id")
    reached = F.coalesce("n", F.lit(0)) + F.col("own_n")
    used = counted.groupBy(*keys, "most").agg(
        F.sum("own_n").alias("requests"),
        F.min(F.when(reached >= F.col("warn"), F.col("at_ms"))).alias("warned_ms"),
        F.min(F.when(reached >= F.col("most"), F.col("at_ms"))).alias("stopped_ms"),
    )
    return used.select(
        *keys,
        F.least("requests", "most").alias("consumed"),
        F.greatest(F.col("requests") - F.col("most"), F.lit(0)).alias("refused"),
        "warned_ms", "stopped_ms",
    )


def failure_rate(requests: DataFrame, settings: BreakerSettings, failure: Column | None = None) -> DataFrame:
    """For every outcome: outcomes and failures of its source in the trailing window, itself included.

    `tripping` compares exactly: enough outcomes, and failures at or above the share.
    """
    failed = is_failure(F.col("status")) if failure is None else failure
    log = requests.select("source_id", "request_id", millis(F.col("at")).alias("at_ms"), failed.cast("long").alias("failed"))
    window = trailing(
        log, ["source_id"], "at_ms", settings.window_ms, {"n": _one(), "bad": ("sum", F.col("failed"))}
    )
    total = F.coalesce("n", F.lit(0)) + F.col("own_n")
    bad = F.coalesce("bad", F.lit(0)) + F.col("own_bad")
    rates = window.select("source_id", "at_ms", total.alias("outcomes"), bad.alias("failures"))
    share = F.lit(str(settings.failure_rate_threshold)).cast("decimal(10,9)")
    tripping = (F.col("outcomes") >= settings.minimum_outcomes) & (
        F.col("failures").cast("decimal(20,0)") >= share * F.col("outcomes").cast("decimal(18,0)")
    )
    return attach(log, rates, ["source_id", "at_ms"], ["source_id"]).select(
        "source_id", "request_id", "at_ms", "outcomes", "failures", tripping.alias("tripping")
    )


def source_health(requests: DataFrame, period_ms: int) -> DataFrame:
    """Successes, errors and blocks per source and period."""
    at = millis(F.col("at"))
    blocked = F.col("status").isin(401, 403, 429)
    return requests.groupBy("source_id", period_start(at, period_ms).alias("period_start_ms")).agg(
        F.count("*").alias("requests"),
        F.count_if(~is_failure(F.col("status"))).alias("successes"),
        F.count_if(blocked).alias("blocks"),
    )


def ceiling_audit(requests: DataFrame, default: Ceiling, hosts: Mapping[str, Ceiling] | None = None) -> DataFrame:
    """Per host: requests that exceeded its rate ceiling, and requests too close to the one before.

    In the order of a log, the request that makes one too many in the trailing
    interval is in excess, and so is every further one.
    """
    special = dict(hosts or {})
    spark = requests.sparkSession
    schema = "host string, most long, span long, gap long"
    rows = [(host, c.max_requests, c.interval_ms, c.min_delay_ms) for host, c in special.items()]
    own = small(spark.createDataFrame(rows, schema), len(rows))
    log = requests.select("host", millis(F.col("at")).alias("at_ms")).join(own, "host", "left").select(
        "host", "at_ms",
        F.coalesce("most", F.lit(default.max_requests)).alias("most"),
        F.coalesce("span", F.lit(default.interval_ms)).alias("span"),
        F.coalesce("gap", F.lit(default.min_delay_ms)).alias("gap"),
    )
    # A window has one width, so hosts are taken together by their interval. Whatever
    # the hosts, the ceiling itself comes along as a measure.
    carried = {name: ("max", F.col(name)) for name in ("most", "gap")}
    spans = {default.interval_ms, *(c.interval_ms for c in special.values())}
    rates = [
        trailing(log.where(F.col("span") == span), ["host"], "at_ms", span, {"n": _one(), **carried}).select(
            "host", "at_ms", "n", "own_n", "own_most", "own_gap"
        )
        for span in spans
    ]
    previous = running(log, ["host"], "at_ms", {"last": ("max", F.col("at_ms"))}).select("host", "at_ms", "last")
    rate = _union(rates).join(previous, ["host", "at_ms"])
    excess = F.least(
        F.col("own_n"), F.greatest(F.lit(0), F.coalesce("n", F.lit(0)) + F.col("own_n") - F.col("own_most"))
    )
    near = F.col("at_ms") - F.col("last") < F.col("own_gap")
    crowded = F.when(F.col("own_gap") > 0, F.col("own_n") - 1).otherwise(F.lit(0))
    return rate.groupBy("host").agg(
        F.sum("own_n").alias("requests"),
        F.sum(excess).alias("over_ceiling"),
        F.sum(crowded + F.when(near, 1).otherwise(0)).alias("too_close"),
    )


def documented_limit_audit(requests: DataFrame, sources: list[Source]) -> DataFrame:
    """Sources whose traffic exceeded what their vendor documents, per trailing second and per day."""
    log = requests.select("source_id", millis(F.col("at")).alias("at_ms"))
    seconds = trailing(log, ["source_id"], "at_ms", 1000, {"n": _one()})
    peak = seconds.groupBy("source_id").agg(F.max(F.coalesce("n", F.lit(0)) + F.col("own_n")).alias("peak_per_second"))
    days = period_counts(requests, 86_400_000).groupBy("source_id").agg(F.max("requests").alias("peak_per_day"))
    known = Registry(tuple(sources)).frame(requests.sparkSession)
    terms = known.select("source_id", "documented_per_second", "documented_per_day")
    over = lambda peak, limit: F.coalesce(F.col(peak) > F.col(limit), F.lit(False))
    return peak.join(days, "source_id").join(terms, "source_id", "left").select(
        "source_id", "peak_per_second", "peak_per_day",
        over("peak_per_second", "documented_per_second").alias("over_per_second"),
        over("peak_per_day", "documented_per_day").alias("over_per_day"),
    )


def holds(responses: DataFrame, default_ms: int) -> DataFrame:
    """The holds responses earn: host, instant and when the hold ends."""
    at = millis(F.col("at"))
    hold = hold_ms(F.col("status"), F.col("retry_after"), at, default_ms)
    return responses.select("host", "request_id", at.alias("at_ms"), (at + hold).alias("hold_until_ms")).where(
        "hold_until_ms is not null"
    )


def hold_audit(requests: DataFrame, default_ms: int, chunk_ms: int = RUN_CHUNK_MS) -> DataFrame:
    """Every request with the hold its host was under when it was sent.

    A hold is never shortened by a later one: what counts is the latest end among
    all earlier responses.
    """
    at = millis(F.col("at"))
    until = at + hold_ms(F.col("status"), F.col("retry_after"), at, default_ms)
    log = requests.select("host", "request_id", at.alias("at_ms"), until.alias("until"))
    held = running(log, ["host"], "at_ms", {"held": ("max", F.col("until"))}, chunk_ms)
    rows = attach(log, held.select("host", "at_ms", "held"), ["host", "at_ms"], ["host"])
    inside = F.coalesce(F.col("held") > F.col("at_ms"), F.lit(False))
    return rows.select("host", "request_id", "at_ms", F.when(inside, F.col("held")).alias("held_until_ms"), inside.alias("inside_hold"))


def period_stops(
    responses: DataFrame, existing: DataFrame, period_ms: Column, limit_statuses: Column
) -> DataFrame:
    """The first limit answer per source and period that is not stopped yet: one new stop, one notification."""
    at = millis(F.col("at"))
    limited = responses.where(F.array_contains(limit_statuses, F.col("status"))).select(
        "source_id", "request_id", "status", at.alias("at_ms"), period_start(at, period_ms).alias("period_start_ms")
    )
    first = limited.groupBy("source_id", "period_start_ms").agg(
        F.min(F.struct("at_ms", "request_id", "status")).alias("s")
    )
    return first.select(
        "source_id", "period_start_ms", F.col("s.at_ms").alias("stopped_ms"), F.col("s.request_id").alias("request_id"),
        F.concat(F.lit("answered "), F.col("s.status").cast("string")).alias("reason"),
    ).join(existing.select("source_id", "period_start_ms"), ["source_id", "period_start_ms"], "left_anti")


def refusal_report(outcomes: DataFrame) -> DataFrame:
    """How many requests were refused for each of the nine reasons, zero included."""
    reasons = outcomes.sparkSession.createDataFrame([(r,) for r in REFUSAL_REASONS], "refusal string")
    counts = outcomes.where(F.col("refusal").isin(*REFUSAL_REASONS)).groupBy("refusal").agg(F.count("*").alias("n"))
    return reasons.join(counts, "refusal", "left").select("refusal", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
