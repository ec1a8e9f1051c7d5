import random

from pyspark.sql import functions as F

from tidemark.config import Allowance, BreakerSettings, Ceiling, by_source, stop_period_ms
from tidemark.operators import requestlog


def log(spark, rows):
    """Rows `(source, host, ms, status, retry_after)` as a request log."""
    return spark.createDataFrame(
        [(i, *row) for i, row in enumerate(rows)],
        "request_id long, source_id string, host string, ms long, status int, retry_after string",
    ).withColumn("at", F.timestamp_millis("ms"))


def _random(seed, n=500, span=100_000):
    rng = random.Random(seed)
    return [
        (rng.choice(["hot"] * 3 + ["b", "c"]), rng.choice(["h1"] * 3 + ["h2"]), rng.randrange(span), rng.choice([200, 200, 403, 429, 500]),
         rng.choice([None, None, "3", "0", "junk"]))
        for _ in range(n)
    ]


def _ordered(rows):
    return sorted(((i, *row) for i, row in enumerate(rows)), key=lambda r: (r[3], r[0]))


def test_allowance_levels(spark):
    rows = _random(1)
    allowances = {"hot": Allowance(30, 10_000, 0.8), "b": Allowance(7, 7_000, 0.5)}
    got = {(r.source_id, r.period_start_ms): tuple(r)[2:] for r in requestlog.allowance_usage(log(spark, rows), allowances).collect()}
    want = {}
    for source, a in allowances.items():
        used = {}
        for _, name, _, ms, _, _ in _ordered(rows):
            if name != source:
                continue
            key = (source, ms - ms % a.period_ms)
            consumed, refused, warned, stopped = used.get(key, (0, 0, None, None))
            if consumed == a.limit:
                refused += 1
            else:
                consumed += 1
                if warned is None and consumed / a.limit >= a.warn_fraction:
                    warned = ms
                if stopped is None and consumed >= a.limit:
                    stopped = ms
            used[key] = (consumed, refused, warned, stopped)
        want.update(used)
    assert got == want
    assert any(v[1] for v in want.values()) and any(v[3] is None for v in want.values())


def test_warn_counts_are_exact():
    for limit in range(1, 200):
        for fraction in (0.1, 0.5, 0.7, 0.8, 0.9, 1.0):
            want = next(n for n in range(1, limit + 1) if n / limit >= fraction)
            assert Allowance(limit, warn_fraction=fraction).warn_count == want


def test_failure_rate(spark):
    rows = _random(2)
    settings = BreakerSettings(3_000, 5, 0.6, 1)
    got = {r.request_id: (r.outcomes, r.failures, r.tripping) for r in requestlog.failure_rate(log(spark, rows), settings).collect()}
    for i, (source, _, ms, _, _) in enumerate(rows):
        inside = [r for r in rows if r[0] == source and ms - 3_000 < r[2] <= ms]
        bad = sum(r[3] >= 400 for r in inside)
        assert got[i] == (len(inside), bad, len(inside) >= 5 and bad / len(inside) >= 0.6)


def _breaker(rows, s):
    pauses = []
    for source in {r[0] for r in rows}:
        window, until = [], None
        for _, name, _, ms, status, _ in _ordered(rows):
            if name != source or (until is not None and ms < until):
                continue
            if until is not None:
                window, until = [], None
            window = [w for w in window if w[0] > ms - s.window_ms] + [(ms, status >= 400)]
            bad = sum(w[1] for w in window)
            if len(window) >= s.minimum_outcomes and bad / len(window) >= s.failure_rate_threshold:
                until = ms + s.pause_ms
                pauses.append((source, ms, until, bad, len(window)))
    return sorted(pauses)


def test_breaker_replay_is_the_same_for_any_slicing(spark):
    for seed, settings, widths in ((3, BreakerSettings(2_000, 4, 0.5, 5_000), (None, 20_001)), (5, BreakerSettings(700, 2, 1.0, 30_000), (12_345,))):
        rows = _random(seed, n=250)
        want = _breaker(rows, settings)
        for width in widths:
            got = requestlog.breaker_replay(log(spark, rows), settings, slice_ms=width)
            assert sorted(map(tuple, got.select("source_id", "tripped_ms", "paused_until_ms", "failures", "outcomes").collect())) == want


def test_ceilings(spark):
    rows = _random(6)
    default, special = Ceiling(5, 1_000, 40), {"h2": Ceiling(2, 300, 900)}
    got = {r.host: (r.requests, r.over_ceiling, r.too_close) for r in requestlog.ceiling_audit(log(spark, rows), default, special).collect()}
    for host in ("h1", "h2"):
        c = special.get(host, default)
        sent = [r[3] for r in _ordered(rows) if r[2] == host]
        over = sum(len([t for t in sent[: i + 1] if t > at - c.interval_ms]) > c.max_requests for i, at in enumerate(sent))
        close = sum(b - a < c.min_delay_ms for a, b in zip(sent, sent[1:]))
        assert got[host] == (len(sent), over, close)


def test_holds_are_never_shortened(spark):
    rows = _random(7)
    got = {r.request_id: (r.held_until_ms, r.inside_hold) for r in requestlog.hold_audit(log(spark, rows), 2_000, chunk_ms=997).collect()}
    for i, (_, host, ms, _, _) in enumerate(rows):
        until = 0
        for _, h, at, status, header in rows:
            if h == host and at < ms:
                hold = {"3": 3_000, "0": 2_000, "junk": 2_000}.get(header, 2_000 if status == 429 else None)
                until = max(until, at + hold if hold else 0)
        assert got[i] == ((until, True) if until > ms else (None, False))


def test_stops_happen_once_per_period(spark):
    rows = [("a", "h", 5, 200, None), ("a", "h", 7, 403, None), ("a", "h", 8, 403, None), ("a", "h", 103, 403, None), ("b", "h", 9, 429, None), ("b", "h", 60, 403, None)]
    existing = spark.createDataFrame([("a", 100)], "source_id string, period_start_ms long")
    period = by_source({"a": 100}, F.col("source_id"), 50)
    stops = requestlog.period_stops(log(spark, rows), existing, period, F.array(F.lit(403)))
    assert sorted(map(tuple, stops.select("source_id", "period_start_ms", "stopped_ms", "request_id", "reason").collect())) == [
        ("a", 0, 7, 1, "answered 403"), ("b", 50, 60, 5, "answered 403"),
    ]
    # Found again, it is neither a new stop nor a second notification.
    again = requestlog.period_stops(log(spark, rows), existing.unionByName(stops.select("source_id", "period_start_ms")), period, F.array(F.lit(403)))
    assert again.isEmpty()


def test_stop_periods():
    assert stop_period_ms(Allowance(5, 60), BreakerSettings(1, 1, 1.0, 7), 9) == 60
    assert stop_period_ms(None, BreakerSettings(1, 1, 1.0, 7), 9) == 7
    assert stop_period_ms(None, None, 9) == 9


def test_refusal_report_names_every_reason(spark):
    rows = spark.createDataFrame([("host-held",), ("host-held",), (None,), ("robots-stale",)], "refusal string")
    got = {r.refusal: r.n for r in requestlog.refusal_report(rows).collect()}
    assert len(got) == 9 and got["host-held"] == 2 and got["robots-stale"] == 1 and got["transport-error"] == 0
