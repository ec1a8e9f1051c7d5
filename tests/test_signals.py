import random
import statistics
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidemark.config import DAY_MS
from tidemark.operators import signals
from tidemark.operators.signals import Signal, availability_state, back_in_stock, drop, judge, low, outlier, seasonal_drops

NOW = 1_700_000_000_000
SCHEMA = "source_id string, listing_id string, obs_id string, ms long, amount_minor_units long, currency string, availability string"
STATES = ["https://schema.org/InStock", "OutOfStock", None, "http://schema.org/SoldOut", "x", " LimitedAvailability "]


def history(spark, points):
    """Points `(listing, ms, amount[, currency[, availability]])` as an observation table."""
    rows = [("s", p[0], f"{i:05d}", p[1], p[2], p[3] if len(p) > 3 else "USD", p[4] if len(p) > 4 else None) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("observed_at", F.timestamp_millis("ms"))


def told(spark, points, signal, **options):
    rows = judge(history(spark, points), [signal], **options).orderBy("obs_id").collect()
    return [(r.status, r.window_count, r.reference_amount) for r in rows]


def some_points(n=160):
    dice = random.Random(5)
    return [
        (dice.choice("ab"), NOW + dice.randrange(60) * DAY_MS // 2, dice.randrange(900, 1100), "USD" if dice.random() < 0.97 else "CAD", dice.choice(STATES))
        for _ in range(n)
    ]


def plainly(points, width, least, verdict):
    """Statuses by comparing each row with every other one."""
    out = []
    for p in points:
        before = [h for h in points if h[0] == p[0] and h[1] < p[1] and (width is None or h[1] > p[1] - width)]
        if not before:
            out.append(("empty-window", 0))
        elif any(h[3] != p[3] for h in before):
            out.append(("currency-mismatch", len(before)))
        elif len(before) < least:
            out.append(("insufficient-history", len(before)))
        else:
            out.append((verdict(p[2], [h[2] for h in before]), len(before)))
    return out


def far(price, before):
    mean, spread = Fraction(sum(before), len(before)), statistics.variance([Fraction(x) for x in before])
    return "no-spread" if spread == 0 else "fired" if price < mean and (mean - price) ** 2 * 100 >= 144 * spread else "not-lower"


@pytest.mark.parametrize("hot_rows", [2_000, 0])
@pytest.mark.parametrize("width", [None, 7 * DAY_MS])
def test_signals_against_every_pair(spark, width, hot_rows):
    points = some_points()
    asked = [low("low", width, 3, 5), drop("drop", width, 2, 500), outlier("far", width, 3, 12)]
    rows = judge(history(spark, points), asked, hot_rows=hot_rows).orderBy("obs_id").collect()
    got = {s.signal_id: [(r.status, r.window_count) for r in rows if r.signal_id == s.signal_id] for s in asked}
    assert got["low"] == plainly(points, width, 3, lambda p, h: "fired" if p + 5 <= min(h) else "not-lower")
    assert got["drop"] == plainly(points, width, 2, lambda p, h: "fired" if Fraction(p) <= Fraction(sum(h), len(h)) * Fraction(95, 100) else "not-lower")
    assert got["far"] == plainly(points, width, 3, far)
    assert {"fired", "not-lower"} <= {s for s, _ in got["far"]}


@pytest.mark.parametrize("hot_rows", [2_000, 0])
def test_back_in_stock_passes_over_the_unknown(spark, hot_rows):
    points = some_points()
    state = {0: "in", 1: "out", 2: None, 3: "out", 4: None, 5: "in"}
    known = [(p, state[STATES.index(p[4])], f"{i:05d}") for i, p in enumerate(points)]
    want = []
    for p, now, _ in known:
        earlier = [(q[1], i, s) for q, s, i in known if q[0] == p[0] and q[1] < p[1] and s]
        last = max(earlier)[2] if earlier else None
        want.append("unknown" if now is None else "no-earlier-state" if last is None else "fired" if (now, last) == ("in", "out") else "no-change")
    assert [s for s, _, _ in told(spark, points, back_in_stock(), hot_rows=hot_rows)] == want
    assert {"fired", "no-change", "unknown", "no-earlier-state"} == set(want)


def test_a_gap_keeps_the_last_state(spark):
    points = [("a", NOW, 5, "USD", "OutOfStock"), ("a", NOW + 900 * DAY_MS, 6, "USD", None), ("a", NOW + 1800 * DAY_MS, 7, "CAD", "InStock")]
    for hot_rows in (2_000, 0):
        assert told(spark, points, back_in_stock(), hot_rows=hot_rows) == [("no-earlier-state", 0, None), ("unknown", 1, None), ("fired", 2, 5)]


def test_a_long_listing_is_cut_only_for_windows_with_a_lower_end(spark, monkeypatch):
    points = [("a", NOW + i * DAY_MS // 4, 1000 + i * 7919 % 613, "USD", STATES[i * 31 % 6]) for i in range(signals.FRAME_ROWS + 100)]
    want = told(spark, points, back_in_stock(), hot_rows=0)
    cut = []
    monkeypatch.setattr(signals, "_chunked", lambda *given, plain=signals._chunked: cut.append(given) or plain(*given))
    assert told(spark, points, back_in_stock()) == want and not cut
    told(spark, points, low("low", DAY_MS, 1, 1))
    assert len(cut) == 1


def test_bounds_of_the_exact_comparison(spark):
    huge, big = 2**63 - 1, 10**12
    four = lambda x, p: [("a", NOW + i, v) for i, v in enumerate([x, x, x, p])]
    assert told(spark, four(huge, 1), drop("d", None, 1, 100))[-1][0] == "out-of-range"
    assert told(spark, four(100, huge), outlier("o", None, 2, 20))[-1][0] == "out-of-range"
    assert told(spark, four(big, big - big // 100), drop("d", None, 1, 100))[-1] == ("fired", 3, big)
    assert told(spark, four(big, big - big // 100 + 1), drop("d", None, 1, 100))[-1] == ("not-lower", 3, big)
    assert told(spark, four(100, 1), outlier("o", None, 2, 20))[-1][0] == "no-spread"
    assert told(spark, four(0, 0), drop("d", None, 1, 100))[-1][0] == "no-average"
    assert told(spark, four(huge, huge - 1), low("l", None, 1, 1))[-1] == ("fired", 3, huge)
    assert told(spark, four(None, 5), low("l", None, 1, 1)) == [("no-price", 0, None)] * 3 + [("empty-window", 0, None)]


def test_rows_without_listing_or_instant_and_an_empty_table(spark):
    points = [(None, NOW, 5), (None, NOW + 1, 4), ("a", None, 3), ("a", NOW, 9), ("a", NOW + 1, 8, None), ("a", NOW + 2, 7)]
    for hot_rows in (2_000, 0):
        got = [s for s, _, _ in told(spark, points, low("l", None, 1, 1), hot_rows=hot_rows)]
        assert got == ["empty-window"] * 4 + ["currency-mismatch"] * 2
    assert judge(history(spark, points).where("false").drop("availability"), [low("l", None, 1)]).count() == 0
    with pytest.raises(ValueError):
        judge(history(spark, points), [low("l", None, 1), drop("l", None, 1, 1)])


def test_a_kind_of_ones_own_brings_its_measures(spark):
    """How many different days of the window were cheaper than ten: a kind the library does not have."""
    def verdict(of):
        return F.struct(F.when(of("cheap") >= 2, F.lit("often-cheap")).otherwise(F.lit("rarely")).alias("status"), F.lit(None).cast("long").alias("reference_amount"))

    cheap = Signal("cheap", 5, lambda: {"cheap": ("sum", (F.col("amount_minor_units") < 10).cast("long"))}, verdict)
    points = [("a", NOW + i, v) for i, v in enumerate([9, 11, 9, 12, 12, 12])]
    for hot_rows in (2_000, 0):
        rows = judge(history(spark, points), [low("low", 5, 1), cheap], hot_rows=hot_rows).where("signal_id = 'cheap'").orderBy("obs_id")
        assert [r.status for r in rows.collect()] == ["empty-window", "rarely", "rarely", "often-cheap", "often-cheap", "rarely"]
    clash = Signal("clash", 5, lambda: {"low": ("max", F.col("amount_minor_units"))}, verdict)
    with pytest.raises(ValueError):
        judge(history(spark, points), [low("low", 5, 1), clash])


def test_availability_states(spark):
    rows = spark.createDataFrame([(s,) for s in [*STATES, "", "https://schema.org/", "INSTOCK"]], "s string")
    assert [r[0] for r in rows.select(availability_state(F.col("s"))).collect()] == ["in", "out", None, "out", None, "in", None, None, "in"]


def test_target_prices(spark):
    targets = spark.createDataFrame(
        [("a", "USD", 10), ("a", "USD", 12), ("b", "CAD", 5), (None, "USD", 9), ("c", "USD", None), ("d", "usd", 9)],
        "listing_id string, currency string, target_minor_units long",
    )
    points = [("a", NOW, 12), ("a", NOW, 13), ("a", NOW, None), ("b", NOW, 1), ("c", NOW, 1), ("d", NOW, 1), (None, NOW, 1), ("a", NOW, 1, None)]
    got = signals.target_prices(history(spark, points), targets).orderBy("obs_id").collect()
    assert [(r.status, r.target_minor_units) for r in got] == [
        ("fired", 12), ("above-target", 12), ("no-price", 12), ("currency-mismatch", None), ("currency-mismatch", None),
    ]


def test_overlapping_seasons_raise_the_bar(spark):
    day0 = NOW - NOW % DAY_MS
    prices = [100, 100, 100, 85, 85, 85, 60, 85]
    points = [("a", day0 + i * DAY_MS, p) for i, p in enumerate(prices)]
    calendar = spark.sql(f"""
        SELECT source_id, date_add(to_date(timestamp_millis({day0}L)), lo) AS starts_on, date_add(to_date(timestamp_millis({day0}L)), hi) AS ends_before, extra_basis_points
        FROM VALUES ('s', 4, 8, 100), (null, 4, 5, 900), ('s', 2, 6, 300), ('other', 0, 9, 9000), (null, 5, 5, 9000), ('s', 0, 9999, 9000), ('s', null, 3, 1)
        AS t(source_id, lo, hi, extra_basis_points)""")
    assert signals.season_faults(calendar).count() == 3
    for hot_rows in (2_000, 0):
        rows = seasonal_drops(history(spark, points), calendar, 30 * DAY_MS, 2, 1_000, hot_rows=hot_rows).orderBy("at_ms").collect()
        assert [(r.seasons, r.extra) for r in rows] == [(0, 0), (0, 0), (1, 300), (1, 300), (3, 900), (2, 300), (1, 100), (1, 100)]
        assert [r.status for r in rows] == [
            "empty-window", "insufficient-history", "not-lower", "all-time-low", "seasonal", "not-lower", "all-time-low", "not-lower",
        ]
    nothing = seasonal_drops(history(spark, points), calendar.where("false"), 30 * DAY_MS, 2, 1_000).orderBy("at_ms").collect()
    assert nothing[4].status == "fired"
