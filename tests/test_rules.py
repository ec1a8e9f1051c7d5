import random

import pytest
from pyspark.sql import functions as F

from tidemark.config import DAY_MS, Rule
from tidemark.operators import delivery
from tidemark.operators.rules import (
    clearance_tag, compose_alerts, endings_frame, evaluate_alerts, fired, latest, register_rule_kind, replay_alerts,
    RULE_KINDS, window_low,
)

NOW = 1_700_000_000_000
RULE = Rule("test-low", 30 * DAY_MS, 3, 100, 7 * DAY_MS)
SCHEMA = "source_id string, listing_id string, obs_id string, ms long, amount_minor_units long, currency string"


def history(spark, points):
    """Points `(listing, ms, amount[, currency[, source]])` as an observation table."""
    rows = [
        (p[4] if len(p) > 4 else "s", p[0], f"{i:05d}", p[1], p[2], p[3] if len(p) > 3 else "USD")
        for i, p in enumerate(points)
    ]
    return spark.createDataFrame(rows, SCHEMA).withColumn("observed_at", F.timestamp_millis("ms"))


def flat(listing, count, amount, ending, currency="USD"):
    return [(listing, ending - i * DAY_MS, amount, currency) for i in range(count)]


def verdict_at(spark, points, rule=RULE, ms=NOW, **options):
    rows = window_low(history(spark, points), [rule], **options).where(F.col("at_ms") == ms).collect()
    assert len(rows) == 1
    return rows[0]


def test_refusals_in_their_order(spark):
    day = NOW - DAY_MS
    cases = {
        "empty": ([("a", NOW, 1)], "empty-window", 0),
        "two of three": (flat("a", 2, 10_000, day) + [("a", NOW, 1)], "insufficient-history", 2),
        "three of three": (flat("a", 3, 10_000, day) + [("a", NOW, 1)], "fired", 3),
        "old ones do not count": (flat("a", 3, 10_000, NOW - 40 * DAY_MS) + flat("a", 2, 10_000, day) + [("a", NOW, 1)], "insufficient-history", 2),
        "mismatch before count": ([("a", day, 10_000, "CAD"), ("a", NOW, 1)], "currency-mismatch", 1),
        "mismatch among many": (flat("a", 4, 10_000, day) + [("a", day - 1, 9, "CAD"), ("a", NOW, 1)], "currency-mismatch", 5),
        "margin met": (flat("a", 3, 10_000, day) + [("a", NOW, 9_900)], "fired", 3),
        "margin missed by one": (flat("a", 3, 10_000, day) + [("a", NOW, 9_901)], "not-lower", 3),
        "beyond double precision": (flat("a", 3, 2**53 + 101, day) + [("a", NOW, 2**53 + 1)], "fired", 3),
        "one off beyond double precision": (flat("a", 3, 2**53 + 100, day) + [("a", NOW, 2**53 + 1)], "not-lower", 3),
        "next to the 64-bit limit": (flat("a", 3, 2**63 - 1, day) + [("a", NOW, 2**63 - 2)], "not-lower", 3),
        "future is no history": ([("a", NOW + 1, 5), ("a", NOW, 1)], "empty-window", 0),
        "lower end is open": (flat("a", 2, 10_000, day) + [("a", NOW - 30 * DAY_MS, 10_000), ("a", NOW, 1)], "insufficient-history", 2),
        "one past the lower end": (flat("a", 2, 10_000, day) + [("a", NOW - 30 * DAY_MS + 1, 10_000), ("a", NOW, 1)], "fired", 3),
        "another listing is no history": (flat("b", 5, 10_000, day) + [("a", NOW, 1)], "empty-window", 0),
    }
    for name, (points, status, count) in cases.items():
        got = verdict_at(spark, points)
        assert (got.status, got.window_count) == (status, count), name


def test_reference_is_the_earliest_of_equal_lows(spark):
    points = flat("a", 3, 5_000, NOW - DAY_MS) + [("a", NOW - 2 * DAY_MS, 7_000), ("a", NOW, 1_000)]
    got = verdict_at(spark, points)
    assert (got.reference_amount, got.reference_at_ms) == (5_000, NOW - 3 * DAY_MS)


def test_equal_instants_are_no_history_of_each_other(spark):
    points = flat("a", 3, 10_000, NOW - DAY_MS) + [("a", NOW, 1), ("a", NOW, 20_000)]
    rows = window_low(history(spark, points), [RULE]).where(F.col("at_ms") == NOW).collect()
    assert sorted((r.status, r.window_count) for r in rows) == [("fired", 3), ("not-lower", 3)]


def test_history_may_be_kept_per_source(spark):
    points = [("a", NOW - i * DAY_MS, 10_000, "USD", "other") for i in (1, 2, 3)] + [("a", NOW, 1, "USD", "s")]
    assert verdict_at(spark, points).status == "fired"
    assert verdict_at(spark, points, history_keys=("source_id", "listing_id")).status == "empty-window"


def _random_points(seed, n=300):
    rng = random.Random(seed)
    return [
        (rng.choice(["hot", "hot", "hot", "x", "y"]), rng.randrange(120) * DAY_MS // 2, rng.randrange(1000, 1500), rng.choice(["USD"] * 30 + ["EUR"]))
        for _ in range(n)
    ]


def _brute(points, rule):
    out = []
    for i, (listing, ms, amount, currency) in enumerate(points):
        inside = [p for p in points if p[0] == listing and ms - rule.window_ms < p[1] < ms]
        if not inside:
            status = "empty-window"
        elif any(p[3] != currency for p in inside):
            status = "currency-mismatch"
        elif len(inside) < rule.minimum_observations:
            status = "insufficient-history"
        else:
            low = min((p[2], p[1]) for p in inside)
            status = "fired" if amount + rule.improvement_minor_units <= low[0] else "not-lower"
        out.append((f"{i:05d}", rule.rule_id, status, len(inside), *(low if status in ("fired", "not-lower") else (None, None))))
    return out


def test_verdicts_match_brute_force_whatever_the_order_and_the_hot_keys(spark):
    points = _random_points(1)
    rules = [RULE, Rule("short", 7 * DAY_MS + 13, 1, 20, DAY_MS)]
    want = sorted(_brute(points, rules[0]) + _brute(points, rules[1]), key=str)
    columns = ("obs_id", "rule_id", "status", "window_count", "reference_amount", "reference_at_ms")
    for frame, hot_rows in ((history(spark, points), 10**6), (history(spark, points).repartition(7, "amount_minor_units"), 1)):
        got = window_low(frame, rules, hot_rows=hot_rows).select(*columns).collect()
        assert sorted(map(tuple, got), key=str) == want


def test_only_judges_the_given_rows(spark):
    frame = history(spark, _random_points(2))
    some = frame.where("obs_id % 5 = 0")
    columns = ("obs_id", "status", "window_count", "reference_amount")
    want = window_low(frame, [RULE]).where("obs_id % 5 = 0").select(*columns)
    got = window_low(frame, [RULE], only=some).select(*columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_latest_takes_the_highest_id_among_equals(spark):
    points = [("a", NOW - 5, 1), ("a", NOW, 2), ("a", NOW, 3), ("a", NOW + 1, 4), ("b", NOW - 31 * DAY_MS, 5)]
    rows = latest(history(spark, points), NOW, 30 * DAY_MS).collect()
    assert [(r.listing_id, r.amount_minor_units) for r in rows] == [("a", 3)]


def _alerts(spark, cooldown_ms_ago=None, url="https://shop.example/1", enabled=True, amount=1):
    points = flat("1", 3, 10_000, NOW - 2 * DAY_MS) + [("1", NOW - DAY_MS, amount)]
    watch = spark.createDataFrame([("s", "1", url, enabled), ("s", "2", url, True)], "source_id string, listing_id string, listing_url string, enabled boolean")
    held = [] if cooldown_ms_ago is None else [("s", "1", "test-low", NOW - cooldown_ms_ago)]
    cooldowns = spark.createDataFrame(held, "source_id string, listing_id string, rule_id string, ms long").select(
        "source_id", "listing_id", "rule_id", F.timestamp_millis("ms").alias("fired_at")
    )
    endings = endings_frame(watch, {"s": ["97", "1"]})
    return evaluate_alerts(history(spark, points), watch, [RULE], cooldowns, NOW, endings)


def test_alert_statuses(spark):
    def status(**options):
        return {r.listing_id: r.status for r in _alerts(spark, **options).collect()}

    assert status() == {"1": "deliverable", "2": "no-observation"}
    assert status(cooldown_ms_ago=7 * DAY_MS - 1)["1"] == "suppressed"
    # The cooldown ends at its last instant.
    assert status(cooldown_ms_ago=7 * DAY_MS)["1"] == "deliverable"
    assert status(url=None)["1"] == "undeliverable"
    assert status(url="https://u:p@shop.example/1")["1"] == "undeliverable"
    assert status(amount=9_950)["1"] == "not-lower"
    assert status(enabled=False) == {"2": "no-observation"}


def test_composed_alert(spark):
    alert = compose_alerts(_alerts(spark)).collect()
    assert len(alert) == 1
    body = alert[0].body.split("\n")
    assert alert[0].title == "USD 0.01 on 1 (test-low)"
    assert body[0] == "test-low fired for s/1."
    assert body[1] == "Observed USD 0.01 at 2023-11-13T22:13:20.000Z."
    assert body[2].startswith("It beats USD 100.00, the lowest of the 3 observation(s) in the window, seen 2023-11-10T")
    assert body[3] == "https://shop.example/1" and body[4].startswith("Price ends in 1, ") and len(body) == 5


def test_clearance_takes_the_first_configured_ending(spark):
    rows = spark.createDataFrame([("s", 1297), ("s", 7), ("t", 1297), ("u", -97)], "source_id string, amount_minor_units long")
    endings = endings_frame(rows, {"s": ["7", "97", ""], "u": ["97"]})
    got = {(r.source_id, r.amount_minor_units): r.clearance_ending for r in clearance_tag(rows, endings).collect()}
    assert got == {("s", 1297): "7", ("s", 7): "7", ("t", 1297): None, ("u", -97): "97"}


def test_replay_follows_the_cooldown(spark):
    rng = random.Random(3)
    for cooldown in (0, 1, 5, 1000):
        rule = Rule("r", DAY_MS, 1, 0, cooldown)
        points = [(rng.choice("aab"), rng.randrange(400)) for _ in range(150)]
        frame = spark.createDataFrame(
            [("s", listing, f"{i:04d}", ms, i, "USD", "r") for i, (listing, ms) in enumerate(points)],
            "source_id string, listing_id string, obs_id string, at_ms long, amount_minor_units long, currency string, rule_id string",
        )
        want = []
        for listing in "ab":
            last = None
            for ms in sorted({ms for name, ms in points if name == listing}):
                if last is None or ms >= last + cooldown:
                    want.append((listing, ms))
                    last = ms
        got = replay_alerts(frame, [rule]).select("listing_id", "at_ms").collect()
        assert sorted(map(tuple, got)) == sorted(want), cooldown


def test_deliveries_stop_at_the_first_credential_refusal(spark):
    statuses = {"r1": [200, 500, 401, 200, 403], "r2": [204, 302, 200], "r3": [403], "r4": [None, 200]}
    rows = [(run, i, "s", f"{run}-{i}", "rule", NOW + i, i, "USD", s) for run, many in statuses.items() for i, s in enumerate(many)]
    outbox = spark.createDataFrame(
        rows, "run_id string, position int, source_id string, listing_id string, rule_id string, ms long, amount_minor_units long, currency string, status int"
    ).withColumn("fired_at", F.timestamp_millis("ms"))
    done = delivery.reconcile_deliveries(outbox)
    got = {}
    for r in done.orderBy("run_id", "position").collect():
        got.setdefault(r.run_id, []).append(r.outcome)
    assert got == {
        "r1": ["delivered", "failed", "refused", "not-attempted", "not-attempted"],
        "r2": ["delivered", "failed", "delivered"], "r3": ["refused"], "r4": ["failed", "delivered"],
    }
    old = done.where("listing_id in ('r1-0', 'r3-0')").withColumn("fired_at", F.timestamp_millis(F.lit(NOW + 10)))
    after = {r.listing_id: r.fired_at.timestamp() * 1000 for r in delivery.update_cooldowns(old, done).collect()}
    assert after == {"r1-0": NOW + 10, "r2-0": NOW, "r2-2": NOW + 2, "r3-0": NOW + 10, "r4-1": NOW + 1}


def test_rule_kinds_are_checked(spark):
    with pytest.raises(ValueError):
        window_low(history(spark, [("a", 1, 1)]), [Rule("x", 1, 1, 0, 0, kind="unknown")])
    with pytest.raises(ValueError):
        Rule("x", 0, 1, 0, 0)
    register_rule_kind("same", RULE_KINDS["window-low"])
    try:
        rows = fired(window_low(history(spark, flat("a", 2, 5, NOW)), [Rule("x", DAY_MS * 2, 1, 0, 0, kind="same")])).collect()
        assert len(rows) == 1
    finally:
        RULE_KINDS.pop("same")


def test_the_earliest_other_code_is_named(spark):
    day = NOW - 10 * DAY_MS
    codes = ["USD", "USD", "ZAR", "AUD", "CHF", "USD"]
    points = [("a", day + i * DAY_MS, 10_000, code) for i, code in enumerate(codes)] + [("a", NOW, 1, "USD"), ("a", NOW, 1, "ZAR"), ("a", NOW, 1, "x")]
    for hot_rows in (10**6, 1):
        rows = window_low(history(spark, points), [RULE], hot_rows=hot_rows).where(F.col("at_ms") == NOW).orderBy("obs_id").collect()
        assert [r.mismatch_currency for r in rows] == ["ZAR", "USD", "USD"]
        # Two of one instant go by their id, and the window ends before its own instant.
        tied = [("a", day, 1, "USD"), ("a", day + 1, 2, "EUR"), ("a", day + 1, 2, "CAD"), ("a", NOW, 1, "USD"), ("a", NOW, 1, "GBP")]
        rows = window_low(history(spark, tied), [RULE], hot_rows=hot_rows).where(F.col("at_ms") == NOW).orderBy("obs_id").collect()
        assert [r.mismatch_currency for r in rows] == ["EUR", "USD"]


def test_one_long_listing_is_cut_by_time_and_short_ones_are_not(spark):
    points = [("long", NOW - i * 3_600_001, 1000 + i * 37 % 101) for i in range(400)] + flat("short", 5, 2_000, NOW)
    whole = window_low(history(spark, points), [RULE], hot_rows=10**6).collect()
    cut = window_low(history(spark, points), [RULE], hot_rows=50)
    assert sorted(map(str, whole)) == sorted(map(str, cut.collect()))
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "_chunk" in plan and plan != window_low(history(spark, points), [RULE], hot_rows=10**6)._jdf.queryExecution().executedPlan().toString()


def test_rows_without_a_listing_have_no_history(spark):
    points = [(None, NOW - i * DAY_MS, 5) for i in range(4)] + flat("a", 4, 10_000, NOW)
    rows = window_low(history(spark, points), [RULE]).where("listing_id is null").collect()
    assert [(r.status, r.window_count) for r in rows] == [("empty-window", 0)] * 4
