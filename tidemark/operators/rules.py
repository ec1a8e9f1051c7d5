"""Window-low verdicts over whole histories, and the alert statuses built on them."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.config import Rule
from tidemark.functions.instants import millis
from tidemark.functions.money import shown, with_code
from tidemark.functions.text import iso_millis, single_line, usable_link
from tidemark.operators.history import CURRENCY_SHAPE
from tidemark.operators.skew import HOT_ROWS, attach
from tidemark.operators.trailing import running, trailing
from tidemark.session import cut_lineage

LISTING = ("listing_id",)


#: A listing with more observations than this is cut into chunks of time.
FRAME_ROWS = 2_000


def _window_low_verdict(rule: Rule) -> Column:
    """The ordered refusals of one rule over the price columns and the window columns.

    A window tells `n`, its observations, `low` and `low_ms`, its lowest price and when that was first seen, and `other`,
    the earliest code that isn't the observation's own.
    """
    count = F.coalesce(F.col("n"), F.lit(0).cast("long"))
    # Compared as decimals: an amount next to the 64-bit limit must not overflow.
    reached = F.col("amount_minor_units").cast("decimal(20,0)") + rule.improvement_minor_units <= F.col("low")
    status = (
        F.when(count == 0, F.lit("empty-window"))
        .when(F.col("other").isNotNull(), F.lit("currency-mismatch"))
        .when(count < rule.minimum_observations, F.lit("insufficient-history"))
        .when(reached, F.lit("fired"))
        .otherwise(F.lit("not-lower"))
    )
    judged = status.isin("fired", "not-lower")
    return F.struct(
        F.lit(rule.rule_id).alias("rule_id"),
        status.alias("status"),
        count.alias("window_count"),
        F.when(judged, F.col("low")).alias("reference_amount"),
        F.when(judged, F.col("low_ms")).alias("reference_at_ms"),
        F.when(status == "currency-mismatch", F.col("other")).alias("mismatch_currency"),
    )


# A rule kind is a function from a rule to a verdict column over the window columns.
RULE_KINDS: dict[str, Callable[[Rule], Column]] = {"window-low": _window_low_verdict}


def register_rule_kind(kind: str, verdict: Callable[[Rule], Column]) -> None:
    """Add a rule kind; its verdict must be a struct like the built-in one's."""
    RULE_KINDS[kind] = verdict


def _judged(rows: DataFrame, kept: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """A verdict per row and rule; `windows` of a row holds what each width tells."""
    unknown = sorted({rule.kind for rule in rules} - set(RULE_KINDS))
    if unknown:
        raise ValueError(f"unknown rule kinds: {unknown}")
    told = rows.select(*kept, F.explode("windows").alias("w")).select(*kept, "w.*")
    each = F.array_compact(F.array(*[F.when(F.col("width") == rule.window_ms, RULE_KINDS[rule.kind](rule)) for rule in rules]))
    return told.select(*kept, F.explode(each).alias("v")).select(*kept, "v.*")


def _widths(rules: Sequence[Rule]) -> list[int]:
    if not rules:
        raise ValueError("at least one rule is needed")
    return sorted({rule.window_ms for rule in rules})


def _window(width: int, n: Column, low: Column, other: Column) -> Column:
    """One width's part of `windows`; `low` is a price with its instant."""
    return F.struct(
        F.lit(width).cast("long").alias("width"), n.cast("long").alias("n"), low["amount_minor_units"].alias("low"), low["at_ms"].alias("low_ms"),
        other.alias("other"),
    )


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def prices(observations: DataFrame, *extra: str) -> DataFrame:
    """The narrow projection every rule works on, with the instant in milliseconds."""
    return observations.select(
        "source_id", "listing_id", "obs_id", millis(F.col("observed_at")).alias("at_ms"),
        "amount_minor_units", "currency", *extra,
    )


def _coded(rows: DataFrame) -> DataFrame:
    """Codes as they are compared; anything but three capitals, which the guard of the history keeps out, is `???`."""
    return rows.withColumn("code", F.when(F.col("currency").rlike(CURRENCY_SHAPE), F.col("currency")).otherwise(F.lit("???")))


def _framed(rows: DataFrame, keys: Sequence[str], widths: Sequence[int]) -> DataFrame:
    """`windows` of the rows that ask, by plain frames over whole listings: one shuffle whatever the number of widths.

    Rows hold `counts` (part of the history) and `asks`. Only for listings of few rows, since a frame is added up anew
    for each of them. A listing is one chunk; rows without a listing or an instant have no history and are spread.
    """
    placed = reduce(and_, [F.col(k).isNotNull() for k in (*keys, "at_ms")])
    rows = rows.withColumn("_chunk", F.when(~placed, F.xxhash64("obs_id", "amount_minor_units", "currency")))
    listing = W.partitionBy(*keys, "_chunk")
    to_end = listing.orderBy(F.desc("at_ms"), F.desc("obs_id")).rowsBetween(W.unboundedPreceding, -1)
    in_order = listing.orderBy("at_ms", "obs_id").rowsBetween(W.unboundedPreceding, -1)
    # The earliest code other than one's own is the first of the window or the first that differs from that one.
    before = F.last(F.when(F.col("counts"), F.col("code")), ignorenulls=True).over(in_order)
    rows = rows.withColumn("change", F.when(F.col("counts") & (before != F.col("code")), F.struct("at_ms", "code")))
    rows = rows.withColumn("next", F.last("change", ignorenulls=True).over(to_end))
    counted = lambda *c: F.when(F.col("counts") & placed, F.struct(*c))
    rows = rows.withColumns({"_price": counted("amount_minor_units", "at_ms"), "_point": counted("at_ms", "obs_id", "code", "next")})
    cells = {}
    for width in widths:
        frame = listing.orderBy("at_ms").rangeBetween(1 - width, -1)
        cells |= {f"n{width}": F.count("_point").over(frame), f"low{width}": F.min("_price").over(frame), f"first{width}": F.min("_point").over(frame)}
    rows = rows.withColumns(cells).where("asks")

    def other(first: Column) -> Column:
        after = F.when(first["next"]["at_ms"] < F.col("at_ms"), first["next"]["code"])
        return F.when(first["code"] != F.col("code"), first["code"]).otherwise(after)

    windows = F.array(*[_window(w, F.col(f"n{w}"), F.col(f"low{w}"), other(F.col(f"first{w}"))) for w in widths])
    return rows.withColumn("windows", windows)


def _chunked(history: DataFrame, rows: DataFrame, keys: Sequence[str], widths: Sequence[int], probes: bool, hot_rows: int) -> DataFrame:
    """`windows` of rows of long listings, from chunks of time.

    The more rows the longest listing has, the shorter the chunks: about as many to a window as each holds points. The
    earliest other code is the least over the places in which two codes' numbers differ, so it merges like any minimum.
    """
    longest = history.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    codes = [r.code for r in history.select("code").unionByName(rows.select("code")).distinct().sort("code").collect()]  # three letters each
    bits = range((max(1, len(codes)) - 1).bit_length())
    number = F.array_position(F.lit(codes), F.col("code")) - 1 if codes else F.lit(0)
    bit = lambda b: F.shiftright(number, b) % 2
    point = F.struct("at_ms", "obs_id", "code")
    measures = {"n": ("sum", F.lit(1).cast("long")), "low": ("min", F.struct("amount_minor_units", "at_ms"))}
    measures |= {f"b{b}{v}": ("min", F.when(bit(b) == v, point)) for b in bits for v in (0, 1)}
    on = [*keys, "at_ms"]
    seen = rows
    for width in widths:
        window = trailing(
            history, keys, "at_ms", width, measures, rows if probes else None, shortest_chunk_ms=1, most_chunks=max(64, math.isqrt(longest))
        )
        window = window.select(*on, F.struct(*measures).alias(f"w{width}"))
        seen = attach(seen, window, on, keys, hot_rows)

    def told(width: int) -> Column:
        cells = F.col(f"w{width}")
        points = [F.when(bit(b) == 0, cells[f"b{b}1"]).otherwise(cells[f"b{b}0"]) for b in bits]
        least = F.least(*points) if len(points) > 1 else points[0] if points else F.lit(None).cast("struct<code:string>")
        return _window(width, cells["n"], cells["low"], least["code"])

    return seen.withColumn("windows", F.array(*[told(width) for width in widths]))


def window_low(
    observations: DataFrame,
    rules: Sequence[Rule],
    history_keys: Sequence[str] = LISTING,
    only: DataFrame | None = None,
    hot_rows: int = FRAME_ROWS,
    joining: bool = False,
) -> DataFrame:
    """A verdict for every observation and rule over the observation's own trailing window.

    `only` names the observations to judge, where they are few against the history `observations`; only their listings
    are then looked at. If they are `joining`, they are not in `observations` yet and count like those. Listings of more than `hot_rows` observations are cut by time, all others are a plain frame each.
    """
    keys, widths = list(history_keys), _widths(rules)
    history = _coded(prices(observations))
    kept = [name for name in history.columns if name != "code"]
    rows = history
    if only is not None:
        rows = _coded(prices(only))
        history = history.join(rows.select(*keys).distinct(), keys, "left_semi").select(*history.columns)

    def flagged(history: DataFrame, rows: DataFrame) -> DataFrame:
        counting = history.withColumns({"counts": F.lit(True), "asks": F.lit(only is None)})
        return counting if only is None else counting.unionByName(rows.withColumns({"counts": F.lit(joining), "asks": F.lit(True)}))

    whole = history.unionByName(rows) if joining and only is not None else history
    long = cut_lineage(whole.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows).select(*keys))
    if long.isEmpty():
        return _judged(_framed(flagged(history, rows), keys, widths), kept, rules)
    cold = _framed(flagged(history.join(long, keys, "left_anti"), rows.join(long, keys, "left_anti")), keys, widths)
    hot = [df.join(long, keys, "left_semi") for df in (whole, rows)]
    cut = _chunked(*hot, keys, widths, only is not None, HOT_ROWS if hot_rows == FRAME_ROWS else hot_rows)
    return _judged(cold.select(*kept, "windows").unionByName(cut.select(*kept, "windows")), kept, rules)


def fired(verdicts: DataFrame) -> DataFrame:
    """Only the firings."""
    return verdicts.where(F.col("status") == "fired")


def _instant(ms: int) -> Column:
    return F.lit(dt.datetime.fromtimestamp(ms / 1000, dt.timezone.utc))


def between(observations: DataFrame, after_ms: int, until_ms: int) -> DataFrame:
    """Observations with `after < observed_at <= until`; the literals reach the scan.

    Where the table is partitioned by `observed_date`, its bounds are given too,
    so whole partitions are skipped.
    """
    # Timestamps may carry microseconds, and the comparison is in milliseconds.
    rows = observations.where(
        (F.col("observed_at") >= _instant(after_ms + 1)) & (F.col("observed_at") < _instant(until_ms + 1))
    )
    if "observed_date" in observations.columns:
        first, last = (dt.datetime.fromtimestamp(ms / 1000, dt.timezone.utc).date() for ms in (after_ms, until_ms))
        # Files that were written without the partition column are read for their instants alone.
        rows = rows.where(F.col("observed_date").isNull() | F.col("observed_date").between(F.lit(first), F.lit(last)))
    return rows


def latest(observations: DataFrame, as_of_ms: int, within_ms: int, keys: Sequence[str] = LISTING) -> DataFrame:
    """The last observation of each listing at or before `as_of`, highest id first among equals.

    One aggregate with a map-side combine; no sort and no group in one task.
    """
    rows = prices(between(observations, as_of_ms - within_ms, as_of_ms))
    order = F.struct("at_ms", "obs_id")
    cells = F.struct(*[c for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(cells, order).alias("o")).select(*keys, "o.*")


def evaluate_alerts(
    observations: DataFrame,
    watchlist: DataFrame,
    rules: Sequence[Rule],
    cooldowns: DataFrame,
    as_of_ms: int,
    endings: DataFrame | None = None,
    history_keys: Sequence[str] = LISTING,
) -> DataFrame:
    """One status per enabled watchlist entry and rule, as of one instant.

    Statuses: no-observation, empty-window, currency-mismatch,
    insufficient-history, not-lower, suppressed, undeliverable, deliverable.
    """
    widest = max(rule.window_ms for rule in rules)
    listed = watchlist.where("enabled").select("source_id", "listing_id", "listing_url")
    recent = between(observations, as_of_ms - 2 * widest, as_of_ms)
    last = latest(recent, as_of_ms, widest, history_keys)
    if "source_id" not in history_keys:
        last = last.drop("source_id")
    # One listing has one instant to judge, so all its windows are conditional measures of one grouping.
    asked = _coded(last).select(*history_keys, F.struct(*last.columns, "code").alias("o"))
    points = _coded(prices(recent)).select(*history_keys, F.struct("at_ms", "amount_minor_units", "obs_id", "code").alias("p"))
    pairs = asked.join(points, list(history_keys), "left")
    cells = {}
    for width in _widths(rules):
        inside = (F.col("p.at_ms") < F.col("o.at_ms")) & (F.col("p.at_ms") > F.col("o.at_ms") - width)
        foreign = inside & (F.col("p.code") != F.col("o.code"))
        cells[f"n{width}"] = F.count_if(inside)
        cells[f"low{width}"] = F.min(F.when(inside, F.struct("p.amount_minor_units", "p.at_ms")))
        cells[f"other{width}"] = F.min(F.when(foreign, F.struct("p.at_ms", "p.obs_id", "p.code")))["code"]
    seen = pairs.groupBy(*history_keys).agg(F.any_value("o").alias("o"), *[c.alias(name) for name, c in cells.items()])
    windows = F.array(*[_window(w, F.col(f"n{w}"), F.col(f"low{w}"), F.col(f"other{w}")) for w in _widths(rules)])
    verdicts = _judged(seen.select("o.*", windows.alias("windows")), last.columns, rules)

    # A listing without an observation is one skipped row, whatever the rules.
    rows = listed.join(verdicts, list(history_keys), "left").join(
        cooldowns.select("source_id", "listing_id", "rule_id", millis(F.col("fired_at")).alias("last_fired_ms")),
        ["source_id", "listing_id", "rule_id"],
        "left",
    )
    cooldown = F.coalesce(*[F.when(F.col("rule_id") == r.rule_id, F.lit(r.cooldown_ms).cast("long")) for r in rules])
    quiet_until = F.col("last_fired_ms") + cooldown
    link = usable_link(F.col("listing_url"))
    status = (
        F.when(F.col("status").isNull(), F.lit("no-observation"))
        .when(F.col("status") != "fired", F.col("status"))
        .when(quiet_until > as_of_ms, F.lit("suppressed"))
        .when(link.isNull(), F.lit("undeliverable"))
        .otherwise(F.lit("deliverable"))
    )
    out = rows.select(
        "source_id", "listing_id", "rule_id", status.alias("status"), "at_ms", "amount_minor_units", "currency",
        "window_count", "reference_amount", "reference_at_ms", "mismatch_currency",
        F.when(status == "suppressed", quiet_until).alias("quiet_until_ms"),
        F.when(status == "deliverable", link).alias("link"),
    )
    if endings is None:
        return out.withColumn("clearance_ending", F.lit(None).cast("string"))
    tagged = out.join(endings.select("source_id", "endings"), "source_id", "left")
    ending = F.when(F.col("status") == "deliverable", clearance_ending(F.col("amount_minor_units"), F.col("endings")))
    return tagged.withColumn("clearance_ending", ending).drop("endings")


def clearance_ending(amount: Column, endings: Column) -> Column:
    """The first configured ending the amount's digits end in; a tag, never a trigger."""
    digits = F.regexp_replace(amount.cast("string"), "^-", "")
    matching = F.filter(endings, lambda ending: (F.length(ending) > 0) & F.endswith(digits, ending))
    return F.try_element_at(matching, F.lit(1))


def clearance_tag(alerts: DataFrame, endings: DataFrame) -> DataFrame:
    """Alerts with the clearance ending of their source, where one matches."""
    known = alerts.join(endings.select("source_id", "endings"), "source_id", "left")
    return known.withColumn(
        "clearance_ending", clearance_ending(F.col("amount_minor_units"), F.col("endings"))
    ).drop("endings")


def compose_alerts(alerts: DataFrame) -> DataFrame:
    """The outbox: a title and a self-explaining body for every deliverable alert."""
    # The wording of an alert.
    observed, reference = shown("amount_minor_units"), shown("reference_amount")
    subject = F.concat_ws("/", "source_id", "listing_id")
    body = F.concat_ws(
        "\n",
        F.concat(F.col("rule_id"), F.lit(" fired for "), subject, F.lit(".")),
        F.concat(F.lit("Observed "), observed, F.lit(" at "), iso_millis(F.timestamp_millis("at_ms")), F.lit(".")),
        F.concat(
            F.lit("It beats "), reference, F.lit(", the lowest of the "), F.col("window_count").cast("string"),
            F.lit(" observation(s) in the window, seen "), iso_millis(F.timestamp_millis("reference_at_ms")),
            F.lit("."),
        ),
        F.col("link"),
        F.when(
            F.col("clearance_ending").isNotNull(),
            F.concat(
                F.lit("Price ends in "), F.col("clearance_ending"),
                F.lit(
                    ", which is one of the endings you configured for this source. That is a corroborating tag "
                    "only: it did not trigger this alert and it never can."
                ),
            ),
        ),
    )
    title = F.concat(observed, F.lit(" on "), F.col("listing_id"), F.lit(" ("), F.col("rule_id"), F.lit(")"))
    ready = with_code(alerts.where(F.col("status") == "deliverable"), F.col("currency"))
    return ready.select(
        "rule_id", "source_id", "listing_id", single_line(title).alias("title"), body.alias("body"), "link",
        F.col("amount_minor_units").alias("observed_amount"), "reference_amount", "currency", "clearance_ending",
        "at_ms",
    )


def alert_report(statuses: DataFrame) -> DataFrame:
    """Per source and status: how many. The rows behind a count stay in `statuses`."""
    return statuses.groupBy("source_id", "status").agg(F.count("*").alias("n"))


def _next_at_or_after(points: DataFrame, keys: Sequence[str], gap_ms: int) -> DataFrame:
    """For every point the first point of its key that lies at least `gap_ms` later."""
    # Time runs backwards, so "everything at or after t + gap" is a prefix.
    moments = points.select(
        *keys,
        F.explode(
            F.array(
                F.struct((-F.col("at_ms")).alias("back"), F.col("at_ms").alias("value"), F.lit(0).alias("asks")),
                F.struct(
                    (1 - F.col("at_ms") - gap_ms).alias("back"),
                    F.lit(None).cast("long").alias("value"),
                    F.lit(1).alias("asks"),
                ),
            )
        ).alias("m"),
    ).select(*keys, "m.*")
    found = running(moments, keys, "back", {"nxt": ("min", F.col("value")), "asks": ("max", F.col("asks"))})
    return found.where("own_asks = 1").select(*keys, (1 - F.col("back") - gap_ms).alias("at_ms"), "nxt")


def replay_alerts(
    firings: DataFrame, rules: Sequence[Rule], history_keys: Sequence[str] = LISTING
) -> DataFrame:
    """The firings a cooldown lets through, over all history.

    From a kept firing the next kept one is the first at least a cooldown later,
    so the kept firings are a chain of pointers. The chain is followed by
    doubling the pointers: log2(chain length) rounds of equi-joins, and no group
    is ever folded in one task.
    """
    kept = [_replay_rule(firings, rule, list(history_keys)) for rule in rules]
    return _union(kept)


def _replay_rule(firings: DataFrame, rule: Rule, keys: list[str]) -> DataFrame:
    # One alert per instant: the lowest price, then the lowest id.
    order = F.struct("amount_minor_units", "obs_id")
    rows = firings.where(F.col("rule_id") == rule.rule_id)
    cells = F.struct(*[c for c in rows.columns if c not in (*keys, "at_ms")])
    points = rows.groupBy(*keys, "at_ms").agg(F.min_by(cells, order).alias("cells"))
    if rule.cooldown_ms == 0:
        return points.select(*keys, "at_ms", "cells.*")
    points = cut_lineage(points)
    reach = points.groupBy(*keys).agg((F.max("at_ms") - F.min("at_ms")).alias("span")).agg(F.max("span")).first()[0]
    hops = cut_lineage(_next_at_or_after(points, keys, rule.cooldown_ms).where("nxt is not null"))
    marked = points.groupBy(*keys).agg(F.min("at_ms").alias("at_ms"))
    longest = (reach or 0) // rule.cooldown_ms + 1
    covered = 1
    while covered < longest:
        # `hops` jumps `covered` kept firings ahead, and `marked` holds the first `covered` of each key.
        marked = cut_lineage(
            marked.unionByName(
                marked.join(hops, [*keys, "at_ms"]).select(*keys, F.col("nxt").alias("at_ms"))
            )
        )
        covered *= 2
        if covered < longest:
            ahead = hops.select(*keys, F.col("at_ms").alias("nxt"), F.col("nxt").alias("nxt2"))
            hops = cut_lineage(hops.join(ahead, [*keys, "nxt"]).select(*keys, "at_ms", F.col("nxt2").alias("nxt")))
    return points.join(marked, [*keys, "at_ms"], "left_semi").select(*keys, "at_ms", "cells.*")


def endings_frame(observations: DataFrame, endings: Mapping[str, Sequence[str]]) -> DataFrame:
    """Configured endings as rows; at most one row per configured source."""
    return observations.sparkSession.createDataFrame(
        [(source, list(values)) for source, values in endings.items()], "source_id string, endings array<string>"
    )
