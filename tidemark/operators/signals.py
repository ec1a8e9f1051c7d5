"""Signals over a price history: every kind brings its own measures into one window pass.

A signal names a trailing window (or all time before), measures that merge (sums, minima, maxima), and a verdict over
them. Signals of one width share their measures. Measures are exact: sums and sums of squares are decimals, and a verdict
compares products of them, never quotients, averages or roots. What would not fit 38 digits is `out-of-range`, not wrong.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import trim_all
from tidemark.operators.history import CURRENCY_SHAPE
from tidemark.operators.rules import FRAME_ROWS, LISTING, prices
from tidemark.operators.skew import HOT_ROWS, attach
from tidemark.operators.trailing import Measure, running, trailing
from tidemark.session import cut_lineage

_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}

# Amounts beyond this are counted apart, so that a sum of squares can't leave 38 digits.
MOST_AMOUNT = 10**12
# Calendar ranges longer than this are a mistake; the bound is what lets a range be one row per day.
MAX_RANGE_DAYS = 400


@dataclass(frozen=True)
class Signal:
    """One rule: its window (`None`: everything before), its measures over `prices` columns, and its verdict.

    Both are functions, so that a signal can be stated before there is a session.
    `verdict` gets a function from a measure's name to its column and returns a struct of `status` and
    `reference_amount`. `minimum_observations` is checked before it and, if it
    `compares_prices`, that the window holds no currency but the price's own.
    """

    signal_id: str
    width_ms: int | None
    measures: Callable[[], Mapping[str, Measure]]
    verdict: Callable[[Callable[[str], Column]], Column]
    minimum_observations: int = 1
    compares_prices: bool = True

    def __post_init__(self) -> None:
        if not self.signal_id.strip():
            raise ValueError("signal_id must not be empty")
        if self.width_ms is not None and self.width_ms < 1:
            raise ValueError(f"width_ms of {self.signal_id} must be at least 1")


_WIDE = "decimal(38,0)"
_amount = lambda: F.col("amount_minor_units").cast("decimal(20,0)")
# Only observations with a price make up the history that prices are compared with.
_priced = lambda value: F.when(F.col("amount_minor_units").isNotNull(), value)
# An amount that can't be squared is left out of the moments, and `big` tells that there was one.
_fits = lambda: F.abs(_amount()) <= MOST_AMOUNT


def _moments() -> dict[str, Measure]:
    small = F.when(_fits(), _amount().cast("decimal(13,0)"))
    return {
        "big": ("max", ~_fits()),
        "total": ("sum", small.cast("decimal(25,0)")),
        "squares": ("sum", (small * small).cast("decimal(26,0)")),
    }


def _told(status: Column, reference: Column) -> Column:
    return F.struct(status.alias("status"), reference.cast("bigint").alias("reference_amount"))


def _times(first: Column, *others: Column) -> Column:
    """A product of whole numbers, null where it leaves 38 digits."""
    return reduce(lambda a, b: F.try_multiply(a.cast(_WIDE), b.cast(_WIDE)), others, first.cast(_WIDE))


def low(signal_id: str, width_ms: int | None, minimum_observations: int, improvement: int = 0) -> Signal:
    """The lowest price of the window, or of all time, undercut by `improvement` minor units."""

    def verdict(of: Callable[[str], Column]) -> Column:
        reached = _amount() + improvement <= of("low")
        return _told(F.when(reached, F.lit("fired")).otherwise(F.lit("not-lower")), of("low"))

    return Signal(signal_id, width_ms, lambda: {"low": ("min", F.col("amount_minor_units"))}, verdict, minimum_observations)


def drop(signal_id: str, width_ms: int | None, minimum_observations: int, basis_points: int | Column) -> Signal:
    """At least `basis_points` hundredths of a percent under the window's average; the reference is the average, rounded down."""

    def verdict(of: Callable[[str], Column]) -> Column:
        n, total = of("n"), of("total")
        bar = _times(total, F.lit(10_000) - basis_points)
        price = _times(n, _amount(), F.lit(10_000))
        status = (
            F.when(of("big") | ~_fits() | price.isNull() | bar.isNull(), F.lit("out-of-range"))
            .when(total <= 0, F.lit("no-average"))
            .when(price <= bar, F.lit("fired"))
            .otherwise(F.lit("not-lower"))
        )
        return _told(status, F.when(status.isin("fired", "not-lower"), _whole(total, n)))

    return Signal(signal_id, width_ms, _moments, verdict, minimum_observations)


def _whole(total: Column, n: Column) -> Column:
    """`total` div `n` for a total above zero."""
    rest = total.cast(_WIDE) % n.cast(_WIDE)
    return ((total.cast(_WIDE) - rest) / n.cast("decimal(20,0)")).cast("decimal(25,0)")


def outlier(signal_id: str, width_ms: int | None, minimum_observations: int, tenths: int) -> Signal:
    """At least `tenths`/10 sample standard deviations under the window's mean.

    With n prices, their sum s and sum of squares q, a price p is that low when s > n p and
    100 (s - n p)^2 (n - 1) >= tenths^2 n (n q - s^2). A window without spread gives no verdict.
    """

    def verdict(of: Callable[[str], Column]) -> Column:
        n, total = of("n"), of("total")
        spread = F.try_subtract(_times(n, of("squares")), _times(total, total))
        under = F.try_subtract(total.cast(_WIDE), _times(n, _amount()))
        far = _times(under, under, n - 1, F.lit(100))
        bar = _times(spread, n, F.lit(tenths * tenths))
        status = (
            F.when(of("big") | ~_fits() | far.isNull() | bar.isNull(), F.lit("out-of-range"))
            .when(spread == 0, F.lit("no-spread"))
            .when((under > 0) & (far >= bar), F.lit("fired"))
            .otherwise(F.lit("not-lower"))
        )
        return _told(status, F.lit(None))

    return Signal(signal_id, width_ms, _moments, verdict, max(2, minimum_observations))


def availability_state(value: Column) -> Column:
    """`in`, `out` or null (unknown) of a schema.org availability, with or without its address."""
    name = F.lower(F.element_at(F.split(trim_all(value), "/"), -1))
    # The schema.org names for an item that can be had now, and for one that cannot.
    return F.when(name.isin("instock", "instoreonly", "onlineonly", "limitedavailability"), F.lit("in")).when(
        name.isin("outofstock", "soldout", "discontinued", "backorder"), F.lit("out")
    )


def back_in_stock(signal_id: str = "back-in-stock") -> Signal:
    """In stock now, and out of stock by the last known state at an earlier instant.

    Observations without a known state are passed over. Of several at one instant the highest id is the last; rows of one
    instant don't see each other. The reference is the price at that last known state.
    """

    def measures() -> dict[str, Measure]:
        state = availability_state(F.col("availability"))
        return {"state": ("max", F.when(state.isNotNull(), F.struct("at_ms", "obs_id", state.alias("state"), "amount_minor_units")))}

    def verdict(of: Callable[[str], Column]) -> Column:
        now, last = availability_state(F.col("availability")), of("state")
        status = (
            F.when(now.isNull(), F.lit("unknown"))
            .when(last.isNull(), F.lit("no-earlier-state"))
            .when((now == "in") & (last["state"] == "out"), F.lit("fired"))
            .otherwise(F.lit("no-change"))
        )
        return _told(status, F.when(status.isin("fired", "no-change"), last["amount_minor_units"]))

    return Signal(signal_id, None, measures, verdict, 0, compares_prices=False)


def _common() -> dict[str, Measure]:
    code = _priced(F.coalesce("currency", F.lit("")))
    return {"n": ("sum", _priced(F.lit(1).cast("long"))), "first_code": ("min", code), "last_code": ("max", code)}


def _measures_by_width(signals: Sequence[Signal]) -> dict[int | None, dict[str, Measure]]:
    """Every width with what its signals measure; signals of a width that use one name share the measure."""
    out: dict[int | None, dict[str, Measure]] = {}
    for signal in signals:
        own = out.setdefault(signal.width_ms, _common())
        for name, measure in signal.measures().items():
            kind, value = own.setdefault(name, measure)
            if (kind, str(value)) != (measure[0], str(measure[1])):
                raise ValueError(f"two measures of one width are named {name}")
    return out


def _cell(width: int | None) -> str:
    return "_all" if width is None else f"_w{width}"


def _framed(rows: DataFrame, keys: Sequence[str], widths: Mapping[int | None, Mapping[str, Measure]]) -> DataFrame:
    """One shuffle and sort for all widths. Rows without a key or an instant have no history and are spread."""
    placed = reduce(and_, [F.col(k).isNotNull() for k in (*keys, "at_ms")])
    rows = rows.withColumn("_spread", F.when(~placed, F.xxhash64("obs_id", "amount_minor_units", "currency")))
    listing = W.partitionBy(*keys, "_spread").orderBy("at_ms")
    cells = {}
    for width, measures in widths.items():
        frame = listing.rangeBetween(W.unboundedPreceding if width is None else 1 - width, -1)
        told = [_MERGE[kind](F.when(placed, value)).over(frame).alias(name) for name, (kind, value) in measures.items()]
        cells[_cell(width)] = F.struct(*told)
    return rows.withColumns(cells).drop("_spread")


def _chunked(rows: DataFrame, keys: Sequence[str], widths: Mapping[int | None, Mapping[str, Measure]]) -> DataFrame:
    """The same for long listings, from chunks of time; what is known before a chunk is carried over its border."""
    on, dated = [*keys, "at_ms"], rows.where("at_ms IS NOT NULL")
    for width, measures in widths.items():
        seen = running(dated, keys, "at_ms", measures) if width is None else trailing(dated, keys, "at_ms", width, measures, shortest_chunk_ms=1)
        rows = attach(rows, seen.select(*on, F.struct(*measures).alias(_cell(width))), on, keys)
    return rows


def _judged(
    observations: DataFrame, signals: Sequence[Signal], history_keys: Sequence[str], hot_rows: int | None, extra: Sequence[str] = ()
) -> tuple[DataFrame, list[str], list[Column]]:
    """The rows with their windows, the columns to keep, and the verdict of each signal over them."""
    if not signals or len({s.signal_id for s in signals}) != len(signals):
        raise ValueError("signals must be given and have different ids")
    keys, widths = list(history_keys), _measures_by_width(signals)
    if hot_rows is None:
        # A frame over everything before grows row by row; only one with a lower end is added up anew for each row.
        hot_rows = HOT_ROWS if all(width is None for width in widths) else FRAME_ROWS
    if "availability" not in observations.columns:
        observations = observations.withColumn("availability", F.lit(None).cast("string"))
    rows = prices(observations, "availability", *extra)
    kept, cells = list(rows.columns), [_cell(width) for width in widths]
    long = cut_lineage(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows).select(*keys))
    if long.isEmpty():
        seen = _framed(rows, keys, widths)
    else:
        cold = _framed(rows.join(long, keys, "left_anti"), keys, widths).select(*kept, *cells)
        seen = cold.unionByName(_chunked(rows.join(long, keys, "left_semi"), keys, widths).select(*kept, *cells))

    def told(signal: Signal) -> Column:
        of = lambda name: F.col(_cell(signal.width_ms))[name]
        count, code = F.coalesce(of("n"), F.lit(0).cast("long")), F.coalesce("currency", F.lit(""))
        own = signal.verdict(of)
        refusal = F.when(count < signal.minimum_observations, F.lit("insufficient-history"))
        if signal.compares_prices:
            mixed = (of("first_code") != code) | (of("last_code") != code)
            refusal = (
                F.when(F.col("amount_minor_units").isNull(), F.lit("no-price"))
                .when(count == 0, F.lit("empty-window"))
                .when(mixed, F.lit("currency-mismatch"))
                .otherwise(refusal)
            )
        return F.struct(
            F.lit(signal.signal_id).alias("signal_id"), F.coalesce(refusal, own["status"]).alias("status"), count.alias("window_count"),
            F.when(refusal.isNull(), own["reference_amount"]).alias("reference_amount"),
        )

    return seen, kept, [told(signal) for signal in signals]


def judge(
    observations: DataFrame, signals: Sequence[Signal], history_keys: Sequence[str] = LISTING, hot_rows: int | None = None
) -> DataFrame:
    """A status for every observation and signal, over the history strictly before the observation.

    Statuses of signals that compare prices: no-price (a null amount), empty-window, currency-mismatch (the window holds
    another code), insufficient-history, then the signal's own. Listings of more than `hot_rows` observations (FRAME_ROWS,
    or HOT_ROWS if no signal has a width) are cut by time, the others are one plain frame each. Repeated rows count each for itself. Rows without a key or an instant have
    an empty window. `availability` may be missing.
    """
    seen, kept, verdicts = _judged(observations, signals, history_keys, hot_rows)
    return seen.select(*kept, F.explode(F.array(*verdicts)).alias("v")).select(*kept, "v.*")


def target_prices(observations: DataFrame, targets: DataFrame) -> DataFrame:
    """Every observation of a listing with a target (`listing_id, currency, target_minor_units`) and whether it reaches it.

    Of several targets of a listing in one currency the highest counts. Statuses: fired, above-target, currency-mismatch
    (the listing has targets in other currencies only), no-price. A target without a listing, an amount or a code of three
    capitals is none.
    """
    usable = targets.where(F.col("currency").rlike(CURRENCY_SHAPE) & F.col("listing_id").isNotNull() & F.col("target_minor_units").isNotNull())
    best = usable.groupBy("listing_id", "currency").agg(F.max("target_minor_units").alias("target_minor_units"))
    # A code is three capitals, which bounds the map of a listing.
    per_listing = best.groupBy("listing_id").agg(
        F.map_from_entries(F.collect_list(F.struct("currency", "target_minor_units"))).alias("targets")
    )
    rows = attach(prices(observations), per_listing, ["listing_id"]).where("targets IS NOT NULL")
    target = F.try_element_at("targets", F.col("currency"))
    status = (
        F.when(F.col("amount_minor_units").isNull(), F.lit("no-price"))
        .when(target.isNull(), F.lit("currency-mismatch"))
        .when(F.col("amount_minor_units") <= target, F.lit("fired"))
        .otherwise(F.lit("above-target"))
    )
    return rows.withColumn("target_minor_units", target).withColumn("status", status).drop("targets")


def seasons_by_day(calendar: DataFrame) -> DataFrame:
    """A calendar (`source_id` or null for all, `starts_on`, `ends_before`, `extra_basis_points`) as one row per source and day.

    Days are UTC. Where ranges overlap the highest bar counts; `seasons` tells how many there are. Ranges that are empty,
    undated or longer than MAX_RANGE_DAYS are left out of the index, so check the calendar with `season_faults` first.
    """
    ranges = calendar.where(~_faulty()).select(
        "source_id", "extra_basis_points", F.explode(F.sequence("starts_on", F.date_sub("ends_before", 1))).alias("day")
    )
    return ranges.groupBy("source_id", "day").agg(F.max("extra_basis_points").alias("extra"), F.count("*").alias("seasons"))


def _faulty() -> Column:
    days = F.datediff("ends_before", "starts_on")
    return ~F.coalesce((days >= 1) & (days <= MAX_RANGE_DAYS) & (F.col("extra_basis_points") >= 0), F.lit(False))


def season_faults(calendar: DataFrame) -> DataFrame:
    """Calendar rows that `seasons_by_day` leaves out."""
    return calendar.where(_faulty())


def seasonal_drops(
    observations: DataFrame, calendar: DataFrame, width_ms: int, minimum_observations: int, basis_points: int,
    history_keys: Sequence[str] = LISTING, hot_rows: int = FRAME_ROWS,
) -> DataFrame:
    """Percent drops whose bar is raised in season, while an all-time low always alerts.

    Statuses: fired, all-time-low (a drop or not, below everything before), seasonal (enough of a drop on other days only),
    and those of `drop`. Seasons meet observations by equal source and day, so no range is compared row by row.
    """
    seasons = seasons_by_day(calendar)
    rows = prices(observations).withColumn("observed_at", F.timestamp_millis("at_ms")).withColumn("day", F.to_date("observed_at"))
    ours = seasons.where("source_id IS NOT NULL").withColumnsRenamed({"extra": "own_extra", "seasons": "own_seasons"})
    rows = rows.join(ours, ["source_id", "day"], "left").join(seasons.where("source_id IS NULL").drop("source_id"), "day", "left")
    zero = F.lit(0)
    rows = rows.withColumns({
        "extra": F.greatest(F.coalesce("extra", zero), F.coalesce("own_extra", zero)),
        "seasons": F.coalesce("seasons", zero) + F.coalesce("own_seasons", zero),
    })
    signals = [
        drop("drop", width_ms, minimum_observations, basis_points),
        drop("raised", width_ms, minimum_observations, F.lit(basis_points) + F.col("extra")),
        low("lowest", None, minimum_observations, 1),
    ]
    seen, kept, (plain, raised, lowest) = _judged(rows, signals, history_keys, hot_rows, ("seasons", "extra"))
    status = (
        F.when(lowest["status"] == "fired", F.lit("all-time-low"))
        .when(raised["status"] == "fired", F.lit("fired"))
        .when(plain["status"] == "fired", F.lit("seasonal"))
        .otherwise(plain["status"])
    )
    return seen.select(*kept, status.alias("status"), plain["window_count"].alias("window_count"), plain["reference_amount"].alias("reference_amount"))
