"""Configuration records. They are small by construction and checked on creation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS

# Configuration of at most so many rows is broadcast; more of it joins like any other table.
MAX_CONFIG_ROWS = 10_000


@dataclass(frozen=True)
class Rule:
    """A trailing-window low: beat the lowest price of the window by a margin."""

    rule_id: str
    window_ms: int
    minimum_observations: int
    improvement_minor_units: int
    cooldown_ms: int
    kind: str = "window-low"

    def __post_init__(self) -> None:
        if not self.rule_id.strip():
            raise ValueError("rule_id must not be empty")
        for name in ("window_ms", "minimum_observations"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} of {self.rule_id} must be at least 1")
        for name in ("improvement_minor_units", "cooldown_ms"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} of {self.rule_id} must not be negative")


@dataclass(frozen=True)
class Source:
    """What is declared about one source: money, zone, terms and politeness."""

    source_id: str
    currency: str = "USD"
    time_zone: str = "UTC"
    raw_context_retention_hours: int | None = None
    ceiling_hours: int | None = None
    attribution_required: bool = False
    attribute_to: str | None = None
    notice: str | None = None
    limit_statuses: tuple[int, ...] = (403,)
    documented_per_second: int | None = None
    documented_per_day: int | None = None


@dataclass(frozen=True)
class Allowance:
    """How many requests a source may make per epoch-aligned period."""

    limit: int
    period_ms: int = DAY_MS
    warn_fraction: float = 0.8

    @property
    def warn_count(self) -> int:
        """The smallest count whose share of the limit reaches the warn fraction."""
        count = int(self.limit * self.warn_fraction)
        while count > 1 and (count - 1) / self.limit >= self.warn_fraction:
            count -= 1
        while count / self.limit < self.warn_fraction:
            count += 1
        return max(count, 1)


@dataclass(frozen=True)
class Ceiling:
    """At most `max_requests` per trailing interval, each `min_delay_ms` apart."""

    max_requests: int
    interval_ms: int
    min_delay_ms: int


@dataclass(frozen=True)
class BreakerSettings:
    """Pause a source when enough of its recent outcomes failed."""

    window_ms: int
    minimum_outcomes: int
    failure_rate_threshold: float
    pause_ms: int


def small(frame: DataFrame, rows: int) -> DataFrame:
    """Configuration, marked for broadcasting after a check of its number of rows."""
    return F.broadcast(frame) if rows <= MAX_CONFIG_ROWS else frame


@dataclass(frozen=True)
class Registry:
    """The known sources, in the order they were declared."""

    sources: tuple[Source, ...] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        ids = [source.source_id for source in self.sources]
        if len(set(ids)) != len(ids):
            raise ValueError("source ids must be unique")

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row per source, marked for broadcasting if there are few."""
        schema = (
            "source_id string, currency string, time_zone string, retention_hours int, ceiling_hours int, "
            "attribution_required boolean, attribute_to string, notice string, limit_statuses array<int>, "
            "documented_per_second long, documented_per_day long"
        )
        rows = [
            (
                s.source_id, s.currency, s.time_zone, s.raw_context_retention_hours, s.ceiling_hours,
                s.attribution_required, s.attribute_to if s.attribute_to is not None else s.source_id,
                s.notice, list(s.limit_statuses), s.documented_per_second, s.documented_per_day,
            )
            for s in self.sources
        ]
        return small(spark.createDataFrame(rows, schema), len(rows))


def stop_period_ms(allowance: Allowance | None, breaker: BreakerSettings | None, default_pause_ms: int) -> int:
    """How long a stop lasts: the allowance period, else the pause, else the default."""
    if allowance is not None:
        return allowance.period_ms
    return breaker.pause_ms if breaker is not None else default_pause_ms


def by_source(settings: dict[str, int], source: Column, default: int | None = None) -> Column:
    """A per-source number from configuration, as a column expression."""
    if len(settings) > MAX_CONFIG_ROWS:
        raise ValueError("too many per-source settings")
    found = F.lit(default).cast("long")
    for source_id, value in settings.items():
        found = F.when(source == source_id, F.lit(value).cast("long")).otherwise(found)
    return found
