"""The watchlist: scans, upserts and the check that a run stayed inside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["source_id", "listing_id"]


def enabled_entries(watchlist: DataFrame, source_id: str | None = None, with_link: bool = False) -> DataFrame:
    """The entries a run looks at; order them only where they are written."""
    rows = watchlist.where("enabled")
    if source_id is not None:
        rows = rows.where(F.col("source_id") == source_id)
    return rows.select(*KEY, "enabled", *(["listing_url"] if with_link else []))


def upsert_watchlist(current: DataFrame, changes: DataFrame) -> DataFrame:
    """The watchlist after `changes` (`source_id, listing_id, listing_url?, note?, enabled?, added_at, seq`).

    The last change of a key wins as a whole: what it does not state becomes null,
    and `enabled` becomes true. `added_at` stays that of the first insert.
    """
    for name, kind in (("listing_url", "string"), ("note", "string"), ("enabled", "boolean")):
        if name not in changes.columns:
            changes = changes.withColumn(name, F.lit(None).cast(kind))
    last = changes.groupBy(*KEY).agg(
        F.max_by(F.struct("listing_url", "note", "enabled"), "seq").alias("new"),
        F.min_by("added_at", "seq").alias("first_added"),
    )
    both = current.join(last, KEY, "full_outer")
    changed = F.col("new").isNotNull()
    return both.select(
        *KEY,
        F.when(changed, F.col("new.listing_url")).otherwise(F.col("listing_url")).alias("listing_url"),
        F.when(changed, F.coalesce(F.col("new.enabled"), F.lit(True))).otherwise(F.col("enabled")).alias("enabled"),
        F.coalesce(F.col("added_at"), F.col("first_added")).alias("added_at"),
        F.when(changed, F.col("new.note")).otherwise(F.col("note")).alias("note"),
    )


def switch_entries(current: DataFrame, switches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The watchlist after `switches` (`source_id, listing_id, enabled, seq`), and per key whether it existed."""
    last = switches.groupBy(*KEY).agg(F.max_by("enabled", "seq").alias("_switch"))
    updated = current.join(last, KEY, "left").withColumn("enabled", F.coalesce("_switch", "enabled")).drop("_switch")
    existed = last.join(current.select(*KEY, F.lit(True).alias("existed")), KEY, "left").select(
        *KEY, F.coalesce("existed", F.lit(False)).alias("existed")
    )
    return updated, existed


def attempted_outside_watchlist(attempted: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Listings a run asked about although they are not enabled; empty when it behaved."""
    return attempted.join(enabled_entries(watchlist), KEY, "left_anti")


def without_stopped(entries: DataFrame, stops: DataFrame, period: Column) -> DataFrame:
    """Entries whose source is not stopped for the period `period` (start, in milliseconds)."""
    held = stops.select("source_id", "period_start_ms")
    return entries.withColumn("period_start_ms", period).join(held, ["source_id", "period_start_ms"], "left_anti")


def skipped_because_stopped(entries: DataFrame, stops: DataFrame, period: Column) -> DataFrame:
    """The other half of `without_stopped`."""
    held = stops.select("source_id", "period_start_ms")
    return entries.withColumn("period_start_ms", period).join(held, ["source_id", "period_start_ms"], "left_semi")
