"""Declared schemas of the tables; nothing is inferred on read."""

from __future__ import annotations

OBSERVATIONS = (
    "obs_id string, source_id string, listing_id string, store_id string, amount_minor_units long, currency string, "
    "observed_at timestamp, source_time_zone string, vendor_price_updated_at timestamp, "
    "raw_context_retention_hours int, raw_context string, availability string, observed_date date"
)
WATCHLIST = (
    "source_id string, listing_id string, listing_url string, enabled boolean, added_at timestamp, note string"
)
COOLDOWNS = (
    "source_id string, listing_id string, rule_id string, fired_at timestamp, amount_minor_units long, currency string"
)
PAGES = "page_id long, url string, html string"
RESPONSES = (
    "request_id string, source_id string, listing_id string, status int, body string, received_at timestamp"
)
REQUESTS = (
    "request_id string, source_id string, host string, at timestamp, status int, error string, retry_after string"
)
ROBOTS = "origin string, status int, body string, truncated boolean"
PERIOD_STOPS = (
    "source_id string, period_start_ms long, stopped_ms long, request_id string, reason string, notified_at timestamp"
)
