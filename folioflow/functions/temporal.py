"""Bi-temporal expressions: valid time and transaction time, null for an open bound."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
MAX_DELAY = 30 * DAY
MAX_RETRIES = 10


def read_datetime(s: Column) -> Column:
    """A timestamp from RFC 3339 text or epoch seconds; null, empty, OPEN and anything else are null."""
    t = F.trim(s)
    number = t.try_cast("bigint")
    return F.when(t.isNull() | (t == "") | (t == "OPEN"), None).when(number.isNotNull(), F.timestamp_seconds(number)).otherwise(t.try_cast("timestamp"))


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 as a whole number, the nearest one, halves to the even one: what a cast of fractional seconds to an integer gives in the SQL."""
    return F.rint(F.unix_micros(ts.cast("timestamp")) / 1e6).cast("bigint")


def is_active_at(valid_from: Column, valid_to: Column, at: Column) -> Column:
    """Half open [from, to); a missing side is unbounded."""
    return (valid_from.isNull() | (valid_from <= at)) & (valid_to.isNull() | (at < valid_to))


def was_known_at(recorded_at: Column, superseded_at: Column, at: Column) -> Column:
    """Superseded but never recorded was never known; nothing set was always known."""
    return F.when(recorded_at.isNull() & superseded_at.isNotNull(), False).otherwise(is_active_at(recorded_at, superseded_at, at))


def overlaps(from_a: Column, to_a: Column, from_b: Column, to_b: Column) -> Column:
    """Two half-open intervals share a moment; null bounds are open."""
    return (from_a.isNull() | to_b.isNull() | (from_a < to_b)) & (from_b.isNull() | to_a.isNull() | (from_b < to_a))


def bitemporal_issues(valid_from: Column, valid_to: Column, recorded_at: Column, superseded_at: Column) -> Column:
    """At most three issues, in this order."""
    return F.array_compact(F.array(
        F.when(valid_from >= valid_to, "valid_range_inverted"),
        F.when(recorded_at >= superseded_at, "knowledge_range_inverted"),
        F.when(recorded_at < valid_from, "recorded_before_valid"),
    ))


def edge_resolution(old_valid: Column, old_invalid: Column, new_valid: Column, new_invalid: Column) -> Column:
    """What a new edge does to an old one of the same ends and type; the first rule that holds."""
    return (
        F.when(old_invalid <= new_valid, "skip_old_already_invalid")
        .when(new_invalid <= old_valid, "skip_new_was_invalid")
        .when(old_valid < new_valid, "supersede")
        .otherwise("retain_both")
    )


def backoff_seconds(retries: Column) -> Column:
    """A day, times three for each retry, at most thirty days."""
    return F.least(F.lit(float(DAY)) * F.pow(F.lit(3.0), retries.cast("double")), F.lit(float(MAX_DELAY))).cast("long")


def edge_active(at: Column, valid_at: Column, invalid_at: Column, retroactive_to: Column) -> Column:
    """Whether an edge holds at a time, from its start or the earlier one it was extended to; without an end it goes on."""
    return F.coalesce((F.coalesce(retroactive_to, valid_at) <= at) & (invalid_at.isNull() | (at < invalid_at)), F.lit(False))
