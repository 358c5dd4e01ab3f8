"""Timestamps, ages and windows, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.sources.ledger import age


def parse_iso(text: Column) -> Column:
    """A timestamp of ISO text with Z, an offset or none (UTC); null where it is none."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), r"([0-9])[zZ]$", "$1+00:00"))


def to_iso(when: Column) -> Column:
    """ISO text in UTC with Z, to the second."""
    return F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def cursor_age(now: Column, updated: Column) -> Column:
    """Seconds since a cursor moved, at least 0; infinite for one that never did."""
    return F.when(updated.isNull(), F.lit(float("inf"))).otherwise(F.greatest(F.lit(0.0), age(now, updated)))
