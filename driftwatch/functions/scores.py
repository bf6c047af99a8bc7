"""Scalar scoring rules: thresholds, statuses, confidences, unit changes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Detection thresholds.
ANOMALY_Z = 2.0
CRITICAL_Z = 3.5
SPIKE_Z = 3.0
ELEVATED_Z = 1.5
CUMULATIVE_LIMIT = 0.8
CUMULATIVE_WINDOW = 6
CUMULATIVE_MIN_POINTS = 3
TREND_SLOPE = 0.5
IMMINENT_MINUTES = 30
WARNING_MINUTES = 120
RUNWAY_BAR_MINUTES = 240


def kilobytes(x: Column, places: int = 2) -> Column:
    return F.round(x / 1024, places)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def normalize(x: Column, low: float, high: float) -> Column:
    return clamp01((x - low) / (high - low))


def severity(z: Column) -> Column:
    return F.when(F.abs(z) >= CRITICAL_Z, F.lit("CRITICAL")).otherwise(F.lit("WARNING"))


def z_confidence(z: Column) -> Column:
    return F.least(F.lit(1.0), F.abs(z) / 10.0)


def velocity_status(z: Column, cumulative_alert: Column) -> Column:
    return (
        F.when(z > SPIKE_Z, F.lit("spike"))
        .when(cumulative_alert, F.lit("cumulative_drift"))
        .when(z > ELEVATED_Z, F.lit("elevated"))
        .otherwise(F.lit("normal"))
    )


def trend(slope: Column) -> Column:
    return (
        F.when(slope > TREND_SLOPE, F.lit("increasing"))
        .when(slope < -TREND_SLOPE, F.lit("decreasing"))
        .otherwise(F.lit("stable"))
    )


def runway_status(minutes: Column) -> Column:
    """Zero or missing minutes count as no forecast, hence NORMAL."""
    known = minutes.isNotNull() & (minutes != 0)
    return (
        F.when(known & (minutes < IMMINENT_MINUTES), F.lit("CRITICAL_IMMINENT"))
        .when(known & (minutes < WARNING_MINUTES), F.lit("WARNING"))
        .otherwise(F.lit("NORMAL"))
    )


def runway_fill(minutes: Column) -> Column:
    """Share of the runway bar that is used up, 0 to 100."""
    full = float(RUNWAY_BAR_MINUTES)
    left = F.coalesce(minutes, F.lit(full))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), (full - left) / full * 100))


def hour_key(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def resolution_minutes(similar: Column, first_option: Column) -> Column:
    """Past incident's time if positive, else the first option's, else 30."""
    return F.coalesce(
        F.when(similar > 0, similar.cast("int")), F.when(first_option > 0, first_option.cast("int")), F.lit(30)
    )
