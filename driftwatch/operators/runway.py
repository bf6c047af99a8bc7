"""Write-rate windows, their trend, and the time until sizes turn critical."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.functions import scores
from driftwatch.session import bounded, keys_of, null_safe_join

# Windows looked at, fewest windows trusted, defaults of a key
# without a baseline.
WINDOWS, MIN_WINDOWS = 6, 3
DEFAULT_MEAN, DEFAULT_STDDEV = 1024.0, 512.0


def write_stats(df: DataFrame, key, ts: str, size: Column, width: str = "60 seconds") -> DataFrame:
    """Tumbling windows with event count, mean and largest size per key."""
    keys = keys_of(key)
    return (
        df.select(*keys, F.window(F.col(ts), width).alias("w"), size.alias("bytes"))
        .groupBy(*keys, "w")
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.avg("bytes").alias("mean_bytes"),
            F.max("bytes").alias("max_bytes"),
        )
        .select(
            *keys,
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "event_count",
            "mean_bytes",
            "max_bytes",
            F.col("event_count").alias("current_rate_per_min"),
            (F.col("mean_bytes") / 1024).alias("avg_doc_size_kb"),
            (F.col("max_bytes") / 1024).alias("max_doc_size_kb"),
        )
    )


def recent_counts(
    df: DataFrame, key, ts: str, as_of: Column, windows: int = WINDOWS, names: DataFrame | None = None
) -> DataFrame:
    """Events in each of the last hours before ``as_of``; empty hours are 0.

    Window ``i`` is ``[as_of - (i + 1) h, as_of - i h)``. One aggregate counts
    all windows, so no window or key is missing and nothing is joined. Keys come
    from ``df``; if ``names`` lists them, only the last hours of ``df`` are read.
    """
    keys = keys_of(key)
    df = df.select(*keys, ts)
    if names is not None:
        recent = df.filter(F.col(ts) >= as_of - F.expr(f"INTERVAL {windows} HOURS"))
        df = recent.unionByName(names.select(*keys).distinct().withColumn(ts, F.lit(None).cast(df.schema[ts].dataType)))
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    slot = F.ceil(age / F.lit(3_600_000_000)) - 1
    counted = df.select(*keys, slot.alias("slot")).groupBy(*keys).agg(
        *[F.count_if(F.col("slot") == i).alias(f"_{i}") for i in range(windows)]
    )
    counts = F.array(*[F.col(f"_{i}") for i in range(windows)])
    return counted.select(*keys, F.posexplode(counts).alias("i", "event_count")).select(
        *keys,
        "event_count",
        F.round(F.col("event_count") / 60, 4).alias("current_rate_per_min"),
        F.lit(0.0).alias("avg_doc_size_kb"),
        (as_of - F.make_dt_interval(hours=F.col("i"))).alias("window_end"),
    )


def trend_slopes(stats: DataFrame, key, rate: str = "event_count", windows: int = WINDOWS) -> DataFrame:
    """Least-squares slope per window step over the newest windows of a key."""
    keys = keys_of(key)
    newest = Window.partitionBy(*keys).orderBy(F.desc("window_end"))
    ranked = stats.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= windows)
    # sums of whole numbers are exact, so a flat rate has slope 0 and no noise
    x, y = -F.col("rn").cast("double"), F.col(rate).cast("double")
    n, sx, sy = F.count(F.lit(1)), F.sum(x), F.sum(y)
    spread = n * F.sum(x * x) - sx * sx
    return ranked.groupBy(*keys).agg(
        n.alias("n_windows"),
        F.when(spread != 0, (n * F.sum(x * y) - sx * sy) / spread).otherwise(F.lit(0.0)).alias("slope"),
        F.max(F.when(F.col("rn") == 1, F.col("event_count"))).cast("double").alias("current_rate"),
        F.max(F.when(F.col("rn") == 1, F.col("avg_doc_size_kb"))).alias("current_size_kb"),
    )


def runway(
    stats: DataFrame, baseline: DataFrame, key, as_of: Column, fallback: DataFrame | None = None,
    metric: str = "rate", strict: bool = False,
) -> DataFrame:
    """Trend and minutes to critical per key.

    ``fallback`` (from :func:`recent_counts`) replaces the windows of keys
    with fewer than three. ``metric='rate'`` divides the size gap by the slope
    of the event rate; ``'size'`` uses the slope of the mean size instead.
    ``strict`` reports a fallback without any event as insufficient. Windows
    that end after ``as_of`` do not count.
    """
    keys = keys_of(key)
    rate = "event_count" if metric == "rate" else "avg_doc_size_kb"
    stats = stats.filter(F.col("window_end") <= as_of)
    slopes = trend_slopes(stats, keys, rate)
    if fallback is not None:
        good = slopes.filter(F.col("n_windows") >= MIN_WINDOWS)
        spare = null_safe_join(fallback, good.select(*keys), keys, "left_anti")
        replaced = trend_slopes(spare, keys, rate)
        if strict:
            alive = spare.groupBy(*keys).agg(F.sum("event_count").alias("n")).filter("n > 0").select(*keys)
            replaced = null_safe_join(replaced, alive, keys, "left_semi")
        few = null_safe_join(slopes.filter(F.col("n_windows") < MIN_WINDOWS), replaced.select(*keys), keys, "left_anti")
        slopes = good.unionByName(replaced).unionByName(few)
    side = bounded(baseline.select(*keys, F.col("mean_bytes").alias("_mean"), F.col("stddev_bytes").alias("_sd")))
    joined = null_safe_join(slopes, side, keys, "left")
    slope, current = F.col("slope"), F.col("current_rate")
    spread = F.greatest(F.coalesce(F.when(F.col("_sd") != 0, F.col("_sd")), F.lit(DEFAULT_STDDEV)), F.lit(1.0))
    critical_kb = (F.coalesce("_mean", F.lit(DEFAULT_MEAN)) + scores.CRITICAL_Z * spread) / 1024
    gap = critical_kb - F.coalesce("current_size_kb", F.lit(0.0))
    enough = F.col("n_windows") >= MIN_WINDOWS
    minutes = F.when(enough & (slope > 0) & (current > 0) & (gap > 0), F.round(gap / slope, 1))
    confidence = F.least(
        F.lit(0.95), 0.3 + F.col("n_windows") * 0.1 + F.when(slope != 0, F.lit(0.3)).otherwise(F.lit(0.0))
    )
    out = joined.withColumn("minutes_to_critical", minutes)
    left = F.col("minutes_to_critical")
    micros = (left * 60_000_000).cast("long")
    return out.select(
        *keys,
        F.when(enough, F.round(current, 2)).otherwise(F.lit(0.0)).alias("current_rate_per_min"),
        F.timestamp_micros(F.unix_micros(as_of.cast("timestamp")) + micros).alias("projected_critical_at"),
        "minutes_to_critical",
        F.when(enough, scores.trend(slope)).otherwise(F.lit("stable")).alias("trend"),
        F.when(enough, F.round(confidence, 2)).otherwise(F.lit(0.1)).alias("confidence"),
        F.when(enough, scores.runway_status(left)).otherwise(F.lit("insufficient_data")).alias("status"),
        F.round(F.when(enough, slope), 6).alias("slope"),
        F.round(scores.runway_fill(left), 6).alias("fill_pct"),
    )
