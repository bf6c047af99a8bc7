"""Semantic velocity: how fast the hourly mean embedding of a key moves.

Vectors are averaged per (key, hour, position), so raw vectors never travel
further than their map task and a hot key or hour is combined before the
shuffle. All later steps see one row per key and hour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.functions import scores
from driftwatch.functions.vectors import unit, unit_cosine_distance
from driftwatch.operators.evaluate import evaluate
from driftwatch.session import bounded, keys_of, null_safe_join

# Smallest deviation and mean used as divisors, newest rows and
# bucket size of the cold-start fallback.
FLOOR = 1e-7
RECENT_ROWS, RECENT_BUCKET = 60, 8


def partial_sums(df: DataFrame, key, ts: str, emb: str) -> DataFrame:
    """(key, hour, pos, total, n): sums and counts by vector position, which any two loads can add up."""
    keys = keys_of(key)
    usable = df.filter(F.col(ts).isNotNull() & (F.size(F.coalesce(F.col(emb), F.array())) > 0))
    placed = usable.select(*keys, scores.hour_key(F.col(ts)).alias("hour"), F.posexplode(emb).alias("pos", "x"))
    return placed.groupBy(*keys, "hour", "pos").agg(F.sum(F.col("x").cast("double")).alias("total"), F.count(F.lit(1)).alias("n"))


def hourly_centroids(df: DataFrame, key, ts: str, emb: str) -> DataFrame:
    """Unit mean vector per (key, hour); vectors of unequal length fail.

    Components are summed by (key, hour, position) in generated code and
    combined on the map side. Only the means are put together again, one per
    dimension and hour.
    """
    return centroids_of_sums(partial_sums(df, key, ts, emb), key)


def centroids_of_sums(sums: DataFrame, key) -> DataFrame:
    """Unit mean vectors from the rows of :func:`partial_sums`."""
    keys = keys_of(key)
    # every vector has a first position, so counts differ only if lengths do
    same = F.min("n") == F.max("n")
    mean = F.struct("pos", (F.col("total") / F.col("n")).alias("m"))
    return (
        sums.groupBy(*keys, "hour")
        .agg(
            F.when(same, F.max("n"))
            .otherwise(F.raise_error(F.lit("vectors of unequal length within an hour")).cast("long"))
            .alias("docs"),
            F.transform(F.array_sort(F.collect_list(mean)), lambda c: c["m"]).alias("mean"),
        )
        .select(*keys, "hour", "docs", unit(F.col("mean")).alias("centroid"))
    )


def centroid_distances(centroids: DataFrame, key) -> DataFrame:
    """Distance of each hour to the previous present hour of its key.

    The first hour of a key has no distance. The window sees one row per hour,
    so its length is the time span, not the data.
    """
    keys = keys_of(key)
    order = Window.partitionBy(*keys).orderBy("hour")
    return (
        centroids.withColumn("previous", F.lag("centroid").over(order))
        .withColumn("distance", F.when(F.col("previous").isNotNull(), unit_cosine_distance(F.col("previous"), F.col("centroid"))))
        .select(*keys, "hour", "docs", "distance")
    )


def velocity_report(distances: DataFrame, key, hours: int, total_docs: str = "docs") -> DataFrame:
    """Velocity of the last hour of each key against its earlier hours."""
    keys = keys_of(key)
    gathered = distances.groupBy(*keys).agg(
        F.sum(total_docs).alias("n_docs"),
        F.count(F.lit(1)).alias("n_hours"),
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("distance").isNotNull(), F.struct("hour", "distance")))),
            lambda x: x["distance"],
        ).alias("d"),
    )
    d = F.col("d")
    n = F.size(d)
    current = F.try_element_at(d, F.lit(-1))
    history = F.slice(d, 1, F.greatest(n - 1, F.lit(0)))
    recent = F.slice(d, F.greatest(n - scores.CUMULATIVE_WINDOW + 1, F.lit(1)), scores.CUMULATIVE_WINDOW)

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)

    staged = (
        gathered.withColumns({"current": current, "h": history, "r": recent})
        .withColumn("avg", F.when(F.size("h") > 0, total(F.col("h")) / F.size("h")).otherwise(F.col("current")))
        .withColumn(
            "std",
            F.when(
                F.size("h") > 1,
                F.sqrt(
                    F.aggregate(
                        "h", F.lit(0.0), lambda a, x: a + (x - F.col("avg")) * (x - F.col("avg"))
                    ) / F.size("h")
                ),
            ).otherwise(F.lit(FLOOR)),
        )
        .withColumn("z", (F.col("current") - F.col("avg")) / F.greatest("std", F.lit(FLOOR)))
        .withColumn("ratio", F.col("current") / F.greatest("avg", F.lit(FLOOR)))
        .withColumn("drift", total(F.col("r")))
        .withColumn(
            "alert",
            (F.col("drift") > scores.CUMULATIVE_LIMIT) & (F.size("r") >= scores.CUMULATIVE_MIN_POINTS),
        )
    )
    known = (F.col("n_docs") >= 2) & (F.col("n_hours") >= 2)
    status = F.when(known, scores.velocity_status(F.col("z"), F.col("alert"))).otherwise(F.lit("insufficient_data"))

    def value(name: str, places: int, otherwise: float) -> Column:
        return F.when(known, F.round(name, places)).otherwise(F.lit(otherwise))

    name = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    text = F.format_string(
        "SEMANTIC SPIKE in '%s': centroid shifted %.4f cosine units this hour (Z=%.1f vs historical avg %.4f). "
        "Documents no longer semantically similar to historical norm. "
        "Possible: data source contamination, pipeline mixing, or domain change.",
        name, F.col("current"), F.col("z"), F.col("avg"),
    )
    return staged.withColumn("status", status).select(
        *keys,
        value("current", 6, 0.0).alias("centroid_distance"),
        value("avg", 6, 0.0).alias("baseline_distance"),
        value("ratio", 3, 1.0).alias("velocity_ratio"),
        value("z", 2, 0.0).alias("velocity_zscore"),
        value("drift", 6, 0.0).alias("cumulative_drift"),
        F.when(known, F.col("alert")).otherwise(F.lit(False)).alias("cumulative_alert"),
        "status",
        F.when(known, F.col("d")).otherwise(F.array().cast("array<double>")).alias("hourly_distances"),
        F.lit(hours).alias("window_hours"),
        (F.col("status") == "spike").alias("spike_detected"),
        F.when(F.col("status") == "spike", text).alias("interpretation"),
    )


def semantic_velocity(
    df: DataFrame, key, ts: str, emb: str, as_of: Column, hours: int = 8, history: DataFrame | None = None,
    fallback: str | None = None,
) -> DataFrame:
    """Velocity per key over the rows of the last ``hours`` before ``as_of``.

    With ``history`` the rows come from :func:`velocity_input`.
    """
    keys = keys_of(key)
    if history is not None:
        rows = velocity_input(df, history, keys, ts, emb, as_of, hours, fallback)
    else:
        rows = _lookback(df, ts, as_of, hours)
    return velocity_report(centroid_distances(hourly_centroids(rows, keys, ts, emb), keys), keys, hours)


def _lookback(df: DataFrame, ts: str, as_of: Column, hours: int) -> DataFrame:
    return df.filter((F.col(ts) >= as_of - F.expr(f"INTERVAL {hours} HOURS")) & (F.col(ts) <= as_of))


def velocity_input(
    live: DataFrame, history: DataFrame, key, ts: str, emb: str, as_of: Column, hours: int = 8,
    fallback: str | None = None,
) -> DataFrame:
    """Rows (key, ts, emb): live rows, topped up from history where sparse.

    Keys with fewer than two live rows also take their history rows of the
    same period. With ``fallback='recent'``, keys that still have fewer than
    two take their newest 60 history rows, in synthetic hours of eight rows.
    """
    keys = keys_of(key)
    columns = [*keys, ts, emb]

    def usable(df: DataFrame) -> DataFrame:
        return df.filter(F.col(emb).isNotNull()).select(*columns)

    def rich(df: DataFrame) -> DataFrame:
        return bounded(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select(*keys))

    now = _lookback(usable(live), ts, as_of, hours)
    past = _lookback(usable(history), ts, as_of, hours)
    rows = now.unionByName(null_safe_join(past, rich(now), keys, "left_anti"))
    if fallback != "recent":
        return rows
    enough = rich(rows)
    newest = Window.partitionBy(*keys).orderBy(F.desc(ts), F.xxhash64(emb))
    synthetic = (
        null_safe_join(usable(history), enough, keys, "left_anti")
        .withColumn("rn", F.row_number().over(newest))
        .filter(F.col("rn") <= RECENT_ROWS)
        .withColumn(ts, as_of - F.make_dt_interval(hours=F.floor((F.col("rn") - 1) / RECENT_BUCKET).cast("int")))
        .select(*columns)
    )
    return null_safe_join(rows, enough, keys, "left_semi").unionByName(synthetic)


def series_zscores(df: DataFrame, key, value: str) -> DataFrame:
    """Adds the population z-score of each point within its whole series."""
    keys = keys_of(key)
    stats = bounded(df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd")))
    z = F.when(F.col("_sd") > 0, (F.col(value) - F.col("_mean")) / F.col("_sd")).otherwise(F.lit(0.0))
    return null_safe_join(df, stats, keys).withColumn("z", z).drop("_mean", "_sd")


def peak_zscore(df: DataFrame, key, order: str, value: str) -> DataFrame:
    """Largest absolute population z-score of each series and where it is.

    The farthest point from the mean is the minimum or the maximum, so one
    aggregate finds it without a second pass.
    """
    keys = keys_of(key)
    g = df.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("sd"),
        F.max(F.struct(F.col(value).alias("v"), (-F.col(order).cast("double")).alias("o"))).alias("top"),
        F.min(F.struct(F.col(value).alias("v"), F.col(order).cast("double").alias("o"))).alias("low"),
    )
    up, down = F.col("top.v") - F.col("mean"), F.col("mean") - F.col("low.v")
    first = (up > down) | ((up == down) & (-F.col("top.o") <= F.col("low.o")))
    z = F.when(F.col("sd") > 0, F.greatest(up, down) / F.col("sd")).otherwise(F.lit(0.0))
    return g.select(*keys, z.alias("peak_z"), F.when(first, -F.col("top.o")).otherwise(F.col("low.o")).alias("peak_at"))


def backtest_velocity(df: DataFrame, key, trial: str, label: str, ts: str, emb: str, as_of: Column, hours: int) -> DataFrame:
    """Alarm rates over labelled windows: one verdict per (key, trial)."""
    keys = [*keys_of(key), trial, label]
    verdicts = semantic_velocity(df, keys, ts, emb, as_of, hours)
    return evaluate(verdicts, F.col(label), F.col("spike_detected"), [])
