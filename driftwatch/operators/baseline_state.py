"""Size baselines on mergeable state: a refresh reads the new documents only.

Of each key the state keeps counts and sums, which merge exactly, and a KLL
sketch of the sizes, whose quantiles have a bounded rank error however many
loads were merged. The state is a bucketed table; a load carries a tag, so that
a repeated one adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.functions import scores
from driftwatch.functions.sizes import document_bytes
from driftwatch.session import keys_of
from driftwatch.sources import buckets

# Accuracy of the sketch, and the error of a rank it keeps to with 99 % confidence.
SKETCH_K, RANK_ERROR = 800, 0.005
QUANTILES = {"p50_bytes": 0.5, "p95_bytes": 0.95, "p99_bytes": 0.99}


def size_summaries(df: DataFrame, key, size: Column | None = None) -> DataFrame:
    """(key, sample_count, total, squares, min_bytes, max_bytes, sketch) of some documents; combined before the shuffle."""
    keys = keys_of(key)
    size = document_bytes(df) if size is None else size
    wide = F.col("bytes").cast("decimal(19,0)")
    return df.select(*keys, size.cast("bigint").alias("bytes")).where("bytes IS NOT NULL").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.sum(wide).cast("decimal(38,0)").alias("total"),
        F.sum((wide * wide).cast("decimal(38,0)")).cast("decimal(38,0)").alias("squares"),
        F.min("bytes").alias("min_bytes"),
        F.max("bytes").alias("max_bytes"),
        F.kll_sketch_agg_bigint("bytes", SKETCH_K).alias("sketch"),
    )


def add_documents(state: str, df: DataFrame, key, tag: int, size: Column | None = None, n_buckets: int = 16) -> bool:
    """Merges the documents of a load into the state; False if a load with this tag was merged before."""
    keys = keys_of(key)

    def merge(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.groupBy(*by, *keys).agg(
            F.sum("sample_count").alias("sample_count"),
            F.sum("total").cast("decimal(38,0)").alias("total"),
            F.sum("squares").cast("decimal(38,0)").alias("squares"),
            F.min("min_bytes").alias("min_bytes"),
            F.max("max_bytes").alias("max_bytes"),
            F.kll_merge_agg_bigint("sketch", SKETCH_K).alias("sketch"),
        )

    return buckets.merge_buckets(state, size_summaries(df, keys, size), keys, merge, tag, n_buckets)


def baseline_of_state(spark: SparkSession, state: str, key) -> DataFrame:
    """The full baseline of each key: as :func:`profile.size_baseline`, with sketched percentiles."""
    keys = keys_of(key)
    n, total = F.col("sample_count").cast("double"), F.col("total").cast("double")
    mean = total / n
    # n * squares - total ** 2 in decimals would need more than 38 digits
    spread = F.greatest(F.col("squares").cast("double") - total * mean, F.lit(0.0))
    rows = buckets.read_table(spark, state).withColumns(
        {"mean_bytes": mean, "stddev_bytes": F.when(F.col("sample_count") > 1, F.sqrt(spread / (n - 1)))}
    )
    return rows.select(
        *keys, "mean_bytes", "stddev_bytes", "sample_count", "min_bytes", "max_bytes",
        *[F.kll_sketch_get_quantile_bigint("sketch", F.lit(p)).alias(name) for name, p in QUANTILES.items()],
        (F.col("mean_bytes") + scores.ANOMALY_Z * F.col("stddev_bytes")).alias("warning_threshold_bytes"),
        (F.col("mean_bytes") + scores.CRITICAL_Z * F.col("stddev_bytes")).alias("critical_threshold_bytes"),
    )
