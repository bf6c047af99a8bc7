"""Evaluation of detectors against labels, and summaries of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.session import keys_of


def evaluate(df: DataFrame, label: Column, predicted: Column, key=()) -> DataFrame:
    """TP, TN, FP, FN and the rates derived from them, with guarded divisors."""
    keys = keys_of(key)
    truth, guess = F.coalesce(label, F.lit(False)), F.coalesce(predicted, F.lit(False))
    marked = df.select(*keys, truth.alias("t"), guess.alias("p"))
    counts = [
        F.count_if(F.col("t") & F.col("p")).alias("tp"),
        F.count_if(~F.col("t") & ~F.col("p")).alias("tn"),
        F.count_if(~F.col("t") & F.col("p")).alias("fp"),
        F.count_if(F.col("t") & ~F.col("p")).alias("fn"),
    ]
    c = marked.groupBy(*keys).agg(*counts) if keys else marked.agg(*counts)
    one = F.lit(1).cast("long")

    def rate(part: str, other: str) -> Column:
        return F.col(part) / F.greatest(F.col(part) + F.col(other), one)

    c = c.withColumns({"precision": rate("tp", "fp"), "recall": rate("tp", "fn")})
    both = F.col("precision") + F.col("recall")
    return c.withColumns(
        {
            "f1": F.round(2 * F.col("precision") * F.col("recall") / F.greatest(both, F.lit(0.001)), 6),
            "fpr": F.round(rate("fp", "tn"), 6),
            "fnr": F.round(rate("fn", "tp"), 6),
            "precision": F.round("precision", 6),
            "recall": F.round("recall", 6),
        }
    )


def result_summary(df: DataFrame, category: str, passed: Column, millis: Column) -> DataFrame:
    """Passed, failed, total and mean time per category."""
    return df.groupBy(category).agg(
        F.count_if(passed).alias("passed"),
        F.count_if(~passed).alias("failed"),
        F.sum(millis).alias("total_ms"),
        F.avg(millis).alias("mean_ms"),
    )


def slowest(df: DataFrame, category: str, millis: str, tie: str, n: int) -> DataFrame:
    """The ``n`` slowest rows of each category."""
    order = Window.partitionBy(category).orderBy(F.desc(millis), tie)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
