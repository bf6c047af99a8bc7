"""Session helpers: a configured session, the shared checkpoint folder, and
the size-checked broadcast used by every join with a side of unknown size."""

from __future__ import annotations

import tempfile
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when it was counted and has at most this many rows.
BROADCAST_ROWS = 100_000


def get_spark(app: str = "driftwatch", cores: str = "*", **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        # call sites of every Column call are costly to record for large expressions
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for name, value in conf.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A folder of our own is made only for a local master that names none; on a
    cluster executors could not see it, so there that is an error.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="driftwatch-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Run ``df`` once and cut its lineage with a reliable checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Materialize a small side and broadcast it if its row count allows.

    Above the bound the frame is returned unhinted, so the join shuffles and
    the adaptive skew join splits hot keys.
    """
    stored = materialize(df)
    if stored.count() <= rows:
        return F.broadcast(stored)
    return stored


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of the rows; runs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def read_bytes(df: DataFrame) -> int:
    """The size of all inputs of the rows, each as often as it is read; runs no job."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def spread(df: DataFrame) -> DataFrame:
    """Gives a small input to all cores before CPU-heavy row work.

    An input that fills less than half of the cores with file splits (say one
    file with one row group) is dealt out round-robin. A larger one keeps its
    splits and is not shuffled.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores) if estimated_bytes(df) < split * cores / 2 else df


def null_safe_join(left: DataFrame, right: DataFrame, key, how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet each other; the key columns appear once."""
    keys = keys_of(key)
    side = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    both = left.join(side, same, how)
    if how in ("left_semi", "left_anti"):
        return both
    if how == "full_outer":
        both = both.withColumns({k: F.coalesce(k, f"_right_{k}") for k in keys})
    return both.drop(*[f"_right_{k}" for k in keys])


def keys_of(key: str | list[str] | tuple[str, ...]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)
