"""Two sinks for one stream: rows in time go to an accepted table, all others to the dead letters.

Every batch leaves three folders under a base folder, each named by the batch:
``accepted``, ``dead`` and a one-row ``ledger`` with its counts and the newest
event time so far. A folder is written aside and renamed into place once, so a
batch that is repeated after a failure adds nothing, and a reader never sees
half of it. The accepted table is itself the source of further streams, whose
watermark can drop none of its rows: a row is accepted only if it is newer than
the newest event of all earlier batches less the delay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.sources import tables

WATERMARK = "5 minutes"
LATE = ("LateEvent", "event is older than the watermark")
NO_TIME = ("NullEventTime", "event has no time")
# Number of the closing batch, after all others.
CLOSING = 999_999_999


def _batch(base: str, kind: str, number: int) -> str:
    return f"{base}/{kind}/batch={number:09d}"


def _numbers(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the batches in the ledger."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = hadoop(f"{base}/ledger")
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    names = [s.getPath().getName() for s in files.listStatus(root)]
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def ledger(spark: SparkSession, base: str) -> DataFrame:
    """(batch, accepted, dead, newest) of the finished batches."""
    return spark.read.parquet(f"{base}/ledger")


def _newest(spark: SparkSession, base: str, before: int):
    done = [n for n in _numbers(spark, base) if n < before]
    return spark.read.parquet(_batch(base, "ledger", done[-1])).first()["newest"] if done else None


def route_batches(base: str, ts: str, error: Column | None = None, watermark: str = WATERMARK) -> Callable[[DataFrame, int], None]:
    """Batch writer with two sinks and a ledger.

    A row is a dead letter if ``error`` (null for good rows, else a struct of
    error_type and error_message) says so, if its time is null, or if it is not
    newer than the newest accepted time of earlier batches less ``watermark``.
    A bad row costs itself only; the batch goes on.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if tables.table_exists(spark, _batch(base, "ledger", number)):
            return
        newest = _newest(spark, base, number)
        moment = F.col(ts).cast("timestamp")
        late = F.lit(False) if newest is None else moment <= F.lit(newest) - F.expr(f"INTERVAL {watermark}")

        def fault(kind: tuple[str, str]) -> Column:
            return F.struct(F.lit(kind[0]).alias("error_type"), F.lit(kind[1]).alias("error_message"))

        reason = F.when(moment.isNull(), fault(NO_TIME)).when(late, fault(LATE))
        rows = batch.persist()
        good, bad = tables.split_dead_letter(rows, reason if error is None else F.coalesce(error, reason), F.current_timestamp())
        tables.write_once(good, _batch(base, "accepted", number))
        tables.write_once(bad, _batch(base, "dead", number))
        rows.unpersist()
        # what was written counts, also if an earlier try wrote it
        kept = spark.read.schema(batch.schema).parquet(_batch(base, "accepted", number))
        dead = spark.read.schema(bad.schema).parquet(_batch(base, "dead", number)).count()
        total = kept.agg(F.count(F.lit(1)).alias("accepted"), F.lit(dead).cast("long").alias("dead"), F.greatest(F.max(moment), F.lit(newest).cast("timestamp")).alias("newest"))
        tables.write_once(total.coalesce(1), _batch(base, "ledger", number))

    return write


def close_stream(spark: SparkSession, base: str, schema, ts: str, after: str = "1 hour", watermark: str = WATERMARK) -> None:
    """Adds a last row without values, newer than everything, so that all windows and buffers of readers close.

    It is timed ``after`` plus the watermark past the newest accepted event.
    Events that come later than this are late; only a stream that has ended is closed.
    """
    newest = _newest(spark, base, CLOSING)
    if newest is None:
        return
    columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name != ts]
    at = F.lit(newest) + F.expr(f"INTERVAL {watermark}") + F.expr(f"INTERVAL {after}")
    kind = next(f.dataType for f in schema if f.name == ts)
    row = spark.range(1).coalesce(1).select(*columns, at.cast(kind).alias(ts)).select(*[f.name for f in schema])
    tables.write_once(row, _batch(base, "accepted", CLOSING))


def accepted_stream(spark: SparkSession, base: str, schema, ts: str, row_id: str, watermark: str = WATERMARK) -> DataFrame:
    """The accepted rows as a stream with a watermark on ``ts``.

    ``row_id`` is a column that no accepted row lacks; the closing row has
    none and moves the watermark only. All finished batches are taken at a
    trigger: a batch must not be split between two, or its older rows could be
    late for its newer ones.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = hadoop(f"{base}/accepted")
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(root)
    rows = spark.readStream.schema(schema).parquet(f"{base}/accepted/batch=*")
    timed = rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    # names the time, so that it is not pushed below the watermark
    return timed.where(F.col(row_id).isNotNull() | F.col(ts).isNull())


def dead_letters(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(f"{base}/dead").drop("batch")
