"""Helpers of this package: stored intermediates, word splitting, prefix sums, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from driftwatch.session import checkpoint_dir, read_bytes

# A word is a run of anything but ASCII white space, as in bytes.split().
SPACES = r"[\x20\x09-\x0D]+"
BITMAP_BITS = 1 << 26
# What a task that writes an intermediate result reads, if there are tasks enough for all cores.
WRITE_BYTES = 8 * 1024 * 1024
# Edges that a task joins at a time.
EDGES_IN_TASK = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, never a recomputation.
    A small result of many partitions is written by few tasks, as every file
    costs its own processes and requests.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    tasks = max(2 * spark.sparkContext.defaultParallelism, ceil(read_bytes(df) / WRITE_BYTES))
    df.coalesce(min(tasks, 2**31 - 1)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Delete the files of frames made by :func:`stored` that nothing will read again."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            if path.getName().startswith("llm-"):
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def marks(ids: DataFrame, id_col: str = "id") -> DataFrame:
    """(_bucket, _bits): a bitmap of the hashes of the ids, of 8 MB at most however many they are."""
    at = _mark(id_col)
    return ids.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits")
    )


def perhaps_in(df: DataFrame, bitmap: DataFrame, id_col: str = "id", how: str = "left_semi") -> DataFrame:
    """The rows whose id has its hash in ``bitmap``, or with ``left_anti`` the others, without a shuffle.

    Every row with one of the bitmap's ids is among the former, and some more:
    an exact join must follow, which then shuffles few rows in vain. With very
    many ids the bitmap is full and only that join is left.
    """
    place = F.bitmap_bit_position(_mark(id_col))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.getbit(byte, (place % 8).cast("int")) == 1
    return df.join(F.broadcast(bitmap), (F.bitmap_bucket_number(_mark(id_col)) == F.col("_bucket")) & there, how)


def _mark(id_col: str) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(BITMAP_BITS)) + 1


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def map_batches(df: DataFrame, rows_of: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """One output batch for each Arrow batch; nothing is kept between batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield rows_of(batch)

    return df.mapInArrow(run, schema)


def words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case; none for a null text."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def power_of_two(n: float, least: int, most: int) -> int:
    size = least
    while size < n and size < most:
        size *= 2
    return size


def running_totals(
    df: DataFrame, group: str, order: list[str], amount: str, into: str, buckets: int
) -> DataFrame:
    """Add ``into``: the sum of ``amount`` over the earlier rows of the group.

    Rows of a group are ordered by the hash of ``order``, ties by the columns
    themselves. A group never meets in one task: it is cut into ``buckets``
    hash ranges, whose totals are summed ahead in a table of one row for each
    group and bucket. ``df`` should be stored or cheap, as it is read twice.
    """
    hashed = df.withColumn("_h", F.xxhash64(*order)).withColumn(
        "_b", F.shiftrightunsigned("_h", 64 - (buckets.bit_length() - 1)).cast("int") if buckets > 1 else F.lit(0)
    )
    # unsigned order of the hash, so that buckets and rows are ordered alike
    hashed = hashed.withColumn("_h", F.col("_h").bitwiseXOR(F.lit(-(2**63))))
    ahead = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        hashed.groupBy(group, "_b")
        .agg(F.sum(amount).alias("_t"))
        .select(F.col(group).alias("_g"), F.col("_b").alias("_gb"), F.coalesce(F.sum("_t").over(ahead), F.lit(0)).alias("_a"))
    )
    own = Window.partitionBy(group, "_b").orderBy("_h", *order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        hashed.withColumn("_o", F.coalesce(F.sum(amount).over(own), F.lit(0)))
        .join(before, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_gb")))
        .withColumn(into, F.col("_a") + F.col("_o"))
        .drop("_h", "_b", "_o", "_g", "_gb", "_a")
    )


def _forests(edges: DataFrame, most: int, roots: bool) -> DataFrame:
    """Edges (u, v) that connect what ``edges`` do: of every ``most`` of a task each id points at the smallest one it reaches by them.

    With ``roots`` those point at themselves.
    """
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}
        held = 0

        def root(x):
            while x in up:
                above = up[x]
                up[x] = up.get(above, above)
                x = above
            return x

        def out() -> pa.RecordBatch:
            found = [(x, root(x)) for x in up]
            if roots:
                found += [(x, x) for x in {v for _, v in found}]
            return pa.RecordBatch.from_arrays([pa.array(x, batch.schema.types[0]) for x in zip(*found)], ["u", "v"])

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                u, v = root(u), root(v)
                if u != v:
                    up[max(u, v)] = min(u, v)
            held += batch.num_rows
            if held >= most and up:
                yield out()
                up.clear()
                held = 0
        if up:
            yield out()

    return edges.mapInArrow(run, f"u {kind}, v {kind}")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", in_task: int = 0) -> DataFrame:
    """(id, component_id) of every endpoint; component_id is the smallest id reachable.

    Alternating large and small stars: each round points the larger neighbours
    of a node, then the smaller ones, at its smallest neighbour. A hub is only
    ever the key of a minimum (combined before the shuffle) and of a join (which
    Spark can split). Rounds end when the edges no longer change; ids of any
    orderable type will do. Self-links and links with a null end are ignored.

    With ``in_task``, tasks join that many edges at a time in Python before each
    round, if ids are whole numbers or strings. So many edges in all are joined
    by one task, without a round and its shuffles.
    """
    in_task *= isinstance(edges.schema[a].dataType, (IntegralType, StringType)) and edges.schema[a].dataType == edges.schema[b].dataType
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = stored(pairs if in_task else pairs.distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(now)
    while seen[0]:
        if in_task:
            last = seen[0] <= in_task
            joined = stored(_forests(now.coalesce(ceil(seen[0] / in_task)), in_task, last))
            forget(now)
            now = joined
            if last:
                return now.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("m", "u").alias("m"))
        large = (
            both.where(F.col("v") > F.col("u"))
            .join(low, F.col("u") == F.col("w"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        turned = (
            large.join(low, F.col("u") == F.col("w"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where(F.col("u") != F.col("v"))
        )
        after = stored(turned.unionByName(low.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct())
        forget(now)
        now, before, seen = after, seen, mark(after)
        if seen == before:
            break
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component_id"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(roots.distinct())
