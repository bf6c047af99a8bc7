"""Profiles of keyed document tables: sizes, percentiles, fields, health.

``key`` names the grouping columns (one table, source or tenant per value).
Every profile is one job for all keys. Aggregates combine on the map side, so
a key that holds a third of the rows costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwatch.functions.scores import ANOMALY_Z, CRITICAL_Z, kilobytes
from driftwatch.functions.sizes import document_bytes
from driftwatch.session import keys_of, null_safe_join

# Buckets keep the leading bits of a value: at most 2**BUCKET_BITS per octave.
BUCKET_BITS = 10

# Type names as seen by a dynamic-language client and by a document store.
CLIENT_TYPES = {
    "STRING": "str",
    "BIGINT": "int",
    "DOUBLE": "float",
    "FLOAT": "float",
    "DECIMAL": "float",
    "BOOLEAN": "bool",
    "VOID": "NoneType",
    "ARRAY": "list",
    "OBJECT": "dict",
    "TIMESTAMP": "datetime",
    "TIMESTAMP_NTZ": "datetime",
    "DATE": "datetime",
    "BINARY": "bytes",
}
STORE_TYPES = {
    "STRING": "string",
    "BIGINT": "long",
    "DOUBLE": "double",
    "FLOAT": "double",
    "DECIMAL": "double",
    "BOOLEAN": "bool",
    "VOID": "null",
    "ARRAY": "array",
    "OBJECT": "object",
    "TIMESTAMP": "date",
    "TIMESTAMP_NTZ": "date",
    "DATE": "date",
    "BINARY": "binData",
}


# --- sizes and percentiles -------------------------------------------------


def size_histogram(df: DataFrame, key, size: Column | None = None) -> DataFrame:
    """Rows (key, bytes, n): one scan and one map-combined shuffle."""
    keys = keys_of(key)
    size = document_bytes(df) if size is None else size
    # the group of missing sizes counts 0; a filter on the size itself would be
    # pushed down and have every size computed twice
    return (
        df.select(*keys, size.cast("long").alias("bytes"))
        .groupBy(*keys, "bytes")
        .agg(F.count("bytes").alias("n"))
        .filter(F.col("n") > 0)
    )


def _bucket_low(value: Column) -> Column:
    """Lower bound of the bucket of a non-negative integer; order preserving."""
    bits = F.length(F.bin(value))
    drop = F.greatest(bits - F.lit(BUCKET_BITS), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def _coarse(hist: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per bucket: count, rank offset, and the key's total and mean.

    A key has a few thousand buckets at most, so the windows stay small.
    """
    v, low, n = F.col(value).cast("double"), F.col("low").cast("double"), F.col("n")
    per_key = Window.partitionBy(*keys)
    running = per_key.orderBy("low").rowsBetween(Window.unboundedPreceding, 0)
    return (
        hist.withColumn("low", _bucket_low(F.col(value)))
        .groupBy(*keys, "low")
        .agg(
            F.sum("n").alias("c"),
            F.sum(n * v).alias("s"),
            F.sum(n * (v - low)).alias("d1"),
            F.sum(n * (v - low) * (v - low)).alias("d2"),
            F.min(value).alias("least"),
            F.max(value).alias("most"),
        )
        .withColumn("before", F.sum("c").over(running) - F.col("c"))
        .withColumn("total", F.sum("c").over(per_key))
        .withColumn("mean", F.sum("s").over(per_key) / F.col("total"))
    )


def _percentiles(hist: DataFrame, coarse: DataFrame, keys: list[str], probs: list[float], value: str) -> DataFrame:
    wanted = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("total") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            wanted.append(
                F.struct(
                    F.lit(i).alias("i"), F.lit(side).alias("side"), rank.cast("long").alias("rank"), at.alias("at")
                )
            )
    hits = coarse.select(
        *keys,
        "low",
        "before",
        F.filter(
            F.array(*wanted),
            lambda w: (w["rank"] >= F.col("before")) & (w["rank"] < F.col("before") + F.col("c")),
        ).alias("ws"),
    ).filter(F.size("ws") > 0)
    by_value = Window.partitionBy(*keys, "low").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    found = (
        null_safe_join(hist.withColumn("low", _bucket_low(F.col(value))), hits, [*keys, "low"])
        .withColumn("upto", F.col("before") + F.sum("n").over(by_value))
        .select(
            *keys,
            F.col(value).cast("double").alias("v"),
            F.explode(
                F.filter(
                    F.col("ws"),
                    lambda w: (w["rank"] < F.col("upto")) & (w["rank"] >= F.col("upto") - F.col("n")),
                )
            ).alias("w"),
        )
    )
    outs = []
    for i in range(len(probs)):
        lo = F.max(F.when((F.col("w.i") == i) & (F.col("w.side") == "lo"), F.col("v")))
        hi = F.max(F.when((F.col("w.i") == i) & (F.col("w.side") == "hi"), F.col("v")))
        at = F.max(F.when(F.col("w.i") == i, F.col("w.at")))
        outs.append((lo + (hi - lo) * (at - F.floor(at))).alias(f"p{i}"))
    return found.groupBy(*keys).agg(*outs)


def histogram_percentiles(hist: DataFrame, key, probs: list[float], value: str = "bytes") -> DataFrame:
    """Exact interpolated percentiles p0, p1, … per key from (key, value, n).

    Two levels keep every window small whatever the skew: first ranks over
    buckets of leading bits (a few thousand per key at most), then ranks over
    the values of only those buckets that hold a wanted rank.
    """
    keys = keys_of(key)
    return _percentiles(hist, _coarse(hist, keys, value), keys, probs, value)


def _moments(coarse: DataFrame, keys: list[str]) -> DataFrame:
    """Count, mean, sample deviation and bounds, merged over the buckets.

    Deviations are summed around each bucket's lower bound and then moved to
    the mean, so nothing cancels when all sizes are alike.
    """
    shift = F.col("low") - F.col("mean")
    squares = F.sum(F.col("d2") + 2 * shift * F.col("d1") + F.col("c") * shift * shift)
    count = F.sum("c")
    return coarse.groupBy(*keys).agg(
        count.alias("sample_count"),
        F.max("mean").alias("mean_bytes"),
        F.when(count > 1, F.sqrt(F.greatest(squares, F.lit(0.0)) / (count - 1))).alias("stddev_bytes"),
        F.min("least").alias("min_bytes"),
        F.max("most").alias("max_bytes"),
    )


def size_baseline(df: DataFrame, key, size: Column | None = None, full: bool = False) -> DataFrame:
    """Mean, sample deviation and count of document sizes per key.

    ``full`` adds min, max, p50, p95, p99 and the two precomputed thresholds.
    All documents are read; nothing is sampled.
    """
    keys = keys_of(key)
    size = document_bytes(df) if size is None else size
    if not full:
        return (
            df.select(*keys, size.alias("bytes"))
            .groupBy(*keys)
            .agg(
                F.avg("bytes").alias("mean_bytes"),
                F.stddev_samp("bytes").alias("stddev_bytes"),
                F.count("bytes").alias("sample_count"),
            )
        )
    hist = size_histogram(df, keys, size)
    coarse = _coarse(hist, keys, "bytes")
    cuts = _percentiles(hist, coarse, keys, [0.5, 0.95, 0.99], "bytes")
    return (
        null_safe_join(_moments(coarse, keys), cuts, keys)
        .select(
            *keys,
            "mean_bytes",
            "stddev_bytes",
            "sample_count",
            F.col("p0").alias("p50_bytes"),
            F.col("p1").alias("p95_bytes"),
            F.col("p2").alias("p99_bytes"),
            "max_bytes",
            "min_bytes",
            (F.col("mean_bytes") + ANOMALY_Z * F.col("stddev_bytes")).alias("warning_threshold_bytes"),
            (F.col("mean_bytes") + CRITICAL_Z * F.col("stddev_bytes")).alias("critical_threshold_bytes"),
        )
    )


def size_stats(df: DataFrame, key, size: Column | None = None) -> DataFrame:
    """Mean and largest size in KB and the mean number of present fields."""
    keys = keys_of(key)
    size = document_bytes(df) if size is None else size
    present = sum((F.col(f"`{c}`").isNotNull().cast("int") for c in df.columns), F.lit(0))
    return (
        df.select(*keys, size.alias("bytes"), present.alias("fields"))
        .groupBy(*keys)
        .agg(
            F.round(F.avg(F.col("bytes") / 1024), 2).alias("mean_kb"),
            F.round(F.max(F.col("bytes") / 1024), 2).alias("max_kb"),
            F.avg("fields").alias("field_count"),
        )
    )


# --- fields and types ------------------------------------------------------


def _type_head(value: Column) -> Column:
    """First word of a variant's type, such as ARRAY or DECIMAL."""
    text = F.schema_of_variant(value)
    return F.substring_index(F.substring_index(text, "<", 1), "(", 1)


def _named(head: Column, names: dict[str, str]) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(mapping[head], F.lower(head))


def spark_type(data_type: T.DataType, names: dict[str, str]) -> str:
    """Type name of a typed column."""
    if isinstance(data_type, (T.StructType, T.MapType)):
        return names["OBJECT"]
    if isinstance(data_type, T.ArrayType):
        return names["ARRAY"]
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType)):
        return "int"
    word = data_type.simpleString().split("(")[0].upper()
    return names.get(word, word.lower())


def _field_rows(df: DataFrame, keys: list[str], doc: str | None, order: str) -> DataFrame:
    """Rows (key, field, type, ord, text) of the fields present in a document."""
    ordinal = F.col(order).alias("ord")
    if doc is not None:
        members = F.map_entries(F.try_variant_get(F.col(f"`{doc}`"), "$", "map<string,variant>"))
        rows = df.select(*keys, ordinal, F.explode(members).alias("m")).select(
            *keys, "ord", F.col("m.key").alias("field"), F.col("m.value").alias("value")
        )
        text = F.substring(F.col("value").cast("string"), 1, 100)
        return rows.select(*keys, "field", _named(_type_head(F.col("value")), CLIENT_TYPES).alias("type"), "ord", text.alias("text"))
    cells = [
        F.when(
            F.col(f"`{f.name}`").isNotNull(),
            F.struct(
                F.lit(f.name).alias("field"),
                F.lit(spark_type(f.dataType, CLIENT_TYPES)).alias("type"),
                F.substring(F.col(f"`{f.name}`").cast("string"), 1, 100).alias("text"),
            ),
        )
        for f in df.schema.fields
        if f.name not in keys
    ]
    rows = df.select(*keys, ordinal, F.explode(F.array_compact(F.array(*cells))).alias("cell"))
    return rows.select(*keys, "cell.field", "cell.type", "ord", "cell.text")


def _field_counts(df: DataFrame, keys: list[str], doc: str | None, names: dict[str, str]) -> DataFrame:
    """Rows (key, field, type, n).

    A variant ``doc`` keeps the difference between a null and a missing field;
    in a typed frame a null counts as missing, and one aggregate over the
    columns replaces the explode.
    """
    if doc is not None:
        members = F.map_entries(F.try_variant_get(F.col(f"`{doc}`"), "$", "map<string,variant>"))
        rows = df.select(*keys, F.explode(members).alias("m")).select(
            *keys, F.col("m.key").alias("field"), F.col("m.value").alias("value")
        )
        head = _type_head(F.col("value"))
        if names is STORE_TYPES:
            small = F.try_variant_get(F.col("value"), "$", "int").isNotNull()
            head = F.when((head == "BIGINT") & small, F.lit("INT")).otherwise(head)
        # names are given after counting, once per group instead of per value
        counted = rows.select(*keys, "field", head.alias("head")).groupBy(*keys, "field", "head").agg(F.count(F.lit(1)).alias("n"))
        return counted.select(*keys, "field", _named(F.col("head"), names).alias("type"), "n")
    fields = [f for f in df.schema.fields if f.name not in keys]
    counts = df.groupBy(*keys).agg(*[F.count(F.col(f"`{f.name}`")).alias(f"_{i}") for i, f in enumerate(fields)])
    cells = [
        F.struct(
            F.lit(f.name).alias("field"),
            F.lit(spark_type(f.dataType, names)).alias("type"),
            F.col(f"_{i}").alias("n"),
        )
        for i, f in enumerate(fields)
    ]
    return counts.select(*keys, F.inline(F.array(*cells))).filter(F.col("n") > 0)


def field_profile(df: DataFrame, key, doc: str | None = None, n: int = 30) -> DataFrame:
    """The ``n`` most frequent top-level fields per key."""
    keys = keys_of(key)
    counts = _field_counts(df, keys, doc, CLIENT_TYPES).groupBy(*keys, "field").agg(F.sum("n").alias("occurrence_count"))
    order = Window.partitionBy(*keys).orderBy(F.desc("occurrence_count"), "field")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def _field_types(df: DataFrame, keys: list[str], doc: str | None, names: dict[str, str]) -> DataFrame:
    return (
        _field_counts(df, keys, doc, names)
        .groupBy(*keys, "field")
        .agg(F.array_sort(F.collect_set("type")).alias("types"), F.sum("n").alias("count"))
    )


def schema_snapshot(df: DataFrame, key, doc: str | None = None) -> DataFrame:
    """Per field: its store type names and how many documents carry it."""
    return _field_types(df, keys_of(key), doc, STORE_TYPES)


def snapshot_report(snapshot: DataFrame, key) -> DataFrame:
    """One row per key with the fields as an array, most frequent first."""
    keys = keys_of(key)
    item = F.struct((-F.col("count")).alias("neg"), F.col("field").alias("name"), "types", "count")
    return snapshot.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(item)),
            lambda x: F.struct(x["name"].alias("name"), x["types"].alias("types"), x["count"].alias("count")),
        ).alias("fields")
    )


def live_schema(df: DataFrame, key, doc: str | None = None, min_share: float = 0.0) -> DataFrame:
    """Rows (key, field, sorted distinct client types).

    ``min_share`` drops fields carried by less than that share of the
    documents of their key, so that a rare field does not flicker.
    """
    keys = keys_of(key)
    found = _field_types(df, keys, doc, CLIENT_TYPES)
    if min_share > 0:
        total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
        found = null_safe_join(found, total, keys).filter(F.col("count") >= min_share * F.col("total")).drop("total")
    return found.drop("count")


def schema_examples(df: DataFrame, key, order: str, doc: str | None = None) -> DataFrame:
    """Field, sorted types, first example text (100 characters), field count.

    ``order`` must be unique per document for the example to be repeatable.
    """
    keys = keys_of(key)
    found = (
        _field_rows(df, keys, doc, order)
        .groupBy(*keys, "field")
        .agg(F.array_sort(F.collect_set("type")).alias("types"), F.min_by("text", "ord").alias("example"))
    )
    return found.withColumn("field_count", F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def first_types(df: DataFrame, key, order: str, doc: str | None = None) -> DataFrame:
    """Type of each field in the first document that carries it."""
    keys = keys_of(key)
    return _field_rows(df, keys, doc, order).groupBy(*keys, "field").agg(F.min_by("type", "ord").alias("type"))


# --- counts, groups, samples -----------------------------------------------


def top_groups(df: DataFrame, column: str, n: int = 10, size: Column | None = None) -> DataFrame:
    """The ``n`` largest groups of a column with their mean document size."""
    size = document_bytes(df) if size is None else size
    return (
        df.select(column, size.alias("bytes"))
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"), F.avg("bytes").alias("avg_bytes"))
        .orderBy(F.desc("n"), column)
        .limit(n)
    )


def coverage(df: DataFrame, column: str, condition: Column | None = None) -> DataFrame:
    """Total rows, rows that carry ``column``, rows without it, rows matching."""
    matching = F.count_if(condition) if condition is not None else F.count(F.lit(1))
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(column).alias("with_value"),
        F.count_if(F.col(column).isNull()).alias("without_value"),
        matching.alias("matching"),
    )


def sample_rows(df: DataFrame, id_column: str, n: int) -> DataFrame:
    """A repeatable random sample: the ``n`` rows with the smallest id hash."""
    return df.orderBy(F.md5(F.col(id_column).cast("string")), id_column).limit(n)


# --- health card -----------------------------------------------------------

# Health penalties and their limits.
MIB = 1_048_576
SKEW_HIGH, SKEW_MODERATE = 20, 5
HEALTHY_SCORE, WARNING_SCORE = 8, 5


def health_card(df: DataFrame, key, size: Column | None = None, layout: DataFrame | None = None) -> DataFrame:
    """Size percentiles, skew, score 0-10, status and issue texts per key.

    ``layout`` gives ``index_count`` per key: how many partition or bucket
    layouts serve the table. Without it every key counts as having none.
    """
    keys = keys_of(key)
    base = size_baseline(df, keys, size, full=True)
    if layout is not None:
        base = null_safe_join(base, layout.select(*keys, "index_count"), keys, "left")
    else:
        base = base.withColumn("index_count", F.lit(0))
    p50, p95, p99 = F.col("p50_bytes"), F.col("p95_bytes"), F.col("p99_bytes")
    count = F.coalesce(F.col("index_count"), F.lit(0)).cast("int")
    skew = p95 / F.greatest(p50, F.lit(1.0))
    biggest = F.col("max_bytes")
    zero = F.lit(0.0)
    score = F.round(
        F.greatest(
            zero,
            10.0
            - F.when(count == 0, 3.0).otherwise(zero)
            - F.when(skew > SKEW_HIGH, 2.5).when(skew > SKEW_MODERATE, 1.0).otherwise(zero)
            - F.when(p99 > MIB, 2.0).otherwise(zero)
            - F.when(biggest > 8 * MIB, 1.5).otherwise(zero),
        ),
        1,
    )
    issues = F.array_compact(
        F.array(
            F.when(count == 0, F.lit("No secondary indexes — all queries will collection-scan")),
            F.when(
                skew > SKEW_HIGH, F.format_string("High size skew: P95/P50 = %.0f× — outlier documents detected", skew)
            ).when(skew > SKEW_MODERATE, F.format_string("Moderate size skew: P95/P50 = %.0f×", skew)),
            F.when(p99 > MIB, F.format_string("P99 size %.1f KB — approaching 16 MB BSON limit risk", F.round(p99 / 1024, 0))),
            F.when(
                biggest > 8 * MIB,
                F.format_string("Max document %.1f MB — over 50%% of BSON limit", F.round(biggest / MIB, 1)),
            ),
        )
    )
    return (
        base.withColumn("health_score", score)
        .withColumn("issues", issues)
        .select(
            *keys,
            "health_score",
            F.col("sample_count").alias("doc_count"),
            kilobytes(F.col("mean_bytes")).alias("mean_size_kb"),
            kilobytes(p50).alias("p50_size_kb"),
            kilobytes(p95).alias("p95_size_kb"),
            kilobytes(p99).alias("p99_size_kb"),
            kilobytes(biggest).alias("max_size_kb"),
            count.alias("index_count"),
            F.when(F.col("health_score") >= HEALTHY_SCORE, F.lit("HEALTHY"))
            .when(F.col("health_score") >= WARNING_SCORE, F.lit("WARNING"))
            .otherwise(F.lit("CRITICAL"))
            .alias("status"),
            "issues",
        )
    )


def average_health(cards: DataFrame) -> DataFrame:
    return cards.agg(F.avg(F.coalesce("health_score", F.lit(0.0))).alias("avg_health"))
