"""Document size in bytes of the public BSON layout, as one Column.

The Column is generated from the DataFrame schema at plan time, so it runs
inside code generation and reads only lengths, never a serialized document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the BSON layout: bytes of the fixed-width types.
FIXED_WIDTH = {
    T.ByteType: 4,
    T.ShortType: 4,
    T.IntegerType: 4,
    T.LongType: 8,
    T.FloatType: 8,
    T.DoubleType: 8,
    T.BooleanType: 1,
    T.TimestampType: 8,
    T.TimestampNTZType: 8,
    T.DateType: 8,
    T.DecimalType: 16,
}
DOCUMENT_OVERHEAD = 5  # int32 length plus the closing zero byte
ELEMENT_OVERHEAD = 2  # type byte plus the zero byte that ends the name


def document_bytes(
    df: DataFrame, columns: list[str] | None = None, null_as: str = "missing", doc: str | None = None
) -> Column:
    """Size of each row as a document made of ``columns`` (default: all).

    With ``doc`` the document is the value of that struct or variant column.
    """
    if doc is not None and isinstance(df.schema[doc].dataType, T.VariantType):
        return variant_bytes(F.col(f"`{doc}`"))
    if doc is not None:
        return _value(df.schema[doc].dataType, F.col(f"`{doc}`"), null_as)
    wanted = set(columns) if columns is not None else None
    fields = [f for f in df.schema.fields if wanted is None or f.name in wanted]
    return _document(fields, lambda name: F.col(f"`{name}`"), null_as)


def _document(fields, get, null_as: str) -> Column:
    total = F.lit(DOCUMENT_OVERHEAD).cast("long")
    for field in fields:
        value = get(field.name)
        head = ELEMENT_OVERHEAD + len(field.name.encode("utf-8"))
        absent = head if null_as == "null" else 0
        total = total + F.when(value.isNull(), F.lit(absent).cast("long")).otherwise(
            head + _value(field.dataType, value, null_as)
        )
    return total


def _value(data_type: T.DataType, value: Column, null_as: str) -> Column:
    width = FIXED_WIDTH.get(type(data_type))
    if width is not None:
        return F.lit(width).cast("long")
    if isinstance(data_type, T.StringType):
        return 5 + F.octet_length(value).cast("long")
    if isinstance(data_type, T.BinaryType):
        return 5 + F.octet_length(value).cast("long")
    if isinstance(data_type, T.NullType):
        return F.lit(0).cast("long")
    if isinstance(data_type, T.StructType):
        return _document(data_type.fields, lambda name: value.getField(name), null_as)
    if isinstance(data_type, T.ArrayType):
        return _array(data_type, value, null_as)
    if isinstance(data_type, T.MapType):
        return _map(data_type, value, null_as)
    raise TypeError(f"no document size for {data_type.simpleString()}")


def index_digits(n: Column) -> Column:
    """Total characters of the array keys "0" .. str(n - 1), in closed form."""
    n = n.cast("long")
    total = n
    for power in range(1, 10):
        total = total + F.greatest(n - F.lit(10**power).cast("long"), F.lit(0).cast("long"))
    return total


def _array(data_type: T.ArrayType, value: Column, null_as: str) -> Column:
    element = data_type.elementType
    n = F.size(value).cast("long")
    frame = DOCUMENT_OVERHEAD + n * ELEMENT_OVERHEAD + index_digits(n)
    present = F.size(F.array_compact(value)).cast("long") if data_type.containsNull else n
    width = FIXED_WIDTH.get(type(element))
    if width is not None:
        return frame + present * width
    if isinstance(element, T.StringType):
        # array_join skips nulls, so its byte length is the sum over elements
        return frame + present * 5 + F.octet_length(F.array_join(value, "")).cast("long")
    sizes = F.transform(
        value,
        lambda x: F.when(x.isNull(), F.lit(0).cast("long")).otherwise(_value(element, x, null_as)),
    )
    return frame + F.aggregate(sizes, F.lit(0).cast("long"), lambda a, b: a + b)


def _map(data_type: T.MapType, value: Column, null_as: str) -> Column:
    sizes = F.transform(
        F.map_entries(value),
        lambda e: ELEMENT_OVERHEAD
        + F.octet_length(e["key"].cast("string")).cast("long")
        + F.when(e["value"].isNull(), F.lit(0).cast("long")).otherwise(
            _value(data_type.valueType, e["value"], null_as)
        ),
    )
    return DOCUMENT_OVERHEAD + F.aggregate(sizes, F.lit(0).cast("long"), lambda a, b: a + b)


# JSON parsers refuse deeper documents.
PARSER_DEPTH = 1000


def variant_bytes(doc: Column, max_depth: int = 16) -> Column:
    """Size of a dynamic document.

    A document's size is the sum of what each node adds by itself, so the
    nodes are summed level by level, first ``max_depth`` levels, and for a
    document with more all that a parser accepts.
    """
    zero = F.lit(0).cast("long")

    def level(acc: Column, _: Column) -> Column:
        added = F.aggregate(acc["nodes"], zero, lambda a, n: a + ELEMENT_OVERHEAD + n["name"] + _own_bytes(n["v"], n["head"]))
        return F.struct((acc["total"] + added).alias("total"), _members(acc["nodes"]).alias("nodes"))

    root = F.array(F.struct(zero.alias("name"), doc.alias("v"), _type_head(doc).alias("head")))
    start = F.struct(F.lit(DOCUMENT_OVERHEAD).cast("long").alias("total"), _members(root).alias("nodes"))

    def finished(acc: Column, beyond: Column) -> Column:
        return F.when(F.size(acc["nodes"]) == 0, acc["total"]).otherwise(beyond)

    too_deep = F.raise_error(F.lit(f"document deeper than {PARSER_DEPTH} levels")).cast("long")
    whole = F.aggregate(
        F.sequence(F.lit(1), F.lit(max_depth)),
        start,
        level,
        lambda acc: finished(
            acc,
            F.aggregate(
                F.sequence(F.lit(max_depth + 1), F.lit(PARSER_DEPTH)), acc, level, lambda rest: finished(rest, too_deep)
            ),
        ),
    )
    return F.when(doc.isNotNull(), whole)


def _type_head(value: Column) -> Column:
    return F.substring_index(F.substring_index(F.schema_of_variant(value), "<", 1), "(", 1)


def _members(nodes: Column) -> Column:
    """The children of all containers: (bytes of the name, value, type)."""

    def one(n: Column) -> Column:
        fields = F.map_entries(F.try_variant_get(n["v"], "$", "map<string,variant>"))
        items = F.try_variant_get(n["v"], "$", "array<variant>")
        return F.when(
            n["head"] == "OBJECT",
            F.transform(fields, lambda e: F.struct(F.octet_length(e["key"]).cast("long").alias("name"), e["value"].alias("v"))),
        ).otherwise(
            F.transform(items, lambda x, i: F.struct(F.length(i.cast("string")).cast("long").alias("name"), x.alias("v")))
        )

    # the type is taken once per node and kept beside it
    containers = F.filter(nodes, lambda n: n["head"].isin("OBJECT", "ARRAY"))
    return F.transform(
        F.flatten(F.transform(containers, one)),
        lambda c: F.struct(c["name"].alias("name"), c["v"].alias("v"), _type_head(c["v"]).alias("head")),
    )


def _own_bytes(value: Column, head: Column) -> Column:
    whole = F.when(F.try_variant_get(value, "$", "int").isNotNull(), F.lit(4)).otherwise(F.lit(8))
    return (
        F.when(head == "STRING", 5 + F.octet_length(F.try_variant_get(value, "$", "string")))
        .when(head == "BIGINT", whole)
        .when(head == "BOOLEAN", F.lit(1))
        .when(head == "VOID", F.lit(0))
        .when(head.isin("OBJECT", "ARRAY"), F.lit(DOCUMENT_OVERHEAD))
        .otherwise(F.lit(8))
        .cast("long")
    )
