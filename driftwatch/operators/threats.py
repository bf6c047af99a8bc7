"""Scan of nested document text for prompt-injection patterns.

The whole scan is one Column per row: the schema (or the variant) is walked to
an array of (path, text), each text is tested, and the matches are counted in
place. Nothing is exploded, shuffled or sent to Python.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwatch.functions import patterns as P
from driftwatch.session import spread

_LABELS = list(dict.fromkeys(label for label, _, _ in P.INJECTION_PATTERNS))
_NO_STRINGS = "array<struct<field:string,text:string>>"


# --- walks: document to array of (field path, text) --------------------------


def typed_strings(df: DataFrame, columns: list[str] | None = None, doc: str | None = None, max_depth: int | None = None) -> Column:
    """All texts of the typed columns, with paths; ``max_depth`` ends the walk.

    With ``doc`` the document is the value of that struct column.
    """
    schema = df.schema if doc is None else df.schema[doc].dataType
    fields = [(f, F.col(f"`{f.name}`") if doc is None else F.col(doc).getField(f.name)) for f in schema.fields]
    fields = [(f, value) for f, value in fields if columns is None or f.name in columns]
    parts = []
    for f, value in fields:
        part = _walk(f.dataType, value, F.lit(f.name), 1, max_depth)
        if part is not None:
            parts.append(part)
    if not parts:
        return F.array().cast(_NO_STRINGS)
    return F.concat(*parts)


def _walk(data_type: T.DataType, value: Column, path: Column, depth: int, most: int | None) -> Column | None:
    if most is not None and depth > most:
        return None
    none = F.array().cast(_NO_STRINGS)
    if isinstance(data_type, T.StringType):
        return F.when(value.isNotNull(), F.array(F.struct(path.alias("field"), value.alias("text")))).otherwise(none)
    if isinstance(data_type, T.StructType):
        parts = []
        for f in data_type.fields:
            part = _walk(f.dataType, value.getField(f.name), F.concat(path, F.lit(f".{f.name}")), depth + 1, most)
            if part is not None:
                parts.append(part)
        return F.concat(*parts) if parts else None
    if isinstance(data_type, T.ArrayType):
        if _walk(data_type.elementType, F.lit(None), path, depth + 1, most) is None:
            return None
        deeper = F.transform(
            value,
            lambda x, i: _walk(
                data_type.elementType, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), depth + 1, most
            ),
        )
        return F.coalesce(F.flatten(deeper), none)
    if isinstance(data_type, T.MapType):
        if _walk(data_type.valueType, F.lit(None), path, depth + 1, most) is None:
            return None
        deeper = F.transform(
            F.map_entries(value),
            lambda e: _walk(
                data_type.valueType, e["value"], F.concat(path, F.lit("."), e["key"].cast("string")), depth + 1, most
            ),
        )
        return F.coalesce(F.flatten(deeper), none)
    return None


def variant_strings(doc: str, max_depth: int | None = None) -> Column:
    """All texts of a variant document, with paths; ``max_depth`` ends the walk.

    Level by level: only objects and lists are walked on and texts are set
    aside as they are met, until nothing is left to walk.
    """
    value = F.col(doc)
    levels = _most_levels(doc) if max_depth is None else F.least(_most_levels(doc), F.lit(max_depth))
    def sorted_out(nodes: Column, texts: Column) -> Column:
        found = F.transform(
            F.filter(nodes, lambda n: n["m"].isNull() & n["l"].isNull() & (F.schema_of_variant(n["v"]) == "STRING")),
            lambda n: F.struct(n["field"].alias("field"), F.variant_get(n["v"], "$", "string").alias("text")),
        )
        onward = F.filter(nodes, lambda n: n["m"].isNotNull() | n["l"].isNotNull())
        return F.struct(onward.alias("open"), F.concat(texts, found).alias("texts"))

    def level(state: Column, _: Column) -> Column:
        below = F.flatten(F.transform(state["open"], _children))
        return F.when(F.size(state["open"]) == 0, state).otherwise(sorted_out(below, state["texts"]))

    start = sorted_out(F.array(_opened(F.lit(""), value)), F.array().cast(_NO_STRINGS))
    steps = F.when(levels >= 1, F.sequence(F.lit(1), levels)).otherwise(F.array().cast("array<int>"))
    return F.when(value.isNotNull(), F.aggregate(steps, start, level, lambda s: s["texts"])).otherwise(F.array().cast(_NO_STRINGS))


def _most_levels(doc: str) -> Column:
    """No document is nested deeper than it has opening brackets."""
    text = F.to_json(doc)
    return F.coalesce(F.length(text) - F.length(F.translate(text, "{[", "")), F.lit(0))


def _opened(path: Column, value: Column) -> Column:
    """A node with its content: ``m`` for an object, ``l`` for a list."""
    return F.struct(
        path.alias("field"), value.alias("v"),
        F.try_variant_get(value, "$", "map<string,variant>").alias("m"), F.try_variant_get(value, "$", "array<variant>").alias("l"),
    )


def _children(node: Column) -> Column:
    path = node["field"]
    prefix = F.when(path == "", F.lit("")).otherwise(F.concat(path, F.lit(".")))
    return F.when(
        node["m"].isNotNull(), F.transform(F.map_entries(node["m"]), lambda e: _opened(F.concat(prefix, e["key"]), e["value"]))
    ).otherwise(F.transform(node["l"], lambda x, i: _opened(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), x)))


def document_strings(
    df: DataFrame, doc_id: str, doc: str | None = None, columns: list[str] | None = None, max_depth: int | None = None
) -> DataFrame:
    """The walk as rows (id, field, text)."""
    dynamic = doc is not None and not isinstance(df.schema[doc].dataType, T.StructType)
    names = columns or [c for c in df.columns if c != doc_id]
    strings = variant_strings(doc, max_depth) if dynamic else typed_strings(df, None if doc else names, doc, max_depth)
    return df.select(doc_id, F.inline(strings))


# --- tests on one text --------------------------------------------------------


def fold(text: Column) -> Column:
    """Lower case, with the letters that fold to ASCII replaced by them."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.lower(F.when(ascii_only, text).otherwise(F.translate(text, P.FOLDED_FROM, P.FOLDED_TO)))


def _may_match(folded: Column, required: list[list[str]]) -> Column:
    return reduce(and_, [reduce(or_, [folded.contains(x) for x in one_of]) for one_of in required])


def _raw_matches(text: Column, folded: Column) -> Column:
    """One text per pattern: its first match, or null if there is none.

    Literals are looked up first, then the lower-case pattern in the folded
    text, which matches exactly where the pattern does when case is ignored;
    only texts with a match pay for finding it with case.
    """
    return F.array(
        *[
            F.when(
                _may_match(folded, required) & folded.rlike(f"(?U){pattern.lower()}"),
                F.regexp_extract(text, f"(?iU){pattern}", 0),
            )
            for (_, pattern, _), required in zip(P.INJECTION_PATTERNS, P.REQUIRED_LITERALS)
        ]
    )


def _by_label(field: Column, raw: Column) -> Column:
    """Match structs, for each label that of its first matching pattern."""
    found = []
    for label in _LABELS:
        hits = [
            F.when(
                raw[i] != "",
                F.struct(
                    field.alias("field"),
                    F.lit(label).alias("pattern_label"),
                    F.lit(about).alias("description"),
                    F.substring(raw[i], 1, P.MATCH_CHARS).alias("matched_text"),
                ),
            )
            for i, (name, _, about) in enumerate(P.INJECTION_PATTERNS)
            if name == label
        ]
        found.append(F.coalesce(*hits))
    return F.array_compact(F.array(*found))


def text_matches(strings: Column, max_chars: int | None = None, min_chars: int | None = None) -> Column:
    """Matches of an array of (field, text), one per label and text.

    Whole texts of any length are tested; ``max_chars`` cuts them first,
    ``min_chars`` leaves shorter ones out.
    """
    long_enough = strings if min_chars is None else F.filter(strings, lambda s: F.length(s["text"]) >= min_chars)

    def prepared(s: Column) -> Column:
        text = s["text"] if max_chars is None else F.substring(s["text"], 1, max_chars)
        return F.struct(s["field"].alias("field"), text.alias("text"), fold(text).alias("folded"))

    def tested(s: Column) -> Column:
        return F.struct(s["field"].alias("field"), _raw_matches(s["text"], s["folded"]).alias("raw"))

    tests = F.transform(F.transform(long_enough, prepared), tested)
    hit = F.filter(tests, lambda s: F.exists(s["raw"], lambda m: m != ""))
    return F.flatten(F.transform(hit, lambda s: _by_label(s["field"], s["raw"])))


def _present(names: list[str], get) -> Column:
    """The suspicious ones of the field names that have a value."""
    odd = [F.when(get(c).isNotNull(), F.lit(c)) for c in names if c.lower() in P.SUSPICIOUS_FIELDS]
    return F.array_compact(F.array(*odd)) if odd else F.array()


# --- scans ----------------------------------------------------------------------


def scan_threats(
    df: DataFrame, doc_id: str, columns: list[str] | None = None, doc: str | None = None,
    max_chars: int | None = None, keep: list[str] | None = None, max_depth: int | None = None, min_chars: int | None = None,
) -> DataFrame:
    """Threat verdict per document.

    Typed frames are scanned over ``columns`` (default: all but the id);
    with ``doc``, the document is that struct or variant column. Texts of any
    depth and length are scanned; ``max_depth=P.SHORT_DEPTH``,
    ``min_chars=P.SHORT_CHARS`` and ``max_chars=50_000`` give the shorter scan.
    """
    df = spread(df)
    if doc is not None and isinstance(df.schema[doc].dataType, T.StructType):
        names = df.schema[doc].dataType.fieldNames()
        strings = typed_strings(df, columns, doc, max_depth)
        odd = _present(names, lambda c: F.col(doc).getField(c))
    elif doc is not None:
        strings = variant_strings(doc, max_depth)
        names = F.map_keys(F.try_variant_get(F.col(doc), "$", "map<string,variant>"))
        odd = F.filter(names, lambda n: F.lower(n).isin(P.SUSPICIOUS_FIELDS))
    else:
        scanned = [c for c in (columns or df.columns) if c != doc_id]
        strings = typed_strings(df, scanned, None, max_depth)
        odd = _present(scanned, lambda c: F.col(f"`{c}`"))
    odd = F.coalesce(odd, F.array()).cast("array<string>")
    staged = df.select(
        doc_id, *(keep or []), text_matches(strings, max_chars, min_chars).alias("matches"), odd.alias("suspicious_fields")
    )
    m, s = F.size("matches"), F.size("suspicious_fields")
    raw = F.least(F.lit(1.0), m * P.MATCH_WEIGHT + s * P.FIELD_WEIGHT)
    hit = (m > 0) | (s > 0)
    critical = (m >= P.CRITICAL_MATCHES) | (raw >= P.CRITICAL_CONFIDENCE)
    return staged.select(
        doc_id,
        *(keep or []),
        hit.alias("threat_detected"),
        F.when(hit, F.lit("AI_MEMORY_POISONING")).alias("anomaly_type"),
        F.when(hit & critical, F.lit("CRITICAL")).when(hit, F.lit("WARNING")).alias("severity"),
        "matches",
        "suspicious_fields",
        F.round(raw, 3).alias("confidence"),
    )


def scan_requests(df: DataFrame, text: str, max_chars: int | None = None) -> DataFrame:
    """Adds ``blocked``: the outgoing text carries an injection pattern.

    Whole texts are tested; ``max_chars`` cuts them first.
    """
    value = F.col(text) if max_chars is None else F.substring(text, 1, max_chars)
    return spread(df).withColumn("blocked", F.coalesce(value.rlike(f"(?iU){P.REQUEST_PATTERN}"), F.lit(False)))
