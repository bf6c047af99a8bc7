"""Text Columns: near-duplicate key, lenient JSON, redaction, truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Map keys whose values are hidden, and the text shown instead.
SENSITIVE_KEYS = ["uri", "connection_string", "password", "api_key", "token", "secret"]
REDACTED = "***REDACTED***"
# Fixed value: marker appended to a shortened text.
TRUNCATED = "…[truncated]"
END_MARK = "--end of value--"


def duplicate_key(kind: Column, description: Column) -> Column:
    """Kind plus the first 60 characters without trailing numbers, lower case."""
    head = F.substring(F.coalesce(description, F.lit("")), 1, 60)
    stem = F.lower(F.trim(F.regexp_replace(head, r"(?U)[\d.\s]+$", "")))
    return F.concat_ws("|", F.coalesce(kind, F.lit("")), stem)


def title_case(kind: Column) -> Column:
    return F.initcap(F.replace(kind, F.lit("_"), F.lit(" ")))


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def redact(args: Column) -> Column:
    return F.transform_values(
        args, lambda k, v: F.when(F.lower(k).isin(SENSITIVE_KEYS), F.lit(REDACTED)).otherwise(v)
    )


def json_length(value: Column) -> Column:
    """Characters of the value serialized as JSON."""
    return F.length(F.to_json(value))


def shorten_map(value: Column, max_chars: int = 2000, keep: int = 300) -> Column:
    """Cut long texts of a string map, only if the whole is over the limit."""
    cut = F.transform_values(
        value,
        lambda _, v: F.when(
            F.length(v) > keep, F.concat(F.substring(v, 1, keep), F.lit(TRUNCATED))
        ).otherwise(v),
    )
    return F.when(json_length(value) > max_chars, cut).otherwise(value)


def shorten_list(value: Column, max_chars: int = 2000, items: int = 10) -> Column:
    return F.when(json_length(value) > max_chars, F.slice(value, 1, items)).otherwise(value)


def strip_fences(raw: Column) -> Column:
    """Drop a code fence around a reply; the closing fence may be missing."""
    text = F.trim(F.regexp_replace(raw, r"(?U)^\s+|\s+$", ""))
    body = F.regexp_replace(text, r"^```[^\n]*\n?", "")
    body = F.regexp_replace(body, r"\n[ \t]*```[ \t]*$", "")
    return F.when(text.startswith("```"), F.trim(body)).otherwise(text)


def strict_json(text: Column) -> Column:
    """Variant of a text that is one JSON value and nothing else, else null.

    The parser stops after the first value, so the text is put in an array
    before an end mark, which must come out right behind it.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{END_MARK}"]')))
    whole = F.try_variant_get(wrapped, "$[1]", "string") == END_MARK
    return F.when(whole, F.try_variant_get(wrapped, "$[0]", "variant"))


def lenient_json(raw: Column, keep: int | None = None) -> Column:
    """Variant of a model reply.

    Tries the text without fences, then its widest ``{...}`` block. A reply that
    is no JSON at all becomes ``{raw_response, parse_error: true}`` and a
    missing reply becomes an empty object. ``keep`` cuts the kept reply to as
    many characters; by default it stays whole.
    """
    body = strip_fences(raw)
    block = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    failed = F.to_json(F.struct((raw if keep is None else F.substring(raw, 1, keep)).alias("raw_response"), F.lit(True).alias("parse_error")))
    empty = raw.isNull() | (raw == "")
    return F.coalesce(
        F.when(empty, F.parse_json(F.lit("{}"))),
        strict_json(body),
        strict_json(F.when(block != "", block)),
        F.parse_json(failed),
    )


def usable_reply(reply: Column) -> Column:
    """A parsed reply is used if it is a non-empty object without error marks."""
    as_map = F.try_variant_get(reply, "$", "map<string,string>")
    bad = F.coalesce(as_map["parse_error"], F.lit("false")) == "true"
    raw = F.coalesce(as_map["raw_response"], F.lit("")) != ""
    return F.coalesce((F.size(as_map) > 0) & ~bad & ~raw, F.lit(False))


def plain_id(value: Column) -> Column:
    """Identifier text, unwrapping the ``{"$oid": ...}`` form."""
    return F.coalesce(F.get_json_object(value, "$.$oid"), F.get_json_object(value, "$['$oid']"), value)


def plain_timestamp(value: Column) -> Column:
    """Timestamp from ISO text or from the ``{"$date": ...}`` form."""
    return F.try_to_timestamp(F.coalesce(F.get_json_object(value, "$['$date']"), value))


def canonical_json(columns: list[str]) -> Column:
    """JSON of the row with its keys in sorted order and no spaces."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)]), {"ignoreNullFields": "false"})
