"""Linking tool calls of incident agents to their results, in canonical JSON.

Calls and results are rows of the agents' audit trail: ``incident_id``,
``call_id``, ``tool_name``, ``args`` (JSON text), ``after`` (the call it waited
for) and ``response``. Joins are by identifier; the order follows from the
depth of each call below the calls it waited for.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.common import forget, stored

KEY = ("incident_id", "call_id")
# JSON kinds as schema_of_variant names them
KINDS = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY"}


def argument_errors(tool_name: Column, args: Column, schemas: Mapping[str, Mapping[str, str]]) -> Column:
    """Errors of JSON arguments against the tool's schema, as an array of texts; empty if valid.

    ``schemas``: tool -> argument -> kind (string, integer, number, boolean,
    object, array), with ``?`` at the end of a kind where the argument may be
    missing. It is compiled into one expression.
    """
    v = F.try_parse_json(args)
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    verdict = F.array(F.lit("unknown tool"))
    for tool, fields in schemas.items():
        errors = [F.transform(F.array_sort(F.array_except(keys, F.array(*[F.lit(f) for f in fields]).cast("array<string>"))), lambda k: F.concat(F.lit("unexpected "), k))]
        for field, kind in sorted(fields.items()):
            value = F.try_variant_get(v, f"$['{field}']", "variant")
            is_kind = F.schema_of_variant(value)
            name = kind.rstrip("?")
            right = is_kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") if name == "number" else is_kind.startswith(KINDS[name])
            missing = F.lit(None).cast("string") if kind.endswith("?") else F.lit(f"missing {field}")
            wrong = F.when(value.isNull(), missing).when(~right, F.lit(f"{field} is not {name}"))
            errors.append(F.array(wrong))
        listed = F.filter(F.concat(*errors), lambda e: e.isNotNull())
        verdict = F.when(tool_name == tool, F.when(keys.isNull(), F.array(F.lit("arguments are no JSON object"))).otherwise(listed)).otherwise(verdict)
    return verdict


def call_depth(calls: DataFrame) -> DataFrame:
    """(incident_id, call_id, depth): 0 for a call that waited for none, else one below the call it waited for.

    Pointers double each round, so a chain of n calls takes log2(n) rounds. A
    call that waits for an unknown one starts a chain; calls of a circle, or
    below one, get a null depth.
    """
    known = calls.select("incident_id", F.col("call_id").alias("up"))
    now = (
        calls.select(*KEY, F.col("after").alias("up"))
        .join(known.withColumn("found", F.lit(True)), ["incident_id", "up"], "left")
        .select(*KEY, F.when(F.col("found"), F.col("up")).alias("up"))
        .withColumn("depth", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long"))
    )
    now = stored(now)
    rows = now.count()
    open_rows, reach = now.where("up is not null").count(), 1
    while open_rows and reach <= rows:
        jump = now.select("incident_id", F.col("call_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"))
        nxt = stored(
            now.where("up is not null")
            .join(jump, ["incident_id", "up"])
            .select(*KEY, F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"))
            .unionByName(now.where("up is null"))
        )
        forget(now)
        now, reach, open_rows = nxt, reach * 2, nxt.where("up is not null").count()
    return now.select(*KEY, F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """One row for each call, and for each result without a call, in canonical JSON.

    Gives ``incident_id, call_id, depth, linked, valid, errors, record``: sort by
    (incident_id, depth, call_id) for an order in which every call follows the
    one it waited for. ``record`` has sorted keys, no blanks and no null fields;
    arguments that are JSON appear as such, others as text. A call without a
    result, and a result without a call, are kept with ``linked`` false; the
    latter has a null depth. Repeated rows of one identifier count once (the
    smallest by content); rows with a null identifier are kept, unlinked.
    Empty tables give an empty result; other columns are ignored.
    """
    c = (
        calls.where(F.col("incident_id").isNotNull() & F.col("call_id").isNotNull())
        .groupBy(*KEY)
        .agg(F.min(F.struct("tool_name", "args", "after")).alias("c"))
        .select(*KEY, "c.*")
    )
    c = stored(c)
    r = (
        results.where(F.col("incident_id").isNotNull() & F.col("call_id").isNotNull())
        .groupBy(*KEY)
        .agg(F.min(F.struct("response")).alias("r"))
        .select(*KEY, "r.response", F.lit(True).alias("answered"))
    )
    nameless_c = calls.where(F.col("incident_id").isNull() | F.col("call_id").isNull()).select(*KEY, "tool_name", "args", "after")
    nameless_r = results.where(F.col("incident_id").isNull() | F.col("call_id").isNull()).select(*KEY, "response")
    no_text = F.lit(None).cast("string")
    linked = c.join(r, list(KEY), "left").join(call_depth(c), list(KEY), "left").withColumn("called", F.lit(True))
    orphans = r.join(c.select(*KEY), list(KEY), "left_anti").unionByName(nameless_r.withColumn("answered", F.lit(True)))
    rows = linked.unionByName(
        orphans.select(
            *KEY, no_text.alias("tool_name"), no_text.alias("args"), no_text.alias("after"), "response", "answered",
            F.lit(None).cast("long").alias("depth"), F.lit(False).alias("called"),
        )
    ).unionByName(
        nameless_c.select(
            "*", no_text.alias("response"), F.lit(None).cast("boolean").alias("answered"),
            F.lit(0).cast("long").alias("depth"), F.lit(True).alias("called"),
        )
    )
    errors = F.when(F.col("called"), argument_errors(F.col("tool_name"), F.col("args"), schemas)).otherwise(
        F.array(F.lit("no call"))
    )
    parsed = F.try_parse_json("args")
    # variants keep the keys of objects sorted
    arguments = F.coalesce(F.to_json(parsed), F.to_json(F.struct(F.col("args").alias("text"))), F.lit("null"))
    rest = F.to_json(F.struct("call_id", "incident_id", F.col("after").alias("follows"), "response", F.col("tool_name").alias("tool")))
    joined = F.concat(F.lit('{"arguments":'), arguments, F.when(rest == "{}", "").otherwise(","), F.substr(rest, F.lit(2)))
    record = F.to_json(F.parse_json(joined))
    return rows.select(
        *KEY,
        "depth",
        (F.coalesce("called", F.lit(False)) & F.coalesce("answered", F.lit(False))).alias("linked"),
        errors.alias("errors"),
        record.alias("record"),
    ).withColumn("valid", F.size("errors") == 0)
