"""Lempel-Ziv phrase fingerprints of watched texts.

A text is parsed into phrases, each the shortest string not yet in the
dictionary that the parse itself builds. Texts that compress alike share
phrases; the hashed phrase set is kept as a signature of minimum hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.common import map_batches

BINS = 128
MOST_RANGES = 16_384
_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2**64
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def phrase_ends(text: str) -> list[int]:
    """Ends of the phrases of a text, by code points; the last may repeat an earlier phrase."""
    seen: set[str] = set()
    add = seen.add
    ends = []
    phrase = ""
    for at, c in enumerate(text, 1):
        phrase += c
        if phrase not in seen:
            add(phrase)
            ends.append(at)
            phrase = ""
    if phrase:
        ends.append(len(text))
    return ends


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = max(2 * len(_powers[0]), n + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers[0], _powers[1]


def phrase_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the phrases: polynomial hashes cut out of one running sum."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    up, down = _power_tables(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes + np.uint64(1)) * up[: len(codes)], out=sums[1:])
    ends = np.array(phrase_ends(text))
    starts = np.concatenate([[0], ends[:-1]])
    return _mix((sums[ends] - sums[starts]) * down[starts])


def _fill_order(bins: int) -> np.ndarray:
    """For each bin the order in which it looks for a filled one: fixed, and different for every bin."""
    rng = np.random.Generator(np.random.PCG64(11))
    return np.stack([rng.permutation(bins) for _ in range(bins)])


def signature(text: str | None, bins: int, order: np.ndarray) -> str:
    """One minimum hash for each bin of the hash range as four hex digits; empty for a text without characters.

    A bin without phrases takes the hash of the first filled bin in its own order.
    """
    if not text:
        return ""
    h = phrase_hashes(text)
    least = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    where = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(least, where, h)
    filled = np.zeros(bins, bool)
    filled[where] = True
    if not filled.all():
        empty = np.flatnonzero(~filled)
        least[empty] = least[order[empty, filled[order[empty]].argmax(axis=1)]]
    return _mix(least).astype(">u2").tobytes().hex()


def add_fingerprints(documents: DataFrame, text: str = "text", into: str = "fingerprint", bins: int = BINS) -> DataFrame:
    """Add the fingerprint (string) of each whole text of a watched collection.

    One map, no shuffle; other columns are carried along and one named ``into``
    is replaced. Equal texts, repeated rows included, have equal fingerprints;
    null and empty texts have the empty string; an empty table stays empty.
    """
    kept = documents.drop(into)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        order = _fill_order(bins)
        found = [signature(t, bins, order) for t in batch.column(text).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, into])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"`{into}` string"])
    return map_batches(kept, run, schema)


def likeness(a: str, b: str, bins: int = BINS) -> Column:
    """Share of equal minimum hashes of two fingerprint columns; 1 if both are empty, 0 if one is."""
    same = F.filter(
        F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.substr(F.col(a), i * 4 + 1, F.lit(4)) == F.substr(F.col(b), i * 4 + 1, F.lit(4))
    )
    return F.when((F.col(a) == "") | (F.col(b) == ""), (F.col(a) == F.col(b)).cast("double")).otherwise(F.size(same) / F.lit(float(bins)))


def with_successor(rows: DataFrame, order: str, columns: list[str], chunk_rows: int = 1024, keys: DataFrame | None = None) -> DataFrame:
    """Add ``next_<column>`` of the row next in ascending ``order``; the last row's next is the first.

    ``order`` is an integer column. Its values are cut at percentiles into
    ranges of about ``chunk_rows`` rows, however they lie, and every row is sent
    once to its range. The first row of a range goes to the range before it as
    well, so ranges are walked apart and in constant memory. Rows with a null
    ``order`` come last, in the order of a hash of ``columns[0]``, and are cut
    into ranges of that hash; rows with equal values follow each other in the
    order of ``columns``. A single row is own next. ``keys`` may name a cheaper
    frame with the same ``order`` and ``columns[0]`` values. The driver holds
    one number for each range, at most 16,384.
    """
    keys = rows if keys is None else keys
    value = F.col(order).cast("long")
    known = keys.where(F.col(order).isNotNull()).select(value.alias("v"))
    n, unnamed = keys.agg(F.count(order), F.count_if(F.col(order).isNull())).first()
    named_from = _range_starts(known, n, chunk_rows)
    hashed = keys.where(F.col(order).isNull()).select(F.xxhash64(columns[0]).alias("v"))
    unnamed_from = _range_starts(hashed, unnamed, chunk_rows)
    ranges = len(named_from) + len(unnamed_from)
    names = [*rows.columns, *[f"next_{c}" for c in columns]]
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    held = list(rows.columns)

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = batch.column("_h").to_numpy(zero_copy_only=False)
        no_id = pc.is_null(batch.column(order)).to_numpy(zero_copy_only=False)
        ids = pc.fill_null(batch.column(order).cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
        part, first = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
        for where, values, starts, at in ((~no_id, ids, named_from, 0), (no_id, hashes, unnamed_from, len(named_from))):
            if where.any():
                k = np.searchsorted(starts, values[where], "right") - 1
                part[where], first[where] = at + k, starts[k] == values[where]
        again = np.flatnonzero(first)
        take = pa.array(np.concatenate([np.arange(len(ids)), again]))
        to = np.concatenate([part, (part[again] - 1) % ranges])
        last = np.concatenate([np.zeros(len(ids), bool), np.ones(len(again), bool)])
        return pa.RecordBatch.from_arrays(
            [*[batch.column(c).take(take) for c in [*held, "_h"]], pa.array(to), pa.array(last)], [*held, "_h", "_p", "_last"]
        )

    h = F.when(F.col(order).isNull(), F.xxhash64(columns[0])).otherwise(F.lit(0).cast("long"))
    schema = ", ".join(f"`{c}` {kind[c]}" for c in held)
    sent = map_batches(rows.withColumn("_h", h), deal, f"{schema}, _h long, _p long, _last boolean")
    ties = [F.col(c) for c in columns if c != order]
    dealt = sent.repartition("_p").sortWithinPartitions("_p", "_last", order, "_h", *ties)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending = None
        for batch in batches:
            t = pa.Table.from_batches([batch] if pending is None else [pending, batch]).combine_chunks()
            now, after = t.slice(0, t.num_rows - 1), t.slice(1)
            pending = t.slice(t.num_rows - 1).to_batches()[0] if t.num_rows else None
            keep = pc.and_(pc.equal(now["_p"], after["_p"]), pc.invert(now["_last"]))
            out = pa.table([now[c] for c in held] + [after[c] for c in columns], names=names).filter(keep)
            yield from out.combine_chunks().to_batches()

    return dealt.mapInArrow(run, ", ".join([schema, *[f"`next_{c}` {kind[c]}" for c in columns]]))


def _range_starts(values: DataFrame, n: int, chunk_rows: int) -> np.ndarray:
    """First values of ranges of about ``chunk_rows`` of the ``n`` values, the least one among them; none if ``n`` is 0."""
    if not n:
        return np.zeros(0, np.int64)
    pieces = int(min(MOST_RANGES, max(1, n // chunk_rows)))
    shares = [k / pieces for k in range(1, pieces)] or [0.0]
    # percentiles pass through doubles, so a second pass over the values finds the least one of each range
    cuts = np.unique(np.array(values.agg(F.percentile_approx("v", shares, max(1000, 16 * pieces))).first()[0], np.int64))

    def least(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = np.sort(batch.column(0).to_numpy())
        part, at = np.unique(np.searchsorted(cuts, v, "right"), return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(part), pa.array(v[at])], ["part", "v"])

    firsts = map_batches(values, least, "part long, v long").groupBy("part").agg(F.min("v").alias("v"))
    return np.sort(np.array([r.v for r in firsts.collect()], np.int64))
