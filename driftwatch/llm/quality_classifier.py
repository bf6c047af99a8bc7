"""Quality of watched texts by positive-unlabelled learning.

Trusted positives and unlabelled texts give, with the class prior, the risk of a
classifier without any trusted negatives: prior * loss of the positives as
positives + (loss of the unlabelled as negatives - prior * loss of the positives
as negatives). The bracket is a risk and is kept from going below zero.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.common import forget, map_batches, stored, words

MARKS = b"!#*$%&|<>.,;:?'\"()[]{}@/\\=+-_~^`0123456789"
N_FEATURES = 27


def style(text: str | None) -> np.ndarray:
    """Measures of form, none of meaning: shares of characters, repetition, lengths. Zeros (but the first) for no words."""
    x = np.zeros(N_FEATURES, np.float32)
    x[0] = 1.0
    w = words(text)
    if not w:
        return x
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    n, size = len(w), raw.sum()
    marks = raw[list(b"!#*$%&|<>")] / n
    symbols = marks[1:].sum()
    lines = [v for v in text.split("\n") if v.strip()]
    digits, upper, lower = raw[48:58].sum() / size, raw[65:91].sum() / size, raw[97:123].sum() / size
    twice = sum(a == b for a, b in zip(w, w[1:])) / n
    fresh = len(set(w)) / n
    length = size / n
    punctuation = raw[[44, 46, 59, 58, 63]].sum() / n
    links = raw[[47, 64, 61, 95, 123, 125, 91, 93]].sum() / n
    x[1:] = (
        *np.minimum(np.sqrt(marks), 1.5),
        min(math.sqrt(symbols), 2.0),
        min(symbols * 4, 1.0),
        min(marks[0] * 4, 1.0),
        math.sqrt(digits),
        math.sqrt(upper),
        min(upper * 4, 1.0),
        lower,
        raw[128:].sum() / size,
        twice,
        min(twice * 4, 1.0),
        fresh,
        math.log1p(n) / 10,
        min(length, 20) / 20,
        min(math.sqrt(punctuation), 1.5),
        min(math.sqrt(links), 1.5),
        (1 - len(set(lines)) / len(lines)) if lines else 0.0,
        math.log1p(n / max(1, len(lines))) / 5,
    )
    return x


def style_features(documents: DataFrame, text: str = "text") -> DataFrame:
    """Replace ``text`` by ``x`` (array of float), its style measures; one map, no shuffle."""
    kept = [c for c in documents.columns if c not in (text, "x")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [style(t) for t in batch.column(text).to_pylist()]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(x, pa.list_(pa.float32()))], [*kept, "x"])

    kind = {f.name: f.dataType.simpleString() for f in documents.schema}
    return map_batches(documents.select(*kept, text), run, ", ".join([f"`{c}` {kind[c]}" for c in kept] + ["x array<float>"]))


def _sums(rows: DataFrame, w: np.ndarray) -> dict[str, np.ndarray]:
    """Loss, gradient and curvature sums over all rows at weights ``w``, and the sums over the positives.

    Each task adds up its rows; the parts, of fixed size, are added up by Spark.
    """
    d = len(w)
    size = 2 + d + d * d + 3 + d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(float)
            positive = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            f = np.clip(x @ w, -30, 30)
            p = 1 / (1 + np.exp(-f))
            soft = np.log1p(np.exp(f))
            total += np.concatenate(
                [
                    [len(x), soft.sum()],
                    x.T @ p,
                    ((x * (p * (1 - p))[:, None]).T @ x).ravel(),
                    [positive.sum(), soft[positive].sum(), (soft - f)[positive].sum()],
                    x[positive].sum(axis=0),
                ]
            )
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], ["i", "v"])

    parts = rows.select("x", "positive").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i")
    v = np.array([r["v"] for r in parts.collect()]) if size else np.zeros(0)
    v = v if len(v) else np.zeros(size)
    return {
        "n": v[0], "soft": v[1], "slope": v[2 : 2 + d], "bend": v[2 + d : 2 + d + d * d].reshape(d, d),
        "n_pos": v[-3 - d], "pos_soft": v[-2 - d], "pos_loss": v[-1 - d], "pos_x": v[-d:],
    }


def class_prior(rows: DataFrame) -> float:
    """Share of positives: of the trusted labels (column ``label``) if both kinds are there, else 0.5."""
    n, ones = rows.agg(F.count("label"), F.coalesce(F.sum("label"), F.lit(0))).first()
    return min(max(ones / n, 0.02), 0.98) if n and 0 < ones < n else 0.5


def fit_quality(
    documents: DataFrame,
    labels: DataFrame,
    id_col: str = "document_id",
    text: str = "text",
    prior: float | None = None,
    ridge: float = 1e-4,
    steps: int = 12,
) -> np.ndarray:
    """Weights of the style measures that minimise the non-negative unbiased risk.

    ``documents`` are the unlabelled texts; ``labels`` (``id_col``, ``quality``)
    names the trusted positives among them by quality 1. Other labels serve only
    to estimate the prior where none is given. All rows count: each Newton step
    on the logistic risk is one Spark job over the stored measures. A step after
    which the negative-class risk is below zero is halved, and the last weights
    are kept if that does not help. Without positives the weights are zero, but
    for the prior. Repeated label rows count once, null labels not at all.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(id_col).agg(F.max("quality").alias("label"))
    measured = style_features(documents.select(id_col, F.col(text).alias("text")), "text")
    rows = stored(measured.join(known, id_col, "left").select("x", "label", F.coalesce(F.col("label") == 1, F.lit(False)).alias("positive")))
    share = class_prior(rows) if prior is None else prior
    w = np.zeros(N_FEATURES)
    w[0] = math.log(share / (1 - share))
    now = _sums(rows, w)
    if not now["n_pos"]:
        forget(rows)
        return w
    penalty = np.full(N_FEATURES, ridge)
    penalty[0] = 1e-8

    def risk(s: dict, w: np.ndarray) -> tuple[float, float]:
        negative = s["soft"] / s["n"] - share * s["pos_soft"] / s["n_pos"]
        return share * s["pos_loss"] / s["n_pos"] + max(0.0, negative) + 0.5 * (penalty * w * w).sum(), negative

    best = risk(now, w)[0]
    for _ in range(steps):
        slope = now["slope"] / now["n"] - share * now["pos_x"] / now["n_pos"] + penalty * w
        step = np.linalg.lstsq(now["bend"] / now["n"] + np.diag(penalty), slope, rcond=None)[0]
        for _ in range(6):
            there = _sums(rows, w - step)
            value, negative = risk(there, w - step)
            if negative >= 0 and value <= best + 1e-12:
                break
            step = step / 2
        else:
            break
        w, now, gained, best = w - step, there, best - value, value
        if gained < 1e-5:
            break
    forget(rows)
    return w


def score_quality(documents: DataFrame, weights: np.ndarray, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Add ``score`` (probability of quality 1) and ``predicted`` (int, 1 at ``threshold`` and above) to whole texts.

    One map, no shuffle. Null and empty texts are scored by their zero measures;
    other columns are carried along, those of the two names replaced.
    """
    kept = documents.drop("score", "predicted")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.stack([style(t) for t in batch.column(text).to_pylist()]).astype(float)
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, "score"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["score double"])
    return map_batches(kept, run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(id_col: str, parts: int, rest: int) -> Column:
    """Whether the crc32 of the id, written as text, leaves ``rest`` when divided by ``parts``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == rest, F.lit(False))
