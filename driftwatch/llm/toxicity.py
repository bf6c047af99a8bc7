"""Toxicity of watched texts by a chain of linear classifiers.

Categories are predicted one after the other. The model of a later category
sees, besides the text, the probabilities of the earlier ones; while training
these are out-of-fold predictions, so that it learns from probabilities as
uncertain as those it will meet.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.common import map_batches, stored, words

MAX_TRAIN_ROWS = 8_000
N_TERMS = 128
N_FOLDS = 5
N_STYLE = 9
TRIM = b".,;:!?\"'()[]"


class ChainModel(NamedTuple):
    """Terms, and for each category of the chain its weights over [1, style, terms, earlier logits]."""

    categories: tuple[str, ...]
    terms: tuple[bytes, ...]
    weights: tuple[np.ndarray, ...]


def features(text: str | None, index: dict[bytes, int]) -> np.ndarray:
    """1, style measures, then log counts of the terms. A null text counts as empty."""
    w = words(text)
    x = np.zeros(1 + N_STYLE + len(index))
    x[0] = 1.0
    if not w:
        return x
    n = len(w)
    get = index.get
    for term in w:
        j = get(term)
        if j is None:
            j = get(term.strip(TRIM))
        if j is not None:
            x[j] += 1.0
    np.log1p(x[1 + N_STYLE :], out=x[1 + N_STYLE :])
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    size = raw.sum()
    x[1 : 1 + N_STYLE] = (
        math.log1p(n) / 10,
        raw[65:91].sum() / size,
        raw[33] / n,
        raw[[35, 42, 36, 37, 38, 124, 60, 62]].sum() / n,
        raw[48:58].sum() / size,
        len(set(w)) / n,
        sum(a == b for a, b in zip(w, w[1:])) / n,
        raw[128:].sum() / size,
        size / n / 20,
    )
    return x


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Newton steps on the ridge-penalised log loss; the intercept (column 0) is free."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _terms(sample: DataFrame, categories: Sequence[str], n_terms: int) -> tuple[bytes, ...]:
    """The words whose document counts tell a category best: |z| of the log odds, ties by word."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [sorted({v.strip(TRIM) for v in words(t)} - {b""}) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [pa.array(found, pa.list_(pa.binary()))] + [batch.column(c) for c in categories],
            ["terms", *categories],
        )

    kinds = ", ".join(f"{c} double" for c in categories)
    listed = map_batches(sample.select("text", *categories), run, f"terms array<binary>, {kinds}")
    counts = listed.select(F.explode("terms").alias("term"), *categories)
    # a null label counts for neither side
    counts = counts.groupBy("term").agg(
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(f"{c}_1") for c in categories],
        *[F.count(c).alias(f"{c}_n") for c in categories],
    )
    totals = sample.agg(
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(f"{c}_1") for c in categories],
        *[F.count(c).alias(f"{c}_n") for c in categories],
    ).first()
    chosen: list[bytes] = []
    for c in categories:
        n1, n0 = totals[f"{c}_1"], totals[f"{c}_n"] - totals[f"{c}_1"]
        a, b = F.col(f"{c}_1"), F.col(f"{c}_n") - F.col(f"{c}_1")
        odds = F.log((a + 0.5) / (n1 - a + 0.5)) - F.log((b + 0.5) / (n0 - b + 0.5))
        z = odds / F.sqrt(1 / (a + 0.5) + 1 / (n1 - a + 0.5) + 1 / (b + 0.5) + 1 / (n0 - b + 0.5))
        best = counts.where(a + b >= 5).orderBy(F.abs(z).desc(), "term").limit(n_terms // len(categories))
        chosen += [bytes(r["term"]) for r in best.select("term").collect()]
    return tuple(dict.fromkeys(chosen))


def fit_chain(
    documents: DataFrame,
    labels: DataFrame,
    categories: Sequence[str],
    id_col: str = "document_id",
    text: str = "text",
    max_train_rows: int = MAX_TRAIN_ROWS,
    n_terms: int = N_TERMS,
    folds: int = N_FOLDS,
) -> ChainModel:
    """Fit the chain on a bounded sample of labelled rows.

    ``labels`` has ``id_col`` and one 0/1 column for each category, in the order
    of the chain. At most ``max_train_rows`` labelled rows are used, the first
    by a hash of the id, so that only bounded data reach the driver: the chosen
    terms and one dense row for each sampled document. Rows with a null label of
    a category are left out for that category; repeated label rows count once.
    A category with fewer than two rows of either kind gets its base rate.
    """
    cats = tuple(categories)
    chosen = (
        labels.where(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(*[F.max(F.col(c).cast("double")).alias(c) for c in cats])
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_train_rows)
    )
    sample = stored(
        documents.select(F.col(id_col).alias("_id"), F.col(text).alias("text"))
        .join(F.broadcast(stored(chosen)), "_id")
        .groupBy("_id", *cats)
        .agg(F.min("text").alias("text"))
    )
    terms = _terms(sample, cats, n_terms)
    index = {t: 1 + N_STYLE + j for j, t in enumerate(terms)}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [features(t, index).astype(np.float32) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("_id"), pa.array(x, pa.list_(pa.float32()))] + [batch.column(c) for c in cats],
            ["_id", "x", *cats],
        )

    kind = sample.schema["_id"].dataType.simpleString()
    rows = map_batches(sample, run, f"_id {kind}, x array<float>, " + ", ".join(f"{c} double" for c in cats)).orderBy("_id").toArrow()
    width = 1 + N_STYLE + len(terms)
    x = np.concatenate([c.flatten().to_numpy() for c in rows["x"].chunks] or [np.zeros(0)]).reshape(-1, width).astype(float)
    fold = np.arange(len(x)) % folds
    weights = []
    for c in cats:
        y = rows[c].to_numpy().astype(float)
        known = ~np.isnan(y)
        if (y[known] == 1).sum() < 2 or (y[known] == 0).sum() < 2:
            w = np.zeros(x.shape[1])
            w[0] = _logit((np.nansum(y) + 0.5) / (known.sum() + 1.0))
            weights.append(w)
            x = np.column_stack([x, np.full(len(x), w[0])])
            continue
        out = np.zeros(len(x))
        for k in range(folds):
            train = known & (fold != k)
            out[fold == k] = x[fold == k] @ fit_logistic(x[train], y[train])
        weights.append(fit_logistic(x[known], y[known]))
        x = np.column_stack([x, np.clip(out, -8, 8)])
    return ChainModel(cats, terms, tuple(weights))


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def predict_chain(documents: DataFrame, model: ChainModel, text: str = "text") -> DataFrame:
    """Add ``p_<category>`` (double) for each category of the chain.

    One map over the whole texts, no shuffle; all other columns are carried
    along, and those of the added names replaced. Null and empty texts are
    scored as texts without words.
    """
    index = {t: 1 + N_STYLE + j for j, t in enumerate(model.terms)}
    names = [f"p_{c}" for c in model.categories]
    kept = documents.drop(*names)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.stack([features(t, index) for t in batch.column(text).to_pylist()])
        found = []
        for w in model.weights:
            f = np.clip(x @ w, -8, 8)
            found.append(pa.array(1 / (1 + np.exp(-f))))
            x = np.column_stack([x, f])
        return pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, *names])

    # quoted, as a carried column may have any name
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"`{n}` double" for n in names])
    return map_batches(kept, run, schema)


def flag(model: ChainModel, category: str, threshold: float = 0.5) -> Column:
    assert category in model.categories
    return F.col(f"p_{category}") >= threshold
