"""Spelling variants among the words of watched documents, by PartEnum signatures.

One edit changes the letter multiset of a word, seen as a binary vector of
(letter, occurrence), by a Hamming distance of two at most. The dimensions are
dealt to a few parts; words at that distance agree exactly on one of the
enumerated subsets of parts, so their signatures meet in an equi-join. The edit
also leaves one half of the shorter word intact, at its start or at its end, and
that half is part of the signature, which keeps the groups small. Every pair
that meets is verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.common import forget, map_batches, stored

# Runs of letters A-Z, a-z and U+00C0 to U+00FF; every other code point is "?" after encoding.
RUN, GAP = re.compile(rb"[a-z\xc0-\xff]+"), re.compile(rb"[^a-z\xc0-\xff]")
SLICE = 1 << 22
FLUSH = 500_000
# (edits of the multiset, parts): a replaced letter, and an inserted or deleted one
REPLACED, RESIZED = (2, 4), (1, 2)
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _runs(text: str) -> Iterator[list[bytes]]:
    """The lower-cased runs of a whole text, one byte a code point, in bounded lists."""
    data = text.encode("latin-1", "replace").lower()
    at = 0
    while at < len(data):
        end = at + SLICE
        gap = GAP.search(data, end) if end < len(data) else None
        end = gap.start() if gap else len(data)
        yield RUN.findall(data[at:end])
        at = end


def word_counts(
    documents: DataFrame, id_col: str = "document_id", text: str = "text", noise: int = 31, shortest: int = 7
) -> DataFrame:
    """(word string, n long): words of at least ``shortest`` letters in all whole texts.

    A word is a run of letters, A-Z in lower case. If ``noise`` divides the
    CRC-32 h of ``<id>:<run>``, the run first loses its letter number h modulo
    its length; ``noise=0`` leaves all runs as they are. A null text has no
    words, a null id is written as nothing. Counts are combined in the task
    before the shuffle, so a word that is everywhere is one row of each task.
    """

    def changed(run: bytes, prefix: int) -> bytes:
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
        if h % noise:
            return run
        k = h % len(run)
        return run[:k] + run[k + 1 :]

    def out(seen: Counter) -> pa.RecordBatch:
        names = [w.decode("latin-1") for w in seen]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not t:
                    continue
                prefix = zlib.crc32(f"{'' if name is None else name}:".encode())
                for found in _runs(t):
                    for w, k in Counter(found).items():
                        if len(w) >= shortest:
                            w = changed(w, prefix) if noise else w
                            if len(w) >= shortest:
                                seen[w] += k
                    if len(seen) > FLUSH:
                        yield out(seen)
                        seen.clear()
        if seen:
            yield out(seen)

    named = documents.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("t"))
    return named.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _span_hash(letters: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hash of the letters from place ``low`` up to ``high`` of each row."""
    h = np.zeros(len(letters), np.uint64)
    for j in range(letters.shape[1]):
        h = np.where((j >= low) & (j < high), _mix(h * _MUL + letters[:, j] + np.uint64(1)), h)
    return h


def _part_sums(letters: np.ndarray, parts: int) -> np.ndarray:
    """For each word and part, a hash of the multiset's dimensions in the part."""
    ordered = np.sort(letters, axis=1)
    nth = np.zeros_like(ordered)
    for j in range(1, ordered.shape[1]):
        nth[:, j] = np.where(ordered[:, j] == ordered[:, j - 1], nth[:, j - 1] + np.uint64(1), np.uint64(0))
    dimension = (ordered << np.uint64(32)) | nth
    part = _mix(dimension * _MUL + np.uint64(parts)) % np.uint64(parts)
    value = np.where(ordered > 0, _mix(dimension + _MUL), np.uint64(0))
    return np.stack([np.where(part == p, value, np.uint64(0)).sum(axis=1, dtype=np.uint64) for p in range(parts)], axis=1)


def signatures(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(places, signatures): which word each signature belongs to.

    Two words of one length that differ in one letter, and two words of which
    one is the other with a letter more, have at least one signature in common.
    """
    length = np.array([len(w) for w in words], np.int64)
    widest = int(length.max())
    letters = np.frombuffer("".join(w.ljust(widest, "\0") for w in words).encode("utf-32-le"), np.uint32)
    letters = letters.reshape(len(words), widest).astype(np.uint64)
    place = np.arange(len(words))
    places, found = [], []
    # the shorter length of a pair: its own for a replaced letter; its own or one less for a resized word
    for kind, (edits, parts), shorter in ((0, REPLACED, (0,)), (1, RESIZED, (0, 1))):
        sums = _part_sums(letters, parts)
        for less in shorter:
            base = length - less
            half = base // 2
            intact = (
                _span_hash(letters, np.zeros_like(half), half),
                _span_hash(letters, length - (base - half), length),
            )
            for number, chosen in enumerate(combinations(range(parts), parts - edits)):
                agree = _mix(sums[:, list(chosen)].sum(axis=1, dtype=np.uint64) + np.uint64(2 * number + kind))
                for side, part in enumerate(intact):
                    places.append(place)
                    found.append(_mix(agree * _MUL + _mix(part + np.uint64(side)) + base.astype(np.uint64)))
    return np.concatenate(places), np.concatenate(found).view(np.int64)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n) for all pairs of ``words`` (word, n) that differ by exactly one edit, both ways.

    An edit inserts, deletes or replaces one code point. ``words`` should hold
    each word once; it is read once. A pair that meets under several signatures
    is given once. Long words need no care: only their signatures are shuffled
    with them. A signature that many words share is joined like any hot key:
    the adaptive skew join splits it.
    """

    def rows_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = batch.column(0)
        at, signature = signatures(names.to_pylist())
        at = pa.array(at)
        return pa.RecordBatch.from_arrays(
            [pa.array(signature, pa.int64()), names.take(at), batch.column(1).take(at)], ["signature", "word", "n"]
        )

    signed = map_batches(words.select("word", "n"), rows_of, "signature long, word string, n long")
    a, b = signed.alias("a"), signed.alias("b")
    met = a.join(b, (F.col("a.signature") == F.col("b.signature")) & (F.col("a.word") < F.col("b.word")))
    once = (
        met.where(F.levenshtein("a.word", "b.word", 1) == 1)
        .select(F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("near"), F.col("b.n").alias("near_n"))
        .distinct()
    )
    ways = F.explode(F.array(F.struct("word", "n", "near", "near_n"), F.struct(
        F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")
    )))
    return once.select(ways.alias("p")).select("p.*")


def follow_forms(forms: DataFrame) -> DataFrame:
    """(word, root): the last word reached from each word of ``forms`` (word, form).

    Each round jumps twice as far as the one before. Forms must not run in a
    circle; here each occurs at least ten times as often as its word.
    """
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        after = stored(now.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_went")))
        went = after.where("_went").limit(1).count()
        forget(now)
        now = after.drop("_went")
        if not went:
            return now


def spelling_variants(
    documents: DataFrame, id_col: str = "document_id", text: str = "text", noise: int = 31, shortest: int = 7,
    least: int = 2, times: int = 10,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of the texts of a watched collection.

    Words and ``noise`` are those of :func:`word_counts`; words seen fewer than
    ``least`` times are left out. ``n_near`` counts the words one edit away.
    ``form`` is the commonest of them (of equals the smallest in code-point
    order) if it occurs at least ``times`` times as often, else null, and
    ``root`` the last word reached by following forms. Rows with equal or null
    ids all count; null and empty texts have no words; an empty table gives an
    empty result. Extra columns are ignored.
    """
    words = stored(word_counts(documents, id_col, text, noise, shortest).where(F.col("n") >= least))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    known = words.join(near, "word", "left")
    form_n = -F.col("best.less")
    whole = stored(
        known.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(form_n >= times * F.col("n"), F.col("best.near")).alias("form"),
            F.when(form_n >= times * F.col("n"), form_n).alias("form_n"),
        )
    )
    roots = follow_forms(whole.where("form IS NOT NULL").select("word", "form"))
    return whole.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
