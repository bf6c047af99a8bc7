"""Quality rules over watched documents, compiled into one projection.

Base counts and ratios are built-in expressions on the text alone: no user
function, no explode, no shuffle, so a plan is a scan and one projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.common import SPACES

SYMBOLS = "[#*$%&|<>]"
STOP_WORDS = (
    *("the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "be", "with", "a", "on", "by", "this"),
    *("le", "la", "les", "de", "des", "du", "un", "une", "et", "en", "est", "que", "pour", "dans", "sur"),
    *("der", "die", "das", "und", "zu", "den", "von", "mit", "ist", "nicht", "sich", "des", "ein", "auf"),
    *("el", "los", "las", "del", "que", "y", "con", "por", "para", "se", "no", "una", "su", "al"),
)


class Rule(NamedTuple):
    """Keep a document only if ``low <= measure <= high``; an open end is None."""

    measure: str
    low: float | None
    high: float | None


# Measures: any base count, and the ratios of `measures`.
RULES = (
    Rule("mean_word_length", 2.0, 15.0),
    Rule("symbol_ratio", None, 0.3),
    Rule("shout_ratio", None, 0.3),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("repeat_ratio", None, 0.5),
)


def word_array(text: Column) -> Column:
    # only the ends of a text can give an empty part, and only an all-blank text two
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


PLACE_BITS = 20


def repeated_window_words(items: Column) -> Column:
    """Words lying in a three-word window found twice or more in the array.

    Each window is one long: the upper bits of its hash, then its place. Once
    sorted, equal windows are neighbours. The words of neighbours with equal
    hash bits are compared; a text where they differ, or with more places than
    the bits hold, takes the slower way over the windows' own text.
    """
    room = 1 << PLACE_BITS

    def covered(starts: Column) -> Column:
        # starts ascend; each window adds the words that the one before it did not reach
        reach = F.greatest(F.size(starts) - 1, F.lit(0))
        gaps = F.zip_with(F.slice(starts, 2, reach), F.slice(starts, 1, reach), lambda b, a: F.least(b - a, F.lit(3)))
        return F.when(F.size(starts) == 0, F.lit(0)).otherwise(F.lit(3) + F.aggregate(gaps, F.lit(0), lambda s, g: s + g))

    def by_hash(w: Column) -> Column:
        n = F.size(w) - 2
        packed = F.transform(
            F.slice(w, 1, n),
            lambda a, i: F.xxhash64(a, w[i + 1], w[i + 2]).bitwiseAND(F.lit(-room)).bitwiseOR(i.cast("long")),
        )

        def twins(p: Column) -> Column:
            # pairs of places of neighbours with equal hash bits, in one long
            pairs = F.transform(
                F.slice(p, 2, F.size(p)),
                lambda x, i: F.when(
                    F.shiftright(x.bitwiseXOR(p[i]), PLACE_BITS) == 0,
                    x.bitwiseAND(F.lit(room - 1)) * room + p[i].bitwiseAND(F.lit(room - 1)),
                ),
            )
            return F.filter(pairs, lambda k: k.isNotNull())

        def places(k: Column) -> Column:
            high = F.transform(k, lambda x: F.shiftright(x, PLACE_BITS).cast("int"))
            low = F.transform(k, lambda x: x.bitwiseAND(F.lit(room - 1)).cast("int"))
            return F.array_sort(F.array_distinct(F.concat(high, low)))

        def differ(x: Column) -> Column:
            a, b = F.shiftright(x, PLACE_BITS).cast("int"), x.bitwiseAND(F.lit(room - 1)).cast("int")
            return (w[a] != w[b]) | (w[a + 1] != w[b + 1]) | (w[a + 2] != w[b + 2])

        return bind(
            bind(F.sort_array(packed), twins),
            lambda k: F.when(F.size(k) == 0, F.lit(0))
            .when(F.exists(k, differ), by_text(w))
            .otherwise(bind(places(k), covered)),
        )

    def by_text(w: Column) -> Column:
        placed = F.transform(
            F.slice(w, 1, F.size(w) - 2),
            lambda a, i: F.struct(F.concat_ws(" ", a, w[i + 1], w[i + 2]).alias("g"), i.alias("i")),
        )

        def starts(p: Column) -> Column:
            return F.filter(
                F.transform(
                    p,
                    lambda x, i: F.when(
                        F.coalesce(F.get(p, i + 1)["g"] == x["g"], F.lit(False))
                        | F.coalesce(F.get(p, i - 1)["g"] == x["g"], F.lit(False)),
                        x["i"],
                    ),
                ),
                lambda i: i.isNotNull(),
            )

        return bind(F.sort_array(placed), lambda p: bind(F.array_sort(starts(p)), covered))

    return bind(
        items,
        lambda w: F.when(F.size(w) < 3, F.lit(0)).when(F.size(w) > room, by_text(w)).otherwise(by_hash(w)),
    )


def measures(documents: DataFrame, text: str = "text", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """Add counts and ratios of each whole text; a null text counts as empty.

    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long) and
    ``mean_word_length, symbol_ratio, shout_ratio, stop_word_ratio,
    dup_line_ratio, repeat_ratio`` (double, 0 for a text without words).
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = documents.withColumn(
        "_q",
        bind(
            word_array(F.col(text)),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.regexp_replace(t, SPACES, "")).cast("long").alias("word_chars"),
                F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                bind(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))).alias("lines"),
                repeated_window_words(w).cast("long").alias("n_repeat_words"),
                F.regexp_count(t, F.lit("!")).alias("shouts"),
                F.size(F.filter(w, lambda x: x.isin(*dict.fromkeys(stop_words)))).alias("stops"),
            ),
        ),
    )
    q = F.col("_q")
    n = F.greatest(q["n_words"], F.lit(1)).cast("double")
    return counted.withColumns(
        {
            "n_words": q["n_words"],
            "word_chars": q["word_chars"],
            "n_symbols": q["n_symbols"],
            "n_dup_lines": q["lines"]["d"].cast("long"),
            "n_repeat_words": q["n_repeat_words"],
            "mean_word_length": q["word_chars"] / n,
            "symbol_ratio": q["n_symbols"] / n,
            "shout_ratio": q["shouts"] / n,
            "stop_word_ratio": q["stops"] / n,
            "dup_line_ratio": q["lines"]["d"] / F.greatest(q["lines"]["n"], F.lit(1)),
            "repeat_ratio": q["n_repeat_words"] / n,
        }
    ).drop("_q")


def passes(rules: Sequence[Rule] = RULES) -> Column:
    """The threshold table as one boolean expression over :func:`measures`."""
    verdict = F.lit(True)
    for r in rules:
        if r.low is not None:
            verdict = verdict & (F.col(r.measure) >= F.lit(r.low))
        if r.high is not None:
            verdict = verdict & (F.col(r.measure) <= F.lit(r.high))
    return verdict


def apply_quality_rules(
    documents: DataFrame,
    text: str = "text",
    rules: Sequence[Rule] = RULES,
    min_words: int = 50,
    max_repeat_percent: int = 50,
) -> DataFrame:
    """Every watched document with its counts, ``base_failed`` and ``kept``.

    ``documents`` holds one row for each document of a collection (say
    ``collection_name, document_id, text``); all its columns are carried along,
    and those named like a measure are replaced. ``base_failed``: fewer than
    ``min_words`` words, or more than ``max_repeat_percent`` in a hundred words
    in repeated three-word windows. ``kept``: neither that nor any rule of the
    table broken. A null or empty text has no words and fails; rows are judged
    one by one, so repeated rows get equal verdicts and an empty table none.
    """
    m = measures(documents, text)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return m.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & passes(rules))
