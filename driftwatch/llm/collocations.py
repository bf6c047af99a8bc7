"""Phrase collocations of watched texts, by multikey quicksort of suffix pointers.

A suffix is the run of at most four words that starts at a word of a piece.
Suffixes are routed globally by their leading words, and a task sorts the
pointers to its suffixes by three-way partitions, word by word: the pointers
equal to the pivot go on to their next word, and the size of such an equal
partition is the count of its phrase. Partitions smaller than the least count
are abandoned, sorted no further. Nothing else is sorted or counted.

A leading word or phrase so common that its suffixes would crowd one task is
routed by one word more. Counts of such hot phrases are sums over the routes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.llm.common import BITMAP_BITS, marks, stored

LONGEST, LEAST, TOP = 4, 30, 2000
NO_LANG = "und"
# Bytes no UTF-8 text holds: end of a piece, end of a text.
PIECE, TEXT = b"\xfe", b"\xff"
_TO_PIECES = bytes(PIECE[0] if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b for b in range(256))
SLICE = 4 << 20
FLUSH = 500_000
# Suffixes of one task; a phrase leads too many of them if it occurs a quarter as often.
ROUTE_SUFFIXES = 1 << 20
# A leading phrase seen this often in a slice may be hot.
LOCAL_HOT = 8
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], list[str]]]:
    """Texts as bytes with their languages, in slices of bounded size; a longer text is cut between two pieces."""
    texts, langs, size = [], [], 0
    for t, lang in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
        t = (t or b"").lower().translate(_TO_PIECES)
        at = 0
        while at < len(t):
            end = t.find(PIECE, at + SLICE) if len(t) - at > SLICE else len(t)
            end = len(t) if end < 0 else end
            texts.append(t[at:end])
            langs.append(lang)
            size += end - at
            at = end
            if size >= SLICE:
                yield texts, langs
                texts, langs, size = [], [], 0
    if texts:
        yield texts, langs


class _Slice:
    """The words of a slice as codes of its distinct words, with their languages and pieces."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        joined = (b" " + TEXT + b" ").join(texts).replace(PIECE, b" " + PIECE + b" ")
        found = pa.array(joined.split(), pa.binary()).dictionary_encode()
        self.names = found.dictionary
        self.values = self.names.to_pylist()
        code = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        kind = np.array([1 if v == PIECE else 2 if v == TEXT else 0 for v in self.values], np.int8)
        kind = kind[code] if len(code) else np.zeros(0, np.int8)
        self.langs = sorted(set(langs))
        number = {x: i for i, x in enumerate(self.langs)}
        lang = np.array([number[x] for x in langs], np.int64)[np.cumsum(kind == 2)]
        piece, word = np.cumsum(kind > 0), kind == 0
        self.code, self.lang, self.piece = code[word], lang[word], piece[word]
        self.hashes, self.lang_hashes = word_hashes(self.values), word_hashes([x.encode() for x in self.langs])

    def suffixes(self, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, counts): distinct sorted rows (language, word, ..., word) with their counts; -1 after an end.

        A suffix ends with its piece or before a word that is not ``common``;
        suffixes of one word are left out.
        """
        n, code = len(self.code), self.code
        rows = np.full((n, LONGEST + 1), -1, np.int64)
        rows[:, 0], rows[:, 1] = self.lang, code
        start = np.flatnonzero(common[code])
        for k in range(1, LONGEST):
            start = start[start < n - k]
            start = start[common[code[start + k]] & (self.piece[start + k] == self.piece[start])]
            rows[start, k + 1] = code[start + k]
        rows = rows[rows[:, 2] >= 0]
        # equal suffixes of a slice become one pointer with a weight
        wide = np.int64(len(self.values) + 1)
        front = (rows[:, 0] * wide + rows[:, 1] + 1) * wide + rows[:, 2] + 1
        back = (rows[:, 3] + 1) * wide + rows[:, 4] + 1
        order = np.lexsort((back, front))
        front, back = front[order], back[order]
        new = np.ones(len(order), bool)
        new[1:] = (front[1:] != front[:-1]) | (back[1:] != back[:-1])
        first = np.flatnonzero(new)
        return rows[order[first]], np.diff(np.append(first, len(order)))

    def frequent_leads(self, least: int) -> Iterator[tuple[int, int]]:
        """(hash, n) of the phrases of one to three words seen ``least`` times or more in the slice."""
        h = self.lang_hashes[self.lang]
        start = np.arange(len(self.code))
        for k in range(LONGEST - 1):
            if k:
                near = start + k < len(self.code)
                start, h = start[near], h[near]
                near = self.piece[start + k] == self.piece[start]
                start, h = start[near], h[near]
            h = (h ^ (h >> np.uint64(29))) * _MUL + self.hashes[self.code[start + k]]
            lead, where, n = np.unique(h, return_inverse=True, return_counts=True)
            big = n >= least
            yield from zip(lead[big].view(np.int64).tolist(), n[big].tolist())
            # no longer phrase is more frequent
            start, h = start[big[where]], h[big[where]]

    def lead_hashes(self, rows: np.ndarray) -> np.ndarray:
        return lead_hashes(rows, self.lang_hashes, self.hashes)


def word_hashes(values: list[bytes]) -> np.ndarray:
    """The hash Spark has for the same strings."""
    return np.array([xxhash.xxh64_intdigest(v, 42) for v in values], np.uint64)


def lead_hashes(rows: np.ndarray, langs: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes (long) of the first one to four words of each row, with its language."""
    out = np.empty((len(rows), LONGEST), np.uint64)
    h = langs[rows[:, 0]] if len(rows) else np.zeros(0, np.uint64)
    for k in range(LONGEST):
        h = (h ^ (h >> np.uint64(29))) * _MUL + words[rows[:, k + 1]] if len(rows) else h
        out[:, k] = h
    return out.view(np.int64)


def _hot_leads(keys: np.ndarray, langs: np.ndarray, words: np.ndarray, hot: bytes) -> np.ndarray:
    """Mask like ``keys``: is the phrase from the first word to this one hot? A language is if one of its words is."""
    found = np.zeros(keys.shape, bool)
    some = np.arange(len(keys))
    h = langs[keys[:, 0]]
    for k in range(1, LONGEST):
        h = (h ^ (h >> np.uint64(29))) * _MUL + words[keys[some, k]]
        # only what follows a hot phrase can be hot
        still = _bits(hot, h) & (keys[some, k] >= 0)
        some, h = some[still], h[still]
        found[some, k] = True
    found[:, 0] = found[:, 1]
    return found


def _bits(bitmap: bytes, hashes: np.ndarray) -> np.ndarray:
    at = hashes.view(np.int64) % BITMAP_BITS
    return (np.frombuffer(bitmap, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _bitmap(rows: DataFrame, hashed: str) -> bytes:
    """Bits of the hashes of a column, 8 MB however many rows there are."""
    bits = bytearray(BITMAP_BITS // 8)
    for r in marks(rows, hashed).toLocalIterator():
        at = (r["_bucket"] - 1) * len(r["_bits"])
        bits[at : at + len(r["_bits"])] = r["_bits"]
    return bytes(bits)


def leading_counts(texts: DataFrame) -> DataFrame:
    """(lang, word binary, lead long, n) of whole texts (text, lang), combined in the task before the shuffle.

    Rows with a ``word`` are its counts. The others give, by the hash of a
    leading phrase of one to three words, its occurrences in those slices where
    it has at least ``LOCAL_HOT``: these only decide routes.
    """

    def out(seen: Counter) -> pa.RecordBatch:
        lead = [k[2] for k in seen]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.binary()),
                pa.array(lead, pa.int64()), pa.array(list(seen.values()), pa.int64()),
            ],
            ["lang", "word", "lead", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for some in _slices(batch):
                s = _Slice(*some)
                if not len(s.code):
                    continue
                key, n = np.unique(s.lang * len(s.values) + s.code, return_counts=True)
                for k, v in zip(key.tolist(), n.tolist()):
                    lang, code = divmod(k, len(s.values))
                    seen[s.langs[lang], s.values[code], None] += v
                for h, v in s.frequent_leads(LOCAL_HOT):
                    seen[None, None, h] += v
                if len(seen) > FLUSH:
                    yield out(seen)
                    seen.clear()
        if seen:
            yield out(seen)

    made = texts.mapInArrow(run, "lang string, word binary, lead long, n long")
    return made.groupBy("lang", "word", "lead").agg(F.sum("n").alias("n"))


def routed_suffixes(texts: DataFrame, common: Broadcast, hot: Broadcast) -> DataFrame:
    """(route long, lang, suffix binary, n long): distinct suffixes of each slice of the texts (text, lang).

    ``common`` and ``hot`` are bitmaps of the words that may be frequent and of
    the leading phrases that are hot. A bit set for nothing costs time, not
    truth. A suffix is routed by its shortest leading phrase that is not hot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _slices(batch):
                s = _Slice(*some)
                rows, n = s.suffixes(_bits(common.value, s.hashes))
                heads = s.lead_hashes(rows)
                route, deeper = heads[:, 0].copy(), np.ones(len(rows), bool)
                for k in range(1, LONGEST):
                    deeper &= _bits(hot.value, heads[:, k - 1]) & (rows[:, k + 1] >= 0)
                    route[deeper] = heads[deeper, k]
                words = [s.names.take(pa.array(c, pa.int64(), mask=c < 0)) for c in rows[:, 1:].T]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(route), pa.array(s.langs, pa.string()).take(pa.array(rows[:, 0])),
                        pc.binary_join_element_wise(*words, b" ", null_handling="skip"), pa.array(n, pa.int64()),
                    ],
                    ["route", "lang", "suffix", "n"],
                )

    return texts.mapInArrow(run, "route long, lang string, suffix binary, n long")


def equal_partitions(
    keys: np.ndarray, weights: np.ndarray, least: int, spared: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Multikey three-way quicksort of pointers to the rows of ``keys``, all partitions of a round at once.

    ``keys`` holds a code for each depth, -1 after the end of a row. Yields
    (rows, depth, sizes) of equal partitions: a row for each, and the summed
    weights of the rows that agree with it on the first ``depth`` codes.
    Partitions whose sum is below ``least`` are abandoned, unless they hold a
    row marked in ``spared`` (a mask like ``keys``) at the depth just compared.
    """
    n, last = len(keys), keys.shape[1] - 1
    flat = np.ascontiguousarray(keys.T, np.int32).reshape(-1)  # all codes of a depth side by side
    marked = None if spared is None or not spared.any() else np.ascontiguousarray(spared.T).reshape(-1)
    pointer = np.arange(n, dtype=np.int32)
    lengths = np.array([n] if n else [], np.int64)  # of the partitions, which lie one after the other
    depth = np.zeros(len(lengths), np.int64)
    while len(pointer):
        first = np.cumsum(lengths) - lengths
        where = np.repeat(depth * n, lengths) + pointer
        code = flat[where]
        pivot = np.median(np.stack([code[first], code[first + lengths // 2], code[first + lengths - 1]]), axis=0).astype(np.int32)
        pivot = np.repeat(pivot, lengths)
        less, more = code < pivot, code > pivot
        # stable split of each partition into less, equal and greater
        n_less, n_more = np.add.reduceat(less, first, dtype=np.int64), np.add.reduceat(more, first, dtype=np.int64)
        same = ~(less | more)
        moved = np.empty_like(pointer)
        counts = np.stack([n_less, lengths - n_less - n_more, n_more], axis=1)
        offset = (np.cumsum(counts) - counts.reshape(-1)).reshape(-1, 3)
        for k, mine in enumerate((less, same, more)):
            moved[_ranges(offset[:, k], counts[:, k])] = pointer[mine]
        pointer = moved
        which = np.flatnonzero(counts.reshape(-1))
        starts, lengths = offset.reshape(-1)[which], counts.reshape(-1)[which]
        at, equal, head = depth[which // 3], which % 3 == 1, pointer[starts]
        total = np.add.reduceat(weights[pointer], starts)
        keep = total >= least
        if marked is not None:
            keep |= np.maximum.reduceat(marked[np.repeat(at * n, lengths) + pointer], starts)
        whole = equal & (keys[head, at] >= 0)
        for d in np.unique(at[whole & keep]).tolist():
            mine = whole & keep & (at == d)
            yield head[mine], d + 1, total[mine]
        # equal pointers go on to their next word; those at an end or at full depth are sorted
        go = keep & np.where(equal, whole & (at < last), True)
        pointer = pointer[np.repeat(go, lengths)]
        lengths, depth = lengths[go], (at + equal)[go]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, start[1] ..., in one array."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def route_counts(suffixes: DataFrame, hot: Broadcast, least: int) -> DataFrame:
    """(lang, phrase binary, f): counts of phrases of two words or more in the suffixes of each task.

    A task holds the suffixes of its routes at once; their number is what the
    routes are cut for. Phrases below ``least`` are left out, but for hot ones,
    whose other suffixes are in other tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        lists = pc.split_pattern(table.column("suffix"), pattern=b" ").chunk(0)
        words = lists.values.dictionary_encode()
        langs = table.column("lang").chunk(0).dictionary_encode()
        code = words.indices.to_numpy(zero_copy_only=False)
        start = lists.offsets.to_numpy().astype(np.int64)
        length = np.diff(start)
        keys = np.full((len(length), LONGEST + 1), -1, np.int32)
        keys[:, 0] = langs.indices.to_numpy(zero_copy_only=False)
        for k in range(LONGEST):
            have = np.flatnonzero(length > k)
            keys[have, k + 1] = code[start[have] + k]
        spared = _hot_leads(
            keys, word_hashes([v.encode() for v in langs.dictionary.to_pylist()]), word_hashes(words.dictionary.to_pylist()), hot.value
        )
        for rows, depth, size in equal_partitions(keys, table.column("n").to_numpy(), least, spared):
            if depth < 3:  # a language, or a word, counted before
                continue
            names = [words.dictionary.take(pa.array(c)) for c in keys[rows, 1:depth].T]
            yield pa.RecordBatch.from_arrays(
                [
                    langs.dictionary.take(pa.array(keys[rows, 0])),
                    pc.binary_join_element_wise(*names, b" "), pa.array(size, pa.int64()),
                ],
                ["lang", "phrase", "f"],
            )

    return suffixes.mapInArrow(run, "lang string, phrase binary, f long")


def phrase_counts(texts: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of the phrases of one to four words seen ``least`` times or more, and (lang, n) of all words.

    ``texts`` has a ``text`` and a ``lang`` column; it is read twice.
    """
    spark = texts.sparkSession
    counted = stored(leading_counts(texts))
    words = counted.where("word IS NOT NULL")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    often = words.where(F.col("n") >= least)
    total = counted.where("word IS NOT NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    common = spark.sparkContext.broadcast(_bitmap(often.select(F.col("word").cast("string").alias("word")), "word"))
    crowds = counted.where(F.col("lead").isNotNull() & (F.col("n") >= ROUTE_SUFFIXES // 4))
    hot = spark.sparkContext.broadcast(_hash_bitmap(crowds))
    suffixes = routed_suffixes(texts, common, hot).repartition(1 + total // ROUTE_SUFFIXES, "route")
    longer = route_counts(suffixes, hot, least).groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    text = F.col("phrase").cast("string")
    both = often.select("lang", F.col("word").cast("string").alias("phrase"), F.lit(1).alias("k"), F.col("n").alias("f")).unionByName(
        longer.select("lang", text.alias("phrase"), F.size(F.split(text, " ")).alias("k"), "f")
    )
    return stored(both), totals


def _hash_bitmap(crowds: DataFrame) -> bytes:
    """Bits of leading phrases given by their hashes."""
    at = F.pmod(F.col("lead"), F.lit(BITMAP_BITS))
    bits = bytearray(BITMAP_BITS // 8)
    chunks = crowds.groupBy(F.bitmap_bucket_number(at + 1).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at + 1)).alias("_bits")
    )
    for r in chunks.toLocalIterator():
        start = (r["_bucket"] - 1) * len(r["_bits"])
        bits[start : start + len(r["_bits"])] = r["_bits"]
    return bytes(bits)


def score_phrases(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates among ``counts`` (lang, phrase, k, f), contained ones dropped.

    All arithmetic is in decimals of 38 digits, so it is exact.
    """
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    w = F.split("phrase", " ")
    candidates = counts.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), w.alias("w"))
    cuts = candidates.select(
        "lang", "phrase", "k", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    ).select(
        "lang", "phrase", "a", "cut",
        F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("left"),
        F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("right"),
    )
    part = counts.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("f"))
    with_left = cuts.join(part.withColumnRenamed("f", "l"), (F.col("lang") == F.col("_lang")) & (F.col("left") == F.col("_part"))).drop("_lang", "_part", "left")
    with_both = with_left.join(part.withColumnRenamed("f", "r"), (F.col("lang") == F.col("_lang")) & (F.col("right") == F.col("_part")))
    ratio = (F.lit(2_000_000).cast("decimal(7,0)") * wide("a")).alias("up"), (wide("l") + wide("r")).alias("down")
    scored = with_both.select("lang", "phrase", "a", "cut", "l", "r", *ratio).withColumn("score", F.expr("up div down"))
    worst = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("s"))
    # contiguous parts of at least two words of each longer candidate
    inside = candidates.where("k > 2").select(
        "lang",
        F.col("a").alias("longer"),
        F.explode(F.expr(
            "flatten(transform(sequence(2, k - 1), n -> transform(sequence(1, k - n + 1), i -> array_join(slice(w, i, n), ' '))))"
        )).alias("part"),
    )
    over = inside.groupBy(F.col("lang").alias("_lang"), F.col("part").alias("_part")).agg(F.max("longer").alias("longer"))
    free = F.coalesce(100 * wide("longer") < 80 * wide("a"), F.lit(True))
    return (
        worst.join(over, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_part")), "left")
        .where(free)
        .select("lang", "phrase", "a", "s.l", "s.r", "s.score")
    )


def mine_collocations(
    documents: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int | None = TOP
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of two to four words of each language of watched texts.

    Words are lower-cased (A-Z) runs without spaces and tabs, in pieces cut at
    sentence marks and line ends. ``a``, ``l`` and ``r`` count the phrase, its
    first and its other part at the lowest-scoring cut, ``n`` all words of the
    language; ``score`` is floor(2000000 a / (l + r)). Candidates occur
    ``least`` times or more; those that lie inside a longer one with four
    fifths of their count are dropped. Returns the ``top`` of each language by
    score, count and phrase (all with ``top=None``). The texts may be of any
    collection; a null language is ``und``; null and empty texts have no words;
    repeated rows all count; an empty table gives an empty result.
    """
    texts = documents.select(F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit(NO_LANG)).alias("lang"))
    counts, totals = phrase_counts(texts, least)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = score_phrases(counts).withColumn("rank", F.row_number().over(order))
    best = ranked if top is None else ranked.where(F.col("rank") <= top)
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")
    )
