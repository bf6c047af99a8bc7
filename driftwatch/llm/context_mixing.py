"""Language-model scores of watched texts by online logistic context mixing.

Every token is coded as the eight bits of its class and then as itself within
the class. Each bit is predicted from several hashed contexts, whose counts are
gathered from all training texts; a gated set of weights mixes the predictions
in the logistic domain, learning online from bit to bit, and an adaptive table
refines the mixture. A token within its class has its smoothed share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.common import power_of_two, stored

BITS = 8
CLASSES = 1 << BITS
TOP_CLASSES = 192
TOP_TOKENS = 65_536
MOST_SLOTS = 1 << 20
# Code points of the texts held at once, and of those cut into tokens at once; texts mixed side by side.
SLICE = 20 << 20
PIECE = 2 << 20
LANES = 4096
# Longer texts are gathered, so that they are mixed side by side too.
LONG = 8192
GATHERED = 20 << 20
END = b"\n"  # no word holds white space
SMOOTH = 0.1
CHUNK = 4096
# contexts with a hashed table: the token before; the two classes before
HASHED = 2
_MUL = np.uint64(0x9E3779B97F4A7C15)
NODE = np.uint64(0x9E3779B1)
MOST_LOGIT = 8.0


class ContextModel(NamedTuple):
    """Bounded parts of the model, sent to the tasks; the counts of rarer tokens stay a table."""

    top: dict[bytes, int]  # token -> rank
    top_counts: np.ndarray
    rank_class: np.ndarray
    class_log_mass: np.ndarray  # log10 of the smoothed count of each class
    tables: tuple[np.ndarray, ...]  # logit of each slot: order 0, order 1, hashed
    slots: int
    train_tokens: int
    log_total: float


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts as binary, one text after the other; the text of each): A-Z in lower case, cut at ASCII white space."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    tokens = lists.flatten().cast(pa.large_binary() if pa.types.is_large_string(lists.type.value_type) else pa.binary())
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    # white space at either end leaves an empty piece
    real = pc.greater(pc.binary_length(tokens), 0)
    return tokens.filter(real), row[real.to_numpy(zero_copy_only=False)]


def token_counts(texts: DataFrame, flush: int = 1_000_000) -> DataFrame:
    """(token binary, n long) over whole texts, one end for each text; combined in the task, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[pa.Table] = []
        added = 0

        def summed() -> pa.Table:
            return pa.concat_tables(seen).group_by("token").aggregate([("n", "sum")]).rename_columns(["token", "n"])

        for batch in batches:
            for start, end in _slices(batch.column(0), PIECE):
                words = pc.value_counts(_tokens(batch.column(0).slice(start, end - start))[0])
                seen.append(pa.table({"token": words.field(0).cast(pa.binary()), "n": words.field(1)}))
                seen.append(pa.table({"token": pa.array([END], pa.binary()), "n": pa.array([end - start], pa.int64())}))
                added += len(words)
                if added > flush // 2:
                    seen[:], added = [summed()], 0
                    if len(seen[0]) > flush:
                        yield from seen.pop().to_batches()
        if seen:
            yield from summed().to_batches()

    return texts.mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def tail_class(token: bytes) -> int:
    return int(tail_classes([token])[0])


def tail_classes(tokens: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh32_intdigest
    return TOP_CLASSES + np.array([digest(t) for t in tokens], np.int64) % (CLASSES - TOP_CLASSES)


class Ranked(NamedTuple):
    """Texts of a slice one after the other, an end after each: ranks of the tokens, and those outside the top."""

    ids: np.ndarray  # a token outside the top has a number past it, by its class
    size: np.ndarray  # tokens of each text, its end included
    rare: pa.Array  # the distinct tokens outside the top
    rare_row: np.ndarray  # text and place in ``rare`` of each token outside the top
    rare_at: np.ndarray


def _ranked(texts: pa.Array, top: pa.Array, end: int) -> Ranked:
    """``end`` is the rank of the end; without training texts it is the first number past the top."""
    tokens, row = _tokens(texts)
    size = np.bincount(row, minlength=len(texts)) + 1
    rank = pc.index_in(tokens, value_set=top.cast(tokens.type))
    found = pc.fill_null(rank, -1).to_numpy().astype(np.int32)
    outside = np.flatnonzero(found < 0)
    coded = tokens.take(pa.array(outside)).dictionary_encode()
    at = coded.indices.to_numpy()
    classes = tail_classes(coded.dictionary.to_pylist()).astype(np.int32)
    if len(outside):
        found[outside] = len(top) - TOP_CLASSES + classes[at]
    ids = np.full(size.sum(), end, np.int32)
    ids[np.arange(len(row)) + row] = found  # so many ends come before
    return Ranked(ids, size, coded.dictionary.cast(pa.binary()), row[outside], at)


def _top_array(top: dict[bytes, int]) -> tuple[pa.Array, int]:
    """The tokens in order of rank, and the rank of the end."""
    return pa.array(list(top), pa.binary()), top.get(END, len(top))


def _slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``most`` code points, or one longer text."""
    start, held = 0, 0
    for i, size in enumerate(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
        if held and held + size > most:
            yield start, i
            start, held = i, 0
        held += size + 1
    if start < len(texts):
        yield start, len(texts)


class Coded(NamedTuple):
    """Texts of a slice one after the other: a class and two hashed contexts for each token."""

    classes: np.ndarray  # uint8
    word: np.ndarray  # hash of the token before
    pair: np.ndarray  # hash of the two classes before
    offset: np.ndarray
    size: np.ndarray


def _joined(parts: list[Coded]) -> Coded:
    """Coded texts one part after the other."""
    classes, word, pair, _, size = (np.concatenate(x) for x in zip(*parts))
    return Coded(classes, word, pair, np.cumsum(size) - size, size)


def _coded(parts: list[np.ndarray], rank_class: np.ndarray) -> Coded:
    return _in_context(np.concatenate(parts), np.array([len(p) for p in parts], np.int64), rank_class)


def _in_context(ids: np.ndarray, size: np.ndarray, rank_class: np.ndarray) -> Coded:
    offset = np.cumsum(size) - size
    c = rank_class[ids].astype(np.uint8)
    word = np.zeros(len(ids), np.uint64)
    word[1:] = ids[:-1].astype(np.uint64) + np.uint64(1)
    word[offset] = 0
    pair = np.zeros(len(ids), np.uint64)
    pair[2:] = (c[1:-1].astype(np.uint64) << np.uint64(BITS)) | c[:-2].astype(np.uint64)
    pair[offset] = 0
    pair[(offset + 1)[size > 1]] = 0
    pair += np.uint64(1 << 40)
    return Coded(c, _short(word), _short(pair), offset, size)


def _short(context: np.ndarray) -> np.ndarray:
    return ((context * _MUL) >> np.uint64(20)).astype(np.uint32)


def _slot(h: np.ndarray, node: np.ndarray, slots: int) -> np.ndarray:
    return ((h + node.astype(np.uint64) * NODE) & np.uint64(slots - 1)).astype(np.int64)


def bit_counts(texts: DataFrame, top, rank_class, slots: int) -> DataFrame:
    """(table int, chunk int, zeros binary, ones binary): bit counts of each context slot over the texts.

    A task counts into tables of fixed size and hands on the chunks it touched.
    """
    shared = texts.sparkSession.sparkContext.broadcast((top, rank_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, rank_class = shared.value
        top, last = _top_array(top)
        sizes = (CLASSES, CLASSES * CLASSES, *[slots] * HASHED)
        counts = [np.zeros((2, max(s, CHUNK)), np.uint32) for s in sizes]
        for batch in batches:
            for start, end in _slices(batch.column(0), PIECE):
                ranked = _ranked(batch.column(0).slice(start, end - start), top, last)
                coded = _in_context(ranked.ids, ranked.size, rank_class)
                c = coded.classes.astype(np.int64)
                before = np.zeros_like(c)
                before[1:] = c[:-1]
                before[coded.offset] = 0
                # without a hash, classes are counted once and added up along the tree of their bits
                pairs = np.bincount(before << BITS | c, minlength=CLASSES * CLASSES).reshape(CLASSES, CLASSES)
                for b in range(BITS):
                    each = pairs.reshape(CLASSES, 1 << b, 2, -1).sum(axis=3).astype(np.uint32)
                    nodes = (1 << b) + np.arange(1 << b)
                    for bit in range(2):
                        counts[0][bit, nodes] += each[:, :, bit].sum(axis=0, dtype=np.uint32)
                        counts[1][bit].reshape(CLASSES, CLASSES)[:, nodes] += each[:, :, bit]
                    node = (1 << b) | (c >> (BITS - b))
                    bit = (c >> (BITS - 1 - b)) & 1
                    for table, h in zip(counts[2:], (coded.word, coded.pair)):
                        at = _slot(h, node, slots) + bit * table.shape[1]
                        np.add.at(table.reshape(-1), at, np.uint32(1))
        for k, table in enumerate(counts):
            for at in range(0, table.shape[1], CHUNK):
                zeros, ones = table[0, at : at + CHUNK], table[1, at : at + CHUNK]
                if zeros.any() or ones.any():
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([k], pa.int32()),
                            pa.array([at // CHUNK], pa.int32()),
                            pa.array([zeros.tobytes()], pa.binary()),
                            pa.array([ones.tobytes()], pa.binary()),
                        ],
                        ["table", "chunk", "zeros", "ones"],
                    )

    made = texts.mapInArrow(run, "table int, chunk int, zeros binary, ones binary")
    # two levels, so that a chunk's parts from all tasks never queue in one
    salted = made.withColumn("salt", F.spark_partition_id() % 16)
    first = _add_up(salted, ["table", "chunk", "salt"])
    return _add_up(first, ["table", "chunk"])


def _add_up(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of the count chunks with equal keys, streamed over sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None

        def out() -> pa.RecordBatch:
            data = [np.minimum(s, 2**32 - 1).astype(np.uint32).tobytes() for s in sums]
            return pa.RecordBatch.from_arrays(
                [*[pa.array([v], pa.int32()) for v in now], *[pa.array([d], pa.binary()) for d in data]], [*keys, "zeros", "ones"]
            )

        for batch in batches:
            for *key, zeros, ones in zip(*[batch.column(c).to_pylist() for c in (*keys, "zeros", "ones")]):
                if key != now:
                    if now is not None:
                        yield out()
                    now, sums = key, [np.zeros(CHUNK, np.uint64), np.zeros(CHUNK, np.uint64)]
                sums[0] += np.frombuffer(zeros, np.uint32)
                sums[1] += np.frombuffer(ones, np.uint32)
        if now is not None:
            yield out()

    kind = ", ".join(f"{k} int" for k in keys)
    dealt = rows.select(*keys, "zeros", "ones").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, f"{kind}, zeros binary, ones binary")


def fit_context_model(texts: DataFrame, counts: DataFrame) -> ContextModel:
    """The bounded parts of the model from training ``texts`` (one text column) and their token ``counts``.

    The 65,536 most frequent tokens get ranks, and classes of even mass in order
    of rank; any other token's class comes from its hash. Context tables grow
    with the corpus, a slot for every sixteen tokens, up to 2**20 slots.
    """
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    best = counts.orderBy(F.col("n").desc(), "token").limit(TOP_TOKENS).collect()
    top = {bytes(r["token"]): k for k, r in enumerate(best)}
    n = np.array([r["n"] for r in best], float)
    smoothed = n + SMOOTH
    mass = smoothed.sum() or 1.0
    ranks = np.minimum(((np.cumsum(smoothed) - smoothed) / mass * TOP_CLASSES).astype(np.int64), TOP_CLASSES - 1)
    rank_class = np.concatenate([ranks, np.arange(TOP_CLASSES, CLASSES)])
    class_mass = np.zeros(CLASSES)
    np.add.at(class_mass, ranks, smoothed)
    # the unknown token of each hashed class has the smoothing mass
    class_mass[TOP_CLASSES:] += SMOOTH
    if kinds > len(best):
        last = best[-1]
        rest = counts.where((F.col("n") < last["n"]) | ((F.col("n") == last["n"]) & (F.col("token") > F.lit(last["token"]))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros(CLASSES)
            for batch in batches:
                np.add.at(held, tail_classes(batch.column(0).to_pylist()), batch.column(1).to_numpy() + SMOOTH)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES), pa.int32()), pa.array(held)], ["class", "mass"])

        masses = rest.select("token", "n").mapInArrow(run, "class int, mass double").groupBy("class").agg(F.sum("mass").alias("mass"))
        for r in masses.collect():
            class_mass[r["class"]] += r["mass"]
    if END not in top:  # without training texts
        class_mass[TOP_CLASSES] += SMOOTH
    slots = power_of_two(total / 16, 1 << 14, MOST_SLOTS)
    sizes = (CLASSES, CLASSES * CLASSES, *[slots] * HASHED)
    tables = [np.zeros(max(s, CHUNK), np.float32) for s in sizes]
    for r in bit_counts(texts, top, rank_class, slots).toLocalIterator():
        zeros, ones = (np.frombuffer(r[c], np.uint32).astype(np.float64) for c in ("zeros", "ones"))
        tables[r["table"]][r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.clip(
            np.log((ones + 0.4) / (zeros + 0.4)), -MOST_LOGIT, MOST_LOGIT
        )
    with np.errstate(divide="ignore"):
        log_mass = np.log10(class_mass)
    return ContextModel(
        top, n, rank_class, log_mass, tuple(tables), slots, int(total), math.log10(total + SMOOTH * (kinds + 1))
    )


class Scorer:
    """Sums of log10 bit probabilities of many texts at once, one lane each."""

    rate, forget = np.float32(0.02), np.float32(1 / 24)
    start = np.array([0.1, 0.35, 0.45, 0.25, 0.1], np.float32)  # weights before any learning

    def __init__(self, model: ContextModel):
        self.model = model
        self.steps = np.linspace(-8, 8, 17, dtype=np.float32)

    def __call__(self, coded: Coded) -> np.ndarray:
        """log10 probability of the classes of each text."""
        out = np.zeros(len(coded.size))
        order = np.argsort(-coded.size, kind="stable")
        for at in range(0, len(order), LANES):
            some = order[at : at + LANES]
            out[some] = self._lanes(coded, coded.offset[some], coded.size[some])
        return out

    def _lanes(self, coded: Coded, offset: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Lanes come longest first, so at each step the running ones are a prefix."""
        m, n, longest = self.model, len(sizes), int(sizes[0])
        running = np.searchsorted(-sizes, -np.arange(longest), side="left")
        inputs = len(self.start)
        # one block for each bit, so that a bit's state is contiguous; lanes lie side by side
        weights = np.tile(self.start[None, :, None], (BITS, 1, n))
        own = np.zeros(CLASSES * n, np.float32)  # the lane's own bits: probability less a half
        refined = np.tile((1 / (1 + np.exp(-self.steps)))[:, None], (BITS, 1, n)).reshape(BITS, -1)
        score = np.zeros(n)
        lane = np.arange(n)
        mask = np.uint64(m.slots - 1)
        nodes = np.arange(CLASSES, dtype=np.uint64) * NODE
        half, one = np.float32(0.5), np.float32(1)
        take = np.take
        previous = np.zeros(n, np.int64)
        for t in range(longest):
            a = running[t]
            place = offset[:a] + t
            c = take(coded.classes, place).astype(np.int64)
            h1, h2 = take(coded.word, place).astype(np.uint64), take(coded.pair, place).astype(np.uint64)
            base = previous[:a] << BITS
            previous = c
            who = lane[:a]
            node = np.ones(a, np.int64)
            gained = np.ones(a, np.float32)
            x = np.empty((inputs, a), np.float32)
            part, dot, p, final, slip = (np.empty((inputs, a), np.float32), *np.empty((4, a), np.float32))
            low, at = np.empty((2, a), np.int64)
            for b in range(BITS):
                bit = (c >> (BITS - 1 - b)) & 1
                target = bit.astype(np.float32)
                spread = take(nodes, node)
                take(m.tables[0], node, out=x[0], mode="clip")
                take(m.tables[1], base | node, out=x[1], mode="clip")
                take(m.tables[2], ((h1 + spread) & mask).view(np.int64), out=x[2], mode="clip")
                spread += h2
                spread &= mask
                take(m.tables[3], spread.view(np.int64), out=x[3], mode="clip")
                np.multiply(node, n, out=at)
                at += who
                memory = take(own, at)
                np.multiply(memory, np.float32(6), out=x[4])
                w = weights[b, :, :a]
                # added up in a fixed order, so that a text scores alike beside any others
                np.multiply(w, x, out=part)
                np.add(part[0], part[1], out=dot)
                for k in range(2, inputs):
                    dot += part[k]
                np.clip(dot, -7.9, 7.9, out=dot)
                np.negative(dot, out=p)
                np.exp(p, out=p)
                p += one
                np.divide(one, p, out=p)
                # the refining table: probabilities at fixed logits, read between its two nearest entries
                dot += np.float32(8)
                low[:] = dot
                dot -= low
                low *= n
                low += who
                table = refined[b]
                left, right = take(table, low), take(table, low + n)
                np.subtract(right, left, out=final)
                final *= dot
                final += left
                final *= np.float32(0.25)
                final += p * np.float32(0.75)
                np.clip(final, 1e-4, 1 - 1e-4, out=final)
                # the probability of the bit that came: 1 - |target - final|
                np.subtract(target, final, out=final)
                np.abs(final, out=final)
                np.subtract(one, final, out=final)
                gained *= final
                np.subtract(target, p, out=slip)
                slip *= self.rate
                x *= slip
                w += x
                close = dot > half
                nearest = np.where(close, right, left)
                low += close * n
                table[low] = nearest + (target - nearest) * np.float32(0.03)
                target -= half
                target -= memory
                target *= self.forget
                target += memory
                own[at] = target
                node <<= 1
                node |= bit
            score[:a] += np.log10(gained)
        return score


def score_texts(
    documents: DataFrame, id_col: str = "document_id", text: str = "text", train: str = "train"
) -> DataFrame:
    """(id_col, train, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of each whole text.

    Learns from the rows of a watched collection whose boolean column ``train``
    is true. ``score`` and ``base_score`` are log10 probabilities by the context
    model and by smoothed token counts alone; ``n_known`` counts tokens seen in
    training. All training texts are counted, and counts of tokens beyond the
    65,536 most frequent are joined as a table. A null or empty text is its end
    alone. Each row is scored by itself, also those with equal or null ids.
    Without training rows every token is unknown; an empty table gives an empty
    result. Adaptation goes on over the whole of a text, however long.
    """
    id_type = documents.schema[id_col].dataType.simpleString()
    docs = documents.select(F.col(id_col).alias("id"), F.col(text).alias("t"), F.coalesce(F.col(train), F.lit(False)).alias("train"))
    texts = docs.where("train").select("t")
    counts = stored(token_counts(texts))
    model = fit_context_model(texts, counts)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    most, piece = SLICE, PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = ContextModel(*shared.value)
        scorer = Scorer(m)
        top_log = np.concatenate([np.log10(m.top_counts + SMOOTH), np.zeros(len(m.rank_class) - len(m.top_counts))])
        no_end = END not in m.top
        top, last = _top_array(m.top)

        def looked_at(texts: pa.Array) -> tuple[Coded, np.ndarray, pa.Array, pa.Array, pa.Array]:
            """(coded texts, log10 of shares within the classes, base scores, known tokens, rare tokens)"""
            ids, size, rare, row, at = _ranked(texts, top, last)
            coded = _in_context(ids, size, m.rank_class)
            fixed = -np.add.reduceat(m.class_log_mass[m.rank_class[ids]], coded.offset)
            base = np.add.reduceat(top_log[ids], coded.offset) + (math.log10(SMOOTH) if no_end else 0.0)
            known = size - np.bincount(row, minlength=len(size)) - no_end
            # each rare token once a text, with its count
            each, times = np.unique(row * max(1, len(rare)) + at, return_counts=True)
            where, which = np.divmod(each, max(1, len(rare)))
            ends = np.concatenate([[0], np.cumsum(np.bincount(where, minlength=len(size)))])
            pairs = pa.StructArray.from_arrays([rare.take(pa.array(which)), pa.array(times, pa.int64())], ["token", "k"])
            tails = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            return coded, fixed, pa.array(base, pa.float64()), pa.array(known, pa.int64()), tails

        for batch in batches:
            for start, end in _slices(batch.column(1), most):
                some = batch.slice(start, end - start)
                # tokens are large until they are coded, so few texts are cut at once; all of the slice are mixed side by side
                cuts = _slices(some.column(1), piece)
                parts, fixed, base, known, tails = zip(*[looked_at(some.column(1).slice(a, b - a)) for a, b in cuts])
                coded = _joined(parts)
                bytes_ = pc.fill_null(pc.binary_length(some.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0), some.column(2), pa.array(coded.size), pa.concat_arrays(known), pa.concat_arrays(base),
                        pa.array(scorer(coded) + np.concatenate(fixed)), bytes_, pa.concat_arrays(tails),
                    ],
                    ["id", "train", "n_tokens", "known", "base", "bits", "bytes", "tails"],
                )

    # long texts of all partitions meet in few tasks, ordered by length, and are mixed side by side
    is_long = F.coalesce(F.length("t") > LONG, F.lit(False))
    total = docs.where(is_long).agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    gathered = docs.where(is_long).repartitionByRange(1 + total // GATHERED, F.length("t")).sortWithinPartitions(F.length("t"))
    docs = docs.where(~is_long).unionByName(gathered)
    scored = docs.mapInArrow(
        run,
        f"id {id_type}, train boolean, n_tokens long, known long, base double, bits double, bytes long, "
        "tails array<struct<token:binary,k:long>>",
    )
    # numbered when stored, so that rows with equal ids stay apart
    made = stored(scored.withColumn("row", F.monotonically_increasing_id()))
    rare = made.select("row", F.explode("tails").alias("x")).select("row", "x.token", "x.k")
    looked_up = rare.join(counts, "token", "left").groupBy("row").agg(
        F.sum(F.col("k") * F.log10(F.coalesce(F.col("n"), F.lit(0)) + SMOOTH)).alias("rare_log"),
        F.coalesce(F.sum(F.when(F.col("n").isNotNull(), F.col("k"))), F.lit(0)).alias("rare_known"),
    )
    logs = F.col("base") + F.coalesce("rare_log", F.lit(0.0))
    score = logs + F.col("bits")
    return made.drop("tails").join(looked_up, "row", "left").select(
        F.col("id").alias(id_col),
        "train",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(model.log_total)).alias("base_score"),
        score.alias("score"),
        (-score / math.log10(2) / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"),
    )
