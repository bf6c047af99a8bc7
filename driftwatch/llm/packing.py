"""Packing texts into sequences of at most ``capacity`` tokens.

Tokenising is one map over the texts. Packing works on the lengths alone, in
shards of a bounded number of pieces: best fit by falling length, then a local
search that swaps pieces between underfull bins until some bins are empty.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.llm.common import map_batches
from driftwatch.session import bounded

CAPACITY = 2048
SHARD_ROWS = 4096
# order values whose counts are summed in one task
SPAN = 4096
CACHE_WORDS = 200_000
# Words of these characters are safe to split and lower-case by ourselves:
# no white space but ASCII, no composing, one lower-case letter each.
PLAIN = re.compile(r"[!-~¡-į]+")
# fixed value: the vocabulary's own rule for pieces of a word
RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokens:
    """Little-endian uint32 ids of whole texts, by a bounded cache of words.

    The vocabulary never joins across white space, so a text's ids are those of
    its words. Plain words are cut into letter, digit and symbol runs, each run
    tokenised once; any other word goes through the tokenizer as a whole.
    """

    def __init__(self, path: str, most: int = CACHE_WORDS):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.find = regex.compile(RUNS).findall
        self.letters = _byte_letters()
        # two generations each: what is still in use moves on from the old one
        self.words: dict[bytes, bytes] = {}
        self.old_words: dict[bytes, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.old_runs: dict[str, bytes] = {}
        self.most = most

    def _run(self, run: str) -> bytes:
        found = self.runs.get(run)
        if found is None:
            found = self.old_runs.get(run)
            if found is None:
                spelt = run if run.isascii() else run.encode().decode("latin-1").translate(self.letters)
                found = b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(spelt)])
            if len(self.runs) >= self.most:
                self.old_runs, self.runs = self.runs, {}
            self.runs[run] = found
        return found

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "surrogatepass")
        if PLAIN.fullmatch(text) and "<|" not in text:
            low = text.lower()
            if low.isalpha():
                return self._run(low)
            if low[:-1].isalpha() and not low[-1].isnumeric():
                return self._run(low[:-1]) + self._run(low[-1])
            return b"".join(map(self._run, self.find(low)))
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def __call__(self, text: str | None) -> bytes:
        data = text.encode("utf-8", "surrogatepass") if text else b""
        # letters count in lower case, but for the marks of special tokens
        split = data.split() if b"<|" in data else data.lower().split()
        known = self.words
        try:
            return b"".join(map(known.__getitem__, split))
        except KeyError:
            if len(known) >= self.most:
                self.old_words, self.words = known, {}
                known = self.words
            old = self.old_words.get
            for w in split:
                if w not in known:
                    known[w] = old(w) or self._word(w)
            return b"".join(map(known.__getitem__, split))


def token_pieces(
    documents: DataFrame,
    tokenizer_path: str,
    id_col: str = "document_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = 0,
) -> DataFrame:
    """(id_col, piece int, start long, length long, token_ids binary): texts as token pieces.

    ``token_ids`` holds little-endian uint32 ids, the text's and then ``end_id``.
    Only texts of more than ``capacity`` ids are cut; all their pieces but the
    last are full. A null or empty text is one piece of the end id alone.
    Repeated rows give repeated pieces. Each executor reads ``tokenizer_path``
    from its own installation.
    """
    id_type = documents.schema[id_col].dataType.simpleString()
    end = end_id.to_bytes(4, "little")
    width = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens(tokenizer_path)
        for batch in batches:
            whose, piece, start, data = [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                ids = tokens(t) + end
                for k in range(0, len(ids), width):
                    whose.append(i)
                    piece.append(k // width)
                    start.append(k // 4)
                    data.append(ids[k : k + width])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(whose, pa.int32())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array([len(d) // 4 for d in data], pa.int64()),
                    pa.array(data, pa.binary()),
                ],
                ["id", "piece", "start", "length", "token_ids"],
            )

    made = documents.select(F.col(id_col).alias("id"), F.col(text).alias("t")).mapInArrow(
        run, f"id {id_type}, piece int, start long, length long, token_ids binary"
    )
    return made.withColumnRenamed("id", id_col)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes: longest first, each into the fullest bin that still has room."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), ascending
    for i in sorted(range(len(lengths)), key=lambda j: -lengths[j]):
        at = bisect.bisect_left(room, (lengths[i], -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if free > lengths[i]:
            bisect.insort(room, (free - lengths[i], b))
    return bins


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search over the underfull bins: every exchange raises the sum of squared fills.

    The emptiest bin is the donor, then the next. Of all ways to move one of its
    pieces to a fuller bin, or to exchange one or two of them for one, so that
    the fuller bin gains, the one that gains most is taken, until none is left.
    A donor without pieces is dropped. Every underfull bin is a donor in each
    round. The search ends when a round changes nothing, or when no packing
    could have fewer bins.
    """
    size = np.array(lengths, np.int64)
    home = np.zeros(len(size), np.int64)
    for b, members in enumerate(bins):
        home[members] = b
    fill = np.bincount(home, size, len(bins)).astype(np.int64) if len(bins) else np.zeros(0, np.int64)
    count, fewest = int((fill > 0).sum()), -(-int(fill.sum()) // capacity)
    changed = True
    while changed and count > fewest:
        changed = False
        # pieces of full bins take no part; a piece of size 0 for each bin stands for a plain move
        loose = np.flatnonzero((fill > 0) & (fill < capacity))
        pieces = np.flatnonzero(np.isin(home, loose))
        taken = np.concatenate([size[pieces], np.zeros(len(loose), np.int64)])
        where = np.concatenate([home[pieces], loose])
        for donor in loose[np.argsort(fill[loose], kind="stable")]:
            while 0 < fill[donor] < capacity:
                mine = np.flatnonzero(where[: len(pieces)] == donor)
                give, some = _givable(pieces[mine].tolist(), lengths)
                free = capacity - fill[where]
                at = np.searchsorted(give, free + taken, "right") - 1
                gain = np.where((at >= 0) & (where != donor) & (fill[where] >= fill[donor]) & (free > 0), give[at] - taken, 0)
                best = int(gain.argmax())
                if gain[best] <= 0:
                    break
                other, changed = where[best], True
                fill[donor] -= gain[best]
                fill[other] += gain[best]
                where[np.flatnonzero(np.isin(pieces, some[at[best]]))] = other
                if best < len(pieces):
                    where[best] = donor
            if fill[donor] == 0:
                count -= 1
                if count <= fewest:
                    break
        home[pieces] = where[: len(pieces)]
    packed: list[list[int]] = [[] for _ in bins]
    for i, b in enumerate(home.tolist()):
        packed[b].append(i)
    return [b for b in packed if b]


def _givable(donor: list[int], lengths: list[int]) -> tuple[np.ndarray, list[tuple]]:
    """(sizes ascending, pieces of each): one or two pieces of a bin for every size they can have."""
    alike: dict[int, list[int]] = {}
    for i in donor:
        alike.setdefault(lengths[i], []).append(i)
    # pieces of one length are alike, so a bin has few pairs to try however many pieces it holds
    found = {n: (same[0],) for n, same in alike.items()}
    sizes = sorted(alike)
    for x, n in enumerate(sizes):
        if len(alike[n]) > 1:
            found.setdefault(2 * n, (alike[n][0], alike[n][1]))
        for m in sizes[x + 1 :]:
            found.setdefault(n + m, (alike[n][0], alike[m][0]))
    given = sorted(found)
    return np.array(given, np.int64), [found[n] for n in given]


def pack_pieces(
    pieces: DataFrame,
    id_col: str = "document_id",
    capacity: int = CAPACITY,
    shard_rows: int = SHARD_ROWS,
    rows: int | None = None,
    order: str | None = None,
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` (long): a place for every piece.

    ``pieces`` has ``id_col``, ``piece`` and ``length``; other columns are
    carried along. Pieces are dealt by hash to shards of about ``shard_rows``
    (from ``rows``, if their number is known; counted if not given), and every shard
    is packed by itself, at the cost of one part-filled bin or so each. Offsets
    of a sequence leave no gap. A piece longer than ``capacity`` is an error.
    Repeated rows are separate pieces; an empty table gives an empty result.

    With ``order``, a column of whole numbers from 0, shards are ranges of it
    instead, of about ``shard_rows`` pieces each (nulls last), and
    ``sequence_id`` follows them: sequences of a later range have greater
    numbers, and those of one range go by the mean place of their tokens.
    ``pieces`` should then be stored or cheap, as it is read twice.
    """
    base = pieces.drop("sequence_id", "offset")
    if order is None:
        n = max(1, -(-(pieces.count() if rows is None else rows) // shard_rows))
        dealt = base.withColumn("_at", F.lit(0).cast("long")).withColumn("_shard", F.pmod(F.xxhash64(id_col, "piece"), F.lit(n)))
    else:
        dealt = _placed(base, order, id_col).withColumn("_shard", F.floor(F.col("_at") / shard_rows).cast("long"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        # columns stay as they came: numbers beside nulls would be changed in pandas
        by = [("length", "descending"), *((c, "ascending") for c in (id_col, "piece") if not pa.types.is_nested(table.schema.field(c).type))]
        table = table.take(pc.sort_indices(table, by))
        lengths = table.column("length").to_pylist()
        if lengths and lengths[0] > capacity:
            raise ValueError(f"a piece of {lengths[0]} tokens is longer than {capacity}")
        sequence, offset = [0] * len(lengths), [0] * len(lengths)
        bins = improve(best_fit(lengths, capacity), lengths, capacity)
        if order is not None:
            place = table.column("_at").to_pylist()
            bins.sort(key=lambda b: sum(place[i] * lengths[i] for i in b) / max(1, sum(lengths[i] for i in b)))
        for b, members in enumerate(bins):
            at = 0
            for i in members:
                sequence[i], offset[i] = key[0].as_py() << 32 | b, at
                at += lengths[i]
        kept = table.drop_columns(["_shard", "_at"])
        return kept.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema] + ["sequence_id long", "offset long"])
    return dealt.groupBy("_shard").applyInArrow(run, schema)


def _placed(pieces: DataFrame, order: str, id_col: str) -> DataFrame:
    """Add ``_at``: about how many pieces come before in the order; those of equal order are spread by hash."""
    # one row for each order value, then for each span of them; nulls come after all
    value = F.coalesce(F.col(order).cast("long"), F.lit(2**62))
    each = pieces.groupBy(value.alias("_v")).agg(F.count("*").alias("_n")).withColumn("_b", F.floor(F.col("_v") / SPAN))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ahead = each.groupBy("_b").agg(F.sum("_n").alias("_t")).select(
        F.col("_b").alias("_g"), F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_a")
    )
    own = Window.partitionBy("_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    start = each.withColumn("_o", F.coalesce(F.sum("_n").over(own), F.lit(0))).join(ahead, F.col("_b") == F.col("_g"))
    starts = bounded(start.select("_v", "_n", (F.col("_a") + F.col("_o")).alias("_s")))
    spread = F.col("_s") + F.pmod(F.xxhash64(id_col, "piece"), F.col("_n"))
    return pieces.withColumn("_w", value).join(starts, F.col("_w") == F.col("_v")).withColumn("_at", spread).drop("_w", "_v", "_n", "_s")
