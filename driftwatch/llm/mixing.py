"""Mixing collections to target weights by Pfair scheduling.

The texts of each collection are dealt into blocks of equal size. Block k of a
collection of weight w is released at slot floor(k / w) and due by slot
ceil((k + 1) / w); earliest deadline first gives every slot to a released block.
As the weights sum to one, every deadline is met, so at any slot the blocks a
collection has had differ from weight times slots by less than one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.llm.common import power_of_two, running_totals, stored
from driftwatch.session import bounded

PERIOD = 840
BLOCK_CHARS = 65_536
# spans of up to 2**NEAR slots are ranked within one partition
NEAR = 14


def whole_shares(weights: DataFrame, key: str = "collection_name", period: int = PERIOD) -> DataFrame:
    """(key, share): positive weights as whole shares of ``period`` slots, by largest remainder.

    Each collection gets one slot at least; ``period`` is raised to a hundred
    slots a collection where it is smaller than that.
    """
    w = weights.where(F.col("weight") > 0).groupBy(key).agg(F.sum("weight").alias("weight"))
    # one row for each collection: the windows are over this small table
    everything = Window.partitionBy(F.lit(0))
    n, total = F.count("*").over(everything), F.sum("weight").over(everything)
    slots = F.greatest(F.lit(period), 100 * n)
    part = w.withColumn("slots", slots).withColumn("q", F.col("weight") / total * (F.col("slots") - n))
    part = part.withColumn("left", F.col("slots") - n - F.sum(F.floor("q")).over(everything))
    rank = F.row_number().over(everything.orderBy((F.col("q") - F.floor("q")).desc(), key))
    return part.select(key, (1 + F.floor("q") + F.when(rank <= F.col("left"), 1).otherwise(0)).cast("long").alias("share"))


def slot_table(shares: DataFrame, key: str = "collection_name") -> DataFrame:
    """(key, share, period, job, slot_in_period) of one period of the schedule.

    Every slot goes to the released block due first (ties to the first key).
    The period sums all shares, so the schedule repeats. No task walks along
    the slots. Spans of slots are halved into a tree instead. On the way up each
    span learns which of the blocks released in it fit into it: those of the left
    half, and of the left half's rest and the right half's own as many as the
    right half has slots, by deadline. On the way down each span hands to its
    left half the first blocks by deadline of those that were released earlier
    or fit into that half, the others to its right half. A span of one slot then
    holds its block. That takes two ranks a level, over one row for each slot.
    """
    total = shares.agg(F.sum("share")).first()[0] or 0
    levels = max(0, int(total) - 1).bit_length()
    p, k = F.lit(total).cast("long"), F.col("job")
    jobs = shares.select(key, "share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("share") - 1)).alias("job"))
    jobs = jobs.withColumns(
        {
            "period": p,
            "_r": F.floor(k * p / F.col("share")).cast("long"),
            "_d": F.ceil((k + 1) * p / F.col("share")).cast("long"),
        }
    )
    due = ["_d", F.col(key).asc_nulls_first()]
    first = F.row_number().over(Window.partitionBy("_near", "_span").orderBy(*due)) == 1
    # spans inside one block of slots stay in its partition; only wider ones are shuffled again
    jobs = jobs.withColumns({"_near": F.shiftright("_r", NEAR), "_span": F.col("_r")}).repartition("_near")
    jobs = jobs.withColumn("_fits", first.cast("long"))
    for level in range(1, levels + 1):
        bit = 1 << (level - 1)
        right, fits = F.col("_r").bitwiseAND(F.lit(bit)) != 0, F.col("_fits").bitwiseAND(F.lit(bit)) != 0
        span = [F.shiftright("_r", level).alias("_span"), (right == fits).alias("_asks")]
        jobs = jobs.withColumns({"_span": span[0], "_asks": span[1]})
        rank = F.row_number().over(Window.partitionBy(*_spans(level), "_asks").orderBy(*due))
        now = F.when(F.col("_asks"), rank <= bit).otherwise(fits)
        jobs = jobs.withColumn("_fits", F.col("_fits").bitwiseOR(F.when(now, F.lit(bit << 1)).otherwise(F.lit(0)).cast("long")))
    jobs = jobs.withColumns({"_near": F.lit(0).cast("long"), "_span": F.lit(0).cast("long")})
    for level in range(levels, 0, -1):
        bit = 1 << (level - 1)
        start = F.shiftleft(F.col("_span"), level)
        fits = F.col("_fits").bitwiseAND(F.lit(bit)) != 0
        asks = (F.col("_r") < start) | ((F.col("_r") < start + bit) & fits)
        jobs = jobs.withColumn("_asks", asks)
        rank = F.row_number().over(Window.partitionBy(*_spans(level), "_asks").orderBy(*due))
        left = F.col("_asks") & (rank <= bit)
        jobs = jobs.withColumn("_span", F.col("_span") * 2 + F.when(left, 0).otherwise(1))
        if level == NEAR + 1:
            jobs = jobs.withColumn("_near", F.col("_span")).repartition("_near")
    return jobs.select(key, "share", "period", F.col("_span").alias("slot_in_period"), "job")


def _spans(level: int) -> list[str]:
    return ["_near", "_span"] if level <= NEAR else ["_span"]


def tempered_weights(documents: DataFrame, key: str, text: str, power: float = 0.5) -> DataFrame:
    """(key, weight): characters of each collection to a power; an empty collection counts as one character."""
    size = F.greatest(F.sum(F.length(F.coalesce(text, F.lit("")))), F.lit(1))
    return documents.groupBy(key).agg(F.pow(size, F.lit(power)).alias("weight"))


def mix_collections(
    documents: DataFrame,
    weights: DataFrame | None = None,
    key: str = "collection_name",
    id_col: str = "document_id",
    text: str = "text",
    block_chars: int = BLOCK_CHARS,
    period: int = PERIOD,
    power: float = 0.5,
) -> DataFrame:
    """Every document with its ``block``, ``release``, ``deadline`` and ``slot`` (long).

    Sorting by ``slot`` gives the mixture. A document starts in the block that
    holds its first character when the texts of its collection are laid end to
    end in order of a hash of the id; one longer than a block leaves the next
    blocks empty. ``weights`` (key, weight) defaults to the collections' sizes to
    the power ``power``. A collection without a positive weight has no slots:
    null, to be placed last. When a collection runs out its slots stay empty, so
    no document is dropped or repeated. Null collections form one collection,
    null texts are empty, rows repeating an id share its place, and an empty table gives an
    empty result. Other columns are carried along; those of the four names are
    replaced. A large collection is split by hash ranges, never gathered.
    """
    base = documents.drop("block", "release", "deadline", "slot")
    places = slot_places(base, weights, key, id_col, text, block_chars, period, power)
    mine = F.col(key).eqNullSafe(F.col("_key")) & F.col(id_col).eqNullSafe(F.col("_id"))
    return base.join(places, mine).drop("_key", "_id")


def slot_places(
    documents: DataFrame,
    weights: DataFrame | None = None,
    key: str = "collection_name",
    id_col: str = "document_id",
    text: str = "text",
    block_chars: int = BLOCK_CHARS,
    period: int = PERIOD,
    power: float = 0.5,
) -> DataFrame:
    """(_key, _id, block, release, deadline, slot): the places of :func:`mix_collections`, one row for each collection and id."""
    # everything is decided on narrow rows; the texts are only read for their length
    sized = documents.groupBy(F.col(key).alias("_key"), F.col(id_col).alias("_id")).agg(
        F.sum(F.length(F.coalesce(F.col(text), F.lit(""))).cast("long")).alias("_chars")
    )
    sized = stored(sized)
    if weights is None:
        size = F.greatest(F.sum("_chars"), F.lit(1))
        weights = sized.groupBy(F.col("_key").alias(key)).agg(F.pow(size, F.lit(power)).alias("weight"))
    slots = stored(slot_table(whole_shares(weights, key, period), key))
    placed = running_totals(sized, "_key", ["_id"], "_chars", "_before", power_of_two(sized.count() / 64, 1, 4096))
    # one row for each collection, and one for each slot of a period: broadcast up to a counted bound
    shares = slots.groupBy(F.col(key).alias("_sk")).agg(F.min("share").alias("_a"), F.min("period").alias("_p"))
    blocks = placed.withColumn("block", F.floor(F.col("_before") / block_chars).cast("long")).join(
        bounded(shares), F.col("_key").eqNullSafe(F.col("_sk")), "left"
    )
    jobs = slots.select(F.col(key).alias("_jk"), F.col("job").alias("_j"), F.col("slot_in_period").cast("long").alias("_s"))
    return blocks.join(
        bounded(jobs), F.col("_key").eqNullSafe(F.col("_jk")) & (F.col("block") % F.col("_a") == F.col("_j")), "left"
    ).select(
        "_key",
        "_id",
        "block",
        F.floor(F.col("block") * F.col("_p") / F.col("_a")).cast("long").alias("release"),
        F.ceil((F.col("block") + 1) * F.col("_p") / F.col("_a")).cast("long").alias("deadline"),
        ((F.col("block") / F.col("_a")).cast("long") * F.col("_p") + F.col("_s")).alias("slot"),
    )
