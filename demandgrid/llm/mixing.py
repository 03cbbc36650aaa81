"""Mixing sources to target weights by proportionate fair scheduling (operator 3).

A source with integer weight w out of W gets block k (from 0) released at slot floor(k W / w), due at
ceil((k + 1) W / w), and one block runs per slot, the earliest deadline first.  After any number of slots every
source then lies less than one block from its share.  The schedule repeats after W slots, so one period of it, as
long as the weights' sum and thus a parameter, is worked out on the driver; documents find their slot by arithmetic.

Nothing is dropped or repeated: when a source has run out, the others go on by their own weights in a new phase, of
which there are as many as sources at most.  Within a source the order is a hash of key and text.

Defined results: a source outside the recipe (null included) belongs to the pool ``other``, a null key is hashed like
an empty one, a null text has size 0, and rows that agree in key and text follow each other in any order.  A document
starts in the block its first byte falls in, so a very long one spans the slots of several blocks."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandgrid.llm.base import let, spread_rank

OTHER = "other"


def one_period(weights: dict[str, int]) -> list[tuple[str, int]]:
    """The slots of one period as (source, number of the block in the period)."""
    whole = sum(weights.values())
    release = lambda s, k: k * whole // weights[s]
    due = lambda s, k: -(-(k + 1) * whole // weights[s])
    waiting = [(0, s, 0) for s in sorted(weights)]
    heapq.heapify(waiting)
    ready, slots = [], []
    for t in range(whole):
        while waiting and waiting[0][0] <= t:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due(s, k), s, k))
        _, s, k = heapq.heappop(ready)
        slots.append((s, k))
        if k + 1 < weights[s]:
            heapq.heappush(waiting, (release(s, k + 1), s, k + 1))
    return slots


@dataclass(frozen=True)
class Phase:
    """From ``slot`` on, the sources in ``weights`` take turns; ``begun`` are the blocks each had before."""

    slot: int
    begun: dict[str, int]
    weights: dict[str, int]
    slots: list[tuple[str, int]]


def phases(weights: dict[str, int], blocks: dict[str, int]) -> list[Phase]:
    """The schedule of sources with these numbers of blocks, as one phase for each set of unfinished sources."""
    begun, slot, out = {s: 0 for s in blocks}, 0, []
    while left := {s: weights[s] for s in sorted(blocks) if begun[s] < blocks[s]}:
        order = one_period(left)
        place = {x: i for i, x in enumerate(order)}
        ends = {s: (d // w) * len(order) + place[s, d % w] + 1
                for s, w in left.items() for d in [blocks[s] - begun[s] - 1]}
        length = min(ends.values())
        out.append(Phase(slot, dict(begun), left, order))
        whole, rest = divmod(length, len(order))
        for s, w in left.items():
            begun[s] += whole * w
        for s, _ in order[:rest]:
            begun[s] += 1
        slot += length
    return out


def _timetable(spark: SparkSession, plan: list[Phase]) -> DataFrame:
    """Per pool its phases: first block, first slot, period, blocks a period and the places of those in it."""
    rows: dict[str, list[tuple]] = {}
    for p in plan:
        for s, w in p.weights.items():
            places = [i for i, (x, _) in enumerate(p.slots) if x == s]
            rows.setdefault(s, []).append((p.begun[s], p.slot, len(p.slots), w, places))
    return spark.createDataFrame(
        list(rows.items()), "__pool string, __phases array<struct<begun: bigint, slot: bigint, period: int, w: int, "
        "places: array<int>>>")


def _slot(block: Column, phases_: Column) -> Column:
    """Slot of a block: the last phase of its pool that had begun before it, and the place in the period."""

    def of(p: Column) -> Column:
        d = block - p["begun"]
        return p["slot"] + F.floor(d / p["w"]) * p["period"] + F.get(p["places"], F.pmod(d, p["w"]).cast("int"))

    return let(F.element_at(F.filter(phases_, lambda p: p["begun"] <= block), -1), of).cast("long")


def mix(df: DataFrame, weights: dict[str, int], *, key: str = "doc_id", source: str = "source", text: str = "text",
        block_bytes: int = 65_536, other: int = 1, keep: bool = False) -> DataFrame:
    """Key, pool, block, slot and order within the block (``offset``, the bytes before the document in its source).

    ``weights`` is the recipe: integers, also the length of the period; ``other`` is the weight of all sources it
    doesn't name.  ``keep``: carry the whole row as the struct ``row``.  One job counts the bytes per pool; the
    pools are as many as the recipe names."""
    weights = {**weights, OTHER: other}
    pool = F.when(F.col(source).isin([s for s in weights if s != OTHER]), F.col(source)).otherwise(F.lit(OTHER))
    rows = df.select(
        *([F.struct("*").alias("row")] if keep else []), F.col(key).alias("__key"), pool.alias("__pool"),
        # key and text together, so that rows of one key, or without one, don't meet in one cell of the ranking
        F.md5(F.concat_ws(" ", F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit(""))))).alias("__h"),
        F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("__size"),
        F.xxhash64(F.col(text)).alias("__t"))
    placed = spread_rank(rows, ["__pool"], ["__h", "__size", "__t"], start="__offset", size="__size")
    totals = df.groupBy(pool.alias("p")).agg(
        F.sum(F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")).alias("n")).collect()
    # documents start at offsets up to the pool's size, also empty ones at its very end
    plan = phases(weights, {r["p"]: r["n"] // block_bytes + 1 for r in totals})
    block = F.floor(F.col("__offset") / block_bytes).cast("long")
    # one row for each pool of the recipe, whatever the data
    placed = placed.join(F.broadcast(_timetable(df.sparkSession, plan)), "__pool")
    return placed.withColumn("__block", block).select(
        *(["row"] if keep else []), F.col("__key").alias(key), F.col("__pool").alias("pool"),
        F.col("__block").alias("block"), _slot(F.col("__block"), F.col("__phases")).alias("slot"),
        F.col("__offset").alias("offset"), F.col("__h").alias("order_hash"))


def in_mixed_order(df: DataFrame, weights: dict[str, int], **options) -> DataFrame:
    """The rows of ``df`` unchanged, partition by partition and row by row in the order of the mix."""
    mixed = mix(df, weights, keep=True, **options)
    return (mixed.repartitionByRange("slot", "order_hash").sortWithinPartitions("slot", "offset", "order_hash")
            .select("row.*"))
