"""Documents dealt to shards of near-equal bytes by Karmarkar-Karp differencing.

Rows with equal texts are one group and stay in one shard.  Differencing starts with one partial
partition per item (all its bytes in one shard) and again and again combines the two partial
partitions of largest spread, the fullest shard of one with the emptiest of the other, until one
is left.  That order is sequential, so the items are made few enough for one task first, by rules
that hold at every size:

* A group with at least a 256th of a shard's bytes is an item of its own (4,096 at most for 16 shards).
* Other groups go, by a hash of their text, to a level (three quarters to level 0, three
  quarters of the rest to level 1, and so on) and within a level to one of 64 parcels a shard.  Levels
  go on until a parcel of the last holds about one group.  Parcels are sums combined before the
  shuffle.  Each level is four times finer than the one above, so the differences that large
  items leave are evened out by smaller ones down to single texts.  The number of items grows
  with the logarithm of the number of groups (about 20,000 for 10^10 groups).

Rows find their shard through these two small tables, so no row moves to its group.  Slots are
counted per input partition and shard and moved by the counts before them.

Defined results: a null text counts as empty (size 1, crc 0) and is in one group with empty
texts; ids may be null or repeated, every row gets a slot of its own; with fewer groups than shards
some shards stay empty; other columns are ignored; an empty table gives no rows.  Slots follow the
order in which the rows are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import clean_text, ready
from fleetlens.session import stored

SHARDS = 16
#: A group with one byte in so many, for each shard, is an item of its own.
HEADS = 256
#: Parcels of a level, for each shard.
PARCELS = 64
_ROW_BITS = 33  # fixed value: monotonically_increasing_id keeps the row number in the low 33 bits


def differencing(sizes: Sequence[int], shards: int) -> list[int]:
    """The shard of every item; ``sizes`` in any order, ties are broken by position."""
    if not sizes:
        return []
    sums = [[size, *[0] * (shards - 1)] for size in sizes]  # of every partial partition, falling
    parents: list[tuple[int, int, list[int]]] = []
    heap = [(-size, at) for at, size in enumerate(sizes)] if shards > 1 else []
    heapq.heapify(heap)
    while len(heap) > 1:
        _, one = heapq.heappop(heap)
        _, two = heapq.heappop(heap)
        both = [a + b for a, b in zip(sums[one], reversed(sums[two]))]
        order = sorted(range(shards), key=lambda k: -both[k])
        parents.append((one, two, order))
        sums.append([both[k] for k in order])
        sums[one] = sums[two] = None
        heapq.heappush(heap, (sums[-1][-1] - sums[-1][0], len(sums) - 1))
    labels: list = [None] * len(sums)
    labels[-1] = list(range(shards))
    if shards == 1:
        return [0] * len(sizes)
    for at in range(len(parents) - 1, -1, -1):
        one, two, order = parents[at]
        mixed = [0] * shards
        for place, k in enumerate(order):
            mixed[k] = labels[len(sizes) + at][place]
        labels[len(sizes) + at] = None
        labels[one], labels[two] = mixed, mixed[::-1]
    return [labels[at][0] for at in range(len(sizes))]


def _deal(shards: int) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [frame for frame in frames if not frame.empty]
        if found:
            items = pd.concat(found, ignore_index=True)
            items = items.sort_values(["bytes", "level", "parcel", "head"], ascending=[False, True, True, True], kind="stable")
            items["shard"] = differencing(items["bytes"].tolist(), shards)
            yield items.drop(columns="bytes")

    return run


def levels_for(n_groups: int, parcels: int) -> int:
    """Levels until a parcel of the last one holds about one group."""
    levels = 0
    while n_groups > parcels * 4**levels:
        levels += 1
    return levels


def _parcel(levels: int, parcels: int) -> tuple[Column, Column]:
    """Level and parcel of a group by its digest; the last level has four times the parcels."""
    name = F.xxhash64("digest")
    level = sum((F.when(name.bitwiseAND(F.lit(4**k - 1)) == 0, 1).otherwise(0) for k in range(1, levels + 1)), F.lit(0))
    rest = F.shiftrightunsigned(name, 2 * levels + 1)
    parcel = F.when(level == levels, rest % (4 * parcels)).otherwise(rest % parcels)
    return level.cast("int").alias("level"), parcel.cast("int").alias("parcel")


def shard_documents(
    docs: DataFrame,
    shards: int = SHARDS,
    id_column: str = "doc_id",
    text: str = "text",
    heads: int = HEADS,
    parcels: int = PARCELS,
) -> DataFrame:
    """``id, size, text_crc32, digest, shard, slot``; ``digest`` names the group (SHA-256 of the text).

    ``heads`` and ``parcels`` are per shard and bound the items of the one task that does the differencing.
    """
    ready(docs.sparkSession)
    heads, parcels = heads * shards, parcels * shards
    whole = clean_text(F.col(text))
    rows = stored(
        docs.select(
            F.col(id_column).alias("id"),
            (F.octet_length(whole).cast("long") + 1).alias("size"),
            F.crc32(whole).alias("text_crc32"),
            F.unhex(F.sha2(whole, 256)).alias("digest"),
            F.monotonically_increasing_id().alias("at"),
        )
    )
    groups = stored(rows.groupBy("digest").agg(F.sum("size").alias("bytes")))
    figures = groups.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bytes").cast("decimal(38,0)")).alias("total")).first()
    levels = levels_for(figures.n, parcels)
    is_head = F.col("bytes").cast("decimal(38,0)") * heads >= F.lit(figures.total or 0)
    level, parcel = _parcel(levels, parcels)
    none = F.lit(None)
    large = groups.where(is_head).select("bytes", none.cast("int").alias("level"), none.cast("int").alias("parcel"), F.hex("digest").alias("head"))
    small = groups.where(~is_head).select(level, parcel, "bytes").groupBy("level", "parcel").agg(F.sum("bytes").alias("bytes"))
    items = large.unionByName(small.select("bytes", "level", "parcel", none.cast("string").alias("head")))
    dealt = stored(items.repartition(1).mapInPandas(_deal(shards), "level int, parcel int, head string, shard int"))
    by_head = dealt.where("head is not null").select(F.unhex("head").alias("digest"), F.col("shard").alias("of_head"))
    by_parcel = dealt.where("head is null").select("level", "parcel", F.col("shard").alias("of_parcel"))
    placed = (
        rows.select("*", level, parcel)
        .join(F.broadcast(by_head), "digest", "left")
        .join(F.broadcast(by_parcel), ["level", "parcel"], "left")
        .withColumn("shard", F.coalesce("of_head", "of_parcel"))
        .withColumn("part", F.shiftright("at", _ROW_BITS))
        .select("id", "size", "text_crc32", "digest", "shard", "part", "at")
    )
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "part", F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("at")) - 1
    numbered = placed.withColumn("inside", inside).join(starts, ["shard", "part"])
    return numbered.select("id", "size", "text_crc32", "digest", "shard", (F.col("start") + F.col("inside")).cast("long").alias("slot"))
