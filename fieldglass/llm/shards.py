"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Rows with equal texts are one group and stay together.  Groups are summed by
Spark; small ones are poured by hash into a fixed number of parcels, large ones
stand alone, so what the differencing works on is bounded at every input size.
It starts from one partial partition per parcel, (size, 0, ..., 0), and always
combines the two with the largest spread, the larger shards of one with the
smaller of the other.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldglass.llm.common import landed, texts

SHARDS = 24
#: Parcels per shard; groups above the mean parcel stand alone, so at most as many again.
PARCELS_PER_SHARD = 256
ROW_BYTES = 8
#: Rows one numbering cell is meant to hold.
CELL_ROWS = 50_000
LEAST_CELLS = 512


def differencing(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item.

    A partial partition is a tuple of sums in descending order and, for each sum,
    the node of a merge tree that says which items it holds.  Ties are broken by
    the order of the items, so the result depends on the input alone.
    """
    left: list[int] = []
    right: list[int] = []
    items = len(sizes)
    heap = [(-size, i, (size,) + (0,) * (shards - 1), (i,) + (-1,) * (shards - 1)) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    stamp = items
    while len(heap) > 1:
        _, _, sums, nodes = heapq.heappop(heap)
        _, _, other, others = heapq.heappop(heap)
        joined = []
        for k in range(shards):
            a, b = nodes[k], others[shards - 1 - k]
            if a < 0 or b < 0:
                node = max(a, b)
            else:
                node = items + len(left)
                left.append(a)
                right.append(b)
            joined.append((sums[k] + other[shards - 1 - k], -k, node))
        joined.sort(reverse=True)
        heapq.heappush(
            heap, (joined[-1][0] - joined[0][0], stamp, tuple(x[0] for x in joined), tuple(x[2] for x in joined))
        )
        stamp += 1
    out = [0] * items
    for shard, root in enumerate(heap[0][3] if heap else ()):
        todo = [root] if root >= 0 else []
        while todo:
            node = todo.pop()
            if node < items:
                out[node] = shard
            else:
                todo += [left[node - items], right[node - items]]
    return out


def parcel_of(key: Column, parcels: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parcels)).cast("int")


def assign_shards(
    docs: DataFrame, shards: int = SHARDS, id_column: str = "doc_id", text_column: str = "text",
    parcels_per_shard: int = PARCELS_PER_SHARD,
) -> DataFrame:
    """Put every row into a shard and number the rows of each shard.

    Columns: doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, law
    ('bytes'), shard, slot (gapless from 0 in each shard), grown_shard (null:
    the law is not by key).

    The driver sees at most 2 x shards x parcels_per_shard sums.  Their lookup
    tables have that many rows, so broadcasting them is safe; rows go through one
    shuffle, dealt by shard and hash of the id, so neither a large group nor a
    full shard meets in one task.  A group that weighs more than a shard's share
    fills one shard beyond the others: it is indivisible.

    Null texts have the size 8 and are equal to empty ones.  Repeated rows and
    ids keep a row and a slot each.  Other columns are left out.  An empty table
    gives an empty one; fewer groups than shards leave shards empty.
    """
    parcels = shards * parcels_per_shard
    binary = F.encode("text", "UTF-8")
    rows = landed(
        texts(docs, id_column, text_column).select(
            "doc_id", (F.octet_length("text") + ROW_BYTES).cast("long").alias("size"),
            F.crc32(binary).alias("text_crc32"), F.unhex(F.md5(binary)).alias("key"),
        ),
        "sizes",
    )
    groups = landed(rows.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "groups")
    total, count = groups.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    large = F.col("size") * parcels > total
    alone = groups.where(large).select("key", "size").orderBy("key").collect()
    poured = (
        groups.where(~large).groupBy(parcel_of(F.col("key"), parcels).alias("parcel"))
        .agg(F.sum("size").alias("size")).orderBy("parcel").collect()
    )
    found = differencing([r["size"] for r in alone] + [r["size"] for r in poured], shards)
    spark = docs.sparkSession
    by_key = spark.createDataFrame(
        [(r["key"], s) for r, s in zip(alone, found)], "key binary, own_shard int"
    )
    by_parcel = spark.createDataFrame(
        [(r["parcel"], s) for r, s in zip(poured, found[len(alone):])], "parcel int, parcel_shard int"
    )
    cells = max(LEAST_CELLS, -(-count // (shards * CELL_ROWS)))
    placed = (
        rows.withColumn("parcel", parcel_of(F.col("key"), parcels))
        .join(F.broadcast(by_key), "key", "left").join(F.broadcast(by_parcel), "parcel", "left")
        .select(
            "doc_id", "size", "text_crc32", F.coalesce("own_shard", "parcel_shard").alias("shard"),
            F.pmod(F.xxhash64("doc_id"), F.lit(cells)).alias("cell"),
        )
    )
    counts = placed.groupBy("shard", "cell").count()
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("rank", F.row_number().over(inside)).join(landed(starts, "starts"), ["shard", "cell"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
