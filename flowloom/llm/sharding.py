"""Sharding of documents by longest-processing-time scheduling under the law `bytes`.

Rows with equal texts stay together. Groups are scheduled by size, largest first, each to the
least-loaded shard through a heap. Only groups that can matter for the balance are scheduled one
by one: those of at least 1 / (shards * fine) of all bytes, of which there are at most
shards * fine whatever the input. All other groups fall by a hash of their text into ``cells``
cells, which are scheduled like groups. So the driver never holds more than shards * fine + cells
sizes, and no shard is further from the least loaded than by the last item put on it. With few
documents nearly every cell is one group and the schedule is the plain one.

Slots number the rows of a shard from 0 without gaps. They come from counts per shard and block
of rows: a running sum of the counts gives each block its first slot, and rows are numbered within
their block, so no task holds a whole shard.

Defined results: a null text has no bytes, size 1 and checksum 0, and is bound to no other row, also
if ids repeat or are null; an empty text has size 1 and is a text like others; repeated rows get different slots; an empty table
gives no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, fresh, hash_pair


def schedule(sizes: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """Longest processing time first: item name -> shard, for (size, name) items."""
    heap = [(0, i) for i in range(shards)]
    out = {}
    for size, name in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        out[name] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def shard_bytes(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", fine: int = 256, cells: int = 1 << 14, block_rows: int = 20_000) -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    t, row = F.col(text), fresh(docs, "row")
    # two independent 64-bit hashes name a group of equal texts; a null text is a group by itself, named by its row's number
    h1, h2 = hash_pair(t)
    n1, n2 = hash_pair(F.col(row), F.lit("null"))
    rows = docs.withColumn(row, F.monotonically_increasing_id()).select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(t), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(t.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.col(row).alias("row"),
        *(F.when(t.isNull(), n).otherwise(h).alias(g) for n, h, g in ((n1, h1, "g1"), (n2, h2, "g2"))),
    )
    rows = durable(rows)  # a few numbers a row; the texts are read once, and a row's number stays as it is from here
    groups = rows.groupBy("g1", "g2").agg(F.sum("size").alias("size"))
    total = rows.agg(F.sum("size").alias("s"), F.count("*").alias("n")).first()
    if not total.n:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).limit(0)
    bound = total.s / (shards * fine)
    cell = F.pmod(F.col("g1"), F.lit(cells))
    summed = groups.groupBy((F.col("size") >= bound).alias("large"), F.when(F.col("size") >= bound, F.col("g1")).alias("a"), F.when(F.col("size") >= bound, F.col("g2")).alias("b"), F.when(F.col("size") < bound, cell).alias("cell")).agg(F.sum("size").alias("size"))
    items = summed.collect()
    placed = schedule([(r.size, f"{r.a}:{r.b}" if r.large else f"cell {r.cell}") for r in items], shards)
    large = spark.createDataFrame([(r.a, r.b, placed[f"{r.a}:{r.b}"]) for r in items if r.large], "g1 long, g2 long, large_shard int")
    small = spark.createDataFrame([(r.cell, placed[f"cell {r.cell}"]) for r in items if not r.large], "cell long, cell_shard int")
    put = rows.withColumn("cell", cell).join(F.broadcast(large), ["g1", "g2"], "left").join(F.broadcast(small), "cell", "left")
    put = put.select("doc_id", "row", "size", "text_crc32", F.coalesce("large_shard", "cell_shard").alias("shard"))
    blocks = max(1, -(-total.n // block_rows))
    put = put.withColumn("block", F.pmod(F.xxhash64("doc_id", "row"), F.lit(blocks)))
    counts = put.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "size", "text_crc32", "row"))
    numbered = put.withColumn("inside", inside).join(firsts, ["shard", "block"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("inside") - 1).cast("long").alias("slot"))
