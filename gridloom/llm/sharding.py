"""Sharding: a consistent-hash ring with virtual nodes and bounded loads.

Every document has a place on a ring of ``CELLS`` cells; every shard owns the cells up to its
virtual nodes. A shard takes the keys of its own arcs up to its capacity; keys of a full shard
continue clockwise to the next shard that has room. Capacities add up to the number of rows and
differ by one at most, so row counts do too.

A key's place is that of its group, if one is given (the query's groups are equal texts): a group
lies in one shard and goes on in the next only where the shard is full.

Cost: one scan for the counts of the cells (partial sums; CELLS rows reach the driver, whatever the
input), one for those of the parts of hot cells, one with a shuffle of narrow rows by cell. No row
meets all others: a window ranks the rows of one cell, or of one part of a cell that holds over
1 / HOT of all rows. Only SQL functions touch rows.

Defined results: null texts have size 16 and crc 0; null doc_ids share one cell, or that of their
group; repeated rows each get a slot of their own; an empty table gives no rows; other columns pass
through, but for ones named shard or slot, which are replaced.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import documents, text_of

#: Cells of the ring and virtual nodes of a shard. Both fixed: tables of cells are small at any scale.
CELLS = 1 << 14
NODES = 64
#: A cell is hot beyond this part of all rows, so there are fewer than HOT such cells. Its parts are
#: BY_GROUP classes of groups, each dealt by key into BY_KEY.
HOT, BY_GROUP, BY_KEY = 256, 16, 64


def _spin(x: int) -> int:
    """A fixed 64-bit mixing of integers, for the places of virtual nodes."""
    mask = (1 << 64) - 1
    x = (x + 0x9E3779B97F4A7C15) & mask
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
    return x ^ (x >> 31)


def ring(shards: int, cells: int = CELLS, nodes: int = NODES) -> list[int]:
    """The owner of each cell: the shard of the first virtual node at or after it."""
    at: dict[int, int] = {}
    for shard in range(shards):
        for v in range(nodes):
            cell = _spin(shard * 1_000_003 + v) % cells
            at[cell] = min(shard, at.get(cell, shard))
    owner, current = [0] * cells, at[min(at)]
    for cell in range(cells - 1, -1, -1):
        current = owner[cell] = at.get(cell, current)
    return owner


def segments(counts: dict[int, int], shards: int, cells: int = CELLS, nodes: int = NODES) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, rank after the last, shard, first slot): where the keys of a cell go.

    Ranks are places in the cell's order. Work is bounded by cells and shards, not by rows.
    """
    owner, total = ring(shards, cells, nodes), sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, out, over = [0] * shards, [], []

    def place(cell: int, low: int, high: int, shard: int) -> int:
        n = min(high - low, room[shard])
        if n:
            out.append((cell, low, low + n, shard, used[shard]))
            room[shard] -= n
            used[shard] += n
        return low + n

    for cell in sorted(counts):
        low = place(cell, 0, counts[cell], owner[cell])
        if low < counts[cell]:
            over.append((cell, low))
    for cell, low in over:
        step = cell
        while low < counts[cell]:
            step = (step + 1) % cells
            low = place(cell, low, counts[cell], owner[step])
    return out


def shard(df: DataFrame, key: str = "doc_id", shards: int = 40, cells: int = CELLS, nodes: int = NODES, group: str | None = None) -> DataFrame:
    """df with columns shard and slot (gapless from 0 in each shard); counts differ by one at most.

    group: a column whose equal values have one place on the ring; each key has its own by default.
    """
    spark = df.sparkSession
    at = F.col(f"`{group or key}`")
    order = F.xxhash64(at, F.lit(1))
    cell = F.pmod(F.xxhash64(at), F.lit(cells)).cast("int")
    counts = {r[0]: r[1] for r in df.select(cell.alias("cell")).groupBy("cell").count().collect()}  # cells rows at most
    rows = json.dumps([dict(zip(("cell", "low", "high", "shard", "at"), x, strict=True)) for x in segments(counts, shards, cells, nodes)])
    kind = "array<struct<cell:int,low:bigint,high:bigint,shard:int,at:bigint>>"
    table = spark.range(1).select(F.explode(F.from_json(F.lit(rows), kind)).alias("seg")).select(*(F.col(f"seg.{x}").alias(f"_gl_{x}") for x in ("cell", "low", "high", "shard", "at")))

    hot = [c for c, n in counts.items() if n * HOT > sum(counts.values())]
    part = F.pmod(order, F.lit(BY_GROUP)) * BY_KEY + F.pmod(F.xxhash64(F.col(f"`{key}`"), F.lit(2)), F.lit(BY_KEY))
    ranked = df.withColumn("_gl_of", cell).withColumn("_gl_part", F.when(F.col("_gl_of").isin(hot), part).otherwise(F.lit(0)).cast("int"))
    within = Window.partitionBy("_gl_of", "_gl_part").orderBy(order, F.xxhash64(F.col(f"`{key}`"), F.lit(1)), F.col(f"`{key}`"))
    rank = F.row_number().over(within) - F.lit(1)
    if hot:
        before = Window.partitionBy("_gl_hot").orderBy("_gl_piece").rowsBetween(Window.unboundedPreceding, -1)
        pieces = ranked.where(F.col("_gl_of").isin(hot)).groupBy(F.col("_gl_of").alias("_gl_hot"), F.col("_gl_part").alias("_gl_piece")).count()
        pieces = pieces.select("_gl_hot", "_gl_piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_gl_before"))
        # fewer than HOT * BY_GROUP * BY_KEY rows: bounded at any scale
        ranked = ranked.withColumn("_gl_rank", rank).join(F.broadcast(pieces), (F.col("_gl_of") == F.col("_gl_hot")) & (F.col("_gl_part") == F.col("_gl_piece")), "left")
        ranked = ranked.withColumn("_gl_rank", F.col("_gl_rank") + F.coalesce("_gl_before", F.lit(0)))
    else:
        ranked = ranked.withColumn("_gl_rank", rank)
    # at most cells + shards * nodes rows: bounded at any scale
    joined = ranked.join(F.broadcast(table), (F.col("_gl_of") == F.col("_gl_cell")) & (F.col("_gl_rank") >= F.col("_gl_low")) & (F.col("_gl_rank") < F.col("_gl_high")))
    return joined.select(*(F.col(f"`{c}`") for c in df.columns if c not in ("shard", "slot")), F.col("_gl_shard").alias("shard"), (F.col("_gl_at") + F.col("_gl_rank") - F.col("_gl_low")).cast("long").alias("slot"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the law ``rows``; equal texts share a place on the ring."""
    text = text_of()
    rows = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("same"))
    return shard(rows, group="same").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
