"""Uniform shuffle into shards of exact size.

Rows sit in source blocks, the partitions of the table. A communication matrix says how many rows each block
sends to each shard; its rows are drawn from the multivariate hypergeometric
law, which is the law that a uniform shuffle of all rows induces. Each block
permutes its rows and cuts the permutation by its row of the matrix, the rows
are exchanged, and each shard permutes again.
"""

from __future__ import annotations

import itertools
import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import util

SHARDS = 40
#: Source blocks at most: more partitions are read several at a time.
MOST_BLOCKS = 20_000
#: Rows of a cell of a shard, on average at most, and cells of a shard, at least.
CELL_ROWS, LEAST_CELLS = 100_000, 4


def _log_pmf(k: int, good: int, bad: int, n: int) -> float:
    def choose(a, b):
        return math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)

    return choose(good, k) + choose(bad, n - k) - choose(good + bad, n)


def hypergeometric(rng: random.Random, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without return are good. Inversion outwards from the mode."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    u = rng.random()
    up = down = mode
    p_up = p_down = math.exp(_log_pmf(mode, good, bad, n))
    u -= p_up
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (n - up) / ((up + 1) * (bad - n + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - n + down) / ((good - down + 1) * (n - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
        if p_up < 1e-300 and p_down < 1e-300:
            break
    return mode


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Row counts from each block (rows) to each shard (columns), with the given sums."""
    rng, left, out = random.Random(seed), list(shards), []
    for size in blocks:
        row, rest, free = [], size, sum(left)
        for s, room in enumerate(left):
            k = hypergeometric(rng, room, free - room, rest)
            free -= room
            rest -= k
            left[s] -= k
            row.append(k)
        out.append(row)
    return out


def shuffle_into_shards(docs: DataFrame, shards: int = SHARDS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Shard sizes differ by one row at most; within them every assignment is
    equally likely. ``slot`` runs from 0 without gaps in each shard. Source blocks
    are the partitions of ``docs``: each is permuted where it lies and written
    with the places of its rows, so that what follows reads fixed places and a
    task that runs again gives the same rows. A null text has size 16 and the CRC
    of no bytes. Repeated rows and ties are rows of their own; very long texts
    count whole and do not travel; an empty table gives no rows; other columns
    are ignored.
    """
    spark = docs.sparkSession
    bytes_ = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(bytes_).cast("bigint") + 16).alias("size"), F.crc32(bytes_).alias("text_crc32"))
    slim = slim.coalesce(MOST_BLOCKS).withColumn("_at", F.monotonically_increasing_id())
    permuted = slim.sortWithinPartitions(F.xxhash64(F.lit(seed), F.lit(1), "_at"), "_at").drop("_at").withColumn("place", F.monotonically_increasing_id())
    permuted = util.stored(permuted, "permuted")
    block, rank = F.shiftright("place", 33).cast("int"), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))  # a place is the partition and the row's number in it
    counts = sorted(permuted.groupBy(block.alias("block")).count().collect())  # one number per partition, MOST_BLOCKS at most
    total = sum(n for _, n in counts)
    matrix = communication_matrix([n for _, n in counts], [total // shards + (s < total % shards) for s in range(shards)], seed)
    cuts = util.literal_rows(spark, [{"block": b, "ends": list(itertools.accumulate(row))} for (b, _), row in zip(counts, matrix, strict=True)], "block int, ends array<bigint>")
    n_cells = max(LEAST_CELLS, -(-total // (shards * CELL_ROWS)))
    second = F.xxhash64(F.lit(seed), F.lit(2), "place")
    placed = permuted.withColumn("block", block).join(cuts, "block").withColumn("shard", F.size(F.filter("ends", lambda e: e <= rank)))
    placed = placed.select("doc_id", "size", "text_crc32", "shard", "place", second.alias("second"), F.pmod(second, F.lit(n_cells)).cast("int").alias("cell"))
    cells = util.stored(placed.groupBy("shard", "cell").count(), "cells")
    offsets = cells.withColumn("offset", F.sum("count").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)))
    offsets = offsets.select("shard", "cell", F.coalesce("offset", F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("second", "place"))
    return placed.withColumn("within", within).join(offsets, ["shard", "cell"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("offset") + F.col("within") - 1).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return shuffle_into_shards(util.table(spark, sf_dir, "documents"))
