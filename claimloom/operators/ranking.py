"""First-wins, last-wins, preferred-wins, and merges of pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import kept


def name_winners(contracts: DataFrame) -> DataFrame:
    """Contract for each name: one with a precondition wins, then the first loaded.

    Group minima are aggregates, so a hot name is combined before the shuffle.
    """
    order = F.struct((~F.col("has_pre")).alias("p"), "load_seq", "contract_cid")
    return contracts.groupBy("name").agg(F.min(order).alias("w"), F.count("*").alias("candidates")).select("name", F.col("w.contract_cid").alias("contract_cid"), F.col("w.load_seq").alias("load_seq"), "candidates")


def name_collisions(contracts: DataFrame) -> DataFrame:
    """Later contracts of a name and tier; inv-only duplicates of ``#euf#`` names are no collision."""
    first = contracts.groupBy("name", "has_pre").agg(F.min(F.struct("load_seq", "contract_cid")).alias("w"), F.count("*").alias("c")).filter("c > 1")
    late = contracts.join(first, ["name", "has_pre"]).filter(F.struct("load_seq", "contract_cid") > F.col("w"))
    return late.filter(~(F.col("name").contains("#euf#") & F.col("inv_only"))).select("name", "contract_cid", "load_seq")


def last_by(rows: DataFrame, keys: list[str], value: str, order: str = "load_seq") -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def first_by(rows: DataFrame, keys: list[str], value: str, order: str = "load_seq") -> DataFrame:
    return rows.groupBy(*keys).agg(F.min_by(value, order).alias(value))


def duplicates(rows: DataFrame, keys: list[str], order: str = "load_seq") -> DataFrame:
    """Rows after the first of their key."""
    first = rows.groupBy(*keys).agg(F.min(order).alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    return rows.join(first, keys).filter(F.col(order) > F.col("_first")).drop("_first", "_n")


def unique_names(rows: DataFrame, label: str, order: str) -> DataFrame:
    """Adds ``unique_name``: repeats get a suffix from 2 on.

    Rows are sorted over all partitions by label and order; a row's rank is its
    place in its own piece of the label plus the pieces before, so that a label
    that many rows have is not one task.
    """
    ranged = kept(rows.repartitionByRange(label, order).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy(label, "_p").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(label).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = kept(sizes.select(F.col(label).alias("_l"), F.col("_p").alias("_q"), F.coalesce(before, F.lit(0)).alias("_before")))
    within = F.row_number().over(Window.partitionBy(label, "_p").orderBy(order))
    placed = ranged.withColumn("_within", within).join(offsets, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_p") == F.col("_q")))
    rank = F.col("_within") + F.col("_before")
    return placed.withColumn("unique_name", F.when(rank == 1, F.col(label)).otherwise(F.concat_ws("_", F.col(label), rank.cast("string")))).select(*rows.columns, "unique_name")


def portfolio(runs: DataFrame, by: str, consensus: bool = False) -> DataFrame:
    """Verdict of the quickest definitive solver, or what all definitive ones agree on."""
    sure = F.col("verdict").isin("discharged", "unsatisfied")
    if consensus:
        out = runs.groupBy(by).agg(F.count_distinct(F.when(sure, F.col("verdict"))).alias("k"), F.min(F.when(sure, F.col("verdict"))).alias("v"))
        return out.select(by, F.when(F.col("k") == 1, F.col("v")).when(F.col("k") == 0, "undecidable").otherwise("disagreement").alias("verdict"))
    best = runs.groupBy(by).agg(F.min(F.when(sure, F.struct("wall_ms", "solver", "verdict"))).alias("w"))
    return best.select(by, F.coalesce("w.verdict", F.lit("undecidable")).alias("verdict"), F.col("w.solver").alias("solver"))


def chain(runs: DataFrame, by: str) -> DataFrame:
    """Verdict of the first definitive solver in listed order."""
    sure = F.col("verdict").isin("discharged", "unsatisfied")
    best = runs.groupBy(by).agg(F.min(F.when(sure, F.struct("step", "verdict"))).alias("w"))
    return best.select(by, F.coalesce("w.verdict", F.lit("undecidable")).alias("verdict"))


def merge_pools(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left``, and those of ``right`` whose key it lacks."""
    return left.unionByName(right.join(left.select(key).distinct(), key, "left_anti"))


def merge_collisions(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    l = left.select(key, F.col(value).alias("kept"))  # noqa: E741
    return right.select(key, F.col(value).alias("dropped")).join(l, key).filter(~F.col("kept").eqNullSafe(F.col("dropped")))


def gaps(all_names: DataFrame, pinned: DataFrame, excluded: DataFrame) -> DataFrame:
    """Names that are neither pinned nor excluded."""
    return all_names.distinct().join(pinned.unionByName(excluded), all_names.columns, "left_anti")


def pool_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """Ids on one side only, with the side."""
    key = first.columns
    return first.distinct().join(second, key, "left_anti").withColumn("side", F.lit("first")).unionByName(second.distinct().join(first, key, "left_anti").withColumn("side", F.lit("second")))


def top(rows: DataFrame, by: str, k: int) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(k)
