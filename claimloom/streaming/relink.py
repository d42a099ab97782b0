"""Incremental linking: slots (kit, file) are replaced, and the link result follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import linking


def latest(slots: DataFrame) -> DataFrame:
    """Last version of each slot (kit, file, version, edges)."""
    return slots.groupBy("kit", "file").agg(F.max(F.struct("version", "edges")).alias("s")).select("kit", "file", F.col("s.version").alias("version"), F.col("s.edges").alias("edges"))


def relink(slots: DataFrame, contracts: DataFrame) -> DataFrame:
    """Link outcomes of the last version of all slots."""
    edges = latest(slots).select("file", F.inline("edges"))
    return linking.obligations(edges, contracts)


def affected(changed_names: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that a change of contracts (kit, name) can touch: only these are linked again."""
    keyed = edges.withColumn("_key", F.col("target_symbol"))
    names = changed_names.select(F.concat_ws(":", "kit", "name").alias("_key")).distinct()
    return keyed.join(names, "_key", "left_semi").drop("_key")


def start(stream: DataFrame, contracts: DataFrame, out: str, checkpoint: str):
    """Run the upsert as a stream.

    Each batch is merged into the slots written so far and the outcome of that
    version is written beside it, under the batch number, so a batch that runs
    again gives the same files.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark: SparkSession = df.sparkSession
        seen = df.select("kit", "file", "version", "edges")
        if number > 0:
            seen = seen.unionByName(spark.read.parquet(f"{out}/slots/batch={number - 1}"))
        latest(seen).write.mode("overwrite").parquet(f"{out}/slots/batch={number}")
        slots = spark.read.parquet(f"{out}/slots/batch={number}")
        relink(slots, contracts).write.mode("overwrite").parquet(f"{out}/links/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cached(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files whose content and dependencies were resolved before, and the rest."""
    key = ["content_cid", "dep_cid"]
    return files.join(cache, key), files.join(cache, key, "left_anti")
