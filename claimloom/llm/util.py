"""Helpers shared by the document operators."""

from __future__ import annotations

import atexit
import gc
import json
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: White space that separates words: ASCII only.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a variable.

    Without it Catalyst may inline the value into a lambda and evaluate it for
    every element of an array.
    """
    return F.transform(F.array(value), body)[0]


def running(a: Column, of) -> Column:
    """Running results of an associative ``of`` over an array: by doubling, so that n values cost n log n steps."""
    powers = F.transform(F.sequence(F.lit(0), F.length(F.bin(F.size(a)))), lambda k: F.call_function("shiftleft", F.lit(1), k))
    step = lambda acc, p: F.transform(acc, lambda x, i: F.when(i >= p, of(F.get(acc, i - p), x)).otherwise(x))
    return F.aggregate(powers, a, step)


def prefix_sums(a: Column) -> Column:
    return running(a, lambda x, y: x + y)


def computed(df: DataFrame, values: Column) -> DataFrame:
    """``df`` with the fields of the struct ``values`` as columns, replacing any of these names.

    The struct stays a projection of its own: Catalyst does not copy an
    expression that is not cheap into a projection that reads it more than once.
    """
    kept, made = "_kept_", "_made_"
    before = df.columns
    out = df.select(F.struct(*[F.col(f"`{c}`") for c in before]).alias(kept), values.alias(made))
    new = out.schema[made].dataType.names
    taken = {c.lower() for c in new}
    return out.select(*[F.col(f"{kept}.`{c}`") for c in before if c.lower() not in taken], *[F.col(f"{made}.`{c}`") for c in new])


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+``; a null text has none.

    White space becomes blanks first: splitting at a fixed blank needs no regular expression.
    """
    plain = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def literal_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of given rows, held in the plan as a literal."""
    text = F.lit(json.dumps(rows))
    return spark.range(1).select(F.inline(F.from_json(text, f"array<struct<{schema}>>")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm.get() if jvm.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="claimloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


_written: list[tuple[SparkSession, str]] = []


def stored(df: DataFrame, name: str, batch: int = 2000, into: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; with ``into``, add it to a table written before.

    This cuts the lineage: a lost executor costs a reread, not a recomputation.
    The table goes when the process ends, or by :func:`discard`. Python steps on
    the way get ``batch`` rows at a time, fewer where rows are long.
    """
    spark = df.sparkSession
    path = into._claimloom_path if into is not None else os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    wanted = {CLEANUP: "true", "spark.sql.execution.arrow.maxRecordsPerBatch": str(batch)}  # the table stands, so the shuffle files behind it can go at once
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        df.write.mode("append").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    if into is None:
        _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._claimloom_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`stored`."""
    path = getattr(df, "_claimloom_path", None)
    if path:
        _remove(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@atexit.register
def _discard_all() -> None:
    for spark, path in _written:
        _remove(spark, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
