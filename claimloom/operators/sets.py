"""Exact ids of sets of any size: BLAKE3 as a distributed tree.

The id of a set is the digest of its sorted members as canonical JSON. Members
are sorted by range, so that a large set lies over many tasks; sums over the
tasks, then within them, give each member its place in the text. The text comes
together in chunks of 1,024 bytes alone, each of which gives a chaining value, and
these are folded ``FAN`` at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import batch
from .graph import kept

#: Chaining values that are folded in one row, a power of two.
FAN = 1024


def quoted(text: Column) -> Column:
    """A string as canonical JSON."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    rare = out
    for c in range(32):
        rare = F.replace(rare, F.lit(chr(c)), F.lit(f"\\u{c:04x}"))
    return F.concat(F.lit('"'), F.when(text.rlike("[\\x00-\\x1f]"), rare).otherwise(out), F.lit('"'))


@F.pandas_udf(T.BinaryType())
def _chunk_words(data: pd.Series, number: pd.Series, only: pd.Series) -> pd.Series:
    words = batch.chunk_words([bytes(d) for d in data], number.to_numpy(np.int64), only.to_numpy(bool)) if len(data) else []
    return pd.Series([w.astype("<u4").tobytes() for w in words], dtype=object)


@F.pandas_udf(T.BinaryType())
def _folded(values: pd.Series, root: pd.Series) -> pd.Series:
    if not len(values):
        return pd.Series([], dtype=object)
    count = values.map(len).to_numpy(np.int64)
    words = np.frombuffer(b"".join(bytes(v) for row in values for v in row), "<u4").reshape(-1, 16)
    out = batch.fold(words[:, :8], np.repeat(np.arange(len(values)), count), root.to_numpy(bool))
    single = count == 1  # goes up as it is; a set of one chunk keeps its digest
    out[single] = words[np.cumsum(count)[single] - 1]
    return pd.Series([w.astype("<u4").tobytes() for w in out], dtype=object)


def tree_ids(rows: DataFrame, by: list[str], text: Column, order: Column, begin: str, between: str, end: str) -> DataFrame:
    """(by, n, n_bytes, cid) of each group's texts in order, joined by ``between``, with ``begin`` and ``end`` around them.

    No group comes together in a row or a task, whatever its size. Texts that sort alike must be equal.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    named = rows.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], order.alias("_o"), text.cast("binary").alias("_e")).filter("_e is not null")
    sort = [*keys, "_o"]
    placed = kept(named.repartitionByRange(*sort).sortWithinPartitions(*sort).select(*keys, "_e", F.monotonically_increasing_id().alias("_at")))
    task = F.shiftright("_at", 33)
    size = F.octet_length("_e").cast("bigint") + len(between.encode())
    lift = len(begin.encode()) - len(between.encode())  # the first text has ``begin`` before it in place of ``between``
    tasks = placed.groupBy(*keys, task.alias("_t")).agg(F.sum(size).alias("_s"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_s").over(Window.partitionBy(*keys).orderBy("_t").rowsBetween(Window.unboundedPreceding, -1))
    tasks = kept(tasks.withColumn("_before", before))
    within = F.sum(size).over(Window.partitionBy(*keys, "_t").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    key_is = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    inside = placed.withColumn("_t", task).withColumn("_w", F.coalesce(within, F.lit(0)))
    on = [*key_is(inside, tasks), inside["_t"] == tasks["_t"]]
    met = inside.join(tasks, on).select(*[inside[k] for k in keys], "_e", "_w", "_before")
    first = F.col("_before").isNull() & (F.col("_w") == 0)
    piece = F.concat(F.when(first, F.lit(begin.encode())).otherwise(F.lit(between.encode())), "_e")
    place = F.when(first, 0).otherwise(F.coalesce("_before", F.lit(0)) + F.col("_w") + lift).cast("bigint")
    whole = kept(tasks.groupBy(*keys).agg((F.sum("_s") + lift).cast("bigint").alias("_p"), F.sum("_n").alias("n")))
    pieces = met.select(*keys, piece.alias("_e"), place.alias("_p")).unionByName(whole.select(*keys, F.lit(end.encode()).alias("_e"), "_p")).filter("octet_length(_e) > 0")
    last = F.col("_p") + F.octet_length("_e") - 1
    cut = pieces.withColumn("_c", F.explode(F.sequence(F.floor(F.col("_p") / batch.CHUNK), F.floor(last / batch.CHUNK))))
    skip = F.greatest(F.col("_c") * batch.CHUNK - F.col("_p"), F.lit(0))
    room = (F.col("_c") + 1) * batch.CHUNK - F.col("_p") - skip
    cut = cut.select(*keys, "_c", F.struct("_p", F.col("_e").substr((skip + 1).cast("int"), room.cast("int")).alias("_e")).alias("_f"))
    joined = F.aggregate(F.array_sort(F.collect_list("_f")), F.lit(b""), lambda a, x: F.concat(a, x["_e"]))
    n_bytes = (F.col("_p") + len(end.encode())).alias("n_bytes")
    totals = whole.select(*[F.col(k).alias(f"{k}_") for k in keys], "n", n_bytes)
    same = lambda df: [df[k].eqNullSafe(totals[f"{k}_"]) for k in keys] or F.lit(True)
    chunks = cut.groupBy(*keys, "_c").agg(joined.alias("_d"))
    chunks = chunks.join(totals, same(chunks)).select(*keys, "n", "n_bytes", "_c", "_d")
    values = kept(chunks.select(*keys, "n", "n_bytes", "_c", _chunk_words("_d", "_c", F.col("n_bytes") <= batch.CHUNK).alias("_v")))
    most = values.agg(F.max("_c")).first()[0]
    while most:
        up = F.shiftright("_c", FAN.bit_length() - 1)
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("_c", "_v"))), lambda x: x["_v"])
        level = values.withColumn("_up", up).groupBy(*keys, "n", "n_bytes", "_up").agg(ordered.alias("_vs"))
        tops = level.groupBy(*[F.col(k).alias(f"{k}_") for k in keys]).agg(F.max("_up").alias("_top"))
        level = level.join(tops, [level[k].eqNullSafe(tops[f"{k}_"]) for k in keys] or F.lit(True))
        values = kept(level.select(*keys, "n", "n_bytes", F.col("_up").alias("_c"), _folded("_vs", F.col("_top") == 0).alias("_v")))
        most >>= FAN.bit_length() - 1
    cid = F.concat(F.lit("blake3-512:"), F.lower(F.hex("_v"))).alias("cid")
    return values.select(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)], "n", "n_bytes", cid)


def set_ids(rows: DataFrame, by: list[str], member: str, distinct: bool = False) -> DataFrame:
    """(by, n, n_distinct, n_bytes, set_cid): ids of the groups' members as canonical JSON arrays, sorted, duplicates kept.

    ``distinct``: a group with a duplicate has no id. Null members do not count; groups without members have no row.
    """
    found = tree_ids(rows, by, quoted(F.col(member)), F.col(member), "[", ",", "]")
    each = rows.filter(F.col(member).isNotNull()).groupBy(*by, member).count().groupBy(*[F.col(b).alias(f"_{b}") for b in by]).agg(F.count(F.lit(1)).alias("n_distinct"))
    out = found.join(each, [found[b].eqNullSafe(each[f"_{b}"]) for b in by] or F.lit(True))
    cid = F.when(F.lit(not distinct) | (F.col("n") == F.col("n_distinct")), F.col("cid"))
    return out.select(*by, "n", "n_distinct", "n_bytes", cid.alias("set_cid"))
