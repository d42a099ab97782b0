"""Exact top-k search by inner product.

Vectors are packed into shards, one matrix a row, where they lie; the queries
among them are packed beside them, and come to the shards in waves of a bounded
size. A tile is the matrix product of a query block and a shard. Of each tile
the k best candidates of every query go into one list per query and task, and
the lists of the tasks are merged as a tree, ``FAN`` at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import util

K = 20
#: Vectors and components of a shard, at most (but for one long vector).
TILE_ROWS, TILE_CELLS = 8192, 1 << 21
#: Bytes of the query blocks of a wave with their lists, at most (but for one large block).
WAVE_BYTES = 64 << 20
#: Bytes that a query's list takes.
LIST_BYTES = 5 * 8 * K
#: Lists of a query block that one task merges at once.
FAN = 16

LONG = np.iinfo(np.int64)


def matrix(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Vectors as the rows of a matrix in the smallest type that holds them; missing components are 0."""
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        m = flat.reshape(len(lengths), width)
    else:
        m = np.zeros((len(lengths), width))
        m[np.arange(width) < lengths[:, None]] = flat
    most = np.abs(m).max(initial=0)
    kind = next((t for t in (np.int8, np.int16, np.int32) if most <= np.iinfo(t).max), np.float64)
    return np.ascontiguousarray(m, dtype=kind)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers; one that leaves long stands at its limit."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d].astype(np.float64), b[:, :d].astype(np.float64)
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, d)
    if bound < 2.0**53:  # every sum on the way is a whole number that doubles hold
        return (a @ b.T).astype(np.int64)
    if bound < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = lambda m: np.array([int(x) for x in m.ravel()], dtype=object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, LONG.min, LONG.max).astype(np.int64)


class Best:
    """The k best candidates of each query of a block. A place is free where a query has fewer."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.held = [np.zeros((n, 0), t) for t in (np.int64, np.int64, bool, np.int64, bool)]  # score, id, id is null, row, free

    def add(self, *more: np.ndarray) -> None:
        score, ids, null, at, free = (np.concatenate(x, axis=1) for x in zip(self.held, more, strict=True))
        order = np.lexsort((at, ids, null, ~score, free), axis=-1)[:, : self.k]  # ~x falls as x rises, over all longs
        self.held = [np.take_along_axis(x, order, axis=1) for x in (score, ids, null, at, free)]

    def tile(self, queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, null: np.ndarray, at: np.ndarray) -> None:
        """Queries (``own``: their rows) against a shard whose rows are in the order of ties."""
        score = products(queries, vectors)
        itself = own[:, None] == at
        n, k = score.shape[1], min(self.k, score.shape[1])
        if n > 2 * k and np.abs(score).max(initial=0) < 2**62 // (n + 1):
            key = score * n + (n - 1 - np.arange(n))  # ties fall to the smaller column, so the k largest keys are one set
            key[itself] = LONG.min
            cols = np.argpartition(key, n - k, axis=1)[:, n - k :]
        else:
            cols = np.lexsort((np.broadcast_to(np.arange(n), score.shape), ~score, itself), axis=-1)[:, :k]
        self.add(*(np.take_along_axis(np.broadcast_to(x, score.shape), cols, axis=1) for x in (score, ids, null, at, itself)))

    def packed(self) -> bytes:
        return np.stack([x.astype(np.int64) for x in self.held]).tobytes()

    def add_packed(self, data: bytes) -> None:
        score, ids, null, at, free = np.frombuffer(data, np.int64).reshape(5, self.n, -1)
        self.add(score, ids, null.astype(bool), at, free.astype(bool))


PACKED = "shard bigint, is_query boolean, n int, kind string, ids binary, nulls binary, ats binary, vectors binary"
PACKED_TYPE = pa.schema([("shard", pa.int64()), ("is_query", pa.bool_()), ("n", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()), ("nulls", pa.binary()), ("ats", pa.binary()), ("vectors", pa.binary())])


def _packed_rows(ids, null, at, m):
    """The shard of these rows, and the block of the queries among them."""
    order = np.lexsort((at, ids, null))
    ids, null, at, m = ids[order], null[order], at[order], m[order]
    for is_query, rows in ((False, slice(None)), (True, np.flatnonzero(~null & (ids % 20 == 0)))):
        if len(at[rows]):
            yield (int(at.min()), is_query, len(at[rows]), m.dtype.str, *(x[rows].tobytes() for x in (ids, null, at, m)))


def _pack(tile_rows: int):
    """Shards and query blocks of one task."""

    def run(batches):
        held: list[tuple] = []
        rows = cells = 0

        def flush():
            ids, null, at, flat, lengths = (np.concatenate(x) for x in zip(*held, strict=True))
            out = list(_packed_rows(ids, null, at, matrix(flat, lengths)))
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), PACKED_TYPE, strict=True)], schema=PACKED_TYPE)

        for whole in batches:
            for batch in (whole.slice(i, min(512, tile_rows)) for i in range(0, whole.num_rows, min(512, tile_rows))):
                v = batch.column(1)
                if rows and (rows + batch.num_rows > tile_rows or cells + len(v.flatten()) > TILE_CELLS):
                    yield flush()
                    held, rows, cells = [], 0, 0
                ids = batch.column(0)
                held.append((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), batch.column(2).to_numpy(), v.flatten().to_numpy(zero_copy_only=False), np.asarray(v.value_lengths())))
                rows, cells = rows + batch.num_rows, cells + len(v.flatten())
        if rows:
            yield flush()

    return run


def _unpacked(n, kind, ids, nulls, ats, vectors) -> tuple:
    return np.frombuffer(vectors, kind).reshape(n, -1), np.frombuffer(ids, np.int64), np.frombuffer(nulls, bool), np.frombuffer(ats, np.int64)


LISTS = "block bigint, node bigint, n int, lists binary"


def _tiles(k: int):
    """Tiles of one task: one list for each query that it met."""

    def run(batches):
        best: dict[int, Best] = {}
        node = 0
        for batch in batches:
            for r in batch.itertuples(index=False):
                node = r.node
                vectors, ids, null, at = _unpacked(r.n, r.kind, r.ids, r.nulls, r.ats, r.vectors)
                queries, _, _, own = _unpacked(r.q_n, r.q_kind, r.q_ids, r.q_nulls, r.q_ats, r.q_vectors)
                best.setdefault(r.block, Best(r.q_n, k)).tile(queries, own, vectors, ids, null, at)
        for block, b in best.items():
            yield pd.DataFrame([(block, node, b.n, b.packed())], columns=["block", "node", "n", "lists"])

    return run


def _merge(k: int, fan: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        b = Best(int(part["n"].iloc[0]), k)
        for data in part["lists"]:
            b.add_packed(data)
        return pd.DataFrame([(part["block"].iloc[0], part["node"].iloc[0] // fan, b.n, b.packed())], columns=["block", "node", "n", "lists"])

    return run


RESULT = "query_id bigint, rank int, vec_id bigint, score bigint"


def _result(batches):
    for batch in batches:
        for lists, of in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            queries = np.frombuffer(of, np.int64)
            score, ids, null, _, free = np.frombuffer(lists, np.int64).reshape(5, len(queries), -1)
            there = free == 0
            cols = [pa.array(np.broadcast_to(queries[:, None], there.shape)[there]), pa.array(np.cumsum(there, axis=1)[there].astype(np.int32)), pa.array(ids[there], mask=null[there] == 1), pa.array(score[there])]
            yield pa.RecordBatch.from_arrays(cols, names=["query_id", "rank", "vec_id", "score"])


def _whole(x: Column, scale: float) -> Column:
    """floor(scale * x) as a double: from 2^53 on a double is a whole number already."""
    y = F.least(F.greatest(x * F.lit(float(scale)), F.lit(-1.7e308)), F.lit(1.7e308))
    return F.when(F.abs(y) < F.lit(2.0**53), F.floor(y).cast("double")).otherwise(y)


def _waves(blocks: DataFrame, most_bytes: int) -> int:
    """Waves to deal the query blocks to, so that none is larger than its bound."""
    weight = F.sum(F.octet_length("vectors") + F.col("n") * LIST_BYTES)
    whole = blocks.agg(weight.alias("w"), F.max(F.octet_length("vectors") + F.col("n") * LIST_BYTES).alias("most"), F.count(F.lit(1)).alias("n")).first()
    if not whole["w"]:
        return 0
    waves = min(-(-whole["w"] // most_bytes), whole["n"])
    while waves > 1 and blocks.groupBy(_wave(waves)).agg(weight.alias("w")).agg(F.max("w")).first()[0] > max(most_bytes, 2 * whole["most"]):
        waves *= 2
    return waves


def _wave(waves: int) -> Column:
    return F.pmod(F.xxhash64("shard"), F.lit(waves))


def top_k(vectors: DataFrame, k: int = K, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", tile_rows: int = TILE_ROWS, wave_bytes: int = WAVE_BYTES, fan: int = FAN) -> DataFrame:
    """The k highest scores of every query: query_id, rank from 1, vec_id, score.

    A component x counts as floor(scale * x). Queries are the rows whose id is
    divisible by 20; candidates are all rows but the query's own row, so another
    row of the same id is one. Ties go to the smaller id, a null id comes last
    and is never a query. Null vectors and vectors with null or non-finite
    components take no part; missing components of shorter vectors are 0, so an
    empty one scores 0. Sums are exact; one that leaves long stands at its limit.
    Query blocks are broadcast in waves of ``wave_bytes``, each of which reads the
    packed shards once. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    slim = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("raw"))
    bad = F.exists("raw", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    slim = slim.filter(F.col("raw").isNotNull() & ~bad).select("vec_id", F.transform("raw", lambda x: _whole(x, scale)).alias("v"), F.monotonically_increasing_id().alias("at"))
    packed = util.stored(slim.mapInArrow(_pack(tile_rows), PACKED), "packed", batch=512)
    shards, blocks = packed.filter("not is_query").drop("is_query").withColumn("node", F.spark_partition_id().cast("bigint")), packed.filter("is_query")
    found, waves = None, _waves(blocks, wave_bytes)
    for wave in range(waves):
        asked = blocks.filter(_wave(waves) == wave).select(F.col("shard").alias("block"), *[F.col(c).alias(f"q_{c}") for c in ("n", "kind", "ids", "nulls", "ats", "vectors")])
        lists = util.stored(shards.crossJoin(F.broadcast(asked)).mapInPandas(_tiles(k), LISTS), "lists", batch=4)  # tiles of blocks: the wave's size was checked
        nodes = lists.agg(F.max("node")).first()[0]
        while nodes:
            merged = util.stored(lists.groupBy("block", F.floor(F.col("node") / fan)).applyInPandas(_merge(k, fan), LISTS), "merged")
            util.discard(lists)
            lists, nodes = merged, nodes // fan
        ids = asked.select("block", "q_ids")
        found = util.stored(lists.join(ids, "block").select("lists", "q_ids").mapInArrow(_result, RESULT), "found", batch=16, into=found)
        util.discard(lists)
    util.discard(packed)
    return found if found is not None else spark.createDataFrame([], RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(util.table(spark, sf_dir, "embeddings"))


SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
q as (select * from v where vec_id % 20 = 0),
s as (select q.vec_id as query_id, v.vec_id, list_inner_product(q.v::double[], v.v::double[])::bigint as score from q join v on q.vec_id <> v.vec_id),
r as (select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""
