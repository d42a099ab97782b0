"""Prefix trie of conversations.

A turn's label is a digest of its role and text, a conversation the string of
its labels. Strings are brought into order by a range sort that also splits
copies of one string, and cut into shards of neighbours. A shard's trie is
laid out level by level: the LOUDS bitvector (for each node a one for every
child, then a zero) with the labels beside it; parents follow from it by rank
and select, and counts are rolled up level by level from the last with
``np.add.at``.

Two shards can only share nodes on a shard's outer paths: those of its first and
its last string. These nodes, the heavy upper levels among them, are left open
by the shard and merged apart: shards are taken ``FAN`` neighbours at a time,
their outer paths laid over each other, and the paths inside are settled, until
one group is left. Nodes settled below an open parent get its conversation in
the end, by a join.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import util

#: Turns of a shard, at most, but for one conversation that has more.
SHARD_TURNS = 1 << 18
#: Neighbouring shards whose outer paths are merged at once.
FAN = 32
LABEL = 16


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, labels, sizes): the labels of the rebuilt turns as one binary string, and the code points of their texts."""
    turn = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).filter("conv_id is not null")
    label = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    row = F.struct(F.col("turn").isNotNull().alias("there"), "turn", "role", F.substring("text", 1, 32).alias("head"), label.alias("label"), F.length("text").alias("size"))
    own = turn.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("t"))
    own = own.select("conv_id", F.unhex(F.array_join(F.col("t.label"), "")).alias("labels"), F.col("t.size").alias("sizes"))
    own = util.stored(own, "turns")
    head = own.filter("conv_id % 100 = 0").selectExpr("conv_id as base", f"substring(labels, 1, {5 * LABEL}) as base_labels", "slice(sizes, 1, 5) as base_sizes")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(6)).cast("int")
    both = own.withColumn("base", F.expr("conv_id - conv_id % 100")).withColumn("h", h).join(head, "base", "left")
    labels = f"concat(substring(coalesce(base_labels, x''), 1, {LABEL} * h), substring(labels, {LABEL} * h + 1))"
    sizes = "concat(slice(coalesce(base_sizes, cast(array() as array<int>)), 1, h), slice(sizes, h + 1, size(sizes)))"
    return both.selectExpr("conv_id", f"{labels} as labels", f"{sizes} as sizes")


def louds(degrees: np.ndarray) -> np.ndarray:
    """The bitvector of a trie: for each node, level by level, a one for every child, then a zero."""
    bits = np.ones(int(degrees.sum()) + len(degrees), bool)
    bits[np.cumsum(degrees) + np.arange(len(degrees))] = False
    return bits


def parents(bits: np.ndarray) -> np.ndarray:
    """Parent of every node (the root's is 0): the k-th one stands for node k, among the ones of its parent."""
    ones = np.flatnonzero(bits)
    return np.concatenate([[0], ones - np.arange(len(ones))])  # zeros before it


class Shard:
    """The trie of strings that lie next to each other in their order."""

    def __init__(self, strings: list[bytes], sizes: np.ndarray, convs: np.ndarray):
        lengths = np.array([len(s) // LABEL for s in strings], np.int64)
        at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        flat = np.frombuffer(b"".join(strings), np.uint64).reshape(-1, LABEL // 8)
        self.strings, self.convs, self.lengths = strings, convs, lengths
        node = np.zeros(len(strings), np.int64)  # of each string, on the level
        levels, degrees, first, last = [0], [np.zeros(1, np.int64)], [0], [0]
        labels, size, count, least, starts = [np.zeros((1, LABEL // 8), np.uint64)], [np.zeros(1, np.int64)], [np.array([len(strings)])], [np.array([convs.min()])], [np.zeros(1, np.int64)]
        alive, total, depth = np.arange(len(strings)), 1, 0
        while True:
            depth += 1
            alive = alive[lengths[alive] >= depth]
            if not len(alive):
                break
            place = at[alive] + depth - 1
            own = flat[place]
            new = np.ones(len(alive), bool)
            new[1:] = (node[alive[1:]] != node[alive[:-1]]) | (own[1:] != own[:-1]).any(axis=1)
            begin = np.flatnonzero(new)
            np.add.at(degrees[-1], node[alive[begin]] - levels[-1], 1)
            labels.append(own[begin])
            size.append(sizes[place[begin]])
            count.append(np.diff(np.append(begin, len(alive))))
            least.append(np.minimum.reduceat(convs[alive], begin))
            starts.append(alive[begin])
            degrees.append(np.zeros(len(begin), np.int64))
            node[alive] = total + np.cumsum(new) - 1
            levels.append(total)
            total += len(begin)
            for path, end in ((first, 0), (last, len(strings) - 1)):
                if lengths[end] >= depth:
                    path.append(int(node[end]))
        self.levels = np.append(levels, total)
        self.degrees, self.labels, self.size, self.count, self.least, self.starts = map(np.concatenate, (degrees, labels, size, count, least, starts))
        self.bits = louds(self.degrees)
        self.parent = parents(self.bits)
        self.depth = np.repeat(np.arange(len(self.levels) - 1), np.diff(self.levels))
        self.first, self.last = first, last
        self.open = np.zeros(total, bool)
        self.open[first], self.open[last] = True, True
        self._roll_up()

    def _roll_up(self) -> None:
        """Sums over subtrees, level by level from the last. An open node has the sums of what is settled below it alone."""
        closed = ~self.open
        self.leaves = np.where(closed & (self.degrees == 0), 1, 0)
        self.saved = np.where(closed, (self.count - 1) * self.size, 0)
        self.children = np.zeros(len(self.parent), np.int64)
        for begin, end in zip(self.levels[-2:0:-1], self.levels[:1:-1], strict=True):
            up = np.arange(begin, end)[closed[begin:end]]
            for sums, own in ((self.leaves, self.leaves), (self.saved, self.saved), (self.children, np.ones(len(self.parent), np.int64))):
                np.add.at(sums, self.parent[up], own[up])

    def ends(self, node: int) -> bytes:
        """Conversations that end at a node, in the order of their ids: the first of the strings that reach it."""
        begin = int(self.starts[node])
        d, end = self.depth[node], begin + int(self.count[node])
        n = int(np.searchsorted(self.lengths[begin:end] > d, True)) if self.lengths[begin] == d else 0
        return ",".join(map(str, self.convs[begin : begin + n].tolist())).encode()

    def digests(self) -> dict[int, bytes]:
        """A digest of the labels down to every open node."""
        out = {0: b""}
        for v in np.flatnonzero(self.open)[1:].tolist():
            out[v] = hashlib.md5(out[int(self.parent[v])] + self.labels[v].tobytes()).digest()
        return out


NODES = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
MADE = f"{NODES}, shard bigint, number bigint, digest binary, parent binary, size bigint, paths int, piece binary"
TYPES = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}
MADE_TYPE = pa.schema([(c.split()[0], TYPES[c.split()[1]]) for c in MADE.split(", ")])
NONE = hashlib.sha256(b"").hexdigest()
ON_FIRST, ON_LAST = 1, 2


def _rows_of(shard: Shard, task: int, number: int) -> pa.RecordBatch:
    """Settled nodes, open nodes (with a digest), and for open nodes the ids that end there (with a piece)."""
    digest = shard.digests()
    opened = np.array(sorted(digest), np.int64)
    rest = np.flatnonzero(~shard.open)
    order = np.concatenate([rest, opened])
    n, k = len(rest), len(opened)
    ends = [e and hashlib.sha256(e).hexdigest() or NONE for e in (shard.ends(v) if shard.lengths[shard.starts[v]] == shard.depth[v] else b"" for v in rest.tolist())]
    pieces = [(digest[v], e, int(shard.convs[shard.starts[v]])) for v in opened.tolist() if (e := shard.ends(v))]
    above = shard.parent[order].tolist()
    below_open = shard.open[shard.parent[rest]]
    first, last = set(shard.first), set(shard.last)
    nulls, p = (lambda m: [None] * m), len(pieces)
    cols = {
        "conv_id": shard.least[order].tolist() + [x[2] for x in pieces],
        "depth": shard.depth[order].tolist() + nulls(p),
        "parent_conv_id": pa.array(np.concatenate([shard.least[shard.parent[rest]], np.zeros(k + p, np.int64)]), mask=np.concatenate([below_open, np.ones(k + p, bool)])),
        "n_convs": shard.count[order].tolist() + nulls(p),
        "n_children": shard.children[order].tolist() + nulls(p),
        "n_leaves": shard.leaves[order].tolist() + nulls(p),
        "saved_tokens": shard.saved[order].tolist() + nulls(p),
        "ends_sha256": ends + nulls(k + p),
        "shard": [task] * (n + k + p),
        "number": [number] * (n + k + p),
        "digest": nulls(n) + [digest[v] for v in opened.tolist()] + [x[0] for x in pieces],
        "parent": [digest[v] if o else None for v, o in zip(above[:n], below_open.tolist(), strict=True)] + [digest[u] if v else None for u, v in zip(above[n:], opened.tolist(), strict=True)] + nulls(p),
        "size": shard.size[order].tolist() + nulls(p),
        "paths": nulls(n) + [ON_FIRST * (v in first) + ON_LAST * (v in last) for v in opened.tolist()] + nulls(p),
        "piece": nulls(n + k) + [x[1] for x in pieces],
    }
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(cols.values(), MADE_TYPE, strict=True)], schema=MADE_TYPE)


def _shards(shard_turns: int):
    """Tries of the shards of one task."""

    def run(batches):
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        strings: list[bytes] = []
        sizes: list[np.ndarray] = []
        convs: list[int] = []
        turns = 0

        def flush():
            return _rows_of(Shard(strings, np.concatenate(sizes).astype(np.int64), np.array(convs, np.int64)), task, number)

        for batch in batches:
            for conv, labels, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                here = max(1, len(labels) // LABEL)
                if convs and turns + here > shard_turns:
                    yield flush()
                    strings, sizes, convs, turns, number = [], [], [], 0, number + 1
                strings.append(labels)
                sizes.append(size.values.to_numpy(zero_copy_only=False))
                convs.append(conv)
                turns += here
        if convs:
            yield flush()

    return run


OPEN = "shard bigint, digest binary, parent binary, depth bigint, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, size bigint, paths int"
SUMS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]


def _merge(whole: bool, fan: int):
    """Outer paths of neighbouring shards laid over each other; settled nodes get paths 0. ``whole``: these are all shards."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        low, high = part["shard"].min(), part["shard"].max()
        part["on_first"] = (part["shard"] == low) & (part["paths"] & ON_FIRST > 0)
        part["on_last"] = (part["shard"] == high) & (part["paths"] & ON_LAST > 0)
        how = {"parent": "first", "depth": "first", "conv_id": "min", **dict.fromkeys(SUMS, "sum"), "size": "first", "on_first": "max", "on_last": "max"}
        merged = part.groupby("digest", sort=False).agg(how).reset_index()
        on = np.zeros(len(merged), np.int64) if whole else (ON_FIRST * merged["on_first"] + ON_LAST * merged["on_last"]).to_numpy()
        place = {d: i for i, d in enumerate(merged["digest"])}
        up = np.array([place.get(p, -1) for p in merged["parent"]])
        convs, children, leaves, saved = (merged[c].to_numpy(np.int64).copy() for c in SUMS)
        depth, size = merged["depth"].to_numpy(), merged["size"].to_numpy()
        for d in np.unique(depth)[::-1]:
            v = np.flatnonzero((depth == d) & (on == 0))
            leaves[v] = np.where(children[v] == 0, 1, leaves[v])
            saved[v] += (convs[v] - 1) * size[v]
            v = v[up[v] >= 0]
            np.add.at(children, up[v], 1)
            np.add.at(leaves, up[v], leaves[v])
            np.add.at(saved, up[v], saved[v])
        return merged.assign(shard=low // fan, n_children=children, n_leaves=leaves, saved_tokens=saved, paths=on)[[c.split()[0] for c in OPEN.split(", ")]]

    return run


def _hashed(batches):
    """(digest, ends_sha256) from pieces in the order of digests and ids."""
    now, state, empty, out = None, None, True, []
    for batch in batches:
        for digest, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if digest != now:
                if now is not None:
                    out.append((now, state.hexdigest()))
                now, state, empty = digest, hashlib.sha256(), True
            state.update(piece if empty else b"," + piece)
            empty = False
    if now is not None:
        out.append((now, state.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.string())], names=["digest", "ends_sha256"])


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS, fan: int = FAN) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are taken by turn, nulls first, then by role, the first characters of the text and a digest,
    so ties and repeated rows have one order. Null roles and texts count as empty;
    rows of a null conv_id belong to no conversation. ``c % 100`` has the sign of c, as
    in SQL. Turns are compared by a 128-bit digest of role and text. A conversation without turns
    after rebuilding is a member of the root alone. An empty table gives no rows;
    other columns are ignored; texts are whole and do not travel. A conversation is one
    string of 16 bytes (and a size) a turn, so it has 10^8 turns at most; copies of one
    string, and strings of one beginning, are split over tasks.
    """
    spark = conversations.sparkSession
    strings = rebuilt(conversations).repartitionByRange("labels", "conv_id").sortWithinPartitions("labels", "conv_id")
    made = util.stored(strings.mapInArrow(_shards(shard_turns), MADE), "tries", batch=1000)
    most = made.agg(F.max("number")).first()[0]
    if most is None:
        return spark.createDataFrame([], NODES)
    names = [c.split()[0] for c in OPEN.split(", ")]
    left = made.filter("paths is not null").withColumn("shard", F.col("shard") * (most + 1) + F.col("number")).select(*names)
    widest, settled = left.agg(F.max("shard")).first()[0], None
    while left is not None:
        whole = widest < fan
        merged = util.stored(left.groupBy(F.floor(F.col("shard") / fan)).applyInPandas(_merge(whole, fan), OPEN), "outer")
        done = merged.filter("paths = 0")
        settled = done if settled is None else settled.unionByName(done)
        left, widest = None if whole else merged.filter("paths > 0"), widest // fan
    pieces = made.filter("piece is not null").repartition("digest").sortWithinPartitions("digest", "conv_id").select("digest", "piece")
    ends = pieces.mapInArrow(_hashed, "digest binary, ends_sha256 string")
    names = [c.split()[0] for c in NODES.split(", ")]
    upper = util.stored(settled.join(ends, "digest", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NONE))), "upper")
    above = upper.select(F.col("digest").alias("parent"), F.col("conv_id").alias("_parent_conv_id"))
    nodes = made.filter("digest is null")
    found = upper.select("parent", *[n for n in names if n != "parent_conv_id"]).unionByName(nodes.filter("parent is not null").select("parent", *[n for n in names if n != "parent_conv_id"]))
    found = found.join(above, "parent", "left").withColumnRenamed("_parent_conv_id", "parent_conv_id").select(*names)
    return nodes.filter("parent is null").select(*names).unionByName(found)


def query(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(util.table(spark, sf_dir, "conversations"))


SQL = r"""
with recursive turns as (
  select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i, {'r': coalesce(role, ''), 't': coalesce(text, '')} as t
  from conversations where conv_id is not null),
own as (select c, list(t order by i) as t,
    xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)),
      lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda a, z: case when a % 2 = 1 then xor(a // 2, 3988292384::bigint) else a // 2 end))) % 6 as h
  from turns group by c),
built as (select o.c, list_concat(list_slice(coalesce(b.t, []), 1, o.h), list_slice(o.t, o.h + 1, len(o.t))) as t from own o left join own b on b.c = o.c - o.c % 100),
prefixes as (select c, unnest(range(0, len(t) + 1)) as d, t from built),
members as (select c, d, list_slice(t, 1, d) as p, len(t) = d as ended from prefixes),
nodes as (select d, p, min(c) as conv_id, count(*) as n, coalesce(string_agg(case when ended then c::varchar end, ',' order by c), '') as ends from members group by d, p),
children as (select list_slice(p, 1, d - 1) as p, count(*) as n from nodes where d > 0 group by 1),
full_nodes as (select n.*, coalesce(k.n, 0) as n_children from nodes n left join children k on k.p = n.p),
above as (select unnest(list_transform(range(0, d + 1), lambda x: list_slice(p, 1, x))) as p, case when n_children = 0 then 1 else 0 end as leaf, case when d = 0 then 0 else (n - 1) * length(p[d].t) end as saved from full_nodes),
sums as (select p, sum(leaf)::bigint as n_leaves, sum(saved)::bigint as saved from above group by p)
select f.conv_id, f.d as depth, u.conv_id as parent_conv_id, f.n as n_convs, f.n_children, s.n_leaves, s.saved as saved_tokens, sha256(f.ends) as ends_sha256
from full_nodes f join sums s on s.p = f.p left join nodes u on f.d > 0 and u.p = list_slice(f.p, 1, f.d - 1)
"""
