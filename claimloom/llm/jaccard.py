"""N-gram Jaccard join by vertical partitioning.

Shingles have one global order, that of their 64-bit hashes. The order is cut
into fragments; each fragment is counted apart from the others, and what the
fragments count is summed per document or per pair:

1. Documents: a set that links with another shares a given part of its shingles
   with it. A first range of the order tells which sets hold too many shingles
   that no other set has; these link with nothing. For the sets left, all
   fragments count in how many sets each shingle is.
2. Candidates: of each set left, the rarest shingles that any link must touch
   are its keys (prefix filter). On each key one leader, the set that meets most
   others, stands for all: every set on the key is compared with the leader
   alone, so that the work is linear in the members of a group.
3. Pairs: overlaps are counted by fragment and summed per pair.
4. What a leader leaves open: two members that a leader does not join can still
   link with each other, but then their differences from the leader overlap by
   more than half of the one. So the rarest of these differences are keys of a
   next round, in the same way. Small groups are compared in full.

Documents with one and the same set are one vertex.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, util
from .substrings import _mix, gram_hashes, word_hashes

#: Defaults of the operator and the pipeline's stage: shingles of five words, linked from a similarity of 0.8.
SHINGLE, PERCENT = 5, 80
#: Documents of a batch and their bytes; pieces in which a pair's overlap is counted.
BATCH, BATCH_BYTES, PIECES = 1000, 1 << 22, 8
#: Rounds with leaders; from the second on, a group is compared in full if that gives a member no more pairs than this.
ROUNDS, SMALL = 3, 64
#: Owner of a shingle that several documents of a batch hold.
_SEVERAL = 0xFFFF


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles of the lower-cased words."""
    words = (text or "").encode().lower().split()
    n = min(shingle, len(words))
    if not n:
        return np.zeros(0, dtype=np.uint64)
    grams = gram_hashes(word_hashes(words), n)
    return np.unique(grams if n == shingle else _mix(grams + np.uint64(shingle - n)))


def least_overlap(total, percent: int):
    """Least shingles that linked sets of ``total`` shingles together share: percent * (total - i) <= 100 * i."""
    return -(-percent * total // (100 + percent))


def differences(total, percent: int):
    """Most shingles in which linked sets of ``total`` shingles together differ."""
    return total - 2 * least_overlap(total, percent)


def spare(n, percent: int):
    """Most shingles of a set of size ``n`` that a linked set can lack."""
    return n - -(-percent * n // 100)


def _signature(tokens: np.ndarray) -> bytes | None:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None


def _batches(batches, rows: int, text_column: int):
    """(number, batch) of bounded batches; numbers differ between tasks."""
    number = TaskContext.get().partitionId() << 24
    for b in batches:
        at = 0
        while at < b.num_rows:
            part = b.slice(at, rows)
            while part.num_rows > 1 and part.column(text_column).nbytes > BATCH_BYTES:
                part = part.slice(0, part.num_rows // 2)
            yield number, part
            number += 1
            at += part.num_rows


def _fragments(tokens: np.ndarray, limit: int, fragments: int):
    """(fragment, start, stop) of the fragments that sorted ``tokens`` fall into; ``limit`` is the end of the order's range, in units of 2^32."""
    of = (tokens >> np.uint64(32)) * np.uint64(fragments) // np.uint64(limit)
    cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
    return [(int(of[a]), a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def _runs(tokens: np.ndarray):
    """Starts of equal runs in sorted ``tokens``, and the runs' lengths."""
    starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, dtype=np.int64)
    return starts, np.diff(np.concatenate([starts, [len(tokens)]]))


_DOC = pa.struct([("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("unsure", pa.int64())])
_SCANNED = "batch bigint, fragment int, tokens binary, owners binary, docs array<struct<doc_id:bigint,h:bigint,n:bigint,sig:binary,unsure:bigint>>"


def _scan(shingle: int, share: float, fragments: int):
    """Rows (doc_id, text, h) to one row for each batch, with its documents, and one for each fragment of it.

    A shingle that several documents of the batch hold is known to be shared, and travels once.
    """
    limit = int(share * 2**32)

    def run(batches):
        for number, b in _batches(batches, BATCH, 1):
            sets = [shingle_set(t, shingle) for t in b.column(1).to_pylist()]
            low = [t[: np.searchsorted(t >> np.uint64(32), limit)] for t in sets]
            flat = np.concatenate(low)
            owner = np.repeat(np.arange(len(low)), [len(t) for t in low])
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            starts, lengths = _runs(flat)
            tokens, owners = flat[starts], np.where(lengths == 1, owner[starts], _SEVERAL)
            unsure = np.bincount(owners[owners != _SEVERAL], minlength=len(sets))
            docs = [dict(doc_id=d, h=h, n=len(s), sig=_signature(s), unsure=int(u)) for d, h, s, u in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), sets, unsure, strict=True)]
            cuts = _fragments(tokens, limit, fragments)
            packed = tokens.view(np.uint8).reshape(-1, 8)[:, :6]  # 48 bits and the fragment: two shingles that fall together only keep a document longer
            owners = owners.astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number] * (len(cuts) + 1), pa.int64()),
                    pa.array([-1, *[f for f, _, _ in cuts]], pa.int32()),
                    pa.array([None, *[packed[x:y].tobytes() for _, x, y in cuts]], pa.binary()),
                    pa.array([None, *[owners[x:y].tobytes() for _, x, y in cuts]], pa.binary()),
                    pa.array([docs, *[None] * len(cuts)], pa.list_(_DOC)),
                ],
                names=["batch", "fragment", "tokens", "owners", "docs"],
            )

    return run


def _by_fragment(batches, count):
    """Calls ``count`` with the rows of each fragment; rows come sorted by the first column."""
    now, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[0] != now:
                if rows:
                    yield count(rows)
                now, rows = row[0], []
            rows.append(row)
    if rows:
        yield count(rows)


def _shared(batches):
    """Rows (fragment, batch, tokens, owners) to (batch, hits): owners of shingles that another batch has too, once for each."""

    def count(rows):
        sizes = [len(r[3]) // 2 for r in rows]
        tokens = np.zeros((sum(sizes), 8), dtype=np.uint8)
        tokens[:, :6] = np.frombuffer(b"".join(r[2] for r in rows), dtype=np.uint8).reshape(-1, 6)
        tokens = tokens.view("<u8").ravel()
        order = np.argsort(tokens, kind="stable")
        same = tokens[order[1:]] == tokens[order[:-1]]
        twice = np.zeros(len(tokens), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        out, at = [], 0
        for (_, number, _, owners), n in zip(rows, sizes, strict=True):
            own = np.frombuffer(owners, dtype="<u2")
            hits = own[twice[at : at + n] & (own != _SEVERAL)]
            at += n
            if len(hits):
                out.append((number, hits.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["batch", "hits"])

    return _by_fragment(batches, count)


def _judge(percent: int):
    """Rows (batch, docs, hits) to one row for each document; ``open`` if enough of its shingles are shared."""

    def run(batches):
        for b in batches:
            for number, docs, hits in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = np.frombuffer(b"".join(hits or []), dtype="<u2")
                n = np.array([d["n"] for d in docs], dtype=np.int64)
                lone = np.array([d["unsure"] for d in docs]) - np.bincount(found, minlength=len(docs))
                keep = (n > 0) & (lone <= spare(n, percent))
                cols = [[number * 2048 + i for i in range(len(docs))], *([d[k] for d in docs] for k in ("doc_id", "h", "n", "sig")), keep.tolist()]
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["rid", "doc_id", "h", "n", "sig", "open"])

    return run


def _sets(shingle: int, fragments: int):
    """Rows (v, text) to one row for each batch, with its sets, and one for each fragment of it, with how many of the batch's sets hold each shingle."""

    def run(batches):
        for number, b in _batches(batches, BATCH // 4, 1):
            sets = [shingle_set(t, shingle) for t in b.column(1).to_pylist()]
            flat = np.concatenate(sets)
            tokens, counts = np.unique(flat, return_counts=True)
            counts = counts.astype("<u4")
            cuts = _fragments(tokens, 2**32, fragments)
            none = [None] * len(cuts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number] * (len(cuts) + 1), pa.int64()),
                    pa.array([-1, *[f for f, _, _ in cuts]], pa.int32()),
                    pa.array([None, *[tokens[x:y].tobytes() for _, x, y in cuts]], pa.binary()),
                    pa.array([None, *[counts[x:y].tobytes() for _, x, y in cuts]], pa.binary()),
                    pa.array([b.column(0).to_pylist(), *none], pa.list_(pa.int64())),
                    pa.array([[len(s) for s in sets], *none], pa.list_(pa.int64())),
                    pa.array([flat.tobytes(), *none], pa.binary()),
                ],
                names=["batch", "fragment", "tokens", "counts", "vs", "sizes", "flat"],
            )

    return run


def _frequencies(batches):
    """Rows (fragment, batch, tokens, counts) to (batch, fragment, df): in how many sets of all batches each of the row's shingles is."""

    def count(rows):
        tokens = np.frombuffer(b"".join(r[2] for r in rows), dtype="<u8")
        counts = np.frombuffer(b"".join(r[3] for r in rows), dtype="<u4")
        _, inverse = np.unique(tokens, return_inverse=True)
        df = np.minimum(np.bincount(inverse, weights=counts), 2**31 - 1).astype("<u4")[inverse]
        cuts = np.cumsum([0, *[len(r[3]) // 4 for r in rows]])
        return pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([df[x:y].tobytes() for x, y in zip(cuts, cuts[1:], strict=False)], pa.binary())], names=["batch", "fragment", "df"])

    return _by_fragment(batches, count)


def _lists(flat: np.ndarray, cuts: np.ndarray, kind: str):
    return pa.ListArray.from_arrays(pa.array(cuts.astype("int32")), pa.array(flat.astype(kind)))


def _pieces(percent: int):
    """Rows (batch, vs, sizes, flat, found) to the pieces of the sets that enough of their shingles keep open.

    Shingles that no other set has do not come along but as a number, ``lone``.
    The first piece holds the set's keys: the rarest shingles that any link must touch.
    """

    def run(batches):
        for b in batches:
            for _, vs, sizes, flat, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                flat = np.frombuffer(flat, dtype="<u8")
                _, inverse = np.unique(flat, return_inverse=True)
                df = np.frombuffer(b"".join(x["df"] for x in sorted(found, key=lambda x: x["fragment"])), dtype="<u4")[inverse]
                ends = np.cumsum([0, *sizes])
                rows = []
                for v, n, a, z in zip(vs, sizes, ends, ends[1:], strict=False):
                    shared = df[a:z] > 1
                    t, f = flat[a:z][shared], df[a:z][shared]
                    lone = n - len(t)
                    if lone <= spare(n, percent):
                        keys = t[np.lexsort((t, f))][: max(spare(n, percent) + 1 - lone, 0)]
                        cuts = np.searchsorted(t >> np.uint64(61), np.arange(PIECES + 1, dtype=np.uint64))
                        rows += [(v, k, n, lone, t[cuts[k] : cuts[k + 1]], f[cuts[k] : cuts[k + 1]], keys if k == 0 else keys[:0]) for k in range(PIECES)]
                if rows:
                    cols = list(zip(*rows, strict=True))
                    plain = [pa.array(c, t) for c, t in zip(cols[:4], (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)]
                    lists = [_lists(np.concatenate(c), np.cumsum([0, *map(len, c)]), t) for c, t in zip(cols[4:], ("int64", "int32", "int64"), strict=True)]
                    yield pa.RecordBatch.from_arrays(plain + lists, names=["v", "piece", "n", "lone", "tokens", "df", "keys"])

    return run


def _partial(batches):
    """Rows (lead, v, group, tokens, df, tokens of the leader, their df) of one piece each to the overlap in it and what differs.

    The difference is ranked: shingles of the leader's that few lack come early, as rare ones of the other set do.
    """
    for b in batches:
        ks, ranks, diffs = [], [], []
        group = b.column(2).to_pylist()
        t, f, lt, lf = ([x.values.to_numpy() for x in b.column(i)] for i in range(3, 7))
        for g, a, fa, c, fc in zip(group, t, f, lt, lf, strict=True):
            more, less = ~np.isin(a, c, assume_unique=True), ~np.isin(c, a, assume_unique=True)
            ks.append(len(a) - int(more.sum()))
            ranks.append(np.concatenate([fa[more], np.maximum(g - fc[less], 0) + 1]))
            diffs.append(np.concatenate([a[more], c[less]]))
        cuts = np.cumsum([0, *map(len, diffs)])
        flat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, dtype=kind)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ks, pa.int64()), _lists(flat(ranks, "int32"), cuts, "int32"), _lists(flat(diffs, "int64"), cuts, "int64")], names=["lead", "v", "k", "ranks", "diff"])


def needed(n: int, n_lead: int, d: int, percent: int, linked: bool) -> int | None:
    """Least overlap of two differences from a leader, if their sets link; None if they cannot.

    The one belongs to a set of size ``n`` that differs in ``d`` shingles from a
    leader of size ``n_lead``; of the other it is known only whether it is
    linked with the leader. With differences a and b, the sets differ in
    a + b - 2 * overlap shingles.
    """
    m = np.arange(-(-percent * n // 100), n * 100 // percent + 1)
    most = differences(m + n, percent)
    least = np.maximum(np.abs(m - n_lead), d - most)
    of_lead = differences(m + n_lead, percent)
    if linked:
        fits = least <= of_lead
    else:
        least, fits = np.maximum(least, of_lead + 2), np.ones(len(m), dtype=bool)  # sets of given sizes differ in an even number or an odd one
    return max(int((-(-(d + least - most) // 2))[fits].min()), 1) if fits.any() else None


def _marks(percent: int):
    """Rows (lead, v, n, lone, n_lead, lone_lead, k, parts) to (lead, v, linked, marks).

    Marks are the rarest differences that a link with another member must touch:
    side 0 between members that are not linked with the leader, 1 of such a one towards a linked one, 2 the other way.
    ``rest`` counts the differences from the mark on, ``d`` all of them.
    """
    mark = pa.struct([("side", pa.int32()), ("token", pa.int64()), ("rest", pa.int64()), ("d", pa.int64())])

    def run(batches):
        for b in batches:
            rows = []
            for lead, v, n, lone, n_lead, lone_lead, k, parts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                d = n + n_lead - 2 * k
                linked = k >= least_overlap(n + n_lead, percent)
                rank = np.array([x for p in parts for x in p["ranks"]], dtype=np.int64)
                diff = np.array([x for p in parts for x in p["diff"]], dtype=np.int64)
                diff = diff[np.lexsort((diff, rank))]
                marks = []
                for side, to_linked in ((2, False),) if linked else ((0, False), (1, True)):
                    overlap = needed(n, n_lead, d, percent, to_linked)
                    if overlap is not None:
                        long = d - overlap + 1 - lone
                        marks += [dict(side=side, token=x, rest=d - lone - i, d=d) for i, x in enumerate(diff[: max(long, 0)].tolist())]
                        if long > len(diff) and lone_lead:  # shingles that only the leader has differ for all
                            marks.append(dict(side=side, token=0, rest=lone_lead, d=d))
                rows.append((lead, v, linked, marks))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.list_(mark)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["lead", "v", "linked", "marks"])

    return run


def _compared(pairs: DataFrame, pieces: DataFrame, percent: int) -> DataFrame:
    """(lead, v, linked, marks) of pairs (lead, v, group): overlaps are counted piece by piece and summed per pair."""
    own = pieces.select("v", "piece", "tokens", "df")
    of_lead = pieces.select(F.col("v").alias("lead"), "piece", F.col("tokens").alias("lead_tokens"), F.col("df").alias("lead_df"))
    met = pairs.join(own, "v").join(of_lead, ["lead", "piece"])
    counted = met.select("lead", "v", "group", "tokens", "df", "lead_tokens", "lead_df").mapInArrow(_partial, "lead bigint, v bigint, k bigint, ranks array<int>, diff array<bigint>")
    total = util.stored(counted.groupBy("lead", "v").agg(F.sum("k").alias("k"), F.collect_list(F.struct("ranks", "diff")).alias("parts")), "overlaps", batch=500)
    size = pieces.filter("piece = 0").select("v", "n", "lone")
    of_pairs = total.join(size, "v").join(size.toDF("lead", "n_lead", "lone_lead"), "lead").select("lead", "v", "n", "lone", "n_lead", "lone_lead", "k", "parts")
    out = util.stored(of_pairs.mapInArrow(_marks(percent), "lead bigint, v bigint, linked boolean, marks array<struct<side:int,token:bigint,rest:bigint,d:bigint>>"), "compared", batch=500)
    util.discard(total)
    return out


def _placed_on(members: DataFrame, found: DataFrame | None) -> DataFrame:
    """Members of keys with the component that is known of each."""
    if found is None:
        return members.withColumn("component", F.col("v"))
    return members.join(found, "v", "left").withColumn("component", F.coalesce("component", "v"))


def _pairs_in_full(members: DataFrame, size: DataFrame, percent: int) -> DataFrame:
    """Pairs (lead, v) of members of one key that may link: of a link's common marks, the first passes both filters."""
    of = members.join(size.select("v", "n"), "v")
    a, b = (of.select("key", *[F.col(c).alias(c + x) for c in ("side", "v", "component", "n", "rest", "d")]) for x in "ab")
    waiting = ((F.col("sidea") == 0) & (F.col("sideb") == 0) & (F.col("va") < F.col("vb"))) | ((F.col("sidea") == 1) & (F.col("sideb") == 2))
    total = F.col("na") + F.col("nb")
    close = (F.col("nb") * 100 >= F.col("na") * percent) & (F.col("na") * 100 >= F.col("nb") * percent)
    most = total - 2 * F.ceil(total * percent / (100 + percent) - 1e-6)
    reached = F.col("da").isNull() | (2 * F.least("resta", "restb") >= F.col("da") + F.col("db") - most)
    met = a.join(b, "key").filter(waiting & (F.col("componenta") != F.col("componentb")) & close & reached)
    return met.select(F.least("va", "vb").alias("lead"), F.greatest("va", "vb").alias("v"), F.lit(0).alias("group")).distinct()


def _links(pieces: DataFrame, percent: int, rounds: int) -> DataFrame | None:
    """(v, component) of all sets that link with another; None if there are none."""
    size = pieces.filter("piece = 0").select("v", "n", "lone")
    none = F.lit(None).cast("bigint")
    members = pieces.filter("piece = 0").select(F.explode("keys").alias("key"), F.lit(0).alias("side"), "v", none.alias("rest"), none.alias("d"))
    links = found = None
    for k in range(rounds + 1):
        members = util.stored(_placed_on(members, found), "members")
        apart, linked = F.sum((F.col("side") == 1).cast("int")), F.sum((F.col("side") == 2).cast("int"))
        groups = members.groupBy("key").agg(F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("side").alias("side"), apart.alias("apart"), linked.alias("linked"))
        # sides 1 and 2 only wait for each other
        groups = groups.filter("lo < hi and (side = 0 or apart > 0 and linked > 0)")
        each = F.when(F.col("side") == 0, F.col("size") / 2).otherwise(F.least("apart", "linked"))
        groups = util.stored(groups.select("key", "size", (F.lit(k == rounds) | F.lit(k > 0) & (each <= SMALL)).alias("full")), "groups")
        judged, full, large = [], groups.filter("full"), groups.filter("not full")
        if not full.isEmpty():
            pairs = util.stored(_pairs_in_full(members.join(full, "key"), size, percent), "pairs")
            judged.append(_compared(pairs, pieces, percent))
        led = not large.isEmpty()
        if led:
            large = util.stored(members.join(large, "key").select("key", "size", "v"), "large")
            meets = large.groupBy("v").agg(F.sum("size").alias("meets")).join(size, "v")
            first = F.max(F.struct("meets", (-F.col("lone")).alias("lone"), (-F.col("v")).alias("v")))
            lead = util.stored(large.join(meets, "v").groupBy("key").agg(first.alias("l")).select("key", (-F.col("l.v")).alias("lead")), "leaders")
            pairs = util.stored(large.join(lead, "key").filter("v != lead").select("lead", "v").distinct(), "pairs")
            group = util.stored(pairs.groupBy("lead").agg((F.count("*") + 1).cast("int").alias("group")), "led")
            judged.append(_compared(pairs.join(group, "lead"), pieces, percent))
        new = [x.filter("linked").select(F.col("lead").alias("u"), "v") for x in judged]
        new = [x for x in new if not x.isEmpty()]
        for x in new:
            links = x if links is None else links.unionByName(x)
        if new:
            links = util.stored(links.distinct(), "links")
            found = util.stored(graph.components(links), "components")
        if not led:
            return found
        old = members
        members = judged[-1].select("lead", "v", F.inline("marks")).select(F.xxhash64("lead", F.when(F.col("side") == 0, 0).otherwise(1), "token").alias("key"), "side", "v", "rest", "d")
        util.discard(old)
    return found


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_class.

    ``component_id`` is the least id that links lead to, the document's own
    included; ``n_class`` counts the rows with the same set. A document without
    words, or without text, links with nothing. Repeated rows, and rows that
    repeat an id, are documents of their own that happen to have that id; a null
    id is null as a component unless links lead to another. Very long texts are
    taken whole; an empty table gives no rows. Other columns are ignored.
    """
    out = _placed(docs, shingle, percent, rounds, id_col, text_col)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_class", F.lit(1)).cast("bigint").alias("n_class"))


def _placed(docs: DataFrame, shingle: int, percent: int, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, h (hash of the text), n, and its set's sig, component (a vertex), component_id, n_class; these are null without words."""
    spark = docs.sparkSession
    fragments = 2 * util.partitions(spark)
    share = min(1.0, 2 * (100 - percent) / 100 + 1e-9)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))

    scanned = util.stored(rows.mapInArrow(_scan(shingle, share, fragments), _SCANNED), "scanned")
    dealt = scanned.filter("fragment >= 0").select("fragment", "batch", "tokens", "owners").repartition(fragments, "fragment").sortWithinPartitions("fragment")
    hits = dealt.mapInArrow(_shared, "batch bigint, hits binary").groupBy("batch").agg(F.collect_list("hits").alias("hits"))
    judged = scanned.filter("fragment < 0").select("batch", "docs").join(hits, "batch", "left").select("batch", "docs", "hits")
    sets = util.stored(judged.mapInArrow(_judge(percent), "rid bigint, doc_id bigint, h bigint, n bigint, sig binary, open boolean"), "sets", batch=64)
    util.discard(scanned)
    util.release(spark)

    classes = sets.filter("n > 0").groupBy("sig").agg(F.min("rid").alias("v"), F.min("doc_id").alias("rep"), F.count("*").alias("n_class"), F.min_by(F.struct("doc_id", "h"), "rid").alias("row"), F.max("open").alias("open"))
    classes = util.stored(classes, "classes")
    wanted = classes.filter("open").select("v", F.col("row.doc_id").alias("_doc_id"), F.col("row.h").alias("_h"))
    held = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("h") == F.col("_h"))).select("v", "text").dropDuplicates(["v"])
    schema = "batch bigint, fragment int, tokens binary, counts binary, vs array<bigint>, sizes array<bigint>, flat binary"
    counted = util.stored(held.mapInArrow(_sets(shingle, fragments), schema), "counted", batch=BATCH // 4)
    util.release(spark)
    dealt = counted.filter("fragment >= 0").select("fragment", "batch", "tokens", "counts").repartition(fragments, "fragment").sortWithinPartitions("fragment")
    df = dealt.mapInArrow(_frequencies, "batch bigint, fragment int, df binary").groupBy("batch").agg(F.collect_list(F.struct("fragment", "df")).alias("found"))
    held = counted.filter("fragment < 0").select("batch", "vs", "sizes", "flat").join(df, "batch")
    pieces = util.stored(held.mapInArrow(_pieces(percent), "v bigint, piece int, n bigint, lone bigint, tokens array<bigint>, df array<int>, keys array<bigint>"), "pieces", batch=32)
    util.discard(counted)
    util.release(spark)

    found = _links(pieces, percent, rounds)
    util.discard(pieces)
    if found is None:
        least = classes.select("sig", F.col("v").alias("component"), F.col("rep").alias("component_id"), "n_class")
    else:
        placed = util.stored(classes.join(found, "v", "left").withColumn("component", F.coalesce("component", "v")).select("sig", "component", "rep", "n_class"), "placed")
        roots = util.stored(placed.groupBy("component").agg(F.min("rep").alias("component_id")), "roots")
        least = util.stored(placed.join(roots, "component").select("sig", "component", "component_id", "n_class"), "least")
    worded = sets.filter("n > 0").select("doc_id", "h", "n", "sig").join(least, "sig")
    bare = sets.filter("n = 0").select("doc_id", "h", "n", "sig", *[F.lit(None).cast("bigint").alias(c) for c in ("component", "component_id", "n_class")])
    return worded.select(*bare.columns).unionByName(bare)


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(util.table(spark, sf_dir, "documents"), shingle=3, percent=90)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: that with the least id, a null id last, and of its texts that with the least hash.

    Texts that nothing links stay, also under one id or none. Of rows equal in
    id and text one stays; documents without words all stay.
    """
    placed = _placed(docs, SHINGLE, PERCENT).filter("sig is not null")
    chosen = placed.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("c"))
    chosen = util.stored(chosen.select(F.col("c.doc_id").alias("_doc_id"), F.col("c.h").alias("_h")), "chosen")
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    hashed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64("text").alias("_hash"), worded.alias("_worded"))
    kept = hashed.filter("_worded").join(chosen, F.col("_id").eqNullSafe(F.col("_doc_id")) & (F.col("_hash") == F.col("_h")), "left_semi").dropDuplicates(["_id", "_hash"])
    return kept.unionByName(hashed.filter("not _worded")).select("_row.*")


SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT k, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT k, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT k, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS m FROM g GROUP BY k),
rep AS (SELECT min(k) AS r, m, n, count(*) AS n_class FROM n GROUP BY m, n),
x AS (SELECT r, g, n FROM rep JOIN g ON g.k = rep.r),
o AS (SELECT a.r AS a, b.r AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.g = b.g AND a.r <> b.r AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n GROUP BY 1, 2),
e AS (SELECT a, b FROM o WHERE 100 * i >= 90 * (na + nb - i)),
c(a, b) AS (SELECT r, r FROM rep UNION SELECT c.a, e.b FROM c JOIN e ON e.a = c.b),
least AS (SELECT c.a AS r, min(w.doc_id) AS component_id FROM c JOIN rep q ON q.r = c.b JOIN n ON n.m = q.m AND n.n = q.n JOIN w ON w.k = n.k GROUP BY c.a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, CASE WHEN n.n IS NULL THEN doc_id ELSE component_id END AS component_id, coalesce(n_class, 1) AS n_class
FROM w LEFT JOIN n USING (k) LEFT JOIN rep ON rep.m = n.m AND rep.n = n.n LEFT JOIN least ON least.r = rep.r
"""
