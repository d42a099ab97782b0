"""Substring dedup by super-k-mers.

A window is ``WINDOW`` consecutive words. Its minimiser is the least hash among
its m-mers (``M`` consecutive words). Consecutive windows with the same
minimiser travel as one packed string, a super-k-mer, to the minimiser's bucket,
where sorting brings equal windows together and counts them. A minimiser met
once cannot hold a repeated window, so only repeated ones travel. Buckets of
very frequent minimisers are dealt out again, window by window, by the window's
digest, so that no bucket is large.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import util

WINDOW, M = 35, 8
#: Super-k-mers of one minimiser that are counted in one bucket; beyond it windows are dealt by digest.
BUCKET = 400

_ODD = np.uint64(0x9E3779B97F4A7C15)
_known: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; remembers up to a number of words."""
    if len(_known) > 150_000:
        _known.clear()
    out = list(map(_known.get, words))
    if None in out:
        for i, w in enumerate(words):
            if out[i] is None:
                out[i] = xxhash.xxh64_intdigest(w)
                if len(w) < 40:
                    _known[w] = out[i]
    return np.array(out, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive word hashes."""
    count = len(h) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        out = out * _ODD + _mix(h[k : k + count] + np.uint64(k + 1))
    return _mix(out)


def super_kmers(words: list[bytes], window: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window and number of windows of each super-k-mer."""
    empty = np.zeros(0, dtype=np.int64)
    if len(words) < window:
        return empty, empty, empty
    grams = gram_hashes(word_hashes(words), m)
    span = window - m + 1
    n = len(words) - window + 1
    least = np.empty(n, dtype=np.int64)
    for at in range(0, n, 65536):  # bounded memory on very long texts
        part = grams[at : min(n, at + 65536) + span - 1]
        least[at : at + 65536] = np.lib.stride_tricks.sliding_window_view(part, span).argmin(axis=1) + np.arange(at, at + len(part) - span + 1)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return grams[least[first]].view(np.int64), first.astype(np.int64), np.diff(np.concatenate([first, [n]])).astype(np.int64)


def _slices(batches, size: int = 500):
    for b in batches:
        for at in range(0, b.num_rows, size):
            yield b.slice(at, size)


def _scan(window: int, m: int):
    def run(batches):
        for b in _slices(batches):
            n_words, digest, keys, firsts, counts, lengths = [], [], [], [], [], []
            for text in b.column(2).to_pylist():
                words = (text or "").encode().split()
                n_words.append(len(words))
                digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
                k, f, c = super_kmers(words, window, m)
                keys.append(k)
                firsts.append(f)
                counts.append(c)
                lengths.append(len(k))
            ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype("int32"))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x).astype(t))) for x, t in ((keys, "int64"), (firsts, "int32"), (counts, "int32"))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(n_words, pa.int64()), pa.array(digest), *lists], names=["doc_id", "h", "n_words", "sha", "keys", "firsts", "counts"])

    return run


def _pack(window: int, hot: bool):
    """Rows (doc_id, h, text, found) to (bucket, doc_id, h, first, packed).

    Super-k-mers of frequent minimisers come out window by window, with the
    window's 128-bit digest as both bucket and string.
    """
    names = ["bucket", "doc_id", "h", "first", "packed"]
    types = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def rows_of(doc_id, h, words, found):
        for x in found:
            if x["hot"] == hot:
                first, n = x["first"], x["n"]
                if hot:
                    for i in range(first, first + n):
                        digest = xxhash.xxh3_128_digest(b" ".join(words[i : i + window]))
                        yield digest, doc_id, h, i, None
                else:
                    yield x["key"].to_bytes(8, "big", signed=True), doc_id, h, first, b" ".join(words[first : first + n + window - 1])

    def run(batches):
        for b in _slices(batches, 100):
            rows = []
            for doc_id, h, text, found in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                rows.extend(rows_of(doc_id, h, (text or "").encode().split(), found))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)

    return run


def _count(window: int):
    """Sorted rows of whole buckets to (doc_id, h, start, stop): runs of repeated windows, as word places."""

    def repeated(rows):
        if len(rows) < 2:
            return
        cut, windows = [], []
        for _, _, _, packed in rows:
            ends = np.flatnonzero(np.frombuffer(packed, dtype=np.uint8) == 32)
            ends = [*ends.tolist(), len(packed)]
            starts = [0, *[e + 1 for e in ends[:-1]]]
            own = [packed[starts[i] : ends[i + window - 1]] for i in range(len(ends) - window + 1)]
            cut.append(len(own))
            windows += own
        order = sorted(range(len(windows)), key=windows.__getitem__)
        twice = bytearray(len(windows))
        for x, y in zip(order, order[1:], strict=False):
            if windows[x] == windows[y]:
                twice[x] = twice[y] = 1
        at = 0
        for (doc_id, h, first, _), n in zip(rows, cut, strict=True):
            run = None
            for i, again in enumerate([*twice[at : at + n], 0]):
                if again:
                    run = i if run is None else run
                elif run is not None:
                    yield doc_id, h, first + run, first + i + window - 1
                    run = None
            at += n

    def run(batches):
        key, rows, out = None, [], []
        for b in _slices(batches, 2000):
            for bucket, doc_id, h, first, packed in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if bucket != key:
                    out.extend(repeated(rows))
                    key, rows = bucket, []
                rows.append((doc_id, h, first, packed))
            if len(out) > 5000:
                yield _ranges(out)
                out = []
        out.extend(repeated(rows))
        yield _ranges(out)

    return run


def _ranges(rows):
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "h", "start", "stop"])


def _cut(keep_text: bool):
    """Rows (doc_id, h, text, ranges) to what is left of each text."""

    def run(batches):
        for b in _slices(batches, 200):
            removed, digest, texts = [], [], []
            for text, ranges in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                words = (text or "").encode().split()
                keep = np.ones(len(words) + 1, dtype=bool)
                for r in ranges:
                    keep[r["start"] : r["stop"]] = False
                left = b" ".join([w for w, k in zip(words, keep, strict=False) if k])
                removed.append(int(len(keep) - keep.sum()))
                digest.append(hashlib.sha256(left).hexdigest())
                texts.append(left.decode())
            cols = [b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(digest)] + ([pa.array(texts)] if keep_text else [])
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "h", "n_removed", "cut_sha", "kept_text"][: len(cols)])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, m: int = M, bucket: int = BUCKET, keep_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, and kept_text if asked for.

    A word goes if a window that covers it starts at a second place, in any
    document or the same one; all places count on the input. A null text is
    empty. Rows that repeat id and text are places of their own, under one id or
    none. Documents shorter than a window keep all words (``kept_text`` is null
    where nothing goes). Very long texts are taken whole; an empty table gives no
    rows. Other columns are ignored. Windows of a bucket are compared word by
    word; those of minimisers met more than ``bucket`` times by 128-bit digests.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    doc = ["doc_id", "h"]
    scanned = util.stored(rows.mapInArrow(_scan(window, m), "doc_id bigint, h bigint, n_words bigint, sha string, keys array<bigint>, firsts array<int>, counts array<int>"), "scanned")
    kmers = scanned.select(*doc, F.inline(F.arrays_zip("keys", "firsts", "counts"))).toDF(*doc, "key", "first", "n")
    often = util.stored(kmers.groupBy("key").count().filter("count > 1").select("key", (F.col("count") > bucket).alias("hot")), "often")
    found = kmers.join(often, "key").groupBy(*doc).agg(F.collect_set(F.struct("key", "first", "n", "hot")).alias("found"))
    held = util.stored(_join(rows, found, "inner").select(*doc, "text", "found"), "held")
    util.release(spark)

    schema = "bucket binary, doc_id bigint, h bigint, first int, packed binary"
    packed = held.mapInArrow(_pack(window, False), schema)
    cold = packed.repartition(util.partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(_count(window), "doc_id bigint, h bigint, start int, stop int")
    singles = held.filter(F.exists("found", lambda x: x["hot"])).mapInArrow(_pack(window, True), schema)
    twice = util.stored(singles.groupBy("bucket").count().filter("count > 1").select("bucket"), "twice")
    hot = singles.join(twice, "bucket").select(*doc, F.col("first").alias("start"), (F.col("first") + window).alias("stop"))
    ranges = util.stored(cold.unionByName(hot).groupBy(*doc).agg(F.collect_set(F.struct("start", "stop")).alias("ranges")), "ranges")
    schema = "doc_id bigint, h bigint, n_removed bigint, cut_sha string" + ", kept_text string" * keep_text
    cut = _join(held.select(*doc, "text"), ranges, "inner").select(*doc, "text", "ranges").mapInArrow(_cut(keep_text), schema)
    cut = util.stored(cut.dropDuplicates(doc), "cut")
    out = _join(scanned.select(*doc, "n_words", "sha"), cut, "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("cut_sha", "sha").alias("kept_sha256"), *["kept_text"] * keep_text)
    util.release(spark)
    return out


def _join(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Join on document id, which may be null, and text hash."""
    b = b.withColumnsRenamed({"doc_id": "_doc_id", "h": "_h"})
    return a.join(b, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("h") == F.col("_h")), how).drop("_doc_id", "_h")


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(util.table(spark, sf_dir, "documents"))


SQL = r"""
WITH w AS (SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT k, w, unnest(generate_series(1, len(w) - 34)) AS i FROM w WHERE len(w) >= 35),
s AS (SELECT k, i, count(*) OVER (PARTITION BY array_to_string(w[i:i + 34], ' ')) AS c FROM p),
gone AS (SELECT DISTINCT k, i + j AS pos FROM (SELECT k, i, unnest(generate_series(0, 34)) AS j FROM s WHERE c > 1)),
words AS (SELECT k, unnest(w) AS x, generate_subscripts(w, 1) AS pos FROM w),
kept AS (SELECT k, string_agg(x, ' ' ORDER BY pos) AS t, count(*) AS n FROM words ANTI JOIN gone USING (k, pos) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (k)
"""
