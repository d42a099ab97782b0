"""Benchmark decontamination by spaced seeds.

A mask picks some places of a window of words and ignores the others, so a
window still matches when an ignored word was substituted. Hashes of masked
windows of test items and of documents meet in an equi-join; each hit names an
item and a diagonal (document place minus item place). Along the diagonal the
words are then compared one by one; neighbouring diagonals count together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import util

#: Places that each mask reads.
MASKS = [(0, 1, 2, 4, 7, 8), (0, 2, 3, 5, 6, 9), (0, 1, 4, 5, 8, 10)]
#: A hit counts if this share of the item's words agrees, or this share of some run of words.
SHARE, RUN, RUN_SHARE = 0.6, 20, 0.8
#: Diagonals this many words apart count together.
GAP = 3
#: Seeds and items up to so many bytes are broadcast, beyond them the joins shuffle; bytes of a seed in memory, at most.
BROADCAST_BYTES, SEED_BYTES = 1 << 26, 48
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def seeds(hashes: Column) -> list[Column]:
    """For each mask the hashes of all masked windows, in order."""
    out = []
    for k, mask in enumerate(MASKS):
        last = F.size(hashes) - mask[-1] - 1
        made = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), _masked(hashes, k, mask))
        out.append(F.when(last >= 0, made).otherwise(F.expr("cast(array() as array<bigint>)")))
    return out


def _masked(hashes: Column, k: int, mask: tuple[int, ...]):
    return lambda i: F.xxhash64(F.lit(k), *[F.get(hashes, i + o) for o in mask])


def _seed_rows(df: DataFrame, hashes: str) -> DataFrame:
    """Explodes the seeds of the array column ``hashes`` into ``seed`` and ``place``."""
    h = F.col(hashes)
    # outer: for an inner one Catalyst would filter on the array first and so compute it twice
    out = df.withColumn("_all", F.concat(*seeds(h)))
    sizes = [F.greatest(F.size(h) - mask[-1], F.lit(0)) for mask in MASKS]
    rest = [c for c in df.columns if c != hashes]
    out = out.select(*rest, *[s.alias(f"_s{k}") for k, s in enumerate(sizes)], F.posexplode_outer("_all").alias("_i", "seed"))
    place, before = F.col("_i"), F.lit(0)
    for k in range(len(MASKS) - 1):
        before = before + F.col(f"_s{k}")
        place = F.when(F.col("_i") >= before, F.col("_i") - before).otherwise(place)
    return out.withColumn("place", place).drop("_i", *[f"_s{k}" for k in range(len(MASKS))])


def _by_size(df: DataFrame, limit: int, size=None) -> DataFrame:
    """``df``, to be broadcast if its bytes (``size`` a row) stay within a limit; else the join shuffles."""
    total = df.agg(F.sum(F.lit(SEED_BYTES) if size is None else size)).first()[0] or 0
    return F.broadcast(df) if total <= limit else df


def contaminated(docs: DataFrame, items: DataFrame, share: float = SHARE, run: int = RUN, run_share: float = RUN_SHARE, gap: int = GAP, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and test item that it holds: doc_id, h, item_id, n_item, n_matched, overlap, first_word, last_word.

    ``h`` hashes the text, so that rows with the same id and other texts stay
    apart. ``overlap`` is the share of the item's words found in place, on the
    best diagonal and those with hits up to ``gap`` words before it, so that a
    word put in or left out does not part an item; places count words from 0.
    Items with fewer words than the shortest mask spans, and null texts, match
    nothing. Items without an id are found under a null one; of several texts
    with one id the best counts. Equal rows of either table count once. Very
    long texts are taken whole, empty tables give no rows, other columns are
    ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    tests = items.select(F.col(item_id).alias("item_id"), tokens(F.col(item_text)).alias("item")).filter(F.size("item") > min(m[-1] for m in MASKS)).distinct()
    tests = tests.withColumn("k", F.xxhash64(F.col("item_id").isNull(), "item_id", "item"))
    hashed = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    of_tests = _seed_rows(tests.select("k", F.size("item").alias("n_item"), hashed(F.col("item")).alias("_h")), "_h")
    of_tests = of_tests.select("seed", "k", "n_item", F.col("place").alias("item_place")).distinct()
    of_docs = _seed_rows(rows.select("doc_id", "h", hashed(tokens(F.col("text"))).alias("_h")), "_h")
    hits = of_docs.join(_by_size(of_tests, BROADCAST_BYTES), "seed")
    hits = util.stored(hits.select("doc_id", "h", "k", "n_item", (F.col("place") - F.col("item_place")).alias("diagonal")).distinct(), "hits")
    of_hit = hits.select(F.col("doc_id").alias("_doc_id"), F.col("h").alias("_h"), "k", "n_item", "diagonal")
    same_text = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("h") == F.col("_h"))
    matched = rows.join(of_hit.select("_doc_id", "_h").distinct(), same_text).select("doc_id", "h", "text").dropDuplicates(["doc_id", "h"])
    matched = util.computed(matched, F.struct(tokens(F.col("text")).alias("w"))).drop("text")
    first = F.greatest("diagonal", F.lit(0))
    regions = matched.join(of_hit, same_text).select("doc_id", "h", "k", "diagonal", F.size("w").alias("n_words"), F.slice("w", first + 1, F.col("n_item") + F.least("diagonal", F.lit(0))).alias("words"))
    compared = regions.join(_by_size(tests, BROADCAST_BYTES, F.octet_length(F.array_join("item", " ")) + 24 * F.size("item")), "k")
    same = F.transform("item", lambda x, i: F.coalesce(x == F.get(F.col("words"), i + F.least("diagonal", F.lit(0))), F.lit(False)))
    compared = compared.select("doc_id", "h", "k", "item_id", F.size("item").alias("n_item"), "n_words", "diagonal", same.alias("same"))
    near = Window.partitionBy("doc_id", "h", "k").orderBy("diagonal").rangeBetween(-gap, 0)
    compared = compared.withColumn("_all", F.collect_list("same").over(near))
    any_of = F.transform("same", lambda _, i: F.exists("_all", lambda a: F.get(a, i)).cast("int"))

    def best_run(s):
        length = F.least(F.size(s), F.lit(run))
        starts = F.sequence(F.lit(1), F.greatest(F.size(s) - length + 1, F.lit(1)))
        total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
        return F.array_max(F.transform(starts, lambda i: total(F.slice(s, i, F.greatest(length, F.lit(1))))))

    judged = util.computed(compared, F.struct(any_of.alias("same")))
    judged = judged.select("doc_id", "h", "item_id", "n_item", "n_words", "diagonal", F.aggregate("same", F.lit(0), lambda x, y: x + y).alias("n_matched"), best_run(F.col("same")).alias("run"))
    enough = (F.col("n_matched") >= share * F.col("n_item")) | ((F.col("run") >= run_share * run) & (F.col("n_item") >= run))
    best = F.max(F.struct((F.col("n_matched") / F.col("n_item")).alias("overlap"), "n_matched", (-F.col("diagonal")).alias("back"), "n_item", "n_words")).alias("b")
    out = judged.filter(enough).groupBy("doc_id", "h", "item_id").agg(best)
    return out.select(
        "doc_id",
        "h",
        "item_id",
        F.col("b.n_item").cast("bigint").alias("n_item"),
        F.col("b.n_matched").cast("bigint").alias("n_matched"),
        "b.overlap",
        F.greatest(-F.col("b.back"), F.lit(0)).cast("bigint").alias("first_word"),
        (F.least(F.col("b.n_item") - F.col("b.back"), F.col("b.n_words")) - 1).cast("bigint").alias("last_word"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return contaminated(util.table(spark, sf_dir, "documents"), util.table(spark, sf_dir, "benchmark")).drop("h")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item; columns as they came, whatever their names.

    Null and empty texts stay, and so do repeated rows; an empty table stays empty.
    """
    bad = util.stored(contaminated(docs, util.table(spark, sf_dir, "benchmark")).select("doc_id", "h").distinct(), "contaminated")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
    return rows.join(bad, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("h")), "left_anti").select("_row.*")
