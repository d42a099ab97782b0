"""Comparison of claim sets by behaviour, and the gates over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def classify(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row per behaviour: status (held, renamed, new, lost), names that stayed, went and came.

    Tables have name and behaviour. Both sides are grouped by behaviour first, so
    the full join moves one row per behaviour.
    """
    side = lambda df, c: df.filter("behaviour is not null").groupBy("behaviour").agg(F.array_sort(F.collect_set("name")).alias(c))
    both = side(before, "b").join(side(after, "a"), "behaviour", "full")
    none = F.expr("cast(array() as array<string>)")
    b, a = F.coalesce("b", none), F.coalesce("a", none)
    status = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "lost").when(b == a, "held").otherwise("renamed")
    return both.select(
        "behaviour",
        status.alias("status"),
        F.size(F.array_intersect(b, a)).alias("n_held"),
        F.array_join(F.array_except(b, a), ", ").alias("from_names"),
        F.array_join(F.array_except(a, b), ", ").alias("to_names"),
    )


def summarize(classified: DataFrame) -> DataFrame:
    """One row: new, lost, held (names) and renamed (behaviours), and the bump they imply."""
    n = lambda s: F.count_if(F.col("status") == s)
    held = F.coalesce(F.sum(F.when(F.col("status").isin("held", "renamed"), F.col("n_held"))), F.lit(0)).cast("bigint")
    one = classified.agg(n("new").alias("new_behaviours"), n("lost").alias("lost_behaviours"), held.alias("held"), n("renamed").alias("renamed"))
    return one.withColumn("bump", C.bump(F.col("lost_behaviours"), F.col("new_behaviours")))


def gate(summary: DataFrame, require: str | None = None, frozen: bool = False) -> DataFrame:
    """Adds ``ok``. Nothing on either side fails; ``frozen`` allows no change; ``require`` bounds the bump; else nothing may be lost."""
    if require is not None and require.lower() not in ("none", "minor", "major"):
        raise ValueError(f"invalid require {require!r}")
    counts = [F.col(c) for c in ("new_behaviours", "lost_behaviours", "renamed")]
    vacuous = C.all_of([c == 0 for c in counts]) & (F.col("held") == 0)
    if frozen:
        ok = C.all_of([c == 0 for c in counts])
    elif require is not None:
        ok = C.bump_rank(F.col("bump")) <= C.bump_rank(F.lit(require))
    else:
        ok = F.col("lost_behaviours") == 0
    return summary.withColumn("ok", ~vacuous & ok)


def markdown(summary: DataFrame) -> DataFrame:
    """The verdict as a line of Markdown."""
    text = F.format_string("**%s** new=%d lost=%d held=%d renamed=%d", F.col("bump"), F.col("new_behaviours"), F.col("lost_behaviours"), F.col("held"), F.col("renamed"))
    return summary.select(text.alias("markdown"))


def report_markdown(gated: DataFrame, residual: DataFrame | None = None, require: str | None = None, frozen: bool = False) -> DataFrame:
    """Report of a comparison as one Markdown text: verdict, mode, counts with their bump, and the residual if there is one.

    ``gated`` is the row of :func:`gate`, ``residual`` that of
    :func:`residual_gate`. The changes themselves are :func:`change_lines`.
    """
    mode = "frozen (any change fails)" if frozen else f"require {require}" if require else "default (loss or growth fails)"
    counts = ("new_behaviours", "lost_behaviours", "held", "renamed")
    vacuous = C.all_of([F.col(c) == 0 for c in counts])
    behaviour = F.format_string("**Behaviour:** %d new, %d lost, %d held, %d renamed; bump `%s`", *counts, F.col("bump"))
    parts = [F.when(vacuous, "**Behaviour:** vacuous; nothing on either side").otherwise(behaviour)]
    ok = F.col("ok")
    if residual is not None:
        gated = gated.join(residual.select("before_residual", "after_residual", F.col("ok").alias("_residual_ok")))  # one row on each side
        ok = ok & F.col("_residual_ok")
        parts.append(F.format_string("**Residual:** %d to %d (%+d)", "before_residual", "after_residual", F.col("after_residual") - F.col("before_residual")))
    head = F.concat(F.lit("### Claim diff: "), F.when(ok, "PASS").otherwise("FAIL"))
    return gated.select(F.concat_ws("\n\n", head, F.lit(f"**Mode:** `{mode}`"), *parts).alias("markdown"))


def change_lines(classified: DataFrame) -> DataFrame:
    """(behaviour, line) of what changed, in order: +, - or ~ with the names."""
    line = F.when(F.col("status") == "new", F.concat(F.lit("+ "), "to_names")).when(F.col("status") == "lost", F.concat(F.lit("- "), "from_names")).otherwise(F.concat(F.lit("~ "), "from_names", F.lit(" -> "), "to_names"))
    return classified.filter("status <> 'held'").select("behaviour", line.alias("line")).orderBy("line", "behaviour")


AXIS = ["source_loci", "source_warranted", "source_support", "source_refused", "source_inactive", "source_refuted", "unclassified_source"]
COUNTERS = ["assert_macros", "discharged", "refused", "unaccounted"]


def residual_gate(before: DataFrame, after: DataFrame, require: str | None = None, frozen: bool = False) -> DataFrame:
    """One row: residuals and ``ok`` over two one-row ledgers.

    Silent drops, a lost source axis and unclassified sources always fail.
    """
    cols = COUNTERS + AXIS + ["assertion_multiset_cid"]
    b = before.select(*[F.col(c).alias(f"b_{c}") for c in cols], F.lit(1).alias("_k"))
    a = after.select(*[F.col(c).alias(f"a_{c}") for c in cols], F.lit(1).alias("_k"))
    both = b.join(a, "_k")  # one row on each side
    has = lambda p: ~C.all_of([F.col(f"{p}_{c}").isNull() for c in AXIS])
    left = lambda p: F.col(f"{p}_assert_macros") - F.col(f"{p}_discharged")
    sound = (F.col("a_unaccounted") <= 0) & ~(has("b") & ~has("a")) & (F.coalesce("a_unclassified_source", F.lit(0)) <= 0)
    grew = left("a") > left("b")
    if frozen:
        ok = C.all_of([F.col(f"b_{c}").eqNullSafe(F.col(f"a_{c}")) for c in cols])
    elif require is not None:
        ok = ~grew if require.lower() != "major" else F.lit(True)
    else:
        ok = ~grew
    return both.select(left("b").alias("before_residual"), left("a").alias("after_residual"), (sound & ok).alias("ok"))
