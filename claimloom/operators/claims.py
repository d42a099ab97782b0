"""Grouped claims: conjunction, the ground decision procedure, verdicts, reports, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def conjoin(claims: DataFrame) -> DataFrame:
    """Groups of claims that are decided together: those of one ``#euf#`` name; any other row is a group of its own."""
    joined = F.col("name").contains("#euf#")
    return claims.withColumn("claim_group", F.when(joined, F.col("name")).otherwise(F.concat_ws("@", "name", "claim_id")))


def decide(literals: DataFrame, integer: bool = False, by: str = "claim_group") -> DataFrame:
    """Verdict per group over literal facts (op, value) about one term.

    Two different equalities, an equality that a disequality or a bound rules
    out, crossed bounds, and an integer interval or point whose every place is
    excluded are unsat. A fact outside the fragment leaves a group undecidable
    unless it is unsat anyway.
    """
    v, op = F.col("value"), F.col("op")
    low = F.when(op == ">=", v).when(op == ">", F.floor(v) + 1 if integer else v)
    high = F.when(op == "<=", v).when(op == "<", F.ceil(v) - 1 if integer else v)
    if integer:
        low, high = F.ceil(low), F.floor(high)
    agg = literals.groupBy(by).agg(
        F.count("*").alias("n"),
        F.count_distinct(F.when(op == "=", v)).alias("n_eq"),
        F.min(F.when(op == "=", v)).alias("eq"),
        F.max(low).alias("low"),
        F.min(high).alias("high"),
        F.max(F.when(op == ">", v)).alias("above"),
        F.min(F.when(op == "<", v)).alias("below"),
        F.collect_set(F.when(op == "!=", v)).alias("not_in"),  # one value per distinct literal of the group
        F.count_if(~op.isin("=", "!=", "<", "<=", ">", ">=") | v.isNull()).alias("n_other"),
    )
    eq = F.col("eq")
    crossed = F.col("low") > F.col("high")
    out_of_bounds = (eq < F.col("low")) | (eq > F.col("high"))
    if integer:
        inside = F.size(F.filter("not_in", lambda x: (x >= F.col("low")) & (x <= F.col("high")) & (x == F.floor(x))))
        excluded = inside >= F.col("high") - F.col("low") + 1
    else:
        strict = (F.col("above") >= F.col("high")) | (F.col("below") <= F.col("low"))
        crossed = crossed | strict
        out_of_bounds = out_of_bounds | (eq <= F.col("above")) | (eq >= F.col("below"))
        excluded = (F.col("low") == F.col("high")) & F.array_contains("not_in", F.col("low"))
    false = lambda c: F.coalesce(c, F.lit(False))
    unsat = (F.col("n_eq") > 1) | false(F.array_contains("not_in", eq)) | false(out_of_bounds) | false(crossed) | false(excluded)
    raw = F.when(unsat, "unsat").when(F.col("n_other") > 0, "undecidable").otherwise("sat")
    return agg.select(by, F.col("n").alias("n_claims"), raw.alias("raw"), C.consistency_status(raw).alias("status"))


def ladder(tiers: list[tuple[str, Column]], status: str = "discharged") -> tuple[Column, Column]:
    """First tier whose condition holds, as (status, method); rows that none settles are undecided."""
    method = F.lit(None).cast("string")
    for name, condition in reversed(tiers):
        method = F.when(condition, name).otherwise(method)
    return F.when(method.isNotNull(), status).otherwise("undecidable"), method


def settled(obligations: DataFrame) -> DataFrame:
    """Obligations as report rows: the outcome is the method, and its status follows from it."""
    outcome = F.col("outcome")
    status = F.when(outcome.isin("vacuous", "equal", "implied"), "discharged").when(outcome == "refuted", "unsatisfied").when(outcome.isin("unresolved-symbol", "unprovable-obligation"), "refused").otherwise("undecidable")
    return obligations.withColumns({"method": outcome, "status": status})


def report(rows: DataFrame) -> DataFrame:
    """Counters over report rows (row_class, status). Self posts and consistency rows count as passes or violations, not as call sites.

    Refused rows are neither; zero call sites, violations and load errors fail.
    """
    is_ = lambda s: F.col("status") == s
    one = rows.agg(
        F.count_if(F.col("row_class") == "callsite").alias("total_callsites"),
        F.count_if(is_("discharged")).alias("discharged"),
        F.count_if(is_("refused")).alias("refused"),
        F.count_if(is_("unsatisfied") | is_("undecidable")).alias("violations"),
        F.count_if(F.col("row_class") == "load-error").alias("load_errors"),
    )
    failed = (F.col("violations") > 0) | (F.col("load_errors") > 0) | (F.col("total_callsites") == 0)
    return one.withColumn("exit_code", F.when(failed, 1).otherwise(0))


def discharge_split(rows: DataFrame, bucket: Column, names: list[str]) -> DataFrame:
    """One row with a count per bucket."""
    return rows.select(bucket.alias("b")).agg(*[F.count_if(F.col("b") == n).alias(n) for n in names])


def histogram(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def sweep(files: DataFrame) -> DataFrame:
    """Per file and in total (file null) in one pass: asserts, discharged, refused, unaccounted."""
    n = lambda s: F.count_if(F.col("state") == s)
    out = files.rollup("file").agg(F.count("*").alias("asserts"), n("discharged").alias("discharged"), n("refused").alias("refused"))
    return out.withColumn("unaccounted", F.col("asserts") - F.col("discharged") - F.col("refused")).withColumn("undischarged", F.col("asserts") - F.col("discharged"))


def verdict_conjunction(evidence: DataFrame, by: str) -> DataFrame:
    """Any refusal refuses; all exact is exact; else lossy, with the losses of each dimension joined by and."""
    rank = F.when(F.col("verdict") == "refuse", 2).when(F.col("verdict") == "lossy", 1).otherwise(0)
    worst = evidence.groupBy(by).agg(F.max(rank).alias("r"), F.array_sort(F.collect_set(F.when(F.col("verdict") == "lossy", F.struct("dimension", "formula")))).alias("losses"))
    verdict = F.when(F.col("r") == 2, "refuse").when(F.col("r") == 1, "lossy").otherwise("exact")
    text = F.array_join(F.transform("losses", lambda x: F.concat_ws(":", x["dimension"], x["formula"])), " and ")
    return worst.select(by, verdict.alias("verdict"), F.when(F.col("r") == 1, text).otherwise("").alias("loss"))


def solver_telemetry(runs: DataFrame) -> DataFrame:
    return runs.groupBy("solver").agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("verdict") == "discharged").alias("discharged"),
        F.count_if(F.col("verdict") == "unsatisfied").alias("unsatisfied"),
        F.count_if(F.col("verdict") == "timeout").alias("timeouts"),
        F.sum("wall_ms").alias("wall_ms"),
        F.max_by("version", "seq").alias("version"),
    )


def rollup_paths(loci: DataFrame) -> DataFrame:
    """Loci that no other locus of the same file contains.

    A path's ancestors are its own prefixes, so the containment test is an
    equi-join on exploded prefixes, not a comparison of all pairs.
    """
    parts = F.split("path", r"\.")
    up = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), ".")))
    above = loci.select("file", "path", F.explode(up).alias("parent")).distinct()
    inside = above.join(loci.select("file", F.col("path").alias("parent")).distinct(), ["file", "parent"], "left_semi").select("file", "path").distinct()
    return loci.join(inside, ["file", "path"], "left_anti")


def set_digest(rows: DataFrame, by: str | None, member: str) -> DataFrame:
    """Digest of a group's members, duplicates kept, with their number and that of distinct ones.

    Two levels, so that no group comes together in one row: members fall into
    65,536 buckets by the first digits of their SHA-256; each bucket's digest is
    that of its sorted members with their numbers, and the group's that of the
    bucket digests in order.
    The exact id of a set that fits a row is ``functions.canon.set_cid``.
    """
    keys = [by] if by else []
    parts = rows.filter(F.col(member).isNotNull()).groupBy(*keys, F.substring(F.sha2(F.col(member).cast("binary"), 256), 1, 4).alias("_b"), F.col(member).alias("_m")).agg(F.count("*").alias("_n"))
    line = F.concat_ws(":", F.col("_m"), F.col("_n").cast("string"))
    buckets = parts.groupBy(*keys, "_b").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_m", line.alias("l")))), lambda x: x["l"]), "\n").cast("binary"), 256).alias("_d"), F.sum("_n").alias("_n"), F.count("*").alias("_k"))
    whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_d"))), lambda x: x["_d"]), "\n").cast("binary"), 256)
    return buckets.groupBy(*keys).agg(whole.alias("digest"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum("_k"), F.lit(0)).alias("n_distinct"))


def floor_checks(signals: DataFrame) -> DataFrame:
    """Rows (check, status) over one row of signals: zero where zero is demanded."""
    zero = lambda c, name, bad="fail": F.struct(F.lit(name).alias("check"), F.when(F.col(c) == 0, "pass").otherwise(bad).alias("status"))
    checks = F.array(
        zero("silently_dropped", "silently-dropped"),
        zero("false_pass", "false-pass"),
        zero("dropped_sites", "dropped-sites"),
        zero("unnamed", "panic-census-named", "warn"),
        F.struct(F.lit("total-callsites").alias("check"), F.when(F.col("total_callsites") > 0, "pass").otherwise("fail").alias("status")),
        F.struct(F.lit("discharge-split").alias("check"), F.when(F.col("split_total") == F.col("total_rows"), "pass").otherwise("fail").alias("status")),
    )
    return signals.select(F.inline(checks))
