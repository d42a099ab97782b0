"""Policies: claim shapes, admission, release, solver gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def validate_claims(claims: DataFrame) -> DataFrame:
    """Adds ``error``: every verdict kind carries exactly its fields (witness, loss, gap)."""
    has = lambda c: F.col(c).isNotNull()
    error = (
        F.when((F.col("verdict") == "exact") & (has("loss") | has("gap")), "exact claim with loss or gap")
        .when((F.col("verdict") == "exact") & ~has("witness"), "exact claim without witness")
        .when((F.col("verdict") == "lossy") & (~has("loss") | has("gap")), "lossy claim needs a loss and no gap")
        .when((F.col("verdict") == "gap") & (~has("gap") | has("witness")), "gap claim needs a gap and no witness")
        .when(~F.col("verdict").isin("exact", "lossy", "gap"), "unknown verdict")
    )
    return claims.withColumn("error", error)


def claim_report(claims: DataFrame) -> DataFrame:
    """Counts of exact, lossy, gap and invalid claims."""
    outcome = F.when(F.col("error").isNotNull(), "invalid").otherwise(F.col("verdict"))
    return validate_claims(claims).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def admission(receipts: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Receipts with ``admitted``: artifact and policy ids both equal what the receipt names."""
    a = artifacts.select("artifact", F.col("artifact_cid").alias("_a"), F.col("policy_cid").alias("_p"))
    ok = F.col("artifact_cid").eqNullSafe(F.col("_a")) & F.col("policy_cid").eqNullSafe(F.col("_p")) & F.col("_a").isNotNull()
    return receipts.join(a, "artifact", "left").withColumn("admitted", ok).drop("_a", "_p")


def admit_profiles(profiles: DataFrame) -> DataFrame:
    """Valid policy profiles by id; the last one written stays."""
    valid = profiles.filter((F.col("threshold") >= 0) & (F.col("threshold") <= 10_000) & F.col("name").isNotNull())
    return valid.groupBy("cid").agg(F.max_by(F.struct("name", "threshold"), "load_seq").alias("p")).select("cid", "p.name", "p.threshold")


def release(checks: dict[str, list[tuple[str, bool]]]) -> dict:
    """Receipt of a release: each target passes if all of its checks do; no target fails."""
    targets = {t: all(ok for _, ok in found) and bool(found) for t, found in checks.items()}
    return {"targets": targets, "ok": bool(targets) and all(targets.values())}


def rewriting_gate(rules: list[dict], enabled: bool) -> str:
    """No rules pass; with the gate off, rules are rejected; else certificates would be needed, which are not at hand."""
    return "accepted" if not rules else "undecidable" if enabled else "rejected"


def config_checks(config: dict) -> list[dict]:
    """Wiring of a configuration: solvers exist that the plan and the dispatch table name."""
    solvers = {s.get("name") for s in config.get("solvers", [])}
    named = set(config.get("plan", {}).get("order", [])) | set(config.get("dispatch", {}).values())
    out = [{"check": "has-solvers", "ok": bool(solvers)}]
    return out + [{"check": f"solver-{n}", "ok": n in solvers} for n in sorted(named)]


def theory_route(theory: str, dispatch: dict[str, str]) -> str | None:
    return dispatch.get(theory, dispatch.get("default"))
