"""Sinks: bundles, witness packages, JSON reports."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import bundle, canon
from . import bundle_source

BUNDLE = "name string, bundle_cid string, content binary"


def build_bundles(members: DataFrame, signer: str, declared_at: str, seed: bytes, version: str = "1") -> DataFrame:
    """One signed bundle per name from rows (name, member_cid, body). A bundle is one file, so its members fit one task."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["name"].iloc[0]
        parts = {c: b.encode() for c, b in zip(pdf["member_cid"], pdf["body"], strict=True)}
        cid, data = bundle.build_bundle(name, version, parts, signer, declared_at, seed)
        return pd.DataFrame([{"name": name, "bundle_cid": cid, "content": data}])

    return members.select("name", "member_cid", "body").groupBy("name").applyInPandas(one, BUNDLE)


def write_files(files: DataFrame, root: str, suffix: str = ".proof") -> int:
    """Write (bundle_cid, content) rows as files named by digest, in tasks; none appears before all are written. Gives the number of rows."""
    bundle_source.register(files.sparkSession)
    seen = Observation()
    files.select("bundle_cid", "content").observe(seen, F.count(F.lit(1)).alias("n")).write.format("claim_bundles").mode("append").option("suffix", suffix).save(root)
    return seen.get["n"]


RUN_NAME = "verifier-run"


def run_bundles(stages: DataFrame, signer: str, declared_at: str, seed: bytes) -> DataFrame:
    """One signed bundle per run: a receipt for each stage, and a memento that names them in order.

    Stages have run_id, position, stage, verdict and facts (a JSON object). A run is unsatisfied
    if a stage is, else undecidable if one is, else discharged. The stages of a run fit one task.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        how = {"signer": signer, "declared_at": declared_at, "seed": seed}
        run, order, parts = pdf["run_id"].iloc[0], [], {}
        for r in pdf.sort_values(["position", "stage"]).itertuples(index=False):
            cid, member = bundle.mint("stage-receipt", {"run": run, "position": int(r.position), "stage": r.stage, "verdict": r.verdict, "facts": json.loads(r.facts) if r.facts is not None else None}, {}, **how)
            order.append(cid)
            parts[cid] = canon.jcs(member, "linker").encode()
        said = set(pdf["verdict"])
        verdict = "unsatisfied" if "unsatisfied" in said else "undecidable" if said != {"discharged"} else "discharged"
        cid, member = bundle.mint("proof-run", {"run": run, "stageReceipts": order, "verdict": verdict}, {"note": "run receipt"}, **how)
        parts[cid] = canon.jcs(member, "linker").encode()
        made, data = bundle.build_bundle(RUN_NAME, "1.0.0", parts, signer, declared_at, seed)
        return pd.DataFrame([{"name": run, "bundle_cid": made, "content": data}])

    return stages.select("run_id", "position", "stage", "verdict", "facts").groupBy("run_id").applyInPandas(one, BUNDLE)


def witness_packages(witnesses: DataFrame) -> DataFrame:
    """(suite, package_cid, count, passed, content): bodies by test id, one per line."""
    from ..functions import udfs

    rows = F.array_sort(F.collect_list(F.struct("test_id", "body")))
    text = F.concat(F.array_join(F.transform(rows, lambda x: x["body"]), "\n"), F.lit("\n"))
    out = witnesses.groupBy("suite").agg(text.alias("content"), F.count("*").alias("count"), F.count_if(F.col("outcome") == "passed").alias("passed"))
    return out.withColumn("package_cid", udfs.cid("content"))


def verification_receipt(claims: DataFrame, witnesses: DataFrame) -> DataFrame:
    """One row: totals of claims (status, method, obligation_class) and of witnesses (result), the split of claims, and ``ok``.

    Claims themselves go out row by row with :func:`report_json`. ``ok`` asks for
    no failed claim and only verified witnesses; no claims at all are not ok.
    """
    from ..functions import columns as C

    done = F.col("status") == "discharged"
    bucket = C.claim_bucket(F.col("status"), F.col("method"), F.col("obligation_class"))
    split = [F.count_if(bucket == b).alias(f"split_{b}") for b in ("reflexive", "panicSafe", "substantive", "vacuous", "hashTier", "undecidable")]
    one = claims.agg(F.count("*").alias("total_claims"), F.count_if(done).alias("discharged"), F.count_if(F.coalesce(~done, F.lit(True))).alias("failed"), *split)
    audit = witnesses.agg(F.count("*").alias("witnesses"), F.count_if(F.col("result") == "verified").alias("verified"))
    ok = (F.col("failed") == 0) & (F.col("total_claims") > 0) & (F.col("verified") == F.col("witnesses"))
    return one.join(audit).withColumn("ok", ok)  # one row on each side


def report_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def report_text(report: DataFrame) -> str:
    """A one-row report as lines."""
    r = report.first()
    return "\n".join(f"{k}: {v}" for k, v in r.asDict().items()) if r else "no report"


def dump(members: DataFrame) -> DataFrame:
    """Members as readable JSON lines."""
    return members.select("bundle_cid", "member_cid", F.to_json(F.parse_json("body")).alias("body")).orderBy("bundle_cid", "member_cid")
