"""Scans: bundles, witness packages, sidecars, ledgers, rules, configuration."""

from __future__ import annotations

import fnmatch
import hashlib
import subprocess
import tarfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import udfs

MEMBERS = "path string, bundle_cid string, member_cid string, body string, error string"


def scan(spark: SparkSession, root: str, pattern: str = "*.proof") -> DataFrame:
    """Bundle files under a root: path, content, stem."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", "content", F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("stem"))


def members(files: DataFrame) -> DataFrame:
    """One row per member and per load error. The file's name is its trust root: 128 hex digits that equal its content's hash.

    ``load_seq`` orders rows by path and member id, so winners do not depend on
    the order in which files are read.
    """
    named = files.withColumn("hex", F.col("stem").rlike("^[0-9a-f]{128}$"))
    good = named.filter("hex").select("path", "content", F.concat(F.lit("blake3-512:"), "stem").alias("expected"))
    bad = named.filter(~F.col("hex")).select("path", F.lit(None).cast("string").alias("bundle_cid"), F.lit(None).cast("string").alias("member_cid"), F.lit(None).cast("string").alias("body"), F.lit("file name is not a digest").alias("error"))
    rows = good.mapInPandas(udfs.explode_members, MEMBERS).unionByName(bad)
    return rows.withColumn("load_key", F.concat_ws("\x00", "path", F.coalesce("member_cid", F.lit(""))))


def from_bytes(rows: DataFrame) -> DataFrame:
    """Members of bundles handed over as (label, expected_cid, bytes); equal ones load once."""
    once = rows.groupBy("expected_cid", "bytes").agg(F.min("label").alias("path"))
    return once.select("path", F.col("bytes").alias("content"), F.col("expected_cid").alias("expected")).mapInPandas(udfs.explode_members, MEMBERS)


def git_revision(spark: SparkSession, repo: str, rev: str, folder: str, path: str = "", pattern: str = "*.proof") -> DataFrame:
    """Bundle files of ``path`` at a revision of a git repository, as :func:`scan` reads them.

    Matching files of the revision's archive are streamed one by one into a
    subfolder of the shared ``folder``; the working tree is not touched. A
    revision or path that git does not know is an error, one without such files
    gives no rows.
    """
    if rev.startswith("-") or ":" in rev:
        raise ValueError(f"not a revision: {rev!r}")
    tree = f"{rev}:{path}" if path not in ("", ".") else rev
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = f"{folder}/{hashlib.sha256(f'{repo}\n{tree}'.encode()).hexdigest()[:16]}"
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(conf)
    fs.delete(base, True)  # of an earlier run
    fs.mkdirs(base)
    with subprocess.Popen(["git", "-C", repo, "archive", "--format=tar", tree], stdout=subprocess.PIPE, stderr=subprocess.PIPE) as git:
        try:
            with tarfile.open(fileobj=git.stdout, mode="r|") as archive:
                for entry in archive:
                    if entry.isfile() and ".." not in entry.name.split("/") and fnmatch.fnmatch(entry.name.rpartition("/")[2], pattern):
                        content, out = archive.extractfile(entry), fs.create(jvm.org.apache.hadoop.fs.Path(f"{root}/{entry.name}"), True)
                        try:
                            while chunk := content.read(1 << 20):
                                out.write(bytearray(chunk))
                        finally:
                            out.close()
        except tarfile.ReadError:
            pass  # git says below what was wrong
        git.stdout.read()
        error = git.stderr.read().decode(errors="replace").strip()
    if git.returncode:
        raise ValueError(f"git archive {tree}: {error}")
    return scan(spark, root, pattern)


def fingerprints(spark: SparkSession, root: str) -> DataFrame:
    """Id of every bundle file of a directory."""
    return scan(spark, root).select("path", udfs.cid("content").alias("cid"))


def witnesses(spark: SparkSession, root: str) -> DataFrame:
    """(witness_cid, body) of all lines of witness packages; the id is computed, so a changed line has another."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.witness").text(root)
    return lines.filter("value <> ''").select(udfs.cid("value").alias("witness_cid"), F.col("value").alias("body"))


def witness(spark: SparkSession, root: str, cid: str) -> DataFrame:
    return witnesses(spark, root).filter(F.col("witness_cid") == cid)


EDGE = "edges array<struct<sourceContractCid:string,targetContractCid:string,targetSymbol:string,callSiteLocus:struct<file:string,line:int,column:int>>>"


def call_edges(spark: SparkSession, root: str) -> DataFrame:
    """Edges of all sidecar files; files that do not parse are skipped."""
    files = spark.read.schema(EDGE).option("multiLine", "true").option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.call-edges.json").json(root)
    return files.select(F.inline("edges")).toDF("source_cid", "target_cid", "target_symbol", "locus")


LEDGER = "corpus string, files int, parse_ok int, parse_fail int, assert_macros bigint, discharged bigint, refused bigint, unaccounted bigint, assertion_multiset_cid string, source_loci bigint, source_warranted bigint, source_support bigint, source_work bigint, source_refused bigint, source_inactive bigint, source_refuted bigint, unclassified_source bigint, reasons map<string,bigint>, per_file array<struct<file:string,asserts:bigint,discharged:bigint,refused:bigint,unaccounted:bigint,parse_ok:boolean>>"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """One row of counters; the older ``source_work`` counts as support."""
    row = spark.read.schema(LEDGER).option("multiLine", "true").json(path)
    return row.withColumn("source_support", F.when(F.col("source_support").isNotNull() | F.col("source_work").isNotNull(), F.coalesce("source_support", F.lit(0)) + F.coalesce("source_work", F.lit(0)))).drop("source_work")


RULE = "op string, params array<string>, template string"


def rules(spark: SparkSession, root: str) -> list[dict]:
    """All rewrite rules of a directory, by operator: a configuration that the driver holds."""
    import json

    rows = spark.read.schema(RULE).option("multiLine", "true").option("pathGlobFilter", "*.json").json(root).orderBy("op").collect()
    return [{"op": r["op"], "params": r["params"], "template": json.loads(r["template"])} for r in rows]


def config(spark: SparkSession, path: str) -> dict:
    """A TOML file through Spark's reader, so it may lie in any store."""
    import tomllib

    rows = spark.read.format("binaryFile").load(path).select("content").take(1)
    return tomllib.loads(bytes(rows[0]["content"]).decode()) if rows else {}


def source_bodies(pins: DataFrame, files: DataFrame) -> DataFrame:
    """Pins (path, start, stop, pinned) with the text found there, or a refusal where its id differs or the file is missing."""
    found = pins.join(files.select("path", "content"), "path", "left")
    body = F.expr("substring(cast(content as string), start + 1, stop - start)")
    found = found.withColumn("body", body).withColumn("actual", udfs.cid("body"))
    state = F.when(F.col("content").isNull(), "missing").when(F.col("actual") == F.col("pinned"), "resolved").otherwise("refused")
    return found.select("path", "pinned", state.alias("state"), F.when(state == "resolved", F.col("body")).alias("body"))


def test_outcomes(lines: DataFrame) -> DataFrame:
    """(name, outcome) from lines of a test runner."""
    pattern = r"^test (\S+) \.\.\. (ok|FAILED|ignored)"
    hit = lines.filter(F.col("value").rlike(pattern))
    return hit.select(F.regexp_extract("value", pattern, 1).alias("name"), F.regexp_extract("value", pattern, 2).alias("outcome"))


def first_per_name(contracts: DataFrame) -> DataFrame:
    """Import bindings: for each name the contract with a pre, else with a post, else with an inv; ties by id."""
    rank = F.when(F.col("pre").isNotNull(), 0).when(F.col("post").isNotNull(), 1).otherwise(2)
    best = contracts.groupBy("name").agg(F.min(F.struct(rank.alias("rank"), "contract_cid")).alias("w"))
    return best.select("name", F.col("w.contract_cid").alias("contract_cid"))
