"""The bundle data source: partitions, commit, and runs read back."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from claimloom.functions import bundle, canon
from claimloom.sources import bundle_source, sinks

DAY, SEED = "2026-01-01T00:00:00.000Z", bytes(32)


def made(spark, n):
    bodies = [(f"b{i % n}", json.dumps({"evidence": {"kind": "k", "body": {"i": i}}})) for i in range(3 * n)]
    rows = [(name, canon.member_cid(json.loads(b)), b) for name, b in bodies]
    return sinks.build_bundles(spark.createDataFrame(rows, "name string, member_cid string, body string"), "s", DAY, SEED)


def names(root):
    return sorted(p.name for p in Path(root).rglob("*") if p.is_file())


def read(spark, root, **options):
    bundle_source.register(spark)
    return spark.read.format("claim_bundles").options(**options).load(str(root))


def test_written_in_tasks_and_read_by_size(spark, tmp_path):
    files = made(spark, 7).cache()
    assert sinks.write_files(files, f"file://{tmp_path}/out") == 7
    assert sinks.write_files(files.limit(3), f"file://{tmp_path}/out") == 3  # the same names again
    assert names(tmp_path / "out") == sorted(r.bundle_cid.rpartition(":")[2] + ".proof" for r in files.collect())
    (tmp_path / "out" / "deep").mkdir()
    (tmp_path / "out" / "deep" / "x.proof").write_bytes(b"")
    (tmp_path / "out" / "deep" / "note.txt").write_text("no bundle")
    for most in (1, 2500, 64 << 20):
        got = read(spark, tmp_path / "out", maxPartitionBytes=most)
        assert got.filter("error is null").select("member_cid").distinct().count() == 21 and [r.error for r in got.filter("error is not null").collect()] == ["file name is not a digest"]
    assert read(spark, tmp_path / "out", maxPartitionBytes=1).rdd.getNumPartitions() == 8 > read(spark, tmp_path / "out").rdd.getNumPartitions()


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    files = made(spark, 5).cache()
    sinks.write_files(files.limit(1), str(tmp_path / "out"))
    before = names(tmp_path / "out")
    broken = files.unionByName(spark.createDataFrame([("z", "blake3-512:short", b"x")], files.schema)).repartition(4)
    with pytest.raises(Exception, match="no bundle"):
        sinks.write_files(broken, str(tmp_path / "out"))
    assert names(tmp_path / "out") == before and [p for p in (tmp_path / "out").iterdir() if p.is_dir()] == []
    late = files.withColumn("content", F.when(F.col("name") == "b4", F.raise_error(F.lit("late"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="late"):
        sinks.write_files(late, str(tmp_path / "out"))
    assert names(tmp_path / "out") == before


def test_attempts_that_were_not_committed_stay_out(spark, tmp_path):
    files = {r.bundle_cid: bytes(r.content) for r in made(spark, 2).collect()}
    w = bundle_source.BundleWriter({"path": str(tmp_path)})
    kept, lost = files
    for folder, cid in (("0-1", kept), ("0-2", lost)):
        (Path(w.staging) / folder).mkdir(parents=True)
        (Path(w.staging) / folder / f"{cid.rpartition(':')[2]}.proof").write_bytes(files[cid])
    assert read(spark, tmp_path).count() == 0  # nothing is there before the commit
    w.commit([bundle_source.Staged(f"{w.staging}/0-1"), None])
    assert {r.bundle_cid for r in read(spark, tmp_path).collect()} == {kept} and names(tmp_path) == [kept.rpartition(":")[2] + ".proof"]


def test_empty_and_missing(spark, tmp_path):
    assert read(spark, tmp_path / "none").collect() == []
    assert sinks.write_files(made(spark, 1).limit(0), str(tmp_path / "out")) == 0 and names(tmp_path / "out") == []
    with pytest.raises(Exception, match="append"):
        made(spark, 1).write.format("claim_bundles").mode("overwrite").save(str(tmp_path / "out"))


def test_runs_read_back_with_their_receipts(spark, tmp_path):
    stages = [("r1", 1, "load", "discharged", '{"n":3}'), ("r1", 2, "solve", "unsatisfied", None), ("r2", 1, "load", "discharged", None), ("r3", 1, "load", "discharged", None), ("r3", 2, "solve", "skipped", None)]
    frame = spark.createDataFrame(stages, "run_id string, position int, stage string, verdict string, facts string")
    bundles = sinks.run_bundles(frame, "s", DAY, SEED)
    assert all(bundle.conformance(bytes(r.content), r.bundle_cid.rpartition(":")[2]) == [] for r in bundles.collect())
    sinks.write_files(bundles, str(tmp_path / "runs"))
    rows = [(r.bundle_cid, r.member_cid, json.loads(r.body)["header"]) for r in read(spark, tmp_path / "runs").collect()]
    runs = {h["run"]: h for _, _, h in rows if h["kind"] == "proof-run"}
    assert {k: h["verdict"] for k, h in runs.items()} == {"r1": "unsatisfied", "r2": "discharged", "r3": "undecidable"}
    receipts = {cid: h for _, cid, h in rows if h["kind"] == "stage-receipt"}
    assert [receipts[c]["stage"] for c in runs["r1"]["stageReceipts"]] == ["load", "solve"] and receipts[runs["r1"]["stageReceipts"][0]]["facts"] == {"n": 3}
