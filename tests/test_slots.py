"""Linking from a stream with keyed state."""

import time

from pyspark.sql import functions as F

from claimloom.operators import linking
from claimloom.streaming import slots

SCHEMA = f"kit string, file string, version long, contracts {slots.CONTRACTS}, edges {slots.EDGES}"


def contract(name, pre=None, post=None, cid=None):
    return ("k", name, cid or f"c:{name}:{pre}:{post}", pre, post)


def edge(source, symbol, line, cid=None):
    return (source, cid, symbol, line)


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    time.sleep(0.05)  # files are taken in the order of their times


def run(spark, tmp_path, **how):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = slots.start(stream, str(tmp_path / "out"), str(tmp_path / "cp"), **how)
    q.awaitTermination(90)
    assert q.exception() is None
    return str(tmp_path / "out")


def log(spark, out, kind):
    return {n: spark.read.parquet(f"{out}/{kind}/batch={n}").count() for n in slots._batches(spark, f"{out}/{kind}", "batch")}


def links(spark, out):
    return sorted((r.kit, r.file or "", r.line, r.outcome) for r in slots.current_links(spark, out).collect())


def whole(spark, rows):
    """Outcomes of linking the last versions anew."""
    last = {}
    for r in rows:
        if r[:2] not in last or r[2] > last[r[:2]][2]:
            last[r[:2]] = r
    now = spark.createDataFrame(list(last.values()), SCHEMA)
    made = linking.obligations(now.select("kit", "file", F.inline("edges")), now.select(F.inline("contracts")))
    return sorted((r.kit, r.file or "", r.line, r.outcome) for r in made.collect())


CALLER = contract("caller", post="p", cid="c:caller")
CALLS = ("k", "calls", 1, [CALLER], [edge("c:caller", "k:f", 1), edge("c:caller", "k:g", 2), edge("c:caller", "k:none", 3)])
F1 = ("k", "f", 1, [contract("f", pre="p")], [])
G1 = ("k", "g", 1, [contract("g")], [])


def test_unchanged_and_late_slots_write_nothing(spark, tmp_path):
    late = ("k", "f", 2, [contract("f", pre="late")], [])
    steps = [[CALLS, F1, G1], [F1], [("k", "f", 3, *F1[3:])], [late], [("k", "calls", 1, *CALLS[3:])]]
    for s in steps:
        put(spark, str(tmp_path / "in"), s)
    out = run(spark, tmp_path)
    assert log(spark, out, "slots") == {0: 3, 1: 0, 2: 0, 3: 0, 4: 0} and list(log(spark, out, "links")) == [0]
    assert links(spark, out) == whole(spark, [r for s in steps for r in s]) == [("k", "calls", 1, "equal"), ("k", "calls", 2, "vacuous"), ("k", "calls", 3, "unresolved-symbol")]


def test_only_touched_edges_are_linked_again(spark, tmp_path):
    steps = [
        [CALLS, F1, G1],
        [("k", "f", 2, [contract("f", pre="q")], [])],  # one contract changes
        [("k", "h", 1, [contract("none")], [])],  # a missing one comes
        [("k", "g", 2, None, None)],  # one goes
        [("k", "calls", 2, [contract("caller", cid="c:caller")], CALLS[4][:1])],  # the caller loses its post and two edges
    ]
    for s in steps:
        put(spark, str(tmp_path / "in"), s)
    out = run(spark, tmp_path, compact_every=2)
    assert log(spark, out, "slots") == {0: 3, 1: 1, 2: 1, 3: 1, 4: 1}
    assert log(spark, out, "links") == {0: 3, 1: 1, 2: 1, 3: 1, 4: 1}
    assert slots._batches(spark, f"{out}/snapshot-links", "upto") == [1, 3]
    done = []
    for n, s in enumerate(steps):
        done += [(*r[:3], r[3] or [], r[4] or []) for r in s]
        got = sorted((r.kit, r.file, r.line, r.outcome) for r in slots.current_links(spark, out, n).collect())
        assert got == whole(spark, done), n
    assert links(spark, out) == [("k", "calls", 1, "unprovable-obligation")]


def test_ties_repeats_and_nulls(spark, tmp_path):
    rows = [("k", None, None, [contract("f", pre="p")], []), ("k", None, 5, [CALLER], [edge(None, None, 1), edge("c:caller", "k:g", 2)]), ("k", "", 1, [contract("g"), contract("g")], []), G1, G1]
    put(spark, str(tmp_path / "in"), rows)
    put(spark, str(tmp_path / "in"), [("k", "g", 1, [contract("g", pre="z")], [])])  # same version, other content: the greater digest stays
    out = run(spark, tmp_path)
    now = {(r.kit, r.file): r for r in slots.current_slots(spark, out).collect()}
    assert set(now) == {("k", None), ("k", ""), ("k", "g")} and now["k", None].version == 5
    assert [x[2:] for x in links(spark, out)] == [(1, "unresolved-symbol"), (2, "vacuous")]


def test_eviction_keeps_late_versions_out(spark, tmp_path):
    put(spark, str(tmp_path / "in"), [("k", "f", 3, [contract("f", pre="p")], [])])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    q = slots.start(stream, out, str(tmp_path / "cp"), ttl_ms=1, trigger={"processingTime": "1 second"})
    try:
        for _ in range(60):
            if sum(log(spark, out, "slots").values()) == 1:
                break
            time.sleep(0.5)
        put(spark, str(tmp_path / "in"), [("k", "f", 2, [contract("f", pre="late")], [])])
        for _ in range(60):
            if sum(log(spark, out, "slots").values()) == 2:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert sum(log(spark, out, "slots").values()) == 2  # the state was gone, so it was written once more
    assert [r.version for r in slots.current_slots(spark, out).collect()] == [3]


def test_edges_of_slots_travel_little(spark, tmp_path):
    """Odd edges come to what linking all at once makes of them; the log of links is dealt out once."""
    made = [contract("f", pre="p", cid="c:f"), contract("f", pre="o", cid="c:f"), contract("f", cid="c:e"), contract("caller", post="p", cid="c:caller"), contract("caller", post="z", cid="c:caller"), ("k", "g", None, "p", "p"), (None, "h", "c:h", "p", None), ("k", None, "c:n", "p", None), ("c", "c:f", "c:x", None, "q")]
    asked = [edge(s, t, n, c) for n, (s, t, c) in enumerate((s, t, c) for s in ("c:caller", "c:none", None, "c:x") for t in ("k:f", "k:g", "c:c:f", ":f", "k:", "f", "k:h", None) for c in (None, "c:f", "c:h", "c:none"))]
    slot = [("k", "a", 1, made, asked[:50]), ("k", None, 1, [], asked[50:])]
    rows = spark.createDataFrame(slot, SCHEMA).withColumns({"slot": F.to_json(F.struct("kit", "file")), "digest": F.lit("d"), "touched": F.array().cast("array<string>")})
    for upper in (10**9, -1):  # keys sent to all tasks, and dealt out
        touched = slots._touched(slots._edges(rows), rows.limit(1).withColumn("touched", F.array(F.lit("c:c:f"), F.lit("s:k:g"), F.lit("c:c:x"))), upper)
        ask = lambda e: {f"c:{e[0]}", f"c:{e[1]}" if e[1] else f"s:{e[2]}"}
        assert sorted(r.line for r in touched.collect()) == sorted(e[3] for e in asked if ask(e) & {"c:c:f", "s:k:g", "c:c:x"})
    key = lambda r: (r.line, r.resolved, r.source_post, r.target_pre, r.outcome)
    assert sorted(map(key, slots.relinked(rows, rows).collect()), key=str) == sorted(map(key, linking.obligations(rows.select(F.inline("edges")), rows.select(F.inline("contracts"))).collect()), key=str)
    put(spark, str(tmp_path / "in"), slot)
    out = run(spark, tmp_path)
    last = slots.current_links(spark, out)
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(slot") == 1 + plan.count("BroadcastExchange") and last.count() == len(asked)
    assert spark.conf.get(slots.CLEANUP, "false") == "false"
