"""Batched BLAKE3 and the ids of sets as a tree."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from claimloom.functions import batch, canon, crypto
from claimloom.operators import sets


def test_batched_digests_are_the_digests():
    rng = random.Random(1)
    values = [rng.randbytes(n) for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 3072, 5 * 1024, 7 * 1024 + 3, 9000, 31744)]
    assert batch.digests(values) == [crypto.blake3(v, 64) for v in values]
    assert batch.digests([]) == []
    # published vector: input of the bytes 0, 1, ... 250, 0, ...
    data = bytes(i % 251 for i in range(2049))
    assert batch.digests([data])[0].hex().startswith("5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b68795")


def test_set_ids_are_the_exact_ids(spark, monkeypatch):
    monkeypatch.setattr(sets, "FAN", 4)
    rng = random.Random(2)
    members = [("big", f"blake3-512:{rng.randrange(10**12):0128x}") for _ in range(900)] + [("twice", "x"), ("twice", "x"), ("one", "é\"\\\n\x01\U0001f600"), ("empty text", ""), (None, "n"), ("long", "y" * 5000), ("long", "z" * 3000)]
    members += [(f"g{i % 40}", f"m{i}") for i in range(400)] + [("nothing", None)]
    df = spark.createDataFrame(members, "g string, m string").repartition(9)
    got = {r.g: r for r in sets.set_ids(df, ["g"], "m").collect()}
    want = defaultdict(list)
    for g, m in members:
        if m is not None:
            want[g].append(m)
    assert set(got) == set(want)
    for g, ms in want.items():
        assert (got[g].set_cid, got[g].n, got[g].n_distinct) == (canon.set_cid(ms), len(ms), len(set(ms))), g
    strict = {r.g: r.set_cid for r in sets.set_ids(df.filter("g in ('twice', 'one')"), ["g"], "m", distinct=True).collect()}
    assert strict == {"twice": None, "one": canon.set_cid([members[902][1]])}
    assert sets.set_ids(df.filter("false"), ["g"], "m").collect() == []


def test_one_set_of_a_whole_table(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("m"))
    [r] = sets.set_ids(df, [], "m").collect()
    assert r.set_cid == canon.set_cid([str(i) for i in range(3000)])
    [t] = sets.tree_ids(df, [], F.col("m"), F.col("m"), "", "\n", "").collect()
    assert t.cid == crypto.cid("\n".join(sorted(str(i) for i in range(3000))))
