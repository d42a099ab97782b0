import json
import subprocess

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from claimloom.functions import bundle, canon, columns, crypto, udfs
from claimloom.functions.formula import atom, const, var
from claimloom.frontends import python_source as py
from claimloom.operators import algebra, claims, diff, gates, graph, linking, pool, ranking
from claimloom.sources import bundles, sinks
from claimloom.streaming import relink


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


CASES = [
    ([("a", "1")], [("a", "1")], (0, 0, 1, 0, "none"), True),
    ([("a", "1")], [("b", "1")], (0, 0, 0, 1, "none"), True),
    ([("a", "1")], [("a", "2")], (1, 1, 0, 0, "MAJOR"), False),
    ([("a", "1")], [("a", "1"), ("b", "2")], (1, 0, 1, 0, "minor"), True),
    ([("a", "1"), ("b", "2")], [("a", "1")], (0, 1, 1, 0, "MAJOR"), False),
    ([], [], (0, 0, 0, 0, "none"), False),
]


@pytest.mark.parametrize("before,after,counts,ok", CASES)
def test_diff(spark, before, after, counts, ok):
    s = diff.summarize(diff.classify(frame(spark, before, "name string, behaviour string"), frame(spark, after, "name string, behaviour string")))
    assert tuple(s.first()) == counts
    assert diff.gate(s).first()["ok"] is ok
    if counts[:2] == (0, 0) and counts[3] == 1:
        assert diff.gate(s, frozen=True).first()["ok"] is False
    assert diff.gate(s, require="major").first()["ok"] is (sum(counts[:4]) > 0)


def test_gate_rejects_unknown_bump(spark):
    with pytest.raises(ValueError):
        diff.gate(spark.range(1), require="huge")


@pytest.mark.parametrize(
    "facts,integer,raw",
    [
        ([("=", 5), ("=", 6)], True, "unsat"), ([("=", 5), ("=", 5)], True, "sat"), ([("=", 5), ("!=", 5)], True, "unsat"), ([(">", 1), ("<", 2)], True, "unsat"),
        ([(">", 1), ("<", 2)], False, "sat"), ([(">=", 1), ("<", 1)], False, "unsat"), ([(">=", 1), ("<=", 2), ("!=", 1), ("!=", 2)], True, "unsat"),
        ([(">=", 1), ("<=", 1), ("!=", 1)], False, "unsat"), ([("call", 1)], True, "undecidable"), ([("call", 1), ("=", 1), ("=", 2)], True, "unsat"), ([("=", 0), (">", 0)], False, "unsat"),
    ],
)
def test_ground_procedure(spark, facts, integer, raw):
    rows = frame(spark, [("g", op, float(v)) for op, v in facts], "claim_group string, op string, value double")
    assert claims.decide(rows, integer).first()["raw"] == raw


def test_columns(spark):
    rows = frame(spark, [("kit:f::facts::1", "cannot read `b`, got x"), ("f:", "Foo: "), (":f", ""), ("f", None)], "s string, r string")
    kit, name = columns.split_symbol(F.col("s"))
    got = rows.select(kit.alias("k"), name.alias("n"), columns.is_setup_binding(F.col("s")).alias("b"), columns.reason_bucket(F.col("r")).alias("r")).collect()
    assert [(r["k"], r["n"], r["b"]) for r in got] == [("kit", "f::facts::1", True), (None, None, False), (None, None, False), (None, None, False)]
    assert [r["r"] for r in got] == ["cannot read", "foo", "", None]


def test_effects(spark):
    none, io = [], ["async"]
    functions = frame(spark, [("query", none, none), ("render", none, none), ("handler", io, none), ("formatter", none, io)], "name string, admitted array<string>, forbidden array<string>")
    sites = frame(spark, [("sql", "query", None), ("rq", "render", "query"), ("hr", "handler", "render"), ("fq", "formatter", "query")], "cid string, containing_fn string, callee string")
    out = graph.propagate_effects(functions, sites, frame(spark, [("sql", "async")], "cid string, effect string"))
    assert {r["name"]: r["decision"] for r in out.collect()} == {"query": "widen", "render": "widen", "handler": "halt", "formatter": "refuse"}


def test_reach_with_cycle(spark):
    edges = frame(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    out = graph.reach(edges, frame(spark, [("a",)], "start string"))
    assert sorted((r["node"], r["depth"]) for r in out.collect()) == [("a", 0), ("b", 1), ("c", 2)]
    pairs = frame(spark, [("a", "a"), ("a", "b"), ("a", "c"), ("a", "y"), ("'static", "q")], "a string, c string")
    assert {(r["a"], r["c"]): r["how"] for r in graph.implies(pairs, edges).collect()} == {("a", "a"): "reflexive", ("a", "b"): "direct", ("a", "c"): "transitive", ("a", "y"): "none", ("'static", "q"): "none"}
    assert {(r["a"], r["c"]) for r in graph.outlives(pairs, edges).filter("holds").collect()} == {("a", "a"), ("a", "b"), ("a", "c"), ("'static", "q")}


def test_reach_over_a_long_chain(spark):
    edges = frame(spark, [(f"n{i}", f"n{i + 1}") for i in range(300)] + [("n300", "n7")], "src string, dst string")
    out = graph.reach(edges, frame(spark, [("n0",), ("n290",)], "start string"))
    got = {(r["start"], r["node"]): r["depth"] for r in out.collect()}
    want = {("n0", f"n{i}"): i for i in range(301)} | {("n290", f"n{i}"): i - 290 if i >= 290 else 11 + i - 7 for i in range(7, 301)}
    assert got == want


def test_unknown_functions_and_call_sites_are_errors(spark):
    functions = frame(spark, [("f", "cf", "sf", None, [], []), ("g", "cg", "sg", "k", [], ["io"]), ("h", "ch", "sh", None, ["io"], [])], "name string, function_cid string, signature_cid string, forbidding_contract_cid string, admitted array<string>, forbidden array<string>")
    sites = frame(spark, [("a", "f", None), ("b", "g", "f"), ("c", "lost", "f"), ("d", "h", "f"), ("e", "f", None)], "cid string, containing_fn string, callee string")
    changed = frame(spark, [("e", "dim", "io", 1), ("a", None, "io", 2), ("gone", None, "io", 3)], "cid string, dimension string, effect string, seq bigint")
    out = {r["name"] or r["trigger"]: (r["decision"], r["trigger"], r["dimension"], r["deciding_cid"]) for r in graph.propagate_effects(functions, sites, changed).collect()}
    assert out == {"f": ("widen", "e", "dim", None), "g": ("refuse", "b", None, "k"), "h": ("halt", None, None, "sh"), "lost": ("unknown-function", "c", None, None), "gone": ("unknown-callsite", "gone", None, None)}


def test_all_rules_are_read(spark, tmp_path):
    (tmp_path / "r.json").write_text("[" + ",".join(f'{{"op":"o{i}","params":["x"],"template":"{{\\"kind\\":\\"var\\"}}"}}' for i in range(10_001)) + "]")
    assert len(bundles.rules(spark, str(tmp_path))) == 10_001


def test_unique_names_of_one_label(spark):
    rows = frame(spark, [("hot", i) for i in range(500)] + [("cold", 1), (None, 1), (None, 2)], "label string, at int")
    out = ranking.unique_names(rows.repartition(7), "label", "at").collect()
    assert sorted(r["unique_name"] for r in out if r["label"] == "hot") == sorted(["hot"] + [f"hot_{i}" for i in range(2, 501)])
    assert {r["at"]: r["unique_name"] for r in out if r["label"] == "hot"}[41] == "hot_42" and [r["unique_name"] for r in out if r["label"] == "cold"] == ["cold"]


def test_pinned_targets(spark):
    sites = frame(spark, [(None, "b"), ("x", "b"), ("c", None), ("c", "no"), ("c", "b2"), ("c", "b")], "target_cid string, pinned_bundle string")
    members = frame(spark, [("b", "c"), ("b2", "d"), ("b", "x")], "bundle_cid string, member_cid string")
    out = linking.pinned(sites, members, frame(spark, [("c",)], "contract_cid string")).collect()
    assert {(r["target_cid"], r["pinned_bundle"]): r["pin"] for r in out} == {(None, "b"): "no-target", ("x", "b"): "not-a-contract", ("c", None): "ok", ("c", "no"): "bundle-absent", ("c", "b2"): "not-a-member", ("c", "b"): "ok"}


def test_annotations_with_an_error(spark):
    rows = frame(spark, [("f", 1, "c", "panic", 2, None), ("f", 1, "c", "io", 1, None), ("g", 2, "c", None, 3, "broken")], "file string, line int, callee string, category string, load_seq int, error string")
    assert [tuple(r) for r in pool.annotations(rows.filter("error is null")).collect()] == [("f", 1, "c", "io", None)]
    assert [tuple(r) for r in pool.annotations(rows).collect()] == [("g", 2, "c", None, "broken")]


def test_lookup_deals_out_null_keys(spark):
    rows = spark.range(400).selectExpr("id", "if(id < 40, concat('k', id), null) as key", "map('a', id) as more")
    right = frame(spark, [("k1", 1), (None, 2)], "key string, found int")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for fixed in (right, right.withColumn("key", F.coalesce("key", F.lit("k2")))):  # a key that cannot be null, too
            out = linking.looked_up(rows, fixed, ["key"]).withColumn("task", F.spark_partition_id()).collect()
            assert len(out) == 400 and {r["id"] for r in out if r["found"] == 1} == {1}
            assert len({r["task"] for r in out if r["key"] is None}) == 4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_linking_is_partition_invariant(spark):
    contracts = frame(spark, [("k", "f", "c:f", "p", None), ("k", "g", "c:g", None, "p")], "kit string, name string, contract_cid string, pre string, post string")
    edges = frame(spark, [("c:g", None, "k:f", 1), ("c:f", None, "k:g", 2), ("c:g", None, "k:no", 3), ("c:g", "c:g", "k:f", 4)], "source_cid string, target_cid string, target_symbol string, line long")
    got = [sorted((r["line"], r["outcome"]) for r in linking.obligations(edges.repartition(n), contracts).collect()) for n in (1, 8)]
    assert got[0] == got[1] == [(1, "equal"), (2, "unprovable-obligation"), (3, "unresolved-symbol"), (4, "vacuous")]


def test_bundles(spark, tmp_path):
    how = {"signer": "s", "declared_at": "2026-01-01T00:00:00.000Z", "seed": b"\x02" * 32}
    minted = [bundle.mint_contract({"name": f"f{i}", "pre": atom("≥", var("x"), const(i))}, **how) for i in range(3)]
    members = frame(spark, [("one" if i < 2 else "two", c, canon.jcs(m, "linker")) for i, (c, m) in enumerate(minted)], "name string, member_cid string, body string")
    made = sinks.build_bundles(members, "s", how["declared_at"], how["seed"])
    root = tmp_path / "proofs" / "sub"
    root.mkdir(parents=True)
    assert sinks.write_files(made, f"file://{root}") == 2
    (tmp_path / "proofs" / ("0" * 128 + ".proof")).write_bytes(b"junk")
    (tmp_path / "proofs" / "short.proof").write_bytes(b"junk")
    rows = bundles.members(bundles.scan(spark, f"file://{tmp_path}/proofs")).collect()
    assert sorted(r["member_cid"] for r in rows if r["error"] is None) == sorted(c for c, _ in minted)
    assert sum(r["error"] is not None for r in rows) == 2
    assert bundles.fingerprints(spark, f"file://{tmp_path}/proofs").count() == 4
    body = frame(spark, [(json.dumps(minted[0][1]),)], "j string")
    assert body.select(columns.member_kind(F.col("j")), columns.contract_name(F.col("j"))).first()[:] == ("contract", "f0")


def test_sidecars_and_ledger(spark, tmp_path):
    (tmp_path / "a.call-edges.json").write_text(json.dumps({"edges": [{"sourceContractCid": "a", "targetSymbol": "k:f"}]}))
    (tmp_path / "b.call-edges.json").write_text("{broken")
    assert [r["target_symbol"] for r in bundles.call_edges(spark, f"file://{tmp_path}").collect()] == ["k:f"]
    (tmp_path / "l.json").write_text(json.dumps({"corpus": "c", "assert_macros": 5, "discharged": 3, "refused": 1, "unaccounted": 1, "source_work": 2}))
    one = bundles.ledger(spark, f"file://{tmp_path}/l.json")
    assert one.first()["source_support"] == 2
    assert diff.residual_gate(one, one).first()["ok"] is False  # a silent drop
    (tmp_path / "c.toml").write_text('[plan]\norder = ["a", "b"]\n[[solvers]]\nname = "a"\n')
    checks = gates.config_checks(bundles.config(spark, f"file://{tmp_path}/c.toml"))
    assert [c["ok"] for c in checks] == [True, True, False]
    (tmp_path / "w.witness").write_bytes(bundle.witness_bundle([b'{"a":1}', b'{"b":2}']))
    assert bundles.witness(spark, f"file://{tmp_path}", crypto.cid(b'{"b":2}')).first()["body"] == '{"b":2}'


def test_udfs(spark):
    f = json.dumps(atom("=", {"kind": "ctor", "name": "g", "args": [var("x")]}, const(1)))
    df = frame(spark, [(f,), (None,), ("{bad",)], "f string")
    got = df.select(udfs.formula_cid("f").alias("c"), udfs.theory("f").alias("t"), udfs.constructors("f").alias("k"), udfs.validity_script("f").alias("s"), udfs.is_closed("f").alias("o")).collect()
    assert got[0]["t"] == "linear-arithmetic" and got[0]["k"] == ["g"] and got[0]["c"].startswith("blake3-512:") and got[0]["o"] is False
    assert got[1] == Row(None, None, None, None, None) and got[2]["c"] is None
    udfs.register(spark)
    assert spark.sql("select claim_cid('') c").first()["c"] == crypto.cid(b"")
    r = udfs.Registry()
    r.admit("a", len, "x")
    r.seal()
    with pytest.raises(ValueError):
        r.admit("b", len, "y")


def test_algebra(spark):
    p, q = atom("p"), atom("q")
    rows = frame(spark, [("1", json.dumps({"kind": "and", "operands": [p, q]}))], "id string, formula string")
    facts = frame(spark, [(canon.formula_cid(p),)], "cid string")
    assert algebra.weaken(rows, facts).first()["left"] == canon.jcs(q)
    assert algebra.verified_parts(rows.withColumnRenamed("id", "formula_id"), facts).count() == 1
    cases = [("a", atom("<", const(1), const(2))), ("b", atom("=", const(1), const(2))), ("c", atom("r", var("x")))]
    out = algebra.run_plan(frame(spark, [(i, json.dumps(f)) for i, f in cases], "id string, formula string"), {"ground": algebra.ground_solver}, ["missing", "ground"])
    assert {r["id"]: r["verdict"] for r in out.collect()} == {"a": "discharged", "b": "unsatisfied", "c": "undecidable"}
    one, two = frame(spark, [("f", json.dumps(p)), ("g", json.dumps(p))], "function string, formula string"), frame(spark, [("f", json.dumps(q))], "function string, formula string")
    assert {r["function"]: r["state"] for r in algebra.marry(one, two).collect()} == {"f": "both", "g": "first-only"}


SOURCE = """
LIMIT = 3
LIMIT2 = 1
LIMIT2 = 2

def half(n: int) -> int:
    if n < 0:
        raise ValueError(n)
    return n // 2 if False else n

@requires(lambda x: x > 0)
def pos(x):
    return x + 1

def test_add():
    assert add(2, 3) == 5
    assert add(2, 3) == 6
    self.assertEqual(half(4), 2)
    assert [x for x in y]
"""


def test_python_lifter(spark):
    rows = py.lift(frame(spark, [("a.py", SOURCE), ("b.py", "def ("), ("c.py", None)], "path string, source string")).collect()
    kinds = {(r["path"], r["producer"], r["kind"]) for r in rows}
    assert ("a.py", "assertions", "claim") in kinds and ("a.py", "assertions", "refusal") in kinds and ("b.py", "pins", "refusal") in kinds
    names = [r["name"] for r in rows if r["producer"] == "assertions" and r["kind"] == "claim"]
    assert names[0] == names[1] and "#euf#" in names[0]
    assert {r["name"]: r["kind"] for r in rows if r["producer"] == "pins" and r["path"] == "a.py"} == {"LIMIT": "pin", "LIMIT2": "refusal"}
    pre = json.loads(next(r["value"] for r in rows if r["producer"] == "contracts" and r["kind"] == "contract" and r["name"] == "half"))["pre"]
    assert pre["kind"] == "not"


def test_emitters():
    p = {"name": "concept:eq", "args": [var("a"), {"kind": "ctor", "name": "+", "args": [const(1), const(2)]}]}
    assert py.render(p) == "assert a == (1 + 2)" and py.render(p, py.UNITTEST) == "self.assertEqual(a, (1 + 2))"
    assert py.render({"name": "nope", "args": []}) is None and py.render({"name": "eq", "args": [var("a")]}) is None
    assert "@given(a=st.integers())" in py.property_test("p", {"a": "Int"}, {"name": "ge", "args": [var("a"), const(0)]})
    assert py.recognise("def f(q):\n    return q + 1\n", {"inc": "def t(x):\n    return x + 1\n"})[0]["name"] == "f"


def test_stream_equals_batch(spark, tmp_path):
    contracts = frame(spark, [("k", "f", "c:f", "p", None), ("k", "g", "c:g", None, "p")], "kit string, name string, contract_cid string, pre string, post string")
    edge = "array<struct<source_cid:string,target_cid:string,target_symbol:string,line:bigint>>"
    rows = [("k", "a", 1, [("c:g", None, "k:f", 1)]), ("k", "b", 1, [("c:g", None, "k:no", 2)]), ("k", "b", 2, [("c:g", None, "k:g", 3)])]
    slots = frame(spark, rows, f"kit string, file string, version long, edges {edge}")
    for i in range(3):
        slots.filter(F.col("version") * 10 + F.ascii("file") == [107, 108, 118][i]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(slots.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = relink.start(stream, contracts, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out" / "links").iterdir())
    got = sorted((r["line"], r["outcome"]) for r in spark.read.parquet(str(tmp_path / f"out/links/batch={last}")).collect())
    assert got == sorted((r["line"], r["outcome"]) for r in relink.relink(slots, contracts).collect()) == [(1, "equal"), (3, "vacuous")]


def test_gates(spark):
    rows = frame(spark, [("exact", "w", None, None), ("exact", None, None, None), ("lossy", None, "l", None), ("gap", None, None, "g"), ("odd", None, None, None)], "verdict string, witness string, loss string, gap string")
    assert {r["outcome"]: r["n"] for r in gates.claim_report(rows).collect()} == {"exact": 1, "lossy": 1, "gap": 1, "invalid": 2}
    assert gates.release({"a": [("x", True)]})["ok"] and not gates.release({})["ok"]
    assert gates.rewriting_gate([], False) == "accepted" and gates.rewriting_gate([{}], False) == "rejected"


def test_assertion_site_ignores_space_outside_literals(spark):
    rows = [("assert_eq", "a+b,  c"), ("assert_eq", "a + b,\n c"), ("assert_eq", "ab, c"), ("assert", "a+b, c"), ("assert_eq", 'f("a b")'), ("assert_eq", 'f( "a  b" )'), ("assert_eq", None), ("assert_eq", "")]
    got = [r[0] for r in spark.createDataFrame(rows, "p string, a string").select(columns.assertion_site(F.col("p"), F.col("a"))).collect()]
    assert got[0] == got[1] == "assert_eq!(a + b , c)"
    assert len(set(got)) == 7 and got[6] is None and got[7] == "assert_eq!()"


def test_rerun_discharge(spark):
    pins = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"), (None, "5"), ("e", None)], "suite string, pinned string")
    runs = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "3"), ("e", "6"), (None, "5")], "suite string, cid string")
    outcomes = spark.createDataFrame([("a", "t1", "passed"), ("c", "t2", "failed"), ("c", "t1", None), ("b", "t1", "failed")], "suite string, test string, outcome string")
    got = {r["suite"]: (r["verdict"], r["reason"], r["n_tests"], r["n_failed"], r["first_failed"]) for r in pool.rerun_discharge(pins, runs, outcomes).collect()}
    assert got["a"] == ("discharged", "reproduced", 1, 0, None)
    assert got["b"] == ("refused", "not-reproduced", 1, 1, "t1")
    assert got["c"] == ("refused", "failed-outcomes", 2, 2, "t1")
    assert got["d"][1] == got[None][1] == "not-run" and got["e"][1] == "not-reproduced"


def test_checked_composition(spark):
    x, r = {"kind": "var", "name": "x"}, {"kind": "var", "name": "result"}
    seven = {"kind": "const", "value": 7}
    less = lambda a: {"kind": "atomic", "name": "<", "args": [a, {"kind": "const", "value": 9}]}
    plain = {"formals": ["x"], "pre": less(x), "effects": []}
    inner = lambda *effects, **more: {"cid": "i", "formals": ["y"], "post": {"kind": "atomic", "name": "=", "args": [r, seven]}, "effects": list(effects)} | more
    e = lambda kind, key="q", **more: {"kind": kind, "key": key} | more
    alias = e("possible_aliasing", None, formals=["a", "b", "c"])
    covered = [{"a": "b", "b": "a"}, {"a": "a", "b": "c"}, {"a": "c", "b": "b"}]
    cases = {
        "plain": (plain, inner(), 0, None),
        "done": (plain, inner(e("opaque_loop", "k")), 0, None),
        "other kind": (plain, inner(e("early_return", "k")), 0, "early_return"),
        **{k: (plain, inner(e(k)), 0, k) for k in ("opaque_loop", "early_return", "closure_capture", "drop", "unresolved_call", "pinned_reference")},
        "discharged call": (plain, inner(e("unresolved_call", "k")), 0, "unresolved_call"),
        "keyless": (plain, inner({"kind": "opaque_loop"}), 0, "opaque_loop"),
        "pin": (plain, inner(e("pinned_reference", "p")), 0, None),
        "pin of another": (plain, inner(e("pinned_reference", "p"), cid="j"), 0, "pinned_reference"),
        "pin of nobody": (plain, inner(e("pinned_reference", "p"), cid=""), 0, "pinned_reference"),
        "aliasing": (plain, inner(alias, covered=covered[:2]), 0, "possible_aliasing"),
        "aliasing covered": (plain, inner(alias, covered=covered), 0, None),
        "aliasing of one": (plain, inner(e("possible_aliasing", None, formals=["a"])), 0, None),
        "outer first": ({**plain, "effects": [alias, e("drop", "d")]}, inner(e("opaque_loop")), 0, "drop"),
        "inner before aliasing": ({**plain, "effects": [alias]}, inner(e("opaque_loop")), 0, "opaque_loop"),
    }
    refused = {"io": (plain, inner(e("io")), 0, "impure"), "raw": (plain, inner(e("raw_pointer_provenance")), 0, "impure"), "formal": (plain, inner(), 1, "no-formal"), "result": (plain, inner(post=less(r)), 0, "no-result")}
    rows = [(i, json.dumps(o), json.dumps(c), n) for i, (o, c, n, _) in (cases | refused).items()]
    pairs = spark.createDataFrame(rows, "id string, outer string, inner string, formal int")
    done = spark.createDataFrame([("opaque_loop", "k", None), ("opaque_loop", "k", "i"), ("unresolved_call", "k", None), ("pinned_reference", "p", "i"), ("pinned_reference", "p", ""), ("drop", None, None)], "kind string, key string, function_cid string")
    got = {i: json.loads(c) for i, c in algebra.compose_checked(pairs, done).collect()}
    assert got["plain"] == got["done"] and got["plain"]["formals"] == ["y"] and json.dumps(less(seven), sort_keys=True) in json.dumps(got["plain"]["pre"], sort_keys=True)
    for i, (_, _, _, kind) in cases.items():
        assert (got[i].get("refused"), got[i].get("kind")) == (("opaque", kind) if kind else (None, None)), i
    assert {i: got[i].get("refused") for i in refused} == {i: why for i, (*_, why) in refused.items()}
    assert got["aliasing"]["key"] == "b/c"


def test_attribute_safety_asks_for_this_receiver(spark):
    term = lambda r, a: json.dumps({"args": [{"kind": "var", "name": r}, {"kind": "const", "value": a}], "kind": "ctor", "name": "python:attribute"}, separators=(",", ":"))
    fact = lambda r, a: json.dumps({"args": [{"kind": "var", "name": r}, {"kind": "const", "sort": {"kind": "primitive", "name": "String"}, "value": a}], "kind": "atomic", "name": "attribute_present"}, separators=(",", ":"))
    sites = [
        ("own", "C", "x", term("r", "x"), [fact("q", "x"), fact("r", "x")]), ("other receiver", "C", "x", term("r", "x"), [fact("q", "x")]), ("other attribute", "C", "x", term("r", "y"), [fact("r", "x")]), ("no term", "C", "x", None, [fact("r", "x")]),
        ("no class", None, "x", term("r", "x"), [fact("r", "x")]), ("no name", "C", "", term("r", ""), []), ("shape", "C", "s", term("r", "s"), None), ("open shape", "O", "s", term("r", "s"), []), ("unknown", "U", "s", term("r", "s"), []),
    ]
    shapes = spark.createDataFrame([("C", "s", True), ("O", "s", False)], "class_name string, attribute string, closed boolean")
    got = {r["site"]: (r["reason"], r["status"]) for r in pool.attribute_safety(spark.createDataFrame(sites, "site string, receiver_class string, attribute string, arg_term string, guards array<string>"), shapes).collect()}
    open_ = lambda why: (why, "undecidable")
    assert got == {"own": ("guarded", "discharged"), "other receiver": open_("not-guaranteed"), "other attribute": open_("malformed"), "no term": open_("malformed"), "no class": open_("unknown-class"), "no name": open_("no-attribute"),
                   "shape": ("guaranteed", "discharged"), "open shape": open_("no-shape"), "unknown": open_("no-shape")}


def test_report_of_nothing_is_vacuous_and_fails(spark):
    none = spark.createDataFrame([], "name string, behaviour string")
    text = diff.report_markdown(diff.gate(diff.summarize(diff.classify(none, none)), frozen=True), frozen=True).first()[0]
    assert text.startswith("### Claim diff: FAIL") and "frozen" in text and "vacuous" in text
    claims = spark.createDataFrame([], "status string, method string, obligation_class string")
    assert not sinks.verification_receipt(claims, spark.createDataFrame([], "result string")).first()["ok"]


def test_git_revision(spark, tmp_path):
    repo = tmp_path / "repo"
    (repo / "sub").mkdir(parents=True)
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True)
    git("init", "-q")
    for n, text in enumerate(("first", "second")):
        (repo / "sub" / "a.proof").write_text(text)
        (repo / "b.proof").write_text("same")
        (repo / f"other{n}.txt").write_text("x")
        git("add", "-A")
        git("commit", "-q", "-m", text)
    (repo / "sub" / "a.proof").write_text("not committed")
    read = lambda *a: sorted((r["stem"], bytes(r["content"])) for r in bundles.git_revision(spark, str(repo), a[0], f"file://{tmp_path}/out", *a[1:]).collect())
    assert read("HEAD~1") == [("a", b"first"), ("b", b"same")]
    assert read("HEAD") == read("HEAD", ".") == [("a", b"second"), ("b", b"same")]
    assert read("HEAD", "sub") == [("a", b"second")]
    assert read("HEAD", "", "*.none") == []
    for bad in ("--output=x", "HEAD:sub", "missing"):
        with pytest.raises(ValueError):
            read(bad)
    with pytest.raises(ValueError):
        read("HEAD", "missing")
