"""Body obligations and facts of callees."""

import json

from pyspark.sql import functions as F

from claimloom.functions.formula import atom, const, var
from claimloom.operators import bodies

X, Y = var("x"), var("y")


def app(name, *args):
    return {"kind": "ctor", "name": name, "args": list(args)}


def body(op, formals, value, pre=None):
    return (op, formals, json.dumps(atom("=", var("result"), value)), json.dumps(pre) if pre else None)


BODIES = [
    body("double", ["x"], app("*", X, const(2))),
    body("inc", ["x"], app("+", X, const(1))),
    body("inc2", ["x"], app("inc", app("inc", X))),
    body("inc3", ["y"], app("inc2", app("inc", Y))),
    body("swap", ["x", "y"], app("-", Y, X)),
    body("loop", ["x"], app("loop", X)),
    body("even", ["x"], app("odd", X)),
    body("odd", ["x"], app("even", X)),
    body("twice", ["x"], app("inc", X)),
    body("partial", ["x"], X, atom("<", const(0), X)),
    body("total", ["x"], X, atom("true")),
    body("binder", ["x"], app("g", {"kind": "lambda", "paramName": "y", "body": app("+", X, Y)})),
    ("vague", ["x"], json.dumps(atom("<", var("result"), X)), None),
]
CASES = {
    "direct": (atom("=", app("double", const(3)), const(6)), "body-call-expected", None, "discharged"),
    "wrong": (atom("=", app("double", const(3)), const(7)), "body-call-expected", None, "unsatisfied"),
    "three deep": (atom("=", app("inc3", Y), app("+", Y, const(3))), "body-call-expected", None, "discharged"),
    "three deep, wrong": (atom("=", app("inc3", Y), app("+", Y, const(4))), "body-call-expected", None, "unsatisfied"),
    "formals at once": (atom("=", app("swap", Y, X), app("-", X, Y)), "body-call-expected", None, "discharged"),
    "recursive": (atom("=", app("loop", const(1)), const(1)), "body-call-expected", "recursive", "refused"),
    "mutual": (atom("=", app("even", const(1)), const(1)), "body-call-expected", "recursive", "refused"),
    "nested in its own argument": (atom("=", app("inc", app("inc", const(1))), const(3)), "body-call-expected", None, "discharged"),
    "same callee": (atom("=", app("double", X), app("double", X)), "body-eq-same-callee", None, "discharged"),
    "same callee, other argument": (atom("=", app("double", const(3)), app("double", const(4))), "body-eq-same-callee", None, "unsatisfied"),
    "nested": (atom("=", app("Ok", app("inc", X)), app("Ok", app("+", X, const(1)))), "body-eq-nested-call", None, "discharged"),
    "nested, wrong": (atom("=", app("Ok", app("inc", X)), app("Err", X)), "body-eq-nested-call", None, "unsatisfied"),
    "nested partial": (atom("=", app("Ok", app("partial", X)), app("Ok", X)), "body-eq-nested-call", "pre-bearing", "refused"),
    "total": (atom("=", app("total", X), X), "body-call-expected", None, "discharged"),
    "shape": (atom("<", app("inc", X), const(9)), None, "shape", "refused"),
    "no body": (atom("=", app("other", X), X), None, "not-body-bearing", "open"),
    "no value": (atom("=", app("vague", X), X), "body-call-expected", "no-value", "refused"),
    "arity": (atom("=", app("inc", X, Y), X), "body-call-expected", "arity", "refused"),
    "no capture": (atom("=", app("binder", Y), app("g", {"kind": "lambda", "paramName": "y", "body": app("+", Y, Y)})), "body-call-expected", None, "undecidable"),
}


def test_body_obligations(spark):
    schema = "op string, formals array<string>, post string, pre string"
    rows = [(n, json.dumps(f)) for n, (f, *_) in CASES.items()] + [("text", "ok"), ("null", None)]
    got = {r.id: r for r in bodies.body_obligations(spark.createDataFrame(rows, "id string, formula string"), spark.createDataFrame(BODIES, schema)).collect()}
    assert len(got) == len(rows)
    for n, (_, tier, reason, status) in CASES.items():
        assert (got[n].tier, got[n].reason, got[n].status) == (tier, reason, status), n
    assert got["same callee"].method == "reflexive" and got["total"].method == "reflexive" and got["direct"].method == got["three deep"].method == "solver-substantive"
    assert got["text"].status in ("open", "refused") and got["null"].status is None


def test_no_obligations(spark):
    none = spark.createDataFrame([], "id string, formula string")
    assert bodies.body_obligations(none, spark.createDataFrame(BODIES, "op string, formals array<string>, post string, pre string")).collect() == []


def test_post_facts(spark):
    call = json.dumps(app("to_string", X))
    one, two = json.dumps(atom("is_ok", var("result"))), json.dumps({"kind": "or", "operands": [atom("is_ok", var("result")), atom("is_err", var("result"))]})
    schema = "site string, arg_term string, panic_site boolean, bundle_cid string, file string, line bigint, producer_file string, producer_line bigint, producer_symbol string"
    sites = [
        ("plain", call, False, "b", "f", 1, None, None, None),
        ("variable", json.dumps(X), False, "b", "f", 1, None, None, None),
        ("nothing", None, False, "b", "f", 1, None, None, None),
        ("panic here", call, True, "b", "f", 25, None, None, None),
        ("panic elsewhere", call, True, "b", "f", 38, None, None, None),
        ("panic, producer named", call, True, "b", "f", 38, "f", 25, "to_string"),
        ("panic, other producer", call, True, "b", "f", 38, "f", 25, "parse"),
        ("no bridge", json.dumps(app("unknown", X)), False, "b", "f", 1, None, None, None),
        ("not single", json.dumps(app("loose", X)), False, "b", "f", 1, None, None, None),
    ]
    by_symbol = spark.createDataFrame([("to_string", "c1"), ("loose", "c2")], "symbol string, target string")
    by_site = spark.createDataFrame([("b", "f", 25, "to_string", "c1")], "bundle_cid string, file string, line bigint, symbol string, target string")
    contracts = spark.createDataFrame([("c1", one), ("c2", two)], "contract_cid string, post string")
    got = {r.site: r for r in bodies.post_facts(spark.createDataFrame(sites, schema), by_symbol, by_site, contracts).collect()}
    assert {n: r.why for n, r in got.items()} == {
        "plain": None, "variable": "no-call", "nothing": "no-call", "panic here": None, "panic elsewhere": "no-bridge", "panic, producer named": None, "panic, other producer": "other-producer",
        "no bridge": "no-bridge", "not single": "not-single",
    }
    assert json.loads(got["plain"].fact) == atom("is_ok", app("to_string", X))


def test_formulas_that_come_to_the_same_are_decided_once(spark, monkeypatch):
    j = lambda name, *args: '{"kind":"ctor","name":"%s","args":[%s]}' % (name, ",".join(args))
    equal = lambda a, b: '{"kind":"atomic","name":"=","args":[%s,%s]}' % (a, b)
    number = lambda n: '{"kind":"const","value":%d}' % n
    known = [(f"f{i}", ["x"], equal('{"kind":"var","name":"result"}', j("+", '{"kind":"var","name":"x"}', number(i))), None) for i in range(6)]
    asked = [(f"a{i}", equal(j(f"f{i}", number(9 - i)), number(9))) for i in range(6)] + [("b", equal(j("f1", number(1)), number(9))), ("c", None)]
    decided, implications = [], bodies.decide.implications
    monkeypatch.setattr(bodies.decide, "implications", lambda pairs: (decided.append(pairs.count()), implications(pairs))[1])
    made = bodies.body_obligations(spark.createDataFrame(asked, "id string, formula string"), spark.createDataFrame(known, "op string, formals array<string>, post string, pre string"))
    got = {r["id"]: r["status"] for r in made.collect()}
    assert decided == [2]
    assert got == {f"a{i}": "discharged" for i in range(6)} | {"b": "unsatisfied", "c": None}


def test_bodies_are_followed_once_and_calls_of_equal_fate_are_one(spark, monkeypatch):
    n = 40
    value = lambda i: app("+", app(f"f{i - 1}", X) if i % 4 else X, const(1))
    known = [*BODIES, *[body(f"f{i}", ["x"], value(i)) for i in range(n)], body("late", ["x"], app("partial", X)), body("later", ["x"], app("late", X)), body("drop", ["x", "y"], X), ("torn", ["x"], "{", None), body("rips", ["x"], app("torn", X))]
    asked = {f"a{i}": atom("=", app(f"f{i}", const(5)), const(5 + i % 4 + 1)) for i in range(n)}
    asked |= {n: f for n, (f, *_) in CASES.items()}
    one = lambda *calls: atom("=", app("Ok", *calls), const(1))
    asked |= {
        "late": one(app("late", X)), "two late": one(app("later", X), app("late", X)), "late and recursive": one(app("even", X), app("later", X)), "at once first": one(app("later", X), app("vague", X)), "arity first": one(app("later", X, X)),
        "dropped": one(app("drop", X, app("late", X))), "dropped at once": one(app("drop", X, app("partial", X))), "torn": one(app("torn", X)), "torn later": one(app("rips", X), app("inc", X)), "two names": atom("=", app("inc", X), app("twice", X)), "variable of a call's name": atom("=", app("inc", var("twice")), app("+", var("twice"), const(1))),
        "float": one(app("inc", const(1.5))), "binder and call": one(app("binder", app("inc", Y))),
    }
    schema = "op string, formals array<string>, post string, pre string"
    rows = spark.createDataFrame([(i, json.dumps(f)) for i, f in asked.items()] + [("text", "ok"), ("none", None), ("list", "[1]")], "id string, formula string")
    contracts = spark.createDataFrame(known, schema)
    best = contracts.groupBy("op").agg(F.min(F.struct("formals", "post", "pre")).alias("b")).select("op", F.struct("op", "b.formals", "b.post", "b.pre").alias("body"))
    plain = bodies.reduce(lambda a, b: a.unionByName(b), bodies._levels(rows, best)).mapInPandas(bodies._ended, "id string, tier string, reason string, reduced string, method string")
    levels, followed = bodies._levels, []
    monkeypatch.setattr(bodies, "_levels", lambda active, one: (followed.append({r.id for r in active.collect()}), levels(active, one))[1])
    got = bodies.reduced(rows, contracts)
    columns = sorted(plain.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, (tuple(r[c] for c in columns) for r in plain.collect())))
    assert followed[0] == {k[0] for k in known} and not any(i.startswith("a") and i[1:].isdigit() for i in followed[1])


def test_formulas_travel_as_numbers(spark, monkeypatch):
    """One table at most holds a row with text for each formula: what goes to bodies and back is numbers."""
    keep, wide = bodies.kept, []

    def kept(df):
        out = keep(df)
        if {"template", "formula"} & set(out.columns) and out.count() >= 60:
            wide.append(out.columns)
        return out

    monkeypatch.setattr(bodies, "kept", kept)
    call = '{"kind":"atomic","name":"=","args":[{"kind":"ctor","name":"b%d","args":[{"kind":"var","name":"x"}]},{"kind":"const","value":1}]}'
    rows = spark.createDataFrame([(str(i), call % (i % 40)) for i in range(60)], "id string, formula string")
    known = spark.createDataFrame([body(f"b{i}", ["x"], X) for i in range(30)], "op string, formals array<string>, post string, pre string")
    got = {r.id: (r.reason, r.reduced is not None) for r in bodies.reduced(rows, known).collect()}
    assert got == {str(i): (None, True) if i % 40 < 30 else ("not-body-bearing", False) for i in range(60)}
    assert len(wide) <= 1
