"""Claims at call sites through all tiers."""

import json

from claimloom.functions.formula import atom, const, var
from claimloom.operators import verify

X, Y = var("x"), var("y")
SITE = "id string, target_cid string, assertion string, guards array<string>, args array<string>, actuals map<string,string>, receiver_class string, attribute string, arg_term string"
CONTRACT = "contract_cid string, op string, formals array<string>, pre string, post string"


def app(name, *args):
    return {"kind": "ctor", "name": name, "args": list(args)}


def j(f):
    return json.dumps(f) if f is not None else None


def site(i, target=None, assertion=None, guards=None, args=None, actuals=None):
    return (i, target, j(assertion), guards and [j(g) for g in guards], args and [j(a) for a in args], actuals and {k: j(a) for k, a in actuals.items()}, None, None, None)


def attribute(i, cls, name):
    term = {"args": [var("r"), {"kind": "const", "sort": {"kind": "primitive", "name": "String"}, "value": name}], "kind": "ctor", "name": "python:attribute"}
    return (i, "c:none", None, None, None, None, cls, name, json.dumps(term, separators=(",", ":")))


CONTRACTS = [
    ("c:none", "plain", None, None, None),
    ("c:true", "plain2", None, j(atom("true")), None),
    ("c:double", "double", ["x"], None, j(atom("=", var("result"), app("*", X, const(2))))),
    ("c:inc", "inc", ["x"], None, j(atom("=", var("result"), app("+", X, const(1))))),
    ("c:loop", "loop", ["x"], None, j(atom("=", var("result"), app("loop", X)))),
    ("c:some", "unwrap", ["x"], j(atom("is_some", X)), j(atom("=", var("result"), app("val", X)))),
    ("c:pos", "log", ["x"], j(atom("<", const(0), X)), None),
    ("c:less", "less", ["x", "y"], j(atom("<", X, Y)), None),
    ("c:bad", "bad", ["x"], "{", None),
]
R, S = var("r"), var("s")
CASES = {
    "attribute": (attribute("", "C", "a"), "attribute-safety", "discharged", "attribute-safe"),
    "attribute lost": (attribute("", "C", "b"), "attribute-safety", "undecidable", None),
    "no target": (site("", "c:gone"), "unresolved-target", "undecidable", None),
    "null target": (site(""), "unresolved-target", "undecidable", None),
    "vacuous": (site("", "c:none"), "vacuous", "discharged", None),
    "true is nothing": (site("", "c:true", args=[X]), "vacuous", "discharged", None),
    "guarded": (site("", "c:some", guards=[atom("is_some", R)], args=[R]), "guarded", "discharged", "panic-safe"),
    "guard of another": (site("", "c:some", guards=[atom("is_some", S)], args=[R]), "guarded", "undecidable", None),
    "guard denied": (site("", "c:some", guards=[atom("is_none", R)], args=[R]), "guarded", "undecidable", None),
    "unguarded": (site("", "c:some", args=[R]), "unguarded", "undecidable", None),
    "pre before body": (site("", "c:some", atom("=", app("unwrap", R), app("unwrap", R)), args=[R]), "unguarded", "undecidable", None),
    "number": (site("", "c:pos", args=[const(3)]), "unguarded", "discharged", "solver-substantive"),
    "number refuted": (site("", "c:pos", args=[const(0)]), "unguarded", "unsatisfied", None),
    "bounds": (site("", "c:pos", guards=[atom("<", const(4), R)], args=[R]), "guarded", "discharged", "panic-safe"),
    "two actuals": (site("", "c:less", guards=[atom("<", Y, X)], actuals={"x": Y, "y": X}), "guarded", "discharged", "panic-safe"),
    "two formals unnamed": (site("", "c:less", args=[X, Y]), "instantiate-refused", "undecidable", None),
    "no formula": (site("", "c:bad", args=[X]), "instantiate-refused", "undecidable", None),
    "body": (site("", "c:double", atom("=", app("double", const(3)), const(6))), "body-solver", "discharged", "solver-substantive"),
    "body refuted": (site("", "c:double", atom("=", app("double", const(3)), const(7))), "body-solver", "unsatisfied", None),
    "body alike": (site("", "c:inc", atom("=", app("inc", Y), app("inc", Y))), "body-reflexive", "discharged", "reflexive"),
    "body recursive": (site("", "c:loop", atom("=", app("loop", const(1)), const(1))), "body-refused", "undecidable", None),
    "body unread": (site("", "c:inc", atom("=", app("other", X), X)), "body-bearing-refused", "undecidable", None),
}


def frames(spark):
    rows = [(name, *case[0][1:]) for name, case in CASES.items()]
    return spark.createDataFrame(rows, SITE), spark.createDataFrame(CONTRACTS, CONTRACT), spark.createDataFrame([("C", "a")], "class_name string, attribute string")


def test_every_tier(spark):
    sites, contracts, shapes = frames(spark)
    rows = verify.verify_claims(sites, contracts, shapes).collect()
    assert len(rows) == len(CASES)
    got = {r.id: (r.tier, r.verdict, r.method) for r in rows}
    assert got == {n: c[1:] for n, c in CASES.items()}
    assert {r.tier for r in rows} == set(verify.TIERS)
    by = {r.id: r for r in rows}
    assert by["vacuous"].obligation_class == "vacuous" and by["number"].obligation_class == "linear-arithmetic"
    assert by["body"].body_tier == "body-call-expected" and by["body recursive"].reason == "body-discharge: recursive"
    assert by["number"].solver == "difference" and by["unguarded"].solver == "<none>"


def test_routes_and_solvers_that_are_not_there(spark, monkeypatch):
    sites, contracts, shapes = frames(spark)
    few = sites.filter("id in ('number', 'number refuted', 'guarded', 'vacuous')")

    def never(_):
        raise AssertionError("nothing was routed here")

    monkeypatch.setattr(verify.decide, "implications", never)
    got = {r.id: (r.verdict, r.routed_solver, r.reason) for r in verify.verify_claims(few, contracts, shapes, {"linear-arithmetic": "ground", "default": "z"}).collect()}
    assert got["number"][:2] == ("discharged", "ground") and got["number refuted"][:2] == ("unsatisfied", "ground")
    assert got["guarded"] == ("undecidable", "z", "no solver z") and got["vacuous"][0] == "discharged"


def test_no_sites(spark):
    _, contracts, shapes = frames(spark)
    assert verify.verify_claims(spark.createDataFrame([], SITE), contracts, shapes).collect() == []
