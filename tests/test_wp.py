"""Weakest preconditions over terms as rows."""

import json

from claimloom.functions.canon import jcs
from claimloom.functions.formula import atom, const, var
from claimloom.operators import wp

A, B, X, R = map(var, ("a", "b", "x", "result"))


def app(name, *args):
    return {"kind": "ctor", "name": name, "args": list(args)}


def rows_of(term, tree):
    """Nodes of a term, without recursion."""
    out, stack, n = [], [(tree, None, 0, 0)], 0
    while stack:
        t, parent, pos, depth = stack.pop()
        me, n = n, n + 1
        out.append((term, me, parent, pos, depth, t["name"] if t["kind"] == "ctor" else None, None if t["kind"] == "ctor" else jcs(t)))
        if t["kind"] == "ctor":
            stack += [(a, me, i, depth + 1) for i, a in enumerate(t["args"])]
    return out


NODES = "term string, node int, parent int, pos int, depth int, name string, text string"
CONTRACTS = "op string, slots array<string>, pre string, post string, unresolved_call string, opaque_loop string"


def contract(op, slots, value=None, pre=None, call=None, loop=None, post=None):
    post = atom("=", R, value) if value else post
    return (op, slots, json.dumps(pre) if pre else None, json.dumps(post) if post else None, call, loop)


KNOWN = [
    contract("add", ["a", "b"], app("+", A, B)), contract("sub", ["a", "b"], app("-", B, A)), contract("inc", ["a"], app("+", A, const(1)), atom("<", A, const(9))),
    contract("bound", ["a"], post=atom("<", R, A)), contract("lost", ["a"], call="elsewhere"), contract("loop", ["a"], app("+", A, A), loop="l"), contract("bare", ["a"]),
    contract("lambda", ["a"], app("g", {"kind": "lambda", "paramName": "x", "body": app("+", A, X)})),
]
Q = atom("<", R, const(5))
CASES = {
    "variable": (X, atom("<", X, const(5)), None),
    "slots at once": (app("sub", B, A), atom("<", app("-", A, B), const(5)), None),
    "nested": (app("add", app("add", X, const(1)), app("sub", A, B)), atom("<", app("+", app("+", X, const(1)), app("-", B, A)), const(5)), None),
    "root's precondition": (app("inc", app("inc", X)), {"kind": "and", "operands": [atom("<", app("+", X, const(1)), const(9)), atom("<", app("+", app("+", X, const(1)), const(1)), const(5))]}, None),
    "constructor inside": (app("add", app("Ok", X), app("bound", A)), atom("<", app("+", app("Ok", X), app("bound", A)), const(5)), None),
    "root without contract": (app("Ok", X), None, "opaque-call"),
    "unresolved inside": (app("add", app("lost", X), X), None, "opaque-call"),
    "loop at the root": (app("loop", X), None, "opaque-loop"),
    "loop inside": (app("add", app("loop", X), X), atom("<", app("+", app("+", X, X), X), const(5)), None),
    "arity": (app("add", X), None, "arity"),
    "arity inside": (app("Some", app("add", X)), None, "opaque-call"),
    "arity inside of a known": (app("inc", app("add", X)), None, "arity"),
    "no rule": (app("bare", X), None, "no-rule"),
    "binder": (app("lambda", X), None, "binder"),
}


def test_weakest_preconditions(spark):
    nodes = spark.createDataFrame([r for n, (t, _, _) in CASES.items() for r in rows_of(n, t)], NODES)
    evidence = [(n, json.dumps(Q), n, i) for i, n in enumerate(CASES)]
    all_x = {"kind": "forall", "name": "y", "sort": {"kind": "primitive", "name": "Int"}, "body": Q}
    evidence += [("variable", json.dumps(all_x), "quantified", 90), ("missing", json.dumps(Q), "missing", 91), ("nested", json.dumps(atom("true")), "says nothing", 92)]
    got = {r.compound: r for r in wp.compound(nodes, spark.createDataFrame(KNOWN, CONTRACTS), spark.createDataFrame(evidence, "term string, predicate string, compound string, k int")).collect()}
    for n, (_, want, why) in CASES.items():
        assert (got[n].wp, got[n].why) == (jcs(want) if want else None, why), n
        assert got[n].verdict == ("lossy" if want else "error" if why in ("arity", "no-rule") else "refuse")
    assert (got["quantified"].why, got["missing"].why) == ("binder", "no-term")
    assert got["says nothing"].verdict == "exact" and len(got) == len(evidence)


def test_deep_terms(spark):
    deep, want = X, X
    for i in range(12):
        deep, want = app("add", deep, const(i)), app("+", want, const(i))
    nodes = spark.createDataFrame(rows_of("t", deep), NODES)
    [r] = wp.weakest(nodes, spark.createDataFrame(KNOWN, CONTRACTS), spark.createDataFrame([("t", json.dumps(Q))], "term string, predicate string")).collect()
    assert r.wp == jcs(atom("<", want, const(5)))


def test_no_terms(spark):
    none = spark.createDataFrame([], NODES)
    assert wp.weakest(none, spark.createDataFrame(KNOWN, CONTRACTS), spark.createDataFrame([], "term string, predicate string")).collect() == []
