import json

import pytest

from claimloom.functions import bundle, canon, cbor, crypto, formula, smt
from claimloom.functions.formula import atom, const, var

# Published vectors: canonical text and content id.
EQ = '{"args":[{"args":[{"kind":"const","sort":{"kind":"primitive","name":"String"},"value":"42"}],"kind":"ctor","name":"parse_int"},{"kind":"const","sort":{"kind":"primitive","name":"Int"},"value":42}],"kind":"atomic","name":"="}'
EQ_CID = "blake3-512:5eade72c08811b2d38adcb158eced38f3d319de090d59b2fa7a77ad830169e18539d2b75d2a2838c545e644a688cf137603674523ff37f1586a650f6dd05aeaa"


def test_cid_vector():
    assert crypto.cid(EQ) == EQ_CID
    assert canon.jcs(json.loads(EQ)) == EQ
    assert crypto.is_cid(EQ_CID) and not crypto.is_cid("blake3-512:00") and not crypto.is_cid(None)


def test_blake3_lengths():
    # digests of the empty string and of many chunks, from the published test vectors
    assert crypto.blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    data = bytes(i % 251 for i in range(1025))
    assert crypto.blake3(data).hex() == "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"


def test_ed25519_vector():
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    assert crypto.ed25519_public(seed).hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    signature = crypto.ed25519_sign(seed, b"")
    assert signature.hex().startswith("e5564300c360ac729086e2cc806e828a")
    assert crypto.ed25519_verify(crypto.ed25519_public(seed), signature, b"")
    assert not crypto.ed25519_verify(crypto.ed25519_public(seed), signature, b"x")
    assert crypto.verify_strings(crypto.public_string(seed), crypto.sign_string(seed, b"m"), b"m")
    assert not crypto.verify_strings("rsa:00", "ed25519:!", b"m")


def test_numbers_stay_apart():
    assert canon.jcs(5.9, "pool") == "5" and canon.jcs(5.2, "pool") == "5"
    assert canon.jcs(5.5, "handshake") == '"5.5"' and canon.jcs(5.0, "handshake") == "5"
    assert canon.jcs(5.0, "linker") == '"5.0"'
    with pytest.raises(canon.NotCanonical):
        canon.jcs(5.0)


def test_strings_and_keys():
    assert canon.jcs({"b": "\n\"\\", "a": [None, True], "é": 1, "Z": 0}) == '{"Z":0,"a":[null,true],"b":"\\u000a\\"\\\\","é":1}'


def test_sets():
    assert canon.set_cid(["b", "a"]) == canon.set_cid(["a", "b"])
    assert canon.set_cid(["a", "a"]) != canon.set_cid(["a"])
    with pytest.raises(ValueError):
        canon.set_cid(["a", "a"], distinct=True)


def test_property_hash_ignores_name():
    a = {"name": "f", "pre": atom("true")}
    assert canon.contract_cid(a) != canon.contract_cid(a | {"name": "g"})
    assert canon.property_hash(a) == canon.property_hash(a | {"name": "g"})


def test_member_shapes():
    layered = {"envelope": {"signer": "s"}, "header": {"kind": "contract", "name": "f"}, "metadata": {"x": 1}}
    flat = {"cid": "c", "evidence": {"kind": "implication", "body": {"a": 1}}, "producerSignature": "s"}
    assert canon.kind_of(layered) == "contract" and canon.kind_of(flat) == "implication"
    assert canon.body_field(layered, "x") == 1 and canon.body_field(flat, "a") == 1
    assert canon.member_cid(flat) == canon.member_cid(flat | {"cid": "d"})
    assert canon.member_cid({"envelope": {}, "header": {"kind": "proof-run", "cid": "own"}}) == "own"


def test_cbor():
    value = {"a": [1, 24, 70000], "bb": b"\x00", "c": {"d": "é"}}
    assert cbor.decode(cbor.encode(value)) == value
    assert cbor.encode({"bb": 1, "a": 2}) == cbor.encode({"a": 2, "bb": 1})
    for bad in (b"", b"\x61", b"\xff", b"\x01\x01", b"\xa2\x61a\x01\x61a\x01", b"\xf6"):
        with pytest.raises(cbor.CborError):
            cbor.decode(bad)


HOW = {"signer": "s", "declared_at": "2026-01-01T00:00:00.000Z", "seed": b"\x01" * 32}


def test_bundle_round_trip():
    cid, member = bundle.mint_contract({"name": "f", "pre": atom("≥", var("x"), const(0))}, **HOW)
    data_cid, data = bundle.build_bundle("b", "1", {cid: canon.jcs(member, "linker").encode()}, "s", HOW["declared_at"], HOW["seed"])
    rows = bundle.explode_bundle(data, data_cid)
    assert [(r["member_cid"], r["error"]) for r in rows] == [(cid, None)]
    assert bundle.verify_bundle(data, crypto.ed25519_public(HOW["seed"]))
    assert bundle.conformance(data, data_cid.split(":")[1]) == []
    assert "name differs from content" in bundle.conformance(data, "0" * 128)
    assert bundle.explode_bundle(data, "blake3-512:00")[0]["error"]
    assert bundle.explode_bundle(b"junk")[0]["error"].startswith("not a bundle")
    with pytest.raises(ValueError):
        bundle.mint_contract({"name": "f"}, **HOW)
    other = bundle.build_bundle("b", "1", {"blake3-512:" + "0" * 128: b"{}", "md5:1": b"{}"}, "s", HOW["declared_at"], HOW["seed"])[1]
    assert all(r["error"] for r in bundle.explode_bundle(other))


def test_witness_lines():
    data, cid = bundle.suite_bundle({"t2": b'{"b":1}', "t1": b'{"a":1}'})
    assert data == b'{"a":1}\n{"b":1}\n' and cid == crypto.cid(data)
    assert set(bundle.read_witness_bundle(data).values()) == {b'{"a":1}', b'{"b":1}'}


def forall(name, body):
    return {"kind": "forall", "name": name, "sort": {"kind": "primitive", "name": "Int"}, "body": body}


def test_substitution_and_closure():
    f = forall("x", atom(">", var("x"), var("y")))
    assert not formula.is_closed(f) and formula.is_closed(forall("y", f))
    assert formula.free_variables(f) == {"y"}
    captured = formula.substitute_plain(f, "y", var("x"))
    assert captured["body"]["args"] == [var("x"), var("x")]
    renamed = formula.substitute(f, "y", var("x"))
    assert renamed["name"] != "x" and renamed["body"]["args"][1] == var("x")
    assert formula.instantiate(f, [], None, [const(3)])["args"][0] == const(3)
    with pytest.raises(ValueError):
        formula.instantiate(atom("p"), ["a", "b"], None, [const(1)])
    assert formula.canonical(forall("q", atom(">", var("q")))) == formula.canonical(forall("z", atom(">", var("z"))))
    let = {"kind": "let", "bindings": [{"name": "a", "boundTerm": const(1)}], "body": var("a")}
    assert formula.canonical(let) == const(1)
    assert formula.canonical_property(atom("=", var("r"), var("n")), ["n"], "r")["args"] == [var("$out"), var("$arg0")]


def test_routes():
    assert formula.theory(atom("contains", const("a", "String"), const("b", "String"))) == "strings"
    assert formula.theory(atom("bvult", var("x"), var("y"))) == "bitvectors"
    assert formula.theory(atom("<", var("x"), const(1))) == "linear-arithmetic"
    assert formula.theory(forall("x", atom("p", var("x")))) == "first-order"
    assert formula.theory(atom("equational_theory")) == "equational-theory"
    assert formula.theory(atom("p")) == "default"
    assert formula.discharge_method(atom("=", var("x"), var("x"))) == "reflexive"
    assert formula.discharge_method(atom("=", var("x"), var("y"))) == "solver-substantive"


def test_conjunction_and_tactics():
    a, b = atom("p"), atom("q")
    both = formula.conjoin(a, {"kind": "and", "operands": [b, a, formula.TRUE]})
    assert both == {"kind": "and", "operands": [a, b]}
    assert formula.tactics(both, {formula.formula_cid(a)}) == ("weakened", b)
    assert formula.tactics(both, {formula.formula_cid(a), formula.formula_cid(b)})[0] == "proved"
    implies = {"kind": "implies", "operands": [a, b]}
    assert formula.tactics(implies, {formula.formula_cid(formula.contrapositive(implies))})[0] == "proved"


def test_composition():
    inner = {"formals": ["n"], "pre": atom("≥", var("n"), const(0)), "post": atom("=", var("result"), {"kind": "ctor", "name": "+", "args": [var("n"), const(1)]})}
    outer = {"formals": ["m"], "pre": atom(">", var("m"), const(0)), "post": atom("=", var("result"), var("m"))}
    made = formula.compose(outer, inner, 0)
    assert made["formals"] == ["n"] and made["post"]["args"][1]["name"] == "+"
    assert formula.compose(outer | {"effects": ["io"]}, inner, 0) is None
    assert formula.compose_chain([inner, outer | {"effects": ["io"]}]) == {"refused": "impure", "step": 1}
    pre = formula.wp({"kind": "ctor", "name": "inc", "args": [const(2)]}, atom("<", var("result"), const(9)), {"inc": inner})
    assert atom("≥", const(2), const(0)) in formula.conjuncts(pre)
    rule = {"op": "twice", "params": ["a"], "template": {"kind": "ctor", "name": "+", "args": [var("a"), var("a")]}}
    assert formula.desugar({"kind": "ctor", "name": "twice", "args": [const(1)]}, [rule])["name"] == "+"
    with pytest.raises(ValueError):
        formula.desugar({"kind": "ctor", "name": "x", "args": []}, [{"op": "x", "params": [], "template": {"kind": "ctor", "name": "x", "args": []}}], limit=50)


def test_scripts():
    f = atom("≥", var("x"), const(-1))
    assert "(assert (not (>= x (- 1))))" in smt.validity(f) and "(declare-const x Int)" in smt.satisfiability(f)
    assert smt.formula(atom("is_ascii_digit", var("s"))) == '(str.in_re s (re.* (re.range "0" "9")))'
    assert smt.reglan("a+b?") == '(re.++ (re.+ (str.to_re "a")) (re.opt (str.to_re "b")))'
    with pytest.raises(smt.Refused):
        smt.reglan("(?=a)b")
    assert smt.lean(f).startswith("theorem obligation (x : Int)")
    assert smt.maude(atom("=", const(1), var("x"))) == "reduce 1 == x ."
    assert formula.fol(forall("x", atom(">", var("x"), const(0)))) == "∀x:Int. x > 0"


def test_ground_values():
    assert smt.eval_string("contains", ["abc", "b"]) and not smt.eval_string("prefix-of", ["b", "abc"])
    tree = {"kind": "ctor", "name": "bvshl", "args": [var("x"), const(31)]}
    assert smt.eval_bv32(tree, {"x": 1}) == -(2**31)
    assert smt.model_value("((result #xffffffff))") == -1 and smt.model_value("unsat") is None
    assert "#x00000001" in smt.derive_query(tree, {"x": 1})
    with pytest.raises(smt.Refused):
        smt.derive_query(tree, {})
    assert smt.disjoint_types("int", "str") and not smt.disjoint_types("int", "bool") and not smt.disjoint_types("int", "Foo")


@pytest.mark.parametrize("pattern", ["(?i)abc", "(?P<n>x)", "a*+", "a*?", r"\\bfoo", r"(a)\\1", "(?>ab)", "(?<=a)b", "[a", "(ab", r"[\\D]x[\\Wa]"])
def test_patterns_that_are_refused(pattern):
    with pytest.raises(smt.Refused):
        smt.reglan(pattern.replace("\\\\", "\\"))


def test_patterns():
    assert smt.reglan(".") == '(re.inter re.allchar (re.comp (str.to_re "\\u{a}")))'
    assert smt.reglan("^ab$") == smt.reglan("ab") and smt.reglan("^a|b$") == smt.reglan("a|b")
    assert smt.reglan(r"\D") == '(re.diff re.allchar (re.range "0" "9"))' and "re.union" in smt.reglan(r"\s")
    assert smt.reglan("[+?]+") == '(re.+ (re.union (str.to_re "+") (str.to_re "?")))'
    assert smt.disjoint_types("bytearray", "type") and not smt.disjoint_types("Animal", "Dog")


def test_constructor_names_parse_a_shape_once(monkeypatch):
    def plain(text):
        try:
            return [c["name"] for c in formula.constructors(json.loads(text))]
        except ValueError:
            return "malformed"

    def made(text):
        try:
            return formula.constructor_names(text)
        except ValueError:
            return "malformed"

    f = '{"kind":"atomic","name":"=","args":[{"kind":"ctor","name":"%s","args":[{"kind":"var","name":"%s"},{"kind":"const","value":%s}]},{"name" : "g","kind":"ctor"}]}'
    texts = [f % v for v in [("f", "x", 1), ("a", "ctor", 22), ("name", "value", -3), ("\\u0067", "x", 1), ('q\\"', "x", 1), ("é", "x", 1), ("f", "x", "007"), ("f", "x", "1.5"), ("f", "x", '"name"'), ("f\n", "x", 1), ("", "", 10**30)]]
    texts += [texts[0].replace('"name":"f"', x) for x in ('"name":#', '"name":5', '"name":null', '"name":"f","name":"h"', '"n\\u0061me":"f"', '"name" :"f"', '"name":"f"#')] + ["5", "[]", "ok", ""]
    assert [made(t) for t in texts * 2] == [plain(t) for t in texts * 2]
    loads, n = json.loads, []
    monkeypatch.setattr(formula.json, "loads", lambda t: (n.append(t), loads(t))[1])
    formula._read.clear()
    assert [formula.constructor_names(f % (f"p{i}", "x", i)) for i in range(50)] == [[f"p{i}", "g"] for i in range(50)] and len(n) == 1


def test_many_members_are_minted_side_by_side(monkeypatch):
    how = {"signer": crypto.public_string(bytes(32)), "declared_at": "2026-01-01T00:00:00.000Z", "seed": bytes(32)}
    contents = [("implication", {"n": i, "text": "x" * 40 * i, "none": None}, {"m": i}) for i in range(40)] + [("proof-run", {"cid": "own"}, {})]
    one_by_one = [bundle.mint(*c, **how) for c in contents]
    monkeypatch.setattr(crypto, "blake3", None)
    assert bundle.mint_many(contents, **how) == one_by_one
