"""Claims from Python source: assertions, preconditions, call edges, decorators, constant pins.

Each function maps a source text to rows; :func:`lift` runs them over a frame
of files. What cannot be read becomes a refusal row with a reason, never
nothing.
"""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import DataFrame

from ..functions import canon
from ..functions.formula import TRUE, atom, conjoin, const, negate, var

# Comparison operators, and assertion helpers with the place of their tolerance.
COMPARE = {ast.Eq: "=", ast.NotEq: "≠", ast.Lt: "<", ast.LtE: "≤", ast.Gt: ">", ast.GtE: "≥", ast.Is: "=", ast.IsNot: "≠"}
ARITHMETIC = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Mod: "%"}
HELPERS = {"assertEqual": "=", "assert_equal": "=", "assert_array_equal": "=", "assertNotEqual": "≠", "assertLess": "<", "assertLessEqual": "≤", "assertGreater": ">", "assertGreaterEqual": "≥", "assertTrue": "true", "assertFalse": "false", "assert_allclose": "close", "assertAlmostEqual": "close"}
SORTS = {"int": "Int", "bool": "Bool", "str": "String", "float": "Real"}


class Unreadable(ValueError):
    pass


def sort_of(annotation) -> dict:
    name = getattr(annotation, "id", None)
    return {"kind": "primitive", "name": SORTS.get(name, "Any")}


def term(node: ast.AST) -> dict:
    if isinstance(node, ast.Name):
        return var(node.id)
    if isinstance(node, ast.Constant):
        if node.value is None:
            return {"kind": "ctor", "name": "None", "args": []}
        for kind, sort in ((bool, "Bool"), (int, "Int"), (str, "String"), (float, "Real")):
            if isinstance(node.value, kind):
                return const(node.value, sort)
        raise Unreadable(f"literal {type(node.value).__name__}")
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub) and isinstance(node.operand, ast.Constant) and isinstance(node.operand.value, int | float):
        return const(-node.operand.value, "Int" if isinstance(node.operand.value, int) else "Real")
    if isinstance(node, ast.BinOp) and type(node.op) in ARITHMETIC:
        return {"kind": "ctor", "name": ARITHMETIC[type(node.op)], "args": [term(node.left), term(node.right)]}
    if isinstance(node, ast.Call):
        if node.keywords:
            raise Unreadable("keyword arguments")
        return {"kind": "ctor", "name": ast.unparse(node.func), "args": [term(a) for a in node.args]}
    if isinstance(node, ast.Attribute):
        return {"kind": "ctor", "name": "attr", "args": [term(node.value), const(node.attr, "String")]}
    if isinstance(node, ast.List | ast.Tuple | ast.Set | ast.Dict):
        text = collection(node)
        if text is not None:
            return const(text, "String")
    raise Unreadable(type(node).__name__)


def collection(node: ast.AST) -> str | None:
    """Canonical text of a literal collection, or None."""
    try:
        value = ast.literal_eval(node)
    except (ValueError, TypeError):
        return None

    def text(v):
        if isinstance(v, dict):
            return "{" + ",".join(sorted(f"{text(k)}:{text(x)}" for k, x in v.items())) + "}"
        if isinstance(v, set):
            return "set(" + ",".join(sorted(map(text, v))) + ")"
        if isinstance(v, list | tuple):
            return ("[%s]" if isinstance(v, list) else "(%s)") % ",".join(map(text, v))
        return repr(v)

    return text(value)


def predicate(node: ast.AST) -> dict:
    if isinstance(node, ast.Compare):
        parts, left = [], node.left
        for op, right in zip(node.ops, node.comparators, strict=True):
            if type(op) in COMPARE:
                parts.append(atom(COMPARE[type(op)], term(left), term(right)))
            elif isinstance(op, ast.In | ast.NotIn):
                inside = atom("contains", term(right), term(left))
                parts.append(inside if isinstance(op, ast.In) else negate(inside))
            left = right
        return conjoin(*parts)
    if isinstance(node, ast.BoolOp):
        ops = [predicate(v) for v in node.values]
        return conjoin(*ops) if isinstance(node.op, ast.And) else {"kind": "or", "operands": ops}
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
        return negate(predicate(node.operand))
    if isinstance(node, ast.Constant) and node.value is True:
        return TRUE
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "isinstance" and len(node.args) == 2:
        return atom("isinstance", term(node.args[0]), const(ast.unparse(node.args[1]), "String"))
    return atom("truthy", term(node))


def helper(call: ast.Call) -> dict | None:
    """Predicate of an assertion helper, or None if it is not one."""
    name = call.func.attr if isinstance(call.func, ast.Attribute) else getattr(call.func, "id", None)
    kind = HELPERS.get(name)
    if kind is None:
        return None
    args = call.args
    if kind in ("true", "false"):
        p = predicate(args[0])
        return p if kind == "true" else negate(p)
    if kind == "close":
        tolerance = next((k.value for k in call.keywords if k.arg in ("rtol", "atol", "delta", "places")), None)
        return atom("close", term(args[0]), term(args[1]), term(tolerance) if tolerance is not None else const("default", "String"))
    return atom(kind, term(args[0]), term(args[1]))


def _row(kind: str, name: str, line: int, value=None, reason: str | None = None) -> dict:
    return {"kind": kind, "name": name, "line": line, "value": None if value is None else canon.jcs(value, "linker"), "reason": reason}


def _claim_name(p: dict, function: str) -> str:
    """Claims about one call share a name, so they are decided together."""
    args = p.get("args") or []
    if p.get("kind") == "atomic" and args and args[0].get("kind") == "ctor" and args[0].get("name") not in (*ARITHMETIC.values(), "attr"):
        return f"{args[0]['name']}#euf#{canon.short(canon.jcs_cid(args[0], 'linker'))}"
    return f"{function}::facts"


def assertions(source: str) -> list[dict]:
    """Claims of test functions: plain asserts and helpers."""
    out = []
    for fn in [n for n in ast.walk(ast.parse(source)) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]:
        for node in ast.walk(fn):
            try:
                if isinstance(node, ast.Assert):
                    p = predicate(node.test)
                elif isinstance(node, ast.Call) and (p := helper(node)) is not None:
                    pass
                else:
                    continue
                out.append(_row("claim", _claim_name(p, fn.name), node.lineno, p))
            except (Unreadable, IndexError) as e:
                out.append(_row("refusal", fn.name, node.lineno, reason=f"cannot read `{ast.unparse(node)[:60]}`, got {e}"))
    return out


def contracts(source: str) -> list[dict]:
    """A contract per function: leading guards that raise are preconditions, one final return gives the post."""
    out = []
    for fn in [n for n in ast.walk(ast.parse(source)) if isinstance(n, ast.FunctionDef)]:
        pre, post, effects = [], None, set()
        for s in fn.body:
            try:
                if isinstance(s, ast.If) and len(s.body) == 1 and isinstance(s.body[0], ast.Raise) and not s.orelse:
                    pre.append(negate(predicate(s.test)))
                elif isinstance(s, ast.Assert):
                    pre.append(predicate(s.test))
                elif isinstance(s, ast.Return) and s.value is not None:
                    post = atom("=", var("result"), term(s.value))
            except Unreadable as e:
                out.append(_row("refusal", fn.name, s.lineno, reason=f"cannot read guard, got {e}"))
        for n in ast.walk(fn):
            if isinstance(n, ast.Raise):
                effects.add("panics")
            elif isinstance(n, ast.Global | ast.Nonlocal):
                effects.add("writes")
            elif isinstance(n, ast.Call) and getattr(n.func, "id", "") in ("open", "print", "input"):
                effects.add("io")
            elif isinstance(n, ast.For | ast.While):
                effects.add("opaque_loop")
        formals = [a.arg for a in fn.args.args]
        value = {"name": fn.name, "formals": formals, "formalSorts": [sort_of(a.annotation) for a in fn.args.args], "pre": conjoin(*pre) if pre else None, "post": post, "effects": sorted(effects)}
        out.append(_row("contract", fn.name, fn.lineno, {k: v for k, v in value.items() if v is not None}))
    return out


def call_edges(source: str) -> list[dict]:
    out = []
    for fn in [n for n in ast.walk(ast.parse(source)) if isinstance(n, ast.FunctionDef)]:
        for n in ast.walk(fn):
            if isinstance(n, ast.Call):
                out.append(_row("call", fn.name, n.lineno, {"target": f"python:{ast.unparse(n.func)}"}))
    return out


def decorators(source: str) -> list[dict]:
    """Contracts given by ``requires`` and ``ensures`` decorators with a lambda."""
    out = []
    for fn in [n for n in ast.walk(ast.parse(source)) if isinstance(n, ast.FunctionDef)]:
        value = {}
        for d in fn.decorator_list:
            name = getattr(d.func, "attr", getattr(d.func, "id", "")) if isinstance(d, ast.Call) else ""
            if name in ("requires", "ensures") and d.args and isinstance(d.args[0], ast.Lambda):
                try:
                    value["pre" if name == "requires" else "post"] = predicate(d.args[0].body)
                except Unreadable as e:
                    out.append(_row("refusal", fn.name, d.lineno, reason=f"cannot read {name}, got {e}"))
        if value:
            out.append(_row("contract", fn.name, fn.lineno, value | {"name": fn.name}))
    return out


def pins(source: str) -> list[dict]:
    """Module constants; names bound twice or to something else are refused by reason."""
    tree, seen, out = ast.parse(source), {}, []
    for s in tree.body:
        targets = s.targets if isinstance(s, ast.Assign) else [s.target] if isinstance(s, ast.AnnAssign) and s.value else []
        for t in targets:
            if isinstance(t, ast.Name):
                seen.setdefault(t.id, []).append(s)
    for name, where in seen.items():
        try:
            if len(where) > 1:
                raise Unreadable("bound more than once")
            out.append(_row("pin", name, where[0].lineno, atom("=", var(name), term(where[0].value))))
        except Unreadable as e:
            out.append(_row("refusal", name, where[0].lineno, reason=str(e)))
    return out


def gaps(walks: list[dict]) -> list[dict]:
    """Walks whose entry formula still holds the predicate on a plain variable without a guard."""
    return [w for w in walks if w.get("predicate_at_entry") and w.get("subject_kind") == "var" and not w.get("guarded")]


PRODUCERS = {"assertions": assertions, "contracts": contracts, "call_edges": call_edges, "decorators": decorators, "pins": pins}
SCHEMA = "path string, producer string, kind string, name string, line int, value string, reason string"


def lift(files: DataFrame, producers: list[str] | None = None) -> DataFrame:
    """Rows of all producers over files (path, source). A file that does not parse gives one refusal per producer."""
    names = producers or list(PRODUCERS)

    def run(batches):
        for pdf in batches:
            rows = []
            for path, source in zip(pdf["path"], pdf["source"], strict=True):
                for name in names:
                    try:
                        found = PRODUCERS[name](source or "")
                    except (SyntaxError, ValueError, RecursionError) as e:
                        found = [_row("refusal", path, 0, reason=f"does not parse, got {type(e).__name__}")]
                    rows += [{"path": path, "producer": name} | r for r in found]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.select("path", "source").mapInPandas(run, SCHEMA)


# Predicate heads and the Python text of an assertion.
PYTEST = {
    "eq": "assert {0} == {1}", "ne": "assert {0} != {1}", "lt": "assert {0} < {1}", "gt": "assert {0} > {1}", "le": "assert {0} <= {1}", "ge": "assert {0} >= {1}",
    "option-is-some": "assert {0} is not None", "option-is-none": "assert {0} is None", "not-null": "assert {0} is not None", "fallible-err": "with pytest.raises(Exception):\n        {0}()",
}
UNITTEST = {
    "eq": "self.assertEqual({0}, {1})", "ne": "self.assertNotEqual({0}, {1})", "lt": "self.assertLess({0}, {1})", "gt": "self.assertGreater({0}, {1})",
    "le": "self.assertLessEqual({0}, {1})", "ge": "self.assertGreaterEqual({0}, {1})", "option-is-some": "self.assertIsNotNone({0})", "option-is-none": "self.assertIsNone({0})",
    "not-null": "self.assertIsNotNone({0})", "fallible-err": "with self.assertRaises(Exception):\n        {0}()",
}


def _spell(t: dict) -> str | None:
    kind = t.get("kind")
    if kind == "var":
        return t["name"]
    if kind == "const":
        return repr(t["value"])
    name = str(t.get("name", "")).removeprefix("concept:")
    args = [_spell(a) for a in t.get("args") or []]
    if None in args or not name:
        return None
    return f"({args[0]} {name} {args[1]})" if name in ("+", "-", "*", "/", "%") and len(args) == 2 else f"{name}({', '.join(args)})"


def render(p: dict, table: dict[str, str] = PYTEST) -> str | None:
    """Assertion text of a neutral predicate; None if the table, the arity or a term does not allow it."""
    form = table.get(str(p.get("name", "")).removeprefix("concept:"))
    args = [_spell(a) for a in p.get("args") or []]
    if form is None or None in args or len(args) != (2 if "{1}" in form else 1):
        return None
    return form.format(*args)


def property_test(name: str, variables: dict[str, str], p: dict) -> str | None:
    """A Hypothesis test of a predicate over typed variables."""
    body = render(p)
    kinds = {"Int": "st.integers()", "String": "st.text()", "Bool": "st.booleans()", "Real": "st.floats(allow_nan=False)"}
    if body is None or any(s not in kinds for s in variables.values()):
        return None
    given = ", ".join(f"{v}={kinds[s]}" for v, s in variables.items())
    return f"from hypothesis import given, strategies as st\n\n\n@given({given})\ndef test_{name}({', '.join(variables)}):\n    {body}\n"


def recognise(source: str, templates: dict[str, str]) -> list[dict]:
    """Functions whose body equals a template's up to names: tags with the template's name."""

    def shape(fn):
        names: dict[str, str] = {}

        class Rename(ast.NodeTransformer):
            def visit_Name(self, n):
                n.id = names.setdefault(n.id, f"v{len(names)}")
                return n

            def visit_arg(self, n):
                n.arg, n.annotation = names.setdefault(n.arg, f"v{len(names)}"), None
                return n

        copy = Rename().visit(ast.parse(ast.unparse(fn)).body[0])
        return ast.dump(ast.Module(body=[copy.args, *copy.body], type_ignores=[]))

    known = {shape(ast.parse(t).body[0]): k for k, t in templates.items()}
    out = []
    for fn in [n for n in ast.walk(ast.parse(source)) if isinstance(n, ast.FunctionDef)]:
        tag = known.get(shape(fn))
        if tag:
            out.append(_row("tag", fn.name, fn.lineno, json.loads(json.dumps({"tag": tag}))))
    return out
