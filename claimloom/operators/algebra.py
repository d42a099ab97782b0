"""Formula algebra over columns and pairs of contracts."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import canon, formula, smt, udfs


def callsites(contracts: DataFrame, bridges: DataFrame) -> DataFrame:
    """Each constructor in a formula that a bridge names: one row per occurrence."""
    names = contracts.select("contract_cid", F.explode(udfs.constructors("formula")).alias("symbol"))
    return names.join(bridges, "symbol")


def verified_parts(formulas: DataFrame, facts: DataFrame) -> DataFrame:
    """(formula_id, cid) of subformulas that are facts."""

    def parts(batches):
        for pdf in batches:
            rows = [(i, c) for i, f in zip(pdf["formula_id"], pdf["formula"], strict=True) for c in {formula.formula_cid(x) for x in formula.subformulas(json.loads(f))}]
            yield pd.DataFrame(rows, columns=["formula_id", "cid"])

    rows = formulas.select("formula_id", "formula").mapInPandas(parts, "formula_id string, cid string")
    return rows.join(facts.select("cid").distinct(), "cid", "left_semi")


def weaken(obligations: DataFrame, facts: DataFrame) -> DataFrame:
    """Obligations without the conjuncts that are facts; ``proved`` where none is left."""

    def parts(batches):
        for pdf in batches:
            rows = [(i, n, formula.formula_cid(c), canon.jcs(c, "linker")) for i, f in zip(pdf["id"], pdf["formula"], strict=True) for n, c in enumerate(formula.conjuncts(json.loads(f)))]
            yield pd.DataFrame(rows, columns=["id", "n", "cid", "part"])

    rows = obligations.select("id", "formula").mapInPandas(parts, "id string, n int, cid string, part string")
    left = rows.join(facts.select("cid").distinct(), "cid", "left_anti")
    kept = left.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda x: x["part"]), " & ").alias("left"))
    return obligations.select("id").join(kept, "id", "left").withColumn("proved", F.col("left").isNull())


def opaque_effects(functions: DataFrame, discharged: DataFrame) -> DataFrame:
    """Effects (function, cid, n, kind, key, formals, covered) that are not discharged.

    Discharges have kind, key and function_cid. Loops, early returns, closures and
    drops need one of their kind and key, a pinned reference one of its key that is
    also of the function; an unresolved call stays open. Aliasing is open, with the first
    such two as key, unless ``covered`` (structs a, b) has every two of its formals.
    An effect without a key is open.
    """
    effect = F.col("kind")
    known = discharged.select("kind", "key", "function_cid").filter("key is not null")
    looked = functions.filter(effect.isin(*formula.BY_KEY)).join(known.select("kind", "key").distinct(), ["kind", "key"], "left_anti")
    pins = known.filter("function_cid != ''").select("kind", "key", F.col("function_cid").alias("cid")).distinct()
    pinned = functions.filter(effect.isin(*formula.BY_FUNCTION)).join(pins, ["kind", "key", "cid"], "left_anti")
    two = F.expr("flatten(transform(formals, (x, i) -> transform(slice(formals, i + 2, size(formals)), y -> struct(x as a, y as b))))")
    bare = F.filter(two, lambda p: ~F.exists(F.coalesce("covered", F.expr("cast(array() as array<struct<a:string,b:string>>)")), lambda m: (m["a"] == p["a"]) & (m["b"] == p["b"]) | (m["a"] == p["b"]) & (m["b"] == p["a"])))
    aliasing = functions.filter(effect.isin(*formula.BY_FORMALS)).withColumn("_bare", bare).filter("size(_bare) > 0").withColumn("key", F.expr("concat_ws('/', _bare[0].a, _bare[0].b)"))
    parts = [looked, pinned, functions.filter(effect.isin(*formula.NEVER_DISCHARGED)), aliasing]
    return reduce(DataFrame.unionByName, [x.select("function", "n", "kind", "key") for x in parts])


def compose_checked(pairs: DataFrame, discharged: DataFrame) -> DataFrame:
    """Pairs (id, outer, inner, formal) of contracts as JSON to (id, composed): a contract, or why there is none.

    Contracts have effects (kind, key, for aliasing also formals), cid and covered. The
    effects of both sides look up the discharges (kind, key, function_cid) in joins;
    what stays open travels with its pair, in the order in which it is met: the outer's, the
    inner's, then aliasing of both.
    """
    schema = "struct<cid:string,effects:array<struct<kind:string,key:string,formals:array<string>>>,covered:array<struct<a:string,b:string>>>"
    sides = F.posexplode(F.array(*[F.from_json(c, schema) for c in ("outer", "inner")])).alias("side", "c")
    met = pairs.select(F.col("id").alias("function"), sides).select("function", "side", "c.cid", "c.covered", F.posexplode("c.effects").alias("at", "e"))
    turn = F.struct(F.col("e.kind").isin(*formula.BY_FORMALS).alias("late"), "side", "at")
    open_ = opaque_effects(met.select("function", "cid", "covered", turn.alias("n"), "e.kind", "e.key", "e.formals"), discharged)
    order = F.array_sort(F.collect_list(F.struct("n", "kind", "key")))
    blocked = open_.groupBy(F.col("function").alias("id")).agg(F.transform(order, lambda x: F.struct(x["kind"].alias("kind"), x["key"].alias("key"))).alias("open"))

    def run(batches):
        for pdf in batches:
            rows = zip(pdf["outer"], pdf["inner"], pdf["formal"], pdf["open"], strict=True)
            made = [json.dumps(formula.compose_checked(json.loads(o), json.loads(i), int(n), list(k) if k is not None else []), sort_keys=True) for o, i, n, k in rows]
            yield pd.DataFrame({"id": pdf["id"], "composed": made})

    return pairs.join(blocked, "id", "left").select("id", "outer", "inner", "formal", "open").mapInPandas(run, "id string, composed string")


def is_pure(effects):
    return F.size(effects) == 0


def region_demands(demands: DataFrame, substitution: DataFrame, closure: DataFrame) -> DataFrame:
    """Demands (call, longer, shorter) over formal regions that the caller's closure does not meet."""
    sub = substitution.dropna().select("call", "formal", "actual")
    step = demands.join(sub.select("call", F.col("formal").alias("longer"), F.col("actual").alias("a")), ["call", "longer"], "left")
    step = step.join(sub.select("call", F.col("formal").alias("shorter"), F.col("actual").alias("c")), ["call", "shorter"], "left")
    step = step.select("call", F.coalesce("a", "longer").alias("a"), F.coalesce("c", "shorter").alias("c"))
    open_ = step.filter((F.col("a") != F.col("c")) & (F.col("a") != "'static") & (F.col("c") != "'static"))
    return open_.join(closure.select("a", "c"), ["a", "c"], "left_anti")


def run_plan(rows: DataFrame, solvers: dict, order: list[str]) -> DataFrame:
    """Verdicts of the listed solvers in turn over (id, formula); a name without a solver is undecidable."""

    def run(batches):
        for pdf in batches:
            out = []
            for i, text in zip(pdf["id"], pdf["formula"], strict=True):
                verdict, by = "undecidable", None
                for name in order:
                    solve = solvers.get(name)
                    found = solve(json.loads(text)) if solve else "undecidable"
                    if found in ("discharged", "unsatisfied"):
                        verdict, by = found, name
                        break
                out.append((i, verdict, by))
            yield pd.DataFrame(out, columns=["id", "verdict", "solver"])

    return rows.select("id", "formula").mapInPandas(run, "id string, verdict string, solver string")


def ground_solver(f: dict) -> str:
    """Decides closed comparisons of literals and their connectives; all else is undecidable."""

    def value(t):
        if t.get("kind") == "const":
            return t["value"]
        if t.get("kind") == "ctor" and t.get("name") in ("+", "-", "*"):
            a = [value(x) for x in t["args"]]
            if None not in a and all(isinstance(x, int) for x in a) and len(a) == 2:
                return {"+": a[0] + a[1], "-": a[0] - a[1], "*": a[0] * a[1]}[t["name"]]
        return None

    def truth(x):
        kind = x.get("kind")
        if kind == "atomic":
            if formula.is_true(x):
                return True
            args = [value(a) for a in x.get("args") or []]
            if None in args:
                return True if formula.discharge_method(x) == "reflexive" else None
            name = x["name"]
            if len(args) == 2 and (type(args[0]) is type(args[1]) or name in ("=", "≠", "!=")) and not any(isinstance(a, float) for a in args):
                a, b = args
                table = {"=": lambda: a == b, "≠": lambda: a != b, "!=": lambda: a != b, "<": lambda: a < b, "≤": lambda: a <= b, "<=": lambda: a <= b, ">": lambda: a > b, "≥": lambda: a >= b, ">=": lambda: a >= b}
                if name in table:
                    return table[name]()
            try:
                found = smt.eval_string(name, args)
                return found if isinstance(found, bool) else None
            except (smt.Refused, TypeError, KeyError):
                return None
        parts = [truth(o) for o in x.get("operands") or []]
        if kind == "not":
            return None if parts[0] is None else not parts[0]
        if kind == "and":
            return False if False in parts else None if None in parts else True
        if kind == "or":
            return True if True in parts else None if None in parts else False
        if kind == "implies":
            return True if parts[0] is False or parts[-1] is True else None if None in parts else False
        return None

    return {True: "discharged", False: "unsatisfied", None: "undecidable"}[truth(f)]


def marry(first: DataFrame, second: DataFrame) -> DataFrame:
    """One contract per function from two lifts: conjoined where both have it, extras named."""
    both = first.select("function", F.col("formula").alias("a")).join(second.select("function", F.col("formula").alias("b")), "function", "full")
    state = F.when(F.col("a").isNull(), "second-only").when(F.col("b").isNull(), "first-only").otherwise("both")
    return both.select("function", state.alias("state"), F.coalesce(udfs.conjoin("a", "b"), "a", "b").alias("formula"))
