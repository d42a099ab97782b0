"""Arrow-batched functions over the plain Python ones, and their registry."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import batch, bundle, canon, crypto, formula, smt


def _each(f: Callable, kind) -> Callable:
    """A Pandas UDF that maps null to null and an error to null."""

    def one(*values):
        if any(v is None for v in values):
            return None
        try:
            return f(*values)
        except (ValueError, KeyError, TypeError, IndexError, RecursionError):
            return None

    def one_column(a: pd.Series) -> pd.Series:
        return a.map(one, na_action=None)

    def two_columns(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    def many(k: int):
        return F.pandas_udf(one_column if k == 1 else two_columns, kind)

    return many


def _json(f):
    return lambda text, *more: f(json.loads(text), *more)


S, B = T.StringType(), T.BooleanType()


def _cid(a: pd.Series) -> pd.Series:
    values = [None if v is None else v.encode() if isinstance(v, str) else bytes(v) for v in a]
    made = iter(batch.digests([v for v in values if v is not None]))
    return pd.Series([None if v is None else "blake3-512:" + next(made).hex() for v in values], dtype=object)


cid = F.pandas_udf(_cid, S)
jcs = _each(_json(lambda v: canon.jcs(v, "linker")), S)(1)
formula_cid = _each(_json(canon.formula_cid), S)(1)
formula_hash = _each(_json(canon.formula_hash), S)(1)
linker_cid = _each(_json(lambda v: canon.jcs_cid(v, "linker")), S)(1)
member_cid = _each(_json(canon.member_cid), S)(1)
contract_cid = _each(_json(canon.contract_cid), S)(1)
signed = _each(_json(bundle.signature_holds), B)(1)
property_hash = _each(_json(canon.property_hash), S)(1)
implication_hash = _each(canon.implication_hash, S)(2)
canonical = _each(_json(lambda v: canon.jcs(formula.canonical(v), "linker")), S)(1)
theory = _each(_json(formula.theory), S)(1)
discharge_method = _each(_json(formula.discharge_method), S)(1)
is_closed = _each(_json(formula.is_closed), B)(1)
fol = _each(_json(formula.fol), S)(1)
free_variables = _each(_json(lambda v: sorted(formula.free_variables(v))), T.ArrayType(S))(1)
constructors = _each(formula.constructor_names, T.ArrayType(S))(1)
validity_script = _each(_json(smt.validity), S)(1)
satisfiability_script = _each(_json(smt.satisfiability), S)(1)
lean = _each(_json(smt.lean), S)(1)
maude = _each(_json(smt.maude), S)(1)
reglan = _each(smt.reglan, S)(1)
conjoin = _each(lambda a, b: canon.jcs(formula.conjoin(json.loads(a), json.loads(b)), "linker"), S)(2)
compiled = {"smt-lib": validity_script, "lean": lean, "maude": maude}

BY_NAME = {k: v for k, v in globals().items() if hasattr(v, "returnType") and not k.startswith("_")}


class Registry:
    """Functions, compilers and solvers by name; admitted by id, then sealed."""

    def __init__(self):
        self.items: dict[str, tuple[str, Callable]] = {}
        self.sealed = False

    def admit(self, name: str, function: Callable, content: str) -> str:
        if self.sealed:
            raise ValueError("registry is sealed")
        key = crypto.cid(content)
        if name in self.items and self.items[name][0] != key:
            raise ValueError(f"{name} is taken")
        self.items[name] = (key, function)
        return key

    def seal(self) -> str:
        self.sealed = True
        return canon.set_cid([k for k, _ in self.items.values()])


def register(spark) -> None:
    """Make all functions callable from SQL."""
    for name, f in BY_NAME.items():
        spark.udf.register(f"claim_{name}", f)


def explode_members(batches):
    """For ``mapInPandas``: (path, content, expected) to member rows."""
    columns = ["path", "bundle_cid", "member_cid", "body", "error"]
    for pdf in batches:
        rows = [{"path": p} | r for p, c, e in zip(pdf["path"], pdf["content"], pdf["expected"], strict=True) for r in bundle.explode_bundle(bytes(c), e)]
        yield pd.DataFrame(rows, columns=columns)
