"""Column expressions: all run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: form of a content id.
CID = "^blake3-512:[0-9a-f]{128}$"


def is_cid(c: Column) -> Column:
    return F.coalesce(c.rlike(CID), F.lit(False))


def short_cid(c: Column) -> Column:
    return F.concat(F.substring(F.substring_index(c, ":", -1), 1, 12), F.lit("…"))


def member_kind(json: Column) -> Column:
    """Kind of a member: layered header first, then flat evidence."""
    return F.coalesce(F.get_json_object(json, "$.header.kind"), F.get_json_object(json, "$.envelope.header.kind"), F.get_json_object(json, "$.evidence.kind"))


def member_body(json: Column) -> Column:
    return F.coalesce(F.get_json_object(json, "$.header"), F.get_json_object(json, "$.envelope.header"), F.get_json_object(json, "$.evidence.body"))


def body_field(json: Column, name: str) -> Column:
    paths = [f"$.header.{name}", f"$.envelope.header.{name}", f"$.metadata.{name}", f"$.evidence.body.{name}"]
    return F.coalesce(*[F.get_json_object(json, p) for p in paths])


def contract_name(json: Column) -> Column:
    return F.coalesce(body_field(json, "contractName"), body_field(json, "name"))


def is_setup_binding(name: Column) -> Column:
    return F.coalesce(name.rlike("::facts(::[0-9]+)?$"), F.lit(False))


def is_consistency_candidate(name: Column, pre: Column, post: Column, inv: Column) -> Column:
    return inv.isNotNull() & pre.isNull() & post.isNull() & ~is_setup_binding(name)


def bump(lost: Column, new: Column) -> Column:
    return F.when(lost > 0, "MAJOR").when(new > 0, "minor").otherwise("none")


def bump_rank(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low == "none", 0).when(low == "minor", 1).when(low == "major", 2)


def report_bucket(status: Column, method: Column, panic_site: Column) -> Column:
    """One of seven buckets for a report row."""
    return (
        F.when(F.coalesce(status != "discharged", F.lit(True)), "undecidable")
        .when(panic_site & ~method.eqNullSafe(F.lit("panic-safe")), "falsePass")
        .when((method == "panic-safe") & panic_site, "panicSafe")
        .when(method == "reflexive", "reflexive")
        .when(method == "vacuous", "vacuous")
        .when(method == "hash-tier", "hashTier")
        .otherwise("solverSubstantive")
    )


def self_check_bucket(status: Column, method: Column, panic_site: Column) -> Column:
    """One of five buckets, or null for discharged rows that none names."""
    return (
        F.when(F.coalesce(status != "discharged", F.lit(True)), "undecidable")
        .when(panic_site & ~method.eqNullSafe(F.lit("panic-safe")), "falsePass")
        .when((method == "panic-safe") & panic_site, "panicSafe")
        .when(method.isin("reflexive", "vacuous"), method)
    )


def claim_bucket(verdict: Column, method: Column, obligation_class: Column) -> Column:
    """One of six buckets for a verified claim."""
    return (
        F.when(F.coalesce(verdict != "discharged", F.lit(True)), "undecidable")
        .when(method == "reflexive", "reflexive")
        .when(method == "panic-safe", "panicSafe")
        .when(method == "solver-substantive", "substantive")
        .when(obligation_class == "vacuous", "vacuous")
        .otherwise("hashTier")
    )


def consistency_status(raw: Column) -> Column:
    """Polarity turned: satisfiable claims are consistent."""
    return F.when(raw == "sat", "discharged").when(raw == "unsat", "unsatisfied").otherwise("undecidable")


def reason_bucket(reason: Column) -> Column:
    """Refusal text without quoted specifics and tails, lower case, 72 characters at most."""
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    bare = F.regexp_replace(reason, "`[^`]*(`|$)", "")
    head = F.split_part(F.split_part(bare, F.lit(", got"), F.lit(1)), F.lit("; skipped:"), F.lit(1))
    head = trim(F.regexp_replace(F.lower(trim(head)), r"(?U)[:\s]+$", ""))
    return F.when(head == "", F.lower(trim(reason))).otherwise(F.substring(head, 1, 72))


def effect_class(kind: Column, ordering: Column, drop_kind: Column) -> Column:
    """Whether an effect occurrence blocks, informs or needs a memento."""
    return (
        F.when(kind.isin("reads", "writes", "io", "panics", "unsafe"), "block")
        .when(kind == "atomic_access", F.when(ordering.isNotNull(), "informational").otherwise("memento-required"))
        .when(kind == "drop", F.when(drop_kind.isin("trivial", "structural"), "informational").otherwise("memento-required"))
        .otherwise("memento-required")
    )


def split_symbol(symbol: Column) -> tuple[Column, Column]:
    """Kit and name at the first colon; both null if either part is empty."""
    at = F.instr(symbol, ":")
    kit, name = F.substring(symbol, 1, at - 1), F.substring(symbol, at + 1, F.length(symbol))
    ok = (at > 1) & (F.length(name) > 0)
    return F.when(ok, kit), F.when(ok, name)


def verifier_name(symbol: Column) -> Column:
    """Name as the verifier sees it: the kit is dropped."""
    at = F.instr(symbol, ":")
    return F.when(at > 0, F.substring(symbol, at + 1, F.length(symbol))).otherwise(symbol)


#: Builtin types of which any two different ones are disjoint, but for bool and int.
BUILTINS = ["int", "str", "float", "complex", "bytes", "bytearray", "list", "tuple", "dict", "set", "frozenset", "bool", "NoneType", "type"]


def disjoint_types(a: Column, b: Column) -> Column:
    """Whether no value is an instance of both; types that are not builtin may share instances."""
    return a.isin(BUILTINS) & b.isin(BUILTINS) & (a != b) & ~(a.isin("int", "bool") & b.isin("int", "bool"))


def is_witness_member(json: Column) -> Column:
    return F.coalesce(F.get_json_object(member_body(json), "$.evidence.proofType") == "custom", F.lit(False))


def is_panic_site(panic_site: Column, effect_site: Column) -> Column:
    """The flag where it is given, else whether the effect is that of panics."""
    return F.coalesce(panic_site, effect_site == "panic-freedom", F.lit(False))


def residual(assert_macros: Column, discharged: Column) -> Column:
    return assert_macros - discharged


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


#: Tokens of an assertion's argument: string literals whole, words, runs of operators, single brackets and separators.
TOKENS = r'"(?:[^"\\]|\\.)*"|[A-Za-z0-9_]+|[()\[\]{},;]|[^A-Za-z0-9_\s"()\[\]{},;]+|"'


def assertion_site(path: Column, argument: Column) -> Column:
    """Text of an assertion that does not change with its white space, but with its path and every token; its content id names the site."""
    tokens = F.regexp_extract_all(argument, F.lit(TOKENS), F.lit(0))
    return F.concat(path, F.lit("!("), F.array_join(tokens, " "), F.lit(")"))
