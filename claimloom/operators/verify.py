"""Verification of claims at call sites: a cascade of tiers, each over what the tiers before it left open.

A site is settled by the first tier that applies: the shape of an attribute's
class, a target that is not there, the body of what is called, an empty
precondition, or a solver. What reaches the solvers is one obligation, routed by
its theory; equal obligations are decided once, and a solver to which nothing
was routed does not run.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import formula, udfs
from ..functions.canon import jcs
from . import algebra, bodies, decide, linking, pool
from .graph import kept, sent

TIERS = "attribute-safety unresolved-target guarded unguarded instantiate-refused body-refused body-reflexive body-solver body-bearing-refused vacuous".split()
SOLVERS = ("difference", "ground")
TRUE = '{"kind":"and","operands":[]}'


def nontrivial(pre):
    """Whether a precondition asks for something."""
    return pre.isNotNull() & ~F.coalesce((F.get_json_object(pre, "$.kind") == "atomic") & (F.get_json_object(pre, "$.name") == "true"), F.lit(False))


def _instantiated(batches):
    """Preconditions at their calls: (id, obligation, error)."""
    for pdf in batches:
        out = []
        for i, pre, formals, args, actuals in zip(pdf["id"], pdf["pre"], pdf["formals"], pdf["args"], pdf["actuals"], strict=True):
            text = error = None
            try:
                named = {k: json.loads(v) for k, v in dict(actuals).items()} if actuals is not None and len(actuals) else None
                made = formula.instantiate(json.loads(pre), list(formals) if formals is not None else [], named, [json.loads(a) for a in args] if args is not None else [])
                text = jcs(formula.strip_forall(made), "linker")
            except (ValueError, TypeError, AttributeError, KeyError) as e:
                error = str(e) if type(e) is ValueError else "malformed"
            out.append((i, text, error))
        yield pd.DataFrame(out, columns=["id", "obligation", "error"])


def solved(obligations: DataFrame, routes: dict[str, str]) -> DataFrame:
    """Obligations (id, assumed, obligation) with class, routed solver and verdict. Equal ones are decided once.

    ``routes`` names a solver for each theory and for ``default``. A name that is no
    solver of this library leaves its obligations undecidable.
    """
    text = F.concat(F.length("assumed").cast("string"), F.lit(":"), "assumed", "obligation")
    keyed = kept(obligations.withColumn("_key", F.sha2(text, 256)))
    whole = F.when(F.col("assumed") == TRUE, F.col("obligation")).otherwise(F.concat(F.lit('{"kind":"implies","operands":['), "assumed", F.lit(","), "obligation", F.lit("]}")))
    once = keyed.groupBy("_key").agg(F.first("assumed").alias("assumed"), F.first("obligation").alias("obligation"))  # equal in a group
    once = once.withColumns({"whole": whole}).withColumns({"obligation_class": F.coalesce(udfs.theory("whole"), F.lit("default")), "method": udfs.discharge_method("obligation")})
    default = routes.get("default")
    route = F.lit(default)
    for theory, solver in sorted(routes.items()):
        route = F.when(F.col("obligation_class") == theory, solver).otherwise(route)
    once = kept(once.withColumn("routed_solver", route))
    alike = F.coalesce(F.col("method") == "reflexive", F.lit(False)) & F.col("routed_solver").isin(*SOLVERS)
    found = [once.filter(alike).select("_key", F.lit("discharged").alias("verdict"))]
    left = once.filter(~alike)
    bounds, ground = left.filter("routed_solver = 'difference'"), left.filter("routed_solver = 'ground'")
    if not bounds.isEmpty():
        made = decide.implications(bounds.select(F.col("_key").alias("id"), F.col("assumed").alias("post"), F.col("obligation").alias("pre")))
        found.append(made.select(F.col("id").alias("_key"), F.when(F.col("verdict") == "implied", "discharged").when(F.col("verdict") == "refuted", "unsatisfied").otherwise("undecidable").alias("verdict")))
    if not ground.isEmpty():
        made = algebra.run_plan(ground.select(F.col("_key").alias("id"), F.col("whole").alias("formula")), {"ground": algebra.ground_solver}, ["ground"])
        found.append(made.select(F.col("id").alias("_key"), "verdict"))
    verdicts = found[0]
    for f in found[1:]:
        verdicts = verdicts.unionByName(f)
    once = once.join(verdicts, "_key", "left").select("_key", "obligation_class", "routed_solver", "method", F.coalesce("verdict", F.lit("undecidable")).alias("verdict"))
    return keyed.join(once, "_key").drop("_key")


def verify_claims(sites: DataFrame, contracts: DataFrame, shapes: DataFrame, routes: dict[str, str] | None = None) -> DataFrame:
    """One row per site: id, tier, obligation_class, routed_solver, solver, verdict, reason, method, body_tier.

    Sites have id, target_cid, assertion (a formula or null), guards and args (arrays
    of JSON), actuals (a map by formal, or null), and for an attribute receiver_class,
    attribute and arg_term. Contracts have contract_cid, op, formals, pre, post; of
    several of one id the least counts. Ids are unique. In this order:

    * a site of an attribute is settled by its guards and its class, whatever they say;
    * a target that asks for something must have it: its precondition at this call
      follows from the guards (``panic-safe``) or holds by itself. This goes
      before its body, whose equation with itself would say nothing;
    * else an assertion about calls with bodies is reduced through them; one that
      cannot be is refused, never passed over;
    * else a target that is not there leaves the site undecidable, one with formals was
      to be reduced and is refused, and one without is ``vacuous``.

    Null guards and args are empty ones; a null assertion has no body to go through.
    """
    routes = routes or {"default": "difference"}
    none, empty = F.lit(None).cast("string"), F.expr("cast(array() as array<string>)")
    given = ["guards", "args", "actuals", "receiver_class", "attribute", "arg_term"]
    alone = F.col("attribute").isNull()  # an attribute is settled whatever its target and assertion say
    rows = sites.withColumns({"guards": F.coalesce("guards", empty), "args": F.coalesce("args", empty), "actuals": F.map_entries("actuals"), "target_cid": F.when(alone, F.col("target_cid")), "assertion": F.when(alone, F.col("assertion"))})
    columns = ["id", "tier", "obligation_class", "routed_solver", "solver", "verdict", "reason", "method", "body_tier"]

    def row(df: DataFrame, tier, reason, klass="default", verdict="undecidable", solver="<none>", routed="<none>", method=None, body_tier=None) -> DataFrame:
        col = lambda v: none if v is None else F.lit(v) if isinstance(v, str) else v
        return df.select("id", *[col(v).alias(n) for n, v in zip(columns[1:], (tier, klass, routed, solver, verdict, reason, method, body_tier), strict=True)])

    least = contracts.filter("contract_cid is not null").groupBy("contract_cid").agg(F.min(F.struct("formals", "pre", "post", "op")).alias("c"))
    targets = least.select(F.col("contract_cid").alias("target_cid"), "c.formals", "c.pre", F.lit(True).alias("there"))
    bearing = contracts.filter("formals is not null").select("op", "formals", "post", "pre")
    read, made = bodies.told(rows.select("id", "target_cid", "assertion", *given), "assertion", bearing)
    read = kept(linking.looked_up(read, targets, ["target_cid"]).drop("target_cid"))
    what = [*given, "formals", "pre", "there", "made"]
    kinds = kept(read.select(*what).distinct().select(F.monotonically_increasing_id().alias("id"), *what))  # sites of a kind have one fate

    attribute = kinds.filter(F.col("attribute").isNotNull())
    safe = pool.attribute_safety(attribute.select("id", "receiver_class", "attribute", "arg_term", "guards"), shapes)
    settled = [row(safe, "attribute-safety", F.col("reason"), "attribute-safety", F.col("status"), "classShapes", "classShapes", F.when(F.col("status") == "discharged", "attribute-safe"))]

    met = kinds.filter(F.col("attribute").isNull()).withColumn("actuals", F.map_from_entries("actuals"))
    asks = met.filter(nontrivial(F.col("pre")))
    at_call = kept(asks.select("id", "pre", "formals", "args", "actuals").mapInPandas(_instantiated, "id bigint, obligation string, error string"))
    settled.append(row(at_call.filter("obligation is null"), "instantiate-refused", F.concat(F.lit("instantiate: "), "error")))
    guard = F.when(F.size("guards") == 0, TRUE).otherwise(F.concat(F.lit('{"kind":"and","operands":['), F.array_join(F.array_sort(F.array_distinct("guards")), ","), F.lit("]}")))
    pre = at_call.filter("obligation is not null").join(asks.select("id", guard.alias("assumed")), "id")
    pre = pre.select("id", "assumed", "obligation", F.when(F.col("assumed") == TRUE, "unguarded").otherwise("guarded").alias("tier"), none.alias("body_tier"))

    free = met.filter(~nontrivial(F.col("pre"))).select("id", "formals", "there", "made")
    made = made.select("made", F.col("tier").alias("body_tier"), F.col("reason").alias("why"), "reduced", F.col("method").alias("shallow"))
    gone = kept(free.join(made, "made", "left").withColumn("why", F.coalesce("why", F.when(F.col("reduced").isNull(), "not-body-bearing"))))
    settled.append(row(gone.filter("why is not null and why != 'not-body-bearing'"), "body-refused", F.concat(F.lit("body-discharge: "), "why"), body_tier=F.col("body_tier")))
    through = gone.filter("why is null").select("id", F.lit(TRUE).alias("assumed"), F.col("reduced").alias("obligation"), F.when(F.col("shallow") == "reflexive", "body-reflexive").otherwise("body-solver").alias("tier"), "body_tier")

    open_ = gone.filter("why = 'not-body-bearing'")
    settled.append(row(open_.filter("there is null"), "unresolved-target", F.lit("resolve-target: no such contract")))
    settled.append(row(open_.filter("there and formals is not null"), "body-bearing-refused", F.lit("body-discharge: target has formals, and its obligation was not reduced")))
    settled.append(row(open_.filter("there and formals is null"), "vacuous", F.lit("vacuous: target carries no precondition"), "vacuous", "discharged", "none (vacuous)"))

    done = solved(pre.unionByName(through), routes)
    known = F.col("routed_solver").isin(*SOLVERS)
    reason = F.when(known, F.concat(F.lit("solver: "), "verdict")).otherwise(F.concat(F.lit("no solver "), F.coalesce("routed_solver", F.lit("<none>"))))
    # the shallow mark of a body is told before numbers are worked out, so it comes from its tier
    method = F.when(F.col("tier") == "guarded", "panic-safe").when(F.col("tier") == "body-reflexive", "reflexive").when(F.col("tier") == "body-solver", "solver-substantive").otherwise(F.col("method"))
    settled.append(row(done, F.col("tier"), reason, F.col("obligation_class"), F.col("verdict"), F.when(known & (F.col("verdict") != "undecidable"), F.col("routed_solver")).otherwise("<none>"), F.coalesce("routed_solver", F.lit("<none>")), F.when(F.col("verdict") == "discharged", method), F.col("body_tier")))
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    out = kept(kinds.withColumnRenamed("id", "_kind").join(out.withColumnRenamed("id", "_kind"), "_kind")).drop("_kind")
    met = lambda c: read[c].eqNullSafe(out[f"_{c}"])
    out = sent(out.withColumnsRenamed({c: f"_{c}" for c in what}), bodies.TEXTS)
    return read.join(out, reduce(and_, map(met, what))).select(*columns)


def split(verified: DataFrame) -> DataFrame:
    """Count per tier, verdict and bucket of the receipt."""
    bucket = C.claim_bucket(F.col("verdict"), F.col("method"), F.col("obligation_class"))
    return verified.groupBy("tier", "verdict", bucket.alias("bucket")).agg(F.count("*").alias("n"))
