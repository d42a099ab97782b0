"""Weakest preconditions of terms as rows, from the leaves up.

A node is a row (term, node, parent, pos, depth); all calls of one depth are
worked out at once: their arguments come together by parent, their contracts by
name, in joins. A contract's value is a text with marks for its slots, made once
for each operator, so a call puts its arguments' texts where the marks are. No
term is walked by recursion, however deep, and none is held whole outside its row.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formula
from ..functions.canon import jcs
from .graph import kept, sent
from .linking import looked_up
from .sets import quoted

#: Marks begin and end with control characters, which canonical JSON never has.
OPEN, CLOSE = "\x01", "\x02"
#: Refusals for want of a memento; all other reasons are faults of a contract.
REFUSED = ("opaque-call", "opaque-loop", "binder")


def _marked(text: str | None, names: list[str]) -> str | None:
    """Canonical text with marks for the variables of these names; None if a binder could catch what is put there."""
    if text is None:
        return None
    tree = json.loads(text)
    kinds = {n.get("kind") for n in formula.nodes(tree)}
    if kinds & {"forall", "exists", "lambda", "let", "choice"}:
        return None
    place = {n: i for i, n in enumerate(names)}

    def walk(t):
        if isinstance(t, list):
            return "[" + ",".join(map(walk, t)) + "]"
        if isinstance(t, dict):
            if t.get("kind") == "var" and t.get("name") in place:
                return f"{OPEN}{place[t['name']]}{CLOSE}"
            return "{" + ",".join(f"{jcs(k)}:{walk(t[k])}" for k in sorted(t)) + "}"
        return jcs(t, "linker")

    return walk(tree)


TEMPLATES = "op string, n int, value string, pre string, why string"


def _templates(batches):
    for pdf in batches:
        rows = []
        for op, slots, pre, post, result, call, loop in zip(*(pdf[c] for c in ("op", "slots", "pre", "post", "result", "unresolved_call", "opaque_loop")), strict=True):
            slots = list(slots) if slots is not None else []
            post = json.loads(post) if post else None
            found = formula.result_equation(post, result or "result") if post is not None else None
            value, own = (None if x is None else jcs(x, "linker") for x in (found, json.loads(pre) if pre and not formula.is_true(json.loads(pre)) else None))
            why = "opaque-call" if call else "opaque-loop" if loop else "no-rule" if pre is None and post is None else None
            made = (_marked(value, slots), _marked(own, slots))
            if why is None and (value, own) != (None, None) and any(x is not None and m is None for x, m in zip((value, own), made, strict=True)):
                why = "binder"
            rows.append((op, len(slots), *made, why))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in TEMPLATES.split(", ")])


def _predicates(batches):
    for pdf in batches:
        texts = [jcs(json.loads(p), "linker") for p in pdf["predicate"]]
        yield pdf.assign(canonical=texts, asked=[_marked(t, ["result"]) for t in texts])


def _filled(template: Column, args: Column) -> Column:
    """The template with every mark replaced by the argument of its number."""
    return F.when(F.size(args) > 0, F.aggregate(F.sequence(F.lit(0), F.size(args) - 1), template, lambda t, i: F.replace(t, F.concat(F.lit(OPEN), i.cast("string"), F.lit(CLOSE)), F.get(args, i)))).otherwise(template)


def values(nodes: DataFrame, contracts: DataFrame) -> DataFrame:
    """(term, name, value, pre, why) of the root of every term.

    Nodes have term, node, parent (null at a root), pos, depth (0 at a root), name and
    text: a leaf has its canonical JSON as text, a call has name. In an argument
    a call without a contract, or whose contract gives its result no term, is a
    constructor. A refusal or fault of an argument is the call's, first argument first. ``pre`` is
    the root's own precondition with its arguments; those of arguments do not count.
    """
    given = {"slots": "array<string>", "pre": "string", "post": "string", "result": "string", "unresolved_call": "string", "opaque_loop": "string"}
    whole = contracts.select("op", *[F.col(c) if c in contracts.columns else F.lit(None).cast(t).alias(c) for c, t in given.items()])
    known = kept(whole.dropDuplicates(["op"]).mapInPandas(_templates, TEMPLATES))
    nodes = kept(nodes.select("term", "node", "parent", "pos", "depth", "name", "text"))
    rules = known.select(F.col("op").alias("name"), F.col("n").alias("_n"), F.col("value").alias("_value"), F.col("pre").alias("_pre"), F.col("why").alias("_why"), F.lit(True).alias("_known"))
    below, depth = None, nodes.agg(F.max("depth")).first()[0]
    while depth is not None and depth >= 0:
        here = nodes.filter(F.col("depth") == depth)
        if below is None:
            met = here.withColumns({"args": F.expr("cast(array() as array<string>)"), "_bad": F.lit(None).cast("string")})
        else:
            order = F.array_sort(F.collect_list(F.struct("pos", "value", "why")))
            args = below.groupBy("term", F.col("parent").alias("node")).agg(order.alias("_a"))
            args = args.select("term", "node", F.transform("_a", lambda x: x["value"]).alias("args"), F.get(F.filter(F.transform("_a", lambda x: x["why"]), lambda w: w.isNotNull()), F.lit(0)).alias("_bad"))
            met = here.join(args, ["term", "node"], "left").withColumn("args", F.coalesce("args", F.expr("cast(array() as array<string>)")))
        met = looked_up(met, rules, ["name"])
        root, n = F.lit(depth == 0), F.size("args")
        fault = (
            F.when(F.col("name").isNull(), None)
            .when(root & F.col("_known").isNull(), "opaque-call")
            .when(F.col("_known").isNull(), F.col("_bad"))
            .when(F.col("_why").isin("opaque-call") | root & F.col("_why").isin("opaque-loop"), F.col("_why"))
            .when(F.col("_n") != n, "arity")
            .when(F.col("_bad").isNotNull(), F.col("_bad"))
            .when((F.col("_why") == "binder") | root & (F.col("_why") == "no-rule"), F.col("_why"))
        )
        bare = F.concat(F.lit('{"args":['), F.array_join("args", ","), F.lit('],"kind":"ctor","name":'), quoted(F.col("name")), F.lit("}"))
        value = F.when(F.col("name").isNull(), F.col("text")).when(F.col("_value").isNotNull(), _filled(F.col("_value"), F.col("args"))).otherwise(bare)
        made = met.withColumn("why", fault).select("term", "parent", "pos", "name", F.when(F.col("why").isNull(), value).alias("value"), F.when(F.col("why").isNull(), _filled(F.col("_pre"), F.col("args"))).alias("pre"), "why")
        below, depth = kept(made), depth - 1
    if below is None:
        return nodes.select("term", "name", F.col("text").alias("value"), F.col("text").alias("pre"), F.col("text").alias("why"))
    return below.select("term", "name", "value", "pre", "why")


def weakest(nodes: DataFrame, contracts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence (term, predicate, ...) with ``wp``, or ``why`` there is none: the root's precondition and the predicate with the root's value for ``result``.

    A predicate with a quantifier is refused as ``binder`` if the value has variables
    that it could catch, that is, unless it does not speak of the result.
    """
    own = [c for c in evidence.columns if c != "predicate"]
    asked = evidence.select("predicate").distinct().mapInPandas(_predicates, "predicate string, canonical string, asked string")
    met = evidence.select("term", "predicate").distinct().join(sent(kept(asked)), "predicate").join(values(nodes, contracts), "term", "left")  # each term and predicate once
    put = F.replace(F.col("asked"), F.lit(f"{OPEN}0{CLOSE}"), F.col("value"))
    both = F.when(F.col("pre").isNull(), put).otherwise(F.concat(F.lit('{"kind":"and","operands":['), "pre", F.lit(","), put, F.lit("]}")))
    why = F.when(F.col("value").isNull() & F.col("why").isNull(), "no-term").when(F.col("why").isNotNull(), F.col("why")).when(F.col("asked").isNull(), "binder")
    met = met.withColumn("why", why).select(F.col("term").alias("_term"), F.col("predicate").alias("_asked"), "canonical", F.when(F.col("why").isNull(), both).alias("wp"), "why")
    met = sent(kept(met), 100_000)
    out = evidence.join(met, evidence["term"].eqNullSafe(met["_term"]) & (evidence["predicate"] == met["_asked"]))
    return out.select(*[F.col("canonical").alias(c) if c == "predicate" else F.col(c) for c in [*own, "predicate"]], "wp", "why")


def compound(nodes: DataFrame, contracts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence (term, predicate, compound, ...) with ``verdict``: exact where the wp is the predicate itself, lossy where it is not, refuse, or error where a contract is at fault.

    :func:`claims.verdict_conjunction` makes one verdict of a compound of them.
    """
    verdict = F.when(F.col("why").isin(*REFUSED), "refuse").when(F.col("why").isNotNull(), "error").when(F.col("wp") == F.col("predicate"), "exact").otherwise("lossy")
    return weakest(nodes, contracts, evidence).withColumn("verdict", verdict)
