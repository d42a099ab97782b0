"""Body obligations: calls in an equation are replaced by the bodies of what they call, level by level.

A level asks for the bodies of all calls that the terms hold, in one join, and
puts them in. The calls that a body brings are the next level's. Every call
knows the calls it came through, so one that comes back to itself is found when
it is met, whatever way it took.
"""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formula
from ..functions.canon import jcs
from . import decide
from .graph import dropped, kept, sent
from .linking import looked_up

VIA = "$via"
#: Names of variables and ops that no formula has: no text is taken for a template that holds one.
ACTUAL = "\1actual:"
#: The number of a fate that is told only level by level.
OPEN = -1


def _body(found: dict) -> tuple[list[str], dict | None, str | None]:
    """Formals and value of a contract, or why its value cannot stand for the call."""
    post = json.loads(found["post"]) if found["post"] else None
    value = formula.result_equation(post, "result") if post is not None else None
    if found["pre"] and not formula.is_true(json.loads(found["pre"])):
        return found["formals"], None, "pre-bearing"
    return found["formals"], value, None if value is not None else "no-value"


def _applied(op: str, formals: list[str], value: dict, args: list, via: list[str]) -> dict:
    """The value with actuals for formals, all at once: formals get names first that no actual has."""
    fresh = [f"\0{i}" for i in range(len(formals))]
    for name, new in zip(formals, fresh, strict=True):
        value = formula.substitute(value, name, formula.var(new))
    value = _marked(value, [*via, op])
    for new, a in zip(fresh, args, strict=True):
        value = formula.substitute(value, new, a)
    return value


def _marked(t, via: list[str]):
    if isinstance(t, list):
        return [_marked(x, via) for x in t]
    if not isinstance(t, dict):
        return t
    out = {k: _marked(v, via) if isinstance(v, dict | list) and k != "sort" else v for k, v in t.items()}
    return out | {VIA: via} if t.get("kind") == "ctor" else out


def _plain(t, work_out: bool):
    """A term without marks, and if asked with sums and products of numbers worked out."""
    if isinstance(t, list):
        return [_plain(x, work_out) for x in t]
    if not isinstance(t, dict):
        return t
    out = {k: _plain(v, work_out) if isinstance(v, dict | list) and k != "sort" else v for k, v in t.items() if k != VIA}
    args = out.get("args") or []
    if work_out and out.get("kind") == "ctor" and out.get("name") in ("+", "-", "*") and len(args) == 2 and all(a.get("kind") == "const" and type(a.get("value")) is int for a in args):
        a, b = (x["value"] for x in args)
        return {"kind": "const", "value": {"+": a + b, "-": a - b, "*": a * b}[out["name"]]}
    return out


class _Refused(Exception):
    pass


def _expand(t, known: dict):
    """One level: every call with a body, innermost first."""
    if isinstance(t, list):
        return [_expand(x, known) for x in t]
    if not isinstance(t, dict):
        return t
    out = {k: _expand(v, known) if isinstance(v, dict | list) and k not in ("sort", VIA) else v for k, v in t.items()}
    if out.get("kind") != "ctor" or out.get("name") not in known:
        return out
    op, via = out["name"], out.get(VIA) or []
    if op in via:
        raise _Refused("recursive")
    formals, value, why = known[op]
    if why:
        raise _Refused(why)
    args = out.get("args") or []
    if len(args) != len(formals):
        raise _Refused("arity")
    return _applied(op, formals, value, args, via)


def _tier(f: dict, known: dict) -> str | None:
    """How the calls stand in an equation; None if the formula is no equation."""
    sides = f.get("args") or []
    if f.get("kind") != "atomic" or f.get("name") != "=" or len(sides) != 2:
        return None
    heads = [s.get("name") if s.get("kind") == "ctor" and s.get("name") in known else None for s in sides]
    return "body-eq-nested-call" if heads == [None, None] else "body-eq-same-callee" if heads[0] == heads[1] else "body-call-expected"


STATE = "id string, formula string, tier string, reason string, again boolean"


def _level(batches):
    names = [c.split()[0] for c in STATE.split(", ")]
    for pdf in batches:
        out = []
        for i, text, tier, bodies in zip(pdf["id"], pdf["formula"], pdf["tier"], pdf["bodies"], strict=True):
            reason, again = None, False
            try:
                known = {b["op"]: _body(b) for b in (bodies if bodies is not None else [])}
                f = json.loads(text)
                if not known:
                    reason = None if tier else "not-body-bearing"
                elif (tier := tier or _tier(f, known)) is None:
                    reason = "shape"
                else:
                    text, again = jcs(_expand(f, known), "linker"), True
            except _Refused as e:
                reason = str(e)
            except (ValueError, TypeError, AttributeError, KeyError):
                reason = "malformed"
            out.append((i, text, tier, reason, again))
        yield pd.DataFrame(out, columns=names)


def _calls(batches):
    for pdf in batches:
        rows = []
        for i, text in zip(pdf["id"], pdf["formula"], strict=True):
            try:
                rows += [(i, n) for n in {n for n in formula.constructor_names(text) if isinstance(n, str)}]
            except (ValueError, TypeError, AttributeError):
                pass
        yield pd.DataFrame(rows, columns=["id", "op"])


def _ended(batches):
    for pdf in batches:
        trees = [json.loads(t) if why is None else None for t, why in zip(pdf["formula"], pdf["reason"], strict=True)]
        made = [jcs(_plain(t, True), "linker") if t is not None else None for t in trees]
        how = [formula.discharge_method(_plain(t, False)) if t is not None else None for t in trees]
        yield pd.DataFrame({"id": pdf["id"], "tier": pdf["tier"], "reason": pdf["reason"], "reduced": pd.Series(made, dtype=object), "method": pd.Series(how, dtype=object)})


def _levels(active: DataFrame, one: DataFrame) -> list[DataFrame]:
    """Formulas (id, formula) that ended, by the level at which they did."""
    active = kept(active.select("id", "formula", F.lit(None).cast("string").alias("tier")))
    done = []
    while True:
        asked = active.select("id", "formula").mapInPandas(_calls, "id string, op string").join(one, "op").groupBy("id").agg(F.collect_list("body").alias("bodies"))
        state = kept(active.join(asked, "id", "left").select("id", "formula", "tier", "bodies").mapInPandas(_level, STATE))
        done.append(state.filter("not again"))
        active = state.filter("again")
        if active.isEmpty():
            return done


def _asked_of_itself(batches):
    """Each op as an equation of a call with marked actuals; ops without formals are left out."""
    for pdf in batches:
        rows = []
        for op, formals in zip(pdf["op"], pdf["formals"], strict=True):
            if formals is not None and all(f is not None for f in formals):
                call = {"kind": "ctor", "name": op, "args": [formula.var(f"{ACTUAL}{i}") for i in range(len(formals))]}
                rows.append((op, len(formals), jcs(formula.atom("=", call, {"kind": "const", "value": 0}), "linker")))
        yield pd.DataFrame(rows, columns=["op", "n", "formula"])


def _closed(batches):
    """What a call comes to, as a text that calls of equal fate share; none where a formula must go level by level."""
    for pdf in batches:
        out = []
        for op, n, text, reason, level in zip(pdf["op"], pdf["n"], pdf["formula"], pdf["reason"], pdf["level"], strict=True):
            value = None
            if reason is None:
                value = _plain(json.loads(text)["args"][0], False)
                if any(x.get("kind") in (*formula.BINDERS, "lambda", "choice", "let") for x in formula.nodes(value)):
                    continue
            out.append((op, json.dumps({"n": n, "value": value, "why": reason, "at_once": bool(level == 0)}, sort_keys=True)))
        yield pd.DataFrame(out, columns=["op", "fate"])


def _fates(one: DataFrame) -> DataFrame:
    """(op, fate): bodies with all their calls replaced, each worked out once."""
    rows = kept(one.select("op", "body.formals").mapInPandas(_asked_of_itself, "op string, n int, formula string"))
    done = [d.withColumn("level", F.lit(n)) for n, d in enumerate(_levels(rows.select(F.col("op").alias("id"), "formula"), one))]
    ended = reduce(DataFrame.unionByName, done).select(F.col("id").alias("op"), "formula", "reason", "level")
    return kept(rows.select("op", "n").join(ended, "op").mapInPandas(_closed, "op string, fate string"))


#: A formula's own names and numbers, as :func:`formula.template` and :func:`formula.holes_of` find them.
NAME, NUMBER = formula._NAME.pattern, formula._NUMBER.pattern
#: Stands between labels of names; no name has it.
BETWEEN = "\x1f"
#: A name without a body, as a number of a fate.
BARE = -2
#: Rows with texts that are sent along at most.
TEXTS = 100_000


def _holes(batches):
    """Shapes of formulas with the holes that are names of calls; none where the shape could be read in another way."""
    for pdf in batches:
        out = []
        for number, shape in zip(pdf["shape_number"], pdf["shape"], strict=True):
            try:
                found = formula.constructor_holes(shape)
                holes = sorted(set(found)) if all(type(h) is int for h in found) else None
            except (ValueError, TypeError, AttributeError, RecursionError):
                holes = None
            out.append((number, shape, holes))
        yield pd.DataFrame(out, columns=["shape_number", "shape", "holes"])


def _known(batches):
    """Forms whose calls have fates: kind, tier, reason, reduced, method, and whether they must go level by level."""
    for pdf in batches:
        out = []
        for kind, text, labels, fates, bares, texts in zip(pdf["kind"], pdf["template"], pdf["labels"], pdf["fates"], pdf["bares"], pdf["texts"], strict=True):
            texts, names, known = dict(texts) if texts is not None else {}, [], {}
            own = labels.split(BETWEEN) if labels else []
            asked = list(dict.fromkeys(x for x in own if x.startswith("asked:")))
            for x in own:
                how, _, rest = x.partition(":")
                at, number, name = rest.split(":", 2) if how == "fate" else (rest, fates[asked.index(x)], bares[asked.index(x)]) if how == "asked" else (None, BARE, rest)
                if int(number) == BARE:
                    names.append(name)
                else:
                    names.append(f"{ACTUAL}op{at}")
                    known[names[-1]] = json.loads(texts[int(number)]) if int(number) != OPEN else None
            tier = reason = made = method = None
            again = None in known.values()
            try:
                if not known:
                    reason = "not-body-bearing"
                elif not again:
                    f = json.loads(formula.filled(text, names))
                    tier = _tier(f, known)
                    if any(k["why"] == "malformed" and k["at_once"] for k in known.values()):
                        tier, reason = None, "malformed"
                    elif tier is None:
                        reason = "shape"
                    else:
                        done = json.loads(jcs(_put(f, known), "linker"))
                        late = {k["why"] for k in known.values()} - {None}
                        again = bool(late) and len(known) > 1
                        if late:
                            reason = late.pop()
                        else:
                            made, method = jcs(_plain(done, True), "linker"), formula.discharge_method(_plain(done, False))
            except _Refused as e:
                reason = str(e)
            except (ValueError, TypeError, AttributeError, KeyError, RecursionError):
                again = True
            out.append((kind, tier, reason, made, method, again))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in KNOWN.split(", ")])


KNOWN = "kind bigint, tier string, reason string, reduced string, method string, again boolean"


def _put(t, known: dict):
    """All calls with fates replaced by what they come to, innermost first."""
    if isinstance(t, list):
        return [_put(x, known) for x in t]
    if not isinstance(t, dict):
        return t
    out = {k: _put(v, known) if isinstance(v, dict | list) and k != "sort" else v for k, v in t.items()}
    if out.get("kind") != "ctor" or out.get("name") not in known:
        return out
    fate, args = known[out["name"]], out.get("args") or []
    if fate["why"] and fate["at_once"]:
        raise _Refused(fate["why"])
    if len(args) != fate["n"]:
        raise _Refused("arity")
    return out if fate["why"] else _filled(fate["value"], args)


def _filled(t, args: list):
    if isinstance(t, list):
        return [_filled(x, args) for x in t]
    if not isinstance(t, dict):
        return t
    if t.get("kind") == "var" and isinstance(t.get("name"), str) and t["name"].startswith(ACTUAL):
        return args[int(t["name"][len(ACTUAL) :])]
    return {k: _filled(v, args) if isinstance(v, dict | list) and k != "sort" else v for k, v in t.items()}


def _read(rows: DataFrame, text: str, fates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with ``form``, ``asks`` and ``fates`` in place of the formula, and (form, template, labels). A formula that is no plain JSON stays as ``odd``.

    A form is a formula without the names of those calls that change from row to row; these are ``asks``, and are looked
    up one after another. Calls that are the same in all formulas of a shape are looked up once.
    """
    t = F.col(text)
    plain = t.isNotNull() & ~t.contains("\\") & ~t.contains(formula._HOLE)
    own = [c for c in rows.columns if c != text]
    read = rows.withColumn("template", F.when(plain, F.regexp_replace(t, NAME, formula._HOLE)))
    read = kept(read.select(*own, F.when(~plain, t).alias("odd"), "template", F.regexp_replace("template", NUMBER, '"value":0').alias("shape"), F.when(plain, F.regexp_extract_all(t, F.lit(NAME), F.lit(1))).alias("names")))
    shapes = read.select("shape").filter("shape is not null").distinct().select(F.monotonically_increasing_id().alias("shape_number"), "shape")
    shapes = kept(shapes.mapInPandas(_holes, "shape_number bigint, shape string, holes array<int>"))
    met = read.join(sent(shapes, TEXTS), "shape", "left")
    each = met.select("shape_number", "names", F.explode("holes").alias("at")).select("shape_number", "at", F.xxhash64(F.get("names", F.col("at"))).alias("h"))
    one = each.groupBy("shape_number", "at").agg(F.min("h").alias("h"), F.max("h").alias("other")).filter("h = other")
    same = kept(one.groupBy("shape_number").agg(F.collect_set("at").alias("same"), F.collect_set("h").alias("hashes")))
    # all bodies of such a name's hash are told of, so a name that is not among them has none
    hashed = same.select("shape_number", F.explode("hashes").alias("h")).join(fates.select(F.xxhash64("op").alias("h"), "op", "number"), "h")
    same = same.select("shape_number", "same").join(hashed.groupBy("shape_number").agg(F.map_from_entries(F.collect_list(F.struct("op", "number"))).alias("told")), "shape_number", "left")
    met = met.join(sent(kept(same)), "shape_number", "left")
    first = lambda x: (F.array_position("names", x) - 1).cast("string")
    is_call, is_same = (lambda i: F.array_contains("holes", i)), lambda i: F.coalesce(F.array_contains("same", i), F.lit(False))
    known = lambda x: F.try_element_at("told", x)
    named = lambda x: F.concat(F.lit("name:"), x)
    label = lambda x, i: F.when(~is_call(i), named(x)).when(~is_same(i), F.concat(F.lit("asked:"), first(x))).otherwise(F.coalesce(F.concat(F.lit("fate:"), first(x), F.lit(":"), known(x).cast("string"), F.lit(":"), x), named(x)))
    asks = F.array_distinct(F.transform(F.filter("holes", lambda i: ~is_same(i)), lambda i: F.get("names", i)))
    labels = F.when(F.col("holes").isNotNull(), F.array_join(F.transform("names", label), BETWEEN))
    text_of = F.when(F.col("holes").isNull(), _rebuilt())
    met = met.select(*own, F.coalesce("odd", text_of).alias("odd"), F.when(F.col("holes").isNotNull(), F.col("template")).alias("template"), labels.alias("labels"), asks.alias("asks"))
    forms = kept(met.select("template", "labels").filter("template is not null").distinct().select(F.monotonically_increasing_id().alias("form"), "template", "labels"))
    met = kept(met.join(sent(forms, TEXTS), ["template", "labels"], "left").drop("template", "labels").withColumns({"fates": F.expr("cast(array() as array<bigint>)"), "bares": F.expr("cast(array() as array<string>)")}))
    dropped(read)
    n = 0
    while not (asking := met.filter(F.size("asks") > n)).isEmpty():
        found = looked_up(asking.withColumn("_op", F.get("asks", F.lit(n))), fates.withColumnRenamed("op", "_op"), ["_op"])
        found = found.withColumns({"fates": F.concat("fates", F.array(F.coalesce("number", F.lit(BARE)))), "bares": F.concat("bares", F.array(F.when(F.col("number").isNull(), F.col("_op")).otherwise("")))})
        done = met.filter(~F.coalesce(F.size("asks") > n, F.lit(False)))
        new = kept(found.select(met.columns).unionByName(done))
        dropped(met)
        met, n = new, n + 1
    return met, forms


def _rebuilt() -> Column:
    """The text of a formula from its template and names."""
    parts = F.split("template", formula._HOLE)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit('"name":"'), F.get("names", i - 1), F.lit('"'), p))), "")


SAYS = ["tier", "reason", "reduced", "method"]


def told(rows: DataFrame, text: str, bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with ``made`` in place of their formula, and (made, tier, reason, reduced, method). A null formula has no ``made``.

    See :func:`reduced`. Rows need no ids, and travel only to the bodies of their calls.
    """
    one = bodies.filter("op is not null").groupBy("op").agg(F.min(F.struct("formals", "post", "pre")).alias("b")).select("op", F.struct("op", "b.formals", "b.post", "b.pre").alias("body"))
    one = kept(one)
    came = _fates(one)
    texts = kept(came.select("fate").distinct().withColumn("number", F.monotonically_increasing_id()))
    fates = kept(one.select("op").join(came.join(texts, "fate").select("op", "number"), "op", "left").select("op", F.coalesce("number", F.lit(OPEN)).alias("number")))
    met, forms = _read(rows, text, fates)
    own = [c for c in met.columns if c not in ("odd", "form", "asks", "fates", "bares")]
    key = ["form", "fates", "bares"]
    kinds = kept(met.filter("form is not null").select(*key).distinct().select(F.monotonically_increasing_id().alias("kind"), *key))
    shaped = kinds.join(forms, "form")
    fixed = F.transform(F.filter(F.split("labels", BETWEEN), lambda x: x.startswith("fate:")), lambda x: F.split(x, ":")[2].cast("bigint"))
    means = shaped.select("kind", F.explode(F.array_distinct(F.concat("fates", fixed))).alias("number")).join(texts, "number").groupBy("kind").agg(F.map_from_entries(F.collect_list(F.struct("number", "fate"))).alias("texts"))
    made = kept(shaped.join(means, "kind", "left").mapInPandas(_known, KNOWN))
    results = made.filter("not again").select(*SAYS).distinct()
    # formulas of which this does not tell go level by level, with their own text
    odd = met.filter("odd is not null").select(*own, F.col("odd").alias("_text"))
    again = shaped.join(made.filter("again").select("kind"), "kind")
    if not again.isEmpty():
        name = lambda x: F.when(x.startswith("name:"), F.substring(x, 6, 2**30)).when(x.startswith("fate:"), F.regexp_extract(x, "(?s)^fate:[0-9]+:-?[0-9]+:(.*)$", 1)).otherwise(F.get("asks", (F.array_position("_asked", x) - 1).cast("int")))
        again = again.withColumns({"_labels": F.split("labels", BETWEEN), "_asked": F.array_distinct(F.filter(F.split("labels", BETWEEN), lambda x: x.startswith("asked:")))}).drop("kind", "labels")
        odd = odd.unionByName(met.join(again, key).withColumn("names", F.transform("_labels", name)).select(*own, _rebuilt().alias("_text")))
    slow = None
    if not odd.isEmpty():
        asked = odd.select(F.sha2("_text", 256).alias("id"), F.col("_text").alias("formula")).distinct()
        slow = kept(reduce(DataFrame.unionByName, _levels(asked, one)).mapInPandas(_ended, "id string, tier string, reason string, reduced string, method string"))
        results = results.unionByName(slow.select(*SAYS)).distinct()
    results = kept(results.select(F.monotonically_increasing_id().alias("made"), *SAYS))
    same = lambda df: reduce(lambda x, y: x & y, [df[c].eqNullSafe(results[c]) for c in SAYS])
    which = kept(made.filter("not again").join(results, same(made)).select("kind", "made").join(kinds, "kind").drop("kind"))
    out = met.filter("odd is null").join(sent(which), key, "left")
    if slow is not None:
        out = out.join(sent(made.filter("again").join(kinds, "kind").select(*key)), key, "left_anti")
        how = kept(slow.join(results, same(slow)).select(F.col("id").alias("_id"), "made"))
        out = out.select(*own, "made").unionByName(odd.withColumn("_id", F.sha2("_text", 256)).join(how, "_id").select(*own, "made"))
    return out.select(*own, "made"), results


def reduced(obligations: DataFrame, bodies: DataFrame) -> DataFrame:
    """Formulas (id, formula) with calls replaced by bodies: id, tier, reason, reduced, method.

    Bodies have op, formals, post and pre; of several of one op the least counts. A
    formula without a call that has a body is ``not-body-bearing``. One that has
    is reduced or refused, never passed over: ``shape`` (no equation),
    ``recursive``, ``pre-bearing`` (a body's value would drop the precondition),
    ``no-value`` (its post gives the result no term), ``arity`` or ``malformed``.

    Bodies are followed level by level, each once. Formulas that are equal but for calls
    of equal fate are reduced once. Those with binders in bodies, with several calls of which one is refused
    on a later level, or that are no plain JSON go level by level themselves.
    """
    rows, results = told(obligations.select("id", "formula"), "formula", bodies)
    out = rows.join(sent(results, TEXTS), "made", "left")
    return out.withColumn("reason", F.when(F.col("made").isNull(), "malformed").otherwise(F.col("reason"))).drop("made")


def body_obligations(obligations: DataFrame, bodies: DataFrame) -> DataFrame:
    """Obligations (id, formula) with tier, reason, method and status; what formulas come to is decided once.

    A reduced equation of a term with itself is discharged as ``reflexive``; others go to the
    decision procedure without assumptions: discharged (``solver-substantive``),
    unsatisfied or undecidable. Refusals are ``refused``; formulas without a body are ``open``.
    """
    rows, made = told(obligations, "formula", bodies)
    made = made.withColumn("_asks", F.when(F.expr("reason is null and method != 'reflexive'"), F.sha2("reduced", 256)))
    open_ = made.filter("_asks is not null").groupBy(F.col("_asks").alias("id")).agg(F.first("reduced").alias("pre"))  # equal in a group
    verdicts = decide.implications(open_.select("id", F.lit('{"kind":"and","operands":[]}').alias("post"), "pre")).withColumnRenamed("id", "_asks")
    found = looked_up(made.drop("reduced"), verdicts, ["_asks"])
    status = (
        F.when(F.col("reason") == "not-body-bearing", "open")
        .when(F.col("reason").isNotNull(), "refused")
        .when((F.col("method") == "reflexive") | (F.col("verdict") == "implied"), "discharged")
        .when(F.col("verdict") == "refuted", "unsatisfied")
        .otherwise("undecidable")
    )
    found = kept(found.select("made", "tier", "reason", F.when(status == "discharged", F.col("method")).alias("method"), status.alias("status")))
    return rows.join(sent(found), "made", "left").drop("made")


def post_facts(callsites: DataFrame, by_symbol: DataFrame, by_site: DataFrame, contracts: DataFrame) -> DataFrame:
    """Call sites with ``fact``, the guard that the post of the argument's own callee gives, or ``why`` there is none.

    Sites have arg_term (JSON), panic_site, bundle_cid, file, line; producer_file,
    producer_line and producer_symbol may name another place. The callee's contract
    is that of its symbol's bridge; at a panic site it is that of the bridge at
    the very place, and no other will do. Only a post that is one predicate of
    ``result`` alone gives a fact: the same predicate of the argument.
    """
    names = "file line symbol".split()
    sites = callsites.withColumns({f"producer_{n}": F.lit(None).cast("bigint" if n == "line" else "string") for n in names if f"producer_{n}" not in callsites.columns})
    kind, name = F.get_json_object("arg_term", "$.kind"), F.get_json_object("arg_term", "$.name")
    place = {"_file": F.coalesce("producer_file", "file"), "_line": F.coalesce("producer_line", "line").cast("bigint"), "_symbol": F.when(kind == "ctor", name)}
    keyed = sites.withColumns(place)
    symbol = by_symbol.select(F.col("symbol").alias("_symbol"), F.col("target").alias("_general"))
    site = by_site.select(F.col("bundle_cid"), F.col("file").alias("_file"), F.col("line").cast("bigint").alias("_line"), F.col("symbol").alias("_symbol"), F.col("target").alias("_own"))
    panic = F.coalesce("panic_site", F.lit(False))
    general = keyed.filter(~panic).join(symbol, "_symbol", "left").withColumn("_target", F.col("_general")).drop("_general")
    own = keyed.filter(panic).join(site, ["bundle_cid", "_file", "_line", "_symbol"], "left").withColumn("_target", F.col("_own")).drop("_own")
    posts = contracts.groupBy(F.col("contract_cid").alias("_target")).agg(F.min("post").alias("_post"))
    met = general.unionByName(own).join(posts, "_target", "left")
    predicate = F.get_json_object("_post", "$.name")
    single = (F.get_json_object("_post", "$.kind") == "atomic") & (F.get_json_object("_post", "$.args[0].kind") == "var") & (F.get_json_object("_post", "$.args[0].name") == "result") & F.get_json_object("_post", "$.args[1]").isNull()
    false = lambda c: F.coalesce(c, F.lit(False))
    why = (
        F.when(F.col("_symbol").isNull(), "no-call")
        .when(panic & false(F.col("producer_symbol") != F.col("_symbol")), "other-producer")
        .when(F.col("_target").isNull(), "no-bridge")
        .when(F.col("_post").isNull(), "no-post")
        .when(~false(single), "not-single")
    )
    fact = F.concat(F.lit('{"args":['), F.col("arg_term"), F.lit('],"kind":"atomic","name":'), F.to_json(F.struct(predicate.alias("n"))).substr(F.lit(6), F.length(F.to_json(F.struct(predicate.alias("n")))) - 6), F.lit("}"))
    return met.withColumn("why", why).withColumn("fact", F.when(F.col("why").isNull(), fact)).drop("_file", "_line", "_symbol", "_target", "_post")
