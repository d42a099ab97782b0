"""Operators over a pool of members (cid, body, load_seq): claims, witnesses, sites, ledgers, obligations."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import formula, udfs
from . import sets
from .graph import kept, sent
from .linking import looked_up


def contracts(members: DataFrame) -> DataFrame:
    """(cid, name, pre, post, inv, load_seq) of the contracts of a pool; formulas are JSON text."""
    own = members.filter(C.member_kind(F.col("body")) == "contract")
    return own.select("cid", C.contract_name(F.col("body")).alias("name"), *[C.body_field(F.col("body"), f).alias(f) for f in ("pre", "post", "inv")], "load_seq")


def direct_formula_claims(members: DataFrame) -> DataFrame:
    """(property_cid, property_name, formula) of contracts whose invariant is an obligation and an object."""
    body = C.member_body(F.col("body"))
    field = lambda f: F.get_json_object(body, f"$.{f}")
    found = members.filter((C.member_kind(F.col("body")) == "contract") & (field("invVerification") == "obligation") & field("inv").startswith("{"))
    return found.select(F.col("cid").alias("property_cid"), F.coalesce(field("name"), field("contractName"), F.lit("<unnamed>")).alias("property_name"), field("inv").alias("formula"))


def witness_members(members: DataFrame) -> DataFrame:
    """Members that an execution witness settles."""
    return members.filter(C.is_witness_member(F.col("body")))


def has_witnesses(members: DataFrame) -> DataFrame:
    """One row: whether the pool holds a witness."""
    return members.agg(F.coalesce(F.max(C.is_witness_member(F.col("body"))), F.lit(False)).alias("has_witnesses"))


def by_formula(formulas: DataFrame, facts: DataFrame, members: DataFrame) -> DataFrame:
    """Formula ids with the member that proves each: the first fact of a formula, then its member."""
    first = facts.groupBy("formula_cid").agg(F.min_by("cid", "load_seq").alias("cid"))
    return looked_up(looked_up(formulas, first, ["formula_cid"]), members.select("cid", "body"), ["cid"])


def panic_loci(sites: DataFrame, loci: DataFrame) -> DataFrame:
    """Sites (callee, arg_term) with the first locus of the same callee and argument; a site without an argument has none."""
    first = loci.filter("arg_term is not null").groupBy("callee", "arg_term").agg(F.min_by("locus", "load_seq").alias("locus"))
    asks = sites.filter("arg_term is not null").join(first, ["callee", "arg_term"], "left")
    return asks.unionByName(sites.filter("arg_term is null"), allowMissingColumns=True)


def attribute_safety(sites: DataFrame, shapes: DataFrame) -> DataFrame:
    """Sites (receiver_class, attribute, arg_term, guards) with ``status`` and ``reason``.

    ``arg_term`` is the access as a term, ``python:attribute`` of the receiver and the
    attribute's name; an argument of another form or another attribute is malformed.
    A guard discharges if it is the fact that this receiver's term has the attribute;
    the same attribute of another receiver is not. Else the shape (class_name, attribute,
    and closed if given) of a closed class does. Terms and guards are canonical JSON.
    """
    attribute, term = F.col("attribute"), F.col("arg_term")
    there = shapes if "closed" not in shapes.columns else shapes.filter("closed")
    classes = there.select(F.col("class_name").alias("receiver_class"), F.lit(True).alias("_shape")).distinct()
    own = there.select(F.col("class_name").alias("receiver_class"), "attribute", F.lit(True).alias("_own")).distinct()
    path = lambda p: F.get_json_object(term, p)
    fits = (path("$.kind") == "ctor") & (path("$.name") == "python:attribute") & (path("$.args[1].value") == attribute) & path("$.args[0]").isNotNull() & path("$.args[2]").isNull()
    quoted = F.to_json(F.array(attribute))
    quoted = quoted.substr(F.lit(2), F.length(quoted) - 2)
    needed = F.concat(F.lit('{"args":['), path("$.args[0]"), F.lit(',{"kind":"const","sort":{"kind":"primitive","name":"String"},"value":'), quoted, F.lit('}],"kind":"atomic","name":"attribute_present"}'))
    met = sites.join(classes, "receiver_class", "left").join(own, ["receiver_class", "attribute"], "left")
    false = lambda c: F.coalesce(c, F.lit(False))
    reason = (
        F.when(F.coalesce(F.col("receiver_class") == "", F.lit(True)), "unknown-class")
        .when(F.coalesce(attribute == "", F.lit(True)), "no-attribute")
        .when(~false(fits), "malformed")
        .when(false(F.array_contains("guards", needed)), "guarded")
        .when(F.col("_shape").isNull(), "no-shape")
        .when(F.col("_own"), "guaranteed")
        .otherwise("not-guaranteed")
    )
    return met.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isin("guarded", "guaranteed"), "discharged").otherwise("undecidable")).drop("_shape", "_own")


def unaccounted(buckets: DataFrame, ledger: DataFrame) -> DataFrame:
    """Reachable buckets that the ledger has no row for, in order."""
    return buckets.select("shape").distinct().join(ledger.select("shape").distinct(), "shape", "left_anti").orderBy("shape")


def census_report(census: DataFrame, ledger: DataFrame) -> DataFrame:
    """(status, n, pct) of census rows (shape, count) by the status of the ledger; a shape that it does not know has status ``unknown``."""
    status = ledger.groupBy("shape").agg(F.min("status").alias("status"))
    rows = census.join(status, "shape", "left").groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.sum("count").alias("n"))
    total = rows.agg(F.sum("n").alias("total"))
    return rows.join(total).select("status", "n", F.round(100 * F.col("n") / F.greatest("total", F.lit(1)), 2).alias("pct"))


def ledger_totals(audits: DataFrame, fields: list[str]) -> DataFrame:
    """One row: the sums of the audits' counters; what an audit lacks counts as zero."""
    return audits.agg(*[F.coalesce(F.sum(f), F.lit(0)).cast("bigint").alias(f) for f in fields])


def report_mementos(mementos: DataFrame, audits: DataFrame) -> DataFrame:
    """Source mementos whose group some audit names."""
    return mementos.join(audits.select("group").distinct(), "group", "left_semi")


def dependency_lines(packages: DataFrame) -> DataFrame:
    """Canonical lines of dependencies (name, version, source, checksum), in order, duplicates kept; their id is that of the lines joined."""
    text = F.concat_ws("\t", *[F.coalesce(c, F.lit("")) for c in ("name", "version", "source", "checksum")])
    return packages.select(text.alias("line")).orderBy("line")


def dependency_vector(packages: DataFrame) -> DataFrame:
    """One row (cid, n): the id of the sorted lines, duplicates kept, joined by line ends."""
    return sets.tree_ids(dependency_lines(packages), [], F.col("line"), F.col("line"), "", "\n", "").select("cid", "n")


def in_site_order(sites: DataFrame) -> DataFrame:
    return sites.orderBy("file", "line", "callee", "reason")


def bridge_bodies(calls: DataFrame) -> DataFrame:
    """Calls (verb, function, source_layer, target_layer, target_cid) with ``body``, the bridge's header as JSON."""
    header = F.struct(
        F.lit("bridge").alias("kind"),
        F.concat_ws(":", "verb", "source_layer", "function").alias("name"),
        F.lit("1").alias("schemaVersion"),
        F.col("target_cid").alias("sourceContractCid"),
        F.col("source_layer").alias("sourceLayer"),
        F.col("function").alias("sourceSymbol"),
        F.struct(F.col("target_cid").alias("cid"), F.lit("contract").alias("kind")).alias("target"),
        F.col("target_cid").alias("targetContractCid"),
        F.col("target_layer").alias("targetLayer"),
    )
    return calls.withColumn("body", F.to_json(header))


def implication_bodies(calls: DataFrame) -> DataFrame:
    """Calls (verb, function, params, op_cid) with ``body``: a contract whose post holds the call as a term."""
    args = F.transform("params", lambda p: F.struct(F.lit("var").alias("kind"), p.alias("name")))
    term = F.struct(args.alias("args"), F.lit("ctor").alias("kind"), F.col("function").alias("name"))
    body = F.struct(F.concat(F.col("verb"), F.lit("-callsite:"), F.col("function")).alias("contractName"), F.col("op_cid"), F.struct(F.array(term).alias("args"), F.lit("atomic").alias("kind")).alias("post"))
    return calls.withColumn("body", F.to_json(body))


def witness_discharge(claims: DataFrame, packages: DataFrame) -> DataFrame:
    """Claims (property, package, claimed) with ``verdict`` and ``reason`` from outcomes (package, test, passed).

    A package that no outcome resolves, or whose number of outcomes is not what
    is claimed, is refused; failed outcomes refute; only all passed discharge.
    """
    found = packages.groupBy("package").agg(F.count("*").alias("n"), F.count_if(~F.col("passed")).alias("failed"), F.min(F.when(~F.col("passed"), F.col("test"))).alias("first_failed"))
    met = looked_up(claims, found, ["package"])
    reason = F.when(F.col("package").isNull(), "no-package").when(F.col("n").isNull(), "unresolved").when(F.col("n") != F.col("claimed"), "count-differs").when(F.col("failed") > 0, "failed-outcomes").otherwise("all-passed")
    verdict = F.when(reason == "all-passed", "discharged").when(reason == "no-package", "undecidable").otherwise("unsatisfied")
    return met.select("property", "package", verdict.alias("verdict"), reason.alias("reason"), "first_failed")


def rerun_discharge(pins: DataFrame, runs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Pins (suite, pinned) with ``verdict`` and ``reason`` from a suite or a build that ran again.

    Runs (suite, cid) hold the recomputed id, outcomes (suite, test, outcome) its
    parts. A pin that did not run or whose id differs is refused, then one with
    an outcome other than passed. ``n_tests``, ``n_failed`` and the least
    ``first_failed`` come along. Of repeated runs of a suite the least id counts.
    """
    run = runs.filter("suite is not null").groupBy("suite").agg(F.min("cid").alias("_cid"))
    failed = F.coalesce(F.col("outcome") != "passed", F.lit(True))
    parts = outcomes.filter("suite is not null").groupBy("suite").agg(F.count("*").alias("n_tests"), F.count_if(failed).alias("n_failed"), F.min(F.when(failed, F.col("test"))).alias("first_failed"))
    met = pins.join(run, "suite", "left").join(parts, "suite", "left").fillna(0, ["n_tests", "n_failed"])
    reason = F.when(F.col("_cid").isNull(), "not-run").when(~F.col("_cid").eqNullSafe(F.col("pinned")), "not-reproduced").when(F.col("n_failed") > 0, "failed-outcomes").otherwise("reproduced")
    return met.select("suite", "pinned", F.when(reason == "reproduced", "discharged").otherwise("refused").alias("verdict"), reason.alias("reason"), "n_tests", "n_failed", "first_failed")


def cached_implications(pairs: DataFrame, cache: DataFrame) -> DataFrame:
    """Pairs (post_hash, pre_hash) with ``cached``: the least id of a cached implication of that property with a valid signature."""
    valid = cache.filter("valid").groupBy("post_hash", "pre_hash").agg(F.min("cid").alias("cached"))
    return pairs.join(valid, ["post_hash", "pre_hash"], "left")


#: Members of a pair that are checked before any others of it.
FIRST = 16


def verified_implications(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (post_hash, pre_hash) with ``cached`` from members (member_cid, body): implications of the pair whose property hash and signature hold.

    Signatures are costly. The least id of those that hold is asked for, so ids are checked in their order: the first
    ``FIRST`` of each pair, then all others of the pairs for which none of these holds. Property hashes are made once a pair.
    """
    head = lambda k: F.get_json_object("body", f"$.header.{k}")
    known = members.select("member_cid", "body", head("kind").alias("kind"), head("antecedentHash").alias("post_hash"), head("consequentHash").alias("pre_hash"), head("propertyHash").alias("property"))
    pair = ["post_hash", "pre_hash"]
    asked = kept(pairs.select(*pair).dropna().distinct().withColumn("property", udfs.implication_hash(*pair)))
    met = known.filter("kind = 'implication' and member_cid is not null").join(sent(asked), [*pair, "property"], "left_semi")
    ids = met.select(*pair, "member_cid").distinct()
    first = kept(ids.withColumn("_n", F.row_number().over(Window.partitionBy(*pair).orderBy("member_cid"))).filter(F.col("_n") <= FIRST + 1))
    begun = first.filter(F.col("_n") <= FIRST).drop("_n")
    checked = lambda rows: rows.select(*pair, F.col("member_cid").alias("cid"), F.coalesce(udfs.signed("body"), F.lit(False)).alias("valid"))
    spread = lambda rows: rows.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cache = kept(checked(spread(met.join(sent(begun), [*pair, "member_cid"], "left_semi").select(*pair, "member_cid", "body").distinct())))
    more = first.filter(F.col("_n") > FIRST).select(*pair).join(cache.filter("valid").select(*pair).distinct(), pair, "left_anti")
    if not more.isEmpty():
        rest = met.join(sent(more), pair, "left_semi").join(sent(begun), [*pair, "member_cid"], "left_anti").select(*pair, "member_cid", "body").distinct()
        cache = cache.unionByName(kept(checked(spread(rest))))
    return cached_implications(pairs, cache)


def annotations(rows: DataFrame) -> DataFrame:
    """Indexed annotations (file, line, callee, category, load_seq, error): the first of a place; where any did not load, only the errors."""
    first = rows.filter("error is null").groupBy("file", "line", "callee").agg(F.min_by("category", "load_seq").alias("category"))
    bad = rows.agg(F.count("error").alias("n_errors"))
    errors = rows.filter("error is not null").select("file", "line", "callee", F.lit(None).cast("string").alias("category"), "error")
    return first.withColumn("error", F.lit(None).cast("string")).join(bad).filter("n_errors = 0").drop("n_errors").unionByName(errors)


def coalesce_declarations(declarations: DataFrame) -> DataFrame:
    """Declarations (name, pos, pre, post, inv) with those of one name that only have an invariant conjoined.

    ``inv`` becomes the operands in the order they came, each once; other
    declarations pass as they are. (name, pos, pre, post, invs)
    """
    only = F.col("pre").isNull() & F.col("post").isNull() & F.col("inv").isNotNull()
    first = declarations.filter(only).groupBy("name", "inv").agg(F.min("pos").alias("pos"))
    joined = first.groupBy("name").agg(F.min("pos").alias("pos"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "inv"))), lambda x: x["inv"]).alias("invs"))
    null = F.lit(None).cast("string")
    rest = declarations.filter(~only).select("name", "pos", "pre", "post", F.when(F.col("inv").isNotNull(), F.array("inv")).otherwise(F.expr("cast(array() as array<string>)")).alias("invs"))
    return joined.select("name", "pos", null.alias("pre"), null.alias("post"), "invs").unionByName(rest)


def self_posts(rows: DataFrame, solve) -> DataFrame:
    """Rows (cid, post) to (cid, verdict, method): the post with ``result`` replaced by the term that it equals must be valid.

    Posts without such a term have no obligation and no row. ``solve`` decides a formula.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for cid, post in zip(pdf["cid"], pdf["post"], strict=True):
                tree = json.loads(post) if post else None
                term = formula.result_equation(tree, "result") if tree else None
                if term is not None:
                    obligation = formula.substitute(tree, "result", term)
                    verdict = solve(obligation)
                    out.append((cid, verdict, formula.discharge_method(obligation) if verdict == "discharged" else None))
            yield pd.DataFrame(out, columns=["cid", "verdict", "method"])

    return rows.select("cid", "post").mapInPandas(run, "cid string, verdict string, method string")
