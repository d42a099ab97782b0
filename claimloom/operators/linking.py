"""Resolution of calls to contracts, and link obligations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def looked_up(rows: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on columns of both, in one pass over ``rows``: those with a null key meet nothing, and are dealt out by their other columns instead of meeting in one task."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    zero = F.pmod(F.xxhash64(*keys), F.lit(1))  # no literal: Spark would move a literal into the condition and deal out by the keys alone
    told = [f.name for f in rows.schema if "map<" not in f.dataType.simpleString()]  # maps have no hash
    salted = rows.withColumn("_salt", F.when(whole, 0).otherwise(1 + F.pmod(F.xxhash64(*told), F.lit(4096))).cast("int"))
    return salted.join(right.withColumn("_salt", zero.cast("int")), [*keys, "_salt"], "left").drop("_salt")


def name_index(contracts: DataFrame) -> DataFrame:
    """(kit, name) to the least contract id."""
    return contracts.groupBy("kit", "name").agg(F.min("contract_cid").alias("resolved_cid"))


def resolve(edges: DataFrame, contracts: DataFrame) -> DataFrame:
    """Edges with ``resolved``: the direct target if given, else kit and name of the symbol. Only the latter look anything up."""
    kit, name = C.split_symbol(F.col("target_symbol"))
    asks = F.col("target_cid").isNull()
    keyed = edges.withColumns({"_kit": F.when(asks, kit), "_name": F.when(asks, name)})
    index = name_index(contracts).select(F.col("kit").alias("_kit"), F.col("name").alias("_name"), F.col("resolved_cid").alias("_found"))
    return looked_up(keyed, index, ["_kit", "_name"]).withColumn("resolved", F.coalesce("target_cid", "_found")).drop("_kit", "_name", "_found")


def verifier_edges(edges: DataFrame, contracts: DataFrame) -> DataFrame:
    """Edges as the verifier resolves them: kits are dropped, unresolved edges too."""
    index = contracts.groupBy(F.col("name").alias("_name")).agg(F.min("contract_cid").alias("by_name"))
    keyed = edges.withColumn("_name", C.verifier_name(F.col("target_symbol")))
    out = keyed.join(index, "_name", "left").withColumn("target", F.coalesce("target_cid", "by_name"))
    return out.filter(F.col("target").isNotNull()).select("source_cid", "target", "line")


def outcome() -> Column:
    """What becomes of an edge with ``resolved``, ``source_post`` and ``target_pre``."""
    return (
        F.when(F.col("resolved").isNull(), "unresolved-symbol")
        .when(F.col("source_post").isNull(), "unprovable-obligation")
        .when(F.col("target_pre").isNull(), "vacuous")
        .when(F.col("source_post") == F.col("target_pre"), "equal")
        .otherwise("needs-decision")
    )


def obligations(edges: DataFrame, contracts: DataFrame) -> DataFrame:
    """Each edge with its outcome: the caller's post is tested before the callee's pre.

    ``needs-decision`` marks implications of two different formulas. Of rows that
    share a contract id the least formula counts. Unresolved edges ask for no
    precondition.
    """
    least = contracts.groupBy("contract_cid").agg(F.min("post").alias("source_post"), F.min("pre").alias("target_pre"))
    posts = least.select(F.col("contract_cid").alias("source_cid"), "source_post")
    pres = least.select(F.col("contract_cid").alias("resolved"), "target_pre")
    joined = looked_up(looked_up(resolve(edges, contracts), posts, ["source_cid"]), pres, ["resolved"])
    return joined.withColumn("outcome", outcome())


def slot_obligations(edges: DataFrame, contracts: DataFrame) -> DataFrame:
    """As :func:`obligations`, of edges that lie in slots; they come out slot by slot.

    Edges travel twice: to what they ask for, where a symbol finds its contract
    and precondition at once, and back to their slot. There the posts of their
    sources come, once for a slot and source.
    """
    least = contracts.groupBy("contract_cid").agg(F.min("post").alias("post"), F.min("pre").alias("pre")).filter("contract_cid is not null")
    named = looked_up(name_index(contracts), least.select(F.col("contract_cid").alias("resolved_cid"), "pre"), ["resolved_cid"])
    index = named.select(F.concat(F.lit("s"), "kit").alias("_kit"), F.col("name").alias("_name"), F.col("resolved_cid").alias("_found"), F.col("pre").alias("target_pre"))
    index = index.unionByName(least.filter("pre is not null").select(F.lit("c").alias("_kit"), F.col("contract_cid").alias("_name"), F.col("contract_cid").alias("_found"), F.col("pre").alias("target_pre")))
    kit, name = C.split_symbol(F.col("target_symbol"))
    asks = F.col("target_cid").isNull()
    keyed = edges.withColumns({"_kit": F.when(asks, F.concat(F.lit("s"), kit)).otherwise(F.lit("c")), "_name": F.when(asks, name).otherwise(F.col("target_cid"))})
    found = looked_up(keyed, index, ["_kit", "_name"]).withColumn("resolved", F.coalesce("target_cid", "_found")).drop("_kit", "_name", "_found")
    posts = least.filter("post is not null").select(F.col("contract_cid").alias("source_cid"), "post")
    told = edges.select("slot", "source_cid").distinct().join(posts, "source_cid")
    told = told.groupBy("slot").agg(F.map_from_entries(F.collect_list(F.struct("source_cid", "post"))).alias("_posts"))
    back = found.repartition("slot").join(told, "slot", "left")
    return back.withColumn("source_post", F.try_element_at("_posts", "source_cid")).drop("_posts").withColumn("outcome", outcome())


def bridges(edges: DataFrame, contracts: DataFrame) -> DataFrame:
    """One bridge per resolved edge, whatever becomes of its obligation, in order of target and source."""
    out = resolve(edges, contracts).filter(F.col("resolved").isNotNull())
    return out.select(F.col("resolved").alias("target_contract_cid"), F.col("source_cid").alias("source_contract_cid"), "line", F.col("target_symbol").alias("symbol"))


def pinned(callsites: DataFrame, members: DataFrame, contracts: DataFrame | None = None) -> DataFrame:
    """Call sites (target_cid, pinned_bundle) with ``pin``: ok, or which of the ways a target fails.

    In this order: no-target, not-a-contract (where contracts are given),
    bundle-absent, not-a-member. A site that pins nothing is ok.
    """
    own = members.select(F.col("bundle_cid").alias("pinned_bundle"), F.col("member_cid").alias("target_cid"), F.lit(True).alias("_in")).distinct()
    bundles = members.select(F.col("bundle_cid").alias("pinned_bundle"), F.lit(True).alias("_there")).distinct()
    out = looked_up(looked_up(callsites, own, ["pinned_bundle", "target_cid"]), bundles, ["pinned_bundle"])
    kind = F.lit(True)
    if contracts is not None:
        out = looked_up(out, contracts.select(F.col("contract_cid").alias("target_cid"), F.lit(True).alias("_kind")).distinct(), ["target_cid"])
        kind = F.col("_kind")
    missing = lambda c: F.coalesce(~c, F.lit(True))
    pin = (
        F.when(F.col("target_cid").isNull(), "no-target")
        .when(missing(kind), "not-a-contract")
        .when(F.col("pinned_bundle").isNull(), "ok")
        .when(F.col("_there").isNull(), "bundle-absent")
        .when(F.col("_in").isNull(), "not-a-member")
        .otherwise("ok")
    )
    return out.withColumn("pin", pin).drop("_in", "_there", "_kind")


def member_bundle(members: DataFrame) -> DataFrame:
    return members.groupBy("member_cid").agg(F.min("bundle_cid").alias("bundle_cid"))


def producer_posts(uses: DataFrame, bridge_rows: DataFrame, contracts: DataFrame) -> DataFrame:
    """Post of the contract behind each used symbol: symbol to bridge to contract."""
    by_symbol = bridge_rows.groupBy("symbol").agg(F.max_by("target_contract_cid", "load_seq").alias("contract_cid"))
    posts = contracts.select("contract_cid", "post").dropDuplicates(["contract_cid"])
    return looked_up(looked_up(uses, by_symbol, ["symbol"]), posts, ["contract_cid"])


def scoped_bridge(uses: DataFrame, by_site: DataFrame, by_symbol: DataFrame) -> DataFrame:
    """Target of a use: the bridge of its own place if there is one, else that of its symbol."""
    site = by_site.select("bundle_cid", "file", "line", "symbol", F.col("target").alias("_site"))
    symbol = by_symbol.select("symbol", F.col("target").alias("_symbol"))
    return uses.join(site, ["bundle_cid", "file", "line", "symbol"], "left").join(symbol, "symbol", "left").withColumn("target", F.coalesce("_site", "_symbol")).drop("_site", "_symbol")


def diagnostics(outcomes: DataFrame, file: str) -> DataFrame:
    return outcomes.filter((F.col("file") == file) & ~F.col("outcome").isin("vacuous", "equal"))


def annotate(annotations: DataFrame, census: DataFrame) -> DataFrame:
    """Full join of annotations and census rows by place: matched, stale (no such row) or unannotated; a proven target is an error."""
    key = ["file", "line", "callee"]
    a = annotations.select(*key, F.lit(True).alias("_a"))
    c = census.select(*key, "status", F.lit(True).alias("_c"))
    state = F.when(F.col("_c").isNull(), "stale").when(F.col("_a").isNull(), "unannotated").when(F.col("status") == "discharged", "already-proven").otherwise("matched")
    return a.join(c, key, "full").select(*key, "status", state.alias("state"))


def with_universals(obligation_rows: DataFrame, universals: DataFrame) -> DataFrame:
    """Every obligation with all closed universals as one array: one row joins all, and Spark sends it along if it is small."""
    one = universals.agg(F.array_sort(F.collect_set("formula")).alias("universals"))
    return obligation_rows.join(one)
