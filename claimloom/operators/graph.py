"""Implication closure, reachability and effect propagation."""

from __future__ import annotations

import atexit
import itertools
import tempfile
import threading
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SETTINGS = threading.Lock()  # held while settings of a session differ for a moment
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; set only where it is unset, on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = own.get() if own.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        found = tempfile.mkdtemp(prefix="claimloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What is written there goes when the process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: worked out once, with its lineage cut."""
    path = scratch(df.sparkSession, "kept")
    put(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Tables of :func:`kept` that nothing will read again go at once."""
    for t in tables:
        remove(t.sparkSession, t._kept_at)


def put(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write ``df`` to a folder, in parquet pressed by zstd. When it stands, the shuffle files behind it go at once, not when the driver next collects garbage."""
    conf = df.sparkSession.conf
    with SETTINGS:
        before = conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")
    try:
        df.write.mode(mode).option("compression", "zstd").parquet(path)
    finally:
        with SETTINGS:
            conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def sent(df: DataFrame, most: int = 500_000) -> DataFrame:
    """``df`` marked to be sent to all tasks, if its rows were counted and are few."""
    return F.broadcast(df) if df.count() <= most else df


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _discard_all() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone already
            return


def reach(edges: DataFrame, starts: DataFrame, wide: int = 8) -> DataFrame:
    """(start, node, depth): all nodes each start reaches, with the least depth, however deep.

    Only the frontier is joined in each round, against nodes seen before, so
    cycles end; a round costs what it finds. After every ``wide`` rounds links
    come to span twice as many hops, so that long chains take few rounds: a round
    over links of up to k hops finds exactly the next k depths.
    """
    seen = [kept(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct())]
    links = edges.filter("src is not null and dst is not null").select(F.col("src").alias("node"), "dst", F.lit(1).alias("hops")).distinct()
    for count in itertools.count(1):
        step = seen[-1].join(links, "node").groupBy("start", F.col("dst").alias("node")).agg(F.min(F.col("depth") + F.col("hops")).alias("depth"))
        frontier = kept(step.join(reduce(DataFrame.unionByName, seen).select("start", "node"), ["start", "node"], "left_anti"))
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, seen)
        seen.append(frontier)
        if count % wide == 0:
            further = links.select("node", F.col("dst").alias("via"), F.col("hops").alias("h")).join(links.withColumnRenamed("node", "via"), "via").select("node", "dst", (F.col("h") + F.col("hops")).alias("hops"))
            links = kept(links.unionByName(further).groupBy("node", "dst").agg(F.min("hops").alias("hops")))
            seen = [kept(reduce(DataFrame.unionByName, seen[:-1])), frontier]
    raise AssertionError


def direct(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (a, c) with ``known``: whether an edge says so itself."""
    own = edges.select(F.col("src").alias("a"), F.col("dst").alias("c"), F.lit(True).alias("known")).distinct()
    return pairs.join(own, ["a", "c"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


class Search:
    """Search from both ends of asked pairs (a, c) at once, level by level, over links (node, dst).

    ``ahead[n]`` holds the nodes n steps from a with the least predecessor, ``behind[n]``
    those n steps before c; a level is taken on the side that has fewer rows. A pair
    leaves when its sides meet, which is at its least length, or when one ends. So
    the rows made are those around the asked pairs, and rounds are half a path's length
    where both sides grow alike.
    """

    def __init__(self, pairs: DataFrame, edges: DataFrame):
        ask = pairs.select("a", "c").filter("a is not null and c is not null and a != c").distinct()
        self.links = edges.filter("src is not null and dst is not null").select(F.col("src").alias("node"), "dst").distinct()
        self.ahead = [kept(ask.select("a", "c", F.col("a").alias("node"), F.lit(None).cast("string").alias("before")))]
        self.behind = [kept(ask.select("a", "c", F.col("c").alias("node")))]
        self.met: list[DataFrame] = []
        wide = [self.ahead[0].count()] * 2
        while wide[0] and wide[1]:
            forward = wide[0] <= wide[1]
            levels, others = (self.ahead, self.behind) if forward else (self.behind, self.ahead)
            now = levels[-1].join(others[-1].select("a", "c").distinct(), ["a", "c"], "left_semi")  # a pair goes on only if both of its sides do
            if self.met:
                now = now.join(reduce(DataFrame.unionByName, self.met).select("a", "c").distinct(), ["a", "c"], "left_anti")
            if forward:
                step = now.join(self.links, "node").groupBy("a", "c", F.col("dst").alias("node")).agg(F.min("node").alias("before"))
            else:
                step = now.withColumnRenamed("node", "dst").join(self.links, "dst").select("a", "c", "node").distinct()
            seen = reduce(DataFrame.unionByName, [x.select("a", "c", "node") for x in levels])
            new = kept(step.join(seen, ["a", "c", "node"], "left_anti"))
            levels.append(new)
            wide[not forward] = new.count()
            meeting = new.select("a", "c", "node").join(others[-1].select("a", "c", "node"), ["a", "c", "node"])
            self.met.append(kept(meeting.withColumns({"ahead": F.lit(len(self.ahead) - 1), "behind": F.lit(len(self.behind) - 1)})))

    def lengths(self) -> DataFrame:
        """(a, c, length) of the pairs that are joined by a path, of least length."""
        none = self.ahead[0].limit(0).select("a", "c", F.lit(0).alias("length"))
        return reduce(DataFrame.unionByName, [m.select("a", "c", (F.col("ahead") + F.col("behind")).alias("length")).distinct() for m in self.met], none)

    def paths(self) -> DataFrame:
        """(a, c, path): of the paths of least length the one whose nodes, read from c, are least one by one."""
        if not self.met:
            return self.ahead[0].limit(0).select("a", "c", F.array("node").alias("path"))
        met = kept(reduce(DataFrame.unionByName, self.met))
        # from where the sides meet on to c: what lies on a path of least length, with its least predecessor there
        steps = [x.filter("before is not null").select("a", "c", "node", "before", F.lit(n).alias("at")) for n, x in enumerate(self.ahead) if n]
        now = met.select("a", "c", "node", "ahead", F.col("behind").alias("left"))
        for n in range(len(self.behind) - 2, -1, -1):
            start = now.filter(F.col("left") > n)
            step = start.join(self.links, "node").select("a", "c", F.col("dst"), F.col("node").alias("from"), "ahead", "left")
            on = step.join(self.behind[n].select("a", "c", F.col("node").alias("dst")), ["a", "c", "dst"])
            on = kept(on.groupBy("a", "c", F.col("dst").alias("node")).agg(F.min("from").alias("before"), F.first("ahead").alias("ahead"), F.first("left").alias("left")))
            steps.append(on.select("a", "c", "node", "before", (F.col("ahead") + F.col("left") - n).alias("at")))
            now = kept(now.filter(F.col("left") <= n).unionByName(on.select("a", "c", "node", "ahead", "left")))
        pointers = kept(reduce(DataFrame.unionByName, steps))
        out = kept(met.select("a", "c", (F.col("ahead") + F.col("behind")).alias("at"), F.col("c").alias("node")).distinct())
        way, far = [out], out.agg(F.max("at")).first()[0] or 0
        for _ in range(far):  # back from c, one step of every pair a round
            out = kept(out.join(pointers, ["a", "c", "node", "at"]).select("a", "c", (F.col("at") - 1).alias("at"), F.col("before").alias("node")))
            way.append(out)
        rows = reduce(DataFrame.unionByName, way)
        return rows.groupBy("a", "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "node"))), lambda x: x["node"]).alias("path"))


def proof_paths(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (a, c) with ``path``, the nodes of a path of least length, and its length; null where there is none. An end implies itself."""
    found = Search(pairs, edges).paths()
    own = F.when(F.col("a") == F.col("c"), F.array("a"))
    out = pairs.join(found, ["a", "c"], "left").withColumn("path", F.coalesce(own, "path"))
    return out.withColumn("length", F.when(F.col("path").isNotNull(), F.size("path") - 1))


def implies(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (a, c) with ``how``: reflexive, direct, transitive or none. Only what lies around the pairs is searched."""
    far = Search(pairs, edges).lengths()
    how = F.when(F.col("a") == F.col("c"), "reflexive").when(F.col("length") == 1, "direct").when(F.col("length").isNotNull(), "transitive").otherwise("none")
    return pairs.join(far, ["a", "c"], "left").select("a", "c", how.alias("how"))


def outlives(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (a, c) with ``holds``: equal, ``'static`` on either side, or reachable."""
    how = implies(pairs, edges)
    return how.select("a", "c", ((F.col("how") != "none") | (F.col("a") == "'static") | (F.col("c") == "'static")).alias("holds"))


def propagate_effects(functions: DataFrame, callsites: DataFrame, changed: DataFrame) -> DataFrame:
    """One decision for each function that a changed effect reaches: halt, refuse or widen; and an error for each call site or function that is unknown.

    Functions have name, function_cid, signature_cid, forbidding_contract_cid
    (these may be null or absent), admitted and forbidden (arrays); call sites
    have cid, containing_fn, callee; changes have cid, effect and may have
    dimension and seq, their order. Level by level from callee to callers; within a level the first in
    the order of a queue decides: changes by ``seq``, callers by the order of
    the decision that reached them, then by call site. A function that admits or
    forbids the effect ends the way; the first decision stays.
    """
    given = lambda df, **types: df.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in df.columns})
    functions = given(functions, function_cid="string", signature_cid="string", forbidding_contract_cid="string")
    changed = given(changed, dimension="string", seq="bigint").fillna(0, ["seq"])
    spots = callsites.select("cid", F.col("containing_fn").alias("name"))
    pending = kept(changed.select("cid", "dimension", "effect", F.array(F.format_string("%020d", "seq")).alias("turn")).join(spots, "cid", "left"))
    out = None
    for level in itertools.count():
        first = pending.groupBy("name", F.when(F.col("name").isNull(), F.col("cid")).alias("_lost")).agg(F.min(F.struct("turn", "cid", "dimension", "effect")).alias("w"))
        if out is not None:
            first = first.join(out.select(F.col("name").alias("_done")), F.col("name") == F.col("_done"), "left_anti")
        facts = functions.select(F.col("name").alias("_name"), "function_cid", "signature_cid", "forbidding_contract_cid", "admitted", "forbidden")
        met = first.join(facts, F.col("name") == F.col("_name"), "left")
        admits, forbids = F.array_contains("admitted", F.col("w.effect")), F.array_contains("forbidden", F.col("w.effect"))
        decision = F.when(F.col("name").isNull(), "unknown-callsite").when(F.col("_name").isNull(), "unknown-function").when(admits, "halt").when(forbids, "refuse").otherwise("widen")
        judged = kept(
            met.withColumn("decision", decision).select(
                "name",
                "decision",
                "function_cid",
                F.when(F.col("decision") == "halt", F.col("signature_cid")).when(F.col("decision") == "refuse", F.coalesce("forbidding_contract_cid", "signature_cid")).alias("deciding_cid"),
                F.when(F.col("decision") == "widen", F.col("w.dimension")).alias("dimension"),
                F.col("w.effect").alias("effect"),
                F.when(F.col("decision") != "halt", F.col("w.cid")).alias("trigger"),
                F.when(F.col("decision") == "halt", "signature already admits").when(F.col("decision") == "refuse", "contract forbids widening").alias("reason"),
                F.lit(level).alias("level"),
                F.col("w.turn").alias("_turn"),
            )
        )
        if judged.isEmpty():
            break
        out = judged if out is None else kept(out.unionByName(judged))
        widened = judged.filter("decision = 'widen'").select(F.col("name").alias("callee"), "dimension", "effect", "_turn")
        pending = callsites.filter(F.col("callee").isNotNull()).join(widened, "callee").select("cid", "dimension", "effect", F.concat("_turn", F.array("cid")).alias("turn"), F.col("containing_fn").alias("name"))
    return (judged if out is None else out).drop("_turn")


def compose_edges(steps: DataFrame) -> DataFrame:
    """Consecutive steps of a path (path, n, cid) as composed edges."""
    right = steps.select("path", (F.col("n") - 1).alias("n"), F.col("cid").alias("right_cid"))
    return steps.join(right, ["path", "n"]).select("path", "n", F.col("cid").alias("left_cid"), "right_cid")
