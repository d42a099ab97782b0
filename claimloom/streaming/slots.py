"""Linking from a stream with keyed state: only slots whose content changed are written, only edges they touch are linked again.

A slot (kit, file) carries contracts and call edges under a version. Its state
holds the last version, a digest of the content and a mark for each contract,
so a version that comes late, or that says what is known already, writes
nothing. A changed slot is appended to the log with the names and ids whose
contracts came, went or changed; edges that ask for one of these, in any slot,
are linked again and appended to the log of links. The log is read as the last
entry of each slot and edge. :func:`compact` folds it into a snapshot.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators import decide, linking
from ..operators.graph import CLEANUP, SETTINGS, put, sent

CONTRACTS = "array<struct<kit:string,name:string,contract_cid:string,pre:string,post:string>>"
EDGES = "array<struct<source_cid:string,target_cid:string,target_symbol:string,line:bigint>>"
CONTRACT_FIELDS, EDGE_FIELDS = ([f.split(":")[0] for f in x[len("array<struct<") : -2].split(",")] for x in (CONTRACTS, EDGES))
CHANGED = "slot string, kit string, file string, version long, digest string, contracts string, edges string, touched array<string>"
SLOT_LOG = f"slot string, kit string, file string, version bigint, digest string, contracts {CONTRACTS}, edges {EDGES}, touched array<string>, batch bigint"
LINK_LOG = "slot string, digest string, place int, kit string, file string, source_cid string, target_cid string, target_symbol string, line bigint, resolved string, outcome string, batch bigint"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SlotState(StatefulProcessor):
    """Last version of one slot; passes on rows whose content is new."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.slot = handle.getValueState("slot", "version long, digest string, marks array<string>", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        best = None
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                if best is None or (r.version, r.digest) > (best.version, best.digest):
                    best = r
        old = self.slot.get() if self.slot.exists() else None
        if best is None or old is not None and (old[0], old[1]) >= (best.version, best.digest):
            return
        marks = sorted(best.marks)
        self.slot.update((int(best.version), best.digest, marks))
        if old is not None and old[1] == best.digest:
            return
        changed = set(marks) ^ set(old[2] if old is not None else [])
        touched = sorted({part for m in changed for part in m.split("\n")[:2]})
        row = (key[0], best.kit, best.file, int(best.version), best.digest, best.contracts, best.edges, touched)
        yield pd.DataFrame([row], columns=[c.split()[0] for c in CHANGED.split(", ")])

    def close(self) -> None:
        pass


def _prepared(slots: DataFrame) -> DataFrame:
    """Slots with an id, a digest of the content and a mark (id, symbol, digest of the formulas) for each contract. A null version is older than any."""
    contracts = F.coalesce(F.col("contracts").cast(CONTRACTS), F.expr(f"cast(array() as {CONTRACTS})"))
    edges = F.coalesce(F.col("edges").cast(EDGES), F.expr(f"cast(array() as {EDGES})"))
    symbol = lambda c: F.concat_ws(":", c["kit"], c["name"])
    one = lambda c: F.concat(F.lit("c:"), F.coalesce(c["contract_cid"], F.lit("")), F.lit("\ns:"), symbol(c), F.lit("\n"), F.sha2(F.to_json(F.struct(c["pre"], c["post"])), 256))
    out = slots.select(F.to_json(F.struct("kit", "file")).alias("slot"), "kit", "file", F.coalesce(F.col("version").cast("bigint"), F.lit(-(2**63))).alias("version"), contracts.alias("_contracts"), edges.alias("_edges"))
    text = lambda c, fields: F.to_json(F.transform(F.array_sort(c), lambda x: F.array(*[x[f].cast("string") for f in fields])))
    out = out.withColumns({"contracts": text("_contracts", CONTRACT_FIELDS), "edges": text("_edges", EDGE_FIELDS), "marks": F.array_distinct(F.transform("_contracts", one))})
    return out.withColumn("digest", F.sha2(F.concat(F.length("contracts").cast("string"), F.lit(":"), "contracts", "edges"), 256)).drop("_contracts", "_edges")


def _parsed(column: str, form: str, fields: list[str]) -> Column:
    """Contracts or edges from their text, which has values without names."""
    return F.transform(F.from_json(column, "array<array<string>>"), lambda x: F.struct(*[x[i].alias(f) for i, f in enumerate(fields)])).cast(form)


def _batches(spark: SparkSession, path: str, head: str) -> list[int]:
    """Numbers of the folders ``head=N`` in ``path`` that were written to their end."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith(f"{head}=")]
    done = [p for p in names if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().partition("=")[2]) for p in done)


def _log(spark: SparkSession, out: str, kind: str, upto: int | None = None) -> DataFrame:
    """The log of slots or links up to a batch: the newest snapshot that is not beyond it, and the batches after it."""
    schema = SLOT_LOG if kind == "slots" else LINK_LOG
    last = upto if upto is not None else 2**62
    snap = [n for n in _batches(spark, f"{out}/snapshot-links", "upto") if n <= last]  # links are written last
    since = snap[-1] if snap else -1
    paths = [f"{out}/{kind}/batch={n}" for n in _batches(spark, f"{out}/{kind}", "batch") if since < n <= last]
    paths += [f"{out}/snapshot-{kind}/upto={since}"] if snap else []
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _last(log: DataFrame) -> DataFrame:
    """(slot, digest, batch) of the last entry of each slot."""
    last = log.groupBy("slot").agg(F.max(F.struct("version", "digest", "batch")).alias("s"))
    return last.select("slot", "s.digest", "s.batch")


def current_slots(spark: SparkSession, out: str, upto: int | None = None) -> DataFrame:
    """The last entry of each slot. A batch has one entry of a slot at most."""
    log = _log(spark, out, "slots", upto)
    return log.join(sent(_last(log).select("slot", "batch")), ["slot", "batch"], "left_semi")


def current_links(spark: SparkSession, out: str, upto: int | None = None) -> DataFrame:
    """The last outcome of each edge of the current slots. The log of links is dealt out once, by slots, in which it lies."""
    slots = sent(_last(_log(spark, out, "slots", upto)).select("slot", "digest"))
    log = _log(spark, out, "links", upto).join(slots, ["slot", "digest"], "left_semi").repartition("slot")
    last = F.max("batch").over(Window.partitionBy("slot", "place"))
    return log.withColumn("_last", last).filter("batch = _last").drop("_last")


def contracts_of(slots: DataFrame) -> DataFrame:
    return slots.select(F.inline("contracts"))


def _edges(slots: DataFrame) -> DataFrame:
    return slots.select("slot", F.posexplode("edges").alias("place", "e")).select("slot", "place", "e.*")


def _touched(edges: DataFrame, changed: DataFrame, most: int = 2_000_000) -> DataFrame:
    """Edges that ask for what came, went or changed. Keys are met as 64-bit hashes: an edge taken in by chance is linked again, to the same outcome."""
    keys = changed.select(F.explode("touched").alias("key")).select(F.xxhash64("key").alias("key")).distinct()
    said = lambda head, c: F.concat(F.lit(head), c)
    hashed = lambda c: F.when(c.isNotNull(), F.xxhash64(c))
    asks = {"_source": hashed(said("c:", F.col("source_cid"))), "_target": hashed(F.coalesce(said("c:", F.col("target_cid")), said("s:", F.col("target_symbol"))))}
    keyed = edges.withColumns(asks)
    if keys.count() <= most:
        for c in asks:
            keyed = keyed.join(F.broadcast(keys.select(F.col("key").alias(c), F.lit(True).alias(f"{c}_met"))), c, "left")
        return keyed.filter("_source_met or _target_met").select(edges.columns)
    met = keyed.select("slot", "place", F.explode(F.array_compact(F.array(*asks))).alias("key")).join(keys, "key", "left_semi").select("slot", "place").distinct()
    return edges.join(met, ["slot", "place"], "left_semi")


def relinked(slots: DataFrame, changed: DataFrame, settle: bool = False) -> DataFrame:
    """Outcomes of the edges of ``slots`` that ``changed`` slots bring or touch; with ``settle`` implications are decided too.

    Edges of other slots are read to find those that are touched; only these are joined with contracts. What is the same
    for a whole slot does not travel with its edges, and they come back slot by slot.
    """
    names = sent(changed.select("slot").distinct())
    again = _edges(slots.join(names, "slot", "left_semi"))
    others = slots.join(names, "slot", "left_anti")
    if not others.isEmpty():
        again = again.unionByName(_touched(_edges(others), changed))
    found = linking.slot_obligations(again, contracts_of(slots))
    found = decide.decided(found) if settle else found
    return found.join(sent(slots.select("slot", "digest", "kit", "file")), "slot").sortWithinPartitions("slot", "place")


def start(stream: DataFrame, out: str, checkpoint: str, ttl_ms: int | None = None, compact_every: int | None = None, settle: bool = False, trigger: dict | None = None):
    """Run the linker over a stream of slots (kit, file, version, contracts, edges).

    A batch that runs again writes the same folders. With ``ttl_ms`` the state of a slot
    that saw nothing for so long is evicted; what comes next for it is compared with the log when
    it is read, so an old version still loses, and costs one write. Time to live needs a
    processing-time trigger; without it all that is there is taken, and the query ends.
    """

    def batch(df: DataFrame, number: int) -> None:
        rows = df.withColumns({"contracts": _parsed("contracts", CONTRACTS, CONTRACT_FIELDS), "edges": _parsed("edges", EDGES, EDGE_FIELDS), "batch": F.lit(number).cast("bigint")})
        put(rows, f"{out}/slots/batch={number}")
        changed = spark.read.schema(SLOT_LOG).parquet(f"{out}/slots/batch={number}")
        if changed.isEmpty():
            return
        links = relinked(current_slots(spark, out, number), changed, settle).withColumn("batch", F.lit(number).cast("bigint"))
        put(links.select(*[c.split()[0] for c in LINK_LOG.split(", ")]), f"{out}/links/batch={number}")
        if compact_every and number % compact_every == compact_every - 1:
            compact(spark, out, number)

    spark = stream.sparkSession
    wanted = {PROVIDER: ROCKS, CLEANUP: "true"}
    with SETTINGS:
        before = {k: spark.conf.get(k, None) for k in wanted}
        for k, v in wanted.items():
            spark.conf.set(k, v)  # a query keeps the settings of its start
        try:
            kept = _prepared(stream).groupBy("slot").transformWithStateInPandas(SlotState(ttl_ms), CHANGED, "Update", "ProcessingTime" if ttl_ms else "None")
            how = trigger or ({"processingTime": "10 seconds"} if ttl_ms else {"availableNow": True})
            return kept.writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(**how).start()
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def compact(spark: SparkSession, out: str, upto: int) -> None:
    """Fold the log up to a batch into a snapshot. Folders before it are read no more; they are left to who keeps the store."""
    put(current_slots(spark, out, upto), f"{out}/snapshot-slots/upto={upto}")
    put(current_links(spark, out, upto), f"{out}/snapshot-links/upto={upto}")
