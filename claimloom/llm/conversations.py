"""Conversation structure repair.

The rows of a conversation are edited at least cost into the roles
``(s?(ua)+)?``. A macro edit is a run of inserts and what becomes of the next
row: its code, such as ``K``, ``IK`` or ``IIR``, is prefix-free, so sequences of
codes compare as their codes do, one row after the other. Instead of audit
strings, a layer of the dynamic program holds for each state a cost, the rank of
its best string among those of the layer, and a pointer to its parent; what can
follow depends on the costs' differences and the ranks alone, so the layers met
are few and each is worked out once. The audit is read back from the pointers.

Rows are brought into order by a range sort, which may cut a long conversation
into runs. A run of a cut conversation is summed up for every state it can begin
in, and the sums are chained.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import util

START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 40
#: Rows of a run, at most.
RUN_ROWS = 1 << 16

#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: The state that an insert leads to, with the role it inserts, and the state that a kept role leads to.
INSERTED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: What is inserted at the end of a conversation: the state must be START or ASSISTANT after it.
TAILS = {START: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}

#: A row's code: its role's initial and whether it is sound, must go, or is truncated.
INITIALS = "sua?"
SOUND, MUST_GO, CUT = range(3)


def _macros(initial: str, fault: int) -> list[list[tuple[str, int, int]]]:
    """For each state before a row: (code, cost, state after it). Two inserts lead to every state that any number leads to."""
    out = []
    for before in range(4):
        moves, at = [], before
        for inserts in range(3):
            at = INSERTED[at] if inserts else before
            paid, run = INSERT * inserts, "I" * inserts
            moves.append((run + "D", paid + DELETE, at))
            if fault != MUST_GO:
                paid += TRUNCATED * (fault == CUT)
                if (at, initial) in KEPT:
                    moves.append((run + "K", paid, KEPT[at, initial]))
                moves.append((run + "R", paid + REROLE, INSERTED[at]))
        out.append(moves)
    return out


class Layers:
    """Layers of the program and the steps between them, worked out when first met.

    A layer is, for each state, (cost over the least cost of the layer, rank) or
    None; a step gives the next layer, the cost it adds, and for each state its
    parent and code.
    """

    def __init__(self):
        self.moves = [_macros(i, f) for i in INITIALS for f in (SOUND, MUST_GO, CUT)]
        self.layers: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.steps: dict[int, int] = {}  # layer * 16 + row code -> step
        self.made: list[tuple[int, int, tuple]] = []  # step -> (layer, cost, pointers)
        self.begin = [self._of(tuple((0, 0) if q == s else None for q in range(4))) for s in range(4)]

    def _of(self, layer: tuple) -> int:
        if layer not in self.number:
            self.number[layer] = len(self.layers)
            self.layers.append(layer)
        return self.number[layer]

    def step(self, layer: int, code: int) -> int:
        key = layer * 16 + code
        if key not in self.steps:
            best: dict[int, tuple] = {}
            for p, held in enumerate(self.layers[layer]):
                if held is not None:
                    for macro, cost, q in self.moves[code][p]:
                        way = (held[0] + cost, held[1], macro, p)
                        if q not in best or way < best[q]:
                            best[q] = way
            least = min(w[0] for w in best.values())
            order = sorted(best, key=lambda q: best[q][1:3])
            new = tuple((best[q][0] - least, order.index(q)) if q in best else None for q in range(4))
            self.steps[key] = len(self.made)
            self.made.append((self._of(new), least, tuple((best[q][3], best[q][2]) if q in best else None for q in range(4))))
        return self.steps[key]

    def forward(self, begin: int, codes: bytes) -> tuple[int, int, np.ndarray]:
        """From one state over the rows of a run: last layer, cost to add, and the step taken at each row."""
        layer, cost, taken = self.begin[begin], 0, np.zeros(len(codes), np.int32)
        known, made = self.steps, self.made
        for i, code in enumerate(codes):
            s = known.get(layer * 16 + code)
            if s is None:
                s = self.step(layer, code)
            layer, more, _ = made[s]
            cost += more
            taken[i] = s
        return layer, cost, taken

    def backward(self, state: int, taken: np.ndarray) -> list[str]:
        """Codes of the rows of a run that ends in ``state``."""
        out = []
        for s in taken[::-1].tolist():
            state, macro = self.made[s][2][state]
            out.append(macro)
        return out[::-1]

    def sums(self, codes: bytes) -> list[list[tuple[int, int] | None]]:
        """For each state that a run can begin in, and each it ends in: cost and rank."""
        out = []
        for begin in range(4):
            layer, cost, _ = self.forward(begin, codes)
            out.append([None if held is None else (cost + held[0], held[1]) for held in self.layers[layer]])
        return out


def last_state(layer: list[tuple[int, int] | None]) -> tuple[int, int]:
    """The state that ends the best audit, and its whole cost."""
    cost, _, _, state = min((held[0] + INSERT * TAILS[q], held[1], TAILS[q], q) for q, held in enumerate(layer) if held is not None)
    return state, cost


def chain(sums: list[list[list[tuple[int, int] | None]]]) -> tuple[list[tuple[int, int]], int]:
    """(begin, end) of every run of a conversation, and the whole cost: the same program, with runs in place of rows."""
    layer: list[tuple[int, int] | None] = [(0, 0), None, None, None]
    parents = []
    for run in sums:
        best: dict[int, tuple] = {}
        for p, held in enumerate(layer):
            if held is not None:
                for q, way in enumerate(run[p]):
                    if way is not None:
                        new = (held[0] + way[0], held[1], way[1], p)
                        if q not in best or new < best[q]:
                            best[q] = new
        order = sorted(best, key=lambda q: best[q][1:3])
        layer = [(best[q][0], order.index(q)) if q in best else None for q in range(4)]
        parents.append([best[q][3] if q in best else None for q in range(4)])
    state, cost = last_state(layer)
    ends, end = [], state
    for before in reversed(parents):
        ends.append((before[end], end))
        end = before[end]
    return ends[::-1], cost


def damaged(rows: DataFrame) -> DataFrame:
    """Rows after damage: conv_id, turn, role, text, copy. A dropped row has copy -1, so that its conversation stays known."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")), F.lit(20)).cast("int")
    out = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 0, F.array(F.lit(-1))).when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def _trimmed(text: Column) -> Column:
    """Text without white space at its end, ASCII only."""
    return F.rtrim(text, F.lit(" \t\n\x0b\x0c\r"))


def ordered(rows: DataFrame) -> DataFrame:
    """Damaged rows in order, with their place, fault so far and digest; ``place`` has no gaps within a task of the sort."""
    end = _trimmed(F.col("text"))
    cut = ~F.substring(end, -1, 1).isin(".", "!", "?")
    fault = F.when(end == "", "blank").when(cut, "truncated")
    sort = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role"]
    out = rows.filter("copy >= 0").withColumn("head", F.substring("text", 1, 32))
    out = out.repartitionByRange(*sort, "head").sortWithinPartitions(*sort, "text", "copy")
    digest = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    return out.select("conv_id", "turn", "role", "text", fault.alias("fault"), F.unhex(digest).alias("digest"), F.monotonically_increasing_id().alias("place"))


def repeated(rows: DataFrame) -> DataFrame:
    """Places of the rows whose role and text their conversation has had before: a digest's least place is its first."""
    said = rows.filter("fault is null or fault != 'blank'").select("conv_id", "digest", "place")
    first = said.groupBy("conv_id", "digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first")
    return said.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d"))).filter("place > first").select("place")


RUNS = "conv_id bigint, place bigint, codes binary"


def _runs(run_rows: int):
    """Runs of places without gaps of one conversation, as one byte a row."""

    def run(batches):
        conv, first, codes = None, None, bytearray()
        out: list[tuple] = []

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["conv_id", "place", "codes"])

        for batch in batches:
            for c, place, code in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if first is None or c != conv or place != first + len(codes) or len(codes) == run_rows:
                    if first is not None:
                        out.append((conv, first, bytes(codes)))
                    conv, first, codes = c, place, bytearray()
                codes.append(code)
            if len(out) >= 5000:
                yield batch_of(out)
                out = []
        if first is not None:
            out.append((conv, first, bytes(codes)))
        if out:
            yield batch_of(out)

    return run


def _summed(batches):
    layers = Layers()
    for batch in batches:
        rows = []
        for conv, place, codes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            rows.append((conv, place, [x for begin in layers.sums(codes) for held in begin for x in (held or (NEVER, 0))]))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["conv_id", "place", "sums"])


def _chained(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("place")
    sums = [[[None if s[8 * p + 2 * q] >= NEVER else (int(s[8 * p + 2 * q]), int(s[8 * p + 2 * q + 1])) for q in range(4)] for p in range(4)] for s in part["sums"]]
    ends, cost = chain(sums)
    last = len(ends) - 1
    return pd.DataFrame({"place": part["place"], "begin": [b for b, _ in ends], "end": [e for _, e in ends], "cost": [cost] + [0] * last, "tail": [0] * last + [TAILS[ends[-1][1]]]})


EDITED = "conv_id bigint, place bigint, edits binary, cost bigint, tail int"


def _edited(batches):
    """Edits of every run, one byte a row: 16 times its fault, four times the inserts before it, and which of D, K, R follows."""
    layers = Layers()
    for batch in batches:
        rows = []
        for conv, place, codes, begin, end, cost, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            whole = begin is None  # the conversation is one run
            layer, paid, taken = layers.forward(START if whole else begin, codes)
            if whole:
                end, more = last_state(layers.layers[layer])
                cost, tail = paid + more, TAILS[end]
            edits = bytes(16 * (code % 3) + 4 * (len(m) - 1) + "DKR".index(m[-1]) for code, m in zip(codes, layers.backward(end, taken), strict=True))
            rows.append((conv, place, edits, cost, tail))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32()), strict=True)], names=["conv_id", "place", "edits", "cost", "tail"])


RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Conversation:
    """What is known of a conversation while its runs and rows stream by."""

    def __init__(self, conv):
        self.conv, self.counts, self.audit, self.hash, self.wrote = conv, dict.fromkeys(COUNTS, 0), [], hashlib.sha256(), False
        self.state, self.edits, self.first, self.tail = START, b"", 0, 0
        self.turns, self.low, self.high, self.before = 0, None, None, None

    def run(self, place, edits, cost, tail):
        self.edits, self.first, self.tail = edits, place, tail
        self.counts["cost"] += cost

    def write(self, role, text):
        self.hash.update(("\n" * self.wrote + role + ":" + text).encode())
        self.wrote = True

    def insert(self, n):
        for _ in range(n):
            self.state = INSERTED[self.state]
            self.write(ROLES[self.state], "")

    def row(self, place, turn, role, text, blank):
        fault, edit = divmod(self.edits[place - self.first], 16)
        if fault:
            self.counts["truncated" if fault == CUT else "blank" if blank else "duplicate"] += 1
        if turn is not None:
            if turn != self.high:
                self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.before = role[:1]
        inserts, edit = divmod(edit, 4)
        self.audit.append("I" * inserts + "DKR"[edit])
        self.insert(inserts)
        if edit == 1:
            self.state = KEPT[self.state, role[:1]]
            self.write(role, text)
        elif edit == 2:
            self.state = INSERTED[self.state]
            self.write(ROLES[self.state], text)

    def result(self):
        self.insert(self.tail)
        if self.high is not None:
            self.counts["gaps"] = self.high - self.low + 1 - self.turns
        return (self.conv, *self.counts.values(), "".join(self.audit) + "I" * self.tail, self.hash.hexdigest())


def _repaired(batches):
    """Runs and rows in the order of conversations and places, a run before its rows."""
    now, out = None, []
    types = [pa.int64()] * 7 + [pa.string()] * 2

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])

    for batch in batches:
        for part in range(0, batch.num_rows, 500):
            for conv, place, kind, edits, cost, tail, turn, role, text, blank in zip(*(c.to_pylist() for c in batch.slice(part, 500).columns), strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        out.append(now.result())
                    now = _Conversation(conv)
                if kind == 0:
                    now.run(place, edits, cost, tail)
                elif kind == 1:
                    now.row(place, turn, role, text, blank)
        if len(out) >= 1000:
            yield batch_of(out)
            out = []
    if now is not None:
        out.append(now.result())
    if out:
        yield batch_of(out)


def repair(conversations: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are damaged first (see :func:`damaged`), a null role, text, id or turn counting
    as one blank there. Rows are taken by turn, nulls first, then by role, text
    and copy, so ties and repeated rows have one result; a repeated row is a
    duplicate. Rows of a null conv_id are one conversation. A role that begins with
    none of s, u, a (an empty one too) cannot be kept as it is. Conversations of
    which no row is left have zeros, an empty audit and the hash of no bytes. An
    empty table gives no rows; other columns are ignored. Texts are whole. What
    is held of a conversation in one place is its audit; its texts stream by.
    """
    rows = damaged(conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text"))
    placed = util.stored(ordered(rows), "placed")
    again = repeated(placed).select("place", F.lit(True).alias("again"))
    initial = F.substring("role", 1, 1)
    at = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when((F.col("fault") == "blank") | F.col("again"), MUST_GO).when(F.col("fault") == "truncated", CUT).otherwise(SOUND)
    coded = placed.join(again, "place", "left").select("conv_id", "place", (at * 3 + fault).alias("code"))
    runs = util.stored(coded.repartitionByRange("place").sortWithinPartitions("place").mapInArrow(_runs(run_rows), RUNS), "runs", batch=10_000)
    several = runs.groupBy("conv_id").count().filter("count > 1").select(F.col("conv_id").alias("c"))
    sums = runs.join(several, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi").mapInArrow(_summed, "conv_id bigint, place bigint, sums array<bigint>")
    ends = sums.groupBy("conv_id").applyInPandas(_chained, "place bigint, begin int, end int, cost bigint, tail int")
    edited = util.stored(runs.join(ends, "place", "left").select("conv_id", "place", "codes", "begin", "end", "cost", "tail").mapInArrow(_edited, EDITED), "edited")
    util.discard(runs)
    nothing = {"place": "bigint", "edits": "binary", "cost": "bigint", "tail": "int", "turn": "bigint", "role": "string", "text": "string", "blank": "boolean"}
    kinds = [edited, placed.withColumn("blank", F.col("fault").eqNullSafe("blank")), rows.filter("copy < 0").select("conv_id").distinct()]
    parts = []
    for kind, df in enumerate(kinds):
        cols = {c: F.col(c) if c in df.columns else F.lit(None).cast(t) for c, t in nothing.items()}
        parts.append(df.select("conv_id", cols.pop("place").alias("place"), F.lit(kind).alias("kind"), *[v.alias(c) for c, v in cols.items()]))
    stream = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return stream.repartition("conv_id").sortWithinPartitions("conv_id", "place", "kind").mapInArrow(_repaired, RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    return repair(util.table(spark, sf_dir, "conversations"))


SQL = r"""
with recursive src as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint)),
      lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda a, z: case when a % 2 = 1 then xor(a // 2, 3988292384::bigint) else a // 2 end))) % 20 as kind
  from conversations),
hurt as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role, case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case when kind = 3 then [0, 1] else [0] end) as copy
  from src where kind <> 0),
numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as n from hurt),
faulty as (
  select *, substring(role, 1, 1) as initial, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when row_number() over (partition by conv_id, role, text order by n) > 1 then 'duplicate'
    when right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
    lag(substring(role, 1, 1)) over (partition by conv_id order by n) as before
  from numbered),
inserts(q, k, p, added) as (values ('', 0, '', ''), ('', 1, 'u', '|user:'), ('', 2, 'a', '|user:|assistant:'), ('s', 0, 's', ''), ('s', 1, 'u', '|user:'), ('s', 2, 'a', '|user:|assistant:'),
  ('u', 0, 'u', ''), ('u', 1, 'a', '|assistant:'), ('a', 0, 'a', ''), ('a', 1, 'u', '|user:')),
legal(p, role) as (values ('', 's'), ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
moves as (
  select q, k, p, added, 'D' as edit, null as initial, p as q2, 4 as cost from inserts
  union all select q, k, i.p, added, 'K', l.role, l.role, 0 from inserts i join legal l on i.p = l.p
  union all select q, k, i.p, added, 'R', null, case when i.p = 'u' then 'a' else 'u' end, 3 from inserts i),
best as (
  select conv_id, 0::bigint as n, '' as q, {'c': 0::bigint, 'a': '', 'o': ''} as b from (select distinct conv_id from faulty)
  union all
  select r.conv_id, r.n + 1, m.q2, min({'c': r.b.c + 3 * m.k + m.cost + case when m.edit <> 'D' and f.fault = 'truncated' then 3 else 0 end, 'a': r.b.a || repeat('I', m.k) || m.edit,
    'o': r.b.o || replace(m.added, '|', chr(10)) || case m.edit when 'K' then chr(10) || f.role || ':' || f.text when 'R' then chr(10) || case m.q2 when 'u' then 'user' else 'assistant' end || ':' || f.text else '' end})
  from best r join faulty f on r.conv_id is not distinct from f.conv_id and f.n = r.n + 1 join moves m on m.q = r.q and (m.initial is null or m.initial = f.initial) and (m.edit = 'D' or f.fault not in ('blank', 'duplicate'))
  group by r.conv_id, r.n + 1, m.q2),
ends as (
  select conv_id, min({'c': b.c + 3 * k, 'a': b.a || repeat('I', k), 'o': b.o || replace(added, '|', chr(10))}) as b
  from best join (select q, k, added from inserts where p in ('', 'a')) using (q) where n = (select max(f.n) from faulty f where f.conv_id is not distinct from best.conv_id) group by conv_id),
stats as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal
  from faulty group by conv_id)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(e.b.c, 0) as cost, coalesce(e.b.a, '') as audit, sha256(coalesce(substring(e.b.o, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join stats s on c.conv_id is not distinct from s.conv_id left join ends e on c.conv_id is not distinct from e.conv_id
"""
