"""Operators 11 to 13 against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from claimloom.llm import conversations, topk, trie

CONV = "conv_id bigint, turn bigint, role string, text string"


def chats(seed=3, n=60):
    rng = random.Random(seed)
    said = ["Yes.", "No.", "a b", "", " \t\n", "What? ", "é!", "x" * 50 + ".", None]
    rows = []
    for c in itertools.chain(range(n), range(100, 100 + n), [-3, -100, 250]):
        for t in range(rng.choice([1, 2, 3, 5, 7])):
            rows.append((c, rng.choice([t, t, t, t + 1, None]) if rng.random() < 0.2 else t, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, "", "uploader"]), rng.choice(said)))
    rows += [(300, t, ["user", "assistant"][t % 2], f"turn {t // 3}.") for t in range(400)]
    rows += [(None, t, "user", "nobody's.") for t in range(3)] + [(301, 0, "user", "Same."), (301, 0, "user", "Same.")]
    for c in range(310, 330):  # copies of one conversation
        rows += [(c, t, "user", f"c{t}.") for t in range(6)]
    return rows


def by_turn(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[0]].append(r)
    return {c: sorted(v, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")) for c, v in out.items()}


def brute_repair(rows):
    """Least cost and audit over all edits, by a search over strings."""
    spaces = " \t\n\x0b\x0c\r"
    word = lambda x: " " if x is None else str(x)
    hurt = defaultdict(list)
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{word(c)}:{word(t)}".encode()) % 20
        hurt[c]
        role, text = word(role), word(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        hurt[c] += [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for c, own in hurt.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in own:
            s = text.strip(spaces)
            faults.append("blank" if not s else "duplicate" if (role, text) in seen else "truncated" if s[-1] not in ".!?" else "")
            seen.add((role, text))
        best = {"": (0, "", [])}
        legal = {"": "su", "s": "u", "u": "a", "a": "u"}
        full = {"u": "user", "a": "assistant"}

        def insert(held, legal=legal, full=full):
            for _ in range(3):
                for q, (cost, audit, made) in list(held.items()):
                    for r in legal[q]:
                        if r != "s":
                            new = (cost + 3, audit + "I", [*made, full[r] + ":"])
                            held[r] = min(held.get(r, new), new)
            return held

        for (_, role, text), fault in zip(own, faults, strict=True):
            new = {}

            def offer(q, way, new=new):
                new[q] = min(new.get(q, way), way)

            for q, (cost, audit, made) in insert(best).items():
                offer(q, (cost + 4, audit + "D", made))
                if fault not in ("blank", "duplicate"):
                    more = 3 * (fault == "truncated")
                    if role[:1] and role[:1] in legal[q]:
                        offer(role[:1], (cost + more, audit + "K", [*made, f"{role}:{text}"]))
                    for r in legal[q]:
                        if r != "s":
                            offer(r, (cost + more + 3, audit + "R", [*made, f"{full[r]}:{text}"]))
            best = new
        cost, audit, made = min(v for q, v in insert(best).items() if q in ("", "a"))
        turns = [t for t, _, _ in own if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(own)]
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("run_rows", [3, 1 << 16])
def test_repair_is_the_cheapest(spark, run_rows):
    rows = chats()
    df = spark.createDataFrame(rows, CONV).selectExpr("*", "1 as place", "'x' as edits", "2 as kind").repartition(7)
    got = sorted((tuple(r) for r in conversations.repair(df, run_rows).collect()), key=str)
    assert got == brute_repair(rows)


def test_repair_chains_runs_as_one(spark):
    rng = random.Random(5)
    layers = conversations.Layers()
    for _ in range(200):
        codes = bytes(rng.randrange(12) for _ in range(rng.randint(1, 40)))
        cuts = sorted({0, len(codes), *(rng.randrange(len(codes)) for _ in range(3))})
        runs = [codes[a:b] for a, b in itertools.pairwise(cuts)]
        ends, cost = conversations.chain([layers.sums(r) for r in runs])
        layer, paid, taken = layers.forward(conversations.START, codes)
        end, more = conversations.last_state(layers.layers[layer])
        assert cost == paid + more and ends[-1][1] == end
        pieces = [m for r, (b, e) in zip(runs, ends, strict=True) for m in layers.backward(e, layers.forward(b, r)[2])]
        assert pieces == layers.backward(end, taken)


def brute_trie(rows):
    own = by_turn([r for r in rows if r[0] is not None])
    turns = {c: [(r[2] or "", r[3] or "") for r in v] for c, v in own.items()}
    built = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = turns.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])
        built[c] = tuple(base[:h] + t[h:])
    members = defaultdict(list)
    for c, t in sorted(built.items()):
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        ((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in m if built[c] == p).encode()).hexdigest()) for p, m in members.items()),
        key=str,
    )


@pytest.mark.parametrize(("shard_turns", "fan"), [(1, 2), (9, 3), (1 << 18, 32)])
def test_trie_of_shards_is_the_whole_trie(spark, shard_turns, fan):
    rows = chats(4)
    df = spark.createDataFrame(rows, CONV).selectExpr("*", "1 as depth", "'x' as labels", "2 as shard").repartition(6)
    got = sorted((tuple(r) for r in trie.prefix_trie(df, shard_turns, fan).collect()), key=str)
    assert got == brute_trie(rows)


def test_louds_gives_parents():
    degrees = np.array([2, 0, 3, 1, 0, 0, 0])
    bits = trie.louds(degrees)
    assert "".join("01"[int(b)] for b in bits) == "1100111010000"
    assert trie.parents(bits).tolist() == [0, 0, 0, 2, 2, 2, 3]


def test_no_conversations(spark):
    none = spark.createDataFrame([], CONV)
    assert conversations.repair(none).collect() == []
    assert trie.prefix_trie(none).collect() == []
    nobody = spark.createDataFrame([(None, None, None, None)], CONV)
    assert trie.prefix_trie(nobody).collect() == []
    [r] = conversations.repair(nobody).collect()
    assert r.conv_id is None and r.repaired_sha256 == hashlib.sha256(b"").hexdigest()


VEC = "vec_id bigint, embedding array<float>, label int"


def vectors():
    rng = random.Random(9)
    hot = [0.5, -0.25, 1.0]
    rows = [(i, [rng.uniform(-1, 1) for _ in range(3)], 0) for i in range(90)] + [(i, hot, 1) for i in range(90, 150)]
    rows += [(160, None, 0), (180, [1.0, None, 2.0], 0), (200, [float("nan"), 1.0, 1.0], 0), (220, [float("inf")] * 3, 0), (None, hot, 0), (None, [9.0, 9.0, 9.0], 0)]
    rows += [(240, [], 0), (241, [2.0], 0), (242, [0.1] * 7, 0), (40, hot, 2), (40, hot, 2), (-20, [-0.015625, 0.3, -0.999], 0)]
    return rows


def brute_top(rows, k, scale=64):
    own = [(i, [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(own):
        if i is not None and i % 20 == 0:
            ranked = sorted((-min(max(sum(a * b for a, b in zip(q, v, strict=False)), -(1 << 63)), (1 << 63) - 1), j is None, j or 0) for m, (j, v) in enumerate(own) if m != n)
            out += [(i, r + 1, None if null else j, -s) for r, (s, null, j) in enumerate(ranked[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("k", "tile_rows", "wave_bytes", "fan"), [(20, 8192, 1 << 26, 16), (20, 40, 20_000, 2), (200, 30, 1 << 26, 3)])
def test_top_k_is_exact(spark, k, tile_rows, wave_bytes, fan):
    rows = vectors()
    df = spark.createDataFrame(rows, VEC).selectExpr("*", "1 as at", "2 as node", "3 as n").repartition(5)
    got = sorted((tuple(r) for r in topk.top_k(df, k, tile_rows=tile_rows, wave_bytes=wave_bytes, fan=fan).collect()), key=str)
    assert got == brute_top(rows, k)


@pytest.mark.parametrize("size", [1e3, 1e8, 3e15, 1e30])
def test_top_k_of_large_components(spark, size):
    rng = random.Random(2)
    rows = [(i, [float(np.float32(rng.uniform(-size, size))) for _ in range(4)], 0) for i in range(70)]
    got = sorted((tuple(r) for r in topk.top_k(spark.createDataFrame(rows, VEC)).collect()), key=str)
    assert got == brute_top(rows, 20)


def test_top_k_without_vectors_or_queries(spark):
    assert topk.top_k(spark.createDataFrame([], VEC)).collect() == []
    assert topk.top_k(spark.createDataFrame([(1, [1.0], 0), (None, [1.0], 0)], VEC)).collect() == []
    assert topk.top_k(spark.createDataFrame([(20, [1.0], 0)], VEC)).collect() == []
