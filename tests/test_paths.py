"""Proof paths against breadth-first search."""

import itertools
import random
from collections import deque

from claimloom.operators import graph


def brute(a, c, edges):
    """Of the shortest paths, the one least when read from its end."""
    before, depth, queue = {a: []}, {a: 0}, deque([a])
    while queue:
        u = queue.popleft()
        for v in sorted({y for x, y in edges if x == u}):
            if v not in depth:
                depth[v] = depth[u] + 1
                before[v] = []
                queue.append(v)
            if depth[v] == depth[u] + 1:
                before[v].append(u)
    if c not in depth:
        return None
    path = [c]
    while path[-1] != a:
        path.append(min(before[path[-1]]))
    return path[::-1]


def test_paths_are_the_shortest(spark):
    rng = random.Random(3)
    nodes = [f"n{i}" for i in range(24)]
    edges = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(40)} | {(f"m{i}", f"m{i + 1}") for i in range(9)} | {("m9", "m0")}
    pairs = [tuple(rng.sample(nodes, 2)) for _ in range(60)] + [("m0", "m9"), ("m5", "m4"), ("n1", "n1"), ("m3", "n1"), ("gone", "n1"), (None, "n1"), ("n1", None), ("m0", "m9")]
    e = spark.createDataFrame([*edges, (None, "n1"), ("n1", None)], "src string, dst string")
    got = [(r.a, r.c, r.path, r.length) for r in graph.proof_paths(spark.createDataFrame(pairs, "a string, c string"), e).collect()]
    want = [(a, c, None if None in (a, c) else brute(a, c, edges)) for a, c in pairs]
    assert sorted(got, key=str) == sorted(((a, c, p, p and len(p) - 1) if p is not None else (a, c, None, None) for a, c, p in want), key=str)
    how = {(r.a, r.c): r.how for r in graph.implies(spark.createDataFrame(pairs, "a string, c string"), e).collect()}
    for a, c, p in want:
        assert how[a, c] == ("none" if p is None else ["reflexive", "direct"][len(p) - 1] if len(p) < 3 else "transitive")


def test_search_stays_around_the_pairs(spark):
    """A pair with a small neighbourhood on one side costs that side, however wide the other is."""
    wide = [("hub", f"w{i}") for i in range(500)] + [(f"w{i}", f"x{i}") for i in range(500)] + [("x7", "end")]
    edges = spark.createDataFrame(wide, "src string, dst string")
    search = graph.Search(spark.createDataFrame([("hub", "end")], "a string, c string"), edges)
    made = sum(x.count() for x in itertools.chain(search.ahead, search.behind))
    assert made < 520 and search.lengths().first()["length"] == 3


def test_no_pairs(spark):
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    none = spark.createDataFrame([], "a string, c string")
    assert graph.proof_paths(none, edges).collect() == [] and graph.implies(none, edges).collect() == []
