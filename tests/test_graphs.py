"""Graph operators against their definitions on random graphs; a cycle of ten thousand nodes; odd input."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from quarrylens.operators import graphs


def frame(spark, edges, kind="long"):
    return spark.createDataFrame(edges, f"a {kind}, b {kind}").repartition(2)


def components(edges):
    ahead = collections.defaultdict(set)
    for a, b in edges:
        ahead[a].add(b)

    def reach(n):
        seen, todo = set(), [n]
        while todo:
            for m in ahead[todo.pop()]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        return seen

    nodes = {n for e in edges for n in e}
    far = {n: reach(n) for n in nodes}
    out = set()
    for n in nodes:
        group = {m for m in far[n] if n in far[m]} | {n}
        if len(group) > 1:
            out.add((n, min(group), len(group)))
    return out


@pytest.mark.parametrize("few", [0, 7, 20_000])
@pytest.mark.parametrize("n,m", [(30, 20), (30, 40), (30, 90)])
def test_components(spark, few, n, m):
    rnd = random.Random(n * m)
    edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)] + [(100, 101), (101, 100), (101, 102), (102, 101), (200, 200), (300, 301), (301, 302), (302, 303)]
    got = graphs.strongly_connected(frame(spark, edges), few)
    assert {tuple(r) for r in got.select("node", "component", "size").collect()} == components(edges)


def test_a_long_cycle(spark):
    n = 10_000
    cycle = [(i, (i + 1) % n) for i in range(n)] + [(n + i, n + i + 1) for i in range(500)] + [(5, n)]
    got = graphs.strongly_connected(frame(spark, cycle), 0)
    assert [tuple(r) for r in got.groupBy("component", "size").count().collect()] == [(0, n, n)]


def test_components_of_nothing(spark):
    assert graphs.strongly_connected(frame(spark, [])).count() == 0
    assert graphs.strongly_connected(frame(spark, [(1, 1)])).count() == 0
    got = graphs.strongly_connected(frame(spark, [("b", "a"), ("a", "b"), ("a", "c")], "string"), 0)
    assert {tuple(r) for r in got.select("node", "component", "size").collect()} == {("a", "a", 2), ("b", "a", 2)}


@pytest.mark.parametrize("depth", [1, 2, 5])
def test_reach(spark, depth):
    rnd = random.Random(depth)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(80)]
    sources = [1, 2, 99, 1]
    seen = {n: (0, None) for n in sources}
    for k in range(1, depth + 1):
        new = {}
        for a, b in edges:
            if a in seen and seen[a][0] == k - 1 and b not in seen:
                new[b] = min(new.get(b, a), a)
        seen |= {b: (k, a) for b, a in new.items()}
    got, beyond = graphs.reach(frame(spark, edges), spark.createDataFrame([(n, "x") for n in sources] + [(None, "x")], "node long, depth string"), depth)
    assert {(r.node, r.depth, r.via) for r in got.collect()} == {(n, d, v) for n, (d, v) in seen.items()}
    assert {tuple(r) for r in beyond.collect()} == {(a, b) for a, b in edges if a in seen and seen[a][0] == depth and b not in seen}


def test_resolve(spark):
    names = spark.createDataFrame([("p1", "/a/b"), ("p2", "/a/c/"), ("p3", "/x"), ("p4", "/x/"), ("p5", None), ("p6", "/only"), ("p7", "/only/below")], "node string, path string")
    links = spark.createDataFrame([("p1", "/a"), ("p1", "a/"), ("p2", "/x"), ("p3", "/nowhere"), ("p4", "/a/b"), ("p6", "/only"), ("p2", "/only")], "src string, name string")
    edges, notes = graphs.resolve(links, names)
    assert {tuple(r) for r in edges.collect()} == {("p1", "/a"), ("/a", "p1"), ("/a", "p2"), ("p4", "p1"), ("p2", "p6")}
    assert {tuple(r) for r in notes.collect()} == {("p1", "/a", "prefix", 2), ("p1", "a/", "prefix", 2), ("p2", "/x", "ambiguous", 2), ("p3", "/nowhere", "missing", 0)}
    left = links.distinct().count() - notes.where(F.col("kind") != "prefix").count()
    assert left == notes.where("kind = 'prefix'").count() + 3  # each link is an edge or a note
