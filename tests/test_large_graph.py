"""Walks of graphs spread over rows against those of one row, on graphs of every shape."""

import random

import pytest
from pyspark.sql import functions as F

from walkloom.operators import large_graph as lg
from walkloom.operators import walks

SHAPES = {
    "random": lambda rng, n: {tuple(sorted(rng.sample(range(n), 2))) for _ in range(2 * n)},
    "path": lambda rng, n: {(k, k + 1) for k in range(5)},
    "star": lambda rng, n: {(0, k) for k in range(1, n)},
    "parts": lambda rng, n: {(0, 1), (1, 2), (0, 2), (3, 4), (5, 6), (6, 7), (5, 7)},
    "tree": lambda rng, n: {(rng.randrange(k), k) for k in range(1, n)},
}


@pytest.fixture(scope="module")
def graphs():
    """graph id -> pairs of nodes."""
    rng = random.Random(7)
    return {g: sorted(make(rng, 9)) for g, make in enumerate([*SHAPES.values(), SHAPES["random"], SHAPES["tree"]])}


@pytest.fixture(scope="module")
def edges(spark, graphs):
    rows = [(g, s, d) for g, pairs in graphs.items() for a, b in pairs for s, d in ((a, b), (b, a))]
    return spark.createDataFrame([(g, k, s, d, (s + d) % 5 + (s * d) % 3) for k, (g, s, d) in enumerate(rows)], "graph_id long, edge_id long, src long, dst long, cost long").cache()


def arcs(pairs):
    return [(s, d, 0, 0) for a, b in pairs for s, d in ((a, b), (b, a))]


def test_bfs(edges, graphs):
    rounds = []
    got = lg.bfs(edges, rounds=rounds).collect()
    for g, pairs in graphs.items():
        own = sorted((r for r in got if r["graph_id"] == g), key=lambda r: r["place"])
        least = min(min(p) for p in pairs)
        assert [r["node_id"] for r in own] == walks.bfs(range(9), arcs(pairs), least)
        assert [r["place"] for r in own] == list(range(len(own))) and own[0]["parent"] is None
        level = {r["node_id"]: r["level"] for r in own}
        assert all(level[r["node_id"]] == level[r["parent"]] + 1 and tuple(sorted((r["parent"], r["node_id"]))) in pairs for r in own[1:])
    assert len(rounds) == 1 + max(r["level"] for r in got)


def test_topo(spark, edges, graphs):
    nodes = spark.createDataFrame([(g, v) for g in graphs for v in range(9)], "graph_id long, node_id long")
    got = lg.topo(nodes, edges).collect()
    for g, pairs in graphs.items():
        own = sorted((r for r in got if r["graph_id"] == g), key=lambda r: r["place"])
        assert [r["node_id"] for r in own] == walks.topo(list(range(9)), arcs(pairs), 0)


def test_euler(spark, edges, graphs):
    both = edges.union(spark.createDataFrame([(0, 900, 0, 0, 0), (90, 901, 1, 2, 0), (90, 902, 2, 1, 0), (90, 903, 1, 2, 0), (90, 904, 2, 1, 0), (90, 905, 4, 4, 0)], edges.schema))
    ends = {r["edge_id"]: (r["graph_id"], r["src"], r["dst"]) for r in both.collect()}
    got = lg.euler(both).collect()
    assert sorted(r["edge_id"] for r in got) == sorted(ends)
    tours = {}
    for r in sorted(got, key=lambda r: r["pos"]):
        assert ends[r["edge_id"]][0] == r["graph_id"]
        tours.setdefault((r["graph_id"], r["root"]), []).append((r["pos"], *ends[r["edge_id"]][1:]))
    for (_, root), t in tours.items():
        assert [x[0] for x in t] == list(range(len(t))) and t[0][1] == t[-1][2] == root
        assert all(a[2] == b[1] for a, b in zip(t, t[1:]))
    assert sum(k[0] == list(SHAPES).index("parts") for k in tours) == 3 and sum(k[0] == 90 for k in tours) == 2
    with pytest.raises(Exception, match="none the other way"):
        lg.euler(spark.createDataFrame([(0, 0, 1, 2)], "graph_id long, edge_id long, src long, dst long")).count()


def test_euler_places_items_once(spark, edges, monkeypatch):
    """Rounds are of nodes, not of edges; nodes whose items several tasks share are walked as others."""
    rounds = []
    rows = lambda df: sorted(map(tuple, df.select("graph_id", "root", "pos", "edge_id").collect()))
    got = rows(lg.euler(edges, rounds=rounds))
    nodes = edges.select("graph_id", "src").distinct().count()
    assert sum(n for what, n in rounds if what == "euler up") == sum(n for what, n in rounds if what == "euler down") == nodes - len({r[:2] for r in got})
    monkeypatch.setattr(lg, "NODE_ITEMS", 1)
    assert rows(lg.euler(edges)) == got


@pytest.mark.parametrize("delta", [3])
def test_shortest_paths(edges, graphs, delta):
    rounds = []
    got = lg.shortest_paths(edges, lg.least_nodes(edges), delta, rounds).collect()
    for g, pairs in graphs.items():
        near = {}
        for a, b in pairs:
            c = (a + b) % 5 + (a * b) % 3
            near.setdefault(a, []).append((b, c))
            near.setdefault(b, []).append((a, c))
        dist = walks.shortest(near, min(near))[0]
        own = {r["node_id"]: r for r in got if r["graph_id"] == g}
        assert {v: r["dist"] for v, r in own.items()} == dist
        for v, r in own.items():
            assert r["predecessors"] == sorted(u for u, c in near[v] if u in dist and dist[u] + c == dist[v])
    assert {w for w, _ in rounds} == {"light", "heavy"}


def test_empty(spark):
    none = spark.createDataFrame([], "graph_id long, edge_id long, src long, dst long, cost long")
    assert lg.bfs(none).count() == lg.euler(none).count() == 0
    assert lg.topo(none.select("graph_id", F.col("src").alias("node_id")), none).count() == 0
    assert lg.shortest_paths(none, lg.least_nodes(none), 3).count() == 0


def test_ranked(spark):
    """Places in groups that several tasks share, and sums before."""
    rng = random.Random(2)
    rows = [(0 if k < 400 else k % 5, rng.random(), rng.randrange(9)) for k in range(500)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = lg.ranked(spark.createDataFrame(rows, "g long, x double, v long").repartition(7), ["g"], ["x"], "v").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 500
    for g in range(5):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["x"])
        assert [r["place"] for r in own] == list(range(len(own)))
        assert [r["before"] for r in own] == [sum(r["v"] for r in own[:k]) for k in range(len(own))]
