"""Golden walks of a five-node graph, and properties of walks of random graphs."""

import random
from collections import Counter

import pytest

from walkloom.operators import matching, walks

TYPES, PAIRS = [6, 6, 8, 1, 7], [(0, 1, 1), (1, 2, 2), (0, 3, 1), (1, 4, 1), (2, 4, 1)]


def bidirected(types, pairs):
    e = [x for s, d, t in pairs for x in ((s, d, t), (d, s, t))]
    n = Counter((types[s], t, types[d]) for s, d, t in e)
    return [(s, d, t, n[types[s], t, types[d]]) for s, d, t in e]


@pytest.mark.parametrize("method,start,path", [
    ("feuler", 0, "0 1 2 1 4 2 4 1 0 3 0"), ("feuler", 2, "2 1 0 3 0 1 2 4 1 4 2"), ("eulerian", 0, "0 3 0 1 4 2 4 1 2 1 0"), ("eulerian", 2, "2 4 2 1 4 1 0 3 0 1 2"),
    ("bfs", 0, "0 1 3 2 4"), ("dfs", 0, "0 1 2 4 3"), ("topo", 0, "3 4 2 1 0")])
def test_golden_paths(method, start, path):
    assert walks.WALKS[method](list(range(5)), bidirected(TYPES, PAIRS), start) == [int(x) for x in path.split()]


def test_golden_tokens():
    e = bidirected(TYPES, PAIRS)
    assert walks.walk(TYPES, e, "feuler")[0] == [13, 13, 4, 17, 4, 13, 15, 17, 15, 13, 13, 3, 13]
    assert walks.walk(TYPES, e, "eulerian")[0] == [13, 3, 13, 13, 15, 17, 15, 13, 4, 17, 4, 13, 13]
    assert len(walks.walk(TYPES, e, "feuler", omit=None)[0]) == 21
    assert walks.starts(5, 3) == [0, 1, 2] and walks.starts(5, 10) == [0, 1, 2, 3, 4] and walks.starts(0, 3) == []


def test_edge_cases():
    assert walks.walk([], [], "feuler") == ([], [])
    for m in walks.METHODS:
        assert walks.walk([3], [], m)[0] == [7]
    tokens, names = walks.walk([1, 1, 2, 2, 2], bidirected([1, 1, 2, 2, 2], [(0, 1, 1), (2, 3, 1), (3, 4, 1)]), "feuler")
    assert tokens.count(7) == 1 and names[5] == "component_sep" and names[0] == "node_2"


@pytest.mark.parametrize("seed", range(30))
def test_circuits_use_each_edge_once(seed):
    rng = random.Random(seed)
    n = rng.randint(2, 12)
    pairs = {(rng.randrange(v), v) for v in range(1, n)} | {tuple(sorted(rng.sample(range(n), 2))) for _ in range(n)}
    types = [rng.randrange(4) for _ in range(n)]
    e = bidirected(types, [(a, b, rng.randrange(3)) for a, b in sorted(pairs)])
    for m in ("feuler", "eulerian"):
        p = walks.WALKS[m](list(range(n)), e, 0)
        assert len(p) == len(e) + 1 and p[0] == p[-1] == 0 and Counter(zip(p, p[1:])) == Counter((s, d) for s, d, *_ in e)
    p = walks.WALKS["cpp"](list(range(n)), e, 0)
    assert p[0] == p[-1] and {tuple(sorted(x)) for x in zip(p, p[1:])} == pairs
    odd = [v for v in range(n) if sum(v in x for x in pairs) % 2]
    near = {v: [(b if a == v else a, 1.0) for a, b in pairs if v in (a, b)] for v in range(n)}
    cost = {(a, b): walks.shortest(near, a)[0][b] for a in odd for b in odd}

    def least(left):
        return 0 if not left else min(cost[left[0], b] + least([x for x in left[1:] if x != b]) for b in left[1:])

    assert len(odd) > 8 or len(p) - 1 - len(pairs) == least(odd)


def least_sum(n, cost):
    """The least cost of a perfect matching, by all of them."""
    from functools import lru_cache

    @lru_cache(None)
    def rest(mask):
        if not mask:
            return 0
        i = (mask & -mask).bit_length() - 1
        return min(cost[i][j] + rest(mask ^ (1 << i) ^ (1 << j)) for j in range(i + 1, n) if mask >> j & 1)

    return rest((1 << n) - 1)


@pytest.mark.parametrize("seed", range(60))
def test_matching_is_least(seed):
    rng = random.Random(seed)
    n, most = rng.choice([2, 4, 6, 8, 10, 12]), rng.choice([2, 5, 100])
    cost = [[0] * n for _ in range(n)]
    for i in range(n):
        for j in range(i):
            cost[i][j] = cost[j][i] = rng.randint(0, most)
    got = matching.pairs(list(range(n)), lambda a, b: cost[a][b])
    assert sorted(x for p in got for x in p) == list(range(n)) and sum(cost[a][b] for a, b in got) == least_sum(n, cost)


@pytest.mark.parametrize("seed", range(3))
def test_matching_of_58_on_a_tree(seed):
    """Between nodes of a tree, the least matching uses the edges that part odd numbers of them; a postman walks just these twice."""
    rng = random.Random(seed)
    up, w = [None] + [rng.randrange(v) for v in range(1, 200)], [0] + [rng.randint(1, 9) for _ in range(199)]
    some = rng.sample(range(200), 58)

    def above(v):
        out, s = {}, 0
        while v is not None:
            out[v], s, v = s, s + w[v], up[v]
        return out

    far = {v: above(v) for v in some}
    cost = lambda a, b: min(far[a][x] + far[b][x] for x in far[a] if x in far[b])
    count = [v in some for v in range(200)]
    best = 0
    for v in range(199, 0, -1):
        best += w[v] * (count[v] % 2)
        count[up[v]] += count[v]
    assert sum(cost(a, b) for a, b in matching.pairs(some, cost)) == best
    near = {v: {} for v in range(200)}
    for v in range(1, 200):
        near[v][up[v]] = near[up[v]][v] = w[v]
    assert sum(near[a][b] for a, b in walks.walked_twice(near)) == sum(w)


@pytest.mark.parametrize("seed", range(20))
def test_walked_twice_is_least(seed):
    """Against matchings of all odd nodes by shortest paths, with weights, on graphs with cycles and leaves."""
    rng = random.Random(seed)
    n = rng.randint(4, 16)
    near = {v: {} for v in range(n)}
    for v in range(1, n):
        u = rng.randrange(v)
        near[v][u] = near[u][v] = rng.randint(1, 20) / 4
    for _ in range(rng.randrange(n)):
        a, b = rng.sample(range(n), 2)
        near[a][b] = near[b][a] = rng.randint(1, 20) / 4
    again = walks.walked_twice(near)
    degree = Counter(v for v in near for _ in near[v]) + Counter(x for e in again for x in e)
    assert all(d % 2 == 0 for d in degree.values())
    lists = {v: sorted(x.items()) for v, x in near.items()}
    odd = [v for v in near if len(near[v]) % 2]
    if len(odd) <= 12:
        assert abs(sum(near[a][b] for a, b in again) - least_sum(len(odd), [[walks.shortest(lists, a)[0][b] for b in odd] for a in odd])) < 1e-6


def test_screen_by_pairs(spark):
    """The screen's degree sums against looking at every pair of nodes."""
    import random
    from itertools import combinations

    from walkloom.operators import graph

    rng, rows, want = random.Random(12), [], {}
    for g in range(150):
        n = rng.randint(3, 9)
        pairs = {p for p in combinations(range(n), 2) if rng.random() < rng.choice([0.4, 0.7, 0.9])}
        rows.append((g, [1] * n, [(s, d, 1, 0) for a, b in sorted(pairs) for s, d in ((a, b), (b, a))]))
        near = {v: {x for p in pairs if v in p for x in p if x != v} for v in range(n)}
        reach, todo = {0}, [0]
        while todo:
            new = near[todo.pop()] - reach
            reach |= new
            todo += new
        if len(reach) < n:
            want[g] = (False, "unconnected")
        elif min(map(len, near.values())) >= n // 2:
            want[g] = (True, "dirac")
        else:
            ok = all(len(near[a]) + len(near[b]) >= n for a, b in combinations(range(n), 2) if b not in near[a])
            want[g] = (ok, "ore" if ok else "neither")
    df = spark.createDataFrame(rows, "graph_id long, types array<int>, edges array<struct<src:int,dst:int,edge_type:int,cnt:long>>")
    assert {r[0]: (r[1], r[2]) for r in graph.hamiltonian_screen(df).collect()} == want
    assert {w for _, w in want.values()} == {"unconnected", "dirac", "ore", "neither"}
