"""Walks over one packed graph, and the operators that run them over a table of graphs.

A graph is types (by node id) and edges (src, dst, type, count) by edge id, both directions stored.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walkloom.operators import matching

METHODS = ("feuler", "eulerian", "cpp", "fcpp", "bfs", "dfs", "topo")


def component_roots(n: int, pairs) -> list[int]:
    """The least node of each node's component."""
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def circuit(out: dict[int, list[int]], start: int) -> list[int]:
    """Nodes of a trail that uses each listed arc once; arcs of a node go in the order listed."""
    at, open_, done = dict.fromkeys(out, 0), [start], []
    while open_:
        v = open_[-1]
        arcs = out.get(v, ())
        if at.get(v, 0) < len(arcs):
            at[v] += 1
            open_.append(arcs[at[v] - 1])
        else:
            done.append(open_.pop())
    return done[::-1]


def neighbours(edges) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for s, d, *_ in edges:
        out.setdefault(s, []).append(d)
    return out


def sorted_neighbours(edges) -> dict[int, list[int]]:
    near = neighbours(edges)
    for x in near.values():
        x.sort()
    return near


def first_with_arcs(out: dict, start: int, nodes: list[int]) -> int:
    """start, or the next node after it (then before it) that has arcs."""
    k = nodes.index(start) if start in nodes else 0
    return next((v for v in nodes[k:] + nodes[:k] if out.get(v)), start)


def feuler(nodes, edges, start):
    count = {(s, d): c for s, d, _, c in reversed(edges)}
    out = {v: sorted(ds, key=lambda d: (-count[v, d], d)) for v, ds in neighbours(edges).items()}
    return circuit(out, first_with_arcs(out, start, nodes))


def eulerian(nodes, edges, start):
    out = neighbours(edges)
    into = neighbours([(d, s) for s, d, *_ in edges])
    if any(len(out.get(v, ())) != len(into.get(v, ())) for v in nodes):
        for s, ds in into.items():
            out.setdefault(s, []).extend(ds)
    out = {v: sorted(ds, reverse=True) for v, ds in out.items()}
    return circuit(out, first_with_arcs(out, start, nodes))


def shortest(near: dict[int, list[tuple[int, float]]], start: int) -> tuple[dict, dict]:
    """Distances and predecessors; equal distances keep the smaller predecessor."""
    dist, prev, heap = {start: 0.0}, {}, [(0.0, start)]
    while heap:
        d, v = heapq.heappop(heap)
        if d > dist[v]:
            continue
        for u, c in near[v]:
            if d + c < dist.get(u, float("inf")) or (d + c == dist.get(u) and u != start and v < prev.get(u, v)):
                if d + c < dist.get(u, float("inf")):
                    heapq.heappush(heap, (d + c, u))
                dist[u], prev[u] = d + c, v
    return dist, prev


def walked_twice(near: dict[int, dict[int, float]]) -> list[tuple[int, int]]:
    """Edges that, walked once more, leave no node of odd degree, at the least summed cost. near: costs by node and neighbour.

    An edge to a node of degree one must be in if that node is odd, so such nodes are taken off one after another;
    what is left is solved by shortest paths between odd nodes and a least-cost matching of these.
    """
    odd = {v for v, x in near.items() if len(x) % 2}
    left, again = {v: dict(x) for v, x in near.items()}, []
    ends = [v for v, x in left.items() if len(x) == 1]
    while ends:
        v = ends.pop()
        if len(left[v]) != 1:
            continue
        (u, _), left[v] = *left[v].items(), {}
        del left[u][v]
        if v in odd:
            again.append((u, v))
            odd ^= {u, v}
        if len(left[u]) == 1:
            ends.append(u)
    lists, rest = {v: sorted(x.items()) for v, x in left.items()}, sorted(odd)
    paths = {v: shortest(lists, v) for v in rest}
    for a, b in matching.pairs(rest, lambda a, b: paths[a][0][b]):
        while b != a:
            again.append((paths[a][1][b], b))
            b = paths[a][1][b]
    return again


def pair_costs(edges, costs=None) -> dict[int, dict[int, float]]:
    """Costs by node and neighbour; 1 if none are given."""
    near: dict[int, dict[int, float]] = {}
    for s, d, *_ in edges:
        if d != s and d not in near.get(s, ()):
            near.setdefault(s, {})[d] = near.setdefault(d, {})[s] = costs[min(s, d), max(s, d)] if costs else 1.0
    return near


def postman(nodes, edges, start, costs=None):
    """A closed walk over every pair of nodes joined by an edge, with the cheapest pairs walked twice. costs: of a pair, 1 if none are given."""
    near = pair_costs(edges, costs)
    left: dict[int, list[int]] = {v: sorted(x) for v, x in near.items()}
    for a, b in walked_twice(near):
        left[a].append(b)
        left[b].append(a)
    left = {v: sorted(x, reverse=True) for v, x in left.items()}
    open_, done = [first_with_arcs(left, start, nodes)], []
    while open_:
        v = open_[-1]
        if left.get(v):
            u = left[v].pop()
            left[u].remove(v)
            open_.append(u)
        else:
            done.append(open_.pop())
    return done[::-1]


def fcpp_costs(edges) -> dict:
    """The costs of pairs by the logarithm of their triplets' counts, from 0.5 for the commonest to 1."""
    import math

    weight: dict = {}
    for s, d, _, c in edges:
        weight.setdefault((min(s, d), max(s, d)), math.log10(max(c, 1)))
    lo, hi = min(weight.values(), default=0), max(weight.values(), default=0)
    return {k: 0.5 + 0.5 * (1 - ((w - lo) / (hi - lo) if hi > lo else 0.5)) for k, w in weight.items()}


def fcpp(nodes, edges, start):
    return postman(nodes, edges, start, fcpp_costs(edges))


def bfs(nodes, edges, start, near=None):
    """near: sorted_neighbours(edges), where several walks share them."""
    near = sorted_neighbours(edges) if near is None else near
    seen, out = {start}, [start]
    for v in out:
        for u in near.get(v, ()):
            if u not in seen:
                seen.add(u)
                out.append(u)
    return out


def dfs(nodes, edges, start):
    near, seen, out = neighbours(edges), set(), []
    for root in [start, *nodes]:
        open_ = [root]
        while open_:
            v = open_.pop()
            if v not in seen:
                seen.add(v)
                out.append(v)
                open_ += [u for u in reversed(near.get(v, ())) if u not in seen]
    return out


def topo(nodes, edges, start):
    """Edges run from larger to smaller ids; the smallest node that is ready goes first."""
    arcs = {(s, d) for s, d, *_ in edges if s > d}
    waits = dict.fromkeys(nodes, 0)
    for _, d in arcs:
        waits[d] += 1
    ready, out, near = [v for v in nodes if not waits[v]], [], neighbours(arcs)
    heapq.heapify(ready)
    while ready:
        out.append(v := heapq.heappop(ready))
        for d in near.get(v, ()):
            waits[d] -= 1
            if not waits[d]:
                heapq.heappush(ready, d)
    return out


WALKS = {"feuler": feuler, "eulerian": eulerian, "cpp": postman, "fcpp": fcpp, "bfs": bfs, "dfs": dfs, "topo": topo}


def register(name: str, walk) -> None:
    """Adds a method: a function of (nodes, edges, start) that gives nodes in order."""
    WALKS[name] = walk


def starts(n: int, k: int) -> list[int]:
    """Starts of at most k variants, evenly spread."""
    k = min(k, n)
    return [i * max(1, n // k) % n for i in range(k)] if k else []


def tokens_of(path, types, edges, omit, with_edges: bool, named: bool = True, ids: list[int] | None = None) -> tuple[list[int], list[str]]:
    """Node tokens 2t + 1 with edge tokens 2t between them, but for edges of the type omit; and, if named, what each came from."""
    if not with_edges:
        return [2 * types[v] + 1 for v in path], [f"node_{v}" for v in path] if named else []
    kind: dict = {}
    for k, (s, d, t, _) in enumerate(edges):
        kind.setdefault((s, d), (t, k))
    tokens, names, before = [], [], None
    for v in path:
        if before is not None:
            t, k = kind.get((before, v)) or kind[v, before]
            if t != omit:
                tokens.append(2 * t)
                if named:
                    names.append(f"edge_{ids[k] if ids else k}")
        tokens.append(2 * types[v] + 1)
        if named:
            names.append(f"node_{v}")
        before = v
    return tokens, names


def walk(types, edges, method: str, start: int = 0, omit: int | None = 1, with_edges: bool = True, separator: int = 7, named: bool = True, near=None) -> tuple[list[int], list[str]]:
    """Tokens and, if named, what each came from. near: what shared() gave. Euler and postman walks take components by size downwards, parted by a separator."""
    n, run = len(types), WALKS[method]
    if not n:
        return [], []
    if method in ("bfs", "dfs", "topo"):
        return tokens_of(run(list(range(n)), edges, start, *([near] if near else [])), types, edges, omit, False, named)
    roots = component_roots(n, [(s, d) for s, d, *_ in edges])
    parts: dict[int, list[int]] = {}
    for v, r in enumerate(roots):
        parts.setdefault(r, []).append(v)
    own: dict[int, list] = {r: [] for r in parts}
    ids: dict[int, list[int]] = {r: [] for r in parts}
    for k, e in enumerate(edges):
        own[roots[e[0]]].append(e)
        ids[roots[e[0]]].append(k)
    tokens, names = [], []
    order = sorted(parts, key=lambda r: (-len(parts[r]), r))
    for k, r in enumerate(order):
        t, e = tokens_of(run(parts[r], own[r], start if len(order) == 1 else r), types, own[r], omit, with_edges, named, ids[r])
        if k:
            tokens.append(separator)
            names.append("component_sep")
        tokens += t
        names += e
    return tokens, names


def shared(edges, method: str):
    """What all walks of a graph by this method can share, if there is such."""
    return sorted_neighbours(edges) if WALKS[method] is bfs else None


def packed_rows(batch):
    """graph_id, types, edges (src, dst, type, count) of the rows of a batch of packed graphs, without a dictionary an edge."""
    types, edges = batch.column("types"), batch.column("edges")
    e = edges.flatten()
    flat = list(zip(*(e.field(c).to_pylist() for c in ("src", "dst", "edge_type", "cnt")))) if len(e) else []
    ends = 0
    for g, t, x in zip(batch.column("graph_id").to_pylist(), types.to_pylist(), edges):
        n = len(x) if x.is_valid else 0
        yield g, t or [], flat[ends : ends + n]
        ends += n


def serialize(packed: DataFrame, method: str = "feuler", variants: int = 1, omit: int | None = 1, with_edges: bool = True, separator: int = 7, elements: bool = True) -> DataFrame:
    """graph_id, variant_id, tokens and, if asked for, elements of packed graphs. A graph is a row, so nothing is shuffled."""

    def run(batches):
        for b in batches:
            ids, ks, tokens, names = [], [], [], []
            for g, types, edges in packed_rows(b):
                near = shared(edges, method)
                for k, s in enumerate(starts(len(types), variants)):
                    t, e = walk(types, edges, method, s, omit, with_edges, separator, elements, near)
                    ids.append(g)
                    ks.append(k)
                    tokens.append(t)
                    names.append(e)
            out = [pa.array(ids, pa.int64()), pa.array(ks, pa.int32()), pa.array(tokens, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*out, pa.array(names, pa.list_(pa.string()))] if elements else out, ["graph_id", "variant_id", "tokens", "elements"][: 3 + elements])

    return packed.select("graph_id", "types", "edges").mapInArrow(run, "graph_id long, variant_id int, tokens array<int>" + (", elements array<string>" if elements else ""))


def postman_costs(packed: DataFrame, weighted: bool = False) -> DataFrame:
    """graph_id, odd (nodes of odd degree), again (edges walked twice), cost (of these) of packed graphs: the least cost of an even graph."""

    def run(batches):
        for b in batches:
            rows = []
            for g, _, edges in packed_rows(b):
                costs = fcpp_costs(edges) if weighted else None
                near = pair_costs(edges, costs)
                again = walked_twice(near)
                rows.append((g, sum(len(x) % 2 for x in near.values()), len(again), sum(near[a][b] for a, b in again)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["graph_id", "odd", "again", "cost"])

    return packed.select("graph_id", "types", "edges").mapInArrow(run, "graph_id long, odd long, again long, cost double")


def odd_paths(packed: DataFrame) -> DataFrame:
    """graph_id, src, dst, hops: shortest paths between nodes of odd degree in one component, src < dst."""

    def run(batches):
        for b in batches:
            rows = []
            for g, _, edges in packed_rows(b):
                near = pair_costs(edges)
                lists = {v: sorted(x.items()) for v, x in near.items()}
                odd = [v for v in near if len(near[v]) % 2]
                for v in odd:
                    dist = shortest(lists, v)[0]
                    rows += [(g, v, u, int(dist[u])) for u in odd if u > v and u in dist]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int64()))], ["graph_id", "src", "dst", "hops"])

    return packed.select("graph_id", "types", "edges").mapInArrow(run, "graph_id long, src int, dst int, hops long")


def provenance(sequences: DataFrame) -> DataFrame:
    """graph_id, variant_id, pos, kind (node, edge or unknown), id of each token."""
    x = sequences.select("graph_id", "variant_id", F.posexplode("elements").alias("pos", "e"))
    kind = F.split_part("e", F.lit("_"), F.lit(1))
    known = kind.isin("node", "edge")
    return x.select("graph_id", "variant_id", "pos", F.when(known, kind).otherwise("unknown").alias("kind"), F.when(known, F.split_part("e", F.lit("_"), F.lit(2)).cast("int")).alias("id"))
