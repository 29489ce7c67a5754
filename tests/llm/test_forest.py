"""The hash-prefix forest: what its prefixes decide, and recall of the registered query."""

import numpy as np
import pytest

from walkloom.llm import ann_forest, queries

SF = "/root/testdata/sf0.01"


def clustered():
    """Rows spread evenly, and clusters of several widths."""
    rng = np.random.default_rng(3)
    m = rng.normal(size=(3000, 32))
    for k, (a, b) in enumerate([(0, 400), (400, 700), (700, 900)]):
        m[a:b] = rng.normal(size=32) + m[a:b] * (0.02, 0.1, 0.3)[k]
    return m / np.linalg.norm(m, axis=1)[:, None]


def test_prefixes_decide():
    """Queries stop at prefixes of different lengths, longer in closer clusters; strings of one symbol give other candidates."""
    m = clustered()
    q = m[::30]
    full, flat = ann_forest.Forest(m, 1.0), ann_forest.Forest(m, 1.0, depth=1)
    length = full.ranges(ann_forest.strings(q, np.zeros(len(q))), 450)[2]
    assert len(set(length.tolist())) >= 2 and length[:13].mean() >= length[13:23].mean() > length[30:].mean()
    one, many = ([set(x.tolist()) for x in f.candidates(ann_forest.strings(q, np.zeros(len(q)), depth=f.depth), 450)] for f in (flat, full))
    assert sum(a != b for a, b in zip(one, many)) > 0.9 * len(q)
    hit = 0
    for k, found in enumerate(many):
        assert found <= set(range(len(m)))
        hit += len(found & set(np.argsort(-(m @ q[k]))[1:21].tolist()))
    assert hit / (20 * len(q)) >= 0.9
    assert np.mean([len(x) for x in many]) < 0.4 * len(m) < np.mean([len(x) for x in one])


def test_trees_are_independent():
    """No symbol stands in two trees, and the symbols of a string are its own."""
    m = clustered()[900:]
    s = ann_forest.strings(m, np.zeros(len(m)), trees=24)
    symbols = [(t >> np.uint32(ann_forest.BITS * k)) & np.uint32((1 << ann_forest.BITS) - 1) for t in s for k in range(ann_forest.DEPTH)]
    assert len({x.tobytes() for x in symbols}) == 24 * ann_forest.DEPTH
    agree = np.array([[np.mean(a == b) for b in symbols[k + 1 :]] for k, a in enumerate(symbols[:-1])][0])
    assert agree.max() < 0.2  # as of chance, one in 32


def test_ranges():
    """The ranges are the rows that share the prefix, and the ascent stops at the first length that holds enough."""
    m = clustered()[::5]
    f, codes = ann_forest.Forest(m, 1.0), ann_forest.strings(m[:40], np.zeros(40))
    lo, hi, length = f.ranges(codes, 200)
    own = ann_forest.strings(m, np.sqrt(np.maximum(1 - (m**2).sum(1), 0)))
    for k in range(40):
        for depth in range(ann_forest.DEPTH, -1, -1):
            shift = np.uint32(ann_forest.BITS * (ann_forest.DEPTH - depth))
            same = own >> shift == (codes[:, k] >> shift)[:, None]
            if depth == 0 or same.sum() - (len(own) - 1) * (own == codes[:, k][:, None]).sum(1).min() >= 200:
                break
        assert depth == length[k]
        if depth:
            assert all(set(f.order[t][lo[t, k] : hi[t, k]].tolist()) == set(np.flatnonzero(same[t]).tolist()) for t in range(len(own)))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_registered_query(spark, sf):
    """op7 against brute force over every query: 20 nearest, recall of 0.9, scores exact."""
    d = f"/root/testdata/{sf}"
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect() if r["embedding"]}
    ids = np.array(sorted(rows))
    m = np.array([rows[i] for i in ids])
    out = {}
    for r in queries.op7_ann_forest(spark, d).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    assert set(out) == {i for i in ids.tolist() if i % 20 == 0}
    for q, got in out.items():
        got.sort()
        assert [g[0] for g in got] == list(range(1, 21)) and all(abs(rows[q] @ rows[i] - s) < 1e-12 and i != q for _, i, s in got)
        assert got == sorted(got, key=lambda g: (-g[2], g[1]))
        s = m @ rows[q]
        s[ids == q] = -np.inf
        hit += len({g[1] for g in got} & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
    assert hit / (20 * len(out)) >= 0.9, hit / (20 * len(out))
