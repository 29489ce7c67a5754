"""Superpixels, scanning of image files, counted graph files, properties and targets, against plain forms."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from walkloom.operators import images as I
from walkloom.sources import importers, io


def plain_segments(image, step, compactness, rounds):
    """Labels pixel by pixel."""
    h, w = len(image), len(image[0])
    seeds = [(float(image[r][c]), float(r), float(c)) for r in range(step // 2, h, step) for c in range(step // 2, w, step)]
    label = {}
    for _ in range(rounds):
        for r in range(h):
            for c in range(w):
                near = [(((image[r][c] - v) * (image[r][c] - v) + (compactness / step) ** 2 * ((r - y) * (r - y) + (c - x) * (c - x))), k) for k, (v, y, x) in enumerate(seeds) if abs(r - y) <= 2 * step and abs(c - x) <= 2 * step]
                label[r, c] = min(near)[1]
        for k in range(len(seeds)):
            own = [p for p, x in label.items() if x == k]
            if own:
                seeds[k] = tuple(sum(x) / len(own) for x in ([image[r][c] for r, c in own], [r for r, _ in own], [c for _, c in own]))
    return label


def regions(label):
    """Sets of linked pixels of one label."""
    left, out = set(label), []
    while left:
        todo, own = [left.pop()], set()
        while todo:
            r, c = todo.pop()
            own.add((r, c))
            for p in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if p in left and label[p] == label[r, c]:
                    left.discard(p)
                    todo.append(p)
        out.append(own)
    return out


def test_segments():
    rng = random.Random(4)
    for _ in range(25):
        h, w, step = rng.choice([(8, 8, 2), (9, 7, 3), (12, 10, 4), (5, 5, 5), (1, 6, 2)])
        image = [[rng.choice([0, 40, 200, 255]) if rng.random() < 0.5 else rng.randrange(256) for _ in range(w)] for _ in range(h)]
        got = I.segments(np.array(image), step, 10.0, 3) if h > step // 2 else None
        if got is None:
            continue
        raw = plain_segments(image, step, 10.0, 3)
        final = {(r, c): int(got[r, c]) for r in range(h) for c in range(w)}
        parts = regions(raw)
        kept = {}
        for p in sorted(parts, key=lambda p: (-len(p), min(r * w + c for r, c in p))):
            kept.setdefault(raw[next(iter(p))], p)
        assert all(final[q] == k for k, p in kept.items() for q in p)
        assert len(regions(final)) == len(set(final.values())) == len(kept)  # each label is one region


def test_graph_of_regions(spark):
    """Edges and representatives of given labels, pixel by pixel."""
    rng = random.Random(5)
    rows, edges, reps = [], set(), set()
    for g in range(20):
        label = [[rng.randrange(3) for _ in range(4)] for _ in range(5)]
        value = [[rng.randrange(9) for _ in range(4)] for _ in range(5)]
        for r in range(5):
            for c in range(4):
                rows.append((g, r, c, value[r][c], label[r][c]))
                if r < 4 and c < 3:
                    edges |= {(g, *sorted((label[r][c], o))) for o in (label[r][c + 1], label[r + 1][c]) if o != label[r][c]}
        for k in {x for row in label for x in row}:
            own = [(r, c) for r in range(5) for c in range(4) if label[r][c] == k]
            y, x = (sum(p[j] for p in own) / len(own) for j in (0, 1))
            r, c = min(own, key=lambda p: (p[0] - y) * (p[0] - y) + (p[1] - x) * (p[1] - x))
            reps.add((g, k, len(own), r, c, value[r][c]))
    df = spark.createDataFrame(rows, "image_id long, r int, c int, pixel int, label int")
    assert {tuple(x) for x in I.region_adjacency(df, 5, 4).collect()} == edges
    assert {tuple(x) for x in I.representatives(df).select("image_id", "label", "size", "r", "c", "pixel").collect()} == reps


@pytest.mark.parametrize("hexadecimal", [True, False])
def test_read_images(spark, tmp_path, hexadecimal):
    """Records of files split in many byte ranges, text or bytes."""
    rng = random.Random(1)
    images = [(k, rng.randrange(10), [rng.randrange(256) for _ in range(16)]) for k in range(200)]
    if hexadecimal:
        io.write_images(f"{tmp_path}/i", spark.createDataFrame(images, "image_id long, label int, pixels array<int>").coalesce(1))
    else:
        (tmp_path / "i").mkdir()
        (tmp_path / "i" / "a.bin").write_bytes(b"".join(bytes([k, *p]) for _, k, p in images))
        (tmp_path / "i" / "_skipped").write_bytes(b"xx")
    back = io.read_images(spark, f"{tmp_path}/i", 16, hexadecimal, split_bytes=500)
    assert back.rdd.getNumPartitions() > 5
    got = sorted((r["file"], r["record"], r["label"], list(r["pixels"])) for r in back.collect())
    assert [x[2:] for x in got] == [x[1:] for x in images] and (hexadecimal or [x[1] for x in got] == list(range(200)))
    if not hexadecimal:
        (tmp_path / "i" / "b.bin").write_bytes(bytes(20))
        with pytest.raises(Exception):
            io.read_images(spark, f"{tmp_path}/i", 16, False).count()


def test_counted(spark, tmp_path, monkeypatch):
    """Graphs of many sizes, none and more lines than a run, one way and both ways."""
    monkeypatch.setattr(importers, "RUN", 3)
    rng = random.Random(2)
    sizes = [3, 0, 1, 10, 0, 2]
    nodes = [[rng.randrange(5) for _ in range(n)] for n in sizes]
    edges = [[(rng.randrange(n), rng.randrange(n), rng.randrange(6)) for _ in range(2 * n)] for n in sizes]
    text = {"num-node-list": sizes, "num-edge-list": [len(e) for e in edges], "graph-label": [k / 2 for k in range(6)], "node-feat": [f"{t},0" for n in nodes for t in n], "edge": [f"{a}, {b}" for e in edges for a, b, _ in e], "edge-feat": [f"{t},1" for e in edges for *_, t in e]}
    for name, lines in text.items():
        (tmp_path / f"{name}.csv").write_text("".join(f"{x}\n" for x in lines))
    g, v, e = importers.read_counted(spark, str(tmp_path))
    assert sorted(map(tuple, g.collect())) == [(k, k / 2) for k in range(6)]
    assert sorted(map(tuple, v.collect())) == sorted((k, i, t + 1) for k, n in enumerate(nodes) for i, t in enumerate(n))
    want = sorted((k, i, a, b, t + 1 if t < 4 else 0) for k, x in enumerate(edges) for i, (a, b, t) in enumerate(x))
    assert sorted(map(tuple, e.collect())) == want
    both = importers.read_counted(spark, str(tmp_path), both_ways=True)[2]
    assert sorted(map(tuple, both.collect())) == sorted([(k, 2 * i, a, b, t) for k, i, a, b, t in want] + [(k, 2 * i + 1, b, a, t) for k, i, a, b, t in want])


def test_properties(spark):
    items = [(1, '{"a": 1, "b": 2.5, "t": true, "s": "x", "long": "' + "y" * 50 + '", "near": "' + "é" * 49 + '", "id": 4, "smiles": "C", "n": null, "l": [1], "o": {"z": 1}}'), (2, '{"properties": {"a": "p", "id": 3, "n": null, "l": [1, 2], "big": "' + "w" * 60 + '"}, "a": 9}'), (3, "{}"), (4, None), (5, "not json"), (6, '{"properties": 5}'), (7, '{"a": 123456789012345678901234567890.5, "b": 1e300}')]
    got = {(r["k"], r["name"]): (r["number"], r["text"]) for r in io.properties(spark.createDataFrame(items, "k long, item string"), "k").collect()}
    assert got == {(1, "a"): (1.0, None), (1, "b"): (2.5, None), (1, "t"): (1.0, None), (1, "s"): (None, "x"), (1, "near"): (None, "é" * 49), (2, "a"): (9.0, None), (2, "id"): (3.0, None), (2, "n"): (None, "null"), (2, "l"): (None, "[1,2]"), (2, "big"): (None, "w" * 60), (6, "properties"): (5.0, None), (7, "a"): (123456789012345678901234567890.5, None), (7, "b"): (1e300, None)}


def test_target(spark):
    assert io.resolved_target(["b"]) == "b" and io.resolved_target(["a", "b"], "b") == "b" and io.resolved_target(["a", "b"], None, "a") == "a" and io.resolved_target([]) is None
    for found, name, default in ((["label", "b"], "nosuch", "label"), (["a", "b"], None, None), (["a", "b"], None, "c"), ([], "x", None)):
        with pytest.raises(ValueError):
            io.resolved_target(found, name, default)
    rows = spark.createDataFrame([({"label": 1.0, "x": 2.0},), ({"label": 3.0},)], "m map<string,double>")
    assert [r[0] for r in rows.select(io.target(F.col("m"), "label")).collect()] == [1.0, 3.0] and io.names(rows, "m") == ["label", "x"]
    with pytest.raises(Exception, match="no property x in label"):  # an absent one isn't taken from elsewhere
        rows.select(io.target(F.col("m"), "x").alias("y")).collect()


def test_aligned_lines(spark, tmp_path):
    (tmp_path / "s.txt").write_text(" CC \nCO\n\n")
    ids = spark.createDataFrame([(7,), (3,), (9,), (8,), (20,)], "graph_id long")
    got = {r[0]: r[1] for r in io.read_aligned_lines(spark, f"{tmp_path}/s.txt", ids, "smiles").collect()}
    assert got == {3: "CC", 7: "CO", 8: "", 9: "", 20: ""}


def test_layouts(spark, tmp_path):
    for name, lines in {"num-node-list": [1], "num-edge-list": [0], "graph-label": [3], "node-feat": [4], "edge": [], "edge-feat": []}.items():
        (tmp_path / f"{name}.csv").write_text("".join(f"{x}\n" for x in lines))
    g, v, e = importers.load(spark, "counted", str(tmp_path))
    assert [tuple(r) for r in g.collect()] == [(0, 3.0)] and [tuple(r) for r in v.collect()] == [(0, 0, 5)] and e.count() == 0
    importers.register("again", lambda s, folder, shift: tuple(x.withColumn("graph_id", F.col("graph_id") + shift) for x in importers.read_counted(s, folder)))
    assert importers.load(spark, "again", str(tmp_path), shift=7)[0].first()["graph_id"] == 7
    for bad in (lambda: importers.register("again", None), lambda: importers.load(spark, "nosuch", "x")):
        with pytest.raises(ValueError):
            bad()
    del importers.LAYOUTS["again"]


def test_pixels_are_made_once_an_image(spark):
    """Within a scan's lambda, neither the levels of gray nor the scanning order are made again for each pixel."""
    from walkloom.sources import views

    plan = I.scanned(views.images(spark, "/root/testdata/sf0.001"), 8, 8, "diag")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_min") == 1 and "array_sort" not in plan
