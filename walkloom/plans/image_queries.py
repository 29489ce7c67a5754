"""Queries over images: the 64 values of an embedding, as 8 x 8 levels of gray."""

from __future__ import annotations

from pyspark.sql import functions as F

from walkloom.operators import bpe
from walkloom.operators import images as I
from walkloom.plans.views_sql import merges
from walkloom.sources import io, views

Q, S = {}, {}
SIDE, STEP, ROUNDS = 8, 2, 2


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


PIXELS = """WITH RECURSIVE im AS (SELECT vec_id AS image_id, CAST(label AS INT) AS label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE len(embedding) = 64),
px AS (SELECT image_id, label, CAST(i AS INT) AS i, CAST(i // 8 AS INT) AS r, CAST(i % 8 AS INT) AS c, CAST(CASE WHEN hi > lo THEN floor((v - lo) / (hi - lo) * 255) ELSE 0 END AS INT) AS pixel FROM (SELECT image_id, label, list_min(e) AS lo, list_max(e) AS hi, generate_subscripts(e, 1) - 1 AS i, unnest(e) AS v FROM im))"""
_images = lambda s, d: views.images(s, d)

query("O-SC3", PIXELS + " SELECT a.image_id, a.label, a.i AS src, b.i AS dst, a.pixel FROM px a JOIN px b ON a.image_id = b.image_id AND abs(a.r - b.r) + abs(a.c - b.c) = 1")(
    lambda s, d: (lambda back: I.grid(back.withColumnRenamed("record", "image_id"), SIDE, SIDE).join(back.select(F.col("record").alias("image_id"), "label"), "image_id"))(_rescanned(s, d)))


def _rescanned(s, d):
    """The images written as records of one width and read back by byte ranges; a record's number in all files is its image_id, as these count from 0."""
    path = io.scratch(s, "images")
    io.write_images(path, _images(s, d))
    back = io.read_images(s, path, SIDE * SIDE, split_bytes=16_384)
    sizes = back.groupBy("file").agg(F.count("*").alias("n"))  # a row a file
    first = sizes.select("file", F.expr("coalesce(sum(n) over (order by file rows between unbounded preceding and 1 preceding), 0)").alias("first"))
    return back.join(first, "file").select((F.col("first") + F.col("record")).alias("record"), "label", "pixels")


_ORDERS = {
    "O-SE9": ("row_major", "r, c"), "O-SE10": ("serpentine", "r, CASE WHEN r % 2 = 0 THEN c ELSE -c END"), "O-SE11": ("diag_zigzag", "r + c, CASE WHEN (r + c) % 2 = 0 THEN -r ELSE r END"),
    "O-SE12": ("diag", "r + c, CASE WHEN (r + c) % 2 = 0 THEN r ELSE -r END"), "O-SE12_row": ("row", "r, c"), "O-SE12_col": ("col", "c, r"), "O-SE12_snake": ("snake", "r, CASE WHEN r % 2 = 0 THEN c ELSE -c END"),
}
for _id, (_how, _key) in _ORDERS.items():
    query(_id, PIXELS + f" SELECT image_id, string_agg(CAST(pixel AS VARCHAR), ' ' ORDER BY {_key}) AS tokens FROM px GROUP BY 1")(
        lambda s, d, how=_how: I.scanned(_images(s, d), SIDE, SIDE, how).withColumn("tokens", F.array_join("tokens", " ")))


def _segments_sql() -> str:
    """seg: image_id, i, r, c, pixel, label. A round gives pixels to seeds and moves these; parts that don't keep their label take one from beside them, in six rounds."""
    out = PIXELS + f", sd0 AS (SELECT image_id, (r // {STEP}) * {SIDE // STEP} + c // {STEP} AS k, CAST(pixel AS DOUBLE) AS v, CAST(r AS DOUBLE) AS sr, CAST(c AS DOUBLE) AS sc FROM px WHERE r % {STEP} = {STEP // 2} AND c % {STEP} = {STEP // 2})"
    for t in range(ROUNDS):
        out += f""", as{t} AS (SELECT px.image_id, i, any_value(r) AS r, any_value(c) AS c, any_value(pixel) AS pixel, min({{'d': (pixel - v) * (pixel - v) + {(10.0 / STEP) ** 2} * ((r - sr) * (r - sr) + (c - sc) * (c - sc)), 'k': k}}).k AS label
FROM px JOIN sd{t} s ON s.image_id = px.image_id AND abs(r - sr) <= {2 * STEP} AND abs(c - sc) <= {2 * STEP} GROUP BY 1, 2),
sd{t + 1} AS (SELECT s.image_id, s.k, coalesce(m.v, s.v) AS v, coalesce(m.r, s.sr) AS sr, coalesce(m.c, s.sc) AS sc FROM sd{t} s LEFT JOIN (SELECT image_id, label, CAST(sum(pixel) AS DOUBLE) / COUNT(*) AS v, CAST(sum(r) AS DOUBLE) / COUNT(*) AS r, CAST(sum(c) AS DOUBLE) / COUNT(*) AS c FROM as{t} GROUP BY 1, 2) m ON m.image_id = s.image_id AND m.label = s.k)"""
    last = f"as{ROUNDS - 1}"
    out += f""", adj AS (SELECT a.image_id, a.i, b.i AS j, a.label = b.label AS same FROM {last} a JOIN {last} b ON a.image_id = b.image_id AND abs(a.r - b.r) + abs(a.c - b.c) = 1),
reach AS (SELECT image_id, i, i AS root FROM {last} UNION SELECT adj.image_id, adj.j, reach.root FROM reach JOIN adj ON adj.image_id = reach.image_id AND adj.i = reach.i AND same AND adj.j > reach.root),
prt AS (SELECT image_id, i, min(root) AS root FROM reach GROUP BY 1, 2), siz AS (SELECT p.image_id, a.label, p.root, COUNT(*) AS n FROM prt p JOIN {last} a ON a.image_id = p.image_id AND a.i = p.i GROUP BY 1, 2, 3),
kept AS (SELECT image_id, label, root FROM siz QUALIFY row_number() OVER (PARTITION BY image_id, label ORDER BY n DESC, root) = 1),
o0 AS (SELECT a.*exclude (label), k.label FROM {last} a JOIN prt p ON p.image_id = a.image_id AND p.i = a.i LEFT JOIN kept k ON k.image_id = a.image_id AND k.root = p.root)"""
    for t in range(6):
        out += f", o{t + 1} AS (SELECT o.image_id, o.i, any_value(o.r) AS r, any_value(o.c) AS c, any_value(o.pixel) AS pixel, coalesce(any_value(o.label), min(b.label)) AS label FROM o{t} o JOIN adj ON adj.image_id = o.image_id AND adj.i = o.i JOIN o{t} b ON b.image_id = adj.image_id AND b.i = adj.j GROUP BY 1, 2)"
    return out + ", seg AS (SELECT * FROM o6)"


SEGMENTS = _segments_sql()
_TOUCH = f", tch AS (SELECT DISTINCT x.image_id, CAST(least(x.label, y.label) AS INT) AS a, CAST(greatest(x.label, y.label) AS INT) AS b FROM seg x JOIN seg y ON x.image_id = y.image_id AND (y.r = x.r AND y.c = x.c + 1 OR y.c = x.c AND y.r = x.r + 1) WHERE x.label <> y.label AND x.r < {SIDE - 1} AND x.c < {SIDE - 1})"
_REP = ", ctr AS (SELECT image_id, label, avg(r) AS mr, avg(c) AS mc, COUNT(*) AS size FROM seg GROUP BY 1, 2), rep AS (SELECT image_id, CAST(label AS INT) AS label, size, r, c, pixel FROM seg JOIN ctr USING (image_id, label) QUALIFY row_number() OVER (PARTITION BY image_id, label ORDER BY (r - mr) * (r - mr) + (c - mc) * (c - mc), r, c) = 1)"


def _superpixels(s, d):
    return io.saved(I.superpixels(_images(s, d), SIDE, SIDE, STEP, rounds=ROUNDS), "superpixels")


query("O-TK14", SEGMENTS + _TOUCH + " SELECT * FROM tch")(lambda s, d: I.region_adjacency(_superpixels(s, d), SIDE, SIDE))
query("O-TK14_regions", SEGMENTS + _REP + " SELECT * FROM rep")(lambda s, d: I.representatives(_superpixels(s, d)))
query("O-TK9", SEGMENTS + _REP + " SELECT image_id, label, concat_ws(' ', -1, pixel, 256 + r, 284 + c, -2) AS tokens FROM rep")(
    lambda s, d: I.representatives(_superpixels(s, d)).select("image_id", "label", F.array_join(I.node_tokens("pixel", "r", "c", (-1, -2)), " ").alias("tokens")))


def _distances(s, d):
    x = _superpixels(s, d)
    end = lambda k: I.representatives(x).select("image_id", F.col("label").alias(k), F.col("r").alias(f"r{k}"), F.col("c").alias(f"c{k}"))
    far = F.floor(F.sqrt((F.col("ra") - F.col("rb")) ** 2 + (F.col("ca") - F.col("cb")) ** 2)).cast("int")
    return I.region_adjacency(x, SIDE, SIDE).join(end("a"), ["image_id", "a"]).join(end("b"), ["image_id", "b"]).withColumn("distance", far).select("image_id", "a", "b", I.edge_token("distance").alias("token"))


query("O-TK9_edges", SEGMENTS + _TOUCH + _REP + " SELECT t.image_id, t.a, t.b, CAST(314 + floor(sqrt((x.r - y.r) * (x.r - y.r) + (x.c - y.c) * (x.c - y.c))) AS INT) AS token FROM tch t JOIN rep x ON x.image_id = t.image_id AND x.label = t.a JOIN rep y ON y.image_id = t.image_id AND y.label = t.b")(_distances)

_GRAY = PIXELS + ", s0 AS (SELECT image_id AS graph_id, list(CAST(pixel // 16 AS INT) ORDER BY i) AS t FROM px GROUP BY 1)"
_gray = lambda s, d: I.scanned(_images(s, d), SIDE, SIDE, "row").select(F.col("image_id").alias("graph_id"), F.transform("tokens", lambda t: F.floor(t / 16).cast("int")).alias("tokens"))


def _trained(s, d):
    """The levels of gray, written once for all passes over them, and four rules."""
    gray = io.saved(_gray(s, d), "gray")
    return gray, bpe.train(gray, merges=4)


def _rules(s, d):
    gray, rules = _trained(s, d)
    io.discard(gray)
    return rules


query("O-BP16", merges(4, _GRAY) + " " + " UNION ALL ".join(f'SELECT {k} AS rank, l AS "left", r AS "right", new_id, cnt FROM r{k}' for k in range(4)))(_rules)
query("O-BP16_encoded", merges(4, _GRAY) + " SELECT graph_id, array_to_string(t, ' ') AS encoded FROM s4")(lambda s, d: bpe.encode(*_trained(s, d)).select("graph_id", F.array_join("encoded", " ").alias("encoded")))
