"""Grayscale images: scanning orders, grids, superpixels and their graphs. An image is a row: image_id, pixels (array of int, row by row)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walkloom.operators.tokenize import image_order, let


def scanned(images: DataFrame, h: int, w: int, how: str) -> DataFrame:
    """image_id, tokens: the pixels in a scanning order."""
    return images.select("image_id", let(F.col("pixels"), lambda p: F.transform(image_order(h, w, how), lambda i: F.get(p, i))).alias("tokens"))


def grid(images: DataFrame, h: int, w: int) -> DataFrame:
    """image_id, src, dst, pixel (of src): the four-neighbour grid of each image, both directions."""
    r, c = F.floor(F.col("src") / w), F.col("src") % w
    near = F.array(F.when(c + 1 < w, F.col("src") + 1), F.when(c > 0, F.col("src") - 1), F.when(r + 1 < h, F.col("src") + w), F.when(r > 0, F.col("src") - w))
    return images.select("image_id", F.posexplode("pixels").alias("src", "pixel")).select("image_id", "src", F.explode(F.array_compact(near).cast("array<int>")).alias("dst"), "pixel")


def segments(image: np.ndarray, step: int, compactness: float = 10.0, rounds: int = 3) -> np.ndarray:
    """Labels of an image's pixels: local k-means in value and place from seeds on a grid, then regions made connected.

    A seed stands in each square of step by step, where that has its middle. In each round a pixel goes to the seed of least squared
    difference of values, plus (compactness / step) squared times the squared distance, of those within 2 * step in rows and in
    columns; ties go to the first, and seeds move to the means of their pixels. Of a label's parts (by four neighbours) the largest,
    the first on ties, keeps it; the pixels of the others take, round by round, the least label beside them.
    """
    h, w = image.shape
    rows, cols = np.arange(step // 2, h, step), np.arange(step // 2, w, step)
    seeds = np.array([(image[r, c], r, c) for r in rows for c in cols], float)
    at = np.indices((h, w)).astype(float)
    weight, label = (compactness / step) * (compactness / step), np.zeros((h, w), int)
    for _ in range(rounds):
        dv, dr, dc = (x[None] - seeds[:, k][:, None, None] for k, x in enumerate((image.astype(float), at[0], at[1])))
        far = np.where((np.abs(dr) <= 2 * step) & (np.abs(dc) <= 2 * step), dv * dv + weight * (dr * dr + dc * dc), np.inf)
        label = far.argmin(0)
        n = np.bincount(label.ravel(), minlength=len(seeds))
        some = n > 0
        for k, x in enumerate((image.astype(float), at[0], at[1])):
            seeds[some, k] = np.bincount(label.ravel(), weights=x.ravel(), minlength=len(seeds))[some] / n[some]
    return connected(label)


def parts(label: np.ndarray) -> np.ndarray:
    """The first pixel, by its number, of each pixel's part: four-neighbours of one label, linked."""
    h, w = label.shape
    root = np.arange(h * w).reshape(h, w)
    while True:
        new = root.copy()
        for a, b in ((np.s_[1:, :], np.s_[:-1, :]), (np.s_[:-1, :], np.s_[1:, :]), (np.s_[:, 1:], np.s_[:, :-1]), (np.s_[:, :-1], np.s_[:, 1:])):
            new[a] = np.where(label[a] == label[b], np.minimum(new[a], new[b]), new[a])
        if (new == root).all():
            return root
        root = new


def connected(label: np.ndarray) -> np.ndarray:
    root, out = parts(label), np.full(label.shape, -1)
    found, size = np.unique(root, return_counts=True)
    best: dict[int, tuple[int, int]] = {}
    for r, n in zip(found.tolist(), size.tolist()):
        k = int(label.ravel()[r])
        best[k] = max(best.get(k, (0, 0)), (n, -r))
    keeps = np.isin(root, [-r for _, r in best.values()])
    out[keeps] = label[keeps]
    while (out < 0).any():
        big = np.where(out < 0, label.size, out)
        around = np.full((4, *out.shape), label.size)
        around[0, 1:], around[1, :-1], around[2, :, 1:], around[3, :, :-1] = big[:-1], big[1:], big[:, :-1], big[:, 1:]
        least = around.min(0)
        out = np.where((out < 0) & (least < label.size), least, out)
    return out


def superpixels(images: DataFrame, h: int, w: int, step: int, compactness: float = 10.0, rounds: int = 3) -> DataFrame:
    """image_id, r, c, pixel, label of each pixel."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                labels = [segments(np.asarray(p, np.int64).reshape(h, w), step, compactness, rounds).ravel().tolist() for p in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(labels, pa.list_(pa.int32()))], ["image_id", "pixels", "labels"])

    found = images.select("image_id", "pixels").mapInArrow(run, "image_id long, pixels array<int>, labels array<int>")
    x = found.select("image_id", F.posexplode(F.arrays_zip("pixels", "labels")).alias("i", "x"))
    return x.select("image_id", F.floor(F.col("i") / w).cast("int").alias("r"), (F.col("i") % w).cast("int").alias("c"), F.col("x.pixels").alias("pixel"), F.col("x.labels").alias("label"))


def region_adjacency(labels: DataFrame, h: int, w: int) -> DataFrame:
    """image_id, a, b: labels that touch to the right of or below a pixel, of all pixels but the last row's and column's."""
    near = lambda dr, dc: labels.select("image_id", (F.col("r") - dr).alias("r"), (F.col("c") - dc).alias("c"), F.col("label").alias("other"))
    from_ = labels.filter((F.col("r") < h - 1) & (F.col("c") < w - 1)).select("image_id", "r", "c", "label")
    pairs = from_.join(near(0, 1).union(near(1, 0)), ["image_id", "r", "c"]).filter("label <> other")
    return pairs.select("image_id", F.least("label", "other").alias("a"), F.greatest("label", "other").alias("b")).distinct()


def representatives(labels: DataFrame) -> DataFrame:
    """image_id, label, size, r, c, pixel: of each region, the pixel nearest to its centroid, the first on ties."""
    mean = labels.groupBy("image_id", "label").agg(F.avg("r").alias("_r"), F.avg("c").alias("_c"), F.count("*").alias("size"))
    far = (F.col("r") - F.col("_r")) * (F.col("r") - F.col("_r")) + (F.col("c") - F.col("_c")) * (F.col("c") - F.col("_c"))
    best = labels.join(mean, ["image_id", "label"]).groupBy("image_id", "label").agg(F.first("size").alias("size"), F.min_by(F.struct("r", "c", "pixel"), F.struct(far.alias("d"), "r", "c")).alias("x"))
    return best.select("image_id", "label", "size", "x.*")


def node_tokens(pixel: str, y: str, x: str, ends: tuple[int, int] | None = None):
    """Tokens of a superpixel: its value, row and column, each from a base of its own; ends: a start and an end token around them."""
    inner = [F.col(pixel) + PIXEL, F.col(y) + Y, F.col(x) + X]
    return F.array(*([F.lit(ends[0]), *inner, F.lit(ends[1])] if ends else inner))


def edge_token(distance: str):
    return F.col(distance) + DISTANCE


#: Where the tokens of values, rows, columns and distances begin.
PIXEL, Y, X, DISTANCE = 0, 256, 284, 314
