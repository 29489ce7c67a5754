"""Quality classifier: random Fourier features approximate a Gaussian kernel over document statistics,
ridge regression is fitted from normal equations summed by partition, scores are calibrated by isotonic regression.

Defined results: null or empty text has all statistics 0 and is scored like any other; labels of
documents that don't exist are ignored, of several for one document the largest counts; with no labels, or one kind only, every score is that kind's
rate (0.5 without any); repeated rows each get a row; other columns pass through where docs are kept.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walkloom.llm.common import crc_mod, discard, materialize

FEATURES = 192
GAMMA = 0.15
RIDGE = 1.0
BINS = 1000
SEED = 7
#: "letters" are the counts of the three commonest letters of the corpus' languages: junk has too few of them, or too many.
STATISTICS = ["log_words", "word_len", "symbols", "duplicate_lines", "repeated_windows", "capitals", "digits", "distinct_words", "line_words", "top_word", "letters", "stops"]


def statistics(text: str) -> list[float]:
    """Figures of a whole text; each is bounded or a logarithm."""
    ws = text.split()
    n = len(ws)
    if not n:
        return [0.0] * len(STATISTICS)
    size = len(text)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    counts: dict = {}
    for w in ws:
        counts[w] = counts.get(w, 0) + 1
    windows = n - 2
    distinct = len(set(zip(ws, ws[1:], ws[2:]))) if windows > 0 else 0
    marks = sum(map(text.count, "#*$%&|<>"))
    caps = size - len(text.translate(_NO_CAPS))
    digits = size - len(text.translate(_NO_DIGITS))
    chars = sum(map(len, ws))
    return [
        math.log1p(n), chars / n / 5, min(marks / n, 4.0), 1 - len(set(lines)) / len(lines), 1 - distinct / windows if windows > 0 else 0.0,
        caps / chars, digits / chars, len(counts) / n, math.log1p(n / len(lines)), max(counts.values()) / n,
        (text.count("e") + text.count("a") + text.count("n")) / chars, (text.count(".") + text.count(",")) / n,
    ]


_NO_CAPS = {c: None for c in range(65, 91)}
_NO_DIGITS = {c: None for c in range(48, 58)}


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, x (array of float)."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([statistics(t.as_py() or "") for t in b.column(1)], pa.list_(pa.float32()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, x array<float>")


class Map:
    """Standardised statistics to random Fourier features and a constant; the same for the same seed."""

    def __init__(self, mean, std, features: int = FEATURES, gamma: float = GAMMA, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.std = np.asarray(mean), np.maximum(np.asarray(std), 1e-6)
        self.w = rng.normal(0, math.sqrt(2 * gamma), (len(self.mean), features))
        self.b = rng.uniform(0, 2 * math.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -8, 8)
        return np.hstack([math.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(z), 1))])


def normal_equations(rows: DataFrame, phi: Map) -> tuple[np.ndarray, np.ndarray]:
    """Sums of z z' and z y over rows (x, y): one matrix a partition, then one for each of 16 groups of them."""
    d = len(phi.b) + 1

    def part(batches):
        a, b = np.zeros((d, d)), np.zeros(d)
        for batch in batches:
            if batch.num_rows:
                z = phi(_matrix(batch.column(0)))
                a, b = a + z.T @ z, b + z.T @ np.asarray(batch.column(1), dtype=float)
        yield pa.RecordBatch.from_arrays([pa.array([np.hstack([a.ravel(), b]).tobytes()], pa.binary())], ["m"])

    def add(batches):
        total = sum(np.frombuffer(x.as_py()) for batch in batches for x in batch.column(0))
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    sums = rows.select("x", F.col("y").cast("double")).mapInArrow(part, "m binary").repartition(16).mapInArrow(add, "m binary").collect()
    total = sum((np.frombuffer(r["m"]) for r in sums), np.zeros(d * d + d))
    return total[: d * d].reshape(d, d), total[d * d :]


def _matrix(lists) -> np.ndarray:
    return np.asarray(lists.flatten(), dtype=float).reshape(len(lists), -1)


def isotonic(n: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: for counts n and sums y by bin, the nearest rates that don't fall."""
    blocks: list[list[float]] = []
    for k in range(len(n)):
        blocks.append([n[k], y[k], 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.concatenate([np.full(int(c), s / m if m else 0.0) for m, s, c in blocks]) if blocks else np.zeros(0)


def fit(features: DataFrame, labels: DataFrame):
    """A function from a matrix of statistics to scores in [0, 1]. labels: doc_id, y (0 or 1).

    Calibration is cross-fitted: rates come from scores that the weights of the other half give. The weights of all are the model.
    """
    stats = features.select(*[c for k in range(len(STATISTICS)) for c in (F.avg(F.col("x")[k]).alias(f"m{k}"), F.stddev_pop(F.col("x")[k]).alias(f"s{k}"))]).first()
    mean = [stats[f"m{k}"] or 0.0 for k in range(len(STATISTICS))]
    phi = Map(mean, [stats[f"s{k}"] or 0.0 for k in range(len(STATISTICS))])
    y = labels.filter("y is not null and doc_id is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    half = (F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 5) % 2).cast("int")
    rows = materialize(features.join(y, "doc_id").select("x", "y", half.alias("half")), "labelled")
    parts = [normal_equations(rows.filter(F.col("half") == h), phi) for h in (0, 1)]
    a, b = parts[0][0] + parts[1][0], parts[0][1] + parts[1][1]
    n = a[-1, -1]  # the constant's square, summed
    if n < 1 or b[-1] in (0.0, n):
        rate = 0.5 if n < 1 else b[-1] / n
        return lambda x: np.full(len(x), rate)
    solve = lambda a, b: np.linalg.solve(a + RIDGE * np.eye(len(a)), b)
    weights, cross = solve(a, b), [solve(*parts[1]), solve(*parts[0])]
    raw = lambda x: phi(x) @ weights

    def bins(batches):
        for batch in batches:
            if batch.num_rows:
                z, h = phi(_matrix(batch.column(0))), np.asarray(batch.column(2))
                k = np.clip((np.where(h == 0, z @ cross[0], z @ cross[1]) + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), batch.column(1)], ["k", "y"])

    found = rows.select("x", F.col("y").cast("long"), "half").mapInArrow(bins, "k int, y long").groupBy("k").agg(F.count("*").alias("n"), F.sum("y").alias("y")).orderBy("k").collect()
    at = (np.array([r["k"] for r in found]) + 0.5) / BINS * 2 - 0.5
    rates = isotonic(np.array([r["n"] for r in found], dtype=float), np.array([r["y"] for r in found], dtype=float))
    discard(rows)
    return lambda x: np.clip(np.interp(raw(x), at, rates), 0.0, 1.0)


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document. Labels of the held-out fold are never read by the fit."""
    features = materialize(with_statistics(docs), "statistics")
    known = labels.filter(crc_mod(F.col("doc_id"), folds) != held).select("doc_id", F.col(label).alias("y"))
    model = fit(features, known)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model(np.stack(x.to_numpy()).astype(float)) if len(x) else np.zeros(0))

    out = features.select("doc_id", (crc_mod(F.col("doc_id"), folds) == held).alias("held_out"), score("x").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents predicted to be good, with their own columns. Documents with one id and several texts stay if any is good."""
    good = scored(docs, labels, **how).filter("predicted = 1").select("doc_id").distinct()
    return docs.join(good, docs["doc_id"].eqNullSafe(good["doc_id"]), "left_semi")
