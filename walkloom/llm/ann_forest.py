"""Approximate nearest neighbours by inner product with a hash-prefix forest.

A symbol of a vector is the place and sign of the largest of WIDE rotated components (a cross-polytope hash,
over vectors brought to one length by an extra component, so that the nearest by angle are those with the
largest inner product). A tree's strings are DEPTH symbols, and no two trees share one, so trees are independent.
Rows are dealt into blocks of about BLOCK; a block holds one sorted array of strings per tree. A query descends
in every tree of a block to its longest-prefix match; then all trees ascend together, a symbol at a time, until
the ranges under their prefixes hold enough entries: SHARE of the block's rows, and LEAST times as many as are
asked for, besides the query's own copies. How long the prefixes are then depends on how close its neighbours
are: a query in a tight cluster stops at long ones. The rows of these ranges, and no others, are measured exactly,
in double precision on the original vectors.

Vectors are measured where they are, so a query is sent to every block, in parts of QUERIES; no task holds more
than a block of rows and a part of queries whatever the table's size. Every row is indexed; nothing is sampled.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part; shorter
vectors count as padded with zeros; a query id with several vectors uses the least of them; rows with the
query's id are never its candidates; other repeated rows are candidates each; ties go to the smaller vec_id;
fewer candidates than are asked for are all returned; other columns are ignored; no valid rows give no result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from walkloom.llm.common import discard, materialize

TREES = 288
DEPTH = 4
WIDE = 16
#: Bits of a symbol.
BITS = 5
BLOCK = 8192
QUERIES = 4096
#: Entries of the trees' ranges in all, as a share of the block's rows, at which the trees stop ascending. Recall for this and other figures is in the README.
SHARE = 0.15
#: Entries at least, as a multiple of the rows asked for.
LEAST = 28
SEED = 11
#: Queries whose candidates are held at a time, and rows that are rotated at a time.
AT_ONCE, ROWS = 256, 512


def valid(rows: DataFrame) -> DataFrame:
    """vec_id, v (array of double) of the rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0)).filter(F.coalesce(good, F.lit(False)))


def matrix(vectors, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def _rotations(dim: int, wide: int, symbols: int) -> np.ndarray:
    """Random rotations side by side, drawn alike in every task: dim x (a multiple of wide), enough for so many symbols. One gives as many as it has room for."""
    rng, each = np.random.default_rng(SEED), dim // wide
    return np.hstack([np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, : each * wide].astype(np.float32) for _ in range(-(-symbols // each))])[:, : symbols * wide]


def strings(m: np.ndarray, extra: np.ndarray, trees: int = TREES, depth: int = DEPTH, wide: int = WIDE) -> np.ndarray:
    """The strings of rows: trees x rows, the first symbol highest. Each symbol of the rotations goes to another tree."""
    x = np.hstack([m, extra[:, None]]).astype(np.float32)
    wide = min(wide, x.shape[1])
    # Columns by symbol, then component, then tree, so that a component of all trees lies together.
    turned = _rotations(x.shape[1], wide, trees * depth).reshape(-1, depth, trees, wide).swapaxes(2, 3).reshape(-1, depth * wide * trees)
    out, code = np.zeros((trees, len(x)), np.uint32), np.arange(0, 2 * wide, 2, dtype=np.uint32)[None, :, None]
    for at in range(0, len(x), ROWS):
        part = out[:, at : at + ROWS]
        for k in range(depth):  # a tree's k-th symbol
            y = (x[at : at + ROWS] @ turned[:, k * trees * wide : (k + 1) * trees * wide]).view(np.uint32).reshape(-1, wide, trees)
            # A positive float's bits rise with it: place and sign take the lowest five, so the largest brings them along.
            best = ((y & np.uint32(0x7FFFFFE0)) | ((y >> np.uint32(31)) ^ np.uint32(1)) | code).max(axis=1)
            part[:] = (part << np.uint32(BITS)) | (best & np.uint32(31)).T
    return out


class Forest:
    """The sorted arrays of one block."""

    def __init__(self, m: np.ndarray, longest: float, depth: int = DEPTH):
        self.m, self.depth = m, depth
        # The extra component brings every row to the length of the longest.
        codes = strings(m, np.sqrt(np.maximum(longest**2 - (m**2).sum(1), 0)), depth=depth)
        self.order = np.argsort(codes, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(codes, self.order, 1)

    def ranges(self, codes: np.ndarray, enough: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """lo and hi of each tree and query where the ascent stops, and the length of the prefixes there: the longest that hold enough in all, or none."""
        n, trees, nq = len(self.m), *codes.shape
        lo, hi, todo = np.zeros((trees, nq), np.int64), np.full((trees, nq), n, np.int64), np.arange(nq)
        length, copies = np.zeros(nq, int), None
        for depth in range(self.depth, 0, -1):
            shift = np.uint32(BITS * (self.depth - depth))
            a, b = np.empty((trees, len(todo)), np.int64), np.empty((trees, len(todo)), np.int64)
            for t in range(trees):
                own, c = self.sorted[t] >> shift, codes[t, todo] >> shift
                a[t], b[t] = np.searchsorted(own, c), np.searchsorted(own, c, side="right")
            # What is in every tree's whole string is the query's own vector again: a copy counts once.
            held = (b - a).sum(0)
            copies = (b - a).min(0) if copies is None else copies
            stop = held - copies * (trees - 1) >= enough
            lo[:, todo[stop]], hi[:, todo[stop]], length[todo[stop]] = a[:, stop], b[:, stop], depth
            todo, copies = todo[~stop], copies[~stop]
            if not len(todo):
                break
        return lo, hi, length

    def candidates(self, codes: np.ndarray, enough: float):
        """Yields for each query, given by its strings (trees x queries), the places of the rows that are measured."""
        n = len(self.m)
        for at in range(0, codes.shape[1], AT_ONCE):
            lo, hi, length = self.ranges(codes[:, at : at + AT_ONCE], enough)
            held = np.zeros((lo.shape[1], n), bool)
            held[length == 0] = True
            some = np.flatnonzero(length)
            for t in range(len(lo)):
                size = hi[t, some] - lo[t, some]
                ends = np.cumsum(size)
                if len(ends) and ends[-1]:
                    places = np.arange(ends[-1]) + np.repeat(lo[t, some] - (ends - size), size)
                    held[np.repeat(some, size), self.order[t][places]] = True
            for v in held:
                yield np.flatnonzero(v)


def search(rows: DataFrame, queries: DataFrame, top: int = 20, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """query_id, rank, vec_id, score, measured: the nearest found of rows (vec_id, embedding) for each of queries (alike).

    measured: the rows that were measured exactly for the query, in the block that vec_id is in.
    """
    # Written, so that a row has the same number each time it is read.
    rows = materialize(valid(rows).withColumn("row", F.monotonically_increasing_id()), "vectors")
    queries = materialize(valid(queries).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    n, dim, longest = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    n_queries, wide_q = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    dim = max(dim or 0, wide_q or 0)
    # A query's strings are made once, for all blocks.
    coded = lambda frames: (q.assign(codes=[c.tobytes() for c in np.ascontiguousarray(strings(matrix(q["v"], dim), np.zeros(len(q))).T)]) for q in frames)
    plain, queries = queries, materialize(queries.mapInPandas(coded, "vec_id long, v array<double>, codes binary"), "coded")
    discard(plain)
    blocks, parts = max(1, math.ceil(n / BLOCK)), max(1, math.ceil(n_queries / QUERIES))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).withColumn("part", every(parts))
    right = queries.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).withColumn("block", every(blocks))

    def find(a: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(q):
            ids = a["vec_id"].to_numpy()
            m, x = matrix(a["v"], dim), matrix(q["v"], dim)
            codes = np.frombuffer(b"".join(q["codes"]), np.uint32).reshape(len(q), -1).T
            for query, v, at in zip(q["vec_id"].to_numpy(), x, Forest(m, longest).candidates(codes, max(share * len(a), least * top))):
                measured, at = len(at), at[ids[at] != query]
                score = m[at] @ v
                if len(at) > top:  # the best, and all that tie with the last of them
                    best = score >= np.partition(score, len(at) - top)[len(at) - top]
                    at, score = at[best], score[best]
                best = np.lexsort((ids[at], -score))[:top]
                out.append((np.full(len(best), query), ids[at][best], score[best], np.full(len(best), measured)))
        names = {"query_id": "int64", "vec_id": "int64", "score": "float64", "measured": "int64"}
        return pd.DataFrame({c: np.concatenate([x[k] for x in out]) if out else np.zeros(0) for k, c in enumerate(names)}).astype(names)

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(find, "query_id long, vec_id long, score double, measured long")
    found = found.withColumn("_first", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return found.filter(F.col("_first") <= top).select("query_id", F.col("_first").alias("rank"), "vec_id", "score", "measured")
