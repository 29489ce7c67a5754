"""Exact n-gram Jaccard join by universe partition and pigeonhole.

A document is the set of its distinct n-word shingles, as 64-bit hashes of their words (two different
shingles of a pair of documents clash with odds below 1e-12). Sets of s and t members whose Jaccard
similarity is at least p % differ in at most H(s + t) members. By size band, hashed members fall into
m segments; r of those are looked up with one-deletion neighbourhoods and so catch a difference of one,
the others catch none; with m + r >= H + 1 + spare, any pair within H agrees in a looked-up segment, even if
up to spare empty segments are left out (empty ones would be the commonest keys; only documents with
more than spare of them emit them). m, r and spare are chosen by cost from the band's document count.

Copies are one node. A key's nodes aren't paired with each other. A sketch of a set is the parities of its
members' counts in buckets; the bits in which two sketches differ are at most the members in which their
sets do. Among a key's nodes, those that share most lead: a leader takes the nodes near it and, of all others,
those that may be similar to one of these by their sketches, so any similar pair meets at a leader (the
centre). Nodes that share but a passage are mostly far from each other and stay single. A key with very many nodes has one centre instead,
the node that shares most. Nodes are compared with their centres by exact difference sets. Pairs of the key's nodes that this leaves
in different components, and near by their sketches, must share members of those differences, rarest first, so they are found by
a prefix join over the differences, and verified on them. A member that very many differences share
is a key of the next round, for ROUNDS rounds; what is left then, and pairs that need share none, meet in blocks
of a bucket. No candidate is dropped.

Defined results: words are runs of non-blank characters, A-Z lower-cased; null text and text without
words have size 0 and no links; with fewer than n words the whole is the one shingle; rows of one doc_id
with different texts are different documents of that id; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from walkloom.llm.common import discard, materialize, pieces

#: A difference member that makes more pairs than this in one centre's group is a key of the next round, for so many rounds.
HOT_PAIRS = 4096
ROUNDS = 8
#: Nodes on each side of a bucket that one task pairs: larger buckets are split into blocks, and pairs of blocks are joined.
SIDE = 256
#: Copies of a text from which its rows are dealt to several tasks.
COPIES = 1000
#: Ids of documents that are broadcast, at most: 16 MB.
BROADCAST_IDS = 2_000_000
#: Nodes that are compared with one copy of their centre.
PER_CENTRE = 64
#: A key with more nodes than this has one centre, so that a task holds few sketches.
LED_NODES = 2048

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Words(dict):
    def __missing__(self, w: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        self[w] = v = xxhash.xxh3_64_intdigest(w)
        return v


_words = _Words()


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's n-word shingles."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.zeros(0, _U)
    h = np.fromiter(map(_words.__getitem__, ws), _U, len(ws))
    width = min(n, len(h))
    out = np.zeros(len(h) - width + 1, _U)
    for k in range(width):
        out = mix(out + h[k : len(h) - width + 1 + k] + _U(0x9E3779B97F4A7C15))
    return np.unique(out if width == n else mix(out + _U(width)))


def most_apart(total: int, p: int) -> int:
    """H: the most members that two sets of so many members in all may differ in."""
    return total - 2 * -(-p * total // (100 + p))


@lru_cache(None)
def band_of(size: int, p: int) -> tuple[int, int, int]:
    """Number, least and largest size of the band; a set's partners are in its own band and those next to it."""
    k, lo = 0, 1
    while (hi := lo * 100 // p) < size:
        k, lo = k + 1, hi + 1
    return k, lo, hi


@lru_cache(None)
def limits(k: int, p: int) -> tuple[int, int, int]:
    """Least and largest size of band k, and H for its pairs with sets up to the next band."""
    lo = 1
    for _ in range(k):
        lo = lo * 100 // p + 1
    hi = lo * 100 // p
    top = hi + hi * 100 // p
    return lo, hi, max(most_apart(s, p) for s in range(max(2 * lo, top - 40), top + 1))


def allocate(k: int, p: int, docs: int) -> tuple[int, int, int]:
    """m, r, spare of band k at least cost: keys a document, and pairs a document by chance, if the band has so many documents."""
    lo, hi, far = limits(k, p)
    if far == 0:
        return 0, 0, 0  # only copies are linked
    best = None
    # Large bands have many empty segments by chance: what may be spared grows with H.
    for spare in sorted({*range(13), *(math.ceil(far * f / 50) for f in range(1, 13))}):
        for r in {0, 1, (far + 1 + spare) // 4, (far + 1 + spare) // 2}:
            m = far + 1 + spare - r
            if m < max(1, r):
                continue
            fill = lo / m
            none = math.exp(-fill)
            over = 1 - sum(math.exp(e * math.log(m * none) - m * none - math.lgamma(e + 1)) for e in range(spare + 1))
            chance = (m - r) * (max(over, 0) * none**2 + 1e-7**fill) + r * none**2 * (1 + 2 * fill)
            cost = m + r * fill + docs * chance
            if best is None or cost < best[0]:
                best = (cost, m, r, spare)
    return best[1:]


def keys(h: np.ndarray, k: int, plan: tuple[int, int, int]) -> tuple[np.ndarray, int]:
    """The keys of a set in band k, and how many of them it shares with any similar set, at least."""
    m, r, spare = plan
    if m == 0:
        return np.zeros(0, _U), 1
    token = mix(h ^ _U(0x5851F42D4C957F2D))
    segment = ((token >> _U(33)) % _U(m)).astype(np.int64)
    sums, count = np.zeros(m, _U), np.bincount(segment, minlength=m)
    np.add.at(sums, segment, token)
    name = mix(np.arange(m, dtype=_U) + _U(k << 32))
    out = mix(sums + name)
    empty = count == 0
    if empty.sum() <= spare:
        out = out[~empty | (np.arange(m) < r)]
    # A similar pair agrees in spare + 1 segments at least if none has deletions, and in fewer looked-up ones by those that are empty.
    need = 1 if r else max(1, spare + 1 - int(empty.sum()))
    if r:
        at = np.flatnonzero(segment < r)
        out = np.concatenate([out, mix(sums[segment[at]] - token[at] + name[segment[at]])])
    return np.unique(out), need


def sketch(h: np.ndarray) -> bytes:
    """The parities of the members' counts in buckets, a power of two of them, at least one a member."""
    buckets = max(64, 1 << (len(h) - 1).bit_length())
    at = (mix(h ^ _U(0x9FB21C651E98DF25)) & _U(buckets - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=buckets) & 1).astype(np.uint8)).tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of words, with the buckets of the smallest."""
    width = min(map(len, sketches))
    out = np.empty((len(sketches), width // 8), _U)
    for i, x in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(x, _U).reshape(-1, width // 8), axis=0)
    return out


@lru_cache(100_000)
def reach(size: int, p: int) -> int:
    """The most members in which a set of this size differs from any similar one."""
    return most_apart(size + size * 100 // p, p) + 1


def near(sizes: np.ndarray, x: np.ndarray, p: int) -> np.ndarray:
    """Which pairs of nodes may be similar by their sketches."""
    out = np.empty((len(sizes), len(sizes)), bool)
    for i in range(len(sizes)):
        total = sizes + sizes[i]
        out[i] = np.bitwise_count(x ^ x[i]).sum(axis=1, dtype=np.int64) <= total - 2 * -(-p * total // (100 + p))
    np.fill_diagonal(out, False)
    return out


def led(sizes: list[int], sketches: list[bytes], p: int) -> list[tuple[int, int]]:
    """(leader, node) among a key's nodes, the likeliest leaders first: any pair that may be similar is at one leader, itself counted."""
    x = folded(sketches)
    if len(sizes) == 2:
        apart = int(np.bitwise_count(x[0] ^ x[1]).sum())
        return [(0, 1)] if apart <= most_apart(sum(sizes), p) else []
    may = near(np.array(sizes), x, p)
    left, out = may.any(axis=1), []
    while left.any():
        c = int(left.argmax())
        own = left & (np.bitwise_count(x ^ x[c]).sum(axis=1, dtype=np.int64) <= reach(sizes[c], p))
        own[c] = True
        left &= ~own
        out += [(c, int(y)) for y in np.flatnonzero(own | may[own].any(axis=0)) if y != c]
    return out


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, row_key, n_shingles, node (a digest of the set), sketch. row_key: null where docs has none."""
    key = F.col("row_key") if "row_key" in docs.columns else F.lit(None).cast("long").alias("row_key")

    def run(batches):
        for b in pieces(batches):
            hs = [shingles(t.as_py(), n) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(2), pa.array([len(h) for h in hs], pa.int64()), pa.array([_node(h) if len(h) else None for h in hs], pa.binary()),
                pa.array([sketch(h) if len(h) else None for h in hs], pa.binary())], ["doc_id", "row_key", "n_shingles", "node", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text", key).mapInArrow(run, "doc_id long, row_key long, n_shingles long, node binary, sketch binary")


def _node(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def _keys(docs: DataFrame, n: int, p: int, plans: dict) -> DataFrame:
    """node, key, need of every key of a set in its band and in the one below (there need, the shared keys needed, is negative)."""

    def run(batches):
        seen: set = set()  # a task emits the keys of copies once
        for b in pieces(batches, 100):
            nodes, found, needs = [], [], []
            for t in b.column(0):
                h = shingles(t.as_py(), n)
                if not len(h) or (node := _node(h)) in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(node)
                k = band_of(len(h), p)[0]
                for j in (k, k - 1):
                    if j >= 0:
                        own, need = keys(h, j, plans.get(j) or allocate(j, p, 1))
                        nodes += [node] * len(own)
                        found.append(own.view(np.int64))
                        needs.append(np.full(len(own), need if j == k else -need, np.int32))
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(np.concatenate(found)), pa.array(np.concatenate(needs))], ["node", "key", "need"])

    return docs.select("text").mapInArrow(run, "node binary, key long, need int")


def _groups(batches):
    """Lists of the rows with one value in the first column, of sorted rows."""
    rows: list = []
    for b in pieces(batches):
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if rows and r[0] != rows[0][0]:
                yield rows
                rows = []
            rows.append(r)
    if rows:
        yield rows


def _once(pairs):
    """Batches of (centre, node); a task sends a pair once, as far as it remembers."""
    sent, out = set(), []
    batch = lambda: pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], ["centre", "node"])
    for pair in pairs:
        if pair in sent:
            continue
        if len(sent) > 200_000:
            sent.clear()
        sent.add(pair)
        out.append(pair)
        if len(out) == 5000:
            yield batch()
            out = []
    yield batch()


def _pairs(shared: DataFrame, sketches: DataFrame, p: int) -> DataFrame:
    """(centre, node) of (key, node)."""

    def run(batches):
        groups = (sorted(g, key=lambda r: (-r[4], r[1])) for g in _groups(batches) if len(g) > 1)
        yield from _once((g[c][1], g[y][1]) for g in groups for c, y in led([r[2] for r in g], [r[3] for r in g], p))

    counts = materialize(shared.groupBy("key").agg(F.count("*").alias("n")), "counts")
    few = shared.join(counts.filter(F.col("n").between(2, LED_NODES)), "key").withColumn("pop", F.sum("n").over(W.partitionBy("node")))
    few = few.join(sketches, "node").select("key", "node", "size", "sketch", "pop").repartition("key").sortWithinPartitions("key", "node")
    many = materialize(shared.join(counts.filter(F.col("n") > LED_NODES), "key"), "many")
    pop = many.groupBy("node").agg(F.sum("n").alias("pop"))
    centre = many.join(pop, "node").groupBy("key").agg(F.max(F.struct("pop", "node")).alias("x")).select("key", F.col("x.node").alias("centre"))
    one = many.join(centre, "key").filter("node <> centre").select("centre", "node")
    return few.mapInArrow(run, "centre binary, node binary").union(one).distinct()


def _hashes(docs: DataFrame, n: int) -> DataFrame:
    """node, size, h of documents."""

    def run(batches):
        for b in pieces(batches):
            hs = [shingles(t.as_py(), n) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([
                pa.array([hashlib.blake2b(h.tobytes(), digest_size=16).digest() for h in hs], pa.binary()), pa.array([len(h) for h in hs], pa.int64()),
                pa.array([h.view(np.int64) for h in hs], pa.list_(pa.int64()))], ["node", "size", "h"])

    return docs.select("text").mapInArrow(run, "node binary, size long, h array<long>")


def _near_others(members: DataFrame, sketches: DataFrame, p: int) -> DataFrame:
    """members (centre, node, own) that are near, by sketches, to one of their centre with another label; all of them where a centre has very many."""

    def run(batches):
        for g in _groups(batches):
            own = np.unique([r[2] for r in g], return_inverse=True)[1]
            may = near(np.array([r[3] for r in g]), folded([r[4] for r in g]), p) & (own[:, None] != own)
            yield from _once((g[i][0], g[i][1]) for i in np.flatnonzero(may.any(axis=1)))

    large = materialize(members.groupBy("centre").agg(F.count("*").alias("n")).filter(F.col("n") > LED_NODES).select("centre"), "large-centres")
    few = members.join(large, "centre", "left_anti").select("centre", "node", "own").join(sketches, "node")
    few = few.select("centre", "node", "own", "size", "sketch").repartition("centre").sortWithinPartitions("centre", "node")
    many = members.join(large, "centre", "left_semi").select("centre", "node")
    kept = materialize(few.mapInArrow(run, "centre binary, node binary").union(many), "near")
    return members.join(kept, ["centre", "node"], "left_semi")


def _differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """centre, node, centre_size, size, diff, n_diff of pairs (centre, node). diff: what only the node has, then what only the centre has."""
    counts = pairs.groupBy("centre").agg(F.ceil(F.count("*") / PER_CENTRE).cast("int").alias("salts"))
    counts = materialize(counts, "centres")
    wide = materialize(counts.filter("salts > 1"), "wide-centres")  # few; their size is known, so Spark broadcasts them where they are small
    centres = counts.join(sets, counts["centre"] == sets["node"]).select("centre", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("is_node"), "node", "size", "h")
    salt = F.pmod(F.xxhash64("node"), F.coalesce("salts", F.lit(1)).cast("long")).cast("int")
    nodes = pairs.join(wide, "centre", "left").join(sets, "node").select("centre", salt.alias("salt"), F.lit(1).alias("is_node"), "node", "size", "h")

    def run(batches):
        centre = h0 = size0 = None
        for b in pieces(batches):
            rows: dict = {"centre": [], "node": [], "centre_size": [], "size": [], "diff": []}
            hs = b.column(5)
            for i, (c, is_node, node, size) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist())):
                h = np.asarray(hs[i].values, dtype=np.int64)
                if not is_node:
                    centre, h0, size0 = c, h, size
                    continue
                assert c == centre
                diff = np.concatenate([np.setdiff1d(h, h0, assume_unique=True), np.setdiff1d(h0, h, assume_unique=True)])
                for name, v in zip(rows, (c, node, size0, size, diff)):
                    rows[name].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows["centre"], pa.binary()), pa.array(rows["node"], pa.binary()), pa.array(rows["centre_size"], pa.int64()), pa.array(rows["size"], pa.int64()), pa.array(rows["diff"], pa.list_(pa.int64()))], list(rows))

    # A centre's copy comes first in its group; groups are small, so tasks are even.
    both = centres.unionByName(nodes).repartition("centre", "salt").sortWithinPartitions("centre", "salt", "is_node")
    return both.mapInArrow(run, "centre binary, node binary, centre_size long, size long, diff array<long>").withColumn("n_diff", F.size("diff"))


def _links(total, apart, p: int):
    """Whether sets of so many members in all that differ in so many are similar."""
    shared = (total - apart) / 2
    return F.lit(100) * shared >= F.lit(p) * (total - shared)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """u, v: each node that isn't the least of its component, and that least, of undirected links; by alternating large and small stars.

    Minima are summed before they are shuffled, and joined back, so a node with very many links is split.
    """
    edges = materialize(links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct(), "edges")
    seen = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
        down = materialize(down, "large")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select("v", "m").union(least.select("u", "m"))
        small = materialize(small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).filter("u <> v").distinct(), "small")
        now = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        edges, last = small, edges
        discard(down, last)
        if now == seen:
            return edges
        seen = now


def _labelled(df: DataFrame, labels: DataFrame, col: str, to: str) -> DataFrame:
    """df with the label of the node in col, itself where it has no links."""
    x = labels.select(F.col("u").alias(col), F.col("v").alias("_label"))
    return df.join(x, col, "left").withColumn(to, F.coalesce("_label", col)).drop("_label")


def _round(pairs: DataFrame, sets: DataFrame, sketches: DataFrame, links: DataFrame | None, p: int, last: bool) -> tuple[DataFrame, DataFrame]:
    """One round over pairs (centre, node): all links so far, and the (key, node) of the next round."""
    diffs = materialize(_differences(pairs, sets), "differences")
    found = diffs.filter(_links(F.col("size") + F.col("centre_size"), F.col("n_diff"), p)).select(F.col("centre").alias("a"), F.col("node").alias("b"))
    links = found if links is None else links.union(found)
    labels = components(links)
    members = _labelled(_labelled(diffs, labels, "node", "own"), labels, "centre", "main")
    apart = materialize(members.groupBy("centre").agg(F.max(F.col("own") != F.col("main")).alias("some")).filter("some").select("centre"), "apart")
    members = materialize(_near_others(members.join(apart, "centre", "left_semi"), sketches, p), "members")

    # x and y: a pair's nearer and farther node from their centre; at least one isn't linked to it, so y is at least "far" from it.
    # The first member that both differences hold, in their order, lies within these prefixes; a null token stands for pairs that need share none.
    ratio = (100 - p, 100 + p)
    most = F.floor((F.col("size") + F.floor(F.col("size") * 100 / p)) * ratio[0] / ratio[1])
    far = F.floor((F.ceil(F.col("size") * p / 100) + F.col("centre_size")) * ratio[0] / ratio[1])
    need = F.ceil((F.col("d") + F.greatest(F.col("d"), far) - most) / 2)
    x_len = F.greatest(F.col("d") - F.greatest(need, F.lit(1)) + 1, F.lit(0))
    y_len = F.when(F.col("d") >= far, F.least(F.col("d"), most + 1)).otherwise(0)
    rows = members.withColumn("d", F.col("n_diff").cast("long"))

    def side(at, length, free):
        tokens = F.concat(F.slice("diff", F.lit(1), length.cast("int")), F.when(free, F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<long>")))
        return rows.select("centre", "node", "own", "size", "d", F.lit(at).alias("at"), F.posexplode(tokens).alias("i", "token"))

    both = prefixes = materialize(side(0, x_len, need <= 0).union(side(1, y_len, (F.col("d") >= far) & (F.col("d") <= most))), "prefixes")
    count = both.groupBy("centre", "token").agg(F.sum(1 - F.col("at")).alias("nx"), F.sum("at").alias("ny"), F.min("own").alias("lo"), F.max("own").alias("hi")).filter("nx > 0 and ny > 0 and lo <> hi")
    hot = F.lit(False) if last else (F.col("nx") * F.col("ny") > HOT_PAIRS) & (F.col("token") != 0)
    split = lambda n: F.ceil(F.col(n) / SIDE).cast("int").alias(n)
    count = materialize(count.select("centre", "token", hot.alias("hot"), split("nx"), split("ny")), "buckets")
    both = both.join(count, ["centre", "token"])
    again = both.filter("hot").select(F.xxhash64("centre", "token").alias("key"), "node").distinct()

    def blocks(at, own, other, t):
        """A side of the buckets that aren't hot; a row is in its own block, and meets each block of the other side."""
        block = F.pmod(F.xxhash64("node"), F.col(own).cast("long")).cast("int").alias("b" + own)
        cols = ["centre", "token", *[F.col(c).alias(c + t) for c in ("node", "own", "size", "d", "i")], block]
        return both.filter(~F.col("hot") & (F.col("at") == at)).select(*cols, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("b" + other))

    x, y = blocks(0, "nx", "ny", "_x"), blocks(1, "ny", "nx", "_y")
    total = F.col("size_x") + F.col("size_y")
    need_both = F.ceil((F.col("d_x") + F.col("d_y") - (total - 2 * F.ceil(total * p / ratio[1]))) / 2)
    order = (F.col("d_x") < F.col("d_y")) | ((F.col("d_x") == F.col("d_y")) & (F.col("node_x") < F.col("node_y")))
    fit = (F.col("size_x") * 100 >= F.col("size_y") * p) & (F.col("size_y") * 100 >= F.col("size_x") * p)
    room = F.least(F.col("d_x") - F.col("i_x"), F.col("d_y") - F.col("i_y")) >= need_both
    maybe = x.join(y, ["centre", "token", "bnx", "bny"]).filter((F.col("own_x") != F.col("own_y")) & order & fit & room).select("centre", "node_x", "node_y").distinct()
    of = lambda t: members.select("centre", F.col("node").alias("node" + t), F.col("size").alias("size" + t), F.col("diff").alias("diff" + t))
    maybe = maybe.join(of("_x"), ["centre", "node_x"]).join(of("_y"), ["centre", "node_y"])
    apart = F.size("diff_x") + F.size("diff_y") - 2 * F.size(F.array_intersect("diff_x", "diff_y"))
    more = materialize(maybe.filter(_links(total, apart, p)).select(F.col("node_x").alias("a"), F.col("node_y").alias("b")), "links")
    links = materialize(links.union(more).distinct(), "all-links")
    again = materialize(again, "again")
    discard(diffs, members, prefixes, count, more)
    return links, again


def linked(docs: DataFrame, n: int = 5, p: int = 80) -> DataFrame:
    """doc_id, n_shingles, node, component_id of every row of docs (doc_id, text): n-word shingles, p % similarity.

    component_id: the least doc_id that links lead to, null if there is none. node: a digest of the set, null where that is empty.
    """
    return _linked(docs, n, p).select("doc_id", "n_shingles", "node", "component_id")


def _linked(docs: DataFrame, n: int, p: int) -> DataFrame:
    """As linked, with row_key (of docs, if it has one) and label: the component itself, as components may share their least doc_id."""
    base = materialize(_sets(docs, n), "sets")
    # Set sizes, an eighth of e apart: they weigh the costs of keys, and no result depends on them.
    sizes = base.filter("n_shingles > 0").groupBy(F.floor(F.log1p(F.col("n_shingles").cast("double")) * 8).alias("k")).count().collect()
    plans: dict = {}
    for r in sizes:
        for k in range(band_of(max(1, int(math.exp(r["k"] / 8)) - 1), p)[0], band_of(int(math.exp((r["k"] + 1) / 8)) + 1, p)[0] + 1):
            plans[k] = max(plans.get(k, 1), r["count"])
    plans = {k: allocate(k, p, c) for k, c in plans.items()}
    # Copies in other tasks meet here, under each of their keys. Keys with the same nodes become one, named by a sum over those;
    # should two such names clash, their nodes are compared together.
    rows = _keys(docs, n, p, plans).repartition("key").dropDuplicates(["key", "node"])
    by_key = W.partitionBy("key")
    named = rows.withColumn("n", F.count("*").over(by_key)).withColumn("name", F.sum(F.shiftright(F.xxhash64("node", F.col("need") < 0), 20)).over(by_key)).filter("n > 1")
    shared = found = materialize(named.groupBy(F.xxhash64("name", "n").alias("key"), "node", "need").agg(F.count("*").alias("n")), "found")
    # Too few shared keys in a band: no similar set there.
    shared = shared.withColumn("n", F.sum("n").over(W.partitionBy("node", F.col("need") < 0))).filter(F.col("n") >= F.abs("need"))
    shared = materialize(shared.select("key", "node").distinct(), "shared")
    discard(found)
    # Copies go before the join, so that none of them is a key of many rows there.
    some = base.select("node", F.col("n_shingles").alias("size"), "sketch").dropDuplicates(["node"]).join(shared.select("node").distinct(), "node", "left_semi")
    sketches = materialize(some, "sketches")
    pairs = materialize(_pairs(shared, sketches, p), "pairs")
    wanted = base.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"))
    asked = wanted.join(pairs.select("node").union(pairs.select("centre")).distinct(), "node", "left_semi")
    asked = materialize(asked, "wanted")
    need = asked.filter("rep is not null").select(F.col("rep").alias("doc_id")).distinct()
    # A doc_id may have several texts; sets that aren't asked for drop out where pairs are joined.
    # Their ids are broadcast if they are few; else texts are shuffled.
    ids = F.broadcast(need) if need.count() <= BROADCAST_IDS else need
    sets = _hashes(docs.join(ids, "doc_id", "left_semi"), n)
    # Sets that only rows without an id have are found by their digests.
    unnamed = asked.filter("rep is null").select("node")
    if not unnamed.isEmpty():
        sets = sets.union(_hashes(docs.filter("doc_id is null"), n).join(unnamed, "node", "left_semi").select(*sets.columns))
    sets = materialize(sets.dropDuplicates(["node"]), "hashes")
    links, k = None, 0
    while k == 0 or not shared.isEmpty():
        k += 1
        before = shared, pairs, links
        links, shared = _round(pairs, sets, sketches, links, p, k >= ROUNDS)
        pairs = None if shared.isEmpty() else materialize(_pairs(shared, sketches, p), "pairs")
        discard(*[x for x in before if x is not None])
    labels = components(links)
    reps = _labelled(wanted.filter("node is not null"), labels, "node", "label")
    reps = materialize(reps, "reps")
    # Components of one node are their own; the others are few, and Spark broadcasts them where they are small.
    least = reps.groupBy("label").agg(F.min("rep").alias("component_id"), F.count("*").alias("n")).filter("n > 1").select("label", "component_id")
    least = materialize(least, "least")
    found = reps.join(least, "label", "left").select("node", "label", F.coalesce("component_id", "rep").alias("component_id"), F.when(F.col("rows") > COPIES, F.ceil(F.col("rows") / COPIES)).otherwise(1).cast("long").alias("salts"))
    found = materialize(found, "components")
    wide = materialize(found.filter("salts > 1").select("node", "salts"), "wide-nodes")
    discard(sketches, asked, sets, links, labels, reps, least)
    # A text with very many rows is dealt to several tasks. Such texts are few, and Spark broadcasts them where they are small.
    base = base.drop("sketch").join(wide, "node", "left")
    salt = F.pmod(F.xxhash64("doc_id", "row_key"), F.when(F.col("node").isNull(), COPIES).otherwise(F.coalesce("salts", F.lit(1))).cast("long"))
    found = found.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    out = base.withColumn("salt", salt).join(found, ["node", "salt"], "left")
    return out.select("doc_id", "row_key", "n_shingles", "node", "label", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, p: int = 80) -> DataFrame:
    """One row of each component, that with the least doc_id, with the columns of docs; of rows with that doc_id, one.

    Rows without a doc_id stay only where their component has no row with one. Documents without words are in no group and all stay.
    """
    # A written table, so that a row has the same key each time it is read.
    rows = materialize(docs.withColumn("row_key", F.monotonically_increasing_id()), "keyed")
    found = materialize(_linked(rows, n, p).filter("node is not null").select("doc_id", "row_key", "label"), "rows")
    first = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("x")).select("x.row_key")
    gone = materialize(found.select("row_key").join(first, "row_key", "left_anti"), "gone")
    discard(found)
    # As above: keys are broadcast if they are few; else texts are shuffled.
    keys = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return rows.join(keys, "row_key", "left_anti").drop("row_key").select(docs.columns)
