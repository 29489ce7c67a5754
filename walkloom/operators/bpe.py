"""Byte-pair encoding of integer sequences: training, encoding, decoding.

The most frequent adjacent pair is merged, ties to the smaller (left, right); overlapping occurrences
count; merges don't overlap and go from left to right; new ids start at the largest base id plus two.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from walkloom.sources.io import Layers, discard, exists, opened, saved, scratch

RULES = "rank int, left int, right int, new_id int, cnt long"
#: Tokens of distinct sequences that one machine trains on, at most (some 40 bytes each); beyond, tables are passed over. Both give the same rules.
LOCAL_TOKENS = 8_000_000
#: The commonest pairs that a pass looks at for merges that don't touch each other.
CANDIDATES = 256
#: Merges of more tokens than LOCAL_TOKENS that are each counted in a pass over all sequences, at most; more are trained on pieces.
FEW_MERGES = 8
#: Tokens that are encoded at once.
CHUNK_TOKENS = 2_000_000


def distinct(x: np.ndarray) -> np.ndarray:
    """The values of a short array, in order."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class Corpus:
    """Sequences end to end as arrays, with links over what is merged away. A place's pair is its token and the next of its sequence."""

    def __init__(self, tokens: np.ndarray, ends: np.ndarray):
        """ends: where each sequence ends."""
        n = len(tokens)
        self.tok = tokens.astype(np.int64)
        self.after, self.before = np.arange(1, n + 1), np.arange(-1, n - 1)
        starts, full = np.concatenate([[0], ends[:-1]]), ends > np.concatenate([[0], ends[:-1]])
        self.after[ends[full] - 1], self.before[starts[full]] = -1, -1
        self.live = np.ones(n, bool)

    def pairs(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of places that begin a pair, and the pairs, as one number each."""
        places = places[places >= 0]
        places = places[self.live[places] & (self.after[places] >= 0)]
        return places, (self.tok[places] << 32) | self.tok[self.after[places]]

    def hits(self, places: np.ndarray, left: int, right: int) -> np.ndarray:
        """Those of places where the pair stands, from the left, without overlaps."""
        places, code = self.pairs(places)
        places = distinct(places[code == ((left << 32) | right)])
        if left == right and len(places) > 1:
            # In a run of one token every other place is taken.
            first = np.concatenate([[True], self.after[places[:-1]] != places[1:]])
            run = np.flatnonzero(first)[np.cumsum(first) - 1]
            places = places[(np.arange(len(places)) - run) % 2 == 0]
        return places

    def lost(self, places: np.ndarray) -> np.ndarray:
        """Before a merge at places: where the pairs are that it takes away."""
        around = np.concatenate([places, self.before[places], self.after[places]])
        return distinct(around[around >= 0])

    def made(self, places: np.ndarray) -> np.ndarray:
        """After a merge at places: where the pairs are that it made."""
        around = np.concatenate([places, self.before[places]])
        return distinct(around[around >= 0])

    def merge(self, places: np.ndarray, new_id: int) -> None:
        gone = self.after[places]
        then = self.after[gone]
        self.tok[places], self.live[gone] = new_id, False
        self.after[places] = then
        # Neighbours that were merged away in this step hand over to those that took them in.
        self.before[then[then >= 0]] = places[then >= 0]

    def rest(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.live)
        return at, self.tok[at]


def pair_counts(sequences: DataFrame, weight: Column | None = None) -> DataFrame:
    """left, right, cnt of adjacent pairs within sequences (tokens)."""
    n = F.size("tokens")
    pairs = F.arrays_zip(F.slice("tokens", F.lit(1), F.greatest(n - 1, F.lit(0))).alias("l"), F.slice("tokens", F.lit(2), F.greatest(n - 1, F.lit(0))).alias("r"))
    x = sequences.select(F.explode(pairs).alias("p"), (F.lit(1) if weight is None else weight).cast("long").alias("w"))
    return x.groupBy(F.col("p.l").alias("left"), F.col("p.r").alias("right")).agg(F.sum("w").alias("cnt"))


def best_pair(counts: DataFrame, min_frequency: int = 2) -> DataFrame:
    return counts.filter(F.col("cnt") >= min_frequency).orderBy(F.col("cnt").desc(), "left", "right").limit(1)


def merged(tokens: str, left: int, right: int, new_id: int) -> Column:
    """The array with each occurrence of the pair replaced, in one pass from the left. The sum is (done, whether the last is an open left)."""
    zero = F.struct(F.array().cast("array<int>").alias("out"), F.lit(False).alias("open"))
    step = lambda a, t: F.when(a["open"] & (t == right), F.struct(F.concat(a["out"], F.array(F.lit(new_id))).alias("out"), F.lit(False).alias("open"))).otherwise(
        F.struct(F.concat(a["out"], F.when(a["open"], F.array(F.lit(left))).otherwise(F.array().cast("array<int>")), F.when(t == left, F.array().cast("array<int>")).otherwise(F.array(t))).alias("out"), (t == left).alias("open")))
    return F.aggregate(tokens, zero, step, lambda a: F.when(a["open"], F.concat(a["out"], F.array(F.lit(left)))).otherwise(a["out"]))


def merge_list(tokens: list[int], left: int, right: int, new_id: int) -> list[int]:
    out, k, n = [], 0, len(tokens)
    while k < n:
        if k + 1 < n and tokens[k] == left and tokens[k + 1] == right:
            out.append(new_id)
            k += 2
        else:
            out.append(tokens[k])
            k += 1
    return out


def train_arrays(tokens: np.ndarray, ends: np.ndarray, times: np.ndarray, merges: int, min_frequency: int = 2, first_id: int | None = None) -> list[tuple[int, int, int, int]]:
    """(left, right, new_id, cnt) by rank, of sequences with multiplicities.

    Pair counts are kept up to date at the places that a merge touches, and a heap gives the next pair; entries whose
    count has changed since are passed over.
    """
    c = Corpus(tokens, ends)
    weight = np.repeat(times, np.diff(np.concatenate([[0], ends])))
    places, code = c.pairs(np.arange(len(tokens)))
    order = np.argsort(code, kind="stable")
    found, start = np.unique(code[order], return_index=True)
    where = dict(zip(found.tolist(), ([x] for x in np.split(places[order], start[1:]))))
    counts = dict(zip(found.tolist(), np.add.reduceat(weight[places[order]], start).tolist() if len(found) else ()))
    heap = [(-n, k) for k, n in counts.items()]
    heapq.heapify(heap)
    new_id = (int(tokens.max()) + 2 if len(tokens) else 1) if first_id is None else first_id
    rules: list[tuple[int, int, int, int]] = []

    def shift(at: np.ndarray, sign: int) -> set[int]:
        at, code = c.pairs(at)
        if not len(at):
            return set()
        order = np.argsort(code, kind="stable")
        at, code = at[order], code[order]
        found, start = np.unique(code, return_index=True)
        sums = np.add.reduceat(weight[at], start)
        for k, n, own in zip(found.tolist(), sums.tolist(), np.split(at, start[1:])):
            counts[k] = counts.get(k, 0) + sign * n
            if sign > 0:
                where.setdefault(k, []).append(own)
        return set(found.tolist())

    while heap and len(rules) < merges:
        n, k = heapq.heappop(heap)
        if counts.get(k, 0) != -n:
            continue
        if -n < min_frequency or n == 0:
            break
        left, right = k >> 32, k & 0xFFFFFFFF
        at = c.hits(np.concatenate(where.pop(k)), left, right)
        changed = shift(c.lost(at), -1)
        c.merge(at, new_id)
        changed |= shift(c.made(at), 1)
        rules.append((left, right, new_id, -n))
        new_id += 1
        for x in changed:
            if counts[x] > 0:
                heapq.heappush(heap, (-counts[x], x))
            else:
                counts.pop(x)
                where.pop(x, None)
    return rules


def train_local(sequences: list[tuple[list[int], int]], merges: int, min_frequency: int = 2) -> list[tuple[int, int, int, int]]:
    """As train_arrays, from (tokens, multiplicity)."""
    tokens = np.array([t for s, _ in sequences for t in s], np.int64)
    return train_arrays(tokens, np.cumsum([len(s) for s, _ in sequences]).astype(np.int64), np.array([n for _, n in sequences], np.int64), merges, min_frequency)


def independent(counts: list[tuple[int, int, int]], min_frequency: int) -> list[tuple[int, int, int]]:
    """Of pairs (left, right, cnt), commonest first, the first ones that are sure to be the next merges, one after another.

    A merge changes only counts of pairs that share a token with it, and makes pairs no commoner than those; so the
    next in order follows it if they share none, and if no pair as common as that next one shares a token with what is merged.
    """
    out, used = [], set()
    for k, (left, right, n) in enumerate(counts):
        same = (x for x in counts[k + 1 :] if x[2] == n)
        if n < min_frequency or used & {left, right} or (used and any(used & {a, b} for a, b, _ in same)) or (k and k == len(counts) - 1):
            break
        out.append((left, right, n))
        used |= {left, right}
        if left == right:
            break
    return out


#: What a pass over the sequences that hold a pair gives: the changed sequences, changes of counts, and places of new pairs.
STEP = "kind int, id long, n long, tokens array<int>, left int, right int, cnt long"
SEQUENCE, COUNT, PLACE = range(3)
_OF = {SEQUENCE: ("id", "n", "tokens"), COUNT: ("left", "right", "cnt"), PLACE: ("left", "right", "id")}
_TYPE = {"id": "long", "n": "long", "tokens": "array<int>", "left": "int", "right": "int", "cnt": "long"}


def _sums(code: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(code, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, at, weight)
    return found[total != 0], total[total != 0]


def merge_batch(ids: np.ndarray, times: np.ndarray, tokens: np.ndarray, ends: np.ndarray, rules: list[tuple[int, int, int]]):
    """Sequences after merges (left, right, new_id), one after another: which changed, their tokens and ends, changes of pair counts, and new pairs by sequence.

    Counts and places are kept up to date around the merged places only.
    """
    c = Corpus(tokens, ends)
    owner = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
    changed, codes, weights, places = np.zeros(len(ends), bool), [], [], []
    for left, right, new_id in rules:
        at = c.hits(np.flatnonzero(c.live & (c.tok == left)), left, right)
        if not len(at):
            continue
        changed[owner[at]] = True
        lost, code = c.pairs(c.lost(at))
        codes.append(code)
        weights.append(-times[owner[lost]])
        c.merge(at, new_id)
        made, code = c.pairs(c.made(at))
        codes.append(code)
        weights.append(times[owner[made]])
        places.append(np.unique(np.stack([code, ids[owner[made]]]), axis=1))
    at, tok = c.rest()
    stops = np.searchsorted(at, ends)
    begins = np.concatenate([[0], stops[:-1]])
    kept = np.flatnonzero(changed)
    empty = np.zeros(0, np.int64)
    cut = np.concatenate([tok[begins[k] : stops[k]] for k in kept.tolist()] or [empty])
    return kept, cut, np.cumsum(stops[kept] - begins[kept]), _sums(np.concatenate(codes or [empty]), np.concatenate(weights or [empty])), np.concatenate(places or [np.zeros((2, 0), np.int64)], axis=1)


def _pass(rows: DataFrame, rules: list[tuple[int, int, int]]) -> DataFrame:
    """STEP of sequences (id, n, tokens)."""

    def batch(kind, size, **columns):
        arrays = [pa.array(np.full(size, kind, np.int32))]
        for name, type_ in (("id", pa.int64()), ("n", pa.int64()), ("tokens", pa.list_(pa.int32())), ("left", pa.int32()), ("right", pa.int32()), ("cnt", pa.int64())):
            x = columns.get(name)
            arrays.append(pa.nulls(size, type_) if x is None else x if isinstance(x, pa.Array) else pa.array(x).cast(type_))
        return pa.RecordBatch.from_arrays(arrays, ["kind", "id", "n", "tokens", "left", "right", "cnt"])

    def run(batches):
        for b in batches:
            ids, times = (np.asarray(b.column(k), dtype=np.int64) for k in (0, 1))
            kept, tokens, ends, (code, delta), (pair, own) = merge_batch(ids, times, *_flat(b.column(2)), rules)
            yield batch(SEQUENCE, len(kept), id=ids[kept], n=times[kept], tokens=_lists(tokens, ends))
            yield batch(COUNT, len(code), left=code >> 32, right=code & 0xFFFFFFFF, cnt=delta)
            yield batch(PLACE, len(pair), left=pair >> 32, right=pair & 0xFFFFFFFF, id=own)

    return rows.select("id", "n", "tokens").mapInArrow(run, STEP)


class PairTables:
    """Training state as tables in layers: sequences (the newest of an id counts), pair counts (to be summed), and an index from pair to sequences.

    A pass reads the counts, asks the index for the sequences that hold its pairs, and writes those that changed, the changes of counts
    and the places of new pairs. An index entry may be out of date: then its sequence is looked at and doesn't change.
    """

    def __init__(self, distinct: DataFrame):
        """distinct: tokens, n."""
        self.spark, self.age = distinct.sparkSession, 0
        base = saved(distinct.select(F.monotonically_increasing_id().alias("id"), "n", "tokens", F.lit(0).alias("age")), "sequences")
        newest = lambda df: df.groupBy("id").agg(F.max_by(F.struct("n", "tokens", "age"), "age").alias("x")).select("id", "x.*")
        self.sequences = Layers(newest)
        self.counts = Layers(lambda df: df.groupBy("left", "right").agg(F.sum("cnt").alias("cnt")).filter("cnt <> 0"))
        self.index = Layers(lambda df: df.distinct().repartitionByRange("left", "right").sortWithinPartitions("left", "right"))
        self.newest = newest
        self.top = base.agg(F.max(F.array_max("tokens"))).first()[0]
        self.counts.add(saved(pair_counts(base, F.col("n")), "counts"))
        n = F.greatest(F.size("tokens") - 1, F.lit(0))
        pairs = F.array_distinct(F.arrays_zip(F.slice("tokens", F.lit(1), n).alias("l"), F.slice("tokens", F.lit(2), n).alias("r")))
        places = base.select("id", F.explode(pairs).alias("p")).select(F.col("p.l").alias("left"), F.col("p.r").alias("right"), "id")
        self.index.add(saved(places.repartitionByRange("left", "right").sortWithinPartitions("left", "right"), "index"))
        self.sequences.add(base)

    def best(self) -> list[tuple[int, int, int]]:
        """The commonest pairs, as many as a pass looks at."""
        if not self.counts.layers:
            return []
        return [tuple(r) for r in self.counts.combine(self.counts.all()).orderBy(F.col("cnt").desc(), "left", "right").limit(CANDIDATES).select("left", "right", "cnt").collect()]

    def merge(self, rules: list[tuple[int, int, int]]) -> None:
        wanted = F.lit(False)
        for left, right, _ in rules:
            wanted = wanted | ((F.col("left") == left) & (F.col("right") == right))  # a filter of the scan: layers are sorted by pair
        ids = self.index.all().filter(wanted).select("id").distinct()
        rows = self.newest(self.sequences.all().join(ids, "id", "left_semi"))
        path = scratch(self.spark, "pass")
        _pass(rows, rules).write.partitionBy("kind").parquet(path)
        self.age += 1
        for kind, layers in ((SEQUENCE, self.sequences), (COUNT, self.counts), (PLACE, self.index)):
            if not exists(self.spark, f"{path}/kind={kind}"):
                continue
            part = opened(self.spark, f"{path}/kind={kind}", ", ".join(f"{c} {_TYPE[c]}" for c in _OF[kind]))
            if kind == SEQUENCE:
                aged = saved(part.withColumn("age", F.lit(self.age)), "sequences")
            else:
                aged = saved(layers.combine(part), "counts" if kind == COUNT else "index")
            discard(part)
            layers.add(aged)
        discard(opened(self.spark, path, STEP))

    @property
    def written(self) -> int:
        """Rows written so far, by table."""
        return self.sequences.written, self.counts.written, self.index.written

    def discard(self) -> None:
        for x in (self.sequences, self.counts, self.index):
            x.discard()


def train_tables(distinct: DataFrame, merges: int, min_frequency: int = 2, top: int | None = None) -> tuple[list[tuple[int, int, int, int]], tuple[int, int, int]]:
    """(left, right, new_id, cnt) by rank, of sequences (tokens, n) of any size, and the rows written of sequences, counts and index. top: the largest token, if sequences leave some out."""
    state, rules = PairTables(distinct), []
    state.top = state.top if top is None else top
    try:
        while state.top is not None and len(rules) < merges:
            made = [(left, right, state.top + 2 + len(rules) + k, n) for k, (left, right, n) in enumerate(independent(state.best(), min_frequency)[: merges - len(rules)])]
            if not made:
                break
            rules += made
            if len(rules) < merges:
                state.merge([r[:3] for r in made])
        return rules, state.written
    finally:
        state.discard()


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists end to end, and where each ends; null is empty."""
    sizes = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
    return np.asarray(lists.flatten(), dtype=np.int64), np.cumsum(sizes)


#: Rows of a batch that are counted or cut at once, and tokens of a batch that is counted whole; distinct pieces that a task holds while it counts them; pairs that a task holds to cut by.
SLICE_ROWS, SLICE_TOKENS, HELD_PIECES, HELD_PAIRS = 256, 1_000_000, 300_000, 1_000_000


def merge_all(flat: np.ndarray, ends: np.ndarray, rules: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and ends after a few rules (left, right, new_id), each in one pass over all tokens."""
    for left, right, new_id in rules:
        hit = (flat[:-1] == left) & (flat[1:] == right)
        hit[ends[(ends > 0) & (ends < len(flat))] - 1] = False
        at = np.flatnonzero(hit)
        if left == right and len(at) > 1:
            # In a run of one token every other place is taken.
            first = np.concatenate([[True], at[1:] != at[:-1] + 1])
            at = at[(np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1]) % 2 == 0]
        kept = np.ones(len(flat), bool)
        kept[at + 1] = False
        flat = flat.copy()
        flat[at] = new_id
        flat, ends = flat[kept], ends - np.searchsorted(at + 1, ends)
    return flat, ends


def _totals(sequences: DataFrame, rules: list[tuple[int, int, int]] = ()) -> DataFrame:
    """kind, left, right, cnt: the counts of adjacent pairs (COUNT), and of tokens by a batch's largest one, which is in left (SEQUENCE), after rules (left, right, new_id). Batches are counted where they are."""

    def run(batches):
        for b in batches:
            size = b.num_rows if len(b.column(0).flatten()) <= SLICE_TOKENS else SLICE_ROWS
            for k in range(0, b.num_rows, max(size, 1)):
                flat, ends = merge_all(*_flat(b.column(0).slice(k, size)), rules)
                if not len(flat):
                    continue
                inner = np.ones(len(flat), bool)
                inner[ends[ends > 0] - 1] = False
                at = np.flatnonzero(inner)
                if flat.min() >= 0 and flat.max() < 1 << 21:
                    types = np.flatnonzero(np.bincount(flat))
                    place = np.zeros(types[-1] + 1, np.int64)
                    place[types] = np.arange(len(types))
                else:
                    types = None
                if types is not None and len(types) <= 2048:
                    n = np.bincount(place[flat[at]] * len(types) + place[flat[at + 1]])
                    code = np.flatnonzero(n)
                    left, right, n = types[code // len(types)], types[code % len(types)], n[code]
                else:
                    code, n = np.unique((flat[at] << 32) | flat[at + 1], return_counts=True)
                    left, right = code >> 32, code & 0xFFFFFFFF
                yield pa.RecordBatch.from_arrays([pa.array(np.append(np.full(len(n), COUNT), SEQUENCE).astype(np.int32)), *(pa.array(np.append(x, y).astype(np.int32)) for x, y in ((left, flat.max()), (right, 0))), pa.array(np.append(n, len(flat)).astype(np.int64))], ["kind", "left", "right", "cnt"])

    return sequences.select("tokens").mapInArrow(run, "kind int, left int, right int, cnt long").groupBy("kind", "left", "right").agg(F.sum("cnt").alias("cnt"))


def pieces(sequences: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """tokens, n: the distinct pieces of sequences (tokens) that are cut between any two tokens that aren't one of pairs, and how often each is there; single tokens go."""
    wanted = np.sort(np.array([(a << 32) | b for a, b in pairs], np.int64))

    def run(batches):
        held: dict[bytes, int] = {}

        def flush():
            raw = b"".join(held)
            out = pa.RecordBatch.from_arrays([_lists(np.frombuffer(raw, np.int32), np.cumsum([len(x) // 4 for x in held])), pa.array(list(held.values()), pa.int64())], ["tokens", "n"])
            held.clear()
            return out

        for b in batches:
            for k in range(0, b.num_rows, SLICE_ROWS):
                flat, ends = _flat(b.column(0).slice(k, SLICE_ROWS))
                if len(flat) < 2 or not len(wanted):
                    continue
                code = (flat[:-1] << 32) | flat[1:]
                whole = wanted[np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)] == code
                whole[ends[(ends > 0) & (ends < len(flat))] - 1] = False
                stops = np.append(np.flatnonzero(~whole) + 1, len(flat))
                begins = np.concatenate([[0], stops[:-1]])
                long = stops - begins > 1
                raw = flat.astype(np.int32).tobytes()
                for x, y in zip((begins[long] * 4).tolist(), (stops[long] * 4).tolist()):
                    piece = raw[x:y]
                    held[piece] = held.get(piece, 0) + 1
                if len(held) > HELD_PIECES:
                    yield flush()
        if held:
            yield flush()

    return sequences.select("tokens").mapInArrow(run, "tokens array<int>, n long").groupBy("tokens").agg(F.sum("n").alias("n"))


def _merged_by(sequences: DataFrame, rules: list[tuple[int, int, int]]) -> DataFrame:
    """sequences (tokens) after rules (left, right, new_id), by rank."""
    book = Codebook(rules)

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, SLICE_ROWS):
                tok, ends, _, _ = book._encode(*_flat(b.column(0).slice(k, SLICE_ROWS)))
                yield pa.RecordBatch.from_arrays([_lists(tok, ends)], ["tokens"])

    return sequences.select("tokens").mapInArrow(run, "tokens array<int>")


def train_pieces(sequences: DataFrame, totals: DataFrame, merges: int, min_frequency: int, top: int) -> list[tuple[int, int, int, int]]:
    """(left, right, new_id, cnt) by rank, of sequences of any size, of which totals are the counts and top the largest token.

    A merge joins what stands next to each other at least as often as it counts. So as long as merges count some number or more, nothing is joined where
    two tokens stand next to each other less often, and sequences may be cut there: such pieces are short and repeat. A phase learns the merges that count
    at least a third of the commonest pair; then the sequences are merged by them and counted again, until merges count too little.
    """
    rules, lowest, now = [], max(min_frequency, 1), sequences
    while len(rules) < merges:
        counts = totals.filter(F.col("kind") == COUNT)
        best = counts.agg(F.max("cnt")).first()[0]
        if best is None or best < lowest:
            break
        least = max(lowest, best // 3)
        pairs = [tuple(r) for r in counts.filter(F.col("cnt") >= least).select("left", "right").limit(HELD_PAIRS + 1).collect()]
        cut = saved(now.groupBy("tokens").agg(F.count("*").alias("n")) if len(pairs) > HELD_PAIRS else pieces(now, pairs), "pieces")
        size = cut.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
        first = top + 2 + len(rules)
        found = _train_local(cut, merges - len(rules), least, first) if size <= LOCAL_TOKENS else train_tables(cut, merges - len(rules), least, first - 2)[0]
        discard(cut)
        rules += found
        if len(rules) >= merges or least == lowest:
            break
        new = saved(_merged_by(now, [r[:3] for r in found]), "merged")
        discard(now, totals)
        now, totals = new, saved(_totals(new), "totals")
    discard(now, totals)  # not the sequences given, which aren't saved here
    return rules


def train_rounds(sequences: DataFrame, totals: DataFrame, merges: int, min_frequency: int, top: int) -> list[tuple[int, int, int, int]]:
    """As train_pieces, for few merges: a round counts the pairs of all sequences, merged in passing by the rules so far, and takes the merges that are sure to be next. Nothing but counts is shuffled or written."""
    rules: list[tuple[int, int, int, int]] = []
    while len(rules) < merges:
        best = totals.filter(F.col("kind") == COUNT).orderBy(F.col("cnt").desc(), "left", "right").limit(CANDIDATES).select("left", "right", "cnt").collect()
        found = independent([tuple(r) for r in best], max(min_frequency, 1))[: merges - len(rules)]
        if not found:
            break
        rules += [(left, right, top + 2 + len(rules) + k, n) for k, (left, right, n) in enumerate(found)]
        totals = _totals(sequences, [r[:3] for r in rules])
    return rules


def _train_local(distinct: DataFrame, merges: int, min_frequency: int, first_id: int | None = None) -> list[tuple[int, int, int, int]]:
    rows = distinct.toArrow()
    flat, ends = _flat(rows.column("tokens").combine_chunks()) if rows.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return train_arrays(flat, ends, np.asarray(rows.column("n"), dtype=np.int64), merges, min_frequency, first_id)


def train(sequences: DataFrame, merges: int = 2000, min_frequency: int = 2, strategy: str = "auto") -> DataFrame:
    """The codebook (rank, left, right, new_id, cnt). strategy: auto, local or distributed.

    Sequences of up to LOCAL_TOKENS are trained on one machine, where equal ones are one, with a multiplicity. Of more, up to FEW_MERGES are
    counted in a pass over all each (train_rounds); for more merges the distinct pieces between which nothing is merged are (train_pieces), or, if those are more too, passes over tables (PairTables) take all merges that are
    sure to be next. distributed: passes over tables, of whole sequences. All give the same rules.
    """
    spark = sequences.sparkSession
    distinct = sequences.groupBy("tokens").agg(F.count("*").alias("n"))
    if strategy == "auto":
        totals = saved(_totals(sequences), "totals")
        size, top = totals.filter(F.col("kind") == SEQUENCE).agg(F.coalesce(F.sum("cnt"), F.lit(0)), F.max("left")).first()
        large = train_rounds if merges <= FEW_MERGES else train_pieces
        rules = _train_local(distinct, merges, min_frequency) if size <= LOCAL_TOKENS else large(sequences.select("tokens"), totals, merges, min_frequency, top)
        discard(totals)
    elif strategy == "local":
        rules = _train_local(distinct, merges, min_frequency)
    else:
        rules, _ = train_tables(distinct, merges, min_frequency)
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rules)], RULES)


def vocab_size(sequences: DataFrame, rules: DataFrame) -> DataFrame:
    """base, merges, vocab_size, separator (the id left free)."""
    base = sequences.select(F.explode("tokens").alias("t")).agg(F.countDistinct("t").alias("base"), (F.max("t") + 1).alias("separator"))
    return base.crossJoin(rules.agg(F.count("*").alias("merges"))).withColumn("vocab_size", F.col("base") + F.col("merges"))  # one row each


def encode_list(tokens: list[int], rank: dict, limit: int | None = None) -> tuple[list[int], list[int]]:
    """Encoded tokens, and the ranks applied. rank: (left, right) -> (rank, new_id). The lowest-ranked pair present is merged first. The plain form of encode_arrays."""
    used = []
    while len(tokens) > 1:
        best = min((rank[p] for p in zip(tokens, tokens[1:]) if p in rank), default=None)
        if best is None or (limit is not None and best[0] >= limit):
            break
        pair = next(p for p in zip(tokens, tokens[1:]) if rank.get(p) == best)
        tokens = merge_list(tokens, *pair, best[1])
        used.append(best[0])
    return tokens, used


def gathered(values: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists that which names, one after another, and where each ends."""
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    size = (ends - begins)[which]
    stops = np.cumsum(size)
    return values[np.arange(stops[-1] if len(stops) else 0) + np.repeat(begins[which] - (stops - size), size)], stops


class Codebook:
    """Rules as arrays: pairs as sorted numbers, with their ranks."""

    def __init__(self, rules: list[tuple[int, int, int]]):
        """rules: (left, right, new_id) by rank."""
        code = np.array([(a << 32) | b for a, b, _ in rules], np.int64)
        self.order = np.argsort(code, kind="stable")
        self.code, self.rules = code[self.order], rules

    def ranks(self, code: np.ndarray) -> np.ndarray:
        """The ranks of pairs; -1 where there is none."""
        if not len(self.code):
            return np.full(len(code), -1)
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[at] == code, self.order[at], -1)

    def encode(self, tokens: np.ndarray, ends: np.ndarray, limits: np.ndarray | None = None):
        """Tokens and ends after the rules, ranks applied, and their ends. limits: by sequence, rules of lower rank only. Equal sequences are encoded once."""
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        raw, first, which = tokens.astype(np.int32).tobytes(), {}, np.empty(len(ends), np.int64)
        tags = np.zeros(len(ends), np.int64) if limits is None else limits
        for k, (a, b, tag) in enumerate(zip((begins * 4).tolist(), (ends * 4).tolist(), tags.tolist())):
            which[k] = first.setdefault((raw[a:b], tag), len(first))
        if len(first) > 0.9 * len(ends):
            return self._encode(tokens, ends, limits)
        own = np.zeros(len(first), np.int64)
        own[which[::-1]] = np.arange(len(ends) - 1, -1, -1)  # the first of each
        tok, stops, rank, last = self._encode(*gathered(tokens, ends, own), None if limits is None else limits[own])
        return *gathered(tok, stops, which), *gathered(rank, last, which)

    def _encode(self, tokens: np.ndarray, ends: np.ndarray, limits: np.ndarray | None = None):
        """As encode, of each sequence.

        A new token's rules come after the rule that made it, so one pass by rank does: what a merge brings together is put by for its rank.
        """
        c, waiting = Corpus(tokens, ends), [[] for _ in self.rules]
        owner = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
        used: list[tuple[np.ndarray, int]] = []

        def put(places):
            places, code = c.pairs(places)
            rank = self.ranks(code)
            keep = rank >= 0 if limits is None else (rank >= 0) & (rank < limits[owner[places]])
            places, rank = places[keep], rank[keep]
            if len(places):
                order = np.argsort(rank, kind="stable")
                found, start = np.unique(rank[order], return_index=True)
                for r, own in zip(found.tolist(), np.split(places[order], start[1:])):
                    waiting[r].append(own)

        put(np.arange(len(tokens)))
        for r, (left, right, new_id) in enumerate(self.rules):
            if waiting[r]:
                at = c.hits(np.concatenate(waiting[r]), left, right)
                if len(at):
                    used.append((distinct(owner[at]), r))
                    c.merge(at, new_id)
                    put(c.made(at))
                waiting[r] = None
        at, tok = c.rest()
        who = np.concatenate([x for x, _ in used] or [np.zeros(0, np.int64)])
        rank = np.concatenate([np.full(len(x), r) for x, r in used] or [np.zeros(0, np.int64)])
        order = np.argsort(who, kind="stable")  # ranks rise already
        return tok, np.searchsorted(at, ends), rank[order], np.cumsum(np.bincount(who, minlength=len(ends)))


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values.astype(np.int32)))


def encode(sequences: DataFrame, rules: DataFrame, limit: int | None = None, limit_column: str | None = None) -> DataFrame:
    """sequences with encoded and ranks. limit: rules of lower rank only, for all, or by a column. A codebook has as many rows as merges, so each task holds it."""
    book = Codebook([(r["left"], r["right"], r["new_id"]) for r in rules.orderBy("rank").collect()])
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    ints = ArrayType(IntegerType())
    schema = StructType([*sequences.schema.fields, StructField("encoded", ints), StructField("ranks", ints)])
    names = [*sequences.columns, "encoded", "ranks"]

    def run(batches):
        held, size = [], 0

        def flush():
            (whole,) = pa.Table.from_batches(held).combine_chunks().to_batches()  # one batch, or an error: no row is left behind
            flat, ends = _flat(whole.column(whole.schema.get_field_index("tokens")))
            limits = None if limit is None else np.full(len(ends), limit)
            if limit_column:
                limits = np.asarray(whole.column(whole.schema.get_field_index(limit_column)), dtype=np.int64)
            tok, stops, rank, last = book.encode(flat, ends, limits)
            return pa.RecordBatch.from_arrays([*whole.columns, _lists(tok, stops), _lists(rank, last)], names)

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += len(b.column(b.schema.get_field_index("tokens")).flatten())
            if size >= CHUNK_TOKENS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return sequences.mapInArrow(run, schema)


def draw(salt, *keys) -> Column:
    """A number from 0 to 1 by a digest of the keys, which any engine with md5 can repeat."""
    key = F.concat_ws(":", *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys], F.lit(str(salt)))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


#: Draws of a truncated Gaussian before it is set to a bound.
TRIES = 8


def rank_limit(mode: str, rules: int, k: int | None = None, lo: int = 0, hi: int | None = None, seed: int = 42, keys=("graph_id",)) -> Column:
    """A column of rank limits: none, all, topk, random, triangular or gaussian between lo and hi; drawn by a digest of the keys.

    triangular has its mode at hi; gaussian has its mean at hi and a third of the range as deviation, cut to whole numbers and drawn up to TRIES times until it is inside; else it is hi.
    """
    hi = rules if hi is None else hi
    u = lambda salt: draw(f"{seed}:{salt}", *keys)
    normal = lambda t: (hi + F.sqrt(-2 * F.log(F.greatest(u(f"a{t}"), F.lit(1e-12)))) * F.cos(2 * F.pi() * u(f"b{t}")) * max(1.0, (hi - lo) / 3.0)).cast("long")
    tries = [normal(t) for t in range(TRIES)]
    value = {
        "none": lambda: F.lit(0), "all": lambda: F.lit(rules), "topk": lambda: F.lit(k if k is not None else rules), "random": lambda: lo + F.floor(u("r") * (hi - lo + 1)),
        "triangular": lambda: F.floor(lo + (hi - lo) * F.sqrt(u("t"))), "gaussian": lambda: F.coalesce(*[F.when((x >= lo) & (x <= hi), x) for x in tries], F.lit(hi)),
    }[mode]()
    return F.greatest(F.lit(lo if mode in ("random", "triangular", "gaussian") else 0), F.least(F.lit(rules), value)).cast("int")


def eval_limit(mode: Column, rules: Column | int, k: Column | int | None = None, lo: Column | int = 0, hi: Column | int | None = None) -> Column:
    """The fixed rank limit that stands for a drawn one in evaluation, by mode: none, all, topk (k), random and triangular (the middle of lo and hi, halves to even), gaussian (k, or else hi)."""
    col = lambda x: F.lit(x) if isinstance(x, int) else F.lit(None).cast("int") if x is None else x
    rules, k, lo = col(rules), col(k), col(lo)
    hi = F.coalesce(col(hi), rules)
    fixed = F.when(mode == "none", 0).when(mode == "all", rules).when(mode == "topk", k).when(mode.isin("random", "triangular"), F.bround((lo + hi) / 2)).when(mode == "gaussian", F.coalesce(k, hi))
    return F.greatest(F.lit(0), F.least(rules, F.coalesce(fixed, rules))).cast("int")


def expansions(rules: DataFrame) -> DataFrame:
    """token, base (array of int) of each new id. A rule's parts are older than it, so one pass in order of rank does."""
    known: dict[int, list[int]] = {}
    for r in rules.orderBy("rank").collect():
        known[r["new_id"]] = known.get(r["left"], [r["left"]]) + known.get(r["right"], [r["right"]])
    return rules.sparkSession.createDataFrame(list(known.items()), "token int, base array<int>")


def decode(sequences: DataFrame, rules: DataFrame, column: str = "encoded") -> DataFrame:
    """sequences with decoded."""
    known = {r["token"]: np.array(r["base"], np.int32) for r in expansions(rules).collect()}
    at = sequences.columns.index(column)
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    ids = np.array(sorted(known), np.int64)
    sizes = np.array([len(known[i]) for i in ids.tolist()], np.int64)
    begins, flat = np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([known[i] for i in ids.tolist()] or [np.zeros(0, np.int32)])

    def run(batches):
        for b in batches:
            tok, ends = _flat(b.column(at))
            place = np.minimum(np.searchsorted(ids, tok), max(len(ids) - 1, 0))
            new = ids[place] == tok if len(ids) else np.zeros(len(tok), bool)
            n = np.where(new, sizes[place], 1) if len(ids) else np.ones(len(tok), np.int64)
            stop = np.cumsum(n)
            out = np.repeat(tok, n)
            within = np.arange(len(out)) - np.repeat(stop - n, n)
            if len(ids):
                is_new = np.repeat(new, n)
                out[is_new] = flat[(np.repeat(begins[place], n) + within)[is_new]]
            yield pa.RecordBatch.from_arrays([*b.columns, _lists(out, np.concatenate([[0], stop])[ends])], [*b.schema.names, "decoded"])

    return sequences.mapInArrow(run, StructType([*sequences.schema.fields, StructField("decoded", ArrayType(IntegerType()))]))


def compression(encoded: DataFrame) -> DataFrame:
    """sequences, before, after, saved, ratio, exact (share decoded to what it was) of rows (tokens, encoded, decoded)."""
    x = encoded.agg(F.count("*").alias("sequences"), F.sum(F.size("tokens")).alias("before"), F.sum(F.size("encoded")).alias("after"), F.avg((F.col("decoded") == F.col("tokens")).cast("double")).alias("exact"))
    return x.withColumn("saved", F.col("before") - F.col("after")).withColumn("ratio", F.col("after") / F.col("before"))


def codebook_sizes(rules: DataFrame) -> DataFrame:
    """new tokens by how many base tokens they hold: 1, 2-3, 4-10 or more."""
    n = F.size("base")
    kind = F.when(n <= 1, "1").when(n <= 3, "2-3").when(n <= 10, "4-10").otherwise(">10")
    return expansions(rules).groupBy(kind.alias("size")).agg(F.count("*").alias("tokens"))


#: Fixed value: atoms of a molecule's string, in brackets, of two letters or of one.
ATOMS = r"(\[[^\]]+\]|Cl|Br|Si|Se|Na|Li|K|Mg|Ca|Fe|Zn|Cu|Mn|Co|Ni|Cd|Hg|[BCNOPSFIbcnopsfi])"


def codebook_patterns(rules: DataFrame, elements: tuple[str, ...] = ("C", "N", "O", "S"), targets: tuple[str, ...] = ()) -> DataFrame:
    """rank, new_id, text, atoms, size (bin of atoms), rings, one has_<k> an element, target, of a codebook over code points.

    rings: half the digits of the text, as a ring's ends carry one each. target: whether the text holds one of targets;
    the least rank of those that do is first_rank.
    """
    text = F.concat_ws("", F.transform("base", lambda t: F.char(t)))
    x = rules.select("rank", "new_id").join(expansions(rules).withColumnRenamed("token", "new_id"), "new_id").withColumn("text", text)
    atoms = F.size(F.regexp_extract_all("text", F.lit(ATOMS), F.lit(0)))
    kind = F.when(F.col("atoms") <= 1, "1").when(F.col("atoms") <= 3, "2-3").when(F.col("atoms") <= 10, "4-10").otherwise(">10")
    digits = F.length(F.regexp_replace("text", "[^0-9]", ""))
    target = F.lit(False)
    for t in targets:
        target = target | F.contains("text", F.lit(t))
    x = x.withColumn("atoms", atoms).withColumns({"size": kind, "rings": F.floor(digits / 2).cast("int"), "target": target, **{f"has_{e}": F.lower("text").contains(e.lower()) for e in elements}})
    return x.drop("base").withColumn("first_rank", F.min(F.when(F.col("target"), F.col("rank"))).over(W.partitionBy("target")))
