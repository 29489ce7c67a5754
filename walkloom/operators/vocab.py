"""Vocabularies, model-ready batches, augmentation and label scaling."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from walkloom.operators.stats import quantiles

#: Ids of special tokens.
SPECIALS = {"PAD": 0, "UNK": 1, "MASK": 2, "CLS": 3, "SEP": 4, "NODE_START": 5, "NODE_END": 6, "COMP_SEP": 7}


def frequencies(tokens: DataFrame) -> DataFrame:
    """tok, cnt, first (graph_id, pos) of rows graph_id, pos, tok; negative tokens are left out."""
    return tokens.filter("tok >= 0").groupBy("tok").agg(F.count("*").alias("cnt"), F.min(F.struct("graph_id", "pos")).alias("first"))


def _counted(flat):
    """Distinct values, the place where each is first, and how often it is there; by a table where values are small."""
    import numpy as np

    if not len(flat) or flat.min() < 0 or flat.max() > 1 << 21:
        return np.unique(flat, return_index=True, return_counts=True)
    n = np.bincount(flat)
    first = np.zeros(len(n), np.int64)
    first[flat[::-1]] = np.arange(len(flat) - 1, -1, -1)  # the last one written stays
    tok = np.flatnonzero(n)
    return tok, first[tok], n[tok]


def frequencies_of(sequences: DataFrame) -> DataFrame:
    """As frequencies, from sequences (graph_id, tokens): a batch's tokens are counted where they are."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            b = b.take(pa.array(np.argsort(np.asarray(b.column(0)), kind="stable")))  # so that the first place is that of the least id
            lists = b.column(1)
            sizes = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
            tok, at, n = _counted(np.asarray(lists.flatten(), dtype=np.int64))
            ends = np.cumsum(sizes)
            row = np.searchsorted(ends, at, side="right")
            first = pa.StructArray.from_arrays([b.column(0).take(pa.array(row)).cast(pa.int64()), pa.array((at - (ends - sizes)[row]).astype(np.int32))], ["graph_id", "pos"])
            keep = pa.array(tok >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(tok.astype(np.int32)).filter(keep), pa.array(n).filter(keep), first.filter(keep)], ["tok", "cnt", "first"])

    parts = sequences.select("graph_id", "tokens").mapInArrow(run, "tok int, cnt long, first struct<graph_id: long, pos: int>")
    return parts.groupBy("tok").agg(F.sum("cnt").alias("cnt"), F.min("first").alias("first"))


def build(tokens: DataFrame, min_frequency: int = 1, max_size: int | None = None, compat_pad_zero: bool = False) -> DataFrame:
    """token, vocab_id, freq: by count downwards, ties to what is seen first; ids follow the special ones. tokens: as for frequencies, or what that gives."""
    f = (tokens if "cnt" in tokens.columns else frequencies(tokens)).filter(F.col("cnt") >= min_frequency)
    if compat_pad_zero:
        f = f.filter("tok <> 0")
    rank = F.row_number().over(W.orderBy(F.col("cnt").desc(), "first"))  # one row a distinct token
    out = f.select(F.col("tok").alias("token"), (rank + len(SPECIALS) - 1).alias("vocab_id"), F.col("cnt").alias("freq"))
    return out if max_size is None else out.filter(F.col("vocab_id") < max_size)


#: Types of a vocabulary that each task holds, at most (16 bytes each); with more, tokens are joined.
HELD_TYPES = 5_000_000


def ids_of(sequences: DataFrame, vocab: DataFrame) -> DataFrame:
    """sequences with tokens replaced by their ids, in place; unknown tokens are UNK."""
    import numpy as np

    rows = vocab.select("token", "vocab_id").limit(HELD_TYPES + 1).toArrow()
    if rows.num_rows > HELD_TYPES:
        long = to_ids(sequences.select("graph_id", F.posexplode("tokens").alias("pos", "tok")), vocab)
        lists = long.groupBy("graph_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "vocab_id"))), lambda x: x["vocab_id"]).alias("tokens"))
        return sequences.drop("tokens").join(lists, "graph_id", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<int>"))).select(sequences.columns)
    token, ids = (np.asarray(rows.column(c), dtype=np.int64) for c in ("token", "vocab_id"))
    order = np.argsort(token)
    token, ids = token[order], ids[order].astype(np.int32)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            lists = b.column(at)
            flat = np.asarray(lists.flatten(), dtype=np.int64)
            place = np.minimum(np.searchsorted(token, flat), max(len(token) - 1, 0))
            new = np.where(token[place] == flat, ids[place], SPECIALS["UNK"]) if len(token) else np.full(len(flat), SPECIALS["UNK"])
            ends = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))])
            cols = list(b.columns)
            cols[at] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(new.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    at = sequences.columns.index("tokens")
    return sequences.mapInArrow(run, sequences.schema)


def coverage(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """total, known, rate of tokens that the vocabulary has."""
    x = frequencies(tokens).join(vocab.select(F.col("token").alias("tok"), "vocab_id"), "tok", "left")
    x = x.agg(F.sum("cnt").alias("total"), F.sum(F.when(F.col("vocab_id").isNotNull(), F.col("cnt")).otherwise(0)).alias("known"))
    return x.withColumn("rate", F.col("known") / F.col("total"))


def with_all(frequency: DataFrame, rules: DataFrame) -> DataFrame:
    """tok, cnt: counted tokens, with every base and new id of a codebook counted at least once."""
    more = rules.select(F.explode(F.array("left", "right", "new_id")).alias("tok")).distinct().withColumn("cnt", F.lit(0).cast("long"))
    return frequency.select("tok", "cnt").union(more).groupBy("tok").agg(F.greatest(F.sum("cnt"), F.lit(1)).alias("cnt"))


def to_ids(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """graph_id, pos, vocab_id; unknown tokens are UNK."""
    v = vocab.select(F.col("token").alias("tok"), "vocab_id")
    return tokens.join(v, "tok", "left").select("graph_id", "pos", F.coalesce("vocab_id", F.lit(SPECIALS["UNK"])).alias("vocab_id"))


def encoded(ids: DataFrame, max_len: int) -> DataFrame:
    """graph_id, input_ids, attention_mask of length max_len: CLS, ids, SEP, and PAD; longer ones are cut before SEP."""
    s = ids.groupBy("graph_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "vocab_id"))), lambda x: x["vocab_id"]).alias("ids"))
    body = F.concat(F.array(F.lit(SPECIALS["CLS"])), F.slice("ids", 1, max_len - 2), F.array(F.lit(SPECIALS["SEP"])))
    n = F.size("b")
    s = s.withColumn("b", body)
    return s.select("graph_id", F.concat("b", F.array_repeat(F.lit(SPECIALS["PAD"]), (max_len - n).cast("int"))).alias("input_ids"), F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), (max_len - n).cast("int"))).alias("attention_mask"))


def compatibility(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """types, unknown, ratio, verdict: ok up to 5 % unknown types, warn up to 10 %, else fail."""
    x = tokens.select("tok").distinct().join(vocab.select(F.col("token").alias("tok"), "vocab_id"), "tok", "left")
    x = x.agg(F.count("*").alias("types"), F.count_if(F.col("vocab_id").isNull()).alias("unknown"))
    ratio = F.col("unknown") / F.col("types")
    return x.withColumn("ratio", ratio).withColumn("verdict", F.when(ratio <= 0.05, "ok").when(ratio <= 0.1, "warn").otherwise("fail"))


def length_policy(lengths: DataFrame, policy: str = "max", k: float = 3.0, cap: int = 8096, positions: int | None = None) -> DataFrame:
    """max_len of rows (n): the largest, or the mean and k population deviations, and two; at most cap. An error if that is more than positions."""
    n = F.max("n") if policy == "max" else F.ceil(F.avg("n") + k * F.stddev_pop("n"))
    x = lengths.agg(F.least(F.coalesce(n.cast("long"), F.lit(0)) + 2, F.lit(cap)).cast("long").alias("max_len"))
    if positions is None:
        return x
    return x.select(F.when(F.col("max_len") > positions, F.raise_error(F.format_string(f"a length of %s is more than the {positions} positions", "max_len")).cast("long")).otherwise(F.col("max_len")).alias("max_len"))


def framed(sequences: DataFrame, max_len: int) -> DataFrame:
    """As encoded, from sequences of ids (graph_id, tokens)."""
    body = F.concat(F.array(F.lit(SPECIALS["CLS"])), F.slice("tokens", 1, max_len - 2), F.array(F.lit(SPECIALS["SEP"])))
    n = F.size("b")
    pad = lambda x: F.array_repeat(F.lit(x), (max_len - n).cast("int"))
    return sequences.withColumn("b", body).select("graph_id", F.concat("b", pad(SPECIALS["PAD"])).alias("input_ids"), F.concat(F.array_repeat(F.lit(1), n), pad(0)).alias("attention_mask"))


#: A prime below 2 ** 31, so that squares fit in a long.
PRIME = 2_147_483_647


def salt_number(salt: str) -> int:
    return zlib.crc32(salt.encode()) % PRIME


def uniform(salt: str, key: Column | str, place: Column | int = 0) -> Column:
    """A number from 0 to 1 by whole-number arithmetic on a key and a place, which SQL can repeat."""
    s, key = salt_number(salt), F.col(key) if isinstance(key, str) else key
    h = F.pmod(key.cast("long") * 7919 + (F.lit(place) if isinstance(place, int) else place).cast("long") * 104729 + s, F.lit(PRIME).cast("long"))
    h = (h * h + h * 40503 + s) % PRIME
    h = (h * h + h * 12345 + 1) % PRIME
    return h.cast("double") / float(PRIME)


def uniform_sql(salt: str, key: str, place: str = "0") -> str:
    """The same number in SQL."""
    s = salt_number(salt)
    h = f"((CAST({key} AS BIGINT) * 7919 + CAST({place} AS BIGINT) * 104729 + {s}) % {PRIME})"
    h = f"(list_transform([{h}], lambda h: (h * h + h * 40503 + {s}) % {PRIME})[1])"
    return f"(list_transform([{h}], lambda h: (h * h + h * 12345 + 1) % {PRIME})[1] / {float(PRIME)})"


def _uniform_at(salt: str, key, place):
    """The same numbers in numpy, of arrays of whole keys and places; keys of any size."""
    s = salt_number(salt)
    h = (key % PRIME * 7919 + place * 104729 + s) % PRIME
    h = (h * h + h * 40503 + s) % PRIME
    h = (h * h + h * 12345 + 1) % PRIME
    return h / float(PRIME)


#: Tokens that are drawn at once, about.
DRAWN_AT_ONCE = 1 << 20


def masked(sequences: DataFrame, vocab_size: int, p: float = 0.15, seed: int = 42) -> DataFrame:
    """graph_id, input_ids, labels of sequences of ids: of the tokens drawn, 80 % are MASK, 10 % another, 10 % stay; labels are -100 elsewhere. vocab_size: ids in all, special ones included.

    Drawn by the numbers of uniform(), for many tokens at once.
    """
    import numpy as np

    def changed(ids, lists):
        import pyarrow as pa

        flat, n = lists.flatten(), np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
        ends = np.cumsum(n)
        x, key = np.asarray(flat.fill_null(0)), np.repeat(np.asarray(ids.fill_null(0), dtype=np.int64), n)
        place = np.arange(len(x)) - np.repeat(ends - n, n)
        known = np.repeat(np.asarray(ids.is_valid()), n)
        at = np.flatnonzero((x >= len(SPECIALS)) & known & (_uniform_at(f"draw:{seed}", key, place) < p))
        key, place, old = key[at], place[at], x[at]
        how, other = _uniform_at(f"how:{seed}", key, place), len(SPECIALS) + np.floor(_uniform_at(f"token:{seed}", key, place) * (vocab_size - len(SPECIALS)))
        new, labels = x.copy(), np.full(len(x), -100, x.dtype)
        new[at] = np.where(how < 0.8, SPECIALS["MASK"], np.where(how < 0.9, other.astype(np.int64), old))
        labels[at] = old
        offsets, no_list = pa.array(np.concatenate([[0], ends]).astype(np.int32)), lists.is_null()
        return [pa.ListArray.from_arrays(offsets, v, mask=no_list) for v in (pa.array(new, mask=np.asarray(flat.is_null())), pa.array(labels))]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ends, at = np.cumsum(np.asarray(b.column(1).value_lengths().fill_null(0), dtype=np.int64)), 0
            while at < b.num_rows:
                to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + DRAWN_AT_ONCE, side="right")), at + 1)
                part = b.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([part.column(0), *changed(part.column(2), part.column(1))], ["graph_id", "input_ids", "labels"])
                at = to

    rows = sequences.select("graph_id", "tokens", F.col("graph_id").cast("long").alias("key"))
    key, lists, _ = (f.dataType.simpleString() for f in rows.schema)
    return rows.mapInArrow(run, f"graph_id {key}, input_ids {lists}, labels {lists}")


def augmented(sequences: DataFrame, how: str, ratio: float = 0.1, p: float = 1.0, window: int = 3, epoch: int = 0, mask_id: int = SPECIALS["MASK"], valid: tuple[int, ...] = ()) -> DataFrame:
    """sequences (graph_id, tokens) changed by deletion, insertion, replacement, swap, truncation or masking; the same for the same epoch.

    A sequence is changed at all with probability p. Then ratio of its length, rounded down, is the number of places that are deleted
    (one token stays), inserted at, replaced, swapped with another in a window around a place, or masked (one at least, one stays);
    truncation leaves a run of at least that share. What is put in comes from valid. Sequences of one token aren't deleted from, swapped, cut or masked.
    """
    t, n = F.col("tokens"), F.size("tokens")
    u = lambda s, i=0: uniform(f"{how}:{s}:{epoch}", "graph_id", i)
    count = F.floor(n * ratio + 1e-9).cast("int")
    at = lambda a, i: F.get(a, i.cast("int"))
    token = lambda i: F.element_at(F.array(*map(F.lit, valid)), (F.floor(u("token", i) * len(valid)) + 1).cast("int"))
    ranked = F.array_sort(F.transform(t, lambda x, i: F.struct(u("place", i).alias("u"), i.alias("i"))))
    chosen = lambda k: F.transform(F.slice(ranked, F.lit(1), k), lambda s: s["i"])
    many = n > 1

    def swapped(acc, j):
        lo = F.greatest(F.lit(0), F.floor(u("centre", j) * n).cast("int") - window // 2)
        size = F.least(n, F.floor(u("centre", j) * n).cast("int") + window // 2 + 1) - lo
        a = (F.floor(u("a", j) * size)).cast("int")
        b = ((a + 1 + F.floor(u("b", j) * (size - 1))) % size).cast("int")
        return F.when(size >= 2, F.transform(acc, lambda x, i: F.when(i == lo + a, at(acc, lo + b)).when(i == lo + b, at(acc, lo + a)).otherwise(x))).otherwise(acc)

    steps = lambda k: F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
    least = F.greatest(F.lit(1), count)
    start = F.floor(u("start") * (n - least + 1)).cast("int")
    length = least + F.floor(u("end") * (n - start - least + 1)).cast("int")

    def inserted():
        where = F.transform(steps(count), lambda j: F.struct(F.floor(u("where", j) * (n + 1)).cast("int").alias("p"), token(j).alias("x")))
        put = lambda i: F.transform(F.filter(where, lambda s: s["p"] == i), lambda s: s["x"])
        return F.concat(F.flatten(F.transform(t, lambda x, i: F.concat(put(i), F.array(x)))), put(n))

    new = {
        "deletion": lambda: F.when(many, F.filter(t, lambda x, i: ~F.array_contains(chosen(F.least(count, n - 1)), i))).otherwise(t),
        "insertion": inserted,
        "replacement": lambda: F.transform(t, lambda x, i: F.when(F.array_contains(chosen(F.least(count, n)), i), token(i)).otherwise(x)),
        "swap": lambda: F.when(many, F.aggregate(steps(count), t, swapped)).otherwise(t),
        "truncation": lambda: F.when(many & (least < n), F.slice(t, start + 1, length)).otherwise(t),
        "masking": lambda: F.when(many, F.transform(t, lambda x, i: F.when(F.array_contains(chosen(F.greatest(F.lit(1), F.least(count, n - 1))), i), F.lit(mask_id)).otherwise(x))).otherwise(t),
    }[how]()
    return sequences.withColumn("tokens", F.when((n > 0) & (u("gate") <= p), new).otherwise(t))


def compose(sequences: DataFrame, steps: list[dict]) -> DataFrame:
    for s in steps:
        sequences = augmented(sequences, **s)
    return sequences


#: Presets of steps.
PRESETS = {
    "default": [{"how": "deletion", "ratio": 0.05, "p": 0.3}, {"how": "swap", "ratio": 0.05, "p": 0.3}],
    "aggressive": [{"how": "deletion", "ratio": 0.1, "p": 0.5}, {"how": "swap", "ratio": 0.1, "p": 0.5}, {"how": "truncation", "ratio": 0.6, "p": 0.3}],
    "conservative": [{"how": "deletion", "ratio": 0.02, "p": 0.2}, {"how": "swap", "ratio": 0.02, "p": 0.2}],
}


def one_variant(sequences: DataFrame, how: str = "first", seed: int = 42) -> DataFrame:
    order = F.col("variant_id") if how == "first" else F.xxhash64("graph_id", "variant_id", F.lit(seed))
    return sequences.withColumn("_n", F.row_number().over(W.partitionBy("graph_id").orderBy(order))).filter("_n = 1").drop("_n")


def scaler(labels: DataFrame, how: str = "standard") -> DataFrame:
    """shift, scale of a column y: mean and population deviation, least and range, or median and quartile range; a scale near 0 is 1."""
    if how == "standard":
        x = labels.agg(F.avg("y").alias("shift"), F.stddev_pop("y").alias("scale"))
    elif how == "minmax":
        x = labels.agg(F.min("y").alias("shift"), (F.max("y") - F.min("y")).alias("scale"))
    else:
        x = quantiles(labels, "y", at=(0.25, 0.5, 0.75), names=("a", "b", "c")).select(F.col("b").alias("shift"), (F.col("c") - F.col("a")).alias("scale"))
    return x.withColumn("scale", F.when(F.abs("scale") < 1e-12, 1.0).otherwise(F.col("scale")))


def scaled(labels: DataFrame, s: DataFrame, inverse: bool = False) -> DataFrame:
    """labels with z (or, inverse, y back from z). The scaler is one row."""
    x = labels.crossJoin(F.broadcast(s))
    return (x.withColumn("y", F.col("z") * F.col("scale") + F.col("shift")) if inverse else x.withColumn("z", (F.col("y") - F.col("shift")) / F.col("scale"))).drop("shift", "scale")
