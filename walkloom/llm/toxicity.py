"""Toxicity by noisy-channel deobfuscation: a character language model over the whole corpus is the source;
leetspeak, separators and repeated characters are the channel; Viterbi decodes each doubtful word's lattice,
and what is restored is scored by terms learned from labels.

Words without digits, symbols, separators or characters in runs of three have one path and aren't decoded.
Defined results: null and empty texts, and texts without learned terms, get the rate of toxic documents among
labelled ones without terms; with no labels, or one kind, every score is that kind's rate (0 without any);
labels of missing documents are ignored, of several for one document the largest counts; repeated rows each get
a row; other columns are ignored. Words and spaced runs of any length are decoded whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walkloom.llm.common import crc_mod, discard, materialize
from walkloom.llm.quality_classifier import isotonic

#: Labelled documents that terms are learned from, at most; the same ones are taken in every run.
LABELLED = 40_000
#: Terms that a task counts before it sends what it has.
HELD = 200_000
#: Standard errors by which a term's rate of toxic documents must exceed a half.
SURE = 1.64
#: Toxic documents that a term is in, at least.
LEAST = 3
BINS = 200

#: What a character may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t", "|": "li", "(": "c", "€": "e", "£": "l", "¡": "i"}
SEPARATORS = "._-*~'`"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
_INDEX = {c: k + 1 for k, c in enumerate(LETTERS)}  # 0: a word's ends; 27: any other letter
SIDE = 28

_WORD = re.compile(r"[^\W\d_]+")
_SPACED = re.compile(r"(?<!\S)\S(?:[ ._\-*]\S){2,}(?!\S)")
_OUTER = re.compile(r"^[\s.,;:?\"'()\[\]{}<>#%&*^~=_/\\-]+|[\s.,;:!?\"'()\[\]{}<>#%&*^~=_/\\|-]+$|[#*$%&|<>]{2,}$")
_DOUBT = re.compile(r"[0-9@$!+|(€£¡]|[._\-*~'`]|(.)\1\1")
_TWICE = re.compile(r"(.)\1+")


def count_characters(docs: DataFrame) -> np.ndarray:
    """Trigram counts of the words of all documents, by character class; a task sends its counts, not its words."""

    def run(batches):
        total, seen = np.zeros(SIDE**3), Counter()

        def flush():
            for w, n in seen.items():
                a = b = 0
                for c in (*(_INDEX.get(c, 27) for c in w), 0):
                    total[(a * SIDE + b) * SIDE + c] += n
                    a, b = b, c
            seen.clear()

        for batch in batches:
            for t in batch.column(0):
                seen.update(_WORD.findall((t.as_py() or "").lower()))
                if len(seen) > 200_000:
                    flush()
        flush()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.float64())], ["k", "n"])

    out = np.zeros(SIDE**3)
    for r in docs.select("text").mapInArrow(run, "k long, n double").groupBy("k").agg(F.sum("n").alias("n")).collect():  # SIDE ** 3 rows at most
        out[r["k"]] = r["n"]
    return out


class LanguageModel:
    """Interpolated trigrams of character classes, as logarithms."""

    def __init__(self, counts: np.ndarray):
        tri = counts.reshape(SIDE, SIDE, SIDE)
        bi, one = tri.sum(0), tri.sum((0, 1))
        p1 = (one + 1) / (one + 1).sum()
        p2 = (bi + 5 * p1) / (bi.sum(1, keepdims=True) + 5)
        p3 = (tri + 5 * p2[None]) / (tri.sum(2, keepdims=True) + 5)
        self.log = np.log(p3).tolist()


def arcs(c: str, before: str) -> list[tuple[str, float]]:
    """What the channel may have read to write c: the character, or none, and the log odds of writing c for it."""
    out = []
    if c in _INDEX:
        out.append((c, -0.05))
    elif c in LEET:
        out += [(x, -0.7) for x in LEET[c]] + [("", -10.0)]
    elif c in SEPARATORS:
        out.append(("", -0.1))
    elif c.isalpha():
        out.append((c, -0.05))
    else:
        out.append(("", -4.0))
    if c == before:
        out.append(("", -0.9))
    return out


def decode(word: str, lm: LanguageModel) -> str:
    """The likeliest word behind one as written."""
    # Texts are chains of (character, chain before it), so that a long word takes no copies.
    best: dict = {(0, 0): (0.0, None)}
    before = ""
    for c in word:
        step: dict = {}
        for (a, b), (score, text) in best.items():
            for x, channel in arcs(c, before):
                if x:
                    k = _INDEX.get(x, 27)
                    at, s = (b, k), score + channel + lm.log[a][b][k]
                else:
                    at, s = (a, b), score + channel
                if at not in step or s > step[at][0]:
                    step[at] = (s, (x, text) if x else text)
        best, before = step, c
    ends = [(s + lm.log[a][b][0], t) for (a, b), (s, t) in best.items()]
    top = max(s for s, _ in ends)
    return max(_unchained(t) for s, t in ends if s == top)


def _unchained(chain) -> str:
    out = []
    while chain:
        x, chain = chain
        out.append(x)
    return "".join(reversed(out))


def terms(word: str, lm: LanguageModel) -> list[str]:
    """Of a lower-cased word as written: the restored word, it without doubled letters, and its beginnings."""
    w = _OUTER.sub("", word)
    if not w:
        return []
    if _DOUBT.search(w):
        w = decode(w, lm)
    out = [w]
    if (x := _TWICE.sub(r"\1", w)) != w:
        out.append(x)
    return out + [f"{w[:k]}~" for k in (5, 7, 9) if len(w) >= k]


#: Letters of the parts of a spelled-out run that are learned from, beside the run as a whole.
PARTS = range(3, 17)


def spaced(run: str, lm: LanguageModel, sizes=PARTS) -> list[str]:
    """Of a run of single characters: what it restores to, and the parts of that of the sizes given, as terms."""
    w = decode(run.replace(" ", "_"), lm)
    return [w, *(w[a : a + n] for n in sizes for a in range(len(w) - n + 1))]


class Reader:
    """Terms of whole texts. Words are decoded once; what they give is kept."""

    def __init__(self, lm: LanguageModel, wanted: dict | None = None):
        self.lm, self.wanted, self.known = lm, wanted, {}
        # Where terms are wanted, parts of just their sizes are looked up, whatever these are.
        self.sizes = PARTS if wanted is None else sorted({len(x) for x in wanted if len(x) >= PARTS[0] and not x.endswith("~")})

    def of(self, word: str):
        if (got := self.known.get(word)) is None:
            if len(self.known) > 400_000:
                self.known.clear()
            got = terms(word, self.lm)
            if self.wanted is not None:
                got = [x for x in got if x in self.wanted]
            self.known[word] = got = tuple(got)
        return got

    def __call__(self, text: str) -> set[str]:
        text, out = text.lower(), set()
        for w in set(text.split()):
            out.update(self.of(w))
        for m in _SPACED.finditer(text):
            out.update(x for x in spaced(m[0], self.lm, self.sizes) if self.wanted is None or x in self.wanted)
        return out


def _count_terms(rows: DataFrame, lm: LanguageModel) -> DataFrame:
    """term, n0, n1: documents of rows (text, half) with it, by half."""

    def run(batches):
        seen, reader = (Counter(), Counter()), Reader(lm)

        def flush():
            every = list(seen[0].keys() | seen[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *(pa.array([c[t] for t in every], pa.int64()) for c in seen)], ["term", "n0", "n1"])
            for c in seen:
                c.clear()
            return out

        for batch in batches:
            for t, half in zip(batch.column(0), batch.column(1).to_pylist()):
                seen[half].update(reader(t.as_py() or ""))
                if len(seen[0]) + len(seen[1]) > HELD:
                    yield flush()
        yield flush()

    return rows.select("text", "half").mapInArrow(run, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _sums(rows: DataFrame, lm: LanguageModel, weights: list[dict], ddl: str) -> DataFrame:
    """A long of each text of rows (text, which, the long), and s: the summed weights of its terms, by the model that "which" numbers."""

    def run(batches):
        reader = Reader(lm, {t: None for w in weights for t in w})
        for b in batches:
            s = [math.fsum(sorted(weights[k].get(x, 0.0) for x in reader(t.as_py() or ""))) for t, k in zip(b.column(0), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(s, pa.float64())], [ddl, "s"])

    return rows.mapInArrow(run, f"{ddl} long, s double")


def lower_bound(a, n):
    """The lower bound of the rate that a of n show."""
    rate = a / n
    return (rate + SURE**2 / 2 / n - SURE * F.sqrt(rate * (1 - rate) / n + SURE**2 / 4 / n**2)) / (1 + SURE**2 / n)


def weigh(toxic: DataFrame, clean: DataFrame, base: float) -> list[dict]:
    """Weights of the terms whose rate of toxic documents is surely over a half: the log odds of its lower bound, over the base rate's.

    Three of them: by both halves, by the second and by the first. The terms are chosen before they are collected; as
    the labelled documents are bounded, so are these.
    """
    clean = clean.join(toxic.select("term"), "term", "left_semi").select("term", F.col("n0").alias("c0"), F.col("n1").alias("c1"))
    both = toxic.join(clean, "term", "left").na.fill(0, ["c0", "c1"])
    sides = (F.col("n0") + F.col("n1"), F.col("c0") + F.col("c1")), (F.col("n1"), F.col("c1")), (F.col("n0"), F.col("c0"))
    low = [F.when(a >= LEAST, lower_bound(a.cast("double"), (a + c).cast("double"))).alias(f"w{k}") for k, (a, c) in enumerate(sides)]
    found = both.select("term", *low).filter("w0 > 0.5 or w1 > 0.5 or w2 > 0.5").collect()
    odds = lambda x: math.log(x / (1 - x)) - math.log(base / (1 - base))
    return [dict(sorted((r["term"], odds(r[f"w{k}"])) for r in found if (r[f"w{k}"] or 0) > 0.5)) for k in range(3)]


def fit(docs: DataFrame, labels: DataFrame, lm: LanguageModel, bound: int = LABELLED):
    """Weights of terms, and a function from sums to scores. labels: doc_id, y.

    Scores are set by cross-fitting: each half's sums come from terms of the other half. The terms of all are the model.
    """
    y = labels.filter("y is not null and doc_id is not null").groupBy("doc_id").agg(F.max("y").cast("long").alias("y"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)  # a bounded sample, so it may be broadcast
    half = (F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 3) % 2).cast("int")
    known = materialize(docs.select("doc_id", "text").join(F.broadcast(y), "doc_id").withColumn("half", half), "labelled")
    counts = {(r["half"], r["y"]): r["count"] for r in known.groupBy("half", "y").count().collect()}
    of = lambda v, h: sum(n for (half, y), n in counts.items() if y == v and half in h)
    bad, good = of(1, (0, 1)), of(0, (0, 1))
    if not bad or not good:
        rate = bad / (bad + good) if bad + good else 0.0
        return {}, lambda s: np.full(len(s), rate)
    base = bad / (bad + good)
    toxic = materialize(_count_terms(known.filter("y = 1"), lm).filter(F.col("n0") + F.col("n1") >= LEAST), "terms")
    weights, *cross = weigh(toxic, _count_terms(known.filter("y = 0"), lm), base)
    discard(toxic)
    sums = _sums(known.select("text", "half", F.col("y").cast("long").alias("y")), lm, cross, "y")
    sums = sums.groupBy(F.least(F.floor(F.col("s") * 10), F.lit(BINS)).alias("k")).agg(F.count("*").alias("n"), F.sum("y").alias("y")).orderBy("k").collect()
    at = np.array([r["k"] for r in sums], dtype=float)
    rates = isotonic(np.array([r["n"] for r in sums], dtype=float), np.array([r["y"] for r in sums], dtype=float))
    discard(known)
    return weights, lambda s: np.interp(np.minimum(np.floor(s * 10), BINS), at, rates)


def scored(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document. Labels of the held-out fold are never read by the fit."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    lm = LanguageModel(count_characters(docs))
    weights, score = fit(docs, labels.filter(crc_mod(F.col("doc_id"), folds) != held).select("doc_id", F.col(label).alias("y")), lm)
    sums = _sums(docs.select("text", F.lit(0).alias("which"), "doc_id"), lm, [weights], "doc_id")

    @F.pandas_udf("double")
    def to_score(s):
        import pandas as pd

        return pd.Series(np.clip(score(s.to_numpy()), 0.0, 1.0))

    out = sums.select("doc_id", (crc_mod(F.col("doc_id"), folds) == held).alias("held_out"), to_score("s").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
