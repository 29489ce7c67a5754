"""Words that are spelled out letter by letter, of any length, alone or in longer runs; scores against a plain recomputation."""

import math

import numpy as np
import pytest

from walkloom.llm import toxicity as tx


@pytest.fixture(scope="module")
def lm():
    return tx.LanguageModel(np.ones(tx.SIDE**3))


@pytest.mark.parametrize("word", ["ass", "idiot", "a" + "bcd" * 5 + "e", "abcdefghijklmnopqrstuvwx"])
def test_sizes(lm, word):
    """Found among the terms that are wanted, also between other letters that are spelled out."""
    read = tx.Reader(lm, {word: 1.0, "other": 1.0})
    for run in (" ".join(word), " ".join("xy" + word + "zq"), ".".join(word), "-".join("qq" + word)):
        assert word in read(f"well {run} then") or word not in tx._SPACED.findall(run), run
    assert word in read(f"so {' '.join(word)} it is")


def test_learned_parts(lm):
    got = tx.spaced("a s s", lm)
    assert got.count("ass") >= 1
    long = tx.spaced(" ".join("abcdefghijklmnopqrst"), lm)
    assert "abcdefghijklmnopqrst" in long and "abc" in long and "efghijklmnopqrst" in long and "defghijklmnopqrst" not in long


def test_scores_are_sums(spark):
    """A document's sum is that of the weights of its distinct terms, read plainly; its score follows from the sum alone; extra columns and long ordinary texts are harmless."""
    rows = [(k, f"word{k % 7} {'you idiot' if k % 3 == 0 else 'fine day'} number{k}", "x", 0.5) for k in range(300)] + [(1000, "plain words " * 60_000, "x", 0.5), (1001, None, None, None), (1002, "", None, None), (1003, "i d i o t s", "x", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, predicted string, score double")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in tx.scored(docs, labels).collect()}
    lm = tx.LanguageModel(tx.count_characters(docs.select("doc_id", "text")))
    known = labels.filter(tx.crc_mod(tx.F.col("doc_id"), 3) != 1).select("doc_id", tx.F.col("toxic").alias("y"))
    weights, score = tx.fit(docs.select("doc_id", "text"), known, lm)
    assert weights and "idiot" in weights
    for d, text, *_ in rows:
        said = (text or "").lower()
        found = {t for w in set(said.split()) for t in tx.terms(w, lm)} | {t for m in tx._SPACED.finditer(said) for t in tx.spaced(m[0], lm, range(1, 40))}
        total = math.fsum(sorted(weights.get(t, 0.0) for t in found if t in weights))
        want = float(np.clip(score(np.array([total])), 0, 1)[0])
        assert abs(got[d]["score"] - want) < 1e-9, (d, total)
        assert got[d]["predicted"] == int(got[d]["score"] >= 0.7)
    assert all(got[k]["predicted"] == int(k % 3 == 0) for k in range(300)) and got[1000]["predicted"] == 0
