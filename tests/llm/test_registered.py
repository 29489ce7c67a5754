"""Registered queries on a small folder against plain recomputations, with their own constants."""

import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from walkloom.llm import quality_classifier as qc
from walkloom.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, path = random.Random(21), tmp_path_factory.mktemp("registered")
    word = lambda: "".join(rng.choice("bcdfglmn") + rng.choice("aeiou") for _ in range(rng.randint(1, 3)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(10)) + "." for _ in range(n // 10))
    texts = [text(rng.randint(60, 200)) for _ in range(90)]
    texts += ["%% ## " * rng.randint(20, 60) + str(rng.random()) for _ in range(40)] + ["7 " * rng.randint(30, 90) for _ in range(20)]
    for k in range(12):  # near copies by one word of many, copies but for case, and one that shares half
        w = texts[k].split(" ")
        w[len(w) // 2] = "changed"
        texts += [" ".join(w), texts[k].upper(), texts[k][: len(texts[k]) // 2]]
    texts += [None, "", "  \n", "one", "ONE", "two words", "long words here " * 20_000]
    docs = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)] + [(3, texts[3], "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(k, int(k < 90 or k >= 150), 0) for k in range(0, len(texts), 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    pages = [(1, "http://a/1", "same"), (5, None, "same"), (3, "u", "same"), (7, "u", None), (8, "u", ""), (9, "u", "é" * 5000), (9, "u", "é" * 5000)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path), docs, labels, pages


def test_op8(spark, folder):
    """Three-word shingles, 90 of 100: each row's set size and the least id that links lead to."""
    path, docs, *_ = folder
    sets = []
    for _, t, *_ in docs:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set())
    label = list(range(len(docs)))
    least = [d[0] for d in docs]
    for _ in range(4):
        for i in range(len(docs)):
            for j in range(i):
                shared = len(sets[i] & sets[j])
                if shared and 100 * shared >= 90 * (len(sets[i]) + len(sets[j]) - shared):
                    least[i] = least[j] = min(least[i], least[j])
    assert len(label) == len(docs)
    got = sorted(tuple(r) for r in queries.op8_jaccard_join(spark, path).select("doc_id", "n_shingles", "component_id").collect())
    assert got == sorted((d[0], len(s), m) for d, s, m in zip(docs, sets, least)) and len({m for m in least}) < len(docs) - 20


def test_op9(spark, folder):
    path, *_, pages = folder
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    top, seen, want = {}, set(), []
    for p, _, h in pages:
        top[h or ""] = max(p, top.get(h or "", p))
    for p, _, h in pages:
        h = h or ""
        own = p == top[h] and h not in seen
        seen |= {h} if own else set()
        want.append((p, len(h.encode()), sha(h), "response" if own else "revisit", None if own else top[h]))
    got = [tuple(r) for r in queries.op9_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def plain_isotonic(pairs):
    """Nearest rising rates of (place, n, sum): the greatest lower, over starts, of the least mean, over ends."""
    mean = lambda a, b: sum(p[2] for p in pairs[a : b + 1]) / sum(p[1] for p in pairs[a : b + 1])
    return [max(min(mean(a, b) for b in range(k, len(pairs))) for a in range(k + 1)) for k in range(len(pairs))]


def test_op6(spark, folder):
    """Scores from the statistics by plain ridge regression, with rates of the other half's scores."""
    path, docs, labels, _ = folder
    crc = lambda k: zlib.crc32(str(k).encode())
    x = {i: np.array(qc.statistics(d[1] or ""), np.float32).astype(float) for i, d in enumerate(docs)}
    every = np.array([x[i] for i in range(len(docs))])
    phi = qc.Map(every.mean(0), every.std(0))
    y = dict((k, q) for k, q, _ in labels if crc(k) % 5 != 0)
    rows = [(x[i], y[d[0]], crc(d[0]) // 5 % 2) for i, d in enumerate(docs) if d[0] in y]
    z, t, half = phi(np.array([r[0] for r in rows])), np.array([float(r[1]) for r in rows]), np.array([r[2] for r in rows])
    solve = lambda on: np.linalg.solve(z[on].T @ z[on] + qc.RIDGE * np.eye(z.shape[1]), z[on].T @ t[on])
    cross = np.where(half == 0, z @ solve(half == 1), z @ solve(half == 0))
    bins = {}
    for s, v in zip(np.clip((cross + 0.5) / 2 * qc.BINS, 0, qc.BINS - 1).astype(int).tolist(), t.tolist()):
        n, total = bins.get(s, (0, 0.0))
        bins[s] = (n + 1, total + v)
    table = sorted((k, n, v) for k, (n, v) in bins.items())
    raw = phi(every) @ solve(np.ones(len(t), bool))
    want = np.clip(np.interp(raw, [(k + 0.5) / qc.BINS * 2 - 0.5 for k, *_ in table], plain_isotonic(table)), 0, 1)
    got = {}
    for r in queries.op6_quality_classifier(spark, path).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for d, w in zip(docs, want):
        assert all(math.isclose(r["score"], w, abs_tol=2e-3) and r["held_out"] == (crc(d[0]) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in got[d[0]])
    assert sum(len(v) for v in got.values()) == len(docs)


def test_op12(spark, folder):
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in queries.op12_html_extract(spark, folder[0]).collect()}
    assert got == {1: ("same", 4), 5: ("same", 4), 3: ("same", 4), 7: ("", 0), 8: ("", 0), 9: ("é" * 5000, 5000)}
