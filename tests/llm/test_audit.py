"""The filter audit against brute force."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest

from walkloom.llm import filter_audit as fa

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, labels):
    good, toxic = ({d for d, *x in labels if d is not None and x[k] == 1} for k in (0, 1))
    least = {}
    for d, _, t in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    rows = []
    for d, part, t in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > least[t]}
        rows.append((part or "", {f for f in fails if fails[f]}, d in good, d in toxic))
    out, total = {}, Counter()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                gone = [r for r in mine if f in r[1] and not r[1] & before]
                total[part, f] += len(gone)
                out[part, "".join(order), k + 1] = [sum(not r[1] & {*before, f} for r in mine), len(gone), sum(f in r[1] and bool(r[1] & before) for r in mine), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
    return {(*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(n)) for _ in range(n))
    texts = [text(rng.choice([3, 150, 199, 200, 260])) for _ in range(60)]
    texts += [x.upper() for x in texts[:10]] + [x + " #" for x in texts[5:20]] + [texts[3], "é" * 30, "", None, "A \x0b a\x1fb \x85 c", " ".join("ab" for _ in range(400)), "x " * 40_000]
    docs = [(k, rng.choice(["en", "de", "", None]), t) for k, t in enumerate(texts)]
    docs += [(1000 + k, rng.choice(["en", "fr"]), texts[k % 7]) for k in range(300)] + [docs[3], docs[3], (None, "en", texts[0]), (None, None, "only here"), (-5, "de", texts[1])]
    rng.shuffle(docs)
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 1200, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1)]
    return docs, labels


def frames(spark, docs, labels):
    more = "doc_id long, lang string, text string, mask string, part string, copies string, good string"
    return spark.createDataFrame([(*d, "m", "p", "c", "g") for d in docs], more).repartition(6), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_audit(spark, tables):
    docs, labels = tables
    got = fa.audit(*frames(spark, docs, labels)).collect()
    assert len(got) == 600 * len({p or "" for _, p, _ in docs}) and {tuple(r) for r in got} == brute(docs, labels)
    assert fa.audit(*frames(spark, [], [])).count() == 0


def test_non_minimum(spark, tables):
    docs, labels = tables
    first = {}
    for d, _, t in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    got = Counter(r[0] for r in fa.non_minimum(frames(spark, docs, labels)[0]).collect())
    assert got == Counter(d for d, _, t in docs if d is not None and d > first[t or ""])


def test_one_fingerprint(tables, monkeypatch):
    """Texts that share a fingerprint are told apart by their chains."""
    docs, _ = tables
    plain = sorted(map(repr, fa._meet(list(fa._send(docs)))))
    monkeypatch.setattr(fa.xxhash, "xxh64_intdigest", lambda _: 7)
    halves = [*fa._send(docs[:150]), *fa._send(docs[150:])]
    merged = Counter()
    for d, p, m, n in fa._meet(halves):
        merged[d, p, m] += n
    want = Counter()
    for r in plain:
        d, p, m, n = eval(r)
        want[d, p, m] += n
    assert merged == want


def test_copies_send_one_record_a_partition():
    """Of a group of copies, a partition sends one text, whatever their number."""
    sent = list(fa._send([(k, "en", "same text") for k in range(5000)]))
    assert sum(isinstance(r[0], bytes) for _, r in sent) == 1 and len(sent) == 5000
