"""Edge cases of each operator, against brute force."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from walkloom.llm import ann_forest, byte_bpe, chat_format, jaccard_join, mixing, quality_classifier, quality_rules, sharding, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, kept string"
WORDS = "the of and is to in that it was for on are as with his they at be this from".split()
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))
    texts = [text(rng.randint(60, 200)) for _ in range(60)]
    for k in range(12):  # near copies and copies
        w = texts[k].split()
        w[rng.randrange(len(w))] = "changed"
        texts += [" ".join(w), texts[k]]
    texts += [None, "", "   \n\t", "one", "two words", "a b é\U0001f600 c", "x " * 400, text(9000), "\n".join(["same line here"] * 9)]
    rows = [(k, t, "en", None if k % 7 == 0 else f"s{k % 3}", 0, 5, 1, "z") for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id at all", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).cache()


def plain(df):
    return [tuple(r) for r in df.collect()]


def test_rules(spark, docs):
    for r in quality_rules.apply_policy(quality_rules.ledger(docs)).collect():
        w = BLANK.findall(r["text"] or "")
        tri = Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (r["text"] or "").split("\n") if BLANK.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    kept = quality_rules.keep_passing(docs)
    assert kept.columns == docs.columns and kept.count() > 50
    a = {(r["policy"], r["rule"]): r for r in quality_rules.ablations(quality_rules.ledger(docs)).collect()}
    assert a["v3", "symbols"]["kept"] == kept.count() <= a["v3", "few_words"]["kept_without"]
    assert quality_rules.keep_passing(docs.limit(0)).count() == 0


def test_chat(spark):
    hard = "</s>[INST] <|im_end|>\n<|im_start|>user\n&lt; & [x"
    rows = [(1, 0, "user", hard), (1, 1, "assistant", hard), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, "system", "end"), (2, 0, "user", "alone"), (None, None, None, None), (3, 1, "assistant", "b"), (3, 0, "us\ner<", "a"), (3, 0, "us\ner<", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    ex = chat_format.expand(chat_format.format_conversations(df))
    assert ex.filter("target is not null").count() == 3
    got = {r["conv_id"]: r for r in chat_format.read_back(ex).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c), key=lambda x: (x[0] or 0, x[1], x[2]))
        assert [tuple(t) for t in got[c]["turns"]] == [t[1:] for t in turns]
        assert got[c]["losses"] == [t[2] for t in turns if t[1] == "assistant"]
    assert chat_format.read_back(chat_format.expand(chat_format.format_conversations(df.limit(0)))).count() == 0


def test_sharding(spark, docs):
    rows = docs.withColumn("size", F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 8)
    out = sharding.shard_by_bytes(rows, 5).collect()
    assert len(out) == docs.count()
    order = sorted(out, key=lambda r: (r["shard"], r["slot"]))
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in order]
    assert ids == sorted(ids)
    sums = Counter()
    for k in range(5):
        own = [r for r in order if r["shard"] == k]
        assert [r["slot"] for r in own] == list(range(len(own)))
        sums[k] = sum(r["size"] for r in own)
    total = sum(sums.values())
    assert all(abs(s - total / 5) <= max(r["size"] for r in out) for s in sums.values())
    assert sharding.shard_by_bytes(rows.limit(0), 5).count() == 0


@pytest.mark.parametrize("chunk,overlap", [(32768, 512), (200, 60), (64, 16)])
def test_bpe(spark, docs, chunk, overlap):
    enc = byte_bpe.encoder(byte_bpe.vocabulary_path())
    more = spark.createDataFrame([(900, "word \n  \n  x" * 50), (901, "a" * 700), (902, "don't we'll " * 40 + " " * 90 + "end"), (903, "é中\U0001f600 " * 60)], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(more)
    ids = byte_bpe.encode(both, chunk=chunk, overlap=overlap)
    want = Counter((r[0], tuple(enc.encode_ordinary(r[1] or ""))) for r in both.collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in ids.collect()) == want
    assert Counter((r[0], bytes(r[1])) for r in byte_bpe.decode(ids).collect()) == Counter((r[0], (r[1] or "").encode()) for r in both.collect())
    assert byte_bpe.digests(byte_bpe.encode(both.limit(0))).count() == 0


def test_warc(spark):
    rows = [(1, "http://a/1 x\r\n", "same"), (5, None, "same"), (3, "u", "same"), (7, "u", None), (8, "u", ""), (None, "u", "other"), (9, "u", "x" * 50_000), (9, "u", "x" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = warc.write(warc.plan_records(pages), 400).cache()
    got = warc.read(archives, True).collect()
    assert all(r["kind"] == "record" for r in got) and len(got) == len(rows)
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got)
    assert kinds == sorted([("1", "revisit", 5, 4), ("5", "response", None, 4), ("3", "revisit", 5, 4), ("7", "revisit", 8, 0), ("8", "response", None, 0), ("None", "response", None, 5), ("9", "response", None, 50_000), ("9", "revisit", 9, 50_000)])
    assert all(r["payload_digest"] == base64.b32encode(hashlib.sha1(bytes(r["payload"])).digest()).decode() for r in got if r["record_type"] == "response")
    big = warc.plan_records(pages, 10_000).groupBy("record_type").count().collect()
    assert dict(map(tuple, big)) == {"response": 7, "revisit": 1}
    # Damage: one record's bytes change, junk lies between two, the end is cut off.
    recs = [warc.record(k, "u", f"text {k}".encode(), warc.digest(f"text {k}".encode()), "response", None) for k in range(5)]
    hurt = bytearray(recs[1])
    hurt[len(hurt) // 2] ^= 255
    content = recs[0] + bytes(hurt) + recs[2] + b"\x1f\x8bjunk WARC/1.1 no" + recs[3] + recs[4][:-9]
    out = list(warc.salvage(content))
    assert [x[2]["warc-record-id"] for x in out if x[0] == "record"] == ["<urn:page:0>", "<urn:page:2>", "<urn:page:3>", "<urn:page:4>"]  # the last lost its checksum only; its digest is right
    gaps = [(x[1], x[2]) for x in out if x[0] == "gap"]
    assert gaps[0] == (len(recs[0]), len(recs[0]) + len(hurt)) and gaps[-1][1] == len(content) and len(gaps) == 3
    assert list(warc.salvage(b"")) == [] and list(warc.salvage(b"junk")) == [("gap", 0, 4)]


@pytest.mark.parametrize("kind", ["gzip", "plain"])
def test_salvage_within(kind):
    """Records in one member, or uncompressed: a damaged one in the middle is set aside, its neighbours are read."""
    import gzip

    recs = [warc.record(k, "u", f"text {k} ".encode() * 9, warc.digest(f"text {k} ".encode() * 9), "response", None) for k in range(3)]
    raws = [gzip.decompress(r) for r in recs]
    for hurt in (raws[1].replace(b"text 1", b"tixt 1", 1), raws[1].replace(b"Content-Length: 63", b"Content-Length: 9999"), raws[1][:-40], b"WARC/1.1\r\n junk " * 20):
        raw = raws[0] + hurt + raws[2]
        out = list(warc.salvage(gzip.compress(raw) if kind == "gzip" else raw))
        assert [x[2]["warc-record-id"] for x in out if x[0] == "record"] == ["<urn:page:0>", "<urn:page:2>"]
        gap = [x for x in out if x[0] == "gap"]
        assert len(gap) == 1
        assert gap[0][3:] == (len(raws[0]), len(raws[0]) + len(hurt)) if kind == "gzip" else gap[0][1:3] == (len(raws[0]), len(raws[0]) + len(hurt))


def test_salvage_damaged_members():
    """Truncated members and members with a wrong checksum give the records that are whole; what follows is read; junk takes time in proportion."""
    import gzip
    import time

    rng = random.Random(8)
    text = lambda k: bytes(rng.randrange(32, 127) for _ in range(3000)) + str(k).encode()
    bodies = [text(k) for k in range(4)]
    recs = [warc.record(k, "u", b, warc.digest(b), "response", None) for k, b in enumerate(bodies)]
    whole = gzip.compress(b"".join(gzip.decompress(r) for r in recs[:3]))
    ids = lambda content: [x[2]["warc-record-id"][10:-1] for x in warc.salvage(content) if x[0] == "record"]
    assert ids(whole[: len(whole) * 5 // 6]) == ["0", "1"] and [x[0] for x in warc.salvage(whole[: len(whole) * 5 // 6])][-1] == "gap"
    wrong = whole[:-8] + b"\0\0\0\0" + whole[-4:]  # the checksum only
    assert ids(wrong + recs[3]) == ["0", "1", "2", "3"]
    assert ids(whole[: len(whole) // 2] + recs[3])[-1] == "3"
    began = time.time()
    assert ids((b"\x1f\x8b\x08junk WARC/1.1 no" * 200_000) + recs[3]) == ["3"] and time.time() - began < 60
    big = warc.record(9, "u", b"x" * 30_000_000, warc.digest(b"x" * 30_000_000), "response", None)
    assert ids(recs[0] + big + recs[1]) == ["0", "9", "1"]


def test_warc_after_shuffle(spark, tmp_path):
    """Rows that come from a shuffle, extra and clashing columns, an empty table, and archives read back from files."""
    rows = [(k % 3, "u", f"p{k % 2}", "x", k) for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string, row int").repartition(7)
    archives = warc.write(warc.plan_records(pages))
    warc.export(archives, f"{tmp_path}/a")
    for a in (archives, warc.files(spark, f"{tmp_path}/a")):
        got = warc.read(a).collect()
        assert len(got) == 40 and Counter(r["record_type"] for r in got) == {"response": 2, "revisit": 38} and {r["refers_to"] for r in got} == {None, 2}
    assert warc.read(warc.write(warc.plan_records(pages.limit(0)))).count() == 0


def test_mixing(spark, docs):
    out = mixing.mixed(docs).collect()
    by = {r["source"]: r for r in out}
    sizes = Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(BLANK.findall(r["text"] or ""))
    total, weights, target = sum(sizes.values()), {}, {}
    for k, s in enumerate(sorted(sizes, key=lambda x: (x is None, x or ""))):
        weights[s] = k % 3 + 1
    free, left = set(sizes), total
    while True:
        over = [s for s in free if left * weights[s] / sum(weights[x] for x in free) > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * sizes[s]
            free.discard(s)
        left = total - sum(target.values())
    target |= {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
    for s, r in by.items():
        assert r["source_size"] == sizes[s] and abs(r["target"] - target[s]) < 1e-6
    for r in out:
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert r["copies"] in (int(rate), int(rate) + 1) and r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
    mix = mixing.emit(docs)
    assert mix.columns == docs.columns and mix.count() == sum(r["copies"] for r in out)
    assert mixing.emit(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n,p", [(3, 90), (5, 80), (2, 60)])
def test_jaccard(spark, docs, n, p):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None]
    sets = []
    for _, t in rows:
        w = BLANK.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= p * (len(sets[i]) + len(sets[j]) - shared):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    want = Counter((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))
    found = jaccard_join.linked(docs.filter("doc_id is not null").select("doc_id", "text"), n, p)
    assert Counter(plain(found.select("doc_id", "n_shingles", "component_id"))) == want


@pytest.mark.parametrize("led_nodes,rounds", [(2048, 8), (5, 1)])
def test_jaccard_families(spark, monkeypatch, led_nodes, rounds):
    """Copies of copies, more than a centre reaches, with the hot path on, with keys of very many nodes, and with buckets in blocks."""
    monkeypatch.setattr(jaccard_join, "HOT_PAIRS", 4)
    monkeypatch.setattr(jaccard_join, "LED_NODES", led_nodes)
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard_join, "SIDE", 3)
    monkeypatch.setattr(jaccard_join, "PER_CENTRE", 4)
    monkeypatch.setattr(jaccard_join, "COPIES", 2)
    rng = random.Random(5)
    base, rows = [f"w{k}" for k in range(150)], []
    for f in range(4):
        parent = [w if rng.random() > 0.06 else f"f{f}{k}" for k, w in enumerate(base)]
        for c in range(12):
            rows.append((len(rows), " ".join(w if rng.random() > 0.004 * (c % 5) else f"x{f}{c}{k}" for k, w in enumerate(parent))))
    sets = [{tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                shared = len(sets[i] & sets[j])
                if 100 * shared >= 90 * (len(sets[i]) + len(sets[j]) - shared):
                    label[i] = label[j] = min(label[i], label[j])
        if label == (label := list(label)):
            pass
    found = jaccard_join.linked(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)
    assert dict(plain(found.select("doc_id", "component_id"))) == dict(enumerate(label))


def test_jaccard_null_ids(spark):
    """Near copies whose ids are null link like others; a component's id is the least that it has."""
    near = [" ".join(f"w{j}" if j != k else "x" for j in range(60)) for k in (58, 59, 60)]
    rows = [(None, near[0]), (None, near[1]), (4, near[2]), (None, "alone " * 9), (None, None), (6, "")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, node string")
    got = Counter(plain(jaccard_join.linked(docs, 5, 80).select("doc_id", "component_id")))
    assert got == Counter([(None, 4), (None, 4), (4, 4), (None, None), (None, None), (6, 6)])
    assert jaccard_join.linked(docs.limit(0)).count() == 0 and jaccard_join.keep_one(docs.limit(0)).count() == 0


def test_forest_blocks(spark, monkeypatch):
    """Several blocks of rows and parts of queries, fewer candidates than are asked for, ties, and clashing columns."""
    monkeypatch.setattr(ann_forest, "BLOCK", 300)
    monkeypatch.setattr(ann_forest, "QUERIES", 20)
    v = np.random.default_rng(4).normal(size=(1500, 24))
    v[200:900] = v[3] + v[200:900] * 1e-3  # a hot cluster
    df = spark.createDataFrame([(k, [float(x) for x in y], 1, 0.5) for k, y in enumerate(v)], "vec_id long, embedding array<double>, row int, score double")
    out = {}
    for r in ann_forest.search(df, df.filter("vec_id % 20 = 0")).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    for q in range(0, 1500, 20):
        s = v @ v[q]
        s[q] = -np.inf
        got = sorted(out[q])
        assert [g[0] for g in got] == list(range(1, 21)) and all(abs(s[i] - x) < 1e-9 for _, i, x in got)
        hit += len({i for _, i, _ in got} & set(np.argsort(-s)[:20].tolist()))
    assert hit / 1500 >= 0.9
    few = spark.createDataFrame([(k, [1.0, float(k % 2)]) for k in (0, 1, 2, 3, 3)], "vec_id long, embedding array<double>")
    assert [(r["rank"], r["vec_id"], r["score"]) for r in ann_forest.search(few, few.filter("vec_id = 0")).orderBy("rank").collect()] == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0), (4, 3, 1.0)]


def test_forest(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(700, 16))
    rows = [(k, [float(x) for x in y]) for k, y in enumerate(v)] + [(700, None), (720, [0.0] * 16), (740, [float("nan")] * 16), (760, [None] + [1.0] * 15), (780, [])] + [(800 + k, [float(x) for x in v[20]]) for k in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = ann_forest.search(df, df.filter("vec_id % 20 = 0")).collect()
    good = {r[0]: np.float32(r[1]).astype(float) for r in rows if r[1] and None not in r[1] and np.isfinite(np.float64(r[1])).all() and any(r[1])}
    hit = total = 0
    for q in (i for i in good if i % 20 == 0):
        want = sorted(((-float(good[i] @ good[q]), i) for i in good if i != q))[:20]
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        assert [g[0] for g in got] == list(range(1, 21)) and all(abs(good[i] @ good[q] - s) < 1e-9 for _, i, s in got)
        hit, total = hit + len({i for _, i in want} & {g[1] for g in got}), total + 20
    assert hit / total >= 0.9
    assert ann_forest.search(df.limit(0), df.limit(0)).count() == 0


def test_classifiers(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for k in range(400):
        bad = k % 5 == 0
        w = [rng.choice(WORDS) + rng.choice("abcdef") for _ in range(80)]
        toxic = k % 4 == 1
        if toxic:
            for _ in range(5):
                w[rng.randrange(80)] = rng.choice(["stupid", "st.u.p.i.d", "$tup1d", "stuuuupid", "moron", "m0ron"])
        rows.append((k, " ".join(x + ("$$$" if bad else "") for x in w) if bad and not toxic else " ".join(w)))
        labels.append((k, int(not bad or toxic), int(toxic)))
    docs = spark.createDataFrame(rows + [(1000, None), (1001, ""), (None, "x"), rows[0]], "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(5000, 1, 1), (1000, None, None)], "doc_id long, quality int, toxic int")
    q = {r["doc_id"]: r for r in quality_classifier.scored(docs, lab).collect()}
    t = {r["doc_id"]: r for r in toxicity.scored(docs, lab).collect()}
    assert set(q) == set(t) == {None, 1000, 1001, *range(400)}
    assert sum(q[k]["predicted"] == y for k, y, _ in labels) >= 390 and sum(t[k]["predicted"] == y for k, _, y in labels) >= 390
    assert all(0 <= r["score"] <= 1 for x in (q, t) for r in x.values())
    for f in (quality_classifier.scored, toxicity.scored):
        assert f(docs, lab.limit(0)).count() == 404 and f(docs.limit(0), lab).count() == 0
    assert quality_classifier.keep_good(docs, lab).columns == docs.columns


def test_isotonic():
    assert list(quality_classifier.isotonic(np.array([1.0, 1, 2]), np.array([1.0, 0, 2]))) == [0.5, 0.5, 1.0]


def test_restoring():
    counts = np.zeros(toxicity.SIDE**3)
    for w in ["stupid", "moron", "idiot", "loser", "the", "and"] * 20:
        a = b = 0
        for c in (*(toxicity._INDEX[x] for x in w), 0):
            counts[(a * toxicity.SIDE + b) * toxicity.SIDE + c] += 1
            a, b = b, c
    lm = toxicity.LanguageModel(counts)
    for seen, word in (("$tup1d", "stupid"), ("m0r0n", "moron"), ("l.o.s.e.r", "loser"), ("stuuuupid", "stupid"), ("1d10t", "idiot")):
        assert toxicity.terms(seen, lm)[0] == word
    assert "stupid" in toxicity.spaced("s t u p i d", lm) and toxicity.terms("...", lm) == []


def test_restoring_long_runs_and_words():
    counts = np.zeros(toxicity.SIDE**3)
    for w in ["stupid", "moron", "idiot", "loser", "the", "and"] * 20:
        a = b = 0
        for c in (*(toxicity._INDEX[x] for x in w), 0):
            counts[(a * toxicity.SIDE + b) * toxicity.SIDE + c] += 1
            a, b = b, c
    lm = toxicity.LanguageModel(counts)
    assert "stupid" in toxicity.spaced(" ".join("theand" * 80 + "stupid"), lm)
    assert toxicity.terms("i" * 40 + "d" * 40 + "iot", lm)[0] == "idiot"
    assert toxicity.terms(".".join("stupid" * 12), lm)[0].startswith("stupid") and len(toxicity.decode("a1" * 20_000, lm)) > 0


@pytest.mark.parametrize("p,moves", [(80, 30), (90, 6), (80, 120)])
def test_jaccard_leaders(p, moves):
    """Every similar pair of a key's nodes meets at a leader, and families make few pairs."""
    rng = np.random.default_rng(5)
    base = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (150, 160, 400)]
    sets = []
    for b in base:
        for _ in range(40):
            h = b.copy()
            at = rng.choice(len(h), rng.integers(0, min(moves, len(h))), replace=False)
            h[at] = rng.integers(0, 2**63, len(at)).astype(np.uint64)
            sets.append(np.unique(h))
    got = jaccard_join.led([len(h) for h in sets], [jaccard_join.sketch(h) for h in sets], p)
    at = {}
    for c, y in got:
        at.setdefault(c, {c}).add(y)
    for i in range(len(sets)):
        for j in range(i):
            same = len(np.intersect1d(sets[i], sets[j]))
            if 100 * same >= p * (len(sets[i]) + len(sets[j]) - same):
                assert any(i in g and j in g for g in at.values())
    assert len(got) < len(sets) ** 2 / 4


def test_jaccard_sketch():
    """Sketches differ in no more bits than their sets do in members, whatever their sizes."""
    rng = np.random.default_rng(6)
    for n in (1, 2, 63, 64, 65, 300):
        for m in (1, 40, 500):
            a, b = (np.unique(rng.integers(0, 700, k).astype(np.uint64)) for k in (n, m))
            x = jaccard_join.folded([jaccard_join.sketch(a), jaccard_join.sketch(b)])
            assert np.bitwise_count(x[0] ^ x[1]).sum() <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("p", [80, 90])
@pytest.mark.parametrize("count", [1, 20_000, 10_000_000])
def test_jaccard_keys(p, count):
    """Any pair at the bound shares as many keys as either needs, however many documents the plan is for; far sets share few."""
    rng = np.random.default_rng(7)
    for size in (3, 30, 90, 300, 900, 3000):
        for longer in (0, 1):
            a = rng.integers(0, 2**63, size).astype(np.uint64)
            for _ in range(10):
                # b holds what a does but for some, and others; the pair is as far apart as it may be.
                lost = int(rng.integers(0, (size * (100 - p) // 100 // (1 + longer)) + 1))
                more = max(0, (size - lost) * 100 // p - size)
                b = np.concatenate([a[lost:], rng.integers(0, 2**63, more).astype(np.uint64)])
                shared = size - lost
                assert 100 * shared >= p * (len(a) + len(b) - shared)
                k, j = jaccard_join.band_of(len(a), p)[0], jaccard_join.band_of(len(b), p)[0]
                band = min(k, j)
                assert max(k, j) - band <= 1
                plan = jaccard_join.allocate(band, p, count)
                (x, need_x), (y, need_y) = jaccard_join.keys(np.unique(a), band, plan), jaccard_join.keys(np.unique(b), band, plan)
                if plan[0] == 0:
                    assert np.array_equal(np.unique(a), np.unique(b))  # only copies link
                else:
                    assert len(np.intersect1d(x, y)) >= max(need_x, need_y)


def test_jaccard_allocation():
    """In bands of many words, keys a document don't leap as documents grow in number."""
    for k in range(20, 38):
        few, many = ((m + r * jaccard_join.limits(k, 80)[0] / m) for m, r, _ in (jaccard_join.allocate(k, 80, c) for c in (2_000, 200_000)))
        assert many <= 2 * few


def test_keep_one(spark):
    """Repeated rows, an id with several texts, and rows without an id, also as bridges."""
    w = lambda t, *changed: " ".join(f"{t}{k}" if k not in changed else f"{t}x{k}" for k in range(100))
    a = w("a")
    rows = [(5, a), (5, a), (7, a), (None, a)]  # copies of one id, of another and of none
    rows += [(5, w("b")), (4, w("b", 99))]  # 5 is the least id of a's group, but here isn't the least
    rows += [(None, w("c")), (None, w("c")), (None, w("d"))]  # groups without any id
    rows += [(20, w("e")), (None, w("e", 99)), (21, w("e", 99, 0))]  # 20 and 21 are similar to what is between
    rows += [(30, w("f")), (30, w("g"))]  # one id, two groups
    rows += [(None, None), (None, " "), (9, ""), (9, "")]
    docs = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, size long")
    got = jaccard_join.keep_one(docs, 2, 97)
    assert got.columns == docs.columns
    kept = Counter((r["doc_id"], r["text"]) for r in got.collect())
    assert kept == Counter([(5, a), (4, w("b", 99)), (None, w("c")), (None, w("d")), (20, w("e")), (30, w("f")), (30, w("g")), (None, None), (None, " "), (9, ""), (9, "")])
    ids = {r["text"]: r["component_id"] for r in docs.join(jaccard_join.linked(docs, 2, 97).select("doc_id", "component_id"), "doc_id").collect() if r["doc_id"] == 21}
    assert ids == {w("e", 99, 0): 20}
