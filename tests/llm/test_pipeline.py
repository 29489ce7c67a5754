"""The pipeline's stages and the registered queries against brute force, on small tables of their own."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from test_operators import BLANK, WORDS

import corpus_pipeline
from walkloom.llm import byte_bpe, chat_format, mixing, quality_classifier, quality_rules, queries, sharding, toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents and labels: clean texts, near copies and copies, junk, nulls, repeated rows, and columns named as what is made."""
    rng, path = random.Random(11), tmp_path_factory.mktemp("sf")
    text = lambda n: "\n".join(" ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(12)) for _ in range(n // 12))
    texts = [text(rng.randint(70, 250)) for _ in range(120)]
    for k in range(20):
        w = texts[k].split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts += [" ".join(w), texts[k]]
    texts += ["### $$$ " * 40, "A B " * 60, None, "", "short text", "\n".join(["same line here now"] * 20)]
    rows = [(k, t, "en", None if k % 9 == 0 else f"s{k % 3}", len(t or ""), k, "x", 1.5) for k, t in enumerate(texts)]
    rows += [rows[3], (None, texts[50], None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _w long, _source string, failed_bits double")
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(k, int(k < len(texts) - 6), 0) for k in range(len(texts))] + [(5, 0, 0), (99_999, 1, 0), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(c, t, ("system", "user", "assistant")[t % 3], f"text {c} {t} <&[") for c in range(6) for t in range(c)] + [(9, 0, "assistant", "x" * 50_000), (9, 1, "assistant", None)], "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path)


def plain(df, *columns):
    return Counter(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def rule_bits(text):
    w = BLANK.findall(text or "")
    tri = Counter(zip(w, w[1:], w[2:]))
    covered = len({k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)})
    lines = [x for x in (text or "").split("\n") if BLANK.search(x)]
    chars, n, dup = sum(map(len, w)), len(w), len(lines) - len(set(lines))
    symbols, caps = sum(c in "#*$%&|<>" for c in text or ""), sum("A" <= c <= "Z" for c in text or "")
    checks = [n < 50, 100 * covered > 50 * n, 100 * symbols > 25 * n, len(lines) >= 4 and 100 * dup > 40 * len(lines), chars < 3 * n, chars > 12 * n, 100 * caps > 40 * chars]
    return sum(1 << k for k, x in enumerate(checks) if x), symbols, caps


def test_stages(spark, folder):
    """Each stage on what the one before it kept."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "quality_classifier", "jaccard_join", "mixing", "byte_bpe"]
    kept = stages["quality_rules"](spark, docs, folder).cache()
    assert kept.columns == docs.columns and plain(kept) == Counter({r: n for r, n in plain(docs).items() if not rule_bits(r[1])[0]})
    good = stages["quality_classifier"](spark, kept, folder).cache()
    scores = plain(quality_classifier.scored(kept, spark.read.parquet(f"{folder}/labels.parquet")), "doc_id", "predicted")
    ids = {d for d, p in scores if p}
    assert good.columns == docs.columns and plain(good) == Counter({r: n for r, n in plain(kept).items() if r[0] in ids}) and good.count() > 100
    one = stages["jaccard_join"](spark, good, folder).cache()
    rows = sorted(plain(good).elements(), key=lambda r: (r[0] is None, r[0] or 0))
    shingles = []
    for r in rows:
        w = BLANK.findall(r[1].translate({c: c + 32 for c in range(65, 91)}))
        shingles.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(shingles[i] & shingles[j])
            if 100 * both >= 80 * (len(shingles[i]) + len(shingles[j]) - both) and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    assert one.columns == docs.columns and plain(one) == Counter(rows[k] for k in sorted(set(group)))
    mix = stages["mixing"](spark, one, folder).cache()
    copies = plain(mixing.mixed(one.select("doc_id", "source", "text")), "doc_id", "text", "copies")
    assert mix.columns == docs.columns and plain(mix, "doc_id", "text") == Counter({(d, t): c * n for (d, t, c), n in copies.items() if c})
    enc = byte_bpe.encoder(byte_bpe.vocabulary_path())
    want = Counter()
    for (d, t), n in plain(mix, "doc_id", "text").items():
        e = enc.encode_ordinary(t)
        want[d, len(e), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += n
    assert plain(stages["byte_bpe"](spark, mix, folder)) == want == plain(corpus_pipeline.run(spark, folder))


def test_stages_of_nothing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name


def test_queries(spark, folder):
    """The registered queries, with their own constants."""
    docs = plain(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id", "text")
    got = {(r["doc_id"], r["failed_bits"]) for r in queries.op3_quality_rules(spark, folder).collect()}
    assert got == {(d, rule_bits(t)[0]) for d, t in docs}
    out = queries.op4_sharding(spark, folder).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter({(d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())): n for (d, t), n in docs.items()})
    assert {r["shard"] for r in out} <= set(range(24)) and all(r["law"] == "bytes" and r["grown_shard"] is None for r in out)
    slots = Counter(r["shard"] for r in out)
    assert Counter((r["shard"], r["slot"]) for r in out) == Counter((k, j) for k, n in slots.items() for j in range(n))
    enc = byte_bpe.encoder(byte_bpe.vocabulary_path())
    assert plain(queries.op5_byte_bpe(spark, folder), "doc_id", "n_tokens") == sum((Counter({(d, len(enc.encode_ordinary(t or ""))): n}) for (d, t), n in docs.items()), Counter())
    chat = {r["conv_id"]: r for r in queries.op2_chat_format(spark, folder).collect()}
    turns = {}
    for r in spark.read.parquet(f"{folder}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    turns[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert set(chat) == set(turns)
    for c, t in turns.items():
        loss = "".join(x for r, x in t if r == "assistant")
        assert chat[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in t).encode()).hexdigest() and chat[c]["n_turns"] == len(t)
        assert (chat[c]["loss_chars"], chat[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    mix = {r["doc_id"]: r for r in queries.op10_mixing(spark, folder).collect()}
    assert set(mix) == {d for d, _ in docs} and all(r["taken"] <= 3 * r["size"] and r["taken"] % max(r["size"], 1) == 0 for r in mix.values())
    for op in (queries.op1_toxicity, queries.op6_quality_classifier):
        assert set(op(spark, folder).columns) >= {"doc_id", "held_out", "score", "predicted"} and op(spark, folder).count() == sum(docs.values())


def test_against_sql(spark, folder):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, folder)
        want = con.execute(sql)
        names = [c[0] for c in want.description]
        near = lambda r: tuple(f"{x:.9g}" if isinstance(x, float) else x for x in r)
        assert sorted(names) == sorted(got.columns)
        assert Counter(map(near, got.select(*names).collect())) == Counter(map(near, want.fetchall())), name


def test_contexts(spark):
    """Each reply has all turns before it as context; what follows the last reply is kept; a wrong context is an error."""
    rows = [(1, k, r, f"{r}{k}<") for k, r in enumerate(["user", "assistant", "user", "assistant", "system"])] + [(2, 0, "user", "a")]
    ex = chat_format.expand(chat_format.format_conversations(spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, pos int"))).cache()
    head = lambda r: f"{chat_format.HEAD}{r}\n"
    said = [head(r) + t.replace("<", "&lt;") + chat_format.TAIL for _, _, r, t in rows[:5]]
    got = {(r["conv_id"], r["pos"]): r for r in ex.collect()}
    assert got[1, 1]["context"] == said[0] + head("assistant") and got[1, 1]["target"] == "assistant1&lt;"
    assert got[1, 3]["context"] == "".join(said[:3]) + head("assistant") and got[1, 5]["context"] == said[4] and got[1, 5]["target"] is None
    assert set(got) == {(1, 1), (1, 3), (1, 5), (2, 1)} and got[2, 1]["context"] == head("user") + "a" + chat_format.TAIL
    from pyspark.sql import functions as F

    wrong = ex.withColumn("context", F.when(F.col("pos") == 1, F.replace("context", F.lit("user0"), F.lit("user9"))).otherwise(F.col("context")))
    with pytest.raises(Exception, match="prefix"):
        chat_format.read_back(wrong).collect()


def test_clashes(spark):
    """Columns named as what the operators make inside pass through."""
    names = ["_w", "_t", "_l", "_h", "_s", "_p", "_in", "_part", "_salt", "_row", "_size", "_source", "_rate", "_k"]
    ddl = "doc_id long, text string, source string, size long, " + ", ".join(f"{c} int" for c in names)
    docs = spark.createDataFrame([(k, f"word {k} " * 30, "s", None if k == 3 else 9, *range(len(names))) for k in range(8)], ddl)
    for out in (quality_rules.ledger(docs), sharding.shard_by_bytes(docs, 3), mixing.mixed(docs)):
        assert plain(out, *names) == Counter({tuple(range(len(names))): 8})


def test_ridge(spark):
    """Features approximate the Gaussian kernel, and summed normal equations give the ridge solution of a plain one."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 12))
    phi = quality_classifier.Map(np.zeros(12), np.ones(12), features=20_000)
    z = phi(x)[:, :-1]
    near = np.exp(-quality_classifier.GAMMA * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - near).max() < 0.05
    small, y = quality_classifier.Map(np.zeros(12), np.ones(12), features=16), (x[:, 0] > 0).astype(float)
    rows = spark.createDataFrame([([float(v) for v in np.float32(r)], float(t)) for r, t in zip(x, y)], "x array<float>, y double").repartition(5)
    a, b = quality_classifier.normal_equations(rows, small)
    m = small(np.float32(x).astype(float))
    assert np.allclose(a, m.T @ m) and np.allclose(b, m.T @ y)


@pytest.mark.parametrize("seed", range(4))
def test_decode_is_likeliest(seed):
    """Viterbi against all ways that the channel may have written a short word."""
    import numpy as np

    rng = random.Random(seed)
    counts = np.zeros(toxicity.SIDE**3)
    for w in ["stupid", "idiot", "loser", "the", "tide", "list"] * 9:
        a = b = 0
        for c in (*(toxicity._INDEX[x] for x in w), 0):
            counts[(a * toxicity.SIDE + b) * toxicity.SIDE + c] += 1
            a, b = b, c
    lm = toxicity.LanguageModel(counts)

    def score_of(text):
        a = b = 0
        total = 0.0
        for c in (*(toxicity._INDEX.get(x, 27) for x in text), 0):
            total, a, b = total + lm.log[a][b][c], b, c
        return total

    def every(word, before=""):
        if not word:
            yield "", 0.0
            return
        for x, s in toxicity.arcs(word[0], before):
            for rest, t in every(word[1:], word[0]):
                yield x + rest, s + t

    for _ in range(40):
        word = "".join(rng.choice("s5$t7u.i1!dd|lloo0e3-aa") for _ in range(rng.randint(1, 7)))
        best = max(score_of(t) + s for t, s in every(word))
        got = toxicity.decode(word, lm)
        assert abs(max(score_of(t) + s for t, s in every(word) if t == got) - best) < 1e-9
