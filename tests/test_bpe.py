import random

from pyspark.sql import functions as F

from walkloom.operators import bpe

CORPUS = [[1, 2, 3, 1, 2], [1, 2, 1, 2, 3], [3, 3, 3, 3, 1]]
RULES = [(1, 2, 5, 4), (3, 3, 6, 3), (5, 3, 7, 2)]


def test_golden(spark):
    assert bpe.train_local([(t, 1) for t in CORPUS], 10, 2) == RULES
    df = spark.createDataFrame([(k, t) for k, t in enumerate(CORPUS)], "graph_id long, tokens array<int>")
    for how in ("local", "distributed"):
        rules = bpe.train(df, 10, 2, how)
        assert [tuple(r)[1:] for r in rules.orderBy("rank").collect()] == RULES
    out = bpe.decode(bpe.encode(df, rules), rules).orderBy("graph_id").collect()
    assert [r["encoded"] for r in out] == [[7, 5], [5, 7], [6, 6, 1]]
    assert [r["decoded"] for r in out] == CORPUS


def test_merge_forms_agree(spark):
    rng = random.Random(1)
    rows = [([rng.randrange(3) for _ in range(rng.randrange(9))],) for _ in range(60)] + [([1, 1, 1, 2, 1, 1],), ([],), ([1],)]
    df = spark.createDataFrame(rows, "tokens array<int>")
    for left, right in ((1, 1), (1, 2)):
        for t, got in df.select("tokens", bpe.merged("tokens", left, right, 9).alias("m")).collect():
            assert got == bpe.merge_list(t, left, right, 9)
    assert bpe.merge_list([1, 1, 1, 2, 1, 1], 1, 1, 9) == [9, 1, 2, 9]


def test_limits(spark):
    rank = {(1, 2): (0, 4), (4, 3): (1, 5)}
    assert bpe.encode_list([1, 2, 3], rank)[0] == [5] and bpe.encode_list([1, 2, 3], rank, 1)[0] == [4, 3] and bpe.encode_list([], rank)[0] == []
    df = spark.range(200).select(F.col("id").alias("graph_id"))
    for m in ("none", "all", "topk", "random", "triangular", "gaussian"):
        got = [r[0] for r in df.select(bpe.rank_limit(m, 50, 20)).collect()]
        assert min(got) >= 0 and max(got) <= 50


def test_random_corpora(spark):
    """Arrays and batches of independent merges against counting anew, and encoding by arrays against pair by pair, with limits."""
    from collections import Counter

    import numpy as np

    rng = random.Random(3)
    for _ in range(150):
        k = rng.choice([1, 2, 3, 5])
        seqs = [[rng.randrange(k) for _ in range(rng.randrange(30))] for _ in range(rng.randint(1, 12))]
        now, want, top = [list(s) for s in seqs], [], max((max(s) for s in seqs if s), default=-1)
        while len(want) < 25 and (c := Counter(p for s in now for p in zip(s, s[1:]))) and max(c.values()) > 1:
            pair, n = min(c.items(), key=lambda x: (-x[1], x[0]))
            want.append((*pair, top + 2 + len(want), n))
            now = [bpe.merge_list(s, *want[-1][:3]) for s in now]
        assert bpe.train_local([(s, 1) for s in seqs], 25, 2) == want
        now, made = [list(s) for s in seqs], []
        while len(made) < 25:
            c = Counter(p for s in now for p in zip(s, s[1:]))
            best = sorted(((*p, n) for p, n in c.items()), key=lambda x: (-x[2], x[0], x[1]))[: rng.choice([4, 256])]
            step = bpe.independent(best, 2)[: 25 - len(made)]
            if not step:
                break
            for a, b, n in step:
                made.append((a, b, top + 2 + len(made), n))
                now = [bpe.merge_list(s, *made[-1][:3]) for s in now]
        assert made == want
        book, rank = bpe.Codebook([r[:3] for r in want]), {r[:2]: (i, r[2]) for i, r in enumerate(want)}
        flat, ends = np.array([t for s in seqs for t in s], np.int64), np.cumsum([len(s) for s in seqs])
        limits = np.array([rng.randrange(len(want) + 2) for _ in seqs])
        for lim in (None, limits):
            tok, stop, used, last = book.encode(flat, ends, lim)
            stop, last = np.concatenate([[0], stop]), np.concatenate([[0], last])
            for i, s in enumerate(seqs):
                assert bpe.encode_list(s, rank, None if lim is None else int(lim[i])) == (tok[stop[i] : stop[i + 1]].tolist(), used[last[i] : last[i + 1]].tolist())


def test_distributed_tables(spark):
    """Both ways over tables, with null and empty sequences, and the round trip."""
    rng = random.Random(9)
    rows = [(k, [rng.choice([1, 3, 5, 2]) for _ in range(rng.randrange(40))]) for k in range(200)] + [(900, []), (901, None)]
    df = spark.createDataFrame(rows, "graph_id long, tokens array<int>")
    a, b = (bpe.train(df, 30, strategy=s).orderBy("rank").collect() for s in ("local", "distributed"))
    assert a == b and len(a) == 30
    out = bpe.decode(bpe.encode(df, spark.createDataFrame(a, bpe.RULES)), spark.createDataFrame(a, bpe.RULES)).collect()
    assert all(r["decoded"] == (r["tokens"] or []) for r in out) and len(out) == len(rows)
    assert bpe.train(df.limit(0), 5).count() == 0
    assert [r["first_rank"] for r in bpe.codebook_patterns(spark.createDataFrame([(0, 67, 108, 300, 9), (1, 300, 49, 301, 5)], bpe.RULES), targets=("Cl1",)).orderBy("rank").collect()] == [None, 1]


def _left(spark):
    """Files of the shared folder."""
    import glob

    from walkloom.sources import io

    return set(glob.glob(io.scratch(spark, "x").removeprefix("file://").rpartition("/")[0] + "/*"))


def test_tables(spark):
    """Training over tables gives the rules of one machine, on corpora of few and of many tokens, and leaves no table."""
    rng = random.Random(6)
    before = _left(spark)
    for k, size, merges in ((3, 20, 7),):
        seqs = [([rng.randrange(k) for _ in range(rng.randrange(25))],) for _ in range(size)] + [([1, 1, 1, 1, 1],), ([],), ([0],)] * 2
        df = spark.createDataFrame(seqs, "tokens array<int>").repartition(3)
        both = [[tuple(r) for r in bpe.train(df, merges, 2, how).orderBy("rank").collect()] for how in ("local", "distributed")]
        assert both[0] == both[1] and len(both[0]) > 5
    assert bpe.train(spark.createDataFrame([], "tokens array<int>"), 5, 2, "distributed").count() == 0
    assert _left(spark) == before


def test_tables_write_what_changes(spark):
    """A pair that few sequences hold costs few rows, however many sequences there are."""
    rows = [([k % 7 + 10 * (k % 11), 200 + k, 300 + k % 13],) for k in range(3000)] + [([1, 2, 400 + k, 3, 4, 5, 6],) for k in range(12)]
    df = spark.createDataFrame(rows, "tokens array<int>").groupBy("tokens").agg(F.count("*").alias("n"))
    rules, (sequences, counts, index) = bpe.train_tables(df, 8, 5)
    passes = len(rules)
    assert rules[:2] == [(1, 2, 3201, 12), (3, 4, 3202, 12)] and 4 <= passes <= 8
    base = 3012, sum(max(0, len(set(zip(t, t[1:])))) for (t,) in rows)
    assert base[0] <= sequences < base[0] + 12 * 2 * passes and index < base[1] + 12 * 3 * passes


def test_merge_batch():
    """Changes of counts and places of pairs around merges, against counting anew."""
    from collections import Counter

    import numpy as np

    rng = random.Random(9)
    for _ in range(200):
        seqs = [[rng.randrange(3) for _ in range(rng.randrange(14))] for _ in range(rng.randint(1, 6))]
        times, ids = [rng.randint(1, 4) for _ in seqs], [100 + k for k in range(len(seqs))]
        rules = [(rng.randrange(3), rng.randrange(3), 7), (rng.choice([7, 1]), rng.choice([7, 2]), 8)]
        now = [bpe.merge_list(bpe.merge_list(s, *rules[0]), *rules[1]) for s in seqs]
        count = lambda ss: sum((Counter({p: n * w for p, n in Counter(zip(s, s[1:])).items()}) for s, w in zip(ss, times)), Counter())
        kept, tok, ends, (code, delta), (pair, own) = bpe.merge_batch(np.array(ids), np.array(times), np.array([t for s in seqs for t in s], np.int64), np.cumsum([len(s) for s in seqs]), rules)
        want = count(now)
        want.subtract(count(seqs))
        assert {(c >> 32, c & 0xFFFFFFFF): d for c, d in zip(code.tolist(), delta.tolist())} == {p: d for p, d in want.items() if d}
        parts = np.split(tok, ends[:-1])
        assert {k: p.tolist() for k, p in zip(kept.tolist(), parts)} == {k: b for k, (a, b) in enumerate(zip(seqs, now)) if a != b}
        held = {((c >> 32, c & 0xFFFFFFFF), i) for c, i in zip(pair.tolist(), own.tolist())}
        assert held >= {(p, ids[k]) for k, s in enumerate(now) for p in zip(s, s[1:]) if 7 in p or 8 in p}


def test_pieces(spark, monkeypatch):
    """Of more tokens than one machine takes, pieces are trained on, not passes over all sequences; with the same rules, also where the first guess is too high."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(3, 8))) for _ in range(60)]
    texts = [([ord(c) for c in " ".join(rng.choice(words) for _ in range(rng.randrange(60)))],) for _ in range(300)] + [([97] * k,) for k in range(9)] + [(None,), ([],), ([900],)]
    df = spark.createDataFrame(texts, "tokens array<int>").repartition(3)
    before = _left(spark)
    for merges, least, local, tables in ((30, 20, 20_000, False), (150, 2, 20_000, False), (900, 300, 49_000, False), (3, 2, 10, True)):
        want = [tuple(r) for r in bpe.train(df, merges, least, "local").orderBy("rank").collect()]
        assert want[0][3] == 902 and (merges == 900) == (len(want) < merges)
        with monkeypatch.context() as m:
            m.setattr(bpe, "LOCAL_TOKENS", local)
            if not tables:
                m.setattr(bpe, "PairTables", None)
            assert [tuple(r) for r in bpe.train(df, merges, least).orderBy("rank").collect()] == want
    assert _left(spark) == before


def test_few_merges_are_counted_in_passes(spark, monkeypatch):
    """Few merges of many sequences need no pieces and no tables, and give the rules of one machine; also for runs of one token."""
    rng = random.Random(3)
    for top in (2, 3, 16):
        df = spark.createDataFrame([([rng.randrange(top) for _ in range(rng.randrange(12))],) for _ in range(400)], "tokens array<int>").repartition(3)
        want = [[tuple(r) for r in bpe.train(df, n, 2, "local").orderBy("rank").collect()] for n in (4, 8)]
        with monkeypatch.context() as m:
            m.setattr(bpe, "LOCAL_TOKENS", 100)
            m.setattr(bpe, "train_pieces", None)
            m.setattr(bpe, "train_tables", None)
            assert [[tuple(r) for r in bpe.train(df, n, 2).orderBy("rank").collect()] for n in (4, 8)] == want
