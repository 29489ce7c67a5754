"""Conversation repair against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from walkloom.llm import conversation_repair as cr

FULL = re.compile(r"[^\x20\x09-\x0D]")
GIVES = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """Every edit sequence in order of cost, then letters: rows (role, text, must go, cut)."""
    best = {}

    def go(i, roles, cost, edits, out):
        if cost > best.get("cost", 10**9) or len(roles) > 2 * len(rows) + 2:
            return
        if i == len(rows) and GIVES.fullmatch("".join(r[:1] for r in roles)):
            key = (cost, edits)
            if key < (best.get("cost", 10**9), best.get("edits", "")):
                best.update(cost=cost, edits=edits, out=list(out))
        ok = lambda rs: re.fullmatch(r"s?(ua)*u?", "".join(r[:1] or "?" for r in rs))
        if len(edits) < 2 or edits[-2:] != "II":
            for r in ("user", "assistant"):
                if ok([*roles, r]):
                    go(i, [*roles, r], cost + 3, edits + "I", [*out, f"{r}:"])
        if i < len(rows):
            role, text, gone, cut = rows[i]
            go(i + 1, roles, cost + 4, edits + "D", out)
            if not gone:
                if ok([*roles, role]):
                    go(i + 1, [*roles, role], cost + 3 * cut, edits + "K", [*out, f"{role}:{text}"])
                for r in ("user", "assistant"):
                    if ok([*roles, r]):
                        go(i + 1, [*roles, r], cost + 3 + 3 * cut, edits + "R", [*out, f"{r}:{text}"])

    go(0, [], 0, "", [])
    return best["cost"], best["edits"], best["out"]


def brute(table):
    found = defaultdict(list)
    for conv, turn, role, text in table:
        rows = found[conv]
        shown = lambda x: " " if x is None else str(x)
        role, text = shown(role), shown(text)
        draw = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        role = "user" if draw == 4 else role
        rows += [(turn, role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    out = set()
    for conv, rows in found.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{r[1]}\0{r[2]}".encode()).digest()))
        faults, seen, marked = dict.fromkeys(("blank", "duplicate", "truncated"), 0), set(), []
        for _, role, text in rows:
            last = FULL.findall(text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, edits, kept = cheapest(marked)
        out.add((conv, gaps, *faults.values(), illegal, cost, edits, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


SCHEMA = "conv_id long, turn long, role string, text string, n string, audit string, digest string, copies string"


def table(seed, conversations, longest):
    rng, rows = random.Random(seed), []
    texts = ["Yes.", "No!", "a b", "What?", "", " \t", "so", None, "é.", "…", "long " * 50 + ".", "Done. \n"]
    for c in range(conversations):
        roles = rng.choice([["user", "assistant"], ["system", "user", "assistant"], ["user", "assistant", "tool", None, "", "agent", "system"]])
        for t in range(rng.randint(1, longest)):
            turn = rng.choice([t, t, t, t + 3, None])
            rows.append((c if c else None, turn, roles[t % len(roles)] if rng.random() < 0.8 else rng.choice(roles), rng.choice(texts)))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def test_repair(spark):
    rows = table(1, 150, 6)
    df = spark.createDataFrame([(*r, "x", "y", "z", "7") for r in rows], SCHEMA).repartition(5)
    got = cr.repair(cr.damage(df))
    assert got.count() == len({r[0] for r in rows}) and rows_of(got) == brute(rows)


def test_pieces(spark):
    """A conversation that several tasks hold, with rows that repeat within a turn and across turns, is as in one task."""
    rng = random.Random(3)
    rows = [(7, rng.randrange(300), rng.choice(["user", "assistant"]), rng.choice(["a.", "b.", "c", "d?"]) + str(rng.randrange(40)) + ".") for _ in range(900)] + [(7, 5, "user", "same.")] * 400 + [(8, 0, "user", "x.")]
    df = cr.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).cache()
    found = {}
    for n in (1, 13):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found[n] = rows_of(cr.repair(df))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found[1] == found[13] and len(found[1]) == 2


def test_trie():
    """Answers on shared prefixes are those of each signature alone, and shared layers aren't made again."""
    rng = random.Random(5)
    found = sorted("".join(rng.choice("suaoSUAOx") for _ in range(rng.randint(0, 7))) for _ in range(3000))
    alone = lambda s: next(cr.walk_trie([s]))[1:3]
    got = list(cr.walk_trie(found))
    assert [x[0] for x in got] == found and all(x[1:3] == alone(x[0]) for x in got)
    assert sum(x[3] for x in got) == len({s[:k] for s in found for k in range(1, len(s) + 1)}) < sum(map(len, found))


@pytest.mark.parametrize("signature, cost, edits", [("", 0, ""), ("ua", 0, "KK"), ("s", 4, "D"), ("u", 3, "KI"), ("a", 3, "IK"), ("uu", 3, "KR"), ("sa", 3, "KIK"), ("x", 4, "D"), ("o", 4, "D"), ("U", 4, "D"), ("uaua" * 500, 0, "K" * 2000)])
def test_edits(signature, cost, edits):
    assert next(cr.walk_trie([signature]))[1:3] == (cost, edits)


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.repair(cr.damage(df)).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = cr.repair(cr.damage(spark.createDataFrame([(gone, 0, "user", "hi.")], df.schema))).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
