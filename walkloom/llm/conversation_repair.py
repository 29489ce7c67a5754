"""Conversation structure repair: least-cost edits that make a conversation's roles alternate, by dynamic programming over a trie of signatures.

A conversation's signature has a symbol a row, of its role's initial and its first fault. Signatures are
range-partitioned and sorted, so those that share a prefix stand together: a task walks them as a prefix
trie, keeps the layers of the path it is on, computes a layer once for each shared prefix, and emits an
answer at each terminal node. Layers hold costs only; the edits are read off the terminal's path.

Rows are ordered by (turn, nulls first; role; digest of role and text), so that equal rows are adjacent.
Copies of a row are counted before they are sent; a conversation's signature is made of pieces, one a task
of a range partition over all rows, so a conversation of any size isn't gathered as rows. The text of a
repaired conversation is hashed as its rows stream through one task, one row in memory at a time: SHA-256
is sequential.

Defined results: nulls are one space; a null conv_id is a conversation, a null turn comes first and is no
turn for gaps; a role whose initial isn't s, u or a is never kept, nor an empty one; repeated rows are
duplicates of the first; an empty table gives no rows, a conversation that loses all rows zeros and empty
texts. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walkloom.llm.common import BLANKS, materialize, pieces

#: Symbols by initial (s, u, a, other): sound and truncated rows, then blank and duplicate ones.
SOUND, CUT, BLANK, REPEAT = "suao", "SUAO", "1234", "5678"
DELETE, INSERT, KEEP, REROLE = "DIKR"
COST = {DELETE: 4, INSERT: 3, KEEP: 0, REROLE: 3}
#: What an undeleted truncated row adds.
CUT_COST = 3
#: States: nothing given yet, after system, after user, after assistant. Done in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
FAR = 1 << 60


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies (0 where the row is dropped): rows with planted faults, by the crc32 of their key."""
    one = F.lit(" ")
    text, role = F.coalesce(F.col("text").cast("string"), one), F.coalesce(F.col("role").cast("string"), one)
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), one), F.lit(":"), F.coalesce(F.col("turn").cast("string"), one))
    draw = F.crc32(key.cast("binary")) % 20
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(draw == 4, "user").otherwise(role).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1).alias("copies"),
    )


def _digest() -> Column:
    return F.unhex(F.md5(F.concat("role", F.lit("\0"), "text").cast("binary")))


def _symbol() -> Column:
    """Of a row's initial and of the faults that it shows by itself."""
    full = F.translate("text", BLANKS, "")
    at = F.instr(F.lit("sua"), F.left("role", F.lit(1)))
    at = F.when((F.col("role") == "") | (at == 0), 4).otherwise(at)
    of = lambda names: F.substring(F.lit(names), at, F.lit(1))
    return F.when(full == "", of(BLANK)).when(F.right(full, F.lit(1)).isin(".", "!", "?"), of(SOUND)).otherwise(of(CUT))


_PIECE = "conv_id long, turn long, role string, digest binary, symbols string, first_turn long, last_turn long, turns long"


def _cut(batches):
    """Sorted rows as pieces: of each conversation, the symbols that this task has, with the piece's first key and its turns."""
    key, out = None, []
    names = [x.split()[0] for x in _PIECE.split(", ")]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64()])))
    made = lambda rows: pa.RecordBatch.from_pylist([{**r, "symbols": "".join(r["symbols"])} for r in rows], schema)
    for b in batches:
        for conv, turn, role, digest, symbols in zip(*(c.to_pylist() for c in b.columns)):
            if not out or conv != key:
                if len(out) >= 1000:
                    yield made(out)
                    out = []
                key = conv
                out.append(dict(zip(names, (conv, turn, role, digest, [], None, None, 0))))
            p = out[-1]
            p["symbols"].append(symbols)
            if turn is not None and symbols:
                if turn != p["last_turn"]:
                    p["turns"] += 1
                p["first_turn"], p["last_turn"] = turn if p["first_turn"] is None else p["first_turn"], turn
    if out:
        yield made(out)


def signatures(damaged: DataFrame) -> DataFrame:
    """conv_id, symbols (a row each, in order), gaps; a row for every conversation, also of dropped rows only."""
    keys = ["conv_id", "turn", "digest"]
    # Equal rows are counted first, so that no key has more than one row.
    each = damaged.select("conv_id", "turn", "role", _digest().alias("digest"), _symbol().alias("symbol"), "copies").groupBy(*keys, "role", "symbol").agg(F.sum("copies").alias("copies"))
    # Of rows said in several turns, the first: min ignores nulls, which come first.
    said = each.filter("copies > 0").groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("x")).agg(F.count("*").alias("n"), F.max(F.col("turn").isNull()).alias("unplaced"), F.min("turn").alias("least")).filter("n > 1")
    each = each.join(said, each["conv_id"].eqNullSafe(said["c"]) & (each["digest"] == said["x"]), "left")
    later = F.coalesce(F.when(F.col("unplaced"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("least")), F.lit(False))
    blank = F.col("symbol").isin(*BLANK)
    again = F.when(blank, F.col("symbol")).otherwise(F.translate("symbol", SOUND + CUT, REPEAT * 2))
    symbols = F.when(F.col("copies") == 0, "").otherwise(F.concat(F.when(later, again).otherwise(F.col("symbol")), F.repeat(again, (F.col("copies") - 1).cast("int"))))
    order = ["conv_id", "turn", "role", "digest"]
    rows = each.select(*order, symbols.alias("symbols")).repartitionByRange(*order).sortWithinPartitions(*order)
    parts = rows.mapInArrow(_cut, _PIECE)
    # A conversation has a piece a task at most.
    p = F.struct(F.col("turn").isNotNull().alias("placed"), "turn", "role", "digest", "symbols", "first_turn", "last_turn", "turns")
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(p)).alias("p"))
    turns = F.filter("p", lambda x: x["turns"] > 0)
    # A turn that two pieces share counts once.
    shared = F.size(F.filter(F.transform(turns, lambda x, i: F.get(turns, i - 1)["last_turn"] == x["first_turn"]), lambda x: x))
    distinct = F.aggregate(turns, F.lit(0).cast("long"), lambda a, x: a + x["turns"]) - shared
    span = F.array_max(F.transform(turns, lambda x: x["last_turn"])) - F.array_min(F.transform(turns, lambda x: x["first_turn"])) + 1
    return whole.select("conv_id", F.array_join(F.transform("p", lambda x: x["symbols"]), "").alias("symbols"), F.coalesce(span - distinct, F.lit(0)).cast("long").alias("gaps"))


def _moves(symbol: str) -> list[tuple[str, int, list[int]]]:
    """The edits that use up a row: (edit, cost, the state after each state, -1 where it can't be)."""
    moves = [(DELETE, COST[DELETE], list(STATES))]
    if symbol != "x":
        more, kind = CUT_COST * symbol.isupper(), symbol.lower()
        keep = {"s": [SYSTEM, -1, -1, -1], "u": [USER, USER, -1, USER], "a": [-1, -1, ASSISTANT, -1]}.get(kind)
        if keep:
            moves.append((KEEP, COST[KEEP] + more, keep))
        moves.append((REROLE, COST[REROLE] + more, [USER, USER, ASSISTANT, USER]))
    return moves


MOVES = {c: _moves(c) for c in SOUND + CUT + "x"}
#: The state after an inserted row.
INSERTED = [USER, USER, ASSISTANT, USER]


def _closed(layer: list[int]) -> tuple[int, ...]:
    """A layer with what insertions reach: two in a row pass through every state."""
    for _ in range(3):
        for s in STATES:
            layer[INSERTED[s]] = min(layer[INSERTED[s]], layer[s] + COST[INSERT])
    return tuple(layer)


FIRST = _closed([0, FAR, FAR, FAR])


def _next(layer: tuple[int, ...], symbol: str) -> tuple[int, ...]:
    out = [FAR] * 4
    for _, cost, to in MOVES[symbol]:
        for s in STATES:
            if to[s] >= 0:
                out[to[s]] = min(out[to[s]], layer[s] + cost)
    return _closed(out)


def _edits(signature: str, layers: list[tuple[int, ...]]) -> tuple[int, str]:
    """Least cost, and the ASCII-least of the cheapest edits, from the layers on the signature's path.

    From the end, the states of each layer that lie on a cheapest path are marked; from the start, the least
    edit that leads to a marked state is taken. An edit fixes the state that it leads to, so this is the least string.
    """
    last = layers[len(signature)]
    cost = min(last[START], last[ASSISTANT])
    marked: list[set[int]] = [set() for _ in range(len(signature) + 1)]
    marked[-1] = {s for s in (START, ASSISTANT) if last[s] == cost}
    for i in range(len(signature), -1, -1):
        here, on = layers[i], marked[i]
        for _ in range(3):
            on |= {s for s in STATES if INSERTED[s] in on and here[s] + COST[INSERT] == here[INSERTED[s]]}
        if i:
            before = layers[i - 1]
            marked[i - 1] = {s for _, c, to in MOVES[signature[i - 1]] for s in STATES if to[s] in on and before[s] + c == here[to[s]]}
    out, i, s = [], 0, START
    while i < len(signature) or not (s in (START, ASSISTANT) and layers[i][s] == cost):
        ways = [(e, i + 1, to[s]) for e, c, to in MOVES[signature[i]] if to[s] in marked[i + 1] and layers[i][s] + c == layers[i + 1][to[s]]] if i < len(signature) else []
        if INSERTED[s] in marked[i] and layers[i][s] + COST[INSERT] == layers[i][INSERTED[s]]:
            ways.append((INSERT, i, INSERTED[s]))
        edit, i, s = min(ways)
        out.append(edit)
    return cost, "".join(out)


def walk_trie(found):
    """(signature, cost, edits, layers computed) for signatures in sorted order; layers of a prefix that the one before shares aren't computed again."""
    path, layers, answer = "", [FIRST], None
    for signature in found:
        shared = len(os.path.commonprefix([path, signature]))
        made = len(signature) - shared
        if answer is None or signature != path:
            del layers[shared + 1 :]
            for c in signature[shared:]:
                layers.append(_next(layers[-1], c))
            answer = _edits(signature, layers)
        path = signature
        yield signature, *answer, made


_ANSWER = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _terminals(batches):
    names = [x.split()[0] for x in _ANSWER.split(", ")]
    schema = pa.schema([(n, pa.string() if n == "audit" else pa.int64()) for n in names])
    initials = str.maketrans(CUT + BLANK + REPEAT, SOUND * 3)

    def rows():
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("signature", "conv_id", "gaps", "symbols")))

    held: list[tuple] = []

    def signatures_of():
        for r in rows():
            held.append(r)
            yield r[0]

    out = []
    for _, cost, edits, _ in walk_trie(signatures_of()):
        _, conv, gaps, symbols = held.pop()
        count = lambda names, x=symbols: sum(map(x.count, names))
        who = symbols.translate(initials)
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(who, who[1:]))
        out.append(dict(zip(names, (conv, gaps, count(BLANK), count(REPEAT), count(CUT), illegal, cost, edits))))
        if len(out) == 1000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def answers(found: DataFrame) -> DataFrame:
    """The counts, the least cost and the cheapest edits of each conversation, from its symbols."""
    rows = found.select(F.translate("symbols", BLANK + REPEAT, "x" * 8).alias("signature"), "conv_id", "gaps", "symbols")
    # By conversation too, so that one signature, however common, is dealt over several tasks.
    return rows.repartitionByRange("signature", "conv_id").sortWithinPartitions("signature", "conv_id").mapInArrow(_terminals, _ANSWER)


_MADE = _ANSWER + ", repaired_sha256 string"


class _Repair:
    """One conversation's repaired text, hashed as its rows come."""

    def __init__(self, answer: dict):
        self.answer, self.edits, self.at, self.state, self.hash, self.begun = answer, answer["audit"], 0, START, hashlib.sha256(), False

    def give(self, role: str, text: str, state: int) -> None:
        if self.begun:
            self.hash.update(b"\n")
        self.hash.update(role.encode() + b":" + text.encode())
        self.begun, self.state = True, state

    def to(self) -> tuple[str, int]:
        return ("assistant", ASSISTANT) if self.state == USER else ("user", USER)

    def insert(self) -> None:
        while self.at < len(self.edits) and self.edits[self.at] == INSERT:
            role, state = self.to()
            self.give(role, "", state)
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.insert()
        edit, self.at = self.edits[self.at], self.at + 1
        if edit == KEEP:
            self.give(role, text, {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]])
        elif edit == REROLE:
            new, state = self.to()
            self.give(new, text, state)

    def done(self) -> dict:
        self.insert()
        if self.at != len(self.edits):
            raise ValueError("the edits don't fit the conversation")
        return {**self.answer, "repaired_sha256": self.hash.hexdigest()}


def _apply(batches):
    names = [x.split()[0] for x in _ANSWER.split(", ")]
    schema = pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in [*names, "repaired_sha256"]])
    now, out = None, []
    for b in pieces(batches):
        for r in b.to_pylist():
            if r["audit"] is not None:  # a conversation's first row
                if now:
                    out.append(now.done())
                now = _Repair({n: r[n] for n in names})
            else:
                for _ in range(r["copies"]):
                    now.row(r["role"], r["text"])
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if now:
        yield pa.RecordBatch.from_pylist([now.done()], schema)


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of damaged rows (conv_id, turn, role, text, copies)."""
    rows = rows.select("conv_id", "turn", "role", "text", "copies")
    found = materialize(answers(signatures(rows)), "repairs")
    texts = rows.filter("copies > 0").withColumn("digest", _digest())
    both = found.unionByName(texts, allowMissingColumns=True)
    keys = [F.col("conv_id"), F.col("audit").isNull(), F.col("turn"), F.col("role"), F.col("digest")]
    return both.repartition("conv_id").sortWithinPartitions(*keys).drop("digest", "turn").mapInArrow(_apply, _MADE)
