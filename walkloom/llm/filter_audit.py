"""Filter interaction audit: which filter removes what, in every order of the filters, by fingerprint routing and mask counts.

Rows are routed by the xxhash of their text. A partition keeps, for each fingerprint, a chain of the full
texts that have it, each with its least id, so texts of one fingerprint are told apart; rows whose id isn't
the least are emitted. That is done once where rows are read, so that of a group of copies, however large,
one record a partition is sent, and once where the records meet. Each row then has a mask of the filters
that it fails; combineByKey adds masks up in one vector of counts a part, and the report for all orders is
made from these vectors alone.

Defined results: null text is empty; words are runs of characters that aren't blanks; a null id neither is
an equal text's smaller id nor has one; repeated rows count one by one, and those that share the least id all
pass E; a null part (lang) counts as empty text; a document is good or toxic if any label row says so; an
empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

from collections import Counter
from itertools import permutations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
EQUAL = 1 << FILTERS.index("E")
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = b"#$%&*|"


def own_failures(text: bytes) -> int:
    """The bits of filters A to D, which a text alone decides."""
    words = text.split()  # by the six ASCII blanks
    points = len(text.decode(errors="replace"))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return (len(words) < 200) + 2 * (100 * len(set(words)) < 50 * len(words)) + 4 * (100 * capitals > 3 * points) + 8 * (symbols > 0)


class Chains:
    """fingerprint -> [text, its mask, its least id, Counter of the parts of the rows with that id], an entry for each text."""

    def __init__(self):
        self.of: dict[int, list[list]] = {}

    def entry(self, fingerprint: int, text: bytes, mask: int | None = None) -> list:
        chain = self.of.setdefault(fingerprint, [])
        for e in chain:
            if e[0] == text:
                return e
        chain.append([text, own_failures(text) if mask is None else mask, None, Counter()])
        return chain[-1]

    @staticmethod
    def put(e: list, doc_id: int, parts: Counter):
        """Adds rows of one id to an entry; yields the rows that aren't of its least id."""
        if e[2] is None or doc_id < e[2]:
            doc_id, e[2], parts, e[3] = e[2], doc_id, e[3], parts
        elif doc_id == e[2]:
            e[3].update(parts)
            return
        for part, n in parts.items():
            yield doc_id, part, e[1] | EQUAL, n

    def all(self):
        for fingerprint, chain in self.of.items():
            for e in chain:
                yield fingerprint, e


def _send(rows):
    """Records to route: of a text (its fingerprint, and a chain's entry), or of a row that is decided (doc_id, part, mask, rows)."""
    chains = Chains()
    for doc_id, part, text in rows:
        text = (text or "").encode()
        fingerprint = xxhash.xxh64_intdigest(text)
        e = chains.entry(fingerprint, text)
        if doc_id is None:
            yield fingerprint, (None, part or "", e[1], 1)
            continue
        for gone in chains.put(e, doc_id, Counter({part or "": 1})):
            yield xxhash.xxh64_intdigest(str(gone[0])), gone
    for fingerprint, e in chains.all():
        if e[2] is not None:
            yield fingerprint, tuple(e)


def _meet(records):
    """Rows (doc_id, part, mask, rows), from records of one partition."""
    chains = Chains()
    for fingerprint, record in records:
        if not isinstance(record[0], bytes):
            yield record
            continue
        text, mask, least, parts = record
        yield from chains.put(chains.entry(fingerprint, text, mask), least, parts)
    for _, (_, mask, least, parts) in chains.all():
        for part, n in parts.items():
            yield least, part, mask, n


#: Bytes of text that a routing partition holds, about.
PART_BYTES = 32 << 20


def masks(docs: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part, mask (bit k: filter k of FILTERS fails; E marks the ids that aren't least of their text), copies (equal rows)."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES)
    rows = docs.select(F.col("doc_id").cast("long"), F.col(part).cast("string"), "text").rdd
    met = rows.mapPartitions(_send).partitionBy(n, lambda k: k % n).mapPartitions(_meet)
    return spark.createDataFrame(met, "doc_id long, part string, mask int, copies long", verifySchema=False)


def non_minimum(docs: DataFrame) -> DataFrame:
    """The ids, once a row, of the documents whose text a smaller id has too."""
    return masks(docs).filter(F.col("mask").bitwiseAND(EQUAL) != 0).select("doc_id", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("doc_id")


def _count(mask: int, n: int, good: int, toxic: int, into: np.ndarray | None = None) -> np.ndarray:
    """A vector of counts: for each mask, documents, good ones, toxic ones."""
    into = np.zeros((1 << len(FILTERS), 3), "i8") if into is None else into
    into[mask] += (n, n * good, n * toxic)
    return into


def _merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a += b
    return a


def _report(part: str, counts: np.ndarray):
    """A row for each order and step."""
    at = np.arange(len(counts))
    removed, rows = Counter(), []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(order):
            bit = 1 << k
            fails, met = at & bit != 0, at & before != 0
            gone = counts[fails & ~met].sum(0)
            removed[k] += int(gone[0])
            rows.append((k, "".join(FILTERS[x] for x in order), step + 1, *map(int, (counts[at & (before | bit) == 0, 0].sum(), gone[0], counts[fails & met, 0].sum(), counts[bit, 0], gone[1], gone[2]))))
            before |= bit
    for k, *row in rows:
        yield part, *row, removed[k]


REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """A row for each part, order of the filters and step, as REPORT names them. labels: doc_id, quality, toxic."""
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    none = F.lit(0)
    rows = masks(docs, part).join(known, "doc_id", "left").select("part", "mask", "copies", F.coalesce("good", none), F.coalesce("toxic", none))
    vectors = rows.rdd.map(lambda r: (r[0], r[1:])).combineByKey(lambda r: _count(*r), lambda v, r: _count(*r, into=v), _merge)
    return docs.sparkSession.createDataFrame(vectors.flatMap(lambda x: _report(*x)), REPORT, verifySchema=False)
