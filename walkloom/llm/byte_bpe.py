"""Byte-level BPE by overlapping chunks.

Texts of more than CHUNK characters are cut into chunks that overlap by OVERLAP, spread over the
tasks and pre-tokenised apart. The streams of neighbours are stitched at the first pre-token boundary
that both found in their overlap; from there on they agree, as a match of the pattern depends only on
what follows its start. The pieces between stitches are then encoded apart and their ids joined. If
two streams don't meet in an overlap (a run of one kind of character longer than it), their pieces are
encoded as one. Shorter texts are one chunk and are encoded at once. Decoding joins raw bytes.

Defined results: null text is empty and has no ids; repeated rows each get a row; other columns are
dropped; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from walkloom.llm.common import materialize, pieces as slices

CHUNK = 32_768
OVERLAP = 512
#: A boundary this near a chunk's cut end may have come out otherwise with more text in view.
MARGIN = 8

_encoders: dict = {}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str, pattern: str | None = None):
    """The tokenizer of a rank file; each Python worker reads it once."""
    import public_tokenizers
    import tiktoken

    if (path, pattern) not in _encoders:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path, pattern]


def boundaries(text: str, pattern: str, lo: int, hi: int) -> list[int]:
    """Pre-token boundaries p of text, lo <= p <= hi, with a blank after and none before them.

    At such a place no later text changes the match that ends there, so its piece can be cut out.
    """
    import regex

    out = []
    for m in regex.compile(pattern).finditer(text):
        p = m.end()
        if p > hi:
            break
        if p >= lo and p < len(text) and text[p] in " \n" and not text[p - 1].isspace():
            out.append(p)
    return out


def encode(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, pattern: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) of every whole text."""
    import public_tokenizers

    path, pattern = path or vocabulary_path(), pattern or public_tokenizers.PATTERN
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def whole(batches):
        enc = encoder(path, pattern)
        for b in slices(batches, 64):
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array((np.array(enc.encode_ordinary(t.as_py()), np.int32) for t in b.column(1)), pa.list_(pa.int32()))], ["doc_id", "ids"])

    short = docs.filter(F.length("text") <= chunk).mapInArrow(whole, "doc_id long, ids array<int>")
    long = docs.filter(F.length("text") > chunk)
    if long.isEmpty():
        return short

    def cut(batches):
        import uuid

        for b in slices(batches, 16):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                text, key = text.as_py(), uuid.uuid5(uuid.NAMESPACE_OID, f"{part()}").hex
                for k, at in enumerate(range(0, len(text), chunk)):
                    yield pa.RecordBatch.from_pylist([{"key": key, "doc_id": doc, "k": k, "at": at, "text": text[at : at + chunk + overlap]}], schema)

    def streams(batches):
        for b in slices(batches, 1):
            for row in b.to_pylist():
                text, at = row["text"], row["at"]
                found = boundaries(text, pattern, 0, len(text) - MARGIN)
                row["head"] = [at + p for p in found if p <= overlap] if at else []
                row["tail"] = [at + p for p in found if p >= chunk]
                yield pa.RecordBatch.from_pylist([row], schema2)

    schema = pa.schema([("key", pa.string()), ("doc_id", pa.int64()), ("k", pa.int32()), ("at", pa.int64()), ("text", pa.string())])
    schema2 = pa.schema([*schema, ("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64()))])
    ddl = "key string, doc_id long, k int, at long, text string"
    chunks = materialize(long.mapInArrow(cut, ddl), "chunks")  # the keys are made once
    found = chunks.repartition("key", "k").mapInArrow(streams, f"{ddl}, head array<long>, tail array<long>")
    order = W.partitionBy("key").orderBy("k")
    cuts = found.withColumn("cut", F.when(F.col("k") == 0, F.lit(0).cast("long")).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(order)))))
    # A chunk without a meeting place goes with the one before it.
    cuts = cuts.withColumn("piece", F.sum(F.when(F.col("cut").isNotNull(), 1).otherwise(0)).over(order)).withColumn("next", F.lead("cut").over(order))
    cuts = cuts.withColumn("last", F.lead("k").over(order).isNull())
    parts = cuts.groupBy("key", "piece").agg(F.first("doc_id").alias("doc_id"), F.min("cut").alias("cut"), F.max_by("next", "k").alias("next"), F.sort_array(F.collect_list(F.struct("k", "at", "text"))).alias("x"))

    def encode_pieces(batches):
        enc = encoder(path, pattern)
        for b in slices(batches, 1):
            for r in b.to_pylist():
                x, start = r["x"], r["x"][0]["at"]
                text = "".join(c["text"][:chunk] for c in x[:-1]) + x[-1]["text"]
                end = len(text) if r["next"] is None else r["next"] - start
                ids = enc.encode_ordinary(text[r["cut"] - start : end])
                yield pa.RecordBatch.from_arrays([pa.array([r["key"]]), pa.array([r["doc_id"]], pa.int64()), pa.array([r["piece"]], pa.int64()), pa.array([np.array(ids, np.int32)], pa.list_(pa.int32()))], ["key", "doc_id", "piece", "ids"])

    ids = parts.mapInArrow(encode_pieces, "key string, doc_id long, piece long, ids array<int>")
    joined = ids.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("piece", "ids"))), lambda s: s["ids"])).alias("ids"))
    return short.unionByName(joined.select("doc_id", "ids"))


_count = [0]


def part() -> str:
    """A name for a text that no other text of this job has: its task's partition and a counter of the worker."""
    from pyspark import TaskContext

    _count[0] += 1
    c = TaskContext.get()
    return f"{c.stageId()}/{c.partitionId()}/{c.taskAttemptId()}/{_count[0]}"


def decode(ids: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, bytes (binary) from doc_id, ids."""
    path = path or vocabulary_path()

    def run(batches):
        enc = encoder(path, pattern)
        for b in slices(batches, 64):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.decode_bytes(i.as_py()) for i in b.column(1)], pa.binary())], ["doc_id", "bytes"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(ids: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 from doc_id, ids."""
    path = path or vocabulary_path()

    def run(batches):
        enc = encoder(path, pattern)
        for b in slices(batches, 256):
            out = []
            for i in b.column(1):  # one text's ids at a time
                ids = i.as_py()
                out.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(enc.decode_bytes(ids)).hexdigest()))
            n, a, d = zip(*out)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return ids.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
