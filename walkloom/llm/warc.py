"""WARC archives: a writer with revisit records, and a reader that salvages damaged archives.

An archive is a row (name, content): content is a sequence of gzip members, one a record. Such tables
are written and read by Spark, so they may be in any store; export() copies them to files.

Defined results: null html is an empty payload; null url and page_id are written as "null" and read
back as null; of rows with equal payloads and equal largest page_id, one is the response (which, is
decided by row order) and the others revisit it; other columns are dropped; an empty table gives no rows.
Headers and URLs may have any length. A number in a header that isn't one, in ASCII digits and within 64
bits, is null, as is a damaged page id; without a right Content-Length there is no record. No damage raises.

What a salvage sets aside is a row of kind gap, with its place in the archive and, within a member that was
decompressed, in its text. A record of a member whose checksum fails counts only if its own digest is right.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walkloom.llm.common import materialize, shared_dir  # noqa: F401

VERSION = b"WARC/1.1"
#: An archive is closed when it has reached so many bytes.
ARCHIVE_BYTES = 4 << 20
GZIP = b"\x1f\x8b\x08"
DATE = "2020-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _numbered_alike(df: DataFrame) -> bool:
    """Whether row numbers are the same in each reading: only of files that are scanned, with columns and filters that give the same each time."""
    plan = df._jdf.queryExecution().optimizedPlan()
    if not plan.deterministic():
        return False
    while (kind := plan.getClass().getSimpleName()) in ("Project", "Filter"):
        plan = plan.child()
    return kind == "LogicalRelation"


def with_digests(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_digest, row."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([digest(x.as_py()) for x in b.column(2)], pa.string())], [*b.schema.names, "payload_digest"])

    if not _numbered_alike(pages):
        pages = materialize(pages.select("page_id", "url", "html"), "pages")
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(run, "page_id long, url string, payload binary, row long, payload_digest string")


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """with_digests plus record_type and refers_to. Payloads of fewer than min_bytes are all responses.

    The winners are one row a distinct payload, summed before they are shuffled, and written, so that
    a payload with any share of the rows is split by the skew join.
    """
    rows = with_digests(pages)
    best = rows.filter(F.length("payload") >= min_bytes).groupBy("payload_digest").agg(F.max(F.struct(F.coalesce("page_id", F.lit(-(2**63))).alias("p"), (-F.col("row")).alias("r"))).alias("x"), F.max("page_id").alias("refers_to"))
    best = materialize(best.select("payload_digest", (-F.col("x.r")).alias("best_row"), "refers_to"), "winners")
    own = F.col("best_row").isNull() | (F.col("best_row") == F.col("row"))
    return rows.join(best, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_digest", F.when(own, "response").otherwise("revisit").alias("record_type"), F.when(~own, F.col("refers_to")).alias("refers_to"))


def uri(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(page_id, url, payload: bytes, payload_digest: str, record_type: str, refers_to) -> bytes:
    """One gzip member. A revisit has no payload; its length is kept in a header."""
    body = payload if record_type == "response" else b""
    target = "null" if url is None else re.sub(r"[\x00-\x20\x7f-\xa0]", lambda m: "".join(f"%{x:02X}" for x in m[0].encode()), url)
    head = [VERSION.decode(), f"WARC-Type: {record_type}", f"WARC-Record-ID: {uri(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
            f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest(body)}", f"X-Payload-Length: {len(payload)}"]
    if record_type == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {uri(refers_to)}"]
    raw = "\r\n".join([*head, "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write(records: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """The archives as a written table (name, content)."""

    def run(batches):
        from pyspark import TaskContext

        task, n, parts, total = TaskContext.get().partitionId(), 0, [], 0

        def close():
            return pa.RecordBatch.from_arrays([pa.array([f"part-{task:06d}-{n:05d}.warc.gz"]), pa.array([b"".join(parts)], pa.binary())], ["name", "content"])

        for b in batches:
            for row in zip(*(c for c in b.columns)):
                parts.append(record(*(x.as_py() for x in row)))
                total += len(parts[-1])
                if total >= archive_bytes:
                    yield close()
                    n, parts, total = n + 1, [], 0
        if parts:
            yield close()

    cols = ["page_id", "url", "payload", "payload_digest", "record_type", "refers_to"]
    return materialize(records.select(*cols).mapInArrow(run, "name string, content binary"), "archives")


def export(archives: DataFrame, folder: str) -> None:
    """Copies archives, one at a time, to files in a folder of this machine."""
    import os

    os.makedirs(folder, exist_ok=True)
    for r in archives.toLocalIterator():
        with open(f"{folder}/{r['name']}", "wb") as f:
            f.write(r["content"])


def files(spark: SparkSession, path: str) -> DataFrame:
    """Archives from files, in any store. An archive is one row: Spark fails on files above spark.sql.sources.binaryFile.maxLength."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


class _Marks:
    """The next place of each of some marks; no byte is searched twice for one."""

    def __init__(self, raw: bytes, *marks: bytes):
        self.raw, self.at = raw, {m: -1 for m in marks}

    def next(self, start: int) -> int:
        for m, p in self.at.items():
            if p < start:
                p = self.raw.find(m, start)
                self.at[m] = len(self.raw) if p < 0 else p
        return min(self.at.values())


VERSION_LINE = re.compile(rb"WARC/1\.\d\r\n")
NUMBER = re.compile(r"\d{1,18}", re.ASCII)


def number(x: str | None) -> int | None:
    """What ASCII digits say, if they fit in 64 bits."""
    return int(x) if x is not None and NUMBER.fullmatch(x) else None


class Text:
    """Bytes that are searched for records."""

    def __init__(self, raw: bytes):
        self.raw = raw
        self.blanks, self.versions = _Marks(raw, b"\r\n\r\n"), _Marks(raw, b"\r\nWARC/1.")

    def record(self, at: int) -> tuple[dict, bytes, int] | None:
        """Headers, block and end of the record at a place, or None if any check fails.

        Headers that hold a version line are those of a record that is cut off, so no byte is read as headers twice.
        """
        if not VERSION_LINE.match(self.raw, at):
            return None
        split = self.blanks.next(at)
        if split == len(self.raw) or self.versions.next(at) < split:
            return None
        try:
            lines = self.raw[at:split].decode().split("\r\n")[1:]
            head = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        except ValueError:
            return None
        length = number(head.get("content-length"))
        end = split + 4 + (length or 0)
        if length is None or self.raw[end : end + 4] != b"\r\n\r\n":
            return None
        body = self.raw[split + 4 : end]
        if (d := head.get("warc-block-digest", "")).startswith("sha1:") and d[5:] != digest(body):
            return None
        return head, body, end + 4


#: Compressed bytes that are taken at a time.
STEP = 1 << 16


def member(content: bytes, at: int) -> tuple[bytes, int | None]:
    """What the gzip member at content[at:] decompresses to, as far as that goes, and its end; None as the end if it has no right checksum."""
    z, out, view = zlib.decompressobj(31), [], memoryview(content)
    for p in range(at, len(content), STEP):
        step, before = view[p : p + STEP], z.copy()
        try:
            out.append(z.decompress(step))
        except zlib.error:
            # What came before the fault, by halves, as the last step gave nothing.
            lo, hi = 0, len(step)
            while hi - lo > 1:
                mid, trial = (lo + hi) // 2, before.copy()
                try:
                    out.append(trial.decompress(step[lo:mid]))
                    lo, before = mid, trial
                except zlib.error:
                    hi = mid
            return b"".join(out), None
        if z.eof:
            return b"".join(out), p + len(step) - len(z.unused_data)
    return b"".join(out), None


def records(raw: bytes, sure: bool = True):
    """Yields ("record", start, end, headers, block) and ("gap", start, end) of raw records, one after another.

    After a failed check the next version line that begins a whole record is searched for. sure: whether
    records without a digest of their block count.
    """
    at, bad, versions, text = 0, None, _Marks(raw, b"WARC/1."), Text(raw)
    while at < len(raw):
        got = text.record(at)
        if got and (sure or got[0].get("warc-block-digest", "").startswith("sha1:")):
            if bad is not None:
                yield "gap", bad, at
                bad = None
            yield "record", at, got[2], *got[:2]
            at = got[2]
        else:
            bad = at if bad is None else bad
            at = versions.next(at + 1)
    if bad is not None:
        yield "gap", bad, len(raw)


def salvage(content: bytes):
    """Yields ("record", start, headers, block) and ("gap", start, end) or ("gap", start, end, inner start, inner end): what is read, and bytes that are set aside.

    After a failed check the next gzip member, or version line, that holds a whole record is searched for, and what is
    before it is a gap. Inner places are those in a member's text, the end None where that is unknown. Of a
    member that is damaged, records are read as far as it decompresses; the bytes after it are searched as well.
    """
    at, bad, marks, text = 0, None, _Marks(content, GZIP, b"WARC/1."), Text(content)
    while at < len(content):
        found, end = [], None
        if content.startswith(GZIP, at):
            raw, end = member(content, at)
            found = list(records(raw, end is not None))
            if not any(x[0] == "record" for x in found) and (end is None or raw):
                found, end = [], None
            stop = end
        elif got := text.record(at):
            found, end = [("record", 0, 0, *got[:2])], got[2]
            stop = end
        if not found and end is None:
            bad = at if bad is None else bad
            at = marks.next(at + 1)
            continue
        if bad is not None:
            yield "gap", bad, at
            bad = None
        if stop is None:  # a damaged member ends where the next mark is
            stop = marks.next(at + 1)
        read = 0
        for kind, a, b, *x in found:
            if kind == "gap":
                yield "gap", at, stop, a, b
            else:
                yield "record", at, *x
            read = b
        if end is None and found[-1][0] == "record":
            yield "gap", at, stop, read, None  # the rest of its text is unknown
        at = stop
    if bad is not None:
        yield "gap", bad, len(content)


def _id(x: str | None) -> int | None:
    x = (x or "").removeprefix("<urn:page:").removesuffix(">")
    found = re.fullmatch(r"-?\d{1,19}", x, re.ASCII)
    return int(x) if found and -(1 << 63) <= int(x) < 1 << 63 else None


def read(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row a record or gap: name, at, kind (record or gap), gap_end, inner_at, inner_end, page_id, record_type, refers_to, payload_digest, payload_bytes, payload."""

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0), b.column(1)):
                rows = []
                for kind, at, x, *body in salvage(content.as_py()):
                    row = {"name": name.as_py(), "at": at, "kind": kind}
                    if kind == "gap":
                        row |= {"gap_end": x, **dict(zip(("inner_at", "inner_end"), body))}
                    else:
                        t, payload = x.get("warc-type"), body[0]
                        same = t == "response"
                        row |= {"page_id": _id(x.get("warc-record-id")), "record_type": t, "refers_to": _id(x.get("warc-refers-to")),
                                "payload_digest": digest(payload) if same else x.get("warc-payload-digest", "").removeprefix("sha1:"), "payload_bytes": len(payload) if same else number(x.get("x-payload-length")), "payload": payload if with_payload else None}
                    rows.append(row)
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("name", pa.string()), ("at", pa.int64()), ("kind", pa.string()), ("gap_end", pa.int64()), ("inner_at", pa.int64()), ("inner_end", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
    return archives.select("name", "content").mapInArrow(run, "name string, at long, kind string, gap_end long, inner_at long, inner_end long, page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")
