"""Archives damaged anywhere, and headers of any length."""

import gzip
import random

import pytest

from walkloom.llm import warc


def archive(n=3):
    return [warc.record(k, f"http://a/{k}", f"text {k}".encode(), warc.digest(f"text {k}".encode()), "response" if k < 2 else "revisit", 7) for k in range(n)]


@pytest.fixture(scope="module")
def damaged():
    """Each byte of a small archive flipped, plain and compressed; each length it can be cut to; and numbers that are none."""
    packed = b"".join(archive())
    plain = gzip.decompress(packed)
    out = []
    for whole in (plain, packed):
        for k in range(len(whole)):
            hurt = bytearray(whole)
            hurt[k] ^= random.Random(k).choice([1, 2, 16, 128, 255])
            out += [bytes(hurt), whole[:k]]
    for old in (b"X-Payload-Length: 6", b"Content-Length: 6", b"<urn:page:1>", b"<urn:page:7>", b"\r\nWARC-Type"):
        for new in (b"?", b"\xc2\xb2", b"--5", b"+5", b" 6", b"1e3", b"-1", b"9" * 30, b"", "٣".encode(), b"0x6", b"6 6", b"6_6"):
            name, sep, _ = old.partition(b": ") if b": " in old else (b"<urn:page:", b"", b"")
            out.append(plain.replace(old, (name + sep + new) + (b">" if b"urn" in old else b""), 1))
    return out


def test_never_raises(spark, damaged):
    rows = [(str(k), x) for k, x in enumerate(damaged)]
    got = warc.read(spark.createDataFrame(rows, "name string, content binary").repartition(8)).collect()
    assert {r["name"] for r in got} == {str(k) for k, x in enumerate(damaged) if x}
    whole = {(0, "response"), (1, "response"), (2, "revisit")}
    by = {}
    for r in got:
        by.setdefault(r["name"], []).append(r)
    # One flipped byte costs one record at most; gaps and records don't overlap.
    sound = sum(len({(r["page_id"], r["record_type"]) for r in x if r["kind"] == "record"} & whole) >= 2 for x in by.values())
    assert sound > 0.55 * len(by)
    assert all(r["gap_end"] > r["at"] for r in got if r["kind"] == "gap")


@pytest.mark.parametrize("x, want", [("5", 5), ("0", 0), ("", None), (None, None), ("?", None), ("²", None), ("--5", None), ("-5", None), (" 5", None), ("5\n", None), ("٣", None), ("9" * 18, int("9" * 18)), ("9" * 30, None)])
def test_number(x, want):
    assert warc.number(x) == want


@pytest.mark.parametrize("x, want", [("<urn:page:-3>", -3), ("<urn:page:null>", None), ("<urn:page:²>", None), ("<urn:page:--5>", None), (None, None), ("<urn:page:99999999999999999999>", None), ("<urn:page:9223372036854775807>", 2**63 - 1)])
def test_id(x, want):
    assert warc._id(x) == want


def test_long_headers(spark):
    """A URL of 2 MiB comes back, also after damage before it."""
    url = "http://a/" + "x" * (2 << 20)
    pages = spark.createDataFrame([(1, url, "p"), (2, "http://b/WARC/1.1", "q")], "page_id long, url string, html string")
    got = warc.read(warc.write(warc.plan_records(pages))).collect()
    assert {(r["page_id"], r["kind"], r["payload_bytes"]) for r in got} == {(1, "record", 1), (2, "record", 1)}
    long = warc.record(1, url, b"p", warc.digest(b"p"), "response", None)
    out = list(warc.salvage(b"WARC/1.1\r\nWARC-Type: x\r\n" * 1000 + gzip.decompress(long)))
    assert [x[0] for x in out] == ["gap", "record"] and out[1][2]["warc-target-uri"] == url


def test_rows_that_change(spark):
    """Rows whose numbers could differ from reading to reading are written first: a limit, a shuffle, a random filter."""
    pages = spark.createDataFrame([(k % 4, "u", f"p{k % 3}") for k in range(60)], "page_id long, url string, html string")
    path = warc.shared_dir(spark) + "/numbered"
    pages.write.mode("overwrite").parquet(path)
    scan = spark.read.parquet(path)
    assert warc._numbered_alike(scan.filter("page_id >= 0").select("page_id", "url", "html"))
    for odd in (pages, scan.limit(50), scan.coalesce(1), scan.filter("rand() < 0.999999999"), scan.union(scan)):
        assert not warc._numbered_alike(odd)
        n = odd.count()
        got = warc.read(warc.write(warc.plan_records(odd))).collect()
        assert sum(r["record_type"] == "response" for r in got) == 3 and len(got) == n
