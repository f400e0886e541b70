"""op8: archives, read back, pushed-down filters and payloads that are stepped over."""

import base64
import gzip
import hashlib
import io
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, StringStartsWith

from terrapatch.llm import queries, warc

from .conftest import SF


def brute(rows, least=0):
    first = {}
    for i, h in rows:
        p = (h or "").encode()
        if len(p) >= least and i is not None:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, h in rows:
        p = (h or "").encode()
        again = p in first and first[p] != i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", first[p] if again else None))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1:3]))


def result(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1:3]))


KIND = "page_id long, url string, html string, payload string, record_id string, sha string, n int"
ROWS = [(1, "http://a/", "<p>é</p>"), (2, "http://b/\r\nX: y", "<p>é</p>"), (0, None, "<p>é</p>"), (3, "http://c/", None), (4, "", ""), (5, "http://d/", "x" * 300_000 + "\r\n\r\nWARC/1.1\r\n"), (6, "http://e/", "\r\n\r\n"), (7, "http://f/", "x" * 300_000 + "\r\n\r\nWARC/1.1\r\n"), (8, "http://g/", "\u0000"), (None, "http://h/", "no id"), (9, "http://h/", "no id")]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*r, "p", "r", "s", 1) for r in ROWS], KIND).repartition(3)


def test_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()
    assert result(queries.op8_warc(spark, SF)) == brute(rows)


def test_sql_says_the_same(spark):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    names = [c for c in queries.op8_warc(spark, SF).columns]
    want = db.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLE['op8_warc']})").fetchall()
    assert result(queries.op8_warc(spark, SF)) == sorted(want)


def test_revisits_are_read_without_payloads(spark, pages, tmp_path):
    """Each of the two scans has its filter pushed to the source, and only that of responses asks for payloads."""
    warc.archived(pages, str(tmp_path))
    plan = warc.read_back(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "BatchScan" in line]
    assert len(scans) == 2 and sum("payload#" in x for x in scans) == 1 and "Filter (" not in plan


@pytest.mark.parametrize("least", [0, 10])
def test_odd_rows(spark, pages, tmp_path, least):
    warc.archived(pages, str(tmp_path), least=least)
    assert result(warc.read_back(spark, str(tmp_path))) == brute([(i, h) for i, _, h in ROWS], least)


def test_empty_table(spark, pages, tmp_path):
    warc.archived(pages.limit(0), str(tmp_path))
    assert warc.read_back(spark, str(tmp_path)).collect() == []


def parsed(data):
    """(headers, block) of the records of an archive, by a plain parser."""
    out, f = [], io.BytesIO(data)
    while line := f.readline():
        assert line == b"WARC/1.1\r\n"
        head = {}
        while (line := f.readline()) != b"\r\n":
            k, _, v = line.decode().partition(": ")
            head[k] = v.rstrip("\r\n")
        block = f.read(int(head["Content-Length"]))
        assert f.read(4) == b"\r\n\r\n"
        out.append((head, block))
    return out


def test_files_are_warc(spark, pages, tmp_path):
    """Any gzip reader sees records with the headers of the format, whose blocks hold the payloads; each record is a member."""
    warc.archived(pages, str(tmp_path))
    records = [r for p in tmp_path.glob("*.warc.gz") for r in parsed(gzip.decompress(p.read_bytes()))]
    assert len(records) == len(ROWS)
    by = {h["WARC-Record-ID"]: (h, b) for h, b in records}
    for i, _, html in ROWS:
        head, block = by[f"<urn:x-page:{'' if i is None else i}>"]
        http, _, body = block.partition(b"\r\n\r\n")
        assert http.startswith(b"HTTP/1.1 200 OK")
        if head["WARC-Type"] == "response":
            assert body == (html or "").encode()
            assert head["WARC-Payload-Digest"] == "sha1:" + warc.base32_sha1(body)
        else:
            assert body == b"" and head["WARC-Refers-To"] in by
    assert not list(tmp_path.glob("_temporary*"))


def test_filters_are_pushed_down():
    reader = warc.WarcReader("x", ["record_type"])
    rest = list(reader.pushFilters([EqualTo(("record_type",), "response"), In(("target_uri",), ("a", "b")), StringStartsWith(("target_uri",), "a"), IsNotNull(("refers_to",)), GreaterThan(("content_length",), 5)]))
    assert [type(f) for f in rest] == [GreaterThan]
    assert reader.wanted({"record_type": "response", "target_uri": "a", "refers_to": "x"})
    assert not reader.wanted({"record_type": "revisit", "target_uri": "a", "refers_to": "x"})
    assert not reader.wanted({"record_type": "response", "target_uri": "b", "refers_to": "x"})
    assert not reader.wanted({"record_type": "response", "target_uri": "a"})


@pytest.mark.parametrize("zipped", ["true", "false"])
def test_filtered_reads_equal_filtered_rows(spark, pages, tmp_path, zipped):
    warc.register(spark)
    rows = pages.select(F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")).alias("record_id"), F.when(F.col("page_id") % 2 == 0, "response").otherwise("warcinfo").alias("record_type"), F.col("url").alias("target_uri"), F.lit("2026-01-01T00:00:00Z").alias("date"), F.lit("D").alias("payload_digest"), F.lit(None).cast("string").alias("refers_to"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    path = str(tmp_path / zipped)
    rows.write.format("warc").option("zip", zipped).mode("append").save(path)
    read = spark.read.format("warc").schema(warc.READ).load(path)
    want = sorted((r["record_id"], bytes(r["payload"])) for r in rows.where("record_type = 'response'").collect())
    assert sorted((r["record_id"], bytes(r["payload"])) for r in read.where("record_type = 'response'").select("record_id", "payload").collect()) == want
    assert read.where("target_uri LIKE 'http://a%'").count() == 1
    assert read.where("record_type = 'response' AND target_uri IN ('http://g/', 'http://f/')").count() == 1


def test_unwanted_payloads_are_not_read(tmp_path):
    """Of a record that a filter rejects, and of any record if no payload is asked for, the block is stepped over."""
    big = warc.record({"record_type": "response", "record_id": "<a>", "payload": b"z" * 5_000_000})
    small = warc.record({"record_type": "revisit", "record_id": "<b>", "payload": b""})
    (tmp_path / "x.warc").write_bytes(big + small)

    class Counting:
        def __init__(self, raw):
            self.raw, self.n = raw, 0

        def read(self, n=-1):
            out = self.raw.read(n)
            self.n += len(out)
            return out

        def seek(self, *a):
            return self.raw.seek(*a)

        def tell(self):
            return self.raw.tell()

    for fields, tests, n in ((["record_id"], [], 2), (["record_id", "payload"], [("record_type", "in", ("revisit",))], 1)):
        reader = warc.WarcReader(str(tmp_path), fields)
        reader.tests = tests
        with open(tmp_path / "x.warc", "rb") as f:
            raw = Counting(f)
            assert len(list(reader.records(warc._Seekable(raw)))) == n
            assert raw.n < 1_100_000
    zipped = warc.member(big)
    stream = warc._Member(io.BytesIO(zipped[24:]), len(zipped) - 32)
    reader.tests = [("record_type", "in", ("revisit",))]
    assert list(reader.records(stream)) == []


def test_other_gzip_archives_are_read(spark, tmp_path):
    """Files of other writers: one gzip stream, or members without a length."""
    warc.register(spark)
    one = warc.record({"record_type": "response", "record_id": "<a>", "payload": b"A"})
    two = warc.record({"record_type": "response", "record_id": "<b>", "payload": b"B"})
    Path(tmp_path / "a.warc.gz").write_bytes(gzip.compress(one + two))
    Path(tmp_path / "b.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    Path(tmp_path / "c.warc").write_bytes(one + two)
    read = spark.read.format("warc").schema(warc.READ).load(str(tmp_path))
    assert sorted(bytes(r["payload"]) for r in read.select("payload").collect()) == [b"A", b"A", b"A", b"B", b"B", b"B"]


def test_partitions_follow_the_files(tmp_path, monkeypatch):
    for k in range(6):
        (tmp_path / f"{k}.warc").write_bytes(b"x" * 100)
    reader = warc.WarcReader(str(tmp_path), [])
    assert [len(p.paths) for p in reader.partitions()] == [6]
    monkeypatch.setattr(warc, "TOGETHER", 250)
    assert [len(p.paths) for p in reader.partitions()] == [2, 2, 2]


def test_base32(spark):
    df = spark.createDataFrame([(b"",), (b"abc",), (("é" * 50).encode(),)], "p binary")
    for r in df.select("p", warc.base32(F.sha1("p")).alias("d")).collect():
        assert r["d"] == warc.base32_sha1(bytes(r["p"]))
