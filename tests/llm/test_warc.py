import gzip
import hashlib
import io
from collections import defaultdict

from pyspark.sql import functions as F

from quirefold.llm import files, warc
from quirefold.llm.shared import fresh_path


def pages(spark):
    big = "x" * 2000
    rows = [(1, "http://a/1", big), (2, "http://a/\r\n2", big), (3, None, "small"), (4, "http://a/4", "small"), (5, "http://a/5", None), (None, "http://a/n", big), (7, "u", "é" * 600), (7, "u", "é" * 600), (8, "v", "y" * 3_000_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))


def test_edges(spark):
    path = fresh_path(spark, "w")
    warc.write_warc(warc.page_records(pages(spark)), path)
    rows = {r.record_id + r.warc_type: r for r in warc.read_warc(spark, path).collect()}
    assert rows["<urn:page:1>revisit"].refers_to == "<urn:page:2>" == rows["<urn:page:>revisit"].refers_to
    assert rows["<urn:page:2>response"].target_uri == "http://a/ 2" and rows["<urn:page:3>response"].target_uri is None
    assert rows["<urn:page:5>response"].payload_length == 0 and bytes(rows["<urn:page:7>response"].payload) == ("é" * 600).encode()
    assert rows["<urn:page:1>revisit"].payload_length == 2000 and not rows["<urn:page:1>revisit"].payload
    assert len(rows["<urn:page:8>response"].payload) == 3_000_000 and warc.read_warc(spark, path).count() == 9
    assert warc.read_warc(spark, path, payload=False).count() == 9
    empty = fresh_path(spark, "w")
    warc.write_warc(warc.page_records(pages(spark).limit(0)), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_filters_are_pushed_and_payloads_skipped(spark):
    path = fresh_path(spark, "w")
    warc.write_warc(warc.page_records(pages(spark)), path)
    df = warc.read_warc(spark, path).where("warc_type = 'revisit' and target_uri in ('http://a/1', 'http://a/9')")
    assert [r.record_id for r in df.collect()] == ["<urn:page:1>"]
    reader = warc.WarcReader(path, df.schema)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("warc_type",), "revisit"), GreaterThan(("payload_length",), 3)]))
    assert len(left) == 1 and reader.wanted == {"warc_type": {"revisit"}}
    entry = files.read_manifests(path)[0]
    raw = open(f"{path}/{entry['file']}".replace("file:", ""), "rb").read()
    big = [x for x in range(len(raw)) if raw[x : x + 4] == b"\x1f\x8b\x08\x04"]
    for at in big:
        plain = warc.Plain(io.BytesIO(raw), at, True)
        warc.split_head(plain)
        assert len(plain.got) < 3_000_000 and plain.after() == at + plain.size


def test_foreign_archives(spark, tmp_path):
    one = warc.record({"warc_type": "response", "record_id": "<urn:x:1>", "warc_date": "d", "target_uri": "u", "refers_to": None, "payload_digest": "00" * 20, "payload_length": 3, "payload": b"abc"})
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x:0>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(info + one)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(one))
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted((r.record_id, bytes(r.payload)) for r in rows) == [("<urn:x:0>", b"hello")] * 2 + [("<urn:x:1>", b"abc")] * 2


def test_query(spark, sf):
    groups, want = defaultdict(list), {}
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    for r in rows:
        groups[(r.html or "").encode()].append(r.page_id)
    for payload, ids in groups.items():
        for i in ids:
            again = len(payload) >= 1000 and i != max(ids)
            want[i] = (len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", max(ids) if again else None)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op5_warc(spark, sf).collect()}
    assert got == want
