"""WARC archives as a PySpark data source.

Writing: each task writes a file of records, each a gzip member of its own, whose extra field "sl" gives its
compressed and plain length. The manifest lists the committed files with places at which they can be cut.

Reading: stretches of files are the partitions. Of a record the headers are parsed first; a record that the pushed
filters on type and headers rule out, or whose payload isn't in the schema, is left at that, and the reader goes on to
the next one by the length in the extra field (or Content-Length in plain files) without decoding the payload. Files
without a manifest or extra fields, .warc or .warc.gz, can be read as well, a file in a partition.

A null payload is empty. A null target has no header and is read as null. Line ends in header values become blanks.
Pages: a null html is empty; a null page_id is written without a number and read as null, and never has the largest
page_id beside others; rows of equal page_id and payload are all responses if they have the largest page_id. Other
columns are not written. An empty table gives no files and reads as empty.
"""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from quirefold.llm import files
from quirefold.llm.shared import fresh_path

PART_BYTES = 16 << 20
BATCH_BYTES = 8 << 20
LEVEL = 4
SAME_FROM = 1000
MEMBER = struct.Struct("<4sIBBH2sHII")
SCHEMA = "record_id string, warc_type string, target_uri string, warc_date string, refers_to string, payload_digest string, payload_length long, payload binary"
#: Header of each column that filters can be pushed to.
HEADERS = {"record_id": "WARC-Record-ID", "warc_type": "WARC-Type", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def member(raw: bytes) -> bytes:
    """raw as a gzip member with its lengths in the extra field."""
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    size = MEMBER.size + len(body) + 8
    return MEMBER.pack(b"\x1f\x8b\x08\x04", 0, 0, 255, 12, b"sl", 8, size, len(raw)) + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def record(row: dict) -> bytes:
    """The plain bytes of a record whose block is an HTTP response; a revisit's has no body."""
    payload = b"" if row["warc_type"] == "revisit" else row["payload"] or b""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_length"] + payload
    digest = row["payload_digest"] and "sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    fields = [
        ("WARC-Type", row["warc_type"]),
        ("WARC-Record-ID", row["record_id"]),
        ("WARC-Date", row["warc_date"]),
        ("WARC-Target-URI", row["target_uri"]),
        ("WARC-Payload-Digest", digest),
        ("WARC-Refers-To", row["refers_to"]),
        ("WARC-Profile", IDENTICAL if row["warc_type"] == "revisit" else None),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{k}: {' '.join(v.splitlines())}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


class Warc(DataSource):
    """Format quirefold_warc. Option path: a folder of archives."""

    @classmethod
    def name(cls) -> str:
        return "quirefold_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], schema)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"])


class Written(WriterCommitMessage):
    def __init__(self, entry: dict):
        self.entry = entry


class WarcWriter(DataSourceArrowWriter):
    """Rows of SCHEMA to archives; each attempt of a task has a file of its own."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        file = files.attempt_name(".warc.gz")
        where, name = files.at(f"{self.path}/{file}")
        out, at, parts = None, 0, []
        for batch in iterator:
            for start in range(0, batch.num_rows, 256):
                for row in batch.slice(start, 256).to_pylist():
                    out = out or where.open_output_stream(name, compression=None)
                    raw = member(record(row))
                    out.write(raw)
                    if not parts or parts[-1][1] - parts[-1][0] > PART_BYTES:
                        parts.append([at, at])
                    at += len(raw)
                    parts[-1][1] = at
        if out:
            out.close()
        return Written({"file": file, "parts": parts} if out else {})

    def commit(self, messages):
        files.write_manifest(self.path, [m.entry for m in messages if m and m.entry])

    def abort(self, messages):
        files.drop_files(self.path, [m.entry["file"] for m in messages if m and m.entry])


class FilePart(InputPartition):
    def __init__(self, file: str, begin: int, end: int):
        self.file, self.begin, self.end = file, begin, end


class Plain:
    """A member's or a plain file's bytes from some place on, read as far as asked for."""

    def __init__(self, src, begin: int, packed: bool):
        self.src, self.begin, self.packed = src, begin, packed
        self.inflate = zlib.decompressobj(31) if packed else None
        self.got, self.size = b"", None
        src.seek(begin)
        if packed:
            first = src.read(MEMBER.size)
            if len(first) == MEMBER.size and first[3] == 4 and MEMBER.unpack(first)[5] == b"sl":
                self.size = MEMBER.unpack(first)[7]
            self.rest = first

    def more(self, least: int) -> bool:
        """Whether at least ``least`` bytes are there now, or fewer as the record ends."""
        while len(self.got) < least:
            if not self.packed:
                part = self.src.read(max(least - len(self.got), 1 << 12))
                if not part:
                    return False
                self.got += part
                continue
            if self.inflate.eof:
                return False
            raw = self.rest or self.src.read(min(max(1 << 11, (least - len(self.got)) // 2), 1 << 20))
            self.rest = b""
            if not raw:
                return False
            self.got += self.inflate.decompress(raw)
        return True

    def after(self) -> int:
        """Where the next member begins."""
        if self.size is None:
            while self.more(len(self.got) + 1):
                pass
            return self.src.tell() - len(self.inflate.unused_data)
        return self.begin + self.size


def split_head(plain: Plain) -> tuple[dict[str, str], int] | None:
    """Headers by lower-case name, and where the block begins."""
    least = 1
    while (end := plain.got.find(b"\r\n\r\n")) < 0:
        least = len(plain.got) + 1
        if not plain.more(least):
            return None
    lines = plain.got[:end].decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, end + 4


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema):
        self.path, self.fields, self.wanted = path, schema, {}

    def pushFilters(self, filters):
        """Takes equalities and lists of values of header columns; returns the other filters to Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            elif not (column in HEADERS and isinstance(f, IsNotNull) and self.wanted.get(column)):
                yield f

    def partitions(self):
        where, name = files.at(self.path)
        if not where.get_file_info(name).is_file and (known := files.read_manifests(self.path)):
            return [FilePart(f"{self.path}/{x['file']}", a, b) for x in known for a, b in x["parts"]]
        from pyarrow import fs

        found = [where.get_file_info(name)] if where.get_file_info(name).is_file else where.get_file_info(fs.FileSelector(name))
        scheme = self.path[: len(self.path) - len(name)] if self.path.endswith(name) else ""
        return [FilePart(scheme + x.path, 0, x.size) for x in found if x.path.endswith((".warc", ".warc.gz"))] or [FilePart("", 0, 0)]

    def value(self, headers: dict[str, str], column: str) -> str | None:
        v = headers.get(HEADERS[column].lower())
        if column == "payload_digest" and v and v.lower().startswith("sha1:"):
            code = v[5:]
            return code.lower() if len(code) == 40 else base64.b32decode(code).hex()
        return v

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_schema(self.fields)
        names = self.fields.names
        rows: list[list] = []
        size = 0
        for row in self.records(partition, "payload" in names) if partition.file else ():
            rows.append([row[c] for c in names])
            size += 200 + len(row.get("payload") or b"")
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)

    def records(self, part: FilePart, with_payload: bool) -> Iterator[dict]:
        where, name = files.at(part.file)
        packed, at = part.file.endswith(".gz"), part.begin
        with where.open_input_file(name) as src:
            while at < part.end:
                plain = Plain(src, at, packed)
                head = split_head(plain)
                if head is None:
                    return
                headers, begin = head
                length = int(headers.get("content-length", 0))
                row = {c: self.value(headers, c) for c in HEADERS}
                if all(row[c] in values for c, values in self.wanted.items()):
                    yield row | self.block(plain, headers, begin, length, with_payload)
                at = plain.after() if packed else at + begin + length + 4

    @staticmethod
    def block(plain: Plain, headers: dict[str, str], begin: int, length: int, with_payload: bool) -> dict:
        """Length of the payload and, if asked for, the payload: the body of a HTTP block, or else the whole block."""
        if not headers.get("content-type", "").startswith("application/http"):
            plain.more(begin + length if with_payload else 0)
            return {"payload_length": length, "payload": plain.got[begin : begin + length] if with_payload else None}
        while (end := plain.got.find(b"\r\n\r\n", begin, begin + length)) < 0 and plain.more(len(plain.got) + 1):
            pass
        http = plain.got[begin:end].decode("latin-1").lower().split("\r\n")
        told = next((int(x.partition(":")[2]) for x in http if x.startswith("content-length:")), begin + length - end - 4)
        if with_payload:
            plain.more(begin + length)
        return {"payload_length": told, "payload": plain.got[end + 4 : begin + length] if with_payload else None}


def write_warc(df: DataFrame, path: str) -> None:
    """df (columns of SCHEMA) to archives in the folder path."""
    spark = df.sparkSession
    spark.dataSource.register(Warc)
    where, name = files.at(path)
    where.create_dir(name)
    df.select(*[x.split()[0] for x in SCHEMA.split(", ")]).write.format("quirefold_warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the archives in path, by SCHEMA; without payloads they aren't decoded."""
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("quirefold_warc").schema(SCHEMA if payload else SCHEMA.rsplit(", ", 1)[0]).load(path)


def page_records(pages: DataFrame, same_from: int = SAME_FROM, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Records (SCHEMA) of pages (page_id, url, html): of equal payloads all but that of the largest page_id revisit it."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("payload")).select("*", F.sha1("payload").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_length"))
    again = rows.where(F.col("payload_length") >= same_from).groupBy("payload_digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select(F.col("payload_digest").alias("_digest"), "last")
    rows = rows.join(again, (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_length") >= same_from), "left")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("last")) & F.col("last").isNotNull(), F.lit(False))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    return rows.select(
        name(F.col("page_id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("warc_type"), F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"),
        F.when(revisit, name(F.col("last"))).alias("refers_to"), "payload_digest", "payload_length", F.when(~revisit, F.col("payload")).alias("payload"),
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as WARC records, reads the archives back and returns what they say of each page."""
    path = fresh_path(spark, "warc")
    write_warc(page_records(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")), path)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    # by pushed predicates; a revisit tells all by its headers, so no payload is decoded for it
    responses = read_warc(spark, path).where("warc_type = 'response'").withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    revisits = read_warc(spark, path, payload=False).where("warc_type = 'revisit'").withColumn("payload_bytes", F.col("payload_length"))
    columns = ["record_id", "payload_bytes", "payload_digest", "warc_type", "refers_to", "target_uri"]
    both = responses.select(*columns).unionByName(revisits.select(*columns))
    return both.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), page("refers_to").alias("refers_to"), F.col("target_uri").alias("url"))


SQL_OP5 = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, url, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
     g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to, url
FROM g
"""
