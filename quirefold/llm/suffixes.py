"""Exact removal of repeated passages by a logarithmic family of suffix arrays.

A passage of LENGTH bytes is repeated if it also starts earlier: in a document of a smaller doc_id, or earlier in the
same one. Every byte of such a passage goes.

Every suffix is cut at LENGTH bytes. Its anchor is, of the K-grams within these, the one of the least hash, the first of
them. Suffixes that follow each other and have one anchor are a unit: the text from the first to the end of the last.
Equal passages have equal anchors, so only units whose anchor is found elsewhere too can hold repeats; the others are
told by their counts and not read any further. Of units with the same bytes the later ones are repeats as a whole, and
the first goes on. Where more than HOT different units share an anchor, they are parted by the bytes that half of their
suffixes have in common, and these by halves again, down to single suffixes if need be; a unit that shares such bytes
with no other holds no repeats.

The units that are left go into the index by batches, in the order of doc_id. A batch's suffixes are sorted, bucket by
bucket (an anchor is in one bucket), which tells the repeats within the batch; the sorted array is then merged with the
arrays of the earlier levels, which tells the repeats of earlier batches. Then it becomes a level itself: as long as
there is a level of its rank, both are merged into one of the next rank, so that the levels are a logarithmic number.

Order: null doc_id first; documents of one doc_id by a hash of their text; of repeated rows one comes first. Null and
empty texts have no bytes. A text may be of any length. An empty table gives an empty result. Other columns are not used.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm.shared import fresh_path, map_batches, shuffles_removed, stored

LENGTH = 100
K = 24
#: Suffixes, at most, that one anchor stands for.
WINDOW = LENGTH - K + 1
#: Different units of one anchor that one bucket takes.
HOT = 20_000
#: Bytes of units of a bucket, about.
BUCKET = 1 << 19
BATCHES = 4
#: Suffixes of a very long text that are looked at together.
STRETCH = 1 << 20
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
FIRST = -(1 << 63)


def gram_hashes(data: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """A hash of the K-gram at each place of data, or at some of them."""
    words = np.ndarray(max(0, len(data) - 7), "<u8", data, strides=(1,))
    x = np.uint64(0)
    for i, c in enumerate(_C):
        x = (x ^ (words[8 * i : 8 * i + len(data) - K + 1] if at is None else words[at + 8 * i])) * c
        x ^= x >> np.uint64(29)
    return x * _C[0]


def units(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first suffix, number of suffixes, anchor's distance from the first) of the units of a text."""
    parts = []
    for low in range(0, len(data) - LENGTH + 1, STRETCH):
        piece = data[low : low + STRETCH + LENGTH - 1]
        # the hash's upper half, and the place
        m = (gram_hashes(piece) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(piece) - K + 1, dtype=np.uint64)
        size = 1
        while 2 * size <= WINDOW:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        m = np.minimum(m[: len(m) - (WINDOW - size)], m[WINDOW - size :]) & np.uint64(0xFFFFFFFF)
        first = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
        parts.append((first + low, np.diff(first, append=len(m)), m[first].astype(np.int64) - first))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, and its path, so that it can be removed once what follows from it is written."""
    path = fresh_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def texts(df: DataFrame, text: str) -> DataFrame:
    """(doc_id, d, h, g, t): t the bytes; d and h tell documents apart and order them, g is a hash of both."""
    known = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("t"))
    known = known.select("doc_id", F.coalesce("doc_id", F.lit(FIRST)).alias("d"), F.xxhash64("t").alias("h"), "t")
    return known.select("*", F.xxhash64("d", "h").alias("g"))


def anchors(docs: DataFrame) -> DataFrame:
    """(anchor, g, unit) for each unit; unit has its first suffix, their number and the anchor's distance."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                g = b.column("g").slice(at, 64).to_numpy(zero_copy_only=False)
                out = []
                for i, t in enumerate(b.column("t").slice(at, 64)):
                    data = np.frombuffer(t.as_buffer(), np.uint8)
                    start, n, to = units(data)
                    out.append((gram_hashes(data, start + to) if len(start) else start, np.full(len(start), g[i]), (start << 16) | (n << 8) | to))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.uint64).view(np.int64)) for x in zip(*out)], ["anchor", "g", "unit"])

    return docs.where(F.octet_length("t") >= LENGTH).select("g", "t").mapInArrow(run, "anchor long, g long, unit long")


UNIT = "d long, h long, start long, n int, at int, anchor long, bytes binary"
IDENTITY = ["k1", "k2"]


def with_identity(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"k1": F.xxhash64("bytes"), "k2": F.xxhash64(F.lit(1), "bytes")})


def repeated_units(docs: DataFrame) -> tuple[DataFrame, str]:
    """UNIT rows of the units whose anchor is found more than once, and their path."""
    found, path = written(anchors(docs), "anchors")
    often = found.groupBy("anchor").count().where("count > 1").select("anchor")
    wanted = found.join(often, "anchor").groupBy("g").agg(F.collect_list("unit").alias("wanted"))  # as many as the text has units

    def run(batches: Iterable[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            out: dict[str, list] = {c.split()[0]: [] for c in UNIT.split(", ")}
            for d, h, t, w in zip(b["d"], b["h"], b["t"], b["wanted"]):
                u = np.unique(np.array(w, np.int64))
                start, n, at = u >> 16, (u >> 8) & 255, u & 255
                ok = start + n + LENGTH - 1 <= len(t)  # another document's unit where g is the same
                start, n, at = start[ok], n[ok], at[ok]
                own = gram_hashes(np.frombuffer(t, np.uint8), start + at).view(np.int64) if len(start) else start
                ends = (start + n + LENGTH - 1).tolist()
                for c, v in zip(out, ([d] * len(start), [h] * len(start), start.tolist(), n.tolist(), at.tolist(), own.tolist(), [t[a:b] for a, b in zip(start.tolist(), ends)])):
                    out[c] += v
                if len(out["d"]) > 10_000:
                    yield out
                    out = {c: [] for c in out}
            yield out

    made = written(with_identity(map_batches(docs.select("d", "h", "g", "t").join(wanted, "g").select("d", "h", "t", "wanted"), run, UNIT)), "units")
    removed(docs.sparkSession, path)
    return made


def firsts(rows: DataFrame, path: str) -> tuple[DataFrame, str, DataFrame]:
    """Of the units of a table with the same bytes the first, their path, and the spans of the others, repeats as a whole; the table goes."""
    names = ["d", "h", "start"]
    first, first_path = written(rows.groupBy(*IDENTITY).agg(F.min(F.struct(*names, "n", "at", "anchor", "bytes")).alias("f")).select("f.*", *IDENTITY), "firsts")
    known = first.select(*IDENTITY, F.struct(*names).alias("f"))
    later = rows.select(*names, "n", *IDENTITY).join(known, IDENTITY).where(F.struct(*names) != F.col("f"))
    spans = stored(later.select("d", "h", "start", (F.col("start") + F.col("n") + LENGTH - 1).alias("end")), "spans")
    removed(rows.sparkSession, path)
    return first, first_path, spans


def halved(rows: DataFrame, size: int) -> DataFrame:
    """Units cut into those of suffixes that begin in the same stretch of ``size`` bytes before the anchor; the bytes that all of such a stretch have are the new anchor."""

    def run(batches: Iterable[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            out: dict[str, list] = {c.split()[0]: [] for c in UNIT.split(", ")}
            for d, h, start, n, at, anchor, data in zip(*(b[c] for c in out)):
                for k in range((at - n + 1) // size, at // size + 1):
                    far, near = min(at, k * size + size - 1), max(at - n + 1, k * size)
                    skip = at - far
                    own = data[skip : at - near + LENGTH]
                    core = data[at - k * size : at - k * size - size + 1 + LENGTH]
                    name = hashlib.blake2b(core, digest_size=8, key=b"%d %d %d" % (anchor, k, size)).digest()
                    for c, v in zip(out, (d, h, start + skip, far - near + 1, far, int.from_bytes(name, "little", signed=True), own)):
                        out[c].append(v)
            yield out

    return with_identity(map_batches(rows.select(*(c.split()[0] for c in UNIT.split(", "))), run, UNIT))


def parted(first: DataFrame, path: str, hot: int = HOT) -> tuple[DataFrame, list[DataFrame]]:
    """Units of a table that share an anchor with others, no more than ``hot`` of them; and spans of repeats that were found on the way. The table goes."""
    ready, spans, size = [], [], 1 << (WINDOW - 1).bit_length()
    while True:
        counts = first.groupBy("anchor").count().where("count > 1")
        known = stored(first.join(counts, "anchor"), "shared")
        removed(first.sparkSession, path)
        ready.append(known.where(F.col("count") <= hot).drop("count"))
        much = known.where(F.col("count") > hot).drop("count")
        if size == 1 or much.isEmpty():
            return reduce(DataFrame.unionByName, ready), spans
        size //= 2
        first, path, later = firsts(*written(halved(much, size), "halves"))
        spans.append(later)


def passages(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The LENGTH bytes from each place on, as strings that sort like bytes; all are of one length, so that zeros at the end don't matter."""
    if not len(at):
        return np.zeros(0, f"S{LENGTH}")
    return np.lib.stride_tricks.sliding_window_view(text, LENGTH)[at].view(f"S{LENGTH}").ravel()


def suffix_array(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in the order of their passages, equal ones in the order given; and which have the passage of the one before."""
    order = np.argsort(key := passages(text, at), kind="stable")
    key = key[order]
    return order, np.concatenate(([False], key[1:] == key[:-1]))[: len(order)]


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two levels (text, suffix array), each passage once, as one."""
    x, y = passages(*a), passages(*b)
    place = np.searchsorted(x, y)
    new = (place == len(x)) | (x[np.minimum(place, len(x) - 1)] != y) if len(x) else np.ones(len(y), bool)
    return np.concatenate((a[0], b[0])), np.insert(a[1], place[new], b[1][new] + len(a[0]))


def scanned(merge: list[int]):
    """Suffix array of a bucket's new units, spans of those found earlier, and the level that it becomes with those of the ranks to merge."""

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        new = part[part["rank"] < 0].sort_values(["d", "h", "start"])
        levels = {int(r): (np.frombuffer(t, np.uint8), np.frombuffer(s, np.int32)) for r, t, s in zip(part["rank"], part["bytes"], part["sa"]) if r >= 0}
        text = np.frombuffer(b"".join(new["bytes"]), np.uint8)
        n = new["n"].to_numpy(np.int64)
        unit = np.repeat(np.arange(len(n)), n)
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = (np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1))[unit] + j
        order, again = suffix_array(text, at)
        group = np.cumsum(~again) - 1
        heads = order[~again]
        mine = passages(text, at[heads])
        old = np.zeros(len(heads), bool)
        for t, sa in levels.values():
            if len(sa):
                theirs = passages(t, sa)
                place = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
                old |= theirs[place] == mine
        gone = np.zeros(len(at), bool)
        gone[order] = again | old[group]
        # stretches of repeats within a unit
        edge = np.concatenate(([True], (unit[1:] != unit[:-1]) | (gone[1:] != gone[:-1])))[: len(gone)]
        first = np.flatnonzero(edge & gone)
        ends = np.append(np.flatnonzero(edge), len(gone))
        last = ends[np.searchsorted(ends, first, "right")] - 1
        start = new["start"].to_numpy(np.int64)[unit]
        spans = pd.DataFrame({"d": new["d"].to_numpy()[unit[first]], "h": new["h"].to_numpy()[unit[first]], "start": start[first] + j[first], "end": start[first] + j[last] + LENGTH})
        level = (text, at[heads[~old]].astype(np.int32))
        for r in merge:
            if r in levels:
                level = merged(levels[r], level)
        kept = pd.DataFrame({"d": [0], "h": [0], "start": [0], "end": [-1], "bucket": [int(key[0])], "bytes": [level[0].tobytes()], "sa": [level[1].astype(np.int32).tobytes()]})
        out = pd.concat([spans.assign(bucket=0, bytes=None, sa=None), kept])
        return out[["d", "h", "start", "end", "bucket", "bytes", "sa"]]

    return run


def indexed(shared: DataFrame, batches: int = BATCHES, bucket: int = BUCKET) -> list[DataFrame]:
    """Spans (d, h, start, end) of the repeats among units, batch after batch."""
    size = shared.agg(F.sum(F.octet_length("bytes"))).first()[0]
    if not size:
        return []
    buckets = math.ceil(size / bucket)
    bounds = sorted(set(shared.stat.approxQuantile("d", [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    shared = shared.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)).cast("int"))
    edges = [None, *map(int, bounds), None]
    levels: dict[int, DataFrame] = {}
    spans = []
    for low, high in zip(edges, edges[1:]):
        batch = shared.where((F.lit(True) if low is None else F.col("d") > low) & (F.lit(True) if high is None else F.col("d") <= high))
        rows = batch.select("bucket", F.lit(-1).alias("rank"), "d", "h", "start", "n", "bytes", F.lit(None).cast("binary").alias("sa"))
        for r, level in levels.items():
            none = [F.lit(0).cast("long").alias(c) for c in ("d", "h", "start")]  # no nulls, which would make them floats
            rows = rows.unionByName(level.select("bucket", F.lit(r).alias("rank"), *none, F.lit(0).alias("n"), "bytes", "sa"))
        merge = []
        while len(merge) in levels:
            merge.append(len(merge))
        made = stored(rows.groupBy("bucket").applyInPandas(scanned(merge), "d long, h long, start long, end long, bucket int, bytes binary, sa binary"), "level")
        spans.append(made.where("end >= 0").select("d", "h", "start", "end"))
        levels = {r: x for r, x in levels.items() if r not in merge} | {len(merge): made.where("end < 0").select("bucket", "bytes", "sa")}
    return spans


def repeated_spans(docs: DataFrame, batches: int = BATCHES, bucket: int = BUCKET, hot: int = HOT) -> DataFrame:
    """(d, h, start, end): the bytes to remove, in spans that may overlap, of ``texts``."""
    first, path, later = firsts(*repeated_units(docs))
    shared, spans = parted(first, path, hot)
    return reduce(DataFrame.unionByName, [later, *spans, *indexed(shared, batches, bucket)])


def disjoint(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def without_repeats(df: DataFrame, text: str = "text", batches: int = BATCHES, bucket: int = BUCKET, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): of each text its removed spans, apart from each other, and the bytes left."""
    docs = texts(df, text)
    found = repeated_spans(docs, batches, bucket, hot).groupBy("d", "h").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("found"))
    # of rows that are the same one is the first
    rows = docs.select("doc_id", "d", "h", "t").join(found, ["d", "h"], "left")

    def run(batches_: Iterable[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches_:
            spans = [disjoint([(x["start"], x["end"]) for x in f or []]) for f in b["found"]]
            kept = []
            for t, s in zip(b["t"], spans):
                at = [0, *(x for ab in s for x in ab), len(t)]
                kept.append(b"".join(t[a:b] for a, b in zip(at[::2], at[1::2])))
            yield {"doc_id": b["doc_id"], "h": b["h"], "n_bytes": [len(t) for t in b["t"]], "spans": [[{"start": x, "end": y} for x, y in s] for s in spans], "kept": kept}

    return map_batches(rows.select("doc_id", "h", "t", "found"), run, "doc_id long, h long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def removal_report(df: DataFrame, text: str = "text", batches: int = BATCHES, bucket: int = BUCKET, hot: int = HOT) -> DataFrame:
    """Bytes, removed bytes and spans of each document, and the digest of what is left."""
    out = without_repeats(df, text, batches, bucket, hot)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    each = out.select("doc_id", "h", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    each = each.groupBy(*each.columns).agg(F.count("*").cast("int").alias("rows")).select("*", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("k"))
    again = (F.col("k") > 1) & (F.col("n_bytes") >= LENGTH)
    return each.select("doc_id", "n_bytes", F.when(again, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(again, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"), F.when(again, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents, removed."""
    return removal_report(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL_OP11 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, i, substr(x, 2 * i + 1, 200) AS s FROM (SELECT doc_id, x, unnest(range(length(x) // 2 - 99)) AS i FROM d WHERE length(x) >= 200)),
e AS (SELECT doc_id, i FROM p QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 100 THEN 0 ELSE 1 END AS apart FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, i, sum(apart) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g),
r AS (SELECT doc_id, k, min(i) AS a, max(i) + 100 AS b FROM k GROUP BY doc_id, k),
s AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a) AS n, count(*) AS m FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(m, 0) AS n_spans,
       sha256(unhex(CASE WHEN m IS NULL THEN x ELSE array_to_string(list_transform(range(m + 1), lambda j: substr(x, CASE WHEN j = 0 THEN 1 ELSE 2 * b[j] + 1 END, CASE WHEN j = m THEN length(x) ELSE 2 * a[j + 1] - CASE WHEN j = 0 THEN 0 ELSE 2 * b[j] END END)), '') END)) AS kept_sha256
FROM d LEFT JOIN s ON s.doc_id = d.doc_id
"""
