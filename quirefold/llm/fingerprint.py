"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the K smallest 64-bit hashes of a text's distinct shingles (five words; a shorter text is one shingle).
Sketches of parts merge into that of the whole by taking the K smallest of both. From two sketches follow estimates of
resemblance and containment, from one the number of distinct shingles; all are exact below K shingles.

A fingerprint as a string is the sketch's hashes in ascending order, 16 hex digits each. A null or empty text, or one
of white space alone, has the empty fingerprint; two empty fingerprints are alike (1), an empty and another one are
not (0). Very long texts are sketched in parts, whose
sketches are merged. Repeated rows keep their order by text; null doc_ids come first. An empty table gives an empty result. Other columns are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm.shared import map_batches

SHINGLE = 5
K = 128
#: Words of a part of a very long text.
STRETCH = 100_000
CACHE = 500_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on each other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of each word, remembered for up to CACHE words."""

    def __missing__(self, word: str) -> int:
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        if len(self) >= CACHE:
            self.clear()
        self[word] = h
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A hash for each run of ``size`` words, given their hashes; one for all words where there are fewer."""
    n = len(words)
    if not n:
        return words
    size = min(size, n)
    out = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        out = mixed(out + words[i : n - size + 1 + i] * _MIX[i % len(_MIX)] + np.uint64(i + 1))
    return out


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct hashes, ascending."""
    if len(hashes) > 4 * k:
        # the smallest ones, with room for repeats; all of them where repeats leave too few
        few = np.unique(np.partition(hashes, 4 * k)[: 4 * k])
        if len(few) >= k:
            return few[:k]
    return np.unique(hashes)[:k]


def sketch_of(words: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of a text, given its words' hashes; very long ones part by part, the parts' sketches merged."""
    out = sketch(shingle_hashes(words[:STRETCH]), k)
    for at in range(STRETCH - SHINGLE + 1, len(words) - SHINGLE + 1, STRETCH - SHINGLE + 1):
        out = merge(out, sketch(shingle_hashes(words[at : at + STRETCH]), k), k)
    return out


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of two parts together."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def _union(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    u = merge(a, b, k)
    return u, int(np.isin(np.intersect1d(a, b, assume_unique=True), u, assume_unique=True).sum())


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the shingles of either text that both have."""
    u, both = _union(a, b, k)
    return both / len(u) if len(u) else 1.0


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the first text's shingles that the second has."""
    u, both = _union(a, b, k)
    if not len(a):
        return 1.0
    return min(1.0, both / len(u) * distinct(u, k) / distinct(a, k))


def as_text(a: np.ndarray) -> str:
    return a.astype(">u8").tobytes().hex()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u8").astype(np.uint64)


def fingerprints(df: DataFrame, text: str = "text", k: int = K) -> DataFrame:
    """df with ``fingerprint`` (string) and ``n_shingles`` (estimate); own columns of these names, in any case of letters, are replaced."""
    from pyspark.sql import types as T

    keep = [c for c in df.columns if c.lower() not in ("fingerprint", "n_shingles")]

    def run(batches: Iterable[dict[str, list]]):
        words = WordHashes()
        for b in batches:
            made = [sketch_of(words.of((t or "").split()), k) for t in b[text]]
            yield {c: b[c] for c in keep} | {"fingerprint": [as_text(x) for x in made], "n_shingles": [distinct(x, k) for x in made]}

    return map_batches(df.select(*keep), run, T.StructType([*(df.schema[c] for c in keep), T.StructField("fingerprint", T.StringType()), T.StructField("n_shingles", T.DoubleType())]))


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, within_edited double"


def edited_fingerprints(df: DataFrame, k: int = K) -> DataFrame:
    """For each of df's documents its fingerprint, that of its edited text and its likeness to that and the next document's.

    The edited text ends with the next document's beginning. Documents are dealt out by ranges of doc_id and sorted
    there, each text once; a range's first document also goes to the range before, whose last document it follows.
    What the driver holds are the ranges' bounds and first doc_ids, two numbers for each partition.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = np.unique(np.array(docs.stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts), np.float64))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(bounds, ids.fillna(0).astype(np.float64), "right"))).astype("int32")

    ranged = docs.withColumn("range", range_of("doc_id"))
    # null, if there, is the first range's first doc_id
    heads = ranged.groupBy("range").agg(F.min("doc_id").alias("least"), F.bool_or(F.col("doc_id").isNull()).alias("nulls")).orderBy("range").collect()
    if not heads:
        return spark.createDataFrame([], EDITED)
    firsts = {None if r.nulls else r.least: heads[i - 1].range for i, r in enumerate(heads)}

    @F.pandas_udf("int")
    def range_before(ids: pd.Series) -> pd.Series:
        return pd.Series([firsts.get(None if pd.isna(x) else int(x)) for x in ids], dtype="Int32")

    before = F.when(F.col("doc_id").isNull() | F.col("doc_id").isin([x for x in firsts if x is not None]), range_before("doc_id"))
    place = F.array_compact(F.array(F.struct("range", F.lit(False).alias("edge")), F.when(before.isNotNull(), F.struct(before.alias("range"), F.lit(True).alias("edge")))))
    dealt = ranged.select("doc_id", "text", F.inline(place).alias("range", "edge")).repartitionById(max(r.range for r in heads) + 1, "range")
    dealt = dealt.sortWithinPartitions("range", "edge", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")

    def run(batches: Iterable[dict[str, list]]):
        words, held, over = WordHashes(), None, False
        for b in batches:
            cols: dict[str, list] = {c.split()[0]: [] for c in EDITED.split(", ")}
            for doc_id, text, edge in zip(b["doc_id"], b["text"], b["edge"]):
                if over:
                    break  # further rows of the next document's doc_id
                now = (doc_id, text, sketch_of(words.of(text.split()), k))
                if held:
                    was, t, p = held
                    edited = t[: len(t) - len(t) // 2] + text[: len(t) // 2]
                    e = sketch_of(words.of(edited.split()), k)
                    row = (was, len(t), hashlib.sha256(edited.encode()).hexdigest(), as_text(p), as_text(e), resemblance(p, e, k), resemblance(p, now[2], k), distinct(p, k), containment(p, e, k))
                    for c, v in zip(cols, row):
                        cols[c].append(v)
                held, over = now, edge
            yield cols

    return map_batches(dealt.select("doc_id", "text", "edge"), run, EDITED)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts."""
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
