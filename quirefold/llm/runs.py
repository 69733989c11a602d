"""Periodic runs of words, found by seeds on diagonals.

A run is a stretch of consecutive words whose smallest period is q (words q apart are the same) and whose length is at
least LEAST and POWERS * q, that no neighbouring word extends keeping the period. Two copies of a run, q apart, overlap
in length - q words; the least such overlap of all periods from 2^j to 2^(j+1) - 1 is the size of the k-grams that are
indexed for them. As this is more than any of these periods, and the rotations of a smallest period differ, a k-gram of
a run comes next q words on: only occurrences that follow each other are paired, so the pairs of one size are no more
than the words. A pair is a seed on the diagonal of its lag. It is extended to both sides as far as words q apart are
the same, unless the table of the furthest word covered on its lag shows that it lies in an earlier extension.

k-grams are numbered exactly, by pairs of numbers of shorter ones. A document without two equal 5-grams has no run.

Null and empty texts, and those of white space alone, have no words. A null doc_id makes no periodic words. Texts of any
length are worked on whole, one document in memory at a time. Repeated rows give repeated results; an empty table an
empty one. Other columns are not used.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm.shared import map_batches

LEAST = 6
POWERS = 4
#: Words compared at once at first when a seed is extended; doubled as long as they are the same.
STEP = 64


def overlap(q: int) -> int:
    """Words that a run of period q at least shares with itself moved by q."""
    return max(LEAST, POWERS * q) - q


def numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair, the same for equal ones."""
    return np.unique(a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def grams(blocks: dict[int, np.ndarray], k: int) -> np.ndarray:
    """Numbers of all k-grams; blocks has those of sizes that are powers of two, and gets more of them."""
    size = 1
    while 2 * size <= k:
        if 2 * size not in blocks:
            blocks[2 * size] = numbered(blocks[size][:-size], blocks[size][size:])
        size *= 2
    first = blocks[size]
    return first if size == k else numbered(first[: len(first) - (k - size)], first[k - size :])


def reach(ids: np.ndarray, at: int, lag: int, step: int) -> int:
    """From the pair (at, at + lag) on, how many pairs in the step's direction (1 or -1) are the same."""
    n, size = 0, STEP
    room = len(ids) - lag - at if step > 0 else at + 1
    while n < room:
        size = min(size, room - n)
        low = at + n if step > 0 else at - n - size + 1
        same = ids[low : low + size] == ids[low + lag : low + lag + size]
        if not same.all():
            return n + int(np.argmin(same if step > 0 else same[::-1]))
        n += size
        size *= 2
    return n


def repeats_five(ids: np.ndarray) -> bool:
    """Whether two 5-grams may be equal; never false where they are."""
    n = len(ids) - 4
    x = np.zeros(max(n, 0), np.uint64)
    for i in range(5 if n > 0 else 0):
        x = (x ^ ids[i : i + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    x.sort()
    return bool(n > 1 and (x[1:] == x[:-1]).any())


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs in a sequence of word numbers, by start, then period."""
    n = len(ids)
    if n < LEAST or not repeats_five(ids):
        return []
    out = []
    blocks = {1: ids}
    low = 1
    while POWERS * low <= n:
        k = min(overlap(q) for q in range(low, min(2 * low, low + 3)))  # it grows with q beyond the first few
        if k + low > n:
            break
        names = grams(blocks, k)
        order = np.argsort(names, kind="stable")
        same = names[order][1:] == names[order][:-1]
        if not same.any():
            break  # longer k-grams don't repeat either
        at, lag = order[:-1][same], np.diff(order)[same]
        seeds = (lag >= low) & (lag < 2 * low)
        at, lag = at[seeds], lag[seeds]
        order = np.lexsort((at, lag))
        covered: dict[int, int] = {}
        for a, q in zip(at[order].tolist(), lag[order].tolist()):
            if a < covered.get(q, 0):
                continue
            left = reach(ids, a, q, -1) - 1
            right = reach(ids, a, q, 1)
            covered[q] = a + right
            length = left + right + q
            if length >= max(LEAST, POWERS * q):
                out.append((a - left, length, q))
        low *= 2
    return sorted(out, key=lambda r: (r[0], r[2]))


def word_numbers(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(defaultdict(count().__next__).__getitem__, words), np.int64, len(words))


def with_periods(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a periodic tail where the hash of doc_id says so."""
    n = len(words)
    if not n or doc_id is None or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    piece = words[a : a + p]
    return words[:a] + (piece * ((n - a) // len(piece) + 1))[: n - a]


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run has after its first period."""
    if not found:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").split()  # of bytes, by exactly space and \x09 to \x0D


def periodic_runs(df: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, start, length, period): a row for each run of each text, as it is."""

    def run(batches: Iterable[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            rows = [(i, *r) for i, t in zip(b["doc_id"], b["t"]) for r in runs(word_numbers(words_of(t)))]
            yield {c: [r[k] for r in rows] for k, c in enumerate(("doc_id", "start", "length", "period"))}

    return map_batches(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t")), run, "doc_id long, start long, length long, period long")


def without_repeats(df: DataFrame, text: str = "text") -> DataFrame:
    """df with its text's runs each reduced to one period, words joined by one space; texts without a run stay as they are."""

    @F.pandas_udf("string")
    def reduced(texts):
        def one(t):
            words = words_of(t)
            found = runs(word_numbers(words))
            return b" ".join(collapsed(words, found)).decode() if found else None

        return texts.map(one)

    return df.withColumn(text, F.coalesce(reduced(F.col(text).cast("binary")), F.col(text)))


RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def run_digests(df: DataFrame) -> DataFrame:
    """For each document, after its periodic words are made: its number of runs, the longest one, and digests of all and of the words kept."""

    def run(batches: Iterable[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["t"]):
                words = with_periods(words_of(text), doc_id)
                found = runs(word_numbers(words))
                start, length, period = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None, None, None)
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in found).encode()
                rows.append((doc_id, len(found), start, length, period, 1000 * length // period if found else None, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest()))
            yield {c.split()[0]: [r[k] for r in rows] for k, c in enumerate(RESULT.split(", "))}

    return map_batches(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("t")), run, RESULT)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents."""
    return run_digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: Every pair of words that are the same, at every lag, of one document; runs are stretches of such pairs without a gap.
#: A stretch of a lag that has a smaller period is one of that, too, and of at least its length.
SQL_OP13 = r"""
WITH RECURSIVE crc(doc_id, rest, v) AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR), CAST(4294967295 AS BIGINT) FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL
  SELECT doc_id, rest[2:], xor(v >> 8, list_reduce(list_prepend(xor(v, ord(rest[1])) & 255, range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))
  FROM (SELECT doc_id, rest, v FROM crc WHERE rest <> '')),
h AS (SELECT doc_id, xor(v, 4294967295) AS h FROM crc WHERE rest = ''),
w0 AS (SELECT d.doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, h.h, h.h // 10 AS g FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id),
w1 AS (SELECT doc_id, ws, CAST(len(ws) AS BIGINT) AS n, h, g, CASE WHEN len(ws) > 0 THEN g % len(ws) END AS a FROM w0),
w2 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM w1),
w AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % p + 1] END) ELSE ws END AS ws FROM w2),
x AS (SELECT doc_id, n, i, ws[i + 1] AS word FROM (SELECT doc_id, n, ws, unnest(range(n)) AS i FROM w)),
pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND b.i - a.i <= a.n // 4),
grown AS (SELECT doc_id, q, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k, i FROM pairs),
found AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM grown GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM found o WHERE o.doc_id = f.doc_id AND o.q < f.q AND o.s <= f.s AND o.s + o.len >= f.s + f.len)),
best AS (SELECT doc_id, count(*) AS n_runs, arg_min({'s': s, 'len': len, 'q': q}, {'a': -len, 'b': s, 'c': q}) AS r, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM runs),
kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS t FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i WHERE gone.i IS NULL GROUP BY x.doc_id)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, r.s AS start, r.len AS length, r.q AS period, 1000 * r.len // r.q AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM w LEFT JOIN best ON best.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id
"""
