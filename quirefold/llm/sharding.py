"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Documents of one text form a group, which goes into one shard. A group that alone would fill more than a PART-th of a
shard's bytes, tokens or rows (LEAST_ROWS rows at least) is dealt into pieces by a hash, each about below that. There
are few of these, PART times shards times three at most. Groups and pieces, in descending order of size, go to the bin whose residual capacity
has the highest dot product with the group's (bytes, tokens, rows), each as shares of the total.

Packing is done in cells: hashes deal the groups into cells of about CELL groups, each of which is packed into BINS
times as many bins as there are shards; the bins are then groups of the next round, until one cell is left, whose bins
are the shards. So no task holds more than a cell.

Bytes, tokens and rows count alike. The law that holds is ``bytes``: the shards' sizes are near equal, as far as the
largest document allows; in a table of few documents they differ by some hundredths. Size counts
the UTF-8 bytes of the text and one more; null text is like an empty one. Null and repeated doc_ids are rows like
others. Other columns stay. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm.mixing import CHUNK_ROWS, CHUNKS, n_words, running
from quirefold.llm.shared import stored, utf8

SHARDS = 16
PART = 8
CELL = 16384
BINS = 16
#: Rows of a group below which their number alone doesn't divide it.
LEAST_ROWS = 16


def packed(size: np.ndarray, bins: int) -> np.ndarray:
    """A bin for each row of size (n x dimensions)."""
    total = size.sum(0)
    share = size / np.where(total > 0, total, 1)
    residual = np.full((bins, size.shape[1]), 1 / bins)
    out = np.zeros(len(size), np.int32)
    for i in np.lexsort((np.arange(len(size)), -share.max(1))):
        out[i] = best = int((residual @ share[i]).argmax())
        residual[best] -= share[i]
    return out


def pack(items: DataFrame, keys: list[str], shards: int, cell: int = CELL) -> DataFrame:
    """(keys, shard) for items of keys, bytes, tokens and rows."""
    n = items.count()
    cell = max(cell, 4 * BINS * shards)  # fewer bins come out than groups go in
    cells = max(1, math.ceil(n / cell))
    bins = shards if cells == 1 else BINS * shards
    kept = items.select(*keys, "bytes", "tokens", "rows", F.pmod(F.xxhash64(*keys), F.lit(cells)).alias("cell_"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.select(*keys, "cell_", "bytes", "tokens", "rows").schema)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(keys)  # whatever order the shuffle gave
        return part.assign(bin_=packed(part[["bytes", "tokens", "rows"]].to_numpy(float), bins))[[*keys, "cell_", "bytes", "tokens", "rows", "bin_"]]

    placed = kept.groupBy("cell_").applyInPandas(run, f"{fields}, bin_ int")
    if cells == 1:
        return placed.select(*keys, F.col("bin_").alias("shard"))
    placed = stored(placed, "shard-cells")
    sums = placed.groupBy(F.col("cell_").alias("cell"), F.col("bin_").alias("bin")).agg(*[F.sum(c).alias(c) for c in ("bytes", "tokens", "rows")])
    upper = pack(sums, ["cell", "bin"], shards, cell)
    upper = upper.select(F.col("cell").alias("_cell"), F.col("bin").alias("_bin"), "shard")
    return placed.join(upper, (F.col("cell_") == F.col("_cell")) & (F.col("bin_") == F.col("_bin"))).select(*keys, "shard")


def sharded(df: DataFrame, shards: int = SHARDS, text: str = "text", cell: int = CELL) -> DataFrame:
    """df without its text, with ``size``, ``tokens``, ``text_crc32``, ``shard`` and ``slot`` (place in the shard, from 0)."""
    made = ("size", "tokens", "text_crc32", "shard", "slot")
    names = [c for c in df.columns if c != text and c.lower() not in made]
    rest = [F.col(c).alias(f"c_{i}") for i, c in enumerate(names)]
    whole = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(*rest, (utf8(text) + 1).alias("size"), n_words(text).alias("tokens"), F.crc32(whole.cast("binary")).alias("text_crc32"), F.md5(whole.cast("binary")).alias("h"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
    docs = stored(docs, "shard-docs")
    total = docs.agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r")).first()
    most = [max(1, (x or 0) // (shards * PART)) for x in total]
    groups = docs.groupBy("h").agg(F.count("*").alias("rows"), F.first("size").alias("size"), F.first("tokens").alias("tokens"))
    parts = F.greatest(F.ceil(F.col("rows") * F.col("size") / most[0]), F.ceil(F.col("rows") * F.col("tokens") / most[1]), F.ceil(F.col("rows") / max(LEAST_ROWS, most[2])))
    # few: each holds a PART of a shard's bytes, tokens or rows
    hot = groups.where(F.col("rows") > 1).withColumn("parts", F.least("rows", parts).cast("long")).where("parts > 1").select("h", "parts")
    docs = docs.join(F.broadcast(hot), "h", "left").withColumn("piece", F.when(F.col("parts").isNotNull(), F.pmod("salt", "parts")).otherwise(0)).drop("parts")
    items = docs.groupBy("h", "piece").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    placed = docs.join(pack(stored(items, "shard-items"), ["h", "piece"], shards, cell), ["h", "piece"])
    placed = placed.withColumn("_chunk", F.pmod("salt", F.lit(max(CHUNKS, (total.r or 0) // CHUNK_ROWS)))).withColumn("_one", F.lit(1).cast("long"))
    placed = running(placed, ["shard"], "_chunk", ["salt"], "_one", "slot")
    return placed.select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(names)], "size", "tokens", "text_crc32", "shard", "slot")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shard and a place in it for every document."""
    found = sharded(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "tokens")
