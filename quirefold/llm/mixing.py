"""Mixing sources to target weights: blocks of words, drawn source by source into output shards.

Each source's documents follow each other in an order given by hashes and are cut into blocks of a fixed number of
words. A source's target is as many words, so as many draws of blocks: whole epochs of all its blocks, then a part of
one more, whose last draw is cut short to meet the target exactly. Each output shard draws a multinomial number of
blocks from each source, in proportion to the sources' draws; what a source was drawn too often falls to sources that
were drawn too seldom. A source's k-th draw is the block at which a pseudorandom permutation of its block numbers
(swap-or-not, another one in each epoch) has k. Draws and blocks are then joined by block number.

Only DataFrame functions are used. A source's running sums are made within chunks of its documents, chosen by hash,
and over the chunks' sums, so that no task holds a source. Reruns agree, as all draws are hashes.

Null text: size 0, never taken. Null source: a source of its own, the last. Null weights don't occur; sources without
words have target 0. Repeated rows are documents of their own. Other columns stay. Very long texts are cut into blocks like others. An empty
table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.llm.shared import WORD, stored

BLOCK = 256
SHARD_BLOCKS = 4096
EPOCHS = 3
CHUNKS = 1024
#: Rows of a chunk where there are more of them than CHUNKS.
CHUNK_ROWS = 100_000
CELLS = 1024
ROUNDS = 24
SEED = 20240607


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def hashed(*columns) -> Column:
    return F.xxhash64(F.lit(SEED), *columns)


def running(df: DataFrame, keys: list[str], chunk: str, order: list, value: str, out: str) -> DataFrame:
    """df with the sum ``out`` of ``value`` over the rows before, by keys in order of chunk and then ``order``.

    Running sums are made within a chunk, and over the chunks' sums.
    """
    sums = df.groupBy(*keys, chunk).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, chunk, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = df.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return found.join(sums, [*keys, chunk]).withColumn(out, F.col("_before") + F.col("_within")).drop("_before", "_within")


def permuted(x: Column, n: Column, key: list[Column], backwards: bool = False) -> Column:
    """The place of x in a pseudorandom permutation of 0..n-1, or what is at place x. Each round swaps pairs, or not."""
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if backwards else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def swap(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(hashed(*key, r), n) - at, n)
        return F.when(hashed(*key, r, F.greatest(at, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(at)

    return F.aggregate(rounds, x.cast("long"), swap)


def owners(points: DataFrame, at: str, intervals: DataFrame, total: int) -> DataFrame:
    """points joined to the one of the intervals [lo, hi) that holds ``at``, by cells of the number line."""
    width = F.lit(max(1, -(-total // CELLS))).cast("long")
    cut = intervals.where("hi > lo").withColumn("_cell", F.explode(F.sequence(F.floor(F.col("lo") / width).cast("long"), F.floor((F.col("hi") - 1) / width).cast("long"))))
    return points.withColumn("_cell", F.floor(F.col(at) / width).cast("long")).join(cut, "_cell").where(F.col(at).between(F.col("lo"), F.col("hi") - 1)).drop("_cell", "lo", "hi")


def weighed(df: DataFrame) -> DataFrame:
    """Sources by code point, null last, with weights 1, 2, 3 and so on again. df: source, size."""
    sizes = df.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row for each source
    return sizes.withColumn("s", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("long")).withColumn("weight", (F.col("s") % 3 + 1).cast("double"))


def targets(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """sources with ``target``: shares of all words by weight, none above ``epochs`` times the source's size.

    The excess is shared out again until none is above. So, in order of the weight for which a source reaches its
    limit, the first ones have their limit and the others one multiple of their weights.
    """
    everything = Window.partitionBy()
    limit = F.lit(epochs) * F.col("source_size")
    ordered = Window.orderBy(limit / F.col("weight"), "s")
    upto = ordered.rowsBetween(Window.unboundedPreceding, -1)
    df = sources.withColumn("_total", F.sum("source_size").over(everything)).withColumn("_weights", F.sum("weight").over(everything))
    left = F.col("_total") - F.coalesce(F.sum(limit).over(upto), F.lit(0))
    level = left / (F.col("_weights") - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    df = df.withColumn("_level", level)
    # the first one that stays below its limit, and with it all later ones
    first = F.min(F.when(F.col("_level") * F.col("weight") <= limit, F.struct((limit / F.col("weight")).alias("at"), "s", "_level")))
    df = df.withColumn("_free", first.over(everything)["_level"])
    return df.withColumn("target", F.least(limit.cast("double"), F.coalesce(F.col("_free"), F.lit(0.0)) * F.col("weight"))).drop("_total", "_weights", "_level", "_free")


def draws(sources: DataFrame, block: int) -> DataFrame:
    """sources with their numbers of blocks and draws, and how many words the last draw takes."""
    df = sources.withColumn("n_blocks", F.ceil(F.col("source_size") / block).cast("long"))
    words = F.floor(F.col("target") + 0.5).cast("long")
    df = df.withColumn("full", F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long"))
    df = df.withColumn("rest", words - F.col("full") * F.col("source_size"))
    short = F.lit(block) - (F.col("source_size") - (F.col("n_blocks") - 1) * block)
    place = permuted(F.col("n_blocks") - 1, F.col("n_blocks"), [F.col("s"), F.col("full")], backwards=True)
    df = df.withColumn("_short", short).withColumn("_place", F.when(F.col("n_blocks") > 0, place).otherwise(0))
    few = F.ceil(F.col("rest") / block).cast("long")
    part = F.when(few <= F.col("_place"), few).otherwise(F.ceil((F.col("rest") + F.col("_short")) / block).cast("long"))
    df = df.withColumn("part", F.when(F.col("rest") > 0, part).otherwise(0).cast("long"))
    seen = (F.col("part") - 1) * block - F.when(F.col("part") - 1 > F.col("_place"), F.col("_short")).otherwise(0)
    df = df.withColumn("last_words", F.when(F.col("part") > 0, F.col("rest") - seen).otherwise(0).cast("long"))
    return df.withColumn("draws", F.col("full") * F.col("n_blocks") + F.col("part")).drop("_short", "_place", "rest")


def drawn(spark: SparkSession, sources: DataFrame) -> DataFrame:
    """(shard, s, before, n): each shard's number of draws from each source, and the draws of it in earlier shards."""
    total = sources.agg(F.sum("draws")).first()[0] or 0
    before = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ends = sources.select("s", "draws", F.coalesce(F.sum("draws").over(before), F.lit(0)).cast("long").alias("lo")).withColumn("hi", F.col("lo") + F.col("draws"))
    slots = spark.range(total).select(F.floor(F.col("id") / SHARD_BLOCKS).cast("long").alias("shard"), F.pmod(hashed("id"), F.lit(max(1, total))).alias("u"))
    counts = owners(slots, "u", ends.select("s", "lo", "hi"), total).groupBy("shard", "s").agg(F.count("*").alias("n"))
    counts = running(counts.withColumn("_chunk", F.floor(F.col("shard") / CHUNKS)), ["s"], "_chunk", ["shard"], "n", "before").drop("_chunk")
    kept = counts.join(sources.select("s", "draws"), "s").withColumn("kept", F.greatest(F.lit(0), F.least(F.col("n"), F.col("draws") - F.col("before"))))
    kept = stored(kept.select("shard", "s", "n", "kept"), "mix-drawn")
    # what was drawn too often, by shard, is handed to sources that were drawn too seldom
    free = kept.groupBy("shard").agg(F.sum(F.col("n") - F.col("kept")).alias("free")).where("free > 0").withColumn("_chunk", F.floor(F.col("shard") / CHUNKS)).withColumn("_one", F.lit(0))
    free = running(free, ["_one"], "_chunk", ["shard"], "free", "at")
    points = free.select("shard", F.explode(F.sequence(F.col("at").cast("long"), (F.col("at") + F.col("free") - 1).cast("long"))).alias("u"))
    lacking = sources.select("s", "draws").join(kept.groupBy("s").agg(F.sum("kept").alias("kept")), "s", "left").select("s", (F.col("draws") - F.coalesce("kept", F.lit(0))).alias("lack"))
    lacking = lacking.withColumn("lo", F.coalesce(F.sum("lack").over(before), F.lit(0)).cast("long")).withColumn("hi", F.col("lo") + F.col("lack"))
    spare = kept.agg(F.sum(F.col("n") - F.col("kept"))).first()[0] or 0
    more = owners(points, "u", lacking.select("s", "lo", "hi"), spare).select("shard", "s", F.lit(1).cast("long").alias("n"))
    both = kept.select("shard", "s", F.col("kept").alias("n")).unionByName(more).groupBy("shard", "s").agg(F.sum("n").alias("n")).where("n > 0")
    return running(both.withColumn("_chunk", F.floor(F.col("shard") / CHUNKS)), ["s"], "_chunk", ["shard"], "n", "before").drop("_chunk")


def mix(df: DataFrame, text: str = "text", source: str = "source", block: int = BLOCK, epochs: int = EPOCHS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, sources and the mix.

    Documents: df's columns but the text, and ``size``, ``s``, ``start`` (size, source number, words of the source
    before it), which replace own columns of these names, in any case of letters. Sources: ``s``, ``source``, ``source_size``, ``weight``, ``target``, ``draws`` and so on. The mix: a
    row for each piece of a document in a drawn block: ``shard``, ``s``, ``k`` (draw), ``block``, ``epoch``, ``start``
    of the document, ``lo`` and ``hi`` (its words, counted from 0, that are taken).
    """
    spark = df.sparkSession
    # the caller's columns are kept in one, so that their names don't meet those of the work
    kept = [c for c in df.columns if c != text and c.lower() not in ("size", "s", "start")]
    plain = df.select(F.struct(F.lit(0).alias("none_"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)]).alias("row"), F.col(source).alias("source"), n_words(text).alias("size"), hashed(*[F.to_json(c) if t.startswith("struct") else F.col(c).cast("string") for c, t in df.dtypes]).alias("key"))
    plain = stored(plain, "mix-docs")
    chunks = max(CHUNKS, plain.count() // CHUNK_ROWS)
    sources = stored(draws(targets(weighed(plain), epochs), block), "mix-sources")
    docs = plain.join(sources.select(F.col("source").alias("_source"), "s"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    docs = docs.withColumn("chunk", F.pmod(F.col("key"), F.lit(chunks)))
    docs = stored(running(docs, ["s"], "chunk", ["key", "size"], "size", "start").select("row", "size", "s", "start"), "mix-placed")
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    blocks = docs.where("size > 0").select("s", "start", "size", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("block"))
    at = F.col("block") * block - F.col("start")
    blocks = blocks.select("s", "start", "block", F.greatest(at, F.lit(0)).alias("lo"), F.least(at + block, F.col("size")).alias("hi"), F.greatest(-at, F.lit(0)).alias("_from"))
    slots = drawn(spark, sources).join(sources.select("s", "n_blocks", "full", "part", "last_words"), "s")
    # few rows, each of which becomes many
    slots = slots.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard", "s")
    slots = slots.select("*", F.explode(F.sequence(F.col("before").cast("long"), (F.col("before") + F.col("n") - 1).cast("long"))).alias("k"))
    slots = slots.withColumn("epoch", F.floor(F.col("k") / F.col("n_blocks")).cast("long"))
    cut = F.when(F.col("k") == F.col("full") * F.col("n_blocks") + F.col("part") - 1, F.when(F.col("part") > 0, F.col("last_words")))
    slots = slots.select("shard", "s", "k", "epoch", permuted(F.col("k") % F.col("n_blocks"), F.col("n_blocks"), [F.col("s"), F.col("epoch")]).alias("block"), F.coalesce(cut, F.lit(block)).alias("_most"))
    # the block's first _most words: a piece begins at word _from of its block
    pieces = slots.join(blocks, ["s", "block"]).withColumn("hi", F.least(F.col("hi"), F.col("lo") + F.col("_most") - F.col("_from")))
    docs = docs.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(kept)], "size", "s", "start")
    return docs, sources, pieces.where("hi > lo").select("shard", "s", "k", "block", "epoch", "start", "lo", "hi")


def mixed(df: DataFrame, text: str = "text", source: str = "source", block: int = BLOCK, epochs: int = EPOCHS) -> DataFrame:
    """The rows of df as often as the mix takes them.

    An epoch that takes all of a document's words gives it unchanged; one that takes some of them gives each run of
    taken words as a row of its own, the words joined by blanks. Integer column ``n_chars``, if there, is set anew.
    """
    key = "whole"
    known = df.select(F.struct(*df.columns).alias(key), F.col(text).alias("text"), F.col(source).alias("source"))
    docs, _, pieces = mix(known, block=block, epochs=epochs)
    runs = Window.partitionBy("s", "start", "epoch").orderBy("lo")
    pieces = pieces.select("s", "start", "epoch", "lo", "hi").withColumn("_new", (F.col("lo") != F.coalesce(F.lag("hi").over(runs), F.lit(-1))).cast("int"))
    pieces = pieces.withColumn("_run", F.sum("_new").over(runs)).groupBy("s", "start", "epoch", "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    pieces = pieces.select(F.col("s").alias("_s"), F.col("start").alias("_start"), "lo", "hi")
    taken = docs.where("size > 0").join(pieces, (F.col("s") == F.col("_s")) & (F.col("start") == F.col("_start")))
    whole = F.col(key)[text]
    part = F.array_join(F.slice(F.regexp_extract_all(whole, F.lit(f"({WORD})")), (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")), " ")
    out = taken.withColumn("_text", F.when(F.col("hi") - F.col("lo") == F.col("size"), whole).otherwise(part))
    made = {text: F.col("_text")}
    for c in df.columns:
        if c.lower() == "n_chars":
            made[c] = F.char_length("_text").cast(df.schema[c].dataType)
    return out.select(*[made.get(c, F.col(key)[c]).alias(c) for c in df.columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    docs, sources, pieces = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    taken = pieces.groupBy("s", "start").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    taken = taken.select(F.col("s").alias("_s"), F.col("start").alias("_start"), "taken")
    found = docs.join(taken, (F.col("s") == F.col("_s")) & (F.col("start") == F.col("_start")) & (F.col("size") > 0), "left")
    named = sources.select(F.col("s").alias("_n"), "source_size", "target", "weight")
    return found.join(named, F.col("s") == F.col("_n")).select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source", "weight")
