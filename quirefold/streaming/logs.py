"""Growing logs as streams: windowed cost, cycles with timers, and remembered threads kept as state. Late rows beyond the watermark are dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

WATERMARK = "1 hour"
HOURS = 20
KINDS = ("seal1", "attack", "seal3", "pause", "resume", "close")
CYCLE = "stream long, cycle long, start_seq long, n_marks long, closed boolean, paused boolean, seal1 boolean, attack boolean, seal3 boolean, expired boolean"
STATE = "cycle long, start_seq long, n_marks long, closed boolean, paused boolean, seal1 boolean, attack boolean, seal3 boolean, last double"


def table_stream(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A table's files as a stream, by the schema that they have. NTZ times become times, which watermarks need."""
    schema = spark.read.parquet(f"{base}/{name}.parquet").schema
    df = spark.readStream.schema(schema).parquet(f"{base}/{name}.parque[t]")
    for c, kind in df.dtypes:
        if kind == "timestamp_ntz":
            df = df.withColumn(c, F.col(c).cast("timestamp"))
    return df


def windowed(df: DataFrame, ts: str, key: str, sums: dict[str, str], width: str = "1 day") -> DataFrame:
    """Sums by key and window of time, with a watermark."""
    rows = df.withWatermark(ts, WATERMARK).groupBy(F.window(ts, width).alias("w"), key)
    return rows.agg(F.count("*").alias("calls"), *[F.sum(c).alias(out) for out, c in sums.items()]).select(F.col("w.start").alias("start"), key, "calls", *sums)


def fold_cycles(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A stream's current cycle from its marks so far: one row for each batch that brings some, and one when it expires.

    An open cycle that isn't paused has a timer HOURS after its last mark; a pause or a close takes it away, a resume sets
    it again. A cycle whose time is over already when its marks come has expired at once.
    """
    now = list(state.get) if state.exists else [0, None, 0, False, False, False, False, False, None]
    expired = state.hasTimedOut
    if not expired:
        rows = pd.concat(list(parts)).sort_values("seq")  # one stream's marks of a batch, whose files are limited
        for seq, kind, at in zip(rows["seq"], rows["kind"], rows["ts"]):
            if kind == "start":
                now = [now[0] + 1, int(seq), 0, False, False, False, False, False, None]
            elif not now[0] or kind not in KINDS:
                continue
            if kind == "close":
                now[3] = True
            elif kind in ("pause", "resume"):
                now[4] = kind == "pause"
            elif kind != "start":
                now[{"seal1": 5, "attack": 6, "seal3": 7}[kind]] = True
            now[2] += 1
            now[8] = at.timestamp()
        if now[0] and not now[3] and not now[4]:
            end = int(now[8] * 1000) + HOURS * 3_600_000
            expired = end < state.getCurrentWatermarkMs()
            if not expired:
                state.update(tuple(now))
                state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
    state.update(tuple(now))
    if now[0]:
        yield pd.DataFrame([[key[0], *now[:8], expired]], columns=[c.split()[0] for c in CYCLE.split(", ")])


def cycles(marks: DataFrame) -> DataFrame:
    """The state of each stream's current cycle, from a stream of marks (stream, seq, ts, kind) that arrive in order of seq.

    A cycle expires when the watermark is more than HOURS past its last mark. Marks older than the watermark are dropped;
    the query's progress counts them.
    """
    return marks.withWatermark("ts", WATERMARK).groupBy("stream").applyInPandasWithState(fold_cycles, CYCLE, STATE, "update", GroupStateTimeout.EventTimeTimeout)


THREADS = 40
THREAD = "user string, thread long, used long"


def fold_threads(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A user's remembered threads: of all seen so far the THREADS used last, of equally late ones those of least number.

    State is the map of these as two arrays; a thread that was forgotten and comes again is remembered anew. All of them
    are a batch's rows; a batch whose times are all older forgets nothing.
    """
    ids, used = state.get if state.exists else ([], [])
    kept = dict(zip(ids, used))
    for part in parts:
        for thread, at in zip(part["thread"], part["at"]):
            kept[int(thread)] = max(int(at), kept.get(int(thread), int(at)))
        kept = dict(sorted(kept.items(), key=lambda x: (-x[1], x[0]))[:THREADS])
    state.update((list(kept), list(kept.values())))
    yield pd.DataFrame([(key[0], t, at) for t, at in kept.items()], columns=["user", "thread", "used"])


def threads(turns: DataFrame) -> DataFrame:
    """The threads that each user's store holds after each batch of a stream of turns (user, thread, at), at a whole number."""
    return turns.groupBy("user").applyInPandasWithState(fold_threads, THREAD, "ids array<long>, used array<long>", "update", GroupStateTimeout.NoTimeout)


def in_files(df: DataFrame, order: str, parts: int, path: str) -> str:
    """df written as ``parts`` tables of files, one after the other by ranges of a column, so that a stream gets as many batches."""
    bounds = sorted(set(df.stat.approxQuantile(order, [i / parts for i in range(1, parts)], 0.01)))
    for low, high in zip([None, *bounds], [*bounds, None]):
        part = df.where((F.lit(True) if low is None else F.col(order) > low) & (F.lit(True) if high is None else F.col(order) <= high))
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def drained(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """All that a stream has now, written to a table under path, its checkpoint beside; what was read before isn't read again.

    Update mode goes batch by batch into partitions of the batch's number, which a repeated batch overwrites.
    """
    spark = stream.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    query = writer.foreachBatch(batch).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.option("basePath", f"{path}/data").schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{path}/data")
