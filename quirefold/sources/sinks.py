"""What is written: logs by lines, units by document, transcription pages, a versioned index that is refreshed batch by batch."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from quirefold.functions.text import fingerprint16
from quirefold.operators.index import kept_vectors


def append_log(rows: DataFrame, path: str) -> None:
    """Rows to a log of JSON lines; null fields are left out, letters beyond ASCII kept."""
    rows.write.mode("append").option("ignoreNullFields", "true").json(path)


def write_units(units: DataFrame, path: str) -> None:
    """Units as JSON lines, a folder for each document by its name; documents that are there already are replaced."""
    units.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc").json(path)


def not_ingested(files: DataFrame, bibliography: DataFrame) -> DataFrame:
    """Files (file) that no entry (file) of the bibliography comes from yet."""
    return files.join(bibliography.select("file"), "file", "left_anti")


def pages_replaced(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Pages (name, page, text) with new texts in the place of old ones, without page markers in them; of repeated ones the first by ``seq``."""
    first = new.groupBy("name", "page").agg(F.min_by("text", "seq").alias("_new"))
    clean = F.trim(F.regexp_replace("_new", r"<!-- pagina \d+ -->\s*", ""))
    return stored.join(first, ["name", "page"], "full").select("name", "page", F.coalesce(clean, "text").alias("text"))


#: Hash buckets of an index, and entries of its log after which it is written whole.
BUCKETS, COMPACT = 64, 16
VERSION = "number long, path string, base boolean"


def index_schema(rows: DataFrame) -> StructType:
    """Of index rows with ``vector_from``."""
    return StructType([*(f for f in rows.schema.fields if f.name != "gone"), StructField("vector_from", LongType())])


def entries(spark: SparkSession, path: str) -> list[Row]:
    """The published entries (number, path, base) of an index's log: one for each batch, bases apart; none before the first.

    What the driver holds is a row for each entry. A batch that was repeated has several, which say the same; one is taken.
    """
    try:
        rows = spark.read.schema(VERSION).json(f"{path}/versions").groupBy("number", "base").agg(F.min("path").alias("path"))
        return rows.orderBy("number", F.desc("base")).collect()
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return []


def publish(spark: SparkSession, path: str, number: int, table: str, base: bool) -> None:
    spark.createDataFrame([(number, table, base)], VERSION).coalesce(1).write.mode("append").json(f"{path}/versions")


def last_version(spark: SparkSession, path: str, schema: StructType, below: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """An index (id, hash, meta columns, vector_from) as its log says: the last base, and what changed since.

    below: only batches of smaller numbers. buckets: only these hash buckets, whose folders alone are read.
    """
    known = [e for e in entries(spark, path) if below is None or e.number < below]
    base = max((e.number for e in known if e.base), default=None)
    used = [e for e in known if (e.base and e.number == base) or (not e.base and (base is None or e.number > base))]
    full = StructType([*schema.fields, StructField("gone", BooleanType()), StructField("bucket", IntegerType())])
    if not used:
        return spark.createDataFrame([], schema)
    log = None
    for e in used:
        one = spark.read.schema(full).parquet(e.path).withColumn("_at", F.lit(e.number))
        log = one if log is None else log.unionByName(one)
    if buckets is not None:
        log = log.where(F.col("bucket").isin(buckets))
    last = log.groupBy("id").agg(F.max_by(F.struct(*[f.name for f in schema.fields if f.name != "id"], "gone"), "_at").alias("x"))
    return last.select("id", "x.*").where("not gone").select(*schema.fieldNames())


def write_entry(rows: DataFrame, path: str, number: int, base: bool) -> None:
    """Rows of an index, gone ones among them, as an entry of its log: a new table, and then the line that publishes it."""
    table = f"{path}/log/{number}-{'base' if base else 'changes'}-{uuid.uuid4().hex}"
    rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int")).repartition("bucket").write.partitionBy("bucket").parquet(table)
    publish(rows.sparkSession, path, number, table, base)


def apply_changes(rows: DataFrame, path: str, number: int, meta: list[str]) -> None:
    """A batch of index rows (id, hash, meta columns, and ``gone`` if any are to go), numbered, into the index's log.

    Only rows that differ from what the index had before this number are written, with ``vector_from`` the number where
    the text is new; rows that are gone leave a line that says so. Of rows of one id in a batch one is taken. A repeated
    batch compares with the same state as before and writes the same rows to a table of its own, so readers never see a
    half-written one and the result is the same. Every COMPACT entries the state is written whole.
    """
    spark = rows.sparkSession
    schema = index_schema(rows)
    names = [f.name for f in schema.fields if f.name != "vector_from"]
    rows = rows.withColumn("gone", F.coalesce("gone", F.lit(False)) if "gone" in rows.columns else F.lit(False))
    one = rows.groupBy("id").agg(F.max(F.struct(*[c for c in names if c != "id"], "gone")).alias("x")).select("id", "x.*")
    buckets = [r[0] for r in one.select(F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int")).distinct().collect()]
    old = last_version(spark, path, schema, number, buckets)
    was = old.select("id", F.struct(*[c for c in schema.fieldNames() if c != "id"]).alias("was"))
    both = one.join(was, "id", "left")
    same = F.col("hash").eqNullSafe(F.col("was.hash")) & F.col("was").isNotNull()
    moved = both.withColumn("vector_from", F.when(same, F.col("was.vector_from")).otherwise(F.lit(number)).cast("long"))
    changed = F.col("was").isNull() | ~same
    for c in meta:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"was.{c}"))
    made = moved.where(F.when(F.col("gone"), F.col("was").isNotNull()).otherwise(changed))
    write_entry(made.select(*schema.fieldNames(), "gone"), path, number, False)
    if sum(not e.base for e in entries(spark, path)) % COMPACT == 0:
        write_entry(last_version(spark, path, schema, number + 1).withColumn("gone", F.lit(False)), path, number, True)


def refresh_index(stream: DataFrame, path: str, meta: list[str]) -> DataFrame:
    """The index after a stream of index rows, each batch by ``apply_changes``."""
    spark = stream.sparkSession
    writer = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    query = writer.foreachBatch(lambda rows, number: apply_changes(rows, path, number, meta)).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return last_version(spark, path, index_schema(stream))


def write_vectors(vectors: DataFrame, status: DataFrame, new: DataFrame, path: str) -> None:
    """The vectors of an index after a change, as a table."""
    kept_vectors(vectors, status, new).write.mode("overwrite").parquet(path)


MANIFEST = "batch string, name string, path string"


def commit_batch(tables: dict[str, DataFrame], path: str, batch: str) -> None:
    """Several tables as one batch: each is written to a place of its own, and then one line of the manifest names them all.

    Readers follow the manifest, so they see all of a batch or nothing, and a repeated batch once.
    """
    spark = next(iter(tables.values())).sparkSession
    lines = []
    for name, df in tables.items():
        at = f"{path}/{name}/{batch}-{uuid.uuid4().hex}"
        df.write.parquet(at)
        lines.append((batch, name, at))
    # one file, which appears whole or not at all
    spark.createDataFrame(lines, MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifest")


def committed(spark: SparkSession, path: str, name: str, schema: StructType | str) -> DataFrame:
    """A table of all committed batches, with its ``batch``; of a repeated batch the tables of one of its commits."""
    try:
        # a row for each batch and table; a batch's tables are of one commit, as its file names tell
        rows = spark.read.schema(MANIFEST).json(f"{path}/manifest").select("*", F.input_file_name().alias("file"))
        chosen = rows.groupBy("batch").agg(F.min("file").alias("file"))
        found = rows.join(chosen, ["batch", "file"]).where(F.col("name") == name).select("batch", "path").collect()
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        found = []
    out = spark.createDataFrame([], schema).withColumn("batch", F.lit(""))
    for r in found:
        out = out.unionByName(spark.read.schema(out.drop("batch").schema).parquet(r.path).withColumn("batch", F.lit(r.batch)))
    return out


def marked(text: Column, comment: str = "% ") -> Column:
    """A text with a first line that has the fingerprint of all the others."""
    return F.concat(F.lit(comment), fingerprint16(text), F.lit("\n"), text)


def untouched(written: Column, comment: str = "% ") -> Column:
    """Whether a marked text is as it was written: its first line has the fingerprint of the rest. False for any other text."""
    first, rest = F.substring_index(written, "\n", 1), F.regexp_replace(written, r"\A[^\n]*\n?", "")
    return F.coalesce(F.contains(written, F.lit("\n")) & (first == F.concat(F.lit(comment), fingerprint16(rest))), F.lit(False))


def exported(stored: DataFrame, new: DataFrame, force: bool = False) -> DataFrame:
    """Exports (name, text) after new ones: texts that someone has edited stay, unless forced; ``outcome`` is written, yours, or kept.

    stored: name, text as they are now. new: name, text without a mark. A text that is the same anew is written all the same.
    """
    both = stored.withColumnRenamed("text", "_old").join(new.withColumnRenamed("text", "_new"), "name", "full")
    mine = F.lit(force) | F.col("_old").isNull() | untouched(F.col("_old"))
    outcome = F.when(F.col("_new").isNull(), "kept").when(mine, "written").otherwise("yours")
    return both.select("name", F.when(outcome == "written", marked(F.col("_new"))).otherwise(F.col("_old")).alias("text"), outcome.alias("outcome"))


def write_bibliography(entries: DataFrame, path: str) -> None:
    """Entries (doc and fields, null ones left out) as lines of JSON with sorted keys, ordered by doc."""
    fields = F.struct(*sorted(c for c in entries.columns if c != "doc"))
    line = F.to_json(F.struct(F.col("doc").alias("doc"), fields.alias("fields")), {"ignoreNullFields": "true"})
    entries.select("doc", line.alias("value")).repartitionByRange("doc").sortWithinPartitions("doc").select("value").write.mode("overwrite").text(path)


def read_bibliography(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """(doc and fields) of a bibliography; nothing where there is none, or of lines that aren't entries."""
    schema = f"doc string, fields struct<{fields}>"
    try:
        rows = spark.read.schema("value string").text(path).select(F.from_json("value", schema).alias("x"))
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows = spark.createDataFrame([], f"x struct<doc: string, fields: struct<{fields}>>")
    return rows.where("x.doc is not null").select("x.doc", "x.fields.*")
