"""Queries that write tables as the library's sinks do and read them back, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import text as X
from quirefold.operators import index as I
from quirefold.plans.common import docs
from quirefold.sources import sinks as W
from quirefold.sources import tables as T
from quirefold.sources.shared import fresh_path
from quirefold.streaming import logs


def log_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Events as calls, appended to a log in two parts and read back."""
    path = fresh_path(spark, "log")
    calls = T.table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.concat("event_type", F.lit(" ñ")).alias("comando"), F.floor("value").cast("long").alias("tokens_in"), F.when(F.col("user_id") % 2 == 0, F.col("user_id")).alias("tokens_cache"), (F.col("user_id") % 3 == 0).alias("forzado"), "event_id")
    for part in (F.col("event_id") % 2 == 0, F.col("event_id") % 2 == 1):
        W.append_log(calls.where(part).drop("event_id"), path)
    return T.log(spark, path).groupBy("comando").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_cache").alias("tokens_cache"), F.count_if("forzado").alias("forced"))


def units_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of all documents as units of their sources, written by source and read back."""
    path = fresh_path(spark, "units")
    lines = I.lines_as_units(docs(spark, sf).where("source is not null"), "doc_id", "text").join(docs(spark, sf).select(F.col("doc_id").cast("string").alias("doc"), "source"), "doc")
    W.write_units(lines.select(F.col("source").alias("doc"), "n", F.col("kind").alias("tipo"), F.col("text").alias("texto"), F.lit(False).alias("corte_pagina")), path)
    back = T.units(spark, f"{path}/*")
    return back.groupBy(F.regexp_replace("doc", "^doc=", "").alias("source")).agg(F.count("*").alias("units"), F.sum(F.length("texto")).alias("chars"), F.max("n").alias("last"))


def pages_replaced(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations as pages, of which users' turns are replaced, and some added."""
    t = T.table(spark, sf, "conversations").select(F.col("conv_id").alias("name"), F.col("turn").alias("page"), "role", "text")
    changed = t.where("role = 'user'").select("name", "page", F.concat(F.lit("<!-- pagina 3 -->\nnew "), "page").alias("text"), F.lit(1).alias("seq"))
    late = t.where("role = 'user'").select("name", "page", F.lit("late").alias("text"), F.lit(2).alias("seq"))
    more = t.groupBy("name").agg(F.max("page").alias("page")).select("name", (F.col("page") + 1).alias("page"), F.lit("added").alias("text"), F.lit(1).alias("seq"))
    made = W.pages_replaced(t.drop("role"), changed.unionByName(late).unionByName(more))
    return made.select(F.col("name").alias("conv_id"), F.col("page").alias("turn"), F.md5("text").alias("hash"))


def files_left(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files that aren't ingested yet: those without labels."""
    files = docs(spark, sf).select(F.concat("doc_id", F.lit(".pdf")).alias("file"))
    return W.not_ingested(files, T.table(spark, sf, "labels").select(F.concat("doc_id", F.lit(".pdf")).alias("file")))


def index_refreshed(spark: SparkSession, sf: str) -> DataFrame:
    """The index after two streams of documents: first as they are, then labelled ones again, of which toxic ones have another text
    and those of low quality are gone; the second stream's batch is repeated, which changes nothing."""
    path = fresh_path(spark, "index")
    stream = logs.table_stream(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), X.fingerprint16(F.col("text")).alias("hash"), "source")
    first = W.refresh_index(stream, path, ["source"])
    labels = T.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"), "toxic", "quality")
    again = first.join(labels, "id").select("id", F.when(F.col("toxic") == 1, F.reverse("hash")).otherwise(F.col("hash")).alias("hash"), F.lit("moved").alias("source"), (F.col("quality") == 0).alias("gone"))
    schema = W.index_schema(again)
    number = 1 + max(e.number for e in W.entries(spark, path))
    for _ in range(2):
        W.apply_changes(again, path, number, ["source"])
    made = W.last_version(spark, path, schema)
    return made.select(F.col("id").cast("long").alias("doc_id"), "hash", "source", (F.col("vector_from") == number).alias("embedded"))


QUERIES = {f.__name__: f for f in (log_round_trip, units_round_trip, pages_replaced, files_left, index_refreshed)}

SQL = {
    "log_round_trip": "SELECT event_type || ' ñ' AS comando, count(*) AS calls, CAST(sum(floor(value)) AS BIGINT) AS tokens_in, CAST(sum(user_id) FILTER (user_id % 2 = 0) AS BIGINT) AS tokens_cache, count(*) FILTER (user_id % 3 = 0) AS forced FROM events GROUP BY event_type",
    "units_round_trip": """WITH l AS (SELECT source, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS l FROM documents WHERE source IS NOT NULL), u AS (SELECT source, i AS n, l[i] AS t FROM l, unnest(range(1, len(l) + 1)) AS x(i))
        SELECT source, count(*) AS units, CAST(sum(length(t)) AS BIGINT) AS chars, CAST(max(n) AS INTEGER) AS last FROM u GROUP BY source""",
    "pages_replaced": "SELECT conv_id, turn, md5(CASE WHEN role = 'user' THEN 'new ' || turn ELSE text END) AS hash FROM conversations UNION ALL SELECT conv_id, max(turn) + 1, md5('added') FROM conversations GROUP BY conv_id",
    "files_left": "SELECT doc_id || '.pdf' AS file FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "index_refreshed": """SELECT d.doc_id, CASE WHEN toxic = 1 THEN reverse(substr(sha1(text), 1, 16)) ELSE substr(sha1(text), 1, 16) END AS hash, CASE WHEN l.doc_id IS NULL THEN source ELSE 'moved' END AS source, coalesce(toxic = 1, false) AS embedded
        FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(quality, 1) <> 0""",
}
