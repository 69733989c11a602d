"""Queries on sources, header fields and registers that other queries don't touch, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.functions import text as X
from quirefold.operators import index as I
from quirefold.operators import lab as L
from quirefold.operators import registry as R
from quirefold.operators import search as S
from quirefold.sources import tables as T
from quirefold.sources.tables import table


def header_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Headers of customers' files with a field set, one taken out and one replaced where it is."""
    c = table(spark, sf, "customer")
    text = F.concat(F.lit("---\nestado: sin_revisar\nname: "), "c_name", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("\nsegment: "), "c_mktsegment")).otherwise(""), F.lit("\n---\nbody of "), "c_custkey")
    fields = X.replaced_field(X.without_field(X.with_field(X.header_fields(text), "state", F.lit("done")), "estado"), "segment", F.lit("S"))
    return c.select("c_custkey", F.array_join(F.array_sort(F.transform(F.map_entries(fields), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";").alias("fields"), X.body(text).alias("body"))


def marked_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations as pages of one body, cut by their markers, with the marks of doubt that they have."""
    t = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    body = F.array_join(F.transform("t", lambda x: F.concat(F.lit("<!-- pagina "), x["turn"] + 1, F.lit(" -->\n"), x["text"], F.repeat(F.lit(" [?]"), x["turn"].cast("int")), F.lit(" [ILEGIBLE]\n"))), "")
    pages = T.marked_pages(t.select("doc", body.alias("text"))).where("page > 0")
    marks = X.doubts(F.col("text"))
    return pages.select(F.col("doc").alias("conv_id"), F.col("page").cast("long").alias("page"), marks["illegible"].cast("long").alias("illegible"), marks["doubtful"].cast("long").alias("doubtful"))


def page_units(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations as page texts, of which system turns are blank."""
    t = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("turn") % 3 == 2, " \n ").otherwise(F.col("text")).alias("text")))), lambda x: x["text"]).alias("pages"))
    return T.page_units(t).select(F.col("doc").alias("conv_id"), F.col("page").cast("long").alias("page"), F.length("text").cast("long").alias("chars"))


def markdown_units(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of customers as converted markdown: a page each, a heading every third, a long and a short block."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), F.row_number().over(w).alias("i"), "o_orderkey")
    one = F.concat(F.lit("\n\n{"), F.col("i"), F.lit("}------\n\n"), F.when(F.col("i") % 3 == 1, F.concat(F.lit("## Part "), "i", F.lit("\n\n"))).otherwise(""), F.lit("A block with more than forty letters for order "), "o_orderkey", F.lit("\n\nshort\n"))
    docs = o.select("doc", "i", one.alias("t")).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]), "").alias("text"))
    return T.markdown_units(docs).select(F.col("doc").alias("o_custkey"), F.col("n").cast("long").alias("n"), F.col("page").cast("long").alias("page"), "section")


def commit_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Events as lines of a log of changes, by kinds of marks; clicks have no tab and are left out."""
    begins = F.element_at(F.create_map(*[F.lit(x) for kv in {"signup": "inicio sesion", "view": "sellado :: fase 1", "purchase": "cierre de", "error": "reanudacion"}.items() for x in kv]), F.col("event_type"))
    line = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.when(F.col("event_type") == "click", " ").otherwise("\t"), F.coalesce(begins, F.lit("x")), F.lit(" "), F.col("event_id"))
    rows = T.commits(table(spark, sf, "events").select(line.alias("value")))
    return rows.groupBy(T.mark_kind(F.col("msg")).alias("kind")).agg(F.count("*").alias("n"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last"))


def previous_fragments(spark: SparkSession, sf: str) -> DataFrame:
    """For each line item the two before it in its order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.row_number().over(w).alias("ord")).withColumn("id", F.concat_ws("#", "doc", "ord"))
    return S.neighbours(rows, 2).select("id", F.array_join("before", ",").alias("before"))


def section_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of orders as headings of three levels, by their numbers."""
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("doc"), F.row_number().over(w).alias("n"), F.least(F.col("l_linenumber"), F.lit(3)).cast("int").alias("level"))
    return I.section_numbers(rows, "level").select(F.col("doc").alias("l_suppkey"), "n", "number")


def attempts_added(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as attempts, all of which come twice; those of finished ones are stored already."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("rid"), F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("session"), (F.col("o_orderkey") % 6 - 1).cast("int").alias("level"), "o_orderstatus")
    new = R.new_attempts(o.where("o_orderstatus = 'F'").select("rid", "date", "session"), o.drop("o_orderstatus").unionByName(o.drop("o_orderstatus")))
    return new.select(F.col("rid").alias("o_custkey"), F.col("date").cast("string").alias("date"), "session", "level")


def ids_renamed(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by their priorities after a log of renamings."""
    names = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("old")).distinct().where("length(old) % 2 = 0").select("old", F.concat(F.lit("new-"), "old").alias("new"))
    return R.renamed(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("doc")), names).groupBy("doc").agg(F.count("*").alias("n"))


def entries_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as entries that newer rows are merged into: names by hand stay, balances are the new ones; some are new."""
    s = table(spark, sf, "supplier")
    stored = s.where("s_suppkey % 3 > 0").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("name"), F.col("s_acctbal").alias("bal"))
    new = s.where("s_suppkey % 4 < 3").select(F.col("s_suppkey").alias("id"), F.lit("theirs").alias("name"), (-F.col("s_acctbal")).alias("bal"))
    return R.upserted(stored, new, "id", ["name"])


def ratios_again(spark: SparkSession, sf: str) -> DataFrame:
    """Ratios of the orders' weights, taken from the weights again, but for the last."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    r = table(spark, sf, "orders").where("o_totalprice > 0").select(F.col("o_custkey").alias("seq_id"), (F.row_number().over(w) - 1).cast("int").alias("p"), F.log("o_totalprice").alias("log_m"))
    return L.ratios(L.weights(r).select("seq_id", "p", "log_w")).select("seq_id", "p", F.round("log_m", 6).alias("log_m"))


def accents_dropped(spark: SparkSession, sf: str) -> DataFrame:
    """Documents' first lines without accents and as slugs; those with full-width letters and ligatures are as the plain ones."""
    first = F.substring_index("text", "\n", 1)
    wide = F.concat(F.lit("ﬁne "), F.translate(F.lower(first), "abcdefghij", "ａｂｃｄｅｆｇｈｉｊ"))
    d = table(spark, sf, "documents")
    return d.select("doc_id", (X.squeezed(wide) == X.squeezed(F.concat(F.lit("fine "), first))).alias("same"), F.length(X.slug(X.unaccented(first))).cast("long").alias("slug_chars"), F.length(X.unaccented(first)).cast("long").alias("chars"))


QUERIES = {f.__name__: f for f in (header_fields, marked_pages, page_units, markdown_units, commit_marks, previous_fragments, section_counters, attempts_added, ids_renamed, entries_merged, ratios_again, accents_dropped)}

SQL = {
    "header_fields": "SELECT c_custkey, 'name=' || c_name || CASE WHEN c_custkey % 2 = 0 THEN ';segment=S' ELSE '' END || ';state=done' AS fields, 'body of ' || c_custkey AS body FROM customer",
    "marked_pages": "SELECT conv_id, turn + 1 AS page, CAST(len(regexp_extract_all(text || ' [ILEGIBLE]', '\\[ILEGIBLE\\]')) AS BIGINT) AS illegible, CAST(turn + len(regexp_extract_all(text, '\\[\\?\\]')) AS BIGINT) AS doubtful FROM conversations",
    "page_units": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page, CAST(length(text) AS BIGINT) AS chars FROM conversations QUALIFY turn % 3 < 2",
    "markdown_units": """WITH o AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders) SELECT o_custkey, i AS n, i AS page, 'Part ' || (i - (i - 1) % 3) AS section FROM o""",
    "commit_marks": """SELECT CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'seal1' WHEN 'purchase' THEN 'close' WHEN 'error' THEN 'resume' END AS kind, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events WHERE event_type <> 'click' GROUP BY 1""",
    "previous_fragments": """WITH r AS (SELECT l_orderkey AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS n FROM lineitem) SELECT d || '#' || n AS id, concat_ws(',', CASE WHEN n > 2 THEN d || '#' || (n - 2) END, CASE WHEN n > 1 THEN d || '#' || (n - 1) END) AS before FROM r""",
    "section_counters": """WITH r AS (SELECT l_suppkey AS d, least(l_linenumber, 3) AS l, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS n FROM lineitem),
        a AS (SELECT *, count(*) FILTER (l = 1) OVER (PARTITION BY d ORDER BY n ROWS UNBOUNDED PRECEDING) AS x FROM r), b AS (SELECT *, count(*) FILTER (l = 2) OVER (PARTITION BY d, x ORDER BY n ROWS UNBOUNDED PRECEDING) AS y FROM a), c AS (SELECT *, count(*) FILTER (l = 3) OVER (PARTITION BY d, x, y ORDER BY n ROWS UNBOUNDED PRECEDING) AS z FROM b)
        SELECT d AS l_suppkey, CAST(n AS INTEGER) AS n, x || CASE WHEN l > 1 THEN '.' || y ELSE '' END || CASE WHEN l > 2 THEN '.' || z ELSE '' END AS number FROM c""",
    "attempts_added": """WITH o AS (SELECT o_custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, o_orderpriority AS session, o_orderkey % 6 - 1 AS level, o_orderstatus = 'F' AS f FROM orders)
        SELECT o_custkey, date, session, CAST(least(greatest(max(level), 0), 3) AS INTEGER) AS level FROM o GROUP BY o_custkey, date, session HAVING NOT bool_or(f)""",
    "ids_renamed": "SELECT CASE WHEN length(o_orderpriority) % 2 = 0 THEN 'new-' || o_orderpriority ELSE o_orderpriority END AS doc, count(*) AS n FROM orders GROUP BY 1",
    "entries_merged": """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 > 0 AND s_suppkey % 2 = 0 THEN s_name WHEN s_suppkey % 4 < 3 THEN 'theirs' END AS name, CASE WHEN s_suppkey % 4 < 3 THEN -s_acctbal ELSE s_acctbal END AS bal FROM supplier WHERE s_suppkey % 3 > 0 OR s_suppkey % 4 < 3""",
    "ratios_again": """WITH r AS (SELECT o_custkey AS seq_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS p, ln(o_totalprice) AS log_m, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_totalprice > 0) SELECT seq_id, p, round(log_m, 6) AS log_m FROM r WHERE p < n - 1""",
    "accents_dropped": """WITH f AS (SELECT doc_id, string_split(text, chr(10))[1] AS t FROM documents), u AS (SELECT doc_id, regexp_replace(strip_accents(lower(t)), '[^\\x00-\\x7F]', '', 'g') AS a FROM f), s AS (SELECT *, trim(regexp_replace(a, '[^a-z0-9]+', '-', 'g'), '-') AS g FROM u)
        SELECT doc_id, true AS same, CAST(length(CASE WHEN rtrim(g[:60], '-') = '' THEN 'apuntes' ELSE rtrim(g[:60], '-') END) AS BIGINT) AS slug_chars, CAST(length(a) AS BIGINT) AS chars FROM s""",
}
