"""Queries of small grammars and of files written and read back, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.functions import text as X
from quirefold.operators import lab as L
from quirefold.operators import notes as N
from quirefold.operators import registry as R
from quirefold.operators import tex as TX
from quirefold.plans.common import docs
from quirefold.sources import sinks as W
from quirefold.sources import tables as T
from quirefold.sources.shared import fresh_path
from quirefold.sources.tables import table


def bibliography_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as entries of a bibliography, written and read back."""
    path = fresh_path(spark, "bibliography")
    part = table(spark, sf, "part")
    W.write_bibliography(part.select(F.concat(F.lit("p"), "p_partkey").alias("doc"), F.concat("p_name", F.lit(' "ñ"')).alias("title"), F.when(F.col("p_size") % 7 > 0, F.col("p_size") + 1990).alias("year"), F.array("p_brand", "p_type").alias("authors")), path)
    back = W.read_bibliography(spark, path, "title string, year long, authors array<string>")
    return back.select("doc", "title", "year", F.array_join("authors", "; ").alias("authors"))


def exports_spared(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as exports that are written again; each third was edited meanwhile, each seventh is new."""
    rows = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("name"), F.concat_ws("\n", "c_name", "c_mktsegment").alias("text"), "c_custkey")
    first = W.exported(rows.select("name", "text").limit(0), rows.where("c_custkey % 7 <> 0").select("name", "text")).select("name", "text")
    edited = first.withColumn("text", F.when(F.col("name").cast("long") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    made = W.exported(edited, rows.select("name", F.upper("text").alias("text")))
    return made.select(F.col("name").cast("long").alias("c_custkey"), "outcome", F.md5("text").alias("hash"))


def page_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Page ranges of line items, cut to the order's number of pages, which is their number times four."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"))
    ranges = F.when(F.col("q") % 5 == 0, "").otherwise(F.concat(F.col("q") % 4, F.lit("-"), F.col("q") % 4 + 2, F.lit(", "), F.col("q"), F.lit(",2")))
    pages = X.page_ranges(ranges, F.col("l_linenumber").cast("int") * 4)
    return rows.select("l_orderkey", "l_linenumber", "q", F.array_join(pages.cast("array<string>"), ",").alias("pages"))


def next_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """The next free numbers among the orders' keys and the parts' sizes."""
    out = R.next_number(table(spark, sf, "orders"), "o_orderkey").withColumn("of", F.lit("orders"))
    return out.unionByName(R.next_number(table(spark, sf, "part"), "p_size").withColumn("of", F.lit("sizes"))).select("of", "next")


def json_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Objects in replies around the events' properties: fenced, with words about them, broken, or none."""
    e = table(spark, sf, "events")
    k = F.col("event_id") % 4
    reply = F.when(k == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(k == 1, F.concat(F.lit("Here: "), "props", F.lit(" so."))).when(k == 2, F.concat(F.lit("{"), "props")).otherwise(F.lit("none"))
    return e.select("event_id", X.json_object(reply).alias("object"))


def template_hints(spark: SparkSession, sf: str) -> DataFrame:
    """Hints of templates made of the parts' types."""
    t = table(spark, sf, "part").select(F.concat(F.lit("## R"), "p_partkey", F.lit("\n ("), "p_type", F.lit("  of R"), "p_partkey", F.lit(" [x:pNN])\ntext (not one)")).alias("text"))
    return N.template_hints(t)


def pade_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of the approximants that the customers' series of prices allow."""
    n = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    each = F.array(*map(F.lit, L.pade_orders(10**6)))
    return n.select("o_custkey", F.explode(F.filter(each, lambda m: 2 * m + 1 <= F.col("n"))).alias("m"))


def raw_heads(spark: SparkSession, sf: str) -> DataFrame:
    """Heads of documents: of every second one with a line that is no field."""
    d = docs(spark, sf)
    line = F.when(F.col("doc_id") % 2 == 0, "no field here").otherwise("- item")
    text = F.concat(F.lit("---\nid: "), "doc_id", F.lit("\n"), line, F.lit("\n---\n"), F.coalesce("text", F.lit("")))
    return d.select("doc_id", X.raw_head(text).alias("raw"))


def roman_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of items by the parts' keys, in roman numerals."""
    k = (F.col("p_partkey") % 3999 + 1).cast("int")
    return table(spark, sf, "part").select("p_partkey", TX.item_label(F.lit("(i)"), k).alias("label"))


def typed_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of customers as converted markdown: a page each, with titles, statements, proofs, paragraphs and short blocks."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), F.row_number().over(w).alias("i"), "o_orderkey")
    names = F.array(*map(F.lit, ("**Theorem", "lemma", "Proof", "A plain paragraph")))
    block = F.concat(F.element_at(names, (F.col("o_orderkey") % 4 + 1).cast("int")), F.lit(" 2."), "i", F.lit(".** and forty letters more, which make it long, for order "), "o_orderkey")
    one = F.concat(F.lit("\n{"), F.col("i"), F.lit("}------\n\n"), F.when(F.col("i") % 3 == 1, F.concat(F.lit("## Part "), "i", F.lit("\n \n"))).otherwise(""), block, F.lit("\n\nshort\n"))
    made = o.select("doc", "i", one.alias("t")).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]), "").alias("text"))
    return T.typed_markdown_units(made).select(F.col("doc").alias("o_custkey"), F.col("n").cast("long").alias("n"), F.col("page").cast("long").alias("page"), "section", "kind", "number", F.length("text").cast("long").alias("chars"))


def transcription_units(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as transcriptions: a title and a notice before the first page, a page for each turn with marks, figures and titles."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), "turn", F.length("text").alias("n"))
    t = F.col("turn")
    page = F.concat(F.lit("<!-- pagina "), t + 1, F.lit(" -->\n"), F.when(t % 3 == 0, F.concat(F.lit("## Part "), t, F.lit("\nwords behind it\n\n"))).otherwise(""), F.lit("<!-- teorema -->\nletters "), F.col("n"), F.lit(" ![figura](figuras/a.png)\n<!-- fin -->\n\n![figura](figuras/b.png \"x\")\n\n<!-- nota -->\n"))
    made = c.select("doc", "turn", page.alias("p")).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "p"))), lambda x: x["p"]), "").alias("p"))
    whole = made.select("doc", F.concat(F.lit("# Title\n\n> Transcripcion automatica SIN REVISAR. More.\n\n"), "p").alias("text"))
    return T.transcription_units(whole, ["teorema", "lema", "demostracion"]).select(F.col("doc").alias("conv_id"), F.col("n").cast("long").alias("n"), F.col("page").cast("long").alias("page"), "section", "kind", "cut", "text")


QUERIES = {f.__name__: f for f in (bibliography_round_trip, exports_spared, page_ranges, next_numbers, json_objects, template_hints, pade_orders, raw_heads, roman_labels, transcription_units, typed_markdown)}

_MARKED = "'% ' || substr(sha1({0}), 1, 16) || chr(10) || {0}"
_DIGITS = [["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"], ["", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"], ["", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"]]

SQL = {
    "bibliography_round_trip": """SELECT 'p' || p_partkey AS doc, p_name || ' "ñ"' AS title, CAST(CASE WHEN p_size % 7 > 0 THEN p_size + 1990 END AS BIGINT) AS year, p_brand || '; ' || p_type AS authors FROM part""",
    "exports_spared": f"""WITH t AS (SELECT c_custkey, c_name || chr(10) || c_mktsegment AS t FROM customer)
        SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 7 <> 0 THEN 'yours' ELSE 'written' END AS outcome, md5(CASE WHEN c_custkey % 3 = 0 AND c_custkey % 7 <> 0 THEN {_MARKED.format("t")} || '!' ELSE {_MARKED.format("upper(t)")} END) AS hash FROM t""",
    "page_ranges": """WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS q FROM lineitem),
        p AS (SELECT *, CASE WHEN q % 5 = 0 THEN range(1, l_linenumber * 4 + 1) ELSE list_filter(list_concat(range(q % 4, q % 4 + 3), [q, 2]), lambda x: x BETWEEN 1 AND l_linenumber * 4) END AS p FROM l)
        SELECT l_orderkey, l_linenumber, q, array_to_string(list_sort(list_distinct(p)), ',') AS pages FROM p""",
    "next_numbers": """SELECT 'orders' AS of, (SELECT min(n) FROM (SELECT 1 AS n UNION SELECT o_orderkey + 1 FROM orders WHERE o_orderkey >= 0) WHERE n NOT IN (SELECT o_orderkey FROM orders)) AS next
        UNION ALL SELECT 'sizes', (SELECT min(n) FROM (SELECT 1 AS n UNION SELECT p_size + 1 FROM part WHERE p_size >= 0) WHERE n NOT IN (SELECT p_size FROM part))""",
    "json_objects": "SELECT event_id, CASE WHEN event_id % 4 < 2 THEN props END AS object FROM events",
    "template_hints": "SELECT DISTINCT '(' || p_type || ' of RN [ID:pNN])' AS hint FROM part",
    "pade_orders": "SELECT o_custkey, CAST(m AS INTEGER) AS m FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL), (VALUES (2), (3), (4), (5), (6), (8), (10), (12)) AS t(m) WHERE 2 * m + 1 <= n",
    "raw_heads": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'id: ' || doc_id || chr(10) || 'no field here' END AS raw FROM documents",
    "roman_labels": f"SELECT p_partkey, '(' || repeat('m', CAST(k // 1000 AS INTEGER)) || ({_DIGITS[2]})[CAST(k // 100 % 10 AS INTEGER) + 1] || ({_DIGITS[1]})[CAST(k // 10 % 10 AS INTEGER) + 1] || ({_DIGITS[0]})[CAST(k % 10 AS INTEGER) + 1] || ')' AS label FROM (SELECT p_partkey, p_partkey % 3999 + 1 AS k FROM part)",
    "typed_markdown": """WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
        u AS (SELECT o_custkey, i, 0 AS j, 'titulo' AS kind, NULL AS number, 'Part ' || i AS t FROM o WHERE i % 3 = 1 UNION ALL
          SELECT o_custkey, i, 1, ['teorema', 'lema', 'demostracion', 'parrafo'][o_orderkey % 4 + 1], CASE WHEN o_orderkey % 4 < 3 THEN '2.' || i END, ['**Theorem', 'lemma', 'Proof', 'A plain paragraph'][o_orderkey % 4 + 1] || ' 2.' || i || '.** and forty letters more, which make it long, for order ' || o_orderkey FROM o)
        SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY i, j) AS n, i + 1 AS page, 'Part ' || (i - (i - 1) % 3) AS section, kind, number, CAST(length(t) AS BIGINT) AS chars FROM u""",
    "transcription_units": """WITH c AS (SELECT conv_id, turn, length(text) AS l, max(turn - turn % 3) OVER (PARTITION BY conv_id ORDER BY turn) AS p, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations),
        u AS (SELECT DISTINCT conv_id, -1 AS turn, 0 AS j, first + 1 AS page, 'Title' AS section, 'titulo' AS kind, 'Title' AS text FROM c UNION ALL SELECT conv_id, turn, 0, turn + 1, 'Part ' || p, 'titulo', 'Part ' || turn FROM c WHERE turn % 3 = 0
          UNION ALL SELECT conv_id, turn, 1, turn + 1, 'Part ' || p, 'parrafo', 'words behind it' FROM c WHERE turn % 3 = 0 UNION ALL SELECT conv_id, turn, 2, turn + 1, 'Part ' || p, 'parrafo', 'letters ' || l FROM c)
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, j) AS n, page, section, kind, kind = 'parrafo' AS cut, text FROM u""",
}
