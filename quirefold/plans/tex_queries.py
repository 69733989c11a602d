"""Queries on TeX sources, made from the orders of each customer, and their SQL, which takes the same rows without sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.operators import tex as T
from quirefold.sources.shared import stored
from quirefold.sources.tables import table

BAR = "Some words that stand between statements so that a paragraph has more than sixty letters "


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("doc"), F.row_number().over(w).alias("i"), "o_orderkey", (F.col("o_orderkey") % 4).alias("k"))


def _statement() -> F.Column:
    return F.concat(F.lit("Let order o"), "o_orderkey", F.lit(" of client c"), "doc", F.lit(" hold under price p"), F.col("o_orderkey") * 7, F.lit(" always"))


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    """A section every third order, a paragraph and a statement for each; each statement refers to itself, the one before and a list's item."""
    env = F.element_at(F.array(*map(F.lit, ("thm", "satz", "proof", "hyp"))), (F.col("k") + 1).cast("int"))
    section = F.when(F.col("i") % 3 == 1, F.concat(F.lit("\\section{Part {\\bf "), "i", F.lit("}\n of it}\n"))).when(F.col("i") % 3 == 0, "\\subsection*{More}\n").otherwise("")
    refs = F.concat(F.lit(" by Lemmas~\\ref{l"), "i", F.lit("}, (\\ref{it1}), \\eqref{eq} and \\cref{l"), F.col("i") - 1, F.lit("}"))
    one = F.concat(section, F.lit("short % comment with \\section{no}\n\n"), F.lit(BAR), F.lit("for $x$ \\emph{n"), "i", F.lit("}.\n\n\\begin{"), env, F.lit("}[opt]\\label{l"), "i", F.lit("}"), _statement(), refs, F.lit("\\end{"), env, F.lit("}\n"))
    made = _orders(spark, sf).select("doc", "i", one.alias("t")).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]), "").alias("t"))
    pre = "\\documentclass{x}\\newtheorem{satz}[thm]{Lemma of use}\\newtheorem*{hyp}{Own Case}\\begin{document}"
    post = "\\begin{enumerate}[(i)]\\item a \\item\\label{it1} b\\end{enumerate}\n$$y \\tag{7}\\label{eq}$$\\end{document}\\section{after}"
    return made.select("doc", F.concat(F.lit(pre), "t", F.lit(post)).alias("tex"))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """Printed pages, of two orders each, whose statements have numbers."""
    name = F.when(F.col("k") == 0, "Theorem ").when(F.col("k") == 1, "Lemma ").otherwise("")
    one = _orders(spark, sf).select("doc", (F.floor((F.col("i") - 1) / 2) + 1).cast("int").alias("page"), "i", F.concat(F.lit(BAR), F.lit("n"), "i", F.lit(". "), name, F.when(F.col("k") < 2, F.concat("i", F.lit(".1. (Watson). "))).otherwise(""), _statement(), F.lit(". ")).alias("t"))
    return one.groupBy("doc", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]), "").alias("text"))


def tex_units(spark: SparkSession, sf: str) -> DataFrame:
    """Units of all sources."""
    u = T.tex_units(_sources(spark, sf))
    return u.select(F.col("doc").cast("long").alias("custkey"), F.col("n").cast("int").alias("n"), "section", "kind", "label", F.length("text").alias("chars"))


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    # units and pages are read several times, but parsed once
    units, pages = stored(T.tex_units(_sources(spark, sf)), "units"), stored(_pages(spark, sf), "pages")
    return T.with_printed_numbers(stored(T.with_pages(units, pages), "placed"), pages)


def tex_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages and printed numbers of labelled statements."""
    u = _numbered(spark, sf).where("label is not null")
    return u.select(F.col("doc").cast("long").alias("custkey"), "label", "kind", "page", "estimated", "number")


def tex_references(spark: SparkSession, sf: str) -> DataFrame:
    """Statements whose references are resolved by statements' numbers, lists' items and tags: what is behind their own words."""
    units = stored(_numbered(spark, sf), "numbered")
    listed = _sources(spark, sf).select("doc", F.inline(T.printed_labels(F.col("tex"))))
    done = T.resolved_references(units, T.statement_labels(units).unionByName(listed)).where("label is not null")
    return done.select(F.col("doc").cast("long").alias("custkey"), "label", F.regexp_extract("text", r"(by Lemmas.*)$", 1).alias("tail"))


def item_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Printed labels of the orders' lines as items of lists, in five styles."""
    style = F.element_at(F.array(*map(F.lit, ("(A)", "a)", " [I] ", "i.", "1"))), (F.col("l_orderkey") % 5 + 1).cast("int"))
    k = (F.col("l_partkey") % 60 + 1).cast("int")
    return table(spark, sf, "lineitem").select("l_orderkey", k.alias("k"), T.item_label(style, k).alias("printed")).distinct()


def tex_inlined(spark: SparkSession, sf: str) -> DataFrame:
    """Projects of a main file that takes in chapters, an order each, which take in a common file."""
    o = _orders(spark, sf)
    main = o.groupBy("doc").agg(F.concat(F.lit("\\begin{document}"), F.array_join(F.transform(F.array_sort(F.collect_list("i")), lambda i: F.concat(F.lit("\\input{./ch"), i, F.lit("}"))), ""), F.lit("\\include{lost}")).alias("text")).withColumn("name", F.lit("main.tex"))
    chapters = o.select("doc", F.concat(F.lit("<"), "i", F.lit("\\input{common.tex}>")).alias("text"), F.concat(F.lit("ch"), "i", F.lit(".tex")).alias("name"))
    common = o.select("doc", F.lit("*").alias("text"), F.lit("common.tex").alias("name")).distinct()
    made = T.inlined(main.unionByName(chapters).unionByName(common))
    return made.select(F.col("doc").cast("long").alias("custkey"), F.md5("tex").alias("hash"))


QUERIES = {f.__name__: f for f in (tex_units, tex_pages, tex_references, item_labels, tex_inlined)}

_O = "o AS (SELECT o_custkey AS custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS i, o_orderkey, o_orderkey % 4 AS k, 'Let order o' || o_orderkey || ' of client c' || o_custkey || ' hold under price p' || (o_orderkey * 7) || ' always' AS st FROM orders)"
_ROMAN = "[" + ", ".join(f"'{t}{u}'" for t in ["", "x", "xx", "xxx", "xl", "l", "lx"] for u in ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"]) + "]"
SQL = {
    "tex_units": f"""WITH {_O}, u AS (SELECT custkey, i, 0 AS j, 'titulo' AS kind, NULL AS label, CASE WHEN i % 3 = 1 THEN length('Part {{\\bf ' || i || '}} of it') ELSE 4 END AS chars FROM o WHERE i % 3 <> 2
          UNION ALL SELECT custkey, i, 1, 'parrafo', NULL, {len(BAR)} + length('for $x$ \\emph{{n' || i || '}}.') FROM o
          UNION ALL SELECT custkey, i, 2, ['teorema', 'lema', 'demostracion', 'own-case'][k + 1], 'l' || i, length('\\label{{l' || i || '}}' || st || ' by Lemmas~\\ref{{l' || i || '}}, (\\ref{{it1}}), \\eqref{{eq}} and \\cref{{l' || (i - 1) || '}}') FROM o)
        SELECT custkey, CAST(row_number() OVER (PARTITION BY custkey ORDER BY i, j) - 1 AS INTEGER) AS n, CAST((i + 2) // 3 AS VARCHAR) || CASE WHEN i % 3 = 0 THEN '.1' ELSE '' END AS section, kind, label, CAST(chars AS INTEGER) AS chars FROM u""",
    "tex_pages": f"WITH {_O} SELECT custkey, 'l' || i AS label, ['teorema', 'lema', 'demostracion', 'own-case'][k + 1] AS kind, CAST((i - 1) // 2 + 1 AS INTEGER) AS page, false AS estimated, CASE WHEN k < 2 THEN i || '.1' END AS number FROM o",
    "tex_references": f"""WITH {_O}, p AS (SELECT *, lag(k) OVER (PARTITION BY custkey ORDER BY i) AS pk FROM o)
        SELECT custkey, 'l' || i AS label, 'by Lemmas~' || CASE k WHEN 0 THEN 'Theorem ' || i || '.1' WHEN 1 THEN i || '.1' ELSE '\\ref{{l' || i || '}}' END || ', (ii), (7) and ' || CASE pk WHEN 0 THEN 'Theorem ' || (i - 1) || '.1' WHEN 1 THEN 'Lemma ' || (i - 1) || '.1' ELSE '\\cref{{l' || (i - 1) || '}}' END AS tail FROM p""",
    "item_labels": f"""WITH x AS (SELECT DISTINCT l_orderkey, CAST(l_partkey % 60 + 1 AS INTEGER) AS k FROM lineitem), y AS (SELECT *, CASE WHEN k <= 26 THEN chr(k + 96) ELSE CAST(k AS VARCHAR) END AS a, {_ROMAN}[k + 1] AS r FROM x)
        SELECT l_orderkey, k, CASE l_orderkey % 5 WHEN 0 THEN '(' || upper(a) || ')' WHEN 1 THEN a || ')' WHEN 2 THEN '[' || upper(r) || ']' WHEN 3 THEN r || '.' ELSE CAST(k AS VARCHAR) END AS printed FROM y""",
    "tex_inlined": f"WITH {_O} SELECT custkey, md5('\\begin{{document}}' || string_agg('<' || i || '*>', '' ORDER BY i)) AS hash FROM o GROUP BY custkey",
}
