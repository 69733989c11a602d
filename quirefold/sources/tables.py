"""Sources: tables by name, units and logs by schema, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions.text import stripped

UNIT = "n int, capa string, pagina int, seccion string, tipo string, label string, numero string, texto string, pagina_estimada boolean, corte_pagina boolean"
CALL = "ts string, comando string, fase string, proveedor string, modelo string, tokens_in bigint, tokens_out bigint, tokens_cache bigint, esfuerzo string, tokens_razonamiento bigint, max_tokens bigint, segundos double, cortada boolean, forzado boolean, simulado boolean"
TURN = "ts string, fase string, modelo string, esfuerzo string, turno int, plantilla string, fragmento string, pregunta string, respuesta string, citas array<string>, tokens_in bigint, tokens_out bigint, tokens_cache bigint, segundos double, cortada boolean"


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def units(spark: SparkSession, path: str) -> DataFrame:
    """Units of JSON lines files in a folder for each document; ``doc`` is the folder's name."""
    df = spark.read.schema(UNIT).json(path)
    return df.withColumn("doc", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def log(spark: SparkSession, path: str, schema: str = CALL) -> DataFrame:
    """Rows of a JSON lines log; blank and broken lines are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


def commits(lines: DataFrame, line: str = "value") -> DataFrame:
    """(ts, msg) of log lines with a time, a tab and a subject; others are left out."""
    parts = F.split(F.col(line), "\t", 2)
    return lines.where(F.contains(line, F.lit("\t"))).select(F.to_timestamp(parts[0]).alias("ts"), parts[1].alias("msg"))


def mark_kind(msg: Column) -> Column:
    """The kind of mark that a subject is, by how it begins; null for others."""
    # How subjects begin.
    begins = [("inicio sesion", "start"), ("inicio diagnostico", "start"), ("sellado :: fase 1", "seal1"), ("sellado :: diagnostico", "seal1"), ("ataque", "attack"), ("sellado :: fase 3", "seal3"), ("cierre", "close"), ("pausa", "pause"), ("reanud", "resume")]
    out = F.lit(None).cast("string")
    for text, kind in reversed(begins):
        out = F.when(F.startswith(msg, F.lit(text)), kind).otherwise(out)
    return out


def page_units(pages: DataFrame) -> DataFrame:
    """A unit for each page text (doc, pages) that isn't blank."""
    rows = pages.select("doc", F.posexplode("pages").alias("i", "text")).where(stripped(F.col("text")) != "")
    return rows.select("doc", (F.col("i") + 1).alias("page"), F.lit("pagina").alias("kind"), "text")


def marked_pages(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc, page, text) of bodies cut by page marker comments; what stands before the first is page 0."""
    marker = r"<!-- pagina (\d+) -->"
    numbers = F.concat(F.array(F.lit("0")), F.regexp_extract_all(text, F.lit(marker), F.lit(1)))
    parts = F.arrays_zip(numbers.alias("page"), F.split(text, marker, -1).alias("text"))
    return docs.select("doc", F.inline(parts)).select("doc", F.col("page").cast("int").alias("page"), stripped(F.col("text")).alias("text"))


def markdown_units(docs: DataFrame, text: str = "text", least: int = 40) -> DataFrame:
    """(doc, n, page, section, text) of converted markdown: pages by {n} rules, headings set the section, short blocks go."""
    from pyspark.sql import Window

    marker = r"\{(\d+)\}-{5,}"
    numbers = F.concat(F.array(F.lit("0")), F.regexp_extract_all(text, F.lit(marker), F.lit(1)))
    paged = docs.select("doc", F.posexplode(F.arrays_zip(numbers.alias("page"), F.split(text, marker, -1).alias("text"))).alias("i", "x"))
    blocks = paged.select("doc", "i", F.col("x.page").cast("int").alias("page"), F.posexplode(F.split("x.text", r"\n\s*\n")).alias("j", "text"))
    w = Window.partitionBy("doc").orderBy("i", "j")
    heading = F.nullif(F.trim(F.regexp_extract("text", r"^\s*#+\s*([^\n]+)", 1)), F.lit(""))
    blocks = blocks.withColumn("heading", heading).withColumn("section", F.last("heading", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = blocks.where(F.length(F.trim(F.regexp_replace(F.lower("text"), r"[^a-z0-9]+", " "))) >= least)
    return kept.select("doc", F.row_number().over(w).alias("n"), "page", "section", stripped(F.col("text")).alias("text"))


# Names of statements in converted papers, and their kinds; a proof is of the last.
STATEMENTS = {"theorem": "teorema", "lemma": "lema", "proposition": "proposicion", "corollary": "corolario", "definition": "definicion", "remark": "observacion", "example": "ejemplo", "notation": "notacion", "conjecture": "conjetura", "proof": "demostracion"}


def typed_markdown_units(docs: DataFrame, text: str = "text", least: int = 40) -> DataFrame:
    """(doc, n, page, section, kind, number, text) of converted markdown, by blocks between blank lines.

    {n} rules on lines of their own begin page n + 1; what stands before the first has none. A block that begins with a
    hash is a title, which sets the section; others that are too short go. A statement begins with its name, which may be bold, and the
    number that follows it; all else is a paragraph.
    """
    from pyspark.sql import Window

    marker = r"\n\{(\d+)\}-{5,}[ \t]*(?=\n)"
    whole = F.concat(F.lit("\n"), F.coalesce(text, F.lit("")))
    numbers = F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(whole, F.lit(marker), F.lit(1)))
    paged = docs.select("doc", F.posexplode(F.arrays_zip(numbers.alias("page"), F.split(whole, marker, -1).alias("text"))).alias("i", "x"))
    blocks = paged.select("doc", "i", (F.col("x.page").cast("int") + 1).alias("page"), F.posexplode(F.split("x.text", r"\n\s*\n")).alias("j", "text")).withColumn("text", stripped(F.col("text"))).where("text <> ''")
    w = Window.partitionBy("doc").orderBy("i", "j")
    title = F.startswith("text", F.lit("#"))
    name = stripped(F.regexp_replace("text", r"\A[# ]+", ""))
    blocks = blocks.withColumn("section", F.last(F.when(title, name), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = rf"(?i)\A\*{{0,2}}({'|'.join(STATEMENTS)})\b[ \t]*(\d+(?:\.\d+)*)?"
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STATEMENTS.items() for x in kv]), F.lower(F.regexp_extract("text", first, 1))), F.lit("parrafo"))
    kept = blocks.where(title | (F.length(F.trim(F.regexp_replace(F.lower("text"), r"[^a-z0-9]+", " "))) >= least))
    number = F.when(~title, F.nullif(F.regexp_extract("text", first, 2), F.lit("")))
    return kept.select("doc", F.row_number().over(w).alias("n"), "page", "section", F.when(title, "titulo").otherwise(kind).alias("kind"), number.alias("number"), F.when(title, name).otherwise(F.col("text")).alias("text"))


# What isn't text in a transcription (figures, marks of blocks) and the notice that it wasn't reviewed.
FIGURE = r'!\[figura\]\(figuras/[^)\s]+(?: "[^"]*")?\)'
NOTICE = "> Transcripcion automatica SIN REVISAR."


def transcription_units(docs: DataFrame, kinds: list[str], text: str = "text") -> DataFrame:
    """(doc, n, page, section, kind, cut, text) of transcriptions: titles and paragraphs with the page that a mark on a line of its own began.

    What stands before the first mark goes with the first page. Figures, marks of blocks (of ``kinds``, and their ends),
    the notice and other comments are no text. A block that begins with a hash is a title to the end of its line, which sets
    the section, and what follows is a paragraph. ``cut`` says that a paragraph isn't joined with those of other pages.
    """
    from pyspark.sql import Window

    mark = r"(?m)^<!-- pagina (\d+) -->[ \t]*$"
    body = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(body, F.lit(mark), F.lit(1))
    numbers = F.concat(F.array(F.get(found, F.lit(0))), found)
    paged = docs.select("doc", F.posexplode(F.arrays_zip(numbers.alias("page"), F.split(body, mark, -1).alias("text"))).alias("i", "x"))
    blocks = paged.select("doc", "i", F.col("x.page").cast("int").alias("page"), F.posexplode(F.split("x.text", r"\n\s*\n")).alias("j", "text"))
    block_mark = rf"(?m)^<!-- (?:{'|'.join(kinds)}|fin) -->[ \t]*$"
    blocks = blocks.withColumn("text", stripped(F.regexp_replace(F.regexp_replace(stripped(F.col("text")), FIGURE, ""), block_mark, "")))
    blocks = blocks.where((F.col("text") != "") & ~F.startswith("text", F.lit(NOTICE)) & ~F.startswith("text", F.lit("<!--")))
    title = F.startswith("text", F.lit("#"))
    name = stripped(F.regexp_replace(F.substring_index("text", "\n", 1), r"\A[# ]+", ""))
    rest = F.when(title, stripped(F.regexp_replace("text", r"\A[^\n]*\n?", ""))).otherwise(F.col("text"))
    parts = F.filter(F.array(F.when(title, F.struct(F.lit("titulo").alias("kind"), name.alias("text"))), F.when(rest != "", F.struct(F.lit("parrafo").alias("kind"), rest.alias("text")))), lambda x: x.isNotNull())
    w = Window.partitionBy("doc").orderBy("i", "j")
    made = blocks.withColumn("section", F.last(F.when(title, name), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).select("doc", "i", "j", "page", "section", F.posexplode(parts).alias("k", "x"))
    order = Window.partitionBy("doc").orderBy("i", "j", "k")
    return made.select("doc", F.row_number().over(order).alias("n"), "page", "section", "x.kind", (F.col("x.kind") == "parrafo").alias("cut"), "x.text")


def html_head(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with ``title``, ``lang``, ``charset`` and ``metas`` (map of meta names to their first value)."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)(<meta\s[^>]*>)"), F.lit(1))
    attr = lambda tag, name: F.regexp_extract(tag, rf"(?i)\s{name}=[\"']([^\"']*)[\"']", 1)
    pairs = F.transform(tags, lambda t: F.struct(F.lower(F.coalesce(F.nullif(attr(t, "name"), F.lit("")), attr(t, "property"))).alias("k"), attr(t, "content").alias("v")))
    named = F.filter(pairs, lambda p: p["k"] != "")
    first = F.filter(named, lambda p, i: F.array_position(F.transform(named, lambda q: q["k"]), p["k"]) == i + 1)
    text = lambda pattern: F.nullif(F.trim(F.regexp_extract(html, pattern, 1)), F.lit(""))
    return pages.withColumn("title", text(r"(?is)<title[^>]*>(.*?)</title>")).withColumn("lang", text(r"(?i)<html[^>]*\slang=[\"']([^\"']*)")).withColumn("charset", text(r"(?i)<meta[^>]*charset=[\"']?([A-Za-z0-9_-]+)")).withColumn("metas", F.map_from_entries(first))
