"""Queries on notes, made as texts from the orders and their lines, and their SQL, which takes the same rows without texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.functions import text as X
from quirefold.operators import notes as N
from quirefold.sources.tables import table

HINT = "(Di aqui con tus palabras que dice R1, sin mirar el paper)"


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("doc"), F.row_number().over(w).alias("i"), (F.col("o_orderkey") % 7).cast("int").alias("k"), F.to_date("o_orderdate").cast("string").alias("day"), F.col("o_orderstatus").alias("status"))


def _notes(spark: SparkSession, sf: str) -> DataFrame:
    """A note for each customer, with a block for each order."""
    i, k = F.col("i").cast("string"), F.col("k")
    kind = F.element_at(F.array(*map(F.lit, ("Teorema", "Lemma", "Proposición", "Remark", "Nada", "Corollary", "Definicion"))), k + 1)
    own = F.concat(F.lit(HINT.replace("R1", "R")), F.lit("\n"), F.repeat(F.concat("status", F.lit(" explica ")), k * 6))
    own = F.regexp_replace(own, r"dice R,", F.concat(F.lit("dice R"), i, F.lit(",")))
    tries = F.array_join(F.transform(F.sequence(F.lit(1), k + 1), lambda x: F.concat(F.lit("- "), "day", F.lit(" | nivel "), x.cast("string"), F.lit(" | "), x.cast("string"), F.lit(".5 min | s"), i)), "\n")
    name = F.when(k % 2 == 0, "### Reconstruccion (fase 3, a ciegas)").otherwise("### Mi explicacion")
    one = F.concat(F.lit("## R"), i, F.lit(" — "), kind, F.lit(" "), k.cast("string"), F.lit("."), i, F.lit(" (x)\n### Enunciado\n"), F.repeat(F.lit("palabra "), k), F.lit("\n- modo: "), "status", F.lit("\n"), name, F.lit("\n"), own, F.lit("\nIntentos:\n"), tries, F.lit("\n"))
    made = _orders(spark, sf).select("doc", "i", one.alias("t")).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]), "").alias("t"))
    return made.select("doc", F.concat(F.lit("# Nota\n## Mapa\ntiempo: 5\nalgo\n"), "t", F.lit("## Dudas\nninguna\n")).alias("text"))


def note_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of all notes with their printed numbers and kinds."""
    b = N.blocks(_notes(spark, sf))
    both = N.kind_and_number(F.col("title"))
    return b.select(F.col("doc").cast("long").alias("custkey"), "rid", "title", N.printed_number(F.col("title")).alias("number"), both["kind"].alias("kind"), N.value_line(F.col("body"), "modo").alias("mode"))


def note_attempts(spark: SparkSession, sf: str) -> DataFrame:
    rows = N.blocks(_notes(spark, sf)).select("doc", "rid", F.posexplode(N.attempts(F.col("body"))).alias("n", "x"))
    return rows.select(F.col("doc").cast("long").alias("custkey"), "rid", "n", F.col("x.date").cast("string").alias("date"), "x.level", "x.minutes", "x.session")


def note_state(spark: SparkSession, sf: str) -> DataFrame:
    """Fields written, attempts, last attempt and last check of each block; orders of the status F have been checked."""
    hints = F.array(N.hint(F.lit(HINT)))
    checks = _orders(spark, sf).where("status = 'F'").select("doc", F.concat(F.lit("R"), F.col("i").cast("string")).alias("rid"), F.concat("day", F.lit(".md")).alias("file"))
    b = N.note_state(N.blocks(_notes(spark, sf)), hints, checks)
    own = N.own_text(N.subsection(F.col("body"), "Reconstruccion", flexible=True), hints)
    return b.select(F.col("doc").cast("long").alias("custkey"), "rid", F.array_join("written", ",").alias("written"), F.col("tries").cast("long").alias("tries"), F.col("last.level").alias("last_level"), "last_check", N.valid_explanation(own).alias("valid"))


def note_block(spark: SparkSession, sf: str) -> DataFrame:
    """The second block of each note, by its id."""
    b = N.block(N.blocks(_notes(spark, sf)), " r2")
    return b.select(F.col("doc").cast("long").alias("custkey"), F.length(N.subsection(F.col("body"), "Enunciado")).alias("chars"))


def note_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of sections and the first one's time, by note."""
    items = N.diagnostic_items(_notes(spark, sf))
    return items.groupBy("doc").agg(F.count("*").alias("sections"), F.sum("minutes").alias("minutes"), F.min(F.when(F.col("title") == "Mapa", F.col("body"))).alias("map")).select(F.col("doc").cast("long").alias("custkey"), "sections", "minutes", "map")


def heading_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Anchors of orders as headings by their status and priority."""
    slug = X.slug(X.unaccented(F.concat_ws(" ", "o_orderstatus", "o_orderpriority")))
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", slug.alias("slug"))
    return N.heading_slugs(rows, ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", "anchor")


def _lists(spark: SparkSession, sf: str) -> DataFrame:
    """A register for each customer: open and structural gaps, cards and a reading list, an order each."""
    i = F.col("i").cast("string")
    gap = F.concat(N.gap_line(F.col("day"), F.lit("sesion"), F.lit("f2"), F.concat(F.lit("tema"), F.col("k").cast("string"), F.lit(" : x"))), F.when(F.col("k") == 3, " ESTRUCTURAL").otherwise(""))
    card = F.concat(F.lit("p"), i, F.lit(" :: r"), F.when(F.col("k") < 2, " VERIFICAR CON PAPER").otherwise(""))
    read = F.concat(F.lit("- ["), F.when(F.col("status") == "F", "x").when(F.col("status") == "P", "~").otherwise(" "), F.lit("] titulo "), F.col("k").cast("string"))
    rows = _orders(spark, sf).select("doc", "i", gap.alias("g"), card.alias("c"), read.alias("r"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", c))), lambda x: x[c]), "\n")
    made = rows.groupBy("doc").agg(joined("g").alias("g"), joined("c").alias("c"), joined("r").alias("r"))
    return made.select("doc", F.concat(F.lit("```\n- [ ] example :: no\n```\n"), "g", F.lit("\n# x :: y\n`a :: b`\n"), "c", F.lit("\n## Nucleo de lecturas\n"), "r", F.lit("\n## Otros\n- [ ] fuera\n")).alias("text"))


def register_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Open and structural gaps, cards and waiting cards of each register."""
    gaps, cards = N.gap_counts(F.col("text")), N.card_counts(N.without_code(F.col("text")))
    return _lists(spark, sf).select(F.col("doc").cast("long").alias("custkey"), gaps["pending"].cast("long").alias("pending"), gaps["structural"].cast("long").alias("structural"), cards["cards"].cast("long").alias("cards"), cards["waiting"].cast("long").alias("waiting"))


def reading_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the reading lists, resolved to the customer's order of that number where there is one, and marked by their prices."""
    lines = N.reading_list(_lists(spark, sf))
    ids = _orders(spark, sf).select("doc", F.concat(F.lit("titulo "), F.col("k").cast("string")).alias("title"), F.col("i").alias("id"))
    known = N.resolved(lines, ids, ["doc", "title"]).withColumn("id", F.concat_ws(":", "doc", F.col("id").cast("string")))
    read = _orders(spark, sf).where("k in (1, 2)").select(F.concat_ws(":", "doc", F.col("i").cast("string")).alias("id"), (F.col("k") == 1).alias("cold"))
    return N.marked_read(known, read).select(F.col("doc").cast("long").alias("custkey"), F.col("pos").cast("int").alias("pos"), "title", "mark", F.contains("id", F.lit(":")).alias("resolved"))


def register_append(spark: SparkSession, sf: str) -> DataFrame:
    """A register of gaps of the finished orders after those of all orders are appended; topics of a customer count once."""
    rows = _orders(spark, sf).select("doc", F.concat(F.lit("t"), F.col("k").cast("string")).alias("topic"), F.concat("day", F.lit("-"), F.lpad("i", 4, "0")).alias("seq"), "status")
    w = Window.partitionBy("doc", "topic").orderBy("seq")
    stored = rows.where("status = 'F'").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    made = N.appended(stored, rows, ["doc", "topic"])
    return made.select(F.col("doc").cast("long").alias("custkey"), "topic", "seq", "status")


def transcription_files(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as files, of which some are transcriptions, with their originals."""
    c = table(spark, sf, "customer")
    head = F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("---\nestado: "), F.when(F.col("c_custkey") % 3 == 1, "revisado").otherwise("sin_revisar"), F.lit("\ntipo: curso\n---\n"))).otherwise("---\ntipo: curso\n---\n")
    files = c.select(F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, "pdf").otherwise("jpg").alias("ext"), F.concat(head, F.lit("body")).alias("text"))
    ends = c.select(F.col("c_name").alias("name"), F.explode(F.array(*map(F.lit, ("heic", "jpg", "png")))).alias("ext"), "c_custkey").where("ext <> 'jpg' or c_custkey % 5 > 0")
    made = N.with_original(N.transcriptions(files).select("name", "ext", "state"), ends.select("name", F.concat_ws(".", "name", "ext").alias("file"), "ext"))
    return made.select("name", "state", "original")


def valid_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as boxes: those that are ones, by order."""
    q, d = F.col("l_quantity") * 2, F.col("l_discount") * 500
    ok = N.valid_box(F.col("l_tax") * 100, F.col("l_linenumber") * 5.0, q, d + 55)
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count_if(ok).alias("boxes"))


def occupied_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of orders as paragraphs: returned ones open a block, the next accepted one closes it."""
    text = F.when(F.col("l_returnflag") == "R", "<!-- teorema -->").when(F.col("l_returnflag") == "A", "<!-- fin -->").otherwise("text")
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    rows = table(spark, sf, "lineitem").select("l_suppkey", F.row_number().over(w).alias("n"), text.alias("text"))
    return N.occupied(rows, ["l_suppkey"], "n").groupBy("l_suppkey").agg(F.count_if("taken").alias("taken"), F.count("*").alias("n"))


def structure_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an order as a reply's lines: which of them are accepted."""
    a = F.col("l_linenumber") * 3
    line = F.concat(a.cast("string"), F.lit("-"), (a + (F.col("l_quantity") % 6).cast("int")).cast("string"), F.lit(": lema"), F.when(F.col("l_returnflag") == "N", " sigue").otherwise(""))
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_extendedprice")
    rows = table(spark, sf, "lineitem").withColumn("_r", F.row_number().over(w)).where("_r = 1").select("l_orderkey", "l_linenumber", line.alias("t"))
    replies = rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "t"))), lambda x: x["t"]), "\n").alias("reply"))
    made = replies.select("l_orderkey", F.explode(N.structure_reply(F.col("reply"), F.lit(22))).alias("x"))
    return made.select("l_orderkey", F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.col("x.goes_on").alias("goes_on"))


def newest_threads(spark: SparkSession, sf: str) -> DataFrame:
    """The 40 newest orders of each priority, as threads that are still remembered."""
    rows = table(spark, sf, "orders").select("o_orderpriority", F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("last"))
    return N.newest(rows, ["o_orderpriority"], "last").select("o_orderpriority", F.col("id").alias("o_orderkey"))


def command_options(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens and effort by the events' types, with defaults; one type has no effort on purpose."""
    tokens = F.create_map(F.lit("view"), F.lit(2500), F.lit("click"), F.lit(800))
    effort = F.create_map(F.lit("view"), F.lit("low"), F.lit("error"), F.lit(None).cast("string"))
    rows = table(spark, sf, "events").select("event_type", N.option(tokens, F.col("event_type"), F.lit(1000)).alias("tokens"), N.option(effort, F.col("event_type"), F.lit("high")).alias("effort"))
    return rows.groupBy("event_type", "tokens", "effort").agg(F.count("*").alias("n"))


def base_weeks(spark: SparkSession, sf: str) -> DataFrame:
    """The plan's section for the week that each order's state tells; plans are made for the customers."""
    o = _orders(spark, sf)
    states = o.select("doc", "i", F.concat(F.lit("Fase: "), F.when(F.col("k") < 6, "BASE en marcha, ").otherwise("libre, "), F.lit("semana "), F.col("k") + 1, F.lit(" de 7")).alias("line"))
    plan = o.select("doc").distinct().select("doc", F.concat(F.lit("# Plan\n## Semana 1. Uno de "), "doc", F.lit("\nTexto: libro\n\nMeta al acabar: a\nb\n\nmas\n## Semanas 2-4. Dos\nMeta al acabar: c\n## Semana 6. Tres\nnada\n")).alias("text"))
    return N.week_of(states, plan).select(F.col("doc").cast("long").alias("custkey"), "i", "week", "title", "goal")


def pasted_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as passages that are pasted under a command, or without one."""
    command = F.element_at(F.array(*map(F.lit, ("/lema ", "/pegar\n", "", "/lemas "))), (F.col("turn") % 4 + 1).cast("int"))
    p = N.pasted(F.concat(command, F.lit("word "), "conv_id", F.when(F.col("conv_id") % 2 == 0, "\n.\n").otherwise("")))
    return table(spark, sf, "conversations").select("conv_id", "turn", p["command"].alias("command"), p["text"].alias("text"))


def pending_registers(spark: SparkSession, sf: str) -> DataFrame:
    """Open lines of the section of pending ones, and the section of phase 3, of registers by customer."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "status"))), lambda x: F.concat(F.when(x["status"] == "O", "- [ ] ").otherwise("- [x] "), x["i"].cast("string"))), "\n")
    text = _orders(spark, sf).groupBy("doc").agg(F.concat(F.lit("- [ ] no\n## Pendientes\n"), lines, F.lit("\n## Fase 3 - Ataque (a ciegas)\n"), F.count("*"), F.lit("\n## Hechas\n- [ ] no")).alias("text"))
    return text.select(F.col("doc").cast("long").alias("custkey"), F.size(N.pending_lines(F.col("text"))).cast("long").alias("pending"), N.text_or_section(F.col("text"), "Fase 3").alias("phase3"))


QUERIES = {f.__name__: f for f in (note_blocks, note_attempts, note_state, note_block, note_sections, heading_anchors, register_counts, reading_lines, register_append, transcription_files, valid_boxes, occupied_paragraphs, structure_replies, newest_threads, command_options, base_weeks, pasted_passages, pending_registers)}

_O = "o AS (SELECT o_custkey AS custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS i, CAST(o_orderkey % 7 AS INTEGER) AS k, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderstatus AS status FROM orders)"

SQL = {
    "base_weeks": f"""WITH {_O} SELECT custkey, i, CASE WHEN k < 6 THEN k + 1 END AS week, CASE WHEN k = 0 THEN 'Uno de ' || custkey WHEN k BETWEEN 1 AND 3 THEN 'Dos' WHEN k = 5 THEN 'Tres' END AS title, CASE WHEN k = 0 THEN 'a b' WHEN k BETWEEN 1 AND 3 THEN 'c' END AS goal FROM o""",
    "pasted_passages": "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '/lema' WHEN 1 THEN '/pegar' END AS command, CASE turn % 4 WHEN 3 THEN '/lemas ' ELSE '' END || 'word ' || conv_id AS text FROM conversations",
    "pending_registers": f"WITH {_O} SELECT custkey, count(*) FILTER (status = 'O') AS pending, CAST(count(*) AS VARCHAR) AS phase3 FROM o GROUP BY custkey",
    "note_blocks": f"""WITH {_O} SELECT custkey, 'R' || i AS rid, ['Teorema', 'Lemma', 'Proposición', 'Remark', 'Nada', 'Corollary', 'Definicion'][k + 1] || ' ' || k || '.' || i || ' (x)' AS title, k || '.' || i AS number,
        ['teorema', 'lema', 'proposicion', '', '', 'corolario', 'definicion'][k + 1] AS kind, status AS mode FROM o""",
    "note_attempts": f"WITH {_O} SELECT custkey, 'R' || i AS rid, CAST(x - 1 AS INTEGER) AS n, day AS date, CAST(least(x, 3) AS INTEGER) AS level, x + 0.5::DOUBLE AS minutes, 's' || i AS session FROM o, range(1, k + 2) AS t(x)",
    "note_state": f"""WITH {_O} SELECT custkey, 'R' || i AS rid, concat_ws(',', CASE WHEN k * 8 - 1 + length('\n- modo: ' || status) > 40 THEN 'Enunciado' END, CASE WHEN length(status || ' explica ') * k * 6 - 1 > 40 THEN 'Reconstruccion' END) AS written,
        CAST(k + 1 AS BIGINT) AS tries, CAST(least(k + 1, 3) AS INTEGER) AS last_level, CASE WHEN status = 'F' THEN day || '.md' END AS last_check, length(status || ' explica ') * k * 6 - 1 >= 200 AS valid FROM o""",
    "note_block": f"WITH {_O} SELECT custkey, CAST(length(trim(repeat('palabra ', k) || chr(10) || '- modo: ' || status, ' ' || chr(10))) AS INTEGER) AS chars FROM o WHERE i = 2",
    "note_sections": f"WITH {_O} SELECT custkey, count(*) + 2 AS sections, (count(*) + 1) * 20 + 5 AS minutes, 'algo' AS map FROM o GROUP BY custkey",
    "heading_anchors": """WITH s AS (SELECT o_custkey, o_orderkey, trim(regexp_replace(lower(o_orderstatus || ' ' || o_orderpriority), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, slug ORDER BY o_orderkey) AS n FROM s)
        SELECT o_custkey, o_orderkey, CASE WHEN n > 1 THEN slug || '-' || n ELSE slug END AS anchor FROM r""",
    "register_counts": f"WITH {_O} SELECT custkey, count(*) + count(*) FILTER (status NOT IN ('F', 'P')) + 1 AS pending, count(*) FILTER (k = 3) AS structural, count(*) AS cards, count(*) FILTER (k < 2) AS waiting FROM o GROUP BY custkey",
    "reading_lines": f"""WITH {_O}, u AS (SELECT *, count(*) OVER (PARTITION BY custkey, k) AS same FROM o)
        SELECT custkey, i - 1 AS pos, 'titulo ' || k AS title, CASE WHEN same = 1 AND k = 1 THEN 'x' WHEN same = 1 AND k = 2 THEN '~' WHEN status = 'F' THEN 'x' WHEN status = 'P' THEN '~' ELSE ' ' END AS mark, same = 1 AS resolved FROM u""",
    "register_append": f"WITH {_O} SELECT custkey, 't' || k AS topic, day || '-' || lpad(CAST(i AS VARCHAR), 4, '0') AS seq, status FROM o QUALIFY row_number() OVER (PARTITION BY custkey, k ORDER BY status <> 'F', seq) = 1",
    "transcription_files": """SELECT c_name AS name, CASE WHEN c_custkey % 3 = 1 THEN 'revisado' ELSE 'sin_revisar' END AS state, c_name || CASE WHEN c_custkey % 2 = 1 AND c_custkey % 5 > 0 THEN '.jpg' ELSE '.heic' END AS original FROM customer WHERE c_custkey % 3 > 0""",
    "valid_boxes": """WITH b AS (SELECT l_orderkey, l_tax * 100 AS x0, l_linenumber * 5.0::DOUBLE AS y0, l_quantity * 2 AS x1, l_discount * 500 + 55 AS y1 FROM lineitem)
        SELECT l_orderkey, count(*) FILTER (x0 >= 0 AND x0 < x1 AND x1 <= 100 AND y0 >= 0 AND y0 < y1 AND y1 <= 100 AND (x1 - x0) * (y1 - y0) <= 9000) AS boxes FROM b GROUP BY l_orderkey""",
    "occupied_paragraphs": """WITH r AS (SELECT l_suppkey, l_returnflag AS f, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS n FROM lineitem),
        b AS (SELECT *, coalesce(sum(CASE f WHEN 'R' THEN 1 WHEN 'A' THEN -1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open FROM r) SELECT l_suppkey, count(*) FILTER (f IN ('R', 'A') OR open > 0) AS taken, count(*) AS n FROM b GROUP BY l_suppkey""",
    "structure_replies": """WITH RECURSIVE d AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_extendedprice) = 1),
        x AS MATERIALIZED (SELECT l_orderkey, l_linenumber * 3 AS a, l_linenumber * 3 + CAST(l_quantity % 6 AS INTEGER) AS b, l_returnflag = 'N' AS goes_on, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM d WHERE l_linenumber * 3 + CAST(l_quantity % 6 AS INTEGER) <= 22),
        r(l_orderkey, n, ok, reach) AS (SELECT l_orderkey, n, true, b FROM x WHERE n = 1 UNION ALL SELECT x.l_orderkey, x.n, x.a > r.reach, CASE WHEN x.a > r.reach THEN x.b ELSE r.reach END FROM r JOIN x ON x.l_orderkey = r.l_orderkey AND x.n = r.n + 1)
        SELECT x.l_orderkey, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, goes_on FROM x JOIN r ON r.l_orderkey = x.l_orderkey AND r.n = x.n WHERE ok""",
    "newest_threads": "SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) <= 40",
    "command_options": "SELECT event_type, CASE event_type WHEN 'view' THEN 2500 WHEN 'click' THEN 800 ELSE 1000 END AS tokens, CASE event_type WHEN 'view' THEN 'low' WHEN 'error' THEN NULL ELSE 'high' END AS effort, count(*) AS n FROM events GROUP BY ALL",
}
