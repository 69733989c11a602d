"""Notes, readings and transcriptions as text: blocks, fields, attempts, lists, headings, counts.

Texts are columns; what is found in them comes back as columns or as rows by document. All of it is expressions of the
JVM, so that a note is parsed where it is read.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions.text import header_fields, stripped, unaccented

# The fields of a result's block, kinds of statements with their Spanish names, an attempt's line.
FIELDS = ("Enunciado", "Hipotesis, y por que cada una", "Lema clave", "Que se rompe sin el", "Desarrollo", "Reconstruccion", "Derivaciones y reformulaciones", "Donde se usa")
LEGACY = {"Reconstruccion": "Mi explicacion"}
KIND_NAMES = {"teorema": "teorema", "theorem": "teorema", "lema": "lema", "lemma": "lema", "proposicion": "proposicion", "proposition": "proposicion", "corolario": "corolario", "corollary": "corolario", "definicion": "definicion", "definition": "definicion"}
MORE_KINDS = ("observacion", "remark", "ejemplo", "example")
ATTEMPT = r"(?m)^- (\d{4}-\d{2}-\d{2}) \| nivel (\d+) \| ([\d.]+) min \| (.*)$"
OWN_LEAST, WRITTEN_LEAST = 200, 40


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of a pattern's first match; null where there is none."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(0))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), for which value is taken once, however often use has it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc, i, title, body): the parts of texts under headings of the second level; what stands before has no title."""
    parts = docs.select("doc", F.posexplode(F.split(text, r"(?m)^## ")).alias("i", "_part"))
    title = F.when(F.col("i") > 0, stripped(F.substring_index("_part", "\n", 1)))
    body = F.when(F.col("i") == 0, F.col("_part")).otherwise(F.regexp_replace("_part", r"\A[^\n]*\n?", ""))
    return parts.select("doc", "i", title.alias("title"), stripped(body).alias("body")).where("title is not null or body <> ''")


def blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc, i, rid, title, body): the blocks of results, headed by R, a number, a dash and a title."""
    head = r"^(R\d+)\s*[—–-]+\s*(.+)$"
    return sections(docs, text).where(F.col("title").rlike(head)).select("doc", "i", F.regexp_extract("title", head, 1).alias("rid"), stripped(F.regexp_extract("title", head, 2)).alias("title"), "body")


def block(blocks_: DataFrame, rid: str) -> DataFrame:
    """The block of each document with an id, in any case of letters."""
    return blocks_.where(F.col("rid") == rid.strip().upper())


def subsection(body: Column, name: str, flexible: bool = False) -> Column:
    """What stands under a heading of the third level up to the next one; flexible: the heading may go on, or have an older name."""
    end = r"\b[^\n]*$" if flexible else r"[ \t]*$"
    one = lambda n: found(body, rf"(?ms)^### {re.escape(n)}{end}(.*?)(?=^### |\z)")
    out = F.coalesce(one(name), one(LEGACY[name])) if flexible and name in LEGACY else one(name)
    return stripped(F.coalesce(out, F.lit("")))


def value_line(text: Column, key: str) -> Column:
    """The value of a list's line ``- key: value``; null where there is none."""
    return F.trim(found(text, rf"(?m)^- {re.escape(key)}:(.*)$"))


def printed_number(title: Column) -> Column:
    """The number behind a kind's name, else the first with a full stop, else the first integer."""
    kinds = "|".join([*KIND_NAMES, *MORE_KINDS])
    return F.coalesce(found(title, rf"(?i)\b(?:{kinds})\s+(\d+(?:\.\d+)*)\b"), found(title, r"\b(\d+(?:\.\d+)+)\b"), found(title, r"\b(\d+)\b"))


def kind_and_number(text: Column) -> Column:
    """(kind, number) that a text names, accents left out; an empty kind where only a number is there, null without one."""
    pattern = rf"\b({'|'.join(KIND_NAMES)})\s+(\d+(?:\.\d+)*)\b"
    plain = unaccented(text)
    names = F.create_map(*[F.lit(x) for kv in KIND_NAMES.items() for x in kv])
    named = F.struct(names[F.regexp_extract(plain, pattern, 1)].alias("kind"), F.regexp_extract(plain, pattern, 2).alias("number"))
    number = printed_number(text)
    return F.when(plain.rlike(pattern), named).when(number.isNotNull(), F.struct(F.lit("").alias("kind"), number.alias("number")))


def attempts(body: Column) -> Column:
    """(date, level, minutes, session) of the attempts that a block's reconstruction lists; levels within 0..3."""
    listed = F.coalesce(found(subsection(body, "Reconstruccion", flexible=True), r"(?ms)^Intentos:\s*$(.*)"), F.lit(""))
    part = lambda text, i: F.regexp_extract_all(text, F.lit(ATTEMPT), F.lit(i))
    rows = once(listed, lambda t: F.arrays_zip(part(t, 1).alias("date"), part(t, 2).alias("level"), part(t, 3).alias("minutes"), part(t, 4).alias("session")))
    return F.transform(rows, lambda x: F.struct(x["date"].cast("date").alias("date"), F.greatest(F.lit(0), F.least(F.lit(3), x["level"].cast("int"))).alias("level"), x["minutes"].cast("double").alias("minutes"), F.trim(x["session"]).alias("session")))


def hint(line: Column) -> Column:
    """A template's hint with its block's and page's names left out, so that hints of all blocks are equal."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(line, r"\s+", " ")), r"\[[^\]]*:pNN\]", "[ID:pNN]"), r"\bR\d+\b|\bRN\b", "RN")


def template_hints(template: DataFrame, text: str = "text") -> DataFrame:
    """(hint): the lines of templates that stand in brackets."""
    lines = template.select(F.explode(F.split(text, "\n")).alias("line")).select(F.trim("line").alias("line"))
    return lines.where(F.col("line").rlike(r"^\(.*\)$")).select(hint(F.col("line")).alias("hint")).distinct()


def own_text(field: Column, hints: Column) -> Column:
    """What was written in a field: without attempts and without the hint that it begins with. hints: array of hints."""
    rest = stripped(F.regexp_replace(F.regexp_replace(field, r"(?m)^Intentos:\s*$", ""), ATTEMPT, ""))

    def without(rest: Column, first: Column) -> Column:
        is_hint = (first != "") & F.exists(hints, lambda h: (h == first) | (F.substring(h, 1, 40) == F.substring(first, 1, 40)))
        return F.when(is_hint, stripped(F.regexp_replace(rest, r"(?s)\A\([^)]*\)", ""))).otherwise(rest)

    return once(rest, lambda t: once(hint(F.regexp_extract(t, r"(?s)\A(\([^)]*\))", 1)), lambda first: without(t, first)))


def valid_explanation(own: Column) -> Column:
    """Whether own text is an explanation: long enough and not as the template begins."""
    return once(own, lambda t: (F.length(t) >= OWN_LEAST) & ~F.startswith(t, F.lit("Tu reconstruccion")))


def note_state(blocks_: DataFrame, hints: Column, checks: DataFrame | None = None) -> DataFrame:
    """blocks with ``written`` (fields with own text), ``tries``, ``last`` (attempt) and, from checks (doc, rid, file), ``last_check``."""
    has = [F.when(F.length(own_text(subsection(F.col("body"), f, flexible=True), hints)) > WRITTEN_LEAST, F.lit(f)) for f in FIELDS]
    out = blocks_.withColumn("written", F.array_compact(F.array(*has))).withColumn("_tries", attempts(F.col("body")))
    out = out.withColumn("tries", F.size("_tries")).withColumn("last", F.try_element_at("_tries", F.lit(-1))).drop("_tries")
    if checks is None:
        return out.withColumn("last_check", F.lit(None).cast("string"))
    return out.join(checks.groupBy("doc", "rid").agg(F.max("file").alias("last_check")), ["doc", "rid"], "left")


def heading_slugs(headings: DataFrame, keys: list[str], order: str, slug: str = "slug") -> DataFrame:
    """headings with ``anchor``: the slug, and from its second time in a document on its number behind it."""
    w = Window.partitionBy(*keys, slug).orderBy(order)
    n = F.row_number().over(w)
    return headings.withColumn("anchor", F.when(n > 1, F.concat(slug, F.lit("-"), n.cast("string"))).otherwise(F.col(slug)))


def diagnostic_items(docs: DataFrame, text: str = "text", minutes: int = 20) -> DataFrame:
    """(doc, i, title, minutes, body) of a diagnosis: sections with the time that they name, else ``minutes``."""
    rows = sections(docs, text).where("title is not null")
    line = r"(?m)^tiempo:\s*(\d+)\s*$"
    return rows.select("doc", "i", "title", F.coalesce(found(F.col("body"), line).cast("int"), F.lit(minutes)).alias("minutes"), stripped(F.regexp_replace("body", line, "")).alias("body"))


def without_code(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)```.*?```", "")


def gap_counts(text: Column) -> Column:
    """(pending, structural): open gaps of a register, and those marked as structural; examples in code don't count."""
    plain = without_code(text)
    return F.struct(F.regexp_count(plain, F.lit(r"(?m)^- \[ \]")).alias("pending"), F.regexp_count(plain, F.lit(r"(?m)^- \[.*ESTRUCTURAL")).alias("structural"))


def card_counts(text: Column) -> Column:
    """(cards, waiting): lines of cards, and those that wait for the paper; headings, comments and code don't count."""
    cards = F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit("::")) & ~x.rlike(r"^(#|<!--)") & ~F.contains(x, F.lit("`")))
    return F.struct(F.size(cards).alias("cards"), F.size(F.filter(cards, lambda x: F.contains(x, F.lit("VERIFICAR CON PAPER")))).alias("waiting"))


def reading_list(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc, pos, mark, title): lines ``- [mark] title`` of the section that is called the core, in order."""
    core = F.coalesce(found(F.col(text), r"(?ms)^## Nucleo[^\n]*$(.*?)(?=^## |\z)"), F.lit(""))
    rows = docs.select("doc", F.posexplode(F.filter(F.split(core, "\n"), lambda x: x.rlike(r"^- \[.\]\s*.+$"))).alias("pos", "_line"))
    return rows.select("doc", "pos", F.regexp_extract("_line", r"^- \[(.)\]", 1).alias("mark"), stripped(F.regexp_extract("_line", r"^- \[.\]\s*(.+)$", 1)).alias("title"))


def resolved(lines: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """lines with ``id``, the one that matches (keys, id) have for them; null where there are none or several."""
    one = matches.select(*keys, "id").distinct().groupBy(*keys).agg(F.when(F.count("*") == 1, F.min("id")).alias("id"))
    return lines.join(one, keys, "left")


def marked_read(lines: DataFrame, read: DataFrame) -> DataFrame:
    """Lines of a reading list (id, mark, title) with new marks: x for those read cold, else ~; others stay. read: id, cold."""
    news = read.groupBy("id").agg(F.bool_or("cold").alias("_cold"))
    return lines.join(news, "id", "left").withColumn("mark", F.when(F.col("_cold").isNull(), F.col("mark")).when(F.col("_cold"), "x").otherwise("~")).drop("_cold")


def gap_line(date: Column, origin: Column, phase: Column, text: Column) -> Column:
    """A gap as a line of its register."""
    return F.concat(F.lit("- [ ] "), F.concat_ws(" | ", date.cast("string"), origin, phase, stripped(F.regexp_replace(text, r"\s+", " "))))


def appended(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A register with new rows (same columns, ``seq`` among them); rows whose keys are there already, or come twice, count once."""
    first = new.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))).where("_r = 1").drop("_r")
    return stored.unionByName(first.join(stored.select(*keys), keys, "left_anti"))


def transcriptions(files: DataFrame, text: str = "text") -> DataFrame:
    """Files that are transcriptions: their heads have a state. With ``state`` and ``header``."""
    return files.withColumn("header", header_fields(F.col(text))).withColumn("state", F.try_element_at("header", F.lit("estado"))).where("state is not null")


def with_original(names: DataFrame, originals: DataFrame) -> DataFrame:
    """names (name, ext) with ``original``: the file (name, file, ext) of the same name, of the same ending if there is one, else the first."""
    both = names.join(originals.select("name", "file", F.col("ext").alias("_ext")), "name", "left")
    best = F.min_by("file", F.struct(F.coalesce(F.col("ext") != F.col("_ext"), F.lit(True)), "file"))
    return both.groupBy(*names.columns).agg(best.alias("original"))


def valid_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether a box in hundredths of a page is one, and doesn't take up nearly all of it."""
    inside = lambda a, b: (a >= 0) & (a < b) & (b <= 100)
    return F.coalesce(inside(x0, x1) & inside(y0, y1) & ((x1 - x0) * (y1 - y0) <= 9000), F.lit(False))


def occupied(paragraphs: DataFrame, keys: list[str], order: str, text: str = "text") -> DataFrame:
    """paragraphs with ``taken``: whether they are within a marked block, its marks included."""
    opens, closes = F.col(text).rlike(r"^<!-- (?!fin\b|pagina\b)\w+.* -->$"), F.col(text).rlike(r"^<!-- fin -->$")
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return paragraphs.withColumn("taken", opens | closes | (F.coalesce(before, F.lit(0)) > 0))


def structure_reply(reply: Column, paragraphs: Column) -> Column:
    """(a, b, kind, goes_on) of a reply's lines ``a-b: kind [sigue]``; lines beyond the paragraphs or over an accepted one are left out."""
    line = r"(?m)^\s*(\d{1,6})(?:-(\d{1,6}))?:\s*(\w+)(?:\s+(sigue))?\s*$"
    part = lambda i: F.regexp_extract_all(reply, F.lit(line), F.lit(i))
    rows = F.transform(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("kind"), part(4).alias("on")), lambda x: F.struct(x["a"].cast("int").alias("a"), F.when(x["b"] == "", x["a"]).otherwise(x["b"]).cast("int").alias("b"), x["kind"].alias("kind"), (x["on"] == "sigue").alias("goes_on")))
    good = F.filter(rows, lambda x: (x["a"] >= 1) & (x["a"] <= x["b"]) & (x["b"] <= paragraphs))
    none = F.filter(good, lambda x: F.lit(False))
    return F.aggregate(good, none, lambda s, x: F.when(F.exists(s, lambda y: (y["a"] <= x["b"]) & (y["b"] >= x["a"])), s).otherwise(F.concat(s, F.array(x))))


def newest(threads: DataFrame, keys: list[str], last: str, most: int = 40) -> DataFrame:
    """The ``most`` threads of each key that were used last, as a store that forgets the others holds them."""
    w = Window.partitionBy(*keys).orderBy(F.desc(last), "id")
    return threads.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def option(values: Column, key: Column, default: Column) -> Column:
    """A setting from a map by a command's name, else its default; a value that is there but null stays null."""
    return F.when(F.map_contains_key(values, key), F.try_element_at(values, key)).otherwise(default)


def paragraph(body: Column, label: str) -> Column:
    """The paragraph that begins with a label, without it and in one line; null where there is none."""
    return F.trim(F.regexp_replace(found(body, rf"(?ms)^{re.escape(label)}\s*(.*?)(?=\n\s*\n|\z)"), r"\s+", " "))


def week_of(states: DataFrame, plan: DataFrame) -> DataFrame:
    """states (doc, line) with ``week``, ``of`` and, of the plan's section (doc, text) for that week, ``title`` and ``goal``.

    A state tells its week as ``BASE ... semana N de T``; sections of the plan are headed by a week or a range of weeks.
    """
    told = r"BASE.*?semana (\d+) de (\d+)"
    known = states.withColumn("week", found(F.col("line"), told).cast("int")).withColumn("of", found(F.col("line"), told, 2).cast("int"))
    head = r"^Semanas? (\d+)(?:-(\d+))?\.\s*(.+)$"
    part = lambda i: F.regexp_extract("title", head, i)
    rows = sections(plan).where(F.col("title").rlike(head)).select("doc", "i", part(1).cast("int").alias("_a"), F.coalesce(F.nullif(part(2), F.lit("")), part(1)).cast("int").alias("_b"), part(3).alias("_t"), paragraph(F.col("body"), "Meta al acabar:").alias("_g"))
    hits = known.select("doc", "week").distinct().join(rows, "doc").where("week between _a and _b").groupBy("doc", "week").agg(F.min(F.struct("i", "_t", "_g")).alias("x"))
    return known.join(hits.select("doc", "week", F.col("x._t").alias("title"), F.col("x._g").alias("goal")), ["doc", "week"], "left")


def pending_lines(text: Column) -> Column:
    """The open lines of a register's section of pending ones."""
    part = F.coalesce(found(text, r"(?ms)^## Pendientes\s*$(.*?)(?=^## |\z)"), F.lit(""))
    return F.filter(F.split(part, "\n"), lambda x: F.startswith(F.trim(x), F.lit("- [ ]")))


def text_or_section(text: Column, name: str) -> Column:
    """The section of a heading, or of one that the name is part of; null where it is empty."""
    exact = found(text, rf"(?ms)^## {re.escape(name)}[ \t]*$(.*?)(?=^## |\z)")
    like = found(text, rf"(?ms)^## [^\n]*{re.escape(name)}[^\n]*$(.*?)(?=^## |\z)")
    return F.coalesce(F.nullif(stripped(exact), F.lit("")), F.nullif(stripped(like), F.lit("")))


def pasted(text: Column) -> Column:
    """(command, text) of a pasted passage: a command at its beginning and a full stop alone at its end are taken off."""
    command = r"(?s)\A\s*(/pegar|/paso|/lema|/notacion)\b[ \t]*"
    rest = F.regexp_replace(F.regexp_replace(text, command, ""), r"(?:\A|\n)\s*\.\s*\z", "")
    return F.struct(found(text, command).alias("command"), stripped(rest).alias("text"))
