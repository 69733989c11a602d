"""TeX sources to units: sections, statements and paragraphs, with pages, printed numbers and resolved references.

Sources are parsed by expressions within the JVM. Pages and numbers come from the text of the printed pages, which
units meet by document. One document's units are gone through in order, without their texts, where a page depends on
the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions.groups import by_group
from quirefold.functions.text import nfkc, plain_text, squeezed, stripped, without_comments
from quirefold.sources.shared import stored

# Environments and names of statements with their kinds, and the printed names of kinds.
ENVIRONMENTS = {
    "theorem": "teorema", "thm": "teorema", "lemma": "lema", "lem": "lema", "proposition": "proposicion", "prop": "proposicion", "corollary": "corolario", "cor": "corolario", "definition": "definicion",
    "defn": "definicion", "def": "definicion", "remark": "observacion", "rem": "observacion", "example": "ejemplo", "proof": "demostracion", "abstract": "resumen", "notation": "notacion",
    "conjecture": "conjetura", "question": "pregunta", "problem": "problema", "assumption": "hipotesis", "claim": "afirmacion",
}
NAMED = {k: v for k, v in ENVIRONMENTS.items() if k not in ("thm", "lem", "prop", "cor", "defn", "def", "rem", "proof", "abstract")}
PRINTED = {"teorema": "Theorem", "lema": "Lemma", "proposicion": "Proposition", "corolario": "Corollary", "definicion": "Definition", "observacion": "Remark", "ejemplo": "Example", "conjetura": "Conjecture", "problema": "Problem", "notacion": "Notation", "afirmacion": "Claim", "pregunta": "Question"}
PARAGRAPH = 60
_ITEM, _FIELD = "\u0001", "\u0002"


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def with_kinds(docs: DataFrame, preamble: str) -> DataFrame:
    """docs with ``_kinds``: the map of statement environments to kinds, with those that a preamble defines; of repeated definitions the first.

    In steps, as functions of elements would take what they use of the row anew for each element.
    """
    pattern = r"\\newtheorem\*?\{([^}]+)\}(?:\[[^\]]*\])?\{([^}]+)\}"
    found = docs.withColumns({f"_d{i}": F.regexp_extract_all(preamble, F.lit(pattern), F.lit(i)) for i in (1, 2)})
    kind = lambda name: F.coalesce(F.try_element_at(literal_map(NAMED), F.substring_index(name, " ", 1)), F.replace(name, F.lit(" "), F.lit("-")))
    named = F.transform(F.arrays_zip(F.col("_d1").alias("e"), F.col("_d2").alias("n")), lambda p: F.struct(p["e"].alias("e"), squeezed(p["n"]).alias("n")))
    own = F.filter(named, lambda p, i: (F.array_position("_d1", p["e"]) == i + 1) & (p["n"] != ""))
    made = found.withColumn("_own", F.transform(own, lambda p: F.struct(p["e"].alias("key"), kind(p["n"]).alias("value"))))
    made = made.withColumn("_keys", F.transform("_own", lambda p: p["key"]))
    return made.withColumn("_kinds", F.map_concat(F.map_filter(literal_map(ENVIRONMENTS), lambda k, v: ~F.array_contains("_keys", k)), F.map_from_entries("_own"))).drop("_d1", "_d2", "_own", "_keys")


def tex_units(docs: DataFrame, tex: str = "tex") -> DataFrame:
    """(doc, n, section, kind, label, text): the units of TeX sources (doc, tex) in order; short paragraphs go."""
    plain = docs.select("doc", without_comments(F.col(tex)).alias("_plain"))
    cut = plain.select("doc", F.substring_index("_plain", r"\begin{document}", 1).alias("_pre"), "_plain")
    begin = F.length("_pre") + 1
    body = F.when(begin <= F.length("_plain"), F.substring_index(F.substring("_plain", begin + 16, F.length("_plain")), r"\end{document}", 1)).otherwise("")
    known = with_kinds(cut.select("doc", "_pre", body.alias("_body")), "_pre").drop("_pre")
    envs = F.array_join(F.transform(F.map_keys("_kinds"), lambda e: F.concat(F.lit("\\Q"), e, F.lit("\\E"))), "|")
    head = r"(?s)\\(section|subsection|subsubsection)\*?\{((?:[^{}]|\{[^{}]*\})*)\}|\\begin\{("
    pattern = F.concat(F.lit(head), envs, F.lit(r")\}(?:\[[^\]]*\])?(.*?)\\end\{\3\}"))
    parts = F.split(F.regexp_replace("_body", pattern, F.lit(f"{_ITEM}$1{_FIELD}$2{_FIELD}$3{_FIELD}$4{_ITEM}")), _ITEM)
    level = lambda f: F.when(f[0] == "section", 1).when(f[0] == "subsection", 2).when(f[0] == "subsubsection", 3).otherwise(0)
    none = F.lit(None).cast("string")

    def of_fields(f: Column) -> Column:
        text = F.when(f[0] != "", F.trim(F.regexp_replace(f[1], r"\s+", " "))).otherwise(stripped(f[3]))
        label = F.when(f[0] == "", F.nullif(F.regexp_extract(f[3], r"\\label\{([^}]*)\}", 1), F.lit("")))
        return F.struct(level(f).alias("level"), F.when(f[0] != "", "titulo").otherwise(F.try_element_at("_kinds", f[2])).alias("kind"), label.alias("label"), text.alias("text"))

    def of_item(part: Column) -> Column:
        return F.transform(F.array(F.split(part, _FIELD)), of_fields)

    def of_text(part: Column) -> Column:
        long = F.filter(F.transform(F.split(part, r"\n\s*\n"), stripped), lambda p: F.length(squeezed(plain_text(p))) >= PARAGRAPH)
        return F.transform(long, lambda p: F.struct(F.lit(0).alias("level"), F.lit("parrafo").alias("kind"), none.alias("label"), p.alias("text")))

    units = known.select("doc", F.posexplode(F.flatten(F.transform(parts, lambda p, i: F.when(i % 2 == 1, of_item(p)).otherwise(of_text(p))))).alias("n", "u")).select("doc", "n", "u.*")
    return numbered_sections(units).select("doc", "n", "section", "kind", "label", "text")


def numbered_sections(units: DataFrame) -> DataFrame:
    """units (doc, n, level) with ``section``: counters of three levels, each begun anew by those above; null before the first."""
    upto = Window.partitionBy("doc").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    # counts so far, less those at the last heading above: one order serves all
    units = units.withColumns({f"_{i}": F.count(F.when(F.col("level") == i, 1)).over(upto) for i in (1, 2, 3)})
    base = {f"_b{i}": F.coalesce(F.max(F.when(F.col("level").between(1, i - 1), F.col(f"_{i}"))).over(upto), F.lit(0)) for i in (2, 3)}
    units = units.withColumns(base).withColumns({f"_{i}": F.col(f"_{i}") - F.col(f"_b{i}") for i in (2, 3)}).drop("_b2", "_b3")
    nonzero = lambda c: F.when(F.col(c) > 0, F.col(c).cast("string"))
    return units.withColumn("section", F.when(F.col("_1") > 0, F.concat_ws(".", nonzero("_1"), nonzero("_2"), nonzero("_3")))).drop("_1", "_2", "_3")


def with_words(units: DataFrame) -> DataFrame:
    """units with ``_w``, the words of their texts, in two steps, as each step uses the text more than once."""
    plain = units.withColumn("_p", plain_text(F.col("text")))
    return plain.withColumn("_w", F.filter(F.split(squeezed(F.col("_p")), " "), lambda w: w != "")).drop("_p")


def with_pages(units: DataFrame, pages: DataFrame) -> DataFrame:
    """units (doc, n, kind, text) with ``page`` and ``estimated``, by the text of the pages (doc, page, text).

    A page has a unit if one of nine snippets of its words is in it, earlier and longer ones first; of several pages
    the next one from the last unit's page on counts, else the first. If there is none, that of six from there on which
    has most of the unit's first words, three fifths at least. Else it is the last unit's page, by estimate.
    """
    size = F.size("_w")
    snippet = lambda at, n: F.array_join(F.slice("_w", at + 1, n), " ")
    starts = [F.lit(0), F.floor(size / 3).cast("int"), F.floor(2 * size / 3).cast("int")]
    snippets = [F.when(size >= 4, snippet(a, n)) for a in starts for n in (8, 6, 4)]
    few = F.filter(F.slice("_w", 1, 25), lambda w: F.length(w) > 2)
    # stored, as conditions on what follows from the words would be pushed below and take them anew
    known = stored(with_words(units).select("doc", "n", "_w"), "words").select("doc", "n", *[F.when(F.length(s) >= 18, s).alias(f"_s{i}") for i, s in enumerate(snippets)], F.when((size >= 4) & (F.size(few) >= 5), few).alias("_f"))
    texts = pages.select("doc", "page", squeezed(F.col("text")).alias("_t"))
    # a page counts by the first snippet that it has
    hit = F.coalesce(*[F.when(F.contains("_t", F.col(f"_s{i}")), F.lit(i)) for i in range(len(snippets))])
    none, names = F.lit(None), [f"_s{i}" for i in range(len(snippets))]
    hits = known.where(F.coalesce(*names).isNotNull()).drop("_f").join(texts, "doc").select("doc", "n", "page", hit.alias("hit"), none.cast("double").alias("share")).where("hit is not null")
    hits = stored(hits, "hits")
    # words are looked for only where no page has a snippet
    left = known.where("_f is not null").select("doc", "n", "_f").join(hits.select("doc", "n").distinct(), ["doc", "n"], "left_anti")
    share = F.size(F.filter("_f", lambda w: F.array_contains("_tw", w))) / F.size("_f")
    shares = left.join(texts.select("doc", "page", F.split("_t", " ").alias("_tw")), "doc").select("doc", "n", "page", none.cast("int").alias("hit"), share.alias("share")).where("share >= 0.6")
    found = hits.unionByName(shares).groupBy("doc", "n").agg(F.min("hit").alias("_best"), F.array_sort(F.collect_list(F.struct("page", "hit", "share"))).alias("_x"))
    first = F.transform(F.filter("_x", lambda x: x["hit"] == F.col("_best")), lambda x: x["page"])
    found = found.select("doc", "n", first.alias("at"), F.when(F.col("_best").isNull(), F.transform("_x", lambda x: F.struct(x["page"].alias("page"), x["share"].alias("share")))).alias("near"))
    count = pages.groupBy("doc").agg(F.max("page").alias("pages"))
    rows = units.select("doc", "n", "kind").join(found, ["doc", "n"], "left").join(count, "doc", "left")

    def work(_, rows) -> list[tuple]:
        out, last = [], None
        for u in rows:
            begin, page = last or 1, None
            # the first from the last page on, or else the first of those before it
            if u["at"]:
                page = next((p for p in u["at"] if p >= begin), u["at"][0])
            elif u["near"]:
                near = sorted((x for x in u["near"] if (x["page"] - begin) % u["pages"] < 6), key=lambda x: (x["page"] < begin, x["page"]))
                page = max(near, key=lambda x: x["share"])["page"] if near else None
            if page is None and u["kind"] == "titulo":
                page = last
            out.append((u["n"], page if page is not None else last, page is None))
            last = out[-1][1]
        return out

    placed = by_group(rows, "doc", ["n", "kind", "at", "near", "pages"], "n int, page int, estimated boolean", work)
    return units.join(placed, ["doc", "n"])


def with_printed_numbers(units: DataFrame, pages: DataFrame) -> DataFrame:
    """units (doc, n, kind, page, estimated, text) with ``number``: that of the heading on their page whose statement begins as they do."""
    name = F.try_element_at(literal_map(PRINTED), F.col("kind"))
    texts = pages.select("doc", "page", nfkc(F.col("text")).alias("_t"))
    both = with_words(units.where(name.isNotNull() & ~F.col("estimated"))).select("doc", "n", "page", name.alias("_k"), F.slice("_w", 1, 6).alias("_w")).join(texts, ["doc", "page"]).where("size(_w) >= 3")
    pattern = F.concat(F.lit("\\b"), "_k", F.lit(r"\s+(\d+(?:\.\d+)*)\b\.?"))
    numbers, tails = F.regexp_extract_all("_t", pattern, F.lit(1)), F.slice(F.split("_t", pattern), 2, 1 << 30)
    # what a heading may have before its statement is passed over
    lead = F.concat(F.lit(r"^[a-z ]{0,60}?(?=\b"), F.get("_w", F.lit(0)), F.lit(r"\b)"))
    tail = lambda t: F.regexp_replace(squeezed(F.substring(t, 1, 260)), lead, F.lit(""))
    rows = F.transform(F.arrays_zip(numbers.alias("number"), tails.alias("tail")), lambda x: F.struct(x["number"].alias("number"), tail(x["tail"]).alias("tail")))
    there = lambda x, ws: F.size(F.filter(ws, lambda w: F.contains(x["tail"], w)))
    fits = lambda x: (there(x, F.slice("_w", 1, 3)) == 3) & (there(x, F.col("_w")) >= F.least(F.lit(4), F.size("_w")))
    found = both.select("doc", "n", F.get(F.filter(rows, fits), F.lit(0))["number"].alias("number"))
    return units.join(found, ["doc", "n"], "left")


def item_label(style: Column, k: Column) -> Column:
    """The printed label of a list's k-th item by its style; null for other styles."""
    pattern = r"^(\W*)(A|a|I|i|1)(\W*)$"
    part = lambda i: F.regexp_extract(F.trim(style), pattern, i)
    digit = lambda values, n: F.get(F.array(*map(F.lit, values)), n.cast("int"))
    ones, tens = ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"], ["", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"]
    hundreds = ["", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"]
    roman = F.concat(F.repeat(F.lit("m"), F.floor(k / 1000).cast("int")), digit(hundreds, F.floor(k / 100) % 10), digit(tens, F.floor(k / 10) % 10), digit(ones, k % 10))
    letter = F.when(k <= 26, F.char(k + 96)).otherwise(k.cast("string"))
    kind = part(2)
    made = F.when(kind == "A", F.upper(letter)).when(kind == "a", letter).when(kind == "I", F.upper(roman)).when(kind == "i", roman).otherwise(k.cast("string"))
    return F.when(F.trim(style).rlike(pattern), F.concat(part(1), made, part(3)))


def printed_labels(body: Column) -> Column:
    """(label, printed) of lists' items and of tagged equations in a TeX body."""
    lists = r"(?s)\\begin\{enumerate\}\[([^\]]*)\](.*?)\\end\{enumerate\}"
    found = F.arrays_zip(F.regexp_extract_all(body, F.lit(lists), F.lit(1)).alias("style"), F.regexp_extract_all(body, F.lit(lists), F.lit(2)).alias("block"))
    flat = F.filter(found, lambda x: ~F.contains(x["block"], F.lit(r"\begin{enumerate}")))
    labels = lambda item, text: F.transform(F.regexp_extract_all(item, F.lit(r"\\label\{([^}]+)\}"), F.lit(1)), lambda l: F.struct(l.alias("label"), text.alias("printed")))  # noqa: E731,E741
    items = F.flatten(F.transform(flat, lambda x: F.flatten(F.transform(F.slice(F.split(x["block"], r"\\item\b"), 2, 1 << 30), lambda item, k: labels(item, item_label(x["style"], k + 1))))))
    tagged = F.array().cast("array<struct<label:string,printed:string>>")
    for pattern, label, tag in ((r"\\label\{([^}]+)\}[^\n]{0,80}?\\tag\*?\{([^}]+)\}", 1, 2), (r"\\tag\*?\{([^}]+)\}[^\n]{0,80}?\\label\{([^}]+)\}", 2, 1)):
        both = F.arrays_zip(F.regexp_extract_all(body, F.lit(pattern), F.lit(label)).alias("l"), F.regexp_extract_all(body, F.lit(pattern), F.lit(tag)).alias("t"))
        tagged = F.concat(tagged, F.transform(both, lambda x: F.struct(x["l"].alias("label"), F.concat(F.lit("("), x["t"], F.lit(")")).alias("printed"))))
    return F.filter(F.concat(items, tagged), lambda x: x["printed"].isNotNull())


def resolved_references(units: DataFrame, labels: DataFrame) -> DataFrame:
    """units (doc, text) whose references to labels (doc, label, printed) are what is printed; others stay.

    A reference behind the name that its label is printed with has only the number.
    """
    one = labels.groupBy("doc", "label").agg(F.min("printed").alias("printed"))
    named = units.select("doc", "n", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\\(?:eqref|ref|autoref|cref)\{([^}]+)\}"), F.lit(1)))).alias("label"))
    known = named.join(one, ["doc", "label"]).groupBy("doc", "n").agg(F.array_sort(F.collect_list(F.struct("label", "printed"))).alias("_l"))
    quoted = lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))

    def step(text: Column, x: Column) -> Column:
        bare = F.regexp_replace(x["printed"], r"^\(+|\)+$", "")
        round_ = F.when(F.startswith(x["printed"], F.lit("(")), x["printed"]).otherwise(F.concat(F.lit("("), x["printed"], F.lit(")")))
        safe = lambda c: F.regexp_replace(c, r"([\\$])", r"\\$1")
        at = lambda before, commands, after: F.concat(F.lit(before + r"\\(?:" + commands + r")\{"), quoted(x["label"]), F.lit(r"\}" + after))
        text = F.regexp_replace(F.regexp_replace(text, at(r"\(", "eqref|ref", r"\)"), safe(round_)), at("", "eqref", ""), safe(round_))
        word, number = F.substring_index(bare, " ", 1), F.regexp_replace(bare, r"^\S+ ", "")
        behind = F.concat(F.lit("(?i)("), quoted(word), F.lit("s?[~ ]*)"), at("", "ref|autoref|cref", ""))
        text = F.when(F.contains(bare, F.lit(" ")), F.regexp_replace(text, behind, F.concat(F.lit("$1"), safe(number)))).otherwise(text)
        return F.regexp_replace(text, at("", "ref|autoref|cref", ""), safe(bare))

    return units.join(known, ["doc", "n"], "left").withColumn("text", F.when(F.col("_l").isNotNull(), F.aggregate("_l", F.col("text"), step)).otherwise(F.col("text"))).drop("_l")


def statement_labels(units: DataFrame) -> DataFrame:
    """(doc, label, printed) of statements with a label and a printed number."""
    name = F.try_element_at(literal_map(PRINTED), F.col("kind"))
    return units.where(name.isNotNull() & F.col("label").isNotNull() & F.col("number").isNotNull()).select("doc", "label", F.concat_ws(" ", name, "number").alias("printed"))


def inlined(files: DataFrame, depth: int = 5) -> DataFrame:
    """(doc, tex): each project's main file (doc, name, text) with the files that it takes in, ``depth`` levels deep; of what is missing nothing stays.

    The main file is the first by name that begins a document.
    """
    key = lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), r"^\./", ""), r"\.tex$", "")
    command = r"\\(?:input|include)\{([^}]*)\}"
    main = files.where(F.contains("text", F.lit(r"\begin{document}"))).groupBy("doc").agg(F.min_by("text", "name").alias("tex"))
    store = files.select("doc", key(F.col("name")).alias("_key"), F.col("text").alias("_text"))
    for _ in range(depth):
        parts = main.select("doc", "tex", F.posexplode(F.split("tex", command)).alias("_i", "_part")).withColumn("_name", F.get(F.regexp_extract_all("tex", F.lit(command), F.lit(1)), F.col("_i") - 1))
        got = parts.join(store, (parts["doc"] == store["doc"]) & (key(F.col("_name")) == F.col("_key")), "left").select(parts["doc"], "_i", F.concat(F.coalesce("_text", F.lit("")), "_part").alias("_piece"))
        main = got.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_piece"))), lambda x: x["_piece"]), "").alias("tex"))
    return main
