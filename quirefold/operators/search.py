"""Search over fragments: lexical, by vectors, fused, and what is built on it.

Statistics come from the rows that are searched, so filters go before. Ties are ordered by id. Ranks count from 0.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions.text import tokens
from quirefold.sources.shared import stored

K1, B, EPSILON = 1.5, 0.75, 0.25
LIST, RRF, VECTOR_WEIGHT = 50, 60, 1.5


def index_terms(df: DataFrame, id_: str, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, toks, dl): each row's tokens and their number. Written once, this serves all searches."""
    return df.select(F.col(id_).alias("id"), *keep, tokens(F.col(text)).alias("toks")).withColumn("dl", F.size("toks"))


def term_counts(terms: DataFrame) -> DataFrame:
    """(term, df): in how many rows a term is."""
    return terms.select(F.explode(F.array_distinct("toks")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def bm25(terms: DataFrame, query: list[str]) -> DataFrame:
    """terms' rows with ``bm25`` for a query, given as tokens; repeated ones count again.

    One pass gives a row of statistics: the number and mean size of rows and in how many each query term is. A term of
    more than half of the rows would weigh less than nothing and gets a share of the mean weight of all terms; only
    then are these counted. The last pass scores each row by itself.
    """
    distinct = list(dict.fromkeys(query))
    weight = lambda n, df: math.log(n - df + 0.5) - math.log(df + 0.5)
    known = terms.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.array_contains("toks", t)).alias(f"df{i}") for i, t in enumerate(distinct)]).first()
    weights = [weight(known.n, df) if (df := known[f"df{i}"]) else None for i in range(len(distinct))]
    if any(w is not None and w < 0 for w in weights):
        n, df = F.lit(known.n), F.col("df")
        mean = term_counts(terms).agg(F.avg(F.log(n - df + 0.5) - F.log(df + 0.5))).first()[0]
        weights = [EPSILON * mean if w is not None and w < 0 else w for w in weights]
    score = F.lit(0.0)
    for t, w in zip(distinct, weights):
        if w is not None:
            tf = _occurrences("toks", t)
            score = score + F.when(tf > 0, query.count(t) * w * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / known.avgdl))).otherwise(0.0)
    return terms.withColumn("bm25", score)


def _occurrences(array: str, value: str) -> Column:
    return F.size(F.filter(array, lambda x: x == value))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(df: DataFrame, query: DataFrame, vector: str = "embedding") -> DataFrame:
    """df with ``cosine`` to the one vector of query (column q); rows of no length or another size drop out."""
    both = df.crossJoin(F.broadcast(query.select("q"))).where(F.size(vector) == F.size("q"))
    norm = lambda c: F.greatest(F.sqrt(dot(c, c)), F.lit(1e-9))
    return both.withColumn("cosine", dot(F.col(vector), F.col("q")) / (norm(F.col(vector)) * norm(F.col("q")))).drop("q")


def top(df: DataFrame, score: str, k: int, out: str = "rank", digits: int = 9) -> DataFrame:
    """The k best rows by rounded score, then id, with their rank from 0."""
    best = df.orderBy(F.round(score, digits).desc(), "id").limit(k)
    return best.withColumn(out, F.row_number().over(Window.orderBy(F.round(score, digits).desc(), "id")) - 1)


def fused(lexical: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """(id, bm25, cosine, rrf) of the best rows of both lists: reciprocal ranks, those of vectors weighing more."""
    a = top(lexical.where("bm25 > 0").select("id", "bm25"), "bm25", LIST).withColumn("x", 1 / (RRF + F.col("rank"))).drop("rank")
    if vectors is None:
        return a.select("id", "bm25", F.lit(None).cast("double").alias("cosine"), F.col("x").alias("rrf"))
    b = top(vectors.select("id", "cosine"), "cosine", LIST).withColumn("y", VECTOR_WEIGHT / (RRF + F.col("rank"))).drop("rank")
    return a.join(b, "id", "full").select("id", "bm25", "cosine", (F.coalesce("x", F.lit(0.0)) + F.coalesce("y", F.lit(0.0))).alias("rrf"))


def boosted(df: DataFrame, kind: str, boosts: Mapping[str, float]) -> DataFrame:
    """df with ``rrf`` times the boost of the row's kind."""
    factor = F.lit(1.0)
    for name, by in boosts.items():
        factor = F.when(F.col(kind) == name, F.lit(float(by))).otherwise(factor)
    return df.withColumn("rrf", F.col("rrf") * factor)


def capped(df: DataFrame, score: str, doc: str, per_doc: int, k: int, digits: int = 9) -> DataFrame:
    """The k best rows, at most per_doc of each document (no cap at 0)."""
    order = [F.round(score, digits).desc(), F.col("id")]
    if per_doc:
        df = df.withColumn("_n", F.row_number().over(Window.partitionBy(doc).orderBy(*order))).where(F.col("_n") <= per_doc).drop("_n")
    return df.orderBy(*order).limit(k)


def expanded(queries: DataFrame, glossary: DataFrame, query: str = "query", lengths: int = 1000) -> DataFrame:
    """queries with ``expanded``: the translations of all glossary keys in it, those of longer keys first.

    queries: without accents, lower case. glossary: key, value; one row a term. The stretches of a query that have the
    length of any key are looked up; keys have few lengths, and beyond ``lengths`` of them it fails.
    """
    sizes = [r[0] for r in glossary.where("length(key) > 0").select(F.length("key")).distinct().limit(lengths + 1).collect()]
    if len(sizes) > lengths:
        raise ValueError(f"keys of more than {lengths} lengths")
    text = F.col(query)
    of = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    every = F.array_distinct(F.concat(*[of(n) for n in sorted(sizes)])) if sizes else F.array().cast("array<string>")
    distinct = queries.distinct()
    looked = distinct.select(*queries.columns, F.explode(every).alias("_key")).join(glossary.select(F.col("key").alias("_key"), F.col("value").alias("_value")), "_key")
    found = F.array_sort(F.collect_list(F.struct((-F.length("_key")).alias("l"), F.col("_key").alias("key"), F.col("_value").alias("value"))))
    more = looked.groupBy(*queries.columns).agg(F.array_join(F.transform(found, lambda x: x["value"]), " ").alias("_more"))
    same = F.lit(True)
    for c in queries.columns:
        same = same & F.col(f"q.{c}").eqNullSafe(F.col(f"m.{c}"))
    both = distinct.alias("q").join(more.alias("m"), same, "left")
    return both.select(*[F.col(f"q.{c}").alias(c) for c in queries.columns], F.trim(F.concat_ws(" ", f"q.{query}", "_more")).alias("expanded"))


def merged(*lists: DataFrame, id_: str = "id", pos: str = "pos") -> DataFrame:
    """Ordered union of lists (id, pos): each id once, where it comes first; ``place`` counts from 0."""
    parts = [x.select(F.col(id_).alias("id"), F.lit(i).alias("list"), F.col(pos).alias("pos")) for i, x in enumerate(lists)]
    everything = parts[0]
    for x in parts[1:]:
        everything = everything.unionByName(x)
    first = everything.groupBy("id").agg(F.min(F.struct("list", "pos")).alias("at")).select("id", "at.list", "at.pos")
    return first.withColumn("place", F.row_number().over(Window.orderBy("list", "pos", "id")) - 1)


# Fixed value: commands that refer to a label.
REFERENCE = r"\\(?:ref|eqref|autoref|cref)\{([^}]+)\}"


def followed(results: DataFrame, fragments: DataFrame, most: int = 4) -> DataFrame:
    """Fragments of the same document that the results refer to by label and that aren't among them, in order of results.

    results: id, doc, pos, text. fragments: id, doc, ord, label; of equal labels in a document the first counts.
    Returns (id, doc, label, via, place): up to ``most``, via the id of the result that refers first.
    """
    refs = results.select("doc", "pos", F.col("id").alias("via"), F.posexplode(F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(1))).alias("n", "label"))
    first = refs.groupBy("doc", "label").agg(F.min(F.struct("pos", "n", "via")).alias("at"))
    labelled = fragments.where("label is not null").select("doc", "label", F.col("id").alias("to"), "ord").join(first.select("doc", "label"), ["doc", "label"], "left_semi")
    targets = labelled.groupBy("doc", "label").agg(F.min_by("to", F.struct("ord", "to")).alias("to"))
    new = first.join(targets, ["doc", "label"]).join(results.select(F.col("id").alias("to")), "to", "left_anti")
    one = new.groupBy("to").agg(F.min(F.struct("at", "doc", "label")).alias("x")).select("to", "x.at", "x.doc", "x.label")
    best = one.orderBy("at", "to").limit(most).withColumn("place", F.row_number().over(Window.orderBy("at", "to")) - 1)
    return best.select(F.col("to").alias("id"), "doc", "label", "at.via", "place")


# How much more fragments of a kind count, and the printed names of kinds.
BOOSTS = {"teorema": 1.5, "definicion": 1.5, "lema": 1.3, "proposicion": 1.3, "corolario": 1.2, "notacion": 1.2}
NAMES = {"teorema": "Teorema", "lema": "Lema", "proposicion": "Proposicion", "corolario": "Corolario", "definicion": "Definicion", "observacion": "Observacion", "ejemplo": "Ejemplo", "conjetura": "Conjetura", "problema": "Problema", "notacion": "Notacion", "afirmacion": "Afirmacion", "pregunta": "Pregunta"}


def query_terms(query: str, glossary: DataFrame | None = None, spark=None) -> list[str]:
    """A query's tokens, with those of the translations of all glossary keys (key, value) that are in it, longer keys first."""
    from quirefold.functions.text import unaccented

    spark = glossary.sparkSession if glossary is not None else spark
    more = []
    if glossary is not None:
        # as many rows as keys are in the query at most
        hits = glossary.where(F.contains(unaccented(F.lit(query)), F.col("key"))).select("key", "value").collect()
        more = [r.value for r in sorted(hits, key=lambda r: (-len(r.key), r.key))]
    return spark.range(1).select(tokens(F.lit(" ".join([query, *more]))).alias("t")).first().t


def search(fragments: DataFrame, terms: list[str], k: int = 8, source: str | None = None, doc=None, vectors: DataFrame | None = None, per_doc: int = 2, boosts: Mapping[str, float] = BOOSTS) -> DataFrame:
    """The k fragments that fit a query best: lexical ranks, fused with those by vectors, kinds boosted, per document capped.

    fragments: id, source, doc, kind, text and others, all of which are returned, with ``bm25``, ``cosine``, ``rrf`` and
    ``place``. Filters go before statistics; within one document there is no cap. vectors: (id, cosine); without them
    the search is lexical only.
    """
    if source is not None:
        fragments = fragments.where(F.col("source") == source)
    if doc is not None:
        fragments = fragments.where(F.col("doc") == doc)
    if vectors is not None:
        vectors = vectors.join(fragments.select("id"), "id", "left_semi")
    found = boosted(fused(bm25(index_terms(fragments, "id"), terms), vectors).join(fragments, "id"), "kind", boosts)
    best = capped(found, "rrf", "doc", 0 if doc is not None else per_doc, k)
    place = F.row_number().over(Window.orderBy(F.round("rrf", 9).desc(), "id")) - 1
    return best.withColumn("place", place).withColumn("rrf", F.round("rrf", 4)).withColumn("bm25", F.round(F.coalesce("bm25", F.lit(0.0)), 2))


def citation(doc: Column, page: Column, kind: Column, number: Column, label: Column, layer: Column, version: Column) -> Column:
    """The citation of a fragment: document and page, kind with printed number, else label; for TeX the version of its text."""
    there = lambda c: F.coalesce(c.cast("string"), F.lit("")) != ""
    base = F.concat(doc, F.when(there(page) & (page != 0), F.concat(F.lit(":p"), page.cast("string"))).otherwise(""))
    named = F.lit(None).cast("string")
    for key, name in NAMES.items():
        named = F.when(kind == key, name).otherwise(named)
    tagged = F.when(there(label), F.concat(F.lit(", etiqueta LaTeX: "), label)).otherwise("")
    what = F.when(named.isNotNull() & there(number), F.concat(F.lit(", "), named, F.lit(" "), number)).when(named.isNotNull() | (kind == "demostracion"), F.concat(F.lit(", "), kind, tagged)).otherwise("")
    text = F.when(layer == "tex", F.concat(F.lit(" | texto: arXiv "), F.when(there(version), version).otherwise("v?"))).otherwise("")
    return F.concat(F.lit("["), base, what, text, F.lit("]"))


def by_number(fragments: DataFrame, doc, number: str) -> DataFrame:
    """Fragments of a document with a printed number, which may be given with its kind's name and a full stop; by order."""
    wanted = F.nullif(F.regexp_extract(F.lit(number), r"(\d+(?:\.\d+)*)", 1), F.lit(""))
    return fragments.where((F.col("doc") == doc) & (F.col("number") == wanted)).orderBy("ord", "id")


def by_page(fragments: DataFrame, doc, page: int) -> DataFrame:
    """Fragments of a document's page, by order."""
    return fragments.where((F.col("doc") == doc) & (F.col("page") == page)).orderBy("ord", "id")


def with_texts(places: DataFrame, fragments: DataFrame) -> DataFrame:
    """Merged lists (id, place) as results (id, doc, pos, text)."""
    return places.select("id", F.col("place").alias("pos")).join(fragments.select("id", "doc", "text"), "id")


def with_references(places: DataFrame, fragments: DataFrame, most: int) -> DataFrame:
    """(id, list, place) of merged lists and, behind them, up to ``most`` fragments that they refer to."""
    return merged(places, followed(with_texts(places, fragments), fragments, most), pos="place")


def recovered(fragments: DataFrame, doc, terms: list[str], located: DataFrame, budget: int, vectors: DataFrame | None = None) -> DataFrame:
    """What goes with a question on a passage: located fragments (id, pos), the 4 of the document that fit best, up to 2 that these refer to; as many as the budget of words holds.

    Without vectors the search is lexical, as for a question that is the passage itself.
    """
    near = search(fragments, terms, k=4, doc=doc, vectors=vectors, per_doc=0).select("id", F.col("place").alias("pos"))
    places = with_references(merged(located, near), fragments, 2)
    sized = places.join(fragments.select("id", "text"), "id").withColumn("size", F.size(F.split(F.trim("text"), r"\s+"))).withColumn("_all", F.lit(0))
    return within_budget(sized.drop("text"), ["_all"], "place", "size", budget).drop("_all")


def asked(fragments: DataFrame, terms: list[str], named: list, k: int = 8, vectors: DataFrame | None = None) -> DataFrame:
    """The fragments for a question: for each named document (three at most) its own quota, then the best of all, then references."""
    lists = [search(fragments, terms, k=max(6, k // len(named)), doc=d, vectors=vectors, per_doc=0) for d in named[:3]]
    lists.append(search(fragments, terms, k=k, vectors=vectors))
    return with_references(merged(*lists, pos="place"), fragments, 4)


def wanted(answer: Column) -> Column:
    """The words that an answer asks to search for again, or null."""
    # Fixed value: the line that asks.
    return F.nullif(F.trim(F.regexp_extract(answer, r"(?m)^BUSCAR:[ \t]*(\S.*)$", 1)), F.lit(""))


def second_pass(fragments: DataFrame, places: DataFrame, terms: list[str], named: list, k: int = 10, vectors: DataFrame | None = None) -> DataFrame:
    """The fragments of a first pass (id, place), behind them new ones for the words of the second, and what these refer to: id, list, place.

    The second search is within each of the named documents, without named ones over all, and without a cap.
    """
    lists = [search(fragments, terms, k=k, doc=d, vectors=vectors, per_doc=0) for d in named or [None]]
    new = stored(merged(*lists, pos="place").join(places.select("id"), "id", "left_anti").select("id", "place"), "new")
    more = followed(with_texts(new, fragments), fragments, 4)
    return merged(places, new, more, pos="place")


def headings(places: DataFrame, fragments: DataFrame, bibliography: DataFrame) -> DataFrame:
    """(doc, line): a line for each document of the places: bibliography has doc, status, title, authors, venue, year."""
    # The lines' form.
    docs = places.join(fragments.select("id", "doc"), "id").select("doc").distinct().join(bibliography, "doc", "left")
    parts = F.filter(F.array("title", F.array_join(F.slice("authors", 1, 3), "; "), "venue", F.col("year").cast("string")), lambda x: F.coalesce(x, F.lit("")) != "")
    line = F.when(F.col("status") == "verificado", F.array_join(parts, " | ")).when(F.col("status").isNotNull(), F.concat(F.lit("metadatos "), "status")).otherwise("nota propia")
    return docs.select("doc", F.concat(F.lit("  "), "doc", F.lit(": "), line).alias("line"))


def context(places: DataFrame, fragments: DataFrame, budget: int | None = None) -> DataFrame:
    """(id, place, block, size, total): the places' fragments with citation and mark before their text, and words so far, as many as the budget of words holds.

    places: id, place and ``via``: reference, second, pasted, or null. Fragments have what ``citation`` asks for.
    """
    # The marks.
    mark = F.when(F.col("via") == "reference", " (traido por referencia)").when(F.col("via") == "second", " (segunda busqueda)").when(F.col("via") == "pasted", " (contiene lo que pegaste)").otherwise("")
    cited = citation(*[F.col(c) for c in ("doc", "page", "kind", "number", "label", "layer", "version")])
    block = F.concat(cited, mark, F.lit("\n"), "text")
    rows = places.join(fragments, "id").select("id", "place", block.alias("block")).withColumn("size", F.size(F.split(F.trim("block"), r"\s+"))).withColumn("_all", F.lit(0))
    return within_budget(rows, ["_all"], "place", "size", 2**31 - 1 if budget is None else budget).drop("_all", "_n")


def prompt(question: str, blocks: DataFrame, lines: DataFrame, again: str | None = None) -> DataFrame:
    """One row (prompt, size) of a question, its documents' lines and its blocks, of which there are as many as a search returns."""
    # The headings.
    second = "" if again is None else f"SEGUNDA BUSQUEDA HECHA: {again}\nSi lo pedido sigue sin aparecer, ahora si puedes escribir: 'No esta en el corpus (segunda busqueda en <documentos> con: <palabras>)'.\n\n"
    joined = blocks.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "block"))), lambda x: x["block"]), "\n\n").alias("b"), F.sum("size").alias("size"))
    heads = lines.agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("h"))
    text = F.concat(F.lit(f"PREGUNTA: {question}\n\nDOCUMENTOS:\n"), "h", F.lit("\n\n" + second + "FRAGMENTOS:\n\n"), "b")
    return joined.crossJoin(F.broadcast(heads)).select(text.alias("prompt"), "size")


def for_result(fragments: DataFrame, doc, title: str, terms: list[str], k: int, vectors: DataFrame | None = None) -> DataFrame:
    """The fragments for one result of a document: those of its printed number first, then similar ones, then up to 3 references."""
    exact = by_number(fragments, doc, title).select("id", F.col("ord").alias("pos"))
    near = search(fragments, terms, k=k, doc=doc, vectors=vectors, per_doc=0).select("id", F.col("place").alias("pos"))
    return with_references(merged(exact, near), fragments, 3)


def used(answers: DataFrame, cited: DataFrame) -> DataFrame:
    """(aid, id): fragments whose citation the answer's line of used ones has. answers: aid, answer. cited: aid, id, citation."""
    line = F.regexp_extract("answer", r"(?m)^USADOS:[ \t]*(.*)$", 1)
    keys = answers.select("aid", F.explode(F.transform(F.split(line, ";"), lambda x: F.trim(x))).alias("citation")).where("citation <> ''").distinct()
    return cited.join(keys, ["aid", "citation"], "left_semi").select("aid", "id")


def postings(terms: DataFrame) -> DataFrame:
    """(term, id, tf, dl): the inverted index of terms as ``index_terms`` gives them."""
    return terms.select("id", "dl", F.explode("toks").alias("term")).groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))


def search_many(terms: DataFrame, questions: DataFrame, k: int = 8) -> DataFrame:
    """(qid, id, bm25, rank): the k best rows for each of many questions (qid, query), which meet their rows by term."""
    posted = postings(terms)
    sizes = terms.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    weight = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    # sizes and the mean weight are one row each
    known = posted.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(sizes)).withColumn("w", weight)
    mean = known.agg(F.avg("w").alias("mean"))
    asked_ = questions.select("qid", F.explode(tokens(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    rows = asked_.join(known.crossJoin(F.broadcast(mean)), "term").join(posted, "term")
    idf = F.when(F.col("w") >= 0, F.col("w")).otherwise(EPSILON * F.col("mean"))
    part = F.col("qtf") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = rows.groupBy("qid", "id").agg(F.sum(part).alias("bm25")).where("bm25 > 0")
    w = Window.partitionBy("qid").orderBy(F.round("bm25", 9).desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def within_budget(df: DataFrame, keys: list[str], order: str, size: str, budget: int) -> DataFrame:
    """The rows of each key, in order, whose sizes add up to the budget at most; the first one always."""
    w = Window.partitionBy(*keys).orderBy(order)
    total = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_total", total).withColumn("_n", F.row_number().over(w)).where((F.col("_total") <= budget) | (F.col("_n") == 1)).withColumnRenamed("_total", "total").drop("_n")


def neighbours(df: DataFrame, n: int, id_: str = "id", doc: str = "doc", order: str = "ord") -> DataFrame:
    """df with ``before``: the n previous ids of the same document."""
    return df.withColumn("before", F.collect_list(id_).over(Window.partitionBy(doc).orderBy(order).rowsBetween(-n, -1)))
