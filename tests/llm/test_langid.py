import math

from pyspark.sql import functions as F

from quirefold.llm import langid


def test_backoff_order():
    import numpy as np

    grams = ["a", " ", " a"]
    table = np.array([[-1, -2], [-3, -4], [-1, -1], [-2, -9]], float)
    m = langid.Model(["x", "y"], ["known"], grams, table, np.array([-20.0, -20.0]))
    assert m.word("known").tolist() == [-1, -2]
    # " a " isn't known: mean of " a" (known) and "a " (backs off to "a" and " "), each step at a price
    ab = langid.BACKOFF + (table[1] + table[2]) / 2
    want = langid.BACKOFF + langid.BACKOFF + (table[3] + ab) / 2
    assert np.allclose(m.word("a"), want) and m.gram("q").tolist() == [-20, -20] and math.isclose(langid.BACKOFF, math.log(0.4))


def plain_scores(rows):
    """Texts' mean log frequencies by a plain loop over all labelled rows; rows: text, lang."""
    from collections import Counter

    langs = sorted({x for _, x in rows})
    seen = {name: [Counter() for _ in range(langid.GRAM + 1)] for name in langs}
    for t, name in set(rows):
        for w in langid.LETTERS.findall(t.lower()):
            seen[name][0][w] += 1
            padded = f" {w} "
            for n in range(1, langid.GRAM + 1):
                for i in range(len(padded) - n + 1):
                    seen[name][n][padded[i : i + n]] += 1
    sums = {name: [sum(c.values()) for c in seen[name]] for name in langs}
    know = [set().union(*(seen[name][k] for name in langs)) for k in range(langid.GRAM + 1)]

    def log(name, k, item):
        return math.log(seen[name][k][item] + 0.5) - math.log(sums[name][k] + 1)

    def gram(name, g):
        if g in know[len(g)]:
            return log(name, len(g), g)
        return math.log(0.5) - math.log(sums[name][1] + 1) if len(g) == 1 else math.log(0.4) + (gram(name, g[:-1]) + gram(name, g[1:])) / 2

    def word(name, w):
        if w in know[0]:
            return log(name, 0, w)
        padded = f" {w} "
        n = min(langid.GRAM, len(padded))
        parts = [padded[i : i + n] for i in range(len(padded) - n + 1)]
        return math.log(0.4) + sum(gram(name, g) for g in parts) / len(parts)

    def of(text):
        words = langid.LETTERS.findall((text or "").lower())
        if not words:
            return None
        mean = {name: sum(word(name, w) for w in words) / len(words) for name in langs}
        best = max(langs, key=lambda name: (mean[name], [-ord(c) for c in name]))
        return best, 1 / sum(math.exp((x - mean[best]) * min(len(words), langid.EVIDENCE)) for x in mean.values())

    return of


def test_query_is_the_plain_loops(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", langid.held_out().alias("held")).collect()
    of = plain_scores([(r.text, r.lang) for r in rows if not r.held and r.text is not None and r.lang is not None])
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.op2_langid(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        want = of(r.text) or ("und", 0.0)
        assert got[r.doc_id][0] == want[0] and abs(got[r.doc_id][1] - want[1]) < 1e-3


def test_edges(docs, nothing):
    model = langid.fit(docs)
    assert model.langs == ["de", "en"]
    rows = langid.predict(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1
    assert langid.predict(nothing, model).count() == 0
    none = langid.fit(nothing)
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}


def test_held_out_accuracy(spark, sf):
    known = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("lang").alias("truth"))
    rows = langid.op2_langid(spark, sf).join(known, "doc_id").where("held_out").collect()
    assert rows and sum(r.lang_pred == r.truth for r in rows) >= 0.95 * len(rows)


def test_texts_of_numbers_that_are_no_letters(spark):
    rows = [(1, "½ ² Ⅷ ①", None), (2, "the old river", "en"), (3, "der alte Fluß", "de"), (4, "the", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(df, langid.fit(df.where("lang is not null").select("text", "lang"))).collect()}
    assert got[1] == "und" and got[4] != "und"
