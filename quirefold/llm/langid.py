"""Language identification by word-first backoff.

A word that the model knows is scored by its log frequency in each language. An unseen word is scored by its character
n-grams of N letters (the word is padded with a blank on either side); an n-gram that the model doesn't know backs off
to the two n-grams of one letter less that it consists of, down to single letters, all of which that were learned from
the model knows, and then to a floor. A text's score in a language is the mean over its words; its language is that of
the highest score, and of equals the first by name.

Words are runs of letters in lower case. ``score`` is the posterior of the language, given equal priors and words that
count as EVIDENCE independent ones at most; ``known`` is the share of words that the model knows.

Null text, or one without letters: ``und`` with score 0. Without any labelled text all documents are ``und``. Null
languages are no labels; more than LANGUAGES of them are an error. Texts of any length are scored whole, in stretches.
Repeated rows and other columns are kept; empty tables give empty results.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.llm.shared import commonest, kept_in_worker, map_batches, stored

#: Distinct texts of a language that a model is fitted on, about as many at most; all of them where there are no more.
SAMPLE_DOCS = 4000
#: Words, and n-grams of more than one letter, that a model knows, over all languages.
MODEL_WORDS = 150_000
MODEL_GRAMS = 150_000
GRAM = 5
#: Languages that a model may have; beyond that, ``fit`` fails.
LANGUAGES = 500
STRETCH = 8192
EVIDENCE = 50
BACKOFF = math.log(0.4)
CACHE = 400_000
UND = "und"
LETTERS = re.compile(r"[^\W\d_]+")
#: What that pattern takes for letters, but ``str.isalpha`` doesn't: halves, squares and the like.
NUMBERS = frozenset(c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())


def words_of(text: str) -> list[str]:
    """A text's runs of letters, in lower case."""
    text = text.lower()
    for c in () if text.isascii() else NUMBERS.intersection(text):
        text = text.replace(c, "_")
    return LETTERS.findall(text)


class Model:
    """Log frequencies by language: a row of ``table`` for each of the words and then of the n-grams that are known."""

    def __init__(self, langs: list[str], words: list[str], grams: list[str], table: np.ndarray, floor: np.ndarray):
        self.langs, self.table, self.floor, self.items = langs, table, floor, ("\n".join(words), "\n".join(grams))
        self.found: dict[str, np.ndarray] = {}

    def __getattr__(self, name: str):
        # made where they are needed: what is sent is the joined items
        if name not in ("words", "grams"):
            raise AttributeError(name)
        words, grams = (x.split("\n") if x else [] for x in self.items)
        self.words = {w: i for i, w in enumerate(words)}
        self.grams = {g: len(words) + i for i, g in enumerate(grams)}
        return getattr(self, name)

    def __getstate__(self):
        return self.langs, self.table, self.floor, self.items

    def __setstate__(self, state):
        self.langs, self.table, self.floor, self.items = state
        self.found = {}

    def gram(self, g: str) -> np.ndarray:
        at = self.grams.get(g)
        if at is not None:
            return self.table[at]
        if len(g) == 1:
            return self.floor
        found = self.found.get(g)
        if found is None:
            if len(self.found) > CACHE:
                self.found.clear()
            found = self.found[g] = BACKOFF + (self.gram(g[:-1]) + self.gram(g[1:])) / 2
        return found

    def word(self, w: str) -> np.ndarray:
        at = self.words.get(w)
        if at is not None:
            return self.table[at]
        padded = f" {w} "
        n = min(GRAM, len(padded))
        total = np.zeros(len(self.langs))
        for i in range(len(padded) - n + 1):
            total += self.gram(padded[i : i + n])
        return BACKOFF + total / (len(padded) - n + 1)


class WordScores(dict):
    """Row numbers of words in ``rows``, which holds their log frequencies and, last, whether they are known."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.rows = model, np.zeros((1024, len(model.langs) + 1))

    def __missing__(self, w: str) -> int:
        at = len(self)
        if at >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[at, :-1] = self.model.word(w)
        self.rows[at, -1] = w in self.model.words
        self[w] = at
        return at

    def mean(self, words: list[str]) -> np.ndarray:
        """Mean over words, a stretch at a time."""
        total = np.zeros(self.rows.shape[1])
        for i in range(0, len(words), STRETCH):
            if len(self) > CACHE:
                self.clear()
            part = words[i : i + STRETCH]
            at = np.fromiter(map(self.__getitem__, part), np.int64, len(part))  # rows may be another array now
            total += self.rows[at].sum(0)
        return total / len(words)


def counted(df: DataFrame, text: str, lang: str) -> DataFrame:
    """(kind, lang, item, n): words (kind 0) and n-grams of padded words by language, counted in the tasks first."""

    def run(batches: Iterable[dict[str, list]]):
        seen: dict[str, Counter] = {}

        def flush():
            out: dict[str, list] = {"kind": [], "lang": [], "item": [], "n": []}
            for name, words in seen.items():
                items: list[dict[str, int]] = [words, *({} for _ in range(GRAM))]
                for w, n in words.items():
                    padded = f" {w} "
                    for size in range(1, GRAM + 1):
                        into = items[size]
                        for i in range(len(padded) - size + 1):
                            g = padded[i : i + size]
                            into[g] = into.get(g, 0) + n
                for kind, found in enumerate(items):
                    out["kind"] += [kind] * len(found)
                    out["lang"] += [name] * len(found)
                    out["item"] += found
                    out["n"] += found.values()
            seen.clear()
            return out

        for b in batches:
            for t, name in zip(b[text], b[lang]):
                seen.setdefault(name, Counter()).update(words_of(t))
            if sum(map(len, seen.values())) > CACHE // 4:
                yield flush()
        yield flush()

    df = df.select(text, lang).where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    return map_batches(df, run, "kind int, lang string, item string, n long").groupBy("kind", "lang", "item").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from df's labelled rows, of each language about ``sample_docs`` whole distinct texts chosen by a hash of the text."""
    labelled = df.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not sizes:
        return Model([], [], [], np.zeros((0, 0), np.float32), np.zeros(0))
    langs = sorted(sizes)
    share = F.create_map(*[F.lit(x) for name in langs for x in (name, min(1.0, sample_docs / sizes[name]))])
    chosen = labelled.where(F.shiftrightunsigned(F.xxhash64("text"), 11) / float(1 << 53) < share[F.col("lang")])
    # equal texts go in or stay out together, so each counts once
    chosen = chosen.groupBy("lang", F.md5(F.col("text").cast("binary"))).agg(F.min("text").alias("text"))
    items = stored(counted(chosen, "text", "lang"), "langid")
    sums = np.zeros((GRAM + 1, len(langs)))
    place = {name: i for i, name in enumerate(langs)}
    for r in items.groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect():
        sums[r.kind, place[r.lang]] = r.n
    total = F.create_map(*[F.lit(x) for kind in range(GRAM + 1) for i, name in enumerate(langs) for x in (f"{kind} {name}", float(sums[kind, i] or 1))])
    # the items that weigh most in any language, as many as the model may hold
    part = F.col("n") / total[F.concat(F.col("kind").cast("string"), F.lit(" "), F.col("lang"))]
    by = F.map_from_entries(F.collect_list(F.struct("lang", "n")))
    ranked = items.groupBy("kind", "item").agg(F.max(part).alias("w"), by.alias("by"))
    ranked = stored(ranked.withColumn("w", (F.col("w") * 1e12).cast("long") + 1), "langid")
    words = commonest(ranked.where("kind = 0"), "w", "item", MODEL_WORDS)
    grams = ranked.where("kind = 1").unionByName(commonest(ranked.where("kind > 1"), "w", "item", MODEL_GRAMS))
    logs = np.log(sums + 1)
    counts = F.array(*[F.coalesce(F.try_element_at("by", F.lit(name)), F.lit(0)).cast("float") for name in langs])
    tables = []
    for rows in (words, grams):
        got = rows.select("kind", "item", counts.alias("n")).toArrow()
        n = got["n"].combine_chunks().flatten().to_numpy().reshape(-1, len(langs))
        tables.append((got["item"].to_pylist(), (np.log(n + 0.5) - logs[got["kind"].to_numpy()]).astype(np.float32)))
    (known, a), (pieces, b) = tables
    return Model(langs, known, pieces, np.concatenate([a, b]), np.log(0.5) - logs[1])


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with ``lang_pred``, ``score`` and ``known`` (share of known words); own columns of these names, in any case of letters, are replaced."""
    keep = [c for c in df.columns if c.lower() not in ("lang_pred", "score", "known")]
    sent = df.sparkSession.sparkContext.broadcast(model)
    name = uuid.uuid4().hex

    def run(batches: Iterable[dict[str, list]]):
        seen = kept_in_worker(("langid", name), lambda: WordScores(sent.value))
        names = seen.model.langs
        for b in batches:
            langs, scores, known = [], [], []
            for t in b[text]:
                words = words_of(t) if t and names else []
                if not words:
                    langs.append(UND), scores.append(0.0), known.append(0.0)
                    continue
                *mean, share = seen.mean(words).tolist()
                most = max(mean)
                weight = min(len(words), EVIDENCE)
                langs.append(names[mean.index(most)])
                scores.append(1 / sum(math.exp((x - most) * weight) for x in mean))
                known.append(share)
            yield {c: b[c] for c in keep} | {"lang_pred": langs, "score": scores, "known": known}

    kinds = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("known", T.DoubleType())]
    return map_batches(df.select(*keep), run, T.StructType([*(df.schema[c] for c in keep), *kinds]))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning: its fold, by a checksum of its id, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by a model of the labelled documents that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out()).select("text", "lang"))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "known")
