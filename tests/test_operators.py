from pyspark.sql import functions as F

from quirefold.functions import text as X
from quirefold.operators import cycle as C
from quirefold.operators import index as I
from quirefold.operators import locate as L
from quirefold.operators import registry as R
from quirefold.operators import search as S
from quirefold.sources import tables as T


def units(spark, rows):
    return spark.createDataFrame([("d", i + 1, *r) for i, r in enumerate(rows)], "doc string, n int, kind string, section string, page int, cut boolean, text string").selectExpr("*", "cast(null as string) label", "cast(null as string) number")


def test_fragments(spark):
    para = "word " * 120
    rows = [("titulo", "1", 1, False, "Title"), ("parrafo", "1", 1, False, para), ("parrafo", "1", 1, False, para), ("parrafo", "1", 2, False, para), ("parrafo", "1", 2, False, para), ("definicion", "1", 2, False, "short"), ("parrafo", "2", 3, False, para), ("parrafo", "3", 3, False, para), ("parrafo", "3", 4, True, para), ("parrafo", "3", 5, True, para), ("teorema", "3", 5, False, "A sentence of words. " * 300)]
    out = I.fragments(units(spark, rows)).orderBy("k").collect()
    assert [(r.first_n, r.last_n, r.kind) for r in out][:6] == [(2, 4, "parrafos"), (5, 5, "parrafo"), (6, 6, "definicion"), (7, 7, "parrafo"), (8, 8, "parrafo"), (9, 9, "parrafo")]
    long = [r for r in out if r.kind == "teorema"]
    assert len(long) > 1 and all(r.words <= 800 + 60 for r in long) and [r.part for r in long] == list(range(len(long))) and [r.short_ok for r in out if r.first_n == 9] == [True]


def test_phases(spark):
    base = "2024-01-01 "
    logs = {
        1: [("start", "10:00")], 2: [("start", "10:00"), ("seal1", "10:30")], 3: [("start", "10:00"), ("seal1", "10:30"), ("attack", "10:40")],
        4: [("start", "10:00"), ("seal1", "10:30"), ("attack", "10:40"), ("seal3", "11:00")], 5: [("start", "10:00"), ("close", "11:00")],
        6: [("start", "10:00"), ("pause", "10:10"), ("pause", "10:20"), ("resume", "10:30"), ("resume", "10:40"), ("seal1", "11:00")], 7: [("seal1", "10:00")],
    }
    rows = [(k, i, base + t + ":00", kind) for k, v in logs.items() for i, (kind, t) in enumerate(v)]
    marks = spark.createDataFrame(rows, "stream long, seq long, t string, kind string").withColumn("ts", F.to_timestamp("t"))
    at = lambda t: F.to_timestamp(F.lit(t))
    got = {r.stream: r for r in C.cycles(marks, at("2024-01-02 05:59:00")).collect()}
    assert [got[k].phase for k in range(1, 6)] == ["f1", "f2", "f3", "f4", "libre"] and 7 not in got
    late = {r.stream: r.expired for r in C.cycles(marks, at("2024-01-02 06:00:00.000001")).collect()}
    assert late[1] and not late[4] and not C.cycles(marks, at("2024-01-02 06:00:00")).where("stream = 1").first().expired
    spans = C.cycles(marks, at("2024-01-02 00:00:00")).where("stream = 6")
    assert C.net_minutes(spans, C.pauses(C.numbered(marks)), at("2024-01-02 00:00:00"), "start", "seal1").first().minutes == 40.0


def test_stream_is_the_batch(spark, sf):
    from quirefold.plans import log_queries as Q

    batch = {r.user_id: (r.cycle, r.closed, r.paused) for r in Q.cycle_phase(spark, sf).collect()}
    last = {}
    for r in Q.cycle_phase(spark, sf).orderBy("cycle").collect():
        last[r.user_id] = (r.cycle, r.closed, r.paused)
    assert batch and {r.user_id: (r.cycle, r.closed, r.paused) for r in Q.stream_cycle(spark, sf).collect()} == last


def test_search_properties(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    terms = S.index_terms(d, "doc_id", keep=("source",))
    scored = S.bm25(terms, ["the", "and"]).where("bm25 > 0").cache()
    few, more = ({r.id for r in S.capped(scored, "bm25", "source", 1, k).collect()} for k in (4, 8))
    assert few < more
    rows = S.capped(scored, "bm25", "source", 1, 8).collect()
    assert len({r.source for r in rows}) == len(rows)
    one = S.bm25(terms.where("source = 'src1'"), ["the"]).count()
    assert one == d.where("source = 'src1'").count()


def test_diff_of_itself_is_nothing(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), X.fingerprint16(F.col("text")).alias("hash"), "source")
    assert {r.status for r in I.difference(rows, rows, ["source"]).collect()} == {"same"}


def test_references(spark):
    results = spark.createDataFrame([("a", "d", 0, r"see \ref{x} and \eqref{y}"), ("b", "d", 1, r"\ref{x} \ref{z}")], "id string, doc string, pos int, text string")
    frags = spark.createDataFrame([("a", "d", 0, "y"), ("c", "d", 1, "x"), ("e", "d", 2, "z"), ("f", "q", 3, "z")], "id string, doc string, ord int, label string")
    assert [(r.id, r.via) for r in S.followed(results, frags).orderBy("id").collect()] == [("c", "a"), ("e", "b")]


def test_text_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(X.page_ranges(F.lit("1-3,5,9"), F.lit(6))) == [1, 2, 3, 5] and get(X.page_ranges(F.lit(""), F.lit(3))) == [1, 2, 3]
    assert get(X.tokens(F.lit(r"The \alpha2 x Ab-c1"))) == ["the", "alpha", "ab", "c1"] and get(X.bag(F.lit(r"\foo The abc1 de"))) == ["the", "abc"]
    assert get(X.without_comments(F.lit("a \\% b % c"))) == "a \\% b " and get(X.cited_keys(F.lit(r"\cite{a, b}\citep[x]{b,c}"))) == ["a", "b", "c"]
    assert get(X.header_fields(F.lit("---\nestado: revisado\nk: a: b\n---\nbody"))) == {"estado": "revisado", "k": "a: b"} and get(X.body(F.lit("---\nk: v\n---\nbody"))) == "body"
    assert get(X.topic(F.lit("2024 | a | Borel : more"))) == "borel" and get(X.squeezed(X.plain_text(F.lit(r"A $x$ \emph{b} \ref{q} [c]")))) == "a b c"
    assert get(X.sentences(F.lit("One. Two; three. Four"))) == ["One.", "Two; three.", "Four"] and get(X.json_object(F.lit('x {"a": 1} y'))) == '{"a": 1}'
    assert get(X.slug(F.lit("Hello, World!"))) == "hello-world" and get(X.section(F.lit("## A\none\n## B\ntwo"), "A")) == "one"
    assert one.select(X.nfkc(F.lit("ﬁ")).alias("x"), X.unaccented(F.lit("Múltiple")).alias("y")).first() == ("fi", "multiple")


def test_glued_words_are_taken_apart(spark):
    vocabulary = spark.createDataFrame([("d", w) for w in ("red", "house", "horse", "ses", "use")] + [("e", "red")], "doc string, word string")
    words = spark.createDataFrame([("d", "aredhouses"), ("d", "horsered"), ("e", "aredhouses"), ("e", "nothing")], "doc string, word string")
    got = {(r.doc, r.word): r.parts for r in L.unglued(words, vocabulary).collect()}
    assert got == {("d", "aredhouses"): ["red", "house"], ("d", "horsered"): ["horse", "red"], ("e", "aredhouses"): ["red"]}


def test_registries(spark):
    prices = spark.createDataFrame([("m", 2.0, None, 4.0)], "model string, p_in double, p_cache double, p_out double")
    calls = spark.createDataFrame([("m", 1_000_000, 500_000, 2_000_000), ("q", 1, 1, 1)], "model string, tokens_in long, tokens_out long, tokens_cache long")
    got = {r.model: r.eur for r in R.cost(calls, prices, 0.5).collect()}
    assert got == {"m": 2.0, "q": None}
    used = spark.createDataFrame([(1,), (2,), (4,)], "number long")
    assert R.next_number(used).first().next == 3 and R.next_number(used.limit(0)).first().next == 1
    stored = spark.createDataFrame([("a", "mine", 1)], "id string, note string, n int")
    new = spark.createDataFrame([("a", "theirs", 2), ("b", "x", 3)], "id string, note string, n int")
    assert sorted(map(tuple, R.upserted(stored, new, "id", ["note"]).collect())) == [("a", "mine", 2), ("b", "x", 3)]


def test_sources(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"ts": "2024", "tokens_in": 3}\nbroken\n\n{"ts": "2025"}\n')
    assert sorted(r.ts for r in T.log(spark, str(tmp_path / "log.jsonl")).collect()) == ["2024", "2025"]
    lines = spark.createDataFrame([("2024-01-01T10:00:00+01:00\tinicio sesion 1",), ("no tab",)], "value string")
    row = T.commits(lines).withColumn("kind", T.mark_kind(F.col("msg"))).collect()
    assert len(row) == 1 and row[0].kind == "start"
    md = spark.createDataFrame([("d", "# Head\n\n{0}-------\n\nA paragraph with enough letters to be kept as a unit.\n\nshort\n\n{1}-------\n\n## Two\n\nAnother paragraph with enough letters to be kept here.")], "doc string, text string")
    assert [(r.n, r.page, r.section) for r in T.markdown_units(md).collect()] == [(1, 0, "Head"), (2, 1, "Two")]
    html = spark.createDataFrame([('<html lang="fr"><meta name="Author" content="A"><meta name="author" content="B"><title> T </title>',)], "html string")
    r = T.html_head(html).first()
    assert (r.title, r.lang, r.metas) == ("T", "fr", {"author": "A"})
