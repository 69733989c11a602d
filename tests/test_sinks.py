from pyspark.sql import functions as F

from quirefold.operators import cycle, search
from quirefold.sources import sinks


def test_a_batch_is_seen_whole_and_once(spark, tmp_path):
    path = str(tmp_path / "b")
    a = lambda *x: spark.createDataFrame([(i,) for i in x], "i int")
    assert sinks.committed(spark, path, "a", "i int").count() == 0
    sinks.commit_batch({"a": a(1, 2), "b": a(7)}, path, "one")
    for _ in range(3):
        sinks.commit_batch({"a": a(3), "b": a(8, 9)}, path, "two")
    a(99).write.parquet(f"{path}/a/three-left")  # a batch that was never committed
    got = {name: sorted((r.batch, r.i) for r in sinks.committed(spark, path, name, "i int").collect()) for name in "ab"}
    assert got == {"a": [("one", 1), ("one", 2), ("two", 3)], "b": [("one", 7), ("two", 8), ("two", 9)]}


def test_exports_spare_what_was_edited(spark):
    frame = lambda rows: spark.createDataFrame(rows, "name string, text string")
    first = sinks.exported(frame([]), frame([("a", "text a\nmore"), ("b", ""), ("c", "c")])).drop("outcome")
    texts = {r.name: r.text for r in first.collect()}
    assert texts["a"].endswith("\ntext a\nmore") and texts["a"].startswith("% ") and len(texts["a"].split("\n")[0]) == 18
    edited = frame([("a", texts["a"]), ("b", texts["b"] + "x"), ("c", "all mine"), ("old", "old")])
    new = frame([("a", "anew"), ("b", "anew"), ("c", "anew"), ("d", "anew")])
    got = {r.name: (r.outcome, r.text.split("\n")[-1]) for r in sinks.exported(edited, new).collect()}
    assert got == {"a": ("written", "anew"), "b": ("yours", "x"), "c": ("yours", "all mine"), "d": ("written", "anew"), "old": ("kept", "old")}
    assert {r.outcome for r in sinks.exported(edited, new, force=True).where("name <> 'old'").collect()} == {"written"}


def test_bibliography_round_trip(spark, tmp_path):
    path = str(tmp_path / "bib")
    fields = "title string, year int, authors array<string>"
    assert sinks.read_bibliography(spark, path, fields).count() == 0
    rows = [("z", "Ünïcode", 2001, ["A", "B"]), ("a", None, None, None), ("m", 'quo"te\nline', 1999, [])]
    sinks.write_bibliography(spark.createDataFrame(rows, f"doc string, {fields}"), path)
    spark.createDataFrame([("broken",), ("",), ('{"x": 1}',)], "value string").write.mode("append").text(path)
    got = sorted((tuple(r[:3]), r.authors) for r in sinks.read_bibliography(spark, path, fields).collect())
    assert got == sorted(((d, t, y), a) for d, t, y, a in rows)
    lines = [r.value for r in spark.read.text(path).where("value like '%fields%'").collect()]
    assert '{"doc":"z","fields":{"authors":["A","B"],"title":"Ünïcode","year":2001}}' in lines


def test_an_answer_that_asks_again(spark):
    answers = ["text\nBUSCAR: teorema de Borel \nend", "BUSCAR:", "no BUSCAR: x", None]
    df = spark.createDataFrame([(a,) for a in answers], "a string")
    assert [r[0] for r in df.select(search.wanted(F.col("a"))).collect()] == ["teorema de Borel", None, None, None]


def test_closing_needs_its_phase_and_an_answer(spark):
    rows = [(s, i, f"2024-01-01 {h}:00:00", k) for s in (1, 2, 3) for i, (h, k) in enumerate([("10", "start"), ("11", "seal1"), ("12", "attack"), ("13", "seal3")]) if s != 2 or k != "seal3"]
    marks = spark.createDataFrame(rows, "stream long, seq long, t string, kind string").withColumn("ts", F.to_timestamp("t"))
    now = F.to_timestamp(F.lit("2024-01-01 14:00:00"))
    spans = cycle.cycles(marks, now)
    answer = '{"coincidencia_propuesta": 3, "errores": [{"cod": "E1"}], "conjeturas": [" one ", "two"]}'
    answers = spark.createDataFrame([(1, 1, "d", answer, 9), (2, 1, "d", answer, 1), (3, 1, "d", "sorry", None)], "stream long, cycle long, day string, answer string, own int")
    calls = spark.createDataFrame([(1, "d"), (1, "d"), (2, "d")], "stream long, day string")
    made = cycle.closings(spans, answers, cycle.pauses(cycle.numbered(marks)), calls, now, spark.createDataFrame([(1, 4)], "stream long, known long"))
    m = made["metrics"].collect()
    assert [(r.stream, r.match, r.errors, r.conjectures, r.min_f1, r.min_f3, r.calls_f2) for r in m] == [(1, 3, 1, 2, 60.0, 60.0, 2)]
    assert [(r.text, r.number) for r in made["conjectures"].orderBy("number").collect()] == [("one", 5), ("two", 6)]
    assert {(r.stream, r.why) for r in made["refused"].collect()} == {(2, "f3"), (3, "unread")}
    assert made["cards"].count() == made["gaps"].count() == 0 and made["errors"].first().cod == "E1"
