import datetime
import random

from pyspark.sql import functions as F

from quirefold.operators import cycle
from quirefold.sources import sinks
from quirefold.streaming import logs


def test_stream_expires_as_the_batch_does(spark, tmp_path):
    rng = random.Random(2)
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    rows, at = [], start
    for seq in range(600):
        at += datetime.timedelta(minutes=rng.randint(1, 120))
        rows.append((rng.randrange(12), seq, at, rng.choices(["start", "seal1", "attack", "seal3", "pause", "resume", "close", None], [3, 3, 2, 2, 2, 1, 1, 2])[0]))
    rows.append((99, 600, at, "start"))
    marks = spark.createDataFrame(rows, "stream long, seq long, ts timestamp, kind string")
    path = logs.in_files(marks, "seq", 5, str(tmp_path / "marks"))
    stream = spark.readStream.schema(marks.schema).option("maxFilesPerTrigger", 1).parquet(path)
    made = logs.drained(logs.cycles(stream), str(tmp_path / "out"), "update")
    got = {r.stream: tuple(r.x) for r in made.groupBy("stream").agg(F.max_by(F.struct("cycle", "closed", "paused", "expired"), "batch").alias("x")).collect()}
    now = F.lit(at - datetime.timedelta(hours=1))
    want = {}
    for r in cycle.cycles(marks, now).orderBy("cycle").collect():
        want[r.stream] = (r.cycle, r.closed, r.paused, r.expired)
    assert got == want and {x[3] for x in want.values()} == {True, False} and made.select("batch").distinct().count() >= 5


def test_threads_forget_the_oldest(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(90), at) for at in range(400)]
    df = spark.createDataFrame(rows, "user string, thread long, at long")
    path = logs.in_files(df, "at", 4, str(tmp_path / "turns"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    made = logs.drained(logs.threads(stream), str(tmp_path / "out"), "update")
    last = made.groupBy("user").agg(F.max("batch").alias("b"))
    got = sorted((r.user, r.thread, r.used) for r in made.join(last, "user").where("batch = b").collect())
    used = {}
    for u, t, at in rows:
        used[u, t] = at
    want = sorted((u, t, at) for k in "ab" for (u, t), at in sorted((x for x in used.items() if x[0][0] == k), key=lambda x: (-x[1], x[0][1]))[:40])
    assert got == want


def test_index_log(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = lambda ids, tag, gone=False: spark.createDataFrame([(str(i), f"{tag}{i}", "s", gone) for i in ids], "id string, hash string, source string, gone boolean")
    first = rows(range(2000), "h")
    schema = sinks.index_schema(first)
    state = lambda: {r.id: (r.hash, r.vector_from) for r in sinks.last_version(spark, path, schema).collect()}
    sinks.apply_changes(first, path, 0, ["source"])
    assert state() == {str(i): (f"h{i}", 0) for i in range(2000)}
    change = rows(range(20), "g").unionByName(rows(range(20, 30), "h")).unionByName(rows(range(30, 35), "h", True)).unionByName(rows(range(9000, 9003), "x", True))
    sinks.apply_changes(change, path, 1, ["source"])
    was = state()
    assert was == {str(i): (f"g{i}", 1) if i < 20 else (f"h{i}", 0) for i in range(2000) if not 30 <= i < 35}
    written = spark.read.parquet(next(e.path for e in sinks.entries(spark, path) if e.number == 1)).count()
    assert written == 25  # what changed, no more
    sinks.apply_changes(rows(range(40, 50), "k"), path, 2, ["source"])
    then = state()
    for number, batch in ((1, change), (2, rows(range(40, 50), "k"))):
        sinks.apply_changes(batch, path, number, ["source"])
        assert state() == then


def test_index_log_is_written_whole_now_and_then(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "COMPACT", 3)
    path = str(tmp_path / "index")
    want = {}
    for number in range(5):
        df = spark.createDataFrame([(str(i), f"{number}", "s") for i in range(number, number + 3)], "id string, hash string, source string")
        sinks.apply_changes(df, path, number, ["source"])
        want |= {str(i): (str(number), number) for i in range(number, number + 3)}
    assert [e.number for e in sinks.entries(spark, path) if e.base] == [2]
    assert {r.id: (r.hash, r.vector_from) for r in sinks.last_version(spark, path, sinks.index_schema(df)).collect()} == want
