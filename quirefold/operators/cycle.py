"""Working cycles from an ordered log of marks: phases, pauses, net minutes, expiry.

Rows: stream, seq, ts, kind (start, seal1, attack, seal3, pause, resume, close; others are ignored). The order is that
of seq, not of time. Each start opens a cycle; marks keep their first time; a close ends it, but later marks still
move its last time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("start", "seal1", "attack", "seal3", "pause", "resume", "close")
HOURS = 20


def seconds(a: Column, b: Column) -> Column:
    """From a to b, exact to the microsecond."""
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1e6


def numbered(marks: DataFrame) -> DataFrame:
    """marks with the number of their cycle; those before the first start go."""
    upto = Window.partitionBy("stream").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    known = marks.where(F.col("kind").isin(*KINDS))
    return known.withColumn("cycle", F.sum((F.col("kind") == "start").cast("int")).over(upto)).where("cycle > 0")


def pauses(cycles: DataFrame) -> DataFrame:
    """(stream, cycle, p, r) of numbered marks: a pause in a pause and a resume outside one don't count; r null if open."""
    w = Window.partitionBy("stream", "cycle").orderBy("seq")
    turns = cycles.where(F.col("kind").isin("pause", "resume")).withColumn("was", F.lag("kind").over(w))
    turns = turns.where(((F.col("kind") == "pause") & (F.coalesce("was", F.lit("resume")) == "resume")) | ((F.col("kind") == "resume") & (F.col("was") == "pause")))
    return turns.withColumn("r", F.lead("ts").over(w)).where("kind = 'pause'").select("stream", "cycle", F.col("ts").alias("p"), "r")


def cycles(marks: DataFrame, now: Column, hours: float = HOURS) -> DataFrame:
    """A row for each cycle: first marks, closed, paused, last, expired (more than ``hours`` idle, unless paused), phase."""
    rows = numbered(marks)
    first = lambda k: F.min_by(F.when(F.col("kind") == k, F.col("ts")), F.when(F.col("kind") == k, F.col("seq")))
    turn = F.max_by("kind", F.when(F.col("kind").isin("pause", "resume"), F.col("seq")))
    out = rows.groupBy("stream", "cycle").agg(*[first(k).alias(k) for k in ("start", "seal1", "attack", "seal3")], F.bool_or(F.col("kind") == "close").alias("closed"), F.max_by("ts", "seq").alias("last"), F.coalesce(turn == "pause", F.lit(False)).alias("paused"))
    out = out.withColumn("expired", ~F.col("closed") & ~F.col("paused") & (seconds(F.col("last"), now) > hours * 3600))
    return out.withColumn("phase", phase())


def phase() -> Column:
    return F.when(F.col("closed") | F.col("expired"), "libre").when(F.col("seal1").isNull(), "f1").when(F.col("attack").isNotNull() & F.col("seal3").isNull(), "f3").when(F.col("seal3").isNotNull(), "f4").otherwise("f2")


def allowed(phase: Column, forced: Column) -> tuple[Column, Column]:
    """Whether a model may be called in a phase, and whether a forced call breaks the rule."""
    free = phase.isin("libre", "f2", "f4")
    return free | forced, forced & ~free


def net_minutes(spans: DataFrame, breaks: DataFrame, now: Column, a: str, b: str) -> DataFrame:
    """spans (stream, cycle, a, b) with ``minutes`` from a to b less the pauses within, one decimal."""
    end = F.coalesce(F.col("r"), now)
    over = F.greatest(F.lit(0.0), seconds(F.greatest(F.col("p"), F.col("_a")), F.least(end, F.col("_b"))))
    pos = spans.select("stream", "cycle", F.col(a).alias("_a"), F.col(b).alias("_b"))
    cut = pos.join(breaks, ["stream", "cycle"]).where((F.col("p") < F.col("_b")) & (end > F.col("_a"))).groupBy("stream", "cycle").agg(F.sum(over).alias("_cut"))
    return spans.join(cut, ["stream", "cycle"], "left").withColumn("minutes", F.round((seconds(F.col(a), F.col(b)) - F.coalesce("_cut", F.lit(0.0))) / 60, 1)).drop("_cut")


def guarded(marks: DataFrame) -> DataFrame:
    """marks with ``before``, the phase of their stream when they come, and ``ok``, whether they may come then.

    A first seal needs phase f1, a third one f3, an end f4; an attack f2, a pause an open cycle that isn't paused, a
    resumption a paused one. What isn't allowed is a mark of the log all the same, so later ones see it.
    """
    known = marks.where(F.col("kind").isin(*KINDS))
    upto = Window.partitionBy("stream").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.coalesce(F.sum((F.col("kind") == "start").cast("int")).over(upto), F.lit(0))
    rows = known.withColumn("_cycle", starts)
    was = Window.partitionBy("stream", "_cycle").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    # the start itself is counted in the cycle before it
    seen = lambda k: F.coalesce(F.bool_or(F.col("kind") == k).over(was), F.lit(False))
    turn = F.last(F.when(F.col("kind").isin("pause", "resume"), F.col("kind")), ignorenulls=True).over(was)
    rows = rows.withColumn("closed", seen("close") | (F.col("_cycle") == 0)).withColumn("expired", F.lit(False))
    for k in ("seal1", "attack", "seal3"):
        rows = rows.withColumn(k, F.when(seen(k), F.lit(1)))
    rows = rows.withColumn("paused", F.coalesce(turn == "pause", F.lit(False))).withColumn("before", phase())
    open_ = F.col("before") != "libre"
    needs = {"seal1": F.col("before") == "f1", "attack": F.col("before") == "f2", "seal3": F.col("before") == "f3", "close": F.col("before") == "f4", "pause": open_ & ~F.col("paused"), "resume": open_ & F.col("paused")}
    ok = F.lit(True)
    for k, c in needs.items():
        ok = F.when(F.col("kind") == k, c).otherwise(ok)
    return rows.withColumn("ok", ok).drop("_cycle", "closed", "expired", "seal1", "attack", "seal3", "paused")


def paused_hours(cycles_: DataFrame, breaks: DataFrame, now: Column, warn: float = 72) -> DataFrame:
    """cycles with ``hours`` since the last pause where they are paused, one decimal, and ``warning``: more than ``warn``."""
    last = breaks.where("r is null").groupBy("stream", "cycle").agg(F.max("p").alias("_p"))
    out = cycles_.join(last, ["stream", "cycle"], "left")
    hours = F.when(F.col("paused") & (F.col("phase") != "libre"), F.round(seconds(F.col("_p"), now) / 3600, 1))
    return out.withColumn("hours", hours).withColumn("warning", F.coalesce(F.col("hours") > warn, F.lit(False))).drop("_p")


def session_of(cycles_: DataFrame, sessions: DataFrame) -> DataFrame:
    """cycles with ``date``, that of their start, and ``path``: the first session (path, date) of it that is no diagnosis."""
    plain = sessions.where(~F.contains("path", F.lit("diagnostico"))).groupBy("date").agg(F.min("path").alias("path"))
    return cycles_.withColumn("date", F.to_date("start")).join(plain, "date", "left")


def metrics(marks: DataFrame, breaks: DataFrame, now: Column) -> DataFrame:
    """(stream, date, cycles, closed, min_f1, min_f3): by start date, net minutes of the first and third phase.

    A mark counts up to its cycle's end, so what comes after a close doesn't move anything.
    """
    rows = numbered(marks)
    ended = F.coalesce(F.bool_or(F.col("kind") == "close").over(Window.partitionBy("stream", "cycle").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    rows = rows.withColumn("_e", ended).where("not _e")
    first = lambda k: F.min_by(F.when(F.col("kind") == k, F.col("ts")), F.when(F.col("kind") == k, F.col("seq"))).alias(k)
    one = rows.groupBy("stream", "cycle").agg(*[first(k) for k in ("start", "seal1", "attack", "seal3")], F.bool_or(F.col("kind") == "close").alias("closed"))
    one = net_minutes(one, breaks, now, "start", "seal1").withColumnRenamed("minutes", "f1")
    one = net_minutes(one, breaks, now, "attack", "seal3").withColumnRenamed("minutes", "f3")
    return one.groupBy("stream", F.to_date("start").alias("date")).agg(F.count("*").alias("cycles"), F.count_if("closed").alias("closed"), F.sum("f1").alias("min_f1"), F.sum("f3").alias("min_f3"))


# What is to be done next, by phase.
NEXT = {"f1": "sellar 1", "f2": "ataque", "f3": "sellar 3", "f4": "cierre"}


def suggestion(phase_: Column, paused: Column, due: Column, gaps: Column) -> Column:
    """What to do next: resume what is paused; else the phase's next step; when free, first what is due again, then structural gaps, else a new session."""
    out = F.when(due > 0, "reconstruir").when(gaps > 0, "lagunas").otherwise("sesion new")
    for k, v in NEXT.items():
        out = F.when(phase_ == k, v).otherwise(out)
    return F.when(paused & (phase_ != "libre"), "reanudar").otherwise(out)


def attack_mode(unread: Column, total: Column) -> Column:
    """'extension' once all of the core is read, else 'reconstruccion'."""
    return F.when((total > 0) & (unread == 0), "extension").otherwise("reconstruccion")


def is_base(label: Column) -> Column:
    """Whether a session is one of the base, by its label."""
    return F.startswith(label, F.lit("base-"))


def dashboard(counts: dict[str, Column], rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, value): several small aggregates of rows as one list."""
    made = rows.groupBy(*keys).agg(*[c.cast("double").alias(n) for n, c in counts.items()])
    return made.select(*keys, F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in counts])))


# The fields of an answer that closes a cycle.
CLOSE = "struct<diff_estructural: string, coincidencia_propuesta: int, errores: array<struct<cod: string, contexto: string, creia: string, es: string, posicion: string>>, tarjetas: array<struct<pregunta: string, respuesta: string>>, lagunas: array<struct<tema: string, texto: string>>, conjeturas: array<string>>"


def closings(spans: DataFrame, answers: DataFrame, breaks: DataFrame, calls: DataFrame, now: Column, known: DataFrame) -> dict[str, DataFrame]:
    """All that the close of a cycle writes, as tables by name: metrics, errors, cards, gaps, conjectures, and refused.

    spans: cycles as ``cycles`` gives them; only those of phase f4 can be closed, the others are refused. answers:
    (stream, cycle, day, answer, own), JSON with the fields of CLOSE, and the own valuation, null to take the proposed one;
    an answer that can't be read is refused. calls: (stream, day), of the questions asked. known: (stream, known), conjectures so far, on from
    which new ones are numbered.
    """
    read = answers.withColumn("a", F.from_json("answer", CLOSE))
    both = read.join(spans.select("stream", "cycle", "phase"), ["stream", "cycle"])
    # what isn't JSON is read as an answer without any field
    good = F.col("a").isNotNull() & F.coalesce(F.get_json_object("answer", "$").isNotNull(), F.lit(False))
    ready = both.where(good & (F.col("phase") == "f4"))
    refused = both.where(~(good & (F.col("phase") == "f4"))).select("stream", "cycle", F.when(F.col("phase") != "f4", F.col("phase")).otherwise("unread").alias("why"))
    each = lambda field, *columns: ready.select("stream", "cycle", "day", F.posexplode(f"a.{field}").alias("n", "x")).select("stream", "cycle", "day", F.col("n").cast("int").alias("n"), *columns)
    closed = spans.join(ready.select("stream", "cycle"), ["stream", "cycle"], "left_semi")
    times = net_minutes(closed, breaks, now, "start", "seal1").select("stream", "cycle", F.col("minutes").alias("min_f1"))
    times = times.join(net_minutes(closed, breaks, now, "attack", "seal3").select("stream", "cycle", F.col("minutes").alias("min_f3")), ["stream", "cycle"])
    asked = calls.groupBy("stream", "day").agg(F.count("*").alias("calls_f2"))
    match = F.coalesce(F.when(F.col("own").between(0, 3), F.col("own")), F.col("a.coincidencia_propuesta"), F.lit(0))
    size = lambda field: F.greatest(F.size(f"a.{field}"), F.lit(0)).cast("long")
    metrics = ready.select("stream", "cycle", "day", match.cast("long").alias("match"), size("errores").alias("errors"), size("conjeturas").alias("conjectures")).join(times, ["stream", "cycle"]).join(asked, ["stream", "day"], "left").withColumn("calls_f2", F.coalesce("calls_f2", F.lit(0)))
    w = Window.partitionBy("stream").orderBy("cycle", "n")
    conjectures = each("conjeturas", F.trim("x").alias("text")).join(known, "stream", "left").withColumn("number", (F.coalesce("known", F.lit(0)) + F.row_number().over(w)).cast("long")).drop("known")
    return {"metrics": metrics, "errors": each("errores", "x.*"), "cards": each("tarjetas", "x.*"), "gaps": each("lagunas", "x.*"), "conjectures": conjectures, "refused": refused}
