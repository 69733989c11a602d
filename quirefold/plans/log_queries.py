"""Queries on event logs and registries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.operators import cycle as C
from quirefold.operators import registry as R
from quirefold.plans.common import docs
from quirefold.sources import sinks as W
from quirefold.sources.shared import fresh_path
from quirefold.sources.tables import table
from quirefold.streaming import logs

NOW = "2024-01-31 00:00:00"
PRICES = [("m0", 2.5, 1.25, 10.0), ("m1", 0.15, None, 0.6), ("m2", 1.1, 0.55, 4.4)]
FX = 0.87


def _kinds():
    """Event types as marks: two of them by the event's value."""
    e = F.col("event_type")
    low = F.col("value") < 35
    return F.when(e == "signup", "start").when((e == "view") & low, "seal1").when(e == "view", "seal3").when(e == "click", "attack").when((e == "error") & low, "pause").when(e == "error", "resume").when(e == "purchase", "close")


def _marks(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("stream"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), _kinds().alias("kind"))


def _cycles(spark: SparkSession, sf: str) -> DataFrame:
    return C.cycles(_marks(table(spark, sf, "events")), F.lit(NOW).cast("timestamp"))


def cycle_phase(spark: SparkSession, sf: str) -> DataFrame:
    return _cycles(spark, sf).select(F.col("stream").alias("user_id"), F.col("cycle").cast("long").alias("cycle"), "start", "closed", "paused", "phase")


def cycle_expiry(spark: SparkSession, sf: str) -> DataFrame:
    hours = F.round(C.seconds(F.col("last"), F.lit(NOW).cast("timestamp")) / 3600, 2)
    return _cycles(spark, sf).select(F.col("stream").alias("user_id"), F.col("cycle").cast("long").alias("cycle"), hours.alias("idle_hours"), "expired")


def net_minutes(spark: SparkSession, sf: str) -> DataFrame:
    now = F.lit(NOW).cast("timestamp")
    marks = _marks(table(spark, sf, "events"))
    found = C.net_minutes(C.cycles(marks, now).where("seal1 is not null"), C.pauses(C.numbered(marks)), now, "start", "seal1")
    return found.select(F.col("stream").alias("user_id"), F.col("cycle").cast("long").alias("cycle"), "minutes")


def engine_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Which cycles' phases allow a model, and where a forced call would break the rule."""
    free, broken = C.allowed(F.col("phase"), F.col("stream") % 3 == 0)
    return _cycles(spark, sf).groupBy("phase").agg(F.count("*").alias("cycles"), F.count_if(free).alias("allowed"), F.count_if(broken).alias("violations"))


def guarded_marks(spark: SparkSession, sf: str) -> DataFrame:
    """The phase before each mark of the log, and whether the mark may come then."""
    made = C.guarded(_marks(table(spark, sf, "events")))
    return made.select(F.col("stream").alias("user_id"), F.col("seq").alias("event_id"), "kind", F.col("before").alias("phase"), "ok")


def paused_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Hours since the last pause of paused cycles, with a warning after three days, and what is to be done next."""
    now, marks = F.lit(NOW).cast("timestamp"), _marks(table(spark, sf, "events"))
    made = C.paused_hours(C.cycles(marks, now), C.pauses(C.numbered(marks)), now)
    next_ = C.suggestion(F.col("phase"), F.col("paused"), F.col("stream") % 3, F.col("stream") % 2)
    return made.select(F.col("stream").alias("user_id"), F.col("cycle").cast("long").alias("cycle"), "hours", "warning", next_.alias("next"))


def cycle_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """The first session of the date of each cycle's start; orders' dates, a day of the month later, are sessions."""
    marks = _marks(table(spark, sf, "events"))
    day = F.make_date(F.lit(2024), F.lit(1), F.dayofmonth("o_orderdate"))
    label = F.concat(F.date_format(day, "yyyy-MM-dd"), F.when(F.col("o_orderkey") % 7 == 0, "-diagnostico-").otherwise("-paper-"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.lit(".md"))
    sessions = table(spark, sf, "orders").select(label.alias("path"), day.alias("date"))
    made = C.session_of(C.cycles(marks, F.lit(NOW).cast("timestamp")), sessions)
    return made.select(F.col("stream").alias("user_id"), F.col("cycle").cast("long").alias("cycle"), F.col("date").cast("string").alias("date"), "path", C.is_base(F.substring("path", 12, 100)).alias("base"))


def cycle_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Net minutes of the first and third phase by user and start date."""
    now, marks = F.lit(NOW).cast("timestamp"), _marks(table(spark, sf, "events"))
    made = C.metrics(marks, C.pauses(C.numbered(marks)), now)
    return made.select(F.col("stream").alias("user_id"), F.col("date").cast("string").alias("date"), "cycles", "closed", F.round("min_f1", 1).alias("min_f1"), F.round("min_f3", 1).alias("min_f3"))


def dashboard(spark: SparkSession, sf: str) -> DataFrame:
    """Small aggregates of the orders by customer as one list, and the mode that follows from them."""
    open_ = F.col("o_orderstatus") == "O"
    counts = {"orders": F.count("*"), "unread": F.count_if(open_), "total": F.round(F.sum("o_totalprice"), 2), "base": F.count_if(C.is_base(F.concat(F.lit("base-"), "o_orderstatus")))}
    rows = C.dashboard(counts, table(spark, sf, "orders"), ["o_custkey"])
    mode = table(spark, sf, "orders").groupBy("o_custkey").agg(C.attack_mode(F.count_if(open_), F.count("*")).alias("mode"))
    return rows.join(mode, "o_custkey")


def transcription_cost(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens, seconds and cut pages by month, with costs of three digits, none where a price is missing."""
    e = _calls(table(spark, sf, "events")).withColumn("seconds", F.col("tokens_out") / 100.0).withColumn("cut", F.col("tokens_out") > 15000)
    prices = spark.createDataFrame(PRICES, "model string, p_in double, p_cache double, p_out double")
    return R.transcription_costs(R.cost(e, prices, FX), "month", "model").select("month", "model", "pages", "tokens_in", "tokens_out", F.round("seconds", 2).alias("seconds"), "cut", F.round("eur", 2).alias("eur"))


def _calls(events: DataFrame) -> DataFrame:
    tin = F.floor(F.col("value") * 1000).cast("long")
    return events.select("event_id", F.date_format("ts", "yyyy-MM").alias("month"), F.to_date("ts").alias("day"), F.col("event_type").alias("command"), F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("model"), tin.alias("tokens_in"), F.floor(F.col("value") * 100).cast("long").alias("tokens_out"), (F.get_json_object("props", "$.k").cast("long") * 500).alias("tokens_cache"))


def _priced(spark: SparkSession, sf: str) -> DataFrame:
    prices = spark.createDataFrame(PRICES, "model string, p_in double, p_cache double, p_out double")
    return R.cost(_calls(table(spark, sf, "events")), prices, FX)


def call_cost(spark: SparkSession, sf: str) -> DataFrame:
    return _priced(spark, sf).select("event_id", F.round("eur", 9).alias("eur"))


def month_cost(spark: SparkSession, sf: str) -> DataFrame:
    return R.cost_by(_priced(spark, sf), "month", "command").withColumn("eur", F.round("eur", 4))


def cost_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rows = _priced(spark, sf).rollup("month", "command").agg(*R.cost_sums())
    return rows.withColumn("alert", R.budget_alert(F.col("eur"), F.col("unpriced"), 20.0)).withColumn("eur", F.round("eur", 4))


def last4_vs_prev4(spark: SparkSession, sf: str) -> DataFrame:
    found = R.trend(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice")
    return found.select("o_custkey", F.round("recent", 4).alias("recent"), F.round("earlier", 4).alias("earlier"))


def topic_recurrence(spark: SparkSession, sf: str) -> DataFrame:
    lines = docs(spark, sf).select(F.explode(F.split("text", "\n")).alias("line")).where(F.contains("line", F.lit("|")))
    return R.recurrence(lines.where(~F.trim("line").rlike(r"\|$")))


def spaced_repetition(spark: SparkSession, sf: str) -> DataFrame:
    tries = table(spark, sf, "events").select("user_id", "event_type", F.col("event_id").alias("seq"), F.to_date("ts").alias("date"), (F.floor("value") % 4).cast("int").alias("level"))
    return R.due(tries, ["user_id", "event_type"], F.to_date(F.lit(NOW))).select("user_id", "event_type", "level", F.col("days").cast("long").alias("days"))


def progress_first_unread(spark: SparkSession, sf: str) -> DataFrame:
    return R.progress(table(spark, sf, "orders"), ["o_custkey"], "o_orderkey", F.col("o_orderstatus") != "O")


def card_export_split(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.lit("- "), "p_name", F.lit(" :: "), "p_type", F.when(F.col("p_brand") == "Brand#2", " VERIFICAR CON PAPER").otherwise(""))
    return R.cards(table(spark, sf, "part").withColumn("line", line), "line").select("p_partkey", "front", "back", "held")


def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by status with the share of all, the commonest first."""
    n = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    return n.crossJoin(F.broadcast(total)).select("o_orderstatus", "n", F.round(F.col("n") / F.col("t"), 4).alias("share")).orderBy(F.desc("n"), "o_orderstatus")


def stream_cost_window(spark: SparkSession, sf: str) -> DataFrame:
    """Daily cost by command from the log as a stream; open windows at its end are in it too (complete mode)."""
    calls = logs.table_stream(spark, sf, "events").withColumn("tokens", F.floor(F.col("value") * 1000).cast("long"))
    made = logs.drained(logs.windowed(calls, "ts", "event_type", {"tokens": "tokens"}), fresh_path(spark, "stream"), "complete")
    last = made.agg(F.max("batch").alias("b"))
    return made.join(F.broadcast(last), F.col("batch") == F.col("b")).select(F.to_date("start").alias("day"), "event_type", "calls", "tokens")


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """An answer for each cycle, made of its user's events: errors, views as cards, clicks as gaps, purchases as conjectures; one in eleven can't be read."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("stream"), "event_id", "event_type")
    of = lambda kind, x: F.array_sort(F.collect_list(F.when(F.col("event_type") == kind, F.struct(F.col("event_id").alias("i"), x.alias("x")))))
    text = F.concat(F.lit("e"), F.col("event_id"))
    parts = e.groupBy("stream").agg(of("error", F.struct(F.lit("E1").alias("cod"), text.alias("contexto"))).alias("errores"), of("view", F.struct(text.alias("pregunta"), F.lit("r").alias("respuesta"))).alias("tarjetas"), of("click", F.struct(F.lit("t").alias("tema"), text.alias("texto"))).alias("lagunas"), of("purchase", F.concat(F.lit(" c"), F.col("event_id"), F.lit(" "))).alias("conjeturas"), F.count("*").alias("n"))
    answer = F.to_json(F.struct(F.lit("d").alias("diff_estructural"), (F.col("n") % 4).alias("coincidencia_propuesta"), *[F.col(f"{c}.x").alias(c) for c in ("errores", "tarjetas", "lagunas", "conjeturas")]))
    cycles = _cycles(spark, sf).select("stream", "cycle", F.to_date("start").alias("day"))
    return cycles.join(parts.select("stream", answer.alias("answer"), "n"), "stream").select("stream", "cycle", "day", F.when(F.col("cycle") % 11 == 7, "no answer").otherwise(F.col("answer")).alias("answer"), F.when(F.col("cycle") % 3 == 0, 5).when(F.col("cycle") % 3 == 1, 2).alias("own"))


def _closed(spark: SparkSession, sf: str) -> tuple[str, dict[str, DataFrame]]:
    """Closings of all cycles, committed in two batches, of which the second is repeated."""
    now = F.lit(NOW).cast("timestamp")
    marks = _marks(table(spark, sf, "events"))
    spans, breaks = C.cycles(marks, now), C.pauses(C.numbered(marks))
    calls = table(spark, sf, "events").where("event_type = 'click'").select(F.col("user_id").alias("stream"), F.to_date("ts").alias("day"))
    known = calls.select("stream").distinct().select("stream", (F.col("stream") % 5).alias("known"))
    path, answers = fresh_path(spark, "closed"), _answers(spark, sf)
    for batch, part in (("even", 0), ("odd", 1), ("odd", 1)):
        made = C.closings(spans, answers.where(F.pmod("stream", F.lit(2)) == part), breaks, calls, now, known)
        W.commit_batch(made, path, batch)
    return path, made


def closed_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of the closed cycles in one report, after a repeated batch."""
    path, made = _closed(spark, sf)
    m = W.committed(spark, path, "metrics", made["metrics"].schema)
    return m.select(F.col("stream").alias("user_id"), F.col("cycle").cast("long").alias("cycle"), "match", "errors", "conjectures", "min_f1", "min_f3", "calls_f2")


def closed_registers(spark: SparkSession, sf: str) -> DataFrame:
    """What closing wrote into the registers, by user, and how many closings were refused."""
    path, made = _closed(spark, sf)
    out = None
    for name in ("errors", "cards", "gaps", "conjectures", "refused"):
        t = W.committed(spark, path, name, made[name].schema)
        last = F.max("number") if name == "conjectures" else F.lit(None).cast("long")
        one = t.groupBy("stream").agg(F.count("*").alias("rows"), last.alias("last")).select(F.col("stream").alias("user_id"), F.lit(name).alias("register"), "rows", "last")
        out = one if out is None else out.unionByName(one)
    return out


def _parts(spark: SparkSession, df: DataFrame, order: str, parts: int) -> DataFrame:
    """A table as a stream of several batches, in order."""
    path = logs.in_files(df, order, parts, fresh_path(spark, "files"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def stream_cycle(spark: SparkSession, sf: str) -> DataFrame:
    """The state of each user's current cycle when the log has ended, kept by a stream over three batches; expired ones by timers."""
    marks = _parts(spark, _marks(table(spark, sf, "events")), "seq", 3)
    made = logs.drained(logs.cycles(marks), fresh_path(spark, "stream"), "update")
    last = made.groupBy("stream").agg(F.max_by(F.struct("cycle", "start_seq", "closed", "paused", "seal1", "attack", "seal3", "expired"), "batch").alias("x"))
    return last.select(F.col("stream").alias("user_id"), "x.*")


def stream_threads(spark: SparkSession, sf: str) -> DataFrame:
    """The threads that a store of 40 for each order status and priority holds after three batches of orders, of those in the order of customers."""
    turns = table(spark, sf, "orders").select(F.concat_ws("/", "o_orderstatus", "o_orderpriority").alias("user"), F.col("o_custkey").alias("thread"), F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("at"), "o_orderkey")
    made = logs.drained(logs.threads(_parts(spark, turns, "at", 3).drop("o_orderkey")), fresh_path(spark, "stream"), "update")
    last = made.groupBy("user").agg(F.max("batch").alias("b"))
    return made.join(last, "user").where("batch = b").select("user", "thread", "used")


QUERIES = {f.__name__: f for f in (cycle_phase, cycle_expiry, net_minutes, engine_gate, call_cost, month_cost, cost_rollup, last4_vs_prev4, topic_recurrence, spaced_repetition, progress_first_unread, card_export_split, status_counts, stream_cost_window, closed_metrics, closed_registers, stream_cycle, stream_threads, guarded_marks, paused_cycles, cycle_sessions, cycle_metrics, dashboard, transcription_cost)}

_MARKS = """m AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN CASE WHEN value < 35 THEN 'seal1' ELSE 'seal3' END WHEN 'click' THEN 'attack'
      WHEN 'error' THEN CASE WHEN value < 35 THEN 'pause' ELSE 'resume' END WHEN 'purchase' THEN 'close' END AS kind FROM events),
    n AS (SELECT *, sum(CASE WHEN kind = 'start' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS cycle FROM m WHERE kind IS NOT NULL),
    k AS (SELECT * FROM n WHERE cycle > 0),
    c AS (SELECT user_id, cycle, arg_min(ts, event_id) FILTER (kind = 'start') AS start, arg_min(ts, event_id) FILTER (kind = 'seal1') AS seal1, arg_min(ts, event_id) FILTER (kind = 'attack') AS attack,
      arg_min(ts, event_id) FILTER (kind = 'seal3') AS seal3, bool_or(kind = 'close') AS closed, arg_max(ts, event_id) AS last, coalesce(arg_max(kind, event_id) FILTER (kind IN ('pause', 'resume')) = 'pause', false) AS paused FROM k GROUP BY ALL),
    x AS (SELECT *, epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(last) AS idle, NOT closed AND NOT paused AND epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(last) > 20 * 3600 * 1000000::BIGINT AS expired FROM c),
    y AS (SELECT *, CASE WHEN closed OR expired THEN 'libre' WHEN seal1 IS NULL THEN 'f1' WHEN attack IS NOT NULL AND seal3 IS NULL THEN 'f3' WHEN seal3 IS NOT NULL THEN 'f4' ELSE 'f2' END AS phase FROM x)"""
_CLOSED = f"""{_MARKS}, ready AS (SELECT * FROM y WHERE phase = 'f4' AND cycle % 11 <> 7),
    a AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'view') AS cards, count(*) FILTER (event_type = 'click') AS gaps, count(*) FILTER (event_type = 'purchase') AS conjectures FROM events GROUP BY ALL),
    t AS (SELECT *, lag(kind) OVER (PARTITION BY user_id, cycle ORDER BY event_id) AS was FROM k WHERE kind IN ('pause', 'resume')),
    u AS (SELECT * FROM t WHERE kind = 'pause' AND coalesce(was, 'resume') = 'resume' OR kind = 'resume' AND was = 'pause'),
    bk AS (SELECT * FROM (SELECT user_id, cycle, ts AS p, kind, lead(ts) OVER (PARTITION BY user_id, cycle ORDER BY event_id) AS r FROM u) WHERE kind = 'pause')"""
_COST = """p(model, p_in, p_cache, p_out) AS (VALUES ('m0', 2.5::DOUBLE, 1.25::DOUBLE, 10.0::DOUBLE), ('m1', 0.15, NULL, 0.6), ('m2', 1.1, 0.55, 4.4)),
    l AS (SELECT event_id, strftime(ts, '%Y-%m') AS month, event_type AS command, 'm' || (user_id % 4) AS model, CAST(floor(value * 1000) AS BIGINT) AS tokens_in, CAST(floor(value * 100) AS BIGINT) AS tokens_out,
      CAST(json_extract_string(props, '$.k') AS BIGINT) * 500 AS tokens_cache FROM events),
    e AS (SELECT l.*, least(coalesce(tokens_cache, 0), tokens_in) AS cached, p_in, p_cache, p_out FROM l LEFT JOIN p USING (model)),
    z AS (SELECT *, ((tokens_in - cached) * p_in + cached * coalesce(p_cache, p_in) + tokens_out * p_out) / 1e6 * 0.87 AS eur FROM e)"""
_SUMS = "count(*) AS calls, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, round(sum(coalesce(eur, 0)), 4) AS eur, bool_or(eur IS NULL) AS unpriced"

_PAUSES = """t AS (SELECT *, lag(kind) OVER (PARTITION BY user_id, cycle ORDER BY event_id) AS was FROM k WHERE kind IN ('pause', 'resume')),
    u AS (SELECT * FROM t WHERE kind = 'pause' AND coalesce(was, 'resume') = 'resume' OR kind = 'resume' AND was = 'pause'),
    r AS (SELECT user_id, cycle, ts AS p, kind, lead(ts) OVER (PARTITION BY user_id, cycle ORDER BY event_id) AS r FROM u)"""


def _net(a: str, b: str, name: str) -> str:
    return f"""{name} AS (SELECT q.user_id, q.cycle, round((epoch_us({b}) - epoch_us({a}) - coalesce(sum(greatest(0, epoch_us(least(coalesce(r, TIMESTAMP '{NOW}'), {b})) - epoch_us(greatest(p, {a})))) FILTER (p < {b} AND coalesce(r, TIMESTAMP '{NOW}') > {a}), 0)) / 1e6 / 60, 1) AS m
        FROM q LEFT JOIN r ON r.user_id = q.user_id AND r.cycle = q.cycle AND r.kind = 'pause' WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY q.user_id, q.cycle, {a}, {b})"""


SQL = {
    "guarded_marks": f"""WITH {_MARKS}, g AS (SELECT *, coalesce(sum(CASE WHEN kind = 'start' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cy FROM m WHERE kind IS NOT NULL),
        s AS (SELECT *, coalesce(bool_or(kind = 'seal1') OVER w, false) AS s1, coalesce(bool_or(kind = 'attack') OVER w, false) AS at_, coalesce(bool_or(kind = 'seal3') OVER w, false) AS s3, coalesce(bool_or(kind = 'close') OVER w, false) AS cl,
          coalesce(last_value(CASE WHEN kind IN ('pause', 'resume') THEN kind END IGNORE NULLS) OVER w = 'pause', false) AS pa FROM g WINDOW w AS (PARTITION BY user_id, cy ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f AS (SELECT *, CASE WHEN cl OR cy = 0 THEN 'libre' WHEN NOT s1 THEN 'f1' WHEN at_ AND NOT s3 THEN 'f3' WHEN s3 THEN 'f4' ELSE 'f2' END AS phase FROM s)
        SELECT user_id, event_id, kind, phase, CASE kind WHEN 'seal1' THEN phase = 'f1' WHEN 'attack' THEN phase = 'f2' WHEN 'seal3' THEN phase = 'f3' WHEN 'close' THEN phase = 'f4' WHEN 'pause' THEN phase <> 'libre' AND NOT pa WHEN 'resume' THEN phase <> 'libre' AND pa ELSE true END AS ok FROM f""",
    "paused_cycles": f"""WITH {_MARKS}, {_PAUSES}, l AS (SELECT user_id, cycle, max(p) AS p FROM r WHERE kind = 'pause' AND r IS NULL GROUP BY ALL), h AS (SELECT y.*, CASE WHEN paused AND phase <> 'libre' THEN round((epoch_us(TIMESTAMP '{NOW}') - epoch_us(p)) / 1e6 / 3600, 1) END AS hours FROM y LEFT JOIN l ON l.user_id = y.user_id AND l.cycle = y.cycle)
        SELECT user_id, CAST(cycle AS BIGINT) AS cycle, hours, coalesce(hours > 72, false) AS warning, CASE WHEN paused AND phase <> 'libre' THEN 'reanudar' WHEN phase = 'f1' THEN 'sellar 1' WHEN phase = 'f2' THEN 'ataque' WHEN phase = 'f3' THEN 'sellar 3' WHEN phase = 'f4' THEN 'cierre' WHEN user_id % 3 > 0 THEN 'reconstruir' WHEN user_id % 2 > 0 THEN 'lagunas' ELSE 'sesion new' END AS next FROM h""",
    "cycle_sessions": f"""WITH {_MARKS}, s AS (SELECT make_date(2024, 1, day(o_orderdate)) AS d, o_orderkey FROM orders WHERE o_orderkey % 7 > 0), b AS (SELECT d, min(lpad(CAST(o_orderkey AS VARCHAR), 9, '0')) AS k FROM s GROUP BY d)
        SELECT user_id, CAST(cycle AS BIGINT) AS cycle, CAST(CAST(start AS DATE) AS VARCHAR) AS date, CAST(d AS VARCHAR) || '-paper-' || k || '.md' AS path, CASE WHEN k IS NOT NULL THEN false END AS base FROM y LEFT JOIN b ON d = CAST(start AS DATE)""",
    "cycle_metrics": f"""WITH {_MARKS}, {_PAUSES}, e AS (SELECT *, coalesce(bool_or(kind = 'close') OVER (PARTITION BY user_id, cycle ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended FROM k),
        q AS (SELECT user_id, cycle, arg_min(ts, event_id) FILTER (kind = 'start') AS start, arg_min(ts, event_id) FILTER (kind = 'seal1') AS seal1, arg_min(ts, event_id) FILTER (kind = 'attack') AS attack, arg_min(ts, event_id) FILTER (kind = 'seal3') AS seal3, bool_or(kind = 'close') AS closed FROM e WHERE NOT ended GROUP BY ALL),
        {_net("start", "seal1", "f1")}, {_net("attack", "seal3", "f3")}
        SELECT q.user_id, CAST(CAST(start AS DATE) AS VARCHAR) AS date, count(*) AS cycles, count(*) FILTER (closed) AS closed, round(sum(f1.m), 1) AS min_f1, round(sum(f3.m), 1) AS min_f3 FROM q LEFT JOIN f1 ON f1.user_id = q.user_id AND f1.cycle = q.cycle LEFT JOIN f3 ON f3.user_id = q.user_id AND f3.cycle = q.cycle GROUP BY q.user_id, CAST(start AS DATE)""",
    "dashboard": """WITH c AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS u, round(sum(o_totalprice), 2) AS t FROM orders GROUP BY o_custkey)
        SELECT o_custkey, unnest(['orders', 'unread', 'total', 'base']) AS name, unnest([n::DOUBLE, u::DOUBLE, t, n::DOUBLE]) AS value, CASE WHEN u = 0 THEN 'extension' ELSE 'reconstruccion' END AS mode FROM c""",
    "transcription_cost": f"""WITH {_COST} SELECT month, model, count(*) AS pages, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, round(sum(tokens_out / 100.0), 2) AS seconds, count(*) FILTER (tokens_out > 15000) AS cut,
        round(CASE WHEN bool_and(p_in IS NOT NULL AND p_cache IS NOT NULL AND p_out IS NOT NULL) THEN sum(round(eur, 3)) END, 2) AS eur FROM z GROUP BY month, model""",
    "cycle_phase": f"WITH {_MARKS} SELECT user_id, CAST(cycle AS BIGINT) AS cycle, start, closed, paused, phase FROM y",
    "cycle_expiry": f"WITH {_MARKS} SELECT user_id, CAST(cycle AS BIGINT) AS cycle, round(idle / 1e6 / 3600, 2) AS idle_hours, expired FROM y",
    "net_minutes": f"""WITH {_MARKS},
        t AS (SELECT *, lag(kind) OVER (PARTITION BY user_id, cycle ORDER BY event_id) AS was FROM k WHERE kind IN ('pause', 'resume')),
        u AS (SELECT * FROM t WHERE kind = 'pause' AND coalesce(was, 'resume') = 'resume' OR kind = 'resume' AND was = 'pause'),
        r AS (SELECT user_id, cycle, ts AS p, kind, lead(ts) OVER (PARTITION BY user_id, cycle ORDER BY event_id) AS r FROM u),
        o AS (SELECT y.user_id, y.cycle, sum(greatest(0, epoch_us(least(coalesce(r, TIMESTAMP '2024-01-31 00:00:00'), seal1)) - epoch_us(greatest(p, start)))) AS cut FROM y JOIN r ON r.user_id = y.user_id AND r.cycle = y.cycle AND r.kind = 'pause' WHERE seal1 IS NOT NULL GROUP BY ALL)
        SELECT y.user_id, CAST(y.cycle AS BIGINT) AS cycle, round((epoch_us(seal1) - epoch_us(start) - coalesce(cut, 0)) / 1e6 / 60, 1) AS minutes FROM y LEFT JOIN o ON o.user_id = y.user_id AND o.cycle = y.cycle WHERE seal1 IS NOT NULL""",
    "engine_gate": f"WITH {_MARKS}, g AS (SELECT phase, phase IN ('libre', 'f2', 'f4') AS free, user_id % 3 = 0 AS forced FROM y) SELECT phase, count(*) AS cycles, count(*) FILTER (free OR forced) AS allowed, count(*) FILTER (forced AND NOT free) AS violations FROM g GROUP BY phase",
    "call_cost": f"WITH {_COST} SELECT event_id, round(eur, 9) AS eur FROM z",
    "month_cost": f"WITH {_COST} SELECT month, command, {_SUMS} FROM z GROUP BY month, command",
    "cost_rollup": f"""WITH {_COST}, s AS (SELECT month, command, {_SUMS}, sum(coalesce(eur, 0)) AS raw FROM z GROUP BY ROLLUP (month, command))
        SELECT month, command, calls, tokens_in, tokens_out, eur, unpriced, CASE WHEN unpriced THEN NULL WHEN raw > 20 THEN 'over' WHEN raw > 16 THEN 'near' END AS alert FROM s""",
    "last4_vs_prev4": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
        SELECT o_custkey, round(avg(o_totalprice) FILTER (n <= 4), 4) AS recent, round(avg(o_totalprice) FILTER (n BETWEEN 5 AND 8), 4) AS earlier FROM r GROUP BY o_custkey""",
    "topic_recurrence": """WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), k AS (SELECT lower(trim(string_split(string_split(line, '|')[-1], ':')[1], ' ')) AS topic FROM l WHERE contains(line, '|') AND NOT regexp_matches(trim(line, ' '), '\\|$'))
        SELECT topic, count(*) AS n, count(*) >= 3 AS structural FROM k GROUP BY topic""",
    "spaced_repetition": """WITH a AS (SELECT user_id, event_type, arg_max(CAST(floor(value) AS INTEGER) % 4, event_id) AS level, arg_max(CAST(ts AS DATE), event_id) AS d FROM events GROUP BY ALL),
        b AS (SELECT *, date_diff('day', d, DATE '2024-01-31') AS days FROM a)
        SELECT user_id, event_type, level, days FROM b WHERE days >= CASE level WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 14 ELSE 30 END""",
    "progress_first_unread": "SELECT o_custkey, min(o_orderkey) FILTER (o_orderstatus = 'O') AS first_unread, count(*) FILTER (o_orderstatus <> 'O') AS n_read, count(*) AS total FROM orders GROUP BY o_custkey",
    "card_export_split": "SELECT p_partkey, p_name AS front, p_type || CASE WHEN p_brand = 'Brand#2' THEN ' VERIFICAR CON PAPER' ELSE '' END AS back, p_brand = 'Brand#2' AS held FROM part",
    "status_counts": "SELECT o_orderstatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM orders GROUP BY o_orderstatus",
    "stream_cost_window": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS calls, CAST(sum(CAST(floor(value * 1000) AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY ALL",
    "stream_cycle": f"""WITH {_MARKS}, q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cycle DESC) AS r FROM y), s AS (SELECT user_id, cycle, event_id FROM k WHERE kind = 'start')
        SELECT q.user_id, CAST(q.cycle AS BIGINT) AS cycle, s.event_id AS start_seq, closed, paused, seal1 IS NOT NULL AS seal1, attack IS NOT NULL AS attack, seal3 IS NOT NULL AS seal3,
        NOT closed AND NOT paused AND epoch_ms(last) + 20 * 3600000 < (SELECT epoch_ms(max(ts)) - 3600000 FROM m) AS expired FROM q JOIN s ON s.user_id = q.user_id AND s.cycle = q.cycle WHERE r = 1""",
    "closed_metrics": f"""WITH {_CLOSED}, ca AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS calls FROM events WHERE event_type = 'click' GROUP BY ALL)
        SELECT q.user_id, CAST(q.cycle AS BIGINT) AS cycle, CASE WHEN q.cycle % 3 = 1 THEN 2 ELSE a.n % 4 END AS match, a.errors, a.conjectures,
          CASE WHEN q.seal1 IS NOT NULL THEN round((epoch_us(q.seal1) - epoch_us(q.start) - coalesce((SELECT sum(greatest(0, epoch_us(least(coalesce(b.r, TIMESTAMP '2024-01-31 00:00:00'), q.seal1)) - epoch_us(greatest(b.p, q.start)))) FROM bk b WHERE b.user_id = q.user_id AND b.cycle = q.cycle), 0)) / 1e6 / 60, 1) END AS min_f1,
          CASE WHEN q.seal3 IS NOT NULL AND q.attack IS NOT NULL THEN round((epoch_us(q.seal3) - epoch_us(q.attack) - coalesce((SELECT sum(greatest(0, epoch_us(least(coalesce(b.r, TIMESTAMP '2024-01-31 00:00:00'), q.seal3)) - epoch_us(greatest(b.p, q.attack)))) FROM bk b WHERE b.user_id = q.user_id AND b.cycle = q.cycle), 0)) / 1e6 / 60, 1) END AS min_f3,
          coalesce(ca.calls, 0) AS calls_f2
        FROM ready q JOIN a ON a.user_id = q.user_id LEFT JOIN ca ON ca.user_id = q.user_id AND ca.day = CAST(q.start AS DATE)""",
    "closed_registers": f"""WITH {_CLOSED}, z AS (SELECT user_id, count(*) AS c FROM ready GROUP BY ALL)
        SELECT user_id, 'errors' AS register, c * errors AS rows, CAST(NULL AS BIGINT) AS last FROM z JOIN a USING (user_id) WHERE errors > 0 UNION ALL SELECT user_id, 'cards', c * cards, NULL FROM z JOIN a USING (user_id) WHERE cards > 0
        UNION ALL SELECT user_id, 'gaps', c * gaps, NULL FROM z JOIN a USING (user_id) WHERE gaps > 0 UNION ALL SELECT user_id, 'conjectures', c * conjectures, CASE WHEN gaps > 0 THEN user_id % 5 ELSE 0 END + c * conjectures FROM z JOIN a USING (user_id) WHERE conjectures > 0
        UNION ALL SELECT user_id, 'refused', count(*), NULL FROM y WHERE phase <> 'f4' OR cycle % 11 = 7 GROUP BY ALL""",
    "stream_threads": """WITH t AS (SELECT concat_ws('/', o_orderstatus, o_orderpriority) AS u, o_custkey AS thread, CAST(max(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))) AS BIGINT) AS used FROM orders GROUP BY ALL)
        SELECT u AS "user", thread, used FROM t QUALIFY row_number() OVER (PARTITION BY u ORDER BY used DESC, thread) <= 40""",
}
