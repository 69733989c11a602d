"""Analytics over append-only registries: cost, recurrence, spaced repetition, trends, cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions.text import topic

# Days until a block is tried again, by the level of its last attempt.
AGAIN = {0: 3, 1: 3, 2: 14, 3: 30}
STRUCTURAL = 3


def cost(calls: DataFrame, prices: DataFrame, fx: float) -> DataFrame:
    """calls (model, tokens_in, tokens_out, tokens_cache) with ``eur``: cached input at its own price; null without a price.

    prices: model, p_in, p_cache, p_out in USD a million tokens; a list of models, sent to all tasks.
    """
    cache = F.least(F.coalesce("tokens_cache", F.lit(0)), F.col("tokens_in"))
    usd = ((F.col("tokens_in") - cache) * F.col("p_in") + cache * F.coalesce("p_cache", "p_in") + F.col("tokens_out") * F.col("p_out")) / 1e6
    priced = calls.join(F.broadcast(prices), "model", "left")
    known = F.col("p_in").isNotNull() & F.col("p_out").isNotNull()
    return priced.withColumn("eur", F.when(known, usd * fx)).withColumn("all_prices", known & F.col("p_cache").isNotNull()).drop("p_in", "p_cache", "p_out")


def transcription_costs(costs: DataFrame, *keys: str) -> DataFrame:
    """Pages, tokens, seconds, cut pages and euros by keys; euros of three digits a page, none unless all three prices are known."""
    eur = F.when(F.bool_and("all_prices"), F.sum(F.round("eur", 3)))
    return costs.groupBy(*keys).agg(F.count("*").alias("pages"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("seconds").alias("seconds"), F.count_if("cut").alias("cut"), eur.alias("eur"))


def cost_by(costs: DataFrame, *keys: str) -> DataFrame:
    """Calls, tokens, euros and whether a price is missing, by keys."""
    return costs.groupBy(*keys).agg(*cost_sums())


def cost_sums() -> list[Column]:
    return [F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum(F.coalesce("eur", F.lit(0.0))).alias("eur"), F.bool_or(F.col("eur").isNull()).alias("unpriced")]


def budget_alert(eur: Column, unpriced: Column, budget: float) -> Column:
    """'over' above the budget, 'near' above four fifths of it; nothing while a price is missing."""
    return F.when(unpriced, None).when(eur > budget, "over").when(eur > 0.8 * budget, "near")


def recurrence(lines: DataFrame, line: str = "line", least: int = STRUCTURAL) -> DataFrame:
    """(topic, n, structural) of gap lines."""
    counted = lines.select(topic(F.col(line)).alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))
    return counted.withColumn("structural", F.col("n") >= least)


def due(attempts: DataFrame, keys: list[str], today: Column) -> DataFrame:
    """The last attempt (date, level; in order of seq) of each block whose interval is over."""
    last = attempts.groupBy(*keys).agg(F.max_by(F.struct("date", "level"), "seq").alias("x")).select(*keys, "x.date", "x.level")
    wait = F.lit(AGAIN[3])
    for level in (2, 1, 0):
        wait = F.when(F.col("level") == level, AGAIN[level]).otherwise(wait)
    return last.withColumn("days", F.date_diff(today, "date")).where(F.col("days") >= wait)


def trend(rows: DataFrame, keys: list[str], order: list[str], value: str, n: int = 4) -> DataFrame:
    """(keys, recent, earlier): means of the last n rows and of the n before them, by key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    near = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 2 * n)
    return near.groupBy(*keys).agg(F.avg(F.when(F.col("_r") <= n, F.col(value))).alias("recent"), F.avg(F.when(F.col("_r") > n, F.col(value))).alias("earlier"))


def progress(rows: DataFrame, keys: list[str], order: str, read: Column) -> DataFrame:
    """(keys, first_unread, n_read, total) of an ordered reading list."""
    return rows.groupBy(*keys).agg(F.min(F.when(~read, F.col(order))).alias("first_unread"), F.count_if(read).alias("n_read"), F.count("*").alias("total"))


def cards(lines: DataFrame, line: str, hold: str = "VERIFICAR CON PAPER") -> DataFrame:
    """lines that are cards (front :: back) with ``front``, ``back`` and ``held`` (to be verified before they are exported)."""
    text = F.regexp_replace(F.trim(F.col(line)), r"^- ", "")
    at = F.locate("::", text)
    cut = lines.where(at > 0).withColumn("front", F.trim(F.substring(text, F.lit(1), at - 1))).withColumn("back", F.trim(F.substring(text, at + 2, F.length(text))))
    return cut.where("front <> '' and back <> ''").withColumn("held", F.contains(F.col(line), F.lit(hold)))


def new_attempts(stored: DataFrame, more: DataFrame) -> DataFrame:
    """Those of ``more`` (rid, date, session, level) that aren't stored yet, each once, levels within 0..3."""
    once = more.groupBy("rid", "date", "session").agg(*[F.max(c).alias(c) for c in more.columns if c not in ("rid", "date", "session")]).select(*more.columns)
    return once.join(stored, ["rid", "date", "session"], "left_anti").withColumn("level", F.least(F.greatest("level", F.lit(0)), F.lit(3)))


def next_number(used: DataFrame, number: str = "number") -> DataFrame:
    """(next): the least number from 1 on that isn't used."""
    mine = used.select(F.col(number).cast("long").alias("n")).distinct()
    after = mine.select((F.col("n") + 1).alias("n")).where("n >= 1").unionByName(mine.sparkSession.range(1, 2).select(F.col("id").alias("n")))
    return after.join(mine, "n", "left_anti").agg(F.min("n").alias("next"))


def renamed(rows: DataFrame, names: DataFrame, key: str = "doc") -> DataFrame:
    """rows with keys by the rename log (old, new); fails if a new name is taken or an old one isn't there."""
    if not names.join(rows.select(F.col(key).alias("old")), "old", "left_anti").isEmpty():
        raise ValueError("an old name isn't there")
    taken = rows.join(names.select(F.col("new").alias(key)), key, "left_semi").join(names.select(F.col("old").alias(key)), key, "left_anti").limit(1)
    if taken.count():
        raise ValueError("a new name is in use")
    return rows.join(names, F.col(key) == F.col("old"), "left").withColumn(key, F.coalesce("new", key)).drop("old", "new")


def upserted(stored: DataFrame, new: DataFrame, key: str, manual: list[str]) -> DataFrame:
    """stored with the rows of new: manual fields keep their stored value where there is one, others take the new one."""
    a, b = stored.alias("a"), new.alias("b")
    cols = [F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) if c in manual else F.when(F.col(f"b.{key}").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in stored.columns if c != key]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *cols)
