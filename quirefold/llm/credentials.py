"""Secret scans by multipart credential linking.

A credential has parts: an identifier that says who asks for access, a secret, and an endpoint that it is for. Some
patterns are strong and count by themselves: assignments of secrets, access key ids and long hexadecimal strings.
Others are weak (a user name, a short password, an address) and are reported only where complementary parts stand
within SCOPE code points of them in the same text: an identifier beside a secret, a secret beside an identifier, an
endpoint beside both. Parts are joined as intervals, by equal text and stretches of BIN code points.

Spans are given as code points, the end excluded. A null text is like an empty one: no spans. Very long texts are
searched whole. Repeated rows get equal results, whatever their ids; equal texts are linked once. Other columns are kept, but for ``spans``, which is replaced.
An empty table gives an empty result. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm.shared import fresh_name, stored

SCOPE = 200
BIN = 400
PART = 512
#: Linked spans and texts that are sent to all tasks at most.
SENT = 1_000_000
KINDS = ["assign", "access", "hex", "id", "secret", "endpoint"]
STRONG = 3
#: Roles of the kinds: 0 identifier, 1 secret, 2 endpoint.
ROLE = {"assign": 1, "access": 0, "hex": 1, "id": 0, "secret": 1, "endpoint": 2}

# The patterns of the strong kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
# The patterns of the weak kinds.
ID = r"""(?i:(access_?key_?id|client_?id|account_?id|user_?id|user_?name|user|login|account))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})"""
SECRET = r"""(?i:(passphrase|passcode|passwd|password|pass|pwd|private_?key|access_?key|credential|auth|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=~!@#$%^&*-]{4,})"""
ENDPOINT = r"""(?i:https?|ftp|jdbc:[a-z]+|postgres|postgresql|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9_.:/@?&=%-]{3,}"""
EMPTY = "cast(array() as array<struct<start:bigint,kind:int,stop:bigint>>)"


def folded(items: Column, empty: Column, step) -> Column:
    """What step makes of items one by one, from (at, out) = (0, empty). Results grow a part at a time, so that long ones aren't copied for each item."""

    def part(state: Column, some: Column) -> Column:
        return F.aggregate(some, F.struct(state["at"].alias("at"), empty.alias("out")), step, lambda s: F.struct(s["at"].alias("at"), F.concat(state["out"], s["out"]).alias("out")))

    def all_parts(whole: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(whole), F.lit(1)) - 1) / PART).cast("int")), lambda i: F.slice(whole, i * PART + 1, PART))
        return F.aggregate(cut, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")), part)

    # as a variable, items is made once
    return F.transform(F.array(items), all_parts)[0]


def found(text: Column, pattern: str, kind: str, gate: Column, least: int = 0) -> Column:
    """Spans of the leftmost matches that don't overlap, as (start, kind, stop); those of a short second group dropped.

    A text falls into the matches and what lies between them, so the lengths of both give the places.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if least else matches
    between = F.split(text, pattern, -1)
    one = F.arrays_zip(F.transform(F.slice(between, 1, F.size(matches)), F.char_length).alias("gap"), F.transform(matches, F.char_length).alias("size"), F.transform(values, F.char_length).alias("value"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + x["size"]
        span = F.array(F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("stop")))
        spans = F.when(x["value"] >= least, F.concat(state["out"], span)).otherwise(state["out"]) if least else F.concat(state["out"], span)
        return F.struct(end.alias("at"), spans.alias("out"))

    return F.when(gate & text.rlike(pattern), folded(one, F.expr(EMPTY), step)["out"]).otherwise(F.expr(EMPTY))


def parts_of(text: Column) -> Column:
    """All strong and weak parts of a text. A cheap search for a character that each pattern needs comes first."""
    sign = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    always = F.lit(True)
    return F.concat(
        found(text, ASSIGN, "assign", sign, ASSIGN_LEAST),
        found(text, ACCESS, "access", F.contains(text, F.lit("AKIA"))),
        found(text, HEX, "hex", always),
        found(text, ID, "id", sign),
        found(text, SECRET, "secret", sign),
        found(text, ENDPOINT, "endpoint", F.contains(text, F.lit("://"))),
    )


def role(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(ROLE[k]) for k in KINDS]), kind + 1)


def linked(parts: DataFrame, key: str) -> DataFrame:
    """(key, more): the weak parts of each text that complementary ones are near to. parts: key, parts; a row a text.

    A part lies in each bin that it touches, and a scope in each that it reaches into; a pair counts in the first bin
    that both have.
    """
    one = parts.select(key, F.inline("parts")).withColumn("role", role(F.col("kind")))
    near = one.select(key, "role", F.col("start").alias("b"), F.col("stop").alias("e"), F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor((F.col("stop") - 1) / BIN))).alias("bin"))
    weak = one.where(F.col("kind") >= STRONG).withColumn("lo", F.greatest(F.col("start") - SCOPE, F.lit(0))).withColumn("hi", F.col("stop") + SCOPE)
    scopes = weak.select(key, F.col("role").alias("own"), "kind", "start", "stop", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / BIN), F.floor((F.col("hi") - 1) / BIN))).alias("bin"))
    pairs = scopes.join(near, [key, "bin"]).where((F.col("b") < F.col("hi")) & (F.col("e") > F.col("lo")) & (F.col("role") != F.col("own")) & ((F.col("e") <= F.col("start")) | (F.col("b") >= F.col("stop"))))
    has = lambda r: F.max((F.col("role") == r).cast("int")) == 1
    seen = pairs.groupBy(key, "own", "kind", "start", "stop").agg(has(0).alias("ids"), has(1).alias("secrets"))
    good = seen.where(F.expr("(own = 0 and secrets) or (own = 1 and ids) or (own = 2 and ids and secrets)"))
    return good.groupBy(key).agg(F.collect_list(F.struct("start", "kind", "stop")).alias("more"))


def scan(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """df with ``spans``: array of (start, kind, stop) by start, then kind; the strong parts and the linked weak ones.

    A weak part that lies within a strong one of the same role is that part again and isn't reported.
    """
    key, made, more_ = fresh_name(df, "text_key"), fresh_name(df, "parts_made"), fresh_name(df, "more_parts")
    whole = F.coalesce(F.col(text), F.lit(""))
    kept = [c for c in df.columns if c.lower() != "spans" and (keep_text or c != text)]
    docs = stored(df.select(*kept, F.md5(whole.cast("binary")).alias(key), parts_of(whole).alias(made)), "secrets")
    strong = F.filter(made, lambda p: p["kind"] < STRONG)
    again = lambda p: F.exists(strong, lambda q: (role(q["kind"]) == role(p["kind"])) & (q["start"] < p["stop"]) & (q["stop"] > p["start"]))
    usable = F.filter(made, lambda p: (p["kind"] < STRONG) | ~again(p))
    roles = lambda r: F.exists("parts", lambda p: role(p["kind"]) == r)
    # texts with an identifier, a secret and a weak part; each once
    texts = docs.where(F.size(made) > 1).select(key, usable.alias("parts")).where(roles(0) & roles(1) & F.exists("parts", lambda p: p["kind"] >= STRONG))
    more = stored(linked(texts.groupBy(key).agg(F.first("parts").alias("parts")), key).withColumnRenamed("more", more_), "secrets-linked")
    size = more.agg(F.coalesce(F.sum(F.size(more_) + 1), F.lit(0))).first()[0]
    spans = F.array_sort(F.concat(strong, F.coalesce(more_, F.expr(EMPTY)))).alias("spans")
    if size <= SENT:
        return docs.join(F.broadcast(more), key, "left").select(*kept, spans)
    # only texts with weak parts are moved
    weak = F.exists(made, lambda p: p["kind"] >= STRONG)
    return docs.where(weak).join(more, key, "left").select(*kept, spans).unionByName(docs.where(~weak).select(*kept, F.array_sort(strong).alias("spans")))


def as_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda p: F.concat_ws(":", F.element_at(names, p["kind"] + 1), p["start"].cast("string"), p["stop"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """text with each stretch of spans replaced by the name of the first one's kind in angle brackets."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])

    def step(state: Column, p: Column) -> Column:
        gap = F.substring(text, (state["at"] + 1).cast("int"), (p["start"] - state["at"]).cast("int"))
        out = F.when(p["start"] >= state["at"], F.concat(state["out"], gap, F.element_at(names, p["kind"] + 1))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], p["stop"]).alias("at"), out.alias("out"))

    rest = lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.lit((1 << 31) - 1)))
    done = F.transform(F.array(folded(spans, F.lit(""), step)), rest)[0]
    return F.when(F.size(spans) > 0, done).otherwise(text)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets in every document."""
    docs = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep_text=False)
    n = lambda k: F.size(F.filter("spans", lambda p: p["kind"] == k)).cast("long")
    base = F.filter("spans", lambda p: p["kind"] < STRONG)
    return docs.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(as_text(base).cast("binary"), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
