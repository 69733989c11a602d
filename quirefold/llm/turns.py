"""Repair of conversations by a parallel Viterbi pass over their turns, with rank convergence.

A conversation's role initials have to read ``(s?(ua)+)?``. Keep costs 0, Rerole (to user or assistant) 2, Delete 3, Insert
(an empty user or assistant turn, anywhere) 2; a truncated turn that isn't deleted adds 1; blank turns and those whose
role and text came before have to be deleted. Of the cheapest edits those whose initials are least in ASCII are made.

Turns are sorted by ranges of conversation and turn, so that a long conversation lies in several partitions; its part of
a partition is a chunk. Backwards through a chunk goes the vector of the least costs to the end, one for each state of
the roles. All chunks start at once, from the vector of a conversation's end, which is a guess but for the last. What
matters of a vector are differences: where the vector that the next chunk came to differs from the guess by more than a
constant, a fix-up pass runs the chunk from it until old and new vector differ by a constant only, beyond which the rest
stays. Passes end when no chunk needs one, after as many passes as a conversation has chunks at most. The stitched
vectors then say in each state which edit is the first of a cheapest rest; chunks find where they lead from each state,
which is put together for each conversation, and are traced from the state that they really begin in.

Order: by turn, null first; then role, text. Null role and text count as one space. An empty role has no right initial.
Conversations of a null id are one conversation. A text may be of any length. Repeated rows are duplicates of the first.
An empty table gives an empty result. Other columns are not used. The digest of a conversation is a chain over its text,
so one task makes it, turn by turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.llm.shared import map_batches, stored

# States: nothing yet, after a system turn, after a user's, after an assistant's. The costs.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Least costs of an end in each state.
END = (0, 2 * INSERT, INSERT, 0)
INITIALS = "sua?"
FAULTS = ("", "blank", "duplicate", "truncated")
LEGAL = {"su", "ua", "au"}
SPACE = r"\x20\x09-\x0D"
NULL = " "


def damaged(df: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with the damage that the hash of conversation and turn says; nulls of role and text as one space."""
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(NULL)).alias("role"), F.coalesce("text", F.lit(NULL)).alias("text"))
    said = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(NULL)) for c in ("conv_id", "turn")))
    rows = rows.withColumn("_d", F.crc32(said.cast("binary")) % 20).where("_d <> 0")
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_d") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("_d") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy")).drop("_copy")


def placed(rows: DataFrame, parts: int) -> DataFrame:
    """rows in order: (cid, mid, part, turn, role, text, code), mid ascending in the order of turns, part the chunk's partition.

    cid is conv_id as text, one space for null. code has the role's initial and the first fault. Rows that are the same
    are counted before they are sorted.
    """
    cid = F.coalesce(F.col("conv_id").cast("string"), F.lit(NULL))
    same = rows.groupBy(cid.alias("cid"), "turn", "role", "text").agg(F.count("*").cast("int").alias("n"))
    same = same.withColumn("h", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(1), "text"))
    key = ["cid", "role", "h", "h2"]
    first = same.groupBy(*key).agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
    found = same.join(first, key).select("cid", "turn", "role", "text", F.col("turn").eqNullSafe(F.col("first.turn")).alias("is_first"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    fault = F.when(~F.col("text").rlike(f"[^{SPACE}]"), 1).when(~F.col("is_first") | (F.col("k") > 1), 2).when(~F.col("text").rlike(rf"[.!?][{SPACE}]*\z"), 3).otherwise(0)
    initial = F.coalesce(F.nullif(F.instr(F.lit(INITIALS[:3]), F.substring("role", 1, 1)) * (F.length("role") > 0).cast("int"), F.lit(0)), F.lit(4)) - 1
    order = ["cid", F.col("turn").asc_nulls_first(), "role", "text", "k"]
    ordered = found.withColumn("code", (initial * 4 + fault).cast("int")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    mid = F.monotonically_increasing_id()
    return stored(ordered.select("cid", mid.alias("mid"), F.shiftright(mid, 33).cast("int").alias("part"), "turn", "role", "text", "code"), "turns")


Vector = tuple[int, int, int, int]
_made: dict[tuple[int, Vector], tuple[Vector, int]] = {}


def before(code: int, after: Vector) -> tuple[Vector, int]:
    """The vector before a turn from that after it, less its least cost, and that cost."""
    if (code, after) not in _made:
        fault, initial = code % 4, INITIALS[code // 4]
        cost = [DELETE + x for x in after]
        if fault not in (1, 2):
            more = TRUNCATED * (fault == 3)
            for symbol, own in [(initial, 0), ("u", REROLE), ("a", REROLE)]:
                for state, to in NEXT.get(symbol, {}).items():
                    cost[state] = min(cost[state], own + more + after[to])
        for _ in range(2):  # inserts before the turn, of which two can follow each other
            for symbol in "ua":
                for state, to in NEXT[symbol].items():
                    cost[state] = min(cost[state], INSERT + cost[to])
        least = min(cost)
        _made[code, after] = tuple(x - least for x in cost), least
    return _made[code, after]


def backward(codes: bytes, end: Vector) -> tuple[Vector, int]:
    """The vector at the beginning of a chunk, and what it is above."""
    total = 0
    for code in reversed(codes):
        end, least = before(code, end)
        total += least
    return end, total


def fixed_up(codes: bytes, old_end: Vector, old: Vector, total: int, end: Vector) -> tuple[Vector, int]:
    """``backward`` from another end, run only until both vectors differ by a constant."""
    a, b = old_end, end
    for code in reversed(codes):
        if a == b:
            return old, total
        a, x = before(code, a)
        b, y = before(code, b)
        total += y - x
    return b, total


def choice(state: int, code: int | None, here: Vector, after: Vector | None, least: int) -> tuple[str, int, bool]:
    """The first edit of the least cheapest rest: its letter, the state after it, and whether the turn is done.

    Letters: D, K, U and A (Rerole to user, to assistant), u and a (inserted); order of their initials in the audit:
    D, I, K, R. here and after are the vectors before and after the turn, here ``least`` above its own zero.
    """
    left = here[state] + least
    if code is not None and after[state] + DELETE == left:
        return "D", state, True
    for symbol in "ua":
        to = NEXT[symbol].get(state)
        if to is not None and here[to] + least + INSERT == left:
            return symbol, to, False
    more = TRUNCATED * (code % 4 == 3)
    to = NEXT.get(INITIALS[code // 4], {}).get(state)
    if to is not None and after[to] + more == left:
        return "K", to, True
    symbol = "u" if state in NEXT["u"] else "a"
    return symbol.upper(), NEXT[symbol][state], True


_steps: dict[tuple, tuple[str, int]] = {}


def step(state: int, code: int, here: Vector, after: Vector, least: int) -> tuple[str, int]:
    """All edits up to and with that of a turn, and the state after it."""
    key = (state, code, here, after, least)
    if key not in _steps:
        edits, done, at = "", False, state
        while not done:
            letter, at, done = choice(at, code, here, after, least)
            edits += letter
        _steps[key] = edits, at
    return _steps[key]


def traced(codes: bytes, end: Vector, state: int, last: bool) -> tuple[list[str], int]:
    """The edits at each turn of a chunk entered in a state, and the state at its end; the last chunk also closes the conversation."""
    vectors, leasts = [end], []
    for code in reversed(codes):
        v, least = before(code, vectors[-1])
        vectors.append(v)
        leasts.append(least)
    edits = []
    for i, code in enumerate(codes):
        made, state = step(state, code, vectors[-1 - i], vectors[-2 - i], leasts[-1 - i])
        edits.append(made)
    while last and END[state]:
        letter, state, _ = choice(state, None, END, None, 0)
        edits[-1] += letter
    return edits, state


CHUNK = "cid string, part int, mids array<long>, codes binary, used array<int>, start array<int>, total long"


def speculative(chunks: DataFrame) -> DataFrame:
    def run(batches: Iterable[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            made = [backward(c, END) for c in b["codes"]]
            yield b | {"used": [list(END)] * len(made), "start": [list(v) for v, _ in made], "total": [t for _, t in made]}

    return stored(map_batches(chunks, run, CHUNK), "chunks")


def converged(chunks: DataFrame) -> DataFrame:
    """Chunks whose vectors follow from those of the chunk after them."""
    w = Window.partitionBy("cid").orderBy("part")  # as many rows as a conversation has chunks, one a partition at most

    def run(batches: Iterable[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            made = [fixed_up(c, tuple(u), tuple(v), t, tuple(x)) for c, u, v, t, x in zip(b["codes"], b["used"], b["start"], b["total"], b["want"])]
            yield {c: b[c] for c in ("cid", "part", "mids", "codes")} | {"used": b["want"], "start": [list(v) for v, _ in made], "total": [t for _, t in made]}

    while True:
        wanted = chunks.withColumn("want", F.coalesce(F.lead("start").over(w), F.array(*map(F.lit, END))))
        if wanted.where(F.col("want") != F.col("used")).isEmpty():
            return chunks
        chunks = stored(map_batches(wanted, run, CHUNK), "chunks")


def entered(chunks: DataFrame) -> DataFrame:
    """chunks with the state in which each is entered, and whether it is its conversation's last."""
    w = Window.partitionBy("cid").orderBy("part")
    known = chunks.withColumn("last", F.lead("part").over(w).isNull()).withColumn("only", F.col("last") & F.lag("part").over(w).isNull())

    def run(batches: Iterable[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            yield {"cid": b["cid"], "part": b["part"], "ends": [[traced(c, tuple(u), s, False)[1] for s in range(4)] for c, u in zip(b["codes"], b["used"])]}

    leads = map_batches(known.where("not only").select("cid", "part", "codes", "used"), run, "cid string, part int, ends array<int>")
    # the states at the ends of a conversation's chunks, one after the other
    each = leads.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("part", "ends"))).alias("of"))
    states = F.aggregate("of", F.array(F.lit(NOTHING)), lambda s, x: F.concat(s, F.array(F.get(x["ends"], F.element_at(s, -1)))))
    starts = each.select("cid", F.explode(F.arrays_zip(F.col("of.part").alias("part"), F.slice(states, 1, F.size("of")).alias("state"))).alias("x")).select("cid", "x.part", "x.state")
    return known.drop("only").join(starts, ["cid", "part"], "left").withColumn("state", F.coalesce("state", F.lit(NOTHING)))


def audited(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``placed`` rows: (mid, edits) for each, and (cid, blank, duplicate, truncated, illegal, cost, audit) for each conversation."""
    each = rows.groupBy("cid", "part").agg(F.array_sort(F.collect_list(F.struct("mid", "code"))).alias("x"))
    codes = F.unhex(F.array_join(F.transform("x.code", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    chunks = converged(speculative(each.select("cid", "part", F.col("x.mid").alias("mids"), codes.alias("codes"))))

    def run(batches: Iterable[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            edits = [traced(c, tuple(u), s, last)[0] for c, u, s, last in zip(b["codes"], b["used"], b["state"], b["last"])]
            roles = ["".join(INITIALS[x // 4] for x in c) for c in b["codes"]]
            counts = {name: [sum(x % 4 == k for x in c) for c in b["codes"]] for k, name in enumerate(FAULTS) if k}
            audit = ["".join("I" if x in "ua" else "R" if x in "UA" else x for x in "".join(e)) for e in edits]
            yield {c: b[c] for c in ("cid", "part", "mids", "start", "total")} | counts | {"edits": edits, "audit": audit, "ends": [r[0] + r[-1] for r in roles], "illegal": [sum(x + y not in LEGAL for x, y in zip(r, r[1:])) for r in roles]}

    kind = "cid string, part int, mids array<long>, start array<int>, total long, blank long, duplicate long, truncated long, edits array<string>, audit string, ends string, illegal long"
    made = stored(map_batches(entered(chunks).select("cid", "part", "mids", "codes", "used", "start", "total", "state", "last"), run, kind), "edits")
    edits = made.select(F.explode(F.arrays_zip("mids", "edits")).alias("x")).select(F.col("x.mids").alias("mid"), "x.edits")
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "total")]
    report = made.groupBy("cid").agg(*sums, F.min_by("start", "part").alias("start"), F.array_sort(F.collect_list(F.struct("part", "ends", "audit"))).alias("x"))
    between = F.zip_with(F.slice("x.ends", 1, F.size("x") - 1), F.slice("x.ends", 2, F.size("x")), lambda a, b: F.concat(F.substring(a, 2, 1), F.substring(b, 1, 1)))
    illegal = F.col("illegal") + F.size(F.filter(between, lambda p: ~p.isin(*LEGAL)))
    cost = F.col("total") + F.get("start", F.lit(NOTHING))
    return edits, report.select("cid", "blank", "duplicate", "truncated", illegal.alias("illegal"), cost.alias("cost"), F.array_join("x.audit", "").alias("audit"))


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(cid, mid, k, role, text): the turns of the repaired conversations, in the order of mid and k."""
    each = rows.join(edits, "mid").select("cid", "mid", "role", "text", F.posexplode(F.split("edits", "")).alias("k", "edit")).where("edit not in ('D', '')")
    role = F.when(F.upper("edit") == "U", "user").when(F.upper("edit") == "A", "assistant").otherwise(F.col("role"))
    return each.select("cid", "mid", "k", role.alias("role"), F.when(F.col("edit").isin("u", "a"), "").otherwise(F.col("text")).alias("text"))


def digests(turns: DataFrame) -> DataFrame:
    """(cid, repaired_sha256) of turns as ``repaired`` gives them, a turn at a time."""

    def run(batches: Iterable[dict[str, list]]) -> Iterator[dict[str, list]]:
        now, made = None, None
        for b in batches:
            out: dict[str, list] = {"cid": [], "repaired_sha256": []}
            for cid, role, text in zip(b["cid"], b["role"], b["text"]):
                if cid != now:
                    if now is not None:
                        out["cid"].append(now)
                        out["repaired_sha256"].append(made.hexdigest())
                    now, made = cid, hashlib.sha256()
                else:
                    made.update(b"\n")
                made.update(f"{role}:{text}".encode())
            yield out
        if now is not None:
            yield {"cid": [now], "repaired_sha256": [made.hexdigest()]}

    return map_batches(turns.repartition("cid").sortWithinPartitions("cid", "mid", "k").select("cid", "role", "text"), run, "cid string, repaired_sha256 string")


def repair_report(df: DataFrame, rows: DataFrame, parts: int | None = None) -> DataFrame:
    """For each conv_id of df the faults of its rows, the cost and audit of their repair, and the digest of the result."""
    spark = df.sparkSession
    turns = placed(rows, parts or int(spark.conf.get("spark.sql.shuffle.partitions")))
    edits, report = audited(turns)
    hashed = digests(repaired(turns, edits))
    gaps = turns.groupBy("cid").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    all_ids = df.select(F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit(NULL)).alias("cid")).distinct()
    out = all_ids.join(gaps, "cid", "left").join(report, "cid", "left").join(hashed, "cid", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.nullif("cid", F.lit(NULL)).cast("long").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage to and repair of all conversations."""
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair_report(df, damaged(df))
