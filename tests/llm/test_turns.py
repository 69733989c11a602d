import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from quirefold.llm import turns

ROLES = ["system", "user", "assistant", "tool", "", None]
TEXTS = ["Fine.", "What?", "cut off", "", " \n", None, "Yes! \t", "long " * 2000 + "end.", "no end here", "a.b"]


def rows_of(n, seed, conv=None):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        c = conv if conv is not None else rng.choice([1, 2, 3, 4, 5, 60, 61, 62, None])
        out.append((c, rng.choice([None, *range(12)]), rng.choices(ROLES, [1, 6, 6, 1, 1, 1])[0], rng.choice(TEXTS) if rng.random() < 0.5 else f"line {rng.random()}."))
    return out


def damage(rows):
    out = []
    for c, t, role, text in rows:
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(c, t, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def cheapest(rows):
    """The cheapest edits by Dijkstra over (cost, audit): every edit string in the order of cost, then ASCII."""
    n = len(rows)
    heap = [(0, "", 0, "", ())]
    seen = set()
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        state = (i, roles[-1:], len(roles) > 0)
        if (state, "done") in seen:
            continue
        seen.add((state, "done"))
        if i == n and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, out
        nexts = []
        if i < n:
            fault, role, text = rows[i]
            nexts.append((3, "D", i + 1, roles, out))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                nexts.append((more, "K", i + 1, roles + (role[:1] or "?"), (*out, f"{role}:{text}")))
                nexts += [(2 + more, "R", i + 1, roles + r[0], (*out, f"{r}:{text}")) for r in ("user", "assistant")]
        nexts += [(2, "I", i, roles + r[0], (*out, f"{r}:")) for r in ("user", "assistant")]
        for c, letter, j, r, o in nexts:
            if re.fullmatch("s?(ua)*u?", r):
                heapq.heappush(heap, (cost + c, audit + letter, j, {"a": "ua", "u": "u", "s": "s", "": ""}[r[-1:]], o))  # one of the same state
    raise AssertionError


def plain(rows):
    by = defaultdict(list)
    for r in damage(rows):
        by[r[0]].append(r)
    out = []
    for c in {r[0] for r in rows}:
        own = sorted(by[c], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        known = [r[1] for r in own if r[1] is not None]
        seen, faults = set(), []
        for _, _, role, text in own:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [(r[2][:1] or "?") for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, made = cheapest([(f, r[2], r[3]) for f, r in zip(faults, own)])
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out.append((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()))
    return sorted(out, key=repr)


def compared(spark, rows, parts):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id long, turn long, role string, text string, Cid int, Part string")
    got = turns.repair_report(df, turns.damaged(df), parts).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows)


@pytest.mark.parametrize(("n", "seed", "parts"), [(150, 1, 2), (150, 2, 7), (40, 3, 5)])
def test_by_all_edits(spark, n, seed, parts):
    compared(spark, rows_of(n, seed), parts)


def test_one_conversation_over_many_partitions(spark):
    compared(spark, [(7, t, "user", f"line {t}.") for t in range(60)], 6)  # alternating vectors: passes go on to the first chunk
    compared(spark, rows_of(120, 5, conv=8), 9)
    compared(spark, [(7, t, "user", " ") for t in range(40)] + [(7, 50, "system", "You are.")], 6)


def test_empty_and_dropped(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turns.repair_report(df, turns.damaged(df)).count() == 0
    gone = next((c, t) for c in range(100) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    compared(spark, [(*gone, "user", "Hello there.")], 2)
