import hashlib
import random

import numpy as np
import pytest

from quirefold.llm import suffixes


def plain(rows):
    """Every passage of 100 bytes in the order of documents."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        t = (text or "").encode()
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 99):
            if (s := t[i : i + 100]) in seen:
                gone[i : i + 100] = True
            seen.add(s)
        edges = np.flatnonzero(np.diff(gone.astype(int), prepend=0) == 1)
        out.append((doc_id, len(t), int(gone.sum()), len(edges), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, **args):
    df = spark.createDataFrame([(*r, 7, "x", 1, 2) for r in rows], "doc_id long, text string, D int, Kept string, Anchor int, bytes int")
    return sorted((tuple(r) for r in suffixes.removal_report(df, **args).collect()), key=repr)


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß世") for _ in range(rng.randint(1, 9)))
    some = lambda k: " ".join(word() for _ in range(k))
    passage, line = some(60), some(12)
    rows = [(None, some(40)), (3, ""), (4, None), (5, "ab" * 4000), (6, "x" * 250), (7, "x" * 99)]
    for i in range(10, 10 + n):
        kind = rng.randrange(6)
        text = some(rng.randint(5, 120))
        if kind == 1:
            text = some(5) + passage[rng.randrange(20) :] + some(9)
        elif kind == 2:
            text = f"{some(3)} {line} {some(30)}"
        elif kind == 3 and len(rows) > 8:
            old = list(rows[-1][1] or "")
            for _ in range(3):
                if old:
                    old[rng.randrange(len(old))] = "!"
            text = "".join(old)
        elif kind == 4 and len(rows) > 8:
            text = rows[rng.randrange(len(rows))][1] or ""
        rows.append((i, text + (f"\n{text}" if rng.random() < 0.1 else "")))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "args"), [(1, {}), (2, {"hot": 3, "bucket": 2000}), (3, {"hot": 1, "batches": 7, "bucket": 500})])
def test_by_all_passages(spark, seed, args):
    rows = corpus(seed)
    assert found(spark, rows, **args) == plain(rows)


def test_repeated_rows_and_ids(spark):
    rows = [(1, "word " * 60), (1, "word " * 60), (2, "other " * 5), (2, "other " * 5)]
    got = found(spark, rows)
    assert got == plain(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.removal_report(df).count() == 0


def test_units_cover_all_suffixes_and_very_long_texts(monkeypatch):
    data = np.frombuffer(random.Random(1).randbytes(5000), np.uint8)
    whole = suffixes.units(data)
    assert whole[0][0] == 0 and (whole[0][1:] == (whole[0] + whole[1])[:-1]).all() and whole[0][-1] + whole[1][-1] == 5000 - 99
    monkeypatch.setattr(suffixes, "STRETCH", 700)
    cut = suffixes.units(data)
    assert set(zip(cut[0] + cut[2], cut[0] // 700)) >= set(zip(whole[0] + whole[2], whole[0] // 700))


def test_operator_gives_spans_and_bytes(spark):
    text = "".join(random.Random(2).choices("abcdefgh ", k=300))
    df = spark.createDataFrame([(1, text), (2, "new|" + text[50:250] + "|end")], "doc_id long, text string")
    got = {r.doc_id: r for r in suffixes.without_repeats(df).collect()}
    assert got[1].kept.decode() == text and [tuple(s) for s in got[2].spans] == [(4, 204)] and got[2].kept == b"new||end"
