import hashlib
import random
import re
import zlib

import numpy as np

from quirefold.llm import runs


def plain(w):
    """All runs by their definition: every period, every stretch."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                s = w[i : i + length]
                if all(any(s[t] != s[t + p] for t in range(length - p)) for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_by_definition():
    rng = random.Random(3)
    for _ in range(1500):
        w = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 50))]
        if len(w) > 8 and rng.random() < 0.5:
            a, p = rng.randrange(4), rng.randint(1, len(w) // 4)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        assert runs.runs(np.array(w, np.int64)) == plain(w), w


def test_long_texts_of_one_word_and_of_long_periods():
    assert runs.runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    assert runs.runs(np.arange(200_000) % 9_999) == [(0, 200_000, 9_999)]
    assert runs.runs(np.arange(5)) == []
    nested = np.array(([0] * 7 + [1]) * 5)
    assert runs.runs(nested) == plain(nested.tolist())


def test_query_by_definition(docs, nothing):
    got = sorted((tuple(r) for r in runs.run_digests(docs).collect()), key=repr)
    want = []
    for doc_id, text in ((r.doc_id, r.text) for r in docs.collect()):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if len(w) > 1000:
            continue
        h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        found = plain(w)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        best = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else None
        first = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((doc_id, len(found), *first, digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), digest(" ".join(x for i, x in enumerate(w) if i not in gone))))
    assert [r for r in got if r[0] != 9] == sorted(want, key=repr)
    assert [r[1:5] for r in got if r[0] == 9] == [(1, 0, 30_000, 1)]
    assert runs.run_digests(nothing).count() == 0


def test_operator_keeps_texts_and_columns(docs, nothing):
    found = {(r.doc_id, r.start, r.length, r.period) for r in runs.periodic_runs(docs).collect()}
    assert found == {(9, 0, 30_000, 1)}
    out = runs.without_repeats(docs)
    assert out.columns == docs.columns
    texts = {(r.doc_id, r.text) for r in out.collect()}
    assert (9, "word") in texts and (4, None) in texts and (6, " \n\t ") in texts and len(texts) == 10
    assert runs.without_repeats(nothing).count() == 0
