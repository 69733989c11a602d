import hashlib

import numpy as np

from quirefold.llm import fingerprint as fp


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def sketch(text, k=fp.K):
    return fp.sketch(fp.shingle_hashes(fp.WordHashes().of(text.split())), k)


def test_sketches_merge():
    a, b = " ".join(f"w{i}" for i in range(900)), " ".join(f"w{i}" for i in range(600, 1500))
    x, y = sketch(a), sketch(b)
    whole = np.unique(np.concatenate([fp.shingle_hashes(fp.WordHashes().of(t.split())) for t in (a, b)]))[: fp.K]
    assert fp.merge(x, y).tolist() == whole.tolist()
    assert abs(fp.resemblance(x, y) - len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))) < 0.15
    assert abs(fp.distinct(x) / 896 - 1) < 0.3 and fp.distinct(sketch("a b c d e f")) == 2
    assert abs(fp.containment(x, y) - 296 / 896) < 0.2 and fp.from_text(fp.as_text(x)).tolist() == x.tolist()


def test_repeats_don_t_hide_shingles():
    text = "a b c d e " * 400 + " ".join(f"w{i}" for i in range(300))
    assert sketch(text).tolist() == np.unique(fp.shingle_hashes(fp.WordHashes().of(text.split())))[: fp.K].tolist()


def test_edges(docs, nothing):
    rows = fp.fingerprints(docs).collect()
    assert {r.fingerprint for r in rows if not (r.text or "").split()} == {""}
    assert len({r.fingerprint for r in rows if r.doc_id in (1, 2)}) == 1
    made = fp.edited_fingerprints(docs).collect()
    assert len(made) == len(rows) and fp.edited_fingerprints(nothing).count() == 0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in made)


def test_parts_are_the_whole(monkeypatch):
    rng = np.random.default_rng(2)
    words = fp.WordHashes().of([f"w{i}" for i in rng.integers(0, 200, 1000)])
    whole = np.unique(fp.shingle_hashes(words))[: fp.K].tolist()
    for n in (5, 6, 17, 300, 999, 1000):
        monkeypatch.setattr(fp, "STRETCH", n)
        assert fp.sketch_of(words).tolist() == whole


def plain(text):
    """The K least hashes of a text's shingles, and all of them, by plain sets."""
    h = fp.WordHashes()
    return sorted({int(fp.shingle_hashes(h.of(list(s)))[0]) for s in shingles(text)})


def plain_likeness(a, b):
    least = sorted(set(a) | set(b))[: fp.K]
    return len(set(least) & set(a) & set(b)) / len(least) if least else 1.0


def test_query(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in fp.op8_fingerprints(spark, sf).collect()}
    assert len(got) == len(d)
    for i, x in enumerate(d):
        u, n = d[(i + 1) % len(d)].text, len(x.text)
        e = x.text[: n - n // 2] + u[: n // 2]
        r = got[x.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(e.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fp.as_text(sketch(x.text)), fp.as_text(sketch(e)))
        p, q, v = plain(x.text), plain(e), plain(u)
        assert r.fingerprint == "".join(f"{h:016x}" for h in p[: fp.K])
        assert abs(r.near_edited - plain_likeness(p, q)) < 1e-9 and abs(r.near_next - plain_likeness(p, v)) < 1e-9
        assert (len(p) >= fp.K) or r.n_shingles == len(p)
        a, b = shingles(x.text), shingles(e)
        assert abs(r.near_edited - len(a & b) / len(a | b)) < 0.25
