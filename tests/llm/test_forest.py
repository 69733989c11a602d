import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.llm import forest


def brute(rows, cosine=0.95):
    """{id: (links, component)} of rows (id, vector)."""
    good = []
    for i, (_, v) in enumerate(rows):
        x = None if v is None or any(c is None for c in v) else np.array(v, float)
        if x is not None and len(x) and np.isfinite(x).all() and x.any():
            good.append((i, x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max())))
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(good)):
        for b in range(a):
            (i, x), (j, y) = good[a], good[b]
            if len(x) == len(y) and (x @ y >= cosine or np.array_equal(x, y)):
                links[i] += 1
                links[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    comp = {}
    for i, (d, _) in enumerate(rows):
        comp.setdefault(root(i), []).append(d)
    return [(links[i], min(comp[root(i)])) for i in range(len(rows))]


def clusters(n=160, size=24):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(n):
        c = rng.standard_normal(size)
        rows += [(c + rng.standard_normal(size) * rng.choice([0.05, 0.2, 0.28])).astype(np.float32).tolist() for _ in range(rng.integers(1, 6))]
    rows += [rows[0]] * 7
    return [(i * 3, v) for i, v in enumerate(rows)]


@pytest.mark.parametrize("leaf", [10_000, 60])
def test_links(spark, leaf):
    rows = clusters()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in forest.near_vectors(df, leaf=leaf, sample=300).collect()}
    want = dict(zip((d for d, _ in rows), brute(rows)))
    if leaf > len(rows):
        assert got == want  # one leaf holds all
    else:
        found, all_ = sum(x[0] for x in got.values()), sum(x[0] for x in want.values())
        assert 0.97 * all_ <= found <= all_ and all(got[d][0] <= want[d][0] for d in got)


@pytest.mark.parametrize(("n", "spread", "cell"), [(4000, 0.033, 700), (4000, 0.05, 4096), (2500, 0.02, 900)])
def test_dense_cluster(spark, monkeypatch, n, spread, cell):
    """Most vectors near each other: mean cosines around 0.935, 0.86 and 0.975, many more than a leaf holds."""
    monkeypatch.setattr(forest, "CELL", cell)
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(64)
    v = np.vstack([centre / np.linalg.norm(centre) + spread * rng.standard_normal((n, 64)), rng.standard_normal((500, 64))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in forest.near_vectors(df, leaf=300, sample=3000).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(1) - 1
    found = np.array([got[i] for i in range(len(v))])
    assert (found <= want).all() and found.sum() >= 0.98 * want.sum(), found.sum() / want.sum()


def test_edges(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, v), (2, v), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 2.0]), (7, [1.0, float("nan"), 2.0]), (8, [1.0, float("inf"), 2.0]), (9, [1e-30, 2e-30, 3e-30]), (10, [-1.0, -2.0, -3.0]), (None, v), (11, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n", F.lit(3)).withColumn("unit", F.lit("x"))
    got = {}
    for r in forest.near_vectors(df).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert got[1] == [(4, 1, True)] and got[2] == [(4, 1, False)] * 2 and got[None] == [(4, None, False)] and got[9] == [(4, 1, False)]
    assert all(got[i] == [(0, i, True)] for i in (3, 4, 5, 6, 7, 8, 10, 11))
    assert forest.near_vectors(df.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {x: x for e in edges for x in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.component for r in forest.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == root(x) for x in parent)


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in forest.op7_embeddings(spark, sf).collect()}
    assert got == dict(zip((d for d, _ in rows), brute(rows)))
