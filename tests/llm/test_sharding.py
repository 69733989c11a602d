import zlib
from collections import defaultdict

import numpy as np

from quirefold.llm import sharding


def test_packed_balances_all():
    rng = np.random.default_rng(4)
    size = np.column_stack([rng.integers(1, 4000, 3000), rng.integers(1, 800, 3000), np.ones(3000)]).astype(float)
    sums = np.zeros((16, 3))
    np.add.at(sums, sharding.packed(size, 16), size)
    assert (sums.max(0) / sums.mean(0) < [1.01, 1.05, 1.05]).all()


def test_packed_is_the_plain_loop():
    rng = np.random.default_rng(5)
    size = np.column_stack([rng.integers(1, 24, 300), rng.integers(0, 8, 300), rng.integers(1, 3, 300)]).astype(float)
    # with totals that are powers of two all sums are exact
    size = np.vstack([size, 4096 - size.sum(0)])
    total = [sum(x[d] for x in size) for d in range(3)]
    items = sorted(((tuple(x[d] / total[d] for d in range(3)), i) for i, x in enumerate(size.tolist())), key=lambda x: (-max(x[0]), x[1]))
    left, want = [[1 / 8] * 3 for _ in range(8)], {}
    for share, i in items:
        dots = [sum(a * b for a, b in zip(bin_, share)) for bin_ in left]
        want[i] = best = dots.index(max(dots))
        left[best] = [a - b for a, b in zip(left[best], share)]
    got = sharding.packed(size, 8).tolist()
    assert all(got[i] == want[i] for i in want)


def check(rows, shards):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values()) and set(by) <= set(range(shards))
    return [sum(r.size for r in by[s]) for s in range(shards)]


def test_cells_and_hot_group(spark):
    rows = [(i, "hot text of some words") for i in range(700)] + [(700 + i, f"text number {i} " + "x" * (i * 7 % 300)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = sharding.sharded(df, shards=4, cell=40).collect()
    sizes = check(made, 4)
    assert len(made) == len(rows) and max(sizes) / min(sizes) < 1.06
    whole = sharding.sharded(df.where("doc_id >= 690"), shards=4).collect()
    assert len({r.shard for r in whole if r.doc_id < 700}) == 1  # a group that isn't hot stays together


def test_edges(docs, nothing):
    rows = sharding.sharded(docs).collect()
    assert len(rows) == docs.count() and sharding.sharded(nothing).count() == 0
    check(rows, 16)
    assert sorted(r.size for r in rows if r.doc_id in (4, 5)) == [1, 1] and {r.text_crc32 for r in rows if r.doc_id in (4, 5)} == {0} and rows[0].H == 7


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = sharding.op10_sharding(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    sizes = check(rows, 16)
    assert max(sizes) - min(sizes) <= max(0.03 * sum(sizes) / 16, max(r.size for r in rows))
