import re

from pyspark.sql import functions as F

from quirefold.llm import mixing

RUN = re.compile(r"[^\x20\x09-\x0D]+")


def water(sizes, weights, epochs=3):
    """Targets by sharing the excess again until none is above."""
    limit, target, free = [epochs * s for s in sizes], [0.0] * len(sizes), set(range(len(sizes)))
    left = float(sum(sizes))
    while free:
        share = left / sum(weights[i] for i in free)
        over = [i for i in free if share * weights[i] > limit[i]]
        if not over:
            for i in free:
                target[i] = share * weights[i]
            return target
        for i in over:
            target[i] = float(limit[i])
            left -= limit[i]
            free.remove(i)
    return target


def test_targets(spark):
    sizes = [10, 1000, 0, 3, 500, 70, 2]
    rows = [(f"s{i}", s) for i, s in enumerate(sizes)]
    made = mixing.targets(mixing.weighed(spark.createDataFrame(rows, "source string, size long"))).orderBy("source").collect()
    want = water(sizes, [i % 3 + 1 for i in range(len(sizes))])
    assert all(abs(r.target - t) < 1e-9 * max(1, t) for r, t in zip(made, want)) and abs(sum(want) - sum(sizes)) < 1e-6


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        df = spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n), [F.lit(3)]).alias("to"))
        rows = df.select("id", "to", mixing.permuted(F.col("to"), F.lit(n), [F.lit(3)], backwards=True).alias("back")).collect()
        assert sorted(r.to for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)
    assert [r.to for r in df.collect()] != list(range(100))


def test_pieces(spark):
    rows = [(i, " ".join(f"w{j}" for j in range((i * 37) % 90)), f"s{i % 4}" if i % 5 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs, sources, pieces = mixing.mix(df, block=16)
    size = {r.s: r for r in sources.collect()}
    got = pieces.collect()
    lengths = {(r.s, r.start): r.size for r in docs.collect() if r.size}
    for s, r in size.items():
        mine = [x for x in got if x.s == s]
        assert sum(x.hi - x.lo for x in mine) == int(r.target + 0.5) and {x.k for x in mine} == set(range(r.draws))
        for e in range(r.full):  # whole epochs take each word once
            assert sum(x.hi - x.lo for x in mine if x.epoch == e) == r.source_size
        assert all(0 <= x.lo < x.hi <= lengths[s, x.start] for x in mine)
    n = sum(r.draws for r in size.values())
    shards = {}
    for x in {(x.shard, x.s, x.k) for x in got}:
        shards[x[0]] = shards.get(x[0], 0) + 1
    assert sum(shards.values()) == n


def test_edges(docs, nothing):
    made, sources, pieces = mixing.mix(docs)
    assert made.count() == docs.count() and {r.N_Blocks for r in made.collect()} == {7} and not {"Size", "S", "Start"} & set(made.columns)
    names = {r.source: r.s for r in sources.collect()}
    assert names == {"a": 0, "b": 1, "c": 2, None: 3}
    d, s, p = mixing.mix(nothing)
    assert d.count() == s.count() == p.count() == 0 and mixing.mixed(nothing).count() == 0
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    texts = {r.text for r in docs.collect() if r.text}
    assert all(any(set(r.text.split()) <= set(t.split()) for t in texts) for r in out.collect())


def test_query(spark, sf):
    d = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = mixing.op9_mixing(spark, sf).collect()
    assert len(rows) == len(d) and sorted(map(tuple, rows)) == sorted(map(tuple, mixing.op9_mixing(spark, sf).collect()))
    sizes = {}
    for r in rows:
        assert r.size == len(RUN.findall(d[r.doc_id].text)) and 0 <= r.taken <= 3 * r.size
        sizes.setdefault(r.source, [0, 0])
        sizes[r.source][0] += r.size
        sizes[r.source][1] += r.taken
    names = sorted(sizes)
    want = water([sizes[n][0] for n in names], [i % 3 + 1 for i in range(len(names))])
    for r in rows:
        assert r.source_size == sizes[r.source][0] and abs(r.target - want[names.index(r.source)]) < 1e-6 * max(1, r.target)
    assert all(abs(sizes[n][1] - t) <= 0.5 for n, t in zip(names, want))
