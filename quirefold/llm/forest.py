"""Near-duplicate vectors by a forest of random-projection trees.

Equal vectors (by direction) are one class. Each tree splits the classes at the median of a random projection, again
and again, until a leaf is small; classes near a split go to both sides (spill). Within a leaf all classes are compared
by cosine in double precision, in blocks. A pair is counted in the first tree and leaf that hold both, so that no pair
has to be sent: a leaf returns each class's number of links and, for the components, a spanning forest of its links.
Components are then united over all leaves by rounds of joins.

Where a leaf's vectors lie so close together that any split parts near ones (the spread of a projection is less than the
distance of a near pair), it isn't split but compared whole, in cells of two blocks of its classes; a leaf whose
classes all share a leaf of an earlier tree is passed over. Where they lie nearly as close, more of them go to both sides.

Trees are fitted on a bounded sample of SAMPLE classes in all, round by round: a round splits the largest of the leaves
that are still too large, of which it draws a sample anew. Directions follow from the tree's and node's number; only
thresholds are sent. Every class goes through every tree.

A vector that is null, empty or zero, or that holds null or other components than finite numbers links with nothing;
vectors of different lengths don't link. Null ids are kept out of components (their own is null) but count as links. Repeated rows
are vectors of their own, linked with each other. Other columns are not used. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm.shared import stored

COSINE = 0.95
TREES = 12
LEAF = 1000
SPILL = 0.08
#: Spill where the spread is less than twice the distance of a near pair.
WIDE = 0.15
#: Classes of one leaf that a task compares with as many others, at most.
CELL = 4096
#: Near pairs for each class of a cell up to which pairs are looked at one by one.
FEW_PAIRS = 16
SAMPLE = 24_000
SEED = 7
#: Classes of a leaf in the sample, so many at least as a rule, and the least size of leaves that small tables are split to.
LEAF_SAMPLE = 64
LEAST_LEAF = 32
BLOCK = 1024
ROUNDS = 40
#: Lengths of vectors that a table may have.
LENGTHS = 32
#: Edges that one task unites, and nodes that are sent to all tasks with their components, at most.
FEW_EDGES = 100_000
SENT = 200_000


def direction(tree: int, node: int, size: int) -> np.ndarray:
    return np.random.default_rng((SEED, tree, node)).standard_normal(size)


def fit_tree(tree: int, node: int, points: np.ndarray, weight: float, spill: float, leaf: int, gap: float, out: dict[int, tuple[float, float, float]], whole: set) -> None:
    """Thresholds (left end, middle, right start) of node and those below. A point stands for ``weight`` classes.

    whole gets the nodes (tree, node) that aren't split although they are large. gap: the distance of a near pair.
    """
    if len(points) * weight <= leaf or len(points) < 16:
        return
    at = points @ direction(tree, node, points.shape[1])
    if at.std() < gap:
        whole.add((tree, node))
        return
    spill = spill if at.std() >= 2 * gap else max(spill, WIDE)
    low, mid, high = np.quantile(at, [0.5 - spill, 0.5, 0.5 + spill])
    if low == high:
        whole.add((tree, node))
        return
    out[node] = (float(low), float(mid), float(high))
    # a class between low and high goes to both sides
    fit_tree(tree, 2 * node, points[at <= high], weight, spill, leaf, gap, out, whole)
    fit_tree(tree, 2 * node + 1, points[at >= low], weight, spill, leaf, gap, out, whole)


def descend(tree: int, leaves: list[list[int]], points: np.ndarray, splits: dict[int, tuple[float, float, float]]) -> list[list[int]]:
    """The leaves that each point reaches from those where it is."""
    out: list[list[int]] = [[] for _ in leaves]
    todo: dict[int, list[int]] = {}
    for i, own in enumerate(leaves):
        for node in own:
            (todo.setdefault(node, []) if node in splits else out[i]).append(i if node in splits else node)
    while todo:
        node, rows = todo.popitem()
        low, _, high = splits[node]
        index = np.array(rows)
        at = points[index] @ direction(tree, node, points.shape[1])
        for child, part in ((2 * node, index[at <= high]), (2 * node + 1, index[at >= low])):
            if child in splits:
                todo.setdefault(child, []).extend(part.tolist())
            else:
                for i in part.tolist():
                    out[i].append(child)
    return out


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def grown(classes: DataFrame, trees: int, leaf: int, spill: float, sample: int, cosine: float = COSINE) -> DataFrame:
    """classes (cls, unit, n) with ``leaves``: for each tree the array of its leaves that hold the class.

    A round splits the largest of the leaves that are too large, as many as the sample gives LEAF_SAMPLE of their
    classes each; those that it doesn't come to are split in later rounds. Fails if ROUNDS rounds leave any unsplit.
    """
    spark = classes.sparkSession
    df = classes.withColumn("leaves", F.array_repeat(F.array(F.lit(1).cast("long")), trees))
    schema = df.schema
    n = classes.count()
    leaf = min(leaf, max(LEAST_LEAF, n // 8))  # small tables are split as well
    large: list[tuple[int, int, int]] = [(t, 1, n) for t in range(trees)] if n > leaf else []
    whole: set[tuple[int, int]] = set()
    for round_ in range(ROUNDS):
        if not large:
            return df
        now = sorted(large, key=lambda x: (-x[2], x[:2]))[: max(trees, sample // LEAF_SAMPLE)]
        total = max(sum(x[2] for x in now if x[0] == t) for t in range(trees))
        share = min(1.0, sample / total)
        nodes = [[x[1] for x in now if x[0] == t] for t in range(trees)]
        within = F.lit(False)
        for t, own in enumerate(nodes):
            if own:
                within = within | F.arrays_overlap(F.col("leaves")[t], F.array(*[F.lit(x).cast("long") for x in own]))
        chosen = df.where(within & (F.shiftrightunsigned(F.xxhash64("cls", F.lit(round_)), 11) / float(1 << 53) < share)).select("unit", "leaves").toPandas()
        points = matrix(chosen["unit"])
        splits: list[dict[int, tuple[float, float, float]]] = [{} for _ in range(trees)]
        members: dict[tuple[int, int], list[int]] = {}
        for i, own in enumerate(chosen["leaves"]):
            for t, held in enumerate(own):
                for node in held:
                    members.setdefault((t, int(node)), []).append(i)
        for t, node, _ in now:
            own = members.get((t, node), [])
            fit_tree(t, node, points[own], 1 / share, spill, leaf, (2 * (1 - cosine)) ** 0.5, splits[t], whole)
        sent = spark.sparkContext.broadcast(splits)

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                own = [[[int(x) for x in held] for held in row] for row in part["leaves"]]
                unit = matrix(part["unit"])
                if len(part):
                    for t, s in enumerate(sent.value):
                        if s:
                            for row, held in zip(own, descend(t, [row[t] for row in own], unit, s)):
                                row[t] = held
                yield part.assign(leaves=own)

        df = stored(df.mapInPandas(run, schema), "forest")
        if share == 1.0 and len(now) == len(large):
            return df
        counts = df.select(F.posexplode("leaves").alias("tree", "nodes")).select("tree", F.explode("nodes").alias("node")).groupBy("tree", "node").count()
        large = [tuple(r) for r in counts.where(F.col("count") > 2 * leaf).collect() if (r.tree, r.node) not in whole]
    raise RuntimeError(f"leaves are too large after {ROUNDS} rounds")


def cells(placed: DataFrame) -> DataFrame:
    """A row for each class of ``grown`` and cell (tree, node, x, y) that it is in, own its block: leaves of more than CELL classes have several blocks.

    earlier: the class's leaves before this one, tree after tree, as numbers.
    Leaves whose classes all share a leaf of an earlier tree have none, and neither have those of one class.
    """
    each = placed.select("cls", "unit", "n", "leaves", F.posexplode("leaves").alias("tree", "nodes")).select("cls", "unit", "n", "leaves", "tree", F.explode("nodes").alias("node"))
    # the first leaves of all trees; one of an earlier tree that is the same for all has every pair
    firsts = F.transform("leaves", lambda x: F.get(x, F.lit(0)))
    trees = len(placed.select("leaves").first()["leaves"]) if not placed.isEmpty() else 0
    ends = [f(F.get(firsts, F.lit(t))).alias(f"{name}{t}") for t in range(trees) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    sizes = each.groupBy("tree", "node").agg(F.count("*").alias("size"), *ends)
    again = F.lit(False)
    for t in range(trees):
        again = again | (F.col("tree") > t) & (F.col(f"lo{t}") == F.col(f"hi{t}"))
    sizes = sizes.where((F.col("size") > 1) & ~again).select("tree", "node", F.ceil(F.col("size") / CELL).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("cls", F.lit(5)), F.col("blocks")).cast("int")
    all_ = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least("own", i).alias("x"), F.greatest("own", i).alias("y")))
    number = lambda t, v: t.cast("long") * F.lit(1 << 48) + v
    codes = F.flatten(F.transform("leaves", lambda nodes, t: F.transform(nodes, lambda v: number(t, v))))
    earlier = F.filter(codes, lambda c: c < number(F.col("tree"), F.col("node")))
    return each.join(sizes, ["tree", "node"]).withColumn("own", own).select("tree", "node", "cls", "unit", "n", earlier.alias("earlier"), "own", F.inline(all_))


def merged_labels(labels: np.ndarray, i: int, to: np.ndarray) -> list[int]:
    """Unites i with the places ``to``; those of them, one for each other label, that this needed."""
    found = []
    while True:
        other = to[labels[to] != labels[i]]
        if not len(other):
            return found
        found.append(int(other[0]))
        a, b = labels[i], labels[other[0]]
        labels[labels == max(a, b)] = min(a, b)


class Sets(dict):
    """The rows of a column of arrays as sets, made when they are needed."""

    def __init__(self, column: pd.Series):
        self.column = column.to_numpy()

    def __missing__(self, i: int) -> set:
        self[i] = out = set(self.column[i].tolist())
        return out


def compared(cosine: float):
    """Compares the classes of a cell: rows (cls, links, other), links where other is null, else an edge of a spanning forest."""

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        x, y = int(key[2]), int(key[3])
        part = part.sort_values("cls").reset_index(drop=True)
        unit, weight, names, block = matrix(part["unit"]), part["n"].to_numpy(np.int64), part["cls"].to_numpy(np.int64), part["own"].to_numpy()
        earlier = Sets(part["earlier"])
        left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
        links, labels, edges = np.zeros(len(part), np.int64), np.arange(len(part)), []
        if len(left) and len(right):
            for a in range(0, len(left), BLOCK):
                i = left[a : a + BLOCK]
                for b in range(0, len(right), BLOCK):
                    j = right[b : b + BLOCK]
                    near = unit[i] @ unit[j].T >= cosine
                    if x == y:
                        near &= i[:, None] < j[None, :]
                    if not near.any():
                        continue
                    if near.sum() <= FEW_PAIRS * len(i):
                        for r, c in zip(*np.nonzero(near)):
                            near[r, c] = earlier[i[r]].isdisjoint(earlier[j[c]])
                    else:
                        near &= ~shared(earlier, i, j)
                    links[i] += near @ weight[j]
                    links[j] += weight[i] @ near
                    for r in np.flatnonzero(near.any(1)):
                        edges += [(names[i[r]], names[c]) for c in merged_labels(labels, i[r], j[near[r]])]
        hit = np.flatnonzero(links)
        return pd.DataFrame({"cls": [*names[hit], *(e[0] for e in edges)], "links": [*links[hit], *(0 for _ in edges)], "other": pd.array([*(None for _ in hit), *(int(e[1]) for e in edges)], dtype="Int64")})

    return run


def shared(earlier: Sets, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of i and j have an earlier leaf in common."""
    out = np.zeros((len(i), len(j)), bool)
    mine, theirs = ({v for r in side for v in earlier[r]} for side in (i, j))
    both = sorted(mine & theirs)
    for at in range(0, len(both), 512):
        place = {v: k for k, v in enumerate(both[at : at + 512])}
        a, b = np.zeros((len(i), len(place)), np.float32), np.zeros((len(j), len(place)), np.float32)
        for m, side in ((a, i), (b, j)):
            for r, row in enumerate(side):
                m[r, [place[v] for v in earlier[row] if v in place]] = 1
        out |= a @ b.T > 0
    return out


def signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def united(edges: DataFrame) -> DataFrame:
    """(node, component) of FEW_EDGES distinct edges (u, v) at most, in one task."""
    kind = edges.schema["u"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict = {}

        def root(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for part in parts:
            for u, v in zip(part["u"], part["v"]):
                u, v = root(u if kind == "bigint" else bytes(u)), root(v if kind == "bigint" else bytes(v))
                parent[max(u, v)] = min(u, v)
        nodes = [x for x in parent if root(x) != x]
        yield pd.DataFrame({"node": nodes, "component": [root(x) for x in nodes]})

    return stored(edges.coalesce(1).mapInPandas(run, f"node {kind}, component {kind}"), "united")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for the nodes of edges but the least of each component, which names it.

    In each round every node's neighbours are linked to the least one near it, first those that are larger than it,
    then those that are smaller; this ends in stars around the least nodes after a logarithmic number of rounds. Edges
    that don't change any more are these stars. Should ROUNDS rounds not be enough, it fails. FEW_EDGES edges or fewer
    don't need rounds of jobs.
    """
    now = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    was = signature(now)
    if was[0] <= FEW_EDGES:
        return united(now)
    for _ in range(ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        large = stored(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = stored(small, "edges")
        then, was = was, signature(now)
        if then == was:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    raise RuntimeError(f"components aren't found after {ROUNDS} rounds")


def with_components(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """pairs (a, b and others) with their ends' components c_a and c_b, null where an end names its own."""
    few = joined.limit(SENT + 1).count() <= SENT
    for s in ("a", "b"):
        own = joined.select(F.col("node").alias(f"n_{s}"), F.col("component").alias(f"c_{s}"))
        pairs = pairs.join(F.broadcast(own) if few else own, F.col(s) == F.col(f"n_{s}"), "left").drop(f"n_{s}")
    return pairs


def extended(joined: DataFrame, edges: DataFrame) -> DataFrame:
    """Components (node, component) as ``components`` gives them, with further edges (a, b) between any nodes."""
    if edges.isEmpty():
        return joined
    both = with_components(edges, joined)
    more = components(both.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")))
    moved = joined.join(more.select(F.col("node").alias("_n"), F.col("component").alias("_c")), F.col("component") == F.col("_n"), "left")
    return stored(moved.select("node", F.coalesce("_c", "component").alias("component")).unionByName(more), "joined")


def near_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of df."""
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    sizes = [r.d for r in rows.where(F.size("v") > 0).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(LENGTHS + 1).collect()] or [0]
    if len(sizes) > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} lengths")
    # those of the commonest length go with those without one
    parts = [rows.where((F.size("v") == d) | (F.coalesce(F.size("v"), F.lit(-1)) <= 0) if i == 0 else F.size("v") == d) for i, d in enumerate(sizes)]
    out = of_length(parts[0], sizes[0], cosine, trees, leaf, spill, sample)
    for part, d in zip(parts[1:], sizes[1:]):
        out = out.unionByName(of_length(part, d, cosine, trees, leaf, spill, sample))
    return out


def of_length(rows: DataFrame, size: int, cosine: float, trees: int, leaf: int, spill: float, sample: int) -> DataFrame:
    """near_vectors of rows (vec_id, v), of which those of another length link with nothing."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    top = F.aggregate("v", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))
    good = F.coalesce((F.size("v") == size) & finite & (top > 0), F.lit(False))
    # by the largest component first, so that neither tiny nor huge ones vanish in squares
    scaled = F.transform("v", lambda x: x / top)
    norm = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.withColumn("scaled", F.when(good, scaled)).withColumn("unit", F.when(F.col("scaled").isNotNull(), F.transform("scaled", lambda x: x / norm + F.lit(0.0))))
    rows = rows.withColumn("h", F.when(F.col("unit").isNotNull(), F.xxhash64("unit")))
    # equal directions, by two hashes; a class is named by its least id or, where all are null, by its hash
    rows = stored(rows.select("vec_id", "unit", "h", F.when(F.col("h").isNotNull(), F.md5(F.to_json(F.struct("unit")).cast("binary"))).alias("h2")), "vectors")
    classes = rows.where("h is not null").groupBy("h", "h2").agg(F.min("vec_id").alias("least"), F.first("unit").alias("unit"), F.count("*").alias("n"))
    classes = stored(classes.withColumn("cls", F.xxhash64("h2", "h")), "classes")
    placed = grown(classes.select("cls", "unit", "n"), trees, leaf, spill, sample, cosine)
    found = stored(cells(placed).groupBy("tree", "node", "x", "y").applyInPandas(compared(cosine), "cls long, links long, other long"), "links")
    links = found.where("other is null").groupBy("cls").agg(F.sum("links").alias("links"))
    ids = classes.select("cls", "least")
    edges = found.where("other is not null").join(ids.withColumnRenamed("least", "a"), "cls").join(ids.select(F.col("cls").alias("other"), F.col("least").alias("b")), "other").where("a is not null and b is not null")
    united = components(edges.select("a", "b"))
    known = classes.join(links, "cls", "left").join(united, F.col("least") == F.col("node"), "left").select("h", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "least").alias("component"))
    out = rows.select("vec_id", "h", "h2").join(known, ["h", "h2"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


SQL_OP7 = """
WITH RECURSIVE v AS (
  SELECT vec_id, CASE WHEN len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                       AND list_max(list_transform(embedding, lambda x: abs(x))) > 0
                      THEN list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS e
  FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(id, m) AS (SELECT vec_id, vec_id FROM v UNION SELECT p.b, r.m FROM r JOIN p ON p.a = r.id),
c AS (SELECT id, min(m) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.id = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
