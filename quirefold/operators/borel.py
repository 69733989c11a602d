"""Rational approximants of series, their poles, directions and Laplace sums.

Exact series are long tables (series_id, n, num, den), whole numbers in text, all n from 0 to the last one, or gathered, rows
(series_id, c) with all coefficients as text. Equal series come often, so a worker remembers what it made of one. An approximant
is a row (series_id, m, p, q): coefficients of numerator and denominator, lowest power first, q_0 = 1. Poles are rows
(series_id, re, im), of several approximants with ``ord``. A series has few coefficients and an approximant few roots,
which is what one row's arithmetic is about; what grows are the series, the poles and the points.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions.groups import by_group, each_row
from quirefold.operators.branches import quotient, times
from quirefold.operators.lab import log_gamma
from quirefold.sources.shared import stored

# The largest order of minimal and of default approximants, and tolerances.
MINIMAL, DEFAULT = 12, 8
DOUBLET = 1e-6
STABLE = 1e-3
VOTES = 3
GAP = 0.05


def transformed(series: DataFrame, k: float = 1.0) -> DataFrame:
    """(series_id, n, sign, log_b): c_n / gamma(1 + n / k) of series (series_id, n, c) by sign and logarithm."""
    log_b = F.log(F.abs("c")) - log_gamma(1 + F.col("n") / F.lit(float(k)))
    return series.where("c <> 0").select("series_id", "n", F.signum("c").cast("int").alias("sign"), log_b.alias("log_b"))


def recurrence(c: list[Fraction]) -> list[Fraction]:
    """The shortest q, q_0 = 1, with sum of q_j c_{n-j} = 0 for all n from its length less 1 on (Berlekamp and Massey)."""
    q, last = [Fraction(1)], [Fraction(1)]
    size, gap, scale = 0, 1, Fraction(1)
    for n, x in enumerate(c):
        d = x + sum((q[j] * c[n - j] for j in range(1, min(size, len(q) - 1) + 1)), Fraction(0))
        if not d:
            gap += 1
            continue
        moved = [Fraction(0)] * gap + [d / scale * y for y in last]
        was = q
        q = [a - b for a, b in zip([*q, *[Fraction(0)] * (len(moved) - len(q))], [*moved, *[Fraction(0)] * (len(q) - len(moved))])]
        if 2 * size <= n:
            last, scale, size, gap = was, d, n + 1 - size, 1
        else:
            gap += 1
    return (q + [Fraction(0)] * (size + 1))[: size + 1]


def told(rows: list) -> tuple[str, ...]:
    c = ["0"] * (int(rows[-1]["n"]) + 1)
    for x in rows:
        c[int(x["n"])] = f"{x['num']}/{x['den']}"
    return tuple(c)


@lru_cache(1 << 14)
def least(told: tuple[str, ...], most: int) -> tuple[int, list[str], list[str]] | None:
    """(m, p, q) of the least approximant of a series that has all its coefficients."""
    c = [Fraction(x) for x in told]
    q = recurrence(c[1:])  # the numerator may be of the denominator's order
    m = len(q) - 1
    return (m, *([str(x) for x in s] for s in (times(c, q, m + 1), q))) if 1 <= m <= min(most, (len(c) - 1) // 2) else None


def minimal(series: DataFrame, most: int = MINIMAL) -> DataFrame:
    """(series_id, m, p, q): the approximant [m / m] of least m that has all coefficients of an exact series, p and q as text.

    No row where none up to ``most``, or half the order, has them: the series then isn't rational as far as it is known.
    """

    schema = "m int, p array<string>, q array<string>"
    listed = lambda found: [] if found is None else [found]
    if "c" in series.columns:
        rows = series.select("series_id", "c")
        return each_row(rows, f"series_id {dict(rows.dtypes)['series_id']}, {schema}", lambda r: [(r["series_id"], *x) for x in listed(least(tuple(r["c"]), most))])
    return by_group(series, "series_id", ["n", "num", "den"], schema, lambda _, rows: listed(least(told(rows), most)))


def expanded(approximants: DataFrame, order: Column | int) -> DataFrame:
    """(series_id, n, c): coefficients 0 to ``order`` of exact approximants, as text."""
    rows = approximants.select("series_id", "p", "q", (F.lit(order) if isinstance(order, int) else order).alias("order"))

    def coefs(p: tuple[str, ...], q: tuple[str, ...], size: int) -> list[str]:
        return [str(x) for x in quotient([Fraction(x) for x in p], [Fraction(x) for x in q], size)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = lru_cache(1 << 14)(coefs)
        for part in parts:
            made = [(r[0], known(tuple(r[1]), tuple(r[2]), r[3] + 1)) for r in part.itertuples(index=False)]
            yield pd.DataFrame(made, columns=["series_id", "c"])

    return rows.mapInPandas(run, f"series_id {dict(rows.dtypes)['series_id']}, c array<string>").select("series_id", F.posexplode("c").alias("n", "c"))


def approximants(series: DataFrame, orders: list[int] | None = None) -> DataFrame:
    """(series_id, ord, p, q): approximants [m / m] in double precision of series (series_id, n, c), those of singular systems left out.

    By default one, of half the series' order, DEFAULT at most; else all of ``orders`` that the series has coefficients for.
    """

    def work(_, rows):
        c = np.zeros(int(rows[-1]["n"]) + 1)
        for x in rows:
            c[int(x["n"])] = x["c"]
        out = []
        for m in orders or [min(DEFAULT, (len(c) - 1) // 2)]:
            if m < 1 or 2 * m + 1 > len(c):
                continue
            a = np.array([[c[m + i - j] for j in range(1, m + 1)] for i in range(1, m + 1)])
            if np.linalg.matrix_rank(a) < m:
                continue
            q = np.array([1.0, *np.linalg.solve(a, -c[m + 1 : 2 * m + 1])])
            out.append((m, np.convolve(c[: m + 1], q)[: m + 1].tolist(), q.tolist()))
        return out

    return by_group(series, "series_id", ["n", "c"], "ord int, p array<double>, q array<double>", work)


def roots(polys: DataFrame, coefs: str, keep: list[str]) -> DataFrame:
    """(keep, re, im): the finite roots of the polynomials in the array ``coefs``, lowest power first, of numbers or their text."""

    def of(told: tuple) -> list[tuple[float, float]]:
        c = np.array([float(Fraction(x)) if isinstance(x, str) else x for x in told])
        c = np.trim_zeros(np.where(np.abs(c) < 1e-14 * max(1.0, np.abs(c).max()), 0.0, c), "b")
        return [(float(z.real), float(z.imag)) for z in np.roots(c[::-1]) if np.isfinite(z)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = lru_cache(1 << 14)(of)
        for part in parts:
            out = [(*own, *z) for *own, c in part.itertuples(index=False) for z in known(tuple(c))]
            yield pd.DataFrame(out, columns=[*keep, "re", "im"])

    kinds = dict(polys.dtypes)
    return polys.select(*keep, coefs).mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", re double, im double")


def near_cells(df: DataFrame, size: Column, key: list[str]) -> DataFrame:
    """df once for each square of a grid of side ``size`` (a power of two) that a point within size of (re, im) may be in."""
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    at = df.withColumn("_l", size)
    return at.withColumn("_dx", F.explode(step)).withColumn("_dy", F.explode(step)).select(*key, "_l", *[(F.floor(F.col(c) / F.col("_l")) + F.col(d)).cast("long").alias(x) for c, d, x in (("re", "_dx", "_x"), ("im", "_dy", "_y"))], *[c for c in df.columns if c not in key])


def without_doublets(poles: DataFrame, zeros: DataFrame, tol: float = DOUBLET, key: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """poles (key, re, im) but those with a zero (key, re, im) nearer than tol times the pole's modulus, or tol.

    Poles and zeros meet by squares whose side is the power of two that covers a pole's reach.
    """
    names = list(key)
    reach = tol * F.greatest(F.lit(1.0), F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")))
    side = F.pow(F.lit(2.0), F.ceil(F.log2(reach)))
    sided = poles.withColumn("_reach", reach)
    cells = near_cells(sided.select(*names, "re", "im", "_reach").distinct(), side, names)
    # a zero is put into the grids of all sides of its key's poles
    sides = sided.select(*names, side.alias("_l")).distinct()
    at = zeros.select(*names, F.col("re").alias("zre"), F.col("im").alias("zim")).distinct().join(sides, names)
    at = at.select(*names, "_l", "zre", "zim", *[F.floor(F.col(c) / F.col("_l")).cast("long").alias(x) for c, x in (("zre", "_x"), ("zim", "_y"))])
    gap = F.sqrt(F.pow(F.col("re") - F.col("zre"), 2) + F.pow(F.col("im") - F.col("zim"), 2))
    gone = cells.join(at, [*names, "_l", "_x", "_y"]).where(gap < F.col("_reach")).select(*names, "re", "im").distinct()
    return poles.join(gone, [*names, "re", "im"], "left_anti")


def clean_poles(series: DataFrame, orders: list[int] | None = None) -> DataFrame:
    """(series_id, ord, re, im): poles of the approximants without those that a zero cancels."""
    made = approximants(series, orders)
    key = ["series_id", "ord"]
    return without_doublets(roots(made, "q", key), roots(made, "p", key), key=tuple(key))


def first_come(nodes: DataFrame, conflicts: DataFrame, key: str) -> DataFrame:
    """The nodes that are taken if each, in order, is taken unless an earlier taken one conflicts with it.

    conflicts: (a, b), a before b. A node none of whose earlier conflicts is undecided is decided; rounds go on until all are.
    """
    undecided, out = nodes, None
    while True:
        open_ = conflicts.join(undecided.select(F.col(key).alias("b")), "b").join(undecided.select(F.col(key).alias("a")), "a")
        waiting = open_.select(F.col("b").alias(key)).distinct()
        taken = stored(undecided.join(waiting, key, "left_anti"), "taken")
        out = taken if out is None else out.unionByName(taken)
        gone = conflicts.join(taken.select(F.col(key).alias("a")), "a").select(F.col("b").alias(key)).distinct()
        undecided = stored(undecided.join(taken.select(key), key, "left_anti").join(gone, key, "left_anti"), "undecided")
        if undecided.isEmpty():
            return out


def directions(poles: DataFrame, gap: float = GAP) -> DataFrame:
    """(series_id, direction, radius, n) of poles (series_id, re, im): each, by modulus, then angle, joins the first direction less than ``gap`` from its own, or is one.

    Angles count to 12 decimals, and gaps aren't taken around the circle. Within half a gap's sector all poles are near
    each other, so it has one direction at most, and its first pole that is left stands for it: where that comes before
    those of the two sectors to each side, it is a direction. Then the poles near it go, and the next round begins. So
    a series has 2 pi / gap * 2 such poles at most in a round, however many poles it has.
    """
    r = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    z = poles.select("series_id", F.round(F.atan2("im", "re"), 12).alias("_a"), r.alias("_r")).withColumn("_s", F.floor(F.col("_a") / (gap / 2)).cast("int"))
    z = stored(z, "angles")
    around = Window.partitionBy("series_id").orderBy("_s").rangeBetween(-2, 2)
    left, leaders = z, None
    while True:
        heads = left.groupBy("series_id", "_s").agg(F.min(F.struct("_r", "_a")).alias("h"))
        new = heads.withColumn("_first", F.min("h").over(around)).where(F.col("h") == F.col("_first"))
        new = stored(new.select("series_id", F.col("h._a").alias("direction"), F.col("h._r").alias("_lr"), F.col("_s").alias("_ls")), "directions")
        if new.isEmpty():
            break
        leaders = new if leaders is None else leaders.unionByName(new)
        left = stored(_joined(left, new, gap).where("direction is null").select("series_id", "_a", "_r", "_s"), "angles")
    if leaders is None:
        return poles.select("series_id", F.lit(0.0).alias("direction"), F.lit(0.0).alias("radius"), F.lit(0).cast("long").alias("n")).limit(0)
    member = _joined(z, leaders, gap)
    return member.groupBy("series_id", "direction").agg(F.min("_r").alias("radius"), F.count("*").alias("n"))


def _joined(z: DataFrame, leaders: DataFrame, gap: float) -> DataFrame:
    """z with the first leader near each pole, by modulus, then angle, or null."""
    near = leaders.select("series_id", "direction", "_lr", F.explode(F.sequence(F.col("_ls") - 2, F.col("_ls") + 2)).alias("_s"))
    # a sector is near a few leaders only, as these are a gap apart
    by_sector = near.groupBy("series_id", "_s").agg(F.array_sort(F.collect_list(F.struct(F.col("_lr").alias("r"), F.col("direction").alias("d")))).alias("_near"))
    first = F.filter("_near", lambda x: F.abs(x["d"] - F.col("_a")) < gap)
    return z.join(by_sector, ["series_id", "_s"], "left").withColumn("direction", F.get(first, F.lit(0))["d"]).drop("_near")


def radius(poles: DataFrame) -> DataFrame:
    """(series_id, radius): the least modulus of the poles."""
    return poles.groupBy("series_id").agg(F.min(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("radius"))


PANELS, NODES, FAR = 24, 16, 45.0


def laplace(points: DataFrame, k: float = 1.0, near: float = 0.02) -> DataFrame:
    """points (p, q, z_re, z_im, direction and others) with the sum of the approximant p / q along a direction: re, im, on_ray.

    The integral of B(u) k z^-k exp(-(u / z)^k) u^(k-1) over the ray, by Gauss and Legendre in stretches up to where the
    exponential is e^-FAR. on_ray: a pole of B is within an angle ``near`` of the ray, so the sum is not to be trusted.
    Null where the exponential doesn't fall along the ray.
    """
    x, w = np.polynomial.legendre.leggauss(NODES)
    s = np.concatenate([(i + (x + 1) / 2) / PANELS for i in range(PANELS)])
    weight = np.tile(w / 2 / PANELS, PANELS)

    def number(c) -> np.ndarray:
        return np.array([float(Fraction(v)) if isinstance(v, str) else v for v in c])

    def along(p: tuple, q: tuple, zr: float, zi: float, d: float) -> tuple:
        z = complex(zr, zi)
        turn = np.exp(1j * k * (d - np.angle(z))) if z else 0
        if not z or turn.real <= 1e-3:
            return None, None, None
        end = (FAR / turn.real) ** (1 / k)
        # by the square, so that the stretches near 0 are short
        t, dt = end * s**2, 2 * end * s * weight
        u = np.exp(1j * d) * abs(z) * t
        b = np.polyval(number(p)[::-1], u) / np.polyval(number(q)[::-1], u)
        f = np.sum(b * np.exp(-turn * t**k) * turn * k * t ** (k - 1) * dt)
        at = np.roots(np.trim_zeros(number(q), "b")[::-1])
        close = bool(np.any(np.abs(np.angle(at * np.exp(-1j * d))) < near)) if len(at) else False
        return float(f.real), float(f.imag), close

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = lru_cache(1 << 14)(along)
        for part in parts:
            out = [known(tuple(p), tuple(q), *at) for p, q, *at in zip(part["p"], part["q"], part["z_re"], part["z_im"], part["direction"])]
            yield part.drop(columns=["p", "q"]).assign(**{c: [o[i] for o in out] for i, c in enumerate(("re", "im", "on_ray"))}).astype(object)

    rest = points.drop("p", "q")
    kinds = ", ".join(f"`{c}` {t}" for c, t in rest.dtypes)
    return points.mapInPandas(run, f"{kinds}, re double, im double, on_ray boolean")


def report(series: DataFrame) -> DataFrame:
    """(series_id, re, im, votes, modulus, direction, radius): stable poles of exact series, by modulus, with their direction and the least modulus.

    A rational series has the poles of its minimal approximant, which count as found by all orders; of others those that
    come back in several.
    """
    from quirefold.operators.lab import pade_orders, stable_poles

    exact_ = stored(minimal(series), "approximants")
    own = roots(exact_, "q", ["series_id"]).withColumn("votes", F.lit(None).cast("long"))
    other = series.join(exact_.select("series_id"), "series_id", "left_anti")
    if "c" in series.columns:
        parts = F.split("c", "/")
        other = other.select("series_id", F.posexplode("c").alias("n", "c")).select("series_id", "n", F.get(parts, F.lit(0)).alias("num"), F.coalesce(F.get(parts, F.lit(1)), F.lit("1")).alias("den"))
    other = other.select("series_id", "n", (F.col("num").cast("double") / F.col("den").cast("double")).alias("c"))
    voted = stable_poles(clean_poles(other, pade_orders(10**6)), STABLE, VOTES).select("series_id", "re", "im", F.col("votes").cast("long").alias("votes"))
    both = stored(own.unionByName(voted), "poles")
    return both.select("*", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("modulus"), F.atan2("im", "re").alias("direction")).join(radius(both), "series_id")
