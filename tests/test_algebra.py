import math
import random
from fractions import Fraction

import numpy as np

from quirefold.operators import borel, branches


def polys(spark, given):
    rows = [(k, i, n, str(c.numerator), str(c.denominator)) for k, p in given.items() for i, s in enumerate(p) for n, c in enumerate(map(Fraction, s))]
    return branches.gathered(spark.createDataFrame(rows, "poly_id long, i int, n int, num string, den string"))


def z(order, *terms):
    out = [0] * (order + 1)
    for n, c in terms:
        out[n] = c
    return out


def series(y, size):
    out = [Fraction(0)] * size
    for x in y:
        out[x["n"]] = Fraction(x["c"])
    return out


def test_catalan_by_lifting_and_refusals(spark):
    n = 20
    given = {1: [z(n, (1, 1)), z(n, (0, -1)), z(n, (0, 1))], 2: [z(n, (1, -1)), z(n), z(n, (0, 1))]}
    got = {(r.poly_id, r.root): r for r in branches.lifted_roots(polys(spark, given)).collect()}
    catalan = [0] + [math.comb(2 * k, k) // (k + 1) for k in range(n)]
    assert series(got[1, "0"].y, n + 1) == catalan and got[1, "0"].steps <= 6
    assert series(got[1, "1"].y, n + 1) == [1] + [-c for c in catalan[1:]]
    assert got[2, "0"].status == "multiple root" and got[2, "0"].y is None


def test_branches_of_known_curves(spark):
    n = 12
    given = {
        1: [z(n, (1, -1)), z(n), z(n), z(n, (0, 1))],  # y^3 = z
        2: [z(n, (1, -1), (2, -1)), z(n), z(n, (0, 1))],  # y^2 = z (1 + z)
        3: [z(n, (2, 1)), z(n, (1, -2)), z(n, (0, 1))],  # (y - z)^2
        4: [z(n, (3, -4)), z(n), z(n, (0, 9))],  # 9 y^2 = 4 z^3
        5: [z(n, (2, 2)), z(n, (1, -3)), z(n, (0, 1))],  # (y - z)(y - 2 z)
    }
    got = {}
    p = polys(spark, given)
    for r in branches.residuals(p, branches.puiseux(p)).collect():
        got.setdefault(r.poly_id, []).append(r)
    assert [(r.r, r.c, r.residual) for r in got[1]] == [(3, "1", 0)] and [tuple(x) for x in got[1][0].y] == [(1, "1")]
    assert sorted(r.c for r in got[2]) == ["-1", "1"] and all(r.r == 2 and r.residual == 0 for r in got[2])
    root = series(next(r.y for r in got[2] if r.c == "1"), n + 1)
    assert root[1] == 1 and root[3] == Fraction(1, 2) and root[5] == Fraction(-1, 8)
    assert [(r.status, r.multiplicity, [tuple(x) for x in r.y]) for r in got[3]] == [("multiple", 2, [(1, "1")])]
    assert sorted(tuple(map(tuple, r.y)) for r in got[4]) == [((3, "-2/3"),), ((3, "2/3"),)]
    assert sorted(tuple(map(tuple, r.y)) for r in got[5]) == [((1, "1"),), ((1, "2"),)]


def test_rational_roots_with_multiplicity():
    rng = random.Random(1)
    for _ in range(150):
        f, want = [Fraction(rng.randint(1, 9), rng.randint(1, 5))], {}
        for _ in range(rng.randint(0, 4)):
            r = Fraction(rng.randint(-30, 30), rng.randint(1, 12))
            want[r] = want.get(r, 0) + 1
            f = [a - r * b for a, b in zip([0, *f], [*f, 0])]
        if rng.random() < 0.5:
            f = [2 * a + b for a, b in zip([*f, 0, 0], [0, 0, *f])]
        assert branches.rational_roots(f) == sorted(want.items())


def exact(spark, given):
    rows = [(k, n, str(Fraction(c).numerator), str(Fraction(c).denominator)) for k, s in given.items() for n, c in enumerate(s)]
    return spark.createDataFrame(rows, "series_id long, n int, num string, den string")


def test_minimal_approximants_and_their_expansion(spark):
    given = {1: [(-1) ** n for n in range(31)], 2: [2**n + Fraction(1, 4**n) for n in range(12)], 3: [1, 1] + [0] * 9, 4: [Fraction(1, math.factorial(n)) for n in range(13)], 5: [3] + [0] * 8}
    made = borel.minimal(exact(spark, given)).collect()
    assert {r.series_id: r.m for r in made} == {1: 1, 2: 2, 3: 1, 4: 6}  # 13 coefficients always have one of order 6
    back = borel.expanded(borel.minimal(exact(spark, given)), 11).where("series_id = 2").orderBy("n").collect()
    assert [Fraction(r.c) for r in back] == given[2]
    poles = borel.roots(borel.minimal(exact(spark, given)).where("series_id = 2"), "q", ["series_id"]).collect()
    assert np.allclose(sorted(r.re for r in poles), [0.5, 4.0])


def test_report_finds_built_singularities(spark):
    zeta = 2 * np.exp(1j * np.pi / 3)
    pair = [float(2 * (zeta ** -(n + 1)).real) for n in range(30)]
    noisy = [Fraction(x) for x in pair]  # doubles: no exact recurrence, so poles are voted
    rows = borel.report(exact(spark, {1: [(-1) ** n for n in range(31)], 2: noisy})).collect()
    euler = [r for r in rows if r.series_id == 1]
    assert len(euler) == 1 and abs(euler[0].re + 1) < 1e-8 and abs(abs(euler[0].direction) - np.pi) < 1e-6 and abs(euler[0].radius - 1) < 1e-8
    own = sorted((r.modulus, r.direction) for r in rows if r.series_id == 2)[:2]
    assert np.allclose([m for m, _ in own], 2, atol=1e-4) and np.allclose(sorted(d for _, d in own), [-np.pi / 3, np.pi / 3], atol=1e-3)


def test_doublets_by_all_pairs(spark):
    rng = random.Random(4)
    points = lambda n: [(rng.randrange(3), rng.choice([1.0, 30.0]) * rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(n)]
    poles = points(200)
    zeros = points(150) + [(k, x + rng.gauss(0, 0.02), y) for k, x, y in rng.sample(poles, 60)]
    want = {p for p in poles if not any(k == p[0] and math.hypot(x - p[1], y - p[2]) < 0.05 * max(1, math.hypot(p[1], p[2])) for k, x, y in zeros)}
    frame = lambda rows: spark.createDataFrame(rows, "series_id int, re double, im double")
    assert {tuple(r) for r in borel.without_doublets(frame(poles), frame(zeros), 0.05).collect()} == want


def test_directions_one_after_the_other(spark):
    rng = random.Random(5)
    poles = [(k, rng.gauss(0, 1), rng.gauss(0, 1)) for k in range(3) for _ in range(150)] + [(9, (n + 1) * math.cos(0.03 * n), (n + 1) * math.sin(0.03 * n)) for n in range(60)]
    want = []
    for k in {p[0] for p in poles}:
        dirs = []
        for r, a in sorted((math.hypot(x, y), round(math.atan2(y, x), 12)) for q, x, y in poles if q == k):
            for d in dirs:
                if abs(d[0] - a) < 0.05:
                    d[2] += 1
                    break
            else:
                dirs.append([a, r, 1])
        want += [(k, round(a, 6), round(r, 6), n) for a, r, n in dirs]
    got = borel.directions(spark.createDataFrame(poles, "series_id int, re double, im double")).collect()
    assert sorted((r.series_id, round(r.direction, 6), round(r.radius, 6), r.n) for r in got) == sorted(want)
    assert borel.directions(spark.createDataFrame([], "series_id int, re double, im double")).count() == 0


def test_laplace_sums(spark):
    rows = [([1.0], [1.0, 1.0], z_, 0.1 if z_ == 0.2 else 0.0, d) for z_ in (0.1, 0.2, 0.3) for d in (0.0, 0.3)] + [([1.0], [1.0, 1.0], 0.1, 0.0, np.pi), ([1.0], [1.0, -1.0], 0.1, 0.0, 0.0)]
    got = borel.laplace(spark.createDataFrame(rows, "p array<double>, q array<double>, z_re double, z_im double, direction double")).collect()
    s = np.linspace(0, 50, 2_000_001)
    for r in got[:6]:
        y = np.exp(-s) / (1 + complex(r.z_re, r.z_im) * s)
        want = ((y[1:] + y[:-1]) / 2 * np.diff(s)).sum()
        assert abs(complex(r.re, r.im) - want) < 1e-8 and not r.on_ray
    assert got[6].re is None and got[7].on_ray


def test_laplace_of_higher_order_is_the_series_again(spark):
    # B(u) = 1 + u + u^2: its sum of order k is 1 + gamma(1 + 1 / k) z + gamma(1 + 2 / k) z^2
    point = spark.createDataFrame([([1.0, 1.0, 1.0], [1.0], 0.2, 0.0, 0.0)], "p array<double>, q array<double>, z_re double, z_im double, direction double")
    for k in (1.0, 2.0, 3.0):
        got = borel.laplace(point, k).first()
        assert abs(got.re - (1 + math.gamma(1 + 1 / k) * 0.2 + math.gamma(1 + 2 / k) * 0.04)) < 1e-10
