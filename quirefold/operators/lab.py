"""Numerical laboratory: weight sequences, formal series, growth, algebraic branches, sweeps.

Weight sequences are long tables (seq_id, p, log_m): the logarithm of the p-th ratio, p from 0. Sums of them are
log_M(p), the logarithm of the p-th weight, with log_M(0) = 0. Series are long tables (series_id, n, c). Exact algebra
goes by group, on the fractions of one series at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions.groups import by_group


def by_p():
    """A sequence in order of p."""
    return Window.partitionBy("seq_id").orderBy("p")


def from_p():
    return by_p().rowsBetween(0, Window.unboundedFollowing)


def weights(ratios: DataFrame) -> DataFrame:
    """ratios with ``log_M``: sums of the log ratios before p."""
    return ratios.withColumn("log_M_", F.coalesce(F.sum("log_m").over(by_p().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumnRenamed("log_M_", "log_w")


def ratios(weights_: DataFrame) -> DataFrame:
    """(seq_id, p, log_m) of a table (seq_id, p, log_w): differences to the next; the last p has none."""
    return weights_.withColumn("log_m", F.lead("log_w").over(by_p()) - F.col("log_w")).where("log_m is not null").select("seq_id", "p", "log_m")


def generated(ids: DataFrame, n: int, log_m: Column) -> DataFrame:
    """Sequences by a formula in p and columns of ids (seq_id, parameters): ratios for p = 0..n."""
    return ids.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(n)))).withColumn("log_m", log_m).select("seq_id", "p", "log_m")


# Coefficients of Lanczos' approximation of the gamma function for g = 7.
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0.5."""
    y = x - 1
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(c) / (y + i)
    t = y + 7.5
    return 0.5 * math.log(2 * math.pi) + (y + 0.5) * F.log(t) - t + F.log(total)


E = math.e
#: The catalogue of weight sequences: log_M(p) from p and parameters a and b, and those given by their ratios' logarithms.
CATALOGUE = {
    "gevrey": lambda p, a, b: a * log_gamma(p + 1),
    "gevrey_log": lambda p, a, b: a * log_gamma(p + 1) + b * p * F.log(F.log(p + E)),
    "q_gevrey": lambda p, a, b: p * p * F.log(a),
}
RATIO_CATALOGUE = {"slow_ratios": lambda p, a, b: F.log(F.log(p + E)), "power_ratios": lambda p, a, b: a * F.log(p + 1)}


def catalogue(ids: DataFrame, n: int) -> DataFrame:
    """(seq_id, p, log_w), p = 0..n, of the sequences that ids (seq_id, kind, a, b) name."""
    rows = ids.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(n))))
    p, a, b = F.col("p").cast("double"), F.col("a"), F.col("b")
    direct, ratio = F.lit(None).cast("double"), F.lit(None).cast("double")
    for kind, made in CATALOGUE.items():
        direct = F.when(F.col("kind") == kind, made(p, a, b)).otherwise(direct)
    for kind, made in RATIO_CATALOGUE.items():
        ratio = F.when(F.col("kind") == kind, made(p, a, b)).otherwise(ratio)
    summed = F.coalesce(F.sum(ratio).over(by_p().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return rows.select("seq_id", "p", F.when(F.col("kind").isin(*RATIO_CATALOGUE), summed).otherwise(direct).alias("log_w"))


def weight_values(weights_: DataFrame) -> DataFrame:
    """weights with ``value``, the weight itself."""
    return weights_.withColumn("value", F.exp("log_w"))


#: Series of a prescribed growth: ln |c_n| from n and parameters a and b, without noise.
GROWTH = {
    "gevrey": lambda n, a, b: a * log_gamma(n + 1),
    "strongly_regular": lambda n, a, b: a * log_gamma(n + 1) + b * n * F.log(F.log(n + E)),
    "q_gevrey": lambda n, a, b: n * n * F.log(a),
}


def grown_series(ids: DataFrame, noise: DataFrame) -> DataFrame:
    """(series_id, n, sign, log_c) of ids (series_id, kind, a, b) and noise (series_id, n, eps), eps within 1/2 and 2."""
    rows = ids.join(noise, "series_id")
    n, out = F.col("n").cast("double"), F.lit(None).cast("double")
    for kind, made in GROWTH.items():
        out = F.when(F.col("kind") == kind, made(n, F.col("a"), F.col("b"))).otherwise(out)
    return rows.select("series_id", "n", F.lit(1).alias("sign"), (out + F.log(F.greatest(F.lit(0.5), F.least(F.lit(2.0), "eps")))).alias("log_c"))


def euler_series(n: DataFrame) -> DataFrame:
    """n with sign and logarithm of (-1)^n n!."""
    return n.select("*", F.when(F.col("n") % 2 == 0, 1).otherwise(-1).alias("sign"), log_gamma(F.col("n") + F.lit(1.0)).alias("log_c"))


def catalan_series(n: DataFrame) -> DataFrame:
    """n with sign and logarithm of the n-th coefficient of (1 - sqrt(1 - 4 z)) / 2: Catalan numbers, none at 0."""
    m = F.col("n") - F.lit(1.0)
    return n.where("n >= 1").select("*", F.lit(1).alias("sign"), (log_gamma(2 * m + 1) - log_gamma(m + 1) - log_gamma(m + 2)).alias("log_c"))


def series_from_poles(poles: DataFrame, n: int, k: float = 1.0) -> DataFrame:
    """(series_id, n, c): gamma(1 + n / k) times the sum of r / zeta^(n + 1) over real poles (series_id, zeta, r)."""
    rows = poles.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(n)))).withColumn("_x", F.col("r") / F.pow("zeta", F.col("n") + 1))
    return rows.groupBy("series_id", "n").agg(F.sum("_x").alias("_x")).select("series_id", "n", (F.exp(log_gamma(1 + F.col("n") / F.lit(k))) * F.col("_x")).alias("c"))


def convention(weights_: DataFrame, inside: bool) -> DataFrame:
    """log weights with p! taken in (inside) or out."""
    lf = F.sum(F.when(F.col("p") > 0, F.log("p")).otherwise(0.0)).over(by_p().rowsBetween(Window.unboundedPreceding, 0))
    return weights_.withColumn("log_w", F.col("log_w") + lf * (1 if inside else -1))


def first_concavity(ratios_: DataFrame, tol: float = 1e-12) -> DataFrame:
    """(seq_id, p): the first p whose ratio the next one falls below; null where the weights are log-convex."""
    fall = ratios_.withColumn("_x", F.lead("log_m").over(by_p()) < F.col("log_m") - tol)
    return fall.groupBy("seq_id").agg(F.min(F.when(F.col("_x"), F.col("p"))).alias("p"))


def dc_constant(ratios_: DataFrame) -> DataFrame:
    """(seq_id, dc, p): e to the largest log_m / (p + 1), and where it is first."""
    x = F.struct((F.col("log_m") / (F.col("p") + 1)).alias("v"), (-F.col("p")).alias("q"))
    return ratios_.groupBy("seq_id").agg(F.max(x).alias("x")).select("seq_id", F.exp("x.v").alias("dc"), (-F.col("x.q")).alias("p"))


def mg_constant(weights_: DataFrame) -> DataFrame:
    """(seq_id, mg, p, q): e to the largest (log_w(p+q) - log_w(p) - log_w(q)) / (p + q), p <= q, and where it is first.

    By its definition this looks at all p and q with p + q <= N; each p gives only its own q, which meet by (seq_id, q).
    """
    ends = weights_.groupBy("seq_id").agg(F.max("p").alias("_n"))
    a = weights_.join(ends, "seq_id").where((F.col("p") * 2 <= F.col("_n")) & (F.col("_n") >= 1)).select("seq_id", F.col("p").cast("int").alias("p"), F.col("log_w").alias("_wp"), F.explode(F.sequence(F.greatest(F.col("p"), F.lit(1)).cast("int"), (F.col("_n") - F.col("p")).cast("int"))).alias("q"))
    b = weights_.select("seq_id", F.col("p").cast("int").alias("q"), F.col("log_w").alias("_wq"))
    c = weights_.select("seq_id", F.col("p").cast("int").alias("_s"), F.col("log_w").alias("_ws"))
    pairs = a.join(b, ["seq_id", "q"]).withColumn("_s", F.col("p") + F.col("q")).join(c, ["seq_id", "_s"])
    best = F.max(F.struct(F.round((F.col("_ws") - F.col("_wp") - F.col("_wq")) / F.col("_s"), 12).alias("v"), (-F.col("p")).alias("p"), (-F.col("q")).alias("q")))
    return pairs.groupBy("seq_id").agg(best.alias("x")).select("seq_id", F.exp("x.v").alias("mg"), (-F.col("x.p")).alias("p"), (-F.col("x.q")).alias("q"))


def omega_index(ratios_: DataFrame) -> DataFrame:
    """(seq_id, omega): the least log_m / ln p over the later half."""
    last = ratios_.withColumn("_n", F.max("p").over(Window.partitionBy("seq_id")))
    return last.where(F.col("p") >= F.greatest(F.lit(2), F.floor(F.col("_n") / 2))).groupBy("seq_id").agg(F.min(F.col("log_m") / F.log("p")).alias("omega"))


def gamma1_constant(ratios_: DataFrame, margin: int = 40, least: int = 10) -> DataFrame:
    """(seq_id, g1, p, reliable): the largest m_p times the tail of 1 / ((q + 1) m_q), q >= p, where it is first.

    The last ``margin`` p are left out, as their tails are cut; sequences that leave fewer than ``least`` have no row.
    It is reliable where the tail there is below a thousandth of the whole.
    """
    tail = F.sum(F.exp(-F.col("log_m")) / (F.col("p") + 1)).over(from_p())
    x = ratios_.withColumn("_tail", tail).withColumn("_n", F.max("p").over(Window.partitionBy("seq_id")) + 1 - margin).where(F.col("_n") >= least)
    best = F.max(F.when(F.col("p") < F.col("_n"), F.struct((F.col("_tail") * F.exp("log_m")).alias("v"), (-F.col("p")).alias("p"))))
    at = lambda p: F.max(F.when(F.col("p") == p, F.col("_tail")))
    out = x.groupBy("seq_id").agg(best.alias("x"), at(F.lit(0)).alias("_all"), F.coalesce(at(F.col("_n")), F.lit(0.0)).alias("_rest"))
    return out.select("seq_id", F.col("x.v").alias("g1"), (-F.col("x.p")).alias("p"), (F.col("_rest") < F.col("_all") / 1000).alias("reliable"))


def almost_increasing(values: DataFrame, value: str) -> DataFrame:
    """(seq_id, c): the largest quotient of a value and a later one."""
    return values.withColumn("_l", F.min(value).over(from_p())).groupBy("seq_id").agg(F.max(F.col(value) / F.col("_l")).alias("c"))


def associated(weights_: DataFrame, points: DataFrame, most: int = 10_000) -> DataFrame:
    """(seq_id, log_t, omega, log_h): sup of p log t - log_w and inf of log_w + p log t. points: log_t, at most ``most``, sent to all tasks."""
    if points.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} points")
    both = weights_.crossJoin(F.broadcast(points))
    at = F.col("p") * F.col("log_t")
    return both.groupBy("seq_id", "log_t").agg(F.max(at - F.col("log_w")).alias("omega"), F.min(F.col("log_w") + at).alias("log_h"))


def ratio_fit(series: DataFrame) -> DataFrame:
    """(series_id, slope, offset) of ln |c(n+1) / c(n)| on ln n, n >= 1."""
    w = Window.partitionBy("series_id").orderBy("n")
    x = series.where("c <> 0 and n >= 1").withColumn("_y", F.log(F.abs(F.lead("c").over(w) / F.col("c")))).withColumn("_x", F.log("n"))
    return x.where("_y is not null").groupBy("series_id").agg(F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("offset"))


def tail(series: DataFrame) -> DataFrame:
    """The rows of series from the later of 4 and half of the last n with c <> 0 on, c <> 0, with their place ``_i`` in it and number ``_m``."""
    known = series.where("c <> 0").withColumn("_n", F.max("n").over(Window.partitionBy("series_id"))).where(F.col("n") >= F.greatest(F.lit(4), F.floor(F.col("_n") / 2)))
    return known.withColumn("_i", F.row_number().over(Window.partitionBy("series_id").orderBy("n"))).withColumn("_m", F.count("*").over(Window.partitionBy("series_id")))


def tail_fit(series: DataFrame, least: int = 6) -> DataFrame:
    """(series_id, alpha, log_a, offset, residual, low, high, points) of ln |c| = alpha n ln n + n log_a + offset on the tail.

    low and high: alpha on the tail's halves, where these have four points at least, else on all. By centred sums.
    Series with fewer than ``least`` points in the tail have no row.
    """
    x = tail(series).select("series_id", "_i", F.col("_m").alias("m"), (F.col("n") * F.log("n")).alias("u"), F.col("n").cast("double").alias("v"), F.log(F.abs("c")).alias("y")).where(F.col("m") >= least)
    half = F.floor(F.col("m") / 2)
    parts = {"all": F.lit(True), "one": F.col("_i") <= half, "two": F.col("_i") > half}
    sums = [F.count("*").alias("points"), F.avg("u").alias("_u"), F.avg("v").alias("_v"), F.avg("y").alias("_y")]
    for name, cond in parts.items():
        own = {c: F.when(cond, F.col(c)) for c in "uvy"}
        sums += [F.covar_pop(own[a], own[b]).alias(f"{name}_{a}{b}") for a, b in ("uu", "vv", "uv", "uy", "vy", "yy")]
        sums.append(F.count_if(cond).alias(f"{name}_n"))
    g = x.groupBy("series_id").agg(*sums)
    at = lambda name, ab: F.col(f"{name}_{ab}")
    det = lambda k: at(k, "uu") * at(k, "vv") - at(k, "uv") * at(k, "uv")
    alpha = lambda k: (at(k, "uy") * at(k, "vv") - at(k, "vy") * at(k, "uv")) / det(k)
    whole, slope = alpha("all"), (at("all", "vy") * at("all", "uu") - at("all", "uy") * at("all", "uv")) / det("all")
    one, two = (F.when(at(k, "n") >= 4, alpha(k)).otherwise(whole) for k in ("one", "two"))
    rest = at("all", "yy") - whole * at("all", "uy") - slope * at("all", "vy")
    return g.select("series_id", whole.alias("alpha"), slope.alias("log_a"), (F.col("_y") - whole * F.col("_u") - slope * F.col("_v")).alias("offset"), F.sqrt(F.greatest(rest, F.lit(0.0))).alias("residual"), F.least(one, two).alias("low"), F.greatest(one, two).alias("high"), "points")


def growth_report(series: DataFrame) -> DataFrame:
    """Each series' tail fit beside the fit of its ratios and its last n."""
    last = series.where("c <> 0").groupBy("series_id").agg(F.max("n").alias("n"))
    return last.join(tail_fit(series), "series_id", "left").join(ratio_fit(series), "series_id", "left")


def compared_growth(series: DataFrame, weights_: DataFrame) -> DataFrame:
    """(series_id, sup, slope): of c_n = (|c| / M_n)^(1/n), the largest over the later half and the slope of ln c_n on ln n."""
    w = weights_.select(F.col("seq_id").alias("series_id"), F.col("p").alias("n"), "log_w")
    x = series.where("c <> 0 and n >= 1").join(w, ["series_id", "n"]).withColumn("_l", (F.log(F.abs("c")) - F.col("log_w")) / F.col("n")).withColumn("_n", F.max("n").over(Window.partitionBy("series_id")))
    return x.groupBy("series_id").agg(F.max(F.when(F.col("n") * 2 >= F.col("_n"), F.exp("_l"))).alias("sup"), F.regr_slope("_l", F.log("n")).alias("slope"))


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cauchy product of series of one id, to the order of the shorter one."""
    left = a.select("series_id", F.col("n").alias("i"), F.col("c").alias("x"))
    right = b.select("series_id", F.col("n").alias("j"), F.col("c").alias("y"))
    ends = a.groupBy("series_id").agg(F.max("n").alias("e")).join(b.groupBy("series_id").agg(F.max("n").alias("f")), "series_id").select("series_id", F.least("e", "f").alias("end"))
    both = left.join(right, "series_id").join(ends, "series_id").where(F.col("i") + F.col("j") <= F.col("end"))
    return both.groupBy("series_id", (F.col("i") + F.col("j")).alias("n")).agg(F.sum(F.col("x") * F.col("y")).alias("c"))


def total(a: DataFrame, b: DataFrame, sign: int = 1) -> DataFrame:
    """Sum (or, by sign, difference) of series of one id, to the order of the shorter one."""
    return a.join(b.select("series_id", "n", F.col("c").alias("_c")), ["series_id", "n"]).select("series_id", "n", (F.col("c") + sign * F.col("_c")).alias("c"))


def derivative(series: DataFrame) -> DataFrame:
    return series.where("n >= 1").select("series_id", (F.col("n") - 1).alias("n"), (F.col("n") * F.col("c")).alias("c"))


def negated(series: DataFrame) -> DataFrame:
    return scaled(series, -1.0)


def scaled(series: DataFrame, by: float) -> DataFrame:
    return series.withColumn("c", F.col("c") * by)


def truncated(series: DataFrame, n: int) -> DataFrame:
    """series up to order n."""
    return series.where(F.col("n") <= n)


def coefficients(series: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (series_id, n) with the coefficient ``c``, 0 where there is none."""
    return wanted.join(series.select("series_id", "n", "c"), ["series_id", "n"], "left").withColumn("c", F.coalesce("c", F.lit(0.0)))


def dense(series: DataFrame, order: int) -> DataFrame:
    """(series_id, c): an array of the coefficients 0..order of each series; order is the operation's, so arrays are of one length."""
    found = F.map_from_entries(F.collect_list(F.when(F.col("n").between(0, order), F.struct("n", F.col("c").cast("double").alias("c")))))
    return series.groupBy("series_id").agg(found.alias("_m")).select("series_id", F.transform(F.sequence(F.lit(0), F.lit(order)), lambda n: F.coalesce(F.try_element_at("_m", n), F.lit(0.0))).alias("c"))


def sparse(df: DataFrame) -> DataFrame:
    """A row (series_id, n, c) for each coefficient of arrays (series_id, c)."""
    return df.select("series_id", F.posexplode("c").alias("n", "c"))


def convolved(a: Column, b: Column) -> Column:
    """Cauchy product of two arrays of one length, to that length."""
    upto = lambda n: F.sequence(F.lit(0), n)
    return F.transform(a, lambda _, n: F.aggregate(upto(n), F.lit(0.0), lambda s, i: s + F.get(a, i) * F.get(b, n - i)))


def unit(c: Column) -> Column:
    return F.transform(c, lambda _, i: F.when(i == 0, F.lit(1.0)).otherwise(0.0))


def power(c: Column, k: int) -> Column:
    """The k-th power of an array's series, k >= 0, by repeated products."""
    return F.aggregate(F.array_repeat(F.lit(0), k), unit(c), lambda acc, _: convolved(acc, c))


def composed(f: Column, g: Column) -> Column:
    """f(g(z)) of arrays, from the highest coefficient of f down; fails where g(0) isn't 0."""
    start = F.transform(f, lambda x: F.lit(0.0))
    out = F.aggregate(F.reverse(f), start, lambda acc, x: F.transform(convolved(acc, g), lambda v, i: v + F.when(i == 0, x).otherwise(0.0)))
    return F.when(F.get(g, F.lit(0)) == 0, out).otherwise(F.raise_error(F.lit("a composed series must vanish at 0")).cast("array<double>"))


def divided(a: Column, b: Column) -> Column:
    """a / b of arrays, a coefficient after the other; null where b(0) is 0."""
    step = lambda q, n: F.concat(q, F.array((F.get(a, n) - F.aggregate(F.sequence(F.lit(0), n), F.lit(0.0), lambda s, i: s + F.coalesce(F.get(q, i) * F.get(b, n - i), F.lit(0.0)))) / F.get(b, F.lit(0))))
    return F.when(F.get(b, F.lit(0)) != 0, F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), F.array().cast("array<double>"), step))


def borel(series: DataFrame) -> DataFrame:
    """(series_id, n, sign, log_b): c_n / n! by sign and logarithm of the absolute value; ln n! is a running sum."""
    w = Window.partitionBy("series_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    lf = F.sum(F.when(F.col("n") > 0, F.log("n")).otherwise(0.0)).over(w)
    return series.withColumn("_f", lf).where("c <> 0").select("series_id", "n", F.signum("c").cast("int").alias("sign"), (F.log(F.abs("c")) - F.col("_f")).alias("log_b"))


def series_orders(coefs: DataFrame) -> DataFrame:
    """(poly_id, i, o, lc): where the i-th coefficient series (poly_id, i, n, c) begins, and with what; none where it is 0."""
    return coefs.where("c <> 0").groupBy("poly_id", "i").agg(F.min("n").alias("o"), F.min_by("c", "n").alias("lc"))


def derivative_in_y(coefs: DataFrame) -> DataFrame:
    """The derivative by y of polynomials (poly_id, i, n, c), i the power of y."""
    return coefs.where("i >= 1").select("poly_id", (F.col("i") - 1).alias("i"), "n", (F.col("i") * F.col("c")).alias("c"))


def newton_edges(points: DataFrame) -> DataFrame:
    """(poly_id, i, j, oi, oj, mu, on_edge): edges of the lower hull of points (poly_id, i, o), mu = (oi - oj) / (j - i).

    A point is a corner where it rises more steeply to all later points than from all earlier ones; on_edge has the i
    of all points on the edge. All pairs of one polynomial's points are looked at; it has few.
    """
    a = points.select("poly_id", "i", F.col("o").alias("oi"))
    b = points.select("poly_id", F.col("i").alias("j"), F.col("o").alias("oj"))
    pairs = a.join(b, "poly_id").where("i <> j").withColumn("_s", (F.col("oj") - F.col("oi")) / (F.col("j") - F.col("i")))
    turn = pairs.groupBy("poly_id", "i", "oi").agg(F.max(F.when(F.col("j") < F.col("i"), F.col("_s"))).alias("_in"), F.min(F.when(F.col("j") > F.col("i"), F.col("_s"))).alias("_out"))
    w = Window.partitionBy("poly_id").orderBy("i")
    below = turn.where("_in is null or _out is null or _in <= _out").withColumn("_corner", F.expr("_in is null or _out is null or _in < _out"))
    # what lies on the hull without being a corner belongs to the corner before it
    edge = below.withColumn("_e", F.sum(F.col("_corner").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    edges = edge.groupBy("poly_id", "_e").agg(F.min("i").alias("i"), F.min_by("oi", "i").alias("oi"), F.array_sort(F.collect_list("i")).alias("_on"))
    w2 = Window.partitionBy("poly_id").orderBy("_e")
    out = edges.withColumn("j", F.lead("i").over(w2)).withColumn("oj", F.lead("oi").over(w2)).where("j is not null")
    return out.select("poly_id", "i", "j", "oi", "oj", ((F.col("oi") - F.col("oj")) / (F.col("j") - F.col("i"))).alias("mu"), F.concat("_on", F.array("j")).alias("on_edge"))


def characteristic(edges: DataFrame, orders: DataFrame) -> DataFrame:
    """(poly_id, i, power, lc): for each edge, by its first i, the coefficients of its characteristic polynomial."""
    on = edges.select("poly_id", F.col("i").alias("edge"), F.explode("on_edge").alias("i"))
    return on.join(orders.select("poly_id", "i", "lc"), ["poly_id", "i"]).select("poly_id", F.col("edge").alias("i"), F.col("i").alias("power"), "lc")


def pade_orders(n: int) -> list[int]:
    """Orders of the diagonal approximants that a series of order n allows."""
    # Fixed values.
    return [m for m in (2, 3, 4, 5, 6, 8, 10, 12) if 2 * m + 1 <= n + 1]


def stable_poles(poles: DataFrame, tol: float = 1e-3, votes: int = 3) -> DataFrame:
    """(series_id, re, im, votes) of poles (series_id, ord, re, im) that come back in several orders: means of near ones.

    Poles meet by squares of a grid, so only those near each other are compared. One of them stands for those near it:
    the first, by order, then real and imaginary part, of those with ``votes`` orders (or all, where there are fewer).
    """
    size = tol * F.greatest(F.lit(1.0), F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")))
    z = poles.select("series_id", "ord", "re", "im", size.alias("size")).withColumn("n_ord", F.size(F.collect_set("ord").over(Window.partitionBy("series_id"))))
    # a pole's square has at least its reach as side: all poles of a power of two of sizes share one grid
    level = F.ceil(F.log2(F.col("size") / tol)).cast("int")
    z = z.withColumn("level", level).withColumn("id", F.struct("ord", "re", "im"))
    side = tol * F.pow(F.lit(2.0), F.col("l"))
    cell = lambda c: F.floor(F.col(c) / side).cast("long")
    reach = F.array(F.lit(-1), F.lit(0), F.lit(1))
    # the neighbours of a pole may be a level above or below
    own = z.withColumn("l", F.col("level")).select("*", cell("re").alias("_x"), cell("im").alias("_y")).select("*", F.explode(reach).alias("_i")).select("*", F.explode(reach).alias("_j")).withColumn("_x", F.col("_x") + F.col("_i")).withColumn("_y", F.col("_y") + F.col("_j"))
    other = z.select("series_id", F.col("ord").alias("o2"), F.col("re").alias("re2"), F.col("im").alias("im2"), "re", "im", F.explode(F.array(F.col("level") - 1, F.col("level"), F.col("level") + 1)).alias("l")).select("series_id", "o2", "re2", "im2", "l", cell("re").alias("_x"), cell("im").alias("_y"))
    gap = F.sqrt(F.pow(F.col("re") - F.col("re2"), 2) + F.pow(F.col("im") - F.col("im2"), 2))
    near = own.join(other, ["series_id", "l", "_x", "_y"]).where(gap < F.col("size"))
    voted = near.groupBy("series_id", "id", "size", "n_ord").agg(F.count_distinct("o2").alias("votes"), F.avg("re2").alias("mre"), F.avg("im2").alias("mim"), F.collect_set(F.struct(F.col("o2").alias("ord"), F.col("re2").alias("re"), F.col("im2").alias("im"))).alias("_near"))
    voted = voted.where(F.col("votes") >= F.least(F.lit(votes), F.col("n_ord")))
    known = voted.select("series_id", F.col("id").alias("_n"))
    earlier = voted.select("series_id", "id", F.explode("_near").alias("_n")).join(known, ["series_id", "_n"]).where(F.col("_n") < F.col("id")).select("series_id", "id").distinct()
    return voted.join(earlier, ["series_id", "id"], "left_anti").select("series_id", F.col("mre").alias("re"), F.col("mim").alias("im"), "votes")


def sweep(rows: DataFrame, grid: DataFrame, holds: Column, order: list[str], most: int = 5, points: int = 1000) -> DataFrame:
    """For each point of a grid (at most ``points``, sent to all tasks) the first rows that refute a condition on both, with their place ``k``."""
    if grid.limit(points + 1).count() > points:
        raise ValueError(f"more than {points} points")
    both = rows.crossJoin(F.broadcast(grid)).where(~F.coalesce(holds, F.lit(False)))
    w = Window.partitionBy(*grid.columns).orderBy(*order)
    return both.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)


def counterexamples(rows: DataFrame, predicate: Column | str, order: list[str], most: int = 5) -> DataFrame:
    """The first rows, in order, where a predicate isn't true; where it fails or is null it isn't."""
    holds = F.expr(predicate) if isinstance(predicate, str) else predicate
    return rows.where(~F.coalesce(holds, F.lit(False))).orderBy(*order).limit(most)


def by_series(series: DataFrame, schema: str, work: Callable[[list[Fraction]], list[tuple]]) -> DataFrame:
    """work on each series' exact coefficients (num, den as strings), missing ones 0; rows as schema after series_id."""

    def exact(_, rows) -> list[tuple]:
        c = [Fraction(0)] * (int(rows[-1]["n"]) + 1)
        for x in rows:
            c[int(x["n"])] = Fraction(int(x["num"]), int(x["den"]))
        return work(c)

    return by_group(series, "series_id", ["n", "num", "den"], schema, exact)


def inverse(series: DataFrame) -> DataFrame:
    """1 / series, exact, to the same order; nothing where the constant term is 0."""

    def work(c):
        if not c[0]:
            return []
        out = [1 / c[0]]
        for n in range(1, len(c)):
            out.append(-sum(c[k] * out[n - k] for k in range(1, n + 1)) / c[0])
        return [(n, str(x.numerator), str(x.denominator)) for n, x in enumerate(out)]

    return by_series(series, "n int, num string, den string", work)


def euler_sum(points: DataFrame, z: str = "z", nodes: int = 40) -> DataFrame:
    """points with ``value``: the Laplace integral of 1 / (1 + z t) by Gauss-Laguerre quadrature, for z > 0."""
    t, w = np.polynomial.laguerre.laggauss(nodes)
    terms = F.array(*[F.struct(F.lit(float(a)).alias("t"), F.lit(float(b)).alias("w")) for a, b in zip(t, w)])
    return points.withColumn("value", F.aggregate(terms, F.lit(0.0), lambda s, x: s + x["w"] / (1 + F.col(z) * x["t"])))


