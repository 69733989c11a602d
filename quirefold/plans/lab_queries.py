"""Queries of the numerical laboratory and their SQL. Sequences and series come from the orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.operators import lab as L
from quirefold.sources.tables import table


def _ratios(spark: SparkSession, sf: str) -> DataFrame:
    """A sequence for each customer: log_m is the logarithm of its p-th order's price, in order of keys."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    orders = table(spark, sf, "orders").where("o_totalprice > 0")
    return orders.select(F.col("o_custkey").alias("seq_id"), (F.row_number().over(w) - 1).cast("int").alias("p"), F.log("o_totalprice").alias("log_m"))


def _series(spark: SparkSession, sf: str, value: str) -> DataFrame:
    """A series for each order: coefficients by line."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("series_id"), (F.row_number().over(w) - 1).cast("int").alias("n"), F.col(value).alias("c"))


def _prices(spark: SparkSession, sf: str) -> DataFrame:
    """A series for each customer: its orders' prices by order."""
    return _ratios(spark, sf).select(F.col("seq_id").alias("series_id"), F.col("p").alias("n"), F.exp("log_m").alias("c"))


def _long_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """A sequence for each supplier: ln(p + 1) and the tax of its p-th line item."""
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_tax")
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("seq_id"), (F.row_number().over(w) - 1).cast("int").alias("p"), "l_tax")
    return rows.select("seq_id", "p", (F.log(F.col("p") + F.lit(1.0)) + F.col("l_tax")).alias("log_m"))


def _long_series(spark: SparkSession, sf: str) -> DataFrame:
    """Series whose n-th coefficient grows like (n / 3)^n, without its exponential part: ln |c_n| would be beyond a double's range."""
    return _long_ratios(spark, sf).select(F.col("seq_id").alias("series_id"), F.col("p").alias("n"), F.exp("log_m").alias("c"))


def weight_sums(spark, sf):
    return L.weights(_ratios(spark, sf)).select("seq_id", "p", F.round("log_w", 6).alias("log_w"))


def log_convex(spark, sf):
    return L.first_concavity(_ratios(spark, sf))


def dc_constant(spark, sf):
    return L.dc_constant(_ratios(spark, sf)).select("seq_id", F.round("dc", 6).alias("dc"), "p")


def mg_constant(spark, sf):
    return L.mg_constant(L.weights(_ratios(spark, sf))).select("seq_id", F.round("mg", 6).alias("mg"))


def omega_index(spark, sf):
    return L.omega_index(_ratios(spark, sf)).select("seq_id", F.round("omega", 6).alias("omega"))


def gamma1_tail(spark, sf):
    return L.gamma1_constant(_long_ratios(spark, sf)).select("seq_id", F.round("g1", 6).alias("g1"), "p", "reliable")


def almost_increasing(spark, sf):
    return L.almost_increasing(_ratios(spark, sf), "log_m").select("seq_id", F.round("c", 6).alias("c"))


def associated_fn(spark, sf):
    """At the logarithms of all retail prices' powers of ten."""
    points = table(spark, sf, "part").select(F.floor(F.log("p_retailprice")).cast("double").alias("log_t")).distinct()
    return L.associated(L.weights(_ratios(spark, sf)), points).select("seq_id", "log_t", F.round("omega", 6).alias("omega"), F.round("log_h", 6).alias("log_h"))


def convention_switch(spark, sf):
    w = L.weights(_ratios(spark, sf))
    back = L.convention(L.convention(w, True), False).select("seq_id", "p", F.round("log_w", 6).alias("back"))
    return L.convention(w, True).select("seq_id", "p", F.round("log_w", 6).alias("inside")).join(back, ["seq_id", "p"])


def weights_panel(spark, sf):
    """All constants of each sequence's first 150 and first 300 ratios in a row."""
    cut = _long_ratios(spark, sf).withColumn("n", F.explode(F.array(F.lit(150), F.lit(300)))).where("p < n")
    r = cut.select(F.struct(F.col("seq_id").alias("id"), "n").alias("seq_id"), "p", "log_m")
    w = L.weights(r)
    parts = [L.dc_constant(r).select("seq_id", "dc"), L.mg_constant(w).select("seq_id", "mg"), L.omega_index(r), L.gamma1_constant(r).select("seq_id", "g1", "reliable"), L.first_concavity(r).withColumnRenamed("p", "concave_at")]
    out = r.select("seq_id").distinct()
    for x in parts:
        out = out.join(x, "seq_id", "left")
    return out.select("seq_id.id", "seq_id.n", *[F.round(c, 6).alias(c) for c in ("dc", "mg", "omega", "g1")], "reliable", "concave_at")


def growth_ratio_fit(spark, sf):
    fit = L.ratio_fit(_prices(spark, sf))
    return fit.select("series_id", F.round("slope", 5).alias("slope"), F.round("offset", 5).alias("offset"))


def growth_tail_fit(spark, sf):
    fit = L.tail_fit(_long_series(spark, sf))
    return fit.select("series_id", *[(F.round(c, 4) + 0.0).alias(c) for c in ("alpha", "log_a", "offset", "residual", "low", "high")], F.col("points").cast("long").alias("points"))


def growth_report(spark, sf):
    """Tail fit and fit of ratios side by side."""
    out = L.growth_report(_long_series(spark, sf))
    return out.select("series_id", F.col("n").cast("int").alias("n"), *[(F.round(c, 4) + 0.0).alias(c) for c in ("alpha", "low", "high", "slope")])


def roumieu_beurling(spark, sf):
    """Growth of each customer's prices against the weights made of them."""
    found = L.compared_growth(_prices(spark, sf), L.weights(_ratios(spark, sf)))
    return found.select("series_id", F.round("sup", 6).alias("sup"), F.round("slope", 5).alias("slope"))


def cauchy_product(spark, sf):
    made = L.product(_series(spark, sf, "l_quantity"), _series(spark, sf, "l_discount"))
    return made.select("series_id", "n", F.round("c", 4).alias("c"))


def series_sums(spark, sf):
    """Sum and difference of two series of an order, and the sum's derivative."""
    a, b = _series(spark, sf, "l_quantity"), _series(spark, sf, "l_tax")
    plus, minus = L.total(a, b), L.total(a, b, -1).withColumnRenamed("c", "minus")
    slope = L.derivative(plus).withColumnRenamed("c", "slope")
    return plus.join(minus, ["series_id", "n"]).join(slope, ["series_id", "n"], "left").select("series_id", "n", *[F.round(c, 4).alias(c) for c in ("c", "minus", "slope")])


def borel_coeffs(spark, sf):
    return L.borel(_series(spark, sf, "l_extendedprice")).select("series_id", "n", "sign", F.round("log_b", 6).alias("log_b"))


def _coefs(spark, sf):
    """Polynomials in y, whose coefficients are series: for each line of an order one that begins at its quantity modulo 7."""
    rows = _series(spark, sf, "l_quantity").select(F.col("series_id").alias("poly_id"), F.col("n").alias("i"), F.col("c").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("n"))
    return rows.select("poly_id", "i", "n", F.when(F.col("n") >= F.col("q") % 7, F.col("q") + F.col("n")).otherwise(0.0).alias("c"))


def newton_edges(spark, sf):
    """Polygons of the orders' polynomials."""
    edges = L.newton_edges(L.series_orders(_coefs(spark, sf)))
    return edges.select("poly_id", "i", "j", F.round("mu", 6).alias("mu"), F.array_join("on_edge", ",").alias("on_edge"))


def newton_characteristic(spark, sf):
    orders = L.series_orders(_coefs(spark, sf))
    return L.characteristic(L.newton_edges(orders), orders).select("poly_id", "i", "power", F.round("lc", 6).alias("lc"))


def poly_derivative(spark, sf):
    return L.derivative_in_y(_coefs(spark, sf)).where("c <> 0").select("poly_id", "i", "n", F.round("c", 6).alias("c"))


def _pairs(spark, sf, order):
    """Arrays a (quantities) and b (discounts, 0 at 0) of each order, to an order."""
    a = L.dense(_series(spark, sf, "l_quantity"), order).withColumnRenamed("c", "a")
    b = L.dense(_series(spark, sf, "l_discount").where("n > 0"), order).withColumnRenamed("c", "b")
    return a.join(b, "series_id", "left").withColumn("b", F.coalesce("b", F.array_repeat(F.lit(0.0), order + 1)))


def series_power(spark, sf):
    """Cubes of the orders' series, to order 6."""
    cubes = L.dense(_series(spark, sf, "l_tax"), 6).withColumn("c", L.power(F.col("c"), 3))
    return L.sparse(cubes).select("series_id", "n", F.round("c", 9).alias("c"))


def series_composition(spark, sf):
    """One series of an order at another, to order 3."""
    made = _pairs(spark, sf, 3).select("series_id", L.composed(F.col("a"), F.col("b")).alias("c"))
    return L.sparse(made).select("series_id", "n", F.round("c", 6).alias("c"))


def series_quotient(spark, sf):
    """One series of an order by another, to order 3; prices by quantities."""
    a = L.dense(_series(spark, sf, "l_extendedprice"), 3).withColumnRenamed("c", "a")
    b = L.dense(_series(spark, sf, "l_quantity"), 3).withColumnRenamed("c", "b")
    made = a.join(b, "series_id").select("series_id", L.divided(F.col("a"), F.col("b")).alias("c"))
    return L.sparse(made).where("c <> 0").select("series_id", "n", F.signum("c").cast("int").alias("sign"), F.round(F.log(F.abs("c")), 6).alias("log_c"))


def series_simple(spark, sf):
    """Negation, a multiple and the first three coefficients, those that aren't there as 0."""
    rows = _series(spark, sf, "l_quantity")
    wanted = rows.select("series_id").distinct().withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(2))))
    out = L.coefficients(L.truncated(rows, 1), wanted)
    minus = L.negated(out).withColumnRenamed("c", "minus")
    third = L.scaled(out, 1 / 3).withColumnRenamed("c", "third")
    return out.join(minus, ["series_id", "n"]).join(third, ["series_id", "n"]).select("series_id", "n", "c", F.round("minus", 4).alias("minus"), F.round("third", 4).alias("third"))


def _kinds(spark, sf, kinds):
    """A sequence of one of the kinds for each supplier."""
    names = F.array(*[F.lit(k) for k in kinds])
    a = F.col("s_nationkey") % 4 / F.lit(2.0) + 1.5
    return table(spark, sf, "supplier").select("s_suppkey", F.element_at(names, (F.col("s_suppkey") % len(kinds) + 1).cast("int")).alias("kind"), a.alias("a"), (F.col("s_nationkey") % 3).cast("double").alias("b"))


def weight_catalogue(spark, sf):
    ids = _kinds(spark, sf, [*L.CATALOGUE, *L.RATIO_CATALOGUE]).withColumnRenamed("s_suppkey", "seq_id")
    made = L.weight_values(L.catalogue(ids, 20))
    return made.select("seq_id", "p", F.round("log_w", 6).alias("log_w"), F.round(F.log("value"), 6).alias("log_value"))


def grown_series(spark, sf):
    """Series of prescribed growth whose noise comes from line items' taxes."""
    ids = _kinds(spark, sf, list(L.GROWTH)).withColumnRenamed("s_suppkey", "series_id")
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_tax")
    noise = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("series_id"), (F.row_number().over(w) - 1).cast("int").alias("n"), (0.5 + F.col("l_tax") * 15).alias("eps")).where("n <= 50")
    return L.grown_series(ids, noise).select("series_id", "n", "sign", F.round("log_c", 6).alias("log_c"))


def closed_series(spark, sf):
    """Euler's and Catalan's series by the orders' numbers of lines."""
    n = _series(spark, sf, "l_quantity").select("series_id", "n")
    euler = L.euler_series(n).withColumn("kind", F.lit("euler"))
    return euler.unionByName(L.catalan_series(n).withColumn("kind", F.lit("catalan"))).select("series_id", "n", "kind", "sign", F.round("log_c", 6).alias("log_c"))


def series_from_poles(spark, sf):
    """Poles of an order: its lines' quantities, with their taxes as residues."""
    poles = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("series_id"), (F.col("l_quantity") + 0.5).alias("zeta"), F.col("l_tax").alias("r"))
    return L.series_from_poles(poles, 5).select("series_id", "n", F.round("c", 9).alias("c"))


def _poles(spark, sf):
    """Points of a part: an order for each shipping mode of number, the plane by discount and tax."""
    rows = table(spark, sf, "lineitem")
    return rows.select(F.col("l_partkey").alias("series_id"), (F.col("l_linenumber") % 4).cast("int").alias("ord"), (F.col("l_discount") * 20 + 0.5).alias("re"), (F.col("l_tax") * 10 - 0.4).alias("im")).distinct()


def stable_poles(spark, sf):
    found = L.stable_poles(_poles(spark, sf), 0.15, 3)
    return found.select("series_id", F.round("re", 6).alias("re"), F.round("im", 6).alias("im"), F.col("votes").cast("long").alias("votes"))


def refutation_sweep(spark, sf):
    """For bounds on the price per piece that follow from the regions' numbers, the first line items that refute them."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    grid = table(spark, sf, "region").select((F.col("r_regionkey") * 10000 + 30000).cast("long").alias("bound"))
    found = L.sweep(rows, grid, (F.col("l_extendedprice") < F.col("bound")) | (F.col("l_quantity") > 45), ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])
    return found.select("bound", F.col("k").cast("int").alias("k"), "l_orderkey", "l_linenumber")


def _exact(spark, sf):
    return _series(spark, sf, "l_quantity").select("series_id", "n", F.when(F.col("n") == 0, 1).otherwise(F.col("c")).cast("long").cast("string").alias("num"), F.lit("1").alias("den"))


def series_inverse(spark, sf):
    """Exact inverses of the orders' series with constant term 1."""
    return L.inverse(_exact(spark, sf))


def laplace_sum(spark, sf):
    points = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", (F.col("l_tax") + 0.01).alias("z"))
    return L.euler_sum(points).select("l_orderkey", "l_linenumber", "l_tax", F.round("value", 7).alias("value"))


QUERIES = {f.__name__: f for f in (weight_sums, log_convex, dc_constant, mg_constant, omega_index, gamma1_tail, almost_increasing, associated_fn, convention_switch, weights_panel, growth_ratio_fit, growth_tail_fit, roumieu_beurling, cauchy_product, series_sums, borel_coeffs, growth_report, newton_edges, newton_characteristic, poly_derivative, series_power, series_composition, series_quotient, series_simple, weight_catalogue, grown_series, closed_series, series_from_poles, stable_poles, refutation_sweep, series_inverse, laplace_sum)}

_R = "r AS (SELECT o_custkey AS seq_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS p, ln(o_totalprice) AS log_m, o_totalprice AS c FROM orders WHERE o_totalprice > 0)"
_W = _R + ", w AS (SELECT seq_id, p, coalesce(sum(log_m) OVER (PARTITION BY seq_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS log_w FROM r)"
_MG = "mx AS (SELECT seq_id, max(p) AS e FROM w GROUP BY ALL), mv AS (SELECT a.seq_id, a.p, b.p AS q, round((s.log_w - a.log_w - b.log_w) / s.p, 12) AS v FROM w a JOIN w b ON a.seq_id = b.seq_id AND a.p <= b.p AND b.p >= 1 JOIN w s ON s.seq_id = a.seq_id AND s.p = a.p + b.p), mg AS (SELECT seq_id, exp(v) AS mg, p, q FROM mv QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY v DESC, p, q) = 1)"
_OM = "om AS (SELECT seq_id, min(log_m / ln(p)) AS omega FROM (SELECT *, max(p) OVER (PARTITION BY seq_id) AS n FROM r) WHERE p >= greatest(2, n // 2) GROUP BY ALL)"
_G1 = "gt AS (SELECT seq_id, p, log_m, sum(exp(-log_m) / (p + 1)) OVER (PARTITION BY seq_id ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t, max(p) OVER (PARTITION BY seq_id) - 39 AS n FROM r), gr AS (SELECT seq_id, coalesce(max(t) FILTER (p = n), 0) < max(t) FILTER (p = 0) / 1000 AS reliable FROM gt WHERE n >= 10 GROUP BY seq_id), g1 AS (SELECT seq_id, t * exp(log_m) AS g1, p, reliable FROM gt JOIN gr USING (seq_id) WHERE p < n QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY t * exp(log_m) DESC, p) = 1)"
_LINE = "l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount, l_tax"
_LONG = f"z AS (SELECT l_suppkey AS seq_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY {_LINE}) - 1 AS INTEGER) AS p, l_tax FROM lineitem), r AS (SELECT seq_id, p, ln(p + 1) + l_tax AS log_m FROM z)"
_TAIL = f"{_LONG}, y AS (SELECT seq_id AS series_id, p AS n, log_m AS y FROM r), k AS (SELECT *, max(n) OVER (PARTITION BY series_id) AS e FROM y), t AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY n) AS i, count(*) OVER (PARTITION BY series_id) AS m FROM k WHERE n >= greatest(4, e // 2)), u AS (SELECT series_id, i, m, n * ln(n) AS u, n::DOUBLE AS v, y FROM t WHERE m >= 6)"


def _fit(where: str, name: str) -> str:
    """A table of the sums and slopes of u where a condition holds."""
    sums = ", ".join(f"covar_pop({a}, {b}) AS {a}{b}" for a, b in ("uu", "vv", "uv", "uy", "vy", "yy"))
    return f"{name} AS (SELECT series_id, n, (uy * vv - vy * uv) / (uu * vv - uv * uv) AS alpha, (vy * uu - uy * uv) / (uu * vv - uv * uv) AS la, au, av, ay, yy, uy, vy FROM (SELECT series_id, count(*) AS n, avg(u) AS au, avg(v) AS av, avg(y) AS ay, {sums} FROM u WHERE {where} GROUP BY series_id))"


_FITS = f"{_TAIL}, {_fit('true', 'f')}, {_fit('i <= m // 2', 'f1')}, {_fit('i > m // 2', 'f2')}, fit AS (SELECT f.series_id, f.alpha, f.la, f.ay - f.alpha * f.au - f.la * f.av AS c, sqrt(greatest(f.yy - f.alpha * f.uy - f.la * f.vy, 0)) AS res, CASE WHEN f1.n >= 4 THEN f1.alpha ELSE f.alpha END AS a1, CASE WHEN f2.n >= 4 THEN f2.alpha ELSE f.alpha END AS a2, f.n FROM f JOIN f1 USING (series_id) JOIN f2 USING (series_id))"
_S = "s AS (SELECT l_orderkey AS series_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax) - 1 AS INTEGER) AS n, * FROM lineitem)"

_NEWTON = """co AS (SELECT series_id AS poly_id, s.n AS i, m.n AS n, CASE WHEN m.n >= l_quantity % 7 THEN l_quantity + m.n ELSE 0 END AS c FROM s, range(9) AS m(n)),
    t AS (SELECT poly_id, i, min(n) AS o, arg_min(c, n) AS lc FROM co WHERE c <> 0 GROUP BY ALL),
    b AS (SELECT a.poly_id, a.i, b.i AS j, a.o AS oi, b.o AS oj FROM t a JOIN t b ON a.poly_id = b.poly_id AND a.i < b.i),
    e AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM t k WHERE k.poly_id = b.poly_id AND ((k.o - oi) * (j - b.i) < (oj - oi) * (k.i - b.i) OR (k.i < b.i OR k.i > j) AND (k.o - oi) * (j - b.i) = (oj - oi) * (k.i - b.i)))),
    edges AS (SELECT poly_id, i, j, (oi - oj) / (j - i) AS mu, (SELECT string_agg(k.i, ',' ORDER BY k.i) FROM t k WHERE k.poly_id = e.poly_id AND k.i BETWEEN e.i AND e.j AND (k.o - oi) * (j - e.i) = (oj - oi) * (k.i - e.i)) AS on_edge FROM e)"""
_AT = "coalesce(max({c}) FILTER (n = 0), 0) AS {a}0, coalesce(max({c}) FILTER (n = 1), 0) AS {a}1, coalesce(max({c}) FILTER (n = 2), 0) AS {a}2, coalesce(max({c}) FILTER (n = 3), 0) AS {a}3"
_POLES = "p AS (SELECT DISTINCT l_partkey AS series_id, CAST(l_linenumber % 4 AS INTEGER) AS ord, l_discount * 20 + 0.5 AS re, l_tax * 10 - 0.4 AS im FROM lineitem)"

SQL = {
    "weight_sums": f"WITH {_W} SELECT seq_id, p, round(log_w, 6) AS log_w FROM w",
    "log_convex": f"WITH {_R}, x AS (SELECT *, lead(log_m) OVER (PARTITION BY seq_id ORDER BY p) AS nx FROM r) SELECT seq_id, min(p) FILTER (nx < log_m - 1e-12) AS p FROM x GROUP BY seq_id",
    "dc_constant": f"WITH {_R}, x AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY log_m / (p + 1) DESC, p) AS k FROM r) SELECT seq_id, round(exp(log_m / (p + 1)), 6) AS dc, p FROM x WHERE k = 1",
    "mg_constant": f"WITH {_W}, {_MG} SELECT seq_id, round(mg, 6) AS mg FROM mg",
    "omega_index": f"WITH {_R}, {_OM} SELECT seq_id, round(omega, 6) AS omega FROM om",
    "gamma1_tail": f"WITH {_LONG}, {_G1} SELECT seq_id, round(g1, 6) AS g1, p, reliable FROM g1",
    "almost_increasing": f"WITH {_R}, x AS (SELECT seq_id, log_m / min(log_m) OVER (PARTITION BY seq_id ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM r) SELECT seq_id, round(max(q), 6) AS c FROM x GROUP BY seq_id",
    "associated_fn": f"WITH {_W}, t AS (SELECT DISTINCT CAST(floor(ln(p_retailprice)) AS DOUBLE) AS log_t FROM part) SELECT seq_id, log_t, round(max(p * log_t - log_w), 6) AS omega, round(min(log_w + p * log_t), 6) AS log_h FROM w, t GROUP BY ALL",
    "convention_switch": f"WITH {_W} SELECT seq_id, p, round(log_w + lgamma(p + 1), 6) AS inside, round(log_w, 6) AS back FROM w",
    "weights_panel": f"""WITH {_LONG.replace("r AS (", "r0 AS (")}, r AS (SELECT {{'id': seq_id, 'n': n}} AS seq_id, p, log_m FROM r0, (VALUES (150), (300)) AS c(n) WHERE p < n),
        w AS (SELECT seq_id, p, coalesce(sum(log_m) OVER (PARTITION BY seq_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS log_w FROM r), {_MG}, {_OM}, {_G1},
        d AS (SELECT seq_id, max(log_m / (p + 1)) AS dc FROM r GROUP BY ALL), lc AS (SELECT seq_id, min(p) FILTER (nx < log_m - 1e-12) AS concave_at FROM (SELECT *, lead(log_m) OVER (PARTITION BY seq_id ORDER BY p) AS nx FROM r) GROUP BY ALL)
        SELECT d.seq_id.id AS id, d.seq_id.n AS n, round(exp(dc), 6) AS dc, round(mg, 6) AS mg, round(omega, 6) AS omega, round(g1, 6) AS g1, reliable, concave_at FROM d LEFT JOIN mg USING (seq_id) LEFT JOIN om USING (seq_id) LEFT JOIN g1 USING (seq_id) LEFT JOIN lc USING (seq_id)""",
    "growth_ratio_fit": f"""WITH {_R}, x AS (SELECT seq_id, ln(p) AS x, ln(lead(c) OVER (PARTITION BY seq_id ORDER BY p) / c) AS y FROM r WHERE p >= 1)
        SELECT seq_id AS series_id, round(regr_slope(y, x), 5) AS slope, round(regr_intercept(y, x), 5) AS offset FROM x WHERE y IS NOT NULL GROUP BY seq_id""",
    "growth_tail_fit": f"WITH {_FITS} SELECT series_id, round(alpha, 4) + 0.0 AS alpha, round(la, 4) + 0.0 AS log_a, round(c, 4) + 0.0 AS offset, round(res, 4) + 0.0 AS residual, round(least(a1, a2), 4) + 0.0 AS low, round(greatest(a1, a2), 4) + 0.0 AS high, n AS points FROM fit",
    "growth_report": f"""WITH {_FITS}, q AS (SELECT series_id, ln(n) AS x, lead(y) OVER (PARTITION BY series_id ORDER BY n) - y AS d FROM y WHERE n >= 1), s AS (SELECT series_id, regr_slope(d, x) AS slope FROM q WHERE d IS NOT NULL GROUP BY series_id)
        SELECT y.series_id, CAST(max(y.n) AS INTEGER) AS n, round(any_value(alpha), 4) + 0.0 AS alpha, round(any_value(least(a1, a2)), 4) + 0.0 AS low, round(any_value(greatest(a1, a2)), 4) + 0.0 AS high, round(any_value(slope), 4) + 0.0 AS slope FROM y LEFT JOIN fit USING (series_id) LEFT JOIN s USING (series_id) GROUP BY y.series_id""",
    "roumieu_beurling": f"""WITH {_W}, x AS (SELECT seq_id, p, (ln(c) - log_w) / p AS l, max(p) OVER (PARTITION BY seq_id) AS n FROM r JOIN w USING (seq_id, p) WHERE p >= 1)
        SELECT seq_id AS series_id, round(max(exp(l)) FILTER (p * 2 >= n), 6) AS sup, round(regr_slope(l, ln(p)), 5) AS slope FROM x GROUP BY seq_id""",
    "cauchy_product": f"""WITH {_S} SELECT a.series_id, a.n + b.n AS n, round(sum(a.l_quantity * b.l_discount), 4) AS c FROM s a JOIN s b USING (series_id)
        JOIN (SELECT series_id, max(n) AS e FROM s GROUP BY series_id) USING (series_id) WHERE a.n + b.n <= e GROUP BY ALL""",
    "series_sums": f"""WITH {_S}, x AS (SELECT series_id, n, l_quantity + l_tax AS c, l_quantity - l_tax AS minus FROM s)
        SELECT x.series_id, x.n, round(x.c, 4) AS c, round(x.minus, 4) AS minus, round(y.n * y.c, 4) AS slope FROM x LEFT JOIN x y ON y.series_id = x.series_id AND y.n = x.n + 1""",
    "borel_coeffs": f"WITH {_S} SELECT series_id, n, CAST(sign(l_extendedprice) AS INTEGER) AS sign, round(ln(abs(l_extendedprice)) - lgamma(n + 1), 6) AS log_b FROM s WHERE l_extendedprice <> 0",
    "newton_edges": f"WITH {_S}, {_NEWTON} SELECT poly_id, i, j, round(mu, 6) AS mu, on_edge FROM edges",
    "newton_characteristic": f"WITH {_S}, {_NEWTON} SELECT e.poly_id, e.i, t.i AS power, round(lc, 6) AS lc FROM e JOIN t ON t.poly_id = e.poly_id AND t.i BETWEEN e.i AND e.j AND (t.o - oi) * (e.j - e.i) = (oj - oi) * (t.i - e.i)",
    "poly_derivative": f"WITH {_S}, {_NEWTON} SELECT poly_id, i - 1 AS i, CAST(n AS INTEGER) AS n, round(i * c, 6) AS c FROM co WHERE i >= 1 AND c <> 0",
    "series_power": f"""WITH {_S}, x AS (SELECT series_id, n, l_tax AS c FROM s WHERE n <= 6), k AS (SELECT DISTINCT series_id FROM s), g AS (SELECT series_id, m::INTEGER AS n FROM k, range(7) AS t(m)),
        p AS (SELECT a.series_id, a.n + b.n + d.n AS n, sum(a.c * b.c * d.c) AS c FROM x a JOIN x b USING (series_id) JOIN x d USING (series_id) WHERE a.n + b.n + d.n <= 6 GROUP BY ALL)
        SELECT series_id, n, round(coalesce(c, 0), 9) AS c FROM g LEFT JOIN p USING (series_id, n)""",
    "series_composition": f"""WITH {_S}, v AS (SELECT series_id, {_AT.format(a='f', c='l_quantity')}, {_AT.format(a='g', c='l_discount')} FROM s GROUP BY series_id),
        h AS (SELECT series_id, unnest([0, 1, 2, 3]) AS n, unnest([f0, f1 * g1, f1 * g2 + f2 * g1 * g1, f1 * g3 + 2 * f2 * g1 * g2 + f3 * g1 * g1 * g1]) AS c FROM v) SELECT series_id, n, round(c, 6) AS c FROM h""",
    "series_quotient": f"""WITH {_S}, v AS (SELECT series_id, {_AT.format(a='a', c='l_extendedprice')}, {_AT.format(a='b', c='l_quantity')} FROM s GROUP BY series_id), q0 AS (SELECT *, a0 / b0 AS q0 FROM v WHERE b0 <> 0), q1 AS (SELECT *, (a1 - b1 * q0) / b0 AS q1 FROM q0),
        q2 AS (SELECT *, (a2 - b1 * q1 - b2 * q0) / b0 AS q2 FROM q1), q3 AS (SELECT *, (a3 - b1 * q2 - b2 * q1 - b3 * q0) / b0 AS q3 FROM q2), h AS (SELECT series_id, unnest([0, 1, 2, 3]) AS n, unnest([q0, q1, q2, q3]) AS c FROM q3) SELECT series_id, n, CAST(sign(c) AS INTEGER) AS sign, round(ln(abs(c)), 6) AS log_c FROM h WHERE c <> 0""",
    "series_simple": f"""WITH {_S}, k AS (SELECT DISTINCT series_id FROM s), g AS (SELECT series_id, m::INTEGER AS n FROM k, range(3) AS t(m)), x AS (SELECT g.series_id, g.n, coalesce(l_quantity, 0) AS c FROM g LEFT JOIN s ON s.series_id = g.series_id AND s.n = g.n AND s.n <= 1)
        SELECT series_id, n, c, round(-c, 4) AS minus, round(c / 3, 4) AS third FROM x""",
    "weight_catalogue": """WITH k AS (SELECT s_suppkey AS seq_id, ['gevrey', 'gevrey_log', 'q_gevrey', 'slow_ratios', 'power_ratios'][s_suppkey % 5 + 1] AS kind, s_nationkey % 4 / 2.0 + 1.5 AS a, s_nationkey % 3 AS b FROM supplier),
        x AS (SELECT *, t.p::INTEGER AS q FROM k, range(21) AS t(p)),
        m AS (SELECT *, CASE kind WHEN 'slow_ratios' THEN ln(ln(q + exp(1))) WHEN 'power_ratios' THEN a * ln(q + 1) ELSE 0 END AS lm FROM x),
        w AS (SELECT seq_id, q, CASE kind WHEN 'gevrey' THEN a * lgamma(q + 1) WHEN 'gevrey_log' THEN a * lgamma(q + 1) + b * q * ln(ln(q + exp(1))) WHEN 'q_gevrey' THEN q * q * ln(a) ELSE coalesce(sum(lm) OVER (PARTITION BY seq_id ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS v FROM m)
        SELECT seq_id, q AS p, round(v, 6) AS log_w, round(v, 6) AS log_value FROM w""",
    "grown_series": f"""WITH k AS (SELECT s_suppkey AS series_id, ['gevrey', 'strongly_regular', 'q_gevrey'][s_suppkey % 3 + 1] AS kind, s_nationkey % 4 / 2.0 + 1.5 AS a, s_nationkey % 3 AS b FROM supplier),
        z AS (SELECT l_suppkey AS series_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY {_LINE}) - 1 AS INTEGER) AS n, least(2.0, greatest(0.5, 0.5 + l_tax * 15)) AS eps FROM lineitem)
        SELECT series_id, n, 1 AS sign, round(CASE kind WHEN 'gevrey' THEN a * lgamma(n + 1) WHEN 'strongly_regular' THEN a * lgamma(n + 1) + b * n * ln(ln(n + exp(1))) ELSE n * n * ln(a) END + ln(eps), 6) AS log_c FROM k JOIN z USING (series_id) WHERE n <= 50""",
    "closed_series": f"""WITH {_S} SELECT series_id, n, 'euler' AS kind, CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END AS sign, round(lgamma(n + 1), 6) AS log_c FROM s
        UNION ALL SELECT series_id, n, 'catalan', 1, round(lgamma(2 * n - 1) - lgamma(n) - lgamma(n + 1), 6) FROM s WHERE n >= 1""",
    "series_from_poles": "SELECT series_id, n, round(exp(lgamma(n + 1)) * c, 9) AS c FROM (SELECT l_orderkey AS series_id, n::INTEGER AS n, sum(l_tax / pow(l_quantity + 0.5, n + 1)) AS c FROM lineitem, range(6) AS t(n) GROUP BY ALL)",
    "stable_poles": f"""WITH {_POLES}, z AS (SELECT *, 0.15 * greatest(1, sqrt(re * re + im * im)) AS size, {{'o': ord, 're': re, 'im': im}} AS id FROM p), n AS (SELECT series_id, count(DISTINCT ord) AS k FROM p GROUP BY ALL),
        v AS (SELECT a.series_id, a.id, any_value(a.size) AS size, count(DISTINCT b.ord) AS votes, avg(b.re) AS mre, avg(b.im) AS mim FROM z a JOIN z b ON a.series_id = b.series_id AND sqrt((a.re - b.re) ** 2 + (a.im - b.im) ** 2) < a.size GROUP BY a.series_id, a.id),
        k AS (SELECT v.* FROM v JOIN n USING (series_id) WHERE votes >= least(3, k))
        SELECT series_id, round(mre, 6) AS re, round(mim, 6) AS im, votes FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.series_id = a.series_id AND b.id < a.id AND sqrt((a.id.re - b.id.re) ** 2 + (a.id.im - b.id.im) ** 2) < a.size)""",
    "refutation_sweep": """SELECT bound, CAST(row_number() OVER (PARTITION BY bound ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS INTEGER) AS k, l_orderkey, l_linenumber FROM lineitem, (SELECT CAST(r_regionkey * 10000 + 30000 AS BIGINT) AS bound FROM region)
        WHERE NOT coalesce(l_extendedprice < bound OR l_quantity > 45, false) QUALIFY k <= 5""",
}
