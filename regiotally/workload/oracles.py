"""The SQL whose result each query has to equal, over the same tables."""

from __future__ import annotations

from regiotally.workload.tables import SEGMENTS, YEARS

# Fixed values, written out here so that a slip in the library's own tables shows: coefficients of Wichura (1988),
# algorithm AS 241, and of Royston (1995), algorithm AS R94, constant term first.
CENTRE_NUMERATOR = [
    3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
    4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3,
]
CENTRE_DENOMINATOR = [
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3,
]
TAIL_NUMERATOR = [
    1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
    1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4,
]
TAIL_DENOMINATOR = [
    1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9,
]
FAR_NUMERATOR = [
    6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
    2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7,
]
FAR_DENOMINATOR = [
    1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
    7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15,
]
LAST_WEIGHT = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
NEXT_WEIGHT = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
LARGE_MEAN = [-1.5861, -0.31082, -0.083751, 0.0038915]
LARGE_LOG_SPREAD = [-0.4803, -0.082676, 0.0030302]

DUMMIES = ["EAST", "EUROPE", "GULF", "SOUTH"]
FEATURES = [
    "sin_month", "cos_month", "rate_lag1", "rate_lag3", "supply_per_head", "returned_rows", "filled_rows",
    "reg_EAST", "reg_EUROPE", "reg_GULF",
]
VARIANTS = [("V1: Temporal only", 4), ("V2: + Supply", 5), ("V3: + Context", 7), ("V4: + Region", 10)]
ALPHAS = [0.01, 0.1, 1.0, 10.0, 100.0]
LABEL = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][{}]"


def r(expression: str, digits: int = 6) -> str:
    return f"(round_even(({expression}) * 1e{digits}, 0) / 1e{digits} + 0.0::DOUBLE)"


# Mean of rates with one digit, summed as whole tenths so that it does not depend on the row order.
EXACT_MEAN = "round_even(sum((rate_100k * 10)::BIGINT) / count(*), 0) / 10"

# Named parts of the queries, each with the parts it builds on.
PARTS: dict[str, tuple[list[str], str]] = {}


def part(name: str, needs: list[str], body: str) -> None:
    PARTS[name] = (needs, body)


def query(needs: list[str], body: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for other in PARTS[name][0]:
                visit(other)
            ordered.append(name)

    for name in needs:
        visit(name)
    if not ordered:
        return body
    heads = {n: f"{n}(g, p, k, i, j, v)" for n in ("solved", "ridged", "inverse")}
    heads |= {"folded": "folded(g, b, k, i, j, v)", "descent": "descent(g, b, k, w)"}
    parts = []
    for n in ordered:
        keep = "AS" if n in heads else "AS MATERIALIZED"
        parts.append(f"{heads.get(n, n)} {keep} ({PARTS[n][1]})")
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


part("places", [], """
  SELECT n_nationkey, n_name, r_name,
         CASE r_name WHEN 'AFRICA' THEN 'SOUTH' WHEN 'AMERICA' THEN 'WEST' WHEN 'ASIA' THEN 'EAST'
           WHEN 'MIDDLE EAST' THEN CASE n_name WHEN 'NATION_4' THEN 'EAST' WHEN 'NATION_9' THEN 'SOUTH'
             WHEN 'NATION_14' THEN 'EUROPE' ELSE 'GULF' END
           ELSE r_name END AS region
  FROM nation JOIN region ON n_regionkey = r_regionkey""")
part("loaded", ["places"], """
  SELECT year(o_orderdate)::INT AS year, quarter(o_orderdate)::INT AS quarter, month(o_orderdate)::INT AS month,
         region, r_name, n_name, '0' || replace(o_orderpriority, '-', ' ') AS category, l_linenumber || '-' || round(l_tax * 100)::INT AS kind,
         (l_returnflag = 'R')::INT AS returned, (l_discount >= 0.05::DOUBLE)::INT AS filled, l_quantity::BIGINT AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN places ON c_nationkey = n_nationkey""")
part("rolled", ["loaded"], """
  SELECT year, quarter, month, region, category, kind, returned, filled, sum(n)::BIGINT AS incidents
  FROM loaded WHERE year <> 2001 GROUP BY ALL""")
part("active", [], "SELECT DISTINCT year(o_orderdate)::INT AS year, o_custkey FROM orders")
part("population", ["active", "places"], f"""
  SELECT year, region, count(*)::BIGINT AS total_population,
         count(*) FILTER (c_acctbal >= 0)::BIGINT AS credit, count(*) FILTER (c_acctbal < 0)::BIGINT AS debit,
         {', '.join(f"count(*) FILTER (c_mktsegment = '{s}')::BIGINT AS pop_{s.lower()}" for s in SEGMENTS)}
  FROM active JOIN customer ON o_custkey = c_custkey JOIN places ON c_nationkey = n_nationkey
  WHERE year BETWEEN 1995 AND 2000 GROUP BY year, region""")
part("shipped", ["places"], """
  SELECT year(l_shipdate)::INT AS year, quarter(l_shipdate)::INT AS quarter, r_name,
         sum(l_quantity) AS supply, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS returned_supply
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN places ON s_nationkey = n_nationkey
  GROUP BY ALL""")
part("supplied", ["shipped"], """
  SELECT year, quarter, CASE r_name WHEN 'AFRICA' THEN 'SOUTH' WHEN 'AMERICA' THEN 'WEST' WHEN 'ASIA' THEN 'EAST'
           WHEN 'EUROPE' THEN 'EUROPE' WHEN 'MIDDLE EAST' THEN 'GULF' END AS region,
         sum(supply) AS supply, sum(returned_supply) AS returned_supply
  FROM shipped GROUP BY ALL""")
part("reported", ["supplied"], """
  SELECT year, quarter, region, CASE WHEN year <> 2000 OR quarter < 3 THEN supply END AS supply,
         CASE WHEN year <> 2000 OR quarter < 3 THEN returned_supply END AS returned_supply FROM supplied""")
part("merged", ["rolled", "population", "reported"], """
  SELECT r.*, total_population, credit, debit, pop_automobile, pop_building, pop_furniture, pop_household,
         pop_machinery,
         round_even(coalesce(supply, avg(supply) OVER w), 0)::BIGINT AS supply,
         round_even(coalesce(returned_supply, avg(returned_supply) OVER w), 0)::BIGINT AS returned_supply
  FROM rolled r LEFT JOIN reported s USING (year, quarter, region) LEFT JOIN population p USING (year, region)
  WINDOW w AS (PARTITION BY r.region, r.quarter)""")
part("cells2", ["merged"], """
  SELECT year, quarter, month, region, sum(incidents)::BIGINT AS incidents, sum(returned)::BIGINT AS returned_rows,
         sum(filled)::BIGINT AS filled_rows, max(supply) AS supply, max(total_population) AS total_population,
         max(credit) AS credit
  FROM merged WHERE category = '01 URGENT' GROUP BY ALL""")
part("cells", ["cells2"], """
  SELECT *, round_even(incidents / total_population * 100000 * 10, 0) / 10 AS rate_100k FROM cells2""")
part("ranked", ["cells"], f"""
  SELECT region, avg(rate) AS rate FROM (SELECT region, year, {EXACT_MEAN} AS rate FROM cells GROUP BY ALL) GROUP BY region""")
part("panel", ["cells2"], f"""
  SELECT * FROM (
    SELECT *, ln(1 + rate_100k) AS log_rate, supply / total_population AS supply_per_head,
           sin(2 * pi() * month / 12) AS sin_month, cos(2 * pi() * month / 12) AS cos_month,
           lag(rate_100k, 1) OVER w AS rate_lag1, lag(rate_100k, 3) OVER w AS rate_lag3,
           {', '.join(f"region = '{v}' AS \"reg_{v}\"" for v in DUMMIES)}
    FROM (SELECT *, round_even(incidents / total_population * 100000 * 100, 0) / 100 AS rate_100k FROM cells2)
    WINDOW w AS (PARTITION BY region ORDER BY year, month))
  WHERE rate_lag1 IS NOT NULL AND rate_lag3 IS NOT NULL""")

# Models: features in long form, normal equations as (i, j, v) cells, elimination by recursion.
part("long", ["panel"], " UNION ALL ".join(
    f"SELECT region, year, month, log_rate AS y, {i} AS i, \"{f}\"::DOUBLE AS x FROM panel"
    for i, f in enumerate(FEATURES, 1)))
part("train_scale", ["long"], """
  SELECT i, avg(x) AS m, CASE WHEN max(x) = min(x) THEN 1 ELSE stddev_pop(x) END AS s
  FROM long WHERE year < 2000 GROUP BY i""")
part("z", ["long", "train_scale"], """
  SELECT region, year, month, y, i, (x - m) / s AS z FROM long JOIN train_scale USING (i)
  UNION ALL SELECT region, year, month, y, 0, 1.0 FROM long WHERE i = 1""")
part("train_sums", ["z"], """
  SELECT a.i AS i, b.i AS j, sum(a.z * b.z) AS v FROM z a JOIN z b USING (region, year, month)
  WHERE year < 2000 GROUP BY ALL
  UNION ALL SELECT i, 99, sum(z * y) FROM z WHERE year < 2000 GROUP BY i""")

ELIMINATE = """
    CASE WHEN abs(d.v) < 1e-9 THEN e.v WHEN e.i = e.k + 1 THEN e.v / d.v ELSE e.v - c.v * r.v / d.v END"""

part("all_scale", ["long"], """
  SELECT i, avg(x) AS m, CASE WHEN max(x) = min(x) THEN 1 ELSE stddev_pop(x) END AS s FROM long GROUP BY i""")


def elimination(name: str, systems: str) -> str:
    """Normal equations of the training rows for every system, eliminated column by column."""
    return f"""
  SELECT g, p, -1, i, j, v + CASE WHEN i = j AND i > 0 THEN alpha ELSE 0 END
  FROM {systems} JOIN train_sums ON i <= p AND (j <= p OR j = 99)
  UNION ALL
  SELECT e.g, e.p, e.k + 1, e.i, e.j, {ELIMINATE}
  FROM {name} e JOIN {name} d ON d.g = e.g AND d.i = e.k + 1 AND d.j = e.k + 1
    JOIN {name} r ON r.g = e.g AND r.i = e.k + 1 AND r.j = e.j
    JOIN {name} c ON c.g = e.g AND c.i = e.i AND c.j = e.k + 1
  WHERE e.k < e.p"""


def model_parts(order: str) -> None:
    """Feature sets, folds in ``order``, ridge grid and final fits."""
    part("systems", [], "SELECT * FROM (VALUES " + ", ".join(
        f"({g}, {p}, 0.0::DOUBLE)" for g, (_, p) in enumerate(VARIANTS, 1)) + ") AS t(g, p, alpha)")
    part("solved", ["systems", "train_sums"], elimination("solved", "systems"))
    part("variant_fit", ["solved"], "SELECT g, i, v FROM solved WHERE k = p AND j = 99")
    part("variant_test", ["z", "variant_fit"], """
  SELECT g, region, year, month, any_value(y) AS y, sum(z * v) AS fitted FROM z JOIN variant_fit USING (i)
  WHERE year = 2000 GROUP BY g, region, year, month""")
    part("variant_error", ["variant_test"], """
  SELECT g, sqrt(avg((y - fitted) ** 2)) AS rmse, avg(abs(y - fitted)) AS mae FROM variant_test GROUP BY g""")
    part("chosen", ["variant_error", "systems"], """
  SELECT g, p FROM variant_error JOIN systems USING (g) ORDER BY rmse, g LIMIT 1""")
    part("placed", ["panel"], f"""
  SELECT region, year, month, row_number() OVER (ORDER BY {order}) AS rn, count(*) OVER () AS n FROM panel""")
    part("blocks", ["placed"], """
  SELECT region, year, month, CASE WHEN rn <= n - 5 * (n // 6) THEN 0
           ELSE 1 + (rn - (n - 5 * (n // 6)) - 1) // (n // 6) END AS b FROM placed""")
    part("zall", ["long", "all_scale", "blocks", "chosen"], """
  SELECT region, year, month, b, y, i, (x - m) / s AS z
  FROM long JOIN all_scale USING (i) JOIN blocks USING (region, year, month) WHERE i <= (SELECT p FROM chosen)
  UNION ALL SELECT region, year, month, b, y, 0, 1.0 FROM long JOIN blocks USING (region, year, month) WHERE i = 1""")
    part("block_sums", ["zall"], """
  SELECT x.b AS b, x.i AS i, w.i AS j, sum(x.z * w.z) AS v FROM zall x JOIN zall w USING (region, year, month)
  GROUP BY ALL
  UNION ALL SELECT b, i, 99, sum(z * y) FROM zall GROUP BY b, i""")
    part("fold_sums", ["block_sums"], """
  SELECT t.b AS b, i, j, sum(v) AS v FROM (SELECT unnest([1, 2, 3, 4, 5]) AS b) t JOIN block_sums s ON s.b < t.b
  GROUP BY ALL""")
    # Plain least squares is the limit of a vanishing ridge penalty: the smallest weights where features are collinear.
    part("alphas", [], "SELECT * FROM (VALUES " + ", ".join(
        f"({g}, {a}::DOUBLE, {a or 1e-7}::DOUBLE)" for g, a in enumerate([0.0, *ALPHAS])) + ") AS t(g, alpha, penalty)")
    part("folded", ["fold_sums", "alphas", "chosen"], f"""
  SELECT g, b, -1, i, j, v + CASE WHEN i = j AND i > 0 THEN penalty ELSE 0 END FROM fold_sums, alphas
  UNION ALL
  SELECT e.g, e.b, e.k + 1, e.i, e.j, {ELIMINATE}
  FROM folded e JOIN folded d ON d.g = e.g AND d.b = e.b AND d.i = e.k + 1 AND d.j = e.k + 1
    JOIN folded r ON r.g = e.g AND r.b = e.b AND r.i = e.k + 1 AND r.j = e.j
    JOIN folded c ON c.g = e.g AND c.b = e.b AND c.i = e.i AND c.j = e.k + 1
  WHERE e.k < (SELECT p FROM chosen)""")
    part("fold_fit", ["folded", "chosen"], """
  SELECT g, b, i, v FROM folded WHERE k = (SELECT p FROM chosen) AND j = 99""")
    part("fold_test", ["zall", "fold_fit"], """
  SELECT g, b, region, year, month, any_value(y) AS y, sum(z * v) AS fitted
  FROM zall JOIN fold_fit USING (b, i) GROUP BY g, b, region, year, month""")
    part("grid", ["fold_test", "alphas"], """
  SELECT g, any_value(alpha) AS alpha, avg(rmse) AS cv_rmse
  FROM (SELECT g, b, sqrt(avg((y - fitted) ** 2)) AS rmse FROM fold_test GROUP BY g, b) JOIN alphas USING (g)
  GROUP BY g""")
    part("best_alpha", ["grid"], "SELECT g, alpha, cv_rmse FROM grid WHERE g > 0 ORDER BY cv_rmse, g LIMIT 1")
    # One ridge system over the chosen features: substitute into the cells of the training rows.
    part("ridge_system", ["chosen", "best_alpha"], "SELECT 1 AS g, p, alpha FROM chosen, best_alpha b")
    part("ridged", ["ridge_system", "train_sums"], elimination("ridged", "ridge_system"))
    part("ridge_fit", ["ridged"], "SELECT i, v FROM ridged WHERE k = p AND j = 99")
    part("ols_test", ["variant_test", "chosen"], """
  SELECT region, year, month, y, fitted FROM variant_test WHERE g = (SELECT g FROM chosen)""")
    part("ridge_test", ["z", "ridge_fit"], """
  SELECT region, year, month, any_value(y) AS y, sum(z * v) AS fitted FROM z JOIN ridge_fit USING (i)
  WHERE year = 2000 GROUP BY region, year, month""")
    # Lasso by coordinate descent on centred sums: one coordinate per step, every fold (b > 0), the training
    # rows (b = 0) and all alphas at once.
    part("lasso_sums", ["fold_sums", "train_sums", "chosen"], """
  SELECT b, i, j, v FROM fold_sums
  UNION ALL SELECT 0, i, j, v FROM train_sums, chosen WHERE i <= p AND (j <= p OR j = 99)""")
    part("centred", ["lasso_sums"], """
  SELECT f.b AS b, f.i AS i, f.j AS j, (f.v - x.v * y.v / n.v) / n.v AS v
  FROM lasso_sums f JOIN lasso_sums x ON x.b = f.b AND x.i = 0 AND x.j = f.i
    JOIN lasso_sums y ON y.b = f.b AND y.i = 0 AND y.j = f.j
    JOIN lasso_sums n ON n.b = f.b AND n.i = 0 AND n.j = 0
  WHERE f.i > 0 AND f.j > 0""")
    part("lasso_rows", ["centred"], """
  SELECT b, i, list(v ORDER BY j) FILTER (j < 99) AS others, any_value(v) FILTER (j = 99) AS c,
         any_value(v) FILTER (j = i) AS d FROM centred GROUP BY b, i""")
    part("descent", ["lasso_rows", "alphas", "chosen"], """
  SELECT g, b, 0, list_transform(range(p), lambda q: 0.0::DOUBLE)
  FROM alphas, (SELECT DISTINCT b FROM lasso_rows), chosen c(_g, p) WHERE g > 0
  UNION ALL
  SELECT g, b, k + 1, w[1:i - 1] || [CASE WHEN d < 1e-12 THEN 0 ELSE sign(u) * greatest(abs(u) - alpha, 0) / d END]
           || w[i + 1:]
  FROM (SELECT s.g, s.b, s.k, s.w, i, d, alpha, c - list_dot_product(others, w) + d * w[i] AS u
        FROM descent s JOIN alphas USING (g)
          JOIN lasso_rows l ON l.b = s.b AND l.i = s.k % (SELECT p FROM chosen) + 1
        WHERE s.k < 400 * (SELECT p FROM chosen))""")
    part("lasso_weights", ["descent", "chosen"], """
  SELECT g, b, w FROM descent WHERE k = 400 * (SELECT p FROM chosen)""")
    part("lasso_fit", ["lasso_weights", "lasso_sums"], """
  SELECT g, b, i, v FROM (SELECT g, b, generate_subscripts(w, 1) AS i, unnest(w) AS v FROM lasso_weights)
  UNION ALL
  SELECT g, w.b, 0, any_value(y.v / n.v) - sum(w.w[x.j] * x.v / n.v)
  FROM lasso_weights w JOIN lasso_sums x ON x.b = w.b AND x.i = 0 AND x.j BETWEEN 1 AND 98
    JOIN lasso_sums n ON n.b = w.b AND n.i = 0 AND n.j = 0 JOIN lasso_sums y ON y.b = w.b AND y.i = 0 AND y.j = 99
  GROUP BY g, w.b""")
    part("lasso_fold_test", ["zall", "lasso_fit"], """
  SELECT g, b, region, year, month, any_value(y) AS y, sum(z * v) AS fitted
  FROM zall JOIN lasso_fit USING (b, i) WHERE b > 0 GROUP BY g, b, region, year, month""")
    part("lasso_grid", ["lasso_fold_test", "alphas"], """
  SELECT g, any_value(alpha) AS alpha, avg(rmse) AS cv_rmse
  FROM (SELECT g, b, sqrt(avg((y - fitted) ** 2)) AS rmse FROM lasso_fold_test GROUP BY g, b) JOIN alphas USING (g)
  GROUP BY g""")
    # Alphas that leave no weight have equal errors, up to the order of summation.
    part("best_lasso", ["lasso_grid"], """
  SELECT g, alpha, cv_rmse FROM lasso_grid ORDER BY round(cv_rmse, 12), g LIMIT 1""")
    part("lasso_test", ["z", "lasso_fit", "best_lasso"], """
  SELECT region, year, month, any_value(y) AS y, sum(z * v) AS fitted FROM z JOIN lasso_fit f USING (i)
  WHERE year = 2000 AND f.b = 0 AND f.g = (SELECT g FROM best_lasso) GROUP BY region, year, month""")
    part("tests", ["ols_test", "ridge_test", "lasso_test", "grid", "best_alpha", "best_lasso"], """
  SELECT 1 AS m, 'Linear Regression' AS model, 'ols' AS kind, alpha, cv_rmse, o.* FROM ols_test o, grid WHERE g = 0
  UNION ALL SELECT 2, printf('Ridge (a=%g)', alpha), 'ridge', alpha, cv_rmse, o.* FROM ridge_test o, best_alpha
  UNION ALL SELECT 3, printf('Lasso (a=%g)', alpha), 'lasso', alpha, cv_rmse, o.* FROM lasso_test o, best_lasso""")
    part("winner", ["tests"], "SELECT m FROM tests ORDER BY cv_rmse, m LIMIT 1")
    part("raw_sums", ["long", "chosen"], """
  SELECT a.i AS i, b.i AS j, sum(a.x * b.x) AS v FROM long a JOIN long b USING (region, year, month), chosen
  WHERE year < 2000 AND a.i <= p AND b.i <= p GROUP BY ALL""")
    part("inverse", ["raw_sums", "chosen"], f"""
  SELECT 1, p, 0, i, j, v FROM raw_sums, chosen
  UNION ALL SELECT 1, p, 0, i, 100 + j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END FROM raw_sums, chosen
  UNION ALL
  SELECT e.g, e.p, e.k + 1, e.i, e.j, {ELIMINATE}
  FROM inverse e JOIN inverse d ON d.i = e.k + 1 AND d.j = e.k + 1 JOIN inverse r ON r.i = e.k + 1 AND r.j = e.j
    JOIN inverse c ON c.i = e.i AND c.j = e.k + 1
  WHERE e.k < e.p""")
    part("forecast", ["tests", "winner"], forecast_sql("(SELECT * FROM tests WHERE m = (SELECT m FROM winner))"))


def forecast_sql(source: str) -> str:
    """The forecast columns from ``y`` and ``fitted``, as two nested selects."""
    return f"""
  SELECT *, round_even(error / actual * 100 * 10, 0) / 10 AS pct_error, abs(error) AS abs_error
  FROM (SELECT *, round_even((predicted - actual) * 10, 0) / 10 AS error
        FROM (SELECT region, year, month, {LABEL.format('month')} AS month_label, exp(y) - 1 AS actual_exact,
                     exp(fitted) - 1 AS predicted_exact, round_even((exp(y) - 1) * 10, 0) / 10 AS actual,
                     round_even((exp(fitted) - 1) * 10, 0) / 10 AS predicted FROM {source}))"""


def simpson_sql(density: str, upper: str, steps: int = 2000) -> str:
    """Integral from 0 to ``upper`` of a density with a place {x}."""
    value = density.format(x=f"({upper} * q / {steps})")
    weight = f"CASE WHEN q IN (0, {steps}) THEN 1 WHEN q % 2 = 1 THEN 4 ELSE 2 END"
    return f"({upper} / {3 * steps} * (SELECT sum({weight} * {value}) FROM range({steps + 1}) nodes(q)))"


def polynomial_sql(coefficients, x: str) -> str:
    text = repr(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        text = f"({text} * ({x}) + {c!r})"
    return text


def inverse_normal_sql(p: str) -> str:
    inner, root = f"(0.180625 - ({p} - 0.5) ** 2)", f"sqrt(-ln(least({p}, 1 - {p})))"
    return f"""CASE WHEN abs({p} - 0.5) <= 0.425
      THEN ({p} - 0.5) * {polynomial_sql(CENTRE_NUMERATOR, inner)} / {polynomial_sql(CENTRE_DENOMINATOR, inner)}
      WHEN {root} <= 5 THEN sign({p} - 0.5) * {polynomial_sql(TAIL_NUMERATOR, root + ' - 1.6')}
        / {polynomial_sql(TAIL_DENOMINATOR, root + ' - 1.6')}
      ELSE sign({p} - 0.5) * {polynomial_sql(FAR_NUMERATOR, root + ' - 5')}
        / {polynomial_sql(FAR_DENOMINATOR, root + ' - 5')} END"""


def normal_parts() -> None:
    part("ordered", ["ols_test"], """
  SELECT y - fitted AS e, row_number() OVER (ORDER BY y - fitted, region, year, month) AS rn, count(*) OVER () AS n
  FROM ols_test""")
    part("levels", ["ordered"], """
  SELECT e, rn, CASE WHEN rn = n THEN 0.5 ** (1.0 / n) WHEN rn = 1 THEN 1 - 0.5 ** (1.0 / n)
           ELSE (rn - 0.3175) / (n + 0.365) END AS level, (rn - 0.375) / (n + 0.25) AS middle, n FROM ordered""")
    part("scores", ["levels"], f"""
  SELECT *, {inverse_normal_sql('level')} AS theoretical, {inverse_normal_sql('middle')} AS m FROM levels""")
    part("lengths", ["scores"], f"""
  SELECT any_value(n) AS n, sum(m * m) AS mm,
         {polynomial_sql(LAST_WEIGHT, '1 / sqrt(any_value(n))')} + max(m) / sqrt(sum(m * m)) AS a1,
         {polynomial_sql(NEXT_WEIGHT, '1 / sqrt(any_value(n))')}
           + max(CASE WHEN rn = n - 1 THEN m END) / sqrt(sum(m * m)) AS a2,
         max(m) AS m1, max(CASE WHEN rn = n - 1 THEN m END) AS m2 FROM scores""")
    part("weights", ["scores", "lengths"], """
  SELECT e, CASE WHEN rn = 1 THEN -a1 WHEN rn = 2 THEN -a2 WHEN rn = s.n - 1 THEN a2 WHEN rn = s.n THEN a1
           ELSE m / sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) END AS a
  FROM scores s, lengths""")


def oracles() -> dict[str, str]:
    model_parts("region, year, month")
    normal_parts()
    found = {
        "region_recode": query(["places"], """
            SELECT region, count(*)::BIGINT AS customers FROM customer JOIN places ON c_nationkey = n_nationkey
            GROUP BY region"""),
        "pair_recode": query(["places"], """
            SELECT region, CASE WHEN r_name = 'MIDDLE EAST' AND n_name IN ('NATION_4', 'NATION_9', 'NATION_14') THEN 'pair'
                     WHEN r_name IN ('AFRICA', 'AMERICA', 'ASIA', 'MIDDLE EAST') THEN 'first' ELSE 'none' END AS match,
                   count(*)::BIGINT AS customers
            FROM customer JOIN places ON c_nationkey = n_nationkey GROUP BY ALL"""),
        "unmapped_pairs": query(["places"], """
            SELECT r_name, n_name, 1::BIGINT AS rows FROM places
            WHERE r_name NOT IN ('AFRICA', 'AMERICA', 'ASIA', 'MIDDLE EAST') AND n_nationkey IN (SELECT c_nationkey FROM customer)"""),
        "strict_flag_recode": """
            SELECT CASE l_returnflag WHEN 'R' THEN 1 ELSE 0 END AS returned,
                   CASE l_linestatus WHEN 'F' THEN 1 ELSE 0 END AS filled, count(*)::BIGINT AS lines
            FROM lineitem GROUP BY ALL""",
        "lenient_recode_sum": """
            SELECT CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 'goods' ELSE 'home' END AS segment,
                   count(*)::BIGINT AS customers
            FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY ALL""",
        "table_recode": """
            SELECT n_name AS nation_name, count(*)::BIGINT AS suppliers
            FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL""",
        "not_equal_keeps_null": """
            SELECT nullif(o_orderstatus, 'P') AS status, count(*)::BIGINT AS orders FROM orders
            WHERE o_orderstatus <> 'F' GROUP BY ALL""",
        "quarter_month_labels": f"""
            SELECT month(o_orderdate)::INT AS month, quarter(o_orderdate)::INT AS quarter,
                   {LABEL.format('month(o_orderdate)')} AS label, count(*)::BIGINT AS orders FROM orders GROUP BY ALL""",
        "quarter_end_quarters": query(["shipped"], """
            SELECT DISTINCT year, quarter * 3 AS month, quarter FROM shipped"""),
        "label_strip": """
            SELECT '0' || replace(o_orderpriority, '-', ' ') AS label, split_part(o_orderpriority, '-', 2) AS name,
                   o_orderpriority AS prefix, format('{:,}', count(*)) AS orders_text,
                   printf('%.1f', count(*) / 7) AS orders_fixed
            FROM orders GROUP BY o_orderpriority""",
        "period_labels": """
            SELECT year(o_orderdate) || '-Q' || quarter(o_orderdate) AS period, count(*)::BIGINT AS orders
            FROM orders GROUP BY ALL""",
        "population_features": query(["population"], "SELECT * FROM population"),
        "supply_rollup": query(["supplied"], "SELECT * FROM supplied"),
        "append_years": query(["shipped"], """
            SELECT year, r_name AS region, sum(supply) AS supply,
                   sum(returned_supply) FILTER (year >= 1998) AS returned_supply
            FROM shipped GROUP BY ALL"""),
        "merged_table": query(["merged"], f"""
            SELECT *, {', '.join(f"region = '{v}' AS \"region_{v}\"" for v in DUMMIES)} FROM merged"""),
        "imputed_supply": query(["merged"], """
            SELECT year, quarter, region, max(supply) AS supply, count(*)::BIGINT AS rows FROM merged GROUP BY ALL"""),
        "onehot_region": query(["places"], f"""
            SELECT region, n_name, count(*)::BIGINT AS customers,
                   {', '.join(f"region = '{v}' AS \"region_{v}\"" for v in DUMMIES)}
            FROM customer JOIN places ON c_nationkey = n_nationkey GROUP BY ALL"""),
        "encoded_shipments": """
            WITH lines AS (
              SELECT l_returnflag || '-' || l_linestatus || '-' || (year(l_shipdate) > 1998) AS state, l_quantity FROM lineitem)
            SELECT state = 'A-O-false' AS "is_A-O-false", state = 'N-F-false' AS "is_N-F-false", state = 'N-O-false' AS "is_N-O-false",
                   state = 'R-F-false' AS "is_R-F-false", state = 'R-O-false' AS "is_R-O-false", state LIKE '%true' AS is_new,
                   sum(l_quantity::BIGINT)::BIGINT AS quantity
            FROM lines GROUP BY ALL""",
        "first_orders": """
            SELECT o_custkey, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) FILTER (o_orderstatus <> 'P') AS status,
                   arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS priority
            FROM orders GROUP BY o_custkey""",
        "null_profile": query(["rolled", "reported"], """
            SELECT unnest(['supply', 'returned_supply']) AS column_name, count(*)::BIGINT AS nulls
            FROM rolled LEFT JOIN reported USING (year, quarter, region) WHERE supply IS NULL"""),
        "coverage": query(["supplied"], """
            SELECT year, quarter, count(*)::BIGINT AS n_regions FROM supplied GROUP BY ALL"""),
        "rowcount_matrix": query(["rolled"], f"""
            SELECT region, {', '.join(f'count(*) FILTER (year = {y})::BIGINT AS y{y}' for y in YEARS)}
            FROM rolled GROUP BY region"""),
        "region_list": query(["rolled"], "SELECT DISTINCT region FROM rolled"),
        "load_counts": query(["loaded"], """
            SELECT count(*) FILTER (year <> 2001)::BIGINT AS kept, sum(n) FILTER (year <> 2001)::BIGINT AS counted,
                   count(*)::BIGINT AS loaded FROM loaded"""),
        "join_nulls": query(["rolled", "reported", "merged", "population"], """
            SELECT (SELECT count(*) FROM rolled)::BIGINT AS rows,
                   count(*) FILTER (s.supply IS NULL)::BIGINT AS joined_supply,
                   count(*) FILTER (s.returned_supply IS NULL)::BIGINT AS joined_returned_supply,
                   (SELECT count(*) FROM merged WHERE supply IS NULL)::BIGINT AS filled_supply,
                   (SELECT count(*) FROM merged WHERE returned_supply IS NULL)::BIGINT AS filled_returned_supply,
                   count(*) FILTER (p.total_population IS NULL)::BIGINT AS peopled_total_population
            FROM rolled LEFT JOIN reported s USING (year, quarter, region) LEFT JOIN population p USING (year, region)"""),
        "observed_counts": query(["loaded", "rolled", "reported", "merged", "population"], """
            SELECT l.*, n.* FROM
              (SELECT count(*) FILTER (year <> 2001)::BIGINT AS kept, sum(n) FILTER (year <> 2001)::BIGINT AS counted,
                      count(*)::BIGINT AS loaded FROM loaded) l,
              (SELECT count(*)::BIGINT AS rows, count(*) FILTER (s.supply IS NULL)::BIGINT AS joined_supply,
                      count(*) FILTER (s.returned_supply IS NULL)::BIGINT AS joined_returned_supply,
                      (SELECT count(*) FROM merged WHERE supply IS NULL)::BIGINT AS filled_supply,
                      (SELECT count(*) FROM merged WHERE returned_supply IS NULL)::BIGINT AS filled_returned_supply,
                      count(*) FILTER (p.total_population IS NULL)::BIGINT AS peopled_total_population
               FROM rolled LEFT JOIN reported s USING (year, quarter, region) LEFT JOIN population p USING (year, region)) n"""),
        "delimited_round_trip": query(["merged"], f"""
            SELECT *, {', '.join(f"region = '{v}' AS \"region_{v}\"" for v in DUMMIES)} FROM merged"""),
        "load_rejects": """
            SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'type of o_totalprice' WHEN o_orderstatus = 'P' THEN 'missing o_orderstatus'
                     ELSE 'kept' END AS reason, count(*)::BIGINT AS rows FROM orders GROUP BY ALL""",
        "yearly_files": query(["places"], """
            SELECT file_year, region, sum(supply) AS supply, count(*)::BIGINT AS rows FROM (
              SELECT year(l_shipdate)::INT AS file_year, quarter(l_shipdate), n_nationkey, r_name AS region, sum(l_quantity) AS supply
              FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN places ON s_nationkey = n_nationkey GROUP BY ALL)
            GROUP BY ALL"""),
        "final_nulls": query(["merged"], """
            SELECT column_name, nulls FROM (
              SELECT unnest(['supply', 'returned_supply', 'total_population', 'credit', 'debit', 'incidents']) AS column_name,
                     unnest([count(*) - count(supply), count(*) - count(returned_supply), count(*) - count(total_population),
                             count(*) - count(credit), count(*) - count(debit), count(*) - count(incidents)]) AS nulls
              FROM merged) WHERE nulls > 0"""),
        "sample_rows": query(["rolled", "population"], """
            SELECT r.*, total_population FROM rolled r LEFT JOIN population USING (year, region)
            ORDER BY year, quarter, month, region, category, kind, returned, filled LIMIT 3"""),
        "population_by_year": query(["population"], f"""
            SELECT region, {', '.join(f'max(total_population) FILTER (year = {y}) AS y{y}' for y in YEARS)}
            FROM population GROUP BY region"""),
        "category_by_year": query(["rolled"], f"""
            SELECT substr(category, 4) AS category,
                   {', '.join(f'coalesce(sum(incidents) FILTER (year = {y}), 0)::BIGINT AS y{y}' for y in YEARS)}
            FROM rolled GROUP BY category"""),
        "involvement_share": query(["rolled"], f"""
            SELECT flag, involved, not_involved, {r('100.0 * involved / (involved + not_involved)', 1)} AS involved_pct,
                   {r('100.0 * not_involved / (involved + not_involved)', 1)} AS not_involved_pct
            FROM (SELECT 'returned' AS flag, sum(incidents) FILTER (returned = 1)::BIGINT AS involved,
                         sum(incidents) FILTER (returned = 0)::BIGINT AS not_involved FROM rolled
                  UNION ALL SELECT 'filled', sum(incidents) FILTER (filled = 1)::BIGINT,
                         sum(incidents) FILTER (filled = 0)::BIGINT FROM rolled)"""),
        "monthly_total_peak": query(["rolled"], f"""
            SELECT month, incidents, {LABEL.format('month')} AS month_label, incidents = max(incidents) OVER () AS is_peak
            FROM (SELECT month, sum(incidents)::BIGINT AS incidents FROM rolled GROUP BY month)"""),
        "monthly_trend": query(["rolled"], f"""
            SELECT year, month, sum(incidents)::BIGINT AS incidents, {LABEL.format('month')} AS month_label
            FROM rolled GROUP BY year, month"""),
        "category_month_matrix": query(["rolled"], f"""
            SELECT substr(category, 4) AS category,
                   {', '.join(f'coalesce(sum(incidents) FILTER (month = {m}), 0)::BIGINT AS m{m}' for m in range(1, 13))}
            FROM rolled GROUP BY category"""),
        "event_hour_matrix": "SELECT hour(ts)::INT AS hour, " + ", ".join(
            f"count(*) FILTER (event_type = '{e}')::BIGINT AS \"{e}\""
            for e in ["click", "error", "purchase", "signup", "view"]) + " FROM events GROUP BY ALL",
        "event_daily_lags": """
            SELECT *, lag(n, 1) OVER w AS lag1, lag(n, 3) OVER w AS lag3
            FROM (SELECT event_type, ts::DATE AS day, count(*)::BIGINT AS n FROM events GROUP BY ALL)
            WINDOW w AS (PARTITION BY event_type ORDER BY day)""",
        "assault_cells": query(["cells"], "SELECT * FROM cells"),
        "supply_trend": query(["cells"], """
            SELECT year, quarter, region, max(supply) AS supply, year || '-Q' || quarter AS period,
                   max(supply) / 1000 AS supply_thousands FROM cells GROUP BY year, quarter, region"""),
        "assault_month_region": query(["cells"], f"""
            SELECT month, region, {r('avg(incidents)')} AS mean_count, {LABEL.format('month')} AS month_label
            FROM cells GROUP BY month, region"""),
        "skewness_raw_log": query(["cells"], f"""
            SELECT {r('skewness(incidents)')} AS skew_raw, {r('skewness(ln(1 + incidents))')} AS skew_log FROM cells"""),
        "corr_pair": query(["cells"], f"SELECT {r('corr(supply, incidents)')} AS r FROM cells"),
        "listed_regions": query(["rolled"], "SELECT region, sum(incidents)::BIGINT AS incidents FROM rolled GROUP BY ALL"),
        "lag_features": query(["rolled"], """
            SELECT *, lag(incidents, 1) OVER w AS lag1, lag(incidents, 3) OVER w AS lag3
            FROM (SELECT region, category, year, month, sum(incidents)::BIGINT AS incidents FROM rolled GROUP BY ALL)
            WINDOW w AS (PARTITION BY region, category ORDER BY year, month)"""),
        "calendar_lags": query(["rolled"], """
            SELECT region, (no // 12)::INT AS year, (no % 12 + 1)::INT AS month, incidents,
                   lag(incidents, 1) OVER w AS lag1, lag(incidents, 3) OVER w AS lag3
            FROM (SELECT region, unnest(range(min(year * 12 + month - 1), max(year * 12 + month - 1) + 1)) AS no
                  FROM rolled GROUP BY region)
              LEFT JOIN (SELECT region, year * 12 + month - 1 AS no, sum(incidents)::BIGINT AS incidents
                         FROM rolled GROUP BY ALL) USING (region, no)
            WINDOW w AS (PARTITION BY region ORDER BY no)"""),
        "train_test_rows": query(["panel"], """
            SELECT count(*)::BIGINT AS rows, count(*) FILTER (year < 2000)::BIGINT AS train,
                   count(*) FILTER (year = 2000)::BIGINT AS test FROM panel"""),
        "panel_features": query(["panel"], f"""
            SELECT * REPLACE ({', '.join(f"{r(c, 9)} AS {c}" for c in ['sin_month', 'cos_month', 'log_rate', 'supply_per_head'])})
            FROM panel"""),
        "standardized": query(["panel"], "SELECT region, year, month, " + ", ".join(
            f"{r(f'({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()')} AS z_{c}"
            for c in ["rate_lag1", "rate_lag3", "supply_per_head"]) + " FROM panel"),
        "vif": query(["panel"], f"""
            SELECT feature, vif, CASE WHEN vif > 50 THEN 'High' WHEN vif > 10 THEN 'Elevated' ELSE 'Acceptable' END
                     AS assessment
            FROM (SELECT unnest(['rate_lag1', 'supply_per_head']) AS feature, {r('1 / (1 - ab * ab / (aa * bb))')} AS vif
                  FROM (SELECT sum(rate_lag1 * supply_per_head) AS ab, sum(rate_lag1 ** 2) AS aa,
                               sum(supply_per_head ** 2) AS bb FROM panel WHERE year < 2000))"""),
    }
    found["monthly_rate_by_year"] = query(["rolled", "population"], f"""
            SELECT year, month, incidents, population, {r('incidents / population * 100000', 1)} AS rate_per_100k,
                   {LABEL.format('month')} AS month_label
            FROM (SELECT year, month, sum(incidents)::BIGINT AS incidents FROM rolled GROUP BY ALL)
              JOIN (SELECT year, sum(total_population)::BIGINT AS population FROM population
                    WHERE (year, region) IN (SELECT (year, region) FROM rolled) GROUP BY year) USING (year)""")
    found["monthly_rate"] = (
        f"SELECT month, {r('rate')} AS rate_per_100k, {LABEL.format('month')} AS month_label, "
        f"rate = max(rate) OVER () AS is_peak FROM (SELECT month, avg(rate_per_100k) AS rate FROM ("
        f"{found['monthly_rate_by_year']}) GROUP BY month)"
    )
    per_year = ", ".join(
        f"max(total) FILTER (year = {y}) AS total_{y}, max(rate) FILTER (year = {y}) AS rate_{y}" for y in YEARS)
    found["assault_region_year"] = query(["cells"], f"""
            SELECT region, {per_year}, sum(total)::BIGINT AS total_all, {r('avg(rate)')} AS mean_rate
            FROM (SELECT region, year, sum(incidents)::BIGINT AS total, {EXACT_MEAN} AS rate
                  FROM cells GROUP BY region, year) GROUP BY region""")
    for name, value in [("histogram30", "incidents::DOUBLE"), ("histogram30_log", "ln(1 + incidents)")]:
        found[name] = query(["cells"], f"""
            SELECT bin::INT AS bin, {r('any_value(a)')} AS from_value, {r('any_value(b)')} AS to_value, count(x)::BIGINT AS n
            FROM (SELECT bin, lo + bin * step AS a, CASE WHEN bin = 29 THEN hi ELSE lo + (bin + 1) * step END AS b
                  FROM (SELECT unnest(range(30)) AS bin, min({value}) AS lo, max({value}) AS hi,
                               (max({value}) - min({value})) / 30 AS step FROM cells))
              LEFT JOIN (SELECT {value} AS x FROM cells) ON x >= a AND (x < b OR bin = 29 AND x <= b)
            GROUP BY bin""")
    for name, value in [("density_grid", "incidents::DOUBLE"), ("density_grid_log", "ln(1 + incidents)")]:
        kernel = "sum(exp(-0.5 * ((spot - value) / h) ** 2)) / (any_value(h) * sqrt(2 * pi()))"
        found[name] = query(["cells"], f"""
            SELECT point::INT AS point, {r('spot', 9)} AS x, {r(f'{kernel} / any_value(n)', 9)} AS density,
                   {r(f'{kernel} * any_value(hi - lo) / 30', 9)} AS curve
            FROM (SELECT point, h, n, lo, hi, lo + point * (hi - lo) / 199 AS spot
                  FROM (SELECT unnest(range(200)) AS point, min({value}) AS lo, max({value}) AS hi, count(*) AS n,
                               stddev_samp({value}) * count(*) ** -0.2 AS h FROM cells)), (SELECT {value} AS value FROM cells)
            GROUP BY point, spot""")
    found["trend_line"] = query(["cells"], f"""
            SELECT point::INT AS point, {r('spot')} AS x, {r('c + m * spot')} AS y
            FROM (SELECT point, c, m, lo + point * (hi - lo) / 99 AS spot
                  FROM (SELECT unnest(range(100)) AS point, regr_intercept(incidents, supply / 1000) AS c,
                               regr_slope(incidents, supply / 1000) AS m, min(supply / 1000) AS lo,
                               max(supply / 1000) AS hi FROM cells))""")
    names = {"incidents": "Incidents", "supply": "supply", "total_population": "Total Population", "credit": "credit",
             "returned_rows": "returned_rows", "filled_rows": "filled_rows"}
    found["corr_matrix"] = query(["cells"], " UNION ALL ".join(
        f"SELECT '{names[a]}' AS row_name, '{names[b]}' AS column_name, CASE WHEN stddev_pop({a}) * stddev_pop({b}) > 0 THEN {r(f'corr({a}, {b})')} END AS r FROM cells"
        for a in names for b in names))
    found["corr_wide"] = query(["rolled"], f"""
            , kinds AS (SELECT DISTINCT kind FROM rolled WHERE kind IS NOT NULL), months AS (SELECT DISTINCT year, month FROM rolled),
            cells AS (SELECT year, month, kind, coalesce(n, 0) AS n FROM months CROSS JOIN kinds LEFT JOIN
                        (SELECT year, month, kind, sum(incidents) AS n FROM rolled GROUP BY ALL) USING (year, month, kind))
            SELECT a.kind AS row_name, b.kind AS column_name,
                   CASE WHEN stddev_pop(a.n) * stddev_pop(b.n) > 0 THEN {r('corr(a.n, b.n)')} END AS r
            FROM cells a JOIN cells b USING (year, month) GROUP BY ALL""")
    root = "(sqrt(n) + 0.12 + 0.11 / sqrt(n)) * distance"
    tail = f"2 * (SELECT sum((-1) ** (k - 1) * exp(-2 * k * k * ({root}) ** 2)) FROM range(1, 20) s(k))"
    found["price_normality"] = query([], f"""
            WITH scored AS (
              SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS i, count(*) OVER () AS n,
                     (o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER () AS z FROM orders),
            below AS (SELECT *, 0.5 + {simpson_sql('(exp(-0.5 * {x} * {x}) / sqrt(2 * pi()))', 'z', 200)} AS f FROM scored),
            gap AS (SELECT any_value(n)::BIGINT AS n, max(greatest(i / n - f, f - (i - 1) / n)) AS distance FROM below)
            SELECT n, {r('distance', 9)} AS distance, {r(f'least(1, greatest(0, {tail}))', 9)} AS p_value,
                   CASE WHEN {tail} > 0.05 THEN 'not rejected' ELSE 'rejected' END AS normality FROM gap""")
    found["findings_summary"] = query(["rolled", "cells", "ranked"], f"""
            SELECT (SELECT {LABEL.format('month')} FROM rolled GROUP BY month ORDER BY sum(incidents) DESC, month LIMIT 1)
                     AS peak_month,
                   (SELECT region FROM ranked ORDER BY rate DESC, region LIMIT 1) AS top_region,
                   (SELECT {r('rate')} FROM ranked ORDER BY rate DESC, region LIMIT 1) AS top_rate,
                   {r('corr(supply, incidents)')} AS supply_r, {r('skewness(incidents)')} AS skew_raw,
                   {r('skewness(ln(1 + incidents))')} AS skew_log
            FROM cells""")

    # Models
    variants = ", ".join(f"({g}, '{n}', {p})" for g, (n, p) in enumerate(VARIANTS, 1))
    found["feature_ablation"] = query(["variant_error", "chosen"], f"""
            SELECT variant, features, {r('rmse')} AS rmse, {r('mae')} AS mae, g = (SELECT g FROM chosen) AS chosen,
                   split_part(variant, ':', 1) AS short_name
            FROM variant_error JOIN (VALUES {variants}) AS t(g, variant, features) USING (g)""")
    grid = f"""
            SELECT 'ridge' AS penalty, alpha, {r('cv_rmse')} AS cv_rmse, g = (SELECT g FROM best_alpha) AS chosen
            FROM grid WHERE g > 0"""
    feature = "CASE i " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FEATURES, 1)) + " END"
    found["residuals"] = query(["ols_test"], f"""
            SELECT region, year, month, {r('fitted')} AS fitted, {r('y - fitted')} AS residual FROM ols_test""")
    found["qq_positions"] = query(["scores"], f"""
            SELECT rn AS position, {r('level')} AS level, {r('theoretical')} AS theoretical, {r('e')} AS ordered
            FROM scores""")
    found["qq_line"] = query(["scores"], f"""
            SELECT {r('regr_slope(e, theoretical)')} AS slope, {r('regr_intercept(e, theoretical)')} AS intercept,
                   {r('corr(e, theoretical)')} AS r FROM scores""")
    shown = "region, year, month, month_label, actual, predicted, error, pct_error, abs_error"
    found["forecast_rows"] = query(["forecast"], f"SELECT {shown} FROM forecast")
    found["best5"] = query(["forecast"], f"""
            SELECT {shown} FROM forecast ORDER BY abs_error, region, year, month LIMIT 5""")
    found["worst5"] = query(["forecast"], f"""
            SELECT {shown} FROM forecast ORDER BY abs_error DESC, region, year, month LIMIT 5""")
    found["forecast_by_region"] = query(["forecast"], f"""
            SELECT region, {r('avg(actual)', 3)} AS avg_actual, {r('avg(predicted)', 3)} AS avg_predicted,
                   {r('sqrt(avg(error ** 2))', 3)} AS rmse, {r('avg(pct_error)', 3)} AS mean_pct_error
            FROM forecast GROUP BY region""")
    found["overall_error"] = query(["forecast"], f"""
            SELECT {r('sqrt(avg((predicted_exact - actual_exact) ** 2))', 2)} AS rmse,
                   {r('avg(abs(predicted_exact - actual_exact))', 2)} AS mae FROM forecast""")
    found["alpha_grid"] = query(["grid", "best_alpha", "lasso_grid", "best_lasso"], grid + f"""
            UNION ALL SELECT 'lasso', alpha, {r('cv_rmse')}, g = (SELECT g FROM best_lasso) FROM lasso_grid""")
    found["leaderboard"] = query(["tests", "winner"], f"""
            SELECT any_value(model) AS model, any_value(kind) AS kind, any_value(alpha) AS alpha,
                   {r('sqrt(avg((y - fitted) ** 2))')} AS rmse, {r('avg(abs(y - fitted))')} AS mae,
                   {r('sqrt(avg((exp(y) - exp(fitted)) ** 2))', 2)} AS rmse_rate, {r('any_value(cv_rmse)', 4)} AS cv_rmse,
                   m = (SELECT m FROM winner) AS chosen
            FROM tests GROUP BY m""")
    found["coefficients"] = query(["ridge_fit", "lasso_fit", "best_lasso"], f"""
            SELECT {feature} AS feature, {r('f.v')} AS ridge, {r('l.v')} AS lasso, abs(l.v) < 1e-6 AS lasso_zeroed
            FROM ridge_fit f JOIN lasso_fit l USING (i)
            WHERE i > 0 AND l.b = 0 AND l.g = (SELECT g FROM best_lasso)""")
    student = (
        "exp(lgamma(n / 2) - lgamma((n - 1) / 2)) / sqrt((n - 1) * pi()) * (1 + {x} * {x} / (n - 1)) ** (-n / 2)"
    )
    found["model_significance"] = query(["tests"], f"""
            SELECT model_a, model_b, n, {r('t')} AS t_stat, {r('p')} AS p_value, p < 0.05 AS significant
            FROM (SELECT *, 1 - 2 * {simpson_sql(student, 'abs(t)')} AS p
                  FROM (SELECT a.model AS model_a, b.model AS model_b, count(*)::BIGINT AS n,
                               avg(abs(a.y - a.fitted) - abs(b.y - b.fitted))
                                 / (stddev_samp(abs(a.y - a.fitted) - abs(b.y - b.fitted)) / sqrt(count(*))) AS t
                        FROM tests a JOIN tests b USING (region, year, month) WHERE a.m < b.m GROUP BY a.model, b.model))""")
    found["shapiro_test"] = query(["weights"], f"""
            SELECT n, {r('w')} AS w, {r('p')} AS p_value, CASE WHEN p > 0.05 THEN 'not rejected' ELSE 'rejected' END
                     AS normality
            FROM (SELECT *, 0.5 - {simpson_sql('(exp(-0.5 * {x} * {x}) / sqrt(2 * pi()))', 'score')} AS p
                  FROM (SELECT *, (ln(1 - w) - {polynomial_sql(LARGE_MEAN, 'ln(n)')})
                                    / exp({polynomial_sql(LARGE_LOG_SPREAD, 'ln(n)')}) AS score
                        FROM (SELECT count(*)::BIGINT AS n, sum(a * e) ** 2 / (var_pop(e) * count(*)) AS w FROM weights)))""")
    found["forecast_best_model"] = query(["tests", "winner"], f"""
            SELECT * REPLACE ({r('actual_exact', 3)} AS actual_exact, {r('predicted_exact', 3)} AS predicted_exact)
            FROM ({forecast_sql('(SELECT * FROM tests WHERE m = (SELECT m FROM winner))')})""")
    found["vif_chosen"] = query(["inverse", "raw_sums"], f"""
            SELECT {feature} AS feature, {r('vif')} AS vif,
                   CASE WHEN vif > 50 THEN 'High' WHEN vif > 10 THEN 'Elevated' ELSE 'Acceptable' END AS assessment
            FROM (SELECT i, s.v * n.v AS vif FROM inverse n JOIN raw_sums s USING (i)
                  WHERE n.k = n.p AND n.j = 100 + n.i AND s.j = s.i)""")
    model_parts("year, month, region")
    found["ridge_grid_time_order"] = query(["grid", "best_alpha"], grid)
    return found
