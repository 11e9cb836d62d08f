"""Two-table quality, report and privacy metrics."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from catalog.base import ORACLES, PAIR_SCHEMA, Tables, check, one_row, r, rounded
from semblance.operators import compare as C
from semblance.operators import privacy as V
from semblance.operators import report as R
from semblance.plans.evaluate import evaluate

BOTH = ("pair_real", "pair_syn")
NUMERIC = ("quantity", "price", "discount", "konst")
COERCED = (*NUMERIC, "num_text")
TEXT = ("num_text", "flag", "status")


def pair(t: Tables):
    return t("pair_real"), t("pair_syn")


def named(df):
    return df.withColumnRenamed("column", "column_name")


def long_sql(columns, cast: str) -> str:
    """Both tables in long form: column, value, 1 for real."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS c, CAST({c} AS {cast}) AS v, {k} AS r FROM {t} WHERE {c} IS NOT NULL"
        for t, k in (("pair_real", 1), ("pair_syn", 0)) for c in columns
    )


def freq_sql(columns) -> str:
    return f"SELECT c, v, sum(r) AS nr, sum(1 - r) AS ns FROM ({long_sql(columns, 'VARCHAR')}) GROUP BY c, v"


def hist_sql(columns, bins: int) -> str:
    return f"""
      SELECT g.c, g.b, coalesce(h.nr, 0) AS nr, coalesce(h.ns, 0) AS ns FROM
        (SELECT c, b FROM (SELECT DISTINCT c FROM edges WHERE hi > lo) CROSS JOIN range({bins}) AS x(b)) g
      LEFT JOIN (SELECT c, b, sum(r) AS nr, sum(1 - r) AS ns FROM (
        SELECT n.c, r, greatest(0, least({bins - 1}, CASE WHEN v < b0 * step + lo THEN b0 - 1 WHEN v >= (b0 + 1) * step + lo THEN b0 + 1 ELSE b0 END)) AS b
        FROM (SELECT l.*, lo, (hi - lo) / {bins} AS step, CAST(floor((v - lo) / ((hi - lo) / {bins})) AS INTEGER) AS b0
              FROM longs l JOIN edges e ON l.c = e.c WHERE hi > lo) n) GROUP BY c, b) h ON g.c = h.c AND g.b = h.b"""


def edges_sql(columns) -> str:
    return f"longs AS ({long_sql(columns, 'DOUBLE')}), edges AS (SELECT c, min(v) AS lo, max(v) AS hi FROM longs GROUP BY c)"


COVERAGE = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name,
        (SELECT count(TRY_CAST({c} AS DOUBLE)) / count(*) FROM pair_real) AS real_ratio,
        (SELECT count(TRY_CAST({c} AS DOUBLE)) / count(*) FROM pair_syn) AS synthetic_ratio, {'true' if c in NUMERIC else 'false'} AS numeric_type"""
    for c in (*NUMERIC, *TEXT)
)


@check(
    "common_numeric",
    f"""WITH k AS ({COVERAGE}) SELECT column_name, round(real_ratio, 6) AS real_ratio, round(synthetic_ratio, 6) AS synthetic_ratio,
        (numeric_type OR (real_ratio >= 0.8 AND synthetic_ratio >= 0.8)) AND real_ratio > 0 AND synthetic_ratio > 0 AS is_common FROM k""",
    BOTH,
)
def common_numeric(t: Tables):
    return rounded(named(C.common_numeric(*pair(t))).select("column_name", "real_ratio", "synthetic_ratio", "is_common"), real_ratio=6, synthetic_ratio=6)


@check(
    "frequency_pair",
    f"WITH f AS ({freq_sql(TEXT)}) SELECT c AS column_name, v AS value, CAST(nr AS BIGINT) AS n_real, CAST(ns AS BIGINT) AS n_synthetic FROM f",
    BOTH,
)
def frequency_pair(t: Tables):
    return named(C.frequency_pair(*pair(t), list(TEXT)))


@check(
    "histogram_pair",
    f"WITH {edges_sql(NUMERIC)}, h AS ({hist_sql(NUMERIC, 10)}) "
    "SELECT c AS column_name, CAST(b AS INTEGER) AS bin, CAST(nr AS BIGINT) AS n_real, CAST(ns AS BIGINT) AS n_synthetic FROM h",
    BOTH,
)
def histogram_pair(t: Tables):
    real, syn = pair(t)
    return named(C.histogram_pair(real, syn, C.joint_bounds(real, syn, list(NUMERIC)), 10))


KL = f"""
WITH {edges_sql(NUMERIC)}, h AS ({hist_sql(NUMERIC, 10)}), f AS ({freq_sql(TEXT)}),
m AS (SELECT c, nr + 1e-10 AS p, ns + 1e-10 AS q FROM h),
t AS (SELECT c, CASE WHEN nr > 0 THEN nr / sum(nr) OVER (PARTITION BY c) ELSE 1e-8 END AS p,
             CASE WHEN ns > 0 THEN ns / sum(ns) OVER (PARTITION BY c) ELSE 1e-8 END AS q FROM f),
s AS (SELECT c, p / sum(p) OVER (PARTITION BY c) AS p, q / sum(q) OVER (PARTITION BY c) AS q FROM (SELECT * FROM m UNION ALL SELECT * FROM t))
SELECT c AS column_name, round(sum(p * (ln(p + 1e-10) - ln(q + 1e-10))), 6) + 0e0 AS kl FROM s GROUP BY c"""


@check("kl_divergence", KL, BOTH)
def kl_divergence(t: Tables):
    return rounded(named(C.kl_divergence(*pair(t))), kl=6)


CDF = f"""vals AS (SELECT c, v, sum(r) AS nr, sum(1 - r) AS ns FROM ({long_sql(COERCED, 'DOUBLE')}) GROUP BY c, v),
cdf AS (SELECT c, v, nr, ns, sum(nr) OVER w / sum(nr) OVER (PARTITION BY c) AS f, sum(ns) OVER w / sum(ns) OVER (PARTITION BY c) AS g,
               lead(v) OVER (PARTITION BY c ORDER BY v) - v AS width FROM vals WINDOW w AS (PARTITION BY c ORDER BY v))"""


@check(
    "two_sample_cdf",
    f"WITH {CDF} SELECT c AS column_name, round(v, 4) AS v, round(f, 6) AS cdf_real, round(g, 6) AS cdf_synthetic, round(width, 4) AS width FROM cdf",
    BOTH,
)
def two_sample_cdf(t: Tables):
    cdf = named(C.two_sample_cdf(C.numeric_pair(*pair(t)))).withColumnRenamed("value", "v").drop("n_real", "n_synthetic")
    return rounded(cdf, v=4, cdf_real=6, cdf_synthetic=6, width=4)


@check(
    "two_sample_cdf_chunked",
    f"WITH {CDF} SELECT c AS column_name, round(v, 4) AS v, round(f, 6) AS cdf_real, round(g, 6) AS cdf_synthetic, round(width, 4) AS width FROM cdf",
    BOTH,
)
def two_sample_cdf_chunked(t: Tables):
    """The large-table path: each column's values cut into many chunks."""
    cdf = C.two_sample_cdf(C.numeric_pair(*pair(t)), chunks=16)
    return rounded(named(cdf).withColumnRenamed("value", "v").drop("n_real", "n_synthetic"), v=4, cdf_real=6, cdf_synthetic=6, width=4)


W1 = f"""
WITH {CDF}, d AS (SELECT c, sum(abs(f - g) * coalesce(width, 0)) / CASE WHEN max(v) FILTER (nr > 0) - min(v) FILTER (nr > 0) <= 1e-12
       THEN greatest(abs(min(v) FILTER (nr > 0)), abs(max(v) FILTER (ns > 0)), abs(min(v) FILTER (ns > 0)), 1)
       ELSE max(v) FILTER (nr > 0) - min(v) FILTER (nr > 0) END AS distance FROM cdf GROUP BY c)"""


@check(
    "wasserstein",
    W1 + " SELECT c AS column_name, round(distance, 6) + 0e0 AS distance FROM d UNION ALL SELECT 'mean', round(avg(distance), 6) FROM d",
    BOTH,
)
def wasserstein(t: Tables):
    by, mean = C.wasserstein(C.numeric_pair(*pair(t)))
    rows = [*by.items(), ("mean", mean)]
    return rounded(t.spark.createDataFrame(rows, "column_name string, distance double"), distance=6)


def _filled_sql(columns) -> str:
    fill = ", ".join(f"median(CAST({c} AS DOUBLE)) AS {c}" for c in columns)
    put = ", ".join(f"coalesce(CAST(t.{c} AS DOUBLE), m.{c}) AS {c}" for c in columns)
    return f"m AS (SELECT {fill} FROM pair_real), a AS (SELECT {put} FROM pair_real t, m), b AS (SELECT {put} FROM pair_syn t, m)"


def _r_sql(x: str, y: str, t: str) -> str:
    return (
        f"(SELECT CASE WHEN var_pop({x}) > 0 AND var_pop({y}) > 0 THEN covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})) "
        f"ELSE 0 END FROM {t})"
    )


CORR = " UNION ALL ".join(
    f"SELECT '{x}' AS column_a, '{y}' AS column_b, {_r_sql(x, y, 'a')} AS r_real, {_r_sql(x, y, 'b')} AS r_synthetic" for x in COERCED for y in COERCED
)


@check(
    "correlation_matrix",
    f"WITH {_filled_sql(COERCED)} SELECT column_a, column_b, round(r_real, 6) + 0e0 AS r_real, round(r_synthetic, 6) + 0e0 AS r_synthetic FROM ({CORR})",
    BOTH,
)
def correlation_matrix(t: Tables):
    return rounded(C.correlation_matrix(C.numeric_pair(*pair(t))), r_real=6, r_synthetic=6)


@check(
    "correlation_difference",
    f"""WITH {_filled_sql(COERCED)}, d AS (SELECT column_a, column_b, abs(r_real - r_synthetic) AS d FROM ({CORR}))
        SELECT round(max(d), 6) AS max_diff, round(avg(d) FILTER (column_a < column_b), 6) AS mean_diff,
               round(stddev_pop(d) FILTER (column_a < column_b), 6) AS std_diff FROM d""",
    BOTH,
)
def correlation_difference(t: Tables):
    found = C.correlation_difference(C.numeric_pair(*pair(t)))
    return rounded(one_row(t.spark, **found), max_diff=6, mean_diff=6, std_diff=6)


PCA_REAL = "SELECT o_totalprice AS x, o_totalprice*5e-1 + (o_custkey % 1000)*1e1 AS y FROM orders"
PCA_SYN = "SELECT o_totalprice*9e-1 AS x, o_totalprice*3e-1 + (o_custkey % 1000)*2e2 AS y FROM orders"


@check(
    "pca_variance",
    f"""WITH a AS ({PCA_REAL}), b AS ({PCA_SYN}),
      k AS (SELECT var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) AS r FROM a),
      s AS (SELECT var_pop(x) / vx AS sx, var_pop(y) / vy AS sy, covar_pop(x, y) / sqrt(vx * vy) AS sxy, r FROM b, k GROUP BY vx, vy, r)
      SELECT round(CASE WHEN (1 + abs(r)) / 2 >= 0.95 THEN ((sx + sy) / 2 + sign(r) * sxy) / (sx + sy) ELSE 1 END, 6) AS pca_variance FROM s""",
)
def pca_variance(t: Tables):
    """Two columns, where the principal axes are known in closed form."""
    table = lambda sql: t.spark.sql(sql.replace("FROM orders", "FROM {orders}"), orders=t("orders"))
    return one_row(t.spark, pca_variance=round(C.pca_variance_retained(C.numeric_pair(table(PCA_REAL), table(PCA_SYN))), 6))


# -- sets --------------------------------------------------------------------


@check(
    "stack_labeled",
    f"""SELECT origin, count(*) AS n, round(sum(price), 2) AS price FROM (
        SELECT 1 AS origin, price FROM pair_real UNION ALL SELECT 0, price FROM pair_syn) GROUP BY origin""",
    BOTH,
)
def stack_labeled(t: Tables):
    both = C.stacked(*pair(t))
    return both.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), r(F.sum("price"), 2).alias("price"))


@check("category_union", f"WITH f AS ({freq_sql(TEXT)}) SELECT c AS column_name, v AS value FROM f", BOTH)
def category_union(t: Tables):
    return named(C.category_union(*pair(t), list(TEXT)))


@check("label_intersect", "SELECT flag AS label FROM pair_real WHERE flag IS NOT NULL INTERSECT SELECT flag FROM pair_syn", BOTH)
def label_intersect(t: Tables):
    return C.shared_labels(*pair(t), "flag")


@check(
    "category_except",
    f"WITH f AS ({freq_sql(TEXT)}) SELECT c AS column_name, v AS value, CASE WHEN nr = 0 THEN 'novel' ELSE 'lost' END AS status FROM f WHERE nr = 0 OR ns = 0",
    BOTH,
)
def category_except(t: Tables):
    return named(C.category_difference(*pair(t), list(TEXT)))


# -- report ------------------------------------------------------------------

TV = """SELECT c, 0.5e0 * sum(abs(nr / tr - ns / ts)) AS tv FROM (SELECT c, nr, ns, sum(nr) OVER (PARTITION BY c) AS tr,
        sum(ns) OVER (PARTITION BY c) AS ts FROM {f}) GROUP BY c"""


@check("tv_distance", f"WITH f AS ({freq_sql(TEXT)}) SELECT c AS column_name, round(tv, 6) AS tv FROM ({TV.format(f='f')})", BOTH)
def tv_distance(t: Tables):
    return rounded(named(R.tv_distance(C.frequency_pair(*pair(t), list(TEXT)))), tv=6)


@check("tv_complement", f"WITH f AS ({freq_sql(TEXT)}) SELECT c AS column_name, round(1 - tv, 6) AS score FROM ({TV.format(f='f')})", BOTH)
def tv_complement(t: Tables):
    return rounded(named(R.tv_complement(*pair(t), list(TEXT))), score=6)


@check("ks_complement", f"WITH {CDF} SELECT c AS column_name, round(1 - max(abs(f - g)), 6) AS score FROM cdf GROUP BY c", BOTH)
def ks_complement(t: Tables):
    return rounded(named(R.ks_complement(C.numeric_pair(*pair(t)))), score=6)


def _pair_r(x: str, y: str, t: str) -> str:
    ok = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    return f"(SELECT CASE WHEN var_pop({x}) > 0 AND var_pop({y}) > 0 THEN covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})) ELSE 0 END FROM {t} WHERE {ok})"


PAIR_CORR = " UNION ALL ".join(
    f"SELECT '{x}' AS c1, '{y}' AS c2, 1 - abs({_pair_r(x, y, 'pair_real')} - {_pair_r(x, y, 'pair_syn')}) / 2 AS s" for x, y in combinations(NUMERIC, 2)
)


@check("pair_correlation", f"SELECT c1 AS column_1, c2 AS column_2, round(s, 6) AS score FROM ({PAIR_CORR})", BOTH)
def pair_correlation(t: Tables):
    return rounded(R.pair_correlation(*pair(t), list(NUMERIC)), score=6)


def contingency_sql() -> str:
    """Joint shares of every pair with a category; numbers in ten bins of the real range."""
    bound = "bnd AS (SELECT " + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in NUMERIC) + " FROM pair_real)"

    def cell(c):
        if c in NUMERIC:
            step = f"((hi_{c} - lo_{c}) / 10)"
            b = f"CAST(floor(({c} - lo_{c}) / {step}) AS INTEGER)"
            exact = f"CASE WHEN {c} < {b} * {step} + lo_{c} THEN {b} - 1 WHEN {c} >= ({b} + 1) * {step} + lo_{c} THEN {b} + 1 ELSE {b} END"
            return (
                f"CASE WHEN {c} IS NULL THEN '__missing__' WHEN hi_{c} <= lo_{c} THEN '0' "
                f"ELSE CAST(greatest(0, least(9, {exact})) AS VARCHAR) END AS {c}"
            )
        return f"CASE WHEN {c} IS NULL OR {c} IN ('nan', '<NA>') THEN '__missing__' ELSE {c} END AS {c}"

    cells = ", ".join(cell(c) for c in (*NUMERIC, *TEXT))
    pairs = [(x, y) for x, y in combinations((*NUMERIC, *TEXT), 2) if y in TEXT]
    rows = " UNION ALL ".join(f"SELECT '{x}' AS c1, '{y}' AS c2, {x} AS a, {y} AS b, r FROM cells" for x, y in pairs)
    return f"""{bound}, cells AS (SELECT {cells}, 1 AS r FROM pair_real, bnd UNION ALL SELECT {cells}, 0 FROM pair_syn, bnd),
      joint_rows AS ({rows}), joint_n AS (SELECT c1, c2, a, b, sum(r) AS nr, sum(1 - r) AS ns FROM joint_rows GROUP BY ALL),
      contingency AS (SELECT c1, c2, 1 - 0.5e0 * sum(abs(nr / tr - ns / ts)) AS s FROM (SELECT *, sum(nr) OVER (PARTITION BY c1, c2) AS tr,
        sum(ns) OVER (PARTITION BY c1, c2) AS ts FROM joint_n) GROUP BY c1, c2)"""


@check("pair_contingency", f"WITH {contingency_sql()} SELECT c1 AS column_1, c2 AS column_2, round(s, 6) AS score FROM contingency", BOTH)
def pair_contingency(t: Tables):
    return rounded(R.pair_contingency(*pair(t), list(NUMERIC), list(TEXT)), score=6)


BOUNDARY = " UNION ALL ".join(
    f"SELECT '{c}' AS c, (SELECT avg(CASE WHEN {c} BETWEEN lo AND hi THEN 1e0 WHEN {c} IS NOT NULL THEN 0e0 END) FROM pair_syn, "
    f"(SELECT min({c}) AS lo, max({c}) AS hi FROM pair_real)) AS s" for c in NUMERIC
)
ADHERENCE = "SELECT c, sum(CASE WHEN nr > 0 THEN ns ELSE 0 END) / sum(ns) AS s FROM f GROUP BY c"


@check("boundary_adherence", f"SELECT c AS column_name, round(s, 6) AS score FROM ({BOUNDARY})", BOTH)
def boundary_adherence(t: Tables):
    return rounded(named(R.boundary_adherence(*pair(t), list(NUMERIC))), score=6)


@check("category_adherence", f"WITH f AS ({freq_sql(TEXT)}) SELECT c AS column_name, round(s, 6) AS score FROM ({ADHERENCE})", BOTH)
def category_adherence(t: Tables):
    return rounded(named(R.category_adherence(*pair(t), list(TEXT))), score=6)


@check(
    "quality_report",
    f"""WITH f AS ({freq_sql(TEXT)}), {CDF}, {contingency_sql()}, scores AS (
      SELECT 'quality' AS report, 'Column Shapes' AS property, 1 - max(abs(f - g)) AS s FROM cdf WHERE c <> 'num_text' GROUP BY c
      UNION ALL SELECT 'quality', 'Column Shapes', 1 - tv FROM ({TV.format(f='f')})
      UNION ALL SELECT 'quality', 'Column Pair Trends', s FROM ({PAIR_CORR})
      UNION ALL SELECT 'quality', 'Column Pair Trends', s FROM contingency
      UNION ALL SELECT 'diagnostic', 'Data Validity', s FROM ({BOUNDARY})
      UNION ALL SELECT 'diagnostic', 'Data Validity', s FROM ({ADHERENCE})
      UNION ALL SELECT 'diagnostic', 'Data Structure', 1e0),
    p AS (SELECT report, property, avg(s) AS s FROM scores GROUP BY report, property)
    SELECT report, property, round(s, 4) AS score FROM p UNION ALL SELECT report, 'overall', round(avg(s), 4) FROM p GROUP BY report""",
    BOTH,
)
def quality_report(t: Tables):
    return R.quality_report(*pair(t), PAIR_SCHEMA)


# -- privacy -----------------------------------------------------------------


@check(
    "dp_estimate",
    f"""WITH {edges_sql(NUMERIC)}, h AS ({hist_sql(NUMERIC, 20)}), f AS ({freq_sql(TEXT)}),
      cells AS (SELECT c, nr, ns FROM h UNION ALL SELECT c, nr, ns FROM f),
      tv AS (SELECT c, 0.5e0 * sum(abs((nr + 1e-9) / tr - (ns + 1e-9) / ts)) AS tv FROM (SELECT c, nr, ns, sum(nr + 1e-9) OVER (PARTITION BY c) AS tr,
        sum(ns + 1e-9) OVER (PARTITION BY c) AS ts FROM cells) GROUP BY c),
      m AS (SELECT least(avg(tv), 1 - 1e-9) AS t FROM tv)
      SELECT round(t, 6) AS mean_tv, round(least(10, ln((1 + t) / (1 - t))), 6) AS epsilon, 1e-5 AS delta, 0.95e0 AS confidence FROM m""",
    BOTH,
)
def dp_estimate(t: Tables):
    return rounded(V.budget_estimate(*pair(t)), mean_tv=6, epsilon=6)


# Accounts of customers and suppliers: two whole tables with the same two numbers.
ACCOUNTS = """real AS (SELECT c_acctbal AS balance, CAST(c_nationkey AS DOUBLE) AS nation FROM customer),
syn AS (SELECT s_acctbal * 1.2e0 AS balance, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE CAST(s_nationkey AS DOUBLE) END AS nation FROM supplier)"""
SCALED = ACCOUNTS + """,
st AS (SELECT min(balance) AS lb, max(balance) - min(balance) AS rb, min(nation) AS ln, max(nation) - min(nation) AS rn, median(balance) AS mb, median(nation) AS mn FROM real),
a AS (SELECT least(5, greatest(-5, (balance - lb) / rb)) AS x, least(5, greatest(-5, (nation - ln) / rn)) AS y FROM real, st),
b AS (SELECT row_number() OVER () AS i, least(5, greatest(-5, (coalesce(balance, mb) - lb) / rb)) AS x,
             least(5, greatest(-5, (coalesce(nation, mn) - ln) / rn)) AS y FROM syn, st),
dist AS (SELECT i, b.x, b.y, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS d FROM b, a)"""


def accounts(t: Tables):
    real = t("customer").selectExpr("c_acctbal AS balance", "cast(c_nationkey AS double) AS nation")
    syn = t("supplier").selectExpr(
        "s_acctbal * 1.2e0 AS balance", "CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE cast(s_nationkey AS double) END AS nation"
    )
    return real, syn


@check("normalized_matrix", f"WITH {SCALED} SELECT 'real' AS side, round(x, 6) AS x, round(y, 6) AS y FROM a UNION ALL SELECT 'synthetic', round(x, 6), round(y, 6) FROM b")
def normalized_matrix(t: Tables):
    a, b = V.normalized_matrices(C.numeric_pair(*accounts(t)))
    side = lambda df, s: df.select(F.lit(s).alias("side"), r(F.col("balance")).alias("x"), r(F.col("nation")).alias("y"))
    return side(a, "real").unionByName(side(b, "synthetic"))


@check(
    "nearest_neighbor",
    f"WITH {SCALED}, n AS (SELECT i, x, y, min(d) AS d FROM dist GROUP BY i, x, y) SELECT round(x, 6) AS x, round(y, 6) AS y, count(*) AS n, round(min(d), 6) AS distance FROM n GROUP BY x, y",
)
def nearest_neighbor(t: Tables):
    near = V.nearest_real(C.numeric_pair(*accounts(t)))
    return near.select(
        r(F.col("p")[0]).alias("x"), r(F.col("p")[1]).alias("y"), F.col("weight").alias("n"), r(F.col("distance")).alias("distance")
    )


@check(
    "k_anonymity",
    f"""WITH {SCALED}, n AS (SELECT i, min(d) AS d FROM dist GROUP BY i), th AS (SELECT quantile_cont(d, 0.75) AS t FROM n),
      k AS (SELECT i, count(*) FILTER (d <= t) AS k FROM dist, th GROUP BY i)
      SELECT round((SELECT t FROM th), 6) AS threshold, CAST(floor(median(k)) AS BIGINT) AS k FROM k""",
)
def k_anonymity(t: Tables):
    found = V.k_anonymity_numeric(C.numeric_pair(*accounts(t)))
    return one_row(t.spark, threshold=round(found["threshold"], 6), k=found["k"])


KEYS = "SELECT concat(coalesce(num_text, '__missing__'), chr(31), coalesce(flag, '__missing__'), chr(31), coalesce(status, '__missing__')) AS key FROM {t}"


@check(
    "k_anonymity_categorical",
    f"""WITH a AS ({KEYS.format(t='pair_real')}), b AS ({KEYS.format(t='pair_syn')}), ca AS (SELECT key, count(*) AS n FROM a GROUP BY key),
      j AS (SELECT b.key, coalesce(n, 0) AS n FROM b LEFT JOIN ca ON b.key = ca.key)
      SELECT key, count(*) AS rows, max(n) AS n, (SELECT CAST(floor(median(n)) AS BIGINT) FROM j) AS k FROM j GROUP BY key""",
    BOTH,
)
def k_anonymity_categorical(t: Tables):
    real, syn = (df.select(*TEXT) for df in pair(t))
    k = V.k_anonymity_categorical(real, syn)
    return V.category_key_counts(real, syn).select("key", F.col("weight").alias("rows"), "n", F.lit(k).cast("bigint").alias("k"))


RANGES = """(VALUES ('privacy', 'epsilon', 1, 1), ('privacy', 'k_anonymity', 1, 1), ('privacy', 'membership_auc', 1, 1), ('quality', 'kl_divergence', 7, 7),
       ('quality', 'max_diff', 1, 1), ('quality', 'mean_diff', 1, 1), ('quality', 'std_diff', 1, 1), ('quality', 'pca_variance_retained', 1, 1), ('quality', 'wasserstein', 1, 1), ('quality', 'wasserstein_column', 5, 5)) AS v(section, metric, n_rows, n_in_range)"""
# Counts of all metrics, then the values of those that the oracles of their parts know.
EVALUATED = f"""SELECT section, metric, NULL AS item, NULL AS value, n_rows, n_in_range FROM {RANGES}
    UNION ALL SELECT 'report', 'synthetic_to_real_f1', NULL, NULL, 1, 1
    UNION ALL SELECT 'report', report || '.score', NULL, NULL, count(*), count(*) FILTER (score BETWEEN 0 AND 1) FROM ({ORACLES['quality_report']}) GROUP BY report
    UNION ALL SELECT 'report', report || '.score', property, score, 1, 1 FROM ({ORACLES['quality_report']})
    UNION ALL SELECT 'quality', 'kl_divergence', column_name, kl, 1, 1 FROM ({ORACLES['kl_divergence']})
    UNION ALL SELECT 'quality', 'wasserstein_column', column_name, distance, 1, 1 FROM ({ORACLES['wasserstein']}) WHERE column_name <> 'mean'
    UNION ALL SELECT 'quality', 'wasserstein', '', distance, 1, 1 FROM ({ORACLES['wasserstein']}) WHERE column_name = 'mean'
    UNION ALL SELECT 'quality', unnest(['max_diff', 'mean_diff', 'std_diff']), '', unnest([max_diff, mean_diff, std_diff]), 1, 1 FROM ({ORACLES['correlation_difference']})
    UNION ALL SELECT 'privacy', 'epsilon', '', epsilon, 1, 1 FROM ({ORACLES['dp_estimate']})"""
KNOWN = ("kl_divergence", "wasserstein_column", "wasserstein", "max_diff", "mean_diff", "std_diff", "epsilon", "quality.score", "diagnostic.score")


@check("evaluate_pair", EVALUATED)
def evaluate_pair(t: Tables):
    """Every metric's rows and those within its range, the learned ones and the report included, and the values of those with an oracle.

    A failure that the evaluation records is one more metric here, which the oracle does not have.
    """
    found = evaluate(*pair(t), PAIR_SCHEMA)
    share = (F.col("section") == "report") | F.col("metric").isin("membership_auc", "pca_variance_retained")
    inside = (F.col("value") >= 0) & (~share | (F.col("value") <= 1.0001))
    counts = found.groupBy("section", "metric").agg(F.count(F.lit(1)).cast("int").alias("n_rows"), F.count(F.when(inside, 1)).cast("int").alias("n_in_range"))
    counts = counts.select("section", "metric", F.lit(None).cast("string").alias("item"), F.lit(None).cast("double").alias("value"), "n_rows", "n_in_range")
    known = found.where(F.col("metric").isin(*KNOWN))
    return counts.unionByName(known.select("section", "metric", F.coalesce("item", F.lit("")).alias("item"), r(F.col("value")).alias("value"), F.lit(1).alias("n_rows"), F.lit(1).alias("n_in_range")))
