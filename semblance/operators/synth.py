"""Synthesiser: a Gaussian copula fitted by aggregates and sampled row by row.

Fit: quantile knots per numeric column, category shares per discrete column and
one correlation matrix of normal scores.  Generate: every row derives its own
draws from a hash of its number and the seed, so the output does not depend on
partitioning and a lost task recomputes the same rows.

Nonlinear relations between columns are only captured as rank correlation.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semblance.functions.scalars import col
from semblance.operators.compare import correlations, covariances
from semblance.operators.order import running_totals
from semblance.operators.prepare import hash_uniform, training_frame
from semblance.operators.profile import TableSchema, value_counts
from semblance.session import materialised

TAIL = 1e-6  # the score of a numeric column's smallest and largest value
PROBS = [0.0, 0.001, 0.005, *[i / 100 for i in range(1, 100)], 0.995, 0.999, 1.0]
ACCURACY = 20_000
ROWS_TO_SEND = 100_000  # categories of a column are broadcast up to this counted number, joined by shuffle beyond


def _z(p: float) -> float:
    return NormalDist().inv_cdf(min(max(p, TAIL), 1 - TAIL))


Z_KNOTS = [_z(p) for p in PROBS]

# Acklam's rational approximation of the normal quantile (relative error below 1.2e-9), highest power first.
CENTRE_TOP = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
CENTRE_BOTTOM = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
TAIL_TOP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
TAIL_BOTTOM = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
TAIL_FROM = 0.02425


def _polynomial(x: Column, powers: tuple[float, ...]) -> Column:
    out = F.lit(powers[0])
    for c in powers[1:]:
        out = out * x + F.lit(c)
    return out


def normal_score(p: Column) -> Column:
    """The standard normal quantile; minus and plus infinity at 0 and 1."""
    q = p - F.lit(0.5)
    tail = F.sqrt(F.lit(-2.0) * F.log(F.least(p, F.lit(1.0) - p)))
    outer = _polynomial(tail, TAIL_TOP) / _polynomial(tail, TAIL_BOTTOM)
    inner = _polynomial(q * q, CENTRE_TOP) * q / _polynomial(q * q, CENTRE_BOTTOM)
    return (
        F.when(p <= 0, F.lit(float("-inf"))).when(p >= 1, F.lit(float("inf")))
        .when(p < TAIL_FROM, outer).when(p > 1 - TAIL_FROM, -outer).otherwise(inner)
    )


@dataclass
class Marginal:
    """Value knots at the fixed probabilities of one numeric column."""

    knots: list[float]
    is_integer: bool


@dataclass
class SynthModel:
    schema: TableSchema
    columns: list[str]
    numeric: dict[str, Marginal]
    categories: DataFrame  # column, value, lo, hi, z
    correlation: np.ndarray
    rows: int


# -- piecewise-linear maps ---------------------------------------------------


def _segments(df: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """Adds ``__seg_<column>``: how many cuts are at or below the value, by binary search in the JVM."""
    if not cuts:
        return df
    # positional names, as the stage cannot address names with dots
    names = [f"__x{i}" for i in range(len(cuts))]
    found = Bucketizer(
        splitsArray=[[float("-inf"), *c, float("inf")] for c in cuts.values()], inputCols=names, outputCols=[f"{n}s" for n in names],
        handleInvalid="keep",
    ).transform(df.select("*", *[col(c).alias(n) for c, n in zip(cuts, names)]))
    return found.select(*map(col, df.columns), *[F.col(f"{n}s").cast("int").alias(f"__seg_{c}") for c, n in zip(cuts, names)])


def interpolated(df: DataFrame, maps: dict[str, tuple[list[float], list[float]]]) -> DataFrame:
    """Replace columns by a piecewise-linear function given as (xs, ys), flat outside.

    The segment is found by binary search in the JVM.
    """
    searched = {c: m for c, m in maps.items() if len(m[0]) > 2}
    out = _segments(df, {c: m[0][1:-1] for c, m in searched.items()})
    done = []
    for c in df.columns:
        if c not in maps:
            done.append(col(c))
            continue
        xs, ys = maps[c]
        if len(xs) == 1:
            done.append(F.when(col(c).isNotNull(), F.lit(float(ys[0]))).alias(c))
            continue
        slopes = [(y1 - y0) / (x1 - x0) for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:])]
        seg = (col(f"__seg_{c}") + 1) if c in searched else F.lit(1)
        at = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), seg)
        x = F.least(F.lit(float(xs[-1])), F.greatest(F.lit(float(xs[0])), col(c)))
        done.append(F.when(col(c).isNotNull(), at(ys[:-1]) + (x - at(xs[:-1])) * at(slopes)).alias(c))
    return out.select(*done)


def _score_map(m: Marginal) -> tuple[list[float], list[float]]:
    """Value to normal score; a value that spans several knots takes their middle."""
    xs = sorted(set(m.knots))
    zs = [[z for k, z in zip(m.knots, Z_KNOTS) if k == x] for x in xs]
    return xs, [(z[0] + z[-1]) / 2 for z in zs]


# -- fit ---------------------------------------------------------------------


def category_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, lo, hi, z): each category's share interval and the score of its middle."""
    counts = value_counts(df, columns)
    cum = running_totals(counts, ["count"], df.count() * len(columns))
    shares = cum.select(
        "column", "value",
        ((F.col("cum_count") - F.col("count")) / F.col("total_count")).alias("lo"),
        (F.col("cum_count") / F.col("total_count")).alias("hi"),
    )
    return shares.withColumn("z", normal_score((F.col("lo") + F.col("hi")) / 2))


def nearest_correlation(r: np.ndarray, floor: float = 1e-6) -> np.ndarray:
    """Positive definite with a unit diagonal, by lifting the eigenvalues."""
    r = r.copy()
    np.fill_diagonal(r, 1.0)
    values, vectors = np.linalg.eigh(r)
    fixed = vectors @ np.diag(np.maximum(values, floor)) @ vectors.T
    s = np.sqrt(np.diag(fixed))
    return fixed / np.outer(s, s)


def fit(df: DataFrame, schema: TableSchema) -> SynthModel:
    """Fit the generator to the labelled, filled rows of ``df``; skipped columns are not learned."""
    frame = training_frame(df, schema)
    columns = frame.columns
    numeric = [c for c in columns if c in schema.numeric]
    discrete = [c for c in columns if c not in schema.numeric]
    whole = lambda x: F.bool_and(F.abs(x - F.rint(x)) < F.lit(1e-9))
    row = frame.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.percentile_approx(col(c), PROBS, ACCURACY).alias(f"q{i}") for i, c in enumerate(numeric)],
        *[whole(col(c)).alias(f"w{i}") for i, c in enumerate(numeric)],
    ).first()
    marginals = {c: Marginal([float(v) for v in row[f"q{i}"]], bool(row[f"w{i}"])) for i, c in enumerate(numeric)}
    if discrete:
        categories = materialised(category_scores(frame, discrete))
    else:
        categories = frame.sparkSession.createDataFrame([], "column string, value string, lo double, hi double, z double")
    scores = interpolated(frame, {c: _score_map(m) for c, m in marginals.items()})
    sizes = _sizes(categories)
    for c in discrete:
        d = categories.where(F.col("column") == c).select(F.col("value").alias("__v"), F.col("z").alias("__z"))
        joined = scores.join(F.broadcast(d) if sizes.get(c, 0) <= ROWS_TO_SEND else d, col(c) == F.col("__v"))
        scores = joined.select(*[F.col("__z").alias(c) if n == c else col(n) for n in columns])
    r = nearest_correlation(correlations(covariances(scores, columns)))
    return SynthModel(schema, columns, marginals, categories, r, row["n"])


# -- generate ----------------------------------------------------------------


def _normal(k: int, seed: int) -> Column:
    """The k-th standard normal draw of a row; draws come in pairs."""
    u1 = hash_uniform(seed, F.col("id"), F.lit(k // 2), F.lit("radius"))
    u2 = hash_uniform(seed, F.col("id"), F.lit(k // 2), F.lit("angle"))
    turn = F.cos if k % 2 == 0 else F.sin
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * turn(u2 * F.lit(2 * np.pi))


def _condition_scores(model: SynthModel, column: str, value) -> tuple[float, float] | float:
    """The condition column's score: a constant, or the category's interval of probabilities."""
    if column in model.numeric:
        xs, zs = _score_map(model.numeric[column])
        return float(np.interp(float(value), xs, zs))
    if column not in model.columns:
        raise ValueError(f"Column '{column}' is not part of the model.")
    row = model.categories.where((F.col("column") == column) & (F.col("value") == str(value))).first()
    if row is None:
        raise ValueError(f"Column '{column}' has no category '{value}'.")
    return row["lo"], row["hi"]


def generate(
    spark: SparkSession, model: SynthModel, n: int, seed: int = 42, condition: dict | None = None
) -> DataFrame:
    """n rows; a condition fixes its first column to a value and the rest follow by correlation."""
    columns = list(model.columns)
    ids = spark.range(n)
    given = None
    if condition:
        column, value = next(iter(condition.items()))
        given = (column, value, _condition_scores(model, column, value))
        columns.remove(column)
        columns.insert(0, column)
    at = [model.columns.index(c) for c in columns]
    lower = np.linalg.cholesky(model.correlation[np.ix_(at, at)])
    draws = [_normal(k, seed).alias(f"e{k}") for k in range(len(columns))]
    if given and isinstance(given[2], float):
        draws[0] = F.lit(given[2]).alias("e0")
    elif given:
        lo, hi = given[2]
        # The draw lies inside (0, 1), so the score is finite over the whole interval.
        inside = hash_uniform(seed, F.col("id"), F.lit("condition")) + F.lit(2.0**-54)
        draws[0] = normal_score(F.lit(lo) + F.lit(hi - lo) * inside).alias("e0")
    base = ids.select("id", *draws)
    mixed = []
    for i, c in enumerate(columns):
        terms = [F.col(f"e{j}") * F.lit(float(lower[i, j])) for j in range(i + 1) if abs(lower[i, j]) > 1e-12]
        mixed.append(sum(terms[1:], terms[0]).alias(c))
    scores = base.select(F.col("id").alias("__id"), *mixed)
    out = interpolated(scores, {c: (Z_KNOTS, m.knots) for c, m in model.numeric.items()})
    out = _categories_from_scores(out, model, [c for c in columns if c not in model.numeric])
    done = []
    for c in model.columns:
        m = model.numeric.get(c)
        done.append((F.rint(col(c)) if m and m.is_integer else col(c)).alias(c))
    if given:
        done = [F.lit(given[1]).cast("double" if c in model.numeric else "string").alias(c) if c == given[0] else e for c, e in zip(model.columns, done)]
    return out.select(*done)


def _sizes(categories: DataFrame) -> dict[str, int]:
    """Categories of each column; one row per column."""
    return {r["column"]: r["count"] for r in categories.groupBy("column").count().collect()}


def _categories_from_scores(df: DataFrame, model: SynthModel, columns: list[str]) -> DataFrame:
    """Each score becomes the category whose score interval holds it, whatever the number of categories.

    Draws and categories meet in slots of about equal probability, as many as the column has categories, so a draw
    meets two categories on average.  A slot only brings the two sides together; the interval decides, in the
    same scores on both sides.
    """
    sizes, out = _sizes(model.categories), df
    for c in columns:
        n = sizes[c]
        # Close to the normal distribution function, and rising: all that slots need.
        slot = lambda z: F.floor(F.lit(float(n)) / (F.lit(1.0) + F.exp(F.lit(-1.702) * z))).cast("long")
        cats = model.categories.where(F.col("column") == c).select(
            F.col("value").alias("__value"), normal_score(F.col("lo")).alias("__from"), normal_score(F.col("hi")).alias("__to")
        )
        # In two steps, so that a category over nearly all slots makes no array of that length.
        first, last = slot(F.col("__from")), slot(F.col("__to"))
        cats = cats.select("*", F.explode(F.sequence(F.shiftright(first, 12), F.shiftright(last, 12))).alias("__block"))
        low, high = F.shiftleft("__block", 12), F.shiftleft("__block", 12) + F.lit(4_095)
        cats = cats.select("*", F.explode(F.sequence(F.greatest(first, low), F.least(last, high))).alias("__slot")).drop("__block")
        if n <= ROWS_TO_SEND:
            cats = F.broadcast(cats)
        met = out.withColumn("__slot", slot(col(c))).join(cats, "__slot").where((col(c) >= F.col("__from")) & (col(c) < F.col("__to")))
        out = met.select(*[F.col("__value").alias(x) if x == c else col(x) for x in df.columns])
    return out
