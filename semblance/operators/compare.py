"""Two-table comparison: shared columns, frequencies, distances, correlation, PCA."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semblance.functions.scalars import col, is_numeric, label, number, safe_ratio
from semblance.operators.order import chunks_for, medians, running_totals, sampled_cuts
from semblance.session import ship

# Fixed values.
COERCIBLE_SHARE = 0.8
KL_BINS = 10
BIN_SMOOTHING = 1e-10
ABSENT_SHARE = 1e-8
LOG_SMOOTHING = 1e-10
VARIANCE_KEPT = 0.95


def shared_columns(real: DataFrame, synthetic: DataFrame) -> list[str]:
    """Columns of both tables in the real table's order."""
    return [c for c in real.columns if c in set(synthetic.columns)]


def numeric_by_type(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if is_numeric(real.schema[c].dataType) or is_numeric(synthetic.schema[c].dataType)]


def as_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[number(col(c), df.schema[c].dataType).alias(c) for c in columns])


def as_labels(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[label(col(c), df.schema[c].dataType).alias(c) for c in columns])


def coverage(df: DataFrame, columns: list[str], side: str) -> DataFrame:
    """(column, rows, number count) in one aggregate."""
    if not columns:
        return df.sparkSession.createDataFrame([], f"column string, {side}_rows bigint, {side}_count bigint")
    nums = as_numbers(df, columns)
    agg = nums.agg(F.count(F.lit(1)).alias("n"), *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col("n").alias(f"{side}_rows"), F.col(f"c{i}").alias(f"{side}_count"))
            for i, c in enumerate(columns)
        ]
    )
    return agg.select(F.inline(rows))


def common_numeric(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Which shared columns count as numeric on both sides, and why."""
    columns = shared_columns(real, synthetic)
    typed = set(numeric_by_type(real, synthetic, columns))
    # one row per column on either side
    both = coverage(real, columns, "real").join(F.broadcast(coverage(synthetic, columns, "synthetic")), "column")
    share = lambda side: F.coalesce(safe_ratio(F.col(f"{side}_count"), F.col(f"{side}_rows")), F.lit(0.0))
    by_type = F.col("column").isin(*typed) if typed else F.lit(False)
    enough = (share("real") >= COERCIBLE_SHARE) & (share("synthetic") >= COERCIBLE_SHARE)
    some = (F.col("real_count") > 0) & (F.col("synthetic_count") > 0)
    return both.select(
        *both.columns, share("real").alias("real_ratio"), share("synthetic").alias("synthetic_ratio"),
        by_type.alias("numeric_type"), ((by_type | enough) & some).alias("is_common"),
    )


@dataclass
class NumericPair:
    """The common numeric columns of two tables as doubles, found once and shared."""

    columns: list[str]
    real: DataFrame
    synthetic: DataFrame
    rows: int  # of both sides, for sizing
    gaps: list[str] | None = None  # columns with nulls on either side; None if not known
    _fill: dict[str, float] | None = None
    _covariances: tuple[np.ndarray, np.ndarray] | None = None

    def covariances(self) -> tuple[np.ndarray, np.ndarray]:
        """Covariance matrices of both filled tables, computed once."""
        if self._covariances is None:
            self._covariances = tuple(covariances(t, self.columns) for t in self.filled())
        return self._covariances

    @property
    def fill(self) -> dict[str, float]:
        """The real table's medians, of the columns that have something to fill."""
        if self._fill is None:
            gaps = self.columns if self.gaps is None else self.gaps
            self._fill = medians(self.real, {c: col(c) for c in gaps})
        return self._fill

    def filled(self) -> tuple[DataFrame, DataFrame]:
        """Both tables with nulls replaced by the real medians."""
        put = [(F.coalesce(col(c), F.lit(self.fill[c])) if c in self.fill else col(c)).alias(c) for c in self.columns]
        return self.real.select(*put), self.synthetic.select(*put)


def numeric_pair(real: DataFrame, synthetic: DataFrame) -> NumericPair:
    found = {r["column"]: r for r in common_numeric(real, synthetic).where("is_common").collect()}  # one row per column
    columns = [c for c in shared_columns(real, synthetic) if c in found]
    some = next(iter(found.values()), None)
    gaps = [c for c, r in found.items() if r["real_count"] < r["real_rows"] or r["synthetic_count"] < r["synthetic_rows"]]
    return NumericPair(
        columns, as_numbers(real, columns), as_numbers(synthetic, columns), some["real_rows"] + some["synthetic_rows"] if some else 0, gaps
    )


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.unpivot([], [col(c) for c in columns], "column", "value").where(F.col("value").isNotNull())


def stacked(real: DataFrame, synthetic: DataFrame, name: str = "origin", marks=(1, 0)) -> DataFrame:
    """Real and synthetic rows in one table with a label (or a weight) per origin."""
    columns = shared_columns(real, synthetic)
    return (
        real.select(*map(col, columns)).withColumn(name, F.lit(marks[0]))
        .unionByName(synthetic.select(*map(col, columns)).withColumn(name, F.lit(marks[1])))
    )


def _both_counts(real: DataFrame, synthetic: DataFrame, columns: list[str], *keys: Column) -> DataFrame:
    """Per (column, key...) how many real and synthetic values: one shuffle for all columns."""
    both = _long(real, columns).withColumn("__r", F.lit(1)).unionByName(_long(synthetic, columns).withColumn("__r", F.lit(0)))
    return both.groupBy("column", *keys).agg(
        F.sum("__r").cast("bigint").alias("n_real"), F.sum(1 - F.col("__r")).cast("bigint").alias("n_synthetic")
    )


def frequency_pair(real: DataFrame, synthetic: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value text, n_real, n_synthetic): the full outer alignment of categories."""
    columns = columns or shared_columns(real, synthetic)
    return _both_counts(as_labels(real, columns), as_labels(synthetic, columns), columns, F.col("value"))


def joint_bounds(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Joint min and max per column; columns with an empty side are left out."""
    out = {}
    if columns:
        aggs = [f(col(c)).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))]
        a, b = as_numbers(real, columns).agg(*aggs).first(), as_numbers(synthetic, columns).agg(*aggs).first()
        for i, c in enumerate(columns):
            if a[f"lo{i}"] is not None and b[f"lo{i}"] is not None:
                out[c] = (min(a[f"lo{i}"], b[f"lo{i}"]), max(a[f"hi{i}"], b[f"hi{i}"]))
    return out


def bin_of(v: Column, low: float, high: float, bins: int) -> Column:
    """Equal-width bin by the edges ``low + i*step``; the last bin is closed."""
    step = (high - low) / bins
    if step <= 0:
        return F.when(v.isNotNull(), F.lit(0))
    b = F.floor((v - F.lit(low)) / F.lit(step)).cast("int")
    exact = F.when(v < b * F.lit(step) + F.lit(low), b - 1).when(v >= (b + 1) * F.lit(step) + F.lit(low), b + 1).otherwise(b)
    return F.when(v.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(bins - 1), exact)))


def histogram_pair(
    real: DataFrame, synthetic: DataFrame, bounds: dict[str, tuple[float, float]], bins: int = KL_BINS
) -> DataFrame:
    """(column, bin, n_real, n_synthetic) for every bin of every column, empty bins included."""
    columns = list(bounds)
    spark = real.sparkSession
    cut = lambda df: as_numbers(df, columns).select(*[bin_of(col(c), *bounds[c], bins).alias(c) for c in columns])
    counts = _both_counts(cut(real), cut(synthetic), columns, F.col("value").alias("bin"))
    grid = spark.createDataFrame(
        [(c, b, 0, 0) for c in columns for b in range(bins)], "column string, bin int, n_real bigint, n_synthetic bigint"
    )
    return counts.unionByName(grid).groupBy("column", "bin").agg(
        F.sum("n_real").alias("n_real"), F.sum("n_synthetic").alias("n_synthetic")
    )


def _split_kinds(real: DataFrame, synthetic: DataFrame):
    """Numeric columns with bounds, and the columns compared by category.

    A column is numeric by type on either side with a number on both; anything
    else is compared as text.
    """
    columns = shared_columns(real, synthetic)
    bounds = joint_bounds(real, synthetic, numeric_by_type(real, synthetic, columns))
    text = [c for c in columns if c not in bounds]
    varying = {c: b for c, b in bounds.items() if b[0] < b[1]}
    constant = [c for c in bounds if c not in varying]
    return columns, varying, constant, text


def kl_divergence(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """(column, kl) for every shared column; 0 where a side is empty or constant."""
    columns, varying, _, text = _split_kinds(real, synthetic)
    parts = []
    if varying:
        h = histogram_pair(real, synthetic, varying, KL_BINS).select(
            "column", (F.col("n_real") + F.lit(BIN_SMOOTHING)).alias("p"), (F.col("n_synthetic") + F.lit(BIN_SMOOTHING)).alias("q")
        )
        totals = h.groupBy("column").agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
        parts.append(_kl_sum(h.join(F.broadcast(totals), "column")))
    if text:
        f = frequency_pair(real, synthetic, text)
        n = f.groupBy("column").agg(F.sum("n_real").alias("nr"), F.sum("n_synthetic").alias("ns")).where("nr > 0 AND ns > 0")
        share = lambda k, t: F.when(F.col(k) > 0, F.col(k) / F.col(t)).otherwise(F.lit(ABSENT_SHARE))
        # one row per column, so the totals may be broadcast
        shares = f.join(F.broadcast(n), "column").select("column", share("n_real", "nr").alias("p"), share("n_synthetic", "ns").alias("q"))
        totals = shares.groupBy("column").agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
        parts.append(_kl_sum(shares.join(F.broadcast(totals), "column")))
    return _with_zeroes(real, columns, parts, "kl")


def _kl_sum(h: DataFrame) -> DataFrame:
    p, q = F.col("p") / F.col("sp"), F.col("q") / F.col("sq")
    term = p * (F.log(p + F.lit(LOG_SMOOTHING)) - F.log(q + F.lit(LOG_SMOOTHING)))
    return h.groupBy("column").agg(F.sum(term).alias("kl"))


def _with_zeroes(real: DataFrame, columns: list[str], parts: list[DataFrame], name: str) -> DataFrame:
    base = real.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    if not parts:
        return base.withColumn(name, F.lit(0.0))
    scores = parts[0]
    for p in parts[1:]:
        scores = scores.unionByName(p)
    return base.join(F.broadcast(scores), "column", "left").select("column", F.coalesce(name, F.lit(0.0)).alias(name))


def two_sample_cdf(pair: NumericPair, chunks: int | None = None) -> DataFrame:
    """Per column and distinct value both empirical CDFs and the gap to the next value."""
    counts = _both_counts(pair.real, pair.synthetic, pair.columns, F.col("value"))
    chunks = chunks or chunks_for(pair.rows)
    cuts = None
    if chunks > 1:
        both = pair.real.unionByName(pair.synthetic)
        cuts = sampled_cuts(both, pair.columns, pair.rows, chunks)
    cum = running_totals(counts, ["n_real", "n_synthetic"], pair.rows, chunks=chunks, cuts=cuts)
    return cum.select(
        "column", "value", "n_real", "n_synthetic",
        (F.col("cum_n_real") / F.when(F.col("total_n_real") > 0, F.col("total_n_real"))).alias("cdf_real"),
        (F.col("cum_n_synthetic") / F.when(F.col("total_n_synthetic") > 0, F.col("total_n_synthetic"))).alias("cdf_synthetic"),
        (F.col("next_value") - F.col("value")).alias("width"),
    )


def wasserstein_by_column(pair: NumericPair, cdf: DataFrame | None = None) -> DataFrame:
    """(column, distance): 1-Wasserstein divided by the real range."""
    cdf = two_sample_cdf(pair) if cdf is None else cdf
    real, syn = F.col("n_real") > 0, F.col("n_synthetic") > 0
    agg = cdf.groupBy("column").agg(
        F.sum(F.abs(F.col("cdf_real") - F.col("cdf_synthetic")) * F.coalesce("width", F.lit(0.0))).alias("w"),
        F.min(F.when(real, F.col("value"))).alias("rmin"),
        F.max(F.when(real, F.col("value"))).alias("rmax"),
        F.min(F.when(syn, F.col("value"))).alias("smin"),
        F.max(F.when(syn, F.col("value"))).alias("smax"),
    )
    span = F.col("rmax") - F.col("rmin")
    flat = F.greatest(F.abs("rmin"), F.abs("smax"), F.abs("smin"), F.lit(1.0))
    return agg.select("column", (F.col("w") / F.when(span <= 1e-12, flat).otherwise(span)).alias("distance"))


def wasserstein(pair: NumericPair) -> tuple[dict[str, float], float]:
    """Scaled distance per common numeric column, and their unweighted mean (0 without columns)."""
    by = {r["column"]: r["distance"] for r in wasserstein_by_column(pair).collect()} if pair.columns else {}
    return by, sum(by.values()) / len(by) if by else 0.0


# -- correlation ------------------------------------------------------------


def _centred(df: DataFrame, columns: list[str]) -> tuple[DataFrame, int]:
    """Columns x0, x1, ... about their means (a first scan), and the row count.

    A constant column is taken about its value, so that rounding gives it no variance.
    """
    centre = lambda c: F.when(F.min(col(c)) < F.max(col(c)), F.avg(col(c))).otherwise(F.min(col(c)))
    found = df.agg(F.count(F.lit(1)).alias("n"), *[centre(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return df.select(*[(col(c) - F.lit(found[f"m{i}"] or 0.0)).alias(f"x{i}") for i, c in enumerate(columns)]), found["n"]


CELLS = ("n", "sx", "sxx", "sxy")


def _grams(centred: DataFrame, d: int) -> dict[str, np.ndarray]:
    """d x d matrices over the rows where both columns are present: n, sums of the first, of its square, of the product.

    Each task multiplies its batches and gives d x d partial sums, so no row is spread over the pairs.
    """
    ship(centred.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros((d, d)) for k in CELLS}
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1)
            there = ~np.isnan(x)
            x[~there] = 0.0
            there = there.astype(float)
            total["n"] += there.T @ there
            total["sx"] += x.T @ there
            total["sxx"] += (x * x).T @ there
            total["sxy"] += x.T @ x
        at = np.arange(d * d, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(total[k].ravel()) for k in CELLS]], ["k", *CELLS])

    parts = centred.mapInArrow(run, "k int, n double, sx double, sxx double, sxy double")
    sums = parts.groupBy("k").agg(*[F.sum(c).alias(c) for c in CELLS]).collect()  # one row per cell
    out = {k: np.zeros(d * d) for k in CELLS}
    for r in sums:
        for k in CELLS:
            out[k][r["k"]] = r[k]
    return {k: v.reshape(d, d) for k, v in out.items()}


def pair_sums(df: DataFrame, pairs: list[tuple[str, str]]) -> list[tuple]:
    """(n, sx, sy, sxx, syy, sxy) of each pair over the rows where both are present."""
    columns = sorted({c for p in pairs for c in p})
    g = _grams(_centred(df, columns)[0], len(columns))
    at = [(columns.index(a), columns.index(b)) for a, b in pairs]
    cells = [(g["n"][i, j], g["sx"][i, j], g["sx"][j, i], g["sxx"][i, j], g["sxx"][j, i], g["sxy"][i, j]) for i, j in at]
    return [tuple(map(float, c)) for c in cells]


def covariances(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Population covariance matrix of columns without nulls, from products about the means."""
    if not columns:
        return np.zeros((0, 0))
    centred, n = _centred(df, columns)
    return _grams(centred, len(columns))["sxy"] / max(n, 1)


def correlations(cov: np.ndarray) -> np.ndarray:
    """Pearson matrix; an undefined entry is 0, the diagonal of a constant column included."""
    s = np.sqrt(np.diag(cov))
    scale = np.outer(s, s)
    return np.clip(np.divide(cov, scale, out=np.zeros_like(cov), where=scale > 0), -1.0, 1.0)


def correlation_matrix(pair: NumericPair) -> DataFrame:
    """(column_a, column_b, r_real, r_synthetic) over the full matrix of the filled tables."""
    a, b = map(correlations, pair.covariances())
    rows = [
        (x, y, float(a[i, j]), float(b[i, j])) for i, x in enumerate(pair.columns) for j, y in enumerate(pair.columns)
    ]
    return pair.real.sparkSession.createDataFrame(rows, "column_a string, column_b string, r_real double, r_synthetic double")


def correlation_difference(pair: NumericPair) -> dict[str, float]:
    """Largest difference over the full matrix; mean and population std over the upper triangle."""
    if len(pair.columns) < 2:
        return {"max_diff": 0.0, "mean_diff": 0.0, "std_diff": 0.0}
    a, b = map(correlations, pair.covariances())
    diff = np.abs(a - b)
    upper = diff[np.triu_indices(len(pair.columns), 1)]
    return {"max_diff": float(diff.max()), "mean_diff": float(upper.mean()), "std_diff": float(upper.std())}


def pca_variance_retained(pair: NumericPair) -> float:
    """Share of the synthetic variance kept by the real table's 95 % components.

    Both covariance matrices are Spark aggregates; only the d x d eigenproblem
    runs on the driver, and no row is projected.
    """
    if not pair.columns:
        return 0.0
    real, syn = pair.filled()
    rows = real.limit(len(pair.columns)).count()
    cov_real, cov_syn = pair.covariances()
    s = np.sqrt(np.diag(cov_real))
    s[s == 0] = 1.0
    cov_real, cov_syn = cov_real / np.outer(s, s), cov_syn / np.outer(s, s)
    total = float(np.trace(cov_syn))
    limit = min(rows, len(pair.columns))
    if limit < 1:
        return 0.0
    values, vectors = np.linalg.eigh(cov_real)
    values, vectors = np.clip(values[::-1], 0, None), vectors[:, ::-1]
    if total <= 1e-12:
        return 1.0
    share = np.cumsum(values) / values.sum() if values.sum() > 0 else np.ones(len(values))
    keep = max(1, min(int(np.searchsorted(share, VARIANCE_KEPT) + 1), limit))
    w = vectors[:, :keep]
    kept = float(np.trace(w.T @ cov_syn @ w)) / total
    return min(max(kept, 0.0), 1.0) if math.isfinite(kept) else 0.0


# -- sets of categories -----------------------------------------------------


def category_union(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    return frequency_pair(real, synthetic, columns).select("column", "value")


def category_difference(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """Categories on one side only: ``novel`` in the synthetic table, ``lost`` from the real one."""
    f = frequency_pair(real, synthetic, columns).where("n_real = 0 OR n_synthetic = 0")
    return f.select("column", "value", F.when(F.col("n_real") == 0, "novel").otherwise("lost").alias("status"))


def shared_labels(real: DataFrame, synthetic: DataFrame, target: str) -> DataFrame:
    """Labels on both sides, as text."""
    pick = lambda df: df.select(label(col(target), df.schema[target].dataType).alias("label")).where("label IS NOT NULL")
    return pick(real).intersect(pick(synthetic))
