"""Column profile: types, missing values, moments, quantiles, top values, classes."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semblance.functions.scalars import (
    SEVERE_BELOW, col, finite, imbalance_advice, label, normalized, number, ratio_text, sanitized,
)
from semblance.operators.order import exact_quantiles

# Fixed values.
NUMERIC_SHARE = 0.9
ID_SHARE = 0.95
ID_DISTINCT = 50
LOW_CARDINALITY = 5
TOP_VALUES = 5
EXAMPLES = 3


@dataclass(frozen=True)
class TableSchema:
    """Which columns are numeric, categorical or skipped, and the label column."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    skipped: tuple[str, ...] = ()
    target: str | None = None

    @staticmethod
    def from_profile(rows) -> "TableSchema":
        pick = lambda role, kind=None: tuple(
            r["column"] for r in rows if r["role"] == role and (kind is None or r["type"] == kind)
        )
        target = pick("target")
        return TableSchema(
            pick("feature", "numeric"), pick("feature", "categorical"), pick("skipped"), target[0] if target else None
        )

    @property
    def discrete(self) -> tuple[str, ...]:
        """Categorical features and the label column, which is always categorical."""
        extra = (self.target,) if self.target and self.target not in self.categorical else ()
        return self.categorical + extra

    @property
    def used(self) -> tuple[str, ...]:
        return self.numeric + self.discrete


MOMENTS = ("min", "max", "mean", "std", "skewness", "kurtosis")
STATS_SCHEMA = (
    "column string, rows bigint, missing_count bigint, missing_pct double, non_null bigint, numeric_ratio double, "
    + ", ".join(f"{m} double" for m in MOMENTS)
)


def moments_from_sums(n: int, s2: float, s3: float, s4: float, constant: bool) -> dict[str, float | None]:
    """Sample std, bias-corrected skewness and excess kurtosis from sums about the mean."""
    out = {"std": math.sqrt(s2 / (n - 1)) if n > 1 else None, "skewness": None, "kurtosis": None}
    if constant or s2 == 0:
        return {"std": 0.0 if n > 1 else None, "skewness": 0.0 if n > 2 else None, "kurtosis": 0.0 if n > 3 else None}
    if n > 2:
        out["skewness"] = math.sqrt(n * (n - 1)) / (n - 2) * (s3 / n) / (s2 / n) ** 1.5
    if n > 3:
        out["kurtosis"] = (n - 1) / ((n - 2) * (n - 3)) * (n * (n + 1) * s4 / s2**2 - 3 * (n - 1))
    return out


def column_stats(df: DataFrame, columns: list[str] | None = None, shape: bool = True) -> DataFrame:
    """One row per column: counts, range, mean and (with ``shape``) spread, skewness and kurtosis.

    Two scans of plain sums: the second takes powers about the mean.  The
    built-in central moments would need one scan, but dozens of them in one
    aggregate outgrow what the JVM compiles, and run many times slower.
    """
    columns = columns or df.columns
    types = {f.name: f.dataType for f in df.schema}
    present = [col(c).isNotNull().alias(f"v{i}") for i, c in enumerate(columns)]
    xs = [number(col(c), types[c]).alias(f"x{i}") for i, c in enumerate(columns)]
    x = [F.col(f"x{i}") for i in range(len(columns))]
    first = df.select(*present, *xs).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(F.when(F.col(f"v{i}"), 1)).alias(f"p{i}") for i in range(len(x))],
        *[f(x[i]).alias(f"{name}{i}") for i in range(len(x)) for name, f in (("c", F.count), ("min", F.min), ("max", F.max), ("mean", F.avg))],
    ).first()
    spread = [i for i in range(len(x)) if shape and first[f"c{i}"] and first[f"min{i}"] < first[f"max{i}"]]
    sums = {}
    if spread:
        d = {i: x[i] - F.lit(first[f"mean{i}"]) for i in spread}
        sums = df.select(*[xs[i] for i in spread]).select(*[d[i].alias(f"d{i}") for i in spread]).agg(
            *[F.sum(F.col(f"d{i}") * F.col(f"d{i}")).alias(f"s2_{i}") for i in spread],
            *[F.sum(F.col(f"d{i}") * F.col(f"d{i}") * F.col(f"d{i}")).alias(f"s3_{i}") for i in spread],
            *[F.sum(F.col(f"d{i}") * F.col(f"d{i}") * F.col(f"d{i}") * F.col(f"d{i}")).alias(f"s4_{i}") for i in spread],
        ).first()
    rows = []
    for i, c in enumerate(columns):
        n, p, k = first["n"], first[f"p{i}"], first[f"c{i}"]
        if i in spread:
            m = moments_from_sums(k, sums[f"s2_{i}"], sums[f"s3_{i}"], sums[f"s4_{i}"], False)
        else:
            m = moments_from_sums(k, 0.0, 0.0, 0.0, True) if shape else dict.fromkeys(MOMENTS[3:])
        rows.append((
            c, n, n - p, (n - p) / n * 100 if n else 0.0, p, k / p if p else 0.0,
            *[first[f"{name}{i}"] for name in ("min", "max", "mean")], *[m[name] for name in MOMENTS[3:]],
        ))
    return df.sparkSession.createDataFrame(rows, STATS_SCHEMA)


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value text, count) of all columns.

    Columns of one type are unpivoted and grouped together by their raw values;
    only the distinct values are turned into text.
    """
    columns = columns or df.columns
    types = {f.name: f.dataType for f in df.schema}
    families: dict[str, list[str]] = {}
    for c in columns:
        families.setdefault(_family(types[c]), []).append(c)
    out = None
    for family, members in families.items():
        key = (lambda c: finite(col(c).cast("double"))) if family == "double" else (
            (lambda c: label(col(c), types[c])) if family == "text" else (lambda c: col(c).cast(family))
        )
        counts = (
            df.select(*[key(c).alias(c) for c in members])
            .unpivot([], [col(c) for c in members], "column", "value")
            .where(F.col("value").isNotNull())
            .groupBy("column", "value")
            .agg(F.count(F.lit(1)).alias("count"))
        )
        counts = counts.select("column", label(F.col("value"), counts.schema["value"].dataType).alias("value"), "count")
        out = counts if out is None else out.unionByName(counts)
    return out


def _family(dtype: T.DataType) -> str:
    if isinstance(dtype, T.IntegralType):
        return "bigint"
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return "double"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return dtype.simpleString()
    return "text"


def distinct_stats(counts: DataFrame) -> DataFrame:
    """Distinct count, unique ratio and constant flag per column."""
    return counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("unique_values"),
        F.sum("count").alias("non_null"),
        (F.count(F.lit(1)) / F.sum("count")).alias("unique_ratio"),
        (F.count(F.lit(1)) <= 1).alias("is_constant"),
    )


def top_values(counts: DataFrame, k: int = TOP_VALUES) -> DataFrame:
    """The k most frequent values per column; ties go to the smaller value.

    The rank filter becomes a per-partition limit before the shuffle, so a
    column with many values never meets in one task.
    """
    totals = counts.groupBy("column").agg(F.sum("count").alias("non_null"))
    w = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    ranked = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.join(totals, "column").select(
        "column", "rank", "value", "count", (F.col("count") / F.col("non_null") * 100).alias("pct")
    )


def example_values(counts: DataFrame, k: int = EXAMPLES) -> DataFrame:
    """The k smallest distinct values per column (a table has no first row)."""
    w = Window.partitionBy("column").orderBy("value")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("column", "rank", "value")


def quantile_stats(df: DataFrame, columns: list[str], **kw) -> DataFrame:
    """Exact q1, median, q3 and the interquartile range per column."""
    types = {f.name: f.dataType for f in df.schema}
    found = exact_quantiles(df, {c: number(col(c), types[c]) for c in columns}, [0.25, 0.5, 0.75], **kw)
    rows = [(c, q[0.25], q[0.5], q[0.75], None if q[0.5] is None else q[0.75] - q[0.25]) for c, q in found.items()]
    return df.sparkSession.createDataFrame(rows, "column string, q1 double, median double, q3 double, iqr double")


PROFILE_SCHEMA = (
    "column string, position int, role string, type string, missing_count bigint, missing_pct double, unique_values bigint, "
    "is_constant boolean, min double, max double, mean double, std double, median double, q1 double, q3 double, iqr double, "
    "skewness double, kurtosis double, cardinality bigint"
)


def profile(df: DataFrame, target: str | None = None, **kw) -> DataFrame:
    """One row per column: its role, logical type and statistics.

    Roles: ``feature``, ``target``, ``skipped`` (all null, or nearly unique with
    more than 50 distinct values).  The counts decide the types; quantiles are
    then read for the numeric columns only, top values for the categorical ones.
    """
    df = sanitized(normalized(df))
    stats = {r["column"]: r for r in column_stats(df).collect()}  # one row per column
    distinct = {r["column"]: r for r in distinct_stats(value_counts(df)).collect()}  # one row per column
    kinds: dict[str, tuple[str, str | None]] = {}
    for c in df.columns:
        d = distinct.get(c)
        if d is None or (c != target and d["unique_ratio"] >= ID_SHARE and d["unique_values"] > ID_DISTINCT):
            kinds[c] = ("skipped", None)
        elif c == target:
            kinds[c] = ("target", "categorical")
        else:
            numeric = stats[c]["numeric_ratio"] >= NUMERIC_SHARE and d["unique_values"] > LOW_CARDINALITY
            kinds[c] = ("feature", "numeric" if numeric else "categorical")
    numeric = [c for c, k in kinds.items() if k[1] == "numeric"]
    categorical = [c for c, k in kinds.items() if k[1] == "categorical"]
    quantiles = {r["column"]: r for r in quantile_stats(df, numeric, **kw).collect()} if numeric else {}
    rows = []
    for i, c in enumerate(df.columns):
        role, kind = kinds[c]
        s, d, q = stats[c], distinct.get(c), quantiles.get(c)
        of = lambda source, *names: [source[n] if source is not None else None for n in names]
        rows.append((
            c, i, role, kind, *of(s if kind else None, "missing_count", "missing_pct"),
            *of(d if kind else None, "unique_values", "is_constant"), *of(s if q else None, "min", "max", "mean", "std"),
            *of(q, "median", "q1", "q3", "iqr"), *of(s if q else None, "skewness", "kurtosis"),
            d["unique_values"] if kind == "categorical" else None,
        ))
    base = df.sparkSession.createDataFrame(rows, PROFILE_SCHEMA)
    if not categorical:
        empty = "array<struct<value:string,count:bigint,pct:double>>"
        return base.withColumns({
            "top_value_stats": F.lit(None).cast(empty), "example_values": F.lit(None).cast("array<string>"),
            "most_common_freq": F.lit(None).cast("bigint"),
        })
    counts = value_counts(df, categorical)
    top = top_values(counts).groupBy("column").agg(  # at most five rows per column
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "value", "count", "pct"))),
            lambda s: F.struct(s["value"].alias("value"), s["count"].alias("count"), s["pct"].alias("pct")),
        ).alias("top_value_stats"),
        F.max("count").alias("most_common_freq"),
    )
    examples = example_values(counts).groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("example_values"))
    # each side has one row per column
    return base.join(F.broadcast(top.join(examples, "column")), "column", "left").select(
        *base.columns, "top_value_stats", "example_values", "most_common_freq"
    )


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """(label text, count), nulls excluded."""
    text = label(col(target), df.schema[target].dataType)
    return (
        df.select(text.alias("label")).where(F.col("label").isNotNull()).groupBy("label").agg(F.count(F.lit(1)).alias("count"))
    )


def class_imbalance(df: DataFrame, target: str) -> DataFrame:
    """Minority and majority class with ratio, severity and advice (one row)."""
    by = class_distribution(df, target).agg(
        F.min_by("label", F.struct("count", "label")).alias("minority_class"),
        F.min("count").alias("minority_count"),
        F.min_by("label", F.struct(-F.col("count"), F.col("label"))).alias("majority_class"),
        F.max("count").alias("majority_count"),
        F.sum("count").alias("total"),
    ).where(F.col("total").isNotNull())
    pct = lambda name: F.col(name) / F.col("total") * 100
    return by.select(
        "minority_class", "minority_count", pct("minority_count").alias("minority_pct"),
        "majority_class", "majority_count", pct("majority_count").alias("majority_pct"),
        ratio_text(F.col("majority_count"), F.col("minority_count")).alias("class_ratio"),
        (pct("minority_count") < SEVERE_BELOW).alias("is_severe"),
        imbalance_advice(pct("minority_count")).alias("recommendation"),
    )


def report_columns(profiled: DataFrame) -> DataFrame:
    """Logical type to report type (numerical / categorical), the target included."""
    kind = F.when(F.col("type") == "numeric", "numerical").otherwise("categorical")
    return profiled.where(F.col("role") != "skipped").select("column", kind.alias("sdtype"), (F.col("role") == "target").alias("is_target"))
