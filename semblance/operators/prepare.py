"""Training preparation: imputation, scaling, dictionaries, one-hot, splits, sampling."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semblance.functions.scalars import clipped, col, label, normalized, number, present_or_missing
from semblance.operators.order import hash_numbered, medians, running_totals
from semblance.operators.profile import TableSchema, value_counts

# Fixed values.
SCALE_EPSILON = 1e-8


# -- numbers ----------------------------------------------------------------


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numbers with nulls replaced by the column's exact median (0 if it has none)."""
    xs = {c: number(col(c), df.schema[c].dataType) for c in columns}
    fill = medians(df, xs)
    return df.select(*[(F.coalesce(xs[c], F.lit(fill[c])) if c in xs else col(c)).alias(c) for c in df.columns])


@dataclass
class Encoder:
    """Fitted ranges of the numeric columns and dictionaries of the categorical ones."""

    ranges: dict[str, tuple[float, float]]
    dictionary: DataFrame  # column, value, idx

    def ranges_frame(self) -> DataFrame:
        rows = [(c, lo, hi) for c, (lo, hi) in self.ranges.items()]
        return self.dictionary.sparkSession.createDataFrame(rows, "column string, min double, max double")


def dictionary(df: DataFrame, columns: list[str], chunks: int | None = None) -> DataFrame:
    """(column, value, idx): distinct values numbered from 0 in value order."""
    counts = value_counts(df, columns).select("column", "value", F.lit(1).cast("bigint").alias("one"))
    rows = df.count() * max(1, len(columns))
    return running_totals(counts, ["one"], rows, chunks=chunks).select(
        "column", "value", (F.col("cum_one") - 1).alias("idx")
    )


def fit_encoder(df: DataFrame, numeric: list[str], categorical: list[str]) -> Encoder:
    ranges = {}
    if numeric:
        xs = [number(col(c), df.schema[c].dataType) for c in numeric]
        row = df.agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate(xs) for n, f in (("lo", F.min), ("hi", F.max))]).first()
        ranges = {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(numeric)}
    if categorical:
        words = dictionary(df, categorical)
    else:
        words = df.sparkSession.createDataFrame([], "column string, value string, idx bigint")
    return Encoder(ranges, words)


def _with_lookup(df: DataFrame, words: DataFrame, c: str, frm: str, to: str, key: Column) -> DataFrame:
    """Replace column ``c`` through the dictionary; unseen becomes null.

    No broadcast hint: the dictionary may be large, so the optimizer sizes it.
    """
    d = words.where(F.col("column") == c).select(F.col(frm).alias("__from"), F.col(to).alias("__to"))
    joined = df.withColumn("__key", key).join(d, F.col("__key") == F.col("__from"), "left")
    return joined.select(*[F.col("__to").alias(c) if n == c else col(n) for n in df.columns])


def encode(df: DataFrame, enc: Encoder, categorical: list[str]) -> DataFrame:
    """Numbers to [0, 1], categories to their index."""

    def scaled(c: str) -> Column:
        lo, hi = enc.ranges[c]
        if lo is None:
            return F.lit(None).cast("double")
        x = number(col(c), df.schema[c].dataType)
        return clipped((x - F.lit(lo)) / F.lit(hi - lo + SCALE_EPSILON), 0.0, 1.0)

    types = {f.name: f.dataType for f in df.schema}
    out = df.select(*[(scaled(c) if c in enc.ranges else col(c)).alias(c) for c in df.columns])
    for c in categorical:
        out = _with_lookup(out, enc.dictionary, c, "value", "idx", label(col(c), types[c]))
    return out


def decode(df: DataFrame, enc: Encoder, categorical: list[str]) -> DataFrame:
    """Back to the original range and category text (the scale's epsilon is not undone)."""

    def unscaled(c: str) -> Column:
        lo, hi = enc.ranges[c]
        return F.lit(None).cast("double") if lo is None else col(c) * F.lit(hi - lo) + F.lit(lo)

    out = df.select(*[(unscaled(c) if c in enc.ranges else col(c)).alias(c) for c in df.columns])
    for c in categorical:
        out = _with_lookup(out, enc.dictionary, c, "idx", "value", col(c))
    return out


# -- training frame ---------------------------------------------------------


def training_frame(df: DataFrame, schema: TableSchema) -> DataFrame:
    """Labelled rows with filled numbers and category tokens; skipped columns are left out.

    Raises when a numeric column holds text that is no number, or no row is labelled.
    """
    df = normalized(df)
    types = {f.name: f.dataType for f in df.schema}
    if schema.target:
        df = df.where(col(schema.target).isNotNull())
    numeric = [c for c in schema.numeric if c in df.columns]
    xs = {c: number(col(c), types[c]) for c in numeric}
    found = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(col(c)).alias(f"p{i}") for i, c in enumerate(numeric)],
        *[F.count(xs[c]).alias(f"x{i}") for i, c in enumerate(numeric)],
    ).first()
    if schema.target and found["n"] == 0:
        raise ValueError(f"Target column '{schema.target}' has no usable non-missing rows for training.")
    for i, c in enumerate(numeric):
        if isinstance(types[c], T.StringType) and found[f"x{i}"] < found[f"p{i}"]:
            raise ValueError(f"Column '{c}' is marked numeric but contains non-numeric values.")
    fill = medians(df, {c: xs[c] for i, c in enumerate(numeric) if found[f"x{i}"] < found["n"]})
    keep = [c for c in df.columns if c in schema.used]
    return df.select(
        *[
            ((F.coalesce(xs[c], F.lit(fill[c])) if c in fill else xs[c]) if c in xs else present_or_missing(label(col(c), types[c]))).alias(c)
            for c in keep
        ]
    )


# -- indicators -------------------------------------------------------------


def one_hot(df: DataFrame, columns: list[str]) -> DataFrame:
    """The set indicators in long form: the other columns, ``column`` and ``token``, one row per row and column.

    The missing token is a category like any other.  The schema does not depend on the data, and a column may have any
    number of categories; a pivot over ``token`` gives 0/1 columns where there are few.
    """
    set_ones = [F.struct(F.lit(c).alias("column"), present_or_missing(label(col(c), df.schema[c].dataType)).alias("token")) for c in columns]
    kept = [col(c) for c in df.columns if c not in columns]
    return df.select(*kept, F.explode(F.array(*set_ones)).alias("__one")).select(*map(col, [c for c in df.columns if c not in columns]), "__one.column", "__one.token")


# -- splits and weights -----------------------------------------------------


FEW_CLASSES = 10_000  # classes up to which the ends of their shares go to all tasks


def stratified_split(
    df: DataFrame, target: str, row_key: str, test_share: float = 0.3, seed: int = 42, chunk_bits: int = 16
) -> DataFrame:
    """Adds ``is_test``: in each class the rounded share of rows with the smallest seeded hash.

    Hash chunks are counted first.  Only the rows of the chunk in which the share of a class ends are ranked, all others
    lie on one side of it, so rows are neither sorted nor moved.
    """
    cut = df.withColumn("__draw", F.xxhash64(col(row_key), F.lit(seed))).withColumn("__chunk", F.shiftright("__draw", 64 - chunk_bits))
    counts = cut.groupBy(col(target).alias("__class"), F.col("__chunk").alias("__edge")).agg(F.count(F.lit(1)).alias("__n"))
    all_of = Window.partitionBy("__class")
    upto = F.sum("__n").over(all_of.orderBy("__edge").rowsBetween(Window.unboundedPreceding, 0))
    ends = counts.select("__class", "__edge", F.floor(F.sum("__n").over(all_of) * test_share + 0.5).alias("__left"), upto.alias("__upto"), "__n")
    # The chunk that holds the last row of the share, and how many of its rows belong to it.
    ends = ends.where((F.col("__upto") >= F.col("__left")) & (F.col("__upto") - F.col("__n") < F.col("__left")))
    ends = ends.select("__class", "__edge", (F.col("__left") - F.col("__upto") + F.col("__n")).alias("__left"))
    # A row for each class; very many classes are joined by shuffle.
    few = ends.limit(FEW_CLASSES + 1).collect()
    if len(few) <= FEW_CLASSES:
        ends = F.broadcast(df.sparkSession.createDataFrame(few, ends.schema))
    sides = cut.join(ends, col(target).eqNullSafe(F.col("__class")), "left")
    edge = F.coalesce(F.col("__chunk") == F.col("__edge"), F.lit(False))
    ranked = sides.where(edge).withColumn("is_test", F.row_number().over(Window.partitionBy("__class").orderBy("__draw", col(row_key))) <= F.col("__left"))
    others = sides.where(~edge).withColumn("is_test", F.coalesce(F.col("__chunk") < F.col("__edge"), F.lit(False)))
    return others.unionByName(ranked).select(*map(col, df.columns), "is_test")


def class_weight(df: DataFrame, target: str, positive) -> DataFrame:
    """Negatives over positives (at least one), one row."""
    pos = F.count(F.when(col(target) == F.lit(positive), 1))
    neg = F.count(F.when(col(target) != F.lit(positive), 1))
    return df.agg((neg / F.greatest(pos, F.lit(1))).alias("class_weight"))


# -- mode-specific encoding -------------------------------------------------


MODES = 10  # modes a column has at most
MODE_WEIGHT = 0.005  # modes of less are dropped
SPREAD = 0.001  # concentration of the stick-breaking prior: small, so that modes the data do not need lose their weight
PULL = 0.001  # rows that the overall mean weighs in a mode's mean
MODE_CELLS = 1_024  # cells of about equal counts that a column's values are summed in


def _digamma(x: np.ndarray) -> np.ndarray:
    """The logarithmic derivative of the gamma function for positive numbers."""
    x, out = np.array(x, float), np.zeros(np.shape(x))
    for _ in range(8):
        small = x < 8
        out -= np.where(small, 1 / x, 0)
        x = np.where(small, x + 1, x)
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def _bound(a, b, beta, freedom, scale, centre, prior_mean, prior_var, concentration) -> float:
    """What the posterior of the sticks, means and precisions costs against their priors."""
    gamma = np.vectorize(math.lgamma)
    prior = math.lgamma(concentration) - math.lgamma(1 + concentration)
    sticks = prior - (gamma(a) + gamma(b) - gamma(a + b))
    sticks += (a - 1) * _digamma(a) + (b - concentration) * _digamma(b) + (1 + concentration - a - b) * _digamma(a + b)
    means = 0.5 * (np.log(beta / PULL) + PULL / beta - 1 + PULL * freedom / scale * np.square(centre - prior_mean))
    shape, rate = freedom / 2, scale / 2
    precisions = (shape - 0.5) * _digamma(shape) - gamma(shape) + math.lgamma(0.5) + 0.5 * np.log(rate / (prior_var / 2)) + shape * (prior_var / 2 - rate) / rate
    return float((sticks + means + precisions).sum())


def mixture(n: np.ndarray, s: np.ndarray, q: np.ndarray, modes: int = MODES, steps: int = 300, concentration: float = SPREAD) -> list[tuple[float, float, float]]:
    """(weight, mean, std) of a truncated Dirichlet-process mixture of Gaussians, by variational expectation-maximisation.

    ``n``, ``s`` and ``q`` are the counts, sums and sums of squares of cells of neighbouring values, in order; a cell is
    given to the modes as a whole.  The prior deviation is a ``modes``-th of the data's, with the weight of one row.  It
    begins with one, two, ... ``modes`` stretches of equal counts, goes on with the three of the best lower bound of the
    evidence, and keeps the best end; then modes are left out, the smallest first, as long as that raises the bound.
    """
    total, x = n.sum(), s / n
    prior_mean = s.sum() / total
    prior_var = max(q.sum() / total - prior_mean**2, 1e-300) / modes**2
    inside = np.maximum(q / n - x * x, 0)

    def step(r: np.ndarray) -> tuple[np.ndarray, tuple]:
        # The stick is broken in the order of the modes' sizes.
        r = r[:, np.argsort(-(n @ r), kind="stable")]
        count = n @ r
        mean = np.divide(s @ r, count, out=np.full(modes, prior_mean), where=count > 1e-12)
        within = np.maximum(q @ r - 2 * mean * (s @ r) + mean * mean * count, 0)
        beta, freedom = PULL + count, 1 + count
        centre = (PULL * prior_mean + count * mean) / beta
        scale = prior_var + within + PULL * count / beta * np.square(mean - prior_mean)
        a, b = 1 + count, concentration + np.concatenate([np.cumsum(count[::-1])[::-1][1:], [0]])
        of_a, of_b, of_both, of_half = np.split(_digamma(np.concatenate([a, b, a + b, freedom / 2])), 4)
        weight = of_a - of_both + np.concatenate([[0], np.cumsum(of_b - of_both)[:-1]])
        log = weight + 0.5 * (of_half + np.log(2) - np.log(scale) - 1 / beta)
        log = log - 0.5 * freedom / scale * (np.square(x[:, None] - centre) + inside[:, None])
        top = log.max(axis=1, keepdims=True)
        r = np.exp(log - top)
        fit = r.sum(axis=1, keepdims=True)
        return r / fit, (a, b, beta, freedom, scale, centre, float(n @ (np.log(fit) + top)[:, 0]))

    def bound(end: tuple) -> float:
        return end[-1] - _bound(*end[:-1], prior_mean, prior_var, concentration)

    begun = []
    for k in range(1, modes + 1):
        r = np.zeros((len(n), modes))
        r[np.arange(len(n)), np.minimum((np.cumsum(n) - n / 2) * k / total, k - 1).astype(int)] = 1.0
        for _ in range(40):
            r, end = step(r)
        begun.append((bound(end), -k, r))
    def ended(r: np.ndarray) -> tuple:
        now = -np.inf
        for i in range(steps):
            r, end = step(r)
            if i % 20 == 0:
                before, now = now, bound(end)
                if now - before < 1e-7 * total:
                    break
        return now, r, end

    best = max((ended(r) for _, _, r in sorted(begun, key=lambda e: e[:2], reverse=True)[:3]), key=lambda e: e[0])
    tried = True
    while tried:
        tried = False
        size = n @ best[1]
        for k in np.argsort(size):
            # Only a mode that others could take over.
            if 0.5 < size[k] < 0.05 * total:
                rest = np.delete(best[1], k, axis=1)
                rest = np.insert(rest / np.maximum(rest.sum(axis=1, keepdims=True), 1e-300), modes - 1, 0.0, axis=1)
                other = ended(rest)
                if other[0] > best[0] + 1e-6 * total:
                    best, tried = other, True
                    break
    a, b, _, freedom, scale, centre, _ = best[2]
    share = a / (a + b) * np.concatenate([[1], np.cumprod(b / (a + b))[:-1]])
    return sorted([(float(w), float(m), float(v)) for w, m, v in zip(share, centre, np.sqrt(scale / freedom))], key=lambda m: m[1])


def mode_cells(df: DataFrame, column: str, cells: int = MODE_CELLS) -> tuple[list[tuple[int, float, float]], float, float]:
    """(count, sum, sum of squares) of about equal cells of the column's order; then the column's mean and deviation.

    A value that fills a cell has one of its own.  Sums are of the distances from the mean in deviations, so squares keep their digits.
    """
    x = df.select(number(col(column), df.schema[column].dataType).alias("x")).where("x IS NOT NULL")
    stats = x.agg(F.avg("x"), F.stddev_pop("x"), F.percentile_approx("x", [i / cells for i in range(1, cells)], 4 * cells)).first()
    mean, std = stats[0] or 0.0, stats[1] or 0.0
    if std == 0:
        return [], mean, std
    cuts = sorted(set(stats[2]))
    cut = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="x", outputCol="cell").transform(x)
    z = (F.col("x") - mean) / std
    # Cells also end at equal steps of the value, so none holds both sides of a gap.
    step = F.floor(F.greatest(F.least(z, F.lit(16.0)), F.lit(-16.0)) * 32).alias("step")
    found = cut.groupBy("cell", step).agg(F.count(F.lit(1)).alias("n"), F.sum(z).alias("s"), F.sum(z * z).alias("q")).orderBy("cell", "step").collect()
    return [(r["n"], r["s"], r["q"]) for r in found], mean, std


def fit_modes(df: DataFrame, column: str, modes: int = MODES, least: float = MODE_WEIGHT) -> list[tuple[float, float, float]]:
    """(weight, mean, std) of the column's modes, as many as it needs and at most ``modes``, by mean; weights add up to one."""
    cells, mean, std = mode_cells(df, column)
    if std == 0:
        return [(1.0, mean, 1.0)]
    n, s, q = (np.array(v, float) for v in zip(*cells))
    found = [m for m in mixture(n, s, q, modes) if m[0] >= least]
    total = sum(w for w, _, _ in found)
    return [(w / total, m * std + mean, v * std) for w, m, v in found]


def mode_normalized(df: DataFrame, column: str, modes: list[tuple[float, float, float]], row_key: Column | None = None, seed: int = 42) -> DataFrame:
    """Adds a mode ``<column>_mode`` (from 1) and the offset ``<column>_offset`` from its mean in four of its stds.

    With ``row_key`` the mode is drawn by its responsibility for the value, by the key's hash; else it is the most likely one.
    """
    x = number(col(column), df.schema[column].dataType)
    names = [f"__mode{k}" for k in range(len(modes))]
    # Step by step, so that no score is worked out more than once.
    out = df.withColumns({
        n: F.lit(float(np.log(max(w, 1e-300)) - np.log(s))) - (x - F.lit(m)) * (x - F.lit(m)) / F.lit(2 * s * s) for n, (w, m, s) in zip(names, modes)
    })
    out = out.withColumn("__top", F.greatest(*names) if len(names) > 1 else F.col(names[0]))
    if row_key is None:
        mode = F.array_position(F.array(*names), F.col("__top")).cast("int")
    else:
        # The first mode at which the shares so far reach the draw.
        so_far = {}
        for n in names:
            so_far[n] = sum((F.exp(F.col(k) - F.col("__top")) for k in so_far), F.exp(F.col(n) - F.col("__top")))
        out = out.withColumns(so_far).withColumn("__at", hash_uniform(seed, row_key, F.lit(column), F.lit("mode")) * F.col(names[-1]))
        mode = sum(((F.col(n) <= F.col("__at")).cast("int") for n in names[:-1]), F.lit(1))
    pick = lambda k: F.element_at(F.array(*[F.lit(m[k]) for m in modes]), F.col(f"{column}_mode"))
    out = out.withColumn(f"{column}_mode", F.when(x.isNotNull(), mode)).withColumn(
        f"{column}_offset", clipped((x - pick(1)) / (4 * pick(2)), -1.0, 1.0)
    )
    return out.drop(*names, "__top", "__at")


# -- condition sampling -----------------------------------------------------


def condition_weights(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, count, weight): log-frequency shares per column."""
    counts = value_counts(df, columns)
    logs = counts.withColumn("log_count", F.log(F.col("count") + F.lit(1)))
    totals = logs.groupBy("column").agg(F.sum("log_count").alias("total"))
    return logs.join(F.broadcast(totals), "column").select(
        "column", "value", "count", (F.col("log_count") / F.col("total")).alias("weight")
    )


def hash_uniform(seed: int, *parts: Column) -> Column:
    """A reproducible number in [0, 1) from a row's own values."""
    return F.shiftrightunsigned(F.xxhash64(*parts, F.lit(seed)), 11) * F.lit(2.0**-53)


def conditional_sample(
    df: DataFrame, columns: list[str], row_key: str, draws: int, seed: int = 42
) -> DataFrame:
    """(draw, column, value, row key): pick a column, a category by log-frequency, then a row having it.

    Category weights are integers, so their running totals are exact.  Each
    category's span is cut into equal slots, and draws meet categories by an
    equi join on the slot; rows are met by their index within the category.
    """
    spark = df.sparkSession
    counts = value_counts(df, columns).withColumn(
        "w", F.floor(F.log(F.col("count") + F.lit(1)) * F.lit(2.0**24))
    )
    cum = running_totals(counts, ["w"], df.count() * len(columns))
    totals = {r["column"]: (r["total"], r["n"]) for r in cum.groupBy("column").agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("n")).collect()}
    names = [c for c in columns if c in totals]
    if not names:
        raise ValueError("No column has a category to draw from.")
    total_of = F.element_at(F.array(*[F.lit(totals[c][0]) for c in names]), F.col("ci"))
    slot_of = F.element_at(F.array(*[F.lit(-(-totals[c][0] // totals[c][1])) for c in names]), F.col("ci"))
    order = F.array(*[F.lit(c) for c in names])
    spans = cum.withColumn("ci", F.array_position(order, F.col("column")).cast("int")).withColumn("slot_size", slot_of)
    spans = spans.select(
        "ci", "column", "value", "count", (F.col("cum_w") - F.col("w")).alias("lo"), F.col("cum_w").alias("hi"),
        F.explode(
            F.sequence(F.floor((F.col("cum_w") - F.col("w")) / F.col("slot_size")), F.floor((F.col("cum_w") - 1) / F.col("slot_size")))
        ).alias("slot"),
    )
    draw = spark.range(draws).withColumnRenamed("id", "draw")
    draw = draw.withColumn("ci", (F.floor(hash_uniform(seed, F.col("draw"), F.lit("column")) * len(names)) + 1).cast("int"))
    draw = draw.withColumn("at", F.floor(hash_uniform(seed, F.col("draw"), F.lit("value")) * total_of))
    draw = draw.withColumn("slot", F.floor(F.col("at") / slot_of))
    chosen = draw.join(spans, ["ci", "slot"]).where("at >= lo AND at < hi").select(
        "draw", "column", "value", (F.floor(hash_uniform(seed, F.col("draw"), F.lit("row")) * F.col("count")) + 1).alias("idx")
    )
    types = {f.name: f.dataType for f in df.schema}
    rows = df.select(col(row_key).alias("row_key"), *[label(col(c), types[c]).alias(c) for c in names])
    rows = rows.unpivot(["row_key"], [col(c) for c in names], "column", "value").where("value IS NOT NULL")
    rows = hash_numbered(rows, ["column", "value"], F.col("row_key"), seed)
    return chosen.join(rows, ["column", "value", "idx"]).select("draw", "column", "value", F.col("row_key").alias(row_key))
