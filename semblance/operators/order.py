"""Order statistics and running totals that never sort one group in one task.

The common trick: cut the order into chunks, total each chunk, carry the totals
of the earlier chunks, and sort only inside a chunk.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semblance.functions.scalars import col
from semblance.session import materialised

ROWS_PER_CHUNK = 64_000
MAX_CHUNKS = 32_768
SAMPLES_PER_CHUNK = 20
# Tables up to this size are counted whole; beyond it quantiles are bracketed first.
COUNTED_ROWS = 2_000_000


def chunks_for(rows: int) -> int:
    return max(1, min(MAX_CHUNKS, math.ceil(rows / ROWS_PER_CHUNK)))


# -- numbering --------------------------------------------------------------


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], chunk: Column, name: str = "idx",
    total: str | None = None,
) -> DataFrame:
    """``row_number`` per key (from 1), with the key's rows spread over chunks.

    ``chunk`` must not decrease along ``order``.  ``total`` adds the key's row count.
    """
    cut = df.withColumn("__chunk", chunk)
    earlier = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        cut.groupBy(*keys, "__chunk")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(
            *keys, "__chunk", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
            F.sum("__n").over(Window.partitionBy(*keys)).alias("__total"),
        )
    )
    inside = Window.partitionBy(*keys, "__chunk").orderBy(*order)
    local = cut.withColumn("__rn", F.row_number().over(inside))
    # Where there are no nulls, equality joins the rows as the window has dealt them.
    equal = lambda k, a, b: a.eqNullSafe(b) if cut.schema[k].nullable else a == b
    same = [equal(k, F.col(f"a.{k}"), F.col(f"b.{k}")) for k in [*keys, "__chunk"]]
    joined = local.alias("a").join(totals.alias("b"), same)
    return joined.select(
        *[F.col("a." + "`" + c + "`") for c in df.columns], (F.col("__rn") + F.col("__before")).alias(name),
        *([F.col("__total").alias(total)] if total else []),
    )


def hash_numbered(
    df: DataFrame, keys: Sequence[str], row_key: Column, seed: int = 42, chunk_bits: int = 16, name: str = "idx",
    total: str | None = None,
) -> DataFrame:
    """A seeded shuffle order per key: 1..n, reproducible on any partitioning.

    The leading bits of the hash are the chunk, so chunks are of equal size.
    """
    drawn = df.withColumn("__draw", F.xxhash64(row_key, F.lit(seed))).withColumn("__tie", row_key)
    chunk = F.shiftright("__draw", 64 - chunk_bits)
    return numbered(drawn, keys, [F.col("__draw"), F.col("__tie")], chunk, name, total).drop("__draw", "__tie")


def rolling(
    df: DataFrame, keys: Sequence[str], idx: str, width: int, exprs: dict[str, Callable[[object], Column]],
    chunk_rows: int = 1_024,
) -> DataFrame:
    """Windows over the last ``width`` rows of a dense 1..n index per key.

    A long run is cut into chunks; the ``width - 1`` rows before a chunk are
    copied into it, so every window is whole and no run sits in one task.
    """
    size = max(chunk_rows, width)
    home = F.floor(F.col(idx) / size)
    last = F.floor((F.col(idx) + (width - 1)) / size)
    copies = df.withColumn("__home", home).withColumn("__chunk", F.explode(F.sequence(home, last)))
    frame = Window.partitionBy(*keys, "__chunk").orderBy(idx)
    full = frame.rowsBetween(-(width - 1), 0)
    return (
        copies.select("*", *[make(full).alias(name) for name, make in exprs.items()])
        .where(F.col("__chunk") == F.col("__home"))
        .drop("__chunk", "__home")
    )


# -- running totals over sorted distinct values ------------------------------


def _even_cuts(values: list, chunks: int) -> list:
    values = sorted(values)
    stride = max(1, len(values) // chunks)
    return sorted(set(values[stride::stride]))


def sampled_cuts(df: DataFrame, columns: Sequence[str], rows: int, chunks: int) -> dict[str, list]:
    """Cut points per column from about ``chunks * SAMPLES_PER_CHUNK`` of the ``rows``.

    They shape the work, not the result.
    """
    wanted = chunks * SAMPLES_PER_CHUNK
    sample = df.select(*map(col, columns)).sample(min(1.0, wanted / max(rows, 1)), seed=7).collect()
    return {c: _even_cuts([r[i] for r in sample if r[i] is not None], chunks) for i, c in enumerate(columns)}


def _counted_cuts(counts: DataFrame, key: str, value: str, rows: int, chunks: int) -> dict[str, list]:
    """The same from the counted values, where the rows are not at hand."""
    wanted = chunks * SAMPLES_PER_CHUNK
    picked = F.pmod(F.xxhash64(key, value), F.lit(max(1, rows // wanted))) == 0
    per_key: dict[str, list] = {}
    for k, v in counts.where(picked).select(key, value).collect():
        per_key.setdefault(k, []).append(v)
    return {k: _even_cuts(values, chunks) for k, values in per_key.items()}


def running_totals(
    counts: DataFrame,
    measures: Sequence[str],
    rows: int,
    key: str = "column",
    value: str = "value",
    chunks: int | None = None,
    cuts: dict[str, list] | None = None,
) -> DataFrame:
    """Running sum of each measure over the distinct values of each key.

    ``counts`` has one row per (key, value).  The result adds ``cum_<measure>``
    (inclusive), the key's ``total_<measure>`` and ``next_value``.  ``rows`` bounds the row count and decides
    how many chunks each key is cut into; one chunk needs no extra pass.  The
    cuts are constants of the plan, so a recomputed task cuts the same way.
    """
    chunks = chunks or chunks_for(rows)
    if chunks == 1:
        w = Window.partitionBy(key).orderBy(value)
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        return counts.select(
            "*",
            *[F.sum(m).over(upto).alias(f"cum_{m}") for m in measures],
            *[F.sum(m).over(Window.partitionBy(key)).alias(f"total_{m}") for m in measures],
            F.lead(value).over(w).alias("next_value"),
        )

    if cuts is None:
        cuts = _counted_cuts(counts, key, value, rows, chunks)
    placed = _with_chunk(counts, key, value, cuts)
    totals = placed.groupBy(key, "__chunk").agg(
        *[F.sum(m).alias(f"__t_{m}") for m in measures], F.min(value).alias("__first")
    )
    by_chunk = Window.partitionBy(key).orderBy("__chunk")
    before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col(key).alias("__k"),
        F.col("__chunk").alias("__c"),
        *[F.coalesce(F.sum(f"__t_{m}").over(before), F.lit(0)).alias(f"__o_{m}") for m in measures],
        *[F.sum(f"__t_{m}").over(Window.partitionBy(key)).alias(f"total_{m}") for m in measures],
        F.lead("__first").over(by_chunk).alias("__next_first"),
    )
    w = Window.partitionBy(key, "__chunk").orderBy(value)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select(
        "*",
        *[F.sum(m).over(upto).alias(f"__l_{m}") for m in measures],
        F.lead(value).over(w).alias("__lead"),
    )
    # Keys x chunks rows at most, so the offsets may be broadcast.  A null-safe
    # join infers no filter, so both sides keep the same counts and share them.
    same = F.col(key).eqNullSafe(F.col("__k")) & F.col("__chunk").eqNullSafe(F.col("__c"))
    joined = local.join(F.broadcast(offsets), same)
    return joined.select(
        *[col(c) for c in counts.columns],
        *[(F.col(f"__l_{m}") + F.col(f"__o_{m}")).alias(f"cum_{m}") for m in measures],
        *[F.col(f"total_{m}") for m in measures],
        F.coalesce("__lead", "__next_first").alias("next_value"),
    )


def _with_chunk(counts: DataFrame, key: str, value: str, cuts: dict[str, list]) -> DataFrame:
    dtype = counts.schema[value].dataType
    cuts = {k: c for k, c in cuts.items() if c}
    if not cuts:
        return counts.withColumn("__chunk", F.lit(0))
    if isinstance(dtype, T.DoubleType):  # a binary search per key in the JVM
        names = [f"__v{i}" for i in range(len(cuts))]
        apart = counts.select("*", *[F.when(F.col(key) == k, F.col(value)).alias(n) for k, n in zip(cuts, names)])
        found = Bucketizer(
            splitsArray=[[float("-inf"), *c, float("inf")] for c in cuts.values()], inputCols=names, outputCols=[f"{n}c" for n in names],
            handleInvalid="keep",
        ).transform(apart)
        chunk = F.coalesce(*[F.col(f"{n}c") for n in names], F.lit(0.0)).cast("int")
        return found.select(*[col(c) for c in counts.columns], chunk.alias("__chunk"))
    table = counts.sparkSession.createDataFrame(
        list(cuts.items()), f"`__k` {counts.schema[key].dataType.simpleString()}, `__cuts` array<{dtype.simpleString()}>"
    )
    # bounded by keys x chunks, so it may be broadcast
    placed = counts.join(F.broadcast(table), F.col(key) == F.col("__k"), "left")
    return placed.withColumn("__chunk", _chunk_of(F.col("__cuts"), F.col(value))).drop("__k", "__cuts")


def _chunk_of(cuts: Column, v: Column, fan: int = 32) -> Column:
    """How many cut points lie below ``v``: a search in two steps of ``fan``."""
    coarse = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.size(cuts) / fan).cast("int"))),
                      lambda i: F.try_element_at(cuts, i * fan) < v)
    start = F.size(coarse) * fan
    fine = F.filter(F.slice(cuts, start + 1, fan), lambda s: s < v)
    return F.when(cuts.isNull() | (F.size(cuts) == 0), F.lit(0)).otherwise(start + F.size(fine))


# -- exact quantiles --------------------------------------------------------


def _interpolated(low, high, at: float) -> float | None:
    """Between the values at the ranks around ``at``."""
    if low is None or low == high or at == math.floor(at):
        return low
    return (math.ceil(at) - at) * low + (at - math.floor(at)) * high


def exact_quantiles(
    df: DataFrame, columns: dict[str, Column], probs: Sequence[float], exact_limit: int = COUNTED_ROWS
) -> dict[str, dict[float, float | None]]:
    """Exact linear-interpolated quantiles of several double columns.

    Up to ``exact_limit`` rows (checked) the distinct values of each column are
    counted and summed in order.  Beyond that a sketch gives a bracket around
    each wanted rank, one scan proves how many values lie below and inside it,
    and only the values inside the bracket are counted and sorted.
    """
    if not columns:
        return {}
    names, probs = list(columns), [float(p) for p in probs]
    narrow = df.select(*[columns[n].alias(f"q{i}") for i, n in enumerate(names)])
    rows = narrow.count()
    if rows <= exact_limit:
        return _counted_quantiles(narrow, names, probs, rows)

    accuracy, slack = 20_000, 2 / 20_000
    edges = [e for p in probs for e in (max(0.0, p - slack), min(1.0, p + slack))]
    sketch = narrow.agg(
        *[F.count(f"q{i}").alias(f"n{i}") for i in range(len(names))],
        *[F.percentile_approx(f"q{i}", edges, accuracy).alias(f"e{i}") for i in range(len(names))],
    ).first()
    jobs = []  # (column index, prob, low, high, rank below, rank above)
    for i in range(len(names)):
        n = sketch[f"n{i}"]
        for j, p in enumerate(probs):
            if n:
                low, high = sketch[f"e{i}"][2 * j : 2 * j + 2]
                at = p * (n - 1)
                jobs.append([i, p, low, high, math.floor(at), math.ceil(at), at])
    if jobs:
        sizes = narrow.agg(
            *[F.count(F.when(F.col(f"q{j[0]}") < j[2], 1)).alias(f"b{k}") for k, j in enumerate(jobs)],
            *[F.count(F.when(F.col(f"q{j[0]}") <= j[3], 1)).alias(f"a{k}") for k, j in enumerate(jobs)],
        ).first()
        for k, job in enumerate(jobs):
            if not (sizes[f"b{k}"] <= job[4] and job[5] < sizes[f"a{k}"]):
                job[2], job[3] = float("-inf"), float("inf")
                job.append(0)
            else:
                job.append(sizes[f"b{k}"])
    out = {n: {p: None for p in probs} for n in names}
    if not jobs:
        return out
    inside = F.array(
        *[
            F.when(F.col(f"q{j[0]}").between(j[2], j[3]), F.struct(F.lit(k).alias("job"), F.col(f"q{j[0]}").alias("value")))
            for k, j in enumerate(jobs)
        ]
    )
    counts = (
        narrow.select(F.explode(F.filter(inside, lambda s: s.isNotNull())).alias("s"))
        .groupBy(F.col("s.job").cast("string").alias("job"), F.col("s.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    whole = any(j[2] == float("-inf") for j in jobs)
    inside_rows = rows if whole else int(2 * slack * rows) + 1
    cum = running_totals(counts, ["n"], inside_rows, key="job")
    frame = narrow.sparkSession.createDataFrame(
        [(str(k), j[4] - j[7], j[5] - j[7]) for k, j in enumerate(jobs)], "__job string, low bigint, high bigint"
    )
    picked = (
        cum.join(F.broadcast(frame), F.col("job") == F.col("__job"))
        .groupBy("job")
        .agg(
            F.min(F.when(F.col("cum_n") > F.col("low"), F.col("value"))).alias("low"),
            F.min(F.when(F.col("cum_n") > F.col("high"), F.col("value"))).alias("high"),
        )
        .collect()
    )
    for row in picked:
        i, p, *_, at, _ = jobs[int(row["job"])]
        out[names[i]][p] = _interpolated(row["low"], row["high"], at)
    return out


def _counted_quantiles(narrow: DataFrame, names: list[str], probs: list[float], rows: int):
    counts = (
        narrow.unpivot([], narrow.columns, "column", "value").where(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    chunks = chunks_for(rows)
    cuts = sampled_cuts(narrow, narrow.columns, rows, chunks) if chunks > 1 else None
    cum = running_totals(counts, ["n"], rows, chunks=chunks, cuts=cuts)
    at = [F.lit(p) * (F.col("total_n") - 1) for p in probs]
    first = lambda rank: F.min(F.when(F.col("cum_n") > rank, F.col("value")))
    picked = cum.groupBy("column").agg(
        F.max("total_n").alias("total"),
        *[first(F.floor(x)).alias(f"low{k}") for k, x in enumerate(at)],
        *[first(F.ceil(x)).alias(f"high{k}") for k, x in enumerate(at)],
    )
    out = {n: {p: None for p in probs} for n in names}
    for r in picked.collect():
        for k, p in enumerate(probs):
            out[names[int(r["column"][1:])]][p] = _interpolated(r[f"low{k}"], r[f"high{k}"], p * (r["total"] - 1))
    return out


def weighted_quantile(counts: DataFrame, value: str, weight: str, prob: float, rows: int) -> float | None:
    """Exact linear-interpolated quantile where each value stands for ``weight`` rows."""
    flat = (
        counts.groupBy(F.col(value).alias("value"))
        .agg(F.sum(weight).alias("n"))
        .withColumn("column", F.lit("v"))
    )
    flat = materialised(flat)  # read once for the total, once for the ranks
    total = flat.agg(F.sum("n")).first()[0]
    if not total:
        return None
    at = prob * (total - 1)
    lo, hi = math.floor(at), math.ceil(at)
    a, b = (
        running_totals(flat, ["n"], rows)
        .agg(F.min(F.when(F.col("cum_n") > lo, F.col("value"))), F.min(F.when(F.col("cum_n") > hi, F.col("value"))))
        .first()
    )
    return _interpolated(a, b, at)


def medians(df: DataFrame, columns: dict[str, Column], **kw) -> dict[str, float]:
    """Median per column; 0 where a column has no value."""
    found = exact_quantiles(df, columns, [0.5], **kw)
    return {n: (0.0 if q[0.5] is None else q[0.5]) for n, q in found.items()}
