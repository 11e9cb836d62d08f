"""A generator that follows the strongest dependences between columns.

Fit: columns become states (a number's bins, a category itself).  The mutual information
of every pair of columns comes from one pass; its maximum spanning tree says which pairs
to learn, and for these the joint counts of all states are kept as they are.  Generate:
one column after the other along the tree, each drawn from its counts beside its parent's
state.  Any shape of dependence along an edge is kept, categories with categories included.

Conditions are exact: counts below a given column are weighed by how likely they make it,
from the leaves to the root, before anything is drawn.  Draws are a function of row number
and seed, so a lost task draws the same rows again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semblance.functions.scalars import col
from semblance.operators.prepare import hash_uniform, training_frame
from semblance.operators.profile import TableSchema, value_counts
from semblance.operators.trees import Coding
from semblance.session import ship, written

STATES = 32  # bins of a number; categories that the choice of the tree tells apart, the rarest as one
FINE = 8  # steps inside a bin at which its values are known
ACCURACY = 20_000  # of the sketch that a number's knots come from: ranks are right to one part in so many
ROWS_TO_SEND = 100_000  # rows of a count table that a join may broadcast
HELD_PAIRS = 4_096  # pairs of columns whose counts a task adds up before it hands them on


@dataclass
class Number:
    """A numeric column's states: own values where they are few, else bins between ``knots``, ``FINE`` steps a bin."""

    cuts: list[float]
    knots: list[float]
    values: list[float] | None
    whole: bool

    def state(self, x: float) -> int:
        return int(np.searchsorted(self.cuts, x, side="right"))


@dataclass
class TreeModel:
    """Columns, their states, the tree's edges and for each the joint counts of the two columns' states."""

    schema: TableSchema
    columns: list[str]
    numbers: dict[str, Number]
    edges: list[tuple[int, int]]
    counts: DataFrame  # edge, a, b (states as text), n
    single: DataFrame  # place, state, n
    information: dict[tuple[int, int], float]
    rows: int

    def describe(self) -> list[tuple[str, str, float]]:
        """The edges with their mutual information in nats."""
        return [(self.columns[a], self.columns[b], self.information[a, b]) for a, b in self.edges]


# -- states --------------------------------------------------------------------


def _numbers(frame: DataFrame, columns: list[str]) -> dict[str, Number]:
    if not columns:
        return {}
    x = lambda c: col(c).cast("double")
    steps = [i / (STATES * FINE) for i in range(STATES * FINE + 1)]
    row = frame.agg(*[F.percentile_approx(x(c), steps, ACCURACY) for c in columns], *[F.bool_and(F.abs(x(c) - F.rint(x(c))) < 1e-9) for c in columns]).first()
    out = {}
    for i, c in enumerate(columns):
        whole = bool(row[len(columns) + i])
        # One row more than states is enough to know.
        few = sorted(r[0] for r in frame.select(x(c)).where(x(c).isNotNull()).distinct().limit(STATES + 1).collect())
        if len(few) <= STATES:
            out[c] = Number(few[1:], few, few or [0.0], whole)
            continue
        knots = [float(k) for k in row[i]]
        # A value that fills several bins is one state.
        out[c] = Number(sorted({k for k in knots[FINE:-1:FINE] if k > knots[0]}), knots, None, whole)
    return out


def states(frame: DataFrame, columns: list[str], numbers: dict[str, Number]) -> DataFrame:
    """The state of every column as text, columns ``s0, s1, ...``."""
    out = []
    for i, c in enumerate(columns):
        if c in numbers:
            cuts = numbers[c].cuts
            bin_ = F.size(F.filter(F.array(*[F.lit(v) for v in cuts]), lambda v: v <= col(c).cast("double"))) if cuts else F.lit(0)  # noqa: B023
            out.append(bin_.cast("string").alias(f"s{i}"))
        else:
            out.append(col(c).cast("string").alias(f"s{i}"))
    return frame.select(*out)


def pair_sums(coded: DataFrame, width: int) -> DataFrame:
    """(i, j, s) for every pair of the columns, whole numbers below STATES: the sum of n log n over their joint counts."""
    ship(coded.sparkSession)
    pairs = [(i, j) for i in range(width) for j in range(i + 1, width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(pairs), STATES * STATES), np.int64) if len(pairs) <= HELD_PAIRS else None

        def out(first: int, counts: np.ndarray) -> pa.RecordBatch:
            p, cell = np.nonzero(counts)
            ij = np.array(pairs, np.int32).reshape(-1, 2)[p + first]
            return pa.RecordBatch.from_arrays([pa.array(ij[:, 0]), pa.array(ij[:, 1]), pa.array(cell.astype(np.int32)), pa.array(counts[p, cell])], ["i", "j", "cell", "n"])

        for batch in batches:
            s = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(width)]
            for p, (i, j) in enumerate(pairs):
                counts = np.bincount(s[i] * STATES + s[j], minlength=STATES * STATES)
                if held is None:
                    yield out(p, counts[None])
                else:
                    held[p] += counts
        if held is not None:
            yield out(0, held)

    cells = coded.mapInArrow(run, "i int, j int, cell int, n long").groupBy("i", "j", "cell").agg(F.sum("n").alias("n"))
    return cells.groupBy("i", "j").agg(F.sum(F.col("n") * F.log(F.col("n"))).alias("s"))


def mutual_information(df: DataFrame, schema: TableSchema) -> tuple[dict[tuple[int, int], float], list[str]]:
    """Mutual information in nats of every pair of columns of the training frame, and the columns."""
    frame = written(training_frame(df, schema))
    columns, rows = frame.columns, frame.count()
    numbers = _numbers(frame, [c for c in columns if c in schema.numeric])
    return _information(frame, columns, numbers, rows), columns


def _information(frame: DataFrame, columns: list[str], numbers: dict[str, Number], rows: int) -> dict[tuple[int, int], float]:
    text = [c for c in columns if c not in numbers]
    kept: dict[str, list[str]] = {c: [] for c in text}
    if text:
        by_count = Window.partitionBy("column").orderBy(F.desc("count"), "value")
        # The most frequent categories of each column; Spark cuts each task's part before it shuffles.
        top = value_counts(frame, text).withColumn("place", F.row_number().over(by_count)).where(F.col("place") < STATES)
        for r in top.orderBy("column", "place").collect():
            kept[r["column"]].append(r["value"])
    code = Coding([c for c in columns if c in numbers], [], [np.array(numbers[c].cuts) for c in columns if c in numbers])
    named = [F.coalesce(F.array_position(F.array(*[F.lit(v) for v in kept[c]]), col(c)), F.lit(0)).cast("int").alias(c) for c in text if kept[c]]
    named += [F.lit(0).alias(c) for c in text if not kept[c]]
    plain = code.coded(frame.select(*[col(c) for c in code.numeric], *named), *[col(c) for c in text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = dict(zip(code.numeric, code.bins(batch)))
            own = [pa.array(bins[c].astype(np.int32)) if c in bins else batch.column(c).cast(pa.int32()) for c in columns]
            yield pa.RecordBatch.from_arrays(own, [f"c{i}" for i in range(len(columns))])

    ship(frame.sparkSession)
    coded = written(plain.mapInArrow(run, ", ".join(f"c{i} int" for i in range(len(columns)))))
    one = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"c{i}").alias("s")) for i in range(len(columns))])).alias("p")
    alone = coded.select(one).groupBy("p.i", "p.s").count().groupBy("i").agg(F.sum(F.col("count") * F.log("count")).alias("s"))
    single = {r["i"]: r["s"] for r in alone.collect()}
    # H(a) + H(b) - H(a, b), rounded so that the order of summation cannot tell.
    joint = pair_sums(coded, len(columns)).collect() if len(columns) > 1 else []
    return {(r["i"], r["j"]): round(max(0.0, math.log(rows) + (r["s"] - single[r["i"]] - single[r["j"]]) / rows), 12) for r in joint}


def spanning_tree(width: int, information: dict[tuple[int, int], float]) -> list[tuple[int, int]]:
    """The maximum spanning tree's edges (a < b); ties go to the earlier columns."""
    group, out = list(range(width)), []
    for (a, b), _ in sorted(information.items(), key=lambda e: (-e[1], e[0])):
        if group[a] != group[b]:
            out.append((a, b))
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    return out


def fit(df: DataFrame, schema: TableSchema) -> TreeModel:
    """Fit to the labelled, filled rows of ``df``; the columns the profile skips are not learned."""
    frame = written(training_frame(df, schema))
    columns, rows = frame.columns, frame.count()
    if not rows:
        raise ValueError("The table has no rows to learn from.")
    numbers = _numbers(frame, [c for c in columns if c in schema.numeric])
    information = _information(frame, columns, numbers, rows)
    edges = spanning_tree(len(columns), information)
    s = states(frame, columns, numbers)
    one = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.col(f"s{i}").alias("state")) for i in range(len(columns))])).alias("p")
    single = written(s.select(one).groupBy("p.place", "p.state").agg(F.count(F.lit(1)).alias("n")))
    if edges:
        pair = F.explode(F.array(*[F.struct(F.lit(e).alias("edge"), F.col(f"s{a}").alias("a"), F.col(f"s{b}").alias("b")) for e, (a, b) in enumerate(edges)])).alias("p")
        counts = written(s.select(pair).groupBy("p.edge", "p.a", "p.b").agg(F.count(F.lit(1)).alias("n")))
    else:
        counts = frame.sparkSession.createDataFrame([], "edge int, a string, b string, n long")
    return TreeModel(schema, columns, numbers, edges, counts, single, information, rows)


# -- generate ------------------------------------------------------------------


def _rooted(width: int, edges: list[tuple[int, int]], root: int) -> list[tuple[int, int, int]]:
    """(node, parent, edge) in an order in which parents come first."""
    out, seen, front = [], {root}, [root]
    while front:
        node = front.pop(0)
        for e, (a, b) in enumerate(edges):
            other = b if a == node else a if b == node else None
            if other is not None and other not in seen:
                seen.add(other)
                front.append(other)
                out.append((other, node, e))
    return out


def _table(model: TreeModel, node: int, edge: int) -> DataFrame:
    """(parent, state, w) of the node's states beside its parent's."""
    own, other = ("a", "b") if model.edges[edge][0] == node else ("b", "a")
    return model.counts.where(F.col("edge") == edge).select(F.col(other).alias("parent"), F.col(own).alias("state"), F.col("n").cast("double").alias("w"))


def _given(model: TreeModel, condition: dict) -> dict[int, str]:
    out = {}
    for column, value in condition.items():
        if column not in model.columns:
            raise ValueError(f"Column '{column}' is not part of the model.")
        place = model.columns.index(column)
        out[place] = str(model.numbers[column].state(float(value))) if column in model.numbers else str(value)
        if model.single.where((F.col("place") == place) & (F.col("state") == out[place])).isEmpty():
            raise ValueError(f"Column '{column}' has no category '{value}'.")
    return out


def _weighed(model: TreeModel, order: list[tuple[int, int, int]], root: int, given: dict[int, str]) -> dict[int, DataFrame]:
    """For each node its states' weights beside each parent state, given the conditions at and below it.

    From the leaves up, a node tells its parent how likely each of the parent's states makes the conditions.
    """
    message: dict[int, list[DataFrame]] = {}
    out = {}
    alone = model.single.where(F.col("place") == root).select(F.lit("").alias("parent"), "state", F.col("n").cast("double").alias("w"))
    for node, parent, edge in [*reversed(order), (root, None, None)]:
        table = _table(model, node, edge) if parent is not None else alone
        total = table.groupBy("parent").agg(F.sum("w").alias("total"))
        changed = node in given or node in message
        if node in given:
            table = table.where(F.col("state") == given[node])
        for factor in message.get(node, []):
            table = table.join(factor, "state").select("parent", "state", (F.col("w") * F.col("factor")).alias("w"))
        out[node] = table.where("w > 0")
        if changed and parent is not None:
            told = out[node].groupBy("parent").agg(F.sum("w").alias("s")).join(total, "parent")
            message.setdefault(parent, []).append(written(told.select(F.col("parent").alias("state"), (F.col("s") / F.col("total")).alias("factor"))))
    return out


def _drawn(rows: DataFrame, node: int, parent: str, table: DataFrame, u: Column) -> DataFrame:
    """Adds column ``s<node>``: a state of the table beside each row's parent state, by the row's number ``u``.

    A parent's states share the unit interval by weight.  Rows and states meet in slots of that interval, about as many as a
    parent has states, so a row meets two states on average, whatever their number, and a frequent parent is spread over its slots.
    """
    along = Window.partitionBy("parent").orderBy("state")
    shares = table.withColumn("hi", F.sum("w").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn(
        "all", F.sum("w").over(Window.partitionBy("parent"))
    ).withColumn("last", F.lead("state").over(along).isNull())
    shares = shares.select(
        "parent", "state", F.coalesce(F.lag("hi").over(along) / F.col("all"), F.lit(0.0)).alias("lo"), F.when(F.col("last"), F.lit(1.0)).otherwise(F.col("hi") / F.col("all")).alias("hi")
    )
    shares = written(shares)
    size = shares.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("parent").alias("p")).first()
    slots = max(1, min(65_536, math.ceil(size.n / max(size.p, 1))))
    slot = F.explode(F.sequence(F.floor(F.col("lo") * slots), F.least(F.floor(F.col("hi") * slots), F.lit(slots - 1)))).alias("__slot")
    meets = shares.select(F.col("parent").alias("__parent"), F.col("state").alias("__state"), "lo", "hi", slot)
    if size.n + size.p * slots <= ROWS_TO_SEND:
        meets = F.broadcast(meets)
    asked = rows.withColumn("__u", u).withColumn("__slot", F.floor(F.col("__u") * slots))
    own = F.lit("") if parent == "" else F.col(parent)
    met = asked.join(meets, (own == F.col("__parent")) & (asked["__slot"] == meets["__slot"])).where("__u >= lo AND __u < hi")
    return met.select(*[F.col(c) for c in rows.columns], F.col("__state").alias(f"s{node}"))


def _value(model: TreeModel, place: int, seed: int) -> Column:
    """The column's value from its state; a bin gives a value between its ends, at the steps known inside."""
    column, state = model.columns[place], F.col(f"s{place}")
    number = model.numbers.get(column)
    if number is None:
        return state
    at = state.cast("int")
    if number.values is not None:
        return F.element_at(F.array(*[F.lit(float(v)) for v in number.values]), at + 1)
    knots = np.array(number.knots)
    # Steps of each bin: from the first knot that is not below its lower cut to the upper cut's.
    ends = [0, *[int(np.searchsorted(knots, c)) for c in number.cuts], len(knots) - 1]
    lit = lambda vs: F.array(*[F.lit(v) for v in vs])
    first, steps = F.element_at(lit(ends[:-1]), at + 1), F.element_at(lit([b - a for a, b in zip(ends, ends[1:])]), at + 1)
    along = hash_uniform(seed, F.col("id"), F.lit(place), F.lit("inside")) * steps
    step = F.least(F.floor(along).cast("int"), F.greatest(steps - 1, F.lit(0)))
    low = F.element_at(lit([float(k) for k in knots]), first + step + 1)
    high = F.element_at(lit([float(k) for k in knots]), F.least(first + step + 2, F.lit(len(knots))))
    x = low + (high - low) * (along - step)
    return F.rint(x) if number.whole else x


def generate(spark: SparkSession, model: TreeModel, n: int, seed: int = 42, condition: dict | None = None) -> DataFrame:
    """n rows; conditions fix any number of columns to values, and the others follow exactly as the tree has it.

    An unknown column or category, or conditions that never meet, are errors.
    """
    given = _given(model, condition or {})
    root = next(iter(given), 0)
    order = _rooted(len(model.columns), model.edges, root)
    tables = _weighed(model, order, root, given)
    if given and tables[root].isEmpty():
        raise ValueError("The conditions never meet.")
    out = spark.range(n)
    for node, parent in [(root, None), *[(c, p) for c, p, _ in order]]:
        u = hash_uniform(seed, F.col("id"), F.lit(node), F.lit("state"))
        out = _drawn(out, node, "" if parent is None else f"s{parent}", tables[node], u)
    done = []
    for i, c in enumerate(model.columns):
        fixed = condition and c in condition
        done.append((F.lit(condition[c]).cast("double" if c in model.numbers else "string") if fixed else _value(model, i, seed)).alias(c))
    return out.select(*done)
