"""The generator along the tree of the strongest dependences."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from semblance.operators import dependence as D
from semblance.operators.profile import TableSchema

SCHEMA = TableSchema(("x", "y", "few"), ("a", "b"), (), "label")


@pytest.fixture(scope="module")
def table(spark):
    """y follows x along a parabola, b follows a, few follows b, the label follows x; nothing of it is a rank correlation."""
    rnd, rows = random.Random(5), []
    for _ in range(6000):
        x, a = rnd.uniform(-1, 1), rnd.choice("pqrst")
        b = {"p": "one", "q": "two", "r": "one", "s": "two", "t": "three"}[a] if rnd.random() < 0.95 else "rare"
        few = {"one": 1.0, "two": 7.0, "three": 1.0, "rare": 3.0}[b]
        rows.append((x, x * x + rnd.gauss(0, 0.02), few, a, b, "in" if abs(x) < 0.5 else "out"))
    return spark.createDataFrame(rows, "x double, y double, few double, a string, b string, label string").repartition(4).cache()


@pytest.fixture(scope="module")
def model(table):
    return D.fit(table, SCHEMA)


def test_information_as_brute_force(table):
    found, columns = D.mutual_information(table, SCHEMA)
    rows = table.select(*columns).collect()
    at = {c: i for i, c in enumerate(columns)}
    for pair in (("a", "b"), ("b", "few"), ("a", "label")):
        i, j = sorted(at[c] for c in pair)
        n, ni, nj = Counter((r[i], r[j]) for r in rows), Counter(r[i] for r in rows), Counter(r[j] for r in rows)
        want = sum(c / len(rows) * math.log(c * len(rows) / (ni[u] * nj[v])) for (u, v), c in n.items())
        assert found[i, j] == pytest.approx(max(want, 0), abs=1e-8)
    assert len(found) == len(columns) * (len(columns) - 1) // 2


def test_tree_takes_the_strongest_edges(model):
    edges = {frozenset(e[:2]) for e in model.describe()}
    assert len(edges) == 5 and {frozenset("xy"), frozenset("ab"), frozenset(("b", "few"))} <= edges
    assert frozenset(("x", "label")) in edges or frozenset(("y", "label")) in edges
    assert D.spanning_tree(3, {(0, 1): 0.5, (0, 2): 0.5, (1, 2): 0.5}) == [(0, 1), (0, 2)]


def test_joint_shares_of_every_edge(spark, table, model):
    n = 20_000
    drawn = D.generate(spark, model, n, seed=3)
    assert drawn.columns == model.columns and drawn.count() == n
    real = D.states(table.select(*model.columns), model.columns, model.numbers)
    made = D.states(drawn, model.columns, model.numbers)
    for a, b in model.edges:
        want = {(r[0], r[1]): r[2] / 6000 for r in real.groupBy(f"s{a}", f"s{b}").count().collect()}
        got = {(r[0], r[1]): r[2] / n for r in made.groupBy(f"s{a}", f"s{b}").count().collect()}
        for k in want.keys() | got.keys():
            share = want.get(k, 0)
            # A value on the border of a bin may stand in the next one.
            assert abs(got.get(k, 0) - share) < 6 * math.sqrt(max(share, 1 / 6000) / n) + 1e-3, (a, b, k)
    rows = drawn.select("x", "y", "few", "b").collect()
    assert np.mean([abs(r.y - r.x * r.x) < 0.12 for r in rows]) > 0.9
    assert all(r.few == {"one": 1.0, "two": 7.0, "three": 1.0, "rare": 3.0}[r.b] for r in rows)


def test_draws_do_not_depend_on_partitions(spark, model):
    a = D.generate(spark, model, 500, seed=1)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert a.exceptAll(D.generate(spark, model, 500, seed=1)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a.exceptAll(D.generate(spark, model, 500, seed=2)).count() > 300


def test_conditions_are_exact(spark, table, model):
    """Shares of a below a condition on few, two edges away, and under two conditions at once."""
    made = D.generate(spark, model, 20_000, condition={"few": 1.0})
    assert made.where("few != 1.0").count() == 0
    want = {r[0]: r[1] for r in table.where("few = 1.0").groupBy("a").count().collect()}
    got = {r[0]: r[1] / 20_000 for r in made.groupBy("a").count().collect()}
    for a, n in want.items():
        assert got[a] == pytest.approx(n / sum(want.values()), abs=0.015)
    both = D.generate(spark, model, 4_000, condition={"label": "in", "a": "t", "y": 0.04})
    assert both.where("label = 'in' AND a = 't' AND y = 0.04").count() == 4_000
    assert both.where("abs(x) BETWEEN 0.05 AND 0.35").count() > 3_500 and both.where("x < 0").count() == pytest.approx(2_000, abs=400)
    for wrong in ({"a": "none"}, {"nothing": 1}, {"a": "p", "b": "three"}):
        with pytest.raises(ValueError):
            D.generate(spark, model, 5, condition=wrong)


def test_wide_categories_and_hot_values(spark):
    rnd = random.Random(2)
    rows = [(f"k{i % 700}", f"v{i % 700 // 7}", 5.0 if rnd.random() < 0.4 else float(rnd.randrange(1000)), "l") for i in range(7000)]
    df = spark.createDataFrame(rows, "k string, v string, n double, label string")
    model = D.fit(df, TableSchema(("n",), ("k", "v"), (), "label"))
    made = D.generate(spark, model, 14_000)
    assert made.where("concat('v', cast(floor(cast(substring(k, 2) AS int) / 7) AS int)) != v").count() == 0
    assert made.select("k").distinct().count() == 700
    assert made.where("n = 5.0").count() / 14_000 == pytest.approx(df.where("n = 5.0").count() / 7000, abs=0.03)
    assert made.agg(F.min("n") >= 0, F.max("n") <= 999, F.bool_and(F.col("n") == F.rint("n"))).first()[:] == (True, True, True)


def test_small_tables(spark):
    one = spark.createDataFrame([(1.0, "a", "l")], "x double, c string, label string")
    schema = TableSchema(("x",), ("c",), (), "label")
    assert D.generate(spark, D.fit(one, schema), 3).collect() == [(1.0, "a", "l")] * 3
    with pytest.raises(ValueError):
        D.fit(one.where("false"), schema)
    only = D.fit(one.select("label"), TableSchema((), (), (), "label"))
    assert D.generate(spark, only, 2).collect() == [("l",)] * 2
