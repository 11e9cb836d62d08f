import numpy as np
import pytest
from pyspark.sql import functions as F

from semblance.operators import order as O


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows hold one value."""
    return spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 7.0D ELSE (id * 37 % 1009) / 3.0D END AS x", "id")


@pytest.mark.parametrize("limit", [0, 10**6])
def test_quantiles_match_numpy(spark, skewed, limit):
    probs = [0.0, 0.01, 0.25, 0.5, 0.777, 1.0]
    found = O.exact_quantiles(skewed, {"x": F.col("x")}, probs, exact_limit=limit)["x"]
    xs = np.array([r["x"] for r in skewed.select("x").collect()])
    for p in probs:
        assert found[p] == pytest.approx(np.percentile(xs, p * 100), abs=1e-9)


@pytest.mark.parametrize("limit", [0, 10])
def test_quantiles_of_nothing(spark, limit):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert O.exact_quantiles(df, {"x": F.col("x")}, [0.5], exact_limit=limit) == {"x": {0.5: None}}
    assert O.medians(df, {"x": F.col("x")}, exact_limit=limit) == {"x": 0.0}


def test_weighted_quantile(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 1), (9.0, 2)], "v double, w bigint")
    flat = [1.0] * 5 + [2.0] + [9.0] * 2
    for p in (0.0, 0.5, 0.75, 0.9, 1.0):
        assert O.weighted_quantile(df, "v", "w", p, 3) == pytest.approx(np.percentile(flat, p * 100))


@pytest.mark.parametrize("kind", ["double", "string"])
def test_running_totals_do_not_depend_on_chunks(spark, kind):
    counts = spark.range(700).selectExpr("concat('c', id % 2) AS column", f"cast(id * 31 % 701 AS {kind}) AS value", "id % 5 AS n")
    one = O.running_totals(counts, ["n"], 700, chunks=1)
    many = O.running_totals(counts, ["n"], 700, chunks=40)
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, many.collect()), key=str)


def test_numbering_a_hot_key(spark):
    df = spark.range(3000).selectExpr("CASE WHEN id % 3 > 0 THEN 'hot' ELSE concat('k', id % 50) END AS k", "id")
    got = O.numbered(df, ["k"], [F.col("id")], F.floor(F.col("id") / 100))
    bad = got.groupBy("k").agg(F.count("*").alias("n"), F.max("idx").alias("m"), F.countDistinct("idx").alias("d")).where("n != m OR n != d")
    assert bad.count() == 0
    hot = [r["id"] for r in got.where("k = 'hot'").orderBy("idx").collect()]
    assert hot == sorted(hot)


def test_hash_order_ignores_partitioning(spark):
    df = spark.range(500).selectExpr("id % 2 AS k", "id")
    a = O.hash_numbered(df.repartition(3), ["k"], F.col("id"))
    b = O.hash_numbered(df.repartition(7), ["k"], F.col("id"))
    assert a.exceptAll(b).count() == 0
    assert a.where("k = 0").agg(F.max("idx"), F.countDistinct("idx")).first() == (250, 250)


@pytest.mark.parametrize("width", [1, 2, 10])
def test_rolling_over_chunk_edges(spark, width):
    df = spark.range(1, 101).selectExpr("'a' AS k", "id AS idx", "(id * 7 % 13) AS v")
    got = O.rolling(df, ["k"], "idx", width, {"s": lambda w: F.sum("v").over(w), "n": lambda w: F.count("v").over(w)}, chunk_rows=10)
    v = [i * 7 % 13 for i in range(1, 101)]
    rows = got.orderBy("idx").collect()
    assert len(rows) == 100
    for r in rows:
        window = v[max(0, r["idx"] - width) : r["idx"]]
        assert (r["s"], r["n"]) == (sum(window), len(window))


def test_rows_of_known_keys_are_dealt_out_once(spark):
    df = spark.range(1000).select(F.col("id"), F.shiftright("id", 7).alias("k"))
    plan = lambda d: O.hash_numbered(d, ["k"], F.col("id"))._jdf.queryExecution().executedPlan().toString()
    nullable = df.withColumn("k", F.when(F.col("k") > 0, F.col("k")))
    # Keys that may be null are joined by other expressions than the window's, for which large tables are dealt out anew.
    assert "coalesce(k" in plan(nullable) and "coalesce(k" not in plan(df)
    got = {(r["k"], r["idx"]) for r in O.hash_numbered(nullable, ["k"], F.col("id")).collect()}
    assert len(got) == 1000 and (None, 1) in got
