import math

import pandas as pd
import pytest

from semblance.operators import profile as P
from semblance.operators import validate as V


def rows(df, target=None, **kw):
    return {r["column"]: r.asDict(recursive=True) for r in P.profile(df, target, **kw).collect()}


def test_type_gates(spark):
    df = spark.range(60).selectExpr(
        "id AS key", "cast(id % 52 AS string) AS nearly", "id % 5 AS five", "id % 6 AS six", "CASE WHEN id % 10 = 0 THEN 'x' ELSE cast(id % 7 AS string) END AS mixed",
        "CASE WHEN id % 9 = 0 THEN 'x' ELSE cast(id % 7 AS string) END AS too_mixed", "cast(NULL AS string) AS empty", "'  ' AS blank", "1.0D AS konst", "id % 2 AS y",
    )
    p = rows(df, "y")
    assert p["key"]["role"] == "skipped" and p["empty"]["role"] == "skipped" and p["blank"]["role"] == "skipped"
    assert p["nearly"]["type"] == "numeric"  # 52 of 60 is below the share
    assert p["five"]["type"] == "categorical" and p["six"]["type"] == "numeric"
    assert p["mixed"]["type"] == "numeric" and p["too_mixed"]["type"] == "categorical"
    assert p["konst"]["is_constant"] and p["konst"]["type"] == "categorical"
    assert p["y"]["role"] == "target" and p["y"]["type"] == "categorical"
    assert p["five"]["top_value_stats"][0] == {"value": "0", "count": 12, "pct": 20.0}
    assert p["five"]["example_values"] == ["0", "1", "2"] and p["five"]["most_common_freq"] == 12


def test_skip_gate_needs_more_than_fifty_values(spark):
    fifty = spark.range(50).selectExpr("concat('v', id) AS c", "id % 2 AS y")
    assert rows(fifty, "y")["c"]["role"] == "feature"
    assert rows(spark.range(52).selectExpr("concat('v', least(id, 50)) AS c", "id % 2 AS y"), "y")["c"]["role"] == "skipped"


@pytest.mark.parametrize("xs", [[1, 2, 3, 4, 5, 6, 20], [0.5, -1, 8, 8, 8, 2, 3, 1e3], [4, 1, 7, 2, 9, 3]])
def test_moments_match_pandas(spark, xs):
    series = pd.Series(xs, dtype=float)
    p = rows(spark.createDataFrame([(float(x), "ab"[i % 2]) for i, x in enumerate(xs)], "x double, y string"), "y")["x"]
    want = {
        "min": series.min(), "max": series.max(), "mean": series.mean(), "std": series.std(), "median": series.median(), "q1": series.quantile(0.25),
        "q3": series.quantile(0.75), "skewness": series.skew(), "kurtosis": series.kurt(),
    }
    assert {k: p[k] for k in want} == pytest.approx(want)


def test_nan_and_infinity_are_missing_numbers(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)] + [(math.nan,), (math.inf,)], "x double")
    p = rows(df)["x"]
    assert p["type"] == "numeric" and p["max"] == 19.0


def test_empty_table(spark):
    p = rows(spark.createDataFrame([], "a double, b string, y string"), "y")
    assert all(r["role"] == "skipped" for r in p.values())


def test_ingest_golden(spark):
    df = spark.createDataFrame([(10.5, "A", 0), (12.0, "B", 0), (13.5, "A", 0), (99.9, "C", 1)], "amount double, merchant string, fraud int")
    p = rows(df, "fraud")
    assert sum(r["role"] == "feature" for r in p.values()) == 2
    assert {r["label"]: r["count"] for r in P.class_distribution(df, "fraud").collect()} == {"0": 3, "1": 1}
    im = P.class_imbalance(df, "fraud").first()
    assert (im["minority_class"], im["class_ratio"], im["is_severe"]) == ("1", "1:3", False)
    assert im["recommendation"].startswith("Dataset is relatively balanced (25.00% minority).")


def test_imbalance_texts_and_single_class(spark):
    make = lambda n, m: spark.range(n).selectExpr(f"CASE WHEN id < {m} THEN 'rare' ELSE 'common' END AS y")
    assert "severe class imbalance (4.00%" in P.class_imbalance(make(100, 4), "y").first()["recommendation"]
    assert "moderate class imbalance (10.00%" in P.class_imbalance(make(100, 10), "y").first()["recommendation"]
    one = P.class_imbalance(make(10, 0), "y").first()
    assert one["minority_class"] == one["majority_class"] == "common" and one["class_ratio"] == "1:1"
    assert P.class_imbalance(make(10, 0).where("false"), "y").count() == 0


@pytest.mark.parametrize(
    "sql,message",
    [
        ("cast(NULL AS string)", "entirely empty"),
        ("'a'", "at least 2 unique classes for classification. Found 1."),
        ("cast(id AS string)", "2-20 unique values for classification. Found 21 unique values."),
        ("CASE WHEN id % 2 = 0 THEN 0.5D ELSE 1.5D END", "Continuous float"),
    ],
)
def test_target_rules(spark, sql, message):
    with pytest.raises(V.TableError, match=message.replace(".", r"\.")):
        V.validate_target(spark.range(21).selectExpr(f"{sql} AS y"), "y")


def test_target_accepts(spark):
    V.validate_target(spark.range(20).selectExpr("cast(id AS double) AS y"), "y")
    with pytest.raises(V.TableError, match="'fraud' not found. Available columns: amount"):
        V.validate_target(spark.createDataFrame([(1,), (2,)], "amount int"), "fraud")
