import math

import pytest
from pyspark.sql import functions as F

from semblance.functions import scalars as S


def values(spark, texts, fn, kind="string"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", fn(F.col("v"), df.schema["v"].dataType).alias("x")).orderBy("i").collect()]


def test_trim_and_blank(spark):
    got = values(spark, ["  a ", " b　", "\t\n", " ", "\x1cc\x1f", "a b", None], lambda c, t: S.trimmed(c))
    assert got == ["a", "b", None, None, "c", "a b", None]


def test_number_text(spark):
    texts = ["1", " 12 ", "1d", "1f", "1_000", "0x10", "nan", "inf", "1e999", "-.5", "1.", ".", "+3e-2", "", None, "1 2"]
    assert values(spark, texts, S.number) == [1.0, 12.0, None, None, None, None, None, None, None, -0.5, 1.0, None, 0.03, None, None, None]


def test_number_types(spark):
    assert values(spark, [1.5, math.nan, math.inf, None], S.number, "double") == [1.5, None, None, None]
    assert values(spark, [True, False, None], S.number, "boolean") == [1.0, 0.0, None]


def test_labels(spark):
    assert values(spark, [0.0, -0.0, 1.5, 1e20, None], S.label, "double") == ["0", "0", "1.5", "1.0E20", None]
    assert values(spark, [True, False], S.label, "boolean") == ["True", "False"]
    assert values(spark, [3, None], S.label, "bigint") == ["3", None]


def test_sanitized_nested(spark):
    df = spark.sql(
        "SELECT double('NaN') AS a, array(double('Infinity'), 1D) AS b, map('k', double('NaN'), 'j', 2D) AS c, "
        "named_struct('x', double('-Infinity'), 'y', array(double('NaN'))) AS d, 1 AS e"
    )
    row = S.sanitized(df).first()
    assert row["a"] is None and row["b"] == [None, 1.0] and row["c"] == {"k": None, "j": 2.0}
    assert row["d"]["x"] is None and row["d"]["y"] == [None] and row["e"] == 1
    text = S.sanitized(df).select(F.to_json(F.struct("*"))).first()[0]
    assert "NaN" not in text and "Infinity" not in text


@pytest.mark.parametrize("majority,minority,text", [(3, 1, "1:3"), (5, 2, "1:2"), (7, 2, "1:4"), (1, 1, "1:1"), (1, 3, "1:1")])
def test_ratio_is_half_even(spark, majority, minority, text):
    assert spark.range(1).select(S.ratio_text(F.lit(majority), F.lit(minority))).first()[0] == text


def test_small_formulas(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(S.round_up_to_multiple(F.lit(n), F.lit(10))) for n in (0, 1, 10, 11)] == [10, 10, 10, 20]
    assert one(S.loss_ratio(F.lit(-3.0), F.lit(2.0))) == 1.5
    assert one(S.loss_ratio(F.lit(1.0), F.lit(0.0))) == 1e8
    assert one(S.epsilon_of(F.lit(0.0))) == 0.0
    assert one(S.epsilon_of(F.lit(1.0))) == 10.0
    assert one(S.clipped(F.lit(None).cast("double"), 0.0, 1.0)) is None


def test_integer_like(spark):
    agg = lambda xs, kind: spark.createDataFrame([(x,) for x in xs], f"v {kind}").agg(
        S.integer_like(F.col("v"), spark.createDataFrame([], f"v {kind}").schema["v"].dataType)
    ).first()[0]
    assert agg([1.0, 2.0, None], "double") and not agg([1.0, 2.5], "double")
    assert agg(["1", "2.0"], "string") and not agg(["1", "x"], "string")
    assert agg([], "double")
