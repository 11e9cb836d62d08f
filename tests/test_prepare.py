from statistics import NormalDist

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from semblance.operators import compare as C
from semblance.operators import learn as L
from semblance.operators import prepare as P
from semblance.operators import report as R
from semblance.operators import synth as Y
from semblance.operators.profile import TableSchema, profile


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(3000).selectExpr(
        "id", "cast(id * 7919 % 1000 AS double) / 10 AS x", "cast(id * 7919 % 1000 * 2 + id % 50 AS bigint) AS k",
        "CASE WHEN id % 11 = 0 THEN NULL WHEN id % 3 > 0 THEN 'hot' ELSE concat('c', id % 4) END AS c",
        "CASE WHEN id * 7919 % 1000 > 700 THEN 'yes' ELSE 'no' END AS y",
    )


SCHEMA = TableSchema(("x", "k"), ("c",), ("id",), "y")


def test_training_frame_rules(spark):
    schema = TableSchema(("x",), ("c",), ("id",), "y")
    df = spark.createDataFrame([(1, "1.5", "nan", "a"), (2, None, None, "b"), (3, "2.5", "u", " ")], "id int, x string, c string, y string")
    got = P.training_frame(df, schema)
    assert got.columns == ["x", "c", "y"]  # skipped columns are left out
    assert sorted(map(tuple, got.collect())) == [(1.5, "__missing__", "a"), (1.5, "__missing__", "b")]
    with pytest.raises(ValueError, match="non-numeric"):
        P.training_frame(df.withColumn("x", F.lit("z")), schema)
    with pytest.raises(ValueError, match="no usable"):
        P.training_frame(df.withColumn("y", F.lit(None).cast("string")), schema)


def test_encode_clips_and_drops_unseen(spark):
    fit = spark.createDataFrame([(0.0, "a"), (10.0, "b")], "x double, c string")
    enc = P.fit_encoder(fit, ["x"], ["c"])
    new = spark.createDataFrame([(5.0, "b"), (20.0, "z"), (None, None)], "x double, c string")
    assert [tuple(r) for r in P.encode(new, enc, ["c"]).collect()] == [(pytest.approx(0.5), 1), (1.0, None), (None, None)]
    back = P.decode(P.encode(fit, enc, ["c"]), enc, ["c"]).orderBy("x").collect()
    assert [(r["x"], r["c"]) for r in back] == [(pytest.approx(0.0), "a"), (pytest.approx(10.0), "b")]


def test_split_shares_and_reproducibility(rows):
    a = P.stratified_split(rows.repartition(5), "c", "id", 0.2)
    b = P.stratified_split(rows.repartition(2), "c", "id", 0.2)
    assert a.count() == 3000 and a.exceptAll(b).count() == 0
    for r in a.groupBy("c").agg(F.count("*").alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).collect():
        assert r["t"] == int(r["n"] * 0.2 + 0.5)


def test_one_hot_of_any_number_of_levels(spark, rows):
    few = P.one_hot(rows.select("id", "c"), ["c"])
    assert few.columns == ["id", "column", "token"] and few.count() == 3000
    assert {r["token"] for r in few.select("token").distinct().collect()} == {"hot", "c0", "c1", "c2", "c3", "__missing__"}
    many = P.one_hot(rows.selectExpr("id", "cast(id AS string) AS c", "c AS d"), ["c", "d"])
    assert many.columns == few.columns and many.schema == few.schema and many.where("column = 'c' AND token != cast(id AS string)").count() == 0
    assert many.groupBy("column").count().collect()[0]["count"] == 3000


def test_membership_does_not_depend_on_partitions(spark, rows):
    real, syn = rows.drop("id").where("k % 2 = 0"), rows.drop("id").where("k % 2 = 1")
    a = [L.membership_auc(real.repartition(n), syn.repartition(n), trees=5, depth=4) for n in (1, 7)]
    assert a[0] == pytest.approx(a[1], abs=1e-12)


def test_row_keys_follow_from_content(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, "a"), (1, "a")], "x int, y string")
    keys = [sorted(r["__row"] for r in L.with_row_key(df.repartition(n)).collect()) for n in (1, 4)]
    assert keys[0] == keys[1] and len(set(keys[0])) == 5


def test_conditional_sample_frequencies(rows):
    n = 20_000
    got = P.conditional_sample(rows, ["c", "y"], "id", n)
    assert got.count() == n and got.select("draw").distinct().count() == n
    joined = got.join(rows, "id")
    assert joined.where("(column = 'c' AND value != c) OR (column = 'y' AND value != y)").count() == 0
    share = {(r["column"], r["value"]): r["count"] / n for r in got.groupBy("column", "value").count().collect()}
    for r in P.condition_weights(rows, ["c", "y"]).collect():
        assert share[r["column"], r["value"]] == pytest.approx(r["weight"] / 2, abs=0.015)


def test_mode_encoding_can_be_undone(rows):
    df = rows.select("id", "x")
    modes = P.fit_modes(df, "x", modes=3)
    assert sum(w for w, _, _ in modes) == pytest.approx(1.0)
    got = P.mode_normalized(df, "x", modes).collect()
    inside = [r for r in got if abs(r["x_offset"]) < 1]
    assert len(inside) > 2500
    for r in inside[:200]:
        _, mean, std = modes[r["x_mode"] - 1]
        assert r["x_offset"] * 4 * std + mean == pytest.approx(r["x"])
    assert P.fit_modes(df.withColumn("x", F.lit(3.0)), "x") == [(1.0, 3.0, 1.0)]


def planted(spark, spec, seed=0):
    rnd = np.random.default_rng(seed)
    x = np.concatenate([rnd.normal(m, s, n) for m, s, n in spec])
    return x, spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, x double").repartition(4)


@pytest.mark.parametrize("spec", [[(0, 1, 3000), (10, 2, 3000)], [(i * 10, 1, 400 * (1 + i % 3)) for i in range(7)], [(5, 3, 4000)], [(0, 1, 3000), (4, 0.3, 1000)]])
def test_modes_are_as_many_as_planted(spark, spec):
    x, df = planted(spark, spec)
    found = P.fit_modes(df, "x")
    assert len(found) == len(spec) and sum(w for w, _, _ in found) == pytest.approx(1)
    for (w, m, s), (mean, std, n) in zip(found, spec):
        assert w == pytest.approx(n / len(x), abs=0.02) and m == pytest.approx(mean, abs=0.15 * std) and s == pytest.approx(std, rel=0.12)


def test_mixture_steps_as_plain_formulas():
    """The end is a fixed point of the update equations, written out here cell by cell."""
    rnd = np.random.default_rng(3)
    z = np.sort(np.concatenate([rnd.normal(-1, 0.2, 150), rnd.normal(1, 0.3, 150)]))
    one = np.ones(len(z))
    found = P.mixture(one, z, z * z, modes=4)
    kept = [m for m in found if m[0] > 0.01]
    assert len(kept) == 2
    density = [[w * math.exp(-((v - m) ** 2) / (2 * s * s)) / s for w, m, s in kept] for v in z]
    share = [[d / sum(row) for d in row] for row in density]
    for k, (w, m, s) in enumerate(kept):
        n = sum(r[k] for r in share)
        mean = sum(r[k] * v for r, v in zip(share, z)) / n
        assert (w, m) == (pytest.approx(n / len(z), abs=0.01), pytest.approx(mean, abs=0.01))
        assert s == pytest.approx(math.sqrt(sum(r[k] * (v - mean) ** 2 for r, v in zip(share, z)) / n), rel=0.05)


def test_modes_are_drawn_by_responsibility(spark):
    modes = [(0.75, 0.0, 1.0), (0.25, 0.0, 2.0)]
    df = spark.createDataFrame([(i, 1.5) for i in range(20_000)] + [(20_000, None)], "id long, x double")
    got = P.mode_normalized(df, "x", modes, F.col("id"))
    odds = [w / s * math.exp(-(1.5**2) / (2 * s * s)) for w, _, s in modes]
    assert got.where("x_mode = 1").count() / 20_000 == pytest.approx(odds[0] / sum(odds), abs=0.012)
    assert got.where("x IS NULL").first()["x_mode"] is None
    assert got.repartition(3).exceptAll(P.mode_normalized(df, "x", modes, F.col("id"))).count() == 0


def test_auc_with_ties(spark):
    pairs = [(0, 0.1), (0, 0.4), (1, 0.4), (1, 0.8), (0, 0.8), (1, 0.9)]
    df = spark.createDataFrame(pairs, "label int, score double")
    wins = [(p > n) + 0.5 * (p == n) for y, p in pairs if y for z, n in pairs if not z]
    assert L.auc(df).first()["auc"] == pytest.approx(np.mean(wins))
    assert L.auc(df.where("label = 1")).first()["auc"] is None


def test_classifier_learns(rows):
    _, metrics = L.train_real(rows, "y", "yes", "id", rounds=3)
    m = metrics.first()
    assert m["auc"] > 0.95 and m["tn"] + m["fp"] + m["fn"] + m["tp"] == 600
    _, mixed = L.train_mixed(rows, rows.withColumn("x", F.col("x") + 0.1), "y", "yes", "id", rounds=3)
    assert mixed.first()["auc"] > 0.9
    with pytest.raises(ValueError, match="not found in dataframe"):
        L.train_real(rows, "absent", "yes", "id")


def test_membership_attack(spark, rows):
    halves = rows.select("x", "c").where("id < 1500"), rows.select("x", "c").where("id >= 1500")
    assert L.membership_auc(*halves, trees=10, depth=5) == pytest.approx(0.5, abs=0.1)
    moved = halves[1].withColumn("x", F.col("x") + 500)
    assert L.membership_auc(halves[0], moved, trees=10, depth=5) > 0.99
    assert L.membership_auc(halves[0].limit(1), moved) == 0.5


def test_train_on_synthetic(rows):
    assert L.synthetic_to_real_f1(rows, rows, SCHEMA, rounds=3) > 0.9
    with pytest.raises(ValueError, match="two shared labels"):
        L.synthetic_to_real_f1(rows, rows.withColumn("y", F.lit("other")), SCHEMA)


def test_synthesiser(spark, rows, monkeypatch):
    model = Y.fit(rows, SCHEMA)
    assert model.columns == ["x", "k", "c", "y"] and np.linalg.eigvalsh(model.correlation).min() > 0
    a = Y.generate(spark, model, 4000, seed=1)
    assert a.repartition(3).exceptAll(Y.generate(spark, model, 4000, seed=1)).count() == 0
    assert a.exceptAll(Y.generate(spark, model, 4000, seed=2)).count() > 3000
    got = a.agg(F.min("x"), F.max("x"), F.avg("x"), F.corr("x", "k"), F.sum((F.col("k") != F.rint("k")).cast("int"))).first()
    want = rows.agg(F.min("x"), F.max("x"), F.avg("x"), F.corr("x", "k")).first()
    assert got[0] >= want[0] and got[1] <= want[1] and got[2] == pytest.approx(want[2], rel=0.05) and got[3] > 0.95 and got[4] == 0
    share = lambda df, n: {r["c"]: r["count"] / n for r in df.groupBy(F.coalesce("c", F.lit("__missing__")).alias("c")).count().collect()}
    real, syn = share(rows, 3000), share(a, 4000)
    assert real.keys() == syn.keys() and all(abs(real[c] - syn[c]) < 0.03 for c in real)
    monkeypatch.setattr(Y, "ROWS_TO_SEND", -1)  # joins by shuffle instead of broadcast
    joined = Y.generate(spark, model, 4000, seed=1)
    assert joined.count() == 4000 and joined.exceptAll(a).count() == 0


def test_normal_score(spark):
    ps = [1e-300, 1e-12, 1e-6, 0.001, 0.02425, 0.3, 0.5, 0.7, 0.97575, 0.999, 1 - 1e-9]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(Y.normal_score(F.col("p"))).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=2e-9, abs=2e-9)
    ends = spark.createDataFrame([(0.0,), (1.0,)], "p double").select(Y.normal_score(F.col("p"))).collect()
    assert [r[0] for r in ends] == [float("-inf"), float("inf")]


@pytest.mark.parametrize("hot", [0, 200_000])
def test_every_category_is_drawn(spark, hot):
    """Thousands of categories of equal share, with and without one that holds nearly all rows."""
    df = spark.range(3000 + hot).select(F.concat(F.lit("c"), F.least("id", F.lit(3000)).cast("string")).alias("c"), F.lit("y").alias("y"))
    drawn = Y.generate(spark, Y.fit(df, TableSchema((), ("c",), (), "y")), 100 * (3000 + hot) // (1 + hot // 20_000)).groupBy("c").count()
    n = {r["c"]: r["count"] for r in drawn.collect()}
    ends = [n[f"c{i}"] for i in range(3000)]
    assert len(n) == 3000 + (hot > 0) and min(ends) > 0 and max(ends) < 100 + 8 * 10
    assert sum(ends) == pytest.approx(300_000 / (1 + hot // 20_000), rel=0.02)


def test_conditional_generation(spark, rows):
    model = Y.fit(rows, SCHEMA)
    yes = Y.generate(spark, model, 2000, condition={"y": "yes"})
    assert yes.select("y").distinct().collect()[0][0] == "yes" and yes.count() == 2000
    no = Y.generate(spark, model, 2000, condition={"y": "no"})
    assert yes.agg(F.avg("x")).first()[0] > no.agg(F.avg("x")).first()[0] + 20
    fixed = Y.generate(spark, model, 500, condition={"x": 90.0})
    assert fixed.agg(F.min("x"), F.max("x")).first() == (90.0, 90.0) and fixed.agg(F.avg("k")).first()[0] > 1500
    with pytest.raises(ValueError, match="no category"):
        Y.generate(spark, model, 5, condition={"y": "maybe"})


def test_awkward_column_names(spark):
    df = spark.range(300).selectExpr("id", "cast(id % 50 AS double) AS `a.b`", "cast(id % 40 AS double) AS `c d`", "concat('v', id % 3) AS `e.f`", "concat('y', id % 2) AS `y.z`")
    schema = TableSchema.from_profile(profile(df.drop("id"), "y.z").collect())
    assert schema == TableSchema(("a.b", "c d"), ("e.f",), (), "y.z")
    made = Y.generate(spark, Y.fit(df, schema), 100)
    assert made.columns == ["a.b", "c d", "e.f", "y.z"] and made.count() == 100
    assert C.kl_divergence(df.drop("id"), made).count() == 4
    assert R.quality_report(df, made, schema).count() == 6
    assert L.train_real(df, "y.z", "y1", "id", rounds=1)[1].count() == 1


def test_split_ranks_the_rows_at_the_edge_only(spark, monkeypatch):
    """The rows of the smallest hashes, as many as the rounded share of each class asks; repeated and null keys and classes, very many classes."""
    rows = [(f"k{i % 900}" if i % 11 else None, [None, "a", "b", "lone"][0 if i % 5 == 0 else 1 + (i % 3 > 0)], i) for i in range(3000)] + [("x", "lone", -1)]
    df = spark.createDataFrame(rows, "key string, c string, i int").repartition(4)
    want = {c: int(sum(r[1] == c for r in rows) * 0.3 + 0.5) for c in {r[1] for r in rows}}
    for few, bits in ((10_000, 16), (10_000, 2), (0, 4)):
        monkeypatch.setattr(P, "FEW_CLASSES", few)
        out = P.stratified_split(df, "c", "key", chunk_bits=bits)
        assert out.columns == ["key", "c", "i", "is_test"]
        got = out.withColumn("h", F.xxhash64("key", F.lit(42))).collect()
        assert sorted(r.i for r in got) == sorted(r[2] for r in rows)
        for c, n in want.items():
            inside, outside = ([r.h for r in got if r.c == c and r.is_test == t] for t in (True, False))
            assert len(inside) == n and (not n or not outside or max(inside) <= min(outside))
    monkeypatch.undo()
    plan = P.stratified_split(df, "c", "key")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
