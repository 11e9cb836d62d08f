import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from semblance.operators import compare as C
from semblance.operators import neighbors as N
from semblance.operators import privacy as V
from semblance.operators import report as R
from semblance.operators.profile import TableSchema
from semblance.plans.evaluate import evaluate

SCHEMA = TableSchema(("amount", "score"), ("merchant",), (), "fraud")


def scores(df, key="column"):
    return {r[0]: r[1] for r in df.collect()}


def test_golden_quality(pair):
    real, syn = pair
    kl = scores(C.kl_divergence(real, syn))
    assert kl["amount"] == 0 and kl["fraud"] == pytest.approx(0, abs=1e-9)
    assert kl["score"] == pytest.approx(5.122207, abs=1e-6) and kl["merchant"] == pytest.approx(0.462098, abs=1e-6)
    p = C.numeric_pair(real, syn)
    assert p.columns == ["amount", "score"]
    assert scores(C.wasserstein_by_column(p)) == pytest.approx({"amount": 0.0, "score": 0.127778}, abs=1e-6)
    assert C.wasserstein(p)[1] == pytest.approx(0.063889, abs=1e-6)
    assert C.correlation_difference(p) == pytest.approx({"max_diff": 0.0, "mean_diff": 0.0, "std_diff": 0.0}, abs=1e-12)
    assert C.pca_variance_retained(p) == pytest.approx(1.0)


def test_golden_privacy(pair):
    real, syn = pair
    tv = scores(V.budget_divergences(real, syn))
    assert tv == pytest.approx({"amount": 0, "score": 0.75, "merchant": 1 / 3, "fraud": 0}, abs=1e-6)
    assert V.budget_estimate(real, syn).first()["epsilon"] == pytest.approx(0.555526, abs=1e-6)
    found = V.k_anonymity_numeric(C.numeric_pair(real, syn))
    assert found["threshold"] == pytest.approx(0.091667, abs=1e-6) and found["k"] == 1


def test_identical_tables(pair):
    real, _ = pair
    p = C.numeric_pair(real, real)
    assert all(abs(v) < 1e-9 for v in scores(C.kl_divergence(real, real)).values())
    assert C.wasserstein(p)[1] == 0 and V.budget_estimate(real, real).first()["epsilon"] == pytest.approx(0, abs=1e-9)
    assert all(v == 1 for v in scores(R.ks_complement(p)).values())
    assert all(r["score"] == 1 for r in R.quality_report(real, real, SCHEMA).collect())
    assert C.category_difference(real, real, ["merchant"]).count() == 0


def test_result_ignores_partitioning(pair):
    real, syn = pair
    a = R.score_table(real.repartition(1), syn.repartition(3), SCHEMA)
    b = R.score_table(real.repartition(5), syn.repartition(2), SCHEMA)
    assert a.exceptAll(b).count() == 0


def test_tv_is_symmetric(pair):
    real, syn = pair
    one, two = (scores(R.tv_complement(a, b, ["merchant", "fraud"])) for a, b in ((real, syn), (syn, real)))
    assert one == two


def test_constant_on_one_side(spark):
    real = spark.range(50).selectExpr("5.0D AS a", "id * 1.0D AS b")
    syn = spark.range(50).selectExpr("id % 7 * 1.0D AS a", "id * 1.0D AS b")
    assert C.correlation_difference(C.numeric_pair(real, syn))["max_diff"] == pytest.approx(1.0)  # the diagonal


def test_no_shared_column(spark):
    real, syn = spark.range(5).selectExpr("id AS a"), spark.range(5).selectExpr("id AS b")
    p = C.numeric_pair(real, syn)
    assert p.columns == [] and C.wasserstein(p)[1] == 0 and C.pca_variance_retained(p) == 0
    assert V.k_anonymity(real, syn) == 0 and V.budget_estimate(real, syn).first()["epsilon"] == 0
    assert C.kl_divergence(real, syn).count() == 0


def test_empty_and_nonfinite_sides(spark):
    real = spark.createDataFrame([(1.0, "a"), (math.inf, "b"), (math.nan, None)], "x double, t string")
    syn = spark.createDataFrame([(None, None), (None, None)], "x double, t string")
    assert scores(C.kl_divergence(real, syn)) == {"x": 0.0, "t": 0.0}
    assert V.budget_divergences(real, syn).count() == 0
    full = spark.createDataFrame([(3.0, "a")], "x double, t string")
    assert C.joint_bounds(real, full, ["x"]) == {"x": (1.0, 3.0)}


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = np.round(rng.normal(size=400), 1), np.round(rng.normal(1, 2, size=300), 1)
    frame = lambda x: spark.createDataFrame([(float(v),) for v in x], "x double")
    bounds = C.joint_bounds(frame(a), frame(b), ["x"])
    edges = np.histogram_bin_edges(np.concatenate([a, b]), bins=10)
    rows = C.histogram_pair(frame(a), frame(b), bounds, 10).orderBy("bin").collect()
    assert [r["n_real"] for r in rows] == list(np.histogram(a, edges)[0])
    assert [r["n_synthetic"] for r in rows] == list(np.histogram(b, edges)[0])


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 2))
    make = lambda e: np.column_stack([base[:, 0], base[:, 0] + e * base[:, 1], rng.normal(size=300), base[:, 1] * 3])
    a, b = make(0.1), make(0.5)
    frame = lambda m: spark.createDataFrame([tuple(map(float, r)) for r in m], "a double, b double, c double, d double")
    za, zb = (a - a.mean(0)) / a.std(0), (b - a.mean(0)) / a.std(0)
    values, vectors = np.linalg.eigh(np.cov(za.T))
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = int(np.searchsorted(np.cumsum(values) / values.sum(), 0.95) + 1)
    want = np.var(zb @ vectors[:, :keep], axis=0).sum() / np.var(zb, axis=0).sum()
    assert C.pca_variance_retained(C.numeric_pair(frame(a), frame(b))) == pytest.approx(want)


@pytest.mark.parametrize("dims,hot", [(1, False), (2, True), (4, False)])
def test_neighbors_against_brute_force(spark, monkeypatch, dims, hot):
    """Many small boxes and groups, and a third of the points on one spot."""
    for name, value in (("BOX_POINTS", 16), ("GROUP_POINTS", 8), ("BLOCK", 5)):
        monkeypatch.setattr(N, name, value)
    rng = np.random.default_rng(dims)
    real, syn = rng.uniform(size=(400, dims)), rng.uniform(size=(150, dims))
    if hot:
        real[:130], syn[:50] = 0.5, 0.5
        real[130:260] = 0.5 + rng.uniform(size=(130, dims)) * 1e-3
    names = [f"x{k}" for k in range(dims)]
    frame = lambda m: N.merged_points(spark.createDataFrame([tuple(map(float, r)) for r in m], ", ".join(f"{n} double" for n in names)), names)
    d = np.sqrt(((syn[:, None, :] - real[None, :, :]) ** 2).sum(-1))
    placed, boxes = N.build_boxes(frame(real))
    assert boxes.weight.sum() == 400 and len(boxes.low) > 4
    near = {tuple(r["p"]): r["distance"] for r in N.nearest_distances(frame(syn), placed, boxes).collect()}
    assert len(near) == len({tuple(s) for s in syn})
    for s, row in zip(syn, d):
        assert near[tuple(s)] == pytest.approx(row.min(), abs=1e-12)
    for radius in (0.0, 0.01, 0.2, 5.0):
        got = {tuple(r["p"]): r["n"] for r in N.counts_within(frame(syn), placed, boxes, radius).collect()}
        for s, row in zip(syn, d):
            assert got[tuple(s)] == (row <= radius).sum()


def test_k_falls_back_to_categories(spark):
    real = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", None), ("b", "x")], "c string, d string")
    syn = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", None), ("z", "x")], "c string, d string")
    counts = {r["key"]: (r["weight"], r["n"]) for r in V.category_key_counts(real, syn).collect()}
    assert counts == {"a\x1fx": (2, 2), "a\x1f__missing__": (1, 1), "z\x1fx": (1, 0)}
    assert V.k_anonymity(real, syn) == 1  # median of 2, 2, 1, 0 is 1.5


def test_evaluate(pair):
    rows = {(r["metric"], r["item"]): r["value"] for r in evaluate(*pair, SCHEMA, learned=False).collect()}
    assert rows["kl_divergence", "merchant"] == pytest.approx(0.462098, abs=1e-6)
    assert rows["k_anonymity", None] == 1 and 0 <= rows["pca_variance_retained", None] <= 1
    assert 0 <= rows["quality.score", "overall"] <= 1 and rows["diagnostic.score", "Data Structure"] == 1


def test_pieces_of_a_box_change_no_distance_and_no_count():
    """Points on a grid, so that many lie just at the radius; a constant side, a lone point, pieces wholly inside and outside."""
    rng = np.random.default_rng(3)
    grid = np.unique(np.column_stack([rng.integers(0, 9, (900, 3)) / 8, np.zeros(900)]), axis=0)
    asked = np.column_stack([rng.integers(-2, 12, (700, 3)) / 8, rng.integers(0, 2, 700)]).astype(float)
    for other in (grid, grid[:1]):
        pieces = N._pieces(other)
        assert sorted(np.concatenate(pieces.rows)) == list(range(len(other))) and max(map(len, pieces.rows)) <= N.PIECE_POINTS
        total = np.zeros((len(asked), len(other)))
        for k in range(4):
            total += (asked[:, k : k + 1] - other[:, k]) ** 2
        weight = rng.integers(1, 5, len(other))
        v, b = pd.DataFrame({"p": list(asked)}), pd.DataFrame({"p": list(other), "weight": weight})
        assert (N._nearest_in_group(v, b)["distance"].to_numpy() == np.sqrt(total).min(axis=1)).all()
        for radius in (0.0, 0.125, 0.25, 1.0, 3.0):
            assert (N._count_in_group(v, b, radius)["n"].to_numpy() == (np.sqrt(total) <= radius) @ weight).all()
