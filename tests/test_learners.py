"""The registered learners on whole tables: rows with nulls and the status label, and what must hold of their metrics."""

import pytest
from compare import connect
from pyspark.sql import functions as F

from catalog import prepare_checks as checks
from catalog.base import Tables, with_views
from semblance.operators import learn as L
from semblance.operators.profile import TableSchema

FOLDER = "/root/testdata/sf0.001"
METRICS = {"tn", "fp", "fn", "tp", "f1", "recall_minority", "accuracy", "auc"}
WHOLE = {
    "gbt_real": (checks.gbt_real, checks.HELD_OUT.format(t="order_rows")),
    "gbt_mixed": (checks.gbt_mixed, checks.HELD_OUT.format(t=checks.BOTH_ORDERS)),
}


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, FOLDER)


@pytest.mark.parametrize("name", WHOLE)
def test_metrics_of_all_rows(tables, name):
    query, sizes = WHOLE[name]
    m = query(tables, rounds=2).first().asDict()
    assert set(m) == METRICS
    negative, positive = connect(FOLDER).execute(with_views(sizes, ("order_rows", "order_syn"))).fetchone()
    assert (m["tn"] + m["fp"], m["fn"] + m["tp"]) == (negative, positive)
    assert m["accuracy"] == pytest.approx((m["tn"] + m["tp"]) / (negative + positive)) and 0 <= m["auc"] <= 1


def test_mixed_split_holds_both_tables_and_nulls(tables):
    frame = L.mixed_parts(tables("order_rows"), tables("order_syn"), "status", "F", "id")[0]
    n = {r[0]: r[1] for r in frame.groupBy(F.substring("id", 1, 1)).count().collect()}
    assert n == {"r": tables("orders").count(), "s": tables("orders").count()}
    # Nulls stay nulls: the learner picks their side of each split.
    gaps = tables("order_rows").where("total IS NULL").select(F.concat(F.lit("r:"), F.col("id").cast("string")).alias("id"))
    assert gaps.count() > 0 and frame.join(gaps, "id").count() == gaps.count()
    assert frame.join(gaps, "id").where("n1 IS NOT NULL").count() == 0 and frame.where("n1 IS NULL").count() == gaps.count()


def test_learners_tell_what_can_be_told(tables):
    """A label that follows from a feature is learned; a table beside itself tells nothing, a shifted one with its nulls does."""
    rows = tables("order_rows").selectExpr("*", "CASE WHEN total > 150000 THEN 'y' ELSE 'n' END AS dear").drop("status")
    assert L.train_real(rows.where("total IS NOT NULL"), "dear", "y", "id", rounds=3)[1].first()["auc"] > 0.99
    real = tables("order_rows").drop("id")
    assert L.membership_auc(real, real) <= 0.6
    assert L.membership_auc(real, real.withColumn("total", F.col("total") + 1e6)) > 0.9
    schema = TableSchema(("cust", "total"), ("priority",), ("id",), "dear")
    told = rows.where("total IS NOT NULL")
    assert L.synthetic_to_real_f1(told, told, schema, rounds=5) > 0.95
