"""Scans, stores and whole jobs, on data written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import ORDER_SCHEMA, Tables, check, rounded
from catalog.prepare_checks import inside, kept_inside
from semblance.operators import synth as Y
from semblance.operators.profile import profile
from semblance.plans import jobs as J
from semblance.sources.csv import scan_csv
from semblance.sources.datasets import DatasetStore
from semblance.sources.models import ModelStore, read_model, write_model


@check(
    "scan_csv",
    """SELECT id, CAST(cust AS BIGINT) AS cust, round(total, 2) AS total, CASE WHEN priority <> 'nan' THEN priority END AS priority, status FROM order_rows""",
    ("order_rows",),
)
def scan(t: Tables):
    """Written as CSV text, read back with inferred types; null-like texts become null."""
    path = t.scratch()
    t("order_rows").write.option("header", True).csv(path)
    return rounded(scan_csv(t.spark, path), total=2)


@check("scan_text_csv", "SELECT doc_id, md5(text) AS digest, lang, source, n_chars FROM documents")
def scan_text(t: Tables):
    """Texts with line breaks, quotes and commas, as CSV and back."""
    path = t.scratch()
    t("documents").write.option("header", True).option("escape", '"').csv(path)
    return scan_csv(t.spark, path).select("doc_id", F.md5("text").alias("digest"), "lang", "source", "n_chars")


@check("scan_csv_endings", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def scan_csv_endings(t: Tables):
    """Only files that end in .csv are read; the same rows as text files beside them are not."""
    path, df = t.scratch(), t("customer").select("c_custkey", "c_name", "c_nationkey")
    df.write.option("header", True).csv(path)
    df.select(F.concat_ws(",", *df.columns).alias("value")).write.mode("append").text(path)
    return scan_csv(t.spark, path)


@check("sink_roundtrip", "SELECT id, cust, round(total, 2) AS total, priority, status, (SELECT count(*) FROM order_rows) AS n_rows FROM order_rows", ("order_rows",))
def sink_roundtrip(t: Tables):
    store, df = DatasetStore(t.spark, t.scratch()), t("order_rows")
    store.save("orders", df, profile(df, "status"), {"target": "status", "filename": "orders.csv", "user_id": "u1"})
    record, back = store.get("orders")
    return rounded(back.withColumn("n_rows", F.lit(record["n_rows"]).cast("bigint")), total=2)


@check("model_roundtrip", "SELECT 0 AS differences")
def model_roundtrip(t: Tables):
    """A stored and reloaded model draws the same rows."""
    df, path = t("order_rows"), t.scratch()
    model = Y.fit(df, ORDER_SCHEMA)
    write_model(model, path)
    n = df.count()
    return Y.generate(t.spark, read_model(t.spark, path), n).exceptAll(Y.generate(t.spark, model, n)).agg(F.count(F.lit(1)).alias("differences"))


@check(
    "ingest_job",
    "WITH d AS (" + " UNION ALL ".join(f"SELECT count(DISTINCT {c}) AS d, count({c}) AS p FROM order_rows" for c in ("id", "cust", "total", "priority"))
    + """) SELECT status AS label, count(*) AS n, (SELECT count(*) FROM order_rows) AS n_rows,
       CAST((SELECT count(*) FROM d WHERE NOT (d / p >= 0.95 AND d > 50)) AS INTEGER) AS n_features FROM order_rows GROUP BY status""",
    ("order_rows",),
)
def ingest_job(t: Tables):
    root = t.scratch()
    t("order_rows").write.option("header", True).csv(f"{root}/orders_csv")
    record = J.ingest_csv(t.spark, DatasetStore(t.spark, root), f"{root}/orders_csv", "status", "u1")
    rows = [(label, n, record["n_rows"], record["n_features"]) for label, n in record["class_dist"].items()]
    return t.spark.createDataFrame(rows, "label string, n bigint, n_rows bigint, n_features int")


@check("generation_job", inside("cust", "priority", "status"), ("order_rows",))
def generation_job(t: Tables):
    """Ingest, train, generate and read back: as many rows as there were, all inside the real ones; the profile skips ``total`` as a key."""
    root = t.scratch()
    datasets, models = DatasetStore(t.spark, f"{root}/datasets"), ModelStore(t.spark, f"{root}/models")
    record = J.ingest_table(datasets, t("order_rows"), "orders", "status", "u1")
    J.train(datasets, models, record["id"])
    result = J.generate_dataset(datasets, models, record["id"], record["n_rows"])
    return kept_inside(t, datasets.get(result["synthetic_id"])[1], {})
