import json

import pytest
from pyspark.sql import functions as F

from semblance.operators import registry as G
from semblance.operators import runs as H
from semblance.operators.validate import TableError
from semblance.plans import jobs as J
from semblance.sources.csv import scan_csv
from semblance.sources.datasets import DatasetStore
from semblance.sources.models import ModelStore
from semblance.streaming.progress import current, follow, read_records


def write(folder, text, name="data.csv"):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_types_and_tokens(spark, tmp_path):
    path = write(tmp_path, 'a,b,c,d,e,f\n1,1.5,True, x ,NA,"q,1"\n2,NA,false,null,,"say ""hi"""\n3,2e1,TRUE, ,nan,z\n')
    df = scan_csv(spark, path)
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "boolean", "d": "string", "e": "string", "f": "string"}
    assert [tuple(r) for r in df.orderBy("a").collect()] == [
        (1, 1.5, True, "x", None, "q,1"), (2, None, False, None, None, 'say "hi"'), (3, 20.0, True, None, None, "z"),
    ]


def test_csv_short_and_long_rows(spark, tmp_path):
    short = scan_csv(spark, write(tmp_path, "a,b\n1,2\n3\n", "short.csv"))
    assert sorted(map(tuple, short.collect()), key=str) == [(1, 2), (3, None)]
    with pytest.raises(TableError, match="corrupted"):
        scan_csv(spark, write(tmp_path, "a,b\n1,2\n3,4,5\n", "long.csv"))


def test_csv_rejects(spark, tmp_path):
    for text in ("", "a,b\n"):
        with pytest.raises(TableError):
            scan_csv(spark, write(tmp_path, text))
    with pytest.raises(TableError, match="CSV format"):
        scan_csv(spark, write(tmp_path, "a,b\n1,2\n", "data.txt"))


def test_ingest_golden(spark, tmp_path):
    store = DatasetStore(spark, str(tmp_path / "store"))
    path = write(tmp_path, "amount,merchant,fraud\n10.5,A,0\n12.0,B,0\n13.5,A,0\n99.9,C,1\n", "transactions.csv")
    record = J.ingest_csv(spark, store, path, "fraud", "user-1")
    assert (record["n_rows"], record["n_features"], record["class_dist"]) == (4, 2, {"0": 3, "1": 1})
    assert json.loads(record["metadata"])["class_imbalance"]["class_ratio"] == "1:3"
    kept, df = store.get(record["id"])
    assert kept["user_id"] == "user-1" and df.count() == 4 and store.get("absent") is None
    with pytest.raises(TableError, match="'fraud' not found. Available columns: amount"):
        J.ingest_csv(spark, store, write(tmp_path, "amount\n1\n2\n", "no_target.csv"), "fraud")


def test_train_generate_flow(spark, tmp_path):
    datasets, models = DatasetStore(spark, str(tmp_path / "d")), ModelStore(spark, str(tmp_path / "m"))
    df = spark.range(200).selectExpr("id % 37 * 1.5 AS x", "concat('c', id % 3) AS c", "CASE WHEN id % 4 = 0 THEN 'y' ELSE 'n' END AS y")
    source = J.ingest_table(datasets, df, "t", "y", "u")
    with pytest.raises(LookupError, match="Model for dataset"):
        J.generate_dataset(datasets, models, source["id"], 10)
    J.train(datasets, models, source["id"])
    newest = J.train(datasets, models, source["id"], job_id="j2")
    result = J.generate_dataset(datasets, models, source["id"], 50, job_id="g1")
    assert result["n_samples"] == 50 and len(result["preview"]) == 5 and result["generation_time_seconds"] > 0
    record = datasets.record(result["synthetic_id"])
    lineage = json.loads(record["metadata"])
    assert record["dataset_type"] == "synthetic" and record["user_id"] == "u"
    assert (lineage["source_dataset_id"], lineage["source_model_id"], lineage["generation_job_id"]) == (source["id"], newest["id"], "g1")
    with pytest.raises(LookupError, match="not found"):
        J.generate_dataset(datasets, models, source["id"], 10, model_id="nope")
    other = J.ingest_table(datasets, df, "t2", "y")
    with pytest.raises(LookupError, match="does not belong"):
        J.generate_dataset(datasets, models, other["id"], 10, model_id=newest["id"])


def test_newest_job_wins(spark):
    jobs = spark.createDataFrame([("old", "d1", 1), ("new", "d1", 2), ("d1x", "d2", 3)], "job_id string, dataset_id string, created_at int")
    asked = spark.createDataFrame([("old",), ("d1",), ("none",)], "ref string")
    assert {r["ref"]: r["job_id"] for r in G.lookup_jobs(asked, jobs).collect()} == {"old": "old", "d1": "new", "none": None}


def test_patch_keeps_explicit_null(spark):
    base = spark.createDataFrame([("a", 1.0, "x"), ("b", 2.0, "y")], "job_id string, loss double, status string")
    patches = spark.createDataFrame(
        [("a", 1, "loss", "5.5"), ("a", 2, "loss", None), ("a", 3, "status", "done")], "job_id string, seq int, field string, value string"
    )
    got = G.patched(base, patches, "job_id", ["loss", "status"]).orderBy("job_id").collect()
    assert [tuple(r) for r in got] == [("a", None, "done"), ("b", 2.0, "y")]


def test_model_report_keeps_multiplicity(spark):
    models = spark.createDataFrame([("m1", "j1"), ("m2", None), ("m3", "j9")], "id string, training_job_id string")
    jobs = spark.createDataFrame([("j1", "m1", "ok"), ("j2", "m1", "retrain"), ("j3", None, "x")], "job_id string, model_id string, status string")
    gens = spark.createDataFrame([("m1", "completed"), ("m1", "failed"), ("m2", "completed")], "model_id string, status string")
    rows = sorted(tuple(r) for r in G.model_report(models, jobs, gens, ["status"]).select("id", "training_job_id", F.coalesce("status", F.lit("-")), "synthetic_dataset_count").fillna("-").collect())
    assert rows == [("m1", "j1", "ok", 1), ("m1", "j1", "retrain", 1), ("m2", "-", "-", 1), ("m3", "j9", "-", 0)]


def test_summary_defaults_for_empty_history(spark):
    jobs = spark.createDataFrame([("a", 1000, 256)], "job_id string, n_training_rows int, batch_size int")
    history = spark.createDataFrame(
        [], "job_id string, epoch int, generator_loss double, discriminator_loss double, loss_ratio double, epoch_time_seconds double, "
        "samples_per_second double, mode_collapse_score double"
    )
    r = H.run_summary(jobs, history).first()
    assert r["final_mode_collapse_score"] == -1 and r["best_epoch"] == 0 and r["loss_stability_std"] == 0 and r["steps_per_epoch"] == 3


def test_progress_stream_equals_batch(spark, tmp_path):
    rows = spark.range(60).selectExpr(
        "concat('j', id % 3) AS job_id", "cast(id / 3 + 1 AS int) AS epoch", "id * 0.5D AS generator_loss", "1.0D AS discriminator_loss",
        "timestamp_seconds(1700000000 + id) AS ts",
    )
    folder = str(tmp_path / "records")
    rows.where("epoch <= 10").write.parquet(folder)
    out = str(tmp_path / "progress")
    query = follow(read_records(spark, folder), out, str(tmp_path / "state"))
    try:
        query.processAllAvailable()
        rows.where("epoch > 10 AND job_id != 'j0'").write.mode("append").parquet(folder)
        query.processAllAvailable()
        now = current(spark, out)
        assert now.count() == 3 and now.exceptAll(H.progress(rows.where("epoch <= 10 OR job_id != 'j0'"))).count() == 0
        # only the changed runs are written again
        assert spark.read.parquet(out).groupBy("job_id").count().where("count = 1").select("job_id").collect()[0][0] == "j0"
    finally:
        query.stop()
