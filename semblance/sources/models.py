"""Stored generators: parameter tables in Parquet and a registry beside them."""

from __future__ import annotations

import json
from uuid import uuid4

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semblance.operators.profile import TableSchema
from semblance.operators.registry import latest
from semblance.operators.synth import Marginal, SynthModel

REGISTRY_SCHEMA = (
    "id string, dataset_id string, object_key string, training_job_id string, metadata string, config string, "
    "user_id string, created_at timestamp"
)


def write_model(model: SynthModel, path: str) -> None:
    spark = model.categories.sparkSession
    marginals = [(c, m.knots, m.is_integer) for c, m in model.numeric.items()]
    spark.createDataFrame(marginals, "column string, knots array<double>, is_integer boolean").coalesce(1).write.mode(
        "overwrite"
    ).parquet(f"{path}/marginals")
    model.categories.write.mode("overwrite").parquet(f"{path}/categories")
    cells = [
        (a, b, float(model.correlation[i, j])) for i, a in enumerate(model.columns) for j, b in enumerate(model.columns)
    ]
    spark.createDataFrame(cells, "column_a string, column_b string, r double").coalesce(1).write.mode("overwrite").parquet(
        f"{path}/correlation"
    )
    s = model.schema
    header = [(model.columns, list(s.numeric), list(s.categorical), list(s.skipped), s.target, model.rows)]
    spark.createDataFrame(
        header, "columns array<string>, numeric array<string>, categorical array<string>, skipped array<string>, target string, rows bigint"
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/header")


def read_model(spark: SparkSession, path: str) -> SynthModel:
    h = spark.read.parquet(f"{path}/header").first()
    schema = TableSchema(tuple(h["numeric"]), tuple(h["categorical"]), tuple(h["skipped"]), h["target"])
    at = {c: i for i, c in enumerate(h["columns"])}
    r = np.eye(len(at))
    for cell in spark.read.parquet(f"{path}/correlation").collect():  # columns x columns
        r[at[cell["column_a"]], at[cell["column_b"]]] = cell["r"]
    marginals = {m["column"]: Marginal(list(m["knots"]), m["is_integer"]) for m in spark.read.parquet(f"{path}/marginals").collect()}
    categories = spark.read.schema("column string, value string, lo double, hi double, z double").parquet(f"{path}/categories")
    return SynthModel(schema, list(h["columns"]), marginals, categories, r, h["rows"])


class ModelStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def registry(self) -> DataFrame:
        try:
            return self.spark.read.schema(REGISTRY_SCHEMA).parquet(f"{self.root}/models")
        except AnalysisException:
            return self.spark.createDataFrame([], REGISTRY_SCHEMA)

    def save(self, dataset_id: str, model: SynthModel, metadata: dict | None = None, config: dict | None = None) -> dict:
        metadata = metadata or {}
        model_id = str(uuid4())
        path = f"{self.root}/artifacts/{model_id}"
        write_model(model, path)
        record = (
            model_id, dataset_id, path, metadata.get("job_id"), json.dumps(metadata), json.dumps(config or {}), metadata.get("user_id"),
        )
        schema = REGISTRY_SCHEMA.rsplit(", created_at", 1)[0]
        row = self.spark.createDataFrame([record], schema).withColumn("created_at", F.current_timestamp())
        row.write.mode("append").parquet(f"{self.root}/models")
        return {"id": model_id, "dataset_id": dataset_id, "object_key": path}

    def by_id(self, model_id: str) -> dict | None:
        row = self.registry().where(F.col("id") == model_id).first()
        return row.asDict() if row else None

    def newest(self, dataset_id: str) -> dict | None:
        found = latest(
            self.registry().where(F.col("dataset_id") == dataset_id), ["dataset_id"], [F.desc("created_at"), F.asc("id")]
        ).first()
        return found.asDict() if found else None

    def load(self, model_id: str | None = None, dataset_id: str | None = None) -> tuple[dict, SynthModel]:
        """The given model, else the dataset's newest."""
        record = self.by_id(model_id) if model_id else self.newest(dataset_id)
        if record is None:
            what = f"Model '{model_id}'" if model_id else f"Model for dataset '{dataset_id}'"
            raise LookupError(f"{what} not found.")
        return record, read_model(self.spark, record["object_key"])
