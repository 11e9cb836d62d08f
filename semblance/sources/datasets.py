"""Stored datasets: rows by type and id, and an append-only registry beside them."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semblance.functions.scalars import normalized, sanitized
from semblance.operators.profile import class_distribution
from semblance.operators.registry import upserted

REGISTRY_SCHEMA = (
    "id string, filename string, dataset_type string, object_key string, target string, n_rows bigint, "
    "n_features int, class_dist map<string,bigint>, schema string, metadata string, user_id string, "
    "created_at timestamp, version bigint"
)

MAX_CLASSES = 1_000  # classes of a stored label column; validated ones have far fewer


class DatasetStore:
    """Datasets under one folder: ``data/dataset_type=…/id=…`` and ``registry``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(REGISTRY_SCHEMA).parquet(f"{self.root}/registry")
        except AnalysisException:
            return self.spark.createDataFrame([], REGISTRY_SCHEMA)

    def registry(self) -> DataFrame:
        return upserted(self._log(), ["id"], "version")

    def write(self, dataset_id: str, df: DataFrame, kind: str = "real") -> tuple[str, DataFrame]:
        """Write the rows and read them back, so that whatever follows starts from the stored table."""
        path = f"{self.root}/data/dataset_type={kind}/id={dataset_id}"
        df.write.mode("overwrite").parquet(path)
        return path, self.spark.read.parquet(path)

    def save(self, dataset_id: str, df: DataFrame, profile: DataFrame, metadata: dict) -> dict:
        """Write the rows, then register them."""
        path, stored = self.write(dataset_id, df, metadata.get("dataset_type", "real"))
        return self.register(dataset_id, path, stored, profile, metadata)

    def register(self, dataset_id: str, path: str, stored: DataFrame, profile: DataFrame, metadata: dict) -> dict:
        """Register written rows; the label column must be a validated one, of few classes."""
        kind, target = metadata.get("dataset_type", "real"), metadata.get("target")
        rows = profile.collect()  # one row per column
        features = [r["column"] for r in rows if r["role"] == "feature"]
        found = class_distribution(stored, target).limit(MAX_CLASSES + 1).collect() if target else []
        if len(found) > MAX_CLASSES:
            raise ValueError(f"Target '{target}' has more than {MAX_CLASSES} classes.")
        classes = {r["label"]: r["count"] for r in found}
        columns = sanitized(profile).select(F.to_json(F.struct("*")).alias("j")).collect()
        schema = json.dumps({"columns": [json.loads(r["j"]) for r in columns], "target": {"name": target} if target else None})
        record = {
            "id": dataset_id, "filename": metadata.get("filename"), "dataset_type": kind, "object_key": path,
            "target": target, "n_rows": stored.count(), "n_features": len(features), "class_dist": classes,
            "schema": schema, "metadata": json.dumps(metadata), "user_id": metadata.get("user_id"),
        }
        self._append(record)
        return record

    def _append(self, record: dict) -> None:
        names = [f.split(" ")[0] for f in REGISTRY_SCHEMA.split(", ")][:-2]
        schema = REGISTRY_SCHEMA.rsplit(", created_at", 1)[0]
        version = self._log().where(F.col("id") == record["id"]).agg(F.max("version")).first()[0]
        row = self.spark.createDataFrame([tuple(record[n] for n in names)], schema)
        row.withColumn("created_at", F.current_timestamp()).withColumn(
            "version", F.lit((version or 0) + 1).cast("bigint")
        ).write.mode("append").parquet(f"{self.root}/registry")

    def record(self, dataset_id: str) -> dict | None:
        row = self.registry().where(F.col("id") == dataset_id).first()
        return row.asDict() if row else None

    def get(self, dataset_id: str) -> tuple[dict, DataFrame] | None:
        """The registry record and the normalised rows, or None."""
        record = self.record(dataset_id)
        if record is None:
            return None
        return record, normalized(self.spark.read.parquet(record["object_key"]))

    def listed(self, user_id: str | None = None) -> DataFrame:
        """Current records, newest first, those of one user where one is given."""
        current = self.registry() if user_id is None else self.registry().where(F.col("user_id") == user_id)
        return current.orderBy(F.desc("created_at"), "id")
