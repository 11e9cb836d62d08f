"""Ingest, train and generate jobs."""

from __future__ import annotations

import json
from time import perf_counter
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from semblance.functions.scalars import normalized
from semblance.operators.profile import TableSchema, class_imbalance, profile
from semblance.operators.registry import preview
from semblance.operators.synth import SynthModel, fit, generate
from semblance.operators.validate import TableError, validate_target
from semblance.sources.csv import scan_csv
from semblance.sources.datasets import DatasetStore
from semblance.sources.models import ModelStore

PREVIEW_ROWS = 5


def register(
    store: DatasetStore, df: DataFrame, filename: str, target: str, user_id: str | None = None,
    dataset_type: str = "real", extra: dict | None = None,
) -> dict:
    """Profile a table and store it with its class counts and imbalance."""
    dataset_id = str(uuid4())
    # Written first: a scan or a generator runs once, and the profile's passes read the stored columns.
    path, stored = store.write(dataset_id, df, dataset_type)
    imbalance = class_imbalance(stored, target).first()
    metadata = {
        "filename": filename, "target": target, "dataset_type": dataset_type,
        "class_imbalance": imbalance.asDict() if imbalance else None, **({"user_id": user_id} if user_id else {}), **(extra or {}),
    }
    return store.register(dataset_id, path, stored, profile(stored, target), metadata)


def ingest_csv(spark: SparkSession, store: DatasetStore, path: str, target: str, user_id: str | None = None) -> dict:
    """Scan, check the label column, profile, store."""
    df = scan_csv(spark, path)
    validate_target(df, target)
    return register(store, df, path.rsplit("/", 1)[-1], target, user_id)


def ingest_table(store: DatasetStore, df: DataFrame, name: str, target: str, user_id: str | None = None) -> dict:
    df = normalized(df)
    validate_target(df, target)
    return register(store, df, name, target, user_id)


def stored_schema(record: dict) -> TableSchema:
    return TableSchema.from_profile([{"type": None, **c} for c in json.loads(record["schema"])["columns"]])


def resolved_target(record: dict) -> str:
    """The stored target, else the profile's, else the metadata's."""
    profile_target = (json.loads(record.get("schema") or "{}").get("target") or {}).get("name")
    target = record.get("target") or profile_target or json.loads(record.get("metadata") or "{}").get("target")
    if not target:
        raise TableError(f"Dataset '{record['id']}' does not have a target column configured.")
    return target


def train(datasets: DatasetStore, models: ModelStore, dataset_id: str, job_id: str | None = None) -> dict:
    """Fit a generator to a stored dataset and store it."""
    found = datasets.get(dataset_id)
    if found is None:
        raise LookupError(f"Dataset '{dataset_id}' not found.")
    record, df = found
    model: SynthModel = fit(df, stored_schema(record))
    return models.save(dataset_id, model, {"job_id": job_id, "user_id": record["user_id"]}, {"method": "gaussian_copula"})


def generate_dataset(
    datasets: DatasetStore, models: ModelStore, dataset_id: str, n: int, model_id: str | None = None,
    job_id: str | None = None, seed: int = 42, condition: dict | None = None,
) -> dict:
    """Draw n rows from the given or newest model and register them with their lineage."""
    start = perf_counter()
    model_record, model = models.load(model_id, dataset_id)
    if model_record["dataset_id"] != dataset_id:
        raise LookupError(f"Model '{model_id}' does not belong to dataset '{dataset_id}'.")
    source = datasets.record(dataset_id)
    if source is None:
        raise LookupError(f"Dataset '{dataset_id}' not found.")
    rows = generate(datasets.spark, model, n, seed, condition)
    record = register(
        datasets, rows, f"synthetic_{dataset_id}.csv", resolved_target(source), source["user_id"], "synthetic",
        {"source_dataset_id": dataset_id, "source_model_id": model_record["id"], "generation_job_id": job_id},
    )
    stored = datasets.spark.read.parquet(record["object_key"])
    return {
        "synthetic_id": record["id"], "synthetic_path": record["object_key"], "n_samples": record["n_rows"],
        "preview": [r.asDict() for r in preview(stored, PREVIEW_ROWS).collect()],
        "generation_time_seconds": perf_counter() - start,
    }
