"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and the local benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("semblance")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset and the driver is the one executor (tests on one
    machine) a temporary folder takes its place.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("Set spark.checkpoint.dir to a folder all executors share.")
        folder = tempfile.mkdtemp(prefix="semblance-checkpoint-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialised(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder, which cuts its lineage; smaller than a checkpoint where values repeat."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application.

    Workers import the functions they run by name, wherever the driver was
    started, so the package must be on their path and not only on the driver's.
    """
    context = spark.sparkContext
    if getattr(context, "_semblance_shipped", False):
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="semblance-package-")
    context.addPyFile(shutil.make_archive(f"{folder}/semblance", "zip", here.parent, here.name))
    context._semblance_shipped = True
