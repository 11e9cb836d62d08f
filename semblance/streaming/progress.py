"""Follow the epoch records of running jobs as they are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from semblance.operators.registry import latest
from semblance.operators.runs import progress

RECORD_SCHEMA = "job_id string, epoch int, generator_loss double, discriminator_loss double, ts timestamp"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Epoch records as a stream of Parquet files."""
    return spark.readStream.schema(RECORD_SCHEMA).parquet(path)


def follow(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the state of the runs that changed, batch after batch, under ``path``.

    A batch that is run again replaces its own files.  Both folders must be shared by all executors; nothing is kept on
    the driver.
    """

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return progress(records).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """Each run's newest state."""
    return latest(spark.read.parquet(path), ["job_id"], [F.desc("batch")]).drop("batch")
