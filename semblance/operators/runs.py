"""Run history: epoch records, rolling checks, early stop, summaries and job states.

Epochs of a run are consecutive from 1, so a long run can be cut into chunks
(``order.rolling``) and no run has to fit in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semblance.functions.scalars import elapsed_seconds, loss_ratio
from semblance.operators.order import rolling

# Fixed values.
COLLAPSE_WINDOW = 10
LEGAL_STEPS = [("queued", "running"), ("running", "completed"), ("running", "failed"), ("queued", "failed")]


def epoch_records(steps: DataFrame, rows: str = "n_rows") -> DataFrame:
    """One record per (job, epoch) from the step log: the last losses, ratio, time and speed.

    ``steps`` has job_id, epoch, step, generator_loss, discriminator_loss, ts and
    the number of training rows.
    """
    per = steps.groupBy("job_id", "epoch").agg(
        F.max_by("generator_loss", "step").alias("generator_loss"),
        F.max_by("discriminator_loss", "step").alias("discriminator_loss"),
        F.min("ts").alias("__from"), F.max("ts").alias("__to"), F.max(rows).alias("__rows"),
    )
    seconds = elapsed_seconds(F.col("__from"), F.col("__to"))
    return per.select(
        "job_id", "epoch", "generator_loss", "discriminator_loss",
        loss_ratio(F.col("generator_loss"), F.col("discriminator_loss")).alias("loss_ratio"),
        F.round(seconds, 3).alias("epoch_time_seconds"),
        F.round(F.col("__rows") / F.when(seconds > 0, seconds), 1).alias("samples_per_second"),
    )


def collapse_scores(history: DataFrame, width: int = COLLAPSE_WINDOW) -> DataFrame:
    """Adds ``mode_collapse_score``: population std of the last ten generator losses, from the tenth on."""
    out = rolling(
        history, ["job_id"], "epoch", width,
        {"__std": lambda w: F.stddev_pop("generator_loss").over(w), "__n": lambda w: F.count("generator_loss").over(w)},
    )
    score = F.when(F.col("__n") >= width, F.round("__std", 6))
    return out.withColumn("mode_collapse_score", score).drop("__std", "__n")


def convergence(history: DataFrame, patience: int = 20, min_delta: float = 0.001) -> DataFrame:
    """Adds ``converged``: the last ``patience`` generator losses span less than ``min_delta``."""
    out = rolling(
        history, ["job_id"], "epoch", patience,
        {
            "__span": lambda w: F.max("generator_loss").over(w) - F.min("generator_loss").over(w),
            "__n": lambda w: F.count("generator_loss").over(w),
        },
    )
    hit = (F.col("__n") >= patience) & (F.col("__span") < F.lit(min_delta))
    return out.withColumn("converged", F.coalesce(hit, F.lit(False))).drop("__span", "__n")


def early_stop(history: DataFrame, patience: int = 20, min_delta: float = 0.001) -> DataFrame:
    """Per run: first convergent epoch, epochs trained and whether it stopped early."""
    checked = convergence(history, patience, min_delta)
    return checked.groupBy("job_id").agg(
        F.min(F.when(F.col("converged"), F.col("epoch"))).alias("convergence_epoch"), F.max("epoch").alias("__epochs")
    ).select(
        "job_id", "convergence_epoch",
        F.coalesce("convergence_epoch", "__epochs").alias("epochs_trained"),
        F.col("convergence_epoch").isNotNull().alias("early_stopped"),
    )


def truncated(history: DataFrame, stops: DataFrame) -> DataFrame:
    """The history up to each run's last trained epoch."""
    return history.join(stops.select("job_id", "epochs_trained"), "job_id").where("epoch <= epochs_trained").drop("epochs_trained")


def run_summary(jobs: DataFrame, history: DataFrame) -> DataFrame:
    """Mean speed, final and best losses and loss spread of every run; defaults for an empty history.

    ``jobs`` has job_id, n_training_rows and batch_size.
    """
    per = history.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("epochs"),
        # decimal sums do not depend on the order of the rows
        F.avg(F.col("epoch_time_seconds").cast("decimal(18,3)")).alias("t"),
        F.avg(F.col("samples_per_second").cast("decimal(18,1)")).alias("s"),
        F.max_by("generator_loss", "epoch").alias("g"), F.max_by("discriminator_loss", "epoch").alias("d"),
        F.max_by("loss_ratio", "epoch").alias("r"), F.max_by("mode_collapse_score", "epoch").alias("m"),
        F.min("generator_loss").alias("b"), F.min_by("epoch", F.struct("generator_loss", "epoch")).alias("e"),
        F.stddev_pop("generator_loss").alias("sd"),
    )
    zero = lambda name, digits: F.round(F.coalesce(F.col(name), F.lit(0)), digits).cast("double")
    return jobs.join(per, "job_id", "left").select(
        "job_id",
        F.coalesce("epochs", F.lit(0)).alias("epochs"),
        zero("t", 3).alias("avg_epoch_time_seconds"), zero("s", 1).alias("avg_samples_per_second"),
        F.greatest(F.floor(F.col("n_training_rows") / F.col("batch_size")), F.lit(1)).alias("steps_per_epoch"),
        zero("g", 6).alias("final_generator_loss"), zero("d", 6).alias("final_discriminator_loss"),
        zero("r", 4).alias("final_loss_ratio"), F.coalesce("m", F.lit(-1.0)).alias("final_mode_collapse_score"),
        zero("b", 6).alias("best_generator_loss"), F.coalesce("e", F.lit(0)).alias("best_epoch"),
        zero("sd", 6).alias("loss_stability_std"),
    )


def progress(records: DataFrame) -> DataFrame:
    """Current epoch, last loss and heartbeat of each run, folded from the epoch records.

    The history stays in rows; nothing re-reads or rewrites it per epoch.  The
    same fold runs on a stream (``semblance.streaming``).
    """
    return records.groupBy("job_id").agg(
        F.max("epoch").alias("current_epoch"),
        F.max_by("generator_loss", "epoch").alias("final_loss"),
        F.max("ts").alias("last_heartbeat"),
        F.count(F.lit(1)).alias("records"),
    )


def job_states(events: DataFrame) -> DataFrame:
    """Per job the status of its last event, its error and the seconds between first and last event."""
    return events.groupBy("job_id").agg(
        F.max_by("status", "seq").alias("status"),
        F.max_by("error", "seq").alias("error"),
        elapsed_seconds(F.min("ts"), F.max("ts")).alias("elapsed_seconds"),
    )


def illegal_steps(events: DataFrame) -> DataFrame:
    """Events whose status may not follow the one before; ``seq`` counts from 1 per job."""
    seen = rolling(events, ["job_id"], "seq", 2, {"previous": lambda w: F.first("status").over(w)})
    allowed = F.concat_ws(">", "previous", "status").isin(*[f"{a}>{b}" for a, b in LEGAL_STEPS])
    return seen.where((F.col("seq") > 1) & ~allowed).select("job_id", "seq", "previous", "status")


def durations(jobs: DataFrame, start: str, end: str) -> DataFrame:
    return jobs.withColumn("elapsed_seconds", elapsed_seconds(F.col(start), F.col(end)))
