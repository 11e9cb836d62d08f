"""Registry tables: upserts, patches, listings, look-ups, reports and deletes.

The registry is append-only; the current state is a query over the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semblance.functions.scalars import col, json_number, owner
from semblance.operators.order import numbered

HISTORY = "array<struct<epoch:int,generator_loss:double,discriminator_loss:double>>"


def latest(df: DataFrame, keys: list[str], newest: list[Column]) -> DataFrame:
    """One row per key, the first by ``newest``.

    The rank filter prunes each partition to one row per key before the
    shuffle, so a key with many rows costs no more than others.
    """
    w = Window.partitionBy(*keys).orderBy(*newest)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def upserted(log: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The registry's current rows: the highest version of each primary key."""
    return latest(log, keys, [F.desc(version)])


def patched(base: DataFrame, patches: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Apply (key, seq, field, value) patches: the last one wins, an explicit null included."""
    per_field = patches.groupBy(key, "field").agg(F.max_by("value", "seq").alias("value"))
    wide = per_field.groupBy(key).pivot("field", fields).agg(
        F.first("value").alias("value"), F.count(F.lit(1)).alias("seen")
    )
    joined = base.join(wide, key, "left")
    pick = lambda f: F.when(F.col(f"{f}_seen") > 0, F.col(f"{f}_value").try_cast(base.schema[f].dataType)).otherwise(col(f))
    return joined.select(*[(pick(f) if f in fields else col(f)).alias(f) for f in base.columns])


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    """The first rows in the order of the columns, nulls first; a table has no other first rows.

    Every task keeps its own first rows only, so no table is sorted.
    """
    return df.orderBy(*[col(c) for c in df.columns]).limit(rows)


def owned_by(df: DataFrame, user: str | int) -> DataFrame:
    """Rows of one user; anything else reads as absent."""
    return df.where(owner(col("user_id").cast("string"), col("metadata")) == F.lit(str(user)))


def newest_first(df: DataFrame, user_column: str, created: str, key: str) -> DataFrame:
    """Every user's rows with their ``position`` in the listing, newest first.

    Positions are counted by month, so a user with very many rows is spread over tasks.
    """
    month = F.lit(0) - (F.year(created) * 12 + F.month(created))
    return numbered(df, [user_column], [F.desc(created), F.asc(key)], month, "position")


# -- reports ----------------------------------------------------------------


def run_report(jobs: DataFrame) -> DataFrame:
    """Promote report scores and settings from JSON to columns."""
    integer = lambda c, name: json_number(c, name).cast("int")
    return jobs.select(
        "*",
        json_number(F.col("sdmetrics"), "quality_score").alias("sdmetrics_quality_score"),
        json_number(F.col("sdmetrics"), "diagnostic_score").alias("sdmetrics_diagnostic_score"),
        json_number(F.col("sdmetrics"), "ml_efficacy", "train_on_synthetic_test_on_real_f1").alias("sdmetrics_tstr_f1"),
        integer(F.col("config"), "embedding_dim").alias("embedding_dim"),
        json_number(F.col("config"), "generator_lr").alias("generator_lr"),
        json_number(F.col("config"), "discriminator_lr").alias("discriminator_lr"),
        integer(F.col("config"), "batch_size").alias("batch_size"),
    )


def model_report(models: DataFrame, jobs: DataFrame, generations: DataFrame, job_columns: list[str]) -> DataFrame:
    """Models with every job that points at them or produced them, and their completed generations.

    The OR condition would become a nested-loop join.  It is two equi joins
    whose matches cannot overlap: the second leaves out the first one's pairs.
    A model may have several rows; one without a job keeps a single row.
    """
    j = jobs.select(
        F.col("job_id").alias("__job"), F.col("model_id").alias("__model"), *[F.col(c) for c in job_columns]
    )
    m = models.select(F.col("id").alias("__id"), F.col("training_job_id").alias("__producer"))
    points = m.join(j, F.col("__model") == F.col("__id"))
    produced = m.join(
        j, (F.col("__job") == F.col("__producer")) & ~F.col("__model").eqNullSafe(F.col("__id"))
    )
    matches = points.unionByName(produced).drop("__producer", "__model")
    done = (
        generations.where(F.col("status") == "completed").groupBy(F.col("model_id").alias("__gm")).agg(F.count(F.lit(1)).alias("__n"))
    )
    return (
        models.join(matches, F.col("id") == F.col("__id"), "left")
        .join(done, F.col("id") == F.col("__gm"), "left")
        .select(
            *[col(c) for c in models.columns if c != "training_job_id"],
            F.coalesce("training_job_id", "__job").alias("training_job_id"),
            *[F.col(c) for c in job_columns],
            F.coalesce("__n", F.lit(0)).alias("synthetic_dataset_count"),
        )
    )


def dataset_summary(datasets: DataFrame, models: DataFrame, jobs: DataFrame, generations: DataFrame) -> DataFrame:
    """Each dataset with its model count and latest training and generation job.

    Set-based instead of several look-ups per dataset.  The models themselves
    stay in long form (``dataset_models``), as one dataset may have very many.
    """
    prefixed = lambda df, p, cols: df.select(F.col("dataset_id").alias(f"__{p}"), *[F.col(c).alias(f"{p}_{c}") for c in cols])
    counts = models.groupBy(F.col("dataset_id").alias("__m")).agg(
        F.count(F.lit(1)).alias("model_count"), F.max("created_at").alias("latest_model_at")
    )
    newest = lambda df: latest(df, ["dataset_id"], [F.desc("created_at"), F.asc("job_id")])
    job_cols = ["job_id", "status", "created_at"]
    training, generation = prefixed(newest(jobs), "training", job_cols), prefixed(newest(generations), "generation", job_cols)
    return (
        datasets.join(counts, F.col("id") == F.col("__m"), "left")
        .join(training, F.col("id") == F.col("__training"), "left")
        .join(generation, F.col("id") == F.col("__generation"), "left")
        .withColumn("model_count", F.coalesce("model_count", F.lit(0)))
        .withColumn("has_model", F.col("model_count") > 0)
        .drop("__m", "__training", "__generation")
    )


def dataset_models(datasets: DataFrame, models: DataFrame) -> DataFrame:
    """(dataset, model) rows of the listing, one per model."""
    d = datasets.select(F.col("id").alias("dataset_id"), "user_id")
    return models.join(d, "dataset_id").select("user_id", "dataset_id", F.col("id").alias("model_id"), "created_at")


def run_status(jobs: DataFrame, fields: list[tuple[str, str]], history: str | None = "loss_history") -> DataFrame:
    """Fixed status fields (absent ones null); the history keeps epoch and the two losses."""
    have = set(jobs.columns)
    cols = [(col(f) if f in have else F.lit(None).cast(t)).alias(f) for f, t in fields]
    if history and history in have:
        kept = F.transform(
            col(history),
            lambda x: F.struct(x["epoch"].alias("epoch"), x["generator_loss"].alias("generator_loss"), x["discriminator_loss"].alias("discriminator_loss")),
        )
        cols.append(F.coalesce(kept.cast(HISTORY), F.array().cast(HISTORY)).alias(history))
    return jobs.select(*cols)


# The status fields of training and generation jobs.
TRAINING_STATUS = [
    ("job_id", "string"), ("dataset_id", "string"), ("status", "string"), ("current_epoch", "int"),
    ("total_epochs", "int"), ("epochs_trained", "int"), ("early_stopped", "boolean"), ("convergence_epoch", "int"),
    ("training_time_seconds", "double"), ("avg_epoch_time_seconds", "double"), ("steps_per_epoch", "int"),
    ("final_loss", "double"), ("final_generator_loss", "double"), ("final_discriminator_loss", "double"),
    ("final_loss_ratio", "double"), ("final_mode_collapse_score", "double"), ("best_generator_loss", "double"),
    ("best_epoch", "int"), ("loss_stability_std", "double"), ("n_training_rows", "bigint"),
    ("avg_samples_per_second", "double"), ("sdmetrics", "string"), ("model_id", "string"), ("model_path", "string"),
    ("config", "string"), ("source", "string"), ("gpu", "string"), ("error", "string"),
    ("last_heartbeat", "timestamp_ntz"), ("modal_call_id", "string"),
]
GENERATION_STATUS = [
    ("job_id", "string"), ("dataset_id", "string"), ("model_id", "string"), ("status", "string"),
    ("n_samples", "bigint"), ("run_sdmetrics", "boolean"), ("synthetic_id", "string"), ("synthetic_path", "string"),
    ("preview", "string"), ("generation_time_seconds", "double"), ("error", "string"),
    ("last_heartbeat", "timestamp_ntz"), ("modal_call_id", "string"),
]


# -- look-ups ---------------------------------------------------------------


def lookup_jobs(requests: DataFrame, jobs: DataFrame, ref: str = "ref") -> DataFrame:
    """Per request the job with that id, else the newest job of the dataset with that id."""
    direct = jobs.select(F.col("job_id").alias("__ref"), F.col("job_id").alias("__direct"))
    newest = latest(jobs, ["dataset_id"], [F.desc("created_at"), F.asc("job_id")]).select(
        F.col("dataset_id").cast("string").alias("__ds"), F.col("job_id").alias("__newest")
    )
    return (
        requests.join(direct, col(ref) == F.col("__ref"), "left")
        .join(newest, col(ref) == F.col("__ds"), "left")
        .select(*[col(c) for c in requests.columns], F.coalesce("__direct", "__newest").alias("job_id"))
    )


def resolve_models(requests: DataFrame, models: DataFrame) -> DataFrame:
    """The given model of each request, else the dataset's newest, with a status.

    Status: ``ok``, ``not_found`` or ``wrong_dataset``.
    """
    given = models.select(F.col("id").alias("__id"), F.col("dataset_id").alias("__owner"))
    newest = latest(models, ["dataset_id"], [F.desc("created_at"), F.asc("id")]).select(
        F.col("dataset_id").alias("__ds"), F.col("id").alias("__newest")
    )
    asked = F.col("model_id").isNotNull()
    status = (
        F.when(asked & F.col("__id").isNull(), "not_found")
        .when(asked & (F.col("__owner") != F.col("dataset_id")), "wrong_dataset")
        .when(~asked & F.col("__newest").isNull(), "not_found")
        .otherwise("ok")
    )
    return (
        requests.join(given, F.col("model_id") == F.col("__id"), "left")
        .join(newest, F.col("dataset_id") == F.col("__ds"), "left")
        .withColumn("status", status)
        .withColumn("resolved", F.when(F.col("status") == "ok", F.when(asked, F.col("model_id")).otherwise(F.col("__newest"))))
        .select(*[col(c) for c in requests.columns], "status", F.col("resolved").alias("resolved_model_id"))
    )


# -- deletes ----------------------------------------------------------------


def cascade_delete(requests: DataFrame, tables: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Delete datasets with what hangs on them.

    ``requests`` holds (dataset_id, user_id).  Returns each request with
    ``deleted`` (false when the user owns no such dataset) and the remaining
    tables; a synthetic_id that pointed at a deleted dataset becomes null.
    """
    r = requests.select(F.col("dataset_id").alias("id"), "user_id")
    gone = tables["datasets"].join(r, ["id", "user_id"], "left_semi").select(F.col("id").alias("__gone"))
    left = {"datasets": tables["datasets"].join(gone, F.col("id") == F.col("__gone"), "left_anti")}
    for name in ("jobs", "models", "generations"):
        if name in tables:
            left[name] = tables[name].join(gone, F.col("dataset_id") == F.col("__gone"), "left_anti")
    if "generations" in left and "synthetic_id" in left["generations"].columns:
        g = left["generations"].join(gone, F.col("synthetic_id") == F.col("__gone"), "left")
        keep = F.when(F.col("__gone").isNull(), F.col("synthetic_id")).alias("synthetic_id")
        left["generations"] = g.select(*[keep if c == "synthetic_id" else col(c) for c in left["generations"].columns])
    owned = tables["datasets"].select(F.col("id").alias("__i"), F.col("user_id").alias("__u"))
    done = requests.join(owned, (F.col("dataset_id") == F.col("__i")) & (F.col("user_id") == F.col("__u")), "left").select(
        *[col(c) for c in requests.columns], F.col("__i").isNotNull().alias("deleted")
    )
    return done, left
