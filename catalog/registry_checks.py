"""Registry tables, look-ups, reports and run history."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Tables, check, r, rounded
from semblance.operators import registry as G
from semblance.operators import runs as H
from semblance.operators import validate as V
from semblance.operators.order import numbered


# -- upserts and patches -------------------------------------------------------

UPSERT = "SELECT o_custkey AS id, o_orderkey AS version, o_orderstatus AS status, o_totalprice AS n_rows FROM {orders}"


@check(
    "upsert_latest",
    f"""SELECT id, version, status, n_rows FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS k
        FROM ({UPSERT.replace('{orders}', 'orders')})) WHERE k = 1""",
)
def upsert_latest(t: Tables):
    return G.upserted(t.spark.sql(UPSERT, orders=t("orders")), ["id"], "version")


FIELDS = ("click", "error", "purchase", "signup", "view")
PATCHES = "SELECT user_id AS job_id, event_id AS seq, event_type AS field, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(value AS VARCHAR(20)) END AS value FROM {events}"


@check(
    "patch_fold",
    f"""WITH p AS ({PATCHES.replace('{events}', 'events')}),
      l AS (SELECT job_id, field, arg_max_null(value, seq) AS value, count(*) AS n FROM p GROUP BY job_id, field),
      b AS (SELECT c_custkey AS job_id, c_acctbal AS base FROM customer)
      SELECT b.job_id, {', '.join(f"CASE WHEN max(n) FILTER (field = '{f}') > 0 THEN CAST(max(value) FILTER (field = '{f}') AS DOUBLE) ELSE base END AS {f}" for f in FIELDS)}
      FROM b LEFT JOIN l ON b.job_id = l.job_id GROUP BY b.job_id, base""",
)
def patch_fold(t: Tables):
    base = t("customer").select(F.col("c_custkey").alias("job_id"), *[F.col("c_acctbal").alias(f) for f in FIELDS])
    return G.patched(base, t.spark.sql(PATCHES, events=t("events")), "job_id", list(FIELDS))


@check(
    "latest_per_key",
    """SELECT dataset_id, job_id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY created_at DESC, job_id) AS k FROM reg_jobs)
       WHERE k = 1""",
    ("reg_jobs",),
)
def latest_per_key(t: Tables):
    return G.latest(t("reg_jobs"), ["dataset_id"], [F.desc("created_at"), F.asc("job_id")]).select("dataset_id", "job_id", "created_at")


# -- listings and reports ------------------------------------------------------


@check(
    "list_newest",
    "SELECT id, dataset_id, created_at, row_number() OVER (PARTITION BY dataset_id ORDER BY created_at DESC, id) AS position FROM reg_models",
    ("reg_models",),
)
def list_newest(t: Tables):
    return G.newest_first(t("reg_models"), "dataset_id", "created_at", "id").select("id", "dataset_id", "created_at", "position")


@check("preview_rows", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def preview_rows(t: Tables):
    return G.preview(t("orders").select("o_orderkey", "o_custkey", "o_totalprice"))


OWNED = """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_nationkey AS VARCHAR(10)) END AS user_id,
    CASE WHEN c_custkey % 3 < 2 THEN concat('{"user_id": "', c_nationkey, '"}') ELSE '{}' END AS metadata, c_name AS filename FROM """


@check("owner_filter", f"SELECT id, filename FROM ({OWNED} customer) WHERE coalesce(user_id, json_extract_string(metadata, '$.user_id')) = '7'")
def owner_filter(t: Tables):
    t("customer").createOrReplaceTempView("semblance_customer")
    return G.owned_by(t.spark.sql(OWNED + " semblance_customer"), 7).select("id", "filename")


RUN_JSON = """SELECT o_orderkey AS job_id, concat('{"quality_score": ', o_totalprice / 1000000, ', "diagnostic_score": 0.5, "ml_efficacy": {"train_on_synthetic_test_on_real_f1": ',
    o_custkey / 2000, '}}') AS sdmetrics, concat('{"embedding_dim": ', o_custkey, ', "generator_lr": 0.25, "batch_size": ', o_orderkey, '}') AS config FROM """


@check(
    "run_report",
    f"""SELECT job_id, round(CAST(json_extract_string(sdmetrics, '$.quality_score') AS DOUBLE), 6) AS sdmetrics_quality_score,
        CAST(json_extract_string(sdmetrics, '$.diagnostic_score') AS DOUBLE) AS sdmetrics_diagnostic_score,
        round(CAST(json_extract_string(sdmetrics, '$.ml_efficacy.train_on_synthetic_test_on_real_f1') AS DOUBLE), 6) AS sdmetrics_tstr_f1,
        CAST(json_extract_string(config, '$.embedding_dim') AS INTEGER) AS embedding_dim, CAST(json_extract_string(config, '$.generator_lr') AS DOUBLE) AS generator_lr,
        CAST(json_extract_string(config, '$.discriminator_lr') AS DOUBLE) AS discriminator_lr, CAST(json_extract_string(config, '$.batch_size') AS INTEGER) AS batch_size
        FROM ({RUN_JSON} orders)""",
)
def run_report(t: Tables):
    t("orders").createOrReplaceTempView("semblance_orders")
    out = G.run_report(t.spark.sql(RUN_JSON + " semblance_orders")).drop("sdmetrics", "config")
    return rounded(out, sdmetrics_quality_score=6, sdmetrics_tstr_f1=6)


@check(
    "model_report",
    """SELECT tm.id, tm.dataset_id, tm.created_at, coalesce(tm.training_job_id, tj.job_id) AS training_job_id, tj.status, tj.final_loss,
        (SELECT count(*) FROM line_generations gj WHERE gj.model_id = tm.id AND gj.status = 'completed') AS synthetic_dataset_count
       FROM reg_models tm LEFT JOIN reg_jobs tj ON tj.model_id = tm.id OR tj.job_id = tm.training_job_id""",
    ("reg_models", "reg_jobs", "line_generations"),
)
def model_report(t: Tables):
    return G.model_report(t("reg_models"), t("reg_jobs"), t("line_generations"), ["status", "final_loss"])


@check(
    "dataset_summary",
    """WITH m AS (SELECT dataset_id, count(*) AS n, max(created_at) AS at FROM reg_models GROUP BY dataset_id),
       j AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY created_at DESC, job_id) AS k FROM reg_jobs),
       g AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY created_at DESC, job_id) AS k FROM reg_generations)
       SELECT d.*, coalesce(m.n, 0) AS model_count, coalesce(m.n, 0) > 0 AS has_model, m.at AS latest_model_at,
         j.job_id AS training_job_id, j.status AS training_status, j.created_at AS training_created_at,
         g.job_id AS generation_job_id, g.status AS generation_status, g.created_at AS generation_created_at
       FROM reg_datasets d LEFT JOIN m ON m.dataset_id = d.id LEFT JOIN (SELECT * FROM j WHERE k = 1) j ON j.dataset_id = d.id
       LEFT JOIN (SELECT * FROM g WHERE k = 1) g ON g.dataset_id = d.id""",
    ("reg_datasets", "reg_models", "reg_jobs", "reg_generations"),
)
def dataset_summary(t: Tables):
    return G.dataset_summary(t("reg_datasets"), t("reg_models"), t("reg_jobs"), t("reg_generations"))


@check(
    "dataset_models",
    "SELECT d.user_id, d.id AS dataset_id, m.id AS model_id, m.created_at FROM reg_datasets d JOIN reg_models m ON m.dataset_id = d.id",
    ("reg_datasets", "reg_models"),
)
def dataset_models(t: Tables):
    return G.dataset_models(t("reg_datasets"), t("reg_models"))


# -- look-ups, references, deletes ----------------------------------------------


@check(
    "job_lookup",
    """WITH q AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN concat('j', l_orderkey) ELSE CAST(l_suppkey AS VARCHAR) END AS ref FROM lineitem),
       n AS (SELECT CAST(dataset_id AS VARCHAR) AS ref, job_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY created_at DESC, job_id) AS k FROM reg_jobs) WHERE k = 1)
       SELECT q.ref, coalesce(d.job_id, n.job_id) AS job_id, count(*) AS requests FROM q LEFT JOIN reg_jobs d ON d.job_id = q.ref LEFT JOIN n ON n.ref = q.ref GROUP BY ALL""",
    ("reg_jobs",),
)
def job_lookup(t: Tables):
    asked = t("lineitem").selectExpr("CASE WHEN l_linenumber % 2 = 0 THEN concat('j', l_orderkey) ELSE cast(l_suppkey AS string) END AS ref")
    return G.lookup_jobs(asked, t("reg_jobs")).groupBy("ref", "job_id").agg(F.count(F.lit(1)).alias("requests"))


@check(
    "resolve_model",
    """WITH q AS (SELECT o_orderkey AS request, o_custkey + (o_orderkey % 2) AS dataset_id, CASE o_orderkey % 3 WHEN 1 THEN concat('m', o_orderkey) WHEN 2 THEN concat(CASE o_orderstatus WHEN 'F' THEN 'm' ELSE 'gone' END, o_orderkey) END AS model_id FROM orders),
       n AS (SELECT dataset_id, id FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY created_at DESC, id) AS k FROM reg_models) WHERE k = 1),
       s AS (SELECT q.*, CASE WHEN q.model_id IS NOT NULL AND m.id IS NULL THEN 'not_found' WHEN q.model_id IS NOT NULL AND m.dataset_id <> q.dataset_id THEN 'wrong_dataset'
         WHEN q.model_id IS NULL AND n.id IS NULL THEN 'not_found' ELSE 'ok' END AS status, coalesce(q.model_id, n.id) AS pick
         FROM q LEFT JOIN reg_models m ON m.id = q.model_id LEFT JOIN n ON n.dataset_id = q.dataset_id)
       SELECT request, dataset_id, model_id, status, CASE WHEN status = 'ok' THEN pick END AS resolved_model_id FROM s""",
    ("reg_models",),
)
def resolve_model(t: Tables):
    asked = t("orders").selectExpr(
        "o_orderkey AS request", "o_custkey + (o_orderkey % 2) AS dataset_id", "CASE o_orderkey % 3 WHEN 1 THEN concat('m', o_orderkey) WHEN 2 THEN concat(CASE o_orderstatus WHEN 'F' THEN 'm' ELSE 'gone' END, o_orderkey) END AS model_id"
    )
    return G.resolve_models(asked, t("reg_models"))


@check(
    "wrong_dataset",
    """SELECT request, dataset_id, model_id, m.dataset_id AS model_dataset_id FROM
       (SELECT o_orderkey AS request, o_custkey + (o_orderkey % 2) AS dataset_id, concat('m', o_orderkey) AS model_id FROM orders) q JOIN
       (SELECT id, dataset_id FROM reg_models) m ON m.id = q.model_id WHERE m.dataset_id <> q.dataset_id""".replace(
        "SELECT request, dataset_id, model_id", "SELECT request, q.dataset_id, model_id"
    ),
    ("reg_models",),
)
def wrong_dataset(t: Tables):
    asked = t("orders").selectExpr("o_orderkey AS request", "o_custkey + (o_orderkey % 2) AS dataset_id", "concat('m', o_orderkey) AS model_id")
    return V.wrong_dataset(asked, t("reg_models"))


@check(
    "orphan_jobs",
    "SELECT job_id, synthetic_id FROM reg_generations WHERE synthetic_id IS NOT NULL AND synthetic_id NOT IN (SELECT id FROM reg_datasets)",
    ("reg_generations", "reg_datasets"),
)
def orphan_jobs(t: Tables):
    return V.orphans(t("reg_generations"), "synthetic_id", t("reg_datasets"), "id").select("job_id", "synthetic_id")


@check(
    "cascade_delete",
    """WITH q AS (SELECT s_suppkey AS dataset_id, s_nationkey AS user_id FROM supplier),
       gone AS (SELECT d.id FROM reg_datasets d JOIN q ON q.dataset_id = d.id AND q.user_id = d.user_id),
       g AS (SELECT job_id, CASE WHEN synthetic_id IN (SELECT id FROM gone) THEN NULL ELSE synthetic_id END AS synthetic_id FROM reg_generations WHERE dataset_id NOT IN (SELECT id FROM gone))
       SELECT 'datasets' AS kind, CAST(id AS VARCHAR) AS id, CAST(NULL AS BIGINT) AS synthetic_id FROM reg_datasets WHERE id NOT IN (SELECT id FROM gone)
       UNION ALL SELECT 'jobs', job_id, NULL FROM reg_jobs WHERE dataset_id NOT IN (SELECT id FROM gone)
       UNION ALL SELECT 'models', id, NULL FROM reg_models WHERE dataset_id NOT IN (SELECT id FROM gone)
       UNION ALL SELECT 'generations', job_id, synthetic_id FROM g
       UNION ALL SELECT CASE WHEN dataset_id IN (SELECT id FROM gone) THEN 'deleted' ELSE 'refused' END, CAST(dataset_id AS VARCHAR), NULL FROM q""",
    ("reg_datasets", "reg_jobs", "reg_models", "reg_generations"),
)
def cascade_delete(t: Tables):
    asked = t("supplier").select(F.col("s_suppkey").alias("dataset_id"), F.col("s_nationkey").alias("user_id"))
    done, left = G.cascade_delete(
        asked, {"datasets": t("reg_datasets"), "jobs": t("reg_jobs"), "models": t("reg_models"), "generations": t("reg_generations")}
    )
    none = F.lit(None).cast("bigint")
    pick = lambda df, kind, key, syn=none: df.select(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.col(key).cast("string").alias("id"), syn.cast("bigint").alias("synthetic_id")
    )
    return (
        pick(left["datasets"], "datasets", "id").unionByName(pick(left["jobs"], "jobs", "job_id")).unionByName(pick(left["models"], "models", "id"))
        .unionByName(pick(left["generations"], "generations", "job_id", F.col("synthetic_id")))
        .unionByName(pick(done, F.when(F.col("deleted"), "deleted").otherwise("refused"), "dataset_id"))
    )


@check(
    "run_status",
    """SELECT job_id, CAST(dataset_id AS VARCHAR) AS dataset_id, status, model_id, round(final_loss, 2) AS final_loss, CAST(NULL AS VARCHAR) AS error,
       CAST(1 AS BIGINT) AS epochs, final_loss AS last_loss FROM reg_jobs""",
    ("reg_jobs",),
)
def run_status(t: Tables):
    jobs = t("reg_jobs").withColumn(
        "loss_history",
        F.array(F.struct(F.lit(1).alias("epoch"), F.col("final_loss").alias("generator_loss"), F.lit(0.5).alias("discriminator_loss"), F.lit(2.0).alias("loss_ratio"))),
    )
    out = G.run_status(jobs, G.TRAINING_STATUS)
    return out.select(
        "job_id", F.col("dataset_id").cast("string").alias("dataset_id"), "status", "model_id", r(F.col("final_loss"), 2).alias("final_loss"), "error",
        F.size("loss_history").cast("bigint").alias("epochs"), F.col("loss_history")[0]["generator_loss"].alias("last_loss"),
    )


# -- run history -----------------------------------------------------------------


def run_log(t: Tables):
    """One record per event, numbered within its run; the day spreads a long run over tasks."""
    log = t("events").selectExpr(
        "user_id AS job_id", "value AS generator_loss", "value*0.5e0-1e0 AS discriminator_loss", "ts", "event_type", "props", "event_id"
    )
    return numbered(log, ["job_id"], [F.col("ts"), F.col("event_id")], F.to_date("ts"), "epoch")


@check(
    "rolling_std",
    """SELECT job_id, epoch, CASE WHEN count(*) OVER w >= 10 THEN round(stddev_pop(generator_loss) OVER w, 6) END AS mode_collapse_score
       FROM run_log WINDOW w AS (PARTITION BY job_id ORDER BY epoch ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
    ("run_log",),
)
def rolling_std(t: Tables):
    return H.collapse_scores(run_log(t)).select("job_id", "epoch", "mode_collapse_score")


CONVERGED = """k AS (SELECT job_id, epoch, count(*) OVER w >= 5 AND max(generator_loss) OVER w - min(generator_loss) OVER w < 10 AS converged
    FROM run_log WINDOW w AS (PARTITION BY job_id ORDER BY epoch ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""


@check("convergence", f"WITH {CONVERGED} SELECT job_id, epoch, converged FROM k", ("run_log",))
def convergence(t: Tables):
    return H.convergence(run_log(t), 5, 10.0).select("job_id", "epoch", "converged")


@check(
    "early_stop",
    f"""WITH {CONVERGED}, s AS (SELECT job_id, min(epoch) FILTER (converged) AS convergence_epoch, max(epoch) AS n FROM k GROUP BY job_id)
        SELECT s.job_id, convergence_epoch, coalesce(convergence_epoch, n) AS epochs_trained, convergence_epoch IS NOT NULL AS early_stopped,
          (SELECT count(*) FROM run_log r WHERE r.job_id = s.job_id AND r.epoch <= coalesce(convergence_epoch, n)) AS kept FROM s""",
    ("run_log",),
)
def early_stop(t: Tables):
    log = run_log(t)
    stops = H.early_stop(log, 5, 10.0)
    kept = H.truncated(log, stops).groupBy("job_id").agg(F.count(F.lit(1)).alias("kept"))
    return stops.join(kept, "job_id")


EPOCHS = """e AS (SELECT job_id, epoch, arg_max(generator_loss, step) AS generator_loss, arg_max(discriminator_loss, step) AS discriminator_loss,
      (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds, max(n_rows) AS n_rows FROM step_log GROUP BY job_id, epoch),
  rec AS (SELECT job_id, epoch, generator_loss, discriminator_loss, round(abs(generator_loss) / (abs(discriminator_loss) + 1e-8), 4) AS loss_ratio,
      round(seconds, 3) AS epoch_time_seconds, CASE WHEN seconds > 0 THEN round(n_rows / seconds, 1) END AS samples_per_second FROM e)"""


@check("epoch_telemetry", f"WITH {EPOCHS} SELECT * FROM rec", ("step_log",))
def epoch_telemetry(t: Tables):
    return H.epoch_records(t("step_log"))


@check(
    "run_summary",
    f"""WITH {EPOCHS}, per AS (SELECT job_id, count(*) AS n, CAST(sum(CAST(round(epoch_time_seconds * 1000) AS BIGINT)) AS BIGINT) AS t, CAST(sum(CAST(round(samples_per_second * 10) AS BIGINT)) AS BIGINT) AS s, count(samples_per_second) AS m, arg_max(generator_loss, epoch) AS g,
          arg_max(discriminator_loss, epoch) AS d, arg_max(loss_ratio, epoch) AS r, min(generator_loss) AS b,
          first(epoch ORDER BY generator_loss, epoch) AS be, stddev_pop(generator_loss) AS sd FROM rec GROUP BY job_id)
        SELECT c_custkey AS job_id, coalesce(n, 0) AS epochs, coalesce((2 * t + n) // (2 * n), 0) / 1000 AS avg_epoch_time_seconds, coalesce((2 * s + m) // (2 * m), 0) / 10 AS avg_samples_per_second,
          CAST(greatest(floor(5000 / 256), 1) AS BIGINT) AS steps_per_epoch, round(coalesce(g, 0), 6) AS final_generator_loss,
          round(coalesce(d, 0), 6) AS final_discriminator_loss, round(coalesce(r, 0), 4) AS final_loss_ratio, -1e0 AS final_mode_collapse_score,
          round(coalesce(b, 0), 6) AS best_generator_loss, coalesce(be, 0) AS best_epoch, round(coalesce(sd, 0), 6) AS loss_stability_std
        FROM customer LEFT JOIN per ON per.job_id = c_custkey""",
    ("step_log",),
)
def run_summary(t: Tables):
    records = H.epoch_records(t("step_log")).withColumn("mode_collapse_score", F.lit(None).cast("double"))
    jobs = t("customer").select(F.col("c_custkey").alias("job_id"), F.lit(5000).alias("n_training_rows"), F.lit(256).alias("batch_size"))
    return H.run_summary(jobs, records).withColumn("steps_per_epoch", F.col("steps_per_epoch").cast("bigint"))


@check(
    "progress_fold",
    """SELECT job_id, max(epoch) AS current_epoch, arg_max(generator_loss, epoch) AS final_loss, max(ts) AS last_heartbeat, count(*) AS records
       FROM run_log GROUP BY job_id""",
    ("run_log",),
)
def progress_fold(t: Tables):
    return H.progress(run_log(t))


STATES = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'failed' END"


@check(
    "job_state",
    f"""WITH e AS (SELECT job_id, epoch AS seq, {STATES} AS status, CASE WHEN event_type = 'error' THEN props END AS error, ts FROM run_log),
      l AS (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY seq) AS previous FROM e),
      bad AS (SELECT job_id, count(*) FILTER (seq > 1 AND concat(previous, '>', status) NOT IN ('queued>running', 'running>completed', 'running>failed', 'queued>failed')) AS illegal FROM l GROUP BY job_id)
      SELECT e.job_id, arg_max(status, seq) AS status, arg_max_null(error, seq) AS error, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS elapsed_seconds, max(illegal) AS illegal
      FROM e JOIN bad ON bad.job_id = e.job_id GROUP BY e.job_id""",
    ("run_log",),
)
def job_state(t: Tables):
    events = run_log(t).selectExpr(
        "job_id", "epoch AS seq", f"{STATES} AS status", "CASE WHEN event_type = 'error' THEN props END AS error", "ts"
    )
    bad = H.illegal_steps(events).groupBy("job_id").agg(F.count(F.lit(1)).alias("illegal"))
    out = H.job_states(events).join(bad, "job_id", "left").fillna(0, ["illegal"])
    return rounded(out, elapsed_seconds=3)


@check(
    "run_durations",
    "SELECT l_orderkey, l_linenumber, round((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1e6, 3) AS elapsed_seconds FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
def run_durations(t: Tables):
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rounded(H.durations(joined, "o_orderdate", "l_shipdate").select("l_orderkey", "l_linenumber", "elapsed_seconds"), elapsed_seconds=3)
