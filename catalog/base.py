"""Tables, derived views and the register of queries and oracles.

A view's text runs in both engines.  Views keep every row of their base table;
the modulo arithmetic only decides where a null or another value is put, as the
base tables hold none.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semblance.operators.profile import TableSchema
from semblance.session import shared_folder

VIEWS = {
    "pair_real": """
        SELECT CASE WHEN (l_orderkey*7+l_linenumber) % 17 = 0 THEN NULL ELSE l_quantity END AS quantity,
               l_extendedprice AS price, l_discount AS discount, 5e0 AS konst,
               CAST(l_linenumber AS VARCHAR(10)) AS num_text,
               CASE WHEN (l_orderkey+l_linenumber) % 19 = 0 THEN NULL ELSE l_returnflag END AS flag,
               l_linestatus AS status
        FROM lineitem""",
    "pair_syn": """
        SELECT CASE WHEN (l_orderkey*5+l_linenumber) % 13 = 0 THEN NULL ELSE l_quantity*1.1e0+1e0 END AS quantity,
               l_extendedprice*0.9e0 AS price,
               CASE WHEN l_linenumber % 3 = 0 THEN l_tax ELSE l_discount END AS discount,
               5e0+(l_linenumber % 3) AS konst,
               CAST(l_linenumber+1 AS VARCHAR(10)) AS num_text,
               CASE WHEN (l_orderkey+l_linenumber) % 23 = 0 THEN NULL WHEN l_linenumber = 7 THEN 'Z' ELSE l_returnflag END AS flag,
               CASE WHEN l_suppkey % 5 = 0 THEN 'F' ELSE l_linestatus END AS status
        FROM lineitem""",
    "order_rows": """
        SELECT o_orderkey AS id, o_custkey AS cust,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS total,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN 'nan' ELSE o_orderpriority END AS priority,
               o_orderstatus AS status
        FROM orders""",
    "order_syn": """
        SELECT o_orderkey AS id, o_custkey + 3 AS cust, o_totalprice*0.9e0 + 1000e0 AS total,
               CASE WHEN o_custkey % 7 = 0 THEN '9-NEW' ELSE o_orderpriority END AS priority,
               CASE WHEN o_custkey % 4 = 0 THEN 'F' ELSE o_orderstatus END AS status
        FROM orders""",
    "reg_datasets": """
        SELECT c_custkey AS id, c_nationkey AS user_id, c_mktsegment AS filename,
               CASE WHEN c_custkey % 4 = 0 THEN 'synthetic' ELSE 'real' END AS dataset_type FROM customer""",
    "reg_jobs": """
        SELECT concat('j', o_orderkey) AS job_id, o_custkey AS dataset_id, o_orderdate AS created_at,
               CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
               CASE WHEN o_orderstatus='F' THEN concat('m', o_orderkey) END AS model_id,
               o_totalprice AS final_loss FROM orders""",
    "reg_models": """
        SELECT concat('m', o_orderkey) AS id, o_custkey AS dataset_id,
               CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN concat('j', o_orderkey) ELSE concat('j', o_orderkey+1) END AS training_job_id,
               o_orderdate AS created_at FROM orders""",
    "reg_generations": """
        SELECT concat('g', o_orderkey) AS job_id, concat('m', o_orderkey) AS model_id, o_custkey AS dataset_id,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey + 1 END AS synthetic_id,
               CASE WHEN o_orderpriority < '3' THEN 'completed' ELSE 'failed' END AS status, o_orderdate AS created_at FROM orders""",
    "line_generations": """
        SELECT concat('m', l_orderkey) AS model_id, CASE WHEN l_linestatus='F' THEN 'completed' ELSE 'failed' END AS status FROM lineitem""",
    "step_log": """
        SELECT user_id AS job_id, CAST(datediff('day', TIMESTAMP '2024-01-01', ts) AS INTEGER) + 1 AS epoch, event_id AS step,
               value AS generator_loss, value*0.5e0-1e0 AS discriminator_loss, ts, 5000 AS n_rows FROM events""",
}

# The step log's epoch is the day number; only the name of the date function differs.
SPARK_TEXT = {
    "step_log": VIEWS["step_log"].replace(
        "CAST(datediff('day', TIMESTAMP '2024-01-01', ts) AS INTEGER)", "datediff(ts, DATE '2024-01-01')"
    )
}

# A numbered log: one record per event, numbered by time within a run.
RUN_LOG = """
    SELECT user_id AS job_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS epoch,
           value AS generator_loss, value*0.5e0-1e0 AS discriminator_loss, ts,
           event_type, props, event_id FROM events"""

PAIR_SCHEMA = TableSchema(("quantity", "price", "discount", "konst"), ("num_text", "flag"), (), "status")
ORDER_SCHEMA = TableSchema(("cust", "total"), ("priority",), ("id",), "status")


class Tables:
    """The base tables of one folder and the views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        if name in VIEWS:
            text = SPARK_TEXT.get(name, VIEWS[name])
            base = text.split("FROM ")[1].split()[0]
            return self.spark.sql(text.replace(f"FROM {base}", f"FROM {{{base}}}"), **{base: self(base)})
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def scratch(self) -> str:
        """A new folder on the storage the session's checkpoints use."""
        return f"{shared_folder(self.spark)}/semblance-{uuid4().hex}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(body: str, views: tuple[str, ...]) -> str:
    body = body.strip()
    if not views:
        return body
    texts = {**VIEWS, "run_log": RUN_LOG}
    head = "WITH " + ", ".join(f"{v} AS ({texts[v].strip()})" for v in views)
    return f"{head}, {body[5:]}" if body.upper().startswith("WITH ") else f"{head} {body}"


def check(name: str, oracle: str | None = None, views: tuple[str, ...] = ()):
    """Register a query (a function of ``Tables``) and its oracle."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if oracle is not None:
            ORACLES[name] = with_views(oracle, views)
        return fn

    return add


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round the named columns; adding zero turns -0.0 into 0.0."""
    return df.select(*[r(F.col(c), digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


def r(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits) + F.lit(0.0)


def one_row(spark: SparkSession, **values) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], list(values))
