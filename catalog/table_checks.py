"""Scalars, profile and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import ORDER_SCHEMA, Tables, check, r, rounded
from semblance.functions import scalars as S
from semblance.operators import profile as P
from semblance.operators import validate as V
from semblance.operators.order import exact_quantiles
from semblance.operators.prepare import impute_median

SPACE = r"[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]"
PADDED = """
    SELECT doc_id, text,
           CASE doc_id % 4 WHEN 0 THEN concat('  ', lang, chr(160)) WHEN 1 THEN concat(chr(9), lang, chr(10))
                WHEN 2 THEN concat(chr(28), lang) ELSE lang END AS lang,
           CASE doc_id % 3 WHEN 0 THEN chr(160) WHEN 1 THEN '   ' ELSE concat(' ', source) END AS source, n_chars
    FROM {documents}"""


@check(
    "normalize_strings",
    "WITH p AS (" + PADDED.replace("{documents}", "documents") + ") SELECT doc_id, n_chars, "
    + ", ".join(f"nullif(regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g'), '') AS {c}" for c in ("text", "lang", "source"))
    + " FROM p",
)
def normalize_strings(t: Tables):
    return S.normalized(t.spark.sql(PADDED, documents=t("documents")))


NUMBER_TEXTS = """
    SELECT o_orderkey AS id, CASE o_orderkey % 13 WHEN 0 THEN CAST(o_totalprice AS VARCHAR(30))
        WHEN 1 THEN concat(' ', CAST(o_custkey AS VARCHAR(30)), ' ') WHEN 2 THEN '1d' WHEN 3 THEN '1_000' WHEN 4 THEN '0x10'
        WHEN 5 THEN 'nan' WHEN 6 THEN '1e3' WHEN 7 THEN 'abc' WHEN 8 THEN 'inf' WHEN 9 THEN '-.5' WHEN 10 THEN '1e999'
        WHEN 11 THEN NULL ELSE '+7.' END AS v FROM {orders}"""
SQL_NUMBER = (
    "CASE WHEN regexp_full_match(trim(v), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') "
    "AND isfinite(TRY_CAST(trim(v) AS DOUBLE)) THEN TRY_CAST(trim(v) AS DOUBLE) END"
)


@check("coerce_numeric", f"WITH p AS ({NUMBER_TEXTS.replace('{orders}', 'orders')}) SELECT id, v, {SQL_NUMBER} AS x FROM p")
def coerce_numeric(t: Tables):
    df = t.spark.sql(NUMBER_TEXTS, orders=t("orders"))
    return df.select("id", "v", S.number(F.col("v"), df.schema["v"].dataType).alias("x"))


@check(
    "numeric_ratio",
    f"WITH p AS ({NUMBER_TEXTS.replace('{orders}', 'orders')}) "
    f"SELECT 'v' AS column_name, round(count({SQL_NUMBER}) / count(v), 6) AS numeric_ratio FROM p",
)
def numeric_ratio(t: Tables):
    stats = P.column_stats(t.spark.sql(NUMBER_TEXTS, orders=t("orders")), ["v"], shape=False)
    return stats.select(F.col("column").alias("column_name"), r(F.col("numeric_ratio")).alias("numeric_ratio"))


NON_FINITE = """
    SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('Infinity' AS DOUBLE)
        WHEN 2 THEN CAST('-Infinity' AS DOUBLE) ELSE c_acctbal END AS x FROM {customer}"""


@check("sanitize_nonfinite", f"SELECT id, CASE WHEN isfinite(x) THEN x END AS x FROM ({NON_FINITE.replace('{customer}', 'customer')})")
def sanitize_nonfinite(t: Tables):
    return S.sanitized(t.spark.sql(NON_FINITE, customer=t("customer")))


@check(
    "integer_like",
    """SELECT bool_and(abs(l_quantity - round_even(l_quantity, 0)) < 1e-9) AS quantity,
              bool_and(abs(l_discount - round_even(l_discount, 0)) < 1e-9) AS discount,
              bool_and(abs(l_linenumber - round_even(l_linenumber, 0)) < 1e-9) AS linenumber, false AS flag FROM lineitem""",
)
def integer_like(t: Tables):
    df = t("lineitem")
    names = {"quantity": "l_quantity", "discount": "l_discount", "linenumber": "l_linenumber", "flag": "l_returnflag"}
    return df.agg(*[S.integer_like(F.col(c), df.schema[c].dataType).alias(n) for n, c in names.items()])


@check(
    "round_up_multiple",
    "SELECT o_orderkey AS id, CAST(greatest(32, ceil(o_custkey / 32e0) * 32) AS BIGINT) AS batch FROM orders",
)
def round_up_multiple(t: Tables):
    return t("orders").select(
        F.col("o_orderkey").alias("id"), S.round_up_to_multiple(F.col("o_custkey"), F.lit(32)).cast("bigint").alias("batch")
    )


@check(
    "json_extract",
    """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
              TRY_CAST(json_extract_string(concat('{"a": ', props, '}'), '$.a.k') AS DOUBLE) AS nested,
              json_extract_string(props, '$.absent') AS absent FROM events""",
)
def json_extract(t: Tables):
    nested = F.concat(F.lit('{"a": '), F.col("props"), F.lit("}"))
    return t("events").select(
        "event_id", S.json_number(F.col("props"), "k").alias("k"), S.json_number(nested, "a", "k").alias("nested"),
        S.json_text(F.col("props"), "absent").alias("absent"),
    )


@check(
    "missing_token",
    """SELECT id, CASE WHEN priority IS NULL OR priority IN ('nan', '<NA>') THEN '__missing__' ELSE priority END AS priority,
              concat(coalesce(priority, '__missing__'), chr(31), status) AS key FROM order_rows""",
    ("order_rows",),
)
def missing_token(t: Tables):
    key = S.composite_key([F.col("priority"), F.col("status")])
    return t("order_rows").select("id", S.present_or_missing(F.col("priority")).alias("priority"), key.alias("key"))


@check(
    "resolve_target",
    """SELECT id, coalesce(nullif(target, ''), json_extract_string(schema_json, '$.target.name'),
              json_extract_string(metadata, '$.target')) AS resolved FROM (
       SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 1 THEN '' END AS target,
              CASE WHEN c_custkey % 2 = 0 THEN concat('{"target": {"name": "', c_name, '"}}') ELSE '{}' END AS schema_json,
              CASE WHEN c_custkey % 5 > 0 THEN concat('{"target": "n', c_nationkey, '"}') END AS metadata FROM customer)""",
)
def resolve_target(t: Tables):
    df = t("customer").selectExpr(
        "c_custkey AS id", "CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 1 THEN '' END AS target",
        """CASE WHEN c_custkey % 2 = 0 THEN concat('{"target": {"name": "', c_name, '"}}') ELSE '{}' END AS schema_json""",
        """CASE WHEN c_custkey % 5 > 0 THEN concat('{"target": "n', c_nationkey, '"}') END AS metadata""",
    )
    return df.select("id", S.target_name(F.col("target"), F.col("schema_json"), F.col("metadata")).alias("resolved"))


# -- profile -----------------------------------------------------------------


@check(
    "profile_missing",
    "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count, "
        f"round((count(*) - count({c})) / count(*) * 100, 6) AS missing_pct FROM pair_real"
        for c in ("quantity", "price", "discount", "konst", "num_text", "flag", "status")
    ),
    ("pair_real",),
)
def profile_missing(t: Tables):
    stats = P.column_stats(t("pair_real"), shape=False)
    return stats.select(F.col("column").alias("column_name"), "missing_count", r(F.col("missing_pct")).alias("missing_pct"))


@check(
    "profile_distinct",
    "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS unique_values, "
        f"round(count(DISTINCT {c}) / count({c}), 6) AS unique_ratio, count(DISTINCT {c}) <= 1 AS is_constant FROM pair_real"
        for c in ("quantity", "price", "discount", "konst", "num_text", "flag", "status")
    ),
    ("pair_real",),
)
def profile_distinct(t: Tables):
    stats = P.distinct_stats(P.value_counts(t("pair_real")))
    return stats.select(F.col("column").alias("column_name"), "unique_values", r(F.col("unique_ratio")).alias("unique_ratio"), "is_constant")


NUMBERS = ("quantity", "price", "discount", "konst")


@check(
    "profile_numeric",
    "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(avg({c}), 4) AS mean, "
        f"round(stddev_samp({c}), 4) AS std FROM pair_real" for c in NUMBERS
    ),
    ("pair_real",),
)
def profile_numeric(t: Tables):
    stats = P.column_stats(t("pair_real"), list(NUMBERS))
    return stats.select(F.col("column").alias("column_name"), *[r(F.col(c), 4).alias(c) for c in ("min", "max", "mean", "std")])


@check(
    "profile_quantiles",
    "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, round(quantile_cont({c}, 0.25), 4) AS q1, round(median({c}), 4) AS median, "
        f"round(quantile_cont({c}, 0.75), 4) AS q3, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) AS iqr FROM pair_real"
        for c in NUMBERS
    ),
    ("pair_real",),
)
def profile_quantiles(t: Tables):
    found = P.quantile_stats(t("pair_real"), list(NUMBERS))
    return rounded(found.withColumnRenamed("column", "column_name"), q1=4, median=4, q3=4, iqr=4)


@check(
    "profile_shape",
    "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, round(CASE WHEN min({c}) = max({c}) THEN 0 ELSE skewness({c}) END, 4) + 0e0 AS skewness, "
        f"round(CASE WHEN min({c}) = max({c}) THEN 0 ELSE kurtosis({c}) END, 4) + 0e0 AS kurtosis FROM pair_real" for c in NUMBERS
    ),
    ("pair_real",),
)
def profile_shape(t: Tables):
    stats = P.column_stats(t("pair_real"), list(NUMBERS))
    return stats.select(F.col("column").alias("column_name"), *[r(F.col(c), 4).alias(c) for c in ("skewness", "kurtosis")])


TEXTS = ("num_text", "flag", "status")


@check(
    "profile_top_values",
    "WITH v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value FROM pair_real WHERE {c} IS NOT NULL" for c in TEXTS)
    + """), n AS (SELECT column_name, value, count(*) AS n FROM v GROUP BY column_name, value),
    k AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank,
                 row_number() OVER (PARTITION BY column_name ORDER BY value) AS place,
                 sum(n) OVER (PARTITION BY column_name) AS total FROM n)
    SELECT column_name, rank, value, n, round(n / total * 100, 6) AS pct, false AS is_example FROM k WHERE rank <= 5
    UNION ALL SELECT column_name, place, value, NULL, NULL, true FROM k WHERE place <= 3""",
    ("pair_real",),
)
def profile_top_values(t: Tables):
    counts = P.value_counts(t("pair_real"), list(TEXTS))
    top = P.top_values(counts).select(
        F.col("column").alias("column_name"), F.col("rank").cast("bigint").alias("rank"), "value", F.col("count").alias("n"),
        r(F.col("pct")).alias("pct"), F.lit(False).alias("is_example"),
    )
    examples = P.example_values(counts).select(
        F.col("column").alias("column_name"), F.col("rank").cast("bigint").alias("rank"), "value",
        F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("double").alias("pct"), F.lit(True).alias("is_example"),
    )
    return top.unionByName(examples)


@check(
    "class_distribution",
    """SELECT 'flag' AS target, flag AS label, count(*) AS n FROM pair_real WHERE flag IS NOT NULL GROUP BY flag
       UNION ALL SELECT 'konst', CAST(CAST(konst AS BIGINT) AS VARCHAR), count(*) FROM pair_syn GROUP BY konst
       UNION ALL SELECT 'big', CASE WHEN price > 50000 THEN 'True' ELSE 'False' END, count(*) FROM pair_real GROUP BY price > 50000, 2""",
    ("pair_real", "pair_syn"),
)
def class_distribution(t: Tables):
    real, syn = t("pair_real"), t("pair_syn")
    parts = {"flag": (real, "flag"), "konst": (syn, "konst"), "big": (real.withColumn("big", F.col("price") > 50000), "big")}
    out = [
        P.class_distribution(df, c).select(F.lit(n).alias("target"), "label", F.col("count").alias("n")) for n, (df, c) in parts.items()
    ]
    return out[0].unionByName(out[1]).unionByName(out[2])


IMBALANCE = """
WITH c AS (SELECT {c} AS label, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}),
m AS (SELECT first(label ORDER BY n, label) AS minority_class, min(n) AS minority_count,
             first(label ORDER BY n DESC, label) AS majority_class, max(n) AS majority_count, sum(n) AS total FROM c),
p AS (SELECT *, minority_count / total * 100 AS pct FROM m)
SELECT minority_class, minority_count, round(pct, 6) AS minority_pct, majority_class, majority_count,
       round(majority_count / total * 100, 6) AS majority_pct,
       concat('1:', CAST(greatest(1, round_even(majority_count / minority_count, 0)) AS BIGINT)) AS class_ratio, pct < 5 AS is_severe,
       CASE WHEN pct < 5 THEN printf('Dataset shows severe class imbalance (%.2f%% minority). Synthetic data generation is strongly recommended to improve minority coverage.', pct)
            WHEN pct < 20 THEN printf('Dataset shows moderate class imbalance (%.2f%% minority). Synthetic data generation can help balance this.', pct)
            ELSE printf('Dataset is relatively balanced (%.2f%% minority). Synthetic augmentation is optional and should be guided by downstream metrics.', pct) END AS recommendation
FROM p"""


@check("class_imbalance", IMBALANCE.format(c="flag", t="pair_syn"), ("pair_syn",))
def class_imbalance(t: Tables):
    return rounded(P.class_imbalance(t("pair_syn"), "flag"), minority_pct=6, majority_pct=6)


PROFILED = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
            "l_linestatus", "l_shipdate")


def _profile_sql() -> str:
    parts = []
    for c in PROFILED:
        is_text = c in ("l_linestatus", "l_shipdate")
        x = "CAST(NULL AS DOUBLE)" if is_text else f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column_name, count(*) AS n, count({c}) AS p, count(DISTINCT {c}) AS d, count({x}) AS xs, min({x}) AS lo, "
            f"max({x}) AS hi, avg({x}) AS mean, stddev_samp({x}) AS std, quantile_cont({x}, 0.25) AS q1, median({x}) AS med, "
            f"quantile_cont({x}, 0.75) AS q3, skewness({x}) AS skew, kurtosis({x}) AS kurt, "
            f"(SELECT max(k) FROM (SELECT count(*) AS k FROM lineitem GROUP BY {c})) AS top FROM lineitem"
        )
    num = lambda e, a: f"CASE WHEN kind = 'numeric' THEN round({e}, 4) + 0e0 END AS {a}"
    return (
        "WITH s AS (" + " UNION ALL ".join(parts) + "), k AS (SELECT *, d / p >= 0.95 AND d > 50 AS skipped FROM s), "
        "y AS (SELECT *, CASE WHEN skipped THEN NULL WHEN xs / p >= 0.9 AND d > 5 THEN 'numeric' ELSE 'categorical' END AS kind FROM k) "
        "SELECT column_name, CASE WHEN skipped THEN 'skipped' ELSE 'feature' END AS role, kind AS type, "
        "CASE WHEN NOT skipped THEN n - p END AS missing_count, CASE WHEN NOT skipped THEN d END AS unique_values, "
        + ", ".join([num("lo", "min"), num("hi", "max"), num("mean", "mean"), num("std", "std"), num("med", "median"), num("q1", "q1"),
                     num("q3", "q3"), num("q3 - q1", "iqr"), num("skew", "skewness"), num("kurt", "kurtosis")])
        + ", CASE WHEN kind = 'categorical' THEN d END AS cardinality, CASE WHEN kind = 'categorical' THEN top END AS most_common_freq FROM y "
        "UNION ALL SELECT 'l_returnflag', 'target', 'categorical', count(*) - count(l_returnflag), count(DISTINCT l_returnflag), "
        + "NULL, " * 10
        + "count(DISTINCT l_returnflag), (SELECT max(k) FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_returnflag)) FROM lineitem"
    )


@check("profile_table", _profile_sql())
def profile_table(t: Tables):
    p = P.profile(t("lineitem"), "l_returnflag")
    numbers = ("min", "max", "mean", "std", "median", "q1", "q3", "iqr", "skewness", "kurtosis")
    return p.select(
        F.col("column").alias("column_name"), "role", "type", "missing_count", "unique_values", *[r(F.col(c), 4).alias(c) for c in numbers],
        "cardinality", "most_common_freq",
    )


@check(
    "report_metadata",
    """SELECT 'c_custkey' AS column_name, 'x' AS sdtype, false AS is_target WHERE false
       UNION ALL SELECT c, CASE WHEN d > 5 AND num THEN 'numerical' ELSE 'categorical' END, tgt FROM (
         SELECT 'c_nationkey' AS c, count(DISTINCT c_nationkey) AS d, true AS num, false AS tgt, count(*) AS n FROM customer
         UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment), false, true, count(*) FROM customer
         UNION ALL SELECT 'c_custkey', count(DISTINCT c_custkey), true, false, count(*) FROM customer
         UNION ALL SELECT 'c_name', count(DISTINCT c_name), false, false, count(*) FROM customer
         UNION ALL SELECT 'c_acctbal', count(DISTINCT c_acctbal), true, false, count(*) FROM customer)
       WHERE tgt OR NOT (d / n >= 0.95 AND d > 50)""",
)
def report_metadata(t: Tables):
    return P.report_columns(P.profile(t("customer"), "c_mktsegment")).withColumnRenamed("column", "column_name")


def _target_rules_sql(c: str, table: str, numeric: str, whole: str) -> str:
    return f"""
      SELECT '{c}' AS target, 'not_empty' AS rule, count({c}) > 0 AS passed FROM {table}
      UNION ALL SELECT '{c}', 'enough_classes', count(DISTINCT {c}) >= 2 FROM {table}
      UNION ALL SELECT '{c}', 'few_classes', count(DISTINCT {c}) <= 20 FROM {table}
      UNION ALL SELECT '{c}', 'discrete', NOT ({numeric} AND NOT bool_and({whole})) FROM {table}"""


@check(
    "validate_target",
    " UNION ALL ".join([
        _target_rules_sql("l_returnflag", "lineitem", "false", "true"),
        _target_rules_sql("l_discount", "lineitem", "true", "abs(l_discount - round_even(l_discount, 0)) < 1e-9"),
        _target_rules_sql("l_linenumber", "lineitem", "true", "true"),
        _target_rules_sql("l_suppkey", "lineitem", "true", "true"),
    ]),
)
def validate_target(t: Tables):
    df, out = t("lineitem"), None
    for c in ("l_returnflag", "l_discount", "l_linenumber", "l_suppkey"):
        rules = V.target_rules(df, c).select(F.lit(c).alias("target"), "rule", "passed")
        out = rules if out is None else out.unionByName(rules)
    return out


@check(
    "config_rules",
    """WITH c AS (SELECT o_orderkey AS id, CAST(o_custkey * 20 AS BIGINT) AS epochs, CAST(o_custkey AS BIGINT) AS batch_size,
         o_totalprice / 1000000 AS generator_lr, o_orderkey % 13 AS discriminator_steps,
         CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 300 END AS early_stopping_patience,
         o_orderkey % 700 AS embedding_dim, o_orderkey % 7 AS n_generator, o_custkey % 8 AS n_discriminator, o_totalprice / 3000000 AS discriminator_lr,
         (o_orderkey % 40) / 20e0 AS early_stopping_min_delta, o_custkey * 30 AS sdmetrics_n_samples FROM orders)
       SELECT id, 'epochs' AS rule FROM c WHERE NOT (epochs BETWEEN 1 AND 2000)
       UNION ALL SELECT id, 'batch_size' FROM c WHERE NOT (batch_size BETWEEN 32 AND 4096)
       UNION ALL SELECT id, 'generator_lr' FROM c WHERE NOT (generator_lr > 0 AND generator_lr <= 0.1)
       UNION ALL SELECT id, 'discriminator_steps' FROM c WHERE NOT (discriminator_steps BETWEEN 1 AND 10)
       UNION ALL SELECT id, 'early_stopping_patience' FROM c WHERE NOT (early_stopping_patience BETWEEN 5 AND 200)
       UNION ALL SELECT id, 'embedding_dim' FROM c WHERE NOT (embedding_dim BETWEEN 32 AND 512)
       UNION ALL SELECT id, 'generator_dim' FROM c WHERE NOT (n_generator BETWEEN 1 AND 5)
       UNION ALL SELECT id, 'discriminator_dim' FROM c WHERE NOT (n_discriminator BETWEEN 1 AND 5)
       UNION ALL SELECT id, 'discriminator_lr' FROM c WHERE NOT (discriminator_lr > 0 AND discriminator_lr <= 0.1)
       UNION ALL SELECT id, 'early_stopping_min_delta' FROM c WHERE NOT (early_stopping_min_delta > 0 AND early_stopping_min_delta <= 1)
       UNION ALL SELECT id, 'sdmetrics_n_samples' FROM c WHERE NOT (sdmetrics_n_samples BETWEEN 100 AND 20000)""",
)
def config_rules(t: Tables):
    configs = t("orders").selectExpr(
        "o_orderkey AS id", "o_custkey * 20 AS epochs", "o_custkey AS batch_size", "o_totalprice / 1000000 AS generator_lr",
        "o_orderkey % 13 AS discriminator_steps", "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 300 END AS early_stopping_patience",
        "o_orderkey % 700 AS embedding_dim", "array_repeat(64, cast(o_orderkey % 7 AS int)) AS generator_dim", "array_repeat(64, cast(o_custkey % 8 AS int)) AS discriminator_dim",
        "o_totalprice / 3000000 AS discriminator_lr", "(o_orderkey % 40) / 20 AS early_stopping_min_delta", "o_custkey * 30 AS sdmetrics_n_samples",
    )
    return V.config_violations(configs, "id")


@check(
    "impute_median",
    """SELECT id, round(coalesce(total, (SELECT median(total) FROM order_rows)), 4) AS total, priority FROM order_rows""",
    ("order_rows",),
)
def impute(t: Tables):
    df = t("order_rows").select("id", "total", "priority")
    return rounded(impute_median(df, ["total"]), total=4)


@check(
    "exact_quantiles",
    "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, {p}e0 AS p, round(quantile_cont({c}, {p}), 4) AS value FROM lineitem"
        for c in ("l_quantity", "l_extendedprice") for p in (0.01, 0.333, 0.5, 0.99)
    ),
)
def quantiles_by_bracket(t: Tables):
    """The large-table path: a sketch bracket, a counting scan, a sort of the bracket only."""
    df = t("lineitem")
    names = ("l_quantity", "l_extendedprice")
    found = exact_quantiles(df, {c: F.col(c) for c in names}, [0.01, 0.333, 0.5, 0.99], exact_limit=0)
    rows = [(c, p, v) for c, q in found.items() for p, v in q.items()]
    return rounded(t.spark.createDataFrame(rows, "column_name string, p double, value double"), value=4)
