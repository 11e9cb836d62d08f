"""Checks on tables, label columns, configurations and references between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semblance.functions.scalars import col, integer_like, label, number

# Limits and messages.
MIN_CLASSES = 2
MAX_CLASSES = 20
ABSENT_TARGET = "Target column '%s' not found. Available columns: %s"
EMPTY_TARGET = "Target column '%s' cannot be entirely empty or NaN."
ONE_CLASS = "Target column must contain at least 2 unique classes for classification. Found %d."
MANY_CLASSES = "Target column must have 2-20 unique values for classification. Found %d unique values."
CONTINUOUS_TARGET = "Target column must contain discrete class labels. Continuous float targets are not supported."
CONFIG_RULES = {
    "epochs": "epochs BETWEEN 1 AND 2000",
    "batch_size": "batch_size BETWEEN 32 AND 4096",
    "embedding_dim": "embedding_dim BETWEEN 32 AND 512",
    "generator_dim": "size(generator_dim) BETWEEN 1 AND 5",
    "discriminator_dim": "size(discriminator_dim) BETWEEN 1 AND 5",
    "generator_lr": "generator_lr > 0 AND generator_lr <= 0.1",
    "discriminator_lr": "discriminator_lr > 0 AND discriminator_lr <= 0.1",
    "discriminator_steps": "discriminator_steps BETWEEN 1 AND 10",
    "early_stopping_patience": "early_stopping_patience BETWEEN 5 AND 200",
    "early_stopping_min_delta": "early_stopping_min_delta > 0 AND early_stopping_min_delta <= 1.0",
    "sdmetrics_n_samples": "sdmetrics_n_samples BETWEEN 100 AND 20000",
}


class TableError(ValueError):
    """A table or column that cannot be used."""


def target_rules(df: DataFrame, target: str) -> DataFrame:
    """Every rule for a label column as (rule, passed, message), in checking order.

    Labels are grouped first: a set of the distinct labels would grow with the data.
    """
    text = label(col(target), df.schema[target].dataType)
    kind = df.schema[target].dataType
    x = number(col(target), kind)
    classes = df.select(col(target).alias("v"), text.alias("label"), x.alias("x")).where(F.col("v").isNotNull())
    per_label = classes.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(F.col("x").isNotNull()).alias("all_numbers"),
        integer_like(F.col("v"), kind).alias("integers"),
    )
    facts = per_label.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("values"),
        F.count(F.lit(1)).alias("classes"),
        F.coalesce(F.bool_and("all_numbers"), F.lit(False)).alias("all_numbers"),
        F.coalesce(F.bool_and("integers"), F.lit(True)).alias("integers"),
    )
    rule = lambda no, name, passed, message: F.struct(
        F.lit(no).alias("rule_no"), F.lit(name).alias("rule"), passed.alias("passed"), message.alias("message")
    )
    rules = F.array(
        rule(1, "not_empty", F.col("values") > 0, F.lit(EMPTY_TARGET % target)),
        rule(2, "enough_classes", F.col("classes") >= MIN_CLASSES, F.format_string(ONE_CLASS, "classes")),
        rule(3, "few_classes", F.col("classes") <= MAX_CLASSES, F.format_string(MANY_CLASSES, "classes")),
        rule(4, "discrete", ~(F.col("all_numbers") & ~F.col("integers")), F.lit(CONTINUOUS_TARGET)),
    )
    return facts.select(F.inline(rules))


def validate_target(df: DataFrame, target: str) -> None:
    """Raise for the first broken rule."""
    if target not in df.columns:
        raise TableError(ABSENT_TARGET % (target, ", ".join(df.columns)))
    broken = target_rules(df, target).where(~F.col("passed")).orderBy("rule_no").first()
    if broken:
        raise TableError(broken["message"])


def config_violations(configs: DataFrame, key: str) -> DataFrame:
    """(key, broken rule) of every setting outside its range; absent settings pass."""
    rules = [(name, rule) for name, rule in CONFIG_RULES.items() if name in configs.columns]
    broken = F.array(
        *[F.when(~F.coalesce(F.expr(rule), F.lit(True)), F.lit(name)) for name, rule in rules]
    )
    return configs.select(key, F.explode(F.array_compact(broken)).alias("rule"))


def orphans(child: DataFrame, foreign_key: str, parent: DataFrame, primary_key: str) -> DataFrame:
    """Child rows whose non-null reference has no parent."""
    link = child[foreign_key] == parent[primary_key]
    return child.where(col(foreign_key).isNotNull()).join(parent, link, "left_anti")


def wrong_dataset(requests: DataFrame, models: DataFrame) -> DataFrame:
    """Requests whose model exists but belongs to another dataset."""
    m = models.select(F.col("id").alias("__id"), F.col("dataset_id").alias("model_dataset_id"))
    return requests.join(m, F.col("model_id") == F.col("__id")).where(F.col("model_dataset_id") != F.col("dataset_id")).drop("__id")
