"""Scalar column functions: cleaning, coercion, labels and small formulas.

Everything here returns a ``Column`` made of built-in expressions, so it stays
inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
MISSING = "__missing__"
MISSING_TEXTS = ["nan", "<NA>"]
KEY_SEPARATOR = "\u001f"
EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
NUMBER_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
SEVERE_BELOW = 5.0
MODERATE_BELOW = 20.0
SEVERE_TEXT = (
    "Dataset shows severe class imbalance (%.2f%% minority). "
    "Synthetic data generation is strongly recommended to improve minority coverage."
)
MODERATE_TEXT = (
    "Dataset shows moderate class imbalance (%.2f%% minority). "
    "Synthetic data generation can help balance this."
)
BALANCED_TEXT = (
    "Dataset is relatively balanced (%.2f%% minority). "
    "Synthetic augmentation is optional and should be guided by downstream metrics."
)


def col(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


# -- cleaning ---------------------------------------------------------------


def trimmed(c: Column) -> Column:
    """Text without leading and trailing white space; blank becomes null.

    Text that begins and ends with a visible ASCII character, the usual case,
    skips the regular expression.
    """
    visible = lambda end: F.ascii(end).between(33, 126)
    text = F.regexp_replace(c, EDGE_SPACE, "")
    return F.when(visible(c) & visible(F.substring(c, -1, 1)), c).otherwise(F.when(text != "", text))


def finite(c: Column) -> Column:
    """NaN and the infinities become null."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def clean(c: Column, dtype: T.DataType) -> Column:
    """Null out non-finite numbers at any depth of arrays, maps and structs."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return finite(c)
    if not _has_fraction(dtype):
        return c
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: clean(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(c, lambda _, v: clean(v, dtype.valueType))
    fields = [clean(c.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
    return F.when(c.isNotNull(), F.struct(*fields))


def _has_fraction(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _has_fraction(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _has_fraction(dtype.valueType)
    if isinstance(dtype, T.StructType):
        return any(_has_fraction(f.dataType) for f in dtype.fields)
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def normalized(df: DataFrame) -> DataFrame:
    """Trim every string column in one projection; other types are untouched."""
    return df.select(
        *[
            (trimmed(col(f.name)) if isinstance(f.dataType, T.StringType) else col(f.name)).alias(f.name)
            for f in df.schema
        ]
    )


def sanitized(df: DataFrame) -> DataFrame:
    """Null out NaN and infinities in every column, nested ones included."""
    return df.select(*[clean(col(f.name), f.dataType).alias(f.name) for f in df.schema])


# -- types ------------------------------------------------------------------


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def number(c: Column, dtype: T.DataType) -> Column:
    """The value as a finite double, or null where it is no number."""
    if isinstance(dtype, T.StringType):
        text = F.trim(c)
        first = F.ascii(text)  # a digit, a sign or a point, before the costlier test
        could = first.between(48, 57) | first.isin(43, 45, 46)
        return finite(F.when(could & text.rlike(NUMBER_TEXT), text.try_cast("double")))
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return finite(c.cast("double"))
    if isinstance(dtype, T.NumericType):
        return c.cast("double")
    return F.lit(None).cast("double")


def label(c: Column, dtype: T.DataType) -> Column:
    """Canonical text of a value; integral doubles print as integers."""
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, T.BooleanType):
        return F.initcap(c.cast("string"))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        whole = (c == F.rint(c)) & (F.abs(c) < F.lit(1e15))
        return F.when(whole, c.try_cast("bigint").cast("string")).otherwise(c.cast("string"))
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c) if not isinstance(dtype, T.MapType) else F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))
    return c.cast("string")


def integer_like(c: Column, dtype: T.DataType) -> Column:
    """Aggregate: every non-null value is a number within 1e-9 of an integer."""
    x = number(c, dtype)
    ok = x.isNotNull() & (F.abs(x - F.rint(x)) < F.lit(1e-9))
    return F.coalesce(F.bool_and(F.when(c.isNotNull(), F.coalesce(ok, F.lit(False)))), F.lit(True))


def present_or_missing(c: Column) -> Column:
    """Category text with nulls and null-like texts as one token."""
    return F.coalesce(F.when(~c.isin(*MISSING_TEXTS), c), F.lit(MISSING))


def composite_key(columns: list[Column]) -> Column:
    """One text key; nulls take the token first because concat_ws skips them."""
    return F.concat_ws(KEY_SEPARATOR, *[F.coalesce(c, F.lit(MISSING)) for c in columns])


def json_text(c: Column, *path: str) -> Column:
    return F.get_json_object(c, "$." + ".".join(path))


def json_number(c: Column, *path: str) -> Column:
    return json_text(c, *path).try_cast("double")


# -- formulas ---------------------------------------------------------------


def clipped(x: Column, low: float, high: float) -> Column:
    """Null stays null (``least`` and ``greatest`` would skip it)."""
    return F.when(x.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), x)))


def round_up_to_multiple(n: Column, multiple: Column) -> Column:
    return F.greatest(multiple, F.ceil(n / multiple) * multiple)


def ratio_text(majority: Column, minority: Column) -> Column:
    times = F.greatest(F.lit(1), F.bround(majority / minority, 0).cast("bigint"))
    return F.concat(F.lit("1:"), times.cast("string"))


def imbalance_advice(minority_pct: Column) -> Column:
    return (
        F.when(minority_pct < SEVERE_BELOW, F.format_string(SEVERE_TEXT, minority_pct))
        .when(minority_pct < MODERATE_BELOW, F.format_string(MODERATE_TEXT, minority_pct))
        .otherwise(F.format_string(BALANCED_TEXT, minority_pct))
    )


def elapsed_seconds(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(1e6)


def loss_ratio(generator: Column, discriminator: Column) -> Column:
    return F.round(F.abs(generator) / (F.abs(discriminator) + F.lit(1e-8)), 4)


def epsilon_of(mean_tv: Column) -> Column:
    t = clipped(mean_tv, 0.0, 1.0 - 1e-9)
    return clipped(F.log((F.lit(1.0) + t) / (F.lit(1.0) - t)), 0.0, 10.0)


def target_name(target: Column, schema: Column, metadata: Column) -> Column:
    """First non-blank of the stored target, the profile's and the metadata's."""
    options = [target, json_text(schema, "target", "name"), json_text(metadata, "target")]
    return F.coalesce(*[F.when(o != "", o) for o in options])


def owner(user: Column, metadata: Column) -> Column:
    return F.coalesce(F.when(user != "", user), json_text(metadata, "user_id"))


def safe_ratio(top: Column, bottom: Column) -> Column:
    """Null instead of an error for a zero denominator."""
    return top / F.when(bottom != 0, bottom)
