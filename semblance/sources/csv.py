"""CSV scan: header, type inference over the whole file, missing-value tokens."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semblance.functions.scalars import NUMBER_TEXT, col, finite, normalized
from semblance.operators.validate import TableError
from semblance.session import materialised
from semblance.sources.quoted import records

# Texts read as missing, text forms, messages.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
INTEGER_TEXT = r"^[+-]?[0-9]+$"
BOOLEAN_TEXTS = ["True", "TRUE", "true", "False", "FALSE", "false"]
INFINITE_TEXT = r"(?i)^[+-]?inf(inity)?$"
NO_CSV = "File must be CSV format"
EMPTY_CSV = "Uploaded CSV is empty."
CORRUPT_CSV = "Uploaded CSV is corrupted or could not be parsed."
NO_ROWS = "CSV must contain at least one row and one column."
OTHER_HEADER = "CSV files under one path need the same header in the same order."

CORRUPT = "__corrupt"
CSV_FILES = "*.[cC][sS][vV]"


def _inferred(text: Column, found, i: int) -> Column:
    """The narrowest type that every present value of the column fits."""
    if not found[f"n{i}"]:
        return text
    trimmed = F.trim(text)
    if found[f"b{i}"] == found[f"n{i}"]:
        return F.lower(trimmed).try_cast("boolean")
    if found[f"l{i}"] == found[f"n{i}"]:
        return trimmed.try_cast("bigint")
    if found[f"w{i}"]:
        # Integers beyond 64 bits keep their digits.
        return text
    if found[f"d{i}"] == found[f"n{i}"]:
        return finite(trimmed.try_cast("double"))
    return text


def _fields(record: Column, quote: str) -> Column:
    """How many fields a record's text has; commas between quotes do not part fields."""
    q = "\\" + quote
    bare = F.regexp_replace(record, f"{q}[^{q}]*{q}", "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def _open_quotes(spark: SparkSession, path: str, quote: str) -> bool:
    """Whether any line has an odd number of quotes, so that a field goes on in the next line."""
    lines = spark.read.option("pathGlobFilter", CSV_FILES).text(path)
    odd = (F.length("value") - F.length(F.replace(F.col("value"), F.lit(quote), F.lit("")))) % 2 == 1
    return not lines.where(odd).isEmpty()


def _parsed(found: DataFrame, schema: T.StructType, options: dict[str, str]) -> DataFrame:
    """The records' fields by the schema; the first record of each file is its header, and all headers must be the same."""
    found = materialised(found)
    headers = found.where("first").select(F.regexp_replace("text", "^\ufeff", "").alias("text")).distinct().limit(2).collect()
    if len(headers) > 1:
        raise TableError(OTHER_HEADER)
    # Fields by place, as header names may be any text.
    plain = T.StructType([T.StructField(f"f{i}", T.StringType()) for i in range(len(schema) - 1)] + [schema[-1]])
    rows = found.where("NOT first").select(F.from_csv("text", plain.simpleString()[7:-1].replace(":", " ").replace(",", ", "), options).alias("r"))
    return rows.select(*[F.col(f"r.{p.name}").alias(f.name) for p, f in zip(plain, schema)])


def scan_csv(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """Read CSV files with a header row.

    Rows with too many fields are an error, as are files whose header differs from the first one's; short rows are
    filled with nulls.  Tokens for missing values are compared before trimming, on the whole field.  All files are
    read in splits, those with line breaks inside quotes too.  Only files that end in .csv, in either case, are read.
    """
    try:
        several = _open_quotes(spark, path, quote)
        options = {"quote": quote, "escape": quote, "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "nullValue": "", "emptyValue": ""}
        reader = spark.read.options(**options).option("header", True).option("multiLine", several).option("pathGlobFilter", CSV_FILES)
        header = reader.csv(path)
    except AnalysisException as e:
        raise TableError(f"{NO_CSV}: no readable .csv under '{path}'.") from e
    names = header.columns
    if not names:
        raise TableError(EMPTY_CSV)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField(CORRUPT, T.StringType())])
    lenient = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    if several:
        raw = _parsed(records(spark, path, CSV_FILES, quote), schema, {**options, **lenient})
    else:
        raw = reader.options(**lenient).option("enforceSchema", False).schema(schema).csv(path)
    value = {n: F.when(~col(n).isin(*NA_TOKENS), col(n)) for n in names}
    is_number = lambda v: F.trim(v).rlike(NUMBER_TEXT) | F.trim(v).rlike(INFINITE_TEXT)
    facts = [
        F.count(F.lit(1)).alias("rows"),
        # short rows are flagged as well
        F.count(F.when(_fields(col(CORRUPT), quote) > len(names), 1)).alias("flagged"),
        *[F.count(value[n]).alias(f"n{i}") for i, n in enumerate(names)],
        *[F.count(F.when(F.trim(value[n]).isin(*BOOLEAN_TEXTS), 1)).alias(f"b{i}") for i, n in enumerate(names)],
        *[F.count(F.when(F.trim(value[n]).rlike(INTEGER_TEXT), F.trim(value[n]).try_cast("bigint"))).alias(f"l{i}") for i, n in enumerate(names)],
        *[F.count(F.when(F.trim(value[n]).rlike(INTEGER_TEXT) & F.trim(value[n]).try_cast("bigint").isNull(), 1)).alias(f"w{i}") for i, n in enumerate(names)],
        *[F.count(F.when(is_number(value[n]), 1)).alias(f"d{i}") for i, n in enumerate(names)],
    ]
    try:
        found = raw.agg(*facts).first()
    except Exception as e:  # the header check of each file runs with the scan
        if "header" in str(e).lower():
            raise TableError(f"{OTHER_HEADER} {str(e).splitlines()[0]}") from e
        raise
    if found["flagged"]:
        raise TableError(CORRUPT_CSV)
    if not found["rows"]:
        raise TableError(NO_ROWS)
    typed = raw.select(*[_inferred(value[n], found, i).alias(n) for i, n in enumerate(names)])
    return normalized(typed)
