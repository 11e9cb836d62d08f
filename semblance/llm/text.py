"""Words, lower case and keyed rows, shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semblance.session import materialised

# Runs that count as words, and white space.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def named(name: str) -> Column:
    """The column of that very name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def body(name: str) -> Column:
    """A text column without nulls."""
    return F.coalesce(named(name).cast("string"), F.lit(""))


def lowered(text: Column) -> Column:
    """A-Z in lower case, every other character unchanged."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def upto(last: Column) -> Column:
    """0, 1, ... last; no entries where last is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def kept_rows(df: DataFrame) -> DataFrame:
    """The frame, written to the checkpoint folder, with a row key ``rid`` that no recomputation changes."""
    return materialised(df.withColumn("rid", F.monotonically_increasing_id()))


def hex_sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def picked(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns of those very names, the first of equal ones; other columns may clash with them in any spelling."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{df.columns.index(n)}").alias(n) for n in names])


def sent(df: DataFrame, rows: int, most: int) -> DataFrame:
    """The small side of a join: broadcast where its counted rows are at most ``most``, else left to a shuffle join."""
    return F.broadcast(df) if rows <= most else df
