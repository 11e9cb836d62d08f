"""Match positions in column expressions: which spans a pattern has, in code points."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from semblance.llm.text import hex_sha256

SPAN = "struct<kind:string,start:int,stop:int,value:string>"


def none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def matches(text: Column, pattern: str, kind: str, value: int = 0) -> Column:
    """Leftmost non-overlapping matches as (kind, start, stop, value), where ``value`` is a group's text.

    What lies between the matches gives their places: the lengths before a match add up to its start.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = hits if value == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(value))
    steps = F.zip_with(
        F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(hits)), hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("own"))),
        values, lambda s, v: F.struct(s["gap"].alias("gap"), s["own"].alias("own"), v.alias("value")),
    )
    walked = F.aggregate(
        steps, F.struct(F.lit(0).alias("at"), none().alias("out")),
        lambda acc, s: F.struct(
            (acc["at"] + s["gap"] + s["own"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                F.lit(kind).alias("kind"), (acc["at"] + s["gap"]).alias("start"), (acc["at"] + s["gap"] + s["own"]).alias("stop"), s["value"].alias("value"),
            ))).alias("out"),
        ),
    )
    return F.when(text.rlike(pattern), walked["out"]).otherwise(none())


def outside(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: (o["start"] < s["stop"]) & (s["start"] < o["stop"])))


def listed(spans: Column, kinds: Sequence[str]) -> Column:
    """``kind:start:stop`` by start, then by the kinds' order, comma-joined."""
    order = F.array(*[F.lit(k) for k in kinds])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("place"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def digest(base: str, more: str, base_kinds: Sequence[str], kinds: Sequence[str]) -> list[Column]:
    """Counts of the base kinds, their digest, and all spans as text."""
    return [
        *[count_of(F.col(base), k).alias(f"n_{k}") for k in base_kinds], hex_sha256(listed(F.col(base), base_kinds)).alias("base_sha256"),
        listed(F.concat(base, more), kinds).alias("spans"),
    ]


def constant(values: Sequence[float], kind: str) -> Column:
    """A constant array; the optimiser folds it into one literal."""
    return F.from_json(F.lit(str(list(values))), f"array<{kind}>")


Rule = Callable[[Column], Column]
