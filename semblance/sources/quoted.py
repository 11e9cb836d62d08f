"""CSV records with line breaks inside quotes, read in splits.

Whether a line lies inside a quoted field depends on all lines before it.  So each
split of a file first tells how it would end from either beginning; a row for each
split is enough to know how each one really begins.  Then all splits put their records
together at once, and only a record that crosses their borders is joined from parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semblance.session import ship

ENDS = "file string, block long, after_outside boolean, after_inside boolean, starts_outside long, starts_inside long"
PARTS = "file string, owner long, seq long, text string, whole boolean, first boolean"


def goes_on(line: str, inside: bool, quote: str, comma: str = ",") -> bool:
    """Whether a quoted field is open behind a line that begins ``inside`` one or not.

    A quote opens a field only at its beginning; inside, two stand for one.
    """
    at = 0
    while True:
        if inside:
            end = line.find(quote, at)
            while end >= 0 and line.startswith(quote, end + 1):
                end = line.find(quote, end + 2)
            if end < 0:
                return True
            at = end + 1
        elif line.startswith(quote, at):
            inside, at = True, at + 1
            continue
        inside = False
        end = line.find(comma, at)
        if end < 0:
            return False
        at = end + 1


def _lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(file, block, value): lines, each with its file and where its split begins."""
    lines = spark.read.option("pathGlobFilter", glob).option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """Each split's lines, which stand together and in order; a split may go on over several batches."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for key, group in groupby(rows, key=lambda row: row[:2]):
        yield key, (row[2] for row in group)


def records(spark: SparkSession, path: str, glob: str, quote: str) -> DataFrame:
    """(file, text, first): all records of the files, and whether they are their file's first."""
    ship(spark)
    lines = _lines(spark, path, glob)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), own in _by_split(batches):
            state, starts = [False, True], [0, 0]
            for line in own:
                for i in (0, 1):
                    starts[i] += not state[i]
                if quote in line:
                    state = [goes_on(line, s, quote) for s in state]
            cells = [file, block, state[0], state[1], *starts]
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()])],
                                             [c.split()[0] for c in ENDS.split(", ")])

    # A row for each split; from the first to the last, each begins as the one before it ends.
    begins: dict[tuple[str, int], tuple[bool, int]] = {}
    for _, splits in groupby(lines.mapInArrow(ends, ENDS).orderBy("file", "block").collect(), key=lambda r: r["file"]):
        inside, owner = False, -1
        for r in splits:
            begins[r["file"], r["block"]] = (inside, owner)
            starts = r["starts_inside"] if inside else r["starts_outside"]
            owner = r["block"] if starts else owner
            inside = r["after_inside"] if inside else r["after_outside"]
    known = spark.sparkContext.broadcast(begins)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*held), [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()])], [c.split()[0] for c in PARTS.split(", ")]
            )

        for (file, block), own in _by_split(batches):
            inside, owner = known.value[file, block]
            # The open record's lines; a record that began in an earlier split is a part whatever comes.
            open_lines, from_before, first = [], inside, block == 0
            for line in own:
                open_lines.append(line)
                if quote in line:
                    inside = goes_on(line, inside, quote)
                if not inside:
                    held.append((file, owner if from_before else block, block, "\n".join(open_lines), not from_before, first))
                    open_lines, from_before, first = [], False, False
                    if len(held) == 4_096:
                        yield out()
                        held = []
            if open_lines:
                held.append((file, owner if from_before else block, block, "\n".join(open_lines), False, first))
        if held:
            yield out()

    made = lines.mapInArrow(parts, PARTS)
    crossing = made.where("NOT whole").groupBy("file", "owner").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda p: p["text"]), "\n").alias("text"), F.max("first").alias("first")
    )
    whole = made.where("whole").select("file", "text", "first")
    # Carriage returns belong to the line ends; empty lines are no records.
    both = whole.unionByName(crossing.select("file", "text", "first"))
    return both.select("file", F.regexp_replace("text", "\r$", "").alias("text"), "first").where(F.trim("text") != "")
