"""Reversible line deduplication over sharded cuckoo filters and exact reference counts.

State, as three tables keyed by shard (the leading bits of a line key's hash):
``postings`` (key, doc_id), ``counts`` (key, n_docs, max_doc) and ``filters``, one
cuckoo filter a shard of the keys that are common enough to go.  Documents can be
put in and taken out; counts stay exact and a filter loses a key again when its
count falls below the limit.  A filter only spares lines the exact join, so its
false positives change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semblance.llm.text import body, hex_sha256, lowered, named, picked
from semblance.session import materialised, ship

MIN_DOCS = 3
MIN_CHARS = 20
SHARD_KEYS = 50_000  # common keys of a shard, about
FILTER_BYTES = 64 << 20  # filters together up to this size are broadcast; beyond it every line takes the exact join
ROWS_TO_SEND = 200_000  # counts of common keys up to this number are broadcast, joined by shuffle beyond

SLOTS = 4


class CuckooFilter:
    """Buckets of four 32-bit prints; a key's print may stand in two buckets.  Insert, delete, look up."""

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.buckets = buckets  # a power of two
        self.table = np.zeros((buckets, SLOTS), np.uint32) if table is None else table

    @classmethod
    def holding(cls, hashes: np.ndarray) -> "CuckooFilter":
        """A filter of these keys, at most half full at first and twice as large whenever an insert finds no place."""
        buckets = 1 << max(3, (len(hashes) // 2).bit_length())
        while True:
            made = cls(buckets)
            if all(made.insert(p, i) for p, i in zip(*(x.tolist() for x in made._print(hashes)))):
                return made
            buckets *= 2

    def _print(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = hashes.astype(np.int64).view(np.uint64)
        prints = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        prints[prints == 0] = 1
        return prints, ((h >> np.uint64(32)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def _other(self, bucket, prints):
        return bucket ^ ((prints * 0x5BD1E995 >> 7) & (self.buckets - 1))

    def insert(self, p: int, i: int) -> bool:
        table = self.table
        for turn in range(500):
            for b in (i, self._other(i, p)):
                for s in range(SLOTS):
                    if table[b, s] == 0:
                        table[b, s] = p
                        return True
            i = self._other(i, p)
            s = turn % SLOTS
            p, table[i, s] = int(table[i, s]), p
            i = self._other(i, p)
        return False

    def delete(self, hashes: np.ndarray) -> None:
        """Take out keys that were put in."""
        for p, i in zip(*(x.tolist() for x in self._print(hashes))):
            for b in (i, self._other(i, p)):
                at = np.flatnonzero(self.table[b] == p)
                if len(at):
                    self.table[b, at[0]] = 0
                    break

    def has(self, hashes: np.ndarray) -> np.ndarray:
        prints, first = self._print(hashes)
        second = self._other(first, prints.astype(np.int64))
        p = prints[:, None]
        return (self.table[first] == p).any(axis=1) | (self.table[second] == p).any(axis=1)

    def pack(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def unpack(cls, packed: bytes) -> "CuckooFilter":
        table = np.frombuffer(packed, np.uint32).reshape(-1, SLOTS).copy()
        return cls(len(table), table)


@dataclass
class LineIndex:
    """The state; ``bits`` leading bits of k1 name a shard."""

    postings: DataFrame  # k1, k2, doc_id
    counts: DataFrame  # k1, k2, n_docs, max_doc: of all keys
    filters: DataFrame  # shard, packed
    bits: int
    min_docs: int = MIN_DOCS
    min_chars: int = MIN_CHARS


def line_key(line: Column) -> Column:
    return lowered(F.btrim(line, F.lit(" \t\n\v\f\r")))


def lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc_id, h, pos, k1, k2) of every line whose key is long enough; h is the text's hash."""
    text = picked(docs, id_col, text_col).select(named(id_col).alias("doc_id"), body(text_col).alias("t"))
    cut = text.select("doc_id", F.xxhash64("t").alias("h"), F.posexplode(F.split("t", "\n", -1)).alias("pos", "line"))
    keyed = cut.select("doc_id", "h", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select("doc_id", "h", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("line"), "key").alias("k2"))


def shard(bits: int, k1: str = "k1") -> Column:
    return F.shiftrightunsigned(k1, 64 - bits).cast("int") if bits else F.lit(0)


def counted(postings: DataFrame) -> DataFrame:
    return postings.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc"))


def shard_bits(common: DataFrame) -> int:
    """Leading bits that leave about SHARD_KEYS common keys in a shard."""
    return max(0, (common.count() // SHARD_KEYS).bit_length())


def filters_of(common: DataFrame, bits: int) -> DataFrame:
    """A cuckoo filter for each shard of about SHARD_KEYS keys."""
    ship(common.sparkSession)

    def make(keys: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [int(keys["shard"].iloc[0])], "packed": [CuckooFilter.holding(keys["k1"].to_numpy()).pack()]})

    return common.select(shard(bits).alias("shard"), "k1").distinct().groupBy("shard").applyInPandas(make, "shard int, packed binary")


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> LineIndex:
    """The index of these documents.  Rows of one doc_id are one document; null is an id of its own, below all others."""
    postings = lines(docs, id_col, text_col, min_chars).select("k1", "k2", "doc_id").distinct()
    return _index(postings, min_docs, min_chars)


def _index(postings: DataFrame, min_docs: int, min_chars: int) -> LineIndex:
    counts = materialised(counted(postings))
    common = counts.where(F.col("n_docs") >= min_docs)
    bits = shard_bits(common)
    return LineIndex(postings, counts, materialised(filters_of(common, bits)), bits, min_docs, min_chars)


def insert(index: LineIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
    """Put documents in; those whose lines are already there change nothing."""
    more = lines(docs, id_col, text_col, index.min_chars).select("k1", "k2", "doc_id").distinct()
    return _moved(index, materialised(index.postings.union(more).distinct()))


def delete(index: LineIndex, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
    """Take documents out again; their lines' counts fall and filters lose the keys that are no longer common."""
    gone = ids.select(named(id_col).alias("gone")).distinct()
    left = index.postings.join(gone, F.col("doc_id").eqNullSafe(F.col("gone")), "left_anti")
    return _moved(index, materialised(left))


def _moved(index: LineIndex, postings: DataFrame) -> LineIndex:
    """The index over changed postings: only shards with keys that cross the limit get a changed filter.

    Where the common keys have outgrown the shards, all filters are made anew over more of them.
    """
    ship(postings.sparkSession)
    counts = materialised(counted(postings))
    met = counts.where(F.col("n_docs") >= index.min_docs)
    if (bits := shard_bits(met)) > index.bits:
        return LineIndex(postings, counts, materialised(filters_of(met, bits)), bits, index.min_docs, index.min_chars)
    common = lambda c: c.where(F.col("n_docs") >= index.min_docs).select(shard(index.bits).alias("shard"), "k1").distinct()
    before, after = common(index.counts), common(counts)
    step = after.exceptAll(before).withColumn("add", F.lit(True)).union(before.exceptAll(after).withColumn("add", F.lit(False)))

    def change(key: tuple, steps: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        made = CuckooFilter.unpack(held["packed"].iloc[0]) if len(held) else CuckooFilter.holding(np.empty(0, np.int64))
        if len(steps):
            made.delete(steps.loc[~steps["add"], "k1"].to_numpy())
            for p, i in zip(*(x.tolist() for x in made._print(steps.loc[steps["add"], "k1"].to_numpy()))):
                if not made.insert(p, i):
                    return pd.DataFrame({"shard": [key[0]], "packed": [None]})
        return pd.DataFrame({"shard": [key[0]], "packed": [made.pack()]})

    changed = step.groupBy("shard").cogroup(index.filters.groupBy("shard")).applyInPandas(change, "shard int, packed binary")
    changed = materialised(changed)
    # A filter that ran full is made anew, larger.
    full = after.join(changed.where("packed IS NULL").select("shard"), "shard", "left_semi")
    filters = changed.where("packed IS NOT NULL").union(filters_of(full, index.bits))
    return LineIndex(postings, counts, materialised(filters), index.bits, index.min_docs, index.min_chars)


def maybe_common(found: DataFrame, index: LineIndex) -> DataFrame:
    """Without the lines that the filters rule out, where the filters are small enough to send."""
    size = index.filters.agg(F.sum(F.octet_length("packed"))).first()[0] or 0
    if size > FILTER_BYTES:
        return found
    sent = found.sparkSession.sparkContext.broadcast({r.shard: bytes(r.packed) for r in index.filters.collect()})
    bits = index.bits
    ship(found.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {s: CuckooFilter.unpack(p) for s, p in sent.value.items()}
        for batch in batches:
            k1 = batch.column("k1").to_numpy()
            shards = (k1.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(k1), np.int64)
            keep = np.zeros(len(k1), bool)
            for s in np.unique(shards):
                if s in held:
                    at = np.flatnonzero(shards == s)
                    keep[at] = held[s].has(k1[at])
            yield batch.filter(pa.array(keep))

    return found.mapInArrow(run, found.schema)


def drops(docs: DataFrame, index: LineIndex, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h, at): the sorted positions that each text loses."""
    found = maybe_common(lines(docs, id_col, text_col, index.min_chars), index)
    common = index.counts.where(F.col("n_docs") >= index.min_docs)
    if common.count() <= ROWS_TO_SEND:
        common = F.broadcast(common)
    gone = found.join(common, ["k1", "k2"]).where(~F.col("doc_id").eqNullSafe(F.col("max_doc")))
    return gone.groupBy("doc_id", "h").agg(F.collect_set("pos").alias("at"))


def kept(docs: DataFrame, index: LineIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``text_col`` reduced to its other lines, and n_lines and n_dropped.

    A line's key is the line without white space at the ends and with A-Z in lower case.  Keys of at least
    ``min_chars`` code points in at least ``min_docs`` documents of the index lose all lines except in the largest
    doc_id that holds the key.  Null and empty texts are one empty line, and the result is empty, not null.  Rows of
    one doc_id count as one document and each is reduced; the null id is the smallest one.  Result columns named
    n_lines and n_dropped replace columns of that name in any spelling of case.  Keys are told apart by 128 bits of hash.
    """
    index = index or build(docs, id_col, text_col)
    at = drops(docs, index, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.col("at").alias("__at"))
    # Columns by place, as their names can be any.
    stay = [i for i, c in enumerate(docs.columns) if c.lower() not in ("n_lines", "n_dropped")]
    id_at, text_at = f"c{docs.columns.index(id_col)}", f"c{docs.columns.index(text_col)}"
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).withColumn(text_at, body(text_at))
    same = F.col(id_at).eqNullSafe(F.col("__id")) & (F.xxhash64(text_at) == F.col("__h"))
    met = rows.join(at, same, "left").withColumn("__lines", F.split(text_at, "\n", -1))
    n = F.size("__lines")
    left = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), F.col("__at")), lambda i: F.get("__lines", i))
    text = F.when(F.col("__at").isNull(), F.col(text_at)).otherwise(F.array_join(left, "\n"))
    return met.select(
        *[text if f"c{i}" == text_at else F.col(f"c{i}") for i in stay], n.cast("long"), F.coalesce(F.size("__at"), F.lit(0)).cast("long"),
    ).toDF(*[docs.columns[i] for i in stay], "n_lines", "n_dropped")


def digest(reduced: DataFrame) -> DataFrame:
    reduced = picked(reduced, "doc_id", "n_lines", "n_dropped", "text")
    return reduced.select("doc_id", "n_lines", F.greatest("n_dropped", F.lit(0)).alias("n_dropped"), hex_sha256(F.col("text")).alias("kept_sha256"))
