"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into segments, each with a small radius; the radii
plus one add up to the distance plus one, so two fingerprints within the distance
are within the radius in some segment.  One side enumerates the Hamming ball of
its segment value, the other stands in the table by its own, and the complete
distance decides.

Groups of near copies make no pairs.  Equal fingerprints are one node.  Two
fingerprints within a distance share a point of their balls of half that radius,
so every holder of a point is tied to the smallest one: at distance 2 before the
segments, which then look only for links between the classes this leaves, and at
the whole distance for the fingerprints of a bucket that holds more of them than
such a ball has points.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semblance.llm.graph import components
from semblance.llm.text import LOWER, UPPER, kept_rows, picked
from semblance.session import materialised, ship

WORDS, SEED = 4, 42
DISTANCE = 4
# (first bit, bits, radius): radii plus one add up to DISTANCE + 1.
SEGMENTS = ((0, 23, 1), (23, 23, 1), (46, 18, 0))
BITS = 64
GRAMS = 4_096  # shingles whose bits are counted at once
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str | None, size: int = WORDS, seed: int = SEED) -> int:
    """Majority of each bit over the XXH64 of all word shingles; no words give zero."""
    # bytes.split() parts at exactly the six white-space characters of ASCII.
    words = (text or "").encode().translate(_FOLD).split()
    if not words:
        return 0
    counts, total = np.zeros(64, dtype=np.int64), max(1, len(words) - size + 1)
    for first in range(0, total, GRAMS):
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), seed) for i in range(first, min(total, first + GRAMS))]
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for each row; fp is the fingerprint as a signed long.  Null texts have no words."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    plain = picked(docs, id_col, text_col).toDF("doc_id", "text")
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def _flips(size: int, first: int = 0) -> list[int]:
    """Every choice of that many bits, as signed longs."""
    if size == 0:
        return [0]
    return [(1 << b if b < BITS - 1 else -(1 << b)) ^ rest for b in range(first, BITS) for rest in _flips(size - 1, b + 1)]


def ties(fps: DataFrame, distance: int) -> DataFrame:
    """Edges (a, b) between fingerprints (column ``fp``) within the distance that connect all such pairs.

    A pair within the distance shares a point of the smaller one's inner ball (half the distance, rounded down) and the
    other's outer ball (rounded up), and whatever shares such a point is within the distance.  So the smallest inner
    holder of a point is tied to all holders, of which there are no more than points in the outer ball.
    """
    inner, outer = distance // 2, (distance + 1) // 2
    balls = [f for r in range(outer + 1) for f in _flips(r)]
    near = sum(comb(BITS, r) for r in range(inner + 1))
    points = F.array(*[F.struct(F.lit(f).cast("long").alias("flip"), F.lit(i < near).alias("inner")) for i, f in enumerate(balls)])
    held = fps.select("fp", F.explode(points).alias("p")).select("fp", F.col("fp").bitwiseXOR(F.col("p.flip")).alias("point"), "p.inner")
    least = F.min(F.when(F.col("inner"), F.col("fp"))).over(Window.partitionBy("point"))
    tied = held.select(F.col("fp").alias("b"), least.alias("a")).where("a != b")
    return tied.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(classes: DataFrame, distance: int = DISTANCE, segments: tuple = SEGMENTS, hot: int | None = None) -> DataFrame:
    """Edges (a, b) between the classes of fingerprints (columns ``fp`` and ``label``, written out) within the distance.

    They connect what all pairs of fingerprints within the distance connect; two classes have one edge however many
    of their fingerprints are near.  Buckets of more than ``hot`` fingerprints are tied by points instead of compared.
    """
    if sum(r + 1 for _, _, r in segments) < distance + 1 or any(r > 1 for _, _, r in segments):
        raise ValueError("the segments' radii do not cover the distance")
    hot = sum(comb(BITS, i) for i in range((distance + 1) // 2 + 1)) if hot is None else hot
    value = [F.shiftrightunsigned("fp", at).bitwiseAND((1 << bits) - 1) for at, bits, _ in segments]
    stands = F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), v.alias("key")) for s, v in enumerate(value)]))
    balls = F.explode(F.array(*[
        F.struct(F.lit(s).alias("seg"), v.bitwiseXOR(flip).alias("key"))
        for s, (v, (_, bits, radius)) in enumerate(zip(value, segments)) for flip in [0] + [1 << i for i in range(bits) if radius]
    ]))
    table = classes.select("fp", "label", stands.alias("t")).select(F.col("fp").alias("b"), F.col("label").alias("of_b"), "t.seg", "t.key")
    probes = classes.select("fp", "label", balls.alias("t")).select(F.col("fp").alias("a"), F.col("label").alias("of_a"), "t.seg", "t.key")
    full = materialised(table.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("seg", "key"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    pair = [F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")]
    if not full.isEmpty():
        crowd = probes.join(full, ["seg", "key"]).select(F.col("a").alias("fp"), F.col("of_a").alias("label")).distinct()
        crowd = materialised(crowd)
        tied = ties(crowd.select("fp"), distance).join(crowd.select(F.col("fp").alias("a"), F.col("label").alias("of_a")), "a")
        tied = tied.join(crowd.select(F.col("fp").alias("b"), F.col("label").alias("of_b")), "b").where("of_a != of_b").select(*pair)
        table = table.join(full, ["seg", "key"], "left_anti")
    met = (probes["seg"] == table["seg"]) & (probes["key"] == table["key"]) & (F.col("of_a") < F.col("of_b")) & near
    found = probes.join(table, met).select(*pair)
    return (found if full.isEmpty() else found.unionByName(tied)).distinct()


def classes(fps: DataFrame, distance: int = DISTANCE, segments: tuple = SEGMENTS) -> DataFrame:
    """(fp, label) of distinct fingerprints (column ``fp``, written out): the smallest one reachable over links."""
    first = components(materialised(ties(fps, min(2, distance))))
    first = materialised(fps.join(first, fps["fp"] == first["node"], "left").select("fp", F.coalesce("label", "fp").alias("label")))
    merged = components(materialised(links(first, distance, segments))).select(F.col("node").alias("label"), F.col("label").alias("least"))
    return first.join(merged, "label", "left").select("fp", F.coalesce("least", "label").alias("label"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, segments: tuple = SEGMENTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id.

    The component is the smallest doc_id reachable over links, itself included; null ids do not name a component
    (null only where all ids of a component are).  Texts without words, null ones too, have fingerprint zero and link
    like any other; repeated rows link to each other; empty tables stay empty; other columns are not read.
    """
    rows = kept_rows(fingerprints(docs, id_col, text_col))
    nodes = materialised(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    of = materialised(nodes.join(classes(nodes.select("fp"), distance, segments), "fp"))
    # Written out, so that the joins read plain exchanges, which Spark splits where one group has many rows.
    least = materialised(of.groupBy("label").agg(F.min("first").alias("component_id")))
    known = materialised(of.join(least, "label").select("fp", "component_id"))
    return rows.join(known, "fp").select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
