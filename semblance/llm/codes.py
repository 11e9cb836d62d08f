"""Vector code compression: product codes of integer vectors, by exact whole-number rounds.

A vector is cut into equal parts.  The parts of one position are sorted along a
Hilbert curve and laid down in flat blocks; a block stores its vectors, their
min/max box and their sum.  In each round the squared distances from every
codebook entry to the box (nearest and farthest point) leave a shortlist for the
block, thinned by the entries that another one beats in every point of the box.
A shortlist of one takes the block by its sum alone; else a small exact kernel
compares the block's vectors with the shortlist.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semblance.llm.text import kept_rows, picked
from semblance.session import ship, written

PARTS, ENTRIES, ROUNDS, UNIT = 4, 256, 4, 1_024
BLOCK = 128  # vectors of a block
CELL_BITS = 4  # bits of a component on the curve
MOST = 1 << 27  # magnitude of an integer component below which all sums of squares are exact

PLACED = "part int, key binary, rid long, x binary"
BLOCKS = "part int, n int, rids binary, data binary, low binary, high binary, total binary"


def hilbert_keys(cells: np.ndarray, bits: int = CELL_BITS) -> np.ndarray:
    """The place along the Hilbert curve of points with unsigned ``bits``-bit coordinates, as big-endian byte rows.

    Coordinates are turned into the curve's transposed index (exchange and inversion of the low bits from the top level
    down, then Gray code), whose bits are interleaved.
    """
    x = cells.astype(np.uint32).T.copy()
    level = 1 << (bits - 1)
    while level > 1:
        low = np.uint32(level - 1)
        for axis in range(len(x)):
            high = (x[axis] & np.uint32(level)) != 0
            swap = np.where(high, np.uint32(0), (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(high, low, swap)
            x[axis] ^= swap
        level >>= 1
    for axis in range(1, len(x)):
        x[axis] ^= x[axis - 1]
    flip = np.zeros(x.shape[1], np.uint32)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint32(b)) & np.uint32(1), np.uint32((1 << b) - 1), np.uint32(0))
    x ^= flip
    planes = [(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


def shortlists(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """(blocks, entries) true where the entry can be the nearest of a point of the block's box, ties included."""
    lo, hi, c = low[:, None, :], high[:, None, :], book[None]
    below, above = lo - c, c - hi
    near = np.square(np.maximum(np.maximum(below, above), 0)).sum(axis=2)
    far = np.square(np.maximum(np.abs(below), np.abs(above))).sum(axis=2)
    listed = near <= far.min(axis=1, keepdims=True)
    # |x - rival|^2 < |x - c|^2 in the whole box: the difference is linear in x, so a corner decides.
    centre = low + high
    rival = book[np.square(centre[:, None, :] - 2 * c).sum(axis=2).argmin(axis=1)][:, None, :]
    slope = 2 * (c - rival)
    worst = np.maximum(slope * lo, slope * hi).sum(axis=2)
    return listed & (worst >= np.square(c).sum(axis=2) - np.square(rival).sum(axis=2))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row, the lowest on ties, and its squared distance, exactly."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)), 1)
    kind = np.float64 if 4 * x.shape[1] * top * top < 1 << 53 else np.int64  # doubles hold all whole numbers up to there
    own, c = x.astype(kind), book.astype(kind)
    away = np.square(c).sum(axis=1) - 2 * (own @ c.T)
    best = away.argmin(axis=1)
    return best, (away[np.arange(len(x)), best] + np.square(own).sum(axis=1)).astype(np.int64)


def _block(batch: pa.RecordBatch, name: str, i: int, kind, size: int) -> np.ndarray:
    return np.frombuffer(batch.column(name)[i].as_buffer(), kind).reshape(-1, size)


@dataclass
class Codebooks:
    """The entries of each part position: whole numbers in an array (entries, size)."""

    books: list[np.ndarray]

    def sha256(self) -> str:
        return hashlib.sha256(",".join([str(v) for b in self.books for v in b.ravel().tolist()]).encode()).hexdigest()

    def moved(self, sums: list) -> "Codebooks":
        """Every used entry at the floor of its parts' mean; ``sums`` has rows (part, entry, n, total)."""
        books = [b.copy() for b in self.books]
        for r in sums:
            books[r.part][r.entry] = [t // r.n for t in r.total]
        return Codebooks(books)


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None, unit: int, parts: int) -> DataFrame:
    """(rid, id, label, x) of the kept rows, x the integer components; written out."""
    names = [id_col, vector_col] + ([label_col] if label_col else [])
    plain = picked(vectors, *names).toDF("id", "v", *(["label"] if label_col else []))
    if not label_col:
        plain = plain.withColumn("label", F.lit(None).cast("int"))
    doubles = F.transform("v", lambda c: c.cast("double"))
    sound = F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    scaled = plain.where(sound).select("id", "label", F.transform(doubles, lambda c: F.floor(c * float(unit))).alias("x"), doubles.alias("v"))
    usual = (
        scaled.groupBy(F.size("x").alias("n")).agg(F.count(F.lit(1)).alias("rows")).where((F.col("n") > 0) & (F.col("n") % parts == 0))
        .orderBy(F.desc("rows"), F.desc("n")).first()
    )
    size = usual.n if usual else 0
    large = F.exists("v", lambda c: F.abs(c) * float(unit) >= float(MOST))
    message = F.lit(f"A component times {unit} is not below {MOST}; exact sums need smaller ones.")
    x = F.when(large, F.raise_error(message).cast("array<int>")).otherwise(F.transform("x", lambda c: c.cast("int")))
    return kept_rows(scaled.where((F.size("x") == size) & (F.size("x") > 0)).select("id", "label", x.alias("x")))


def first_entries(rows: DataFrame, parts: int, entries: int) -> Codebooks:
    """The parts of the vectors of the smallest ids; nulls come last, equal ids in the order of their vectors."""
    first = rows.select("id", "x").orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()
    x = np.array([r.x for r in first], np.int64)
    return Codebooks(np.split(x, parts, axis=1) if len(x) else [])


def blocks_of(rows: DataFrame, size: int, parts: int, block: int = BLOCK) -> DataFrame:
    """Flat blocks of each position's parts, in the order of the Hilbert curve, written out.

    The curve's cells are about the mean and spread of each component, which shapes the work and never the result.
    Equal parts follow each other by row number, so a range of the sort ends inside them where they are very many.
    """
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(size * parts), np.zeros(size * parts)
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size * parts).astype(float)
            n, s, q = n + len(x), s + x.sum(axis=0), q + np.square(x).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"pos": np.arange(len(s), dtype=np.int32), "n": np.full(len(s), n), "s": s, "q": q})

    seen = rows.select("x").mapInArrow(moments, "pos int, n long, s double, q double").groupBy("pos").agg(F.sum("n"), F.sum("s"), F.sum("q")).orderBy("pos").collect()
    count, s, q = (np.array(v, float) for v in list(zip(*seen))[1:])
    mean = s / count
    spread = np.sqrt(np.maximum(q / count - mean * mean, 0)) + 1e-9
    half = 1 << (CELL_BITS - 1)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size * parts).astype(np.int32)
            cells = np.clip(np.floor((x - mean) / spread * (half / 2)) + half, 0, 2 * half - 1).astype(np.uint32)
            for p in range(parts):
                cut = slice(p * size, (p + 1) * size)
                keys, own = hilbert_keys(cells[:, cut]), np.ascontiguousarray(x[:, cut])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), p, np.int32)), pa.array([k.tobytes() for k in keys], pa.binary()), batch.column("rid"), pa.array([v.tobytes() for v in own], pa.binary())],
                    ["part", "key", "rid", "x"],
                )

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            x = np.frombuffer(b"".join([h[2] for h in held]), np.int32).reshape(-1, size)
            rids = np.array([h[1] for h in held], np.int64)
            cells = [x.tobytes(), x.min(axis=0).tobytes(), x.max(axis=0).tobytes(), x.sum(axis=0, dtype=np.int64).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(
                [held[0][0], len(held), rids.tobytes(), *cells], [pa.int32(), pa.int32()] + [pa.binary()] * 5)], ["part", "n", "rids", "data", "low", "high", "total"])

        for batch in batches:
            for row in zip(batch.column("part").to_pylist(), batch.column("rid").to_pylist(), batch.column("x").to_pylist()):
                if held and (row[0] != held[0][0] or len(held) == block):
                    yield out()
                    held = []
                held.append(row)
        if held:
            yield out()

    curve = rows.select("rid", "x").mapInArrow(placed, PLACED).repartitionByRange("part", "key", "rid").sortWithinPartitions("part", "key", "rid")
    return written(curve.select("part", "rid", "x").mapInArrow(laid, BLOCKS))


def _compared(batch: pa.RecordBatch, books: list[np.ndarray], group: int = 64) -> Iterator[tuple]:
    """(row, part, vectors, listed entries) of every block of a batch; boxes are compared for many blocks at once."""
    part = batch.column("part").to_numpy()
    for p in np.unique(part):
        at, book = np.flatnonzero(part == p), books[p]
        size = book.shape[1]
        for i in range(0, len(at), group):
            rows = at[i : i + group]
            low, high = (np.concatenate([_block(batch, c, int(r), np.int32, size) for r in rows]).astype(np.int64) for c in ("low", "high"))
            for r, listed in zip(rows, shortlists(low, high, book)):
                yield int(r), int(p), np.flatnonzero(listed)


def sums_of(blocks: DataFrame, books: Codebooks) -> list:
    """Rows (part, entry, n, total) of the used entries: a row for each entry of the codebooks at most."""
    own = books.books
    size, entries = own[0].shape[1], len(own[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((len(own), entries), np.int64), np.zeros((len(own), entries, size), np.int64)
        for batch in batches:
            for r, p, listed in _compared(batch, own):
                if len(listed) == 1:
                    n[p, listed[0]] += batch.column("n")[r].as_py()
                    total[p, listed[0]] += _block(batch, "total", r, np.int64, size)[0]
                    continue
                x = _block(batch, "data", r, np.int32, size)
                best = listed[nearest(x, own[p][listed])[0]]
                np.add.at(total[p], best, x)
                n[p] += np.bincount(best, minlength=entries)
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))],
            ["part", "entry", "n", "total"],
        )

    at = lambda i: F.sum(F.get("total", F.lit(i)))
    return (
        blocks.mapInArrow(run, "part int, entry int, n long, total array<long>").groupBy("part", "entry")
        .agg(F.sum("n").alias("n"), F.array(*[at(i) for i in range(size)]).alias("total")).collect()
    )


def coded(blocks: DataFrame, books: Codebooks) -> DataFrame:
    """(rid, part, entry, error) of every part."""
    own = books.books
    size = own[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, p, listed in _compared(batch, own):
                best, error = nearest(_block(batch, "data", r, np.int32, size), own[p][listed])
                rids = np.frombuffer(batch.column("rids")[r].as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rids), pa.array(np.full(len(rids), p, np.int32)), pa.array(listed[best].astype(np.int32)), pa.array(error)], ["rid", "part", "entry", "error"]
                )

    return blocks.mapInArrow(run, "rid long, part int, entry int, error long")


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS,
    entries: int = ENTRIES, rounds: int = ROUNDS, unit: int = UNIT, block: int = BLOCK,
) -> tuple[DataFrame, Codebooks]:
    """One row per kept row: vec_id, label, codes (array of entries by part), error; and the final codebooks.

    Rows without a vector, or with a null or non-finite component, are dropped, and so are vectors of another length than
    the most frequent one that is a multiple of ``parts`` (the longest on ties; empty vectors are never kept).  Components
    of 131,072 and more end the job with an error, as their squares would not add up exactly.  Ties go to the lower entry;
    repeated rows each give a row; null ids seed the codebooks last; fewer rows than ``entries`` make smaller codebooks and
    an empty table empty ones; other columns are not read.  The codebooks' size is fixed by the parameters and the length.
    """
    spark: SparkSession = vectors.sparkSession
    ship(spark)
    rows = whole_vectors(vectors, id_col, vector_col, label_col, unit, parts)
    books = first_entries(rows, parts, entries)
    base = rows.select("rid", F.col("id").alias("vec_id"), "label")
    if not books.books:
        return base.select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")), books
    blocks = blocks_of(rows, books.books[0].shape[1], parts, block)
    for _ in range(rounds):
        books = books.moved(sums_of(blocks, books))
    entry = lambda p: F.max(F.when(F.col("part") == p, F.col("entry")))
    done = coded(blocks, books).groupBy("rid").agg(F.array(*[entry(p) for p in range(parts)]).alias("codes"), F.sum("error").alias("error"))
    return base.join(done, "rid").select("vec_id", "label", "codes", "error"), books


def digest(found: DataFrame, books: Codebooks) -> DataFrame:
    """Codes as hex digits, the error summed over each label (nulls together), and the codebooks' digest."""
    found = written(found)
    by_label = found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label")
    hexed = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return found.join(by_label, F.col("label").eqNullSafe(F.col("__label"))).select(
        "vec_id", hexed.alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")
    )
