"""Substring deduplication by seed and extend.

Every window of ``size`` words selects an anchor, the smallest k-gram in it, so
documents that share a window share its anchor.  The consecutive windows that
select one anchor make its stretch.  Documents join on anchors, and extension
goes both ways from the anchor in two steps, without pairing documents up:

1. equal stretches (anchor, words to the left and right): all holders but those
   of the smallest id lose the stretch's windows;
2. where an anchor has several stretches, the first holder of each opens it into
   its windows, and equal windows meet the same way.

The windows found are merged into maximal repeats.  Nothing is emitted for pairs
of documents, so a passage in a third of all documents costs a row for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from semblance.llm.text import body, hex_sha256, named, picked
from semblance.session import materialised, ship, written

SIZE = 50  # words that make a repeat
GRAM = 8  # words of an anchor
CHUNK = 2 << 20  # characters that a worker handles at once, or one longer text
ROWS_TO_SEND = 500_000  # keys are broadcast up to this counted number, joined by shuffle beyond

_U = np.uint64
_BASE, _BACK = _U(0x9E3779B97F4A7C15), _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _BACK)):
            steps = np.full(n, base, _U)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class Words:
    """The words of some texts, hashed twice, with the hash of any run of words at hand."""

    def __init__(self, texts: list[str], size: int = SIZE, gram: int = GRAM):
        self.size, self.gram = size, gram
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        flat = split.flatten().dictionary_encode()
        # Leading and trailing white space leaves empty strings.
        full = pc.not_equal(pc.binary_length(flat.dictionary), 0).to_numpy(zero_copy_only=False)
        codes = flat.indices.to_numpy()
        real = full[codes] if len(codes) else np.zeros(0, bool)
        before = np.concatenate([[0], np.cumsum(real)])
        # List offsets of a slice start where the slice does.
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        self.bounds = before[bounds]
        digests = [xxhash.xxh3_128_intdigest(w) for w in flat.dictionary.cast(pa.large_binary()).to_pylist()]
        one = np.array([d & 0xFFFFFFFFFFFFFFFF for d in digests], _U)
        two = np.array([d >> 64 for d in digests], _U)
        codes = codes[real]
        self.n = len(codes)
        up, self.down = _power(self.n + 1)
        zero = np.zeros(1, _U)
        self.sums = [np.concatenate([zero, np.cumsum(x[codes] * up[: self.n], dtype=_U)]) if self.n else zero for x in (one, two)]

    def run(self, which: int, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[which][stop] - self.sums[which][first]) * self.down[first])

    def stretches(self) -> dict[str, np.ndarray]:
        """doc, low, high (first and last window start), anchor, g1, g2 of every stretch."""
        low_of, high_of = self.bounds[:-1], self.bounds[1:] - self.size
        have = high_of >= low_of
        docs = np.flatnonzero(have)
        if not len(docs):
            return {k: np.zeros(0, np.int64) for k in ("doc", "low", "high")} | {k: np.zeros(0, _U) for k in ("anchor", "g1", "g2")}
        counts = (high_of - low_of + 1)[docs]
        doc = np.repeat(docs, counts)
        starts = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low_of[docs], counts)
        grams = np.arange(self.n - self.gram + 1)
        value = self.run(0, grams, grams + self.gram)
        at, width, span = grams, 1, self.size - self.gram + 1
        best = value

        def joined(best, at, gap, length):
            right = best[gap : gap + length] <= best[:length]
            return np.where(right, best[gap : gap + length], best[:length]), np.where(right, at[gap : gap + length], at[:length])

        while 2 * width <= span:
            best, at = joined(best, at, width, len(best) - width)
            width *= 2
        if width < span:
            best, at = joined(best, at, span - width, len(best) - (span - width))
        anchor = at[starts]
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(doc)]]) - 1
        low, high, seed = starts[first], starts[last], anchor[first]
        shape = _mixed(((seed - low).astype(_U) << _U(32)) | (high - low).astype(_U))
        g = [_mixed(self.run(i, low, high + self.size) ^ shape) for i in (0, 1)]
        return {"doc": doc[first], "low": low, "high": high, "anchor": value[seed], "g1": g[0], "g2": g[1] & _U(0xFFFFFFFF)}


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(_U).view(np.int64)


def _short(x: np.ndarray) -> np.ndarray:
    """The low 32 bits."""
    return x.astype(np.uint32).view(np.int32)


def _chunks(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of about CHUNK characters."""
    sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > CHUNK:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += int(n)
    if first < batch.num_rows:
        yield batch.slice(first)


def stretches(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """(id, anchor, g1, g2) of all stretches of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch, 1):
                s = Words(part.column(1).to_pylist(), size, gram).stretches()
                ids = part.column(0).take(pa.array(s["doc"]))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(_signed(s[k])) for k in ("anchor", "g1")], pa.array(_short(s["g2"]))], ["id", "anchor", "g1", "g2"])

    return docs.mapInArrow(run, "id long, anchor long, g1 long, g2 int")


def windows(opened: DataFrame, size: int, gram: int) -> DataFrame:
    """(id, w1, w2) of the windows in the stretches named in ``open`` of (id, text, open), each once for a row of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch, 1):
                words = Words(part.column(1).to_pylist(), size, gram)
                s = words.stretches()
                named_in = part.column(2)
                owners = np.repeat(np.arange(part.num_rows), pc.list_value_length(named_in).to_numpy(zero_copy_only=False))
                # (document, stretch) pairs; a stretch is opened where its own document names it.
                names = named_in.flatten().to_numpy()
                pair = lambda doc, g: _mixed(doc.astype(_U) + _U(1)) ^ g.view(_U)
                at = np.flatnonzero(np.isin(pair(s["doc"], s["g1"]), pair(owners, names)))
                counts = (s["high"] - s["low"] + 1)[at]
                starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(s["low"][at], counts)
                w = [words.run(0, starts, starts + size), _short(words.run(1, starts, starts + size) & _U(0xFFFFFFFF))]
                doc = np.repeat(s["doc"][at], counts)
                order = np.lexsort((w[1], w[0], doc))
                new = np.ones(len(order), bool)
                new[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in (doc, *w)], axis=0)
                once = order[new]
                ids = part.column(0).take(pa.array(doc[once]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(_signed(w[0][once])), pa.array(w[1][once])], ["id", "w1", "w2"])

    return opened.mapInArrow(run, "id long, w1 long, w2 int")


def marked(found: DataFrame, kind: str, size: int, gram: int) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, repeats) of (doc_id, text, gone_g, gone_w)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch, 1):
                texts = part.column(1).to_pylist()
                hit = [i for i in range(part.num_rows) if len(part.column(2)[i]) or len(part.column(3)[i])]
                words = Words([texts[i] for i in hit], size, gram)
                s = words.stretches()
                gone = {}
                for j, i in enumerate(hit):
                    first, stop = words.bounds[j], words.bounds[j + 1]
                    own = slice(*np.searchsorted(s["doc"], [j, j + 1]))
                    low, high = s["low"][own], s["high"][own]
                    flags = np.zeros(stop - first + 1, np.int64)
                    whole = np.isin(_signed(s["g1"][own]), part.column(2)[i].values.to_numpy())
                    np.add.at(flags, low[whole] - first, 1)
                    np.add.at(flags, high[whole] + size - first, -1)
                    if len(part.column(3)[i]):
                        starts = np.arange(first, stop - size + 1)
                        single = starts[np.isin(_signed(words.run(0, starts, starts + size)), part.column(3)[i].values.to_numpy())]
                        np.add.at(flags, single - first, 1)
                        np.add.at(flags, single + size - first, -1)
                    gone[i] = np.cumsum(flags[:-1]) > 0
                rows = []
                for i, text in enumerate(texts):
                    split = text.encode().split()
                    mask = gone.get(i)
                    if mask is None or not mask.any():
                        rows.append((len(split), 0, b" ".join(split), []))
                        continue
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                    spans = [{"start": int(a), "stop": int(b)} for a, b in edges.reshape(-1, 2)]
                    rows.append((len(split), int(mask.sum()), b" ".join([w for w, g in zip(split, mask.tolist()) if not g]), spans))
                span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                     pa.array([r[2].decode() for r in rows], pa.string()), pa.array([r[3] for r in rows], span)],
                    ["doc_id", "n_words", "n_removed", "kept", "repeats"],
                )

    return found.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string, repeats array<struct<start:int,stop:int>>")


def _small(df: DataFrame) -> DataFrame:
    """The frame, broadcast where its counted rows are few."""
    return F.broadcast(df) if df.count() <= ROWS_TO_SEND else df


def later(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, id) whose keys a smaller id has too."""
    first = rows.groupBy(*keys).agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    return rows.join(_small(materialised(first.drop("last"))), keys).where("id > first")


def listed(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.groupBy("id").agg(F.collect_set(key).alias(name))


def ordered(docs: DataFrame) -> DataFrame:
    """The rows (doc_id, text) with a number ``id`` in the order of their doc_ids, equal where these are; null is the largest.

    Whole numbers stand for themselves; other ids are numbered along a range partitioning of the distinct ones, and
    so are whole numbers where a null would meet the largest of them.
    """
    last, by_itself = F.lit((1 << 63) - 1), isinstance(docs.schema["doc_id"].dataType, IntegralType)
    if by_itself:
        ends = docs.agg(F.max(F.col("doc_id").cast("long")).alias("top"), F.bool_or(F.col("doc_id").isNull()).alias("gap")).first()
        by_itself = not (ends["gap"] and ends["top"] == (1 << 63) - 1)
    if by_itself:
        return docs.withColumn("id", F.coalesce(F.col("doc_id").cast("long"), last))
    known = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("of")).distinct().repartitionByRange("of").sortWithinPartitions("of")
    known = materialised(known.select("of", F.monotonically_increasing_id().alias("id")))
    return docs.join(known, F.col("doc_id") == F.col("of"), "left").select("doc_id", "text", F.coalesce("id", last).alias("id"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept (the other words, one space between), repeats.

    A word goes when a window of ``size`` words over it stands in a document with a smaller doc_id too; ``repeats``
    are the maximal runs of such words (start, stop).  Windows are judged on the input.  Null and empty texts have no
    words.  Rows of one doc_id do not remove from each other; ids may be of any type that has an order, and
    a null id is larger than all others.  Empty tables stay
    empty; other columns are not read.  Words are told apart by 128 bits of hash, runs of words by 96.
    """
    ship(docs.sparkSession)
    kind = docs.schema[docs.columns.index(id_col)].dataType
    docs = ordered(picked(docs, id_col, text_col).toDF("doc_id", "text"))
    text = docs.select("id", body("text").alias("text"))
    # As Parquet, smaller than a checkpoint: ids repeat, and the last part of each key has 32 bits.
    seeds = written(stretches(text, size, gram))
    holders = written(seeds.groupBy("anchor", "g1", "g2").agg(F.min("id").alias("first"), F.max("id").alias("last")))
    several = holders.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.min("first").alias("low"), F.max("last").alias("high")
    ).where("n > 1 AND low < high").select("anchor")
    opening = holders.join(_small(materialised(several)), "anchor").select(F.col("first").alias("id"), "g1")
    opened = text.join(listed(opening, "g1", "open"), "id").select("id", "text", "open")
    single = later(written(windows(opened, size, gram)), ["w1", "w2"])
    shared = holders.where("first < last").select("g1", "g2", "first")
    whole = seeds.join(_small(shared), ["g1", "g2"]).where("id > first")
    none = F.array().cast("array<long>")
    gone = (
        listed(whole, "g1", "gone_g").join(listed(single, "w1", "gone_w"), "id", "full")
        .select("id", F.coalesce("gone_g", none).alias("gone_g"), F.coalesce("gone_w", none).alias("gone_w"))
    )
    rows = docs.select("doc_id", "id", body("text").alias("text")).join(gone, "id", "left")
    full = rows.select("doc_id", "text", F.coalesce("gone_g", none).alias("gone_g"), F.coalesce("gone_w", none).alias("gone_w"))
    return marked(full, kind.simpleString(), size, gram)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", hex_sha256(F.col("kept")).alias("kept_sha256"))
