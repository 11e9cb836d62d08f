"""Source divergence audit: how far the term shares of a language's sources lie apart.

Terms are counted in batches by length: a term of up to 8 bytes is one 64-bit word,
one of up to 16 bytes two; the words are radix-sorted by 16-bit digits and runs are
counted in numpy.  Longer terms stand in buckets of their own, by width, and are
sorted as bytes.  The sort is stable and the tokens come in order of group and
document, so a run holds a group's documents one after the other.  Spark adds up the
runs of all batches; all later arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semblance.llm.text import picked, sent
from semblance.session import ship, written

MIN_DOCS = 3
TOP = 200
UNIT = 1_000_000_000
CHUNK = 4 << 20  # bytes of text that are sorted at once
TILE = 128  # sources whose pairs one task compares
TERMS = 2_048  # terms of a language that one task compares, about
ROWS_TO_SEND = 100_000  # groups that a join may broadcast
MASK = np.array([(0xFFFFFFFFFFFFFFFF << (64 - 8 * n)) & 0xFFFFFFFFFFFFFFFF for n in range(9)], np.uint64)

_FOLD, _LETTER = np.arange(256, dtype=np.uint8), np.zeros(256, bool)
_FOLD[65:91] += 32
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows by their words, most significant first, in passes over 16-bit digits."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in (0, 16, 32, 48):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                # numpy sorts 16-bit numbers stably by radix.
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _strings(raw: np.ndarray, size: np.ndarray) -> pa.Array:
    """Rows of a byte matrix as strings of the given sizes."""
    data = raw[np.arange(raw.shape[1]) < size[:, None]]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def counted(body: bytes, ends: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """(group, term, occurrences, documents) of the runs, bucket by bucket.

    ``body`` holds the documents one after the other, each with a byte that is no letter behind it at ``ends - 1``;
    ``group`` is theirs, in ascending order.
    """
    text = _FOLD[np.frombuffer(body, np.uint8)]
    edge = np.flatnonzero(np.diff(_LETTER[text].astype(np.int8), prepend=0, append=0))
    start, size = edge[::2], edge[1::2] - edge[::2]
    if not len(start):
        return
    doc = np.searchsorted(ends, start, side="right")
    widest = max(16, 1 << int(size.max() - 1).bit_length())
    padded = np.concatenate([text, np.zeros(widest, np.uint8)])
    word = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    # Up to 8 bytes, up to 16, then buckets of doubling width.
    bucket = np.maximum(np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64), 3)
    for b in np.unique(bucket):
        at = np.flatnonzero(bucket == b)
        first, n = start[at], size[at]
        if b <= 4:
            words = [word[first].byteswap() & MASK[np.minimum(n, 8)]]
            if b == 4:
                words.append(word[first + 8].byteswap() & MASK[n - 8])
            order = radix_order(words)
            words = [w[order] for w in words]
            differs = np.logical_or.reduce([w[1:] != w[:-1] for w in words])
        else:
            width = 1 << int(b)
            raw = np.lib.stride_tricks.as_strided(padded, (len(padded) - width + 1, width), (1, 1))[first]
            raw[np.arange(width) >= n[:, None]] = 0
            order = np.argsort(raw.view(f"S{width}").ravel(), kind="stable")
            raw = raw[order]
            differs = (raw[1:] != raw[:-1]).any(axis=1)
        n, d = n[order], doc[at][order]
        g = group[d]
        run = np.concatenate([[True], differs | (g[1:] != g[:-1])])
        fresh = run | np.concatenate([[True], d[1:] != d[:-1]])
        begin = np.flatnonzero(run)
        if b <= 4:
            raw = np.stack([w[begin] for w in words], axis=1).astype(">u8").view(np.uint8).reshape(len(begin), -1)
        else:
            raw = raw[begin]
        yield g[begin], _strings(raw, n[begin]), np.diff(np.append(begin, len(run))), np.add.reduceat(fresh.astype(np.int64), begin)


def _slices(text: bytes, size: int) -> Iterator[bytes]:
    """The text in pieces of about that many bytes, cut behind a byte that is no letter."""
    at = 0
    while at < len(text):
        stop = min(at + size, len(text))
        while stop < len(text) and _LETTER[text[stop - 1]]:
            stop += 1
        yield text[at:stop]
        at = stop


def counts(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, summed over ``docs``; the empty term stands for the group itself.

    Columns lang, source and text hold no nulls.
    """
    ship(docs.sparkSession)
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = pd.MultiIndex.from_arrays([batch.column(0).to_pylist(), batch.column(1).to_pylist()])
            code, groups = pairs.factorize()
            langs, sources = (pa.array(groups.get_level_values(i), pa.string()) for i in (0, 1))
            none = pa.array(np.zeros(len(groups), np.int64))
            yield pa.RecordBatch.from_arrays([langs, sources, pa.array([""] * len(groups)), none, none], names)

            def rows(found) -> Iterator[pa.RecordBatch]:
                for g, term, n, d in found:
                    yield pa.RecordBatch.from_arrays([langs.take(pa.array(g)), sources.take(pa.array(g)), term, pa.array(n), pa.array(d)], names)

            texts, held, size = batch.column(2), [], 0
            for i in np.argsort(code, kind="stable"):
                raw = texts[int(i)].as_buffer().to_pybytes()
                if len(raw) > chunk:
                    yield from rows(_of_one(raw, int(code[i]), chunk))
                    continue
                held.append((raw, code[i]))
                size += len(raw)
                if size >= chunk:
                    yield from rows(_of_many(held))
                    held, size = [], 0
            yield from rows(_of_many(held))

    found = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _of_many(held: list[tuple[bytes, int]]):
    if held:
        body = b"\n".join([t for t, _ in held]) + b"\n"
        ends = np.cumsum([len(t) + 1 for t, _ in held])
        yield from counted(body, ends, np.array([g for _, g in held]))


def _of_one(text: bytes, group: int, chunk: int):
    """A long document in slices; its terms count as one document's where they come first."""
    seen: set[str] = set()
    for part in _slices(text, chunk):
        for g, term, n, _ in counted(part + b"\n", np.array([len(part) + 1]), np.array([group])):
            own = term.to_pylist()
            yield g, term, n, np.array([t not in seen for t in own], np.int64)
            seen.update(own)


def _share(count: Column, total: Column) -> Column:
    """1 + floor(UNIT * count / total) for count <= total < 2**53, three decimal digits at a time, so nothing overflows."""
    out, rest = F.lit(1).cast("long"), count
    for unit in (1_000_000, 1_000, 1):
        scaled = rest * F.lit(1_000).cast("long")
        out = out + F.call_function("div", scaled, total) * F.lit(unit).cast("long")
        rest = scaled % total
    return out


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """As ``_share``, in numpy."""
    out, rest = np.ones(np.broadcast(count, total).shape, np.uint64), count.astype(np.uint64)
    for unit in (1_000_000, 1_000, 1):
        quotient, rest = np.divmod(rest * np.uint64(1_000), total)
        out += quotient * np.uint64(unit)
    return out


def _tile_pairs(part: pd.DataFrame) -> pd.DataFrame:
    """Sums of the gaps for the pairs of two tiles' sources over the terms of one shard that occur in them.

    Rows of term -1 hold each source's total; ``a`` and ``b`` are the two tiles, often the same.
    """
    own = part[part["tid"] < 0].sort_values("idx")
    rows = part[part["tid"] >= 0]
    idx, total = own["idx"].to_numpy(), own["total"].to_numpy().astype(np.uint64)
    terms, column = np.unique(rows["tid"].to_numpy(), return_inverse=True)
    n = np.zeros((len(idx), len(terms)), np.uint64)
    n[np.searchsorted(idx, rows["idx"].to_numpy()), column] = rows["n"].to_numpy()
    p = _shares(n + np.uint64(1), total[:, None]) if len(terms) else n
    a, b = int(part["a"].iloc[0]), int(part["b"].iloc[0])
    tile, out = idx // TILE, []
    for i in np.flatnonzero((tile == a) | (tile == b)):
        other = (tile == (b if tile[i] == a else a)) & (idx != idx[i])
        q = p[other]
        # The gap's square is below 2**63; unsigned differences wrap and square alike.
        gap = np.where(p[i] > q, p[i] - q, q - p[i])
        out.append(pd.DataFrame({"idx": idx[i], "other": idx[other], "value": (gap * gap // q).sum(axis=1).astype(np.int64), "present": len(terms)}))
    out = pd.concat(out)
    out.insert(0, "lang", part["lang"].iloc[0])
    return out


def audit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP
) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) that occurs.

    Part ``pair`` ranks all other sources of the language by the sum of the gaps over all kept terms; part ``term``
    the ``top`` terms of the group whose share lies above the language's.  Kept are a language's terms found in at
    least ``min_docs`` of its rows; each row is a document, equal ids and texts too.  Null texts, languages and
    sources count as empty strings; a group without terms has zero counts and is ranked like any other; a source
    alone in its language has no pairs; an empty table gives no rows; other columns are not read.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    spark = docs.sparkSession
    plain = picked(docs, lang_col, source_col, text_col).select(
        text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text")
    )
    found = written(counts(plain))
    terms = found.where("term != ''").groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    terms = written(terms.select("lang", "term", "n_lang").withColumn("tid", F.monotonically_increasing_id()))
    kept = written(found.join(terms, ["lang", "term"]).select("lang", "source", "term", "tid", "n", "n_lang"))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n_lang").alias("lang_total"))
    groups = found.where("term = ''").select("lang", "source")
    groups = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("own")), ["lang", "source"], "left").join(langs, "lang", "left")
    zero = F.lit(0).cast("long")
    v = F.coalesce("v", zero)
    groups = written(groups.select(
        "lang", "source", v.alias("v"), (F.coalesce("own", zero) + v).alias("total"), (F.coalesce("lang_total", zero) + v).alias("lang_all"),
        (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long").alias("idx"),
    ))
    known = groups.count()
    rank = lambda: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))

    # Terms above the language's share; Spark keeps the first ranks of each task before it shuffles.
    p, q = _share(F.col("n") + 1, F.col("total")), _share(F.col("n_lang") + 1, F.col("lang_all"))
    above = kept.join(sent(groups, known, ROWS_TO_SEND), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    above = above.select("lang", "source", "item", _gap(F.col("p"), F.col("q")).alias("value")).withColumn("rank", rank()).where(F.col("rank") <= top)

    # Pairs: terms are dealt to shards, sources to tiles; a task has the rows of two tiles in one shard.
    shards = F.greatest(F.ceil(F.col("v") / TERMS), F.lit(1)).cast("long")
    tiles = groups.groupBy("lang").agg((F.floor(F.max("idx") / TILE) + 1).cast("long").alias("tiles"), F.max(shards).alias("shards"))
    place = groups.join(tiles, "lang").select("lang", "source", "total", "idx", "tiles", "shards", F.floor(F.col("idx") / TILE).cast("long").alias("tile"))
    with_tile = F.explode(F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda u: F.struct(F.least(u, F.col("tile")).alias("a"), F.greatest(u, F.col("tile")).alias("b"))
    ))
    shard = F.pmod(F.xxhash64("term"), F.col("shards"))
    cells = kept.join(sent(place, known, ROWS_TO_SEND), ["lang", "source"]).select("lang", shard.alias("shard"), with_tile.alias("t"), "idx", "tid", "n", "total")
    own = place.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"), "idx", "total", "tile", "tiles")
    own = own.select("lang", "shard", with_tile.alias("t"), "idx", F.lit(-1).cast("long").alias("tid"), zero.alias("n"), "total")
    ship(spark)
    sums = (
        cells.unionByName(own).select("lang", "shard", "t.a", "t.b", "idx", "tid", "n", "total").groupBy("lang", "shard", "a", "b")
        .applyInPandas(_tile_pairs, "lang string, idx long, other long, value long, present long")
        .groupBy("lang", "idx", "other").agg(F.sum("value").alias("value"), F.sum("present").alias("present"))
    )
    one = groups.select("lang", "idx", "source", "v", "total")
    other = groups.select("lang", F.col("idx").alias("other"), F.col("source").alias("item"), F.col("total").alias("other_total"))
    # Terms that neither tile holds have the same gap each.
    blank = F.when(F.col("v") > F.col("present"), _gap(_share(F.lit(1).cast("long"), F.col("total")), _share(F.lit(1).cast("long"), F.col("other_total")))).otherwise(zero)
    pairs = sums.join(one, ["lang", "idx"]).join(other, ["lang", "other"]).select(
        "lang", "source", "item", (F.col("value") + (F.col("v") - F.col("present")) * blank).alias("value")
    ).withColumn("rank", rank())
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(above, "term"))
