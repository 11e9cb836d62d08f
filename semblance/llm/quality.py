"""Quality classifier: naive Bayes support vectors.

Documents are sets of hashed n-grams (word unigrams and bigrams, byte trigrams) and
of back-off n-grams that only say how often a word repeats the one before it.
Each n-gram's indicator is scaled by its log-count ratio between the classes, and
a linear hinge-loss model is fitted on the scaled vectors by dual coordinate
descent.  The fit works on blocks of a bounded labelled sample, in parallel; the
blocks' weights are averaged, and a logistic curve over margins from ratios and
weights of the blocks without the document turns margins into probabilities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semblance.llm.text import LOWER, UPPER, body, named, picked
from semblance.session import materialised, ship

SAMPLE = 16_384  # labelled documents that the fit uses at most, about; drawn by hash over all labelled documents
BLOCK = 2_048  # labelled documents that one task fits
LEAST_BLOCKS = 5  # also of small samples, so that the curve is fitted on unseen margins
BITS = 18  # n-grams are hashed to 2**BITS features
ALL = -1  # stands for all blocks where a block stands for the others
EPOCHS, COST = 12, 1.0
FOLDS, HELD_OUT = 5, 0
ROWS = 512
THRESHOLD = 0.3

_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


RUNS, SHARES = (2, 3, 4), (0.05, 0.1, 0.2, 0.4)  # words equal in a row, and shares of words that repeat the last
OWN = 1 + len(RUNS) + len(SHARES)  # features before the hashed ones


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """The sorted distinct features of a text; feature 0 is in every one."""
    raw = (text or "").encode()
    shift = np.uint32(32 - bits)
    found = [np.zeros(1, np.uint32)]
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) > 2:
        found.append(((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(0x9E3779B1)) >> shift)
    words = raw.translate(_FOLD).split()
    if words:
        w = np.array([xxhash.xxh32_intdigest(x) for x in words], np.uint32)
        found += [w >> shift, ((w[:-1] * np.uint32(0x85EBCA6B) ^ w[1:]) * np.uint32(0xC2B2AE35)) >> shift]
    found = [found[0], *[np.maximum(f, OWN) for f in found[1:]]]
    if len(words) > 1:
        again = w[1:] == w[:-1]
        runs = [again if n == 2 else np.convolve(again, np.ones(n - 1, int)) == n - 1 for n in RUNS]
        has = [r.any() for r in runs] + [again.mean() >= x for x in SHARES]
        found.append(np.flatnonzero(has).astype(np.uint32) + np.uint32(1))
    return np.unique(np.concatenate(found)).astype(np.int32)


@dataclass
class Model:
    """Weight of each feature (log-count ratio and hinge-loss weight multiplied), and the curve's slope and offset."""

    ratio: np.ndarray
    weight: np.ndarray
    slope: float
    offset: float

    def margin(self, f: np.ndarray) -> float:
        r = self.ratio[f]
        return float(r @ self.weight[f]) / (float(np.sqrt(r @ r)) or 1.0)

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features(text)) + self.offset, -30, 30))))


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text leaves the held-out remainder; a null id counts as an empty text."""
    return F.crc32(F.coalesce(named(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """(block, y, text) of about ``sample`` labelled documents that are not held out, in LEAST_BLOCKS blocks or in more of about BLOCK.

    An id with several labels has their majority (1 on a tie); null ids and labels teach nothing.
    """
    y = F.when(F.avg(named(label_col).cast("double")) >= 0.5, 1).otherwise(-1)
    known = picked(labels, id_col, label_col).where(named(id_col).isNotNull() & named(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(named(id_col).alias("id")).agg(y.alias("y"))
    count = known.count()
    draw = F.pmod(F.xxhash64(F.lit("quality sample"), F.col("id")), F.lit(1_000_003)) / 1_000_003
    blocks = max(LEAST_BLOCKS, round(min(count, sample) / BLOCK))
    drawn = known.where(draw < min(1.0, sample / max(count, 1))).withColumn("block", F.pmod(F.xxhash64(F.lit("block"), F.col("id")), F.lit(blocks)).cast("int"))
    # The sample's size is bounded, so it is sent to the documents.
    text = picked(docs, id_col, text_col).select(named(id_col).alias("id"), body(text_col).alias("text"))
    return text.join(F.broadcast(drawn), "id").select("block", "y", "text")


def _ratio(p: np.ndarray, q: np.ndarray, n_p: int, n_q: int) -> np.ndarray:
    """Log-count ratios of the features from their counts in the two classes and the classes' sizes."""
    ratio = np.log((p + 1) / (n_p + 2)) - np.log((q + 1) / (n_q + 2))
    ratio[0] = 1.0  # the constant feature is the bias
    return ratio


def _packed(x: np.ndarray) -> bytes:
    """The array in few bytes: most features are rare in a block, so most counts and many weights are zeros."""
    return zlib.compress(x.tobytes(), 1)


def _unpacked(packed: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), kind)


def _ratios(tallied: list[tuple]) -> dict[int, np.ndarray]:
    """Ratios of all blocks, and for each block those of the others: a document's own label has no part in its margin."""
    counts = {block: (_unpacked(p, np.int32), _unpacked(q, np.int32), n_p, n_q) for block, p, q, n_p, n_q in tallied}
    whole = tuple(sum(c[i] for c in counts.values()) for i in range(4))
    return {ALL: _ratio(*whole)} | {b: _ratio(*[x - y for x, y in zip(whole, c)]) for b, c in counts.items()}


def _descended(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Dual coordinate descent for the hinge loss on unit-length scaled rows; classes weigh the same."""
    values = [ratio[f] for f in rows]
    values = [v / (float(np.sqrt(v @ v)) or 1.0) for v in values]
    w, alpha = np.zeros(len(ratio)), np.zeros(len(rows))
    share = {s: max(1, int((y == s).sum())) for s in (-1, 1)}
    cost = np.array([COST * len(y) / (2 * share[int(s)]) for s in y])
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            f, v = rows[i], values[i]
            step = min(max(alpha[i] + 1 - y[i] * float(w[f] @ v), 0.0), cost[i]) - alpha[i]
            if step:
                alpha[i] += step
                w[f] += step * y[i] * v
    return w


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE
) -> Model:
    """Fit on labels outside the held-out remainder.  Without two classes every score is the share of the one there is."""
    spark = docs.sparkSession
    ship(spark)
    size = 1 << BITS

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                sets = pa.array([features(t.as_py()) for t in part.column(2)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), sets], ["block", "y", "f"])

    def gathered(block: pd.DataFrame) -> pd.DataFrame:
        y, f = block["y"].to_numpy(), [np.asarray(x, np.int32) for x in block["f"]]
        n = [np.bincount(np.concatenate([np.empty(0, np.int32), *(x for x, c in zip(f, y) if c == of)]), minlength=size).astype(np.int32) for of in (1, -1)]
        row = {"block": int(block["block"].iloc[0]), "y": y.astype(np.int32).tobytes(), "n": np.array([len(x) for x in f], np.int32).tobytes(), "f": _packed(np.concatenate(f))}
        return pd.DataFrame([row | {"p": _packed(n[0]), "q": _packed(n[1]), "n_p": int((y > 0).sum()), "n_q": int((y < 0).sum())}])

    # A row for each block, whatever the number of documents: labels, features and the features' counts in the two classes.
    rows = labelled(docs, labels, id_col, text_col, label_col, sample).mapInArrow(featured, "block int, y int, f array<int>")
    blocks = materialised(rows.groupBy("block").applyInPandas(gathered, "block int, y binary, n binary, f binary, p binary, q binary, n_p long, n_q long"))
    tallied = [tuple(r) for r in blocks.select("block", "p", "q", "n_p", "n_q").collect()]
    n_p, n_q = (sum(r[i] for r in tallied) for i in (3, 4))
    if not n_p or not n_q:
        return Model(np.zeros(size), np.zeros(size), 0.0, float(np.log((n_p + 1) / (n_q + 1))))
    # Packed counts are sent; the workers make the dense ratios.
    sent = spark.sparkContext.broadcast(tallied)

    def opened(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        for b, y, n, f in zip(*(c.to_pylist() for c in batch.columns)):
            yield b, np.frombuffer(y, np.int32), np.split(_unpacked(f, np.int32), np.cumsum(np.frombuffer(n, np.int32))[:-1])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, y, f in opened(batch):
                apart = {b: r for b, r in _ratios(sent.value).items() if b != own}
                w = [_packed(_descended(f, y, r)) for r in apart.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(apart), pa.int32()), pa.array([own] * len(w), pa.int32()), pa.array(w, pa.binary())], ["apart", "own", "w"])

    def averaged(parts: pd.DataFrame) -> pd.DataFrame:
        w = np.zeros(size)
        for part in parts.sort_values("own")["w"]:
            w += _unpacked(part, np.float64) / len(parts)
        return pd.DataFrame({"apart": [int(parts["apart"].iloc[0])], "w": [_packed(w)]})

    # Averaged where the blocks are, so that the driver gets one row of weights for each block and one for all.
    features_of = blocks.select("block", "y", "n", "f")
    fitted = features_of.mapInArrow(fit, "apart int, own int, w binary").groupBy("apart").applyInPandas(averaged, "apart int, w binary")
    # A lone block, of very few documents, has no others; its margins are zero and make every score the share of label 1.
    weights = {b: _packed(np.zeros(size)) for b, *_ in tallied} | {r.apart: bytes(r.w) for r in fitted.collect()}
    unseen = spark.sparkContext.broadcast(weights)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, y, f in opened(batch):
                model = Model(_ratios(sent.value)[own], _unpacked(unseen.value[own], np.float64), 1.0, 0.0)
                yield pa.RecordBatch.from_arrays([pa.array(y), pa.array([model.margin(x) for x in f], pa.float64())], ["y", "m"])

    # One margin for each document of the bounded sample.
    seen = features_of.mapInArrow(margins, "y int, m double").toPandas()
    sent.destroy()
    unseen.destroy()
    slope, offset = _curve(seen["m"].to_numpy(), seen["y"].to_numpy())
    return Model(_ratios(tallied)[ALL], _unpacked(weights[ALL], np.float64), slope, offset)


def _curve(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve through margins by Newton steps, on targets a little inside 0 and 1."""
    high, low = ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2)
    t = np.where(y > 0, high, low)
    x = np.stack([m, np.ones_like(m)], axis=1)
    b = np.array([1.0, 0.0])
    for _ in range(50):
        s = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = x.T @ (x * (s * (1 - s))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (t - s) - 1e-6 * b)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` and a column ``score`` between 0 and 1, larger where label 1 is likelier.

    Only the text is scored; null and empty texts have the score of a text without n-grams.  Repeated rows score the
    same, an empty table stays empty, and a column named score, in any spelling of case, is replaced.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([sent.value.score(t) for t in texts], dtype="float64")

    stay = [i for i, c in enumerate(docs.columns) if c.lower() != "score"]
    plain, text = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), f"c{docs.columns.index(text_col)}"
    return plain.select(*[F.col(f"c{i}") for i in stay], scored(body(text))).toDF(*[docs.columns[i] for i in stay], "score")


def digest(scored: DataFrame) -> DataFrame:
    return picked(scored, "doc_id", "score").select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
