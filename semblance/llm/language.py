"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is its letters in lower case with one gap for every run of anything else.
Every n-gram of one to four of these is hashed to a feature.  Counts by language
and feature are added up in Spark; the log-probability matrix goes to the tasks as
whole numbers, so a sum does not depend on its order, and numpy scores the n-grams
of many texts at a time.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semblance.llm.text import picked
from semblance.session import ship, written

SIZES = (1, 2, 3, 4)  # characters of an n-gram
BITS = 16  # n-grams are hashed to 2**BITS features
SMOOTHING = 0.5
STEP = 1 << 18  # characters of one text, or n-grams of many, that are handled at once
HELD = 64  # languages a task counts before it hands them on
MOST = 1_024  # languages of one model, which bounds what is broadcast to MOST * 2**BITS * 4 bytes
SCALE = 1 << 20  # log-probabilities are multiples of 1 / SCALE
UNKNOWN = "und"
FOLDS, HELD_OUT = 5, 0
DOCUMENT = -1  # in place of a feature: the number of documents


@cache
def letters() -> np.ndarray:
    """The lower-case letter of every code point; 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        c = chr(point)
        if unicodedata.category(c)[0] == "L":
            low = c.lower()
            table[point] = ord(low[0]) if len(low) >= 1 else point
    return table


def grams(text: str, bits: int = BITS) -> Iterator[np.ndarray]:
    """Features of a text's n-grams, in pieces; nothing for a text without letters."""
    table, shift = letters(), np.uint32(32 - bits)
    carry, any_letter = np.zeros(1, np.uint32), False
    reach = max(SIZES) - 1
    for at in range(0, len(text), STEP):
        points = table[np.frombuffer(text[at : at + STEP].encode("utf-32-le", "surrogatepass"), np.uint32)]
        any_letter = any_letter or bool(points.any())
        last = at + STEP >= len(text)
        x = np.concatenate([carry, points, np.zeros(int(last), np.uint32)])
        x = x[np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])]
        starts = len(x) if last else len(x) - reach
        if starts <= 0:
            carry = x
            continue
        carry = x[starts:]
        if not any_letter:
            continue
        h, found = np.zeros(len(x), np.uint32), []
        for n in range(1, max(SIZES) + 1):
            if n > len(x):
                break
            h = h[: len(x) - n + 1] * np.uint32(0x01000193) + x[n - 1 :]
            if n in SIZES:
                own = h[:starts] + np.uint32(n * 0x632BE5AB & 0xFFFFFFFF)
                own = (own ^ (own >> np.uint32(15))) * np.uint32(0x9E3779B1)
                found.append(own >> shift)
        yield np.concatenate(found)


@dataclass
class Model:
    """Languages in order of their names; rows of whole-numbered negative log-probabilities, and the classes' own."""

    languages: list[str]
    cost: np.ndarray = field(default_factory=lambda: np.zeros((0, 1 << BITS), np.int32))
    prior: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def costs(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) total costs, and the texts' numbers of n-grams; n-grams of several texts are looked up together."""
        out, number = np.tile(self.prior, (len(texts), 1)), np.zeros(len(texts), np.int64)
        held, owner, size = [], [], 0

        def flush() -> None:
            if not held:
                return
            f, begin = np.concatenate(held), np.cumsum([0] + [len(h) for h in held[:-1]])
            for k, row in enumerate(self.cost):
                np.add.at(out[:, k], owner, np.add.reduceat(row[f], begin, dtype=np.int64))

        for i, text in enumerate(texts):
            for f in grams(text or ""):
                if len(f):
                    held.append(f)
                    owner.append(i)
                    number[i] += len(f)
                    size += len(f)
                if size >= STEP:
                    flush()
                    held, owner, size = [], [], 0
        flush()
        return out, number

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language, the first name on ties, and its probability.

        N-grams overlap and depend on each other, so for the probability n of them weigh as much as their square root.  A text without a letter, or a model without languages, gives ``und`` and 0.
        """
        table = letters()
        known = [bool(t) and bool(self.languages) and _has_letter(t, table) for t in texts]
        cost, number = self.costs([t if k else None for t, k in zip(texts, known)])
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = cost.argmin(axis=1)
        gap = (cost - cost.min(axis=1, keepdims=True)) / (SCALE * np.sqrt(np.maximum(number, 1))[:, None])
        score = 1 / np.exp(-np.minimum(gap, 700)).sum(axis=1)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, score, 0.0)


def _has_letter(text: str, table: np.ndarray) -> bool:
    return any(
        table[np.frombuffer(text[i : i + STEP].encode("utf-32-le", "surrogatepass"), np.uint32)].any() for i in range(0, len(text), STEP)
    )


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves the held-out remainder; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def counts(docs: DataFrame) -> DataFrame:
    """(lang, feature, n) over ``docs`` (lang, text); feature -1 counts the documents."""
    ship(docs.sparkSession)
    size = 1 << BITS

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        for lang, (documents, n) in held.items():
            f = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(f) + 1), pa.string()), pa.array(np.append(f, DOCUMENT).astype(np.int32)), pa.array(np.append(n[f], documents))], ["lang", "feature", "n"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if lang not in held and len(held) == HELD:
                    yield from rows(held)
                    held = {}
                own = held.setdefault(lang, [0, np.zeros(size, np.int64)])
                own[0] += 1
                for f in grams(text.as_py()):
                    own[1] += np.bincount(f, minlength=size)
        yield from rows(held)

    return docs.mapInArrow(run, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = SMOOTHING) -> Model:
    """Learn from all rows with a language; null texts count as documents without n-grams.

    What reaches the driver is a row of 2**BITS counts for each language, at most MOST of them; more end with an error.
    """
    plain = picked(docs, lang_col, text_col).toDF("lang", "text")
    plain = plain.where(F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = written(counts(plain))
    if found.where(F.col("feature") == DOCUMENT).limit(MOST + 1).count() > MOST:
        raise ValueError(f"A model holds at most {MOST} languages.")

    def dense(part: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros((1 << BITS) + 1, np.int64)
        n[part["feature"].to_numpy()] = part["n"].to_numpy()
        return pd.DataFrame({"lang": [part["lang"].iloc[0]], "n": [n.tobytes()]})

    # A group has at most 2**BITS + 1 rows; the document count stands in the last place.
    whole = sorted((r.lang, r.n) for r in found.groupBy("lang").applyInPandas(dense, "lang string, n binary").toLocalIterator())
    if not whole:
        return Model([])
    n = [np.frombuffer(raw, np.int64) for _, raw in whole]
    documents = np.array([v[-1] for v in n], float)
    cost = [-np.log((v[:-1] + smoothing) / (v[:-1].sum() + smoothing * (1 << BITS))) for v in n]
    return Model([lang for lang, _ in whole], np.rint(np.array(cost) * SCALE).astype(np.int32), np.rint(-np.log(documents / documents.sum()) * SCALE).astype(np.int64))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score.

    Null texts, empty ones and others without a letter (Unicode category L) have ``und`` and score 0; equal costs take the
    first name; repeated rows each give a row; ids may be null; an empty table stays empty; other columns are not read.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                names, score = sent.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    plain = picked(docs, id_col, text_col).toDF("doc_id", "text").select("doc_id", F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def learnable(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows whose ids are not held out, all columns."""
    at = f"c{docs.columns.index(id_col)}"
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.where(~held_out(F.col(at))).toDF(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
