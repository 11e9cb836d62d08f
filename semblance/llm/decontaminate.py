"""Benchmark decontamination by winnowing.

Of every window of ``words`` consecutive words the smallest hash of its k-grams
is the window's fingerprint, on both sides, so a shared window has the same
fingerprint on both sides and none is missed.  Document windows whose fingerprint
the benchmark cannot hold are left out by a bit table of bounded size; the rest
are joined with the benchmark's windows on fingerprint and exact words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semblance.llm.text import body, hex_sha256, kept_rows, lowered, named, picked, upto, words_of
from semblance.session import materialised

WINDOW = 10  # words that make a hit
K = 5  # words of a gram
MAX_BITS = 23  # the bit table has at most 2**23 bits (1 MB); beyond that it lets more pass, and the join decides
ROWS_TO_SEND = 200_000  # benchmark windows are broadcast up to this counted number, joined by shuffle beyond


def gram(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(words, at + j) for j in range(k)])


def prints(words: Column, size: int, k: int, starts: Column, keep=None) -> Column:
    """(at, size, h) of the windows of ``size`` words that begin at ``starts`` and pass ``keep``.

    Needs the array column ``g`` of k-gram hashes for windows of k words or more.
    """

    def h(at: Column) -> Column:
        if size < k:
            return gram(words, at, size)
        return F.least(*[F.get("g", at + j) for j in range(size - k + 1)]) if size > k else F.get("g", at)

    passed = starts if keep is None else F.filter(starts, lambda at: keep(h(at)))
    return F.transform(passed, lambda at: F.struct(at.alias("at"), F.lit(size).alias("size"), h(at).alias("h")))


def tokens(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    out = picked(df, key, text).select(named(key).alias("key"), words_of(lowered(body(text))).alias("words"))
    return out.withColumn("g", F.transform(upto(F.size("words") - k), lambda at: gram(F.col("words"), at, k)))


def with_text(words: Column, wins: Column) -> Column:
    return F.transform(wins, lambda w: w.withField("text", F.concat_ws(" ", F.slice(words, w["at"] + 1, w["size"]))))


def bits_of(windows: DataFrame, count: int) -> tuple[Column, int]:
    """A table of 2**b bits as a constant array of longs, and b."""
    b = min(MAX_BITS, max(10, (32 * max(count, 1) - 1).bit_length()))
    slot = F.col("h").bitwiseAND((1 << b) - 1)
    set_bits = windows.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(h & 63 AS INT))")).alias("bits")).collect()
    table = [0] * (1 << (b - 6))
    for r in set_bits:
        table[r.word] = r.bits
    return F.from_json(F.lit(str(table)), "array<bigint>"), b


def windows_hit(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, k: int = K,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, items (sorted array of strings).

    A document word is hit inside any occurrence of a benchmark window; an item of fewer than ``window`` words, but
    not none, is one window.  Null texts have no words, a null item is named ``null``, equal documents each give a
    row, equal items count once, empty tables give no hits and other columns are not read.
    """
    items = tokens(benchmark, item_col, item_text_col, k).withColumn("key", F.coalesce(F.col("key").cast("string"), F.lit("null")))
    n = F.size("words")
    long_ones = prints(F.col("words"), window, k, upto(n - window))
    short = [F.when(n == m, prints(F.col("words"), m, k, F.array(F.lit(0)))) for m in range(1, window)]
    wins = F.when(n >= window, long_ones)
    for s in short:
        wins = F.coalesce(wins, s)
    known = kept_rows(
        items.select("key", "words", wins.alias("wins")).select("key", F.explode(with_text(F.col("words"), F.col("wins"))).alias("w"))
        .select("key", "w.size", "w.h", "w.text").distinct()
    ).drop("rid")
    by_size = {r["size"]: r["count"] for r in known.groupBy("size").count().collect()}
    count = sum(by_size.values())
    bits, b = bits_of(known, count)

    def may(h: Column) -> Column:
        slot = h.bitwiseAND((1 << b) - 1)
        word = F.get(bits, F.shiftright(slot, 6).cast("int"))
        return F.call_function("getbit", word, h.bitwiseAND(63).cast("int")) == 1

    split = tokens(docs, id_col, text_col, k)
    found = F.concat(*[prints(F.col("words"), m, k, upto(F.size("words") - m), may) for m in sorted(by_size)]) if by_size else None
    if found is None:
        return split.select(F.col("key").alias("doc_id"), F.size("words").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    rows = kept_rows(
        split.select("key", "words", found.alias("wins")).select(
            F.col("key").alias("doc_id"), F.size("words").cast("long").alias("n_words"), with_text(F.col("words"), F.col("wins")).alias("wins")
        )
    )
    tried = rows.select("rid", F.explode("wins").alias("w")).select("rid", "w.*")
    small = count <= ROWS_TO_SEND
    texts = materialised(known.select("h", "text").distinct())
    hits = tried.join(F.broadcast(texts) if small else texts, ["h", "text"], "left_semi")
    covered = hits.groupBy("rid").agg(F.collect_set(F.struct("at", "size")).alias("at")).select(
        "rid",
        F.size(F.array_distinct(F.flatten(F.transform("at", lambda w: F.sequence(w["at"], w["at"] + w["size"] - 1))))).cast("long").alias("n_hit"),
    )
    pairs = tried.select("rid", "h", "text").join(F.broadcast(known) if small else known, ["h", "text"]).groupBy("rid").agg(F.array_sort(F.collect_set("key")).alias("items"))
    return (
        rows.select("rid", "doc_id", "n_words").join(covered, "rid", "left").join(pairs, "rid", "left")
        .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    )


def digest(hit: DataFrame) -> DataFrame:
    return hit.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        hex_sha256(F.array_join("items", ",")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
