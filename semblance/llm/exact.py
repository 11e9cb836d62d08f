"""Exact deduplication by deterministic block naming.

A normalised text is cut into fixed-size blocks.  The distinct blocks are sorted
and their places in the order are their integer names; then the names of adjacent
blocks pair up, the distinct pairs are sorted and named in turn, and so on until
every document has one name.  Documents with as many blocks and the same name are
equal: a name stands for one text only, whatever the hashes do.

Blocks sort by (hash, text).  The hash says which name a block row has wherever
only one distinct block owns that hash, so texts travel once, already distinct
within each task; blocks that share a hash are told apart by their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semblance.llm.text import SPACE, body, hex_sha256, named, picked, upto
from semblance.session import materialised

BLOCK = 2_048  # code points of a block
NAMES = 65_536  # names given by one sort, about
ROW = ["doc_id", "n_chars", "h1", "h2"]  # what tells rows apart; rows equal in all are the same text under the same id


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE + "+", "")


def block_hash(block: Column) -> Column:
    return F.xxhash64(block)


def ranked(distinct: DataFrame, order: list[str], hashed: Column, rows: int) -> DataFrame:
    """``distinct`` with a column ``name``: the rows' places when sorted by (hash, order).

    Sorted in ranges of the hash, whose number follows the number of rows; the range is the name's upper part.
    """
    bits = max(0, (rows // NAMES).bit_length())
    part = F.shiftrightunsigned("__hash", 64 - bits) if bits else F.lit(0).cast("long")
    sorted_in = Window.partitionBy("__part").orderBy("__hash", *order)
    return (
        distinct.withColumn("__hash", hashed).withColumn("__part", part)
        .withColumn("name", F.shiftleft("__part", 63 - max(bits, 1)) + F.row_number().over(sorted_in))
        .drop("__hash", "__part")
    )


def block_names(hashed: DataFrame, blocks: DataFrame) -> DataFrame:
    """The block rows (ROW, at, hash) with their name instead of their hash; ``blocks`` has their text besides."""
    owners = materialised(blocks.select("hash", "block").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("owners")))
    several = owners.where("owners > 1").select("hash")
    clashes = several.count()
    if clashes == 0:
        names = ranked(owners.select("hash"), [], F.col("hash"), owners.count())
        return hashed.join(names, "hash").drop("hash")
    # Blocks that share a hash: within it the order is the text's.
    few = F.broadcast(several) if clashes <= NAMES else several
    shared = materialised(blocks.join(few, "hash", "left_semi"))
    told = shared.select("hash", "block").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("hash").orderBy("block")))
    keys = owners.where("owners = 1").select("hash", F.lit(1).alias("nth")).union(told.select("hash", "nth"))
    names = materialised(ranked(keys, ["nth"], F.col("hash"), keys.count()))
    plain = hashed.join(few, "hash", "left_anti").join(names, "hash").drop("hash", "nth")
    apart = shared.join(told, ["hash", "block"]).join(names, ["hash", "nth"]).drop("hash", "block", "nth")
    return plain.unionByName(apart.select(*plain.columns))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows, names): the distinct rows with their count and digest, and the one name of each."""
    text = picked(docs, id_col, text_col).select(named(id_col).alias("doc_id"), body(text_col).alias("t"))
    whole = text.select(
        "doc_id", F.length("t").cast("long").alias("n_chars"), F.xxhash64("t").alias("h1"), F.xxhash64(F.lit("row"), "t").alias("h2"),
        normalised(F.col("t")).alias("norm"),
    )
    cut = F.transform(upto(F.ceil(F.length("norm") / block).cast("int") - 1), lambda i: F.substring("norm", i * block + 1, F.lit(block)))
    # Hashes of the blocks stay with their row; only the blocks themselves travel.
    rows = materialised(
        whole.select(*ROW, hex_sha256(F.col("norm")).alias("text_sha256"), F.transform(cut, block_hash).alias("hashes"))
        .groupBy(*ROW, "text_sha256", "hashes").agg(F.count(F.lit(1)).alias("copies")).withColumn("n_blocks", F.size("hashes"))
    )
    blocks = whole.select(*ROW, F.posexplode(cut).alias("at", "block")).withColumn("hash", block_hash(F.col("block")))
    hashed = rows.select(*ROW, F.posexplode("hashes").alias("at", "hash"))
    level = materialised(block_names(hashed, blocks).distinct())
    longest = rows.agg(F.max("n_blocks")).first()[0] or 0
    while longest > 1:
        # A last block without a neighbour pairs with zero, which is no name.
        pairs = level.groupBy(*ROW, F.shiftright("at", 1).alias("at")).agg(
            F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(0)).alias("right"),
        )
        pairs = materialised(pairs)
        distinct = materialised(pairs.select("left", "right").distinct())
        names = ranked(distinct, ["left", "right"], F.xxhash64("left", "right"), distinct.count())
        level = materialised(pairs.join(names, ["left", "right"]).select(*ROW, "at", "name"))
        longest = (longest + 1) // 2
    return rows.drop("hashes"), level.select(*ROW, "name")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, name.

    Texts are equal when they are identical without white space; the row with the most code points, then the smallest
    doc_id, stays (a null id comes after all others).  Null and empty texts and texts of white space only are equal.
    Rows repeated in id and text all count in the group; only one of the rows that stay is marked kept.  Other columns
    are not read; empty tables stay empty.
    """
    rows, names = identities(docs, id_col, text_col, block)
    r, n = rows.alias("r"), names.alias("n")
    on = F.lit(True)
    for c in ROW:
        on = on & F.col(f"r.{c}").eqNullSafe(F.col(f"n.{c}"))
    named_rows = materialised(
        r.join(n, on, "left").select("r.*", F.coalesce("n.name", F.lit(0)).alias("name"))
    )
    key = F.struct((-F.col("n_chars")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("h1").alias("d"), F.col("h2").alias("e"))
    # Written out, so that the join reads plain exchanges, which Spark splits where one group holds many rows.
    groups = materialised(named_rows.groupBy("n_blocks", "name").agg(F.sum("copies").alias("group_size"), F.min(key).alias("best")))
    best = F.col("best")
    first = best["c"].eqNullSafe(F.col("doc_id")) & (best["a"] == -F.col("n_chars")) & (best["d"] == F.col("h1")) & (best["e"] == F.col("h2"))
    out = named_rows.join(groups, ["n_blocks", "name"]).withColumn("first", first)
    return out.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("nth")).select(
        "doc_id", best["c"].alias("keep_id"), "group_size", (F.col("first") & (F.col("nth") == 1)).alias("kept"), "text_sha256", "name"
    )


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
