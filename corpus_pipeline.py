"""From raw documents to tokens: five stages, each one operator over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.  All but the last return the
columns of ``documents``; other columns that came in are left out.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semblance.llm import decontaminate, lines, pieces, quality, simhash
from semblance.llm.text import picked
from semblance.session import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_ones(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; the labels teach it on the documents that came in."""
    docs = picked(docs, *COLUMNS)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the lines that the line operator leaves them; n_chars follows the text."""
    docs = picked(docs, *COLUMNS)
    return lines.kept(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate group; rows of one id are one document.

    Rows with a null id stay only in groups without any other id.
    """
    docs = picked(docs, *COLUMNS)
    found = simhash.near_duplicates(docs)
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(keep, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select(*COLUMNS)


def unseen_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs; rows of one id are one document."""
    docs = picked(docs, *COLUMNS)
    found = decontaminate.windows_hit(docs, table(spark, sf_dir, "benchmark"))
    hit = found.where("n_hit > 0").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti").select(*COLUMNS)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and the digests of ids and decoded texts."""
    import public_tokenizers

    return pieces.digest(pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [
    ("quality", good_ones), ("lines", without_repeated_lines), ("near_duplicates", one_of_each), ("benchmark", unseen_in_benchmark), ("pieces", as_pieces),
]

# The classifier, the fingerprints and the tokenizer are beyond SQL; tests compare with a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the stages before it are written to the session's shared folder and read again."""
    folder, docs = f"{shared_folder(spark)}/pipeline-{uuid4().hex}", table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
