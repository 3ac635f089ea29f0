"""Corpus pipeline: quality, near-duplicates, benchmark leaks, personal data, piece ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zoneloom.llm.decontam import drop_contaminated
from zoneloom.llm.pieces import encode_pieces
from zoneloom.llm.pii import redact
from zoneloom.llm.quality import fit_quality, keep_quality
from zoneloom.llm.simhash import keep_one
from zoneloom.llm.tables import table
from zoneloom.session import cut_lineage

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality trees accept; trees are fitted on labelled documents of this stage's input."""
    return keep_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels", ["doc_id", "quality"])))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark", ["item_id", "text"]))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their text replaced and ``n_chars`` counted anew."""
    return redact(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_pieces, pieces_crc32, pieces, round_trip)``: piece ids, and whether decoding them gives the text back."""
    marked = docs.select(F.struct("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")).alias("row"), "text")
    coded = encode_pieces(marked, PIECE_MODEL, "row", decoded=True)
    return coded.select(
        "row.doc_id", F.size("pieces").cast("bigint").alias("n_pieces"), "pieces_crc32", "pieces",
        (F.sha2("decoded", 256) == F.col("row.sha")).alias("round_trip"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("personal_data", personal_data), ("pieces", pieces),
]

#: Trees, fingerprints and pieces are not expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
