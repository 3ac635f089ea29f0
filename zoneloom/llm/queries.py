"""The registered queries of this subpackage, thin over its operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zoneloom.llm.audit import filter_audit
from zoneloom.llm.bpe import encode_bytes
from zoneloom.llm.decontam import contaminated
from zoneloom.llm.html import extract
from zoneloom.llm.oracles import ORACLES  # noqa: F401
from zoneloom.llm.pieces import encode_pieces
from zoneloom.llm.pii import KINDS, find_personal_data, written
from zoneloom.llm.quality import fit_quality, score_documents
from zoneloom.llm.resample import resample
from zoneloom.llm.rules import apply_rules
from zoneloom.llm.shards import shard_records
from zoneloom.llm.simhash import hex_fingerprint, near_duplicates
from zoneloom.llm.suffix import remove_repeats
from zoneloom.llm.tables import table
from zoneloom.llm.tokens import read_documents, write_token_files
from zoneloom.session import scratch_path

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", ["doc_id", "text"])


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages", ["page_id", "url", "html"]))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_documents(docs, fit_quality(docs, table(spark, sf_dir, "labels", ["doc_id", "quality"])))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark", ["item_id", "text"]))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", hex_fingerprint(found["fp"]).alias("fingerprint"), "component_id")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_records(documents(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents", ["doc_id", "text", "lang"]))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again; ``round_trip`` compares the decoded text's SHA-256 with the text's own."""
    docs = documents(spark, sf_dir)
    marked = docs.select(F.struct("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")).alias("row"), "text")
    coded = encode_pieces(marked, PIECE_MODEL, "row", decoded=True)
    return coded.select(
        "row.doc_id", F.size("pieces").cast("bigint").alias("n_pieces"), "pieces_crc32",
        F.length("decoded").cast("bigint").alias("n_chars"), (F.sha2("decoded", 256) == F.col("row.sha")).alias("round_trip"),
    )


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(documents(spark, sf_dir))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, n))).cast("bigint").alias(f"n_{kind}") for n, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "token-files")
    write_token_files(documents(spark, sf_dir), out, BYTE_BPE)
    return read_documents(spark, out)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "source"])
    return filter_audit(docs, table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"]))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_bytes(documents(spark, sf_dir), BYTE_RANKS, decoded=True)
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark", ["text"]))


QUERIES = {
    "op1_html": op1_html,
    "op2_quality": op2_quality,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_simhash": op5_simhash,
    "op6_sharding": op6_sharding,
    "op7_quality_rules": op7_quality_rules,
    "op8_pieces": op8_pieces,
    "op9_personal_data": op9_personal_data,
    "op10_token_files": op10_token_files,
    "op11_filter_audit": op11_filter_audit,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_resampling": op13_resampling,
}
