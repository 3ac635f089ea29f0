"""Weighted rendezvous hashing of record keys over shards, in SQL functions only.

Every shard draws a cost from the hash of (key, shard), the smaller the likelier the larger its weight; the shard with
the least cost holds the record. A further shard takes records only into itself, and no other record moves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zoneloom.session import cut_lineage

LAW = "key"
SHARDS = 40
OVERHEAD = 16  # bytes a record takes besides its text
BLOCK_ROWS = 20_000  # rows of a shard that one task numbers, on average


def _unit(text: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the text's MD5."""
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def _costs(key: Column, first: int, weights: Sequence[float]) -> Column:
    """Array of ``(cost, shard)``: an exponential draw per shard with the shard's weight as rate."""
    shards = F.array(*[F.struct(F.lit(first + i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])
    return F.transform(
        shards, lambda s: F.struct((-F.ln(_unit(F.concat(key, F.lit(":"), s["shard"].cast("string")))) / s["weight"]).alias("cost"), s["shard"].alias("shard")),
    )


def key_text(key: str) -> Column:
    """The stable text that is hashed; a null key counts as the empty text."""
    return F.coalesce(F.col(key).cast("string"), F.lit(""))


def assign_shards(df: DataFrame, key: str = "doc_id", weights: Sequence[float] = (1.0,) * SHARDS, added: Sequence[float] = (1.0,)) -> DataFrame:
    """Adds ``shard``, and ``grown_shard`` as it is once shards with the weights ``added`` are appended.

    Only key and weights decide: repeated keys share a shard, equal texts with different keys need not.
    """
    if not weights or min([*weights, *added]) <= 0:
        raise ValueError("shards need positive weights")
    text = key_text(key)
    best = df.withColumn("_best", F.array_min(_costs(text, 0, weights)))
    grown = F.array_min(F.array(F.col("_best"), *([F.array_min(_costs(text, len(weights), added))] if added else [])))
    return best.select(*df.columns, F.col("_best.shard").alias("shard"), grown["shard"].alias("grown_shard"))


def number_slots(df: DataFrame, shard: str, key: str, order: Sequence[str], blocks: int) -> DataFrame:
    """Adds ``slot``: gapless from 0 within each shard.

    A shard's rows are dealt over ``blocks`` by the hash of their key and numbered there; only the counts of the
    blocks are summed per shard, so no task holds a whole shard.
    """
    block = (F.conv(F.substring(F.md5(F.concat(F.lit("slot:"), key_text(key))), 1, 8), 16, 10).cast("bigint") % blocks)
    rows = df.withColumn("_block", block)
    earlier = Window.partitionBy(shard).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(shard, "_block").agg(F.count(F.lit(1)).alias("_n")).select(
        F.col(shard).alias("_s"), F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")
    )
    within = Window.partitionBy(shard, "_block").orderBy(*order)
    numbered = rows.withColumn("_at", F.row_number().over(within) - 1)
    return numbered.join(starts, (F.col(shard) == F.col("_s")) & (F.col("_block") == F.col("_b"))).select(
        *df.columns, (F.col("_start") + F.col("_at")).alias("slot")
    )


def shard_records(docs: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * SHARDS) -> DataFrame:
    """``(key, size, text_crc32, law, shard, slot, grown_shard)`` per row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus ``OVERHEAD``; null texts have no bytes and the checksum of the empty text.
    Rows that repeat a key and text take neighbouring slots in any order. An empty table gives an empty one.
    """
    sized = docs.select(
        F.col(key), (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"),
    )
    placed = cut_lineage(assign_shards(sized, key, weights))
    blocks = max(16, -(-placed.count() // (len(weights) * BLOCK_ROWS)))
    return number_slots(placed, "shard", key, [key, "text_crc32", "size"], blocks).select(
        key, "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", "grown_shard"
    )
