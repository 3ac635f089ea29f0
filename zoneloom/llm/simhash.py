"""SimHash near-duplicates: fingerprints, blocks shared by close pairs, Hamming distance, components.

Two 64-bit fingerprints that differ in at most ``d`` bits agree on at least ``BLOCKS - d`` of ``BLOCKS`` blocks
(pigeonhole), so every close pair meets under a key made of that many blocks. Distinct fingerprints are joined on
those keys; a key with many fingerprints is divided again by the same argument over its free bits, so no group of
more than ``GROUP`` fingerprints is ever gathered and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from zoneloom.llm.components import components
from zoneloom.llm.tables import free_name, held
from zoneloom.session import cut_lineage

SEED = 42
SHINGLE = 3
DISTANCE = 3
BLOCKS = 6
GROUP = 4096  # fingerprints of one key that a task compares at once; larger keys are divided, none is dropped


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bitwise majority of the shingles' XXH64; bytes A-Z count as a-z, words are split at ASCII white space."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams: Iterator[bytes] = iter([b" ".join(words)])
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    total, counts = 0, np.zeros(64, np.int64)
    for block in batched(grams, 1 << 14):
        hashes = np.fromiter((xxh64_intdigest(g, SEED) for g in block), np.uint64, len(block))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(block)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(key, fp)`` per row; ``fp`` holds the 64 bits as a signed long. A null text counts as an empty one (0)."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("fingerprints", dict)  # nothing to keep
        for batch in batches:
            values = (fingerprint(t.as_py().encode(), shingle) if t.is_valid else 0 for t in batch.column(1))
            found = np.fromiter(values, np.uint64, len(batch)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["k", "fp"])

    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, fp bigint").withColumnRenamed("k", key)


def _blocks(bits: list[int], n: int) -> list[int]:
    """``n`` masks that share out the bits."""
    return [sum(1 << int(b) for b in part) for part in np.array_split(bits, n) if len(part)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def key_masks(distance: int = DISTANCE, blocks: int = BLOCKS) -> list[int]:
    """Masks of the bits that make up the keys: every choice of ``blocks - distance`` blocks."""
    parts = _blocks(list(range(64)), blocks)
    return [sum(c) for c in combinations(parts, blocks - distance)]


def _finer(mask: int, distance: int) -> list[int]:
    """The mask with one more of ``distance + 1`` blocks of its free bits: a close pair agrees on one of them."""
    return [mask | m for m in _blocks([b for b in range(64) if not mask >> b & 1], distance + 1)]


def _mask_array(masks: list[int]) -> Column:
    return F.array(*[F.lit(_signed(m)) for m in masks])


def spanning_links(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join each set of values connected by steps of at most ``distance`` bits: fewer links than values."""
    found, rest = [], values
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= distance
            if near.any():
                new = rest[near]
                found.extend((int(x), int(y)) for y in new.view(np.int64))
                front.extend(new)
                rest = rest[~near]
    return [(int(np.uint64(x).view(np.int64)), y) for x, y in found]


def _links_in_groups(groups: DataFrame, distance: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links: list[tuple[int, int]] = []
            for members in batch.column(0):
                links += spanning_links(np.sort(members.values.to_numpy()).view(np.uint64), distance)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"]
            )

    return groups.mapInArrow(run, "a bigint, b bigint").distinct()


def fingerprint_links(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, group: int = GROUP) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints (column ``fp``) that connect all within ``distance`` bits.

    They make the same components as all close pairs, but there are fewer links of a key than fingerprints.
    """
    masks = key_masks(distance, blocks)
    rows = fps.select(F.explode(_mask_array(masks)).alias("mask"), "fp").withColumn("key", F.expr("fp & mask"))
    links = []
    while True:
        sizes = cut_lineage(rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        shared = rows.join(sizes, ["mask", "key"])
        members = shared.filter(F.col("n") <= group).groupBy("mask", "key").agg(F.collect_list("fp").alias("fps"))
        links.append(_links_in_groups(members.select("fps"), distance))
        if sizes.filter(F.col("n") > group).isEmpty():
            break
        finer = {m: _finer(m, distance) for m in masks}
        choice = F.create_map(*[c for m, f in finer.items() for c in (F.lit(_signed(m)), _mask_array(f))])
        masks = sorted({m for f in finer.values() for m in f})
        large = shared.filter(F.col("n") > group).select(F.explode(choice[F.col("mask")]).alias("mask"), "fp")
        rows = cut_lineage(large.withColumn("key", F.expr("fp & mask")).distinct())
    joined = links[0]
    for more in links[1:]:
        joined = joined.union(more)
    return joined


def components_of(marked: DataFrame, key: str, distance: int = DISTANCE) -> DataFrame:
    """``(fp, component, component_id)`` per distinct fingerprint of ``marked`` (``key, fp``): its component's least
    fingerprint and least key."""
    fps = cut_lineage(marked.groupBy("fp").agg(F.min(key).alias("first")))
    roots = cut_lineage(components(fingerprint_links(fps.select("fp"), distance), "a", "b"))
    linked = fps.join(roots, fps["fp"] == roots["node"]).select("fp", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("reached"))
    reached = linked.join(least, "root").select("fp", "root", "reached")
    return fps.join(reached, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("component"),
        F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("reached")).alias("component_id"),
    )


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE,
) -> DataFrame:
    """``(key, fp, component_id)`` per row: the smallest key reachable over links of at most ``distance`` bits.

    Null and empty texts have fingerprint zero, which is linked like any other. Rows with a null key take part; a
    component of null keys alone has a null id. Repeated rows are returned as often as they occur.
    """
    marked = cut_lineage(fingerprints(docs, key, text, shingle))
    return marked.join(components_of(marked, key, distance), "fp").select(key, "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE,
) -> DataFrame:
    """One row of each component, with all columns: the row with its smallest key.

    Where several rows give that key, or the component has null keys alone, its least row in column order stays.
    """
    other = free_name(docs, "_k")
    marked = cut_lineage(fingerprints(docs, key, text, shingle))
    groups = cut_lineage(components_of(marked, key, distance))
    keys = marked.join(groups, "fp").groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col(key).eqNullSafe(F.col("component_id"))).alias("first")
    )
    gone = cut_lineage(keys.filter((F.col("n") > 1) | ~F.col("first") | F.col(key).isNull()).select(F.col(key).alias(other), "n"))
    plain = docs.filter(F.col(key).isNotNull()).join(gone.select(other), F.col(key) == F.col(other), "left_anti")
    # Keys of several rows are few: their rows get their fingerprint again, and each component keeps its least row.
    several = gone.filter((F.col("n") > 1) | F.col(other).isNull())
    again = docs.join(several.select(other), F.col(key).eqNullSafe(F.col(other)), "left_semi")
    rows = fingerprints(again.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text")), "_row", "_text", shingle)
    least = rows.join(groups, "fp").filter(F.col(f"_row.{key}").eqNullSafe(F.col("component_id")))
    return plain.union(least.groupBy("component").agg(F.min("_row").alias("_row")).select("_row.*"))
