"""Importance resampling towards a target: hashed n-gram counts, gains per bucket, Gumbel top-k.

Each batch interns its n-grams in an open-addressed NumPy table (XXH64 keys, bytes compared before two occurrences share
a slot). A slot holds the n-gram's bucket and count; occurrences keep their slot numbers, through which the slots' gains
are gathered. What is known of the corpus is one count per bucket.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from zoneloom.llm.tables import byte_chunks
from zoneloom.session import cut_lineage

GRAMS = 2  # words of the longest n-gram
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
SCALE = 1000
CHUNK_BYTES = 1 << 20
LONG_GRAM = 64  # bytes; longer n-grams are compared one by one
SHORT_HASH = 32  # bytes from which XXH64 works in stripes; shorter n-grams are hashed together

# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)

# Words are of digits, letters a-z and bytes from 128; A-Z count as a-z, all other bytes (0 here) separate.
_WORD_BYTE = np.zeros(256, np.uint8)
_WORD_BYTE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
_WORD_BYTE[0x41:0x5B] = range(0x61, 0x7B)


class Words:
    """The words of texts in a row: one buffer with one space behind each word, and where each word lies."""

    def __init__(self, texts: Sequence[bytes]):
        raw = _WORD_BYTE[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        inside = raw > 0
        before = np.concatenate(([False], inside[:-1]))
        kept = inside | before  # the byte behind a word becomes its space
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(before & ~inside)
        place = np.cumsum(kept) - 1
        raw[~inside] = 0x20
        self.buffer = np.concatenate((raw[kept], np.zeros(8, np.uint8)))
        self.data = self.buffer.tobytes()
        self.eight = np.ndarray((len(self.buffer) - 7,), "<u8", self.buffer, strides=(1,))  # eight bytes from each place on
        self.starts, self.ends = place[starts], place[ends]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.text = np.searchsorted(np.cumsum(sizes), starts, side="right")
        self.per_text = np.bincount(self.text, minlength=len(texts))

    def grams(self, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of every run of up to ``longest`` words of one text."""
        starts, ends, texts = [], [], []
        for n in range(1, longest + 1):
            if len(self.starts) >= n:
                whole = self.text[: len(self.text) - n + 1] == self.text[n - 1 :]
                starts.append(self.starts[: len(whole)][whole])
                ends.append(self.ends[n - 1 :][whole])
                texts.append(self.text[: len(whole)][whole])
        none = np.empty(0, np.int64)
        return tuple(np.concatenate(x) if x else none for x in (starts, ends, texts))  # type: ignore[return-value]


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def _hashes(words: Words, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of the bytes at every place."""
    h = sizes.astype(np.uint64) + _P5
    for done in range(0, SHORT_HASH - 8, 8):
        rows = np.flatnonzero(sizes >= done + 8)
        lane = _turn(words.eight[starts[rows] + done] * _P2, 31) * _P1
        h[rows] = _turn(h[rows] ^ lane, 27) * _P1 + _P4
    at = starts + (sizes & ~7)
    rows = np.flatnonzero(sizes & 4)
    h[rows] = _turn(h[rows] ^ (words.eight[at[rows]] & np.uint64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
    at = at + (sizes & 4)
    for done in range(3):
        rows = np.flatnonzero(sizes & 3 > done)
        h[rows] = _turn(h[rows] ^ words.buffer[at[rows] + done] * _P5, 11) * _P1
    for bits, prime in ((33, _P2), (29, _P3)):
        h = (h ^ h >> np.uint64(bits)) * prime
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(sizes >= SHORT_HASH).tolist():
        h[i] = xxh64_intdigest(words.data[starts[i] : starts[i] + sizes[i]])
    return h


class GramTable:
    """Interned n-grams: ``slot`` per occurrence; ``bucket`` and ``count`` per slot."""

    def __init__(self, words: Words, starts: np.ndarray, ends: np.ndarray, buckets: int):
        data, sizes = words.data, ends - starts
        keys = _hashes(words, starts, sizes)
        capacity = 1 << max(4, (2 * len(keys)).bit_length())
        owner = np.full(capacity, -1, np.int64)  # the occurrence that took a slot
        self.slot = (keys & np.uint64(capacity - 1)).astype(np.int64)
        rest = np.arange(len(keys))
        while len(rest):
            at = self.slot[rest]
            free = owner[at] < 0
            owner[at[free]] = rest[free]  # of several the last stays
            holder = owner[at]
            same = holder == rest
            alike = np.flatnonzero(~same & (keys[holder] == keys[rest]) & (sizes[holder] == sizes[rest]))
            same[alike] = _equal(words, starts[holder[alike]], starts[rest[alike]], sizes[rest[alike]])
            rest = rest[~same]
            self.slot[rest] = (self.slot[rest] + 1) & (capacity - 1)
        used = np.flatnonzero(owner >= 0)
        self.count = np.bincount(self.slot, minlength=capacity)
        self.bucket = np.zeros(capacity, np.int64)
        self.bucket[used] = [zlib.crc32(data[a:b]) % buckets for a, b in zip(starts[owner[used]].tolist(), ends[owner[used]].tolist())]


def _equal(words: Words, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the bytes at two places are the same; eight at a time."""
    equal = np.ones(len(a), bool)
    rows = np.flatnonzero(sizes <= LONG_GRAM)
    for done in range(0, LONG_GRAM, 8):
        rows = rows[sizes[rows] > done]
        if not len(rows):
            break
        left = np.minimum(sizes[rows] - done, 8)
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - left) * 8).astype(np.uint64)
        equal[rows] &= ((words.eight[a[rows] + done] ^ words.eight[b[rows] + done]) & mask) == 0
    for i in np.flatnonzero(sizes > LONG_GRAM).tolist():
        equal[i] = words.data[a[i] : a[i] + sizes[i]] == words.data[b[i] : b[i] + sizes[i]]
    return equal


def _tables(batch: pa.RecordBatch, column: int, grams: int, buckets: int) -> Iterator[tuple[pa.RecordBatch, Words, np.ndarray, GramTable]]:
    for first, last in byte_chunks(batch.column(column), CHUNK_BYTES):
        some = batch.slice(first, last - first)
        words = Words(some.column(column).cast(pa.binary()).to_pylist())
        starts, ends, texts = words.grams(grams)
        yield some, words, texts, GramTable(words, starts, ends, buckets)


def bucket_counts(docs: DataFrame, text: str = "text", grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)``: n-grams of all texts per bucket, repeats included. A task sends at most one row per bucket."""
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, table in _tables(batch, 0, grams, buckets):
                np.add.at(total, table.bucket, table.count)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int64()), "n": pa.array(total[used], pa.int64())})

    return rows.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Per bucket the log ratio of its smoothed shares in the target and in the corpus, scaled and floored."""
    counts = [{r["bucket"]: r["n"] for r in df.collect()} for df in (corpus, target)]  # ``buckets`` rows at most
    s, t = ([c.get(b, 0) for b in range(buckets)] for c in counts)
    every_s, every_t = sum(s) + buckets, sum(t) + buckets
    return [math.floor(SCALE * math.log((t[b] + 1) * every_s / ((s[b] + 1) * every_t))) for b in range(buckets)]


def weigh(docs: DataFrame, gains: Sequence[int], key: str = "doc_id", text: str = "text", grams: int = GRAMS) -> DataFrame:
    """``(key, n_words, n_features, weight)`` per row: the floored mean of the gains of its n-grams, 0 without any."""
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.array(gains, np.int64)
        for batch in batches:
            for some, words, texts, table in _tables(batch, 1, grams, buckets):
                features = np.bincount(texts, minlength=len(some))
                # Sums of whole numbers below 2**53, so exact in doubles.
                sums = np.bincount(texts, gain[table.bucket][table.slot], len(some)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "k": some.column(0), "n_words": pa.array(words.per_text, pa.int64()), "n_features": pa.array(features, pa.int64()),
                    "weight": pa.array(sums // np.maximum(features, 1), pa.int64()),
                })

    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, n_words bigint, n_features bigint, weight bigint").withColumnRenamed("k", key)


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Scaled and floored Gumbel noise from the key's SHA-256; the same for equal keys. A null key counts as an empty one."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0)))


def rank_rows(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Adds ``rank`` from 1 in the given order: rows are dealt by ranges, counted per range and numbered within each."""
    dealt = cut_lineage(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row per range
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    numbered = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return numbered.join(starts, "_range").select(*rows.columns, (F.col("_start") + F.col("_at")).alias("rank"))


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
    percent: int = PERCENT, seed: int = SEED, grams: int = GRAMS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
) -> DataFrame:
    """``(key, n_features, weight, score, rank)`` per row; ``rank`` of the drawn ones, null of the others.

    Drawn are ``percent`` of the rows with ``least_words`` words, those of the highest scores; of equal scores the
    smaller key goes first, null keys last, rows with the same key in any order. Null texts have no words. An empty
    target has no n-grams; an empty table gives an empty one.
    """
    gains = bucket_gains(bucket_counts(docs, text, grams, buckets), bucket_counts(target, target_text, grams, buckets), buckets)
    weighed = weigh(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), gains, "k", "t", grams)
    scored = cut_lineage(weighed.withColumn("score", F.col("weight") + gumbel(F.col("k"), seed)).withColumn("tie", F.monotonically_increasing_id()))
    long_enough = F.col("n_words") >= least_words
    eligible = scored.filter(long_enough)
    drawn = percent * eligible.count() // 100
    ranked = rank_rows(eligible, [F.desc("score"), F.asc_nulls_last("k"), F.asc("tie")])
    rest = scored.filter(~long_enough).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(rest).select(
        F.col("k").alias(key), "n_features", "weight", "score", "rank"
    )
