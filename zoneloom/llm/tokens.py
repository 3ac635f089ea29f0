"""Token-id files: a wavelet matrix per shard, written and read as compressed Parquet rows.

A shard row holds the token ids of consecutive documents as bit-planes. Plane ``b`` has bit ``b`` of every id, in the
order that the planes above leave (zeros first, ones after, each in order), and the ones before every block. Rank and
select on the planes give single tokens, counts and the places of a token without unpacking the shard.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zoneloom.llm.tables import byte_chunks, held
from zoneloom.llm.units import UnitEncoder

END_ID = 2
SHARD_TOKENS = 1 << 20  # a shard is closed once it holds so many; documents are never divided
CHUNK_BYTES = 2 << 20
BLOCK_BITS = 512
UNITS_KEPT = 1_500_000  # some 250 MB of a worker
STOPS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII punctuation but the apostrophe, which starts contractions

SHARD_SCHEMA = (
    "part int, shard int, n_tokens bigint, bits int, doc_ids array<{key}>, sizes array<bigint>, "
    "zeros array<bigint>, planes array<binary>, ranks array<binary>"
)


class WaveletMatrix:
    """Token ids as bit-planes with rank directories."""

    def __init__(self, n: int, bits: int, zeros: Sequence[int], planes: Sequence[bytes], ranks: Sequence[bytes]):
        self.n, self.bits, self.zeros = n, bits, list(zeros)
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, np.uint32) for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        zeros, planes, ranks = [], [], []
        for b in reversed(range(bits)):
            ones = (ids & ids.dtype.type(1 << b)) != 0
            packed = np.packbits(ones, bitorder="little")
            left = ids[np.flatnonzero(~ones)]  # places, not masks: a mask of mixed bits takes three times as long
            zeros.append(len(left))
            planes.append(packed.tobytes())
            ids = np.concatenate((left, ids[np.flatnonzero(ones)]))
            per_byte = np.zeros(-(-len(packed) // 64) * 64, np.uint8)
            per_byte[: len(packed)] = np.bitwise_count(packed)
            per_block = per_byte.reshape(-1, BLOCK_BITS // 8).sum(1, dtype=np.uint32)
            ranks.append(np.concatenate((np.zeros(1, np.uint32), np.cumsum(per_block, dtype=np.uint32))).tobytes())
        return cls(len(ids), bits, zeros, planes, ranks)

    def tokens(self) -> np.ndarray:
        """All ids, from the last plane upwards."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        ids = np.zeros(self.n, kind)
        for b, zeros, plane in zip(range(self.bits), reversed(self.zeros), reversed(self.planes)):
            ones = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            above = np.empty(self.n, kind)
            above[np.flatnonzero(~ones)] = ids[:zeros]
            above[np.flatnonzero(ones)] = ids[zeros:] | kind(1 << b)
            ids = above
        return ids

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block = i // BLOCK_BITS
        first = block * (BLOCK_BITS // 8)
        rest = np.unpackbits(self.planes[level][first : -(-i // 8)], bitorder="little")[: i - block * BLOCK_BITS]
        return int(self.ranks[level][block]) + int(rest.sum())

    def _place(self, level: int, k: int, bit: int) -> int:
        """Position of the ``k``-th (from 0) one or zero of a plane."""
        before = self.ranks[level] if bit else np.arange(len(self.ranks[level])) * BLOCK_BITS - self.ranks[level].astype(np.int64)
        block = int(np.searchsorted(before, k, side="right")) - 1
        first = block * (BLOCK_BITS // 8)
        bits = np.unpackbits(self.planes[level][first : first + BLOCK_BITS // 8], bitorder="little")
        return block * BLOCK_BITS + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        value = 0
        for level in range(self.bits):
            ones = self._ones(level, i)
            bit = self._ones(level, i + 1) - ones
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, upto: int) -> tuple[int, int]:
        lo, hi = 0, upto
        for level in range(self.bits):
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.bits - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, upto: int | None = None) -> int:
        """Occurrences of a token among the first ``upto`` ids."""
        if token >> self.bits:
            return 0
        lo, hi = self._range(token, self.n if upto is None else upto)
        return hi - lo

    def find(self, token: int, k: int) -> int:
        """Position of the ``k``-th occurrence (from 0) of a token."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._range(token, self.n)[0] + k
        for level in reversed(range(self.bits)):
            bit = token >> (self.bits - 1 - level) & 1
            i = self._place(level, i - self.zeros[level] if bit else i, bit)
        return i


def _byte_letters() -> dict[int, str]:
    """The characters by which byte-level tokenizers write bytes from 128: the printable ones of Latin-1 themselves, the
    others, and the 67 before them, follow each other from 256."""
    hidden = [*range(33), *range(127, 161), 173]
    return {b: chr(256 + i) for i, b in enumerate(hidden) if b >= 128}


def _encoder(path: str, special: bool) -> tuple[UnitEncoder, int]:
    """A worker's encoder, kept between its tasks, and the bits of an id. The tasks are the threads: it starts none."""
    return held(f"tokens {special} {path}", lambda: _make_encoder(path, special))


def _make_encoder(path: str, special: bool) -> tuple[UnitEncoder, int]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not special
    bits = max(tokenizer.get_vocab_size() - 1, END_ID).bit_length()

    model, table, newline = tokenizer.model, _byte_letters(), tokenizer.encode("\n", add_special_tokens=False).ids
    # A byte-level tokenizer takes letters, the stops behind them and a single line end apart before it joins anything.
    pieces = tokenizer.pre_tokenizer.pre_tokenize_str(" é.\nA") if tokenizer.pre_tokenizer else []
    apart = tokenizer.normalizer is None and [w for w, _ in pieces] == ["Ġ" + "é".encode().decode("latin-1").translate(table), ".", "Ċ", "A"]

    @lru_cache(maxsize=10_000)
    def stops(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    def by_parts(space: bool, unit: str, words: dict[tuple[bool, str], list[int]]) -> list[int] | None:
        """The ids of a unit of letters, stops and single line ends; ``None`` for any other."""
        if space and unit.isascii() and unit.isalpha():
            return [t.id for t in model.tokenize("Ġ" + unit)]
        ids: list[int] = []
        for n, line in enumerate(unit.split("\n")):
            word = line.rstrip(STOPS)
            first = space and not n
            if word and not (word.isalpha() and (word.isascii() or max(word) < "\u0250")) or not line:
                return None
            if n:
                ids += newline
            if word:
                if (first, word) not in words:
                    letters = word if word.isascii() else word.encode().decode("latin-1").translate(table)
                    words[first, word] = [t.id for t in model.tokenize("Ġ" + letters if first else letters)]
                ids += words[first, word]
            if len(line) > len(word):
                ids += stops(line[len(word) :] if word or not first else " " + line)
        return ids

    def encode_new(units: Sequence) -> tuple[np.ndarray, np.ndarray]:
        words: dict[tuple[bool, str], list[int]] = {}
        found = [(by_parts(False, u[0], words) if isinstance(u, tuple) else by_parts(True, u, words)) if apart else None for u in units]
        rest = [i for i, ids in enumerate(found) if ids is None]
        texts = [units[i][0] if isinstance(units[i], tuple) else " " + units[i] for i in rest]
        for i, e in zip(rest, tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            found[i] = e.ids
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum())), sizes

    return UnitEncoder(encode_new, np.uint16 if bits <= 16 else np.uint32, UNITS_KEPT), bits


def _with_ends(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Every document's ids followed by the end id."""
    return np.insert(ids, np.cumsum(sizes), end), sizes + 1


def _shard_rows(batches: Iterator[pa.RecordBatch], path: str, special: bool, end: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    encoder, bits = _encoder(path, special)
    part, shard = TaskContext.get().partitionId(), 0
    keys: list = []
    ids: list[np.ndarray] = []
    sizes: list[np.ndarray] = []

    def close() -> pa.RecordBatch:
        m = WaveletMatrix.build(np.concatenate(ids), bits)
        row = [part, shard, m.n, bits, [k for ks in keys for k in ks], np.concatenate(sizes).tolist(), m.zeros, [p.tobytes() for p in m.planes], [r.tobytes() for r in m.ranks]]
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, row))], schema)

    for batch in batches:
        for first, last in byte_chunks(batch.column(1), CHUNK_BYTES):
            some = batch.slice(first, last - first)
            found, lengths = _with_ends(*encoder.encode(some.column(1).to_pylist()), end)
            keys.append(some.column(0).to_pylist())
            ids.append(found)
            sizes.append(lengths)
            if sum(map(len, ids)) >= SHARD_TOKENS:
                yield close()
                keys, ids, sizes, shard = [], [], [], shard + 1
    if keys:
        yield close()


def write_token_files(
    docs: DataFrame, out: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = END_ID, special: bool = True,
) -> None:
    """Write the ids of all documents, ordered by key, as shard files below ``out``.

    Rows are dealt over tasks by ranges of the key and sorted there (null keys first, repeated keys by text). A null
    text counts as an empty one, which has the end id alone; an empty table has no shards. The strings of special
    tokens become those tokens, as the library does by default, or with ``special=False`` are encoded like other text.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    dealt = rows.repartitionByRange(F.col("k").asc_nulls_first()).sortWithinPartitions(F.col("k").asc_nulls_first(), "t")
    ddl = SHARD_SCHEMA.format(key=rows.schema["k"].dataType.simpleString())
    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], ddl).schema)
    made = dealt.mapInArrow(lambda batches: _shard_rows(batches, tokenizer, special, end, schema), ddl)
    made.write.option("compression", "zstd").parquet(out)


def shard_starts(files: DataFrame) -> DataFrame:
    """``(part, shard, start)``: tokens before each shard. Sums per part are added up first, then within the parts."""
    sizes = files.select("part", "shard", "n_tokens")
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", earlier(Window.orderBy("part")).alias("before"))
    within = sizes.withColumnRenamed("n_tokens", "n").withColumn("inner", earlier(Window.partitionBy("part").orderBy("shard")))
    return within.join(parts, "part").select("part", "shard", (F.col("before") + F.col("inner")).alias("start"))


def _matrix(row: dict) -> WaveletMatrix:
    return WaveletMatrix(row["n_tokens"], row["bits"], row["zeros"], row["planes"], row["ranks"])


def read_documents(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """``(key, start, n_tokens, ids_crc32)`` per document, from the files alone."""
    files = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = _matrix(row).tokens().astype("<u4")
                sizes = np.array(row["sizes"], np.int64)
                ends = np.cumsum(sizes)
                view = memoryview(ids.tobytes())
                sums = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                n = len(sizes)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["part"]] * n, pa.int32()), pa.array([row["shard"]] * n, pa.int32()),
                    batch.slice(i, 1).column(names.index("doc_ids")).flatten(), pa.array(ends - sizes), pa.array(sizes), pa.array(sums, pa.int64()),
                ], ["part", "shard", "k", "inner", "n_tokens", "ids_crc32"])

    names = files.columns
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    docs = files.mapInArrow(run, f"part int, shard int, k {kind}, inner bigint, n_tokens bigint, ids_crc32 bigint")
    placed = docs.join(shard_starts(files), ["part", "shard"])
    return placed.select(F.col("k").alias(key), (F.col("start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def find_tokens(spark: SparkSession, path: str, tokens: Sequence[int]) -> DataFrame:
    """``(token, position)`` of every occurrence, found by select on the planes; positions run over all shards."""
    files = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                matrix = _matrix(row)
                for token in tokens:
                    places = [matrix.find(token, k) for k in range(matrix.count(token))]
                    yield pa.RecordBatch.from_pydict({
                        "part": pa.array([row["part"]] * len(places), pa.int32()), "shard": pa.array([row["shard"]] * len(places), pa.int32()),
                        "token": pa.array([token] * len(places), pa.int32()), "inner": pa.array(places, pa.int64()),
                    })

    found = files.mapInArrow(run, "part int, shard int, token int, inner bigint").join(shard_starts(files), ["part", "shard"])
    return found.select("token", (F.col("start") + F.col("inner")).alias("position"))
