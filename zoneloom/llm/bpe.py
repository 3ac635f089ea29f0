"""Byte-level BPE: boundaries by a scan of transition functions, cached pair merging, offsets kept for decoding.

Text is taken as arrays of code point classes. An automaton over the classes says at which code points a slice starts;
its transition functions are composed blockwise (composition is associative), so every block of a batch advances
together. Each distinct slice is merged once per worker; new slices are merged together, one numpy step per merge.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zoneloom.llm.tables import byte_chunks, held
from zoneloom.llm.units import UnitEncoder, gather

CHUNK_BYTES = 1 << 20
BLOCK = 512  # code points that are composed one after another, in all blocks at once
SLICES_KEPT = 200_000  # of a worker; beyond so many they are merged anew, with the same result
LONG_SLICE = 64  # bytes; longer slices are merged one by one with a heap

# Classes of code points.
LETTER, NUMBER, OTHER, SPACE, WHITE = range(5)
# The code points with the White_Space property, in ranges.
WHITE_SPACE = ((9, 13), (32, 32), (133, 133), (160, 160), (5760, 5760), (8192, 8202), (8232, 8233), (8239, 8239), (8287, 8287), (12288, 12288))
# Letters behind an apostrophe that make a slice with it.
SINGLE_ENDINGS, DOUBLE_ENDINGS = "stmd", ("re", "ve", "ll")

# What the automaton reads: classes, apostrophes that start an ending of one or two letters, and white space by what follows.
READ_LETTER, READ_NUMBER, READ_OTHER, READ_ONE, READ_TWO, READ_SPACE, READ_WHITE, READ_INNER = range(8)
# Where it stands: between slices; in a run; behind a space that joins the next run; in white space; letters of an ending due.
BETWEEN, IN_LETTERS, IN_NUMBERS, IN_OTHERS, JOINING, IN_WHITE, ONE_DUE, TWO_DUE = range(8)
STATES = 8


def _step(state: int, read: int) -> tuple[int, bool]:
    """The next state, and whether a slice starts at what is read."""
    if state in (ONE_DUE, TWO_DUE):
        return (BETWEEN if state == ONE_DUE else ONE_DUE), False
    if read in (READ_ONE, READ_TWO):
        if state in (IN_OTHERS, JOINING):
            return IN_OTHERS, False
        return (ONE_DUE if read == READ_ONE else TWO_DUE), True
    if read == READ_SPACE:
        return JOINING, True
    if read == READ_WHITE:
        return BETWEEN, True
    if read == READ_INNER:
        return IN_WHITE, state != IN_WHITE
    run = {READ_LETTER: IN_LETTERS, READ_NUMBER: IN_NUMBERS, READ_OTHER: IN_OTHERS}[read]
    return run, state not in (run, JOINING)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Next states and starts by ``(what is read, state)``; rows from 8 on are for the first of a text."""
    steps = [[_step(state if read < 8 else BETWEEN, read % 8) for state in range(STATES)] for read in range(16)]
    return np.array([[s for s, _ in row] for row in steps], np.uint8).ravel(), np.array([[b for _, b in row] for row in steps], bool).ravel()


NEXT, STARTS = _tables()


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    for first, last in WHITE_SPACE:
        table[first : last + 1] = WHITE
    table[32] = SPACE
    return table


def _read(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What the automaton reads at each code point; ``first`` marks those that begin a text and has two more, true."""
    kind = _classes()[points]
    white = kind >= SPACE
    followed = np.zeros(len(points), bool)  # by another than white space, in the same text
    followed[:-1] = ~white[1:]
    followed &= ~first[1:-1]
    read = np.where(white, np.where(followed, np.where(kind == SPACE, READ_SPACE, READ_WHITE), READ_INNER), kind).astype(np.uint8)
    quotes = np.flatnonzero(points == ord("'"))
    if len(quotes):
        after = np.concatenate((points, np.zeros(2, points.dtype)))
        inside = ~first[quotes + 1]
        one = inside & np.isin(after[quotes + 1], [ord(c) for c in SINGLE_ENDINGS])
        two = inside & ~first[quotes + 2] & np.any([(after[quotes + 1] == ord(a)) & (after[quotes + 2] == ord(b)) for a, b in DOUBLE_ENDINGS], axis=0)
        read[quotes[one]], read[quotes[two]] = READ_ONE, READ_TWO
    return read + np.where(first[:-2], 8, 0).astype(np.uint8)


def slice_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a slice starts at each code point of texts in a row; ``first`` as for ``_read``."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, READ_INNER, np.uint8)
    padded[:n] = _read(points, first)
    rows = np.multiply(padded.reshape(blocks, BLOCK).T, STATES, dtype=np.uint8)  # a row per place in the blocks
    through = np.tile(np.arange(STATES, dtype=np.uint8), (blocks, 1))  # each block's function from state to state
    for row in rows:
        through = NEXT[row[:, None] + through]
    distance = 1
    while distance < blocks:  # functions of all blocks up to each, by doubling
        through[distance:] = np.take_along_axis(through[distance:], through[:-distance], 1)
        distance *= 2
    state = np.concatenate((np.full(1, BETWEEN, np.uint8), through[:-1, BETWEEN]))
    found = np.empty((BLOCK, blocks), bool)
    for place, row in enumerate(rows):
        at = row + state
        found[place], state = STARTS[at], NEXT[at]
    return found.T.ravel()[:n]


class PairTable:
    """Ranks of pairs of ids that merge, in an open-addressed table."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.none = max(ranks.values(), default=0) + 1
        self._bits = max(4, (4 * len(pairs)).bit_length())
        self._keys, self._ranks = np.full(1 << self._bits, -1, np.int64), np.full(1 << self._bits, self.none, np.int32)
        both = np.array(list(pairs), np.int64).reshape(-1, 2)
        keys, values = both[:, 0] << 32 | both[:, 1], np.fromiter(pairs.values(), np.int32, len(pairs))
        slots = self._home(keys)
        while len(keys):
            free = self._keys[slots] == -1
            self._keys[slots[free]] = keys[free]  # of several the last stays
            placed = self._keys[slots] == keys
            self._ranks[slots[placed]] = values[placed]
            keys, values, slots = keys[~placed], values[~placed], (slots[~placed] + 1) % len(self._keys)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self._bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``none`` where the two do not merge."""
        keys = left.astype(np.int64) << 32 | right
        slots = self._home(keys)
        found = self._keys[slots]
        out = np.where(found == keys, self._ranks[slots], np.int32(self.none))
        rows = np.flatnonzero((found != keys) & (found != -1))
        while len(rows):
            slots[rows] = (slots[rows] + 1) % len(self._keys)
            found = self._keys[slots[rows]]
            out[rows] = np.where(found == keys[rows], self._ranks[slots[rows]], self.none)
            rows = rows[(found != keys[rows]) & (found != -1)]
        return out


class ByteBPE:
    """Merges by rank. The lowest rank goes first, of equal ones the leftmost; a slice that is a token is one id."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = PairTable(self.ranks)
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.token_size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def merge(self, slices: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all slices in a row and the number of ids per slice."""
        lengths = np.fromiter(map(len, slices), np.int64, len(slices))
        known = np.fromiter((self.ranks.get(s, -1) for s in slices), np.int32, len(slices))
        counts = np.where(known >= 0, 1, 0).astype(np.int64)
        found, order = [known[known >= 0]], [np.flatnonzero(known >= 0)]
        rest = np.flatnonzero(known < 0)
        rest = rest[np.argsort(lengths[rest], kind="stable")]
        short = rest[lengths[rest] <= LONG_SLICE]
        for some in np.array_split(short, max(1, len(short) // 4096)):
            if len(some):
                ids, counts[some] = self._together([slices[i] for i in some], lengths[some])
                found.append(ids)
                order.append(some)
        for i in rest[len(short) :].tolist():
            ids = self._alone(slices[i])
            counts[i] = len(ids)
            found.append(np.array(ids, np.int32))
            order.append(np.array([i]))
        done = np.concatenate(order)
        starts = np.empty(len(slices), np.int64)
        starts[done] = np.cumsum(counts[done]) - counts[done]
        return gather(np.concatenate(found), starts, counts), counts

    def _together(self, slices: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slices of similar length: each step merges one pair of every slice that still has one."""
        n, width, none = len(slices), int(lengths.max()), self.pairs.none
        places = np.arange(width)
        alive = places < lengths[:, None]
        ids = np.zeros((n, width), np.int32)
        ids[alive] = self.byte_id[np.frombuffer(b"".join(slices), np.uint8)]
        after, before = np.tile(places + 1, (n, 1)), np.tile(places - 1, (n, 1))
        ranks = np.full((n, width), none, np.int32)  # of the pair that starts at a place
        inner = alive[:, 1:]
        ranks[:, :-1][inner] = self.pairs.rank(ids[:, :-1][inner], ids[:, 1:][inner])
        rows = np.arange(n)
        while True:
            at = ranks[rows].argmin(1) if len(rows) < n else ranks.argmin(1)
            merged = ranks[rows, at]
            rows, at, merged = (a[merged < none] for a in (rows, at, merged))
            if not len(rows):
                return ids[alive], alive.sum(1)
            gone = after[rows, at]
            following, earlier = after[rows, gone], before[rows, at]
            ids[rows, at], alive[rows, gone], ranks[rows, gone] = merged, False, none
            after[rows, at] = following
            more = following < lengths[rows]
            before[rows[more], following[more]] = at[more]
            ranks[rows, at] = none
            ranks[rows[more], at[more]] = self.pairs.rank(merged[more], ids[rows[more], following[more]])
            back = earlier >= 0
            ranks[rows[back], earlier[back]] = self.pairs.rank(ids[rows[back], earlier[back]], merged[back])

    def _alone(self, piece: bytes) -> list[int]:
        """One long slice, its pairs in a heap by rank and place."""
        raw = self.byte_id[np.frombuffer(piece, np.uint8)]
        firsts = self.pairs.rank(raw[:-1], raw[1:]).tolist()
        ids, n, none = raw.tolist(), len(piece), self.pairs.none
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(firsts) if r < none]
        heapq.heapify(heap)

        def push(i: int, j: int) -> None:
            rank = int(self.pairs.rank(np.array([ids[i]]), np.array([ids[j]]))[0])
            if rank < none:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # one of the two has been merged since
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                push(i, after[j])
            if before[i] >= 0:
                push(before[i], i)
        return [x for x in ids if x >= 0]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The bytes of all ids in a row; ``offsets`` are where each id's bytes start, and the end of the last."""
        sizes = self.token_size[ids]
        if not np.array_equal(np.diff(offsets), sizes):
            raise ValueError("ids and offsets do not belong together")
        return gather(self.token_bytes, self.token_start[ids], sizes)


def _codec(path: str) -> tuple[ByteBPE, UnitEncoder]:
    """A worker's ranks and slices, kept between its tasks."""
    def make() -> tuple[ByteBPE, UnitEncoder]:
        bpe = ByteBPE(path)
        return bpe, UnitEncoder(bpe.merge, np.int32, SLICES_KEPT)

    return held(f"bpe {path}", make)


def encode_chunk(bpe: ByteBPE, cache: UnitEncoder, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts in a row, ids per text, bytes per text, and the place of each id's bytes in all texts joined."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    first = np.zeros(len(points) + 2, bool)
    first[-2:] = True
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    starts = np.flatnonzero(slice_starts(points, first))
    data = joined.encode()
    widths = 1 + (points > 0x7F) + (points > 0x7FF).astype(np.int64) + (points > 0xFFFF)
    byte_at = np.concatenate((np.zeros(1, np.int64), np.cumsum(widths)))
    ends = np.append(byte_at[starts[1:]], len(data)) if len(starts) else starts
    slices = [data[a:b] for a, b in zip(byte_at[starts].tolist(), ends.tolist())]
    ids, per_slice = cache.units(slices)
    bounds = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
    upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(per_slice)))[np.searchsorted(starts, bounds)]
    id_sizes = bpe.token_size[ids]
    return ids, np.diff(upto), np.diff(byte_at[bounds]), np.cumsum(id_sizes) - id_sizes


def encode_bytes(docs: DataFrame, ranks: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """``(key, ids, offsets)`` per row: the ids of the whole text and where in its UTF-8 bytes each id starts.

    Null and empty texts have empty arrays. Rows are handled one by one, whatever their key, so nothing is shuffled;
    an empty table gives an empty one. With ``decoded`` the same pass adds what ``decode_bytes`` makes of them.
    """
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cache = _codec(ranks)
        for batch in batches:
            for start, stop in byte_chunks(batch.column(1), CHUNK_BYTES):
                some = batch.slice(start, stop - start)
                ids, counts, sizes, places = encode_chunk(bpe, cache, some.column(1).to_pylist())
                bounds = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
                offsets = (places - np.repeat(np.cumsum(sizes) - sizes, counts)).astype(np.int32)
                columns = {"k": some.column(0), "ids": pa.ListArray.from_arrays(bounds, pa.array(ids)), "offsets": pa.ListArray.from_arrays(bounds, pa.array(offsets))}
                yield pa.RecordBatch.from_pydict(columns | ({"decoded": _decoded(bpe, ids, places, sizes)} if decoded else {}))

    kind = rows.schema["k"].dataType.simpleString()
    more = ", decoded binary" if decoded else ""
    return rows.mapInArrow(run, f"k {kind}, ids array<int>, offsets array<int>{more}").withColumnRenamed("k", key)


def _decoded(bpe: ByteBPE, ids: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The bytes of texts with so many bytes, from their ids and the places of these."""
    data = bpe.decode(ids, np.append(places, sizes.sum())).tobytes()
    ends = np.cumsum(sizes).tolist()
    return pa.array([data[a:b] for a, b in zip([0, *ends], ends)], pa.binary())


def decode_bytes(encoded: DataFrame, ranks: str, ids: str = "ids", offsets: str = "offsets") -> DataFrame:
    """Adds ``decoded``, the bytes that the ids stand for, each put at its offset. Null ids stand for no bytes.

    Ids and offsets that do not belong together are an error.
    """
    kept = [c for c in encoded.columns if c != "decoded"]
    none = F.array().cast("array<int>")
    rows = encoded.select(F.struct(*kept).alias("row"), F.coalesce(ids, none).alias("ids"), F.coalesce(offsets, none).alias("offsets"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _codec(ranks)[0]
        for batch in batches:
            lists = [batch.column(i) for i in (1, 2)]
            bounds, numbers = lists[0].offsets.to_numpy(), [x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
            counts = np.diff(bounds)
            if not np.array_equal(counts, np.diff(lists[1].offsets.to_numpy())):
                raise ValueError("ids and offsets do not belong together")
            upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(bpe.token_size[numbers[0]])))
            sizes = np.diff(upto[bounds - bounds[0]])
            places = numbers[1] + np.repeat(np.cumsum(sizes) - sizes, counts)
            yield pa.RecordBatch.from_pydict({"row": batch.column(0), "decoded": _decoded(bpe, numbers[0], places, sizes)})

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, decoded binary").select("row.*", "decoded")
