"""Exact removal of repeated byte strings by bounded interval expansion on Burrows-Wheeler transforms.

Which strings can be equal is found first, without moving text: of the 20-byte strings in a window of ``LENGTH`` bytes
the one with the least hash is its anchor, so equal windows have equal anchors at equal places. Consecutive windows with
one anchor make a context. Equal contexts are folded by key and count; different contexts of one anchor meet in a task,
which sorts their suffixes and derives the common prefixes of neighbours from the transform by growing length, from
intervals that are extended backwards breadth-first, and stops at ``LENGTH``: neighbours left without a value share that
many bytes or more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zoneloom.llm.decontam import _range_hashes
from zoneloom.llm.tables import byte_chunks
from zoneloom.session import cut_lineage

LENGTH = 100
ANCHOR = 20
CHUNK_BYTES = 1 << 20
BLOCK_BYTES = 1 << 19  # contexts that one transform holds; those of one anchor stay together
HOT = 20_000  # contexts of an anchor beyond which it is divided by what stands beside it
BROADCAST_BYTES = 32 << 20
NO_KEY = -(1 << 63)  # null keys sort first

_ANCHOR_BASE, _CONTEXT_BASE = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
_PLACE = np.uint64((1 << 24) - 1)


def contexts(texts: list[bytes], length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """``(text, start, run, anchor hash, anchor place, context hash)`` of the runs of windows with one anchor.

    A window's anchor is the leftmost of its least hashes (upper 40 bits). Texts over 8 MB are cut into overlapping
    parts, as places take 24 bits.
    """
    parts: list[tuple[int, int, bytes]] = []
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), 1 << 23):
            if len(t) >= length:
                parts.append((i, at, t[at : at + (1 << 23) + length - 1]))
    out = []
    first = 0
    while first < len(parts):
        last, size = first, 0
        while last < len(parts) and (last == first or size + len(parts[last][2]) <= CHUNK_BYTES):
            size += len(parts[last][2])
            last += 1
        out.append(_contexts(parts[first:last], length, anchor))
        first = last
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(c) for c in zip(*out))


def _contexts(parts: list[tuple[int, int, bytes]], length: int, anchor: int) -> tuple[np.ndarray, ...]:
    raw = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
    sizes = np.array([len(p[2]) for p in parts])
    begin = np.cumsum(sizes) - sizes
    values = raw.astype(np.uint64) + np.uint64(1)
    starts = np.arange(len(raw) - anchor + 1)
    hashes = _range_hashes(values, starts, starts + anchor, _ANCHOR_BASE)
    least = (hashes & ~_PLACE) | starts.astype(np.uint64)
    window, width = length - anchor + 1, 1
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < window:
        least = np.minimum(least[: width - window], least[window - width :])
    at = (least & _PLACE).astype(np.int64)
    part = np.repeat(np.arange(len(parts)), sizes)[: len(at)]
    inside = np.arange(len(at)) + length <= (begin + sizes)[part]
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (part[1:] != part[:-1]) | (inside[1:] != inside[:-1])))
    runs = np.flatnonzero(new)
    stops = np.append(runs[1:], len(at))
    runs, stops = runs[inside[runs]], stops[inside[runs]]
    owner = part[runs]
    texts, offsets = (np.array([p[c] for p in parts]) for c in (0, 1))
    return (
        texts[owner], offsets[owner] + runs - begin[owner], stops - runs, hashes[at[runs]].view(np.int64), at[runs] - runs,
        _range_hashes(values, runs, stops - 1 + length, _CONTEXT_BASE).view(np.int64),
    )


# A place packs the start in the text, 16 bits of a hash of the text, where the anchor lies in the first window, and the
# windows of the run less one. A document is its key, ``own`` (another 64-bit hash of its text) and those 16 bits, so
# texts that share a key stay apart.
def _pack(start: np.ndarray, text_hash: np.ndarray, at: np.ndarray, run: np.ndarray) -> np.ndarray:
    return start << 30 | text_hash << 14 | at << 7 | (run - 1)


def _text_hash(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=2).digest(), "big")


def _occurrences(rows: DataFrame, fold: bool) -> DataFrame:
    """``(anchor, context, k, own, place)`` per context of the texts ``(k, t, own)``; folded, equal contexts of a chunk are one row with
    their count ``n`` and the first of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_chunks(batch.column(1), CHUNK_BYTES):
                some = batch.slice(a, b - a)
                texts = [t.as_py().encode() for t in some.column(1)]
                keys = some.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                text, start, size, anchor, at, context = contexts(texts)
                short = np.array([_text_hash(t) for t in texts], np.int64)
                k, own, place = keys[text], some.column(2).to_numpy()[text], _pack(start, short[text], at, size)
                columns = [anchor, context, k, own, place]
                if fold and len(k):
                    order = np.lexsort((place, own, k, context, anchor))
                    columns = [c[order] for c in columns]
                    first = np.flatnonzero(np.concatenate(([True], (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1]))))
                    columns = [c[first] for c in columns] + [np.diff(np.append(first, len(order)))]
                elif fold:
                    columns.append(np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    names = ["anchor", "context", "k", "own", "place"] + ["n"] * fold
    return rows.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols or more, by doubling from seven symbols at once."""
    n = len(symbols)
    rank = np.zeros(n, np.int64)
    for i in range(7):
        rank <<= 8
        rank[: max(0, n - i)] |= symbols[i:]
    known = 7
    while True:
        order = np.argsort(rank, kind="stable")
        ordered = rank[order]
        steps = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        if known >= depth or (n and steps[-1] == n - 1):
            return order
        level = np.empty(n, np.int64)
        level[order] = steps + 1
        rank = level * (n + 2)
        rank[: max(0, n - known)] += level[known:]
        known *= 2


def long_prefixes(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix in order shares ``length`` symbols with the one before.

    ``known`` marks the common prefixes derived so far. The intervals of all strings of one length that set a value are
    extended by every symbol in front of them; an extension's right neighbour gets the current length unless it has a
    smaller one, and only those go on.
    """
    n = len(symbols)
    transform = symbols[order - 1]
    by_symbol = np.argsort(transform, kind="stable")
    back = np.empty(n, np.int64)  # place of the suffix that starts one symbol earlier
    back[by_symbol] = np.arange(n)
    same = transform[by_symbol[1:]] == transform[by_symbol[:-1]]
    following, before = np.full(n, n), np.full(n, -1)  # next and last place with the same symbol in front
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    known = np.zeros(n + 1, bool)
    left, right = np.array([0]), np.array([n - 1])
    for _ in range(length):
        sizes = right - left + 1
        ends = np.cumsum(sizes)
        at = np.repeat(left - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        new_right = np.sort(back[at[following[at] > np.repeat(right, sizes)]])
        new_left = np.sort(back[at[before[at] < np.repeat(left, sizes)]])
        fresh = ~known[new_right + 1]
        left, right = new_left[fresh], new_right[fresh]
        known[right + 1] = True
        if not len(left):
            break
    shares = ~known[:n]
    shares[:1] = False
    return shares


def repeated_starts(bodies: list[bytes], keys: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each context the windows in it that also start earlier, in another one of smaller ``(key, start)``."""
    sizes = np.array([len(b) for b in bodies])
    symbols = np.frombuffer(b"".join(b + b"\0" for b in bodies), np.uint8).astype(np.int64) + 1
    begin = np.cumsum(sizes + 1) - sizes - 1
    symbols[begin + sizes] = 0
    order = suffix_order(symbols, length)
    group = np.cumsum(~long_prefixes(symbols, order, length))
    owner = np.repeat(np.arange(len(bodies)), sizes + 1)[order]
    offset = order - begin[owner]
    whole = offset + length <= sizes[owner]
    group, owner, offset = group[whole], owner[whole], offset[whole]
    sort = np.lexsort((starts[owner] + offset, keys[owner], group))
    group, owner, offset = group[sort], owner[sort], offset[sort]
    # A divided anchor's context may stand in a block twice: only another place than the first of a group is a repeat.
    head = np.searchsorted(group, group, side="left")
    again = (keys[owner] != keys[owner[head]]) | (starts[owner] + offset != starts[owner[head]] + offset[head])
    owner, offset = owner[again], offset[again]
    by_owner = np.argsort(owner, kind="stable")
    return np.split(offset[by_owner], np.searchsorted(owner[by_owner], np.arange(1, len(bodies))))


def _bits(offsets: np.ndarray) -> tuple[int, int]:
    low = sum(1 << int(o) for o in offsets if o < 63)
    return low, sum(1 << int(o) - 63 for o in offsets if o >= 63)


MASKS = "anchor bigint, context bigint, low bigint, high bigint"


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(anchor, context, k, own, place, body)`` ordered by ``part``: one transform per block of whole parts."""
    held: list[dict] = []
    size, part = 0, None

    def solve() -> pa.RecordBatch:
        documents = [(r["k"], r["own"], r["place"] >> 14 & 0xFFFF) for r in held]
        number = {d: i for i, d in enumerate(sorted(set(documents)))}
        found = repeated_starts([r["body"] for r in held], np.array([number[d] for d in documents]), np.array([r["place"] >> 30 for r in held]))
        masks = [(r["anchor"], r["context"], *_bits(o)) for r, o in zip(held, found) if len(o)]
        return pa.RecordBatch.from_arrays([pa.array([m[i] for m in masks], pa.int64()) for i in range(4)], ["anchor", "context", "low", "high"])

    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] != part and size >= BLOCK_BYTES:
                yield solve()
                held, size = [], 0
            part = row["part"]
            held.append(row)
            size += len(row["body"])
    if held:
        yield solve()


def _bodies(needed: DataFrame, rows: DataFrame) -> DataFrame:
    """The bytes of each context, cut from the document that has it first."""
    per_doc = needed.groupBy("k", "own").agg(F.collect_list(F.struct("anchor", "context", "place")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[dict] = []
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py().encode()
                short = _text_hash(text)
                for w in batch.column(3)[i].as_py():
                    start, run_length = w["place"] >> 30, (w["place"] & 127) + 1
                    if w["place"] >> 14 & 0xFFFF == short:
                        document = {"k": batch.column(0)[i].as_py(), "own": batch.column(2)[i].as_py()}
                        found.append(w | document | {"body": text[start : start + run_length - 1 + LENGTH]})
            yield pa.RecordBatch.from_pylist(found, schema)

    schema = pa.schema([*[(n, pa.int64()) for n in ("anchor", "context", "place", "k", "own")], ("body", pa.binary())])
    ddl = "anchor bigint, context bigint, place bigint, k bigint, own bigint, body binary"
    return rows.join(per_doc, ["k", "own"]).select("k", "t", "own", "wanted").mapInArrow(run, ddl)


def _divided(bodies: DataFrame) -> DataFrame:
    """Adds ``part``, for anchors with very many contexts: the anchor with the 40 bytes before or behind it. A common
    window has 40 bytes on one side at least, so its contexts still meet, and most others part."""
    side, at = (LENGTH - ANCHOR) // 2, F.expr("cast(place >> 7 & 127 as int)")

    def beside(name: str, start: Column, enough: Column) -> Column:
        return F.when(enough, F.xxhash64(F.lit(name), "anchor", F.substring("body", start, F.lit(side))))

    divided = F.array_compact(F.array(
        beside("before", at - side + 1, at >= side), beside("behind", at + ANCHOR + 1, F.length("body") - at - ANCHOR >= side),
    ))
    return bodies.withColumn("part", F.explode(divided))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the contexts, with 128 bits of hash of its bytes."""
    for batch in batches:
        bodies = batch.column("body").to_pylist()
        sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
        counts = sizes - LENGTH + 1
        row = np.repeat(np.arange(len(bodies)), counts)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = (np.cumsum(sizes) - sizes)[row] + offset
        values = np.frombuffer(b"".join(bodies), np.uint8).astype(np.uint64) + np.uint64(1)
        hashes = [_range_hashes(values, begin, begin + LENGTH, base).view(np.int64) for base in (_ANCHOR_BASE, _CONTEXT_BASE)]
        places = batch.column("place").to_numpy()
        kept = {n: batch.column(n).take(pa.array(row)) for n in ("part", "anchor", "context", "k", "own")}
        at = (places >> 30)[row] + offset
        yield pa.RecordBatch.from_pydict(kept | {"short": (places >> 14 & 0xFFFF)[row], "at": at, "off": offset, "h1": hashes[0], "h2": hashes[1]})


def _folded_masks(parts: DataFrame) -> DataFrame:
    """Masks of the contexts of parts that no task could hold: windows meet by hash, each hash's first one is found with
    partial sums, and every other place is a repeat."""
    names = "part anchor context k own short at off h1 h2".split()
    windows = cut_lineage(parts.mapInArrow(_windows, ", ".join(f"{n} bigint" for n in names)))
    first = windows.groupBy("part", "h1", "h2").agg(F.min(F.struct("k", "own", "short", "at")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = windows.join(first, ["part", "h1", "h2"]).filter(F.struct("k", "own", "short", "at") != F.col("first"))
    bit = lambda of: F.call_function("shiftleft", F.lit(1).cast("bigint"), of.cast("int"))
    return again.groupBy("anchor", "context").agg(
        F.bit_or(F.when(F.col("off") < 63, bit(F.col("off"))).otherwise(F.lit(0).cast("bigint"))).alias("low"),
        F.bit_or(F.when(F.col("off") >= 63, bit(F.col("off") - 63)).otherwise(F.lit(0).cast("bigint"))).alias("high"),
    )


def _masks(several: DataFrame, rows: DataFrame) -> DataFrame:
    """``(anchor, context, low, high)`` of contexts that share a window with another context of their anchor."""
    columns = ["part", "anchor", "context", "k", "own", "place", "body"]
    needed = ["anchor", "context", "k", "own", "place"]

    def resolved(parts: DataFrame) -> DataFrame:
        return parts.select(*columns).repartition("part").sortWithinPartitions("part", "k", "own", "place").mapInArrow(_resolve, MASKS)

    masks = resolved(_bodies(several.filter(F.col("m") <= HOT).select(*needed), rows).withColumn("part", F.col("anchor")))
    hot = several.filter(F.col("m") > HOT)
    if not hot.isEmpty():
        parts = cut_lineage(_divided(_bodies(hot.select(*needed), rows)).select(*columns))
        sizes = cut_lineage(parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")))
        small, large = (parts.join(sizes.filter(c), "part", "left_semi") for c in (F.col("n") <= HOT, F.col("n") > HOT))
        masks = masks.union(resolved(small)).union(_folded_masks(large))
    return masks.groupBy("anchor", "context").agg(F.bit_or("low").alias("low"), F.bit_or("high").alias("high"))


def _covered(text: bytes, places: list[dict] | None) -> np.ndarray:
    """Which bytes lie in a window that a place marks: all of its run, or those of its mask."""
    steps = np.zeros(len(text) + 1, np.int64)
    for p in places or ():
        start, windows = p["place"] >> 30, (p["place"] & 127) + 1
        if p["low"] is None:
            steps[start] += 1
            steps[start + windows - 1 + LENGTH] -= 1
        else:
            marked = p["low"] | p["high"] << 63
            for i in range(windows):
                if marked >> i & 1:
                    steps[start + i] += 1
                    steps[start + i + LENGTH] -= 1
    return np.cumsum(steps[:-1]) > 0


def repeated_places(rows: DataFrame) -> DataFrame:
    """``(k, own, place, low, high)``: contexts of the rows ``(k, t, own)`` whose windows repeat earlier ones; masks where not all do."""
    folded = _occurrences(rows, fold=True)
    # Dealt by anchor once: equal contexts are counted and the contexts of an anchor are told apart in the same tasks.
    # Of one text they all come from one chunk, the first of them ahead, so the least document has the first place.
    counted = folded.repartition("anchor").groupBy("anchor", "context").agg(
        F.sum("n").alias("n"), F.min(F.struct("k", "own", (F.col("place") / F.lit(1 << 14)).cast("bigint").bitwiseAND(0xFFFF).alias("short"), "place")).alias("first")
    ).select("anchor", "context", "n", "first.k", "first.own", "first.place")
    decided = cut_lineage(counted.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("anchor"))).filter("n > 1 or m > 1"))
    masks = cut_lineage(_masks(decided.filter("m > 1"), rows))
    first = decided.join(masks, ["anchor", "context"], "left").filter("n > 1 or low is not null").select(
        "anchor", "context", F.col("k").alias("k0"), F.col("own").alias("own0"), F.col("place").alias("place0"), "low", "high"
    )
    every = _occurrences(rows, fold=False).join(first, ["anchor", "context"])
    is_first = (F.col("k") == F.col("k0")) & (F.col("own") == F.col("own0")) & (F.col("place") == F.col("place0"))
    return every.filter(~is_first | F.col("low").isNotNull()).select(
        "k", "own", "place", F.when(is_first, F.col("low")).alias("low"), F.when(is_first, F.col("high")).alias("high")
    )


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_bytes, n_removed, n_spans, kept)`` per row; ``kept`` holds the bytes that are left, as binary.

    A byte goes if a string of ``LENGTH`` bytes around it also starts earlier: in a row with a smaller key, or earlier
    in the same. Keys are whole numbers; a null key comes before all others. Rows that repeat key and text are one
    document, each returned; different texts of one key come in the order of hashes of them. Null texts count as empty ones.
    """
    rows = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(NO_KEY)).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("own", F.xxhash64("t"))
    # As long as one text has contexts, however many texts share its key; rows that repeat key and text give each place twice.
    places = cut_lineage(repeated_places(rows).groupBy("k", "own").agg(F.collect_set(F.struct("place", "low", "high")).alias("places")))
    # What a task of this stage gets of the places is checked; larger ones are joined by key.
    size = places.agg(F.sum(F.size("places").cast("bigint") * 32 + 48)).first()[0] or 0
    joined = rows.join(F.broadcast(places) if size <= BROADCAST_BYTES else places, ["k", "own"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, t, marks in zip(batch.column(0), batch.column(1), batch.column(2)):
                raw = t.as_py().encode()
                own = _text_hash(raw) if marks.is_valid else 0
                gone = _covered(raw, [p for p in marks.as_py() or () if p["place"] >> 14 & 0xFFFF == own])
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0]))
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if spans else raw
                out.append((k.as_py(), len(raw), len(raw) - len(kept), spans, kept))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.binary())], names)

    names = ["k", "n_bytes", "n_removed", "n_spans", "kept"]
    made = joined.select("k", "t", "places").mapInArrow(run, "k bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    kind = docs.schema[key].dataType
    return made.select(F.when(F.col("k") != NO_KEY, F.col("k")).cast(kind).alias(key), *names[1:])
