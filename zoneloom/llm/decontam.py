"""Benchmark decontamination by template windows.

Texts become tokens (ASCII case and punctuation dropped); numbers, units after numbers, and names (capitalised inside a
sentence) become typed slots. Windows of tokens are hashed with slots in place of values, so a question with other
numbers or names still matches; whether the values were exchanged one for one is checked afterwards.

Items that such windows say too little of are looked for as they stand: with values in place of slots, or, in scripts
written without spaces, by windows of characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zoneloom.llm.tables import byte_chunks, free_name, held
from zoneloom.session import cut_lineage

WINDOW = 5  # tokens; items with fewer have one window of their own length
LEAST_WORDS = 3  # tokens of a window that are not slots; windows with fewer say nothing
WHOLE = 8  # tokens of an item that is looked for as it stands, up to which it is one window
CHARACTERS, WHOLE_CHARACTERS = 10, 16  # the same two sizes for characters of scripts without spaces
COVERAGE = 0.5  # share of an item's windows that a document has to hold
CONSISTENCY = 0.8  # least share of an item's slot values that stand for one value each
DRIFT = 16  # tokens that an occurrence may be shifted along its length, at most; a quarter of the item's windows if fewer
BLOCK_WINDOWS = 1 << 20  # benchmark windows that go to the tasks at once; a larger benchmark takes several passes
CHUNK_BYTES = 1 << 19

UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb oz ml l s sec second seconds min minute minutes h hour hours day days week weeks month months "
    "year years percent pct dollar dollars cent cents euro euros pound pounds usd eur gbp mph kmh kb mb gb tb hz w kw v a meter meters "
    "metre metres inch inches foot feet yard yards mile miles gram grams liter liters litre litres degree degrees"
)
NUMBER, UNIT, NAME = 1, 2, 3
# How a window is hashed; a window's size carries it, so hashes of one way never meet those of another.
TEMPLATE, VERBATIM, UNSPACED = 0, 32, 64
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u3096\u309d-\u30fa\u30fc-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_WIDE_STOPS = re.compile("[\u3000-\u303f\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE, _KEPT, _ENDER, _DIGIT, _CAPITAL = (np.zeros(256, bool) for _ in range(5))
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_KEPT[48:58] = _KEPT[65:91] = _KEPT[97:123] = _KEPT[128:] = True
_ENDER[list(b".!?:;\n")] = True
_DIGIT[48:58] = True
_CAPITAL[65:91] = True
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, at least ``n``."""
    powers: dict[int, tuple[np.ndarray, np.ndarray]] = held("decontamination", dict)
    if base not in powers or len(powers[base][0]) < n:
        size = max(n, CHUNK_BYTES + (1 << 14))
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        powers[base] = (tables[0], tables[1])
    return powers[base]


def _range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A hash of ``values[s:e]`` for every range, the same wherever the range lies."""
    powers, inverse = _power_tables(base, len(values) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * powers[: len(values)], dtype=np.uint64)))
    h = (sums[ends] - sums[starts]) * inverse[starts]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _unit_hashes() -> np.ndarray:
    raw = np.frombuffer(UNITS.replace(" ", "").encode(), np.uint8)
    sizes = np.array([len(u) for u in UNITS.split()])
    ends = np.cumsum(sizes)
    return np.sort(_range_hashes(raw.astype(np.uint64) + np.uint64(1), ends - sizes, ends, _BASE))


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


class Templates:
    """The tokens of some texts: ``doc`` (row of the text), ``value`` (hash of the token), ``kind`` (0 or a slot type)."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join(texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        doc_start = np.cumsum(sizes + 1) - sizes - 1
        kept = np.flatnonzero(_KEPT[raw])
        word = np.cumsum(_SPACE[raw], dtype=np.int64)[kept]
        starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(kept)), bool), word[1:] != word[:-1])))
        ends = np.append(starts[1:], len(kept))[: len(starts)]
        letters = _LOWER[raw[kept]].astype(np.uint64) + np.uint64(1)
        self.value = _range_hashes(letters, starts, ends, _BASE)
        at = kept[starts]
        self.doc = np.searchsorted(doc_start, at, side="right") - 1
        n = len(starts)
        same = np.concatenate((np.zeros(min(1, n), bool), self.doc[1:] == self.doc[:-1]))
        enders = np.cumsum(_ENDER[raw], dtype=np.int64)
        before = np.concatenate((at[:1], kept[ends[:-1] - 1]))[:n]
        inside = same & (enders[at] == enders[before])
        number = _DIGIT[raw[at]]
        after = np.concatenate((np.zeros(min(1, n), bool), number[:-1])) & same
        self.kind = np.zeros(n, np.int64)
        self.kind[_CAPITAL[raw[at]] & inside & ~number] = NAME
        self.kind[after & _member(self.value, _unit_hashes())] = UNIT
        self.kind[number] = NUMBER
        self.place = np.arange(n) - np.searchsorted(self.doc, self.doc, side="left")  # within the text
        self.count = np.bincount(self.doc, minlength=len(texts))

    def windows(self, size: int, verbatim: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """First tokens of the windows that lie in one text and have words enough, and the windows' hashes; verbatim
        windows need no words, and their values are hashed."""
        first = np.arange(max(0, len(self.doc) - size + 1))
        slots = np.concatenate(([0], np.cumsum(self.kind > 0)))
        good = self.doc[first] == self.doc[first + size - 1]
        if not verbatim:
            good &= slots[first + size] - slots[first] <= size - LEAST_WORDS
        first = first[good]
        shown = self.value if verbatim else np.where(self.kind > 0, self.kind.astype(np.uint64), self.value)
        return first, _range_hashes(shown, first, first + size, _STEP).view(np.int64)

    def slots(self, first: int, size: int) -> list[dict]:
        return [
            {"at": i, "kind": int(self.kind[first + i]), "value": int(self.value[first + i].view(np.int64))}
            for i in range(size) if self.kind[first + i]
        ]


def _spaced(text: str) -> str:
    """The text with every character of a script without spaces as a word of its own."""
    return _UNSPACED.sub(r" \g<0> ", _WIDE_STOPS.sub(" ", text))


def _enough(made: Templates, size: int, whole: int) -> np.ndarray:
    """Texts of which template windows keep half or more of the places."""
    kept = np.zeros(len(made.count), np.int64)
    for n in range(LEAST_WORDS, whole + 1):
        first, _ = made.windows(n)
        of_size = _size_of(made.count, size, whole)[made.doc[first]] == n
        np.add.at(kept, made.doc[first[of_size]], 1)
    return (2 * kept >= made.count - _size_of(made.count, size, whole) + 1) & (kept > 0)


def _size_of(count: np.ndarray, size: int, whole: int) -> np.ndarray:
    """Tokens of a text's windows: all of them up to ``whole``."""
    return np.where(count <= whole, count, size)


def _item_windows(texts: list[str]) -> Iterator[tuple[int, Templates, np.ndarray, np.ndarray, np.ndarray]]:
    """``(size, templates, rows of the texts, first tokens, hashes)`` of all windows that the items stand for."""
    plain, spaced = (Templates([t.encode() for t in ts]) for ts in (texts, [_spaced(t) for t in texts]))
    rows = np.arange(len(texts))
    unspaced = np.fromiter((len(_UNSPACED.findall(t)) for t in texts), np.int64, len(texts)) > plain.count
    unspaced &= _enough(spaced, CHARACTERS, WHOLE_CHARACTERS)
    verbatim = ~unspaced & ~_enough(plain, WINDOW, WINDOW)
    for made, kind, least, size, whole, wanted in (
        (plain, TEMPLATE, LEAST_WORDS, WINDOW, WINDOW, rows >= 0), (plain, VERBATIM, 1, WINDOW, WHOLE, verbatim),
        (spaced, UNSPACED, LEAST_WORDS, CHARACTERS, WHOLE_CHARACTERS, unspaced),
    ):
        for n in range(least, whole + 1):
            first, hashes = made.windows(n, kind == VERBATIM)
            hit = (_size_of(made.count, size, whole)[made.doc[first]] == n) & wanted[made.doc[first]]
            yield kind + n, made, rows, first[hit], hashes[hit]


def _text_windows(texts: list[str], wanted: dict[int, np.ndarray]) -> Iterator[tuple[int, Templates, np.ndarray, np.ndarray, np.ndarray]]:
    """The same for the windows of any texts that are wanted; a verbatim one counts once in a text."""
    made: dict[int, tuple[Templates, np.ndarray]] = {}
    for code, ordered in wanted.items():
        kind, size = code & ~31, code & 31
        if (kind == UNSPACED) not in made:
            rows = np.array([i for i, t in enumerate(texts) if kind != UNSPACED or not t.isascii() and _UNSPACED.search(t)], np.int64)
            made[kind == UNSPACED] = Templates([(_spaced(texts[i]) if kind == UNSPACED else texts[i]).encode() for i in rows]), rows
        tokens, rows = made[kind == UNSPACED]
        first, hashes = tokens.windows(size, kind == VERBATIM)
        hit = _member(hashes, ordered)
        first, hashes = first[hit], hashes[hit]
        if kind == VERBATIM:
            order = np.lexsort((hashes, tokens.doc[first]))
            first, hashes = first[order], hashes[order]
            new = np.concatenate((np.ones(min(1, len(first)), bool), (hashes[1:] != hashes[:-1]) | (tokens.doc[first][1:] != tokens.doc[first][:-1])))
            first, hashes = first[new], hashes[new]
        yield code, tokens, rows, first, hashes


ROW = "row bigint, size int, hash bigint, place bigint, slots array<struct<at: int, kind: int, value: bigint>>"


def _window_rows(df: DataFrame, key: str, text: str, wanted: dict[int, np.ndarray] | None) -> DataFrame:
    """``(key, row, size, hash, place, slots)`` of the texts' windows: those in ``wanted``, or all an item stands for.
    ``row`` tells texts with one key apart."""
    rows = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.xxhash64(text).alias("row"))
    ddl = f"k {rows.schema['k'].dataType.simpleString()}, {ROW}"
    slot_type = pa.list_(pa.struct([("at", pa.int32()), ("kind", pa.int32()), ("value", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_chunks(batch.column(1), CHUNK_BYTES):
                some = batch.slice(a, b - a)
                texts = some.column(1).to_pylist()
                for size, made, at, first, hashes in _item_windows(texts) if wanted is None else _text_windows(texts, wanted):
                    row = pa.array(at[made.doc[first]])
                    slots = [made.slots(int(f), size & 31) if size < VERBATIM or size >= UNSPACED else [] for f in first]
                    yield pa.RecordBatch.from_arrays([
                        *[some.column(c).take(row) for c in (0, 2)], pa.array(np.full(len(first), size, np.int32)), pa.array(hashes),
                        pa.array(made.place[first]), pa.array(slots, slot_type),
                    ], ["k", "row", "size", "hash", "place", "slots"])

    return rows.mapInArrow(run, ddl).withColumnRenamed("k", key)


def _best_occurrence(hits: dict[str, np.ndarray], slots: list[list[tuple]], n_windows: int) -> tuple[int, float] | None:
    """``(n_matched, consistency)`` of the best place where a text holds an item, ``None`` if there is none.

    Hits are aligned by document place minus item place. Around each such shift every item window takes the nearest
    hit, and each document window serves one item window.
    """
    drift = min(DRIFT, max(1, n_windows // 4))
    shift = hits["place"] - hits["item_place"]
    order = np.argsort(shift, kind="stable")
    ordered = shift[order]
    anchors = np.unique(ordered)
    lows, highs = np.searchsorted(ordered, anchors - drift), np.searchsorted(ordered, anchors + drift, side="right")
    best = None
    for anchor, low, high in zip(anchors, lows, highs):
        if high - low < COVERAGE * n_windows:
            continue
        band = order[low:high]
        for side, other in (("item_place", "place"), ("place", "item_place")):
            band = band[np.lexsort((hits[other][band], np.abs(shift[band] - anchor), hits[side][band]))]
            band = band[np.concatenate(([True], hits[side][band][1:] != hits[side][band][:-1]))]
        matched = len(np.unique(hits["hash"][band]))
        if matched < COVERAGE * n_windows:
            continue
        values: dict[tuple, set] = {}
        for kind, item_value, value in (x for i in band for x in slots[i]):
            if kind != UNIT:
                values.setdefault((kind, item_value), set()).add(value)
        one = [len(v) == 1 or k[1] in v for k, v in values.items()]
        consistency = sum(one) / len(one) if one else 1.0
        if consistency >= CONSISTENCY and (best is None or (matched, consistency) > best):
            best = matched, consistency
            if best == (n_windows, 1.0):
                break
    return best


def _occurrences(pairs: DataFrame) -> DataFrame:
    """``(_key, _item, n_matched, consistency)`` of the texts that hold an item in one place, from the hits of each text
    in each item ``(_key, row, _item, item_row, hash, place, slots, item_place, item_slots, n_windows)``."""
    ddl = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("_key", "_item")) + ", n_matched bigint, consistency double"
    grouped = pairs.withColumn("_group", F.xxhash64("_key", "row", "_item", "item_row")).repartition("_group").sortWithinPartitions("_group")

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        rows = pa.Table.from_batches(held).combine_chunks()
        hits = {c: rows[c].to_numpy() for c in ("place", "item_place", "hash")}
        slots = [[(i["kind"], i["value"], d["value"]) for i, d in zip(a, b)] for a, b in zip(rows["item_slots"].to_pylist(), rows["slots"].to_pylist())]
        best = _best_occurrence(hits, slots, rows["n_windows"][0].as_py())
        if best is None:
            return None
        first = rows.slice(0, 1)
        columns = [first[c].combine_chunks() for c in ("_key", "_item")]
        columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
        return pa.RecordBatch.from_arrays([*columns, pa.array([best[0]], pa.int64()), pa.array([best[1]])], ["_key", "_item", "n_matched", "consistency"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        group = None
        for batch in batches:
            groups = batch.column(batch.schema.get_field_index("_group")).to_numpy()
            starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(groups)), bool), groups[1:] != groups[:-1])))
            for a, b in zip(starts, np.append(starts[1:], len(groups))):
                if held and groups[a] != group:
                    if (made := solve(held)) is not None:
                        yield made
                    held = []
                group = groups[a]
                held.append(batch.slice(a, b - a))
        if held and (made := solve(held)) is not None:
            yield made

    return grouped.mapInArrow(run, ddl)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``(key, item, n_windows, n_matched, coverage, consistency)`` for documents that hold a benchmark item.

    A pair is reported if the document has at least ``COVERAGE`` of the item's windows and the exchange of slot values
    is one for one for at least ``CONSISTENCY`` of them; a value that the document repeats unchanged counts as such, and
    units, which seldom change, are left out. This is judged over the document and, where that fails, over each place
    in which the item's windows stand in line, so variants of one item or stray windows do not hide a true one; counts
    are then those of the best place. An item of which less than half of the windows have ``LEAST_WORDS`` plain tokens
    is also looked for as it stands: as one run of tokens if it has up to ``WHOLE``, so that one of a single word is held
    by every document with the word, else by windows of ``WINDOW``. One in a script without spaces is looked for by
    windows of characters. ``n_windows`` counts the windows of the way that found it, templates first. Null and empty
    texts hold nothing. Items with the same id are one item.
    """
    found = _window_rows(benchmark, item, item_text, None)
    # From here on an item is its id and the way in which it is looked for.
    items = cut_lineage(found.withColumn("_item", F.struct(F.col(item).alias("id"), F.expr("size div 32").alias("way"))).drop(item))
    totals = items.groupBy("_item").agg(F.countDistinct("size", "hash").alias("n_windows"))
    n = items.count()
    passes = max(1, -(-n // BLOCK_WINDOWS))
    hits = None
    for p in range(passes):
        # One block of the benchmark, at most about BLOCK_WINDOWS hashes of 8 bytes, goes to every task.
        block = items.filter(F.pmod(F.xxhash64("hash"), F.lit(passes)) == p).select("size", "hash").distinct().toPandas()
        wanted = {int(s): np.sort(g["hash"].to_numpy(np.int64)) for s, g in block.groupby("size")}
        found = _window_rows(docs, key, text, wanted)
        hits = found if hits is None else hits.union(found)
    hits = cut_lineage(hits.withColumnRenamed(key, "_key"))
    windows = items.select("_item", "size", "hash").distinct()
    matched = hits.select("_key", "size", "hash").distinct().join(windows, ["size", "hash"]).groupBy("_key", "_item").agg(F.count(F.lit(1)).alias("n_matched"))
    kept = cut_lineage(matched.alias("a").join(totals.alias("b"), _same("_item")).select(
        "_key", "a._item", "n_windows", "n_matched", (F.col("n_matched") / F.col("n_windows")).alias("coverage")
    ).filter(F.col("coverage") >= COVERAGE))
    occurring = items.select("_item", F.col("row").alias("item_row"), "size", "hash", F.col("place").alias("item_place"), F.col("slots").alias("item_slots"))
    pairs = hits.join(occurring, ["size", "hash"])
    zipped = F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d"))
    exchanged = pairs.filter("size(slots) > 0").select("_key", "_item", F.explode(zipped).alias("z")).select(
        "_key", "_item", "z.i.kind", F.col("z.i.value").alias("item_value"), F.col("z.d.value").alias("value")
    ).filter(F.col("kind") != UNIT).distinct()
    per_value = exchanged.groupBy("_key", "_item", "kind", "item_value").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("value") == F.col("item_value")).alias("itself")
    )
    consistent = per_value.groupBy("_key", "_item").agg(
        F.avg(((F.col("n") == 1) | F.col("itself")).cast("double")).alias("consistency")
    )
    judged = cut_lineage(kept.alias("a").join(consistent.alias("b"), _same("_key") & _same("_item"), "left").select(
        "a._key", "a._item", "n_windows", "n_matched", "coverage", F.coalesce("consistency", F.lit(1.0)).alias("consistency"),
    ))
    whole = judged.filter(F.col("consistency") >= CONSISTENCY)
    open_pairs = judged.filter(F.col("consistency") < CONSISTENCY).select("_key", "_item", "n_windows")
    placed = pairs.alias("a").join(open_pairs.alias("b"), _same("_key") & _same("_item")).select(
        "a._key", "row", "a._item", "item_row", "hash", "place", "slots", "item_place", "item_slots", "n_windows"
    )
    best = _occurrences(placed).groupBy("_key", "_item").agg(F.max(F.struct("n_matched", "consistency")).alias("best"))
    apart = best.alias("a").join(open_pairs.alias("b"), _same("_key") & _same("_item")).select(
        "a._key", "a._item", "n_windows", "best.n_matched", (F.col("best.n_matched") / F.col("n_windows")).alias("coverage"), "best.consistency"
    )
    every = whole.union(apart).withColumn("_id", F.col("_item.id"))
    first = F.min_by(F.struct("n_windows", "n_matched", "coverage", "consistency"), "_item.way").alias("found")
    return every.groupBy("_key", "_id").agg(first).select(F.col("_key").alias(key), F.col("_id").alias(item), "found.*")


def _same(column: str) -> Column:
    return F.col(f"a.{column}").eqNullSafe(F.col(f"b.{column}"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, all columns kept. Rows are told apart by key and text, so a null or
    repeated key does not take other documents along."""
    row = free_name(docs, "_row_key")
    marked = docs.select(F.struct(F.col(key).alias("k"), F.xxhash64(text).alias("h")).alias(row), F.col(text).alias("_text"))
    gone = cut_lineage(contaminated(marked, benchmark, row, "_text").select(row).distinct())
    return docs.join(gone, F.col(key).eqNullSafe(F.col(f"{row}.k")) & (F.xxhash64(text) == F.col(f"{row}.h")), "left_anti")
