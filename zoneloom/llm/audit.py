"""How filters act on each other: what each removes in every order, per part of the corpus.

A document's outcome in any order depends on nothing but the set of filters it fails, so the corpus is reduced to counts
per part and set. The repeat filter needs the whole table: counting Bloom sketches, merged from all tasks, clear the
texts that are surely unique, and only the others are shuffled and compared in full.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zoneloom.llm.rules import let, words_of
from zoneloom.session import cut_lineage

LETTERS = "ABCDE"
REPEAT = "E"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SIGNS = 50, 65, 5, "#$%&*|"

BLOCK_CELLS = 64  # counters of a block of the sketch; a text counts in two of one block
TEXTS_PER_BLOCK = 4
BROADCAST_BYTES = 32 << 20  # of the sketch, up to which it is sent to every task; larger ones are joined by block
BLOCK_BYTES = 16


def bit(letter: str) -> int:
    return 1 << LETTERS.index(letter)


def text_flags(text: Column) -> Column:
    """Bits of the filters that the text alone decides: few words, few distinct words, capitals, signs."""
    def of_words(words: Column) -> Column:
        few = F.when(F.size(words) < LEAST_WORDS, bit("A")).otherwise(0)
        return few + F.when(100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words), bit("B")).otherwise(0)

    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return (
        let(words_of(text), of_words) + F.when(100 * capitals > CAPITAL_PERCENT * F.length(text), bit("C")).otherwise(0)
        + F.when(text.rlike(f"[{SIGNS}]"), bit("D")).otherwise(0)
    )


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 12), F.lit(blocks).cast("bigint"))


def _cells(h: Column) -> tuple[Column, Column]:
    """Two different counters of the block, from hash bits that do not choose the block."""
    first = h.bitwiseAND(63)
    return first, (first + 1 + h.bitwiseAND(0xFC0) % (BLOCK_CELLS - 1)) % BLOCK_CELLS


def _mark(cell: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), cell.cast("int"))


def repeat_sketch(hashes: DataFrame, h: str, blocks: int) -> DataFrame:
    """``(block, repeated)``: the merged counting Bloom sketch, as the counters of each block that counted two or more.

    Every task adds up its own counters before they are merged, so a text in a third of all rows is one count of each
    task. Blocks with fewer than two such counters can hold no repeat and are left out.
    """
    cells = hashes.select(_block(F.col(h), blocks).alias("block"), F.explode(F.array(*_cells(F.col(h)))).alias("cell"))
    counters = cells.groupBy("block", "cell").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return counters.groupBy("block").agg(F.bit_or(_mark(F.col("cell"))).alias("repeated")).filter(F.bit_count("repeated") >= 2)


def repeated_texts(docs: DataFrame, sketch: DataFrame, blocks: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(digest, least)`` of every text that stands under two different keys: its SHA-256 and its least key.

    Only texts that the sketch does not clear are grouped, by the whole text. Rows without a key, and texts of one key
    alone, make no group; a null text counts as an empty one.
    """
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    probed = sketch if sketch.count() * BLOCK_BYTES > BROADCAST_BYTES else F.broadcast(sketch)
    first, second = (_mark(c) for c in _cells(F.col("h")))
    both = first.bitwiseOR(second)
    possible = rows.withColumn("block", _block(F.col("h"), blocks)).join(probed, "block").filter(F.col("repeated").bitwiseAND(both) == both)
    texts = possible.groupBy("h", "t").agg(F.min("k").alias("least"), F.max("k").alias("most")).filter("most > least")
    return texts.select(F.unhex(F.sha2("t", 256)).alias("digest"), "least")


def failure_sets(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents per part and set of filters they fail, all rows of ``docs`` counted.

    Null parts count as the empty string. A row fails the repeat filter if a smaller key has its text; rows without a
    key never do. Labels of a key labelled twice are joined by "or"; documents without one are neither good nor toxic.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    flagged = cut_lineage(docs.select(
        F.col(key).alias("k"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_flags(t).alias("mask"),
        F.unhex(F.sha2(t, 256)).alias("digest"), F.xxhash64(t).alias("h"),
    ))
    blocks = max(1, flagged.count() // TEXTS_PER_BLOCK)
    sketch = cut_lineage(repeat_sketch(flagged, "h", blocks))
    repeats = cut_lineage(repeated_texts(docs, sketch, blocks, key, text))
    marks = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"),
    )
    rows = flagged.join(repeats, "digest", "left").join(marks, "k", "left")
    mask = F.col("mask") + F.when(F.col("k") > F.col("least"), bit(REPEAT)).otherwise(0)
    return rows.groupBy("part", mask.alias("mask")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"),
    )


def interactions(sets: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from the counts of ``failure_sets``.

    A step removes what fails its filter and no earlier one. ``shapley`` adds up what the step's filter removes over all
    orders: a document that fails ``m`` filters falls to each of them in the same number of orders.
    """
    orders = ["".join(p) for p in permutations(LETTERS)]
    steps = F.array(*[
        F.struct(F.lit(o).alias("filter_order"), F.lit(i + 1).alias("step"), F.lit(bit(o[i])).alias("own"), F.lit(sum(map(bit, o[:i]))).alias("earlier"))
        for o in orders for i in range(len(o))
    ])
    cells = sets.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    rows = cells.select("part", "cells", F.explode(steps).alias("s")).select("part", "cells", "s.*")
    fails, passed = (lambda c: c["mask"].bitwiseAND(F.col("own")) != 0), (lambda c: c["mask"].bitwiseAND(F.col("earlier")) == 0)

    def total(where, value=lambda c: c["n"]) -> Column:
        return F.aggregate(F.filter("cells", where), F.lit(0).cast("bigint"), lambda a, c: a + value(c))

    removed = lambda c: fails(c) & passed(c)
    return rows.select(
        "part", "filter_order", "step",
        total(lambda c: ~fails(c) & passed(c)).alias("kept"), total(removed).alias("removed"), total(lambda c: fails(c) & ~passed(c)).alias("redundant"),
        total(lambda c: c["mask"] == F.col("own")).alias("unique_fails"), total(removed, lambda c: c["good"]).alias("good_lost"),
        total(removed, lambda c: c["toxic"]).alias("toxic_lost"),
        total(fails, lambda c: (c["n"] * len(orders) / F.bit_count(c["mask"])).cast("bigint")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``interactions`` of the five filters over ``docs``; an empty table has no parts and gives no rows."""
    return interactions(cut_lineage(failure_sets(docs, labels, key, text, part)))
