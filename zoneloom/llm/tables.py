"""What the operators share: opening tables, bounded chunks of a batch, hidden columns that cannot clash."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


_held: dict[str, Any] = {}


def held(name: str, make: Callable[[], Any]) -> Any:
    """What a worker keeps between its tasks, under a name. One thing at a time: the next operator's takes the place of
    the last one's, so a worker that serves many stages holds no more than one that serves one."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] = ()) -> DataFrame:
    """A whole input table, or some of its columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def free_name(df: DataFrame, name: str) -> str:
    """The name, made longer until no column of the table has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def byte_chunks(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of an Arrow string array that hold ``limit`` bytes at most, or one longer row."""
    first, size = 0, 0
    for row, length in enumerate(pc.binary_length(texts).to_pylist()):
        length = length or 0
        if row > first and size + length > limit:
            yield first, row
            first, size = row, 0
        size += length
    if first < len(texts):
        yield first, len(texts)
